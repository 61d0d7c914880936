"""Static rule and configuration tables, and loaders for user-supplied ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import params as P

CONFIG_SCHEMA = ("position int, id string, name string, description string, risk_prompt string, tools array<string>, priority string, config_type string, "
                 "rule_id string, severity string, expected_clauses array<string>, expected_facts array<string>, "
                 "extract_fields array<struct<label:string,description:string>>")
RULE_SCHEMA = ("id string, name string, severity string, department string, keywords array<string>, logic_type string, fields array<string>, "
               "min_length int, suggestion string")
DECISION_SCHEMA = "rule_key string, condition string, config_id string, rule_id string, rule_name string, severity string, reason string, depends_on array<string>"


def default_configs(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(P.AUDIT_CONFIGS, CONFIG_SCHEMA).withColumn("enabled", F.lit(True))


def load_audit_configs(spark: SparkSession, path: str | None = None) -> DataFrame:
    """Enabled configurations, from a JSON table or the defaults."""
    c = default_configs(spark) if path is None else spark.read.schema(CONFIG_SCHEMA + ", enabled boolean").json(path)
    return c.where("enabled")


def rule_catalog(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(P.RULES, RULE_SCHEMA).withColumn("enabled", F.lit(True))


def default_decision_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(P.DECISION_RULES, DECISION_SCHEMA)


def load_decision_table(spark: SparkSession, path: str) -> DataFrame:
    """Decision-graph JSON (nodes holding rules with quoted outputs) to rule rows."""
    rule = ("_id string, input_condition string, output_config_id string, output_rule_id string, output_rule_name string, output_severity string, "
            "output_decision string, output_reason string, output_depends_on string, output_evidence_clause_ids string")
    g = spark.read.schema(f"nodes array<struct<content:struct<rules:array<struct<{rule.replace(' string', ':string')}>>>>>").option("multiLine", True).json(path)
    r = g.select(F.explode("nodes").alias("n")).select(F.explode("n.content.rules").alias("r")).select("r.*")
    plain = lambda c: F.nullif(F.regexp_replace(F.trim(c), '^"(.*)"$', "$1"), F.lit(""))
    return r.select(F.col("_id").alias("rule_key"), F.col("input_condition").alias("condition"), plain("output_config_id").alias("config_id"), plain("output_rule_id").alias("rule_id"),
                    plain("output_rule_name").alias("rule_name"), plain("output_severity").alias("severity"), plain("output_reason").alias("reason"),
                    F.from_json("output_depends_on", "array<string>").alias("depends_on")).where(F.col("rule_id").isNotNull())


def available_rule_ids(table: DataFrame) -> DataFrame:
    return table.select("rule_id").where(F.col("rule_id").isNotNull()).distinct()
