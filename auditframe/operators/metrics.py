"""Reporting aggregates shown next to results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import params as P
from ..functions import ordered as O
from ..functions import text as X
from .registry import rule_dedupe


def registry_metrics(docs: DataFrame, rules: DataFrame) -> DataFrame:
    d = docs.agg(F.count(F.lit(1)).alias("documents"), F.count_if(F.col("status") == "effective").alias("active_documents"), F.count_if("current_version").alias("current_versions"),
                 F.count_if(F.col("doc_type") == "policy").alias("policies"), F.count_if(F.col("doc_type") == "template").alias("templates"))
    r = rules.agg(F.count(F.lit(1)).alias("rules"), F.count_if("enabled").alias("enabled_rules"), F.count_if(~F.col("enabled")).alias("disabled_rules"), F.count_distinct("source_document_id").alias("source_documents"))
    return d.join(F.broadcast(r))  # one row each


def documents_in_order(docs: DataFrame) -> DataFrame:
    return docs.orderBy(F.desc("current_version"), "name", F.desc("effective_ts"), "document_id")


def rules_in_order(rules: DataFrame) -> DataFrame:
    return rule_dedupe(rules, "last").orderBy(F.desc("enabled"), "rule_id", "source_document_id")


def _buckets(df: DataFrame, column: str, order: list[str]) -> DataFrame:
    n = df.where(F.col(column).isin(order)).groupBy("task_id", column).agg(F.count(F.lit(1)).alias("n"))
    rank = F.array_position(X.literal(order), F.col(column))
    return n.withColumn("position", rank)


def focus_buckets(focuses: DataFrame) -> DataFrame:
    return _buckets(focuses, "focus_source", P.FOCUS_BUCKETS)


def clause_buckets(clauses: DataFrame) -> DataFrame:
    return _buckets(clauses, "label_source", P.CLAUSE_BUCKETS)


def verification_buckets(items: DataFrame) -> DataFrame:
    s = F.col("status")
    return items.groupBy("task_id").agg(F.count_if(s == "pass").alias("passed"), F.count_if(s == "warning").alias("warnings"), F.count_if(s == "external_pending").alias("pending"),
                                        F.count_if(F.col("source") == "external_dependency").alias("need_tool"))


def related_clause_labels(items: DataFrame, clauses: DataFrame) -> DataFrame:
    e = items.select("task_id", "item_id", F.posexplode("clause_ids").alias("pos", "clause_id")).join(clauses.select("task_id", "clause_id", F.concat_ws(" / ", "label", "title").alias("l")), ["task_id", "clause_id"])
    return e.groupBy("task_id", "item_id").agg(O.joined_list("l", ["pos"], "；").alias("labels"))


def kb_result_filter(focuses: DataFrame, items: DataFrame) -> tuple[DataFrame, DataFrame]:
    return focuses.where(F.col("focus_source") == "knowledge_base_rule_check"), items.where(F.col("source") == "knowledge_base")


def overview_cards(facts: DataFrame, tasks: DataFrame, slots=P.OVERVIEW_SLOTS) -> DataFrame:
    """One card per slot: the first fact with a slot label; the party card is built from both parties when absent."""
    first = lambda labels: F.min_by(F.when(F.col("label").isin(labels), F.struct("value", "confidence")), F.when(F.col("label").isin(labels), F.col("ord")))
    g = facts.groupBy("task_id").agg(*[first(labels).alias(f"s{i}") for i, (_, labels) in enumerate(slots)], first(["甲方"]).alias("pa"), first(["乙方"]).alias("pb"))
    both = F.concat_ws("；", F.concat(F.lit("甲方："), "pa.value"), F.concat(F.lit("乙方："), "pb.value"))
    party = F.when(F.col("pa").isNotNull() | F.col("pb").isNotNull(), F.struct(both.alias("value"), F.greatest(F.coalesce("pa.confidence", F.lit(0.0)), F.coalesce("pb.confidence", F.lit(0.0))).alias("confidence")))
    cards = F.array(*[F.struct(F.lit(i).alias("position"), F.lit(t).alias("title"), (F.coalesce(f"s{i}", party) if t == "甲乙方信息" else F.col(f"s{i}")).alias("f")) for i, (t, _) in enumerate(slots, start=0)])
    j = tasks.select("task_id").distinct().join(g, "task_id", "left").select("task_id", F.explode(cards).alias("c"))
    value = F.coalesce(F.nullif(X.strip(F.col("c.f.value")), F.lit("")), F.lit("未提取"))
    muted = F.col("c.f").isNull() | (X.strip(X.text_of("c.f.value")) == "未提取")
    return j.select("task_id", (F.col("c.position") + 1).alias("position"), "c.title", value.alias("value"), F.coalesce("c.f.confidence", F.lit(0.0)).alias("confidence"), muted.alias("muted"))


def contract_number_of(facts: DataFrame) -> DataFrame:
    f = facts.where(F.col("label").isin("合同编号", "协议编号"))
    return f.groupBy("task_id").agg(X.null_if_missing(F.min_by("value", "ord")).alias("contract_number"))


def template_pages(catalog: DataFrame) -> DataFrame:
    ok = F.col("start_page") <= F.col("end_page")
    return catalog.withColumn("page", F.explode(F.when(ok, F.sequence("start_page", "end_page"))))
