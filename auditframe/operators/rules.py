"""The two rule systems and their reconciliation."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import params as P
from ..functions import ordered as O
from ..functions import text as X

# --- catalogue rules on the contract schema ---------------------------------


def rule_drafts(kb: DataFrame, catalog=P.RULES, limit: int | None = None) -> DataFrame:
    """Draft rule per (document, catalogue rule) whose keywords occur in its policy clauses, with the ids of those clauses (or of the first ones).

    Only clauses with a hit are exploded.
    """
    hay = kb.where(F.col("doc_type") == "policy").withColumn("_h", X.joined("title", "content"))
    ids = X.all_keys("_h", {r[0]: r[4] for r in catalog})
    hit = hay.select("document_id", "clause_id", "page_start", "block_no", F.explode(ids).alias("rule_id"))
    place = ["page_start", "block_no", "clause_id"]
    lead = hit.withColumn("_r", F.struct(*place)) if limit is None else O.top_k(hit, ["document_id", "rule_id"], place, limit, "_r")
    d = lead.groupBy("document_id", "rule_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("_r", "clause_id"))), lambda s: s["clause_id"]).alias("basis_policy"))
    info = lambda i: X.lookup("rule_id", {r[0]: r[i] for r in catalog})
    return d.select("document_id", "rule_id", info(1).alias("name"), info(2).alias("severity"), info(3).alias("department"), info(8).alias("suggestion"), "basis_policy",
                    F.lit(False).alias("enabled"), F.lit("draft").alias("status"))


def _filled(field) -> Column:
    return F.coalesce(F.try_element_at("fields", F.lit(field)), F.lit(""))


def rule_condition(logic: str, fields: list[str], min_length: int) -> Column:
    """Boolean over one contract row: fields (map), category, template_id, template_category, outdated (boolean)."""
    pay, acc = _filled("payment_terms"), _filled("acceptance_standard")
    tax = F.coalesce(F.nullif(_filled("invoice"), F.lit("")), _filled("tax_rate"))
    breach, dispute = _filled("breach_liability"), _filled("dispute_resolution")
    none = F.lit(False)
    tables = {
        "template_required": lambda: F.col("template_id").isNull(),
        "template_category_match": lambda: F.col("template_id").isNotNull() & ~F.coalesce("template_category", F.lit("")).contains(F.col("category"))
        & ~F.col("category").contains(F.coalesce("template_category", F.lit(""))),
        "schema_required": lambda: _filled(fields[0]) == "",
        "required_any": lambda: reduce(lambda a, b: a & b, [_filled(f) == "" for f in fields]),
        "field_length_min": lambda: F.length(_filled(fields[0])) < min_length,
        "payment_acceptance_invoice": lambda: (pay != "") & (~pay.contains("验收") | (acc == "") | (tax == "")),
        "prepayment": lambda: pay.contains("预付") & ~pay.contains("验收"),
        "breach_equity": lambda: breach.contains("乙方") & ~breach.contains("甲方"),
        "dispute_bias": lambda: X.contains_any(dispute, P.VENUE_WORDS),
        "reference_outdated": lambda: F.coalesce("outdated", none),
    }
    return tables[logic]() if logic in tables else none


LOCATIONS = {"payment_acceptance_invoice": "付款条款", "prepayment": "付款条款", "breach_equity": "违约责任", "dispute_bias": "争议解决", "reference_outdated": "引用条款"}


def outdated_tasks(missing: DataFrame, types=P.OUTDATED_TYPES) -> DataFrame:
    return missing.groupBy("task_id").agg(F.bool_or(F.col("clause_type").isin(types)).alias("outdated"))


def run_rules(contracts: DataFrame, rules: DataFrame, max_rules: int = 2000) -> DataFrame:
    """Enabled rules x contracts -> hits.

    contracts: task_id, category, fields, template_id, template_name, template_category, outdated.
    The rule list is configuration: it is read (bounded by ``max_rules``, an
    error beyond) and compiled into one array expression, so a contract is
    scanned once and only its hits are exploded; there is no cross join.
    """
    rows = rules.where("enabled").orderBy("id").limit(max_rules + 1).collect()
    if len(rows) > max_rules:
        raise ValueError(f"more than {max_rules} enabled rules; split the rule table into several runs")
    hits = [
        F.when(rule_condition(r["logic_type"], list(r["fields"] or []), r["min_length"] or 0), X.literal({
            "rule_no": i, "rule_id": r["id"], "rule_name": r["name"], "severity": r["severity"], "department": r["department"],
            "suggestion": r["suggestion"], "basis_ids": list(r.asDict().get("basis_policy") or []), "clause_location": LOCATIONS.get(r["logic_type"], "")}))
        for i, r in enumerate(rows)]
    h = contracts.select("task_id", "template_name", F.explode(F.array_compact(F.array(*hits))).alias("h"))
    return h.select("task_id", "h.*", F.col("h.rule_name").alias("problem"), F.col("template_name").alias("basis_template"), F.lit(P.ISSUE_CONFIDENCE["rule"]).alias("confidence"))


# --- decision table ---------------------------------------------------------

_WORDS = re.compile(r"^[\w\s.'\"=!<>()一-龥-]*$")


def condition_sql(text: str) -> str:
    """Decision-table condition as a Spark SQL predicate: only the null tests and == differ."""
    if not _WORDS.match(text):
        raise ValueError(f"unsupported condition: {text}")
    s = re.sub(r"!=\s*null\b", "IS NOT NULL", re.sub(r"==\s*null\b", "IS NULL", text))
    return s.replace("==", "=")


def eval_decision_table(inputs: DataFrame, table=P.DECISION_RULES) -> DataFrame:
    """Every rule whose condition holds, as rows; the conditions become one array expression per contract."""
    outs = [
        F.when(F.expr(condition_sql(cond)), X.literal({
            "match_no": i, "config_id": cfg, "rule_id": rid, "rule_name": name, "severity": sev, "decision": "hit", "reason": reason, "depends_on": deps, "evidence_clause_ids": []}))
        for i, (_, cond, cfg, rid, name, sev, reason, deps) in enumerate(table)]
    return inputs.select("task_id", F.explode(F.array_compact(F.array(*outs))).alias("m")).select("task_id", "m.*")


def decision_matches(raw: DataFrame, configs: DataFrame) -> DataFrame:
    """Bind returned matches to enabled rule checks: by id, else to the first one with the rule id; fill defaults.

    raw: task_id, match_no, config_id, rule_id, rule_name, severity, decision, reason, depends_on, evidence_clause_ids.
    Configurations are a small table; the planner broadcasts it when its size allows and shuffles otherwise.
    """
    c = configs.where(F.col("enabled") & (F.col("config_type") == "rule_check")).select("position", F.col("id").alias("c_id"), F.col("name").alias("c_name"), F.col("description").alias("c_desc"), F.col("rule_id").alias("c_rule"), F.col("severity").alias("c_sev"))
    by_id = c.select(*[F.col(x).alias(f"i_{x}") for x in ("c_id", "c_name", "c_desc", "c_rule", "c_sev")])
    lead = O.first_by(c.where(F.col("c_rule").isNotNull()), ["c_rule"], ["position"]).select(*[F.col(x).alias(f"r_{x}") for x in ("c_id", "c_name", "c_desc", "c_rule", "c_sev")])
    j = raw.withColumn("config_id", F.nullif(X.strip(X.text_of("config_id")), F.lit(""))).withColumn("rule_id", F.nullif(X.strip(X.text_of("rule_id")), F.lit("")))
    j = j.join(by_id, F.col("config_id") == F.col("i_c_id"), "left").join(lead, F.col("rule_id") == F.col("r_c_rule"), "left")
    bound = lambda x: F.when(F.col("i_c_id").isNotNull(), F.col(f"i_{x}")).otherwise(F.col(f"r_{x}"))
    nz = lambda x: F.nullif(F.col(x), F.lit(""))
    return j.select("task_id", "match_no", F.coalesce("config_id", bound("c_id")).alias("config_id"), bound("c_id").alias("bound_config_id"), F.coalesce("rule_id", bound("c_rule")).alias("rule_id"),
                    F.coalesce(nz("rule_name"), bound("c_name"), F.lit("未命名规则")).alias("rule_name"), F.coalesce(nz("severity"), bound("c_sev"), F.lit("medium")).alias("severity"),
                    F.coalesce(nz("decision"), F.lit("hit")).alias("decision"), F.coalesce(nz("reason"), bound("c_desc"), F.lit("")).alias("reason"), "depends_on", "evidence_clause_ids")


def configured_rules(configs: DataFrame) -> DataFrame:
    c = configs.where(F.col("enabled") & (F.col("config_type") == "rule_check"))
    return c.select("position", F.col("id").alias("config_id"), "name", F.nullif(F.trim("rule_id"), F.lit("")).alias("rule_id"), "severity", F.transform("extract_fields", lambda e: e["label"]).alias("extract_labels"))


def missing_configured(configs: DataFrame, available: DataFrame) -> DataFrame:
    """Configured rule ids the decision table does not hold; none when the table is empty."""
    c = configured_rules(configs).where(F.col("rule_id").isNotNull())
    some = available.agg((F.count(F.lit(1)) > 0).alias("_some"))  # one row
    return c.join(available.select("rule_id").distinct(), "rule_id", "left_anti").join(F.broadcast(some)).where("_some").drop("_some", "extract_labels", "severity")


def unmatched_returned(matches: DataFrame, configs: DataFrame) -> DataFrame:
    c = configured_rules(configs)
    m = matches.join(c.select("config_id"), "config_id", "left_anti")
    return m.join(c.where(F.col("rule_id").isNotNull()).select("rule_id").distinct(), "rule_id", "left_anti").select("task_id", "match_no", "config_id", "rule_id", "rule_name")


def engine_status(tasks: DataFrame, configs: DataFrame, responses: DataFrame, missing: DataFrame, unmatched: DataFrame, connected: bool = True) -> DataFrame:
    """Per contract: no_rule_configs, not_connected, engine_error (no response row), ok or ok_with_warnings."""
    n = configured_rules(configs).agg(F.count(F.lit(1)).alias("n_configs"))
    m = missing.agg(F.count(F.lit(1)).alias("n_missing"))
    u = unmatched.groupBy("task_id").agg(F.count(F.lit(1)).alias("n_unmatched"))
    r = responses.select("task_id", F.lit(True).alias("_answered")).distinct()
    j = tasks.select("task_id").distinct().join(r, "task_id", "left").join(u, "task_id", "left").join(F.broadcast(n)).join(F.broadcast(m))
    status = (F.when(F.col("n_configs") == 0, "no_rule_configs").when(F.lit(not connected), "not_connected").when(F.col("_answered").isNull(), "engine_error")
              .when((F.col("n_missing") > 0) | (F.coalesce("n_unmatched", F.lit(0)) > 0), "ok_with_warnings").otherwise("ok"))
    return j.select("task_id", status.alias("status"), "n_configs", "n_missing", F.coalesce("n_unmatched", F.lit(0)).alias("n_unmatched"))


def rule_exec_status(status: DataFrame, configs: DataFrame, matches: DataFrame, missing: DataFrame) -> DataFrame:
    """Per contract and rule configuration: execution status, risk, confidence, reason, review hint."""
    c = configs.where(F.col("enabled") & (F.col("config_type") == "rule_check"))
    c = c.withColumn("rule_id", F.nullif(F.trim("rule_id"), F.lit(""))).select("position", F.col("id").alias("config_id"), "name", "rule_id", F.col("severity").alias("c_sev"),
        F.coalesce(F.nullif("description", F.lit("")), F.col("risk_prompt")).alias("c_reason"), "expected_clauses", "tools", F.array_distinct(F.transform("extract_fields", lambda e: e["label"])).alias("extract_labels"))
    c = c.join(missing.select("config_id", F.lit(True).alias("_gone")), "config_id", "left")
    # every contract gets every rule configuration: the configurations travel as one array value
    packed = c.agg(F.array_sort(F.collect_list(F.struct("position", "config_id", "name", "rule_id", "c_sev", "c_reason", "expected_clauses", "tools", "extract_labels", "_gone"))).alias("cs"))
    t = status.select("task_id", F.col("status").alias("engine")).join(F.broadcast(packed)).select("task_id", "engine", F.explode("cs").alias("c")).select("task_id", "engine", "c.*")
    m = matches.select("task_id", "match_no", "config_id", F.col("rule_id").alias("m_rule"), F.col("severity").alias("m_sev"), F.col("reason").alias("m_reason"), "depends_on", "evidence_clause_ids")
    last = lambda k: m.where(F.col(k).isNotNull()).groupBy("task_id", k).agg(F.max_by(F.struct("m_sev", "m_reason", "depends_on", "evidence_clause_ids"), "match_no").alias("b"))
    t = t.join(last("config_id").withColumnRenamed("b", "b1"), ["task_id", "config_id"], "left")
    t = t.join(last("m_rule").select("task_id", F.col("m_rule").alias("rule_id"), F.col("b").alias("b2")), ["task_id", "rule_id"], "left")
    t = t.withColumn("b", F.coalesce("b1", "b2"))
    st = (F.when(F.col("engine").isin("engine_error", "not_connected"), F.col("engine")).when(F.col("_gone"), "missing_in_engine").when(F.col("b").isNotNull(), "hit").otherwise("not_hit"))
    t = t.withColumn("exec_status", st)
    s = F.col("exec_status")
    risk = F.when(s == "hit", F.lower(F.coalesce(F.nullif("b.m_sev", F.lit("")), F.col("c_sev"), F.lit("medium")))).when(s == "not_hit", "low").otherwise("pending_verification")
    reason = (F.when(s == "hit", F.trim(F.coalesce(F.nullif("b.m_reason", F.lit("")), F.col("c_reason"))))
              .when(s == "engine_error", F.concat(F.lit("规则引擎执行失败，当前状态为 "), "engine", F.lit("。"))).otherwise(X.lookup("exec_status", P.EXEC_REASON)))
    deps = F.filter(F.transform(F.coalesce("b.depends_on", F.array().cast("array<string>")), X.strip), lambda x: x != "")
    return t.select("task_id", "position", "config_id", "rule_id", "name", "exec_status", risk.alias("risk_level"),
                    X.lookup("exec_status", P.EXEC_CONFIDENCE).alias("confidence"), reason.alias("reason"), X.lookup("exec_status", P.EXEC_REVIEW).alias("human_review"),
                    F.when(F.size("b.depends_on") > 0, deps).otherwise(F.col("extract_labels")).alias("depends_on"), "expected_clauses", "tools", "b.evidence_clause_ids")
