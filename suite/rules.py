"""Rules (survey section 2.7)."""

from pyspark.sql import functions as F

from auditframe import params as P
from auditframe.operators import clauses as C
from auditframe.operators import rules as R
from auditframe.plans import bridge as B
from auditframe.sources import configs as G

from . import sqlkit as S
from .clauses import HAY, RIN, SCHEMA, classified, rule_inputs, schema
from .registry import query

CFG = f"""cfg AS (SELECT * FROM {S.values([(c[0], c[1], c[2], c[3], c[4], c[7], c[8], c[9], c[10], [l for l, _ in c[12]]) for c in P.AUDIT_CONFIGS])} t(position, id, name, description, prompt, config_type, rule_id, severity, expected, labels))"""


@query("rule_catalog", f"SELECT t.id, t.name, t.severity, t.department, count(clause_id)::BIGINT AS n_clauses FROM {S.values([r[:5] for r in P.RULES])} t(id, name, severity, department, words) LEFT JOIN kb ON len(list_filter(words, lambda w: contains(title || chr(10) || content, w))) > 0 GROUP BY ALL")
def _(spark, sf):
    """The catalogue with the number of knowledge clauses that speak about each rule."""
    from auditframe.functions import text as X
    cat = G.rule_catalog(spark)
    k = B.kb_clauses(spark, sf).withColumn("h", X.joined("title", "content"))
    ids = X.all_keys("h", {r[0]: r[4] for r in P.RULES})
    n = k.select(F.explode(ids).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    return cat.join(n, "id", "left").select("id", "name", "severity", "department", F.coalesce("n", F.lit(0)).alias("n_clauses"))


@query("rule_drafts", f"""WITH c AS (SELECT * FROM {S.values([(r[0], r[1], r[4]) for r in P.RULES])} t(rule_id, name, words)),
    h AS (SELECT document_id, rule_id, name, clause_id, row_number() OVER (PARTITION BY document_id, rule_id ORDER BY page_start, block_no) AS r FROM kb JOIN c ON len(list_filter(words, lambda w: contains(title || chr(10) || content, w))) > 0 WHERE doc_type = 'policy')
    SELECT document_id, rule_id, name, string_agg(clause_id, '|' ORDER BY r) AS basis_policy FROM h GROUP BY ALL""")
def _(spark, sf):
    return R.rule_drafts(B.kb_clauses(spark, sf)).select("document_id", "rule_id", "name", "basis_policy")


@B.memo
def contracts(spark, sf):
    """Contracts with fields, category and, for most, a template of varying category."""
    d = B.documents(spark, sf)
    sch = schema(spark, sf)
    prepaid = (F.col("field") == "payment_terms") & (F.substring("task_id", 6, 20).cast("long") % 4 == 0)
    f = C.schema_fields(sch.withColumn("value", F.when(prepaid, "合同生效后支付预付款").otherwise(F.col("value"))), d)
    cats = F.array(*map(F.lit, S.CATS))
    i = F.col("doc_id")
    x = d.select("task_id", "doc_id").join(classified(spark, sf).select("task_id", "category"), "task_id").join(f, "task_id")
    has = i % 5 != 0
    return x.select("task_id", "category", "fields", F.when(has, F.concat(F.lit("tpl_"), i)).alias("template_id"), F.when(has, F.concat(F.lit("name_"), i)).alias("template_name"),
                    F.when(has, F.get(cats, (i % 6).cast("int"))).alias("template_category"), (i % 9 == 0).alias("outdated"))


def _cond(logic, fields, n):
    v = lambda f: f"coalesce(f['{f}'], '')"
    pay = v("payment_terms")
    return {
        "template_required": "template_id IS NULL",
        "template_category_match": "template_id IS NOT NULL AND NOT contains(coalesce(tcat, ''), category) AND NOT contains(category, coalesce(tcat, ''))",
        "schema_required": f"{v(fields[0] if fields else 'x')} = ''",
        "required_any": " AND ".join(f"{v(f)} = ''" for f in fields) or "FALSE",
        "field_length_min": f"length({v(fields[0] if fields else 'x')}) < {n}",
        "payment_acceptance_invoice": f"{pay} <> '' AND (NOT contains({pay}, '验收') OR {v('acceptance_standard')} = '' OR ({v('invoice')} = '' AND {v('tax_rate')} = ''))",
        "prepayment": f"contains({pay}, '预付') AND NOT contains({pay}, '验收')",
        "breach_equity": f"contains({v('breach_liability')}, '乙方') AND NOT contains({v('breach_liability')}, '甲方')",
        "dispute_bias": S.has(v("dispute_resolution"), P.VENUE_WORDS),
        "reference_outdated": "outdated",
    }[logic]


CON = f"""{HAY}, {SCHEMA}, fm AS (SELECT task_id, map_from_entries(list((field, CASE WHEN field = 'payment_terms' AND substr(task_id, 6)::INT % 4 = 0 THEN '合同生效后支付预付款' ELSE value END))) AS f FROM sch GROUP BY task_id),
    con AS (SELECT d.task_id, category, coalesce(f, MAP {{}}) AS f, CASE WHEN doc_id % 5 <> 0 THEN 'tpl_' || doc_id END AS template_id, CASE WHEN doc_id % 5 <> 0 THEN 'name_' || doc_id END AS template_name, CASE WHEN doc_id % 5 <> 0 THEN ({S.lst(S.CATS)})[doc_id % 6 + 1] END AS tcat, doc_id % 9 = 0 AS outdated FROM docs d JOIN cls USING (task_id) LEFT JOIN fm USING (task_id))"""
HITS = f"{CON}, hits AS (" + " UNION ALL ".join(f"SELECT task_id, {i} AS rule_no, {S.q(r[0])} AS rule_id, {S.q(r[1])} AS problem, {S.q(r[2])} AS severity, {S.q(r[3])} AS department, {S.q(r[8])} AS suggestion, {S.q(R.LOCATIONS.get(r[5], ''))} AS clause_location, template_name AS basis_template FROM con WHERE {_cond(r[5], r[6], r[7])}" for i, r in enumerate(P.RULES)) + ")"


@B.memo
def hits(spark, sf):
    return R.run_rules(contracts(spark, sf), G.rule_catalog(spark))


@query("run_rules", f"WITH {HITS} SELECT task_id, rule_id, problem, severity, clause_location, basis_template, 0.86::DOUBLE AS confidence FROM hits")
def _(spark, sf):
    return hits(spark, sf).select("task_id", "rule_id", "problem", "severity", "clause_location", "basis_template", "confidence")


def _register(logic):
    """One query per logic type: the same contracts, only the rules of that type."""
    rows = [r for r in P.RULES if r[5] == logic]
    names = {"template_category_match": "rule_template_category", "payment_acceptance_invoice": "rule_payment_binding"}
    sql = " UNION ALL ".join(f"SELECT task_id, {S.q(r[0])} AS rule_id FROM con WHERE {_cond(r[5], r[6], r[7])}" for r in rows)

    @query(names.get(logic, f"rule_{logic}"), f"WITH {CON} {sql}")
    def run(spark, sf):
        return R.run_rules(contracts(spark, sf), G.rule_catalog(spark).where(F.col("logic_type") == logic)).select("task_id", "rule_id")


for _logic in ["template_required", "template_category_match", "schema_required", "required_any", "field_length_min", "payment_acceptance_invoice", "prepayment", "breach_equity", "dispute_bias", "reference_outdated"]:
    _register(_logic)

_DC = {"missing_contract_number": "number IS NULL", "payment_without_acceptance_gate": "hasPaymentClause AND NOT hasAcceptanceClause", "missing_breach_clause": "NOT hasBreachClause",
       "missing_account_info": "account IS NULL", "amount_present_but_payment_missing": "amount IS NOT NULL AND NOT hasPaymentClause"}
EVAL = f"{RIN}, ev AS (" + " UNION ALL ".join(f"SELECT task_id, {i} AS match_no, {S.q(r[2])} AS config_id, {S.q(r[3])} AS rule_id, {S.q(r[4])} AS rule_name, {S.q(r[5])} AS severity, {S.q(r[6])} AS reason, {S.q('|'.join(r[7]))} AS depends_on FROM ri WHERE {_DC[r[3]]}" for i, r in enumerate(P.DECISION_RULES)) + ")"


@query("eval_decision_table", f"WITH {EVAL} SELECT task_id, match_no::BIGINT AS match_no, config_id, rule_id, rule_name, severity, reason, depends_on FROM ev")
def _(spark, sf):
    return R.eval_decision_table(rule_inputs(spark, sf)).select("task_id", "match_no", "config_id", "rule_id", "rule_name", "severity", "reason", "depends_on")


@B.memo
def raw_matches(spark, sf):
    """Decision hits as an external engine may return them: some without config id, some unknown, some without texts."""
    e = R.eval_decision_table(rule_inputs(spark, sf)).drop("evidence_clause_ids")
    k = F.col("match_no")
    lead = B.clauses(spark, sf).where(F.col("core_label") == "合同金额").groupBy("task_id").agg(F.min_by("clause_id", "sort_order").alias("_c"))
    e = e.join(lead, "task_id", "left").withColumn("evidence_clause_ids", F.when((k == 0) & F.col("_c").isNotNull(), F.array("_c", F.lit("nope"))).otherwise(F.array().cast("array<string>"))).drop("_c")
    e = e.withColumn("config_id", F.when(k == 1, F.lit("rule_001")).when(k == 3, F.lit(None).cast("string")).otherwise(F.col("config_id")))
    e = e.withColumn("rule_id", F.when(k == 2, F.lit("unknown_rule")).otherwise(F.col("rule_id")))
    return e.withColumn("rule_name", F.when(k == 3, "").otherwise(F.col("rule_name"))).withColumn("severity", F.when(k == 3, "").otherwise(F.col("severity"))).withColumn("reason", F.when(k == 3, "").otherwise(F.col("reason")))


RAW = f"""{EVAL}, {CFG}, lead AS (SELECT task_id, arg_min(clause_id, sort_order) AS c FROM clauses WHERE core_label = '合同金额' GROUP BY task_id),
    raw AS (SELECT task_id, match_no, CASE match_no WHEN 1 THEN 'rule_001' WHEN 3 THEN NULL ELSE config_id END AS config_id, CASE WHEN match_no = 2 THEN 'unknown_rule' ELSE rule_id END AS rule_id, CASE WHEN match_no = 3 THEN NULL ELSE rule_name END AS rule_name, CASE WHEN match_no = 3 THEN NULL ELSE severity END AS severity, CASE WHEN match_no = 3 THEN NULL ELSE reason END AS reason, depends_on, CASE WHEN match_no = 0 THEN c END AS ev FROM ev LEFT JOIN lead USING (task_id)),
    dm AS (SELECT task_id, match_no::BIGINT AS match_no, coalesce(r.config_id, coalesce(i.id, b.id)) AS config_id, coalesce(i.id, b.id) AS bound_config_id, coalesce(r.rule_id, i.rule_id, b.rule_id) AS rule_id, coalesce(r.rule_name, i.name, b.name, '未命名规则') AS rule_name, coalesce(r.severity, i.severity, b.severity, 'medium') AS severity, 'hit' AS decision, coalesce(r.reason, i.description, b.description, '') AS reason, depends_on, ev
      FROM raw r LEFT JOIN (SELECT * FROM cfg WHERE config_type = 'rule_check') i ON r.config_id = i.id LEFT JOIN (SELECT * FROM cfg WHERE config_type = 'rule_check') b ON r.rule_id = b.rule_id)"""


@B.memo
def bound(spark, sf):
    return R.decision_matches(raw_matches(spark, sf), G.default_configs(spark))


@query("decision_matches", f"WITH {RAW} SELECT task_id, match_no, config_id, bound_config_id, rule_id, rule_name, severity, decision, reason FROM dm")
def _(spark, sf):
    return bound(spark, sf).drop("depends_on", "evidence_clause_ids")


@query("configured_rules", f"WITH {CFG}, n AS (SELECT core_label, count(*) AS n FROM clauses GROUP BY core_label) SELECT id AS config_id, name, rule_id, severity, array_to_string(labels, '|') AS extract_labels, coalesce(sum(n.n), 0)::BIGINT AS n_clauses FROM (SELECT *, unnest(CASE WHEN len(labels) = 0 THEN [''] ELSE labels END) AS lb FROM cfg WHERE config_type = 'rule_check') LEFT JOIN n ON lb = core_label GROUP BY ALL")
def _(spark, sf):
    """Configured rules with the number of clauses whose label is one of the fields they ask for."""
    c = R.configured_rules(G.default_configs(spark))
    n = B.clauses(spark, sf).groupBy(F.col("core_label").alias("lb")).agg(F.count(F.lit(1)).alias("n"))
    w = c.select("config_id", F.explode("extract_labels").alias("lb")).join(n, "lb", "left").groupBy("config_id").agg(F.sum(F.coalesce("n", F.lit(0))).alias("n_clauses"))
    return c.join(w, "config_id", "left").select("config_id", "name", "rule_id", "severity", "extract_labels", F.coalesce("n_clauses", F.lit(0)).alias("n_clauses"))


@B.memo
def available(spark, sf):
    """Rules an engine shows by having answered with them at least once."""
    return R.eval_decision_table(rule_inputs(spark, sf)).where(F.col("rule_id") != "missing_account_info").select("rule_id").distinct()


MISSING = "miss AS (SELECT position, id AS config_id, name, rule_id FROM cfg WHERE config_type = 'rule_check' AND rule_id NOT IN (SELECT rule_id FROM ev WHERE rule_id <> 'missing_account_info'))"


@query("missing_configured", f"WITH {RAW}, {MISSING} SELECT config_id, name, rule_id FROM miss")
def _(spark, sf):
    return R.missing_configured(G.default_configs(spark), available(spark, sf)).select("config_id", "name", "rule_id")


UNM = "unm AS (SELECT task_id, match_no, config_id, rule_id, rule_name FROM dm WHERE NOT coalesce(config_id IN (SELECT id FROM cfg WHERE config_type = 'rule_check'), FALSE) AND NOT coalesce(rule_id IN (SELECT rule_id FROM cfg WHERE rule_id IS NOT NULL), FALSE))"


@query("unmatched_returned", f"WITH {RAW}, {UNM} SELECT * FROM unm")
def _(spark, sf):
    return R.unmatched_returned(bound(spark, sf), G.default_configs(spark))


STATUS = f"{RAW}, {MISSING}, {UNM}, stt AS (SELECT d.task_id, CASE WHEN doc_id % 10 = 0 THEN 'engine_error' WHEN (SELECT count(*) FROM miss) > 0 OR d.task_id IN (SELECT task_id FROM unm) THEN 'ok_with_warnings' ELSE 'ok' END AS status FROM docs d)"


@B.memo
def engine(spark, sf):
    d, cfg, b = B.documents(spark, sf), G.default_configs(spark), bound(spark, sf)
    miss = R.missing_configured(cfg, available(spark, sf))
    return R.engine_status(d, cfg, d.where(F.col("doc_id") % 10 != 0), miss, R.unmatched_returned(b, cfg)), cfg, b, miss


@query("engine_status", f"WITH {STATUS} SELECT task_id, status FROM stt")
def _(spark, sf):
    return engine(spark, sf)[0].select("task_id", "status")


def _m(k, v):
    return "CASE st " + " ".join(f"WHEN {S.q(a)} THEN {S.q(b)}" for a, b in k.items()) + f" {v} END"


EXEC = f"""{STATUS}, x0 AS (SELECT s.task_id, status, c.*, (SELECT arg_max(struct_pack(sev := d.severity, reason := d.reason, dep := d.depends_on, ev := d.ev), match_no) FROM dm d WHERE d.task_id = s.task_id AND d.config_id = c.id) AS b1, (SELECT arg_max(struct_pack(sev := d.severity, reason := d.reason, dep := d.depends_on, ev := d.ev), match_no) FROM dm d WHERE d.task_id = s.task_id AND d.rule_id = c.rule_id) AS b2 FROM stt s, cfg c WHERE config_type = 'rule_check'),
    x1 AS (SELECT *, coalesce(b1, b2) AS b, CASE WHEN status = 'engine_error' THEN status WHEN id IN (SELECT config_id FROM miss) THEN 'missing_in_engine' WHEN coalesce(b1, b2) IS NOT NULL THEN 'hit' ELSE 'not_hit' END AS st FROM x0),
    xs AS (SELECT task_id, position::BIGINT AS position, id AS config_id, rule_id, name, st AS exec_status, CASE st WHEN 'hit' THEN lower(coalesce(b.sev, severity, 'medium')) WHEN 'not_hit' THEN 'low' ELSE 'pending_verification' END AS risk_level, {_m(P.EXEC_CONFIDENCE, 'ELSE 0.66')}::DOUBLE AS confidence,
      CASE st WHEN 'hit' THEN trim(coalesce(nullif(b.reason, ''), description)) WHEN 'engine_error' THEN '规则引擎执行失败，当前状态为 engine_error。' ELSE {_m(P.EXEC_REASON, '')} END AS reason, {_m(P.EXEC_REVIEW, '')} AS human_review, CASE WHEN coalesce(b.dep, '') <> '' THEN b.dep ELSE array_to_string(labels, '|') END AS depends_on, b.ev AS ev, expected FROM x1)"""


@B.memo
def exec_rows(spark, sf):
    s, cfg, b, miss = engine(spark, sf)
    return R.rule_exec_status(s, cfg, b, miss)


@query("rule_exec_status", f"WITH {EXEC} SELECT task_id, position, config_id, rule_id, name, exec_status, risk_level, confidence, reason, human_review, depends_on FROM xs")
def _(spark, sf):
    return exec_rows(spark, sf).drop("expected_clauses", "tools", "evidence_clause_ids")
