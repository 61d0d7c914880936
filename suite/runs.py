"""Comparison of two runs (survey section 2.10).  Run b is run a with shifted labels, values and pages."""

from pyspark.sql import functions as F

from auditframe.functions import text as X
from auditframe.operators import runs as N
from auditframe.plans import bridge as B

from . import sqlkit as S
from .registry import query

AB = """ca AS (SELECT task_id, clause_id, CASE WHEN sort_order % 8 = 0 THEN label || '*' ELSE label END AS title, label, core_label, sort_order FROM clauses),
    cb AS (SELECT task_id, clause_id, CASE WHEN sort_order % 3 = 0 THEN label || ' 改' ELSE label END AS title, label, CASE WHEN sort_order % 8 = 0 THEN '其他重要条款' ELSE core_label END AS core_label, sort_order FROM clauses WHERE doc_id % 9 <> 0),
    fa AS (SELECT task_id, label, value, sort_order AS ord FROM key_facts), fb AS (SELECT task_id, label, CASE WHEN sort_order % 6 = 0 THEN '变更' ELSE value END AS value, sort_order AS ord FROM key_facts WHERE doc_id % 9 <> 0),
    sa AS (SELECT task_id, CASE WHEN block_no % 2 = 0 THEN '第' || block_no || '条' ELSE '（一）' END AS section_code, text AS title, 1 + block_no % 2 AS level, block_no AS sort_order FROM blocks),
    sb AS (SELECT task_id, section_code, CASE WHEN sort_order % 4 = 0 THEN title || '!' ELSE title END AS title, level, sort_order FROM sa)"""


def _runs(spark, sf):
    c, f, b = B.clauses(spark, sf), B.key_facts(spark, sf), B.blocks(spark, sf)
    n = F.col("sort_order")
    ca = c.select("task_id", "clause_id", F.when(n % 8 == 0, F.concat("label", F.lit("*"))).otherwise(F.col("label")).alias("title"), "label", "core_label", "sort_order")
    cb = c.where(F.col("doc_id") % 9 != 0).select("task_id", "clause_id", F.when(n % 3 == 0, F.concat("label", F.lit(" 改"))).otherwise(F.col("label")).alias("title"), "label", F.when(n % 8 == 0, "其他重要条款").otherwise(F.col("core_label")).alias("core_label"), "sort_order")
    fa = f.select("task_id", "label", "value", n.alias("ord"))
    fb = f.where(F.col("doc_id") % 9 != 0).select("task_id", "label", F.when(n % 6 == 0, "变更").otherwise(F.col("value")).alias("value"), n.alias("ord"))
    k = F.col("block_no")
    sa = b.select("task_id", F.when(k % 2 == 0, F.concat(F.lit("第"), "block_no", F.lit("条"))).otherwise("（一）").alias("section_code"), F.col("text").alias("title"), (1 + k % 2).alias("level"), k.alias("sort_order"))
    sb = sa.withColumn("title", F.when(F.col("sort_order") % 4 == 0, F.concat("title", F.lit("!"))).otherwise(F.col("title")))
    return ca, cb, fa, fb, sa, sb


runs = B.memo(_runs)
NK = lambda c: S.sub(f"lower({c})", f"[{S.WS}]+")


def overlap_sql(a, b, col, name):
    return f"""{name}a AS (SELECT task_id, {NK(col)} AS k, count(*) AS n, min({col}) AS v FROM {a} GROUP BY ALL), {name}b AS (SELECT task_id, {NK(col)} AS k, count(*) AS n, min({col}) AS v FROM {b} GROUP BY ALL),
    {name}j AS (SELECT coalesce(x.task_id, y.task_id) AS task_id, coalesce(x.k, y.k) AS k, x.n AS na, y.n AS nb, x.v AS va, y.v AS vb FROM {name}a x FULL JOIN {name}b y ON x.task_id = y.task_id AND x.k = y.k),
    {name} AS (SELECT task_id, coalesce(sum(na), 0)::BIGINT AS baseline_count, coalesce(sum(nb), 0)::BIGINT AS candidate_count, count_if(k <> '' AND na IS NOT NULL AND nb IS NOT NULL)::BIGINT AS overlap_count,
      round(count_if(k <> '' AND na IS NOT NULL AND nb IS NOT NULL) / greatest(count_if(k <> '' AND na IS NOT NULL), 1)::DOUBLE, 4) AS ratio_vs_baseline, round(count_if(k <> '' AND na IS NOT NULL AND nb IS NOT NULL) / greatest(count_if(k <> '' AND nb IS NOT NULL), 1)::DOUBLE, 4) AS ratio_vs_candidate,
      coalesce(array_to_string((list(va ORDER BY k) FILTER (k <> '' AND nb IS NULL)), '|'), '') AS baseline_only, coalesce(array_to_string((list(vb ORDER BY k) FILTER (k <> '' AND na IS NULL)), '|'), '') AS candidate_only FROM {name}j GROUP BY task_id)"""


@query("list_overlap", f"WITH {AB}, {overlap_sql('ca', 'cb', 'title', 'ov')} SELECT * FROM ov")
def _(spark, sf):
    r = runs(spark, sf)
    return N.list_overlap(r[0], r[1], "title")


SUM = "rep AS (SELECT task_id, CASE WHEN doc_id % 4 = 0 THEN '服务合同类' ELSE '通用合同类' END AS category, 'tpl_' || doc_id AS template_id FROM docs), isx AS (SELECT task_id, CASE WHEN sort_order % 2 = 0 THEN 'must_modify' ELSE 'suggest_modify' END AS severity, label AS problem, '第 ' || page || ' 页' AS clause_location FROM clauses), isy AS (SELECT task_id, CASE WHEN sort_order % 3 = 0 THEN 'must_modify' ELSE 'suggest_modify' END AS severity, CASE WHEN sort_order % 5 = 0 THEN label || '新' ELSE label END AS problem, '第 ' || (page + sort_order % 2) || ' 页' AS clause_location FROM clauses WHERE doc_id % 9 <> 0)"


def issue_runs(spark, sf):
    c = B.clauses(spark, sf)
    n = F.col("sort_order")
    sev = lambda m: F.when(n % m == 0, "must_modify").otherwise("suggest_modify").alias("severity")
    at = lambda p: F.concat(F.lit("第 "), p, F.lit(" 页")).alias("clause_location")
    a = c.select("task_id", sev(2), F.col("label").alias("problem"), at(F.col("page")))
    b = c.where(F.col("doc_id") % 9 != 0).select("task_id", sev(3), F.when(n % 5 == 0, F.concat("label", F.lit("新"))).otherwise(F.col("label")).alias("problem"), at(F.col("page") + n % 2))
    return a, b


def summaries(spark, sf):
    ca, cb, fa, fb, _, _ = runs(spark, sf)
    ia, ib = issue_runs(spark, sf)
    d = B.documents(spark, sf)
    rep = d.select("task_id", F.when(F.col("doc_id") % 4 == 0, "服务合同类").otherwise("通用合同类").alias("category"), F.concat(F.lit("tpl_"), "doc_id").alias("template_id"))
    repb = rep.withColumn("category", F.lit("服务合同类"))
    ta = d.select("task_id", (F.col("doc_id") + 100).alias("elapsed_ms"), F.lit(False).alias("failed"))
    tb = d.select("task_id", ((F.col("doc_id") + 100) * (F.col("doc_id") % 3)).alias("elapsed_ms"), (F.col("doc_id") % 11 == 0).alias("failed"))
    return N.run_summary(ta, {"clauses": ca, "facts": fa}, rep, ia), N.run_summary(tb, {"clauses": cb, "facts": fb}, repb, ib)


@query("run_summary", f"WITH {AB}, {SUM} SELECT d.task_id, doc_id + 100 AS elapsed_ms, FALSE AS failed, (SELECT count(*) FROM ca WHERE ca.task_id = d.task_id)::BIGINT AS n_clauses, (SELECT count(*) FROM fa WHERE fa.task_id = d.task_id)::BIGINT AS n_facts, category, template_id, (SELECT count(*) FROM isx WHERE isx.task_id = d.task_id)::BIGINT AS issue_count, (SELECT count_if(severity = 'must_modify') FROM isx WHERE isx.task_id = d.task_id)::BIGINT AS n_must_modify, (SELECT count_if(severity = 'suggest_modify') FROM isx WHERE isx.task_id = d.task_id)::BIGINT AS n_suggest_modify FROM docs d JOIN rep USING (task_id)")
def _(spark, sf):
    return summaries(spark, sf)[0]


@query("fact_agreement")
def _(spark, sf):
    r = runs(spark, sf)
    return N.fact_agreement(r[2], r[3])


@query("severity_counts", f"WITH {SUM}, x AS (SELECT task_id, severity, count(*) AS n FROM isx GROUP BY ALL), y AS (SELECT task_id, severity, count(*) AS n FROM isy GROUP BY ALL) SELECT task_id, severity, coalesce(x.n, 0)::BIGINT AS baseline, coalesce(y.n, 0)::BIGINT AS candidate FROM x FULL JOIN y USING (task_id, severity)")
def _(spark, sf):
    return N.severity_counts(*issue_runs(spark, sf))


@query("issue_agreement", f"WITH {SUM}, {overlap_sql('isx', 'isy', 'problem', 'op')}, {overlap_sql('isx', 'isy', 'clause_location', 'oc')} SELECT task_id, op.ratio_vs_baseline AS problem_ratio, op.overlap_count AS problem_overlap, oc.ratio_vs_baseline AS location_ratio, oc.overlap_count AS location_overlap FROM op FULL JOIN oc USING (task_id)")
def _(spark, sf):
    return N.issue_agreement(*issue_runs(spark, sf))


def delta(spark, sf):
    a, b = summaries(spark, sf)
    r = runs(spark, sf)
    return N.run_delta(a, b, {"clause": N.list_overlap(r[0], r[1], "title")}, ["n_clauses", "n_facts"])


DELTA = f"""{AB}, {SUM}, {overlap_sql('ca', 'cb', 'title', 'ov')}, dl AS (SELECT d.task_id, doc_id, doc_id % 11 = 0 AS bad, CASE WHEN doc_id % 9 = 0 THEN (SELECT count(*) FROM ca WHERE ca.task_id = d.task_id) ELSE 0 END AS lost, CASE WHEN doc_id % 9 = 0 THEN (SELECT count(*) FROM fa WHERE fa.task_id = d.task_id) ELSE 0 END AS lostf, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE (doc_id % 3)::DOUBLE END AS ratio, ov.ratio_vs_baseline AS ovl FROM docs d LEFT JOIN ov USING (task_id))"""


@query("run_delta", f"WITH {DELTA} SELECT task_id, CASE WHEN bad THEN 'failed' ELSE 'ok' END AS execution_status, CASE WHEN NOT bad THEN -lost END::BIGINT AS n_clauses_delta, CASE WHEN NOT bad THEN -lostf END::BIGINT AS n_facts_delta, CASE WHEN NOT bad THEN (doc_id + 100) * (doc_id % 3 - 1) END AS elapsed_ms_delta, CASE WHEN NOT bad THEN -lost END::BIGINT AS issue_count_delta, NOT bad AND doc_id % 4 = 0 AS category_same, NOT bad AS template_same, CASE WHEN NOT bad THEN ratio END AS elapsed_ratio, ovl AS clause_overlap FROM dl")
def _(spark, sf):
    return delta(spark, sf)


@query("run_assessment", f"""WITH {DELTA} SELECT task_id, CASE WHEN bad THEN 'run_failed' ELSE coalesce(nullif(concat_ws('|', CASE WHEN doc_id % 4 <> 0 THEN 'category_drift' END, CASE WHEN ovl < 0.8 THEN 'low_clause_overlap' END, CASE WHEN doc_id % 2 = 0 THEN 'low_fact_similarity' END, CASE WHEN doc_id % 5 = 0 THEN 'low_issue_overlap' END,
    CASE WHEN lost >= 5 THEN 'fewer_issues' END, CASE WHEN ratio > 1.3 THEN 'slower' END, CASE WHEN ratio < 0.75 THEN 'faster' END), ''), 'no_structural_regression') END AS notes FROM dl""")
def _(spark, sf):
    i = F.substring("task_id", 6, 20).cast("long")
    d = delta(spark, sf).withColumn("value_similarity_avg", F.when(i % 2 == 0, 0.5).otherwise(0.9)).withColumn("problem_ratio", F.when(i % 5 == 0, 0.1).otherwise(0.9))
    return N.run_assessment(d)


@query("page_agreement")
def _(spark, sf):
    b = B.blocks(spark, sf)
    return N.page_agreement(b, b.where(F.col("doc_id") % 9 != 0).withColumn("text", F.concat("text", F.when(F.col("block_no") % 6 == 0, "附").otherwise(""))))


@query("section_agreement", f"""WITH {AB}, m AS (SELECT 'a' AS r, task_id, title, section_code || ' ' || title AS t, section_code LIKE '第%' AS mj, sort_order FROM sa UNION ALL SELECT 'b', task_id, title, section_code || ' ' || title, section_code LIKE '第%', sort_order FROM sb),
    o AS (SELECT r, task_id, t, sort_order, row_number() OVER (PARTITION BY r, task_id ORDER BY sort_order) AS k FROM m WHERE mj AND NOT EXISTS (SELECT 1 FROM m x WHERE x.r <> m.r AND x.task_id = m.task_id AND x.mj AND x.t = m.t))
    SELECT task_id, count_if(r = 'a' AND mj)::BIGINT AS baseline_major, count_if(r = 'a' AND NOT mj)::BIGINT AS baseline_child, count_if(r = 'b' AND mj)::BIGINT AS candidate_major, count_if(r = 'b' AND NOT mj)::BIGINT AS candidate_child,
    coalesce((SELECT string_agg(t, '|' ORDER BY k) FROM o WHERE r = 'a' AND o.task_id = m.task_id), '') AS missing_in_candidate, coalesce((SELECT string_agg(t, '|' ORDER BY k) FROM o WHERE r = 'b' AND o.task_id = m.task_id), '') AS extra_in_candidate FROM m GROUP BY task_id""")
def _(spark, sf):
    r = runs(spark, sf)
    return N.section_agreement(r[4], r[5])


@query("label_count_delta", f"WITH {AB}, x AS (SELECT task_id, core_label AS label, count(*) AS n FROM ca GROUP BY ALL), y AS (SELECT task_id, core_label AS label, count(*) AS n FROM cb GROUP BY ALL) SELECT task_id, label, coalesce(x.n, 0)::BIGINT AS baseline, coalesce(y.n, 0)::BIGINT AS candidate, (coalesce(y.n, 0) - coalesce(x.n, 0))::BIGINT AS delta FROM x FULL JOIN y USING (task_id, label)")
def _(spark, sf):
    r = runs(spark, sf)
    return N.label_count_delta(r[0], r[1])


@query("fact_side_by_side", f"WITH {AB}, x AS (SELECT task_id, label, (list(value ORDER BY ord))[1:3] AS v FROM fa GROUP BY ALL), y AS (SELECT task_id, label, (list(value ORDER BY ord))[1:3] AS v FROM fb GROUP BY ALL) SELECT task_id, label, coalesce(nullif(array_to_string(x.v, '；'), ''), '未提取') AS baseline_value, coalesce(nullif(array_to_string(y.v, '；'), ''), '未提取') AS candidate_value, x.v[1] IS NOT DISTINCT FROM y.v[1] AS same FROM x FULL JOIN y USING (task_id, label)")
def _(spark, sf):
    r = runs(spark, sf)
    return N.fact_side_by_side(r[2], r[3])


@query("status_counts", "SELECT task_id, CASE WHEN sort_order % 3 = 0 THEN 'unknown' ELSE label END AS status, count(*)::BIGINT AS n FROM clauses GROUP BY ALL")
def _(spark, sf):
    c = B.clauses(spark, sf).withColumn("status", F.when(F.col("sort_order") % 3 == 0, "").otherwise(F.col("label")))
    return N.status_counts(c, "status")


@query("step_side_by_side", """WITH a AS (SELECT task_id, core_label AS name, min(block_no) AS at, count(*) AS n FROM blocks GROUP BY ALL), b AS (SELECT task_id, core_label AS name, min(block_no) AS at, count(*) AS n FROM blocks WHERE block_no % 2 = 0 GROUP BY ALL)
    SELECT task_id, row_number() OVER (PARTITION BY task_id ORDER BY a.at) AS position, name, 'ok' AS baseline_status, CASE WHEN b.n IS NULL THEN '-' ELSE 'late' END AS candidate_status, a.n::BIGINT AS baseline_rows, coalesce(b.n, 0)::BIGINT AS candidate_rows FROM a LEFT JOIN b USING (task_id, name)""")
def _(spark, sf):
    b = B.blocks(spark, sf)
    side = lambda d, s: d.groupBy("task_id", F.col("core_label").alias("name")).agg(F.min("block_no").alias("step_id"), F.count(F.lit(1)).alias("n_rows")).withColumn("status", F.lit(s))
    return N.step_side_by_side(side(b, "ok"), side(b.where(F.col("block_no") % 2 == 0), "late"))
