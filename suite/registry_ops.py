"""Knowledge-base metadata and versions (survey section 2.9)."""

from pyspark.sql import functions as F

from auditframe.operators import registry as G
from auditframe.plans import bridge as B

from . import sqlkit as S
from .registry import query
from .sources import rule_rows
from .structure import HC, SPLIT_POLICY, SPLIT_TEMPLATE, ranges
from .retrieval import usage_sql

TODAY = 20240701
RULES = "ru AS (SELECT 'RULE_' || (doc_id % 7) AS rule_id, 'doc_' || (doc_id % 50) AS source_document_id, doc_id AS written, doc_id % 2 = 0 AS enabled, ['kc_' || doc_id || '_2', 'kc_' || doc_id || '_1', 'kc_none'] AS basis FROM documents)"


@B.memo
def rules(spark, sf):
    i = F.col("doc_id")
    return B.load(spark, sf, "documents").select(F.concat(F.lit("RULE_"), i % 7).alias("rule_id"), F.concat(F.lit("doc_"), i % 50).alias("source_document_id"), i.alias("written"), (i % 2 == 0).alias("enabled"),
        F.array(F.concat(F.lit("kc_"), i, F.lit("_2")), F.concat(F.lit("kc_"), i, F.lit("_1")), F.lit("kc_none")).alias("basis_policy"))


DEDUP = "kd AS (SELECT * FROM kb QUALIFY row_number() OVER (PARTITION BY document_id, coalesce(template_id, ''), title, page_start, page_end ORDER BY clause_no, clause_id) = 1), rd AS (SELECT * FROM ru QUALIFY row_number() OVER (PARTITION BY rule_id, source_document_id ORDER BY written) = 1)"


@query("kb_clause_dedupe", f"WITH {RULES}, {DEDUP} SELECT clause_id, title FROM kd")
def _(spark, sf):
    return G.kb_clause_dedupe(B.kb_clauses(spark, sf)).select("clause_id", "title")


@query("document_clauses", f"WITH {RULES}, {DEDUP} SELECT document_id, clause_id, content FROM kd")
def _(spark, sf):
    return G.document_clauses(B.kb_clauses(spark, sf)).select("document_id", "clause_id", "content")


@query("rule_dedupe", f"WITH {RULES}, {DEDUP} SELECT rule_id, source_document_id, written FROM rd")
def _(spark, sf):
    return G.rule_dedupe(rules(spark, sf)).select("rule_id", "source_document_id", "written")


@query("rule_dedupe_last", f"WITH {RULES} SELECT rule_id, source_document_id, max(written) AS written FROM ru GROUP BY ALL")
def _(spark, sf):
    return G.rule_dedupe(rules(spark, sf), "last").select("rule_id", "source_document_id", "written")


@query("document_metadata", f"WITH {RULES}, {DEDUP} SELECT k.document_id, (SELECT count(*) FROM kd WHERE kd.document_id = k.document_id)::BIGINT AS clause_count, (SELECT count(*) FROM kd WHERE kd.document_id = k.document_id AND {S.LIVE})::BIGINT AS effective_clause_count, (SELECT count(*) FROM rd WHERE source_document_id = k.document_id)::BIGINT AS rule_count, (SELECT count(*) FROM rd WHERE source_document_id = k.document_id AND enabled)::BIGINT AS enabled_rule_count FROM kb_docs k")
def _(spark, sf):
    return G.document_metadata(B.kb_documents(spark, sf), B.kb_clauses(spark, sf), rules(spark, sf)).select("document_id", "clause_count", "effective_clause_count", "rule_count", "enabled_rule_count")


@query("clause_metadata", f"WITH {RULES}, {DEDUP}, ln AS (SELECT c AS clause_id, count(*) AS n, string_agg(DISTINCT rule_id, '|' ORDER BY rule_id) AS rs FROM (SELECT rule_id, unnest(basis) AS c FROM rd) GROUP BY c) SELECT clause_id, k.name AS document_name, concat_ws(' / ', category_lv1, category_lv2) AS category_path, coalesce(n, 0)::BIGINT AS linked_rule_count, rs AS linked_rules FROM kb JOIN kb_docs k USING (document_id) LEFT JOIN ln USING (clause_id)")
def _(spark, sf):
    return G.clause_metadata(B.kb_clauses(spark, sf), B.kb_documents(spark, sf), rules(spark, sf)).select("clause_id", "document_name", "category_path", "linked_rule_count", "linked_rules")


@query("rule_metadata", f"WITH {RULES}, e AS (SELECT rule_id, source_document_id, written, c, p FROM (SELECT *, unnest(basis) AS c, unnest([1, 2, 3]) AS p FROM (SELECT * FROM ru QUALIFY row_number() OVER (PARTITION BY rule_id, source_document_id ORDER BY written) = 1)) WHERE c IN (SELECT clause_id FROM kb)) SELECT r.rule_id, r.source_document_id, k.name AS source_document_name, count(c)::BIGINT AS source_clause_count, string_agg(c, '|' ORDER BY p) AS source_clause_ids FROM (SELECT * FROM ru QUALIFY row_number() OVER (PARTITION BY rule_id, source_document_id ORDER BY written) = 1) r LEFT JOIN e USING (rule_id, source_document_id) LEFT JOIN kb_docs k ON k.document_id = r.source_document_id GROUP BY ALL")
def _(spark, sf):
    return G.rule_metadata(G.rule_dedupe(rules(spark, sf)), B.kb_documents(spark, sf), B.kb_clauses(spark, sf)).select("rule_id", "source_document_id", "source_document_name", "source_clause_count", "source_clause_ids")


@query("version_context", """SELECT d.document_id, row_number() OVER (PARTITION BY d.name, d.doc_type ORDER BY d.effective_ts DESC, d.created_at DESC, d.document_id) AS series_pos, count(*) OVER (PARTITION BY d.name, d.doc_type) AS series_size,
    (SELECT string_agg(p.document_id, '|' ORDER BY p.effective_ts DESC, p.created_at DESC) FROM kb_docs p WHERE p.replaced_by = d.document_id AND p.name = d.name AND p.doc_type = d.doc_type) AS previous_versions, n.document_id AS next_version FROM kb_docs d LEFT JOIN kb_docs n ON n.document_id = d.replaced_by""")
def _(spark, sf):
    return G.version_context(B.kb_documents(spark, sf)).select("document_id", "series_pos", "series_size", "previous_versions", "next_version")


@query("enrich_catalog", f"""WITH us AS ({usage_sql('registry')}), t AS (SELECT * FROM kb WHERE template_id IS NOT NULL), n AS (SELECT template_id, count(*) AS n, min(page_start) AS a, max(page_end) AS b FROM t GROUP BY template_id),
    f AS (SELECT template_id, title, row_number() OVER (PARTITION BY template_id ORDER BY min(page_start * 1000000 + rn)) AS r FROM (SELECT *, row_number() OVER (PARTITION BY template_id ORDER BY page_start, clause_no, title) AS rn FROM t) GROUP BY template_id, title),
    k AS (SELECT template_id, string_agg(title, '|' ORDER BY r) AS key_titles, string_agg(title, ' / ' ORDER BY r) FILTER (r <= 3) AS signature FROM f WHERE r <= 4 GROUP BY template_id)
    SELECT template_id, n::BIGINT AS clause_count, key_titles, signature, CASE WHEN usage_profile IS NOT NULL AND usage_basis <> '' THEN usage_profile || '（依据：' || array_to_string(string_split(usage_basis, '|')[1:3], ' / ') || '）' ELSE usage_profile END AS usage_summary FROM n JOIN k USING (template_id) JOIN us USING (template_id)""")
def _(spark, sf):
    k = B.kb_clauses(spark, sf)
    cat = k.where(F.col("template_id").isNotNull()).groupBy("template_id").agg(F.min("page_start").alias("start_page"), F.max("page_end").alias("end_page"))
    return G.enrich_catalog(cat, k).select("template_id", "clause_count", "key_titles", "signature", "usage_summary")


VAR = f"""{HC}, ca AS (SELECT document_id, left(template_name, 1) AS template_name, 'tpl_' || idx AS template_id, start_page, end_page, [template_name, '共同'] AS kt FROM rg),
    si AS (SELECT *, row_number() OVER (PARTITION BY document_id, template_name ORDER BY start_page, end_page, template_id) AS i, count(*) OVER (PARTITION BY document_id, template_name) AS n FROM ca),
    on1 AS (SELECT document_id, template_name, t FROM (SELECT document_id, template_name, unnest(list_distinct(kt)) AS t FROM ca) GROUP BY ALL HAVING count(*) = 1)"""


@query("same_name_variants", f"WITH {VAR} SELECT document_id, template_name, template_id, i AS same_name_index, n AS same_name_total, '同名模板 ' || i || '/' || n || ' · 第 ' || start_page || '-' || end_page || ' 页' AS label, CASE WHEN EXISTS (SELECT 1 FROM on1 WHERE on1.document_id = si.document_id AND on1.template_name = si.template_name AND on1.t = kt[1]) THEN kt[1] ELSE array_to_string({S.distinct_list('kt')}, '|') END AS variant_cues FROM si WHERE n > 1")
def _(spark, sf):
    r = ranges(spark, sf)
    c = r.select("document_id", F.substring("template_name", 1, 1).alias("template_name"), F.concat(F.lit("tpl_"), "idx").alias("template_id"), "start_page", "end_page", F.array("template_name", F.lit("共同")).alias("key_titles"))
    return G.same_name_variants(c)


def requests(spark, sf):
    """Documents with labels are the ones asked about."""
    return B.load(spark, sf, "labels").select("doc_id", F.concat(F.lit("doc_"), "doc_id").alias("document_id"), "quality", "toxic")


@query("abolish_documents", f"SELECT k.document_id, CASE WHEN l.doc_id IS NOT NULL THEN 'abolished' ELSE status END AS status, CASE WHEN l.doc_id IS NULL THEN abolish_ts WHEN quality = 1 THEN 20240101 ELSE {TODAY} END::BIGINT AS abolish_ts, (current_version AND l.doc_id IS NULL) AS current_version FROM kb_docs k LEFT JOIN labels l USING (doc_id)")
def _(spark, sf):
    r = requests(spark, sf).select("document_id", F.when(F.col("quality") == 1, 20240101).alias("abolish_ts"))
    return G.abolish_documents(B.kb_documents(spark, sf), B.kb_clauses(spark, sf), r, TODAY)[0].select("document_id", "status", "abolish_ts", "current_version")


@query("abolish_cascade", f"SELECT clause_id, CASE WHEN l.doc_id IS NOT NULL THEN 'abolished' ELSE status END AS status, CASE WHEN l.doc_id IS NULL THEN abolish_ts WHEN quality = 1 THEN 20240101 ELSE {TODAY} END::BIGINT AS abolish_ts FROM kb k LEFT JOIN labels l ON k.doc_id = l.doc_id")
def _(spark, sf):
    r = requests(spark, sf).select("document_id", F.when(F.col("quality") == 1, 20240101).alias("abolish_ts"))
    return G.abolish_documents(B.kb_documents(spark, sf), B.kb_clauses(spark, sf), r, TODAY)[1].select("clause_id", "status", "abolish_ts")


@query("replace_documents", "SELECT k.document_id, CASE WHEN l.doc_id IS NOT NULL THEN 'superseded' ELSE status END AS status, CASE WHEN l.doc_id IS NOT NULL THEN 'doc_' || (l.doc_id + 1) ELSE replaced_by END AS replaced_by, CASE WHEN m.doc_id IS NOT NULL THEN TRUE WHEN l.doc_id IS NOT NULL THEN FALSE ELSE current_version END AS current_version FROM kb_docs k LEFT JOIN labels l ON k.doc_id = l.doc_id LEFT JOIN labels m ON k.doc_id = m.doc_id + 1")
def _(spark, sf):
    r = requests(spark, sf).select(F.col("document_id").alias("old_id"), F.concat(F.lit("doc_"), F.col("doc_id") + 1).alias("new_id"))
    return G.replace_documents(B.kb_documents(spark, sf), B.kb_clauses(spark, sf), r, TODAY)[0].select("document_id", "status", "replaced_by", "current_version")


@query("patch_status", f"SELECT clause_id, CASE WHEN quality = 1 THEN 'expired' ELSE status END AS status, CASE WHEN quality = 1 THEN {TODAY} ELSE abolish_ts END::BIGINT AS abolish_ts FROM kb k LEFT JOIN labels l ON k.doc_id = l.doc_id")
def _(spark, sf):
    r = requests(spark, sf).select("document_id", F.when(F.col("quality") == 1, "expired").otherwise("draft").alias("status"))
    return G.patch_status(B.kb_documents(spark, sf), B.kb_clauses(spark, sf), r, TODAY)[1].select("clause_id", "status", "abolish_ts")


@query("ingest_policies", f"SELECT document_id, 'clause_' || left(sha256(document_id || '|' || part_no || '|' || article_no), 16) AS clause_id, title, clause_no, 1536::BIGINT AS dims FROM ({SPLIT_POLICY})")
def _(spark, sf):
    c, _ = G.ingest_policies(B.texts(spark, sf).withColumn("effective_ts", F.lit(20240101)))
    return c.select("document_id", "clause_id", "title", "clause_no", F.size("vector").alias("dims"))


_TPL = SPLIT_TEMPLATE.replace("'name_' || doc_id", "(SELECT x.file_name FROM docs x WHERE x.doc_id = f.doc_id)")


@query("ingest_templates", f"SELECT document_id, 'clause_' || left(sha256(document_id || '|' || template_id || '|' || clause_no), 16) AS clause_id, title, clause_type, 1536::BIGINT AS dims FROM ({_TPL})")
def _(spark, sf):
    t = B.texts(spark, sf).select("document_id", F.concat(F.lit("tpl_"), "doc_id").alias("template_id"), F.col("file_name").alias("template_name"), "text", F.lit("服务合同类").alias("category_lv1"), F.lit(None).cast("string").alias("category_lv2"),
                                  F.lit(1).alias("page_start"), F.lit(9).alias("page_end"), F.lit(20240101).alias("effective_ts"))
    return G.ingest_templates(t).select("document_id", "clause_id", "title", "clause_type", F.size("vector").alias("dims"))
