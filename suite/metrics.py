"""Reporting aggregates (survey section 2.11)."""

from pyspark.sql import functions as F

from auditframe import params as P
from auditframe.functions import text as X
from auditframe.operators import issues as I
from auditframe.operators import metrics as M
from auditframe.plans import bridge as B

from . import sqlkit as S
from .clauses import ordered_facts
from .issues import FCAND, VCON, VKEY, VREQ, candidate_rows
from .registry import query
from .registry_ops import RULES, rules
from .structure import HC, ranges
from auditframe.sources import configs as G


@query("registry_metrics", f"WITH {RULES} SELECT count(*)::BIGINT AS documents, count_if(status = 'effective')::BIGINT AS active_documents, count_if(current_version)::BIGINT AS current_versions, count_if(doc_type = 'policy')::BIGINT AS policies, count_if(doc_type = 'template')::BIGINT AS templates, (SELECT count(*) FROM ru)::BIGINT AS rules, (SELECT count_if(enabled) FROM ru)::BIGINT AS enabled_rules, (SELECT count_if(NOT enabled) FROM ru)::BIGINT AS disabled_rules, (SELECT count(DISTINCT source_document_id) FROM ru)::BIGINT AS source_documents FROM kb_docs")
def _(spark, sf):
    return M.registry_metrics(B.kb_documents(spark, sf), rules(spark, sf))


@query("documents_in_order", "SELECT document_id, name, current_version, effective_ts FROM kb_docs ORDER BY current_version DESC, name, effective_ts DESC, document_id")
def _(spark, sf):
    return M.documents_in_order(B.kb_documents(spark, sf)).select("document_id", "name", "current_version", "effective_ts")


@query("rules_in_order", f"WITH {RULES} SELECT rule_id, source_document_id, enabled FROM ru QUALIFY row_number() OVER (PARTITION BY rule_id, source_document_id ORDER BY written DESC) = 1 ORDER BY enabled DESC, rule_id")
def _(spark, sf):
    return M.rules_in_order(rules(spark, sf)).select("rule_id", "source_document_id", "enabled")


@query("focus_buckets", f"WITH {FCAND} SELECT task_id, focus_source, count(*)::BIGINT AS n, list_position({S.lst(P.FOCUS_BUCKETS)}, focus_source)::BIGINT AS position FROM fcd GROUP BY ALL")
def _(spark, sf):
    return M.focus_buckets(I.focuses_from_candidates(candidate_rows(spark, sf), B.clauses(spark, sf), G.default_configs(spark)))


@query("clause_buckets", f"SELECT task_id, label_source, count(*)::BIGINT AS n, list_position({S.lst(P.CLAUSE_BUCKETS)}, label_source)::BIGINT AS position FROM clauses GROUP BY ALL")
def _(spark, sf):
    return M.clause_buckets(B.clauses(spark, sf))


def items(spark, sf):
    c = B.clauses(spark, sf)
    return I.verification([I.verify_required(B.documents(spark, sf), c), I.verify_keywords(c), I.verify_confidence(c)])


VALL = f"{VREQ}, {VKEY}, {VCON}, va AS (SELECT * FROM vrq UNION ALL SELECT * FROM vky UNION ALL SELECT * FROM vcf)"


@query("verification_buckets", f"WITH {VALL} SELECT task_id, count_if(status = 'pass')::BIGINT AS passed, count_if(status = 'warning')::BIGINT AS warnings, 0::BIGINT AS pending, 0::BIGINT AS need_tool FROM va GROUP BY task_id")
def _(spark, sf):
    return M.verification_buckets(items(spark, sf))


@query("related_clause_labels", f"WITH {VALL}, e AS (SELECT task_id, item_id, unnest(string_split(clause_ids, '|')) AS cid, unnest(range(len(string_split(clause_ids, '|')))) AS p FROM va WHERE clause_ids <> '') SELECT e.task_id, item_id, string_agg(label || ' / ' || title, '；' ORDER BY p) AS labels FROM e JOIN clauses c ON c.task_id = e.task_id AND c.clause_id = cid GROUP BY ALL")
def _(spark, sf):
    return M.related_clause_labels(items(spark, sf), B.clauses(spark, sf))


@query("kb_result_filter", "SELECT task_id, clause_id AS focus_id FROM clauses WHERE sort_order % 2 = 0")
def _(spark, sf):
    f = B.clauses(spark, sf).select("task_id", F.col("clause_id").alias("focus_id"), F.when(F.col("sort_order") % 2 == 0, "knowledge_base_rule_check").otherwise("agent_discovered").alias("focus_source"), F.lit("model").alias("source"))
    return M.kb_result_filter(f, f)[0].select("task_id", "focus_id")


_LAB = "CASE label WHEN '账户信息' THEN '协议编号' WHEN '违约责任' THEN '甲方' WHEN '争议解决' THEN '乙方' WHEN '付款条件' THEN '服务内容' ELSE label END"


def card_facts(spark, sf):
    l = F.col("label")
    lab = F.when(l == "账户信息", "协议编号").when(l == "违约责任", "甲方").when(l == "争议解决", "乙方").when(l == "付款条件", "服务内容").otherwise(l)
    return ordered_facts(spark, sf).withColumn("label", lab)


@query("overview_cards", f"""WITH f AS (SELECT task_id, {_LAB} AS label, value, confidence, sort_order FROM key_facts), s AS (SELECT * FROM (VALUES (1, '合同编号', ['合同编号', '协议编号']), (2, '主体摘要', ['主体摘要', '合同基本信息']), (3, '甲乙方信息', ['甲乙方信息']), (4, '服务内容', ['服务内容'])) t(position, title, labels)),
    c AS (SELECT d.task_id, position, title, (SELECT arg_min(struct_pack(v := value, c := confidence), sort_order) FROM f WHERE f.task_id = d.task_id AND list_contains(labels, label)) AS x, (SELECT arg_min(struct_pack(v := value, c := confidence), sort_order) FROM f WHERE f.task_id = d.task_id AND label = '甲方') AS a, (SELECT arg_min(struct_pack(v := value, c := confidence), sort_order) FROM f WHERE f.task_id = d.task_id AND label = '乙方') AS b FROM docs d, s),
    y AS (SELECT task_id, position, title, CASE WHEN x IS NOT NULL THEN x WHEN title = '甲乙方信息' AND (a IS NOT NULL OR b IS NOT NULL) THEN struct_pack(v := concat_ws('；', '甲方：' || a.v, '乙方：' || b.v), c := greatest(coalesce(a.c, 0), coalesce(b.c, 0))) END AS z FROM c)
    SELECT task_id, position::BIGINT AS position, title, coalesce(nullif(trim(z.v), ''), '未提取') AS value, coalesce(z.c, 0)::DOUBLE AS confidence, z IS NULL OR trim(z.v) = '未提取' AS muted FROM y""")
def _(spark, sf):
    return M.overview_cards(card_facts(spark, sf), B.documents(spark, sf))


@query("contract_number_of", f"WITH f AS (SELECT task_id, {_LAB} AS label, value, sort_order FROM key_facts) SELECT task_id, nullif(arg_min(value, sort_order), '') AS contract_number FROM f WHERE label = '协议编号' GROUP BY task_id")
def _(spark, sf):
    return M.contract_number_of(card_facts(spark, sf))


@query("template_pages", f"WITH {HC} SELECT document_id, idx, page FROM (SELECT document_id, idx, unnest(range(start_page, end_page + 1)) AS page FROM rg)")
def _(spark, sf):
    return M.template_pages(ranges(spark, sf)).select("document_id", "idx", "page")
