"""Clauses, facts, classification, schema (survey section 2.4)."""

from pyspark.sql import functions as F

from auditframe import params as P
from auditframe.functions import text as X
from auditframe.operators import clauses as C
from auditframe.operators import structure as D
from auditframe.plans import bridge as B
from auditframe.sources import configs as G

from . import sqlkit as S
from .registry import query
from .structure import HEAD, HEADS, PTEXT, SECT, blocks, sections


@B.memo
def ordered_facts(spark, sf):
    return B.key_facts(spark, sf).withColumn("ord", F.col("sort_order"))


ITEMS = """it AS (SELECT task_id, sort_order AS ord, CASE WHEN sort_order % 9 = 0 THEN '' WHEN core_label = '合同金额' THEN '合同价款' ELSE label END AS label, CASE WHEN sort_order % 2 = 0 THEN title END AS title, raw_text,
    CASE WHEN sort_order % 3 = 0 THEN page ELSE page + 1000 END AS given, confidence, need_review FROM clauses)"""


@B.memo
def items(spark, sf):
    c = B.clauses(spark, sf)
    n = F.col("sort_order")
    return c.select("task_id", n.alias("ord"), F.when(n % 9 == 0, " ").when(F.col("core_label") == "合同金额", "合同价款").otherwise(F.col("label")).alias("label"),
                    F.when(n % 2 == 0, F.col("title")).alias("title"), F.lit(None).cast("string").alias("core_label"), F.lit("").alias("label_source"), "raw_text",
                    F.lit(None).cast("string").alias("summary"), F.when(n % 3 == 0, F.col("page")).otherwise(F.col("page") + 1000).cast("string").alias("page"),
                    F.col("confidence").cast("string").alias("confidence"), F.lit(None).cast("array<string>").alias("references"),
                    F.when(F.col("need_review"), "yes").otherwise("no").alias("need_review"))


@query("build_clauses", f"""WITH {PTEXT}, {SECT}, {ITEMS}, b1 AS (SELECT * REPLACE (CASE WHEN label <> '' THEN label ELSE title END AS label), {S.compact_summary('raw_text', None)} AS rt FROM it WHERE label <> '' OR title IS NOT NULL),
    b2 AS (SELECT *, {S.mapped('label', P.CORE_LABEL_ALIASES)} AS core FROM b1), pg AS (SELECT b2.task_id, ord, min(page) AS fp FROM b2 JOIN pt USING (task_id) WHERE contains(ptext, rt) OR contains(replace(ptext, ' ', ''), replace(rt, ' ', '')) GROUP BY ALL),
    fst AS (SELECT task_id, min(page) AS p1 FROM blocks GROUP BY task_id),
    b3 AS (SELECT b2.*, coalesce(CASE WHEN given < 1000 THEN given END, fp, p1)::BIGINT AS page FROM b2 LEFT JOIN pg USING (task_id, ord) JOIN fst USING (task_id)),
    b4 AS (SELECT b3.task_id, ord, arg_max(s.title, s.page * 100000 + s.sort_order) AS section_title FROM b3 JOIN sect s ON s.task_id = b3.task_id AND s.page <= b3.page GROUP BY ALL)
    SELECT b3.task_id, 'clause_' || printf('%03d', ord) AS clause_id, left(label, 80) AS label, core AS core_label, CASE WHEN label = core THEN 'core' ELSE 'user_configured' END AS label_source, coalesce(title, left(label, 80)) AS title,
      {S.compact_summary('rt', 80)} AS summary, rt AS raw_text, page, confidence, ord AS sort_order, section_title, array_to_string({S.cross_refs('rt')}, '|') AS "references", need_review FROM b3 LEFT JOIN b4 USING (task_id, ord)""")
def _(spark, sf):
    return C.build_clauses(items(spark, sf), B.blocks(spark, sf), sections(spark, sf))


ANCHOR = "WITH ac AS (" + " UNION ALL ".join(
    f"SELECT task_id, page, block_no, block_id, t, {i} AS label_no, {S.q(k)} AS label, {S.count_words('t', w)} AS hits FROM ab" for i, (k, w) in enumerate(P.ANCHOR_KEYWORDS.items())) + "),"
ANCHOR = ANCHOR.replace("WITH ac AS", f"ab AS (SELECT task_id, page, block_no, block_id, {S.clean_lines('text')} AS t FROM blocks), ac AS") + f"""
    ar AS (SELECT *, row_number() OVER (PARTITION BY task_id, label_no ORDER BY hits * 20 + least(length(t), 200) // 20 DESC, page, block_no) AS rk FROM ac WHERE hits > 0 AND t <> ''),
    anc AS (SELECT task_id, label, {S.compact_summary('t', 80)} AS summary, {S.compact_summary('t', None)} AS raw_text, page, row_number() OVER (PARTITION BY task_id ORDER BY label_no) AS sort_order, t, block_id FROM ar WHERE rk = 1)"""


@query("anchor_clauses", f"WITH {ANCHOR} SELECT task_id, 'clause_' || printf('%03d', sort_order) AS clause_id, label, summary, raw_text, page, sort_order, array_to_string({S.cross_refs('t')}, '|') AS \"references\", block_id FROM anc")
def _(spark, sf):
    return C.anchor_clauses(B.blocks(spark, sf)).select("task_id", "clause_id", "label", "summary", "raw_text", "page", "sort_order", "references", "block_id")


DEDUP = """dk AS (SELECT *, CASE WHEN label_source = 'agent_discovered' THEN label ELSE core_label END AS k FROM (SELECT * REPLACE (page // 3 AS page) FROM clauses)),
    dr AS (SELECT *, row_number() OVER (PARTITION BY task_id, k, page ORDER BY confidence DESC, length(raw_text) DESC, sort_order) AS rk FROM dk),
    dd AS (SELECT task_id, row_number() OVER (PARTITION BY task_id ORDER BY page, sort_order, label, k) AS no, label, page, raw_text, confidence FROM dr WHERE rk = 1)"""


@query("clause_dedupe", f"WITH {DEDUP} SELECT task_id, 'clause_' || printf('%03d', no) AS clause_id, label, page::BIGINT AS page, raw_text, confidence, no AS sort_order FROM dd")
def _(spark, sf):
    c = B.clauses(spark, sf).withColumn("page", F.floor(F.col("page") / 3))
    return C.clause_dedupe(c).select("task_id", "clause_id", "label", "page", "raw_text", "confidence", "sort_order")


FPAGES = f"""fp0 AS (SELECT *, dense_rank() OVER (PARTITION BY task_id ORDER BY page) AS pp, row_number() OVER (PARTITION BY task_id, page ORDER BY block_no) AS bp, {S.contract_number('text')} AS num FROM blocks),
    fpg AS (SELECT task_id, num AS value, arg_min(page, page * 1000000 + block_no) AS page, arg_min(block_id, page * 1000000 + block_no) AS block_id, min(page * 1000000 + block_no) AS ord FROM fp0 WHERE num IS NOT NULL GROUP BY task_id, num)"""


@query("facts_from_pages", f"WITH {FPAGES} SELECT task_id, '合同编号' AS label, value, page, 0.88::DOUBLE AS confidence, block_id AS evidence_id FROM fpg")
def _(spark, sf):
    return C.facts_from_pages(B.blocks(spark, sf)).select("task_id", "label", "value", "page", "confidence", "evidence_id")


@B.memo
def fact_clauses(spark, sf):
    """Bridge clauses with two labels renamed and structured fields, so that every branch is used."""
    k = F.col("core_label")
    core = F.when(k == "违约责任", "甲乙方信息").when(k == "账户信息", "合同基本信息").otherwise(k)
    m = (F.when(k == "合同金额", F.create_map(F.lit("totalAmount"), F.concat("page", F.lit("万元"))))
         .when(k == "付款条件", F.create_map(F.lit("paymentTrigger"), F.lit(" 验收后 "), F.lit("contractNumber"), F.concat(F.lit("N-"), "page")))
         .otherwise(F.create_map().cast("map<string,string>")))
    return B.clauses(spark, sf).withColumn("structured_fields", m).withColumn("core_label", core)


_STRUCT = "来自条款结构化字段。"
FCLAUSE = f"""fc0 AS (SELECT * REPLACE (CASE core_label WHEN '违约责任' THEN '甲乙方信息' WHEN '账户信息' THEN '合同基本信息' ELSE core_label END AS core_label), core_label AS old FROM clauses),
    fc1 AS (
      SELECT task_id, '合同编号' AS label, 'N-' || page AS value, page, confidence, clause_id, '{_STRUCT}' AS notes, sort_order, 0 AS seq FROM fc0 WHERE old = '付款条件'
      UNION ALL SELECT task_id, '合同金额', page || '万元', page, confidence, clause_id, '{_STRUCT}', sort_order, 2 FROM fc0 WHERE old = '合同金额'
      UNION ALL SELECT task_id, '付款条件', '验收后', page, confidence, clause_id, '{_STRUCT}', sort_order, 3 FROM fc0 WHERE old = '付款条件'
      UNION ALL SELECT task_id, unnest(regexp_extract_all(raw_text, {S.q(P.PARTY_PATTERN)}, 1)), unnest(list_transform(regexp_extract_all(raw_text, {S.q(P.PARTY_PATTERN)}, 2), lambda v: {S.clean_lines('v')})), page, confidence, clause_id, NULL, sort_order, 5 FROM fc0 WHERE core_label = '甲乙方信息'
      UNION ALL SELECT task_id, '合同编号', {S.contract_number('raw_text')}, page, confidence, clause_id, NULL, sort_order, 900 FROM fc0 WHERE core_label = '合同基本信息'
      UNION ALL SELECT task_id, '合同金额', coalesce(nullif(trim(regexp_extract(raw_text, {S.q(P.AMOUNT_PATTERN)}, 1)), ''), summary), page, confidence, clause_id, NULL, sort_order, 901 FROM fc0 WHERE core_label = '合同金额'
      UNION ALL SELECT task_id, {S.mapped('core_label', C.SUMMARY_FACTS)}, {S.clean_lines('summary')}, page, confidence, clause_id, NULL, sort_order, 902 FROM fc0 WHERE core_label IN ({', '.join(S.q(k) for k in C.SUMMARY_FACTS)})
      UNION ALL SELECT task_id, '主体摘要', {S.clean_lines('summary')}, page, confidence, clause_id, '主体名称建议人工复核。', sort_order, 903 FROM fc0 WHERE core_label = '甲乙方信息' AND len(regexp_extract_all(raw_text, {S.q(P.PARTY_PATTERN)}, 1)) = 0),
    fcl AS (SELECT *, row_number() OVER (PARTITION BY task_id, label, value, page ORDER BY sort_order, seq) AS rk FROM fc1 WHERE value <> '')"""


@query("facts_from_clauses", f"WITH {FCLAUSE} SELECT task_id, label, value, page, confidence, clause_id, notes FROM fcl WHERE rk = 1")
def _(spark, sf):
    return C.facts_from_clauses(fact_clauses(spark, sf)).drop("ord")


@query("build_facts", f"""WITH v AS (SELECT fact_id, task_id, label, value, page, confidence FROM key_facts),
    w AS (SELECT *, CASE WHEN label = '账户信息' THEN coalesce({S.contract_number(S.compact_summary('value', None))}, '未提取') WHEN label IN ('付款条件', '验收标准', '争议解决') THEN {S.compact_summary('value', None)} ELSE {S.compact_summary('value', None)} END AS out FROM v WHERE value <> '')
    SELECT w.task_id, CASE WHEN label = '账户信息' THEN '合同编号' ELSE label END AS label, out AS value, w.page, w.confidence, arg_min(b.block_id, b.block_no) AS evidence_id
    FROM w LEFT JOIN blocks b ON b.task_id = w.task_id AND b.page = w.page AND (contains({S.clean_lines('b.text')}, {S.clean_lines('out')}) OR contains(replace({S.clean_lines('b.text')}, ' ', ''), replace(out, ' ', ''))) GROUP BY fact_id, w.task_id, label, out, w.page, w.confidence""")
def _(spark, sf):
    f = ordered_facts(spark, sf)
    it = f.select("task_id", F.col("fact_id").alias("fact_key"), "ord", F.when(F.col("label") == "账户信息", "合同编号").otherwise(F.col("label")).alias("label"), "value",
                  F.lit(None).cast("string").alias("evidence_text"), F.col("page").cast("string").alias("page"), F.col("confidence").cast("string").alias("confidence"), F.lit("").alias("notes"))
    return C.build_facts(it, B.blocks(spark, sf)).select("task_id", "label", "value", "page", "confidence", "evidence_id")


@query("fact_dedupe", """WITH f AS (SELECT task_id, label, left(value, 4) AS value, page // 3 AS page, confidence, sort_order FROM key_facts), r AS (SELECT *, row_number() OVER (PARTITION BY task_id, label, value, page ORDER BY confidence DESC, sort_order) AS rk FROM f)
    SELECT task_id, label, value, page::BIGINT AS page, confidence, 'fact_' || printf('%03d', row_number() OVER (PARTITION BY task_id ORDER BY page, label, value)) AS fact_id FROM r WHERE rk = 1""")
def _(spark, sf):
    f = ordered_facts(spark, sf).select("task_id", "label", F.substring("value", 1, 4).alias("value"), F.floor(F.col("page") / 3).alias("page"), "confidence", "ord")
    return C.fact_dedupe(f).drop("ord")


@query("required_facts", f"""SELECT task_id, label, value, page, confidence FROM key_facts UNION ALL SELECT task_id, l, v, 1, 0.2 FROM docs, (SELECT * FROM {S.values([*P.OVERVIEW_DEFAULTS, ("账户信息", "未提取")])} t(l, v)) WHERE (task_id, l) NOT IN (SELECT (task_id, label) FROM key_facts)""")
def _(spark, sf):
    f = ordered_facts(spark, sf).withColumn("notes", F.lit("")).withColumn("evidence_id", F.col("block_id"))
    return C.required_facts(f, B.documents(spark, sf), [*P.OVERVIEW_DEFAULTS, ("账户信息", "未提取")]).select("task_id", "label", "value", "page", "confidence")


@query("requested_fields", f"""WITH cf AS (SELECT * FROM {S.values([(c[0], i, a, b) for c in P.AUDIT_CONFIGS for i, (a, b) in enumerate(c[12])])} t(position, i, label, description)),
    fst AS (SELECT label, arg_min(description, position * 1000 + i) AS description FROM cf GROUP BY label) SELECT label, description, count(clause_id)::BIGINT AS n_clauses FROM fst LEFT JOIN clauses USING (label) GROUP BY ALL""")
def _(spark, sf):
    r = C.requested_fields(G.default_configs(spark))
    n = B.clauses(spark, sf).groupBy("label").agg(F.count(F.lit(1)).alias("n_clauses"))
    return r.join(n, "label", "left").select("label", "description", F.coalesce("n_clauses", F.lit(0)).alias("n_clauses"))


EXTRACT = f"""{FPAGES}, {FCLAUSE}, u AS (SELECT task_id, '合同编号' AS label, value, page, 0.88::DOUBLE AS confidence FROM fpg UNION ALL SELECT task_id, label, value, page, confidence FROM fcl WHERE rk = 1),
    b AS (SELECT task_id, label, value, page, max(confidence) AS confidence FROM u GROUP BY ALL),
    ekf AS (SELECT *, 'fact_' || printf('%03d', row_number() OVER (PARTITION BY task_id ORDER BY page, label, value)) AS fact_id FROM (SELECT * FROM b UNION ALL SELECT task_id, l, v, 1, 0.2 FROM (SELECT DISTINCT task_id FROM blocks), (SELECT * FROM {S.values(P.OVERVIEW_DEFAULTS)} t(l, v)) WHERE (task_id, l) NOT IN (SELECT (task_id, label) FROM b)))"""


@query("extract_key_facts", f"WITH {EXTRACT} SELECT task_id, label, value, page, confidence, fact_id FROM ekf")
def _(spark, sf):
    return C.extract_key_facts(B.blocks(spark, sf), fact_clauses(spark, sf)).select("task_id", "label", "value", "page", "confidence", "fact_id")


@query("fact_map", "SELECT task_id, label, arg_min(value, sort_order) AS value FROM key_facts WHERE value <> '' GROUP BY task_id, label")
def _(spark, sf):
    return C.fact_map(ordered_facts(spark, sf))


HAY = f"""{SECT}, pc AS (SELECT task_id, file_name AS t FROM docs UNION ALL SELECT task_id, title FROM sect
      UNION ALL SELECT task_id, label || chr(10) || value FROM key_facts
      UNION ALL SELECT task_id, title || chr(10) || summary FROM clauses),
    hy AS (SELECT task_id, string_agg(t, chr(10)) AS h FROM pc GROUP BY task_id),
    ch AS ({" UNION ALL ".join(f"SELECT task_id, {i} AS k, {S.q(c)} AS category, {S.words_in('h', w)} AS hits FROM hy" for i, (c, w) in enumerate({**P.CATEGORY_KEYWORDS, "验收付款类": ["验收", "付款", "节点"]}.items()))}),
    cls AS (SELECT task_id, CASE WHEN n = 0 THEN '通用合同类' ELSE category END AS category, CASE WHEN n = 0 THEN 0.3::DOUBLE ELSE 0.55 END AS confidence, CASE WHEN n = 0 THEN '' ELSE array_to_string(hits[1:6], '|') END AS evidence FROM
      (SELECT *, len(hits) AS n, row_number() OVER (PARTITION BY task_id ORDER BY len(hits) DESC, k) AS rk FROM ch) WHERE rk = 1)"""
WORDS = {**P.CATEGORY_KEYWORDS, "验收付款类": ["验收", "付款", "节点"]}


@B.memo
def classified(spark, sf):
    return C.classify_contract(B.documents(spark, sf), sections(spark, sf), ordered_facts(spark, sf), B.clauses(spark, sf), WORDS)


@query("classify_contract", f"WITH {HAY} SELECT *, 'keyword' AS method FROM cls")
def _(spark, sf):
    return classified(spark, sf)


@query("classify_merge", f"WITH {HAY} SELECT task_id, CASE WHEN quality IS NULL THEN category WHEN quality = 1 THEN '买卖合同类' ELSE '通用合同类' END AS category, CASE WHEN quality IS NULL THEN confidence ELSE 0.9 END AS confidence, CASE WHEN quality IS NULL THEN evidence ELSE '采购' END AS evidence, CASE WHEN quality IS NULL THEN 'keyword' ELSE 'llm' END AS method FROM cls LEFT JOIN (SELECT 'task_' || doc_id AS task_id, quality FROM labels) USING (task_id)")
def _(spark, sf):
    lab = B.load(spark, sf, "labels")
    model = lab.select(F.concat(F.lit("task_"), "doc_id").alias("task_id"), F.when(F.col("quality") == 1, "买卖合同类").alias("category"), F.lit("0.9").alias("confidence"), F.array(F.lit(" 采购 "), F.lit(" ")).alias("evidence"))
    return C.classify_merge(model, classified(spark, sf))


def _schema_sql():
    parts = []
    for k, w in P.SCHEMA_ALIASES.items():
        parts.append(f"SELECT task_id, {S.q(k)} AS field, trim(value) AS value, 0 AS tier, sort_order FROM key_facts WHERE value <> '' AND {S.has('label', w)}")
        at = "coalesce(" + ", ".join(f"nullif(strpos(h, {S.q(a)}), 0)" for a in w) + ")"
        parts.append(f"SELECT task_id, {S.q(k)}, {S.strip(f'substr(h, {at})')}, 1, sort_order FROM hh WHERE {S.has('h', w)}")
    return f"""hh AS (SELECT task_id, sort_order, title || chr(10) || summary || chr(10) || raw_text AS h FROM clauses), su AS ({" UNION ALL ".join(parts)}),
    sch AS (SELECT task_id, field, arg_min(value, tier * 1000000 + sort_order) AS value FROM su GROUP BY task_id, field)"""


SCHEMA = _schema_sql()


@B.memo
def schema(spark, sf):
    return C.contract_schema(ordered_facts(spark, sf), B.clauses(spark, sf))


@query("contract_schema", f"WITH {SCHEMA} SELECT task_id, field, value FROM sch")
def _(spark, sf):
    return schema(spark, sf)


PROFILE = f"""{HAY}, {SCHEMA}, pv AS (SELECT task_id, max(value) FILTER (field = 'contract_subject') AS subj, max(value) FILTER (field = 'payment_terms') AS pay FROM sch GROUP BY task_id),
    pl AS (SELECT task_id, string_agg('- ' || title || ': ' || summary, chr(10) ORDER BY sort_order) AS ln FROM clauses GROUP BY task_id),
    prof AS (SELECT task_id, '合同类别：' || category || chr(10) || '合同标的：' || coalesce(subj, '未提取') || chr(10) || '服务内容：' || coalesce(subj, '未提取') || chr(10) || '付款条款：' || coalesce(pay, '未提取') || chr(10) || '关键条款：' || coalesce(chr(10) || ln, '') AS profile FROM cls LEFT JOIN pv USING (task_id) LEFT JOIN pl USING (task_id))"""


@B.memo
def profile(spark, sf):
    return C.contract_profile(classified(spark, sf), C.schema_fields(schema(spark, sf), B.documents(spark, sf)), B.clauses(spark, sf))


@query("contract_profile", f"WITH {PROFILE} SELECT task_id, profile FROM prof")
def _(spark, sf):
    return profile(spark, sf)


@query("candidate_titles", f"""WITH {SECT}, tt AS (SELECT task_id, page, coalesce(arg_min(CASE WHEN {HEAD} AND length(text) <= 32 THEN text ELSE left(text, 32) END, (CASE WHEN {HEAD} AND length(text) <= 32 THEN 0 ELSE 1 END) * 1000000 + block_no), '') AS title FROM blocks GROUP BY task_id, page),
    u AS (SELECT task_id, title, k FROM (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY page) AS k FROM tt) UNION ALL SELECT task_id, title, k + 10000000 FROM (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY sort_order) AS k FROM sect)),
    d AS (SELECT task_id, title, min(k) AS k FROM u WHERE title <> '' GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY k) AS rk FROM d)
    SELECT task_id, string_agg(title, '；' ORDER BY rk) AS titles FROM r GROUP BY task_id""")
def _(spark, sf):
    return C.candidate_titles(D.page_title(blocks(spark, sf)), sections(spark, sf))


@query("model_context", """WITH f AS (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY sort_order) AS p FROM key_facts), c AS (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY sort_order) AS p FROM clauses),
    fl AS (SELECT task_id, string_agg('- ' || label || ': ' || coalesce(nullif(value, ''), '空'), chr(10) ORDER BY p) AS fact_lines FROM f GROUP BY task_id),
    cl AS (SELECT task_id, string_agg('- ' || title, chr(10) ORDER BY p) AS title_lines, string_agg('- ' || title || ': ' || summary, chr(10) ORDER BY p) AS summary_lines FROM c GROUP BY task_id) SELECT * FROM fl FULL JOIN cl USING (task_id)""")
def _(spark, sf):
    return C.model_context(ordered_facts(spark, sf), B.clauses(spark, sf))


RIN = f"""{SECT}, rf AS (SELECT task_id, label, arg_min(value, sort_order) AS v FROM key_facts WHERE value <> '' GROUP BY ALL), ri AS (SELECT t.task_id, (SELECT count(*) FROM sect s WHERE s.task_id = t.task_id) AS sections, (SELECT count(*) FROM clauses c WHERE c.task_id = t.task_id) AS n_clauses,
      (SELECT v FROM rf WHERE rf.task_id = t.task_id AND label = '合同编号') AS number, (SELECT v FROM rf WHERE rf.task_id = t.task_id AND label = '合同金额') AS amount, (SELECT v FROM rf WHERE rf.task_id = t.task_id AND label = '账户信息') AS account,
      {", ".join(f"EXISTS (SELECT 1 FROM clauses c WHERE c.task_id = t.task_id AND core_label = '{v}') AS {k}" for k, v in C.PRESENCE)} FROM docs t)"""


@B.memo
def rule_inputs(spark, sf):
    return C.rule_input(B.documents(spark, sf), sections(spark, sf), B.clauses(spark, sf), ordered_facts(spark, sf))


@query("rule_input", f"WITH {RIN} SELECT task_id, sections::BIGINT AS section_count, n_clauses::BIGINT AS clause_count, number, amount, account, hasPaymentClause AS pay, hasAcceptanceClause AS acc, hasBreachClause AS breach, hasDisputeClause AS dispute, hasAccountClause AS acct FROM ri")
def _(spark, sf):
    r = rule_inputs(spark, sf)
    return r.select("task_id", F.col("contract.sectionCount").alias("section_count"), F.col("contract.clauseCount").alias("clause_count"), F.col("contract.contractNumber").alias("number"),
                    F.col("entities.contractAmount").alias("amount"), F.col("entities.accountInfo").alias("account"), F.col("derived.hasPaymentClause").alias("pay"),
                    F.col("derived.hasAcceptanceClause").alias("acc"), F.col("derived.hasBreachClause").alias("breach"), F.col("derived.hasDisputeClause").alias("dispute"), F.col("derived.hasAccountClause").alias("acct"))


@query("cross_reference_rows", f"SELECT task_id, clause_id, label, page, array_to_string(r, '|') AS \"references\" FROM (SELECT *, {S.cross_refs('raw_text')} AS r FROM clauses) WHERE len(r) > 0")
def _(spark, sf):
    return C.cross_reference_rows(B.clauses(spark, sf).withColumn("references", X.cross_references("raw_text")))


@query("apply_draft_edits", """SELECT task_id, clause_id, CASE WHEN need_review THEN 'page=edited|label=' || label ELSE 'page=' || page || '|label=' || label END AS fields FROM clauses""")
def _(spark, sf):
    c = B.clauses(spark, sf).withColumn("structured_fields", F.create_map(F.lit("label"), F.col("label"), F.lit("page"), F.col("page").cast("string")))
    e = c.where("need_review").select("task_id", "clause_id", F.create_map(F.lit("page"), F.lit("edited")).alias("edited"))
    m = F.col("structured_fields")
    return C.apply_draft_edits(c, e).select("task_id", "clause_id", F.concat(F.lit("page="), m["page"], F.lit("|label="), m["label"]).alias("fields"))
