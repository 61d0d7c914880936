"""Issues, focuses, verification, reports (survey section 2.8)."""

from pyspark.sql import functions as F

from auditframe import params as P
from auditframe.functions import text as X
from auditframe.operators import clauses as C
from auditframe.operators import issues as I
from auditframe.operators import retrieval as V
from auditframe.operators import rules as R
from auditframe.plans import bridge as B
from auditframe.session import stage
from auditframe.sources import configs as G

from . import sqlkit as S
from .clauses import ordered_facts
from .registry import query
from .retrieval import POOL, pool
from .rules import CFG, CON, EXEC, HITS, contracts, bound, engine, exec_rows, hits
from .structure import SECT, sections


@B.memo
def differences(spark, sf):
    """Missing and weakened template clauses derived from clause positions."""
    c = B.clauses(spark, sf)
    n = F.col("sort_order")
    title = F.when(n % 2 == 0, F.concat("label", F.lit("："))).otherwise(F.concat(F.lit("第"), F.col("page").cast("string"), F.lit("页 "), "label"))
    base = c.select("task_id", F.concat(F.lit("t_"), "clause_id").alias("template_clause_id"), n.alias("template_ord"), title.alias("title"), F.lit("payment").alias("clause_type"), "page", "sort_order")
    weak = base.where(n % 3 == 1).withColumn("contract_clause_id", F.col("template_clause_id")).withColumn("score", F.lit(0.5))
    return base.where(n % 3 == 0), weak


@B.memo
def matched(spark, sf):
    return contracts(spark, sf).where(F.col("template_id").isNotNull()).select("task_id", "template_id", "template_name")


_TITLE = "CASE WHEN sort_order % 2 = 0 THEN label || '：' ELSE '第' || page || '页 ' || label END"
_SKIP = " OR ".join(f"(starts_with(plain, {S.q(w)}) AND coalesce(f['{f}'], '') <> '')" for w, f in P.FIELD_TITLES)
ISS = f"""{HITS}, df AS (SELECT c.task_id, sort_order AS ord, {_TITLE} AS title, replace(replace({_TITLE}, '：', ''), ':', '') AS plain, sort_order % 3 AS k, template_id, template_name, f FROM clauses c JOIN con USING (task_id) WHERE template_id IS NOT NULL),
    im AS (SELECT task_id, 'template_missing' AS source, ord, 'must_modify' AS severity, 'legal' AS department, '范本条款: ' || title AS clause_location, '待审合同缺少范本关键条款：' || title AS problem, title AS query, trim(title) AS txt, template_id, template_name AS basis_template, NULL AS source_rule_id, NULL AS source_rule_name, '请补充或引用与范本一致的“' || title || '”条款。' AS suggestion, 0.84::DOUBLE AS confidence, TRUE AS nde FROM df WHERE k = 0 AND NOT ({_SKIP})),
    iw AS (SELECT task_id, 'template_weakened', ord, 'suggest_modify', 'business', '条款比对: ' || title, '待审合同对应条款相较范本存在弱化或偏差：' || title, title, trim(title), template_id, template_name, NULL, NULL, '请核对“' || title || '”条款表述，避免责任或条件被弱化。', 0.76::DOUBLE, FALSE FROM df WHERE k = 1),
    ir AS (SELECT h.task_id, 'rule', rule_no, h.severity, department, clause_location, problem, problem, problem, template_id, basis_template, rule_id, problem, suggestion, 0.86::DOUBLE, clause_location = '' AND {S.has('problem', P.NO_EVIDENCE_WORDS)} FROM hits h JOIN con USING (task_id)),
    iu AS (SELECT * FROM im UNION ALL SELECT * FROM iw UNION ALL SELECT * FROM ir),
    iss AS (SELECT *, 'issue_' || left(sha256(task_id || '|' || source || '|' || severity || '|' || txt), 10) AS issue_id FROM iu QUALIFY row_number() OVER (PARTITION BY task_id, source, severity, txt ORDER BY ord) = 1)"""
OUT = ["task_id", "source", "severity", "department", "clause_location", "problem", "basis_template", "suggestion", "confidence", "no_direct_evidence"]


@B.memo
def three(spark, sf):
    con = stage(contracts(spark, sf))  # read by all three kinds of issues
    m = con.where(F.col("template_id").isNotNull()).select("task_id", "template_id", "template_name")
    miss, weak = differences(spark, sf)
    h = R.run_rules(con, G.rule_catalog(spark))
    return I.issues_missing(miss, con, m), I.issues_weakened(weak, m), I.issues_rules(h, m), con


@B.memo
def all_issues(spark, sf):
    a, b, c, con = three(spark, sf)
    return I.issues(a, b, c), con


def _sel(t):
    return f"SELECT task_id, source, severity, department, clause_location, problem, basis_template, suggestion, confidence, nde AS no_direct_evidence FROM {t}"


COLS = "(task_id, source, ord, severity, department, clause_location, problem, query, txt, template_id, basis_template, source_rule_id, source_rule_name, suggestion, confidence, nde)"


@query("issues_missing", f"WITH {ISS} {_sel('im')}")
def _(spark, sf):
    return three(spark, sf)[0].select(*OUT)


@query("issues_weakened", f"WITH {ISS}, iw2{COLS} AS (SELECT * FROM iw) {_sel('iw2')}")
def _(spark, sf):
    return three(spark, sf)[1].select(*OUT)


@query("issues_rules", f"WITH {ISS}, ir2{COLS} AS (SELECT * FROM ir) {_sel('ir2')}")
def _(spark, sf):
    return three(spark, sf)[2].select(*OUT)


@query("issues", f"WITH {ISS} {_sel('iss').replace('FROM iss', ', issue_id FROM iss')}")
def _(spark, sf):
    return all_issues(spark, sf)[0].select(*OUT, "issue_id")


BASIS = f"""{ISS}, pq AS (SELECT DISTINCT query FROM iss WHERE query <> ''), {POOL},
    bo AS (SELECT query, trim(title) AS t, min(rank) AS r FROM pk JOIN pool USING (clause_id) WHERE trim(title) <> '' GROUP BY ALL), bt AS (SELECT query, string_agg(t, '|' ORDER BY r) AS titles FROM bo GROUP BY query),
    tb AS (SELECT q.template_id, q.query, t.title AS matched_title, t.page_start AS matched_page FROM (SELECT DISTINCT template_id, query FROM iss WHERE template_id IS NOT NULL) q JOIN (SELECT * FROM kb WHERE template_id IS NOT NULL) t USING (template_id)
      QUALIFY row_number() OVER (PARTITION BY q.template_id, q.query ORDER BY CASE WHEN contains(t.title, q.query) OR contains(q.query, t.title) THEN 0 ELSE 1 END, t.page_start, t.clause_no, t.clause_id) = 1)"""


@query("issues_with_basis", f"WITH {BASIS} SELECT task_id, issue_id, coalesce(titles, '') AS basis_titles, matched_title, matched_page FROM iss LEFT JOIN bt USING (query) LEFT JOIN tb USING (template_id, query)")
def _(spark, sf):
    t = B.kb_clauses(spark, sf).where(F.col("template_id").isNotNull())
    return I.with_basis(all_issues(spark, sf)[0], pool(spark, sf), t).select("task_id", "issue_id", "basis_titles", "matched_title", "matched_page")


@query("issues_by_severity", f"WITH {ISS} SELECT task_id, severity, count(*)::BIGINT AS n_issues FROM iss GROUP BY ALL")
def _(spark, sf):
    i, _ = all_issues(spark, sf)
    return i.groupBy("task_id", "severity").agg(F.count(F.lit(1)).alias("n_issues"))


@query("report_summary", f"""WITH {ISS}, n AS (SELECT task_id, count(*) AS a, count_if(severity = 'must_modify') AS b FROM iss GROUP BY task_id)
    SELECT task_id, 'contract_' || task_id AS contract_id, category, template_id, coalesce(a, 0)::BIGINT AS issue_count, coalesce(b, 0)::BIGINT AS must_modify_count, template_id IS NOT NULL AS template_matched,
    '识别合同类别为' || category || '，' || CASE WHEN template_id IS NOT NULL THEN '已匹配范本' ELSE '未匹配到有效范本' END || '，共发现 ' || coalesce(a, 0) || ' 个问题，其中必须修改 ' || coalesce(b, 0) || ' 个。' AS summary FROM con LEFT JOIN n USING (task_id)""")
def _(spark, sf):
    i, con = all_issues(spark, sf)
    return I.report_summary(i, con.select("task_id", "category", "template_id"))


@query("report_payload")
def _(spark, sf):
    from auditframe.operators import compare as K
    from .compare import target_inputs
    i, con = all_issues(spark, sf)
    _, c, f, ev = target_inputs(spark, sf)
    t = K.issue_target(i.withColumn("matched_title", F.lit(None).cast("string")), c, f, ev)
    return I.report_payload(I.report_summary(i, con.select("task_id", "category", "template_id")), i.select("task_id", "issue_id", "severity", "problem"), t)


# --- focuses ----------------------------------------------------------------

@B.memo
def candidate_rows(spark, sf):
    c = B.clauses(spark, sf)
    n = F.col("sort_order")
    return c.select("task_id", n.alias("ord"), F.when(n % 8 == 0, " ").otherwise(F.concat(F.lit(" 关注 "), "label")).alias("title"), F.lit("原因").alias("reason"),
                    F.when(n % 3 == 0, "user_rule_check").alias("focus_source"), F.when(n % 2 == 0, "高").alias("risk_level"), F.when(n % 4 == 0, "0.9").otherwise("x").alias("confidence"),
                    F.when(n % 5 == 0, F.array(F.lit("zzz"))).otherwise(F.array("clause_id", F.lit("zzz"))).alias("clause_ids"),
                    F.when(n % 6 == 1, F.array(F.lit("relation_003"), F.lit("rule_001"))).when(n % 6 == 2, F.array(F.lit("relation_001"))).otherwise(F.array().cast("array<string>")).alias("relation_ids"),
                    F.lit("").alias("location"), F.array("label").alias("depends_on"), F.array(F.lit("model_inference")).alias("tools"), F.lit("").alias("review"))


FCAND = """fcd AS (SELECT task_id, sort_order AS ord, '关注 ' || label AS title, CASE WHEN sort_order % 3 = 0 THEN 'agent_discovered' WHEN sort_order % 6 = 1 THEN 'user_external_check' WHEN sort_order % 6 = 2 THEN 'user_relation_check' ELSE 'agent_discovered' END AS focus_source,
    CASE WHEN sort_order % 6 = 1 THEN 'relation_003' WHEN sort_order % 6 = 2 THEN 'relation_001' ELSE '' END AS relation_ids, CASE WHEN sort_order % 2 = 0 THEN 'high' ELSE 'pending_verification' END AS risk_level, clause_id AS clause_ids, '第 ' || page || ' 页' AS location,
    CASE WHEN sort_order % 4 = 0 THEN 0.9 ELSE 0.66 END::DOUBLE AS confidence FROM clauses WHERE sort_order % 8 <> 0 AND sort_order % 5 <> 0)"""
FSEL = ["task_id", "ord", "title", "focus_source", "relation_ids", "risk_level", "clause_ids", "location", "confidence"]


@query("focuses_from_candidates", f"WITH {FCAND} SELECT * FROM fcd")
def _(spark, sf):
    return I.focuses_from_candidates(candidate_rows(spark, sf), B.clauses(spark, sf), G.default_configs(spark)).select(*FSEL)


@query("focus_groups_input", " UNION ALL ".join(f"""SELECT task_id, '{g}' AS focus_group, clause_id FROM clauses WHERE list_contains({S.lst(l)}, core_label) UNION ALL SELECT task_id, '{g}', clause_id FROM (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY sort_order {o}) AS r FROM clauses WHERE task_id NOT IN (SELECT task_id FROM clauses WHERE list_contains({S.lst(l)}, core_label)))""" for (g, l), o in zip(P.FOCUS_LABELS.items(), ["", "DESC"])))
def _(spark, sf):
    return I.focus_groups_input(B.clauses(spark, sf))


@B.memo
def relabelled(spark, sf):
    """Clauses with two labels renamed so that the relation words find clauses."""
    k = F.col("core_label")
    return B.clauses(spark, sf).withColumn("core_label", F.when(k == "违约责任", "甲乙方信息").when(k == "争议解决", "服务/采购/工程内容").otherwise(k))


FREL = f"""{CFG}, rl AS (SELECT * REPLACE (CASE core_label WHEN '违约责任' THEN '甲乙方信息' WHEN '争议解决' THEN '服务/采购/工程内容' ELSE core_label END AS core_label) FROM clauses),
    ll AS (SELECT task_id, core_label, arg_max(clause_id, sort_order) AS cid, arg_max(page, sort_order) AS page FROM rl GROUP BY ALL),
    fr0 AS (SELECT task_id, position, id, name, config_type, k, label, cid, page FROM cfg JOIN (SELECT * FROM {S.values([(i, w, l) for i, (w, l) in enumerate(P.RELATION_WORDS)])} t(k, w, label)) ON contains(name, w) JOIN ll ON ll.core_label = label WHERE config_type <> 'rule_check'),
    frl AS (SELECT task_id, position::BIGINT AS ord, CASE WHEN name LIKE '%核验' THEN name ELSE name || '核验' END AS title, CASE WHEN config_type = 'external_check' THEN 'user_external_check' ELSE 'user_relation_check' END AS focus_source, id AS relation_ids, 'pending_verification' AS risk_level, string_agg(cid, '|' ORDER BY k) AS clause_ids, string_agg('第 ' || page || ' 页', ' / ' ORDER BY k) AS location, 0.68::DOUBLE AS confidence FROM fr0 GROUP BY ALL)"""


@query("focuses_from_relations", f"WITH {FREL} SELECT * FROM frl")
def _(spark, sf):
    return I.focuses_from_relations(relabelled(spark, sf), G.default_configs(spark)).select(*FSEL)


FRUL = f"""{EXEC}, ll2 AS (SELECT task_id, core_label, arg_max(clause_id, sort_order) AS cid, arg_max(page, sort_order) AS page FROM clauses GROUP BY ALL),
    fx AS (SELECT x.*, (SELECT page FROM clauses c WHERE c.task_id = x.task_id AND c.clause_id = x.ev) AS evp, (SELECT string_agg(cid, '|' ORDER BY list_position(x.expected, core_label)) FROM ll2 WHERE ll2.task_id = x.task_id AND list_contains(x.expected, core_label)) AS xids,
      (SELECT string_agg('第 ' || page || ' 页', ' / ' ORDER BY page) FROM (SELECT DISTINCT page FROM ll2 WHERE ll2.task_id = x.task_id AND list_contains(x.expected, core_label))) AS xloc FROM xs x),
    frx AS (SELECT task_id, position AS ord, name AS title, 'user_rule_check' AS focus_source, config_id AS relation_ids, risk_level, coalesce(ev, xids, '') AS clause_ids, CASE WHEN ev IS NOT NULL THEN '第 ' || evp || ' 页' ELSE coalesce(xloc, '规则引擎返回中未附带具体条款定位') END AS location, confidence FROM fx)"""


@B.memo
def rule_focuses(spark, sf):
    return I.focuses_from_rules(exec_rows(spark, sf), B.clauses(spark, sf))


@query("focuses_from_rules", f"WITH {FRUL} SELECT * FROM frx")
def _(spark, sf):
    return rule_focuses(spark, sf).select(*FSEL)


def with_details(i):
    """Issues with a basis made of their own query (the lookup itself has its own query)."""
    d = F.array(F.struct(F.lit(1).alias("pos"), F.col("query").alias("title")))
    return i.withColumn("basis_details", d)


@query("focuses_from_issues", f"""WITH {ISS} SELECT task_id, 'kb_' || issue_id AS focus_id, problem AS title, CASE severity WHEN 'must_modify' THEN 'high' WHEN 'suggest_modify' THEN 'medium' ELSE 'pending_verification' END AS risk_level,
    coalesce(nullif(clause_location, ''), '制度底座定位') AS location, concat_ws('；', '制度依据：' || query, '范本依据：' || basis_template, '规则：' || source_rule_name) AS basis, query AS depends_on FROM iss""")
def _(spark, sf):
    return I.focuses_from_issues(with_details(all_issues(spark, sf)[0])).select("task_id", "focus_id", "title", "risk_level", "location", "basis", "depends_on")


RANK = "CASE focus_source WHEN 'user_rule_check' THEN 0 WHEN 'user_relation_check' THEN 1 WHEN 'user_external_check' THEN 2 WHEN 'agent_discovered' THEN 3 ELSE 9 END"
FDED = f"""{FCAND}, fz AS (SELECT * REPLACE ('' AS clause_ids) FROM fcd), fdd AS (SELECT * FROM fz QUALIFY row_number() OVER (PARTITION BY task_id, title, clause_ids, focus_source ORDER BY confidence DESC, ord) = 1)"""


@query("focus_dedupe", f"WITH {FDED} SELECT task_id, title, focus_source, risk_level, confidence, 'audit_' || printf('%03d', row_number() OVER (PARTITION BY task_id ORDER BY {RANK}, risk_level, confidence DESC, title, ord)) AS focus_id FROM fdd")
def _(spark, sf):
    f = I.focuses_from_candidates(candidate_rows(spark, sf), B.clauses(spark, sf), G.default_configs(spark)).withColumn("clause_ids", F.array().cast("array<string>"))
    return I.focus_dedupe(f).select("task_id", "title", "focus_source", "risk_level", "confidence", "focus_id")


FGEN = f"""{FRUL}, {FCAND}, {FREL.replace(CFG + ', ', '')}, gu AS (SELECT * FROM frx UNION ALL SELECT * REPLACE (ord + 1000000 AS ord) FROM fcd UNION ALL SELECT * REPLACE (ord + 2000000 AS ord) FROM frl),
    gd AS (SELECT * FROM gu QUALIFY row_number() OVER (PARTITION BY task_id, title, array_to_string(list_sort(string_split(clause_ids, '|')), '|'), focus_source ORDER BY confidence DESC, ord) = 1),
    gen AS (SELECT * REPLACE (row_number() OVER (PARTITION BY task_id ORDER BY {RANK}, risk_level, confidence DESC, title, ord) AS ord) FROM gd)"""


@B.memo
def generated(spark, sf):
    cfg = G.default_configs(spark)
    cand = I.focuses_from_candidates(candidate_rows(spark, sf), B.clauses(spark, sf), cfg)
    return I.generate_focuses(rule_focuses(spark, sf), cand, I.focuses_from_relations(relabelled(spark, sf), cfg))


@query("generate_focuses", f"WITH {FGEN} SELECT task_id, ord, title, focus_source, risk_level, clause_ids, confidence FROM gen")
def _(spark, sf):
    return generated(spark, sf).select("task_id", "ord", "title", "focus_source", "risk_level", "clause_ids", "confidence")


@query("merge_by_id", "SELECT task_id, clause_id, CASE WHEN sort_order % 2 = 0 THEN label ELSE title || '*' END AS label FROM clauses")
def _(spark, sf):
    c = B.clauses(spark, sf)
    return I.merge_by_id("clause_id", c.where(F.col("sort_order") % 2 == 0).select("task_id", "clause_id", "label"), c.select("task_id", "clause_id", F.concat("title", F.lit("*")).alias("label")))


@query("clause_focus_links", f"WITH {FREL} SELECT c.task_id, c.clause_id, coalesce(string_agg('f' || ord, '|' ORDER BY ord), '') AS focus_ids FROM clauses c LEFT JOIN frl ON frl.task_id = c.task_id AND list_contains(string_split(frl.clause_ids, '|'), c.clause_id) GROUP BY ALL")
def _(spark, sf):
    f = I.focuses_from_relations(relabelled(spark, sf), G.default_configs(spark)).withColumn("focus_id", F.concat(F.lit("f"), "ord"))
    return I.clause_focus_links(B.clauses(spark, sf), f)


# --- verification -----------------------------------------------------------

VREQ = f"""vl AS (SELECT * FROM {S.values(list(enumerate(P.VERIFY_REQUIRED, start=1)))} t(i, label)), vc AS (SELECT task_id, core_label, arg_max(clause_id, sort_order) AS cid FROM clauses GROUP BY ALL),
    vrq AS (SELECT d.task_id, 'verify_required_' || printf('%03d', i) AS item_id, CASE WHEN cid IS NULL THEN 'fail' ELSE 'pass' END AS status, CASE WHEN cid IS NULL THEN '未识别到 ' || label || '。建议回看合同原文并人工复核是否缺失。' ELSE '已识别到 ' || label || '，并建立了原文证据映射。' END AS description, coalesce(cid, '') AS clause_ids FROM docs d CROSS JOIN vl LEFT JOIN vc ON vc.task_id = d.task_id AND vc.core_label = label)"""
VKEY = "vky AS (" + " UNION ALL ".join(f"SELECT task_id, 'verify_keyword_' || clause_id AS item_id, CASE WHEN len(h) >= 2 THEN 'pass' ELSE 'warning' END AS status, '命中关键词：' || CASE WHEN len(h) > 0 THEN array_to_string(h, '、') ELSE '未命中核心关键词' END || '。' AS description, clause_id AS clause_ids FROM (SELECT *, {S.words_in('raw_text', w)} AS h FROM clauses WHERE core_label = {S.q(k)})" for k, w in P.VERIFY_KEYWORDS.items()) + ")"
VCON = "vcf AS (SELECT task_id, 'verify_low_confidence' AS item_id, 'warning' AS status, '发现 ' || count(*) || ' 条低置信度条款，建议重点复核。' AS description, string_agg(clause_id, '|' ORDER BY sort_order) AS clause_ids FROM clauses WHERE confidence < 0.65 GROUP BY task_id)"
VSTR = f"{SECT}, vst AS (SELECT task_id, 'verify_structure' AS item_id, 'pass' AS status, '共识别 ' || count(*) || ' 个章节，并完成了顺序和页码映射。' AS description, '' AS clause_ids FROM sect GROUP BY task_id)"
VEXT = "vex AS (SELECT task_id, 'verify_external_dependencies' AS item_id, 'external_pending' AS status, '发现 ' || count(DISTINCT ord) || ' 项关注事项需要结合外部数据进一步核验。' AS description, string_agg(DISTINCT c, '|' ORDER BY c) AS clause_ids FROM (SELECT task_id, ord, unnest(string_split(clause_ids, '|')) AS c FROM frl WHERE risk_level = 'pending_verification') GROUP BY task_id)"
VSEL = ["task_id", "item_id", "status", "description", "clause_ids"]


@query("verify_required", f"WITH {VREQ} SELECT * FROM vrq")
def _(spark, sf):
    return I.verify_required(B.documents(spark, sf), B.clauses(spark, sf)).select(*VSEL)


@query("verify_keywords", f"WITH {VKEY} SELECT * FROM vky")
def _(spark, sf):
    return I.verify_keywords(B.clauses(spark, sf)).select(*VSEL)


@query("verify_confidence", f"WITH {VCON} SELECT * FROM vcf")
def _(spark, sf):
    return I.verify_confidence(B.clauses(spark, sf)).select(*VSEL)


@query("verify_external", f"WITH {FREL}, {VEXT} SELECT * FROM vex")
def _(spark, sf):
    return I.verify_external(I.focuses_from_relations(relabelled(spark, sf), G.default_configs(spark))).select(*VSEL)


@query("verify_structure", f"WITH {VSTR} SELECT * FROM vst")
def _(spark, sf):
    return I.verify_structure(sections(spark, sf)).select(*VSEL)


from .rules import STATUS  # noqa: E402

_MISST = "(SELECT string_agg(name || ' (' || rule_id || ')', '；' ORDER BY position) FROM miss)"
VENG = f"""{STATUS}, hc AS (SELECT task_id, count(*) AS n FROM dm GROUP BY task_id), ven AS (
    SELECT s.task_id, CASE WHEN status = 'engine_error' THEN 'verify_rule_engine_error' ELSE 'verify_rule_engine_summary' END AS item_id, CASE WHEN status = 'engine_error' OR coalesce(n, 0) > 0 THEN 'warning' ELSE 'pass' END AS status,
      CASE WHEN status = 'engine_error' THEN '规则引擎调用失败，本轮未能完成规则校验。' WHEN coalesce(n, 0) > 0 THEN '规则引擎已执行，本轮共命中 ' || n || ' 条规则。' ELSE '规则引擎已执行，当前未命中已配置规则。' END AS description, '' AS clause_ids FROM stt s LEFT JOIN hc USING (task_id)
    UNION ALL SELECT task_id, 'verify_rule_engine_missing_configured_rules', 'warning', '发现 ' || (SELECT count(*) FROM miss) || ' 条规则配置在当前规则目录中不存在：' || {_MISST} || '。', '' FROM stt WHERE status IN ('ok', 'ok_with_warnings') AND (SELECT count(*) FROM miss) > 0
    UNION ALL SELECT task_id, 'verify_rule_engine_unmatched_rules', 'warning', '规则引擎返回了 ' || count(*) || ' 条未绑定到当前审计配置的规则：' || string_agg(rule_name, '；' ORDER BY match_no) || '。', '' FROM unm GROUP BY task_id
    UNION ALL SELECT task_id, 'verify_rule_engine_' || printf('%03d', row_number() OVER (PARTITION BY task_id ORDER BY match_no)), CASE WHEN lower(severity) IN ('low', 'medium') THEN 'warning' ELSE 'fail' END, coalesce(nullif(reason, ''), '规则引擎命中了一个待复核条件。'), coalesce(ev, '') FROM dm)"""


@B.memo
def engine_items(spark, sf):
    s, cfg, b, miss = engine(spark, sf)
    return I.verify_engine(s, b, miss, R.unmatched_returned(b, cfg), B.clauses(spark, sf))


@query("verify_engine", f"WITH {VENG} SELECT * FROM ven")
def _(spark, sf):
    return engine_items(spark, sf).select(*VSEL)


@query("verify_issues", f"WITH {ISS} SELECT task_id, 'kb_verify_' || issue_id AS item_id, CASE severity WHEN 'must_modify' THEN 'fail' WHEN 'suggest_modify' THEN 'warning' ELSE 'external_pending' END AS status, suggestion AS description, '' AS clause_ids FROM iss")
def _(spark, sf):
    return I.verify_issues(all_issues(spark, sf)[0]).select(*VSEL)


@query("verification", f"WITH {VREQ}, {VKEY}, {VCON}, {VSTR}, va AS (SELECT * FROM vrq UNION ALL SELECT * FROM vky UNION ALL SELECT * FROM vcf UNION ALL SELECT * FROM vst) SELECT * REPLACE (CASE WHEN item_id = 'verify_structure' THEN '叙述' ELSE description END AS description) FROM va")
def _(spark, sf):
    c = B.clauses(spark, sf)
    n = B.documents(spark, sf).select("task_id", F.lit("verify_structure").alias("item_id"), F.lit("叙述").alias("description"), F.lit("").alias("method"))
    return I.verification([I.verify_required(B.documents(spark, sf), c), I.verify_keywords(c), I.verify_confidence(c), I.verify_structure(sections(spark, sf))], n).select(*VSEL)


@query("confidence_overview", f"""WITH {SECT}, {FREL}, s AS (SELECT task_id, round(avg(0.4137::DOUBLE + level / 10.0::DOUBLE), 6) AS s FROM sect GROUP BY task_id), c AS (SELECT task_id, round(avg(confidence + 0.0013::DOUBLE), 6) AS c, count_if(need_review) AS r FROM clauses GROUP BY task_id), f AS (SELECT task_id, round(avg(confidence), 6) AS f, count_if(risk_level = 'pending_verification') AS p FROM frl GROUP BY task_id)
    SELECT d.task_id, round(coalesce(s, 0) * 0.32::DOUBLE + coalesce(c, 0) * 0.38::DOUBLE + coalesce(f, 0) * 0.3::DOUBLE, 2) AS overall, round(coalesce(s, 0), 2)::DOUBLE AS sections, round(coalesce(c, 0), 2)::DOUBLE AS clauses, round(coalesce(f, 0), 2)::DOUBLE AS audit, (coalesce(r, 0) + coalesce(p, 0))::BIGINT AS warnings FROM docs d LEFT JOIN s USING (task_id) LEFT JOIN c USING (task_id) LEFT JOIN f USING (task_id)""")
def _(spark, sf):
    s = sections(spark, sf).withColumn("confidence", 0.4137 + F.col("level") / 10)
    return I.confidence_overview(B.documents(spark, sf), s, B.clauses(spark, sf).withColumn("confidence", F.col("confidence") + 0.0013), I.focuses_from_relations(relabelled(spark, sf), G.default_configs(spark)))


@query("task_status", "SELECT d.task_id, CASE WHEN doc_id % 7 = 0 OR d.task_id IN (SELECT task_id FROM clauses WHERE need_review) THEN 'needs_review' ELSE 'completed' END AS status FROM docs d")
def _(spark, sf):
    d = B.documents(spark, sf)
    return I.task_status(d, d.select("task_id", F.when(F.col("doc_id") % 7 == 0, "w").alias("warning")), B.clauses(spark, sf))


@query("agent_step_log", f"""WITH {SECT}, u AS (SELECT task_id, 1 AS k, count(*) AS n FROM blocks GROUP BY task_id UNION ALL SELECT task_id, 2, count(*) FROM sect GROUP BY task_id UNION ALL SELECT task_id, 3, count(*) FROM clauses GROUP BY task_id UNION ALL SELECT task_id, 4, count(*) FROM key_facts GROUP BY task_id)
    SELECT d.task_id, 'step_' || printf('%03d', s.k) AS step_id, s.name, CASE WHEN s.name = 'blocks' AND doc_id % 7 = 0 THEN 'warning' ELSE 'success' END AS status, coalesce(n, 0)::BIGINT AS n_rows FROM docs d CROSS JOIN (SELECT * FROM (VALUES (1, 'blocks'), (2, 'sections'), (3, 'clauses'), (4, 'facts')) t(k, name)) s LEFT JOIN u ON u.task_id = d.task_id AND u.k = s.k""")
def _(spark, sf):
    d = B.documents(spark, sf)
    w = d.where(F.col("doc_id") % 7 == 0).select("task_id", F.lit("blocks").alias("stage"))
    return I.agent_step_log(d, {"blocks": B.blocks(spark, sf), "sections": sections(spark, sf), "clauses": B.clauses(spark, sf), "facts": B.key_facts(spark, sf)}, w)
