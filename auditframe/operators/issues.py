"""Issues, audit focuses, verification items and reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import params as P
from ..functions import ordered as O
from ..functions import text as X
from ..session import stage
from . import retrieval as V

# --- issues -----------------------------------------------------------------

ISSUE_COLUMNS = ["task_id", "source", "ord", "severity", "department", "clause_location", "problem", "query", "dedupe_text", "template_id", "basis_template",
                 "source_rule_id", "source_rule_name", "suggestion", "confidence", "no_direct_evidence", "basis_ids"]


def _none(t="string"):
    return F.lit(None).cast(t)


def _no_ids():
    return F.array().cast("array<string>").alias("basis_ids")


def issues_missing(missing: DataFrame, fields: DataFrame, matched: DataFrame) -> DataFrame:
    """Missing template clause -> issue, unless the title starts with a field word whose field is filled."""
    plain = X.strip(F.translate("title", "：:", ""))
    j = missing.join(matched.select("task_id", "template_id", "template_name"), "task_id").join(fields.select("task_id", "fields"), "task_id", "left").withColumn("_plain", plain)
    skip = F.expr(" OR ".join(f"(startswith(_plain, {X.sql_lit(w)}) AND coalesce(try_element_at(fields, {X.sql_lit(f)}), '') != '')" for w, f in P.FIELD_TITLES))
    j = j.where(~skip)
    return j.select("task_id", F.lit("template_missing").alias("source"), F.col("template_ord").alias("ord"), F.lit("must_modify").alias("severity"), F.lit("legal").alias("department"),
                    F.concat(F.lit("范本条款: "), "title").alias("clause_location"), F.concat(F.lit("待审合同缺少范本关键条款："), "title").alias("problem"), F.col("title").alias("query"),
                    X.strip("title").alias("dedupe_text"), "template_id", F.col("template_name").alias("basis_template"), _none().alias("source_rule_id"), _none().alias("source_rule_name"),
                    F.concat(F.lit("请补充或引用与范本一致的“"), "title", F.lit("”条款。")).alias("suggestion"), F.lit(P.ISSUE_CONFIDENCE["template_missing"]).alias("confidence"), F.lit(True).alias("no_direct_evidence"), _no_ids())


def issues_weakened(weakened: DataFrame, matched: DataFrame) -> DataFrame:
    j = weakened.join(matched.select("task_id", "template_id", "template_name"), "task_id")
    return j.select("task_id", F.lit("template_weakened").alias("source"), F.col("template_ord").alias("ord"), F.lit("suggest_modify").alias("severity"), F.lit("business").alias("department"),
                    F.concat(F.lit("条款比对: "), "title").alias("clause_location"), F.concat(F.lit("待审合同对应条款相较范本存在弱化或偏差："), "title").alias("problem"), F.col("title").alias("query"),
                    X.strip("title").alias("dedupe_text"), "template_id", F.col("template_name").alias("basis_template"), _none().alias("source_rule_id"), _none().alias("source_rule_name"),
                    F.concat(F.lit("请核对“"), "title", F.lit("”条款表述，避免责任或条件被弱化。")).alias("suggestion"), F.lit(P.ISSUE_CONFIDENCE["template_weakened"]).alias("confidence"), F.lit(False).alias("no_direct_evidence"), _no_ids())


def issues_rules(hits: DataFrame, matched: DataFrame) -> DataFrame:
    """Rule hits as issues; the clause ids a rule names itself travel along as basis_ids."""
    ids = F.coalesce("basis_ids", F.array().cast("array<string>")).alias("basis_ids") if "basis_ids" in hits.columns else _no_ids()
    j = hits.join(matched.select("task_id", "template_id"), "task_id", "left")
    no_ev = (X.strip("clause_location") == "") & X.contains_any("problem", P.NO_EVIDENCE_WORDS)
    return j.select("task_id", F.lit("rule").alias("source"), F.col("rule_no").cast("long").alias("ord"), "severity", "department", "clause_location", "problem", F.col("problem").alias("query"),
                    X.strip("problem").alias("dedupe_text"), "template_id", "basis_template", F.col("rule_id").alias("source_rule_id"), F.col("rule_name").alias("source_rule_name"), "suggestion", "confidence", no_ev.alias("no_direct_evidence"), ids)


def issues(missing: DataFrame, weakened: DataFrame, hits: DataFrame) -> DataFrame:
    """Union of the three kinds, first per (source, severity, text); ids are stable digests."""
    u = missing.select(*ISSUE_COLUMNS).unionByName(weakened.select(*ISSUE_COLUMNS)).unionByName(hits.select(*ISSUE_COLUMNS))
    best = O.first_by(u, ["task_id", "source", "severity", "dedupe_text"], ["ord"])
    return best.withColumn("issue_id", F.concat(F.lit("issue_"), F.substring(F.sha2(F.concat_ws("|", "task_id", "source", "severity", "dedupe_text"), 256), 1, 10)))


def with_basis(issue_rows: DataFrame, pool: DataFrame, templates: DataFrame) -> DataFrame:
    """Adds policy titles and details and the matched template clause; each distinct lookup (query and given ids) is resolved once."""
    request = F.sha2(F.concat_ws("\x1f", "query", F.array_join("basis_ids", "\x1e")), 256)
    issue_rows = stage(issue_rows.withColumn("_request", request))  # read by both lookups and by the result
    q = issue_rows.select(F.col("_request").alias("request_id"), "query", F.col("basis_ids").alias("clause_ids")).distinct()
    b = V.policy_basis(q, pool)
    details = F.array_sort(F.collect_list(F.struct("pos", "clause_id", "title", "content", "page_start", "page_end", "document_id")))
    b = b.groupBy(F.col("request_id").alias("_request")).agg(details.alias("basis_details"))
    titles = F.array_distinct(F.filter(F.transform("basis_details", lambda d: X.strip(d["title"])), lambda t: t != ""))
    t = V.template_basis(issue_rows.select("template_id", F.col("query").alias("title")).where(F.col("template_id").isNotNull()).distinct(), templates)
    j = issue_rows.join(b, "_request", "left").drop("_request").join(t.select("template_id", F.col("title").alias("query"), "matched_title", "matched_page"), ["template_id", "query"], "left")
    return j.withColumn("basis_titles", F.coalesce(titles, F.array().cast("array<string>")))


def report_summary(issue_rows: DataFrame, contracts: DataFrame) -> DataFrame:
    """contracts: task_id, category, template_id (null when none)."""
    n = issue_rows.groupBy("task_id").agg(F.count(F.lit(1)).alias("issue_count"), F.count_if(F.col("severity") == "must_modify").alias("must_modify_count"))
    j = contracts.join(n, "task_id", "left").na.fill(0, ["issue_count", "must_modify_count"])
    has = F.col("template_id").isNotNull()
    text = F.format_string("识别合同类别为%s，%s，共发现 %d 个问题，其中必须修改 %d 个。", "category", F.when(has, "已匹配范本").otherwise("未匹配到有效范本"), "issue_count", "must_modify_count")
    return j.select("task_id", F.concat(F.lit("contract_"), "task_id").alias("contract_id"), "category", "template_id", "issue_count", "must_modify_count", has.alias("template_matched"), text.alias("summary"))


def report_payload(summary: DataFrame, issue_rows: DataFrame, targets: DataFrame) -> DataFrame:
    """One row per issue with its report head and its preview target."""
    i = issue_rows.join(targets, ["task_id", "issue_id"], "left")
    return summary.select("task_id", "contract_id", "summary").join(i, "task_id")


# --- focuses ----------------------------------------------------------------

FOCUS_COLUMNS = ["task_id", "ord", "title", "focus_source", "relation_ids", "risk_level", "reason", "clause_ids", "location", "confidence", "depends_on", "tools", "review", "config_id", "rule_id", "engine_status"]


def _pages_text(pages):
    return F.array_join(F.transform(F.array_sort(F.array_distinct(pages)), lambda p: F.concat(F.lit("第 "), p.cast("string"), F.lit(" 页"))), " / ")


def _kept_ids(items: DataFrame, key: list[str], clauses: DataFrame) -> DataFrame:
    """The listed clause ids that exist, in order, with their pages."""
    e = items.select(*key, F.posexplode("ids").alias("pos", "clause_id")).join(clauses.select("task_id", "clause_id", "page"), ["task_id", "clause_id"])
    s = F.array_sort(F.collect_list(F.struct("pos", "clause_id", "page")))
    return e.groupBy(*key).agg(s.alias("s")).select(*key, F.transform("s", lambda x: x["clause_id"]).alias("clause_ids"), F.transform("s", lambda x: x["page"]).alias("pages"))


def focuses_from_candidates(items: DataFrame, clauses: DataFrame, configs: DataFrame) -> DataFrame:
    """Model rows with at least one existing clause and with title and reason; sources and defaults filled.

    items: task_id, ord, title, reason, focus_source, risk_level, confidence, clause_ids, relation_ids, location, depends_on, tools, review.
    """
    i = items.withColumn("title", X.strip(X.text_of("title"))).withColumn("reason", X.strip(X.text_of("reason"))).where((F.col("title") != "") & (F.col("reason") != ""))
    kept = _kept_ids(i.select("task_id", "ord", F.col("clause_ids").alias("ids")), ["task_id", "ord"], clauses)
    cfg = configs.where(F.col("enabled") & (F.col("config_type") != "rule_check")).select(F.col("id").alias("rel"), (F.col("config_type") == "external_check").alias("ext"))
    r = i.select("task_id", "ord", F.posexplode("relation_ids").alias("pos", "rel")).join(cfg, "rel")
    rs = F.array_sort(F.collect_list(F.struct("pos", "rel")))
    r = r.groupBy("task_id", "ord").agg(F.transform(rs, lambda x: x["rel"]).alias("rels"), F.count_if("ext").alias("n_ext"))
    j = i.drop("clause_ids").join(kept, ["task_id", "ord"]).join(r, ["task_id", "ord"], "left")
    rels = F.coalesce("rels", F.array().cast("array<string>"))
    loc = F.coalesce(F.nullif(X.strip(X.text_of("location")), F.lit("")), _pages_text(F.col("pages")))
    return j.select("task_id", "ord", "title", X.focus_source("focus_source", F.size(rels), F.coalesce("n_ext", F.lit(0))).alias("focus_source"), rels.alias("relation_ids"), X.risk_level("risk_level").alias("risk_level"),
                    "reason", "clause_ids", loc.alias("location"), X.clamp_confidence("confidence", 0.66).alias("confidence"), "depends_on", X.tool_labels("tools").alias("tools"),
                    F.coalesce(F.nullif(X.strip(X.text_of("review")), F.lit("")), F.lit("建议审计人员结合合同原文、业务单据和外部系统进一步复核。")).alias("review"),
                    _none().alias("config_id"), _none().alias("rule_id"), _none().alias("engine_status"))


def focus_groups_input(clauses: DataFrame, n: int | None = None) -> DataFrame:
    """Clauses of the two context groups; a task without any gets all its clauses (or its first, or last, n)."""
    perf, rel = P.FOCUS_LABELS["performance"], P.FOCUS_LABELS["relation"]
    def group(name, labels, order):
        hit = clauses.where(F.col("core_label").isin(labels))
        rest = clauses.join(hit.select("task_id").distinct(), "task_id", "left_anti")
        rest = rest if n is None else O.top_k(rest, ["task_id"], [order], n, "_r").drop("_r")
        return hit.unionByName(rest).select("task_id", F.lit(name).alias("focus_group"), "clause_id")
    return group("performance", perf, F.col("sort_order")).unionByName(group("relation", rel, F.desc("sort_order")))


def last_by_label(clauses: DataFrame, labels: list[str]) -> DataFrame:
    """Per task a map from core label to its last clause (labels are a closed list, so the map is bounded)."""
    c = clauses.where(F.col("core_label").isin(labels)).groupBy("task_id", "core_label").agg(F.max_by(F.struct("clause_id", "page"), "sort_order").alias("c"))
    return c.groupBy("task_id").agg(F.map_from_entries(F.collect_list(F.struct("core_label", "c"))).alias("by_label"))


def packed_configs(configs: DataFrame, columns: list[str], limit: int = 5000) -> DataFrame:
    """Configurations as one array value in one row.  They are settings, not data; more than ``limit`` is refused."""
    n = configs.limit(limit + 1).count()
    if n > limit:
        raise ValueError(f"more than {limit} configurations")
    return configs.agg(F.array_sort(F.collect_list(F.struct("position", *columns))).alias("cs"))


def focuses_from_relations(clauses: DataFrame, configs: DataFrame) -> DataFrame:
    """Relation configurations whose name holds a word with a matching clause."""
    c = configs.where(F.col("enabled") & (F.col("config_type") != "rule_check"))
    packed = packed_configs(c, ["id", "name", "description", "risk_prompt", "config_type", "tools"])
    t = last_by_label(clauses, [v for _, v in P.RELATION_WORDS]).join(F.broadcast(packed)).select("task_id", "by_label", F.explode("cs").alias("c"))
    parts = F.array(*[F.when(F.col("c.name").contains(w) & F.map_contains_key("by_label", F.lit(label)), F.struct(F.lit(label).alias("label"), F.col("by_label")[label].alias("at"))) for w, label in P.RELATION_WORDS])
    t = t.withColumn("ps", F.array_compact(parts)).where(F.size("ps") > 0)
    name = F.col("c.name")
    title = F.when(name.endswith("核验"), name).otherwise(F.concat(name, F.lit("核验")))
    return t.select("task_id", F.col("c.position").cast("long").alias("ord"), title.alias("title"), X.source_of_config("c.config_type").alias("focus_source"), F.array("c.id").alias("relation_ids"),
                    F.lit("pending_verification").alias("risk_level"), F.concat(F.lit("该关注项来自用户配置："), F.coalesce(F.nullif("c.description", F.lit("")), F.col("c.risk_prompt"))).alias("reason"),
                    F.array_distinct(F.transform("ps", lambda p: p["at"]["clause_id"])).alias("clause_ids"),
                    F.array_join(F.transform("ps", lambda p: F.concat(F.lit("第 "), p["at"]["page"].cast("string"), F.lit(" 页"))), " / ").alias("location"),
                    F.lit(0.68).alias("confidence"), F.transform("ps", lambda p: p["label"]).alias("depends_on"), X.tool_labels("c.tools").alias("tools"),
                    F.lit("建议结合配置所依赖的业务系统、主数据或规则引擎结果进一步复核。").alias("review"), F.col("c.id").alias("config_id"), _none().alias("rule_id"), _none().alias("engine_status"))


def focuses_from_rules(status: DataFrame, clauses: DataFrame, labels=P.CLAUSE_LABELS) -> DataFrame:
    """One focus per rule configuration and contract; matched clauses first, expected clauses otherwise.

    status: output of ``rule_exec_status``.
    """
    key = ["task_id", "position"]
    ev = status.where(F.size("evidence_clause_ids") > 0).select(*key, F.col("evidence_clause_ids").alias("ids"))
    kept = _kept_ids(ev, key, clauses)
    t = status.join(kept, key, "left").join(last_by_label(clauses, labels), "task_id", "left")
    want = F.filter(F.transform("expected_clauses", lambda x: F.try_element_at("by_label", x)), lambda x: x.isNotNull())
    t = t.withColumn("want", F.coalesce(want, F.array().cast("array<struct<clause_id:string,page:bigint>>")))
    use = F.size("clause_ids") > 0
    ids = F.array_distinct(F.when(use, F.col("clause_ids")).otherwise(F.transform("want", lambda x: x["clause_id"])))
    pages = F.when(use, F.col("pages")).otherwise(F.transform("want", lambda x: x["page"]))
    t = t.withColumn("ids", ids).withColumn("pp", pages)
    return t.select("task_id", F.col("position").cast("long").alias("ord"), F.col("name").alias("title"), F.lit("user_rule_check").alias("focus_source"), F.array("config_id").alias("relation_ids"), "risk_level", "reason",
                    F.col("ids").alias("clause_ids"), F.when(F.size("ids") > 0, _pages_text(F.col("pp"))).otherwise("规则引擎返回中未附带具体条款定位").alias("location"), "confidence", "depends_on",
                    X.tool_labels("tools").alias("tools"), F.col("human_review").alias("review"), "config_id", "rule_id", F.col("exec_status").alias("engine_status"))


def focuses_from_issues(issue_rows: DataFrame) -> DataFrame:
    """Issues (with basis) as focuses of the knowledge-base source."""
    titles = F.filter(F.transform("basis_details", lambda d: d["title"]), lambda t: t != "")
    policy = F.when(F.size(titles) > 0, F.concat(F.lit("制度依据："), F.array_join(titles, " / ")))
    template = F.when(F.length("basis_template") > 0, F.concat(F.lit("范本依据："), "basis_template"))
    rule = F.when(F.length("source_rule_name") > 0, F.concat(F.lit("规则："), "source_rule_name"))
    basis = F.coalesce(F.nullif(F.concat_ws("；", policy, template, rule), F.lit("")), F.lit("制度底座综合校验结果"))
    return issue_rows.select("task_id", F.concat(F.lit("kb_"), "issue_id").alias("focus_id"), F.col("problem").alias("title"), F.lit("knowledge_base_rule_check").alias("focus_source"),
                             X.severity_to_risk("severity").alias("risk_level"), F.concat(F.lit("制度底座命中："), "problem").alias("reason"),
                             F.coalesce(F.nullif("clause_location", F.lit("")), F.lit("制度底座定位")).alias("location"), "confidence", F.coalesce(titles, F.array().cast("array<string>")).alias("depends_on"),
                             basis.alias("basis"), F.col("suggestion").alias("review"), F.col("source_rule_id").alias("rule_id"), F.lit("knowledge_base_hit").alias("engine_status"))


def focus_dedupe(focuses: DataFrame) -> DataFrame:
    """Most confident per (title, clause set, source); ordered by source, risk text, confidence, title; renumbered."""
    f = focuses.withColumn("_ids", F.array_join(F.array_sort("clause_ids"), "\x1f"))
    best = O.first_by(f, ["task_id", "title", "_ids", "focus_source"], [-F.col("confidence"), F.col("ord")])
    rank = F.coalesce(F.try_element_at(X.literal_map(P.FOCUS_SOURCE_RANK), F.col("focus_source")), F.lit(9))
    # risk is ordered as text; the source rank leads the order, so it also serves as the chunk
    best = best.withColumn("_rank", rank)
    best = O.numbered(best, ["task_id"], ["_rank", "risk_level", -F.col("confidence"), "title", "ord"], "ord2", F.col("_rank"))
    return best.withColumn("ord", F.col("ord2")).withColumn("focus_id", F.format_string("audit_%03d", "ord")).drop("_ids", "_rank", "ord2")


def generate_focuses(rule_focuses: DataFrame, candidates: DataFrame | None, relations: DataFrame) -> DataFrame:
    """Rule focuses, then model focuses, then relation fallbacks; deduped and renumbered."""
    step = 1 << 40
    parts = [rule_focuses.select(*FOCUS_COLUMNS)]
    for i, d in enumerate([candidates, relations], start=1):
        if d is not None:
            parts.append(d.select(*FOCUS_COLUMNS).withColumn("ord", F.col("ord") + F.lit(i * step)))
    return focus_dedupe(reduce(DataFrame.unionByName, parts))


def merge_by_id(key: str, *dfs: DataFrame) -> DataFrame:
    """Ordered union; the first table that holds an id wins."""
    cols = dfs[0].columns
    u = reduce(DataFrame.unionByName, [d.select(*cols).withColumn("_src", F.lit(i)) for i, d in enumerate(dfs)])
    return O.first_by(u, ["task_id", key], ["_src"]).drop("_src")


def clause_focus_links(clauses: DataFrame, focuses: DataFrame) -> DataFrame:
    e = focuses.select("task_id", "focus_id", "ord", F.explode("clause_ids").alias("clause_id"))
    g = e.groupBy("task_id", "clause_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "focus_id"))), lambda s: s["focus_id"]).alias("focus_ids"))
    return clauses.select("task_id", "clause_id").join(g, ["task_id", "clause_id"], "left").withColumn("focus_ids", F.coalesce("focus_ids", F.array().cast("array<string>")))


# --- verification -----------------------------------------------------------

ITEM_COLUMNS = ["task_id", "item_id", "name", "method", "status", "description", "clause_ids", "source", "config_id", "rule_id", "engine_status"]


def _item(item_id, name, method, status, description, clause_ids=None, source="model", config_id=None, rule_id=None, engine_status=None):
    lit = lambda v: v if not isinstance(v, (str, type(None))) else F.lit(v).cast("string")
    ids = clause_ids if clause_ids is not None else F.array().cast("array<string>")
    vals = [lit(item_id), lit(name), lit(method), lit(status), lit(description), ids, lit(source), lit(config_id), lit(rule_id), lit(engine_status)]
    return ["task_id", *[v.alias(n) for v, n in zip(vals, ITEM_COLUMNS[1:])]]


def verify_required(tasks: DataFrame, clauses: DataFrame, labels=P.VERIFY_REQUIRED) -> DataFrame:
    t = tasks.select("task_id").distinct().join(last_by_label(clauses, labels), "task_id", "left")
    rows = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(v).alias("label")) for i, v in enumerate(labels, start=1)])
    t = t.select("task_id", "by_label", F.explode(rows).alias("r")).withColumn("c", F.try_element_at("by_label", F.col("r.label")))
    ok = F.col("c").isNotNull()
    text = F.when(ok, F.concat(F.lit("已识别到 "), "r.label", F.lit("，并建立了原文证据映射。"))).otherwise(F.concat(F.lit("未识别到 "), "r.label", F.lit("。建议回看合同原文并人工复核是否缺失。")))
    return t.select(*_item(F.format_string("verify_required_%03d", "r.i"), F.concat("r.label", F.lit("完整性校验")), "条款识别 / 原文证据定位", F.when(ok, "pass").otherwise("fail"), text,
                           F.when(ok, F.array("c.clause_id")).otherwise(F.array().cast("array<string>"))))


def verify_keywords(clauses: DataFrame, words: dict = P.VERIFY_KEYWORDS) -> DataFrame:
    c = clauses.where(F.col("core_label").isin(list(words)))
    words_of = F.expr(f"map({', '.join(f'{X.sql_lit(k)}, {X.sql_lit(w)}' for k, w in words.items())})")
    hits = F.filter(F.try_element_at(words_of, F.col("core_label")), lambda w: F.contains("raw_text", w))
    c = c.withColumn("hits", hits)
    text = F.concat(F.lit("命中关键词："), F.when(F.size("hits") > 0, F.array_join("hits", "、")).otherwise("未命中核心关键词"), F.lit("。"))
    return c.select(*_item(F.concat(F.lit("verify_keyword_"), "clause_id"), F.concat("label", F.lit("关键词一致性校验")), "关键词命中 / 语义对照", F.when(F.size("hits") >= 2, "pass").otherwise("warning"), text, F.array("clause_id")))


def verify_confidence(clauses: DataFrame, below: float = 0.65) -> DataFrame:
    c = clauses.where(F.col("confidence") < below).groupBy("task_id").agg(F.count(F.lit(1)).alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("sort_order", "clause_id"))), lambda s: s["clause_id"]).alias("ids"))
    return c.select(*_item("verify_low_confidence", "低置信度项目复核提示", "置信度阈值检查", "warning", F.format_string("发现 %d 条低置信度条款，建议重点复核。", "n"), F.col("ids")))


def verify_external(focuses: DataFrame) -> DataFrame:
    f = focuses.where(F.col("risk_level") == "pending_verification")
    n = f.groupBy("task_id").agg(F.count(F.lit(1)).alias("n"))
    ids = f.select("task_id", F.explode("clause_ids").alias("c")).groupBy("task_id").agg(F.array_sort(F.collect_set("c")).alias("ids"))
    j = n.join(ids, "task_id", "left")
    return j.select(*_item("verify_external_dependencies", "外部数据依赖检查", "关注事项依赖分析", "external_pending", F.format_string("发现 %d 项关注事项需要结合外部数据进一步核验。", "n"),
                           F.coalesce("ids", F.array().cast("array<string>")), "external_dependency"))


def verify_structure(sections: DataFrame) -> DataFrame:
    s = sections.groupBy("task_id").agg(F.count(F.lit(1)).alias("n"))
    return s.select(*_item("verify_structure", "章节结构校验", "章节识别 / 页码映射", "pass", F.format_string("共识别 %d 个章节，并完成了顺序和页码映射。", "n")))


ENGINE_METHOD = "规则引擎联调"


def verify_engine(status: DataFrame, matches: DataFrame, missing: DataFrame, unmatched: DataFrame, clauses: DataFrame) -> DataFrame:
    """Engine state, summaries of missing and unbound rules, and one row per match."""
    n = matches.groupBy("task_id").agg(F.count(F.lit(1)).alias("n_hits"))
    s = status.join(n, "task_id", "left").na.fill(0, ["n_hits"])
    st = F.col("status")
    fixed = {"no_rule_configs": ("verify_rule_engine_no_config", "规则引擎校验未启用", "当前没有启用任何规则校验配置，本轮未执行规则引擎校验。"),
             "not_connected": ("verify_rule_engine_not_connected", "规则引擎未接入", "规则引擎当前未接入，本轮仅使用模型抽取和基础校验结果。"),
             "engine_error": ("verify_rule_engine_error", "规则引擎调用失败", "规则引擎调用失败，本轮未能完成规则校验。")}
    pick = lambda i, other: F.coalesce(*[F.when(st == k, F.lit(v[i])) for k, v in fixed.items()], other)
    hit = F.col("n_hits") > 0
    text = pick(2, F.when(hit, F.format_string("规则引擎已执行，本轮共命中 %d 条规则。", "n_hits")).otherwise("规则引擎已执行，当前未命中已配置规则。"))
    head = s.select(*_item(pick(0, F.lit("verify_rule_engine_summary")), pick(1, F.lit("规则引擎执行结果")), ENGINE_METHOD, F.when(st.isin(list(fixed)) | hit, "warning").otherwise("pass"), text, source="rule_engine", engine_status=st))
    ran = s.where(st.isin("ok", "ok_with_warnings")).select("task_id")
    gone = missing.agg(F.count(F.lit(1)).alias("n"), O.joined_list(F.concat("name", F.lit(" ("), "rule_id", F.lit(")")), ["position"], "；").alias("t")).where(F.col("n") > 0)
    miss = ran.join(F.broadcast(gone)).select(*_item("verify_rule_engine_missing_configured_rules", "规则配置未在引擎中生效", "规则配置 / 引擎规则目录比对", "warning",
        F.format_string("发现 %d 条规则配置在当前规则目录中不存在：%s。", "n", "t"), source="rule_engine", engine_status="missing_configured_rules"))
    u = unmatched.groupBy("task_id").agg(F.count(F.lit(1)).alias("n"), O.joined_list(F.coalesce(F.nullif("rule_name", F.lit("")), "rule_id", F.lit("未命名规则")), ["match_no"], "；").alias("t"))
    unb = u.select(*_item("verify_rule_engine_unmatched_rules", "规则引擎返回了未绑定的规则", "规则返回映射检查", "warning",
        F.format_string("规则引擎返回了 %d 条未绑定到当前审计配置的规则：%s。", "n", "t"), source="rule_engine", engine_status="unmatched_returned_rules"))
    m = O.numbered(matches, ["task_id"], ["match_no"], "_no")
    kept = _kept_ids(m.select("task_id", "_no", F.col("evidence_clause_ids").alias("ids")), ["task_id", "_no"], clauses)
    m = m.join(kept, ["task_id", "_no"], "left")
    rows = m.select(*_item(F.format_string("verify_rule_engine_%03d", "_no"), F.coalesce(F.nullif("rule_name", F.lit("")), "rule_id", F.lit("规则引擎命中")), "规则引擎校验", F.when(F.lower("severity").isin("low", "medium"), "warning").otherwise("fail"),
        F.coalesce(F.nullif("reason", F.lit("")), F.lit("规则引擎命中了一个待复核条件。")), F.coalesce("clause_ids", F.array().cast("array<string>")), "rule_engine", F.col("config_id"), F.col("rule_id"), "hit"))
    return reduce(DataFrame.unionByName, [head, miss, unb, rows])


def verify_issues(issue_rows: DataFrame) -> DataFrame:
    return issue_rows.select(*_item(F.concat(F.lit("kb_verify_"), "issue_id"), F.col("problem"), "knowledge_base / template_compare / rule_library", X.severity_to_status("severity"), F.col("suggestion"),
                                    source="knowledge_base", rule_id=F.col("source_rule_id"), engine_status="knowledge_base_hit"))


def verification(parts: list[DataFrame], narratives: DataFrame | None = None) -> DataFrame:
    """Union of all items; a narrative replaces description and method of its item."""
    v = reduce(DataFrame.unionByName, [p.select(*ITEM_COLUMNS) for p in parts])
    if narratives is None:
        return v
    n = narratives.select("task_id", "item_id", F.nullif("description", F.lit("")).alias("_d"), F.nullif("method", F.lit("")).alias("_m"))
    j = v.join(n, ["task_id", "item_id"], "left")
    return j.withColumn("description", F.trim(F.coalesce("_d", "description"))).withColumn("method", F.trim(F.coalesce("_m", "method"))).select(*ITEM_COLUMNS)


def confidence_overview(tasks: DataFrame, sections: DataFrame, clauses: DataFrame, focuses: DataFrame) -> DataFrame:
    s = sections.groupBy("task_id").agg(F.round(F.avg("confidence"), 6).alias("s"))
    c = clauses.groupBy("task_id").agg(F.round(F.avg("confidence"), 6).alias("c"), F.count_if("need_review").alias("n_review"))
    f = focuses.groupBy("task_id").agg(F.round(F.avg("confidence"), 6).alias("f"), F.count_if(F.col("risk_level") == "pending_verification").alias("n_pending"))
    j = tasks.select("task_id").distinct().join(s, "task_id", "left").join(c, "task_id", "left").join(f, "task_id", "left").na.fill(0)
    a, b, d = P.CONFIDENCE_WEIGHTS
    return j.select("task_id", F.round(F.col("s") * a + F.col("c") * b + F.col("f") * d, 2).alias("overall"), F.round("s", 2).alias("sections"), F.round("c", 2).alias("clauses"), F.round("f", 2).alias("audit"),
                    (F.col("n_review") + F.col("n_pending")).alias("warnings"))


def task_status(tasks: DataFrame, page_warnings: DataFrame, clauses: DataFrame) -> DataFrame:
    w = page_warnings.where(F.col("warning").isNotNull()).select("task_id").distinct().withColumn("w", F.lit(True))
    c = clauses.groupBy("task_id").agg(F.bool_or("need_review").alias("r"))
    j = tasks.select("task_id").distinct().join(w, "task_id", "left").join(c, "task_id", "left")
    return j.select("task_id", F.when(F.coalesce("w", "r", F.lit(False)) | F.coalesce("r", F.lit(False)), "needs_review").otherwise("completed").alias("status"))


def agent_step_log(tasks: DataFrame, counts: dict[str, DataFrame], warnings: DataFrame | None = None) -> DataFrame:
    """One row per stage with the number of rows it produced; measured counts, no fixed durations."""
    names = list(counts)
    parts = [df.groupBy("task_id").agg(F.count(F.lit(1)).alias("n")).withColumn("stage_no", F.lit(i)) for i, (_, df) in enumerate(counts.items(), start=1)]
    u = reduce(DataFrame.unionByName, parts)
    stages = F.array(*[F.struct(F.lit(i).alias("stage_no"), F.lit(n).alias("stage")) for i, n in enumerate(names, start=1)])
    t = tasks.select("task_id").distinct().select("task_id", F.explode(stages).alias("s")).select("task_id", "s.*")
    j = t.join(u, ["task_id", "stage_no"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    st = F.lit("success")
    if warnings is not None:
        j = j.join(warnings.select("task_id", "stage", F.lit(True).alias("_w")).distinct(), ["task_id", "stage"], "left")
        st = F.when(F.col("_w"), "warning").otherwise("success")
    return j.select("task_id", F.format_string("step_%03d", "stage_no").alias("step_id"), F.col("stage").alias("name"), st.alias("status"), F.col("n").alias("n_rows"))
