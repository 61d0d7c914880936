"""Clauses, key facts, classification and the contract schema."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import params as P
from ..functions import ordered as O
from ..functions import text as X
from ..session import stage
from .structure import coerce_page, locate_block, nearest_section, page_chunk, task_pages


def order_chunk(c="sort_order") -> Column:
    return F.floor(F.col(c) / O.CHUNK)


def nonblank(c) -> Column:
    return F.nullif(X.clean_lines(c), F.lit(""))


# --- clauses ----------------------------------------------------------------

def build_clauses(items: DataFrame, blocks: DataFrame, sections: DataFrame, text_chars: int | None = None) -> DataFrame:
    """Candidate rows to clauses.

    items: task_id, ord, label, title, core_label, label_source, raw_text, summary, page,
    confidence, references (array or null), need_review.
    """
    c = items.withColumn("label", F.coalesce(nonblank("label"), nonblank("title"))).where(F.col("label").isNotNull())
    c = c.withColumn("raw_text", X.compact_summary("raw_text", text_chars)).withColumn("clause_id", F.format_string("clause_%03d", "ord"))
    # made where it is needed, so that a text travels once
    summary = X.compact_summary(F.coalesce(nonblank("summary"), F.nullif("raw_text", F.lit("")), F.col("label")), 80)
    c = coerce_page(c, blocks, "clause_id", "page", F.coalesce(F.nullif("raw_text", F.lit("")), summary), task_pages(blocks, sections))
    c = c.withColumn("core_label", X.core_label(F.coalesce(nonblank("core_label"), F.col("label")))).withColumn("summary", summary)
    refs = F.coalesce(F.when(F.size("references") > 0, F.col("references")), X.cross_references("raw_text"))
    return c.select(
        "task_id", "clause_id", F.substring("label", 1, 80).alias("label"), "core_label",
        X.label_source("label_source", "label", "core_label").alias("label_source"),
        F.coalesce(nonblank("title"), F.substring("label", 1, 80)).alias("title"), "summary",
        F.coalesce(F.nullif("raw_text", F.lit("")), F.col("summary")).alias("raw_text"), "page",
        X.clamp_confidence("confidence").alias("confidence"), F.col("ord").alias("sort_order"), "section_title",
        refs.alias("references"), X.to_bool("need_review").alias("need_review"))


def anchor_clauses(blocks: DataFrame, sections: DataFrame | None = None, words: dict = P.ANCHOR_KEYWORDS, text_chars: int | None = None) -> DataFrame:
    """Per label the block with most distinct keywords (longer text breaks near ties, first wins).

    The dictionary is folded into the row expression; only scoring labels are
    exploded, and the maximum is a combinable aggregate.
    """
    b = blocks.select("task_id", "page", "block_no", "block_id", X.clean_lines("text").alias("text")).where(F.length("text") > 0)
    count = lambda keys: " + ".join(f"CAST(contains(text, {X.sql_lit(w)}) AS INT)" for w in keys)
    scored = ", ".join(f"named_struct('label_no', {i}, 'label', {X.sql_lit(label)}, 'hits', {count(keys)})" for i, (label, keys) in enumerate(words.items()))
    b = b.select("*", F.explode(F.expr(f"filter(array({scored}), s -> s.hits > 0)")).alias("s"))
    weight = F.col("s.hits") * 20 + F.floor(F.least(F.length("text"), F.lit(200)) / 20)
    best = b.groupBy("task_id", "s.label_no", "s.label").agg(F.min_by(F.struct("page", "block_id", "text"), F.struct((-weight).alias("w"), "page", "block_no")).alias("b"))
    c = O.numbered(best, ["task_id"], ["label_no"], "sort_order")
    core = F.when(F.col("label").isin(P.CLAUSE_LABELS), F.col("label")).otherwise(F.lit(P.DEFAULT_LABEL))
    c = c.select("task_id", F.format_string("clause_%03d", "sort_order").alias("clause_id"), "label", core.alias("core_label"), F.lit("core").alias("label_source"),
                 F.col("label").alias("title"), X.compact_summary("b.text", 80).alias("summary"), X.compact_summary("b.text", text_chars).alias("raw_text"),
                 "b.page", F.lit(0.5).alias("confidence"), "sort_order", X.cross_references("b.text").alias("references"), F.lit(True).alias("need_review"), "b.block_id")
    return c if sections is None else nearest_section(c, sections)


def clause_dedupe(clauses: DataFrame) -> DataFrame:
    """One clause per (label or core label, page): most confident, then longest; renumbered."""
    k = F.when(F.col("label_source") == "agent_discovered", F.col("label")).otherwise(F.col("core_label"))
    c = clauses.withColumn("_k", k)
    best = O.first_by(c, ["task_id", "_k", "page"], [-F.col("confidence"), -F.length("raw_text"), F.col("sort_order")])
    best = O.numbered(best, ["task_id"], ["page", "sort_order", "label", "_k"], "_no", page_chunk())
    return best.withColumn("sort_order", F.col("_no")).withColumn("clause_id", F.format_string("clause_%03d", "_no")).drop("_k", "_no")


# --- facts ------------------------------------------------------------------

FACT_COLUMNS = ["task_id", "label", "value", "page", "confidence", "evidence_id", "notes"]


def leading_pages(blocks: DataFrame, n: int) -> DataFrame:
    pages = blocks.select("task_id", "page").distinct()
    return O.top_k(pages, ["task_id"], ["page"], n, "page_pos")


def facts_from_pages(blocks: DataFrame, n_pages: int | None = None, n_blocks: int | None = None) -> DataFrame:
    """Contract numbers found in the blocks (or the leading ones, of the leading pages); first sight of each value."""
    b = blocks if n_pages is None else blocks.join(leading_pages(blocks, n_pages), ["task_id", "page"])
    b = b if n_blocks is None else O.top_k(b, ["task_id", "page"], ["block_no"], n_blocks, "_pos")
    # what a number needs stands in the text as given, too; then exploded, not filtered: a filter on a computed column computes it twice
    b = b.where(X.may_hold_number("text")).select("task_id", "page", "block_no", "block_id", F.explode(F.array_compact(F.array(X.contract_number("text")))).alias("value"))
    f = O.first_by(b.select("task_id", "value", "page", "block_no", "block_id"), ["task_id", "value"], ["page", "block_no"])
    return f.select("task_id", F.lit("合同编号").alias("label"), "value", "page", F.lit(0.88).alias("confidence"), F.col("block_id").alias("evidence_id"),
                    F.lit("基于 OCR 原文块直接提取。").alias("notes"), (F.col("page") * 1000000 + F.col("block_no")).alias("ord"))


STRUCTURED_FACTS = [("contractNumber", "合同编号", None), ("serviceScope", "服务内容", "服务/采购/工程内容"), ("totalAmount", "合同金额", "合同金额"),
                    ("paymentTrigger", "付款条件", "付款条件"), ("implementationDays", "履约期限", "履约期限")]
SUMMARY_FACTS = {"合同基本信息": "主体摘要", "甲乙方信息": "甲乙方信息", "付款条件": "付款条件", "履约期限": "履约期限", "验收标准": "验收标准",
                 "争议解决": "争议解决", "账户信息": "账户信息", "服务/采购/工程内容": "服务内容"}


def facts_from_clauses(clauses: DataFrame) -> DataFrame:
    """Structured fields, party and amount patterns and summaries as facts; first sight of (label, value, page)."""
    key = F.coalesce(F.nullif("core_label", F.lit("")), F.col("label"))
    c = clauses.withColumn("_key", key)
    s = lambda label, value, notes=None: F.struct(label.alias("label"), X.clean_lines(value).alias("value"), F.lit(notes).cast("string").alias("notes"))
    given = []
    for field, label, only in STRUCTURED_FACTS:
        v = F.try_element_at("structured_fields", F.lit(field))
        given.append(F.when((F.col("_key") == only) if only else F.lit(True), s(F.lit(label), v, "来自条款结构化字段。")))
    is_party = F.col("_key") == "甲乙方信息"
    group = lambda hit, i: F.regexp_extract(hit, P.PARTY_PATTERN, i)
    unnamed = s(F.lit("主体摘要"), F.col("summary"), "主体名称建议人工复核。")
    # the text is searched once, its hits are taken apart
    named = X.bound(F.regexp_extract_all("raw_text", F.lit(P.PARTY_PATTERN), F.lit(0)), lambda hits: F.when(F.size(hits) == 0, F.array(unnamed)).otherwise(F.transform(hits, lambda h: s(group(h, 1), group(h, 2)))))
    parties = F.when(is_party, named).otherwise(F.array())
    amount = X.bound(F.regexp_extract("raw_text", P.AMOUNT_PATTERN, 1), lambda x: F.when(x != "", x).otherwise(F.col("summary")))
    label_of = F.create_map(*[F.lit(v) for kv in SUMMARY_FACTS.items() for v in kv])
    rest = F.array(
        F.when(F.col("_key") == "合同基本信息", s(F.lit("合同编号"), X.contract_number("raw_text"))),
        F.when(F.col("_key") == "合同金额", s(F.lit("合同金额"), amount)),
        F.when(F.col("_key").isin(list(SUMMARY_FACTS)), s(F.try_element_at(label_of, F.col("_key")), F.col("summary"))))
    c = c.select("task_id", "clause_id", "page", "confidence", "sort_order", F.posexplode(F.concat(F.array(*given), parties, rest)).alias("seq", "s"))
    c = c.where((F.length("s.label") > 0) & (F.length("s.value") > 0))
    c = c.select("task_id", "s.label", "s.value", "page", "confidence", "clause_id", "s.notes", (F.col("sort_order") * 100000 + F.col("seq")).alias("ord"))
    return O.first_by(c, ["task_id", "label", "value", "page"], ["ord"])


def build_facts(items: DataFrame, blocks: DataFrame) -> DataFrame:
    """Candidate facts: label, shortened value, valid page, evidence block.

    items: task_id, fact_key, ord, label, value, evidence_text, page, confidence, notes.
    """
    # a value of nothing but blanks is the only one that comes out empty; the test of the given value is the cheaper one
    f = items.withColumn("label", X.clean_lines("label")).where((F.length("label") > 0) & (F.length(X.strip("value")) > 0))
    f = f.withColumn("value", X.fact_value(F.col("label"), X.clean_lines("value")))
    probe = F.coalesce(nonblank("evidence_text"), F.col("value"))
    f = coerce_page(f, blocks, "fact_key", "page", probe)  # written there
    ev = locate_block(f, blocks, "fact_key", probe)
    f = f.join(ev, ["task_id", "fact_key"], "left")
    return f.select("task_id", "label", "value", "page", X.clamp_confidence("confidence").alias("confidence"), "evidence_id", nonblank("notes").alias("notes"), "ord")


def fact_dedupe(facts: DataFrame) -> DataFrame:
    return numbered_facts(O.first_by(facts, ["task_id", "label", "value", "page"], [-F.col("confidence"), F.col("ord")]))


def numbered_facts(facts: DataFrame) -> DataFrame:
    """Distinct facts in the order of page, label and value, with their number as order and id."""
    best = O.numbered(facts, ["task_id"], ["page", "label", "value"], "_no", page_chunk())
    return best.withColumn("ord", F.col("_no")).withColumn("fact_id", F.format_string("fact_%03d", "_no")).drop("_no")


def required_facts(facts: DataFrame, tasks: DataFrame, defaults=P.OVERVIEW_DEFAULTS) -> DataFrame:
    """Add a placeholder row per overview label the task lacks; one label set per task decides."""
    seen = facts.groupBy("task_id").agg(F.collect_set(F.when(F.col("label").isin([d for d, _ in defaults]), F.col("label"))).alias("_seen"))
    t = tasks.select("task_id").distinct().join(seen, "task_id", "left")
    rows = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(a).alias("label"), F.lit(b).alias("value")) for i, (a, b) in enumerate(defaults)])
    lacking = F.filter(rows, lambda r: ~F.array_contains(F.coalesce("_seen", F.array().cast("array<string>")), r["label"]))
    p = t.select("task_id", F.explode(lacking).alias("r")).select(
        "task_id", "r.label", "r.value", F.lit(1).cast("long").alias("page"), F.lit(0.2).alias("confidence"), F.lit(None).cast("string").alias("evidence_id"),
        F.lit("模型未稳定识别到该字段。").alias("notes"), (F.lit(1 << 50) + F.col("r.i")).alias("ord"))
    return facts.select(*p.columns).unionByName(p)


def requested_fields(configs: DataFrame) -> DataFrame:
    """Distinct fields asked by enabled rule configurations, first description kept."""
    r = configs.where(F.col("enabled") & (F.col("config_type") == "rule_check"))
    r = r.select("position", F.posexplode("extract_fields").alias("i", "e")).select(
        X.clean_lines("e.label").alias("label"), X.clean_lines("e.description").alias("description"), (F.col("position") * 1000 + F.col("i")).alias("ord"))
    return O.first_by(r.where(F.length("label") > 0), ["label"], ["ord"])


def extract_key_facts(blocks: DataFrame, clauses: DataFrame, overview: DataFrame | None = None, candidates: DataFrame | None = None) -> DataFrame:
    """Overview, page, clause and candidate facts merged; missing overview labels filled.

    Of equal (label, value, page) the most confident one stays, then overview before page and clause facts before candidates.  The
    sources are told apart by a tier, so rows are merged once and numbered once, from a written table.
    """
    shift = 1 << 42
    tiered = lambda df, tier, ord_: df.select(*FACT_COLUMNS, F.lit(tier).alias("_tier"), ord_.alias("ord"))
    allf = tiered(facts_from_pages(blocks), 1, F.col("ord")).unionByName(
        tiered(facts_from_clauses(clauses).withColumnRenamed("clause_id", "evidence_id"), 1, F.col("ord") + F.lit(shift)))
    if overview is not None:
        allf = allf.unionByName(tiered(overview, 0, F.col("ord")))
    if candidates is not None:
        allf = allf.unionByName(tiered(candidates, 2, F.col("ord")))
    merged = stage(O.first_by(allf, ["task_id", "label", "value", "page"], [-F.col("confidence"), F.col("_tier"), F.col("ord")]).drop("_tier"))
    return numbered_facts(required_facts(merged, blocks.select("task_id")))


def fact_map(facts: DataFrame) -> DataFrame:
    f = facts.where(F.length("value") > 0)
    return f.groupBy("task_id", "label").agg(F.min_by("value", "ord").alias("value"))


# --- classification ---------------------------------------------------------

def classify_contract(tasks: DataFrame, sections: DataFrame, facts: DataFrame, clauses: DataFrame, words: dict = P.CATEGORY_KEYWORDS,
                      n_sections: int | None = None, n_facts: int | None = None, n_clauses: int | None = None, n_summaries: int | None = None) -> DataFrame:
    """Category whose keywords occur most often in titles, facts and clauses (all, or the leading ones).

    A keyword is in the joined text when it is in one of its pieces, so each
    piece gives a bit mask and the masks are OR-ed: no text is concatenated.
    """
    flat = [w for keys in words.values() for w in keys]
    first = lambda df, n, order, chunk: df.withColumn("_p", F.lit(0)) if n is None else _leading(df, n, order, chunk)
    pieces = [tasks.select("task_id", F.col("file_name").alias("t"))]
    pieces.append(first(sections, n_sections, ["sort_order"], order_chunk()).select("task_id", F.col("title").alias("t")))
    pieces.append(first(facts, n_facts, ["ord"], order_chunk("ord")).select("task_id", F.concat_ws("\n", "label", "value").alias("t")))
    c = first(clauses, n_clauses, ["sort_order"], order_chunk()) if n_summaries is None else _leading(clauses, n_clauses, ["sort_order"], order_chunk())
    pieces.append(c.select("task_id", F.concat_ws("\n", "title", F.col("summary") if n_summaries is None else F.when(F.col("_p") <= n_summaries, F.col("summary"))).alias("t")))
    allp = reduce(DataFrame.unionByName, pieces)
    m = allp.select("task_id", X.searched("t", flat).alias("t")).select("task_id", X.word_bits("t", flat).alias("m")).groupBy("task_id").agg(F.bit_or("m").alias("m"))
    at, cats = 0, []
    for i, (name, keys) in enumerate(words.items()):
        mask = ((1 << len(keys)) - 1) << at
        cats.append(F.struct(F.expr(f"bit_count(m & {mask}L)").alias("score"), F.lit(-i).alias("first"), F.lit(name).alias("category"), X.first_words("m", keys, 6, at).alias("evidence")))
        at += len(keys)
    r = m.withColumn("b", F.array_max(F.array(*cats)))
    none = F.col("b.score") == 0
    return r.select("task_id", F.when(none, P.DEFAULT_CATEGORY).otherwise(F.col("b.category")).alias("category"),
                    F.when(none, 0.3).otherwise(0.55).alias("confidence"), F.when(none, F.array().cast("array<string>")).otherwise(F.col("b.evidence")).alias("evidence"),
                    F.lit("keyword").alias("method"))


def classify_merge(model: DataFrame, keyword: DataFrame) -> DataFrame:
    """Model verdict when there is one, normalised; keyword verdict otherwise."""
    m = model.select("task_id", F.coalesce("category", F.lit(P.DEFAULT_CATEGORY)).alias("mc"), F.coalesce(F.col("confidence").try_cast("double"), F.lit(0.0)).alias("mf"),
                     F.filter(F.transform("evidence", X.strip), lambda x: F.length(x) > 0).alias("me"))
    j = keyword.join(m, "task_id", "left")
    has = F.col("mc").isNotNull()
    pick = lambda a, b: F.when(has, F.col(a)).otherwise(F.col(b))
    return j.select("task_id", pick("mc", "category").alias("category"), pick("mf", "confidence").alias("confidence"), pick("me", "evidence").alias("evidence"),
                    F.when(has, "llm").otherwise(F.col("method")).alias("method"))


# --- schema -----------------------------------------------------------------

def contract_schema(facts: DataFrame, clauses: DataFrame, aliases: dict = P.SCHEMA_ALIASES, snippet_chars: int | None = None) -> DataFrame:
    """Long table (task_id, field, value): first fact whose label has an alias, else a snippet of the first clause.

    Each text is searched once, for a bit mask of its fields; a task keeps the first text of each field, and snippets are cut from these only.
    """
    no = {k: i for i, k in enumerate(aliases)}
    bits = lambda c: F.expr("(" + " | ".join(f"IF({' OR '.join(f'contains({c}, {X.sql_lit(w)})' for w in ws)}, {1 << no[k]}L, 0L)" for k, ws in aliases.items()) + ")")
    f = facts.withColumn("value", X.strip("value"))
    f = f.select("task_id", F.lit(0).alias("tier"), F.col("ord").cast("long").alias("ord"), F.lit(None).cast("string").alias("title"), "value", F.lit(None).cast("string").alias("raw"), F.lit(False).alias("same"),
                 F.when(F.length("value") > 0, bits("label")).otherwise(0).alias("bits"))
    # a text equal to the summary is not searched or carried twice
    same = F.coalesce(F.col("raw_text") == F.col("summary"), F.lit(False))
    c = clauses.select("task_id", F.lit(1).alias("tier"), F.col("sort_order").cast("long").alias("ord"), "title", F.col("summary").alias("value"), F.when(~same, F.col("raw_text")).alias("raw"), same.alias("same"))
    c = c.withColumn("hay", X.searched(F.concat_ws("\n", "title", "value", "raw"), [w for ws in aliases.values() for w in ws])).withColumn("bits", bits("hay")).drop("hay")
    u = f.unionByName(c)  # rows without a bit are left to the aggregate: as a filter the test would be pushed into the scan and made twice
    first = lambda i: F.min_by(F.struct("tier", "title", "value", "raw", "same"), F.when(F.col("bits").bitwiseAND(1 << i) != 0, F.struct("tier", "ord")))
    rows = u.groupBy("task_id").agg(*[first(i).alias(f"f{i}") for i in no.values()])
    rows = rows.select("task_id", F.explode(F.array(*[F.struct(F.lit(k).alias("field"), F.col(f"f{i}").alias("t")) for k, i in no.items()])).alias("r")).where(F.col("r.t").isNotNull())
    rows = rows.select("task_id", "r.field", "r.t.tier", "r.t.value", F.concat_ws("\n", "r.t.title", "r.t.value", F.when(F.col("r.t.same"), F.col("r.t.value")).otherwise(F.col("r.t.raw"))).alias("hay"))
    # position of the first alias (in alias order) that occurs
    at = "CASE field " + " ".join(f"WHEN {X.sql_lit(k)} THEN coalesce({', '.join(f'nullif(instr(hay, {X.sql_lit(w)}), 0)' for w in ws)})" for k, ws in aliases.items()) + " END"
    cut = X.strip(F.substr("hay", F.expr(at), *([] if snippet_chars is None else [F.lit(snippet_chars)])))
    return rows.select("task_id", "field", F.when(F.col("tier") == 0, F.col("value")).otherwise(cut).alias("value"))


def schema_fields(schema: DataFrame, tasks: DataFrame) -> DataFrame:
    """One row per task with a map of the filled fields (at most one entry per known field)."""
    m = schema.groupBy("task_id").agg(F.map_from_entries(F.collect_list(F.struct("field", "value"))).alias("fields"))
    return tasks.select("task_id").distinct().join(m, "task_id", "left").withColumn("fields", F.coalesce("fields", F.create_map().cast("map<string,string>")))


def _leading(df: DataFrame, n: int | None, order: list, chunk: Column) -> DataFrame:
    """Rows with their position; the first n only, if there is an n."""
    out = O.numbered(df, ["task_id"], order, "_p", chunk)
    return out if n is None else out.where(F.col("_p") <= n)


def _cut(c, n: int | None) -> Column:
    return X.col(c) if n is None else F.substring(X.col(c), 1, n)


def contract_profile(categories: DataFrame, fields: DataFrame, clauses: DataFrame, n_clauses: int | None = None, chars: int | None = None) -> DataFrame:
    """Text profile of a contract: category, subject, payment, clauses (all, or the leading ones)."""
    c = clauses.withColumn("_p", F.col("sort_order")) if n_clauses is None else _leading(clauses, n_clauses, ["sort_order"], order_chunk())
    lines = c.groupBy("task_id").agg(O.joined_list(_profile_line(chars), ["_p"], "\n").alias("lines"))
    j = categories.join(fields, "task_id").join(lines, "task_id", "left")
    return j.select("task_id", F.concat_ws("\n", *_profile_head(), "lines").alias("profile"))


def _profile_line(chars: int | None = None) -> Column:
    return F.concat(F.lit("- "), "title", F.lit(": "), _cut(F.coalesce(F.nullif("summary", F.lit("")), F.col("raw_text")), chars))


def _profile_head() -> list[Column]:
    get = lambda k: F.coalesce(F.nullif(F.try_element_at("fields", F.lit(k)), F.lit("")), F.lit("未提取"))
    return [F.concat(F.lit("合同类别："), "category"), F.concat(F.lit("合同标的："), get("contract_subject")), F.concat(F.lit("服务内容："), get("contract_subject")),
            F.concat(F.lit("付款条款："), get("payment_terms")), F.lit("关键条款：")]


def profile_flags(categories: DataFrame, fields: DataFrame, clauses: DataFrame, words: dict = P.PROFILE_WORDS) -> DataFrame:
    """Names of the entries that have a word in contract_profile(), without that text.

    Its pieces are joined by line breaks, so a word that holds none lies inside one piece: each piece gives a bit mask, and masks are OR-ed.
    """
    flat = [w for ws in words.values() for w in ws]
    if any("\n" in w for w in flat):
        return contract_profile(categories, fields, clauses).select("task_id", X.all_keys("profile", words).alias("flags"))
    bits = F.expr("(" + " | ".join(f"IF({' OR '.join(f'contains(t, {X.sql_lit(w)})' for w in ws)}, {1 << i}L, 0L)" for i, ws in enumerate(words.values())) + ")")
    held = lambda df: df.select("task_id", bits.alias("b")).groupBy("task_id").agg(F.bit_or("b").alias("b"))
    head = categories.join(fields, "task_id").select("task_id", F.concat_ws("\n", *_profile_head()).alias("t"))
    lines = held(clauses.select("task_id", X.searched(_profile_line(), flat).alias("t"))).withColumnRenamed("b", "c")
    names = F.array_compact(F.array(*[F.when(F.col("m").bitwiseAND(1 << i) != 0, k) for i, k in enumerate(words)]))
    return head.select("task_id", bits.alias("b")).join(lines, "task_id", "left").select("task_id", F.col("b").bitwiseOR(F.coalesce("c", F.lit(0))).alias("m")).select("task_id", names.alias("flags"))


def candidate_titles(page_titles: DataFrame, sections: DataFrame, n_pages: int | None = None, n_sections: int | None = None, n_titles: int | None = None) -> DataFrame:
    """Distinct titles of the pages, then of the sections, in order (all, or the first ones of each and in all)."""
    p = _leading(page_titles, n_pages, ["page"], page_chunk()).select("task_id", F.col("title"), F.col("_p").alias("k"))
    s = _leading(sections, n_sections, ["sort_order"], order_chunk()).select("task_id", "title", (F.col("_p") + (1 << 40)).alias("k"))
    u = p.unionByName(s).where(F.length("title") > 0)
    d = u.groupBy("task_id", "title").agg(F.min("k").alias("k"))
    d = d if n_titles is None else O.top_k(d, ["task_id"], ["k"], n_titles, "_r")
    return d.groupBy("task_id").agg(O.joined_list("title", ["k"], "；").alias("titles"))


def model_context(facts: DataFrame, clauses: DataFrame, n_facts: int | None = None, n_clauses: int | None = None, n_summaries: int | None = None,
                  value_chars: int | None = None, summary_chars: int | None = None) -> DataFrame:
    """Fact and clause lines handed to an external classifier; limits, where it has any, are parameters."""
    f = _leading(facts, n_facts, ["ord"], order_chunk("ord"))
    v = F.coalesce(F.nullif(_cut(X.strip("value"), value_chars), F.lit("")), F.lit("空"))
    fl = f.groupBy("task_id").agg(O.joined_list(F.concat(F.lit("- "), "label", F.lit(": "), v), ["_p"], "\n").alias("fact_lines"))
    c = _leading(clauses, n_clauses, ["sort_order"], order_chunk())
    summary = _cut(F.coalesce(F.nullif(X.strip("summary"), F.lit("")), X.strip("raw_text")), summary_chars)
    line = F.concat(F.lit("- "), "title", F.lit(": "), summary)
    cl = c.groupBy("task_id").agg(O.joined_list(F.concat(F.lit("- "), "title"), ["_p"], "\n").alias("title_lines"),
                                  O.joined_list(line if n_summaries is None else F.when(F.col("_p") <= n_summaries, line), ["_p"], "\n").alias("summary_lines"))
    return fl.join(cl, "task_id", "full_outer")


# --- rule input -------------------------------------------------------------

ENTITIES = [("partyA", "甲方"), ("partyB", "乙方"), ("partySummary", "甲乙方信息"), ("subjectSummary", "主体摘要"), ("serviceContent", "服务内容"), ("contractAmount", "合同金额"),
            ("paymentTerms", "付款条件"), ("acceptanceTerms", "验收标准"), ("performanceTerm", "履约期限"), ("disputeTerms", "争议解决"), ("accountInfo", "账户信息")]
PRESENCE = [("hasPaymentClause", "付款条件"), ("hasAcceptanceClause", "验收标准"), ("hasBreachClause", "违约责任"), ("hasDisputeClause", "争议解决"), ("hasAccountClause", "账户信息")]


def rule_input(tasks: DataFrame, sections: DataFrame, clauses: DataFrame, facts: DataFrame) -> DataFrame:
    """One record per contract for the decision rules: contract, entities, fact map, derived flags.

    Only the known labels are folded, by combinable aggregates; the full child
    lists stay in their own tables (see ``export_results`` for the nested form).
    """
    label = F.coalesce(F.nullif("core_label", F.lit("")), F.col("label"))
    s = sections.groupBy("task_id").agg(F.count(F.lit(1)).alias("sectionCount"))
    c = clauses.groupBy("task_id").agg(F.count(F.lit(1)).alias("clauseCount"), *[F.bool_or(label == v).alias(k) for k, v in PRESENCE])
    known = [("contractNumber", "合同编号"), *ENTITIES]
    first = lambda v: X.null_if_missing(F.min_by(F.when(F.col("label") == v, F.col("value")), F.when((F.col("label") == v) & (F.length("value") > 0), F.col("ord"))))
    f = facts.groupBy("task_id").agg(*[first(v).alias(k) for k, v in known])
    j = tasks.select("task_id").distinct().join(s, "task_id", "left").join(c, "task_id", "left").join(f, "task_id", "left")
    yes = lambda k: F.coalesce(F.col(k), F.lit(False)).alias(k)
    return j.select(
        "task_id",
        F.struct("contractNumber", F.coalesce("sectionCount", F.lit(0)).alias("sectionCount"), F.coalesce("clauseCount", F.lit(0)).alias("clauseCount")).alias("contract"),
        F.struct(*[k for k, _ in ENTITIES]).alias("entities"),
        F.struct(F.col("contractNumber").isNotNull().alias("hasContractNumber"), *[yes(k) for k, _ in PRESENCE]).alias("derived"))


def cross_reference_rows(clauses: DataFrame) -> DataFrame:
    return clauses.where(F.size("references") > 0).select("task_id", "clause_id", "label", "page", "references")


def apply_draft_edits(clauses: DataFrame, edits: DataFrame) -> DataFrame:
    """Replace edited structured fields; rows without an edit keep their map."""
    j = clauses.join(edits.select("task_id", "clause_id", F.col("edited").alias("_e")), ["task_id", "clause_id"], "left")
    kept = F.map_filter("structured_fields", lambda k, v: ~F.array_contains(F.map_keys("_e"), k))
    return j.withColumn("structured_fields", F.when(F.col("_e").isNull(), F.col("structured_fields")).otherwise(F.map_concat(kept, "_e"))).drop("_e")
