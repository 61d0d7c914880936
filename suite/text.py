"""Column expressions (survey section 2.2), run over every line of the corpus."""

from pyspark.sql import functions as F

from auditframe import params as P
from auditframe.functions import text as X
from auditframe.plans import bridge as B

from . import sqlkit as S
from .registry import query

SEP = "array_to_string({}, '|')"


def over_blocks(name, make, sql):
    """One output column ``out`` per block."""
    @query(name, f"SELECT block_id, {sql} AS out FROM blocks")
    def run(spark, sf):
        return B.blocks(spark, sf).select("block_id", make().alias("out"))


def over_docs(name, make, sql):
    @query(name, f"SELECT doc_id, {sql} AS out FROM docs")
    def run(spark, sf):
        return B.documents(spark, sf).select("doc_id", make().alias("out"))


# whole raw texts
over_docs("clean_text", lambda: X.clean_text("text"), S.clean_text("raw"))
over_docs("compact_text", lambda: X.compact_text("text"), S.sub(S.clean_text("raw"), f"[{S.WS}]+"))
over_docs("clean_lines", lambda: X.clean_lines("text"), S.clean_lines("raw"))
over_docs("normalize_eval", lambda: X.normalize_eval("text"), S.sub("lower(raw)", f"[{S.WS}]+"))
over_docs("normalize_match", lambda: X.normalize_match("text"), f"lower({S.sub('raw', r'[^\p{L}\p{N}]+')})")
# decorated lines
over_blocks("compact_summary", lambda: X.compact_summary("text", 80), S.compact_summary("text", 80))
over_blocks("normalize_title", lambda: X.normalize_title("text"), f"lower({S.sub('text', f'[{S.WS}:：、，。；\\-（）()\\[\\]]+')})")
over_blocks("is_heading", lambda: X.is_heading("text"), S.is_heading("text"))
over_blocks("is_heading_layout", lambda: X.is_heading_layout("text"),
            f"((length({S.strip('text')}) <= 24 AND regexp_matches({S.strip('text')}, '^[一二三四五六七八九十]、')) OR (length({S.strip('text')}) <= 26 AND {S.has('text', P.LAYOUT_HEADING_TOKENS)}))")
over_blocks("heading_level", lambda: X.heading_level("text"), S.heading_level("text") + "::BIGINT")
over_blocks("section_code", lambda: X.section_code("text"), S.section_code("text"))
over_blocks("norm_section_code", lambda: X.norm_section_code("text"),
            f"CASE WHEN length({S.clean_lines('text')}) > 0 THEN left({S.sub(S.sub(S.clean_lines('text'), f'[{S.WS}]+'), '[：:]')}, 24) END")
over_blocks("valid_section_title", lambda: X.valid_section_title("text"), f"""(length({S.no_space('text')}) BETWEEN 1 AND 80
    AND NOT {S.has(S.no_space('text'), P.SECTION_TITLE_BLOCKLIST)} AND NOT (regexp_matches({S.no_space('text')}, '[：:]$') AND length({S.no_space('text')}) <= 18)
    AND {S.section_code('text')} IS NOT NULL AND NOT coalesce(regexp_matches({S.section_code('text')}, '^(\\d|（|\\()'), FALSE))""")
over_blocks("contract_number", lambda: X.contract_number("text"), S.contract_number("text"))
over_blocks("cross_references", lambda: X.cross_references("text"), SEP.format(S.cross_refs("text")))
over_blocks("reference_list", lambda: X.reference_list("text"), SEP.format(
    "(" + S.distinct_list(f"list_filter(list_transform(regexp_split_to_array(text, '[，,；;\n]+'), lambda p: {S.clean_lines('p')}), lambda p: p <> '')") + ")"))
over_blocks("block_id_list", lambda: X.block_id_list("text"), SEP.format(
    S.distinct_list(f"list_filter(regexp_split_to_array(text, '[,;{S.WS}]+'), lambda p: p <> '')")))
over_blocks("core_label", lambda: X.core_label(F.regexp_replace("core_label", "合同金额", "合同价款")),
            "CASE WHEN core_label = '合同金额' THEN '合同金额' ELSE core_label END")
over_blocks("overview_label", lambda: X.overview_label("core_label"), S.mapped("core_label", P.OVERVIEW_ALIASES))
over_blocks("null_if_missing", lambda: X.null_if_missing(F.when(F.col("block_no") % 5 == 0, " 未提取 ").otherwise(F.col("core_label"))),
            "CASE WHEN block_no % 5 = 0 THEN NULL ELSE core_label END")
over_blocks("clause_type", lambda: X.clause_type("core_label", "text"), S.clause_type("(core_label || chr(10) || text)"))
over_blocks("risk_tags", lambda: X.risk_tags("core_label", "text"), SEP.format(
    "list_filter([" + ", ".join(f"CASE WHEN {S.has('(core_label || chr(10) || text)', w)} THEN {S.q(n)} END" for n, w in P.RISK_TAG_KEYWORDS.items()) + "], lambda t: t IS NOT NULL)"))
_TOK = f"list_filter(regexp_split_to_array({{}}, '[{S.WS}:：，。；;（）()【】\\[\\]/\\\\\\-]+'), lambda t: length(t) >= 2)"
over_blocks("search_tokens", lambda: X.search_tokens("text", "core_label"),
            SEP.format(S.distinct_list(f"list_concat({_TOK.format('text')}, {_TOK.format('core_label')})")))
over_blocks("location_hint", lambda: X.location_hint("text"), f"""CASE WHEN contains(text, ':') THEN {S.strip("substr(text, strpos(text, ':') + 1)")}
    WHEN contains(text, '：') THEN {S.strip("substr(text, strpos(text, '：') + 1)")} ELSE nullif({S.strip('text')}, '') END""")


@query("label_source", f"""SELECT block_id, CASE WHEN block_no % 4 = 0 THEN 'core' WHEN core_label = '其他重要条款' THEN 'agent_discovered'
    WHEN block_no % 3 = 0 THEN 'core' ELSE 'user_configured' END AS out FROM blocks""")
def _(spark, sf):
    b = B.blocks(spark, sf)
    own = F.when(F.col("core_label") == P.DEFAULT_LABEL, F.lit("补充约定")).when(F.col("block_no") % 3 == 0, F.col("core_label")).otherwise("专项条款")
    return b.select("block_id", X.label_source(F.when(F.col("block_no") % 4 == 0, " Core "), own, F.col("core_label")).alias("out"))


@query("fact_value", f"""SELECT block_id, CASE WHEN core_label = '账户信息' THEN coalesce({S.contract_number(S.compact_summary('text', None))}, '未提取')
    WHEN core_label IN ('付款条件', '验收标准', '争议解决') THEN {S.compact_summary('text', None)}
    ELSE {S.compact_summary('text', None)} END AS out FROM blocks""")
def _(spark, sf):
    label = F.when(F.col("core_label") == "账户信息", "合同编号").otherwise(F.col("core_label"))
    return B.blocks(spark, sf).select("block_id", X.fact_value(label, F.col("text")).alias("out"))


@query("clamp_confidence", "SELECT event_id, CASE WHEN event_type = 'click' THEN 0.72::DOUBLE ELSE greatest(0.01::DOUBLE, least(value / 50, 0.99::DOUBLE)) END AS out FROM (SELECT event_id, event_type, value FROM events)")
def _(spark, sf):
    e = B.load(spark, sf, "events")
    return e.select("event_id", X.clamp_confidence(F.when(F.col("event_type") == "click", "n/a").otherwise((F.col("value") / 50).cast("string"))).alias("out"))


@query("coerce_level", "SELECT event_id, CASE WHEN event_type = 'click' THEN 1 ELSE greatest(1, least(user_id % 9, 6)) END::BIGINT AS out FROM events")
def _(spark, sf):
    e = B.load(spark, sf, "events")
    return e.select("event_id", X.coerce_level(F.when(F.col("event_type") == "click", "x").otherwise((F.col("user_id") % 9).cast("string"))).alias("out"))


@query("coerce_order", "SELECT event_id, CASE WHEN event_type = 'click' THEN greatest(1, event_id) ELSE greatest(1, user_id % 9) END::BIGINT AS out FROM events")
def _(spark, sf):
    e = B.load(spark, sf, "events")
    return e.select("event_id", X.coerce_order(F.when(F.col("event_type") == "click", "x").otherwise((F.col("user_id") % 9).cast("string")), F.col("event_id")).alias("out"))


@query("to_bool", "SELECT event_id, event_type IN ('click', 'view') AS out FROM events")
def _(spark, sf):
    e = B.load(spark, sf, "events")
    return e.select("event_id", X.to_bool(F.when(F.col("event_type") == "click", " YES ").when(F.col("event_type") == "view", "是").otherwise("no")).alias("out"))


@query("date_key", "SELECT o_orderkey, strftime(o_orderdate, '%Y%m%d')::BIGINT AS out FROM orders")
def _(spark, sf):
    return B.load(spark, sf, "orders").select("o_orderkey", X.date_key("o_orderdate").alias("out"))


@query("structured_fields", f"""SELECT block_id, (CASE WHEN {S.compact_summary('text', 80)} <> '' THEN '正文=' || {S.compact_summary('text', 80)} || '|' ELSE '' END) || '页码=' || page AS out FROM blocks""")
def _(spark, sf):
    b = B.blocks(spark, sf)
    m = F.create_map(F.lit(" 正文 "), F.col("text"), F.lit("页码"), F.col("page").cast("string"), F.lit("  "), F.lit("x"), F.lit("空"), F.lit(" "))
    return b.select("block_id", F.transform(F.map_entries(X.structured_fields(m)), lambda e: F.concat(e["key"], F.lit("="), e["value"])).alias("out"))


@query("risk_level", """SELECT event_id, CASE event_type WHEN 'click' THEN 'high' WHEN 'view' THEN 'medium' WHEN 'error' THEN 'low' ELSE 'pending_verification' END AS out FROM events""")
def _(spark, sf):
    t = F.col("event_type")
    return B.load(spark, sf, "events").select("event_id", X.risk_level(F.when(t == "click", "高").when(t == "view", " Medium ").when(t == "error", "低").otherwise(t)).alias("out"))


@query("focus_source", """SELECT event_id, CASE WHEN event_type = 'click' THEN 'agent_discovered' WHEN event_type = 'view' THEN 'user_external_check'
    WHEN user_id % 3 > 1 THEN 'user_external_check' WHEN user_id % 2 > 0 THEN 'user_relation_check' ELSE 'agent_discovered' END AS out FROM events""")
def _(spark, sf):
    t = F.col("event_type")
    given = F.when(t == "click", "user_rule_check").when(t == "view", "user_external_check")
    return B.load(spark, sf, "events").select("event_id", X.focus_source(given, F.col("user_id") % 2, F.greatest(F.lit(0), F.col("user_id") % 3 - 1)).alias("out"))


@query("tool_labels", f"SELECT event_id, {S.mapped('event_type', {'click': '规则引擎', 'view': '模型推理'})} || '|知识图谱' AS out FROM events")
def _(spark, sf):
    t = F.col("event_type")
    word = F.when(t == "click", "rule_engine_future").when(t == "view", "model_inference").otherwise(t)
    return B.load(spark, sf, "events").select("event_id", X.tool_labels(F.array(word, F.lit(" "), F.lit("knowledge_graph_future"), word)).alias("out"))


@query("severity_to_risk", "SELECT event_id, CASE event_type WHEN 'click' THEN 'high' WHEN 'view' THEN 'medium' ELSE 'pending_verification' END AS out FROM events")
def _(spark, sf):
    t = F.col("event_type")
    return B.load(spark, sf, "events").select("event_id", X.severity_to_risk(F.when(t == "click", "must_modify").when(t == "view", "suggest_modify")).alias("out"))


@query("severity_to_status", "SELECT event_id, CASE event_type WHEN 'click' THEN 'fail' WHEN 'view' THEN 'warning' ELSE 'external_pending' END AS out FROM events")
def _(spark, sf):
    t = F.col("event_type")
    return B.load(spark, sf, "events").select("event_id", X.severity_to_status(F.when(t == "click", "must_modify").when(t == "view", "suggest_modify")).alias("out"))


@query("title_content", f"""SELECT doc_id, left(ls[1], 120) AS title, {S.clean_text("CASE WHEN len(ls) > 1 THEN array_to_string(ls[2:], chr(10)) ELSE ls[1] END")} AS content
    FROM (SELECT doc_id, list_filter(list_transform(string_split(raw, chr(10)), lambda x: {S.strip('x')}), lambda x: x <> '') AS ls FROM docs) WHERE len(ls) > 0""")
def _(spark, sf):
    d = B.documents(spark, sf).select("doc_id", X.title_content("text", F.lit("")).alias("t"), "text")
    return d.where(F.length(X.clean_lines("text")) > 0).select("doc_id", "t.*")


@query("normalize_block_ids", """SELECT block_id, CASE WHEN block_no % 3 = 0 THEN 'hybrid_' || printf('%03d', page) || '_' || printf('%03d', rn)
    WHEN block_no % 3 = 1 THEN 'vl_' || printf('%03d', page) || '_007' ELSE 'text_1' END AS out
    FROM (SELECT *, row_number() OVER (PARTITION BY task_id, page ORDER BY block_no) AS rn FROM blocks)""")
def _(spark, sf):
    from auditframe.operators.structure import normalize_block_ids
    b = B.blocks(spark, sf)
    old = F.when(F.col("block_no") % 3 == 0, "hybrid_old_1").when(F.col("block_no") % 3 == 1, F.format_string("vl_%03d_007", "page")).otherwise("text_1")
    return normalize_block_ids(b.withColumn("raw_id", old), "raw_id").select("block_id", F.col("raw_id").alias("out"))


@query("hash_embedding", """WITH RECURSIVE src AS (SELECT doc_id, trim(raw, ' ' || chr(10)) AS t FROM docs),
    chain AS (SELECT doc_id, 1 AS step, sha256(t) AS h FROM src WHERE t <> '' UNION ALL SELECT doc_id, step + 1, sha256(unhex(h)) FROM chain WHERE step < 48),
    digits AS (SELECT doc_id, step, i, ('0x' || substr(h, i * 2 + 1, 2))::INT AS b FROM chain, range(32) r(i))
    SELECT doc_id, count(*)::BIGINT AS dims, round(sum(b / 255.0::DOUBLE * 2 - 1), 4) AS total, round(sum((b / 255.0::DOUBLE * 2 - 1) * ((step - 1) * 32 + i)), 4) AS weighted FROM digits GROUP BY doc_id""")
def _(spark, sf):
    d = B.documents(spark, sf).where(F.length(X.strip("text")) > 0).select("doc_id", X.hash_embedding("text").alias("v"))
    add = lambda s, x: s + x
    return d.select("doc_id", F.size("v").alias("dims"), F.round(F.aggregate("v", F.lit(0.0), add), 4).alias("total"),
                    F.round(F.aggregate(F.transform("v", lambda x, i: x * i), F.lit(0.0), add), 4).alias("weighted"))


@query("fit_vector", "SELECT vec_id, list_sum(list_transform(embedding[1:48], lambda x: x::DOUBLE)) AS head, list_sum(list_transform(embedding, lambda x: x::DOUBLE)) AS padded, 48::BIGINT AS n48, 80::BIGINT AS n80 FROM embeddings")
def _(spark, sf):
    e = B.load(spark, sf, "embeddings").withColumn("v", F.col("embedding").cast("array<double>"))
    total = lambda v: F.aggregate(v, F.lit(0.0), lambda s, x: s + x)
    short, long_ = X.fit_vector("v", 48), X.fit_vector("v", 80)
    return e.select("vec_id", total(short).alias("head"), total(long_).alias("padded"), F.size(short).alias("n48"), F.size(long_).alias("n80"))


@query("seq_ratio_bound", """SELECT block_id, (length(a) + length(b)) * (CASE WHEN length(a) + length(b) = 0 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE *
    list_sum(list_transform(list_distinct(string_split(a, '')), lambda c: least(length(a) - length(replace(a, c, '')), length(b) - length(replace(b, c, ''))))) / (length(a) + length(b)) END)::DOUBLE AS out
    FROM (SELECT block_id, text AS a, core_label || title2 AS b FROM (SELECT *, lag(text, 1, '') OVER (PARTITION BY doc_id ORDER BY block_no) AS title2 FROM blocks))""")
def _(spark, sf):
    from pyspark.sql import Window
    w = Window.partitionBy("doc_id").orderBy("block_no")
    b = B.blocks(spark, sf).withColumn("b", F.concat("core_label", F.lag("text", 1, "").over(w)))
    # scaled by the total length: whole numbers, so rounding cannot differ
    return b.select("block_id", (X.seq_ratio_bound("text", "b") * (F.length("text") + F.length("b"))).alias("out"))
