"""Layout and document structure: lines to blocks, blocks to sections, texts to clauses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import params as P
from ..functions import ordered as O
from ..functions import text as X
from ..session import stage

PAGE = ["task_id", "page"]
PAGES_PER_CHUNK = 64


def page_chunk(c="page") -> Column:
    return F.floor(F.col(c) / PAGES_PER_CHUNK)


# --- layout -----------------------------------------------------------------

def _box():
    return [
        F.min("x").alias("x"), F.min("y").alias("y"),
        F.greatest(F.lit(1), F.max(F.col("x") + F.col("width")) - F.min("x")).alias("width"),
        F.greatest(F.lit(1), F.max(F.col("y") + F.col("height")) - F.min("y")).alias("height"),
    ]


def normalize_block_ids(blocks: DataFrame, id_col: str = "block_id") -> DataFrame:
    """Page-qualify generated ids that do not name their page, by position in the page."""
    named = F.col(id_col).contains(F.format_string("_%03d_", F.col("page")))
    family = F.regexp_extract(id_col, "^(paddle|hybrid|vl)_", 1)
    b = O.numbered(blocks, PAGE, ["block_no"], "_pos")
    fresh = F.format_string("%s_%03d_%03d", family, F.col("page"), F.col("_pos"))
    return b.withColumn(id_col, F.when((family != "") & ~named, fresh).otherwise(F.col(id_col))).drop("_pos")


def lines_to_blocks(lines: DataFrame, gap: float = 1.2, indent: int = 48, prefix: str = "paddle") -> DataFrame:
    """Cluster lines of a page in reading order while they stay close and aligned."""
    from pyspark.sql import Window
    order = ["y", "x", "line_no"]
    w = Window.partitionBy(*PAGE).orderBy(*order)
    prev = {c: F.lag(c).over(w) for c in ("x", "y", "height")}
    near = (F.col("y") - (prev["y"] + prev["height"]) <= F.greatest(prev["height"], F.col("height")) * gap) & (
        F.abs(F.col("x") - prev["x"]) < indent)
    b = lines.withColumn("_near", F.coalesce(near, F.lit(False)))
    b = O.islands(b, PAGE, order, ~F.col("_near"), "block_index")
    out = b.groupBy(*PAGE, "block_index").agg(*_box(), X.strip(O.joined_list("text", order, " ")).alias("text"), F.count(F.lit(1)).alias("n_lines"))
    return out.withColumn("block_id", F.format_string(f"{prefix}_%03d_%03d", "page", "block_index")).withColumn("emphasis", X.is_heading_layout("text"))


def ocr_quality(lines: DataFrame) -> DataFrame:
    n = F.length(X.strip("text"))
    # averaged as decimals: a sum of doubles may put a page of exactly 0.9 below 0.9, depending on the order of its lines
    exact = F.col("score").try_cast("decimal(28,15)")
    mean = F.when(F.count(exact) == F.count("score"), F.avg(exact).cast("double")).otherwise(F.avg("score"))
    q = lines.groupBy(*PAGE).agg(
        F.count(F.lit(1)).alias("n_lines"), mean.alias("mean_score"),
        F.avg((n <= 2).cast("double")).alias("short_ratio"), F.avg((n <= 6).cast("double")).alias("fragment_ratio"))
    poor = (F.col("mean_score") < 0.82) | ((F.col("mean_score") < 0.90) & (F.col("short_ratio") > 0.55))
    dense = (F.col("mean_score") < 0.93) & (F.col("n_lines") >= 45) & (F.col("fragment_ratio") > 0.72)
    return q.withColumn("needs_enhancement", poor | dense)


def page_route(blocks: DataFrame, enough: int = 60) -> DataFrame:
    r = blocks.groupBy(*PAGE).agg(F.sum(F.length(X.strip("text"))).alias("text_len"))
    return r.withColumn("route", F.when(F.col("text_len") >= enough, "text").otherwise("ocr"))


def alignment_unstable(lines: DataFrame, blocks: DataFrame) -> DataFrame:
    """Per page: too many blocks that are very tall or nearly empty."""
    height = lines.groupBy(*PAGE).agg(F.avg(F.greatest(F.lit(1), F.col("height"))).alias("line_height"))
    b = blocks.join(height, PAGE, "left").withColumn("line_height", F.coalesce("line_height", F.lit(1.0)))
    s = b.groupBy(*PAGE).agg(
        F.count(F.lit(1)).alias("n_blocks"),
        F.sum((F.col("height") > F.col("line_height") * 4.5).cast("long")).alias("oversized"),
        F.sum((F.length(X.strip("text")) <= 1).cast("long")).alias("tiny"))
    return s.withColumn("unstable", (F.col("oversized") > F.greatest(F.lit(1), F.floor(F.col("n_blocks") / 4))) | (
        F.col("tiny") > F.greatest(F.lit(2), F.floor(F.col("n_blocks") / 3))))


def alignment_blocks(lines: DataFrame, groups: DataFrame) -> DataFrame:
    """Accept proposed line groups that are complete and contiguous; other lines stay single.

    lines: task_id, page, line_no, line_id, text, box; groups: task_id, page, group_no, line_ids.
    The lines of a page and the ids asked for meet in one row, where its blocks are made, so a text is shuffled once.
    """
    ids = F.filter("line_ids", lambda x: F.length(X.strip(x)) > 0)
    want = groups.select(*PAGE, "group_no", F.posexplode(ids).alias("pos", "line_id"))
    line = F.struct("line_id", "line_no", "text", "x", "y", "width", "height")
    kind = lines.select(line.alias("l")).schema["l"].dataType
    pages = lines.groupBy(*PAGE).agg(F.collect_list(line).alias("ls")).join(want.groupBy(*PAGE).agg(F.collect_list(F.struct("group_no", "pos", "line_id")).alias("ws")), PAGE)

    def hits(g):
        def lines_of(w):
            same = F.filter("ls", lambda l: l["line_id"] == w["line_id"])
            return F.transform(F.when(F.size(same) > 0, same).otherwise(F.array(F.lit(None).cast(kind))), lambda l: F.struct(w["pos"].alias("pos"), l.alias("l")))
        return F.flatten(F.transform(F.filter("ws", lambda w: w["group_no"].eqNullSafe(g)), lines_of))

    def made(g):
        def block(h):
            of = lambda fn: F.transform(h, fn)
            left, top, shift = F.array_min(of(lambda v: v["l"]["x"])), F.array_min(of(lambda v: v["l"]["y"])), of(lambda v: v["l"]["line_no"] - v["pos"])
            whole = F.forall(h, lambda v: v["l"]["line_no"].isNotNull()) & F.coalesce(F.array_min(shift) == F.array_max(shift), F.lit(False))
            text = F.array_join(F.transform(F.array_sort(of(lambda v: F.struct(v["pos"].alias("pos"), v["l"]["text"].alias("v")))), lambda v: v["v"]), " ")
            return F.struct(g.alias("group_no"), X.strip(text).alias("text"), left.alias("x"), top.alias("y"), F.greatest(F.lit(1), F.array_max(of(lambda v: v["l"]["x"] + v["l"]["width"])) - left).alias("width"),
                            F.greatest(F.lit(1), F.array_max(of(lambda v: v["l"]["y"] + v["l"]["height"])) - top).alias("height"), whole.alias("whole"))
        return X.bound(hits(g), block)

    pages = pages.withColumn("ms", F.filter(F.transform(F.array_distinct(F.transform("ws", lambda w: w["group_no"])), made), lambda m: m["whole"]))
    heights, blocks = [pages.select(*PAGE, F.explode(c).alias("v")).select(*PAGE, "v.height", "v.text") for c in ("ls", "ms")]
    pages = pages.join(alignment_unstable(heights, blocks).where(~F.col("unstable")).select(*PAGE), PAGE, "left_semi")

    def row(v, block_id, text, tier, seq):
        size = [F.greatest(F.lit(1), v[c]).alias(c) for c in ("width", "height")]
        return F.struct(block_id.alias("block_id"), text.alias("text"), v["x"].alias("x"), v["y"].alias("y"), *size, F.lit(tier).alias("tier"), v[seq].cast("long").alias("seq"))

    used = F.transform(F.filter("ws", lambda w: F.exists("ms", lambda m: m["group_no"] == w["group_no"])), lambda w: w["line_id"])
    tails = X.bound(used, lambda taken: F.filter("ls", lambda l: ~F.coalesce(F.array_contains(taken, l["line_id"]), F.lit(False))))
    rows = F.concat(F.transform("ms", lambda m: row(m, F.format_string("hybrid_%03d_%03d", F.col("page"), m["group_no"]), m["text"], 0, "group_no")),
                    F.transform(tails, lambda l: row(l, F.concat(F.lit("hybrid_tail_"), l["line_id"]), X.strip(l["text"]), 1, "line_no")))
    return O.numbered(pages.select(*PAGE, F.inline(rows)), PAGE, ["y", "x", "tier", "seq"], "block_no").drop("tier", "seq")


def flow_blocks(paragraphs: DataFrame, dims: DataFrame) -> DataFrame:
    """Paragraphs without boxes become stacked boxes, kept inside the page."""
    from pyspark.sql import Window
    w_, h_ = F.col("page_width"), F.col("page_height")
    top, pad = F.greatest(F.lit(36), F.floor(h_ * 0.05)), F.greatest(F.lit(36), F.floor(w_ * 0.08))
    line = F.greatest(F.lit(28), F.floor(h_ * 0.024))
    p = paragraphs.where(F.length("text") > 0).join(dims, PAGE)
    p = p.withColumn("height", line * (F.floor(F.length("text") / 28) + 1)).withColumn("_gap", F.greatest(F.lit(12), F.floor(line * 0.45)))
    before = Window.partitionBy(*PAGE).orderBy("para_no").rowsBetween(Window.unboundedPreceding, -1)
    at = top + F.coalesce(F.sum(F.col("height") + F.col("_gap")).over(before), F.lit(0))
    p = p.withColumn("y", F.least(at, F.greatest(top, h_ - F.col("height") - top))).withColumn("x", pad)
    p = p.withColumn("width", F.greatest(F.lit(320), w_ - pad * 2))
    p = O.numbered(p, PAGE, ["para_no"], "block_no")
    return p.select(*PAGE, "block_no", F.format_string("vl_%03d_%03d", "page", "block_no").alias("block_id"), "text", "x", "y", "width", "height",
                    X.is_heading_layout("text").alias("emphasis"))


def page_paragraphs(responses: DataFrame) -> DataFrame:
    """Given paragraph list, else the lines of the full text; cleaned, empties dropped."""
    given = F.filter(F.transform("paragraphs", X.clean_lines), lambda x: F.length(x) > 0)
    split = F.filter(F.split(X.clean_lines("full_text"), "\n"), lambda x: F.length(x) > 0)
    arr = F.when(F.col("paragraphs").isNotNull(), given).otherwise(split)
    out = responses.select(*PAGE, F.posexplode(arr).alias("pos", "text"))
    return out.select(*PAGE, (F.col("pos") + 1).alias("para_no"), "text")


def page_blocks_source(pages: DataFrame, model_first: bool = True) -> DataFrame:
    """Which block source a page uses, from the row counts of each candidate source."""
    para, lines = F.col("n_paragraphs") > 0, F.col("n_lines") > 0
    aligned, flow, fallback = (F.col("n_aligned") > 0) & lines & para, (F.col("n_flow") > 0) & para, F.col("n_fallback") > 0
    primary_flow = F.lit(model_first) & flow
    source = (
        F.when(aligned, "aligned").when(primary_flow, "flow_primary").when(lines, "layout")
        .when(flow, "flow_only").when(fallback, "fallback").otherwise("none")
    )
    s = pages.withColumn("source", source)
    steps = F.array_compact(F.array(
        F.when(para, "qwen_vl_semantic"),
        F.when((F.col("source") == "layout") | ((F.col("source") == "aligned") & ~F.lit(model_first)), "paddle_ocr"),
        F.when(F.col("source") == "aligned", "qwen_text_anchor"),
        F.when(F.col("source") == "flow_primary", "qwen_vl_primary"),
        F.when(F.col("source").isin("flow_only", "fallback"), "qwen_vl_only")))
    notes = {"flow_primary": "Page %d used VL-primary OCR with approximate boxes", "flow_only": "Page %d used VL-only OCR fallback",
             "fallback": "Page %d used VL-only OCR fallback", "none": "Page %d OCR needs manual review: no text extracted"}
    warning = F.coalesce(*[F.when(F.col("source") == k, F.format_string(v, "page")) for k, v in notes.items()])
    return s.withColumn("steps", steps).withColumn("warning", warning)


def document_pipeline(chosen: DataFrame) -> DataFrame:
    steps = chosen.select("task_id", F.explode_outer("steps").alias("step"))
    s = steps.groupBy("task_id").agg(F.array_join(F.array_sort(F.collect_set("step")), "+").alias("pipeline"))
    return s.withColumn("pipeline", F.when(F.col("pipeline") == "", "pdf_text").otherwise(F.col("pipeline")))


def page_title(blocks: DataFrame, fallback: str = "") -> DataFrame:
    """First short emphasised block, else the first block cut to 32 characters."""
    short = F.col("emphasis") & (F.length("text") <= 32)
    t = blocks.groupBy(*PAGE).agg(F.min_by(F.when(short, F.col("text")).otherwise(F.substring("text", 1, 32)),
                                           F.struct((~short).cast("int"), F.col("block_no"))).alias("title"))
    return t.withColumn("title", F.coalesce("title", F.lit(fallback)))


# --- page batches -----------------------------------------------------------

def page_windows(pages: DataFrame, size: int, overlap: int) -> DataFrame:
    """Overlapping page batches; each page states its windows itself, so no range join is needed."""
    size, step = max(1, size), max(1, max(1, size) - max(0, overlap))
    p = O.numbered(pages.select(*PAGE), ["task_id"], ["page"], "pos", page_chunk())
    counts = pages.groupBy("task_id").agg(F.count(F.lit(1)).alias("n"))
    p = p.join(counts, "task_id").withColumn("pos", F.col("pos") - 1)
    last = F.when(F.col("n") <= size, F.lit(0)).otherwise(F.ceil((F.col("n") - size) / step))
    lo = F.greatest(F.lit(0), F.ceil((F.col("pos") - size + 1) / step))
    hi = F.least(F.floor(F.col("pos") / step), last)
    p = p.withColumn("window_no", F.explode(F.when(lo <= hi, F.sequence(lo, hi)).otherwise(F.array().cast("array<long>"))))
    return p.select(*PAGE, (F.col("window_no") + 1).alias("window_no"))


def chunk_rows(df: DataFrame, keys: list[str], order: list, n: int, chunk: Column | None = None) -> DataFrame:
    d = O.numbered(df, keys, order, "_pos", chunk)
    return d.withColumn("batch_no", F.floor((F.col("_pos") - 1) / max(1, n)) + 1).drop("_pos")


def page_payload(blocks: DataFrame, max_blocks: int | None = None, max_text: int | None = None, max_headings: int | None = None, block_chars: int | None = None, heading_chars: int | None = None) -> DataFrame:
    """Page context for a model: blocks, heading candidates, page text; limits of the model are parameters."""
    cut = lambda c, n: F.col(c) if n is None else F.substring(c, 1, n)
    upto = lambda c, n: F.lit(True) if n is None else F.col(c) <= n
    b = blocks.withColumn("text", X.clean_lines("text")).where(F.length("text") > 0)
    b = b.withColumn("_head", X.is_heading("text"))
    b = O.numbered(b, PAGE, ["block_no"], "_pos").withColumn("_kind", F.when(F.col("_head"), 1).otherwise(0))
    b = O.numbered(b, [*PAGE, "_kind"], ["block_no"], "_head_pos")
    kept = F.when(upto("_pos", max_blocks), F.struct("block_no", cut("text", block_chars).alias("v")))
    heads = F.when(F.col("_head") & upto("_head_pos", max_headings), F.struct("block_no", F.concat("block_id", F.lit(":"), cut("text", heading_chars)).alias("v")))
    values = lambda a: F.transform(F.array_sort(a), lambda s: s["v"])
    out = b.groupBy(*PAGE).agg(F.collect_list(kept).alias("_kept"), F.collect_list(heads).alias("_heads"))
    whole = F.array_join(values(F.col("_kept")), " ")
    return out.select(*PAGE, F.size("_kept").alias("n_blocks"), (whole if max_text is None else F.substring(whole, 1, max_text)).alias("page_text"),
                      values(F.col("_heads")).alias("headings"))


# --- sections ---------------------------------------------------------------

def section_marks(blocks: DataFrame) -> DataFrame:
    """Article marks inside blocks, unless the eight characters before name a citation."""
    # tested on the stored text, as a filter on a computed column computes it twice; blocks without a mark explode to nothing
    b = blocks.where(F.col("text").contains("第")).withColumn("text", X.clean_lines("text"))
    marks = F.regexp_extract_all("text", F.lit(P.SECTION_MARK_PATTERN), F.lit(0))
    b = b.withColumn("_marks", marks).withColumn("_gaps", F.when(F.size("_marks") > 0, F.split("text", P.SECTION_MARK_PATTERN, -1)))
    upto = lambda arr, k: F.aggregate(F.slice(arr, 1, k), F.lit(0), lambda s, v: s + F.length(v))
    spans = F.transform("_marks", lambda m, i: F.struct((upto(F.col("_marks"), i) + upto(F.col("_gaps"), i + 1)).alias("start"), m.alias("mark")))
    c = b.select("task_id", "page", "block_no", "block_id", "text", F.posexplode(spans).alias("mark_no", "s"))
    start, end = F.col("s.start"), F.col("s.start") + F.length("s.mark")
    left = F.substr("text", F.greatest(start - 8, F.lit(0)) + 1, F.least(start, F.lit(8)))
    c = c.where(~X.contains_any(left, P.CITATION_MARKERS))
    code = F.regexp_extract("s.mark", P.SECTION_MARK_PATTERN, 1)
    tail = F.substr("text", end + 1, F.lit(42))
    topic = F.split(tail, r"[。；;\n]|第[一二三四五六七八九十百零〇\d]+条", -1)[0]
    topic = X.compact_summary(X.sub(topic, "^[ ：:，,、]+|[ ：:，,、]+$"), 24)
    from_ = F.greatest(start - 20, F.lit(0))
    evidence = X.compact_summary(F.substr("text", from_ + 1, end + 80 - from_), 120)
    return c.select("task_id", "page", "block_no", "block_id", "mark_no", code.alias("section_code"), topic.alias("topic"), evidence.alias("evidence_text"))


def section_candidates(blocks: DataFrame, cap: int | None = None, marks: DataFrame | None = None) -> DataFrame:
    """Article marks as numbered sections; marks: those of section_marks, if they are there already."""
    c = section_marks(blocks) if marks is None else marks
    c = O.numbered(c, ["task_id"], ["page", "block_no", "mark_no"], "sort_order", page_chunk())
    c = c if cap is None else c.where(F.col("sort_order") <= cap)
    has_topic = F.length("topic") > 0
    return c.select("task_id", F.when(has_topic, F.concat_ws(" ", "section_code", "topic")).otherwise(F.col("section_code")).alias("title"),
                    F.lit(1).alias("level"), "page", "sort_order", "section_code",
                    F.when(has_topic, F.col("topic")).otherwise(F.col("section_code")).alias("summary"), F.lit(0.82).alias("confidence"),
                    "evidence_text", F.array("block_id").alias("block_ids"), F.col("sort_order").alias("ord"))


def _best_sections(items: DataFrame) -> DataFrame:
    """One section per code (or page and title): most confident, most blocks, longest summary; then renumbered."""
    code = X.norm_section_code(F.coalesce(F.nullif(X.clean_lines("section_code"), F.lit("")), X.section_code("title")))
    items = items.withColumn("section_code", code)
    coded = F.coalesce(F.col("section_code").startswith("第"), F.lit(False))
    items = items.withColumn("_kp", F.when(coded, 0).otherwise(F.col("page"))).withColumn("_kt", F.when(coded, F.col("section_code")).otherwise(F.col("title")))
    keys = ["task_id", "_kp", "_kt"]
    rest = [c for c in items.columns if c not in keys]
    order = F.struct((-F.col("confidence")).alias("a"), (-F.size("block_ids")).alias("b"), (-F.length("summary")).alias("c"), F.col("ord").alias("d"))
    best = items.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("_b"), F.min("ord").alias("_seen"))
    # numbering reads its input twice, so the grouped rows are written first
    best = stage(best.select("task_id", "_b.*", "_seen").withColumn("title", F.substring("title", 1, 120)))
    best = O.numbered(best, ["task_id"], ["page", "sort_order", "level", "title", "_seen"], "_no", page_chunk())
    return best.withColumn("sort_order", F.col("_no")).withColumn("ord", F.col("_no")).drop("_no", "_seen")


def coerced_sections(items: DataFrame, blocks: DataFrame) -> DataFrame:
    """Sections given by a model with their values put right: a page of the task, a level
    from 1 to 6, an order from 1 on, a confidence, a list of block ids.

    items: the columns of section_candidates, page, level and sort_order of any type; ord is unique in a task.
    """
    c = items.withColumn("_probe", F.coalesce(F.nullif(X.clean_lines("evidence_text"), F.lit("")), F.col("title")))
    c = coerce_page(c, blocks, "ord", "page", "_probe").drop("_probe")
    if dict(c.dtypes)["block_ids"] == "string":
        c = c.withColumn("block_ids", X.block_id_list("block_ids"))
    return c.withColumns({"confidence": X.clamp_confidence("confidence"), "level": X.coerce_level("level"), "sort_order": X.coerce_order("sort_order", "ord").cast("long"), "block_ids": F.coalesce("block_ids", F.array().cast("array<string>"))})


def section_candidate_dedupe(candidates: DataFrame) -> DataFrame:
    c = candidates.withColumn("title", X.clean_lines("title")).where(F.length("title") > 0)
    summary = F.coalesce(F.nullif(X.clean_lines("summary"), F.lit("")), F.nullif(X.clean_lines("evidence_text"), F.lit("")), F.col("title"))
    return _best_sections(c.withColumn("summary", X.compact_summary(summary, 80)).withColumn("confidence", X.clamp_confidence("confidence")))


def build_sections(items: DataFrame) -> DataFrame:
    c = items.withColumn("title", X.clean_lines("title")).where(X.valid_section_title("title"))
    summary = F.coalesce(F.nullif(X.clean_lines("summary"), F.lit("")), F.nullif(X.clean_lines("evidence_text"), F.lit("")), F.col("title"))
    s = _best_sections(c.withColumn("summary", X.compact_summary(summary, 80)).withColumn("confidence", X.clamp_confidence("confidence")))
    return s.withColumn("section_id", F.format_string("section_%03d", "sort_order"))


def section_merge_gate(merged: DataFrame, candidates: DataFrame) -> DataFrame:
    """Per task: is the merged list acceptable next to the candidate list?"""
    def counts(df, tag):
        code = X.norm_section_code(F.coalesce(F.nullif(X.clean_lines("section_code"), F.lit("")), X.section_code("title")))
        return df.groupBy("task_id").agg(F.count(F.lit(1)).alias(f"n_{tag}"), F.count_if(F.coalesce(code.startswith("第"), F.lit(False))).alias(f"major_{tag}"))
    g = counts(candidates, "candidates").join(counts(merged, "merged"), "task_id", "left").na.fill(0)
    collapsed = (F.col("major_candidates") >= 6) & (F.col("major_merged") < F.greatest(F.lit(5), F.floor(F.col("major_candidates") * 0.55)))
    exploded = F.col("n_merged") > F.greatest(F.col("n_candidates") * 2, F.col("n_candidates") + 20)
    return g.withColumn("accepted", (F.col("n_merged") > 0) & ~collapsed & ~exploded)


SECTION_COLUMNS = ["task_id", "section_id", "title", "level", "page", "summary", "confidence", "sort_order", "section_code"]


def local_sections(blocks: DataFrame, without: DataFrame | None = None) -> DataFrame:
    """Heading-like blocks as sections; a task without any gets one default section.  Tasks of ``without`` are left out.

    Tasks are left out after the headings are found: headings are short, while the texts of all blocks would be shuffled.
    """
    heading = X.bound(X.clean_lines("text"), lambda x: F.when(X.is_heading(x), x))
    h = blocks.select("task_id", "page", "block_no", F.explode(F.array_compact(F.array(heading))).alias("title"))
    pages = blocks.groupBy("task_id").agg(F.min("page").alias("page"))
    h, pages = [df if without is None else df.join(without, "task_id", "left_anti") for df in (h, pages)]
    h = stage(h)
    starts = pages.join(h.select("task_id").distinct(), "task_id", "left_anti")
    h = O.numbered(h, ["task_id"], ["page", "block_no"], "sort_order", page_chunk())
    found = h.select("task_id", F.format_string("section_%03d", "sort_order").alias("section_id"), F.substring("title", 1, 120).alias("title"),
                     X.heading_level("title").alias("level"), "page", X.compact_summary("title", 80).alias("summary"),
                     F.lit(0.55).alias("confidence"), "sort_order", X.section_code("title").alias("section_code"))
    default = starts.select("task_id", F.lit("section_001").alias("section_id"), F.lit("合同正文").alias("title"), F.lit(1).alias("level"), "page",
                          F.lit("未稳定识别到显式章节标题，建议人工复核。").alias("summary"), F.lit(0.35).alias("confidence"),
                          F.lit(1).cast("long").alias("sort_order"), F.lit(None).cast("string").alias("section_code"))
    return found.unionByName(default)


def reconstruct_sections(blocks: DataFrame, window_candidates: DataFrame | None = None, merged: DataFrame | None = None) -> DataFrame:
    """Window and structural candidates, deduped; merged list if it passes the gate; local headings otherwise."""
    c = section_candidates(blocks, marks=stage(section_marks(blocks)))
    if window_candidates is not None:
        head = coerced_sections(window_candidates, blocks).withColumn("_tier", F.lit(0))
        c = head.unionByName(c.withColumn("_tier", F.lit(1)))
        c = c.withColumn("ord", F.col("_tier") * F.lit(1 << 40) + F.col("ord")).drop("_tier")
    c = use = section_candidate_dedupe(c)
    if merged is not None:
        merged = coerced_sections(merged, blocks)
        good = section_merge_gate(merged, c).where("accepted").select("task_id")
        use = merged.join(good, "task_id", "left_semi").unionByName(c.join(good, "task_id", "left_anti"))
    built = build_sections(use).select(*SECTION_COLUMNS)
    local = local_sections(blocks, built.select("task_id").distinct())
    return built.unionByName(local)


def section_tree(sections: DataFrame) -> DataFrame:
    """Parent = nearest earlier section of a smaller level (levels 1 to 6)."""
    at = {f"_l{n}": F.when(F.col("level") == n, F.col("sort_order")) for n in range(1, 6)}
    s = O.carry(sections, ["task_id"], ["sort_order"], at, F.floor(F.col("sort_order") / O.CHUNK))
    parent = F.greatest(*[F.when(F.col("level") > n, F.col(f"_l{n}")) for n in range(1, 6)], F.lit(None).cast("long"))
    return s.withColumn("parent_order", parent).drop(*at)


def nearest_section(x: DataFrame, sections: DataFrame) -> DataFrame:
    """Title of the last section that starts on or before the row's page (as-of by page)."""
    per_page = sections.groupBy(*PAGE).agg(F.max_by("title", "sort_order").alias("_title"))
    wanted = x.select(*PAGE).distinct().withColumn("_title", F.lit(None).cast("string"))
    both = per_page.unionByName(wanted).groupBy(*PAGE).agg(F.max("_title").alias("_title"))
    filled = O.carry(both, ["task_id"], ["page"], {"section_title": F.col("_title")}, page_chunk())
    return x.join(filled.select(*PAGE, "section_title"), PAGE, "left")


def page_texts(blocks: DataFrame) -> DataFrame:
    return blocks.groupBy(*PAGE).agg(O.joined_list("text", ["block_no"], "\n").alias("page_text"))


def no_blanks(c) -> Column:
    """The text without plain blanks; a text that holds another one also holds it after both have lost theirs."""
    return F.replace(X.col(c), F.lit(" "), F.lit(""))


def locate_page(x: DataFrame, blocks: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """First page of the task that contains the text, blanks ignored; null when none does."""
    pages = page_texts(blocks).select(*PAGE, no_blanks("page_text").alias("_b"))
    t = x.where(F.length(X.strip(text_col)) > 0).select("task_id", id_col, no_blanks(X.clean_lines(text_col)).alias("_t"))
    found = t.join(pages, "task_id").where(F.col("_b").contains(F.col("_t")))
    return found.groupBy("task_id", id_col).agg(F.min("page").alias("found_page"))


def task_pages(blocks: DataFrame, sections: DataFrame) -> DataFrame:
    """Every page a row of the tasks can be put on (those of the blocks, and 1), with the title of its section."""
    return nearest_section(blocks.select(*PAGE).unionByName(sections.select("task_id", F.lit(1).cast(dict(blocks.dtypes)["page"]).alias("page"))).distinct(), sections)


def coerce_page(x: DataFrame, blocks: DataFrame, id_col: str, page_col: str, text_col, titled: DataFrame | None = None) -> DataFrame:
    """Given page when the task has it, else the page found by text (a column or an expression), else the first page.

    The rows are written once with the pages that are there; only rows without one are looked up, and texts are moved for them alone.
    titled: task_pages(), whose section titles come along, so that the rows need not meet the sections by themselves; the rows are
    then for one reader, as those looked up are not written.
    """
    pages = blocks.select("task_id", F.col("page").alias("_given"), F.col("page").alias("_p")).distinct()
    shown = [] if titled is None else ["section_title"]
    there = pages if titled is None else pages.join(titled.withColumnRenamed("page", "_given"), ["task_id", "_given"], "left")
    x = x.withColumn("_given", F.col(page_col).cast("string").try_cast("long"))
    known = stage(x.join(there, ["task_id", "_given"], "left"))
    missing = known.where(F.col("_p").isNull()).drop(*shown)
    out = known.where(F.col("_p").isNotNull()).withColumn(page_col, F.coalesce("_p", F.lit(1))).drop("_given", "_p")
    if missing.isEmpty():
        return out
    key = ["task_id", id_col]
    first = blocks.groupBy("task_id").agg(F.min("page").alias("_first"))
    found = missing.select(*key).distinct().join(locate_page(missing, blocks, id_col, text_col), key, "left").join(first, "task_id", "left")
    found = found.select(*key, F.coalesce("found_page", "_first", F.lit(1)).alias("page"))
    found = found if titled is None else found.join(titled, PAGE, "left")
    found = found.select(*[F.col(c).alias(f"_{c}") for c in key], F.col("page").alias("_at"), *shown)
    looked = missing.join(found, (F.col("task_id") == F.col("_task_id")) & F.col(id_col).eqNullSafe(F.col(f"_{id_col}")), "left")
    looked = looked.withColumn(page_col, F.coalesce("_at", F.lit(1))).select(*out.columns)
    return out.unionByName(looked if shown else stage(looked))


def locate_block(x: DataFrame, blocks: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """First block on the row's page that contains the text, blanks ignored."""
    t = x.where(F.length(X.strip(text_col)) > 0).select(*PAGE, id_col, no_blanks(X.clean_lines(text_col)).alias("_t"))
    b = blocks.select(*PAGE, "block_no", "block_id", no_blanks(X.clean_lines("text")).alias("_b"))
    found = t.join(b, PAGE).where(F.col("_b").contains(F.col("_t")))
    return found.groupBy("task_id", id_col).agg(F.min_by("block_id", "block_no").alias("evidence_id"))


# --- knowledge texts --------------------------------------------------------

def _marked(text: Column, pattern: str) -> Column:
    """Parts of a text, each starting with a heading that ends at U+0002 (the first part has none)."""
    return F.split(F.regexp_replace(text, F.lit(f"({pattern})"), F.lit("\x01$1\x02")), "\x01", -1)


def split_policy(docs: DataFrame) -> DataFrame:
    """Policy text to clauses: chapters, then articles; a heading with no text below it gives no row.

    Each part carries its own heading, so the split is done inside the row
    without any shuffle: chapter and article are never looked up in other rows.
    """
    def pieces(df, text, pattern, at, head, body):
        p = df.select("*", F.posexplode(_marked(text, pattern)).alias(at, "_p"))
        cut = F.instr("_p", "\x02")
        p = p.withColumn(head, F.when(cut > 0, X.strip(F.substr("_p", F.lit(1), cut - 1))))
        return p.withColumn(body, X.strip(F.when(cut > 0, F.substr("_p", cut + 1)).otherwise(F.col("_p")))).drop("_p").where(F.length(body) > 0)

    d = docs.select("document_id", "text")
    ch = pieces(d, X.clean_text("text"), P.CHAPTER_PATTERN, "_c", "_chapter", "_body").withColumn("chapter", F.coalesce("_chapter", F.lit(P.DEFAULT_CHAPTER)))
    ar = pieces(ch.select("document_id", "_c", "chapter", "_body"), F.col("_body"), P.ARTICLE_PATTERN, "_a", "article", "_text")
    content = X.clean_text("_text")
    out = ar.select("document_id", F.col("_c").cast("long").alias("part_no"), F.col("_a").cast("long").alias("article_no"), F.col("chapter").alias("category_lv1"),
                    F.coalesce("article", "chapter").alias("title"),
                    F.when(F.col("article").isNotNull(), F.substring_index("article", "条", 1)).otherwise(F.col("chapter")).alias("clause_no"),
                    content.alias("content"), F.lit("policy").alias("doc_type"), F.lit("policy_article").alias("clause_type"))
    return out.where(F.length("content") > 0)


def split_template(docs: DataFrame) -> DataFrame:
    """Template text to clauses: the first of three heading patterns that yields more than one part."""
    def parts(text, pattern):
        return F.filter(F.transform(F.split(text, f"(?={pattern})", -1), X.strip), lambda x: F.length(x) > 0)

    def chosen(text):  # a pattern is tried only when those before it have found nothing
        return F.coalesce(*[X.bound(parts(text, p), lambda found: F.when(F.size(found) > 1, found)) for p in P.TEMPLATE_HEADINGS], F.array(text))

    e = docs.select("document_id", "template_id", "template_name", F.posexplode(X.bound(X.clean_text("text"), chosen)).alias("pos", "part"))
    e = e.withColumn("pos", F.col("pos") + 1)
    e = e.withColumn("tc", X.title_content("part", F.concat_ws("-", "template_name", "pos")))
    title, content = F.col("tc.title"), F.col("tc.content")
    return e.select("document_id", "template_id", "template_name", F.col("pos").cast("string").alias("clause_no"), title.alias("title"),
                    X.clause_type(title, content).alias("clause_type"), content.alias("content"), X.risk_tags(title, content).alias("risk_tags"),
                    F.lit("template").alias("doc_type"))


def template_catalog(lines: DataFrame, contents_pages: int | None = None) -> DataFrame:
    """Table-of-contents lines to catalogue rows, carrying the two category levels.

    lines: document_id, page, line_no, text; with contents_pages only pages up to it.  The levels are carried in
    ranges of lines, so a document that holds most of the table is many tasks.
    """
    x = (lines if contents_pages is None else lines.where(F.col("page") <= contents_pages)).withColumn("line", X.clean_text("text")).where(F.length("line") > 0)
    compact = X.drop_blank("line")
    lv1 = F.coalesce(F.nullif(F.regexp_extract("line", P.CATALOG_LV1, 1), F.lit("")), F.nullif(F.regexp_extract(compact, P.CATALOG_LV1, 1), F.lit("")))
    one_dot = F.length("line") - F.length(F.replace("line", F.lit("."), F.lit(""))) == 1
    x = x.withColumn("_lv1", lv1)
    x = x.withColumn("_lv2", F.when(F.col("_lv1").isNull() & one_dot, F.nullif(F.regexp_extract("line", P.CATALOG_LV2, 2), F.lit(""))))
    is_line = F.col("_lv1").isNull() & F.col("_lv2").isNull() & F.rlike("line", F.lit(P.CATALOG_LINE))
    at = F.struct("page", "line_no")
    x = O.carry(x, ["document_id"], ["page", "line_no"], {"_a": F.when(F.col("_lv1").isNotNull(), F.struct(at.alias("at"), F.col("_lv1").alias("v"))),
                                                          "_b": F.when(F.col("_lv2").isNotNull(), F.struct(at.alias("at"), F.col("_lv2").alias("v")))}, F.col("page") * (1 << 30) + F.floor(F.col("line_no") / O.CHUNK))
    # a level 2 above the last level 1 belongs to an earlier category
    x = x.withColumns({"category_lv1": F.col("_a.v"), "category_lv2": F.when(F.col("_a").isNull() | (F.col("_b.at") > F.col("_a.at")), F.col("_b.v"))}).where(is_line)
    get = lambda i: F.regexp_extract("line", P.CATALOG_LINE, i)
    return x.select("document_id", "page", "line_no", F.concat(F.lit("tpl_"), F.replace(get(1), F.lit("."), F.lit("_"))).alias("template_code"),
                    get(2).alias("template_name"), "category_lv1", "category_lv2", get(3).cast("long").alias("catalog_page"))


def page_offset(catalog: DataFrame, pages: DataFrame, first: int | None = None, contents_pages: int = P.CONTENTS_PAGES) -> DataFrame:
    """Shift between printed and real page numbers, from the first leading title found in the body."""
    lead = (catalog if first is None else catalog.where(F.col("idx") <= first)).select("document_id", "idx", "catalog_page", X.clean_text("template_name").alias("_name")).where(F.length("_name") > 0)
    body = pages.where(F.col("page") > contents_pages)
    hit = lead.join(body, "document_id").where(F.col("page_text").contains(F.col("_name")))
    best = hit.groupBy("document_id").agg(F.min_by(F.col("page") - F.col("catalog_page"), F.struct("idx", "page")).alias("offset"))
    return pages.select("document_id").distinct().join(best, "document_id", "left").withColumn("offset", F.coalesce("offset", F.lit(0)))


def template_ranges(catalog: DataFrame, offsets: DataFrame, page_counts: DataFrame) -> DataFrame:
    """Page range of each template: up to the page before the next one, or the last page."""
    from pyspark.sql import Window
    c = catalog.join(offsets, "document_id").join(page_counts, "document_id")
    start = F.col("catalog_page") + F.col("offset")
    w = Window.partitionBy("document_id").orderBy("idx")
    end = F.coalesce(F.lead(start).over(w) - 1, F.col("page_count"))
    return c.withColumn("start_page", F.greatest(F.lit(1), start)).withColumn("end_page", F.greatest(start, end)).drop("offset", "page_count")


def template_text(ranges: DataFrame, pages: DataFrame) -> DataFrame:
    """Text of the pages in each range; the range is expanded to pages so the join is an equi join."""
    r = ranges.select("document_id", "idx", F.explode(F.when(F.col("start_page") <= F.col("end_page"), F.sequence("start_page", "end_page"))).alias("page"))
    t = r.join(pages, ["document_id", "page"])
    return t.groupBy("document_id", "idx").agg(X.clean_text(O.joined_list("page_text", ["page"], "\n\n")).alias("text"))


def catalog_dedupe(catalog: DataFrame) -> DataFrame:
    name = F.coalesce(F.nullif("template_name", F.lit("")), F.col("template_id"), F.lit(""))
    c = catalog.withColumn("_n", name).withColumn("_s", F.coalesce("start_page", F.lit(1))).withColumn("_e", F.coalesce("end_page", F.lit(1)))
    return O.first_by(c, ["document_id", "_n", "_s", "_e"], ["idx"]).drop("_n", "_s", "_e")
