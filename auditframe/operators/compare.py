"""Template comparison, evidence location and issue targets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import params as P
from ..functions import ordered as O
from ..functions import similarity as M
from ..functions import text as X
from ..session import stage
from .retrieval import substring_pairs
from .structure import PAGE

TEMPLATE_CHUNK, CONTRACT_CHUNK = 128, 128
#: What a pack of contracts holds at most on average; it decides the units of work, never the result.
PACK_CHARS, PACK_CLAUSES, PACK_TASKS = 1 << 18, 2048, 1024
TARGET_CHUNK, PAGE_CHUNK = 64, 8


def _packed(df: DataFrame, keys: list[str], ord_col: str, size: int, fields: list) -> DataFrame:
    """Rows of a key packed into arrays by order range; a chunk holds at most ``size`` order values."""
    chunk = F.floor(F.col(ord_col) / size)
    items = F.array_sort(F.collect_list(F.struct(F.col(ord_col).alias("ord"), *fields)))
    return df.groupBy(*keys, chunk.alias("_chunk")).agg(items.alias("items"))


def spread(df: DataFrame, *keys) -> DataFrame:
    """Even out rows that are each a bounded but heavy unit of Python work; an explicit
    number keeps the runtime from merging them back because their bytes are few."""
    spark = df.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return df.repartition(4 * n, *keys)


def best_clause_match(contract: DataFrame, template: DataFrame, matched: DataFrame) -> DataFrame:
    """Per template clause of the matched template the best contract clause, when it reaches the threshold.

    contract: task_id, clause_id, sort_order, title, raw_text, core_label
    template: template_id, clause_id, ord, title, content, clause_type
    matched:  task_id, template_id

    A template's contracts are dealt out in packs of about PACK_CHARS characters, and a pack meets the template in chunks: such a
    pair is one row, which holds each text once, and returns one row per task and template clause that reaches the threshold.  So
    the clause pairs are never materialised, a contract or template of any size is many units of work, and a template that all
    contracts match is no hot key, neither here nor when its clauses are listed for each contract.
    """
    cut = lambda c: X.text_of(c) if P.CONTENT_CHARS is None else F.substring(X.text_of(c), 1, P.CONTENT_CHARS)
    matched = matched.select("task_id", "template_id")
    c = contract.select("task_id", "clause_id", F.col("sort_order").alias("ord"), X.text_of("title").alias("title"), "core_label", X.text_of("raw_text").alias("raw"))
    c = stage(c.join(matched, "task_id").withColumn("length", F.length("raw")))  # measured, then packed
    load = c.groupBy("template_id").agg((F.sum("length") / PACK_CHARS).alias("_by_chars"), (F.count(F.lit(1)) / PACK_CLAUSES).alias("_by_clauses"))
    load = matched.groupBy("template_id").agg((F.count(F.lit(1)) / PACK_TASKS).alias("_by_tasks")).join(load, "template_id", "left")
    packs = F.ceil(F.greatest("_by_tasks", "_by_chars", "_by_clauses"))
    templates = template.join(load.select("template_id", packs.alias("_packs")), "template_id").select(
        "template_id", "_packs", "clause_id", "ord", X.text_of("title").alias("norm_title"), "title", "clause_type", "page_start", "content", F.length("content").alias("template_length"))
    templates = stage(templates)
    sizes = templates.select("template_id", "_packs").distinct()
    each = F.explode(F.sequence(F.lit(0).cast("long"), F.col("_packs") - 1)).alias("_pack")
    t = _packed(templates, ["template_id", "_packs"], "ord", TEMPLATE_CHUNK,
                ["clause_id", F.col("norm_title").alias("title"), X.normalize_title("norm_title").alias("norm"), cut("content").alias("content"), "clause_type"])
    t = t.select("template_id", each, F.col("_chunk").alias("tc"), F.col("items").alias("ts"))
    unit = F.pmod(F.xxhash64("task_id", F.floor(F.col("ord") / CONTRACT_CHUNK)), F.col("_packs")).alias("_pack")
    c = c.join(sizes, "template_id").select("template_id", unit, F.struct("task_id", "clause_id", "ord", "title", X.normalize_title("title").alias("norm"), cut("raw").alias("content"), "core_label", "length").alias("c"))
    c = c.groupBy("template_id", "_pack").agg(F.collect_list("c").alias("cs"))
    pairs = spread(c.join(t, ["template_id", "_pack"]), "template_id", "_pack", "tc").select("ts", "cs")

    def run(frames):
        import pandas as pd
        cols = ["task_id", "template_clause_id", "clause_id", "clause_ord", "score", "clause_length"]
        for pdf in frames:
            for ts, cs in zip(pdf["ts"], pdf["cs"]):
                yield pd.DataFrame(M.best_of_tasks(list(ts), list(cs)), columns=cols)

    found = pairs.mapInPandas(run, "task_id string, template_clause_id string, clause_id string, clause_ord long, score double, clause_length long")
    best = found.groupBy("task_id", "template_clause_id").agg(F.max_by(F.struct("clause_id", "clause_ord", "score", "clause_length"), F.struct("score", -F.col("clause_ord"))).alias("b"))
    want = matched.join(sizes, "template_id").select("task_id", "template_id", F.pmod(F.xxhash64("task_id"), F.col("_packs")).alias("_pack"))
    rows = templates.select("template_id", each, F.col("clause_id").alias("template_clause_id"), "ord", "title", "clause_type", "page_start", "template_length")
    return want.join(rows, ["template_id", "_pack"]).join(best, ["task_id", "template_clause_id"], "left").select(
        "task_id", "template_id", "template_clause_id", F.col("ord").alias("template_ord"), "title", "clause_type", "page_start", "template_length", "b.clause_id", "b.score", "b.clause_length")


def missing_clauses(match: DataFrame) -> DataFrame:
    return match.where(F.col("clause_id").isNull()).select("task_id", "template_clause_id", "template_ord", "title", "clause_type", F.col("page_start").alias("page"))


def weakened_clauses(match: DataFrame) -> DataFrame:
    ratio = F.greatest(F.lit(1), "clause_length") / F.greatest(F.lit(1), "template_length")
    w = match.where(F.col("clause_id").isNotNull() & ((F.col("score") < P.WEAK_BELOW) | (ratio < P.WEAK_LENGTH_RATIO)))
    return w.select("task_id", "template_clause_id", "template_ord", F.col("clause_id").alias("contract_clause_id"), "title", "clause_type", F.round("score", 4).alias("score"))


def additional_clauses(contract: DataFrame, match: DataFrame) -> DataFrame:
    used = match.where(F.col("clause_id").isNotNull()).select("task_id", "clause_id").distinct()
    return contract.join(used, ["task_id", "clause_id"], "left_anti").select("task_id", F.col("clause_id").alias("contract_clause_id"), "title", "page")


# --- evidence ---------------------------------------------------------------


def _placed(blocks: list, page, block_no, size: int) -> tuple:
    """Text and box of a run of blocks, by position inside its page."""
    rows = [b for b in blocks if b["page"] == page]
    run = [rows[q] for q in sorted(q for p, b in enumerate(rows) if b["block_no"] == block_no for q in range(p, min(p + size, len(rows))))]
    x, y = [min((b[c] for b in run if b[c] is not None), default=None) for c in ("x", "y")]
    right = max((b["x"] + b["width"] for b in run if b["x"] is not None and b["width"] is not None), default=None)
    low = max((b["y"] + (b["height"] or 24) for b in run if b["y"] is not None), default=None)
    return " ".join(b["text"] for b in run if b["text"] is not None).strip(" "), x, y, None if right is None else right - x, None if low is None else low - y


def locate_evidence_text(targets: DataFrame, blocks: DataFrame) -> DataFrame:
    """Best run of one to four consecutive blocks for each target text.

    targets: task_id, target_id, ord, text, page_hint; blocks: task_id, page, block_no, text, box.
    Target chunks meet page chunks of the same task; each pair returns its best run per target with its text and box, so neither
    texts nor blocks are looked up again.  The hinted pages go first: both sides are dealt out once by task and page chunk.  A target
    found there with certainty is done; the others are searched in the other pages, and the first maximum over all pairs is an aggregate.
    """
    spark = targets.sparkSession
    n = 4 * max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    key, box = ["task_id", "target_id"], ["x", "y", "width", "height"]
    kind = dict(blocks.select("page", "block_no", "x", "y", (F.col("x") + F.col("width")).alias("width"), (F.col("y") + F.coalesce("height", F.lit(24))).alias("height")).dtypes)
    placed = f"page {kind['page']}, block_no {kind['block_no']}, size int, score double, evidence_text string, {', '.join(f'{c} {kind[c]}' for c in box)}"
    own, pc = F.floor(F.col("page_hint") / PAGE_CHUNK), F.floor(F.col("page") / PAGE_CHUNK)
    t = targets.select(*key, "ord", F.col("page_hint").cast("long").alias("page_hint"), "text").withColumn("pc", own)
    b = blocks.select("task_id", pc.alias("pc"), F.struct("page", "block_no", "text", *box).alias("b"))
    # what is compared is made of the texts after they have been dealt out
    packed = lambda df: df.groupBy("task_id", "pc").agg(F.array_sort(F.collect_list("b")).alias("bs")).withColumn(
        "bs", F.transform("bs", lambda v: F.struct(*[v[c].alias(c) for c in ("page", "block_no", "text", *box)], X.normalize_match(v["text"]).alias("norm"))))

    def search(whole, names):
        def rows(task, ts, bs):
            bs = [] if bs is None else list(bs)
            ts = [{k: t[k] for k in ("target_id", "ord", "page_hint", "text", "norm", "floor")} for t in ts]
            asked = [i for i, t in enumerate(ts) if t["target_id"] is not None]
            found = {i: r for i, *r in M.best_runs([ts[i] | {"target_id": i} for i in asked], bs)}
            for i, t in enumerate(ts):
                if i in found:
                    page, block_no, size, score = found[i]
                    at = (page, block_no, size, score, *_placed(bs, page, block_no, size))
                else:
                    at = (None, None, None, -1.0, None, None, None, None, None)
                if whole:  # a row for each target, with what a further search needs
                    yield task, t["target_id"], t["ord"], t["page_hint"], None if i in found else t["text"], None if at[3] > 1.0 else t["norm"], *at
                elif i in found:
                    yield task, t["target_id"], *at

        def run(frames):
            import pandas as pd
            for pdf in frames:
                yield pd.DataFrame([r for task, ts, bs in zip(pdf["task_id"], pdf["ts"], pdf["bs"]) for r in rows(task, ts, bs)], columns=names, dtype="object")
        return run

    columns = lambda schema: [c.split()[0] for c in schema.split(", ")]
    fields = lambda floor: ["target_id", "page_hint", "text", "norm", floor.alias("floor")]
    # 1: the pages around the hint
    near = t.repartition(n, "task_id", "pc").withColumn("norm", X.normalize_match("text"))
    near = _packed(near, ["task_id", "pc"], "ord", TARGET_CHUNK, fields(F.lit(-1.0))).join(packed(b.repartition(n, "task_id", "pc")), ["task_id", "pc"], "left")
    schema = f"task_id string, target_id string, ord {dict(targets.dtypes)['ord']}, page_hint long, text string, norm string, {placed}"
    # written: the second search and the choice of the best read it, and the comparisons shall run once
    found = stage(near.select("task_id", F.col("items").alias("ts"), "bs").mapInPandas(search(True, columns(schema)), schema))
    shown = lambda df: df.select(*key, "page", "evidence_text", *box, "score")
    open_, sure = F.col("score") <= 1.0, shown(found.where(F.col("score") > 1.0))
    repeated = not found.groupBy(*key).count().where("count > 1").isEmpty()  # rows of one key share their best run
    if not repeated and found.where(open_).isEmpty():
        return sure
    # 2: other pages, only for targets whose score can still be beaten
    rest = found.where(open_ & F.col("target_id").isNotNull()).withColumn("own", own)
    far = _packed(rest, ["task_id", "own"], "ord", TARGET_CHUNK, fields(F.col("score"))).withColumnRenamed("_chunk", "tc")
    tasks = stage(rest.select("task_id").distinct())
    others = packed(b.join(tasks, "task_id", "left_semi")).withColumnRenamed("task_id", "btask")
    pairs = far.join(others, (F.col("task_id") == F.col("btask")) & (F.col("own") != F.col("pc"))).select("task_id", "tc", "pc", F.col("items").alias("ts"), "bs")
    schema = f"task_id string, target_id string, {placed}"
    better = spread(pairs, "task_id", "tc", "pc").select("task_id", "ts", "bs").mapInPandas(search(False, columns(schema)), schema)
    mine = found if repeated else found.where(open_)
    runs = mine.where(F.col("page").isNotNull()).select(*better.columns).unionByName(better)
    best = runs.groupBy(*key).agg(F.min_by(F.struct("page", "evidence_text", *box, "score"), F.struct((-F.col("score")).alias("s"), "page", "block_no", "size")).alias("r")).select(*key, "r.*")
    first = blocks.groupBy("task_id").agg(F.min("page").alias("_p"))
    r = mine.select(*key, F.coalesce("text", "evidence_text").alias("_t")).join(best, key, "left").join(first, "task_id", "left")
    rest = r.select(*key, F.coalesce("page", "_p", F.lit(1)).alias("page"), F.coalesce("evidence_text", "_t").alias("evidence_text"), F.coalesce("x", F.lit(40)).alias("x"), F.coalesce("y", F.lit(40)).alias("y"),
                    F.coalesce("width", F.lit(200)).alias("width"), F.coalesce("height", F.lit(40)).alias("height"), "score")
    return rest if repeated else sure.unionByName(rest)


def evidence_segments(targets: DataFrame, blocks: DataFrame, text_chars: int | None = None) -> DataFrame:
    """Given block ids, in order, cut where the page changes or the gap is large; an id listed twice counts at its last place.

    targets: task_id, target_id, block_ids, page_hint.
    """
    from pyspark.sql import Window
    ids = targets.select("task_id", "target_id", "page_hint", F.posexplode("block_ids").alias("pos", "block_id"))
    ids = ids.groupBy("task_id", "target_id", "page_hint", "block_id").agg(F.max("pos").alias("pos"))
    j = ids.join(blocks.select("task_id", "block_id", "page", "text", "x", "y", "width", F.coalesce(F.nullif("height", F.lit(0)), F.lit(24)).alias("height")), ["task_id", "block_id"])
    key = ["task_id", "target_id"]
    w = Window.partitionBy(*key).orderBy("pos")
    p = {c: F.lag(c).over(w) for c in ("page", "x", "y", "width", "height")}
    gap = F.col("y") - (p["y"] + p["height"])
    tall = F.greatest(p["height"], "height")
    cut = p["page"].isNull() | (p["page"] != F.col("page")) | (gap > tall * 2.6) | ((gap > tall * 1.4) & (F.abs(F.col("x") - p["x"]) > F.greatest(p["width"], "width") * 0.35))
    s = O.islands(j.withColumn("_cut", cut), key, ["pos"], F.col("_cut"), "seg")
    stripped = F.nullif(X.strip("text"), F.lit(""))
    g = s.groupBy(*key, "page_hint", (F.col("seg") - 1).alias("segment_index")).agg(
        F.min("page").alias("page"), F.min("x").alias("x"), F.min("y").alias("y"), (F.max(F.col("x") + F.col("width")) - F.min("x")).alias("width"),
        (F.max(F.col("y") + F.col("height")) - F.min("y")).alias("height"), (O.joined_list(stripped, ["pos"], "\n") if text_chars is None else F.substring(O.joined_list(stripped, ["pos"], "\n"), 1, text_chars)).alias("text"),
        F.count(F.lit(1)).alias("n_blocks"), F.sum(F.length(X.strip("text"))).alias("text_len"))
    return g.join(g.groupBy(*key).agg(F.count(F.lit(1)).alias("segment_count")), key)


def primary_segment(segments: DataFrame) -> DataFrame:
    """Marks the segment with most text and blocks (hinted page preferred); first wins."""
    score = F.col("text_len") + F.col("n_blocks") * 20 + F.when(F.col("page") == F.col("page_hint"), 200).otherwise(0)
    best = segments.groupBy("task_id", "target_id").agg(F.min_by("segment_index", F.struct((-score).alias("s"), "segment_index")).alias("_primary"))
    return segments.join(best, ["task_id", "target_id"]).withColumn("is_primary", F.col("segment_index") == F.col("_primary")).drop("_primary")


EVIDENCE_COLUMNS = ["task_id", "evidence_id", "source_type", "source_id", "page", "x", "y", "width", "height", "text", "segment_index", "segment_count", "is_primary", "accent"]


def evidence_targets(sections: DataFrame, clauses: DataFrame, facts: DataFrame) -> DataFrame:
    """One target list over the three kinds of findings; absent block ids become an empty array."""
    ids = lambda df: (F.col("block_ids") if "block_ids" in df.columns else F.array().cast("array<string>")).alias("block_ids")
    s = sections.select("task_id", F.lit("section").alias("source_type"), F.col("section_id").alias("source_id"), F.concat_ws(" ", "title", "summary").alias("text"), F.col("page").alias("page_hint"), F.lit("cyan").alias("accent"), ids(sections), F.col("sort_order").alias("ord"))
    c = clauses.select("task_id", F.lit("clause").alias("source_type"), F.col("clause_id").alias("source_id"), F.coalesce(F.nullif("raw_text", F.lit("")), F.col("summary")).alias("text"), F.col("page").alias("page_hint"),
                       F.when(F.col("need_review"), "amber").otherwise("cyan").alias("accent"), ids(clauses), F.col("sort_order").alias("ord"))
    f = facts.select("task_id", F.lit("fact").alias("source_type"), F.col("fact_id").alias("source_id"), F.concat_ws(" ", "label", "value").alias("text"), F.col("page").alias("page_hint"), F.lit("cyan").alias("accent"), ids(facts), F.col("ord"))
    return s.unionByName(c).unionByName(f).withColumn("target_id", F.concat(F.lit("ev_"), "source_id"))


def attach_evidence(targets: DataFrame, blocks: DataFrame) -> DataFrame:
    """Evidence rows: by block ids where they resolve, by text otherwise."""
    targets = stage(targets)  # made of three tables and read four times
    seg = stage(primary_segment(evidence_segments(targets.where(F.size("block_ids") > 0), blocks)))
    info = targets.select("task_id", "target_id", "source_type", "source_id", "accent")
    by_ids = seg.join(info, ["task_id", "target_id"]).select("task_id", F.col("target_id").alias("evidence_id"), "source_type", "source_id", "page", "x", "y", "width", "height", "text", "segment_index", "segment_count", "is_primary", "accent")
    rest = targets.join(seg.select("task_id", "target_id").distinct(), ["task_id", "target_id"], "left_anti")
    loc = locate_evidence_text(rest, blocks).join(info, ["task_id", "target_id"])
    by_text = loc.select("task_id", F.col("target_id").alias("evidence_id"), "source_type", "source_id", "page", "x", "y", "width", "height", F.col("evidence_text").alias("text"),
                         F.lit(0).cast("long").alias("segment_index"), F.lit(1).cast("long").alias("segment_count"), F.lit(True).alias("is_primary"), "accent")
    return by_ids.select(*EVIDENCE_COLUMNS).unionByName(by_text.select(*EVIDENCE_COLUMNS))


def evidence_index(evidence: DataFrame) -> DataFrame:
    """One evidence per id: the last primary in page order, else the first row."""
    rest = [c for c in evidence.columns if c not in ("task_id", "evidence_id")]
    pos = F.struct("page", "segment_index")
    e = evidence.groupBy("task_id", "evidence_id").agg(F.max_by(F.struct(*rest), F.when(F.col("is_primary"), pos)).alias("_p"), F.min_by(F.struct(*rest), pos).alias("_f"))
    return e.select("task_id", "evidence_id", F.coalesce("_p", "_f").alias("_b")).select("task_id", "evidence_id", "_b.*")


def last_evidence(evidence: DataFrame) -> DataFrame:
    """One evidence per id: the last one in page order; of equal places the last by source, where it has one."""
    rest = [c for c in evidence.columns if c not in ("task_id", "evidence_id")]
    place = [c for c in ("page", "segment_index", "source_type", "source_id") if c in rest]
    e = evidence.groupBy("task_id", "evidence_id").agg(F.max_by(F.struct(*rest), F.struct(*place)).alias("_b"))
    return e.select("task_id", "evidence_id", "_b.*")


def page_scope(candidates: DataFrame, pages: DataFrame, radius: int) -> DataFrame:
    """Pages within the radius of any candidate page, else the first three pages of the task."""
    p = F.col("page").cast("string").try_cast("long")
    near = candidates.select("task_id", p.alias("p")).where(F.col("p").isNotNull()).distinct()
    near = near.select("task_id", F.explode(F.sequence(F.greatest(F.lit(1), F.col("p") - radius), F.greatest(F.lit(1), F.col("p") - radius) + F.lit(2 * radius))).alias("page"), F.col("p"))
    near = near.where(F.col("page") <= F.col("p") + radius).select("task_id", "page").distinct()
    pages = pages.select("task_id", "page").distinct()
    ends = pages.groupBy("task_id").agg(F.max("page").alias("_max"))
    in_reach = near.join(ends, "task_id").where(F.col("page") <= F.col("_max")).select("task_id", "page")
    kept = pages.join(in_reach, ["task_id", "page"], "left_semi")
    rest = pages.join(in_reach.select("task_id").distinct(), "task_id", "left_anti")
    return kept.unionByName(O.top_k(rest, ["task_id"], ["page"], 3, "_r").drop("_r"))


def grounding_merge(replies: DataFrame) -> DataFrame:
    """Model-returned candidates to block ids, from the first filled alias; the last reply of a candidate wins.

    replies: task_id, reply_no, candidate_id, block_ids, evidence_block_ids, supporting_block_ids (strings or JSON lists).
    """
    def ids(c):
        listed = F.from_json(c, "array<string>")
        return F.when(F.trim(c).startswith("["), F.array_distinct(F.filter(F.transform(listed, X.strip), lambda x: x != ""))).otherwise(X.block_id_list(c))
    filled = F.coalesce(*[F.when(F.length(X.text_of(c)) > 2, F.col(c)) for c in ("block_ids", "evidence_block_ids", "supporting_block_ids")])
    r = replies.select("task_id", "reply_no", X.strip(X.text_of("candidate_id")).alias("candidate_id"), ids(filled).alias("ids"))
    r = r.where((F.col("candidate_id") != "") & (F.size("ids") > 0))
    return r.groupBy("task_id", "candidate_id").agg(F.max_by("ids", "reply_no").alias("block_ids"))


# --- issue targets ----------------------------------------------------------


def issue_target(issues: DataFrame, clauses: DataFrame, facts: DataFrame, evidence: DataFrame, n_clauses: int | None = None, n_facts: int | None = None, excerpt_chars: int | None = None) -> DataFrame:
    """Best clause with evidence, else best fact with evidence, that an issue speaks about (or among the leading ones only).

    issues: task_id, issue_id, problem, clause_location, source_rule_name, matched_title, no_direct_evidence.
    Only real containments are joined: tokens, hints and titles of a contract are looked up as
    substrings in the texts of that contract alone, so work is linear in the contracts.
    """
    key = ["task_id", "issue_id"]
    issues = stage(issues)  # read by every lookup below
    live = issues.where(~F.coalesce("no_direct_evidence", F.lit(False)))
    tokens = live.select(*key, F.explode(X.search_tokens("problem", "clause_location", "source_rule_name", "matched_title")).alias("needle"))
    tokens = tokens.withColumn("w", F.least(F.length("needle"), F.lit(8)).cast("double"))
    hints = live.select(*key, X.location_hint("clause_location").alias("needle")).where(F.length("needle") > 0)
    titles = live.select(*key, F.col("matched_title").alias("needle")).where(F.length("needle") > 0)

    def scored(target, id_col, hay, needles, extra=None):
        pairs = substring_pairs(target.select("task_id", id_col, hay.alias("hay")), id_col, "hay", needles, "needle", ("task_id",))
        s = pairs.join(needles, ["task_id", "needle"]).select(*key, id_col, "w")
        if extra is not None:
            s = s.unionByName(extra)
        return s.groupBy(*key, id_col).agg(F.sum("w").alias("score"))

    hay = F.concat_ws("\n", "title", "summary", "raw_text", "label", "core_label")
    clause_needles = tokens.unionByName(hints.withColumn("w", F.lit(5.0))).unionByName(titles.withColumn("w", F.lit(6.0)))
    probs = live.select("task_id", F.col("problem").alias("pid"), F.col("problem").alias("ptext")).distinct()
    named = substring_pairs(probs, "pid", "ptext", clauses.select("task_id", F.col("title").alias("needle")), "needle", ("task_id",))
    by_title = live.select(*key, F.col("problem").alias("pid")).join(named, ["task_id", "pid"]).join(clauses.select("task_id", "clause_id", F.col("title").alias("needle")), ["task_id", "needle"])
    by_title = by_title.select(*key, "clause_id", F.lit(4.0).alias("w"))
    cs = scored(clauses, "clause_id", hay, clause_needles, by_title).join(clauses.select("task_id", "clause_id", "sort_order"), ["task_id", "clause_id"])
    # places without their texts: candidates are many
    ev = last_evidence(evidence.select("task_id", "evidence_id", "source_type", "source_id", "page", "segment_index"))
    ev = ev.select("task_id", "evidence_id", F.col("source_type").alias("_st"), F.col("source_id").alias("_sid"), "page")
    best_first = lambda s, col, n: s.withColumn("rank", F.struct((-F.col("score")).alias("s"), F.col(col).alias("o"))) if n is None else O.top_k(s, key, [F.desc("score"), F.col(col)], n)
    found_c = best_first(cs, "sort_order", n_clauses).join(ev.where(F.col("_st") == "clause").withColumnRenamed("_sid", "clause_id"), ["task_id", "clause_id"])
    fact_hay = F.concat_ws("\n", "label", "value", F.coalesce("notes", F.lit("")))
    fs = scored(facts, "fact_id", fact_hay, tokens.unionByName(hints.withColumn("w", F.lit(4.0)))).join(facts.select("task_id", "fact_id", "ord"), ["task_id", "fact_id"])
    found_f = best_first(fs, "ord", n_facts).join(ev.where(F.col("_st") == "fact").withColumnRenamed("_sid", "fact_id"), ["task_id", "fact_id"])
    cand = found_c.select(*key, F.lit(0).alias("tier"), "rank", "clause_id", F.lit(None).cast("string").alias("fact_id"), "evidence_id", "page").unionByName(
        found_f.select(*key, F.lit(1).alias("tier"), "rank", F.lit(None).cast("string").alias("clause_id"), "fact_id", "evidence_id", "page"))
    best = cand.groupBy(*key).agg(F.min_by(F.struct("clause_id", "fact_id", "evidence_id", "page"), F.struct("tier", "rank")).alias("b"))
    # texts are handed to the chosen evidence only, not to every candidate, and move no further; an issue without one has a key of its own
    excerpt = (F.col("text") if excerpt_chars is None else F.substring("text", 1, excerpt_chars)).alias("excerpt")
    out = issues.select(*key, "no_direct_evidence").join(best, key, "left").withColumn("_ev", F.coalesce("b.evidence_id", F.concat(F.lit("\0"), "issue_id")))
    out = out.join(last_evidence(evidence).select("task_id", F.col("evidence_id").alias("_ev"), excerpt), ["task_id", "_ev"], "left")
    note = F.when(F.coalesce("no_direct_evidence", F.lit(False)), "这是缺失或规则类问题，待审合同中没有可直接定位的对应原文证据。").when(F.col("b").isNull(), "未能定位到对应原文。")
    return out.select(*key, "b.clause_id", "b.fact_id", "b.evidence_id", "b.page", "excerpt", note.alias("note"))
