"""Layout and document structure (survey section 2.3)."""

from pyspark.sql import functions as F

from auditframe import params as P
from auditframe.functions import text as X
from auditframe.operators import structure as D
from auditframe.plans import bridge as B

from . import sqlkit as S
from .registry import query

HEAD = f"((length({S.strip('text')}) <= 24 AND regexp_matches({S.strip('text')}, '^[一二三四五六七八九十]、')) OR (length({S.strip('text')}) <= 26 AND {S.has('text', P.LAYOUT_HEADING_TOKENS)}))"


@B.memo
def lines(spark, sf):
    b = B.blocks(spark, sf)
    return b.select("task_id", "page", F.col("block_no").alias("line_no"), F.col("block_id").alias("line_id"), "text", "x", "y", "width", "height", "score")


@B.memo
def blocks(spark, sf):
    return B.blocks(spark, sf).withColumn("emphasis", X.is_heading_layout("text"))


LAYOUT = """WITH l AS (SELECT *, block_no AS line_no, lag(x) OVER w AS px, lag(y) OVER w AS py, lag(height) OVER w AS ph FROM blocks WINDOW w AS (PARTITION BY task_id, page ORDER BY y, x, block_no)),
    g AS (SELECT *, sum(CASE WHEN y - (py + ph) <= greatest(ph, height) * 1.2 AND abs(x - px) < 48 THEN 0 ELSE 1 END) OVER (PARTITION BY task_id, page ORDER BY y, x, block_no) AS k FROM l)"""


@query("lines_to_blocks", LAYOUT + """ SELECT task_id, page, k::BIGINT AS block_index, min(x)::BIGINT AS x, min(y)::BIGINT AS y, (max(x + width) - min(x))::BIGINT AS width, (max(y + height) - min(y))::BIGINT AS height,
    trim(string_agg(text, ' ' ORDER BY y, x, block_no)) AS text, count(*)::BIGINT AS n_lines, 'paddle_' || printf('%03d', page) || '_' || printf('%03d', k::BIGINT) AS block_id FROM g GROUP BY task_id, page, k""")
def _(spark, sf):
    return D.lines_to_blocks(lines(spark, sf)).drop("emphasis")


@query("ocr_quality", """SELECT *, (mean_score < 0.82 OR (mean_score < 0.90 AND short_ratio > 0.55) OR (mean_score < 0.93 AND n_lines >= 45 AND fragment_ratio > 0.72)) AS needs_enhancement
    FROM (SELECT task_id, page, count(*)::BIGINT AS n_lines, round(avg(score), 6) AS mean_score, round(avg(CASE WHEN length(trim(text)) <= 2 THEN 1.0::DOUBLE ELSE 0 END), 6) AS short_ratio,
    round(avg(CASE WHEN length(trim(text)) <= 6 THEN 1.0::DOUBLE ELSE 0 END), 6) AS fragment_ratio FROM blocks GROUP BY task_id, page)""")
def _(spark, sf):
    return D.ocr_quality(lines(spark, sf).withColumn("score", F.round("score", 2)))


@query("page_route", "SELECT task_id, page, sum(length(trim(text)))::BIGINT AS text_len, CASE WHEN sum(length(trim(text))) >= 60 THEN 'text' ELSE 'ocr' END AS route FROM blocks GROUP BY task_id, page")
def _(spark, sf):
    return D.page_route(B.blocks(spark, sf))


GROUPS = """gr AS (SELECT task_id, page, block_no % 2 AS group_no, list('b_' || doc_id || '_' || block_no ORDER BY block_no) AS ids FROM blocks GROUP BY task_id, page, doc_id, block_no % 2
    UNION ALL SELECT task_id, page, 10 + block_no // 2 AS group_no, list(block_id ORDER BY block_no) AS ids FROM blocks GROUP BY task_id, page, block_no // 2)"""


@B.memo
def groups(spark, sf):
    """Proposals: interleaved lines (never contiguous when there are two) and neighbouring pairs."""
    b = B.blocks(spark, sf)
    odd = b.withColumn("group_no", F.col("block_no") % 2)
    pair = b.withColumn("group_no", 10 + F.floor(F.col("block_no") / 2))
    arr = F.transform(F.array_sort(F.collect_list(F.struct("block_no", "block_id"))), lambda s: s["block_id"])
    return odd.unionByName(pair).groupBy("task_id", "page", "group_no").agg(arr.alias("line_ids"))


@query("alignment_blocks", "WITH " + GROUPS + """,
    e AS (SELECT task_id, page, group_no, unnest(ids) AS block_id, unnest(range(len(ids))) AS pos, len(ids) AS n FROM gr),
    m AS (SELECT e.task_id, e.page, e.group_no, min(b.x) AS x, min(b.y) AS y, max(b.x + b.width) - min(b.x) AS width, max(b.y + b.height) - min(b.y) AS height,
      trim(string_agg(b.text, ' ' ORDER BY pos)) AS text FROM e JOIN blocks b ON b.block_id = e.block_id AND b.task_id = e.task_id AND b.page = e.page
      GROUP BY e.task_id, e.page, e.group_no HAVING min(b.block_no - pos) = max(b.block_no - pos)),
    st AS (SELECT task_id, page FROM m GROUP BY task_id, page HAVING NOT (sum(CASE WHEN height > 24 * 4.5 THEN 1 ELSE 0 END) > greatest(1, count(*) // 4)
      OR sum(CASE WHEN length(trim(text)) <= 1 THEN 1 ELSE 0 END) > greatest(2, count(*) // 3))),
    o AS (SELECT task_id, page, 'hybrid_' || printf('%03d', page) || '_' || printf('%03d', group_no) AS block_id, text, x, y, width, height, 0 AS tier, group_no AS seq FROM m SEMI JOIN st USING (task_id, page)
      UNION ALL SELECT task_id, page, 'hybrid_tail_' || block_id, trim(text), x, y, width, height, 1, block_no FROM blocks b SEMI JOIN st USING (task_id, page)
      WHERE NOT EXISTS (SELECT 1 FROM e JOIN m ON e.task_id = m.task_id AND e.page = m.page AND e.group_no = m.group_no WHERE e.block_id = b.block_id))
    SELECT task_id, page, block_id, text, x::BIGINT AS x, y::BIGINT AS y, width::BIGINT AS width, height::BIGINT AS height, row_number() OVER (PARTITION BY task_id, page ORDER BY y, x, tier, seq) AS block_no FROM o""")
def _(spark, sf):
    return D.alignment_blocks(lines(spark, sf), groups(spark, sf))


@query("alignment_unstable", LAYOUT + """, m AS (SELECT task_id, page, k, max(y + height) - min(y) AS height, trim(string_agg(text, ' ')) AS text FROM g GROUP BY task_id, page, k)
    SELECT task_id, page, avg(24.0::DOUBLE) * 0 + count(*)::BIGINT AS n_blocks_d, sum(CASE WHEN height > 24 * 4.5 THEN 1 ELSE 0 END)::BIGINT AS oversized, sum(CASE WHEN length(text) <= 1 THEN 1 ELSE 0 END)::BIGINT AS tiny,
    (sum(CASE WHEN height > 24 * 4.5 THEN 1 ELSE 0 END) > greatest(1, count(*) // 4) OR sum(CASE WHEN length(text) <= 1 THEN 1 ELSE 0 END) > greatest(2, count(*) // 3)) AS unstable FROM m GROUP BY task_id, page""")
def _(spark, sf):
    ln = lines(spark, sf)
    return D.alignment_unstable(ln, D.lines_to_blocks(ln)).withColumn("n_blocks_d", F.col("n_blocks").cast("double")).drop("n_blocks")


@query("flow_blocks", """WITH h AS (SELECT *, 47 * (length(text) // 28 + 1) AS hh FROM blocks),
    c AS (SELECT *, 98 + coalesce(sum(hh + 21) OVER (PARTITION BY task_id, page ORDER BY block_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cy, row_number() OVER (PARTITION BY task_id, page ORDER BY block_no) AS rn FROM h)
    SELECT task_id, page, rn::BIGINT AS block_no, 'vl_' || printf('%03d', page) || '_' || printf('%03d', rn) AS block_id, text, 115::BIGINT AS x, least(cy, greatest(98, 1960 - hh - 98))::BIGINT AS y, 1210::BIGINT AS width, hh::BIGINT AS height FROM c""")
def _(spark, sf):
    p = B.blocks(spark, sf).select("task_id", "page", F.col("block_no").alias("para_no"), "text")
    dims = p.select("task_id", "page").distinct().select("task_id", "page", F.lit(1440).alias("page_width"), F.lit(1960).alias("page_height"))
    return D.flow_blocks(p, dims).drop("emphasis")


@query("page_paragraphs", f"""SELECT task_id, page, para_no, text FROM (
    SELECT task_id, 1::BIGINT AS page, unnest(range(1, len(ls) + 1))::BIGINT AS para_no, unnest(ls) AS text FROM (
      SELECT task_id, list_filter(string_split({S.clean_lines('raw')}, chr(10)), lambda x: x <> '') AS ls FROM docs))""")
def _(spark, sf):
    d = B.documents(spark, sf)
    given = F.when(F.col("doc_type") == "policy", F.split("text", "\n"))
    return D.page_paragraphs(d.select("task_id", F.lit(1).alias("page"), given.alias("paragraphs"), F.col("text").alias("full_text")))


PSRC = """WITH p AS (SELECT task_id, page, count(*) AS n, sum(length(text)) AS chars FROM blocks GROUP BY task_id, page),
    c AS (SELECT *, CASE WHEN chars % 3 > 0 THEN n ELSE 0 END AS para, CASE WHEN chars % 5 > 0 THEN n ELSE 0 END AS lin, CASE WHEN chars % 2 > 0 THEN 1 ELSE 0 END AS ali, CASE WHEN chars % 7 > 2 THEN 1 ELSE 0 END AS flo, CASE WHEN chars % 11 > 5 THEN 1 ELSE 0 END AS fal FROM p),
    s AS (SELECT *, CASE WHEN ali > 0 AND lin > 0 AND para > 0 THEN 'aligned' WHEN flo > 0 AND para > 0 THEN 'flow_primary' WHEN lin > 0 THEN 'layout' WHEN fal > 0 THEN 'fallback' ELSE 'none' END AS source FROM c),
    t AS (SELECT task_id, page, source, list_filter([CASE WHEN para > 0 THEN 'qwen_vl_semantic' END, CASE WHEN source = 'layout' THEN 'paddle_ocr' END, CASE WHEN source = 'aligned' THEN 'qwen_text_anchor' END,
      CASE WHEN source = 'flow_primary' THEN 'qwen_vl_primary' END, CASE WHEN source = 'fallback' THEN 'qwen_vl_only' END], lambda v: v IS NOT NULL) AS steps FROM s)"""


def page_sources(spark, sf):
    p = B.blocks(spark, sf).groupBy("task_id", "page").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("c"))
    flag = lambda m, over: (F.col("c") % m > over).cast("long")
    return D.page_blocks_source(p.select("task_id", "page", (flag(3, 0) * F.col("n")).alias("n_paragraphs"), (flag(5, 0) * F.col("n")).alias("n_lines"),
                                         flag(2, 0).alias("n_aligned"), flag(7, 2).alias("n_flow"), flag(11, 5).alias("n_fallback")))


@query("page_blocks_source", PSRC + """ SELECT task_id, page, source, array_to_string(steps, '|') AS steps, CASE source WHEN 'flow_primary' THEN 'Page ' || page || ' used VL-primary OCR with approximate boxes'
    WHEN 'fallback' THEN 'Page ' || page || ' used VL-only OCR fallback' WHEN 'none' THEN 'Page ' || page || ' OCR needs manual review: no text extracted' END AS warning FROM t""")
def _(spark, sf):
    return page_sources(spark, sf).select("task_id", "page", "source", "steps", "warning")


@query("document_pipeline", PSRC + """ SELECT task_id, coalesce(nullif(string_agg(DISTINCT st, '+' ORDER BY st), ''), 'pdf_text') AS pipeline FROM (SELECT task_id, unnest(CASE WHEN len(steps) = 0 THEN [''] ELSE steps END) AS st FROM t)
    GROUP BY task_id HAVING TRUE""")
def _(spark, sf):
    s = page_sources(spark, sf).withColumn("steps", F.when(F.size("steps") == 0, F.array(F.lit(""))).otherwise(F.col("steps")))
    return D.document_pipeline(s)


@query("page_title", f"""SELECT task_id, page, coalesce(arg_min(CASE WHEN {HEAD} AND length(text) <= 32 THEN text ELSE left(text, 32) END, (CASE WHEN {HEAD} AND length(text) <= 32 THEN 0 ELSE 1 END) * 1000000 + block_no), '') AS title FROM blocks GROUP BY task_id, page""")
def _(spark, sf):
    return D.page_title(blocks(spark, sf))


@query("page_windows", """WITH p AS (SELECT task_id, page, row_number() OVER (PARTITION BY task_id ORDER BY page) - 1 AS pos, count(*) OVER (PARTITION BY task_id) AS n FROM (SELECT DISTINCT task_id, page FROM blocks)),
    w AS (SELECT task_id, n, unnest(range(0, n, 2)) AS start FROM (SELECT DISTINCT task_id, n FROM p)),
    k AS (SELECT *, start // 2 + 1 AS window_no FROM w WHERE start = 0 OR start - 2 + 3 < n)
    SELECT p.task_id, p.page, window_no::BIGINT AS window_no FROM k JOIN p ON p.task_id = k.task_id AND pos >= start AND pos < start + 3""")
def _(spark, sf):
    return D.page_windows(B.blocks(spark, sf).select("task_id", "page").distinct(), 3, 1)


@query("chunk_rows", "SELECT task_id, clause_id, ((row_number() OVER (PARTITION BY task_id ORDER BY sort_order) - 1) // 6 + 1)::BIGINT AS batch_no FROM clauses")
def _(spark, sf):
    c = B.clauses(spark, sf)
    return D.chunk_rows(c, ["task_id"], ["sort_order"], 6, D.page_chunk()).select("task_id", "clause_id", "batch_no")


def payload_sql():
    return f"""WITH b AS (SELECT task_id, page, block_no, block_id, {S.clean_lines('text')} AS t FROM blocks), h AS (SELECT *, {S.is_heading('t')} AS hd FROM b WHERE t <> ''),
    r AS (SELECT *, row_number() OVER (PARTITION BY task_id, page ORDER BY block_no) AS p, row_number() OVER (PARTITION BY task_id, page, hd ORDER BY block_no) AS hp FROM h)
    SELECT task_id, page, count(*)::BIGINT AS n_blocks, string_agg(t, ' ' ORDER BY block_no) AS page_text,
    coalesce(string_agg(block_id || ':' || t, '|' ORDER BY block_no) FILTER (hd), '') AS headings FROM r GROUP BY task_id, page"""


@query("page_payload", payload_sql())
def _(spark, sf):
    return D.page_payload(B.blocks(spark, sf))


CAND = f"""cand AS (SELECT task_id, page, block_no, block_id, mark_no, regexp_extract(mark, {S.q(P.SECTION_MARK_PATTERN)}, 1) AS code,
      substr(text, greatest(start - 8, 0) + 1, least(start, 8)) AS lft, substr(text, start + length(mark) + 1, 42) AS tail, substr(text, greatest(start - 20, 0) + 1, start + length(mark) + 80 - greatest(start - 20, 0)) AS ev
    FROM (SELECT *, length(array_to_string(list_transform(range(1, mark_no + 2), lambda k: gaps[k] || CASE WHEN k <= mark_no THEN marks[k] ELSE '' END), '')) AS start FROM (
      SELECT *, unnest(marks) AS mark, unnest(range(len(marks))) AS mark_no FROM (SELECT *, regexp_extract_all(text, {S.q(P.SECTION_MARK_PATTERN)}, 0) AS marks, regexp_split_to_array(text, {S.q(P.SECTION_MARK_PATTERN)}) AS gaps
        FROM (SELECT task_id, page, block_no, block_id, {S.clean_lines('text')} AS text FROM blocks))))),
    kept AS (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY page, block_no, mark_no) AS sort_order, {S.compact_summary(S.sub("regexp_split_to_array(tail, '[。；;\n]|第[一二三四五六七八九十百零〇\\d]+条')[1]", '^[ ：:，,、]+|[ ：:，,、]+$'), 24)} AS topic FROM cand WHERE NOT {S.has('lft', P.CITATION_MARKERS)}),
    sc AS (SELECT task_id, CASE WHEN topic <> '' THEN code || ' ' || topic ELSE code END AS title, 1::BIGINT AS level, page, sort_order, code AS section_code, CASE WHEN topic <> '' THEN topic ELSE code END AS summary,
      0.82::DOUBLE AS confidence, {S.compact_summary('ev', 120)} AS evidence_text, block_id AS block_ids, sort_order AS ord FROM kept)"""

DEDUPE = f"""dd AS (SELECT *, row_number() OVER (PARTITION BY task_id, section_code ORDER BY confidence DESC, length(summary) DESC, ord) AS rk, min(ord) OVER (PARTITION BY task_id, section_code) AS seen FROM
      (SELECT * REPLACE ({S.compact_summary('summary', 80)} AS summary) FROM sc)),
    ds AS (SELECT * REPLACE (row_number() OVER (PARTITION BY task_id ORDER BY page, sort_order, level, title, seen) AS sort_order) FROM dd WHERE rk = 1)"""


@query("section_candidates", f"WITH {CAND} SELECT * FROM sc")
def _(spark, sf):
    return D.section_candidates(B.blocks(spark, sf))


@query("section_candidate_dedupe", f"WITH {CAND}, {DEDUPE} SELECT task_id, title, page, sort_order::BIGINT AS sort_order, section_code, summary, confidence FROM ds")
def _(spark, sf):
    d = D.section_candidate_dedupe(D.section_candidates(B.blocks(spark, sf)))
    return d.select("task_id", "title", "page", "sort_order", "section_code", "summary", "confidence")


VALID = f"""(length({S.no_space('title')}) BETWEEN 1 AND 80 AND NOT {S.has(S.no_space('title'), P.SECTION_TITLE_BLOCKLIST)} AND NOT (regexp_matches({S.no_space('title')}, '[：:]$') AND length({S.no_space('title')}) <= 18)
    AND {S.section_code('title')} IS NOT NULL AND NOT coalesce(regexp_matches({S.section_code('title')}, '^(\\d|（|\\()'), FALSE))"""
HEADS = f"""hb AS (SELECT task_id, page, block_no, {S.clean_lines('text')} AS title FROM blocks), hh AS (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY page, block_no) AS so FROM hb WHERE {S.is_heading('title')}),
    loc AS (SELECT task_id, 'section_' || printf('%03d', so) AS section_id, left(title, 120) AS title, {S.heading_level('title')}::BIGINT AS level, page, {S.compact_summary('title', 80)} AS summary, 0.55::DOUBLE AS confidence, so::BIGINT AS sort_order, {S.section_code('title')} AS section_code FROM hh
      UNION ALL SELECT task_id, 'section_001', '合同正文', 1, min(page), '未稳定识别到显式章节标题，建议人工复核。', 0.35, 1, NULL FROM blocks WHERE task_id NOT IN (SELECT task_id FROM hh) GROUP BY task_id)"""
BUILT = f"""bv AS (SELECT * REPLACE ({S.compact_summary('summary', 80)} AS summary) FROM %s WHERE {VALID}),
    br AS (SELECT *, row_number() OVER (PARTITION BY task_id, section_code ORDER BY confidence DESC, length(summary) DESC, ord) AS rk2, min(ord) OVER (PARTITION BY task_id, section_code) AS seen2 FROM bv),
    bs AS (SELECT task_id, title, level, page, summary, confidence, row_number() OVER (PARTITION BY task_id ORDER BY page, sort_order, level, title, seen2) AS sort_order, section_code FROM br WHERE rk2 = 1)"""


@query("build_sections", f"WITH {CAND}, {BUILT % 'sc'} SELECT task_id, 'section_' || printf('%03d', sort_order) AS section_id, title, level, page, summary, confidence, sort_order::BIGINT AS sort_order, section_code FROM bs")
def _(spark, sf):
    return D.build_sections(D.section_candidates(B.blocks(spark, sf))).select(*D.SECTION_COLUMNS)


@query("section_merge_gate", f"""WITH {CAND}, {DEDUPE}, ca AS (SELECT task_id, count(*) AS nc, count_if(section_code LIKE '第%') AS mc FROM ds GROUP BY task_id),
    me AS (SELECT task_id, count(*) AS nm, count_if(section_code LIKE '第%') AS mm FROM ds WHERE sort_order % 2 = 1 OR level * 10 > 10 GROUP BY task_id)
    SELECT task_id, nc::BIGINT AS n_candidates, mc::BIGINT AS major_candidates, coalesce(nm, 0)::BIGINT AS n_merged, coalesce(mm, 0)::BIGINT AS major_merged,
    (coalesce(nm, 0) > 0 AND NOT (mc >= 6 AND coalesce(mm, 0) < greatest(5, floor(mc * 0.55::DOUBLE))) AND NOT (coalesce(nm, 0) > greatest(nc * 2, nc + 20))) AS accepted FROM ca LEFT JOIN me USING (task_id)""")
def _(spark, sf):
    c = D.section_candidate_dedupe(D.section_candidates(B.blocks(spark, sf)))
    return D.section_merge_gate(c.where(F.col("sort_order") % 2 == 1), c)


RECON = f"WITH {CAND}, {DEDUPE}, {BUILT % 'ds'}, {HEADS}"


@query("reconstruct_sections", RECON + """, fin AS (SELECT task_id, 'section_' || printf('%03d', sort_order) AS section_id, title, level, page, summary, confidence, sort_order::BIGINT AS sort_order, section_code FROM bs
    UNION ALL SELECT * FROM loc WHERE task_id NOT IN (SELECT task_id FROM bs)) SELECT * FROM fin""")
def _(spark, sf):
    return D.reconstruct_sections(B.blocks(spark, sf))


@query("local_sections", f"WITH {HEADS} SELECT * FROM loc")
def _(spark, sf):
    return D.local_sections(B.blocks(spark, sf))


SECT = f"""sect AS (SELECT task_id, page, block_no AS sort_order, 1 + (length(text) % 4) AS level, {S.compact_summary('text', 80)} AS title FROM blocks WHERE text LIKE '第%')"""


@B.memo
def sections(spark, sf):
    b = B.blocks(spark, sf).where(F.col("text").startswith("第"))
    return b.select("task_id", "page", F.col("block_no").alias("sort_order"), (1 + F.length("text") % 4).alias("level"), X.compact_summary("text", 80).alias("title"))


@query("section_tree", f"WITH {SECT} SELECT a.task_id, a.sort_order, a.level::BIGINT AS level, max(b.sort_order) AS parent_order FROM sect a LEFT JOIN sect b ON a.task_id = b.task_id AND b.sort_order < a.sort_order AND b.level < a.level GROUP BY ALL")
def _(spark, sf):
    return D.section_tree(sections(spark, sf)).select("task_id", "sort_order", "level", "parent_order")


@query("nearest_section", f"WITH {SECT} SELECT c.task_id, clause_id, c.page, arg_max(s.title, s.page * 100000 + s.sort_order) AS section_title FROM clauses c LEFT JOIN sect s ON s.task_id = c.task_id AND s.page <= c.page GROUP BY ALL")
def _(spark, sf):
    return D.nearest_section(B.clauses(spark, sf), sections(spark, sf)).select("task_id", "clause_id", "page", "section_title")


PTEXT = "pt AS (SELECT task_id, page, string_agg(text, chr(10) ORDER BY block_no) AS ptext FROM blocks GROUP BY task_id, page)"
LOC = f"""WITH {PTEXT}, w AS (SELECT clause_id, task_id, CASE WHEN sort_order % 3 = 0 THEN page ELSE page + 1000 END AS given, CASE WHEN sort_order % 4 = 0 THEN label || '?' ELSE raw_text END AS t FROM clauses),
    f AS (SELECT clause_id, min(page) AS fp FROM w JOIN pt USING (task_id) WHERE contains(ptext, t) OR contains(replace(ptext, ' ', ''), replace(t, ' ', '')) GROUP BY clause_id)"""


def wanted(spark, sf):
    c = B.clauses(spark, sf)
    return c.select("task_id", "clause_id", F.when(F.col("sort_order") % 3 == 0, F.col("page")).otherwise(F.col("page") + 1000).alias("page"),
                    F.when(F.col("sort_order") % 4 == 0, F.concat("label", F.lit("?"))).otherwise(F.col("raw_text")).alias("t"))


@query("locate_page", LOC + " SELECT task_id, clause_id, fp AS found_page FROM f JOIN w USING (clause_id)")
def _(spark, sf):
    return D.locate_page(wanted(spark, sf), B.blocks(spark, sf), "clause_id", "t")


@query("coerce_page", LOC + """, fst AS (SELECT task_id, min(page) AS p1 FROM blocks GROUP BY task_id)
    SELECT task_id, w.clause_id, coalesce(CASE WHEN given IN (SELECT page FROM pt WHERE pt.task_id = w.task_id) THEN given END, fp, p1)::BIGINT AS page FROM w LEFT JOIN f USING (clause_id) JOIN fst USING (task_id)""")
def _(spark, sf):
    return D.coerce_page(wanted(spark, sf), B.blocks(spark, sf), "clause_id", "page", "t").select("task_id", "clause_id", "page")


@query("locate_block", "SELECT f.task_id, fact_id, arg_min(b.block_id, b.block_no) AS evidence_id FROM key_facts f JOIN blocks b ON b.task_id = f.task_id AND b.page = f.page WHERE value <> '' AND (contains(b.text, rtrim(value, '…')) OR contains(replace(b.text, ' ', ''), replace(rtrim(value, '…'), ' ', ''))) GROUP BY f.task_id, fact_id")
def _(spark, sf):
    f = B.key_facts(spark, sf).withColumn("v", F.rtrim("value", F.lit("…")))
    return D.locate_block(f, B.blocks(spark, sf), "fact_id", "v")


SPLIT_POLICY = f"""WITH t AS (SELECT document_id, {S.clean_text('text')} AS t FROM texts),
    c AS (SELECT document_id, unnest(ps) AS p, unnest(range(len(ps))) AS part_no FROM (SELECT document_id, string_split(regexp_replace(t, '({P.CHAPTER_PATTERN})', chr(1) || '\\1' || chr(2), 'g'), chr(1)) AS ps FROM t)),
    cb AS (SELECT document_id, part_no, CASE WHEN contains(p, chr(2)) THEN {S.strip("split_part(p, chr(2), 1)")} ELSE '总则' END AS chapter, {S.strip("CASE WHEN contains(p, chr(2)) THEN split_part(p, chr(2), 2) ELSE p END")} AS body FROM c),
    a AS (SELECT document_id, part_no, chapter, unnest(ps) AS p, unnest(range(len(ps))) AS article_no FROM (SELECT *, string_split(regexp_replace(body, '({P.ARTICLE_PATTERN})', chr(1) || '\\1' || chr(2), 'g'), chr(1)) AS ps FROM cb WHERE body <> '')),
    ab AS (SELECT document_id, part_no, article_no, chapter, CASE WHEN contains(p, chr(2)) THEN {S.strip("split_part(p, chr(2), 1)")} END AS article, {S.clean_text("CASE WHEN contains(p, chr(2)) THEN split_part(p, chr(2), 2) ELSE p END")} AS content FROM a)
    SELECT document_id, part_no::BIGINT AS part_no, article_no::BIGINT AS article_no, chapter AS category_lv1, coalesce(article, chapter) AS title, CASE WHEN article IS NOT NULL THEN split_part(article, '条', 1) ELSE chapter END AS clause_no, content, 'policy' AS doc_type, 'policy_article' AS clause_type FROM ab WHERE content <> ''"""


@query("split_policy", SPLIT_POLICY)
def _(spark, sf):
    return D.split_policy(B.texts(spark, sf))


def _tpl_parts(pattern, passes=1):
    x = "t"
    for _ in range(passes):
        x = f"regexp_replace({x}, '({pattern})', chr(1) || '\\1', 'g')"
    return f"list_filter(list_transform(string_split({x}, chr(1)), lambda v: {S.strip('v')}), lambda v: v <> '')"


SPLIT_TEMPLATE = f"""WITH t AS (SELECT document_id, doc_id, {S.clean_text('text')} AS t FROM texts),
    p AS (SELECT *, {_tpl_parts(P.TEMPLATE_HEADINGS[0])} AS p0, {_tpl_parts(P.TEMPLATE_HEADINGS[1])} AS p1, {_tpl_parts(P.TEMPLATE_HEADINGS[2], 2)} AS p2 FROM t),
    e AS (SELECT document_id, doc_id, unnest(ps) AS part, unnest(range(1, len(ps) + 1)) AS pos FROM (SELECT *, CASE WHEN len(p0) > 1 THEN p0 WHEN len(p1) > 1 THEN p1 WHEN len(p2) > 1 THEN p2 ELSE [t] END AS ps FROM p)),
    l AS (SELECT *, list_filter(list_transform(string_split(part, chr(10)), lambda x: {S.strip('x')}), lambda x: x <> '') AS ls FROM e),
    f AS (SELECT *, left(ls[1], 120) AS title, {S.clean_text("CASE WHEN len(ls) > 1 THEN array_to_string(ls[2:], chr(10)) ELSE ls[1] END")} AS content FROM l)
    SELECT document_id, 'tpl_' || doc_id AS template_id, 'name_' || doc_id AS template_name, pos::VARCHAR AS clause_no, coalesce(title, 'name_' || doc_id || '-' || pos) AS title, {S.clause_type("(title || chr(10) || content)")} AS clause_type, coalesce(content, '') AS content,
    array_to_string(list_filter([{", ".join(f"CASE WHEN {S.has('(title || chr(10) || content)', w)} THEN {S.q(n)} END" for n, w in P.RISK_TAG_KEYWORDS.items())}], lambda t: t IS NOT NULL), '|') AS risk_tags, 'template' AS doc_type FROM f"""


@query("split_template", SPLIT_TEMPLATE)
def _(spark, sf):
    t = B.texts(spark, sf)
    return D.split_template(t.select("document_id", F.concat(F.lit("tpl_"), "doc_id").alias("template_id"), F.concat(F.lit("name_"), "doc_id").alias("template_name"), "text"))


@B.memo
def contents(spark, sf):
    """Contents lines from the part table: a category line per brand, a sub-category per type, a dotted line per part."""
    p = B.load(spark, sf, "part")
    doc, key = F.concat(F.lit("cat_"), F.substring("p_brand", -2, 1)), F.col("p_partkey")
    page = (1 + F.col("p_size") % 10).cast("long")
    row = lambda kind, t: F.struct(F.lit(kind).alias("k"), t.alias("text"))
    rows = F.array(row(0, F.concat(F.lit("一、 "), "p_brand", F.lit("类"))), row(1, F.concat(F.lit("1."), (key % 9).cast("string"), F.lit(" "), "p_type")),
                   row(2, F.concat(F.lit("1.1."), key.cast("string"), F.lit(" "), "p_name", F.lit("......"), (key % 40 + 1).cast("string"))))
    e = p.select(doc.alias("document_id"), page.alias("page"), key.alias("key"), F.explode(rows).alias("r"))
    e = e.where((F.col("r.k") > 0) | (F.col("key") % 10 == 0)).where((F.col("r.k") != 1) | (F.col("key") % 3 == 0))
    return e.select("document_id", "page", (F.col("key") * 3 + F.col("r.k")).alias("line_no"), F.col("r.text").alias("text"))


CONT = """cl AS (SELECT 'cat_' || left(right(p_brand, 2), 1) AS document_id, (1 + p_size % 10)::BIGINT AS page, p_partkey * 3 + k AS line_no, CASE k WHEN 0 THEN '一、 ' || p_brand || '类' WHEN 1 THEN '1.' || (p_partkey % 9) || ' ' || p_type
      ELSE '1.1.' || p_partkey || ' ' || p_name || '......' || (p_partkey % 40 + 1) END AS text, k, p_brand, p_type, p_partkey, p_name FROM part, range(3) r(k) WHERE (k > 0 OR p_partkey % 10 = 0) AND (k <> 1 OR p_partkey % 3 = 0)),
    c2 AS (SELECT *, last_value(CASE WHEN k = 0 THEN p_brand || '类' END IGNORE NULLS) OVER w AS lv1, count(CASE WHEN k = 0 THEN 1 END) OVER w AS grp FROM cl WINDOW w AS (PARTITION BY document_id ORDER BY page, line_no ROWS UNBOUNDED PRECEDING)),
    ct AS (SELECT *, last_value(CASE WHEN k = 1 THEN p_type END IGNORE NULLS) OVER (PARTITION BY document_id, grp ORDER BY page, line_no ROWS UNBOUNDED PRECEDING) AS lv2 FROM c2)"""


@query("template_catalog", f"WITH {CONT} SELECT document_id, page, line_no, 'tpl_1_1_' || p_partkey AS template_code, p_name AS template_name, lv1 AS category_lv1, lv2 AS category_lv2, (p_partkey % 40 + 1)::BIGINT AS catalog_page FROM ct WHERE k = 2")
def _(spark, sf):
    return D.template_catalog(contents(spark, sf))


@B.memo
def heading_catalog(spark, sf):
    """Catalogue made of a document's own chapter lines, last one first."""
    b = B.blocks(spark, sf).where(F.col("text").rlike("^第.章"))
    b = b.select(F.col("task_id").alias("document_id"), "block_no", "page", F.col("text").alias("template_name"))
    from auditframe.functions import ordered as O
    b = O.numbered(b, ["document_id"], [-F.col("block_no")], "idx", -D.page_chunk())
    return b.select("document_id", "idx", "template_name", F.floor(F.col("page") / 2).alias("catalog_page"), F.concat(F.lit("tpl_"), "block_no").alias("template_id"))


@B.memo
def doc_pages(spark, sf):
    return D.page_texts(B.blocks(spark, sf)).withColumnRenamed("task_id", "document_id")


HC = f"""{PTEXT}, hc AS (SELECT task_id AS document_id, row_number() OVER (PARTITION BY task_id ORDER BY block_no DESC) AS idx, {S.clean_text('text')} AS name, text AS template_name, (page // 2)::BIGINT AS catalog_page FROM blocks WHERE regexp_matches(text, '^第.章')),
    off AS (SELECT task_id AS document_id, coalesce(o, 0)::BIGINT AS off FROM (SELECT DISTINCT task_id FROM pt) LEFT JOIN (SELECT document_id, arg_min(page - catalog_page, idx * 100000 + page) AS o FROM hc JOIN pt ON task_id = document_id WHERE page > 8 AND contains(ptext, name) GROUP BY document_id) ON document_id = task_id),
    rg AS (SELECT hc.*, greatest(1, catalog_page + off)::BIGINT AS start_page, greatest(catalog_page + off, coalesce(lead(catalog_page + off) OVER (PARTITION BY document_id ORDER BY idx) - 1, n))::BIGINT AS end_page
      FROM hc JOIN off USING (document_id) JOIN (SELECT task_id AS document_id, count(*) AS n FROM pt GROUP BY task_id) USING (document_id))"""


@B.memo
def ranges(spark, sf):
    cat, pages = heading_catalog(spark, sf), doc_pages(spark, sf)
    counts = pages.groupBy("document_id").agg(F.count(F.lit(1)).alias("page_count"))
    return D.template_ranges(cat, D.page_offset(cat, pages), counts)


@query("page_offset", f'WITH {HC} SELECT document_id, off AS "offset" FROM off')
def _(spark, sf):
    return D.page_offset(heading_catalog(spark, sf), doc_pages(spark, sf))


@query("template_ranges", f"WITH {HC} SELECT document_id, idx, template_name, start_page, end_page FROM rg")
def _(spark, sf):
    return ranges(spark, sf).select("document_id", "idx", "template_name", "start_page", "end_page")


@query("template_text", f"WITH {HC} SELECT document_id, idx, {S.clean_text('t')} AS text FROM (SELECT document_id, idx, string_agg(ptext, chr(10) || chr(10) ORDER BY page) AS t FROM rg JOIN pt ON task_id = document_id AND page BETWEEN start_page AND end_page GROUP BY document_id, idx)")
def _(spark, sf):
    return D.template_text(ranges(spark, sf), doc_pages(spark, sf))


@query("catalog_dedupe", f"WITH {HC} SELECT document_id, min(idx) AS idx, template_name, start_page, end_page FROM (SELECT document_id, idx, left(template_name, 3) AS template_name, start_page // 8 AS start_page, end_page // 8 AS end_page FROM rg) GROUP BY document_id, template_name, start_page, end_page")
def _(spark, sf):
    r = ranges(spark, sf).select("document_id", "idx", "template_id", F.substring("template_name", 1, 3).alias("template_name"),
                                 F.floor(F.col("start_page") / 8).alias("start_page"), F.floor(F.col("end_page") / 8).alias("end_page"))
    return D.catalog_dedupe(r).drop("template_id")


