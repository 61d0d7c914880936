"""Near-duplicate documents by fast similarity sketching, banding and exact verification.

Sketch.  A document is the set of its distinct 5-word shingles.  In round i < T every shingle is hashed to one of T bins and to a value
of i plus a fraction, and each bin keeps its smallest value; rounds go on only while a bin is empty, and rounds T .. 2T-1 put every
shingle into bin i - T, so that every coordinate is filled.  A set of n shingles costs about max(n, T log T) placements instead of n T,
and coordinates of two sets agree with the probability of their Jaccard similarity, with the usual concentration bounds.

Banding.  BANDS bands of ROWS coordinates: a pair of similarity 0.85 shares a band but for about one in a million, one of 0.3 shares a
band in less than one per cent of the cases.

Verification.  Documents with equal sets form one class and only the smallest id goes on.  Documents that share a band are chained to
the smallest id of the band, and the connected groups of that chain are compared exactly on their full sets inside tasks: counts of
common shingles are products of incidence matrices.  Groups of more than CHUNK sets or CHUNK_SHINGLES shingles are split by hash into
chunks, and each pair of chunks that share a band is a task of its own; a task goes through its shingles RANGE at a time and returns a
spanning forest of its links, never its pairs.  No band, group or partner is capped.  One set is never split: a task holds its two chunks
packed (8 bytes a shingle), which are about CHUNK_SHINGLES each, or two single sets where these are larger.

Null or empty texts have the empty set, have no links and are kept; rows without id are not linked and are kept; rows that repeat an id
are one node; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import query, staged, table
from .graph import components
from .words import MULTIPLIER, SPACE, U, Words, column, grams, mix, seeded, slices

SHINGLE = 5
PERCENT = 85
BANDS, ROWS = 36, 7
CHUNK = 256
CHUNK_SHINGLES = 4_000_000
#: Shingles of a task that are unpacked at a time, about.
RANGE = 1 << 20
#: Columns of an incidence matrix at a time.
WIDTH = 4096


def sets(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, one after another, and their bounds."""
    w = Words(data, offsets, SPACE)
    h, at = grams(w.hash, w.doc, size)
    d = w.doc[at]
    short = np.flatnonzero((w.counts > 0) & (w.counts < size))
    if len(short):
        whole = np.zeros(len(short), U)
        for j in range(size - 1):
            more = w.counts[short] > j
            whole[more] = whole[more] * U(MULTIPLIER) + w.hash[w.bounds[short[more]] + j]
        h, d = np.r_[h, mix(whole + w.counts[short].astype(U))], np.r_[d, short]
    o = np.lexsort((h, d))
    h, d = h[o], d[o]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
    h, d = h[new], d[new]
    return h, np.searchsorted(d, np.arange(len(offsets)))


def sketches(h: np.ndarray, bounds: np.ndarray, t: int) -> np.ndarray:
    """One row of t coordinates for each set that is not empty (others: zeros), see the head of this module."""
    rows = len(bounds) - 1
    size = np.diff(bounds)
    out = np.full(rows * t, np.iinfo(U).max, U)
    live = np.flatnonzero(size)
    for i in range(2 * t):
        if not len(live):
            break
        n = size[live]
        at = np.repeat(bounds[live] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
        x = seeded(h[at], i)
        b = (x >> U(40)) % U(t) if i < t else np.full(len(x), i - t, U)
        cell = np.repeat(live, n) * t + b.astype(np.int64)
        # the round leads, the fraction follows: 9 and 55 bits
        np.minimum.at(out, cell, (U(i) << U(54)) | (mix(x) >> U(10)))
        live = live[(out.reshape(rows, t)[live] == np.iinfo(U).max).any(1)]
    out = out.reshape(rows, t)
    out[size == 0] = 0
    return out


def sketched(docs: DataFrame, text: str, doc_id: str, bands: int, rows: int, size: int) -> DataFrame:
    """Per document: n_shingles, a 128-bit sum of its set, and the hashes of its bands (none for the empty set)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = column(batch, text)
            for i, j in slices(offsets):
                h, b = sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], size)
                n = np.diff(b)
                sums = [np.cumsum(np.r_[U(0), seeded(h, s)], dtype=U) for s in (1001, 1002)]
                lo, hi = [(s[b[1:]] - s[b[:-1]]).view(np.int64) for s in sums]
                sk = sketches(h, b, bands * rows).reshape(j - i, bands, rows)
                key = np.full((j - i, bands), 0, U) + np.arange(bands, dtype=U)
                for r in range(rows):
                    key = mix(key * U(MULTIPLIER) + sk[:, :, r])
                ends = np.cumsum(np.r_[0, np.where(n > 0, bands, 0)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(key[n > 0].ravel().view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(doc_id).slice(i, j - i), pa.array(n.astype(np.int64)), pa.array(lo), pa.array(hi), lists], names=["doc_id", "n_shingles", "lo", "hi", "bands"])
    kind = dict(docs.dtypes)[doc_id]
    return docs.select(doc_id, text).mapInArrow(run, f"doc_id {kind}, n_shingles long, lo long, hi long, bands array<long>")


def forest(ids: np.ndarray, side: np.ndarray, packed: list[bytes], percent: int) -> tuple[list, list]:
    """A spanning forest of the links among sets (packed 64-bit hashes); if side has two values, only of links across."""
    m = len(ids)
    each = [np.frombuffer(x, U) for x in packed]
    size = np.array([len(x) for x in each], np.int64)
    common = np.zeros((m, m), np.int64)
    parts = max(1, -(-int(size.sum()) // RANGE))
    cuts = np.array([(k << 64) // parts for k in range(1, parts)], U)
    bounds = np.array([np.r_[0, np.searchsorted(x, cuts), len(x)] for x in each], np.int64)
    for k in range(parts):
        h = np.concatenate([x[lo:hi] for x, lo, hi in zip(each, bounds[:, k], bounds[:, k + 1])])
        row = np.repeat(np.arange(m), bounds[:, k + 1] - bounds[:, k])
        _, col, times = np.unique(h, return_inverse=True, return_counts=True)
        shared = times > 1
        number = np.cumsum(shared) - 1
        use = shared[col]
        row, col = row[use], number[col[use]]
        order = np.argsort(col, kind="stable")
        row, col = row[order], col[order]
        width = int(shared.sum())
        for a in range(0, width, WIDTH):
            lo, hi = np.searchsorted(col, [a, a + WIDTH])
            x = np.zeros((m, min(WIDTH, width - a)), np.float32)
            x[row[lo:hi], col[lo:hi] - a] = 1
            common += (x @ x.T).astype(np.int64)
    link = 100 * common >= percent * (size[:, None] + size[None, :] - common)
    np.fill_diagonal(link, False)
    if side.min() != side.max():
        link &= side[:, None] != side[None, :]
    a, b, left = [], [], np.ones(m, bool)
    while left.any():
        wave = np.array([np.argmax(left)])
        left[wave] = False
        while len(wave):
            nxt = link[wave] & left
            reach = np.flatnonzero(nxt.any(0))
            a.extend(ids[wave[np.argmax(nxt[:, reach], 0)]]), b.extend(ids[reach])
            left[reach] = False
            wave = reach
    return a, b


def links(docs: DataFrame, groups: DataFrame, text: str, doc_id: str, size: int, percent: int, kind: str) -> DataFrame:
    """Edges (a, b) that span, with all others, the links inside each group of groups (doc_id, grp, mine, others): mine is a chunk, others are those it meets."""
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = column(batch, "text")
            for i, j in slices(offsets):
                h, b = sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], size)
                raw = pa.Array.from_buffers(pa.binary(), j - i, [None, pa.py_buffer((b * 8).astype(np.int32)), pa.py_buffer(h)])
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), batch.column("grp").slice(i, j - i), batch.column("mine").slice(i, j - i), batch.column("others").slice(i, j - i), raw], names=["doc_id", "grp", "mine", "others", "packed"])

    def inside(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates(["doc_id", "packed"])
        a, b = forest(pdf["doc_id"].to_numpy(), pdf["mine"].to_numpy(), list(pdf["packed"]), percent)
        return pd.DataFrame({"a": a, "b": b})

    texts = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).join(groups, "doc_id")
    held = texts.select("doc_id", "grp", "mine", "others", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(pack, f"doc_id {kind}, grp {kind}, mine int, others array<int>, packed binary")
    each = held.withColumn("other", F.explode("others"))
    each = each.select("doc_id", "grp", "mine", "packed", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"))
    return each.groupBy("grp", "i", "j").applyInPandas(inside, f"a {kind}, b {kind}")


def chunked(coarse: DataFrame, sizes: DataFrame, banded: DataFrame, chunk: int, shingles: int) -> DataFrame:
    """groups of links(), from coarse (id, component), sizes (doc_id, n_shingles) and banded (band, doc_id)."""
    sized = coarse.join(sizes.select(F.col("doc_id").alias("id"), "n_shingles"), "id")
    counts = sized.groupBy("component").agg(F.greatest(F.ceil(F.count("*") / chunk), F.ceil(F.sum("n_shingles") / shingles)).cast("int").alias("parts"))
    dealt = coarse.join(counts, "component").select(F.col("id").alias("doc_id"), F.col("component").alias("grp"), "parts", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("mine"))
    dealt = staged(dealt, "dealt")
    many = dealt.where("parts > 1")
    met = banded.join(many, "doc_id").select("band", "grp", "mine").distinct().groupBy("band", "grp").agg(F.sort_array(F.collect_set("mine")).alias("met")).select("grp", "met").distinct()
    others = met.select("grp", F.explode("met").alias("mine"), "met").groupBy("grp", "mine").agg(F.array_distinct(F.flatten(F.collect_set("met"))).alias("others"))
    one = dealt.where("parts = 1").select("doc_id", "grp", "mine", F.array(F.lit(0)).alias("others"))
    return one.union(many.join(others, ["grp", "mine"]).select("doc_id", "grp", "mine", "others"))


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", size: int = SHINGLE, percent: int = PERCENT,
                    bands: int = BANDS, rows: int = ROWS, chunk: int = CHUNK, shingles: int = CHUNK_SHINGLES) -> DataFrame:
    """Per row of docs: doc_id, n_shingles, component_id (smallest id linked with it, over any number of links), kept."""
    kind = dict(docs.dtypes)[doc_id]
    sk = staged(sketched(docs, text, doc_id, bands, rows, size), "sketches")
    full = sk.where("n_shingles > 0 and doc_id is not null")
    classes = staged(full.groupBy("n_shingles", "lo", "hi").agg(F.min("doc_id").alias("rep")), "classes")
    reps = full.join(classes.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi")
    keyed = reps.select("doc_id", F.explode("bands").alias("band"))
    shared = keyed.groupBy("band").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first <> last")
    banded = keyed.join(shared, "band")
    chain = banded.select(F.col("first").alias("a"), F.col("doc_id").alias("b"))
    coarse = components(chain, "coarse")
    groups = staged(chunked(coarse, reps.select("doc_id", "n_shingles"), banded, chunk, shingles), "groups")
    members = staged(full.join(classes, ["n_shingles", "lo", "hi"]).select("doc_id", "rep").distinct(), "members")
    # rows that repeat an id with other texts tie their classes together
    twice = members.groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("z")).where("a <> z")
    ties = members.join(twice, "doc_id").select("a", F.col("rep").alias("b"))
    found = components(links(docs, groups, text, doc_id, size, percent, kind).union(ties), "near")
    placed = members.join(found.select(F.col("id").alias("rep"), "component"), "rep", "left").select("doc_id", F.coalesce("component", "rep").alias("component_id"))
    placed = placed.groupBy("doc_id").agg(F.min("component_id").alias("component_id"))
    joined = sk.select("doc_id", "n_shingles").join(placed, "doc_id", "left")
    joined = joined.withColumn("component_id", F.coalesce("component_id", "doc_id"))
    return joined.withColumn("kept", F.expr("doc_id is null or doc_id = component_id"))


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """The documents that near_duplicates keeps, one row each, with their own columns."""
    gone = near_duplicates(docs).where("not kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


ORACLE = f"""
WITH w AS MATERIALIZED (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, hash(w[i : i + {SHINGLE - 1}]) h FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - {SHINGLE - 1}, least(len(w), 1)) + 1)) i FROM w)),
n AS MATERIALIZED (SELECT doc_id, count(*) n FROM s GROUP BY doc_id),
common AS (SELECT x.doc_id a, y.doc_id b, count(*) c FROM s x JOIN s y ON x.h = y.h AND x.doc_id < y.doc_id GROUP BY ALL),
edges AS MATERIALIZED (SELECT a, b FROM common JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * c >= {PERCENT} * (p.n + q.n - c)),
both_ways AS MATERIALIZED (SELECT a, b FROM edges UNION ALL SELECT b, a FROM edges),
reach AS (WITH RECURSIVE r(id, node) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.id, e.b FROM r JOIN both_ways e ON r.node = e.a) SELECT id doc_id, min(node) component_id FROM r GROUP BY id)
SELECT d.doc_id, coalesce(n, 0)::BIGINT n_shingles, component_id, d.doc_id = component_id kept FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN reach USING (doc_id)
"""


@query("op4_near_duplicates", ORACLE)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
