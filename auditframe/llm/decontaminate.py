"""Benchmark decontamination by winnowing.

A text becomes a row of word hashes; every k consecutive words have a hash, and of every `window - k + 1` consecutive such hashes the
smallest is kept as a fingerprint.  A span shared by a document and a benchmark item that is `window` words long therefore shares at
least one fingerprint at the same place in both.  Fingerprints of documents meet those of the benchmark, and each meeting is extended
word by word in both directions; what reaches `window` words is a hit.  Items shorter than `window` are one window of their own length
and are compared by the hash of their whole length.

The benchmark is taken in blocks of at most `block_words` words (about 100 bytes a word in a Python worker); each block passes through
the driver and is one pass over the documents inside the same stage, so no document is shuffled, but the driver's and the workers' memory
grow with the number of blocks.  Null or empty texts have no words and no hits; an empty benchmark hits nothing; repeated items and rows
are each reported; further columns are kept as they are.  Items without id are searched like any other: their words count, together they
count as one item, which is a null at the end of the list of ids and has no part in the hash of the ids.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import query, table
from .words import NOT_ALNUM, U, Words, column, grams, slices

WINDOW = 13
K = 5
BLOCK_WORDS = 2_000_000
#: Pairs of places that are extended at a time.
PAIRS = 1 << 20


@dataclass
class Block:
    """One block of the benchmark: word hashes in order, the item of each word, fingerprints, and whole short items by length."""

    words: np.ndarray
    item: np.ndarray
    names: list[str | None]
    prints: np.ndarray
    places: np.ndarray
    short: dict[int, tuple[np.ndarray, np.ndarray]]


def winnow(h: np.ndarray, at: np.ndarray, doc: np.ndarray, run: int) -> np.ndarray:
    """Numbers of the k-grams that are the (leftmost) smallest of any `run` consecutive ones of their text; all, in a text with fewer."""
    n = len(h)
    if n == 0:
        return np.zeros(0, np.int64)
    d = doc[at]
    keep = np.zeros(n, bool)
    if n >= run:
        low, where = h[: n - run + 1].copy(), np.arange(n - run + 1)
        for j in range(1, run):
            less = h[j : j + n - run + 1] < low
            low = np.where(less, h[j : j + n - run + 1], low)
            where = np.where(less, np.arange(j, j + n - run + 1), where)
        keep[where[d[: n - run + 1] == d[run - 1 :]]] = True
    first = np.flatnonzero(np.r_[True, d[1:] != d[:-1]])
    size = np.diff(np.r_[first, n])
    few = size < run
    keep |= np.repeat(few, size)
    return np.flatnonzero(keep)


def build(ids: list, texts: list[str], window: int, k: int) -> Block:
    data = [(t or "").encode() for t in texts]
    w = Words(np.frombuffer(b"".join(data), np.uint8), np.cumsum([0, *map(len, data)]), NOT_ALNUM)
    counts = w.counts
    h, at = grams(w.hash, w.doc, k)
    kept = winnow(h, at, w.doc, window - k + 1)
    kept = kept[counts[w.doc[at[kept]]] >= window]
    order = np.argsort(h[kept], kind="stable")
    short = {}
    for n in np.unique(counts[(counts > 0) & (counts < window)]).tolist():
        own = np.flatnonzero(counts == n)
        g, a = grams(w.hash, w.doc, n)
        mine = np.isin(w.doc[a], own)
        o = np.argsort(g[mine], kind="stable")
        short[n] = (g[mine][o], w.doc[a[mine]][o])
    return Block(w.hash, w.doc, [None if x is None else str(x) for x in ids], h[kept][order], at[kept][order], short)


def meetings(sought: np.ndarray, there: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Numbers (i, j) with sought[i] = there[j], there being sorted; in pieces of bounded size."""
    lo, hi = np.searchsorted(there, sought, "left"), np.searchsorted(there, sought, "right")
    hit = np.flatnonzero(hi > lo)
    size = (hi - lo)[hit]
    ends = np.cumsum(size)
    i = 0
    while i < len(hit):
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + PAIRS, "right")))
        s = size[i:j]
        left = np.repeat(hit[i:j], s)
        yield left, np.repeat(lo[hit[i:j]], s) + np.arange(s.sum()) - np.repeat(np.cumsum(s) - s, s)
        i = j


def extend(a: np.ndarray, a_of: np.ndarray, p: np.ndarray, b: np.ndarray, b_of: np.ndarray, q: np.ndarray, step: int) -> np.ndarray:
    """How many words next to a[p] and b[q] agree, going by step, inside one text and one item."""
    n, live, far = np.zeros(len(p), np.int64), np.arange(len(p)), 0
    while len(live):
        far += step
        x, y = p[live] + far, q[live] + far
        ok = (x >= 0) & (x < len(a)) & (y >= 0) & (y < len(b))
        live, x, y = live[ok], x[ok], y[ok]
        live = live[(a[x] == b[y]) & (a_of[x] == a_of[p[live]]) & (b_of[y] == b_of[q[live]])]
        n[live] += 1
    return n


def find(w: Words, block: Block, window: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hit spans: first word, word after the last, item."""
    starts, ends, items = [], [], []
    if len(block.prints):
        h, at = grams(w.hash, w.doc, k)
        kept = winnow(h, at, w.doc, window - k + 1)
        kept = kept[np.isin(h[kept], block.prints)]
        for i, j in meetings(h[kept], block.prints):
            p, q = at[kept[i]], block.places[j]
            left = extend(w.hash, w.doc, p, block.words, block.item, q, -1)
            right = extend(w.hash, w.doc, p + k - 1, block.words, block.item, q + k - 1, 1)
            true = (left + right + k >= window) & (w.hash[p] == block.words[q])
            for j2 in range(1, k):
                true &= w.hash[p + j2] == block.words[q + j2]
            starts.append((p - left)[true]), ends.append((p + k + right)[true]), items.append(block.item[q[true]])
    for n, (g, of) in block.short.items():
        h, at = grams(w.hash, w.doc, n)
        hit = np.flatnonzero(np.isin(h, g))
        for i, j in meetings(h[hit], g):
            p = at[hit[i]]
            starts.append(p), ends.append(p + n), items.append(of[j])
    if not starts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(starts), np.concatenate(ends), np.concatenate(items)


def merged(spans: np.ndarray) -> np.ndarray:
    """Disjoint spans in order."""
    if len(spans) < 2:
        return spans
    spans = spans[np.lexsort((spans[:, 1], spans[:, 0]))]
    top = np.maximum.accumulate(spans[:, 1])
    new = np.r_[True, spans[1:, 0] > top[:-1]]
    return np.stack([spans[new, 0], np.maximum.reduceat(spans[:, 1], np.flatnonzero(new))], 1)


def contamination(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text",
                  window: int = WINDOW, k: int = K, block_words: int = BLOCK_WORDS, prefix: str = "hit_") -> DataFrame:
    """Append to each document hit_words (its number of words), hit_spans (array of start and end word) and hit_items (sorted ids as text, a null at the end for items without id)."""
    spans_of, items_of, words_of = f"{prefix}spans", f"{prefix}items", f"{prefix}words"
    docs = docs.drop(spans_of, items_of, words_of).withColumns({
        words_of: F.lit(0).cast("long"), spans_of: F.array().cast("array<struct<start:long,end:long>>"), items_of: F.array().cast("array<string>")})
    items = benchmark.select(F.col(item_id).cast("string").alias("id"), F.coalesce(item_text, F.lit("")).alias("text"))
    schema = docs.schema
    first = True
    for block in [*blocks(items, window, k, block_words)] or [build([], [], window, k)]:
        packed = docs.sparkSession.sparkContext.broadcast(block)
        docs = docs.mapInArrow(_pass(packed, text, words_of, spans_of, items_of, window, k, first), schema)
        first = False
    return docs


def blocks(items: DataFrame, window: int, k: int, block_words: int) -> Iterator[Block]:
    """The benchmark, streamed to the driver and cut into blocks of bounded size."""
    ids, texts, n = [], [], 0
    for r in items.orderBy("id", "text").toLocalIterator():
        size = len(r.text) // 2 + 1
        if ids and n + size > block_words:
            yield build(ids, texts, window, k)
            ids, texts, n = [], [], 0
        ids.append(r.id), texts.append(r.text)
        n += size
    if ids:
        yield build(ids, texts, window, k)


def _pass(packed, text: str, words_of: str, spans_of: str, items_of: str, window: int, k: int, first: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = packed.value
        for batch in batches:
            data, offsets = column(batch, text)
            counts, found = np.zeros(batch.num_rows, np.int64), {}
            for i, j in slices(offsets):
                w = Words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], NOT_ALNUM)
                counts[i:j] = w.counts
                s, e, item = find(w, block, window, k)
                order = np.argsort(w.doc[s], kind="stable") if len(s) else s
                s, e, item = s[order], e[order], item[order]
                of, at = np.unique(w.doc[s], return_index=True)
                for d, a, b in zip(of.tolist(), at.tolist(), [*at[1:].tolist(), len(s)]):
                    base = w.bounds[d]
                    found[i + d] = (np.stack([s[a:b] - base, e[a:b] - base], 1), {block.names[x] for x in np.unique(item[a:b]).tolist()})
            old_spans = None if first else batch.column(spans_of).to_pylist()
            old_items = None if first else batch.column(items_of).to_pylist()
            spans, items = [], []
            for r in range(batch.num_rows):
                sp, it = found.get(r, (np.zeros((0, 2), np.int64), set()))
                if not first:
                    sp = np.concatenate([sp, np.array([[x["start"], x["end"]] for x in old_spans[r]], np.int64).reshape(-1, 2)])
                    it = it | set(old_items[r])
                spans.append([{"start": int(a), "end": int(b)} for a, b in merged(sp)] if len(sp) else [])
                items.append(sorted(it, key=lambda x: (x is None, x or "")))
            new = {words_of: pa.array(counts), spans_of: pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), items_of: pa.array(items, pa.list_(pa.string()))}
            yield pa.RecordBatch.from_arrays([new.get(n, batch.column(i)) for i, n in enumerate(batch.schema.names)], names=batch.schema.names)
    return run


def verdicts(found: DataFrame, prefix: str = "hit_") -> DataFrame:
    """n_words, n_hit, n_items and the contamination rule, from what contamination() appended."""
    n_hit = F.aggregate(F.col(f"{prefix}spans"), F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return found.withColumns({"n_words": F.col(f"{prefix}words"), "n_hit": n_hit, "n_items": F.size(f"{prefix}items").cast("long")}).withColumn(
        "contaminated", F.expr("n_hit > 0 and 20 * n_hit >= n_words"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that the rule does not find contaminated, with their own columns."""
    tag = "hit_" if not {"hit_words", "hit_spans", "hit_items"} & set(docs.columns) else "decontamination_hit_"
    found = contamination(docs, benchmark, prefix=tag)
    n_hit = F.aggregate(F.col(f"{tag}spans"), F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return found.where(~((n_hit > 0) & (20 * n_hit >= F.col(f"{tag}words")))).select(*docs.columns)


def _class(negated: str) -> str:
    return f"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{negated}')"


ORACLE = f"""
WITH d AS MATERIALIZED (SELECT doc_id, {_class(r'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')} w FROM documents),
b AS MATERIALIZED (SELECT item_id, w, len(w) n FROM (SELECT item_id, {_class(r'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')} w FROM benchmark) WHERE len(w) > 0),
bw AS MATERIALIZED (SELECT DISTINCT item_id, least(n, {WINDOW}) size, hash(w[i : i + least(n, {WINDOW}) - 1]) h
  FROM (SELECT item_id, w, n, unnest(range(1, greatest(n - {WINDOW - 1}, 1) + 1)) i FROM b)),
sizes AS (SELECT DISTINCT size FROM bw),
dw AS (SELECT doc_id, size, i, hash(w[i : i + size - 1]) h FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) i FROM d, sizes WHERE len(w) >= size)),
hits AS MATERIALIZED (SELECT doc_id, item_id, i, dw.size FROM dw JOIN bw ON dw.h = bw.h AND dw.size = bw.size),
covered AS (SELECT doc_id, count(DISTINCT p) n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) p FROM hits) GROUP BY doc_id),
found AS (SELECT doc_id, count(*) n_items, string_agg(x, ',' ORDER BY x) names FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) x FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) n_words, coalesce(n_hit, 0)::BIGINT n_hit, coalesce(n_items, 0)::BIGINT n_items, sha256(coalesce(names, '')) items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN found USING (doc_id)
"""


@query("op9_decontamination", ORACLE)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = verdicts(contamination(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark")).drop("text"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.concat_ws(",", "hit_items"), 256).alias("items_sha256"), "contaminated")
