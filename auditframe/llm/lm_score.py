"""Language-model scores: prediction by partial matching over bytes, next to a unigram word baseline.

Model.  A trie of byte contexts up to ORDER bytes long, learnt from the training documents.  The chance of the next byte follows the
longest known context; a context with n occurrences of d different bytes escapes to the next shorter one with chance d / (n + d), bytes
already refused on the way are excluded there, and below order 0 the remaining bytes are equally likely.  A text begins with marks and
ends with one (0xFF, which no UTF-8 text holds), so that the chances of all texts sum up to one at most.

Jobs.  (1) Each task counts runs of ORDER + 1 bytes and words of its documents; counts meet by key.  Counts of shorter contexts are sums
of these, so one table is the whole trie.  (2) The trie is dealt by the last two context bytes: each group holds all its contexts of
order 2 and more (the two lowest orders are a 256 x 256 table, broadcast at its fixed size) and prices every run that occurs.  (3) The
documents are dealt into chunks of about CHUNK_BYTES; the distinct keys of a chunk fetch their counts and prices by a join and return to
the chunk, where sums per document are made.  Both tables grow with the corpus and are never broadcast or collected.

Null and empty texts consist of the end only.  Null ids are training rows (fold 0).  Without training rows every byte costs log10 256.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fold, query, staged, table
from .words import SPACE, U, Words, column, slices

ORDER = 4
CHUNK_BYTES = 24 << 20
MARK = 0xFF
GRAM, WORD = 0, 1
#: Entries that a task holds before it hands its counts on.
HELD = 4_000_000


def runs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The run of ORDER + 1 bytes that ends at each byte and at the end of each text, and the number of the text."""
    rows, n = len(offsets) - 1, len(data)
    size = np.diff(offsets)
    buf = np.full(n + (ORDER + 1) * rows, MARK, np.uint8)
    of = np.repeat(np.arange(rows), size)
    buf[np.arange(n) + (ORDER + 1) * of + ORDER] = data
    starts = np.repeat(np.arange(rows), size + 1)
    at = np.arange(n + rows) + ORDER * starts
    key = np.zeros(len(at), U)
    for j in range(ORDER + 1):
        key = (key << U(8)) | buf[at + j].astype(U)
    return key, starts


class Counter:
    """Sums by key, joined from time to time."""

    def __init__(self):
        self.keys, self.n, self.size = [], [], 0

    def add(self, keys: np.ndarray, counted: bool = True):
        """Count keys once each, or with nothing if they are only to be known."""
        u, c = np.unique(keys, return_counts=True)
        self.keys.append(u), self.n.append(c if counted else np.zeros(len(u), np.int64))
        self.size += len(u)
        if self.size > HELD and len(self.keys) > 1:
            self.join()

    def join(self):
        u, inv = np.unique(np.concatenate(self.keys), return_inverse=True)
        self.n = [np.bincount(inv, weights=np.concatenate(self.n), minlength=len(u)).astype(np.int64)]
        self.keys, self.size = [u], len(u)

    def take(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.keys:
            return np.zeros(0, U), np.zeros(0, np.int64)
        self.join()
        out = self.keys[0], self.n[0]
        self.__init__()
        return out


def count_keys(docs: DataFrame) -> DataFrame:
    """(kind, key, n) of docs (train, text): runs of all documents with their count in training ones, words of training ones."""
    def pieces(kind: int, counter: Counter):
        keys, n = counter.take()
        for i in range(0, len(keys), 1 << 17):
            k = keys[i : i + (1 << 17)]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), kind, np.int8)), pa.array(k.view(np.int64)), pa.array(n[i : i + (1 << 17)])], names=["kind", "key", "n"])

    def run(batches):
        counters = {GRAM: Counter(), WORD: Counter()}
        for batch in batches:
            data, offsets = column(batch, "text")
            train = batch.column("train").to_numpy(zero_copy_only=False)
            for i, j in slices(offsets):
                part, off = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                key, of = runs(part, off)
                mine = train[i:j][of]
                counters[GRAM].add(key[mine])
                counters[GRAM].add(key[~mine], counted=False)
                w = Words(part, off, SPACE)
                counters[WORD].add(w.hash[train[i:j][w.doc]])
            for kind, c in counters.items():
                if c.size > HELD:
                    yield from pieces(kind, c)
        for kind, c in counters.items():
            yield from pieces(kind, c)

    partial = docs.select("train", "text").mapInArrow(run, "kind byte, key long, n long")
    return partial.groupBy("kind", "key").agg(F.sum("n").alias("n"))


def price(levels: list[np.ndarray]) -> np.ndarray:
    """log10 of the chance of each byte (columns) in each context (rows); levels: counts from the longest context to order 0."""
    m = len(levels[0])
    p, left, out = np.zeros((m, 256)), np.ones(m), np.zeros((m, 256), bool)
    for n in levels:
        own = np.where(out, 0, n)
        total, kinds = own.sum(1), (own > 0).sum(1)
        den = np.maximum(total + kinds, 1)
        p = np.where(own > 0, left[:, None] * own / den[:, None], p)
        left = np.where(total > 0, left * kinds / den, left)
        out = out | (n > 0)
    rest = 256 - out.sum(1)
    p = np.where(out, p, (left / np.maximum(rest, 1))[:, None])
    return np.log10(np.maximum(p, 1e-300))


def priced(grams: DataFrame, low: np.ndarray) -> DataFrame:
    """(key, cost) of every run; low: the 256 x 256 counts of order 1."""
    shared = grams.sparkSession.sparkContext.broadcast(low)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        key, n = pdf["key"].to_numpy(np.int64), pdf["n"].to_numpy(np.float64)
        last = int(key[0] >> 8) & 0xFF
        order1 = shared.value
        sym = key & 0xFF
        ctx, row = np.unique(key >> 8, return_inverse=True)
        third, third_of = np.unique((ctx >> 16) & 0xFF, return_inverse=True)
        n3 = np.zeros((len(third), 256))
        np.add.at(n3, (third_of[row], sym), n)
        n2 = np.zeros((1, 256))
        np.add.at(n2[0], sym, n)
        order = np.argsort(row, kind="stable")
        cost = np.zeros(len(key))
        for a in range(0, len(ctx), 1024):
            b = min(a + 1024, len(ctx))
            mine = order[slice(*np.searchsorted(row[order], [a, b]))]
            n4 = np.zeros((b - a, 256))
            np.add.at(n4, (row[mine] - a, sym[mine]), n[mine])
            p = price([n4, n3[third_of[a:b]], np.broadcast_to(n2, n4.shape), np.broadcast_to(order1[last], n4.shape), np.broadcast_to(order1.sum(0), n4.shape)])
            cost[mine] = p[row[mine] - a, sym[mine]]
        return pd.DataFrame({"key": key, "cost": cost})

    return grams.groupBy(F.shiftright("key", 8).bitwiseAND(0xFFFF).alias("deal")).applyInPandas(run, "key long, cost double")


def distinct_keys(t: pa.Table) -> pa.Table:
    data, offsets = column(t, "text")
    grams, words = Counter(), Counter()
    for i, j in slices(offsets):
        part, off = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        grams.add(runs(part, off)[0])
        words.add(Words(part, off, SPACE).hash)
    g, w = grams.take()[0], words.take()[0]
    chunk = t["chunk"][0].as_py()
    return pa.table({"chunk": pa.array(np.full(len(g) + len(w), chunk, np.int32)), "kind": pa.array(np.repeat(np.array([GRAM, WORD], np.int8), [len(g), len(w)])), "key": pa.array(np.r_[g, w].view(np.int64))})


def sums(docs: pa.Table, keys: pa.Table) -> pa.Table:
    """Per document of a chunk: tokens, known tokens, the sum of log10(count + 1), and that of prices."""
    data, offsets = column(docs, "text")
    rows = docs.num_rows
    n_words, known, base, score = np.zeros(rows, np.int64), np.zeros(rows, np.int64), np.zeros(rows), np.zeros(rows)
    kind, key, value = keys["kind"].to_numpy(), keys["key"].to_numpy().view(U), keys["value"].to_numpy()
    tables = []
    for k in (GRAM, WORD):
        mine = np.flatnonzero(kind == k)
        o = mine[np.argsort(key[mine])]
        tables.append((key[o], value[o]))
    for i, j in slices(offsets):
        part, off = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        run, of = runs(part, off)
        bits = U(max(1, int(j - i - 1).bit_length()))
        s = np.sort((run << bits) | of.astype(U))
        run, of = s >> bits, (s & ((U(1) << bits) - U(1))).astype(np.int64)
        new = np.ones(len(run), bool)
        new[1:] = run[1:] != run[:-1]
        cost = tables[GRAM][1][np.searchsorted(tables[GRAM][0], run[new])]
        score[i:j] = np.bincount(of, weights=cost[np.cumsum(new) - 1], minlength=j - i)
        w = Words(part, off, SPACE)
        if len(w.hash):
            u, inv = np.unique(w.hash, return_inverse=True)
            c = tables[WORD][1][np.searchsorted(tables[WORD][0], u)]
            n_words[i:j] = w.counts
            known[i:j] = np.bincount(w.doc, weights=(c > 0)[inv], minlength=j - i)
            base[i:j] = np.bincount(w.doc, weights=np.log10(c + 1)[inv], minlength=j - i)
    return pa.table({"doc_id": docs["doc_id"], "held_out": docs["held_out"], "n_words": pa.array(n_words), "known": pa.array(known), "base": pa.array(base), "score": pa.array(score)})


def scored(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", parts: int = 7, held: int = 2, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Per row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10 of the text's probability)."""
    kind = dict(docs.dtypes)[doc_id]
    own = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"), (fold(doc_id, parts) == held).alias("held_out"))
    counts = staged(count_keys(own.withColumn("train", ~F.col("held_out"))), "counts")
    whole = own.agg(F.sum(F.octet_length("text").cast("long")).alias("size"), F.count(F.when(~F.col("held_out"), 1)).alias("train")).first()
    words = counts.where(F.col("kind") == WORD).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    n, v, ends = words["n"] + whole["train"], words["v"] + (whole["train"] > 0), whole["train"]

    grams = counts.where(F.col("kind") == GRAM).select("key", "n")
    low = np.zeros((256, 256))
    # at most 256 * 256 rows
    for r in grams.groupBy(F.col("key").bitwiseAND(0xFFFF).alias("pair")).agg(F.sum("n").alias("n")).collect():
        low[r["pair"] >> 8, r["pair"] & 0xFF] = r["n"]
    values = staged(priced(grams, low).select(F.lit(GRAM).cast("byte").alias("kind"), "key", F.col("cost").alias("value")), "prices").union(
        counts.where(F.col("kind") == WORD).select("kind", "key", F.col("n").cast("double").alias("value")))

    n_chunks = max(1, -(-(whole["size"] or 0) // chunk_bytes))
    # chunk c is partition c, so that every task gets one chunk
    dealt = own.withColumn("chunk", F.pmod(F.xxhash64("doc_id", F.length("text")), F.lit(n_chunks)).cast("int")).repartitionById(n_chunks, F.col("chunk"))
    keys = dealt.groupBy("chunk").applyInArrow(distinct_keys, "chunk int, kind byte, key long")
    fetched = keys.join(values, ["kind", "key"], "left").select("chunk", "kind", "key", F.coalesce("value", F.lit(0.0)).alias("value")).repartitionById(n_chunks, F.col("chunk"))
    made = dealt.groupBy("chunk").cogroup(fetched.groupBy("chunk")).applyInArrow(sums, f"doc_id {kind}, held_out boolean, n_words long, known long, base double, score double")
    spread = F.log10(F.lit(float(n + v + 1)))
    return made.select("doc_id", "held_out", (F.col("n_words") + 1).alias("n_tokens"), (F.col("known") + (1 if ends else 0)).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
                       (F.col("base") + F.log10(F.lit(float(ends + 1))) - (F.col("n_words") + 1) * spread).alias("base_score"), "score")


@query("op7_lm_score")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(table(spark, sf_dir, "documents"))
