"""Quality classifier: nearest-neighbour voting over latent-semantic vectors.

Terms of a text are its runs of three byte classes (letters by case, digits, blanks, line ends, kinds of punctuation, others) and its
word repetitions; they are weighted by square root of frequency and inverse document frequency and scaled to length one.  Latent
directions are the leading eigenvectors of the Gram matrix of at most `sample` labelled texts (a documented bound: the `sample` labelled
ids of smallest hash).  Their projected vectors, labels and the directions are broadcast (at most sample * RANK floats and TERMS * RANK
floats, 4 MB with the defaults), and every document's cosines with all of them are computed exactly, a block of documents at a time; the
k nearest vote, each with a weight that grows with its similarity, next to a small vote of the overall share.

Null and empty texts have no terms, hence no neighbours, and get the overall share of label 1; without labelled rows that share is 0.5.
Labels, lang, source and doc_id are no terms.  Null ids are in fold 0 and are scored like others; repeated rows get equal scores.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fold, query, staged, table
from .words import SPACE, Words, column, slices

SAMPLE = 6000
RANK = 64
NEIGHBOURS = 25
POWER = 8.0
PRIOR_VOTE = 0.5
BLOCK = 1024

KINDS = ["abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t", "\n\r\x0b\x0c", ".,;:'\"()-", "!?", "#*$%&", "|<>"]
KIND = np.full(256, len(KINDS), np.uint8)
for _i, _s in enumerate(KINDS):
    KIND[[ord(c) for c in _s]] = _i
KIND[128:] = len(KINDS) + 1
BASE = len(KINDS) + 2
EXTRA = 4
TERMS = BASE**3 + EXTRA


def terms(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Square roots of term counts, a row for each text."""
    rows = len(offsets) - 1
    kind = KIND[data].astype(np.int64)
    out = np.zeros((rows, TERMS), np.float32)
    if len(data) > 2:
        of = np.repeat(np.arange(rows), np.diff(offsets))
        code = (kind[:-2] * BASE + kind[1:-1]) * BASE + kind[2:]
        inside = of[:-2] == of[2:]
        out += np.bincount((of[:-2] * TERMS + code)[inside], minlength=rows * TERMS).reshape(rows, TERMS)
    w = Words(data, offsets, SPACE)
    h, d = w.hash, w.doc
    for i, gap in enumerate((1, 2)):
        same = (h[gap:] == h[:-gap]) & (d[gap:] == d[:-gap])
        out[:, BASE**3 + i] = np.bincount(d[gap:][same], minlength=rows)
    o = np.lexsort((h, d))
    again = (h[o][1:] == h[o][:-1]) & (d[o][1:] == d[o][:-1])
    out[:, BASE**3 + 2] = np.bincount(d[o][1:][again], minlength=rows)
    out[:, BASE**3 + 3] = w.counts
    return np.sqrt(out)


def scaled(x: np.ndarray) -> np.ndarray:
    n = np.sqrt((x * x).sum(1, keepdims=True))
    return x / np.where(n > 0, n, 1)


class Model:
    """Latent directions, labelled vectors and their labels.  x are rows of terms(); they are scaled a block at a time, so they stand in memory once."""

    def __init__(self, x: np.ndarray, y: np.ndarray, rank: int = RANK):
        self.share = float(y.mean()) if len(y) else 0.5
        self.y = y.astype(np.float32)
        blocks = range(0, len(x), BLOCK)
        used = sum(((x[i : i + BLOCK] > 0).sum(0) for i in blocks), np.zeros(x.shape[1]))
        self.idf = (np.log((1 + len(x)) / (1 + used)) + 1).astype(np.float32)
        gram = np.zeros((x.shape[1], x.shape[1]))
        for i in blocks:
            z = scaled(x[i : i + BLOCK] * self.idf)
            gram += z.T @ z
        values, vectors = np.linalg.eigh(gram)
        self.directions = vectors[:, np.argsort(-values)[:rank]].astype(np.float32)
        del gram, vectors
        self.vectors = np.concatenate([np.zeros((0, self.directions.shape[1]), np.float32), *[scaled(scaled(x[i : i + BLOCK] * self.idf) @ self.directions) for i in blocks]])

    def score(self, x: np.ndarray, k: int = NEIGHBOURS, power: float = POWER, prior: float = PRIOR_VOTE) -> np.ndarray:
        if not len(self.y):
            return np.full(len(x), self.share)
        v = scaled(scaled(x * self.idf) @ self.directions)
        cos = v @ self.vectors.T
        k = min(k, len(self.y))
        near = np.argpartition(-cos, k - 1, axis=1)[:, :k]
        w = np.maximum(np.take_along_axis(cos, near, 1), 0).astype(np.float64) ** power
        return ((w * self.y[near]).sum(1) + prior * self.share) / (w.sum(1) + prior)


def labelled_sample(docs: DataFrame, labels: DataFrame, doc_id: str, text: str, label: str, held: int | None, sample: int) -> tuple[np.ndarray, np.ndarray]:
    """Terms and labels of at most `sample` labelled documents: the ids of smallest hash, outside the held fold."""
    ids = labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull())
    if held is not None:
        ids = ids.where(fold(doc_id, 3) != held)
    ids = ids.groupBy(F.col(doc_id).alias("k_id")).agg(F.max(F.col(label).cast("int")).alias("y")).orderBy(F.xxhash64("k_id"), "k_id").limit(sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = column(batch, "text")
            for i, j in slices(offsets, rows=BLOCK):
                x = terms(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                yield pa.RecordBatch.from_arrays([batch.column("k_id").slice(i, j - i), batch.column("y").slice(i, j - i), pa.array([r.tobytes() for r in x], pa.binary())], names=["k_id", "y", "x"])

    # at most `sample` ids: a broadcast of known size
    rows = docs.select(F.col(doc_id).alias("k_id"), F.coalesce(text, F.lit("")).alias("text")).join(F.broadcast(ids), "k_id").select("k_id", "y", "text")
    kind = dict(rows.dtypes)["k_id"]
    held = staged(rows.mapInArrow(run, f"k_id {kind}, y int, x binary").groupBy("k_id").agg(F.min(F.struct("x", "y")).alias("r")).select("k_id", "r.x", "r.y"), "sample")
    # at most `sample` rows, filled in one after another and put in order of their ids
    x, y, at = np.zeros((held.count(), TERMS), np.float32), [], []
    for r in held.coalesce(8).toLocalIterator():
        x[len(y)] = np.frombuffer(r["x"], np.float32)
        y.append(r["y"])
        at.append(r["k_id"])
    order = sorted(range(len(at)), key=at.__getitem__)
    return x[order], np.array(y, np.int64)[order]


def with_scores(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", held: int | None = 1,
                sample: int = SAMPLE, rank: int = RANK, k: int = NEIGHBOURS, power: float = POWER, prior: float = PRIOR_VOTE, out: str = "score") -> DataFrame:
    """docs with a column `out`: the vote for label 1, between 0 and 1."""
    model = docs.sparkSession.sparkContext.broadcast(Model(*labelled_sample(docs, labels, doc_id, text, label, held, sample), rank))
    docs = docs.drop(out).withColumn(out, F.lit(0.0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for batch in batches:
            data, offsets = column(batch, text)
            scores = np.zeros(batch.num_rows)
            for i, j in slices(offsets, rows=BLOCK):
                scores[i:j] = m.score(terms(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]), k, power, prior)
            yield pa.RecordBatch.from_arrays([pa.array(scores) if n == out else batch.column(c) for c, n in enumerate(batch.schema.names)], names=batch.schema.names)

    return docs.mapInArrow(run, docs.schema)


def drop_low_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The documents scored at least threshold, with their own columns."""
    name = "score" if "score" not in docs.columns else "quality_vote"
    return with_scores(docs, labels, out=name).where(F.col(name) >= threshold).select(*docs.columns)


@query("op3_quality_classifier")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = with_scores(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
