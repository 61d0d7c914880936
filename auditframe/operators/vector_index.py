"""A stored vector index: cell lists around learnt centroids, searched exactly by angle bounds or by a number of nearest cells.

Centroids are learnt by spherical k-means on at most SAMPLE rows (those of smallest hash of the id, a documented bound); every row is then
put into the cell of its nearest centroid, and a cell knows the least and largest angle of its rows.  Angles obey the triangle inequality,
so the cosine of a query with any row of a cell is at most that of the angle by which the query misses the cell's ring.  The exact search
visits the nearest cells first, and afterwards only cells whose bound reaches the k-th best score found there.  Cells are cut into parts of
at most CHUNK rows, so a cell that holds a third of all rows is many tasks.

Zero vectors have no angle and score 0 with everything: they are cell -1, whose bound is 0.  Rows of null vectors, of null or non-finite
entries or of another length than the centroids are left out, as queries and as rows; an empty table gives an empty index.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ordered as O
from ..session import stage

SAMPLE = 8192
MAX_CELLS = 2048
ROUNDS = 8
CHUNK = 20_000
QUERIES = 1024
#: Scores are rounded to nine places; bounds keep clear of that.
SLACK = 1e-8


@dataclass
class VectorIndex:
    """rows: the indexed columns, vector, cell, angle and part; cells: cell, centroid, near, far (least and largest angle), n, parts."""

    rows: DataFrame
    cells: DataFrame


def _usable(df: DataFrame, size: int | None = None) -> DataFrame:
    fine = F.forall("vector", lambda v: F.coalesce(F.abs(v) < F.lit(float("inf")), F.lit(False)))
    return df.where(fine & (F.size("vector") > 0) if size is None else fine & (F.size("vector") == size))


def _units(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = np.linalg.norm(m, axis=1)
    return np.divide(m, n[:, None], out=np.zeros_like(m), where=n[:, None] > 0), n


def learn_centroids(sample: np.ndarray, cells: int, rounds: int = ROUNDS) -> np.ndarray:
    """Spherical k-means on unit rows; starts from rows far from each other and re-seeds empty cells with the worst placed rows."""
    start = [0]
    best = sample @ sample[0]
    while len(start) < cells:
        nxt = int(np.argmin(best))
        if best[nxt] > 1 - 1e-12:
            break
        start.append(nxt)
        best = np.maximum(best, sample @ sample[nxt])
    c = sample[start]
    for _ in range(rounds):
        s = sample @ c.T
        own = s.argmax(1)
        total = np.zeros_like(c)
        np.add.at(total, own, sample)
        filled, n = _units(total)
        c = np.where(n[:, None] > 1e-9, filled, c)
    return c


def _sample(kb: DataFrame, key: str, sample: int) -> DataFrame:
    """One row (hash, key, vector) per id of the `sample` smallest hashes, zero vectors left out.

    The ids are chosen without their vectors: an ordered limit sends that many rows of every partition to the driver.
    """
    some = kb.where(F.exists("vector", lambda v: v != 0)).select(F.xxhash64(key).alias("_h"), key, "vector")
    ids = some.select("_h", key).orderBy("_h", key).limit(sample).distinct()
    return some.join(F.broadcast(ids), ["_h", key], "left_semi").dropDuplicates(["_h", key])


def build_index(kb: DataFrame, key: str = "clause_id", cells: int | None = None, sample: int = SAMPLE, chunk: int = CHUNK) -> VectorIndex:
    """Index all rows of kb (key, vector and any further columns); cells: by default the square root of the rows, MAX_CELLS at most."""
    kb = _usable(kb.withColumn("vector", F.col("vector").cast("array<double>")))
    sizes = kb.groupBy(F.size("vector").alias("s")).count().orderBy(F.desc("count"), F.desc("s")).collect()
    size, n = (sizes[0]["s"], sizes[0]["count"]) if sizes else (1, 0)
    kb = kb.where(F.size("vector") == size)
    some = _sample(kb, key, sample).toPandas().sort_values(["_h", key])
    wanted = min(MAX_CELLS, max(1, round(n**0.5))) if cells is None else cells
    centroids = learn_centroids(_units(np.stack(some["vector"]).astype(float))[0], wanted) if len(some) else np.zeros((0, size))
    held = kb.sparkSession.sparkContext.broadcast(centroids)  # MAX_CELLS * size numbers

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = held.value
        for pdf in frames:
            if not len(pdf):
                continue
            u, norm = _units(np.stack(pdf["vector"]).astype(float))
            s = u @ c.T if len(c) else np.zeros((len(u), 1))
            own = s.argmax(1)
            pdf["cell"] = np.where(norm > 0, own, -1).astype(np.int32)
            pdf["angle"] = np.arccos(np.clip(s[np.arange(len(u)), own], -1, 1))
            yield pdf

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kb.schema.fields) + ", cell int, angle double"
    placed = stage(kb.mapInPandas(place, schema))
    rings = placed.groupBy("cell").agg(F.min("angle").alias("near"), F.max("angle").alias("far"), F.count("*").alias("n"))
    rings = rings.withColumn("parts", F.ceil(F.col("n") / chunk).cast("int"))
    table = kb.sparkSession.createDataFrame([(-1, [0.0] * size), *[(i, c.tolist()) for i, c in enumerate(centroids)]], "cell int, centroid array<double>")
    cells_table = stage(rings.join(table, "cell").select("cell", "centroid", "near", "far", "n", "parts"))
    rows = stage(placed.join(cells_table.select("cell", "parts"), "cell").withColumn("part", F.pmod(F.xxhash64(key), "parts").cast("int")).drop("parts"))
    return VectorIndex(rows, cells_table)


def visits(index: VectorIndex, queries: DataFrame) -> DataFrame:
    """(query_id, vector, cells): all cells of the index with the highest cosine a row of theirs can have, best bound first."""
    c = index.cells.orderBy("cell").toPandas()  # MAX_CELLS + 1 rows
    size = len(c["centroid"].iloc[0]) if len(c) else 1
    held = queries.sparkSession.sparkContext.broadcast((np.stack(c["centroid"]).astype(float) if len(c) else np.zeros((0, size)), c["cell"].to_numpy(), c["near"].to_numpy(), c["far"].to_numpy()))
    q = _usable(queries.select("query_id", F.col("vector").cast("array<double>").alias("vector")), size)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        centroids, names, near, far = held.value
        for pdf in frames:
            if not len(pdf):
                continue
            u, norm = _units(np.stack(pdf["vector"]).astype(float))
            angle = np.arccos(np.clip(u @ centroids.T, -1, 1))
            bound = np.cos(np.maximum(0, np.maximum(angle - far, near - angle)))
            bound[:, names < 0] = 0
            bound[norm == 0] = 0
            order = np.argsort(-bound, axis=1, kind="stable")
            pdf["cells"] = [[{"cell": int(names[j]), "bound": float(b[j])} for j in o] for o, b in zip(order, bound)]
            yield pdf

    return q.mapInPandas(run, f"query_id {dict(queries.dtypes)['query_id']}, vector array<double>, cells array<struct<cell: int, bound: double>>")


def _scan(index: VectorIndex, rows: DataFrame, asked: DataFrame, k: int, own: list[str]) -> DataFrame:
    """The k best rows of each (query, cell, part): asked holds query_id, vector, cell."""
    asked = asked.join(index.cells.select("cell", "parts"), "cell").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    rows = rows.select(*own, "vector", "cell", "part")
    types = dict(rows.dtypes)
    qt = dict(asked.dtypes)["query_id"]

    def best(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": right["query_id"][:0], **{c: left[c][:0] for c in own}, "score": pd.Series([], dtype="float64")})
        left = left.sort_values(own, kind="stable")  # equal scores: first in order
        m = np.stack(left["vector"]).astype(float)
        norm = np.linalg.norm(m, axis=1)
        out = []
        for a in range(0, len(right), QUERIES):
            some = right.iloc[a : a + QUERIES]
            q = np.stack(some["vector"]).astype(float)
            den = np.linalg.norm(q, axis=1)[:, None] * norm[None, :]
            s = np.divide(q @ m.T, den, out=np.zeros_like(den), where=den != 0).round(9)
            top = np.argsort(-s, axis=1, kind="stable")[:, :k]
            out.append(pd.DataFrame({"query_id": np.repeat(some["query_id"].to_numpy(), top.shape[1]), **{c: left[c].to_numpy()[top].ravel() for c in own}, "score": np.take_along_axis(s, top, 1).ravel()}))
        return pd.concat(out)

    return rows.groupBy("cell", "part").cogroup(asked.drop("parts").groupBy("cell", "part")).applyInPandas(best, f"query_id {qt}, " + ", ".join(f"`{c}` {types[c]}" for c in own) + ", score double")


def index_topk(index: VectorIndex, queries: DataFrame, k: int, order: list[str], where: Column | None = None, probes: int = 4, exact: bool = True) -> DataFrame:
    """Cosine top k per query with its rank and the number of cells visited; equal scores follow `order` (columns of the index, ids last).

    where filters rows by any indexed columns (status, type, tags, dates) before they are scored.  exact=False stops after the `probes` best cells.
    """
    rows = index.rows if where is None else index.rows.where(where)
    asked = stage(visits(index, queries))
    by_score = [F.desc("score"), *order]
    first = asked.select("query_id", "vector", F.explode(F.slice("cells", 1, probes)).alias("c")).select("query_id", "vector", "c.cell")
    found = stage(_scan(index, rows, first, k, order))
    lead = O.top_k(found, ["query_id"], by_score, k)
    seen = F.least(F.size("cells"), F.lit(probes))
    if not exact:
        return lead.join(asked.select("query_id", seen.cast("long").alias("cells_visited")), "query_id")
    reached = lead.where(F.col("rank") == k).select("query_id", F.col("score").alias("kth"))
    rest = asked.join(reached, "query_id", "left").withColumn("more", F.filter(F.slice("cells", probes + 1, MAX_CELLS + 1), lambda c: F.coalesce(c["bound"] >= F.col("kth") - SLACK, F.lit(True))))
    rest = stage(rest.select("query_id", "vector", F.transform("more", lambda c: c["cell"]).alias("more"), (seen + F.size("more")).cast("long").alias("cells_visited")))
    later = _scan(index, rows, rest.select("query_id", "vector", F.explode("more").alias("cell")), k, order)
    both = O.top_k(found.unionByName(later), ["query_id"], by_score, k)
    return both.join(rest.select("query_id", "cells_visited"), "query_id")


def probes_for(index: VectorIndex, queries: DataFrame, k: int, order: list[str], target: float = 0.95, sample: int = 256) -> int:
    """The number of cells an approximate search has to visit for a recall of about `target`.

    The true neighbours of at most `sample` queries (those of smallest hash) are found exactly; the answer is the place, in the
    order of visits, within which that share of them lies.
    """
    some = queries.select("query_id", "vector").orderBy(F.xxhash64("query_id"), "query_id").limit(sample)
    some = stage(some)
    true = index_topk(index, some, k, order).select("query_id", order[-1])
    at = visits(index, some).select("query_id", F.posexplode("cells").alias("pos", "c")).select("query_id", (F.col("pos") + 1).alias("place"), "c.cell")
    places = true.join(index.rows.select(order[-1], "cell"), order[-1]).join(at, ["query_id", "cell"])
    got = places.agg(F.percentile("place", F.lit(target)).alias("p")).first()["p"]
    return 1 if got is None else int(np.ceil(got))


def recall(exact: DataFrame, found: DataFrame, key: str) -> float:
    """Share of the rows of an exact answer that another answer holds."""
    n = exact.count()
    return exact.join(found.select("query_id", key), ["query_id", key], "left_semi").count() / n if n else 1.0
