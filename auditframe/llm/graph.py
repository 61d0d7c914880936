"""Connected components of a large edge table."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged

#: So many edges at most are one task's work, whatever the input.
LAST = 4096
#: Rows of an intermediate table for each of its files, and the least number of files.
FILE_ROWS, FILES = 100_000, 8


def components(edges: DataFrame, name: str = "components", last: int = LAST) -> DataFrame:
    """(id, component) for every id in edges (a, b); component is the smallest id that can be reached.

    Contraction: in each round every node joins the neighbour of the lowest hashed priority (itself included), edges are renamed to
    the chosen nodes and those inside a node vanish.  Priorities differ by round, so long chains shrink as fast as bushes.  Choices are
    made by combining aggregates, so a node with very many edges is no single task's work; each round is two tables in the shared folder.
    Rounds go on until at most `last` edges are left between contracted nodes; these are a group of bounded size, and one task follows them to the end.
    """
    live = staged(edges.select("a", "b").where("a is not null and b is not null and a <> b").distinct(), f"{name}-edges")
    left, places, at = live.count(), None, 0
    while left > last:
        low = lambda c: F.xxhash64(F.lit(at), c)
        both = live.union(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        best = both.groupBy("a").agg(F.min(F.struct(low(F.col("b")).alias("p"), F.col("b").alias("to"))).alias("m"))
        own = F.struct(low(F.col("a")).alias("p"), F.col("a").alias("to"))
        moves = staged(few(best.select(F.col("a").alias("node"), F.least(own, F.col("m"))["to"].alias("to")), left), f"{name}-moves")
        by = lambda side: moves.select(F.col("node").alias(side), F.col("to").alias(f"{side}_to"))
        live = staged(few(live.join(by("a"), "a").join(by("b"), "b").select(F.col("a_to").alias("a"), F.col("b_to").alias("b")).where("a <> b").distinct(), left), f"{name}-edges")
        places = follow(places, moves)
        # all moves of earlier rounds stay in the plan, but for every fourth round
        if at % 4 == 3:
            places = staged(places, f"{name}-places")
        left, at = live.count(), at + 1
    if left:
        places = follow(places, staged(roots(live), f"{name}-moves"))
    if places is None:
        return live.select(F.col("a").alias("id"), F.col("b").alias("component"))
    least = places.groupBy("at").agg(F.min("id").alias("component"))
    return staged(few(places.join(least, "at").select("id", "component"), left), name)


def few(df: DataFrame, rows: int) -> DataFrame:
    """Fewer, fuller files for a table of about so many rows, without a shuffle."""
    return df.coalesce(max(FILES, -(-rows // FILE_ROWS)))


def follow(places: DataFrame | None, moves: DataFrame) -> DataFrame:
    """Where each id is after some more moves (node, to); ids appear with their first move."""
    if places is None:
        return moves.select(F.col("node").alias("id"), F.col("to").alias("at"))
    return places.join(moves, F.col("at") == F.col("node"), "left").select("id", F.coalesce("to", "at").alias("at"))


def roots(edges: DataFrame) -> DataFrame:
    """(node, to): one node of each component for all its nodes, by one task; edges are at most LAST rows."""
    kind = dict(edges.dtypes)["a"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        up: dict = {}

        def top(x):
            while up.setdefault(x, x) != x:
                up[x] = up[up[x]]
                x = up[x]
            return x

        a_type = None
        for batch in batches:
            a_type = batch.schema.field("a").type
            for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist()):
                up[top(a)] = top(b)
        if up:
            yield pa.RecordBatch.from_arrays([pa.array(list(up), a_type), pa.array([top(x) for x in up], a_type)], names=["node", "to"])

    return edges.coalesce(1).mapInArrow(run, f"node {kind}, to {kind}")
