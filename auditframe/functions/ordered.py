"""Helpers for results whose order is part of the meaning.

A list in the source data is a table plus an order column here.  Two rules keep
these helpers safe on skewed keys:

* one surviving row per key is an aggregate (``max_by`` / ``min_by`` over a
  struct), so it is combined on the map side and a hot key costs one row per
  input partition;
* numbering inside a key is done in two levels: rows are numbered inside a
  (key, chunk) range and shifted by the running count of the earlier chunks,
  so no task ever sorts a whole hot key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHUNK = 4096


def _cols(names) -> list[Column]:
    return [F.col(n) if isinstance(n, str) else n for n in names]


def first_by(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """One row per key: the smallest by ``order`` (use negated columns for descending)."""
    rest = [c for c in df.columns if c not in keys]
    order_struct = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(_cols(order))])
    best = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), order_struct).alias("_best"))
    return best.select(*keys, "_best.*").select(*df.columns)


def numbered(df: DataFrame, keys: list[str], order: list, name: str, chunk: Column | None = None) -> DataFrame:
    """1-based position inside ``keys`` by ``order``.

    ``chunk`` must be non-decreasing along ``order`` (for example page or
    block_no divided by a constant).  With it, the window partition is
    (keys, chunk) and a small count table supplies the offsets.
    """
    if chunk is None:
        w = Window.partitionBy(*keys).orderBy(*_cols(order))
        return df.withColumn(name, F.row_number().over(w).cast("long"))
    df = df.withColumn("_chunk", chunk)
    counts = df.groupBy(*keys, "_chunk").agg(F.count(F.lit(1)).alias("_n"))
    run = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*keys, "_chunk", F.coalesce(F.sum("_n").over(run), F.lit(0)).alias("_base"))
    w = Window.partitionBy(*keys, "_chunk").orderBy(*_cols(order))
    local = df.withColumn("_local", F.row_number().over(w))
    out = local.join(offsets, [*keys, "_chunk"])
    return out.withColumn(name, (F.col("_base") + F.col("_local")).cast("long")).drop("_chunk", "_base", "_local")


def top_k(df: DataFrame, keys: list[str], order: list, k: int, name: str = "rank") -> DataFrame:
    """First k rows per key.  The planner limits each group before the shuffle,
    so a hot key ships at most k rows per input partition."""
    w = Window.partitionBy(*keys).orderBy(*_cols(order))
    return df.withColumn(name, F.row_number().over(w)).where(F.col(name) <= k).withColumn(name, F.col(name).cast("long"))


def carry(df: DataFrame, keys: list[str], order: list, columns: dict[str, Column], chunk: Column) -> DataFrame:
    """Last non-null value of each column at or before the row.

    Works in (keys, chunk) ranges; one summary row per range carries the value
    across ranges, so a hot key is never sorted in one task.
    """
    df = df.withColumn("_chunk", chunk)
    w = Window.partitionBy(*keys, "_chunk").orderBy(*_cols(order)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = df
    for name, c in columns.items():
        local = local.withColumn(f"_src_{name}", c).withColumn(f"_own_{name}", F.last(f"_src_{name}", ignorenulls=True).over(w))
    pos = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(_cols(order))])
    ends = local.groupBy(*keys, "_chunk").agg(
        *[F.max_by(F.col(f"_src_{n}"), F.when(F.col(f"_src_{n}").isNotNull(), pos)).alias(f"_end_{n}") for n in columns])
    run = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select(*keys, "_chunk", *[F.last(f"_end_{n}", ignorenulls=True).over(run).alias(f"_before_{n}") for n in columns])
    out = local.join(ends, [*keys, "_chunk"])
    return out.select(*[c for c in df.columns if c != "_chunk"],
                      *[F.coalesce(f"_own_{n}", f"_before_{n}").alias(n) for n in columns])


def islands(df: DataFrame, keys: list[str], order: list[str], starts: Column, name: str) -> DataFrame:
    """Number runs of rows: ``starts`` is true where a new run begins."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(name, F.sum(starts.cast("long")).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))


def joined_list(value, order, sep: str) -> Column:
    """Aggregate: values joined in order.  Use where the joined text is itself one bounded value."""
    items = F.array_sort(F.collect_list(F.struct(*_cols(order), (F.col(value) if isinstance(value, str) else value).alias("v"))))
    return F.array_join(F.transform(items, lambda s: s["v"]), sep)
