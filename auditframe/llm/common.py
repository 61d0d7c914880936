"""Shared folder, staged tables and registration for the operators of this package."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

_own: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the cluster names it; a local session without one (tests) gets its own."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="llm-shared-"))
    return _own[0]


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it again: lineage ends there and a lost executor costs no recomputation."""
    path = f"{shared_dir(df.sparkSession)}/llm/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(name: str, oracle: str | None = None):
    """Register a query, with its SQL where there is one."""
    def put(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f
    return put


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate value once per row and hand it to body; a plain column would be evaluated again for each element of a lambda."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def fold(doc_id: str | Column, parts: int) -> Column:
    """crc32 of the id as text, modulo parts (null ids: fold 0)."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(c.cast("string").cast("binary")) % parts, F.lit(0))
