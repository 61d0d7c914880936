"""Vector index: cell lists searched by angle bounds, with filters (survey section 2.5)."""

from pyspark.sql import functions as F

from auditframe.operators import vector_index as VI
from auditframe.plans import bridge as B

from .registry import query
from .retrieval import COS


@B.memo
def vectors(spark, sf):
    e = B.load(spark, sf, "embeddings")
    return e.select(F.col("vec_id").alias("clause_id"), F.col("embedding").cast("array<double>").alias("vector"), (F.col("label") % 3 == 0).alias("live"), F.col("label").cast("long").alias("label"))


@B.memo
def index(spark, sf):
    return VI.build_index(vectors(spark, sf))


def asked(rows):
    """Every row whose id is divisible by 100 is a query against all rows."""
    return rows.where(F.col("clause_id") % 100 == 0).select(F.col("clause_id").alias("query_id"), "vector")


E = "e AS (SELECT vec_id AS clause_id, label, {v} AS v FROM embeddings)"
PLAIN = E.format(v="list_transform(embedding, lambda x: x::DOUBLE)")
# 24 copies of the 64 numbers, each weighed anew
WIDE = E.format(v="flatten(list_transform(range(24), lambda j: list_transform(embedding, lambda x, i: x::DOUBLE * ((((i - 1) * (j + 3)) % 7) - 3))))")


def exact(source, where="TRUE", k=5):
    return f"""WITH {source}, s AS (SELECT a.clause_id AS query_id, b.clause_id, round({COS}, 9) AS score FROM e a, e b WHERE a.clause_id % 100 = 0 AND {where})
    SELECT query_id, clause_id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY s.score DESC, clause_id) AS rank FROM s QUALIFY rank <= {k}"""


@query("vector_index_topk", exact(PLAIN))
def _(spark, sf):
    return VI.index_topk(index(spark, sf), asked(vectors(spark, sf)), 5, ["clause_id"]).drop("cells_visited")


@query("vector_index_filtered", exact(PLAIN, "b.label % 3 = 0 AND b.label < 7", 10))
def _(spark, sf):
    return VI.index_topk(index(spark, sf), asked(vectors(spark, sf)), 10, ["clause_id"], where=F.col("live") & (F.col("label") < 7)).drop("cells_visited")


@query("vector_index_wide", exact(WIDE))
def _(spark, sf):
    weigh = lambda j: F.transform("vector", lambda x, i: x * ((i * (j + 3)) % 7 - 3))
    rows = vectors(spark, sf).withColumn("vector", F.flatten(F.transform(F.sequence(F.lit(0), F.lit(23)), weigh)))
    return VI.index_topk(VI.build_index(rows), asked(rows), 5, ["clause_id"]).drop("cells_visited")


@query("vector_index_cells", "SELECT count(*) AS n_rows, count(DISTINCT vec_id) AS n_ids FROM embeddings")
def _(spark, sf):
    """Every row is in one cell, and the cells count them all."""
    ix = index(spark, sf)
    return ix.rows.agg(F.count("*").alias("n_rows"), F.countDistinct("clause_id").alias("n_ids")).join(ix.cells.agg(F.sum("n").alias("n")), F.col("n") == F.col("n_rows")).drop("n")
