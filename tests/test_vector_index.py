"""The vector index against brute force: exact search, skipped cells, measured recall, filters and edge rows."""
import numpy as np
from pyspark.sql import functions as F

from auditframe.operators import vector_index as VI


def clustered(n=1200, dim=16, groups=12, seed=0):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(groups, dim))
    own = rng.integers(0, groups, n)
    return [(i, (centre[g] + 0.15 * rng.normal(size=dim)).tolist(), int(g)) for i, g in enumerate(own)]


def brute(rows, queries, k):
    ids, m = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    out = {}
    for i, v in queries:
        v = np.array(v)
        den = np.linalg.norm(m, axis=1) * np.linalg.norm(v)
        s = np.divide(m @ v, den, out=np.zeros(len(m)), where=den > 0).round(9)
        o = sorted(range(len(ids)), key=lambda j: (-s[j], ids[j]))[:k]
        out[i] = [(int(ids[j]), float(s[j])) for j in o]
    return out


def answers(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.clause_id, r.score))
    return out


KIND = "clause_id long, vector array<double>, grp long"


def test_exact_search_skips_cells_and_keeps_every_neighbour(spark):
    rows = clustered() + [(5000 + i, [0.0] * 16, 3) for i in range(4)] + [(6000 + i, [1.0] * 16, 4) for i in range(40)]
    queries = [(r[0], r[1]) for r in rows if r[0] % 100 == 0] + [(-1, [0.0] * 16), (-2, [-1.0] * 16)]
    ix = VI.build_index(spark.createDataFrame(rows, KIND), cells=24, chunk=50)
    assert ix.rows.count() == len(rows) == ix.cells.agg(F.sum("n")).first()[0] and ix.cells.agg(F.max("parts")).first()[0] > 1
    got = VI.index_topk(ix, spark.createDataFrame(queries, "query_id long, vector array<double>"), 5, ["clause_id"])
    assert answers(got) == brute(rows, queries, 5)
    seen = [r.cells_visited for r in got.where("query_id >= 0 and query_id < 5000").collect()]
    assert np.mean(seen) < ix.cells.count() / 2


def test_filters_hold_before_the_search(spark):
    rows = clustered(400)
    queries = [(r[0], r[1]) for r in rows if r[0] % 50 == 0]
    ix = VI.build_index(spark.createDataFrame(rows, KIND), cells=10)
    got = VI.index_topk(ix, spark.createDataFrame(queries, "query_id long, vector array<double>"), 4, ["clause_id"], where=F.col("grp").isin(1, 2))
    assert answers(got) == brute([r for r in rows if r[2] in (1, 2)], queries, 4)


def test_measured_recall_of_the_approximate_search(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=8).tolist(), 0) for i in range(1500)]
    queries = spark.createDataFrame([(r[0], r[1]) for r in rows if r[0] % 10 == 0], "query_id long, vector array<double>")
    ix = VI.build_index(spark.createDataFrame(rows, KIND), cells=40)
    probes = VI.probes_for(ix, queries, 5, ["clause_id"], sample=60)
    exact = VI.index_topk(ix, queries, 5, ["clause_id"])
    found = VI.index_topk(ix, queries, 5, ["clause_id"], probes=probes, exact=False)
    assert probes < 40 and VI.recall(exact, found, "clause_id") >= 0.9 and VI.recall(exact, exact, "clause_id") == 1


def test_edge_rows_of_the_index(spark):
    none = VI.build_index(spark.createDataFrame([], KIND))
    q = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [1.0]), (4, [None, 1.0])], "query_id long, vector array<double>")
    assert VI.index_topk(none, q, 3, ["clause_id"]).count() == 0
    rows = [(1, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, None, 1), (3, [float("nan"), 1.0], 1), (4, [None, 1.0], 1), (5, [1.0, 2.0, 3.0], 1), (6, [0.0, 1.0], 1)]
    ix = VI.build_index(spark.createDataFrame(rows, KIND))
    assert answers(VI.index_topk(ix, q, 3, ["clause_id"])) == {1: [(1, 1.0), (1, 1.0), (6, 0.0)]}


def test_sample_chooses_ids_without_vectors(spark):
    """The ids of smallest hash, one row each, and no ordered limit over rows that carry their vectors."""
    df = spark.createDataFrame([(i, [float(i % 3), 0.0]) for i in range(300)], "clause_id long, vector array<double>").repartition(7)
    some = VI._sample(df, "clause_id", 40)
    want = df.where(F.col("vector")[0] != 0).orderBy(F.xxhash64("clause_id"), "clause_id").limit(40).collect()
    assert [r.clause_id for r in sorted(some.collect(), key=lambda r: r._h)] == [r.clause_id for r in want]
    limits = [line for line in some._jdf.queryExecution().executedPlan().toString().splitlines() if "TakeOrdered" in line]
    assert limits and not any("vector" in line for line in limits)
