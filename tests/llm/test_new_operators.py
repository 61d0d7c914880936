"""Whitening, filter audit and I-Match fingerprints against plain Python and numpy, and on edge rows."""
import hashlib
import itertools
import os
import random
import re
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(__file__))

from auditframe.llm import filter_audit, imatch, registry, whitening  # noqa: E402


def write(spark, folder, **tables):
    for name, df in tables.items():
        df.write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def prose(rng, n, vocabulary=300):
    return " ".join(f"w{int(rng.paretovariate(0.7)) % vocabulary}" for _ in range(n))


# ---- whitening

def brute_whitening(rows):
    ok = [(i, [int(np.floor(256 * c)) for c in np.array(v, float)]) for i, v in rows if v and all(c is not None and np.isfinite(c) for c in v)]
    fit = np.array(sorted({tuple(x) for _, x in ok}))
    n, s = len(fit), fit.sum(0)
    v = (fit - s / n).T @ (fit - s / n) / n
    values, vectors = np.linalg.eigh(v)
    values, vectors = values[::-1], vectors[:, ::-1]
    return n, s, values, vectors, ok


def test_spectra_of_rank_one_updates_are_those_of_the_scatter_matrix():
    rng = np.random.default_rng(5)
    for x in (rng.normal(size=(300, 12)), rng.integers(0, 2, (200, 6)).astype(float), (rng.integers(-4, 4, (80, 2)) @ rng.integers(-3, 3, (2, 9))).astype(float), np.ones((5, 3)), rng.normal(size=(2, 7))):
        parts = [whitening.Spectrum.empty(x.shape[1]) for _ in range(3)]
        for i, row in enumerate(x):
            parts[i % 3].add(row)
        for other in parts[1:]:
            parts[0].merge(other)
        c = x - x.mean(0)
        s = parts[0]
        scale = max(1.0, np.abs(c.T @ c).max())
        assert s.n == len(x) and np.abs(s.mean - x.mean(0)).max() < 1e-12
        assert np.abs(s.vectors * s.values @ s.vectors.T - c.T @ c).max() < 1e-12 * scale
        assert np.abs(s.vectors.T @ s.vectors - np.eye(x.shape[1])).max() < 1e-12


def test_secular_roots_lie_between_the_values_and_solve_the_equation():
    d, z2 = np.array([0.0, 1e-9, 1.0, 1.0 + 1e-7, 50.0]), np.array([1e-12, 0.3, 0.2, 0.1, 0.4])
    pole, offset = whitening.secular_roots(d, z2, 2.5)
    got = d[pole] + offset
    want = np.linalg.eigvalsh(np.diag(d) + 2.5 * np.sqrt(np.outer(z2, z2)))
    assert (got[:-1] <= d[1:]).all() and (got >= d).all() and np.abs(got - want).max() < 1e-13


def test_whitening_matches_numpy(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(whitening, "ROWS", 20)
    monkeypatch.setattr(whitening, "FAN", 3)
    rng = np.random.default_rng(1)
    rows = [(i, (rng.normal(size=6) * [1, 3, 0.5, 2, 0.2, 0.1]).tolist()) for i in range(400)]
    rows += [(1000 + i, rows[7][1]) for i in range(150)] + [(7, rows[7][1]), (2000, None), (2001, [None] * 6), (2002, [float("nan")] + [0.0] * 5), (2003, [float("inf")] + [0.0] * 5), (None, rows[3][1]), (2004, [-0.0] * 6), (2005, [1.0, 2.0]), (2006, []), (2007, [1e30] + [0.0] * 5)]
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(9)
    got = registry.QUERIES["op11_whitening"](spark, write(spark, tmp_path, embeddings=docs)).collect()
    usable = [(i, np.float32(v).tolist()) for i, v in rows if v and len(v) == 6 and 1e30 not in v and None not in v]
    n, s, values, vectors, ok = brute_whitening(usable)
    assert len(got) == 4 * len(ok)
    want = {}
    for i, x in ok:
        want[i] = int(((n * np.array(x) - s) ** 2).sum()), (np.array(x) - s / n) @ vectors[:, :4] / np.sqrt(values[:4])
    turns = {}
    for r in got:
        dev, w = want[r.vec_id]
        assert (r.n, r.deviation) == (n, dev) and abs(r.explained - values[r.component - 1] / values.sum()) < 1e-12 and r.identity_error < 1e-10
        sign = turns.setdefault(r.component, np.sign(w[r.component - 1] * r.whitened))
        assert abs(r.whitened - sign * w[r.component - 1]) < 1e-9


def test_whitening_of_edge_tables(spark):
    kind = "vec_id long, embedding array<double>, x string, row int, v int, whitening int"
    assert whitening.whitened(spark.createDataFrame([], kind)).count() == 0
    same = [(i, [1.0, 2.0], "own", 1, 2, 3) for i in range(5)]
    assert whitening.whitened(spark.createDataFrame(same, kind)).count() == 0
    got = whitening.whitened(spark.createDataFrame(same + [(9, [2.0, 4.0], "own", 1, 2, 3), (10, [1.0], "own", 1, 2, 3)], kind)).collect()
    assert len(got) == 6 and {len(r.whitening.whitened) for r in got} == {1} and {(r.x, r.row, r.v) for r in got} == {("own", 1, 2)}
    assert all(abs(abs(r.whitening.whitened[0]) - 1) < 1e-12 and r.whitening.explained == [1.0] for r in got)


def test_deviations_are_exact_or_null_beyond_a_long():
    m = whitening.Whitening(10**6, [3, -(10**9)], np.ones(1), np.ones((2, 1)), 1.0)
    x = np.array([[2, -7], [1500, 1], [2**40, 5]])
    want = [sum((10**6 * int(a) - s) ** 2 for a, s in zip(r, m.sums)) for r in x]
    assert m.deviations(x) == [v if v < 2**63 else None for v in want] and want[2] > 2**63 > want[1]


# ---- filter audit

def brute_audit(docs, labels):
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, x in labels if x == 1 and i is not None}
    first = {}
    for i, t, _ in docs:
        if i is not None:
            first[t or ""] = min(first.get(t or "", i), i)
    parts = {}
    for i, t, lang in docs:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = "".join(f for f, c in zip("ABCDE", (len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), re.search(r"[#$%&*|]", t), i is not None and i > first[t])) if c)
        parts.setdefault(lang or "", []).append((fails, i in good, i in toxic))
    out = {}
    for part, rows in parts.items():
        total = dict.fromkeys("ABCDE", 0)
        for o in itertools.permutations("ABCDE"):
            left = rows
            for s, f in enumerate(o, 1):
                gone = [r for r in left if f in r[0]]
                left = [r for r in left if f not in r[0]]
                before = [r for r in rows if set(o[: s - 1]) & set(r[0])]
                total[f] += len(gone)
                out[part, "".join(o), s] = [len(left), len(gone), sum(f in r[0] for r in before), sum(r[0] == f for r in rows), sum(r[1] for r in gone), sum(r[2] for r in gone)]
        for (p, o, s), v in out.items():
            if p == part:
                v.append(total[o[s - 1]])
    return out


def test_filter_audit_matches_brute_force(spark, tmp_path):
    rng = random.Random(2)
    texts = [None, "", " \t", "A", "a # b", prose(rng, 250), prose(rng, 250).upper(), " ".join(f"u{i}" for i in range(220)), " ".join(f"u{i}" for i in range(220)) + " | X", "É" * 50, "word " * 20000]
    docs = [(i, texts[i % len(texts)], ["en", "de", None, ""][rng.randrange(4)]) for i in range(120)]
    docs += [(5, texts[5], "en"), (5, texts[5], "en"), (5, "other", "fr"), (None, texts[5], "en"), (None, texts[7], None), (200, "only", "xx"), (-1, "A", "de")]
    labels = [(i, rng.randrange(2), rng.randrange(2)) for i in range(0, 120, 2)] + [(4, None, None), (4, 1, None), (None, 1, 1), (999, 1, 1)]
    folder = write(spark, tmp_path, documents=spark.createDataFrame([(i, t, lang, "own", 3) for i, t, lang in docs], "doc_id long, text string, lang string, part string, n int"), labels=spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    got = registry.QUERIES["op12_filter_audit"](spark, folder).collect()
    want = brute_audit(docs, labels)
    assert len(got) == len(want) == 600 * len({lang or "" for _, _, lang in docs})
    for r in got:
        assert [r[c] for c in filter_audit.COUNTS] == want[r.part, r.filter_order, r.step]


def test_removal_steps_are_the_first_failing_filters():
    orders = np.array(list(itertools.permutations(range(4))))
    steps = filter_audit.removal_steps(np.arange(16), orders)
    for m in range(16):
        for o, s in zip(orders, steps[m]):
            assert s == next((k for k, f in enumerate(o) if m >> f & 1), 4)


def test_filter_audit_of_empty_tables_and_without_copies(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    counts = lambda d, names, copies: filter_audit.mask_counts(d, labels, filter_audit.failures(F.col("text")), names, copies)
    assert filter_audit.audit(counts(docs, "ABCDE", True), "ABCDE").count() == 0
    some = spark.createDataFrame([(1, "x", "en"), (2, "x", "en"), (None, "x #", None)], docs.schema)
    assert {tuple(r) for r in counts(some, "ABCD", False).collect()} == {("en", 1, False, False, 2), ("", 9, False, False, 1)}


# ---- fingerprints

def brute_ring(docs):
    """Edited text of each row with an id: rows by descending id, the first after the last."""
    order = sorted(docs, key=lambda r: -r[0])
    out = {}
    for (i, t), (_, nxt) in zip(order, order[1:] + order[:1]):
        t, nxt = t or "", nxt or ""
        cut = len(t) // 3
        out[i] = (t, t[: len(t) - cut] + nxt[:cut], nxt)
    return out


def test_fingerprints_edited_texts_and_likeness(spark, tmp_path):
    rng = random.Random(3)
    texts = [None, "", "one", "a\U0001F600é b c d e", "...", prose(rng, 8000)] + [prose(rng, rng.randrange(5, 400)) for _ in range(90)]
    docs = [(7 * i - 100, t) for i, t in enumerate(texts)] + [(5000 + i, texts[10]) for i in range(60)]
    rng.shuffle(docs)
    df = spark.createDataFrame([(i, t, "own", 1) for i, t in docs], "doc_id long, text string, key string, at int").repartition(6)
    folder = write(spark, tmp_path, documents=df)
    got = {r.doc_id: r for r in registry.QUERIES["op13_imatch"](spark, folder).collect()}
    ring = brute_ring(docs)
    assert len(got) == len(docs)
    by_text = {}
    for i, (t, edited, nxt) in ring.items():
        r = got[i]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        by_text.setdefault(t, set()).add(r.fingerprint)
        by_text.setdefault(edited, set()).add(r.edited_fingerprint)
        assert (r.near_next == 1 or t != nxt) and (r.fingerprint == r.edited_fingerprint or t != edited)
    assert all(len(v) == 1 for v in by_text.values())
    long = [got[i] for i, (t, _, nxt) in ring.items() if len(t) > 300 and t != nxt]
    assert np.mean([r.near_edited > r.near_next for r in long]) > 0.9


def test_lexicon_is_the_band_and_is_looked_up_exactly(spark):
    docs = spark.createDataFrame([(i, " ".join(["all"] + [f"half{i % 2}"] + [f"tenth{i % 10}", f"own{i}"])) for i in range(100)] + [(100, None), (101, " ,. ")], "doc_id long, text string")
    terms = {r.term: r.n for r in imatch.lexicon(docs, low=0.05, high=0.3).collect()}
    hashes = {w: spark.range(1).select(F.xxhash64(F.lit(w))).first()[0] for w in [f"tenth{i}" for i in range(10)] + ["all", "half0", "own3"]}
    assert terms == {hashes[f"tenth{i}"]: 10 for i in range(10)}
    cells = imatch.cells(imatch.lexicon(docs, low=0.05, high=0.3)).first().cells
    assert len(cells) == 20 and sorted(t for c in cells for t in c) == sorted(terms) and all(t % 20 == i for i, c in enumerate(cells) for t in c)
    # without a term of the lexicon all terms count
    prints = {r.doc_id: r.fingerprint for r in imatch.fingerprints(docs, low=0.05, high=0.3).collect()}
    assert prints[0] == prints[10] and prints[0] != prints[1] and set(prints[100]) == {None} == set(prints[101])


def test_likeness_by_hand(spark):
    both = lambda a, b: spark.createDataFrame([(a, b)], "a array<long>, b array<long>").select(imatch.likeness(F.col("a"), F.col("b"), 2, 3)).first()[0]
    n = None
    assert both([1, 1, 2, 3, 4, n], [1, 1, 2, 3, 4, n]) == 1
    assert both([n] * 6, [n] * 6) == 1 and both([n] * 6, [5, 5, n, n, n, n]) == 0
    # the last level with half of the replicas in use is the third: one of one is equal
    assert both([1, 1, 2, 3, 4, n], [9, 9, 2, 8, 4, n]) == 1
    assert both([1, 1, 2, 3, n, n], [9, 9, 2, 8, n, n]) == 0.5


def test_rows_without_id_repeated_rows_and_empty_tables(spark, tmp_path):
    rng = random.Random(4)
    t = prose(rng, 50)
    rows = [(None, t), (None, None), (3, t), (3, t), (3, "else and more"), (4, "first of all")]
    out = registry.QUERIES["op13_imatch"](spark, write(spark, tmp_path / "a", documents=spark.createDataFrame(rows, "doc_id long, text string"))).collect()
    assert len(out) == 6 and len({r.fingerprint for r in out if r.n_chars == len(t)}) == 1
    lost = [r for r in out if r.doc_id is None]
    assert all(r.near_next == 0 for r in lost) and hashlib.sha256(t[: len(t) - len(t) // 3].encode()).hexdigest() in {r.edited_sha256 for r in lost}
    assert registry.QUERIES["op13_imatch"](spark, write(spark, tmp_path / "b", documents=spark.createDataFrame([], "doc_id long, text string"))).count() == 0
    one = registry.QUERIES["op13_imatch"](spark, write(spark, tmp_path / "c", documents=spark.createDataFrame([(1, "alone here now")], "doc_id long, text string"))).first()
    assert one.near_next == 1 and one.n_chars == 14 and one.edited_sha256 == hashlib.sha256(b"alone herealon").hexdigest()
    text = imatch.chained(spark.createDataFrame([("b", "two", 1), ("a", "one", 2), (None, "no", 3)], "doc_id string, text string, bucket int"), "doc_id", "text", ["bucket"]).collect()
    assert {(r.doc_id, r.bucket, r.next and (r.next.bucket, r.next.text)) for r in text} == {("b", 1, (2, "one")), ("a", 2, (1, "two")), (None, 3, None)}


@pytest.mark.parametrize("name", ["op13_imatch", "op12_filter_audit"])
def test_native_plans_hold_no_python(spark, tmp_path, name):
    folder = write(spark, tmp_path, documents=spark.createDataFrame([(1, "a b", "en")], "doc_id long, text string, lang string"), labels=spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int"))
    plan = registry.QUERIES[name](spark, folder)._jdf.queryExecution().executedPlan().toString()
    assert ("Python" in plan or "Pandas" in plan) == (name == "op12_filter_audit")


def test_components_by_rounds_and_by_the_last_task_agree(spark):
    from auditframe.llm.graph import components
    rng = random.Random(8)
    edges = [(i, i + 1) for i in range(0, 300)] + [(1000, 1001 + i) for i in range(200)] + [(rng.randrange(2000, 2400), rng.randrange(2000, 2400)) for _ in range(150)] + [(5000, 5000), (5001, None)]
    df = spark.createDataFrame(edges, "a long, b long")
    up = {}
    def top(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x
    for a, b in edges:
        if a is not None and b is not None and a != b:
            a, b = sorted((top(a), top(b)))
            up[b] = a
    want = {x: top(x) for x in list(up)}
    for last in (0, 40, 4096):
        got = components(df, last=last).collect()
        assert len(got) == len(want) and {r.id: r.component for r in got} == want
    assert components(df.where("a = b"), last=10).count() == 0
