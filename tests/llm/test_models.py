"""Learnt operators held against plain Python: neighbour votes by exact cosines, decision lists by counting every candidate."""
import math
import random
from collections import Counter

import numpy as np
import pytest

from auditframe.llm import quality_knn as Q
from auditframe.llm import quality_rules as R

TEXTS = ["", "a", "ab", "One two, two three! Three THREE", "x\ty\x0bx y\ny", "été naïve ## || <b>", "same same same same " * 40, "1 2 3 4 5 1 2 3 4 5 " * 9, "no\n\nend.\r\n"]


def some_texts(n, seed):
    rng = random.Random(seed)
    words = ["alpha", "Beta", "gamma,", "DELTA", "12", "e.g.", "##", "| x", "zeta!", "été", "the"]
    return TEXTS + [" ".join(rng.choice(words[: rng.randint(2, 11)]) for _ in range(rng.randint(1, 120))) for _ in range(n)]


def packed(texts):
    parts = [t.encode() for t in texts]
    return np.frombuffer(b"".join(parts), np.uint8), np.cumsum([0, *map(len, parts)])


def plain_terms(text):
    kinds = [next((i for i, s in enumerate(Q.KINDS) if chr(b) in s), len(Q.KINDS)) if b < 128 else len(Q.KINDS) + 1 for b in text.encode()]
    out = Counter((a * Q.BASE + b) * Q.BASE + c for a, b, c in zip(kinds, kinds[1:], kinds[2:]))
    w = [x.lower() for x in text.translate({c: " " for c in range(9, 14)}).split(" ") if x]
    out[Q.BASE**3] = sum(a == b for a, b in zip(w, w[1:]))
    out[Q.BASE**3 + 1] = sum(a == b for a, b in zip(w, w[2:]))
    out[Q.BASE**3 + 2] = len(w) - len(set(w))
    out[Q.BASE**3 + 3] = len(w)
    return {k: math.sqrt(n) for k, n in out.items() if n}


def unit(v):
    n = math.sqrt(sum(x * x for x in v.values()))
    return {k: x / n for k, x in v.items()} if n else {}


def test_terms_match_plain_python():
    texts = some_texts(60, 1)
    for t, row in zip(texts, Q.terms(*packed(texts))):
        assert {int(i): pytest.approx(float(row[i]), rel=1e-6) for i in np.flatnonzero(row)} == plain_terms(t), t


def test_votes_match_exact_cosines():
    train, asked = some_texts(150, 2), some_texts(50, 3)
    y = np.array([i % 3 > 0 for i in range(len(train))], np.int64)
    model = Q.Model(Q.terms(*packed(train)), y, rank=12)
    # weights, and directions as eigenvectors of the plain Gram matrix
    rows = [plain_terms(t) for t in train]
    seen = Counter(k for r in rows for k in r)
    idf = {k: math.log((1 + len(train)) / (1 + seen[k])) + 1 for k in range(Q.TERMS)}
    weighted = lambda r: unit({k: x * idf[k] for k, x in r.items()})
    dense = np.zeros((len(train), Q.TERMS))
    for i, r in enumerate(map(weighted, rows)):
        dense[i, list(r)] = list(r.values())
    d = model.directions.astype(float)
    values = np.linalg.svd(dense, compute_uv=False)[:12] ** 2
    assert np.abs(dense.T @ (dense @ d) - d * values).max() < 1e-3 and np.abs(d.T @ d - np.eye(12)).max() < 1e-4

    def latent(r):
        w = weighted(r)
        return unit({c: sum(x * d[k, c] for k, x in w.items()) for c in range(12)})

    known = [latent(r) for r in rows]
    share = y.mean()
    for t, got in zip(asked, model.score(Q.terms(*packed(asked)), k=7, power=8.0, prior=0.5)):
        v = latent(plain_terms(t))
        cos = sorted(((sum(x * u.get(c, 0.0) for c, x in v.items()), i) for i, u in enumerate(known)), key=lambda p: -p[0])
        votes = [(max(c, 0.0) ** 8, y[i]) for c, i in cos[:7]]
        want = (sum(w * b for w, b in votes) + 0.5 * share) / (sum(w for w, _ in votes) + 0.5)
        # where the seventh and the eighth are equally near, either may vote
        if cos[6][0] - cos[7][0] > 1e-5:
            assert got == pytest.approx(want, abs=1e-3), t
        assert 0 <= got <= 1
    assert model.score(Q.terms(*packed([""])))[0] == pytest.approx(share)


def plain_rules(rows):
    """Sequential covering by counting every candidate condition on the rows themselves."""
    at = [i / R.QUANTILES for i in range(R.QUANTILES)] + [0.99, 0.995]
    cuts = {}
    for f in R.FEATURES:
        both = [np.percentile([r[f] for r in part], [100 * a for a in at]) for part in (rows, [r for r in rows if r["bad"]]) if part]
        v = sorted({round(float(x), 12) for part in both for x in part})
        cuts[f] = [(a + b) / 2 for a, b in zip(v, v[1:])]
    holds = lambda r, c: r[c[0]] > c[2] if c[1] == ">" else r[c[0]] <= c[2]
    fits = lambda r, rule: all(holds(r, c) for c in rule)
    count = lambda part: (sum(r["bad"] for r in part), sum(not r["bad"] for r in part))
    rules, left = [], rows
    while len(rules) < R.MAX_RULES:
        rule, grow = [], [r for r in left if not r["prune"]]
        while len(rule) < R.MAX_CONDITIONS and all(count(grow)):
            p0, n0 = count(grow)
            best, found = 1e-12, None
            for f in R.FEATURES:
                for x in cuts[f]:
                    for way in ("<=", ">"):
                        p, n = count([r for r in grow if holds(r, (f, way, x))])
                        if p + n >= R.SUPPORT and p and (g := p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0)))) > best:
                            best, found = g, (f, way, x)
            if not found:
                break
            rule.append(found)
            grow = [r for r in grow if holds(r, found)]
        if not rule:
            break
        tests = [count([r for r in left if r["prune"] and fits(r, rule[:k])]) for k in range(1, len(rule) + 1)]
        worth = [(p - n) / max(1, p + n) for p, n in tests]
        keep = max(range(len(rule)), key=lambda k: (worth[k], -k))
        if tests[keep][0] < R.PRECISION * max(1, sum(tests[keep])):
            break
        rules.append(rule[: keep + 1])
        left = [r for r in left if not fits(r, rules[-1])]
    return rules


def test_decision_list_matches_plain_covering(spark):
    rng = random.Random(5)
    texts, quality = [], []
    for i in range(420):
        good = rng.random() < 0.6
        junk = rng.choice(["##", "!!", "", " |", " 77"]) if not good else rng.choice(["", "", "", "."])
        n = rng.randint(12, 80) if good or rng.random() < 0.7 else rng.randint(200, 260)
        texts.append(" ".join((w := f"w{rng.randrange(400)}") + (junk if rng.random() < 0.4 else "") for _ in range(n)))
        quality.append(int(good))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame(list(enumerate(quality)), "doc_id long, quality int")
    rows = R.labelled(docs, labels, "doc_id", "text", "quality", None, R.SAMPLE)
    got, want = R.learn(rows), plain_rules([r.asDict() for r in rows.collect()])
    assert got and [[c[:2] for c in rule] for rule in got] == [[c[:2] for c in rule] for rule in want]
    assert [c[2] for rule in got for c in rule] == pytest.approx([c[2] for rule in want for c in rule])
    for r in R.judged(docs, labels, held=None).collect():
        bad = any(all(r[f] > x if way == ">" else r[f] <= x for f, way, x in rule) for rule in want)
        assert r["kept"] == (not r["base_failed"] and not bad)
