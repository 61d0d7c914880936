"""Every operator on edge rows and against plain Python; the contracts' queries on a small folder of their own."""
import os
import random
import sys

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(__file__))
import brute  # noqa: E402

from auditframe.llm import chat_format, decontaminate, license_scan, lm_score, mixing, near_dedup, pii, quality_knn, quality_rules, registry, url_filter  # noqa: E402

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, texts, schema=DOCS):
    rows = [(i, t, ["en", "de", None][k % 3], ["src0", "src1", "src17", None][k % 4], len(t or "")) for k, (i, t) in enumerate(texts)]
    return spark.createDataFrame(rows, schema)


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def edges(rng):
    """Nulls, empty, blanks, one word, long, repeated rows, ties."""
    base = prose(rng, 300)
    near = base.replace("w7 ", "ww ", 1)
    return [(0, None), (1, ""), (2, " \t\n"), (3, "One"), (4, "one"), (5, base), (6, base), (7, near), (8, base.upper()), (9, prose(rng, 20000)), (10, "é ü ñ " * 40), (11, "a b c d"), (12, "a b c d"), (None, base), (None, None), (5, base)]


def unique(texts):
    return {i: t for i, t in texts if i is not None}


def test_near_duplicates_match_brute_force(spark):
    rng = random.Random(1)
    texts = edges(rng)
    for g in range(6):
        base = prose(rng, 120).split()
        for k in range(12):
            w = list(base)
            for _ in range(k):
                w[rng.randrange(len(w))] = "x" + str(rng.random())
            texts.append((100 + 20 * g + k, " ".join(w)))
    got = near_dedup.near_duplicates(frame(spark, texts)).collect()
    want = brute.near(unique(texts))
    assert len(got) == len(texts)
    for r in got:
        if r.doc_id is None:
            assert r.kept and r.component_id is None
        else:
            assert (r.n_shingles, r.component_id) == want[r.doc_id] and r.kept == (r.doc_id == r.component_id)


def test_near_duplicates_in_a_large_group_of_many_chunks(spark):
    rng = random.Random(2)
    base = prose(rng, 90, 10**6).split()
    texts = {}
    for k in range(160):
        w = list(base)
        for _ in range(rng.randrange(5)):
            w[rng.randrange(len(w))] = f"y{rng.random()}"
        texts[k] = " ".join(w)
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(frame(spark, list(texts.items())), chunk=16).collect()}
    assert got == {i: c for i, (_, c) in brute.near(texts).items()}


def test_near_duplicates_in_chunks_cut_by_shingles(spark):
    rng = random.Random(15)
    texts = {}
    for g in range(3):
        base = prose(rng, 300, 10**6).split()
        for k in range(20):
            w = list(base)
            for _ in range(rng.randrange(6)):
                w[rng.randrange(len(w))] = f"y{rng.random()}"
            texts[100 * g + k] = " ".join(w)
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(frame(spark, list(texts.items())), shingles=1500).collect()}
    assert got == {i: c for i, (_, c) in brute.near(texts).items()}


def test_chunks_meet_only_where_they_share_a_band(spark):
    coarse = spark.createDataFrame([(i, 0) for i in range(40)] + [(100, 100), (101, 100)], "id long, component long")
    sizes = spark.createDataFrame([(i, 1000) for i in range(40)] + [(100, 10), (101, 10)], "doc_id long, n_shingles long")
    pairs = [(i, i + 1) for i in range(39)] + [(100, 101)]
    banded = spark.createDataFrame([(b, i) for b, p in enumerate(pairs) for i in p], "band long, doc_id long")
    got = {r.doc_id: r for r in near_dedup.chunked(coarse, sizes, banded, 256, 2000).collect()}
    assert len(got) == 42 and got[100].others == got[101].others == [0]
    chunk = {i: got[i].mine for i in range(40)}
    want = {(chunk[a], chunk[b]) for a, b in pairs[:-1]}
    want |= {(b, a) for a, b in want} | {(a, a) for a in chunk.values()}
    assert {(got[i].mine, o) for i in range(40) for o in got[i].others} == want and len(want) < len(set(chunk.values())) ** 2 and max(chunk.values()) > 9


def test_forest_counts_the_same_in_ranges(monkeypatch):
    import numpy as np
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**64, 2000, np.uint64)
    packed = [np.sort(np.r_[base[: 2000 - k * 20], rng.integers(0, 2**64, k * 20, np.uint64)]).tobytes() for k in range(12)]
    whole = near_dedup.forest(np.arange(12), np.zeros(12, int), packed, 85)
    monkeypatch.setattr(near_dedup, "RANGE", 900)
    assert near_dedup.forest(np.arange(12), np.zeros(12, int), packed, 85) == whole and len(whole[0])


def test_rows_that_repeat_an_id_tie_their_texts(spark):
    rng = random.Random(3)
    a, b = prose(rng, 60), prose(rng, 60)
    got = near_dedup.near_duplicates(frame(spark, [(3, a), (4, a), (4, b), (5, b), (6, "else")])).select("doc_id", "component_id").distinct().collect()
    assert {r.doc_id: r.component_id for r in got} == {3: 3, 4: 3, 5: 3, 6: 6}


def test_sketches_fill_every_coordinate_and_estimate_similarity():
    import numpy as np
    rng = np.random.default_rng(0)
    pool = rng.integers(0, 2**63, 3000).astype(np.uint64)
    sets = [np.sort(pool[:1000]), np.sort(pool[200:1200]), pool[:1], np.zeros(0, np.uint64), np.sort(pool)]
    sk = near_dedup.sketches(np.concatenate(sets), np.cumsum([0, *map(len, sets)]), 252)
    assert (sk[[0, 1, 2, 4]] != np.iinfo(np.uint64).max).all() and (sk[3] == 0).all()
    assert abs((sk[0] == sk[1]).mean() - 800 / 1200) < 0.12


def test_decontamination_matches_brute_force(spark):
    rng = random.Random(4)
    item = prose(rng, 40, 10**6)
    items = [(1, item), (2, prose(rng, 14, 10**6)), (3, "only four Words here"), (3, "only four Words here"), (10, ""), (11, None), (12, item + " more")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    w = item.split()
    texts = edges(rng) + [(50, prose(rng, 30) + " " + " ".join(w[5:18]) + " " + prose(rng, 30)), (51, " ".join(w[5:17])), (52, "x " + item.upper() + "! y"), (53, "say: only, FOUR words-here"), (54, prose(rng, 4000) + " " + item),
                          (55, items[1][1]), (56, " ".join(w[:13] + w[12:25]))]
    for block in (10**6, 30):
        got = decontaminate.verdicts(decontaminate.contamination(frame(spark, texts), bench, block_words=block)).withColumn("names", F.sha2(F.concat_ws(",", "hit_items"), 256)).collect()
        want = brute.contaminated(unique(texts), [i for i in items if i[1]])
        assert len(got) == len(texts)
        for r in got:
            if r.doc_id is not None:
                assert (r.n_words, r.n_hit, r.n_items, r.names, r.contaminated) == want[r.doc_id]
    assert decontaminate.contamination(frame(spark, texts), bench.limit(0)).where("size(hit_spans) > 0").count() == 0


def test_decontamination_by_items_without_id(spark):
    rng = random.Random(14)
    a, b, c = prose(rng, 20, 10**6), prose(rng, 20, 10**6), prose(rng, 20, 10**6)
    bench = spark.createDataFrame([(None, a), (None, b), (7, c), (8, c)], "item_id long, text string")
    docs = frame(spark, [(1, f"x {a} y"), (2, f"{a} {b} {c}"), (3, c), (4, "clean words"), (None, a)])
    for block in (10**6, 30):
        got = {r.doc_id: (r.n_hit, r.n_items, r.hit_items, r.contaminated) for r in decontaminate.verdicts(decontaminate.contamination(docs, bench, block_words=block)).collect()}
        assert got == {1: (20, 1, [None], True), 2: (60, 3, ["7", "8", None], True), 3: (20, 2, ["7", "8"], True), 4: (0, 0, [], False), None: (20, 1, [None], True)}
    assert [r.doc_id for r in decontaminate.drop_contaminated(docs, bench).collect()] == [4]


def test_winnowing_keeps_a_fingerprint_of_every_span():
    import numpy as np
    rng = np.random.default_rng(1)
    h = rng.integers(0, 2**62, 500).astype(np.uint64)
    kept = decontaminate.winnow(h, np.arange(500), np.repeat([0, 1], 250), 9)
    for a in [*range(242), *range(250, 492)]:
        assert ((kept >= a) & (kept < a + 9)).any()


def test_pii_base_spans_match_brute_force(spark):
    odd = ["", None, "a@b.c%x@d.e f@g.h.i@j.k", "1.2.3.4.5.6.7.8 1.2.3.400 001.02.3.0000255", "4111 1111 1111 1111 4111-1111-1111-1111 4111111111111112 é4111111111111111", "+1 (234) 555-6789 ++12345678901 +1 2",
           "a" * 50000 + "@", "a@" * 2000, "1." * 20000, "+1((((" * 800, "1-" * 30000, "é x@y" + ".a" * 9000, "ü a@b.co " * 3000, "tel +12 345 678 901."]
    docs = frame(spark, list(enumerate(odd)) + [(3, odd[3])])
    got = pii.with_spans(docs).collect()
    assert len(got) == len(odd) + 1
    for r in got:
        n, spans = brute.pii(odd[r.doc_id])
        mine = ",".join(f"{k}:{s.start}:{s.end}" for k in brute.PII for s in r.pii[k])
        assert mine == spans and {k: len(r.pii[k]) for k in brute.PII} == n
    clean = {r.doc_id: r.text for r in pii.masked(docs).collect()}
    assert clean[1] is None and all(not brute.pii(t)[1] for t in clean.values())


def test_pii_masks_overlapping_spans_as_one(spark):
    rng = random.Random(13)
    filler = [(i, f"{prose(rng, 20)} password={rng.randrange(16**18):018x} {prose(rng, 5)}") for i in range(40)]
    long = "é \U0001F600 " * 3000
    cases = {"call +33.1.42.68.53.00 now": "call [PHONE] now", "é +33.1.42.68.53.00": "é [PHONE]", "a@b.co 1.2.3.4\nx": "[EMAIL] [IP]\nx", f"{long}+33.1.42.68.53.00 a@b.co{long}": f"{long}[PHONE] [EMAIL]{long}",
             "1.2.3.4@b.co": "[EMAIL]", "4111 1111 1111 1111 99999999@a.b": "[CARD] [EMAIL]", "none": "none", "": "", None: None}
    docs = frame(spark, filler + [(100 + i, t) for i, t in enumerate(cases)] + [(300, f"password=4111111111111111aabbcc99 {prose(rng, 5)}")])
    spans = {r.doc_id: r for r in pii.with_spans(docs).collect()}
    got = {r.doc_id: r for r in pii.masked(docs).collect()}
    for i, (t, want) in enumerate(cases.items()):
        assert got[100 + i].text == want and got[100 + i].n_chars == len(want or "")
    for i, r in spans.items():
        places = set()
        for s in [s for k in pii.PATTERNS for s in r.pii[k]] + list(r.pii.added):
            places |= set(range(s.start, s.end))
            assert r.text[s.start : s.end] not in got[i].text
        left = "".join(c for p, c in enumerate(r.text or "") if p not in places)
        if not i == 105:
            kept = got[i].text or ""
            for k in pii.KINDS:
                kept = kept.replace(f"[{k.upper()}]", "")
            assert kept == left
    assert spans[300].pii.added and got[300].text.startswith("[SECRET] ")


def test_pii_learns_credentials_and_leaves_prose(spark):
    rng = random.Random(5)
    texts = [(i, f"{prose(rng, 20)} password={rng.randrange(16**18):018x} {prose(rng, 5)}") for i in range(40)] + [(100 + i, f"{prose(rng, 9)} chapter = introduction {prose(rng, 9)} url: https//w{i}.html") for i in range(40)]
    got = pii.with_spans(frame(spark, texts)).select("doc_id", "text", "pii.added").collect()
    for r in got:
        found = [r.text[s.start : s.end] for s in r.added]
        assert len(found) == 1 and found[0].startswith("password=") if r.doc_id < 100 else not found


def test_expectation_maximisation_tells_reliable_labelers():
    rng = random.Random(6)
    patterns = {}
    for _ in range(4000):
        y = rng.random() < 0.3
        v = tuple((int(y) if rng.random() < a else int(not y)) if rng.random() < 0.9 else -1 for a in (0.95, 0.9, 0.85, 0.8, 0.55))
        patterns[v] = patterns.get(v, 0) + 1
    post, rates = pii.expect(patterns)
    right = [r[1][1] / (r[1][1] + r[1][0]) for r in rates]
    assert abs(right[0] - 0.95) < 0.05 and abs(right[4] - 0.55) < 0.08
    assert post[(1, 1, 1, 1, 1)] > 0.9 > 0.1 > post[(0, 0, 0, 0, 0)]


def test_statistics_match_brute_force(spark):
    rng = random.Random(7)
    texts = edges(rng) + [(60, "x y z a b\nx y z a b\n\nx y z a b"), (61, "a a a a a a a a a a a a"), (62, "p|q <b> #1\n \n \n p|q <b> #1"), (63, "u\x0bv\x0cw\rx\ty " * 30), (64, "1 2 3 4 5 6 1 2 3 4 5 1 2 3 4 5 6 7")]
    for r in quality_rules.statistics(frame(spark, texts)).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute.stats(r.text)


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(8)
    good = [(i, prose(rng, rng.randrange(30, 300)).capitalize() + ".") for i in range(600)]
    bad = [(1000 + i, " ".join(x.upper() + rng.choice(["!!", "###", "$$$", " |"]) for x in prose(rng, rng.randrange(30, 200)).split())) for i in range(200)]
    docs = frame(spark, good + bad)
    labels = spark.createDataFrame([(i, int(i < 1000), 0) for i, _ in good + bad] + [(None, 1, 0), (7, None, 0)], "doc_id long, quality int, toxic int")
    return docs, labels


def test_votes_tell_held_out_quality(spark, labelled):
    docs, labels = labelled
    got = [r for r in quality_knn.with_scores(docs, labels).collect() if brute.fold(r.doc_id, 3) == 1]
    assert sum((r.score >= 0.5) == (r.doc_id < 1000) for r in got) >= 0.98 * len(got)
    assert all(0 <= r.score <= 1 for r in got)


def test_votes_do_not_see_ids_or_labels(spark, labelled):
    docs, labels = labelled
    sample = docs.limit(40)
    a = [r.score for r in quality_knn.with_scores(docs, labels).where("doc_id between 1000 and 1010").orderBy("doc_id").collect()]
    other = docs.where("doc_id between 1000 and 1010").select((F.col("doc_id") + 900000).alias("doc_id"), "text", F.lit("zz").alias("lang"), F.lit("q").alias("source"), "n_chars")
    b = [r.score for r in quality_knn.with_scores(docs.union(other), labels).where("doc_id > 900000").orderBy("doc_id").collect()]
    assert a == pytest.approx(b) and sample.count() == 40


def test_decision_list_rejects_held_out_junk(spark, labelled):
    docs, labels = labelled
    got = [r for r in quality_rules.judged(docs, labels).collect() if brute.fold(r.doc_id, 3) == 1]
    assert sum(r.kept == (r.doc_id < 1000) for r in got) >= 0.97 * len(got)


def test_classifiers_without_rows_or_labels(spark, labelled):
    docs, labels = labelled
    assert quality_knn.with_scores(docs.limit(0), labels).count() == 0 and quality_rules.judged(docs.limit(0), labels).count() == 0
    rows = frame(spark, edges(random.Random(9)))
    assert {r.score for r in quality_knn.with_scores(rows, labels.limit(0)).collect()} == {0.5}
    assert all(r.kept == (not brute.stats(r.text)[5]) for r in quality_rules.judged(rows, labels.limit(0)).collect())


def test_lm_scores_match_brute_force(spark):
    rng = random.Random(10)
    texts = {i: t for i, t in edges(rng) if i not in (None, 9)} | {100 + i: prose(rng, rng.randrange(1, 60), 90) for i in range(40)}
    model = brute.Ppm([t for i, t in texts.items() if brute.fold(i, 7) != 2])
    base = brute.unigram(texts)
    for size in (1 << 20, 2000):
        got = lm_score.scored(frame(spark, list(texts.items())), chunk_bytes=size).collect()
        assert len(got) == len(texts)
        for r in got:
            n, k, total, b = base[r.doc_id]
            assert (r.n_tokens, r.n_known, r.train_tokens) == (n, k, total) and r.held_out == (brute.fold(r.doc_id, 7) == 2)
            assert r.base_score == pytest.approx(b, rel=1e-9, abs=1e-9) and r.score == pytest.approx(model.score(texts[r.doc_id]), rel=1e-9, abs=1e-9)


def test_lm_chances_sum_up_to_one():
    import numpy as np
    rng = np.random.default_rng(2)
    levels = [rng.integers(0, 3, (5, 256)) * (rng.random((5, 256)) < d) for d in (0.01, 0.05, 0.2, 0.3, 0.6)]
    assert np.allclose((10 ** lm_score.price([x.astype(float) for x in levels])).sum(1), 1)


def test_mixture_matches_brute_force(spark):
    rng = random.Random(11)
    rows = [(i, prose(rng, rng.randrange(1, 40)), rng.choice(["en", "en", "de", "fr", None]), rng.choice(["src0"] * 9 + ["src1", "src16", "src17", None])) for i in range(900)] + [(2000, None, "en", "src0"), (2001, "", "it", "src5"), (2002, prose(rng, 9000), "de", "src0")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    domain = lambda s: "reference" if s and int(s[3:]) >= 15 else "web"
    for per_mille, epochs, size in ((400, 2, 64), (1500, 2, 2048), (5000, 2, 64), (0, 1, 64)):
        got = {r.doc_id: r.mix_copies for r in mixing.mixture(docs, budget_per_mille=per_mille, epochs=epochs, size=size).collect()}
        assert got == brute.mix(rows, [mixing.WEIGHTS[x] for x in mixing.LEVELS], epochs, per_mille, mixing.SEED, domain)
    assert mixing.mixture(docs.limit(0)).count() == 0


def test_url_rules_and_terms(spark):
    cases = {"http://A.Example.NET/en/x": ("a.example.net", "/en/x", "example.net/en/", "allow"), "http://x.net": ("x.net", "", None, "allow"), "http://x.net/": ("x.net", "/", "net/", "block"), "http://net/?q": ("net", "/", "net/", "block"),
             "http://badexample.com/de/1": ("badexample.com", "/de/1", None, "allow"), "https://a.org/fr/xxx": ("a.org", "/fr/xxx", "org/fr/", "allow"), "https://a.com/xxx": ("a.com", "/xxx", None, "block"), "https://a.com/xxxl": ("a.com", "/xxxl", None, "allow"),
             "https://a.com/free-loan": ("a.com", "/free-loan", None, "block"), "https://a.com/free?free": ("a.com", "/free", None, "allow"), "nothing": ("", "", None, "allow"), "": ("", "", None, "allow"), None: ("", "", None, "allow"),
             "http://e.com?x=/a#b": ("e.com", "", None, "allow"), "http://e.com#a/b": ("e.com", "", None, "allow")}
    pages = spark.createDataFrame([(i, u, "h", "clash") for i, u in enumerate(cases)] * 2, "page_id long, url string, host string, rule string")
    got = url_filter.judged(pages).collect()
    assert len(got) == 2 * len(cases)
    for r in got:
        assert (r.host, r.path, r.rule, r.verdict) == cases[r.url]
    assert url_filter.judged(pages.limit(0)).count() == 0


def test_url_terms_are_distinct_and_weighted(spark):
    paths = {"free/deals": ("allow", 0, 2, 2), "free/bets": ("block", 0, 2, 3), "bets/bets/Bets": ("allow", 0, 1, 2), "poker-pills": ("block", 0, 2, 4), "free/track/farm": ("allow", 0, 1, 1), "Casino": ("block", 1, 0, 0),
             "casinos.xxx": ("block", 2, 0, 0), "better/sexton": ("allow", 0, 0, 0), "loans_now": ("block", 0, 2, 3), "adult-education": ("allow", 0, 1, 2)}
    got = url_filter.judged(spark.createDataFrame([(f"https://a.com/{p}",) for p in paths], "url string")).collect()
    assert {r.url[14:]: (r.verdict, r.n_strict, r.n_soft, r.soft_weight) for r in got} == paths
    assert not {t for t in url_filter.SOFT if t in url_filter.STRICT} and set(url_filter.SOFT.values()) == {1, 2}
    one = url_filter.judged(spark.createDataFrame([("https://a.com/a-b/a",)], "url string"), strict=[], soft={"a-b": 1, "a": 1}, limit=2, min_soft=2).first()
    assert (one.verdict, one.n_soft) == ("block", 2)


def test_license_rules(spark):
    mit = "Copyright (c) 2020 X. All rights reserved.\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software and so on.\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\nThe software is provided \"as is\", without warranty of any kind."
    cases = {"Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0", "text before.\nThis work is licensed under the GNU General Public License, version 3.\nmore": "GPL-3", "Licensed under the Apache License, Version 2.0.": "Apache-2.0", "Released under the MIT License.": "MIT", mit: "MIT",
             "a license is not here": "", "Licensed under secret terms.": "UNKNOWN", "Released under the MIT License. Licensed under CC BY 4.0.": "MIT,CC-BY-4.0", "": "", None: "", "word " * 30000: ""}
    docs = spark.createDataFrame([(t, "clash") for t in cases], "text string, licenses string")
    got = {r.text: ",".join(r.licenses) for r in license_scan.scanned(docs).collect()}
    assert got == cases and license_scan.scanned(docs.limit(0)).count() == 0


def test_license_texts_of_wrapped_lines():
    mit = """Copyright (c) 2020 X Corp

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED. IN NO EVENT SHALL THE AUTHORS OR
COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM."""
    bsd = """Copyright 2020 X
All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above
   copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions in the documentation.
"""
    three = bsd + """3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""
    apache = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
"""
    gpl3 = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.
"""
    gpl2 = gpl3.replace("software:", "software;").replace("Foundation, either version 3", "Foundation; either version 2")
    comment = lambda t, mark: "".join(f"{mark} {x}\n" for x in t.split("\n"))
    names = lambda t: license_scan.licences(license_scan.identifiers(t))
    for text, name in ((mit, "MIT"), (bsd, "BSD-2-Clause"), (three, "BSD-3-Clause"), (apache, "Apache-2.0"), (gpl3, "GPL-3"), (gpl2, "GPL-2")):
        for t in (text, text.replace("\n", "\r\n"), comment(text, " *"), comment(text, "#"), text.replace("\n", " ") if text in (gpl2, gpl3) else text):
            assert names(t) == [name], (name, t)
        assert names("prose without a stop\n" + text + "\n" + text) == [name, name]
    assert [x[0] for x in license_scan.identifiers(apache)] == ["apache_short", "apache_comply", "apache_obtain", "apache_asis"]
    assert names("some words\nLicensed under the MIT License\nmore words\nCopyright 2020 X\nLicensed under CC BY 4.0\nand so on") == ["MIT", "CC-BY-4.0"]


def test_chat_round_trip(spark):
    rows = [(1, 0, "user", "</s>[INST] ok [/INST] \\ <|turn|> é\n"), (1, 1, "assistant", "<\\s> \\\\ <|end|>"), (1, 2, "assistant", None), (2, 0, None, "x" * 50000), (2, 0, None, "x" * 50000), (3, None, "tool<|says|>", ""), (None, 0, "user", "a"), (None, 0, "user", "b"), (4, 0, "assistant", " lead"), (4, 1, "assistant", "trail ")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = chat_format.formatted(df)
    got = sorted((tuple(zip(r.roles, r.texts)), tuple(r.learnt)) for r in chat_format.read_back(out).collect())
    want = {}
    for i, r in enumerate(rows):
        want.setdefault(r[0] if r[0] is not None else f"alone{i}", []).append((r[1] if r[1] is not None else -1, r[2] or "", r[3] or ""))
    assert got == sorted((tuple((x[1], x[2]) for x in sorted(v)), tuple(x[2] for x in sorted(v) if x[1] == "assistant")) for v in want.values())
    for r in out.collect():
        assert len(r.input_ids) == len(r.loss_mask) and r.formatted.count("<|turn|>") == r.formatted.count("<|end|>")
    assert chat_format.formatted(df.limit(0)).count() == 0


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory, labelled):
    rng = random.Random(12)
    docs, labels = labelled
    top = tmp_path_factory.mktemp("sf")
    item = prose(rng, 40, 10**6)
    base = prose(rng, 150, 10**6)
    more = frame(spark, [(5000, base), (5001, base), (5002, base.replace(" ", "  ")), (5003, prose(rng, 20) + " " + item + " " + prose(rng, 20)), (5004, prose(rng, 60) + " mail a@b.example.com now"), (5005, None), (None, prose(rng, 50))])
    docs.union(more).coalesce(2).write.parquet(f"{top}/documents.parquet")
    labels.write.parquet(f"{top}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{top}/benchmark.parquet")
    return str(top)


def test_pipeline_matches_its_parts_done_by_hand(spark, folder):
    import corpus_pipeline as P
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = {(r.doc_id, r.text): r for r in docs.collect()}
    score = {(r.doc_id, r.text): r.score for r in quality_knn.with_scores(docs, spark.read.parquet(f"{folder}/labels.parquet")).collect()}
    left = [r for k, r in rows.items() if score[k] >= 0.5]
    near = brute.near({r.doc_id: r.text for r in left if r.doc_id is not None})
    left = [r for r in left if r.doc_id is None or near[r.doc_id][1] == r.doc_id]
    item = spark.read.parquet(f"{folder}/benchmark.parquet").first().text
    dirty = brute.contaminated({i: r.text for i, r in enumerate(left)}, [(1, item)])
    left = [r for i, r in enumerate(left) if not dirty[i][4]]
    assert 5003 not in {r.doc_id for r in left} and {5000, 5004} <= {r.doc_id for r in left} and not {5001, 5002} & {r.doc_id for r in left}
    last = P.STAGES[-1][1]
    P.STAGES[-1] = ("mixture", lambda s, d, f: d)
    try:
        got = P.run(spark, folder).collect()
    finally:
        P.STAGES[-1] = ("mixture", last)
    text = {r.doc_id: r.text for r in got}
    assert sorted(str(r.doc_id) for r in got) == sorted(str(r.doc_id) for r in left)
    assert "[EMAIL]" in text[5004] and all(text[r.doc_id] == r.text for r in left if r.doc_id != 5004)
    out = P.run(spark, folder)
    assert out.columns == [*docs.columns, "mix_copies"] and 0 < out.count() <= len(left)
    assert out.select("doc_id").distinct().count() == out.count()


def test_queries_return_the_columns_of_their_contracts(spark, folder):
    want = {"op3_quality_classifier": ["doc_id", "held_out", "score", "predicted"], "op4_near_duplicates": ["doc_id", "n_shingles", "component_id", "kept"], "op5_pii": ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"],
            "op7_lm_score": ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"], "op8_quality_rules": ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"],
            "op9_decontamination": ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]}
    n = spark.read.parquet(f"{folder}/documents.parquet").count()
    for name, cols in want.items():
        out = registry.QUERIES[name](spark, folder)
        assert out.columns == cols and out.count() == n


def test_columns_of_clashing_names_are_kept(spark, labelled):
    docs, labels = labelled
    names = ["rest", "full", "ranges", "leaf", "order", "share", "tokens", "capacity", "domain", "score", "kept", "pii", "hit_words", "component_id", "chunk", "held_out", "k_id", "y", "x", "n", "grp", "parts", "lo", "hi", "bands", "rep", "a", "b", "id", "mix_tokens"]
    small = docs.where("doc_id < 30 or doc_id between 1000 and 1010")
    clash = small.select("*", *[F.lit(f"own {n}").alias(n) for n in names])
    bench = spark.createDataFrame([(1, "nothing of this is in any document at all, not one single word")], "item_id long, text string")
    for out in (quality_knn.drop_low_quality(clash, labels), near_dedup.drop_near_duplicates(clash), decontaminate.drop_contaminated(clash, bench), pii.masked(clash)):
        assert out.columns == clash.columns and {r.rest for r in out.select("rest").collect()} == {"own rest"} and out.where("score <> 'own score'").count() == 0
    used = mixing.mixed(clash)
    assert {r.full for r in used.select("full").collect()} == {"own full"}
    plain = {(r.doc_id, r.mix_copies) for r in mixing.mixed(small).collect()}
    assert {(r.doc_id, r.mix_copies) for r in used.collect()} == plain
    assert near_dedup.near_duplicates(clash).count() == lm_score.scored(clash).count() == quality_rules.judged(clash, labels).count() == small.count()
