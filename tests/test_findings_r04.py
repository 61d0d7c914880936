import hashlib
import json
import random

import numpy as np
import pytest

from auditframe.functions import similarity as M
from auditframe.functions import text as X
from auditframe.operators import clauses as C
from auditframe.operators import compare as K
from auditframe.operators import registry as G
from auditframe.operators import retrieval as V
from auditframe.operators import structure as D
from auditframe.plans import bridge as B


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def embedded(text: str, dim: int = 1536):
    digests = [hashlib.sha256(text.encode()).digest()]
    while len(digests) * 32 < dim:
        digests.append(hashlib.sha256(digests[-1]).digest())
    return np.frombuffer(b"".join(digests), dtype=np.uint8)[:dim] / 255.0 * 2 - 1


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("docs"))
    lines = ["General terms of the service", "The supplier delivers within thirty days", "Payment follows acceptance", "Disputes go to court", "Account details", "Amount due", "Final notes", "Second round of terms"]
    rows = [(i, "\n".join(f"{x} {i}" for x in lines[: 3 + i]), "en" if i % 2 else "de", f"s{i % 2}", 100) for i in range(1, 6)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    return path


def test_analyze_corpus_returns_confidence_and_links(spark, folder):
    """the confidence of a contract, and the focuses of its clauses, were computed and left out of the result."""
    import __spark_entry__ as entry
    rows = entry.queries()["analyze_corpus"](spark, folder).collect()
    of = lambda n: [(r["task_id"], r["item_id"], json.loads(r["value"])) for r in rows if r["result"] == n]
    got = {t: v for t, _, v in of("confidence")}
    assert len(of("confidence")) == len(got) == 5
    mean = lambda n, t: (lambda x: round(sum(x) / len(x), 6) if x else 0.0)([v["confidence"] for u, _, v in of(n) if u == t])
    for t, v in got.items():
        s, c, f = mean("sections", t), mean("clauses", t), mean("focuses", t)
        assert (v["sections"], v["clauses"], v["audit"]) == pytest.approx((s, c, f), abs=0.0051) and v["overall"] == pytest.approx(s * 0.32 + c * 0.38 + f * 0.3, abs=0.0051)
        assert v["warnings"] == sum(w["need_review"] for u, _, w in of("clauses") if u == t) + sum(w["risk_level"] == "pending_verification" for u, _, w in of("focuses") if u == t)
    assert sorted((t, i) for t, i, _ in of("clause_links")) == sorted((t, i) for t, i, _ in of("clauses"))
    wanted = {(t, c, i) for t, i, v in of("focuses") for c in v["clause_ids"]}
    assert wanted and {(t, i, f) for t, i, v in of("clause_links") for f in v["focus_ids"]} == wanted


def test_review_corpus_returns_suggestions(spark, folder):
    """the clauses suggested for a contract were looked up and left out of the result."""
    import __spark_entry__ as entry
    from suite.sqlkit import DAY
    rows = entry.queries()["review_corpus"](spark, folder).collect()
    category = {r["task_id"]: r["item_id"] for r in rows if r["result"] == "categories"}
    live = [r for r in B.kb_clauses(spark, folder).collect() if r["status"] in ("effective", "partially_effective") and r["effective_ts"] <= DAY <= r["abolish_ts"]]
    place = lambda r: (r["template_id"] or "", r["page_start"], r["clause_no"], r["clause_id"])

    def expected(query):
        unit = lambda t: embedded(t) / np.linalg.norm(embedded(t))
        cos = {r["clause_id"]: round(float(unit(query) @ unit(f"{r['title']}\n{r['content']}".strip())), 9) for r in live}
        score = {r["clause_id"]: cos[r["clause_id"]] for r in sorted(live, key=lambda r: (-cos[r["clause_id"]], place(r)))[:5]}
        hits = sorted((r for r in live if r["doc_type"] == "policy" and query in f"{r['title']}\n{r['content']}"), key=place)[:5]
        for rank, r in enumerate(hits):
            score[r["clause_id"]] = score.get(r["clause_id"], 0.0) + 5 - rank
        at = {r["clause_id"]: place(r) for r in live}
        return [(c, pytest.approx(score[c], abs=2e-9)) for c in sorted(score, key=lambda c: (-score[c], at[c]))[:5]]

    assert len(category) == 5
    for task, name in category.items():
        mine = sorted(((json.loads(r["value"]), r["item_id"]) for r in rows if r["result"] == "suggestions" and r["task_id"] == task), key=lambda v: v[0]["rank"])
        assert [(i, v["score"]) for v, i in mine] == expected(name) and all(v["category"] == name for v, _ in mine)


def test_embeddings_are_made_where_the_clauses_are(spark):
    """each vector of 1,536 numbers was shuffled to the queries."""
    kb = spark.createDataFrame([(f"c{i}", f"t{i % 7}", "x" * (i % 5) if i else None, "" if i % 2 else None, i % 3) for i in range(60)], "clause_id string, title string, content string, template_id string, page_start long")
    q = spark.createDataFrame([("a", "t1"), ("b", ""), (None, "t2")], "query_id string, query string").withColumn("vector", X.hash_embedding("query", 40))
    few = V.vector_topk(kb, q, 6)
    many = V.vector_topk(kb, q, 6, chunk=7, query_chunk=2, few=0)
    given = V.vector_topk(kb.withColumn("vector", X.hash_embedding(X.joined("title", "content"), 40)), q, 6)
    key = lambda r: (str(r["query_id"]), r["rank"])
    assert sorted(few.collect(), key=key) == sorted(many.collect(), key=key) == sorted(given.collect(), key=key) and few.count() == 18
    assert "MapInPandas" in plan(few) and "FlatMapCoGroups" not in plan(few)


def test_template_vectors_are_no_expression_of_numbers(spark):
    """each number of a vector was cut out of a hexadecimal text, converted and cast."""
    text = "第一条 付款\n甲方付款\n第二条 验收\n  检验 合格"
    t = spark.createDataFrame([("d", "t", "n", text), ("e", "u", "m", None), ("f", "v", "k", "前言\n一、范围\n二、发票")], "document_id string, template_id string, template_name string, text string").selectExpr(
        "*", "'x' AS category_lv1", "'y' AS category_lv2", "1 AS page_start", "2 AS page_end", "20240101 AS effective_ts")
    df = G.ingest_templates(t)
    assert "conv(" not in plan(df) and plan(df).count("ArrowEvalPython") == 1
    got = {(r["document_id"], r["clause_no"]): r for r in df.collect()}
    assert sorted((k, r["title"], r["content"], r["clause_type"]) for k, r in got.items()) == [
        (("d", "1"), "第一条 付款", "甲方付款", "payment"), (("d", "2"), "第二条 验收", "检验 合格", "acceptance"), (("e", "1"), "m-1", "", "general"),
        (("f", "1"), "前言", "前言", "general"), (("f", "2"), "一、范围", "一、范围", "general"), (("f", "3"), "二、发票", "二、发票", "invoice")]
    for r in got.values():
        assert np.array_equal(r["vector"], embedded(f"{r['title']}\n{r['content']}".strip()))


def test_subsequences_of_many_texts():
    """the bound of each pair was searched by itself."""
    rnd = random.Random(5)
    texts = ["", "a"] + ["".join(rnd.choice("abc付款") for _ in range(rnd.randrange(70))) for _ in range(30)]

    def lcs(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
            row = new
        return row[-1]

    common = M.Subsequences(texts)
    for t in texts + ["zzz", "cab款"]:
        assert common.lengths(t).tolist() == [lcs(t, x) for x in texts]


def test_runs_that_hold_or_are_held():
    rnd = random.Random(6)
    for _ in range(200):
        norm = lambda: "".join(rnd.choice("ab") for _ in range(rnd.randrange(3)))
        blocks = [{"page": p, "block_no": p * 5 + i, "text": rnd.choice(["x", " "]), "norm": norm()} for p in range(3) for i in range(rnd.randrange(6))]
        runs, want = M.runs_of(blocks), []
        for s, b in enumerate(blocks):
            for size in range(1, 5):
                w = blocks[s:s + size]
                if len(w) == size and all(x["page"] == b["page"] for x in w) and " ".join(x["text"] for x in w).strip():
                    want.append((b["page"], b["block_no"], size, "".join(x["norm"] for x in w)))
        assert runs == want
        t = norm() or "a"
        assert sorted(M.holding(t, runs)) == [j for j, r in enumerate(runs) if r[3] and (t in r[3] or r[3] in t)]


def box(n: int) -> tuple:
    return 0, n, 10, 5


def test_certain_targets_are_searched_once(spark):
    """texts, blocks and results were written and joined again after the search, and a second search was planned for no target."""
    blocks = [("t", p, p * 4 + i, f"line{p}x{i} words", *box(i)) for p in range(20) for i in range(3)] + [("t", 3, 12, "line3x0 words", *box(9))]
    b = spark.createDataFrame(blocks, "task_id string, page long, block_no long, text string, x long, y long, width long, height long")
    schema = "task_id string, target_id string, ord long, text string, page_hint long"
    sure = spark.createDataFrame([("t", f"g{p}", p, f"line{p}x0", p) for p in range(20)], schema)
    df = K.locate_evidence_text(sure, b)
    assert "MapInPandas" not in plan(df)
    got = {r["target_id"]: tuple(r)[2:] for r in df.collect()}
    assert got["g5"] == (5, "line5x0 words", *box(0), 1.01)
    assert got["g3"] == (3, "line3x0 words line3x0 words", 0, 0, 10, 14, 1.01)  # a block number that comes twice
    # targets without a task, a page, a text or an own key
    odd = spark.createDataFrame([("t", "a", 1, "line7x2", 40), ("u", "b", 2, "line", 1), (None, "c", 3, "line", 1), ("t", "d", 4, "line1x0", None), ("t", "e", 5, "--", 2), ("t", "f", 6, "line2x1", 2), ("t", "f", 7, "line9x0", 9)], schema)
    got = {}
    for r in K.locate_evidence_text(odd, b).collect():
        got.setdefault(r["target_id"], []).append((r["page"], r["evidence_text"], r["score"]))
    assert got["a"] == [(7, "line7x0 words line7x1 words line7x2 words", 0.95)] and got["b"] == [(1, "line", None)] and got["c"] == [(1, "line", None)] and got["d"] == [(0, "line1x0", None)]
    assert got["e"] == [(2, "line2x0 words", 0.06)] and got["f"] == [(2, "line2x0 words line2x1 words", 1.01)] * 2


def test_texts_of_evidence_follow_the_choice(spark, monkeypatch):
    """The texts of all evidence went along with every candidate, and once more to the issues."""
    seen, real = [], K.last_evidence
    monkeypatch.setattr(K, "last_evidence", lambda e: seen.append(set(e.columns)) or real(e))
    issues = spark.createDataFrame([("t", "i1", "付款 条件", "", None, None, False), ("t", "i2", "验收", "", None, None, False), ("t", "i3", "没有", "", None, None, False)],
                                   "task_id string, issue_id string, problem string, clause_location string, source_rule_name string, matched_title string, no_direct_evidence boolean")
    clauses = spark.createDataFrame([("t", "c1", "付款", "付款 条件", "按 条件 付款", "l", "l", 1)], "task_id string, clause_id string, title string, summary string, raw_text string, label string, core_label string, sort_order long")
    facts = spark.createDataFrame([("t", "f1", "验收", "验收 日期", "", 1)], "task_id string, fact_id string, label string, value string, notes string, ord long")
    ev = spark.createDataFrame([("t", "e1", "clause", "c1", 1, 0, "旧文"), ("t", "e1", "clause", "c1", 2, 0, "新文"), ("t", "e2", "fact", "f1", 4, 0, "事实")],
                               "task_id string, evidence_id string, source_type string, source_id string, page long, segment_index long, text string")
    got = {r["issue_id"]: tuple(r)[2:] for r in K.issue_target(issues, clauses, facts, ev).collect()}
    assert got == {"i1": ("c1", None, "e1", 2, "新文", None), "i2": (None, "f1", "e2", 4, "事实", None), "i3": (None, None, None, None, None, "未能定位到对应原文。")}
    assert [("text" in c) for c in seen] == [False, True]


def test_lines_of_a_page_meet_their_groups_once(spark):
    """lines and groups met in many joins, and each moved the texts."""
    line = lambda t, p, n, text, y=None: (t, p, n, f"l{n}", text, 10, 30 * n if y is None else y, 50, 20)
    lines = [line("t", 1, n, f"w{n}") for n in range(1, 5)] + [line("t", 2, n, f"v{n}") for n in (1, 2)] + [line("t", 2, 2, "v2")] + [line("t", 3, 1, "solo"), line(None, 1, 1, "x")]
    lines += [("t", 2, 7, None, " no id ", 10, 900, 0, 0)]
    groups = [("t", 1, 1, ["l1", "l2"]), ("t", 1, 2, ["l2", "l4"]), ("t", 1, 3, ["l4", "gone"]), ("t", 2, 1, ["l1", " ", "l2"]), ("t", 2, None, ["l1"]), (None, 1, 1, ["l1"]), ("t", 4, 1, ["l1"])]
    a = spark.createDataFrame(lines, "task_id string, page long, line_no long, line_id string, text string, x long, y long, width long, height long")
    g = spark.createDataFrame(groups, "task_id string, page long, group_no long, line_ids array<string>")
    df = D.alignment_blocks(a, g)
    got = sorted((r["page"], r["block_no"], r["block_id"], r["text"], r["x"], r["y"], r["width"], r["height"]) for r in df.collect())
    assert got == [
        (1, 1, "hybrid_001_001", "w1 w2", 10, 30, 50, 50), (1, 2, "hybrid_tail_l3", "w3", 10, 90, 50, 20), (1, 3, "hybrid_tail_l4", "w4", 10, 120, 50, 20),
        (2, 1, "hybrid_002_null", "v1", 10, 30, 50, 20), (2, 2, "hybrid_002_001", "v1 v2 v2", 10, 30, 50, 50), (2, 3, None, "no id", 10, 900, 1, 1)]
    assert plan(df).count("Join") <= 6


def items_and_blocks(spark, page):
    b = spark.createDataFrame([("t", p, p * 2 + i, f"b{p}{i}", f"验收 文本{p}{i}") for p in (1, 2, 3) for i in (0, 1)], "task_id string, page long, block_no long, block_id string, text string")
    rows = [("t", i, f"标签{i}", f"文本{i}1", page(i)) for i in (1, 2, 3)]
    return spark.createDataFrame(rows, "task_id string, ord long, label string, raw string, page string"), b


def test_rows_with_their_page_are_not_looked_up(spark, monkeypatch):
    """the texts of all pages were moved twice and those of the rows five times, whether a page was missing or not."""
    s = spark.createDataFrame([("t", 2, 1, "第二章")], "task_id string, page long, sort_order long, title string")

    def built(page):
        x, b = items_and_blocks(spark, page)
        c = C.build_clauses(x.selectExpr("task_id", "ord", "label", "label AS title", "NULL AS core_label", "'' AS label_source", "raw AS raw_text", "CAST(NULL AS STRING) AS summary", "page", "'0.5' AS confidence",
                                         "CAST(NULL AS ARRAY<STRING>) AS references", "'no' AS need_review"), b, s)
        f = C.build_facts(x.selectExpr("task_id", "concat('k', ord) AS fact_key", "ord", "label", "raw AS value", "CAST(NULL AS STRING) AS evidence_text", "page", "'0.5' AS confidence", "'' AS notes"), b)
        return c, f

    want_c = [(1, "文本11", "文本11", 1, None), (2, "文本21", "文本21", 2, "第二章"), (3, "文本31", "文本31", 3, "第二章")]
    want_f = [(1, "文本11", 1, "b11"), (2, "文本21", 2, "b21"), (3, "文本31", 3, "b31")]
    rows = lambda c, f: ([(r["sort_order"], r["raw_text"], r["summary"], r["page"], r["section_title"]) for r in c.orderBy("sort_order").collect()],
                         [(r["ord"], r["value"], r["page"], r["evidence_id"]) for r in f.orderBy("ord").collect()])
    assert rows(*built(lambda i: "99" if i == 2 else "x")) == (want_c, want_f)
    monkeypatch.setattr(D, "locate_page", lambda *a: pytest.fail("no page is missing"))
    c, f = built(str)
    assert rows(c, f) == (want_c, want_f)
    assert "Join" not in plan(c)


def test_dealt_out_documents_are_written(spark, folder):
    """A few large row groups were dealt out anew, with all their texts, for each reading of the documents."""
    assert "Repartition" not in plan(B.blocks(spark, folder))
    assert B.corpus(spark, folder).count() == 5
