"""Costly texts are computed once and uneven inputs are dealt out: properties of plans and layouts, and equal results on odd texts."""
import random
import re

import pytest
from pyspark.sql import functions as F

from auditframe import params as P
from auditframe.functions import text as X
from auditframe.operators import clauses as C
from auditframe.operators import retrieval as V
from auditframe.operators import structure as S
from auditframe.plans import bridge as B

ODD = ["", " ", "a", " a", "a ", "a b", "a  b", "a\tb", "a\nb", "a\n", "\na", "a \n \n b", "a\rb", "a　b", "　a　", "a\xa0b", "a\x85b", "a b", "a​b", "é ü", "中文 字", "中　文", "a b", "😀 x",
       "😀\n😀", "a\x1fb", "\x00a", "a\x7fb", "x" * 5000 + " " + "中" * 5000, "a \x0b", "a ", "﻿a", "a￾", "a\n\n\n中", "a . b ", " a", "a᠎b", None]


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_plain_texts_come_out_as_by_the_patterns(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(ODD)], "i int, t string")
    blank = f"[{X.WS}]"
    got = df.select("i", "t", X.clean_lines("t").alias("lines"), X.compact_summary("t", None).alias("one"), X.clean_lines(F.concat("t", F.lit(""))).alias("computed")).orderBy("i").collect()
    for r in got:
        t = (r.t or "").replace("　", " ").replace("\r", "\n")
        assert r.lines == re.sub(f"{blank}*[{X.BREAKS}]{blank}*", "\n", t).strip(X.BLANKS), repr(r.t)
        assert r.one == re.sub(f"{blank}+", " ", r.t or "").strip(X.BLANKS), repr(r.t)
        assert r.computed == r.lines


def test_searched_keeps_every_word(spark):
    words = [w for ws in P.SCHEMA_ALIASES.values() for w in ws] + [w for ws in P.CATEGORY_KEYWORDS.values() for w in ws]
    rows = [("abc " + w + " déf 12",) for w in words] + [(w[:1] + " x " + w[1:],) for w in words]
    df = spark.createDataFrame(rows, "t string").select("t", X.searched("t", words).alias("s"))
    assert df.select("t", X.word_bits("t", words[:60]).alias("a"), X.word_bits("s", words[:60]).alias("b")).where("a != b").count() == 0
    assert df.select(X.searched("t", ["OCR"]).alias("s"), "t").where("s != t").count() == 0


def test_numbers_are_looked_for_once(spark):
    """a filter on the computed number put a second copy of its patterns into the scan."""
    b = spark.createDataFrame([("t", 1, 1, "b1", "编号：HT-20240001"), ("t", 1, 2, "b2", "order AB-12345 x"), ("t", 2, 1, "b3", "no number - here"), ("t", 2, 2, "b4", "编号：HT-20240001")], "task_id string, page long, block_no long, block_id string, text string")
    f = C.facts_from_pages(b)
    assert {(r.value, r.evidence_id) for r in f.collect()} == {("HT-20240001", "b1"), ("AB-12345", "b2")}
    assert plan(f).count("A-Z]{1,8}") == 1


def test_clause_texts_are_taken_apart_once(spark):
    """the party pattern ran four times on a text, for the parties, the names and twice for their number."""
    row = ("t", "c1", 1, 0.9, 1, "甲乙方信息", "甲方：Acme Ltd\n乙方：Foo（x）", "sum", "甲乙方信息")
    c = spark.createDataFrame([row, ("t", "c2", 1, 0.9, 2, "甲乙方信息", "nobody", "sum2", "甲乙方信息")], "task_id string, clause_id string, page long, confidence double, sort_order long, core_label string, raw_text string, summary string, label string")
    f = C.facts_from_clauses(c.withColumn("structured_fields", F.create_map().cast("map<string,string>")))
    got = {(r.label, r.value, r.notes) for r in f.collect()}
    assert {("甲方", "Acme Ltd", None), ("乙方", "Foo", None), ("主体摘要", "sum2", "主体名称建议人工复核。"), ("甲乙方信息", "sum", None)} <= got and ("主体摘要", "sum", "主体名称建议人工复核。") not in got
    assert plan(f).count("regexp_extract_all") == 1


def test_schema_searches_each_text_once(spark):
    """F27 and the queries on contracts: the search for each alias was made twice and each field got a copy of the text."""
    facts = spark.createDataFrame([("t", "付款条件", " pay ", 2), ("t", "付款条件", "later", 3), ("t", "合同编号", " ", 1), ("u", "其他", "x", 1)], "task_id string, label string, value string, ord long")
    cl = spark.createDataFrame([("t", 5, "题", "验收 a 发票 b", "验收 a 发票 b"), ("t", 4, "题", None, "合同编号 N 发票"), ("u", 1, None, "无", "质量标准"), ("u", 2, "保密", "s", None)], "task_id string, sort_order long, title string, summary string, raw_text string")
    s = C.contract_schema(facts, cl)
    assert {(r.task_id, r.field): r.value for r in s.collect()} == {
        ("t", "payment_terms"): "pay", ("t", "contract_number"): "合同编号 N 发票", ("t", "invoice"): "发票", ("t", "acceptance_standard"): "验收 a 发票 b\n验收 a 发票 b",
        ("u", "quality"): "质量标准", ("u", "acceptance_standard"): "质量标准", ("u", "confidentiality"): "保密\ns"}
    assert plan(s).count("税率") <= 5  # the search of clauses and labels (one each for 税率) and the cut of the chosen texts


def test_values_are_searched_without_blanks(spark):
    """each pair compared the texts twice and took the blanks out of both."""
    b = spark.createDataFrame([("t", 1, 1, "b1", "x y"), ("t", 1, 2, "b2", "a bc  d"), ("t", 1, 3, "b3", "abcd")], "task_id string, page long, block_no long, block_id string, text string")
    x = spark.createDataFrame([("t", 1, "p", "ab c"), ("t", 1, "q", " x y "), ("t", 1, "r", " "), ("t", 1, "s", "zz")], "task_id string, page long, id string, v string")
    got = S.locate_block(x, b, "id", "v")
    assert {(r.id, r.evidence_id) for r in got.collect()} == {("p", "b2"), ("q", "b1")}
    assert plan(got).count("Contains(_b") == 1


def test_blocks_are_not_shuffled_for_local_sections(spark):
    """the texts of all blocks were joined with the tasks that have sections."""
    b = spark.createDataFrame([("t", 1, 1, "b1", "第一条 总则"), ("u", 1, 1, "b2", "一、范围"), ("v", 2, 1, "b3", "plain"), ("u", 1, 2, "b4", "x" * 100)], "task_id string, page long, block_no long, block_id string, text string")
    s = S.reconstruct_sections(b)
    assert {(r.task_id, r.title, r.page) for r in s.collect()} == {("t", "第一条 总则", 1), ("u", "一、范围", 1), ("v", "合同正文", 2)}
    some = S.local_sections(b, spark.createDataFrame([("t",)], "task_id string"))
    assert {(r.task_id, r.title) for r in some.collect()} == {("u", "一、范围"), ("v", "合同正文")}


@pytest.mark.parametrize("groups", [1, 40])
def test_corpus_is_dealt_out_when_row_groups_are_few(spark, tmp_path, groups):
    """All findings on growth: a file with splits for every core but one row group kept all but one of them idle."""
    import pyarrow as pa
    import pyarrow.parquet as pq
    n = 4000
    t = pa.table({"doc_id": pa.array(range(n), pa.int64()), "text": ["".join(chr(97 + (i * k) % 26) for k in range(400)) for i in range(n)], "lang": ["en"] * n, "source": ["s"] * n, "n_chars": pa.array([400] * n, pa.int64())})
    pq.write_table(t, tmp_path / "documents.parquet", row_group_size=n // groups, compression="none")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "20k")
        spark.conf.set("spark.sql.files.openCostInBytes", "1k")
        assert B.load(spark, str(tmp_path), "documents").rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
        sizes = [r["count"] for r in B.corpus(spark, str(tmp_path)).groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old[0])
        spark.conf.set("spark.sql.files.openCostInBytes", old[1])
    assert sum(sizes) == n and max(sizes) * spark.sparkContext.defaultParallelism <= 2 * n


def test_needles_of_a_group_are_searched_directly(spark):
    """every three characters of every text became a row, also where a group has a handful of needles."""
    from auditframe.operators import retrieval as V
    t = spark.createDataFrame([("a", 1, "one two"), ("a", 2, "two"), ("b", 3, "one"), ("b", 4, "x5y7"), ("c", 5, "one")], "g string, id int, hay string")
    n = spark.createDataFrame([("a", "one"), ("a", "two"), ("a", ""), ("b", "two"), *[("b", str(i)) for i in range(9)]], "g string, needle string")
    want = {("a", 1, "one"), ("a", 1, "two"), ("a", 2, "two"), ("b", 4, "5"), ("b", 4, "7")}
    for limit in (256, 5, 0):  # all groups direct, one by grams, all by grams
        assert {tuple(r) for r in V.substring_pairs(t, "id", "hay", n, "needle", ("g",), limit).select("g", "id", "needle").collect()} == want
    got = plan(V.substring_pairs(t, "id", "hay", n, "needle", ("g",)))
    assert "_gram" not in got


def test_templates_of_equal_lists_are_scored_once(spark):
    """Each template was scored by itself, through a row per signature, template and shared word."""
    live, n = V.P.LIVE_STATUSES[0], 60
    kb = [(f"t{t:03}", f"t{t:03}_{i}", ["付款", "验收", "保密"][i % 3], "", ["甲合同", "技术服务合同", None][t % 3], "服务合同类", "" if t == 6 else None, "template", live, 0, 99, i, str(i)) for t in range(n) for i in range(2 + t % 2)]
    kb = spark.createDataFrame(kb, "template_id string, clause_id string, title string, content string, template_name string, category_lv1 string, category_lv2 string, doc_type string, status string, effective_ts long, abolish_ts long, page_start int, clause_no string")
    tasks = [(f"c{i}", ["服务合同类", "无"][i % 2], ["付款", "保密", "保密"][:i % 4], ["technical"] * (i % 3 == 0)) for i in range(12)]
    sig = V.contract_signatures(spark.createDataFrame(tasks, "task_id string, category string, keywords array<string>, flags array<string>"))
    one = sig.select("signature", "category", "keywords", "flags").distinct()
    scores, members = V.class_scores(one, kb, 5)
    # names, two or three clauses; the template of an empty category stands alone
    assert members.select("class").distinct().count() == 7 and members.count() == n and scores.count() <= 7 * one.count()
    clauses, wanted = kb.collect(), {}
    for s in one.collect():
        for c in clauses:
            got = sum(w in c.title for w in s.keywords) + 3.0 * (s.category in c.category_lv1)
            wanted[s.signature, c.template_id] = wanted.get((s.signature, c.template_id), 0.0) + got
    cand = V.template_candidates(sig, kb, 5)
    assert {(r.signature, r.template_id): r.score for r in cand.collect()} == {k: v for k, v in wanted.items() if v}
    every = V.template_rescore(cand, sig)
    direct = V.rescored_candidates(sig, kb, 5)
    assert direct.columns == every.columns and sorted(map(str, direct.collect())) == sorted(map(str, every.collect()))


def test_members_of_a_large_class_are_dealt_out(spark):
    members = spark.range(3000).select(F.lit("t0").alias("class"), F.concat(F.lit("t"), "id").alias("template_id"), *[F.lit("x").alias(c) for c in V.NAMES])
    out = V.each_member(spark.createDataFrame([("a", "t0", 1.0), ("b", "t0", 2.0)], "signature string, template_id string, score double"), members)
    assert out.count() == 6000 == out.select("signature", "template_id").distinct().count()
    assert plan(out).count("_chunk") > 0 and out.groupBy("signature").count().where("count != 3000").count() == 0


def test_profile_flags_without_the_profile(spark):
    """The texts of all clauses of a contract were joined to look for a few words."""
    cats = spark.createDataFrame([("t", "买卖合同类"), ("u", "检测类"), ("v", "x")], "task_id string, category string")
    fields = spark.createDataFrame([("t", {"contract_subject": "点云"}), ("u", {"payment_terms": "律师"}), ("v", {"payment_terms": ""})], "task_id string, fields map<string,string>")
    rows = [("t", "审", "计 line", "raw", 1), ("t", "条款", "", "工程abc设计\n资产评估", 2), ("u", "审计", None, None, 1), ("u", "测", "量", "", 2), ("u", None, "试验", "", 3), ("w", "审计", "审计", "审计", 1)]
    c = spark.createDataFrame(rows, "task_id string, title string, summary string, raw_text string, sort_order long")
    want = {r.task_id: r.flags for r in V.profile_flags(C.contract_profile(cats, fields, c)).collect()}
    assert {r.task_id: r.flags for r in C.profile_flags(cats, fields, c).collect()} == want
    assert want["t"] == ["technical", "survey", "appraisal"] and want["u"] == ["technical", "detection", "legal"]
    assert {r.task_id: r.flags for r in C.profile_flags(cats, fields, c, {"a": ["\n付款"]}).collect()} == {"t": ["a"], "u": ["a"], "v": ["a"]}


def test_runs_that_cannot_win_are_not_compared(spark, monkeypatch):
    """a target that shares no character with a page was compared with each run of its blocks."""
    from difflib import SequenceMatcher
    from auditframe.functions import similarity as M
    calls = []
    real = M.ratio_to
    monkeypatch.setattr(M, "ratio_to", lambda *a: calls.append(a[:2]) or real(*a))
    block = lambda page, no, text: {"page": page, "block_no": no, "text": text, "norm": text}
    blocks = [block(p, p * 4 + i, f"the{p}quick{i}brown" * (1 + 9 * (i == 2))) for p in range(8) for i in range(4)]
    targets = [{"target_id": "a", "page_hint": 3, "norm": "主体摘要待补充", "floor": -1.0}]
    assert M.best_runs(targets, blocks) == [("a", 3, 12, 1, 0.06)] and not calls
    rng = random.Random(7)
    for _ in range(40):
        text = lambda n: "".join(rng.choice("abc付款") for _ in range(rng.randrange(n)))
        blocks = [block(p, p * 4 + i, text(rng.choice([4, 30, 120]))) for p in range(3) for i in range(4)]
        runs = [(b["page"], b["block_no"], z, "".join(x["norm"] for x in blocks[s:s + z])) for s, b in enumerate(blocks) for z in range(1, 5) if s % 4 + z <= 4 and "".join(x["text"] for x in blocks[s:s + z])]
        targets = [{"target_id": str(i), "page_hint": rng.randrange(4), "norm": text(20) or rng.choice(blocks)["norm"][:9], "floor": rng.choice([-1.0, 0.3])} for i in range(6)]
        want = []
        for t in targets:
            a, best = t["norm"], None
            for r in runs:
                v = 0.0 if not a or not r[3] else 0.95 if a in r[3] or r[3] in a else SequenceMatcher(None, a, r[3]).ratio()
                v += 0.06 if r[0] == t["page_hint"] else 0.0
                if v >= t["floor"] and (best is None or v > best[4]):
                    best = (t["target_id"], *r[:3], v)
            want += [best] if best else []
        assert M.best_runs(targets, blocks) == want
