from pyspark.sql import functions as F

from auditframe.functions import text as X


def one(spark, value, expr):
    return spark.createDataFrame([(value,)], "v string").select(expr.alias("o")).first()[0]


def test_clean_text_edges(spark):
    assert one(spark, "　a\xa0​b\r\n\r\r\n\n c \t d ", X.clean_text("v")) == "a b\n\n c d"
    assert one(spark, None, X.clean_text("v")) == ""
    assert one(spark, "  　 ", X.compact_text("v")) == ""


def test_lines_and_summary(spark):
    assert one(spark, " a \r\n　\n b\x85c ", X.clean_lines("v")) == "a\nb\nc"
    assert one(spark, "x" * 10, X.compact_summary("v", 10)) == "x" * 10
    assert one(spark, "abcdefg，。hijk", X.compact_summary("v", 10)) == "abcdefg…"
    assert one(spark, "\U0001F600" * 12, X.compact_summary("v", 10)) == "\U0001F600" * 9 + "…"


def test_headings(spark):
    assert one(spark, "第 三 条 付款", X.heading_level("v")) == 1
    assert one(spark, "（二）其他", X.heading_level("v")) == 3
    assert one(spark, "2. 范围", X.section_code("v")) == "2."
    assert one(spark, "第三条" + "长" * 60, X.is_heading("v")) is False
    assert one(spark, "", X.is_heading("v")) is False
    assert one(spark, "一、合同编号：", X.valid_section_title("v")) is False
    assert one(spark, "第一章 总则", X.valid_section_title("v")) is True


def test_contract_number_falls_through(spark):
    assert one(spark, "合同编号：HT-2024001。", X.contract_number("v")) == "HT-2024001"
    assert one(spark, "编号：合同书文本 AB-20240, x", X.contract_number("v")) == "AB-20240"
    assert one(spark, "no number", X.contract_number("v")) is None


def test_references_and_levels(spark):
    assert one(spark, "见第一条、附件二及第一条", X.cross_references("v")) == ["第一条", "附件二"]
    assert one(spark, "n/a", X.clamp_confidence("v")) == 0.72
    assert one(spark, "7", X.coerce_level("v")) == 6
    assert one(spark, " 高 ", X.risk_level("v")) == "high"


def test_hash_embedding_matches_chained_digest(spark):
    import hashlib
    got = one(spark, " 付款 ", X.hash_embedding("v", 40))
    d = hashlib.sha256("付款".encode()).digest()
    want = [b / 255.0 * 2 - 1 for b in d] + [b / 255.0 * 2 - 1 for b in hashlib.sha256(d).digest()[:8]]
    assert all(abs(a - b) < 1e-12 for a, b in zip(got, want)) and len(got) == 40
    assert one(spark, "  ", X.hash_embedding("v", 3)) == [0.0, 0.0, 0.0]


def test_bound_is_never_below_ratio(spark):
    from auditframe.functions import similarity as M
    rows = [("付款条件验收", "验收付款"), ("", ""), ("abc", ""), ("abcabc" * 40, "bcabca" * 40)]
    df = spark.createDataFrame(rows, "a string, b string").select(X.seq_ratio_bound("a", "b").alias("u"), M.seq_ratio("a", "b").alias("r"))
    assert all(r.u + 1e-9 >= r.r for r in df.collect())


def test_blank_classes_agree_with_patterns(spark):
    import re
    from itertools import product
    pieces = ["a", " ", "  ", "\t", "\r", "\n", "\x1c", "\x85", "\xa0", "\u2003", "\u2028", "\u3000", "\u200b", "b. "]
    texts = ["".join(p) for p in product(pieces, repeat=3)] + ["a" + " " * 9 + "\n" * 4 + "b" * 30, None]
    w, b = f"[{X.WS}]", f"[{X.BREAKS}]"

    def lines(v):
        return re.sub(f"^{w}+|{w}+$", "", re.sub(f"{w}*{b}{w}*", "\n", (v or "").replace("\u3000", " ").replace("\r", "\n")))

    def clean(v):
        x = re.sub("\r\n?", "\n", (v or "").translate({0x3000: " ", 0xA0: " ", 0x200B: None}))
        return re.sub(f"\\A{w}+|{w}+\\Z", "", re.sub("\n{3,}", "\n\n", re.sub("[ \t]+", " ", x)))

    def one(v):
        return re.sub(f"\\A{w}+|{w}+\\Z", "", re.sub(f"{w}+", " ", lines(v)))
    df = spark.createDataFrame([(t,) for t in texts], "v string")
    rows = df.select("v", X.clean_lines("v").alias("l"), X.clean_lines(F.concat("v", F.lit(""))).alias("l2"), X.compact_summary("v", None).alias("s"), X.clean_text("v").alias("c")).collect()
    assert [r for r in rows if (r.l, r.s, r.c) != (lines(r.v), one(r.v), clean(r.v)) or r.l2 != lines(r.v)] == []


def test_one_line_texts_run_no_pattern_of_runs(spark):
    """A text of single blanks is tested once; the patterns of blank runs stand behind that test, and bounds cut before patterns."""
    df = spark.createDataFrame([("a b",)], "v string")
    plan = df.select(X.compact_summary("v", 20).alias("o"))._jdf.queryExecution().optimizedPlan().toString().lower()
    assert "case when rlike" in plan and "substring" in plan and "translate" not in plan and plan.count("rlike") == 1


def test_ratio_by_text_search():
    import random
    from difflib import SequenceMatcher

    from auditframe.functions import similarity as M
    r = random.Random(5)
    make = lambda n: "".join(r.choice(["ab ", "abc", "条", "付款", "xyz", "\0", "\1"]) if r.random() < 0.9 else chr(r.randrange(0x4E00, 0x4E40)) for _ in range(n))
    texts = ["", "a", "ab" * 300, *[make(r.choice([3, 30, 90, 240])) for _ in range(60)]]
    texts += [t[: len(t) // 2] + make(5) + t[len(t) // 3:] for t in texts]
    for a in texts * 3:
        b, least = r.choice(texts), r.random()
        want = SequenceMatcher(None, a, b).ratio()
        assert M.ratio_to(a, b, M.places(b)) == want
        got = M.ratio_to(a, b, M.places(b), least)
        assert got == want or got == -1 and want < least
        assert M.ratio_to(a, a, M.places(a)) == 1.0


def test_hopeless_pairs_are_left_early():
    from auditframe.functions import similarity as M
    assert M.ratio_to("ab" * 50, "ba" + "c" * 20, M.places("ba" + "c" * 20), 0.9) == -1  # too short to reach 0.9


def test_char_counts_of_any_text():
    from collections import Counter

    from auditframe.functions import similarity as M
    texts = ["", "abca", "条款a", "\U0001F600x", "\ud800"]
    m, n = M.char_counts(texts)
    chars = sorted({c for t in texts for c in t})
    assert list(n) == [len(t) for t in texts] and [[Counter(t)[c] for c in chars] for t in texts] == m.tolist()
    assert M.char_counts(["", ""])[0].sum() == 0
