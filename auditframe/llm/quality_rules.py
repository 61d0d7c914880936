"""Quality rules as a learned decision list, with DataFrame operations only.

Statistics.  Everything is computed inside the row from the whole text: words, symbols, repeated lines, and words in 5-word windows that
occur again.  Windows are compared by 64-bit hashes: a text whose hashes are all distinct has none; otherwise (hash, place) pairs are
sorted and neighbours compared, so that a text of n words costs n log n at most and nothing is shuffled.

Learning.  Sequential covering: at most `sample` labelled rows (a documented bound: the ids of smallest hash outside the held fold) are
split into growing and pruning rows.  A rule grows threshold by threshold (candidates: midpoints between quantiles of each statistic, both directions) by
information gain for label 0, counted by one grouped aggregate a step; then final conditions are dropped while that does not lower its
worth on the pruning rows.  Rules are added while they are right on most pruning rows; each covers what earlier ones left.

The list becomes one CASE expression in order: the first rule that fits rejects, and what no rule fits is kept.

Null and empty texts have no words and fail the base rule; without labelled rows the list is empty and only the base rule counts; null
ids are scored but never learnt from.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fold, let, query, staged, table

SAMPLE = 20_000
QUANTILES = 24
MAX_RULES = 8
MAX_CONDITIONS = 4
#: A rule must be right on this share of the pruning rows it fits, and fit at least so many growing rows.
PRECISION = 0.9
SUPPORT = 8

SYMBOLS = "#*$%&|<>"
BLANKS = "\t\n\x0b\x0c\r"


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(text, BLANKS, " " * len(BLANKS)), " "), "")


def repeated(words: Column, size: int = 5) -> Column:
    """Words in windows of `size` that occur twice or more, the first included; words is a lambda variable."""
    last = F.size(words) - size + 1
    hashes = F.when(last < 2, F.array().cast("array<bigint>")).otherwise(
        F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(1)) - 1), lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(size)])))

    def covered(h: Column) -> Column:
        places = let(F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))), lambda s: F.array_sort(F.transform(
            F.filter(F.transform(s, lambda x, i: F.struct(x["i"].alias("i"), ((F.get(s, i - 1)["h"] == x["h"]) | F.coalesce(F.get(s, i + 1)["h"] == x["h"], F.lit(False))).alias("again"))),
                     lambda x: F.coalesce(x["again"], F.lit(False))), lambda x: x["i"])))
        # each place covers up to the next one, `size` words at most; -size stands before the first
        return F.aggregate(places, F.struct(F.lit(0).cast("long").alias("n"), F.lit(-size).alias("last")),
                           lambda a, p: F.struct((a["n"] + F.least(F.lit(size), p - a["last"])).cast("long").alias("n"), p.alias("last")), lambda a: a["n"])

    return let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(covered(h)))


def count_of(text: Column, chars: str) -> Column:
    return (F.length(text) - F.length(F.translate(text, chars, ""))).cast("long")


def statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed and the shares that rules may test."""
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: F.length(F.translate(x, " " + BLANKS, "")) > 0)
    own = let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    by_word = let(words_of(t), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), F.size(F.array_distinct(w)).cast("long").alias("n_kinds"), repeated(w).alias("n_repeat_words")))
    upper, digits = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    docs = docs.withColumns({
        "_w": by_word, "_l": own, "word_chars": F.length(F.translate(t, " " + BLANKS, "")).cast("long"), "n_symbols": count_of(t, SYMBOLS),
        "_upper": count_of(t, upper), "_digits": count_of(t, digits), "_marks": count_of(t, "!?"), "_stops": count_of(t, ".,;:")})
    docs = docs.withColumns({"n_words": F.col("_w.n_words"), "n_repeat_words": F.col("_w.n_repeat_words"), "n_dup_lines": F.col("_l.n_dup_lines")})
    share = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    docs = docs.withColumns({
        "x_words": F.col("n_words").cast("double"), "x_length": share("word_chars", "n_words"), "x_symbols": share("n_symbols", "n_words"), "x_dup_lines": share("n_dup_lines", "_l.n_lines"),
        "x_repeats": share("n_repeat_words", "n_words"), "x_kinds": share("_w.n_kinds", "n_words"), "x_upper": share("_upper", "word_chars"), "x_digits": share("_digits", "word_chars"),
        "x_marks": share("_marks", "n_words"), "x_stops": share("_stops", "n_words")})
    docs = docs.withColumn("base_failed", F.expr("n_words < 10 or 100 * n_repeat_words > 20 * n_words"))
    return docs.drop("_w", "_l", "_upper", "_digits", "_marks", "_stops")


FEATURES = ["x_words", "x_length", "x_symbols", "x_dup_lines", "x_repeats", "x_kinds", "x_upper", "x_digits", "x_marks", "x_stops"]

#: One condition: statistic, ">" or "<=", threshold.  A rule is a conjunction of them.
Condition = tuple[str, str, float]


def fits(rule: list[Condition]) -> Column:
    out = F.lit(True)
    for name, way, x in rule:
        out = out & (F.col(name) > F.lit(x) if way == ">" else F.col(name) <= F.lit(x))
    return out


def labelled(docs: DataFrame, labels: DataFrame, doc_id: str, text: str, label: str, held: int | None, sample: int) -> DataFrame:
    """Statistics and label (bad) of the sampled labelled rows, and whether a row is for pruning; a table of at most `sample` rows."""
    ids = labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull())
    if held is not None:
        ids = ids.where(fold(doc_id, 3) != held)
    ids = ids.groupBy(F.col(doc_id).alias("k_id")).agg(F.max(F.col(label).cast("int")).alias("y")).orderBy(F.xxhash64("k_id"), "k_id").limit(sample)
    # at most `sample` ids: a broadcast of known size, and statistics of their documents alone
    own = docs.select(F.col(doc_id).alias("k_id"), F.col(text).alias("text")).join(F.broadcast(ids), "k_id")
    rows = statistics(own).groupBy("k_id").agg(F.min("y").alias("y"), F.min(F.struct("base_failed", *FEATURES)).alias("s")).select("k_id", "y", "s.*")
    return staged(rows.where("not base_failed").select((F.col("y") == 0).alias("bad"), (F.pmod(F.xxhash64(F.lit("prune"), "k_id"), F.lit(3)) == 0).alias("prune"), *FEATURES), "labelled")


def gain(p: float, n: float, p0: float, n0: float) -> float:
    return p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0))) if p else 0.0


def learn(rows: DataFrame, quantiles: int = QUANTILES, max_rules: int = MAX_RULES, max_conditions: int = MAX_CONDITIONS, precision: float = PRECISION, support: int = SUPPORT) -> list[list[Condition]]:
    """An ordered list of rules for bad rows."""
    at = [i / quantiles for i in range(quantiles)] + [0.99, 0.995]
    cut = rows.agg(*[F.array_sort(F.array_distinct(F.percentile(F.col(f), F.array(*map(F.lit, at))))).alias(f) for f in FEATURES], *[
        F.array_sort(F.array_distinct(F.percentile(F.when(F.col("bad"), F.col(f)), F.array(*map(F.lit, at))))).alias(f"bad_{f}") for f in FEATURES]).first()
    values = {f: sorted({*(cut[f] or []), *(cut[f"bad_{f}"] or [])}) for f in FEATURES}
    # halfway between two values, so that a threshold stands clear of either side
    cuts = {f: [(a + b) / 2 for a, b in zip(v, v[1:])] for f, v in values.items()}
    if not any(cuts.values()):
        return []
    # a place among the thresholds (how many lie below) for each statistic
    place = lambda f: F.size(F.filter(F.array(*map(F.lit, cuts[f])), lambda t: t < F.col(f)))
    placed = staged(rows.select("bad", "prune", *FEATURES, F.array(*[F.struct(F.lit(f).alias("f"), place(f).alias("i")) for f in FEATURES]).alias("places")), "placed")
    count = lambda df: {True: 0, False: 0} | {r["bad"]: r["count"] for r in df.groupBy("bad").count().collect()}
    rules: list[list[Condition]] = []
    left = placed
    while len(rules) < max_rules:
        rule: list[Condition] = []
        now = count(left.where("not prune"))
        while len(rule) < max_conditions and now[True] and now[False]:
            cells = left.where(fits(rule) & ~F.col("prune")).select("bad", F.explode("places").alias("c")).groupBy("c.f", "c.i").agg(
                F.sum(F.col("bad").cast("long")).alias("p"), F.sum((~F.col("bad")).cast("long")).alias("n")).collect()
            best = (0.0, None, now)
            for f in FEATURES:
                own = {r["i"]: (r["p"], r["n"]) for r in cells if r["f"] == f}
                p = n = 0
                for i in range(len(cuts[f])):
                    p, n = p + own.get(i, (0, 0))[0], n + own.get(i, (0, 0))[1]
                    for way, a, b in (("<=", p, n), (">", now[True] - p, now[False] - n)):
                        if a + b >= support and (g := gain(a, b, now[True], now[False])) > best[0]:
                            best = (g, (f, way, cuts[f][i]), {True: a, False: b})
            if best[1] is None:
                break
            rule.append(best[1])
            now = best[2]
        if not rule:
            break
        tests = [count(left.where(F.col("prune") & fits(rule[:k]))) for k in range(1, len(rule) + 1)]
        worth = [(t[True] - t[False]) / max(1, t[True] + t[False]) for t in tests]
        keep = max(range(len(rule)), key=lambda k: (worth[k], -k))
        rule, seen = rule[: keep + 1], tests[keep]
        if seen[True] < precision * max(1, seen[True] + seen[False]):
            break
        rules.append(rule)
        left = left.where(~fits(rule))
    return rules


def verdict(rules: list[list[Condition]]) -> Column:
    """The list as one conditional expression: true if no rule fits."""
    out = F.when(F.col("base_failed"), F.lit(False))
    for rule in rules:
        out = out.when(fits(rule), F.lit(False))
    return out.otherwise(F.lit(True))


def judged(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", held: int | None = 1, sample: int = SAMPLE) -> DataFrame:
    """docs with their statistics and kept."""
    rules = learn(labelled(docs, labels, doc_id, text, label, held, sample))
    return statistics(docs, text).withColumn("kept", verdict(rules))


@query("op8_quality_rules")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = judged(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
