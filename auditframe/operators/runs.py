"""Comparison of two runs over the same contracts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import params as P
from ..functions import ordered as O
from ..functions import similarity as M
from ..functions import text as X
from .structure import PAGE, page_chunk


def run_summary(tasks: DataFrame, tables: dict[str, DataFrame], reports: DataFrame, issues: DataFrame) -> DataFrame:
    """Row counts per table, category, template and severity counts of each task of a run."""
    out = tasks
    for name, df in tables.items():
        out = out.join(df.groupBy("task_id").agg(F.count(F.lit(1)).alias(f"n_{name}")), "task_id", "left")
    sev = issues.groupBy("task_id").agg(F.count(F.lit(1)).alias("issue_count"), F.count_if(F.col("severity") == "must_modify").alias("n_must_modify"), F.count_if(F.col("severity") == "suggest_modify").alias("n_suggest_modify"))
    out = out.join(reports.select("task_id", "category", "template_id"), "task_id", "left").join(sev, "task_id", "left")
    return out.na.fill(0, [f"n_{n}" for n in tables] + ["issue_count", "n_must_modify", "n_suggest_modify"])


def _kept(df: DataFrame, order: list[str], n: int | None) -> DataFrame:
    """Rows of each task with their rank; the first n only, if there is an n."""
    return df.withColumn("_r", F.struct(*order)) if n is None else O.top_k(df, ["task_id"], order, n, "_r")


def list_overlap(a: DataFrame, b: DataFrame, value: str, samples: int | None = None) -> DataFrame:
    """Overlap of the normalised distinct values of two runs per task, with the values (or some) that only one has."""
    def side(df, tag):
        k = df.select("task_id", F.col(value).alias("v"), X.normalize_eval(value).alias("k"))
        return k.groupBy("task_id", "k").agg(F.count(F.lit(1)).alias(f"n_{tag}"), F.min("v").alias(f"v_{tag}"))
    j = side(a, "a").join(side(b, "b"), ["task_id", "k"], "full_outer")
    key, ina, inb = F.col("k") != "", F.col("n_a").isNotNull(), F.col("n_b").isNotNull()
    g = j.groupBy("task_id").agg(F.coalesce(F.sum("n_a"), F.lit(0)).alias("baseline_count"), F.coalesce(F.sum("n_b"), F.lit(0)).alias("candidate_count"), F.count_if(key & ina & inb).alias("overlap_count"),
                                 F.count_if(key & ina).alias("_a"), F.count_if(key & inb).alias("_b"))
    def sample(cond, v, name):
        s = _kept(j.where(key & cond).select("task_id", "k", F.col(v).alias("v")), ["k"], samples)
        return s.groupBy("task_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("_r", "v"))), lambda x: x["v"]).alias(name))
    g = g.join(sample(ina & ~inb, "v_a", "baseline_only"), "task_id", "left").join(sample(inb & ~ina, "v_b", "candidate_only"), "task_id", "left")
    none = F.array().cast("array<string>")
    return g.select("task_id", "baseline_count", "candidate_count", "overlap_count", F.round(F.col("overlap_count") / F.greatest("_a", F.lit(1)), 4).alias("ratio_vs_baseline"),
                    F.round(F.col("overlap_count") / F.greatest("_b", F.lit(1)), 4).alias("ratio_vs_candidate"), F.coalesce("baseline_only", none).alias("baseline_only"), F.coalesce("candidate_only", none).alias("candidate_only"))


def fact_agreement(a: DataFrame, b: DataFrame, below: float = 0.85) -> DataFrame:
    """Mean value similarity of the labels both runs have (last value of a label wins)."""
    def side(df, tag):
        k = df.withColumn("k", X.normalize_eval("label")).where(F.col("k") != "")
        return k.groupBy("task_id", "k").agg(F.max_by("value", "ord").alias(f"v_{tag}"))
    j = side(a, "a").join(side(b, "b"), ["task_id", "k"])
    na, nb = X.normalize_eval("v_a"), X.normalize_eval("v_b")
    blank_a, blank_b = F.coalesce("v_a", F.lit("")) == "", F.coalesce("v_b", F.lit("")) == ""
    raw = M.seq_ratio(F.when(~blank_a & ~blank_b, na), F.when(~blank_a & ~blank_b, nb))
    j = j.withColumn("_r", raw).withColumn("similarity", F.when(blank_a & blank_b, 1.0).when(blank_a | blank_b, 0.0).otherwise(F.col("_r")))
    return j.groupBy("task_id").agg(F.count(F.lit(1)).alias("shared_labels"), F.round(F.avg("similarity"), 4).alias("value_similarity_avg"), F.count_if(F.col("similarity") < below).alias("n_mismatch"))


def severity_counts(a: DataFrame, b: DataFrame) -> DataFrame:
    n = lambda df, c: df.groupBy("task_id", "severity").agg(F.count(F.lit(1)).alias(c))
    return n(a, "baseline").join(n(b, "candidate"), ["task_id", "severity"], "full_outer").na.fill(0, ["baseline", "candidate"])


def issue_agreement(a: DataFrame, b: DataFrame) -> DataFrame:
    p = list_overlap(a, b, "problem").select("task_id", F.col("ratio_vs_baseline").alias("problem_ratio"), F.col("overlap_count").alias("problem_overlap"))
    c = list_overlap(a, b, "clause_location").select("task_id", F.col("ratio_vs_baseline").alias("location_ratio"), F.col("overlap_count").alias("location_overlap"))
    return p.join(c, "task_id", "full_outer")


def run_delta(a: DataFrame, b: DataFrame, overlaps: dict[str, DataFrame], metrics: list[str]) -> DataFrame:
    """Metric deltas and overlap ratios; a task missing or failed in one run is marked failed.

    a, b: run summaries with ``elapsed_ms``, ``failed`` and the metric columns.
    """
    cols = [*metrics, "elapsed_ms", "issue_count", "category", "template_id", "failed"]
    side = lambda df, t: df.select("task_id", *[F.col(c).alias(f"{t}_{c}") for c in cols], F.lit(True).alias(f"{t}_here"))
    j = side(a, "a").join(side(b, "b"), "task_id", "full_outer")
    failed = F.col("a_here").isNull() | F.col("b_here").isNull() | F.coalesce("a_failed", F.lit(False)) | F.coalesce("b_failed", F.lit(False))
    for name, o in overlaps.items():
        j = j.join(o.select("task_id", F.col("ratio_vs_baseline").alias(f"{name}_overlap")), "task_id", "left")
    d = lambda c: F.when(~failed, F.col(f"b_{c}") - F.col(f"a_{c}")).alias(f"{c}_delta")
    return j.select("task_id", F.when(failed, "failed").otherwise("ok").alias("execution_status"), *[d(c) for c in [*metrics, "elapsed_ms", "issue_count"]],
                    (~failed & F.col("a_category").eqNullSafe(F.col("b_category"))).alias("category_same"), (~failed & F.col("a_template_id").eqNullSafe(F.col("b_template_id"))).alias("template_same"),
                    F.when(~failed & (F.col("a_elapsed_ms") > 0) & (F.col("b_elapsed_ms") > 0), F.col("b_elapsed_ms") / F.greatest("a_elapsed_ms", F.lit(1))).alias("elapsed_ratio"), *[f"{n}_overlap" for n in overlaps])


def run_assessment(delta: DataFrame) -> DataFrame:
    """Threshold notes of a comparison; one neutral note when nothing is off."""
    c = F.col
    tests = [("category_drift", ~c("category_same")), ("template_drift", ~c("template_same")), ("low_clause_overlap", c("clause_overlap") < 0.8), ("low_fact_similarity", c("value_similarity_avg") < 0.85),
             ("low_issue_overlap", c("problem_ratio") < 0.6), ("fewer_issues", c("issue_count_delta") <= -5), ("slower", c("elapsed_ratio") > 1.3), ("faster", c("elapsed_ratio") < 0.75)]
    notes = F.array_compact(F.array(*[F.when(t, F.lit(n)) for n, t in tests]))
    ok = F.when(F.size(notes) > 0, notes).otherwise(F.array(F.lit("no_structural_regression")))
    return delta.select("task_id", F.when(c("execution_status") == "failed", F.array(F.lit("run_failed"))).otherwise(ok).alias("notes"))


def page_agreement(a: DataFrame, b: DataFrame, chars: int | None = P.PAGE_CHARS, preview_chars: int | None = None) -> DataFrame:
    """Pages of two runs by position: sizes, matched characters, similarity, unmatched both ways."""
    def side(blocks, t):
        s = F.nullif(X.strip("text"), F.lit(""))
        g = blocks.groupBy(*PAGE).agg(O.joined_list(s, ["block_no"], "\n").alias("t"), F.count(F.lit(1)).alias("n"))
        g = O.numbered(g, ["task_id"], ["page"], "position", page_chunk())
        return g.select("task_id", "position", F.col("t").alias(f"{t}_text"), X.drop_blank("t").alias(f"{t}_flat"), F.col("n").alias(f"{t}_blocks"))
    j = side(a, "a").join(side(b, "b"), ["task_id", "position"], "full_outer")
    flat = lambda t: F.coalesce(f"{t}_flat", F.lit(""))
    cut = lambda t: flat(t) if chars is None else F.substring(flat(t), 1, chars)
    total = F.length(cut("a")) + F.length(cut("b"))
    j = j.withColumn("matched_chars", M.matching_chars(cut("a"), cut("b")))
    # the ratio is twice the matched characters over all characters
    j = j.withColumn("similarity", F.when(total == 0, 1.0).otherwise(2.0 * F.col("matched_chars") / total))
    n = lambda t: F.length(flat(t))
    preview = lambda c: F.coalesce(c, F.lit("")) if preview_chars is None else F.substring(F.coalesce(c, F.lit("")), 1, preview_chars)
    return j.select("task_id", "position", n("a").alias("baseline_chars"), n("b").alias("candidate_chars"), "matched_chars", "similarity", F.greatest(n("a") - F.col("matched_chars"), F.lit(0)).alias("missing_in_candidate"),
                    F.greatest(n("b") - F.col("matched_chars"), F.lit(0)).alias("missing_in_baseline"), F.coalesce("a_blocks", F.lit(0)).alias("baseline_blocks"), F.coalesce("b_blocks", F.lit(0)).alias("candidate_blocks"),
                    preview("a_text").alias("baseline_preview"), preview("b_text").alias("candidate_preview"))


def section_agreement(a: DataFrame, b: DataFrame, samples: int | None = None) -> DataFrame:
    """Major and child section counts, and the titles only one run has."""
    def major(df):
        code = F.coalesce("section_code", F.lit(""))
        m = ~(code.startswith("（") | code.startswith("(")) & ((F.col("level") == 1) | code.startswith("第"))
        return df.withColumn("_major", m).withColumn("_t", X.strip(F.concat(code, F.lit(" "), F.coalesce("title", F.lit("")))))
    ma, mb = major(a), major(b)
    n = lambda df, t: df.groupBy("task_id").agg(F.count_if("_major").alias(f"{t}_major"), F.count_if(~F.col("_major")).alias(f"{t}_child"))
    def only(x, y, name):
        d = x.where("_major").select("task_id", "_t", "sort_order").join(y.where("_major").select("task_id", "_t"), ["task_id", "_t"], "left_anti")
        d = _kept(d, ["sort_order", "_t"], samples)
        return d.groupBy("task_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("_r", "_t"))), lambda s: s["_t"]).alias(name))
    g = n(ma, "baseline").join(n(mb, "candidate"), "task_id", "full_outer").na.fill(0)
    g = g.join(only(ma, mb, "missing_in_candidate"), "task_id", "left").join(only(mb, ma, "extra_in_candidate"), "task_id", "left")
    none = F.array().cast("array<string>")
    return g.withColumn("missing_in_candidate", F.coalesce("missing_in_candidate", none)).withColumn("extra_in_candidate", F.coalesce("extra_in_candidate", none))


def label_count_delta(a: DataFrame, b: DataFrame) -> DataFrame:
    n = lambda df, t: df.groupBy("task_id", F.coalesce(F.nullif("core_label", F.lit("")), F.col("label"), F.lit("")).alias("label")).agg(F.count(F.lit(1)).alias(t))
    j = n(a, "baseline").join(n(b, "candidate"), ["task_id", "label"], "full_outer").na.fill(0, ["baseline", "candidate"])
    return j.withColumn("delta", F.col("candidate") - F.col("baseline"))


def fact_side_by_side(a: DataFrame, b: DataFrame) -> DataFrame:
    """First three values per label of both runs and whether the first ones are equal."""
    def side(df, t):
        f = df.select("task_id", F.coalesce(F.nullif("label", F.lit("")), F.lit("未命名字段")).alias("label"), F.coalesce("value", F.lit("")).alias("v"), "ord")
        f = O.top_k(f, ["task_id", "label"], ["ord"], 3, "_r")
        return f.groupBy("task_id", "label").agg(O.joined_list("v", ["_r"], "；").alias(f"{t}_value"), F.min_by("v", "_r").alias(f"{t}_first"))
    j = side(a, "baseline").join(side(b, "candidate"), ["task_id", "label"], "full_outer")
    show = lambda t: F.coalesce(F.nullif(f"{t}_value", F.lit("")), F.lit("未提取")).alias(f"{t}_value")
    return j.select("task_id", "label", show("baseline"), show("candidate"), F.col("baseline_first").eqNullSafe(F.col("candidate_first")).alias("same"))


def status_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy("task_id", F.coalesce(F.nullif(column, F.lit("")), F.lit("unknown")).alias(column)).agg(F.count(F.lit(1)).alias("n"))


def step_side_by_side(a: DataFrame, b: DataFrame) -> DataFrame:
    """Steps joined by name, in first-seen order (first run, then second)."""
    side = lambda df, t: df.groupBy("task_id", "name").agg(F.max_by("status", "step_id").alias(f"{t}_status"), F.max_by("n_rows", "step_id").alias(f"{t}_rows"), F.min("step_id").alias(f"{t}_at"))
    j = side(a, "baseline").join(side(b, "candidate"), ["task_id", "name"], "full_outer")
    j = O.numbered(j, ["task_id"], [F.col("baseline_at").isNull(), F.coalesce("baseline_at", "candidate_at")], "position")
    return j.select("task_id", "position", "name", F.coalesce("baseline_status", F.lit("-")).alias("baseline_status"), F.coalesce("candidate_status", F.lit("-")).alias("candidate_status"),
                    F.coalesce("baseline_rows", F.lit(0)).alias("baseline_rows"), F.coalesce("candidate_rows", F.lit(0)).alias("candidate_rows"))
