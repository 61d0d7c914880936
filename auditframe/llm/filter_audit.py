"""Filter interaction audit: what each filter removes under every order of application.

Facts.  Each document becomes one row of fixed size: id, part, a bit mask of the filters it fails, its two labels and a 256-bit digest of
its text.  Rows with the same digest are merged before and after each shuffle, so a text that a third of all rows share is counted where it
is read.  In the end only counts by (part, mask, labels) are left, at most 2^filters * 4 for a part.

Audit.  The mask matrix M (masks x filters: 0 where the mask fails the filter, infinite elsewhere) and the position matrix P (filters x
orders: the place of the filter in the order, that is, the inverse permutation) are combined by (min, +): S[mask, order] is the smallest
M + P, the step at which documents of that mask go, infinite for those that stay.  S drives weighted scatter counts: removed at
(order, step), kept after it, lost labels, and redundancies (masks that fail a step's filter but whose S is smaller).  One part is one row
of counts, so parts are independent tasks.

Null texts are empty; a null part is the empty string; null labels and missing ones are neither 0 nor 1, and of several label rows of an id
one that says 1 is enough.  Rows that repeat an id and a text are each counted and are no copies of each other; rows without id are
counted, are copies of nothing and nothing is a copy of them.  An empty table has no parts and gives no rows.
"""

from __future__ import annotations

from itertools import permutations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let, query, table
from .quality_rules import count_of, words_of

COUNTS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]

#: Fewer words than 200; less than half of them distinct; more than 3 percent capitals; a symbol; a copy of a text with a smaller id.
FILTERS = "ABCDE"
SYMBOLS = "#$%&*|"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def failures(text: Column) -> Column:
    """Whether one text fails the filters A to D, as an array of booleans; its words are split once."""
    t = F.coalesce(text, F.lit(""))
    counts = let(words_of(t), lambda w: F.struct(F.size(w).alias("n"), F.size(F.array_distinct(w)).alias("kinds")))
    return let(counts, lambda w: F.array(w["n"] < 200, 100 * w["kinds"] < 50 * w["n"], 100 * count_of(t, UPPER) > 3 * F.length(t), count_of(t, SYMBOLS) > 0))


def mask_counts(docs: DataFrame, labels: DataFrame, fails: Column, names: str, copies: bool = True, part: str = "lang", text: str = "text", doc_id: str = "doc_id", good: str = "quality", toxic: str = "toxic") -> DataFrame:
    """(part, mask, good, toxic, n): documents by the filters they fail.  fails holds a boolean for each letter of names, and bit i is the i-th.

    With copies, the last letter of names has no boolean: its bit marks a text that a smaller id has as well."""
    own = len(names) - copies
    mask = let(fails, lambda f: sum((F.when(F.get(f, F.lit(i)), F.lit(1 << i)).otherwise(F.lit(0)) for i in range(own)), F.lit(0)))
    facts = docs.select(F.col(doc_id).alias("id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), mask.alias("mask"), F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256)).alias("digest"))
    facts = facts.groupBy("id", "part", "mask", "digest").agg(F.count("*").alias("n"))
    says = labels.where(F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("id")).agg(F.coalesce(F.max(F.col(good) == 1), F.lit(False)).alias("good"), F.coalesce(F.max(F.col(toxic) == 1), F.lit(False)).alias("toxic"))
    with_id = facts.where("id is not null").join(says, "id", "left").withColumns({c: F.coalesce(c, F.lit(False)) for c in ("good", "toxic")})
    nameless = facts.where("id is null").groupBy("part", "mask").agg(F.sum("n").alias("n")).select("part", "mask", F.lit(False).alias("good"), F.lit(False).alias("toxic"), "n")
    keys = ["part", "mask", "good", "toxic"]
    if not copies:
        return with_id.select(*keys, "n").union(nameless).groupBy(*keys).agg(F.sum("n").alias("n"))
    # of each text: all rows, and those of the smallest id, which are no copies
    merged = with_id.groupBy("digest", *keys).agg(F.sum("n").alias("n"), F.min(F.struct("id", "n")).alias("first"))
    least = merged.groupBy("digest").agg(F.min("first.id").alias("least"))
    merged = merged.join(least, "digest").withColumn("originals", F.when(F.col("first.id") == F.col("least"), F.col("first.n")).otherwise(F.lit(0)))
    split = F.array(F.struct(F.col("mask"), F.col("originals").alias("n")), F.struct(F.col("mask").bitwiseOR(F.lit(1 << own)).alias("mask"), (F.col("n") - F.col("originals")).alias("n")))
    rows = merged.select("part", "good", "toxic", F.explode(split).alias("s")).where("s.n > 0").select("part", "s.mask", "good", "toxic", "s.n")
    return rows.union(nameless).groupBy(*keys).agg(F.sum("n").alias("n"))


def removal_steps(masks: np.ndarray, orders: np.ndarray) -> np.ndarray:
    """Step (from 0) at which each mask goes under each order; the number of filters for masks that stay.  A (min, +) product."""
    n_filters = orders.shape[1]
    failed = (masks[:, None] >> np.arange(n_filters)) & 1
    m = np.where(failed == 1, 0, n_filters)
    p = np.argsort(orders, axis=1).T
    return np.minimum((m[:, :, None] + p[None, :, :]).min(1), n_filters)


def audited(counts: pd.DataFrame, names: str) -> pd.DataFrame:
    """Rows (filter_order, step, counts) of one part from its counts by mask and labels."""
    k = len(names)
    orders = np.array(list(permutations(range(k))))
    masks, n = counts["mask"].to_numpy(), counts["n"].to_numpy()
    steps = removal_steps(masks, orders)
    at = steps + np.arange(len(orders)) * (k + 1)
    scatter = lambda w: np.bincount(at.ravel(), np.repeat(w, len(orders)).astype(float), len(orders) * (k + 1)).reshape(len(orders), k + 1)[:, :k].round().astype(np.int64)
    removed = scatter(n)
    # failing[mask, order, step]: the mask fails the filter of that step
    failing = ((masks[:, None] >> np.arange(k)) & 1)[:, orders] == 1
    redundant = (n[:, None, None] * (failing & (steps[:, :, None] < np.arange(k)))).sum(0)
    alone = np.array([n[masks == 1 << f].sum() for f in range(k)])
    by_filter = np.bincount(orders.ravel(), removed.ravel().astype(float), k).round().astype(np.int64)
    return pd.DataFrame({
        "filter_order": np.repeat(["".join(names[f] for f in o) for o in orders], k), "step": np.tile(np.arange(1, k + 1), len(orders)).astype(np.int32),
        "kept": (n.sum() - removed.cumsum(1)).ravel(), "removed": removed.ravel(), "redundant": redundant.ravel(), "unique_fails": alone[orders].ravel(),
        "good_lost": scatter(n * counts["good"].to_numpy()).ravel(), "toxic_lost": scatter(n * counts["toxic"].to_numpy()).ravel(), "shapley": by_filter[orders].ravel()})


def audit(counts: DataFrame, names: str) -> DataFrame:
    """All orders of the filters `names` (one letter a bit) over mask_counts: a row for each part, order and step."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = audited(pdf, names)
        out.insert(0, "part", pdf["part"].iloc[0])
        return out
    return counts.groupBy("part").applyInPandas(run, "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in COUNTS))


ORACLE = f"""
WITH d AS (SELECT doc_id, coalesce(lang, '') part, coalesce(text, '') t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') w FROM documents),
firsts AS (SELECT t, min(doc_id) f FROM d GROUP BY t),
says AS (SELECT doc_id, max(quality = 1) g, max(toxic = 1) x FROM labels GROUP BY doc_id),
facts AS (SELECT part, coalesce(g, false) g, coalesce(x, false) x, [len(w) < 200, 100 * len(list_distinct(w)) < 50 * len(w), 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 3 * length(t), regexp_matches(t, '[{SYMBOLS.replace("|", "")}|]'),
  coalesce(d.doc_id > f, false)] fails FROM d JOIN firsts USING (t) LEFT JOIN says USING (doc_id)),
counts AS MATERIALIZED (SELECT part, g, x, fails, count(*)::BIGINT n FROM facts GROUP BY ALL),
filters AS (SELECT unnest([1, 2, 3, 4, 5]) i),
orders AS MATERIALIZED (SELECT [a.i, b.i, c.i, d.i, e.i] o FROM filters a, filters b, filters c, filters d, filters e WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5),
gone AS MATERIALIZED (SELECT part, o, g, x, fails, n, coalesce(list_min(list_filter(range(1, 6), lambda s: fails[o[s]])), 9) s FROM counts, orders),
steps AS (SELECT part, o, k step, sum(CASE WHEN s > k THEN n ELSE 0 END)::BIGINT kept, sum(CASE WHEN s = k THEN n ELSE 0 END)::BIGINT removed, sum(CASE WHEN s < k AND fails[o[k]] THEN n ELSE 0 END)::BIGINT redundant,
  sum(CASE WHEN fails[o[k]] AND len(list_filter(fails, lambda v: v)) = 1 THEN n ELSE 0 END)::BIGINT unique_fails, sum(CASE WHEN s = k AND g THEN n ELSE 0 END)::BIGINT good_lost, sum(CASE WHEN s = k AND x THEN n ELSE 0 END)::BIGINT toxic_lost
  FROM gone, (SELECT unnest([1, 2, 3, 4, 5]) k) GROUP BY part, o, k)
SELECT part, array_to_string(list_transform(o, lambda f: 'ABCDE'[f]), '') filter_order, step::INTEGER step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, sum(removed) OVER (PARTITION BY part, o[step])::BIGINT shapley FROM steps
"""


@query("op12_filter_audit", ORACLE)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return audit(mask_counts(docs, table(spark, sf_dir, "labels"), failures(F.col("text")), FILTERS), FILTERS)
