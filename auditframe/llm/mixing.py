"""Mixing sources to target weights: hierarchical budgeting, with DataFrame operations only.

Tree.  Leaves are the distinct paths (domain, language, source) of the documents; every node has an integer weight among its siblings.
A leaf holds its tokens times the number of epochs allowed.  The budget of the root flows down: at each node it is shared among the
children by weight, a child that cannot use its share keeps what it can hold, and what is left over goes to its siblings in the same
proportions; only what all siblings together cannot hold stays unused, which is why a parent is never given more than it can hold.  The
shares have a closed form once siblings are sorted by capacity per weight, so each level is one window over the (small) node table.

Selection.  A leaf with budget b takes all its documents for each full epoch, and in the last epoch the longest prefix, in an order
seeded by epoch, whose tokens stay within the rest.  The order is cut into ranges of about RANGE documents: token sums of ranges give the
range in which the prefix ends, and only the documents of that range are sorted.  A leaf that holds a third of all rows is thus many
small groups.

Null domains, languages and sources are paths of their own; null and empty texts have no tokens and come with the prefix they stand in;
null ids take part (as the text 'null'); rows that repeat an id are told apart by their text.  An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import query, staged, table
from .quality_rules import words_of

LEVELS = ["domain", "lang", "source"]
RANGE = 2048
SEED = 17
#: Share of all tokens that the mixture may have, in thousandths, and the most often a document may be used.
BUDGET_PER_MILLE = 400
EPOCHS = 2


def default_domain(source: Column) -> Column:
    """Sources numbered from 15 on are reference works, all others web pages."""
    return F.when(F.coalesce(F.regexp_extract(source, "([0-9]{1,6})$", 1).try_cast("int"), F.lit(0)) >= 15, "reference").otherwise("web")


#: Weights by level; names that are not listed weigh 1.
WEIGHTS = {"domain": {"web": 3, "reference": 2}, "lang": {"en": 4, "de": 2, "fr": 2}, "source": {}}


def order_key(epoch: Column, doc_id: Column, text: Column, seed: int) -> Column:
    """32 hexadecimal digits that order the documents of an epoch."""
    return F.md5(F.concat_ws(":", F.lit(seed), epoch, F.coalesce(doc_id.cast("string"), F.lit("null")), F.length(text)).cast("binary"))


def weight_of(level: str, weights: dict[str, dict[str, int]]) -> Column:
    out = F.lit(1)
    for name, w in weights.get(level, {}).items():
        out = F.when(F.col(level).eqNullSafe(name), w).otherwise(out)
    return out.cast("double")


def budgets(leaves: DataFrame, budget: int, weights: dict[str, dict[str, int]], levels: list[str] = LEVELS) -> DataFrame:
    """leaves (levels..., capacity as double) with share: tokens given to each leaf."""
    nodes = [leaves.groupBy(*levels[: i + 1]).agg(F.sum("capacity").alias("capacity")) for i in range(len(levels))]
    have = None
    for i, level in enumerate(levels):
        above = levels[:i]
        own = nodes[i].withColumn("w", weight_of(level, weights))
        if have is None:
            own = own.withColumn("given", F.least(F.lit(float(budget)), F.sum("capacity").over(Window.partitionBy(F.lit(1)))))
        else:
            up = have.select(*[F.col(c).alias(f"up_{c}") for c in above], F.col("share").alias("given"))
            on = [F.col(c).eqNullSafe(F.col(f"up_{c}")) for c in above]
            own = own.join(up, on, "inner").select(*own.columns, "given")
        by = Window.partitionBy(*above) if above else Window.partitionBy(F.lit(1))
        sort = [F.col("capacity") / F.col("w"), F.col(level).asc_nulls_first()]
        before = by.orderBy(*sort).rowsBetween(Window.unboundedPreceding, -1)
        after = by.orderBy(*sort).rowsBetween(Window.currentRow, Window.unboundedFollowing)
        own = own.withColumns({"filled": F.coalesce(F.sum("capacity").over(before), F.lit(0.0)), "rest_w": F.sum("w").over(after)})
        own = own.withColumn("full", F.expr("capacity / w <= (given - filled) / rest_w"))
        # siblings that can hold their share have one level in common, that of the first of them
        own = own.withColumn("level_at", F.min(F.expr("case when not full then struct(capacity / w as r, (given - filled) / rest_w as x) end")).over(by))
        have = own.withColumn("share", F.expr("case when full then capacity else w * level_at.x end")).select(*levels[: i + 1], "capacity", "share")
    return have


def mixture(docs: DataFrame, domain: Column | None = None, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source", budget: int | None = None,
            budget_per_mille: int = BUDGET_PER_MILLE, weights: dict[str, dict[str, int]] = WEIGHTS, epochs: int = EPOCHS, seed: int = SEED, size: int = RANGE) -> DataFrame:
    """docs with columns mix_domain, mix_tokens and mix_copies: how often the mixture uses the document (0: not at all)."""
    ready = docs.drop("mix_domain", "mix_tokens", "mix_copies").withColumns({
        "mix_domain": default_domain(F.col(source)) if domain is None else domain, "mix_tokens": F.size(words_of(F.coalesce(F.col(text), F.lit("")))).cast("long")})
    path = {"domain": F.col("mix_domain"), "lang": F.col(lang), "source": F.col(source)}
    key = F.struct(*[path[c].alias(c) for c in LEVELS])
    leaves = staged(ready.groupBy(key.alias("leaf")).agg(F.sum("mix_tokens").alias("tokens"), F.count("*").alias("rows")).select("leaf.*", "tokens", "rows").withColumn("capacity", (F.col("tokens") * epochs).cast("double")), "leaves")
    total = leaves.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("t")).first()["t"]
    shares = budgets(leaves, budget if budget is not None else total * budget_per_mille // 1000, weights)
    shares = shares.select(*[F.col(c).alias(f"s_{c}") for c in LEVELS], F.floor("share").cast("long").alias("share"))
    plan = leaves.join(shares, [F.col(c).eqNullSafe(F.col(f"s_{c}")) for c in LEVELS]).select(*LEVELS, "tokens", "rows", "share")
    plan = plan.withColumns({"full": F.expr("case when tokens > 0 then share div tokens else 0 end")})
    plan = staged(plan.withColumns({"rest": F.expr("share - full * tokens"), "ranges": F.ceil(F.col("rows") / size).cast("long")}), "plan")

    p = plan.select(F.struct(*LEVELS).alias("_mix_leaf_of_plan"), *[F.col(c).alias(f"_mix_{c}") for c in ("full", "rest", "ranges")])
    placed = ready.withColumn("_mix_leaf", key).join(p, F.col("_mix_leaf").eqNullSafe(F.col("_mix_leaf_of_plan"))).drop("_mix_leaf_of_plan")
    placed = placed.withColumn("_mix_order", order_key(F.col("_mix_full"), F.col(doc_id), F.col(text), seed))
    placed = placed.withColumn("_mix_range", F.expr("cast(conv(substr(_mix_order, 1, 8), 16, 10) as bigint) * _mix_ranges div 4294967296"))
    small = staged(placed.select(F.col("_mix_leaf").alias("leaf"), F.col("_mix_range").alias("range"), F.col("_mix_order").alias("order"), F.col("mix_tokens").alias("n"), F.col("_mix_rest").alias("rest")), "orders")
    sums = small.groupBy("leaf", "range", "rest").agg(F.sum("n").alias("n"))
    by = Window.partitionBy("leaf").orderBy("range")
    ends = sums.withColumn("before", F.sum("n").over(by) - F.col("n")).where("before <= rest and before + n > rest").groupBy("leaf").agg(F.min(F.struct("range", "before")).alias("e"))
    ends = staged(ends.select(F.col("leaf").alias("e_leaf"), F.col("e.range").alias("e_range"), F.col("e.before").alias("e_before")), "ends")
    inside = small.join(ends, F.col("leaf").eqNullSafe(F.col("e_leaf")) & (F.col("range") == F.col("e_range")))
    running = F.sum("n").over(Window.partitionBy("e_leaf").orderBy("order").rangeBetween(Window.unboundedPreceding, Window.currentRow))
    cut = inside.withColumn("upto", F.col("e_before") + running).where("upto > rest").groupBy("e_leaf").agg(F.min("order").alias("_mix_cut"))
    cut = staged(cut.withColumnRenamed("e_leaf", "_mix_leaf_of_cut"), "cuts")
    out = placed.join(cut, F.col("_mix_leaf").eqNullSafe(F.col("_mix_leaf_of_cut")), "left")
    # the key starts with the digits that make the range, so a prefix of keys is a prefix of ranges
    last = F.expr("case when _mix_cut is null or _mix_order < _mix_cut then 1 else 0 end")
    copies = F.when(F.col("_mix_rest") == 0, F.col("_mix_full")).otherwise(F.col("_mix_full") + last)
    return out.withColumn("mix_copies", copies.cast("long")).select(*ready.columns, "mix_copies")


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The documents that the mixture uses, with their own columns and mix_copies."""
    return mixture(docs, **options).where("mix_copies > 0").drop("mix_domain", "mix_tokens")


def _level(i: int) -> str:
    level, above = LEVELS[i], LEVELS[:i]
    keys, cols = ", ".join(above), ", ".join(LEVELS[: i + 1])
    part = f"PARTITION BY {keys}" if above else ""
    w = "CASE " + " ".join(f"WHEN {level} = '{k}' THEN {v}.0" for k, v in WEIGHTS[level].items()) + " ELSE 1.0 END" if WEIGHTS[level] else "1.0"
    given = f"(SELECT *, least((SELECT (sum(tokens) * {BUDGET_PER_MILLE}) // 1000 FROM leaves)::DOUBLE, sum(capacity) OVER ()) given FROM a{i})"
    if above:
        given = f"(SELECT a{i}.*, s{i - 1}.share given FROM a{i} JOIN s{i - 1} USING ({keys}))"
    return f"""a{i} AS (SELECT {cols}, sum(capacity) capacity, ({w})::DOUBLE w FROM leaves GROUP BY {cols}),
f{i} AS (SELECT *, coalesce(sum(capacity) OVER ({part} ORDER BY capacity / w, {level} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) filled,
  sum(w) OVER ({part} ORDER BY capacity / w, {level} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) rest_w FROM {given}),
g{i} AS (SELECT *, capacity / w <= (given - filled) / rest_w is_full FROM f{i}),
s{i} AS MATERIALIZED (SELECT {cols}, CASE WHEN is_full THEN capacity ELSE w * (first_value(CASE WHEN NOT is_full THEN (given - filled) / rest_w END IGNORE NULLS)
  OVER ({part} ORDER BY capacity / w, {level} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) END share FROM g{i})"""


ORACLE = f"""
WITH d AS MATERIALIZED (SELECT doc_id, lang, source, text, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT n,
  CASE WHEN coalesce(TRY_CAST(regexp_extract(source, '([0-9]{{1,6}})$', 1) AS INTEGER), 0) >= 15 THEN 'reference' ELSE 'web' END domain FROM documents),
leaves AS MATERIALIZED (SELECT domain, lang, source, sum(n)::BIGINT tokens, (sum(n) * {EPOCHS})::DOUBLE capacity FROM d GROUP BY ALL),
{_level(0)},
{_level(1)},
{_level(2)},
plan AS MATERIALIZED (SELECT domain, lang, source, CASE WHEN tokens > 0 THEN floor(share)::BIGINT // tokens ELSE 0 END f, floor(share)::BIGINT - CASE WHEN tokens > 0 THEN floor(share)::BIGINT // tokens ELSE 0 END * tokens rest
  FROM leaves JOIN s2 USING (domain, lang, source)),
o AS (SELECT doc_id, domain, lang, source, n, f, rest, md5('{SEED}:' || f || ':' || doc_id || ':' || length(text)) k FROM d JOIN plan USING (domain, lang, source)),
r AS (SELECT *, sum(n) OVER (PARTITION BY domain, lang, source ORDER BY k) upto FROM o),
c AS (SELECT *, min(CASE WHEN upto > rest THEN k END) OVER (PARTITION BY domain, lang, source) cut FROM r)
SELECT doc_id, domain, lang, source, n AS n_tokens, (f + CASE WHEN rest > 0 AND (cut IS NULL OR k < cut) THEN 1 ELSE 0 END)::BIGINT copies FROM c
"""


@query("op10_mixing", ORACLE)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixture(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"))
    return out.select("doc_id", F.col("mix_domain").alias("domain"), "lang", "source", F.col("mix_tokens").alias("n_tokens"), F.col("mix_copies").alias("copies"))
