"""Document fingerprints by I-Match, with DataFrame operations only.

Lexicon.  Terms are lower-cased words without punctuation, each as a 64-bit hash.  The lexicon holds the terms that stand in LOW to HIGH
of all documents with a term (inverse document frequency ln(1 / HIGH) to ln(1 / LOW)).  Its size is bounded whatever the number of
documents: each of its terms stands in a share LOW of them, so it has at most (mean distinct terms of a document) / LOW terms.  It is
passed to the tasks as one hash table (an array of cells) by a scalar subquery.

Fingerprint.  A text keeps its distinct terms that are in the lexicon (all its terms, if none is), sorted.  REPLICAS random halvings of
the lexicon, repeated LEVELS times, give nested lexicon subsets of shares 1, 1/2, 1/4, ...; the fingerprint is the hash of the terms that
each subset keeps, and nothing where it keeps none.  Large subsets tell equal texts, small ones survive edits.

Likeness of two fingerprints: the share of equal hashes among the subsets that keep a term of either text, counted over the coarsest
level where the subsets are about used up (the last one at which half the replicas keep a term) and all finer ones.  It is 1 for equal
fingerprints, two texts without terms among them, and 0 if one text alone has no term.

Neighbours.  `chained` gives each row the next one by descending id without a global window: cuts by range (their number is a multiple of
the shuffle partitions) deal the rows to buckets, and the top row of each bucket is copied into the one above, so texts are shuffled once.

Null texts are empty; rows that repeat an id follow each other by the hash of their text; rows without id are fingerprinted but stand
outside the order: nothing replaces their cut end, and near_next is 0.  An empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import let, query, staged, table

LOW, HIGH = 0.002, 0.05
REPLICAS, LEVELS = 16, 12
#: Buckets of the order for each shuffle partition.
BUCKETS = 4
#: Cells of the hash table for each term of the lexicon, about.
SPARSE = 2

BREAKS = "\t\n\x0b\x0c\r!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def terms(text: Column) -> Column:
    """Distinct hashes of the words of a text."""
    words = F.array_remove(F.split(F.translate(F.lower(text), BREAKS, " " * len(BREAKS)), " "), "")
    return F.array_distinct(F.transform(words, lambda w: F.xxhash64(w)))


def lexicon(docs: DataFrame, text: str = "text", low: float = LOW, high: float = HIGH) -> DataFrame:
    """(term, n): hashes of the terms that stand in n documents, a share of low to high of those with a term (two at least, if there are two)."""
    own = docs.select(terms(F.coalesce(F.col(text), F.lit(""))).alias("terms")).where(F.size("terms") > 0)
    # the count of documents travels as one more term, so the texts are read once
    counted = staged(own.select(F.explode(F.concat(F.array(F.lit(None).cast("long")), "terms")).alias("term")).groupBy("term").agg(F.count("*").alias("n")), "terms")
    total = F.coalesce(counted.where("term is null").agg(F.max("n").alias("n")).scalar(), F.lit(0))
    return counted.where(F.col("term").isNotNull() & (F.col("n") >= F.greatest(F.least(F.lit(2), total), low * total)) & (F.col("n") <= F.greatest(F.lit(2), high * total)))


def cells(lex: DataFrame) -> DataFrame:
    """One row with the lexicon as a hash table: cell number h modulo the number of cells holds the terms of that remainder.  Bounded as the lexicon is."""
    lex = staged(lex.select("term"), "lexicon")
    size = lex.agg(F.greatest(F.lit(1).cast("long"), SPARSE * F.count("*")).alias("m"))
    placed = lex.select("term", F.pmod("term", size.scalar()).alias("cell")).groupBy("cell").agg(F.collect_list("term").alias("terms"))
    every = size.select(F.explode(F.sequence(F.lit(0).cast("long"), F.col("m") - 1)).alias("cell"))
    rows = every.join(placed, "cell", "left").select(F.struct("cell", F.coalesce("terms", F.array().cast("array<long>")).alias("terms")).alias("r"))
    return staged(rows.agg(F.sort_array(F.collect_list("r")).alias("r")).select(F.col("r.terms").alias("cells")), "cells")


def subsets(own: Column, table: Column, replicas: int, levels: int) -> Column:
    """The fingerprint of a text's distinct terms as an array of hashes, level by level and replica by replica; null where a subset keeps no term."""
    kept = let(F.filter(own, lambda h: F.array_contains(F.get(table, F.pmod(h, F.size(table)).cast("int")), h)), lambda k: F.sort_array(F.when(F.size(k) > 0, k).otherwise(own)))

    def nested(k: Column, r: int) -> Column:
        # bit l of a term's hash by replica decides whether it goes on to level l + 1
        step = lambda a, l: let(F.filter(a["s"], lambda h: F.getbit(F.xxhash64(h, F.lit(r)), l) == 0), lambda s: F.struct(
            s.alias("s"), F.array_append(a["out"], F.when(F.size(s) > 0, F.xxhash64(s))).alias("out")))
        first = F.struct(k.alias("s"), F.array(F.when(F.size(k) > 0, F.xxhash64(k))).alias("out"))
        return F.aggregate(F.sequence(F.lit(0), F.lit(levels - 2)), first, step, lambda a: a["out"])

    by_replica = let(kept, lambda k: F.array(*[nested(k, r) for r in range(replicas)]))
    return let(by_replica, lambda x: F.flatten(F.transform(F.sequence(F.lit(0), F.lit(levels - 1)), lambda l: F.transform(x, lambda y: F.get(y, l)))))


def likeness(a: Column, b: Column, replicas: int = REPLICAS, levels: int = LEVELS) -> Column:
    """0 to 1 for two fingerprints, see the head of this module."""
    pairs = F.zip_with(a, b, lambda x, y: F.when(x == y, F.lit(2)).when(x.isNotNull() | y.isNotNull(), F.lit(1)).otherwise(F.lit(0)))
    count = lambda x, least: F.size(F.filter(x, lambda v: v >= least))
    level = lambda p, l: F.slice(p, l * replicas + 1, replicas)

    def share(p: Column) -> Column:
        last = F.array_max(F.transform(F.sequence(F.lit(0), F.lit(levels - 1)), lambda l: F.when(2 * count(level(p, l), 1) >= replicas, l).otherwise(F.lit(0))))
        return let(let(last, lambda l: F.slice(p, l * replicas + 1, replicas * levels)), lambda q: F.when(count(q, 1) == 0, F.lit(1.0)).otherwise(count(q, 2) / count(q, 1)))

    return let(pairs, share)


def named(fingerprint: Column) -> Column:
    """A fingerprint as a string."""
    return F.array_join(F.transform(fingerprint, lambda h: F.coalesce(F.lower(F.hex(h)), F.lit(""))), ",")


def fingerprints(docs: DataFrame, text: str = "text", out: str = "fingerprint", low: float = LOW, high: float = HIGH, replicas: int = REPLICAS, levels: int = LEVELS, lex: DataFrame | None = None) -> DataFrame:
    """docs with their fingerprint, an array of replicas * levels hashes; lex is the row of cells(), by default that of docs."""
    lex = cells(lexicon(docs, text, low, high)) if lex is None else lex
    mine = [c for c in docs.columns if c != out]
    held = docs.select(F.struct(*mine).alias("row"), F.col(text).alias("t"), lex.scalar().alias("cells"))
    return held.select("row.*", subsets(terms(F.coalesce("t", F.lit(""))), F.col("cells"), replicas, levels).alias(out))


def chained(docs: DataFrame, doc_id: str, text: str, also: list[str], out: str = "next") -> DataFrame:
    """docs with `out`, a struct of `also` and text of the row that follows by descending id (after the last one: the first).  Null for rows without id."""
    key = F.struct(F.col(doc_id).alias("id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("h"))
    buckets = BUCKETS * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = docs.where(F.col(doc_id).isNotNull()).select(key.alias("key")).select("key.*").repartitionByRange(buckets, "id", "h")
    ranges = keys.groupBy(F.spark_partition_id().alias("at")).agg(F.min(F.struct("id", "h")).alias("lo"), F.max(F.struct("id", "h")).alias("hi"))
    # at most `buckets` entries, in ascending order
    cuts = staged(ranges.agg(F.sort_array(F.collect_list(F.struct("lo", "hi"))).alias("cuts")), "cuts")
    mine = [c for c in docs.columns if c != out]
    dealt = docs.select(F.struct(*mine).alias("row"), key.alias("key"), cuts.scalar().alias("cuts"))

    def placed(c: Column, k: Column) -> Column:
        """(bucket, copy): a binary search for the last cut that is not above k; the top row of a bucket goes to the next bucket as well."""
        steps = F.sequence(F.lit(1), F.lit(max(1, buckets.bit_length())))
        found = F.aggregate(steps, F.struct(F.lit(0).alias("lo"), F.size(c).alias("hi")), lambda a, _: let(((a["lo"] + a["hi"]) / 2).cast("int"), lambda m: F.when(
            a["hi"] - a["lo"] <= 1, a).when(F.get(c, m)["lo"] <= k, F.struct(m.alias("lo"), a["hi"].alias("hi"))).otherwise(F.struct(a["lo"].alias("lo"), m.alias("hi")))), lambda a: a["lo"])
        own = lambda b: F.struct(b.alias("bucket"), F.lit(False).alias("copy"))
        return let(found, lambda b: F.when(F.get(c, b)["hi"] == k, F.array(own(b), F.struct(((b + 1) % F.size(c)).alias("bucket"), F.lit(True).alias("copy")))).otherwise(F.array(own(b))))

    with_id = dealt.where("key.id is not null").select("row", "key", F.explode(placed(F.col("cuts"), F.col("key"))).alias("at")).select("row", "key", "at.*")
    order = Window.partitionBy("bucket").orderBy("copy", F.desc("key"))
    follows = F.struct(*[F.col("row")[c].alias(c) for c in also], F.coalesce(F.col("row")[text], F.lit("")).alias(text))
    with_id = with_id.withColumn("next", F.lead(follows).over(order)).where("not copy").select("row.*", F.col("next").alias(out))
    return with_id.union(docs.where(F.col(doc_id).isNull()).select(*mine, F.lit(None).cast(dict(with_id.dtypes)[out]).alias(out)))


@query("op13_imatch")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    lex = cells(lexicon(docs))
    own = chained(fingerprints(docs, lex=lex), "doc_id", "text", ["fingerprint"])
    t = F.coalesce(F.col("text"), F.lit(""))
    cut = F.floor(F.col("n_chars") / 3).cast("int")
    own = own.withColumn("n_chars", F.length(t).cast("long"))
    edited = own.withColumn("edited", F.concat(F.substring(t, F.lit(1), F.col("n_chars").cast("int") - cut), F.substring(F.coalesce(F.col("next.text"), F.lit("")), F.lit(1), cut)))
    out = fingerprints(edited, "edited", "edited_fingerprint", lex=lex)
    return out.select("doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), named(F.col("fingerprint")).alias("fingerprint"), named(F.col("edited_fingerprint")).alias("edited_fingerprint"),
                      likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"), F.coalesce(likeness(F.col("fingerprint"), F.col("next.fingerprint")), F.lit(0.0)).alias("near_next"))
