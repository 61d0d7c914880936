"""Domain tables derived from the driver tables.

Every document plays every part once: it is a contract (task), and by language
it is a policy (``en``) or a template (all other languages) of the knowledge
base.  Chinese heading marks and clause words are added to each line by
position so that the default dictionaries have something to find.  Rows are
never dropped and lines are never cut.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import params as P
from ..functions import text as X
from ..session import stage

NUMERALS = ["一", "二", "三", "四", "五", "六", "七", "八", "九", "十"]
# block_no % 7 -> (core label, words added to the line)
SUFFIXES = [
    ("其他重要条款", ""),
    ("付款条件", " 付款比例按验收节点支付"),
    ("验收标准", " 验收标准以交付成果为准"),
    ("违约责任", " 乙方违约应赔偿逾期责任"),
    ("争议解决", " 争议由仲裁或法院协商解决，乙方所在地"),
    ("账户信息", " 开户行账号见附件一，合同编号：HT-"),
    ("合同金额", " 合同金额人民币"),
]


_PLANS: dict = {}


def memo(fn):
    """Build the plan of a table once per session and folder.  Only the plan is kept, never data."""
    @functools.wraps(fn)
    def wrapper(spark, sf_dir):
        key = (fn.__module__, fn.__name__, id(spark._jsparkSession), spark.sparkContext.applicationId, sf_dir)
        if key not in _PLANS:
            _PLANS[key] = fn(spark, sf_dir)
        return _PLANS[key]
    return wrapper


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@memo
def corpus(spark, sf_dir) -> DataFrame:
    """The documents, spread over all cores when the scan would keep some of them idle.

    A row group is read by one task, whatever the splits: a file of a few large row groups has splits for all cores and
    rows in a few of them.  So the rows of each split are counted (one narrow column), and only an uneven scan is dealt out by id.
    It is written so: a query reads the documents several times, and each reading would deal all texts out again.
    """
    d = load(spark, sf_dir, "documents")
    n = spark.sparkContext.defaultParallelism
    rows = [r["count"] for r in d.select(F.spark_partition_id().alias("p"), "doc_id").groupBy("p").count().collect()]  # a number a split
    even = len(rows) >= n and max(rows) * n <= 2 * sum(rows)
    return d if even else stage(d.repartition(max(n, d.rdd.getNumPartitions()), "doc_id"))


def decorated_lines(doc_id: Column, text: Column) -> Column:
    """Array of decorated lines of one document, in order (position + 1 = block_no)."""
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    numerals, words = F.array(*map(F.lit, NUMERALS)), F.array(*[F.lit(s) for _, s in SUFFIXES])

    def decorate(line, i):
        n = i + 1
        prefix = (
            F.when(n % 5 == 1, F.concat(F.lit("第"), F.get(numerals, F.floor(n / 5).cast("int") % 10), F.lit("章 ")))
            .when((n % 5).isin(2, 4), F.concat(F.lit("第"), F.get(numerals, n % 10), F.lit("条 ")))
            .otherwise("")
        )
        tail = (
            F.when(n % 7 == 5, (F.lit(20240000) + doc_id).cast("string"))
            .when(n % 7 == 6, F.concat((F.lit(10000) + doc_id * 7 + n).cast("string"), F.lit("元")))
            .otherwise("")
        )
        return F.concat(prefix, line, F.get(words, n % 7), tail)

    return F.transform(lines, decorate)


@memo
def documents(spark, sf_dir) -> DataFrame:
    d = corpus(spark, sf_dir)
    return d.select(
        "doc_id", "lang", "source", "text",
        F.concat(F.lit("task_"), "doc_id").alias("task_id"),
        F.concat(F.lit("doc_"), "doc_id").alias("document_id"),
        F.concat("source", F.lit("_"), "doc_id", F.lit("."), "lang").alias("file_name"),
        F.when(F.col("lang") == "en", "policy").otherwise("template").alias("doc_type"),
    )


@memo
def texts(spark, sf_dir) -> DataFrame:
    """One row per document with its decorated text."""
    d = documents(spark, sf_dir)
    lines = decorated_lines(F.col("doc_id"), F.col("text"))
    return d.withColumn("text", F.array_join(lines, "\n"))


@memo
def blocks(spark, sf_dir) -> DataFrame:
    d = corpus(spark, sf_dir).select("doc_id", "text")
    b = d.select("doc_id", F.posexplode(decorated_lines(F.col("doc_id"), F.col("text"))).alias("pos", "text"))
    n, length = F.col("block_no"), F.length("text").cast("long")
    b = b.select("doc_id", (F.col("pos") + 1).cast("long").alias("block_no"), "text")
    return b.select(
        "doc_id",
        F.concat(F.lit("task_"), "doc_id").alias("task_id"),
        F.concat(F.lit("b_"), "doc_id", F.lit("_"), "block_no").alias("block_id"),
        "block_no",
        (F.floor((n - 1) / 4) + 1).alias("page"),
        "text",
        (40 + 30 * (length % 3)).alias("x"),
        (60 + 52 * ((n - 1) % 4) + 6 * (length % 5)).alias("y"),
        F.least(F.lit(900), 12 * length).cast("long").alias("width"),
        F.lit(24).cast("long").alias("height"),
        F.round(0.70 + (length % 30) / 100, 2).alias("score"),
        F.get(F.array(*[F.lit(c) for c, _ in SUFFIXES]), (n % 7).cast("int")).alias("core_label"),
    )


@memo
def clauses(spark, sf_dir) -> DataFrame:
    """Tagged clauses: every line that carries clause words."""
    b = blocks(spark, sf_dir).where(F.col("core_label") != P.DEFAULT_LABEL)
    length = F.length("text").cast("long")
    return b.select(
        "doc_id", "task_id",
        F.concat(F.lit("c_"), "doc_id", F.lit("_"), "block_no").alias("clause_id"),
        F.col("core_label").alias("label"), "core_label",
        F.get(F.array(F.lit("core"), F.lit("user_configured"), F.lit("agent_discovered")), (F.col("block_no") % 3).cast("int")).alias("label_source"),
        F.col("core_label").alias("title"),
        X.compact_summary("text", None).alias("summary"),
        F.col("text").alias("raw_text"),
        "page",
        F.round(0.50 + (length % 50) / 100, 2).alias("confidence"),
        F.col("block_no").alias("sort_order"),
        (length % 4 == 0).alias("need_review"),
        "block_id",
    )


@memo
def key_facts(spark, sf_dir) -> DataFrame:
    c = clauses(spark, sf_dir)
    return c.select(
        "doc_id", "task_id", F.regexp_replace("clause_id", "^c_", "f_").alias("fact_id"), "label",
        F.when(F.col("sort_order") % 5 == 0, "").otherwise(X.compact_summary("raw_text", None)).alias("value"),
        "page", "confidence", "sort_order", "block_id",
    )


@memo
def kb_documents(spark, sf_dir) -> DataFrame:
    d = load(spark, sf_dir, "documents")
    i = F.col("doc_id")
    return d.select(
        "doc_id", F.concat(F.lit("doc_"), "doc_id").alias("document_id"),
        F.col("source").alias("name"),
        F.when(F.col("lang") == "en", "policy").otherwise("template").alias("doc_type"),
        F.when(i % 11 == 0, "abolished").when(i % 13 == 0, "superseded").when(i % 4 == 0, "partially_effective").otherwise("effective").alias("status"),
        (20200101 + 10000 * (i % 5)).alias("effective_ts"),
        F.when(i % 7 == 0, F.lit(20230101)).otherwise(F.lit(P.OPEN_END)).cast("long").alias("abolish_ts"),
        F.when(i % 13 == 0, F.concat(F.lit("doc_"), i + 60)).alias("replaced_by"),
        (i % 13 != 0).alias("current_version"),
        (F.lit(1704067200) + i * 60).alias("created_at"),
        F.sha2("text", 256).alias("file_hash"),
    )


@memo
def kb_clauses(spark, sf_dir) -> DataFrame:
    """Knowledge-base clauses: one per line, dated by its document."""
    b = blocks(spark, sf_dir)
    docs = kb_documents(spark, sf_dir).select("doc_id", "document_id", "doc_type", "name", "status", "effective_ts", "abolish_ts")
    k = b.join(docs, "doc_id")
    tpl = F.col("doc_type") == "template"
    mark = F.regexp_extract("text", "^(第[^ ]+ )?", 1)
    title = F.concat(mark, "core_label")
    cats = F.array(*[F.lit(x) for x in [*P.CATEGORY_KEYWORDS, P.DEFAULT_CATEGORY]])
    names = F.array(*[F.lit(x) for x in ["技术服务合同", "第三方审计合同", "工程勘察合同", "检测委托合同", "仓储合同"]])
    return k.select(
        "doc_id", F.concat(F.lit("kc_"), "doc_id", F.lit("_"), "block_no").alias("clause_id"), "document_id", "doc_type",
        F.when(tpl, F.concat(F.lit("tpl_"), "doc_id")).alias("template_id"),
        F.when(tpl, F.get(names, (F.col("doc_id") % 5).cast("int"))).alias("template_name"),
        F.when(tpl, F.get(cats, (F.col("doc_id") % 6).cast("int"))).otherwise(F.lit(P.DEFAULT_CHAPTER)).alias("category_lv1"),
        F.when(tpl & (F.col("doc_id") % 2 == 0), F.lit("工程勘察设计合同")).alias("category_lv2"),
        F.col("block_no").cast("string").alias("clause_no"),
        title.alias("title"),
        X.clause_type(title, F.col("text")).alias("clause_type"),
        F.col("text").alias("content"),
        F.col("page").alias("page_start"), F.col("page").alias("page_end"),
        "status", "effective_ts", "abolish_ts", "core_label", "block_no",
    )
