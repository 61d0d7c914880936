"""Knowledge-base metadata, versions and status changes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import params as P
from ..functions import ordered as O
from ..functions import text as X
from . import retrieval as V
from .rules import rule_drafts
from .structure import split_policy, split_template


def kb_clause_dedupe(kb: DataFrame) -> DataFrame:
    k = kb.withColumn("_t", F.coalesce("template_id", F.lit("")))
    order = ["page_start", F.coalesce("clause_no", F.lit("")), "clause_id"]
    return O.first_by(k, ["document_id", "_t", "title", "page_start", "page_end"], order[1:]).drop("_t")


def rule_dedupe(rules: DataFrame, keep: str = "first") -> DataFrame:
    r = rules.withColumn("_s", F.coalesce("source_document_id", F.lit("")))
    return O.first_by(r, ["rule_id", "_s"], ["written" if keep == "first" else -F.col("written")]).drop("_s")


def document_metadata(docs: DataFrame, kb: DataFrame, rules: DataFrame, catalog: DataFrame | None = None) -> DataFrame:
    c = kb_clause_dedupe(kb).groupBy("document_id").agg(F.count(F.lit(1)).alias("clause_count"), F.count_if(F.col("status").isin(P.LIVE_STATUSES)).alias("effective_clause_count"))
    r = rule_dedupe(rules).groupBy(F.col("source_document_id").alias("document_id")).agg(F.count(F.lit(1)).alias("rule_count"), F.count_if("enabled").alias("enabled_rule_count"))
    out = docs.join(c, "document_id", "left").join(r, "document_id", "left")
    cols = ["clause_count", "effective_clause_count", "rule_count", "enabled_rule_count"]
    if catalog is not None:
        out = out.join(catalog.groupBy("document_id").agg(F.count(F.lit(1)).alias("template_count")), "document_id", "left")
        cols.append("template_count")
    return out.na.fill(0, cols)


def document_clauses(kb: DataFrame, chars: int | None = None) -> DataFrame:
    out = kb_clause_dedupe(kb)
    return out if chars is None else out.withColumn("content", F.substring("content", 1, chars))


def clause_metadata(kb: DataFrame, docs: DataFrame, rules: DataFrame) -> DataFrame:
    """Clause with its document, linked rules (ordered) and category path.  rules: rule_id, source_document_id, written, basis_policy."""
    links = rule_dedupe(rules).select(F.explode(F.array_distinct("basis_policy")).alias("clause_id"), "rule_id")
    g = links.groupBy("clause_id").agg(F.count(F.lit(1)).alias("linked_rule_count"), F.array_join(F.array_sort(F.collect_set("rule_id")), "|").alias("linked_rules"))
    d = docs.select("document_id", F.col("name").alias("document_name"), F.col("status").alias("document_status"))
    j = kb.join(d, "document_id", "left").join(g, "clause_id", "left")
    path = F.concat_ws(" / ", F.nullif("category_lv1", F.lit("")), F.nullif("category_lv2", F.lit("")))
    return j.withColumn("category_path", path).withColumn("linked_rule_count", F.coalesce("linked_rule_count", F.lit(0)))


def rule_metadata(rules: DataFrame, docs: DataFrame, kb: DataFrame) -> DataFrame:
    """Rule with its source document and its existing source clauses in order."""
    key = ["rule_id", "source_document_id"]
    e = rules.select(*key, F.posexplode("basis_policy").alias("pos", "clause_id")).join(kb.select("clause_id", F.col("title").alias("t")), "clause_id")
    s = F.array_sort(F.collect_list(F.struct("pos", "clause_id", "t")))
    g = e.groupBy(*key).agg(s.alias("s")).select(*key, F.size("s").alias("source_clause_count"), F.transform("s", lambda x: x["clause_id"]).alias("source_clause_ids"))
    d = docs.select(F.col("document_id").alias("source_document_id"), F.col("name").alias("source_document_name"))
    return rules.join(g, key, "left").join(d, "source_document_id", "left").withColumn("source_clause_count", F.coalesce("source_clause_count", F.lit(0)))


def version_context(docs: DataFrame) -> DataFrame:
    """Position in the series of equal name and type (newest first), documents I replaced, my successor.

    A series is summarised by its distinct effective dates; positions come from
    counts per date, so a very long series is not sorted in one task.
    """
    series = ["name", "doc_type"]
    pos = O.numbered(docs, series, [-F.col("effective_ts"), -F.col("created_at"), "document_id"], "series_pos", -F.col("effective_ts"))
    n = docs.groupBy(*series).agg(F.count(F.lit(1)).alias("series_size"))
    mine = docs.select(F.col("replaced_by").alias("document_id"), *[F.col(c).alias(f"_{c}") for c in series], F.col("document_id").alias("prev"), F.col("effective_ts").alias("_e"), F.col("created_at").alias("_c")).where(F.col("document_id").isNotNull())
    j = pos.join(n, series)
    prev = j.select("document_id", *series).join(mine, "document_id").where((F.col("name") == F.col("_name")) & (F.col("doc_type") == F.col("_doc_type")))
    prev = prev.groupBy("document_id").agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("_e")).alias("e"), (-F.col("_c")).alias("c"), "prev"))), lambda s: s["prev"]).alias("previous_versions"))
    nxt = docs.select(F.col("document_id").alias("next_version"))
    return j.join(prev, "document_id", "left").join(nxt, F.col("replaced_by") == F.col("next_version"), "left")


def enrich_catalog(catalog: DataFrame, kb: DataFrame) -> DataFrame:
    """Clause count, first four distinct titles, signature and usage profile text of each catalogue entry."""
    k = kb.where(F.col("template_id").isNotNull())
    n = k.groupBy("template_id").agg(F.count(F.lit(1)).alias("clause_count"))
    titled = k.withColumn("_t", X.strip("title")).where(F.col("_t") != "")
    firsts = titled.groupBy("template_id", "_t").agg(F.min(F.struct("page_start", F.coalesce("clause_no", F.lit("")).alias("no"), "_t")).alias("o"))
    lead = O.top_k(firsts, ["template_id"], ["o"], 4, "_r").groupBy("template_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("_r", "_t"))), lambda s: s["_t"]).alias("key_titles"))
    u = V.usage_profile(k)
    j = catalog.join(n, "template_id", "left").join(lead, "template_id", "left").join(u, "template_id", "left")
    titles = F.coalesce("key_titles", F.array().cast("array<string>"))
    sig = F.when(F.size(titles) > 0, F.array_join(F.slice(titles, 1, 3), " / ")).otherwise(F.format_string("第 %d-%d 页", "start_page", "end_page"))
    basis = F.coalesce("usage_basis", F.array().cast("array<string>"))
    text = F.when(F.col("usage_profile").isNotNull() & (F.size(basis) > 0), F.concat("usage_profile", F.lit("（依据："), F.array_join(F.slice(basis, 1, 3), " / "), F.lit("）"))).otherwise(F.col("usage_profile"))
    return j.withColumn("clause_count", F.coalesce("clause_count", F.lit(0))).withColumn("key_titles", titles).withColumn("signature", sig).withColumn("usage_summary", text)


def same_name_variants(catalog: DataFrame) -> DataFrame:
    """Among equal names: index, total and the titles no sibling has (three at most), else the first two titles.

    A title is a cue when it occurs once per name; counting (name, title) pairs
    replaces comparing siblings with each other.
    """
    key = ["document_id", "template_name"]
    n = catalog.groupBy(*key).agg(F.count(F.lit(1)).alias("same_name_total"))
    c = O.numbered(catalog, key, ["start_page", "end_page", "template_id"], "same_name_index", F.floor(F.col("start_page") / 64)).join(n, key)
    t = c.select(*key, "template_id", F.posexplode(F.array_distinct("key_titles")).alias("pos", "title"))
    once = t.groupBy(*key, "title").agg(F.count(F.lit(1)).alias("k"), F.min("pos").alias("pos"), F.min("template_id").alias("template_id")).where((F.col("k") == 1) & (F.col("title") != ""))
    cues = once.groupBy(*key, "template_id").agg(F.slice(F.transform(F.array_sort(F.collect_list(F.struct("pos", "title"))), lambda s: s["title"]), 1, 3).alias("cues"))
    j = c.where(F.col("same_name_total") > 1).join(cues, [*key, "template_id"], "left")
    cue = F.when(F.size("cues") > 0, F.col("cues")).otherwise(F.slice("key_titles", 1, 2))
    return j.select(*key, "template_id", "same_name_index", "same_name_total", F.format_string("同名模板 %d/%d · 第 %d-%d 页", "same_name_index", "same_name_total", "start_page", "end_page").alias("label"), cue.alias("variant_cues"))


def abolish_documents(docs: DataFrame, kb: DataFrame, requests: DataFrame, today: int) -> tuple[DataFrame, DataFrame]:
    """requests: document_id, abolish_ts (null = today).  Returns new documents and clauses."""
    r = requests.select("document_id", F.coalesce("abolish_ts", F.lit(today)).cast("long").alias("_ts"))
    hit = F.col("_ts").isNotNull()
    d = docs.join(r, "document_id", "left")
    d = d.withColumn("status", F.when(hit, "abolished").otherwise(F.col("status"))).withColumn("abolish_ts", F.coalesce("_ts", "abolish_ts")).withColumn("current_version", F.when(hit, False).otherwise(F.col("current_version"))).drop("_ts")
    return d, cascade(kb, r.withColumn("_status", F.lit("abolished")))


def cascade(kb: DataFrame, changes: DataFrame) -> DataFrame:
    """Status and end date of the clauses of changed documents."""
    k = kb.join(changes.select("document_id", "_status", "_ts"), "document_id", "left")
    return k.withColumn("status", F.coalesce("_status", "status")).withColumn("abolish_ts", F.coalesce("_ts", "abolish_ts")).drop("_status", "_ts")


def replace_documents(docs: DataFrame, kb: DataFrame, requests: DataFrame, today: int) -> tuple[DataFrame, DataFrame]:
    """requests: old_id, new_id."""
    old = requests.groupBy(F.col("old_id").alias("document_id")).agg(F.max("new_id").alias("_by"))
    new = requests.select(F.col("new_id").alias("document_id"), F.lit(True).alias("_new")).distinct()
    d = docs.join(old, "document_id", "left").join(new, "document_id", "left")
    gone = F.col("_by").isNotNull()
    d = d.withColumn("status", F.when(gone, "superseded").otherwise(F.col("status"))).withColumn("replaced_by", F.coalesce("_by", "replaced_by"))
    d = d.withColumn("current_version", F.when(F.col("_new"), True).when(gone, False).otherwise(F.col("current_version"))).drop("_by", "_new")
    return d, cascade(kb, old.select("document_id", F.lit("superseded").alias("_status"), F.lit(today).cast("long").alias("_ts")))


def patch_status(docs: DataFrame, kb: DataFrame, requests: DataFrame, today: int) -> tuple[DataFrame, DataFrame]:
    """requests: document_id, status.  Only terminal states cascade."""
    r = requests.select("document_id", F.col("status").alias("_status"))
    d = docs.join(r, "document_id", "left").withColumn("status", F.coalesce("_status", "status")).drop("_status")
    return d, cascade(kb, r.where(F.col("_status").isin(P.TERMINAL_STATUSES)).withColumn("_ts", F.lit(today).cast("long")))


def ingest_policies(docs: DataFrame, dim: int = 1536) -> tuple[DataFrame, DataFrame]:
    """Policy documents -> clauses with vectors, and rule drafts.  docs: document_id, text, effective_ts."""
    dates = docs.select("document_id", "effective_ts")
    c = split_policy(docs).join(dates, "document_id")
    c = c.withColumn("clause_id", F.concat(F.lit("clause_"), F.substring(F.sha2(F.concat_ws("|", "document_id", "part_no", "article_no"), 256), 1, 16)))
    c = c.withColumn("status", F.lit("effective")).withColumn("abolish_ts", F.lit(P.OPEN_END).cast("long")).withColumn("page_start", F.lit(1).cast("long")).withColumn("block_no", F.col("part_no") * 100000 + F.col("article_no"))
    return c.withColumn("vector", X.hash_embedding(X.joined("title", "content"), dim)), rule_drafts(c)


def ingest_templates(texts: DataFrame, dim: int = 1536) -> DataFrame:
    """Template texts -> clauses with vectors.  texts: document_id, template_id, template_name, text, category_lv1/2, page_start, page_end, effective_ts."""
    info = texts.select("document_id", "template_id", "category_lv1", "category_lv2", "page_start", "page_end", "effective_ts")
    c = split_template(texts).join(info, ["document_id", "template_id"])
    c = c.withColumn("clause_id", F.concat(F.lit("clause_"), F.substring(F.sha2(F.concat_ws("|", "document_id", "template_id", "clause_no"), 256), 1, 16)))
    c = c.withColumn("status", F.lit("effective")).withColumn("abolish_ts", F.lit(P.OPEN_END).cast("long"))
    return c.withColumn("vector", X.hash_embedding(X.joined("title", "content"), dim))
