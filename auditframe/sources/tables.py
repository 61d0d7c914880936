"""Readers, ledgers and table maintenance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import ordered as O
from ..functions import text as X
from ..operators.structure import PAGE, page_chunk, page_texts
from ..session import stage

# --- raw files and ledgers --------------------------------------------------


def file_route(name) -> list[Column]:
    suffix = F.lower(F.regexp_extract(name, r"(\.[^./\\]+)$", 1))
    kind = F.when(suffix == ".pdf", "pdf").when(suffix.isin(".png", ".jpg", ".jpeg"), "image").otherwise("unknown")
    pipeline = F.when(kind == "unknown", "unsupported").otherwise(kind)
    return [suffix.alias("suffix"), kind.alias("file_type"), (kind == "image").alias("is_scanned"), pipeline.alias("pipeline")]


def read_raw_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """Uploads with content hash and route; the content column is dropped unless it is used."""
    f = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(path)
    return f.select("path", "length", "modificationTime", F.sha2("content", 256).alias("file_hash"), *file_route("path"), "content")


def route_texts(df: DataFrame, name: str, content: str) -> DataFrame:
    return df.withColumn("file_hash", F.sha2(content, 256)).select("*", *file_route(name))


def skip_processed(inputs: DataFrame, ledger: DataFrame, order: str) -> DataFrame:
    """Plan per input: reuse when the hash is in the ledger; extract once per new hash, share for its copies.

    Copies are found with one aggregate on the hash, so a hash with very many copies stays cheap.
    """
    lead = inputs.groupBy("file_hash").agg(F.min(order).alias("_lead"))
    known = ledger.select("file_hash", F.lit(True).alias("_known")).distinct()
    plan = lead.join(known, "file_hash", "left")
    j = inputs.join(plan, "file_hash")
    action = F.when(F.col("_known"), "reuse").when(F.col(order) == F.col("_lead"), "extract").otherwise("share")
    return j.withColumn("action", action).withColumn("lead_id", F.col("_lead")).drop("_known", "_lead")


def fingerprint(*cols) -> Column:
    """sha256 of the canonical JSON of a request (keys sorted by name)."""
    return F.sha2(F.to_json(F.struct(*[F.col(c) for c in sorted(cols)])), 256)


def response_ledger(requests: DataFrame, ledger: DataFrame, fields: list[str]) -> DataFrame:
    """Requests with the stored response when the same request was answered before."""
    r = requests.withColumn("fingerprint", fingerprint(*fields))
    return r.join(ledger.select("fingerprint", F.col("response").alias("stored_response")), "fingerprint", "left").withColumn("cached", F.col("stored_response").isNotNull())


# --- pages and OCR lines ----------------------------------------------------


def load_pages(blocks: DataFrame) -> DataFrame:
    return page_texts(blocks)


def document_text(pages: DataFrame) -> DataFrame:
    return pages.groupBy("task_id").agg(X.clean_text(O.joined_list("page_text", ["page"], "\n\n")).alias("text"))


_LINE = "id string, text string, content string, value string, bbox string, box string, rect string, score double, confidence double"
_LIST = f"array<struct<{_LINE.replace(' string', ':string').replace(' double', ':double')}>>"


def load_ocr_lines(raw: DataFrame) -> DataFrame:
    """OCR JSON per page to line rows.

    raw: task_id, page, payload.  The line list may sit under lines / result /
    data / items, directly or one level deeper; boxes are x,y,w,h or polygons.
    """
    p = F.col("payload")
    def at(key):
        here = F.from_json(F.get_json_object(p, f"$.{key}"), _LIST)
        nested = [F.from_json(F.get_json_object(p, f"$.{key}.{k}"), _LIST) for k in ("lines", "items")]
        usable = lambda a: F.when(F.exists(a, lambda x: F.length(X.strip(F.coalesce(F.nullif(x["text"], F.lit("")), F.nullif(x["content"], F.lit("")), x["value"]))) > 0), a)
        return [usable(a) for a in [here, *nested]]
    items = F.coalesce(*[a for key in ("lines", "result", "data", "items") for a in at(key)])
    e = raw.select(*PAGE, F.posexplode(items).alias("i", "o"))
    filled = lambda *ks: F.coalesce(*[F.nullif(F.col(f"o.{k}"), F.lit("")) for k in ks])
    e = e.select(*PAGE, "i", X.strip(F.coalesce(filled("text", "content", "value"), F.lit(""))).alias("text"), filled("bbox", "box", "rect").alias("b"),
                 filled("id").alias("id"), F.coalesce(F.nullif("o.score", F.lit(0.0)), F.nullif("o.confidence", F.lit(0.0)), F.lit(0.0)).alias("score")).where(F.length("text") > 0)
    e = e.withColumn("rect", F.from_json("b", "array<double>")).withColumn("poly", F.from_json("b", "array<array<double>>"))
    is_rect = F.size("rect") == 4
    is_rect = is_rect & ~F.exists("rect", lambda v: v.isNull())
    is_poly = (F.size("poly") >= 4) & ~F.exists("poly", lambda v: v.isNull() | (F.size(v) < 2))
    xs, ys = F.transform("poly", lambda v: v[0]), F.transform("poly", lambda v: v[1])
    pick = lambda r, q: F.coalesce(F.when(is_rect, r), F.when(is_poly, q), F.lit(0.0)).cast("long")
    rect = lambda k: F.get("rect", k)
    out = e.select(*PAGE, F.coalesce("id", F.format_string("remote_paddle_%03d_%03d", F.col("page"), F.col("i") + 1)).alias("line_id"), "text",
                   pick(rect(0), F.array_min(xs)).alias("x"), pick(rect(1), F.array_min(ys)).alias("y"),
                   F.greatest(F.lit(1), pick(rect(2), F.array_max(xs) - F.array_min(xs))).alias("width"),
                   F.greatest(F.lit(1), pick(rect(3), F.array_max(ys) - F.array_min(ys))).alias("height"), "score", "i")
    return O.numbered(out, PAGE, ["y", "x", "i"], "line_no").drop("i")


# --- model replies ----------------------------------------------------------


def reply_json(raw) -> Column:
    """JSON object text of a model reply: from the first to the last brace, whatever fence or prose is around it."""
    return F.regexp_extract(raw, r"(?s)(\{.*\})", 1)


@F.pandas_udf(T.StringType())
def _first_object(texts):
    """First decodable JSON object inside a broken reply; only replies the JVM could not read come here."""
    import json

    import pandas as pd
    decoder = json.JSONDecoder()

    def one(t):
        at = t.find("{") if t is not None else -1
        while at >= 0:
            try:
                obj, _ = decoder.raw_decode(t, at)
                if isinstance(obj, dict):
                    return json.dumps(obj, ensure_ascii=False)
            except json.JSONDecodeError:
                pass
            at = t.find("{", at + 1)
        return None
    return pd.Series([one(t) for t in texts])


def load_model_candidates(raw: DataFrame, aliases: list[str], fields: list[str], repair: bool = True) -> DataFrame:
    """Replies (task_id, reply_id, raw_text) to candidate rows: items of the first alias that holds a list."""
    r = raw.select("task_id", "reply_id", reply_json(F.col("raw_text")).alias("j"))
    if repair:
        # readable replies pass a null to the UDF, so only broken text crosses into Python
        broken = F.when(F.try_parse_json("j").isNull(), F.col("j"))
        r = r.withColumn("_fixed", _first_object(broken)).withColumn("j", F.coalesce("_fixed", "j"))
    v = F.try_parse_json("j")
    # an array under the first alias present; each item is read as an open map
    item = f"array<struct<{','.join(f + ':string' for f in fields)}>>"
    lists = []
    for a in aliases:
        node = F.try_variant_get(v, f"$.{a}", "variant")
        is_list = F.coalesce(F.schema_of_variant(node).startswith("ARRAY"), F.lit(False))
        lists.append(F.when(is_list, F.from_json(F.get_json_object("j", f"$.{a}"), item)))
    e = r.select("task_id", "reply_id", F.posexplode(F.coalesce(*lists)).alias("item_no", "item")).where(F.col("item").isNotNull())
    return e.select("task_id", "reply_id", (F.col("item_no") + 1).alias("item_no"), "item.*")


# --- table maintenance ------------------------------------------------------


def latest_by(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """Last writer wins per key."""
    rest = [c for c in df.columns if c not in keys]
    pos = F.struct(*[F.col(c) if isinstance(c, str) else c for c in order])
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), pos).alias("_b")).select(*keys, "_b.*").select(*df.columns)


def upsert(current: DataFrame, new: DataFrame, key: str, position: str) -> DataFrame:
    """Replace by key and keep the position; new keys are appended after the last position in their own order."""
    values = [c for c in current.columns if c not in (key, position)]
    end = current.agg(F.coalesce(F.max(position), F.lit(0)).alias("_end"))  # one row
    n = new.select(key, F.col(position).alias("_np"), *[F.col(c).alias(f"_n_{c}") for c in values], F.lit(True).alias("_new"))
    j = current.join(n, key, "full_outer").join(F.broadcast(end))
    return j.select(key, F.coalesce(F.col(position), F.col("_end") + F.col("_np")).alias(position),
                    *[F.when(F.col("_new"), F.col(f"_n_{c}")).otherwise(F.col(c)).alias(c) for c in values])


config_upsert = upsert


def delete_ids(current: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return current.join(ids.select(key).distinct(), key, "left_anti")


config_delete = delete_ids


def patch(current: DataFrame, changes: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Overwrite only the given (non-null) fields."""
    c = changes.select(key, *[F.col(f).alias(f"_{f}") for f in fields])
    j = current.join(c, key, "left")
    return j.select(*[F.coalesce(f"_{f}", f).alias(f) if f in fields else F.col(f) for f in current.columns])


def kb_documents_list(docs: DataFrame) -> DataFrame:
    return docs.orderBy(F.desc("created_at"), "document_id")


def kb_clauses_write(kb: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Partitioned by type; sorted by document and template inside files so that both lookups prune row groups."""
    kb.sortWithinPartitions("document_id", "template_id").write.mode(mode).partitionBy("doc_type").parquet(path)


def kb_clauses_list(kb: DataFrame, document_id=None, template_id=None, doc_type=None) -> DataFrame:
    for name, v in (("document_id", document_id), ("template_id", template_id), ("doc_type", doc_type)):
        if v is not None:
            kb = kb.where(F.col(name) == v)
    return kb.orderBy(F.coalesce("template_id", F.lit("")), "page_start", F.coalesce("clause_no", F.lit("")), "clause_id")


def kb_clause_get(kb: DataFrame, clause_id: str) -> DataFrame:
    return kb.where(F.col("clause_id") == clause_id)


def rules_upsert(current: DataFrame, new: DataFrame) -> DataFrame:
    """Both carry ``written`` (write order); the last writer of an id wins."""
    return latest_by(current.unionByName(new), ["rule_id"], ["written"])


def rules_list(rules: DataFrame) -> DataFrame:
    return rules.orderBy("rule_id")


def rules_by_source(rules: DataFrame, document_id) -> DataFrame:
    return rules.where(F.col("source_document_id") == document_id).orderBy("rule_id")


def write_reports(reports: DataFrame, path: str, buckets: int = 64, mode: str = "overwrite") -> None:
    """Bucketed by contract so that one contract is read from one folder."""
    reports.withColumn("bucket", F.pmod(F.xxhash64("contract_id"), F.lit(buckets))).write.mode(mode).partitionBy("bucket").parquet(path)


def read_report(spark: SparkSession, path: str, contract_id: str, buckets: int = 64) -> DataFrame:
    want = F.pmod(F.xxhash64(F.lit(contract_id)), F.lit(buckets))
    return spark.read.parquet(path).where((F.col("bucket") == want) & (F.col("contract_id") == contract_id)).drop("bucket")


def read_reports(spark: SparkSession, path: str, wanted: DataFrame, buckets: int = 64) -> DataFrame:
    """The reports of all wanted contracts (contract_id); only their buckets are read."""
    ids = wanted.select("contract_id").distinct().withColumn("bucket", F.pmod(F.xxhash64("contract_id"), F.lit(buckets)))
    return spark.read.parquet(path).join(ids, ["bucket", "contract_id"], "left_semi").drop("bucket")


def persist_tasks(tasks: DataFrame, path: str) -> None:
    tasks.write.mode("overwrite").json(path)


def load_tasks(spark: SparkSession, path: str, schema: str, indented: bool = False) -> DataFrame:
    """All persisted tasks, one a line or (indented) one or an array of them a file; malformed ones are skipped, see malformed_tasks."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").option("multiLine", indented).json(path)


def malformed_tasks(spark: SparkSession, path: str, schema: str, indented: bool = False) -> DataFrame:
    """The texts that load_tasks skips, for counting or a closer look."""
    read = spark.read.schema(f"{schema}, _malformed string").option("columnNameOfCorruptRecord", "_malformed").option("multiLine", indented)
    return stage(read.json(path)).where("_malformed is not null").select(F.col("_malformed").alias("text"))


def source_tasks(tasks: DataFrame) -> DataFrame:
    return tasks.where(F.col("result").isNotNull()).orderBy(F.desc("created_at"), "task_id")


def page_lookup(pages: DataFrame, task_id: str, page: int) -> DataFrame:
    return pages.where((F.col("task_id") == task_id) & (F.col("page") == page))


def evidence_lookup(evidence: DataFrame) -> DataFrame:
    """First row of every evidence id in page order."""
    return O.first_by(evidence, ["task_id", "evidence_id"], ["page", "segment_index"])


def export_results(tasks: DataFrame, children: dict[str, tuple[DataFrame, list[str]]]) -> DataFrame:
    """One JSON bundle per contract: every child table as an ordered array.

    children: name -> (table with task_id, order columns).  A bundle is one
    value by definition, so its size is that of one contract's results.
    """
    out = tasks
    for name, (df, order) in children.items():
        cols = [c for c in df.columns if c != "task_id"]
        items = F.transform(F.array_sort(F.collect_list(F.struct(F.struct(*order).alias("o"), F.struct(*cols).alias("v")))), lambda s: s["v"])
        out = out.join(df.groupBy("task_id").agg(items.alias(name)), "task_id", "left")
    return out.select("task_id", F.to_json(F.struct(*[c for c in out.columns])).alias("bundle"))
