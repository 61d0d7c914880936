"""Streams that really run, and what they leave behind (survey sections 2.1 and 2.12)."""

from pyspark.sql import functions as F

from auditframe.plans import bridge as B
from auditframe.session import scratch_path
from auditframe.sources import tables as R
from auditframe.streaming import state as T

from .registry import query
from .state import EV, events as task_events, last


def as_stream(spark, df, files=3):
    """A file stream over the rows, a file a batch."""
    path = scratch_path(spark, "stream")
    df.repartition(files).write.parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


@query("stream_ingest", "SELECT sha256(text) AS file_hash, min(len(string_split(text, chr(10))))::BIGINT AS n_lines, count(DISTINCT text) AS n FROM documents GROUP BY 1")
def _(spark, sf):
    """Copies of a text come in different batches and are audited once."""
    d = B.load(spark, sf, "documents").select(F.sha2("text", 256).alias("file_hash"), "text")
    out = scratch_path(spark, "ingested")
    audit = lambda x: x.select("file_hash", F.size(F.split("text", "\n")).cast("long").alias("n_lines"))
    T.stream_ingest(as_stream(spark, d), audit, out, scratch_path(spark, "stream-cp")).awaitTermination()
    return T.read_ingested(spark, out, "file_hash string, n_lines long").groupBy("file_hash").agg(F.min("n_lines").alias("n_lines"), F.count("*").alias("n"))


@query("reaudit_edits", "SELECT task_id, clause_id, CASE WHEN doc_id % 17 = 0 THEN 'edited ' || label ELSE label END AS label FROM clauses")
def _(spark, sf):
    c = B.clauses(spark, sf).select("task_id", "clause_id", "label", "doc_id")
    out, schema = scratch_path(spark, "snapshot"), "task_id string, clause_id string, label string"
    T.write_snapshot(c.drop("doc_id"), out, 0, 16)
    edits = B.documents(spark, sf).where("doc_id % 17 = 0").select("task_id", F.lit("edited ").alias("words"))

    def recompute(batch):
        return T.read_snapshot(spark, out, schema, 1).join(batch.distinct(), "task_id").select("task_id", "clause_id", F.concat("words", "label").alias("label"))

    T.reaudit_edits(as_stream(spark, edits), recompute, out, scratch_path(spark, "edits-cp"), schema, 16).awaitTermination()
    return T.read_snapshot(spark, out, schema)


@query("read_report", "SELECT 'contract_task_' || doc_id AS contract_id, source AS summary, length(text) AS size FROM documents")
def _(spark, sf):
    path = scratch_path(spark, "reports")
    d = B.documents(spark, sf).select(F.concat(F.lit("contract_"), "task_id").alias("contract_id"), F.col("source").alias("summary"), F.length("text").cast("long").alias("size"))
    R.write_reports(d, path)
    return R.read_reports(spark, path, d)


@query("load_tasks", "SELECT 'task_' || doc_id AS task_id, doc_id AS created_at, doc_id % 10 = 0 AS malformed FROM documents")
def _(spark, sf):
    """Every tenth task file is cut short: it is skipped, and found again among the malformed ones."""
    d = B.documents(spark, sf)
    line = F.to_json(F.struct("task_id", F.col("doc_id").alias("created_at")))
    path = scratch_path(spark, "tasks")
    d.select(F.when(F.col("doc_id") % 10 == 0, F.regexp_replace(line, "}$", "")).otherwise(line).alias("value")).write.text(path)
    good = R.load_tasks(spark, path, "task_id string, created_at long").select("task_id", "created_at", F.lit(False).alias("malformed"))
    bad = R.malformed_tasks(spark, path, "task_id string, created_at long").select(F.regexp_extract("text", '"task_id":"([^"]*)"', 1).alias("task_id"), F.regexp_extract("text", '"created_at":([0-9]+)', 1).cast("long").alias("created_at"), F.lit(True).alias("malformed"))
    return good.unionByName(bad)


@query("task_state_timed", f"WITH {EV} SELECT task_id, {last('status')} AS status, {last('progress_percent')}::BIGINT AS progress_percent, {last('current_stage')} AS current_stage, {last('stage_detail')} AS stage_detail, count(*)::BIGINT AS n_events FROM te GROUP BY task_id")
def _(spark, sf):
    """Each batch leaves the tasks it changed in a folder of its own; the row of most events is the state."""
    out = scratch_path(spark, "task-states")
    e = task_events(spark, sf)
    T.task_state_timed(as_stream(spark, e), lambda df, epoch: df.write.mode("overwrite").parquet(f"{out}/epoch={epoch}"), scratch_path(spark, "states-cp")).awaitTermination()
    rows = spark.read.schema("task_id string, status string, progress_percent int, current_stage string, stage_detail string, n_events long, epoch long").parquet(out)
    return rows.groupBy("task_id").agg(F.max_by(F.struct(*T.TASK_FIELDS, "n_events"), "n_events").alias("s")).select("task_id", "s.*")
