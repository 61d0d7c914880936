"""Keyed state: task progress, review state and incremental jobs.

Every fold is written once for batch; the stream runs the same aggregate.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

from .. import params as P

TASK_FIELDS = ["status", "progress_percent", "current_stage", "stage_detail"]
REVIEW_FIELDS = ["status", "message", "contract_id", "issue_count", "detected_category", "error"]


def fold(events: DataFrame, key: str, fields: list[str], order: list[str]) -> DataFrame:
    """Latest non-null value per field.  Combinable, so a hot key costs one row per partition."""
    pos = F.struct(*order)
    return events.groupBy(key).agg(*[F.max_by(f, F.when(F.col(f).isNotNull(), pos)).alias(f) for f in fields], F.max(pos).alias("_at"), F.count(F.lit(1)).alias("n_events"))


def task_state(events: DataFrame) -> DataFrame:
    """Current task state; progress is clamped to 0..100 when written."""
    p = F.col("progress_percent")
    e = events.withColumn("progress_percent", F.when(p.isNotNull(), F.greatest(F.lit(0), F.least(F.lit(100), p))))
    return fold(e, "task_id", TASK_FIELDS, ["ts", "event_id"]).withColumn("updated_at", F.col("_at.ts")).drop("_at")


def review_task_state(events: DataFrame) -> DataFrame:
    return fold(events, "review_id", REVIEW_FIELDS, ["ts", "event_id"]).withColumn("updated_at", F.col("_at.ts")).drop("_at")


def outer_progress(percent):
    """Progress of the whole task while the review runs: the review fills the last tenth."""
    return F.least(F.lit(99), 90 + F.round(F.coalesce(percent, F.lit(0)) * 0.09).cast("int"))


def review_step_state(states: DataFrame, steps=P.REVIEW_STEPS) -> DataFrame:
    """Step list of each review.  states: review_id, status, current_step, progress_percent, failed."""
    rows = F.array(*[F.struct(F.lit(i).alias("position"), F.lit(s).alias("step")) for i, s in enumerate(steps, start=1)])
    at = F.array_position(F.array(*map(F.lit, steps)), F.coalesce("current_step", F.lit("")))
    t = states.withColumn("_at", at).select("*", F.explode(rows).alias("r"))
    p = F.col("r.position")
    st = (F.when((F.col("_at") == 0) & (F.col("status") == "completed"), "completed").when(F.col("_at") == 0, "pending").when(p < F.col("_at"), "completed").when(p > F.col("_at"), "pending")
          .when(F.col("failed"), "failed").when(F.col("status") == "completed", "completed").otherwise("running"))
    return t.select("review_id", p.alias("position"), F.col("r.step").alias("step"), st.alias("step_status"), outer_progress(F.col("progress_percent")).alias("outer_progress"))


def task_state_stream(events: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, available_now: bool = True):
    """The same fold as a streaming aggregate in update mode: the sink receives changed keys only."""
    w = task_state(events).writeStream.outputMode("update").foreachBatch(sink).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if available_now else w).start()


#: A task in one of these states gets no more events, as a rule.
FINISHED = ("completed", "failed")
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
NO_DATA_BATCHES = "spark.sql.streaming.noDataMicroBatches.enabled"


class LatestFields(StatefulProcessor):
    """fold() with a state that ends: the latest value of each field, kept until ``retention_ms`` after the key has finished.

    The state of a key is one row (each field with the position of its event, the number of events); a key sets a timer when it finishes
    and takes it back when it is opened again before.
    """

    def __init__(self, key: str, fields: list, order: list, finished: tuple, retention_ms: int):
        self.key, self.fields, self.order, self.finished, self.retention = key, fields, order, finished, retention_ms

    def init(self, handle) -> None:
        self.handle = handle
        at = [T.StructField(f"{f.name}_{o.name}", o.dataType) for f in self.fields for o in self.order]
        self.schema = T.StructType([*self.fields, *at, *[T.StructField(f"last_{o.name}", o.dataType) for o in self.order], T.StructField("n_events", T.LongType())])
        self.state = handle.getValueState("latest", self.schema)

    def handleInputRows(self, key, rows, timerValues):
        old = self.state.get()
        kept = dict(zip(self.schema.names, old)) if old is not None else dict.fromkeys(self.schema.names)
        kept["n_events"] = kept["n_events"] or 0
        names = [o.name for o in self.order]
        last = tuple(kept[f"last_{o}"] for o in names)
        for row in rows:
            pos = tuple(row[o] for o in names)
            last = pos if last[0] is None or pos > last else last
            kept["n_events"] += 1
            for f in self.fields:
                at = tuple(kept[f"{f.name}_{o}"] for o in names)
                if row[f.name] is not None and (at[0] is None or pos > at):
                    kept[f.name] = row[f.name]
                    kept.update(zip((f"{f.name}_{o}" for o in names), pos))
        kept.update(zip((f"last_{o}" for o in names), last))
        self.state.update(tuple(kept[n] for n in self.schema.names))
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if kept["status"] in self.finished:
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.retention)
        yield Row(**{self.key: key[0], **{f.name: kept[f.name] for f in self.fields}, "n_events": kept["n_events"], "updated_at": last[0]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        self.state.clear()
        return iter(())

    def close(self) -> None:
        pass


def task_state_timed(events: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, retention_ms: int = 24 * 3600 * 1000, finished: tuple = FINISHED, available_now: bool = True):
    """task_state() as a stream whose finished tasks leave the state store.

    The sink receives the changed tasks of each batch.  Equal to the batch fold as long as no event of a task comes later than
    ``retention_ms`` after it finished; an event that does opens the task anew, with its own values and count.  ts and event_id hold no nulls.
    """
    p = F.col("progress_percent")
    e = events.where(F.col("task_id").isNotNull()).withColumn("progress_percent", F.when(p.isNotNull(), F.greatest(F.lit(0), F.least(F.lit(100), p)))).select("task_id", *TASK_FIELDS, "ts", "event_id")
    fields, order = [e.schema[f] for f in TASK_FIELDS], [e.schema[o] for o in ("ts", "event_id")]
    out = T.StructType([e.schema["task_id"], *fields, T.StructField("n_events", T.LongType()), T.StructField("updated_at", e.schema["ts"].dataType)])
    changed = e.groupBy("task_id").transformWithState(LatestFields("task_id", fields, order, finished, retention_ms), out, "Update", "ProcessingTime")
    w = changed.writeStream.outputMode("update").foreachBatch(sink).option("checkpointLocation", checkpoint)
    # Timers need this store.  They make Spark run a batch after each batch, so a run over what is there now would never end: there, timers
    # are looked at in batches with events only.  A query keeps the settings it was started with.
    settings = {PROVIDER: ROCKSDB, **({NO_DATA_BATCHES: "false"} if available_now else {})}
    conf = events.sparkSession.conf
    before = {k: conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            conf.set(k, v)
        return (w.trigger(availableNow=True) if available_now else w).start()
    finally:
        for k, v in before.items():
            conf.set(k, v)


LEDGER_BUCKETS = 64


def stream_ingest(source: DataFrame, audit: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, hash_col: str = "file_hash", available_now: bool = True, ledger: str | None = None):
    """New inputs are audited once each and appended.

    Hashes of audited inputs go to a ledger of their own, bucketed by hash, so an
    input whose audit gives no row is done as well and a batch looks only into
    the buckets of its hashes.  A batch that is retried writes its folder again
    and ignores its own ledger rows: each input gets exactly one result.

    Last of all the batch is marked as finished; read_ingested() returns finished
    batches only, so a reader never sees half a batch or one that is written anew.
    """
    ledger = ledger or f"{out.rstrip('/')}-ledger"
    rows = "hash string, epoch long, bucket int"
    source.sparkSession.createDataFrame([], rows).write.mode("ignore").partitionBy("bucket").parquet(ledger)
    source.sparkSession.createDataFrame([], "epoch long").write.mode("ignore").parquet(f"{out.rstrip('/')}-finished/start")

    def run(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        fresh = batch.dropDuplicates([hash_col]).withColumn("_bucket", F.pmod(F.xxhash64(hash_col), F.lit(LEDGER_BUCKETS)).cast("int"))
        done = spark.read.schema(rows).parquet(ledger).where(F.col("epoch") != epoch)
        fresh = fresh.join(done, (F.col("_bucket") == F.col("bucket")) & (F.col(hash_col) == F.col("hash")), "left_anti")
        audit(fresh.drop("_bucket")).write.mode("overwrite").parquet(f"{out}/epoch={epoch}")
        fresh.select(F.col(hash_col).alias("hash"), F.lit(epoch).cast("long").alias("epoch"), F.col("_bucket").alias("bucket")).write.mode("append").partitionBy("bucket").parquet(ledger)
        spark.range(epoch, epoch + 1).select(F.col("id").alias("epoch")).coalesce(1).write.mode("overwrite").parquet(f"{out.rstrip('/')}-finished/{epoch}")

    w = source.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if available_now else w).start()


def read_ingested(spark: SparkSession, out: str, schema: str) -> DataFrame:
    """Results of the finished batches of stream_ingest, with their epoch; none if no batch is finished."""
    finished = spark.read.schema("epoch long").option("recursiveFileLookup", True).parquet(f"{out.rstrip('/')}-finished").distinct()
    if finished.isEmpty():
        return spark.createDataFrame([], f"{schema}, epoch long")
    return spark.read.schema(f"{schema}, epoch long").parquet(out).join(finished, "epoch", "left_semi")


def task_bucket(buckets: int):
    return F.pmod(F.xxhash64("task_id"), F.lit(buckets)).alias("bucket")


def write_snapshot(rows: DataFrame, out: str, epoch: int, buckets: int, hit: DataFrame | None = None) -> None:
    """Write rows as the contents of their buckets (those of ``hit``, by default all) from this epoch on.

    New files first, the manifest that points to them last: until its one file is there, readers see the earlier contents, and a crash in
    between leaves nothing that anyone reads.  Writing an epoch again replaces it.
    """
    spark = rows.sparkSession
    rows.drop("bucket", "epoch").withColumn("bucket", F.pmod(F.xxhash64("task_id"), F.lit(buckets)).cast("int")).write.mode("overwrite").partitionBy("bucket").parquet(f"{out}/data/epoch={epoch}")
    hit = spark.range(buckets).select(F.col("id").cast("int").alias("bucket")) if hit is None else hit.select(F.col("bucket").cast("int").alias("bucket")).distinct()
    hit.withColumn("epoch", F.lit(epoch).cast("long")).coalesce(1).write.mode("overwrite").parquet(f"{out}/manifest/{epoch}")


def read_snapshot(spark: SparkSession, out: str, schema: str, before: int | None = None) -> DataFrame:
    """The latest contents of every bucket (or those before an epoch).  The manifest has a row for each bucket and epoch that touched it."""
    manifest = spark.read.schema("bucket int, epoch long").option("recursiveFileLookup", True).parquet(f"{out}/manifest")
    if before is not None:
        manifest = manifest.where(F.col("epoch") < before)
    current = manifest.groupBy("bucket").agg(F.max("epoch").alias("epoch"))
    return spark.read.schema(f"{schema}, epoch long, bucket int").parquet(f"{out}/data").join(current, ["bucket", "epoch"], "left_semi").drop("epoch", "bucket")


def reaudit_edits(edits: DataFrame, recompute: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, schema: str, buckets: int = 64, available_now: bool = True):
    """Stream of field edits: only edited tasks are recomputed; their buckets get new contents.

    ``recompute`` gets the edited rows and returns the new result rows of the edited tasks.  Results live in the snapshot ``out``, which
    write_snapshot() starts (epoch 0; batch n is epoch n + 1) or which is empty before the first edit.  A batch reads the contents before
    its own epoch, so a repeated batch gives the same result.
    """
    spark = edits.sparkSession
    spark.createDataFrame([], "bucket int, epoch long").write.mode("ignore").parquet(f"{out}/manifest/start")
    spark.createDataFrame([], schema).write.mode("ignore").parquet(f"{out}/data/epoch=-1/bucket=0")

    def run(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        tasks = batch.select("task_id").distinct()
        hit = tasks.select(task_bucket(buckets)).distinct()
        new = recompute(batch)
        old = read_snapshot(spark, out, schema, epoch + 1).withColumn("bucket", F.pmod(F.xxhash64("task_id"), F.lit(buckets)))
        keep = old.join(hit, "bucket", "left_semi").join(tasks, "task_id", "left_anti")
        write_snapshot(keep.select(*new.columns).unionByName(new), out, epoch + 1, buckets, hit)

    w = edits.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if available_now else w).start()
