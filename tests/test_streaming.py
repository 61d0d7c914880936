from pyspark.sql import functions as F

from auditframe.streaming import state as S

EVENTS = "event_id long, ts long, task_id string, status string, progress_percent int, current_stage string, stage_detail string"


def test_state_stream_equals_batch(spark, tmp_path):
    src = tmp_path / "src"
    rows = [(i, i // 3, f"t{i % 4}", "processing" if i % 5 == 0 else None, (i * 7) % 140 if i % 2 else None, f"s{i}", None) for i in range(60)]
    for k in range(3):
        spark.createDataFrame(rows[k * 20:(k + 1) * 20], EVENTS).coalesce(1).write.mode("append").parquet(str(src))
    batch = S.task_state(spark.read.parquet(str(src))).drop("updated_at")
    latest = {}

    def sink(df, epoch):
        latest.update({r.task_id: tuple(r) for r in df.drop("updated_at").collect()})

    stream = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(str(src))
    S.task_state_stream(stream, sink, str(tmp_path / "cp")).awaitTermination()
    assert sorted(latest.values()) == sorted(tuple(r) for r in batch.collect())
    assert all(r.progress_percent is None or 0 <= r.progress_percent <= 100 for r in batch.collect())


def run_timed(spark, folder, batches, retention_ms):
    """Latest row of each task, and the number of state rows after each batch."""
    latest, sizes = {}, []
    for rows in batches:
        spark.createDataFrame(rows, EVENTS).coalesce(1).write.mode("append").parquet(str(folder / "src"))
        stream = spark.readStream.schema(EVENTS).parquet(str(folder / "src"))
        q = S.task_state_timed(stream, lambda df, epoch: latest.update({r.task_id: r for r in df.collect()}), str(folder / "cp"), retention_ms)
        q.awaitTermination()
        sizes.append(q.recentProgress[-1]["stateOperators"][0]["numRowsTotal"])
    return latest, sizes


def test_timed_state_equals_batch(spark, tmp_path):
    rows = [(i, i // 3, f"t{i % 4}", ("completed" if i % 3 else "processing") if i % 5 == 0 else None, (i * 7) % 140 if i % 2 else None, f"s{i}", None) for i in range(40)]
    # events come out of order, and some repeat a time
    latest, _ = run_timed(spark, tmp_path, [rows[20:], rows[:20]], 3_600_000)
    batch = S.task_state(spark.createDataFrame(rows, EVENTS))
    cols = sorted(batch.columns)
    assert sorted(tuple(r[c] for c in cols) for r in latest.values()) == sorted(tuple(r) for r in batch.select(*cols).collect())


def test_finished_tasks_leave_the_state(spark, tmp_path):
    of = lambda batch, status: [(100 * batch + i, batch, f"t{batch}_{i}", status, 50, None, None) for i in range(10)]
    ended = [of(b, "completed") for b in range(3)] + [of(3, "processing"), [(999, 9, "t3_1", None, 60, None, None)]]
    latest, sizes = run_timed(spark, tmp_path, ended, 0)
    assert len(latest) == 40 and latest["t3_1"].progress_percent == 60 and latest["t3_1"].n_events == 2
    # each batch clears the one before; the ten open tasks stay
    assert max(sizes) <= 30 and sizes[-1] <= 10, sizes
    # a task that gets an event after its state is gone starts anew
    again, _ = run_timed(spark, tmp_path, [[(2000, 20, "t0_1", "processing", 10, None, None)]], 0)
    assert (again["t0_1"].n_events, again["t0_1"].status) == (1, "processing")


def test_ingest_each_hash_once(spark, tmp_path):
    src = tmp_path / "src"
    for part in ([("h1", "a"), ("h2", "b")], [("h2", "b"), ("h3", "c")]):
        spark.createDataFrame(part, "file_hash string, text string").coalesce(1).write.mode("append").parquet(str(src))
    stream = spark.readStream.schema("file_hash string, text string").option("maxFilesPerTrigger", 1).parquet(str(src))
    out = str(tmp_path / "out")
    S.stream_ingest(stream, lambda d: d.withColumn("n", F.length("text")), out, str(tmp_path / "cp")).awaitTermination()
    assert sorted(r.file_hash for r in spark.read.parquet(out).collect()) == ["h1", "h2", "h3"]


def test_readers_see_finished_batches_only(spark, tmp_path):
    src, out = tmp_path / "src", str(tmp_path / "out")
    spark.createDataFrame([("h1", "abc")], "file_hash string, text string").write.parquet(str(src))
    stream = spark.readStream.schema("file_hash string, text string").parquet(str(src))
    S.stream_ingest(stream, lambda d: d, out, str(tmp_path / "cp")).awaitTermination()
    # a batch that is written but not marked
    spark.createDataFrame([("h9", "half")], "file_hash string, text string").write.parquet(f"{out}/epoch=7")
    assert [(r.file_hash, r.epoch) for r in S.read_ingested(spark, out, "file_hash string, text string").collect()] == [("h1", 0)]


TASKS = "task_id string, v string"


def edit_stream(spark, path, rows):
    spark.createDataFrame(rows, "task_id string, e string").coalesce(1).write.mode("append").parquet(str(path))
    return spark.readStream.schema("task_id string, e string").option("maxFilesPerTrigger", 1).parquet(str(path))


def test_reaudit_gives_new_contents_to_edited_tasks_only(spark, tmp_path):
    out, cp = str(tmp_path / "out"), str(tmp_path / "cp")
    S.write_snapshot(spark.createDataFrame([(f"t{i}", "old") for i in range(20)], TASKS), out, 0, 4)
    again = lambda d: d.select("task_id", F.col("e").alias("v"))
    S.reaudit_edits(edit_stream(spark, tmp_path / "edits", [("t3", "x"), ("t9", "y")]), again, out, cp, TASKS, 4).awaitTermination()
    S.reaudit_edits(edit_stream(spark, tmp_path / "edits", [("t3", "z"), ("new", "n")]), again, out, cp, TASKS, 4).awaitTermination()
    got = {r.task_id: r.v for r in S.read_snapshot(spark, out, TASKS).collect()}
    assert len(got) == 21 and (got["t3"], got["t9"], got["new"], got["t4"]) == ("z", "y", "n", "old")
    # contents of another epoch, as a crash before its manifest leaves them, are not read, nor do they hinder the batch when it is repeated
    spark.createDataFrame([("t4", "lost")], TASKS).withColumn("bucket", F.lit(1)).write.partitionBy("bucket").parquet(f"{out}/data/epoch=3")
    assert {r.task_id: r.v for r in S.read_snapshot(spark, out, TASKS).collect()} == got
    S.reaudit_edits(edit_stream(spark, tmp_path / "edits", [("t5", "w")]), again, out, cp, TASKS, 4).awaitTermination()
    assert {r.task_id: r.v for r in S.read_snapshot(spark, out, TASKS).collect()} == {**got, "t5": "w"}


def test_reaudit_starts_from_an_empty_snapshot(spark, tmp_path):
    out = str(tmp_path / "out")
    S.reaudit_edits(edit_stream(spark, tmp_path / "edits", [("t1", "a")]), lambda d: d.select("task_id", F.col("e").alias("v")), out, str(tmp_path / "cp"), TASKS, 4).awaitTermination()
    assert [tuple(r) for r in S.read_snapshot(spark, out, TASKS).collect()] == [("t1", "a")]


def test_reports_are_read_by_bucket(spark, tmp_path):
    from auditframe.sources import tables as T
    path = str(tmp_path / "reports")
    T.write_reports(spark.createDataFrame([(f"c{i}", i) for i in range(200)], "contract_id string, n long"), path, 8)
    one = T.read_report(spark, path, "c7", 8)
    assert [tuple(r) for r in one.collect()] == [("c7", 7)]
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan and plan.count("bucket=") <= 1
    some = T.read_reports(spark, path, spark.createDataFrame([("c1",), ("c9",), ("c9",), ("none",), (None,)], "contract_id string"), 8)
    assert sorted(tuple(r) for r in some.collect()) == [("c1", 1), ("c9", 9)]


def test_an_input_without_rows_is_audited_once(spark, tmp_path):
    src, seen = tmp_path / "src", []
    for part in ([("h1", "")], [("h1", "")], [("h1", ""), ("h2", "b")]):
        spark.createDataFrame(part, "file_hash string, text string").coalesce(1).write.mode("append").parquet(str(src))
    stream = spark.readStream.schema("file_hash string, text string").option("maxFilesPerTrigger", 1).parquet(str(src))

    def audit(d):
        seen.extend(r.file_hash for r in d.collect())
        return d.where("text <> ''")

    S.stream_ingest(stream, audit, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert sorted(seen) == ["h1", "h2"]
