"""Keyed state (survey section 2.12), as batch folds; the streams are tested with the same functions."""

from pyspark.sql import functions as F

from auditframe.plans import bridge as B
from auditframe.streaming import state as T

from .registry import query

EV = """te AS (SELECT event_id, ts, 'task_' || user_id AS task_id, CASE WHEN event_id % 10 = 0 THEN NULL ELSE event_type END AS current_stage, CASE WHEN event_id % 3 = 0 THEN NULL ELSE greatest(0, least(100, floor(value * 3)::INT - 20)) END AS progress_percent,
    CASE WHEN event_id % 4 = 0 THEN 'processing' END AS status, props AS stage_detail FROM events)"""


@B.memo
def events(spark, sf):
    e, i = B.load(spark, sf, "events"), F.col("event_id")
    return e.select("event_id", "ts", F.concat(F.lit("task_"), "user_id").alias("task_id"), F.when(i % 10 != 0, F.col("event_type")).alias("current_stage"),
                    F.when(i % 3 != 0, F.floor(F.col("value") * 3).cast("int") - 20).alias("progress_percent"), F.when(i % 4 == 0, "processing").alias("status"), F.col("props").alias("stage_detail"))


def last(c):
    return f"(arg_max({c}, (ts, event_id)) FILTER ({c} IS NOT NULL))"


@query("task_state", f"WITH {EV} SELECT task_id, {last('status')} AS status, {last('progress_percent')}::BIGINT AS progress_percent, {last('current_stage')} AS current_stage, {last('stage_detail')} AS stage_detail, count(*)::BIGINT AS n_events FROM te GROUP BY task_id")
def _(spark, sf):
    return T.task_state(events(spark, sf)).drop("updated_at")


RV = """rv AS (SELECT event_id, ts, 'rev_' || user_id AS review_id, CASE event_type WHEN 'click' THEN 'running' WHEN 'error' THEN 'failed' WHEN 'view' THEN 'queued' ELSE 'completed' END AS status, event_type AS message, CASE WHEN event_type = 'purchase' THEN event_id END AS issue_count, CASE WHEN event_type = 'error' THEN props END AS error FROM events)"""


@B.memo
def reviews(spark, sf):
    t = F.col("event_type")
    none = F.lit(None).cast("string")
    return B.load(spark, sf, "events").select("event_id", "ts", F.concat(F.lit("rev_"), "user_id").alias("review_id"), F.when(t == "click", "running").when(t == "error", "failed").when(t == "view", "queued").otherwise("completed").alias("status"),
        t.alias("message"), none.alias("contract_id"), F.when(t == "purchase", F.col("event_id")).alias("issue_count"), none.alias("detected_category"), F.when(t == "error", F.col("props")).alias("error"), (F.floor("value") % 101).alias("progress_percent"))


@query("review_task_state", f"WITH {RV} SELECT review_id, {last('status')} AS status, {last('message')} AS message, {last('issue_count')} AS issue_count, {last('error')} AS error, count(*)::BIGINT AS n_events FROM rv GROUP BY review_id")
def _(spark, sf):
    return T.review_task_state(reviews(spark, sf)).select("review_id", "status", "message", "issue_count", "error", "n_events")


@query("review_step_state", f"""WITH {RV}, s AS (SELECT review_id, {last('status')} AS status, max(event_id) % 9 AS k FROM rv GROUP BY review_id),
    st AS (SELECT unnest(['classify_contract', 'match_template', 'extract_schema', 'compare_template', 'retrieve_policy', 'run_rules', 'generate_issues', 'save_report']) AS step, unnest(range(1, 9)) AS p)
    SELECT review_id, p::BIGINT AS position, step, CASE WHEN k = 0 AND status = 'completed' THEN 'completed' WHEN k = 0 THEN 'pending' WHEN p < k THEN 'completed' WHEN p > k THEN 'pending' WHEN status = 'failed' THEN 'failed' WHEN status = 'completed' THEN 'completed' ELSE 'running' END AS step_status,
    least(99, 90 + round(k * 10 * 0.09::DOUBLE))::BIGINT AS outer_progress FROM s, st""")
def _(spark, sf):
    s = reviews(spark, sf).groupBy("review_id").agg(F.max_by("status", F.struct("ts", "event_id")).alias("status"), (F.max("event_id") % 9).alias("k"))
    steps = F.array(*map(F.lit, ["", *T.P.REVIEW_STEPS]))
    return T.review_step_state(s.select("review_id", "status", F.get(steps, F.col("k").cast("int")).alias("current_step"), (F.col("k") * 10).alias("progress_percent"), (F.col("status") == "failed").alias("failed")))
