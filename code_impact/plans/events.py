"""Queries over webhooks, messages, jobs, errors and metrics."""

from pyspark.sql import functions as F

from code_impact.operators import events as ops
from code_impact.operators import sketches
from code_impact.plans.registry import query
from code_impact.session import scratch_path

K = "event_id % 40"
FIRST = f"""CASE WHEN {K} = 1 THEN 'Only POST method is allowed' WHEN {K} = 6 THEN 'Request body is required'
 WHEN {K} = 2 THEN 'X-GitHub-Event header is required' WHEN {K} = 3 THEN 'Only pull_request events are supported' END"""
ACTION = "CASE event_type WHEN 'view' THEN 'opened' WHEN 'click' THEN 'synchronize' WHEN 'signup' THEN 'ready_for_review' WHEN 'purchase' THEN 'closed' ELSE 'labeled' END"
VALID = f"({K} NOT IN (1, 2, 3, 4, 5, 6) AND event_type <> 'error')"
JOB = """substr(md5('d-' || event_id), 1, 8) || '-' || substr(md5('d-' || event_id), 9, 4) || '-3' || substr(md5('d-' || event_id), 14, 3) || '-8'
 || substr(md5('d-' || event_id), 18, 3) || '-' || substr(md5('d-' || event_id), 21, 12)"""


@query("webhook_ingest", f"SELECT event_id, {FIRST} AS request_error FROM events")
def webhook_ingest(t):
    return ops.check_requests(t["webhook_events"]).select("event_id", "request_error")


@query(
    "webhook_errors",
    f"""SELECT event_id, 'body' AS path, 'Invalid JSON in request body' AS message FROM events WHERE {K} = 4
    UNION ALL SELECT event_id, 'repository.full_name', 'Invalid GitHub repository format' FROM events WHERE {K} = 5
    UNION ALL SELECT event_id, 'action', 'Invalid enum value' FROM events WHERE {K} NOT IN (1, 2, 3, 4, 6) AND event_type = 'error'""",
)
def webhook_errors(t):
    return ops.webhook_errors(t["webhook_events"])


@query(
    "webhook_route",
    f"""SELECT event_id, CASE WHEN NOT {VALID} THEN 'rejected' WHEN event_type = 'purchase' THEN 'ignored' ELSE 'queued' END AS route,
    CASE WHEN NOT {VALID} THEN NULL WHEN event_type = 'purchase' THEN 'ignored' ELSE {JOB} END AS job_id,
    CASE WHEN NOT {VALID} THEN NULL WHEN event_type = 'purchase' THEN 'cancelled' ELSE 'queued' END AS status,
    CASE WHEN {FIRST} IS NOT NULL THEN {FIRST} WHEN {K} = 4 THEN 'Invalid JSON in request body' WHEN event_type = 'error' THEN 'Invalid enum value'
     WHEN {K} = 5 THEN 'Invalid GitHub repository format' WHEN event_type = 'purchase' THEN 'Action ''closed'' is not reviewable' ELSE 'PR review job created successfully' END AS message FROM events""",
)
def webhook_route(t):
    return ops.route(t["webhook_events"]).select("event_id", "route", "job_id", "status", "message")


@query(
    "pr_events",
    f"""SELECT event_id, 'org/repo' || (user_id % 5) AS repository, event_id + 1 AS pr_number, {ACTION} AS action, 'd-' || event_id AS delivery_id FROM events WHERE {VALID}""",
)
def pr_events(t):
    return ops.pr_events(t["webhook_events"]).select("event_id", "repository", "pr_number", "action", "delivery_id")


@query(
    "queue_handoff",
    f"""SELECT {JOB} AS job_id, 'org/repo' || (user_id % 5) AS repository, event_id + 1 AS "prNumber", 'pr-review' AS "jobType",
    '{{"requestId":"req-' || event_id || '","timestamp":"' || strftime(date_trunc('milliseconds', ts), '%Y-%m-%dT%H:%M:%S.%g') || 'Z","source":"pr-receptor","payload":{{"jobId":"' || {JOB} || '","action":"' || {ACTION}
    || '","repository":"org/repo' || (user_id % 5) || '","prNumber":' || (event_id + 1) || '}},"metadata":{{"retryCount":0,"correlationId":"req-' || event_id || '"}}}}' AS body
    FROM events WHERE {VALID} AND event_type <> 'purchase'""",
)
def queue_handoff(t):
    path = scratch_path(t.spark, "queue")
    ops.envelopes(ops.route(t["webhook_events"])).write.mode("append").parquet(path)
    return t.spark.read.parquet(path)


@query(
    "validate_messages",
    """SELECT o_orderkey AS message_id, u.p AS path FROM orders, LATERAL (SELECT unnest(CASE o_orderkey % 9 WHEN 1 THEN ['requestId'] WHEN 2 THEN ['timestamp'] WHEN 3 THEN ['source']
    WHEN 4 THEN ['payload'] WHEN 5 THEN ['payload.jobId'] WHEN 6 THEN ['payload.sha', 'payload.title'] WHEN 7 THEN ['metadata'] WHEN 8 THEN ['body'] ELSE [] END) AS p) u""",
)
def validate_messages(t):
    return ops.message_errors(t["process_messages"]).select("message_id", "path")


@query(
    "batch_summary",
    f"""SELECT event_id // 10 AS batch_id, count(*) AS size, count(*) FILTER ({VALID}) AS successes, count(*) FILTER (NOT {VALID}) AS failures,
    coalesce(string_agg(CASE WHEN NOT {VALID} THEN event_id::VARCHAR END, ',' ORDER BY event_id), '') AS failed_ids FROM events GROUP BY 1""",
)
def batch_summary(t):
    routed = ops.route(t["webhook_events"])
    results = routed.select(
        F.floor(F.col("event_id") / 10).alias("batch_id"), F.col("event_id").alias("message_id"), (F.col("route") == "rejected").alias("failed")
    )
    return ops.batch_summary(results)


@query(
    "dead_letters",
    "SELECT queue, message_id, count(*) AS receives FROM message_receives GROUP BY 1, 2 HAVING count(*) >= CASE queue WHEN 'index' THEN 2 ELSE 3 END",
)
def dead_letters(t):
    return ops.dead_letters(t["message_receives"])


@query(
    "job_transitions",
    """WITH s AS (SELECT *, lag(status) OVER (PARTITION BY job_id ORDER BY ts, event_id) AS previous FROM job_events)
    SELECT event_id, job_id, previous, status, previous IS NULL OR (previous || '>' || status) IN ('queued>processing', 'queued>failed', 'queued>cancelled', 'processing>completed', 'processing>failed', 'failed>queued') AS valid,
    CASE previous WHEN 'queued' THEN 'processing,failed,cancelled' WHEN 'processing' THEN 'completed,failed' WHEN 'failed' THEN 'queued' ELSE '' END AS allowed FROM s""",
)
def job_transitions(t):
    return ops.job_transitions(t["job_events"])


AS_OF = "2024-03-31 06:00:00"


@query(
    "jobs_by_status",
    f"""SELECT job_id, arg_max(status, (ts, event_id)) AS status, epoch(date_trunc('second', min(ts)))::BIGINT + 7776000 AS ttl FROM job_events GROUP BY job_id
    HAVING epoch(date_trunc('second', min(ts)))::BIGINT + 7776000 > epoch(TIMESTAMP '{AS_OF}')::BIGINT""",
)
def jobs_by_status(t):
    return ops.live_jobs(t["job_events"], AS_OF)


@query(
    "retry_schedule",
    """SELECT event_id, attempt, CASE WHEN attempt = 0 THEN 0 ELSE least(2 * 2 ** (attempt - 1), 60) END::BIGINT AS queue_delay_s, least(2000 * 2 ** attempt, 60000)::BIGINT AS worker_min_ms,
    (least(2000 * 2 ** attempt, 60000) + 1000)::BIGINT AS worker_max_ms, (least(1000 * 2 ** attempt, 30000) // 2)::BIGINT AS helper_min_ms, least(1000 * 2 ** attempt, 30000)::BIGINT AS helper_max_ms, attempt < 2 AS helper_retries
    FROM (SELECT event_id, event_id % 8 AS attempt FROM error_events) a""",
)
def retry_schedule(t):
    return ops.retry_schedule(t["error_events"].select("event_id", (F.col("event_id") % 8).alias("attempt")))


CLASSIFIED = """SELECT event_id, name, message, CASE event_id % 8 WHEN 0 THEN 'THROTTLING_ERROR' WHEN 1 THEN 'RESOURCE_NOT_FOUND' WHEN 2 THEN 'GITHUB_RATE_LIMIT' WHEN 3 THEN 'JSON_PARSE_ERROR'
 WHEN 4 THEN 'TIMEOUT_ERROR' WHEN 5 THEN 'NETWORK_ERROR' WHEN 6 THEN 'RESOURCE_EXHAUSTED' ELSE 'INTERNAL_ERROR' END AS code,
 CASE event_id % 8 WHEN 0 THEN 429 WHEN 1 THEN 404 WHEN 2 THEN 429 WHEN 3 THEN 400 WHEN 4 THEN 504 WHEN 5 THEN 502 WHEN 6 THEN 503 ELSE 500 END AS status FROM error_events"""


@query("classify_errors", f"SELECT event_id, code, status FROM ({CLASSIFIED}) c")
def classify_errors(t):
    return ops.classify_errors(t["error_events"]).select("event_id", "code", "status")


@query("retryable_errors", f"SELECT event_id, event_id % 8 = 5 AS retryable, event_id % 8 = 0 AS retryable_by_standard FROM ({CLASSIFIED}) c")
def retryable_errors(t):
    return ops.with_retryable(ops.classify_errors(t["error_events"])).select("event_id", "retryable", "retryable_by_standard")


@query(
    "service_metrics",
    """SELECT date_trunc('hour', ts)::VARCHAR AS window_start, service, metric, count(*) AS n, round(sum(value), 4) AS total, round(avg(value), 4) AS mean FROM metric_events GROUP BY 1, 2, 3""",
)
def service_metrics(t):
    found = ops.service_metrics(t["metric_events"])
    start = F.date_format("window_start", "yyyy-MM-dd HH:mm:ss")
    return found.select(start.alias("window_start"), "service", "metric", "n", F.round("total", 4).alias("total"), F.round("mean", 4).alias("mean"))


ALARMS = {"view": (">", 50.0, 2, "breaching"), "error": (">", 60.0, 2, "notBreaching"), "click": ("<", 30.0, 3, "breaching")}


@query(
    "metric_alarms",
    """WITH m AS (SELECT metric, (epoch(ts)::BIGINT - CASE WHEN epoch(ts) < epoch(ts)::BIGINT THEN 1 ELSE 0 END) // 300 * 300 AS period, avg(value) AS mean FROM metric_events WHERE metric IN ('view', 'error', 'click') GROUP BY 1, 2),
    s AS (SELECT metric, unnest(generate_series(min(period), max(period), 300)) AS period FROM m GROUP BY metric),
    f AS (SELECT s.metric, s.period, m.mean, CASE s.metric WHEN 'view' THEN coalesce(m.mean > 50, true) WHEN 'error' THEN coalesce(m.mean > 60, false) ELSE coalesce(m.mean < 30, true) END AS breaching
     FROM s LEFT JOIN m ON m.metric = s.metric AND m.period = s.period),
    w AS (SELECT *, sum(breaching::INT) OVER (PARTITION BY metric ORDER BY period ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) AS two, sum(breaching::INT) OVER (PARTITION BY metric ORDER BY period ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS three FROM f)
    SELECT metric, period::BIGINT AS period, round(mean, 4) AS mean, breaching, CASE metric WHEN 'click' THEN three = 3 ELSE two = 2 END AS alarm FROM w""",
)
def metric_alarms(t):
    found = ops.metric_alarms(t["metric_events"], ALARMS)
    return found.select("metric", F.unix_seconds("period_start").alias("period"), F.round("mean", 4).alias("mean"), "breaching", "alarm")


@query(
    "latency_summary",
    """WITH r AS (SELECT *, row_number() OVER (PARTITION BY metric ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY metric) AS n FROM metric_events)
    SELECT metric AS query, round(avg(value), 4) AS mean, max(CASE WHEN i = floor(n * 0.95) THEN value END) AS p95,
    round(count(*) / ((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6), 9) AS throughput FROM r GROUP BY metric""",
)
def latency_summary(t):
    rows = t["metric_events"].select(F.col("metric").alias("query"), F.col("value").alias("duration"), "ts")
    found = ops.latency_summary(rows)
    return found.select("query", F.round("mean", 4).alias("mean"), "p95", F.round("throughput", 9).alias("throughput"))


@query(
    "latency_sketch",
    """SELECT metric AS query, count(DISTINCT date_trunc('hour', ts))::BIGINT AS windows, count(*) AS n, round(avg(value), 4) AS mean,
    round(count(*) / ((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6), 9) AS throughput, true AS p50_within, true AS p95_within, true AS p99_within FROM metric_events GROUP BY metric""",
)
def latency_sketch(t):
    """Windows stored, then merged; each percentile's true rank is compared with the error stated for sketches of half their size."""
    rows = t["metric_events"].select(F.col("metric").alias("query"), F.col("value").alias("duration"), "ts")
    merged = sketches.merged_latency(t.stored("latency-windows", lambda: sketches.latency_windows(rows)))
    within = sketches.within_rank(merged, rows, sketches.rank_error(sketches.K // 2))
    return merged.join(within, "query").select("query", "windows", "n", F.round("mean", 4).alias("mean"), F.round("throughput", 9).alias("throughput"), "p50_within", "p95_within", "p99_within")
