"""Webhooks, queue messages, jobs, errors and metrics. The same functions run on tables and on streams, unless a
docstring says otherwise."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from code_impact.functions import checks
from code_impact.functions.arrays import each, with_once
from code_impact.functions.ordered import element_at_share, with_previous

# Answers to requests.
MESSAGES = {
    "method": "Only POST method is allowed",
    "body": "Request body is required",
    "header": "X-GitHub-Event header is required",
    "event": "Only pull_request events are supported",
    "json": "Invalid JSON in request body",
    "created": "PR review job created successfully",
}

# Receives after which a message is set aside, per queue.
MAX_RECEIVES = {"index": 2, "process": 3}

# Allowed steps of a job.
TRANSITIONS = {
    "queued": ["processing", "failed", "cancelled"],
    "processing": ["completed", "failed"],
    "completed": [],
    "failed": ["queued"],
    "cancelled": [],
}

_BODY = (
    "action string, number bigint, pull_request struct<number:bigint,title:string,html_url:string,head:struct<sha:string>,"
    "user:struct<login:string>>, repository struct<full_name:string>, _bad string"
)


def _json(text: Column, schema: str) -> Column:
    return F.from_json(text, schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})


# Requests ------------------------------------------------------------------------------------------------------------


def check_requests(requests: DataFrame) -> DataFrame:
    """Add ``request_error``, the first failed check of a request, null when it may be parsed."""
    tests = [
        ("http_method", F.col("http_method") == "POST", MESSAGES["method"]),
        ("body", checks.filled(F.col("body")), MESSAGES["body"]),
        ("github_event", checks.filled(F.col("github_event")), MESSAGES["header"]),
        ("github_event", F.col("github_event") == "pull_request", MESSAGES["event"]),
    ]
    return requests.withColumn("request_error", checks.first_failure(tests))


def check_bodies(requests: DataFrame) -> DataFrame:
    """Parse the bodies of accepted requests; add ``payload`` and ``body_errors``."""
    accepted = check_requests(requests)
    parsed = with_once(accepted, "payload", F.when(F.col("request_error").isNull(), _json(F.col("body"), _BODY)))
    p = F.col("payload")
    readable = p.isNotNull() & p["_bad"].isNull()
    tests = [
        ("action", p["action"].isin(checks.ACTIONS), "Invalid enum value"),
        ("number", checks.positive(p["number"]), "PR number must be positive"),
        ("pull_request", p["pull_request"].isNotNull(), "Required"),
        ("pull_request.number", p["pull_request"].isNull() | checks.positive(p["pull_request"]["number"]), "PR number must be positive"),
        ("repository", p["repository"].isNotNull(), "Required"),
        ("repository.full_name", p["repository"].isNull() | p["repository"]["full_name"].rlike(checks.REPOSITORY), "Invalid GitHub repository format"),
    ]
    unreadable = F.array(F.struct(F.lit("body").alias("path"), F.lit(MESSAGES["json"]).alias("message")))
    none = F.slice(unreadable, 1, 0)
    errors = F.when(F.col("request_error").isNotNull(), none).when(~readable, unreadable).otherwise(checks.failures(tests))
    return parsed.withColumn("body_errors", errors)


def webhook_errors(requests: DataFrame) -> DataFrame:
    rows = check_bodies(requests).select("event_id", F.explode(each(F.col("body_errors"))).alias("e"))
    return rows.select("event_id", "e.path", "e.message")


def name_uuid(name: Column) -> Column:
    """A UUID made from a name, so that a replayed request keeps its job."""
    h = F.md5(name)
    return F.concat(
        F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-3"), F.substring(h, 14, 3), F.lit("-8"), F.substring(h, 18, 3),
        F.lit("-"), F.substring(h, 21, 12),
    )


def route(requests: DataFrame) -> DataFrame:
    """Each request to queued, ignored or rejected, with its job, status and answer."""
    checked = check_bodies(requests)
    p = F.col("payload")
    valid = F.col("request_error").isNull() & (F.size("body_errors") == 0)
    where = F.when(~valid, "rejected").when(p["action"].isin(checks.REVIEWABLE_ACTIONS), "queued").when(
        p["action"].isin(checks.IGNORABLE_ACTIONS), "ignored"
    ).otherwise("rejected")
    routed = checked.withColumn("route", where)
    # A request without a delivery id is named after its event and body.
    own = F.concat_ws(" ", F.col("event_id").cast("string"), F.to_json("payload"))
    queued, ignored = F.col("route") == "queued", F.col("route") == "ignored"
    answer = (
        F.when(queued, MESSAGES["created"])
        .when(ignored, F.concat(F.lit("Action '"), p["action"], F.lit("' is not reviewable")))
        .otherwise(F.coalesce("request_error", F.get("body_errors", F.lit(0))["message"]))
    )
    return routed.select(
        "event_id", "received_at", "delivery_id", "route",
        F.when(queued, name_uuid(F.coalesce(F.nullif("delivery_id", F.lit("")), own))).when(ignored, "ignored").alias("job_id"),
        F.when(queued, "queued").when(ignored, "cancelled").alias("status"),
        answer.alias("message"),
        p["repository"]["full_name"].alias("repository"),
        p["pull_request"]["number"].alias("pr_number"),
        p["action"].alias("action"),
    )


def pr_events(requests: DataFrame) -> DataFrame:
    """Pull-request data of valid requests."""
    p = F.col("payload")
    valid = check_bodies(requests).where(F.col("request_error").isNull() & (F.size("body_errors") == 0))
    return valid.select(
        "event_id", p["repository"]["full_name"].alias("repository"), p["pull_request"]["number"].alias("pr_number"),
        p["action"].alias("action"), p["pull_request"]["head"]["sha"].alias("sha"), p["pull_request"]["title"].alias("title"),
        p["pull_request"]["user"]["login"].alias("author"), F.nullif("delivery_id", F.lit("")).alias("delivery_id"),
        p["pull_request"]["html_url"].alias("pr_url"),
    )


def envelopes(routed: DataFrame) -> DataFrame:
    """Queue messages of queued requests: the body and its attributes as columns."""
    request = F.concat(F.lit("req-"), F.col("event_id").cast("string"))
    payload = F.struct(F.col("job_id").alias("jobId"), "action", "repository", F.col("pr_number").alias("prNumber"))
    metadata = F.struct(F.lit(0).alias("retryCount"), F.col("requestId").alias("correlationId"))
    rows = routed.where(F.col("route") == "queued").withColumn("requestId", request)
    stamp = F.date_format(F.col("received_at").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    body = F.to_json(
        F.struct("requestId", stamp.alias("timestamp"), F.lit("pr-receptor").alias("source"), payload.alias("payload"), metadata.alias("metadata"))
    )
    return rows.select(
        "job_id", "repository", F.col("pr_number").alias("prNumber"), F.lit("pr-review").alias("jobType"), body.alias("body")
    )


_MESSAGE = (
    "requestId string, timestamp string, source string, payload struct<jobId:string,repository:string,prNumber:bigint,action:string,"
    "sha:string,title:string,author:string,githubDeliveryId:string,prUrl:string>, metadata map<string,string>, _bad string"
)


def message_errors(messages: DataFrame) -> DataFrame:
    """Failed checks of strict process messages (``message_id``, ``body``), one row each."""
    m = F.col("m")
    parsed = with_once(messages, "m", _json(F.col("body"), _MESSAGE))
    p, has_payload, has_meta = m["payload"], m["payload"].isNotNull(), m["metadata"].isNotNull()
    inside = lambda ok: ~has_payload | F.coalesce(ok, F.lit(False))
    tests = [
        ("requestId", checks.filled(m["requestId"]), "Request ID cannot be empty"),
        ("timestamp", m["timestamp"].rlike(checks.TIMESTAMP), "Invalid timestamp format"),
        ("source", m["source"] == "pr-receptor", "Invalid literal value"),
        ("payload", has_payload, "Required"),
        ("payload.jobId", inside(p["jobId"].rlike(checks.UUID)), "Invalid UUID format"),
        ("payload.repository", inside(p["repository"].rlike(checks.REPOSITORY)), "Invalid GitHub repository format"),
        ("payload.prNumber", inside(checks.positive(p["prNumber"])), "PR number must be positive"),
        ("payload.action", inside(p["action"].isin(checks.ACTIONS)), "Invalid enum value"),
        ("payload.sha", inside(p["sha"].rlike(checks.SHA)), "Invalid SHA format"),
        ("payload.title", inside(checks.filled(p["title"])), "Title cannot be empty"),
        ("payload.author", inside(checks.filled(p["author"])), "Author cannot be empty"),
        ("payload.prUrl", inside(p["prUrl"].rlike(checks.URL)), "Invalid PR URL"),
        ("metadata", has_meta, "Required"),
        ("metadata.retryCount", ~has_meta | F.coalesce(m["metadata"]["retryCount"].rlike(r"^\d+$"), F.lit(False)), "Expected a count"),
        ("metadata.correlationId", ~has_meta | F.coalesce(checks.filled(m["metadata"]["correlationId"]), F.lit(False)), "Required"),
    ]
    unreadable = F.array(F.struct(F.lit("body").alias("path"), F.lit("Invalid JSON in SQS message body").alias("message")))
    errors = F.when(m.isNull() | m["_bad"].isNotNull(), unreadable).otherwise(checks.failures(tests))
    return parsed.select("message_id", F.explode(each(errors)).alias("e")).select("message_id", "e.path", "e.message")


# Batches, retries, jobs ----------------------------------------------------------------------------------------------


def batch_summary(results: DataFrame) -> DataFrame:
    """Size, successes and failures of each queue batch (``batch_id``, ``message_id``, ``failed``). A queue batch holds a
    fixed small number of messages, so the failed ids fit a row."""
    failed = F.col("failed")
    return results.groupBy("batch_id").agg(
        F.count(F.lit(1)).alias("size"),
        F.count_if(~failed).alias("successes"),
        F.count_if(failed).alias("failures"),
        F.array_join(F.array_sort(F.collect_list(F.when(failed, F.col("message_id")))), ",").alias("failed_ids"),
    )


def dead_letters(receives: DataFrame) -> DataFrame:
    """Messages received as often as their queue allows."""
    limit = F.lit(None).cast("int")
    for queue, most in MAX_RECEIVES.items():
        limit = F.when(F.col("queue") == queue, most).otherwise(limit)
    counted = receives.groupBy("queue", "message_id").agg(F.count(F.lit(1)).alias("receives"))
    return counted.where(F.col("receives") >= limit)


def transition_columns(previous: Column, status: Column) -> tuple[Column, Column]:
    """Whether a step is allowed, and the steps that would be. The first status of a job is always accepted."""
    table = F.create_map(*[x for k, v in TRANSITIONS.items() for x in (F.lit(k), F.array(*[F.lit(s) for s in v]).cast("array<string>"))])
    allowed = F.try_element_at(table, previous)
    return previous.isNull() | F.coalesce(F.array_contains(allowed, status), F.lit(False)), F.coalesce(F.array_join(allowed, ","), F.lit(""))


def job_transitions(events: DataFrame) -> DataFrame:
    """Each status event with the status before it and whether the step is allowed. Batch only; see ``streaming.jobs``."""
    timed = events.withColumn("_us", F.unix_micros(F.col("ts").cast("timestamp")))
    rows = with_previous(timed, ["job_id"], F.col("_us"), [F.col("_us"), F.col("event_id")], "status", "previous", F.col("event_id"))
    ok, allowed = transition_columns(F.col("previous"), F.col("status"))
    return rows.select("event_id", "job_id", "previous", "status", ok.alias("valid"), allowed.alias("allowed"))


def live_jobs(events: DataFrame, as_of: str, ttl_days: int = 90) -> DataFrame:
    """Latest status of each job that has not expired on ``as_of``; a job lives ``ttl_days`` from its first event."""
    ts = F.col("ts").cast("timestamp")
    latest = events.groupBy("job_id").agg(F.max_by("status", F.struct(ts, F.col("event_id"))).alias("status"), F.min(ts).alias("_first"))
    ttl = F.unix_seconds("_first") + F.lit(ttl_days * 86400)
    return latest.withColumn("ttl", ttl).where(F.col("ttl") > F.unix_seconds(F.lit(as_of).cast("timestamp"))).drop("_first")


def retry_schedule(attempts: DataFrame) -> DataFrame:
    """Delays of the three retry schedules for a retry count (``attempt``, from 0), jitter as bounds."""
    n = F.col("attempt")
    power = lambda base, e, most: F.least(F.lit(base) * F.pow(F.lit(2.0), e), F.lit(most)).cast("bigint")
    helper = power(1000, n, 30000)
    return attempts.select(
        "*",
        F.when(n == 0, F.lit(0)).otherwise(power(2, n - 1, 60)).cast("bigint").alias("queue_delay_s"),
        power(2000, n, 60000).alias("worker_min_ms"),
        (power(2000, n, 60000) + 1000).alias("worker_max_ms"),
        (helper / 2).cast("bigint").alias("helper_min_ms"),
        helper.alias("helper_max_ms"),
        (n < 2).alias("helper_retries"),
    )


# Errors --------------------------------------------------------------------------------------------------------------

# Codes and statuses by exception name, and by status of the code host.
PLATFORM_ERRORS = {
    "ResourceNotFoundException": ("RESOURCE_NOT_FOUND", 404),
    "ValidationException": ("AWS_VALIDATION_ERROR", 400),
    "AccessDeniedException": ("ACCESS_DENIED", 403),
    "UnauthorizedOperation": ("ACCESS_DENIED", 403),
    "ThrottlingException": ("THROTTLING_ERROR", 429),
    "RequestLimitExceeded": ("THROTTLING_ERROR", 429),
    "ServiceUnavailableException": ("SERVICE_UNAVAILABLE", 503),
    "ModelTimeoutException": ("MODEL_TIMEOUT", 504),
    "ModelNotReadyException": ("MODEL_TIMEOUT", 504),
    "ModelErrorException": ("MODEL_ERROR", 502),
}
HOST_ERRORS = {
    401: ("GITHUB_AUTH_ERROR", 401),
    403: ("GITHUB_FORBIDDEN", 403),
    404: ("GITHUB_NOT_FOUND", 404),
    422: ("GITHUB_VALIDATION_ERROR", 422),
}
# Codes of the service's own errors.
OWN_ERRORS = {
    "ValidationError": ("VALIDATION_ERROR", 400),
    "SchemaValidationError": ("SCHEMA_VALIDATION_ERROR", 400),
    "AuthenticationError": ("AUTHENTICATION_ERROR", 401),
    "AuthorizationError": ("AUTHORIZATION_ERROR", 403),
    "NotFoundError": ("NOT_FOUND_ERROR", 404),
    "ConflictError": ("CONFLICT_ERROR", 409),
    "InvalidStateError": ("INVALID_STATE_ERROR", 400),
    "ExternalServiceError": ("EXTERNAL_SERVICE_ERROR", 502),
    "GitHubAPIError": ("GITHUB_API_ERROR", 502),
    "DynamoDBError": ("DYNAMODB_ERROR", 502),
    "SQSError": ("SQS_ERROR", 502),
    "BedrockError": ("BEDROCK_ERROR", 502),
    "ProcessingError": ("PROCESSING_ERROR", 500),
    "TimeoutError": ("TIMEOUT_ERROR", 408),
    "RateLimitError": ("RATE_LIMIT_ERROR", 429),
}
RETRYABLE_CODES = ["TIMEOUT_ERROR", "THROTTLING_ERROR", "NETWORK_ERROR"]
RETRYABLE_WORDS = ["timeout", "network", "connection", "econnreset"]
RETRYABLE_STANDARD = ["ECONNREFUSED", "ETIMEDOUT", "ThrottlingException", "ProvisionedThroughputExceededException"]


def classify_errors(errors: DataFrame) -> DataFrame:
    """Code and status of each error (``name``, ``message``, ``http_status``). Own errors, then named platform errors,
    then the code host, then what the message says, then any other exception of the platform."""
    name, low, http = F.col("name"), F.lower("message"), F.col("http_status")
    pair = lambda code, status: F.struct(F.lit(code).alias("code"), F.lit(status).cast("int").alias("status"))
    says = lambda *words: low.rlike("|".join(words))
    own_host = F.struct(F.lit("GITHUB_API_ERROR").alias("code"), F.coalesce(http, F.lit(502)).cast("int").alias("status"))
    rules = [(name == "GitHubAPIError", own_host)]
    rules += [(name == n, pair(*v)) for n, v in {**OWN_ERRORS, **PLATFORM_ERRORS}.items()]
    host = http.isNotNull() | name.isin("HttpError", "RequestError")
    rules.append((host & (http == 403) & F.contains("message", F.lit("rate limit")), pair("GITHUB_RATE_LIMIT", 429)))
    rules += [(host & (http == s), pair(*v)) for s, v in HOST_ERRORS.items()]
    rules += [
        (host, pair("GITHUB_API_ERROR", 502)),
        (says("timeout", "timed out"), pair("TIMEOUT_ERROR", 504)),
        (says("network", "connection", "econnreset", "enotfound"), pair("NETWORK_ERROR", 502)),
        ((F.lower("name") == "syntaxerror") & says("json"), pair("JSON_PARSE_ERROR", 400)),
        (says("out of memory", "heap"), pair("RESOURCE_EXHAUSTED", 503)),
        (F.contains("name", F.lit("Exception")), pair("AWS_ERROR", 502)),
    ]
    found = F.coalesce(*[F.when(F.coalesce(test, F.lit(False)), result) for test, result in rules], pair("INTERNAL_ERROR", 500))
    return errors.withColumn("_c", found).select(*errors.columns, "_c.code", F.col("_c.status").alias("status"))


def with_retryable(classified: DataFrame) -> DataFrame:
    """Add whether an error is worth a retry, by code or by message, and whether the standard list names it."""
    low = F.lower("message")
    words = low.rlike("|".join(RETRYABLE_WORDS))
    own = F.col("name").isin(list(OWN_ERRORS))
    by_code = (F.col("status") >= 500) | F.col("code").isin(RETRYABLE_CODES)
    return classified.withColumn("retryable", F.when(own, by_code).otherwise(words)).withColumn(
        "retryable_by_standard", F.col("name").isin(RETRYABLE_STANDARD)
    )


# Metrics -------------------------------------------------------------------------------------------------------------


def service_metrics(events: DataFrame, width: str = "1 hour") -> DataFrame:
    """Count, sum and mean per window, service and metric."""
    # A watermark belongs to the bare column, so a stream must bring real timestamps.
    ts = F.col("ts") if events.schema["ts"].dataType.typeName() == "timestamp" else F.col("ts").cast("timestamp")
    window = F.window(ts, width)
    grouped = events.groupBy(window.alias("w"), "service", "metric").agg(
        F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"), F.avg("value").alias("mean")
    )
    return grouped.select(F.col("w.start").alias("window_start"), "service", "metric", "n", "total", "mean")


# Periods of one metric that are looked at together.
CHUNK = 1024


def metric_alarms(metrics: DataFrame, alarms: dict[str, tuple[str, float, int, str]], period_s: int = 300) -> DataFrame:
    """State of each alarm per period. An alarm is (comparison, threshold, periods, missing): it rings when the mean breaks
    the threshold in that many periods in a row; a period without data counts as ``missing`` says.

    The means are aggregated first. Time is cut into chunks of ``CHUNK`` periods, each with the periods an alarm looks back on,
    so that windows run per metric and chunk and no array holds the whole span of a metric.
    """
    wanted = metrics.where(F.col("metric").isin(list(alarms)))
    epoch = F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / period_s)
    means = wanted.groupBy("metric", epoch.alias("period")).agg(F.avg("value").alias("mean"))
    span = means.groupBy("metric").agg(F.min("period").alias("a"), F.max("period").alias("b"))
    most = max(count for _, _, count, _ in alarms.values())
    chunks = span.select("metric", "a", "b", F.explode(F.sequence(F.floor(F.col("a") / CHUNK), F.floor(F.col("b") / CHUNK))).alias("chunk"))
    chunks = chunks.repartition("metric", "chunk")
    begin, end = F.col("chunk") * CHUNK, (F.col("chunk") + 1) * CHUNK - 1
    inside = F.sequence(F.greatest("a", begin - (most - 1)), F.least("b", end))
    periods = chunks.select("metric", "chunk", begin.alias("begin"), F.explode(inside).alias("period"))
    filled = periods.join(means, ["metric", "period"], "left")
    breaks, needed = F.lit(False), F.lit(1)
    for metric, (comparison, threshold, count, missing) in alarms.items():
        over = F.col("mean") > threshold if comparison == ">" else F.col("mean") < threshold
        test = F.coalesce(over, F.lit(missing == "breaching"))
        breaks = F.when(F.col("metric") == metric, test).otherwise(breaks)
        needed = F.when(F.col("metric") == metric, count).otherwise(needed)
    ordered = Window.partitionBy("metric", "chunk").orderBy("period")
    state = filled.withColumn("breaching", breaks).withColumn("_needed", needed)
    broken = lambda n: F.count_if(F.col("breaching")).over(ordered.rowsBetween(-(n - 1), 0)) == n
    rings = F.lit(False)
    for n in range(1, most + 1):
        rings = F.when(F.col("_needed") == n, broken(n)).otherwise(rings)
    found = state.withColumn("alarm", rings).where("period >= begin")
    return found.select("metric", F.timestamp_seconds(F.col("period") * period_s).alias("period_start"), "mean", "breaching", "alarm")


def alarm_tests(alarms: dict[str, tuple[str, float, int, str]]) -> dict[str, tuple[Callable[[float | None], bool], int]]:
    """Per metric, whether a mean (None: no data) breaks the threshold, and how many periods must."""

    def test(comparison: str, threshold: float, missing: str) -> Callable[[float | None], bool]:
        def breaks(mean: float | None) -> bool:
            if mean is None or mean != mean:
                return missing == "breaching"
            return mean > threshold if comparison == ">" else mean < threshold

        return breaks

    return {m: (test(comparison, threshold, missing), count) for m, (comparison, threshold, count, missing) in alarms.items()}


def latency_summary(durations: DataFrame) -> DataFrame:
    """Mean, 95th percentile element and throughput per query (``query``, ``duration``, ``ts``)."""
    seconds = (F.unix_micros(F.max("ts")) - F.unix_micros(F.min("ts"))) / 1e6
    timed = durations.withColumn("ts", F.col("ts").cast("timestamp"))
    totals = timed.groupBy("query").agg(F.avg("duration").alias("mean"), (F.count(F.lit(1)) / seconds).alias("throughput"))
    return totals.join(element_at_share(durations, ["query"], "duration", 0.95, "p95"), "query")
