"""Streams give what the batch functions give on the same rows."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from code_impact.operators import events
from code_impact.sources.tables import Inputs
from code_impact.streaming import jobs, webhooks


def drain(df, tmp_path, name, mode):
    query = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name))
    query = query.trigger(availableNow=True).start()
    query.awaitTermination()
    assert query.exception() is None
    return df.sparkSession.table(name)


def source(spark, rows, folder, order):
    """Rows as several files, in order, read as a stream one file at a time."""
    for n, bounds in enumerate([(0, 400), (400, 700), (700, 10**9)]):
        part = rows.where((F.col(order) >= bounds[0]) & (F.col(order) < bounds[1]))
        part.coalesce(1).write.mode("append").parquet(str(folder / f"{n}"))
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(folder))


def test_webhooks(spark, folder, tmp_path):
    requests = Inputs(spark, folder)["webhook_events"].withColumn("received_at", F.col("received_at").cast("timestamp"))
    requests.repartition(4).write.json(str(tmp_path / "in"))
    stream = webhooks.read_requests(spark, str(tmp_path / "in"), 1)
    webhooks.route_requests(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    routed = events.route(requests)
    queued = spark.read.parquet(str(tmp_path / "out" / "queued")).drop("batch")
    expected = {tuple(r) for r in events.envelopes(routed).select("job_id", "repository", "prNumber").collect()}
    assert {tuple(r) for r in queued.select("job_id", "repository", "prNumber").collect()} == expected
    for name in ("ignored", "rejected"):
        found = spark.read.parquet(str(tmp_path / "out" / name)).select("event_id", "message").collect()
        assert {tuple(r) for r in found} == {tuple(r) for r in routed.where(F.col("route") == name).select("event_id", "message").collect()}


def test_partial_failures(spark, folder, tmp_path):
    messages = Inputs(spark, folder)["process_messages"]
    stream = source(spark, messages, tmp_path / "in", "message_id")
    webhooks.split_failures(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    retry = {r["message_id"] for r in spark.read.parquet(str(tmp_path / "out" / "retry")).collect()}
    accepted = {r["message_id"] for r in spark.read.parquet(str(tmp_path / "out" / "accepted")).collect()}
    assert retry == {r["message_id"] for r in events.message_errors(messages).collect()}
    assert len(retry) + len(accepted) == messages.count() and not retry & accepted


def arriving(spark, rows, folder, schema):
    """A stream of one file per list of rows, in that order."""
    for n, part in enumerate(rows):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(str(folder / f"{n}"))
    found = spark.read.parquet(*[str(folder / f"{n}") for n in range(len(rows))])
    return found, spark.readStream.schema(found.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(folder))


def test_job_transitions(spark, folder, tmp_path):
    """Events arrive out of order by less than the lateness; each is judged against the one before it in time."""
    at = lambda minute: datetime(2024, 1, 1) + timedelta(minutes=minute)
    rows = [
        [(2, 1, at(20), "processing"), (1, 1, at(0), "queued"), (11, 2, at(5), "completed")],
        [(4, 1, at(50), "queued"), (10, 2, at(1), "queued"), (3, 1, at(35), "failed")],
        [(12, 2, at(70), "queued"), (5, 1, at(60), "completed"), (6, 1, at(61), None)],
        [(20, 3, at(500), "queued")],
        [(21, 3, at(2000), "processing")],
    ]
    every, stream = arriving(spark, rows, tmp_path / "in", "event_id long, job_id long, ts timestamp, status string")
    found = drain(jobs.job_transitions(stream, "1 hour"), tmp_path, "transitions", "append")
    columns = ["event_id", "job_id", "previous", "status", "valid", "allowed"]
    expected = {tuple(r) for r in events.job_transitions(every).select(columns).collect() if r["event_id"] < 21}
    assert {tuple(r) for r in found.select(columns).collect()} == expected


def test_alarms(spark, folder, tmp_path):
    at = lambda minute: datetime(2024, 1, 1) + timedelta(minutes=minute)
    alarms = {"a": (">", 5.0, 2, "breaching"), "b": ("<", 3.0, 2, "ok")}
    rows = [
        [(at(6), "a", 9.0), (at(1), "a", 7.0), (at(3), "b", 1.0), (at(7), "b", 2.0)],
        [(at(2), "a", 4.0), (at(31), "a", 1.0), (at(22), "b", 2.5)],
        [(at(900), "a", 9.0), (at(905), "b", 1.0)],
    ]
    every, stream = arriving(spark, rows, tmp_path / "in", "ts timestamp, metric string, value double")
    means = jobs.period_mean_stream(stream, list(alarms))
    means.writeStream.option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start(str(tmp_path / "means")).awaitTermination()
    closed = spark.readStream.schema(means.schema).parquet(str(tmp_path / "means"))
    found = drain(jobs.alarm_stream(closed, alarms), tmp_path, "alarms", "append")
    key = lambda r: (r["metric"], r["period_start"], r["mean"], r["breaching"], r["alarm"])
    closed = {key(r) for r in found.collect()}
    batch = {key(r) for r in events.metric_alarms(every.where(F.col("ts") < F.lit(at(60))), alarms).collect()}
    assert closed == batch and any(r[4] for r in closed)


def test_dead_letters(spark, folder, tmp_path):
    """Counts carry over batches, and end when the queue has forgotten the message."""
    day = lambda n: datetime(2024, 1, 1) + timedelta(days=n)
    rows = [
        [(1, day(0), "index"), (2, day(0), "process"), (3, day(0), "process"), (5, day(0), "index"), (6, day(0), "other")],
        [(1, day(1), "index"), (2, day(2), "process"), (2, day(1.5), "process"), (3, day(1), "process")],
        [(4, day(40), "process")],
        [(5, day(41), "index"), (4, day(41), "process"), (4, day(42), "process")],
    ]
    every, stream = arriving(spark, rows, tmp_path / "in", "message_id long, received_at timestamp, queue string")
    found = drain(jobs.dead_letter_stream(stream, "3 days"), tmp_path, "letters", "update")
    last = {(r["queue"], r["message_id"]): r["receives"] for r in found.groupBy("queue", "message_id").agg(F.max("receives").alias("receives")).collect()}
    assert last == {(r["queue"], r["message_id"]): r["receives"] for r in events.dead_letters(every).collect() if r["message_id"] != 5}


def test_service_metrics(spark, folder, tmp_path):
    rows = Inputs(spark, folder)["metric_events"].withColumn("ts", F.col("ts").cast("timestamp"))
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    found = drain(jobs.service_metric_stream(stream), tmp_path, "metrics", "append")
    key = ["window_start", "service", "metric", "n"]
    closed = {tuple(r) for r in found.select(key).collect()}
    batch = {tuple(r) for r in events.service_metrics(rows).select(key).collect()}
    assert closed and closed <= batch and len(batch - closed) < 30


def test_latency_sketches_merge_and_stream(spark, tmp_path):
    import random

    from code_impact.operators import sketches
    from code_impact.operators.events import latency_summary

    rng = random.Random(5)
    rows = [(f"q{k % 2}", rng.lognormvariate(0, 2) if k % 2 else float(k % 10), 1_700_000_000 + k * 5) for k in range(20_000)] + [("q0", None, 1_700_000_000), ("one", 7.5, 1_700_000_001)]
    df = spark.createDataFrame(rows, "query string, duration double, s long").select("query", "duration", F.timestamp_seconds("s").alias("ts"))
    stored = str(tmp_path / "batch")
    sketches.latency_windows(df).write.parquet(stored)
    merged = sketches.merged_latency(spark.read.parquet(stored))
    found = {r["query"]: r for r in merged.collect()}
    assert found["one"].p50 == found["one"].p99 == 7.5 and found["one"].throughput is None and found["one"].n == 1
    assert found["q0"].n == 10_000 and found["q0"].windows == 28 and found["q0"].p95 in (8.0, 6.0)
    exact = {r["query"]: r for r in latency_summary(df.where("query = 'q1'")).collect()}
    assert abs(found["q1"].mean - exact["q1"]["mean"]) < 1e-9 and abs(found["q1"].throughput - exact["q1"].throughput) < 1e-9
    within = sketches.within_rank(merged, df, sketches.rank_error(200)).collect()
    assert len(within) == 3 and all(r.p50_within and r.p95_within and r.p99_within for r in within)
    assert sketches.merged_latency(sketches.latency_windows(df.limit(0))).count() == 0

    source, sink = str(tmp_path / "in"), str(tmp_path / "out")
    df.where("query = 'q1'").repartition(3).write.parquet(source)
    late = spark.createDataFrame([("end", 1.0, 1_800_000_000)], "query string, duration double, s long").select("query", "duration", F.timestamp_seconds("s").alias("ts"))
    for extra in (None, late):
        if extra is not None:
            extra.write.mode("append").parquet(source)
        stream = spark.readStream.schema(df.schema).parquet(source).withWatermark("ts", "1 hour")
        writer = sketches.latency_windows(stream).writeStream.format("parquet").option("path", sink).option("checkpointLocation", str(tmp_path / "state"))
        writer.outputMode("append").trigger(availableNow=True).start().awaitTermination()
    streamed = sketches.merged_latency(spark.read.parquet(sink)).where("query = 'q1'")
    row = streamed.first()
    assert row.n == 10_000 and abs(row["mean"] - exact["q1"]["mean"]) < 1e-9
    assert all(sketches.within_rank(streamed, df, sketches.rank_error(200)).where("query = 'q1'").first()[1:])
