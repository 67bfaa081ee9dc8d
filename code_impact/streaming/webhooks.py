"""Webhook requests as a stream: the checks and routes of ``operators.events`` with one sink per route."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from code_impact.operators import events

REQUEST_SCHEMA = "event_id bigint, received_at timestamp, http_method string, github_event string, delivery_id string, body string"


def read_requests(spark: SparkSession, folder: str, files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(REQUEST_SCHEMA)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.json(folder)


def _sink(root: str, name: str, batch_id: int) -> str:
    return f"{root}/{name}/batch={batch_id}"


def route_requests(requests: DataFrame, root: str, checkpoint: str) -> StreamingQuery:
    """Write queued messages, ignored and rejected requests to three tables under ``root``.

    Every micro-batch replaces its own folder, so a batch run again after a failure leaves no copies.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        routed = events.route(batch).persist()
        try:
            events.envelopes(routed).write.mode("overwrite").parquet(_sink(root, "queued", batch_id))
            for name in ("ignored", "rejected"):
                rows = routed.where(F.col("route") == name).select("event_id", "job_id", "status", "message")
                rows.write.mode("overwrite").parquet(_sink(root, name, batch_id))
        finally:
            routed.unpersist()

    writer = requests.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start()


def split_failures(messages: DataFrame, root: str, checkpoint: str) -> StreamingQuery:
    """Strictly valid messages go on, the others return for a retry with their failed paths."""

    def write(batch: DataFrame, batch_id: int) -> None:
        kept = batch.persist()
        try:
            failed = events.message_errors(kept).groupBy("message_id").agg(F.array_sort(F.collect_list("path")).alias("failed_paths"))
            kept.join(failed, "message_id", "left_anti").write.mode("overwrite").parquet(_sink(root, "accepted", batch_id))
            kept.join(failed, "message_id").write.mode("overwrite").parquet(_sink(root, "retry", batch_id))
        finally:
            kept.unpersist()

    writer = messages.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start()
