"""Jobs over text columns and rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from code_impact.functions import checks
from code_impact.functions.ordered import ranked

INDEX_BATCH = 100
TTL_DAYS = 90


def validate_fields(rows: DataFrame) -> DataFrame:
    """Failed checks of (id, job_id, repository, sha, pr_number, request_id) rows, one row each."""
    tests = [
        ("job_id", checks.matches(F.col("job_id"), checks.UUID), "Invalid UUID format"),
        ("repository", checks.matches(F.col("repository"), checks.REPOSITORY), "Invalid GitHub repository format"),
        ("sha", checks.matches(F.col("sha"), checks.SHA), "Invalid SHA format"),
        ("pr_number", checks.positive(F.col("pr_number")), "PR number must be positive"),
        ("request_id", checks.matches(F.col("request_id"), checks.REQUEST_ID), "Invalid request ID"),
    ]
    return rows.select("id", F.explode(checks.failures(tests)).alias("f")).select("id", "f.path", "f.message")


def batch_rows(rows: DataFrame, keys: list[str], axis: str, size: int = INDEX_BATCH) -> DataFrame:
    """Number rows into batches of ``size`` per key, in order of ``axis``. A key of any size is spread over many tasks.

    Rows with one value of ``axis`` are put in order by a hash of the row, so that they are spread too.
    """
    tie = F.xxhash64(F.to_json(F.struct(*rows.columns)))
    numbered = ranked(rows, keys, F.col(axis), [F.col(axis), tie], "_rank", tie)
    return numbered.withColumn("batch", F.floor((F.col("_rank") - 1) / size)).drop("_rank")


def expires_at(created: Column, days: int = TTL_DAYS) -> Column:
    return F.unix_seconds(created.cast("timestamp")) + F.lit(days * 86400)


def compact_json(columns: list[Column]) -> Column:
    """JSON of the columns without the absent ones."""
    return F.to_json(F.struct(*columns))
