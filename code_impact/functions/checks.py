"""Row validation: named checks that yield an array of failures."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns of identifiers.
UUID = r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[1-5][0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$"
REPOSITORY = r"^[a-zA-Z0-9_.-]+/[a-zA-Z0-9_.-]+$"
SHA = r"^[a-f0-9]{40}$"
REQUEST_ID = r"^[a-zA-Z0-9-_]+$"
TIMESTAMP = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?Z$"
URL = r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^\s]+$"

# Accepted values of enumerations.
ACTIONS = ["opened", "closed", "reopened", "edited", "synchronize", "ready_for_review", "draft"]
REVIEWABLE_ACTIONS = ["opened", "synchronize", "ready_for_review"]
IGNORABLE_ACTIONS = ["closed", "edited", "reopened", "draft"]
JOB_STATUSES = ["queued", "processing", "completed", "failed", "cancelled"]

Check = tuple[str, Column, str]


def failures(checks: list[Check]) -> Column:
    """Array of (path, message) of the checks whose condition is not true. A null condition is a failure."""
    hits = [
        F.when(~F.coalesce(ok, F.lit(False)), F.struct(F.lit(path).alias("path"), F.lit(message).alias("message")))
        for path, ok, message in checks
    ]
    return F.array_compact(F.array(*hits))


def first_failure(checks: list[Check]) -> Column:
    """Message of the first check that is not true, null when all are."""
    return F.coalesce(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(message)) for _, ok, message in checks])


def matches(value: Column, pattern: str) -> Column:
    return value.rlike(pattern)


def filled(value: Column) -> Column:
    return F.length(value) >= 1


def positive(value: Column) -> Column:
    return value > 0


def optional(ok: Column, value: Column) -> Column:
    return value.isNull() | ok
