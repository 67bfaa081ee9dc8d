"""Latency percentiles from mergeable sketches: one per window, stored, and merged for any span without the rows.

``events.latency_summary`` is the exact way over all rows. A sketch holds some hundred values whatever the number of rows, and
merging those of all windows is as good as one sketch of all rows: the rank of a percentile it gives is within ``rank_error`` of
the asked one in 99 of 100 cases. Which values a sketch keeps is drawn at random, so estimates differ between runs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Size of a sketch; its error falls with it.
K = 400
SHARES = (0.5, 0.95, 0.99)


def rank_error(k: int = K) -> float:
    """Stated error of a rank, as a share of all rows, for sketches of size ``k`` (Karnin, Lang and Liberty)."""
    return 2.296 / k**0.9723


def latency_windows(durations: DataFrame, width: str = "1 hour", k: int = K) -> DataFrame:
    """(window_start, query, n, total, first, last, sketch) of durations (``query``, ``duration``, ``ts``); missing durations are left out.

    Rows are summed in the tasks that read them, so a query with a third of all rows sends one sketch a task and window. Works on
    a stream with a watermark on ``ts`` too, in append mode.
    """
    ts = F.col("ts") if durations.schema["ts"].dataType.typeName() == "timestamp" else F.col("ts").cast("timestamp")
    value = F.col("duration").cast("double")
    timed = durations.where(value.isNotNull() & ~F.isnan(value))
    grouped = timed.groupBy(F.window(ts, width).alias("w"), "query").agg(
        F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"), F.min(ts).alias("first"), F.max(ts).alias("last"), F.kll_sketch_agg_double(value, F.lit(k)).alias("sketch")
    )
    return grouped.select(F.col("w.start").alias("window_start"), "query", "n", "total", "first", "last", "sketch")


def merged_latency(windows: DataFrame, keys: tuple[str, ...] = ("query",), shares: tuple[float, ...] = SHARES) -> DataFrame:
    """Per key of stored windows: windows, n, mean, throughput (rows a second, null for a single moment) and the percentiles p50, p95, ..."""
    seconds = (F.unix_micros(F.max("last")) - F.unix_micros(F.min("first"))) / 1e6
    merged = windows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("windows"),
        F.sum("n").alias("n"),
        (F.sum("total") / F.sum("n")).alias("mean"),
        F.try_divide(F.sum("n"), seconds).alias("throughput"),
        F.kll_merge_agg_double("sketch").alias("sketch"),
    )
    quantiles = [F.kll_sketch_get_quantile_double("sketch", F.lit(s)).alias(f"p{round(100 * s)}") for s in shares]
    return merged.select(*keys, "windows", "n", "mean", "throughput", *quantiles)


def within_rank(estimates: DataFrame, durations: DataFrame, error: float, shares: tuple[float, ...] = SHARES) -> DataFrame:
    """(query, p50_within, ...): whether each estimated percentile's true rank among the durations is within ``error`` of its share."""
    names = [f"p{round(100 * s)}" for s in shares]
    rows = durations.where("duration IS NOT NULL").select("query", F.col("duration").cast("double").alias("v")).join(estimates.select("query", *names), "query")
    below = lambda test: F.avg(test.cast("double"))
    ranks = rows.groupBy("query").agg(*[F.struct(below(F.col("v") < F.col(p)).alias("low"), below(F.col("v") <= F.col(p)).alias("high")).alias(p) for p in names])
    return ranks.select("query", *[((F.col(p)["low"] <= s + error) & (F.col(p)["high"] >= s - error)).alias(f"{p}_within") for p, s in zip(names, shares)])
