"""What the corpus operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from code_impact.session import apply_runtime_conf, cut_lineage

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# For bytes.translate: A-Z to a-z, everything else (also inside UTF-8 sequences) unchanged.
ASCII_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
ASCII_SPACE = b" \t\n\x0b\x0c\r"
# Bytes of an Arrow batch, as Spark counts them, after which a new one begins.
BATCH_BYTES = 16 << 20
# Stands for a missing id where ids are compared: such rows come after all others.
NO_ID = 2**63 - 1


def prepare(spark: SparkSession) -> None:
    """Session settings of this package: skewed joins are split, and Arrow batches are cut by rows and by bytes.

    A batch ends with the row that takes it over ``BATCH_BYTES``, so it holds at most that and one text.
    """
    apply_runtime_conf(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "512")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def lower_ascii(text: Column) -> Column:
    return F.when(text.rlike("[A-Z]"), F.translate(text, UPPER, LOWER)).otherwise(text)


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def unused(name: str, *frames: DataFrame) -> str:
    """``name``, or with underscores in front if a column of the frames has it."""
    taken = {c.lower() for df in frames for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def byte_runs(texts: list[bytes], most: int) -> Iterator[tuple[int, int]]:
    """Index ranges (from, to) of runs of texts with at most ``most`` bytes together; a longer text is a run of its own."""
    first = held = 0
    for k, text in enumerate(texts):
        if k > first and held + len(text) > most:
            yield first, k
            first, held = k, 0
        held += len(text)
    if first < len(texts):
        yield first, len(texts)


def numbered(df: DataFrame, order: list[Column], name: str, rows_each: int = 1_000_000) -> DataFrame:
    """Add ``name``: the place of each row, from 0, in the order of all rows. ``df`` should be a stored table.

    Rows are dealt to sorted ranges, equal rows too, so no range depends on how often a value stands. A row's place is its
    place in its range and the sizes of the ranges before. One shuffle; equal rows may swap places.
    """
    ranges = max(parts(df.sparkSession), -(-df.count() // rows_each))
    tie, at, range_, start = (unused(c, df) for c in ("tie", "at", "range", "start"))
    dealt = df.withColumn(tie, F.monotonically_increasing_id()).repartitionByRange(ranges, *order, F.col(tie)).sortWithinPartitions(*order, tie).drop(tie)
    # The upper bits are the number of the range, the lower 33 the row's place in it.
    dealt = cut_lineage(dealt.withColumn(at, F.monotonically_increasing_id()))
    own = F.shiftright(at, 33)
    counts = dealt.groupBy(own.alias(range_)).agg(F.count("*").alias("n"))
    before = Window.orderBy(range_).rowsBetween(Window.unboundedPreceding, -1)
    # One row for each range.
    starts = counts.select(range_, F.coalesce(F.sum("n").over(before), F.lit(0)).alias(start))
    joined = dealt.withColumn(range_, own).join(F.broadcast(starts), range_)
    return joined.select(*df.columns, (F.col(start) + F.col(at).bitwiseAND((1 << 33) - 1)).alias(name))


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    """Apply ``fn`` to each Arrow batch that has rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield fn(batch)

    return df.mapInArrow(run, schema)
