"""Session settings and the shared scratch folder every job uses."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Runtime settings the operators rely on. Skewed join sides (hub classes, huge pull requests) are split by AQE
# even where the split costs one more shuffle.
RUNTIME_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
    # A batch that goes to Python ends with the row that takes it over so many bytes.
    "spark.sql.execution.arrow.maxBytesPerBatch": str(16 << 20),
}

# Parquet files of paths and names are about so much smaller than their rows; by file size alone, tables that hold
# hundreds of MB in memory would be sent through the driver. The corpus operators do without.
TABLE_CONF = {"spark.sql.sources.fileCompressionFactor": "10"}

_local_dirs: dict[str, str] = {}


def local_session(cpus: int | str = "*", app: str = "code_impact") -> SparkSession:
    """A session for tests and the bench. On a cluster the caller brings its own."""
    cores = os.cpu_count() if cpus == "*" else int(cpus)
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.driver.memory", os.environ.get("CODE_IMPACT_DRIVER_MEMORY", "12g"))
        .config("spark.ui.enabled", "false")
    )
    for key, value in RUNTIME_CONF.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def apply_runtime_conf(spark: SparkSession, more: dict[str, str] | None = None) -> None:
    for key, value in (RUNTIME_CONF | (more or {})).items():
        spark.conf.set(key, value)


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``. Only a local master may fall back to a folder of its own."""
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    app = spark.sparkContext.applicationId
    if app not in _local_dirs:
        _local_dirs[app] = tempfile.mkdtemp(prefix="code_impact-")
    return _local_dirs[app]


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder and go on from it, so that a lost executor costs no recomputation.

    A written table instead of ``checkpoint()``: it is columnar, has sizes the optimizer can use, and unions of it plan
    without the constraints of the plan it came from.
    """
    spark = df.sparkSession
    path = scratch_path(spark, "cut")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
