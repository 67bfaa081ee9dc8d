"""Index tables on shared storage: the latest state and a copy per day, both partitioned by repository.

Every save writes its rows under a version of its own and then, in one last write, says for each repository which version
counts. So a save is seen whole or not at all, and nothing of the version before stays visible.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from code_impact.schemas import INDEX_TABLES

PARTS = tuple(INDEX_TABLES)

# Days a snapshot is kept while it is the newest, and afterwards; indexes and artifacts.
INDEX_RETENTION = (90, 30)
ARTIFACT_RETENTION = (30, 7)


class IndexStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")

    def _write(self, df: DataFrame, path: str, partitions: list[str]) -> None:
        # Rebalancing groups the rows of a repository without forcing a large one into a single task.
        (
            df.hint("rebalance", *partitions)
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy(*partitions)
            .parquet(path)
        )

    def save(self, index: dict[str, DataFrame], snapshot_date: str | None = None) -> None:
        """Replace the repositories of ``index["files"]`` in all tables; with a date also that day's copy."""
        version = uuid.uuid4().hex
        touched = index["files"].select("repository").distinct().withColumn("version", F.lit(version))
        kinds = {"latest": {}} | ({"history": {"snapshot_date": F.lit(snapshot_date).cast("date")}} if snapshot_date else {})
        for kind, dated in kinds.items():
            for part in PARTS:
                rows = index[part].withColumns(dated | {"version": F.lit(version)})
                rows.hint("rebalance", "repository").write.mode("append").partitionBy("repository", *dated, "version").parquet(f"{self.root}/{kind}/{part}")
        for kind, dated in kinds.items():
            self._write(touched.withColumns(dated), f"{self.root}/{kind}/current", ["repository", *dated])

    def _current(self, kind: str) -> DataFrame:
        dated = ", snapshot_date date" if kind == "history" else ""
        return self.spark.read.schema("version string, repository string" + dated).parquet(f"{self.root}/{kind}/current")

    def _read(self, kind: str, part: str) -> DataFrame:
        """Rows of the versions that count. The list of versions is one row a repository and prunes the folders read."""
        keys = ["repository", "version"] + (["snapshot_date"] if kind == "history" else [])
        dated = ", snapshot_date date" if kind == "history" else ""
        rows = self.spark.read.schema(INDEX_TABLES[part] + ", version string" + dated).parquet(f"{self.root}/{kind}/{part}")
        return rows.join(self._current(kind), keys, "left_semi").drop("version")

    def load(self, repositories: list[str] | None = None, snapshot_date: str | None = None) -> dict[str, DataFrame] | None:
        """Tables of the asked repositories, read by partition; None when nothing was ever saved."""
        kind = "history" if snapshot_date else "latest"
        try:
            found = {part: self._read(kind, part) for part in PARTS}
        except AnalysisException:
            return None
        for part, df in found.items():
            if repositories is not None:
                df = df.where(F.col("repository").isin(repositories))
            if snapshot_date:
                df = df.where(F.col("snapshot_date") == F.lit(snapshot_date).cast("date"))
            found[part] = df
        return found

    def require(self, repository: str) -> dict[str, DataFrame]:
        found = self.load([repository])
        if found is None or found["files"].isEmpty():
            raise LookupError(f"no index for {repository}")
        return found

    def list(self) -> DataFrame:
        return self._current("latest").select("repository").distinct()

    def exists(self, asked: DataFrame) -> DataFrame:
        return indexes_exist(self.list(), asked)

    def delete(self, repository: str) -> None:
        """Drop a repository from the latest tables: first the word that it counts, then its rows."""
        jvm = self.spark._jvm
        escaped = jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(repository)
        for part in ("current", *PARTS):
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/latest/{part}/repository={escaped}")
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    def compact_history(self, target: str, as_of: str) -> None:
        """Write the history that is still kept on ``as_of`` to ``target``."""
        snapshots = self._read("history", "files").select("repository", "snapshot_date").distinct()
        kept = kept_snapshots(snapshots, as_of).select("repository", "snapshot_date")
        for part in PARTS:
            history = self._read("history", part)
            self._write(history.join(kept, ["repository", "snapshot_date"], "left_semi"), f"{target}/{part}", ["repository", "snapshot_date"])


def indexes_exist(listed: DataFrame, asked: DataFrame) -> DataFrame:
    found = listed.select("repository").distinct().withColumn("_found", F.lit(True))
    return asked.join(found, "repository", "left").select("repository", F.coalesce("_found", F.lit(False)).alias("found"))


def kept_snapshots(snapshots: DataFrame, as_of: str, retention: tuple[int, int] = INDEX_RETENTION) -> DataFrame:
    """Snapshots still kept on ``as_of``: the newest per repository for the first limit, older ones for the second."""
    current_days, older_days = retention
    newest = snapshots.groupBy("repository").agg(F.max("snapshot_date").alias("_newest"))
    age = F.datediff(F.lit(as_of).cast("date"), F.col("snapshot_date"))
    is_current = F.col("snapshot_date") == F.col("_newest")
    return (
        snapshots.join(newest, "repository")
        .withColumn("is_current", is_current)
        .where(age <= F.when(is_current, current_days).otherwise(older_days))
        .drop("_newest")
    )


def artifact_keys(jobs: DataFrame) -> DataFrame:
    """Storage keys of the artifacts of each job, as its message carries them."""
    base = F.concat_ws("/", "repository", F.col("pr_number").cast("string"), "job_id")
    return jobs.withColumn("code_key", F.concat(base, F.lit("/code.tar.gz"))).withColumn(
        "index_key", F.concat(base, F.lit("/dependency-index.json"))
    )


def stage_artifacts(jobs: DataFrame, path: str) -> DataFrame:
    """Write artifact rows, one folder per repository, and read them back."""
    artifact_keys(jobs).hint("rebalance", "repository").write.mode("overwrite").partitionBy("repository").parquet(path)
    return jobs.sparkSession.read.parquet(path)
