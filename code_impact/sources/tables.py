"""The given Parquet tables and the views of ``fixture_sql`` as DataFrames."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from code_impact.session import TABLE_CONF, apply_runtime_conf, scratch_path
from code_impact.sources.fixture_sql import FIXTURES

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


# Views that stand for tables of the service and take a sort of all rows to make: written once per application.
STORED = ("file_changes", "layered_changes")

_written: dict[tuple[str, str, str], str] = {}


class Inputs:
    """Tables and fixture views of one data folder."""

    def __init__(self, spark: SparkSession, folder: str):
        apply_runtime_conf(spark, TABLE_CONF)
        self.spark = spark
        self.folder = folder.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def spread(self, name: str) -> DataFrame:
        """A table that feeds generated source text. A file of one row group would leave the text to a single task, so
        its narrow rows are spread first; inputs with enough splits stay as they are."""
        df = self.table(name)
        wanted = self.spark.sparkContext.defaultParallelism
        return df.repartition(wanted) if df.rdd.getNumPartitions() < wanted else df

    def __getitem__(self, name: str) -> DataFrame:
        if name in TABLES:
            return self.table(name)
        if name in STORED:
            return self.stored(name, lambda: self.view(name))
        return self.view(name)

    def view(self, name: str, stored: bool = True) -> DataFrame:
        text = FIXTURES[name]
        named = set(re.findall(r"\b(?:FROM|JOIN) (\w+)", text))
        for other in named & FIXTURES.keys():
            (self[other] if stored else self.view(other, stored)).createOrReplaceTempView(other)
        used = named & set(TABLES)
        for t in used:
            rows = self.spread(t) if "chr(10)" in text or "'{" in text else self.table(t)
            rows.createOrReplaceTempView(t)
        return self.spark.sql(text)

    def unnumbered(self, name: str) -> DataFrame:
        """A stored view as it is made, for queries that do not read its row numbers: the optimizer then leaves out the sort for them
        and all columns that are not asked for, and nothing is written."""
        return self.view(name, stored=False)

    def types(self, files: str) -> DataFrame:
        """Extracted classes of a fixture, written once per application."""
        from code_impact.operators.index import extract_types

        return self.stored(f"types-{files}", lambda: extract_types(self[files]))

    def index(self, files: str) -> dict[str, DataFrame]:
        """Stored index of a fixture, built once per application."""
        from code_impact.operators.index import build_index
        from code_impact.sources.store import IndexStore

        def build(path: str) -> None:
            IndexStore(self.spark, path).save(build_index(self[files], self.types(files)))

        return IndexStore(self.spark, self.once(f"index-{files}", build)).load()

    def stored(self, label: str, make) -> DataFrame:
        return self.spark.read.parquet(self.once(label, lambda path: make().write.parquet(path)))

    def once(self, label: str, write) -> str:
        key = (self.spark.sparkContext.applicationId, self.folder, label)
        if key not in _written:
            path = scratch_path(self.spark, label)
            write(path)
            _written[key] = path
        return _written[key]
