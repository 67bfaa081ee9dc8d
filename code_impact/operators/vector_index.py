"""Approximate nearest-neighbour search: an inverted file of vectors by their nearest centroid, stored as tables.

A query looks into the lists of its nearest centroids alone. How many it takes for a wanted recall depends on the vectors:
``recall_curve`` measures it against the exact search. ``vectors.top_k`` stays the exact way and the default.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from code_impact.operators.vectors import best_pairs, blocks, metadata_filter, top_k, unit, whole
from code_impact.session import cut_lineage

MOST_LISTS = 4096
# Vectors a list from which its centroid is learned, at most.
SAMPLE_PER_LIST = 64
# Centroids travel to every task.
MOST_BYTES = 64 << 20


def default_lists(n: int) -> int:
    """Square root of the number of vectors, so that a list and the list of centroids are alike in size."""
    return max(1, min(MOST_LISTS, math.floor(math.sqrt(n) + 0.5)))


def _nearest(rows: DataFrame, centroids: np.ndarray, columns: str, probes: int) -> DataFrame:
    """``rows`` (columns, the first a vector) with (list, list_rank) of the ``probes`` nearest centroids; one row for each."""
    probes = min(probes, len(centroids))
    towards = unit(centroids).T

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            vectors = np.array(batch.column(0).to_pylist(), np.float64).reshape(batch.num_rows, -1)
            scores = unit(vectors) @ towards
            lists = np.argsort(-scores, axis=1, kind="stable")[:, :probes]
            again = pa.array(np.repeat(np.arange(batch.num_rows), probes))
            own = [c.take(again) for c in batch.columns]
            added = [pa.array(lists.ravel().astype(np.int32)), pa.array(np.tile(np.arange(1, probes + 1, dtype=np.int32), batch.num_rows))]
            yield pa.RecordBatch.from_arrays([*own, *added], names=[*batch.schema.names, "list", "list_rank"])

    return rows.mapInArrow(near, f"{columns}, list int, list_rank int")


def learn_centroids(collection: DataFrame, lists: int | None = None, rounds: int = 2, key: str = "vec_id") -> np.ndarray:
    """Centroids (lists x width) of the vectors of the commonest width, by ``rounds`` of spherical k-means.

    They begin as the first ``lists`` different vectors by a hash of their key, and are moved to the mean of the unit vectors nearest
    to them among the first ``SAMPLE_PER_LIST`` times as many: a bounded sample, whatever the size of the collection. A centroid
    that no vector is nearest to stays. Work on the sample is spread over tasks; only sums per list come back.
    """
    usable = whole(collection).select(F.col(key).cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("v"))
    widths = usable.groupBy(F.size("v").alias("width")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "width").limit(1).collect()
    if not widths:
        return np.zeros((1, 1))
    width, n = widths[0]["width"], widths[0]["n"]
    lists = default_lists(n) if lists is None else lists
    if lists * width * 8 > MOST_BYTES:
        raise ValueError(f"{lists} centroids of {width} numbers are more than {MOST_BYTES} bytes")
    order = [F.md5(F.col("id").cast("string")), F.col("id")]
    distinct = usable.where(F.size("v") == width).groupBy("v").agg(F.min("id").alias("id"))
    sample = cut_lineage(usable.where(F.size("v") == width).orderBy(*order).limit(lists * SAMPLE_PER_LIST))
    first = distinct.orderBy(*order).limit(lists).orderBy(*order).collect()
    centroids = unit(np.array([r["v"] for r in first], np.float64))

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros(centroids.shape), np.zeros(len(centroids), np.int64)
        for batch in batches:
            vectors = unit(np.array(batch.column(0).to_pylist(), np.float64).reshape(-1, width))
            np.add.at(total, near := np.array(batch.column(1)), vectors)
            count += np.bincount(near, minlength=len(centroids))
        used = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(list(total[used]), pa.list_(pa.float64()))], names=["list", "total"])

    for _ in range(rounds):
        placed = _nearest(sample.select("v"), centroids, "v array<double>", 1).select("v", "list")
        parts = placed.mapInArrow(summed, "list int, total array<double>").select("list", F.posexplode("total").alias("i", "x"))
        moved = centroids.copy()
        sums = parts.groupBy("list", "i").agg(F.sum("x").alias("x")).collect()
        for r in sums:
            moved[r["list"], r["i"]] = r["x"]
        centroids = unit(moved)
    return centroids


def assigned(rows: DataFrame, centroids: np.ndarray, key: str = "vec_id") -> DataFrame:
    """All columns of the rows that can be compared with the centroids, and ``list``, the number of the nearest one."""
    own = whole(rows).where(F.size("embedding") == centroids.shape[1]).withColumn("embedding", F.col("embedding").cast("array<double>"))
    others = [c for c in own.columns if c != "embedding"]
    shape = ", ".join(f"`{c}` {own.schema[c].dataType.simpleString()}" for c in ["embedding", *others])
    return _nearest(own.select("embedding", *others), centroids, shape, 1).drop("list_rank")


class VectorIndex:
    """Tables under ``root``: the centroids, and the vectors with their further columns in one folder a list."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def build(self, collection: DataFrame, lists: int | None = None, rounds: int = 2) -> VectorIndex:
        """Learn the centroids from a sample and store every vector that has their width under its nearest one."""
        centroids = learn_centroids(collection, lists, rounds)
        table = self.spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(centroids)], "list int, vector array<double>")
        table.coalesce(1).write.parquet(f"{self.root}/centroids")
        # The columns, also of an index without vectors.
        assigned(collection, centroids).limit(0).coalesce(1).write.parquet(f"{self.root}/columns")
        return self.add(collection)

    def add(self, rows: DataFrame) -> VectorIndex:
        """Store further vectors under the centroids there are. A list with very many goes to several files."""
        placed = assigned(rows, self.centroids())
        placed.hint("rebalance", "list").write.mode("append").partitionBy("list").parquet(f"{self.root}/vectors")
        return self

    def centroids(self) -> np.ndarray:
        rows = self.spark.read.schema("list int, vector array<double>").parquet(f"{self.root}/centroids").orderBy("list").collect()
        return np.array([r["vector"] for r in rows], np.float64)

    def vectors(self) -> DataFrame:
        columns = self.spark.read.parquet(f"{self.root}/columns").schema
        if not self._path_exists(f"{self.root}/vectors"):
            return self.spark.createDataFrame([], columns)
        return self.spark.read.schema(columns).parquet(f"{self.root}/vectors")

    def _path_exists(self, path: str) -> bool:
        place = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(place)

    def list_sizes(self) -> DataFrame:
        """(list, vectors): how evenly the lists are filled; the list is a folder name, so only footers are read."""
        return self.vectors().groupBy("list").agg(F.count(F.lit(1)).alias("vectors"))

    def top_k(self, queries: DataFrame, k: int, probes: int, where: dict | None = None, block: int = 1024) -> DataFrame:
        """The ``k`` most similar vectors of each query (``query_id``, ``embedding``) in its ``probes`` nearest lists.

        Columns as of the exact search, with exact similarities; what lies in other lists is missed. Folders of lists that no
        query looks into are not read; a metadata filter runs before scoring.
        """
        asked = self._asked(queries, probes)
        packed = blocks(asked, "query_id", block, F.col("list")).select(F.col("ids").alias("q_ids"), "width", "list", F.col("vectors").alias("q_vectors"))
        # At most ``MOST_LISTS`` numbers.
        used = [r["list"] for r in asked.select("list").distinct().collect()]
        rows = self.vectors().where(F.col("list").isin(used))
        rows = rows.where(metadata_filter(where)) if where else rows
        return best_pairs(blocks(rows, "vec_id", block, F.col("list")).join(cut_lineage(packed), ["width", "list"]), k)

    def _asked(self, queries: DataFrame, probes: int) -> DataFrame:
        centroids = self.centroids()
        own = whole(queries).where(F.size("embedding") == centroids.shape[1])
        own = own.select(F.col("embedding").cast("array<double>").alias("embedding"), F.col("query_id").cast("long").alias("query_id"))
        return cut_lineage(_nearest(own, centroids, "embedding array<double>, query_id long", probes))

    def probes_needed(self, queries: DataFrame, k: int) -> DataFrame:
        """(query_id, vec_id, rank, list_rank): the exact best ``k`` of each query, and how many probes it takes to meet each."""
        order = self._asked(queries, MOST_LISTS).select("query_id", "list", "list_rank")
        found = top_k(self.vectors(), queries, k)
        return found.join(self.vectors().select("vec_id", "list"), "vec_id").join(order, ["query_id", "list"]).select("query_id", "vec_id", "rank", "list_rank")

    def recall_curve(self, queries: DataFrame, k: int, probes: list[int]) -> DataFrame:
        """(probes, recall, scored): the share of the exact best ``k`` that so many probes find, and of all vectors they compare."""
        steps = F.explode(F.array(*[F.lit(p) for p in probes])).alias("probes")
        needed = self.probes_needed(queries, k).select("list_rank", steps)
        found = needed.groupBy("probes").agg(F.avg((F.col("list_rank") <= F.col("probes")).cast("double")).alias("recall"))
        sizes = self.list_sizes()
        every = self._asked(queries, MOST_LISTS).join(sizes, "list").select("list_rank", "vectors", steps)
        within = F.sum(F.when(F.col("list_rank") <= F.col("probes"), F.col("vectors")).otherwise(0))
        scored = every.groupBy("probes").agg((within / F.sum("vectors")).alias("scored"))
        return found.join(scored, "probes")


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """(query_id, n_exact, n_found, recall) of an approximate answer against the exact one."""
    hits = exact.select("query_id", "vec_id").join(found.select("query_id", "vec_id", F.lit(1).alias("hit")), ["query_id", "vec_id"], "left")
    counts = hits.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_exact"), F.count("hit").alias("n_found"))
    return counts.withColumn("recall", F.col("n_found") / F.col("n_exact"))
