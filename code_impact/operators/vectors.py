"""Collections of vectors with metadata: upkeep and exact nearest-neighbour search."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from code_impact.session import cut_lineage

SPLIT_ABOVE = 1_000_000
SEMANTIC_WEIGHT = 0.7


def upsert(collection: DataFrame, changes: DataFrame, key: str = "vec_id") -> DataFrame:
    """Add new rows and replace those with the same key."""
    return collection.join(changes.select(key), key, "left_anti").unionByName(changes)


def delete(collection: DataFrame, ids: DataFrame | None = None, where: dict | None = None, key: str = "vec_id") -> DataFrame:
    """Drop rows by key, or by a metadata filter."""
    kept = collection
    if ids is not None:
        kept = kept.join(ids.select(key).distinct(), key, "left_anti")
    if where:
        kept = kept.where(~F.coalesce(metadata_filter(where), F.lit(False)))
    return kept


def collection_stats(rows: DataFrame, collection: str) -> DataFrame:
    return rows.groupBy(F.col(collection).alias("collection")).agg(F.count(F.lit(1)).alias("count"))


def metadata_filter(tree: dict) -> Column:
    """``{"$and": [...]}`` and ``{column: {"$eq" | "$gt": value}}`` as a condition."""
    test = F.lit(True)
    for name, rule in tree.items():
        if name == "$and":
            for part in rule:
                test = test & metadata_filter(part)
            continue
        for operator, value in rule.items():
            test = test & {"$eq": lambda c, v: c == v, "$gt": lambda c, v: c > v}[operator](F.col(name), F.lit(value))
    return test


_BLOCK = "ids array<long>, width int, vectors binary, list int"


def whole(rows: DataFrame) -> DataFrame:
    """Rows whose vector can be compared: not missing, not empty, without nulls."""
    return rows.where("embedding IS NOT NULL AND size(embedding) > 0").where(F.forall("embedding", lambda e: e.isNotNull()))


def blocks(rows: DataFrame, key: str, size: int, list_: Column | None = None) -> DataFrame:
    """Unit vectors packed as (ids, width, vectors, list): at most ``size`` vectors of one width and list in a row.

    A vector that is missing, empty or holds a null is like no other and left out.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[tuple[int, int], list] = {}

        def packed(width: int, list_no: int, held: list) -> pa.RecordBatch:
            vectors = unit(np.array([v for _, v in held], np.float64))
            ids = pa.array([[i for i, _ in held]], pa.list_(pa.int64()))
            columns = [ids, pa.array([width], pa.int32()), pa.array([vectors.tobytes()], pa.binary()), pa.array([list_no], pa.int32())]
            return pa.RecordBatch.from_arrays(columns, names=["ids", "width", "vectors", "list"])

        for batch in batches:
            ids, vectors, lists = batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()
            for k, id_ in enumerate(ids):
                vector = vectors[k].values.to_numpy(zero_copy_only=False)
                kind = (len(vector), lists[k])
                held = waiting.setdefault(kind, [])
                held.append((id_, vector))
                if len(held) == size:
                    yield packed(*kind, waiting.pop(kind))
        for kind, held in waiting.items():
            yield packed(*kind, held)

    list_ = (F.lit(0) if list_ is None else list_).cast("int")
    return whole(rows).select(F.col(key).cast("long"), F.col("embedding").cast("array<double>"), list_.alias("list")).mapInArrow(pack, _BLOCK)


def unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-300)


def best_pairs(pairs: DataFrame, k: int) -> DataFrame:
    """The best ``k`` of each query over pairs of blocks (width, ids, vectors, q_ids, q_vectors), with ``rank``."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                width, ids, vectors, q_ids, q_vectors = (c[r].as_py() for c in batch.columns)
                keys = np.array(ids, np.int64)
                scores = np.frombuffer(q_vectors).reshape(-1, width) @ np.frombuffer(vectors).reshape(-1, width).T
                best = [np.lexsort((keys, -row))[:k] for row in scores]
                found = np.concatenate(best)
                asked_by = np.repeat(np.array(q_ids, np.int64), [len(b) for b in best])
                similar = np.concatenate([row[b] for row, b in zip(scores, best)])
                yield pa.RecordBatch.from_arrays([pa.array(asked_by), pa.array(keys[found]), pa.array(similar)], names=["query_id", "vec_id", "similarity"])

    columns = pairs.select("width", "ids", "vectors", "q_ids", "q_vectors")
    found = columns.mapInArrow(search, "query_id long, vec_id long, similarity double")
    order = Window.partitionBy("query_id").orderBy(F.col("similarity").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def top_k(collection: DataFrame, queries: DataFrame, k: int, where: dict | None = None, block: int = 1024) -> DataFrame:
    """The ``k`` most similar vectors of each query (``query_id``, ``embedding``); similarity is 1 minus cosine distance.

    Exact: blocks of ``block`` vectors meet each block of queries of the same width, and only the best ``k`` of a pair of
    blocks leave the task. Blocks of queries are rows of a table: none of them passes the driver, and a large set of queries
    is shuffled. The metadata filter runs before scoring.
    """
    rows = collection.where(metadata_filter(where)) if where else collection
    # Stored, so that the optimizer knows the size: few queries are broadcast, many are joined by shuffles split where skewed.
    asked = cut_lineage(blocks(queries, "query_id", block).select(F.col("ids").alias("q_ids"), "width", F.col("vectors").alias("q_vectors")))
    return best_pairs(blocks(rows, "vec_id", block).join(asked, "width"), k)


def hybrid(collection: DataFrame, queries: DataFrame, k: int, boost: Column, where: dict | None = None) -> DataFrame:
    """Fetch twice ``k``, rank again by weighted similarity and metadata boost, keep ``k``."""
    fetched = top_k(collection, queries, 2 * k, where).drop("rank")
    marked = fetched.join(collection.select("vec_id", boost.alias("boost")), "vec_id")
    score = F.col("similarity") * SEMANTIC_WEIGHT + F.col("boost") * (1 - SEMANTIC_WEIGHT)
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return marked.withColumn("score", score).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def collection_names(rows: DataFrame, repository: str, kind: str, day: Column, split_above: int = SPLIT_ABOVE) -> DataFrame:
    """Add ``collection``: kind and repository, and the day where the repository is too large for one collection."""
    sizes = rows.groupBy(repository).agg(F.count(F.lit(1)).alias("_n"))
    base = F.concat(F.lit(f"{kind}-"), F.col(repository))
    name = F.when(F.col("_n") > split_above, F.concat(base, F.lit("-"), F.date_format(day, "yyyy-MM-dd"))).otherwise(base)
    return rows.join(sizes, repository).withColumn("collection", name).drop("_n")


def without_copies(rows: DataFrame, key: str, text: str) -> DataFrame:
    """The first row of each distinct text and how many copies it has. Only hashes are grouped, partially first."""
    hashed = rows.select(key, F.sha2(F.col(text), 256).alias("content_hash"))
    return hashed.groupBy("content_hash").agg(F.min(key).alias(key), F.count(F.lit(1)).alias("copies"))
