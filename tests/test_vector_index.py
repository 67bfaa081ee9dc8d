"""The inverted file against the exact search: recall, filters, additions, odd vectors."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from code_impact.operators import vector_index, vectors
from code_impact.operators.vector_index import VectorIndex
from code_impact.session import scratch_path


def table(spark, matrix, **columns):
    rows = [(k, v.tolist(), k % 5) for k, v in enumerate(matrix)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(4)


def asked(spark, matrix):
    return spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(matrix)], "query_id long, embedding array<double>")


def pairs(df):
    return {(r.query_id, r.vec_id, round(r.similarity, 9), r["rank"]) for r in df.collect()}


@pytest.fixture(scope="module")
def grouped(spark):
    """Vectors in 40 groups, queries near some of them, and the index over them."""
    rng = np.random.default_rng(3)
    middles = rng.standard_normal((40, 24))
    matrix = middles[rng.integers(0, 40, 3000)] + 0.15 * rng.standard_normal((3000, 24))
    queries = middles[:25] + 0.1 * rng.standard_normal((25, 24))
    rows = table(spark, matrix)
    return rows, asked(spark, queries), VectorIndex(spark, scratch_path(spark, "vectors")).build(rows)


def test_all_lists_are_the_exact_answer(grouped):
    rows, queries, index = grouped
    assert index.vectors().count() == 3000 and len(index.centroids()) == vector_index.default_lists(3000) == 55
    assert pairs(index.top_k(queries, 10, 55)) == pairs(vectors.top_k(rows, queries, 10))
    where = {"$and": [{"label": {"$eq": 3}}, {"vec_id": {"$gt": 100}}]}
    assert pairs(index.top_k(queries, 10, 55, where)) == pairs(vectors.top_k(rows, queries, 10, where))


def test_few_lists_find_most_of_grouped_vectors(grouped):
    rows, queries, index = grouped
    found, exact = index.top_k(queries, 10, 6), vectors.top_k(rows, queries, 10)
    shares = [r.recall for r in vector_index.recall(found, exact).collect()]
    assert len(shares) == 25 and np.mean(shares) >= 0.95
    curve = {r.probes: r for r in index.recall_curve(queries, 10, [1, 6, 55]).collect()}
    assert abs(curve[6].recall - np.mean(shares)) < 1e-9 and curve[6].scored < 0.3
    assert curve[1].recall <= curve[6].recall <= curve[55].recall == 1.0 == curve[55].scored


def test_given_vectors_reach_nine_tenths(spark):
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    index = VectorIndex(spark, scratch_path(spark, "vectors")).build(rows)
    queries = rows.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    lists = len(index.centroids())
    # These vectors have no groups: three quarters of the lists.
    found = index.top_k(queries, 10, -(-3 * lists // 4))
    shares = [r.recall for r in vector_index.recall(found, vectors.top_k(rows, queries, 10)).collect()]
    assert len(shares) == queries.count() and np.mean(shares) >= 0.9


def test_only_folders_looked_into_are_read(grouped):
    _, queries, index = grouped
    one = index.top_k(queries.where("query_id = 0"), 5, 2)
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [list" in plan


def test_added_and_odd_vectors(spark):
    rng = np.random.default_rng(5)
    rows = table(spark, rng.standard_normal((300, 8)))
    odd = spark.createDataFrame([(900, None, 1), (901, [], 1), (902, [1.0, None] * 4, 1), (903, [0.0] * 8, 1), (904, [1.0] * 3, 1), (905, [2.0] * 8, None)], "vec_id long, embedding array<double>, label int")
    index = VectorIndex(spark, scratch_path(spark, "vectors")).build(rows.unionByName(odd), lists=12)
    # Only vectors of the common width can be compared; one of zeros is like nothing and lies in some list.
    assert {r.vec_id for r in index.vectors().where("vec_id >= 900").collect()} == {903, 905}
    index.add(table(spark, 5 * rng.standard_normal((50, 8))).withColumn("vec_id", F.col("vec_id") + 1000))
    assert index.vectors().count() == 352 and sum(r.vectors for r in index.list_sizes().collect()) == 352
    again = VectorIndex(spark, index.root)
    queries = asked(spark, rng.standard_normal((4, 8))).unionByName(spark.createDataFrame([(9, None)], "query_id long, embedding array<double>"))
    assert pairs(again.top_k(queries, 7, 12)) == pairs(vectors.top_k(index.vectors(), queries, 7))
    # Equal vectors are one centroid at most; an empty collection has one list.
    same = table(spark, np.ones((40, 3)))
    assert len(VectorIndex(spark, scratch_path(spark, "vectors")).build(same).centroids()) == 1
    empty = VectorIndex(spark, scratch_path(spark, "vectors")).build(same.limit(0))
    assert empty.top_k(queries, 3, 1).count() == 0
    with pytest.raises(ValueError):
        vector_index.learn_centroids(same, lists=10_000_000)
