"""Queries over vector collections. The query vectors are the mean vectors of the labels."""

from pyspark.sql import functions as F

from code_impact.operators import vectors as ops
from code_impact.operators.vector_index import VectorIndex, default_lists
from code_impact.plans.registry import query

MEANS = """means AS (SELECT label AS query_id, i, avg(x) AS x FROM (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) e GROUP BY 1, 2),
 qv AS (SELECT query_id, list(x ORDER BY i) AS q FROM means GROUP BY 1),
 scored AS (SELECT q.query_id, e.vec_id, e.label, list_cosine_similarity(e.embedding::DOUBLE[], q.q) AS similarity FROM embeddings e, qv q)"""


def _means(t):
    parts = t["embeddings"].select(F.col("label").alias("query_id"), F.posexplode("embedding").alias("i", "x"))
    means = parts.groupBy("query_id", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    # One value per dimension, so a list is as long as a vector.
    return means.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda p: p["x"]).alias("embedding"))


def _shown(found):
    return found.select("query_id", "vec_id", F.round("similarity", 6).alias("similarity"), F.col("rank").cast("bigint").alias("rank"))


def _ranked(body: str, k: int) -> str:
    return f"""WITH {MEANS}, k AS ({body}) SELECT query_id::BIGINT AS query_id, vec_id, round(similarity, 6) AS similarity, rank FROM k WHERE rank <= {k}"""


@query("vector_topk", _ranked("SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id) AS rank FROM scored", 10))
def vector_topk(t):
    return _shown(ops.top_k(t["embeddings"], _means(t), 10))


@query(
    "vector_topk_filtered",
    _ranked("SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id) AS rank FROM scored WHERE label = 3 AND vec_id > 20", 20),
)
def vector_topk_filtered(t):
    where = {"$and": [{"label": {"$eq": 3}}, {"vec_id": {"$gt": 20}}]}
    return _shown(ops.top_k(t["embeddings"], _means(t), 20, where))


@query(
    "hybrid_search",
    f"""WITH {MEANS}, a AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id) AS r FROM scored),
    b AS (SELECT *, 0.7 * similarity + 0.3 * CASE WHEN label = 3 THEN 1.0 WHEN label = 5 THEN 0.5 ELSE 0.0 END AS score FROM a WHERE r <= 20),
    k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM b)
    SELECT query_id::BIGINT AS query_id, vec_id, round(score, 6)::DOUBLE AS score, rank FROM k WHERE rank <= 10""",
)
def hybrid_search(t):
    boost = F.when(F.col("label") == 3, 1.0).when(F.col("label") == 5, 0.5).otherwise(0.0)
    found = ops.hybrid(t["embeddings"], _means(t), 10, boost)
    return found.select("query_id", "vec_id", F.round("score", 6).alias("score"), F.col("rank").cast("bigint").alias("rank"))


# The inverted file in SQL: the first vectors by hash as centroids, moved twice to the mean of the vectors nearest to them.
_NEAREST = "SELECT {keys}, c.list, row_number() OVER (PARTITION BY {keys} ORDER BY list_cosine_similarity({v}, c.v) DESC, c.list) AS list_rank FROM {rows}, {c} c"
_MEANS_OF = """SELECT c.list, coalesce(m.v, c.v) AS v FROM {c} c LEFT JOIN (SELECT list, list(x ORDER BY i) AS v FROM
  (SELECT list, i, sum(x) AS x FROM (SELECT n.list, unnest(u.v) AS x, generate_subscripts(u.v, 1) AS i FROM ({nearest}) n JOIN u ON u.vec_id = n.vec_id WHERE n.list_rank = 1) GROUP BY 1, 2) GROUP BY 1) m ON m.list = c.list"""


def _inverted(name: str) -> str:
    near = lambda c: _NEAREST.format(keys="vec_id", v="u.v", rows="u", c=c)
    return f"""{MEANS}, n AS (SELECT greatest(1, least(4096, floor(sqrt(count(*)) + 0.5)))::BIGINT AS lists FROM embeddings),
 u AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[]))) AS v FROM embeddings),
 c0 AS (SELECT list, v FROM (SELECT row_number() OVER (ORDER BY md5(vec_id::VARCHAR), vec_id) - 1 AS list, v FROM (SELECT min(vec_id) AS vec_id, v FROM u GROUP BY v)), n WHERE list < lists),
 c1 AS ({_MEANS_OF.format(c="c0", nearest=near("c0"))}), c2 AS ({_MEANS_OF.format(c="c1", nearest=near("c1"))}),
 lists AS (SELECT vec_id, list FROM ({near("c2")}) WHERE list_rank = 1),
 asked AS ({_NEAREST.format(keys="query_id", v="qv.q", rows="qv", c="c2")}),
 {name} AS (SELECT s.query_id, s.vec_id, s.similarity, a.list_rank FROM scored s JOIN lists l ON l.vec_id = s.vec_id JOIN asked a ON a.query_id = s.query_id AND a.list = l.list)"""


def _index(t):
    """The vectors as an inverted file, built once per application and folder, and how many lists it has."""
    index = VectorIndex(t.spark, t.once("vector-index", lambda path: VectorIndex(t.spark, path).build(t["embeddings"])))
    return index, default_lists(t["embeddings"].count())


@query(
    "vector_topk_approx",
    f"""WITH {_inverted("placed")}, k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id) AS rank
      FROM placed, n WHERE list_rank <= ceil(0.75 * lists))
    SELECT query_id::BIGINT AS query_id, vec_id, round(similarity, 6) AS similarity, rank FROM k WHERE rank <= 10""",
)
def vector_topk_approx(t):
    # These vectors have no groups, so three quarters of the lists are needed for nine tenths of the answer; see the curve.
    index, lists = _index(t)
    return _shown(index.top_k(_means(t), 10, -(-3 * lists // 4)))


@query(
    "vector_recall_curve",
    f"""WITH {_inverted("placed")}, p AS (SELECT greatest(1, ceil(lists * s / 8))::INTEGER AS probes FROM n, (SELECT unnest(range(1, 9)) AS s)),
    k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id) AS rank FROM placed)
    SELECT probes::BIGINT AS probes, round(avg(CASE WHEN list_rank <= probes THEN 1.0::DOUBLE ELSE 0.0 END) FILTER (rank <= 10), 6) AS recall,
    round(avg(CASE WHEN list_rank <= probes THEN 1.0::DOUBLE ELSE 0.0 END), 6) AS scored FROM k, (SELECT DISTINCT probes FROM p) GROUP BY 1""",
)
def vector_recall_curve(t):
    index, lists = _index(t)
    curve = index.recall_curve(_means(t), 10, sorted({max(1, -(-lists * s // 8)) for s in range(1, 9)}))
    return curve.select(F.col("probes").cast("bigint").alias("probes"), F.round("recall", 6).alias("recall"), F.round("scored", 6).alias("scored"))


@query(
    "collection_upsert",
    """SELECT vec_id, label FROM embeddings WHERE vec_id NOT IN (SELECT vec_id FROM vector_changes) UNION ALL SELECT vec_id, label FROM vector_changes""",
)
def collection_upsert(t):
    return ops.upsert(t["embeddings"], t["vector_changes"]).select("vec_id", "label")


@query("collection_stats", "SELECT 'label-' || label AS collection, count(*) AS count FROM embeddings WHERE NOT (label = 2 AND vec_id > 100) GROUP BY 1")
def collection_stats(t):
    kept = ops.delete(t["embeddings"], where={"$and": [{"label": {"$eq": 2}}, {"vec_id": {"$gt": 100}}]})
    named = kept.withColumn("name", F.concat(F.lit("label-"), F.col("label").cast("string")))
    return ops.collection_stats(named, "name")


@query(
    "collection_partitions",
    """WITH r AS (SELECT 'repo' || (user_id % 7) AS repository, ts FROM events), n AS (SELECT repository, count(*) AS n FROM r GROUP BY 1)
    SELECT 'code-' || r.repository || CASE WHEN n.n > 150 THEN '-' || strftime(r.ts, '%Y-%m-%d') ELSE '' END AS collection, count(*) AS count FROM r JOIN n ON n.repository = r.repository GROUP BY 1""",
)
def collection_partitions(t):
    rows = t["events"].select(F.concat(F.lit("repo"), (F.col("user_id") % 7).cast("string")).alias("repository"), "ts")
    named = ops.collection_names(rows, "repository", "code", F.col("ts"), split_above=150)
    return ops.collection_stats(named, "collection")


@query("collection_dedup", "SELECT min(doc_id) AS doc_id, sha256(text) AS content_hash, count(*) AS copies FROM documents GROUP BY 2")
def collection_dedup(t):
    return ops.without_copies(t["documents"], "doc_id", "text")
