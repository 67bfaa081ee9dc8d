"""Near-duplicate vectors: Euclidean p-stable hashing in several tables, then exact cosines."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from code_impact.llm.common import map_batches, parts
from code_impact.llm.components import components
from code_impact.session import cut_lineage


def _codes(x: np.ndarray, label: np.ndarray, tables: int, projections: int, width: float, seed: int) -> np.ndarray:
    """One 64-bit bucket number per vector and table: quantised projections of the normalised vector, and its label."""
    rng = np.random.default_rng(seed)
    lines = rng.standard_normal((x.shape[1], tables * projections))
    shift = rng.uniform(0, width, tables * projections)
    cells = np.floor((x @ lines + shift) / width).astype(np.int64).reshape(len(x), tables, projections)
    factor = rng.integers(-(2**63), 2**63 - 1, projections, np.int64) | 1
    mixed = (cells * factor).sum(axis=2) + label[:, None] * np.int64(-7046029254386353131) + np.arange(tables) * np.int64(-4417276706812531889)
    mixed = (mixed ^ (mixed.view(np.uint64) >> np.uint64(29)).view(np.int64)) * np.int64(-4658895280553007687)
    return mixed ^ (mixed.view(np.uint64) >> np.uint64(32)).view(np.int64)


def distinct_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(vec_id, label, vector, usable, twin): usable vectors may link; equal usable vectors of one label share ``twin``."""
    v = F.col(vector_col).cast("array<double>")
    sound = F.forall(v, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf"))))
    usable = F.col(label_col).isNotNull() & F.coalesce(sound, F.lit(False)) & F.coalesce(F.exists(v, lambda e: e != 0), F.lit(False))
    made = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.xxhash64(label_col).alias("label"), v.alias("vector"), usable.alias("usable"))
    return made.withColumn("twin", F.when(F.col("usable"), F.sha2(F.concat_ws(",", F.hex("label"), F.array_join(F.transform("vector", lambda e: (e + F.lit(0.0)).cast("string")), ",")), 256)))


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", cosine: float = 0.93, tables: int = 48, projections: int = 16, width: float = 2.0, seed: int = 11, block_rows: int = 512, group_bytes: int = 32 << 20) -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row per input row.

    Two vectors of one label link where they share a bucket of some table and their cosine, in double precision, is at least
    ``cosine``. With the defaults a pair at cosine 0.93 shares a bucket with probability 0.97, at 0.95 with 0.997, and the larger
    the cosine the surer. Equal vectors always link. A vector that is null, empty, zero, without a label or with null or
    non-finite components links with nothing. Vectors of unlike lengths are never compared. Rows that repeat an id count as
    other vectors; a null id is not kept, and is its own (null) component unless it links.

    Equal vectors are counted and represented by one. Buckets of one representative are dropped before vectors move. A
    bucket is compared in blocks of ``block_rows`` rows, each pair of blocks a task of its own, so a bucket of any size is
    compared whole. A pair that meets in several tables counts in the first. A task returns one count per row and a spanning
    forest of its links, never the pairs.
    """
    n_parts = max(1, parts(vectors.sparkSession))
    rows = cut_lineage(distinct_vectors(vectors, id_col, vector_col, label_col))
    twins = rows.where("usable").groupBy("twin").agg(F.min("vec_id").alias("first"), F.count("*").alias("many"), F.any_value("label").alias("label"), F.any_value("vector").alias("vector"))
    # Node numbers are hashes of the twin, so that they exist without ids and survive a recomputation.
    nodes = twins.withColumn("node", F.xxhash64("twin")).withColumn("dim", F.size("vector"))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims):
                some = batch.filter(pa.array(dims == dim))
                x = np.array(some.column("vector").to_pylist(), np.float64)
                x /= np.abs(x).max(axis=1, keepdims=True)
                x /= np.linalg.norm(x, axis=1, keepdims=True)
                codes = _codes(x, some.column("label").to_numpy() * 4099 + dim, tables, projections, width, seed)
                arrays = [some.column("twin"), some.column("node"), some.column("first"), some.column("many"), pa.array([r.tobytes() for r in x], pa.binary()), pa.array([r.tobytes() for r in codes], pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays, ["twin", "node", "first", "many", "unit", "codes"])

    nodes = cut_lineage(nodes.mapInArrow(hashed, "twin string, node long, first long, many long, unit binary, codes binary"))

    def spread(batch: pa.RecordBatch) -> pa.RecordBatch:
        codes = [np.frombuffer(c, np.int64) for c in batch.column("codes").to_pylist()]
        n = len(codes)
        return pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column("node").to_numpy(), tables)), pa.array(np.tile(np.arange(tables, dtype=np.int32), n)), pa.array(np.concatenate(codes))], ["node", "at", "bucket"])

    places = cut_lineage(map_batches(nodes.select("node", "codes"), spread, "node long, at int, bucket long"))
    full = cut_lineage(places.groupBy("at", "bucket").agg(F.count("*").alias("size")).where("size > 1"))
    shared = places.join(full, ["at", "bucket"]).withColumn("blocks", F.ceil(F.col("size") / block_rows)).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")))
    # Block b meets block o in the task (smaller, larger).
    shared = shared.select("node", "at", "bucket", "block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("o"))
    shared = shared.select("node", "at", "block", F.least("block", "o").alias("lo"), F.greatest("block", "o").alias("hi"), F.xxhash64("at", "bucket", F.least("block", "o"), F.greatest("block", "o")).alias("task"))
    # Tasks have at most two blocks of rows; as many groups of them as keep a group at about ``group_bytes``.
    spread_rows = full.agg(F.coalesce(F.sum(F.col("size") * F.ceil(F.col("size") / block_rows)), F.lit(0))).first()[0]
    row_bytes = nodes.agg(F.coalesce(F.max(F.length("unit") + F.length("codes")), F.lit(0))).first()[0] + 64
    groups = max(16 * n_parts, -(-spread_rows * row_bytes // group_bytes))
    members = shared.join(nodes.select("node", "many", "unit", "codes"), "node").withColumn("group", F.pmod(F.xxhash64("task"), F.lit(groups)))

    def compare(group: pa.Table) -> pa.Table:
        columns = {c: group.column(c).to_pylist() for c in ("unit", "codes")}
        numbers = {c: group.column(c).to_numpy() for c in ("task", "node", "at", "block", "lo", "hi", "many")}
        order = np.argsort(numbers["task"], kind="stable")
        cuts = np.unique(np.concatenate([[0], np.flatnonzero(np.diff(numbers["task"][order])) + 1, [len(order)]]))
        out: tuple[list, list, list] = ([], [], [])
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            at = order[lo:hi]
            node, block, many = numbers["node"][at], numbers["block"][at], numbers["many"][at]
            x = np.array([np.frombuffer(columns["unit"][k], np.float64) for k in at])
            link = x @ x.T >= cosine
            np.fill_diagonal(link, False)
            if numbers["lo"][at[0]] != numbers["hi"][at[0]]:
                link &= block[:, None] != block[None, :]
            a, b = np.nonzero(link)
            if not len(a):
                continue
            table = int(numbers["at"][at[0]])
            if table:
                codes = np.array([np.frombuffer(columns["codes"][k], np.int64)[:table] for k in at])
                for k in range(0, len(a), 65536):
                    met = (codes[a[k : k + 65536]] == codes[b[k : k + 65536]]).any(axis=1)
                    link[a[k : k + 65536][met], b[k : k + 65536][met]] = False
            a, b = np.nonzero(link)
            if not len(a):
                continue
            degree = link @ many
            label = np.arange(len(at))
            while True:
                fresh = np.where(link, label[None, :], len(at)).min(axis=1)
                fresh = np.minimum(fresh, label)
                fresh = np.minimum(fresh, fresh[fresh])
                if (fresh == label).all():
                    break
                label = fresh
            some = np.flatnonzero(degree)
            for column, values in zip(out, (node[some], degree[some], node[label][some]), strict=True):
                column.append(values)
        flat = [np.concatenate(c) if c else np.zeros(0, np.int64) for c in out]
        return pa.table([pa.array(c.astype(np.int64)) for c in flat], names=["node", "links", "to"])

    found = cut_lineage(members.groupBy("group").applyInArrow(compare, "node long, links long, to long"))
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    roots = components(found.select(F.col("node").alias("a"), F.col("to").alias("b")).where("a <> b"))
    known = nodes.select("twin", "node", "first", "many").join(counts, "node", "left").join(roots, "node", "left")
    known = cut_lineage(known.select("twin", "first", (F.coalesce("links", F.lit(0)) + F.col("many") - 1).alias("links"), F.coalesce("root", "node").alias("root")))
    lowest = cut_lineage(known.groupBy("root").agg(F.min("first").alias("component_id")))
    known = cut_lineage(known.join(lowest, "root").select("twin", "links", "component_id"))
    joined = rows.select("vec_id", "twin").join(known, "twin", "left")
    return joined.select(
        "vec_id",
        F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "vec_id").alias("component_id"),
        F.coalesce(F.col("vec_id") == F.coalesce("component_id", "vec_id"), F.lit(False)).alias("kept"),
    )
