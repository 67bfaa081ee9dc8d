"""Documents whose sets of word n-grams overlap: a blocked sparse matrix product of documents by n-grams."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from code_impact.llm.common import ASCII_LOWER, byte_runs, map_batches, parts, unused
from code_impact.llm.components import components
from code_impact.session import cut_lineage

_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
_POWERS = np.cumprod(np.full(4096, 0x9E3779B97F4A7C15, np.uint64))
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: list[bytes], width: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of the ``width``-word shingles of each whole text; all words of a shorter one are one shingle."""
    data = b"".join(t.translate(ASCII_LOWER) + b" " for t in texts)
    b = np.frombuffer(data, np.uint8)
    space = _IS_SPACE[b]
    edge = np.flatnonzero(space[:-1] & ~space[1:]) + 1
    starts = np.concatenate([[0], edge]) if len(b) and not space[0] else edge
    empty = np.zeros(0, np.uint64)
    if not len(starts):
        return [empty] * len(texts)
    lead = starts[0]
    gaps = np.diff(np.append(starts, len(b)))
    at = np.arange(lead, len(b)) - np.repeat(starts, gaps)
    value = np.where(space[lead:], np.uint64(0), (b[lead:].astype(np.uint64) + np.uint64(1)) * _POWERS[at & 4095])
    words = np.add.reduceat(value, starts - lead)
    for k in np.flatnonzero(gaps > 4096):
        word = data[starts[k] : starts[k] + gaps[k]].rstrip(b" \t\n\x0b\x0c\r")
        if len(word) > 4096:
            words[k] = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
    words = _mixed(words)
    ends = np.cumsum([len(t) + 1 for t in texts])
    first = np.searchsorted(starts, np.concatenate([[0], ends]))
    odd = _mixed(np.arange(1, width + 1, dtype=np.uint64)) | np.uint64(1)
    n = max(len(words) - width + 1, 0)
    rolled = np.zeros(n, np.uint64)
    for k in range(width):
        rolled += words[k : k + n] * odd[k]
    rolled = _mixed(rolled)
    found = []
    for lo, hi in zip(first[:-1], first[1:], strict=True):
        if hi - lo >= width:
            found.append(np.unique(rolled[lo : hi - width + 1]))
        elif hi > lo:
            few = sum((int(words[lo + k]) * int(odd[k]) for k in range(hi - lo)), int(hi - lo))
            found.append(_mixed(np.array([few % 2**64], np.uint64)))
        else:
            found.append(empty)
    return found


def _sets(batch: pa.RecordBatch, width: int, most: int = 2 << 20) -> Iterator[np.ndarray]:
    """Sets of the texts of a batch, taken in runs of at most ``most`` bytes; a longer text is taken alone."""
    texts = [t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()]
    for lo, hi in byte_runs(texts, most):
        yield from shingle_sets(texts[lo:hi], width)


def _name(shingles: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(shingles.tobytes(), digest_size=8).digest(), "little", signed=True)


def shingle_names(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5) -> DataFrame:
    """(doc_id, n_shingles, name: hash of the whole set, null for an empty one), one row per document."""

    def named(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = list(_sets(batch, width))
        names = [_name(s) if len(s) else None for s in sets]
        return pa.RecordBatch.from_arrays([batch.column("id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(names, pa.int64())], ["doc_id", "n_shingles", "name"])

    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return map_batches(own, named, "doc_id long, n_shingles long, name long")


def _incidence(docs: DataFrame, text_col: str, width: int, blocks: int, held: int = 2_000_000) -> DataFrame:
    """(block, tops, entries, names, sizes): the incidence matrix, cut into column blocks by the leading bits of the hash.

    An entry is the lower 48 bits of the hash and the 16-bit place of its document in ``names``. Entries are in order of the whole
    hash; ``tops`` holds how many follow one another with the same upper 16 bits, and these bits. Equal sets met together count once.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets: dict[int, np.ndarray] = {}

        def flush() -> pa.RecordBatch:
            names = np.array(list(sets), np.int64)
            sizes = np.array([len(s) for s in sets.values()], np.int32)
            hashes = np.concatenate(list(sets.values()))
            owner = np.repeat(np.arange(len(names)), sizes)
            order = np.argsort(hashes)
            hashes, owner = hashes[order], owner[order]
            block = ((hashes >> np.uint64(32)) * np.uint64(blocks)) >> np.uint64(32)
            cuts = np.flatnonzero(np.diff(block, prepend=block[0] + np.uint64(1)))
            top = (hashes >> np.uint64(48)).astype(np.uint32)
            rows: tuple[list, ...] = ([], [], [], [], [])
            for lo, hi in zip(cuts, np.append(cuts[1:], len(block)), strict=True):
                used, place = np.unique(owner[lo:hi], return_inverse=True)
                entries = (hashes[lo:hi] << np.uint64(16)) | place.astype(np.uint64)
                tops = np.stack(np.unique(top[lo:hi], return_counts=True)).astype(np.uint32)
                for column, value in zip(rows, (int(block[lo]), tops.tobytes(), entries.tobytes(), names[used].tobytes(), sizes[used].tobytes()), strict=True):
                    column.append(value)
            kinds = (pa.int32(), *[pa.binary()] * 4)
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds, strict=True)], ["block", "tops", "entries", "names", "sizes"])

        total = 0
        for batch in batches:
            for shingles in _sets(batch, width):
                if len(shingles):
                    name = _name(shingles)
                    total += 0 if name in sets else len(shingles)
                    sets[name] = shingles
                if total >= held or len(sets) >= 60_000:
                    yield flush()
                    sets, total = {}, 0
        if sets:
            yield flush()

    return docs.select(F.col(text_col).alias("text")).mapInArrow(cut, "block int, tops binary, entries binary, names binary, sizes binary")


def _shared(block: pa.Table, targets: int) -> pa.Table:
    """Entries of a column block whose n-gram more than one set has, dealt to rows by the set they belong to."""
    keys, names, sizes = [], [], []
    for tops, entries, own, size in zip(*(block.column(c).to_pylist() for c in ("tops", "entries", "names", "sizes")), strict=True):
        e = np.frombuffer(entries, np.uint64)
        place = (e & np.uint64(0xFFFF)).astype(np.int64)
        top, times = np.frombuffer(tops, np.uint32).reshape(2, -1)
        keys.append((np.repeat(top.astype(np.uint64), times) << np.uint64(48)) | (e >> np.uint64(16)))
        names.append(np.frombuffer(own, np.int64)[place])
        sizes.append(np.frombuffer(size, np.int32)[place])
    key, name, size = np.concatenate(keys), np.concatenate(names), np.concatenate(sizes)
    order = np.lexsort((name, key))
    key, name, size = key[order], name[order], size[order]
    fresh = np.ones(len(key), bool)
    fresh[1:] = (key[1:] != key[:-1]) | (name[1:] != name[:-1])
    key, name, size = key[fresh], name[fresh], size[fresh]
    begins = np.flatnonzero(np.diff(key, prepend=key[0] + np.uint64(1)))
    count = np.diff(np.append(begins, len(key)))
    df = np.repeat(count, count)
    common = df > 1
    key, name, size = key[common], name[common], size[common]
    # How common an n-gram is, in steps of half a power of two, and its 64-bit hash: the order of the columns.
    rank = np.floor(2 * np.log2(np.maximum(df[common], 1))).astype(np.uint8)
    column = key
    to = (name.view(np.uint64) % np.uint64(targets)).astype(np.int64)
    order = np.lexsort((name, to))
    to, name, size, rank, column = to[order], name[order], size[order], rank[order], column[order]
    rows: tuple[list, ...] = ([], [], [], [], [], [])
    cuts = np.flatnonzero(np.diff(to, prepend=-1)) if len(to) else []
    for lo, hi in zip(cuts, np.append(cuts[1:], len(to)), strict=True) if len(to) else []:
        own, at, n = np.unique(name[lo:hi], return_index=True, return_counts=True)
        values = (int(to[lo]), own.tobytes(), size[lo:hi][at].tobytes(), n.astype(np.int32).tobytes(), column[lo:hi].tobytes(), rank[lo:hi].tobytes())
        for c, v in zip(rows, values, strict=True):
            c.append(v)
    kinds = (pa.int32(), *[pa.binary()] * 5)
    return pa.table([pa.array(c, k) for c, k in zip(rows, kinds, strict=True)], names=["target", "names", "sizes", "counts", "columns", "ranks"])


def _rows(target: pa.Table, percent: int) -> pa.Table:
    """Sets that can reach the similarity: (name, n, columns: shared n-grams, rarest first, prefix: how many of them must be joined)."""
    pieces = []
    for own, size, count in zip(*(target.column(c).to_pylist() for c in ("names", "sizes", "counts")), strict=True):
        count = np.frombuffer(count, np.int32)
        pieces.append((np.repeat(np.frombuffer(own, np.int64), count), np.repeat(np.frombuffer(size, np.int32), count)))
    name = np.concatenate([p[0] for p in pieces])
    size = np.concatenate([p[1] for p in pieces])
    column = np.concatenate([np.frombuffer(c, np.uint64) for c in target.column("columns").to_pylist()])
    rank = np.concatenate([np.frombuffer(c, np.uint8) for c in target.column("ranks").to_pylist()])
    order = np.lexsort((column, rank, name))
    name, size, column = name[order], size[order], column[order]
    cuts = np.flatnonzero(np.diff(name, prepend=name[0] - 1 if name[0] > -(2**63) else 0)) if len(name) else np.zeros(0, int)
    rows: tuple[list, ...] = ([], [], [], [])
    for lo, hi in zip(cuts, np.append(cuts[1:], len(name)), strict=True):
        n = int(size[lo])
        # Two sets link only if they share this many; n-grams that nobody else has come first in the order and are left out.
        least = -(-percent * n // 100)
        if hi - lo >= least:
            for c, v in zip(rows, (int(name[lo]), n, column[lo:hi].tobytes(), int(hi - lo - least + 1)), strict=True):
                c.append(v)
    kinds = (pa.int64(), pa.int32(), pa.binary(), pa.int32())
    return pa.table([pa.array(c, k) for c, k in zip(rows, kinds, strict=True)], names=["name", "n", "columns", "prefix"])


def overlaps(columns: list[np.ndarray], width: int = 4096) -> np.ndarray:
    """Counts of common n-grams of all pairs of rows: the product of the incidence matrix with itself, ``width`` columns at a time."""
    value = np.concatenate(columns)
    row = np.repeat(np.arange(len(columns)), [len(c) for c in columns])
    _, place, count = np.unique(value, return_inverse=True, return_counts=True)
    often = count > 1
    number = np.cumsum(often) - 1
    kept = often[place]
    row, place = row[kept], number[place[kept]]
    order = np.argsort(place, kind="stable")
    row, place = row[order], place[order]
    # A product of 4,096 columns is exact in single precision, their sum is kept in whole numbers.
    total = np.zeros((len(columns), len(columns)), np.int64)
    for lo in range(0, int(often.sum()), width):
        a, b = np.searchsorted(place, [lo, lo + width])
        dense = np.zeros((len(columns), width), np.float32)
        dense[row[a:b], place[a:b] - lo] = 1
        total += (dense @ dense.T).astype(np.int64)
    return total


def _links(rows: list[tuple[int, int, np.ndarray]], percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among rows (name, n, columns): at most one edge per row."""
    name = np.array([r[0] for r in rows], np.int64)
    n = np.array([r[1] for r in rows], np.int64)
    common = overlaps([r[2] for r in rows])
    link = 100 * common >= percent * (n[:, None] + n[None, :] - common)
    np.fill_diagonal(link, True)
    label = np.arange(len(rows))
    while True:
        fresh = np.where(link, label[None, :], len(rows)).min(axis=1)
        fresh = np.minimum(fresh, fresh[fresh])
        if (fresh == label).all():
            break
        label = fresh
    return [(int(a), int(b)) for a, b in zip(name, name[label], strict=True) if a != b]


def _product(members: DataFrame, percent: int, groups: int) -> DataFrame:
    """Links (a, b) within each ``task`` of members (task, name, n, columns); several tasks share a group."""

    def multiply(group: pa.Table) -> pa.Table:
        tasks: dict[int, dict[int, tuple[int, int, np.ndarray]]] = {}
        for task, name, n, columns in zip(*(group.column(c).to_pylist() for c in ("task", "name", "n", "columns")), strict=True):
            tasks.setdefault(task, {})[name] = (name, n, np.frombuffer(columns, np.uint64))
        edges = [e for rows in tasks.values() if len(rows) > 1 for e in _links(list(rows.values()), percent)]
        return pa.table([pa.array([e[0] for e in edges], pa.int64()), pa.array([e[1] for e in edges], pa.int64())], names=["a", "b"])

    dealt = members.select("task", "name", "n", "columns", F.pmod(F.xxhash64("task"), F.lit(groups)).alias("group"))
    return dealt.groupBy("group").applyInArrow(multiply, "a long, b long")


def linked_sets(docs: DataFrame, shingles: int, text_col: str = "text", width: int = 5, percent: int = 75, block_rows: int = 512, leaders: int = 16, entries: int = 4_000_000, product_bytes: int = 32 << 20) -> DataFrame:
    """(node, root) over the names of the sets that have a link, where 100 * common >= ``percent`` * union.

    1. The incidence matrix is cut into column blocks; in each block n-grams of one set only are dropped.
    2. Rows come together again; those that share too little of their size with anybody are dropped. Their n-grams are in order
       of rarity, so two linked sets share one of the first ``prefix``. Sets joined by such columns form clusters.
    3. Clusters are multiplied in blocks of ``block_rows`` rows, with some rows of the whole cluster in every block, and
       linked pairs become components. What remains in different components of a larger cluster is multiplied across
       blocks; two blocks of one and the same component are not. So every pair that could link is either compared or known to be
       in one component, and no pair is written: a block gives at most one edge per row.

    ``shingles`` is the sum of the sizes of all sets. Groups of columns and of rows are as many as keep them at about ``entries``
    entries (some 60 bytes each in a task) whatever the session's partitions are, those of products at ``product_bytes`` of rows.
    """
    n_parts = max(1, parts(docs.sparkSession), -(-shingles // entries))
    blocks = _incidence(docs, text_col, width, n_parts)
    shared = blocks.groupBy("block").applyInArrow(lambda t: _shared(t, n_parts), "target int, names binary, sizes binary, counts binary, columns binary, ranks binary")
    rows = cut_lineage(shared.groupBy("target").applyInArrow(lambda t: _rows(t, percent), "name long, n int, columns binary, prefix int"))

    def prefixes(batch: pa.RecordBatch) -> pa.RecordBatch:
        many = batch.column("prefix").to_numpy()
        head = [np.frombuffer(c, np.int64)[:p] for c, p in zip(batch.column("columns").to_pylist(), many, strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column("name").to_numpy(), many)), pa.array(np.concatenate(head))], ["name", "column"])

    heads = cut_lineage(map_batches(rows, prefixes, "name long, column long"))
    stars = heads.groupBy("column").agg(F.min("name").alias("b"), F.count("*").alias("many")).where("many > 1").select("column", "b")
    stars = cut_lineage(stars)
    clusters = components(heads.join(stars, "column").select(F.col("name").alias("a"), "b").distinct())
    sizes = cut_lineage(clusters.groupBy("root").agg(F.count("*").alias("many")))
    placed = clusters.join(sizes, "root").select(F.col("node").alias("name"), F.col("root").alias("cluster"), "many")
    members = cut_lineage(rows.select("name", "n", "columns").join(placed, "name"))

    blocks_of = F.ceil(F.col("many") / block_rows)
    block = F.pmod(F.xxhash64("name"), blocks_of)
    led = (F.pmod(F.xxhash64("name", F.lit(1)), F.ceil(F.col("many") / leaders)) == 0) & (blocks_of > 1)
    everywhere = F.when(led, F.sequence(F.lit(0).cast("long"), blocks_of - 1)).otherwise(F.array(block))
    held, mean = members.agg(F.coalesce(F.sum(F.length("columns") * F.size(everywhere)), F.lit(0)), F.coalesce(F.avg(F.length("columns")), F.lit(0))).first()
    inside = members.select("name", "n", "columns", F.explode(everywhere).alias("k"), "cluster").withColumn("task", F.xxhash64("cluster", "k"))
    edges = cut_lineage(_product(inside, percent, max(4 * n_parts, -(-held // product_bytes))))

    large = members.where(blocks_of > 1)
    joined = cut_lineage(components(edges))
    known = large.join(joined.withColumnRenamed("node", "name"), "name", "left").select("name", "cluster", F.coalesce("root", "name").alias("part"))
    counts = known.groupBy("cluster", "part").agg(F.count("*").alias("own"))
    pools = counts.where(F.col("own") * 2 < block_rows).groupBy("cluster").agg(F.sum("own").alias("pool"))
    counts = counts.join(pools, "cluster", "left")
    pure = F.col("own") * 2 >= block_rows
    known = known.join(counts, ["cluster", "part"]).select(
        "name",
        "cluster",
        F.when(pure, F.col("part")).alias("only"),
        F.when(pure, F.pmod(F.xxhash64("name"), F.ceil(F.col("own") / block_rows))).otherwise(-1 - F.pmod(F.xxhash64("part"), F.ceil(F.col("pool") / block_rows))).alias("k"),
    )
    known = cut_lineage(known)
    left = known.select("cluster", "only", "k").distinct().withColumn("key", F.xxhash64("cluster", "only", "k"))
    right = left.select("cluster", F.col("only").alias("only2"), F.col("key").alias("key2"))
    pairs = left.join(right, "cluster").where((F.col("key") <= F.col("key2")) & (F.col("only").isNull() | F.col("only2").isNull() | (F.col("only") != F.col("only2"))))
    pairs = pairs.select("key", "key2", F.xxhash64("key", "key2").alias("task"))
    sides = pairs.select("task", "key").unionByName(pairs.select("task", F.col("key2").alias("key"))).distinct()
    across = cut_lineage(known.select("name", F.xxhash64("cluster", "only", "k").alias("key")).join(sides, "key"))
    held = int(across.count() * mean)
    across = across.join(members.select("name", "n", "columns"), "name")
    more = cut_lineage(_product(across, percent, max(4 * n_parts, -(-held // product_bytes))))
    if more.isEmpty():
        return joined
    # What is known to be one component goes in as a star.
    return components(joined.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more))


def first_of_groups(docs: DataFrame, names: DataFrame, first: Column, text_col: str, width: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """((name, root) of all distinct sets of ``names`` (name, n_shingles, further columns), (root, first) by the aggregate ``first``).

    A set that no link leads to is its own root. ``first`` is a minimum: it is taken for each set first, so that a set with very many
    copies is summed before it meets the others.
    """
    sets = cut_lineage(names.where("name IS NOT NULL").groupBy("name").agg(F.min("n_shingles").alias("n"), F.min(first).alias("first")))
    shingles = sets.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    linked = linked_sets(docs, shingles, text_col, width, percent)
    rooted = cut_lineage(sets.join(linked, sets["name"] == linked["node"], "left").select("name", "first", F.coalesce("root", "name").alias("root")))
    return rooted.select("name", "root"), cut_lineage(rooted.groupBy("root").agg(F.min("first").alias("first")))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 75) -> DataFrame:
    """(doc_id, n_shingles, component_id: smallest id reachable by links), one row per input row.

    Words are runs of anything but ASCII white space, A-Z in lower case. A text of fewer words than ``width`` has one shingle, a null
    or empty text none: it links with nothing and is its own component. Rows with equal sets are linked, also rows that share an id;
    rows without an id do not name a component. Shingles and sets are compared by 64-bit hashes.
    """
    names = cut_lineage(shingle_names(docs, id_col, text_col, width))
    rooted, lowest = first_of_groups(docs, names, F.col("doc_id"), text_col, width, percent)
    found = cut_lineage(rooted.join(lowest, "root").select("name", F.col("first").alias("component_id")))
    return names.join(found, "name", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 75) -> DataFrame:
    """The rows of ``docs``, all columns, without all but one of each group that links lead through.

    The row with the smallest id stays, one without an id only where no row of the group has one; of several such rows, as copies
    that share an id or have none, any one. Rows without words link with nothing and all stay.
    """
    at, own_set, kept_at = (unused(c, docs) for c in ("at", "own_set", "kept_at"))

    @F.pandas_udf("name long, n_shingles long")
    def named(texts: pd.Series) -> pd.DataFrame:
        batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], ["text"])
        sets = list(_sets(batch, width))
        return pd.DataFrame({"name": pd.array([_name(s) if len(s) else None for s in sets], "Int64"), "n_shingles": [len(s) for s in sets]})

    # Stored, so that a row keeps its number.
    rows = cut_lineage(docs.withColumn(own_set, named(F.col(text_col))).withColumn(at, F.monotonically_increasing_id()))
    own = rows.select(F.col(own_set)["name"].alias("name"), F.col(own_set)["n_shingles"].alias("n_shingles"), F.col(id_col).cast("long").alias("id"), F.col(at).alias("place"))
    _, best = first_of_groups(rows, own, F.struct(F.col("id").isNull().alias("none"), "id", "place"), text_col, width, percent)
    kept = best.select(F.col("first.place").alias(kept_at))
    empty = F.col(own_set)["name"].isNull()
    one_of_group = rows.where(~empty).join(kept, F.col(at) == F.col(kept_at), "left_semi")
    return rows.where(empty).unionByName(one_of_group).select(*[F.col(f"`{c}`") for c in docs.columns])
