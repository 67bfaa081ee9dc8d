"""Packing of tokenised documents into windows by non-negative least squares over the histogram of piece lengths."""

from __future__ import annotations

import base64
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from code_impact.llm.common import map_batches, parts
from code_impact.session import cut_lineage

RANKS, VOCABULARY = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("byte_bpe_50k.json")
_encoders: dict[tuple[str, str], Encoder] = {}


class Encoder:
    """Byte-level BPE ids of whole texts as little-endian unsigned 32-bit integers.

    A text is cut at its single spaces, which never lie inside a token's word, and the ids of each part are remembered, up
    to ``remembered`` parts. Parts of letters, digits and ASCII signs are encoded from the rank file, all others and every
    text with white space beside a space by the ``tokenizers`` library; both hold the same vocabulary. So is a text that holds
    one of the vocabulary's added tokens, such as an end of text written out, which the library reads as that token.
    """

    def __init__(self, ranks: str, vocabulary: str, remembered: int = 300_000):
        with open(ranks, "rb") as lines:
            table = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
        self.whole = Tokenizer.from_file(vocabulary)
        self.added = [token.content for token in self.whole.get_added_tokens_decoder().values()]
        self.remembered = remembered
        self.known: dict[str, bytes | None] = {}

    def _library(self, text: str) -> bytes:
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _part(self, part: str) -> bytes | None:
        """Ids of a part, None if its ends make the cut unsafe."""
        core = part[1:] if part.startswith(" ") else part
        if not core or core[0].isspace() or core[-1].isspace():
            made = None
        elif all(c.isalpha() or "!" <= c <= "~" or c == "\n" for c in core):
            made = np.array(self.fast.encode_ordinary(part), "<u4").tobytes()
        else:
            made = self._library(part)
        if len(self.known) < self.remembered and len(part) <= 64:
            self.known[part] = made
        return made

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        if any(token in text for token in self.added):
            return self._library(text)
        known = self.known
        first, *rest = text.split(" ")
        found = []
        for part in [first, *(" " + p for p in rest)]:
            ids = known.get(part) or self._part(part)
            if ids is None:
                return self._library(text)
            found.append(ids)
        return b"".join(found)


def encoder(ranks: str = RANKS, vocabulary: str = VOCABULARY) -> Encoder:
    """The encoder of this Python process."""
    if (ranks, vocabulary) not in _encoders:
        _encoders[ranks, vocabulary] = Encoder(ranks, vocabulary)
    return _encoders[ranks, vocabulary]


def cut_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 2048, end_id: int = 1, ranks: str = RANKS, vocabulary: str = VOCABULARY) -> DataFrame:
    """Pieces of at most ``window`` ids: (doc_id, start, length, doc_tokens, ids: little-endian unsigned 32-bit integers).

    Each document ends with ``end_id``; a null text is empty and so becomes one piece of one id. Only the last piece of a
    document is shorter than the window. Repeated rows are cut each on its own; a null id stays null.
    """

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        encode = encoder(ranks, vocabulary).encode
        end = int(end_id).to_bytes(4, "little")
        docs_, starts, lengths, totals, ids = [], [], [], [], []
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            data = encode(text or "") + end
            n = len(data) // 4
            for start in range(0, n, window):
                piece = data[4 * start : 4 * (start + window)]
                docs_.append(doc)
                starts.append(start)
                lengths.append(len(piece) // 4)
                totals.append(n)
                ids.append(piece)
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
        made = [pa.array(v, k) for v, k in zip((docs_, starts, lengths, totals, ids), kinds, strict=True)]
        return pa.RecordBatch.from_arrays(made, ["doc_id", "start", "length", "doc_tokens", "ids"])

    own = docs.select(F.col(id_col).cast("long"), F.col(text_col))
    return map_batches(own, cut, "doc_id long, start long, length long, doc_tokens long, ids binary")


def combinations(window: int, quantum: int, depth: int) -> list[Counter]:
    """All ways to fill the window exactly with at most ``depth`` lengths that are multiples of ``quantum``."""
    found: list[Counter] = []

    def extend(left: int, most: int, deep: int, taken: tuple[int, ...]) -> None:
        if left == 0:
            found.append(Counter(taken))
        elif deep:
            for size in range(min(most, left), 0, -1):
                if size * deep < left:
                    break
                extend(left - size, size, deep - 1, (*taken, size * quantum))

    extend(window // quantum, window // quantum, depth, ())
    return found


def nnls(matrix: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Non-negative least squares by an active set: columns enter by steepest gradient, and leave when they turn negative."""
    scale = target.max(initial=0) or 1.0
    target = target / scale
    x, active = np.zeros(matrix.shape[1]), np.zeros(matrix.shape[1], bool)
    # A combination has few lengths, so the gradient is summed over its entries alone.
    column, row = np.nonzero(matrix.T)
    weight, begins = matrix[row, column], np.flatnonzero(np.diff(column, prepend=-1))

    def solved() -> np.ndarray:
        cols = matrix[:, active]
        gram = cols.T @ cols
        return np.linalg.solve(gram + 1e-10 * np.eye(len(gram)), cols.T @ target)

    for _ in range(3 * len(target)):
        rest = target - matrix[:, active] @ x[active]
        gradient = np.zeros(len(x))
        gradient[column[begins]] = np.add.reduceat(weight * rest[row], begins) if len(begins) else 0
        gradient[active] = 0
        if gradient.max(initial=0) < 1e-7:
            break
        active[gradient.argmax()] = True
        for _ in range(len(target)):
            fresh = solved()
            if (fresh > 0).all():
                break
            old = x[active]
            falling = fresh <= 0
            step = (old[falling] / np.maximum(old[falling] - fresh[falling], 1e-30)).min()
            x[active] = old + step * (fresh - old)
            active[active] = x[active] > 1e-12
            x[~active] = 0
        x[:] = 0
        if active.any():
            x[active] = np.maximum(solved(), 0)
    return x * scale


def plan_windows(histogram: dict[int, int], window: int = 2048, quantum: int = 8, depth: int = 3) -> list[tuple[dict[int, int], int]]:
    """[(pieces of each size in a sequence, number of such sequences)] that use up the histogram of sizes.

    Repeat counts of shallow combinations are solved by least squares against the histogram, rounded as far as the counts
    allow, largest first; what is left is packed by best fit, largest size first, on counts and not on pieces. The work
    depends on the number of sizes, not on the number of pieces.
    """
    left = Counter({s: n for s, n in histogram.items() if n > 0})
    plan: list[tuple[dict[int, int], int]] = []
    units = [quantum * k for k in range(1, window // quantum + 1)]
    target = np.array([left[u] for u in units], float)
    if target.any():
        ways = [w for w in combinations(window, quantum, depth) if all(left[s] for s in w)]
        matrix = np.array([[w[u] for w in ways] for u in units], float).reshape(len(units), len(ways))
        counts = np.rint(nnls(matrix, target)).astype(int) if ways else []
        for k in np.argsort(-np.asarray(counts), kind="stable"):
            n = min([int(counts[k]), *(left[s] // m for s, m in ways[k].items())])
            if n > 0:
                plan.append((dict(ways[k]), n))
                for s, m in ways[k].items():
                    left[s] -= n * m
    # Open sequences by the room that is left in them.
    rooms: dict[int, list[tuple[Counter, int]]] = {}
    for size in sorted((s for s in left if left[s]), reverse=True):
        count = left[size]
        while count:
            room = min((r for r in rooms if r >= size), default=None)
            if room is None:
                each = window // size
                full, odd = divmod(count, each)
                for n, m in ((full, each), (1, odd)):
                    if n and m:
                        rooms.setdefault(window - m * size, []).append((Counter({size: m}), n))
                break
            held, open_ = rooms[room].pop()
            each = min(room // size, count)
            fit = min(open_, count // each)
            if open_ > fit:
                rooms[room].append((held, open_ - fit))
            if not rooms[room]:
                del rooms[room]
            rooms.setdefault(room - each * size, []).append((held + Counter({size: each}), fit))
            count -= fit * each
    return plan + [(dict(held), n) for kept in rooms.values() for held, n in kept]


def _size(length: Column, quantum: int) -> Column:
    return F.when(length <= 2 * quantum, length).otherwise((F.ceil(length / quantum) * quantum).cast("long"))


def pack(pieces: DataFrame, window: int = 2048, quantum: int = 8, depth: int = 3) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to pieces (doc_id, start, length, further columns).

    Lengths are planned in steps of ``quantum``, tiny ones exactly; the offsets in a sequence have no gaps. Only the
    histogram of at most ``window`` sizes goes to the driver. Pieces of one size are numbered in salted groups, dealt in turn
    whatever they hold, and the groups' counts are summed, so that neither a size with a third of all pieces nor as many equal
    pieces are numbered in one task. Equal rows may swap places. Further columns may have any names but the two added.
    """
    if {"sequence_id", "offset"} & {c.lower() for c in pieces.columns}:
        raise ValueError("pieces must not have columns sequence_id or offset")
    spark = pieces.sparkSession
    salts = max(1, parts(spark))
    salt = F.pmod(F.monotonically_increasing_id(), F.lit(salts))
    marked = cut_lineage(pieces.select(F.struct("*").alias("row"), "doc_id", "start", "length", _size(F.col("length"), quantum).alias("size"), salt.alias("salt")))
    counts = cut_lineage(marked.groupBy("size", "salt").agg(F.count("*").alias("n")))
    histogram = {r["size"]: r["n"] for r in counts.groupBy("size").agg(F.sum("n").alias("n")).collect()}

    slots, rank, sequence = [], Counter(), 0
    for held, n in plan_windows(histogram, window, quantum, depth):
        for size, times in held.items():
            slots.append((size, rank[size], rank[size] + times * n, sequence, n))
            rank[size] += times * n
        sequence += n
    table = spark.createDataFrame(slots, "size long, from long, to long, first long, n long")

    before = Window.partitionBy("size").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    # Stored, so that the join below deals pieces by size and salt and not by size alone, as the window before it does.
    starts = counts.select("size", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    starts = cut_lineage(starts)
    order = Window.partitionBy("size", "salt").orderBy("doc_id", "start", "length")
    ranked = (
        marked.withColumn("at", F.row_number().over(order) - 1)
        .join(starts, ["size", "salt"])
        .withColumn("rank", F.col("before") + F.col("at"))
    )
    # At most one row per size and planned combination: bounded by the window, not by the data.
    placed = ranked.join(F.broadcast(table), "size").where((F.col("rank") >= F.col("from")) & (F.col("rank") < F.col("to")))
    placed = placed.withColumn("sequence_id", F.col("first") + (F.col("rank") - F.col("from")) % F.col("n"))
    # A sequence holds at most ``window`` pieces.
    inside = Window.partitionBy("sequence_id").orderBy(F.col("length").desc(), "doc_id", "start").rowsBetween(Window.unboundedPreceding, -1)
    return placed.select("row.*", "sequence_id", F.coalesce(F.sum("length").over(inside), F.lit(0)).cast("long").alias("offset"))
