"""Importance resampling towards a target corpus: hashed word n-grams from running CRCs, log-ratio weights, Gumbel top-k."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from code_impact.llm.common import byte_runs, map_batches, numbered
from code_impact.session import cut_lineage

_SEEN = 0xFFFFFFFF
_MOST_BYTES = 4 << 20


def _word_bytes() -> bytes:
    """For bytes.translate: A-Z to a-z; letters, digits and all bytes outside ASCII stay; everything else is a space."""
    keeps = lambda c: c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A
    lower = [c + 32 if 0x41 <= c <= 0x5A else c for c in range(256)]
    return bytes(c if keeps(c) else 0x20 for c in lower)


_NORMAL = _word_bytes()


def _byte_table() -> np.ndarray:
    """The remainder of each byte in the CRC-32 of zlib (reflected polynomial EDB88320)."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1).astype(np.uint32)
    return table


_STEP = _byte_table()


class Shifts:
    """The linear map over GF(2) that appends zero bytes to a CRC, for each count of them, as tables by digit of base 256.

    ``tables[d]`` holds for v zero blocks of 256**d bytes and for each of the four bytes of a CRC what that byte becomes.
    """

    def __init__(self, digits: int = 5):
        unit = np.concatenate([np.arange(256, dtype=np.uint32) << np.uint32(8 * k) for k in range(4)])
        self.tables: list[np.ndarray] = []
        for d in range(digits):
            rows = [unit]
            for _ in range(255):
                rows.append(self._block(rows[-1], d))
            self.tables.append(np.concatenate(rows))

    def _block(self, crc: np.ndarray, d: int) -> np.ndarray:
        """``crc`` after 256**d zero bytes: 255 blocks and one more of the digit below."""
        if d == 0:
            return _STEP[crc & np.uint32(255)] ^ (crc >> np.uint32(8))
        return self._block(self._digit(crc, d - 1, np.full(crc.shape, 255)), d - 1)

    def _digit(self, crc: np.ndarray, d: int, value: np.ndarray) -> np.ndarray:
        at, table = value * 1024, self.tables[d]
        found = table[at + (crc & np.uint32(255))]
        for k in (1, 2, 3):
            found = found ^ table[at + (256 * k) + ((crc >> np.uint32(8 * k)) & np.uint32(255))]
        return found

    def __call__(self, crc: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Each CRC after so many zero bytes."""
        crc = crc.astype(np.uint32)
        for d in range(len(self.tables)):
            digit = (lengths >> (8 * d)) & 255
            some = np.flatnonzero(digit)
            if len(some):
                crc[some] = self._digit(crc[some], d, digit[some])
        return crc


_shifts: list[Shifts] = []


def shifts() -> Shifts:
    """The tables of this Python process."""
    if not _shifts:
        _shifts.append(Shifts())
    return _shifts[0]


def running_crcs(data: np.ndarray, places: np.ndarray, most: int = _MOST_BYTES) -> np.ndarray:
    """The CRC register, begun at 0, after the first p bytes of ``data`` for each p of the sorted ``places``.

    The bytes are laid out in lanes that one table step a column moves all at once; a lane's registers then meet those
    of the bytes before it by a shift. Only the registers of one stretch of ``most`` bytes are held at a time.
    """
    shift, found, state = shifts(), np.zeros(len(places), np.uint32), 0
    for begin in range(0, len(data), most):
        part = data[begin : begin + most]
        width = max(64, math.isqrt(len(part)))
        lanes = -(-len(part) // width)
        grid = np.zeros(lanes * width, np.uint8)
        grid[: len(part)] = part
        columns = np.ascontiguousarray(grid.reshape(lanes, width).T)
        registers = np.empty((width, lanes), np.uint32)
        crc = np.zeros(lanes, np.uint32)
        for k in range(width):
            crc = _STEP[(crc ^ columns[k]) & np.uint32(255)] ^ (crc >> np.uint32(8))
            registers[k] = crc
        before = np.empty(lanes, np.uint32)
        whole = np.array([width])
        for lane in range(lanes):
            before[lane] = state
            state = int(shift(np.array([state], np.uint32), whole)[0]) ^ int(registers[-1, lane])
        lo, hi = np.searchsorted(places, [begin + 1, begin + len(part) + 1])
        at = places[lo:hi] - begin - 1
        lane, column = at // width, at % width
        found[lo:hi] = registers[column, lane] ^ shift(before[lane], column + 1)
        if len(part) == most and len(part) < lanes * width:
            # The last lane was filled up with zeros: the register after the last true byte goes on.
            lane, column = (most - 1) // width, (most - 1) % width
            state = int(registers[column, lane]) ^ int(shift(before[lane : lane + 1], np.array([column + 1]))[0])
    return found


def ngram_crcs(texts: list[bytes], least: int, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words of each text, CRC-32 of every run of ``least`` to ``most`` words joined by one space, text it comes from).

    All texts are scanned once. The register after a run is that after the text before the run, moved over the run's
    bytes, and the run's own: the first is cancelled, and the start and end values of CRC-32 are put in.
    """
    data = np.frombuffer(b" ".join(t.translate(_NORMAL) for t in texts) + b" ", np.uint8)
    gap = data == 0x20
    begins = np.flatnonzero(~gap & np.concatenate([[True], gap[:-1]]))
    owner = np.searchsorted(np.cumsum([len(t) + 1 for t in texts]), begins, side="right")
    n_words = np.bincount(owner, minlength=len(texts))
    # One space before each word, also between texts.
    keep = ~gap
    keep[begins[begins > 0] - 1] = True
    normal = data[keep]
    gap = normal == 0x20
    starts = np.flatnonzero(~gap & np.concatenate([[True], gap[:-1]]))
    ends = np.flatnonzero(~gap & np.concatenate([gap[1:], [True]])) + 1
    after = running_crcs(normal, np.stack([starts, ends], 1).ravel()).reshape(-1, 2)
    crcs, owners = [], []
    for size in range(least, most + 1):
        first = np.arange(max(0, len(starts) - size + 1))
        first = first[owner[first] == owner[first + size - 1]]
        last = first + size - 1
        moved = shifts()(after[first, 0] ^ np.uint32(_SEEN), ends[last] - starts[first])
        crcs.append(after[last, 1] ^ moved ^ np.uint32(_SEEN))
        owners.append(owner[first])
    return n_words, np.concatenate(crcs), np.concatenate(owners)


def hashed_features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 1, most: int = 1, buckets: int = 10_000) -> DataFrame:
    """(doc_id, n_words, n_features, features: little-endian bucket numbers of all n-grams), one row per document.

    Words are runs of digits, letters and everything outside ASCII, A-Z in lower case. A null or empty text has none. Texts are
    scanned in runs of at most 4 MB, a longer one alone.
    """
    kind = "<u2" if buckets <= 1 << 16 else "<u4"

    def hashed(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()]
        words, counts, made = [], [], []
        for lo, hi in byte_runs(texts, _MOST_BYTES):
            n_words, crcs, owners = ngram_crcs(texts[lo:hi], least, most)
            n = np.bincount(owners, minlength=hi - lo)
            order = np.argsort(owners, kind="stable") if most > least else slice(None)
            bucket = (crcs[order] % np.uint32(buckets)).astype(kind)
            words += n_words.tolist()
            counts += n.tolist()
            made += [b.tobytes() for b in np.split(bucket, np.cumsum(n)[:-1])]
        columns = [batch.column("id"), pa.array(words, pa.int64()), pa.array(counts, pa.int64()), pa.array(made, pa.binary())]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "n_features", "features"])

    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return map_batches(own, hashed, "doc_id long, n_words long, n_features long, features binary")


def bucket_counts(features: DataFrame, buckets: int) -> list[int]:
    """How many features of all rows are in each bucket. A task sends at most one row a bucket, the driver gets as many."""
    kind = "<u2" if buckets <= 1 << 16 else "<u4"

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for some in batch.column("features").to_pylist():
                total += np.bincount(np.frombuffer(some, kind), minlength=buckets)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(total[used])], ["bucket", "n"])

    rows = features.select("features").mapInArrow(counted, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    found = [0] * buckets
    for r in rows:
        found[r["bucket"]] = r["n"]
    return found


def gains(source: list[int], target: list[int]) -> list[int]:
    """Thousandths of the log ratio of each bucket's smoothed share in the target and in the source, rounded down."""
    n, all_s, all_t = len(source), sum(source), sum(target)
    return [math.floor(1000 * math.log((t + 1) * (all_s + n) / ((s + 1) * (all_t + n)))) for s, t in zip(source, target, strict=True)]


def mean_gains(features: DataFrame, gain: list[int]) -> DataFrame:
    """(doc_id, n_words, n_features, weight: rounded-down mean gain of a document's features, 0 without any)."""
    kind, table = "<u2" if len(gain) <= 1 << 16 else "<u4", np.array(gain, np.int64)

    def weighed(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids = [np.frombuffer(f, kind) for f in batch.column("features").to_pylist()]
        weights = [int(table[i].sum()) // len(i) if len(i) else 0 for i in ids]
        return pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(weights, pa.int64())], ["doc_id", "n_words", "n_features", "weight"])

    return map_batches(features.select("doc_id", "n_words", "n_features", "features"), weighed, "doc_id long, n_words long, n_features long, weight long")


def gumbel(id_: Column, seed: int) -> Column:
    """Thousandths of a Gumbel number from the first 32 bits of sha256 of '<seed>:<id>', rounded down; no id is the empty text."""
    named = F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(named.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296)))


def resample(
    docs: DataFrame,
    target: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    target_text_col: str = "text",
    least: int = 1,
    most: int = 1,
    buckets: int = 10_000,
    percent: int = 10,
    min_words: int = 20,
    seed: int = 2024,
) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank): one row per input row; rank from 1 for drawn rows, else null.

    A document's weight is the mean gain of its n-grams; the score adds Gumbel noise, so that the highest ``percent`` of a hundred of
    the documents with at least ``min_words`` words are a draw without replacement by weight. Ties go to the smaller id, rows
    without an id come last among them; rows that share id and score are ranked in any order. Repeated rows count each. An
    empty target weighs by rarity in the source alone; empty documents give an empty result.

    Each text is scanned once; its buckets (two bytes an n-gram) are stored, and counted and weighed from there. Scores are whole
    numbers of a narrow range, so the driver finds the lowest score drawn from the count of each; only rows from there on are sorted.
    """
    stored = cut_lineage(hashed_features(docs, id_col, text_col, least, most, buckets))
    wanted = hashed_features(target.select(F.lit(None).cast("long").alias("id"), F.col(target_text_col).alias("text")), "id", "text", least, most, buckets)
    gain = gains(bucket_counts(stored, buckets), bucket_counts(wanted, buckets))
    scored = cut_lineage(mean_gains(stored, gain).withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed)))
    able = F.col("n_words") >= min_words
    # At most some ten thousand scores: a gain is the logarithm of a share of counts, the noise that of a 32-bit number.
    counts = scored.where(able).groupBy("score").agg(F.count("*").alias("n")).collect()
    drawn = sum(r["n"] for r in counts) * percent // 100
    above, lowest = 0, None
    for r in sorted(counts, key=lambda r: -r["score"]):
        if above >= drawn:
            break
        above, lowest = above + r["n"], r["score"]
    columns = ["doc_id", "n_words", "n_features", "weight", "score"]
    if lowest is None:
        return scored.select(*columns, F.lit(None).cast("long").alias("rank"))
    in_reach = able & (F.col("score") >= lowest)
    ordered = numbered(cut_lineage(scored.where(in_reach)), [F.col("score").desc(), F.col("doc_id").asc_nulls_last()], "place")
    ranked = ordered.select(*columns, F.when(F.col("place") < drawn, F.col("place") + 1).alias("rank"))
    return scored.where(~in_reach).select(*columns, F.lit(None).cast("long").alias("rank")).unionByName(ranked)
