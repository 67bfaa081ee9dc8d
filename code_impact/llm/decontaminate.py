"""Benchmark windows inside documents: a prefix-filtered containment join, in DataFrame operations only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from code_impact.functions.arrays import with_once
from code_impact.llm.common import lower_ascii, unused
from code_impact.session import cut_lineage

# Everything in ASCII but digits and letters parts words. Letters are put in lower case later.
BETWEEN_WORDS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, BETWEEN_WORDS), "")


def item_windows(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", width: int = 10) -> DataFrame:
    """(item_id as string, window: its words joined by spaces, size): ``width`` words from each place, or all of a shorter item."""
    items = with_once(benchmark.select(F.col(id_col).cast("string").alias("item_id"), F.col(text_col).alias("t")), "ws", words(F.col("t")))
    items = items.where(F.size("ws") > 0).withColumn("size", F.least(F.lit(width), F.size("ws")))
    starts = items.select("item_id", "ws", "size", F.explode(F.sequence(F.lit(1), F.size("ws") - F.col("size") + 1)).alias("at"))
    window = lower_ascii(F.array_join(F.slice("ws", F.col("at"), F.col("size")), " "))
    return starts.select("item_id", window.alias("window"), "size").distinct()


def _blocks(rows: DataFrame, by: str, text_bytes: Column, most_rows: int, most_bytes: int) -> list[DataFrame]:
    """``rows`` in blocks that are small enough to be sent to every executor, however many there are."""
    n, size = rows.agg(F.count("*"), F.coalesce(F.sum(text_bytes), F.lit(0))).first()
    blocks = max(1, -(-n // most_rows), -(-size // most_bytes))
    if blocks == 1:
        return [rows]
    return [rows.where(F.pmod(F.xxhash64(by), F.lit(blocks)) == k) for k in range(blocks)]


# Words of a shingle, the token that windows are looked up by; a shorter window is one shingle.
SHINGLE = 3


def _shingles(rows: DataFrame, keys: list[str], widths: list[int]) -> DataFrame:
    """(keys, ws, pos, shingle: hash) of all runs of words in ``ws`` with one of the widths; 0 where a run would pass the end.

    Words are exploded and the words after them looked up in their row, which compiles; no filter, as it would hash twice.
    """
    each_word = rows.select(*keys, "ws", F.posexplode("ws").alias("pos", "word"))
    following = lambda j: F.get("ws", F.col("pos") + j)
    run = lambda w: F.when(F.col("pos") + w <= F.size("ws"), F.xxhash64(F.lit(w), "word", *[following(j) for j in range(1, w)])).otherwise(F.lit(0).cast("long"))
    found = run(widths[0]) if len(widths) == 1 else F.explode(F.array(*[run(w) for w in widths]))
    return each_word.select(*keys, "ws", "pos", found.alias("shingle"))


def _shingle_rows(docs: DataFrame, widths: list[int]) -> DataFrame:
    """(key columns, ws, pos, shingle) for each run of words of a whole text."""
    return _shingles(with_once(docs, "ws", words(lower_ascii(F.col("text")))), ["doc_id", "text_hash"], widths)


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_hash, text): rows that share an id but not a text are told apart."""
    return docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(text_col)).alias("text_hash"), F.col(text_col).alias("text"))


def window_hits(docs: DataFrame, windows: DataFrame, most_rows: int = 500_000, most_bytes: int = 64 << 20) -> DataFrame:
    """(doc_id, text_hash, start, size, window) of all places where a window's words stand in a text, one after another.

    Containment must be whole, so the prefix of a window is one token: its rarest shingle of three words, counted over all
    documents (a window of fewer words is one shingle). Shingles of the documents that are such a prefix give candidates; a
    window that would begin before the text or end after it is dropped by its position and size, and the rest is compared
    word by word where it stands. The windows are the stated query set: they are sent out in blocks of bounded rows and bytes, each block
    against all documents. No document shingle is shuffled but for the counts, which are summed in the tasks first.
    Shingles meet by hash; two that share one only give a candidate more.
    """
    spots = windows.select("window", "size").distinct()
    widths = sorted(r[0] for r in spots.select(F.least("size", F.lit(SHINGLE))).distinct().collect()) or [SHINGLE]
    parted = with_once(spots, "ws", F.split("window", " "))
    by_width = [_shingles(parted.where(F.least("size", F.lit(SHINGLE)) == w), ["window", "size"], [w]) for w in widths]
    spots = reduce(DataFrame.unionByName, by_width).where(F.col("pos") + F.least("size", F.lit(SHINGLE)) <= F.col("size"))
    spots = cut_lineage(spots.select("window", "size", F.col("pos").alias("place"), "shingle"))
    vocabulary = cut_lineage(spots.select("shingle").distinct())
    every_one = _shingle_rows(docs, widths).select("shingle")
    counted = [every_one.join(F.broadcast(b), "shingle", "left_semi") for b in _blocks(vocabulary, "shingle", F.lit(8), most_rows, most_bytes)]
    counts = reduce(DataFrame.unionByName, counted).groupBy("shingle").agg(F.count("*").alias("n"))
    # A shingle that no document has cannot begin a match, and neither can its windows.
    rarest = spots.join(counts, "shingle", "left").groupBy("window", "size").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "place", "shingle")).alias("p"))
    prefixes = cut_lineage(rarest.where("p.n > 0").select("window", "size", "p.place", "p.shingle"))
    found = []
    for block in _blocks(prefixes, "window", F.octet_length("window"), most_rows, most_bytes):
        near = _shingle_rows(docs, widths).join(F.broadcast(block), "shingle")
        start = F.col("pos") - F.col("place")
        near = near.where((start >= 0) & (start + F.col("size") <= F.size("ws")))
        same = F.array_join(F.slice("ws", start + 1, F.col("size")), " ") == F.col("window")
        found.append(near.where(same).select("doc_id", "text_hash", start.alias("start"), "size", "window"))
    return reduce(DataFrame.unionByName, found)


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", width: int = 10) -> DataFrame:
    """(doc_id, text_hash, n_words, n_hit, item_ids: sorted strings), one row per input row.

    Words are runs of digits, letters and everything outside ASCII, A-Z in lower case. A null or empty text has no words. An item
    without words has no window; items without an id hit but are not listed. Repeated rows get the same result each.
    The items of a document are listed in its row, so that list is as long as the items that it contains.
    """
    own = keyed(docs, id_col, text_col)
    windows = cut_lineage(item_windows(benchmark, item_col, item_text_col, width))
    hits = cut_lineage(window_hits(own, windows).distinct())
    order = Window.partitionBy("doc_id", "text_hash").orderBy("start", "size").rowsBetween(Window.unboundedPreceding, -1)
    spans = hits.select("doc_id", "text_hash", "start", "size").distinct()
    end = F.col("start") + F.col("size")
    fresh = F.greatest(F.lit(0), end - F.greatest(F.col("start"), F.coalesce(F.max(end).over(order), F.lit(0))))
    covered = spans.withColumn("fresh", fresh).groupBy("doc_id", "text_hash").agg(F.sum("fresh").cast("long").alias("n_hit"))
    listed = hits.select("doc_id", "text_hash", "window").distinct().join(windows.where("item_id IS NOT NULL").select("window", "item_id"), "window")
    listed = listed.groupBy("doc_id", "text_hash").agg(F.sort_array(F.collect_set("item_id")).alias("item_ids"))
    rows = own.select("doc_id", "text_hash", F.coalesce(F.size(words(F.col("text"))), F.lit(0)).cast("long").alias("n_words"))
    rows = rows.withColumn("n_words", F.greatest(F.col("n_words"), F.lit(0)))
    for part in (covered, listed):
        part = part.withColumnsRenamed({"doc_id": "other_id", "text_hash": "other_hash"})
        rows = rows.join(part, F.col("doc_id").eqNullSafe(F.col("other_id")) & F.col("text_hash").eqNullSafe(F.col("other_hash")), "left").drop("other_id", "other_hash")
    return rows.select("doc_id", "text_hash", "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"), F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 10) -> DataFrame:
    """The rows of ``docs``, all columns, that hold no benchmark window."""
    hits = window_hits(keyed(docs, id_col, text_col), cut_lineage(item_windows(benchmark, width=width)))
    id_, hash_ = unused("id", docs), unused("hash", docs)
    hits = hits.select(F.col("doc_id").alias(id_), F.col("text_hash").alias(hash_)).distinct()
    return docs.join(hits, F.col(id_col).eqNullSafe(F.col(id_)) & (F.xxhash64(F.col(text_col)) == F.col(hash_)), "left_anti")
