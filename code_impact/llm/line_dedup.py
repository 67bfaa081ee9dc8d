"""Lines repeated across documents: explode normalised lines, hash, count documents per hash, drop, reassemble by position."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from code_impact.llm.common import ASCII_LOWER, ASCII_SPACE, NO_ID, map_batches
from code_impact.session import cut_lineage


def line_hashes(text: bytes, min_chars: int) -> list[bytes | None]:
    """One 16-byte hash per line, None for a line whose key is shorter than ``min_chars`` code points.

    A key is the line without ASCII white space at its ends and with A-Z in lower case.
    """
    found: list[bytes | None] = []
    for line in text.translate(ASCII_LOWER).split(b"\n"):
        key = line.strip(ASCII_SPACE)
        short = len(key) < min_chars or (len(key) < 4 * min_chars and len(key.decode()) < min_chars)
        found.append(None if short else hashlib.blake2b(key, digest_size=16).digest())
    return found


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 2, min_chars: int = 10) -> DataFrame:
    """Drop lines found in at least ``min_docs`` documents, except in the document with the smallest id that holds them.

    Returns (``row``: all input columns, ``text``: kept lines joined by a newline, ``n_lines``, ``n_dropped``), one row per
    input row. A null or empty text is one empty line and is returned as ''. Rows that share an id are one document. Rows
    without an id are one document too, which comes after all others. Lines are compared by 128-bit hashes of their keys.

    Narrow (hash, id) rows are counted in two steps (per document, then per hash), so that a line of a third of all
    documents is summed before it meets in one task; marking the lines is a join that is split where it is skewed. Texts are
    shuffled once, by document.
    """
    own = docs.select(F.struct("*").alias("row"), F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("doc"), F.col(text_col).alias("text"))

    def explode(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, hashes = [], []
        for doc, text in zip(batch.column("doc").to_pylist(), batch.column("text").to_pylist(), strict=True):
            found = {h for h in line_hashes((text or "").encode(), min_chars) if h}
            ids += [doc] * len(found)
            hashes += found
        both = np.frombuffer(b"".join(hashes), "<i8").reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(both[:, 0]), pa.array(both[:, 1])], ["doc", "h1", "h2"])

    lines = cut_lineage(map_batches(own.select("doc", "text"), explode, "doc long, h1 long, h2 long"))
    repeated = lines.groupBy("h1", "h2").agg(F.count_distinct("doc").alias("n_docs"), F.min("doc").alias("first"))
    repeated = cut_lineage(repeated.where(F.col("n_docs") >= min_docs).select("h1", "h2", "first"))
    drops = (
        lines.join(repeated, ["h1", "h2"])
        .where(F.col("doc") != F.col("first"))
        .groupBy("doc")
        .agg(F.collect_set(F.struct("h1", "h2")).alias("drops"))
        .select("doc", F.transform("drops", lambda d: d["h1"]).alias("d1"), F.transform("drops", lambda d: d["h2"]).alias("d2"))
    )

    @F.pandas_udf("text string, n_lines long, n_dropped long")
    def reassemble(text: pd.Series, d1: pd.Series, d2: pd.Series) -> pd.DataFrame:
        rows = []
        for value, left, right in zip(text, d1, d2, strict=True):
            value = value or ""
            all_lines = value.split("\n")
            if left is None or not len(left):
                rows.append((value, len(all_lines), 0))
                continue
            gone = {a.tobytes() for a in np.column_stack([left, right]).astype("<i8")}
            kept = [line for line, h in zip(all_lines, line_hashes(value.encode(), min_chars), strict=True) if h not in gone]
            rows.append(("\n".join(kept), len(all_lines), len(all_lines) - len(kept)))
        return pd.DataFrame(rows, columns=["text", "n_lines", "n_dropped"])

    joined = own.join(drops, "doc", "left")
    return joined.select("row", reassemble("text", "d1", "d2").alias("r")).select("row", "r.text", "r.n_lines", "r.n_dropped")
