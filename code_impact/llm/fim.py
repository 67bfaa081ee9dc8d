"""Fill-in-the-middle: whole lines of a text dealt to prefix, middle and suffix and put in a new order, by pyarrow.compute."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from code_impact.llm.common import map_batches

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"


def draws(id_: Column, seed: int) -> list[Column]:
    """Four 32-bit numbers from sha256 of '<seed>:<id>'; no id is the empty text."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def _units(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """(units of all texts, parent of each, its ordinal there, units of each text): lines with the newline that ends them."""
    lists = pc.split_pattern(texts, "\n")
    flat, parent = pc.list_flatten(lists), pc.list_parent_indices(lists).to_numpy(zero_copy_only=False)
    counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    ordinal = np.arange(len(flat)) - np.repeat(np.cumsum(counts) - counts, counts)
    # What follows the last newline has none, and is no unit if it is empty.
    last = ordinal == counts[parent] - 1
    ends = pc.if_else(pa.array(last), "", "\n")
    real = ~last | (pc.binary_length(flat).to_numpy(zero_copy_only=False) > 0)
    units = pc.filter(pc.binary_join_element_wise(flat, ends.cast(flat.type), pa.scalar("", flat.type)), pa.array(real))
    return units, parent[real], ordinal[real], np.bincount(parent[real], minlength=len(texts))


def _joined(units: pa.Array, parent: np.ndarray, chosen: np.ndarray, rows: int) -> pa.Array:
    """For each row the chosen units of it as one text."""
    some = pc.filter(units, pa.array(chosen))
    ends = np.concatenate([[0], np.cumsum(np.bincount(parent[chosen], minlength=rows))])
    lists = pa.LargeListArray.from_arrays(pa.array(ends, pa.int64()), some)
    return pc.binary_join(lists, pa.scalar("", units.type))


def transform_batch(batch: pa.RecordBatch, rate: int, spm: int) -> pa.RecordBatch:
    """A batch (text, h1 to h4, further columns) with its texts transformed; see ``fill_in_middle``."""
    texts = pc.fill_null(batch.column("text").cast(pa.large_string()), "")
    h1, h2, h3, h4 = (batch.column(f"h{k}").to_numpy(zero_copy_only=False) for k in (1, 2, 3, 4))
    units, parent, ordinal, n = _units(texts)
    a, b = h1 % (n + 1), h2 % (n + 1)
    low, high = np.minimum(a, b)[parent], np.maximum(a, b)[parent]
    prefix, middle, suffix = (_joined(units, parent, role, len(texts)) for role in (ordinal < low, (ordinal >= low) & (ordinal < high), ordinal >= high))
    marked = pc.match_substring_regex(texts, f"{PREFIX}|{SUFFIX}|{MIDDLE}")
    plain = pc.or_(pc.or_(pc.equal(texts, ""), marked), pa.array(h3 % 100 >= rate))
    first = pa.array(h4 % 100 < spm)
    form = pc.if_else(plain, "plain", pc.if_else(first, "spm", "psm"))
    sign = {s: pa.scalar(s, pa.large_string()) for s in (PREFIX, SUFFIX, MIDDLE, "")}
    psm = pc.binary_join_element_wise(sign[PREFIX], prefix, sign[SUFFIX], suffix, sign[MIDDLE], middle, sign[""])
    spm_ = pc.binary_join_element_wise(sign[SUFFIX], suffix, sign[PREFIX], prefix, sign[MIDDLE], middle, sign[""])
    output = pc.if_else(plain, texts, pc.if_else(first, spm_, psm))
    chars = [pc.if_else(plain, None, pc.utf8_length(p)).cast(pa.int64()) for p in (prefix, middle)]
    names = ["id", "n", "form", "prefix_chars", "middle_chars", "output"]
    return pa.RecordBatch.from_arrays([batch.column("id"), pa.array(n, pa.int64()), form.cast(pa.string()), *chars, output.cast(pa.string())], names)


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rate: int = 100, spm: int = 50, seed: int = 7) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output), one row per input row.

    A text is cut into ``n`` lines, each with its newline. Two draws by the id set where prefix and middle end. Output in form
    psm: ``<P>`` prefix ``<S>`` suffix ``<M>`` middle; in form spm (``spm`` of a hundred): ``<S>`` suffix ``<P>`` prefix ``<M>``
    middle. Form plain, with the text itself: empty and null texts (output ''), texts that hold a sign, and all but ``rate`` of a
    hundred. Rows with one id are drawn alike; rows without an id are drawn by the empty text. No shuffle: a text is
    transformed where it is read, in batches cut by bytes.
    """
    h = [d.alias(f"h{k}") for k, d in enumerate(draws(F.col(id_col), seed), 1)]
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), *h)
    made = map_batches(own, lambda batch: transform_batch(batch, rate, spm), "id long, n long, form string, prefix_chars long, middle_chars long, output string")
    return made.withColumnRenamed("id", "doc_id")


def restored(output: Column, form: Column) -> Column:
    """The text an output was made from."""
    # An output that is not plain has each sign once: no piece holds one, and none can arise where pieces meet.
    pieces = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    psm = F.concat(F.get(pieces, F.lit(1)), F.get(pieces, F.lit(3)), F.get(pieces, F.lit(2)))
    spm = F.concat(F.get(pieces, F.lit(2)), F.get(pieces, F.lit(3)), F.get(pieces, F.lit(1)))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
