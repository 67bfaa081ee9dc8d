"""From raw documents to packed training sequences: five stages, each written as Parquet and read again by the next.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame. All but the last keep
the columns of documents. ``docs`` may hold nulls, empty and very long texts, repeated rows and more columns: every stage
keeps a row's further columns, and treats nulls and repeats as its operator says. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from code_impact.llm import decontaminate, line_dedup, ngram_join, packing, toxicity
from code_impact.llm.common import prepare, table
from code_impact.session import cut_lineage


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below 0.3."""
    prepare(spark)
    score = toxicity.toxicity(docs, table(spark, sf_dir, "labels"))
    return docs.where(score < 0.3)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that an earlier document has; ``n_chars`` follows the text.

    Every document stays, also one that is left with no line: whether it is worth keeping is for other stages to say.
    """
    prepare(spark)
    kept = line_dedup.dedup_lines(docs)
    new = {"text": F.col("text"), "n_chars": F.length("text").cast(docs.schema["n_chars"].dataType) if "n_chars" in docs.columns else None}
    return kept.select(*[new[c].alias(c) if new.get(c) is not None else F.col("row").getField(c).alias(c) for c in docs.columns])


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each group linked by n-gram overlap."""
    prepare(spark)
    return ngram_join.keep_one(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item."""
    prepare(spark)
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their place in sequences of 2048 tokens."""
    prepare(spark)
    pieces = packing.cut_tokens(docs).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens")
    return packing.pack(pieces)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("ngram_jaccard", keep_one_of_each),
    ("decontamination", drop_leaks),
    ("packing", pack_windows),
]

# Neither the classifier nor the tokenizer can be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return docs
