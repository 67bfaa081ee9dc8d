"""Toxicity of documents by subword bags: misspelt words share the character n-gram vectors of those seen."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from code_impact.llm import subword

FEATURES = subword.Features(sizes=(3, 4, 5), words=False, pairs=False, lower=True, once=True, bits=18, blank=200)


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", folds: int = 4, fold: int = 2, max_rows: int = 4000) -> Column:
    """The score of each whole text as a column, learned from the labels of ids that are not held out."""
    out = subword.held_out(F.col(id_col), folds, fold)
    model = subword.fit(docs, labels.where(~out), FEATURES, id_col, text_col, label_col, max_rows, rate=1.0)
    return subword.score(F.col(text_col), model)


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", folds: int = 4, fold: int = 2, threshold: float = 0.3, max_rows: int = 4000) -> DataFrame:
    """(id, held_out, score, predicted): one row per document. Nulls, empty and repeated rows as in ``score_quality``."""
    score = toxicity(docs, labels, id_col, text_col, label_col, folds, fold, max_rows)
    scored = docs.select(F.col(id_col), subword.held_out(F.col(id_col), folds, fold).alias("held_out"), score.alias("score"))
    return scored.withColumn("predicted", F.when(F.col("score") >= threshold, 1).otherwise(0))
