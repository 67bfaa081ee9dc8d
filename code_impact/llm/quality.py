"""Quality of documents by supervised subword embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from code_impact.llm import subword

# Case and signs tell junk from prose, so texts are read as they are.
FEATURES = subword.Features(sizes=(3, 4), words=True, pairs=True, lower=False, blank=20)


def score_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", folds: int = 3, fold: int = 1, threshold: float = 0.5, max_rows: int = 4000) -> DataFrame:
    """(id, held_out, score, predicted): one row per document, by its whole text alone.

    Labels of held-out ids (crc32 of the id as text leaves ``fold`` of ``folds``) are never read. A null text is an empty one and
    gets the score of a text without words. Repeated rows are scored each; a null id keeps its row and has no label.
    Texts are scored in one pass without a shuffle.
    """
    out = subword.held_out(F.col(id_col), folds, fold)
    model = subword.fit(docs, labels.where(~out), FEATURES, id_col, text_col, label_col, max_rows)
    scored = docs.select(F.col(id_col), out.alias("held_out"), subword.score(F.col(text_col), model).alias("score"))
    return scored.withColumn("predicted", F.when(F.col("score") >= threshold, 1).otherwise(0))
