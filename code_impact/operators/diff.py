"""Differences between two extractions of the same repositories."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Texts of the findings.
CLASS_REMOVED = "Clase '%s' eliminada"
METHOD_REMOVED = "Método público '%s' eliminado de %s"
SIGNATURE_CHANGED = "Firma del método '%s' cambiada en %s"

COLUMNS = ["repository", "type", "severity", "description", "class", "method", "file", "line"]


def _classes(types: DataFrame) -> DataFrame:
    """One row per (repository, class); the last one wins."""
    best = types.groupBy("repository", "name").agg(F.max_by(F.struct("path", "methods"), F.struct("path", "pos")).alias("w"))
    return best.select("repository", F.col("name").alias("class"), F.col("w.path").alias("path"), F.col("w.methods").alias("methods"))


def _methods(classes: DataFrame) -> DataFrame:
    """One row per (repository, class, method name); the last overload wins."""
    rows = classes.select("repository", "class", "path", F.posexplode("methods").alias("no", "m"))
    best = rows.groupBy("repository", "class", "m.name").agg(
        F.max_by(F.struct(F.col("path"), F.col("m.signature").alias("signature"), F.col("m.line").alias("line")), F.col("no")).alias("w")
    )
    return best.select("repository", "class", F.col("name").alias("method"), "w.*")


def classes_removed(old: DataFrame, new: DataFrame) -> DataFrame:
    keys = ["repository", "class"]
    gone = _classes(old).join(_classes(new).select(keys), keys, "left_anti")
    return gone.select(
        "repository", F.lit("class_removed").alias("type"), F.lit("critical").alias("severity"),
        F.format_string(CLASS_REMOVED, "class").alias("description"), "class", F.lit(None).cast("string").alias("method"),
        F.col("path").alias("file"), F.lit(0).alias("line"),
    )


def methods_removed(old: DataFrame, new: DataFrame) -> DataFrame:
    keys = ["repository", "class"]
    new_classes = _classes(new)
    surviving = _methods(_classes(old)).join(new_classes.select(keys), keys, "left_semi")
    gone = surviving.join(_methods(new_classes).select(*keys, "method"), [*keys, "method"], "left_anti")
    return gone.select(
        "repository", F.lit("method_removed").alias("type"), F.lit("major").alias("severity"),
        F.format_string(METHOD_REMOVED, "method", "class").alias("description"), "class", "method",
        F.col("path").alias("file"), "line",
    )


def signatures_changed(old: DataFrame, new: DataFrame) -> DataFrame:
    before = _methods(_classes(old)).select("repository", "class", "method", F.col("signature").alias("_old"))
    after = _methods(_classes(new))
    changed = before.join(after, ["repository", "class", "method"]).where(F.col("_old") != F.col("signature"))
    return changed.select(
        "repository", F.lit("signature_changed").alias("type"), F.lit("major").alias("severity"),
        F.format_string(SIGNATURE_CHANGED, "method", "class").alias("description"), "class", "method",
        F.col("path").alias("file"), "line",
    )


def breaking_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """Removed classes, removed methods and changed signatures in one pass over each side."""
    a, b = _classes(old), _classes(new)
    keys = ["repository", "class"]
    gone_columns = [F.lit("class_removed").alias("type"), F.lit("critical").alias("severity")]
    removed = a.join(b.select(keys), keys, "left_anti").select(
        "repository", *gone_columns, F.format_string(CLASS_REMOVED, "class").alias("description"), "class",
        F.lit(None).cast("string").alias("method"), F.col("path").alias("file"), F.lit(0).alias("line"),
    )
    before = _methods(a.join(b.select(keys), keys, "left_semi"))
    after = _methods(b).select(*keys, "method", F.struct("path", "signature", "line").alias("_new"))
    paired = before.join(after, [*keys, "method"], "left").where(F.col("_new").isNull() | (F.col("_new.signature") != F.col("signature")))
    is_gone = F.col("_new").isNull()
    members = paired.select(
        "repository",
        F.when(is_gone, "method_removed").otherwise("signature_changed").alias("type"),
        F.lit("major").alias("severity"),
        F.when(is_gone, F.format_string(METHOD_REMOVED, "method", "class"))
        .otherwise(F.format_string(SIGNATURE_CHANGED, "method", "class")).alias("description"),
        "class", "method",
        F.coalesce(F.col("_new.path"), F.col("path")).alias("file"),
        F.coalesce(F.col("_new.line"), F.col("line")).alias("line"),
    )
    return removed.select(COLUMNS).unionByName(members.select(COLUMNS))


def new_methods(old: DataFrame, new: DataFrame) -> DataFrame:
    """Methods of the new version with no equal name and signature in the same class before."""
    flat = lambda types: _classes(types).select("repository", "class", "path", F.explode("methods").alias("m")).select(
        "repository", "class", "path", F.col("m.name").alias("method"), F.col("m.signature").alias("signature")
    )
    keys = ["repository", "class", "method", "signature"]
    return flat(new).join(flat(old).select(keys), keys, "left_anti")


def interface_changes(old: DataFrame, new: DataFrame, edges: DataFrame) -> DataFrame:
    """Interface methods whose return type changed, with every class implementing the interface."""
    only = lambda types: _methods_with_returns(types.where(F.col("kind") == "interface"))
    keys = ["repository", "class", "method"]
    before = only(old).select(*keys, F.col("return_type").alias("old_return"))
    after = only(new).select(*keys, F.col("return_type").alias("new_return"))
    changed = before.join(after, keys).where(F.col("old_return") != F.col("new_return"))
    users = edges.where(F.col("type") == "implements").select("repository", F.col("dst").alias("class"), F.col("src").alias("implementer"))
    return changed.join(users.distinct(), ["repository", "class"], "left")


def _methods_with_returns(types: DataFrame) -> DataFrame:
    rows = types.select("repository", F.col("name").alias("class"), "path", "pos", F.posexplode("methods").alias("no", "m"))
    best = rows.groupBy("repository", "class", "m.name").agg(F.max_by("m.return_type", F.struct("path", "pos", "no")).alias("return_type"))
    return best.select("repository", "class", F.col("name").alias("method"), "return_type")


def removed_exports(old: DataFrame, new: DataFrame) -> DataFrame:
    """Exports (repository, path, name) of the old version that the new one lacks."""
    keys = ["repository", "path", "name"]
    return old.select(keys).distinct().join(new.select(keys).distinct(), keys, "left_anti")
