"""The dependency index: merged files, classes and edges of many repositories."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from code_impact.functions.arrays import each, with_once
from code_impact.operators import java
from code_impact.operators.files import language_stats, with_language
from code_impact.operators.strategies import STRATEGIES, LanguageStrategy
from code_impact.session import cut_lineage


def extract_types(files: DataFrame, strategies: dict[str, LanguageStrategy] | None = None) -> DataFrame:
    """Classes of every file whose language has a strategy. Files without readable content are skipped.

    The files are read once for each strategy, whatever the languages that share it.
    """
    strategies = STRATEGIES if strategies is None else strategies
    known = with_language(files).where(F.col("content").isNotNull())
    parts = []
    for strategy in dict.fromkeys(strategies.values()):
        part = strategy.extract(known.where(F.col("language").isin([name for name, s in strategies.items() if s is strategy])))
        parts.append(strategy.link(cut_lineage(part), files) if hasattr(strategy, "link") else part)
    return reduce(DataFrame.unionByName, parts)


def extract_errors(files: DataFrame) -> DataFrame:
    return files.where(F.col("content").isNull()).select("repository", "path", F.lit("unreadable content").alias("error"))


def indexed_files(files: DataFrame, strategies: dict[str, LanguageStrategy] | None = None) -> DataFrame:
    """Files of a language with a strategy and with readable content, with ``language`` and ``content_hash``."""
    languages = list(STRATEGIES if strategies is None else strategies)
    known = with_language(files).where(F.col("language").isin(languages) & F.col("content").isNotNull())
    return known.withColumn("content_hash", F.sha2(F.col("content").cast("binary"), 256))


def merge_files(files: DataFrame, types: DataFrame, strategies: dict[str, LanguageStrategy] | None = None) -> DataFrame:
    """One row per indexed file with the names of its classes in order."""
    names = types.groupBy("repository", "path").agg(F.array_sort(F.collect_list(F.struct("pos", "name"))).alias("_names"))
    size = F.col("size") if "size" in files.columns else F.octet_length("content")
    modified = F.col("last_modified") if "last_modified" in files.columns else F.lit(None).cast("timestamp")
    meta = indexed_files(files, strategies).select("repository", "path", "language", size.cast("bigint").alias("size"), modified.alias("last_modified"), "content_hash")
    listed = F.coalesce(F.transform("_names", lambda n: n["name"]), F.array().cast("array<string>"))
    return meta.join(names, ["repository", "path"], "left").withColumn("classes", listed).drop("_names")


def merge_classes(types: DataFrame, key: tuple[str, ...] = ("name",)) -> DataFrame:
    """One row per class key; the last file in path order wins. Partial aggregation keeps copies off the shuffle."""
    kept = ["path", "package", "kind", "dependencies", "methods"]
    rest = [c for c in kept if c not in key]
    best = types.groupBy("repository", *key).agg(F.max_by(F.struct("name", *rest), F.struct("path", "pos")).alias("w"))
    columns = ["name", *rest]
    return best.select("repository", *key, *[F.col(f"w.{c}").alias(c) for c in columns if c not in key])


def merge_edges(edges: DataFrame) -> DataFrame:
    """One row per (src, dst), whatever the type; the last one in (file, class, edge) order wins."""
    best = edges.groupBy("repository", "src", "dst").agg(
        F.max_by(F.struct("type", "file", "line", "usage"), F.struct("file", "pos", "edge_no")).alias("w")
    )
    return best.select("repository", "src", "dst", "w.*")


def build_index(files: DataFrame, types: DataFrame | None = None, strategies: dict[str, LanguageStrategy] | None = None) -> dict[str, DataFrame]:
    """Index tables of all repositories in ``files``. Pass ``types`` when the extraction is already stored, and
    ``strategies`` (``strategies.EVERY``) for more languages than Java."""
    types = extract_types(files, strategies) if types is None else types
    merged = merge_classes(types)
    rows = merged.select("repository", F.col("name").alias("class"), F.posexplode("methods").alias("method_no", "m"))
    return {
        "files": merge_files(files, types, strategies),
        "classes": merged.drop("methods"),
        "methods": rows.select("repository", "class", "method_no", "m.*"),
        "edges": merge_edges(java.edges(types)),
        "languages": language_stats(files),
    }


def index_stats(index: dict[str, DataFrame]) -> DataFrame:
    """Counts per repository. Every part is aggregated before the join."""
    count = lambda name, alias: index[name].groupBy("repository").agg(F.count(F.lit(1)).alias(alias))
    languages = index["languages"].groupBy("repository").agg(F.array_join(F.array_sort(F.collect_set("language")), ",").alias("languages"))
    parts = [count("files", "total_files"), count("classes", "total_classes"), count("edges", "total_dependencies"), languages]
    joined = reduce(lambda a, b: a.join(b, "repository", "full"), parts)
    return joined.na.fill(0, ["total_files", "total_classes", "total_dependencies"])


def file_changes_since(indexed: DataFrame, new: DataFrame) -> DataFrame:
    """(repository, path, change) with change in added, changed, deleted, against the hashes stored with an index.

    Only the new contents are hashed, and only hashes are joined. A file indexed without a hash counts as changed.
    """
    was = indexed.select("repository", "path", F.col("content_hash").alias("_old"), F.lit(True).alias("_was"))
    now = indexed_files(new).select("repository", "path", F.col("content_hash").alias("_new"))
    change = (
        F.when(F.col("_was").isNull(), "added").when(F.col("_new").isNull(), "deleted").when(~F.col("_old").eqNullSafe(F.col("_new")), "changed")
    )
    return was.join(now, ["repository", "path"], "full").select("repository", "path", change.alias("change")).where("change IS NOT NULL")


def incremental_types(old_types: DataFrame, indexed: DataFrame, new: DataFrame) -> DataFrame:
    """Classes after re-extracting only the files that were added or changed since the index (its ``files`` table).

    The changed keys are stored first: the optimizer then knows their size, and broadcasts few of them over the scan of
    contents instead of shuffling it.
    """
    changed = cut_lineage(file_changes_since(indexed, new))
    keys = ["repository", "path"]
    fresh = new.join(changed.where(F.col("change") != "deleted").select(keys), keys, "left_semi")
    return old_types.join(changed.select(keys), keys, "left_anti").unionByName(extract_types(fresh))


_DOCUMENT = (
    "repository string, metadata map<string,string>, "
    "index struct<classes:map<string,string>,dependencies:map<string,string>,files:map<string,string>>, _bad string"
)


def validate_documents(documents: DataFrame) -> DataFrame:
    """Failed checks of raw index documents (``doc_id``, ``expected``, ``document``), one row each."""
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}
    parsed = with_once(documents, "d", F.from_json("document", _DOCUMENT, options))
    d, ok = F.col("d"), F.col("d").isNotNull() & F.col("d")["_bad"].isNull()
    has_index = d["index"].isNotNull()
    checks = [
        ("json", ~ok),
        ("repository", ok & (F.coalesce(d["repository"], F.lit("")) == "")),
        ("index", ok & ~has_index),
        ("metadata", ok & d["metadata"].isNull()),
        ("index.classes", ok & has_index & d["index"]["classes"].isNull()),
        ("index.dependencies", ok & has_index & d["index"]["dependencies"].isNull()),
        ("index.files", ok & has_index & d["index"]["files"].isNull()),
        ("repository_mismatch", ok & (F.coalesce(d["repository"], F.lit("")) != "") & (d["repository"] != F.col("expected"))),
    ]
    failed = F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in checks]))
    return parsed.select("doc_id", F.explode(each(failed)).alias("failed_check"))
