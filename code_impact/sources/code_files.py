"""Source: a folder of checked-out files as a table."""

from __future__ import annotations

import datetime
from collections.abc import Iterator
from fnmatch import fnmatch
from functools import reduce
from itertools import islice

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from code_impact.functions.paths import IGNORED_DIRS
from code_impact.session import cut_lineage

LISTED = "file string, folder boolean, size long, modified timestamp"


def _children(store: fs.FileSystem, folder: str, glob: str | None) -> Iterator[tuple[str, bool, int, datetime.datetime]]:
    """Files that are wanted and folders that are not ignored, directly below a folder."""
    for found in store.get_file_info(fs.FileSelector(folder)):
        if found.type == fs.FileType.Directory:
            if found.base_name not in IGNORED_DIRS:
                yield found.path, True, 0, found.mtime
        elif glob is None or fnmatch(found.base_name, glob):
            yield found.path, False, found.size, found.mtime


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.bool_(), pa.int64(), pa.timestamp("us", "UTC"))
    columns = list(zip(*rows, strict=True)) or [()] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["file", "folder", "size", "modified"])


def scan_code_files(spark: SparkSession, root: str, repository: str, glob: str | None = None, parts: int = 0) -> DataFrame:
    """All files below ``root``: (repository, path, content, size, last_modified), hidden and empty ones too.

    Bad UTF-8 becomes U+FFFD; a file that cannot be read has no content. Ignored folders are left
    out while listing and ``glob`` is matched against names, so nothing else is ever read. Folders are listed level by level:
    those of a level are a table, dealt out to ``parts`` tasks (as many as Spark shuffles to, if 0), and what they hold is the
    next one, so neither the driver nor one task lists a tree. Files are dealt out again before they are read one by one.
    ``root`` is a path or a URI that ``pyarrow.fs`` can open from every executor.
    """
    _, top = fs.FileSystem.from_uri(root)
    top = top.rstrip("/")
    spread = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def listing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        there, _ = fs.FileSystem.from_uri(root)
        for batch in batches:
            for folder in batch.column(0).to_pylist():
                found = _children(there, folder, glob)
                while some := list(islice(found, 10_000)):
                    yield _batch(some)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        there, _ = fs.FileSystem.from_uri(root)
        for batch in batches:
            for k in range(batch.num_rows):
                one = batch.slice(k, 1)
                try:
                    with there.open_input_stream(batch.column("file")[k].as_py(), compression=None) as file:
                        content = file.read()
                except OSError:
                    content = None
                yield pa.RecordBatch.from_arrays([one.column("file"), one.column("size"), one.column("modified"), pa.array([content], pa.binary())], ["file", "size", "modified", "content"])

    levels, folders = [], spark.createDataFrame([(top,)], "file string")
    while not levels or not folders.isEmpty():
        levels.append(cut_lineage(folders.repartition(spread).mapInArrow(listing, LISTED)))
        folders = levels[-1].where("folder").select("file")
    # The files of all levels, without their contents so far.
    listed = reduce(DataFrame.unionByName, [level.where("NOT folder") for level in levels]).repartition(spread)
    raw = listed.mapInArrow(read, "file string, size long, modified timestamp, content binary")
    return raw.select(
        F.lit(repository).alias("repository"), F.substr("file", F.lit(len(top) + 2)).alias("path"),
        F.make_valid_utf8(F.col("content").cast("string")).alias("content"), "size", F.col("modified").alias("last_modified"),
    )


def write_files(files: DataFrame, root: str) -> None:
    """Write (path, content) rows as files below ``root``. A task that runs again writes the same files again."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = fs.FileSystem.from_uri(root)
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                target = f"{top}/{path}"
                store.create_dir(target.rsplit("/", 1)[0], recursive=True)
                with store.open_output_stream(target, compression=None) as file:
                    file.write((content or "").encode())
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["written"])

    files.select("path", "content").mapInArrow(write, "written long").write.format("noop").mode("overwrite").save()
