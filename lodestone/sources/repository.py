"""Source trees as a table of text files.

Spark's own file sources skip names that start with ``_`` or ``.``, which would
lose files such as ``__init__.py``. Directories are therefore listed by tasks,
and only paths move between tasks before each file is read once.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import reduce
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.text import is_blank, universal_newlines
from lodestone.languages import detect_language
from lodestone.operators.lineage import checkpointed

# Vendor directories that are never searched.
SKIPPED_DIRECTORIES = (".git", "node_modules", "__pycache__", ".venv", "venv", "vendor")

LISTED_ROWS = 10_000
READ_BYTES = 16 << 20


def outside_skipped_directories(path: Column) -> Column:
    """True unless a directory of the relative path is hidden or a vendor directory."""
    parts = F.split(path, "/")
    directories = F.slice(parts, F.lit(1), F.size(parts) - 1)
    return ~F.exists(
        directories, lambda d: d.isin(*SKIPPED_DIRECTORIES) | d.startswith(F.lit("."))
    )


def supported_files(files: DataFrame, path: str = "file_path") -> DataFrame:
    """Keep files of a supported language outside skipped directories; add ``language``."""
    return files.filter(outside_skipped_directories(F.col(path))).withColumn(
        "language", detect_language(F.col(path))
    ).filter(F.col("language").isNotNull())


def decode_source(content: Column) -> Column:
    """Bytes to text: invalid UTF-8 becomes U+FFFD, line ends become LF."""
    return universal_newlines(F.make_valid_utf8(content.cast("string")))


def _skipped(name: str) -> bool:
    return name in SKIPPED_DIRECTORIES or name.startswith(".")


def _open(root: str):
    """File system and path of a root: a URI that pyarrow knows, or a mounted directory."""
    from pyarrow import fs

    if "://" in root:
        return fs.FileSystem.from_uri(root)
    return fs.LocalFileSystem(), os.path.abspath(root)


def _entries(root: str, folder: str) -> Iterator[tuple[str, bool]]:
    """(path below the root, is it a directory) of what a folder holds; directory links are not followed."""
    from pyarrow import fs

    files, base = _open(root)
    place = f"{base.rstrip('/')}/{folder}" if folder else base
    for entry in files.get_file_info(fs.FileSelector(place)):
        path = f"{folder}/{entry.base_name}" if folder else entry.base_name
        if entry.type == fs.FileType.File:
            yield path, False
        elif entry.type == fs.FileType.Directory and not _skipped(entry.base_name):
            if not (isinstance(files, fs.LocalFileSystem) and os.path.islink(entry.path)):
                yield path, True


def list_files(spark: SparkSession, root: str, partitions: int) -> DataFrame:
    """``file_path`` of every file below the root, listed level by level, one task for each share of a level's folders."""

    def listed(batches):
        for batch in batches:
            for folder in batch.column(0).to_pylist():
                found = _entries(root, folder)
                while part := list(islice(found, LISTED_ROWS)):
                    paths, kinds = zip(*part)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(paths, pa.string()), pa.array(kinds, pa.bool_())], names=["path", "is_directory"]
                    )

    folders = spark.createDataFrame([("",)], "path string")
    levels = []
    while not levels or not folders.isEmpty():
        level = checkpointed(
            folders.repartition(partitions, "path").mapInArrow(listed, "path string, is_directory boolean")
        )
        levels.append(level.filter("NOT is_directory").select(F.col("path").alias("file_path")))
        folders = level.filter("is_directory").select("path")
    return reduce(DataFrame.unionAll, levels)


def scan_repository(spark: SparkSession, root: str, partitions: int | None = None) -> DataFrame:
    """``repository, file_path, language, source_code`` of all supported source files.

    *root* is a directory that every executor mounts, or the URI of one on a
    store that pyarrow reaches (``hdfs://``, ``s3://``, ``gs://``, ``file://``). Unreadable and
    blank files are dropped.
    """
    from pyarrow import fs

    files_of, base = _open(root)
    if files_of.get_file_info(base).type != fs.FileType.Directory:
        raise FileNotFoundError(f"{root} is not a directory")
    root = root if "://" in root else base
    partitions = partitions or spark.sparkContext.defaultParallelism

    def read(batches):
        def batch_of(rows):
            columns = [pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.string(), pa.binary()))]
            return pa.RecordBatch.from_arrays(columns, names=["file_path", "language", "content"])

        store, top = _open(root)
        held, size = [], 0
        for batch in batches:
            for path, language in zip(*(c.to_pylist() for c in batch.columns)):
                try:
                    with store.open_input_stream(f"{top.rstrip('/')}/{path}", compression=None) as handle:
                        held.append((path, language, handle.read()))
                except OSError:
                    continue
                size += len(held[-1][2])
                if size >= READ_BYTES:
                    yield batch_of(held)
                    held, size = [], 0
        if held:
            yield batch_of(held)

    paths = list_files(spark, root, partitions)
    files = (
        supported_files(paths)
        .repartition(partitions, "file_path")
        .mapInArrow(read, "file_path string, language string, content binary")
    )
    text = files.select(
        F.lit(os.path.basename(base.rstrip('/'))).alias("repository"),
        "file_path",
        "language",
        decode_source(F.col("content")).alias("source_code"),
    )
    return text.filter(~is_blank(F.col("source_code")))
