"""Rebuild a stored index as another kind and report how well it agrees."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from lodestone.functions.vectors import norm_stats
from lodestone.operators.ann import INDEX_TYPES, VectorIndex, build_index
from lodestone.operators.metrics import result_overlap
from lodestone.report import format_size
from lodestone.sources.index_store import TECHNICAL, _exists, index_bytes, load_index, read_manifest, save_index

CHECK_QUERIES = 100
CHECK_TOP = 10
LOW_RECALL = 0.5


def default_output(source: str, index_type: str, is_evaluation: bool) -> str:
    """``x`` becomes ``x_type``; evaluation caches rename their parent folder."""
    parent, name = os.path.split(source.rstrip("/"))
    if is_evaluation or name == "combined":
        above, folder = os.path.split(parent)
        return os.path.join(above, f"{folder}_{index_type}", name)
    return os.path.join(parent, f"{name}_{index_type}")


def check_recall(truth: VectorIndex, rebuilt: VectorIndex, queries: int = CHECK_QUERIES) -> float:
    """Share of the exact top ten the rebuilt index finds, for sampled stored vectors."""
    sample = (
        truth.items.orderBy(F.xxhash64(truth.item_id, F.lit(42))).limit(queries)
        .select(F.col(truth.item_id).alias("query_id"), F.col(truth.item_vector).alias("query_embedding"))
    )
    expected = truth.search(sample, CHECK_TOP)
    found = rebuilt.search(sample, CHECK_TOP)
    return result_overlap(expected, found, item_id=truth.item_id, k=CHECK_TOP).first()["recall"]


def reindex(
    spark: SparkSession,
    source: str,
    index_type: str,
    *,
    output: str | None = None,
    force: bool = False,
    dry_run: bool = False,
    **params,
) -> dict:
    """Build *index_type* from a stored flat index. Returns the report."""
    if index_type not in INDEX_TYPES:
        raise ValueError(f"{index_type!r} is not one of the index kinds {INDEX_TYPES}")
    stored = load_index(spark, source)
    if stored.item_vector not in stored.items.columns:
        raise ValueError("the source index keeps codes only; re-index from a flat index")
    manifest = read_manifest(spark, source)
    is_evaluation = manifest["key"] is not None
    output = output or default_output(source, index_type, is_evaluation)
    if _exists(spark, output) and not force:
        raise FileExistsError(f"{output} exists; use force to overwrite")
    # What another kind left beside the vectors is no part of the new index.
    exact = VectorIndex(
        "flat", stored.items.drop(*TECHNICAL), stored.item_id, stored.item_vector, details=stored.details
    )
    stats = norm_stats(exact.items, exact.item_vector).first().asDict()
    report = {"source": source, "output": output, "index_type": index_type, **stats}
    if dry_run:
        return report
    rebuilt = build_index(
        exact.items, index_type, item_id=exact.item_id, item_vector=exact.item_vector, **params
    )
    rebuilt.details = exact.details
    queries = spark.read.parquet(f"{source}/{manifest['queries']}") if manifest["queries"] else None
    save_index(rebuilt, output, queries=queries, key=manifest["key"])
    saved = load_index(spark, output)
    recall = check_recall(exact, saved)
    before, after = index_bytes(spark, source), index_bytes(spark, output)
    return {
        **report,
        "recall_at_10": recall,
        "low_recall": index_type != "flat" and recall < LOW_RECALL,
        "source_size": format_size(before),
        "output_size": format_size(after),
        "size_ratio": after / before if before else 0.0,
    }
