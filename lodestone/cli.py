"""Command line: ``index``, ``search``, ``evaluate`` and ``reindex``."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from lodestone.config import CHUNKER_TYPES, SearchConfig
from lodestone.deploy import ship_package
from lodestone.operators.ann import INDEX_DEFAULTS, INDEX_TYPES
from lodestone.plans.build import index_repository
from lodestone.plans.evaluate import evaluate
from lodestone.plans.reindex import reindex
from lodestone.plans.search import search
from lodestone.report import format_index_summary, format_metrics, format_result
from lodestone.sources.index_store import load_index
from lodestone.sources.pairs import read_pairs


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="lodestone", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)

    def command(name):
        added = commands.add_parser(name)
        added.add_argument("--config", "-c")
        return added

    build = command("index")
    build.add_argument("repository_path")
    build.add_argument("--model", "-m", dest="embedding_model")
    build.add_argument("--device", "-d")
    build.add_argument("--index-type", choices=INDEX_TYPES)
    build.add_argument("--batch-size", "-b", type=int)
    build.add_argument("--separate-indexes", "-s", action="store_true", default=None)
    build.add_argument("--chunker-type", choices=CHUNKER_TYPES)

    find = command("search")
    find.add_argument("query")
    find.add_argument("--top-k", "-k", type=int)
    find.add_argument("--language", "-l")
    find.add_argument("--no-rerank", dest="enable_reranking", action="store_false", default=None)

    measure = command("evaluate")
    measure.add_argument("pairs", help="path of the pair table")
    measure.add_argument("--format", default="parquet")
    measure.add_argument("--languages", "-l")
    measure.add_argument("--max-queries", type=int)
    measure.add_argument("--max-dataset-records", type=int)
    measure.add_argument("--separate-indexes", "-s", action="store_true", default=None)
    measure.add_argument("--rewrite", "-r", dest="enable_query_rewriting", action="store_true", default=None)
    measure.add_argument("--rewrite-strategy", dest="query_rewrite_strategy")
    measure.add_argument("--rewrite-model", dest="query_rewriter_model")
    measure.add_argument("--reranker-hint", dest="reranker_language_hint", action="store_true", default=None)
    measure.add_argument("--primary-split", dest="evaluation_primary_split")
    measure.add_argument("--fill-split", dest="evaluation_fill_split")
    measure.add_argument("--fill-from-split", dest="evaluation_fill_from_split", action="store_true", default=None)
    measure.add_argument("--no-deduplicate", dest="evaluation_deduplicate", action="store_false", default=None)
    measure.add_argument("--train-as-queries", dest="evaluation_train_as_queries", action="store_true", default=None)
    measure.add_argument("--chunker-type", choices=CHUNKER_TYPES)

    again = command("reindex")
    again.add_argument("--source", required=True)
    again.add_argument("--output")
    again.add_argument("--type", required=True, choices=INDEX_TYPES, dest="kind")
    for name, value in INDEX_DEFAULTS.items():
        again.add_argument("--" + name.replace("_", "-"), type=int, default=value)
    again.add_argument("--dry-run", action="store_true")
    again.add_argument("--force", "-f", action="store_true")
    return parser


def configured(arguments: argparse.Namespace) -> SearchConfig:
    """File settings, then the options that were given."""
    base = SearchConfig.from_yaml(arguments.config) if arguments.config else SearchConfig()
    given = {k: v for k, v in vars(arguments).items() if v is not None and hasattr(base, k)}
    # Zero sizes mean "not given".
    given = {k: v for k, v in given.items() if not (k in ("top_k", "batch_size") and v == 0)}
    return SearchConfig(**{**vars(base), **given})


def run(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    arguments = _parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("lodestone").getOrCreate()
    ship_package(spark)
    try:
        print(_run(arguments, configured(arguments), spark))
    except (FileNotFoundError, FileExistsError, ValueError) as error:
        print(f"Error: {error}", file=sys.stderr)
        return 1
    return 0


def _run(arguments, config, spark) -> str:
    if arguments.command == "index":
        index = index_repository(spark, arguments.repository_path, config)
        languages = [r[0] for r in index.items.select("language").distinct().orderBy("language").collect()]
        return format_index_summary(
            config.index_dir, index.items.count(), config.embedding_dimension,
            languages if config.separate_indexes else None,
        )
    if arguments.command == "search":
        index = load_index(spark, config.index_dir, arguments.language)
        queries = spark.createDataFrame([(0, arguments.query)], "query_id long, query string")
        shown = ("file_path", "class_name", "function_name", "language", "start_line", "end_line", "source_code")
        found = search(queries, index, config, carry=shown).orderBy("rank").collect()
        if not found:
            return "No results found."
        return "\n\n".join(format_result(r["rank"], r.asDict()) for r in found)
    if arguments.command == "evaluate":
        pairs = read_pairs(spark, arguments.pairs, arguments.format)
        metrics = evaluate(
            pairs, config,
            languages=arguments.languages.split(",") if arguments.languages else None,
            max_queries=arguments.max_queries,
            max_dataset_records=arguments.max_dataset_records or config.max_dataset_records,
            use_cache=True,
        )
        return format_metrics([r.asDict() for r in metrics.collect()])
    params = {name: getattr(arguments, name) for name in INDEX_DEFAULTS}
    report = reindex(
        spark, arguments.source, arguments.kind, output=arguments.output,
        force=arguments.force, dry_run=arguments.dry_run, **params,
    )
    return "\n".join(f"{name}: {value}" for name, value in report.items())


if __name__ == "__main__":
    sys.exit(run())
