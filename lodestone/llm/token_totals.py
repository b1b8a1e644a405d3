"""Token counts: rollups by source, language and tokenizer version, kept by signed deltas.

A batch holds upserts and deletes of (document, version). Its effect is the sum of
what each change adds less what it replaces, found in the ledger of counts. Batches
are written to a place of their own and become visible by a commit entry; a batch
that is delivered again finds the entry and changes nothing. Totals are sums of
committed deltas.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.batches import struct_column
from lodestone.llm.packing import word_tokens

KEYS = ("doc_id", "version")
GROUP = ("source", "lang", "version")
LEDGER = "doc_id bigint, version string, source string, lang string, tokens bigint, sequence bigint"
DELTAS = "source string, lang string, version string, documents bigint, tokens bigint"
COMMITS = "batch_id string, sequence bigint, place string"


def word_count(text: Column) -> Column:
    """Runs of anything but ASCII white space."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("bigint")


def word_and_mark_count(text: Column) -> Column:
    """Runs of letters and digits (all of non-ASCII among them), and single ASCII marks."""
    pattern = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+|[\x21-\x2F\x3A-\x40\x5B-\x60\x7B-\x7E]"
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(pattern)).cast("bigint")


def bpe_count(text: Column, tokenizer_path: str | None = None) -> Column:
    """Ids that the public word tokenizer gives a text; null has none.

    ``tokenizer_path`` must exist on every executor; without it the installed
    tokenizer is used.
    """

    def count(texts: list[bytes]) -> list:
        tokens = word_tokens(tokenizer_path)
        # Each text is closed by one id that doesn't count.
        return [tokens.encoded(pa.array([t.decode() for t in texts], pa.string()), 0)[1] - 1]

    return struct_column("tokens bigint", count)(text)["tokens"]


def counted(docs: DataFrame, versions: dict[str, Column]) -> DataFrame:
    """Upsert events: one row for each document and tokenizer version. All versions are counted in one scan."""
    pairs = F.array(*(F.struct(F.lit(name).alias("version"), count.alias("tokens")) for name, count in versions.items()))
    return docs.select("doc_id", "source", "lang", F.explode(pairs).alias("_made")).select(
        "doc_id", F.col("_made.version").alias("version"), "source", "lang", F.col("_made.tokens").alias("tokens"),
        F.lit(False).alias("deleted"),
    )


@dataclass(frozen=True)
class TokenTotals:
    """The rollup under one folder of a file system that all executors share."""

    spark: SparkSession
    folder: str

    def _commits(self) -> DataFrame:
        try:
            return self.spark.read.schema(COMMITS).parquet(f"{self.folder}/commits")
        except Exception as error:  # nothing is committed yet
            if "PATH_NOT_FOUND" not in str(error):
                raise
            return self.spark.createDataFrame([], COMMITS)

    def _committed(self) -> list:
        """Commit entries by sequence: one short row for each batch."""
        return self._commits().orderBy("sequence").collect()

    def _tables(self, name: str, schema: str, committed: list) -> DataFrame:
        if not committed:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*(f"{entry['place']}/{name}" for entry in committed))

    def ledger(self, committed: list | None = None) -> DataFrame:
        """Current (doc_id, version, source, lang, tokens) of everything that is not deleted."""
        rows = self._tables("ledger", LEDGER, self._committed() if committed is None else committed)
        latest = rows.groupBy(*KEYS).agg(F.max_by(F.struct("source", "lang", "tokens"), "sequence").alias("_now"))
        return latest.select(*KEYS, "_now.*").where("tokens IS NOT NULL")

    def apply(self, batch_id: str, events: DataFrame) -> bool:
        """Commit a batch; False, and no change, if that batch is committed already.

        Events are (doc_id, version, source, lang, tokens, deleted). Of several
        events for one key the last in order of (deleted, tokens, source, lang) counts, so repeated
        rows count once. Deletes of unknown keys change nothing. A null version, source or
        lang is a value of its own and a null count is 0. Upserts without a doc_id each add
        their count for good, since nothing can name them later; deletes without one change
        nothing. One writer commits at a time.
        """
        committed = self._committed()
        if any(entry["batch_id"] == batch_id for entry in committed):
            return False
        sequence = max((entry["sequence"] for entry in committed), default=0) + 1
        place = f"{self.folder}/batches/{sequence}-{uuid.uuid4().hex}"
        gone = F.coalesce("deleted", F.lit(False))
        known = events.select(
            F.col("doc_id").cast("bigint").alias("doc_id"), "version", "source", "lang",
            F.when(~gone, F.coalesce(F.col("tokens").cast("bigint"), F.lit(0).cast("bigint"))).alias("tokens"),
        )
        last = known.where("doc_id IS NOT NULL").groupBy(*KEYS).agg(
            F.max_by(F.struct("source", "lang", "tokens"), F.struct(F.col("tokens").isNull(), "tokens", "source", "lang")).alias("_now")
        )
        last.select(*KEYS, "_now.*", F.lit(sequence).cast("bigint").alias("sequence")).write.parquet(f"{place}/ledger")
        changes = self.spark.read.schema(LEDGER).parquet(f"{place}/ledger").drop("sequence")
        nameless = known.where("doc_id IS NULL AND tokens IS NOT NULL")
        added = changes.where("tokens IS NOT NULL").unionByName(nameless)
        signed = added.select(*GROUP, F.lit(1).alias("sign"), "tokens")
        if committed:
            touched = changes.select(*(F.col(key).alias(f"_{key}") for key in KEYS))
            before = self.ledger(committed)
            same = (before["doc_id"] == touched["_doc_id"]) & before["version"].eqNullSafe(touched["_version"])
            replaced = before.join(touched, same, "left_semi")
            signed = signed.unionByName(replaced.select(*GROUP, F.lit(-1).alias("sign"), "tokens"))
        deltas = signed.groupBy(*GROUP).agg(
            F.sum("sign").cast("bigint").alias("documents"), F.sum(F.col("sign") * F.col("tokens")).cast("bigint").alias("tokens")
        )
        deltas.write.parquet(f"{place}/deltas")
        self.spark.createDataFrame([(batch_id, sequence, place)], COMMITS).coalesce(1).write.mode("append").parquet(f"{self.folder}/commits")
        return True

    def totals(self) -> DataFrame:
        """(source, lang, version, documents, tokens); groups that have come to nothing are left out."""
        return (
            self._tables("deltas", DELTAS, self._committed())
            .groupBy(*GROUP)
            .agg(F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens"))
            .where("documents <> 0 OR tokens <> 0")
        )
