"""Benchmark decontamination: test windows of words found in documents.

Windows of the test items form a hash set that is broadcast, in as many parts as
its size needs; documents stream past it with one hash for each window of words,
all inside one generated stage, once for each part. A hash that is found is verified word by word. What leaves the
scan is one row for each document and one for each verified window.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.storage import BROADCAST_BYTES, broadcast_if_small
from lodestone.llm.text import as_row, ascii_words
from lodestone.operators.lineage import checkpointed

WINDOW = 10
_LENGTH_AT = 32


def test_windows(benchmark: DataFrame, item_id: str, text: str, window: int) -> DataFrame:
    """(item, length, window): the windows of every item, words joined by spaces.

    An item of fewer words than ``window`` is one window, an item of none has none.
    """
    words = benchmark.select(F.col(item_id).cast("string").alias("item"), ascii_words(F.col(text)).alias("words"))
    length = F.least(F.lit(window), F.size("words"))
    return (
        words.where("size(words) > 0")
        .select("item", "words", length.alias("length"))
        .select("item", "words", "length", F.explode(F.expr("sequence(1, size(words) - length + 1)")).alias("at"))
        .select("item", "length", F.array_join(F.slice("words", F.col("at"), F.col("length")), " ").alias("window"))
        .distinct()
    )


def _positions(lengths: list[int]) -> Column:
    """Zero for the document itself, then every window as length * 2**32 + first word (from 1)."""
    runs = [F.array(F.lit(0).cast("bigint"))]
    for length in lengths:
        base = length << _LENGTH_AT
        run = F.sequence(F.lit(base + 1), F.lit(base + 1 - length) + F.size("words"))
        runs.append(F.when(F.size("words") >= length, run).otherwise(F.array().cast("array<bigint>")))
    return F.concat(*runs)


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """One row for each row of ``docs``: doc_id, text_hash, n_words, n_hit, items, spans, contaminated.

    ``spans`` are sorted, merged [first word, word behind) pairs, words from 0;
    ``items`` the ids of the items with a window in the text, as sorted strings.
    Null and empty texts have no words and are clean. Items without an id count for
    hits, not as items. Repeated rows stay repeated and are judged alike; a null id is kept. An empty
    benchmark leaves everything clean, an empty ``docs`` gives no rows. Other
    columns are ignored.
    """
    members = checkpointed(test_windows(benchmark, item_id, item_text, window))
    grouped = members.select("length", "window").distinct()
    windows = checkpointed(
        grouped.select(
            "length", "window", F.xxhash64(F.split("window", " ")).alias("hash"),
            F.monotonically_increasing_id().alias("window_id"),
        )
    )
    size = windows.agg(
        F.sum(F.octet_length("window") + 64).alias("bytes"), F.collect_set("length").alias("lengths")
    ).first()
    held = members.join(windows.select("window", "window_id"), "window").select("window_id", "item")
    passes = max(1, -(-(size["bytes"] or 0) // broadcast_bytes))

    words = docs.select(
        F.col(doc_id).alias("doc_id"), F.xxhash64(F.col(text)).alias("text_hash"), ascii_words(F.col(text)).alias("words")
    )
    length = F.shiftright("code", _LENGTH_AT).cast("int")
    first = F.col("code").bitwiseAND(F.lit((1 << _LENGTH_AT) - 1)).cast("int")
    places = (
        words.select("doc_id", "text_hash", "words", F.explode(_positions(sorted(size["lengths"]))).alias("code"))
        .select("doc_id", "text_hash", "words", length.alias("n"), first.alias("at"))
    )
    # The row of the document itself has no window; its slice only has to be a valid one.
    run = F.slice("words", F.greatest("at", F.lit(1)), F.col("n"))
    places = places.withColumn("key", F.when(F.col("at") > 0, F.xxhash64(run)))

    def scan(number: int) -> DataFrame:
        part = windows if passes == 1 else windows.where(F.pmod("hash", F.lit(passes)) == number)
        matched = (F.col("key") == F.col("hash")) & (F.array_join(run, " ") == F.col("window"))
        return places.join(F.broadcast(part), matched, "left").where(
            "at = 0 OR window_id IS NOT NULL" if number == 0 else "window_id IS NOT NULL"
        )

    found = reduce(DataFrame.unionAll, map(scan, range(passes)))
    report = checkpointed(
        found.select(
            "doc_id", "text_hash", "window_id",
            F.when(F.col("at") == 0, F.size("words")).alias("n_words"),
            F.when(F.col("at") > 0, F.struct((F.col("at") - 1).alias("a"), (F.col("at") - 1 + F.col("n")).alias("b"))).alias("span"),
        )
        .groupBy("doc_id", "text_hash")
        .agg(
            F.max("n_words").cast("bigint").alias("n_words"),
            F.count("n_words").alias("copies"),
            F.collect_set("span").alias("found"),
            F.collect_set("window_id").alias("window_ids"),
        )
    )
    touched = report.where("size(window_ids) > 0").select("doc_id", "text_hash", F.explode("window_ids").alias("window_id"))
    items = (
        touched.join(broadcast_if_small(held), "window_id")
        .groupBy("doc_id", "text_hash")
        .agg(F.array_sort(F.collect_set("item")).alias("items"))
        .select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), "items")
    )
    merged = F.expr(
        """aggregate(array_sort(found), cast(array() as array<struct<a: int, b: int>>), (acc, x) ->
             CASE WHEN size(acc) > 0 AND acc[size(acc) - 1].b >= x.a
                  THEN concat(slice(acc, 1, size(acc) - 1),
                              array(named_struct('a', acc[size(acc) - 1].a, 'b', greatest(acc[size(acc) - 1].b, x.b))))
                  ELSE concat(acc, array(x)) END)"""
    )
    return (
        report.join(items, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash")), "left")
        .select(
            F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies"))).alias("copy"),
            "doc_id", "text_hash", "n_words",
            F.expr("aggregate(array_sort(found), named_struct('end', 0, 'n', 0L), "
                   "(acc, x) -> named_struct('end', greatest(acc.end, x.b), "
                   "'n', acc.n + greatest(0, x.b - greatest(x.a, acc.end))), acc -> acc.n)").alias("n_hit"),
            F.coalesce("items", F.array().cast("array<string>")).alias("items"),
            F.when(F.size("found") > 0, merged).otherwise(F.array().cast("array<struct<a: int, b: int>>")).alias("spans"),
        )
        .drop("copy")
        .withColumn("contaminated", F.col("n_hit") > 0)
    )


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` without a hit, with their own columns.

    Null and empty texts have no hit. Repeated rows stay or go together, rows without id are judged by their
    text. Texts may have any length; other columns any names. An empty table gives no rows.
    """
    dirty = broadcast_if_small(
        contamination(docs, benchmark, doc_id, text, **options)
        .where("contaminated")
        .select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"))
        .distinct()
    )
    same = docs[doc_id].eqNullSafe(dirty["_id"]) & (F.xxhash64(docs[text]) == dirty["_hash"])
    return docs.join(dirty, same, "left_anti")


def remove_spans(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``docs`` with the words of all hits, and what stands between them, cut out of the text.

    Null and empty texts, and texts without a hit, stay as they are; repeated rows are cut alike, rows without
    id too. Other columns may have any names. An empty table gives no rows.
    """
    dirty = (
        contamination(docs, benchmark, doc_id, text, **options)
        .where("contaminated")
        .select(F.col("doc_id").alias("dirty_id"), F.col("text_hash").alias("dirty_hash"), "spans")
        .distinct()
    )
    rows = docs.select(
        as_row(docs.columns).alias("row"), F.col(doc_id).alias("own_id"), F.xxhash64(text).alias("own_hash"), F.col(text).alias("own_text")
    )
    same = F.col("own_id").eqNullSafe(F.col("dirty_id")) & (F.col("own_hash") == F.col("dirty_hash"))
    word = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
    hit = F.col("spans").isNotNull()
    cut = rows.join(dirty, same, "left").select(
        "row", "own_text", "spans",
        F.when(hit, F.regexp_extract_all(F.col("own_text"), F.lit(word), F.lit(0))).alias("raw"),
        F.when(hit, F.split(F.col("own_text"), word)).alias("gaps"),
    )
    # Gap i stands before word i. A span from a to b takes words a..b-1 and the gaps between them.
    kept = F.expr(
        """array_join(transform(gaps, (gap, i) -> concat(
             CASE WHEN exists(spans, s -> i > s.a AND i < s.b) THEN '' ELSE gap END,
             CASE WHEN i >= size(raw) OR exists(spans, s -> i >= s.a AND i < s.b) THEN '' ELSE raw[i] END)), '')"""
    )
    new = F.when(hit, kept).otherwise(F.col("own_text")).alias(text)
    return cut.select(*(new if c == text else F.col("row")[c].alias(c) for c in docs.columns))
