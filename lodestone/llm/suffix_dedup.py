"""Exact removal of long repeated byte strings across a corpus, by sharded suffix arrays.

A byte goes if it is covered by a string of ``length`` bytes that also starts anywhere else in the
corpus, in the same text or another one; strings are judged on the input.

1. Every start of such a string belongs to an anchor, the place of the least hash of 32 bytes inside
   the string. Equal strings have equal anchors at equal offsets, so the starts of one anchor form a
   *segment* and segments are dealt into shards by the anchor's bytes. Anchors that occur once go.
2. Equal segments fold into one with a count before anything is grouped.
3. The different segments of an anchor form a shard. Its suffix array is made by induced sorting
   (``induced_sorting``), permuted common prefixes of ``length`` or more mark repeated starts.
4. An anchor with more different segments than ``SHARD_SEGMENTS`` (the edges of a passage in very many
   texts) is no shard: its folded segments are cut by the anchor's offset into runs of 64 starts and dealt
   by all bytes that the strings of a run share. Unique runs go, equal ones fold, and what is still that
   frequent is cut again, down to single strings. So no shard is larger than that bound, and nothing is left out.

Nulls count as empty. Texts of any length are read in pieces, shorter ones than ``length`` lose nothing.
Repeated rows are copies of each other. An empty table gives an empty result. Input columns may have any
names: inside, they travel in one struct; an added column replaces an input column of its name.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.induced_sorting import common_prefixes, suffix_arrays
from lodestone.operators.lineage import shared_folder

LENGTH = 400
#: Bytes of an anchor.
GRAM = 32
#: Most different segments of a shard.
SHARD_SEGMENTS = 32
#: Starts in a run of a very frequent anchor, then in a run of a very frequent run, and so on.
FINER = (64, 16, 4, 1)
#: Bytes read at a time, and symbols sorted at a time.
PIECE_BYTES, SORT_SYMBOLS = 2 << 20, 1 << 20
POSITION = np.uint64(0xFFFFFF)

SEGMENT = "id long, start int, width int, anchor int, key long, fold long"
PART = f"up_key long, up_fold long, offset int, n long, {SEGMENT}"
RUNS = "array<struct<first: int, stop: int>>"
#: Sorted runs of a segment, those that touch as one.
JOINED_RUNS = f"""aggregate(runs, cast(array() AS {RUNS}), (held, r) -> CASE
  WHEN size(held) > 0 AND r.first <= element_at(held, -1).stop
  THEN concat(slice(held, 1, size(held) - 1), array(named_struct(
    'first', element_at(held, -1).first, 'stop', greatest(element_at(held, -1).stop, r.stop))))
  ELSE concat(held, array(r)) END)"""


def _mixed(x: np.ndarray) -> np.ndarray:
    """Scatter the bits of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def gram_hashes(line: np.ndarray) -> np.ndarray:
    """Hashes of all strings of GRAM bytes, by doubling."""
    h = _mixed(line.astype(np.uint64) + np.uint64(1))
    width = 1
    while width < GRAM:
        h = _mixed(h[:-width] * np.uint64(0xD1342543DE82EF95) + h[width:])
        width *= 2
    return h


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbours, by running minima of blocks from both sides."""
    padded = np.full(-(-len(values) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(values)] = values
    blocks = padded.reshape(-1, width)
    forward = np.minimum.accumulate(blocks, axis=1).reshape(-1)
    backward = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    n = len(values) - width + 1
    return np.minimum(backward[:n], forward[width - 1 : width - 1 + n])


def segments(line: bytes, starts: np.ndarray, length: int) -> dict[str, np.ndarray]:
    """Segments of a run of bytes: first start, starts, offset of the anchor, keys.

    starts: True where a string of ``length`` bytes may start, false where it would cross into another text.
    """
    if len(line) < length:
        return {name: np.array([], np.int64) for name in ("first", "width", "anchor", "key", "fold")}
    hashes = gram_hashes(np.frombuffer(line, np.uint8))
    ranked = (hashes & ~POSITION) | np.arange(len(hashes), dtype=np.uint64)
    anchors = (_least(ranked, length - GRAM + 1) & POSITION).astype(np.int64)
    at = np.flatnonzero(starts[: len(anchors)])
    owner = anchors[at]
    first = np.flatnonzero(np.r_[True, (owner[1:] != owner[:-1]) | (at[1:] != at[:-1] + 1)]) if len(at) else at
    width = np.diff(np.r_[first, len(at)])
    begin, owner = at[first], owner[first]
    view = memoryview(line)
    fold = [xxhash.xxh3_64_intdigest(view[b : b + w + length - 1]) for b, w in zip(begin.tolist(), width.tolist())]
    return {
        "first": begin, "width": width, "anchor": owner - begin,
        "key": hashes[owner].view(np.int64), "fold": np.array(fold, np.uint64).view(np.int64),
    }


def _pieces(batch: pa.RecordBatch, length: int, limit: int) -> Iterator[tuple[list[tuple[int, int, int]], bytes]]:
    """Runs of text of about ``limit`` bytes: the parts as (id, first byte of the part, bytes), and their bytes."""
    parts, held, size = [], [], 0
    for i, value in zip(batch.column(0).to_pylist(), batch.column(1)):
        view = memoryview(value.as_buffer())
        for at in range(0, max(len(view), 1), limit):
            # A part lends its successor's first bytes, so that each start is seen in exactly one.
            part = view[at : at + limit + length - 1]
            if size and size + len(part) > limit:
                yield parts, b"".join(held)
                parts, held, size = [], [], 0
            parts.append((i, at, len(part)))
            held.append(part)
            size += len(part)
    if parts:
        yield parts, b"".join(held)


def _find(length: int, limit: int):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for parts, line in _pieces(batch, length, limit):
                ids, offsets, sizes = (np.array(x, np.int64) for x in zip(*parts))
                begins = np.cumsum(sizes) - sizes
                starts = np.zeros(len(line), bool)
                for begin, size in zip(begins.tolist(), sizes.tolist()):
                    starts[begin : max(begin, begin + min(size - length + 1, limit))] = True
                found = segments(line, starts, length)
                of = np.searchsorted(begins, found["first"], side="right") - 1
                yield pa.record_batch({
                    "id": ids[of], "start": (found["first"] - begins[of] + offsets[of]).astype(np.int32),
                    "width": found["width"].astype(np.int32), "anchor": found["anchor"].astype(np.int32),
                    "key": found["key"], "fold": found["fold"],
                })

    return find


def _cut_finer(length: int, step: int):
    """Segments cut where the anchor's offset passes a multiple of ``step``, keyed by all bytes that their strings share."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("up_key", "up_fold", "offset", "n", "id", "start", "width", "anchor", "key", "fold")
        kinds = [pa.int32() if name in ("offset", "start", "width", "anchor") else pa.int64() for name in names]
        for batch in batches:
            made = []
            for up_key, up_fold, n, i, start, width, anchor, piece in zip(*(c.to_pylist() for c in batch.columns)):
                at = 0
                while at < width:
                    low = (anchor - at) // step * step  # the least offset of this run
                    stop = min(width, anchor - low + 1)
                    core = piece[anchor - low : anchor - low - step + 1 + length]
                    key = xxhash.xxh3_64_intdigest(core, seed=low + 1) - (1 << 63)
                    fold = xxhash.xxh3_64_intdigest(piece[at : stop + length - 1], seed=length) - (1 << 63)
                    made.append((up_key, up_fold, at, n, i, start + at, stop - at, anchor - at, key, fold))
                    at = stop
            columns = list(zip(*made)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], list(names))

    return cut


def repeated_starts(shards: list[list[bytes]], length: int) -> list[list[np.ndarray]]:
    """Of each text of each shard, which starts have an equal string of ``length`` bytes elsewhere in the shard."""
    sizes = np.array([sum(map(len, shard)) + len(shard) for shard in shards])
    symbols = np.zeros((int(sizes.max()), len(shards)), np.int64)
    for k, shard in enumerate(shards):
        # 1 stands between texts, 0 at the end.
        line = np.frombuffer(b"\0".join(shard), np.uint8).astype(np.int64) + 2
        line[np.cumsum([len(x) + 1 for x in shard])[:-1] - 1] = 1
        symbols[: len(line), k] = line
    common, before = common_prefixes(symbols, sizes, suffix_arrays(symbols, sizes))
    repeated = common >= length
    row, lane = np.nonzero(repeated)
    repeated[before[row, lane], lane] = True
    out = []
    for k, shard in enumerate(shards):
        at, marks = 0, []
        for text in shard:
            marks.append(repeated[at : at + len(text) - length + 1, k])
            at += len(text) + 1
        out.append(marks)
    return out


def runs(marks: np.ndarray) -> list[dict[str, int]]:
    """Maximal runs of true values as {first, stop}."""
    edge = np.flatnonzero(np.diff(np.r_[False, marks, False]))
    return [{"first": int(a), "stop": int(b)} for a, b in zip(edge[::2], edge[1::2])]


def _settle_shards(length: int):
    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("first", pa.int32()), ("stop", pa.int32())]))
        for batch in batches:
            # Lanes of like length, so many that their symbols stay within the bound.
            rows = batch.to_pylist()
            rows.sort(key=lambda row: sum(len(x["piece"]) for x in row["held"]))
            start = 0
            while start < len(rows):
                stop, longest = start, 0
                while stop < len(rows):
                    longest = max(longest, sum(len(x["piece"]) + 1 for x in rows[stop]["held"]))
                    if stop > start and longest * (stop - start + 1) > SORT_SYMBOLS:
                        break
                    stop += 1
                shards = rows[start:stop]
                found = repeated_starts([[x["piece"] for x in row["held"]] for row in shards], length)
                made = [
                    (row["key"], x["fold"], runs(np.ones(len(marks), bool) if x["n"] > 1 else marks))
                    for row, each in zip(shards, found) for x, marks in zip(row["held"], each)
                ]
                key, fold, spans = zip(*made)
                yield pa.record_batch({
                    "key": pa.array(key, pa.int64()), "fold": pa.array(fold, pa.int64()), "runs": pa.array(spans, kind)
                })
                start = stop

    return settle


def _stored(frame: DataFrame, folder: str, name: str) -> DataFrame:
    frame.write.option("compression", "zstd").parquet(f"{folder}/{name}")
    return frame.sparkSession.read.parquet(f"{folder}/{name}")


def _numbered(docs: DataFrame, text: str, folder: str) -> DataFrame:
    """The rows under numbers of their own, stored in buckets by number, so that later joins leave the texts in place."""
    spark = docs.sparkSession
    rest = [F.col(f"`{name}`") for name in docs.columns if name != text]
    frame = docs.select(
        F.monotonically_increasing_id().alias("id"),
        (F.struct(*rest) if rest else F.struct(F.lit(0).alias("none"))).alias("rest"),
        F.col(f"`{text}`").cast("binary").alias("bytes"),
    )
    buckets, name = int(spark.conf.get("spark.sql.shuffle.partitions")), f"texts_{uuid.uuid4().hex}"
    writer = frame.repartition(buckets, "id").write.bucketBy(buckets, "id")
    writer.option("path", f"{folder}/{name}").option("compression", "zstd").saveAsTable(name)
    return spark.table(name)


def _counted(folded: DataFrame) -> DataFrame:
    """Folded segments of anchors that occur more than once, with the number of different ones at the anchor."""
    sizes = folded.groupBy("key").agg(F.count("*").alias("different"), F.sum("n").alias("all")).where("all > 1")
    return folded.join(sizes.drop("all"), "key").select("key", "fold", "n", "different", "at.*")


def _pieces_of(table: DataFrame, folded: DataFrame, length: int) -> DataFrame:
    """Folded segments with their bytes, taken from the text where they were first found."""
    piece = F.expr(f"substring(bytes, start + 1, width + {length - 1})").alias("piece")
    return table.join(folded.hint("shuffle_hash"), "id").select(*(F.col(name) for name in folded.columns), piece)


def _settled(table: DataFrame, folded: DataFrame, length: int) -> DataFrame:
    """Repeated starts of folded segments, as runs, but for what a frequent anchor's different segments share."""
    whole = F.array(F.struct(F.lit(0).alias("first"), F.col("width").alias("stop")))
    alone = folded.where(f"n > 1 and (different = 1 or different > {SHARD_SEGMENTS})").select("key", "fold", whole.alias("runs"))
    sharded = folded.where(f"different between 2 and {SHARD_SEGMENTS}")
    shards = _pieces_of(table, sharded, length).groupBy("key").agg(F.collect_list(F.struct("fold", "n", "piece")).alias("held"))
    sorted_ = shards.mapInArrow(_settle_shards(length), f"key long, fold long, runs {RUNS}").where("size(runs) > 0")
    return alone.unionByName(sorted_)


def _repeated_spans(table: DataFrame, found: DataFrame, length: int, folder: str) -> DataFrame:
    """Spans of repeated strings (id, begin, end), some of them overlapping, from all segments."""
    at = F.struct("id", "start", "width", "anchor")
    again = found.groupBy("key").count().where("count > 1").select("key")
    found = _stored(found.join(again, "key", "left_semi"), folder, "candidates")
    folded = _stored(_counted(found.groupBy("key", "fold").agg(F.count("*").alias("n"), F.min(at).alias("at"))), folder, "folded")
    tiers = [(None, _stored(_settled(table, folded, length), folder, "runs"))]
    for step in FINER:
        frequent = folded.where(f"different > {SHARD_SEGMENTS}")
        if frequent.isEmpty():
            break
        cut = _pieces_of(table, frequent, length).select("key", "fold", "n", "id", "start", "width", "anchor", "piece")
        parts = _stored(cut.mapInArrow(_cut_finer(length, step), PART), folder, f"parts-{step}")
        folded = _counted(parts.groupBy("key", "fold").agg(F.sum("n").alias("n"), F.min(at).alias("at")))
        folded = _stored(folded, folder, f"folded-{step}")
        tiers.append((parts, _stored(_settled(table, folded, length), folder, f"runs-{step}")))
    # Runs of parts are runs of the segments that these were cut from.
    while len(tiers) > 1:
        parts, runs_ = tiers.pop()
        moved = F.transform("runs", lambda r: F.struct((r["first"] + F.col("offset")).alias("first"), (r["stop"] + F.col("offset")).alias("stop")))
        above = parts.join(runs_, ["key", "fold"]).select(
            F.col("up_key").alias("key"), F.col("up_fold").alias("fold"), moved.alias("runs")
        )
        tiers[-1] = (tiers[-1][0], tiers[-1][1].unionByName(above))
    settled = tiers[0][1].groupBy("key", "fold").agg(F.sort_array(F.flatten(F.collect_list("runs"))).alias("runs"))
    settled = settled.withColumn("runs", F.expr(JOINED_RUNS))
    spans = found.join(settled, ["key", "fold"]).select("id", "start", F.explode("runs").alias("run"))
    return spans.select(
        "id", (F.col("start") + F.col("run.first")).alias("begin"),
        (F.col("start") + F.col("run.stop") + length - 1).alias("end"),
    )


def _repeats(docs: DataFrame, text: str, length: int) -> DataFrame:
    """id, rest, bytes and the spans of repeated strings (begin, end), unmerged; null where there are none."""
    if not GRAM <= length <= LENGTH:
        raise ValueError(f"length must be between {GRAM} and {LENGTH}")
    folder = f"{shared_folder(docs.sparkSession)}/suffix-dedup-{uuid.uuid4().hex}"
    table = _numbered(docs, text, folder)
    long_enough = table.where(F.octet_length("bytes") >= length)
    found = _stored(long_enough.select("id", "bytes").mapInArrow(_find(length, PIECE_BYTES), SEGMENT), folder, "segments")
    spans = _repeated_spans(table, found, length, folder)
    spans = spans.groupBy("id").agg(F.collect_list(F.struct("begin", "end")).alias("spans"))
    return table.join(spans.hint("shuffle_hash"), "id", "left")


def merged(begins: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of spans, as maximal ones in order."""
    order = np.argsort(begins, kind="stable")
    begins, reach = begins[order], np.maximum.accumulate(ends[order])
    new = np.flatnonzero(np.r_[True, begins[1:] > reach[:-1]])
    return begins[new], reach[np.r_[new[1:] - 1, len(begins) - 1]]


def _cut(texts: pa.Array, spans: pa.Array) -> pa.Array:
    """What is left of each text, its removed spans and its digest; null where there are no spans."""
    kept, removed, digests = [], [], []
    for value, held in zip(texts, spans):
        if not held.is_valid:
            kept.append(None), removed.append(None), digests.append(None)
            continue
        begins, ends = merged(*(held.values.field(i).to_numpy().astype(np.int64) for i in (0, 1)))
        view = memoryview(value.as_buffer())
        left = b"".join(view[a:b] for a, b in zip([0, *ends.tolist()], [*begins.tolist(), len(view)]))
        kept.append(left)
        removed.append([{"begin": a, "end": b} for a, b in zip(begins.tolist(), ends.tolist())])
        digests.append(hashlib.sha256(left).hexdigest())
    span = pa.struct([("begin", pa.int64()), ("end", pa.int64())])
    return pa.StructArray.from_arrays(
        [pa.array(kept, pa.binary()), pa.array(removed, pa.list_(span)), pa.array(digests, pa.string())],
        ["kept", "removed", "sha256"],
    )


_cut.__annotations__ = {"texts": pa.Array, "spans": pa.Array, "return": pa.Array}
CUT = "kept binary, removed array<struct<begin: bigint, end: bigint>>, sha256 string"


def with_repeats(docs: DataFrame, text: str = "text", length: int = LENGTH) -> DataFrame:
    """Every row with what repeated strings take from it.

    Adds n_bytes, n_removed, n_spans (maximal removed runs), removed (those runs as byte offsets, end
    exclusive), kept (the bytes that are left) and kept_sha256. See the module for nulls and names.
    """
    cut = F.arrow_udf(_cut, CUT)(F.when(F.col("spans").isNotNull(), F.col("bytes")), F.col("spans"))
    bare = F.coalesce(F.col("bytes"), F.lit(b""))
    none = F.array().cast("array<struct<begin: bigint, end: bigint>>")
    removed = F.coalesce(F.col("cut.removed"), none)
    added = {
        "n_bytes": F.octet_length(bare).cast("bigint"),
        "n_removed": F.aggregate(removed, F.lit(0).cast("bigint"), lambda n, x: n + x["end"] - x["begin"]),
        "n_spans": F.size(removed).cast("bigint"),
        "removed": removed,
        "kept": F.coalesce(F.col("cut.kept"), bare),
        "kept_sha256": F.coalesce(F.col("cut.sha256"), F.sha2(bare, 256)),
    }
    rows = _repeats(docs, text, length).select("rest", "bytes", cut.alias("cut"))
    old = [
        (F.col("bytes").cast("string") if name == text else F.col("rest")[name]).alias(name)
        for name in docs.columns if name not in added
    ]
    return rows.select(*old, *(column.alias(name) for name, column in added.items()))


def without_repeats(docs: DataFrame, text: str = "text", length: int = LENGTH) -> DataFrame:
    """The same rows and columns with repeated strings cut from the text; a character cut in two goes whole."""
    found = with_repeats(docs, text, length)
    left = F.when(F.col("n_removed") == 0, F.col(f"`{text}`")).otherwise(F.try_validate_utf8(F.make_valid_utf8(F.col("kept").cast("string"))))
    return found.select(*(left.alias(name) if name == text else F.col(f"`{name}`") for name in docs.columns))
