"""SimHash near-duplicates through an inverted index of byte positions.

A fingerprint is eight bytes. Two that differ in at most four bits agree in at
least four bytes at the same position. The index therefore lists fingerprints
under every group of three (position, byte) postings of a covering family: any
four positions contain a group of it, so a pair with the guaranteed count meets
in a list. Lists hold distinct fingerprints only. For each pair in a list the
shared positional bytes are tallied, pairs with fewer than four are dropped,
and the rest verified by their differing bits. A task keeps a spanning forest of the
links that it has verified, never the pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.batches import joined_words, shingle_runs, struct_column
from lodestone.llm.components import components
from lodestone.llm.text import free_name
from lodestone.llm.storage import broadcast_if_small
from lodestone.operators.lineage import checkpointed

SEED = 42
BYTES = 8
GROUPS = ((0, 1, 2), (3, 4, 5), (6, 7))
#: Fingerprints of one list compared in one task; longer lists are split into pairs of blocks.
BLOCK = 2_048


def covering_triples() -> list[tuple[int, int, int]]:
    """Triples of byte positions such that any four positions contain one."""
    found = []
    for triple in combinations(range(BYTES), 3):
        counts = [sum(p in group for p in triple) for group in GROUPS]
        if 3 in counts or any(counts[i] == 2 and counts[(i + 1) % 3] == 1 for i in range(3)):
            found.append(triple)
    return found


TRIPLES = covering_triples()
#: Hashes whose bits are counted at once.
RUN = 1 << 17


def fingerprints(texts: list[bytes], shingle: int = 4) -> list[np.ndarray]:
    """One signed 64-bit fingerprint for each text; bits are counted in runs, so memory doesn't follow the longest text's shingles."""
    digest = xxhash.xxh64_intdigest
    ones = np.zeros((len(texts), 8 * BYTES), np.int64)
    counts = np.zeros(len(texts), np.int64)
    owners: list[int] = []
    sizes: list[int] = []
    hashes: list[int] = []

    def count() -> None:
        bits = np.unpackbits(np.array(hashes, ">u8").view(np.uint8).reshape(-1, BYTES), axis=1)
        begin = np.cumsum(sizes) - sizes
        np.add.at(ones, owners, np.add.reduceat(bits, begin, axis=0, dtype=np.int64))
        np.add.at(counts, owners, sizes)
        owners.clear(), sizes.clear(), hashes.clear()

    for i, text in enumerate(texts):
        for run in shingle_runs(joined_words(text), shingle):
            owners.append(i)
            sizes.append(len(run))
            hashes += [digest(x, SEED) for x in run]
            if len(hashes) >= RUN:
                count()
    if hashes:
        count()
    return [np.packbits(2 * ones > counts[:, None], axis=1).view(">u8")[:, 0].astype(np.uint64).view(np.int64)]


def with_fingerprint(docs: DataFrame, text: str = "text", shingle: int = 4, name: str = "fingerprint") -> DataFrame:
    """Add the fingerprint as a signed long. Texts without words, and nulls, get zero."""
    made = struct_column("value bigint", lambda texts: fingerprints(texts, shingle))
    columns = [F.col(f"`{c}`") for c in docs.columns if c != name]
    inner = free_name(docs, "made")
    return docs.select(*columns, made(F.col(text)).alias(inner)).select(*columns, F.col(inner)["value"].alias(name))


class Forest:
    """Union-find over numbers given to the values that are linked."""

    def __init__(self) -> None:
        self.parent: dict[int, int] = {}

    def root(self, x: int) -> int:
        parent = self.parent
        top = x
        while (up := parent.get(top, top)) != top:
            top = up
        while (up := parent.get(x, x)) != x:
            parent[x] = top
            x = up
        return top

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        low, high = (a, b) if a < b else (b, a)
        self.parent[high] = low
        self.parent.setdefault(low, low)
        return True


def verified(left: np.ndarray, right: np.ndarray | None, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of ``left`` and ``right`` (or of ``left`` with itself) within ``bits`` differing bits."""
    least = BYTES - bits
    other = left if right is None else right
    step = max(1, (1 << 20) // max(len(other), 1))
    for at in range(0, len(left), step):
        differing = left[at : at + step, None] ^ other[None, :]
        # The count filter: bytes that agree are zero bytes of the difference.
        apart = sum(((differing >> np.uint64(8 * p)) & np.uint64(255)) != 0 for p in range(BYTES)) if least > 0 else 0
        near = (apart <= BYTES - least) if least > 0 else np.ones(differing.shape, bool)
        near &= np.bitwise_count(differing) <= bits
        i, j = np.nonzero(near)
        i = i + at
        if right is None:
            keep = i < j
            i, j = i[keep], j[keep]
        yield i, j


def _links(bits: int):
    """Forest edges of the lists in a partition sorted by (list, part, side)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = Forest()
        schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
        made: list[tuple[int, int]] = []

        def judge(values: np.ndarray, sides: np.ndarray) -> None:
            values = values.view(np.uint64)
            left, right = values[sides <= 0], values[sides == 1]
            within = sides[0] < 0  # a whole list or a block with itself
            if len(left) == 0 or (not within and len(right) == 0) or (within and len(left) < 2):
                return
            for i, j in verified(left, None if within else right, bits):
                a = left.view(np.int64)[i].tolist()
                b = (left if within else right).view(np.int64)[j].tolist()
                made.extend(pair for pair in zip(a, b) if forest.join(*pair))

        held: list[tuple[np.ndarray, ...]] = []
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("list", "part", "side", "fingerprint")]
            new = np.ones(batch.num_rows, bool)
            new[1:] = (columns[0][1:] != columns[0][:-1]) | (columns[1][1:] != columns[1][:-1])
            new[0] = last is None or last != (columns[0][0], columns[1][0])
            last = (columns[0][-1], columns[1][-1])
            cuts = [*np.flatnonzero(new).tolist(), batch.num_rows]
            if cuts[0] > 0:
                held.append((columns[3][: cuts[0]], columns[2][: cuts[0]]))
            for start, stop in zip(cuts, cuts[1:]):
                if held:
                    judge(*(np.concatenate(x) for x in zip(*held)))
                held = [(columns[3][start:stop], columns[2][start:stop])]
            while len(made) >= 1 << 16:
                part, made = made[: 1 << 16], made[1 << 16 :]
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*part)], schema=schema)
        if held:
            judge(*(np.concatenate(x) for x in zip(*held)))
        if made:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*made)], schema=schema)

    return run


def postings(distinct: DataFrame) -> DataFrame:
    """(list, fingerprint): each fingerprint under its twenty groups of positional bytes."""
    value = F.col("fingerprint")

    def key(number: int, triple: tuple[int, ...]):
        parts = F.lit(number).cast("bigint")
        for p in triple:
            parts = parts * 256 + F.shiftrightunsigned(value, 8 * p).bitwiseAND(F.lit(255))
        return parts

    keys = F.array(*(key(i, t) for i, t in enumerate(TRIPLES)))
    return distinct.select(F.explode(keys).alias("list"), "fingerprint")


def near_links(distinct: DataFrame, bits: int = 4, block: int = BLOCK) -> DataFrame:
    """Links (a, b) of distinct fingerprints within ``bits`` <= 4 that connect what the complete links connect.

    Lists longer than ``block`` are cut into blocks by a hash; each pair of
    blocks is a part of its own, so no task holds more than two blocks.
    """
    if not 0 <= bits <= 4:
        raise ValueError("the covering family holds for at most four differing bits")
    spark = distinct.sparkSession
    index = postings(distinct)
    sizes = index.groupBy("list").agg(F.count(F.lit(1)).alias("held")).where("held > 1")
    sized = index.join(sizes, "list")
    blocks = F.ceil(F.col("held") / F.lit(block)).cast("int")
    own = F.pmod(F.xxhash64("fingerprint"), F.col("blocks").cast("bigint")).cast("int")
    short = sized.where(F.col("held") <= block).select(
        "list", F.lit(0).alias("part"), F.lit(-1).alias("side"), "fingerprint"
    )
    long = (
        sized.where(F.col("held") > block)
        .select("list", "fingerprint", blocks.alias("blocks"))
        .withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select(
            "list",
            (F.least("own", "other") * F.col("blocks") + F.greatest("own", "other")).alias("part"),
            F.when(F.col("own") == F.col("other"), -1).otherwise((F.col("own") > F.col("other")).cast("int")).alias("side"),
            "fingerprint",
        )
    )
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return (
        short.unionByName(long)
        .repartition(parts, "list", "part")
        .sortWithinPartitions("list", "part")
        .mapInArrow(_links(bits), "a bigint, b bigint")
    )


def near_duplicates(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 4, bits: int = 4
) -> DataFrame:
    """(doc_id, fingerprint as 16 hex digits, component_id, text_hash), one row for each row of ``docs``.

    component_id is the smallest id reachable over links of at most ``bits``
    differing bits. Null texts and texts without words have fingerprint zero and
    link like any other. Rows with a null id keep their row and take the smallest
    id of their component, null if it has none. Repeated rows stay repeated.
    Other columns are ignored. An empty table gives an empty result.
    """
    marked = checkpointed(
        with_fingerprint(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), "text", shingle)
        .select("doc_id", "fingerprint", F.xxhash64("text").alias("text_hash"))
    )
    folded = checkpointed(marked.groupBy("fingerprint").agg(F.min("doc_id").alias("first")))
    links = checkpointed(near_links(folded.select("fingerprint"), bits))
    classes = components(links).withColumnRenamed("node", "fingerprint")
    labelled = folded.join(classes, "fingerprint", "left").withColumn(
        "component", F.coalesce("component", "fingerprint")
    )
    smallest = labelled.groupBy("component").agg(F.min("first").alias("component_id"))
    by_fingerprint = labelled.join(smallest, "component").select("fingerprint", "component_id")
    return marked.join(by_fingerprint, "fingerprint").select(
        "doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id", "text_hash"
    )


def keep_first(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 4, bits: int = 4) -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of their component.

    Rows without an id stay, and so do rows that repeat the id that is kept.
    """
    gone = broadcast_if_small(
        near_duplicates(docs, doc_id, text, shingle, bits)
        .where("doc_id > component_id")
        .select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"))
        .distinct()
    )
    return docs.join(gone, (docs[doc_id] == gone["_id"]) & (F.xxhash64(docs[text]) == gone["_hash"]), "left_anti")
