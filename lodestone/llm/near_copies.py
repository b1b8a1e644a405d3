"""Near copies by the Jaccard similarity of word shingles: fingerprints and banded minima, then exact verification.

Every text is the set of its five-word shingles. SimHash fingerprints of at most four differing bits, found by the
index of positional bytes, propose the closest copies; they alone would miss most pairs at 0.8. Texts that share a band of six minima (of
forty bands; a pair at similarity 0.8 misses all with a chance of 5e-6) are a list, and lists of
the same texts are one. Only texts of one list are compared, by their exact sets:
first each with the least of its list, which joins most copies; then, in lists that these links leave in
several components, all pairs of different components, in blocks of bounded size. Tasks keep a spanning
forest of the pairs that reach the limit, and only such links are closed into components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.batches import joined_words, shingle_runs, struct_column
from lodestone.llm.components import components
from lodestone.llm.simhash import SEED, Forest, near_links
from lodestone.llm.storage import broadcast_if_small
from lodestone.operators.lineage import checkpointed

SHINGLE = 5
SIMILARITY = 0.8
BANDS = 40
ROWS = 6
#: Texts of one candidate group compared in one task; larger groups are split into pairs of blocks.
BLOCK = 512
#: Hashes multiplied at once while minima are taken.
CHUNK = 4_096
MULTIPLIERS = (np.random.default_rng(SEED).integers(0, 1 << 31, BANDS * ROWS, np.uint32) * np.uint32(2) + np.uint32(1))[:, None]
OFFSETS = np.random.default_rng(SEED + 1).integers(0, 1 << 32, BANDS * ROWS, np.uint32)[:, None]


def shingle_hashes(joined: bytes, shingle: int) -> Iterator[np.ndarray]:
    """Hashes of the runs of ``shingle`` joined words, some at a time."""
    digest = xxhash.xxh64_intdigest
    for run in shingle_runs(joined, shingle):
        yield np.fromiter((digest(x, SEED) for x in run), np.uint64, len(run))


def signatures(texts: list[bytes], shingle: int) -> list[list]:
    """A digest of the words of each text, the keys of its bands and its fingerprint (none without words)."""
    nodes, keys, prints = [], [], []
    for text in texts:
        joined = joined_words(text)
        nodes.append(xxhash.xxh64_intdigest(joined, SEED) - (1 << 63))
        if not joined:
            keys.append([])
            prints.append(None)
            continue
        ones, count = np.zeros(64, np.int64), 0
        least = np.full(BANDS * ROWS, 0xFFFFFFFF, np.uint32)
        for hashes in shingle_hashes(joined, shingle):
            low = hashes.astype(np.uint32)
            count += len(hashes)
            for at in range(0, len(low), CHUNK):
                bits = np.unpackbits(hashes[at : at + CHUNK].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
                ones += bits.sum(axis=0, dtype=np.int64)
                np.minimum(least, (low[None, at : at + CHUNK] * MULTIPLIERS + OFFSETS).min(axis=1), out=least)
        raw = least.tobytes()
        width = 4 * ROWS
        keys.append([xxhash.xxh64_intdigest(raw[b * width : (b + 1) * width], b) - (1 << 63) for b in range(BANDS)])
        prints.append(int(np.packbits(2 * ones > count).view(">u8")[0].astype(np.uint64).view(np.int64)))
    return [nodes, keys, prints]


def shingle_sets(texts: list[bytes], shingle: int) -> list[list[bytes]]:
    none = np.zeros(0, np.uint64)
    return [[np.unique(np.concatenate([none, *shingle_hashes(joined_words(t), shingle)])).tobytes() for t in texts]]


def similar(left: list[np.ndarray], right: list[np.ndarray] | None, limit: float, forest: Forest, names: list[int], others: list[int]):
    """Pairs of names, one of ``left`` and one of ``right`` (or of ``left``), that reach ``limit`` and join two trees."""
    other, other_names = (left, names) if right is None else (right, others)
    sizes = np.array([len(s) for s in other])
    pool, number = np.unique(np.concatenate([*left, *other]), return_inverse=True)
    cuts = np.cumsum([len(s) for s in left] + [len(s) for s in other])
    parts = np.split(number, cuts[:-1])
    flat = np.concatenate(parts[len(left) :])
    ends = np.cumsum(sizes)
    mark = np.zeros(len(pool), bool)
    own, at = parts[: len(left)], parts[len(left) :]
    for i, held in enumerate(own):
        first = i + 1 if right is None else 0
        root = forest.root(names[i])
        apart = [j for j in range(first, len(other)) if forest.root(other_names[j]) != root]
        if not apart:
            continue
        mark[held] = True
        if len(apart) == len(other) - first:
            begin = int(ends[first - 1]) if first else 0
            shared = np.add.reduceat(mark[flat[begin:]], ends[first:] - sizes[first:] - begin, dtype=np.int64)
        else:
            shared = np.array([np.count_nonzero(mark[at[j]]) for j in apart])
        mark[held] = False
        whole = sizes[apart] + len(held) - shared
        for j in np.flatnonzero(shared >= limit * whole).tolist():
            if forest.join(names[i], other_names[apart[j]]):
                yield names[i], other_names[apart[j]]


def _links(limit: float):
    """Forest edges of the parts in a partition sorted by (group, part, side)."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = Forest()
        held: dict[int, tuple[list[int], list[np.ndarray]]] = {}
        last = None

        def judged() -> Iterator[pa.RecordBatch]:
            if not held:
                return
            within = -1 in held
            names, sets = held.get(-1) or held.get(0, ([], []))
            others, other_sets = held.get(1, ([], []))
            if len(names) > 1 if within else names and others:
                made = list(similar(sets, None if within else other_sets, limit, forest, names, others))
                if made:
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*made)], schema=schema)

        for batch in batches:
            group, part, side, node, known = (
                batch.column(c).to_pylist() for c in ("component", "part", "side", "node", "known")
            )
            sets = batch.column("hashes")
            for k in range(batch.num_rows):
                if last != (group[k], part[k]):
                    yield from judged()
                    held, last = {}, (group[k], part[k])
                names, values = held.setdefault(side[k], ([], []))
                names.append(node[k])
                forest.join(node[k], known[k])
                values.append(np.frombuffer(sets[k].as_py(), np.uint64))
        yield from judged()

    return run


def _compared(parts: DataFrame, limit: float) -> DataFrame:
    """Links found in each (component, part): pairs of side 0 and side 1, or all pairs of side -1."""
    tasks = int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (
        parts.select("component", "part", "side", "node", "known", "hashes")
        .repartition(tasks, "component", "part")
        .sortWithinPartitions("component", "part")
        .mapInArrow(_links(limit), "a bigint, b bigint")
    )


def similar_links(sets: DataFrame, limit: float = SIMILARITY, block: int = BLOCK) -> DataFrame:
    """Links (a, b) of nodes that connect what all pairs of a group at ``limit`` or more connect.

    ``sets`` has (component, held, node, hashes); ``held`` is the size of the group. Nodes of equal
    ``known``, if there is such a column, are connected already.
    """
    count = F.ceil(F.col("held") / F.lit(block)).cast("int")
    own = F.pmod(F.xxhash64("node"), F.col("blocks").cast("bigint")).cast("int")
    parts = (
        sets.withColumn("known", F.col("known" if "known" in sets.columns else "node"))
        .withColumn("blocks", count)
        .withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .withColumn("part", F.least("own", "other") * F.col("blocks") + F.greatest("own", "other"))
        .withColumn(
            "side", F.when(F.col("own") == F.col("other"), -1).otherwise((F.col("own") > F.col("other")).cast("int"))
        )
    )
    return _compared(parts, limit)


def star_links(members: DataFrame, sets: DataFrame, limit: float, block: int = BLOCK) -> DataFrame:
    """Links of nodes with the least node ``a`` of a list that holds both, in blocks of bounded size."""
    rays = members.where("node <> a").select("a", "node").distinct()
    sizes = rays.groupBy("a").agg(F.ceil(F.count("*") / F.lit(block)).cast("int").alias("blocks"))
    rays = rays.join(sizes, "a").select(
        F.col("a").alias("component"), F.pmod(F.xxhash64("node"), F.col("blocks").cast("bigint")).cast("int").alias("part"),
        F.lit(1).alias("side"), "node",
    )
    centres = sizes.select(
        F.col("a").alias("component"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("part"),
        F.lit(0).alias("side"), F.col("a").alias("node"),
    )
    return _compared(rays.unionByName(centres).join(sets, "node").withColumn("known", F.col("node")), limit)


def fingerprint_rays(nodes: DataFrame) -> DataFrame:
    """Pairs (a, node) that connect the nodes whose fingerprints are linked; ``nodes`` has (node, fingerprint)."""
    known = nodes.where("fingerprint IS NOT NULL")
    first = checkpointed(known.groupBy("fingerprint").agg(F.min("node").alias("a")))
    equal = known.join(first, "fingerprint").where("node <> a").select("a", "node")
    links = near_links(first.select("fingerprint"))
    low, high = first.toDF("a", "x"), first.toDF("b", "y")
    apart = links.join(low, "a").join(high, "b").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("node"))
    return equal.unionByName(apart)


def with_component(
    docs: DataFrame, doc_id: str, text: str, shingle: int, similarity: float, block: int = BLOCK
) -> DataFrame:
    """(doc_id, text_hash, component), one row for each row of ``docs``; texts of the same words are one node.

    Null texts and texts without words are one node. Texts are read whole, whatever their length; rows are kept
    however often they repeat; other columns are ignored, an empty table gives no rows.
    """
    sign = struct_column("node bigint, keys array<bigint>, fingerprint bigint", lambda texts: signatures(texts, shingle))
    marked = checkpointed(
        docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("text_hash"), sign(F.col(text)).alias("made"))
        .select("doc_id", "text_hash", "made.node", "made.keys", "made.fingerprint")
    )
    folded = marked.groupBy("node").agg(F.first("keys").alias("keys"), F.min("text_hash").alias("text_hash"))
    prints = checkpointed(
        marked.groupBy("node").agg(F.first("fingerprint").alias("fingerprint"), F.min("text_hash").alias("text_hash"))
    )
    rays = checkpointed(fingerprint_rays(prints.select("node", "fingerprint")))
    postings = checkpointed(folded.select("node", "text_hash", F.explode("keys").alias("list")))
    lists = postings.groupBy("list").agg(
        F.min("node").alias("a"), F.count(F.lit(1)).alias("held"),
        *(F.bit_xor(F.xxhash64("node", F.lit(k))).alias(f"mark{k}") for k in (1, 2)),
    ).where("held > 1")
    different = lists.groupBy("a", "held", "mark1", "mark2").agg(F.min("list").alias("list"))
    members = checkpointed(postings.join(different.select("list", "a", "held"), "list"))
    ends = rays.select(F.explode(F.array("a", "node")).alias("node")).distinct()
    chosen = members.select("node", "text_hash").unionByName(prints.join(ends, "node").select("node", "text_hash")).distinct()
    texts = docs.select(F.col(text).alias("text"), F.xxhash64(text).alias("text_hash"))
    found = texts.join(broadcast_if_small(chosen), "text_hash").groupBy("node").agg(F.first("text").alias("text"))
    made = struct_column("hashes binary", lambda texts: shingle_sets(texts, shingle))
    sets = checkpointed(found.select("node", made(F.col("text")).alias("made")).select("node", "made.hashes"))
    stars = checkpointed(star_links(members.select("a", "node").unionByName(rays), sets, similarity, block))
    joined = components(stars)
    known = members.select("list", "held", "node").join(joined, "node", "left").select(
        "list", "held", "node", F.coalesce("component", "node").alias("known")
    )
    parted = known.groupBy("list").agg(F.min("known").alias("low"), F.max("known").alias("high")).where("low < high")
    left = known.join(parted.select("list"), "list").withColumnRenamed("list", "component").join(sets, "node")
    more = checkpointed(similar_links(left, similarity, block))
    labels = components(stars.unionByName(more))
    return marked.select("doc_id", "text_hash", "node").join(labels, "node", "left").select(
        "doc_id", "text_hash", F.coalesce("component", "node").alias("component")
    )


def keep_one(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, similarity: float = SIMILARITY
) -> DataFrame:
    """One row of ``docs`` for each component of texts linked at ``similarity`` or more.

    It is the row of the smallest id, null being the largest; of several texts under that id, that of the
    smallest hash, and of rows that repeat id and text, any one. Words are
    lower-cased and split at ASCII whitespace. Texts of fewer words than ``shingle`` are one shingle; nulls and texts without
    words are copies of each other. An empty table gives no rows.
    """
    marked = checkpointed(with_component(docs, doc_id, text, shingle, similarity))
    rank = F.struct(F.col("doc_id").isNull().alias("unnamed"), F.col("doc_id"), F.col("text_hash"))
    best = marked.groupBy("component").agg(F.min(rank).alias("best"))
    keys = marked.groupBy("component", "doc_id", "text_hash").agg(F.count(F.lit(1)).alias("copies"))
    judged = checkpointed(
        keys.join(best, "component").select(
            F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), "copies",
            (F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("text_hash") == F.col("best.text_hash"))).alias("first"),
        )
    )
    # Rows that go, and rows of which one stays.
    gone = broadcast_if_small(judged.where("NOT first OR copies > 1").select("_id", "_hash"))
    repeated = broadcast_if_small(judged.where("first AND copies > 1").select("_id", "_hash"))

    def same(other: DataFrame):
        return docs[doc_id].eqNullSafe(other["_id"]) & (F.xxhash64(docs[text]) == other["_hash"])

    single = docs.join(gone, same(gone), "left_anti")
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    once = (
        docs.join(repeated, same(repeated), "left_semi")
        .groupBy(F.col(doc_id).alias("__id"), F.xxhash64(text).alias("__hash"))
        .agg(F.first(row).alias("__row"))
        .select("__row.*")
    )
    return single.unionByName(once)
