"""Layered neighbour graph (the ``hnsw`` kind) as tables and joins.

Build: every item draws a level from a geometric distribution; each layer links
its members to near items found by an inverted-file join. Items of different
groups (languages) are never linked: each group is a graph of its own inside the
same tables, so a search may be restricted to some of them and loses nothing.

Search: all queries walk the layers of all their groups together. One round joins
the unexpanded beam with the edges, scores the new nodes and keeps the best
``ef`` per query and group, until no beam has anything left to expand.

Insertion: a batch searches the stored graph for its neighbours, so only its own nodes
and those that it links to get new adjacency lists.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.functions.arrow import with_arrow_column
from lodestone.functions.vectors import to_matrix, unit_rows
from lodestone.operators.ann import VectorIndex
from lodestone.operators.lineage import checkpointed, light
from lodestone.operators.nearest import SCORE_SCALE, nearest

#: Cells that a new item looks into for neighbours.
BUILD_PROBES = 8
#: Cells of a group in a layer: half the root of its rows, but no more than this many, and above the second number only
#: as many as hold the third number of rows each. Small cells would hide most of the true neighbours from the probes.
MOST_CELLS = 4_096
FEW_CELLS = 16
CELL_ROWS = 16_384
#: Sides of a join are broadcast up to this many bytes.
BROADCAST_BYTES = 32 << 20
#: Pairs that meet the vectors of their nodes in one group, and those multiplied at once.
PART_PAIRS = 1 << 19
SCORED_ROWS = 1 << 14
#: Walks begin on the lowest layer above the ground that has at most so many nodes of the group, all of which are scored.
ENTRY_NODES = 8_192
_SLOTS = 1 << 30


def _group(column: str | None):
    return F.lit("") if column is None else F.coalesce(F.col(column).cast("string"), F.lit(""))


def _light(frame: DataFrame, rows: int, row_bytes: int) -> DataFrame:
    return F.broadcast(frame) if rows * row_bytes <= BROADCAST_BYTES else frame


def _keyed(items: DataFrame, item_vector: str, group: str | None) -> DataFrame:
    """Add the group and a 128-bit content hash of the vector."""
    vector = F.col(item_vector)
    return items.withColumns(
        {"_g": _group(group), "_h1": F.xxhash64(vector), "_h2": F.xxhash64(F.lit("copy"), vector)}
    )


def with_representative(items: DataFrame, item_id: str, item_vector: str, group: str | None = None) -> DataFrame:
    """Add ``rep``: the smallest id among items of the group with the same vector.

    Only representatives enter the graph, so copies cannot crowd each other out
    of the adjacency lists. Vectors are compared by a 128-bit content hash. One vector may have
    very many copies; they are the large side of a join with unique keys, which
    adaptive execution splits.
    """
    keyed, keys = _keyed(items, item_vector, group), ["_g", "_h1", "_h2"]
    reps = keyed.groupBy(*keys).agg(F.min(item_id).alias("rep")).toDF(*keys, "rep")
    return keyed.join(reps, keys).select(*items.columns, "rep")


def with_level(items: DataFrame, item_id: str, m: int) -> DataFrame:
    """Add ``level``: 0 for most rows, one higher with probability 1/m each time."""
    uniform = (F.pmod(F.xxhash64(item_id), F.lit(_SLOTS)) + 1) / F.lit(float(_SLOTS))
    return items.withColumn("level", F.floor(-F.log(uniform) / math.log(m)).cast("int"))


class Cells:
    """Centroids of every group; a place is written ``group#cell``."""

    def __init__(self, chosen: pa.Table) -> None:
        groups = np.array(chosen.column("_g").to_pylist(), dtype=object)
        matrix = unit_rows(to_matrix(chosen.column("_v"))) if len(groups) else np.empty((0, 0))
        self.of = {g: matrix[groups == g] for g in set(groups.tolist())}

    def places(self, groups: list[str], vectors: np.ndarray, probes: int) -> list[list[str]]:
        """The best cells of each vector's own group, the best first."""
        found: list[list[str]] = [[f"{g}#0"] for g in groups]
        names = np.array(groups, dtype=object)
        for group in set(groups):
            if (centroids := self.of.get(group)) is not None:
                at = np.flatnonzero(names == group)
                best = np.argsort(-(vectors[at] @ centroids.T), axis=1, kind="stable")[:, :probes]
                for i, cells in zip(at.tolist(), best.tolist()):
                    found[i] = [f"{group}#{c}" for c in cells]
        return found


def _placed(frame: DataFrame, cells: Cells, vector: str, probes: int) -> DataFrame:
    """Add ``_place``, with one row for each of the ``probes`` best cells."""

    def compute(batch):
        vectors = unit_rows(to_matrix(batch.column(vector)))
        return pa.array(cells.places(batch.column("_g").to_pylist(), vectors, probes), pa.list_(pa.string()))

    found = with_arrow_column(frame, T.StructField("_places", T.ArrayType(T.StringType())), (vector, "_g"), compute)
    return found.withColumn("_place", F.explode("_places")).drop("_places")


def _layer_links(layer: DataFrame, rows: dict[str, int], item_id, item_vector, m, candidates, probes) -> DataFrame:
    """Outgoing links ``src, dst, score`` of one layer, at most m per item.

    About ``candidates`` items from the best cells of the item's own group are looked at. Most
    links are the nearest of them; the rest are the best item of each further cell,
    which keeps dense groups of copies connected to their surroundings.
    """
    # Cells only steer the choice of links, so hash-chosen items serve as centroids.
    share = F.lit(0.0)
    for group, n in rows.items():
        wanted = min(MOST_CELLS, max(1, math.isqrt(n) // 2), max(FEW_CELLS, n // CELL_ROWS))
        share = F.when(F.col("_g") == group, F.lit(wanted / n)).otherwise(share)
    chosen = layer.filter(F.pmod(F.xxhash64(F.lit("cell"), item_id), F.lit(_SLOTS)) < share * _SLOTS)
    cells = Cells(chosen.orderBy(item_id).select("_g", F.col(item_vector).alias("_v")).toArrow())
    placed = _placed(layer.select(item_id, item_vector, "_g"), cells, item_vector, 1)
    starts = layer.select(F.col(item_id).alias("src"), F.col(item_vector).alias("query_embedding"), "_g")
    found = nearest(
        _placed(starts, cells, "query_embedding", probes), placed, max(1, -(-candidates // probes)) + 1,
        query_id="src", item_id=item_id, item_vector=item_vector, on="_place", per_group=True,
    ).withColumnRenamed("rank", "_cell_rank").filter(F.col("src") != F.col(item_id))
    overall = Window.partitionBy("src").orderBy(F.desc("score"), F.asc(item_id))
    spread_to = Window.partitionBy("src", F.col("_cell_rank") == 1).orderBy(F.desc("score"), F.asc(item_id))
    far = max(1, m // 4)
    ranked = found.withColumn("_near", F.row_number().over(overall)).withColumn(
        "_far", F.row_number().over(spread_to)
    )
    kept = ranked.filter(
        (F.col("_near") <= m - far) | ((F.col("_cell_rank") == 1) & (F.col("_far") <= far))
    )
    return kept.select("src", F.col(item_id).alias("dst"), "score")


def build_graph(
    items: DataFrame, *, item_id="chunk_id", item_vector="embedding",
    m=32, ef_construction=200, ef_search=64, group: str | None = None, probes: int = BUILD_PROBES,
) -> VectorIndex:
    """Levels and adjacency lists, one graph for each value of ``group``. Links are kept both ways, at most 2m per item."""
    leveled = checkpointed(
        with_level(with_representative(items, item_id, item_vector, group), item_id, m)
    )
    nodes = leveled.filter(F.col(item_id) == F.col("rep"))
    narrow = nodes.select(item_id, item_vector, "level", _group(group).alias("_g"))
    # One number for each group and level.
    counts = narrow.groupBy("_g", "level").count().collect()
    layers = []
    for level in range(max((r["level"] for r in counts), default=-1) + 1):
        rows: dict[str, int] = {}
        for r in counts:
            if r["level"] >= level:
                rows[r["_g"]] = rows.get(r["_g"], 0) + r["count"]
        layer = narrow.filter(F.col("level") >= level)
        out = checkpointed(_layer_links(layer, rows, item_id, item_vector, m, ef_construction, probes))
        back = out.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "score")
        best = Window.partitionBy("src").orderBy(F.desc("score"), F.asc("dst"))
        # Copies may all point at one item; Spark trims to m per task before the shuffle.
        back = back.withColumn("_n", F.row_number().over(best)).filter(F.col("_n") <= m).drop("_n")
        layers.append(out.union(back).withColumn("level", F.lit(level)))
    kind = items.schema[item_id].dataType
    if not layers:
        schema = T.StructType(
            [
                T.StructField("level", T.IntegerType()),
                T.StructField("src", kind),
                T.StructField("links", T.ArrayType(kind)),
            ]
        )
        edges = items.sparkSession.createDataFrame([], schema)
    else:
        union = layers[0]
        for layer in layers[1:]:
            union = union.unionByName(layer)
        edges = union.groupBy("level", "src").agg(F.collect_set("dst").alias("links"))
    return VectorIndex(
        "hnsw", leveled, item_id, item_vector, edges=checkpointed(edges),
        options={"m": m, "ef_construction": ef_construction, "ef_search": ef_search, "group": group},
    )


def _batches(asked: DataFrame) -> Iterator[DataFrame]:
    """The queries in batches by a hash of their ids, each small enough for a broadcast variable of its vectors."""
    size = asked.agg(F.sum(8 * F.size("_qv") + 64)).first()[0] or 0
    count = -(-size // BROADCAST_BYTES)
    if count <= 1:
        yield asked
        return
    for number in range(count):
        yield asked.filter(F.pmod(F.xxhash64(F.lit("batch"), "_q"), F.lit(count)) == number)


def _shared_queries(asked: DataFrame):
    """Ids and unit vectors of a batch of queries as a broadcast variable."""
    held = asked.toArrow()
    ids = pd.Index(held.column("_q").to_pandas())
    return asked.sparkSession.sparkContext.broadcast((ids, unit_rows(to_matrix(held.column("_qv")))))


def _scored(pairs: DataFrame, vectors: DataFrame, shared, rows: int) -> DataFrame:
    """Scores of at most ``rows`` rows ``_q, _g, node, _least``, rounded like the exact join, that reach ``_least``, if any.

    Pairs and vectors meet in parts of the nodes: a vector travels once for a part, not for every pair. A pair that
    comes several times meets there, too, and goes out once.
    """
    parts = max(4 * _partitions(pairs), rows // PART_PAIRS)
    fields = [pairs.schema["_q"], pairs.schema["_g"], pairs.schema["node"], T.StructField("score", T.DoubleType())]
    names = [f.name for f in fields]

    def place(frame: DataFrame):
        return frame.withColumn("_p", F.pmod(F.xxhash64("node"), F.lit(parts))).groupBy("_p")

    def score(key, left: pa.Table, right: pa.Table) -> pa.Table:
        made, reaches = np.zeros(left.num_rows), np.zeros(left.num_rows, bool)
        if left.num_rows and right.num_rows:
            ids, matrix = shared.value
            asked = ids.get_indexer(left.column("_q").to_pandas())
            at = pd.Index(right.column("node").to_pandas()).get_indexer(left.column("node").to_pandas())
            held = unit_rows(to_matrix(right.column("_iv")))
            for start in range(0, len(at), SCORED_ROWS):
                some = slice(start, start + SCORED_ROWS)
                made[some] = np.einsum("ij,ij->i", matrix[asked[some]], held[at[some]])
            made = np.rint(made * SCORE_SCALE) / SCORE_SCALE + 0.0
            least = left.column("_least").to_numpy()
            reaches = (at >= 0) & ~(made < least)
            kept = np.flatnonzero(reaches)
            first = np.unique(asked[kept].astype(np.int64) * right.num_rows + at[kept], return_index=True)[1]
            reaches = np.zeros(left.num_rows, bool)
            reaches[kept[first]] = True
        return left.append_column("score", pa.array(made)).filter(pa.array(reaches)).select(names)

    return place(pairs).cogroup(place(vectors)).applyInArrow(score, T.StructType(fields))


def _partitions(frame: DataFrame) -> int:
    return int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _nodes(index: VectorIndex) -> DataFrame:
    """Nodes of the graph: one for each vector of a group."""
    return index.items.filter(F.col(index.item_id) == F.col("rep")).select(
        F.col(index.item_id).alias("node"), F.col(index.item_vector).alias("_iv"), "level",
        _group(index.options.get("group")).alias("_g"),
    )


def _tops(nodes: DataFrame) -> dict[str, tuple[int, int]]:
    """The top layer of the graph of each group, and the layer where walks begin: one row for each group and layer."""
    sizes: dict[str, dict[int, int]] = {}
    for r in nodes.groupBy("_g", "level").count().collect():
        sizes.setdefault(r["_g"], {})[r["level"]] = r["count"]
    found = {}
    for name, counts in sizes.items():
        top, held = max(counts), 0
        enter = top
        for level in range(top, 0, -1):
            held += counts.get(level, 0)
            if held > ENTRY_NODES:
                break
            enter = level
        found[name] = (top, enter)
    return found


def _beams(
    index: VectorIndex, nodes: DataFrame, tops: dict[str, tuple[int, int]], asked: DataFrame, ef: int, layers: bool = False
) -> Iterator[tuple[int, DataFrame]]:
    """Layers from the top and what the queries found there, as ``_q, _g, node, score``; batch after batch of queries.

    ``asked`` has ``_q, _qv`` and the groups ``_gs`` that a query searches. The beam is ``ef`` wide on the lowest layer. The
    layers that walks don't need are left out, unless ``layers`` are asked for.
    """
    for batch in _batches(asked):
        yield from _batch_beams(index, nodes, tops, batch, ef, layers)


def _by_group(values: dict[str, int]):
    """The value of the row's group, -1 for others."""
    out = F.lit(-1)
    for name, value in values.items():
        out = F.when(F.col("_g") == name, F.lit(value)).otherwise(out)
    return out


def _batch_beams(index, nodes, tops, asked, ef, layers) -> Iterator[tuple[int, DataFrame]]:
    shared = _shared_queries(asked.drop("_gs"))
    enter = _by_group({g: e for g, (_, e) in tops.items()})
    degree = index.options.get("m", 32)
    every = asked.withColumn("_g", F.explode("_gs")).drop("_gs")

    def best(held: DataFrame) -> DataFrame:
        return nearest(
            every, held, degree, query_id="_q", query_vector="_qv", item_id="node", item_vector="_iv", on="_g", per_group=True,
        ).select("_q", "_g", "node", "score")

    entered = max(e for _, e in tops.values())
    if layers:
        # Whole layers from where a group is entered upwards are small.
        for level in range(max(t for t, _ in tops.values()), 0, -1):
            if any(e <= level <= t for t, e in tops.values()):
                yield level, best(nodes.filter((F.col("level") >= level) & (enter <= level)))
    beam = best(nodes.filter(F.col("level") >= enter))
    final = Window.partitionBy("_q", "_g").orderBy(F.desc("score"), F.asc("node"))
    # The last score of a full beam: nodes below it can't enter, so they needn't reach the window.
    full = final.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    vectors = nodes.select("node", "_iv")
    for level in range(max(0, entered - 1), -1, -1):
        width = ef if level == 0 else degree
        # Lists are dealt anew: they may lie in one partition, which alone would be expanded.
        links = checkpointed(
            index.edges.filter(F.col("level") == level).select(F.col("src").alias("node"), "links")
            .repartition(_partitions(index.edges), "node")
        )
        # A group that is entered on this layer or below it is not walked here, except on the ground.
        beam = checkpointed(
            beam.withColumns({"expanded": (enter <= level) & F.lit(level > 0), "_least": F.lit(None).cast("double")})
        )
        while waiting := beam.filter(~F.col("expanded")).count():
            frontier = _light(beam.filter(~F.col("expanded")), waiting, 64)
            reached = links.join(frontier, "node").select("_q", "_g", "_least", F.explode("links").alias("node"))
            # Most of what is reached scores too low, so only the rest is looked up in the beam.
            good = _scored(reached, vectors, shared, waiting * 2 * degree)
            seen = beam.select("_q", "_g", "node").toDF("_q", "_g", "node")
            fresh = good.join(seen, ["_q", "_g", "node"], "left_anti")
            grown = beam.drop("_least").withColumn("expanded", F.lit(True)).unionByName(fresh.withColumn("expanded", F.lit(False)))
            # A node outside the best can never come back, so it is forgotten.
            beam = checkpointed(
                grown.withColumn("_n", F.row_number().over(final)).filter(F.col("_n") <= width).drop("_n")
                .withColumn("_least", F.when(F.count("*").over(full) == width, F.min("score").over(full)))
            )
        beam = beam.drop("expanded", "_least")
        yield level, beam if level == 0 else beam.filter(enter > level)


def search_graph(
    index: VectorIndex, queries: DataFrame, k: int, *, query_id="query_id",
    query_vector="query_embedding", own: str | None = None,
) -> DataFrame:
    """Beam search of all queries at once; columns as in the exact join.

    Every group that the items hold is searched, or, with ``own``, each query's own.
    """
    if own is not None and own != index.options.get("group"):
        raise ValueError(f"the graph is not grouped by {own}")
    nodes = _nodes(index)
    tops = _tops(nodes)
    if not tops:
        return nearest(
            queries, index.items, k, query_id=query_id, query_vector=query_vector,
            item_id=index.item_id, item_vector=index.item_vector,
        )
    where = F.array(*(F.lit(name) for name in sorted(tops))) if own is None else F.array(_group(own))
    asked = checkpointed(
        queries.select(F.col(query_id).alias("_q"), F.col(query_vector).alias("_qv"), where.alias("_gs"))
    )
    walked = _beams(index, nodes, tops, asked, max(k, index.options.get("ef_search", 64)))
    # The lowest layer counts, of every batch.
    beam = reduce(DataFrame.unionByName, [beam for level, beam in walked if level == 0])
    overall = Window.partitionBy("_q").orderBy(F.desc("score"), F.asc("node"))
    best = beam.withColumn("_n", F.row_number().over(overall)).filter(F.col("_n") <= k)
    # Copies share their representative's score: the k smallest ids can matter.
    smallest = Window.partitionBy("node").orderBy("member")
    members = (
        index.items.select(F.col("rep").alias("node"), F.col(index.item_id).alias("member"))
        .join(best.select("node").distinct().toDF("node"), "node", "left_semi")
        .withColumn("_m", F.row_number().over(smallest)).filter(F.col("_m") <= k)
    )
    ranked = Window.partitionBy("_q").orderBy(F.desc("score"), F.asc("member"))
    return (
        best.join(members, "node")
        .withColumn("rank", F.row_number().over(ranked))
        .filter(F.col("rank") <= k)
        .select(F.col("_q").alias(query_id), F.col("member").alias(index.item_id), "score", "rank")
    )


def diverse(near: np.ndarray, score: np.ndarray, m: int) -> list[int]:
    """Places of at most m neighbours, the best first, by the relative-neighbourhood rule.

    A candidate nearer to a kept neighbour than to the node is put off: it is reached through
    that neighbour. Room that is left goes to the best of those put off.
    """
    alike = near @ near.T
    kept: list[int] = []
    put_off: list[int] = []
    for i in np.argsort(-score, kind="stable").tolist():
        if len(kept) == m:
            break
        (put_off if (alike[i, kept] > score[i]).any() else kept).append(i)
    return kept + put_off[: m - len(kept)]


def _diverse_links(pairs: DataFrame, vectors: DataFrame, m: int) -> DataFrame:
    """``level, src, dst, score`` of at most m diverse neighbours among the pairs ``level, src, dst`` of a bounded count a node."""
    held = pairs.join(vectors.toDF("dst", "_iv"), "dst").groupBy("level", "src").agg(
        F.array_sort(F.collect_list(F.struct("dst", "_iv"))).alias("_near")
    )
    # A node without its vector can't be placed.
    own = held.join(vectors.toDF("src", "_sv"), "src")

    def compute(batch):
        near = batch.column("_near")
        ends = near.offsets.to_numpy() - near.offsets[0].as_py()
        flat = unit_rows(to_matrix(near.flatten().field("_iv")))
        source = unit_rows(to_matrix(batch.column("_sv")))
        out = []
        for row, (a, b) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist())):
            score = np.rint(flat[a:b] @ source[row] * SCORE_SCALE) / SCORE_SCALE + 0.0
            out.append([{"at": i, "score": score[i]} for i in diverse(flat[a:b], score, m)])
        return pa.array(out, pa.list_(pa.struct([("at", pa.int32()), ("score", pa.float64())])))

    kind = T.ArrayType(T.StructType([T.StructField("at", T.IntegerType()), T.StructField("score", T.DoubleType())]))
    kept = with_arrow_column(own, T.StructField("_kept", kind), ("_near", "_sv"), compute)
    return kept.withColumn("_one", F.explode("_kept")).select(
        "level", "src", F.get("_near", F.col("_one.at"))["dst"].alias("dst"), F.col("_one.score").alias("score")
    )


def _with_stored_representative(index: VectorIndex, items: DataFrame) -> DataFrame:
    """Add ``rep``: the stored node of the same vector, else the smallest id of the batch with it."""
    group, keys = index.options.get("group"), ["_g", "_h1", "_h2"]
    new = checkpointed(with_representative(items, index.item_id, index.item_vector, group))
    asked = light(checkpointed(_keyed(new, index.item_vector, group).select(*keys).distinct()))
    nodes = _keyed(index.items.filter(F.col(index.item_id) == F.col("rep")), index.item_vector, group)
    known = nodes.join(asked, keys, "left_semi").select(*keys, F.col(index.item_id).alias("_old"))
    return _keyed(new, index.item_vector, group).join(known, keys, "left").select(
        *items.columns, F.coalesce("_old", "rep").alias("rep")
    )


def insert_items(index: VectorIndex, items: DataFrame, probes: int = BUILD_PROBES) -> tuple[DataFrame, DataFrame]:
    """Rows of *items* with ``level`` and ``rep``, and the adjacency lists that they change: ``level, src, links``.

    Every new node walks the graph of its own group for candidates and finds others in the batch by
    cells, as when a graph is built. It keeps at most m diverse ones on each layer. Nodes it links to get a link
    back; a list that outgrows 2m is thinned by the same rule. All other lists stay as they are. Stored vectors are
    read once for copies; no stored node is moved. An empty batch changes nothing.
    """
    m, group, item_id = index.options.get("m", 32), index.options.get("group"), index.item_id
    leveled = checkpointed(with_level(_with_stored_representative(index, items), item_id, m))
    own = leveled.filter(F.col(item_id) == F.col("rep")).select(
        item_id, index.item_vector, "level", _group(group).alias("_g")
    )
    stored = _nodes(index)
    tops = _tops(stored)
    counts = own.groupBy("_g", "level").count().collect()
    found = []
    if tops and counts:
        asked = checkpointed(
            own.select(F.col(item_id).alias("_q"), F.col(index.item_vector).alias("_qv"), F.array("_g").alias("_gs"))
        )
        levels = own.select(F.col(item_id).alias("_q"), F.col("level").alias("_top"))
        for level, beam in _beams(index, stored, tops, asked, index.options.get("ef_construction", 200), layers=True):
            found.append(
                beam.join(levels.filter(F.col("_top") >= level), "_q").select(
                    F.lit(level).alias("level"), F.col("_q").alias("src"), F.col("node").alias("dst"), "score"
                )
            )
    for level in range(max((r["level"] for r in counts), default=-1) + 1):
        rows: dict[str, int] = {}
        for r in counts:
            if r["level"] >= level:
                rows[r["_g"]] = rows.get(r["_g"], 0) + r["count"]
        layer = own.filter(F.col("level") >= level)
        near = _layer_links(layer, rows, item_id, index.item_vector, m, index.options.get("ef_construction", 200), probes)
        found.append(near.select(F.lit(level).alias("level"), "src", "dst", "score"))
    if not found:
        return leveled, index.edges.limit(0)
    pairs = found[0]
    for more in found[1:]:
        pairs = pairs.unionByName(more)
    vectors = stored.select("node", "_iv").unionByName(own.select(F.col(item_id).alias("node"), F.col(index.item_vector).alias("_iv")))
    best = Window.partitionBy("level", "src").orderBy(F.desc("score"), F.asc("dst"))
    close = pairs.withColumn("_n", F.row_number().over(best)).filter(F.col("_n") <= 4 * m)
    out = checkpointed(_diverse_links(close.select("level", "src", "dst"), vectors, m))
    back = out.select("level", F.col("dst").alias("src"), F.col("src").alias("dst"), "score")
    # Many new items may point at one node; Spark trims to m per task before the shuffle.
    back = back.withColumn("_n", F.row_number().over(best)).filter(F.col("_n") <= m)
    linked = checkpointed(out.select("level", "src", "dst").unionByName(back.select("level", "src", "dst")))
    touched = linked.select("level", "src").distinct()
    before = index.edges.join(light(checkpointed(touched)), ["level", "src"], "left_semi")
    lists = checkpointed(
        linked.unionByName(before.select("level", "src", F.explode("links").alias("dst")))
        .groupBy("level", "src").agg(F.collect_set("dst").alias("links"))
    )
    full = lists.filter(F.size("links") > 2 * m).select("level", "src", F.explode("links").alias("dst"))
    thinned = _diverse_links(full, vectors, 2 * m).groupBy("level", "src").agg(F.collect_set("dst").alias("links"))
    return leveled, checkpointed(lists.filter(F.size("links") <= 2 * m).unionByName(thinned))


def newest_links(parts: list[DataFrame]) -> DataFrame:
    """Adjacency lists of a graph and its insertions, the oldest first: the newest list of every node counts."""
    if len(parts) == 1:
        return parts[0]
    numbered = [part.select("level", "src", "links", F.lit(k).alias("_k")) for k, part in enumerate(parts)]
    union = numbered[0]
    for more in numbered[1:]:
        union = union.unionByName(more)
    return union.groupBy("level", "src").agg(F.max_by("links", "_k").alias("links"))
