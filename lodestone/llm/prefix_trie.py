"""Prefix trie of conversations: which sequences of turns are shared, and what sharing saves.

A turn is a 16-byte big-endian id, the MD5 of role and text (each with its length), so a conversation is a
byte string of fixed-width ids. Equal conversations fold into one with a count; the strings are then
dealt by range and sorted, so that a frequent first turn spreads over tasks. Each task builds adaptive
radix trees (``radix_tree``) over runs of at most ``UNIT_BYTES``, whatever the number of conversations,
and only byte depths that end a turn emit nodes. A node that lies on the path of a run's first or last string may
go on in the next run; these *edge* nodes, one path at each end of a run, are merged in order with a stack.

Nulls: null role or text counts as empty, a null turn comes first, rows without conversation id are ignored. Rows of
a conversation with equal turn are ordered by turn id, so repeated rows have no effect on each other's order. Texts and
conversations of any length work as long as a conversation's ids (20 bytes a turn) fit a row. An empty table has
no node, not even the root. Other columns are ignored.

The digest of a node's ends is a sequential hash over all conversations that end there, by its definition; their ids
alone are sorted and streamed for it, a node in one task with bounded memory.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.radix_tree import RadixTree
from lodestone.operators.lineage import light, shared_folder

ID_BYTES = 16
#: Bytes of ids in a tree; a longer conversation is a tree of its own.
UNIT_BYTES = 2 << 20
NO_ENDS = hashlib.sha256(b"").hexdigest()

MEASURES = "n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
EDGE = "conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, bytes long, ends_sha256 string"
UNIT = (
    "part int, unit int, conv_id long, depth long, parent_conv_id long, parent_edge int, " + MEASURES
    + f", first_key binary, last_key binary, shared int, edges array<struct<{EDGE.replace(' long', ': bigint').replace(' string', ': string')}>>"
)


def turn_id(role: Column, text: Column) -> Column:
    """32 hexadecimal digits of a turn."""
    sized = [F.concat(F.octet_length(c).cast("string"), F.lit(":"), c) for c in (role, text)]
    return F.md5(F.concat(*sized).cast("binary"))


def ordered_turns(turns: DataFrame) -> DataFrame:
    """conv_id and its turns (id, bytes of text) in order."""
    role, text = (F.coalesce(F.col(name), F.lit("")) for name in ("role", "text"))
    rows = turns.where("conv_id is not null").select(
        "conv_id", F.struct("turn", turn_id(role, text).alias("id"), F.octet_length(text).alias("bytes")).alias("row")
    )
    held = F.sort_array(F.collect_list("row"))
    return rows.groupBy("conv_id").agg(F.transform(held, lambda x: F.struct(x["id"].alias("id"), x["bytes"].alias("bytes"))).alias("turns"))


def keyed(conversations: DataFrame) -> DataFrame:
    """conv_id, key (its turn ids, joined) and bytes (of each turn's text), from conv_id and turns."""
    return conversations.select(
        "conv_id",
        F.unhex(F.array_join(F.col("turns.id"), "")).alias("key"),
        F.col("turns.bytes").alias("bytes"),
    )


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the joined ids of each run of equal names, over batches sorted by name and id."""
    now, digest = None, None
    for batch in batches:
        names, made = [], []
        for name, i in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if name != now:
                if now is not None:
                    names.append(now), made.append(digest.hexdigest())
                now, digest = name, hashlib.sha256(str(i).encode())
            else:
                digest.update(b",%d" % i)
        yield pa.record_batch({"name": pa.array(names, pa.string()), "ends_sha256": pa.array(made, pa.string())})
    if now is not None:
        yield pa.record_batch({"name": [now], "ends_sha256": [digest.hexdigest()]})


def folded(conversations: DataFrame) -> DataFrame:
    """Different keys with their number of conversations, smallest conversation and digest of all of them."""
    named = conversations.withColumn("name", F.md5("key"))
    ids = named.select("name", "conv_id").repartition("name").sortWithinPartitions("name", "conv_id")
    digests = ids.mapInArrow(_digests, "name string, ends_sha256 string")
    once = named.groupBy("name", "key").agg(
        F.count("*").alias("n"), F.min("conv_id").alias("conv_id"), F.first("bytes").alias("bytes")
    )
    return once.join(digests, "name").select("key", "n", "conv_id", "bytes", "ends_sha256")


class Turn:
    """A node of the trie: a turn-aligned depth of the radix tree."""

    __slots__ = ("depth", "conv_id", "n", "children", "leaves", "saved", "bytes", "ends", "parent", "edge")

    def __init__(self, depth, conv_id, n, leaves, saved, size, ends):
        self.depth, self.conv_id, self.n, self.leaves, self.saved, self.bytes, self.ends = depth, conv_id, n, leaves, saved, size, ends
        self.children, self.parent, self.edge = 0, None, None


def trie_nodes(rows: list[tuple]) -> tuple[Turn, Turn | None, Turn | None, list[Turn]]:
    """Root, the nodes at which the first and the last key end, and all nodes. rows: (key, n, conv_id, bytes, ends), sorted."""
    tree = RadixTree()
    tree.insert(b"", None)
    for at, row in enumerate(rows):
        tree.insert(row[0], at)
    nodes: list[Turn] = []
    ending: dict[int, Turn] = {}
    # Each frame: node, byte depths above and at its end, children to come, sum of those done.
    done = None
    stack = [[tree.root, 0, 0, tree.root.items(), [0, None, 0, 0, [], None]]]
    while stack:
        node, above, end, children, total = stack[-1]
        if done is not None:
            n, conv_id, leaves, saved, heads, sample = done
            total[0] += n
            total[1] = conv_id if total[1] is None else min(total[1], conv_id)
            total[2] += leaves
            total[3] += saved
            total[4].extend(heads)
            total[5] = sample if total[5] is None else total[5]
            done = None
        below = next(children, None)
        if below is not None:
            child = below[1]
            stack.append([child, end, end + 1 + len(child.path), child.items(), [0, None, 0, 0, [], None]])
            continue
        stack.pop()
        n, conv_id, leaves, saved, heads, sample = total
        ends = NO_ENDS
        if node.value is not None:
            _, own, first, _, ends = rows[node.value]
            n += own
            conv_id = first if conv_id is None else min(conv_id, first)
            sample = node.value if sample is None else sample
        lowest = -1 if node is tree.root else above // ID_BYTES
        for depth in range(end // ID_BYTES, lowest, -1):
            if depth * ID_BYTES != end:
                here = NO_ENDS
            else:
                here = ends
            size = rows[sample][3][depth - 1] if depth else 0
            saved += (n - 1) * size
            turn = Turn(depth, conv_id, n, leaves if heads else 1, saved, size, here)
            for head in heads:
                head.parent = turn
            turn.children, leaves, heads = len(heads), turn.leaves, [turn]
            nodes.append(turn)
            if node.value is not None and depth * ID_BYTES == end:
                ending[node.value] = turn
        done = (n, conv_id, leaves, saved, heads, sample)
    return nodes[-1], ending[0], ending[len(rows) - 1], nodes


def _path(turn: Turn) -> list[Turn]:
    """From the root to a node."""
    path = []
    while turn is not None:
        path.append(turn)
        turn = turn.parent
    return path[::-1]


def _edge(turn: Turn) -> dict:
    return {"conv_id": turn.conv_id, "n_convs": turn.n, "n_children": turn.children, "n_leaves": turn.leaves,
            "saved_tokens": turn.saved, "bytes": turn.bytes, "ends_sha256": turn.ends}


def _unit_rows(part: int, unit: int, rows: list[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """All nodes of a run but its edges, which go into one row of their own."""
    _, first, last, nodes = trie_nodes(rows)
    left, right = _path(first), _path(last)
    shared = sum(a is b for a, b in zip(left, right)) - 1
    edges = left + right[shared + 1 :]
    for number, turn in enumerate(edges):
        turn.edge = number
    # What hangs below an edge by other edges is counted when these are merged; children first.
    for turn in sorted(edges, key=lambda t: t.depth):
        turn.leaves, turn.saved, turn.children = 0, 0, 0
    plain = []
    for turn in nodes:
        if turn.edge is None:
            plain.append(turn)
            if turn.parent.edge is not None:
                turn.parent.children += 1
                turn.parent.leaves += turn.leaves
                turn.parent.saved += turn.saved
    for at in range(0, len(plain), 8_192):
        some = plain[at : at + 8_192]
        columns = {
            "part": [part] * len(some), "unit": [unit] * len(some), "conv_id": [t.conv_id for t in some],
            "depth": [t.depth for t in some],
            "parent_conv_id": [t.parent.conv_id if t.parent.edge is None else None for t in some],
            "parent_edge": [t.parent.edge for t in some], "n_convs": [t.n for t in some],
            "n_children": [t.children for t in some], "n_leaves": [t.leaves for t in some],
            "saved_tokens": [t.saved for t in some], "ends_sha256": [t.ends for t in some],
        }
        none = dict.fromkeys(("first_key", "last_key", "shared", "edges"), [None] * len(some))
        yield pa.RecordBatch.from_pydict(columns | none, schema=schema)
    row = dict.fromkeys(schema.names, None) | {
        "part": part, "unit": unit, "first_key": rows[0][0], "last_key": rows[-1][0], "shared": shared,
        "edges": [_edge(t) for t in edges],
    }
    yield pa.RecordBatch.from_pylist([row], schema=schema)


def _units(schema: pa.Schema):
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, unit, rows, size = TaskContext.get().partitionId(), 0, [], 0
        for batch in batches:
            for row in zip(*(column.to_pylist() for column in batch.columns)):
                if rows and size + len(row[0]) > UNIT_BYTES:
                    yield from _unit_rows(part, unit, rows, schema)
                    unit, rows, size = unit + 1, [], 0
                rows.append(row)
                size += len(row[0])
        if rows:
            yield from _unit_rows(part, unit, rows, schema)

    return build


class _Open:
    """An edge node that later runs may continue."""

    __slots__ = ("id", "depth", "conv_id", "n", "children", "leaves", "saved", "bytes", "ends", "places")

    def __init__(self, turn: bytes, depth: int, edge: dict):
        self.id, self.depth, self.bytes, self.ends, self.places = turn, depth, edge["bytes"], edge["ends_sha256"], []
        self.conv_id, self.n, self.children, self.leaves, self.saved = edge["conv_id"], 0, 0, 0, 0

    def add(self, edge: dict, place: tuple) -> None:
        self.conv_id = min(self.conv_id, edge["conv_id"])
        self.n += edge["n_convs"]
        self.children += edge["n_children"]
        self.leaves += edge["n_leaves"]
        self.saved += edge["saved_tokens"]
        if edge["ends_sha256"] != NO_ENDS:
            self.ends = edge["ends_sha256"]
        self.places.append(place)


MERGED = "part int, unit int, edge int, own boolean, conv_id long, depth long, parent_edge int, " + MEASURES


def _merge(schema: pa.Schema):
    def closed(node: _Open, above: _Open | None) -> list[tuple]:
        leaves = node.leaves or 1
        saved = node.saved + (node.n - 1) * node.bytes
        if above is not None:
            above.children += 1
            above.leaves += leaves
            above.saved += saved
        return [
            (part, unit, edge, at == 0, node.conv_id, node.depth, parent, node.n, node.children, leaves, saved, node.ends)
            for at, (part, unit, edge, parent) in enumerate(node.places)
        ]

    def table(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows)) or [()] * len(schema)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stack: list[_Open] = []
        made: list[tuple] = []

        def close(depth: int) -> None:
            while len(stack) > depth + 1:
                node = stack.pop()
                made.extend(closed(node, stack[-1] if stack else None))

        for batch in batches:
            for row in batch.to_pylist():
                part, unit, shared, edges = row["part"], row["unit"], row["shared"], row["edges"]
                keys = [
                    [key[i : i + ID_BYTES] for i in range(0, len(key), ID_BYTES)] for key in (row["first_key"], row["last_key"])
                ]
                first, last = keys
                # Nodes of the first path that earlier runs have opened go on; deeper ones end.
                depth = 0
                while depth < len(first) and depth + 1 < len(stack) and stack[depth + 1].id == first[depth]:
                    depth += 1
                if stack:
                    close(depth)
                for d in range(len(first) + 1):
                    if d >= len(stack):
                        stack.append(_Open(first[d - 1] if d else b"", d, edges[d]))
                    stack[d].add(edges[d], (part, unit, d, d - 1 if d else None))
                if shared < len(first):
                    close(shared)
                for d in range(shared + 1, len(last) + 1):
                    number = len(first) + d - shared
                    stack.append(_Open(last[d - 1], d, edges[number]))
                    stack[d].add(edges[number], (part, unit, number, number - 1 if d > shared + 1 else shared))
                if len(made) > 8_192:
                    yield table(made)
                    made.clear()
        while stack:
            node = stack.pop()
            made.extend(closed(node, stack[-1] if stack else None))
        yield table(made)

    return merge


def _schema(spark, ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """One row for each node of the trie over ``conversations`` (conv_id, key, bytes, as ``keyed`` gives them).

    Columns: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens
    (sum over the subtree of (n_convs - 1) times bytes of the last text), ends_sha256.
    """
    spark = conversations.sparkSession
    folder = f"{shared_folder(spark)}/prefix-trie-{uuid.uuid4().hex}"
    conversations.write.parquet(f"{folder}/conversations")
    once = folded(spark.read.parquet(f"{folder}/conversations"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # Sampled bounds may differ from run to run, so what follows from them is written once.
    ranged = once.repartitionByRange(parts, "key").sortWithinPartitions("key")
    ranged.mapInArrow(_units(_schema(spark, UNIT)), UNIT).write.parquet(f"{folder}/units")
    units = spark.read.parquet(f"{folder}/units")
    edges = units.where("edges is not null").select("part", "unit", "first_key", "last_key", "shared", "edges")
    # One row a run, and only its two outermost paths.
    edges.coalesce(1).sortWithinPartitions("part", "unit").mapInArrow(
        _merge(_schema(spark, MERGED)), MERGED
    ).write.parquet(f"{folder}/edges")
    merged = spark.read.parquet(f"{folder}/edges")
    measures = ["n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    nodes = units.where("edges is null")
    inner = nodes.where("parent_edge is null").select("conv_id", "depth", "parent_conv_id", *measures)
    below = nodes.where("parent_edge is not null").select("part", "unit", "parent_edge", "conv_id", "depth", *measures)
    below = below.unionByName(
        merged.where("own and parent_edge is not null").select("part", "unit", "parent_edge", "conv_id", "depth", *measures)
    )
    parents = merged.select("part", "unit", F.col("edge").alias("parent_edge"), F.col("conv_id").alias("parent_conv_id"))
    below = below.join(light(parents), ["part", "unit", "parent_edge"])
    root = merged.where("own and parent_edge is null").withColumn("parent_conv_id", F.lit(None).cast("bigint"))
    columns = ["conv_id", "depth", "parent_conv_id", *measures]
    return inner.unionByName(below.select(*columns)).unionByName(root.select(*columns))
