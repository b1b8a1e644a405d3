"""Top-k vector join: for each query vector, the k best item vectors.

Scores are inner products in double precision, rounded to six decimals; equal
scores are ordered by ascending item id, so results do not depend on how the
items are partitioned.

Two physical strategies share one kernel:

* few queries: the query matrix is broadcast and every item partition keeps a
  running top-k, so the items are never shuffled;
* many queries: both sides are cut into blocks of bounded size per group and
  each block pair is scored by one task. Block counts come from group sizes, so
  a group holding most of the rows is spread over many tasks.

Neither emits more than k rows per query and task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.functions.vectors import to_matrix, unit_rows
from lodestone.operators.lineage import checkpointed

SCORE_SCALE = 1_000_000
BROADCAST_QUERY_ROWS = 16_384
BROADCAST_QUERY_BYTES = 128 << 20
PRUNED_GROUPS = 1_000
MERGE_ABOVE = 4
BROADCAST_GROUPS = 65_536
QUERY_BLOCK_ROWS = 65_536
ITEM_BLOCK_ROWS = 131_072
MIN_ITEM_BLOCK_ROWS = 2_048
#: Rows that a task returns at most, for all queries of its block.
RESULT_ROWS = 2 << 20
BLOCK_BYTES = 128 << 20
#: Entries of a query stripe are trimmed above so many times its results.
TRIM_ABOVE = 3
#: Columns that the grid adds beside those of the caller, who names query and item columns freely.
_QUERY_COUNT, _ITEM_COUNT = "__grid_queries", "__grid_items"
_QUERY_BLOCK, _ITEM_BLOCK = "__grid_query_block", "__grid_item_block"
_QUERY_STRIPE = 256
_ITEM_STRIPE = 1024
#: Items in single precision that queries meet in turn.
RUN_BYTES = 16 << 20
#: Single pairs whose vectors are gathered at once.
_PAIR_STRIPE = 512
_RANK_BITS = 24

Decoder = Callable[[pa.Table], np.ndarray]


def _pair_products(left: np.ndarray, right: np.ndarray, rows: np.ndarray, at: np.ndarray) -> np.ndarray:
    made = np.empty(len(rows))
    for start in range(0, len(rows), _PAIR_STRIPE):
        some = slice(start, start + _PAIR_STRIPE)
        np.einsum("ij,ij->i", left[rows[some]], right[at[some]], out=made[some])
    return made


class Products:
    """Scores of a stripe of query vectors against a stripe of items: inner products of vectors."""

    def prepare(self, queries: np.ndarray) -> np.ndarray:
        return queries

    def scores(self, prepared: np.ndarray, items: np.ndarray) -> np.ndarray:
        return prepared @ items.T

    def pairs(self, prepared: np.ndarray, items: np.ndarray, rows: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Scores of the pairs of query ``rows[i]`` and item ``at[i]`` alone."""
        return _pair_products(prepared, items, rows, at)

    def vectors(self, items: np.ndarray) -> np.ndarray:
        """Vectors whose products with query vectors are the scores, in single precision."""
        return items.astype(np.float32)

    def item_bytes(self, dimension: int) -> int:
        """Memory of an item of a block, without its id."""
        return 8 * dimension


def _slack(queries: np.ndarray, items: np.ndarray) -> float:
    """How far a product in single precision can be from that in double precision; 0 for small whole numbers, else a
    bound by the lengths of the vectors: each entry is rounded once, and so is each partial sum."""
    if not len(items):
        return 0.0
    length = [float(np.sqrt(np.einsum("ij,ij->i", m, m, dtype=np.float64).max())) for m in (queries, items)]
    most = length[0] * length[1]
    if most < 1 << 23 and all((m == np.rint(m)).all() for m in (queries, items)):
        return 0.0
    return 1.01 * (queries.shape[1] + 4) * 2.0**-24 * most + 1e-12


def _ids(column) -> np.ndarray:
    return np.asarray(column.to_numpy(zero_copy_only=False))


def _places(mask: np.ndarray) -> np.ndarray:
    """Flat positions of the few true entries; eight are looked at together."""
    flat = mask.ravel()
    whole = len(flat) & ~7
    some = np.flatnonzero(flat[:whole].view(np.uint64))
    which, bit = np.nonzero(flat[:whole].reshape(-1, 8)[some])
    rest = np.flatnonzero(flat[whole:]) + whole
    return np.concatenate([some[which] * 8 + bit, rest])


class _Best:
    """The k best items of every query of a stripe; items come in ascending order of their ids.

    An entry is one integer that orders by score, then by position (= ascending id). Once every query has k,
    only items above its floor are taken up, and the floors rise whenever the entries are trimmed.
    """

    def __init__(self, queries: int, k: int) -> None:
        self.queries, self.k = queries, k
        self.rows, self.keys = np.empty(0, np.int64), np.empty(0, np.int64)
        self.waiting: list[tuple[np.ndarray, np.ndarray]] = []
        self.held, self.floor = 0, None

    def add(self, raw: np.ndarray, first: int) -> None:
        """Scores of all queries and the items from position ``first`` on; the matrix is changed."""
        raw *= SCORE_SCALE
        keep = min(self.k, raw.shape[1])
        rows = None if self.floor is None else np.flatnonzero(raw > self.floor[:, None])
        if rows is None or len(rows) > 4 * keep * self.queries:
            ranked = np.rint(raw).astype(np.int64) << _RANK_BITS
            ranked -= np.arange(first, first + raw.shape[1])
            if keep < raw.shape[1]:
                ranked = np.partition(ranked, raw.shape[1] - keep, axis=1)[:, raw.shape[1] - keep :]
            rows, keys = np.repeat(np.arange(self.queries), keep), ranked.ravel()
        else:
            rows, at = np.divmod(rows, raw.shape[1])
            keys = (np.rint(raw[rows, at]).astype(np.int64) << _RANK_BITS) - (at + first)
        self._wait(rows, keys)

    def take(self, rows: np.ndarray, at: np.ndarray, scores: np.ndarray) -> None:
        """Scores of single pairs of a query and the item at a position; those below the floor change nothing."""
        scores = scores * SCORE_SCALE
        above = scores > self.floor[rows]
        self._wait(rows[above], (np.rint(scores[above]).astype(np.int64) << _RANK_BITS) - at[above])

    def least(self, slack: float) -> np.ndarray:
        """What a product in single precision, at most ``slack`` off, exceeds wherever the score is above the floor."""
        bound = self.floor / SCORE_SCALE - slack
        near = bound.astype(np.float32)
        return np.where(near > bound, np.nextafter(near, np.float32(-np.inf)), near)

    def _wait(self, rows: np.ndarray, keys: np.ndarray) -> None:
        self.waiting.append((rows, keys))
        self.held += len(rows)
        if self.floor is None or self.held > TRIM_ABOVE * self.k * self.queries:
            self.trim()

    def trim(self) -> None:
        rows = np.concatenate([self.rows, *(r for r, _ in self.waiting)])
        keys = np.concatenate([self.keys, *(x for _, x in self.waiting)])
        order = np.argsort(-keys)
        order = order[np.argsort(rows[order].astype(np.uint16), kind="stable")]
        rows, keys = rows[order], keys[order]
        count = np.bincount(rows, minlength=self.queries)
        place = np.arange(len(rows)) - np.repeat(np.cumsum(count) - count, count)
        kept = place < self.k
        self.rows, self.keys, self.waiting = rows[kept], keys[kept], []
        last = self.keys[place[kept] == self.k - 1]
        self.held = len(self.rows)
        if len(last) == self.queries:
            self.floor = self.scores(last) + 0.25

    @staticmethod
    def scores(keys: np.ndarray) -> np.ndarray:
        return -(-keys >> _RANK_BITS)

    def result(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Query, rounded score and item position of the best, by query, the best first."""
        self.trim()
        score = self.scores(self.keys)
        return self.rows, score, (score << _RANK_BITS) - self.keys


def _block_top(items, item_ids, queries, query_rows, k, scorer=Products()) -> pd.DataFrame:
    """Best k items of one block for each query; ties go to the smaller id.

    Stripes keep the score matrix inside the processor cache. The first item
    stripe sets a floor per query; later stripes, which hold larger ids, only
    contribute items that score above it. Products in single precision, made into one buffer, tell
    which may; these alone are scored in double precision. No stripe of queries holds more than a few times its results,
    and only a run of items exists in single precision at a time.
    """
    order = np.argsort(item_ids, kind="stable")
    if (order[1:] < order[:-1]).any():
        item_ids, items = item_ids[order], items[order]
    del order
    asked = queries.astype(np.float32)
    starts = range(0, len(queries), _QUERY_STRIPE)
    best = [_Best(min(_QUERY_STRIPE, len(queries) - start), k) for start in starts]
    run = max(1, RUN_BYTES // (4 * _ITEM_STRIPE * max(1, queries.shape[1]))) * _ITEM_STRIPE
    for start in range(0, len(items) if len(queries) else 0, run):
        part = items[start : start + run]
        near = scorer.vectors(part) if len(items) > _ITEM_STRIPE else None
        slack = _slack(asked, near) if near is not None else np.inf
        for q_at, held in zip(starts, best):
            _scan(held, scorer.prepare(queries[q_at : q_at + _QUERY_STRIPE]), asked[q_at : q_at + _QUERY_STRIPE], part, near, slack, start, scorer)
    found = []
    for q_at, held in zip(starts, best):
        rows, score, at = held.result()
        found.append((query_rows[rows + q_at], score, item_ids[at]))
    if not found:
        return pd.DataFrame()
    row, score, item = (np.concatenate(column) for column in zip(*found))
    return pd.DataFrame({"row": row, "score": score, "item": item})


def _scan(best: _Best, prepared, asked: np.ndarray, items, near: np.ndarray | None, slack: float, first: int, scorer) -> None:
    """Let a stripe of queries meet a run of items, whose positions begin with ``first``."""
    room = np.empty(len(asked) * _ITEM_STRIPE, np.float32)
    for at_item in range(0, len(items), _ITEM_STRIPE):
        part = items[at_item : at_item + _ITEM_STRIPE]
        if near is not None and best.floor is not None and np.isfinite(slack):
            made = room[: len(asked) * len(part)].reshape(len(asked), len(part))
            np.matmul(asked, near[at_item : at_item + _ITEM_STRIPE].T, out=made)
            hits = _places(made > best.least(slack)[:, None])
            if len(hits) <= 4 * min(best.k, len(part)) * len(asked):
                rows, at = np.divmod(hits, len(part))
                # Without slack the products are the scores.
                scores = scorer.pairs(prepared, part, rows, at) if slack else made.ravel()[hits].astype(np.float64)
                best.take(rows, at + (first + at_item), scores)
                continue
        best.add(scorer.scores(prepared, part), first + at_item)
    best.trim()


def _trim(found: pd.DataFrame, k: int) -> pd.DataFrame:
    """First k rows per query in (score descending, id ascending) order."""
    ordered = found.sort_values(["row", "score", "item"], ascending=[True, False, True])
    return ordered[ordered.groupby("row", sort=False).cumcount() < k]


def _emit(found: pd.DataFrame, query_ids, groups, names, types) -> pa.RecordBatch:
    rows = found["row"].to_numpy() if len(found) else np.empty(0, dtype=np.int64)
    scores = found["score"].to_numpy() if len(found) else np.empty(0, dtype=np.int64)
    items = found["item"] if len(found) else []
    columns = [
        pa.array(query_ids[rows], type=types[0]),
        pa.array(items, type=types[1]),
        pa.array(scores / SCORE_SCALE, type=pa.float64()),
    ]
    if groups is not None:
        columns.append(pa.array(groups[rows], type=types[3]))
    return pa.RecordBatch.from_arrays(columns, names=names)


def _arrow_types(fields) -> list:
    from pyspark.sql.pandas.types import to_arrow_type

    return [to_arrow_type(f.dataType) for f in fields]


def nearest(
    queries: DataFrame,
    items: DataFrame,
    k: int,
    *,
    query_id: str = "query_id",
    query_vector: str = "query_embedding",
    item_id: str = "chunk_id",
    item_vector: str = "embedding",
    on: str | None = None,
    per_group: bool = False,
    decode: Decoder | None = None,
    decode_from: tuple[str, ...] = (),
    scorer: Products = Products(),
    normalize: bool = True,
    exclude_self: bool = False,
    strategy: str = "auto",
) -> DataFrame:
    """Columns ``query_id, item_id, score[, on], rank`` with at most k rows per query.

    ``on`` restricts each query row to items of the same group; a query may
    appear once per group it visits, or once with an array of the groups that it
    visits, and then the group is no column of the result. ``per_group`` ranks within (query, group)
    rather than over all groups of a query. ``decode`` turns a batch of items
    into vectors when they are stored compressed in the ``decode_from`` columns, or
    into any matrix of a row an item that ``scorer`` compares with query vectors.
    ``exclude_self`` drops the item whose id equals the query id.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    group = [on] if on else []
    visits = on is not None and isinstance(queries.schema[on].dataType, T.ArrayType)
    if visits and per_group:
        raise ValueError("ranking by group needs one row for each visit")
    fields = [
        T.StructField(query_id, queries.schema[query_id].dataType),
        T.StructField(item_id, items.schema[item_id].dataType),
        T.StructField("score", T.DoubleType()),
    ] + [T.StructField(c, items.schema[c].dataType) for c in group if not visits]
    schema = T.StructType(fields)
    names, types = [f.name for f in fields], _arrow_types(fields)
    # One spare row per query makes room for the query itself.
    width = k + 1 if exclude_self else k

    def item_matrix(table) -> np.ndarray:
        if decode is not None:
            return decode(table)
        matrix = to_matrix(table.column(item_vector))
        return unit_rows(matrix) if normalize else matrix

    def query_matrix(table) -> np.ndarray:
        matrix = to_matrix(table.column(query_vector))
        return unit_rows(matrix) if normalize else matrix

    # Fresh column ids: queries and items are often two views of one table.
    narrow = queries.select(query_id, *group, query_vector).toDF(query_id, *group, query_vector)
    stored = decode_from if decode is not None else (item_vector,)
    items = items.select(*dict.fromkeys([item_id, *group, *stored]))
    bounded = None
    if strategy in ("auto", "broadcast"):
        head = narrow.limit(BROADCAST_QUERY_ROWS + 1).toArrow()
        if head.num_rows <= BROADCAST_QUERY_ROWS and head.nbytes <= BROADCAST_QUERY_BYTES:
            bounded = head
        elif strategy == "broadcast":
            raise ValueError("too many queries to broadcast")

    if bounded is not None:
        if on:
            # The visited groups are known: let the scan skip the others.
            lists = bounded.column(on).combine_chunks()
            visited = (lists.flatten() if visits else lists).unique().to_pylist()
            if len(visited) <= PRUNED_GROUPS:
                items = items.filter(F.col(on).isin(visited))
        shared = queries.sparkSession.sparkContext.broadcast(
            (
                query_matrix(bounded),
                _ids(bounded.column(query_id)),
                None if not on else _ids(bounded.column(on)) if not visits else (
                    lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), _ids(lists.flatten())
                ),
            )
        )

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            matrix, ids, groups = shared.value
            if not len(ids):
                return
            every = np.arange(len(ids))
            by_group = None
            if visits:
                rows = np.repeat(every, groups[0])
                by_group = {value: rows[at] for value, at in pd.Series(rows).groupby(groups[1]).indices.items()}
                groups = None
            elif on:
                by_group = pd.Series(every).groupby(groups).indices
            kept: list[pd.DataFrame] = []
            held = 0
            for batch in batches:
                if not batch.num_rows:
                    continue
                table = pa.Table.from_batches([batch])
                vectors, item_ids = item_matrix(table), _ids(table.column(item_id))
                parts = []
                if on:
                    present = pd.Series(np.arange(len(item_ids))).groupby(_ids(table.column(on)))
                    for value, at in present.indices.items():
                        rows = by_group.get(value)
                        if rows is not None:
                            parts.append(
                                _block_top(vectors[at], item_ids[at], matrix[rows], rows, width, scorer)
                            )
                else:
                    parts.append(_block_top(vectors, item_ids, matrix, every, width, scorer))
                kept += parts
                held += sum(map(len, parts))
                # Sort only when the buffer holds some full results for every query.
                if held > MERGE_ABOVE * width * len(ids):
                    kept = [_trim(pd.concat(kept, ignore_index=True), width)]
                    held = len(kept[0])
            if held:
                yield _emit(_trim(pd.concat(kept, ignore_index=True), width), ids, groups, names, types)

        candidates = items.mapInArrow(scan, schema)
    else:
        # Read several times below; embedding the queries again would cost more.
        narrow = checkpointed(narrow.withColumn(on, F.explode(on)) if visits else narrow)
        candidates = _blocked(
            narrow, items, group, query_id, item_id, schema, names, types,
            query_matrix, item_matrix, width, query_vector, scorer,
        )

    if exclude_self:
        candidates = candidates.filter(F.col(query_id) != F.col(item_id))
    ranking = Window.partitionBy(query_id, *(group if per_group else [])).orderBy(
        F.desc("score"), F.asc(item_id)
    )
    return candidates.withColumn("rank", F.row_number().over(ranking)).filter(F.col("rank") <= k)


def _blocked(
    queries, items, group, query_id, item_id, schema, names, types,
    query_matrix, item_matrix, width, query_vector, scorer,
) -> DataFrame:
    """Score a grid of (query block, item block) pairs per group.

    Items are cut as little as memory allows, because every further item block gives each query k more
    candidates; more tasks come from smaller query blocks, which only copy items.
    """
    first = queries.select(F.size(query_vector)).first()
    per_block = max(1_024, BLOCK_BYTES // (8 * max(1, first[0] if first else 1)))
    query_rows = min(QUERY_BLOCK_ROWS, per_block, max(_QUERY_STRIPE, RESULT_ROWS // width))
    # Codes take a small part of the memory of vectors, so more of them make a block.
    dimension = max(1, first[0] if first else 1)
    item_bytes = scorer.item_bytes(dimension)
    item_rows = min(ITEM_BLOCK_ROWS * max(1, 8 * dimension // (item_bytes + 16)), max(1_024, BLOCK_BYTES // item_bytes))
    cores = queries.sparkSession.sparkContext.defaultParallelism
    if group:
        queries = queries.filter(F.col(group[0]).isNotNull())
        items = items.filter(F.col(group[0]).isNotNull())
        sizes = queries.groupBy(*group).agg(F.count("*").alias(_QUERY_COUNT)).join(
            items.groupBy(*group).agg(F.count("*").alias(_ITEM_COUNT)), group, "inner"
        )
        # One row per group: broadcast it only after checking how many there are.
        known = sizes.limit(BROADCAST_GROUPS + 1).toArrow()
        if known.num_rows <= BROADCAST_GROUPS:
            sizes = F.broadcast(queries.sparkSession.createDataFrame(known, sizes.schema))
            asked, held = (known.column(c).to_pylist() for c in (_QUERY_COUNT, _ITEM_COUNT))
        else:
            asked, held = [QUERY_BLOCK_ROWS] * cores, [ITEM_BLOCK_ROWS] * cores
        # toDF gives each use its own column ids, so the sides stay unambiguous.
        left, right = (f.join(sizes.toDF(*sizes.columns), group) for f in (queries, items))
    else:
        asked, held = [queries.count()], [items.count()]
        counts = {_QUERY_COUNT: F.lit(asked[0]), _ITEM_COUNT: F.lit(held[0])}
        left, right = queries.withColumns(counts), items.withColumns(counts)
    # A few tasks per core even out hashing; items are cut for them only where queries are too few.
    tasks, finest = 3 * cores, sum(-(-q // _QUERY_STRIPE) for q in asked)
    if finest < tasks:
        item_rows = min(item_rows, max(MIN_ITEM_BLOCK_ROWS, sum(held) * finest // tasks))
    scans = sum(q * max(1, -(-i // item_rows)) for q, i in zip(asked, held))
    query_rows = min(query_rows, max(_QUERY_STRIPE, scans // tasks))

    def blocks(frame):
        def count(rows, limit):
            return F.greatest(F.lit(1), F.ceil(F.col(rows) / limit)).cast("int")

        return frame.withColumns({_QUERY_COUNT: count(_QUERY_COUNT, query_rows), _ITEM_COUNT: count(_ITEM_COUNT, item_rows)})

    left, right = blocks(left), blocks(right)

    def own(id_column, count):
        return F.pmod(F.xxhash64(id_column), F.col(count)).cast("int")

    def every(count):
        return F.explode(F.sequence(F.lit(0), F.col(count) - 1))

    left = left.withColumn(_QUERY_BLOCK, own(query_id, _QUERY_COUNT)).withColumn(_ITEM_BLOCK, every(_ITEM_COUNT))
    right = right.withColumn(_ITEM_BLOCK, own(item_id, _ITEM_COUNT)).withColumn(_QUERY_BLOCK, every(_QUERY_COUNT))
    keys = [*group, _QUERY_BLOCK, _ITEM_BLOCK]

    def score(key, left_rows: pa.Table, right_rows: pa.Table) -> pa.Table:
        ids = _ids(left_rows.column(query_id))
        groups = _ids(left_rows.column(group[0])) if group and len(names) == 4 else None
        found = pd.DataFrame()
        if len(ids) and right_rows.num_rows:
            found = _block_top(
                item_matrix(right_rows), _ids(right_rows.column(item_id)),
                query_matrix(left_rows), np.arange(len(ids)), width, scorer,
            )
        return pa.Table.from_batches([_emit(found, ids, groups, names, types)])

    return (
        left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(score, schema)
    )


def rescored(
    found: DataFrame, queries: DataFrame, items: DataFrame, k: int, candidates: int, *, query_id, query_vector, item_id, item_vector,
) -> DataFrame:
    """The k best of the candidates ``query_id, item_id`` of each query by exact scores, with their ranks.

    Candidates are dealt to (query block, item block) pairs, where the vectors of both sides meet them: a vector travels
    once for each block of the other side, not for every candidate.
    """
    fields = [
        T.StructField(query_id, found.schema[query_id].dataType), T.StructField(item_id, found.schema[item_id].dataType),
        T.StructField("score", T.DoubleType()),
    ]
    names = [f.name for f in fields]
    asked, held = queries.count(), items.count()
    size = items.select(F.size(item_vector)).first()
    per_block = max(1_024, BLOCK_BYTES // (8 * max(1, size[0] if size else 1)))
    query_rows = min(QUERY_BLOCK_ROWS, per_block, max(_QUERY_STRIPE, 2 * RESULT_ROWS // candidates))
    tasks = 3 * queries.sparkSession.sparkContext.defaultParallelism
    query_blocks = max(1, -(-asked // query_rows), min(tasks, asked // _QUERY_STRIPE))
    item_blocks = max(1, -(-held // min(ITEM_BLOCK_ROWS, per_block)))

    def block(column, count):
        return F.pmod(F.xxhash64(column), F.lit(count)).cast("int")

    def every(count):
        return F.explode(F.sequence(F.lit(0), F.lit(count - 1)))

    pairs = found.select(query_id, item_id).dropna().withColumns(
        {_QUERY_BLOCK: block(query_id, query_blocks), _ITEM_BLOCK: block(item_id, item_blocks)}
    )
    # Both sides' vectors in one frame; an id of the other side is null.
    left = queries.select(
        F.col(query_id).alias(query_id), F.lit(None).cast(fields[1].dataType).alias(item_id), F.col(query_vector).cast("array<double>").alias("_v"),
        block(query_id, query_blocks).alias(_QUERY_BLOCK), every(item_blocks).alias(_ITEM_BLOCK),
    ).filter(F.col(query_id).isNotNull())
    right = items.select(
        F.lit(None).cast(fields[0].dataType).alias(query_id), F.col(item_id).alias(item_id), F.col(item_vector).cast("array<double>").alias("_v"),
        every(query_blocks).alias(_QUERY_BLOCK), block(item_id, item_blocks).alias(_ITEM_BLOCK),
    ).filter(F.col(item_id).isNotNull())
    types = _arrow_types(fields)

    def score(key, wanted: pa.Table, vectors: pa.Table) -> pa.Table:
        best = pd.DataFrame(columns=names)
        if wanted.num_rows and vectors.num_rows:
            matrix = unit_rows(to_matrix(vectors.column("_v")))
            at = wanted.select(names[:2]).to_pandas().drop_duplicates()
            for name in names[:2]:
                ids = vectors.column(name)
                own = np.flatnonzero(ids.is_valid().to_numpy())
                at = at.merge(pd.DataFrame({name: ids.drop_null().to_pandas().to_numpy(), f"_at_{name}": own}), on=name)
            rows, columns = (at[f"_at_{name}"].to_numpy() for name in names[:2])
            scores = np.rint(_pair_products(matrix, matrix, rows, columns) * SCORE_SCALE) / SCORE_SCALE + 0.0
            at = at.assign(score=scores).sort_values([names[0], "score", names[1]], ascending=[True, False, True])
            best = at[at.groupby(names[0], sort=False).cumcount() < k]
        return pa.table([pa.array(best[name], type=kind, from_pandas=True) for name, kind in zip(names, types)], names=names)

    keys = [_QUERY_BLOCK, _ITEM_BLOCK]
    scored = pairs.groupBy(*keys).cogroup(left.unionByName(right).groupBy(*keys)).applyInArrow(score, T.StructType(fields))
    ranking = Window.partitionBy(query_id).orderBy(F.desc("score"), F.asc(item_id))
    return scored.withColumn("rank", F.row_number().over(ranking)).filter(F.col("rank") <= k)
