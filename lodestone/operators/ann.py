"""Approximate vector indexes as tables.

An index is the item table plus a ``cell`` and/or ``code`` column, and a model
of bounded size (centroids, codebooks, hyperplanes) kept on the driver. Search
is a top-k join: inverted-file kinds join each query only with the cells it
probes. Quantised kinds are scored on their codes, by a table of each query's
products with all codewords; half precision and sign bits are decoded inside the
scoring kernel. Nothing here scans pairs in Python; blocks are scored at once. A
search may ask for more candidates than it returns and score those again exactly.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.functions.arrow import with_arrow_column
from lodestone.functions.vectors import from_matrix, to_matrix, unit_rows
from lodestone.operators.lineage import checkpointed
from lodestone.operators.nearest import Products, nearest, rescored

# Stored metadata is split by a hash of the item id, for point lookups.
LOOKUP = "lookup_part"
#: Rows, drawn by their hash, that k-means of sub-spaces chooses its first codewords from, and its passes over all rows at most.
SEED_ROWS = 4_096
MOST_PASSES = 20
#: Coded items whose scores are summed at once.
_TABLE_STRIPE = 256
#: Items asked to learn how many candidates trained codes must give, their share of the exact top ten, and the most for a result.
SAMPLE_QUERIES = 512
SAMPLE_RECALL = 0.93
MOST_CANDIDATES = 100


def lookup_part(item_id: str, parts: int) -> Column:
    """Partition that holds the metadata of an item, of ``parts`` in all."""
    return F.pmod(F.xxhash64(item_id), F.lit(parts)).cast("int")


INDEX_TYPES = ("flat", "hnsw", "ivf_flat", "ivf_pq", "ivf_sq", "pq", "lsh")

# Build parameters when none are given.
INDEX_DEFAULTS = {
    "hnsw_m": 32,
    "hnsw_ef_construction": 200,
    "hnsw_ef_search": 64,
    "nlist": 256,
    "nprobe": 32,
    "pq_m": 32,
    "lsh_nbits": 1024,
}


def _kmeans(frame: DataFrame, column, k: int, seed: int, measure: str) -> np.ndarray:
    model = (
        KMeans(k=k, seed=seed, distanceMeasure=measure, featuresCol="_v", maxIter=20)
        .fit(frame.select(array_to_vector(column).alias("_v")))
    )
    return np.array(model.clusterCenters())


def train_centroids(
    vectors: DataFrame, nlist: int, *, item_vector="embedding", seed=42
) -> np.ndarray:
    """Spherical k-means centroids over all vectors, one per inverted-file cell."""
    return unit_rows(_kmeans(vectors, F.col(item_vector).cast("array<double>"), nlist, seed, "cosine"))


def train_codebooks(
    vectors: DataFrame, m: int, bits: int = 8, *, item_vector="embedding", seed=42,
) -> np.ndarray:
    """``(m, codewords, d/m)`` product-quantiser codebooks by k-means per sub-space, over all vectors.

    A pass over the vectors moves the codewords of all sub-spaces.
    """
    if not 1 <= bits <= 8:
        raise ValueError("codes hold between 1 and 8 bits")
    dimension = vectors.select(F.size(item_vector)).first()[0]
    if dimension % m:
        raise ValueError(f"pq_m={m} must divide the dimension {dimension}")
    width = dimension // m
    rows = checkpointed(vectors.select(item_vector))
    share = F.lit(SEED_ROWS / max(1, rows.count()))
    drawn = F.pmod(F.xxhash64(F.lit(seed), item_vector), F.lit(1 << 30)) < share * (1 << 30)
    some = rows.filter(drawn).limit(2 * SEED_ROWS).toArrow()
    if some.num_rows < 2**bits:  # of a small table, or of many copies
        some = rows.limit(2 * SEED_ROWS).toArrow()
    sample = to_matrix(some.column(item_vector)).reshape(-1, m, width)
    books = np.stack([_spread_seeds(sample[:, part], 2**bits, seed + part) for part in range(m)])
    for _ in range(MOST_PASSES):
        moved = _moved(rows, books, item_vector)
        still = np.sqrt(((moved - books) ** 2).sum(axis=2)).max() <= 1e-4
        books = moved
        if still:
            break
    return books


def _spread_seeds(sample: np.ndarray, k: int, seed: int) -> np.ndarray:
    """k rows of the sample, each drawn in proportion to its squared distance from those drawn before; repeated if too few differ."""
    rng = np.random.default_rng(seed)
    chosen = [sample[rng.integers(len(sample))]]
    away = ((sample - chosen[0]) ** 2).sum(axis=1)
    while len(chosen) < k:
        total = away.sum()
        at = rng.choice(len(sample), p=away / total) if total > 0 else 0
        chosen.append(sample[at])
        away = np.minimum(away, ((sample - sample[at]) ** 2).sum(axis=1))
    return np.array(chosen)


def _moved(rows: DataFrame, books: np.ndarray, item_vector: str) -> np.ndarray:
    """Means of the rows nearest to each codeword, of all sub-spaces in one pass; a codeword without rows stays.

    A task returns one sum for each entry, and so does the whole pass.
    """
    m, words, width = books.shape
    shared = rows.sparkSession.sparkContext.broadcast(books)

    def add(batches):
        books = shared.value
        sums, counts = np.zeros((m, words, width)), np.zeros((m, words))
        for batch in batches:
            matrix = to_matrix(batch.column(0))
            codes = PqCodec(books).encode(matrix)
            for part in range(m):
                own = codes[:, part].astype(np.int64)
                counts[part] += np.bincount(own, minlength=words)
                for entry in range(width):
                    sums[part, :, entry] += np.bincount(own, weights=matrix[:, part * width + entry], minlength=words)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(sums.size)), pa.array(sums.ravel()), pa.array(np.repeat(counts.ravel(), width))], names=["at", "x", "n"]
        )

    parts = rows.select(item_vector).mapInArrow(add, "at long, x double, n double")
    held = parts.groupBy("at").agg(F.sum("x").alias("x"), F.sum("n").alias("n")).toArrow()
    made, at = books.reshape(-1).copy(), held.column("at").to_numpy()
    x, n = held.column("x").to_numpy(), held.column("n").to_numpy()
    made[at[n > 0]] = x[n > 0] / n[n > 0]
    return made.reshape(books.shape)


def hyperplanes(bits: int, dimension: int) -> np.ndarray:
    """Reproducible Gaussian directions: Box-Muller over MD5 of ``bit:axis``."""

    def normal(bit: int, axis: int) -> float:
        digest = hashlib.md5(f"{bit}:{axis}".encode()).hexdigest()
        u = (int(digest[:8], 16) + 1) / 4294967297
        v = int(digest[8:16], 16) / 4294967296
        return float(np.sqrt(-2 * np.log(u)) * np.cos(2 * np.pi * v))

    return np.array([[normal(b, a) for a in range(dimension)] for b in range(bits)])


def _of_others(owners: np.ndarray, languages) -> np.ndarray:
    """True where a row may not enter a cell: the cell belongs to another language."""
    return owners[None, :] != np.array(languages, dtype=object)[:, None]


def assign_cells(
    items: DataFrame, centroids: np.ndarray, item_vector="embedding", owners: list[str] | None = None
) -> DataFrame:
    """Add ``cell``: the centroid with the largest inner product. Narrow.

    ``owners`` names the language of every centroid; items then only enter cells of
    their own ``language``.
    """
    owner = None if owners is None else np.array(owners, dtype=object)

    def compute(batch):
        scores = unit_rows(to_matrix(batch.column(item_vector))) @ centroids.T
        if owner is not None:
            scores[_of_others(owner, batch.column("language").to_pylist())] = -np.inf
        return pa.array(np.argmax(scores, axis=1).astype(np.int32))

    inputs = (item_vector,) if owners is None else (item_vector, "language")
    return with_arrow_column(items, T.StructField("cell", T.IntegerType()), inputs, compute)


def probe_cells(
    queries: DataFrame, centroids: np.ndarray, nprobe: int, query_vector="query_embedding",
    owners: list[str] | None = None,
) -> DataFrame:
    """Add ``cell``: the nprobe best centroids of each query, as an array; of each language if they have owners."""
    owner = np.array([""] * len(centroids) if owners is None else owners, dtype=object)
    shares = [np.flatnonzero(owner == name) for name in sorted(set(owner.tolist()), key=str)]

    def compute(batch):
        scores = unit_rows(to_matrix(batch.column(query_vector))) @ centroids.T
        best = [
            share[np.argsort(-scores[:, share], axis=1, kind="stable")[:, :nprobe]] for share in shares
        ]
        return from_matrix(np.hstack(best).astype(np.int32), pa.int32())

    return with_arrow_column(queries, T.StructField("cell", T.ArrayType(T.IntegerType())), (query_vector,), compute)


def _packed(column) -> np.ndarray:
    """Arrow binary column of equal-length values to an ``(n, bytes)`` matrix, without copies."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        raise ValueError("a code is missing")
    rows = len(column)
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + rows + 1]
    width = int(offsets[1] - offsets[0]) if rows else 0
    if rows and (np.diff(offsets) != width).any():
        raise ValueError("codes differ in length")
    data = column.buffers()[2] if rows and width else b""
    return np.frombuffer(data, np.uint8, rows * width, int(offsets[0]) if rows and width else 0).reshape(rows, width)


def _pack(rows: np.ndarray) -> pa.Array:
    rows = np.ascontiguousarray(rows)
    count, width = rows.shape[0], rows.shape[1] * rows.itemsize if rows.ndim == 2 else 0
    offsets = np.arange(count + 1, dtype=np.int32) * width
    return pa.Array.from_buffers(pa.binary(), count, [None, pa.py_buffer(offsets), pa.py_buffer(rows)])


@dataclass
class PqCodec:
    """One byte per sub-space: the nearest codeword by Euclidean distance."""

    codebooks: np.ndarray

    def encode(self, matrix: np.ndarray) -> np.ndarray:
        m, _, width = self.codebooks.shape
        codes = np.empty((len(matrix), m), dtype=np.uint8)
        for part, book in enumerate(self.codebooks):
            sub = matrix[:, part * width : (part + 1) * width]
            codes[:, part] = np.argmin((book**2).sum(axis=1) - 2 * sub @ book.T, axis=1)
        return codes

    def decode(self, packed: np.ndarray) -> np.ndarray:
        parts = [book[packed[:, part]] for part, book in enumerate(self.codebooks)]
        return np.concatenate(parts, axis=1)


@dataclass
class TableScores(Products):
    """Inner products of query vectors with coded items, without decoding these.

    ``prepare`` multiplies a stripe of queries with every codeword once; an item's score is the
    sum of the entries that its code names. With ``centroids`` codes are of residuals, and the
    product with the centroid of the item's cell is one more entry. Tables exist for one stripe
    of queries at a time, a row for each codeword, so that an entry of all its queries is contiguous. The
    vectors that codes stand for, in single precision, only tell which items may be among the best.
    """

    codebooks: np.ndarray
    centroids: np.ndarray | None = None

    def places(self, codes: np.ndarray, cells: np.ndarray | None) -> np.ndarray:
        """Rows of the table that make up the score of every item."""
        m, words, _ = self.codebooks.shape
        rows = codes.astype(np.int32) + np.arange(m, dtype=np.int32) * words
        return rows if cells is None else np.column_stack([rows, cells.astype(np.int32) + m * words])

    def prepare(self, queries: np.ndarray) -> np.ndarray:
        width = self.codebooks.shape[2]
        tables = [
            book @ queries[:, part * width : (part + 1) * width].T for part, book in enumerate(self.codebooks)
        ]
        if self.centroids is not None:
            tables.append(self.centroids @ queries.T)
        return np.vstack(tables)

    def scores(self, prepared: np.ndarray, items: np.ndarray) -> np.ndarray:
        out = np.empty((prepared.shape[1], len(items)))
        # Few items at once, so that sums stay in the processor cache.
        for at in range(0, len(items), _TABLE_STRIPE):
            part = items[at : at + _TABLE_STRIPE]
            total = np.take(prepared, part[:, 0], axis=0, mode="clip")
            entry = np.empty_like(total)
            for column in range(1, items.shape[1]):
                total += np.take(prepared, part[:, column], axis=0, out=entry, mode="clip")
            out[:, at : at + len(part)] = total.T
        return out

    def pairs(self, prepared: np.ndarray, items: np.ndarray, rows: np.ndarray, at: np.ndarray) -> np.ndarray:
        total = np.zeros(len(rows))
        for column in range(items.shape[1]):
            total += prepared[items[at, column], rows]
        return total

    def vectors(self, items: np.ndarray) -> np.ndarray:
        m, words, _ = self.codebooks.shape
        whole = np.concatenate([book[items[:, part] - part * words] for part, book in enumerate(self.codebooks)], axis=1)
        return (whole if self.centroids is None else whole + self.centroids[items[:, m] - m * words]).astype(np.float32)

    def item_bytes(self, dimension: int) -> int:
        return 4 * (len(self.codebooks) + 1)


@dataclass
class SignScores(Products):
    """Products of -1/+1 vectors with items packed to a bit an entry."""

    bits: int

    def scores(self, prepared: np.ndarray, items: np.ndarray) -> np.ndarray:
        return prepared @ self.vectors(items).T.astype(np.float64)

    def pairs(self, prepared: np.ndarray, items: np.ndarray, rows: np.ndarray, at: np.ndarray) -> np.ndarray:
        return super().pairs(prepared, self.vectors(items).astype(np.float64), rows, at)

    def vectors(self, items: np.ndarray) -> np.ndarray:
        return np.unpackbits(items, axis=1, count=self.bits).astype(np.float32) * np.float32(2) - np.float32(1)

    def item_bytes(self, dimension: int) -> int:
        return -(-self.bits // 8)


class HalfCodec:
    """Two bytes per component: IEEE half precision."""

    def encode(self, matrix: np.ndarray) -> np.ndarray:
        return matrix.astype(np.float16).view(np.uint8)

    def decode(self, packed: np.ndarray) -> np.ndarray:
        return np.ascontiguousarray(packed).view(np.float16).astype(np.float64)


@dataclass
class SignCodec:
    """One bit per hyperplane; decoding gives -1/+1, so products count equal bits."""

    planes: np.ndarray

    def signs(self, matrix: np.ndarray) -> np.ndarray:
        return matrix @ self.planes.T > 0

    def encode(self, matrix: np.ndarray) -> np.ndarray:
        return np.packbits(self.signs(matrix), axis=1)

    def decode(self, packed: np.ndarray) -> np.ndarray:
        bits = np.unpackbits(packed, axis=1, count=len(self.planes))
        return bits.astype(np.float64) * 2 - 1


@dataclass
class VectorIndex:
    """An index table with its model.

    ``items`` keeps every original column. When vectors are computed on the
    fly, ``details`` may hold the metadata columns apart from them.
    """

    index_type: str
    items: DataFrame
    item_id: str = "chunk_id"
    item_vector: str = "embedding"
    centroids: np.ndarray | None = None
    codec: object | None = None
    nprobe: int = INDEX_DEFAULTS["nprobe"]
    edges: DataFrame | None = None
    options: dict = field(default_factory=dict)
    details: DataFrame | None = None

    def search(
        self, queries: DataFrame, k: int, *, query_id="query_id", query_vector="query_embedding",
        own: str | None = None, refine: int = 1, **options,
    ) -> DataFrame:
        """Top-k items per query; LSH scores are negated Hamming distances.

        ``own`` names a column of both sides: each query then searches only the
        items that share its value. With ``refine`` above 1 the index gives ``refine * k``
        candidates a query, which are ranked by exact inner products; it must hold its vectors. An index that
        has trained its codebooks gives more, if a sample shows that they are needed.
        """
        if refine < 1:
            raise ValueError("refine must be at least 1")
        if refine > 1 and self.edges is None:
            if self.item_vector not in self.items.columns:
                raise ValueError("the index keeps codes only; candidates can't be scored exactly")
            candidates = k * max(refine, self._candidates())
            found = self.search(queries, candidates, query_id=query_id, query_vector=query_vector, own=own, **options)
            return rescored(
                found, queries, self.items, k, candidates, query_id=query_id, query_vector=query_vector,
                item_id=self.item_id, item_vector=self.item_vector,
            )
        if self.edges is not None:
            from lodestone.operators.graph import search_graph

            return search_graph(self, queries, k, query_id=query_id, query_vector=query_vector, own=own)
        items, on = self.items, own
        if self.centroids is not None:
            queries = probe_cells(queries, self.centroids, self.nprobe, query_vector, self.options.get("owners"))
            on = "cell"
            if own is not None:
                on = "_place"

                def place(cell):
                    return F.concat_ws("#", cell.cast("string"), F.col(own).cast("string"))

                queries = queries.filter(F.col(own).isNotNull()).withColumn(on, F.transform("cell", place))
                items = items.filter(F.col(own).isNotNull()).withColumn(on, place(F.col("cell")))
        if isinstance(self.codec, SignCodec):
            codec = self.codec
            queries = with_arrow_column(
                queries,
                T.StructField(query_vector, T.ArrayType(T.FloatType())),
                (query_vector,),
                lambda b: from_matrix(
                    codec.signs(unit_rows(to_matrix(b.column(query_vector)))) * 2.0 - 1.0
                ),
            )
        found = nearest(
            queries, items, k, query_id=query_id, query_vector=query_vector,
            item_id=self.item_id, item_vector=self.item_vector, on=on,
            decode=self._decoder(), decode_from=("code",) if self.centroids is None else ("code", "cell"),
            scorer=self._scorer(), normalize=not isinstance(self.codec, SignCodec), **options,
        )
        found = found.drop(on) if on else found
        if isinstance(self.codec, SignCodec):
            bits = len(self.codec.planes)
            found = found.withColumn("score", (F.col("score") - bits) / 2)
        return found

    def _candidates(self) -> int:
        """Candidates for each result with which a sample of the items finds its exact top ten; 1 for given codebooks.

        The share that must be found is ``SAMPLE_RECALL``, or all that ``MOST_CANDIDATES`` give if that is less.
        Measured once, and kept in the options.
        """
        if not self.options.get("trained_codebooks"):
            return 1
        if "candidates" not in self.options:
            share = F.lit(SAMPLE_QUERIES / max(1, self.items.count()))
            drawn = F.pmod(F.xxhash64(F.lit("sample"), self.item_id), F.lit(1 << 30)) < share * (1 << 30)
            asked = checkpointed(
                self.items.filter(drawn).select(F.col(self.item_id).alias("_q"), F.col(self.item_vector).alias("_qv"))
            )
            names = {"query_id": "_q", "query_vector": "_qv"}
            truth = nearest(asked, self.items, 10, **names, item_id=self.item_id, item_vector=self.item_vector)
            coded = self.search(asked, 10 * MOST_CANDIDATES, **names).select(
                "_q", self.item_id, F.ceil(F.col("rank") / 10).cast("int").alias("_times")
            )
            # At most one row for each multiple, and one for what isn't found.
            counts = truth.select("_q", self.item_id).join(coded, ["_q", self.item_id], "left").groupBy("_times").count().collect()
            every = sum(r["count"] for r in counts)
            found = np.zeros(MOST_CANDIDATES + 1)
            for r in counts:
                found[r["_times"] or 0] = r["count"]
            found[0] = 0
            reached = np.cumsum(found)
            wanted = min(SAMPLE_RECALL * every, reached[-1])
            self.options["candidates"] = max(1, int(np.argmax(reached >= wanted)))
        return self.options["candidates"]

    def _scorer(self) -> Products:
        if isinstance(self.codec, PqCodec):
            return TableScores(self.codec.codebooks, self.centroids)
        if isinstance(self.codec, SignCodec):
            return SignScores(len(self.codec.planes))
        return Products()

    def _decoder(self):
        if self.codec is None:
            return None
        codec, centroids = self.codec, self.centroids
        if isinstance(codec, SignCodec):
            return lambda table: _packed(table.column("code"))
        if isinstance(codec, PqCodec):
            tables = self._scorer()

            def read(table) -> np.ndarray:
                cells = None if centroids is None else np.asarray(table.column("cell"))
                return tables.places(_packed(table.column("code")), cells)

            return read

        def decode(table) -> np.ndarray:
            vectors = codec.decode(_packed(table.column("code")))
            if centroids is not None:
                vectors = vectors + centroids[np.asarray(table.column("cell"))]
            return vectors

        return decode


def encode_items(index: VectorIndex, items: DataFrame) -> DataFrame:
    """Items with the columns that the index adds by its model: ``cell``, ``code``."""
    item_vector, coarse = index.item_vector, index.centroids
    if coarse is not None:
        items = assign_cells(items, coarse, item_vector, index.options.get("owners"))
    if index.codec is not None:
        codec = index.codec
        used = (item_vector,) if coarse is None else (item_vector, "cell")
        items = with_arrow_column(
            items, T.StructField("code", T.BinaryType()), used,
            lambda b: _pack(codec.encode(_residual(b, item_vector, coarse))),
        )
    return items


def _residual(batch, item_vector: str, coarse: np.ndarray | None) -> np.ndarray:
    matrix = unit_rows(to_matrix(batch.column(item_vector)))
    return matrix if coarse is None else matrix - coarse[np.asarray(batch.column("cell"))]


def build_index(
    items: DataFrame,
    index_type: str,
    *,
    item_id="chunk_id",
    item_vector="embedding",
    centroids: np.ndarray | None = None,
    codebooks: np.ndarray | None = None,
    pq_bits: int = 8,
    separate: bool = False,
    **params,
) -> VectorIndex:
    """Build any supported index. Given models are used as they are, else trained.

    With ``separate`` every ``language`` gets centroids of its own; a graph always has one
    graph for each language.
    """
    if index_type not in INDEX_TYPES:
        raise ValueError(f"{index_type!r} is not one of the index kinds {INDEX_TYPES}")
    p = {**INDEX_DEFAULTS, **params}
    names = {"item_id": item_id, "item_vector": item_vector}
    index = VectorIndex(index_type, items, **names, nprobe=p["nprobe"])
    if index_type == "flat":
        return index
    if index_type == "hnsw":
        from lodestone.operators.graph import build_graph

        return build_graph(
            items, **names, m=p["hnsw_m"], ef_construction=p["hnsw_ef_construction"],
            ef_search=p["hnsw_ef_search"], group="language" if "language" in items.columns else None,
        )

    if index_type.startswith("ivf"):
        if centroids is None and separate:
            # One training run for each language, of which there are few.
            names_of = [r[0] for r in items.select("language").distinct().orderBy("language").collect()]
            trained = [
                train_centroids(items.filter(F.col("language").eqNullSafe(name)), p["nlist"], item_vector=item_vector)
                for name in names_of
            ]
            index.options["owners"] = [name for name, rows in zip(names_of, trained) for _ in rows]
            centroids = np.vstack(trained)
        index.centroids = (
            centroids if centroids is not None else train_centroids(items, p["nlist"], item_vector=item_vector)
        )
    if index_type in ("pq", "ivf_pq"):
        if codebooks is None:
            coarse = index.centroids
            used = (item_vector,) if coarse is None else (item_vector, "cell")
            rest = with_arrow_column(
                encode_items(index, items), T.StructField(item_vector, T.ArrayType(T.FloatType())), used,
                lambda b: from_matrix(_residual(b, item_vector, coarse)),
            )
            codebooks = train_codebooks(rest, p["pq_m"], pq_bits, item_vector=item_vector)
            index.options["trained_codebooks"] = True
        index.codec = PqCodec(codebooks)
    elif index_type == "ivf_sq":
        index.codec = HalfCodec()
    elif index_type == "lsh":
        dimension = items.select(F.size(item_vector)).first()[0]
        index.codec = SignCodec(hyperplanes(p["lsh_nbits"], dimension))
    index.items = encode_items(index, items)
    return index
