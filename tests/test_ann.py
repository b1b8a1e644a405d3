import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestone.functions.vectors import l2_normalize, norm_stats, to_matrix
from lodestone.operators.ann import HalfCodec, PqCodec, SignCodec, TableScores, build_index, hyperplanes
from lodestone.operators.metrics import result_overlap
from lodestone.operators.nearest import nearest
from lodestone.sources.index_store import load_index, save_index


@pytest.fixture(scope="module")
def items(spark):
    rng = np.random.default_rng(5)
    centers = rng.normal(size=(6, 16))
    data = centers[rng.integers(0, 6, 400)] + 0.6 * rng.normal(size=(400, 16))
    data[300:] = data[0]  # a hot group of copies
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(data)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4)
    return frame.persist()


def as_queries(items):
    return items.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_embedding"))


def recall(items, found):
    truth = nearest(as_queries(items), items, 10, item_id="vec_id")
    return result_overlap(truth, found, item_id="vec_id").first()["recall"]


@pytest.mark.parametrize(
    "kind,options,least",
    [
        ("flat", {}, 1.0),
        ("ivf_flat", {"nlist": 8, "nprobe": 3}, 0.85),
        ("ivf_flat", {"nlist": 8, "nprobe": 8}, 1.0),
        ("ivf_sq", {"nlist": 8, "nprobe": 8}, 0.95),
        ("ivf_pq", {"nlist": 4, "nprobe": 4, "pq_m": 8, "pq_bits": 5}, 0.6),
        ("pq", {"pq_m": 8, "pq_bits": 5}, 0.5),
        ("lsh", {"lsh_nbits": 512}, 0.7),
        ("hnsw", {"hnsw_m": 12, "hnsw_ef_search": 48}, 0.9),
    ],
)
def test_recall(items, kind, options, least):
    index = build_index(items, kind, item_id="vec_id", **options)
    found = index.search(as_queries(items), 10)
    assert found.groupBy("query_id").count().filter("count > 10").count() == 0
    assert recall(items, found) >= least


def test_graph_with_a_beam_as_wide_as_the_table_is_exact(items):
    some = items.filter("vec_id % 9 = 0").persist()
    index = build_index(some, "hnsw", item_id="vec_id", hnsw_m=8, hnsw_ef_search=400)
    got = index.search(as_queries(some), 10)
    want = nearest(as_queries(some), some, 10, item_id="vec_id")
    key = ["query_id", "vec_id", "score", "rank"]
    assert sorted(map(tuple, got.select(key).collect())) == sorted(map(tuple, want.select(key).collect()))


def test_ivf_blocks_equal_broadcast(items):
    index = build_index(items, "ivf_flat", item_id="vec_id", nlist=6, nprobe=2)
    key = ["query_id", "vec_id", "score", "rank"]
    a, b = (
        sorted(map(tuple, index.search(as_queries(items), 5, strategy=s).select(key).collect()))
        for s in ("broadcast", "blocks")
    )
    assert a == b


def test_codecs():
    rng = np.random.default_rng(1)
    data = rng.normal(size=(20, 8))
    half = HalfCodec()
    assert np.array_equal(half.decode(half.encode(data)), data.astype(np.float16).astype(float))
    sign = SignCodec(hyperplanes(30, 8))
    assert np.array_equal(sign.decode(sign.encode(data)), np.where(sign.signs(data), 1.0, -1.0))
    assert np.array_equal(hyperplanes(3, 4), hyperplanes(3, 4))


@pytest.mark.parametrize("kind", ["hnsw", "ivf_flat", "pq", "flat"])
def test_own_language_is_complete(items, kind):
    # Copies across languages, and a language of a few items.
    spoken = items.withColumn(
        "language", F.when(F.col("vec_id") % 40 == 0, "few").when(F.col("vec_id") % 2 == 0, "a").otherwise("b")
    )
    index = build_index(spoken, kind, item_id="vec_id", nlist=6, nprobe=6, pq_m=8, pq_bits=5, hnsw_m=8, hnsw_ef_search=24)
    queries = as_queries(spoken).join(spoken.select(F.col("vec_id").alias("query_id"), "language"), "query_id")
    found = index.search(queries, 10, own="language")
    assert found.count() == 4_000
    both = found.join(spoken.select("vec_id", "language"), "vec_id").join(
        queries.select("query_id", F.col("language").alias("asked")), "query_id"
    )
    assert both.filter("language <> asked").isEmpty()


def test_separate_centroids(items, spark, tmp_path):
    spoken = items.withColumn("language", F.when(F.col("vec_id") % 40 == 0, "few").otherwise("most"))
    index = build_index(spoken, "ivf_flat", item_id="vec_id", nlist=4, nprobe=2, separate=True)
    owners = dict(enumerate(index.options["owners"]))
    assert set(owners.values()) == {"few", "most"}
    assert all(owners[r["cell"]] == r["language"] for r in index.items.select("cell", "language").distinct().collect())
    save_index(index, str(tmp_path / "x"), separate=True)
    found = load_index(spark, str(tmp_path / "x")).search(as_queries(spoken), 10)
    assert found.count() == 4_000 and recall(items, found) >= 0.5


def test_uneven_and_missing_vectors_are_refused():
    for broken in ([[1.0, 2.0], [1.0]], [[1.0, 2.0, 3.0], [1.0, 2.0, 3.0, 4.0, 5.0]], [[1.0], None]):
        with pytest.raises(ValueError):
            to_matrix(pa.array(broken, pa.list_(pa.float32())))
    assert to_matrix(pa.array([], pa.list_(pa.float32()))).shape == (0, 0)


def test_bad_arguments(items):
    with pytest.raises(ValueError):
        build_index(items, "tree", item_id="vec_id")
    with pytest.raises(ValueError):
        build_index(items, "pq", item_id="vec_id", pq_m=5)


def test_normalize_and_stats(spark):
    frame = spark.createDataFrame([(1, [3.0, 4.0]), (2, [0.0, 0.0])], "id long, embedding array<float>")
    rows = frame.select("id", l2_normalize(F.col("embedding")).alias("v")).orderBy("id").collect()
    assert rows[0]["v"] == pytest.approx([0.6, 0.8]) and rows[1]["v"] == [0.0, 0.0]
    stats = norm_stats(frame).first()
    assert (stats["vectors"], stats["min_norm"], stats["max_norm"], stats["mean_norm"]) == (2, 0.0, 5.0, 2.5)


@pytest.mark.parametrize("coarse", [False, True])
def test_table_scores_equal_products_with_decoded_vectors(coarse):
    rng = np.random.default_rng(3)
    books, centroids = rng.normal(size=(4, 16, 3)), rng.normal(size=(5, 12)) if coarse else None
    queries, codes, cells = rng.normal(size=(7, 12)), rng.integers(0, 16, (50, 4)).astype(np.uint8), rng.integers(0, 5, 50)
    tables = TableScores(books, centroids)
    got = tables.scores(tables.prepare(queries), tables.places(codes, cells if coarse else None))
    decoded = PqCodec(books).decode(codes) + (centroids[cells] if coarse else 0)
    assert np.allclose(got, queries @ decoded.T)
    assert tables.scores(tables.prepare(queries), tables.places(codes[:0], cells[:0] if coarse else None)).shape == (7, 0)


@pytest.mark.parametrize("kind,options", [("pq", {"pq_m": 8, "pq_bits": 5}), ("lsh", {"lsh_nbits": 128})])
def test_refined_search_scores_its_candidates_exactly(items, kind, options):
    index = build_index(items, kind, item_id="vec_id", **options)
    plain, refined = index.search(as_queries(items), 80), index.search(as_queries(items), 10, refine=8)
    exact = nearest(as_queries(items), items, 400, item_id="vec_id").select("query_id", "vec_id", "score")
    want = {}
    for query, item, score in plain.select("query_id", "vec_id").join(exact, ["query_id", "vec_id"]).collect():
        want.setdefault(query, []).append((-score, item))
    got = {}
    for row in refined.orderBy("query_id", "rank").collect():
        got.setdefault(row["query_id"], []).append((-row["score"], row["vec_id"]))
    assert got == {query: sorted(found)[:10] for query, found in want.items()}


def test_refining_needs_vectors(items):
    index = build_index(items, "lsh", item_id="vec_id", lsh_nbits=32)
    index.items = index.items.drop("embedding")
    with pytest.raises(ValueError, match="codes only"):
        index.search(as_queries(items), 5, refine=4)
    with pytest.raises(ValueError, match="at least 1"):
        index.search(as_queries(items), 5, refine=0)


def test_trained_codes_give_as_many_candidates_as_they_need(spark):
    """Two candidates for a result are far too few for codes of four bits; a sample of the items shows it."""
    rng = np.random.default_rng(11)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(rng.normal(size=(800, 8)))]
    items = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(2)
    queries = items.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_embedding"))
    truth = nearest(queries, items, 10, query_id="query_id", item_id="vec_id")
    index = build_index(items, "pq", item_id="vec_id", pq_m=2, pq_bits=2)
    found = index.search(queries, 10, refine=2)
    assert result_overlap(truth, found, item_id="vec_id").first()["recall"] >= 0.9
    given = build_index(items, "pq", item_id="vec_id", codebooks=index.codec.codebooks)
    plain = given.search(queries, 10, refine=2)
    assert result_overlap(truth, plain, item_id="vec_id").first()["recall"] < 0.9


def test_codebooks_of_all_sub_spaces_are_trained_together(spark, monkeypatch):
    """No run of k-means for each sub-space: a pass moves all codewords to the means of the rows nearest to them."""
    from lodestone.operators import ann

    rng = np.random.default_rng(12)
    data = rng.normal(size=(900, 12)).astype(np.float32)
    rows = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(data)], "vec_id long, embedding array<float>")
    monkeypatch.setattr(ann, "_kmeans", lambda *a: pytest.fail("one run for a sub-space"))
    moved, passes = ann._moved, []
    monkeypatch.setattr(ann, "_moved", lambda *a: passes.append(1) or moved(*a))
    books = ann.train_codebooks(rows, 6, 3)
    assert books.shape == (6, 8, 2) and len(passes) <= ann.MOST_PASSES
    held = moved(rows, books, "embedding")
    codes = PqCodec(books).encode(data.astype(float))
    for part in range(6):
        for word in range(8):
            own = data[codes[:, part] == word, 2 * part : 2 * part + 2]
            assert np.allclose(held[part, word], own.mean(axis=0) if len(own) else books[part, word])
    copies = spark.createDataFrame([(i, [1.0, 2.0, 3.0, 4.0]) for i in range(5)], "vec_id long, embedding array<float>")
    assert np.allclose(ann.train_codebooks(copies, 2, 2), [[[1, 2]] * 4, [[3, 4]] * 4])
