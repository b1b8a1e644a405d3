"""Insertion into a stored graph: recall, copies, and what stays untouched."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.operators import graph
from lodestone.operators.ann import build_index
from lodestone.operators.graph import diverse
from lodestone.operators.metrics import result_overlap
from lodestone.operators.nearest import nearest
from lodestone.sources.index_store import append_items, compact, load_index, read_manifest, save_index


def lists(index):
    return {(r["level"], r["src"]): frozenset(r["links"]) for r in index.edges.collect()}


def as_queries(items):
    return items.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_embedding"), "language")


@pytest.fixture(scope="module")
def items(spark):
    rng = np.random.default_rng(7)
    data = rng.normal(size=(260, 12))
    data[200:220] = data[3]  # copies of a stored vector
    data[220:230] = data[240]  # copies inside the batch
    rows = [(i, "ab"[i % 2] if i < 255 else "new", [float(x) for x in v]) for i, v in enumerate(data)]
    return spark.createDataFrame(rows, "vec_id long, language string, embedding array<float>").repartition(4).persist()


def test_diverse_keeps_the_best_and_skips_what_a_kept_one_reaches():
    near = np.array([[1.0, 0.0], [0.99, np.sqrt(1 - 0.99**2)], [0.0, 1.0]])
    node = np.array([np.cos(0.6), -np.sin(0.6)])
    score = near @ node
    assert diverse(near, score, 3) == [0, 1, 2]  # room is filled
    node = np.array([np.cos(0.5), np.sin(0.5)])
    score = near @ node
    assert score[1] > score[0] > score[2]
    assert diverse(near, score, 2) == [1, 2]  # 0 is nearer to 1 than to the node
    assert diverse(near[:0], score[:0], 2) == []


def test_append_to_a_graph(spark, items, tmp_path):
    path = str(tmp_path / "graph")
    save_index(build_index(items.filter("vec_id < 200"), "hnsw", item_id="vec_id", hnsw_m=8, hnsw_ef_search=32), path)
    before = lists(load_index(spark, path))
    few = items.filter("vec_id IN (201, 203, 205, 230, 259)")
    append_items(spark, path, few)
    after = lists(load_index(spark, path))
    changed = {key for key in before if after[key] != before[key]}
    # Copies of 3 enter no list, the only item of a new group has no neighbour, 230 changes those it links to.
    assert {src for _, src in set(after) - set(before)} == {230}
    assert 0 < len(changed) <= 16 and all(src in after[level, 230] for level, src in changed)
    append_items(spark, path, items.filter("vec_id >= 200").join(few.select("vec_id"), "vec_id", "left_anti"))
    index = load_index(spark, path)
    after = lists(index)
    assert {src for _, src in set(after) - set(before)} == {200, 220, 221, *range(230, 260)} - {240}
    assert all(len(links) <= 16 for links in after.values())
    assert len(read_manifest(spark, path)["links"]) == 2
    truth = nearest(as_queries(items), items, 10, query_id="query_id", item_id="vec_id", on="language")
    for _ in range(2):
        found = load_index(spark, path).search(as_queries(items), 10, own="language")
        assert result_overlap(truth, found, item_id="vec_id").first()["recall"] >= 0.9
        compact(spark, path)
        assert read_manifest(spark, path)["links"] == [] and lists(load_index(spark, path)) == after


def test_appending_nothing(spark, items, tmp_path):
    path = str(tmp_path / "graph")
    save_index(build_index(items.filter("vec_id < 20"), "hnsw", item_id="vec_id", hnsw_m=4), path)
    before = lists(load_index(spark, path))
    append_items(spark, path, items.filter("vec_id < 0"))
    assert lists(load_index(spark, path)) == before and load_index(spark, path).items.count() == 20


def test_many_queries_walk_in_batches(spark, items, monkeypatch):
    """Batches share their query vectors as variables, so no join moves a vector for every pair; results stay."""
    index = build_index(items, "hnsw", item_id="vec_id", hnsw_m=8, hnsw_ef_search=32)
    whole = index.search(as_queries(items), 10, own="language").collect()
    monkeypatch.setattr(graph, "BROADCAST_BYTES", 20_000)
    shared, sizes = graph._shared_queries, []

    def counted(asked):
        sizes.append(asked.count())
        return shared(asked)

    monkeypatch.setattr(graph, "_shared_queries", counted)
    assert sorted(index.search(as_queries(items), 10, own="language").collect()) == sorted(whole)
    assert len(sizes) > 1 and sum(sizes) == 260


def test_walks_begin_on_a_small_layer_above_the_ground(spark):
    """All of that layer is scored, so the layers above it need no rounds; the ground is always walked."""
    sizes = {("a", 0): 90, ("a", 1): 7, ("a", 2): 2, ("b", 0): 3}
    nodes = spark.createDataFrame([k for k, n in sizes.items() for _ in range(n)], "_g string, level int")
    assert graph._tops(nodes) == {"a": (2, 1), "b": (0, 0)}
