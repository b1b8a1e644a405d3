import numpy as np
import pytest
from pyspark.sql import functions as F

import lodestone.operators.nearest as nearest_module
from lodestone.operators.nearest import nearest


def make_vectors(spark, n=300, dim=8, seed=3, groups=3, string_ids=False):
    rng = np.random.default_rng(seed)
    data = rng.normal(size=(n, dim)).astype(np.float32)
    data[n // 2 : n // 2 + n // 3] = data[0]  # a third of the rows are copies
    rows = [
        ((f"v{i:05d}" if string_ids else i), [float(x) for x in v], "g%d" % (0 if i % 3 else i % groups))
        for i, v in enumerate(data)
    ]
    kind = "string" if string_ids else "long"
    return spark.createDataFrame(rows, f"id {kind}, embedding array<float>, grp string"), data


def brute_force(ids, data, queries, k, allowed=None):
    unit = data.astype(np.float64)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    out = {}
    for q in queries:
        scores = np.round(unit @ unit[q], 6)
        pool = [i for i in range(len(ids)) if allowed is None or allowed(q, i)]
        out[ids[q]] = [ids[i] for i in sorted(pool, key=lambda i: (-scores[i], ids[i]))[:k]]
    return out


def collected(frame, query_id="qid", item_id="id"):
    out = {}
    for row in sorted(frame.collect(), key=lambda r: (r[query_id], r["rank"])):
        out.setdefault(row[query_id], []).append(row[item_id])
    return out


@pytest.mark.parametrize("strategy", ["broadcast", "blocks"])
@pytest.mark.parametrize("string_ids", [False, True])
def test_matches_brute_force(spark, monkeypatch, strategy, string_ids):
    monkeypatch.setattr(nearest_module, "QUERY_BLOCK_ROWS", 40)
    monkeypatch.setattr(nearest_module, "ITEM_BLOCK_ROWS", 70)
    monkeypatch.setattr(nearest_module, "MIN_ITEM_BLOCK_ROWS", 50)
    items, data = make_vectors(spark, string_ids=string_ids)
    queries = items.select(F.col("id").alias("qid"), F.col("embedding").alias("query_embedding"))
    got = nearest(
        queries, items.repartition(5), 7, query_id="qid", item_id="id", strategy=strategy
    )
    ids = [r["id"] for r in items.select("id").collect()]
    assert collected(got) == brute_force(ids, data, range(len(ids)), 7)


@pytest.mark.parametrize("strategy", ["broadcast", "blocks"])
def test_groups_and_self_exclusion(spark, monkeypatch, strategy):
    monkeypatch.setattr(nearest_module, "QUERY_BLOCK_ROWS", 30)
    monkeypatch.setattr(nearest_module, "ITEM_BLOCK_ROWS", 50)
    items, data = make_vectors(spark)
    grp = {r["id"]: r["grp"] for r in items.collect()}
    queries = items.select(
        F.col("id").alias("qid"), F.col("embedding").alias("query_embedding"), "grp"
    )
    got = nearest(
        queries, items.repartition(3), 5, query_id="qid", item_id="id", on="grp",
        exclude_self=True, strategy=strategy,
    )
    expected = brute_force(
        list(range(len(data))), data, range(len(data)), 5,
        lambda q, i: grp[q] == grp[i] and q != i,
    )
    assert collected(got) == {q: v for q, v in expected.items() if v}


def test_k_larger_than_corpus_returns_everything(spark):
    items, _ = make_vectors(spark, n=9)
    queries = items.limit(2).select(
        F.col("id").alias("qid"), F.col("embedding").alias("query_embedding")
    )
    assert nearest(queries, items, 50, query_id="qid", item_id="id").count() == 18


def test_empty_sides(spark):
    items, _ = make_vectors(spark, n=9)
    queries = items.select(F.col("id").alias("qid"), F.col("embedding").alias("query_embedding"))
    none = items.filter("false")
    for strategy in ("broadcast", "blocks"):
        assert nearest(queries, none, 3, query_id="qid", item_id="id", strategy=strategy).count() == 0
        assert (
            nearest(queries.filter("false"), items, 3, query_id="qid", item_id="id", strategy=strategy).count()
            == 0
        )


def test_zero_vector_scores_zero(spark):
    items = spark.createDataFrame([(1, [0.0, 0.0]), (2, [3.0, 4.0])], "id long, embedding array<float>")
    queries = spark.createDataFrame([(9, [6.0, 8.0])], "qid long, query_embedding array<float>")
    rows = nearest(queries, items, 2, query_id="qid", item_id="id").orderBy("rank").collect()
    assert [(r["id"], r["score"]) for r in rows] == [(2, 1.0), (1, 0.0)]


def test_floor_keeps_every_better_item(monkeypatch):
    monkeypatch.setattr(nearest_module, "_ITEM_STRIPE", 16)
    monkeypatch.setattr(nearest_module, "_QUERY_STRIPE", 4)
    rng = np.random.default_rng(8)
    for trial in range(30):
        items = np.round(rng.normal(size=(rng.integers(1, 90), 3)), 1)
        if trial % 3 == 0:
            items = items[np.argsort(items @ np.ones(3))]  # better items come last
        if trial % 4 == 0:
            items[: len(items) // 2] = items[0]
        queries = np.vstack([np.ones((1, 3)), rng.normal(size=(9, 3))])
        ids = rng.permutation(len(items))
        got = nearest_module._block_top(items, ids, queries, np.arange(10), 5)
        scores = np.rint(queries @ items.T * nearest_module.SCORE_SCALE).astype(int)
        for q in range(10):
            want = sorted(zip(-scores[q], ids))[:5]
            mine = got[got["row"] == q]
            assert list(zip(-mine["score"], mine["item"])) == want


def test_items_are_not_cut_when_queries_give_enough_tasks(spark):
    """Each item block gives every query k candidates, so their number must not follow the cores."""
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(rng.normal(size=(7_000, 4)))]
    items = spark.createDataFrame(rows, "id long, embedding array<float>")
    queries = items.select(F.col("id").alias("qid"), F.col("embedding").alias("query_embedding"))
    made = nearest(queries, items, 5, query_id="qid", item_id="id", strategy="blocks")
    assert made.count() == 5 * 7_000
    fields = [made.schema[c] for c in ("qid", "id", "score")]
    candidates = nearest_module._blocked(
        queries, items, [], "qid", "id", nearest_module.T.StructType(fields), [f.name for f in fields],
        nearest_module._arrow_types(fields),
        lambda t: nearest_module.unit_rows(nearest_module.to_matrix(t.column("query_embedding"))),
        lambda t: nearest_module.unit_rows(nearest_module.to_matrix(t.column("embedding"))),
        5, "query_embedding", nearest_module.Products(),
    )
    assert candidates.count() == 5 * 7_000


def test_a_stripe_holds_a_few_times_its_results():
    """Random scores enter slowly once floors rise with every trim."""
    rng = np.random.default_rng(6)
    best, scores = nearest_module._Best(20, 50), rng.normal(size=(20, 40_000))
    most = 0
    for at in range(0, 40_000, 1_000):
        best.add(scores[:, at : at + 1_000].copy(), at)
        most = max(most, best.held)
    rows, _, found = best.result()
    rounded = np.rint(scores * nearest_module.SCORE_SCALE)
    for row in range(20):
        assert found[rows == row].tolist() == sorted(range(40_000), key=lambda i: (-rounded[row, i], i))[:50]
    assert most <= 2 * nearest_module.TRIM_ABOVE * 50 * 20


@pytest.mark.parametrize("grouped", [False, True])
def test_blocks_take_any_column_names(spark, grouped):
    """The graph names its queries _q; the grid's own columns must not meet those names."""
    items, data = make_vectors(spark, n=60)
    items = items.withColumnRenamed("id", "_i")
    queries = items.select(F.col("_i").alias("_q"), F.col("embedding").alias("_qb"), "grp")
    got = nearest(
        queries if grouped else queries.drop("grp"), items.withColumnRenamed("embedding", "_ib"), 5, query_id="_q",
        query_vector="_qb", item_id="_i", item_vector="_ib", on="grp" if grouped else None, strategy="blocks",
    )
    groups = [r["grp"] for r in items.orderBy("_i").collect()]
    same = (lambda q, i: groups[q] == groups[i]) if grouped else None
    assert collected(got, "_q", "_i") == brute_force(list(range(60)), data, range(60), 5, same)


@pytest.mark.parametrize("kind", ["vectors", "signs", "codes", "cells"])
def test_only_items_that_may_win_are_scored_in_double_precision(monkeypatch, kind):
    """Products in single precision leave few pairs; the result is that of all scores, ties included."""
    from lodestone.operators.ann import PqCodec, SignScores, TableScores

    monkeypatch.setattr(nearest_module, "_ITEM_STRIPE", 64)
    monkeypatch.setattr(nearest_module, "RUN_BYTES", 4 * 64 * 12 * 5)
    rng = np.random.default_rng(4)
    vectors, queries = rng.normal(size=(3_000, 12)), rng.normal(size=(40, 12))
    vectors[:600] = vectors[0]
    items, scorer = vectors, nearest_module.Products()
    if kind == "signs":
        queries, scorer = np.sign(queries), SignScores(12)
        items = np.packbits(vectors > 0, axis=1)
    elif kind != "vectors":
        books, centroids = rng.normal(size=(4, 16, 3)), rng.normal(size=(5, 12)) if kind == "cells" else None
        scorer = TableScores(books, centroids)
        items = scorer.places(PqCodec(books).encode(vectors), None if centroids is None else rng.integers(0, 5, 3_000))
    ids = rng.permutation(3_000)
    scores = np.rint(scorer.scores(scorer.prepare(queries), items) * nearest_module.SCORE_SCALE).astype(int)
    whole, scored = scorer.scores, []
    monkeypatch.setattr(scorer, "scores", lambda p, i: scored.append(len(i)) or whole(p, i), raising=False)
    got = nearest_module._block_top(items, ids, queries, np.arange(40), 7, scorer)
    for q in range(40):
        mine = got[got["row"] == q]
        assert list(zip(-mine["score"], mine["item"])) == sorted(zip(-scores[q], ids))[:7]
    assert sum(scored) < 1_000


def test_overlap_by_kind_runs_no_search_twice(spark):
    from lodestone.operators.metrics import result_overlap

    runs = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            runs.add(batch.num_rows)
            yield batch

    rows = [(q, i, i + 1) for q in range(4) for i in range(3)]
    truth = spark.createDataFrame(rows, "query_id long, chunk_id long, rank int").coalesce(1)
    found = truth.filter("chunk_id < 2").withColumn("kind", F.lit("a")).unionByName(
        truth.selectExpr("query_id", "chunk_id + 9 as chunk_id", "rank", "'b' as kind")
    )
    truth, found = (f.mapInArrow(counted, f.schema) for f in (truth, found))
    got = result_overlap(truth, found, k=3, by="kind").orderBy("kind").collect()
    assert [(r["kind"], r["hits"], r["expected"]) for r in got] == [("a", 8, 12), ("b", 0, 12)]
    assert runs.value == 12 + 20
