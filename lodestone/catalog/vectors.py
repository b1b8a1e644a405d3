"""Vector queries over ``embeddings``: every vector is both item and query."""

from __future__ import annotations

import uuid
from functools import reduce

import numpy as np
from pyspark.sql import functions as F

from lodestone.catalog.registry import query, table
from lodestone.config import SearchConfig
from lodestone.functions.vectors import l2_normalize, norm_stats, unit_double, unit_rows
from lodestone.operators.ann import assign_cells, build_index
from lodestone.operators.lineage import checkpointed, shared_folder
from lodestone.operators.metrics import METRICS, result_overlap, retrieval_metrics
from lodestone.operators.nearest import nearest
from lodestone.operators.rank import parent_rank, top_per_group_merged
from lodestone.plans.search import retrieve_own_language
from lodestone.sources.index_store import append_items, compact, load_index, save_index

IDS = {"query_id": "query_id", "item_id": "vec_id"}
BITS = 128
PARTS = 8
PROBES = 3

# Unit vectors in double precision.
UNIT = """v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
u AS (SELECT vec_id, label, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) AS e FROM v)"""

PAIRS = """pairs AS (
  SELECT q.vec_id AS query_id, q.label AS query_label, i.vec_id, i.label,
         round(list_dot_product(q.e, i.e), 6) + 0.0 AS score
  FROM u q CROSS JOIN u i)"""

# Cells: the normalised mean vector of every label, over the whole table.
CELLS = """m AS (
  SELECT label, pos, avg(x) AS x
  FROM (SELECT label, unnest(e) AS x, generate_subscripts(e, 1) AS pos FROM u) GROUP BY label, pos),
raw AS (SELECT label AS cell, list(x ORDER BY pos) AS c FROM m GROUP BY label),
cells AS (SELECT cell, c AS mean, list_transform(c, lambda x: x / sqrt(list_dot_product(c, c))) AS c FROM raw)"""

ASSIGNED = """ranked AS (
  SELECT u.vec_id, u.e, cell, c, row_number() OVER (
    PARTITION BY u.vec_id ORDER BY list_dot_product(u.e, c) DESC, cell) AS place
  FROM u CROSS JOIN cells),
assigned AS (SELECT vec_id, e, cell, c FROM ranked WHERE place = 1)"""


def top(source: str, k: int = 10, where: str = "") -> str:
    return f"""SELECT query_id, vec_id, score, rank::INTEGER AS rank FROM (
  SELECT query_id, vec_id, score,
         row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank
  FROM {source} {where}) WHERE rank <= {k}"""


def vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings")


def as_queries(items, *extra):
    return items.select(
        F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_embedding"), *extra
    )


def label_means(items) -> np.ndarray:
    """Mean unit vector per label."""
    return mean_by_label(items.select("label", unit_double(F.col("embedding")).alias("e")))


def mean_by_label(frame) -> np.ndarray:
    """Mean of ``e`` per label: only one vector per label reaches the driver."""
    means = (
        frame.select("label", F.posexplode("e").alias("pos", "x"))
        .groupBy("label", "pos").agg(F.avg("x").alias("x"))
        .groupBy("label").agg(F.array_sort(F.collect_list(F.struct("pos", "x"))).alias("m"))
        .orderBy("label").select(F.transform("m", lambda s: s["x"]).alias("m"))
    )
    return np.array([row["m"] for row in means.collect()])


@query(
    """SELECT count(*) AS vectors, round(min(n), 6) AS min_norm, round(max(n), 6) AS max_norm,
       round(avg(n), 6) AS mean_norm
FROM (SELECT sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) AS n FROM embeddings)"""
)
def vec_norm_stats(spark, sf_dir):
    stats = norm_stats(vectors(spark, sf_dir))
    return stats.select("vectors", *[F.round(c, 6).alias(c) for c in ("min_norm", "max_norm", "mean_norm")])


@query(
    """WITH scaled AS (
  SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE * label) AS e FROM embeddings),
n AS (SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS norm FROM scaled)
SELECT vec_id, pos, round((x / CASE WHEN norm = 0 THEN 1 ELSE norm END)::FLOAT::DOUBLE, 5) + 0.0 AS x
FROM (SELECT vec_id, norm, unnest(e) AS x, generate_subscripts(e, 1)::INTEGER AS pos FROM n)"""
)
def vec_l2_normalize(spark, sf_dir):
    """Vectors scaled by their label; label 0 gives zero vectors, which stay zero."""
    scaled = vectors(spark, sf_dir).select(
        "vec_id",
        F.transform("embedding", lambda x: x.cast("double") * F.col("label")).alias("e"),
    )
    unit = scaled.select("vec_id", F.posexplode(l2_normalize(F.col("e"))).alias("pos", "x"))
    return unit.select(
        "vec_id", (F.col("pos") + 1).alias("pos"),
        (F.round(F.col("x").cast("double"), 5) + 0.0).alias("x"),
    )


@query(f"WITH {UNIT}, {PAIRS} {top('pairs')}")
def flat_topk(spark, sf_dir):
    items = vectors(spark, sf_dir)
    return nearest(as_queries(items), items, 10, **IDS)


@query(f"WITH {UNIT}, {PAIRS} {top('pairs', 10, 'WHERE query_label = label')}")
def language_filter_topk(spark, sf_dir):
    """Search restricted to the query's own partition (label plays the language)."""
    items = vectors(spark, sf_dir)
    return nearest(as_queries(items, "label"), items, 10, on="label", **IDS).drop("label")


@query(
    f"""WITH {UNIT}, {PAIRS}, share AS (SELECT greatest(1, 50 // count(DISTINCT label)) AS n FROM embeddings),
best AS (SELECT * FROM (SELECT *, row_number() OVER (
    PARTITION BY query_id, label ORDER BY score DESC, vec_id) AS place FROM pairs)
  WHERE place <= (SELECT n FROM share))
{top('best', 50)}"""
)
def partitioned_topk_merge(spark, sf_dir):
    """Every partition is searched for its share, then the shares are merged."""
    items = vectors(spark, sf_dir)
    return top_per_group_merged(as_queries(items), items, 50, "label", **IDS).drop("label")


PARENT_RANKS = f"""WITH {UNIT}, {PAIRS},
hits AS ({top('pairs', 50, 'WHERE query_id <> vec_id')}),
firsts AS (
  SELECT query_id, i.label AS parent, min(rank) AS first_rank
  FROM hits JOIN embeddings i USING (vec_id) GROUP BY query_id, i.label),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY first_rank, parent) AS place FROM firsts),
ranks AS (
  SELECT q.vec_id AS query_id, q.label, coalesce(p.place::DOUBLE, 'Infinity'::DOUBLE) AS rank
  FROM embeddings q LEFT JOIN placed p
    ON p.query_id = q.vec_id AND p.parent = q.label AND p.place <= 10)"""


def label_ranks(spark, sf_dir):
    items = vectors(spark, sf_dir)
    found = nearest(as_queries(items), items, 50, exclude_self=True, **IDS)
    results = found.join(items.select("vec_id", F.col("label").alias("parent_id")), "vec_id")
    relevant = items.select(
        F.col("vec_id").alias("query_id"), F.col("label").alias("relevant_parent")
    )
    return parent_rank(results, relevant)


@query(
    f"""{PARENT_RANKS} SELECT query_id, label AS relevant_parent,
CASE WHEN isinf(rank) THEN NULL ELSE rank END AS rank FROM ranks"""
)
def parent_rank_by_label(spark, sf_dir):
    """Rank of the query's own label among distinct labels; a miss shows as NULL."""
    ranks = label_ranks(spark, sf_dir)
    return ranks.withColumn("rank", F.when(F.col("rank") != float("inf"), F.col("rank")))


METRIC_SQL = """round(avg((rank <= 1)::INT), 6) AS recall_at_1, round(avg((rank <= 5)::INT), 6) AS recall_at_5,
round(avg((rank <= 10)::INT), 6) AS recall_at_10, round(avg(1.0::DOUBLE / rank), 6) AS mrr,
round(avg(CASE WHEN rank <= 10 THEN 1.0::DOUBLE / log2(rank + 1) ELSE 0 END), 6) AS ndcg_at_10"""


@query(
    f"""{PARENT_RANKS} SELECT label::VARCHAR AS language, count(*) AS queries, {METRIC_SQL} FROM ranks GROUP BY label
UNION ALL SELECT 'overall', count(*), {METRIC_SQL} FROM ranks"""
)
def retrieval_metrics_by_label(spark, sf_dir):
    ranks = label_ranks(spark, sf_dir).withColumnRenamed("relevant_parent", "language")
    return retrieval_metrics(ranks).select(
        "language", "queries", *[F.round(m, 6).alias(m) for m in METRICS]
    )


# Every index kind below scores all (query, item) pairs it may return.
PROBED = f"""probed AS (SELECT vec_id AS query_id, e, cell FROM ranked WHERE place <= {PROBES})"""

IVF_FLAT = f"""ivf_flat AS (
  SELECT q.query_id, a.vec_id, round(list_dot_product(q.e, a.e), 6) + 0.0 AS score
  FROM probed q JOIN assigned a USING (cell))"""

# Half precision keeps 11 significant bits, and 24 fractional bits near zero.
HALF = "(2.0 ** (greatest(floor(log2(abs(x - c[i]))), -14) - 10))"
IVF_SQ = f"""halves AS (
  SELECT vec_id, cell, list_transform(e, lambda x, i: c[i] +
    CASE WHEN x = c[i] THEN 0 ELSE round_even((x - c[i]) / {HALF}, 0) * {HALF} END) AS d
  FROM assigned),
ivf_sq AS (
  SELECT q.query_id, a.vec_id, round(list_dot_product(q.e, a.d), 6) + 0.0 AS score
  FROM probed q JOIN halves a USING (cell))"""


def coded(name: str, source: str, words: str) -> str:
    """Product-quantised copy ``name`` of ``source(vec_id, r)`` with codewords ``words(word, c)``."""
    width = 64 // PARTS
    return f"""{name}_books AS (
  SELECT part, word, list_slice(c, part * {width} + 1, part * {width} + {width}) AS w
  FROM {words} CROSS JOIN range({PARTS}) t(part)),
{name}_near AS (
  SELECT vec_id, part, w, row_number() OVER (PARTITION BY vec_id, part ORDER BY list_sum(
    list_transform(w, lambda x, i: (x - r[part * {width} + i]) ** 2)), word) AS place
  FROM {source} CROSS JOIN {name}_books),
{name}_codes AS (
  SELECT vec_id, flatten(list(w ORDER BY part)) AS d FROM {name}_near WHERE place = 1 GROUP BY vec_id)"""


PQ = f"""pq_words AS (SELECT cell AS word, mean AS c FROM cells),
pq_rows AS (SELECT vec_id, e AS r FROM u),
{coded('pq', 'pq_rows', 'pq_words')},
pq AS (
  SELECT q.vec_id AS query_id, a.vec_id, round(list_dot_product(q.e, a.d), 6) + 0.0 AS score
  FROM u q CROSS JOIN pq_codes a)"""

IVF_PQ = f"""rest AS (SELECT vec_id, cell, c, list_transform(e, lambda x, i: x - c[i]) AS r FROM assigned),
rest_means AS (
  SELECT label, pos, avg(x) AS x FROM (
    SELECT label, unnest(r) AS x, generate_subscripts(r, 1) AS pos FROM rest JOIN u USING (vec_id))
  GROUP BY label, pos),
rest_words AS (SELECT label AS word, list(x ORDER BY pos) AS c FROM rest_means GROUP BY label),
{coded('rest', 'rest', 'rest_words')},
ivf_pq AS (
  SELECT q.query_id, a.vec_id,
         round(list_dot_product(q.e, list_transform(d, lambda x, i: x + c[i])), 6) + 0.0 AS score
  FROM probed q JOIN rest a USING (cell) JOIN rest_codes USING (vec_id))"""

LSH = f"""planes AS (
  SELECT bit, list(sqrt(-2 * ln((('0x' || substr(h, 1, 8))::BIGINT + 1) / 4294967297.0::DOUBLE))
      * cos(2 * pi() * (('0x' || substr(h, 9, 8))::BIGINT / 4294967296.0::DOUBLE)) ORDER BY axis) AS g
  FROM (SELECT bit, axis, md5(bit || ':' || axis) AS h
        FROM range({BITS}) b(bit) CROSS JOIN range(64) a(axis)) GROUP BY bit),
signs AS (
  SELECT vec_id, string_agg(CASE WHEN list_dot_product(e, g) > 0 THEN '1' ELSE '0' END, '' ORDER BY bit) AS s
  FROM u CROSS JOIN planes GROUP BY vec_id),
lsh AS (
  SELECT q.vec_id AS query_id, i.vec_id, (0 - hamming(q.s, i.s))::DOUBLE AS score
  FROM signs q CROSS JOIN signs i)"""

CELLED = f"{UNIT}, {CELLS}, {ASSIGNED}, {PROBED}"


def label_index(items, kind, means=None):
    """An index whose models are the label means, so SQL can rebuild it."""
    means = label_means(items) if means is None else means
    options = {"item_id": "vec_id", "nprobe": PROBES, "centroids": unit_rows(means)}
    if kind == "pq":
        options["codebooks"] = split_words(means)
    elif kind == "ivf_pq":
        options["codebooks"] = split_words(residual_means(items, options["centroids"]))
    elif kind == "lsh":
        options["lsh_nbits"] = BITS
    return build_index(items, kind, **options)


def split_words(means) -> np.ndarray:
    return means.reshape(len(means), PARTS, -1).transpose(1, 0, 2)


def residual_means(items, centroids) -> np.ndarray:
    """Mean residual per label after subtracting each item's own centroid."""
    cells = items.sparkSession.createDataFrame(
        [(i, [float(x) for x in c]) for i, c in enumerate(centroids)], "cell int, c array<double>"
    )
    rest = (
        assign_cells(items, centroids)
        .withColumn("e", unit_double(F.col("embedding")))
        .join(F.broadcast(cells), "cell")
        .select("label", F.zip_with("e", "c", lambda a, b: a - b).alias("e"))
    )
    return mean_by_label(rest)


def search_all(spark, sf_dir, kind):
    items = vectors(spark, sf_dir)
    return label_index(items, kind).search(as_queries(items), 10)


@query(f"WITH {CELLED}, {IVF_FLAT} {top('ivf_flat')}")
def ivf_flat_topk(spark, sf_dir):
    return search_all(spark, sf_dir, "ivf_flat")


@query(f"WITH {CELLED}, {IVF_SQ} {top('ivf_sq')}")
def ivf_sq_topk(spark, sf_dir):
    return search_all(spark, sf_dir, "ivf_sq")


@query(f"WITH {CELLED}, {IVF_PQ} {top('ivf_pq')}")
def ivf_pq_topk(spark, sf_dir):
    return search_all(spark, sf_dir, "ivf_pq")


@query(f"WITH {UNIT}, {CELLS}, {PQ} {top('pq')}")
def pq_topk(spark, sf_dir):
    return search_all(spark, sf_dir, "pq")


@query(f"WITH {UNIT}, {LSH} {top('lsh')}")
def lsh_hamming_topk(spark, sf_dir):
    return search_all(spark, sf_dir, "lsh")


@query(
    """SELECT count(*) AS queries, count(*) * least(count(*), 10) AS result_rows, true AS finds_nine_in_ten
FROM embeddings"""
)
def hnsw_topk(spark, sf_dir):
    """Layered graph search with a beam far narrower than the table: rows and recall against the exact top ten."""
    items = vectors(spark, sf_dir)
    index = build_index(items, "hnsw", item_id="vec_id", hnsw_m=16, hnsw_ef_search=64)
    found = checkpointed(index.search(as_queries(items), 10))
    truth = nearest(as_queries(items), items, 10, **IDS)
    rows = found.agg(F.countDistinct("query_id").alias("queries"), F.count("*").alias("result_rows"))
    recall = result_overlap(truth, found, item_id="vec_id")
    return rows.withColumn("_one", F.lit(1)).join(
        recall.select(F.lit(1).alias("_one"), (F.col("recall") >= 0.9).alias("finds_nine_in_ten")), "_one"
    ).drop("_one")


STORED_KINDS = ("flat", "ivf_flat")


@query(
    f"""WITH {UNIT}, {PAIRS}, best AS ({top('pairs')}), k AS (SELECT unnest(['flat', 'ivf_flat']) AS index_type)
SELECT index_type, count(*) AS result_rows, true AS finds_nine_in_ten FROM best, k GROUP BY index_type"""
)
def stored_append_topk(spark, sf_dir):
    """An index of half the labels is stored, the other half appended, and all of it loaded and searched."""
    items = vectors(spark, sf_dir)
    first, second = items.filter("label < 5"), items.filter("label >= 5 OR label IS NULL")
    truth = checkpointed(nearest(as_queries(items), items, 10, **IDS))
    folder = f"{shared_folder(spark)}/stored-{uuid.uuid4().hex}"
    out = []
    for kind in STORED_KINDS:
        means = unit_rows(label_means(items)) if kind == "ivf_flat" else None
        index = build_index(first, kind, item_id="vec_id", centroids=means, nprobe=10)
        save_index(index, f"{folder}/{kind}")
        append_items(spark, f"{folder}/{kind}", second)
        found = checkpointed(load_index(spark, f"{folder}/{kind}").search(as_queries(items), 10))
        rows = found.agg(F.count("*").alias("result_rows")).withColumn("index_type", F.lit(kind))
        recall = result_overlap(truth, found, item_id="vec_id")
        out.append(
            rows.join(
                recall.select(F.lit(kind).alias("index_type"), (F.col("recall") >= 0.9).alias("finds_nine_in_ten")),
                "index_type",
            )
        )
    return reduce(lambda a, b: a.unionByName(b), out)


@query(
    """WITH n AS (SELECT count(*) AS whole, count(*) FILTER (WHERE label < 5) AS half FROM embeddings)
SELECT 'stored' AS step, half AS items, CAST(1 AS BIGINT) AS segments, half AS found FROM n
UNION ALL SELECT 'interrupted', half, 1, half FROM n
UNION ALL SELECT 'appended', whole, 2, whole FROM n
UNION ALL SELECT 'compacted', whole, 1, whole FROM n"""
)
def stored_versions(spark, sf_dir):
    """Half of the vectors stored, replaced by a write that stops half-way, the rest appended, segments joined.

    found: vectors that an exact search of the stored index gives as the best for themselves.
    """
    items = vectors(spark, sf_dir)
    first, second = items.filter("label < 5"), items.filter("label >= 5 OR label IS NULL")
    path = f"{shared_folder(spark)}/versions-{uuid.uuid4().hex}"

    def state(step):
        index = load_index(spark, path)
        best = index.search(as_queries(items), 1).filter(F.col("query_id") == F.col("vec_id"))
        return checkpointed(index.items.agg(F.count("*").alias("items")).crossJoin(best.agg(F.count("*").alias("found"))).select(
            F.lit(step).alias("step"), "items", F.lit(len(index.options["segments"])).cast("bigint").alias("segments"), "found"
        ))

    save_index(build_index(first, "flat", item_id="vec_id"), path)
    out = [state("stored")]
    try:  # the edges, written after the items, can't be read
        broken = build_index(second, "flat", item_id="vec_id")
        broken.edges = spark.range(1).select(F.raise_error(F.lit("stopped")).alias("node"))
        save_index(broken, path)
    except Exception as stopped:
        if "stopped" not in str(stopped):
            raise
    out.append(state("interrupted"))
    append_items(spark, path, second)
    out.append(state("appended"))
    compact(spark, path)
    out.append(state("compacted"))
    return reduce(lambda a, b: a.unionByName(b), out)


def grown_graph(spark, sf_dir):
    """A graph of half the labels, stored, and grown by the other half. Its lists before, the loaded index, and all items."""
    items = vectors(spark, sf_dir)
    path = f"{shared_folder(spark)}/grown-{uuid.uuid4().hex}"
    save_index(build_index(items.filter("label < 5"), "hnsw", item_id="vec_id", hnsw_m=16, hnsw_ef_search=64), path)
    before = load_index(spark, path).edges
    append_items(spark, path, items.filter("label >= 5 OR label IS NULL"))
    return before, load_index(spark, path), items


@query(
    """WITH n AS (SELECT count(*) AS whole FROM embeddings)
SELECT whole AS items, CAST(2 AS BIGINT) AS segments, whole * least(whole, 10) AS result_rows, true AS no_list_over_twice_m,
       true AS no_list_lost, true AS finds_nine_in_ten FROM n"""
)
def graph_append_topk(spark, sf_dir):
    """Search of a stored graph that grew by an append, against the exact top ten."""
    before, index, items = grown_graph(spark, sf_dir)
    found = checkpointed(index.search(as_queries(items), 10))
    truth = nearest(as_queries(items), items, 10, **IDS)
    lists = index.edges.agg((F.max(F.size("links")) <= 32).alias("no_list_over_twice_m"))
    lost = before.join(index.edges, ["level", "src"], "left_anti").agg((F.count("*") == 0).alias("no_list_lost"))
    recall = result_overlap(truth, found, item_id="vec_id").select((F.col("recall") >= 0.9).alias("finds_nine_in_ten"))
    # Every side is one row.
    return (
        index.items.agg(F.count("*").alias("items"))
        .withColumn("segments", F.lit(len(index.options["segments"])).cast("bigint"))
        .crossJoin(found.agg(F.count("*").alias("result_rows")))
        .crossJoin(lists).crossJoin(lost).crossJoin(recall)
    )


#: Kinds with trained models, their options, candidates for each result and the recall of the exact top ten that they must reach.
TRAINED = {
    "ivf_flat": ({"nlist": 16, "nprobe": 12}, 1, 0.9),
    "pq": ({"pq_m": 16, "pq_bits": 6}, 8, 0.9),
    "ivf_pq": ({"nlist": 16, "nprobe": 12, "pq_m": 16, "pq_bits": 6}, 8, 0.9),
}


@query(
    f"""WITH {UNIT}, {PAIRS}, best AS ({top('pairs')}), k AS (SELECT unnest({list(TRAINED)}) AS index_type)
SELECT index_type, count(*) AS result_rows, true AS reaches_floor FROM best, k GROUP BY index_type"""
)
def trained_index_recall(spark, sf_dir):
    """Inverted files and quantisers whose models are trained on all vectors."""
    items = vectors(spark, sf_dir)
    truth = checkpointed(nearest(as_queries(items), items, 10, **IDS))
    out = []
    for kind, (options, refine, floor) in TRAINED.items():
        index = build_index(items, kind, item_id="vec_id", **options)
        found = checkpointed(index.search(as_queries(items), 10, refine=refine))
        recall = result_overlap(truth, found, item_id="vec_id")
        out.append(
            found.agg(F.count("*").alias("result_rows")).withColumn("index_type", F.lit(kind)).join(
                recall.select(F.lit(kind).alias("index_type"), (F.col("recall") >= floor).alias("reaches_floor")), "index_type"
            )
        )
    return reduce(lambda a, b: a.unionByName(b), out)


FILTER_KINDS = ("flat", "hnsw", "ivf_flat", "ivf_sq")


@query(
    f"""WITH sizes AS (SELECT label, count(*) AS n FROM embeddings GROUP BY label),
k AS (SELECT unnest([{', '.join(f"'{kind}'" for kind in FILTER_KINDS)}]) AS index_type)
SELECT index_type, CAST(sum(n * least(n, 10)) AS BIGINT) AS result_rows, true AS own_label_only, true AS finds_nine_in_ten
FROM sizes, k GROUP BY index_type"""
)
def language_filter_kinds(spark, sf_dir):
    """Every vector searched among those of its own label, by each kind of index.

    The beam of the graph is far narrower than a label, and the inverted files
    visit eight of their ten cells, so recall is compared with a floor, and rows must be complete.
    """
    items = vectors(spark, sf_dir).withColumn("language", F.col("label").cast("string"))
    queries = as_queries(items, "language")
    config = SearchConfig(retrieval_top_k=10)
    truth = checkpointed(nearest(queries, items, 10, on="language", **IDS).drop("language"))
    known = items.select(F.col("vec_id"), F.col("language").alias("found"))
    asked = queries.select("query_id", F.col("language").alias("wanted"))
    out = []
    for kind in FILTER_KINDS:
        means = label_means(items) if kind.startswith("ivf") else None
        index = build_index(
            items, kind, item_id="vec_id", hnsw_m=16, hnsw_ef_search=48, nprobe=8,
            centroids=None if means is None else unit_rows(means),
        )
        found = checkpointed(retrieve_own_language(queries, index, config))
        placed = found.join(known, "vec_id").join(asked, "query_id")
        out.append(
            placed.agg(F.count("*").alias("result_rows"), F.bool_and(F.col("found") == F.col("wanted")).alias("own_label_only"))
            .withColumn("index_type", F.lit(kind))
            .join(
                result_overlap(truth, found, item_id="vec_id").select(
                    F.lit(kind).alias("index_type"), (F.col("recall") >= 0.9).alias("finds_nine_in_ten")
                ),
                "index_type",
            )
        )
    return reduce(lambda a, b: a.unionByName(b), out)


RECALL_KINDS = {"ivf_flat": IVF_FLAT, "ivf_sq": IVF_SQ, "ivf_pq": IVF_PQ, "pq": PQ, "lsh": LSH}


def recall_sql() -> str:
    rows = " UNION ALL ".join(
        f"""SELECT '{kind}' AS index_type, count(*) AS expected, count(f.vec_id) AS hits,
        round(count(f.vec_id) / count(*), 6) AS recall
        FROM truth t LEFT JOIN ({top(kind)}) f ON t.query_id = f.query_id AND t.vec_id = f.vec_id"""
        for kind in RECALL_KINDS
    )
    return f"WITH {CELLED}, {PAIRS}, truth AS ({top('pairs')}), {', '.join(RECALL_KINDS.values())} {rows}"


@query(recall_sql())
def ann_recall_vs_flat(spark, sf_dir):
    """Share of the exact top ten that each approximate index finds, over all vectors."""
    items = vectors(spark, sf_dir)
    means = label_means(items)
    truth = nearest(as_queries(items), items, 10, **IDS)
    found = [
        label_index(items, kind, means).search(as_queries(items), 10)
        .withColumn("index_type", F.lit(kind))
        for kind in RECALL_KINDS
    ]
    every = reduce(lambda a, b: a.unionByName(b), found)
    recall = result_overlap(truth, every, item_id="vec_id", by="index_type")
    return recall.withColumn("recall", F.round("recall", 6))


#: Candidates that a search by codes gives for each result of its exact second pass.
REFINED = {"pq": 20, "lsh": 20}


def refined_sql() -> str:
    rows = " UNION ALL ".join(
        f"""SELECT '{kind}' AS index_type, count(*) AS expected, count(f.vec_id) AS hits,
        round(count(f.vec_id) / count(*), 6) AS recall
        FROM truth t LEFT JOIN ({top(f'{kind}_again')}) f ON t.query_id = f.query_id AND t.vec_id = f.vec_id"""
        for kind in REFINED
    )
    again = ", ".join(
        f"{kind}_again AS (SELECT p.* FROM pairs p SEMI JOIN ({top(kind, 10 * times)}) c USING (query_id, vec_id))"
        for kind, times in REFINED.items()
    )
    return f"WITH {UNIT}, {CELLS}, {PAIRS}, truth AS ({top('pairs')}), {PQ}, {LSH}, {again} {rows}"


@query(refined_sql())
def refined_recall(spark, sf_dir):
    """Share of the exact top ten found when candidates by codes are scored again exactly, over all vectors."""
    items = vectors(spark, sf_dir)
    means = label_means(items)
    truth = nearest(as_queries(items), items, 10, **IDS)
    found = [
        label_index(items, kind, means).search(as_queries(items), 10, refine=times)
        .withColumn("index_type", F.lit(kind))
        for kind, times in REFINED.items()
    ]
    recall = result_overlap(truth, reduce(lambda a, b: a.unionByName(b), found), item_id="vec_id", by="index_type")
    return recall.withColumn("recall", F.round("recall", 6))
