"""Registered queries of the operators: each reads whole tables and derives the digest columns."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import (
    decontamination,
    hosts,
    licenses,
    packing,
    prefix_trie,
    repetition,
    secrets,
    sharding,
    simhash,
    suffix_dedup,
    token_totals,
    warc,
    whitening,
)
from lodestone.operators.lineage import shared_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(function):
    QUERIES[function.__name__] = function
    return function


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    frame = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return frame.select(*columns) if columns else frame


@query
def op10_suffix_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repetition measures and verdict of every document."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return repetition.with_repetition(docs).drop("text")


@query
def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text")).drop("text_hash")


@query
def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows in every document."""
    found = decontamination.contamination(
        table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "item_id", "text")
    )
    return found.select(
        "doc_id", "n_words", "n_hit",
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        "contaminated",
    )


ORACLES["op1_decontamination"] = r"""
WITH docs AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
items AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(w[p:p + least(len(w), 10) - 1], ' ') AS win
  FROM items, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS t(p) WHERE len(w) > 0),
lengths AS (SELECT DISTINCT n FROM windows),
places AS (
  SELECT doc_id, n, p, array_to_string(w[p:p + n - 1], ' ') AS win
  FROM docs, lengths, unnest(range(1, CAST(len(w) - n + 2 AS BIGINT))) AS t(p) WHERE len(w) >= n),
hits AS (SELECT doc_id, p, n, item FROM places JOIN windows USING (n, win)),
hit_words AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM hits, unnest(range(p, p + n)) AS t(q) GROUP BY doc_id),
hit_items AS (
  SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items_sha256
  FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN hit_words USING (doc_id) LEFT JOIN hit_items USING (doc_id)
"""


@query
def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document."""
    return secrets.with_secrets(table(spark, sf_dir, "documents", "doc_id", "text")).drop("text")


@query
def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences."""
    pieces = packing.packed(table(spark, sf_dir, "documents", "doc_id", "text"))
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


@query
def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and labels of every document."""
    return licenses.with_licenses(table(spark, sf_dir, "documents", "doc_id", "text")).drop("text", "detections")


URL_RULES = [
    hosts.UrlRule("block", "net", "/"),
    hosts.UrlRule("allow", "example.net", "/en/"),
    hosts.UrlRule("block", "example.com", "/de/"),
    hosts.UrlRule("allow", "org", "/fr/"),
]


@query
def op6_host_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's URL judged; a labelled page is bad if its document is toxic or of low quality."""
    labels = table(spark, sf_dir, "labels", "doc_id", "quality", "toxic")
    outcomes = labels.select(
        F.col("doc_id").alias("page_id"), F.when((F.col("toxic") == 1) | (F.col("quality") == 0), 1).otherwise(0).alias("bad")
    )
    return hosts.judge_urls(table(spark, sf_dir, "pages", "page_id", "url"), outcomes, URL_RULES)


_TWO = ", ".join(f"'{suffix}'" for suffix in hosts.TWO_LABEL_SUFFIXES)
ORACLES["op6_host_reputation"] = rf"""
WITH urls AS (
  SELECT page_id,
    CASE WHEN strpos(coalesce(url, ''), '://') = 0 THEN '' ELSE translate(
      regexp_extract(url[strpos(url, '://') + 3:], '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') END AS host,
    CASE WHEN strpos(coalesce(url, ''), '://') = 0 THEN '' ELSE
      regexp_extract(url[strpos(url, '://') + 3:], '^[^/?#]*([^?#]*)', 1) END AS path
  FROM pages),
worst AS (SELECT doc_id AS page_id, max(CASE WHEN toxic = 1 OR quality = 0 THEN 1 ELSE 0 END) AS bad FROM labels GROUP BY doc_id),
parts AS (
  SELECT host, string_split(host, '.')[-1] AS one, array_to_string(string_split(host, '.')[-2:], '.') AS two,
         array_to_string(string_split(host, '.')[-3:], '.') AS three
  FROM (SELECT DISTINCT host FROM urls)),
named AS (
  SELECT host, CASE WHEN two IN ({_TWO}) THEN three ELSE two END AS dom, CASE WHEN two IN ({_TWO}) THEN two ELSE one END AS suf
  FROM parts),
counted AS (SELECT host, CAST(sum(bad) AS DOUBLE) AS x, CAST(count(*) AS DOUBLE) AS n FROM urls JOIN worst USING (page_id) GROUP BY host),
hosts AS (SELECT * FROM counted JOIN named USING (host)),
doms AS (SELECT dom, suf, sum(x) AS x, sum(n) AS n FROM hosts GROUP BY dom, suf),
sufs AS (SELECT suf, sum(x) AS x, sum(n) AS n FROM hosts GROUP BY suf),
moments AS (
  SELECT level, sum(x) / sum(n) AS p, sum(n) AS m, sum(n * n) AS s, sum(x * x / n) - sum(x) * sum(x) / sum(n) AS v, count(*) AS k
  FROM (SELECT 'host' AS level, x, n FROM hosts UNION ALL SELECT 'dom', x, n FROM doms UNION ALL SELECT 'suf', x, n FROM sufs)
  GROUP BY level),
spread AS (SELECT *, CASE WHEN p > 0 AND p < 1 AND m <> s / m THEN (v - (k - 1) * p * (1 - p)) / (m - s / m) END AS t FROM moments),
strength AS (
  SELECT level, p, CASE WHEN t IS NULL OR t <= 0 THEN 10000.0 ELSE least(greatest(p * (1 - p) / t - 1, 2.0), 10000.0) END AS w FROM spread),
suf_rate AS (SELECT suf, (x + w * p) / (n + w) AS r FROM sufs, strength WHERE level = 'suf'),
dom_rate AS (SELECT dom, (x + w * r) / (n + w) AS r FROM doms JOIN suf_rate USING (suf), strength WHERE level = 'dom'),
judged AS (
  SELECT host, CAST(n AS BIGINT) AS host_pages, CAST(x AS BIGINT) AS host_bad,
         q - 1.645 * sqrt(q * (1 - q) / (n + w + 1)) > 0.5 AS blocked
  FROM (
    SELECT host, coalesce(x, 0) AS x, coalesce(n, 0) AS n, w,
           (coalesce(x, 0) + w * coalesce(d.r, s.r, p)) / (coalesce(n, 0) + w) AS q
    FROM named LEFT JOIN counted USING (host) LEFT JOIN dom_rate d USING (dom) LEFT JOIN suf_rate s ON s.suf = named.suf, strength
    WHERE level = 'host')),
ruled AS (
  SELECT *, CASE
    WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') THEN 'net/' END AS rule
  FROM urls)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
            WHEN coalesce(blocked, false) THEN 'block' ELSE 'allow' END AS verdict,
       coalesce(host_pages, 0) AS host_pages, coalesce(host_bad, 0) AS host_bad
FROM ruled LEFT JOIN judged USING (host)
"""


@query
def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to archives, read back and assembled."""
    path = f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    warc.write_archives(table(spark, sf_dir, "pages", "page_id", "url", "html"), path)
    return warc.captures_with_origin(warc.transactions(warc.read_records(spark, path, payload=False)))


ORACLES["op3_warc"] = """
WITH payloads AS (
  SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest
  FROM pages),
origins AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS origin FROM payloads)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id <> origin THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id <> origin THEN origin END AS refers_to
FROM origins
"""


@query
def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in forty shards of near equal bytes."""
    return sharding.sharded(table(spark, sf_dir, "documents", "doc_id", "text"), shards=40)


@query
def op5_token_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token totals after three batches, one of them delivered twice.

    All documents are counted by two tokenizer versions. Then toxic documents are
    deleted, and last, documents that repeat lines are counted anew without the repeats.
    """
    docs = table(spark, sf_dir, "documents", "doc_id", "source", "lang", "text")
    versions = {
        "words-1": token_totals.word_count(F.col("text")), "marks-1": token_totals.word_and_mark_count(F.col("text"))
    }
    rollup = token_totals.TokenTotals(spark, f"{shared_folder(spark)}/token-totals-{uuid.uuid4().hex}")
    rollup.apply("load", token_totals.counted(docs, versions))
    toxic = table(spark, sf_dir, "labels", "doc_id", "toxic").where("toxic = 1").select("doc_id").distinct()
    removed = rollup.ledger().join(toxic, "doc_id", "left_semi").withColumn("deleted", F.lit(True))
    rollup.apply("remove-toxic", removed)
    lines = F.split("text", "\n")
    revised = docs.where(F.size(F.array_distinct(lines)) < F.size(lines)).withColumn(
        "text", F.array_join(F.array_distinct(lines), "\n")
    )
    recount = token_totals.counted(revised, versions).join(toxic, "doc_id", "left_anti")
    for _ in range(2):
        rollup.apply("recount-lines", recount)
    return rollup.totals()


ORACLES["op5_token_totals"] = r"""
WITH lines AS (
  SELECT doc_id, source, lang, text, string_split(text, chr(10)) AS l FROM documents
  WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)),
final AS (
  SELECT source, lang, coalesce(CASE WHEN len(list_distinct(l)) < len(l)
    THEN array_to_string(list_distinct(l), chr(10)) ELSE text END, '') AS text
  FROM lines)
SELECT source, lang, 'words-1' AS version, count(*) AS documents,
       CAST(sum(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+'))) AS BIGINT) AS tokens FROM final GROUP BY source, lang
UNION ALL
SELECT source, lang, 'marks-1', count(*), CAST(sum(len(regexp_extract_all(text,
       '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+|[\x21-\x2F\x3A-\x40\x5B-\x60\x7B-\x7E]'))) AS BIGINT) FROM final GROUP BY source, lang
"""


@query
def op11_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What repeated strings of 400 bytes take from every document."""
    found = suffix_dedup.with_repeats(table(spark, sf_dir, "documents", "doc_id", "text"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


ORACLES["op11_suffix_dedup"] = r"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
places AS (
  SELECT r, p, md5(h[2 * p + 1 : 2 * p + 800]) AS w
  FROM docs, unnest(range(CAST(len(h) / 2 - 399 AS BIGINT))) AS t(p) WHERE len(h) >= 800),
repeated AS (SELECT r, p FROM places WHERE w IN (SELECT w FROM places GROUP BY w HAVING count(*) > 1)),
marked AS (SELECT r, p, CASE WHEN p > lag(p) OVER (PARTITION BY r ORDER BY p) + 400 THEN 1 ELSE 0 END AS jump FROM repeated),
numbered AS (SELECT r, p, sum(jump) OVER (PARTITION BY r ORDER BY p) AS span FROM marked),
spans AS (SELECT r, min(p) AS a, max(p) + 400 AS b FROM numbered GROUP BY r, span),
edges AS (
  SELECT r, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) AS k, a AS e FROM spans
  UNION ALL SELECT r, max(b), 2147483647 FROM spans GROUP BY r),
cut AS (
  SELECT r, string_agg(h[2 * k + 1 : 2 * least(e, len(h) // 2)], '' ORDER BY k) AS kept FROM edges JOIN docs USING (r) GROUP BY r),
sums AS (SELECT r, CAST(sum(b - a) AS BIGINT) AS n_removed, count(*) AS n_spans FROM spans GROUP BY r)
SELECT doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(coalesce(kept, h))) AS kept_sha256
FROM docs LEFT JOIN cut USING (r) LEFT JOIN sums USING (r)
"""


@query
def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The leading 32 whitened components of every embedding."""
    return whitening.whitened(table(spark, sf_dir, "embeddings", "vec_id", "embedding")).drop("eigenvalue")


@query
def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trie of all conversations, each with its head replaced by that of the first of its five."""
    turns = prefix_trie.ordered_turns(table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text"))
    base = turns.select(F.col("conv_id").alias("base_id"), F.slice("turns", 1, 8).alias("base"))
    head = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 9).cast("int")
    own = F.slice("turns", head + 1, F.greatest(F.size("turns") - head, F.lit(0)))
    rebuilt = turns.join(base, F.col("base_id") == F.col("conv_id") - F.col("conv_id") % 5, "left").select(
        "conv_id", F.concat(F.coalesce(F.slice("base", F.lit(1), head), F.slice("turns", 1, 0)), own).alias("turns")
    )
    return prefix_trie.prefix_trie(prefix_trie.keyed(rebuilt))


ORACLES["op13_prefix_trie"] = r"""
WITH turns AS (
  SELECT conv_id, list(struct_pack(id := md5(concat(strlen(coalesce(role, '')), ':', coalesce(role, ''), strlen(coalesce(text, '')), ':', coalesce(text, ''))),
         size := strlen(coalesce(text, ''))) ORDER BY turn NULLS FIRST) AS l
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
heads AS (
  SELECT *, xor(4294967295, list_reduce(
    list_concat([CAST(4294967295 AS BIGINT)], list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
    lambda crc, byte: list_reduce(list_concat([xor(crc, byte)], [CAST(0 AS BIGINT) FOR _ IN range(8)]),
      lambda x, y: xor(x >> 1, 3988292384 * (x & 1))))) % 9 AS h
  FROM turns),
rebuilt AS (
  SELECT a.conv_id, list_concat(coalesce(b.l[1:a.h], []), a.l[a.h + 1:]) AS l
  FROM heads a LEFT JOIN turns b ON b.conv_id = a.conv_id - a.conv_id % 5),
prefixes AS (
  SELECT conv_id, d AS depth, array_to_string(list_transform(l[1:d], lambda x: x.id), '') AS path,
         CASE WHEN d > 0 THEN l[d].size ELSE 0 END AS size, d = len(l) AS ends
  FROM rebuilt, unnest(range(CAST(len(l) + 1 AS BIGINT))) AS t(d)),
nodes AS (
  SELECT path, depth, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * max(size) AS saved,
         sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE ends), '')) AS ends_sha256
  FROM prefixes GROUP BY path, depth),
children AS (SELECT path[1 : 32 * (depth - 1)] AS path, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY 1),
measured AS (SELECT * FROM nodes LEFT JOIN children USING (path)),
subtrees AS (
  SELECT path[1 : 32 * d] AS path, count(*) FILTER (WHERE n_children IS NULL) AS n_leaves, CAST(sum(saved) AS BIGINT) AS saved_tokens
  FROM measured, unnest(range(depth + 1)) AS t(d) GROUP BY 1)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(n.n_children, 0) AS n_children,
       n_leaves, saved_tokens, n.ends_sha256
FROM measured n JOIN subtrees USING (path) LEFT JOIN nodes p ON n.depth > 0 AND p.path = n.path[1 : 32 * (n.depth - 1)]
"""
