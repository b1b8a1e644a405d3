"""Text, corpus and score queries over whole tables.

Inputs that the tables do not hold (code-like text, comments) are derived from
their rows by the same SQL expressions on both engines.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.catalog.registry import query, table
from lodestone.config import DEFAULT_RERANK_INSTRUCTION
from lodestone.functions import text as t
from lodestone.functions.scoring import (
    final_score,
    metadata_bonus,
    score_band,
    token_overlap,
    yes_probability,
)
from lodestone.operators.corpus import (
    fill_to_target,
    first_per_group,
    first_seen,
    language_quotas,
    running_position,
    within_row_limit,
)
from lodestone.operators.lineage import checkpointed
from lodestone.operators.partitioning import spread

# The same character classes, written for the checking engine.
SPACE, IN_LINE, BREAK, WORD = t.SPACE, t.SPACE_IN_LINE, t.LINE_BREAK, t.WORD


def strip_sql(text: str) -> str:
    return rf"regexp_replace({text}, '\A{SPACE}+|{SPACE}+\z', '', 'g')"


def words_sql(text: str) -> str:
    return f"regexp_extract_all(lower({text}), '{WORD}')"


def derived(frame, **expressions):
    return frame.withColumns({name: F.expr(sql) for name, sql in expressions.items()})


@query(
    rf"""WITH s AS (
  SELECT 'documents' AS origin, doc_id AS id, 'python' AS language, text AS code FROM documents
  UNION ALL SELECT 'pages', page_id, 'javascript', html FROM pages)
SELECT origin, id, {strip_sql('''CASE
  WHEN language = 'python' AND contains(code, ':') THEN split_part(code, ':', 1) || ':'
  WHEN language <> 'python' AND contains(code, '{') THEN split_part(code, '{', 1)
  ELSE split_part(code, chr(10), 1) END''')} AS signature FROM s"""
)
def signature_header(spark, sf_dir):
    documents = table(spark, sf_dir, "documents").select(
        F.lit("documents").alias("origin"), F.col("doc_id").alias("id"),
        F.lit("python").alias("language"), F.col("text").alias("code"),
    )
    pages = table(spark, sf_dir, "pages").select(
        F.lit("pages"), "page_id", F.lit("javascript"), "html"
    )
    return documents.union(pages).select(
        "origin", "id", t.signature(F.col("code"), F.col("language")).alias("signature")
    )


SPACED = "replace(text, '.', '.' || repeat(chr(10), cast(1 + doc_id % 5 as int)))"


@query(
    rf"""SELECT doc_id, md5(regexp_replace({SPACED}, '\n{{3,}}', chr(10) || chr(10), 'g')) AS collapsed
FROM documents"""
)
def newline_collapse(spark, sf_dir):
    spaced = derived(spread(table(spark, sf_dir, "documents")), text=SPACED)
    return spaced.select(
        "doc_id", F.md5(t.collapse_blank_lines(F.col("text")).cast("binary")).alias("collapsed")
    )


COMMENT = """CASE WHEN doc_id % 4 = 0 THEN '/** ' || replace(text, chr(10), chr(10) || ' * ') || chr(10) || ' */'
WHEN doc_id % 4 = 1 THEN '// ' || replace(text, chr(10), chr(10) || '  // ')
WHEN doc_id % 4 = 2 THEN '## ' || replace(text, chr(10), chr(10) || '# ')
ELSE '/*=' || text || '*/' END"""


def cleaned_sql(text: str) -> str:
    for pattern in (
        rf"(?m)^{SPACE}*//+{SPACE}?", rf"(?m)^{SPACE}*\*+{SPACE}?", r"/\*+=?", r"\*+/",
        rf"(?m)^{SPACE}*#+{SPACE}?",
    ):
        text = f"regexp_replace({text}, '{pattern}', '', 'g')"
    return f"nullif({strip_sql(text)}, '')"


@query(f"SELECT doc_id, md5({cleaned_sql('(' + COMMENT + ')')}) AS cleaned FROM documents")
def comment_cleanup(spark, sf_dir):
    comments = derived(spread(table(spark, sf_dir, "documents")), text=COMMENT)
    return comments.select(
        "doc_id", F.md5(t.clean_comment(F.col("text")).cast("binary")).alias("cleaned")
    )


# Code-like columns of a part: kinds, names (sometimes missing) and documentation.
PART = {
    "language": "CASE p_partkey % 3 WHEN 0 THEN 'python' WHEN 1 THEN 'javascript' ELSE 'php' END",
    "entity_type": "CASE p_size % 3 WHEN 0 THEN 'class' WHEN 1 THEN 'method' ELSE 'function' END",
    "function_name": "CASE WHEN p_size % 7 = 0 THEN NULL ELSE replace(p_name, ' ', '_') END",
    "class_name": "CASE WHEN p_size % 3 = 2 THEN '' WHEN p_size % 5 = 0 THEN NULL ELSE replace(p_brand, '#', '') END",
    "docstring": "CASE WHEN p_size % 4 = 0 THEN NULL ELSE ' ' || p_type || ' item of ' || p_brand || chr(10) END",
    "source_code": "'def ' || replace(p_name, ' ', '_') || '(a):' || chr(10) || '    return ' || p_size",
    "query": """CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN p_type || '  item ' || p_type || ' missing'
      WHEN 2 THEN upper(p_brand) || ' widget' ELSE '' END""",
}
PART_SQL = "p AS (SELECT p_partkey, p_retailprice, " + ", ".join(
    f"{sql} AS {name}" for name, sql in PART.items()
) + " FROM part)"


def parts(spark, sf_dir):
    return derived(table(spark, sf_dir, "part"), **PART)


CAPITAL = "upper(left(language, 1)) || lower(substr(language, 2))"
FN, CN = "nullif(function_name, '')", "nullif(class_name, '')"
STRUCTURED = f"""concat_ws(chr(10), 'Language: ' || {CAPITAL},
  CASE WHEN entity_type = 'class' THEN 'Class: ' || coalesce({FN}, {CN}, '<unknown>')
       WHEN {CN} IS NOT NULL THEN 'Class: ' || {CN} END,
  CASE WHEN entity_type <> 'class' THEN
    CASE WHEN {CN} IS NULL THEN 'Function: ' ELSE 'Method: ' END || coalesce({FN}, '<unknown>') END,
  'Signature: ' || signature,
  CASE WHEN docstring <> '' THEN 'Documentation: ' || {strip_sql('docstring')} END,
  'Code:', source_code)"""


@query(
    f"""WITH {PART_SQL}, s AS (SELECT *, trim(CASE WHEN language = 'python' THEN split_part(source_code, ':', 1) || ':'
    ELSE split_part(source_code, chr(10), 1) END) AS signature FROM p)
SELECT p_partkey, coalesce(nullif(concat_ws('.', {CN}, {FN}), ''), '<anonymous>') AS identifier,
       {STRUCTURED} AS structured_text FROM s"""
)
def structured_text(spark, sf_dir):
    rows = parts(spark, sf_dir)
    signature = t.signature(F.col("source_code"), F.col("language"))
    return rows.select(
        "p_partkey",
        t.identifier(F.col("class_name"), F.col("function_name")).alias("identifier"),
        t.structured_text(
            F.col("language"), F.col("entity_type"), F.col("class_name"), F.col("function_name"),
            signature, F.col("docstring"), F.col("source_code"),
        ).alias("structured_text"),
    )


def bonus_sql(query="query", function="function_name", owner="class_name", doc="docstring") -> str:
    terms = rf"list_distinct(list_filter(string_split_regex(lower({query}), '{SPACE}+'), lambda w: w <> ''))"
    name = f"lower(coalesce(nullif({function}, ''), nullif({owner}, ''), ''))"
    hits = f"len(list_filter({terms}, lambda w: contains(lower({doc}), w)))"
    return f"""least(1.0::DOUBLE,
  CASE WHEN {name} <> '' AND (contains({name}, lower({query}))
    OR len(list_filter({terms}, lambda w: contains({name}, w))) > 0) THEN 0.4::DOUBLE ELSE 0 END
  + CASE WHEN {name} <> '' AND {name} = replace(lower({query}), ' ', '_') THEN 0.3::DOUBLE ELSE 0 END
  + CASE WHEN {doc} <> '' AND len({terms}) > 0 AND {hits} > 0
    THEN 0.3::DOUBLE * ({hits}::DOUBLE / len({terms})) ELSE 0 END)"""


@query(f"WITH {PART_SQL} SELECT p_partkey, round({bonus_sql()}, 6) AS metadata_bonus FROM p")
def metadata_bonus_by_part(spark, sf_dir):
    bonus = metadata_bonus(*[F.col(c) for c in ("query", "function_name", "class_name", "docstring")])
    return parts(spark, sf_dir).select("p_partkey", F.round(bonus, 6).alias("metadata_bonus"))


def overlap_sql(query: str, document: str) -> str:
    wanted = f"list_distinct({words_sql(query)})"
    return f"""CASE WHEN len({wanted}) = 0 THEN 0.0::DOUBLE
  ELSE len(list_intersect({wanted}, {words_sql(document)}))::DOUBLE / len({wanted}) END"""


@query(
    f"""WITH {PART_SQL}, s AS (SELECT *, p_retailprice / 2000 AS sim, {overlap_sql('query', "coalesce(docstring, '') || source_code")} AS rel,
  {bonus_sql()} AS bonus FROM p)
SELECT p_partkey, round(0.75::DOUBLE * rel + 0.20::DOUBLE * sim + 0.05::DOUBLE * bonus, 6) AS reranked, round(sim, 6) AS plain,
  CASE WHEN 0.75::DOUBLE * rel + 0.20::DOUBLE * sim + 0.05::DOUBLE * bonus >= 0.8 THEN 'green'
       WHEN 0.75::DOUBLE * rel + 0.20::DOUBLE * sim + 0.05::DOUBLE * bonus >= 0.5 THEN 'yellow' ELSE 'red' END AS band,
  round(exp(sim * 2) / (exp(sim * 2) + exp(rel)), 6) AS yes_share FROM s"""
)
def final_score_modes(spark, sf_dir):
    """The weighted score, the plain one, the display colour, and a two-way softmax."""
    similarity = F.col("p_retailprice") / 2000
    relevance = token_overlap(
        F.col("query"), F.concat(F.coalesce("docstring", F.lit("")), F.col("source_code"))
    )
    bonus = metadata_bonus(*[F.col(c) for c in ("query", "function_name", "class_name", "docstring")])
    score = final_score(similarity, relevance, bonus)
    return parts(spark, sf_dir).select(
        "p_partkey",
        F.round(score, 6).alias("reranked"),
        F.round(final_score(similarity, relevance, bonus, reranking=False), 6).alias("plain"),
        score_band(score).alias("band"),
        F.round(yes_probability(similarity * 2, relevance), 6).alias("yes_share"),
    )


# A line of the text as documentation; the code holds the text with or without it.
LEAK = {
    "documentation": "lower(replace(split_part(text, chr(10), 1), ' ', '  '))",
    "code": """CASE WHEN doc_id % 2 = 0 THEN '/* ' || replace(text, chr(10), chr(10) || ' * ')
      ELSE substr(text, 2 + length(split_part(text, chr(10), 1))) END""",
}


@query(
    f"""WITH s AS (SELECT doc_id, {LEAK['documentation']} AS documentation, {LEAK['code']} AS code FROM documents)
SELECT doc_id, len({words_sql('documentation')}) > 0 AND contains(
  ' ' || array_to_string({words_sql('code')}, ' ') || ' ',
  ' ' || array_to_string({words_sql('documentation')}, ' ') || ' ') AS leaks FROM s"""
)
def documentation_leakage(spark, sf_dir):
    pairs = derived(spread(table(spark, sf_dir, "documents")), **LEAK)
    return pairs.select(
        "doc_id", t.contains_documentation(F.col("code"), F.col("documentation")).alias("leaks")
    )


# Half of the texts carry the tag already, in either case or after blanks.
TAGGED = """CASE WHEN length(text) % 4 = 0 THEN '<?php ' || text WHEN length(text) % 4 = 1 THEN '  <?PHP' || chr(10) || text
ELSE text END"""


@query(
    f"""WITH s AS (SELECT doc_id, lang, {TAGGED} AS code FROM documents)
SELECT doc_id, md5(CASE WHEN lang = 'en' AND NOT starts_with({strip_sql('code')}, '<?') THEN '<?php' || chr(10) || code ELSE code END) AS digest FROM s"""
)
def php_tag_prefix(spark, sf_dir):
    """English texts play PHP code: they get the opening tag unless they have it."""
    code = derived(spread(table(spark, sf_dir, "documents").select("doc_id", "lang", "text")), code=TAGGED)
    language = F.when(F.col("lang") == "en", "php").otherwise("python")
    return code.select("doc_id", F.md5(t.with_php_tag(F.col("code"), language).cast("binary")).alias("digest"))


QUOTED = "'def f():' || chr(10) || '    \"\"\"' || text || '\"\"\"' || chr(10) || '    return ' || doc_id"


@query(
    f"""SELECT doc_id, 'def f():' || chr(10) || '    ' || '''''' ||
  repeat(chr(10), (length(text) - length(replace(text, chr(10), '')))::INT) || chr(10) || '    return ' || doc_id AS code
FROM documents"""
)
def docstring_blanking(spark, sf_dir):
    """Whole texts as docstrings: only their line breaks stay."""
    code = derived(spread(table(spark, sf_dir, "documents")), code=QUOTED)
    doc = F.concat(F.lit('"""'), F.col("text"), F.lit('"""'))
    return code.select("doc_id", t.blank_docstring(F.col("code"), doc).alias("code"))


# Trailing blanks and other line ends do not make a text different.
MESSY = """CASE doc_id % 3 WHEN 0 THEN text || '  ' || chr(10) WHEN 1 THEN replace(text, chr(10), ' ' || chr(13) || chr(10))
ELSE replace(text, chr(10), chr(9) || chr(10)) END"""
NORMAL = (
    rf"regexp_replace(regexp_replace({strip_sql('(' + MESSY + ')')}, '{BREAK}', chr(10), 'g'), "
    rf"'{IN_LINE}+\n', chr(10), 'g')"
)
FIRST_SQL = f"""keyed AS (
  SELECT *, (source NOT IN ('src0', 'src1', 'src2', 'src3', 'src4'))::INT AS split_rank,
         sha256(lang || chr(10) || '' || chr(10) || {NORMAL}) AS key
  FROM documents WHERE {strip_sql('text')} <> ''),
firsts AS (SELECT * FROM (
  SELECT *, row_number() OVER (PARTITION BY lang, key ORDER BY split_rank, doc_id) AS n FROM keyed) WHERE n = 1)"""


def keyed_documents(spark, sf_dir):
    """Valid rows with a split and a content key. Five sources form the primary split."""
    rows = spread(table(spark, sf_dir, "documents")).filter(~t.is_blank(F.col("text")))
    primary = F.col("source").isin("src0", "src1", "src2", "src3", "src4")
    messy = derived(rows, code=MESSY)
    return messy.select(
        F.col("lang").alias("language"),
        F.when(primary, 0).otherwise(1).alias("split_rank"),
        F.col("doc_id").alias("row_idx"),
        t.dedup_key(F.col("lang"), F.lit(""), F.col("code")).alias("key"),
    )


@query(f"WITH {FIRST_SQL} SELECT lang AS language, split_rank, doc_id AS row_idx, key FROM firsts")
def dedup_first_seen(spark, sf_dir):
    rows = checkpointed(keyed_documents(spark, sf_dir))
    return first_seen(rows, ["language", "key"], ["split_rank", "row_idx"])


@query(
    f"""WITH {FIRST_SQL}, placed AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY split_rank, doc_id) - 1 AS position FROM firsts)
SELECT lang AS language, split_rank, doc_id AS row_idx, position FROM placed
WHERE split_rank = 0 OR position < CASE lang WHEN 'en' THEN 151 WHEN 'de' THEN 151 ELSE 150 END"""
)
def fill_to_quota(spark, sf_dir):
    """602 records over four languages: primary rows first, then fill rows up to the quota."""
    rows = checkpointed(keyed_documents(spark, sf_dir))
    kept = first_seen(rows, ["language", "key"], ["split_rank", "row_idx"])
    placed = running_position(
        checkpointed(kept.drop("key")), "language", ["split_rank", "row_idx"]
    )
    quotas = language_quotas(602, ["en", "de", "fr", "es"])
    return fill_to_target(placed, quotas)


@query(
    """SELECT lang AS language, doc_id AS row_idx FROM (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS place FROM documents)
WHERE place < CASE lang WHEN 'en' THEN 151 WHEN 'de' THEN 151 ELSE 150 END"""
)
def single_split_limit(spark, sf_dir):
    """Without fill the quota counts the rows considered of each language, valid or not."""
    rows = table(spark, sf_dir, "documents").select(
        F.col("lang").alias("language"), F.lit(0).alias("split_rank"), F.col("doc_id").alias("row_idx")
    )
    return within_row_limit(rows, language_quotas(602, ["en", "de", "fr", "es"])).drop("split_rank")


@query(
    f"""WITH {FIRST_SQL}, r AS (SELECT lang, split_rank, count(*) AS read FROM keyed GROUP BY ALL),
k AS (SELECT lang, split_rank, count(*) AS kept FROM firsts GROUP BY ALL)
SELECT lang AS language, split_rank, read, coalesce(kept, 0) AS kept, read - coalesce(kept, 0) AS duplicates
FROM r LEFT JOIN k USING (lang, split_rank)"""
)
def dedup_counts(spark, sf_dir):
    """Rows read, kept and dropped as duplicates per language and split."""
    rows = checkpointed(keyed_documents(spark, sf_dir))
    read = rows.groupBy("language", "split_rank").agg(F.count("*").alias("read"))
    kept = (
        first_seen(rows, ["language", "key"], ["split_rank", "row_idx"])
        .groupBy("language", "split_rank").agg(F.count("*").alias("kept"))
    )
    return (
        read.join(kept, ["language", "split_rank"], "left").na.fill(0, ["kept"])
        .withColumn("duplicates", F.col("read") - F.col("kept"))
    )


@query(
    """SELECT lang AS language, doc_id, row::INTEGER AS row FROM (
  SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS row FROM documents) WHERE row <= 50"""
)
def query_cap_per_language(spark, sf_dir):
    """First fifty rows per language: the cap on evaluation queries."""
    rows = table(spark, sf_dir, "documents").select(F.col("lang").alias("language"), "doc_id")
    return first_per_group(rows, "language", ["doc_id"], 50)


@query(
    f"""SELECT u.conv_id, u.turn, md5('<Instruct>: {DEFAULT_RERANK_INSTRUCTION}' || chr(10) || '<Query>: ' || u.text || chr(10) ||
  'The document is source code written in ' || upper(left(a.role, 1)) || lower(substr(a.role, 2)) || '.' || chr(10) ||
  '<Document>: ' || a.text) AS hinted,
  length('<Instruct>: {DEFAULT_RERANK_INSTRUCTION}' || '<Query>: ' || u.text || '<Document>: ' || a.text) + 2 AS plain_length
FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1"""
)
def rerank_prompts(spark, sf_dir):
    """Each turn as the query and the following turn as the document."""
    turns = table(spark, sf_dir, "conversations")
    following = turns.select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("role").alias("answer_role"),
        F.col("text").alias("answer"),
    )
    pairs = turns.join(following, ["conv_id", "turn"])
    hinted = t.rerank_prompt(
        F.col("text"), F.col("answer"), DEFAULT_RERANK_INSTRUCTION, F.col("answer_role")
    )
    plain = t.rerank_prompt(F.col("text"), F.col("answer"), DEFAULT_RERANK_INSTRUCTION)
    return pairs.select(
        "conv_id", "turn", F.md5(hinted.cast("binary")).alias("hinted"),
        F.length(plain).cast("long").alias("plain_length"),
    )
