"""License scans: ordered signature rules behind keywords, overlaps resolved by rank.

Everything happens inside the row: a text without any gate word is only split into
words; any other is tried against the rules whose keyword it contains. A
detection that lies within a stronger rule's detection is suppressed, except
for the base phrases, which are always counted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.license_rules import GATES, Rule, rules
from lodestone.llm.text import as_row, ascii_words, from_row

DETECTION = "struct<a: int, b: int, rank: int, label: string, weight: double, base: boolean>"


def _rule_table(signatures: list[Rule]) -> Column:
    return F.array(
        *(
            F.struct(
                F.lit(r.rank).alias("rank"), F.lit(r.label).alias("label"), F.lit(r.weight).alias("weight"),
                F.lit(r.keyword).alias("keyword"), F.lit(f"(?<= )(?:{r.expression})(?= )").alias("expression"),
                F.lit(r.base).alias("base"),
            )
            for r in signatures
        )
    )


#: Places of one rule ``r`` in the line. A mark before each match tells where it begins; word i is
#: element i + 1 of the line split at spaces, and a match of k spaces has k + 1 words.
_PLACES = f"""
transform(
  arrays_zip(
    filter(transform(split(regexp_replace(__line, r.expression, concat(chr(1), '$0')), ' '),
                     (w, i) -> CASE WHEN startswith(w, chr(1)) THEN i - 1 ELSE -1 END), i -> i >= 0),
    transform(regexp_extract_all(__line, r.expression, 0), h -> regexp_count(h, ' ') + 1)),
  z -> cast(named_struct('a', z['0'], 'b', z['0'] + z['1'],
       'rank', r.rank, 'label', r.label, 'weight', r.weight, 'base', r.base) AS {DETECTION}))
"""


def with_licenses(docs: DataFrame, text: str = "text", signatures: list[Rule] | None = None) -> DataFrame:
    """Add n_words, n_base, first_word, last_word, base_labels, labels, score and detections; no shuffle.

    ``detections`` holds what is left after suppression, as word intervals with
    label and weight; ``score`` is the chance that one of them is right, taking
    weights as independent. Null texts are empty. Columns named like a result
    are replaced. Repeated rows are judged alike; any text length works.
    """
    signatures = rules() if signatures is None else signatures
    names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "detections"]
    own = [c for c in docs.columns if c not in names]
    kept = ["__row"]
    words = docs.select(as_row(own).alias("__row"), ascii_words(F.col(text)).alias("__words"))
    gate = F.arrays_overlap("__words", F.array(*map(F.lit, GATES)))
    lines = words.select(
        *kept,
        F.size("__words").cast("bigint").alias("n_words"),
        F.when(gate, F.concat(F.lit(" "), F.array_join("__words", " "), F.lit(" "))).alias("__line"),
    )
    tried = F.filter(_rule_table(signatures), lambda r: F.col("__line").contains(r["keyword"]))
    found = lines.withColumn("__tried", F.when(F.col("__line").isNotNull(), tried))
    places = f"flatten(transform(__tried, r -> {_PLACES}))"
    found = found.withColumn("__found", F.when(F.col("__line").isNotNull(), F.expr(places)))
    left = F.expr(
        """filter(__found, d -> d.base OR NOT exists(__found, e ->
             NOT e.base AND e.rank < d.rank AND e.a <= d.a AND e.b >= d.b))"""
    )
    judged = found.select(*kept, "n_words", left.alias("detections"), F.expr("filter(__found, d -> d.base)").alias("__base"))
    none = F.array().cast(f"array<{DETECTION}>")
    judged = judged.withColumn("detections", F.coalesce("detections", none)).withColumn("__base", F.coalesce("__base", none))
    return judged.select(
        *from_row("__row", own),
        "n_words",
        F.size("__base").cast("bigint").alias("n_base"),
        F.array_min("__base.a").cast("bigint").alias("first_word"),
        F.array_max("__base.a").cast("bigint").alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct("__base.label")), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct("detections.label")), ",").alias("labels"),
        F.expr("round(1 - aggregate(detections, 1D, (p, d) -> p * (1 - d.weight)), 6)").alias("score"),
        "detections",
    )
