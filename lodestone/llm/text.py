"""Column expressions shared by the operators that read words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Whatever stands between words once A-Z is lower-cased: all ASCII but digits and a-z.
BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, UPPER.lower())


def ascii_words(text: Column) -> Column:
    """Lower-cased words; null and texts without words give an empty array."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), BREAKS), "")


def free_name(frame: DataFrame, name: str) -> str:
    """A column name that the frame does not have."""
    taken = {column.lower() for column in frame.columns}
    while name.lower() in taken:
        name += "_"
    return name


def as_row(columns: list[str]) -> Column:
    """One struct of columns, so that their names can't clash with others."""
    return F.struct(*(F.col(f"`{name}`") for name in columns)) if columns else F.struct(F.lit(0).alias("none"))


def from_row(row: str, columns: list[str]) -> list[Column]:
    return [F.col(row)[name].alias(name) for name in columns]
