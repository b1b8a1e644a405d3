"""Arrow columns computed in bounded slices."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

SLICE_BYTES = 4 << 20
BLANK = re.compile(rb"[\x20\x09-\x0D]")


def _cuts(texts: pa.Array, limit: int) -> Iterator[tuple[int, int]]:
    """(first row, rows) of runs of about ``limit`` bytes, one text at least."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < len(texts):
        before = int(ends[start - 1]) if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + limit, side="right")))
        yield start, stop - start
        start = stop


def byte_slices(batch: pa.RecordBatch, column: int, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about ``limit`` bytes of one text column."""
    for start, rows in _cuts(batch.column(column), limit):
        yield batch.slice(start, rows)


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[list[bytes]]:
    """The texts as UTF-8, null as empty, in runs of about ``limit`` bytes."""
    binary = texts.cast(pa.binary() if pa.types.is_string(texts.type) else pa.large_binary())
    for start, rows in _cuts(binary, limit):
        yield [b or b"" for b in binary.slice(start, rows).to_pylist()]


def struct_column(schema: str, compute: Callable[[list[bytes]], list]) -> Callable[[Column], Column]:
    """A struct column of one text column: ``compute`` maps texts to one list or array for each field.

    Only the text goes to Python. It counts as nondeterministic so that filters
    on its fields don't evaluate it a second time.
    """
    kind = StructType.fromDDL(schema)
    target = to_arrow_type(kind)

    def run(texts: pa.Array) -> pa.Array:
        made = []
        for run_ in slices(texts):
            values = compute(run_)
            made.append(
                pa.StructArray.from_arrays(
                    [pa.array(v, type=target.field(i).type) for i, v in enumerate(values)],
                    fields=[target.field(i) for i in range(target.num_fields)],
                )
            )
        whole = pa.concat_arrays(made) if made else pa.array([], type=target)
        # Workers live on; what one stage has freed must not count against the next.
        pa.default_memory_pool().release_unused()
        return whole

    run.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, kind).asNondeterministic()


def joined_words(text: bytes) -> bytes:
    """Lower-cased words between single blanks. Long texts are split piece by piece, so no list holds all words."""
    if len(text) <= SLICE_BYTES:
        return b" ".join(text.lower().split())
    parts, at = [], 0
    while at < len(text):
        blank = BLANK.search(text, at + SLICE_BYTES)
        end = blank.start() if blank else len(text)
        if part := b" ".join(text[at:end].lower().split()):
            parts.append(part)
        at = end
    return b" ".join(parts)


def shingle_runs(joined: bytes, shingle: int, run: int = 1 << 16) -> Iterator[list[bytes]]:
    """Shingles of joined words in runs of bounded length; fewer words are one shingle, none have none."""
    if not joined:
        return
    ends = np.append(np.flatnonzero(np.frombuffer(joined, np.uint8) == 32), len(joined))
    if len(ends) <= shingle:
        yield [joined]
        return
    for at in range(0, len(ends) - shingle + 1, run):
        last = ends[at + shingle - 1 : at + shingle - 1 + run].tolist()
        first = [int(ends[at - 1]) + 1 if at else 0, *(ends[at : at + len(last) - 1] + 1).tolist()]
        yield [joined[a:b] for a, b in zip(first, last)]
