"""Arrow batch helper shared by the operators that compute a column in Python."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

SLICE_ROWS = 1_024


def with_arrow_column(
    frame: DataFrame,
    field: T.StructField,
    inputs: Sequence[str],
    compute: Callable[[pa.RecordBatch], pa.Array],
) -> DataFrame:
    """Add or replace one column computed batch by batch from *inputs*. Narrow: no shuffle.

    Only the inputs go to Python, so the scan still reads no more than is used.
    The column counts as nondeterministic: it is computed once, not again in filters.
    """
    names, kind = list(inputs), to_arrow_type(field.dataType)

    def whole(*columns: pa.Array) -> pa.Array:
        batch = pa.RecordBatch.from_arrays(list(columns), names=names)
        # Small slices bound what a batch of long texts expands into.
        made = [
            compute(batch.slice(at, SLICE_ROWS)).cast(kind) for at in range(0, batch.num_rows, SLICE_ROWS)
        ]
        out = pa.concat_arrays(made) if made else pa.array([], kind)
        # Workers live on; what one batch has freed must not count against the next.
        made.clear()
        pa.default_memory_pool().release_unused()
        return out

    # The function's kind is told by its annotations, one for each input.
    def run_one(a: pa.Array) -> pa.Array:
        return whole(a)

    def run_two(a: pa.Array, b: pa.Array) -> pa.Array:
        return whole(a, b)

    for run in (run_one, run_two):
        run.__annotations__ = dict.fromkeys(run.__annotations__, pa.Array)
    run = {1: run_one, 2: run_two}[len(names)]
    made = F.arrow_udf(run, field.dataType).asNondeterministic()
    return frame.withColumn(field.name, made(*(F.col(name) for name in names)))
