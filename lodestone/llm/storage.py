"""Small sides of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame

from lodestone.operators.lineage import checkpointed, light

#: Tables are broadcast up to this size; beyond it they are joined by a shuffle.
BROADCAST_BYTES = 64 << 20


def broadcast_if_small(frame: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Materialise a frame of plain columns, measure it, and mark it for broadcast if it fits the limit."""
    return light(checkpointed(frame), limit)
