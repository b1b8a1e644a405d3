"""Connected components by repeated hooking and contraction.

Each round hooks every node to its smallest smaller neighbour, flattens the hook
forest by pointer jumping, and replaces the ends of the remaining links by their
roots. Every component loses at least half of its remaining nodes in a round, so
rounds and jumps are logarithmic. The state is always a pair table; nothing is
collected. Hot roots only appear as the large side of joins against unique keys,
which adaptive execution splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.operators.lineage import checkpointed


def _raised(hooks: DataFrame) -> DataFrame:
    """(node, up) with ``up`` raised to the root of its tree."""
    while True:
        above = hooks.select(F.col("node").alias("up"), F.col("up").alias("top"))
        jumped = checkpointed(
            hooks.join(above, "up", "left").select(
                "node", F.coalesce("top", "up").alias("up"), F.col("top").isNotNull().alias("moved")
            )
        )
        hooks = jumped.select("node", "up")
        if jumped.where("moved").isEmpty():
            return hooks


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of ``links`` (a, b); component is the smallest node reachable.

    Self links, repeated links and either direction are allowed. Links with a
    null end are ignored. No links give no rows.
    """
    nodes = links.where("a IS NOT NULL AND b IS NOT NULL").select(F.explode(F.array("a", "b")).alias("node")).distinct()
    open_links = links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    labels = nodes.withColumn("component", F.col("node"))
    while not open_links.isEmpty():
        hooks = _raised(
            checkpointed(open_links.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("up")))
        )
        low = hooks.select(F.col("node").alias("a"), F.col("up").alias("low"))
        high = hooks.select(F.col("node").alias("b"), F.col("up").alias("high"))
        ends = (
            open_links.join(low, "a", "left")
            .join(high, "b")
            .select(F.coalesce("low", "a").alias("x"), F.col("high").alias("y"))
            .where("x <> y")
        )
        open_links = checkpointed(
            ends.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
        )
        raised = hooks.select(F.col("node").alias("component"), F.col("up").alias("raised"))
        labels = checkpointed(
            labels.join(raised, "component", "left").select("node", F.coalesce("raised", "component").alias("component"))
        )
    return labels
