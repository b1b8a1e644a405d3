"""Parallelism of small inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(scan: DataFrame) -> DataFrame:
    """Round-robin a scan that has fewer partitions than the session has cores.

    Expensive per-row work on one small file would otherwise run in one task.
    A scan with enough partitions is returned as it is, without a shuffle. Pass
    scans only: counting the partitions of an aggregate would run it.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan
