"""Dense positions without a single-task window.

A global ``row_number()`` with no PARTITION BY, or one partitioned by a key
that may hold a third of all rows, runs in one task. These helpers spread the
work instead:

1. range-partition on the full ordering key and sort inside each partition,
   so a hot group is cut across many tasks;
2. stamp each row with (partition id, record number in the partition) and
   write the result once (parquet) to the shared checkpoint folder. The rows of a
   shuffle arrive in no fixed order, so a second evaluation could sample
   other range bounds; the written copy makes both uses below agree, and a
   lost executor re-reads it instead of recomputing the shuffle;
3. count rows per partition. That table has at most ``num_partitions`` rows,
   a proven bound, so it is broadcast;
4. ordinal = rows in earlier partitions + record number in the partition.

The ordering key must be unique, otherwise the order of ties (and so the
result) is not defined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import stage

_LOCAL_MASK = (1 << 33) - 1  # monotonically_increasing_id keeps the record number in the low 33 bits


# Rows of one part of a range shuffle, about, where the row count is known.
PART_ROWS = 100_000


def parts_for(spark: SparkSession, rows: int) -> int:
    """Parts of a range shuffle of ``rows`` rows: what it samples to the driver
    and the tasks it starts follow the rows, not the session's setting alone."""
    return max(1, min(-(-rows // PART_ROWS), int(spark.conf.get("spark.sql.shuffle.partitions"))))


def _num_partitions(df: DataFrame, n: int | None) -> int:
    if n:
        return n
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _stamped(df: DataFrame, order: list[Column], n: int) -> DataFrame:
    s = (df.repartitionByRange(n, *order).sortWithinPartitions(*order)
         .withColumn("_pid", F.spark_partition_id())
         .withColumn("_local", F.monotonically_increasing_id().bitwiseAND(F.lit(_LOCAL_MASK))))
    return stage(s, "ordinal")


def global_ordinal(df: DataFrame, order: list[Column], name: str = "ordinal",
                   num_partitions: int | None = None) -> DataFrame:
    """Add ``name``: 0-based dense position of each row in ``order``."""
    s = _stamped(df, order, _num_partitions(df, num_partitions))
    counts = s.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    # at most n rows: a single-partition running sum over them is cheap
    w = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_pid", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_off"))
    return (s.join(F.broadcast(offsets), "_pid")
            .withColumn(name, F.col("_off") + F.col("_local"))
            .drop("_pid", "_local", "_off"))


# Tables at most this long may be numbered by one task.
SMALL_TABLE_ROWS = 100_000


def small_ordinal(df: DataFrame, order: list[Column], name: str, bound: int | None,
                  num_partitions: int | None = None) -> DataFrame:
    """``global_ordinal`` for a table whose row count is proven small by
    ``bound`` (e.g. one row per input file of a run, known from the file
    listing): a single-task ``row_number()`` over at most SMALL_TABLE_ROWS
    rows. Without such a bound, the distributed path is taken."""
    if bound is None or bound > SMALL_TABLE_ROWS:
        return global_ordinal(df, order, name, num_partitions)
    return df.withColumn(name, F.row_number().over(Window.orderBy(*order)) - 1)


def rank_within(df: DataFrame, group: list[str], order: list[Column],
                pos: str = "pos", size: str | None = None,
                num_partitions: int | None = None) -> DataFrame:
    """Add ``pos`` (0-based dense position inside ``group`` by ``order``) and
    optionally ``size`` (rows in the group). Skew-safe: a group may span many
    tasks. The per-group table (one row per group) is joined back with a
    plain equi-join; AQE turns it into a broadcast when its measured size is
    small and splits hot keys otherwise. Group keys must not be NULL."""
    keyed = global_ordinal(df, [F.col(g) for g in group] + list(order), "_ord", num_partitions)
    aggs = [F.min("_ord").alias("_first")]
    if size:
        aggs.append(F.count(F.lit(1)).alias(size))
    firsts = keyed.groupBy(*group).agg(*aggs)
    return (keyed.join(firsts, group)
            .withColumn(pos, F.col("_ord") - F.col("_first"))
            .drop("_ord", "_first"))
