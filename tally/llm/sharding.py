"""Uniform shuffle into shards of exact size by a hypergeometric matrix.

A uniform permutation of n rows cut into shards sends M[p][j] rows of input
partition p to shard j, where M has the partition sizes as row sums, the shard
sizes as column sums, and a multivariate hypergeometric law. M is drawn first,
from counts alone; then each partition permutes its rows locally and deals
them out by its row of M, and each shard permutes what it received.

* The matrix is drawn by halving the partitions: a node of the tree knows how
  many rows of each shard lie in its partitions, and draws its left half's
  share shard by shard. A draw inverts the hypergeometric distribution by
  walking outward from the mode, as far as ten standard deviations.
* Only counts travel through the tree, a row per partition. The rows move
  twice: to their partition's window, and to their shard.
* A shard may outgrow a task, so its permutation is by random key: equal-width
  key ranges of about ``RANGE_ROWS`` rows are sorted for themselves, and
  prefix sums over the ranges make the slots gapless.

Everything is DataFrame expressions. The stamped rows are written once, so a
recomputed task sees the same partitions and positions.

Edge cases: an empty table gives no rows; fewer rows than shards leave shards
empty; nulls, repeated rows and rows alike in all columns are rows like any
other, since position, not content, makes the keys; input columns named like
the results are replaced, all others pass through.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

#: Rows of a shard that one window task sorts, about.
RANGE_ROWS = 20_000


def _unit(*cols: Column) -> Column:
    """Uniform number in [0, 1) with 53 random bits."""
    return F.shiftrightunsigned(F.xxhash64(*cols), 11).cast("double") / F.lit(float(1 << 53))


def hypergeometric(total: Column, good: Column, draws: Column, unit: Column) -> Column:
    """Number of good items among ``draws`` of ``total``, for uniform ``unit``."""
    n, g, d = total.cast("double"), good.cast("double"), draws.cast("double")
    low, high = F.greatest(F.lit(0.0), d + g - n), F.least(g, d)
    mode = F.greatest(low, F.least(high, F.floor((d + 1) * (g + 1) / (n + 2)).cast("double")))
    spread = F.sqrt(F.greatest(F.lit(0.0), d * g * (n - g) * (n - d)) / (n * n * F.greatest(n - 1, F.lit(1.0))))
    reach = F.least(F.greatest(high - mode, mode - low), F.ceil(spread * 10).cast("double") + 30)
    setup = F.struct(n.alias("n"), g.alias("g"), d.alias("d"), mode.alias("m"), reach.alias("reach"), unit.alias("u"))

    def draw(s: Column) -> Column:
        steps = F.when(s.reach >= 1, F.sequence(F.lit(1), s.reach.cast("int"))).otherwise(F.array().cast("array<int>"))

        def up(w: Column, i: Column) -> Column:  # weight of m + i from that of m + i - 1
            k = s.m + i - 1
            return w * F.greatest(F.lit(0.0), (s.g - k) * (s.d - k)) / ((k + 1) * (s.n - s.g - s.d + k + 1))

        def down(w: Column, i: Column) -> Column:  # weight of m - i from that of m - i + 1
            k = s.m - i + 1
            return w * F.greatest(F.lit(0.0), k * (s.n - s.g - s.d + k)) / ((s.g - k + 1) * (s.d - k + 1))

        zero = F.lit(0.0)
        safe = lambda w, f, i: F.when(w > 0, f(w, i)).otherwise(zero)
        sums = F.aggregate(
            steps, F.struct(F.lit(1.0).alias("a"), F.lit(1.0).alias("b"), F.lit(1.0).alias("sum")),
            lambda acc, i: F.transform(F.array(F.struct(safe(acc.a, up, i).alias("a"), safe(acc.b, down, i).alias("b"))),
                                       lambda w: F.struct(w.a.alias("a"), w.b.alias("b"),
                                                          (acc["sum"] + w.a + w.b).alias("sum")))[0],
            lambda acc: acc["sum"])
        mark = s.u * sums
        first = F.when(mark < 1, s.m)
        return F.aggregate(
            steps, F.struct(F.lit(1.0).alias("a"), F.lit(1.0).alias("b"), F.lit(1.0).alias("sum"), first.alias("x"),
                            mark.alias("mark")),
            lambda acc, i: F.transform(
                F.array(F.struct(safe(acc.a, up, i).alias("a"), safe(acc.b, down, i).alias("b"))),
                lambda w: F.struct(w.a.alias("a"), w.b.alias("b"), (acc["sum"] + w.a + w.b).alias("sum"),
                                   F.coalesce(acc.x, F.when(acc.mark < acc["sum"] + w.a, s.m + i),
                                              F.when(acc.mark < acc["sum"] + w.a + w.b, s.m - i)).alias("x"),
                                   acc.mark.alias("mark")))[0],
            lambda acc: F.coalesce(acc.x, s.m))

    value = F.transform(F.array(setup), draw)[0]
    return F.when((good <= 0) | (draws <= 0), F.lit(0)).otherwise(value).cast("long")


def _left_share(node: Column, have: Column, draws: Column, seed: int) -> Column:
    """How many rows of each shard lie in the left half: a multivariate
    hypergeometric draw of ``draws`` rows, shard by shard."""
    start = F.struct(draws.alias("d"), F.aggregate(have, F.lit(0).cast("long"), lambda a, x: a + x).alias("n"),
                     F.array().cast("array<bigint>").alias("out"))

    def step(acc: Column, j: Column) -> Column:
        x = hypergeometric(acc.n, F.get(have, j), acc.d, _unit(F.lit(seed), node, j))
        return F.transform(F.array(x), lambda v: F.struct((acc.d - v).alias("d"), (acc.n - F.get(have, j)).alias("n"),
                                                          F.concat(acc.out, F.array(v)).alias("out")))[0]

    return F.aggregate(F.sequence(F.lit(0), F.size(have) - 1), start, step, lambda acc: acc.out)


def communication_matrix(counts: DataFrame, partitions: int, shard_sizes: Column, seed: int) -> DataFrame:
    """(pid, n) rows to (pid, cells): how many rows of a partition go to each
    shard. ``partitions`` is the number of rows of ``counts``."""
    tree = (counts.agg(F.array_sort(F.collect_list(F.struct("pid", "n"))).alias("cells"))
            .select(F.lit(1).cast("long").alias("node"), "cells", shard_sizes.alias("have")))
    for level in range(math.ceil(math.log2(max(1, partitions)))):
        if level == 6:  # the upper levels are few nodes; from here on each node is drawn in any task
            tree = tree.repartition("node")
        half = F.floor(F.size("cells") / 2).cast("int")
        left = F.slice("cells", F.lit(1), half)
        draws = F.aggregate(left, F.lit(0).cast("long"), lambda a, c: a + c.n)
        tree = tree.withColumn("left", F.when(F.size("cells") > 1, _left_share(F.col("node"), F.col("have"), draws, seed)))
        halves = F.array(
            F.struct((F.col("node") * 2).alias("node"), left.alias("cells"), F.col("left").alias("have")),
            F.struct((F.col("node") * 2 + 1).alias("node"),
                     F.slice("cells", half + 1, F.size("cells") - half).alias("cells"),
                     F.zip_with("have", "left", lambda a, b: a - b).alias("have")))
        alone = F.array(F.struct((F.col("node") * 2).alias("node"), F.col("cells"), F.col("have")))
        tree = tree.select(F.explode(F.when(F.size("cells") > 1, halves).otherwise(alone)).alias("x")).select("x.*")
    return tree.filter(F.size("cells") == 1).select(F.col("cells")[0].pid.alias("pid"), F.col("have").alias("cells"))


def shuffle_to_shards(docs: DataFrame, shards: int = 24, seed: int = 42, shard_col: str = "shard",
                      slot_col: str = "slot") -> DataFrame:
    """``docs`` with its shard (0 to ``shards`` - 1, sizes at most one apart)
    and its slot there (gapless from 0)."""
    scratch = Scratch(docs.sparkSession, "sharding")
    rows = scratch.write(docs.select(F.struct("*").alias("row"), F.spark_partition_id().alias("pid"),
                                     F.monotonically_increasing_id().alias("pos")), "rows")
    counts = scratch.write(rows.groupBy("pid").agg(F.count(F.lit(1)).alias("n")), "counts")
    total, partitions = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    sizes = F.array(*[F.lit(total // shards + (j < total % shards)).cast("long") for j in range(shards)])
    matrix = scratch.write(communication_matrix(counts, partitions, sizes, seed), "matrix")
    ends = F.transform(F.sequence(F.lit(1), F.lit(shards)),
                       lambda k: F.aggregate(F.slice("cells", F.lit(1), k), F.lit(0).cast("long"), lambda a, x: a + x))
    local = Window.partitionBy("pid").orderBy(F.xxhash64(F.lit(seed + 1), "pos"), "pos")
    rank = F.col("rank")
    ranges = max(1, math.ceil(total / shards / RANGE_ROWS))
    unit = _unit(F.lit(seed + 2), F.col("pos"))
    dealt = (rows.withColumn("rank", F.row_number().over(local) - 1)
             .join(matrix.select("pid", ends.alias("ends")), "pid")
             .select("row", "pos", F.size(F.filter("ends", lambda e: e <= rank)).alias("shard"), unit.alias("key"))
             .withColumn("range", F.floor(F.col("key") * ranges).cast("long")))
    dealt = scratch.write(dealt, "dealt")
    earlier = Window.partitionBy("shard").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (dealt.groupBy("shard", "range").agg(F.count(F.lit(1)).alias("n"))
               .withColumn("offset", F.coalesce(F.sum("n").over(earlier), F.lit(0))).drop("n"))
    again = Window.partitionBy("shard", "range").orderBy("key", "pos")
    out = (dealt.withColumn("inside", F.row_number().over(again) - 1).join(offsets, ["shard", "range"]))
    keep = [F.col("row").getField(c).alias(c) for c in docs.columns if c not in (shard_col, slot_col)]
    return out.select(*keep, F.col("shard").cast("int").alias(shard_col),
                      (F.col("offset") + F.col("inside")).cast("long").alias(slot_col))


def write_shards(docs: DataFrame, path: str, shards: int = 24, seed: int = 42) -> None:
    """The shards as folders ``shard=j`` below ``path``, with their slots."""
    shuffle_to_shards(docs, shards, seed).write.partitionBy("shard").parquet(path)
