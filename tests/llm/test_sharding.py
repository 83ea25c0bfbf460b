import math
from collections import Counter

from pyspark.sql import functions as F

from tally.llm import sharding
from tally.llm.sharding import hypergeometric, shuffle_to_shards


def law(total, good, draws):
    return {k: math.comb(good, k) * math.comb(total - good, draws - k) / math.comb(total, draws)
            for k in range(max(0, draws + good - total), min(good, draws) + 1)}


def test_hypergeometric_inverts_its_law(spark):
    for total, good, draws in [(10, 4, 3), (50, 25, 20), (7, 7, 3), (9, 2, 9), (1, 1, 1), (300, 20, 150)]:
        n = 2000
        got = Counter(r.x for r in spark.range(n).select(
            hypergeometric(F.lit(total), F.lit(good), F.lit(draws), (F.col("id") + 0.5) / n).alias("x")).collect())
        want = law(total, good, draws)
        assert set(got) <= set(want)
        assert all(abs(got[k] / n - p) < 2 / n for k, p in want.items()), (total, good, draws)
    for total, good, draws in [(5, 0, 3), (5, 3, 0), (0, 0, 0)]:
        x = spark.range(1).select(hypergeometric(F.lit(total), F.lit(good), F.lit(draws), F.lit(0.3)).alias("x"))
        assert x.first().x == 0


def frame(spark, n, parts):
    return (spark.range(n).repartition(parts).select(
        F.when(F.col("id") % 7 > 0, F.col("id")).alias("doc_id"), F.lit("t").alias("text"),
        F.lit("clash").alias("shard"), F.lit(1).alias("pid"), F.lit(2).alias("row")))


def test_exact_sizes_and_gapless_slots(spark, monkeypatch):
    monkeypatch.setattr(sharding, "RANGE_ROWS", 10)
    for n, parts in [(1000, 7), (5, 3), (0, 2)]:
        docs = frame(spark, n, parts)
        out = shuffle_to_shards(docs, 24, seed=3)
        assert set(out.columns) == {"doc_id", "text", "shard", "pid", "row", "slot"}
        rows = out.collect()
        sizes = Counter(r.shard for r in rows)
        assert len(rows) == n and all(n // 24 <= sizes[j] <= n // 24 + 1 for j in range(24))
        assert all(sorted(r.slot for r in rows if r.shard == j) == list(range(sizes[j])) for j in sizes)
        assert Counter(r.doc_id for r in rows) == Counter(r.doc_id for r in docs.collect())


def test_uniform(spark):
    """Each partition's rows spread over the shards, and places in a shard do
    not follow the input order."""
    docs = frame(spark, 3000, 3).select(F.spark_partition_id().alias("p"), F.monotonically_increasing_id().alias("k"))
    rows = sorted(shuffle_to_shards(docs, 3).collect(), key=lambda r: r.k)
    cells, sizes = Counter((r.p, r.shard) for r in rows), Counter(r.p for r in rows)
    for (p, _), got in cells.items():
        mean = sizes[p] / 3
        assert abs(got - mean) < 5 * math.sqrt(mean * 2 / 3)
    same = sum(a.shard == b.shard for a, b in zip(rows, rows[1:], strict=False))
    rising = sum(a.slot < b.slot for a, b in zip(rows, rows[1:], strict=False))
    assert abs(same - 1000) < 150 and abs(rising - 1500) < 150
