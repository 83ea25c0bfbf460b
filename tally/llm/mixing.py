"""Mixing sources to target weights.

1. Sources sorted by code point (null last) get the repeating weights. Their
   targets share ``share`` of all words; none exceeds ``ceiling`` times its
   source, and what a capped source leaves is shared again by weight. In
   closed form a target is min(ceiling * size, level * weight), where the
   level is the largest of (total - caps before k) / (weights from k on) over
   the sources in the order of size / weight.
2. Every row gets a hash-random key. Key ranges of equal width cut a source,
   however large, into many groups; word counts are summed by (source, range),
   prefix sums of those give each range its offset, and a window inside the
   range gives each row the words before it.
3. The budget of a source is its rounded target: so many whole epochs, and of
   the next epoch the rows before the cut.

Edge cases: a null or empty text has size 0 and adds nothing; null sources are
one source; a source without words has target 0; rows repeated with id and
text share a key, and count each for itself; an empty table gives no rows.
Other columns are never read by the query, and pass through ``mix`` whatever
their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, Scratch, packed, small

#: Rows of a hash range that one window task sorts, about.
RANGE_ROWS = 20_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def random_key(id_col: Column, text: Column, seed: int) -> Column:
    """Hex key that depends on the row alone, so reruns agree; the text keeps
    apart rows whose id is null or repeated."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(id_col.cast("string"), F.lit("")),
                             F.md5(F.coalesce(text, F.lit("")))))


def source_targets(sizes: DataFrame, weights: tuple[int, ...], share: float, ceiling: float) -> DataFrame:
    """``target`` (words, double) of each (source, source_size) row. One row
    per source: the windows over the whole table run over that small table."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    order = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    t = (sizes.withColumn("n", F.row_number().over(by_name) - 1)
         .withColumn("weight", F.get(cycle, F.col("n") % len(weights)))
         .withColumn("cap", F.col("source_size") * F.lit(float(ceiling)))
         .withColumn("ratio", F.col("cap") / F.col("weight"))
         .withColumn("total", F.sum("source_size").over(everything) * F.lit(float(share)))
         .withColumn("caps", F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
         .withColumn("rest", F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)))
         .withColumn("level", F.max((F.col("total") - F.col("caps")) / F.col("rest")).over(everything)))
    return t.select("source", "source_size", F.least("cap", F.col("level") * F.col("weight")).alias("target"))


def _placed(docs: DataFrame, id_col: str, text_col: str, source_col: str, weights, share, ceiling,
            seed: int) -> DataFrame:
    """(id, source, size, key, source_size, target, budget, before): the words
    of its source that come before a row in the random order."""
    scratch = Scratch(docs.sparkSession, "mixing")
    text = F.col(text_col).cast("string")
    rows = scratch.write(docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"),
                                     word_count(text).alias("size"),
                                     random_key(F.col(id_col), text, seed).alias("key")), "rows")
    digits = max(1, math.ceil(math.log(max(1, rows.count()) / RANGE_ROWS, 16)))
    rows = rows.withColumn("range", F.substring("key", 1, digits))
    sums = scratch.write(rows.groupBy("source", "range").agg(F.sum("size").alias("words")), "sums")
    targets = source_targets(sums.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share, ceiling)
    earlier = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.withColumn("offset", F.coalesce(F.sum("words").over(earlier), F.lit(0))).drop("words")
    t, o = targets.alias("t"), offsets.alias("o")
    cuts = (o.join(t, F.col("o.source").eqNullSafe(F.col("t.source")))
            .select("o.source", "range", "offset", "source_size", "target")
            .withColumn("budget", F.floor(F.col("target") + 0.5).cast("long")))
    inside = (Window.partitionBy("source", "range").orderBy("key", "id", "size")
              .rowsBetween(Window.unboundedPreceding, -1))
    r, c = rows.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0))).alias("r"), cuts.alias("c")
    return (r.join(c, F.col("r.source").eqNullSafe(F.col("c.source")) & (F.col("r.range") == F.col("c.range")))
            .select("r.id", "r.source", "r.size", "r.key", "c.source_size", "c.target", "c.budget",
                    (F.col("c.offset") + F.col("r.inside")).alias("before")))


def _epochs(budget: Column, total: Column) -> tuple[Column, Column]:
    """Whole epochs of a source, and the words left for the last one."""
    some = total > 0
    return (F.when(some, F.floor(budget / total)).otherwise(0).cast("long"),
            F.when(some, budget % total).otherwise(0).cast("long"))


def mixture(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
            weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, ceiling: float = 2.0,
            seed: int = 42) -> DataFrame:
    """One row per document: its size, source size and target, and ``taken``,
    the words the mix takes from it. The document at the cut gives the exact
    rest of the budget."""
    p = _placed(docs, id_col, text_col, source_col, weights, share, ceiling, seed)
    whole, rest = _epochs(F.col("budget"), F.col("source_size"))
    last = F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("before")))
    return p.select(F.col("id").alias(id_col), "size", "source_size", "target",
                    (whole * F.col("size") + last).cast("long").alias("taken"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, ceiling: float = 2.0,
        seed: int = 42) -> DataFrame:
    """The mixed documents, all columns: a row for each epoch that takes the
    document. Documents stay whole; the one at the cut is in if at least half
    of it is. The cut is a key per source, so no text is shuffled."""
    p = _placed(docs, id_col, text_col, source_col, weights, share, ceiling, seed)
    whole, rest = _epochs(F.col("budget"), F.col("source_size"))
    chosen = (rest > 0) & (F.col("before") + F.col("size") / 2 <= rest)
    cuts = p.groupBy("source").agg(F.first(whole).alias("whole"), F.max(F.when(chosen, F.col("key"))).alias("cut"))
    cuts = Scratch(docs.sparkSession, "mixing").write(cuts, "cuts")
    text = F.col(text_col).cast("string")
    full = packed(docs, source=F.col(source_col).cast("string"), key=random_key(F.col(id_col), text, seed)).alias("f")
    c = small(cuts, cuts.count()).alias("c")
    copies = F.col("c.whole") + F.coalesce(F.col("f.key") <= F.col("c.cut"), F.lit(False)).cast("long")
    return (full.join(c, F.col("f.source").eqNullSafe(F.col("c.source")))
            .select("f.row", copies.cast("int").alias("copies")).filter("copies > 0")
            .select(F.explode(F.array_repeat("row", F.col("copies"))).alias("row")).select("row.*"))
