"""Exact dedup by a 128-bit content hash with a byte comparison in each group.

Texts are equal when identical after each run of ASCII white space became one
space; a null text counts as empty. The row with the smallest id stays.

1. A narrow table (id, 128-bit hash) is written once. Rows are first counted
   by (hash, id), so a group of any size shrinks to partial counts before it
   is shuffled.
2. Only texts whose hash occurs twice or more are read again, and grouped by
   (hash, text): Spark compares the bytes. A hash with one text is verified;
   a hash with several (a collision) is split by its texts.
3. Each row joins its class on the hash. Unique texts need no partner.

Edge cases: null ids sort last (a group with null ids only keeps one of its
rows, ``keep_id`` null); repeated rows with the same id and text keep exactly
one; an empty table gives no rows; other columns are never read, whatever
their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, Scratch, packed, small


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ")


def md5_128(text: Column) -> Column:
    """16-byte content hash."""
    return F.unhex(F.md5(text))


class _Classes:
    """Classes of a documents table: ``multi`` has a row per hash that occurs
    at least twice, ``split`` a row per text of a collided hash."""

    def __init__(self, docs: DataFrame, id_col: str, text_col: str, hash_fn, with_sha: bool):
        spark = docs.sparkSession
        self.scratch = Scratch(spark, "exact")
        norm = normalised(F.col(text_col).cast("string"))
        self.texts = docs.select(F.col(id_col).alias("id"), norm.alias("norm")).withColumn("h", hash_fn(F.col("norm")))
        cols = ["id", "h"] + ([F.sha2("norm", 256).alias("sha")] if with_sha else [])
        self.rows = self.scratch.write(self.texts.select(*cols), "rows")
        first = F.min(F.struct(F.col("id").isNull().alias("null"), "id", "n")).alias("first")
        by_hash = (self.rows.groupBy("h", "id").agg(F.count(F.lit(1)).alias("n"))
                   .groupBy("h").agg(first, F.sum("n").alias("size"))
                   .filter("size > 1")
                   .select("h", "size", F.col("first.id").alias("keep_id"), F.col("first.n").alias("keep_n")))
        multi = self.scratch.write(by_hash, "multi")
        n_multi = multi.count()
        members = self.texts.join(small(multi.select("h"), n_multi), "h", "left_semi")
        per_text = members.groupBy("h", "norm").agg(F.count(F.lit(1)).alias("n"))
        verified = self.scratch.write(per_text.groupBy("h").agg(F.count(F.lit(1)).alias("texts")), "texts")
        collided = verified.filter("texts > 1").select("h")
        self.n_collided = collided.count()
        self.collided = small(collided, self.n_collided)
        self.multi = small(multi.join(self.collided, "h", "left_anti") if self.n_collided else multi, n_multi)
        self.split = None
        if self.n_collided:
            own = self.texts.join(self.collided, "h", "left_semi")
            self.split = (own.groupBy("h", "norm", "id").agg(F.count(F.lit(1)).alias("n"))
                          .groupBy("h", "norm").agg(first, F.sum("n").alias("size"))
                          .select("h", "norm", "size", F.col("first.id").alias("keep_id"),
                                  F.col("first.n").alias("keep_n")))
        self.tied = (multi.filter("keep_n > 1").limit(1).count() > 0) or bool(self.n_collided)


def exact_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  hash_fn: Callable[[Column], Column] = md5_128) -> DataFrame:
    """One row per input row: the id, ``keep_id``, ``group_size``, ``kept``
    and ``text_sha256`` of the normalised text."""
    c = _Classes(docs, id_col, text_col, hash_fn, with_sha=True)
    rows = c.rows
    if c.n_collided:
        rows = rows.join(c.collided, "h", "left_anti")
    out = rows.join(c.multi, "h", "left").select("id", "sha", "size", "keep_id", "keep_n")
    if c.split is not None:
        texts = c.texts.join(c.collided, "h", "left_semi")
        out = out.unionByName(texts.join(c.split, ["h", "norm"])
                              .select("id", F.sha2("norm", 256).alias("sha"), "size", "keep_id", "keep_n"))
    out = out.select("id", "sha", F.coalesce("size", F.lit(1).cast("long")).alias("size"),
                     F.when(F.col("size").isNull(), F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"),
                     F.coalesce("keep_n", F.lit(1).cast("long")).alias("keep_n"))
    is_keep = F.col("id").eqNullSafe(F.col("keep_id"))
    plain = out.filter(~is_keep | (F.col("keep_n") == 1)).withColumn("kept", is_keep)
    if c.tied:  # rows that share the id that stays are alike in every column here: one of them stays
        alike = (out.filter(is_keep & (F.col("keep_n") > 1))
                 .groupBy("id", "sha", "size", "keep_id", "keep_n").agg(F.count(F.lit(1)).alias("n"))
                 .withColumn("i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n")))))
        plain = plain.unionByName(alike.withColumn("kept", F.col("i") == 1).drop("i", "n"))
    return plain.select(F.col("id").alias(id_col), "keep_id", F.col("size").alias("group_size"), "kept",
                        F.col("sha").alias("text_sha256"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                hash_fn: Callable[[Column], Column] = md5_128) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    c = _Classes(docs, id_col, text_col, hash_fn, with_sha=False)
    norm = normalised(F.col(text_col).cast("string"))
    full = packed(docs, id=F.col(id_col), norm=norm).withColumn("h", hash_fn(F.col("norm")))
    plain = full.join(c.collided, "h", "left_anti") if c.n_collided else full
    joined = plain.join(c.multi, "h", "left").select("row", "id", "h", "size", "keep_id", "keep_n")
    if c.split is not None:
        joined = joined.unionByName(full.join(c.collided, "h", "left_semi").join(c.split, ["h", "norm"])
                                    .select("row", "id", F.unhex(F.sha2("norm", 256)).alias("h"), "size",
                                            "keep_id", "keep_n"))
    stays = F.col("size").isNull() | F.col("id").eqNullSafe(F.col("keep_id"))
    once = F.col("size").isNull() | (F.col("keep_n") == 1)
    kept = joined.filter(stays & once).select("row.*")
    if c.tied:  # several rows share id and text: the smallest by all columns stays
        ties = joined.filter(stays & ~once).groupBy("h").agg(F.min("row").alias("row"))
        kept = kept.union(ties.select("row.*"))
    return kept
