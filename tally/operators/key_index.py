"""Key index of an append-only table: which keys may be stored.

Beside each append, the keys' 64-bit hashes are kept as bitmaps, a set for
each month and level. A level has ``2^bits`` bits, at least ``BITS_PER_KEY``
for each row its month holds when the rows are appended, so the bitmaps of all
appends of a month and level can be united and stay at most 1/BITS_PER_KEY
full; a month that grows goes on to the next level. A key whose bit is unset
on every level of its month is not stored. One that is set may be: the exact
join decides, over the months with such keys alone.

All of it is built-in functions: bitmaps are built and united by aggregates
that combine in the map tasks, and travel as rows of 4 KB for 32,768 bits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bits of a level for each row of its month, and its least and largest size.
BITS_PER_KEY, LEAST_BITS, MOST_BITS = 64, 15, 46
#: Bits of one bitmap (fixed by the bitmap functions).
BITMAP_BITS = 32_768
#: Largest bitmap set that is broadcast to sift stored rows: 2^30 bits, 128 MB.
SIFT_BITS = 30

KEY_INDEX = T.StructType([
    T.StructField("ym", T.IntegerType(), False),
    T.StructField("bits", T.IntegerType(), False),
    T.StructField("bucket", T.LongType(), False),
    T.StructField("bitmap", T.BinaryType(), False),
])


def level(rows: int) -> int:
    """Level of a month that holds ``rows`` rows."""
    return min(max((max(rows, 1) * BITS_PER_KEY - 1).bit_length(), LEAST_BITS), MOST_BITS)


def key_hash(key: list[str]) -> Column:
    return F.xxhash64(*[F.col(k) for k in key])


def _place(hash_: Column, bits: Column) -> Column:
    return F.pmod(hash_, F.pow(F.lit(2), bits).cast("long"))


def _bucket(place: Column) -> Column:
    return F.floor(place / BITMAP_BITS).cast("long")


def _is_set(bitmap: Column, place: Column) -> Column:
    bit = F.pmod(place, F.lit(BITMAP_BITS)).cast("int")
    byte = F.conv(F.hex(F.substring(bitmap, F.floor(bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.pmod(F.floor(byte / F.pow(F.lit(2), F.pmod(bit, F.lit(8)))), F.lit(2)) == 1


def _bitmaps(placed: DataFrame, by: list[str]) -> DataFrame:
    return placed.groupBy(*by, _bucket(F.col("_place")).alias("bucket")).agg(
        F.bitmap_construct_agg(F.pmod(F.col("_place"), F.lit(BITMAP_BITS))).alias("bitmap"))


def index_rows(rows: DataFrame, key: list[str], levels: dict[int, int]) -> DataFrame:
    """Index of appended ``rows`` (key columns and ``ym``); ``levels`` gives
    each of their months its level (one entry a month)."""
    bits = F.create_map(*[F.lit(x) for pair in sorted(levels.items()) for x in pair])[F.col("ym")]
    placed = rows.select("ym", bits.alias("bits"), key_hash(key).alias("_h")).select(
        "ym", "bits", _place(F.col("_h"), F.col("bits")).alias("_place"))
    return _bitmaps(placed, ["ym", "bits"]).select(*[f.name for f in KEY_INDEX.fields])


def possible_hits(incoming: DataFrame, index: DataFrame, key: list[str]) -> DataFrame:
    """Distinct keys of ``incoming`` (key columns and ``ym``) that may be
    stored. Each key looks up the levels of its month (about ten at most, one
    for each doubling); index and keys meet by bitmap."""
    united = index.groupBy("ym", "bits", "bucket").agg(F.bitmap_or_agg("bitmap").alias("bitmap"))
    levels = index.groupBy("ym").agg(F.collect_set("bits").alias("_levels"))  # a row for each month
    keys = incoming.select(*key, "ym").distinct().withColumn("_h", key_hash(key))
    placed = keys.join(levels, "ym").withColumn("bits", F.explode("_levels")).drop("_levels") \
        .withColumn("_place", _place(F.col("_h"), F.col("bits"))).withColumn("bucket", _bucket(F.col("_place")))
    return (placed.join(united, ["ym", "bits", "bucket"]).filter(_is_set(F.col("bitmap"), F.col("_place")))
            .select(*key, "ym").distinct())


def sifted(stored: DataFrame, hits: DataFrame, n_hits: int, key: list[str]) -> DataFrame:
    """``stored`` rows whose key may be one of ``hits``: a broadcast bitmap of
    their hashes (16 bits a key up to SIFT_BITS) drops the others in the scan,
    so that only candidates go on to an exchange."""
    bits = F.lit(min(max((n_hits * 16 - 1).bit_length(), LEAST_BITS), SIFT_BITS))
    marks = _bitmaps(hits.select(_place(key_hash(key), bits).alias("_place")), [])
    placed = stored.withColumn("_place", _place(key_hash(key), bits)).withColumn("bucket", _bucket(F.col("_place")))
    return (placed.join(F.broadcast(marks), "bucket").filter(_is_set(F.col("bitmap"), F.col("_place")))
            .drop("_place", "bucket", "bitmap"))
