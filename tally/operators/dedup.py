"""Run-level and history-level duplicate elimination, counts, ids, history.

A6  first processed row per key       -> hash aggregation of the positions alone
                                          (map-side partial, so a hot key is
                                          combined per task), then a semi join
J1  new rows = incoming |> existing   -> left_anti on the key
J3  duplicates report                 -> left_semi
A2/A3 parsed / inserted per file      -> groupBy + left join (zero kept)
K5  ids in processing order           -> distributed dense ordinal
M5/M6 conditional run history         -> latest-by-file + anti condition
M7  dry run                           -> J1 without A6
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordinal import global_ordinal

LEDGER_KEY = ["date", "name", "price"]
ASSET_KEY = ["date"]


def keyed(df: DataFrame, key: list[str], collation: str | None = None) -> DataFrame:
    """Optionally compare string keys under a collation, e.g.
    ``UNICODE_CI_AI_RTRIM`` (case-, accent-, trailing-blank-insensitive)."""
    if not collation:
        return df
    out = df
    for k in key:
        if dict(df.dtypes)[k] == "string":
            out = out.withColumn(k, F.collate(F.col(k), collation))
    return out


def processing_order(reverse_rows: bool) -> Column:
    """Order in which rows are processed: file rank, then row position
    (ledger files are processed last row first, asset files first row first)."""
    idx = -F.col("row_idx") if reverse_rows else F.col("row_idx")
    return F.struct(F.col("file_rank"), idx)


# A position as one number: rank, then place in the file. Up to these bounds
# two positions never share a number.
MAX_RANK, PLACE_BITS = 1 << 22, 40


def _position_number(reverse_rows: bool) -> Column:
    """``processing_order`` as a long that never falls along it."""
    rank, last = F.col("file_rank").cast("long"), (1 << PLACE_BITS) - 1
    place = F.least(F.greatest(F.col("row_idx").cast("long"), F.lit(0)), F.lit(last))
    place = F.when(F.col("row_idx").isNull(), F.lit(0)).otherwise(F.lit(last) - place if reverse_rows else place)
    return (F.when(rank.isNull() | (rank < 0), F.lit(-1)).when(rank >= MAX_RANK, F.lit(MAX_RANK << PLACE_BITS))
            .otherwise(rank * F.lit(1 << PLACE_BITS) + place))


def first_processed(rows: DataFrame, key: list[str], reverse_rows: bool = True, unique_positions: bool = False) -> DataFrame:
    """Keep only the first processed row of each key. The least position
    of each key is found over keys and one number alone, in a hash table; whole
    rows are neither sorted nor held by a map task. ``unique_positions``: no
    two rows share a position, and ranks stay below MAX_RANK."""
    numbered = rows.withColumn("_position", _position_number(reverse_rows))
    least = numbered.groupBy(*key).agg(F.min("_position").alias("_position")).select("_position")
    rows = numbered.join(least, "_position", "left_semi").drop("_position")
    if unique_positions:
        return rows
    # the key columns come from the chosen row as well: under a collation the
    # grouping value may be the text of any row of the group
    return (rows.groupBy(*[F.col(k).alias(f"_key_{k}") for k in key])
            .agg(F.min_by(F.struct(*rows.columns), processing_order(reverse_rows)).alias("_r"))
            .select("_r.*"))


# Largest incoming key set broadcast to probe the stored keys: rows, and bytes
# of their text columns (counted by the importer).
MAX_BROADCAST_KEYS = 250_000
MAX_BROADCAST_BYTES = 32 << 20


def stored_hits(incoming: DataFrame, existing: DataFrame, key: list[str],
                incoming_rows: int | None) -> DataFrame:
    """Stored keys that an incoming row also has. With a counted incoming
    size below MAX_BROADCAST_KEYS the incoming keys are broadcast and the
    stored side is only scanned (map-side semi join, no shuffle of stored
    data). The result is distinct, so it has at most ``incoming_rows`` rows
    however many copies of a key are stored."""
    keys = incoming.select(*key)
    if incoming_rows is not None and incoming_rows <= MAX_BROADCAST_KEYS:
        keys = F.broadcast(keys)
    return existing.select(*key).join(keys, key, "left_semi").distinct()


def new_rows(incoming: DataFrame, existing: DataFrame, key: list[str],
             incoming_rows: int | None = None) -> DataFrame:
    """Incoming rows whose key is not in ``existing``. ``existing`` is
    pruned to the key columns (and should be pruned to the incoming date
    range by the caller, see ``plans.importer``). When ``incoming_rows``
    bounds the incoming side, the stored side is probed against broadcast
    incoming keys first and the (bounded) hits are broadcast back;
    otherwise one shuffled anti join."""
    if incoming_rows is not None and incoming_rows <= MAX_BROADCAST_KEYS:
        hits = stored_hits(incoming, existing, key, incoming_rows)
        return incoming.join(F.broadcast(hits), key, "left_anti")
    return incoming.join(existing.select(*key), key, "left_anti")


def duplicate_rows(incoming: DataFrame, existing: DataFrame, key: list[str],
                   incoming_rows: int | None = None) -> DataFrame:
    """Incoming rows skipped because their key is already stored."""
    if incoming_rows is not None and incoming_rows <= MAX_BROADCAST_KEYS:
        hits = stored_hits(incoming, existing, key, incoming_rows)
        return incoming.join(F.broadcast(hits), key, "left_semi")
    return incoming.join(existing.select(*key), key, "left_semi")


def import_plan(incoming: DataFrame, existing: DataFrame, key: list[str],
                reverse_rows: bool = True, dry_run: bool = False,
                incoming_rows: int | None = None, unique_positions: bool = False) -> DataFrame:
    """A6 + J1 (or M7: J1 alone). Returns the rows that are (or would be)
    inserted. ``incoming_rows``: counted size of ``incoming`` (see
    ``new_rows``)."""
    if dry_run:
        return new_rows(incoming, existing, key, incoming_rows)
    survivors = first_processed(incoming, key, reverse_rows, unique_positions)
    if incoming_rows is not None and incoming_rows <= MAX_BROADCAST_KEYS:
        # probe with the keys of all incoming rows (a superset of the
        # survivors' keys, and already computed) rather than the aggregate
        hits = stored_hits(incoming, existing, key, incoming_rows)
        return survivors.join(F.broadcast(hits), key, "left_anti")
    return new_rows(survivors, existing, key)


def file_counts(parsed: DataFrame, inserted: DataFrame,
                file_cols: tuple[str, ...] = ("src_file", "file_rank")) -> DataFrame:
    """A2/A3: parsed and inserted rows per file; files with no insert stay."""
    fc = list(file_cols)
    p = parsed.groupBy(*fc).agg(F.count(F.lit(1)).alias("parsed_entry_num"))
    i = inserted.groupBy(*fc).agg(F.count(F.lit(1)).alias("new_entry_num"))
    return (p.join(i, fc, "left")
            .withColumn("new_entry_num", F.coalesce(F.col("new_entry_num"), F.lit(0)).cast("long")))


def file_facts(files: DataFrame, parsed: DataFrame, inserted: DataFrame) -> DataFrame:
    """A2/A3 from the run's file list (src_path, src_file, file_rank): parsed
    and inserted rows of every file, those without a data row included."""
    mark = lambda df, p, n: df.select("src_path", F.lit(p).alias("_p"), F.lit(n).alias("_n"))
    sums = mark(parsed, 1, 0).unionAll(mark(inserted, 0, 1)).groupBy("src_path").agg(
        F.sum("_p").alias("parsed_entry_num"), F.sum("_n").alias("new_entry_num"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return (files.join(sums, "src_path", "left")
            .select("src_path", "src_file", "file_rank", zero("parsed_entry_num"), zero("new_entry_num")))


def latest_by(df: DataFrame, group: list[str], order: str, cols: list[str]) -> DataFrame:
    """The row with the largest ``order`` per group (max_by, partial
    aggregation; no per-group sort)."""
    return (df.groupBy(*group)
            .agg(F.max_by(F.struct(*[F.col(c) for c in cols]), F.col(order)).alias("_l"))
            .select(*group, *[F.col(f"_l.{c}").alias(c) for c in cols]))


def ledger_history_delta(counts: DataFrame, history: DataFrame) -> DataFrame:
    """M5: a history row is appended for a file when its last recorded run
    (by src_file, any job label) had a different parsed count, or when there
    is no last run. Files of one run that share a name follow each other in
    rank order: the one before is the last run of the next."""
    last = latest_by(history, ["src_file"], "id", ["parsed_entry_num"]) \
        .withColumnRenamed("parsed_entry_num", "last_parsed")
    joined = counts.join(last, "src_file", "left")
    if "file_rank" in counts.columns:  # a window per file name, over the files of a run
        before = F.lag("parsed_entry_num").over(Window.partitionBy("src_file").orderBy("file_rank"))
        joined = joined.withColumn("last_parsed", F.coalesce(before, F.col("last_parsed")))
    return (joined
            .filter(F.col("last_parsed").isNull()
                    | (F.col("last_parsed") != F.col("parsed_entry_num"))))


def asset_history_delta(counts: DataFrame) -> DataFrame:
    """M6: asset runs are recorded only when they inserted a row."""
    return counts.filter(F.col("new_entry_num") >= 1)


def assign_ids(new: DataFrame, base_id: Column | int, reverse_rows: bool = True,
               name: str = "id", num_partitions: int | None = None) -> DataFrame:
    """K5: ids ascend by file rank, then processing order inside the file,
    starting after ``base_id`` (the largest stored id). Dense, and computed
    without a global single-task window (see ``ordinal``)."""
    idx = -F.col("row_idx") if reverse_rows else F.col("row_idx")
    ordered = global_ordinal(new, [F.col("file_rank"), idx], "_ord", num_partitions)
    base = base_id if isinstance(base_id, Column) else F.lit(base_id)
    return ordered.withColumn(name, (base + F.col("_ord") + 1).cast("long")).drop("_ord")
