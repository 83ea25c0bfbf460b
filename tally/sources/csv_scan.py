"""Strict positional CSV scans with file, rank and row position.

The reader is RFC-4180 (doubled quotes, quoted newlines) and never infers or
uses a header: a header row is recognised by value, anywhere in the file.
Each output row carries

* ``src_path`` / ``src_file``  full path and basename of its file,
* ``file_rank``  0-based rank of the file in name order (processing order),
* ``row_idx``    0-based position of the record in its file, header included,
* ``n_file_rows``  records in the file, header included.

Files are read as lines, so a file of any size is cut into splits that many
tasks read, quoted newlines or not:

1. One pass over the text stamps each line with what its task has read before
   it - lines, odd lines (an odd number of quotes), record starts - under both
   assumptions about the quotes in front of the split, and whether its quoting
   is broken if it begins outside or inside quotes. The lines are written once.
2. Sums per split, and a prefix sum over the splits of each file (the split
   table: one row per input split), tell whether a split begins inside quotes,
   how many records come before it, and which files have broken quoting.
3. A line outside quotes with closed quotes is a record. Only the lines of
   records that span several lines meet in a shuffle, keyed by their record.
4. ``from_csv`` splits each record into its fields.

A file with broken quoting (a quote inside a bare field, text behind a closing
quote, an open quote at its end) is refused as the source's reader does: it
yields one corrupt record. A line ends at a line feed; a carriage return in
front of it is dropped, also inside quotes. Empty lines outside quotes are no
records.
"""

from __future__ import annotations

import re
import urllib.parse

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.parse import basename
from ..schemas import ASSET_CSV, CORRUPT, LEDGER_CSV
from ..session import lap, stage

# Accepted charset names (fixed values): case-insensitive.
ENCODINGS = {"utf8": "UTF-8", "sjis": "Shift_JIS"}

# Largest counted split table that is broadcast (rows = input splits).
MAX_BROADCAST_SPLITS = 200_000


def resolve_encoding(name: str | None) -> str:
    """Unset means UTF-8; anything but utf8/sjis is a start-up error."""
    key = (name or "utf8").lower()
    if key not in ENCODINGS:
        raise ValueError(f"unsupported csv encoding: {name!r} (expected utf8 or sjis)")
    return ENCODINGS[key]


def require_charset(spark: SparkSession, charset: str) -> None:
    """Spark 4 refuses legacy charsets, and stops at a malformed character,
    unless ``ENGINE_CONF`` is applied; the caller's session is not changed here."""
    for conf in ("spark.sql.legacy.javaCharsets", "spark.sql.legacy.codingErrorAction"):
        if charset != "UTF-8" and spark.conf.get(conf, "false") != "true":
            raise ValueError(f"{charset} needs {conf}=true (see tally.session.ENGINE_CONF)")


def plain_path(path):
    """File paths as one form: ``file:/x`` and ``file:///x`` are the same."""
    return F.regexp_replace(path, "^file:/+", "file:/")


def file_name(path):
    """Basename of a file URI, decoded. A ``+`` in a URI path is a plus."""
    return F.url_decode(F.replace(basename(path), F.lit("+"), F.lit("%2B")))


def run_files(spark: SparkSession, uris: list[str]) -> DataFrame:
    """The files of a run: src_path (URI), src_file (decoded name) and
    file_rank in name order. Files without a record are in it too. ``uris``
    is the listing Spark's planner already holds on the driver."""
    rows = [(re.sub("^file:/+", "file:/", u), urllib.parse.unquote(u.rsplit("/", 1)[-1])) for u in uris]
    rows = sorted(set(rows), key=lambda r: (r[1], r[0]))
    return spark.createDataFrame([(p, n, i) for i, (p, n) in enumerate(rows)],
                                 "src_path string, src_file string, file_rank long")


def read_text(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """The lines of the files as Spark reads them (bytes, not decoded)."""
    return spark.read.option("lineSep", "\n").text([paths] if isinstance(paths, str) else list(paths))


# A field: quoted, up to its closing quote or (open) the end of the line, or
# bare. A line that begins outside quotes is fields between commas; one that
# begins inside goes on to the closing quote first. Parity of the quotes is
# checked apart, so a line with closed quotes has no open field.
_FIELD = r'(?:"[^"]*+(?:""[^"]*+)*+(?:"|\z)|[^",]*+)'
_OUTSIDE = rf"\A{_FIELD}(?:,{_FIELD})*+\z"
_INSIDE = rf'\A[^"]*+(?:""[^"]*+)*+(?:"(?:,{_FIELD})*+)?\z'


_LOCAL_MASK = (1 << 33) - 1  # monotonically_increasing_id keeps the record number in the low 33 bits


def _count() -> Column:
    """Number of rows of this task that were evaluated here before."""
    return F.monotonically_increasing_id().bitwiseAND(F.lit(_LOCAL_MASK))


def _earlier(flag: Column) -> Column:
    """Rows of this task before this one for which ``flag`` holds. Each branch
    counts the rows that take it; ``_at`` counts all."""
    return F.when(flag, _count()).otherwise(F.col("_at") - _count())


def stamped_lines(text: DataFrame, charset: str) -> DataFrame:
    """Step 1: lines of ``read_text`` with their stamps. ``_even`` and ``_odd``
    are the assumptions that a line before which the task has read an even
    (odd) number of odd lines begins outside quotes."""
    value = F.col("value") if charset == "UTF-8" else F.decode(F.col("value").cast("binary"), charset)
    lines = text.select(
        F.when(value.endswith("\r"), F.regexp_replace(value, r"\r\z", "")).otherwise(value).alias("value"),
        plain_path(F.col("_metadata.file_path")).alias("src_path"),
        F.col("_metadata.file_block_start").alias("_block"), _count().alias("_at"))
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    lines = lines.select("*", (quotes > 0).alias("_quoted"), (quotes % 2).alias("_odd_line"))
    lines = lines.select("*", _earlier(F.col("_odd_line") == 1).alias("_odds"))
    begins = lambda parity: (F.col("_odds") % 2 == parity) & (F.col("value") != "")
    return lines.select(
        "src_path", "_block", "_at", "value", "_odd_line", "_odds",
        _earlier(begins(0)).alias("_before_even"), begins(0).alias("_starts_even"),
        _earlier(begins(1)).alias("_before_odd"), begins(1).alias("_starts_odd"),
        (F.col("_quoted") & ~F.col("value").rlike(_OUTSIDE)).alias("_bad"),
        (F.col("_quoted") & ~F.col("value").rlike(_INSIDE)).alias("_bad_inside"))


def split_table(lines: DataFrame, files: DataFrame, multiline: bool = True) -> DataFrame:
    """Step 2: one row per split that holds a line. Without ``multiline`` a
    quote left open at the end of a line is broken quoting."""
    even = F.col("_odds") % 2 == 0
    count = lambda c: F.sum(F.col(c).cast("long"))
    s = lines.groupBy("src_path", "_block").agg(
        F.min("_odds").alias("_odds0"), count("_odd_line").alias("_n_odd"),
        F.min("_before_even").alias("_even0"), count("_starts_even").alias("_n_even"),
        F.min("_before_odd").alias("_odd0"), count("_starts_odd").alias("_n_odd_starts"),
        F.max(F.when(even, F.col("_bad")).otherwise(F.col("_bad_inside"))).alias("_bad_even"),
        F.max(F.when(even, F.col("_bad_inside")).otherwise(F.col("_bad"))).alias("_bad_odd"))
    per_file, all_splits = Window.partitionBy("src_path").orderBy("_block"), Window.partitionBy("src_path")
    before = lambda c: F.coalesce(F.sum(c).over(per_file.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    s = s.withColumn("_as_even", F.pmod(before("_n_odd") - F.col("_odds0"), F.lit(2)) == 0)
    own = lambda a, b: F.when(F.col("_as_even"), F.col(a)).otherwise(F.col(b))
    s = s.withColumn("_n", own("_n_even", "_n_odd_starts")).withColumn("_b", own("_bad_even", "_bad_odd"))
    odd = F.sum("_n_odd").over(all_splits)
    broken = F.max("_b").over(all_splits) | ((odd % 2 == 1) if multiline else (odd > 0))
    s = s.select("src_path", "_block", "_as_even", own("_even0", "_odd0").alias("_base"), before("_n").alias("_off"),
                 F.sum("_n").over(all_splits).alias("n_file_rows"), broken.alias("_broken"),
                 (F.row_number().over(per_file) == 1).alias("_first"), "_n_odd")
    return s.join(files, "src_path")


def records(lines: DataFrame, splits: DataFrame, n_splits: int, spans: bool) -> DataFrame:
    """Step 3: the records of all files that are not broken, as text, with
    their positions. ``spans``: whether any file has records of several lines."""
    facts = splits.filter(~F.col("_broken")).drop("_broken", "_first", "_n_odd")
    own = lines.join(F.broadcast(facts) if n_splits <= MAX_BROADCAST_SPLITS else facts, ["src_path", "_block"])
    begins_inside = (F.col("_odds") % 2 == 1) == F.col("_as_even")
    begun = F.when(F.col("_as_even"), F.col("_before_even")).otherwise(F.col("_before_odd"))
    starts = ~begins_inside & (F.col("value") != "")
    at = (F.col("_off") + begun - F.col("_base") - F.when(starts, 0).otherwise(1)).alias("row_idx")
    facts_of = ["src_path", "src_file", "file_rank", "n_file_rows"]
    alone = own.filter(starts & (F.col("_odd_line") == 0)).select("value", *facts_of, at)
    if not spans:
        return alone
    parts = own.filter(begins_inside | (F.col("_odd_line") == 1)).select("value", "_block", "_at", "file_rank", at)
    whole = (parts.groupBy("file_rank", "row_idx")  # the lines of one record
             .agg(F.array_sort(F.collect_list(F.struct("_block", "_at", "value"))).alias("_lines"))
             .select(F.array_join(F.col("_lines.value"), "\n").alias("value"), "file_rank", "row_idx"))
    of_file = splits.filter("_first").select(*facts_of)  # a rank is one file's
    whole = whole.join(F.broadcast(of_file) if n_splits <= MAX_BROADCAST_SPLITS else of_file, "file_rank").select(
        "value", *facts_of, "row_idx")
    return alone.unionByName(whole)


# Text that one task reads, about, where splits are smaller than that.
TASK_BYTES = 32 << 20


def _staged_lines(text: DataFrame, charset: str, split_bytes: int | None) -> DataFrame:
    """The stamped lines, written once. A split size of the caller's holds for
    the text alone, and one task reads many small splits one behind the other:
    each keeps its own stamps, as they are counted before ``coalesce``."""
    lines = stamped_lines(text, charset)
    if split_bytes is None:
        return stage(lines, "lines")
    spark, size = text.sparkSession, "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(size)
    spark.conf.set(size, str(split_bytes))
    try:
        n_splits = text.select("value").rdd.getNumPartitions()  # planned, not read
        tasks = max(-(-n_splits * split_bytes // TASK_BYTES), spark.sparkContext.defaultParallelism)
        return stage(lines.coalesce(tasks), "lines")
    finally:
        spark.conf.set(size, before)


def scan_positioned(spark: SparkSession, paths: list[str] | str | DataFrame, schema, encoding: str = "utf8",
                    multiline: bool = True, files: DataFrame | None = None, split_bytes: int | None = None) -> DataFrame:
    """Fields as strings, ``_corrupt`` and the positions. The lines are written
    once (shared checkpoint folder), so a lost executor reads the same stamps
    again. ``paths`` may be a ``read_text`` frame, already listed; ``files``
    may rank the files among others of the run. ``split_bytes``: size of the
    files' splits, if not the session's."""
    charset = resolve_encoding(encoding)
    require_charset(spark, charset)
    text = paths if isinstance(paths, DataFrame) else read_text(spark, paths)
    files = run_files(spark, text.inputFiles()) if files is None else files  # already listed for planning
    lines = _staged_lines(text, charset, split_bytes)
    lap("lines staged")
    facts = Observation()  # taken as the table is written
    splits = stage(split_table(lines, files, multiline).observe(facts, F.count(F.lit(1)).alias("n"), F.max("_n_odd").alias("odd")), "splits")
    lap("splits staged")
    rows = records(lines, splits, facts.get["n"], bool(facts.get["odd"]))
    options = {"quote": '"', "escape": '"', "mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}
    ddl = ", ".join(f"{f.name} string" for f in schema.fields)
    positions = ["src_path", "src_file", "file_rank", "row_idx", "n_file_rows"]
    good = rows.select(F.from_csv("value", ddl, options).alias("_r"), *positions).select("_r.*", *positions)
    refused = splits.filter(F.col("_broken") & F.col("_first")).withColumn("row_idx", F.lit(0).cast("long")).select(
        *[F.lit(None).cast("string").alias(f.name) for f in schema.fields if f.name != CORRUPT],
        F.lit('"').alias(CORRUPT), *positions)
    return good.unionByName(refused)


def scan_ledger_csv(spark: SparkSession, paths, encoding: str = "utf8", multiline: bool = True,
                    files: DataFrame | None = None, split_bytes: int | None = None) -> DataFrame:
    """S3: 10 positional string columns + ``_corrupt`` + positions."""
    return scan_positioned(spark, paths, LEDGER_CSV, encoding, multiline, files, split_bytes)


def scan_asset_csv(spark: SparkSession, paths, encoding: str = "utf8", multiline: bool = True,
                   files: DataFrame | None = None, split_bytes: int | None = None) -> DataFrame:
    """7 positional string columns + ``_corrupt`` + positions."""
    return scan_positioned(spark, paths, ASSET_CSV, encoding, multiline, files, split_bytes)
