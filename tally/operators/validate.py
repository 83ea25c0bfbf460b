"""F1-F4 typing of scanned CSV rows, reject reasons and the M9 file policy.

Input: rows of ``sources.csv_scan`` (raw strings + positions). Output: one
row per record with ``is_header``, the typed columns and ``reject`` (NULL
for a good row). A record with the wrong arity is a reject even when it
looks like a header (arity is checked first).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.parse import asset_date, ledger_date, signed_amount, unsigned_price
from ..schemas import ASSET_HEADER_MARK, CORRUPT, LEDGER_HEADER_MARK

POS_COLS = ["src_path", "src_file", "file_rank", "row_idx", "n_file_rows"]
LEDGER_TEXT = ["name", "fin_ins", "l_category", "m_category"]


def _txt(c: str):
    # CSV empty fields arrive as NULL; the source reader gives ''
    return F.coalesce(F.col(c), F.lit(""))


def type_ledger(raw: DataFrame, run_date=None) -> DataFrame:
    """F1-F3 + C1/C2 + W1. ``yyyymm_id`` = records in file - position, with
    the header counted, as the source numbering does."""
    bad_arity = F.col(CORRUPT).isNotNull()
    header = ~bad_arity & (_txt("calc_flag") == F.lit(LEDGER_HEADER_MARK))
    date = ledger_date(_txt("raw_date"))
    price = unsigned_price(_txt("raw_price"))
    reject = (F.when(bad_arity, F.lit("arity"))
              .when(header, F.lit(None))
              .when(date.isNull(), F.lit("date"))
              .when(price.isNull(), F.lit("price")))
    rd = F.current_date() if run_date is None else F.lit(run_date).cast("date")
    return raw.select(
        *POS_COLS,
        header.alias("is_header"),
        reject.alias("reject"),
        (F.col("n_file_rows") - F.col("row_idx")).cast("int").alias("yyyymm_id"),
        date.alias("date"),
        *[_txt(c).alias(c) for c in LEDGER_TEXT],
        price.alias("price"),
        rd.alias("regist_date"),
        _txt("raw_date").alias("raw_date"),
        _txt("raw_price").alias("raw_price"),
        _txt("source_id").alias("source_id"),
    )


ASSET_AMOUNTS = [("raw_total", "total_amount"), ("raw_cash", "cash_deposit_crypto"),
                 ("raw_stocks", "stocks"), ("raw_trusts", "investment_trusts"),
                 ("raw_points", "points")]


def type_asset(raw: DataFrame) -> DataFrame:
    """F1, F2, F4 + C3-C5."""
    bad_arity = F.col(CORRUPT).isNotNull()
    header = ~bad_arity & (_txt("raw_date") == F.lit(ASSET_HEADER_MARK))
    date = asset_date(_txt("raw_date"))
    amounts = [signed_amount(_txt(src)).alias(dst) for src, dst in ASSET_AMOUNTS]
    reject = F.when(bad_arity, F.lit("arity")).when(header, F.lit(None)).when(date.isNull(), F.lit("date"))
    for (src, dst) in ASSET_AMOUNTS:
        reject = reject.when(signed_amount(_txt(src)).isNull(), F.lit(dst))
    return raw.select(*POS_COLS, header.alias("is_header"), reject.alias("reject"),
                      date.alias("date"), *amounts, _txt("details").alias("details"))


def file_report(typed: DataFrame) -> DataFrame:
    """Per file: parsed rows (header excluded), rejects, first bad position."""
    data = ~F.col("is_header")
    return (typed.groupBy("src_path", "src_file", "file_rank")
            .agg(F.count(F.when(data & F.col("reject").isNull(), 1)).alias("parsed_rows"),
                 F.count(F.when(F.col("reject").isNotNull(), 1)).alias("rejected_rows"),
                 F.min(F.when(F.col("reject").isNotNull(), F.col("row_idx"))).alias("first_bad_row")))


def abort_cut(typed: DataFrame) -> int | None:
    """M9 ``abort``: the rank of the first file with a bad row (None = all
    good). One scalar from the per-file report."""
    return (typed.filter(F.col("reject").isNotNull())
            .agg(F.min("file_rank")).first()[0])


def accepted(typed: DataFrame, policy: str = "abort", cut=None) -> tuple[DataFrame, DataFrame]:
    """M9. Returns (accepted data rows, per-file report with ``imported``).

    ``abort``: one bad row rejects its file and every later file; earlier
    files are still imported. ``quarantine``: only the bad files are held
    back. ``cut`` is the abort rank when already known (an int, or None for
    "all good"); when omitted it stays a scalar subquery (no collect, no
    join)."""
    report = file_report(typed)
    if policy == "abort":
        if cut is None or isinstance(cut, int):
            keep = F.lit(True) if cut is None else F.col("file_rank") < F.lit(cut)
        else:
            keep = cut.isNull() | (F.col("file_rank") < cut)
        report = report.withColumn("imported", keep)
        rows = typed.filter(keep)
    elif policy == "quarantine":
        report = report.withColumn("imported", F.col("rejected_rows") == 0)
        bad = report.filter(~F.col("imported")).select("src_path")
        rows = typed.join(bad, "src_path", "left_anti")
    else:
        raise ValueError(f"unknown policy {policy!r}")
    return rows.filter(~F.col("is_header") & F.col("reject").isNull()).drop("is_header", "reject"), report


def apply_policy(typed: DataFrame, policy: str = "abort") -> tuple[DataFrame, DataFrame]:
    """M9 without a known cut: the abort rank is a scalar subquery."""
    if policy not in ("abort", "quarantine"):
        raise ValueError(f"unknown policy {policy!r}")
    cut = (typed.filter(F.col("reject").isNotNull()).agg(F.min("file_rank")).scalar()
           if policy == "abort" else None)
    return accepted(typed, policy, cut)


def rejects(typed: DataFrame) -> DataFrame:
    """The rejected records themselves (quarantine output)."""
    return typed.filter(F.col("reject").isNotNull())
