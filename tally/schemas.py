"""Schemas of the ledger tables and of the two CSV layouts."""

from __future__ import annotations

from pyspark.sql import types as T

# Positional CSV columns; meaning comes from the position alone.
LEDGER_CSV_COLS = ["calc_flag", "raw_date", "name", "raw_price", "fin_ins",
                   "l_category", "m_category", "memo", "transfer", "source_id"]
ASSET_CSV_COLS = ["raw_date", "raw_total", "raw_cash", "raw_stocks",
                  "raw_trusts", "raw_points", "details"]
CORRUPT = "_corrupt"


def csv_schema(cols: list[str]) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType(), True) for c in cols]
                        + [T.StructField(CORRUPT, T.StringType(), True)])


LEDGER_CSV = csv_schema(LEDGER_CSV_COLS)
ASSET_CSV = csv_schema(ASSET_CSV_COLS)

# Header markers (fixed values): first column of a header row.
LEDGER_HEADER_MARK = "計算対象"
ASSET_HEADER_MARK = "日付"

# detail: append-only facts; the two status dates live in detail_status.
DETAIL = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("yyyymm_id", T.IntegerType(), False),
    T.StructField("date", T.DateType(), False),
    T.StructField("name", T.StringType(), False),
    T.StructField("price", T.LongType(), False),
    T.StructField("fin_ins", T.StringType(), False),
    T.StructField("l_category", T.StringType(), False),
    T.StructField("m_category", T.StringType(), False),
    T.StructField("regist_date", T.DateType(), False),
    T.StructField("raw_date", T.StringType(), False),
    T.StructField("raw_price", T.StringType(), False),
    T.StructField("src_file", T.StringType(), True),
    T.StructField("created_at", T.TimestampType(), True),
    T.StructField("updated_at", T.TimestampType(), True),
    T.StructField("ym", T.IntegerType(), True),   # partition: yyyyMM of date
])

DETAIL_STATUS = T.StructType([
    T.StructField("detail_id", T.LongType(), False),
    T.StructField("op", T.StringType(), False),       # check | forward | reset
    T.StructField("at", T.DateType(), False),
    T.StructField("seq", T.LongType(), False),        # batch number, not clock
    T.StructField("written_at", T.TimestampType(), True),
])

EXTRACT_RULE = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("field_name", T.StringType(), True),
    T.StructField("value", T.StringType(), True),
    T.StructField("exact_match", T.IntegerType(), True),
    T.StructField("category_id", T.LongType(), True),
    T.StructField("created_at", T.TimestampType(), True),
    T.StructField("updated_at", T.TimestampType(), True),
])

IMPORT_HISTORY = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("job_label", T.StringType(), True),
    T.StructField("parsed_entry_num", T.LongType(), False),
    T.StructField("new_entry_num", T.LongType(), False),
    T.StructField("src_file", T.StringType(), True),
    T.StructField("created_at", T.TimestampType(), True),
    T.StructField("updated_at", T.TimestampType(), True),
])

ASSET_HISTORY = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("date", T.DateType(), False),
    T.StructField("total_amount", T.LongType(), False),
    T.StructField("cash_deposit_crypto", T.LongType(), False),
    T.StructField("stocks", T.LongType(), False),
    T.StructField("investment_trusts", T.LongType(), False),
    T.StructField("points", T.LongType(), False),
    T.StructField("details", T.StringType(), True),
    T.StructField("created_at", T.TimestampType(), True),
    T.StructField("updated_at", T.TimestampType(), True),
])

# one row per classification batch: everything with id <= hwm was judged
CLASSIFY_RUN = T.StructType([
    T.StructField("seq", T.LongType(), False),
    T.StructField("hwm", T.LongType(), True),
    T.StructField("judged", T.LongType(), True),
    T.StructField("forwarded", T.LongType(), True),
    T.StructField("at", T.DateType(), True),
])

OUTBOX = T.StructType([
    T.StructField("detail_id", T.LongType(), False),
    T.StructField("seq", T.LongType(), False),
    T.StructField("category_id", T.LongType(), False),
    T.StructField("datetime", T.StringType(), False),
    T.StructField("price", T.LongType(), False),
    T.StructField("from", T.StringType(), False),
    T.StructField("type", T.StringType(), True),
    T.StructField("memo", T.StringType(), True),
])

RULE_REQUEST = T.StructType([
    T.StructField("fieldName", T.StringType(), True),
    T.StructField("value", T.StringType(), True),
    T.StructField("categoryId", T.LongType(), True),
    T.StructField("exactMatch", T.IntegerType(), True),
])
