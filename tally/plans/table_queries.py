"""The registered query set over the driver tables.

The driver tables are not ledgers, so each query first maps a table to
ledger columns (raw text is synthesised from the data so that the parsers
really parse), then runs the library operator on the whole table. Every
query has a DuckDB SQL twin in ``ORACLE_SQL`` with the same column names.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import parse as P
from ..schemas import CORRUPT
from ..operators import dedup, rules as R, status as S, validate, views
from ..operators.ordinal import global_ordinal, rank_within, small_ordinal


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def _files_ranked(df: DataFrame, file_col: str) -> DataFrame:
    """file_rank = 0-based rank of the file name; the per-file table has one
    row per file and is joined back by equi-join."""
    files = global_ordinal(df.select(F.col(file_col).alias("_f")).distinct(), [F.col("_f")], "file_rank")
    return df.join(files, df[file_col] == files["_f"]).drop("_f")


# --------------------------------------------------------------------------
# shared mappings
# --------------------------------------------------------------------------

def _orders_raw_date() -> Column:
    d = F.col("o_orderdate")
    return (F.when(F.col("o_orderpriority") == "5-LOW", F.date_format(d, "MM/dd"))
            .when(F.col("o_orderpriority") == "1-URGENT", F.date_format(d, "yyyy/M/d"))
            .otherwise(F.date_format(d, "yyyy/MM/dd")))


def _orders_raw_price() -> Column:
    fmt = F.format_number(F.floor("o_totalprice"), 0)
    return (F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("-"), fmt))
            .when(F.col("o_orderstatus") == "O", F.concat(F.lit('"'), fmt, F.lit('"')))
            .otherwise(F.concat(fmt, F.lit("a"))))


def _events_as_ledger(ev: DataFrame) -> DataFrame:
    """events -> ledger rows: key (day, event_type, floor(value)); file =
    user_id (rank = user_id order); row position = event_id."""
    return ev.select(
        F.to_date("ts").alias("date"), F.col("event_type").alias("name"),
        F.floor("value").cast("long").alias("price"),
        F.col("event_id"), F.col("user_id"),
        F.col("user_id").alias("file_rank"), F.col("event_id").alias("row_idx"))


CUT_EXISTING = "2024-01-16"
CUT_INCOMING = "2024-01-10"


def _events_split(spark, sf_dir):
    ev = _t(spark, sf_dir, "events")
    existing = _events_as_ledger(ev.filter(F.col("ts") < F.lit(CUT_EXISTING).cast("timestamp_ntz")))
    incoming = _events_as_ledger(ev.filter(F.col("ts") >= F.lit(CUT_INCOMING).cast("timestamp_ntz")))
    return existing, incoming


_IMPORT_COLS = ["date", "name", "price", "event_id", "user_id"]


def _derived_rules(spark, sf_dir) -> DataFrame:
    """Extract rules derived from ``part``: exact rules carry a whole name or
    type, substring rules a fragment; sizes above 48 carry an unknown field."""
    p = _t(spark, sf_dir, "part")
    size = F.col("p_size")
    exact = (size <= 8) | ((size > 20) & (size <= 30))
    field = (F.when(size <= 20, F.lit("name")).when(size <= 48, F.lit("m_category"))
             .otherwise(F.lit("memo")))
    noun = F.element_at(F.split(F.col("p_name"), " "), -1)
    value = (F.when(size <= 8, F.col("p_name")).when(size <= 20, noun)
             .when(size <= 30, F.col("p_type")).otherwise(F.substring("p_type", 2, 3)))
    return p.select(
        (F.col("p_partkey") + 1).cast("long").alias("id"),
        field.alias("field_name"), value.alias("value"),
        F.when(exact, F.lit(1)).when(size % 2 == 0, F.lit(0)).otherwise(F.lit(None)).cast("int").alias("exact_match"),
        (F.floor("p_retailprice").cast("long") % 300 + 100).alias("category_id"))


_RULES_SQL = """
rules AS (
  SELECT CAST(p_partkey + 1 AS BIGINT) AS id,
         CASE WHEN p_size <= 20 THEN 'name' WHEN p_size <= 48 THEN 'm_category' ELSE 'memo' END AS field_name,
         CASE WHEN p_size <= 8 THEN p_name
              WHEN p_size <= 20 THEN string_split(p_name, ' ')[-1]
              WHEN p_size <= 30 THEN p_type
              ELSE substr(p_type, 2, 3) END AS value,
         CAST(CASE WHEN p_size <= 8 OR (p_size > 20 AND p_size <= 30) THEN 1
                   WHEN p_size % 2 = 0 THEN 0 END AS INTEGER) AS exact_match,
         CAST(floor(p_retailprice) AS BIGINT) % 300 + 100 AS category_id
  FROM part)"""


def _part_rows(spark, sf_dir) -> DataFrame:
    return _t(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"), F.col("p_name").alias("name"),
        F.col("p_type").alias("m_category"), F.col("p_brand").alias("fin_ins"),
        F.date_add(F.lit("2024-01-01").cast("date"), F.col("p_size")).alias("date"),
        F.floor("p_retailprice").cast("long").alias("price"))


def _orders_detail(spark, sf_dir) -> DataFrame:
    """orders -> detail rows with status events: F forwarded, P judged."""
    o = _t(spark, sf_dir, "orders")
    d = F.to_date("o_orderdate")
    return o.select(
        F.col("o_orderkey").alias("id"), d.alias("date"),
        F.col("o_orderpriority").alias("name"),
        F.floor("o_totalprice").cast("long").alias("price"),
        d.alias("regist_date"),
        F.when(F.col("o_orderstatus").isin("F", "P"), F.date_add(d, 1)).alias("maw_check_date"),
        F.when(F.col("o_orderstatus") == "F", F.date_add(d, 1)).alias("maw_regist_date"))


def _orders_events(spark, sf_dir) -> DataFrame:
    o = _t(spark, sf_dir, "orders")
    return o.filter(F.col("o_orderstatus").isin("F", "P")).select(
        F.col("o_orderkey").alias("detail_id"),
        F.when(F.col("o_orderstatus") == "F", F.lit("forward")).otherwise(F.lit("check")).alias("op"),
        F.date_add(F.to_date("o_orderdate"), 1).alias("at"),
        F.lit(1).cast("long").alias("seq"))


def _assets(spark, sf_dir) -> DataFrame:
    """orders daily totals as asset snapshots."""
    o = _t(spark, sf_dir, "orders")
    return (o.groupBy(F.to_date("o_orderdate").alias("date"))
            .agg(F.sum(F.floor("o_totalprice")).cast("long").alias("total_amount"),
                 F.count(F.lit(1)).alias("points")))


def _history_from_events(ev: DataFrame) -> DataFrame:
    return ev.select(
        F.col("event_id").alias("id"), F.col("event_type").alias("job_label"),
        F.col("user_id").cast("long").alias("parsed_entry_num"),
        F.floor("value").cast("long").alias("new_entry_num"),
        F.format_string("u%04d", F.col("user_id")).alias("src_file"),
        F.col("ts").alias("updated_at"))


def _epoch_ntz(c: Column) -> Column:
    """C12 for a zone-less timestamp (no session-zone shift)."""
    return F.timestamp_diff("SECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), c)


# --------------------------------------------------------------------------
# queries
# --------------------------------------------------------------------------

def q_parse_ledger_date(spark, sf_dir):
    o = _t(spark, sf_dir, "orders").select("o_orderkey", _orders_raw_date().alias("raw_date"))
    d = P.ledger_date("raw_date")
    return o.select("o_orderkey", "raw_date", d.alias("date"), d.isNotNull().alias("valid"))


def q_parse_price(spark, sf_dir):
    o = _t(spark, sf_dir, "orders").select("o_orderkey", _orders_raw_price().alias("raw_price"))
    p = P.unsigned_price("raw_price")
    return o.select("o_orderkey", "raw_price", p.alias("price"), p.isNotNull().alias("valid"))


def q_parse_amount(spark, sf_dir):
    c = _t(spark, sf_dir, "customer")
    fmt = F.format_number(F.floor("c_acctbal"), 0)
    raw = (F.when(F.col("c_mktsegment") == "BUILDING", F.concat(F.lit('"'), fmt, F.lit('"')))
           .when(F.col("c_mktsegment") == "AUTOMOBILE", F.concat(fmt, F.lit(" yen")))
           .otherwise(fmt))
    c = c.select("c_custkey", raw.alias("raw_amount"))
    a = P.signed_amount("raw_amount")
    return c.select("c_custkey", "raw_amount", a.alias("amount"), a.isNotNull().alias("valid"))


def q_parse_month_end(spark, sf_dir):
    o = _t(spark, sf_dir, "orders")
    d = F.col("o_orderdate")
    raw = (F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"),
                  F.concat(F.date_format(d, "yyyy-MM"), F.lit(P.MONTH_END_SUFFIX)))
           .when(F.col("o_orderpriority") == "3-MEDIUM",
                 F.concat(F.date_format(d, "yyyy"), F.lit("-13" + P.MONTH_END_SUFFIX)))
           .when(F.col("o_orderpriority") == "5-LOW", F.date_format(d, "yyyy/MM/dd"))
           .otherwise(F.date_format(d, "yyyy-MM-dd")))
    o = o.select("o_orderkey", raw.alias("raw_date"))
    a = P.asset_date("raw_date")
    return o.select("o_orderkey", "raw_date", a.alias("date"), a.isNotNull().alias("valid"))


def q_split_rejects(spark, sf_dir):
    o = _t(spark, sf_dir, "orders")
    d = F.col("o_orderdate")
    raw_date = F.when((F.col("o_orderpriority") == "5-LOW") & (F.col("o_orderstatus") == "P"),
                      F.date_format(d, "MM/dd")).otherwise(F.date_format(d, "yyyy/MM/dd"))
    ragged = (F.col("o_orderpriority") == "5-LOW") & (F.col("o_orderkey") % 97 == 5)
    raw = _files_ranked(o.select(
        F.col("o_orderpriority").alias("src_file"), F.col("o_orderpriority").alias("src_path"),
        F.col("o_orderkey").alias("row_idx"), F.lit(1).alias("n_file_rows"),
        F.lit("1").alias("calc_flag"), raw_date.alias("raw_date"), F.col("o_orderpriority").alias("name"),
        F.concat(F.lit("-"), F.format_number(F.floor("o_totalprice"), 0)).alias("raw_price"),
        *[F.lit("").alias(c) for c in ("fin_ins", "l_category", "m_category", "source_id")],
        F.when(ragged, F.lit("a,b")).alias(CORRUPT)), "src_file")
    _, report = validate.apply_policy(validate.type_ledger(raw, "2024-01-01"), "abort")
    return report.select("src_file", "file_rank", "parsed_rows", "rejected_rows", "first_bad_row", "imported")


def q_reverse_position(spark, sf_dir):
    ev = _t(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("src_file"))
    r = rank_within(ev, ["src_file"], [F.col("event_id")], pos="row_idx", size="n_file_rows")
    return r.select("event_id", "src_file", "row_idx",
                    (F.col("n_file_rows") - F.col("row_idx")).cast("int").alias("yyyymm_id"))


def q_dedup_in_run(spark, sf_dir):
    rows = _events_as_ledger(_t(spark, sf_dir, "events"))
    return dedup.first_processed(rows, dedup.LEDGER_KEY, reverse_rows=True).select(*_IMPORT_COLS)


def q_import_new_rows(spark, sf_dir):
    existing, incoming = _events_split(spark, sf_dir)
    return dedup.import_plan(incoming, existing, dedup.LEDGER_KEY).select(*_IMPORT_COLS)


def q_import_dry_run(spark, sf_dir):
    existing, incoming = _events_split(spark, sf_dir)
    return dedup.import_plan(incoming, existing, dedup.LEDGER_KEY, dry_run=True).select(*_IMPORT_COLS)


def q_duplicates_report(spark, sf_dir):
    existing, incoming = _events_split(spark, sf_dir)
    return dedup.duplicate_rows(incoming, existing, dedup.LEDGER_KEY).select(*_IMPORT_COLS)


def _import_counts(spark, sf_dir):
    existing, incoming = _events_split(spark, sf_dir)
    inserted = dedup.import_plan(incoming, existing, dedup.LEDGER_KEY)
    return dedup.file_counts(incoming, inserted, ("user_id",)), existing


def q_import_counts(spark, sf_dir):
    counts, _ = _import_counts(spark, sf_dir)
    return counts.select("user_id", "parsed_entry_num", "new_entry_num")


def q_history_delta(spark, sf_dir):
    counts, existing = _import_counts(spark, sf_dir)
    history = (existing.groupBy("user_id", "name")
               .agg(F.max("event_id").alias("id"), F.count(F.lit(1)).alias("parsed_entry_num"))
               .select("id", F.col("user_id").alias("src_file"), "parsed_entry_num"))
    delta = dedup.ledger_history_delta(counts.withColumnRenamed("user_id", "src_file"), history)
    return delta.select(F.col("src_file").alias("user_id"), "parsed_entry_num", "new_entry_num", "last_parsed")


def q_assign_ids(spark, sf_dir):
    existing, incoming = _events_split(spark, sf_dir)
    new = dedup.import_plan(incoming, existing, dedup.LEDGER_KEY)
    base = existing.agg(F.max("event_id")).scalar()
    return dedup.assign_ids(new, base).select("event_id", "id")


def q_asset_new_dates(spark, sf_dir):
    o = _t(spark, sf_dir, "orders")
    d = F.to_date("o_orderdate")
    incoming = _files_ranked(o.filter(F.col("o_orderdate") >= F.lit("1997-01-01").cast("timestamp_ntz")).select(
        d.alias("date"), F.col("o_orderkey"), F.col("o_orderkey").alias("row_idx"),
        F.floor("o_totalprice").cast("long").alias("total_amount"),
        F.col("o_orderpriority").alias("src_file")), "src_file")
    existing = o.filter(F.col("o_orderdate") < F.lit("1998-01-01").cast("timestamp_ntz")).select(d.alias("date"))
    new = dedup.import_plan(incoming, existing, dedup.ASSET_KEY, reverse_rows=False)
    return new.select("date", "o_orderkey", "total_amount")


def q_rule_dictionary(spark, sf_dir):
    v = R.validate_rules(_derived_rules(spark, sf_dir))
    d = R.rule_dictionary(v)
    return d.withColumn("valid", F.col("field_name").isin(list(R.FIELDS)))


def q_classify(spark, sf_dir):
    rows = _part_rows(spark, sf_dir)
    c = R.classify(rows, _derived_rules(spark, sf_dir), row_id="id", on_invalid="skip")
    return c.select("id", "category_id", "matched_by")


def q_classify_join(spark, sf_dir):
    """Same as ``classify`` with the substring-join strategy forced (the
    strategy used for large rule sets)."""
    rows = _part_rows(spark, sf_dir)
    c = R.classify(rows, _derived_rules(spark, sf_dir), row_id="id", on_invalid="skip", strategy="join")
    return c.select("id", "category_id", "matched_by")


def q_transit_rows(spark, sf_dir):
    doc = _t(spark, sf_dir, "documents")
    fin = (F.when(F.col("source") == "src0", F.lit(P.TRANSIT_FIN_INS[0]))
           .when(F.col("source") == "src1", F.lit(P.TRANSIT_FIN_INS[1]))
           .when(F.col("source") == "src2", F.lit(P.TRANSIT_FIN_INS[2]))
           .otherwise(F.col("source")))
    name = F.translate(F.col("text"), "ae", P.TRANSIT_IN_MARK + P.TRANSIT_OUT_MARK)
    return doc.select("doc_id", fin.alias("fin_ins"), P.is_transit(name, fin).alias("is_transit"))


def q_outbox(spark, sf_dir):
    from .classify import outbox_records, outbox_json
    rows = _part_rows(spark, sf_dir)
    c = R.classify(rows, _derived_rules(spark, sf_dir), row_id="id", on_invalid="skip")
    return outbox_json(outbox_records(c, 1, "ledger-importer")).select(
        "detail_id", "seq", "category_id", "datetime", "price", "from", "type", "memo", "body")


def q_pending_rows(spark, sf_dir):
    detail = _orders_detail(spark, sf_dir).drop("maw_check_date", "maw_regist_date")
    return S.pending(detail, _orders_events(spark, sf_dir)).select("id", "date", "name", "price")


def q_apply_status(spark, sf_dir):
    ev = _t(spark, sf_dir, "events")
    op = (F.when(F.col("event_type").isin("view", "click"), F.lit("check"))
          .when(F.col("event_type").isin("purchase", "signup"), F.lit("forward"))
          .when(F.col("event_type") == "error", F.lit("reset")))
    events = ev.select(F.col("user_id").cast("long").alias("detail_id"), op.alias("op"),
                       F.to_date("ts").alias("at"), F.col("event_id").alias("seq"))
    st = S.current_status(events)
    return st.select("detail_id", "op", "maw_check_date", "maw_regist_date",
                     S.status_label().alias("status"))


def q_ledger_page(spark, sf_dir):
    """T1 + F9 + J6: page 3 of the stored rows, newest first, cut by id range
    before the status events of just those ids are read."""
    detail = _orders_detail(spark, sf_dir).drop("maw_check_date", "maw_regist_date")
    pg = views.detail_page(detail, _orders_events(spark, sf_dir), limit=views.DEFAULT_PAGE_SIZE,
                           offset=views.page_offset(3, views.DEFAULT_PAGE_SIZE))
    return views.detail_display(pg).select(
        "id", "useDate", "name", "price_text", "registDate", "importJudgeDate", "importDate", "status")


def q_ledger_count(spark, sf_dir):
    return views.row_count(_orders_detail(spark, sf_dir))


def q_page_count(spark, sf_dir):
    return views.page_count(_orders_detail(spark, sf_dir), views.DEFAULT_PAGE_SIZE)


def q_latest_run_by_job(spark, sf_dir):
    h = _history_from_events(_t(spark, sf_dir, "events"))
    # the table's stamps have no zone; the history's are instants
    return views.latest_run_by_job(h.withColumn("updated_at", F.timestamp_seconds(_epoch_ntz(F.col("updated_at")))))


def q_latest_run_by_file(spark, sf_dir):
    h = _history_from_events(_t(spark, sf_dir, "events"))
    return views.latest_run_by_file(h).select("src_file", "run_id", "job_label",
                                              "parsed_entry_num", "new_entry_num")


def q_runs_for_file(spark, sf_dir):
    h = _history_from_events(_t(spark, sf_dir, "events"))
    return views.runs_for_file(h, "u0007").select("id", "job_label", "parsed_entry_num", "new_entry_num")


def q_asset_latest_n(spark, sf_dir):
    return views.asset_latest(_assets(spark, sf_dir), 10).select("date", "total_amount", "points")


def q_asset_by_date(spark, sf_dir):
    return views.asset_by_date(_assets(spark, sf_dir), "1998-08-02").select("date", "total_amount", "points")


def q_rule_view(spark, sf_dir):
    return views.rule_view(_derived_rules(spark, sf_dir))


def q_rule_lookup(spark, sf_dir):
    return views.rule_lookup(_derived_rules(spark, sf_dir), 42)


def _region_requests(spark, sf_dir) -> DataFrame:
    """Rule requests as JSON text derived from ``region``: one per region,
    one without category and flag (zero values), and three per region that
    must be refused: malformed, text for a number, a number for text."""
    r = _t(spark, sf_dir, "region")
    good = F.format_string('{"fieldName":"name","value":"%s","categoryId":%d,"exactMatch":1}',
                           F.col("r_name"), F.col("r_regionkey") + 500)
    bodies = [good, F.format_string('{"fieldName":"name","value":"%s"', F.col("r_name")),
              F.format_string('{"fieldName":"name","value":"%s"}', F.lower("r_name")),
              F.format_string('{"fieldName":"name","value":"%s","categoryId":1,"exactMatch":"yes"}', F.col("r_name")),
              F.format_string('{"fieldName":"name","value":%d,"categoryId":1,"exactMatch":1}', F.col("r_regionkey"))]
    return r.select(F.col("r_regionkey").alias("req_order"), F.explode(F.array(*[
        F.struct(F.lit(k).alias("k"), b.alias("body")) for k, b in enumerate(bodies)])).alias("b")).select(
        (F.col("req_order") * 5 + F.col("b.k")).alias("req_order"), F.col("b.body").alias("body"))


def q_rule_add(spark, sf_dir):
    rules = _derived_rules(spark, sf_dir)
    req = _region_requests(spark, sf_dir).select("req_order", P.parse_rule_request("body").alias("r"))
    ok = req.filter(F.col("r").isNotNull()).select("req_order", "r.*")
    snapshot = S.add_rules(rules, ok, order_col="req_order")
    return (snapshot.join(rules.select("id"), "id", "left_anti")
            .select("id", "field_name", "value", "exact_match", "category_id"))


def q_rule_delete(spark, sf_dir):
    rules = _derived_rules(spark, sf_dir)
    doomed = _t(spark, sf_dir, "part").filter(F.col("p_brand") == "Brand#1").select(
        (F.col("p_partkey") + 1).alias("id"))
    return S.delete_rules(rules, doomed).select("id", "field_name", "value", "exact_match", "category_id")


def _page_keys(spark, sf_dir) -> DataFrame:
    pg = _t(spark, sf_dir, "pages")
    path = F.regexp_replace(F.regexp_replace(F.col("url"), r"[?#].*$", ""), r"^[a-z]+://", "")
    return pg.select(F.concat(F.lit("landing/"), path).alias("key"))


def q_flatten_by_basename(spark, sf_dir):
    from ..sources.manifest import flatten_by_basename
    return flatten_by_basename(_page_keys(spark, sf_dir), "landing").select("basename", "key", "n_keys")


def q_route_files(spark, sf_dir):
    from ..sources.manifest import route_kind
    o = _t(spark, sf_dir, "orders")
    name = (F.when(F.col("o_orderpriority") == "1-URGENT", F.lit("cf.csv"))
            .when(F.col("o_orderpriority") == "2-HIGH", F.lit("cf_lastmonth.csv"))
            .when(F.col("o_orderpriority") == "3-MEDIUM", F.lit("asset_history.csv"))
            .when(F.col("o_orderpriority") == "4-NOT SPECIFIED", F.lit("asset_history.CSV"))
            .otherwise(F.lit("dummy.csv")))
    fname = F.concat(F.col("o_orderstatus"), F.lit("_"), F.col("o_orderkey").cast("string"), F.lit("_"), name)
    o = o.select("o_orderkey", fname.alias("file_name"))
    is_csv = F.col("file_name").endswith(".csv")
    return o.select("o_orderkey", "file_name", is_csv.alias("listed"),
                    F.when(is_csv, route_kind(F.col("file_name"))).alias("kind"))


QUERIES = {
    "parse_ledger_date": q_parse_ledger_date,
    "parse_price": q_parse_price,
    "parse_amount": q_parse_amount,
    "parse_month_end": q_parse_month_end,
    "split_rejects": q_split_rejects,
    "reverse_position": q_reverse_position,
    "dedup_in_run": q_dedup_in_run,
    "import_new_rows": q_import_new_rows,
    "import_dry_run": q_import_dry_run,
    "duplicates_report": q_duplicates_report,
    "import_counts": q_import_counts,
    "history_delta": q_history_delta,
    "assign_ids": q_assign_ids,
    "asset_new_dates": q_asset_new_dates,
    "rule_dictionary": q_rule_dictionary,
    "classify": q_classify,
    "classify_join": q_classify_join,
    "transit_rows": q_transit_rows,
    "outbox": q_outbox,
    "pending_rows": q_pending_rows,
    "apply_status": q_apply_status,
    "ledger_page": q_ledger_page,
    "ledger_count": q_ledger_count,
    "page_count": q_page_count,
    "latest_run_by_job": q_latest_run_by_job,
    "latest_run_by_file": q_latest_run_by_file,
    "runs_for_file": q_runs_for_file,
    "asset_latest_n": q_asset_latest_n,
    "asset_by_date": q_asset_by_date,
    "rule_view": q_rule_view,
    "rule_lookup": q_rule_lookup,
    "rule_add": q_rule_add,
    "rule_delete": q_rule_delete,
    "flatten_by_basename": q_flatten_by_basename,
    "route_files": q_route_files,
}


# --------------------------------------------------------------------------
# CSV files and streams derived from the tables
# --------------------------------------------------------------------------

# The ledger export's header row, in column order.
LEDGER_HEADER = ["計算対象", "日付", "内容", "金額（円）", "保有金融機関", "大項目", "中項目", "メモ", "振替", "ID"]


def _write_ledger_csv(df: DataFrame, path: str, parts: list[str], encoding: str = "UTF-8") -> None:
    """Ledger CSV files (every field quoted, with the header row), one per
    value of ``parts`` and bucket ``b``, rows in ``row_key`` order."""
    parts = [*parts, "b"]
    (df.repartition(*parts).sortWithinPartitions(*parts, "row_key")
     .select(*parts, *[F.col(c).alias(h) for c, h in zip(
         ["calc", "raw_date", "name", "raw_price", "fin_ins", "l_cat", "m_cat", "memo", "transfer", "sid"],
         LEDGER_HEADER)])
     .write.option("header", "true").option("quoteAll", "true").option("escape", '"').option("encoding", encoding)
     .option("ignoreTrailingWhiteSpace", "false")
     .partitionBy(*parts).csv(path))


# Order keys for each bucket of the CSV files, so that files do not grow with
# the table. Rows with equal dedup keys share a bucket.
BUCKET_KEYS = 1_000_000


def _orders_ledger_text(o: DataFrame) -> DataFrame:
    price = F.floor(F.col("o_totalprice") / 1000) * 1000
    buckets = int(o.agg(F.max("o_orderkey")).first()[0]) // BUCKET_KEYS + 1
    bucket = (F.unix_date(F.to_date("o_orderdate")) * 31 + F.floor(F.col("o_totalprice") / 1000)) % buckets
    return o.select(
        F.format_string("%06d", bucket.cast("long")).alias("b"),
        F.col("o_orderpriority").alias("p"), F.date_format("o_orderdate", "yyyy").alias("yr"),
        F.col("o_orderkey").alias("row_key"), F.lit("1").alias("calc"),
        F.date_format("o_orderdate", "yyyy/MM/dd").alias("raw_date"),
        F.concat_ws(" ", "o_orderpriority", "o_orderstatus").alias("name"),
        F.concat(F.lit("-"), F.format_number(price, 0)).alias("raw_price"),
        F.lit("card").alias("fin_ins"), F.lit("l").alias("l_cat"), F.lit("m").alias("m_cat"),
        F.lit("").alias("memo"), F.lit("0").alias("transfer"),
        F.col("o_orderkey").cast("string").alias("sid"))


def q_import_files_e2e(spark, sf_dir):
    """S1, S3, F1-F3, C1, C2, W1, A6, J1, K5, U1, M11 over CSV files written
    from ``orders`` (one file per priority and year)."""
    from ..session import staging_path
    from ..sources.manifest import list_csv
    from ..sources.store import LedgerStore
    from .importer import import_ledger
    landing = staging_path(spark, "orders-csv")
    _write_ledger_csv(_orders_ledger_text(_t(spark, sf_dir, "orders")), landing, ["p", "yr"])
    paths = [r.path for r in list_csv(spark, landing, recursive=True).select("path").collect()]
    store = LedgerStore(spark, staging_path(spark, "store"))
    res = import_ledger(spark, store, paths, job_label="e2e", run_date="2024-01-01")
    return res.inserted.select("date", "name", "price", "yyyymm_id", F.col("source_id"))


def q_stream_import(spark, sf_dir):
    """ST1: events as ledger CSV files, one folder per day, imported by a
    file stream in several micro-batches into one store."""
    from ..session import staging_path
    from ..sources.store import LedgerStore
    from ..streaming.jobs import stream_import
    ev = _t(spark, sf_dir, "events")
    text = ev.select(
        F.date_format("ts", "yyyy-MM-dd").alias("day"), F.col("event_id").alias("row_key"),
        F.floor(F.col("event_id") / BUCKET_KEYS).alias("b"),
        F.lit("1").alias("calc"), F.date_format("ts", "yyyy/MM/dd").alias("raw_date"),
        F.col("event_type").alias("name"),
        F.concat(F.lit("-"), F.format_number(F.floor("value"), 0)).alias("raw_price"),
        F.lit("card").alias("fin_ins"), F.lit("l").alias("l_cat"), F.lit("m").alias("m_cat"),
        F.lit("").alias("memo"), F.lit("0").alias("transfer"), F.col("event_id").cast("string").alias("sid"))
    landing = staging_path(spark, "events-csv")
    _write_ledger_csv(text, landing, ["day"])
    store = LedgerStore(spark, staging_path(spark, "store"))
    q = stream_import(spark, store, landing, staging_path(spark, "stream-ckpt"), job_label="stream",
                      run_date="2024-02-01", max_files=12)
    q.awaitTermination()
    return store.read("detail").select("date", "name", "price")


def q_stream_latest(spark, sf_dir):
    """ST2: run history derived from events, landed as one parquet folder per
    day, reduced by a streaming max_by per job label."""
    from ..schemas import IMPORT_HISTORY
    from ..session import staging_path
    from ..streaming.jobs import read_latest_runs, stream_latest_runs
    h = _history_from_events(_t(spark, sf_dir, "events"))
    h = h.select(*[(F.col(f.name) if f.name in h.columns else F.lit(None)).cast(f.dataType).alias(f.name)
                   for f in IMPORT_HISTORY.fields], F.to_date("updated_at").alias("day"))
    h = h.withColumn("updated_at", _epoch_ntz(F.col("day").cast("timestamp_ntz")).cast("timestamp"))
    landing, out = staging_path(spark, "history"), staging_path(spark, "gauges")
    h.withColumn("updated_at", F.col("updated_at")).write.partitionBy("day").parquet(landing)
    q = stream_latest_runs(spark, landing, out, staging_path(spark, "gauge-ckpt"))
    q.awaitTermination()
    return read_latest_runs(spark, out).select("job_label", F.col("id").alias("run_id"),
                                               "parsed_entry_num", "new_entry_num")


QUERIES.update({
    "import_files_e2e": q_import_files_e2e,
    "stream_import": q_stream_import,
    "stream_latest": q_stream_latest,
})


def _events_detail(spark, sf_dir) -> DataFrame:
    """events -> stored ledger rows (dense ids event_id + 1)."""
    ev = _t(spark, sf_dir, "events")
    d = F.to_date("ts")
    return ev.select(
        (F.col("event_id") + 1).cast("long").alias("id"), F.lit(1).alias("yyyymm_id"), d.alias("date"),
        F.col("event_type").alias("name"), F.floor("value").cast("long").alias("price"),
        F.lit("card").alias("fin_ins"), F.lit("").alias("l_category"),
        F.format_string("seg%d", F.col("user_id") % 7).alias("m_category"),
        d.alias("regist_date"), F.date_format("ts", "yyyy/MM/dd").alias("raw_date"),
        F.floor("value").cast("string").alias("raw_price"), F.lit("events").alias("src_file"),
        F.lit(None).cast("timestamp").alias("created_at"), F.lit(None).cast("timestamp").alias("updated_at"))


def q_classify_pending_run(spark, sf_dir):
    """M10 over a store: rows of ``error`` events were judged by batch 1;
    the rest are pending and get classified by rules derived from the event
    types: a name substring rule for even ranks, an m_category exact rule
    (segment ``seg<rank>``) for odd ranks."""
    from ..session import staging_path
    from ..sources.store import LedgerStore
    from .classify import classify_pending
    store = LedgerStore(spark, staging_path(spark, "store"))
    detail = _events_detail(spark, sf_dir)
    store.append("detail", detail)
    store.append("detail_status", detail.filter(F.col("name") == "error").select(
        F.col("id").alias("detail_id"), F.lit("check").alias("op"), F.col("date").alias("at"),
        F.lit(1).cast("long").alias("seq")))
    types = small_ordinal(_t(spark, sf_dir, "events").select("event_type").distinct(),
                          [F.col("event_type")], "r", None)
    even = F.col("r") % 2 == 0
    rules = types.select(
        (F.col("r") + 1).cast("long").alias("id"),
        F.when(even, F.lit("name")).otherwise(F.lit("m_category")).alias("field_name"),
        F.when(even, F.substring("event_type", 2, 3))
        .otherwise(F.format_string("seg%d", F.col("r"))).alias("value"),
        F.when(even, F.lit(0)).otherwise(F.lit(1)).alias("exact_match"),
        (F.when(even, F.lit(100)).otherwise(F.lit(200)) + F.col("r")).cast("long").alias("category_id"))
    store.write_rules(rules.withColumn("created_at", F.current_timestamp())
                      .withColumn("updated_at", F.current_timestamp()))
    classify_pending(spark, store, run_date="2024-02-01")
    return store.read("outbox").select("detail_id", "seq", "category_id", "datetime", "price", "memo")


# The asset export's header row, in column order.
ASSET_HEADER = ["日付", "合計", "預金・現金・暗号資産", "株式(現物)", "投資信託", "ポイント", "詳細"]


def q_import_assets_e2e(spark, sf_dir):
    """M12 + C3-C5 + J2 + M6 over asset CSV files written from the daily
    order totals: one file per year, month ends in the month-end notation,
    amounts with separators; a second drop repeats the newest year."""
    from ..session import staging_path
    from ..sources.manifest import list_csv
    from ..sources.store import LedgerStore
    from .importer import import_assets
    landing = staging_path(spark, "assets-csv")
    _write_asset_csv(_assets(spark, sf_dir), landing)
    store = LedgerStore(spark, staging_path(spark, "store"))
    paths = [r.path for r in list_csv(spark, landing, recursive=True).select("path").collect()]
    import_assets(spark, store, paths, job_label="assets")
    newest = sorted(paths)[-1]
    import_assets(spark, store, [newest], job_label="assets")  # all dates known: no insert, no history
    hist = store.read("import_history").agg(F.count(F.lit(1))).scalar()
    return store.read("asset_history").select(
        "date", "total_amount", "cash_deposit_crypto", "stocks", "investment_trusts", "points",
        hist.alias("history_rows"))


def _write_asset_csv(a: DataFrame, landing: str) -> None:
    """Asset CSV files of daily totals, one per year."""
    month_end = F.last_day("date") == F.col("date")
    raw_date = F.when(month_end, F.concat(F.date_format("date", "yyyy-MM"), F.lit(P.MONTH_END_SUFFIX))) \
        .otherwise(F.date_format("date", "yyyy-MM-dd"))
    fmt = lambda c: F.format_number(c, 0)
    text = a.select(F.year("date").alias("yr"), F.col("date").alias("row_key"),
                    raw_date.alias(ASSET_HEADER[0]), fmt(F.col("total_amount")).alias(ASSET_HEADER[1]),
                    fmt(F.floor(F.col("total_amount") / 2)).alias(ASSET_HEADER[2]),
                    F.lit("0").alias(ASSET_HEADER[3]),
                    fmt(F.col("total_amount") - F.floor(F.col("total_amount") / 2)).alias(ASSET_HEADER[4]),
                    F.col("points").cast("string").alias(ASSET_HEADER[5]), F.lit("orders").alias(ASSET_HEADER[6]))
    (text.repartition("yr").sortWithinPartitions("yr", "row_key").drop("row_key")
     .write.option("header", "true").option("quoteAll", "true").partitionBy("yr").csv(landing))


QUERIES.update({
    "classify_pending_run": q_classify_pending_run,
    "import_assets_e2e": q_import_assets_e2e,
})


def _orders_status_events(spark, sf_dir, hwm: int) -> DataFrame:
    """Batch 1 judged every order up to ``hwm`` (forward when status F,
    check otherwise); batch 2 reset the urgent ones among them; batch 3
    judged the F orders just above the mark but died before writing it."""
    o = _t(spark, sf_dir, "orders")
    d = F.date_add(F.to_date("o_orderdate"), 1)
    first = o.filter(F.col("o_orderkey") <= hwm).select(
        F.col("o_orderkey").alias("detail_id"),
        F.when(F.col("o_orderstatus") == "F", F.lit("forward")).otherwise(F.lit("check")).alias("op"),
        d.alias("at"), F.lit(1).cast("long").alias("seq"))
    resets = o.filter((F.col("o_orderkey") <= hwm) & (F.col("o_orderpriority") == "1-URGENT")).select(
        F.col("o_orderkey").alias("detail_id"), F.lit("reset").alias("op"),
        F.date_add(d, 1).alias("at"), F.lit(2).cast("long").alias("seq"))
    late = o.filter((F.col("o_orderkey") > hwm) & (F.col("o_orderkey") <= hwm + 100)
                    & (F.col("o_orderstatus") == "F")).select(
        F.col("o_orderkey").alias("detail_id"), F.lit("check").alias("op"),
        F.date_add(d, 2).alias("at"), F.lit(3).cast("long").alias("seq"))
    return first.unionByName(resets).unionByName(late)


def _half_max_order(spark, sf_dir) -> int:
    return int(_t(spark, sf_dir, "orders").agg(F.max("o_orderkey")).first()[0]) // 2


def q_detail_status_view(spark, sf_dir):
    """J6 + F12: stored rows joined to their latest status event."""
    hwm = _half_max_order(spark, sf_dir)
    detail = _orders_detail(spark, sf_dir).drop("maw_check_date", "maw_regist_date")
    st = S.with_status(detail, _orders_status_events(spark, sf_dir, hwm))
    return st.select("id", "maw_check_date", "maw_regist_date", S.status_label().alias("status"))


def q_pending_incremental(spark, sf_dir):
    """S7 from the last high-water mark (ids above it, minus late-judged ones,
    plus reset rows): must equal the exact anti-join definition."""
    hwm = _half_max_order(spark, sf_dir)
    detail = _orders_detail(spark, sf_dir).drop("maw_check_date", "maw_regist_date")
    return (S.pending_since(detail, _orders_status_events(spark, sf_dir, hwm), hwm, mark_seq=1)
            .select("id", "date", "price"))


QUERIES.update({
    "detail_status_view": q_detail_status_view,
    "pending_incremental": q_pending_incremental,
})


def q_dedup_collated(spark, sf_dir):
    """A6 under a case- and trailing-blank-insensitive key: whole rows, with
    the name as the chosen row spells it."""
    rows = _events_as_ledger(_t(spark, sf_dir, "events"))
    name = (F.when(F.col("event_id") % 3 == 0, F.concat(F.upper("name"), F.lit(" ")))
            .when(F.col("event_id") % 3 == 1, F.initcap("name")).otherwise(F.col("name")))
    keyed = dedup.keyed(rows.withColumn("name", name), dedup.LEDGER_KEY, "UNICODE_CI_AI_RTRIM")
    out = dedup.first_processed(keyed, dedup.LEDGER_KEY, reverse_rows=True)
    return out.select("date", F.col("name").cast("string").alias("name"), "price", "event_id", "user_id")


def _rename_files(spark, landing: str, name: str) -> None:
    """The one CSV file of each partition folder below ``landing`` becomes
    ``name``, with the folder's partition values for ``{}``."""
    from ..sources.store import _fs, list_dirs
    fs, _ = _fs(spark, landing)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path

    def visit(folder: str, values: list[str]) -> None:
        for d in list_dirs(spark, folder):
            if "=" in d:
                visit(f"{folder}/{d}", [*values, d.split("=")[-1]])
        for st in fs.listStatus(path(folder)):
            if st.getPath().getName().endswith(".csv"):
                fs.rename(st.getPath(), path(f"{folder}/{name.format('-'.join(values))}"))

    visit(landing, [])


def _write_bytes(spark, path: str, text: str) -> None:
    from ..sources.store import _fs
    fs, p = _fs(spark, path)
    out = fs.create(p)
    out.write(bytearray(text.encode()))
    out.close()


def q_import_history_e2e(spark, sf_dir):
    """Run folders ``yr=<year>/b=<bucket>`` that all hold
    ``cf 1+2.csv`` (one from orders each, one with a header only, one empty),
    imported twice. History rows follow the files in order."""
    from ..session import staging_path
    from ..sources.store import LedgerStore
    from .importer import import_ledger
    landing = staging_path(spark, "history-csv")
    text = _orders_ledger_text(_t(spark, sf_dir, "orders"))
    # sort key order inside a file does not matter for counts; years are the files
    _write_ledger_csv(text, landing, ["yr"])
    _rename_files(spark, landing, "cf 1+2.csv")
    _write_bytes(spark, f"{landing}/yr=1990/b=000000/cf 1+2.csv", ",".join(LEDGER_HEADER) + "\n")
    _write_bytes(spark, f"{landing}/yr=1991/b=000000/cf 1+2.csv", "")
    store = LedgerStore(spark, staging_path(spark, "store"))
    for label in ("first", "second"):
        import_ledger(spark, store, [f"{landing}/yr=*/b=*/*.csv"], job_label=label, run_date="2024-01-01")
    return store.read("import_history").select("id", "job_label", "parsed_entry_num", "new_entry_num", "src_file")


def q_import_duplicates_e2e(spark, sf_dir):
    """The duplicates frame of a second import that overlaps the
    first: orders before 1996 are stored, then all are imported."""
    from ..session import staging_path
    from ..sources.store import LedgerStore
    from .importer import import_ledger
    landing = staging_path(spark, "overlap-csv")
    _write_ledger_csv(_orders_ledger_text(_t(spark, sf_dir, "orders")), landing, ["yr"])
    store = LedgerStore(spark, staging_path(spark, "store"))
    import_ledger(spark, store, [f"{landing}/yr=199[0-5]/*/*.csv"], run_date="2024-01-01")
    res = import_ledger(spark, store, [f"{landing}/*/*/*.csv"], run_date="2024-01-01")
    return res.duplicates.select("date", "name", "price", "source_id")


def q_import_rejects_e2e(spark, sf_dir):
    """S3, F2, M9: one ledger file per order priority and bucket, written as lines: 1 has
    its header in the middle, 2 a quote inside a bare field, 3 a record with a
    column too many, 4 nothing wrong, 5 a line of blanks. Bad files are held
    back whole."""
    from ..session import staging_path
    from ..sources.store import LedgerStore
    from .importer import import_ledger
    o = _t(spark, sf_dir, "orders")
    t = _orders_ledger_text(o).withColumn("p", F.substring("p", 1, 1))
    cols = ["calc", "raw_date", "name", "raw_price", "fin_ins", "l_cat", "m_cat", "memo", "transfer", "sid"]
    quoted = [F.concat(F.lit('"'), F.col(c), F.lit('"')) for c in cols]
    line = F.concat_ws(",", *quoted)
    odd = F.col("row_key") % 500 == 0
    broken = F.concat_ws(",", *quoted[:2], F.lit('a"b'), *quoted[3:])
    text = t.select("p", "b", "row_key", F.when(odd & (F.col("p") == "2"), broken)
                    .when(odd & (F.col("p") == "3"), F.concat(line, F.lit(",x")))
                    .when(odd & (F.col("p") == "5"), F.lit("   ")).otherwise(line).alias("value"))
    header = t.filter(F.col("p") == "1").groupBy("p", "b").agg(F.max("row_key").alias("row_key")).select(
        "p", "b", (F.col("row_key") / 2).cast("long").alias("row_key"), F.lit(",".join(LEDGER_HEADER)).alias("value"))
    landing = staging_path(spark, "rejects-csv")
    (text.unionByName(header).repartition("p", "b").sortWithinPartitions("p", "b", "row_key").select("p", "b", "value")
     .write.partitionBy("p", "b").text(landing))
    store = LedgerStore(spark, staging_path(spark, "store"))
    res = import_ledger(spark, store, [f"{landing}/*/*/*.txt"], run_date="2024-01-01", policy="quarantine")
    return res.inserted.select("date", "name", "price", "source_id")


QUERIES.update({
    "dedup_collated": q_dedup_collated,
    "import_history_e2e": q_import_history_e2e,
    "import_duplicates_e2e": q_import_duplicates_e2e,
    "import_rejects_e2e": q_import_rejects_e2e,
})


def q_import_sjis_e2e(spark, sf_dir):
    """Shift_JIS ledger files, one per year, with Japanese names."""
    from ..session import staging_path
    from ..sources.store import LedgerStore
    from .importer import import_ledger
    o = _t(spark, sf_dir, "orders")
    text = _orders_ledger_text(o).withColumn("name", F.concat(
        F.lit("表示　ソ能 "), F.translate(F.element_at(F.split("name", " "), -1), "FOP", "済未待")))
    landing = staging_path(spark, "sjis-csv")
    _write_ledger_csv(text, landing, ["yr"], "Shift_JIS")
    store = LedgerStore(spark, staging_path(spark, "store"))
    res = import_ledger(spark, store, [f"{landing}/*/*/*.csv"], run_date="2024-01-01", encoding="sjis")
    return res.inserted.select("date", "name", "price", "source_id")


def _mixed_drop(spark, sf_dir, landing: str) -> None:
    """Ledger and asset files of the orders by year, in one folder per kind and year."""
    _write_ledger_csv(_orders_ledger_text(_t(spark, sf_dir, "orders")), f"{landing}/ledger", ["yr"])
    _rename_files(spark, f"{landing}/ledger", "{}_cf.csv")
    _write_asset_csv(_assets(spark, sf_dir), f"{landing}/asset")
    _rename_files(spark, f"{landing}/asset", "{}_asset_history.csv")


def _stored(store) -> DataFrame:
    return (store.read("detail").select(F.lit("ledger").alias("kind"), "date", "name", F.col("price").alias("amount"))
            .unionByName(store.read("asset_history").select(F.lit("asset").alias("kind"), "date", F.lit("").alias("name"),
                                                            F.col("total_amount").alias("amount"))))


def q_stream_drops_e2e(spark, sf_dir):
    """ST1 over a mixed landing folder: routed by name in micro-batches of
    five files."""
    from ..session import staging_path
    from ..sources.store import LedgerStore
    from ..streaming.jobs import stream_drops
    landing = staging_path(spark, "mixed-csv")
    _mixed_drop(spark, sf_dir, landing)
    store = LedgerStore(spark, staging_path(spark, "store"))
    stream_drops(spark, store, landing, staging_path(spark, "stream-ckpt"), max_files=5, run_date="2024-01-01").awaitTermination()
    return _stored(store)


def q_import_prefix_e2e(spark, sf_dir):
    """The same files below a prefix, and an archive folder with
    equal basenames, which the later keys replace."""
    from ..session import staging_path
    from ..sources.store import LedgerStore
    from .importer import import_prefix
    prefix = staging_path(spark, "prefix-csv")
    _mixed_drop(spark, sf_dir, prefix)
    old = _orders_ledger_text(_t(spark, sf_dir, "orders")).withColumn("name", F.concat(F.lit("old "), F.col("name")))
    _write_ledger_csv(old, f"{prefix}/archive", ["yr"])
    _rename_files(spark, f"{prefix}/archive", "{}_cf.csv")
    store = LedgerStore(spark, staging_path(spark, "store"))
    import_prefix(spark, store, prefix, run_date="2024-01-01")
    return _stored(store)


QUERIES.update({
    "import_sjis_e2e": q_import_sjis_e2e,
    "stream_drops_e2e": q_stream_drops_e2e,
    "import_prefix_e2e": q_import_prefix_e2e,
})


def q_import_split_e2e(spark, sf_dir):
    """Ledger files (one per bucket) with quoted newlines, quotes
    and commas in every record, read in splits of 64 KB."""
    from ..session import staging_path
    from ..sources.store import LedgerStore
    from .importer import import_ledger
    text = _orders_ledger_text(_t(spark, sf_dir, "orders"))
    text = text.withColumn("name", F.concat(F.lit('say "'), F.col("name"), F.lit('",\n\n"twice"'))) \
        .withColumn("memo", F.when(F.col("row_key") % 3 == 0, F.lit("a\n\n,b\n")).otherwise(F.lit('"')))
    landing = staging_path(spark, "split-csv")
    _write_ledger_csv(text, landing, [])
    store = LedgerStore(spark, staging_path(spark, "store"))
    res = import_ledger(spark, store, [f"{landing}/*/*.csv"], run_date="2024-01-01", split_bytes=64 << 10)
    return res.inserted.select("date", "name", "price", "yyyymm_id", "source_id")


def q_import_retry_e2e(spark, sf_dir):
    """A run died after its detail rows (twice as many as
    there are files for) and before its history; its retry, and one more under
    the same id, leave what one clean run leaves."""
    from ..session import staging_path
    from ..sources.store import LedgerStore
    from .importer import import_ledger
    landing = staging_path(spark, "retry-csv")
    _write_ledger_csv(_orders_ledger_text(_t(spark, sf_dir, "orders")), landing, ["yr"])
    _rename_files(spark, landing, "{}_cf.csv")
    store = LedgerStore(spark, staging_path(spark, "store"))
    events = _events_detail(spark, sf_dir)
    dead = store.begin("drop-7").under("ledger")
    dead.append("detail", events.unionByName(events))  # never committed
    for _ in range(2):
        import_ledger(spark, store, [f"{landing}/*/*/*.csv"], run_id="drop-7", job_label="retry", run_date="2024-01-01")
    facts = store.read("detail").agg(F.count(F.lit(1)).alias("stored_rows"), F.max("id").alias("max_id"))
    return store.read("import_history").select("id", "job_label", "src_file", "parsed_entry_num", "new_entry_num") \
        .crossJoin(F.broadcast(facts))  # one row


def _forget_last_epoch(spark, checkpoint: str) -> None:
    """Leave a stream's checkpoint as if it had died before its last epoch's
    commit: the epoch is run again."""
    from ..sources.store import _fs
    fs, p = _fs(spark, f"{checkpoint}/commits")
    epochs = [st.getPath().getName() for st in fs.listStatus(p)]
    last = max(int(e) for e in epochs if e.isdigit())
    fs.delete(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{checkpoint}/commits/{last}"), False)


def q_stream_replay_e2e(spark, sf_dir):
    """ST1: ledger files by year, and one without a byte, in one micro-batch
    that Spark runs a second time. Rows and history are those of one run."""
    from ..session import staging_path
    from ..sources.store import LedgerStore
    from ..streaming.jobs import stream_import
    landing, checkpoint = staging_path(spark, "replay-csv"), staging_path(spark, "stream-ckpt")
    _write_ledger_csv(_orders_ledger_text(_t(spark, sf_dir, "orders")), landing, ["yr"])
    _rename_files(spark, landing, "{}_cf.csv")
    _write_bytes(spark, f"{landing}/yr=1991/b=000000/1991-000000_cf.csv", "")
    store = LedgerStore(spark, staging_path(spark, "store"))
    for turn in range(2):
        if turn:
            _forget_last_epoch(spark, checkpoint)
        stream_import(spark, store, landing, checkpoint, job_label="stream", run_date="2024-01-01").awaitTermination()
    facts = store.read("detail").agg(F.count(F.lit(1)).alias("stored_rows"), F.max("id").alias("max_id"))
    return store.read("import_history").select("id", "job_label", "src_file", "parsed_entry_num", "new_entry_num") \
        .crossJoin(F.broadcast(facts))  # one row


def q_import_stamps_e2e(spark, sf_dir):
    """K6: audit stamps of two imports: each appended row has both, equal to
    each other, and the rows of one run share them."""
    from ..session import staging_path
    from ..sources.store import LedgerStore
    from .importer import import_ledger
    landing = staging_path(spark, "stamps-csv")
    _write_ledger_csv(_orders_ledger_text(_t(spark, sf_dir, "orders")), landing, ["yr"])
    store = LedgerStore(spark, staging_path(spark, "store"))
    import_ledger(spark, store, [f"{landing}/yr=199[0-5]/*/*.csv"], run_date="2024-01-01")
    import_ledger(spark, store, [f"{landing}/*/*/*.csv"], run_date="2024-01-01")
    own = store.read("detail")
    return own.agg(F.count(F.lit(1)).alias("stored_rows"), F.count("created_at").alias("created_rows"),
                   F.count("updated_at").alias("updated_rows"),
                   F.count(F.when(F.col("created_at") == F.col("updated_at"), 1)).alias("equal_rows"),
                   F.count_distinct("created_at").alias("run_stamps"),
                   F.count_distinct(F.when(F.year("date") < 1996, F.col("created_at"))).alias("first_stamps"))


def q_import_collated_e2e(spark, sf_dir):
    """J1, J3 under a collation: orders before 1996 are stored, then all are
    imported with names in small letters and a blank behind; rows whose key
    differs only so are duplicates."""
    from ..session import staging_path
    from ..sources.store import LedgerStore
    from .importer import import_ledger
    text = _orders_ledger_text(_t(spark, sf_dir, "orders"))
    stored, again = staging_path(spark, "collated-csv"), staging_path(spark, "collated-csv")
    _write_ledger_csv(text.filter(F.col("yr") < "1996"), stored, ["yr"])
    _write_ledger_csv(text.withColumn("name", F.concat(F.lower("name"), F.lit(" "))), again, ["yr"])
    store = LedgerStore(spark, staging_path(spark, "store"))
    import_ledger(spark, store, [f"{stored}/*/*/*.csv"], run_date="2024-01-01")
    res = import_ledger(spark, store, [f"{again}/*/*/*.csv"], run_date="2024-01-01", collation="UNICODE_CI_AI_RTRIM")
    both = res.duplicates.select(F.lit("duplicate").alias("kind"), "date", F.col("name").cast("string").alias("name"),
                                 "price", "source_id")
    return both.unionByName(res.inserted.select(F.lit("inserted").alias("kind"), "date",
                                                F.col("name").cast("string").alias("name"), "price", "source_id"))


def q_import_index_e2e(spark, sf_dir):
    """J1-J3, F5 through the key index: orders before 1996, and before 1997,
    are stored, then all are imported; keys beyond a thousand go by the index."""
    from ..session import staging_path
    from ..sources.store import LedgerStore
    from .importer import import_ledger
    landing = staging_path(spark, "index-csv")
    _write_ledger_csv(_orders_ledger_text(_t(spark, sf_dir, "orders")), landing, ["yr"])
    store = LedgerStore(spark, staging_path(spark, "store"))
    for years in ("199[0-5]", "199[0-6]", "*"):
        res = import_ledger(spark, store, [f"{landing}/yr={years}/*/*.csv"], run_date="2024-01-01", index_above=1000)
    return res.duplicates.select(F.lit("duplicate").alias("kind"), "date", "name", "price", "source_id").unionByName(
        res.inserted.select(F.lit("inserted").alias("kind"), "date", "name", "price", "source_id"))


QUERIES.update({
    "import_index_e2e": q_import_index_e2e,
    "import_split_e2e": q_import_split_e2e,
    "import_retry_e2e": q_import_retry_e2e,
    "stream_replay_e2e": q_stream_replay_e2e,
    "import_stamps_e2e": q_import_stamps_e2e,
    "import_collated_e2e": q_import_collated_e2e,
})


def q_status_base_view(spark, sf_dir):
    """J6, F12, M1, M2 from a status base and the events after it: batch 1 is
    compacted, batch 2 (resets) is merged into the next base, batch 3 is the
    tail. Orders are stored once, their status read with them."""
    from ..session import staging_path
    from ..sources.store import LedgerStore
    store, events = LedgerStore(spark, staging_path(spark, "store")), _orders_status_events(spark, sf_dir, _half_max_order(spark, sf_dir))
    for seq in (1, 2, 3):
        store.append("detail_status", events.filter(F.col("seq") == seq))
        if seq < 3:
            store.compact_status()
    detail = _orders_detail(spark, sf_dir).drop("maw_check_date", "maw_regist_date")
    return S.with_state(detail, store.status()).select("id", "maw_check_date", "maw_regist_date", S.status_label().alias("status"))


def q_ledger_page_deep(spark, sf_dir):
    """T1, A1, A7 over a store whose ids have holes (every seventh order is
    missing): a page of 50 rows three quarters down, by the page marks, and
    the row count of the newest commit."""
    from ..session import staging_path
    from ..sources.store import LedgerStore
    store, half = LedgerStore(spark, staging_path(spark, "store")), _half_max_order(spark, sf_dir)
    rows = _orders_ledger_rows(spark, sf_dir).filter(F.col("id") % 7 != 3)
    store.append("detail", rows.filter(F.col("id") <= half))
    store.append("detail", rows.filter(F.col("id") > half))
    events = _orders_status_events(spark, sf_dir, half)
    store.append("detail_status", events.filter(F.col("seq") == 1))
    store.compact_status()
    store.append("detail_status", events.filter(F.col("seq") > 1))
    n = store.rows("detail")
    return views.stored_page(store, 50, n * 3 // 4).withColumn("stored_rows", F.lit(n).cast("long"))


def _orders_ledger_rows(spark, sf_dir) -> DataFrame:
    """orders -> rows of the stored ledger, ids = order keys."""
    d = F.to_date("o_orderdate")
    return _t(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), F.lit(1).alias("yyyymm_id"), d.alias("date"), F.col("o_orderpriority").alias("name"),
        F.floor("o_totalprice").cast("long").alias("price"), F.lit("card").alias("fin_ins"), F.lit("").alias("l_category"),
        F.lit("").alias("m_category"), d.alias("regist_date"), F.lit("").alias("raw_date"), F.lit("").alias("raw_price"),
        F.lit("orders").alias("src_file"), F.lit(None).cast("timestamp").alias("created_at"),
        F.lit(None).cast("timestamp").alias("updated_at"))


def q_stream_latest_update(spark, sf_dir):
    """ST2: the run history of ``stream_latest`` in two parts, the later runs
    landing first: the lower ids that come late change no gauge. ``changes``
    counts the rows published in all, one for each changed label."""
    from ..schemas import IMPORT_HISTORY
    from ..session import staging_path
    from ..streaming.jobs import read_latest_runs, stream_latest_runs
    h = _history_from_events(_t(spark, sf_dir, "events"))
    h = h.select(*[(F.col(f.name) if f.name in h.columns else F.lit(None)).cast(f.dataType).alias(f.name)
                   for f in IMPORT_HISTORY.fields if f.name != "updated_at"], F.lit(None).cast("timestamp").alias("updated_at"))
    landing, out, ckpt = (staging_path(spark, n) for n in ("history", "gauges", "gauge-ckpt"))
    top = h.agg(F.max("id")).first()[0]
    for part in (F.col("id") > top // 2, F.col("id") <= top // 2):
        h.filter(part).write.mode("append").parquet(landing)
        stream_latest_runs(spark, landing, out, ckpt).awaitTermination()
    changes = spark.read.option("basePath", out).parquet(f"{out}/v=*").agg(F.count("id").alias("changes"))
    return read_latest_runs(spark, out).select("job_label", F.col("id").alias("run_id"), "parsed_entry_num",
                                               "new_entry_num").crossJoin(F.broadcast(changes))  # one row


def q_import_manifest_e2e(spark, sf_dir):
    """Ledger and asset files below a prefix in runs of four files.
    The first four files were imported as the drop's first run before the call
    that imports the whole drop, which goes on behind it."""
    from ..session import staging_path
    from ..sources.store import LedgerStore
    from ..sources.manifest import list_csv
    from .importer import _import_kinds, import_prefix
    prefix = staging_path(spark, "manifest-csv")
    _mixed_drop(spark, sf_dir, prefix)
    store = LedgerStore(spark, staging_path(spark, "store"))
    first = sorted((r.file_name, r.path) for r in list_csv(spark, prefix, recursive=True).collect())[:4]
    by_kind = {kind: [p for n, p in first if ("asset" in n) == (kind == "asset")] for kind in ("ledger", "asset")}
    _import_kinds(spark, store, by_kind, run_date="2024-01-01", run_id="drop.0")
    import_prefix(spark, store, prefix, run_date="2024-01-01", run_id="drop", max_files=4)
    return _stored(store).withColumn("runs", F.lit(len(store._markers())).cast("long"))


QUERIES.update({
    "status_base_view": q_status_base_view,
    "ledger_page_deep": q_ledger_page_deep,
    "stream_latest_update": q_stream_latest_update,
    "import_manifest_e2e": q_import_manifest_e2e,
})
