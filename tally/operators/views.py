"""Read-side views."""

from __future__ import annotations

import bisect

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.parse import display_stamp, epoch_seconds, thousands
from .dedup import latest_by
from .status import status_label

DEFAULT_PAGE_SIZE = 20  # fixed value: API default limit


def detail_view(detail_with_status: DataFrame) -> DataFrame:
    """id, useDate, name, price, registDate, importJudgeDate, importDate."""
    d = detail_with_status
    return d.select(
        F.col("id"), F.col("date").alias("useDate"), F.col("name"), F.col("price"),
        F.col("regist_date").alias("registDate"),
        F.col("maw_check_date").alias("importJudgeDate"),
        F.col("maw_regist_date").alias("importDate"))


def detail_display(view: DataFrame) -> DataFrame:
    """UI form of F9: C13 stamps, C14 thousands, F12 status."""
    return view.select(
        "id", "useDate", "name",
        thousands(F.col("price")).alias("price_text"),
        display_stamp(F.col("registDate")).alias("registDate"),
        display_stamp(F.col("importJudgeDate")).alias("importJudgeDate"),
        display_stamp(F.col("importDate")).alias("importDate"),
        status_label("importJudgeDate", "importDate").alias("status"))


def page(df: DataFrame, limit: int = DEFAULT_PAGE_SIZE, offset: int = 0,
         order_col: str = "id") -> DataFrame:
    """``order_col`` DESC, then OFFSET/LIMIT. Planned as a per-task
    top-(offset+limit) and one merge (TakeOrderedAndProject), never a full
    sort."""
    if limit < 0 or offset < 0:
        raise ValueError("limit and offset must be >= 0")
    ordered = df.orderBy(F.col(order_col).desc())
    return ordered.offset(offset).limit(limit) if offset else ordered.limit(limit)


def detail_page(detail: DataFrame, events: DataFrame, limit: int = DEFAULT_PAGE_SIZE,
                offset: int = 0) -> DataFrame:
    """T1 + F9 over the stored tables: the page is cut from ``detail`` first
    (per-task top-k), then only the status events of those ids are read.
    The page ids are at most offset+limit rows, so they are broadcast."""
    from .status import current_status
    rows = page(_newest(detail, limit + offset), limit, offset)
    ids = F.broadcast(rows.select(F.col("id").alias("detail_id")))
    st = current_status(events.join(ids, "detail_id", "left_semi"))
    joined = rows.join(F.broadcast(st.drop("op", "written_at")), rows["id"] == st["detail_id"], "left").drop("detail_id")
    return detail_view(joined).orderBy(F.col("id").desc())


def _newest(detail: DataFrame, need: int) -> DataFrame:
    """Ids are dense and ascend with insertion, so the newest ``need`` rows
    sit in the id range (max - need, max]. Reading that range lets the
    filter reach the parquet row-group statistics instead of scanning the
    table; when the range holds fewer rows (gaps), the whole table is used."""
    if need <= 0:
        return detail
    top = detail.agg(F.max("id")).first()[0]  # a scan of the id column alone
    if top is None:
        return detail
    cand = detail.filter(F.col("id") > F.lit(top - need))
    return cand if cand.count() >= need else detail


def mark_range(marks: list, limit: int, offset: int) -> tuple[int, int, int] | None:
    """(id above which, id up to which, rows to skip) of a page of the newest
    rows, from marks [id, rows up to it]. Between two marks without holes the
    ids follow from arithmetic; otherwise the range goes from mark to mark.
    None if the page is empty."""
    total = marks[-1][1] if marks else 0
    last, first = total - offset, max(total - offset - limit, 0)  # ranks from below: first < rank <= last
    if last <= 0 or limit <= 0:
        return None

    def around(rank: int) -> tuple[list, list]:
        i = bisect.bisect_left(marks, rank, key=lambda m: m[1])
        return marks[i - 1] if i else [None, 0], marks[i]

    below, above = around(last)
    dense = below[0] is not None and above[0] - below[0] == above[1] - below[1]
    upto, skip = (above[0] - (above[1] - last), 0) if dense else (above[0], above[1] - last)
    if first == 0:
        return (marks[0][0] - marks[0][1], upto, skip) if marks[0][1] == 0 else (-(1 << 62), upto, skip)
    below, above = around(first)
    dense = below[0] is not None and above[0] - below[0] == above[1] - below[1]
    if dense or above[1] == first:
        return above[0] - (above[1] - first), upto, skip
    return below[0] if below[0] is not None else -(1 << 62), upto, skip


def stored_page(store, limit: int = DEFAULT_PAGE_SIZE, offset: int = 0) -> DataFrame:
    """T1 + F9 over a store: a page at any depth reads one id range of
    ``detail``, and of the status base, found from the marks in the newest
    commit; nothing is counted and no maximum is looked up. With no marks (ids
    that do not ascend from run to run) it is ``detail_page``."""
    from .status import with_state
    if limit < 0 or offset < 0:
        raise ValueError("limit and offset must be >= 0")
    marks, detail = store.marks("detail"), store.read("detail")
    if marks is None:
        return detail_page(detail, store.status(), limit, offset)
    found = mark_range(marks, limit, offset)
    if found is None:
        return detail_view(with_state(detail.limit(0), store.status().limit(0)))
    above, upto, skip = found
    rows = page(detail.filter((F.col("id") > above) & (F.col("id") <= upto)), limit, skip)
    state = store.status().filter((F.col("detail_id") > above) & (F.col("detail_id") <= upto))
    return detail_view(with_state(F.broadcast(rows), state)).orderBy(F.col("id").desc())


def page_offset(page_no: int, per_page: int, total_pages: int | None = None) -> int:
    """Page p (1-based, clamped to [1, total_pages]) -> offset (p-1)*per_page."""
    if total_pages is not None:
        page_no = min(page_no, max(total_pages, 1))
    return (max(page_no, 1) - 1) * per_page


def row_count(df: DataFrame) -> DataFrame:
    """A1: one row {count}."""
    return df.agg(F.count(F.lit(1)).alias("count"))


def page_count(df: DataFrame, per_page: int) -> DataFrame:
    """ceil(count / per_page), at least 1."""
    return df.agg(F.count(F.lit(1)).alias("count")).select(
        "count", F.greatest(F.ceil(F.col("count") / F.lit(per_page)), F.lit(1)).cast("long").alias("pages"))


def rule_view(rules: DataFrame) -> DataFrame:
    """id, fieldName, value, categoryId, exactMatch."""
    return rules.select(
        F.col("id"), F.col("field_name").alias("fieldName"), F.col("value"),
        F.col("category_id").alias("categoryId"),
        F.coalesce(F.col("exact_match"), F.lit(0)).cast("int").alias("exactMatch"))


def rule_lookup(rules: DataFrame, rule_id: int) -> DataFrame:
    """the rule with this id (empty = missing)."""
    return rule_view(rules.filter(F.col("id") == F.lit(rule_id)))


def asset_by_date(assets: DataFrame, date) -> DataFrame:
    """F7."""
    return assets.filter(F.col("date") == F.lit(date).cast("date"))


def asset_latest(assets: DataFrame, n: int) -> DataFrame:
    """Newest ``n`` snapshots by date."""
    return assets.orderBy(F.col("date").desc()).limit(n)


def runs_for_file(history: DataFrame, src_file: str) -> DataFrame:
    """F8."""
    return history.filter(F.col("src_file") == F.lit(src_file))


def latest_run_by_job(history: DataFrame) -> DataFrame:
    """A5: per job label the parsed / new counts and epoch of the last run."""
    last = latest_by(history, ["job_label"], "id", ["id", "parsed_entry_num", "new_entry_num", "updated_at"])
    return last.select("job_label", F.col("id").alias("run_id"), "parsed_entry_num", "new_entry_num",
                       epoch_seconds(F.col("updated_at")).alias("updated_at_epoch"))


def latest_run_by_file(history: DataFrame) -> DataFrame:
    """F8 + W3: last run per src_file."""
    last = latest_by(history, ["src_file"], "id", ["id", "job_label", "parsed_entry_num", "new_entry_num"])
    return last.withColumnRenamed("id", "run_id")
