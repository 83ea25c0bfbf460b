"""Pending rows -> classification -> outbox -> status events.

Order of writes makes a retry exactly-once at table level: the outbox is
written first, then the status events, then the batch's high-water mark. A
run that died between the writes is finished by the next one: outbox records
without a status event get theirs first (``finish_open_batch``), so the rows
are no longer pending. Without its mark the next run falls back to the
previous mark, which only widens the scan.

Pending rows come from the last high-water mark (``status.pending_since``):
ids above it, plus rows whose latest event is a reset. One writer at a time
is assumed (imports and classifications do not overlap).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.parse import compact_date, to_json_record
from ..operators import rules as R
from ..operators import status as S
from ..session import lap, stage
from ..sources.store import LedgerStore

# Fixed value: the outbound record's origin tag (configurable).
DEFAULT_SOURCE_TAG = "ledger-importer"


@dataclass
class ClassifyResult:
    classified: DataFrame   # every pending row with category_id (NULL = not selected)
    outbox: DataFrame       # records written (or, dry run, that would be)
    events: DataFrame       # status events written
    seq: int


# Status events after the base that make a classification write the next base.
COMPACT_EVENTS = 1_000_000


def next_batch(store: LedgerStore) -> int:
    """Next batch number: above every status event and every recorded
    classification batch (a batch that judged nothing writes no event but
    still records its mark), and above the outbox, so that no reset can take
    the number of a batch that died after sending."""
    return max(store.top(t) for t in ("detail_status", "classify_run", "outbox")) + 1


def finish_open_batch(store: LedgerStore, run_date=None) -> None:
    """A batch that died after writing its outbox left records without a
    status event. They were sent: their forward events are written now, under
    the batch's own number, so that each is one judgement. Such records are
    newer than the last recorded batch; older outbox files are not read."""
    if not store.exists("outbox"):
        return
    last = store.top("classify_run")
    if store.top("outbox") <= last:
        return
    sent = store.read("outbox").filter(F.col("seq") > F.lit(last)).select("detail_id", "seq")
    known = store.read("detail_status").filter(F.col("seq") > F.lit(last)).filter(F.col("op") == S.FORWARD)
    open_ = stage(sent.join(known, ["detail_id", "seq"], "left_anti"), "open-batch")
    if not open_.isEmpty():
        at = run_date if run_date is not None else F.current_date()
        store.append("detail_status", open_.select("detail_id", F.lit(S.FORWARD).alias("op"),
                                                   F.lit(at).cast("date").alias("at"), "seq"))


def outbox_records(classified: DataFrame, seq, source_tag: str = DEFAULT_SOURCE_TAG) -> DataFrame:
    """K4: outbound record per selected row; ``type`` is never set (an empty
    string, as the record's zero value) and the memo carries the ledger name."""
    return classified.filter(F.col("category_id").isNotNull()).select(
        F.col("id").alias("detail_id"),
        F.lit(seq).cast("long").alias("seq"),
        F.col("category_id").cast("long").alias("category_id"),
        compact_date(F.col("date")).alias("datetime"),
        F.col("price").cast("long").alias("price"),
        F.lit(source_tag).alias("from"),
        F.lit("").alias("type"),
        F.col("name").alias("memo"))


def outbox_json(outbox: DataFrame) -> DataFrame:
    """Adds the JSON body of each record (NULL fields omitted)."""
    return outbox.withColumn("body", to_json_record("category_id", "datetime", "price", "from", "type", "memo"))


def classify_pending(spark: SparkSession, store: LedgerStore, *, run_date=None,
                     dry_run: bool = False, strategy: str = "auto",
                     on_invalid: str = "abort", source_tag: str = DEFAULT_SOURCE_TAG) -> ClassifyResult:
    lap(None)
    if not dry_run:
        finish_open_batch(store, run_date)
    events = store.read("detail_status")
    seq = next_batch(store)
    runs = store.read("classify_run")
    mark = runs.agg(F.max_by(F.struct("hwm", "seq"), "seq").alias("m")).first()[0] \
        if store.exists("classify_run") else None
    hwm, mark_seq = (mark["hwm"], mark["seq"]) if mark is not None else (None, None)
    detail = store.read("detail")
    snap_max = store.top("detail") or None  # the snapshot this batch judges
    if snap_max is not None:
        detail = detail.filter(F.col("id") <= F.lit(snap_max))
    pend = S.pending_since(detail, events, hwm, mark_seq)
    lap("seq, mark, snapshot")
    classified = R.classify(pend, store.rules(), row_id="id", strategy=strategy, on_invalid=on_invalid)
    classified = stage(classified, "classified")
    lap("classified staged")
    at = run_date if run_date is not None else F.current_date()
    out = outbox_records(classified, seq, source_tag)
    ev = S.judge_events(classified, at, seq)
    if dry_run:
        return ClassifyResult(classified, out, ev, seq)
    store.append("outbox", out)
    lap("outbox appended")
    store.append("detail_status", ev)
    lap("status appended")
    counts = classified.agg(F.count(F.lit(1)).alias("judged"),
                            F.count("category_id").alias("forwarded"))
    store.append("classify_run", counts.select(
        F.lit(seq).cast("long").alias("seq"),
        F.lit(snap_max if snap_max is not None else hwm).cast("long").alias("hwm"),
        "judged", "forwarded", F.lit(at).cast("date").alias("at")))
    lap("mark appended")
    store.compact_status(least_tail=COMPACT_EVENTS)
    return ClassifyResult(classified, out, ev, seq)


RESET_OPERATION = "reset"  # fixed value: the only operation a detail accepts


def patch_details(spark: SparkSession, store: LedgerStore, ids: DataFrame, operation: str,
                  run_date=None) -> int:
    """M2 entry point: only the ``reset`` operation is defined."""
    if operation != RESET_OPERATION:
        raise ValueError(f"a detail has no operation {operation!r}")
    return reset_details(spark, store, ids, run_date)


def reset_details(spark: SparkSession, store: LedgerStore, ids: DataFrame, run_date=None) -> int:
    """M2: reset a DataFrame of ids to pending. Returns the batch number."""
    seq = next_batch(store)
    at = run_date if run_date is not None else F.current_date()
    store.append("detail_status", S.reset_events(ids, at, seq))
    return seq
