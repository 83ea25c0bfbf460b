"""Runs of the store: nothing of a dead run is seen, a retry replaces it."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from conftest import write
from tally.plans import importer
from tally.plans.importer import import_drop, import_ledger
from tally.sources.store import LedgerStore, WriteConflict

ROWS = ",2024/07/19,A,-1,i,l,m,,,\n,2024/07/20,B,-2,i,l,m,,,\n"


def names(store):
    return sorted((r.id, r.name) for r in store.read("detail").collect())


def history(store):
    return [(r.id, r.src_file, r.parsed_entry_num, r.new_entry_num) for r in store.read("import_history").orderBy("id").collect()]


CLEAN = ([(1, "B"), (2, "A")], [(1, "cf.csv", 2, 2)])


@pytest.mark.parametrize("run_id", [None, "drop-1"])
def test_death_between_detail_and_history(spark, workdir, monkeypatch, run_id):
    """The retry gives the rows and counts of one clean run."""
    store, p = LedgerStore(spark, f"{workdir}/store"), write(f"{workdir}/in/cf.csv", ROWS)

    def dies(*a, **kw):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(importer, "_history_rows", dies)
        with pytest.raises(RuntimeError, match="lost"):
            import_ledger(spark, store, [p], run_id=run_id)
    assert names(store) == [] and history(store) == [] and store.top("detail") == 0
    assert len(store.abandoned()) == 1
    import_ledger(spark, store, [p], run_id=run_id)
    assert (names(store), history(store)) == CLEAN
    assert store.abandoned() == ([] if run_id else store.abandoned()) and store.rows("detail") == 2


def test_death_before_the_commit(spark, workdir, monkeypatch):
    store, p = LedgerStore(spark, f"{workdir}/store"), write(f"{workdir}/in/cf.csv", ROWS)
    with monkeypatch.context() as m:
        m.setattr(importer.Run, "commit", lambda self: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError, match="lost"):
            import_ledger(spark, store, [p], run_id="r")
    assert names(store) == [] and history(store) == []
    import_ledger(spark, store, [p], run_id="r")
    assert (names(store), history(store)) == CLEAN


def test_a_committed_run_is_not_run_again(spark, workdir):
    store, p = LedgerStore(spark, f"{workdir}/store"), write(f"{workdir}/in/cf.csv", ROWS)
    import_ledger(spark, store, [p], run_id="r")
    write(p, ROWS + ",2024/07/21,C,-3,i,l,m,,,\n")
    res = import_ledger(spark, store, [p], run_id="r")
    assert res.replayed and sorted(r.name for r in res.inserted.collect()) == ["A", "B"]
    assert (names(store), history(store)) == CLEAN


def test_both_kinds_of_a_drop_appear_together(spark, workdir, monkeypatch):
    store = LedgerStore(spark, f"{workdir}/store")
    write(f"{workdir}/drop/cf.csv", ROWS)
    write(f"{workdir}/drop/asset_history.csv", "2025-08-02,1,1,0,1,1,x\n")
    with monkeypatch.context() as m:
        m.setattr(importer.dedup, "asset_history_delta", lambda c: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError, match="lost"):
            import_drop(spark, store, f"{workdir}/drop", run_id="d")
    assert names(store) == [] and store.read("asset_history").isEmpty()
    import_drop(spark, store, f"{workdir}/drop", run_id="d")
    assert names(store) == CLEAN[0] and store.read("asset_history").count() == 1
    assert history(store) == [(1, "cf.csv", 2, 2), (2, "asset_history.csv", 1, 1)]


def test_a_second_writer_fails_and_is_not_seen(spark, workdir):
    store = LedgerStore(spark, f"{workdir}/store")
    row = spark.createDataFrame([(1, dt.date(2024, 1, 1))], "seq long, at date").select(
        "seq", F.lit(1).alias("hwm"), F.lit(1).alias("judged"), F.lit(1).alias("forwarded"), "at")
    first, second = store.begin("one"), store.begin("two")
    for run in (first, second):
        run.append("classify_run", row)
    first.commit()
    with pytest.raises(WriteConflict):
        second.commit()
    assert store.read("classify_run").count() == 1 and store.abandoned() == ["two"]
    with pytest.raises(ValueError):
        store.begin("one")
    with pytest.raises(ValueError):
        store.begin("a~b")


def test_markers_carry_counts_and_maxima(spark, workdir):
    """Counts and largest ids come from the newest marker, not from a scan."""
    store = LedgerStore(spark, f"{workdir}/store")
    for k in range(3):
        import_ledger(spark, store, [write(f"{workdir}/in{k}/cf.csv", ROWS + f",2024/08/{k + 1:02d},N{k},-1,i,l,m,,,\n")])
        assert store.rows("detail") == store.read("detail").count() == 3 + k
        assert store.top("detail") == store.read("detail").agg(F.max("id")).first()[0] == 3 + k
    assert store.top("import_history") == store.read("import_history").agg(F.max("id")).first()[0]
    assert store.read_run("detail", store._markers()[-1].split("~")[1]).count() == 1
