"""ST1 / ST2: restarts resume from the checkpoint; new files only."""

from conftest import write
from tally.plans.importer import import_ledger
from tally.sources.store import LedgerStore
from tally.streaming.jobs import read_latest_runs, stream_import, stream_latest_runs


def test_asset_stream_resumes(spark, workdir):
    store = LedgerStore(spark, f"{workdir}/store")
    landing, ckpt = f"{workdir}/landing", f"{workdir}/ckpt"
    write(f"{landing}/run=1/asset_history.csv", "日付,合計,a,b,c,d,e\n2025-08-01,\"1,000\",1,0,1,1,x\n")
    stream_import(spark, store, landing, ckpt, kind="asset", job_label="s").awaitTermination()
    assert store.read("asset_history").count() == 1
    # restart with nothing new: no batch, nothing written
    stream_import(spark, store, landing, ckpt, kind="asset", job_label="s").awaitTermination()
    assert store.read("import_history").count() == 1
    # a new drop (unique path) with one known and one new date
    write(f"{landing}/run=2/asset_history.csv", "2025-08-01,5,1,0,1,1,x\n2025-07月末,\"2,000\",1,0,1,1,y\n")
    stream_import(spark, store, landing, ckpt, kind="asset", job_label="s").awaitTermination()
    rows = sorted((str(r.date), r.total_amount) for r in store.read("asset_history").collect())
    assert rows == [("2025-07-31", 2000), ("2025-08-01", 1000)]


def test_gauges_follow_history(spark, workdir):
    store = LedgerStore(spark, f"{workdir}/store")
    import_ledger(spark, store, [write(f"{workdir}/in1/cf.csv", ",2024/07/19,A,-1,i,l,m,,,\n")], job_label="j1")
    import_ledger(spark, store, [write(f"{workdir}/in2/cf.csv", ",2024/07/19,A,-1,i,l,m,,,\n"
                                                                ",2024/07/20,B,-2,i,l,m,,,\n")], job_label="j2")
    out, ckpt = f"{workdir}/gauges", f"{workdir}/gckpt"
    stream_latest_runs(spark, store.path("import_history"), out, ckpt).awaitTermination()
    got = {r.job_label: (r.parsed_entry_num, r.new_entry_num) for r in read_latest_runs(spark, out).collect()}
    assert got == {"j1": (1, 1), "j2": (2, 1)}


def test_mixed_drop_stream_routes_by_name(spark, workdir):
    from tally.streaming.jobs import stream_drops
    store = LedgerStore(spark, f"{workdir}/store")
    landing, ckpt = f"{workdir}/landing", f"{workdir}/ckpt"
    write(f"{landing}/run=1/cf.csv", ",2024/07/19,A,-1,i,l,m,,,\n")
    write(f"{landing}/run=1/asset_history.csv", "2025-08-01,1,1,0,1,1,x\n")
    write(f"{landing}/run=1/dummy.csv", "ignored\n")
    stream_drops(spark, store, landing, ckpt, job_label="d").awaitTermination()
    assert store.read("detail").count() == 1 and store.read("asset_history").count() == 1
    write(f"{landing}/run=2/cf.csv", ",2024/07/19,A,-1,i,l,m,,,\n,2024/07/20,B,-2,i,l,m,,,\n")
    stream_drops(spark, store, landing, ckpt, job_label="d").awaitTermination()
    assert sorted(r.name for r in store.read("detail").collect()) == ["A", "B"]


def test_files_without_a_byte_have_history_in_a_stream(spark, workdir):
    store = LedgerStore(spark, f"{workdir}/store")
    landing, ckpt = f"{workdir}/landing", f"{workdir}/ckpt"
    write(f"{landing}/run=1/a b_cf.csv", "")
    write(f"{landing}/run=1/c_cf.csv", ",2024/07/19,A,-1,i,l,m,,,\n")
    for k in range(2, 14):  # past a compaction of the file log
        stream_import(spark, store, landing, ckpt, job_label="s").awaitTermination()
        write(f"{landing}/run={k}/d{k:02d}_cf.csv", "")
    stream_import(spark, store, landing, ckpt, job_label="s").awaitTermination()
    got = [(r.id, r.src_file, r.parsed_entry_num) for r in store.read("import_history").orderBy("id").collect()]
    assert got == [(1, "a b_cf.csv", 0), (2, "c_cf.csv", 1)] + [(k + 1, f"d{k:02d}_cf.csv", 0) for k in range(2, 14)]


def test_a_replayed_epoch_changes_nothing(spark, workdir):
    from tally.plans.table_queries import _forget_last_epoch
    store = LedgerStore(spark, f"{workdir}/store")
    landing, ckpt = f"{workdir}/landing", f"{workdir}/ckpt"
    write(f"{landing}/run=1/cf.csv", ",2024/07/19,A,-1,i,l,m,,,\n")
    stream_import(spark, store, landing, ckpt, job_label="s").awaitTermination()
    write(f"{landing}/run=2/cf.csv", ",2024/07/19,A,-1,i,l,m,,,\n,2024/07/20,B,-1,i,l,m,,,\n")
    stream_import(spark, store, landing, ckpt, job_label="s").awaitTermination()
    before = [sorted(map(str, store.read(t).collect())) for t in ("detail", "import_history")], len(store._markers())
    _forget_last_epoch(spark, ckpt)
    stream_import(spark, store, landing, ckpt, job_label="s").awaitTermination()
    assert ([sorted(map(str, store.read(t).collect())) for t in ("detail", "import_history")], len(store._markers())) == before
    assert before[1] == 2


def test_an_aborted_epoch_is_tried_again(spark, workdir):
    import pytest
    store = LedgerStore(spark, f"{workdir}/store")
    landing, ckpt = f"{workdir}/landing", f"{workdir}/ckpt"
    write(f"{landing}/run=1/a_cf.csv", ",2024/07/19,A,-1,i,l,m,,,\n")
    bad = write(f"{landing}/run=1/b_cf.csv", ",2024/07/32,X,-1,i,l,m,,,\n")
    write(f"{landing}/run=1/c_cf.csv", ",2024/07/21,C,-1,i,l,m,,,\n")
    with pytest.raises(Exception, match="invalid rows"):
        stream_import(spark, store, landing, ckpt).awaitTermination()
    assert [r.name for r in store.read("detail").collect()] == ["A"]
    write(bad, ",2024/07/20,B,-1,i,l,m,,,\n")  # mended in place
    stream_import(spark, store, landing, ckpt).awaitTermination()
    rows = store.read("detail").orderBy("id").collect()
    assert [(r.id, r.name) for r in rows] == [(1, "A"), (2, "B"), (3, "C")]


def test_gauges_publish_what_changed(spark, workdir):
    """A trigger with one changed label writes one row; late, lower ids write
    none; bases keep the reader short, and a replayed epoch changes nothing."""
    from pyspark.sql import functions as F
    from tally.plans.table_queries import _forget_last_epoch
    from tally.schemas import IMPORT_HISTORY
    src, out, ckpt = f"{workdir}/history", f"{workdir}/gauges", f"{workdir}/gckpt"

    def land(rows):
        df = spark.createDataFrame(rows, "id long, job_label string, parsed_entry_num long")
        cols = [(F.col(f.name) if f.name in df.columns else F.lit(1)).cast(f.dataType if f.dataType.simpleString() != "timestamp"
                else "long").cast(f.dataType).alias(f.name) for f in IMPORT_HISTORY.fields]
        df.select(*cols).write.mode("append").parquet(src)
        stream_latest_runs(spark, src, out, ckpt, base_every=3).awaitTermination()

    def published(epoch):
        return spark.read.parquet(f"{out}/v={epoch}").count()

    land([(1, "a", 10), (2, "b", 20), (3, None, 30), (4, "a", 40)])
    land([(9, "b", 90)])
    land([(5, "b", 50), (3, "c", 5)])
    land([(2, None, 1)])
    assert [published(e) for e in range(4)] == [3, 1, 1, 0]
    want = {"a": (4, 40), "b": (9, 90), None: (3, 30), "c": (3, 5)}
    got = lambda: {r.job_label: (r.id, r.parsed_entry_num) for r in read_latest_runs(spark, out).collect()}
    assert got() == want
    land([(20, "c", 200)])
    _forget_last_epoch(spark, ckpt)
    stream_latest_runs(spark, src, out, ckpt, base_every=3).awaitTermination()
    assert published(4) == 1 and got() == want | {"c": (20, 200)}
    import os
    assert os.path.isdir(f"{out}/base=2")
