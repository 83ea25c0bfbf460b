"""The scale-oriented fast paths must equal their exact definitions."""

import datetime as dt
import random

from pyspark.sql import functions as F

from tally.operators import status as S, views
from tally.operators.ordinal import global_ordinal, rank_within, small_ordinal


def _detail(spark, n):
    return spark.createDataFrame([(i, dt.date(2024, 1, 1 + i % 28), f"n{i}", i * 10, dt.date(2024, 2, 1))
                                  for i in range(1, n + 1)],
                                 "id long, date date, name string, price long, regist_date date")


def _events(spark, rows):
    return spark.createDataFrame([(d, op, dt.date(2024, 3, 1), seq) for d, op, seq in rows],
                                 "detail_id long, op string, at date, seq long")


def ids(df):
    return sorted(r.id for r in df.select("id").collect())


def test_pending_since_equals_exact(spark):
    detail = _detail(spark, 40)
    # batch 1 judged ids 1..20 (mark 20); 5 and 7 reset later, 7 judged again;
    # batch 3 judged 21..25 but died before writing its mark
    ev = [(i, "check" if i % 3 else "forward", 1) for i in range(1, 21)]
    ev += [(5, "reset", 2), (7, "reset", 2), (7, "check", 3)]
    ev += [(i, "check", 3) for i in range(21, 26)]
    events = _events(spark, ev)
    exact = ids(S.pending(detail, events))
    assert exact == [5] + list(range(26, 41))
    assert ids(S.pending_since(detail, events, 20)) == exact
    assert ids(S.pending_since(detail, events, 20, mark_seq=1)) == exact
    assert ids(S.pending_since(detail, events, None)) == exact


def test_page_range_cut_equals_full_topk(spark):
    detail = _detail(spark, 200)
    events = _events(spark, [(199, "forward", 1), (150, "check", 1)])
    got = views.detail_page(detail, events, 20, 40).collect()
    assert [r.id for r in got] == list(range(160, 140, -1))
    # with gaps in the ids the range holds too few rows: falls back to the table
    gappy = detail.filter((F.col("id") % 2 == 0) | (F.col("id") < 50))
    got2 = views.detail_page(gappy, events, 20, 40).collect()
    expect = sorted((r.id for r in gappy.collect()), reverse=True)[40:60]
    assert [r.id for r in got2] == expect
    top = views.detail_page(detail, events, 3, 0).collect()
    assert [(r.id, r.importJudgeDate, r.importDate) for r in top] == [
        (200, None, None), (199, dt.date(2024, 3, 1), dt.date(2024, 3, 1)), (198, None, None)]


def test_ordinals_against_brute_force_with_hot_group(spark):
    random.seed(7)
    # one group holds a third of the rows
    rows = [(i, "hot" if i % 3 == 0 else f"g{random.randint(0, 40)}", random.random()) for i in range(3000)]
    df = spark.createDataFrame(rows, "k long, grp string, v double")
    got = {r.k: r.o for r in global_ordinal(df, [F.col("v"), F.col("k")], "o").collect()}
    want = {k: i for i, (k, _, _) in enumerate(sorted(rows, key=lambda r: (r[2], r[0])))}
    assert got == want
    got2 = {r.k: (r.pos, r.size) for r in rank_within(df, ["grp"], [F.col("k").desc()], "pos", "size").collect()}
    by = {}
    for k, g, _ in rows:
        by.setdefault(g, []).append(k)
    want2 = {}
    for g, ks in by.items():
        for i, k in enumerate(sorted(ks, reverse=True)):
            want2[k] = (i, len(ks))
    assert got2 == want2
    small = {r.k: r.o for r in small_ordinal(df, [F.col("v"), F.col("k")], "o", 3000).collect()}
    assert small == want


def test_mark_ranges_hold_every_page():
    """Pages found from marks, with and without holes, against the ids."""
    random.seed(3)
    for dense in (True, False):
        ids, marks, last = [], [], 0
        for _ in range(30):
            size = random.randint(1, 9)
            gap = random.choice([0, 0, 5])
            own = list(range(last + 1 + gap, last + 1 + gap + size)) if dense else \
                sorted(random.sample(range(last + 1 + gap, last + 40 + gap), size))
            if not marks or own[0] > last + 1:
                marks.append([own[0] - 1, len(ids)])
            ids += own
            last = own[-1]
            marks.append([last, len(ids)])
        newest = ids[::-1]
        for limit in (1, 3, 20, 500):
            for offset in range(0, len(ids) + 3):
                found = views.mark_range(marks, limit, offset)
                want = newest[offset:offset + limit]
                if found is None:
                    assert want == []
                    continue
                above, upto, skip = found
                inside = [i for i in newest if above < i <= upto]
                assert inside[skip:skip + limit] == want, (dense, limit, offset)
                if dense:
                    assert skip == 0 and len(inside) == len(want)
                else:
                    assert len(inside) <= limit + 2 * 9
    assert views.mark_range([], 5, 0) is None and views.mark_range(marks, 0, 0) is None


def _store_rows(spark, ids):
    from tally.schemas import DETAIL
    day = dt.date(2024, 1, 1)
    rows = [(i, 1, day, f"n{i}", i, "", "", "", day, "", "", "f", None, None, 202401) for i in ids]
    return spark.createDataFrame(rows, DETAIL).drop("ym")


def test_stored_pages_read_one_range(spark, workdir):
    from tally.sources.store import LedgerStore
    store = LedgerStore(spark, f"{workdir}/store")
    ids = list(range(1, 41)) + list(range(50, 300, 7)) + list(range(300, 320))
    for own in (ids[:40], ids[40:76], ids[76:]):
        store.append("detail", _store_rows(spark, own))
    store.append("detail_status", _events(spark, [(i, "check", 1) for i in ids[:60]]))
    store.compact_status()
    store.append("detail_status", _events(spark, [(ids[5], "reset", 2), (ids[70], "forward", 2)]))
    judged = set(ids[:60]) - {ids[5]} | {ids[70]}
    for limit, offset in ((5, 0), (7, 30), (20, 60), (20, 90), (5, 200)):
        df = views.stored_page(store, limit, offset)
        got = [(r.id, r.importJudgeDate is not None) for r in df.collect()]
        assert got == [(i, i in judged) for i in ids[::-1][offset:offset + limit]]
    plan = views.stored_page(store, 3, 85)._jdf.queryExecution().executedPlan().toString()  # ids 8 to 10 from below
    assert "GreaterThan(id," in plan and "LessThanOrEqual(id," in plan and "GreaterThan(detail_id," in plan
    store.append("detail", _store_rows(spark, [45]))  # below the others: no marks any more
    assert store.marks("detail") is None
    assert [r.id for r in views.stored_page(store, 2, 55).collect()] == sorted([*ids, 45], reverse=True)[55:57]
    assert views.stored_page(LedgerStore(spark, f"{workdir}/none")).collect() == []


def test_base_and_tail_equal_all_events(spark, workdir):
    from tally.sources.store import LedgerStore
    random.seed(5)
    store, events = LedgerStore(spark, f"{workdir}/store"), []
    detail = _detail(spark, 60)
    for seq in range(1, 8):
        own = [(i, random.choice(["check", "forward", "reset"]), seq) for i in random.sample(range(1, 61), 15)]
        events += own
        store.append("detail_status", _events(spark, own))
        if seq in (2, 3, 6):
            assert store.compact_status()
        key = lambda r: (r.id, r.maw_check_date, r.maw_regist_date)
        got = sorted(map(key, S.with_state(detail, store.status()).collect()), key=str)
        assert got == sorted(map(key, S.with_status(detail, _events(spark, events)).collect()), key=str)
    base, tail, n = store.status_parts()
    assert n == 15 and tail.count() == 15 and base.count() == len({i for i, _, s in events if s <= 6})
    assert not store.compact_status(least_tail=16) and not store.compact_status(least_tail=15)  # fewer than the base
    old = [f for f in store.folders("detail_status") if f in str(tail.inputFiles())]
    assert len(old) == 1  # the tail's folder alone is listed


def test_a_drop_in_bounded_runs_goes_on_where_it_died(spark, workdir, monkeypatch):
    from conftest import write
    from tally.plans import importer
    from tally.sources.store import LedgerStore
    store = LedgerStore(spark, f"{workdir}/store")
    for k in range(5):
        write(f"{workdir}/drop/{k}_cf.csv", f",2024/07/{k + 1:02d},N{k},-1,i,l,m,,,\n")
    write(f"{workdir}/drop/5_cf.csv", "")
    real, calls = importer._import_kinds, []

    def dies(spark, store, by_kind, **kw):
        calls.append(kw["run_id"])
        if len(calls) == 2:
            raise RuntimeError("lost")
        return real(spark, store, by_kind, **kw)

    monkeypatch.setattr(importer, "_import_kinds", dies)
    try:
        importer.import_drop(spark, store, f"{workdir}/drop", run_id="d", max_files=2)
    except RuntimeError:
        pass
    assert [r.name for r in store.read("detail").orderBy("id").collect()] == ["N0", "N1"]
    importer.import_drop(spark, store, f"{workdir}/drop", run_id="d", max_files=2)
    assert calls == ["d.0", "d.1", "d.1", "d.2"]
    assert [(r.id, r.name) for r in store.read("detail").orderBy("id").collect()] == [(k + 1, f"N{k}") for k in range(5)]
    assert [r.src_file for r in store.read("import_history").orderBy("id").collect()] == [f"{k}_cf.csv" for k in range(6)]
