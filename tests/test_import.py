"""CSV scan, typing, positions, dedup, ids, counts and history end to end."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from conftest import write
from tally.operators import validate
from tally.plans.importer import ImportAborted, import_assets, import_drop, import_ledger
from tally.sources.csv_scan import resolve_encoding, scan_asset_csv, scan_ledger_csv
from tally.sources.store import LedgerStore

HEADER = '"計算対象","日付","内容","金額（円）","保有金融機関","大項目","中項目","メモ","振替","ID"\n'
CF = (HEADER
      + '"1","2024/08/19","GREEN MARKET 12","-2310","青空カード","通信費","その他通信費","","0","a1"\n'
      + '"1","2024/08/03","みどり商店","-761","青空カード","食費","食料品","","0","a2"\n'
      + '"1","2024/08/03","Ｂｌｕｅ　Ｓｈｏｐ　Ｔｅｎ","-915","白鳥カード","未分類","未分類","","0","a3"\n')
CF_OLD_FORM = ("計算対象,日付,内容,金額（円）,保有金融機関,大項目,中項目,メモ,振替,削除\n"
               ",06/10(水),ひので食堂,-820,青空カード,食費,外食,,,\n"
               ',06/10(水),KAZE PAY,"-7,204",青空カード,その他,雑費,,,\n')
CF_NO_HEADER = (",2024/07/19,うみ寿司,-1933,青空カード,食費,外食,,,\n"
                ",2024/07/12,みどり商店,-347,青空カード,食費,食料品,,,\n")
ASSET = ("日付,合計,預金・現金・暗号資産,株式(現物),投資信託,ポイント,詳細\n"
         '2025-08-02,"5,600,000","3,500,000",0,"1,400,000","100,000",おためし\n'
         '2025-08-01,"4,700,000","3,100,000",0,"1,500,000","100,000",おためし\n'
         '2025-05月末,"6,300,000","3,500,000",0,"1,400,000","100,000",月末\n')


def typed_rows(spark, paths, encoding="utf8"):
    return validate.type_ledger(scan_ledger_csv(spark, paths, encoding), "2024-08-23")


def test_cf_fixture(spark, workdir):
    p = write(f"{workdir}/cf.csv", CF)
    rows = typed_rows(spark, [p]).filter("NOT is_header").orderBy("row_idx").collect()
    got = [(r.yyyymm_id, r.date, r.name, r.price, r.reject) for r in rows]
    assert got == [(3, dt.date(2024, 8, 19), "GREEN MARKET 12", 2310, None),
                   (2, dt.date(2024, 8, 3), "みどり商店", 761, None),
                   (1, dt.date(2024, 8, 3), "Ｂｌｕｅ　Ｓｈｏｐ　Ｔｅｎ", 915, None)]


def test_old_date_form_rejects_file(spark, workdir):
    p = write(f"{workdir}/cf_lastmonth.csv", CF_OLD_FORM)
    rep = validate.file_report(typed_rows(spark, [p])).first()
    assert rep.rejected_rows == 2 and rep.first_bad_row == 1


@pytest.mark.parametrize("enc,codec", [("utf8", "utf-8"), ("", "utf-8"), ("sjis", "shift_jis"), ("SJIS", "shift_jis")])
def test_encodings(spark, workdir, enc, codec):
    p = write(f"{workdir}/cf.csv", CF_NO_HEADER, codec)
    rows = typed_rows(spark, [p], enc).orderBy("row_idx").collect()
    assert [(r.name, r.price, r.yyyymm_id) for r in rows] == [("うみ寿司", 1933, 2), ("みどり商店", 347, 1)]


def test_bad_encoding_name():
    with pytest.raises(ValueError):
        resolve_encoding("latin1")


def test_positions_header_mid_file_quotes_and_ragged(spark, workdir):
    text = (',2024/07/19,"multi\nline",-1,x,a,b,,,\n'
            "\n"
            + HEADER
            + ',2024/07/18,"say ""hi""",-2,x,a,b,,,\n'
            + "short,row\n")
    p = write(f"{workdir}/cf.csv", text)
    rows = typed_rows(spark, [p]).orderBy("row_idx").collect()
    assert [r.row_idx for r in rows] == [0, 1, 2, 3]
    assert [r.n_file_rows for r in rows] == [4, 4, 4, 4]
    assert [r.yyyymm_id for r in rows] == [4, 3, 2, 1]
    assert rows[0].name == "multi\nline" and rows[2].name == 'say "hi"'
    assert rows[1].is_header and rows[3].reject == "arity"


def test_positions_many_files_and_partitions(spark, workdir):
    # enough rows that a file spans several records per task and several files share tasks
    paths = []
    for f in range(6):
        lines = [f",2024/01/{(i % 28) + 1:02d},n{f}_{i},-{i},x,a,b,,,\n" for i in range(500 + f)]
        paths.append(write(f"{workdir}/drop/f{f}_cf.csv", "".join(lines)))
    rows = typed_rows(spark, paths).select("src_file", "file_rank", "row_idx", "n_file_rows", "name").collect()
    for r in rows:
        f, i = r.name[1:].split("_")
        assert r.row_idx == int(i) and r.n_file_rows == 500 + int(f) and r.file_rank == int(f)


def test_asset_scan(spark, workdir):
    p = write(f"{workdir}/asset_history.csv", ASSET)
    rows = validate.type_asset(scan_asset_csv(spark, [p])).filter("NOT is_header").orderBy("row_idx").collect()
    assert [(r.date, r.total_amount, r.cash_deposit_crypto, r.stocks, r.investment_trusts, r.points) for r in rows] == [
        (dt.date(2025, 8, 2), 5600000, 3500000, 0, 1400000, 100000),
        (dt.date(2025, 8, 1), 4700000, 3100000, 0, 1500000, 100000),
        (dt.date(2025, 5, 31), 6300000, 3500000, 0, 1400000, 100000)]


def test_asset_arity_and_bad_date(spark, workdir):
    p = write(f"{workdir}/asset_history.csv", "2025-08-02,1,2\ninvalid-date,1,2,3,4,5,x\n")
    rows = validate.type_asset(scan_asset_csv(spark, [p])).orderBy("row_idx").collect()
    assert [r.reject for r in rows] == ["arity", "date"]


def _details(store):
    return store.read("detail").orderBy("id").collect()


def test_import_twice_is_idempotent(spark, workdir):
    store = LedgerStore(spark, f"{workdir}/store")
    p = write(f"{workdir}/in/cf.csv", CF)
    r1 = import_ledger(spark, store, [p], job_label="job", run_date="2024-08-23")
    assert [(d.id, d.yyyymm_id, d.name) for d in _details(store)] == [
        (1, 1, "Ｂｌｕｅ　Ｓｈｏｐ　Ｔｅｎ"), (2, 2, "みどり商店"), (3, 3, "GREEN MARKET 12")]
    c1 = r1.counts.collect()
    assert [(c.src_file, c.parsed_entry_num, c.new_entry_num) for c in c1] == [("cf.csv", 3, 3)]
    assert store.read("import_history").count() == 1
    r2 = import_ledger(spark, store, [p], job_label="job", run_date="2024-08-24")
    assert r2.inserted.count() == 0 and r2.duplicates.count() == 3
    assert store.read("detail").count() == 3
    # same parsed count as the last run of this file: no new history row (M5)
    assert store.read("import_history").count() == 1


def test_in_run_dedup_and_ids_across_files(spark, workdir):
    store = LedgerStore(spark, f"{workdir}/store")
    a = write(f"{workdir}/in/a_cf.csv",
              ",2024/07/19,X,-1,i,l,m,,,\n,2024/07/19,X,-1,i,l,m,,,second-copy\n,2024/07/18,Y,-2,i,l,m,,,\n")
    b = write(f"{workdir}/in/b_cf.csv", ",2024/07/19,X,-1,i,l,m,,,\n,2024/07/17,Z,-3,i,l,m,,,\n")
    res = import_ledger(spark, store, [b, a], job_label="j", run_date="2024-08-01")
    got = [(d.id, d.src_file, d.name, d.yyyymm_id) for d in _details(store)]
    # a_cf.csv first (name order), last row first; the later copy of X in a wins over the earlier one
    assert got == [(1, "a_cf.csv", "Y", 1), (2, "a_cf.csv", "X", 2), (3, "b_cf.csv", "Z", 1)]
    counts = {c.src_file: (c.parsed_entry_num, c.new_entry_num) for c in res.counts.collect()}
    assert counts == {"a_cf.csv": (3, 2), "b_cf.csv": (2, 1)}


def test_dry_run_counts_more_and_writes_nothing(spark, workdir):
    store = LedgerStore(spark, f"{workdir}/store")
    a = write(f"{workdir}/in/cf.csv", ",2024/07/19,X,-1,i,l,m,,,\n,2024/07/19,X,-1,i,l,m,,,\n")
    res = import_ledger(spark, store, [a], dry_run=True)
    assert res.inserted.count() == 2
    assert store.read("detail").count() == 0 and store.read("import_history").count() == 0


def test_abort_policy_keeps_earlier_files(spark, workdir):
    store = LedgerStore(spark, f"{workdir}/store")
    good = write(f"{workdir}/in/a_cf.csv", CF_NO_HEADER)
    bad = write(f"{workdir}/in/b_cf_lastmonth.csv", CF_OLD_FORM)
    later = write(f"{workdir}/in/c_cf.csv", ",2024/07/10,Q,-5,i,l,m,,,\n")
    with pytest.raises(ImportAborted):
        import_ledger(spark, store, [good, bad, later], job_label="j")
    assert sorted(d.name for d in _details(store)) == ["うみ寿司", "みどり商店"]


def test_quarantine_policy(spark, workdir):
    store = LedgerStore(spark, f"{workdir}/store")
    good = write(f"{workdir}/in/a_cf.csv", CF_NO_HEADER)
    bad = write(f"{workdir}/in/b_cf_lastmonth.csv", CF_OLD_FORM)
    later = write(f"{workdir}/in/c_cf.csv", ",2024/07/10,Q,-5,i,l,m,,,\n")
    res = import_ledger(spark, store, [good, bad, later], policy="quarantine")
    assert sorted(d.name for d in _details(store)) == ["Q", "うみ寿司", "みどり商店"]
    assert res.rejects.count() == 2


def test_history_written_when_parsed_count_changes(spark, workdir):
    store = LedgerStore(spark, f"{workdir}/store")
    p = write(f"{workdir}/in1/cf.csv", CF_NO_HEADER)
    import_ledger(spark, store, [p], job_label="j")
    p2 = write(f"{workdir}/in2/cf.csv", CF_NO_HEADER + ",2024/07/20,NEW,-9,i,l,m,,,\n")
    res = import_ledger(spark, store, [p2], job_label="j")
    h = store.read("import_history").orderBy("id").collect()
    assert [(r.id, r.parsed_entry_num, r.new_entry_num) for r in h] == [(1, 2, 2), (2, 3, 1)]
    assert res.inserted.count() == 1


def test_asset_import_first_row_wins_and_history_only_on_insert(spark, workdir):
    store = LedgerStore(spark, f"{workdir}/store")
    p = write(f"{workdir}/in/asset_history.csv",
              ASSET + '2025-08-02,"1","1",0,"1","1",later copy\n')
    import_assets(spark, store, [p], job_label="a")
    rows = store.read("asset_history").orderBy("id").collect()
    assert [(r.id, r.date, r.total_amount) for r in rows] == [
        (1, dt.date(2025, 8, 2), 5600000), (2, dt.date(2025, 8, 1), 4700000), (3, dt.date(2025, 5, 31), 6300000)]
    import_assets(spark, store, [p], job_label="a")
    assert store.read("import_history").count() == 1  # nothing inserted the second time


def test_import_drop_routes_by_name(spark, workdir):
    store = LedgerStore(spark, f"{workdir}/store")
    d = f"{workdir}/drop"
    write(f"{d}/cf.csv", CF)
    write(f"{d}/asset_history.csv", ASSET)
    write(f"{d}/dummy.csv", "whatever,1\n")
    write(f"{d}/notes.txt", "x")
    out = import_drop(spark, store, d, job_label="j", run_date="2024-08-23")
    assert set(out) == {"ledger", "asset"}
    assert store.read("detail").count() == 3 and store.read("asset_history").count() == 3


def test_collation_key_option(spark, workdir):
    store = LedgerStore(spark, f"{workdir}/store")
    p = write(f"{workdir}/in1/cf.csv", ",2024/07/19,apple,-1,i,l,m,,,\n")
    import_ledger(spark, store, [p])
    p2 = write(f"{workdir}/in2/cf.csv", ",2024/07/19,APPLE ,-1,i,l,m,,,\n")
    assert import_ledger(spark, store, [p2], dry_run=True).inserted.count() == 1
    res = import_ledger(spark, store, [p2], dry_run=True, collation="UNICODE_CI_AI_RTRIM")
    assert res.inserted.count() == 0


def test_bom_header_is_recognised(spark, workdir):
    p = write(f"{workdir}/cf.csv", "﻿" + CF)
    rows = typed_rows(spark, [p]).orderBy("row_idx").collect()
    assert rows[0].is_header and [r.yyyymm_id for r in rows[1:]] == [3, 2, 1]
    assert all(r.reject is None for r in rows)


def test_import_prefix_flattens_by_basename(spark, workdir):
    from tally.plans.importer import import_prefix
    store = LedgerStore(spark, f"{workdir}/store")
    root = f"{workdir}/bucket/cfo"
    write(f"{root}/2025/01/cf.csv", ",2024/07/19,OLD,-1,i,l,m,,,\n")
    write(f"{root}/sub/cf.csv", ",2024/07/19,NEW,-1,i,l,m,,,\n")      # same basename, later key: wins
    write(f"{root}/sub/asset_history.csv", "2025-08-02,1,1,0,1,1,x\n")
    write(f"{root}/dummy.csv", "x\n")
    out = import_prefix(spark, store, root + "/", job_label="s3")
    assert set(out) == {"ledger", "asset"}
    assert [d.name for d in store.read("detail").collect()] == ["NEW"]
    assert store.read("asset_history").count() == 1


def test_split_files_keep_exact_positions(spark, workdir):
    """A large file read by many tasks (no quoted newlines): positions still
    come out exact through the per-split offsets."""
    paths = []
    for f in range(3):
        lines = [f",2024/01/{(i % 28) + 1:02d},n{f}_{i},-{i},x,a,b,,,\n" for i in range(3000 + f)]
        paths.append(write(f"{workdir}/big/f{f}_cf.csv", "".join(lines)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    try:
        scanned = scan_ledger_csv(spark, paths, multiline=False)
        n_splits = scanned.sparkSession.read.csv(paths).rdd.getNumPartitions()
        rows = validate.type_ledger(scanned, "2024-08-23").select(
            "file_rank", "row_idx", "n_file_rows", "yyyymm_id", "name").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert n_splits > 3
    assert len(rows) == 9003
    for r in rows:
        f, i = r.name[1:].split("_")
        assert (r.file_rank, r.row_idx, r.n_file_rows, r.yyyymm_id) == (int(f), int(i), 3000 + int(f), 3000 + int(f) - int(i))


def test_returned_ids_survive_the_append(spark, workdir):
    store = LedgerStore(spark, f"{workdir}/store")
    import_ledger(spark, store, [write(f"{workdir}/in1/cf.csv", CF_NO_HEADER)])
    res = import_ledger(spark, store, [write(f"{workdir}/in2/cf.csv", ",2024/07/20,NEW,-9,i,l,m,,,\n")])
    stored = {d.name: d.id for d in store.read("detail").collect()}
    assert [(r.name, r.id) for r in res.inserted.collect()] == [("NEW", stored["NEW"])] and stored["NEW"] == 3
    assert [r.id for r in res.history.collect()] == [2]


def test_drop_abort_spans_kinds_in_name_order(spark, workdir):
    """A bad asset file stops ledger files named after it, as one sequence."""
    store = LedgerStore(spark, f"{workdir}/store")
    d = f"{workdir}/drop"
    write(f"{d}/a_cf.csv", CF_NO_HEADER)                                # before the bad file: imported
    write(f"{d}/b_asset_history.csv", "2025-08-02,1,2\n")               # arity error
    write(f"{d}/c_cf.csv", ",2024/07/10,LATE,-5,i,l,m,,,\n")           # after: not imported
    with pytest.raises(ImportAborted):
        import_drop(spark, store, d, job_label="j")
    assert sorted(r.name for r in store.read("detail").collect()) == ["うみ寿司", "みどり商店"]
    assert store.read("asset_history").count() == 0


ROW = ",2024/07/{:02d},{},-1,i,l,m,,,\n"


def history(store):
    return [(r.src_file, r.parsed_entry_num, r.new_entry_num) for r in store.read("import_history").orderBy("id").collect()]


def test_files_without_rows_have_history(spark, workdir):
    store = LedgerStore(spark, f"{workdir}/store")
    p = write(f"{workdir}/in/cf.csv", HEADER)
    import_ledger(spark, store, [p], job_label="j")
    assert history(store) == [("cf.csv", 0, 0)]
    p2 = write(f"{workdir}/in2/cf.csv", ROW.format(1, "A"))
    import_ledger(spark, store, [p2])
    p3 = write(f"{workdir}/in3/cf.csv", "")
    res = import_ledger(spark, store, [p3])
    assert history(store) == [("cf.csv", 0, 0), ("cf.csv", 1, 1), ("cf.csv", 0, 0)]
    assert [(r.parsed_entry_num, r.new_entry_num) for r in res.counts.collect()] == [(0, 0)]


def test_equal_names_in_one_run_follow_each_other(spark, workdir):
    store = LedgerStore(spark, f"{workdir}/store")
    paths = [write(f"{workdir}/run={k}/cf.csv", "".join(ROW.format(k, n) for n in names))
             for k, names in ((1, "AB"), (2, "CD"), (3, "E"))]
    import_ledger(spark, store, paths)
    assert history(store) == [("cf.csv", 2, 2), ("cf.csv", 1, 1)]


def test_duplicates_frame_after_a_real_import(spark, workdir):
    store = LedgerStore(spark, f"{workdir}/store")
    import_ledger(spark, store, [write(f"{workdir}/a/cf.csv", ROW.format(1, "A"))])
    res = import_ledger(spark, store, [write(f"{workdir}/b/cf.csv", ROW.format(1, "A") + ROW.format(1, "B"))])
    assert [r.name for r in res.duplicates.collect()] == ["A"] and [r.name for r in res.inserted.collect()] == ["B"]
    again = import_ledger(spark, store, [f"{workdir}/b/cf.csv"])
    assert again.inserted.count() == 0 and again.duplicates.count() == 2


def test_routed_abort_cuts_by_path_not_by_name(spark, workdir):
    from tally.plans.importer import _import_kinds
    good = write(f"{workdir}/run=1/cf.csv", ROW.format(1, "A"))
    bad = write(f"{workdir}/run=2/cf.csv", ",2024/07/32,X,-1,i,l,m,,,\n")
    for n, call in (("kinds", lambda s: _import_kinds(spark, s, {"ledger": [good, bad], "asset": []})),
                    ("direct", lambda s: import_ledger(spark, s, [good, bad]))):
        store = LedgerStore(spark, f"{workdir}/store-{n}")
        with pytest.raises(ImportAborted):
            call(store)
        assert [r.name for r in store.read("detail").collect()] == ["A"], n


def test_file_names_are_stored_as_they_are(spark, workdir):
    store = LedgerStore(spark, f"{workdir}/store")
    names = ["資産 1_cf.csv", "a+b_cf.csv", "c%20d_cf.csv"]
    paths = [write(f"{workdir}/in/{n}", ROW.format(i + 1, f"N{i}")) for i, n in enumerate(names)]
    import_ledger(spark, store, [f"{workdir}/in"] if len(paths) else [])
    assert sorted(r.src_file for r in store.read("detail").collect()) == sorted(names)
    assert sorted(h[0] for h in history(store)) == sorted(names)


@pytest.mark.parametrize("line", [',2024/07/01,a"b,-1,i,l,m,,,\n', ',2024/07/01,"x"y,-1,i,l,m,,,\n', "   \n"])
@pytest.mark.parametrize("multiline", [True, False])
def test_broken_lines_hold_the_file_back(spark, workdir, line, multiline):
    store = LedgerStore(spark, f"{workdir}/store")
    paths = [write(f"{workdir}/a_cf.csv", ROW.format(1, "A") + line + ROW.format(2, "B")),
             write(f"{workdir}/b_cf.csv", ROW.format(3, '"C, ""q"""') + "\n" + ROW.format(4, "D"))]
    res = import_ledger(spark, store, paths, policy="quarantine", multiline=multiline)
    assert sorted(r.name for r in store.read("detail").collect()) == ['C, "q"', "D"]
    assert {r.src_file: r.imported for r in res.report.collect()} == {"a_cf.csv": False, "b_cf.csv": True}


def test_collated_dedup_keeps_one_whole_row(spark):
    from tally.operators import dedup
    rows = spark.createDataFrame([(dt.date(2024, 1, 1), "APPLE ", 1, 0, 0, "iX"), (dt.date(2024, 1, 1), "apple", 1, 0, 1, "iY")],
                                 "date date, name string, price long, file_rank long, row_idx long, fin_ins string")
    out = dedup.first_processed(dedup.keyed(rows, dedup.LEDGER_KEY, "UNICODE_CI_AI_RTRIM"), dedup.LEDGER_KEY).collect()
    assert [(r.name, r.fin_ins) for r in out] == [("apple", "iY")]


def test_stored_copies_of_a_key_are_broadcast_once(spark):
    from tally.operators import dedup
    one = spark.createDataFrame([(dt.date(2024, 1, 1), "A", 1)], "date date, name string, price long")
    stored = one.crossJoin(spark.range(1000)).drop("id")
    assert dedup.stored_hits(one, stored, dedup.LEDGER_KEY, 1).count() == 1


def test_positions_need_no_window_over_all_splits(spark, workdir):
    p = write(f"{workdir}/f_cf.csv", "".join(ROW.format(1, f"n{i}") for i in range(50)))
    for multiline in (True, False):
        plan = scan_ledger_csv(spark, [p], multiline=multiline)._jdf.queryExecution().executedPlan().toString()
        assert "SinglePartition" not in plan


def strict_reader(text):
    """Records of a file as a plain strict reader gives them; None if it
    refuses the file."""
    lines = [line[:-1] if line.endswith("\r") else line for line in text.split("\n")]
    if not lines[-1]:
        lines.pop()
    out, at = [], 0
    while at < len(lines):
        record, at = lines[at], at + 1
        if not record:
            continue
        while record.count('"') % 2:
            if at == len(lines):
                return None
            record, at = record + "\n" + lines[at], at + 1
        fields, p = [], 0
        while True:
            if record[p:p + 1] == '"':
                q = p + 1
                while record[q] != '"' or record[q + 1:q + 2] == '"':
                    q += 2 if record[q] == '"' else 1
                    if q >= len(record):
                        return None
                fields.append(record[p + 1:q].replace('""', '"'))
                p = q + 1
                if record[p:p + 1] not in ("", ","):
                    return None
            else:
                q = record.find(",", p) if "," in record[p:] else len(record)
                if '"' in record[p:q]:
                    return None
                fields.append(record[p:q])
                p = q
            if p >= len(record):
                break
            p += 1
        out.append(fields)
    return out


@pytest.fixture()
def tiny_splits(spark):
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    yield
    spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def check_scan(spark, workdir, texts):
    from tally.schemas import LEDGER_CSV_COLS
    paths = [write(f"{workdir}/drop/{k}", v) for k, v in texts.items()]
    got = {}
    for r in scan_ledger_csv(spark, paths).collect():
        got.setdefault(r.src_file, []).append(r)
    for name, text in texts.items():
        want, own = strict_reader(text), sorted(got.get(name, []), key=lambda r: r.row_idx)
        if want is None:
            assert [(r.row_idx, r._corrupt) for r in own] == [(0, '"')], name
            continue
        assert [r.row_idx for r in own] == list(range(len(want))), name
        for r, fields in zip(own, want, strict=True):
            assert r.n_file_rows == len(want) and (r._corrupt is None) == (len(fields) == 10), (name, fields)
            if len(fields) == 10:
                assert [r[c] or "" for c in LEDGER_CSV_COLS] == fields, name
    return paths


def test_records_over_many_splits_equal_a_strict_reader(spark, workdir, tiny_splits):
    """Quoted newlines, closing and open quotes, CRLF and empty lines at any
    place of files that are cut into splits of 4 KB."""
    import random
    rng = random.Random(1)

    def field():
        if rng.random() < 0.3:
            return '"' + "".join(rng.choice(["a", '""', "\n", "\r\n", ",", " ", "漢", "\n\n"]) for _ in range(rng.randrange(8))) + '"'
        return "".join(rng.choice("ab é0") for _ in range(rng.randrange(5)))

    texts = {}
    for k in range(12):
        body = "".join(",".join(field() for _ in range(10 if rng.random() < 0.97 else 9)) + rng.choice(["\n", "\r\n", "\n\n"])
                       for _ in range(rng.choice([0, 1, 60, 200])))
        if k % 6 == 5:
            body = body[:len(body) // 2] + rng.choice(['"', 'x"y', '"a"b,']) + body[len(body) // 2:]
        texts[f"f{k:02d}_cf.csv"] = body
    texts["long_cf.csv"] = ',2024/01/01,"' + "x,\n" * 5000 + '",-1,x,a,b,,,\n' + "".join(ROW.format(1, f"n{i}") for i in range(10))
    texts["last_cf.csv"] = ROW.format(1, "A") + ',2024/07/02,"no\nend",-1,i,l,m,,,'
    paths = check_scan(spark, workdir, texts)
    from tally.sources.csv_scan import read_text
    assert read_text(spark, [p for p in paths if "long" in p]).rdd.getNumPartitions() >= 3


def test_strict_quoting_over_many_splits(spark, workdir, tiny_splits):
    body = "".join(f'"a{i}","say ""{i}""\n\n"",\n, and on",x,,,,,,,\n' for i in range(700))
    check_scan(spark, workdir, {
        "good": body, "empty": "", "bare": body + 'x,a"b"c,y\n' + body, "behind": body + '"a"x,"b"\n' + body,
        "open": body + '"a,b\n', "inside": body + '"a\nb"c,"d\ne"\n' + body, "plain": "a,b\n" * 2000,
        "crlf": body.replace("\n", "\r\n")})


def test_malformed_shift_jis_is_replaced(spark, workdir):
    p = f"{workdir}/cf.csv"
    with open(p, "wb") as f:
        f.write(",2024/07/01,ソ".encode("shift_jis") + b"\x81\xff" + ",-1,i,l,m,,,\n".encode())
    (row,) = scan_ledger_csv(spark, [p], "sjis").collect()
    assert row.name.startswith("ソ�") and row._corrupt is None


def plans_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_scan_is_one_text_pass_without_a_shuffle_of_lines(spark, workdir):
    p = write(f"{workdir}/cf.csv", "".join(ROW.format(1, f"n{i}") for i in range(50)))
    plan = plans_of(scan_ledger_csv(spark, [p]))
    assert "FileScan text" not in plan and "Exchange hashpartitioning" not in plan  # the lines were written once
    p2 = write(f"{workdir}/cf2.csv", ROW.format(1, '"a\nb"'))
    plan = plans_of(scan_ledger_csv(spark, [p2]))
    assert plan.count("Exchange hashpartitioning") == 1  # lines of records that span several, by record
