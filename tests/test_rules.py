"""Rule dictionary, classification precedence, full classify run, status."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from conftest import write
from tally.operators import rules as R, status as S, views
from tally.plans.classify import classify_pending, outbox_json, reset_details
from tally.plans.importer import import_ledger
from tally.schemas import EXTRACT_RULE
from tally.sources.store import LedgerStore

RULES = [  # the reference's precedence fixture
    (1, "name", "かんぜんいっち", 1, 100),
    (2, "name", "ぶぶんめい", 0, 200),
    (3, "m_category", "かんぜんいっち", 1, 300),
    (4, "m_category", "ぶぶんめい", 0, 400),
]


def rules_df(spark, rows):
    return spark.createDataFrame([(i, f, v, e, c, None, None) for i, f, v, e, c in rows], EXTRACT_RULE)


def rows_df(spark, rows):
    return spark.createDataFrame(rows, "id long, name string, m_category string, fin_ins string")


@pytest.mark.parametrize("strategy", ["array", "join"])
def test_precedence(spark, strategy):
    rows = rows_df(spark, [
        (1, "かんぜんいっち", "", "x"), (2, "ねーむぶぶんめい", "", "x"), (3, "", "かんぜんいっち", "x"),
        (4, "", "AAAぶぶんめいかてごりー", "x"), (5, "のっとふぁうんど", "のっとふぁうんど", "x"),
        (6, "入 東京 出 大阪", "", "モバイルSuica"), (7, "かんぜんいっち", "かんぜんいっち", "モバイルSuica")])
    got = {r.id: (r.category_id, r.matched_by) for r in
           R.classify(rows, rules_df(spark, RULES), strategy=strategy).collect()}
    assert got == {1: (100, "name_exact"), 2: (200, "name_contains"), 3: (300, "m_category_exact"),
                   4: (400, "m_category_contains"), 5: (None, None), 6: (270, "transit"),
                   7: (100, "name_exact")}


@pytest.mark.parametrize("strategy", ["array", "join"])
def test_several_hits_lowest_id_and_empty_value(spark, strategy):
    rules = rules_df(spark, [(10, "name", "ab", 0, 1), (5, "name", "bc", 0, 2), (7, "name", "abc", None, 3),
                             (20, "m_category", "", 0, 9)])
    rows = rows_df(spark, [(1, "xabcx", "q", ""), (2, "zzz", "anything", ""), (3, "ab", "", "")])
    got = {r.id: r.category_id for r in R.classify(rows, rules, strategy=strategy).collect()}
    # row 1: ids 5, 7, 10 all hit -> id 5; rows 2/3: the empty m_category rule matches everything
    assert got == {1: 2, 2: 9, 3: 1}


def test_dictionary_later_rule_overwrites(spark):
    rules = rules_df(spark, [(1, "name", "A", 1, 10), (2, "name", "A", 1, 20), (3, "name", "A", 0, 30),
                             (4, "name", "A", 2, 40)])
    d = {(r.exact, r.value): (r.category_id, r.rule_id) for r in R.rule_dictionary(rules).collect()}
    assert d == {(True, "A"): (20, 2), (False, "A"): (40, 4)}


def test_unknown_field_aborts_or_skips(spark):
    rules = rules_df(spark, RULES + [(9, "memo", "x", 1, 1)])
    rows = rows_df(spark, [(1, "かんぜんいっち", "", "")])
    with pytest.raises(R.InvalidRuleError):
        R.classify(rows, rules)
    assert R.classify(rows, rules, on_invalid="skip").first().category_id == 100


def test_rule_csv_sample(spark):
    rules = rules_df(spark, [(1, "m_category", "携帯電話", 1, 231), (2, "name", "WASABI", 0, 230)])
    rows = rows_df(spark, [(1, "X", "携帯電話", ""), (2, "WASABI CLOUD", "通信", ""), (3, "wasabi", "", "")])
    got = {r.id: r.category_id for r in R.classify(rows, rules).collect()}
    assert got == {1: 231, 2: 230, 3: None}


def test_empty_rules_keep_rows(spark):
    rows = rows_df(spark, [(1, "a", "b", "")])
    out = R.classify(rows, rules_df(spark, []), strategy="array").collect()
    assert len(out) == 1 and out[0].category_id is None


def _seed(spark, workdir):
    store = LedgerStore(spark, f"{workdir}/store")
    p = write(f"{workdir}/in/cf.csv",
              ",2024/07/19,かんぜんいっち,-100,x,l,,,,\n"
              ",2024/07/18,入 東京 出 大阪,-200,モバイルSuica,交通,,,,\n"
              ",2024/07/17,のっとふぁうんど,-300,x,l,のっとふぁうんど,,,\n")
    import_ledger(spark, store, [p], run_date="2024-07-20")
    store.write_rules(rules_df(spark, RULES))
    return store


def test_classify_run_outbox_status_and_reset(spark, workdir):
    store = _seed(spark, workdir)
    dry = classify_pending(spark, store, run_date="2024-07-21", dry_run=True)
    assert dry.outbox.count() == 2 and store.read("outbox").count() == 0
    res = classify_pending(spark, store, run_date="2024-07-21")
    out = {r.memo: (r.category_id, r.datetime, r.price, r.type) for r in store.read("outbox").collect()}
    assert out == {"かんぜんいっち": (100, "20240719", 100, ""), "入 東京 出 大阪": (270, "20240718", 200, "")}
    body = outbox_json(store.read("outbox")).filter("detail_id = 3").first().body
    assert body.startswith('{"category_id":100,"datetime":"20240719","price":100,"from":')
    # every pending row was judged; only the matched ones are forwarded
    det = S.with_status(store.read("detail"), store.read("detail_status"))
    st = {r.name: (r.maw_check_date, r.maw_regist_date) for r in det.collect()}
    d = dt.date(2024, 7, 21)
    assert st == {"かんぜんいっち": (d, d), "入 東京 出 大阪": (d, d), "のっとふぁうんど": (d, None)}
    # nothing pending any more: a second run forwards nothing
    assert classify_pending(spark, store, run_date="2024-07-22").outbox.count() == 0
    # reset the forwarded row -> pending again -> forwarded again under a new batch number
    rid = store.read("detail").filter(F.col("name") == "かんぜんいっち").select("id")
    reset_details(spark, store, rid, run_date="2024-07-23")
    assert S.pending(store.read("detail"), store.read("detail_status")).count() == 1
    r3 = classify_pending(spark, store, run_date="2024-07-24")
    assert r3.outbox.count() == 1 and store.read("outbox").count() == 3
    assert res.seq < r3.seq


def test_outbox_retry_is_exactly_once(spark, workdir):
    store = _seed(spark, workdir)
    r1 = classify_pending(spark, store, run_date="2024-07-21", dry_run=True)
    store.append("outbox", r1.outbox)  # a run that died after its outbox write
    classify_pending(spark, store, run_date="2024-07-21")
    assert store.read("outbox").count() == 2


def test_reset_after_a_dead_batch_sends_nothing_twice(spark, workdir):
    """A batch dies after its outbox; another row is reset; the retry runs."""
    store = _seed(spark, workdir)
    store.append("outbox", classify_pending(spark, store, run_date="2024-07-21", dry_run=True).outbox)
    rid = store.read("detail").filter(F.col("name") == "のっとふぁうんど").select("id")
    assert reset_details(spark, store, rid, run_date="2024-07-21") == 2
    classify_pending(spark, store, run_date="2024-07-22")
    sent = store.read("outbox").groupBy("detail_id").count().collect()
    assert sorted(r["count"] for r in sent) == [1, 1]
    assert S.pending(store.read("detail"), store.read("detail_status")).count() == 0
    # a reset of a sent row is a new judgement
    first = store.read("outbox").agg(F.min("detail_id").alias("id"))
    reset_details(spark, store, first, run_date="2024-07-23")
    classify_pending(spark, store, run_date="2024-07-24")
    assert store.read("outbox").count() == 3


def test_updated_at_follows_the_status(spark, workdir):
    store = _seed(spark, workdir)
    before = {r.id: r.updated_at for r in store.read("detail").collect()}
    classify_pending(spark, store, run_date="2024-07-21")
    after = S.with_status(store.read("detail"), store.read("detail_status")).collect()
    assert all(r.updated_at > before[r.id] for r in after)


def test_many_bad_rules_are_counted(spark):
    rules = rules_df(spark, [(i, "memo", "x", 1, 1) for i in range(1, 31)])
    with pytest.raises(R.InvalidRuleError, match="30 rules.*and 10 more"):
        R.check_rules(rules)


def test_status_views(spark, workdir):
    store = _seed(spark, workdir)
    classify_pending(spark, store, run_date="2024-07-21")
    det = S.with_status(store.read("detail"), store.read("detail_status"))
    v = views.detail_display(views.detail_view(det)).orderBy("id").collect()
    assert [r.status for r in v] == ["judged", "forwarded", "forwarded"]
    assert v[0].importDate == "" and v[1].importJudgeDate == "2024-07-21"
    page = views.page(views.detail_view(det), limit=2, offset=1).collect()
    assert [r.id for r in page] == [2, 1]
    assert views.page_count(det, 2).first().pages == 2
    assert views.row_count(det).first()["count"] == 3


def test_rule_edits(spark):
    rules = rules_df(spark, RULES)
    req = spark.createDataFrame([(0, "name", "X", 5, 1), (1, "name", "X", 5, 1)],
                                "o int, fieldName string, value string, categoryId long, exactMatch int")
    snap = S.add_rules(rules, req, order_col="o")
    assert [r.id for r in snap.orderBy("id").collect()] == [1, 2, 3, 4, 5, 6]
    left = S.delete_rules(snap, spark.createDataFrame([(2,), (99,)], "id long"))
    assert sorted(r.id for r in left.collect()) == [1, 3, 4, 5, 6]
    assert views.rule_lookup(left, 3).first().fieldName == "m_category"
    assert views.rule_lookup(left, 2).count() == 0


def test_patch_operation_and_page_clamp(spark, workdir):
    from tally.plans.classify import patch_details
    store = _seed(spark, workdir)
    with pytest.raises(ValueError):
        patch_details(spark, store, spark.createDataFrame([(1,)], "id long"), "delete")
    assert patch_details(spark, store, spark.createDataFrame([(1,)], "id long"), "reset") == 1
    assert views.page_offset(9, 20, total_pages=3) == 40 and views.page_offset(0, 20) == 0


def test_store_views_for_sql(spark, workdir):
    store = _seed(spark, workdir)
    classify_pending(spark, store, run_date="2024-07-21")
    store.register_views(prefix="t_")
    got = spark.sql("SELECT count(*) AS n, count(maw_regist_date) AS fwd FROM t_detail_current").first()
    assert (got.n, got.fwd) == (3, 2)
    assert spark.sql("SELECT count(*) FROM t_extract_rule").first()[0] == 4


def test_auto_switches_to_join_for_many_substring_rules(spark):
    many = [(i, "name", f"w{i:04d}", 0, 1000 + i) for i in range(1, 701)]   # 700 substring rules
    many += [(900_000, "name", "w00", 0, 7)]                                  # shorter, higher id
    rules = rules_df(spark, many)
    rows = rows_df(spark, [(1, "xx w0042 yy", "", ""), (2, "w0700", "", ""), (3, "none", "", ""),
                           (4, "w00", "", "")])
    auto = {r.id: r.category_id for r in R.classify(rows, rules).collect()}
    arr = {r.id: r.category_id for r in R.classify(rows, rules, strategy="array").collect()}
    assert auto == arr == {1: 1042, 2: 1700, 3: None, 4: 7}


def test_gram_index_equals_contains(spark):
    """Rules of all lengths, overlapping grams, letters beyond the basic
    plane, and grams that many texts hold, against plain ``in``."""
    import random
    r = random.Random(6)
    text = lambda n: "".join(r.choice("abcab é漢🙂%_") for _ in range(n))
    texts = [(i, text(r.randrange(0, 25)), text(r.randrange(0, 6)), "") for i in range(300)]
    texts += [(900, "aaaaaaaa", "", ""), (901, "", "", ""), (902, None, "abc", "")]
    values = {(f, text(r.choice([1, 2, 3, 4, 5, 8]))) for f in ("name", "m_category") for _ in range(40)} | {("name", "aaaa"), ("name", "zzz")}
    rules = [(k + 1, f, v, 0, 1000 + k) for k, (f, v) in enumerate(sorted(values))]
    rows = spark.createDataFrame(texts, "id long, name string, m_category string, fin_ins string")
    got = {x.id: x.category_id for x in R.classify(rows, rules_df(spark, rules), strategy="join", with_transit=False).collect()}

    def first(field, value):
        return min(((i, c) for i, f, v, _, c in rules if f == field and v in (value or "")), default=(0, None))[1]

    assert got == {i: first("name", n) if first("name", n) is not None else first("m_category", m) for i, n, m, _ in texts}


def test_grams_do_not_follow_the_rules_lengths(spark):
    texts = spark.createDataFrame([("name", "abcdefghijklmnopqrstuvwxyz")], "field string, text string")
    grams = lambda sizes: len(texts.select(R._grams("text", F.array(*[F.lit(s) for s in sizes]))).first()[0])
    assert grams([3]) == 24 and grams([1, 2, 3]) == 75
    part = spark.createDataFrame([("name", "abcdefghijkl", 1, 1), ("name", "qrstuv", 2, 2), ("name", "xyz!", 3, 3), ("name", "zz", 4, 4)],
                                 "field string, value string, rule_id long, category_id long")
    filed = R.anchors(texts.unionByName(texts.selectExpr("field", "'abcdefgh qrs' AS text")), part, F.array(F.lit(2), F.lit(3))).collect()
    assert {x.rule_id for x in filed} == {1, 2}  # the others have a gram that no text holds
    rare = {x.rule_id: x.gram for x in filed}
    assert rare[1] in {"ghi", "hij", "ijk", "jkl"} and rare[2] in {"rst", "stu", "tuv"}
