"""Key index: no stored key is missed, few others are kept, and a drop beyond
the broadcast bound exchanges no stored row that cannot match."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from conftest import write
from tally.operators import dedup, key_index as K
from tally.plans.importer import import_ledger
from tally.sources.store import LedgerStore, month_key

KEY = dedup.LEDGER_KEY


def keys(spark, lo, hi):
    day = F.date_add(F.lit(dt.date(2024, 1, 1)), (F.col("id") % 90).cast("int"))
    return spark.range(lo, hi).select(day.alias("date"), F.concat(F.lit("n"), F.col("id")).alias("name"),
                                      (F.col("id") % 7).alias("price")).withColumn("ym", month_key(F.col("date")))


def test_every_stored_key_is_possible_and_few_others(spark):
    """Appends of one month unite on a level, and a grown month moves on."""
    index = None
    for lo, hi in ((0, 900), (900, 1000), (1000, 9000)):
        rows = keys(spark, lo, hi)
        months = {r[0]: r[1] for r in keys(spark, 0, hi).groupBy("ym").count().collect()}
        part = K.index_rows(rows, KEY, {m: K.level(n) for m, n in months.items()})
        index = part if index is None else index.unionByName(part)
    index = index.cache()
    assert index.select("bits").distinct().count() == 2
    maybe = K.possible_hits(keys(spark, 0, 20000), index, KEY)
    stored = keys(spark, 0, 9000)
    assert stored.join(maybe, KEY, "left_anti").isEmpty()
    others = maybe.join(stored, KEY, "left_anti").count()
    assert 0 < others < 11000 * 3 / K.BITS_PER_KEY
    assert K.possible_hits(keys(spark, 0, 100).withColumn("ym", F.lit(209901)), index, KEY).isEmpty()
    index.unpersist()


def test_sifted_rows_hold_all_matches(spark):
    stored, hits = keys(spark, 0, 20000), keys(spark, 5000, 6000)
    out = K.sifted(stored, hits, 1000, KEY)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert hits.join(out, KEY, "left_anti").isEmpty() and out.count() < 1000 + 19000 / 8
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_levels():
    assert K.level(0) == K.LEAST_BITS and K.level(512) == 15 and K.level(513) == 16 and K.level(1 << 50) == K.MOST_BITS


ROW = ",2024/{:02d}/{:02d},N{},-{},i,l,m,,,\n"


def drop(n, lo=0):
    return "".join(ROW.format(i % 3 + 1, i % 28 + 1, i, i) for i in range(lo, n))


@pytest.mark.parametrize("bound", [0, 50, 10 ** 6])
def test_imports_by_index_equal_the_plain_join(spark, workdir, bound):
    store = LedgerStore(spark, f"{workdir}/store")
    a, b = write(f"{workdir}/a/cf.csv", drop(200)), write(f"{workdir}/b/cf.csv", drop(300, 100) + drop(300, 250))
    import_ledger(spark, store, [a], index_above=bound)
    dry = import_ledger(spark, store, [b], index_above=bound, dry_run=True)
    assert dry.inserted.count() == 150 and dry.duplicates.count() == 100
    res = import_ledger(spark, store, [b], index_above=bound)
    assert sorted(r.name for r in res.inserted.collect()) == sorted(f"N{i}" for i in range(200, 300))
    assert sorted(r.name for r in res.duplicates.collect()) == sorted(f"N{i}" for i in range(100, 200))
    assert [r.id for r in store.read("detail").orderBy("id").collect()] == list(range(1, 301))


def test_a_drop_without_possible_hits_reads_no_stored_row(spark, workdir, monkeypatch):
    store = LedgerStore(spark, f"{workdir}/store")
    import_ledger(spark, store, [write(f"{workdir}/a/cf.csv", drop(60))])
    called = []
    monkeypatch.setattr(dedup, "stored_hits", lambda *a: called.append(1))
    monkeypatch.setattr(K, "sifted", lambda *a: called.append(1))
    new = write(f"{workdir}/b/cf.csv", "".join(f",2023/05/01,Z{i},-1,i,l,m,,,\n" for i in range(40)))
    res = import_ledger(spark, store, [new], index_above=10)
    assert res.inserted.count() == 40 and res.duplicates.count() == 0 and not called


def test_stored_rows_are_sifted_before_any_exchange(spark, workdir):
    """Plan of the exact join beyond the bound: the scan of ``detail`` reads
    three columns of the months with possible keys and meets a broadcast
    bitmap before the exchange."""
    store = LedgerStore(spark, f"{workdir}/store")
    import_ledger(spark, store, [write(f"{workdir}/a/cf.csv", drop(200))])
    maybe = K.possible_hits(keys(spark, 0, 50).unionByName(store.read("detail").select(*KEY, "ym").limit(20)),
                            store.key_index("detail"), KEY)
    own = store.read("detail").filter(F.col("ym").isin([202401])).select(*KEY)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = K.sifted(own, maybe, 100, KEY).join(maybe.select(*KEY), KEY, "left_semi")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    scan = plan.index("ReadSchema: struct<date:date,name:string,price:bigint>")
    assert "PartitionFilters: [ym" in plan or "ym#" in plan[:scan]
    upto = plan[:plan.index("/detail/")] if "/detail/" in plan else plan[:scan]
    lines = [line.strip(" :+-") for line in upto.splitlines() if any(w in line for w in ("Exchange", "BroadcastHashJoin"))]
    assert any(line.startswith("BroadcastHashJoin [bucket") for line in lines)
