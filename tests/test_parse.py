"""Scalar functions: usual values and edge cases."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tally.functions import parse as P


def one(spark, col, values):
    df = spark.createDataFrame([(v,) for v in values], "x string")
    return [r[0] for r in df.select(col(F.col("x"))).collect()]


def test_ledger_date(spark):
    got = one(spark, P.ledger_date, ["2023/11/05", "7/4(月)", "2023/1/5", "2023/02/30",
                                     "12023/11/05", "2023/11/05 ", "", None, "2020/02/29"])
    assert got == [dt.date(2023, 11, 5), None, None, None, None, None, None, None, dt.date(2020, 2, 29)]


def test_unsigned_price(spark):
    got = one(spark, P.unsigned_price, ["-48", "-5,048", "-5,x48", "+5", "", " 12", '"-6,310"',
                                        "1-2", "2147483647", "2147483648", None])
    assert got == [48, 5048, None, 5, None, None, 6310, 12, 2147483647, None, None]


def test_signed_amount(spark):
    got = one(spark, P.signed_amount, ["52", "4,000,052", '"7,111,222"', "xyz", "-9,090", "", "+3"])
    assert got == [52, 4000052, 7111222, None, -9090, None, 3]


def test_asset_date(spark):
    got = one(spark, P.asset_date, ["2023-04-09", "2023-06月末", "2020-02月末", "no day",
                                    "2023-13月末", "2023-00月末", "2023-6月末", "2023/04/09"])
    assert got == [dt.date(2023, 4, 9), dt.date(2023, 6, 30), dt.date(2020, 2, 29), None,
                   dt.date(2024, 1, 31), dt.date(2022, 12, 31), None, None]


@pytest.mark.parametrize("name,fin,expected", [
    ("入 北町 出 南浜", "モバイルSuica", True),
    ("入 AB川口 出 AB山手", "モバイルSuica (モバイルSuica ID)", True),
    ("入 みなと橋 出 もり台", "モバイルSuica（モバイルSuica ID）", True),
    ("入 北町 出 南浜", "べつのカード", False),
    ("出 北町 入 南浜", "モバイルSuica", False),
    ("売店", "モバイルSuica", False),
    ("入 北町", "モバイルSuica", False),
    ("入 北町 出 南浜", None, False),
])
def test_transit(spark, name, fin, expected):
    df = spark.createDataFrame([(name, fin)], "name string, fin_ins string")
    assert df.select(P.is_transit("name", "fin_ins")).first()[0] is expected


def test_formatters(spark):
    df = spark.createDataFrame([(dt.date(2023, 11, 5), 7654321, None)], "d date, p long, n date")
    r = df.select(P.compact_date("d"), P.thousands("p"), P.display_stamp("d"), P.display_stamp("n"),
                  P.exact_flag(F.lit(None).cast("int")), P.exact_flag(F.lit(1)), P.exact_flag(F.lit(2)),
                  P.basename(F.lit("s3a://b/in/2023/01/old.csv"))).first()
    assert tuple(r) == ("20231105", "7,654,321", "2023-11-05", "", False, True, False, "old.csv")


def test_contains_empty_needle(spark):
    df = spark.createDataFrame([("abc",)], "x string")
    assert df.select(P.contains("x", F.lit("")), P.contains("x", F.lit("B"))).first() == (True, False)


def test_rule_request_json(spark):
    df = spark.createDataFrame([('{"fieldName":"name","value":"GARDEN","categoryId":417,"exactMatch":0}',),
                                ('{"fieldName":',), ('{"fieldName":"name","value":"x"}',),
                                ('{"fieldName":"name","value":"x","categoryId":1,"exactMatch":"yes"}',),
                                ('{"fieldName":"name","value":5,"categoryId":1}',), ('{"categoryId":1.5}',), ("[1]",),
                                ('{"value":null,"categoryId":7}',), (None,)], "js string")
    rows = df.select(P.parse_rule_request("js").alias("r")).collect()
    assert rows[0].r.value == "GARDEN" and rows[0].r.categoryId == 417
    assert tuple(rows[2].r) == ("name", "x", 0, 0) and tuple(rows[7].r) == ("", "", 7, 0)
    assert all(rows[i].r is None for i in (1, 3, 4, 5, 6, 8))
