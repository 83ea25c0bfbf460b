"""Property tests: the Column parsers against a plain-Python model of the
source's integer and date rules, on random text."""

import datetime as dt
import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tally.functions import parse as P

ALPHABET = "0123456789,-+\"a /"


def model_unsigned(raw: str):
    s = raw.replace(",", "").replace("-", "").replace('"', "")
    if not re.fullmatch(r"\+?[0-9]+", s):
        return None
    v = int(s)
    return v if v <= 2**31 - 1 else None


def model_signed(raw: str):
    s = raw.replace(",", "").replace('"', "")
    if not re.fullmatch(r"[+-]?[0-9]+", s):
        return None
    v = int(s)
    return v if -(2**31) <= v <= 2**31 - 1 else None


def model_date(raw: str):
    if not re.fullmatch(r"[0-9]{4}/[0-9]{2}/[0-9]{2}", raw):
        return None
    try:
        return dt.datetime.strptime(raw, "%Y/%m/%d").date()
    except ValueError:
        return None


def run(spark, fn, values):
    df = spark.createDataFrame([(v,) for v in values], "x string")
    return [r[0] for r in df.select(fn(F.col("x"))).collect()]


texts = st.lists(st.text(alphabet=ALPHABET, max_size=14), min_size=1, max_size=60)
dates = st.lists(st.builds(lambda y, m, d: f"{y:04d}/{m:02d}/{d:02d}",
                           st.integers(1000, 9999), st.integers(0, 13), st.integers(0, 32)),
                 min_size=1, max_size=60)


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(values=texts)
def test_unsigned_price_model(spark, values):
    assert run(spark, P.unsigned_price, values) == [model_unsigned(v) for v in values]


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(values=texts)
def test_signed_amount_model(spark, values):
    assert run(spark, P.signed_amount, values) == [model_signed(v) for v in values]


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(values=dates)
def test_ledger_date_model(spark, values):
    assert run(spark, P.ledger_date, values) == [model_date(v) for v in values]
