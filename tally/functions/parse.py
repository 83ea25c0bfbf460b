"""Scalar Column -> Column functions (parsers, predicates, formatters).

All are built-in Spark expressions, so they stay inside whole-stage codegen.
A parser returns NULL for a value it rejects; callers turn NULL into a reject.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import RULE_REQUEST

__all__ = [
    "INT32_MAX", "INT32_MIN", "TRANSIT_FIN_INS", "TRANSIT_IN_MARK", "TRANSIT_OUT_MARK",
    "TRANSIT_CATEGORY", "MONTH_END_SUFFIX", "ledger_date", "unsigned_price", "signed_amount",
    "month_end_date", "iso_date", "asset_date", "is_transit", "contains", "compact_date", "day",
    "basename", "exact_flag", "epoch_seconds", "display_stamp", "thousands", "to_json_record",
    "parse_rule_request",
]

INT32_MAX = 2147483647
INT32_MIN = -2147483648

# Transit-card institution spellings, marks and category.
TRANSIT_FIN_INS = [
    "モバイルSuica",
    "モバイルSuica (モバイルSuica ID)",
    "モバイルSuica（モバイルSuica ID）",
]
TRANSIT_IN_MARK = "入"
TRANSIT_OUT_MARK = "出"
TRANSIT_CATEGORY = 270
MONTH_END_SUFFIX = "月末"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def ledger_date(raw) -> Column:
    """Strict ``yyyy/MM/dd`` (zero padded, valid calendar day) -> date."""
    raw = _c(raw)
    return F.when(raw.rlike(r"^\d{4}/\d{2}/\d{2}\z"),
                  F.try_to_date(raw, "yyyy/MM/dd"))


def unsigned_price(raw) -> Column:
    """Drop every ``,`` ``-`` ``"`` and parse an integer; sign is lost on
    purpose. Values beyond the 32-bit column range are rejects."""
    s = F.translate(_c(raw), ',-"', "")
    v = s.try_cast("bigint")
    return F.when(s.rlike(r"^\+?\d+\z") & (v <= F.lit(INT32_MAX)), v)


def signed_amount(raw) -> Column:
    """Drop ``,`` and ``"`` and parse a signed integer."""
    s = F.translate(_c(raw), ',"', "")
    v = s.try_cast("bigint")
    return F.when(s.rlike(r"^[+-]?\d+\z") & v.between(INT32_MIN, INT32_MAX), v)


def month_end_date(raw) -> Column:
    """C4: ``YYYY-MM月末`` -> last day of that month. The month is not range
    checked: 13 rolls into January of the next year, 00 into December of the
    previous one."""
    raw = _c(raw)
    pat = r"^(\d{4})-(\d{2})" + MONTH_END_SUFFIX + r"\z"
    y = F.regexp_extract(raw, pat, 1).cast("int")
    m = F.regexp_extract(raw, pat, 2).cast("int")
    return F.when(raw.rlike(pat),
                  F.date_sub(F.add_months(F.make_date(y, F.lit(1), F.lit(1)), m), 1))


def iso_date(raw) -> Column:
    """Strict ``yyyy-MM-dd``."""
    raw = _c(raw)
    return F.when(raw.rlike(r"^\d{4}-\d{2}-\d{2}\z"),
                  F.try_to_date(raw, "yyyy-MM-dd"))


def asset_date(raw) -> Column:
    """C4 then C5: month-end notation first, ISO date otherwise."""
    return F.coalesce(month_end_date(raw), iso_date(raw))


def is_transit(name, fin_ins) -> Column:
    """Institution is one of the transit spellings and the first entry
    mark comes strictly before the first exit mark."""
    name, fin_ins = _c(name), _c(fin_ins)
    i_in = F.instr(name, TRANSIT_IN_MARK)
    i_out = F.instr(name, TRANSIT_OUT_MARK)
    return (F.coalesce(fin_ins.isin(TRANSIT_FIN_INS), F.lit(False))
            & (i_in > 0) & (i_out > i_in))


def contains(text, needle) -> Column:
    """Case- and width-sensitive substring test; empty needle matches."""
    return F.contains(_c(text), _c(needle))


def compact_date(d) -> Column:
    """``yyyyMMdd``."""
    return F.date_format(_c(d), "yyyyMMdd")


def day(ts) -> Column:
    """Drop the time part."""
    return F.to_date(_c(ts))


def basename(path) -> Column:
    """Last path segment."""
    return F.element_at(F.split(_c(path), "/"), -1)


def exact_flag(x) -> Column:
    """C11: only 1 means exact; NULL reads as 0."""
    return F.coalesce(_c(x), F.lit(0)) == F.lit(1)


def epoch_seconds(ts) -> Column:
    """C12."""
    return F.unix_timestamp(_c(ts))


def display_stamp(x) -> Column:
    """First 19 characters of the text form, missing -> ''."""
    return F.coalesce(F.substring(_c(x).cast("string"), 1, 19), F.lit(""))


def thousands(x) -> Column:
    """C14: thousands separators."""
    return F.format_number(_c(x), 0)


def to_json_record(*cols) -> Column:
    """JSON object; NULL fields are omitted."""
    return F.to_json(F.struct(*cols))


def parse_rule_request(js) -> Column:
    """JSON rule request -> struct. A missing or null field reads as its
    zero value; malformed input, anything but an object, and a field of the
    wrong type (text for a number, a fraction for an integer) give NULL."""
    doc = F.try_parse_json(_c(js))
    kind = lambda f: F.coalesce(F.schema_of_variant(F.try_variant_get(doc, f"$.{f}", "variant")), F.lit("VOID"))
    zero = {"string": ("STRING", ""), "bigint": ("BIGINT", 0), "int": ("BIGINT", 0)}
    fields, fits = [], F.schema_of_variant(doc).startswith("OBJECT")
    for f in RULE_REQUEST.fields:
        kind_name = f.dataType.simpleString()
        want, empty = zero[kind_name]
        fits = fits & kind(f.name).isin(want, "VOID")
        value = F.try_variant_get(doc, f"$.{f.name}", kind_name)
        fields.append(F.coalesce(value, F.lit(empty).cast(f.dataType)).alias(f.name))
    return F.when(fits, F.struct(*fields))
