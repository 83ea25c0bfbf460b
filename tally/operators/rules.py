"""Rule dictionary and classification.

Precedence: name exact > name contains > m_category exact > m_category
contains > transit (C6) > none. Among several substring hits the rule with
the lowest id wins (deterministic; the source leaves it undefined).

Exact rules are an equi-join on (field value) against the deduplicated
dictionary (unique per value, so no row is multiplied); Spark broadcasts the
dictionary when its measured size is small.

Substring rules have two exact strategies:

* ``array``: the substring rules travel as one sorted array row (broadcast,
  one row) and each ledger row runs ``filter(rules, r -> contains(...))``.
  No shuffle; cost per row grows with the number of substring rules, so it
  is used only up to ``max_array_rules``.
* ``join``: the distinct texts of both fields are matched first. Each
  substring rule is filed under its rarest gram of three characters; a text
  emits its distinct grams once, meets the rules filed under them, and is
  verified with ``contains``; the lowest rule id per text is kept with min_by
  (partial aggregation). What a text emits depends on its length alone, not on
  the rules' number or lengths. Exact rules join the same distinct texts, so
  the rows are joined once per field.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.parse import TRANSIT_CATEGORY, contains, exact_flag, is_transit
from ..session import stage

FIELDS = ("name", "m_category")
MAX_ARRAY_RULES = 512


class InvalidRuleError(ValueError):
    pass


def validate_rules(rules: DataFrame) -> DataFrame:
    """adds ``valid`` (field_name is ``name`` or ``m_category``)."""
    return rules.withColumn("valid", F.coalesce(F.col("field_name").isin(list(FIELDS)), F.lit(False)))


def check_rules(rules: DataFrame, on_invalid: str = "abort") -> DataFrame:
    """F11 policy. ``abort`` raises (naming the offending ids) when any rule
    has an unknown field, as the source stops the whole classification run;
    ``skip`` drops such rules."""
    v = validate_rules(rules)
    if on_invalid == "skip":
        return v.filter("valid").drop("valid")
    if on_invalid != "abort":
        raise ValueError(f"unknown on_invalid {on_invalid!r}")
    bad = v.filter(~F.col("valid"))
    n = bad.count()
    if n:
        first = [r["id"] for r in bad.select("id").orderBy("id").limit(20).collect()]
        more = f" and {n - len(first)} more" if n > len(first) else ""
        raise InvalidRuleError(f"unknown field name in {n} rules: {first}{more}")
    return v.drop("valid")


def rule_dictionary(rules: DataFrame) -> DataFrame:
    """A4: one entry per (field_name, exact, value); a later rule (higher id)
    overwrites an earlier one. Output: field_name, exact (bool), value,
    category_id, rule_id."""
    return (rules.withColumn("exact", exact_flag(F.col("exact_match")))
            .withColumn("value", F.coalesce(F.col("value"), F.lit("")))
            .groupBy("field_name", "exact", "value")
            .agg(F.max_by(F.struct(F.col("category_id"), F.col("id")), F.col("id")).alias("_w"))
            .select("field_name", "exact", "value",
                    F.col("_w.category_id").alias("category_id"),
                    F.col("_w.id").alias("rule_id")))


def _exact_match(rows: DataFrame, dictionary: DataFrame, field: str, out: str) -> DataFrame:
    d = (dictionary.filter((F.col("field_name") == field) & F.col("exact"))
         .select(F.col("value").alias(f"_v_{out}"), F.col("category_id").alias(out)))
    return rows.join(d, rows[field] == d[f"_v_{out}"], "left").drop(f"_v_{out}")


def _contains_array(rows: DataFrame, dictionary: DataFrame, field: str, out: str) -> DataFrame:
    # a scalar subquery: evaluated once, shipped to every task as a value
    arr = (dictionary.filter((F.col("field_name") == field) & ~F.col("exact"))
           .agg(F.sort_array(F.collect_list(F.struct(F.col("rule_id"), F.col("value"), F.col("category_id")))))
           .scalar())  # exactly one row, even with no rules
    hits = F.filter(F.col(f"_rs_{out}"), lambda r: contains(F.col(field), r["value"]))
    return (rows.withColumn(f"_rs_{out}", arr)
            .withColumn(out, F.try_element_at(hits, F.lit(1))["category_id"])
            .drop(f"_rs_{out}"))


#: Characters of the grams by which substring rules are filed.
GRAM = 3


def _grams(text: str, sizes: Column) -> Column:
    """Distinct grams of each size of a text column."""
    def of_size(n: Column) -> Column:
        starts = F.when(F.length(text) >= n, F.sequence(F.lit(1), F.length(text) - n + 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.substring(text, i, n))
    return F.array_distinct(F.flatten(F.transform(sizes, of_size)))


def anchors(texts: DataFrame, part: DataFrame, sizes: Column) -> DataFrame:
    """(field, gram, value, rule_id, category_id): each substring rule under
    its gram that the fewest texts hold. A rule with a gram that no text holds
    matches none and is left out. Rules shorter than GRAM are their own gram."""
    size = F.least(F.length("value"), F.lit(GRAM))
    own = part.withColumn("grams", _grams("value", F.array(size)))
    filed = own.select("field", "value", "rule_id", "category_id", F.size("grams").alias("n_grams"), F.explode("grams").alias("gram"))
    held = (texts.select("field", F.explode(_grams("text", sizes)).alias("gram"))
            .join(filed.select("field", "gram").distinct(), ["field", "gram"], "left_semi")
            .groupBy("field", "gram").agg(F.count(F.lit(1)).alias("texts")))
    best = (filed.join(held, ["field", "gram"]).groupBy("field", "value", "rule_id", "category_id", "n_grams")
            .agg(F.min_by("gram", F.struct("texts", "gram")).alias("gram"), F.count(F.lit(1)).alias("found")))
    return best.filter(F.col("found") == F.col("n_grams")).select("field", "gram", "value", "rule_id", "category_id")


def _match_texts(rows: DataFrame, dictionary: DataFrame) -> DataFrame:
    """(field, text, exact_category, contains_category) of every distinct text
    of both fields that some rule matches. A text emits its grams of up to
    three sizes once, whatever the rules' lengths; those that are some rule's
    anchor are verified with ``contains``."""
    texts = stage(rows.select(F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("text")) for f in FIELDS]))
                              .alias("t")).select("t.*").distinct(), "texts")
    exact = dictionary.filter("exact").select(F.col("field_name").alias("field"), F.col("value").alias("text"),
                                              F.col("category_id").alias("exact_category"))
    part = dictionary.filter(~F.col("exact")).select(F.col("field_name").alias("field"), "value", "rule_id", "category_id")
    sizes = part.filter("value <> ''").agg(F.collect_set(F.least(F.length("value"), F.lit(GRAM)))).scalar()  # three at most
    texts = texts.withColumn("sizes", sizes)
    filed = stage(anchors(texts, part.filter("value <> ''"), F.col("sizes")), "anchors")
    found = (texts.select("field", "text", F.explode(_grams("text", F.col("sizes"))).alias("gram"))
             .join(filed, ["field", "gram"]).filter(contains(F.col("text"), F.col("value")))
             .select("field", "text", "rule_id", "category_id"))
    always = part.filter("value = ''").select("field", "rule_id", "category_id")  # the empty value, one rule a field
    found = found.unionByName(texts.select("field", "text").join(F.broadcast(always), "field").select(*found.columns))
    hits = found.groupBy("field", "text").agg(F.min_by("category_id", "rule_id").alias("contains_category"))
    return (texts.drop("sizes").join(exact, ["field", "text"], "left").join(hits, ["field", "text"], "left")
            .filter(F.col("exact_category").isNotNull() | F.col("contains_category").isNotNull()))


def _join_matches(rows: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Join strategy: the matched texts come back with one join per field."""
    matched = stage(_match_texts(rows, dictionary), "matched")
    for field, exact, part in (("name", "_c1", "_c2"), ("m_category", "_c3", "_c4")):
        m = matched.filter(F.col("field") == field).select(F.col("text").alias("_t"), F.col("exact_category").alias(exact),
                                                           F.col("contains_category").alias(part))
        rows = rows.join(m, rows[field] == m["_t"], "left").drop("_t")
    return rows


def classify(rows: DataFrame, rules: DataFrame, row_id: str = "id",
             strategy: str = "auto", max_array_rules: int = MAX_ARRAY_RULES,
             on_invalid: str = "abort", with_transit: bool = True) -> DataFrame:
    """M8: adds ``category_id`` (NULL = not selected) and ``matched_by``.

    ``rows`` needs ``name``, ``m_category``, ``fin_ins`` and a unique
    ``row_id``. ``rules`` has the extract_rule columns."""
    checked = check_rules(rules, on_invalid)
    dictionary = stage(rule_dictionary(checked), "rules")  # written once, read by every branch
    if strategy == "auto":
        n_partial = dictionary.filter(~F.col("exact")).count()  # small table
        strategy = "array" if n_partial <= max_array_rules else "join"
    out = rows.withColumn("name", F.coalesce(F.col("name"), F.lit(""))) \
              .withColumn("m_category", F.coalesce(F.col("m_category"), F.lit("")))
    if strategy == "array":
        out = _exact_match(out, dictionary, "name", "_c1")
        out = _exact_match(out, dictionary, "m_category", "_c3")
        out = _contains_array(out, dictionary, "name", "_c2")
        out = _contains_array(out, dictionary, "m_category", "_c4")
    else:
        out = _join_matches(out, dictionary)
    transit = is_transit(F.col("name"), F.col("fin_ins")) if with_transit else F.lit(False)
    matched: Column = (F.when(F.col("_c1").isNotNull(), F.lit("name_exact"))
                       .when(F.col("_c2").isNotNull(), F.lit("name_contains"))
                       .when(F.col("_c3").isNotNull(), F.lit("m_category_exact"))
                       .when(F.col("_c4").isNotNull(), F.lit("m_category_contains"))
                       .when(transit, F.lit("transit")))
    category = F.coalesce(F.col("_c1"), F.col("_c2"), F.col("_c3"), F.col("_c4"),
                          F.when(transit, F.lit(TRANSIT_CATEGORY).cast("long")))
    return (out.withColumn("category_id", category.cast("long"))
            .withColumn("matched_by", matched)
            .drop("_c1", "_c2", "_c3", "_c4"))
