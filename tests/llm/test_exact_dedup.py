import hashlib
import re
from collections import defaultdict

from pyspark.sql import functions as F

from tally.llm.exact_dedup import exact_classes, exact_dedup

ROWS = [(1, "a  b", "x"), (2, "a b", "y"), (3, "a\tb", "x"), (4, "a b ", "x"), (5, None, "x"), (6, "", None),
        (7, " ", "x"), (8, "c", "x"), (8, "c", "x"), (8, "c", "w"), (None, "d", "x"), (None, "d", "x"), (9, "d", "q"),
        (None, "e", "q"), (None, "e", "q"), (10, "z" * 200_000, "x"), (11, "z" * 200_000, "y")]


def frame(spark, rows=ROWS):
    return (spark.createDataFrame(rows, "doc_id long, text string, size string").repartition(3)
            .withColumn("kept", F.lit("clash")).withColumn("h", F.lit("clash")))


def expected(rows):
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups = defaultdict(list)
    for i, t, _ in rows:
        groups[norm(t)].append(i)
    out = []
    for t, ids in groups.items():
        keep = min((i for i in ids if i is not None), default=None)
        sha, first = hashlib.sha256(t.encode()).hexdigest(), True
        for i in ids:
            kept = i == keep and first
            first = first and not kept
            out.append((str(i), str(keep), len(ids), kept, sha))
    return sorted(out)


def got(df):
    return sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.kept, r.text_sha256) for r in df.collect())


def test_classes(spark):
    assert got(exact_classes(frame(spark))) == expected(ROWS)


def test_collisions_are_split_by_bytes(spark):
    weak = lambda c: F.encode(F.substring(F.md5(c), 1, 1), "utf-8")
    rows = ROWS + [(100 + i, f"t{i % 40}", "x") for i in range(120)]
    assert got(exact_classes(frame(spark, rows), hash_fn=weak)) == expected(rows)
    kept = exact_dedup(frame(spark, rows), hash_fn=weak)
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(x[1] for x in expected(rows) if x[3])


def test_rows_that_stay_keep_their_columns(spark):
    docs = frame(spark)
    kept = exact_dedup(docs)
    assert kept.columns == docs.columns
    rows = kept.collect()
    assert sorted(str(r.doc_id) for r in rows) == sorted(x[1] for x in expected(ROWS) if x[3])
    assert [r["size"] for r in rows if r.doc_id == 8] == ["w"]  # ties: the smallest row


def test_empty_table(spark):
    docs = frame(spark).limit(0)
    assert exact_classes(docs).count() == 0 and exact_dedup(docs).count() == 0
