import hashlib
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tally.llm import mixing
from tally.llm.mixing import mix, mixture

ROWS = [(i, " ".join(["w"] * (1 + i * 7 % 23)), ["b", "a", None, "c", "é", "a"][i % 6]) for i in range(300)]
ROWS += [(None, "x y", "a"), (None, None, "a"), (5, "", "b"), (7, "same  row", "c"), (7, "same  row", "c"),
         (900, "w " * 30_000, "big"), (901, None, "nothing"), (902, " \t ", "nothing")]


def frame(spark, rows=ROWS):
    return (spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
            .withColumn("size", F.lit("clash")).withColumn("key", F.lit(1)).withColumn("copies", F.lit(2)))


def size(t):
    return len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))


def targets(rows, weights=(3, 1, 2)):
    """Share by weight, cap, share the excess again, as the words say."""
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += size(t)
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    left, open_, out = 1.5 * sum(sizes.values()), set(names), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] >= 2 * sizes[s]}
        if not full:
            return sizes, out | {s: level * weight[s] for s in open_}
        out |= {s: 2.0 * sizes[s] for s in full}
        left -= sum(2 * sizes[s] for s in full)
        open_ -= full
    return sizes, out


@pytest.mark.parametrize("range_rows", [20_000, 3])
def test_mixture(spark, monkeypatch, range_rows):
    monkeypatch.setattr(mixing, "RANGE_ROWS", range_rows)  # the ranges change the plan, not the result
    sizes, target = targets(ROWS)
    key = lambda i, t: hashlib.md5(f"42:{'' if i is None else i}:{hashlib.md5((t or '').encode()).hexdigest()}".encode()).hexdigest()
    by = defaultdict(list)
    for i, t, s in ROWS:
        by[s].append((key(i, t), i if i is not None else -1, size(t)))
    want = []
    for s, docs in by.items():
        budget, before = int(target[s] + 0.5), 0
        for _, i, n in sorted(docs):
            taken = 0 if not sizes[s] else budget // sizes[s] * n + max(0, min(n, budget % sizes[s] - before))
            before += n
            want.append((str(i), n, sizes[s], round(target[s], 4), taken))
    rows = mixture(frame(spark)).collect()
    got = [(str(-1 if r.doc_id is None else r.doc_id), r["size"], r.source_size, round(r.target, 4), r.taken) for r in rows]
    assert sorted(got) == sorted(want)
    assert all(r.taken <= 2 * r["size"] for r in rows)
    assert rows and sum(r.taken for r in rows) == pytest.approx(1.5 * sum(sizes.values()), abs=len(sizes))


def test_mix_repeats_whole_documents(spark):
    docs = frame(spark)
    out = mix(docs)
    assert out.columns == docs.columns
    sizes, target = targets(ROWS)
    words, texts = Counter(), {(i, t, s) for i, t, s in ROWS}
    for r in out.collect():
        assert (r.doc_id, r.text, r.source) in texts
        words[r.source] += size(r.text)
    for s, n in target.items():
        largest = max(size(t) for _, t, x in ROWS if x == s)
        assert abs(words[s] - n) <= largest, s
    assert sorted(map(str, out.collect())) == sorted(map(str, mix(docs.repartition(5)).collect()))


def test_empty(spark):
    assert mixture(frame(spark).limit(0)).count() == 0 and mix(frame(spark).limit(0)).count() == 0
