import math
import random
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tally.llm import lm_scoring
from tally.llm.lm_scoring import lm_scores


def plain(rows, least):
    texts = [(t or "").encode().split() for _, t in rows]
    c, two = Counter(w for t in texts for w in t), Counter(p for t in texts for p in zip(t, t[1:]))
    total, out = sum(c.values()), []
    for (i, _), t in zip(rows, texts):
        s = math.log(c[t[0]] / total) if t else 0.0
        for a, b in zip(t, t[1:]):
            s += math.log(two[a, b] / c[a]) if two[a, b] >= least else math.log(0.4 * c[b] / total)
        out.append((str(i), len(t), s))
    return sorted(out)


def same(docs, rows, least):
    got = sorted((str(x.doc_id), x.n_words, x.log_score) for x in lm_scores(docs, min_pairs=least).collect())
    want = plain(rows, least)
    assert [g[:2] for g in got] == [w[:2] for w in want]
    assert [g[2] for g in got] == pytest.approx([w[2] for w in want], rel=1e-9, abs=1e-6)


@pytest.mark.parametrize("least", [1, 2, 3])
@pytest.mark.parametrize("short,frequent,bits", [(1 << 18, 1 << 18, 27), (3, 1, 27), (0, 0, 15)])
def test_scores(spark, monkeypatch, short, frequent, bits, least):
    """No word or pair is too rare, and the aids change no score."""
    for name, value in {"SHORT_IDS": short, "FREQUENT_PAIRS": frequent, "FILTER_BITS": bits}.items():
        monkeypatch.setattr(lm_scoring, name, value)
    r = random.Random(1)
    vocab = ["the", "of", "É", "a.", *(f"w{i}" for i in range(60))]
    rows = [(i, " ".join(r.choices(vocab, k=r.choice([0, 1, 2, 30, 90]), weights=[40, 30, 9, 9] + [1] * 60))) for i in range(80)]
    rows += [(None, "the of"), (None, None), (3, "same the of"), (3, "same the of"), (500, "the of " * 20_000),
             (600, " \n\tonce  only\x0bhere\x0c "), (601, "a　b a　b"), (602, "")]
    docs = (spark.createDataFrame(rows, "doc_id long, text string").repartition(3).withColumn("key", F.lit("clash"))
            .withColumn("uid", F.lit(1)).withColumn("x", F.lit(2)))
    same(docs, rows, least)


def test_empty_table(spark):
    assert lm_scores(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    (row,) = lm_scores(spark.createDataFrame([(1, None)], "doc_id long, text string")).collect()
    assert (row.n_words, row.log_score, row.mean_log_score) == (0, 0.0, 0.0)


def test_long_texts_in_blocks(monkeypatch):
    """Blocks of a text give its words once and all its pairs."""
    r = random.Random(2)
    texts = [" ".join(r.choices("ab cde fgh i jklmnopqr é stuvwxyz　z".split(" "), k=n)) + r.choice(["", " ", "\n\n"])
             for n in (0, 3, 50, 400, 1)] + [None, "x" * 300, " " * 200 + "y", "p q"]
    column = pa.array(texts)

    def facts():
        words, two = Counter(), Counter()
        for w in lm_scoring._words(column):
            starts = lm_scoring._starts(w)
            for j in range(len(w.at)):
                row = int(w.row[w.text[j]])
                if not starts[j] or w.first_block[w.text[j]]:
                    words[row, int(w.hashes[w.at[j]])] += 1
                if w.next_is_own[j]:
                    two[row, int(w.hashes[w.at[j]]), int(w.hashes[w.at[j + 1]])] += 1
        return words, two

    whole = facts()
    monkeypatch.setattr(lm_scoring, "CALL", 64)
    assert facts() == whole
    assert sum(whole[0].values()) == sum(len((t or "").encode().split()) for t in texts)


def test_no_row_of_the_vocabulary_in_the_plan(spark):
    rows = [(i, f"the w{i} of w{i % 3}") for i in range(50)]
    plan = lm_scores(spark.createDataFrame(rows, "doc_id long, text string").repartition(2))._jdf.queryExecution().toString()
    assert "LocalTableScan" not in plan.split("== Physical Plan ==")[1].split("MapInArrow")[0] and "LeftAnti" not in plan


def test_words_hashed_together(monkeypatch):
    """The XXH64 of the library, with no call of it for a word of under 32 bytes."""
    import xxhash
    plain, calls = xxhash.xxh64_intdigest, []
    monkeypatch.setattr(xxhash, "xxh64_intdigest", lambda w: calls.append(bytes(w)) or plain(w))
    r = random.Random(3)
    texts = [" ".join("".join(r.choices("abcé　z9😀", k=k)) for k in range(1, 60) for _ in range(5)),
             None, "x" * 31 + " " + "y" * 32 + " " + "z" * 100_000, "", "é"]
    words = {w for t in texts for w in (t or "").encode().split()}
    got = {int(h) for w in lm_scoring._words(pa.array(texts)) for h in w.hashes}
    assert got == {-1 - (plain(w) >> 1) for w in words}
    assert sorted(calls) == sorted(w for w in words if len(w) >= 32)
