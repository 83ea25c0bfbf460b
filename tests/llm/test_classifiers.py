import math
import random

import numpy as np
from pyspark.sql import functions as F

from tally.llm import nbsvm, toxicity
from tally.llm.nbsvm import dual_coordinate_descent, indicators, quality_scores
from tally.llm.toxicity import Lexicon, best_cut, fold, toxicity_scores


def train():
    return F.crc32(F.encode(F.col("id").cast("string"), "utf-8")) % 3 != 1


def test_dual_coordinate_descent_reaches_the_optimum():
    """Against plain subgradient values: no direction lowers the objective."""
    r = np.random.default_rng(0)
    rows = [np.flatnonzero(r.random(12) < 0.4) for _ in range(60)]
    y = np.where(r.random(60) < 0.5, 1.0, -1.0)
    ratio, cost = r.normal(size=12), np.full(60, 0.7)
    w = dual_coordinate_descent(rows, y, ratio, cost, 3000, 1)
    x = np.zeros((60, 13))
    for i, own in enumerate(rows):
        x[i, own], x[i, 12] = nbsvm.unit(ratio[own]), 1
    goal = lambda v: 0.5 * v @ v + (cost * np.maximum(0, 1 - y * (x @ v))).sum()
    best = goal(w)
    assert all(goal(w + d) >= best - 1e-2 for s in (1e-1, 1e-2) for d in r.normal(size=(200, 13)) * s)


def test_indicators(monkeypatch):
    t = "some words, some words\nand lines\nand lines\n" * 30
    whole = indicators(t).tolist()
    monkeypatch.setattr(nbsvm, "BLOCK", 11)
    assert indicators(t).tolist() == whole == sorted(set(whole))
    assert not len(indicators(None)) and not len(indicators("")) and len(indicators("abc")) == 0
    big = "word " * 50_000
    assert set(indicators(big)) >= set(indicators("word word ")[:5])


def corpus(seed=4):
    r = random.Random(seed)
    word = lambda: r.choice("bcdfgh") + r.choice("aeiou") + r.choice("lmnrst") + r.choice("aeiou")
    rows, quality, toxic = [], [], []
    for i in range(400):
        w = [word() for _ in range(r.randint(30, 120))]
        bad, rude = i % 4 == 0, i % 5 == 0
        if bad:
            w = [x + r.choice(["%%", "$$"]) for x in w]
        if rude:
            for _ in range(4):
                w.insert(r.randrange(len(w)), r.choice(["Zorblax", "1dιot", "grumpf", "idïot!!"]))
        elif i % 7 == 0:
            w.insert(3, "grumpf")
            w.insert(3, "friendly")
        rows.append((i, " ".join(w)))
        if i % 10:
            quality.append((i, int(not bad)))
        toxic.append((i, int(rude)))
    return rows + [(None, None), (None, "x"), (5000, ""), (5001, "ok " * 100_000)], quality, toxic


def frame(spark, rows):
    return (spark.createDataFrame(rows, "doc_id long, text string").repartition(4).withColumn("y", F.lit("clash"))
            .withColumn("score", F.lit(1)).withColumn("low", F.lit(1)))


def accuracy(scores, truth):
    import zlib
    held = [(r.score >= 0.5) == (truth[r.doc_id] == 1) for r in scores if r.doc_id in truth and zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    return sum(held) / len(held)


def test_quality(spark):
    rows, quality, _ = corpus()
    lab = spark.createDataFrame([*quality, (1, 0), (1, 1), (None, 0)], "doc_id long, quality int")
    out = quality_scores(frame(spark, rows), lab, train()).collect()
    assert len(out) == len(rows) and all(0 <= r.score <= 1 for r in out)
    assert accuracy(out, dict(quality)) >= 0.98
    again = quality_scores(frame(spark, rows).repartition(2), lab, train()).collect()
    assert sorted((str(r.doc_id), round(r.score, 9)) for r in out) == sorted((str(r.doc_id), round(r.score, 9)) for r in again)
    one = quality_scores(frame(spark, rows), lab.filter("quality = 1"), train()).first()
    none = quality_scores(frame(spark, rows), lab.limit(0), train()).first()
    assert one.score > 0.5 and none.score == 0.5
    assert quality_scores(frame(spark, rows).limit(0), lab, train()).count() == 0


def test_toxicity(spark, monkeypatch):
    rows, _, toxic = corpus()
    monkeypatch.setattr(toxicity, "MIN_CLEAN_PHRASES", 2)
    lab = spark.createDataFrame(toxic, "doc_id long, toxic int")
    out = toxicity_scores(frame(spark, rows), lab, train()).collect()
    assert len(out) == len(rows) and all(0 <= r.score <= 1 for r in out)
    assert accuracy(out, dict(toxic)) >= 0.95
    assert [r.score for r in out if r.doc_id == 5000] == [0.0]
    assert toxicity_scores(frame(spark, rows), lab.limit(0), train()).count() == len(rows)
    assert toxicity_scores(frame(spark, rows).limit(0), lab, train()).count() == 0


def test_folding_and_exceptions(monkeypatch):
    assert fold("An 1DіOT!! ｍоrоn$ 50% naïve") == " an idiot moron 50 naïve "
    assert fold("call 455 or 7001, $5 a55 @home h3llo_w0rld 3!") == " call 455 or 7001 5 ass ahome hello world 3 "
    lex = Lexicon({" idiot ": 4.0, " idio": 2.0, " trash ": 4.0}, ["trash can"])
    assert lex.level("you idiot") == 200 and lex.level("idiots here") == 100 and lex.level("the trash can") == 0
    assert lex.level("idíot") == 400 and lex.level("") == 0 and lex.level(None) == 0
    monkeypatch.setattr(toxicity, "BLOCK", 5)
    assert Lexicon({" idiot ": 4.0}, []).level("a fine idiot of note") == 80
    assert best_cut(np.array([0.0, 1.0, 3.0, 4.0]), np.array([0, 0, 1, 1])) == 2.0


def test_blocks_change_no_level(monkeypatch):
    """Equal levels, candidates and phrases for every size of a block: entries
    and exception phrases may lie across its end, and words of any length."""
    r = random.Random(8)
    words = ["trash", "can", "idiot", "1diot", "ídiot", "id\u0456ots", "the", "7001", "pond", "scum!", "x" * 700, "sore", "loser", "é"]
    entries = {" idiot ": 4.0, " idio": 2.0, " trash ": 4.0, " scum ": 3.0, " loser ": 4.0, f" {'x' * 700} ": 1.0}
    lex = Lexicon(entries, ["trash can", "pond scum", "sore loser", f"the {'x' * 700}"])
    texts = [r.choice(["", " ", "\n"]) + r.choice([" ", "  \n", " - "]).join(r.choices(words, k=r.randrange(60))) for _ in range(40)]
    texts += ["trash can", "a" * 30 + " trash can " + "b" * 30]
    want = [(lex.level(t), [w for b in toxicity.folded_blocks(t) for w in b.folded[b.start:b.stop].split()]) for t in texts]
    assert [w for _, w in want] == [fold(t).split() for t in texts]
    for size in (1, 2, 3, 5, 8, 13, 36, 40, 100):
        monkeypatch.setattr(toxicity, "BLOCK", size)
        assert [(lex.level(t), [w for b in toxicity.folded_blocks(t) for w in b.folded[b.start:b.stop].split()])
                for t in texts] == want, size


def plain_toxicity(rows, labels, held, sample):
    """Entries, weights, exceptions, cut and scores by plain loops."""
    import math
    import re
    folded = {i: fold(t or "").split() for i, t in rows}
    y = {i: v for i, v in labels if not held(i)}
    toxic, clean, near = {}, {}, {}
    for i, v in y.items():
        own = {}
        for previous, w in zip(["", *folded[i]], folded[i]):
            for t in [f" {w} ", *(f" {w[:k]}" for k in range(4, 9) if len(w) > k)]:
                own.setdefault(t, previous)
        for t, previous in own.items():
            (toxic if v else clean)[t] = (toxic if v else clean).get(t, 0) + 1
            if v:
                near.setdefault(t, set()).add(previous)
    n = [sum(v == k for v in y.values()) for k in (0, 1)]
    entries = {f" {w} ": 4.0 for w in toxicity.SEED_WORDS}
    for t, k in toxic.items():
        c = clean.get(t, 0)
        if k >= 5 and len(near[t]) >= 4 and k >= 0.7 * (k + c):
            odds = math.log((k + 0.5) / (n[1] + 1)) - math.log((c + 0.5) / (n[0] + 1))
            if odds > 0:
                entries[t] = max(odds, entries.get(t, 0.0))

    def best(word, table):
        return max((v for t, v in table.items() if (t == f" {word} " if t.endswith(" ") else word.startswith(t[1:]))), default=0.0)

    use = {}
    for i, v in y.items():
        w, own = folded[i], set()
        for k, word in enumerate(w):
            if best(word, entries):
                own |= {f"{w[k - 1]} {word}"} if k else set()
                own |= {f"{word} {w[k + 1]}"} if k + 1 < len(w) else set()
        for p in own:
            use.setdefault(p, [0, 0])[v] += 1
    exceptions = {*toxicity.SEED_EXCEPTIONS, *(p for p, (c, t) in use.items() if t == 0 and c >= toxicity.MIN_CLEAN_PHRASES)}

    def level(w):
        covered = {k + d for k in range(len(w) - 1) if f"{w[k]} {w[k + 1]}" in exceptions for d in (0, 1)}
        fixed = {f" {x} ": 4.0 for x in toxicity.SEED_WORDS}
        total = sum(max(best(x, entries), best(re.sub("[̀-ͯ]+", "", __import__("unicodedata").normalize("NFKD", x)), fixed))
                    for k, x in enumerate(w) if k not in covered)
        return 100 * total / len(w) if w else 0.0

    cut = best_cut(np.array([level(folded[i]) for i in y]), np.array(list(y.values())))
    return entries, sorted(exceptions), cut, {i: level(w) / (level(w) + cut) for i, w in folded.items()}


def test_toxicity_by_plain_loops(spark, monkeypatch):
    """Entries, weights, exceptions, cut and every score of a small corpus."""
    import zlib
    monkeypatch.setattr(toxicity, "MIN_CLEAN_PHRASES", 2)
    rows, _, toxic = corpus(9)
    rows = [(i, t) for i, t in rows if i is not None] + [(6000 + k, f"my friendly zorblax has {k} feet") for k in range(12)]
    toxic += [(6000 + k, 0) for k in range(12)]
    held = lambda i: zlib.crc32(str(i).encode()) % 3 == 1
    entries, exceptions, cut, scores = plain_toxicity(rows, toxic, held, None)
    docs, labels = frame(spark, rows), spark.createDataFrame(toxic, "doc_id long, toxic int")
    got = toxicity.learn(docs, labels, train(), "doc_id", "text", "toxic", toxicity.SAMPLE_ROWS)
    assert got[0].keys() == entries.keys() and all(abs(got[0][t] - v) < 1e-9 for t, v in entries.items())
    assert len(entries) > len(toxicity.SEED_WORDS) and "friendly zorblax" in exceptions
    assert got[1] == exceptions and abs(got[2] - cut) < 1e-9
    out = {r.doc_id: r.score for r in toxicity_scores(docs, labels, train()).collect()}
    assert out.keys() == scores.keys() and all(abs(out[i] - s) < 1e-9 for i, s in scores.items())


def test_quality_by_plain_loops(spark):
    """Counts, ratios and every score of a small corpus; the fit itself is
    checked against its optimum above."""
    import zlib
    rows, quality, _ = corpus(11)
    rows = [(i, t) for i, t in rows if i is not None]
    held = lambda i: zlib.crc32(str(i).encode()) % 3 == 1
    texts, y = dict(rows), {i: v for i, v in quality if not held(i)}
    counts = np.zeros((2, nbsvm.SIZE))
    for i, v in y.items():
        counts[v][sorted(set(indicators(texts[i]).tolist()))] += 1
    ratio = nbsvm.log_count_ratio(counts[1], counts[0])
    smooth = counts + 1
    assert np.allclose(ratio, np.log(smooth[1] / smooth[1].sum()) - np.log(smooth[0] / smooth[0].sum()))
    docs, labels = frame(spark, rows), spark.createDataFrame(quality, "doc_id long, quality int")
    model = nbsvm.fit(nbsvm.training_rows(docs, labels, "quality", train(), "doc_id", "text"))
    assert np.allclose(model[1][:-1], ratio)
    ids = sorted(y)
    sign = np.array([1.0 if y[i] else -1.0 for i in ids])
    cost = np.array([nbsvm.COST * len(ids) / (2 * (sign == s).sum()) for s in sign])
    w = dual_coordinate_descent([indicators(texts[i]) for i in ids], sign, ratio, cost, nbsvm.EPOCHS, 42)
    scaled = np.append(w[:-1] * ratio, w[-1])
    out = {r.doc_id: r.score for r in quality_scores(docs, labels, train()).collect()}
    for i, t in texts.items():
        x = sorted(set(indicators(t).tolist()))
        length = math.sqrt(sum(ratio[k] ** 2 for k in x))
        margin = (sum(scaled[k] for k in x) / length if length else 0.0) + scaled[-1]
        assert abs(out[i] - 1 / (1 + math.exp(-nbsvm.SLOPE * margin))) < 1e-6


def test_a_repeated_id_does_not_fill_the_task(spark):
    rows = spark.range(5000).select(F.lit(7).alias("id"), F.concat(F.lit("t"), "id").alias("text"), F.lit(1).alias("y"))
    assert nbsvm.sampled(rows, 5000, 5000).count() == 5000
    assert nbsvm.bounded(rows, 100).count() == 200 and nbsvm.bounded(rows, 5000).count() == 5000
