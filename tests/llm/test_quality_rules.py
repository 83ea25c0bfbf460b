import math
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from tally.llm import quality_rules as q
from tally.llm.quality_rules import base_stats, quality_filter, quality_rules


def plain_stats(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    times, covered = Counter(windows), set()
    for i, w in enumerate(windows):
        if times[w] > 1:
            covered |= {i, i + 1, i + 2}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)),
            len(covered))


def texts():
    r = random.Random(5)
    word = lambda: r.choice(["é", "a", "bc", "日本", "#x", "a<b>", "%"]) * r.randint(1, 2)
    out = [None, "", " ", "a", "a b", "a b a b", "x x x x", "l1\nl1\n\n\nl1", " \x85 nbsp x", "w " * 5000]
    return out + ["".join(word() + r.choice([" ", "\n", "\t\t"]) for _ in range(r.choice([3, 60, 300]))) for _ in range(60)]


def test_base_stats():
    for t in texts():
        assert base_stats(t) == plain_stats(t), t
    big = [str(i).encode() for i in range(1 << 20)] * 2
    assert q.repeat_words(big) == len(big) and q.repeat_words(big[:1 << 20]) == 0


def corpus():
    r = random.Random(2)
    good = lambda: " ".join(r.choice(["river", "stone", "walk"]) + str(r.randrange(60)) for _ in range(900))
    junk = lambda: " ".join(r.choice("qzxv") + str(r.randrange(60)) + r.choice(["%%%", "$$$", "&&&"]) for _ in range(900))
    rows = [(i, good() if i % 3 else junk()) for i in range(90)]
    labels = [(i, int(i % 3 > 0)) for i in range(0, 60)] + [(61, 1), (61, 0), (None, 1)]
    return rows + [(None, good()), (None, None), (5, ""), (1000, "river " * 40_000)], labels


def test_ratio_and_verdict(spark, monkeypatch):
    rows, labels = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).withColumn("s", F.lit("clash")).withColumn("good", F.lit(3))
    lab = spark.createDataFrame(labels, "doc_id long, quality int")
    out = quality_rules(docs, lab).collect()
    raw, target = Counter(), Counter()
    by = {}
    for i, y in labels:
        by.setdefault(i, set()).add(y)
    grams = lambda t: [((int.from_bytes((t or "").encode()[k:k + 4], "little") * 0x9E3779B1) & 0xFFFFFFFF) >> 16
                       for k in range(len((t or "").encode()) - 3)]
    for i, t in rows:
        raw.update(grams(t))
        if i is not None and by.get(i) == {1}:
            target.update(grams(t))
    nr, nt = sum(raw.values()) + 65536, sum(target.values()) + 65536
    want = []
    for i, t in rows:
        g = grams(t)
        v = sum(math.log((target[x] + 1) / nt) - math.log((raw[x] + 1) / nr) for x in g) / len(g) if g else 0.0
        n, *_, rep = plain_stats(t)
        failed = n < 50 or 100 * rep > 50 * n
        want.append((str(i), *plain_stats(t), round(v, 6), failed, not failed and v >= -0.5))
    assert sorted((str(r.doc_id), *r[1:6], round(r.ratio, 6), r.base_failed, r.kept) for r in out) == sorted(want)
    kept = quality_filter(docs, lab)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(w[0] for w in want if w[-1])
    assert any(not w[-2] and not w[-1] for w in want)
    assert quality_rules(docs.limit(0), lab).count() == 0 and quality_rules(docs, lab.limit(0)).count() == len(rows)
    monkeypatch.setattr(q, "BLOCK", 7)
    for t in texts():
        assert sorted(x for b in q._blocks((t or "").encode()) for x in b.tolist()) == sorted(grams(t))
