import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tally.llm import simhash
from tally.llm.common import Scratch
from tally.llm.components import components
from tests_llm_helpers import groups, near, plain_fingerprint

from tally.llm.simhash import block_bits, fingerprint, links, simhash_components, simhash_dedup, trie_pairs


def points(seed, n=400):
    r = random.Random(seed)
    out = [r.getrandbits(64) for _ in range(n // 4)]
    centre = r.getrandbits(64)
    while len(set(out)) < n:
        x = r.choice([centre, r.choice(out)])
        for _ in range(r.randint(0, 7)):
            x ^= 1 << r.choice([r.randrange(64), r.randrange(10)])
        out.append(x)
    return sorted(set(out))


@pytest.mark.parametrize("seed", range(3))
def test_trie_pairs(monkeypatch, seed):
    monkeypatch.setattr(simhash, "FRONTIER", 50)
    fps = points(seed)
    a = np.array(fps, dtype=np.uint64)
    pairs = lambda v, s: [(int(v[i]), int(v[j])) for x, y in trie_pairs(v, np.array(s), 0, 4) for i, j in zip(x, y)]
    n = len(fps)
    assert sorted((min(p), max(p)) for p in pairs(a, [[0, n, 0, n, 0]])) == sorted(near(fps, 4))
    left, right = a[::2], a[1::2]
    got = pairs(np.concatenate([left, right]), [[0, len(left), len(left), n, 0]])
    assert sorted(got) == sorted((p, q) for p in left.tolist() for q in right.tolist() if (p ^ q).bit_count() <= 4)


def test_links_split_units_lose_nothing(spark, monkeypatch):
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    fps = points(7, 500)
    df = spark.createDataFrame([(signed(x),) for x in fps], "fp long")
    want = groups([signed(x) for x in fps], [(signed(a), signed(b)) for a, b in near(fps, 4)])
    for rows in (4096, 100):
        monkeypatch.setattr(simhash, "UNIT_ROWS", rows)
        e = links(df, 4)
        pairs = e.collect()
        assert all(((r.u ^ r.v) & (1 << 64) - 1).bit_count() <= 64 for r in pairs)
        assert groups(want, [(r.u, r.v) for r in pairs]) == want
    got = {r.node: r.label for r in components(e, Scratch(spark, "t")).collect()}
    assert {n: got.get(n, n) for n in want} == want


def test_rows_written_for_random_fingerprints(spark, monkeypatch):
    """Without hot prefixes nothing is expanded: what is written beside the
    links is a size row for each unit of two or more. A hot prefix is: its rows
    are copied 16 times, then up to 163 and 794 times."""
    r = np.random.default_rng(4)
    n = 20_000
    df = spark.createDataFrame([(int(x),) for x in r.integers(-(1 << 63), 1 << 63, n)], "fp long")
    written = {}

    class Counting(Scratch):
        def write(self, frame, name):
            out = super().write(frame, name)
            written[name] = out.count()
            return out

    monkeypatch.setattr(simhash, "Scratch", Counting)
    links(df, 4).collect()
    assert not [k for k in written if k.startswith("units")] and written["sizes0"] <= 5 * n
    written.clear()
    monkeypatch.setattr(simhash, "UNIT_ROWS", 1)
    same = spark.createDataFrame([(x,) for x in range(40)], "fp long")  # one prefix in all tries but the last
    links(same, 4).collect()
    in_large = 4 * 40  # rows of units that are expanded, and their copies at each turn
    assert written["units1"] == in_large * 16  # nodes that nothing meets go before the next turn
    assert all(written[f"units{t}"] <= in_large * c for t, c in ((2, 163), (3, 794)))


def texts():
    r = random.Random(3)
    word = lambda: r.choice("ab") + str(r.randrange(300))
    base = [" ".join(word() for _ in range(r.choice([1, 3, 40, 200]))) for _ in range(40)]
    out = [(i, t) for i, t in enumerate(base)]
    for i in range(60):
        w = r.choice(base).split()
        w[r.randrange(len(w))] = word()
        out.append((100 + i, " ".join(w).upper() if i % 5 == 0 else "\n".join(w)))
    return out + [(None, base[0]), (None, None), (300, ""), (301, " \t"), (5, base[5]), (5, base[5]), (None, "only"),
                  (None, "only"), (400, "É ÀB " * 70_000)]


def frame(spark, data):
    return (spark.createDataFrame(data, "doc_id long, text string").repartition(3)
            .withColumn("fp", F.lit("clash")).withColumn("uid", F.lit("clash")).withColumn("label", F.lit(1)))


def test_components_and_dedup(spark):
    data = texts()
    fps = [plain_fingerprint(t) for _, t in data]
    assert [fingerprint(t, 4) for _, t in data] == fps
    root = groups(set(fps), near(fps, 4))
    least = {}
    for (i, _), f in zip(data, fps):
        least.setdefault(root[f], set()).add(i)
    least = {k: min((i for i in v if i is not None), default=None) for k, v in least.items()}
    rows = simhash_components(frame(spark, data)).collect()
    want = sorted((str(i), f"{f:016x}", str(least[root[f]])) for (i, _), f in zip(data, fps))
    assert sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in rows) == want
    docs = frame(spark, data)
    kept = simhash_dedup(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(map(str, least.values()))


def test_blocks_and_empty(spark):
    assert block_bits(4) == [0, 12, 25, 38, 51, 64] and block_bits(0) == [0, 64]
    docs = frame(spark, texts()).limit(0)
    assert simhash_components(docs).count() == 0 and simhash_dedup(docs).count() == 0
