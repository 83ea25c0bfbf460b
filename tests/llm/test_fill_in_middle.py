"""Fill-in-the-middle: brute force, chunk memo, restoring, edge cases."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from tally.llm import fill_in_middle as M

PATTERNS = {"line": r"[^\n]*\n|[^\n]+", "char": r"(?s).",
            "word": r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*|[\x20\x09-\x0D]+"}


def plain(doc_id, text, unit="line", seed=7, fim_rate=100, spm_rate=50):
    text = text or ""
    units = re.findall(PATTERNS[unit], text)
    n, digest = len(units), hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k:8 * k + 8], 16) for k in range(4)]
    if not text or any(s in text for s in M.SENTINELS) or h[2] % 100 >= fim_rate:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < spm_rate:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def texts():
    rng = random.Random(5)
    shared = "".join(rng.choice("abc é\n漢🙂.") for _ in range(6000))
    out = [None, "", "\n", "\n\n\n", "a", "no end", "x\ny", "a<P>b\nc", "<S", "tail <S\n<S\n<", "\r\n\r\n x \t y",
           "漢字\nかな\n🙂", "a" * 20000, "\n" * 20000, "🙂" * 5000, " \n" * 9000]
    for k in range(40):
        cut = rng.randrange(6000)
        out.append(shared[:cut] + "".join(rng.choice("xy \n") for _ in range(rng.randrange(900))) + shared[cut:])
    return out


def rows_of(spark, own, unit, **kw):
    df = spark.createDataFrame([(i, t, "keep", i) for i, t in enumerate(own)], "doc_id long, text string, form string, n int")
    out = M.fill_in_middle(df, unit, **kw)
    out = out.withColumn("again", M.restored(F.col("output"), F.col("form")))
    return {r.doc_id: r for r in out.collect()}


@pytest.mark.parametrize("unit", sorted(PATTERNS))
def test_brute_force_and_restoring(spark, unit):
    own = texts()
    got = rows_of(spark, own, unit)
    assert len(got) == len(own)
    for i, t in enumerate(own):
        r = got[i]
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == plain(i, t, unit), (i, t)
        assert r.again == (t or "")


def test_rates(spark):
    own = texts()
    got = rows_of(spark, own, "line", fim_rate=40, spm_rate=0, seed=11)
    assert {i: (r.form, r.output) for i, r in got.items()} == {
        i: plain(i, t, "line", 11, 40, 0)[1::3] for i, t in enumerate(own)}
    assert {r.form for r in got.values()} == {"plain", "psm"}


def test_blocks_and_small_memo_change_nothing(monkeypatch):
    """Chunks, counts and cuts are the same for every block and memo size."""
    unit, text = M.UNITS["word"], (texts()[20] * 8).encode()
    whole = [tuple(M.chunk_ends(M.hash_cuts(text), 0, len(text)))]
    monkeypatch.setattr(M, "BLOCK", 1000)
    whole.append(tuple(M.chunk_ends(M.hash_cuts(text), 0, len(text))))
    assert whole[0] == whole[1]
    monkeypatch.setattr(M, "MEMO_BYTES", 5000)
    memo, cuts = M.Memo(unit), M.hash_cuts(text)
    units = re.findall(PATTERNS["word"], text.decode())
    for _ in range(2):
        s = M.summarise(text, 0, len(text), cuts, memo)
        assert s.units[-1] == len(units) and s.chars[-1] == len(text.decode())
        assert memo.held <= 5000 + M.LONGEST
    for k in (0, 1, len(units) // 2, len(units) - 1, len(units)):
        head = "".join(units[:k])
        assert M.locate(text, s, k, unit) == (len(head.encode()), len(head))


def test_shared_passages_share_chunks():
    """Chunks depend on content: a passage behind other text falls into the
    same chunks after its first few, and the memo meets them again."""
    rng = random.Random(3)
    passage = bytes(rng.randrange(32, 127) for _ in range(30000))
    heads = [bytes(rng.randrange(32, 127) for _ in range(n)) for n in (0, 777, 5000)]
    ends = [{e - len(h) for e in M.chunk_ends(M.hash_cuts(h + passage), 0, len(h) + len(passage))} for h in heads]
    common = ends[0] & ends[1] & ends[2]
    assert len(common) > 0.8 * len(ends[0]) > 20
    memo = M.Memo(M.UNITS["line"])
    for h in heads:
        M.summarise(h + passage, 0, len(h) + len(passage), M.hash_cuts(h + passage), memo)
    assert sum(map(len, memo)) < len(passage) + sum(map(len, heads)) + 20 * M.LONGEST


def test_longest_chunk_and_runs_of_one_byte():
    for text in (b"a" * 50000, bytes(range(256)) * 300, b"\n" * 9999):
        ends = list(M.chunk_ends(M.hash_cuts(text), 0, len(text)))
        sizes = [b - a for a, b in zip([0, *ends[:-1]], ends, strict=True)]
        assert ends[-1] == len(text) and max(sizes) <= M.LONGEST and min(sizes[:-1], default=M.SHORTEST) >= M.SHORTEST


def test_repeated_rows_null_ids_and_empty_table(spark):
    df = spark.createDataFrame([(None, "a\nb\nc"), (None, "a\nb\nc"), (1, "x\ny"), (1, "x\ny"), (1, None)],
                               "doc_id long, text string")
    got = [tuple(r) for r in M.fill_in_middle(df).collect()]
    assert sorted(got, key=str) == sorted([(i, *plain(i, t)) for i, t in
                                           [(None, "a\nb\nc")] * 2 + [(1, "x\ny")] * 2 + [(1, None)]], key=str)
    assert M.fill_in_middle(df.filter("false")).collect() == []


def test_sentinels_that_could_arise_at_a_seam_are_refused(spark):
    df = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    for bad in (("aba", "xx", "y"), ("<P>", "<P>", "<M>"), ("", "<S>", "<M>"), ("<P<", "<S>", "<M>")):
        with pytest.raises(ValueError):
            M.fill_in_middle(df, sentinels=bad)
