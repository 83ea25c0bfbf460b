"""The registered queries over whole tables: twins, brute force, contracts."""

import os
import sys
import zlib
from collections import defaultdict

import pytest
from tests_llm_helpers import groups, near, plain_fingerprint, words

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(__file__))))
from oracle_compare import digest, duck  # noqa: E402

from tally.llm.queries import ORACLE_SQL, QUERIES  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_twins(spark, name):
    df = QUERIES[name](spark, SF)
    res = duck(SF).execute(ORACLE_SQL[name])
    columns = [d[0] for d in res.description]
    assert sorted(df.columns) == sorted(columns)
    assert digest(df.columns, [tuple(r) for r in df.collect()]) == digest(columns, res.fetchall())


def test_every_query_is_registered():
    assert sorted(int(k[2:].split("_")[0]) for k in QUERIES) == list(range(1, 14))


def test_op1(spark, docs):
    fps = {i: plain_fingerprint(r.text) for i, r in docs.items()}
    root, least = groups(set(fps.values()), near(fps.values(), 4)), {}
    for i, f in fps.items():
        least[root[f]] = min(i, least.get(root[f], i))
    got = {(r.doc_id, r.fingerprint, r.component_id) for r in QUERIES["op1_simhash"](spark, SF).collect()}
    assert got == {(i, f"{f:016x}", least[root[f]]) for i, f in fps.items()}


def test_op3(spark, docs):
    rows = QUERIES["op3_sharding"](spark, SF).collect()
    assert {(r.doc_id, r["size"], r.text_crc32) for r in rows} == {
        (i, len(d.text.encode()) + 8, zlib.crc32(d.text.encode())) for i, d in docs.items()}
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert set(slots) == set(range(24)) and {len(v) for v in slots.values()} <= {len(docs) // 24, len(docs) // 24 + 1}
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())


@pytest.mark.parametrize("name,modulus,rest", [("op4_quality", 3, 1), ("op7_toxicity", 5, 0)])
def test_classifiers(spark, docs, name, modulus, rest):
    rows = QUERIES[name](spark, SF).collect()
    assert {r.doc_id for r in rows} == set(docs) and len(rows) == len(docs)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % modulus == rest) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    column = "quality" if name == "op4_quality" else "toxic"
    truth = {r.doc_id: r[column] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    right = [r.predicted == truth[r.doc_id] for r in rows if r.doc_id in truth and r.held_out]
    assert sum(right) / len(right) >= 0.85


def test_op5(spark, docs):
    truth = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    for r in QUERIES["op5_quality_rules"](spark, SF).collect():
        n = len(words(docs[r.doc_id].text))
        assert r.n_words == n and r.base_failed == (n < 50 or 100 * r.n_repeat_words > 50 * n)
        assert not (r.base_failed and r.kept)
        assert r.base_failed or r.doc_id not in truth or r.kept == (truth[r.doc_id] == 1)


def test_op6(spark, docs):
    rows = {r.doc_id: r for r in QUERIES["op6_lm_scoring"](spark, SF).collect()}
    assert {i: r.n_words for i, r in rows.items()} == {i: len(d.text.encode().split()) for i, d in docs.items()}
    assert all(r.log_score < 0 for r in rows.values())


def test_op9(spark, docs):
    rows = QUERIES["op9_packing"](spark, SF).collect()
    pieces, bins = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append((r.piece, r.start, r.length))
        bins[r.sequence_id].append((r.offset, r.length))
    assert set(pieces) == set(docs)
    for own in pieces.values():
        assert [p for p, _, _ in sorted(own)] == list(range(len(own)))
        assert all(s == 4096 * p and n == 4096 for p, s, n in sorted(own)[:-1])
    for own in bins.values():
        at = 0
        for offset, n in sorted(own):
            assert offset == at
            at += n
        assert at <= 4096
    assert len(bins) <= -(-sum(r.length for r in rows) // 4096) + 2


def test_op10(spark):
    """At sf0.01: every quoted token is a secret, no number is one."""
    import hashlib
    import re
    sf_dir = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    tokens = {(i, m.start(1)) for i, t in texts.items() for m in re.finditer(r'token = "([0-9a-f]{40})"', t)}
    rows = QUERIES["op10_secret_scan"](spark, sf_dir).collect()
    for r in rows:
        text = texts[r.doc_id][r.start:r.start + r.length]
        assert hashlib.sha256(text.encode()).hexdigest() == r.sha256
        assert not (r.is_secret and text.isdigit())
    assert tokens and tokens <= {(r.doc_id, r.start) for r in rows if r.is_secret}


def test_op12(spark, docs):
    import hashlib

    import numpy as np
    import sentencepiece
    from tally.llm.queries import piece_model_path
    sp = sentencepiece.SentencePieceProcessor(model_file=piece_model_path())
    rows = {r.doc_id: r for r in QUERIES["op12_sentence_pieces"](spark, SF).collect()}
    assert set(rows) == set(docs)
    for i, d in docs.items():
        ids = sp.encode(d.text or "", add_bos=True, add_eos=True)
        r = rows[i]
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(sp.decode(ids).encode()).hexdigest()
        assert r.spanned_bytes == len((d.text or "").encode())


def test_op13(spark):
    from test_whitening import brute, check
    own = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    rows = QUERIES["op13_whitening"](spark, SF).collect()
    check(rows, brute(own, 32))
    assert rows[0].identity_error < 1e-4
