"""Pieces: the library's ids, offsets by round trip, normalisation by map."""

import random
import struct

import numpy as np
import pytest

from tally.llm import sentence_pieces as S
from tally.llm.queries import piece_model_path


@pytest.fixture(scope="module")
def library():
    import sentencepiece
    return sentencepiece.SentencePieceProcessor(model_file=piece_model_path())


@pytest.fixture(scope="module")
def model():
    return S.PieceModel(piece_model_path())


def texts():
    rng = random.Random(9)
    alphabet = list("aaabeinost   \n\t.,-'") + ["é", "漢", "字", "🙂", "▁", "　", "<s>", "</s>", "<0x0A>", "\x00", "́", "ﬁ", "</w>"]
    out = ["", " ", "  ", "a", " a", "a ", "▁", "▁▁a", "\n", "\n\n a\n", "a  b   c                                d", "\r\n", "x" * 3000,
           "naïve café", "<s> not a mark </s>", "a\tb", "​", "🙂🙂", "．", "﻿a"]
    out += ["".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 120))) for _ in range(300)]
    return out


def expected(library, text):
    return library.encode(text, add_bos=True, add_eos=True)


def test_ids_are_the_librarys(model, library):
    own = texts()
    for text, (ids, _) in zip(own, model.encode(own), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == expected(library, text), repr(text)
    assert model.decode([i for i, _ in model.encode(own)]) == [library.decode(expected(library, t)) for t in own]


def test_spans_tile_the_source(model, library):
    own = texts()
    for text, (ids, begins) in zip(own, model.encode(own), strict=True):
        ids, data = np.frombuffer(ids, "<u4").tolist(), text.encode()
        assert len(begins) == len(ids) + 1 and begins[0] == 0 and begins[-1] == len(data)
        assert (np.diff(begins) >= 0).all()
        first = True
        for piece, a, b in zip(ids, begins[:-1], begins[1:], strict=True):
            name, span = library.id_to_piece(piece), data[a:b]
            if library.is_control(piece):
                assert span == b""
                continue
            own_bytes = bytes([int(name[3:5], 16)]) if library.is_byte(piece) else name.encode()
            if first:  # the blank mark before the text has no source
                own_bytes, first = own_bytes[3:], False
            assert own_bytes == span.replace(b" ", "▁".encode()) or own_bytes == span, (text, name)


def test_spans_agree_with_the_library(model, library):
    for text in texts():
        if not text or "▁" in text:
            continue
        proto = library.encode(text, return_type="proto")
        (_, begins), = model.encode([text])
        for k, piece in enumerate(proto.pieces):
            if not library.is_byte(piece.id):
                assert (piece.begin, piece.end) == (begins[k + 1], begins[k + 2])


def test_long_texts_in_blocks(model, library, monkeypatch):
    text = " ".join(texts()) * 3
    monkeypatch.setattr(S, "BLOCK", 50)
    monkeypatch.setattr(S, "CALL", 1000)
    monkeypatch.setattr(S, "MEMO_WORDS", 100)
    small = S.PieceModel(piece_model_path())
    (ids, begins), = small.encode([text])
    assert np.frombuffer(ids, "<u4").tolist() == expected(library, text)
    (again, same), = model.encode([text])
    assert again == ids and (begins == same).all()
    assert len(small.memo) <= 100 + 60


def double_array(entries):
    """A compiled character map of (key, replacement) pairs of bytes: each
    node takes a block of 256 units of its own, so that places never clash."""
    strings, places, tree = b"", {}, {}
    for key, new in entries:
        places[key] = len(strings)
        strings += new + b"\0"
        node = tree
        for byte in key:
            node = node.setdefault(byte, {})
        node[None] = places[key]
    units, free = {}, [1]

    def fill(node, at):
        base = free[0] * 256
        free[0] += 1
        offset = base ^ at
        offset = (offset >> 8) << 8  # whole blocks: written in the long form
        base = at ^ offset
        units[at] = units.get(at, 0) | (offset >> 8) << 10 | 0x200
        if None in node:
            units[at] |= 0x100
            units[base] = 0x80000000 | node[None]
        for byte, child in node.items():
            if byte is not None:
                units[base ^ byte] = units.get(base ^ byte, 0) | byte
                fill(child, base ^ byte)

    fill(tree, 0)
    size = (max(units) // 256 + 1) * 256
    array = b"".join(struct.pack("<I", units.get(k, 1 << 31)) for k in range(size))
    return struct.pack("<I", len(array)) + array + strings


MAP = [("ﬁ".encode(), b"fi"), ("é".encode(), "é".encode()), ("　".encode(), b" "), (b"ab", b"X"), (b"abc", b"YZ"),
       ("​".encode(), b""), (b"q", b"  ")]


def with_map(entries, squeeze):
    """The given model with a character map and squeezing of blanks."""
    with open(piece_model_path(), "rb") as f:
        data = f.read()
    spec = b"\x0a\x01x" + b"\x18\x01" + bytes([0x20, squeeze]) + b"\x28\x01"
    if entries:
        blob, size = double_array(entries), b""
        n = len(blob)
        while True:
            size += bytes([n & 127 | (128 if n > 127 else 0)])
            n >>= 7
            if not n:
                break
        spec += b"\x12" + size + blob
    size, n = b"", len(spec)
    while True:
        size += bytes([n & 127 | (128 if n > 127 else 0)])
        n >>= 7
        if not n:
            break
    return b"".join(raw for number, _, raw in S._fields(data) if number != 3) + b"\x1a" + size + spec


@pytest.mark.parametrize("squeeze", [0, 1])
@pytest.mark.parametrize("entries", [[], MAP])
def test_character_map_like_the_library(tmp_path, squeeze, entries):
    import sentencepiece
    path = tmp_path / "mapped.model"
    path.write_bytes(with_map(entries, squeeze))
    library, model = sentencepiece.SentencePieceProcessor(model_file=str(path)), S.PieceModel(str(path))
    own = texts() + ["ﬁn abcab  abx ", "　　a", "q", " q a q ", "​", "ée", "abcabcab", "aqqb", "a​ b"]
    for text, (ids, begins) in zip(own, model.encode(own), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == expected(library, text), repr(text)
        assert begins[0] == 0 and begins[-1] == len(text.encode()) and (np.diff(begins) >= 0).all()


def test_replaced_text_keeps_its_source(tmp_path):
    path = tmp_path / "mapped.model"
    path.write_bytes(with_map(MAP, 0))
    model = S.PieceModel(str(path))
    normal, align = model.normalise("aﬁ abcd")
    assert normal == "▁afi▁YZd"
    assert align.tolist() == [0, 0, 0, 0, 1, 1, 4, 4, 4, 5, 5, 8, 9]


def test_longest_key_wins():
    table = S.CharacterMap(double_array(MAP))
    assert table.longest(b"abcd", 0) == (3, b"YZ") and table.longest(b"xabd", 1) == (2, b"X")
    assert table.longest(b"a", 0) is None and table.longest("ﬁ".encode(), 0) == (3, b"fi")


def test_edge_rows(spark, library):
    df = spark.createDataFrame([(1, None, "z"), (1, "", "z"), (None, "a b", None), (2, "a b", "z"), (2, "a b", "z")],
                               "doc_id long, text string, ids string")
    rows = S.decode_pieces(S.encode_pieces(df, piece_model_path()), piece_model_path()).collect()
    whole = S.encode_pieces(df, piece_model_path(), with_text=True)
    assert sorted(map(str, whole.collect())) == sorted(map(str, rows))
    got = sorted((str(r.doc_id), np.frombuffer(r.ids, "<u4").tolist(), r.decoded) for r in rows)
    ab = expected(library, "a b")
    assert got == sorted([("1", [1, 2], ""), ("1", [1, 2], ""), ("None", ab, "a b"), ("2", ab, "a b"), ("2", ab, "a b")])
    assert S.encode_pieces(df.filter("false"), piece_model_path()).collect() == []
    null = spark.createDataFrame([(1, None)], "doc_id long, ids binary")
    assert [r.decoded for r in S.decode_pieces(null, piece_model_path()).collect()] == [""]
