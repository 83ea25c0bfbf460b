"""Offset-preserving SentencePiece encoding and decoding.

1. The normaliser reads the model's compiled character map (a double-array
   trie and its replacement strings): at each place the longest matching key
   is replaced, user-defined symbols first, and each normalised byte records
   the source byte it came from. Blanks become the model's blank mark.
2. Normalised text is cut into words where no merge of the vocabulary can
   reach across: before a run of blank marks that follows other text, and
   around ASCII characters that no piece of two or more holds. Words a worker has not met
   are merged in one call by the library on a copy of the model whose
   normaliser does nothing; their ids are kept in two generations of a memo.
3. Piece lengths summed along the ids give each piece's place in the
   normalised text, and the recorded alignment projects it on source bytes.

The spans tile the source: each begins where the one before ended, the first
at 0, the last at its end. Begin and end ids have empty spans, like a blank
mark that the model put before the text. A replaced key belongs whole to the
piece that holds the replacement's last byte; unchanged text is aligned byte
by byte, so byte pieces get a byte each.

Edge cases: a null or empty text gives the begin and end ids alone; repeated
rows give rows of their own; very long texts are merged in blocks; an empty
table gives no rows; columns other than id and text are never read. Models
without byte fallback are refused: their unknown piece has no length.
"""

from __future__ import annotations

import re
import struct
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship_code

#: Words that one generation of a worker's memo holds, about.
MEMO_WORDS = 100_000
#: Characters of a normalised text that are cut into words at a time.
BLOCK = 1 << 20
#: Characters of texts whose unknown words are merged in one call.
CALL = 1 << 20

# Fixed values of the model format: blank mark, piece types.
BLANK = "▁"
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        value, at, shift = value | (byte & 0x7F) << shift, at + 1, shift + 7
        if byte < 0x80:
            return value, at


def _fields(data: bytes) -> Iterator[tuple[int, object, bytes]]:
    """(number, value, raw bytes) of each field of a serialised message."""
    at = 0
    while at < len(data):
        start = at
        key, at = _varint(data, at)
        kind = key & 7
        if kind == 0:
            value, at = _varint(data, at)
        else:
            size, at = _varint(data, at) if kind == 2 else ({1: 8, 5: 4}[kind], at)
            value, at = data[at:at + size], at + size
        yield key >> 3, value, data[start:at]


class CharacterMap:
    """Longest-prefix replacement by a compiled character map: the length of a
    double array, its 32-bit units, and replacement strings ended by zero."""

    def __init__(self, blob: bytes):
        size = struct.unpack_from("<I", blob)[0]
        self.units = np.frombuffer(blob, "<u4", size // 4, 4).tolist()
        self.strings = blob[4 + size:]
        self.first = {b for b in range(1, 256) if self._step(self._base(0), b) is not None}

    def _base(self, node: int) -> int:
        unit = self.units[node]
        return node ^ ((unit >> 10) << ((unit & 0x200) >> 6))

    def _step(self, base: int, byte: int) -> int | None:
        node = base ^ byte
        return node if node < len(self.units) and self.units[node] & 0x800000FF == byte else None

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """Length of the longest key at ``at`` and its replacement."""
        found, base, end = None, self._base(0), at
        while end < len(data):
            node = self._step(base, data[end])
            if node is None:
                break
            base, end = self._base(node), end + 1
            if self.units[node] >> 8 & 1:
                found = end - at, self.units[base] & 0x7FFFFFFF
        if found is None:
            return None
        size, value = found
        return size, self.strings[value:self.strings.index(b"\0", value)]


class PieceModel:
    """A SentencePiece model: normaliser, words, pieces."""

    def __init__(self, path: str):
        import sentencepiece
        with open(path, "rb") as f:
            data = f.read()
        pieces, copy, spec, trainer = [], [], {}, {}
        for number, value, raw in _fields(data):
            if number == 1:
                own = {k: v for k, v, _ in _fields(value)}
                pieces.append((own[1].decode(), own.get(3, NORMAL)))
            elif number == 2:
                trainer = {k: v for k, v, _ in _fields(value)}
            if number == 3:
                spec = {k: v for k, v, _ in _fields(value)}
            else:
                copy.append(raw)
        if not any(kind == BYTE for _, kind in pieces):
            raise ValueError("a model with byte fallback is needed")
        # the same model with a normaliser that does nothing
        copy.append(bytes([3 << 3 | 2, 6, 3 << 3, 0, 4 << 3, 0, 5 << 3, 0]))
        self.merges = sentencepiece.SentencePieceProcessor(model_proto=b"".join(copy))
        self.whole = sentencepiece.SentencePieceProcessor(model_proto=data)
        self.map = CharacterMap(spec[2]) if spec.get(2) else None
        self.dummy_prefix, self.squeeze = bool(spec.get(3, 1)), bool(spec.get(4, 1))
        self.escape, self.suffix = bool(spec.get(5, 1)), bool(trainer.get(24, 0))
        self.symbols = sorted((p.encode() for p, kind in pieces if kind == USER_DEFINED), key=len, reverse=True)
        self.lengths = np.array([1 if kind == BYTE else 0 if kind == CONTROL else len(p.encode())
                                 for p, kind in pieces], dtype=np.int64)
        self.begin, self.end = self.whole.bos_id(), self.whole.eos_id()
        self.plain = not (self.map or self.symbols or self.squeeze or self.suffix or not self.escape)
        self.words = self._word_pattern([p for p, kind in pieces if kind in (NORMAL, UNUSED, USER_DEFINED)])
        self.memo, self.old = {}, {}

    def _word_pattern(self, pieces: list[str]):
        """Cuts text where no piece can reach across; None if there is no such
        place (blank marks inside pieces, symbols, marks behind words)."""
        if self.symbols or self.suffix or any(BLANK in p.lstrip(BLANK) for p in pieces):
            return None
        held = set().union(*(p for p in pieces if len(p) > 1))
        alone = "".join(re.escape(chr(c)) for c in range(128) if chr(c) not in held)
        pattern = f"{BLANK}*[^{BLANK}{alone}]+|{BLANK}+"
        return re.compile(f"{pattern}|[{alone}]" if alone else pattern)

    # -- normalisation -----------------------------------------------------
    def normalise(self, text: str) -> tuple[str, np.ndarray]:
        """Normalised text, and for each of its bytes, and one more for its
        end, the source byte it begins at."""
        if not self.plain:
            return self._by_map(text.encode())
        if not text:
            return "", np.zeros(1, np.int64)
        source = np.frombuffer(text.encode(), np.uint8)
        align = np.repeat(np.arange(len(source)), np.where(source == 0x20, 3, 1))
        prefix = BLANK if self.dummy_prefix else ""
        return prefix + text.replace(" ", BLANK), np.concatenate(
            [np.zeros(3 * len(prefix), np.int64), align, [len(source)]])

    def _parts(self, data: bytes) -> Iterator[tuple[int, int, bytes, bool]]:
        """(start, end, replacement, unchanged) from left to right."""
        at = 0
        while at < len(data):
            symbol = next((s for s in self.symbols if data.startswith(s, at)), None)
            size = 1
            while at + size < len(data) and data[at + size] & 0xC0 == 0x80:
                size += 1  # one character
            found = (len(symbol), symbol) if symbol else (
                self.map.longest(data, at) if self.map and data[at] in self.map.first else None)
            size, new = found or (size, data[at:at + size])
            yield at, at + size, new, new == data[at:at + size]
            at += size

    def _by_map(self, data: bytes) -> tuple[str, np.ndarray]:
        mark = BLANK.encode() if self.escape else b" "
        out, align, after_blank = [], [], self.squeeze
        parts = list(self._parts(data))
        if self.squeeze:  # blanks before the text
            parts = parts[next((i for i, p in enumerate(parts) if p[2] != b" "), len(parts)):]
        if not parts:
            return "", np.zeros(1, np.int64)
        body = []
        for start, end, new, same in parts:
            while self.squeeze and after_blank and new.startswith(b" "):
                new, same = new[1:], False
            if new:
                body.append((start, end, new, same))
                after_blank = new.endswith(b" ")
        if self.dummy_prefix and not self.suffix:
            out.append(mark)
            align += [parts[0][0]] * len(mark)
        for start, _, new, same in body:
            for i, byte in enumerate(new):
                own = mark if byte == 0x20 else bytes([byte])
                out.append(own)
                align += [start + i if same else start] * len(own)
        value, last = b"".join(out), parts[-1][1]
        if self.squeeze:
            while value.endswith(mark):
                value, last = value[:-len(mark)], align[len(value) - len(mark)]
                align = align[:len(value)]
        if self.dummy_prefix and self.suffix:
            value += mark
            align += [last] * len(mark)
        return value.decode(), np.array([*align, last], np.int64)

    # -- ids ---------------------------------------------------------------
    def _blocks(self, text: str) -> Iterator[list[str]]:
        """Words of a normalised text, in lists of about BLOCK characters."""
        if self.words is None:
            yield [text] if text else []
            return
        at = 0
        while at < len(text):
            end = len(text)
            if end - at > BLOCK:  # cut before a blank mark behind other text
                cut = re.compile(f"(?<!{BLANK}){BLANK}").search(text, at + BLOCK)
                end = cut.start() if cut else end
            yield self.words.findall(text[at:end])
            at = end

    def learn(self, words: set[str]) -> None:
        """Merge the words that the memo does not hold, in one call."""
        if len(self.memo) > MEMO_WORDS:
            self.memo, self.old = {}, self.memo
        new = [w for w in words if w not in self.memo]
        for w in new:
            if w in self.old:
                self.memo[w] = self.old[w]
        new = [w for w in new if w not in self.memo]
        for w, ids in zip(new, self.merges.encode(new, num_threads=1), strict=True):
            self.memo[w] = array("I", ids).tobytes()

    def _ids(self, words: list[str]) -> bytes:
        return b"".join(map(self.memo.__getitem__, words))

    def encode(self, texts: list[str]) -> Iterator[tuple[bytes, np.ndarray]]:
        """Ids (little-endian 32-bit, begin and end ids included) and the
        source bytes at which pieces begin, and one more for the last end."""
        normal = [self.normalise(t) for t in texts]
        if sum(len(t) for t, _ in normal) <= 2 * CALL:
            ready = [[w for block in self._blocks(t) for w in block] for t, _ in normal]
            self.learn(set().union(*ready))
            found = [self._ids(words) for words in ready]
        else:
            found = []
            for t, _ in normal:
                own = []
                for words in self._blocks(t):
                    self.learn(set(words))
                    own.append(self._ids(words))
                found.append(b"".join(own))
        for (_, align), ids, text in zip(normal, found, texts, strict=True):
            size = self.lengths[np.frombuffer(ids, "<u4")]
            places = np.zeros(len(size) + 3, np.int64)  # begin id, pieces, end id, last end
            places[2:-1] = align[np.cumsum(size)]
            places[-2:] = len(text.encode())
            yield (self.begin.to_bytes(4, "little") + ids + self.end.to_bytes(4, "little")), places

    def decode(self, ids: list[bytes]) -> list[str]:
        """The library's text of each list of ids."""
        return [self.whole.decode(np.frombuffer(i, "<u4").tolist()) for i in ids]


_MODELS: dict[str, PieceModel] = {}


def _model(path: str) -> PieceModel:
    return _MODELS.get(path) or _MODELS.setdefault(path, PieceModel(path))


def _runs(sizes: list[int]) -> Iterator[tuple[int, int]]:
    """Bounds of runs of rows of at most CALL characters or bytes, or one row."""
    lo = held = 0
    for i, size in enumerate(sizes):
        if i > lo and held + size > CALL:
            yield lo, i
            lo, held = i, 0
        held += size
    if lo < len(sizes):
        yield lo, len(sizes)


def encode_pieces(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text",
                  with_text: bool = False) -> DataFrame:
    """One row per document: id, ``ids`` (binary, little-endian 32-bit) and
    ``begins`` (array of source bytes, one per id and one for the last end:
    piece i spans begins[i] to begins[i + 1]). ``with_text`` adds ``decoded``,
    as ``decode_pieces`` would, without a second worker beside the first."""
    ship_code(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(model_path)
        for batch in batches:
            column = batch.column("text")
            for lo, hi in _runs(pc.fill_null(pc.utf8_length(column), 0).to_pylist()):
                texts = [t or "" for t in column.slice(lo, hi - lo).to_pylist()]
                ids, places = zip(*model.encode(texts), strict=True)
                offsets = np.concatenate([[0], np.cumsum([len(p) for p in places])])
                begins = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()),
                                                  pa.array(np.concatenate(places), pa.int32()))
                decoded = [pa.array(model.decode(list(ids)), pa.string())] if with_text else []
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").slice(lo, hi - lo), pa.array(ids, pa.binary()), begins, *decoded],
                    names=["id", "ids", "begins", *["decoded" for _ in decoded]])

    schema = f"id {rows.schema['id'].dataType.simpleString()}, ids binary, begins array<int>"
    schema += ", decoded string" if with_text else ""
    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def decode_pieces(coded: DataFrame, model_path: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """``coded`` with the text of its ``ids`` in ``out_col`` (a null is empty)."""
    ship_code(coded.sparkSession)
    rest = [c for c in coded.columns if c != out_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(model_path)
        for batch in batches:
            for lo, hi in _runs(pc.fill_null(pc.binary_length(batch.column(ids_col)), 0).to_pylist()):
                part = batch.slice(lo, hi - lo)
                decoded = model.decode([i or b"" for i in part.column(ids_col).to_pylist()])
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(decoded, pa.string())], names=[*rest, out_col])

    rows = coded.select(*rest)
    return rows.mapInArrow(run, rows.schema.simpleString()[len("struct<"):-1] + f",{out_col}:string")
