"""Fill-in-the-middle transformation by memoised content-defined chunks.

A text is cut into units (lines, words or characters); two hashed unit numbers
split it into prefix, middle and suffix, which are written in psm or spm order
with sentinels.

1. A rolling hash over the last 32 bytes ends a chunk wherever its high bits
   are zero (chunks of 64 to 4096 bytes, about 512), so a passage that many
   documents share falls into the same chunks wherever it stands.
2. A chunk's summary - unit starts behind its first byte, characters, first
   and last byte - is memoised per worker under the chunk's whole content, so
   a hit is verified byte by byte and a hash collision can't mix two chunks.
   The memo holds two generations of bounded size; the older one is dropped.
3. Summaries combine: counts add up, and the last byte of one with the first
   byte of the next decides whether a unit starts at the seam. The running
   counts locate the chunk that holds a cut, and only that chunk is searched.

Edge cases: a null or empty text is plain with 0 units; a text that contains a
sentinel is plain; rows repeated in any column give rows of their own, with
equal results for equal id and text; a null id is hashed as an empty string; a
very long text is hashed in blocks; an empty table gives no rows; columns
other than id and text are never read.
"""

from __future__ import annotations

import itertools
import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ship_code

#: Bytes of the rolling hash's window; no chunk is shorter than two windows.
WINDOW = 32
SHORTEST, LONGEST, CHUNK_BITS = 64, 4096, 9
#: Bytes of content that one generation of a worker's memo holds.
MEMO_BYTES = 16 << 20
#: Bytes that are hashed at a time.
BLOCK = 4 << 20

SENTINELS = ("<P>", "<S>", "<M>")

_GEAR = np.random.default_rng(7).integers(0, 1 << 32, 256, dtype=np.uint32)
_CONTINUATION = bytes(range(0x80, 0xC0))
_SPACE = b"\x20\x09\x0a\x0b\x0c\x0d"


@dataclass(frozen=True)
class Unit:
    """Where units start: behind the first byte of a chunk (their number and
    their places), and whether one starts between two bytes."""
    count: Callable[[bytes], int]
    places: Callable[[bytes], list[int]]
    between: Callable[[int, int], bool]


UNITS = {
    # [^\n]*\n|[^\n]+
    "line": Unit(lambda b: b.count(b"\n", 0, len(b) - 1),
                 lambda b: [m.end() for m in re.finditer(rb"\n", b[:-1])],
                 lambda last, first: last == 0x0A),
    # a word with the white space behind it; white space at the start is one too
    "word": Unit(lambda b: len(re.findall(rb"[\x20\x09-\x0d](?=[^\x20\x09-\x0d])", b)),
                 lambda b: [m.end() for m in re.finditer(rb"[\x20\x09-\x0d](?=[^\x20\x09-\x0d])", b)],
                 lambda last, first: last in _SPACE and first not in _SPACE),
    "char": Unit(lambda b: len(b[1:].translate(None, _CONTINUATION)),
                 lambda b: [m.start() + 1 for m in re.finditer(rb"[^\x80-\xbf]", b[1:])],
                 lambda last, first: not 0x80 <= first < 0xC0),
}


def rolling_hash(data: np.ndarray) -> np.ndarray:
    """Hash of the last ``WINDOW`` bytes at each byte, by doubling windows."""
    h, width = _GEAR[data], 1
    while width < WINDOW:
        h[width:] += h[:-width] << np.uint32(width)
        width *= 2
    return h


def hash_cuts(data: bytes) -> np.ndarray:
    """Ends that the rolling hash proposes, in ascending order."""
    found = []
    for at in range(0, len(data), BLOCK):
        lo = max(0, at - WINDOW + 1)
        h = rolling_hash(np.frombuffer(data, np.uint8, min(len(data), at + BLOCK) - lo, lo))
        ends = np.flatnonzero(h >> np.uint32(32 - CHUNK_BITS) == 0) + lo + 1
        found.append(ends[ends > at])
    return np.concatenate(found) if found else np.zeros(0, np.int64)


def chunk_ends(cuts, start: int, end: int) -> Iterator[int]:
    """Ends of the chunks of the text at ``start``..``end`` of the data that
    ``cuts`` belong to. They depend on the text alone: a proposed end lies at
    least ``SHORTEST`` bytes behind its chunk's start, so its window does not
    reach over it."""
    while start < end:
        i = bisect_left(cuts, start + SHORTEST)
        start = min(end, start + LONGEST, int(cuts[i]) if i < len(cuts) else end)
        yield start


class Memo(dict):
    """Chunk (whole content) to its summary, in two generations."""

    def __init__(self, unit: Unit):
        super().__init__()
        self.unit, self.old, self.held = unit, {}, 0

    def __missing__(self, chunk: bytes) -> tuple[int, int, int, int]:
        found = self.old.get(chunk)
        if found is None:
            found = (self.unit.count(chunk), len(chunk.translate(None, _CONTINUATION)), chunk[0], chunk[-1])
        if self.held + len(chunk) > MEMO_BYTES:
            self.old, self.held = dict(self), 0
            self.clear()
        self.held += len(chunk)
        self[chunk] = found
        return found


@dataclass
class Summary:
    """Chunk starts of a text, with the units started and characters begun
    before each, and the totals at the end."""
    at: list[int]
    units: list[int]
    chars: list[int]


def summarise(data: bytes, start: int, end: int, cuts, memo: Memo) -> Summary:
    """Combine the chunk summaries of the text at ``start``..``end``."""
    out, units, chars, last = Summary([], [], []), 0, 0, None
    for stop in chunk_ends(cuts, start, end):
        inner, own, first, final = memo[data[start:stop]]
        out.at.append(start)
        out.units.append(units)
        out.chars.append(chars)
        units += inner + (last is None or memo.unit.between(last, first))
        chars += own
        start, last = stop, final
    out.at.append(end)
    out.units.append(units)
    out.chars.append(chars)
    return out


def locate(data: bytes, summary: Summary, number: int, unit: Unit) -> tuple[int, int]:
    """Byte place in ``data`` and characters before unit ``number`` of a text."""
    if number >= summary.units[-1]:
        return summary.at[-1], summary.chars[-1]
    i = bisect_right(summary.units, number) - 1  # the chunk in which that many units had started
    lo, hi = summary.at[i], summary.at[i + 1]
    chunk, k = data[lo:hi], number - summary.units[i]
    places = unit.places(chunk)
    if len(places) < summary.units[i + 1] - summary.units[i]:
        places = [0, *places]  # a unit starts at the seam
    return lo + places[k], summary.chars[i] + len(chunk[:places[k]].translate(None, _CONTINUATION))


_MEMOS: dict[str, Memo] = {}


def _groups(texts: list[bytes]) -> Iterator[list[bytes]]:
    """Runs of texts of about BLOCK bytes, one text at least."""
    sizes = itertools.accumulate(map(len, texts))
    for _, run in itertools.groupby(zip(texts, sizes, strict=True), key=lambda x: (x[1] - len(x[0])) // BLOCK):
        yield [t for t, _ in run]


def fill_in_middle(docs: DataFrame, unit: str = "line", seed: int = 7, fim_rate: int = 100, spm_rate: int = 50,
                   sentinels: tuple[str, str, str] = SENTINELS, id_col: str = "doc_id",
                   text_col: str = "text") -> DataFrame:
    """One row per document: id, ``n`` units, ``form`` (plain, psm or spm),
    ``prefix_chars``, ``middle_chars`` (null if plain) and ``output``.

    Of the sha256 of ``seed:id``, the first four groups of 8 hex digits decide:
    prefix ends after the smaller of h1 and h2 modulo n + 1 units and middle
    after the larger; a document is transformed if h3 % 100 < ``fim_rate``, in
    spm order if h4 % 100 < ``spm_rate``. The first character of each of the
    three ``sentinels`` must stand nowhere else in any of them, so that no
    sentinel can arise across a seam and ``restored`` is exact."""
    for s in sentinels:
        if not s or any(s[0] in other[1:] for other in sentinels) or len(set(sentinels)) < 3:
            raise ValueError("the first character of a sentinel must stand nowhere else in the sentinels")
    ship_code(docs.sparkSession)
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    rows = (docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
            .select("id", "text", *[F.conv(F.substr(hashed, F.lit(8 * k + 1), F.lit(8)), 16, 10).cast("long").alias(f"h{k + 1}")
                                    for k in range(4)]))
    marks = [s.encode() for s in sentinels]

    def one(data: bytes, start: int, end: int, cuts, memo: Memo, h: tuple) -> tuple:
        summary = summarise(data, start, end, cuts, memo)
        n, text = summary.units[-1], data[start:end]
        if not text or h[2] % 100 >= fim_rate or any(m in text for m in marks):
            return n, "plain", None, None, text
        first, second = sorted((h[0] % (n + 1), h[1] % (n + 1)))
        (a, chars_a), (b, chars_b) = (locate(data, summary, k, memo.unit) for k in (first, second))
        prefix, middle, suffix = data[start:a], data[a:b], data[b:end]
        spm = h[3] % 100 < spm_rate
        parts = ((marks[1], suffix, marks[0], prefix) if spm else (marks[0], prefix, marks[1], suffix))
        return n, "spm" if spm else "psm", chars_a, chars_b - chars_a, b"".join((*parts, marks[2], middle))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = _MEMOS.get(unit) or _MEMOS.setdefault(unit, Memo(UNITS[unit]))
        for batch in batches:
            texts = [t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()]
            hashes, lo = list(zip(*(batch.column(f"h{k}").to_pylist() for k in range(1, 5)), strict=True)), 0
            for group in _groups(texts):
                data, out, at = b"".join(group), [], 0
                cuts = hash_cuts(data)
                for text, h in zip(group, hashes[lo:lo + len(group)], strict=True):
                    out.append(one(data, at, at + len(text), cuts, memo, h))
                    at += len(text)
                n, form, prefix, middle, output = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").slice(lo, len(group)), pa.array(n, pa.int64()), pa.array(form, pa.string()),
                     pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()),
                     pa.array(output, pa.binary()).cast(pa.string())],
                    names=["id", "n", "form", "prefix_chars", "middle_chars", "output"])
                lo += len(group)

    schema = (f"id {rows.schema['id'].dataType.simpleString()}, n long, form string, prefix_chars long, "
              "middle_chars long, output string")
    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def restored(output: Column, form: Column, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The exact text that an output of ``fill_in_middle`` was made from."""
    p, s, m = sentinels
    body = lambda mark: F.substr(output, F.lit(len(mark) + 1))
    cut = lambda first, second: F.split(body(first), "|".join(re.escape(x) for x in (second, m)))
    psm, spm = cut(p, s), cut(s, p)
    return (F.when(form == "psm", F.concat(psm[0], psm[2], psm[1]))
            .when(form == "spm", F.concat(spm[1], spm[2], spm[0])).otherwise(output))
