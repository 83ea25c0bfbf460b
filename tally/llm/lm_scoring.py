"""LM scoring: stupid backoff over words, computed with joins.

score(w2 | w1) = c(w1 w2) / c(w1) if the pair was counted at least
``min_pairs`` times, else ALPHA * c(w2) / N; a document's score is the sum of
the logarithms, its first word scored by c(w1) / N.

* Every distinct word and every distinct pair is counted as itself, by 63-bit
  hashes of the words; both count tables are distributed and grow with the
  corpus. The ``SHORT_IDS`` most frequent words get a short id in place of
  their hash: that only shortens rows, no count depends on it.
* Pair counts over all documents are a table partitioned by the pair, built
  from partial sums. Each document is exploded into its distinct pairs with
  multiplicity and joined to that table; the rows are summed per document.
* With ``min_pairs`` 1 (the default) no pair of the corpus is unseen, so a
  score is the sum of log c(w1 w2) less the sum of log c(w1), and pairs
  counted once add log 1 = 0: the joined table needs no row for them, and the
  result is that of all pairs. With more, the table holds the gain of a pair
  over its backoff score, for which it is joined to the word counts.
* Word counts enter per document: those of words with a short id are summed
  while exploding, any other word is a row that is joined to its count.
* Two aids of fixed size keep rows out of that join and change no score. Gains
  of the ``FREQUENT_PAIRS`` most frequent pairs are added while exploding. A
  bitmap of the hashes of all rows of the table tells which pairs and words
  are not in it (their gain is 0); a row it cannot tell is joined. On a corpus
  whose table far exceeds the bitmap, more rows are joined.
* A frequent pair has a row per document that holds it; the join is a plain
  one, so skewed partitions are split.

Edge cases: null and wordless texts have no words and score 0; repeated rows
are documents of their own; very long texts are counted in blocks that repeat
the last word of the block before as context; an empty table gives no rows;
other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch

ALPHA = 0.4
#: Words with a short id, at most.
SHORT_IDS = 1 << 18
#: Bytes of text that are counted together (at most 2^20 words, see _PLACE).
CALL = 1 << 21
#: Pairs whose gains are broadcast, at most, and bits of the bitmap (2^27: 16 MB).
FREQUENT_PAIRS = 1 << 18
FILTER_BITS = 27
#: First key of the rows of single words; second key where both words of a
#: pair have short ids, which are then packed in the first.
SINGLE, PACKED, SHIFT = 1 << 62, 1 << 61, 20
_PLACE = 21  # bits of a word's place among the distinct words of a call
_PRIMES = [np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9,
                                  0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5)]  # of XXH64


@dataclass
class Words:
    """The words of some texts: hashes of the distinct ones, the place of each
    word among them, its text, whether the next word is of the same text, and
    for each text its row, whether no word of the row comes before, its length."""
    hashes: np.ndarray
    at: np.ndarray
    text: np.ndarray
    next_is_own: np.ndarray
    row: np.ndarray
    first_block: np.ndarray
    size: np.ndarray


def _hash(words: pa.StringArray) -> np.ndarray:
    """63 bits of the XXH64 (seed 0) of each word, below zero, so that no short
    id is a hash. Words of under 32 bytes are hashed together, in steps of 8, 4
    and 1 bytes; others, which XXH64 takes in another way, one by one."""
    from xxhash import xxh64_intdigest
    _, offsets, data = words.buffers()
    if not len(words):
        return np.zeros(0, np.int64)
    ends = np.frombuffer(offsets, np.int32)[words.offset:words.offset + len(words) + 1].astype(np.int64)
    raw = (data.to_pybytes() if data else b"") + bytes(8)
    p1, p2, p3, p4, p5 = _PRIMES
    at, left = ends[:-1].copy(), np.diff(ends)
    long = np.flatnonzero(left >= 32)
    h = left.astype(np.uint64) + p5
    left[long] = 0
    eights, fours, ones = (np.ndarray(len(raw) - 7, kind, raw, strides=1) for kind in ("<u8", "<u4", "u1"))
    while (i := np.flatnonzero(left >= 8)).size:
        h[i] = _turned(h[i] ^ _turned(eights[at[i]] * p2, 31) * p1, 27) * p1 + p4
        at[i] += 8
        left[i] -= 8
    i = np.flatnonzero(left >= 4)
    h[i] = _turned(h[i] ^ fours[at[i]].astype(np.uint64) * p1, 23) * p2 + p3
    at[i] += 4
    left[i] -= 4
    while (i := np.flatnonzero(left > 0)).size:
        h[i] = _turned(h[i] ^ ones[at[i]].astype(np.uint64) * p5, 11) * p1
        at[i] += 1
        left[i] -= 1
    h = (h ^ h >> np.uint64(33)) * p2
    h = (h ^ h >> np.uint64(29)) * p3
    h ^= h >> np.uint64(32)
    h[long] = np.fromiter((xxh64_intdigest(raw[a:b]) for a, b in zip(ends[long].tolist(), ends[long + 1].tolist(), strict=True)),
                          np.uint64, len(long))
    return -1 - (h >> np.uint64(1)).astype(np.int64)


def _turned(x: np.ndarray, by: int) -> np.ndarray:
    """Bits turned left."""
    return x << np.uint64(by) | x >> np.uint64(64 - by)


def _blocks(data: bytes) -> Iterator[tuple[bool, bytes]]:
    """A long text in blocks of about CALL bytes, each with the last word of
    the ones before it in front; whether there was none."""
    carry = b""
    at = 0
    while at < len(data):
        end = at + CALL
        while end < len(data) and not data[end:end + 1].isspace():
            end += 1
        words = data[at:end]
        yield not carry, carry + b" " + words if carry else words
        last = words.rsplit(None, 1)
        carry = last[-1].strip() if last else carry
        at = end


def _calls(texts: pa.Array) -> Iterator[tuple[list[int], list[bool], pa.Array]]:
    """(rows, whether no word of the row comes before, texts) of about CALL bytes."""
    sizes = pc.binary_length(texts).to_pylist()
    lo = held = 0
    for i, size in enumerate([*sizes, CALL + 1]):
        if i > lo and held + size > CALL:
            yield list(range(lo, i)), [True] * (i - lo), texts.slice(lo, i - lo)
            lo, held = i, 0
        if i < len(sizes) and size > CALL:
            for first, block in _blocks(texts[i].as_buffer().to_pybytes()):
                yield [i], [first], pa.array([block], pa.binary()).cast(pa.string())
            lo, held = i + 1, 0
        else:
            held += size


def _words(column: pa.Array) -> Iterator[Words]:
    """The words of a column of texts, call by call."""
    for row, first, texts in _calls(pc.fill_null(column.cast(pa.string()), "")):
        split = pc.ascii_split_whitespace(texts)
        flat = split.flatten()
        text = np.repeat(np.arange(len(texts)), split.value_lengths().to_numpy(zero_copy_only=False))
        real = pc.not_equal(flat, "")
        coded = flat.filter(real).dictionary_encode()
        text = text[real.to_numpy(zero_copy_only=False)]
        next_is_own = np.zeros(len(text), bool)
        next_is_own[:-1] = text[1:] == text[:-1]
        yield Words(_hash(coded.dictionary), coded.indices.to_numpy(zero_copy_only=False).astype(np.int64),
                    text, next_is_own, np.array(row), np.array(first), np.bincount(text, minlength=len(texts)))


def word_counts(docs: DataFrame, text_col: str) -> DataFrame:
    """(word, n): 63-bit hash of a word and its count over all documents."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for w in _words(b.column(0)):
                repeated = w.at[_starts(w) & ~w.first_block[w.text]]  # context of a later block
                n = np.bincount(w.at, minlength=len(w.hashes)) - np.bincount(repeated, minlength=len(w.hashes))
                yield pa.RecordBatch.from_arrays([pa.array(w.hashes), pa.array(n)], names=["word", "n"])

    return (docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(count, "word long, n long")
            .groupBy("word").agg(F.sum("n").alias("n")))


def _starts(w: Words) -> np.ndarray:
    """Which words are the first of their text."""
    out = np.ones(len(w.at), bool)
    out[1:] = ~w.next_is_own[:-1]
    return out


def count_of_top(rows: DataFrame, column: str, most: int) -> int:
    """The least power of two so that at most ``most`` rows count as many."""
    above, least = 0, 63
    by_power = dict(rows.groupBy(F.floor(F.log2(column)).cast("int")).count().collect())  # 63 rows at most
    while least and above + by_power.get(least - 1, 0) <= most:
        least -= 1
        above += by_power.get(least, 0)
    return 1 << least


@dataclass
class Short:
    """Words with short ids (1 and up, in the order of hashes), and N."""
    hashes: np.ndarray
    counts: np.ndarray
    least: int
    total: int

    def codes(self, hashes: np.ndarray) -> np.ndarray:
        """The short id of each word, or its hash."""
        if not len(self.hashes):
            return hashes
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, at + 1, hashes)


def short_ids(words: DataFrame) -> Short:
    least = count_of_top(words, "n", SHORT_IDS)
    kept = words.filter(F.col("n") >= least).toArrow()  # at most SHORT_IDS rows
    hashes, counts = (kept.column(c).to_numpy() for c in ("word", "n"))
    order = np.argsort(hashes)
    return Short(hashes[order], counts[order], least, words.agg(F.sum("n")).first()[0] or 0)


def _pairs_of(w: Words, short: Short) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, k1, k2, times) of the distinct pairs of each text."""
    j = np.flatnonzero(w.next_is_own)
    key, times = np.unique((w.text[j] << 2 * _PLACE) | (w.at[j] << _PLACE) | w.at[j + 1], return_counts=True)
    codes, place = short.codes(w.hashes), (1 << _PLACE) - 1
    first, second = codes[key >> _PLACE & place], codes[key & place]
    both = (first >= 0) & (second >= 0)
    return key >> 2 * _PLACE, np.where(both, first << SHIFT | second, first), np.where(both, PACKED, second), times


def pair_counts(docs: DataFrame, short: Short, text_col: str) -> DataFrame:
    """(k1, k2, c): the count of each distinct pair over all documents."""
    shared = docs.sparkSession.sparkContext.broadcast(short)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for w in _words(b.column(0)):
                w.text[:] = 0  # no need to keep the texts apart: sums over a whole call
                _, k1, k2, times = _pairs_of(w, shared.value)
                yield pa.RecordBatch.from_arrays([pa.array(k1), pa.array(k2), pa.array(times)], names=["k1", "k2", "x"])

    return (docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(count, "k1 long, k2 long, x long")
            .groupBy("k1", "k2").agg(F.sum("x").alias("c")))


def pair_gains(seen: DataFrame, words: DataFrame, short: Short, min_pairs: int) -> DataFrame:
    """(k1, k2, gain, c) of the pairs that add to a score."""
    if min_pairs <= 1:
        return seen.filter("c > 1").select("k1", "k2", F.log("c").alias("gain"), "c")
    shared = words.sparkSession.sparkContext.broadcast(short)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            codes = shared.value.codes(b.column(0).to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array(codes), b.column(1)], names=["w", "n"])

    coded, packed = words.select("word", "n").mapInArrow(code, "w long, n long"), F.col("k2") == PACKED
    w1 = F.when(packed, F.shiftright("k1", SHIFT)).otherwise(F.col("k1"))
    w2 = F.when(packed, F.col("k1").bitwiseAND(F.lit((1 << SHIFT) - 1))).otherwise(F.col("k2"))
    named = lambda i: coded.select(F.col("w").alias(f"w{i}"), F.col("n").alias(f"n{i}"))
    gain = F.log("c") - F.log("n1") - F.log("n2") - math.log(ALPHA) + math.log(max(1, short.total))
    return (seen.filter(F.col("c") >= min_pairs).select("*", w1.alias("w1"), w2.alias("w2"))
            .join(named(1), "w1").join(named(2), "w2").select("k1", "k2", gain.alias("gain"), "c"))


def _slots(k1: np.ndarray, k2: np.ndarray, bits: int) -> np.ndarray:
    """Hash of ``bits`` bits of two keys."""
    h = k1.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ k2.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    h = (h ^ h >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ h >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return (h >> np.uint64(64 - bits)).astype(np.int64)


def key_filter(keys: DataFrame) -> np.ndarray:
    """Bitmap of the slots of all (k1, k2), little-endian bits."""
    size = FILTER_BITS

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(_slots(b.column(0).to_numpy(), b.column(1).to_numpy(), size))], names=["slot"])

    blocks = (keys.select("k1", "k2").mapInArrow(slots, "slot long")
              .groupBy(F.shiftright("slot", 15).alias("block")).agg(F.bitmap_construct_agg(F.col("slot") % (1 << 15)).alias("bits")))
    out = np.zeros(1 << size - 3, np.uint8)
    for block, bits in blocks.toLocalIterator():  # of fixed size, a partition at a time
        out[block << 12:(block + 1) << 12] = np.frombuffer(bits, np.uint8)
    return out


@dataclass
class Aids:
    """Keys and gains of frequent pairs, by key, and the bitmap of the table."""
    keys: np.ndarray
    gains: np.ndarray
    bitmap: np.ndarray


def scored_rows(docs: DataFrame, short: Short, aids: Aids, min_pairs: int, id_col: str, text_col: str) -> DataFrame:
    """(uid, k1, k2, x, id): the times ``x`` a document has a pair that may be
    in the table and is not frequent; the weight ``x`` of a single word
    without a short id (``k1`` = SINGLE); and two rows with its own figures
    (``k2`` null): the sum of its other scores (``k1`` even, with the id), and
    the number of words (``k1`` odd)."""
    rows = docs.select(F.monotonically_increasing_id().alias("uid"), F.col(id_col).alias("id"),
                       F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast((short, aids))

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        short, aids = shared.value
        log_alpha, log_total = math.log(ALPHA), math.log(max(1, short.total))
        logs = np.concatenate([[0.0], np.log(np.maximum(short.counts, 1))])
        bits = len(aids.bitmap).bit_length() + 2
        for b in batches:
            uids, ids = b.column(0).to_numpy(), b.column(1)
            for w in _words(b.column(2)):
                n, codes = len(w.row), short.codes(w.hashes)
                starts = _starts(w)
                opening, repeated = starts & w.first_block[w.text], starts & ~w.first_block[w.text]
                size = w.size - np.bincount(w.text[repeated], minlength=n)
                heads = np.bincount(w.text[opening], minlength=n)
                if min_pairs <= 1:  # less log c(w1) for each pair; the first word by c / N
                    weight = opening.astype(float) - w.next_is_own
                    base = -log_total * heads
                else:  # log c(w) for each word, backed off but for the first
                    weight = 1.0 - repeated
                    base = -log_total * size + log_alpha * (size - heads)
                code = codes[w.at]
                is_short = code >= 0
                base = base + np.bincount(w.text[is_short], logs[code[is_short]] * weight[is_short], minlength=n)
                text, k1, k2, x = _pairs_of(w, short)
                if len(aids.keys):
                    at = np.minimum(np.searchsorted(aids.keys, k1), len(aids.keys) - 1)
                    hit = (k2 == PACKED) & (aids.keys[at] == k1)
                    base = base + np.bincount(text[hit], aids.gains[at[hit]] * x[hit], minlength=n)
                    text, k1, k2, x = text[~hit], k1[~hit], k2[~hit], x[~hit]
                key, inverse = np.unique((w.text[~is_short] << _PLACE) | w.at[~is_short], return_inverse=True)
                alone = np.bincount(inverse, weight[~is_short], minlength=len(key))
                key, alone = key[alone != 0], alone[alone != 0]
                text = np.concatenate([text, key >> _PLACE])
                k1 = np.concatenate([k1, np.full(len(key), SINGLE)])
                k2 = np.concatenate([k2, codes[key & (1 << _PLACE) - 1]])
                x = np.concatenate([x.astype(float), alone])
                slot = _slots(k1, k2, bits)
                maybe = aids.bitmap[slot >> 3] >> (slot & 7).astype(np.uint8) & 1 == 1
                own = uids[w.row]
                text, none = text[maybe], np.full(n, SINGLE)
                second = np.concatenate([k2[maybe], none, none])
                mark = np.concatenate([np.full(len(text), -1), w.row, np.full(n, -1)])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate([own[text], own, own])), pa.array(np.concatenate([k1[maybe], 2 * own, 2 * own + 1])),
                     pa.array(second, mask=second == SINGLE), pa.array(np.concatenate([x[maybe], base, size.astype(float)])),
                     ids.take(pa.array(mark, mask=mark < 0))], names=["uid", "k1", "k2", "x", "id"])

    return rows.mapInArrow(explode, f"uid long, k1 long, k2 long, x double, id {kind}")


def lm_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_pairs: int = 1) -> DataFrame:
    """One row per document: id, ``n_words``, ``log_score`` (natural log) and
    ``mean_log_score`` per word (0 without words)."""
    scratch = Scratch(docs.sparkSession, "lm")
    words = scratch.write(word_counts(docs, text_col), "words")
    short = short_ids(words)
    seen = scratch.write(pair_counts(docs, short, text_col).filter(F.col("c") >= max(min_pairs, 2)), "pairs")
    gains = pair_gains(seen, words, short, min_pairs)
    table = gains if min_pairs <= 1 else scratch.write(gains, "gains")
    packed = table.filter(F.col("k2") == PACKED)
    top = packed.filter(F.col("c") >= count_of_top(packed, "c", FREQUENT_PAIRS)).select("k1", "gain").toArrow()  # so many rows
    order = np.argsort(top.column("k1").to_numpy())
    singles = words.filter((F.col("n") < short.least) & (F.col("n") > 1)).select(  # of one, the logarithm is 0
        F.lit(SINGLE).alias("k1"), F.col("word").alias("k2"), F.log("n").alias("gain"))
    table = table.select("k1", "k2", "gain").unionByName(singles)
    aids = Aids(top.column("k1").to_numpy()[order], top.column("gain").to_numpy()[order], key_filter(table))
    joined = (scored_rows(docs, short, aids, min_pairs, id_col, text_col)
              .join(table, ["k1", "k2"], "left"))  # null keys: a document's own figures
    own, is_words = F.col("k2").isNull(), F.col("k2").isNull() & (F.col("k1") % 2 == 1)
    score = F.when(own & ~is_words, F.col("x")).when(~own, F.col("x") * F.col("gain"))
    out = joined.groupBy("uid").agg(F.max("id").alias("id"), F.sum(F.when(is_words, F.col("x"))).cast("long").alias("n_words"),
                                    F.sum(score).alias("log_score"))
    return out.select(F.col("id").alias(id_col), "n_words", "log_score",
                      F.when(F.col("n_words") > 0, F.col("log_score") / F.col("n_words")).otherwise(0.0).alias("mean_log_score"))
