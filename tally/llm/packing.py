"""Best-fit packing of tokenised documents into sequences, with certificates.

1. Documents become token ids and an end id; longer ones than a sequence are
   cut into full pieces and a last one. Ids depend only on the text between
   white space, so each worker keeps the ids of words it has met, and looks
   up each distinct word of some megabytes of text once.
2. Pieces are dealt by hash to partitions of about ``PART_ITEMS`` rows. Each
   packs its own by best-fit decreasing and proves a lower bound for its bins
   by dual feasible functions. A partition whose bins equal its bound is
   certified: no packing of its rows is better.
3. A partition with a gap hands over all bins that are not full; a certified
   one hands over its emptiest bin, as only the rounding of its bound is left
   to gain. What was handed over meets in fewer partitions and is packed
   again, until one partition holds it, or no bin was gained.

Edge cases: a null or empty text is one piece, the end id alone; rows repeated
in any column are pieces of their own; ties in length go by position; very
long texts are tokenised in blocks; an empty table gives no rows; columns
other than id and text are never read.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, ship_code

#: Rows that one partition packs, about.
PART_ITEMS = 20_000
#: Words whose ids one generation of a worker's memo holds, about.
MEMO_WORDS = 400_000
#: Marks behind a word that are a token, or tokens, of their own.
STOPS = ".,;:!?"
#: Words that are encoded as one text.
JOINED = 128
#: Bytes of a text that are split into words at a time.
BLOCK = 1 << 20
#: Bytes of texts whose words are looked up together.
CALL = 4 * BLOCK
END_ID = 1


class WordIds:
    """Token ids of words, in two generations of a memo: words of the older
    one are taken over when they are met again, the others go."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer
        self.tokenizer, self.memo, self.old = Tokenizer.from_file(path), {"": b""}, {}
        size, mark = self.tokenizer.get_vocab_size(), getattr(self.tokenizer.model, "end_of_word_suffix", None)
        self.last = np.array([bool(mark) and self.tokenizer.id_to_token(i).endswith(mark) for i in range(size)])

    def learn(self, words: list[str]) -> list[bytes]:
        """Ids (little-endian 32-bit) of distinct words; those not yet known
        are encoded joined by blanks."""
        if len(self.memo) > MEMO_WORDS:
            self.memo, self.old = {"": b""}, self.memo
        found = list(map(self.memo.get, words))
        new = []
        for i, ids in enumerate(found):
            if ids is None:
                known = self.old.get(words[i])
                if known is None:
                    new.append(i)
                else:
                    found[i] = self.memo[words[i]] = known
        for part, cuts, data in self._encoded(words, new):
            for i, lo, hi in zip(part, cuts[:-1], cuts[1:], strict=True):
                found[i] = self.memo[words[i]] = data[lo:hi]
        return found

    def _encoded(self, words: list[str], new: list[int]) -> Iterator[tuple[list[int], list[int], bytes]]:
        """(places of words, their cuts, ids) of groups of words. A word of
        letters has one token marked as the end of a word, at least, and one
        with a stop behind it two: if a group has no more marks than that,
        they are the cuts. Other words (and letters that normalisation takes
        apart) are cut by the offsets of their tokens."""
        simple, rest = [], []
        for i in new:
            w = words[i]
            n = 1 if w.isalpha() else 2 if w[-1] in STOPS and w[:-1].isalpha() else 0
            (simple if n else rest).append((i, n) if n else i)
        groups = [simple[k:k + JOINED] for k in range(0, len(simple), JOINED)]
        joined = [" ".join([words[i] for i, _ in g]) for g in groups]
        for group, coded in zip(groups, self.tokenizer.encode_batch_fast(joined, add_special_tokens=False), strict=True):
            ids, own = np.array(coded.ids, dtype="<u4"), [i for i, _ in group]
            ends, marks = np.flatnonzero(self.last[ids]), np.cumsum([n for _, n in group])
            if len(ends) == marks[-1]:
                yield own, [0, *(4 * ends[marks - 1] + 4).tolist()], ids.tobytes()
            else:
                rest += own
        for k in range(0, len(rest), JOINED):
            group = rest[k:k + JOINED]
            coded = self.tokenizer.encode(" ".join([words[i] for i in group]), add_special_tokens=False)
            begins = np.cumsum([0] + [len(words[i]) + 1 for i in group])
            at = np.searchsorted(begins, np.array([x for x, _ in coded.offsets], dtype=np.int64), side="right") - 1
            yield group, (4 * np.searchsorted(at, np.arange(len(group) + 1))).tolist(), np.array(coded.ids, dtype="<u4").tobytes()

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one behind the other, and where each begins. Each
        distinct word is looked up once; ids are gathered by its places."""
        words = pc.ascii_split_whitespace(texts)
        coded = words.flatten().dictionary_encode()
        own = self.learn(coded.dictionary.to_pylist())
        table = np.frombuffer(b"".join(own), "<u4")
        size = np.array([len(i) // 4 for i in own], dtype=np.int64)
        begin = np.concatenate([[0], np.cumsum(size)])
        word = coded.indices.to_numpy(zero_copy_only=False)
        count = size[word] if len(word) else np.zeros(0, np.int64)
        ends = np.concatenate([[0], np.cumsum(count)])
        ids = table[np.repeat(begin[word] - ends[:-1], count) + np.arange(ends[-1])] if ends[-1] else table[:0]
        rows = np.concatenate([[0], np.cumsum(words.value_lengths().to_numpy(zero_copy_only=False))])
        return ids, ends[rows]


_IDS: dict[str, WordIds] = {}

_BLANKS = (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c")


def blocks(data: bytes) -> Iterator[bytes]:
    """Pieces of ``data`` of about BLOCK bytes, cut at ASCII white space."""
    at = 0
    while len(data) - at > BLOCK:
        cut = max(data.rfind(c, at, at + BLOCK) for c in _BLANKS)
        if cut < 0:  # a longer word: up to its end
            cut = min((e for e in (data.find(c, at + BLOCK) for c in _BLANKS) if e >= 0), default=len(data))
        yield data[at:cut]
        at = cut + 1
    yield data[at:]


def _calls(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Bounds of runs of rows of at most ``most`` bytes, or one row."""
    lo = held = 0
    for i, size in enumerate(sizes):
        if i > lo and held + size > most:
            yield lo, i
            lo, held = i, 0
        held += size
    if lo < len(sizes):
        yield lo, len(sizes)


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, id_col: str = "doc_id",
                 text_col: str = "text", with_ids: bool = False, call: int | None = None) -> DataFrame:
    """One row per piece: id, ``piece``, ``start``, ``length``, ``ids_crc32``
    and, if wanted, the ids themselves (binary, little-endian 32-bit).
    ``call``: bytes of texts whose words are looked up together, CALL if unset."""
    most = call or CALL
    ship_code(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = f"id {rows.schema['id'].dataType.simpleString()}, piece int, start long, length int, ids_crc32 long"
    schema += ", ids binary" if with_ids else ""
    end = END_ID.to_bytes(4, "little")

    def coded(words: WordIds, texts: pa.Array) -> Iterator[bytes]:
        """Ids of each text."""
        if len(texts) > 1 or len(texts[0].as_buffer()) <= most:
            ids, begins = words.encode(texts)
            data, cuts = ids.tobytes(), (4 * begins).tolist()
            yield from (data[lo:hi] for lo, hi in zip(cuts[:-1], cuts[1:], strict=True))
        else:
            yield b"".join(words.encode(pa.array([b], pa.binary()).cast(pa.string()))[0].tobytes()
                           for b in blocks(texts[0].as_buffer().to_pybytes()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _IDS.get(tokenizer_path) or _IDS.setdefault(tokenizer_path, WordIds(tokenizer_path))
        for batch in batches:
            column = pc.fill_null(batch.column("text").cast(pa.string()), "")
            for lo, hi in _calls(pc.binary_length(column).to_pylist(), most):
                index, out = [], []
                for i, ids in enumerate(coded(words, column.slice(lo, hi - lo)), lo):
                    ids += end
                    for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                        index.append(i)
                        out.append((piece, ids[at:at + 4 * capacity]))
                data = [batch.column("id").take(pa.array(index, pa.int64())), pa.array([p for p, _ in out], pa.int32()),
                        pa.array([p * capacity for p, _ in out], pa.int64()),
                        pa.array([len(b) // 4 for _, b in out], pa.int32()),
                        pa.array([zlib.crc32(b) for _, b in out], pa.int64())]
                names = ["id", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    data.append(pa.array([b for _, b in out], pa.binary()))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(data, names=names)

    return rows.mapInArrow(run, schema)


def best_fit_decreasing(sizes: list[int], capacity: int) -> tuple[list[int], list[int], list[int]]:
    """Sizes in decreasing order to bins: the bin and offset of each, and the
    fill of each bin. The bit of each free space that some bin has is set, so
    the tightest bin is the lowest bit from the size on."""
    spaces, by_space = 0, [[] for _ in range(capacity + 1)]
    bins, offsets, fill = [], [], []
    for size in sizes:
        fits = spaces >> size
        if fits:
            space = size + (fits & -fits).bit_length() - 1
            b = by_space[space].pop()
            if not by_space[space]:
                spaces ^= 1 << space
        else:
            space, b = capacity, len(fill)
            fill.append(0)
        bins.append(b)
        offsets.append(fill[b])
        fill[b] += size
        by_space[space - size].append(b)
        spaces |= 1 << (space - size)
    return bins, offsets, fill


def lower_bound(sizes: np.ndarray, capacity: int) -> int:
    """Bins that any packing needs, by dual feasible functions: rounding down
    to multiples (k = 1..64), and thresholds that count large items whole and
    small ones as nothing, with the space left beside items over a half."""
    count = np.bincount(sizes, minlength=capacity + 1)
    value = np.arange(capacity + 1)
    best = -(-int((count * value).sum()) // capacity)
    for k in range(1, 65):
        scaled = (k + 1) * value
        f = np.where(scaled % capacity == 0, k * value, scaled // capacity * capacity)
        best = max(best, -(-int((count * f).sum()) // (k * capacity)))
    upto, words = np.concatenate([[0], np.cumsum(count)]), np.concatenate([[0], np.cumsum(count * value)])
    low = np.arange(0, capacity // 2 + 1)  # thresholds
    high, half = capacity - low, capacity // 2
    over_half = upto[-1] - upto[half + 1]
    middle, middle_sum = upto[high + 1] - upto[half + 1], words[high + 1] - words[half + 1]
    small_sum = words[half + 1] - words[low]
    need = small_sum - (middle * capacity - middle_sum)
    return max(best, int((over_half + np.maximum(0, -(-need // capacity))).max()))


def _pack(capacity: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "uid"], ascending=[False, True], ignore_index=True)
        bins, offsets, fill = best_fit_decreasing(rows["length"].tolist(), capacity)
        level = np.array(fill)
        gap = len(fill) - lower_bound(rows["length"].to_numpy(), capacity)
        hand_over = level < capacity if gap else np.zeros(len(fill), bool)
        if not gap and level.min() < capacity:
            hand_over[level.argmin()] = True
        at = np.array(bins)
        return pd.DataFrame({"uid": rows["uid"], "length": rows["length"], "part": rows["part"], "bin": at,
                             "offset": np.array(offsets, dtype=np.int64), "gap": gap, "open": hand_over[at]})
    return run


def pack(pieces: DataFrame, capacity: int = 4096) -> DataFrame:
    """(uid, length) rows to (uid, sequence_id, offset)."""
    scratch = Scratch(pieces.sparkSession, "packing")
    full = pieces.filter(F.col("length") == capacity)
    done = [full.select("uid", (-F.col("uid") - 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))]
    items, before, held, turn = pieces.filter(F.col("length") < capacity), None, None, 0
    n = items.count()
    while n:
        n_parts = -(-n // PART_ITEMS)
        dealt = items.select("uid", F.col("length").cast("int").alias("length"),
                             F.pmod(F.xxhash64("uid", F.lit(turn)), F.lit(n_parts)).cast("int").alias("part"))
        packed = scratch.write(dealt.groupBy("part").applyInPandas(
            _pack(capacity), "uid long, length int, part int, bin int, offset long, gap int, open boolean"),
            f"round{turn}")
        placed = packed.select("uid", "length", "open",
                               (F.lit(turn) * F.lit(1 << 52) + F.col("part").cast("long") * F.lit(1 << 26)
                                + F.col("bin")).alias("sequence_id"), "offset")
        of = lambda df: df.agg(F.count_distinct("sequence_id"), F.count(F.lit(1))).first()
        if before is not None and of(placed)[0] >= before:  # the exchange gained nothing: the bins stay as they were
            done.append(held)
            break
        if n_parts == 1:
            done.append(placed.select("uid", "sequence_id", "offset"))
            break
        done.append(placed.filter(~F.col("open")).select("uid", "sequence_id", "offset"))
        items = placed.filter("open")
        held = items.select("uid", "sequence_id", "offset")
        before, n = of(items)
        turn += 1
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, id_col: str = "doc_id",
                   text_col: str = "text", with_ids: bool = False, call: int | None = None) -> DataFrame:
    """Pieces of all documents with their ``sequence_id`` and ``offset``."""
    scratch = Scratch(docs.sparkSession, "pieces")
    pieces = scratch.write(token_pieces(docs, tokenizer_path, capacity, id_col, text_col, with_ids, call)
                           .withColumn("uid", F.monotonically_increasing_id()), "pieces")
    out = pieces.join(pack(pieces, capacity), "uid")
    return out.select(F.col("id").alias(id_col), "piece", "start", F.col("length").cast("long").alias("length"),
                      "ids_crc32", "sequence_id", "offset", *(["ids"] if with_ids else []))


def sequences(packed: DataFrame) -> DataFrame:
    """One row per sequence of pieces packed ``with_ids``: its ids in order."""
    own = F.array_sort(F.collect_list(F.struct("offset", "ids")))  # a sequence is bounded by its capacity
    return (packed.groupBy("sequence_id").agg(own.alias("own"))
            .select("sequence_id", F.aggregate("own", F.lit(b""), lambda a, x: F.concat(a, x.ids)).alias("ids")))
