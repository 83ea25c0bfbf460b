"""Quality rules: base statistics and a hashed n-gram log-likelihood ratio.

The verdict compares two multinomials over hashed byte n-grams: the trusted
target (documents labelled good) and the raw corpus (all documents). A
document's ratio is the mean over its n-grams of log p_target - log p_raw; it
is kept if the ratio reaches a fixed threshold. Both count vectors come from
all documents. A vector has 2^``HASH_BITS`` entries whatever the input, so it
may be collected and broadcast; counts are summed in each task first.

Edge cases: a null or empty text has no words, so it fails the base rules; a
text shorter than an n-gram has ratio 0; a document with contradicting labels
is not trusted; without any trusted document every ratio is 0; very long texts
are counted in blocks; repeated rows each count and are each judged; an empty
table gives no rows. Other columns pass through ``quality_filter`` whatever
their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import packed, ship_code, small

NGRAM = 4
HASH_BITS = 16
#: Pseudo-count of every bucket in both multinomials.
SMOOTHING = 1.0
#: Documents with a lower mean log ratio are not kept.
THRESHOLD = -0.5
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
SYMBOLS = b"#*$%&|<>"
_SPACES = b" \t\n\x0b\x0c\r"
BLOCK = 1 << 22

STATS = ("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
         "ratio double")


def buckets(data: bytes) -> np.ndarray:
    """Bucket of each 4-byte n-gram (multiplicative hash of its 32 bits)."""
    n = max(0, len(data) - NGRAM + 1)
    grams = np.ndarray((n,), dtype="<u4", buffer=data, strides=(1,)) if n else np.zeros(0, np.uint32)
    return (grams * np.uint32(0x9E3779B1)) >> np.uint32(32 - HASH_BITS)


def _blocks(data: bytes) -> Iterator[np.ndarray]:
    for at in range(0, max(1, len(data) - NGRAM + 1), BLOCK):
        yield buckets(data[at:at + BLOCK + NGRAM - 1])


def repeat_words(words: list[bytes]) -> int:
    """Words inside 3-word windows that occur twice or more, the first too."""
    n = len(words) - 2
    if n < 2:
        return 0
    index = {w: i for i, w in enumerate(dict.fromkeys(words))}
    ids, size = np.fromiter(map(index.__getitem__, words), np.int64, len(words)), len(index)
    pair = ids[:-1] * size + ids[1:]
    if size >= 1 << 20:
        pair, size = np.unique(pair, return_inverse=True)[1].astype(np.int64), len(ids)
        window = pair[:-1] * size + ids[2:]
    else:
        window = pair[:-1] * size + ids[2:]
    _, at, times = np.unique(window, return_inverse=True, return_counts=True)
    again, covered = times[at] > 1, np.zeros(len(words), bool)
    for k in range(3):
        covered[k:k + n] |= again
    return int(covered.sum())


def base_stats(text: str | None) -> tuple[int, int, int, int, int]:
    text = text or ""
    data = text.encode()
    words = data.split()
    lines = [x for x in data.split(b"\n") if x.translate(None, _SPACES)]
    return (len(words), len(text) - (len(data) - len(data.translate(None, _SPACES))),
            len(data) - len(data.translate(None, SYMBOLS)), len(lines) - len(set(lines)), repeat_words(words))


def log_ratios(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str) -> np.ndarray:
    """log p_target - log p_raw of each bucket, from all documents."""
    ship_code(docs.sparkSession)
    good = (labels.groupBy(F.col("doc_id").alias("id")).agg(F.min("quality").alias("low")).filter("low = 1")
            .filter("id is not null").select("id", F.lit(1).alias("good")))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.join(small(good, good.count()), "id", "left").select("text", "good")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(1 << HASH_BITS, np.int64), np.zeros(1 << HASH_BITS, np.int64)
        for batch in batches:
            for text, trusted in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for b in _blocks((text or "").encode()):
                    np.add.at(raw, b, 1)
                    if trusted:
                        np.add.at(target, b, 1)
        used = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(raw[used]), pa.array(target[used])],
                                         names=["bucket", "raw", "target"])

    found = (rows.mapInArrow(count, "bucket int, raw long, target long").groupBy("bucket")
             .agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toPandas())  # 2^HASH_BITS rows at most
    raw, target = np.zeros(1 << HASH_BITS), np.zeros(1 << HASH_BITS)
    raw[found["bucket"]], target[found["bucket"]] = found["raw"], found["target"]
    if not target.sum():
        return np.zeros(1 << HASH_BITS)
    share = lambda x: np.log((x + SMOOTHING) / (x.sum() + SMOOTHING * len(x)))
    return share(target) - share(raw)


def stats_column(docs: DataFrame, ratios: np.ndarray, text: Column) -> Column:
    """Struct of the base statistics and the mean log ratio of a text."""
    shared = docs.sparkSession.sparkContext.broadcast(ratios)

    @F.pandas_udf(STATS)
    def judge(series: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        table = shared.value
        for texts in series:
            out = []
            for text in texts:
                data, total, n = (text or "").encode(), 0.0, 0
                for b in _blocks(data):
                    total, n = total + float(table[b].sum()), n + len(b)
                out.append((*base_stats(text), total / n if n else 0.0))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in STATS.split(", ")])

    return judge.asNondeterministic()(text)  # evaluated once, also where a filter reads it


def base_failed(stats: str) -> Column:
    n = F.col(f"{stats}.n_words")
    return (n < MIN_WORDS) | (100 * F.col(f"{stats}.n_repeat_words") > MAX_REPEAT_PERCENT * n)


def quality_rules(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: id, base statistics, ``ratio``, ``base_failed``
    and ``kept``."""
    ratios = log_ratios(docs, labels, id_col, text_col)
    stats = stats_column(docs, ratios, F.col(text_col).cast("string"))
    out = docs.select(F.col(id_col).alias("id"), stats.alias("s"))
    return out.select(F.col("id").alias(id_col), "s.*", base_failed("s").alias("base_failed"),
                      (~base_failed("s") & (F.col("s.ratio") >= threshold)).alias("kept"))


def quality_filter(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns."""
    ratios = log_ratios(docs, labels, id_col, text_col)
    text = F.col(text_col).cast("string")
    full = packed(docs, s=stats_column(docs, ratios, text))
    return full.filter(~base_failed("s") & (F.col("s.ratio") >= threshold)).select("row.*")
