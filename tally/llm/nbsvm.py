"""Quality classifier: naive Bayes support vectors.

Features are indicators of hashed byte n-grams, and of windows that repeat
(a word twice in a row, lines, shares of words in repeated 3-word windows).
Each indicator is scaled by its class log-count ratio, taken from all labelled
training rows; a linear hinge-loss model over the scaled indicators is fitted
by dual coordinate descent. Every whole text is scored.

The fit runs in one task over about ``SAMPLE_ROWS`` labelled rows, chosen by a
hash of their id; nothing else is bounded.

Edge cases: null and empty texts have no indicators, so the bias alone scores
them; contradicting labels of a document drop its label; with one class only,
that class is predicted; without labels the score is 0.5; repeated rows are
scored each; an empty table gives no rows; labels, lang, source and id are
never features, and other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, ship_code, small
from .quality_rules import base_stats

HASH_BITS = 18
SAMPLE_ROWS = 8_000
SHAPES = 16  # reserved indices behind the n-gram buckets
SIZE = (1 << HASH_BITS) + SHAPES
BLOCK = 1 << 22
EPOCHS, COST, SLOPE = 30, 1.0, 4.0


def indicators(text: str | None) -> np.ndarray:
    """Sorted distinct feature indices of a whole text."""
    data = (text or "").encode()
    if not data:
        return np.zeros(0, np.int64)
    seen = np.zeros(SIZE, bool) if len(data) > 1 << 16 else None
    found = []
    for at in range(0, max(1, len(data) - 3), BLOCK):
        part = data[at:at + BLOCK + 3]
        if len(part) < 4:
            continue
        grams = np.ndarray((len(part) - 3,), dtype="<u4", buffer=part, strides=(1,))
        b = (grams * np.uint32(0x9E3779B1)) >> np.uint32(32 - HASH_BITS)
        if seen is None:
            found.append(np.unique(b))
        else:
            seen[b] = True
    if seen is not None:
        found.append(np.flatnonzero(seen))
    words = data.split()
    n, _, _, lines, repeated = base_stats(text)
    twice = sum(map(bytes.__eq__, words, words[1:]))
    flags = [twice > 0, 10 * twice > n, lines > 0, lines > 3, *(100 * repeated > k * n for k in (0, 5, 10, 20, 35, 50, 70))]
    shapes = (1 << HASH_BITS) + np.flatnonzero(flags)
    if len(found) > 1:
        found = [np.unique(np.concatenate(found))]
    return np.concatenate([*found, shapes]).astype(np.int64)


def log_count_ratio(positive: np.ndarray, negative: np.ndarray) -> np.ndarray:
    """log (p / |p|) / (q / |q|) with p, q the indicator counts plus one."""
    p, q = positive + 1.0, negative + 1.0
    return np.log(p / p.sum()) - np.log(q / q.sum())


def dual_coordinate_descent(rows: list[np.ndarray], y: np.ndarray, ratio: np.ndarray, cost: np.ndarray,
                            epochs: int, seed: int) -> np.ndarray:
    """Weights (the bias last) of the hinge loss with L2 penalty. A row's
    vector is its scaled indicators at unit length, and a constant 1."""
    w, alpha, order = np.zeros(len(ratio) + 1), np.zeros(len(rows)), np.random.default_rng(seed)
    scaled = [unit(ratio[x]) for x in rows]
    for _ in range(epochs):
        moved = 0.0
        for i in order.permutation(len(rows)):
            x, v = rows[i], scaled[i]
            gradient = y[i] * (float(w[x] @ v) + w[-1]) - 1
            new = min(max(alpha[i] - gradient / (float(v @ v) + 1), 0.0), cost[i])
            step = (new - alpha[i]) * y[i]
            if step:
                w[x] += step * v
                w[-1] += step
                moved = max(moved, abs(step))
                alpha[i] = new
        if moved < 1e-3:
            break
    return w


def unit(v: np.ndarray) -> np.ndarray:
    length = float(np.sqrt(v @ v)) if len(v) else 0.0
    return v / length if length else v


def training_rows(docs: DataFrame, labels: DataFrame, label: str, in_training: Column, id_col: str,
                  text_col: str) -> DataFrame:
    """(id, text, y) of the documents with one label value, where
    ``in_training`` (an expression over the column ``id``) holds."""
    one = (labels.groupBy(F.col("doc_id").alias("id")).agg(F.min(label).alias("y"), F.max(label).alias("top"))
           .filter("y = top and id is not null").select("id", F.col("y").cast("int").alias("y")).filter(in_training))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.join(small(one, one.count()), "id")


def sampled(rows: DataFrame, n_rows: int, wanted: int) -> DataFrame:
    """About ``wanted`` of the ``n_rows`` rows, by a hash of the id."""
    share = min(1.0, wanted / max(1, n_rows))
    return rows.filter(F.shiftrightunsigned(F.xxhash64("id", F.lit(17)), 11) < int(share * (1 << 53)))


def bounded(sample: DataFrame, wanted: int) -> DataFrame:
    """At most twice ``wanted`` rows of a sample, for a task that takes them
    all, however often an id is repeated."""
    return sample.orderBy(F.xxhash64("id", F.lit(17)), F.xxhash64("text")).limit(2 * wanted)


def _counts(rows: DataFrame) -> tuple[np.ndarray, np.ndarray, int, int]:
    """Indicator counts of both classes over all training rows, and the
    number of rows of each; at most SIZE + 1 rows reach the driver."""
    ship_code(rows.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, SIZE + 1), np.int64)
        for batch in batches:
            for text, y in zip(batch.column("text").to_pylist(), batch.column("y").to_pylist(), strict=True):
                own = sums[1 if y == 1 else 0]
                own[indicators(text)] += 1
                own[SIZE] += 1
        used = np.flatnonzero(sums.sum(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(sums[1][used]),
                                          pa.array(sums[0][used])], names=["feature", "positive", "negative"])

    got = (rows.select("text", "y").mapInArrow(count, "feature int, positive long, negative long").groupBy("feature")
           .agg(F.sum("positive").alias("positive"), F.sum("negative").alias("negative")).toPandas())
    positive, negative = np.zeros(SIZE + 1), np.zeros(SIZE + 1)
    positive[got["feature"]], negative[got["feature"]] = got["positive"], got["negative"]
    return positive[:-1], negative[:-1], int(positive[-1]), int(negative[-1])


def fit(rows: DataFrame, sample_rows: int = SAMPLE_ROWS, seed: int = 42) -> np.ndarray:
    """Weights by feature index (already times the ratio), the bias last."""
    positive, negative, n_pos, n_neg = _counts(rows)
    weights = np.zeros(SIZE + 1)
    if not n_pos or not n_neg:
        weights[-1] = float(n_pos > 0) - float(n_neg > 0)
        return weights
    ratio = log_count_ratio(positive, negative)
    shared = rows.sparkSession.sparkContext.broadcast(ratio)

    def train(sample: pd.DataFrame) -> pd.DataFrame:
        features = [indicators(t) for t in sample.sort_values("id")["text"]]
        y = np.where(sample.sort_values("id")["y"].to_numpy() == 1, 1.0, -1.0)
        own = {s: max(1, int((y == s).sum())) for s in (1.0, -1.0)}
        cost = np.array([COST * len(y) / (2 * own[s]) for s in y])  # both classes weigh the same
        w = dual_coordinate_descent(features, y, shared.value, cost, EPOCHS, seed)
        w[:-1] *= shared.value
        used = np.flatnonzero(w)
        return pd.DataFrame({"feature": used, "weight": w[used]})

    sample = bounded(sampled(rows, n_pos + n_neg, sample_rows), sample_rows).withColumn("task", F.lit(0))
    model = sample.groupBy("task").applyInPandas(train, "feature long, weight double")
    got = Scratch(rows.sparkSession, "nbsvm").write(model, "weights").toPandas()  # SIZE + 1 rows at most
    weights[got["feature"]] = got["weight"]
    return np.append(np.stack([weights[:-1], ratio]), [[weights[-1]], [0.0]], axis=1)


def score_column(docs: DataFrame, model: np.ndarray, text: Column) -> Column:
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m = shared.value
        w, ratio = (m[0], m[1]) if m.ndim == 2 else (m, None)
        for texts in series:
            margins = []
            for text in texts:
                x = indicators(text)
                length = float(np.sqrt((ratio[x] ** 2).sum())) if ratio is not None and len(x) else 0.0
                margins.append((float(w[x].sum()) / length if length else 0.0) + w[-1])
            yield pd.Series(1 / (1 + np.exp(-SLOPE * np.array(margins))), dtype=float)

    return score(text)


def quality_scores(docs: DataFrame, labels: DataFrame, in_training: Column, id_col: str = "doc_id",
                   text_col: str = "text", label: str = "quality", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """(id, score) of every document; learned where ``in_training`` holds."""
    model = fit(training_rows(docs, labels, label, in_training, id_col, text_col), sample_rows)
    return docs.select(F.col(id_col).alias(id_col), score_column(docs, model, F.col(text_col).cast("string")).alias("score"))
