"""Toxicity: a weighted lexicon matched by Aho-Corasick on folded text.

Folding lower-cases, maps look-alike letters of other scripts, and digits or
signs of words that hold a letter, to Latin letters, and turns everything else
into single blanks (numbers stay numbers), so an entry is found behind any of these disguises. Accents tell words
of some languages apart, so they stay; the fixed entries, which have none, are
also sought in words without their accents. An entry is a whole word or the
beginning of one.

The lexicon starts from a few fixed entries and learns words and word
beginnings from labelled documents: an entry needs enough toxic documents,
enough different words before it (copies of one document share theirs), and
hardly any clean document; its weight is its log-odds. Phrases around an entry
that clean documents use and toxic ones do not become exceptions: what they
cover does not count. A document's level is the weight found per 100 words,
the heaviest entry of each word counting; score = level / (level + cut) with
the cut that separates the labelled rows best.

Learning uses about ``SAMPLE_ROWS`` labelled rows, chosen by a hash of the id;
every whole text is scored.

Edge cases: null and empty texts have level 0, hence score 0; contradicting
labels of a document drop its label; without labels the fixed entries and a
default cut remain; repeated rows are scored each; very long texts are folded
in blocks cut at white space, each with the word before and behind it, so that
a score does not depend on where blocks end; an empty table gives no rows; labels, lang,
source and id are never read for a score, nor are other columns.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch
from .nbsvm import sampled, training_rows

SAMPLE_ROWS = 20_000
#: General insults and phrases in which one of them is harmless.
SEED_WORDS = ("clown", "disgusting", "idiot", "loser", "moron", "pathetic", "scum", "stupid", "trash", "worthless")
SEED_EXCEPTIONS = ("clown fish", "pond scum", "trash can", "trash bin", "sore loser")
SEED_WEIGHT = 4.0
#: Letters that look like Latin ones, and digits and signs used for letters.
LOOKS = str.maketrans({
    "а": "a", "в": "b", "е": "e", "і": "i", "ј": "j", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c",
    "т": "t", "у": "y", "х": "x", "ѕ": "s", "һ": "h", "ԁ": "d",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x"})
SIGNS = str.maketrans("0134578@$!", "oieastbasi")
BEGINNINGS = range(4, 9)
MIN_DOCS, MIN_CONTEXTS, MIN_PRECISION = 5, 4, 0.7
MIN_CLEAN_PHRASES = 3
DEFAULT_CUT = 1.0
BLOCK = 1 << 20

_TRAILING_SIGNS = re.compile(r"[@$!]+(?!\w)")
_SIGNED = re.compile(r"[^\W_]*[0134578@$!](?:[^\W_]|[@$!])*")
_GAPS = re.compile(r"[\W_]+")
_MARKS = re.compile("[̀-ͯ]+")


def _letters(token: re.Match) -> str:
    """Signs as letters in a token that holds a letter."""
    own = token.group()
    return own.translate(SIGNS) if any(c.isalpha() for c in own) else own


def fold(text: str) -> str:
    """Folded words between single blanks, with a blank at either end."""
    text = text.lower()
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text).translate(LOOKS)
    text = _SIGNED.sub(_letters, _TRAILING_SIGNS.sub(" ", text))
    return f" {_GAPS.sub(' ', text).strip()} "


def bare(folded: str) -> str:
    """Folded text without accents."""
    return _MARKS.sub("", unicodedata.normalize("NFKD", folded))


@dataclass
class Block:
    """Folded words of a block between the word before and the word behind
    it; ``start`` and ``stop`` bound the blanks before its own words."""
    folded: str
    start: int
    stop: int
    words: int


def folded_blocks(text: str) -> Iterator[Block]:
    """The folded words of a text in blocks; every word is one block's own."""
    def parts() -> Iterator[str]:
        at = 0
        while at < len(text):
            end = min(len(text), at + BLOCK)
            while end < len(text) and not text[end].isspace():
                end += 1
            own = fold(text[at:end]).strip()
            if own:
                yield own
            at = end
        yield ""

    left = own = ""
    for following in parts():
        if own:
            head, tail = f" {left}" if left else "", f" {following.split(' ', 1)[0]} " if following else " "
            yield Block(f"{head} {own}{tail}", len(head), len(head) + len(own) + 1, own.count(" ") + 1)
            left = own.rsplit(" ", 1)[-1]
        own = following


def terms(word: str) -> list[str]:
    """A word's candidate entries: itself, and its beginnings."""
    return [f" {word} ", *(f" {word[:k]}" for k in BEGINNINGS if len(word) > k)]


class Matcher:
    """Aho-Corasick automaton over entries and exception phrases."""

    def __init__(self, entries: dict[str, float], exceptions: list[str]):
        import ahocorasick
        self.automaton = ahocorasick.Automaton()
        for term, weight in entries.items():
            self.automaton.add_word(term, (len(term), weight))
        for phrase in exceptions:
            self.automaton.add_word(f" {phrase} ", (len(phrase) + 2, None))
        self.empty = not len(self.automaton)
        if not self.empty:
            self.automaton.make_automaton()

    def found(self, folded: str) -> dict[int, float]:
        """Weight by the position of each matched word that no exception covers."""
        hits, covered = {}, []
        if self.empty:
            return hits
        for end, (length, weight) in self.automaton.iter(folded):
            start = end - length + 1
            if weight is None:
                covered.append((start, end))
            elif weight > hits.get(start, 0.0):
                hits[start] = weight
        for a, b in covered:
            for start in [s for s in hits if a <= s < b]:
                del hits[start]
        return hits


class Lexicon:
    """All entries on the folded text, the fixed ones also without accents."""

    def __init__(self, entries: dict[str, float], exceptions: list[str]):
        self.all = Matcher(entries, exceptions)
        self.fixed = Matcher({f" {w} ": SEED_WEIGHT for w in SEED_WORDS}, exceptions)

    def level(self, text: str | None) -> float:
        """Weight found per 100 words of the whole text."""
        total, words = 0.0, 0
        for block in folded_blocks(text or ""):
            words += block.words
            found = by_word(block.folded, self.all.found(block.folded))
            if not block.folded.isascii():
                plain, own = bare(block.folded), block.folded.split()
                for word, weight in by_word(plain, self.fixed.found(plain)).items():
                    if not own[word].isascii():
                        found[word] = max(weight, found.get(word, 0.0))
            first = block.folded.count(" ", 0, block.start)
            total += sum(weight for word, weight in found.items() if first <= word < first + block.words)
        return 100 * total / words if words else 0.0


def by_word(folded: str, hits: dict[int, float]) -> dict[int, float]:
    """Hits by the number of their word (from 0) instead of its place."""
    out, at, word = {}, 0, 0
    for start in sorted(hits):
        word += folded.count(" ", at, start)
        out[word], at = hits[start], start
    return out


def learn_entries(rows: DataFrame) -> dict[str, float]:
    """Entries from (text, y) rows: candidates are counted by document in each
    task, then summed; those that pass the thresholds reach the driver."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, list[int]] = {}
        before: list[tuple[str, int]] = []
        for batch in batches:
            for text, y in zip(batch.column("text").to_pylist(), batch.column("y").to_pylist(), strict=True):
                near: dict[str, str] = {}
                for block in folded_blocks(text or ""):
                    before_own = block.folded[:block.start].strip()
                    for previous, word in pairwise([before_own, *block.folded[block.start:block.stop].split()]):
                        for t in terms(word):
                            near.setdefault(t, previous)
                for t, previous in near.items():
                    if y == 1:
                        sums.setdefault(t, [0, 0])[0] += 1
                        before.append((t, hash_of(previous)))
                    else:
                        sums.setdefault(t, [0, 0])[1] += 1
        yield pa.RecordBatch.from_pydict({
            "term": [*sums, *(t for t, _ in before)], "toxic": [v[0] for v in sums.values()] + [0] * len(before),
            "clean": [v[1] for v in sums.values()] + [0] * len(before),
            "near": [None] * len(sums) + [h for _, h in before]},
            schema=pa.schema([("term", pa.string()), ("toxic", pa.int64()), ("clean", pa.int64()), ("near", pa.int64())]))

    totals = rows.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()
    n = {r.y: r.n for r in totals}
    found = (rows.select("text", "y").mapInArrow(count, "term string, toxic long, clean long, near long").groupBy("term")
             .agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"),
                  F.count_distinct("near").alias("contexts"))
             .filter((F.col("toxic") >= MIN_DOCS) & (F.col("contexts") >= MIN_CONTEXTS)
                     & (F.col("toxic") >= MIN_PRECISION * (F.col("toxic") + F.col("clean")))).toPandas())
    odds = np.log((found["toxic"] + 0.5) / (n.get(1, 0) + 1)) - np.log((found["clean"] + 0.5) / (n.get(0, 0) + 1))
    return {t: float(w) for t, w in zip(found["term"], odds, strict=True) if w > 0}


def hash_of(word: str) -> int:
    from xxhash import xxh64_intdigest
    return xxh64_intdigest(word) >> 1


def learn_exceptions(rows: DataFrame, entries: dict[str, float]) -> list[str]:
    """Two-word phrases with an entry in them that enough clean documents and
    no toxic document use."""
    shared = rows.sparkSession.sparkContext.broadcast(entries)

    def phrases(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(shared.value, [])
        for batch in batches:
            out = []
            for text, y in zip(batch.column("text").to_pylist(), batch.column("y").to_pylist(), strict=True):
                own = set()
                for block in folded_blocks(text or ""):
                    folded = block.folded
                    for start in matcher.found(folded):
                        if not block.start <= start < block.stop:
                            continue
                        left, end = folded[folded.rfind(" ", 0, start) + 1:start], folded.find(" ", start + 1)
                        word, right = folded[start + 1:end], folded[end + 1:max(folded.find(" ", end + 1), end + 1)]
                        own |= {f"{left} {word}"} if left else set()
                        own |= {f"{word} {right}"} if right else set()
                out += [(p, y) for p in own]
            yield pa.RecordBatch.from_pydict({"phrase": [p for p, _ in out], "y": [y for _, y in out]},
                                             schema=pa.schema([("phrase", pa.string()), ("y", pa.int32())]))

    found = (rows.select("text", "y").mapInArrow(phrases, "phrase string, y int").groupBy("phrase")
             .agg(F.count_if(F.col("y") == 1).alias("toxic"), F.count_if(F.col("y") != 1).alias("clean"))
             .filter((F.col("toxic") == 0) & (F.col("clean") >= MIN_CLEAN_PHRASES)))
    return sorted(r.phrase for r in found.select("phrase").collect())


def best_cut(levels: np.ndarray, y: np.ndarray) -> float:
    """Level from which predicting toxic errs least (both classes weighed by
    their rows), in the middle of the gap there."""
    if not (y == 1).any() or not (y != 1).any():
        return DEFAULT_CUT
    order = np.argsort(levels, kind="stable")
    v, toxic = levels[order], (y == 1)[order]
    errors = np.concatenate([[0], np.cumsum(toxic)]) + np.concatenate([np.cumsum((~toxic)[::-1])[::-1], [0]])
    edges = np.concatenate([[0.0], v, [v[-1] + 2 * DEFAULT_CUT]])
    usable = np.flatnonzero(edges[1:] > edges[:-1])
    if not len(usable):
        return DEFAULT_CUT
    k = usable[errors[usable].argmin()]
    return float(max((edges[k] + edges[k + 1]) / 2, 1e-6))


def level_column(docs: DataFrame, entries: dict[str, float], exceptions: list[str], text: Column) -> Column:
    shared = docs.sparkSession.sparkContext.broadcast((entries, exceptions))

    @F.pandas_udf("double")
    def level(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        lexicon = Lexicon(*shared.value)
        for texts in series:
            yield pd.Series([lexicon.level(t) for t in texts], dtype=float)

    return level(text)


def learn(docs: DataFrame, labels: DataFrame, in_training: Column, id_col: str, text_col: str, label: str,
          sample_rows: int) -> tuple[dict[str, float], list[str], float]:
    """(entries, exceptions, cut)."""
    rows = training_rows(docs, labels, label, in_training, id_col, text_col)
    ids = labels.groupBy(F.col("doc_id").alias("id")).agg(F.min(label).alias("y")).filter("y is not null").filter(in_training)
    rows = Scratch(docs.sparkSession, "toxicity").write(sampled(rows, ids.count(), sample_rows), "sample")
    entries = {f" {w} ": SEED_WEIGHT for w in SEED_WORDS}
    for term, weight in learn_entries(rows).items():
        entries[term] = max(weight, entries.get(term, 0.0))
    exceptions = sorted({*SEED_EXCEPTIONS, *learn_exceptions(rows, entries)})
    found = rows.select("y", level_column(docs, entries, exceptions, F.col("text")).alias("level")).toPandas()
    return entries, exceptions, best_cut(found["level"].to_numpy(), found["y"].to_numpy())


def toxicity_scores(docs: DataFrame, labels: DataFrame, in_training: Column, id_col: str = "doc_id",
                    text_col: str = "text", label: str = "toxic", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """(id, score) of every document; learned where ``in_training`` holds."""
    entries, exceptions, cut = learn(docs, labels, in_training, id_col, text_col, label, sample_rows)
    level = level_column(docs, entries, exceptions, F.col(text_col).cast("string"))
    return (docs.select(F.col(id_col).alias("id"), level.alias("level"))
            .select(F.col("id").alias(id_col), (F.col("level") / (F.col("level") + cut)).alias("score")))
