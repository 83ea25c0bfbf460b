"""SimHash near-dedup by a binary trie self-join.

Fingerprints: each word shingle's XXH64 votes on 64 bits; a bit is 1 if set in
over half of the shingles. Documents link at ``max_bits`` or fewer differing
bits, and a component is what links reach.

Join: distinct fingerprints only, copies meet in their fingerprint. Two
fingerprints within k bits agree wholly in one of k + 1 bit blocks, so there
are k + 1 tries, each over the fingerprints turned to begin with its block.
A node pair of a trie has spent no error on its first block, at least one on
each block of an earlier trie (that trie has those pairs), and is dropped as
soon as it has spent more than k. The tries are cut into units by their first
block's value, and a unit that is larger than ``UNIT_ROWS`` is expanded into
its child node pairs, four bits at a time, each again a unit: no task holds a
hot prefix whole. Inside a unit, node pairs are traversed together, level by
level, over the sorted fingerprints.

A unit emits a spanning forest of the links it found, never all pairs, and
components come from label propagation over those edges.

Edge cases: null and wordless texts have fingerprint zero and link like any
other; fewer words than a shingle give one shingle; null ids count as absent
for ``component_id`` (null if a component has no other); repeated rows stay
rows; an empty table gives no rows; other columns are not read and pass
through ``simhash_dedup`` whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, packed, ship_code, small
from .components import components

#: Largest unit that is traversed at once; its task holds about 300 bytes a row.
#: Without hot prefixes that is enough for 8 * 10^9 distinct fingerprints. An
#: expansion copies each row of a unit to its child node pairs within the
#: budget: 16 rows after one, 163 after two, 794 after three (k = 4).
UNIT_ROWS = 1 << 20
#: Fingerprints of a task that takes several units, about.
BATCH_ROWS = 8192
#: Node pairs held at a time while a unit is traversed.
FRONTIER = 200_000
#: Shingles hashed before their votes are counted.
VOTES = 1 << 16


def fingerprint(text: str | None, words: int) -> int:
    """64-bit SimHash of a whole text (lower-cased A-Z, ``words``-shingles)."""
    from xxhash import xxh64_intdigest
    parts = (text or "").encode().lower().split()
    if not parts:
        return 0
    joined = b" ".join(parts)
    ends = np.cumsum([len(p) + 1 for p in parts]) - 1  # end of each word in ``joined``
    n = max(1, len(parts) - words + 1)
    begins = np.concatenate([[0], ends[:-1] + 1])[:n].tolist()
    stops = ends[min(words, len(parts)) - 1:].tolist()
    votes = np.zeros(64, dtype=np.int64)
    for lo in range(0, n, VOTES):
        h = np.array([xxh64_intdigest(joined[a:b], 42) for a, b in zip(begins[lo:lo + VOTES], stops[lo:lo + VOTES],
                                                                      strict=False)], dtype=np.uint64)
        votes += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * votes > n, bitorder="little")
    return int(bits.view(np.uint64)[0])


def fingerprints(docs: DataFrame, words: int, id_col: str, text_col: str) -> DataFrame:
    """(id, fp): the fingerprint as a signed long of the same bits."""
    ship_code(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t.as_py(), words) for t in batch.column(1)], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], names=["id", "fp"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, fp long")


def block_bits(max_bits: int) -> list[int]:
    """First bit of each of max_bits + 1 blocks, and 64."""
    n = max_bits + 1
    return [64 * i // n for i in range(n)] + [64]


def _turned(fp: np.ndarray, by: int) -> np.ndarray:
    """Fingerprints turned left: bit ``by`` (from the top) comes first."""
    return fp if by == 0 else (fp << np.uint64(by)) | (fp >> np.uint64(64 - by))


def trie_pairs(values: np.ndarray, starts: np.ndarray, depth: int, budget: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs into ``values`` that differ in ``budget`` bits or fewer.

    ``starts``: node pairs (a0, a1, b0, b1, spent), ranges of ``values`` that
    are sorted and equal in their first ``depth`` bits but for ``spent``
    errors; two equal ranges stand for the pairs within one node, each once.
    The halves of a range at the next bit follow from a running count of that
    bit. Node pairs wait on a stack of bounded chunks, so memory does not
    follow the number of links."""
    stack = [(depth, starts[lo:lo + FRONTIER]) for lo in range(0, len(starts), FRONTIER)]
    ones = {}
    while stack:
        level, nodes = stack.pop()
        single = (nodes[:, 1] - nodes[:, 0] == 1) & (nodes[:, 3] - nodes[:, 2] == 1)
        if level == 64:
            single[:] = True
        leaf = nodes[single & (nodes[:, 0] != nodes[:, 2])]
        if len(leaf):
            hit = leaf[np.bitwise_count(values[leaf[:, 0]] ^ values[leaf[:, 2]]) <= budget]
            if len(hit):
                yield hit[:, 0], hit[:, 2]
        nodes = nodes[~single]
        if not len(nodes):
            continue
        if level not in ones:
            bit = (values >> np.uint64(63 - level)) & np.uint64(1)
            ones[level] = np.concatenate([np.zeros(1, np.int32), np.cumsum(bit, dtype=np.int32)])
        one = ones[level]
        a0, a1, b0, b1, e = nodes.T
        a_mid, b_mid = a1 - (one[a1] - one[a0]), b1 - (one[b1] - one[b0])
        same = (a0 == b0) & (a1 == b1)
        nxt = []
        for x0, x1, y0, y1, errors, again in ((a0, a_mid, b0, b_mid, e, False), (a_mid, a1, b_mid, b1, e, False),
                                              (a0, a_mid, b_mid, b1, e + 1, False), (a_mid, a1, b0, b_mid, e + 1, True)):
            ok = (x1 > x0) & (y1 > y0) & (errors <= budget)
            ok &= (x0 != y0) | (x1 - x0 > 1) | (y1 - y0 > 1)
            if again:  # within one node its two halves meet once
                ok &= ~same
            if ok.any():
                nxt.append(np.stack([x0[ok], x1[ok], y0[ok], y1[ok], errors[ok]], axis=1))
        if nxt:
            nodes = np.concatenate(nxt)
            stack += [(level + 1, nodes[lo:lo + FRONTIER]) for lo in range(0, len(nodes), FRONTIER)]


class Forest:
    """Union-find over positions, fed by blocks of links."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:
            ra, rb = self.parent[a], self.parent[b]
            apart = ra != rb
            if not apart.any():
                return
            a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
            np.minimum.at(self.parent, np.maximum(ra, rb), np.minimum(ra, rb))
            while True:  # shortcut until every position names its root
                up = self.parent[self.parent]
                if (up == self.parent).all():
                    break
                self.parent = up


def _edges(max_bits: int):
    """Links of a batch of units of one trie and depth, as a forest."""
    bounds = block_bits(max_bits)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        trie, depth = int(rows["trie"].iloc[0]), int(rows["depth"].iloc[0])
        turned = _turned(rows["fp"].to_numpy().view(np.uint64), bounds[trie])
        unit, second = pd.factorize(rows["unit"])[0], (rows["side"] == 2).to_numpy()
        order = np.lexsort((turned, second, unit))
        values, node = turned[order], (2 * unit + second)[order]
        begins = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]]))
        ends, owner = np.append(begins[1:], len(node)), node[begins]
        first = np.flatnonzero(owner % 2 == 0)
        after = np.minimum(first + 1, len(owner) - 1)
        mate = np.where(owner[after] == owner[first] + 1, after, first)  # a unit's second side, or itself
        starts = np.stack([begins[first], ends[first], begins[mate], ends[mate],
                           rows["spent"].to_numpy()[order][begins[first]]], axis=1)
        back = _turned(values, (64 - bounds[trie]) % 64)
        forest = Forest(len(values))
        for x, y in trie_pairs(values, starts, depth, max_bits):
            if trie:  # a pair that agrees in an earlier block belongs to that block's trie
                differ, own = back[x] ^ back[y], np.ones(len(x), bool)
                for lo, hi in zip(bounds[:trie], bounds[1:trie + 1], strict=True):
                    own &= (differ & np.uint64(((1 << (hi - lo)) - 1) << (64 - hi))) != 0
                x, y = x[own], y[own]
            forest.add(x, y)
        out = np.flatnonzero(forest.parent != np.arange(len(values)))
        return pd.DataFrame({"u": back[out].view(np.int64), "v": back[forest.parent[out]].view(np.int64)})

    return run


def links(fps: DataFrame, max_bits: int) -> DataFrame:
    """Edges (u, v) between distinct fingerprints (column ``fp``): a spanning
    forest of the links of every batch of units."""
    scratch = Scratch(fps.sparkSession, "trie")
    bounds = block_bits(max_bits)
    firsts = F.array(*[F.struct(F.lit(t).alias("trie"), F.lit(lo).alias("first"), F.lit(hi - lo).alias("depth"))
                       for t, (lo, hi) in enumerate(zip(bounds[:-1], bounds[1:], strict=True))])
    turned = "shiftleft(fp, first) | if(first = 0, 0L, shiftrightunsigned(fp, 64 - first))"
    # side 0: a node with itself; 1 and 2: the two nodes of a pair
    units = (fps.select("fp", F.explode(firsts).alias("t")).select("fp", "t.*").withColumn("turned", F.expr(turned))
             .withColumn("unit", F.expr("cast(shiftrightunsigned(turned, 64 - depth) as string)"))
             .withColumn("spent", F.lit(0)).withColumn("side", F.lit(0)))
    key, edges, turn = ["trie", "unit"], [], 0
    while True:
        sizes = units.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("side") <= 1).alias("na"),
                                        F.count_if(F.col("side") == 2).alias("nb"), F.max("side").alias("pair"))
        sizes = scratch.write(sizes.filter("(pair = 0 and n > 1) or (na > 0 and nb > 0)"), f"sizes{turn}")
        large, rows = sizes.agg(F.count_if(F.col("n") > UNIT_ROWS), F.coalesce(F.sum("n"), F.lit(0))).first()
        live = units.join(sizes.select(*key, "n"), key)
        fits = (F.col("n") <= UNIT_ROWS) | (F.col("depth") > 60)
        batches = F.lit(-(-rows // (BATCH_ROWS * len(bounds[1:]))) or 1)
        found = (live.filter(fits).select(*key, "depth", "spent", "side", "fp")
                 .groupBy("trie", "depth", F.pmod(F.xxhash64("unit"), batches).alias("batch"))
                 .applyInPandas(_edges(max_bits), "u long, v long"))
        edges.append(scratch.write(found, f"edges{turn}"))
        if not large:
            break
        # a large unit becomes the pairs of its child nodes, four bits on, within the error budget
        child = (live.filter(~fits).withColumn("own", F.expr("int(shiftrightunsigned(shiftleft(turned, depth), 60))"))
                 .withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(15))))
                 .withColumn("spent", F.expr("spent + bit_count(own ^ other)")).filter(F.col("spent") <= max_bits)
                 # within a node the smaller child is the first side; a node pair keeps its sides
                 .withColumn("side", F.expr("case when side > 0 then side when own = other then 0 "
                                            "when own < other then 1 else 2 end"))
                 .withColumn("unit", F.expr("concat(unit, '.', if(side = 2, other, own), '-', if(side = 2, own, other))"))
                 .withColumn("depth", F.col("depth") + 4))
        turn += 1
        units = scratch.write(child.select("fp", "trie", "first", "depth", "turned", "unit", "spent", "side"),
                              f"units{turn}")
    out = edges[0]
    for e in edges[1:]:
        out = out.unionByName(e)
    return out


def _labelled(docs: DataFrame, words: int, max_bits: int, id_col: str, text_col: str, scratch: Scratch):
    """(rows, labels): the fingerprint of each row, and per fingerprint that
    links to another or occurs twice its component's smallest id."""
    rows = scratch.write(fingerprints(docs, words, id_col, text_col), "rows")
    per_fp = scratch.write(rows.groupBy("fp").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n")), "distinct")
    labels = components(links(per_fp.select("fp"), max_bits), scratch)
    named = per_fp.join(labels.withColumnRenamed("node", "fp"), "fp", "left").withColumn(
        "root", F.coalesce("label", "fp")).filter("label is not null or n > 1")
    roots = named.groupBy("root").agg(F.min("least").alias("component_id"))
    return rows, named.join(roots, "root").select("fp", "root", "component_id")


def simhash_components(docs: DataFrame, words: int = 4, max_bits: int = 4, id_col: str = "doc_id",
                       text_col: str = "text") -> DataFrame:
    """One row per document: id, ``fingerprint`` (16 hex digits) and
    ``component_id``, the smallest id that links reach."""
    scratch = Scratch(docs.sparkSession, "simhash")
    rows, labels = _labelled(docs, words, max_bits, id_col, text_col, scratch)
    labels = scratch.write(labels, "labels").withColumn("grouped", F.lit(True))
    out = rows.join(labels, "fp", "left")
    return out.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
                      F.when(F.col("grouped"), F.col("component_id")).otherwise(F.col("id")).alias("component_id"))


def simhash_dedup(docs: DataFrame, words: int = 4, max_bits: int = 4, id_col: str = "doc_id",
                  text_col: str = "text") -> DataFrame:
    """The rows that stay, one of each component: that with the smallest id,
    of several such (or of null ids only) the smallest text hash, then the
    smallest by all columns. The rows that go are few and narrow (id and text
    hash), so whole rows are neither written nor shuffled while their number
    allows a broadcast."""
    scratch = Scratch(docs.sparkSession, "simhash")
    text = F.col(text_col).cast("string")
    md5 = F.md5(F.coalesce(text, F.lit("")))
    keyed = docs.select(F.struct(F.col(id_col).alias("id"), md5.alias("h")).alias("key"), text.alias("text"))
    rows = scratch.write(fingerprints(keyed, words, "key", "text").select("id.id", "id.h", "fp"), "rows")
    per_fp = scratch.write(rows.groupBy("fp").agg(
        F.min(F.struct(F.col("id").isNull().alias("null"), "id", "h")).alias("least"), F.count(F.lit(1)).alias("n")), "distinct")
    labels = components(links(per_fp.select("fp"), max_bits), scratch)
    stays = (per_fp.join(labels, per_fp.fp == labels.node, "left")
             .groupBy(F.coalesce("label", "fp").alias("root")).agg(F.min("least").alias("least")).select("least.id", "least.h"))
    same = lambda a, b: a["id"].eqNullSafe(b["id"]) & (a["h"] == b["h"])
    per_key = rows.groupBy("id", "h").agg(F.count(F.lit(1)).alias("n"))
    per_key = scratch.write(per_key.alias("a").join(stays.withColumn("stays", F.lit(True)).alias("b"), (
        F.col("a.id").eqNullSafe(F.col("b.id")) & (F.col("a.h") == F.col("b.h"))), "left")
        .select("a.id", "a.h", "a.n", "b.stays").filter("stays is null or n > 1"), "not-plain")
    gone, twice = per_key.filter("stays is null").select("id", "h"), per_key.filter("stays").select("id", "h")
    n_gone, n_twice = gone.count(), twice.count()
    gone, twice = small(gone, n_gone), small(twice, n_twice)
    full = packed(docs, id=F.col(id_col), h=md5)
    kept = full.join(gone, same(full, gone), "left_anti")
    if not n_twice:
        return kept.select("row.*")
    once = kept.join(twice, same(kept, twice), "left_anti").select("row.*")
    again = kept.join(twice, same(kept, twice), "left_semi").groupBy("id", "h").agg(F.min("row").alias("row"))
    return once.union(again.select("row.*"))
