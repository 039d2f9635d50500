"""Near-duplicate classes by an exact join on the Jaccard similarity of word shingles.

Two texts link if the sets of their 5-word shingles (ASCII letters in lower case; a
shorter text is one shingle) have a Jaccard similarity of 0.8 or more; classes are
the connected components of all links.  Nothing is sampled or capped.

Candidates come from prefixes: if both texts list their shingles in one global
order, a linked pair shares a shingle among the first n - ceil(0.8 n) + 1 of each.
The order is by a sketch of all shingle counts (2^20 buckets, levels of an
eighth of a power of two), rarest first, so common lines are hardly ever in a
prefix; ties go by hash.  Equal sets are one node, named by a 64-bit hash.

The first candidates are the links of SimHash fingerprints of the same shingles, found by the binary trie
self-join of simhash.py: a spanning forest of the fingerprints at SIMHASH_BITS or fewer differing bits, nodes of one
fingerprint in a star.  They are compared set by set like all others.  Fingerprints alone can't tell the similarity, so the prefixes
find what they miss.

Every prefix shingle that two nodes share is a run; the smaller set of a pair needs an
even shorter prefix.  After the fingerprints, in two rounds, each row of a run meets only the nearest row before it that is in
another class, in an order that differs from run to run but for sizes, and each node is compared with the likeliest few
it met: that joins most of a large class at a cost linear in its rows.  Then all
pairs of a run whose nodes are still in different classes meet.  Sizes, places within the
order, and 512-bit parity maps of the sets (sets whose maps differ in d bits differ in d
elements or more) drop pairs that cannot reach the similarity; the others are compared set by
set.  Texts of nodes to be compared are found by a bitmap of their hashes, of MAP_BITS at most.

Nulls: a null text has no words; texts without words are one class.  Null ids take
part; a class without any other id keeps one row.  Repeated rows count once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from math import ceil, log2

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import textvec as tv
from .common import small, small_batches, stored
from .simhash import components, fingerprints_of
from .simhash import links as trie_links

_U = np.uint64
_STEP = 0x9E3779B97F4A7C15
_BUCKETS, _CHUNKS = 1 << 20, 16
#: 64-bit words of a parity map.
_WORDS = 8
#: Bits in which fingerprints that link differ at most.
SIMHASH_BITS = 4
#: Nodes that a node is compared with before all pairs of mixed runs are.
TRIED = 3
#: Rounds of that.
TURNS = 2
#: Binary logarithm of the bits with which texts are looked up, at most: 16 MB.
MAP_BITS = 27


def shingle_sets(part: tv.Slice, shingle: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, sizes): the distinct shingles of each text of a slice, ascending within a text."""
    w = tv.words(part)
    if not len(w.starts):
        return np.zeros(0, np.uint64), np.zeros(len(part), np.int64)
    word = tv.hashes(part, w.starts, w.ends, lower=True)
    n = np.where(w.counts > 0, np.maximum(w.counts - shingle + 1, 1), 0)
    text = np.repeat(np.arange(len(part)), n)
    first = (np.cumsum(w.counts) - w.counts)[text] + np.arange(len(text)) - (np.cumsum(n) - n)[text]
    length = np.minimum(shingle, w.counts[text])
    h = length.astype(np.uint64)
    for k in range(shingle):
        has = length > k
        h[has] = h[has] * _U(_STEP) + word[first[has] + k]
    order, new = tv.grouped(tv.mix(h), text)
    keep = order[new]
    return tv.mix(h[keep]), np.bincount(text[keep], minlength=len(part))


def set_names(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """One 64-bit name for each set of shingles; the empty set is 0."""
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(tv.mix(hashes ^ _U(_STEP)), dtype=np.uint64)])
    ends = np.cumsum(sizes)
    return np.where(sizes > 0, tv.mix(sums[ends] - sums[ends - sizes] + sizes.astype(np.uint64)), _U(0))


def parity_maps(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """For each set, bit k of _WORDS * 64: whether an odd number of its elements fall on k."""
    width = 64 * _WORDS
    out = np.zeros((len(sizes), width // 8), np.uint8)
    ends = np.cumsum(sizes)
    for a in range(0, len(sizes), 256):  # bounded scratch space
        z = min(a + 256, len(sizes))
        part = hashes[ends[a] - sizes[a] : ends[z - 1]]
        at = np.repeat(np.arange(z - a), sizes[a:z]) * width + (tv.mix(part ^ _U(0xA5A5A5A55A5A5A5A)) & _U(width - 1)).astype(np.int64)
        odd = (np.bincount(at, minlength=(z - a) * width) & 1).astype(np.uint8)
        out[a:z] = np.packbits(odd.reshape(z - a, width), axis=1, bitorder="little")
    return out


def least_common(n: np.ndarray, m: np.ndarray, tenths: int) -> np.ndarray:
    """The fewest common elements with which sets of n and m have a Jaccard similarity of tenths / 10 or more."""
    return -(-tenths * (n + m) // (10 + tenths))


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, h, text): id and h (a hash of the text) name the row."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return small_batches(docs).select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("h"), text.alias("text"))


def _nodes(rows: DataFrame, shingle: int) -> DataFrame:
    """(id, h, node, n, bits, fp) for each row, and (chunk, counts) of each task's sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = np.zeros(_BUCKETS, np.int32)
        for b in batches:
            names, sizes, maps, fps = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros((0, 8 * _WORDS), np.uint8)], [np.zeros(0, np.uint64)]
            for s in tv.slices(b.column(2)):
                sets, n = shingle_sets(s, shingle)
                np.add.at(sketch, (sets >> _U(44)).astype(np.int64), 1)
                names.append(set_names(sets, n))
                sizes.append(n)
                maps.append(parity_maps(sets, n))
                fps.append(fingerprints_of(s, shingle))
            k = b.num_rows
            bits = pa.FixedSizeBinaryArray.from_buffers(pa.binary(8 * _WORDS), k, [None, pa.py_buffer(np.concatenate(maps).tobytes())]).cast(pa.binary())
            cols = [b.column(0), b.column(1), pa.array(np.concatenate(names).view(np.int64)), pa.array(np.concatenate(sizes)), bits, pa.array(np.concatenate(fps).view(np.int64))]
            yield pa.RecordBatch.from_arrays([*cols, pa.nulls(k, pa.int32()), pa.nulls(k, pa.binary())], names=out)
        if sketch.any():
            blank = [*[pa.nulls(_CHUNKS, pa.int64())] * 4, pa.nulls(_CHUNKS, pa.binary()), pa.nulls(_CHUNKS, pa.int64())]
            yield pa.RecordBatch.from_arrays([*blank, pa.array(range(_CHUNKS), pa.int32()), pa.array([c.tobytes() for c in np.split(sketch, _CHUNKS)], pa.binary())], names=out)

    out = ["id", "h", "node", "n", "bits", "fp", "chunk", "counts"]
    return rows.mapInArrow(run, "id long, h long, node long, n long, bits binary, fp long, chunk int, counts binary")


def _levels(sketches: DataFrame) -> np.ndarray:
    """The level of each bucket: eight times the binary logarithm of its count."""

    def add(group: pa.Table) -> pa.Table:
        total = np.zeros(_BUCKETS // _CHUNKS, np.int64)
        for c in group.column("counts"):
            total += np.frombuffer(c.as_py(), np.int32)
        level = np.minimum(np.round(8 * np.log2(np.maximum(total, 1))), 255).astype(np.uint8)
        return pa.table({"chunk": group.column("chunk").slice(0, 1), "levels": pa.array([level.tobytes()], pa.binary())})

    got = sketches.groupBy("chunk").applyInArrow(add, "chunk int, levels binary").collect()
    return np.concatenate([np.frombuffer(r["levels"], np.uint8) for r in sorted(got, key=lambda r: r["chunk"])]) if got else np.zeros(_BUCKETS, np.uint8)


def _prefixes(rows: DataFrame, levels: np.ndarray, shingle: int, tenths: int) -> DataFrame:
    """(s, node, n, at): the prefix of each node, a node once a task; at is the place in the order."""
    shared = rows.sparkSession.sparkContext.broadcast(levels.tobytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level = np.frombuffer(shared.value, np.uint8)
        seen: set[int] = set()
        for b in batches:
            for part in tv.slices(b.column(2)):
                sets, sizes = shingle_sets(part, shingle)
                names = set_names(sets, sizes)
                fresh = np.zeros(len(part), bool)
                for k, name in enumerate(names.tolist()):
                    if name not in seen:
                        seen.add(name)
                        fresh[k] = True
                text = np.repeat(np.arange(len(part)), sizes)
                order = np.lexsort((sets, level[(sets >> _U(44)).astype(np.int64)], text))  # text stays ascending
                at = np.arange(len(sets)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                keep = np.flatnonzero(fresh[text] & (at < (sizes - -(-tenths * sizes // 10) + 1)[text]))
                t = text[keep]
                cols = [sets[order[keep]].view(np.int64), names[t].view(np.int64), sizes[t].astype(np.int32), at[keep].astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["s", "node", "n", "at"])

    return rows.mapInArrow(run, "s long, node long, n int, at int")


def _matrix(maps: pa.Array) -> np.ndarray:
    """Parity maps as rows of 64-bit words."""
    return np.frombuffer(maps.buffers()[2], np.uint64, len(maps) * _WORDS, maps.offset * 8 * _WORDS).reshape(-1, _WORDS)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """Columns of batches that are sorted by their first column, cut so that no run of it is split."""
    held: list[list[np.ndarray]] = []
    for b in batches:
        if not b.num_rows:
            continue
        cols = [_matrix(c) if pa.types.is_binary(c.type) else c.to_numpy(zero_copy_only=False) for c in b.columns]
        cut = int(np.searchsorted(cols[0], cols[0][-1]))
        if held and (cut or held[-1][0][-1] != cols[0][0]):
            if cut == 0:
                yield [np.concatenate(c) for c in zip(*held, strict=True)]
                held = [cols]
                continue
            held.append([c[:cut] for c in cols])
            yield [np.concatenate(c) for c in zip(*held, strict=True)]
            held = [[c[cut:] for c in cols]]
        elif cut and not held:
            yield [c[:cut] for c in cols]
            held = [[c[cut:] for c in cols]]
        else:
            held.append(cols)
    if held:
        yield [np.concatenate(c) for c in zip(*held, strict=True)]


@dataclass
class _Run:
    """Rows of runs (in the order of size within a run): shingle, set size, node, place of the shingle in the node's order, class, and parity map."""

    s: np.ndarray
    n: np.ndarray
    node: np.ndarray
    at: np.ndarray
    root: np.ndarray
    bits: np.ndarray | None = None

    def possible(self, i: np.ndarray, j: np.ndarray, tenths: int) -> np.ndarray:
        """Which rows i and j of one run can be of nodes with the similarity in different classes."""
        n, m = self.n[i].astype(np.int64), self.n[j].astype(np.int64)
        less = np.minimum(n, m)
        least = least_common(n, m, tenths)
        most = np.minimum(self.at[i], self.at[j]) + np.minimum(n - self.at[i], m - self.at[j])
        ok = (self.root[i] != self.root[j]) & (most >= least) & (np.where(n <= m, self.at[i], self.at[j]) <= less + 2 * tenths * -less // (10 + tenths))
        if self.bits is None:
            return ok
        k = np.flatnonzero(ok)
        apart = np.bitwise_count(self.bits[i[k]] ^ self.bits[j[k]]).sum(1, dtype=np.int64)
        ok[k] = n[k] + m[k] - apart >= 2 * least[k]
        return ok

    def pairs(self, i: np.ndarray, j: np.ndarray) -> pa.RecordBatch:
        a, b = self.node[i], self.node[j]
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])


_SHARED = "s long, n int, node long, at int"


def _in_runs(df: DataFrame, step: Callable[..., Iterator[pa.RecordBatch]], schema: str, *order: str | Column) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cols in _runs(batches):
            yield from step(cols)

    return df.repartition("s").sortWithinPartitions("s", *(order or ("n", "node"))).mapInArrow(run, schema)


def _shared(prefixes: DataFrame) -> DataFrame:
    """The rows of runs with two nodes or more, each once."""

    def step(cols: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        s, n, node, at = cols
        new = np.ones(len(s), bool)
        new[1:] = (s[1:] != s[:-1]) | (node[1:] != node[:-1])
        s, n, node, at = s[new], n[new], node[new], at[new]
        same = np.concatenate([[False], s[1:] == s[:-1], [False]])
        ok = same[1:] | same[:-1]
        if ok.any():
            yield pa.RecordBatch.from_arrays([pa.array(c[ok]) for c in (s, n, node, at)], names=["s", "n", "node", "at"])

    return _in_runs(prefixes.select("s", "n", "node", "at"), step, _SHARED)


def _by_fingerprints(nodes: DataFrame) -> DataFrame:
    """(a, b): each node with the least of its fingerprint, and the least of fingerprints that the trie join links."""
    firsts = stored(nodes.groupBy("fp").agg(F.min("node").alias("first")), "fingerprints")
    same = nodes.join(firsts, "fp").where("node <> first").select(F.col("first").alias("x"), F.col("node").alias("y"))
    near = trie_links(firsts, SIMHASH_BITS)
    for c in "ab":
        near = near.join(firsts.select(F.col("fp").alias(c), F.col("first").alias(f"first_{c}")), c)
    both = same.unionByName(near.select(F.col("first_a").alias("x"), F.col("first_b").alias("y")))
    return both.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def _neighbours(rooted: DataFrame, tenths: int, turn: int) -> DataFrame:
    """(a, b): each row of a run with the nearest row before it in another class, by levels of size and within one by a hash of node, run and turn."""

    def step(cols: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        r = _Run(*cols)
        i = np.arange(len(r.s))
        new_run = np.concatenate([[True], r.s[1:] != r.s[:-1]])
        streak = np.maximum.accumulate(np.where(new_run | np.concatenate([[True], r.root[1:] != r.root[:-1]]), i, 0))
        has = np.flatnonzero(~new_run[streak])
        before = streak[has] - 1
        ok = r.possible(before, has, tenths)
        yield r.pairs(before[ok], has[ok])

    level = F.floor(F.log("n") * (10 / (10 - tenths)))  # sets that can link are two levels apart at most
    return _in_runs(rooted, step, "a long, b long", level, F.xxhash64("s", "node", F.lit(turn))).distinct()


def _mixed(rooted: DataFrame) -> DataFrame:
    """The rows of runs whose nodes are in different classes."""

    def step(cols: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        first = np.flatnonzero(np.concatenate([[True], cols[0][1:] != cols[0][:-1]]))
        mixed = np.minimum.reduceat(cols[4], first) != np.maximum.reduceat(cols[4], first)
        keep = np.repeat(mixed, np.diff(np.append(first, len(cols[0]))))
        if keep.any():
            yield pa.RecordBatch.from_arrays([pa.array(c[keep]) for c in cols], names=["s", "n", "node", "at", "root"])

    return _in_runs(rooted, step, _SHARED + ", root long")


def _across(rooted: DataFrame, nodes: DataFrame, tenths: int) -> DataFrame:
    """(a, b): nodes of one run that are in different classes."""

    def step(cols: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        r = _Run(*cols)
        ends = np.searchsorted(r.s, r.s, "right")
        # sizes ascend within a run, so the partners of a row end where m > 10 n / tenths
        stop = np.array([i + 1 + int(np.searchsorted(r.n[i + 1 : e], 10 * int(r.n[i]) // tenths, "right")) for i, e in enumerate(ends.tolist())], np.int64)
        count = stop - np.arange(len(stop)) - 1
        total = np.concatenate([[0], np.cumsum(count)])
        a = 0
        while a < len(count):  # rows with about a hundred thousand partners at a time
            z = max(a + 1, int(np.searchsorted(total, total[a] + 100_000, "right")) - 1)
            i = np.repeat(np.arange(a, z), count[a:z])
            j = i + 1 + np.arange(len(i)) - np.repeat(total[a:z] - total[a], count[a:z])
            ok = r.possible(i, j, tenths)
            if ok.any():
                yield r.pairs(i[ok], j[ok])
            a = z

    mixed = stored(_mixed(rooted), "mixed")
    bits = nodes.join(mixed.select("node").distinct(), "node", "left_semi").select("node", "bits")
    return _in_runs(mixed.join(bits, "node").select(*mixed.columns, "bits"), step, "a long, b long").distinct()


def _by_maps(pairs: DataFrame, nodes: DataFrame, tenths: int, tried: int | None = TRIED) -> DataFrame:
    """Of the pairs that their sizes and parity maps leave possible, for each b the `tried` likeliest (None: all)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, m = (b.column(c).to_numpy() for c in (2, 4))
            apart = np.bitwise_count(_matrix(b.column(3)) ^ _matrix(b.column(5))).sum(1, dtype=np.int64)
            ok = pa.array(n + m - apart >= 2 * least_common(n, m, tenths))
            yield pa.RecordBatch.from_arrays([*(b.column(c).filter(ok) for c in (0, 1)), pa.array(apart / np.maximum(n + m, 1)).filter(ok)], names=["a", "b", "apart"])

    sides = [nodes.select(F.col("node").alias(c), F.col("n").alias(f"n_{c}"), F.col("bits").alias(f"bits_{c}")) for c in "ab"]
    likely = pairs.join(sides[0], "a").join(sides[1], "b").select("a", "b", "n_a", "bits_a", "n_b", "bits_b").mapInArrow(run, "a long, b long, apart double")
    if tried is None:
        return likely.select("a", "b")
    return likely.withColumn("r", F.row_number().over(Window.partitionBy("b").orderBy("apart", "a"))).where(F.col("r") <= tried).select("a", "b")


def _bitmap(keys: DataFrame, bits: int) -> bytes:
    """2^bits bits, those of the keys' upper bits set."""
    parts = 16

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        there = np.zeros(1 << bits, bool)
        for b in batches:
            there[(b.column(0).to_numpy().view(np.uint64) >> _U(64 - bits)).astype(np.int64)] = True
        if there.any():
            yield pa.RecordBatch.from_arrays([pa.array(range(parts), pa.int32()), pa.array([x.tobytes() for x in np.split(np.packbits(there, bitorder="little"), parts)], pa.binary())], names=["part", "map"])

    def join(group: pa.Table) -> pa.Table:
        out = np.bitwise_or.reduce([np.frombuffer(x.as_py(), np.uint8) for x in group.column("map")])
        return pa.table({"part": group.column("part").slice(0, 1), "map": pa.array([out.tobytes()], pa.binary())})

    got = keys.mapInArrow(mark, "part int, map binary").groupBy("part").applyInArrow(join, "part int, map binary").collect()
    return b"".join(r["map"] for r in sorted(got, key=lambda r: r["part"])) if got else bytes(1 << (bits - 3))


def _links(pairs: DataFrame, nodes: DataFrame, rows: DataFrame, shingle: int, tenths: int) -> DataFrame:
    """The pairs whose sets have the similarity; the sets are read again from one row of each node."""

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in tv.slices(b.column(0)):
                sets, sizes = shingle_sets(part, shingle)
                ends = np.cumsum(sizes)
                found = [sets[e - n : e].tobytes() for e, n in zip(ends.tolist(), sizes.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(set_names(sets, sizes).view(np.int64)), pa.array(found, pa.binary())], names=["node", "set"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = np.zeros(b.num_rows, bool)
            for k in range(b.num_rows):
                x, y = (np.frombuffer(b.column(c)[k].as_buffer(), np.uint64) for c in (2, 3))
                both = np.sort(np.concatenate([x, y]))
                ok[k] = np.count_nonzero(both[1:] == both[:-1]) >= least_common(len(x), len(y), tenths)
            yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(ok)), b.column(1).filter(pa.array(ok))], names=["a", "b"])

    def only(shared: Broadcast, bits: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            there = np.frombuffer(shared.value, np.uint8)
            for b in batches:
                at = b.column(0).to_numpy().view(np.uint64) >> _U(64 - bits)
                yield b.filter(pa.array(there[at >> _U(3)] >> (at & _U(7)).astype(np.uint8) & 1 == 1))

        return run

    needed = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    one = nodes.join(needed, "node", "left_semi").select(F.col("least.id").alias("__id"), F.col("least.h").alias("__h"))
    one = stored(one, "needed")
    bits = min(MAP_BITS, max(16, ceil(log2(16 * one.count() + 1))))
    shared = rows.sparkSession.sparkContext.broadcast(_bitmap(one.select(F.xxhash64("__id", "__h").alias("key")), bits))
    found = rows.select(F.xxhash64("id", "h").alias("key"), "id", "h", "text").mapInArrow(only(shared, bits), "key long, id long, h long, text string")
    texts = found.join(small(one).hint("shuffle_hash"), F.col("id").eqNullSafe(F.col("__id")) & (F.col("h") == F.col("__h")), "left_semi")
    sets = stored(texts.dropDuplicates(["id", "h"]).select("text").mapInArrow(sets_of, "node long, set binary"), "shingles")
    a, b = (sets.select(F.col("node").alias(c), F.col("set").alias(f"set_{c}")) for c in "ab")
    return pairs.join(a, "a").join(b, "b").select("a", "b", "set_a", "set_b").mapInArrow(compare, "a long, b long")


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, tenths: int = 8) -> DataFrame:
    """(id, h, node, root) for every row of docs: h is xxhash64 of its text, root names the class."""
    rows = _rows(docs, id_col, text_col)
    both = stored(_nodes(rows, shingle), "sets")
    named = both.where("chunk IS NULL").select("id", "h", "node", "n")
    least = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "h")).alias("least")
    nodes = stored(both.where("chunk IS NULL").groupBy("node").agg(least, F.first("n").alias("n"), F.first("bits").alias("bits"), F.min("fp").alias("fp")), "nodes")  # rows of a node have one size and map; of fingerprints (repeats count there) the least
    levels = _levels(both.where("chunk IS NOT NULL").select("chunk", "counts"))
    shared = stored(_shared(_prefixes(rows, levels, shingle, tenths)), "shared")
    rooted, links = shared.withColumn("root", F.col("node")), None
    for turn in range(-1, TURNS + 1):
        if turn < 0:
            pairs = _by_maps(_by_fingerprints(nodes), nodes, tenths, None)
        else:
            pairs = _by_maps(_neighbours(rooted, tenths, turn), nodes, tenths) if turn < TURNS else _across(rooted, nodes, tenths)
        found = stored(_links(stored(pairs, "pairs"), nodes, rows, shingle, tenths), "links")
        links = found if links is None else links.union(found)
        roots = components(links).withColumnRenamed("node", "__node")
        rooted = shared.join(small(roots), F.col("node") == F.col("__node"), "left").select(*shared.columns, F.coalesce("root", "node").alias("root"))
    return named.join(roots, F.col("node") == F.col("__node"), "left").select("id", "h", "node", F.coalesce("root", "node").alias("root"))


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, tenths: int = 8) -> DataFrame:
    """One row of docs of each class: that with the smallest id (then the smallest hash of its text); null ids come last."""
    least = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "h"))
    keep = stored(classes(docs, id_col, text_col, shingle, tenths).groupBy("root").agg(least.alias("least")).select("least.*"), "kept")
    keys = {"__id": F.coalesce(F.col(id_col).cast("long"), F.lit(0)), "__none": F.col(id_col).isNull(), "__h": F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit("")))}
    keep = keep.select(F.coalesce("id", F.lit(0)).alias("__id"), F.col("none").alias("__none"), F.col("h").alias("__h"))
    kept = docs.withColumns(keys).join(keep.hint("shuffle_hash"), list(keys), "left_semi").dropDuplicates(list(keys))
    return kept.select(*docs.columns)
