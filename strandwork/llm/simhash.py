"""SimHash near-duplicate classes by a binary trie self-join.

Fingerprints (64 bits) are the bitwise majority over XXH64 values of word
shingles.  Two fingerprints link at max_bits or fewer differing bits.  Links are
found by traversing a binary trie against itself: pairs of nodes descend
together one bit at a time, differing bits accumulate, and a pair is dropped
once its error budget is exceeded.  As a link with at most k errors has at most
k // 2 of them in one half of the bits, two tries (the bits as they are, and
with the halves swapped) are traversed with budget k // 2 in the upper half and k
in all, which keeps the pairs alive few.

Distribution: the top levels of both tries are cut into subtries; each pair of
subtries within the budget is one group.  Pairs that hold too many fingerprints
are cut further, six levels at a time, until none does.  Exact copies are one leaf, and a group
returns a spanning forest of its links, so output is linear in fingerprints
whatever the size of a class.  Classes come from min-label propagation with
star contraction over stored tables; nothing but counts reaches the driver.

Nulls: a null text has no words and fingerprint zero; null ids take part and get
the class of their fingerprint (null if it has no other id).  Repeated rows give
repeated result rows.  Empty tables give empty results.  Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import ceil, comb, log2

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textvec as tv
from .common import small, small_batches, stored

_P1, _P2, _P3, _P4, _P5 = (np.uint64(x) for x in (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261))
_U = np.uint64


def _rotl(x: np.ndarray, r: int) -> np.ndarray:
    return (x << _U(r)) | (x >> _U(64 - r))


def xxh64(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 42) -> np.ndarray:
    """XXH64 of each byte span of data."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    wide = np.ndarray(len(padded) - 7, "<u8", padded, strides=(1,))
    length = (ends - starts).astype(np.uint64)
    with np.errstate(over="ignore"):
        h = length + _U(seed) + _P5
        at = starts.copy()
        big = np.flatnonzero(length >= _U(32))
        if len(big):
            stripes = (length[big] >> _U(5)).astype(np.int64)
            pos = starts[big].copy()
            v = [np.full(len(big), (seed + x) % 2**64, np.uint64) for x in (int(_P1) + int(_P2), int(_P2), 0, -int(_P1))]
            live, turn = np.arange(len(big)), 0
            while len(live):
                for k in range(4):
                    v[k][live] = _rotl(v[k][live] + wide[pos[live] + 8 * k] * _P2, 31) * _P1
                pos[live] += 32
                turn += 1
                live = live[stripes[live] > turn]
            m = _rotl(v[0], 1) + _rotl(v[1], 7) + _rotl(v[2], 12) + _rotl(v[3], 18)
            for k in range(4):
                m = (m ^ (_rotl(v[k] * _P2, 31) * _P1)) * _P1 + _P4
            h[big] = m + length[big]
            at[big] = pos
        left = ends - at
        for turn in range(3):
            i = np.flatnonzero(left >= 8)
            if not len(i):
                break
            h[i] = _rotl(h[i] ^ (_rotl(wide[at[i]] * _P2, 31) * _P1), 27) * _P1 + _P4
            at[i] += 8
            left[i] -= 8
        i = np.flatnonzero(left >= 4)
        h[i] = _rotl(h[i] ^ ((wide[at[i]] & _U(0xFFFFFFFF)) * _P1), 23) * _P2 + _P3
        at[i] += 4
        left[i] -= 4
        for turn in range(3):
            i = np.flatnonzero(left >= 1)
            if not len(i):
                break
            h[i] = _rotl(h[i] ^ ((wide[at[i]] & _U(0xFF)) * _P5), 11) * _P1
            at[i] += 1
            left[i] -= 1
        h = (h ^ (h >> _U(33))) * _P2
        h = (h ^ (h >> _U(29))) * _P3
        return h ^ (h >> _U(32))


def fingerprints_of(part: tv.Slice, shingle: int = 4) -> np.ndarray:
    """The fingerprint of each text of a slice."""
    w = tv.words(part)
    out = np.zeros(len(part), np.uint64)
    if not len(w.starts):
        return out
    size = w.ends - w.starts + 1
    new_ends = np.cumsum(size)
    new_starts = new_ends - size
    stream = tv._LOWER[part.data[np.minimum(np.repeat(w.starts - new_starts, size) + np.arange(new_ends[-1]), len(part.data) - 1)]]
    stream[new_ends - 1] = 32
    n_shingles = np.where(w.counts > 0, np.maximum(w.counts - shingle + 1, 1), 0)
    text_first = np.cumsum(w.counts) - w.counts
    sh_first = np.cumsum(n_shingles) - n_shingles
    text = np.repeat(np.arange(len(part)), n_shingles)
    first = text_first[text] + np.arange(len(text)) - sh_first[text]
    last = np.minimum(first + shingle, text_first[text] + w.counts[text]) - 1
    h = xxh64(stream, new_starts[first], new_ends[last] - 1)
    bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    full = np.flatnonzero(n_shingles)
    ones = np.add.reduceat(bits, sh_first[full], axis=0, dtype=np.int32)
    major = (2 * ones > n_shingles[full][:, None]).astype(np.uint8)
    out[full] = np.packbits(major, axis=1, bitorder="little").view("<u8").ravel()
    return out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4) -> DataFrame:
    """(id, fp): fp is the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = [fingerprints_of(s, shingle) for s in tv.slices(b.column(1))]
            fp = np.concatenate(fps) if fps else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], names=["id", "fp"])

    src = small_batches(docs).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return src.mapInArrow(run, "id long, fp long")


class _Forest:
    """Union-find over numpy arrays, by rounds of minimum labels."""

    def __init__(self, n: int) -> None:
        self.label = np.arange(n)
        self.edges: list[np.ndarray] = []

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        """Joins a[i] with b[i]; keeps only edges that join two classes."""
        while len(a):
            la, lb = self.label[a], self.label[b]
            differ = la != lb
            a, b, la, lb = a[differ], b[differ], la[differ], lb[differ]
            if not len(a):
                return
            hi, lo = np.maximum(la, lb), np.minimum(la, lb)
            _, first = np.unique(hi, return_index=True)
            self.edges.append(np.stack([a[first], b[first]], 1))
            self.label[hi[first]] = lo[first]
            while True:
                up = self.label[self.label]
                if np.array_equal(up, self.label):
                    break
                self.label = up


def trie_links(values: np.ndarray, left: np.ndarray, right: np.ndarray | None, depth: int, max_bits: int, block: int = 1 << 18) -> np.ndarray:
    """A spanning forest (pairs of places) of the links between two subtries, or within one.

    values: sorted distinct keys (already rotated); left and right: (low, high) ranges
    of the subtries, which share their own upper `depth` bits (right None: left with itself).
    """
    forest = _Forest(len(values))
    if len(values) > 1:  # neighbours first: most of a tight class joins before the traversal
        for step in (1, 2, 3):
            a = np.arange(len(values) - step)
            near = np.bitwise_count(values[a] ^ values[a + step]) <= max_bits
            forest.add(a[near], a[near] + step)
    half = max_bits // 2
    same = right is None
    start = (np.array([left[0]]), np.array([left[1]]), np.array([left[0] if same else right[0]]), np.array([left[1] if same else right[1]]))
    errs = np.zeros(1, np.int64) if same else np.bitwise_count((values[start[0]] ^ values[start[2]]) >> _U(64 - depth)).astype(np.int64) if depth else np.zeros(1, np.int64)
    if not same and depth and (errs[0] > max_bits or np.bitwise_count((values[start[0]] ^ values[start[2]]) >> _U(64 - min(depth, 32)))[0] > half):
        return np.zeros((0, 2), np.int64)
    stack = [(depth, *start, errs)]
    ones = {}

    def split(lo: np.ndarray, hi: np.ndarray, d: int) -> np.ndarray:
        if d not in ones:
            ones.clear() if len(ones) > 8 else None
            ones[d] = np.concatenate([[0], np.cumsum((values >> _U(63 - d)) & _U(1), dtype=np.int64)])
        return hi - (ones[d][hi] - ones[d][lo])

    while stack:
        d, alo, ahi, blo, bhi, err = stack.pop()
        while len(alo):
            leaf = (ahi - alo == 1) & (bhi - blo == 1)
            if leaf.any():
                a, b = alo[leaf], blo[leaf]
                x = values[a] ^ values[b]
                ok = (np.bitwise_count(x) <= max_bits) & (a != b)
                forest.add(a[ok], b[ok])
                alo, ahi, blo, bhi, err = (v[~leaf] for v in (alo, ahi, blo, bhi, err))
            if not len(alo) or d == 64:
                break
            # pairs of nodes that already lie in one class can add nothing
            first, last = forest.label[alo], forest.label[bhi - 1]
            maybe = first == last
            if maybe.any() and d % 4 == 0:
                change = np.concatenate([[0], np.cumsum(forest.label[1:] != forest.label[:-1])])
                done = maybe & (change[alo] == change[ahi - 1]) & (change[blo] == change[bhi - 1])
                alo, ahi, blo, bhi, err = (v[~done] for v in (alo, ahi, blo, bhi, err))
            if len(alo) > block:
                cut = len(alo) // 2
                stack.append((d, alo[cut:], ahi[cut:], blo[cut:], bhi[cut:], err[cut:]))
                alo, ahi, blo, bhi, err = (v[:cut] for v in (alo, ahi, blo, bhi, err))
            am, bm = split(alo, ahi, d), split(blo, bhi, d)
            own = (alo == blo) & (ahi == bhi)
            budget = half if d < 32 else max_bits
            parts = []
            for x0, x1, y0, y1, more, keep in ((alo, am, blo, bm, 0, None), (am, ahi, bm, bhi, 0, None), (alo, am, bm, bhi, 1, None), (am, ahi, blo, bm, 1, ~own)):
                ok = (x1 > x0) & (y1 > y0) & (err + more <= budget)
                if keep is not None:
                    ok &= keep
                parts.append((x0[ok], x1[ok], y0[ok], y1[ok], err[ok] + more))
            alo, ahi, blo, bhi, err = (np.concatenate(p) for p in zip(*parts, strict=True))
            single = (ahi - alo == 1) & (bhi - blo == 1) & (alo == blo)
            if single.any():
                alo, ahi, blo, bhi, err = (v[~single] for v in (alo, ahi, blo, bhi, err))
            d += 1
    return np.concatenate(forest.edges) if forest.edges else np.zeros((0, 2), np.int64)


def _swapped(fp: np.ndarray) -> np.ndarray:
    return (fp << _U(32)) | (fp >> _U(32))


def links(fps: DataFrame, max_bits: int = 4, subtrie_rows: int = 8192, count: int | None = None, most: int = 65_536) -> DataFrame:
    """(a, b): links between distinct fingerprints that span every class; fps has one distinct column fp.

    A pair of subtries with more than `most` fingerprints is cut into pairs of deeper ones.
    """
    n = fps.count() if count is None else count
    depth = min(20, max(4, ceil(log2(max(n, 1) / subtrie_rows)))) if n else 4
    half = max_bits // 2
    masks = np.array([m for m in range(1 << depth) if bin(m).count("1") <= half], np.uint64)
    assert len(masks) == sum(comb(depth, k) for k in range(half + 1))
    schema = "turn int, lo long, hi long, upper boolean, fp long"

    names = ["turn", "lo", "hi", "upper", "fp"]

    def paired(own: np.ndarray, turn: int, fp: np.ndarray) -> pa.RecordBatch:
        """Each fingerprint with each pair of subtries that it belongs to; upper: it lies in the second of two."""
        other = own[:, None] ^ masks
        lo, hi = np.minimum(own[:, None], other), np.maximum(own[:, None], other)
        cols = [np.full(lo.size, turn, np.int32), lo.ravel().view(np.int64), hi.ravel().view(np.int64), (own[:, None] > other).ravel(), np.repeat(fp, len(masks)).view(np.int64)]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=names)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for at in range(0, len(fp), 20_000):
                part = fp[at : at + 20_000]
                for turn in (0, 1):
                    yield paired((_swapped(part) if turn else part) >> _U(64 - depth), turn, part)

    def deeper(depth: int, more: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                turn, lo, hi, _, fp = (c.to_numpy(zero_copy_only=False) for c in b.columns)
                lo, hi, fp = lo.view(np.uint64), hi.view(np.uint64), fp.view(np.uint64)
                key = np.where(turn == 1, _swapped(fp), fp)
                own = key >> _U(64 - depth - more)
                across = np.bitwise_count(lo ^ hi)
                for err in np.unique(across).tolist():
                    # of the budget for the upper half and in all, what the levels so far have left
                    mine = np.flatnonzero(across == err)
                    top = (lo ^ hi)[mine] << _U(more)
                    extra = [m for m in range(1 << more) if bin(m).count("1") + err <= max_bits]
                    for m in extra:
                        other = own[mine] ^ top ^ _U(m)
                        ok = np.bitwise_count((own[mine] ^ other) >> _U(max(0, depth + more - 32))) <= half
                        if err == 0:  # a subtrie with itself: either child may be the lower one
                            a, z = np.minimum(own[mine], other), np.maximum(own[mine], other)
                        else:
                            upper = own[mine] >> _U(more) == hi[mine]
                            a, z = np.where(upper, other, own[mine]), np.where(upper, own[mine], other)
                        cols = [turn[mine][ok], a[ok].view(np.int64), z[ok].view(np.int64), (own[mine] > a)[ok], fp[mine][ok].view(np.int64)]
                        yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=names)

        return run

    def meet(depth: int) -> Callable[[pa.Table], pa.Table]:
        def run(group: pa.Table) -> pa.Table:
            turn, lo, hi = (group.column(c)[0].as_py() % 2**64 for c in ("turn", "lo", "hi"))
            v = group.column("fp").to_numpy().view(np.uint64)
            v = np.sort(_swapped(v) if turn else v)
            cut = int(np.searchsorted(v, _U(hi << (64 - depth)))) if hi != lo else 0
            if hi == lo:
                pairs = trie_links(v, (0, len(v)), None, depth, max_bits)
            elif 0 < cut < len(v):
                pairs = trie_links(v, (0, cut), (cut, len(v)), depth, max_bits)
            else:
                pairs = np.zeros((0, 2), np.int64)
            ends = [_swapped(v[pairs[:, k]]) if turn else v[pairs[:, k]] for k in (0, 1)]
            return pa.table({"a": ends[0].view(np.int64), "b": ends[1].view(np.int64)})

        return run

    key = ["turn", "lo", "hi"]
    rows, out = fps.select("fp").mapInArrow(deal, schema), None
    while True:
        counts = rows.groupBy(*key).agg(F.count("*").alias("n"), F.count_if("upper").alias("uppers"))
        one_sided = (F.col("lo") != F.col("hi")) & ((F.col("uppers") == 0) | (F.col("uppers") == F.col("n")))
        full = stored(counts.where(F.col("n") > most).select(*key, one_sided.alias("one_sided")), "full-subtries")
        some = depth < 64 and not full.isEmpty()
        light = rows.join(small(full), key, "left_anti") if some else rows
        found = light.groupBy(*key).applyInArrow(meet(depth), "a long, b long")
        out = found if out is None else out.unionByName(found)
        if not some:
            return out
        more = min(6, 64 - depth)
        rows = stored(rows.join(small(full.where("not one_sided")), key, "left_semi").mapInArrow(deeper(depth, more), schema), "deeper-subtries")
        depth += more


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root): the smallest node reachable from each node that has an edge.

    Alternates large-star and small-star steps; each is a minimum per node (pre-aggregated before its
    shuffle) and an equi-join, and each round is a stored table.
    """
    e = stored(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "links")
    seen = None
    for _ in range(max_rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = stored(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "lows")
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = stored(large, "large")
        low = stored(large.groupBy("u").agg(F.min("v").alias("m")), "lows")
        small_star = large.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        e = stored(small_star, "links")
        state = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root"))


def hex16(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def _rooted(docs: DataFrame, id_col: str, text_col: str, shingle: int, max_bits: int) -> DataFrame:
    """(id, fp, component_id, root) for every row of docs; root names the class, whatever its ids."""
    fps = stored(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    nodes = stored(fps.groupBy("fp").agg(F.min("id").alias("least")), "nodes")
    roots = components(links(nodes, max_bits))
    labelled = stored(nodes.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root")), "labels")
    lowest = labelled.groupBy("root").agg(F.min("least").alias("component_id"))
    named = labelled.join(lowest, "root").select("fp", "component_id", "root")
    return fps.join(named, "fp").select("id", "fp", "component_id", "root")


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, max_bits: int = 4) -> DataFrame:
    """(id, fp, component_id) for every row of docs."""
    return _rooted(docs, id_col, text_col, shingle, max_bits).select("id", "fp", "component_id")


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, max_bits: int = 4) -> DataFrame:
    """One row of docs of each class: that with the smallest id, then fingerprint; a class without ids keeps one row."""

    @F.pandas_udf("long")
    def fingerprint(text):  # noqa: ANN001, ANN202
        fps = [fingerprints_of(s, shingle) for s in tv.slices(pa.array(text, pa.string(), from_pandas=True))]
        return pd.Series((np.concatenate(fps) if fps else np.zeros(0, np.uint64)).view(np.int64))

    least = F.min(F.struct(F.col("id").isNull().alias("__none"), F.coalesce("id", F.lit(0)).alias("__id"), F.col("fp").alias("__fp")))
    keep = stored(_rooted(docs, id_col, text_col, shingle, max_bits).groupBy("root").agg(least.alias("least")).select("least.*"), "kept")
    keys = {"__none": F.col(id_col).isNull(), "__id": F.coalesce(F.col(id_col).cast("long"), F.lit(0)), "__fp": fingerprint(F.col(text_col).cast("string"))}
    kept = small_batches(docs).withColumns(keys).join(keep.hint("shuffle_hash"), list(keys), "left_semi").dropDuplicates(list(keys))
    return kept.select(*docs.columns)
