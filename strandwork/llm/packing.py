"""Best-fit packing of documents into sequences of a fixed number of tokens.

Tokens come from a public tokenizer's file.  Only documents longer than a
sequence are cut.  Packing is bulk-synchronous best-fit.  Pieces are taken by
falling classes of length (halves of a sequence, quarters, and so on).  In a round the pieces
of a class and the gaps that could hold them are sorted by size into ranges, one a
task; each task sweeps its range by falling length, a piece into its successor (the
least gap that holds it, updated at once), and of pieces of one length the one of lower rank
first.  As every gap is in one range, no two tasks want the same.  Gaps that hold any
piece of the class are dealt over all ranges.  What found no gap is sorted anew
with the gaps that are left, over new ranges; in a class's last sweep, or if no gap can hold any piece, the tasks
open sequences for what still finds none.  Every round's gaps and placed pieces are stored tables.

Nulls: a null text is empty; a null id is packed like any other.  An empty text
is one piece of its end token.  Repeated rows are separate documents.  Empty
tables give empty results.  Extra columns are ignored.
"""

from __future__ import annotations

import os
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import reduce
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec as tv
from .common import small_batches, stored

#: Pieces and gaps in one range, about.
RANGE_ROWS = 20_000
#: Sweeps of one class; in the last one its pieces open sequences.
SWEEPS = 2
_SPACE, _LETTER, _DIGIT, _OTHER, _COMPLEX = range(5)
_CLASS = np.full(256, _OTHER, np.uint8)
_CLASS[[9, 10, 11, 12, 13, 32]] = _SPACE
_CLASS[np.r_[65:91, 97:123]] = _LETTER
_CLASS[48:58] = _DIGIT
#: An apostrophe can begin a contraction, "<" a special token, and other bytes may be any characters: such words are encoded whole.
_CLASS[np.r_[0:9, 14:32, 39, 60, 128:256]] = _COMPLEX


class FastIds:
    """Token ids of many texts by a tokenizers file, each different run of characters encoded once.

    For word-level BPE that lower-cases and drops white space: a text's ids are
    those of its white-space-separated words in turn.  A word of plain letters,
    digits and signs is further cut at changes of class, as the tokenizer's own
    split does; any other word is encoded whole.  What is known lies in an
    open-addressing table of numpy arrays, which starts anew beyond `limit` runs.
    A run that is found by its hash is compared byte by byte with the run that the
    table holds; texts with a run that differs are encoded whole.
    """

    def __init__(self, path: str, limit: int = 699_000) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.limit = limit
        self.mask = np.uint64((1 << (limit * 3).bit_length()) - 1)
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(int(self.mask) + 1, np.uint64)  # no run has hash 0
        self.entry = np.zeros(int(self.mask) + 1, np.int32)
        self.at = np.zeros(0, np.int64)
        self.n = np.zeros(0, np.int32)
        self.ids = np.zeros(0, np.uint16)
        self.raw = np.zeros(8, np.uint8)  # the runs themselves, one after another, and eight zeros
        self.raw_at = np.zeros(0, np.int64)
        self.raw_n = np.zeros(0, np.int64)

    def find(self, h: np.ndarray) -> np.ndarray:
        """The entry of each hash, or -1."""
        out = np.full(len(h), -1, np.int64)
        slot = h & self.mask
        there = self.keys[slot]
        hit = there == h
        out[hit] = self.entry[slot[hit]]
        todo = np.flatnonzero(~hit & (there != 0))
        while len(todo):
            slot[todo] = (slot[todo] + np.uint64(1)) & self.mask
            there = self.keys[slot[todo]]
            hit = there == h[todo]
            out[todo[hit]] = self.entry[slot[todo[hit]]]
            todo = todo[~hit & (there != 0)]
        return out

    def learn(self, h: np.ndarray, runs: list[bytes], keys: list[bytes]) -> None:
        """Encodes runs that are new and differ in their hashes; keys: the runs as they are compared."""
        got: list[list[int]] = []
        model = self.tokenizer.model.tokenize
        hard = []
        for k, run in enumerate(runs):
            if run.isalpha():
                got.append([t.id for t in model(run.decode().lower())])
            else:
                got.append([])
                hard.append(k)
        for k, e in zip(hard, self.tokenizer.encode_batch_fast([runs[k].decode() for k in hard], add_special_tokens=False), strict=True):
            got[k] = e.ids
        n = np.fromiter(map(len, got), np.int32, len(got))
        at = len(self.ids) + np.cumsum(n, dtype=np.int64) - n
        entry = len(self.at) + np.arange(len(h))
        self.ids = np.concatenate([self.ids, np.fromiter((x for g in got for x in g), np.uint16, int(n.sum()))])
        self.at, self.n = np.concatenate([self.at, at]), np.concatenate([self.n, n])
        size = np.fromiter(map(len, keys), np.int64, len(keys))
        self.raw_at = np.concatenate([self.raw_at, len(self.raw) - 8 + np.cumsum(size) - size])
        self.raw_n = np.concatenate([self.raw_n, size])
        self.raw = np.concatenate([self.raw[:-8], np.frombuffer(b"".join(keys), np.uint8), np.zeros(8, np.uint8)])
        slot, todo = h & self.mask, np.arange(len(h))
        while len(todo):
            free = todo[self.keys[slot[todo]] == 0]
            _, first = np.unique(slot[free], return_index=True)
            won = free[first]
            self.keys[slot[won]] = h[won]
            self.entry[slot[won]] = entry[won]
            todo = todo[self.keys[slot[todo]] != h[todo]]
            slot[todo] = (slot[todo] + np.uint64(1)) & self.mask

    def encode(self, part: tv.Slice) -> tuple[np.ndarray, np.ndarray]:
        """(all ids one after another, ids of each text)."""
        data = part.data
        n = len(data)
        if not n:
            return np.zeros(0, np.uint32), np.zeros(len(part), np.int64)
        kind = _CLASS[data]
        latin = np.flatnonzero(data[:-1] == 0xC3)  # U+00C0 to U+00FF, letters but for two signs
        latin = latin[(data[latin + 1] != 0x97) & (data[latin + 1] != 0xB7)]
        kind[latin], kind[latin + 1] = _LETTER, _LETTER
        change = np.empty(n + 1, bool)
        change[0], change[n] = True, True
        np.not_equal(kind[1:], kind[:-1], out=change[1:-1])
        change[1:-1] |= kind[1:] == _DIGIT
        change[part.offsets] = True
        complex_at = np.flatnonzero(kind == _COMPLEX)
        exact = None
        if len(complex_at):
            w = tv.words(part)
            hard = np.unique(np.searchsorted(w.starts, complex_at, "right") - 1)
            size = (w.ends - w.starts)[hard]
            inner = np.repeat(w.starts[hard] - (np.cumsum(size) - size), size) + np.arange(size.sum())
            change[inner] = False
            change[w.starts[hard]] = True
            exact = w.starts[hard][np.unique(np.searchsorted(w.starts[hard], np.flatnonzero(data == 60), "right") - 1)] if (data == 60).any() else None
        borders = np.flatnonzero(change)
        solid = kind[borders[:-1]] != _SPACE
        starts, ends = borders[:-1][solid], borders[1:][solid]
        h = tv.hashes(part, starts, ends, lower=True)
        stream = part.stream(lower=True)
        if exact is not None:  # special tokens are told by case
            e = np.searchsorted(starts, exact)
            h[e] ^= tv.hashes(part, starts[e], ends[e]) << np.uint64(1) | np.uint64(1)
            stream = stream.copy()
            for a, b in zip(starts[e].tolist(), ends[e].tolist(), strict=True):
                stream[a:b] = data[a:b]
        h[h == 0] = 1
        entry = self.find(h)
        miss = np.flatnonzero(entry < 0)
        if len(miss):
            new, first = np.unique(h[miss], return_index=True)
            if len(self.at) + len(new) > self.limit and len(self.at):
                self.clear()
                return self.encode(part)
            raw, low = data.tobytes(), stream.tobytes()
            s, t = starts[miss[first]].tolist(), ends[miss[first]].tolist()
            self.learn(new, [raw[a:b] for a, b in zip(s, t, strict=True)], [low[a:b] for a, b in zip(s, t, strict=True)])
            entry[miss] = self.find(h[miss])
        known = tv.same(stream, starts, ends, self.raw, self.raw_at[entry], self.raw_at[entry] + self.raw_n[entry])
        count = self.n[entry].astype(np.int64)
        total = np.concatenate([[0], np.cumsum(count)])
        ids = self.ids[np.repeat(self.at[entry] - total[:-1], count) + np.arange(total[-1])].astype(np.uint32)
        border = total[np.searchsorted(starts, part.offsets)]
        if known.all():
            return ids, np.diff(border)
        parts = [ids[a:b] for a, b in zip(border, border[1:], strict=False)]
        for k in set(part.text_of(starts)[~known].tolist()):
            text = data[part.offsets[k] : part.offsets[k + 1]].tobytes().decode()
            parts[k] = np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)
        return np.concatenate(parts), np.array([len(p) for p in parts], np.int64)


_encoders: dict[str, FastIds] = {}


def _encoder(path: str) -> FastIds:
    if path not in _encoders:
        _encoders[path] = FastIds(path)
    return _encoders[path]


def tokenizer_path(name: str) -> str:
    """Where a public tokenizer's file lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = "word_bpe_49k.json", length: int = 2048, end_id: int = 0) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(tokenizer_path(tokenizer))
        for b in batches:
            for part in tv.slices(b.column(1)):
                ids, n = encoder.encode(part)
                border = np.concatenate([[0], np.cumsum(n)])
                raw = memoryview(ids.astype("<u4").tobytes())
                rows: list[tuple[int, int, int, int, int]] = []
                last = np.array([end_id], "<u4").tobytes()
                for k in range(len(part)):
                    lo, total = int(border[k]), int(n[k]) + 1
                    for piece, start in enumerate(range(0, total, length)):
                        size = min(length, total - start)
                        end = start + size
                        crc = zlib.crc32(raw[4 * (lo + start) : 4 * (lo + min(end, total - 1))])
                        rows.append((k, piece, start, size, zlib.crc32(last, crc) if end == total else crc))
                cols = np.array(rows, np.int64).T
                ids_of = b.column(0).take(pa.array(cols[0] + part.first))
                yield pa.RecordBatch.from_arrays([ids_of, pa.array(cols[1].astype(np.int32)), *(pa.array(c) for c in cols[2:])], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    src = small_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return src.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def best_fit(lengths: np.ndarray, free: np.ndarray, used: np.ndarray, size: int, opens: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(gap of each piece or -1, offset of each piece, free, used): pieces by falling length (by rank within one) into the least gap that holds them.

    opens: pieces without a gap open sequences of `size`, which become gaps behind the given ones.
    """
    gap, offset = np.full(len(lengths), -1), np.zeros(len(lengths), np.int64)
    held: dict[int, list[np.ndarray]] = {}
    present = np.zeros(size + 1, bool)
    order = np.argsort(free, kind="stable")
    for part in np.split(order, np.flatnonzero(np.diff(free[order])) + 1) if len(order) else []:
        held[int(free[part[0]])] = [part]
        present[free[part[0]]] = True
    all_free, all_used = free.astype(np.int64), used.astype(np.int64)
    by = np.argsort(-lengths, kind="stable")
    at = 0
    while at < len(by):
        item = int(lengths[by[at]])
        end = at + int(np.searchsorted(-lengths[by[at:]], -item, "right"))
        while at < end:
            found = present[item:].argmax() if present[item:].any() else -1
            if found < 0:
                if not opens:
                    break
                n = max(1, -(-(end - at) // (size // item)))  # enough for the pieces of this length that are left
                new = len(all_free) + np.arange(n)
                all_free, all_used = np.concatenate([all_free, np.full(n, size)]), np.concatenate([all_used, np.zeros(n, np.int64)])
                held.setdefault(size, []).append(new)
                present[size] = True
                found = size - item
            room = item + int(found)
            part = held[room].pop()
            take, rest = part[: end - at], part[end - at :]
            if len(rest):
                held[room].append(rest)
            present[room] = bool(held[room])
            mine = by[at : at + len(take)]
            gap[mine], offset[mine] = take, all_used[take]
            all_free[take] -= item
            all_used[take] += item
            if room > item:
                held.setdefault(room - item, []).append(take)
                present[room - item] = True
            at += len(take)
        at = end
    return gap, offset, all_free, all_used


_PIECE = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
_STATE = "kind int, doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
_PLACED, _GAP, _LEFT = range(3)


def _swept(rows: DataFrame, number: int, size: int, least: int, most: int, opens: bool, ranges: int) -> DataFrame:
    """One round over pieces (kind _LEFT) and gaps (kind _GAP: length is free, offset is used) of a class of lengths, by ranges of size."""

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        _encoders.clear()  # workers are used again, and rounds need no tokenizer
        got = list(batches)
        if not got:
            return
        t = pa.Table.from_batches(got).combine_chunks()
        kind, length, seq, used = (t.column(c).to_numpy() for c in ("kind", "length", "sequence_id", "offset"))
        p, g = np.flatnonzero(kind == _LEFT), np.flatnonzero(kind == _GAP)
        gap, offset, free, filled = best_fit(length[p], length[g], used[g], size, opens)
        base = (number << 48) + (TaskContext.get().partitionId() << 28)
        names = np.concatenate([seq[g], base + np.arange(len(free) - len(g))])
        pieces = t.take(pa.array(p)).drop_columns(["kind", "sequence_id", "offset"])
        placed = gap >= 0
        columns = [pa.array(np.where(placed, _PLACED, _LEFT).astype(np.int32)), *(pieces.column(c).combine_chunks() for c in _PIECE[:5]), pa.array(np.where(placed, names[gap], -1) if len(names) else np.full(len(p), -1)), pa.array(offset)]
        yield pa.RecordBatch.from_arrays(columns, names=["kind", *_PIECE])
        n = len(free)
        blank = [pa.nulls(n, x) for x in (pa.int64(), pa.int32(), pa.int64())]
        yield pa.RecordBatch.from_arrays([pa.array(np.full(n, _GAP, np.int32)), *blank, pa.array(free), pa.nulls(n, pa.int64()), pa.array(names), pa.array(filled)], names=["kind", *_PIECE])

    tie = F.xxhash64("doc_id", "piece", "start", "ids_crc32", "sequence_id")
    anywhere = least + F.pmod(tie, F.lit(most - least + 1))
    place = F.when((F.col("kind") == _GAP) & (F.col("length") >= most), anywhere).otherwise(F.col("length"))
    dealt = rows.withColumn("place", place).withColumn("tie", tie)
    return dealt.repartitionByRange(ranges, "place", "tie").sortWithinPartitions("kind", "doc_id", "piece", "ids_crc32").drop("place", "tie").mapInArrow(sweep, _STATE)


def pack(cut: DataFrame, length: int = 2048, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Adds sequence_id and offset to pieces; cut is a stored table of pieces()."""
    nothing = F.lit(0).cast("long")
    todo = cut.select(F.lit(_LEFT).alias("kind"), "doc_id", "piece", "start", "length", "ids_crc32", nothing.alias("sequence_id"), nothing.alias("offset"))
    left = Counter({r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()})  # at most `length` rows, as for each count below
    free: Counter[int] = Counter()
    placed, gaps, number, most = [], None, 0, length
    while most:
        least = most // 2 + 1 if most > length // 16 else 1
        pieces, sweeps = todo.where(F.col("length").between(least, most)), 0
        while wanted := {k: left[k] for k in range(least, most + 1) if left[k]}:
            fitting = {k: n for k, n in free.items() if k >= least and n}
            sweeps += 1
            opens = sweeps == SWEEPS or max(fitting, default=0) < min(wanted)
            rows = pieces.unionByName(gaps.where(F.col("length") >= least)) if fitting else pieces
            ranges = max(1, ceil((sum(wanted.values()) + sum(fitting.values())) / range_rows))
            out = stored(_swept(rows, number, length, least, most, opens, ranges), "packing", "none")  # small numbers; compressors hold memory outside the heap for each file
            number += 1
            counts = {(r["kind"], r["length"]): r["n"] for r in out.where(F.col("kind") != _PLACED).groupBy("kind", "length").agg(F.count("*").alias("n")).collect()}
            for k in range(least, length + 1):
                free[k] = 0
            for (kind, k), n in counts.items():
                free[k] += n * (kind == _GAP)
            left.update({k: counts.get((_LEFT, k), 0) - left[k] for k in wanted})
            placed.append(out.where(F.col("kind") == _PLACED).select(*_PIECE))
            kept = out.where((F.col("kind") == _GAP) & (F.col("length") > 0))
            if gaps is not None:  # those that no piece of the class fits, or that were not asked
                kept = kept.unionByName(gaps.where(F.col("length") < least) if fitting else gaps)
            gaps = kept
            pieces = out.where(F.col("kind") == _LEFT)
        most = least - 1
    return reduce(DataFrame.unionByName, placed) if placed else todo.select(*_PIECE)


def packed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = "word_bpe_49k.json", length: int = 2048) -> DataFrame:
    """Every piece of every document with its sequence and offset."""
    return pack(stored(pieces(docs, id_col, text_col, tokenizer, length), "pieces"), length)
