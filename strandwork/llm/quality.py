"""Quality rules: gradient-boosted trees over document statistics, with monotonic constraints.

The statistics are counted over whole texts; the base rules come first, and the
trees (flat numpy node arrays, scored for many documents at once) give a verdict
on the rest.  A higher share of symbols, repeated lines, repeated words, capitals
or exclamation marks can never raise the score.

The trees are fitted on at most `sample` labelled rows outside fold 0 of 5 (by
crc32 of the id); every document is judged.

Nulls: a null text has no words and fails the base rules; a null id is in fold 0
and never learned from.  Without labels of both classes the verdict of the trees is
their constant prior, and 1 without any label.  An id with different labels counts as bad.  Repeated rows get equal results.
Empty tables give empty results.  Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import gbt
from . import textvec as tv
from .common import hashed_below, one_label, small_batches, stored

SAMPLE = 16_000
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: The statistics that the trees see, and how the score may move with each.
FEATURES = {
    "log_words": 0, "mean_word": 0, "symbol_rate": -1, "dup_line_share": -1, "repeat_share": -1, "caps_share": -1, "exclaim_rate": -1,
    "pipe_rate": -1, "digit_share": 0, "symbol_words": -1, "distinct_share": 0, "lines": 0, "top_word_share": -1, "other_signs": 0,
}


def _flags(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


_SYMBOL = _flags(b"#*$%&|<>")
_UPPER = _flags(bytes(range(65, 91)))
_ALPHA = _flags(bytes(range(65, 91)) + bytes(range(97, 123)) + bytes(range(128, 256)))
_DIGIT = _flags(bytes(range(48, 58)))
_SIGN = _flags(b"@^~_=+\\{}[]/`")


def grouped_spans(part: tv.Slice, starts: np.ndarray, ends: np.ndarray, text: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """tv.grouped() by the spans' bytes: spans with equal hashes are compared, and numbered anew should any differ."""
    order, new = tv.grouped(h, text)
    again = np.flatnonzero(~new)
    here, before = order[again], order[again - 1]
    stream = part.stream()
    if not tv.same(stream, starts[here], ends[here], stream, starts[before], ends[before]).all():
        raw, names = stream.tobytes(), {}
        number = np.array([names.setdefault(raw[a:b], len(names)) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], np.uint64)
        order, new = tv.grouped(number, text)
    return order, new


def word_names(part: tv.Slice, w: tv.Words) -> np.ndarray:
    """A number for each word of a slice, equal only for equal bytes."""
    h = tv.hashes(part, w.starts, w.ends)
    order = np.argsort(h, kind="stable")
    again = np.flatnonzero(h[order][1:] == h[order][:-1])
    here, before = order[again + 1], order[again]
    stream = part.stream()
    if not tv.same(stream, w.starts[here], w.ends[here], stream, w.starts[before], w.ends[before]).all():
        raw, names = stream.tobytes(), {}
        h = np.array([names.setdefault(raw[a:b], len(names)) for a, b in zip(w.starts.tolist(), w.ends.tolist(), strict=True)], np.uint64)
    return h


def statistics(part: tv.Slice) -> tuple[np.ndarray, np.ndarray]:
    """(COUNTS, FEATURES) of each text of a slice."""
    n, data = len(part), part.data
    w = tv.words(part)
    if not len(w.starts):
        return np.zeros((n, len(COUNTS)), np.int64), np.zeros((n, len(FEATURES)))
    solid = ~tv.SEPARATOR[data]
    chars = part.per_text(solid & ((data & 0xC0) != 0x80))
    symbols = part.per_text(_SYMBOL[data])
    # lines that hold a word, less the different ones
    lines = tv.spans(part, data != 10)
    has = np.concatenate([[0], np.cumsum(solid)])
    worded = has[lines.ends] > has[lines.starts]
    starts, ends, text = lines.starts[worded], lines.ends[worded], lines.text[worded]
    order, new = grouped_spans(part, starts, ends, text, tv.hashes(part, starts, ends))
    n_lines = np.bincount(text, minlength=n)
    dup_lines = np.bincount(text[order][~new], minlength=n)
    # words in three-word windows that occur twice or more in the text
    h = word_names(part, w)
    repeat = np.zeros(len(h), bool)
    if len(h) > 2:
        win = np.flatnonzero(w.text[2:] == w.text[:-2])
        key = tv.mix(h[win] * np.uint64(3) + tv.mix(h[win + 1] * np.uint64(5) + tv.mix(h[win + 2])))
        o, first = tv.grouped(key, w.text[win])
        differ = (h[win][o][1:] != h[win][o][:-1]) | (h[win + 1][o][1:] != h[win + 1][o][:-1]) | (h[win + 2][o][1:] != h[win + 2][o][:-1])
        if (differ & ~first[1:]).any():  # different windows with one key
            o = np.lexsort((h[win + 2], h[win + 1], h[win], w.text[win]))
            first = np.ones(len(o), bool)
            first[1:] = (np.diff(w.text[win][o]) != 0) | (h[win][o][1:] != h[win][o][:-1]) | (h[win + 1][o][1:] != h[win + 1][o][:-1]) | (h[win + 2][o][1:] != h[win + 2][o][:-1])
        many = np.zeros(len(win), bool)
        many[o] = ~first | ~np.append(first[1:], True)
        at = win[many]
        for k in range(3):
            repeat[at + k] = True
    repeats = np.bincount(w.text, repeat, n).astype(np.int64)
    o, first = tv.grouped(h, w.text)
    distinct = np.bincount(w.text[o][first], minlength=n)
    begin = np.flatnonzero(first)
    run = np.diff(np.append(begin, len(o)))
    top = np.zeros(n)
    np.maximum.at(top, w.text[o][begin], run)
    inside = lambda f: (s := np.concatenate([[0], np.cumsum(f)]))[w.ends] - s[w.starts]
    alpha, upper, sym = inside(_ALPHA[data]), inside(_UPPER[data]), inside(_SYMBOL[data])
    words = np.maximum(w.counts, 1)
    share = lambda f: np.bincount(w.text, f, n) / words
    size = np.maximum(chars, 1)
    x = np.stack([
        np.log1p(w.counts), chars / words, symbols / size, dup_lines / np.maximum(n_lines, 1), repeats / words, share((alpha == upper) & (alpha > 1)), part.per_text(data == 33) / size,
        part.per_text(data == 124) / words, part.per_text(_DIGIT[data]) / size, share((sym > 0) & (alpha > 0)), distinct / words, np.log1p(n_lines), np.where(w.counts >= 20, top / words, 0), part.per_text(_SIGN[data]) / size,
    ], 1).astype(np.float64)
    return np.stack([w.counts, chars, symbols, dup_lines, repeats], 1).astype(np.int64), x


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> gbt.Trees:
    """Trees learned from labels.quality of rows outside fold 0 of 5."""
    known = one_label(labels, "quality", 5, 0, 0)
    n = known.count()
    if n > sample:
        known = known.where(hashed_below("__id", sample, n))
    texts = small_batches(docs).select(F.col("doc_id").cast("long").alias("__doc"), F.col("text").cast("string").alias("text"))
    one = F.broadcast(known)  # about `sample` rows of two numbers
    rows = stored(texts.join(one, F.col("__doc") == F.col("__id")).select("__id", F.xxhash64("text").alias("h"), "text", "y"), "quality-sample")

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [statistics(part)[1] for part in tv.slices(b.column(2))]
            x = np.concatenate(x) if x else np.zeros((0, len(FEATURES)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(3), pa.array(list(x), pa.list_(pa.float64()))], names=["id", "h", "y", "x"])

    got = rows.mapInArrow(describe, "id long, h long, y int, x array<double>").toPandas().sort_values(["id", "h"])
    x, y = np.array(got["x"].tolist()).reshape(-1, len(FEATURES)), got["y"].to_numpy(float)
    if not len(y):
        x, y = np.zeros((1, len(FEATURES))), np.ones(1)
    return gbt.fit(x, y, monotone=list(FEATURES.values()), depth=4, trees=60)


def judge(docs: DataFrame, trees: gbt.Trees, threshold: float = 0.5) -> DataFrame:
    """(doc_id, the counts, base_failed, score, kept) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [statistics(part) for part in tv.slices(b.column(1))]
            counts = np.concatenate([g[0] for g in got]) if got else np.zeros((0, len(COUNTS)), np.int64)
            p = trees.probability(np.concatenate([g[1] for g in got])) if got else np.zeros(0)
            failed = (counts[:, 0] < 50) | (100 * counts[:, 4] > 50 * counts[:, 0])
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c) for c in counts.T), pa.array(failed), pa.array(p), pa.array(~failed & (p >= threshold))], names=["doc_id", *COUNTS, "base_failed", "score", "kept"])

    return small_batches(docs).select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", base_failed boolean, score double, kept boolean")
