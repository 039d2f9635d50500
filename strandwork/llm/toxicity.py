"""Toxicity: gradient-boosted trees over dense features of whole texts, with isotonic calibration.

Features: lexicon densities (a fixed list of insults, and terms and word
beginnings learned from labelled training rows), second-person words near
lexicon hits, capitals, punctuation, and obfuscation (letters mixed with digits
or signs, lexicon hits only after undoing them, stretched letters).

The trees and the learned terms are fitted on at most `sample` labelled rows,
chosen by a hash of the id; every document is scored.

Nulls: a null text is an empty one and gets the model's score for no words; a
null id is in fold 0, so it is held out and never learned from; null labels are
not learned from.  Without labels of both classes every score is the share of toxic
training rows (0 without any).  An id with different labels counts as toxic.  Repeated rows get equal scores.  Empty tables
give empty results.  Extra columns are kept by keep_clean() and ignored by score().
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import gbt
from . import textvec as tv
from .common import hashed_below, one_label, small_batches, stored

#: Labelled rows that a model is fitted on, at most about so many.
SAMPLE = 16_000
#: Terms and word beginnings that are learned at most.
TERMS = 400

# Common insults and second-person words of four languages.
INSULTS = (
    "idiot moron stupid dumb loser scum trash worthless pathetic disgusting clown fool ugly "
    "dummkopf arschloch trottel wichser connard salaud imbecile salope cabron imbecil estupido pendejo"
).split()
SECOND = "you your yours yourself u ur du dich dir dein deine deinen euch euer tu te toi ton ta tes vous votre vos tú ti usted ustedes tus".split()

_LETTER = np.zeros(256, bool)
_LETTER[np.r_[65:91, 97:123, 128:256]] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_PUNCT = np.zeros(256, bool)
_PUNCT[np.r_[33:48, 58:65, 91:97, 123:127]] = True
_LEET = np.arange(256, dtype=np.uint8)
for _a, _b in zip(b"013457@$!", b"oieastasi", strict=True):
    _LEET[_a] = _b
_LEET_SIGN = np.zeros(256, bool)
_LEET_SIGN[list(b"013457@$!")] = True
_BEGINNINGS = (4, 5, 6, 7, 8)

NAMES = (
    "log_words", "fixed_density", "term_density", "term_weight", "term_share_max", "near_second", "second_density", "hits_log",
    "capitals", "caps_words", "punctuation", "exclaims", "questions", "digits", "mixed_words", "leet_density", "stretched", "symbol_words", "mean_word",
)


@dataclass
class Terms:
    """Sorted hashes of learned terms and beginnings with their log odds."""

    keys: np.ndarray
    odds: np.ndarray

    def look(self, h: np.ndarray) -> np.ndarray:
        """The log odds of each hash, 0 where unknown."""
        out = np.zeros(len(h))
        if len(self.keys) and len(h):
            quick = np.zeros(1 << 16, bool)
            quick[(self.keys & np.uint64(0xFFFF)).astype(np.int64)] = True
            maybe = np.flatnonzero(quick[(h & np.uint64(0xFFFF)).astype(np.int64)])
            at = np.minimum(np.searchsorted(self.keys, h[maybe]), len(self.keys) - 1)
            hit = self.keys[at] == h[maybe]
            out[maybe[hit]] = self.odds[at[hit]]
        return out


def _units(part: tv.Slice, w: tv.Words) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(salt, places of tokens, hashes): whole tokens, then their beginnings of each length."""
    yield 0, np.arange(len(w.starts)), tv.hashes(part, w.starts, w.ends, lower=True)
    size = w.ends - w.starts
    for k in _BEGINNINGS:
        longer = np.flatnonzero(size > k)
        yield k, longer, tv.hashes(part, w.starts[longer], w.starts[longer] + k, lower=True) ^ np.uint64(k * 0x9E3779B97F4A7C15 % 2**64)


def _sorted_hashes(words: list[str]) -> np.ndarray:
    return np.unique(np.array([tv.hash_of(w, lower=True) for w in words], np.uint64))


_FIXED = Terms(_sorted_hashes(INSULTS), np.ones(len(set(INSULTS))))
_SECOND = Terms(_sorted_hashes(SECOND), np.ones(len(set(SECOND))))


def features(part: tv.Slice, terms: Terms) -> np.ndarray:
    """One row of NAMES per text."""
    n = len(part)
    data = part.data
    raw = tv.words(part)
    tokens = tv.spans(part, _LETTER[data]) if len(data) else raw
    total = np.maximum(tokens.counts, 1)
    add = lambda v: np.bincount(tokens.text, v, n)
    fixed, best, heavy = np.zeros(len(tokens.starts)), np.zeros(len(tokens.starts)), np.zeros(len(tokens.starts))
    second = np.zeros(len(tokens.starts))
    for salt, places, h in _units(part, tokens):
        if not salt:
            fixed, second = _FIXED.look(h), _SECOND.look(h)
        odds = terms.look(h)
        best[places] = np.maximum(best[places], odds)
        heavy[places] += odds > 0
    hit = np.maximum(fixed, best > 0)
    around = np.concatenate([[0], np.cumsum(second)])
    first = np.cumsum(tokens.counts) - tokens.counts
    i = np.arange(len(tokens.starts))
    lo = np.maximum(i - 5, first[tokens.text])
    hi = np.minimum(i + 6, (first + tokens.counts)[tokens.text])
    near = (around[hi] - around[lo] > 0) & (hit > 0)
    hits = add(hit)
    size = np.maximum(np.diff(part.offsets), 1)
    letters = np.maximum(part.per_text(_LETTER[data]), 1)
    per_byte = lambda f: part.per_text(f) / size
    by_word = lambda f: np.concatenate([[0], np.cumsum(f)])
    inside = lambda f: (s := by_word(f))[raw.ends] - s[raw.starts]
    up, let, dig, pun = (inside(t[data]) for t in (_UPPER, _LETTER, _DIGIT, _PUNCT))
    words_n = np.maximum(raw.counts, 1)
    word_share = lambda f: np.bincount(raw.text, f, n) / words_n
    same = np.zeros(len(data), bool)
    same[2:] = (data[2:] == data[1:-1]) & (data[2:] == data[:-2]) & _LETTER[data[2:]]
    for k in (0, 1):  # a run of letters lies within one text
        same[np.minimum(part.offsets[:-1] + k, len(data) - 1)[np.diff(part.offsets) > k]] = False
    leet = np.zeros(n)
    odd = np.flatnonzero((let > 0) & (inside(_LEET_SIGN[data]) > 0))
    if len(odd):
        plain = tv.Slice(_LEET[data], part.offsets, part.first)
        h = tv.hashes(plain, raw.starts[odd], raw.ends[odd], lower=True)
        leet = np.bincount(raw.text[odd], np.maximum(_FIXED.look(h), terms.look(h) > 0), n)
    cols = [
        np.log1p(raw.counts), add(fixed) / total, hits / total, add(best) / total, add(heavy) / total, add(near) / total, add(second) / total, np.log1p(hits),
        part.per_text(_UPPER[data]) / letters, word_share((up == let) & (let > 1)), per_byte(_PUNCT[data]), per_byte(data == 33), per_byte(data == 63), per_byte(_DIGIT[data]),
        word_share((let > 0) & (dig > 0)), leet / words_n, per_byte(same), word_share(pun > 1), letters / words_n,
    ]
    return np.stack(cols, 1).astype(np.float64)


@dataclass
class Model:
    terms: Terms
    trees: gbt.Trees

    def score(self, part: tv.Slice) -> np.ndarray:
        return self.trees.probability(features(part, self.terms))


def _sampled(docs: DataFrame, labels: DataFrame, label: str, sample: int) -> DataFrame:
    """(__id, h, text, y) of about `sample` labelled training rows at most; the same rows whenever the labels are the same."""
    known = one_label(labels, label, 5, 0, 1)
    n = known.count()
    if n > sample:
        known = known.where(hashed_below("__id", sample, n))
    texts = small_batches(docs).select(F.col("doc_id").cast("long").alias("__doc"), F.col("text").cast("string").alias("text"))
    one = F.broadcast(known)  # about `sample` rows of two numbers
    return texts.join(one, F.col("__doc") == F.col("__id")).select("__id", F.xxhash64("text").alias("h"), "text", "y")


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, terms: int = TERMS) -> Model:
    """Learns from labels.toxic of rows outside fold 0 of 5."""
    rows = stored(_sampled(docs, labels, "toxic", sample), "toxic-sample")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            y = b.column(1).to_numpy()
            for part in tv.slices(b.column(0)):
                w = tv.spans(part, _LETTER[part.data])
                keys = [(np.full(len(places), salt), h, w.text[places]) for salt, places, h in _units(part, w)]
                h, text = np.concatenate([k[1] for k in keys]), np.concatenate([k[2] for k in keys])
                if not len(h):
                    continue
                order, new = tv.grouped(h, text)
                key, label = h[order][new], y[part.first + text[order][new]]
                unit, inverse = np.unique(key, return_inverse=True)
                pos, every = np.bincount(inverse, label), np.bincount(inverse)
                yield pa.RecordBatch.from_arrays([pa.array(unit.view(np.int64)), pa.array(pos.astype(np.int64)), pa.array(every.astype(np.int64))], names=["unit", "pos", "n"])

    total = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum("y"), F.lit(0)).alias("pos")).first()
    share = total["pos"] / max(total["n"], 1)
    units = rows.select("text", "y").mapInArrow(count, "unit long, pos long, n long").groupBy("unit").agg(F.sum("pos").alias("pos"), F.sum("n").alias("n"))
    z = (F.col("pos") - F.col("n") * share) / F.sqrt(F.col("n") * max(share * (1 - share), 1e-9) + 1)
    odds = F.log((F.col("pos") + 0.5) / (F.col("n") - F.col("pos") + 0.5)) - float(np.log((total["pos"] + 0.5) / (total["n"] - total["pos"] + 0.5)))
    best = units.where("pos >= 4").withColumn("z", z).withColumn("odds", odds).where("z > 3.5 and odds > 1.0").orderBy(F.desc("z"), "unit").limit(terms).select("unit", "odds").collect()
    found = sorted((r["unit"] % 2**64, r["odds"]) for r in best)
    known = Terms(np.array([f[0] for f in found], np.uint64), np.array([f[1] for f in found]))

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [features(part, known) for part in tv.slices(b.column(2))]
            x = np.concatenate(x) if x else np.zeros((0, len(NAMES)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(3), pa.array(list(x), pa.list_(pa.float64()))], names=["id", "h", "y", "x"])

    got = rows.select("__id", "h", "text", "y").mapInArrow(describe, "id long, h long, y int, x array<double>").toPandas().sort_values(["id", "h"])
    x = np.array(got["x"].tolist()).reshape(-1, len(NAMES))
    return Model(known, gbt.fit_calibrated(x, got["y"].to_numpy(float)))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = [model.score(part) for part in tv.slices(b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.concatenate(s) if s else np.zeros(0))], names=["doc_id", "score"])

    return small_batches(docs).select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, score double")


def keep_clean(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """docs without rows whose score reaches the threshold; the same columns."""

    @F.pandas_udf("double")
    def of(text):  # noqa: ANN001, ANN202
        import pandas as pd

        s = [model.score(part) for part in tv.slices(pa.Array.from_pandas(text, type=pa.string()))]
        return pd.Series(np.concatenate(s) if s else np.zeros(0))

    return small_batches(docs).where(of(F.col("text").cast("string")) < threshold)
