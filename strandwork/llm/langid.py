"""Language ID: sparse multinomial logistic regression on TF-IDF character n-grams.

N-grams of one to three code points (other than letters count as a blank) are
hashed to 2^16 columns.  Document frequencies are counted over every training
document; the weights are learned by follow-the-regularised-leader (proximal,
per coordinate) with an elastic net, on about `sample` training rows chosen by a
hash of the id, of each language in proportion but `quota` at least; a temperature is then fitted on a fifth of these that was kept out.

Nulls: a null text, or one without a letter, is `und` with score 0; a null lang is
not learned from; a null id counts as the empty text for its fold.  Without training
rows everything is `und`.  Repeated rows get equal results.  Empty tables give
empty results.  Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec as tv
from .common import fold, hash63, small_batches, threshold

BITS = 16
COLUMNS = 1 << BITS
#: Training rows that the weights are fitted on, about; and so many of each language at least (all, if it has fewer).
SAMPLE, QUOTA = 3_000, 60
_ASCII = np.zeros(256, bool)
_ASCII[np.r_[65:91, 97:123]] = True
_FOLD = np.full(0x250, 32, np.uint32)
for _c in range(0x250):
    if chr(_c).isalpha():
        _FOLD[_c] = ord(chr(_c).lower()) if len(chr(_c).lower()) == 1 else _c


def letters(part: tv.Slice) -> np.ndarray:
    """Whether each text has a letter."""
    out = part.per_text(_ASCII[part.data]) > 0
    for k in np.flatnonzero(~out & (part.per_text(part.data > 127) > 0)):
        raw = part.data[part.offsets[k] : part.offsets[k + 1]].tobytes().decode("utf-8", "replace")
        out[k] = any(c.isalpha() for c in raw)
    return out


def columns(part: tv.Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first entry of each text and the end, column, count): the different columns of each text, in order."""
    points = np.frombuffer(part.data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    lead = np.concatenate([[0], np.cumsum((part.data & 0xC0) != 0x80)])
    border = lead[part.offsets]
    points = np.where(points < 0x250, _FOLD[np.minimum(points, 0x24F)], points)
    text = np.repeat(np.arange(len(part)), np.diff(border))
    gram, keys = np.zeros(len(points), np.uint32), []
    for order in (1, 2, 3):
        size = len(points) - order + 1
        if size <= 0:
            break
        gram = (gram[:size] * np.uint32(2654435761) + points[order - 1 :] * np.uint32(40503) + np.uint32(order)) * np.uint32(2246822519)
        column = (gram ^ (gram >> np.uint32(15))) * np.uint32(3266489917) >> np.uint32(32 - BITS)
        inside = text[order - 1 :] == text[:size]
        keys.append(((text[:size] << BITS) + column)[inside])
    key = np.sort(np.concatenate(keys)) if keys else np.zeros(0, np.int64)
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    count = np.diff(np.append(first, len(key)))
    key = key[first]
    return np.searchsorted(key, np.arange(len(part) + 1) << BITS), key & (COLUMNS - 1), count


def weighed(at: np.ndarray, column: np.ndarray, count: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Log-scaled counts times inverse document frequency, each text's with unit length."""
    x = np.log1p(count) * idf[column]
    sums = np.concatenate([[0.0], np.cumsum(x * x)])
    return x / np.repeat(np.maximum(np.sqrt(sums[at[1:]] - sums[at[:-1]]), 1e-9), np.diff(at))


@dataclass
class Model:
    langs: list[str]
    idf: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float

    def predict(self, part: tv.Slice) -> tuple[list[str], np.ndarray]:
        lang, score = np.full(len(part), -1), np.zeros(len(part))
        if self.langs:
            at, column, count = columns(part)
            x = weighed(at, column, count, self.idf)
            full = np.flatnonzero(np.diff(at))
            z = np.tile(self.bias.astype(float), (len(part), 1))
            if len(full):
                z[full] += np.add.reduceat(x[:, None] * self.weights[column], at[full], axis=0)
            p = softmax(z / self.temperature)
            lang, score = p.argmax(1), p.max(1)
            none = ~letters(part)
            lang[none], score[none] = -1, 0.0
        return [self.langs[k] if k >= 0 else "und" for k in lang], score


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def ftrl(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, classes: int, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.02, epochs: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Weights and bias by FTRL-proximal with an elastic net; rows: (columns, values)."""
    z, n = np.zeros((COLUMNS + 1, classes)), np.zeros((COLUMNS + 1, classes))

    def weight(at: np.ndarray) -> np.ndarray:
        zz = z[at]
        return np.where(np.abs(zz) <= l1, 0.0, -(zz - np.sign(zz) * l1) / ((beta + np.sqrt(n[at])) / alpha + l2))

    order = np.random.Generator(np.random.PCG64(7))
    for _ in range(epochs):
        for k in order.permutation(len(rows)):
            at, v = np.append(rows[k][0], COLUMNS), np.append(rows[k][1], 1.0)
            w = weight(at)
            p = softmax((v @ w)[None])[0]
            p[y[k]] -= 1
            g = v[:, None] * p
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha
            z[at] += g - sigma * w
            n[at] += g * g
    w = weight(np.arange(COLUMNS + 1))
    return w[:-1].astype(np.float32), w[-1].astype(np.float32)


def _temperature(logits: np.ndarray, y: np.ndarray) -> float:
    grid = np.exp(np.linspace(np.log(0.2), np.log(5), 60))
    loss = [-np.log(np.maximum(softmax(logits / t)[np.arange(len(y)), y], 1e-12)).mean() for t in grid]
    return float(grid[int(np.argmin(loss))])


def fit(docs: DataFrame, sample: int = SAMPLE, quota: int = QUOTA) -> Model:
    """Learns from text and lang of rows outside fold 1 of 3."""
    train = small_batches(docs).where(F.col("lang").isNotNull() & F.col("text").isNotNull()).where(fold("doc_id", 3) != 1).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, docs_n = np.zeros(COLUMNS, np.int64), 0
        for b in batches:
            docs_n += b.num_rows
            for part in tv.slices(b.column(0)):
                df += np.bincount(columns(part)[1], minlength=COLUMNS)
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(df[at], docs_n))], names=["col", "df"])

    df = train.select("text").mapInArrow(frequencies, "col long, df long").groupBy("col").agg(F.sum("df").alias("df")).toPandas()  # at most COLUMNS + 1 rows
    total = int(df.loc[df["col"] == -1, "df"].sum())
    if not total:
        return Model([], np.zeros(COLUMNS, np.float32), np.zeros((COLUMNS, 0), np.float32), np.zeros(0, np.float32), 1.0)
    seen = np.zeros(COLUMNS)
    real = df["col"] >= 0
    seen[df.loc[real, "col"].to_numpy()] = df.loc[real, "df"]
    idf = np.log((total + 1) / (seen + 1)).astype(np.float32) + np.float32(1)
    chosen = train
    if total > sample:
        rows_of = {r["lang"]: r["n"] for r in train.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row per language, as many as the model has
        least = F.create_map(*[F.lit(x) for lang, n in rows_of.items() for x in (lang, threshold(max(sample * n // total, min(n, quota)), n))])
        chosen = train.where(hash63(F.concat_ws("-", F.lit("lang"), F.col("doc_id").cast("string"))) < least[F.col("lang")])

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols, vals = [], []
            for part in tv.slices(b.column(1)):
                at, column, count = columns(part)
                x = weighed(at, column, count, idf)
                cols += [column[a:b].astype(np.uint16).tobytes() for a, b in zip(at, at[1:], strict=False)]
                vals += [x[a:b].astype(np.float32).tobytes() for a, b in zip(at, at[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(cols, pa.binary()), pa.array(vals, pa.binary())], names=["id", "lang", "cols", "vals"])

    got = chosen.mapInArrow(sparse, "id long, lang string, cols binary, vals binary").toPandas().sort_values(["id", "lang", "cols", "vals"])
    langs = sorted(set(got["lang"]))
    y = np.searchsorted(langs, got["lang"].to_numpy().astype(str))
    rows = [(np.frombuffer(c, np.uint16).astype(np.int64), np.frombuffer(v, np.float32).astype(np.float64)) for c, v in zip(got["cols"], got["vals"], strict=True)]
    held = np.arange(len(rows)) % 5 == 0 if len(rows) >= 50 else np.zeros(len(rows), bool)
    w, bias = ftrl([r for r, h in zip(rows, held, strict=True) if not h], y[~held], len(langs))
    logits = np.array([v @ w[c] + bias for (c, v), h in zip(rows, held, strict=True) if h])
    return Model(langs, idf, w, bias, _temperature(logits, y[held]) if held.any() else 1.0)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2^16 columns by languages, whatever the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lang, score = [], []
            for part in tv.slices(b.column(1)):
                got = shared.value.predict(part)
                lang += got[0]
                score.append(got[1])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lang, pa.string()), pa.array(np.concatenate(score) if score else np.zeros(0))], names=["doc_id", "lang_pred", "score"])

    return small_batches(docs).select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, lang_pred string, score double")
