"""Trigram language model by deleted interpolation.

Maximum-likelihood estimates are mixed order by order,
P1(w) = a p(w) + (1 - a) / (V + 1), P2(w|v) = a[b] p(w|v) + (1 - a[b]) P1(w) and
P3(w|uv) = a[b] p(w|uv) + (1 - a[b]) P2(w|v), with weights by the bucket b (powers of
two) of the context's frequency.  The weights are learned by expectation-maximisation
on held-out counts: a twentieth of the training texts, chosen by a hash of the text so
that copies go together, is taken out of the counts and the weights are those under which
its tokens are likeliest.  Texts are then scored with the counts of all training texts.
Before a text's first word stand end tokens.

Distribution.  Documents are packed into chunks of bounded size, stored.  Each
chunk sends the sorted hashes of its different n-grams, with training
counts, to hash buckets; a bucket sums them over all chunks and answers each chunk
with totals in the order it was asked.  Words and pairs go first; a chunk that has
their totals then asks only for those trigrams whose context also occurs in other
chunks, as it knows the counts of the others.  Every chunk then meets its answers
and scores its texts.  So counts of the whole corpus are summed, every message is
pre-aggregated, tasks hold one chunk or one bucket, frequent words are one key per
chunk, and no table of counts is broadcast.  Words are told apart by 63-bit
hashes, pairs and trigrams by hashes that grow with the corpus, such that about one
in two million n-grams shares its hash.

Nulls: a null text is empty (one end token); a null id counts as the empty text for its
fold.  Repeated rows are separate documents.  Without training rows every
probability is 1.  Empty tables give empty results.  Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from math import ceil, log2

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textvec as tv
from .common import small_batches, stored

#: Bytes of text in a chunk, and bytes of text for each bucket of counts.
CHUNK_BYTES = 8_000_000
BUCKET_BYTES = 8_000_000
_ONE = np.uint64(1)
_END = tv.mix(np.array([0x5EED5EED], np.uint64))[0] & ~_ONE
_CONTEXTS = 48
#: Bins for ratios of two estimates: eight for each power of two from 2^-64 to 2^64; bin 0 is for 0.
_BINS = 1025


def tokens(texts: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every token, tokens of each text); each text ends with the end token."""
    out, sizes = [], []
    for part in tv.slices(texts):
        w = tv.words(part)
        t = np.empty(len(w.starts) + len(part), np.uint64)
        if len(w.starts):
            t[np.arange(len(w.starts)) + w.text] = tv.hashes(part, w.starts, w.ends, lower=True) & ~_ONE
        t[np.cumsum(w.counts + 1) - 1] = _END
        out.append(t)
        sizes.append(w.counts + 1)
    if not out:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(out), np.concatenate(sizes)


def grams(t: np.ndarray, sizes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(pair, trigram) that ends at each token, as even hashes of `bits` bits and a zero; there is no trigram at a text's first token."""
    if not len(t):
        return t, t
    down = np.uint64(64 - bits)
    full = tv.mix(np.concatenate([[_END], t[:-1]]) * np.uint64(0xD6E8FEB86659FD93) + tv.mix(t ^ np.uint64(0xA0761D6478BD642F)))
    third = tv.mix(np.concatenate([[_END], full[:-1]]) * np.uint64(0x9E3779B97F4A7C15) + tv.mix(t ^ np.uint64(0xE7037ED1A0B428DB)))
    return full >> down << _ONE, third >> down << _ONE


def _counted(keys: np.ndarray, train: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different keys in order with their training counts; train: 0 or 1 for each key."""
    s = np.sort(keys | train)
    if not len(s):
        return s, np.zeros(0, np.int64)
    k = s & ~_ONE
    at = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
    return k[at], np.add.reduceat((s & _ONE).astype(np.int64), at)


def _squeeze(a: np.ndarray) -> bytes:
    """An array's bytes, plane by plane, compressed."""
    planes = np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T)
    return pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def _expand(raw: bytes, n: int, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    planes = np.frombuffer(pa.decompress(raw, decompressed_size=n * size, codec="zstd", asbytes=True), np.uint8).reshape(size, n)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def _rows(schema: str, rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "binary": pa.binary(), "double": pa.float64()}
    fields = [(c.split()[0], kinds[c.split()[1]]) for c in schema.split(", ")]
    cols = zip(*rows, strict=True) if rows else [[] for _ in fields]
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, (_, k) in zip(cols, fields, strict=True)], names=[f[0] for f in fields])


_CHUNK = "chunk long, em boolean, bytes long, blob binary"


def _chunks(docs: DataFrame, size: int) -> DataFrame:
    """Documents (doc_id, text, train, em) packed into rows of about `size` bytes of text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base, count = TaskContext.get().partitionId() << 24, 0
        held: dict[bool, list[pa.RecordBatch]] = {False: [], True: []}
        held_bytes = {False: 0, True: 0}

        def out(em: bool) -> pa.RecordBatch:
            nonlocal count
            t = pa.Table.from_batches(held[em]).combine_chunks()
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, t.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
                w.write_table(t)
            row = (base + count, em, held_bytes[em], sink.getvalue().to_pybytes())
            count += 1
            held[em], held_bytes[em] = [], 0
            return _rows(_CHUNK, [row])

        for b in batches:
            em = b.column(3).to_numpy(zero_copy_only=False).astype(bool)
            for which in (False, True):
                part = b.select([0, 1, 2]).filter(pa.array(em == which))
                ends = np.cumsum(pc.fill_null(pc.binary_length(part.column(1)), 0).to_numpy().astype(np.int64))
                a = 0
                while a < part.num_rows:
                    done = int(ends[a - 1]) if a else 0
                    z = max(a + 1, int(np.searchsorted(ends, done + size - held_bytes[which], "right")))
                    z = min(z, part.num_rows)
                    held[which].append(part.slice(a, z - a))
                    held_bytes[which] += int(ends[z - 1]) - done
                    a = z
                    if held_bytes[which] >= size or a < part.num_rows:
                        yield out(which)
        for which in (False, True):
            if held[which]:
                yield out(which)

    return docs.mapInArrow(run, _CHUNK)


def _open(blob: bytes) -> pa.Table:
    return pa.ipc.open_stream(blob).read_all()


_ASK = "place long, chunk long, em boolean, n long, keys binary, counts binary"
_ANSWER = "chunk long, em boolean, kind int, bucket long, n long, v long, total long, counts binary, held binary"
_WORD, _PAIR, _TRI, _BLOB = range(4)


@dataclass(frozen=True)
class Layout:
    """How keys are dealt: buckets by their upper `bits`; a place is bucket * 4 + kind."""

    bits: int
    gram_bits: int

    def low(self, kind: int) -> int:
        """The bits of a key below its bucket."""
        return (64 if kind == _WORD else self.gram_bits + 1) - self.bits

    def messages(self, chunk: int, em: bool, kind: int, key: np.ndarray, count: np.ndarray) -> list[tuple]:
        low = self.low(kind)
        border = np.append(np.searchsorted(key, np.arange(1 << self.bits, dtype=np.uint64) << np.uint64(low)) if self.bits else 0, len(key))
        rows = []
        for bucket in np.flatnonzero(np.diff(border)).tolist():
            part = slice(border[bucket], border[bucket + 1])
            steps = np.diff(key[part], prepend=np.uint64(bucket << low if self.bits else 0))
            rows.append((bucket * 4 + kind, chunk, em, len(steps), _squeeze(steps), _squeeze(count[part].astype(np.uint32))))
        return rows


def _ask(layout: Layout) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """From chunks, the counted words and pairs for each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                t = _open(b.column(3)[k].as_py())
                tok, sizes = tokens(t.column("text"))
                train = np.repeat(t.column("train").to_numpy().astype(np.uint64), sizes)
                for kind in (_WORD, _PAIR):
                    key, count = _counted(tok if kind == _WORD else grams(tok, sizes, layout.gram_bits)[0], train)
                    yield _rows(_ASK, layout.messages(b.column(0)[k].as_py(), b.column(1)[k].as_py(), kind, key, count))

    return run


def _answer(layout: Layout) -> Callable[[pa.Table], pa.Table]:
    """From all chunks' keys in a bucket, for each chunk twice the total and 1 more if other chunks have the key, and for held-out chunks
    the held-out totals; a row with chunk -1 has the bucket's V and N."""

    def run(group: pa.Table) -> pa.Table:
        place = group.column("place")[0].as_py()
        bucket, kind = place >> 2, place & 3
        n = group.column("n").to_numpy()
        em = group.column("em").to_numpy(zero_copy_only=False).astype(bool)
        base = np.uint64(bucket << layout.low(kind) if layout.bits else 0)
        keys = np.concatenate([np.cumsum(_expand(x.as_py(), int(m), np.uint64), dtype=np.uint64) + base for x, m in zip(group.column("keys"), n, strict=True)])
        count = np.concatenate([_expand(x.as_py(), int(m), np.uint32) for x, m in zip(group.column("counts"), n, strict=True)]).astype(np.float64)
        _, where = np.unique(keys, return_inverse=True)
        total = np.bincount(where, count)
        held = np.bincount(where, count * np.repeat(em, n))
        cut = np.cumsum(n)[:-1]
        told = 2 * total.astype(np.uint64) + (np.bincount(where) > 1)
        back, out = np.split(told[where].astype(np.uint64), cut), np.split(held[where].astype(np.uint64), cut)
        rows = [(c.as_py(), bool(e), kind, bucket, int(m), 0, 0, _squeeze(x), _squeeze(y) if e else b"") for c, e, m, x, y in zip(group.column("chunk"), em, n, back, out, strict=True)]
        if kind == _WORD:
            rows.append((-1, False, kind, bucket, int(held.sum()), int((total > 0).sum()), int(total.sum()), b"", b""))
        return pa.Table.from_batches([_rows(_ANSWER, rows)])

    return run


@dataclass
class Known:
    """A chunk's texts, their tokens, and for each of the tokens corpus counts of the word, its context, their pair,
    the pair before and the trigram; held: the same of held-out texts only."""

    chunk: int
    em: bool
    table: pa.Table
    tok: np.ndarray
    sizes: np.ndarray
    counts: list[np.ndarray]
    held: list[np.ndarray]


def _met(batches: Iterator[pa.RecordBatch], layout: Layout, ends: tuple[int, int], third: bool) -> Iterator[tuple[Known, np.ndarray, np.ndarray]]:
    """From rows (chunk, kind, bucket, em, n, data, held) by chunk, answers first, then the blob: what is known of the chunk, its trigrams,
    and which of these are to be asked for. third: whether the answers have the trigrams."""
    answers: list[list[list[np.ndarray]]] = [[[], []] for _ in range(3)]
    for b in batches:
        kinds, ems, n = b.column(1).to_pylist(), b.column(3).to_pylist(), b.column(4).to_pylist()
        for k, kind in enumerate(kinds):
            raw = b.column(5)[k].as_py()
            if kind < _BLOB:
                answers[kind][0].append(_expand(raw, n[k], np.uint64))
                if ems[k]:
                    answers[kind][1].append(_expand(b.column(6)[k].as_py(), n[k], np.uint64))
                continue
            t = _open(raw)
            tok, sizes = tokens(t.column("text"))
            first = np.cumsum(sizes) - sizes
            pair, tri = grams(tok, sizes, layout.gram_bits)
            train = np.repeat(t.column("train").to_numpy().astype(np.uint64), sizes)
            at_word, at_pair = np.searchsorted(_counted(tok, train)[0], tok), np.searchsorted(_counted(pair, train)[0], pair)
            parts, ask = [], np.zeros(len(tok), bool)
            for side in range(2 if ems[k] else 1):
                word, both = (np.concatenate(answers[kind][side]).astype(np.int64) for kind in (_WORD, _PAIR))
                word, both = word[at_word], both[at_pair]
                if side == 0:
                    ask[1:] = both[:-1] & 1
                    word, both = word >> 1, both >> 1
                context, before = np.concatenate([word[:1], word[:-1]]), np.concatenate([both[:1], both[:-1]])
                context[first], before[first] = ends[side], ends[side]
                parts.append([word, context, both, before])
            ask[first] = False
            if third:
                asked, local = _counted(tri[ask], train[ask]), _counted(tri[~ask], train[~ask])
                for side, part in enumerate(parts):
                    c = np.empty(len(tok), np.int64)
                    if ask.any():
                        c[ask] = (np.concatenate(answers[_TRI][side]).astype(np.int64) >> (side == 0))[np.searchsorted(asked[0], tri[ask])]
                    c[~ask] = local[1][np.searchsorted(local[0], tri[~ask])]
                    c[first] = part[2][first]
                    part.append(c)
            yield Known(b.column(0)[k].as_py(), ems[k], t, tok, sizes, parts[0], parts[-1] if ems[k] else []), tri[ask], train[ask]
            answers = [[[], []] for _ in range(3)]


def context_bucket(c: np.ndarray) -> np.ndarray:
    """0 for contexts that were never seen, else one more than the floor of the binary logarithm."""
    return np.minimum(np.where(c > 0, np.floor(np.log2(np.maximum(c, 1))) + 1, 0), _CONTEXTS - 1).astype(np.int64)


def _ratio_bin(r: np.ndarray) -> np.ndarray:
    return np.where(r > 0, np.clip(np.floor(8 * np.log2(np.maximum(r, 1e-300))) + 513, 1, _BINS - 1), 0).astype(np.int64)


def em_weight(tokens_in: np.ndarray, ratio: np.ndarray, rounds: int = 200) -> float:
    """The weight a of the higher estimate by expectation-maximisation; ratio: higher by lower estimate, tokens_in: tokens with it."""
    a = 0.5
    for _ in range(rounds):
        a = float((tokens_in * (a * ratio / (a * ratio + 1 - a))).sum() / tokens_in.sum())
        a = min(max(a, 1e-4), 1 - 1e-4)
    return a


def _weights(cells: pd.DataFrame) -> np.ndarray:
    """The weight for each context bucket from rows (context, tokens, ratio); a bucket without tokens has its lower neighbour's."""
    out, found = np.zeros(_CONTEXTS), {}
    for b, c in cells.groupby("context"):
        if b > 0:
            found[int(b)] = em_weight(c["tokens"].to_numpy(), c["ratio"].to_numpy())
    for b in range(1, _CONTEXTS):
        near = min(found, key=lambda k: (abs(k - b), k), default=None)
        out[b] = found[near] if near is not None else 0.5
    return out


@dataclass
class Weights:
    """Weights of each order by context bucket; the first order has no context and the one weight."""

    one: float = 0.5
    two: np.ndarray = field(default_factory=lambda: np.zeros(_CONTEXTS))
    three: np.ndarray = field(default_factory=lambda: np.zeros(_CONTEXTS))

    def ratios(self, order: int, c: list[np.ndarray], n: int, v: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(context bucket, higher estimate, mixture of the lower orders) of each token from the counts of Known."""
        word, context, pair, before, tri = c
        lower, p = np.full(len(word), 1 / (v + 1)), word / max(n, 1)
        if order == 1:
            return np.ones(len(word), np.int64), p, lower
        lower, p, b = self.one * p + (1 - self.one) * lower, pair / np.maximum(context, 1), context_bucket(context)
        if order == 2:
            return b, p, lower
        lower = self.two[b] * p + (1 - self.two[b]) * lower
        return context_bucket(before), tri / np.maximum(before, 1), lower

    def probability(self, c: list[np.ndarray], n: int, v: int) -> np.ndarray:
        b, p, lower = self.ratios(3, c, n, v)
        return self.three[b] * p + (1 - self.three[b]) * lower


def score(docs: DataFrame, train: Column, held: Column, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = CHUNK_BYTES, bucket_bytes: int = BUCKET_BYTES, found: list[Weights] | None = None) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) of every row.

    train: which rows to learn from; held: of these, which serve to learn the weights (best by content, so that
    copies go together). found: gets the weights.
    """
    src = small_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), train.alias("train"), (train & held).alias("em"))
    chunks = stored(_chunks(src, chunk_bytes), "lm-chunks")
    size, n_chunks = chunks.agg(F.coalesce(F.sum("bytes"), F.lit(0)), F.count("*")).first()
    layout = Layout(min(40, max(0, ceil(log2(max(1, size / bucket_bytes))))), min(62, ceil(log2(size + 2)) + 21))
    spread = 8 << layout.bits  # partitions, several times the places, so that few tasks get more than one

    def totals(asked: DataFrame, name: str) -> DataFrame:
        return stored(asked.repartition(spread, "place").groupBy("place").applyInArrow(_answer(layout), _ANSWER), name)

    answers = totals(chunks.mapInArrow(_ask(layout), _ASK), "lm-answers")
    sums = answers.where("chunk = -1").agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in ("v", "total", "n")]).first()
    v, n, n_held = (int(x) for x in sums)
    train_docs, em_docs = docs.select(F.coalesce(train, F.lit(False)).alias("t"), F.coalesce(train & held, F.lit(False)).alias("e")).agg(F.count_if("t"), F.count_if("e")).first()
    ends = (train_docs, em_docs)

    def meeting(found: DataFrame, only_em: bool) -> DataFrame:
        a, c = found.where("chunk >= 0"), chunks
        if only_em:
            a, c = a.where("em"), c.where("em")
        a = a.select("chunk", "kind", "bucket", "em", "n", F.col("counts").alias("data"), "held")
        zero = F.lit(0).cast("long")
        c = c.select("chunk", F.lit(_BLOB).alias("kind"), zero.alias("bucket"), "em", zero.alias("n"), F.col("blob").alias("data"), F.lit(b"").alias("held"))
        return a.unionByName(c).repartition(max(1, 2 * n_chunks // (20 if only_em else 1)), "chunk").sortWithinPartitions("chunk", "kind", "bucket")

    def ask_more(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, tri, learned in _met(batches, layout, ends, False):
            yield _rows(_ASK, layout.messages(k.chunk, k.em, _TRI, *_counted(tri, learned)))

    both = answers.unionByName(totals(meeting(answers, False).mapInArrow(ask_more, _ASK), "lm-answers"))

    def kept_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, _, _ in _met(batches, layout, ends, True):
            yield _rows("n long, counts binary", [(len(k.tok), _squeeze(np.concatenate([a - b for a, b in zip(k.counts, k.held, strict=True)])))])

    kept = stored(meeting(both, True).mapInArrow(kept_counts, "n long, counts binary"), "lm-held-out")
    weights = Weights()

    def ratios(order: int) -> pd.DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums = np.zeros((2, _CONTEXTS * _BINS))
            for batch in batches:
                for m, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    b, p, lower = weights.ratios(order, np.split(_expand(raw.as_py(), 5 * m, np.int64), 5), n - n_held, v)
                    r = p / lower
                    at = b * _BINS + _ratio_bin(r)
                    sums[0] += np.bincount(at, minlength=sums.shape[1])
                    sums[1] += np.bincount(at, r, sums.shape[1])
            at = np.flatnonzero(sums[0])
            yield pa.RecordBatch.from_arrays([pa.array((at // _BINS).astype(np.int32)), pa.array((at % _BINS).astype(np.int32)), *(pa.array(x[at]) for x in sums)], names=["context", "bin", "tokens", "ratio"])

        # at most contexts x bins rows come to the driver
        rows = kept.mapInArrow(run, "context int, bin int, tokens double, ratio double").groupBy("context", "bin").agg(F.sum("tokens").alias("tokens"), F.sum("ratio").alias("ratio"))
        got = rows.toPandas().sort_values(["context", "bin"])
        got["ratio"] /= got["tokens"]
        return got

    if n > n_held:
        weights.one = float(_weights(ratios(1))[1])
        weights.two = _weights(ratios(2))
        weights.three = _weights(ratios(3))
    if found is not None:
        found.append(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, _, _ in _met(batches, layout, ends, True):
            word = k.counts[0]
            p = weights.probability(k.counts, n, v) if n else np.ones(len(word))
            base = np.log10((word + 0.5) / (n + 0.5 * (v + 1)))
            first = np.cumsum(k.sizes) - k.sizes
            add = lambda x: np.add.reduceat(x, first)
            yield pa.RecordBatch.from_arrays(
                [k.table.column("doc_id").combine_chunks(), pa.array(k.sizes), pa.array(add((word > 0).astype(np.int64))), pa.array(np.full(len(first), n)), pa.array(add(base)), pa.array(add(np.log10(p)))],
                names=["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
            )

    return meeting(both, False).mapInArrow(run, "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double")
