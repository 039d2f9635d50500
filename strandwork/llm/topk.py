"""Exact top-k by integer inner product with block-at-a-time pruning.

Vectors are dealt to cells (the nearest of centres that are fitted on a bounded sample of
SAMPLE vectors; every vector is indexed), sorted by cell and id, and packed into blocks of
consecutive rows (document ranges), each with the maximum and minimum of every component.
For a query a block's bound is the sum over components of what its maxima (or minima, for
negative components) allow.  Blocks form groups of bounded size, with maxima and minima
of their own.  A query first goes to the group with the highest bound; its k-th score
there is the floor with which it goes only to those other groups whose bound reaches
it.  Within a group blocks are taken by falling bound and scored through their forward
index until a bound falls below the floor or the k-th score so far.  Queries pass in chunks of
near ones; no score depends on the cells.

A vector that is null or holds null or non-finite components takes no part; only
vectors of one length meet.  A null id is no query, and as a candidate ranks after
all ids of the same score.  Repeated rows are rows: only a query's own row is left
out.  Fewer candidates than k give fewer results; empty tables give none.  Scores beyond a long are its least or greatest value.  Extra
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import hashed_below, stored

#: Rows of a block, and rows of a group of blocks.
BLOCK, GROUP = 128, 16_384
#: Queries that pass through a group at once.
CHUNK = 256
#: Vectors that the centres are fitted on, and centres, at most.
SAMPLE, CENTRES = 4_096, 512
#: Summaries of groups in one page.
PAGE = 1_024
_PACK = "grp int, kind int, dim int, chunk long, uids binary, ids binary, vecs binary, floors binary"
_BEST = "chunk long, uid long, query_id long, vec_id long, score long, blocks long, scored long"
_NO_ID = np.iinfo(np.int64).max
_NO_FLOOR = np.iinfo(np.int64).min


def exact(v: Column, scale: int = 1024) -> Column:
    return F.transform(v, lambda x: F.floor(x.cast("double") * scale).cast("long"))


def _centres(sample: list[np.ndarray], count: int, rounds: int = 6) -> np.ndarray:
    """Centres of vectors of one length, by Lloyd's rounds from evenly spaced vectors."""
    x = np.stack(sample).astype(np.float64)
    c = x[np.linspace(0, len(x) - 1, min(count, len(x))).astype(np.int64)]
    for _ in range(rounds):
        near = (x @ c.T - 0.5 * (c * c).sum(1)).argmax(1)
        for k in np.unique(near):
            c[k] = x[near == k].mean(0)
    return c


def _celled(rows: DataFrame, centres: dict[int, np.ndarray]) -> DataFrame:
    """rows (id, vec) with cell, the nearest centre of the vector's length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, flat = b.column(1).value_lengths().to_numpy(), b.column(1).flatten().to_numpy().astype(np.float64)
            start, cell = np.cumsum(length) - length, np.zeros(b.num_rows, np.int32)
            for dim, c in centres.items():
                mine = np.flatnonzero(length == dim)
                if dim and len(mine):
                    x = flat[start[mine][:, None] + np.arange(dim)]
                    cell[mine] = (x @ c.T - 0.5 * (c * c).sum(1)).argmax(1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell)], names=["id", "vec", "cell"])

    return rows.mapInArrow(run, "id long, vec array<long>, cell int")


def _row(grp: int, kind: int, dim: int, chunk: int, uid: np.ndarray, ids: np.ndarray, vec: np.ndarray, floors: np.ndarray | None = None) -> pa.RecordBatch:
    floors = np.full(len(uid), _NO_FLOOR) if floors is None else floors
    cols = [pa.array([x], t) for x, t in ((grp, pa.int32()), (kind, pa.int32()), (dim, pa.int32()), (chunk, pa.int64()))]
    return pa.RecordBatch.from_arrays([*cols, *(pa.array([np.ascontiguousarray(x).tobytes()], pa.binary()) for x in (uid, ids, vec, floors))], names=["grp", "kind", "dim", "chunk", "uids", "ids", "vecs", "floors"])


def _packed(rows: DataFrame, size: int, kind: int) -> DataFrame:
    """Blocks of consecutive rows of each partition; grp is the partition. rows: uid, id, vec (sorted)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        grp = TaskContext.get().partitionId()
        held: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}
        chunk = grp << 32

        def out(dim: int, all_rows: bool) -> Iterator[pa.RecordBatch]:
            nonlocal chunk
            uid, ids, vec = (np.concatenate(c) for c in zip(*held[dim], strict=True))
            stop = len(uid) if all_rows else len(uid) // size * size
            for a in range(0, stop, size):
                b = min(a + size, stop)
                yield _row(grp, kind, dim, chunk, uid[a:b], ids[a:b], vec[a:b])
                chunk += 1
            held[dim] = [(uid[stop:], ids[stop:], vec[stop:])]

        for batch in batches:
            uid = batch.column(0).to_numpy()
            ids = batch.column(1).fill_null(_NO_ID).to_numpy()
            lists = batch.column(2)
            length = lists.value_lengths().to_numpy()
            flat = lists.flatten().to_numpy()
            start = np.cumsum(length) - length
            for dim in np.unique(length):
                mine = np.flatnonzero(length == dim)
                vec = flat[(start[mine][:, None] + np.arange(dim)).ravel()].reshape(len(mine), dim) if dim else np.zeros((len(mine), 0), np.int64)
                held.setdefault(int(dim), []).append((uid[mine], ids[mine], vec))
                yield from out(int(dim), False)
        for dim in held:
            if len(held[dim][0][0]) or len(held[dim]) > 1:
                yield from out(dim, True)

    return rows.mapInArrow(run, _PACK)


def _bounds(q: np.ndarray, high: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, bool]:
    """What each query can score at most with rows between low and high, and whether that is beyond what doubles hold exactly."""
    f = q.astype(np.float64)
    most = float(max(np.abs(high).max(initial=0), np.abs(low).max(initial=0)))
    wide = float(np.abs(f).max(initial=0)) * most * max(q.shape[1], 1) >= 2.0**53
    bound = np.maximum(f, 0) @ high.T + np.minimum(f, 0) @ low.T
    if wide:  # integers of any size are compared with them, so there is room for rounding
        bound += np.abs(bound) * 1e-9 + 1
    return bound, wide


class _Group:
    """Blocks of one group and one length."""

    def __init__(self, blocks: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> None:
        self.uids, self.ids = [b[0] for b in blocks], [b[1] for b in blocks]
        self.high = np.stack([b[2].max(0) for b in blocks]).astype(np.float64)
        self.low = np.stack([b[2].min(0) for b in blocks]).astype(np.float64)
        self.vecs = [b[2] for b in blocks]
        self.floats = [b[2].astype(np.float64) for b in blocks]

    def best(self, uid: np.ndarray, q: np.ndarray, k: int, floors: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, int]]:
        """(place of the query, ids, scores, blocks scored) of its k best here that reach its floor."""
        bound, wide = _bounds(q, self.high, self.low)
        f = q.astype(np.float64)
        order = np.argsort(-bound, 1, kind="stable")
        for i in range(len(q)):
            ids, scores = np.zeros(0, np.int64), np.zeros(0, object if wide else np.float64)
            floor, done = int(floors[i]), 0
            for b in order[i]:
                least = max(floor, scores[-1]) if len(scores) == k else floor
                if bound[i, b] < least:
                    break
                done += 1
                s = self.vecs[b].astype(object) @ q[i].astype(object) if wide else self.floats[b] @ f[i]
                other = (self.uids[b] != uid[i]) & (s >= least)
                if not other.any():
                    continue
                ids, scores = np.concatenate([ids, self.ids[b][other]]), np.concatenate([scores, s[other]])
                keep = np.lexsort((ids, -scores))[:k] if not wide else np.array(sorted(range(len(ids)), key=lambda j: (-scores[j], ids[j]))[:k])
                ids, scores = ids[keep], scores[keep]
            yield i, ids, scores, done


def _unpacked(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    uid, ids, floors = (np.frombuffer(row[c], np.int64) for c in ("uids", "ids", "floors"))
    return uid, ids, np.frombuffer(row["vecs"], np.int64).reshape(len(uid), row["dim"]), floors


def _searched(blocks: DataFrame, sent: DataFrame, groups: int, k: int) -> DataFrame:
    """The best rows of each group for the queries sent to it; a row without vec_id and score counts blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grp, raw, ready = None, {}, {}
        for batch in batches:
            for row in batch.to_pylist():
                if row["grp"] != grp:
                    grp, raw, ready = row["grp"], {}, {}
                dim = row["dim"]
                uid, ids, vec, floors = _unpacked(row)
                if row["kind"] == 0:
                    raw.setdefault(dim, []).append((uid, ids, vec))
                    continue
                if dim not in raw:
                    continue
                if dim not in ready:
                    ready[dim] = _Group(raw[dim])
                out: list[tuple] = []
                for i, found, scores, done in ready[dim].best(uid, vec, k, floors):
                    out.append((row["chunk"], int(uid[i]), int(ids[i]), None, None, len(raw[dim]), done))
                    out += [(row["chunk"], int(uid[i]), int(ids[i]), None if x == _NO_ID else int(x), min(max(int(s), -(2**63)), 2**63 - 1), 0, 0) for x, s in zip(found, scores, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in zip(*out, strict=True)], names=[c.split()[0] for c in _BEST.split(", ")])

    both = blocks.unionByName(sent).repartition(groups, "grp").sortWithinPartitions("grp", "kind")
    return both.mapInArrow(run, _BEST)


def _summaries(blocks: DataFrame) -> DataFrame:
    """(page, dim, grps, highs, lows): maxima and minima of each group and length, PAGE groups to a row."""

    def bounds(group: pa.Table) -> pa.Table:
        grp, dim = group.column("grp")[0].as_py(), group.column("dim")[0].as_py()
        vecs = [np.frombuffer(v.as_py(), np.int64).reshape(-1, dim) if dim else np.zeros((1, 0), np.int64) for v in group.column("vecs")]
        high, low = (np.stack([f(v) for v in vecs]) for f in (lambda v: v.max(0), lambda v: v.min(0)))
        return pa.table({"page": pa.array([grp // PAGE], pa.int32()), "dim": pa.array([dim], pa.int32()), "grp": pa.array([grp], pa.int32()), "high": pa.array([high.max(0).astype(float).tobytes()], pa.binary()), "low": pa.array([low.min(0).astype(float).tobytes()], pa.binary())})

    def page(group: pa.Table) -> pa.Table:
        grps = group.column("grp").to_numpy().astype(np.int32).tobytes()
        parts = [b"".join(x.as_py() for x in group.column(c)) for c in ("high", "low")]
        return pa.table({"page": group.column("page").slice(0, 1), "dim": group.column("dim").slice(0, 1), "grps": pa.array([grps], pa.binary()), "highs": pa.array(parts[:1], pa.binary()), "lows": pa.array(parts[1:], pa.binary())})

    one = blocks.select("grp", "dim", "vecs").groupBy("grp", "dim").applyInArrow(bounds, "page int, dim int, grp int, high binary, low binary")
    return one.groupBy("page", "dim").applyInArrow(page, "page int, dim int, grps binary, highs binary, lows binary")


def _sent(chunks: DataFrame, pages: DataFrame, n_pages: int, first: bool) -> DataFrame:
    """Queries dealt to groups. first: each to the group of a page with the highest bound; else to those others whose bound reaches its floor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                uid, ids, vec, floors = _unpacked(row)
                grps = np.frombuffer(row["grps"], np.int32)
                high, low = (np.frombuffer(row[c], np.float64).reshape(len(grps), row["dim"]) for c in ("highs", "lows"))
                bound, _ = _bounds(vec, high, low)
                best = bound.argmax(1)
                for g in range(len(grps)):
                    mine = np.flatnonzero(best == g if first else (best != g) & (bound[:, g] >= floors))
                    if len(mine):
                        yield _row(int(grps[g]), 1, row["dim"], row["chunk"], uid[mine], ids[mine], vec[mine], floors[mine])

    paged = chunks.withColumn("page", F.explode(F.sequence(F.lit(0), F.lit(n_pages - 1))))
    return paged.join(pages, ["page", "dim"]).drop("page").mapInArrow(run, _PACK)


def _floored(chunks: DataFrame, best: DataFrame, k: int) -> DataFrame:
    """chunks with each query's floor, its k-th score so far."""
    rank = F.row_number().over(Window.partitionBy("chunk", "uid").orderBy(F.desc("score")))
    kth = best.where("score is not null").withColumn("r", rank).where(F.col("r") == k).groupBy("chunk").agg(F.collect_list(F.struct("uid", "score")).alias("kth"))  # CHUNK queries at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                uid, ids, vec, floors = _unpacked(row)
                known = {x["uid"]: x["score"] for x in row["kth"] or []}
                yield _row(row["grp"], 1, row["dim"], row["chunk"], uid, ids, vec, np.array([known.get(u, f) for u, f in zip(uid.tolist(), floors.tolist(), strict=True)], np.int64))

    return chunks.join(kth, "chunk", "left").mapInArrow(run, _PACK)


def top_k(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 10, every: int = 100, scale: int = 1024, group: int = GROUP, report: list[DataFrame] | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): queries are the rows whose id is divisible by `every`.

    report: gets a table (blocks, scored): pairs of a query and a block, and those that were scored.
    """
    spark = vectors.sparkSession
    src = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
    fine = F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = src.where(fine).select("id", exact(F.col("v"), scale).alias("vec"))
    n = whole.count()
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    sample: dict[int, list[np.ndarray]] = {}
    for row in whole.where(hashed_below("vec", SAMPLE, n)).select("vec").limit(2 * SAMPLE).collect():
        sample.setdefault(len(row["vec"]), []).append(np.array(row["vec"], np.float64))
    count = min(CENTRES, max(1, n // BLOCK))
    centres = {dim: _centres(sorted(x, key=tuple), count) for dim, x in sample.items()}
    rows = stored(_celled(whole, centres).withColumn("uid", F.monotonically_increasing_id()), "vectors")
    parts = max(1, ceil(n / group))
    order = ["cell", "id", "uid"]
    pick = ["uid", "id", "vec"]
    blocks = stored(_packed(rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).select(*pick), BLOCK, 0), "blocks")
    asked = rows.where(F.col("id") % every == 0).repartitionByRange(max(1, ceil(n / every / (16 * CHUNK))), *order)
    chunks = stored(_packed(asked.sortWithinPartitions(*order).select(*pick), CHUNK, 1), "chunks")
    pages, n_pages = stored(_summaries(blocks), "summaries"), ceil(parts / PAGE)
    first = stored(_searched(blocks, _sent(chunks, pages, n_pages, True), parts, k), "best")
    rest = _searched(blocks, _sent(_floored(chunks, first, k), pages, n_pages, False), parts, k)
    best = first.unionByName(stored(rest, "best") if report is not None else rest)
    if report is not None:
        every_pair = chunks.join(blocks.groupBy("dim").agg(F.count("*").alias("n")), "dim").agg(F.sum(F.octet_length("uids") / 8 * F.col("n")).cast("long").alias("blocks"))
        report.append(every_pair.join(best.agg(F.sum("scored").alias("scored"))))
    rank = F.row_number().over(Window.partitionBy("uid").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last()))
    return best.where("score is not null").withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


SQL = """
WITH good AS (
  SELECT row_number() OVER () AS uid, vec_id, [floor(x::DOUBLE * 1024)::BIGINT FOR x IN embedding] AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR isnan(x) OR isinf(x)]) = 0),
scored AS (
  SELECT q.vec_id AS query_id, q.uid, c.vec_id,
         list_sum([q.v[i] * c.v[i] FOR i IN range(1, len(q.v) + 1)])::BIGINT AS score
  FROM good q JOIN good c ON q.uid <> c.uid AND len(q.v) = len(c.v)
  WHERE q.vec_id % 100 = 0),
ranked AS (
  SELECT *, (row_number() OVER (PARTITION BY uid ORDER BY score DESC, vec_id ASC NULLS LAST))::INTEGER AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""
