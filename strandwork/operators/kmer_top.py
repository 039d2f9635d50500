"""The best references of each query by k-mer TF-IDF cosine, without a row for each k-mer.

References are dealt into chunks. A chunk sends each bucket of k-mers one row with the distinct k-mers it has there,
the bucket adds up their document frequencies and answers each chunk with one row, and the chunk then scores its
references against all queries. Everything is exact: a k-mer is compared in full, no reference or k-mer is left out.
"""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .kmer import ranked, tfidf_scores

#: Characters of references in a chunk, and for which there is a bucket of k-mers.
CHUNK_CHARS = 1 << 23
#: k-mers, and scores, that are handled at a time.
PART = 1 << 20
#: Queries that every task may hold; with more, tfidf_scores() is asked.
QUERIES = 20_000

Grams = tuple[np.ndarray, np.ndarray]  # distinct k-mers in order, and a number for each


def _runs(x: np.ndarray) -> np.ndarray:
    """Where the runs of a sorted array begin."""
    return np.flatnonzero(np.concatenate((np.ones(min(len(x), 1), bool), x[1:] != x[:-1])))


def _distinct(x: np.ndarray) -> Grams:
    x = np.sort(x)
    at = _runs(x)
    return x[at], np.diff(at, append=len(x)).astype(np.uint32)


def _types(k: int) -> tuple[str, str]:
    """Narrow k-mers (at most 8 characters, all below U+0100) are integers of their bytes, wide ones are UTF-32."""
    return "<u8", f"S{4 * k}"


def _windows(parts: list[str], k: int) -> tuple[np.ndarray, np.ndarray]:
    """Narrow and wide k-mers of a document's texts, repeats included."""
    narrow, wide = ([np.zeros(0, t)] for t in _types(k))
    for s in parts:
        n = len(s) - k + 1
        if n < 1:
            continue
        b, big = None, None
        if k <= 8:
            try:
                b = s.encode("latin-1")
            except UnicodeEncodeError:
                b = None
        if b is None:
            u = s.encode("utf-32-be", "surrogatepass")
            every = np.ndarray((n,), _types(k)[1], u, strides=(4,))
            if k > 8:
                wide.append(every)
                continue
            c = np.frombuffer(u, ">u4")
            above = np.concatenate(([0], np.cumsum(c > 255)))
            big = above[k:] > above[:-k]
            wide.append(every[big])
            b = np.where(c > 255, 0, c).astype(np.uint8).tobytes()
        x = np.ndarray((n,), "<u8", b + bytes(8), strides=(1,))
        if k < 8:
            x = x & np.uint64((1 << 8 * k) - 1)
        narrow.append(x if big is None else x[~big])
    return tuple(x[0] if len(x) == 1 else x[1] if len(x) == 2 else np.concatenate(x) for x in (narrow, wide))


def _slices(docs: list[list[str]], k: int, most: int) -> Iterator[tuple[int, int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]]]:
    """(first document, number, for narrow and for wide k-mers: distinct k-mers of each document, counts, document from 0)."""
    first, size, held = 0, 0, []

    def out() -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        return [(np.concatenate([h[w][0] for h in held]), np.concatenate([h[w][1] for h in held]), np.repeat(np.arange(len(held)), [len(h[w][0]) for h in held])) for w in (0, 1)]

    for at, parts in enumerate(docs):
        held.append([_distinct(x) for x in _windows(parts, k)])
        size += len(held[-1][0][0]) + len(held[-1][1][0])
        if size >= PART or len(held) >= most:
            yield first, len(held), out()
            first, size, held = at + 1, 0, []
    if held:
        yield first, len(held), out()


def _vocabulary(docs: list[list[str]], k: int) -> list[Grams]:
    """Narrow and wide k-mers of a chunk with their numbers of documents."""
    parts = [[_distinct(x[0]) for x in xs] for _, _, xs in _slices(docs, k, PART)]
    out = []
    for w in (0, 1):
        x, c = (np.concatenate([np.zeros(0, t)] + [p[w][i] for p in parts]) for i, t in ((0, _types(k)[w]), (1, np.uint32)))
        order = np.argsort(x)
        x = x[order]
        at = _runs(x)
        out.append((x[at], np.add.reduceat(c[order], at).astype(np.uint32) if len(at) else c))
    return out


def _buckets(x: np.ndarray, k: int, buckets: int) -> np.ndarray:
    """The bucket of each k-mer, by its last four characters (so neighbours in order stay together), or, if wide, by all of them."""
    if x.dtype.kind == "S":
        h = np.zeros(len(x), np.uint64)
        for c in np.frombuffer(x.tobytes(), ">u4").reshape(len(x), k).T:
            h = (h + c) * np.uint64(0x9E3779B97F4A7C15)
    else:
        h = ((x >> np.uint64(max(0, 8 * k - 32))) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    b = ((h >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
    return b.astype(np.int64) + (buckets if x.dtype.kind == "S" else 0)


def _pack(x: np.ndarray | bytes) -> bytes:
    b = x if isinstance(x, bytes) else x.tobytes()
    return len(b).to_bytes(8, "little") + pa.compress(b, "zstd", asbytes=True)


def _unpack(b: bytes) -> bytes:
    return pa.decompress(b[8:], int.from_bytes(b[:8], "little"), "zstd", asbytes=True)


def _requests(chunk: int, docs: list[list[str]], k: int, buckets: int, counted: bool) -> Iterator[dict]:
    for x, c in _vocabulary(docs, k):
        b = _buckets(x, k, buckets)
        order = np.argsort(b, kind="stable")
        for at in np.split(order, _runs(b[order])[1:]) if len(b) else ():
            yield {"bucket": int(b[at[0]]), "chunk": chunk, "grams": _pack(x[at]), "counts": _pack(c[at] if counted else np.zeros(len(at), np.uint32))}


def _answers(table: pa.Table, k: int, buckets: int) -> pa.Table:
    """A bucket's document frequencies, for each chunk in the order of its k-mers."""
    bucket = table.column("bucket")[0].as_py()
    kind = _types(k)[bucket >= buckets]
    asked = [np.frombuffer(_unpack(b.as_py()), kind) for b in table.column("grams")]
    counts = np.concatenate([np.frombuffer(_unpack(b.as_py()), np.uint32) for b in table.column("counts")])
    x = np.concatenate(asked)
    order = np.argsort(x)
    at = _runs(x[order])
    found = np.empty(len(x), np.uint32)
    found[order] = np.repeat(np.add.reduceat(counts[order], at, dtype=np.uint32), np.diff(at, append=len(x)))
    ends = np.cumsum([len(a) for a in asked])
    return pa.table({"chunk": table.column("chunk"), "bucket": table.column("bucket"), "found": pa.array([_pack(f) for f in np.split(found, ends[:-1])], pa.binary())})


def _frequencies(vocabulary: list[Grams], k: int, buckets: int, found: dict[int, bytes]) -> list[np.ndarray]:
    """The answers put into the order of the vocabulary."""
    out = []
    for x, _ in vocabulary:
        b = _buckets(x, k, buckets)
        order = np.argsort(b, kind="stable")
        df = np.empty(len(x), np.uint32)
        if len(b):
            df[order] = np.concatenate([np.frombuffer(_unpack(found[i]), np.uint32) for i in np.unique(b).tolist()])
        out.append(df)
    return out


def _idf(df: np.ndarray, n: int) -> np.ndarray:
    return np.log((1 + n) / (1 + df.astype(np.float64))) + 1


class _Asked:
    """All queries: their k-mers, and for each of these the queries that have it with their weights."""

    def __init__(self, docs: list[list[str]], k: int, n: int, vocabulary: list[Grams], df: list[np.ndarray]) -> None:
        self.size = len(docs)
        norm = np.zeros(self.size)
        rows: list[list[tuple[np.ndarray, ...]]] = [[], []]
        for first, _, xs in _slices(docs, k, PART):
            for w, (x, tf, d) in enumerate(xs):
                at = np.searchsorted(vocabulary[w][0], x)
                known = df[w][at] > 0  # k-mers of no reference don't count
                weight = tf[known] * _idf(df[w][at[known]], n)
                norm += np.bincount(d[known] + first, weight * weight, self.size)
                rows[w].append((at[known], d[known] + first, weight))
        self.norm = np.sqrt(norm)
        self.grams, self.start, self.query, self.weight = [], [], [], []
        for w in (0, 1):
            at, q, weight = (np.concatenate(c) for c in zip(*rows[w], strict=True)) if rows[w] else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
            order = np.argsort(at, kind="stable")
            self.grams.append(vocabulary[w][0])
            self.start.append(np.searchsorted(at[order], np.arange(len(vocabulary[w][0]) + 1)))
            self.query.append(q[order])
            self.weight.append(weight[order])


def _scores(ids: np.ndarray, docs: list[list[str]], k: int, n: int, top: int, digits: int, asked: _Asked, vocabulary: list[Grams], df: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, id, cosine): each query's best of a chunk, by cosine, then id."""
    idf = [_idf(f, n) for f in df]
    place = []  # of the chunk's k-mers among those of the queries, or -1
    for w in (0, 1):
        at = np.searchsorted(asked.grams[w], vocabulary[w][0])
        same = at < len(asked.grams[w])
        same[same] = asked.grams[w][at[same]] == vocabulary[w][0][same]
        place.append(np.where(same, at, -1))
    best = (np.zeros(0, np.int64), ids[:0], np.zeros(0))
    for first, number, xs in _slices(docs, k, max(1, 4 * PART // asked.size)):
        norm, dots = np.zeros(number), np.zeros(number * asked.size)
        for w, (x, tf, d) in enumerate(xs):
            if not len(x):
                continue
            order = np.argsort(x)
            x, d = x[order], d[order]
            at = _runs(x)
            which = np.repeat(np.searchsorted(vocabulary[w][0], x[at]), np.diff(at, append=len(x)))
            weight = tf[order] * idf[w][which]
            norm += np.bincount(d, weight * weight, number)
            gram = place[w][which]
            hit = np.flatnonzero(gram >= 0)
            for part in np.array_split(hit, max(1, len(hit) // (PART // 16))):
                begin = asked.start[w][gram[part]]
                many = asked.start[w][gram[part] + 1] - begin
                pair = np.repeat(np.arange(len(part)), many)
                to = np.repeat(begin - np.cumsum(many) + many, many) + np.arange(len(pair))
                dots += np.bincount(d[part[pair]] * asked.size + asked.query[w][to], weight[part[pair]] * asked.weight[w][to], len(dots))
        row = np.flatnonzero(dots > 0)
        doc, query = row // asked.size, row % asked.size
        cosine = np.round(dots[row] / (np.sqrt(norm)[doc] * asked.norm[query]), digits)
        best = tuple(np.concatenate(c) for c in zip(best, (query, ids[first + doc], cosine), strict=True))
        if len(best[0]) > 4 * PART:
            best = _best(*best, top)
    return _best(*best, top)


def _best(query: np.ndarray, ids: np.ndarray, cosine: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.lexsort((ids, -cosine, query))
    q = query[order]
    order = order[np.arange(len(q)) - np.searchsorted(q, q) < top]
    return query[order], ids[order], cosine[order]


_made: list[str] = []


def stored(df: DataFrame) -> DataFrame:
    """df written to the folder that driver and executors share, and read again."""
    spark = df.sparkSession
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="strandwork-")
    _made.append(f"{base.rstrip('/')}/kmers-{uuid.uuid4().hex}")
    df.write.option("compression", "none").parquet(_made[-1])  # the cells are packed
    return spark.read.schema(df.schema).parquet(_made[-1])


@atexit.register
def _sweep() -> None:
    spark = SparkSession.getActiveSession()
    if _made and spark is not None and spark.sparkContext._jsc is not None:
        with contextlib.suppress(Exception):  # the folder may be gone already
            for path in _made:
                where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
                where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def _documents(df: DataFrame, key: str, text: str) -> DataFrame:
    """(id, parts): lower-case texts of each id; only if ids repeat are the rows of one brought together."""
    s = df.select(F.col(key).alias("id"), F.lower(F.col(text)).alias("s"))
    if s.groupBy("id").count().where("count > 1").isEmpty():
        return s.select("id", F.array(F.coalesce("s", F.lit(""))).alias("parts"))
    return s.groupBy("id").agg(F.collect_list("s").alias("parts"))


def _held(parts: list[list[str]]) -> tuple[list[list[int]], bytes]:
    return [[len(s) for s in p] for p in parts], _pack("".join(s for p in parts for s in p).encode("utf-8", "surrogatepass"))


def _parts(sizes: list[list[int]], texts: bytes) -> list[list[str]]:
    s, at, out = _unpack(texts).decode("utf-8", "surrogatepass"), 0, []
    for lengths in sizes:
        out.append([])
        for n in lengths:
            out[-1].append(s[at : at + n])
            at += n
    return out


def tfidf_top(queries: DataFrame, refs: DataFrame, query_key: str, ref_key: str, text: str, k: int, top: int, digits: int = 9) -> DataFrame:
    """(query_id, ref_id, cosine, rank): the best references of each query by the cosine of tfidf_scores(), to so many digits, then by ref_id."""
    spark = refs.sparkSession
    q = _documents(queries, query_key, text).where("id IS NOT NULL")
    kinds = queries.schema[query_key].dataType, refs.schema[ref_key].dataType
    if len(held := q.limit(QUERIES + 1).toArrow()) > QUERIES:
        s = tfidf_scores(queries, refs, query_key, ref_key, text, k)
        return ranked(s.withColumn("cosine", F.round("cosine", digits)), "cosine", top, digits)
    schema = f"query_id {kinds[0].simpleString()}, ref_id {kinds[1].simpleString()}, cosine double"
    asked, asked_ids = held.column("parts").to_pylist(), held.column("id").combine_chunks()
    n, chars = refs.agg(F.count_if(F.length(text) >= k), F.coalesce(F.sum(F.length(text)), F.lit(0))).first()
    if not n or not asked:
        return spark.createDataFrame([], schema).withColumn("rank", F.lit(1))
    buckets = -(-chars // CHUNK_CHARS)

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list = []
        parts: list[list[str]] = []
        size, number = 0, TaskContext.get().partitionId() << 32

        def out() -> pa.RecordBatch:
            sizes, texts = _held(parts)
            return pa.RecordBatch.from_pydict({"chunk": pa.array([number], pa.int64()), "ids": pa.array([ids], pa.list_(id_type)), "sizes": pa.array([sizes], pa.list_(pa.list_(pa.int32()))), "texts": pa.array([texts], pa.binary())})

        for b in batches:
            id_type = b.schema.field("id").type
            for one, p in zip(b.column("id").to_pylist(), b.column("parts").to_pylist(), strict=True):
                ids.append(one)
                parts.append(p)
                size += sum(len(s) for s in p)
                if size >= CHUNK_CHARS or len(ids) >= PART:
                    yield out()
                    ids, parts, size, number = [], [], 0, number + 1
        if ids:
            yield out()

    d = stored(_documents(refs, ref_key, text).mapInArrow(chunks, f"chunk long, ids array<{kinds[1].simpleString()}>, sizes array<array<int>>, texts binary"))
    wants = "bucket long, chunk long, grams binary, counts binary"
    fields = pa.schema([("bucket", pa.int64()), ("chunk", pa.int64()), ("grams", pa.binary()), ("counts", pa.binary())])

    def requests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                chunk, sizes, texts = (b.column(c)[i].as_py() for c in ("chunk", "sizes", "texts"))
                yield pa.RecordBatch.from_pylist(list(_requests(chunk, _parts(sizes, texts), k, buckets, True)), fields)

    own = spark.createDataFrame([tuple(r.values()) for r in _requests(-1, asked, k, buckets, False)], wants)
    found = d.select("chunk", "sizes", "texts").mapInArrow(requests, wants).unionByName(own)
    found = stored(found.groupBy("bucket").applyInArrow(lambda t: _answers(t, k, buckets), "chunk long, bucket long, found binary"))
    v = _vocabulary(asked, k)
    model = _Asked(asked, k, n, v, _frequencies(v, k, buckets, {r["bucket"]: bytes(r["found"]) for r in found.where("chunk = -1").collect()}))
    del asked, v

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        none = pa.table({"query_id": asked_ids[:0], "ref_id": pa.array([], left.schema.field("ids").type.value_type), "cosine": pa.array([], pa.float64())})
        if not left.num_rows or not right.num_rows:
            return none
        ids, docs = left.column("ids")[0].values, _parts(left.column("sizes")[0].as_py(), left.column("texts")[0].as_py())
        vocabulary = _vocabulary(docs, k)
        df = _frequencies(vocabulary, k, buckets, dict(zip(right.column("bucket").to_pylist(), right.column("found").to_pylist(), strict=True)))
        order = pc.array_sort_indices(ids).to_numpy()  # nulls come last
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        query, at, cosine = _scores(place, docs, k, n, top + ids.null_count, digits, model, vocabulary, df)
        out = pa.table({"query_id": asked_ids.take(pa.array(query)), "ref_id": ids.take(pa.array(order[at])), "cosine": pa.array(cosine)})
        return out.filter(pc.is_valid(out.column("ref_id")))

    s = d.groupBy("chunk").cogroup(found.where("chunk >= 0").groupBy("chunk")).applyInArrow(score, schema)
    w = Window.partitionBy("query_id").orderBy(F.desc("cosine"), "ref_id")
    return s.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)
