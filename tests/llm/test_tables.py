"""WARC archives, top-k search, and the pipeline."""

import hashlib
import math
import random

import pytest
from pyspark.sql import functions as F

from strandwork.llm import topk, warc


def rows_of(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.select(*cols).collect()), key=repr)


def brute_warc(rows, least=1000):
    last = {}
    for r in rows:
        h = r["html"] or ""
        if len(h.encode()) >= least and r["page_id"] is not None:
            last[h] = max(last.get(h, r["page_id"]), r["page_id"])
    out = []
    for r in rows:
        h = r["html"] or ""
        raw = h.encode()
        first = last.get(h)
        again = first is not None and first != r["page_id"]
        out.append((r["page_id"], len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if again else "response", first if again else None))
    return sorted(out, key=repr)


COLS = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def test_warc_round_trip(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    assert rows_of(warc.round_trip(pages), *COLS) == brute_warc(pages.collect())


def test_warc_messy(spark):
    big = "<p>é漢" + "x" * 1200 + "\r\n\r\nWARC/1.1\r\nContent-Length: 9\r\n\r\n</p>"
    rows = [(1, "u", big, "z"), (5, "u", big, "z"), (3, None, big, None), (None, "u\r\nX: y", big, "z"), (7, "u", None, "z"), (8, "u", "", "z"), (9, "u", "small", "z"), (10, "u", "small", "z"), (11, "u", "y" * 999, "z"), (12, "u", "y" * 999, "z"), (13, "u", "y" * 1000, "z"), (14, "u", "y" * 1000, "z"), (14, "u", "y" * 1000, "z"), (20, "u", "long" * 500_000, "z")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest string")
    assert rows_of(warc.round_trip(pages), *COLS) == brute_warc(pages.collect())
    assert warc.round_trip(pages.limit(0)).count() == 0
    alone = spark.createDataFrame([(None, "u", big)], "page_id long, url string, html string")
    assert rows_of(warc.round_trip(alone), "page_id", "record_type") == [(None, "response")]


def brute_top(rows, k=10, every=100):
    good = []
    for i, v in rows:
        if v is not None and all(x is not None and math.isfinite(x) for x in v):
            good.append((i, [math.floor(1024 * x) for x in v]))
    out = []
    for a, (q, v) in enumerate(good):
        if q is None or q % every:
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, w, strict=True)), math.inf if c is None else c, b) for b, (c, w) in enumerate(good) if b != a and len(w) == len(v))
        out += [(q, rank, None if c == math.inf else c, -s) for rank, (s, c, _) in enumerate(scored[:k], 1)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("group", [16_384, 300])
def test_top_k(spark, group):
    r = random.Random(2)
    rows = [(k, [r.gauss(0, 1) for _ in range(8)]) for k in range(900)]
    rows += [(900, rows[3][1]), (901, rows[3][1]), (1000, rows[3][1]), (1000, rows[3][1]), (None, rows[3][1]), (1100, None), (1101, [1.0, None] + [0.0] * 6), (1102, [float("nan")] * 8), (1200, [float("inf")] * 8), (1300, [1.0, 2.0]), (1301, [3.0, 4.0]), (1400, []), (1401, [])]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<float>, vec string")
    plain = [(row["vec_id"], row["embedding"]) for row in df.collect()]
    got = topk.top_k(df, group=group)
    assert rows_of(got, "query_id", "rank", "vec_id", "score") == brute_top(plain)


def test_top_k_skips_blocks(spark):
    """Vectors in tight clusters: most blocks of far clusters are never scored, and groups that can't win are never asked."""
    r = random.Random(4)
    heads = [[r.gauss(0, 1) for _ in range(8)] for _ in range(20)]
    rows = [(k, [x + r.gauss(0, 0.02) for x in heads[k % 20]]) for k in range(8000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    report = []
    got = topk.top_k(df, every=1000, group=1000, report=report)
    assert rows_of(got, "query_id", "rank", "vec_id", "score") == brute_top(rows, every=1000)
    pairs = report[0].first()
    assert pairs["blocks"] >= 8 * 63 and pairs["scored"] < 0.5 * pairs["blocks"]


def test_top_k_beyond_doubles(spark):
    rows = [(k * 50, [1e8 + k, -3e8 + k]) for k in range(6)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = rows_of(topk.top_k(df, scale=1), "query_id", "rank", "vec_id", "score")
    want = []
    for q, v in rows:
        if q % 100 == 0:
            s = sorted((-sum(int(x) * int(y) for x, y in zip(v, w, strict=True)), c) for c, w in rows if c != q)
            want += [(q, n, c, -x) for n, (x, c) in enumerate(s, 1)]
    assert got == sorted(want, key=repr)


def test_top_k_empty(spark):
    assert topk.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    assert topk.top_k(spark.createDataFrame([(100, [1.0])], "vec_id long, embedding array<float>")).count() == 0


def brute_redacted(t):
    """The text with the union of all found spans cut out."""
    from strandwork.llm import secret_ledger

    if t is None:
        return None
    inside = [False] * len(t)
    begins = set()
    for a, b, _ in secret_ledger.find(t):
        if not inside[a]:
            begins.add(a)
        inside[a:b] = [True] * (b - a)
    return "".join(("[REDACTED]" if k in begins else "") + ("" if hidden else c) for k, (c, hidden) in enumerate(zip(t, inside, strict=True)))


def brute_copies(rows):
    """Copies of each row as DuckDB mixes them."""
    import duckdb
    import pandas as pd

    from strandwork.llm import mixing

    con = duckdb.connect()
    con.register("documents", pd.DataFrame([(r["doc_id"], r["text"], r["source"]) for r in rows], columns=["doc_id", "text", "source"]))
    return sorted(i for i, n in con.execute(f"SELECT doc_id, copies FROM ({mixing.SQL})").fetchall() for _ in range(n))


def gapless(rows, size=2048):
    """The number of sequences; each is filled from 0 without gaps or overlaps."""
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= size
    return len(by)


def test_pipeline_stages(spark, sf, tmp_path):
    """Each stage by brute force on what its predecessor kept."""
    import corpus_pipeline

    from strandwork.llm import toxicity

    from .test_neardup import expected
    from .test_text_operators import brute_pieces

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    scores = toxicity.score(docs, toxicity.fit(docs, spark.read.parquet(f"{sf}/labels.parquet")))
    want = sorted(r["doc_id"] for r in scores.where("score < 0.5").collect())
    kept = {"": docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, sf).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept[name] = docs.collect()
        if name != "packing":
            assert docs.columns == columns
    assert sorted(r["doc_id"] for r in kept["toxicity"]) == want and len(want) > 150
    whole = {r["doc_id"]: r for r in kept[""]}
    assert all(r == whole[r["doc_id"]] for name in ("toxicity", "simhash") for r in kept[name])
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in kept["simhash"]) == expected(kept["toxicity"])
    clean = {r["doc_id"]: brute_redacted(r["text"]) for r in kept["simhash"]}
    assert sorted((r["doc_id"], r["text"], r["n_chars"], r["lang"], r["source"]) for r in kept["secrets"]) == sorted((r["doc_id"], clean[r["doc_id"]], len(clean[r["doc_id"]]), r["lang"], r["source"]) for r in kept["simhash"])
    assert sorted(r["doc_id"] for r in kept["mixing"]) == brute_copies(kept["secrets"])
    assert all(r["text"] == clean[r["doc_id"]] for r in kept["mixing"])
    got = sorted(((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in kept["packing"]), key=repr)
    assert got == brute_pieces(kept["mixing"])
    assert gapless(kept["packing"]) <= 1.02 * math.ceil(sum(r["length"] for r in kept["packing"]) / 2048) + 1


@pytest.mark.parametrize("which", ["messy", "empty"])
def test_pipeline_on_odd_tables(spark, sf, tmp_path, which, request):
    """Nulls, empty texts, ties, repeated rows and extra columns; and no rows at all."""
    import corpus_pipeline

    df = request.getfixturevalue(which).withColumn("n_chars", F.col("n_chars").cast("long"))
    df.write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{sf}/labels.parquet").write.parquet(str(tmp_path / "labels.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert (gapless(out) > 0) == (which == "messy")


def test_pipeline_run_leaves_only_its_result(spark, sf):
    import corpus_pipeline

    from strandwork.llm import common

    since = common.stored_so_far()
    out = corpus_pipeline.run(spark, sf)
    assert out.count() > 0 and common.stored_so_far() == since + 1
