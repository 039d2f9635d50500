import random

import pytest
from pyspark.sql import functions as F

from strandwork.operators import kmer, kmer_top
from strandwork.queries import QUERIES


def texts(r, n, letters):
    words = ["".join(r.choice(letters) for _ in range(r.randint(1, 9))) for _ in range(60)]
    return [" ".join(r.choice(words) for _ in range(r.randint(0, 30))) for _ in range(n)]


@pytest.mark.parametrize("k", [3, 8, 11])
def test_equals_all_scores(spark, monkeypatch, k):
    """Many chunks and buckets; letters beyond Latin-1, repeated and null ids, null and short texts."""
    monkeypatch.setattr(kmer_top, "CHUNK_CHARS", 900)
    monkeypatch.setattr(kmer_top, "PART", 256)
    r = random.Random(k)
    docs = texts(r, 60, "abcdEFé\n") + texts(r, 40, "abcΩж漢😀\0") + [None, "", "ab"]
    docs = list(enumerate(docs)) + [(7, docs[70]), (7, docs[3]), (None, docs[5]), (500, docs[9]), (501, docs[9])]
    asked = [(k, t[:80] if t else t) for k, t in r.sample(docs, 25)] + [(900, "ÀÖ ÿ no such text"), (901, None)]
    refs, queries = (spark.createDataFrame(x, "id long, text string").repartition(3) for x in (docs, [x for x in asked if x[0] is not None]))
    want = kmer.tfidf_scores(queries, refs, "id", "id", "text", k)
    want = kmer.ranked(want.withColumn("cosine", F.round("cosine", 9)), "cosine", 5)
    got = kmer_top.tfidf_top(queries, refs, "id", "id", "text", k, 5)
    columns = ["query_id", "ref_id", "rank", "cosine"]
    assert sorted(map(tuple, got.select(columns).collect())) == sorted(map(tuple, want.select(columns).collect()))


def test_query_makes_no_row_for_each_kmer(spark, sf):
    """The k-mers of a text used to be exploded into rows, some hundred million at 0.1 GB."""
    plan = QUERIES["kmer_tfidf_top10"](spark, sf)._jdf.queryExecution().toString()
    assert "Explode" not in plan and "Generate" not in plan
