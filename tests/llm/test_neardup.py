"""The exact near-duplicate join against all pairs."""

import re

import pytest
from pyspark.sql import functions as F

from strandwork.llm import neardup

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_sets(texts):
    lower = [re.sub("[A-Z]", lambda m: m[0].lower(), t or "") for t in texts]
    words = [WORD.findall(t) for t in lower]
    return [frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset() for w in words]


def brute_classes(texts):
    """The class of each text: the least index of it."""
    sets = brute_sets(texts)
    nodes = list(dict.fromkeys(sets))
    root = list(range(len(nodes)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(nodes):
        for j in range(i + 1, len(nodes)):
            b = nodes[j]
            if 10 * min(len(a), len(b)) >= 8 * max(len(a), len(b)) and 10 * len(a & b) >= 8 * len(a | b):
                root[find(j)] = find(i)
    place = {s: i for i, s in enumerate(nodes)}
    return [find(place[s]) for s in sets]


def expected(rows):
    """(id, text) of the row that stays of each class."""
    best = {}
    for r, c in zip(rows, brute_classes([r["text"] for r in rows]), strict=True):
        best.setdefault(c, []).append(r["doc_id"])
    return sorted(((x is None, x or 0) for x in (min(v, key=lambda x: (x is None, x or 0)) for v in best.values())))


def near_copies(spark):
    """Copies of a text of 100 words whose 5-word Jaccard similarity with it is about 0.81, 0.9, 0.74 and 0.9 with the last."""
    base = [f"w{k}" for k in range(100)]

    def changed(*places):
        return " ".join(f"new{k}" if k in places else w for k, w in enumerate(base))

    texts = [" ".join(base), changed(30, 60), changed(50), changed(10, 40, 70), changed(10, 40, 70, 90), "other " * 40]
    return spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")


@pytest.mark.parametrize("which", ["near", "messy", "sf0.001", "sf0.01"])
def test_dedup(spark, which, request):
    df = near_copies(spark) if which == "near" else request.getfixturevalue("messy") if which == "messy" else spark.read.parquet(f"/root/testdata/{which}/documents.parquet")
    kept = neardup.dedup(df)
    assert kept.columns == df.columns
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in kept.collect()) == expected(df.collect())


def test_stage_drops_copies_beyond_the_simhash_budget(spark, sf):
    import corpus_pipeline

    df = near_copies(spark)
    stage = dict(corpus_pipeline.STAGES)["simhash"]
    assert sorted(r["doc_id"] for r in stage(spark, df, sf).collect()) == [x for _, x in expected(df.collect())]


def test_one_id_with_two_texts(spark):
    rows = [(1, "a b c d e f g"), (1, "q r s t u v w"), (2, "q r s t u v w"), (None, "q r s t u v w"), (None, "x y z"), (None, "x y z")]
    got = neardup.dedup(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(((r["doc_id"] or 0, r["text"]) for r in got.collect())) == [(0, "x y z"), (1, "a b c d e f g"), (1, "q r s t u v w")]


def test_empty(spark, empty):
    assert neardup.dedup(empty).count() == 0


def test_runs_are_never_split(spark):
    """A large class of near copies beside a text of its own with the same shingles at the front."""
    base = " ".join(f"w{k}" for k in range(60))
    rows = [(k, f"{base} tail{k}") for k in range(1500)] + [(5000, " ".join(f"w{k}" for k in range(30)) + " end " + " ".join(f"v{k}" for k in range(60)))]
    got = neardup.dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))
    assert sorted(r["doc_id"] for r in got.select(F.col("doc_id")).collect()) == [0, 5000]
