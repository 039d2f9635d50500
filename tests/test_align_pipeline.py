import random

from pyspark.sql import functions as F

from strandwork.functions import kernels
from strandwork.queries import QUERIES


def plain_alignment(a, b, scores=kernels.SCORES):
    """The whole matrices, cell by cell."""
    match, mismatch, open_, extend = scores
    low = float("-inf")
    h, e, f = ([[x] * (len(b) + 1) for _ in range(len(a) + 1)] for x in (0.0, low, low))
    best = (0.0, 0, 0)
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            e[i][j] = max(e[i][j - 1] + extend, h[i][j - 1] + open_)
            f[i][j] = max(f[i - 1][j] + extend, h[i - 1][j] + open_)
            h[i][j] = max(0.0, h[i - 1][j - 1] + (match if a[i - 1] == b[j - 1] else mismatch), e[i][j], f[i][j])
            if h[i][j] > best[0]:
                best = (h[i][j], i, j)
    score, i, j = best
    end, same, columns, state = j, 0, 0, "h"
    while state != "h" or h[i][j] > 0:
        if state == "h":
            if h[i][j] == h[i - 1][j - 1] + (match if a[i - 1] == b[j - 1] else mismatch):
                same, columns, i, j = same + (a[i - 1] == b[j - 1]), columns + 1, i - 1, j - 1
            else:
                state = "f" if h[i][j] == f[i][j] else "e"
        elif state == "f":
            columns, state, i = columns + 1, "h" if f[i][j] == h[i - 1][j] + open_ else "f", i - 1
        else:
            columns, state, j = columns + 1, "h" if e[i][j] == h[i][j - 1] + open_ else "e", j - 1
    return {"score": score, "n_matches": same, "aligned_len": columns, "identity": same / columns if columns else 0.0, "ref_start": j, "ref_end": end}


def test_local_alignment_in_a_window():
    r = random.Random(3)
    for _ in range(300):
        a = "".join(r.choice("abc") for _ in range(r.randint(0, 25)))
        b = "".join(r.choice("abcd") for _ in range(r.randint(0, 90)))
        if r.random() < 0.5:
            k = r.randint(0, len(b))
            b = b[:k] + a[: len(a) // 2] + "d" * r.randint(0, 6) + a[len(a) // 2 :] + b[k:]
        assert kernels.local_alignment(a, b) == plain_alignment(a, b)


def test_local_alignment_of_a_long_text():
    a = "the quick brown fox jumps over the lazy dog" * 5
    got = kernels.local_alignment(a, "0" * 1_000_000 + a + "1" * 1_000_000)
    assert (got["n_matches"], got["ref_start"], got["ref_end"]) == (len(a), 1_000_000, 1_000_000 + len(a))


def test_pipeline_keeps_every_holder(spark, tmp_path):
    """Twelve long texts hold the passage, behind eight short ones that lie nearer by k-mers."""
    r = random.Random(8)
    words = lambda n: " ".join("".join(r.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(n))
    passage = words(20)
    docs = [(k, f"{words(60)} {passage} {words(60)}") for k in range(12)] + [(100 + k, passage[: 100 + k]) for k in range(8)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = QUERIES["align_pipeline"](spark, str(tmp_path)).orderBy(F.col("rank")).collect()
    assert [r["ref_id"] for r in got][:12] == list(range(12)) and len(got) == 20
    assert all(r["edit_distance"] == 0 and r["identity"] == 1.0 and r["aligned_len"] == len(passage) for r in got[:12])
