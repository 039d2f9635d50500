import numpy as np
import pytest

from strandwork.llm import simhash


def test_one_id_with_two_texts_and_null_ids(spark):
    rows = [(1, "a b c d e f g"), (1, "q r s t u v w"), (2, "q r s t u v w"), (None, "q r s t u v w"), (None, "x y z"), (None, "x y z"), (1, "a b c d e f g")]
    got = simhash.dedup(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((r["doc_id"] or 0, r["text"]) for r in got.collect()) == [(0, "x y z"), (1, "a b c d e f g"), (1, "q r s t u v w")]


def brute_classes(values, max_bits=4):
    """The classes of more than one value, by all pairs."""
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a in range(0, len(values), 512):
        near = np.argwhere(np.bitwise_count(values[a : a + 512, None] ^ values) <= max_bits)
        for i, j in near[near[:, 0] + a < near[:, 1]].tolist():
            root[find(values[a + i].item())] = find(values[j].item())
    classes = {}
    for x in list(root):
        classes.setdefault(find(x), []).append(x)
    return sorted(map(sorted, classes.values()))


@pytest.mark.parametrize(("shared", "n", "most"), [(40, 3000, 1000), (60, 16, 4), (20, 20_000, 2048)])
def test_full_subtries(spark, shared, n, most):
    """Fingerprints that share their upper bits, in one trie or the other, are cut into deeper subtries."""
    rng = np.random.default_rng(shared + n)
    low = rng.integers(0, 2**64, n, dtype=np.uint64) >> np.uint64(shared)
    for k in range(1, min(n, 2000)):  # chains of values that differ by a few bits
        if k % 9:
            low[k] = low[k - 1]
            for bit in rng.integers(0, 64 - shared, rng.integers(1, 6)).tolist():
                low[k] ^= np.uint64(1 << bit)
    values = np.unique(low | (np.uint64(0xABCDEF0123456789) >> np.uint64(64 - shared) << np.uint64(64 - shared)))
    if shared == 40:
        values = np.unique(simhash._swapped(values))
    df = spark.createDataFrame([(x,) for x in values.view(np.int64).tolist()], "fp long")
    classes = {}
    for r in simhash.components(simhash.links(df, most=most)).collect():
        classes.setdefault(r["root"] % 2**64, {r["root"] % 2**64}).add(r["node"] % 2**64)
    assert sorted(map(sorted, classes.values())) == brute_classes(values)
