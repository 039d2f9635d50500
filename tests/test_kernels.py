"""Kernels against plain dynamic programming."""

import random

import pytest

from strandwork.functions import kernels, stats, text


def plain_infix(q, t):
    row = [0] * (len(t) + 1)
    for i, a in enumerate(q, 1):
        new = [i]
        for j, b in enumerate(t, 1):
            new.append(min(row[j - 1] + (a != b), row[j] + 1, new[j - 1] + 1))
        row = new
    return min(row)


def plain_local(a, b, scores=kernels.SCORES):
    match, mismatch, open_, extend = scores
    best, inf = 0.0, float("-inf")
    h = [[0.0] * (len(b) + 1) for _ in range(len(a) + 1)]
    e = [[inf] * (len(b) + 1) for _ in range(len(a) + 1)]
    f = [[inf] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            e[i][j] = max(e[i][j - 1] + extend, h[i][j - 1] + open_)
            f[i][j] = max(f[i - 1][j] + extend, h[i - 1][j] + open_)
            h[i][j] = max(0.0, h[i - 1][j - 1] + (match if a[i - 1] == b[j - 1] else mismatch), e[i][j], f[i][j])
            best = max(best, h[i][j])
    return best


def test_infix_distance():
    r = random.Random(1)
    for _ in range(300):
        q, s = ("".join(r.choice("ACGT") for _ in range(r.randint(0, n))) for n in (12, 40))
        want = plain_infix(q, s)
        assert kernels.infix_distance(q, s) == want
        assert kernels.infix_distance(q, s, 2) == (want if want <= 2 else -1)


def test_local_score_and_traceback():
    r = random.Random(2)
    for _ in range(200):
        a, b = ("".join(r.choice("ACGT") for _ in range(r.randint(0, 25))) for _ in range(2))
        for scores in (kernels.SCORES, kernels.IDENTITY_SCORES):
            want = plain_local(a, b, scores)
            assert kernels.local_score(a, b, scores) == pytest.approx(want)
            if a and b:
                got = kernels.local_alignment(a, b, scores)
                assert got["score"] == pytest.approx(want)
                assert 0 <= got["n_matches"] <= got["aligned_len"] and got["ref_start"] <= got["ref_end"]


def test_one_long_gap_costs_open_and_extensions():
    assert kernels.local_score("AAAAACCCCC", "AAAAATTTCCCCC") == 20 - 5 - 2 * 2


def test_fuzzy_find():
    assert kernels.fuzzy_find("ACG[AT]", "TTACGTT", 0) == (2, 6, 0)
    assert kernels.fuzzy_find("ACGT", "TTACTTT", 0) is None
    got = kernels.fuzzy_find("ACGTACGT", "TTACGAACGTT", 1)
    assert got is not None and got[2] == 1


def test_primers():
    assert text.primer_pattern("GTGYC") == "GTG[CT]C"
    assert text.reversed_primer("ACGTR") == "YACGT"
    with pytest.raises(ValueError):
        text.primer_pattern("ACX")


def test_mcnemar_and_t():
    assert stats.mcnemar_p(0, 0) == 1.0
    assert stats.mcnemar_p(1, 0) == 1.0
    assert stats.mcnemar_p(0, 10) == pytest.approx(2 / 2**10)
    assert stats.mcnemar_p(40, 10) == pytest.approx(0.0000413, rel=0.1)
    assert stats.t_quantile(0.975, 10) == pytest.approx(2.228139, abs=1e-4)
