import random

from strandwork.functions import kernels


def test_many_pairs_at_a_time():
    """Lengths, letters and gaps of all kinds, in batches that mix them."""
    r = random.Random(5)
    pairs = [("", "abc"), ("abc", ""), ("", ""), ("漢字😀x", "a漢字b😀x"), ("a" * 40, "b" * 9)]
    for _ in range(400):
        a = "".join(r.choice("abcé") for _ in range(r.randint(0, 40)))
        b = "".join(r.choice("abcd") for _ in range(r.randint(0, 150)))
        if r.random() < 0.5:
            k = r.randint(0, len(b))
            b = b[:k] + a[: len(a) // 2] + "d" * r.randint(0, 5) + a[len(a) // 2 :] + b[k:]
        pairs.append((a, b))
    d, s = kernels.compare(*map(list, zip(*pairs, strict=True)))
    assert d.tolist() == [kernels.infix_distance(a, b) for a, b in pairs]
    assert s.tolist() == [kernels.local_score(a, b) for a, b in pairs]


def test_long_query_needs_wider_numbers():
    a = "abcd" * 3000
    d, s = kernels.compare([a], ["x" * 50 + a[:-1] + "y"])
    assert (d[0], s[0]) == (1, 2.0 * (len(a) - 1))


def test_long_targets():
    r = random.Random(6)
    a = ["".join(r.choice("abc") for _ in range(20)) for _ in range(4)]
    b = ["".join(r.choice("abcd") for _ in range(40_000)) for _ in a]
    d, s = kernels.compare(a, b)
    assert d.tolist() == [kernels.infix_distance(*x) for x in zip(a, b, strict=True)]
    assert s.tolist() == [kernels.local_score(*x) for x in zip(a, b, strict=True)]
