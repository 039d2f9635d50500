"""Features and learning steps of the classifiers against plain Python."""

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from strandwork.llm import langid, toxicity
from strandwork.llm import textvec as tv

TERMS = {"idiot": 0.4, "haus": 1.5, "the": 2.0}
STARTS = {"drec": 1.2, "waiting": 0.7}
TEXTS = [
    "You IDIOT!! you are an id1ot, m0r0n and l0ser", "", None, "   \n\t ", "Nothing here is bad. NOTHING AT ALL?", "aaa bbb aa", "a", "drecksack Waitings waiting drec dreck", "das Haus, dein Haus und the the the",
    "w1 2b 33 #!? ,,, x!", "Ä ÖÖÖ éé stupid TU es " + "plain words " * 30 + "you moron", "aa", "abc", "@$$ $tupid du Trottel", "漢字漢字 idiot",
]


def brute_features(text):
    raw = (text or "").encode()
    words = re.findall(rb"[^ \t-\r]+", raw)
    tokens = [t.lower() for t in re.findall(rb"[A-Za-z\x80-\xff]+", raw)]
    fixed = [float(t.decode(errors="replace") in toxicity.INSULTS) for t in tokens]
    second = [float(t.decode(errors="replace") in toxicity.SECOND) for t in tokens]
    odds = [[TERMS.get(t.decode(errors="replace"), 0.0)] + [STARTS.get(t[:k].decode(errors="replace"), 0.0) for k in (4, 5, 6, 7, 8) if len(t) > k and t[:k].decode(errors="replace") in STARTS] for t in tokens]
    best = [max(o) for o in odds]
    hit = [float(max(f, b > 0)) for f, b in zip(fixed, best)]
    near = sum(bool(h) and sum(second[max(0, i - 5) : i + 6]) > 0 for i, h in enumerate(hit))
    total, n_words, size = max(len(tokens), 1), max(len(words), 1), max(len(raw), 1)
    letter = [bool(re.match(rb"[A-Za-z\x80-\xff]", raw[i : i + 1])) for i in range(len(raw))]
    letters = max(sum(letter), 1)
    count = lambda w, c: len(re.findall(c, w))
    is_punct = rb"[!-/:-@\[-`{-~]"
    plain = lambda w: w.translate(bytes.maketrans(b"013457@$!", b"oieastasi")).lower().decode(errors="replace")
    leet = sum(1 for w in words if count(w, rb"[A-Za-z\x80-\xff]") and count(w, rb"[013457@$!]") and (plain(w) in toxicity.INSULTS or plain(w) in TERMS))
    caps = sum(1 for w in words if count(w, rb"[A-Za-z\x80-\xff]") > 1 and count(w, rb"[A-Z]") == count(w, rb"[A-Za-z\x80-\xff]"))
    mixed = sum(1 for w in words if count(w, rb"[A-Za-z\x80-\xff]") and count(w, rb"[0-9]"))
    stretched = sum(1 for i in range(2, len(raw)) if raw[i] == raw[i - 1] == raw[i - 2] and letter[i])
    return [
        math.log1p(len(words)), sum(fixed) / total, sum(hit) / total, sum(best) / total, sum(sum(x > 0 for x in o) for o in odds) / total, near / total, sum(second) / total, math.log1p(sum(hit)),
        count(raw, rb"[A-Z]") / letters, caps / n_words, count(raw, is_punct) / size, raw.count(b"!") / size, raw.count(b"?") / size, count(raw, rb"[0-9]") / size,
        mixed / n_words, leet / n_words, stretched / size, sum(count(w, is_punct) > 1 for w in words) / n_words, letters / n_words,
    ]


def test_toxicity_features(docs):
    known = {tv.hash_of(t, lower=True): o for t, o in TERMS.items()}
    known |= {tv.hash_of(t, lower=True) ^ (len(t) * 0x9E3779B97F4A7C15 % 2**64): o for t, o in STARTS.items()}
    terms = toxicity.Terms(np.array(sorted(known), np.uint64), np.array([known[k] for k in sorted(known)]))
    texts = TEXTS + [r["text"] for r in docs.limit(40).collect()]
    for size in (400_000, 1):  # many texts of a slice, and one
        got = np.concatenate([toxicity.features(part, terms) for part in tv.slices(pa.array(texts), size)])
        for k, t in enumerate(texts):
            assert got[k] == pytest.approx(brute_features(t)), t


def brute_columns(text):
    """Counts of the hashed n-grams of one to three code points."""
    fold = lambda c: (ord(c.lower()) if len(c.lower()) == 1 else ord(c)) if c.isalpha() else 32
    points = [fold(c) if ord(c) < 0x250 else ord(c) for c in text]
    out = Counter()
    for n in (1, 2, 3):
        for i in range(len(points) - n + 1):
            g = 0
            for order in range(1, n + 1):
                g = (g * 2654435761 + points[i + order - 1] * 40503 + order) * 2246822519 % 2**32
            out[((g ^ (g >> 15)) * 3266489917 % 2**32) >> 16] += 1
    return out


def test_langid_columns_and_weights(docs):
    texts = [t or "" for t in TEXTS] + [r["text"][:3000] for r in docs.limit(20).collect()]
    idf = (1 + np.random.default_rng(1).random(langid.COLUMNS)).astype(np.float32)
    part = next(tv.slices(pa.array(texts)))
    at, column, count = langid.columns(part)
    x = langid.weighed(at, column, count, idf)
    for k, t in enumerate(texts):
        mine = slice(at[k], at[k + 1])
        want = brute_columns(t)
        assert dict(zip(column[mine].tolist(), count[mine].tolist())) == want
        weight = {c: math.log1p(n) * float(idf[c]) for c, n in want.items()}
        norm = math.sqrt(sum(w * w for w in weight.values()))
        assert dict(zip(column[mine].tolist(), x[mine].tolist())) == pytest.approx({c: w / norm for c, w in weight.items()}, rel=1e-5)


def test_ftrl_steps():
    """Two rounds over three rows, coordinate by coordinate."""
    rows = [(np.array([1, 5]), np.array([0.6, 0.8])), (np.array([5, 9]), np.array([1.0, 0.2])), (np.array([1]), np.array([1.0]))]
    y, alpha, beta, l1, l2 = np.array([0, 2, 1]), 0.5, 1.0, 0.02, 0.02
    w, bias = langid.ftrl(rows, y, 3, alpha, beta, l1, l2, epochs=2)
    z, n = {}, {}

    def weight(i, c):
        v = z.get((i, c), 0.0)
        return 0.0 if abs(v) <= l1 else -(v - math.copysign(l1, v)) / ((beta + math.sqrt(n.get((i, c), 0.0))) / alpha + l2)

    order = np.random.Generator(np.random.PCG64(7))
    for _ in range(2):
        for k in order.permutation(3):
            terms = [*zip(rows[k][0].tolist(), rows[k][1].tolist()), (-1, 1.0)]
            now = {(i, c): weight(i, c) for i, _ in terms for c in range(3)}
            s = [math.exp(sum(v * now[i, c] for i, v in terms)) for c in range(3)]
            for c in range(3):
                p = s[c] / sum(s) - (c == y[k])
                for i, v in terms:
                    g, old = v * p, n.get((i, c), 0.0)
                    z[i, c] = z.get((i, c), 0.0) + g - (math.sqrt(old + g * g) - math.sqrt(old)) / alpha * now[i, c]
                    n[i, c] = old + g * g
    for c in range(3):
        assert bias[c] == pytest.approx(weight(-1, c), rel=1e-5)
        for i in (1, 5, 9):
            assert w[i, c] == pytest.approx(weight(i, c), rel=1e-5)
    assert np.count_nonzero(w) <= 9


def test_temperature_has_the_least_loss():
    rng = np.random.default_rng(2)
    y = rng.integers(0, 3, 400)
    logits = 6 * (np.eye(3)[y] + rng.normal(0, 1.2, (400, 3)))
    loss = lambda t: -np.mean([z[k] / t - math.log(sum(math.exp(v / t) for v in z)) for z, k in zip(logits, y)])
    t = langid._temperature(logits, y)
    assert t > 1 and loss(t) <= min(loss(x) for x in np.linspace(0.2, 5, 200)) + 1e-3


def test_rare_languages_are_learned(spark):
    """A language with few rows has its quota whatever the size of the sample."""
    words = {"en": "the house and the river", "de": "das haus und der fluss", "xx": "zzyzx qwqw vvyv"}
    rows = [(k, " ".join([words[lang]] * (1 + k % 3)), lang) for k, lang in enumerate(["en"] * 500 + ["de"] * 500 + ["xx"] * 12)]
    docs = spark.createDataFrame(rows, "doc_id int, text string, lang string")
    got = langid.predict(docs, langid.fit(docs, sample=40, quota=8))
    wrong = [r for r in got.join(docs.select("doc_id", "lang"), "doc_id").collect() if r["lang_pred"] != r["lang"]]
    assert not wrong


def test_ids_of_other_types(spark, labels):
    """Int ids are cast, whatever operator reads them."""
    from strandwork.llm import quality

    docs = spark.createDataFrame([(k, f"some words here {k} " * 20, "en") for k in range(60)], "doc_id int, text string, lang string")
    known = spark.createDataFrame([(k, k % 2, k % 2) for k in range(60)], "doc_id int, toxic int, quality int")
    assert toxicity.score(docs, toxicity.fit(docs, known)).count() == 60
    assert quality.judge(docs, quality.fit(docs, known)).count() == 60
    assert langid.predict(docs, langid.fit(docs)).count() == 60
