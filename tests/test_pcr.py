"""Primer panels against plain searches of the whole sequence."""

import regex

from strandwork import queries
from strandwork.functions import kernels, text
from strandwork.operators import pcr


def brute_amplicons(rows, edits):
    """For each region the first strand on which both primers are found at a fitting distance."""
    out = []
    for key, seq in rows:
        turned = seq[::-1].translate(str.maketrans("ACGT", "TGCA"))
        for r in pcr.PANEL:
            fwd, rev = (text.primer_pattern(p) for p in (r.forward, text.reversed_primer(r.reverse)))
            for strand, s in (("+", seq), ("-", turned)):
                f = kernels.fuzzy_find(fwd, s, edits)
                b = f and kernels.fuzzy_find(rev, s, edits, f[1])
                if b and r.low <= b[0] - f[1] <= r.high:
                    out.append((key, r.name, s[f[0] : b[1]], f[2], b[2], strand))
                    break
    return sorted(out)


def test_panel_with_edits(spark, sf):
    seqs = queries.strands(spark, sf).where("doc_id < 80")
    rows = [(r["doc_id"], r["seq"]) for r in seqs.collect()]
    for edits in (0, 3):
        got = sorted(map(tuple, pcr.amplicons(seqs, "doc_id", "seq", edits=edits).collect()))
        assert got == brute_amplicons(rows, edits)
        assert {"+", "-"} <= {r[5] for r in got} and {r[3] for r in got} == ({0, 3} if edits else {0})  # a search takes the first match it meets, not the nearest


def test_primer_finds_what_a_search_finds():
    letters = "CCTACGGGNGGCWGCAG"
    pattern = text.primer_pattern(letters)
    primer = kernels.Primer(letters, pattern, 3)
    cases = ["CCTACGGGAGGCAGCAG", "AAACCTACGGGAGGCAGCAGTT", "CCTACGGAGGCAGCAG", "GCCTACCGGGTGGCTGCAG", "CTACGGGAGGCAGCA", "ACGT" * 30, "", "CCTACG" * 5, "TTTT" + "CCTACGTGGAGGCAGAG" + "CCTACGGGAGGCAGCAG"]
    for s in cases:
        for start in (0, 3):
            assert primer.find(s, start) == kernels.fuzzy_find(pattern, s, 3, start)
    assert regex.search(pattern, cases[0])


def test_inserts_excluded_or_included(spark):
    r = pcr.Region("r", "ACGTACG", "GGGTTTA", 3, 10)
    s = "TT" + "ACGTACG" + "CCCCC" + text.reversed_primer("GGGTTTA") + "A"
    df = spark.createDataFrame([(1, s), (2, None), (3, ""), (4, s + "C" * 20), (1, s)], "k long, seq string")
    got = lambda **how: sorted((x["key"], x["amplicon"]) for x in pcr.amplicons(df, "k", "seq", (r,), edits=0, **how).collect())
    whole = "ACGTACG" + "CCCCC" + text.reversed_primer("GGGTTTA")
    assert got() == [(1, whole), (1, whole), (4, whole)] and got(include_primers=False) == [(1, "CCCCC"), (1, "CCCCC"), (4, "CCCCC")]
