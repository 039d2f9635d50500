"""Operators on small tables, with nulls, ties and missing branches."""

import random
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from strandwork.functions import text
from strandwork.operators import dedup, genes, hits, knn, lineage, pcr, scoring, select

HIT = "query_id long, query_len int, best_identity double, study string, rank int, genome_id string, taxon_id long, organism string, family string, genus string, species string, identity double, align_score double, aligned_len double, edit_identity double, gene_count int"


def random_hits(n_queries=120, seed=3):
    r = random.Random(seed)
    rows = []
    for q in range(n_queries):
        hs = []
        for _ in range(r.randint(1, 12)):
            sp = r.choice(["", None, "Alpha beta", "Alpha gamma", "Candidatus Alpha beta", "Delta sp.", "Eps zeta"])
            hs.append([f"{r.randint(1, 6)}.{r.randint(1, 2)}", r.choice([1, 2, 3, None]), r.choice(["uncultured x", "Alpha beta", None]), r.choice(["F1", "F2", "", None]), r.choice(["Alpha", ""]), sp,
                       round(r.choice([0.8, 0.865, 0.9, 0.945, 0.985, 0.987, 0.99, 1.0]), 4), float(r.choice([100, 150, 190, 200])), float(r.choice([80, 90, 95, 100])), r.choice([None, 0.99, 1.0, 0.9]), r.choice([None, 0, 1000, 3000])])
        hs.sort(key=lambda h: -h[7])
        best = r.choice([None, 0.8]) if r.random() < 0.1 else max(h[6] for h in hs)
        for k, h in enumerate(hs, 1):
            rows.append((q, 100, best, r.choice(["F2 x", "", None]) if k == 1 else None, k, *h))
    return rows


def as_dicts(rows):
    names = [c.strip().split()[0] for c in HIT.split(",")]
    out = {}
    for row in rows:
        d = dict(zip(names, row, strict=True))
        out.setdefault(d["query_id"], []).append(d)
    return out


@pytest.mark.parametrize("knobs", [select.EXACT_TIE, replace(select.EXACT_TIE, window=0.02), replace(select.EXACT_TIE, window=0.2, species_dedup=False), replace(select.EXACT_TIE, window=0.2, cap=2), replace(select.EXACT_TIE, window=0.2, coherence=True, cap=3)])
def test_union_plan_equals_rules(spark, knobs):
    rows = random_hits()
    by = as_dicts(rows)
    for q in by.values():
        for h in q:
            h["study"] = q[0]["study"]
    df = spark.createDataFrame([tuple(h.values()) for q in by.values() for h in q], HIT)
    got = {(r["query_id"], r["rank"]): (r["stage"], r["position"]) for r in select.union(df, knobs).collect()}
    for q, hs in by.items():
        for h, (stage, position) in zip(hs, select.choose(hs, knobs), strict=True):
            assert got[q, h["rank"]] == (stage, position), (q, h["rank"])


def test_fold_variants(spark):
    by = as_dicts(random_hits(30))
    df = spark.createDataFrame([tuple(h.values()) for q in by.values() for h in q], HIT)
    got = {(r["variant"], r["query_id"], r["rank"]): r["stage"] for r in select.fold(df, select.PRESETS).collect()}
    for name, k in select.PRESETS.items():
        for q, hs in by.items():
            for h, (stage, _) in zip(hs, select.choose(hs, k), strict=True):
                assert got[name, q, h["rank"]] == stage


def test_summary_abstains(spark):
    rows = [(1, 100, 0.5, "", 1, "1.1", 1, "x", "F", "G", "S s", 0.5, 10.0, 100.0, None, None), (2, 100, 1.0, "", 1, "1.1", 1, "x", "F", "G", "Alpha beta", 1.0, 10.0, 50.0, None, 0), (3, 100, 1.0, "", 1, "1.1", 1, "x", "F", "G", "Alpha beta", 1.0, 10.0, 100.0, None, 0)]
    got = {r["query_id"]: r for r in select.summary(select.union(spark.createDataFrame(rows, HIT))).collect()}
    assert [got[q]["status"] for q in (1, 2, 3)] == ["abstain_below_family", "abstain_reliability", "ok"]
    assert got[2]["score_top_dropped"] == "reliability_gate" and got[3]["anchor_no_gene_set"] and got[3]["core_genes"] == 0


def test_legacy_with_gene_sets():
    base = {"query_len": 100, "best_identity": 0.97, "study": "", "taxon_id": 1, "organism": "Alpha beta", "family": "F", "genus": "", "identity": 0.97, "align_score": 100.0, "aligned_len": 100.0, "edit_identity": None, "gene_count": None}
    hs = [base | {"rank": k, "genome_id": g, "species": s, "align_score": 100.0 - k} for k, (g, s) in enumerate([("1.1", "A a"), ("2.1", "B b"), ("3.1", "C c"), ("4.1", "D d")], 1)]
    sets = {"1.1": frozenset("abcd"), "2.1": frozenset("abce"), "3.1": frozenset("abcd"), "4.1": frozenset()}
    assert [s for s, _ in select.choose(hs, select.LEGACY, sets)] == ["included", "included", "marginal_gain", "no_gene_set"]


def test_dedup_first_metadata(spark):
    df = spark.createDataFrame([(1, " acgtacgtacgtacgtacgt ", "g1", "m1"), (2, "ACGTACGTACGTACGTACGT", "g2", "m2"), (3, "short", "g1", "m3"), (4, None, "g1", "m4"), (5, "acgtacgtacgtacgtacgt", None, "m5")], "k long, s string, g string, m string")
    r = dedup.index(df, "s", "k", "g", ["m"]).collect()
    assert len(r) == 1 and (r[0]["multiplicity"], r[0]["n_genomes"], r[0]["m"], r[0]["seq_len"]) == (3, 2, "m1", 20)
    assert sorted((x["k"], x["row_id"]) for x in dedup.members(df, "s", "k", "k").collect()) == [(1, 1), (2, 1), (5, 1)]


def test_length_range_zero_is_off(spark):
    df = spark.range(5).withColumnRenamed("id", "n")
    assert dedup.length_range(df, "n", 0, 0).count() == 5 and dedup.length_range(df, "n", 2, None).count() == 3


def test_headers(spark):
    rows = ["fig|1505.7.rna.1|x| desc [Org [nested] x | 1505.7]", "plain header", "fig|12.3.rna.2|y| no tail", "fig|9.1.rna.1|z|[Only organism]"]
    h = F.col("h")
    f = text.header_fields(h)
    got = spark.createDataFrame([(r,) for r in rows], "h string").select(*[c.alias(n) for n, c in f.items()], text.genome_of_header(h).alias("g")).collect()
    assert got[1]["feature_id"] == "plain header" and got[1]["genome_id"] is None and got[1]["g"] == "plain"
    assert (got[2]["feature_id"], got[2]["genome_id"], got[2]["organism"]) == ("12.3.rna.2", "12.3", None)
    assert (got[3]["organism"], got[3]["genome_id"]) == ("Only organism", "9.1")


def test_pcr_reverse_strand_and_bounds(spark):
    panel = (pcr.Region("r", "AACC", "GGTT", 3, 6),)
    back = "AACCAACCTTGG"  # complements are checked through reversed primer
    fwd = "TTAACC" + "ACGTA" + text.reversed_primer("GGTT") + "TT"
    rev = fwd.translate(str.maketrans("ACGT", "TGCA"))[::-1]
    df = spark.createDataFrame([(1, fwd), (2, rev), (3, "TTAACC" + "A" * 9 + "AACC"), (4, back), (5, None)], "k long, s string")
    got = {r["key"]: (r["amplicon"], r["strand"]) for r in pcr.amplicons(df, "k", "s", panel, edits=0, include_primers=False).collect()}
    assert got[1] == ("ACGTA", "+") and got[2][0] is not None and 3 not in got
    with pytest.raises(ValueError):
        pcr.chosen(["nowhere"])


def test_knn_blocks_agree(spark, monkeypatch):
    r = random.Random(4)
    rows = [(k, [r.gauss(0, 1) for _ in range(5)]) for k in range(90)] + [(90, [1.0] + [0.0] * 4), (91, [1.0] + [0.0] * 4)]
    df = spark.createDataFrame(rows, "k long, v array<double>")
    want = [tuple(x) for x in knn.top_k(df, df, "k", "v", 4).orderBy("query_id", "rank").collect()]
    monkeypatch.setattr(knn, "BLOCK", 20)
    monkeypatch.setattr(knn, "CHUNK", 30)
    assert [tuple(x) for x in knn.top_k(df, df, "k", "v", 4).orderBy("query_id", "rank").collect()] == want


def test_lineage_cycle_and_roots(spark):
    nodes = spark.createDataFrame([(1, 1, "domain", "Bacteria"), (2, 1, "phylum", "P"), (3, 2, "species", "S"), (9, None, "superkingdom", "X")], "tax_id long, parent long, rank string, name string")
    got = {r["tax_id"]: (r["domain"], r["phylum"], r["species"]) for r in lineage.ranks(lineage.resolve(nodes), ["domain", "phylum", "species"]).collect()}
    assert got == {1: ("Bacteria", None, None), 2: ("Bacteria", "P", None), 3: ("Bacteria", "P", "S"), 9: ("X", None, None)}


def test_gene_capture_undefined(spark):
    g = lambda rows: spark.createDataFrame(rows, "query_id long, gene string")
    q = spark.createDataFrame([(1,), (2,), (3,)], "query_id long")
    got = {r["query_id"]: r for r in genes.capture(g([(1, "a"), (1, "b"), (2, "a")]), g([(1, "b"), (1, "c")]), q).collect()}
    assert (got[1]["recall"], got[1]["precision"], got[1]["f1"], got[1]["jaccard"]) == (0.5, 0.5, 0.5, pytest.approx(1 / 3))
    assert got[2]["recall"] == 0 and got[2]["precision"] is None and got[3]["f1"] is None


def test_majority_tie_and_holm(spark):
    v = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b"), (2, "a"), (2, "b"), (3, ""), (3, None)], "k long, n string")
    assert {r["k"]: (r["winner"], r["strength"]) for r in hits.majority(v, ["k"], F.col("n")).collect()} == {1: ("a", pytest.approx(2 / 3)), 2: ("AMBIG", 0.5)}
    p = spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.03)], "n string, p double")
    assert {r["n"]: r["p_holm"] for r in scoring.holm(p, "p", [], ["n"]).collect()} == {"a": pytest.approx(0.03), "c": pytest.approx(0.06), "b": pytest.approx(0.06)}


def test_allocation_fills_and_caps(spark):
    s = spark.createDataFrame([("p", "a", 100), ("p", "b", 1), ("p", "c", 25), ("q", "d", 2)], "parent string, child string, n long")
    got = {r["child"]: r["allocated"] for r in scoring.allocate(s, "parent", "child", "n", 20).collect()}
    assert got["d"] == 2 and got["b"] == 1 and got["a"] + got["b"] + got["c"] == 20


def test_reports(spark):
    from strandwork.operators import reports

    a = spark.createDataFrame([(1, 1, "x", "selected", "anchor"), (1, 2, "y", "excluded", None), (2, 1, "x", "excluded", None)], "query_id long, rank int, genome_id string, disposition string, role string")
    b = spark.createDataFrame([(1, 1, "y", "selected", "anchor"), (1, 2, "x", "selected", "congener"), (3, 1, "z", "selected", "anchor")], "query_id long, rank int, genome_id string, disposition string, role string")
    got = {r["query_id"]: r for r in reports.audits_agree(a, b).collect()}
    assert (got[1]["jaccard"], got[1]["same_anchor"], got[1]["anchor_rank"]) == (0.5, False, 2)
    assert got[2]["jaccard"] is None and got[2]["abstains_a"] and got[2]["abstains_b"] and got[3]["abstains_a"] and not got[3]["abstains_b"]
    m = spark.createDataFrame([(k, s) for k, s in enumerate([5, 5, 5, 20, 1, 1, 1, 1])], "k long, s long")
    assert [r["batch"] for r in reports.upload_batches(m, "k", "s", 10, 3).orderBy("k").collect()] == [0, 0, 1, 2, 3, 3, 3, 4]
    f = spark.createDataFrame([("f", "CDS", ["t1", "t2"], {"a": "x", "b": ""}, "n" * 900)], "id string, type string, functions array<string>, aliases map<string,string>, note string")
    r = reports.external(f, "e").first()
    assert r["aliases"] == {"a": "x"} and r["ontology_terms"] == {"e": {"t1": [0], "t2": [1]}} and len(r["note"]) == 800


def test_encoder_is_unit_and_deterministic(spark):
    from strandwork.operators import retrieval

    df = spark.createDataFrame([(1, "acgtacgtacgt"), (2, "ACGTACGTACGT"), (3, None), (4, "ab")], "k long, s string")
    v = {r["k"]: r["embedding"] for r in retrieval.encode(df, "s").collect()}
    assert v[1] == v[2] and sum(x * x for x in v[1]) == pytest.approx(1.0, abs=1e-5) and sum(v[3]) == 0


def test_t_interval(spark):
    from strandwork.functions.stats import t_interval

    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 3.0), ("b", 5.0)], "g string, x double")
    got = {r["g"]: r for r in t_interval(df, ["g"], "x").collect()}
    assert got["a"]["high"] - 2.0 == pytest.approx(4.302653 / 3**0.5, abs=1e-3) and got["b"]["low"] == got["b"]["high"] == 5.0


def largest_remainder(avail, budget):
    """Child by child: floored shares under a cap, largest fractions first, then one by one in turn."""
    import math

    if budget <= 0 or sum(avail.values()) <= budget:
        return dict.fromkeys(avail, 0) if budget <= 0 else dict(avail)
    caps = {c: min(n, math.ceil(0.35 * budget)) for c, n in avail.items()}
    total = sum(n**0.5 for n in avail.values())
    raw = {c: budget * n**0.5 / total for c, n in avail.items()}
    out = {c: min(math.floor(raw[c]), caps[c]) for c in avail}
    left = budget - sum(out.values())
    for c in sorted(avail, key=lambda c: (-(raw[c] - math.floor(raw[c])), c)):
        give = min(caps[c] - out[c], left)
        out[c], left = out[c] + give, left - give
    while left > 0:
        for c in sorted(avail):
            if left and out[c] < avail[c]:
                out[c], left = out[c] + 1, left - 1
    return out


def test_tree_allocation(spark):
    import random

    from strandwork.operators import scoring

    r = random.Random(3)
    leaves = [(f"a{a}", f"b{b}", f"c{c}", r.choice([1, 2, 5, 40, 300])) for a in range(2) for b in range(r.randint(1, 4)) for c in range(r.randint(1, 6))]
    df = spark.createDataFrame(leaves, "a string, b string, c string, n int")
    for budget in (0, 7, 60, 500, 10**6):
        want = {}

        def deal(prefix, budget, depth):
            if depth == 3:
                want[prefix] = budget
                return
            avail = {}
            for row in leaves:
                if row[:depth] == prefix:
                    avail[row[depth]] = avail.get(row[depth], 0) + row[3]
            for child, n in largest_remainder(avail, budget).items():
                deal((*prefix, child), n, depth + 1)

        deal((), budget, 0)
        got = {(x["a"], x["b"], x["c"]): x["allocated"] for x in scoring.allocate_tree(df, ["a", "b", "c"], "n", budget).collect()}
        assert got == want


def test_bootstrap_of_spearman(spark):
    import numpy as np
    import pandas as pd

    from strandwork.functions.stats import bootstrap_corr

    rng = np.random.default_rng(5)
    x = rng.integers(0, 12, 60).astype(float)
    y = x + rng.normal(0, 4, 60).round()
    df = spark.createDataFrame([(k, float(a), float(b)) for k, (a, b) in enumerate(zip(x, y))] + [(99, None, 1.0), (100, float("nan"), 1.0)], "k long, x double, y double")
    got = bootstrap_corr(df, "k", "x", "y", 400).first()
    rank = lambda v: pd.Series(v).rank().to_numpy()
    rho = lambda i: np.corrcoef(rank(x[i]), rank(y[i]))[0, 1]
    draws = [rho(rng.integers(0, 60, 60)) for _ in range(2000)]
    assert abs(got["rho"] - rho(np.arange(60))) < 1e-8 and got["replicates"] == 400
    assert abs(got["low"] - np.quantile(draws, 0.025)) < 0.05 and abs(got["high"] - np.quantile(draws, 0.975)) < 0.05


def test_backend_choice(spark):
    from strandwork.plans.backend import Machine, choose, probe

    for cuda in (False, True):
        for metal in (False, True):
            for cores in (1, 31, 256):
                m = Machine(cuda, metal, cores, 100.0)
                assert choose(m) == ("cuda" if cuda else "metal" if metal else "cpu")
                assert [choose(m, b) for b in ("cuda", "metal", "cpu")] == ["cuda", "metal", "cpu"]
    assert choose(probe(spark)) == "cpu" and probe(spark).cores >= 1


def test_masked_mean(spark):
    from strandwork.functions import vector as V

    rows = [(1, [[3.0, 0.0], [9.0, 9.0], [0.0, 4.0]], [1, 0, 1]), (2, [[1.0, 1.0]], [0]), (3, [], [])]
    df = spark.createDataFrame(rows, "k int, v array<array<double>>, m array<int>")
    got = {r["k"]: r["p"] for r in df.select("k", V.masked_mean(F.col("v"), F.col("m"), 2).alias("p")).collect()}
    assert got == {1: [0.6, 0.8], 2: [0.0, 0.0], 3: [0.0, 0.0]}
