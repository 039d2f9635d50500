"""Files, stages and streams."""

import gzip

from pyspark.sql import functions as F

from strandwork.plans.stages import Runner, file_records
from strandwork.sources import fasta, tables
from strandwork.streaming import watch


def test_fasta_round_trip(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">h1 first\nacgt\nAC\n>h2\nTTTT\n\n>h1 again\nGG")
    got = [(r["header"], r["seq"]) for r in fasta.read_fasta(spark, str(tmp_path / "a.fa")).orderBy("ordinal").collect()]
    assert got == [("h1 first", "ACGTAC"), ("h2", "TTTT"), ("h1 again", "GG")]
    assert [r["header"] for r in fasta.read_fasta(spark, str(tmp_path / "a.fa"), True).orderBy("ordinal").collect()] == ["h1", "h2", "h1"]
    with gzip.open(tmp_path / "b.fna.gz", "wt") as f:
        f.write(">z\nAC\nGT\n")
    assert fasta.read_sequences(spark, str(tmp_path / "b.fna.gz")).collect()[0]["seq"] == "ACGT"
    stats = fasta.file_statistics(spark, str(tmp_path / "a.fa")).first()
    assert (stats["total_length"], stats["n_contigs"]) == (12, 3)
    df = spark.createDataFrame([("x", "ACGTACGTAC")], "h string, s string")
    fasta.write_fasta(df, str(tmp_path / "out"), "h", "s", 4)
    assert fasta.read_fasta(spark, str(tmp_path / "out" / "*.txt")).first()["seq"] == "ACGTACGTAC"


def test_json_map(spark, tmp_path):
    (tmp_path / "m.json").write_text('{"a": "ACGT", "b": "GG"}')
    assert sorted(map(tuple, fasta.read_sequences(spark, str(tmp_path / "m.json")).collect())) == [("a", "ACGT"), ("b", "GG")]


def test_study_table(spark, tmp_path):
    (tmp_path / "t.csv").write_text("seq,Kingdom,Phylum,Class,Order,Family,Genus,Species,rel_ab\nACGT,B,nan,,O,F,midas_g_1,S,0.5\nGG,B,P,C,O,F,G,S,x\n")
    df = tables.read_study(spark, str(tmp_path / "t.csv"))
    assert [r["rel_ab"] for r in df.orderBy("seq").collect()] == [0.5, 0.0]
    assert df.where("seq = 'ACGT'").select(tables.study_taxonomy(df).alias("s")).first()["s"] == "B O F S"


def test_taxdump_and_reports(spark, tmp_path):
    (tmp_path / "nodes.dmp").write_text("1\t|\t1\t|\tno rank\t|\n2\t|\t1\t|\tsuperkingdom\t|\n")
    (tmp_path / "names.dmp").write_text("2\t|\tBacteria\t|\t\t|\tscientific name\t|\n2\t|\teubacteria\t|\t\t|\tsynonym\t|\n")
    got = {r["tax_id"]: (r["parent"], r["rank"], r["name"]) for r in tables.read_taxdump(spark, str(tmp_path / "nodes.dmp"), str(tmp_path / "names.dmp")).collect()}
    assert got == {1: (1, "no rank", None), 2: (1, "superkingdom", "Bacteria")}
    (tmp_path / "tax.tsv").write_text("GB_GCA_1.1\td__Bacteria;p__P\nRS_GCF_2.1\td__Archaea\n")
    assert {r["accession"] for r in tables.read_reference_taxonomy(spark, str(tmp_path / "tax.tsv")).collect()} == {"GCA_1.1", "GCF_2.1"}
    (tmp_path / "d.tsv").write_text("user_genome\tclassification\tclosest_genome_reference\nx\td__B\tN/A\n")
    assert tables.read_decisions(spark, str(tmp_path / "d.tsv")).first()["closest_genome_reference"] == ""


def test_runner_skips_and_forces(spark, tmp_path):
    calls = []

    def work():
        calls.append(1)
        return spark.range(3)

    for _ in range(2):
        r = Runner(spark, f"file://{tmp_path}/run")
        assert r.stage("one", work, knob=1).count() == 3
    assert len(calls) == 1
    r = Runner(spark, f"file://{tmp_path}/run", force=True)
    r.together({"one": work, "two": work})
    assert len(calls) == 3 and r.manifest().count() == 2
    assert file_records(spark, f"{tmp_path}/run/one/*.parquet").where(F.length("md5") == 32).count() > 0


def test_stream_takes_each_key_once(spark, tmp_path):
    schema = "k long, x string"
    spark.createDataFrame([(1, "a"), (2, "b"), (2, "b")], schema).write.parquet(f"{tmp_path}/in/1")
    args = (f"{tmp_path}/out", f"{tmp_path}/check", "k")
    run = lambda: watch.ingest(watch.arrivals(spark, f"{tmp_path}/in/*", schema), *args).awaitTermination()
    run()
    spark.createDataFrame([(2, "late"), (3, "c")], schema).write.parquet(f"{tmp_path}/in/2")
    run()
    run()
    assert sorted((r["k"], r["x"]) for r in spark.read.parquet(f"{tmp_path}/out").collect()) == [(1, "a"), (2, "b"), (3, "c")]


def test_json_is_told_by_content(spark, tmp_path):
    (tmp_path / "seqs").write_text('\n  {"a": "ACGT"}')
    (tmp_path / "plain").write_text(">a\nACGT\n")
    for name in ("seqs", "plain"):
        assert [tuple(r) for r in fasta.read_sequences(spark, str(tmp_path / name)).collect()] == [("a", "ACGT")]


def test_rank_maps(spark, tmp_path):
    (tmp_path / "t.json").write_text('{"1.2__V4": {"Kingdom": "Bacteria", "Phylum": "P", "genus": "g"}, "3.4": {"domain": "Archaea", "Species": "s"}}')
    got = {r["genome_id"]: r["lineage"] for r in tables.read_rank_maps(spark, str(tmp_path / "t.json")).collect()}
    assert got == {"1.2": "d__Bacteria;p__P;c__;o__;f__;g__g;s__", "3.4": "d__Archaea;p__;c__;o__;f__;g__;s__s"}


def test_jsonl_with_nested_cells(spark, tmp_path):
    cells = lambda v: '{"scores": {"anchor": {"cells": {"Genus": %s}}}}' % v
    lines = [f'{{"src_genome_id": "1.1", "region": "V4", "self_modes": {{"include": {cells("true")}}}}}', f'{{"src_genome_id": "1.1", "region": "V3", "self_modes": {{"include": {cells("null")}}}}}', f'{{"src_genome_id": "2.1", "region": "", "self_modes": {{"include": {cells("true")}}}}}', '{"src_genome_id": "3.1", "region": "V4"}', "", "no json"]
    (tmp_path / "s.jsonl").write_text("\n".join(lines))
    records = tables.read_jsonl(spark, str(tmp_path / "s.jsonl"), tables.SCORES)
    got = sorted(map(tuple, tables.correct_cells(records, "anchor", "Genus", "include").collect()))
    assert got == [("1.1", "V3", False), ("1.1", "V4", True)]
    tables.export_jsonl(spark.range(3), str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 3


def test_panel_and_domain_map_fall_back(spark, tmp_path):
    import json

    from strandwork.operators import pcr

    regions = [{"name": f"R{k}", "fwd": "ACGT", "rev": "GGTT", "insert_lo": k, "insert_hi": 100, "priority": "core"} for k in range(8)]
    (tmp_path / "p.json").write_text(json.dumps({"regions": regions}))
    assert [r.low for r in pcr.load_panel(spark, str(tmp_path / "p.json"))] == list(range(8))
    (tmp_path / "q.json").write_text(json.dumps({"regions": regions[:7]}))
    assert pcr.load_panel(spark, str(tmp_path / "q.json")) == pcr.PANEL == pcr.load_panel(spark, str(tmp_path / "none.json"))
    (tmp_path / "m.json").write_text('{"genomes": [{"genome_id": "1.1", "domain": "Bacteria"}, {"genome_id": "2.1"}]}')
    (tmp_path / "f.json").write_text('{"1.1": "Archaea"}')
    read = lambda n: [tuple(r) for r in tables.domain_map(spark, str(tmp_path / n)).collect()]
    assert (read("m.json"), read("f.json"), read("none.json")) == ([("1.1", "Bacteria")], [("1.1", "Archaea")], [])


def test_amplicon_keys(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">1.1__V4 x\nAC\n")
    manifest = spark.createDataFrame([("1.1",), ("2.1",)], "genome_id string")
    keys = lambda p: sorted(r["key"] for r in tables.amplicon_keys(spark, str(tmp_path / p), manifest, ["V3", "V4"]).collect())
    assert keys("a.fa") == ["1.1__V4"] and keys("none.fa") == ["1.1__V3", "1.1__V4", "2.1__V3", "2.1__V4"]


def test_outputs_are_set_aside_and_inexact_input_refused(spark, tmp_path):
    import pytest

    from strandwork.plans import cli, stages

    path = f"{tmp_path}/out"
    assert stages.set_aside(spark, path, "old") is None
    for want in (f"{path}.old", f"{path}.old.1"):
        spark.range(2).write.parquet(path)
        assert stages.set_aside(spark, path, "old") == want and spark.read.parquet(want).count() == 2
    stages.refuse_inexact("exact"), stages.refuse_inexact("estimated", allow=True), stages.refuse_inexact(None)
    with pytest.raises(ValueError, match="estimated"):
        stages.refuse_inexact("estimated")
    assert cli.knobs("exact_tie", '{"window": 0.01, "cap": 2}').cap == 2
    for bad in ('{"windo": 1}', '{"cap": "2"}', '{"species_dedup": 1}'):
        with pytest.raises(ValueError, match="knob"):
            cli.knobs("exact_tie", bad)
    (tmp_path / "b.log").write_text("\n".join(f"[build] {k}\nnoise" for k in range(50)))
    assert stages.log_excerpt(spark, f"{tmp_path}/b.log", ["[build]"], 3) == ["[build] 47", "[build] 48", "[build] 49"]
    assert stages.code_state(str(tmp_path)) == {} or stages.code_state(str(tmp_path))["commit"]
