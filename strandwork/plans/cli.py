"""python -m strandwork.plans.cli: the engine's commands over Parquet tables, FASTA files and JSON maps."""

from __future__ import annotations

import argparse
import json
from dataclasses import fields, replace

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import dedup, hits, kmer, knn, pcr, scoring, select
from ..sources import fasta, tables


def session(name: str = "strandwork") -> SparkSession:
    return SparkSession.builder.appName(name).config("spark.sql.adaptive.enabled", "true").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def knobs(preset: str, overrides: str | None) -> select.Knobs:
    """A preset with values from a JSON object; unknown names and wrong types are refused."""
    base, given = select.PRESETS[preset], json.loads(overrides) if overrides else {}
    kinds = {f.name: type(getattr(base, f.name)) for f in fields(base)}
    for k, v in given.items():
        if k not in kinds:
            raise ValueError(f"unknown knob {k!r}")
        if kinds[k] is bool and not isinstance(v, bool) or kinds[k] is not bool and (isinstance(v, bool) or not isinstance(v, int | float)):
            raise ValueError(f"knob {k!r} takes {kinds[k].__name__}, not {v!r}")
    return replace(base, **{k: kinds[k](v) for k, v in given.items()})


def main(args: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="strandwork")
    sub = p.add_subparsers(dest="command", required=True)
    s = sub.add_parser("search", help="exact cosine neighbours")
    s.add_argument("--vectors", required=True)
    s.add_argument("--key", default="vec_id")
    s.add_argument("--column", default="embedding")
    s.add_argument("--topk", type=int, default=10)
    s.add_argument("--min-sim", type=float)
    s.add_argument("--out", required=True)
    s = sub.add_parser("select", help="representatives from a hit table")
    s.add_argument("--hits", required=True)
    s.add_argument("--preset", choices=sorted(select.PRESETS), default="exact_tie")
    s.add_argument("--knobs", help="JSON object of knob values that replace the preset's")
    s.add_argument("--out", required=True)
    s = sub.add_parser("dedup", help="index of the different sequences of a FASTA file or JSON map")
    s.add_argument("--sequences", required=True)
    s.add_argument("--min-len", type=int, default=20)
    s.add_argument("--out", required=True)
    s = sub.add_parser("pcr", help="amplicons of a panel of regions")
    s.add_argument("--sequences", required=True)
    s.add_argument("--panel")
    s.add_argument("--regions", nargs="*")
    s.add_argument("--core-only", action="store_true")
    s.add_argument("--edits", type=int, default=3)
    s.add_argument("--inserts-only", action="store_true")
    s.add_argument("--out", required=True)
    s = sub.add_parser("kmer", help="nearest sequences by k-mer weights")
    s.add_argument("--queries", required=True)
    s.add_argument("--sequences", required=True)
    s.add_argument("--k", type=int, default=8)
    s.add_argument("--topk", type=int, default=20)
    s.add_argument("--out", required=True)
    s = sub.add_parser("concordance", help="the first aligned hit's lineage against a second classification")
    s.add_argument("--hits", required=True)
    s.add_argument("--decisions", required=True)
    s.add_argument("--out", required=True)
    a = p.parse_args(args)
    spark = session()
    if a.command == "search":
        v = spark.read.parquet(a.vectors)
        out = knn.top_k(v, v, a.key, a.column, a.topk, least=a.min_sim)
    elif a.command == "select":
        found, k = spark.read.parquet(a.hits), knobs(a.preset, a.knobs)
        out = select.fold(found, {a.preset: k}) if k.legacy or k.contamination else select.union(found, k)
    elif a.command == "dedup":
        out = dedup.index(fasta.read_sequences(spark, a.sequences), "seq", "header", "header", ["header"], a.min_len)
    elif a.command == "pcr":
        panel = pcr.load_panel(spark, a.panel) if a.panel else pcr.PANEL
        out = pcr.amplicons(fasta.read_sequences(spark, a.sequences), "header", "seq", pcr.chosen(a.regions, a.core_only, panel), a.edits, not a.inserts_only)
    elif a.command == "kmer":
        q, r = (fasta.read_sequences(spark, p).withColumn("text", F.col("seq")) for p in (a.queries, a.sequences))
        out = kmer.ranked(kmer.tfidf_scores(q, r, "header", "header", "text", a.k), "cosine").where(F.col("rank") <= a.topk)
    else:
        best = hits.first_passing(spark.read.parquet(a.hits), "query_id", F.col("af_pass"), "rank").select("query_id", F.col("lineage").alias("ref"))
        own = tables.read_decisions(spark, a.decisions).select(F.col("user_genome").alias("query_id"), F.col("classification").alias("own"))
        both = best.join(own, "query_id", "left")
        ranks = {x: (f"own_{x}", f"ref_{x}") for x in "dpcofgs"}
        out = scoring.against(both.select(*[text.lineage_rank(F.col(side), x).alias(f"{side}_{x}") for x in ranks for side in ("own", "ref")]), ranks, "rank")
    out.write.mode("overwrite").parquet(a.out)


if __name__ == "__main__":
    main()
