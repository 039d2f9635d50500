"""Primer-style extraction with a panel of regions."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import kernels, text


@dataclass(frozen=True)
class Region:
    name: str
    forward: str
    reverse: str
    low: int
    high: int
    priority: str = "core"


# The panel of regions.
PANEL = (
    Region("FullLength16S", "AGAGTTTGATCMTGGCTCAG", "TACGGYTACCTTGTTACGACTT", 1380, 1520),
    Region("V1-V2", "AGAGTTTGATCMTGGCTCAG", "TGCTGCCTCCCGTAGGAGT", 270, 340),
    Region("V1-V3", "AGAGTTTGATCMTGGCTCAG", "ATTACCGCGGCTGCTGG", 420, 520),
    Region("V3-V4", "CCTACGGGNGGCWGCAG", "GACTACHVGGGTATCTAATCC", 390, 480),
    Region("V4", "GTGYCAGCMGCCGCGGTAA", "GGACTACNVGGGTWTCTAAT", 240, 320),
    Region("V4-V5", "GTGYCAGCMGCCGCGGTAA", "CCGYCAATTYMTTTRAGTTT", 300, 450),
    Region("V4-V5_944R", "GTGYCAGCMGCCGCGGTAA", "GAATTAAACCACATGCTC", 320, 470, "variant"),
    Region("V7-V9", "YAACGAGCGCAACCC", "TACGGYTACCTTGTTACGACTT", 340, 440),
)


def load_panel(spark: SparkSession, path: str) -> tuple[Region, ...]:
    """The regions of a panel file; the built-in ones unless it has exactly eight of different names, none of them V6-V8."""
    schema = "regions array<struct<name: string, fwd: string, rev: string, insert_lo: int, insert_hi: int, lo: int, hi: int, priority: string>>"
    try:
        found = spark.read.option("wholetext", True).text(path).select(F.from_json("value", schema)["regions"].alias("r")).first()
    except AnalysisException:
        return PANEL
    regions = found["r"] if found and found["r"] else []
    names = {r["name"] for r in regions}
    if len(regions) != 8 or len(names) != 8 or "V6-V8" in names:
        return PANEL
    either = lambda a, b: a if a is not None else b
    return tuple(Region(r["name"], r["fwd"], r["rev"], either(r["insert_lo"], r["lo"]), either(r["insert_hi"], r["hi"]), r["priority"] or "core") for r in regions)


def chosen(names: list[str] | None = None, core_only: bool = False, panel: tuple[Region, ...] = PANEL) -> tuple[Region, ...]:
    unknown = set(names or ()) - {r.name for r in panel}
    if unknown:
        raise ValueError(f"unknown regions: {sorted(unknown)}")
    return tuple(r for r in panel if (not names or r.name in names) and (not core_only or r.priority == "core"))


def exact_inserts(df: DataFrame, seq: str, forward: str, reverse: str, low: int, high: int) -> DataFrame:
    """df with at (1-based place of the first forward match) and insert, the text from its end to the next reverse match; other rows go, as do inserts outside low..high.

    Each text is split once by each pattern; the generators keep filters from copying the patterns.
    """
    cut = lambda c, pattern: F.explode(F.array(F.split(c, pattern, 2)))
    first = df.withColumn("__f", cut(F.col(seq), forward)).where(F.size("__f") == 2)
    both = first.withColumn("at", (F.length(F.col("__f")[0]) + 1).cast("long")).withColumn("__r", cut(F.col("__f")[1], reverse)).where(F.size("__r") == 2)
    return both.withColumn("insert", F.col("__r")[0]).where(F.length("insert").between(low, high)).drop("__f", "__r")


def region_statistics(seqs: DataFrame, extracted: DataFrame, seq: str, insert: str, low: int = 1400, high: int = 1600) -> DataFrame:
    """One row: sequences, those of full length, those extracted, shares, and lengths of the inserts; extracted: rows of seqs with an insert."""
    full = lambda c: F.length(c).between(low, high)
    a = seqs.agg(F.count("*").alias("n_input"), F.count_if(full(F.col(seq))).alias("n_full_length"))
    x = F.length(insert).cast("double")
    whole = lambda q: F.percentile(x, F.lit(q)).cast("long")
    b = extracted.agg(F.count("*").alias("n_extracted"), F.count_if(full(F.col(seq))).alias("n_full_extracted"), whole(0.5).alias("median"), F.round(F.avg(x), 1).alias("mean"), whole(0.05).alias("p5"), whole(0.95).alias("p95"), F.min(x).cast("long").alias("low"), F.max(x).cast("long").alias("high"))
    share = lambda k, n: F.round(F.col(k) / F.greatest(F.col(n), F.lit(1)), 4)
    return a.join(F.broadcast(b)).withColumns({"extract_rate": share("n_extracted", "n_input"), "full_extract_rate": share("n_full_extracted", "n_full_length")})  # one row each


def amplicons(seqs: DataFrame, key: str, seq: str, panel: tuple[Region, ...] = PANEL, edits: int = 3, include_primers: bool = True) -> DataFrame:
    """(key, region, amplicon, fwd_edits, rev_edits, strand); the reverse strand is tried where the forward one gives nothing, region by region."""
    plan = [(r.name, r.forward, text.reversed_primer(r.reverse), r.low, r.high) for r in panel]
    turn = str.maketrans(text.CODES, text.COMPLEMENTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        primers = {p: kernels.Primer(p, text.primer_pattern(p), edits) for _, f, r, _, _ in plan for p in (f, r)}

        def one(s: str, fwd: str, rev: str, low: int, high: int) -> tuple[str, int, int] | None:
            f = primers[fwd].find(s)
            r = f and primers[rev].find(s, f[1])
            if not r or not low <= r[0] - f[1] <= high:
                return None
            return (s[f[0] : r[1]] if include_primers else s[f[1] : r[0]]), f[2], r[2]

        for b in batches:
            out: list[tuple] = []
            for k, s in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                back = s.translate(turn)[::-1]
                for name, fwd, rev, low, high in plan:
                    for strand, x in (("+", s), ("-", back)):
                        if got := one(x, fwd, rev, low, high):
                            out.append((k, name, *got, strand))
                            break
            cols = list(zip(*out, strict=True)) or [[]] * 6
            kinds = [b.schema.field(0).type, pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, kinds, strict=True)], names=["key", "region", "amplicon", "fwd_edits", "rev_edits", "strand"])

    src = seqs.select(F.col(key).alias("key"), text.clean_sequence(F.col(seq)).alias("seq")).where(F.col("seq").isNotNull())
    kind = src.schema["key"].dataType.simpleString()
    return src.mapInArrow(run, f"key {kind}, region string, amplicon string, fwd_edits int, rev_edits int, strand string")
