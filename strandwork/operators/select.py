"""Choice of representatives for each query from its ranked hits, with a decision for every hit.

A hit row has query_id, query_len, best_identity, study, rank, genome_id, taxon_id, organism, family, genus,
species, identity, align_score, aligned_len, edit_identity and gene_count.  The union mode is one plan of windows
and conditions.  What depends on the order of earlier choices (contamination budget, the legacy reducer)
runs per query over its bounded list of hits.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, replace

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text


@dataclass(frozen=True)
class Knobs:
    """Thresholds; the defaults are fixed values."""

    cov_min: float = 0.90
    agree_max: float = 0.02
    t_species: float = 0.987
    t_genus: float = 0.945
    t_family: float = 0.865
    window: float = 0.0
    species_dedup: bool = True
    coherence: bool = False
    contamination: bool = False
    protected: float = -1.0
    cap: int = 0
    legacy: bool = False
    band: float = 0.005
    blank_family_tol: float = 0.001
    w_id: float = 0.55
    w_score: float = 0.30
    w_cov: float = 0.15
    uncultured_factor: float = 0.98
    decay: float = 0.01
    novel_min: float = 0.15
    max_low: int = 1
    hard_cap: int = 6
    cap_species: int = 2
    cap_genus: int = 5
    cap_family: int = 2
    contam_species: float = 0.25
    contam_genus: float = 0.40
    contam_family: float = 0.20
    ov_species: float = 0.90
    ov_genus: float = 0.75
    ov_family: float = 0.55
    ov_other: float = 0.45
    accumulate: float = 0.12
    default_genes: int = 3000


EXACT_TIE = Knobs()
GRADUATED = replace(EXACT_TIE, window=0.005, protected=0.0, coherence=True, contamination=True)
GUARDED = replace(EXACT_TIE, coherence=True, contamination=True)
LEGACY = replace(EXACT_TIE, legacy=True)
PRESETS = {"exact_tie": EXACT_TIE, "graduated": GRADUATED, "guarded": GUARDED, "legacy": LEGACY}


def tier(best: Column, k: Knobs = EXACT_TIE) -> Column:
    b = F.coalesce(best, F.lit(0.0))
    return F.when(b >= k.t_species, "species").when(b >= k.t_genus, "genus").when(b >= k.t_family, "family").otherwise("below")


def coverage() -> Column:
    return F.round(F.least(F.col("aligned_len") / F.col("query_len"), F.lit(1.0)), 4)


def agreement() -> Column:
    return F.round(F.abs(F.col("identity") - F.col("edit_identity")), 4)


def gate(k: Knobs = EXACT_TIE) -> Column:
    """The first reason why a hit is not reliable, or null."""
    return (
        F.when(F.col("tier") == "below", "tier_floor")
        .when(coverage() < k.cov_min, "reliability_gate")
        .when(F.coalesce(agreement() > k.agree_max, F.lit(False)), "reliability_gate")
        .when(F.col("identity") < k.t_family, "identity_floor")
    )


def representativeness(k: Knobs = EXACT_TIE) -> Column:
    base = k.w_id * F.col("identity") + k.w_score * (F.col("align_score") / (2 * F.col("query_len"))) + k.w_cov * F.least(F.lit(1.0), F.col("aligned_len") / F.col("query_len"))
    return F.when(text.is_uncultured(F.col("organism")), base * k.uncultured_factor).otherwise(base)


def decayed(k: Knobs = EXACT_TIE) -> Column:
    return representativeness(k) * F.exp(-(F.coalesce(F.col("best_identity"), F.lit(0.0)) - F.col("identity")) / max(k.decay, 1e-9))


def species_key() -> Column:
    name = text.normal_name(F.col("species"))
    return F.coalesce(F.when(name != "", name), F.concat(F.lit("taxon:"), F.col("taxon_id").cast("string")), F.col("genome_id"))


def union(hits: DataFrame, k: Knobs = EXACT_TIE) -> DataFrame:
    """hits with tier, stage, disposition, position, role, confidence and representative (whom a dropped conspecific stands behind)."""
    q = Window.partitionBy("query_id")
    h = hits.withColumn("tier", tier(F.col("best_identity"), k))
    h = h.withColumn("stage", gate(k))
    best = F.max(F.when(F.col("stage").isNull(), F.col("identity"))).over(q)
    h = h.withColumn("best_kept", best)
    h = h.withColumn("stage", F.coalesce("stage", F.when(F.col("best_kept") - F.col("identity") > k.window, "identity_band")))
    live = F.col("stage").isNull()
    by_genome = Window.partitionBy("query_id", "genome_id", live).orderBy(F.desc("identity"), F.desc("align_score"), "rank")
    h = h.withColumn("stage", F.coalesce("stage", F.when(F.row_number().over(by_genome) > 1, "genome_dedup")))
    h = h.withColumn("species_key", species_key())
    if k.species_dedup:
        by_species = Window.partitionBy("query_id", "species_key", live).orderBy(F.desc("identity"), F.desc("align_score"), F.desc(F.coalesce("gene_count", F.lit(0))), "genome_id")
        h = h.withColumn("representative", F.when(live, F.first("genome_id").over(by_species)))
        h = h.withColumn("stage", F.coalesce("stage", F.when(F.row_number().over(by_species) > 1, "species_dedup")))
    else:
        h = h.withColumn("representative", F.when(live, F.col("genome_id")))
    h = h.withColumn("weight", decayed(k))
    order = Window.partitionBy("query_id", live).orderBy(F.desc("weight"), "genome_id")
    family = text.normal_name(F.col("family"))
    h = h.withColumn("anchor_family", F.when(live, F.first(family).over(order))).withColumn("at", F.when(live, F.row_number().over(order)))
    shielded = F.lit(k.protected >= 0) & (F.col("best_kept") - F.col("identity") <= k.protected)
    if k.coherence:
        stray = (F.col("at") > 1) & ~shielded & (family != "") & (F.col("anchor_family") != "") & (family != F.col("anchor_family")) & ~F.array_contains(text.taxonomy_tokens(F.col("study")), family)
        h = h.withColumn("stage", F.coalesce("stage", F.when(stray, "family_consensus")))
    position = F.row_number().over(Window.partitionBy("query_id", live).orderBy("at"))
    h = h.withColumn("position", F.when(live, position))
    if k.cap:
        h = h.withColumn("stage", F.coalesce("stage", F.when(~shielded & (F.col("position") > k.cap), "tier_cap"))).withColumn("position", F.when(live, F.col("position")))
    chosen = F.col("stage").isNull()
    out = h.withColumn("disposition", F.when(chosen, "selected").otherwise("excluded")).withColumn("role", F.when(chosen, F.when(F.col("position") == 1, "anchor").otherwise("congener")))
    out = out.withColumn("confidence", F.when(chosen, confidence(F.col("anchor_family"))))
    return out.withColumn("stage", F.coalesce("stage", F.lit("included"))).drop("best_kept", "at", "weight")


def confidence(consensus: Column) -> Column:
    family = text.normal_name(F.col("family"))
    fits = (F.coalesce(consensus, F.lit("")) == "") | (family == consensus) | F.array_contains(text.taxonomy_tokens(F.col("study")), family)
    return F.when(text.is_uncultured(F.col("organism")) | (family == ""), "low").when(fits & text.is_named(F.col("species")), "high").when(fits, "medium").otherwise("low")


def equivalents(decided: DataFrame) -> DataFrame:
    """(query_id, representative, genome_id, exact_tie): conspecifics that a selected genome stands for."""
    kept = decided.where("disposition = 'selected'").select("query_id", F.col("genome_id").alias("representative"), F.col("identity").alias("kept_identity"))
    lost = decided.where("stage = 'species_dedup'").select("query_id", "representative", "genome_id", "identity")
    return lost.join(kept, ["query_id", "representative"]).select("query_id", "representative", "genome_id", (F.abs(F.col("identity") - F.col("kept_identity")) < 1e-9).alias("exact_tie"))


def summary(decided: DataFrame) -> DataFrame:
    """One row per query: tier, n_selected, anchor, gene estimates, flags."""
    chosen = F.col("disposition") == "selected"
    genes = F.coalesce("gene_count", F.lit(3000)).cast("long")
    out = decided.groupBy("query_id").agg(
        F.min("tier").alias("tier"),
        F.count_if(chosen).alias("n_selected"),
        F.min_by("genome_id", F.when(chosen, F.col("position"))).alias("anchor"),
        F.coalesce(F.max(F.when(F.col("role") == "anchor", genes)), F.lit(0).cast("long")).alias("core_genes"),
        F.count_if(chosen & (F.col("confidence") == "low")).alias("n_low"),
        F.count_if(F.col("stage") == "species_dedup").alias("n_equivalent"),
        F.coalesce(F.bool_and(F.when(chosen, text.is_uncultured(F.col("organism")))), F.lit(False)).alias("uncultured_only"),
        F.coalesce(F.bool_or(chosen & (F.col("gene_count") == 0)), F.lit(False)).alias("has_gene_set_empty"),
        F.coalesce(F.bool_or((F.col("role") == "anchor") & (F.col("gene_count") == 0)), F.lit(False)).alias("anchor_no_gene_set"),
        F.max_by("stage", F.struct("align_score", -F.col("rank"))).alias("top_score_stage"),
    )
    anchor = F.when(F.col("n_selected") > 0, F.col("anchor"))
    status = F.when(F.col("tier") == "below", "abstain_below_family").when(F.col("n_selected") == 0, "abstain_reliability").otherwise("ok")
    return out.withColumn("anchor", anchor).withColumn("status", status).withColumn("family_level_draft", (F.col("tier") == "family") & (F.col("n_selected") > 0)).withColumn(
        "score_top_dropped", F.when(F.col("top_score_stage").isin("family_consensus", "reliability_gate"), F.col("top_score_stage"))
    ).drop("top_score_stage")


def reasons(decided: DataFrame) -> DataFrame:
    """Adds a sentence for each decision."""
    r = (
        F.when(F.col("stage") == "tier_floor", F.format_string("best identity %.4f is below the family threshold", F.coalesce("best_identity", F.lit(0.0))))
        .when((F.col("stage") == "reliability_gate") & (coverage() < EXACT_TIE.cov_min), F.format_string("covers only %.3f of the query", coverage()))
        .when(F.col("stage") == "reliability_gate", F.format_string("identities of the two methods differ by %.3f", agreement()))
        .when(F.col("stage") == "identity_floor", F.format_string("identity %.4f is below the family floor", F.col("identity")))
        .when(F.col("stage") == "identity_band", F.lit("too far below the best identity"))
        .when(F.col("stage") == "genome_dedup", F.lit("another copy of the same genome is kept"))
        .when(F.col("stage") == "species_dedup", F.concat(F.lit("species is represented by "), F.col("representative")))
        .when(F.col("stage") == "family_consensus", F.lit("family differs from the anchor's and is not expected in the study"))
        .when(F.col("role") == "anchor", F.lit("best representative"))
        .otherwise(F.col("stage"))
    )
    return decided.withColumn("reason", r)


_UNCULTURED = re.compile(text.UNCULTURED)
_PREFIX = re.compile(text.NAME_PREFIX)
_MAG = re.compile(text.MAG)


def _name(s: object) -> str:
    return _PREFIX.sub("", s.strip()).lower() if isinstance(s, str) else ""


def _novelty(hit: dict, chosen: list[dict], k: Knobs) -> float:
    """Expected share of new genes by the closest relation to those chosen before."""
    shared = 0.0
    vague = lambda s: not s or "sp." in s or "bacterium" in s
    for c in chosen:
        sp, sc = _name(hit["species"]), _name(c["species"])
        same_genus = _name(hit["genus"]) and _name(hit["genus"]) == _name(c["genus"])
        if sp and sp == sc or same_genus and (vague(sp) or vague(sc)):
            v = k.ov_species
        elif same_genus:
            v = k.ov_genus
        elif _name(hit["family"]) and _name(hit["family"]) == _name(c["family"]):
            v = k.ov_family
        else:
            v = k.ov_other
        shared = max(shared, v)
    return (1 - shared) * max(0.0, 1 - k.accumulate * len(chosen))


def choose(rows: list[dict], k: Knobs, genes: dict[str, frozenset[str]] | None = None) -> list[tuple[str, int | None]]:
    """(stage, position) of each of one query's hits in rank order: the order-dependent rules."""
    stage: list[str | None] = [None] * len(rows)
    best = rows[0]["best_identity"] if rows else None
    best = 0.0 if best is None or best != best else best
    level = "species" if best >= k.t_species else "genus" if best >= k.t_genus else "family" if best >= k.t_family else "below"
    if level == "below":
        return [("tier_floor", None)] * len(rows)
    study = {_name(t) for r in rows[:1] if isinstance(r["study"], str) for t in r["study"].split()}
    for i, r in enumerate(rows):
        ei = r["edit_identity"]
        if round(min(r["aligned_len"] / r["query_len"], 1.0), 4) < k.cov_min or ei is not None and ei == ei and round(abs(r["identity"] - ei), 4) > k.agree_max:
            stage[i] = "reliability_gate"
        elif r["identity"] < k.t_family:
            stage[i] = "identity_floor"
    live = [i for i in range(len(rows)) if stage[i] is None]
    if not live:
        return [(s, None) for s in stage]
    top = max(rows[i]["identity"] for i in live)

    def drop(keep, why: str) -> None:
        nonlocal live
        for i in live:
            if not keep(i):
                stage[i] = why
        live = [i for i in live if stage[i] is None]

    def first_of(key, order, why: str) -> None:
        seen: dict = {}
        for i in sorted(live, key=order):
            seen.setdefault(key(i), i)
        kept = set(seen.values())
        drop(lambda i: i in kept, why)

    def rep(i: int) -> float:
        r = rows[i]
        s = k.w_id * r["identity"] + k.w_score * (r["align_score"] / (2 * r["query_len"])) + k.w_cov * min(1.0, r["aligned_len"] / r["query_len"])
        return s * k.uncultured_factor if _UNCULTURED.search(r["organism"] or "") else s

    weight = lambda i: rep(i) * math.exp(-(best - rows[i]["identity"]) / max(k.decay, 1e-9))
    count = lambda i: rows[i]["gene_count"] if rows[i]["gene_count"] is not None and rows[i]["gene_count"] == rows[i]["gene_count"] else None
    family = lambda i: _name(rows[i]["family"])
    drop(lambda i: top - rows[i]["identity"] <= (k.band if k.legacy else k.window), "identity_band")
    if k.legacy:
        named = [family(i) for i in live if family(i)]
        consensus = max(named, key=lambda f: (named.count(f), -named.index(f))) if named else None
        fits = [rows[i]["identity"] for i in live if family(i) and (family(i) == consensus or family(i) in study)]
        alone = len(live) == 1
        good = [i for i in live if (consensus is None or family(i) == consensus or family(i) in study if family(i) else alone or bool(fits) and abs(rows[i]["identity"] - max(fits)) <= k.blank_family_tol)]
        if good:
            drop(lambda i: i in good, "family_consensus")
    first_of(lambda i: rows[i]["genome_id"], lambda i: (-rows[i]["identity"], -rows[i]["align_score"]), "genome_dedup")
    if k.legacy:
        first_of(lambda i: _name(rows[i]["species"]) or rows[i]["genome_id"], lambda i: -rep(i), "species_dedup")
        order = sorted(live, key=lambda i: -weight(i))
    else:
        if k.species_dedup:
            key = lambda i: _name(rows[i]["species"]) or (f"taxon:{int(rows[i]['taxon_id'])}" if rows[i]["taxon_id"] == rows[i]["taxon_id"] and rows[i]["taxon_id"] is not None else rows[i]["genome_id"])
            first_of(key, lambda i: (-rows[i]["identity"], -rows[i]["align_score"], -(count(i) or 0), rows[i]["genome_id"]), "species_dedup")
        order = sorted(live, key=lambda i: (-weight(i), rows[i]["genome_id"]))
    cap = min(k.hard_cap, {"species": k.cap_species, "genus": k.cap_genus, "family": k.cap_family}[level]) if k.legacy else k.cap
    budget = {"species": k.contam_species, "genus": k.contam_genus, "family": k.contam_family}[level]
    chosen: list[int] = []
    held: set[str] = set()
    anchor_genes, off_target, low = 0, 0.0, 0
    for i in order:
        r = rows[i]
        shielded = not k.legacy and 0 <= k.protected and top - r["identity"] <= k.protected
        own = genes.get(r["genome_id"]) if genes is not None else None
        if k.legacy and genes is not None and not own:
            stage[i] = "no_gene_set"
            continue
        n = len(own) if own else count(i)
        n = k.default_genes if n is None or k.legacy and not n else int(n)
        weak = bool(_UNCULTURED.search(r["organism"] or "")) or not re.match(text.GENOME_ID, r["genome_id"]) or bool(_MAG.search(r["organism"] or ""))
        new = n
        if chosen:
            lead = family(chosen[0])
            if k.coherence and not k.legacy and not shielded and family(i) and lead and family(i) != lead and family(i) not in study:
                stage[i] = "family_consensus"
                continue
            share = len(own - held) / max(len(own), 1) if own and k.legacy else _novelty(r, [rows[c] for c in chosen], k)
            new = len(own - held) if own and k.legacy else int(round(share * n))
            extra = (1.0 - r["identity"]) * new
            if k.legacy and share < k.novel_min:
                stage[i] = "marginal_gain"
                continue
            if k.legacy and low + weak > k.max_low or (k.legacy or k.contamination) and not shielded and anchor_genes and off_target + extra > budget * anchor_genes:
                stage[i] = "contamination_budget"
                continue
        if cap and not shielded and len(chosen) >= cap:
            stage[i] = "tier_cap"
            continue
        if chosen:
            off_target += (1.0 - r["identity"]) * new
        else:
            anchor_genes = n
        held |= own or frozenset()
        low += weak
        chosen.append(i)
        stage[i] = "included"
    return [(s or "included", chosen.index(i) + 1 if i in chosen else None) for i, s in enumerate(stage)]


def fold(hits: DataFrame, variants: dict[str, Knobs]) -> DataFrame:
    """(variant, query_id, rank, genome_id, stage, position) under each set of knobs, in one pass over the hits.

    Hits of one query come one after another in a sorted partition, so memory holds one query's list.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[dict] = []

        def decided(rows: list[dict]) -> list[tuple]:
            return [(name, r["query_id"], r["rank"], r["genome_id"], s, p) for name, k in variants.items() for r, (s, p) in zip(rows, choose(rows, k), strict=True)]

        def frame(out: list[tuple]) -> pd.DataFrame:
            return pd.DataFrame(out, columns=["variant", "query_id", "rank", "genome_id", "stage", "position"]).astype({"position": "Int32"})

        for f in frames:
            out: list[tuple] = []
            for r in f.astype(object).where(f.notna(), None).to_dict("records"):
                if held and held[0]["query_id"] != r["query_id"]:
                    out += decided(held)
                    held = []
                held.append(r)
            yield frame(out)
        if held:
            yield frame(decided(held))

    kind = hits.schema["query_id"].dataType.simpleString()
    together = hits.repartition("query_id").sortWithinPartitions("query_id", "rank")
    return together.mapInPandas(run, f"variant string, query_id {kind}, rank int, genome_id string, stage string, position int")
