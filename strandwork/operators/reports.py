"""Tables that explain a run: why queries abstained, what each maps to, how two audits agree, unions of functions, exports."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..sources.tables import metadata_text


def abstentions(summary: DataFrame) -> DataFrame:
    """Counts and an explanation of each status of select.summary()."""
    why = F.when(F.col("status") == "abstain_below_family", "too far from every reference").when(F.col("status") == "abstain_reliability", "no hit passed the reliability gate").otherwise("mapped")
    return summary.groupBy("status").agg(F.count("*").alias("n"), F.first(why).alias("explanation"))


def mapping(summary: DataFrame, decided: DataFrame, queries: DataFrame) -> DataFrame:
    """One row per query: status, anchor with its identity and species, and numbers of hits and representatives."""
    anchor = decided.where("role = 'anchor'").select("query_id", F.col("identity").alias("anchor_identity"), F.col("species").alias("anchor_species"))
    n = decided.groupBy("query_id").agg(F.count("*").alias("n_hits"))
    out = queries.select("query_id").join(summary.select("query_id", "status", "tier", "anchor", "n_selected"), "query_id", "left").join(anchor, "query_id", "left").join(n, "query_id", "left")
    return out.withColumn("status", F.coalesce("status", F.lit("no_hits"))).fillna(0, ["n_selected", "n_hits"])


def audits_agree(a: DataFrame, b: DataFrame) -> DataFrame:
    """Per query of two decided tables: Jaccard of the chosen genomes, same anchor, the rank that b gives a's anchor, and agreement on abstaining."""
    pick = lambda d, n: d.where("disposition = 'selected'").groupBy("query_id").agg(F.collect_set("genome_id").alias(f"set_{n}"), F.max(F.when(F.col("role") == "anchor", F.col("genome_id"))).alias(f"anchor_{n}"))
    every = a.select("query_id").union(b.select("query_id")).distinct()
    out = every.join(pick(a, "a"), "query_id", "left").join(pick(b, "b"), "query_id", "left")
    rank = b.groupBy("query_id", F.col("genome_id").alias("anchor_a")).agg(F.min("rank").alias("anchor_rank"))
    out = out.join(rank, ["query_id", "anchor_a"], "left")
    none = F.array().cast("array<string>")
    x, y = F.coalesce("set_a", none), F.coalesce("set_b", none)
    union = F.size(F.array_union(x, y))
    return out.select("query_id", F.when(union > 0, F.size(F.array_intersect(x, y)) / union).alias("jaccard"), F.col("anchor_a").eqNullSafe(F.col("anchor_b")).alias("same_anchor"), F.col("anchor_rank").cast("long").alias("anchor_rank"), (F.size(x) == 0).alias("abstains_a"), (F.size(y) == 0).alias("abstains_b"))


def salvage(decided: DataFrame, same: dict[str, Column]) -> DataFrame:
    """Counts by (closest relation that a query's hits have to its source, stage that hit reached); relations in falling order."""
    level = F.lit("none")
    for name, c in reversed(list(same.items())):
        level = F.when(c, F.lit(name)).otherwise(level)
    order = {n: i for i, n in enumerate([*same, "none"])}
    depth = F.create_map(*[F.lit(v) for kv in order.items() for v in kv])[F.col("level")]
    best = decided.withColumn("level", level).groupBy("query_id").agg(F.min_by(F.struct("level", "stage"), F.struct(depth, "rank")).alias("b"))
    return best.groupBy(F.col("b.level").alias("level"), F.col("b.stage").alias("stage")).agg(F.count("*").alias("n"))


def function_union(chosen: DataFrame, functions: DataFrame, fetched: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((query_id, function, n_genomes), (query_id, status, failed)): status is built, abstain or failed; failed lists sources that could not be fetched.

    chosen: query_id and genome_id (null for a query without any); functions: genome_id, function; fetched: genome_id.
    """
    real = chosen.where("genome_id is not null")
    union = real.join(functions, "genome_id").groupBy("query_id", "function").agg(F.count_distinct("genome_id").alias("n_genomes"))
    known = chosen.join(fetched.select("genome_id", F.lit(True).alias("__ok")).distinct(), "genome_id", "left")
    missing = F.sort_array(F.collect_set(F.when(F.col("__ok").isNull(), F.col("genome_id"))))
    per = known.groupBy("query_id").agg(F.count("genome_id").alias("n"), F.count("__ok").alias("n_ok"), missing.alias("failed"))
    status = F.when(F.col("n") == 0, "abstain").when(F.col("n_ok") == 0, "failed").otherwise("built")
    return union, per.select("query_id", status.alias("status"), "failed")


def external(features: DataFrame, event: str) -> DataFrame:
    """Features (id, type, functions, aliases map, note) in the shape of an external genome record: empty aliases dropped, terms by position, notes cut."""
    return features.select(
        "id", "type", F.col("functions"), F.map_filter("aliases", lambda k, v: v.isNotNull() & (v != "")).alias("aliases"),
        text.ontology_terms(F.create_map(F.lit(event), F.coalesce("functions", F.array().cast("array<string>")))).alias("ontology_terms"), metadata_text(F.col("note")).alias("note"),
    )


def upload_batches(manifest: DataFrame, order: str, size: str, most_bytes: int, most_rows: int) -> DataFrame:
    """Adds batch: files in order, a new batch whenever the next file would exceed the bytes or the number.

    Each start depends on the one before, so the manifest (names and sizes) is read in order by one task, as a stream.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        batch, held, n = 0, 0, 0
        for f in frames:
            out = []
            for b in f[size]:
                if n and (held + b > most_bytes or n >= most_rows):
                    batch, held, n = batch + 1, 0, 0
                held, n = held + b, n + 1
                out.append(batch)
            yield f.assign(batch=out)

    ordered = manifest.select(order, size).repartition(1).sortWithinPartitions(order)
    schema = ", ".join(f"{c} {ordered.schema[c].dataType.simpleString()}" for c in (order, size)) + ", batch int"
    return ordered.mapInPandas(run, schema)
