"""Lineages from parent pointers, and placeholder names for ranks that lack one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def resolve(nodes: DataFrame, max_depth: int = 64) -> DataFrame:
    """(tax_id, depth, ancestor, rank, name): every node with all its ancestors (up to max_depth or the next power of two).

    Jumps double: a turn adds the ancestors that are 1, 2, 4, ... beyond those known, until no node has one that far.
    """
    reach = nodes.select("tax_id", F.lit(0).alias("depth"), F.col("tax_id").alias("ancestor"))
    jump = nodes.select(F.col("tax_id").alias("ancestor"), F.col("parent").alias("next")).where("ancestor <> next and next is not null")
    step = 1
    while step <= max_depth:
        further = reach.join(jump, "ancestor").select("tax_id", (F.col("depth") + step).alias("depth"), F.col("next").alias("ancestor"))
        reach = reach.unionByName(further)
        jump = jump.join(jump.select(F.col("ancestor").alias("next"), F.col("next").alias("far")), "next").select("ancestor", F.col("far").alias("next"))
        step *= 2
        if jump.isEmpty():
            break
    return reach.join(nodes.select(F.col("tax_id").alias("ancestor"), "rank", "name"), "ancestor").select("tax_id", "depth", "ancestor", "rank", "name")


def ranks(resolved: DataFrame, wanted: list[str]) -> DataFrame:
    """One column per rank; both superkingdom and domain fill domain."""
    rank = F.when(F.col("rank") == "superkingdom", "domain").otherwise(F.col("rank"))
    return resolved.withColumn("rank", rank).groupBy("tax_id").pivot("rank", wanted).agg(F.first("name"))


def filled(names: list[tuple[str, Column]], taxon: Column) -> list[Column]:
    """Each rank's name, or unclassified_<parent rank>:<parent>; the last rank falls back to sp_taxon_<id>."""
    out: list[Column] = []
    for i, (rank, c) in enumerate(names):
        own = F.when(F.coalesce(c, F.lit("")) != "", c)
        if i == len(names) - 1:
            fall = F.concat(F.lit("sp_taxon_"), taxon.cast("string"))
        elif i:
            fall = F.concat(F.lit(f"unclassified_{names[i - 1][0]}:"), out[-1])
        else:
            fall = F.lit("unclassified")
        out.append(F.coalesce(own, fall).alias(rank))
    return out
