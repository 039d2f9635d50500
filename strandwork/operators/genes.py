"""Gene-set algebra on long (genome, gene) tables; a genome without a set and one with an empty set stay apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ByteType, IntegerType, LongType, ShortType

from ..functions import stats

_INTEGERS = (ByteType, ShortType, IntegerType, LongType)
_BITS = "filter(sequence(0, 63), k -> shiftrightunsigned(mask, k) & 1 = 1)"
_QUERY = "shiftleft(block, 6) + k"


def _masks(chosen: DataFrame) -> DataFrame:
    """(genome_id, block, mask): bit k for query 64 * block + k; a null query is a block of its own, a null genome one more genome."""
    block = F.shiftright(F.col("query_id").cast("long"), 6).alias("block")
    bit = F.expr("shiftleft(1L, cast(coalesce(query_id, 0) & 63 as int))")
    return chosen.groupBy("genome_id", block).agg(F.bit_or(bit).alias("mask"))


def union(chosen: DataFrame, genes: DataFrame) -> DataFrame:
    """(query_id, gene, n_genomes) over each query's chosen genomes.

    Integer query ids travel as masks of 64, so a genome's genes are joined once a mask, not once a query, and
    genomes with one mask are counted before the mask is taken apart, in the partition of the gene.
    """
    kind = chosen.schema["query_id"].dataType
    g = genes.select("genome_id", "gene").distinct()
    if not isinstance(kind, _INTEGERS):
        return chosen.select("query_id", "genome_id").distinct().join(g, "genome_id").groupBy("query_id", "gene").agg(F.count("*").alias("n_genomes"))
    # the key is a struct: no null filter reaches the masks, so their plan is that of sizes() and its shuffles are reused
    g, masks = g.where("genome_id is not null").select(F.struct("genome_id").alias("key"), "gene"), _masks(chosen).select(F.struct("genome_id").alias("key"), "block", "mask")
    per_mask = g.join(masks, "key").groupBy("gene", "block", "mask").agg(F.count("*").alias("n")).repartition("gene")
    out = per_mask.select("gene", "block", F.explode(F.expr(_BITS)).alias("k"), "n").groupBy("gene", "block", "k").agg(F.sum("n").alias("n_genomes"))
    return out.select(F.expr(_QUERY).cast(kind).alias("query_id"), "gene", "n_genomes")


def sizes(chosen: DataFrame) -> DataFrame:
    """(query_id, total): the different genomes of each query, from the masks that union uses."""
    kind = chosen.schema["query_id"].dataType
    if not isinstance(kind, _INTEGERS):
        return chosen.select("query_id", "genome_id").distinct().groupBy("query_id").agg(F.count("*").alias("total"))
    out = _masks(chosen).select("block", F.explode(F.expr(_BITS)).alias("k")).groupBy("block", "k").agg(F.count("*").alias("total"))
    return out.select(F.expr(_QUERY).cast(kind).alias("query_id"), "total")


def novelty(genes: DataFrame, known: DataFrame) -> DataFrame:
    """Rows of genes whose gene is in no known set."""
    return genes.join(known.select("gene").distinct(), "gene", "left_anti")


def pangenome(per_gene: DataFrame, n_genomes: DataFrame) -> DataFrame:
    """Per query: genes in all, in at least half, in one, and in other numbers of its genomes.

    Genes are counted by number of genomes before totals are joined.
    """
    g = per_gene.groupBy("query_id", "n_genomes").agg(F.count("*").alias("genes")).join(n_genomes, "query_id")
    n, t = F.col("n_genomes"), F.col("total")
    of = lambda c: F.sum(F.when(c, F.col("genes")).otherwise(0))
    return g.groupBy("query_id").agg(F.sum("genes").alias("union_genes"), of(n == t).alias("core"), of(2 * n >= t).alias("half_core"), of((n == 1) & (t > 1)).alias("unique"), of((n > 1) & (n < t)).alias("shared"))


def outcome() -> Column:
    """The first reason that holds, in this order."""
    return (
        F.when(~F.col("has_hits"), "no_hits").when(F.col("truth_size").isNull(), "truth_missing").when(F.col("truth_size") == 0, "truth_empty")
        .when(F.col("n_selected") == 0, "abstained").when(F.col("pred_size") == 0, "pred_empty").otherwise("ok")
    )


def capture(truth: DataFrame, pred: DataFrame, queries: DataFrame) -> DataFrame:
    """Per query: sizes, intersection, recall, precision, F1 and Jaccard of two long (query_id, gene) tables."""
    t = truth.groupBy("query_id").agg(F.count_distinct("gene").alias("truth_size"))
    p = pred.groupBy("query_id").agg(F.count_distinct("gene").alias("pred_size"))
    both = truth.select("query_id", "gene").distinct().join(pred.select("query_id", "gene").distinct(), ["query_id", "gene"]).groupBy("query_id").agg(F.count("*").alias("both"))
    out = queries.join(t, "query_id", "left").join(p, "query_id", "left").join(both, "query_id", "left")
    out = out.fillna(0, ["truth_size", "pred_size", "both"])
    i, a, b = F.col("both"), F.col("truth_size"), F.col("pred_size")
    return out.withColumns({"recall": stats.ratio(i, a), "precision": stats.ratio(i, b), "f1": stats.ratio(2 * i, a + b), "jaccard": stats.ratio(i, a + b - i)})


def micro(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Pooled ratios and macro recall with a normal interval."""
    i, t, p = F.sum("both"), F.sum("truth_size"), F.sum("pred_size")
    se = F.stddev_samp("recall") / F.sqrt(F.count("recall"))
    half = 1.96 * F.coalesce(se, F.lit(0.0))
    out = cells.groupBy(*keys).agg(
        F.count("*").alias("n"), stats.ratio(i, t).alias("micro_recall"), stats.ratio(i, p).alias("micro_precision"), stats.ratio(2 * i, t + p).alias("micro_f1"),
        F.avg("recall").alias("macro_recall"), F.greatest(F.lit(0.0), F.avg("recall") - half).alias("low"), F.least(F.lit(1.0), F.avg("recall") + half).alias("high"),
    )
    return out
