"""Exact deduplication, member tables and fan-out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T


def atypical(length: Column, low: int = 200, high: int = 2000) -> Column:
    return (length > high) | (length < low)


def length_range(df: DataFrame, column: str, least: int | None = 0, most: int | None = 0) -> DataFrame:
    """Rows within a length range; 0 or None is no limit."""
    if least:
        df = df.where(F.col(column) >= least)
    if most:
        df = df.where(F.col(column) <= most)
    return df


def keyed(seqs: DataFrame, seq: str, order: str, least: int = 20) -> DataFrame:
    """Adds md5 of the cleaned sequence and its length; shorter ones than least are left out."""
    clean = T.clean_sequence(F.col(seq))
    return seqs.select("*", F.md5(clean.cast("binary")).alias("md5"), F.length(clean).alias("seq_len")).where(F.col("seq_len") >= least)


def index(seqs: DataFrame, seq: str, order: str, genome: str, metadata: list[str], least: int = 20) -> DataFrame:
    """One row per different sequence: the first row's metadata, multiplicity, and distinct genomes."""
    first = F.min_by(F.struct(*metadata), F.col(order))
    out = keyed(seqs, seq, order, least).groupBy("md5").agg(
        F.min(order).alias("first_order"), F.first("seq_len").alias("seq_len"), F.count("*").alias("multiplicity"), F.count_distinct(genome).alias("n_genomes"), first.alias("__m")
    )
    return out.select("md5", "first_order", "seq_len", "multiplicity", "n_genomes", atypical(F.col("seq_len")).alias("atypical_len"), *[F.col("__m").getField(c).alias(c) for c in metadata])


def members(seqs: DataFrame, seq: str, order: str, key: str, least: int = 20) -> DataFrame:
    """(key, row_id): row_id is the least key of rows with the same sequence."""
    k = keyed(seqs, seq, order, least)
    return k.select(key, "md5", "seq_len").join(k.groupBy("md5").agg(F.min(order).alias("row_id")), "md5").select(key, "row_id", "seq_len")


def member_lists(seqs: DataFrame, seq: str, order: str, key: str, least: int = 20) -> DataFrame:
    """For export: md5 with the sorted array of its keys."""
    return keyed(seqs, seq, order, least).groupBy("md5").agg(F.sort_array(F.collect_list(key)).alias("keys"))


def fan_out(hits: DataFrame, bridge: DataFrame, on: str) -> DataFrame:
    """Every hit of a unique row, repeated for each of its members."""
    return hits.join(bridge, on)


def not_fanned(bridge: DataFrame, hits: DataFrame, on: str) -> DataFrame:
    """Members of which no hit is known."""
    return bridge.join(hits, on, "left_anti")


def cleaned(seq: str) -> Column:
    return T.clean_sequence(F.col(seq))


def length_places(df: DataFrame, length: str, order: list[str]) -> DataFrame:
    """Adds place, from 0, in the order of length and then of order, whose first column is a digest.

    Rows are numbered within a length and a beginning of the digest; what comes before is summed over counts.
    """
    keys = [length, "__part"]
    d = df.withColumn("__part", F.substring(order[0], 1, 3))
    counts = d.groupBy(*keys).agg(F.count("*").alias("__n"))
    upto = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    within = counts.withColumn("__b", F.coalesce(F.sum("__n").over(upto(Window.partitionBy(length).orderBy("__part"))), F.lit(0)))
    lengths = counts.groupBy(length).agg(F.sum("__n").alias("__m")).withColumn("__a", F.coalesce(F.sum("__m").over(upto(Window.partitionBy(F.lit(0)).orderBy(length))), F.lit(0)))  # one row per length
    start = within.join(lengths, length).select(*keys, (F.col("__a") + F.col("__b")).alias("__s"))
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return d.withColumn("__r", n).join(start, keys).withColumn("place", (F.col("__s") + F.col("__r") - 1).cast("long")).drop("__part", "__r", "__s")
