"""Long hit tables: ranking, best per key, exclusion, agreement of runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def ranked(hits: DataFrame, query: str, order: list[Column], k: int | None = None, name: str = "rank") -> DataFrame:
    """Adds a rank from 1 within each query; order must be total."""
    out = hits.withColumn(name, F.row_number().over(Window.partitionBy(query).orderBy(*order)))
    return out.where(F.col(name) <= k) if k else out


def best_per(hits: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key by a total order."""
    return hits.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__r = 1").drop("__r")


def exclude_self(hits: DataFrame, query: str, same: Column, order: list[Column]) -> DataFrame:
    """Hits that are not the query's own source, ranked anew."""
    return ranked(hits.where(~F.coalesce(same, F.lit(False))).drop("rank"), query, order)


def tie_cluster(hits: DataFrame, query: str, score: str, epsilon: float = 0.0) -> DataFrame:
    """(query, best, n_tied): hits within epsilon of the best."""
    w = Window.partitionBy(query)
    h = hits.withColumn("best", F.max(score).over(w))
    return h.groupBy(query).agg(F.max("best").alias("best"), F.count_if(F.col("best") - F.col(score) <= epsilon).alias("n_tied"))


def place_in_ties(hits: DataFrame, query: str, score: str) -> DataFrame:
    """Adds n_above (hits that score higher) and n_equal."""
    return hits.withColumn("n_above", (F.rank().over(Window.partitionBy(query).orderBy(F.desc(score))) - 1).cast("long")).withColumn("n_equal", F.count("*").over(Window.partitionBy(query, score)))


def self_recovery(hits: DataFrame, query: str, same: Column) -> DataFrame:
    """(query, self_in_list, self_first, self_rank)."""
    own = F.min(F.when(same, F.col("rank")))
    return hits.groupBy(query).agg(F.coalesce(F.bool_or(same), F.lit(False)).alias("self_in_list"), F.coalesce(own == 1, F.lit(False)).alias("self_first"), own.cast("long").alias("self_rank"))


def compare_runs(a: DataFrame, b: DataFrame, query: str, ref: str) -> DataFrame:
    """Per query: sizes of both lists, common references, Jaccard, same first."""
    both = a.select(query, ref, F.col("rank").alias("ra")).join(b.select(query, ref, F.col("rank").alias("rb")), [query, ref], "full_outer")
    out = both.groupBy(query).agg(
        F.count("ra").alias("n_a"), F.count("rb").alias("n_b"), F.count_if(F.col("ra").isNotNull() & F.col("rb").isNotNull()).alias("n_both"),
        F.coalesce(F.bool_or((F.col("ra") == 1) & (F.col("rb") == 1)), F.lit(False)).alias("same_first"), F.count("*").alias("n_any"),
    )
    return out.withColumn("jaccard", F.col("n_both").cast("double") / F.col("n_any")).withColumn("identical", F.col("n_both") == F.col("n_any")).drop("n_any")


def majority(votes: DataFrame, keys: list[str], name: Column) -> DataFrame:
    """(keys, winner, strength): the most frequent name; AMBIG where two are equally frequent."""
    counts = votes.select(*keys, name.alias("__name")).where("__name is not null and __name <> ''").groupBy(*keys, "__name").agg(F.count("*").alias("__n"))
    w = Window.partitionBy(*keys)
    c = counts.withColumn("__top", F.max("__n").over(w)).withColumn("__total", F.sum("__n").over(w)).where("__n = __top")
    out = c.groupBy(*keys).agg(F.min("__name").alias("__first"), F.count("*").alias("__k"), F.max("__top").alias("__top"), F.max("__total").alias("__total"))
    return out.select(*keys, F.when(F.col("__k") > 1, "AMBIG").otherwise(F.col("__first")).alias("winner"), (F.col("__top").cast("double") / F.col("__total")).alias("strength"))


def exact_flag(neighbours: DataFrame, digests: DataFrame, key: str) -> DataFrame:
    """Adds exact_md5_match to (query_id, ref_id): whether both have the same digest; digests: key and digest."""
    side = lambda c: digests.select(F.col(key).alias(c), F.col("digest").alias(f"__{c}"))
    out = neighbours.join(side("query_id"), "query_id", "left").join(side("ref_id"), "ref_id", "left")
    return out.withColumn("exact_md5_match", F.coalesce(F.col("__query_id") == F.col("__ref_id"), F.lit(False))).drop("__query_id", "__ref_id")


def novel(best_cosine: Column, least: float = 0.9) -> Column:
    """Whether a query is unlike every reference."""
    return F.coalesce(best_cosine < least, F.lit(True))


def first_passing(hits: DataFrame, query: str, passes: Column, order: str) -> DataFrame:
    """The first hit of each query, in order, that passes; queries without any go."""
    kept = hits.where(passes)
    return kept.groupBy(query).agg(F.min_by(F.struct(*kept.columns), order).alias("__h")).select("__h.*")


def pool(parts: list[DataFrame]) -> DataFrame:
    """The different rows of several candidate tables."""
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out.distinct()


def missed(candidates: DataFrame, others: DataFrame, query: str, ref: str, value: str, best: Column | None = None) -> DataFrame:
    """n queries; those for which a row of others beats every candidate, and those whose best of both is the best candidate.

    best: what the best has most of (by default the value, then the smaller ref).
    """
    both = candidates.select(query, ref, value, F.lit(True).alias("mine")).union(others.select(query, ref, value, F.lit(False)))
    best = F.struct(value, -F.col(ref)) if best is None else best
    q = both.groupBy(query).agg(F.max(F.when(F.col("mine"), F.col(value))).alias("c"), F.max(F.when(~F.col("mine"), F.col(value))).alias("r"), F.max_by(ref, best).alias("top"), F.max_by(ref, F.when(F.col("mine"), best)).alias("own"))
    return q.agg(F.count("*").alias("n"), F.count_if(F.col("r") > F.col("c")).alias("n_missed"), F.count_if(F.col("top") == F.col("own")).alias("n_same_first"))


def domain_gate(domain: Column, phylum: Column, domains: list[str] | None = None) -> Column:
    return domain.isin(*(domains or ["Archaea", "Bacteria"])) & phylum.isNotNull()


def genus_band(best_identity: Column, truth: Column, low: float = 0.945, high: float = 0.987) -> Column:
    """Queries whose best hit is of their genus but no nearer, and whose truth is known."""
    return (best_identity >= low) & (best_identity < high) & (F.coalesce(truth, F.lit("")) != "")
