"""k-mer TF-IDF retrieval, rank fusion and recall."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def kmers(df: DataFrame, key: str, text: str, k: int) -> DataFrame:
    """(id, kmer, tf) of texts of at least k characters."""
    grams = F.transform(F.sequence(F.lit(1), F.length("s") - (k - 1)), lambda i: F.substring(F.col("s"), i, F.lit(k)))
    src = df.select(F.col(key).alias("id"), F.lower(F.col(text)).alias("s")).where(F.length("s") >= k)
    return src.select("id", F.explode(grams).alias("kmer")).groupBy("id", "kmer").agg(F.count("*").alias("tf"))


def tfidf_scores(queries: DataFrame, refs: DataFrame, query_key: str, ref_key: str, text: str, k: int) -> DataFrame:
    """(query_id, ref_id, cosine) of pairs with a common k-mer; idf is ln((1 + n) / (1 + df)) + 1 over refs."""
    r = kmers(refs, ref_key, text, k)
    n = refs.where(F.length(text) >= k).count()
    idf = r.groupBy("kmer").agg((F.log((1 + F.lit(n)) / (1 + F.count("*"))) + 1).alias("idf"))
    weighed = r.join(idf, "kmer").withColumn("w", F.col("tf") * F.col("idf"))
    norms = weighed.groupBy("id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    q = kmers(queries, query_key, text, k).join(idf, "kmer").withColumn("w", F.col("tf") * F.col("idf"))
    q_norms = q.groupBy("id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("q_norm"))
    dots = q.select(F.col("id").alias("query_id"), "kmer", F.col("w").alias("qw")).join(weighed.select(F.col("id").alias("ref_id"), "kmer", F.col("w").alias("rw")), "kmer")
    dots = dots.groupBy("query_id", "ref_id").agg(F.sum(F.col("qw") * F.col("rw")).alias("dot"))
    return dots.join(norms.withColumnRenamed("id", "ref_id"), "ref_id").join(q_norms.withColumnRenamed("id", "query_id"), "query_id").select("query_id", "ref_id", (F.col("dot") / (F.col("norm") * F.col("q_norm"))).alias("cosine"))


def ranked(scores: DataFrame, by: str, k: int | None = None, digits: int = 9) -> DataFrame:
    """Adds rank by score (to so many digits), then ref_id."""
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.round(by, digits)), "ref_id"))
    out = scores.withColumn("rank", rank)
    return out.where(F.col("rank") <= k) if k else out


def fuse(a: DataFrame, b: DataFrame, constant: int = 60) -> DataFrame:
    """Reciprocal rank fusion of two rankings (query_id, ref_id, rank from 1)."""
    both = a.select("query_id", "ref_id", F.col("rank").alias("ra")).join(b.select("query_id", "ref_id", F.col("rank").alias("rb")), ["query_id", "ref_id"], "full_outer")
    part = lambda c: F.coalesce(1.0 / (constant + F.col(c) - 1), F.lit(0.0))
    return both.select("query_id", "ref_id", (part("ra") + part("rb")).alias("rrf"))


def agreement_curve(a: DataFrame, b: DataFrame, cutoffs: tuple[int, ...] = (1, 5, 20, 50, 100)) -> DataFrame:
    """For each cutoff k: queries, and those of which the first of a is among the first k of b."""
    best = a.where("rank = 1").select("query_id", F.col("ref_id").alias("best"))
    hit = best.join(b.select("query_id", F.col("ref_id").alias("best"), F.col("rank").alias("at")), ["query_id", "best"], "left")
    ks = F.explode(F.array(*[F.lit(c) for c in cutoffs])).alias("k")
    return hit.select("query_id", "at", ks).groupBy("k").agg(F.count("*").alias("n"), F.count_if(F.col("at") <= F.col("k")).alias("n_found"))
