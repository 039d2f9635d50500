"""Judging retrieval: recall at k, places of known items, cluster routing, and a substitute encoder."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import vector as V


def recall_at(truth: DataFrame, found: DataFrame, ks: tuple[int, ...] = (1, 5, 10, 20), top: int = 5) -> DataFrame:
    """Per k: queries, share whose first true item is among the first k found, share with all of the top true items there, mean recall of them.

    Both tables have query_id, ref_id and rank.
    """
    t = truth.where(F.col("rank") <= top).select("query_id", "ref_id", F.col("rank").alias("true_rank"))
    hit = t.join(found.select("query_id", "ref_id", F.col("rank").alias("at")), ["query_id", "ref_id"], "left")
    each = hit.select("query_id", "true_rank", "at", F.explode(F.array(*[F.lit(k) for k in ks])).alias("k")).groupBy("query_id", "k").agg(
        F.coalesce(F.bool_or((F.col("true_rank") == 1) & (F.col("at") <= F.col("k"))), F.lit(False)).alias("first"), F.count_if(F.col("at") <= F.col("k")).alias("n_in"), F.count("*").alias("n_true")
    )
    return each.groupBy("k").agg(F.count("*").alias("n"), F.avg(F.col("first").cast("int")).alias("first_found"), F.avg((F.col("n_in") == F.col("n_true")).cast("int")).alias("all_found"), (F.sum("n_in") / F.sum("n_true")).alias("recall"))


def equivalent_top(truth: DataFrame, found: DataFrame, score: str, top: int = 5) -> DataFrame:
    """Per query: whether at least `top` found items score as high as the top-th true item."""
    floor = truth.where(F.col("rank") == top).select("query_id", F.col(score).alias("floor"))
    n = found.join(floor, "query_id").groupBy("query_id").agg(F.count_if(F.col(score) >= F.col("floor")).alias("n_as_good"))
    return n.withColumn("equivalent", F.col("n_as_good") >= top)


def place_of(found: DataFrame, known: DataFrame) -> DataFrame:
    """(query_id, place): 0-based rank of each query's known item, null if it was not found."""
    return known.join(found.select("query_id", "ref_id", (F.col("rank") - 1).cast("long").alias("place")), ["query_id", "ref_id"], "left").select("query_id", "place")


def clusters(df: DataFrame, key: str, vec: str, k: int = 10, seed: int = 7) -> tuple[KMeansModel, DataFrame]:
    """A cosine k-means model, and (key, cluster) of every row."""
    v = df.select(key, array_to_vector(F.col(vec).cast("array<double>")).alias("v"))
    model = KMeans(k=k, featuresCol="v", predictionCol="cluster", distanceMeasure="cosine", seed=seed, maxIter=20).fit(v)
    return model, model.transform(v).select(key, "cluster")


def representatives(df: DataFrame, assigned: DataFrame, model: KMeansModel, key: str, vec: str) -> DataFrame:
    """(cluster, key): the member nearest to each centre."""
    centres = df.sparkSession.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())], "cluster int, centre array<double>")
    near = df.join(assigned, key).join(F.broadcast(centres), "cluster").withColumn("c", V.dot(F.col(vec), F.col("centre")))  # k rows
    return near.withColumn("r", F.row_number().over(Window.partitionBy("cluster").orderBy(F.desc("c"), key))).where("r = 1").select("cluster", key)


def routed(best: DataFrame, assigned: DataFrame, ranked_clusters: DataFrame, key: str, beams: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """Per beam width: share of queries whose best item lies in one of their first clusters.

    best: (query_id, ref_id); ranked_clusters: (query_id, cluster, rank).
    """
    home = best.join(assigned.select(F.col(key).alias("ref_id"), "cluster"), "ref_id").join(ranked_clusters, ["query_id", "cluster"], "left")
    each = home.select("query_id", "rank", F.explode(F.array(*[F.lit(b) for b in beams])).alias("beam"))
    return each.groupBy("beam").agg(F.count("*").alias("n"), F.avg(F.coalesce((F.col("rank") <= F.col("beam")).cast("int"), F.lit(0))).alias("reached"))


def encode(df: DataFrame, text: str, k: int = 6, dims: int = 256, out: str = "embedding") -> DataFrame:
    """Adds a unit vector of hashed k-mer counts: a deterministic substitute where no trained encoder is at hand."""

    @F.pandas_udf("array<float>")
    def of(texts: pd.Series) -> pd.Series:
        rows = []
        for t in texts.fillna(""):
            b = np.frombuffer(t.upper().encode(), np.uint8).astype(np.uint64)
            h = np.zeros(max(len(b) - k + 1, 0), np.uint64)
            for i in range(k if len(h) else 0):
                h = h * np.uint64(1099511628211) + b[i : i + len(h)]
            v = np.bincount((((h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(40)).astype(np.int64) % dims, minlength=dims).astype(np.float32)
            n = np.linalg.norm(v)
            rows.append(v / n if n else v)
        return pd.Series(rows)

    return df.withColumn(out, of(F.col(text)))
