"""Two-phase alignment: edit-distance candidates, then local alignment of the survivors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import kernels
from .kmer_top import stored, tfidf_top


def shared_kmers(queries: DataFrame, refs: DataFrame, query_key: str, ref_key: str, text: str, k: int = 8, n: int = 500) -> DataFrame:
    """(query_id, ref_id): each query's n best references by k-mer cosine; the optional prefilter."""
    return tfidf_top(queries, refs, query_key, ref_key, text, k, n).select("query_id", "ref_id")


def with_sequences(pairs: DataFrame, queries: DataFrame, refs: DataFrame, query_key: str, ref_key: str, text: str) -> DataFrame:
    q = queries.select(F.col(query_key).alias("query_id"), F.col(text).alias("query_seq"))
    r = refs.select(F.col(ref_key).alias("ref_id"), F.col(text).alias("ref_seq"))
    return pairs.join(q, "query_id").join(r, "ref_id")


def edit_candidates(pairs: DataFrame, k: int = 500, bound: int = -1) -> DataFrame:
    """(query_id, ref_id, edit_distance, rank): each query's k nearest references by infix edits, ties by ref_id."""

    @F.pandas_udf("int")
    def distance(q: pd.Series, r: pd.Series) -> pd.Series:
        d = kernels.compare(list(q), list(r), local=False)[0]
        return pd.Series(d if bound < 0 else np.where(d <= bound, d, -1), dtype="int32")

    d = pairs.withColumn("edit_distance", distance("query_seq", "ref_seq")).where("edit_distance >= 0")
    w = Window.partitionBy("query_id").orderBy("edit_distance", "ref_id")
    return d.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _best_scores(scored: DataFrame, k: int) -> DataFrame:
    """Ranks by score, then edit distance (null counts as 0), then ref_id."""
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), F.coalesce("edit_distance", F.lit(0)), "ref_id")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _aligned(best: DataFrame) -> DataFrame:
    kind = "score double, n_matches int, aligned_len int, identity double, ref_start int, ref_end int"

    @F.pandas_udf(kind)
    def align(q: pd.Series, r: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([kernels.local_alignment(a, b) for a, b in zip(q, r, strict=True)], columns=[c.split()[0] for c in kind.split(", ")])

    a = best.withColumn("a", align("query_seq", "ref_seq"))
    edit_identity = 1 - F.col("edit_distance") / F.greatest(F.lit(1), F.length("query_seq"))
    return a.select("query_id", "ref_id", "rank", F.col("a.score").alias("align_score"), F.col("a.identity").alias("identity"), F.col("a.n_matches").alias("n_matches"), F.col("a.aligned_len").alias("aligned_len"), "edit_distance", edit_identity.alias("edit_identity"), F.col("a.ref_start").alias("ref_start"), F.col("a.ref_end").alias("ref_end"))


def rescore(pairs: DataFrame, k: int = 20) -> DataFrame:
    """Local alignment of each pair; the k best of a query by score, then edit distance, then ref_id, with their places."""

    @F.pandas_udf("double")
    def score(q: pd.Series, r: pd.Series) -> pd.Series:
        return pd.Series(kernels.compare(list(q), list(r), edits=False)[1])

    return _aligned(_best_scores(pairs.withColumn("score", score("query_seq", "ref_seq")), k))


def search(pairs: DataFrame, queries: DataFrame, refs: DataFrame, query_key: str, ref_key: str, text: str, candidates: int = 500, k: int = 20) -> DataFrame:
    """rescore() of the edit_candidates() of pairs (query_id, ref_id).

    A reference meets its queries in one row, and only numbers are ranked; texts are looked up again for the k best. Edits of all
    pairs are counted only if a query has more pairs than candidates; else they matter for the k best and their ties alone.
    """
    pairs = stored(pairs)
    q = queries.select(F.col(query_key).alias("query_id"), F.col(text).alias("query_seq"))
    r = refs.select(F.col(ref_key).alias("ref_id"), F.col(text).alias("ref_seq")).withColumn("text_id", F.sha1(F.col("ref_seq").cast("binary")))
    edits = not pairs.groupBy("query_id").count().where(F.col("count") > candidates).isEmpty()
    rows = pairs.join(q, "query_id").groupBy("ref_id").agg(F.collect_list(F.struct("query_id", "query_seq")).alias("asked"))
    parts = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.join(r, "ref_id").repartition(parts, F.xxhash64("ref_id")).select("ref_id", "text_id", "ref_seq", "asked")
    kinds = [pairs.schema[c].dataType.simpleString() for c in ("query_id", "ref_id")]

    def compare(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if not len(f):
                continue
            at = np.repeat(np.arange(len(f)), [len(a) for a in f["asked"]])
            asked = [x for a in f["asked"] for x in a]
            texts = list(f["ref_seq"])
            d, s = kernels.compare([x["query_seq"] for x in asked], [texts[i] for i in at], edits)
            yield pd.DataFrame({"query_id": [x["query_id"] for x in asked], "ref_id": f["ref_id"].to_numpy()[at], "text_id": f["text_id"].to_numpy()[at], "edit_distance": d, "score": s})

    key = ["query_id", "ref_id", "text_id"]
    scored = rows.mapInPandas(compare, f"query_id {kinds[0]}, ref_id {kinds[1]}, text_id string, edit_distance int, score double").dropDuplicates(key)
    if edits:
        w = Window.partitionBy("query_id").orderBy("edit_distance", "ref_id")
        scored = scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= candidates).drop("rank")
    by_score = Window.partitionBy("query_id").orderBy(F.desc("score"))
    near = scored.withColumn("at", F.rank().over(by_score)).where(F.col("at") <= k).drop("at", "edit_distance")
    near = near.join(q, "query_id").join(r, ["ref_id", "text_id"]).dropDuplicates(key).repartition(parts, F.xxhash64("query_id", "ref_id"))

    @F.pandas_udf("int")
    def distance(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(kernels.compare(list(a), list(b), local=False)[0], dtype="int32")

    return _aligned(_best_scores(near.withColumn("edit_distance", distance("query_seq", "ref_seq")), k))


def exhaustive_scores(pairs: DataFrame) -> DataFrame:
    """(query_id, ref_id, align_score) of every pair."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            s = [kernels.local_score(a, b) for a, b in zip(f["query_seq"], f["ref_seq"], strict=True)]
            yield pd.DataFrame({"query_id": f["query_id"], "ref_id": f["ref_id"], "align_score": s})

    return pairs.select("query_id", "ref_id", "query_seq", "ref_seq").mapInPandas(run, "query_id long, ref_id long, align_score double")
