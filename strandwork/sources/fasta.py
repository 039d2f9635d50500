"""Sequence files: FASTA (plain or gzip) and JSON maps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SUFFIXES = (".fa", ".fasta", ".fna", ".ffn")


def _is_fasta(path: str) -> bool:
    return path.removesuffix(".gz").endswith(SUFFIXES)


def read_fasta(spark: SparkSession, path: str, first_token: bool = False) -> DataFrame:
    """(file, ordinal, header, seq) of every record.

    Plain files are split at record starts by Spark's own line reader, so one large file is many
    tasks; lines of a sequence are joined and upper-cased.
    """
    raw = spark.read.option("lineSep", "\n>").text(path).select(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("ordinal"), "value")
    record = F.regexp_replace(F.col("value"), r"^>", "")
    head = F.rtrim(F.substring_index(record, "\n", 1))
    body = F.upper(F.regexp_replace(F.substring(record, F.length(F.substring_index(record, "\n", 1)) + 1, F.length(record)), r"\s+", ""))
    name = F.regexp_extract(head, r"^(\S*)", 1) if first_token else head
    return raw.where(F.trim(record) != "").select("file", "ordinal", name.alias("header"), body.alias("seq"))


def read_json_map(spark: SparkSession, path: str) -> DataFrame:
    """(header, seq) of a file that is one JSON object of texts."""
    whole = spark.read.option("wholetext", True).text(path)
    return whole.select(F.explode(F.from_json("value", "map<string,string>")).alias("header", "seq"))


def is_json_map(spark: SparkSession, path: str) -> bool:
    """Whether a file is a JSON map: by its suffix, or else by its first character that is not white space."""
    if path.removesuffix(".gz").endswith(".json"):
        return True
    if _is_fasta(path):
        return False
    first = spark.read.text(path).select(F.ltrim("value").alias("v")).where("v <> ''").first()
    return first is not None and first["v"].startswith("{")


def read_sequences(spark: SparkSession, path: str) -> DataFrame:
    """(header, seq) of a FASTA file or a JSON map."""
    return read_json_map(spark, path) if is_json_map(spark, path) else read_fasta(spark, path).select("header", "seq")


def file_statistics(spark: SparkSession, path: str) -> DataFrame:
    """Total length and number of records of each file."""
    return read_fasta(spark, path).groupBy("file").agg(F.sum(F.length("seq")).alias("total_length"), F.count("*").alias("n_contigs"))


def fasta_line(header: Column, seq: Column, width: int = 0) -> Column:
    body = F.rtrim(F.regexp_replace(seq, f"(.{{{width}}})", "$1\n")) if width else seq
    return F.concat(F.lit(">"), header, F.lit("\n"), body)


def write_fasta(df: DataFrame, path: str, header: str, seq: str, width: int = 0) -> None:
    df.select(fasta_line(F.col(header), F.col(seq), width).alias("value")).write.mode("overwrite").text(path)
