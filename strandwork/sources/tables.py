"""Delimited and JSON inputs with declared schemas, and exports."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text

RANKS = ("Kingdom", "Phylum", "Class", "Order", "Family", "Genus", "Species")
STUDY = "seq string, " + ", ".join(f"`{r}` string" for r in RANKS) + ", rel_ab string"
ANI = "Query_file string, Ref_file string, ANI double, Align_fraction_ref double, Align_fraction_query double, Ref_name string"
DECISIONS = "user_genome string, classification string, closest_genome_reference string"


def read_study(spark: SparkSession, path: str) -> DataFrame:
    """Study taxonomy; an abundance that is empty or no number is 0."""
    return spark.read.schema(STUDY).csv(path, header=True).withColumn("rel_ab", F.coalesce(F.col("rel_ab").try_cast("double"), F.lit(0.0)))


def study_taxonomy(df: DataFrame) -> Column:
    return F.concat_ws(" ", *[F.when(~text.is_placeholder(F.col(r)), F.col(r)) for r in RANKS])


def read_ani(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(ANI).csv(path, sep="\t", header=True)


def read_reference_taxonomy(spark: SparkSession, path: str) -> DataFrame:
    """(accession, lineage) with source prefixes taken off."""
    raw = spark.read.schema("accession string, lineage string").csv(path, sep="\t")
    return raw.withColumn("accession", text.bare_accession(F.col("accession")))


def read_decisions(spark: SparkSession, path: str) -> DataFrame:
    """Classification table of assembled genomes; N/A is empty."""
    raw = spark.read.schema(DECISIONS).csv(path, sep="\t", header=True)
    return raw.withColumn("closest_genome_reference", F.when(F.col("closest_genome_reference") == "N/A", "").otherwise(F.col("closest_genome_reference")))


def read_taxdump(spark: SparkSession, nodes: str, names: str) -> DataFrame:
    """(tax_id, parent, rank, name) of the scientific names."""
    part = lambda path, cols: spark.read.option("sep", "|").csv(path).select(*[text.strip(F.col(f"_c{i}")).alias(c) for i, c in enumerate(cols)])
    n = part(nodes, ["tax_id", "parent", "rank"]).withColumns({"tax_id": F.col("tax_id").cast("long"), "parent": F.col("parent").cast("long")})
    m = part(names, ["tax_id", "name", "unique_name", "class"]).where(F.col("class") == "scientific name").select(F.col("tax_id").cast("long"), "name")
    return n.join(m, "tax_id", "left")


def merged(sources: list[DataFrame], key: str) -> DataFrame:
    """Union of tables in which a later one's row replaces an earlier one's of the same key."""
    every = sources[0].withColumn("__p", F.lit(0))
    for i, s in enumerate(sources[1:], 1):
        every = every.unionByName(s.withColumn("__p", F.lit(i)))
    w = Window.partitionBy(key).orderBy(F.desc("__p"), *[F.col(c) for c in sources[0].columns])
    return every.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r", "__p")


def genome_ids(df: DataFrame, json_col: str) -> DataFrame:
    """Distinct genome ids that occur anywhere in JSON texts, as values or keys."""
    found = F.regexp_extract_all(F.col(json_col), F.lit(r'"(\d+\.\d+)"'), F.lit(1))
    return df.select(F.explode(found).alias("genome_id")).distinct()


def export_json(df: DataFrame, path: str, key: str) -> None:
    """One JSON object per row, keyed; for export only."""
    rest = F.struct(*[c for c in df.columns if c != key])
    df.select(F.to_json(F.create_map(F.col(key).cast("string"), rest)).alias("value")).write.mode("overwrite").text(path)


def export_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def metadata_text(c: Column, length: int = 800) -> Column:
    return F.left(c, F.lit(length))


def read_rank_maps(spark: SparkSession, path: str) -> DataFrame:
    """(genome_id, lineage) from a JSON map of rank names by genome id (or id__suffix); a blank domain is taken from Domain or Kingdom."""
    raw = spark.read.option("wholetext", True).text(path).select(F.explode(F.from_json("value", "map<string,map<string,string>>")).alias("key", "ranks"))
    named = lambda *keys: F.coalesce(*[F.when(F.col("ranks")[k] != "", F.col("ranks")[k]) for k in keys], F.lit(""))
    parts = []
    for rank in ("domain", *(r.lower() for r in RANKS[1:])):
        keys = (rank.capitalize(), rank, "Kingdom") if rank == "domain" else (rank.capitalize(), rank)
        parts.append(F.concat(F.lit(f"{rank[0]}__"), named(*keys)))
    return raw.select(F.substring_index("key", "__", 1).alias("genome_id"), F.concat_ws(";", *parts).alias("lineage"))


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One record a line; lines that are no JSON of the schema are left out."""
    return spark.read.schema(schema + ", _corrupt_record string").json(path).where("_corrupt_record is null").drop("_corrupt_record")


SCORES = "src_genome_id string, region string, self_modes map<string, struct<scores: map<string, struct<cells: map<string, boolean>>>>>"


def correct_cells(records: DataFrame, predictor: str, rank: str, mode: str) -> DataFrame:
    """(unit, region, correct) from records of SCORES; a cell that is false or missing is not correct, a record without the mode or region is left out."""
    scores = F.col("self_modes")[mode]
    cell = scores["scores"][predictor]["cells"][rank]
    return records.where(scores.isNotNull() & (F.coalesce("region", F.lit("")) != "")).select(F.col("src_genome_id").alias("unit"), "region", F.coalesce(cell, F.lit(False)).alias("correct"))


def export_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def domain_map(spark: SparkSession, path: str) -> DataFrame:
    """(genome_id, domain) from a selection manifest or a flat JSON map; no rows if the file is neither."""
    one = "genomes array<struct<genome_id: string, domain: string>>"
    empty = spark.createDataFrame([], "genome_id string, domain string")
    try:
        raw = spark.read.option("wholetext", True).text(path)
        kind = raw.select(F.expr("json_object_keys(value)").alias("k")).first()["k"]
    except AnalysisException:
        return empty
    if kind is None:
        return empty
    if "genomes" in kind:
        g = raw.select(F.inline(F.from_json("value", one)["genomes"]))
    else:
        g = raw.select(F.explode(F.from_json("value", "map<string,string>")).alias("genome_id", "domain"))
    return g.where("genome_id <> '' and domain <> ''")


def amplicon_keys(spark: SparkSession, fasta_path: str, manifest: DataFrame, regions: list[str]) -> DataFrame:
    """(key) of amplicons: the headers of a FASTA file, or without one every manifest genome with every region."""
    from .fasta import read_fasta

    try:
        return read_fasta(spark, fasta_path, first_token=True).select(F.col("header").alias("key"))
    except AnalysisException:
        return manifest.select(F.explode(F.array(*[F.concat_ws("__", "genome_id", F.lit(r)) for r in regions])).alias("key"))
