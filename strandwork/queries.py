"""Registered queries of the engine's own operators over the synthetic tables, each with its SQL.

The tables stand for the engine's data: embeddings for a vector store, documents for sequences,
orders and lineitem for queries and their hits, part for lineages, (supplier, part) for gene sets.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .functions import stats, text
from .operators import align, dedup, genes, hits, kmer, kmer_top, knn, lineage, pcr, scoring, select

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# Vector search and geometry

_COS = "list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[])"
_NN = f"""WITH s AS (SELECT a.vec_id AS query_id, b.vec_id AS ref_id, {_COS} AS cosine, a.label = b.label AS same_label
  FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id),
r AS (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, ref_id))::INTEGER AS rank FROM s)
"""


def _neighbours(spark: SparkSession, sf: str, k: int, least: float | None = None) -> DataFrame:
    v = t(spark, sf, "embeddings")
    return knn.with_labels(knn.top_k(v, v, "vec_id", "embedding", k, least=least), v, "vec_id", "label")


@query(_NN + "SELECT query_id, rank, ref_id, cosine, same_label FROM r WHERE rank <= 10")
def knn_cosine_top10(spark, sf):
    return _neighbours(spark, sf, 10).select("query_id", "rank", "ref_id", "cosine", "same_label")


@query(_NN + "SELECT query_id, rank, ref_id, cosine FROM r WHERE rank <= 20 AND cosine >= 0.3")
def knn_min_sim(spark, sf):
    return _neighbours(spark, sf, 20, 0.3).select("query_id", "rank", "ref_id", "cosine")


@query(_NN + """, n AS (SELECT cosine AS c FROM r WHERE rank = 1)
SELECT count(*) AS n, round(avg(c), 9) AS mean, quantile_cont(c, 0.05) AS p5, quantile_cont(c, 0.5) AS median, quantile_cont(c, 0.95) AS p95,
  min(c) AS low, max(c) AS high, count(*) FILTER (c < 0.3) AS n_isolated FROM n""")
def knn_nn1_stats(spark, sf):
    c = F.col("cosine")
    p = lambda q: F.percentile(c, F.lit(q))
    return _neighbours(spark, sf, 1).agg(F.count("*").alias("n"), F.round(F.avg(c), 9).alias("mean"), p(0.05).alias("p5"), p(0.5).alias("median"), p(0.95).alias("p95"), F.min(c).alias("low"), F.max(c).alias("high"), F.count_if(c < 0.3).alias("n_isolated"))


@query(f"""WITH s AS (SELECT a.vec_id AS query_id, {_COS} AS c FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id)
SELECT query_id, count(*) FILTER (c >= 0.4) AS within_0, count(*) FILTER (c >= 0.3) AS within_1, count(*) FILTER (c >= 0.2) AS within_2, count(*) FILTER (c >= 0.0) AS within_3 FROM s GROUP BY query_id""")
def knn_radius_counts(spark, sf):
    return knn.radius_counts(t(spark, sf, "embeddings"), "vec_id", "embedding", [0.4, 0.3, 0.2, 0.0])


@query(_NN + "SELECT query_id, avg(same_label::INT) AS purity FROM r WHERE rank <= 10 GROUP BY query_id")
def knn_label_purity(spark, sf):
    return _neighbours(spark, sf, 10).groupBy("query_id").agg(knn.purity(F.col("same_label")).alias("purity"))


@query(_NN + """SELECT e.label AS stratum, count(*) AS n, quantile_cont(cosine, 0.5) AS median_nn1, count(*) FILTER (same_label) AS n_same
FROM r JOIN embeddings e ON e.vec_id = r.query_id WHERE rank = 1 GROUP BY e.label""")
def knn_strata(spark, sf):
    return _neighbours(spark, sf, 1).groupBy(F.col("query_label").alias("stratum")).agg(F.count("*").alias("n"), F.percentile("cosine", F.lit(0.5)).alias("median_nn1"), F.count_if("same_label").alias("n_same"))


@query(f"""WITH s AS (SELECT a.vec_id AS query_id, b.vec_id AS ref_id, {_COS} AS cosine FROM embeddings a JOIN embeddings b ON a.label < 5 AND b.label >= 5),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, ref_id) AS k FROM s) SELECT query_id, ref_id, cosine FROM r WHERE k = 1""")
def knn_cross_best(spark, sf):
    v = t(spark, sf, "embeddings")
    return knn.top_k(v.where("label < 5"), v.where("label >= 5"), "vec_id", "embedding", 1).select("query_id", "ref_id", "cosine")


@query(_NN + """, d AS (SELECT query_id, max(CASE WHEN rank = 1 THEN sqrt(greatest(0.0, 2.0 - 2.0 * cosine)) END) AS r1, max(CASE WHEN rank = 2 THEN sqrt(greatest(0.0, 2.0 - 2.0 * cosine)) END) AS r2
  FROM r WHERE rank <= 2 GROUP BY query_id),
m AS (SELECT query_id, r2 / greatest(r1, 1e-9) AS mu FROM d), k AS (SELECT *, count(*) OVER () AS n, row_number() OVER (ORDER BY mu, query_id) AS pos FROM m WHERE mu > 1 + 1e-9)
SELECT count(*) AS n_used, round(count(*) / sum(ln(mu)), 6) AS dimension FROM k WHERE pos <= floor(n * 0.95)""")
def twonn_dim(spark, sf):
    return knn.two_nn(_neighbours(spark, sf, 2)).select("n_used", F.round("dimension", 6).alias("dimension"))


@query(f"""WITH n AS (SELECT max(vec_id) + 1 AS n FROM embeddings), s AS (SELECT a.vec_id AS a_id, b.vec_id AS b_id, {_COS} AS c FROM embeddings a, n JOIN embeddings b ON b.vec_id = (a.vec_id * 7919 + 13) % n.n AND a.vec_id <> b.vec_id)
SELECT count(*) AS n, quantile_cont(c, 0.5) AS median, min(c) AS low, max(c) AS high FROM s""")
def pair_sample_stats(spark, sf):
    v = t(spark, sf, "embeddings")
    n = v.agg((F.max("vec_id") + 1).alias("n"))
    a = v.join(F.broadcast(n)).select(F.col("vec_id").alias("a_id"), F.col("embedding").alias("a"), ((F.col("vec_id") * 7919 + 13) % F.col("n")).alias("b_id"))
    s = a.join(v.select(F.col("vec_id").alias("b_id"), F.col("embedding").alias("b")), "b_id").where("a_id <> b_id").withColumn("c", knn.cosine(F.col("a"), F.col("b")))
    return s.agg(F.count("*").alias("n"), F.percentile("c", F.lit(0.5)).alias("median"), F.min("c").alias("low"), F.max("c").alias("high"))


@query()
def pca_spectrum(spark, sf):
    return knn.spectrum(t(spark, sf, "embeddings"), "embedding")


# Deduplication and sequence statistics

_CLEAN = r"translate(regexp_replace(text, '^\s+|\s+$', '', 'g'), 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ')"
_KEYED = f"WITH k AS (SELECT *, md5({_CLEAN}) AS md5, length({_CLEAN}) AS seq_len FROM documents WHERE length({_CLEAN}) >= 20)\n"


@query(_KEYED + """SELECT md5, min(doc_id) AS first_order, min(seq_len)::BIGINT AS seq_len, count(*) AS multiplicity, count(DISTINCT source) AS n_genomes, min(seq_len) > 2000 OR min(seq_len) < 200 AS atypical_len,
  arg_min(lang, doc_id) AS lang, arg_min(source, doc_id) AS source FROM k GROUP BY md5""")
def dedup_index(spark, sf):
    out = dedup.index(t(spark, sf, "documents"), "text", "doc_id", "source", ["lang", "source"])
    return out.withColumn("seq_len", F.col("seq_len").cast("long"))


@query(_KEYED + "SELECT doc_id, min(doc_id) OVER (PARTITION BY md5) AS row_id, seq_len::BIGINT AS seq_len FROM k")
def dedup_members(spark, sf):
    return dedup.members(t(spark, sf, "documents"), "text", "doc_id", "doc_id").withColumn("seq_len", F.col("seq_len").cast("long"))


@query(_KEYED + "SELECT md5, list_sort(list(doc_id)) AS keys FROM k GROUP BY md5")
def dedup_member_lists(spark, sf):
    return dedup.member_lists(t(spark, sf, "documents"), "text", "doc_id", "doc_id")


@query(_KEYED + """, m AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY md5) AS row_id FROM k)
SELECT m.doc_id, l.doc_id AS row_id, l.quality FROM labels l JOIN m ON m.row_id = l.doc_id""")
def fanout(spark, sf):
    m = dedup.members(t(spark, sf, "documents"), "text", "doc_id", "doc_id")
    return dedup.fan_out(t(spark, sf, "labels").select(F.col("doc_id").alias("row_id"), "quality"), m, "row_id").select("doc_id", "row_id", "quality")


@query(_KEYED + """, m AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY md5) AS row_id FROM k)
SELECT count(*) AS n_missing FROM m WHERE row_id NOT IN (SELECT doc_id FROM labels)""")
def fanout_missing(spark, sf):
    m = dedup.members(t(spark, sf, "documents"), "text", "doc_id", "doc_id")
    return dedup.not_fanned(m, t(spark, sf, "labels").select(F.col("doc_id").alias("row_id")), "row_id").agg(F.count("*").alias("n_missing"))


@query("""SELECT lang, count(*) AS n, round(avg(n_chars::DOUBLE), 6) AS mean, round(stddev_pop(n_chars::DOUBLE), 6) AS std, round(quantile_cont(n_chars::DOUBLE, 0.01), 6) AS p1, round(quantile_cont(n_chars::DOUBLE, 0.99), 6) AS p99, round(quantile_cont(n_chars::DOUBLE, 0.05), 6) AS p5, round(quantile_cont(n_chars::DOUBLE, 0.25), 6) AS p25, round(quantile_cont(n_chars::DOUBLE, 0.5), 6) AS median,
  round(quantile_cont(n_chars::DOUBLE, 0.75), 6) AS p75, round(quantile_cont(n_chars::DOUBLE, 0.95), 6) AS p95, min(n_chars) AS low, max(n_chars) AS high FROM documents GROUP BY lang""")
def seq_stats(spark, sf):
    x = F.col("n_chars").cast("double")
    p = lambda q: F.round(F.percentile(x, F.lit(q)), 6)
    return t(spark, sf, "documents").groupBy("lang").agg(F.count("*").alias("n"), F.round(F.avg(x), 6).alias("mean"), F.round(F.stddev_pop(x), 6).alias("std"), p(0.01).alias("p1"), p(0.99).alias("p99"), p(0.05).alias("p5"), p(0.25).alias("p25"), p(0.5).alias("median"), p(0.75).alias("p75"), p(0.95).alias("p95"), F.min("n_chars").alias("low"), F.max("n_chars").alias("high"))


@query("SELECT doc_id, n_chars, n_chars > 2000 OR n_chars < 200 AS atypical FROM documents WHERE n_chars BETWEEN 100 AND 3000")
def length_filter(spark, sf):
    d = dedup.length_range(t(spark, sf, "documents"), "n_chars", 100, 3000)
    return d.select("doc_id", "n_chars", dedup.atypical(F.col("n_chars")).alias("atypical"))


@query("""WITH a AS (SELECT source, list_sort(list(n_chars)) AS x FROM documents GROUP BY source)
SELECT source, x[1 + round_even(0.05 * (len(x) - 1), 0)::BIGINT] AS p5, x[1 + round_even(0.95 * (len(x) - 1), 0)::BIGINT] AS p95, trunc(list_aggregate(x, 'quantile_cont', 0.5))::BIGINT AS int_median FROM a""")
def nearest_rank(spark, sf):
    x = F.sort_array(F.collect_list("n_chars"))
    at = lambda p: F.element_at(F.col("x"), (1 + F.bround(p * (F.size("x") - 1), 0)).cast("int"))
    d = t(spark, sf, "documents").groupBy("source").agg(x.alias("x"), F.percentile(F.col("n_chars").cast("double"), F.lit(0.5)).cast("long").alias("int_median"))
    return d.select("source", at(0.05).alias("p5"), at(0.95).alias("p95"), "int_median")


@query("SELECT toxic, avg((d.n_chars < 500)::INT) AS share_short, sum(d.n_chars)::BIGINT / greatest(count(*), 1) AS mean_chars FROM labels l LEFT JOIN documents d USING (doc_id) GROUP BY toxic")
def predicate_rates(spark, sf):
    d = t(spark, sf, "labels").join(t(spark, sf, "documents"), "doc_id", "left")
    return d.groupBy("toxic").agg(F.avg((F.col("n_chars") < 500).cast("int")).alias("share_short"), (F.sum("n_chars") / F.greatest(F.count("*"), F.lit(1))).alias("mean_chars"))


# Headers, names, sequences

_HEAD = "'fig|' || page_id || '.' || (page_id % 7) || '.rna.1|x| Organism ' || (page_id % 5) || ' [Genus species ' || (page_id % 3) || ' | ' || page_id || '.' || (page_id % 7) || ']'"


def _headers(spark: SparkSession, sf: str) -> DataFrame:
    p = F.col("page_id")
    h = F.concat(F.lit("fig|"), p, F.lit("."), p % 7, F.lit(".rna.1|x| Organism "), p % 5, F.lit(" [Genus species "), p % 3, F.lit(" | "), p, F.lit("."), p % 7, F.lit("]"))
    return t(spark, sf, "pages").select("page_id", h.alias("h"))


@query(f"""WITH p AS (SELECT page_id, {_HEAD} AS h FROM pages)
SELECT page_id, split_part(h, '|', 2) AS feature_id, 'Genus species ' || (page_id % 3) AS organism, page_id || '.' || (page_id % 7) AS genome_id, page_id AS taxon_id, 'fig|' || page_id || '.' || (page_id % 7) || '.rna.1' AS header_genome, 'Unknown' AS domain FROM p""")
def header_parse(spark, sf):
    h = F.col("h")
    a, b = text.header_fields(h), text.strict_header_fields(h)
    return _headers(spark, sf).select("page_id", b["feature_id"].alias("feature_id"), a["organism"].alias("organism"), F.coalesce(b["genome_id"], a["genome_id"]).alias("genome_id"), b["taxon_id"].alias("taxon_id"), text.genome_of_header(h).alias("header_genome"), text.domain_of_header(h).alias("domain"))


@query(r"""WITH n AS (SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'Candidatus ' || p_name WHEN 1 THEN 'uncultured ' || p_name WHEN 2 THEN 'midas_g_' || p_partkey WHEN 3 THEN 'Genus ' || lower(p_type) WHEN 4 THEN 'Bacillota' ELSE '' END AS s FROM part)
SELECT p_partkey, lower(regexp_replace(trim(s), '(?i)^(Candidatus\s+|Ca[._]\s*|midas_[a-z]_)\s*', '')) AS name,
  CASE WHEN lower(s) = 'bacillota' THEN 'firmicutes' ELSE lower(trim(s)) END AS phylum, s = '' OR lower(s) LIKE 'midas%' OR lower(s) LIKE 'unclassified%' AS placeholder,
  regexp_matches(s, '(?i)uncultured|metagenome|environmental sample|unidentified|unclassified|^\s*$') AS uncultured,
  regexp_matches(s, '^[A-Z][a-z]+ [a-z]{3,}$') AND NOT contains(lower(s), 'bacterium') AS named, s = '' OR contains(lower(s), 'sp.') OR contains(lower(s), 'bacterium') AS unnamed FROM n""")
def name_rules(spark, sf):
    k = F.col("p_partkey")
    s = F.when(k % 6 == 0, F.concat(F.lit("Candidatus "), "p_name")).when(k % 6 == 1, F.concat(F.lit("uncultured "), "p_name")).when(k % 6 == 2, F.concat(F.lit("midas_g_"), k)).when(k % 6 == 3, F.concat(F.lit("Genus "), F.lower("p_type"))).when(k % 6 == 4, "Bacillota").otherwise("")
    d = t(spark, sf, "part").select("p_partkey", s.alias("s"))
    c = F.col("s")
    return d.select("p_partkey", text.normal_name(c).alias("name"), text.normal_phylum(c).alias("phylum"), text.is_placeholder(c).alias("placeholder"), text.is_uncultured(c).alias("uncultured"), text.is_named(c).alias("named"), text.is_unnamed(c).alias("unnamed"))


@query("SELECT p_partkey, list_filter(string_split_regex(lower(p_name), '\\s+'), lambda w: w <> '' AND w NOT IN ('candidatus', 'uncultured', 'unclassified'))[1] AS genus FROM part")
def genus_token(spark, sf):
    return t(spark, sf, "part").select("p_partkey", text.genus_of(F.col("p_name")).alias("genus"))


@query(f"""WITH c AS (SELECT doc_id, {_CLEAN} AS s FROM documents)
SELECT doc_id, md5(reverse(translate(s, 'ACGTRYSWKMBDHVN', 'TGCAYRSWMKVHDBN'))) AS digest FROM c""")
def revcomp(spark, sf):
    s = text.clean_sequence(F.col("text"))
    return t(spark, sf, "documents").select("doc_id", F.md5(text.reverse_complement(s).cast("binary")).alias("digest"))


@query(f"""WITH c AS (SELECT doc_id, {_CLEAN} AS s FROM documents), f AS (SELECT doc_id, s, regexp_extract(s, 'TH[AE]') AS hit FROM c),
g AS (SELECT doc_id, s, instr(s, hit) AS pos, substr(s, instr(s, hit) + 3) AS rest FROM f WHERE hit <> ''),
e AS (SELECT doc_id, pos, rest, instr(rest, 'AND') AS stop FROM g)
SELECT doc_id, pos::BIGINT AS "at", (stop - 1)::BIGINT AS insert_length, md5(substr(rest, 1, (stop - 1)::BIGINT)) AS insert_md5 FROM e WHERE stop > 0 AND stop - 1 BETWEEN 5 AND 400""")
def pcr_exact(spark, sf):
    d = t(spark, sf, "documents").select("doc_id", text.clean_sequence(F.col("text")).alias("s"))
    out = pcr.exact_inserts(d, "s", "TH[AE]", "AND", 5, 400)
    return out.select("doc_id", "at", F.length("insert").cast("long").alias("insert_length"), F.md5(F.col("insert").cast("binary")).alias("insert_md5"))


def _plain(primer: str, changed: int = 0) -> str:
    """One sequence that a degenerate primer fits, with so many letters changed."""
    letters = list(primer.translate(str.maketrans("RYSWKMBDHVN", "ACCAGACAAAA")))
    for at in (3, 8, 11, 13)[:changed]:
        letters[at] = letters[at].translate(str.maketrans("ACGT", "CATG"))
    return "".join(letters)


_FORWARD = [_plain(r.forward, n) for r in pcr.PANEL for n in range(5)]
_REVERSE = [_plain(text.reversed_primer(r.reverse)) for r in pcr.PANEL]


def strands(spark: SparkSession, sf: str) -> DataFrame:
    """(doc_id, seq): for every document a sequence of pseudo-random bases that holds the primers of one region, with 0 to 4 letters changed in the
    forward one, an insert whose length may be out of bounds, and every third sequence on the reverse strand."""
    k, regions = F.col("doc_id"), len(pcr.PANEL)
    pick = lambda values, at: F.element_at(F.array(*[F.lit(v) for v in values]), (at + 1).cast("int"))
    dna = F.translate(F.concat(*[F.md5(F.concat_ws("-", k, F.lit(i)).cast("binary")) for i in range(52)]), "0123456789abcdef", "ACGTACGTACGTACGT")
    size = pick([r.low for r in pcr.PANEL], k % regions) + k * 37 % (pick([r.high - r.low for r in pcr.PANEL], k % regions) + 40)
    d = t(spark, sf, "documents").select("doc_id", dna.alias("dna"), pick(_FORWARD, k % regions * 5 + k % 5).alias("f"), pick(_REVERSE, k % regions).alias("r"), size.cast("int").alias("size"))
    s = F.concat(F.substring("dna", 1, 40), F.col("f"), F.substring(F.col("dna"), F.lit(41), F.col("size")), F.col("r"), F.substring("dna", 1601, 30))
    return d.select("doc_id", s.alias("s")).select("doc_id", F.when(k % 3 == 0, text.reverse_complement(F.col("s"))).otherwise(F.col("s")).alias("seq"))


_N = len(pcr.PANEL)
_STRANDS = (
    "WITH d AS (SELECT doc_id, translate(array_to_string([md5(doc_id || '-' || i) FOR i IN range(0, 52)], ''), '0123456789abcdef', 'ACGTACGTACGTACGT') AS dna, "
    f"{_FORWARD}[doc_id % {_N} * 5 + doc_id % 5 + 1] AS f, {_REVERSE}[doc_id % {_N} + 1] AS r, {[r.low for r in pcr.PANEL]}[doc_id % {_N} + 1] + doc_id * 37 % ({[r.high - r.low for r in pcr.PANEL]}[doc_id % {_N} + 1] + 40) AS size FROM documents),\n"
    "w AS (SELECT doc_id, substr(dna, 1, 40) || f || substr(dna, 41, size::BIGINT) || r || substr(dna, 1601, 30) AS s FROM d),\n"
    "z AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN reverse(translate(s, 'ACGT', 'TGCA')) ELSE s END AS seq FROM w),\n"
    "b AS (SELECT doc_id, '+' AS strand, seq FROM z UNION ALL SELECT doc_id, '-', reverse(translate(seq, 'ACGT', 'TGCA')) FROM z),\n"
    "p(region, f, r, low, high) AS (VALUES " + ", ".join(f"('{r.name}', '{text.primer_pattern(r.forward)}', '{text.primer_pattern(text.reversed_primer(r.reverse))}', {r.low}, {r.high})" for r in pcr.PANEL) + "),\n"
    "h AS (SELECT doc_id, region, strand, regexp_extract(seq, f || '.*?' || r) AS amplicon, length(regexp_extract(seq, f)) + length(regexp_extract(seq, r)) AS primers, low, high FROM b, p),\n"
    "i AS (SELECT *, row_number() OVER (PARTITION BY doc_id, region ORDER BY strand) AS k FROM h WHERE amplicon <> '' AND length(amplicon) - primers BETWEEN low AND high)\n"
)


@query(_STRANDS + "SELECT doc_id, region, strand, length(amplicon)::BIGINT AS amplicon_length, md5(amplicon) AS amplicon_md5 FROM i WHERE k = 1")
def pcr_panel_exact(spark, sf):
    out = pcr.amplicons(strands(spark, sf), "doc_id", "seq", edits=0)
    return out.select(F.col("key").alias("doc_id"), "region", "strand", F.length("amplicon").cast("long").alias("amplicon_length"), F.md5(F.col("amplicon").cast("binary")).alias("amplicon_md5"))


@query()
def pcr_panel(spark, sf):
    """The whole panel with up to three edits a primer."""
    out = pcr.amplicons(strands(spark, sf), "doc_id", "seq")
    return out.select(F.col("key").alias("doc_id"), "region", "strand", "fwd_edits", "rev_edits", F.length("amplicon").cast("long").alias("amplicon_length"), F.md5(F.col("amplicon").cast("binary")).alias("amplicon_md5"))


@query()
def pcr_fuzzy(spark, sf):
    """Short primers with one edit over whole texts."""
    panel = (pcr.Region("short", "CATAT", "TAATC", 5, 4000),)
    return pcr.amplicons(t(spark, sf, "documents"), "doc_id", "text", panel, edits=1).withColumnRenamed("key", "doc_id")


@query(r"""SELECT page_id, CASE WHEN regexp_extract(url, '(GC[AF]_\d+\.\d+)', 1) <> '' THEN regexp_extract(url, '(GC[AF]_\d+\.\d+)', 1) ELSE regexp_replace(split_part(url, '/', -1), '\.(fna|fasta|fa)(\.gz)?$', '') END AS accession FROM pages""")
def reference_ids(spark, sf):
    return t(spark, sf, "pages").select("page_id", text.accession(F.col("url")).alias("accession"))


@query("""SELECT s_suppkey, n.n_name AS g, r.r_name AS d FROM supplier JOIN nation n ON s_nationkey = n_nationkey JOIN region r ON n_regionkey = r_regionkey""")
def lineage_split(spark, sf):
    s = t(spark, sf, "supplier").join(t(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(t(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    line = F.concat(F.lit("d__"), "r_name", F.lit(";p__;g__"), "n_name")
    return s.select("s_suppkey", text.lineage_rank(line, "g").alias("g"), text.lineage_rank(line, "d").alias("d"))


@query("""SELECT l_orderkey || '__' || l_partkey || '__' || l_linenumber AS k, l_orderkey::VARCHAR AS head, l_orderkey || '__' || l_partkey AS head_last, l_linenumber::VARCHAR AS tail_last, l_orderkey AS strict_taxon FROM lineitem""")
def key_split(spark, sf):
    k = F.concat_ws("__", "l_orderkey", "l_partkey", "l_linenumber")
    d = t(spark, sf, "lineitem").select(k.alias("k"), F.concat_ws(".", "l_orderkey", "l_partkey").alias("g"))
    return d.select("k", text.key_head(F.col("k")).alias("head"), text.key_head(F.col("k"), True).alias("head_last"), text.key_tail(F.col("k"), True).alias("tail_last"), text.taxon_of_genome(F.col("g")).alias("strict_taxon"))


@query("SELECT event_id, (props::JSON->>'$.k')::BIGINT AS k FROM events")
def json_path(spark, sf):
    return t(spark, sf, "events").select("event_id", text.json_number(F.col("props"), "$.k").alias("k"))


@query("""SELECT c_custkey, a.name AS name, a.value AS value FROM (SELECT c_custkey, unnest(list_filter([{'name': 'name', 'value': c_name}, {'name': 'segment', 'value': CASE WHEN c_custkey % 3 = 0 THEN '' ELSE c_mktsegment END}, {'name': 'nation', 'value': CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE c_nationkey::VARCHAR END}], lambda x: x.value IS NOT NULL AND x.value <> '')) AS a FROM customer)""")
def alias_build(spark, sf):
    k = F.col("c_custkey")
    a = t(spark, sf, "customer").select("c_custkey", F.explode(text.aliases({"name": F.col("c_name"), "segment": F.when(k % 3 == 0, "").otherwise(F.col("c_mktsegment")), "nation": F.when(k % 4 != 0, F.col("c_nationkey"))})).alias("a"))
    return a.select("c_custkey", "a.name", "a.value")


@query("""SELECT user_id, t.event_type, (t.pos - 1)::BIGINT AS position FROM (SELECT user_id, unnest(list_distinct_sorted) AS event_type, unnest(range(1, len(list_distinct_sorted) + 1)) AS pos
FROM (SELECT user_id, list_sort(list(DISTINCT event_type)) AS list_distinct_sorted FROM events GROUP BY user_id)) t""")
def ontology_map(spark, sf):
    u = t(spark, sf, "events").groupBy("user_id").agg(F.sort_array(F.collect_set("event_type")).alias("x"))
    m = u.select("user_id", text.ontology_terms(F.create_map(F.lit("events"), "x")).alias("m"))
    e = m.select("user_id", F.explode(F.col("m")["events"]).alias("event_type", "at"))
    return e.select("user_id", "event_type", F.element_at("at", 1).cast("long").alias("position"))


@query("""WITH RECURSIVE nodes AS (SELECT r_regionkey::BIGINT AS tax_id, NULL::BIGINT AS parent, 'domain' AS rank, r_name AS name FROM region UNION ALL SELECT 100 + n_nationkey, n_regionkey, 'phylum', n_name FROM nation UNION ALL SELECT 1000 + c_custkey, 100 + c_nationkey, 'species', c_name FROM customer),
up AS (SELECT tax_id, 0 AS depth, tax_id AS ancestor FROM nodes UNION ALL SELECT u.tax_id, u.depth + 1, n.parent FROM up u JOIN nodes n ON n.tax_id = u.ancestor WHERE n.parent IS NOT NULL)
SELECT u.tax_id, max(CASE WHEN n.rank = 'domain' THEN n.name END) AS domain, max(CASE WHEN n.rank = 'phylum' THEN n.name END) AS phylum, max(CASE WHEN n.rank = 'species' THEN n.name END) AS species FROM up u JOIN nodes n ON n.tax_id = u.ancestor GROUP BY u.tax_id""")
def lineage_resolve(spark, sf):
    r = t(spark, sf, "region").select(F.col("r_regionkey").cast("long").alias("tax_id"), F.lit(None).cast("long").alias("parent"), F.lit("domain").alias("rank"), F.col("r_name").alias("name"))
    n = t(spark, sf, "nation").select((100 + F.col("n_nationkey")).cast("long").alias("tax_id"), F.col("n_regionkey").cast("long").alias("parent"), F.lit("phylum").alias("rank"), F.col("n_name").alias("name"))
    c = t(spark, sf, "customer").select((1000 + F.col("c_custkey")).alias("tax_id"), (100 + F.col("c_nationkey")).cast("long").alias("parent"), F.lit("species").alias("rank"), F.col("c_name").alias("name"))
    return lineage.ranks(lineage.resolve(r.unionByName(n).unionByName(c)), ["domain", "phylum", "species"])


@query("""SELECT c_custkey, d, CASE WHEN p <> '' THEN p ELSE 'unclassified_domain:' || d END AS p, CASE WHEN s <> '' THEN s ELSE 'sp_taxon_' || c_custkey END AS s
FROM (SELECT c_custkey, r_name AS d, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE n_name END AS p, CASE WHEN c_custkey % 2 = 0 THEN '' ELSE c_name END AS s FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)""")
def lineage_fill(spark, sf):
    c = t(spark, sf, "customer").join(t(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    k = F.col("c_custkey")
    d, p, s = lineage.filled([("domain", F.col("r_name")), ("phylum", F.when(k % 3 == 0, "").otherwise(F.col("n_name"))), ("species", F.when(k % 2 == 0, "").otherwise(F.col("c_name")))], k)
    return c.select("c_custkey", d.alias("d"), p.alias("p"), s.alias("s"))


# k-mer retrieval and fusion

_TFIDF = """WITH r0 AS (SELECT doc_id AS id, lower(text) AS s FROM documents WHERE length(text) >= 8), q0 AS (SELECT item_id AS id, lower(text) AS s FROM benchmark WHERE length(text) >= 8),
r AS (SELECT id, kmer, count(*) AS tf FROM (SELECT id, substr(s, unnest(range(1, length(s) - 6)), 8) AS kmer FROM r0) GROUP BY id, kmer),
n AS (SELECT count(*) AS n FROM r0), i AS (SELECT kmer, ln((1 + n) / (1 + count(*))) + 1 AS idf FROM r, n GROUP BY kmer, n),
w AS (SELECT id, r.kmer, tf * idf AS w FROM r JOIN i ON r.kmer = i.kmer), wn AS (SELECT id, sqrt(sum(w * w)) AS norm FROM w GROUP BY id),
q AS (SELECT id, q1.kmer, tf * idf AS w FROM (SELECT id, kmer, count(*) AS tf FROM (SELECT id, substr(s, unnest(range(1, length(s) - 6)), 8) AS kmer FROM q0) GROUP BY id, kmer) q1 JOIN i ON q1.kmer = i.kmer), qn AS (SELECT id, sqrt(sum(w * w)) AS norm FROM q GROUP BY id),
d AS (SELECT q.id AS query_id, w.id AS ref_id, sum(q.w * w.w) AS dot FROM q JOIN w ON q.kmer = w.kmer GROUP BY q.id, w.id),
s AS (SELECT query_id, ref_id, round(dot / (wn.norm * qn.norm), 9) AS cosine FROM d JOIN wn ON wn.id = ref_id JOIN qn ON qn.id = query_id),
k AS (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, ref_id))::INTEGER AS rank FROM s)
"""


def _tfidf(spark: SparkSession, sf: str) -> DataFrame:
    return kmer_top.tfidf_top(t(spark, sf, "benchmark"), t(spark, sf, "documents"), "item_id", "doc_id", "text", 8, 10)


@query(_TFIDF + "SELECT query_id, ref_id, rank, cosine FROM k WHERE rank <= 10")
def kmer_tfidf_top10(spark, sf):
    return _tfidf(spark, sf).select("query_id", "ref_id", "rank", "cosine")


_TWO = """WITH a AS (SELECT l_orderkey AS query_id, l_partkey AS ref_id, (row_number() OVER (PARTITION BY l_orderkey ORDER BY max(l_extendedprice) DESC, l_partkey))::INTEGER AS rank FROM lineitem GROUP BY l_orderkey, l_partkey),
b AS (SELECT l_orderkey AS query_id, l_partkey AS ref_id, (row_number() OVER (PARTITION BY l_orderkey ORDER BY max(l_quantity) DESC, l_partkey))::INTEGER AS rank FROM lineitem GROUP BY l_orderkey, l_partkey)
"""


def _two(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    g = t(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("query_id"), F.col("l_partkey").alias("ref_id")).agg(F.max("l_extendedprice").alias("x"), F.max("l_quantity").alias("y"))
    return tuple(hits.ranked(g, "query_id", [F.desc(c), F.col("ref_id")]).select("query_id", "ref_id", "rank") for c in ("x", "y"))


@query(_TWO + """SELECT coalesce(a.query_id, b.query_id) AS query_id, coalesce(a.ref_id, b.ref_id) AS ref_id, coalesce(1.0::DOUBLE / (60 + a.rank - 1), 0) + coalesce(1.0::DOUBLE / (60 + b.rank - 1), 0) AS rrf
FROM a FULL JOIN b ON a.query_id = b.query_id AND a.ref_id = b.ref_id""")
def rrf_fuse(spark, sf):
    return kmer.fuse(*_two(spark, sf))


@query(_TWO + """SELECT k.k::INTEGER AS k, count(*) AS n, count(*) FILTER (b.rank <= k.k) AS n_found FROM a JOIN b ON a.query_id = b.query_id AND a.ref_id = b.ref_id, (VALUES (1), (5), (20), (50), (100)) k(k) WHERE a.rank = 1 GROUP BY k.k""")
def agree_curve(spark, sf):
    return kmer.agreement_curve(*_two(spark, sf))


@query(_TWO + """SELECT coalesce(a.query_id, b.query_id) AS query_id, count(a.rank) AS n_a, count(b.rank) AS n_b, count(*) FILTER (a.rank IS NOT NULL AND b.rank IS NOT NULL) AS n_both,
  coalesce(bool_or(a.rank = 1 AND b.rank = 1), false) AS same_first, count(*) FILTER (a.rank IS NOT NULL AND b.rank IS NOT NULL)::DOUBLE / count(*) AS jaccard, count(*) FILTER (a.rank IS NOT NULL AND b.rank IS NOT NULL) = count(*) AS identical
FROM (SELECT * FROM a WHERE rank <= 3) a FULL JOIN (SELECT * FROM b WHERE rank <= 3) b ON a.query_id = b.query_id AND a.ref_id = b.ref_id GROUP BY 1""")
def agreement_two_runs(spark, sf):
    a, b = _two(spark, sf)
    return hits.compare_runs(a.where("rank <= 3"), b.where("rank <= 3"), "query_id", "ref_id")


@query("""WITH p AS (SELECT DISTINCT p_name FROM part), s AS (SELECT n_name, p_name, levenshtein(lower(n_name), lower(p_name))::INTEGER AS d FROM nation, p),
r AS (SELECT *, (row_number() OVER (PARTITION BY n_name ORDER BY d, p_name))::INTEGER AS rank FROM s) SELECT n_name, p_name, d, rank FROM r WHERE rank <= 5""")
def edit_global_top5(spark, sf):
    names = t(spark, sf, "part").select("p_name").distinct()
    s = names.join(F.broadcast(t(spark, sf, "nation").select("n_name"))).withColumn("d", F.levenshtein(F.lower("n_name"), F.lower("p_name")))  # the 25 nations are the queries
    return hits.ranked(s, "n_name", [F.col("d"), F.col("p_name")], 5)


def _name_pairs(spark: SparkSession, sf: str) -> DataFrame:
    refs = t(spark, sf, "part").groupBy(F.lower("p_name").alias("ref_seq")).agg(F.min("p_partkey").alias("ref_id"))
    q = t(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("query_id"), F.lower("n_name").alias("query_seq"))
    return refs.join(F.broadcast(q))  # the 25 nations are the queries


@query()
def edit_infix_top20(spark, sf):
    return align.edit_candidates(_name_pairs(spark, sf), 20).select("query_id", "ref_id", "edit_distance", "rank")


@query()
def sw_rescore(spark, sf):
    return align.rescore(align.edit_candidates(_name_pairs(spark, sf), 50), 20)


@query()
def sw_exhaustive(spark, sf):
    return align.exhaustive_scores(_name_pairs(spark, sf))


@query()
def align_pipeline(spark, sf):
    b, d = t(spark, sf, "benchmark"), t(spark, sf, "documents")
    p = align.shared_kmers(b, d, "item_id", "doc_id", "text")
    return align.search(p, b, d, "item_id", "doc_id", "text")
