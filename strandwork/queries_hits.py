"""Registered queries on hit tables: selection, gene sets, scoring, sampling, and the tables behind figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .functions import stats, text
from .operators import genes, hits, reports, retrieval, scoring, select
from .queries import _TWO, _neighbours, _two, query, t

# lineitem as a hit table of orders; every number below has the same expression on both sides

HITS_SQL = """WITH ranked AS (SELECT *, (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_partkey, l_suppkey, l_linenumber, l_quantity, l_discount, l_tax, l_shipdate))::INTEGER AS rank FROM lineitem),
hits AS (SELECT l_orderkey AS query_id, 1000 AS query_len, rank, l_partkey || '.' || l_suppkey AS genome_id, l_partkey AS taxon_id, p_type AS genus, CASE WHEN p_partkey % 11 = 0 THEN '' ELSE p_brand END AS family,
  CASE WHEN p_partkey % 13 = 0 THEN '' ELSE p_name END AS species, CASE WHEN l_suppkey % 7 = 0 THEN 'uncultured ' || p_name ELSE p_name END AS organism, 1 - l_discount AS identity, l_extendedprice / 100 AS align_score, 850 + 3 * l_quantity AS aligned_len,
  CASE WHEN l_linenumber = 7 THEN NULL ELSE (1 - l_discount) - l_tax / 2 END AS edit_identity, CASE p_size % 10 WHEN 0 THEN NULL WHEN 1 THEN 0 ELSE p_size * 100 END AS gene_count, max(1 - l_discount) OVER (PARTITION BY l_orderkey) AS best_identity, 'Brand#11 x' AS study
  FROM ranked JOIN part ON l_partkey = p_partkey)
"""


def hit_table(spark: SparkSession, sf: str) -> DataFrame:
    order = [F.desc("l_extendedprice"), *[F.col(c) for c in ("l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_discount", "l_tax", "l_shipdate")]]
    h = hits.ranked(t(spark, sf, "lineitem"), "l_orderkey", order).join(t(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
    k, identity = F.col("p_partkey"), 1 - F.col("l_discount")
    return h.select(
        F.col("l_orderkey").alias("query_id"), F.lit(1000).alias("query_len"), "rank", F.concat_ws(".", "l_partkey", "l_suppkey").alias("genome_id"), F.col("l_partkey").alias("taxon_id"), F.col("p_type").alias("genus"),
        F.when(k % 11 == 0, "").otherwise(F.col("p_brand")).alias("family"), F.when(k % 13 == 0, "").otherwise(F.col("p_name")).alias("species"),
        F.when(F.col("l_suppkey") % 7 == 0, F.concat(F.lit("uncultured "), "p_name")).otherwise(F.col("p_name")).alias("organism"), identity.alias("identity"), (F.col("l_extendedprice") / 100).alias("align_score"), (850 + 3 * F.col("l_quantity")).alias("aligned_len"),
        F.when(F.col("l_linenumber") != 7, identity - F.col("l_tax") / 2).alias("edit_identity"), F.when(F.col("p_size") % 10 == 1, 0).when(F.col("p_size") % 10 != 0, F.col("p_size") * 100).alias("gene_count"),
        F.max(identity).over(Window.partitionBy("l_orderkey")).alias("best_identity"), F.lit("Brand#11 x").alias("study"),
    )


@query(HITS_SQL + "SELECT query_id, rank, genome_id, identity, align_score FROM hits WHERE rank <= 3")
def hits_topk(spark, sf):
    return hit_table(spark, sf).where("rank <= 3").select("query_id", "rank", "genome_id", "identity", "align_score")


@query(HITS_SQL + ", r AS (SELECT query_id, genome_id, rank AS old_rank, (row_number() OVER (PARTITION BY query_id ORDER BY rank))::INTEGER AS rank FROM hits WHERE identity < best_identity) SELECT query_id, genome_id, old_rank, rank FROM r")
def hits_rerank(spark, sf):
    h = hit_table(spark, sf).where("identity < best_identity").withColumnRenamed("rank", "old_rank")
    return hits.ranked(h, "query_id", [F.col("old_rank")]).select("query_id", "genome_id", "old_rank", "rank")


@query(HITS_SQL + ", r AS (SELECT *, row_number() OVER (PARTITION BY query_id, taxon_id ORDER BY identity DESC, align_score DESC, rank) AS k FROM hits) SELECT query_id, taxon_id, rank, genome_id FROM r WHERE k = 1")
def best_copy(spark, sf):
    return hits.best_per(hit_table(spark, sf), ["query_id", "taxon_id"], [F.desc("identity"), F.desc("align_score"), F.col("rank")]).select("query_id", "taxon_id", "rank", "genome_id")


_TIER = "CASE WHEN best_identity >= 0.987 THEN 'species' WHEN best_identity >= 0.945 THEN 'genus' WHEN best_identity >= 0.865 THEN 'family' ELSE 'below' END"
_GATE = f"""CASE WHEN {_TIER} = 'below' THEN 'tier_floor' WHEN round(least(aligned_len / query_len, 1.0), 4) < 0.9 THEN 'reliability_gate' WHEN round(abs(identity - edit_identity), 4) > 0.02 THEN 'reliability_gate' WHEN identity < 0.865 THEN 'identity_floor' END"""


@query(HITS_SQL + f"SELECT DISTINCT query_id, {_TIER} AS tier FROM hits")
def select_tier(spark, sf):
    return hit_table(spark, sf).select("query_id", select.tier(F.col("best_identity")).alias("tier")).distinct()


@query(HITS_SQL + f"SELECT query_id, rank, {_GATE} AS stage FROM hits")
def select_reliability(spark, sf):
    return hit_table(spark, sf).withColumn("tier", select.tier(F.col("best_identity"))).select("query_id", "rank", select.gate().alias("stage"))


_NORM = r"lower(regexp_replace(trim({0}), '(?i)^(Candidatus\s+|Ca[._]\s*|midas_[a-z]_)\s*', ''))"
_UNC = r"regexp_matches(organism, '(?i)uncultured|metagenome|environmental sample|unidentified|unclassified|^\s*$')"
_REP = f"(0.55 * identity + 0.3 * (align_score / (2 * query_len)) + 0.15 * least(1.0, aligned_len / query_len)) * CASE WHEN {_UNC} THEN 0.98 ELSE 1.0 END"
UNION_SQL = (
    HITS_SQL
    + f""", g AS (SELECT *, {_TIER} AS tier, {_GATE} AS s0, {_NORM.format("species")} AS sp, {_NORM.format("family")} AS fam, {_REP} AS rep FROM hits),
b AS (SELECT *, max(CASE WHEN s0 IS NULL THEN identity END) OVER (PARTITION BY query_id) AS bk FROM g),
c AS (SELECT *, coalesce(s0, CASE WHEN bk - identity > 0.0 THEN 'identity_band' END) AS s1 FROM b),
d AS (SELECT *, row_number() OVER (PARTITION BY query_id, genome_id, s1 IS NULL ORDER BY identity DESC, align_score DESC, rank) AS k1 FROM c),
e AS (SELECT *, coalesce(s1, CASE WHEN k1 > 1 THEN 'genome_dedup' END) AS s2, CASE WHEN sp <> '' THEN sp ELSE 'taxon:' || taxon_id END AS species_key FROM d),
f AS (SELECT *, row_number() OVER (PARTITION BY query_id, species_key, s2 IS NULL ORDER BY identity DESC, align_score DESC, coalesce(gene_count, 0) DESC, genome_id) AS k2,
  first_value(genome_id) OVER (PARTITION BY query_id, species_key, s2 IS NULL ORDER BY identity DESC, align_score DESC, coalesce(gene_count, 0) DESC, genome_id) AS r0 FROM e),
h AS (SELECT *, CASE WHEN s2 IS NULL THEN r0 END AS representative, coalesce(s2, CASE WHEN k2 > 1 THEN 'species_dedup' END) AS s3 FROM f),
i AS (SELECT *, CASE WHEN s3 IS NULL THEN row_number() OVER (PARTITION BY query_id, s3 IS NULL ORDER BY rep * exp(-(best_identity - identity) / 0.01) DESC, genome_id) END::INTEGER AS position,
  CASE WHEN s3 IS NULL THEN first_value(fam) OVER (PARTITION BY query_id, s3 IS NULL ORDER BY rep * exp(-(best_identity - identity) / 0.01) DESC, genome_id) END AS anchor_family FROM h),
u AS (SELECT *, coalesce(s3, 'included') AS stage, CASE WHEN s3 IS NULL THEN 'selected' ELSE 'excluded' END AS disposition, CASE WHEN s3 IS NULL THEN CASE WHEN position = 1 THEN 'anchor' ELSE 'congener' END END AS role,
  CASE WHEN s3 IS NULL THEN CASE WHEN {_UNC} OR fam = '' THEN 'low' WHEN (anchor_family = '' OR fam = anchor_family OR fam IN ('brand#11', 'x')) THEN CASE WHEN regexp_matches(trim(species), '^[A-Z][a-z]+ [a-z]{{3,}}$') AND NOT contains(lower(species), 'bacterium') THEN 'high' ELSE 'medium' END ELSE 'low' END END AS confidence FROM i)
"""
)


def _union(spark: SparkSession, sf: str) -> DataFrame:
    return select.union(hit_table(spark, sf))


@query(UNION_SQL + "SELECT query_id, rank, genome_id, tier, stage, disposition, position, role, confidence, representative FROM u")
def select_union(spark, sf):
    return _union(spark, sf).select("query_id", "rank", "genome_id", "tier", "stage", "disposition", "position", "role", "confidence", "representative")


@query(UNION_SQL + "SELECT l.query_id, l.representative, l.genome_id, abs(l.identity - k.identity) < 1e-9 AS exact_tie FROM u l JOIN u k ON l.query_id = k.query_id AND l.representative = k.genome_id AND k.disposition = 'selected' WHERE l.stage = 'species_dedup'")
def select_equivalents(spark, sf):
    return select.equivalents(_union(spark, sf))


@query(
    UNION_SQL
    + """, s AS (SELECT query_id, min(tier) AS tier, count(*) FILTER (disposition = 'selected') AS n_selected, max(CASE WHEN role = 'anchor' THEN genome_id END) AS anchor, coalesce(max(CASE WHEN role = 'anchor' THEN coalesce(gene_count, 3000) END), 0)::BIGINT AS core_genes,
  count(*) FILTER (disposition = 'selected' AND confidence = 'low') AS n_low, count(*) FILTER (stage = 'species_dedup') AS n_equivalent, coalesce(bool_and(CASE WHEN disposition = 'selected' THEN """
    + _UNC
    + """ END), false) AS uncultured_only, coalesce(bool_or(disposition = 'selected' AND gene_count = 0), false) AS has_gene_set_empty, coalesce(bool_or(role = 'anchor' AND gene_count = 0), false) AS anchor_no_gene_set, arg_min(stage, rank) AS top_stage FROM u GROUP BY query_id)
SELECT query_id, tier, n_selected, anchor, core_genes, n_low, n_equivalent, uncultured_only, has_gene_set_empty, anchor_no_gene_set, CASE WHEN tier = 'below' THEN 'abstain_below_family' WHEN n_selected = 0 THEN 'abstain_reliability' ELSE 'ok' END AS status,
  tier = 'family' AND n_selected > 0 AS family_level_draft, CASE WHEN top_stage IN ('family_consensus', 'reliability_gate') THEN top_stage END AS score_top_dropped FROM s"""
)
def select_summary(spark, sf):
    return select.summary(_union(spark, sf))


@query(UNION_SQL + "SELECT stage, tier, count(*) AS n FROM u GROUP BY stage, tier")
def select_exclusions(spark, sf):
    return _union(spark, sf).groupBy("stage", "tier").agg(F.count("*").alias("n"))


@query(UNION_SQL + """SELECT query_id, rank, genome_id, stage, CASE WHEN stage = 'tier_floor' THEN printf('best identity %.4f is below the family threshold', best_identity) WHEN stage = 'reliability_gate' AND round(least(aligned_len / query_len, 1.0), 4) < 0.9 THEN printf('covers only %.3f of the query', round(least(aligned_len / query_len, 1.0), 4))
  WHEN stage = 'reliability_gate' THEN printf('identities of the two methods differ by %.3f', round(abs(identity - edit_identity), 4)) WHEN stage = 'identity_floor' THEN printf('identity %.4f is below the family floor', identity) WHEN stage = 'identity_band' THEN 'too far below the best identity'
  WHEN stage = 'genome_dedup' THEN 'another copy of the same genome is kept' WHEN stage = 'species_dedup' THEN 'species is represented by ' || representative WHEN role = 'anchor' THEN 'best representative' ELSE stage END AS reason FROM u""")
def select_audit(spark, sf):
    return select.reasons(_union(spark, sf)).select("query_id", "rank", "genome_id", "stage", "reason")


@query()
def select_variants(spark, sf):
    """All presets in one pass over the hits."""
    return select.fold(hit_table(spark, sf), select.PRESETS)


@query()
def select_knob_grid(spark, sf):
    from dataclasses import replace

    grid = {f"window {w}, cap {c}": replace(select.EXACT_TIE, window=w, cap=c) for w in (0.0, 0.005, 0.02) for c in (0, 3)}
    return select.fold(hit_table(spark, sf), grid).groupBy("variant", "stage").agg(F.count("*").alias("n"))


@query(UNION_SQL + "SELECT query_id, n_tied, best FROM (SELECT query_id, count(*) FILTER (best_identity - identity <= 0.005) AS n_tied, max(identity) AS best FROM hits GROUP BY query_id)")
def tie_cluster(spark, sf):
    return hits.tie_cluster(hit_table(spark, sf), "query_id", "identity", 0.005)


@query(HITS_SQL + "SELECT query_id, rank, rank() OVER (PARTITION BY query_id ORDER BY identity DESC) - 1 AS n_above, count(*) OVER (PARTITION BY query_id, identity) AS n_equal FROM hits")
def tie_place(spark, sf):
    return hits.place_in_ties(hit_table(spark, sf), "query_id", "identity").select("query_id", "rank", "n_above", "n_equal")


@query(HITS_SQL + ", n AS (SELECT query_id, count(*) FILTER (best_identity - identity <= 0.005) AS n FROM hits GROUP BY query_id) SELECT least(n, 20) AS size, count(*) AS queries FROM n GROUP BY 1")
def tie_histogram(spark, sf):
    n = hits.tie_cluster(hit_table(spark, sf), "query_id", "identity", 0.005)
    return n.groupBy(F.least("n_tied", F.lit(20).cast("long")).alias("size")).agg(F.count("*").alias("queries"))


@query(HITS_SQL + "SELECT query_id, genome_id, (row_number() OVER (PARTITION BY query_id ORDER BY rank))::INTEGER AS rank FROM hits WHERE NOT (taxon_id % 5 = query_id % 5 OR identity >= 0.99)")
def self_exclude(spark, sf):
    h = hit_table(spark, sf).withColumn("old", F.col("rank"))
    same = (F.col("taxon_id") % 5 == F.col("query_id") % 5) | (F.col("identity") >= 0.99)
    return hits.exclude_self(h, "query_id", same, [F.col("old")]).select("query_id", "genome_id", "rank")


@query(HITS_SQL + "SELECT query_id, bool_or(taxon_id % 5 = query_id % 5) AS self_in_list, coalesce(min(CASE WHEN taxon_id % 5 = query_id % 5 THEN rank END) = 1, false) AS self_first, min(CASE WHEN taxon_id % 5 = query_id % 5 THEN rank END)::BIGINT AS self_rank FROM hits GROUP BY query_id")
def self_recovery(spark, sf):
    return hits.self_recovery(hit_table(spark, sf), "query_id", F.col("taxon_id") % 5 == F.col("query_id") % 5)


@query(UNION_SQL + """, o AS (SELECT query_id, max(CASE stage WHEN 'included' THEN 6 WHEN 'species_dedup' THEN 5 WHEN 'genome_dedup' THEN 4 WHEN 'identity_band' THEN 3 WHEN 'reliability_gate' THEN 2 ELSE 1 END) AS s FROM u WHERE taxon_id % 5 = query_id % 5 GROUP BY query_id)
SELECT s::INTEGER AS furthest, count(*) AS n FROM o GROUP BY s""")
def failure_attribution(spark, sf):
    """How far a query's own source came: the furthest stage of any of its hits."""
    order = F.when(F.col("stage") == "included", 6).when(F.col("stage") == "species_dedup", 5).when(F.col("stage") == "genome_dedup", 4).when(F.col("stage") == "identity_band", 3).when(F.col("stage") == "reliability_gate", 2).otherwise(1)
    own = _union(spark, sf).where("taxon_id % 5 = query_id % 5").groupBy("query_id").agg(F.max(order).alias("furthest"))
    return own.groupBy("furthest").agg(F.count("*").alias("n"))


# Gene sets: the parts a supplier delivers

_GENES = "WITH genes AS (SELECT DISTINCT l_suppkey AS genome_id, l_partkey AS gene FROM lineitem), chosen AS (SELECT DISTINCT o_custkey % 50 AS query_id, l_suppkey AS genome_id FROM orders JOIN lineitem ON o_orderkey = l_orderkey)\n"


def _gene_tables(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    li = t(spark, sf, "lineitem")
    g = li.select(F.col("l_suppkey").alias("genome_id"), F.col("l_partkey").alias("gene")).distinct()
    c = t(spark, sf, "orders").join(li, F.col("o_orderkey") == F.col("l_orderkey"))
    return g, c.select((F.col("o_custkey") % 50).alias("query_id"), F.col("l_suppkey").alias("genome_id")).distinct()


@query(_GENES + "SELECT query_id, gene, count(DISTINCT genome_id) AS n_genomes FROM chosen JOIN genes USING (genome_id) GROUP BY query_id, gene")
def gene_union(spark, sf):
    g, c = _gene_tables(spark, sf)
    return genes.union(c, g)


@query(_GENES + ", p AS (SELECT query_id, gene, count(DISTINCT genome_id) AS n FROM chosen JOIN genes USING (genome_id) GROUP BY query_id, gene), k AS (SELECT query_id, count(*) AS total FROM chosen GROUP BY query_id) SELECT query_id, count(*) AS union_genes, count(*) FILTER (n = total) AS core, count(*) FILTER (2 * n >= total) AS half_core, count(*) FILTER (n = 1 AND total > 1) AS \"unique\", count(*) FILTER (n > 1 AND n < total) AS shared FROM p JOIN k USING (query_id) GROUP BY query_id")
def pangenome(spark, sf):
    g, c = _gene_tables(spark, sf)
    return genes.pangenome(genes.union(c, g), genes.sizes(c))


@query(_GENES + "SELECT genome_id, gene FROM genes WHERE gene NOT IN (SELECT l_partkey FROM lineitem WHERE l_suppkey % 20 = 0)")
def gene_novelty(spark, sf):
    g, _ = _gene_tables(spark, sf)
    return genes.novelty(g, g.where("genome_id % 20 = 0")).select("genome_id", "gene")


@query(_GENES + "SELECT gene, count(DISTINCT genome_id) AS n_genomes FROM genes GROUP BY gene")
def gene_prevalence(spark, sf):
    return _gene_tables(spark, sf)[0].groupBy("gene").agg(F.count_distinct("genome_id").alias("n_genomes"))


_CAPTURE = """WITH t AS (SELECT DISTINCT l_suppkey AS query_id, l_partkey AS gene FROM lineitem WHERE l_quantity > 10), p AS (SELECT DISTINCT l_suppkey AS query_id, l_partkey AS gene FROM lineitem WHERE l_quantity <= 30 AND l_suppkey % 9 <> 0),
tt AS (SELECT query_id, count(*) AS truth_size FROM t GROUP BY query_id), pp AS (SELECT query_id, count(*) AS pred_size FROM p GROUP BY query_id), bb AS (SELECT query_id, count(*) AS "both" FROM t JOIN p USING (query_id, gene) GROUP BY query_id),
c AS (SELECT s_suppkey AS query_id, coalesce(truth_size, 0) AS truth_size, coalesce(pred_size, 0) AS pred_size, coalesce("both", 0) AS "both", s_nationkey FROM supplier LEFT JOIN tt ON s_suppkey = tt.query_id LEFT JOIN pp ON s_suppkey = pp.query_id LEFT JOIN bb ON s_suppkey = bb.query_id),
m AS (SELECT *, "both"::DOUBLE / nullif(truth_size, 0) AS recall, "both"::DOUBLE / nullif(pred_size, 0) AS precision, (2 * "both")::DOUBLE / nullif(truth_size + pred_size, 0) AS f1, "both"::DOUBLE / nullif(truth_size + pred_size - "both", 0) AS jaccard FROM c)
"""


def _captured(spark: SparkSession, sf: str) -> DataFrame:
    li = t(spark, sf, "lineitem").select(F.col("l_suppkey").alias("query_id"), F.col("l_partkey").alias("gene"), "l_quantity")
    truth, pred = li.where("l_quantity > 10"), li.where("l_quantity <= 30 and query_id % 9 <> 0")
    return genes.capture(truth, pred, t(spark, sf, "supplier").select(F.col("s_suppkey").alias("query_id"), "s_nationkey"))


@query(_CAPTURE + 'SELECT query_id, truth_size, pred_size, "both", recall, precision, f1, jaccard FROM m')
def gene_capture(spark, sf):
    return _captured(spark, sf).drop("s_nationkey")


@query(_CAPTURE + """, a AS (SELECT s_nationkey, count(*) AS n, sum("both")::DOUBLE / nullif(sum(truth_size), 0) AS micro_recall, sum("both")::DOUBLE / nullif(sum(pred_size), 0) AS micro_precision, (2 * sum("both"))::DOUBLE / nullif(sum(truth_size) + sum(pred_size), 0) AS micro_f1,
  avg(recall) AS r, 1.96 * coalesce(stddev_samp(recall) / sqrt(count(recall)), 0) AS half FROM m GROUP BY s_nationkey)
SELECT s_nationkey, n, micro_recall, micro_precision, micro_f1, round(r, 9) AS macro_recall, round(greatest(0.0, r - half), 9) AS low, round(least(1.0, r + half), 9) AS high FROM a""")
def capture_summary(spark, sf):
    out = genes.micro(_captured(spark, sf), ["s_nationkey"])
    return out.select("s_nationkey", "n", "micro_recall", "micro_precision", "micro_f1", *[F.round(c, 9).alias(c) for c in ("macro_recall", "low", "high")])


@query(_CAPTURE + """SELECT query_id, CASE WHEN truth_size = 0 THEN 'truth_empty' WHEN query_id % 9 = 0 THEN 'abstained' WHEN pred_size = 0 THEN 'pred_empty' ELSE 'ok' END AS outcome FROM m""")
def capture_outcome(spark, sf):
    c = _captured(spark, sf).withColumn("has_hits", F.lit(True)).withColumn("n_selected", (F.col("query_id") % 9 != 0).cast("int"))
    return c.select("query_id", genes.outcome().alias("outcome"))


@query(_CAPTURE + """, n AS (SELECT count(DISTINCT l_partkey) AS u FROM lineitem), k AS (SELECT query_id, "both"::DOUBLE AS tp, (pred_size - "both")::DOUBLE AS fp, (truth_size - "both")::DOUBLE AS fn, (u - truth_size - pred_size + "both")::DOUBLE AS tn FROM m, n)
SELECT query_id, CASE WHEN (tp + fp) * (tp + fn) * (tn + fp) * (tn + fn) > 0 THEN round((tp * tn - fp * fn) / sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)), 12) ELSE 0.0 END AS mcc FROM k""")
def mcc_frontier(spark, sf):
    u = t(spark, sf, "lineitem").agg(F.count_distinct("l_partkey").alias("u"))
    c = _captured(spark, sf).join(F.broadcast(u))
    b, p, n = F.col("both"), F.col("pred_size"), F.col("truth_size")
    return c.select("query_id", F.round(stats.matthews(b, p - b, n - b, F.col("u") - n - p + b), 12).alias("mcc"))


@query("SELECT l_suppkey AS genome_id, count(*) AS n_rows, count(*) >= 610 AS capped FROM lineitem GROUP BY l_suppkey")
def row_cap(spark, sf):
    return t(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("genome_id")).agg(F.count("*").alias("n_rows"), (F.count("*") >= 610).alias("capped"))


@query("SELECT p_partkey FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_discount > 0.08) AND p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_tax > 0.07)")
def candidate_missing(spark, sf):
    li = t(spark, sf, "lineitem").withColumnRenamed("l_partkey", "p_partkey")
    return t(spark, sf, "part").select("p_partkey").join(li.where("l_discount > 0.08"), "p_partkey", "left_semi").join(li.where("l_tax > 0.07"), "p_partkey", "left_anti")


# Scores and tests

_CELLS = """WITH c AS (SELECT l.l_orderkey, l.l_linenumber, l.l_suppkey, p.p_partkey, r.r_name AS truth_region, n.n_name AS truth_nation, CASE WHEN l.l_tax = 0 THEN '' WHEN p.p_partkey % 4 = 0 THEN 'ASIA' ELSE r.r_name END AS called_region, CASE WHEN l.l_tax < 0.03 THEN NULL WHEN p.p_partkey % 3 = 0 THEN 'FRANCE' ELSE n.n_name END AS called_nation
  FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey JOIN supplier s ON l.l_suppkey = s.s_suppkey JOIN nation n ON s.s_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey),
k AS (SELECT *, CASE WHEN coalesce(called_region, '') = '' THEN NULL ELSE called_region = truth_region END AS region_ok, CASE WHEN coalesce(called_nation, '') = '' THEN NULL ELSE called_nation = truth_nation END AS nation_ok FROM c)
"""


def _cells(spark: SparkSession, sf: str) -> DataFrame:
    li = t(spark, sf, "lineitem").join(t(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey")).join(t(spark, sf, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    li = li.join(t(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(t(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    called_region = F.when(F.col("l_tax") == 0, "").when(F.col("p_partkey") % 4 == 0, "ASIA").otherwise(F.col("r_name"))
    called_nation = F.when(F.col("l_tax") < 0.03, F.lit(None)).when(F.col("p_partkey") % 3 == 0, "FRANCE").otherwise(F.col("n_name"))
    c = li.select("l_orderkey", "l_linenumber", "l_suppkey", "p_partkey", F.col("r_name").alias("truth_region"), F.col("n_name").alias("truth_nation"), called_region.alias("called_region"), called_nation.alias("called_nation"))
    return c.withColumn("region_ok", scoring.cell(F.col("truth_region"), F.col("called_region"))).withColumn("nation_ok", scoring.cell(F.col("truth_nation"), F.col("called_nation")))


@query(_CELLS + "SELECT CASE WHEN region_ok THEN CASE WHEN nation_ok THEN 'nation' ELSE 'region' END ELSE 'none' END AS deepest, CASE WHEN NOT region_ok THEN 'region' WHEN NOT nation_ok THEN 'nation' END AS first_wrong, count(*) AS n FROM k GROUP BY 1, 2")
def rank_cells(spark, sf):
    ranks = [("region", F.col("region_ok")), ("nation", F.col("nation_ok"))]
    return _cells(spark, sf).groupBy(scoring.deepest(ranks).alias("deepest"), scoring.first_wrong(ranks).alias("first_wrong")).agg(F.count("*").alias("n"))


@query(_CELLS + """, a AS (SELECT truth_region, count(*) AS n, count(region_ok) AS n_called, count(*) FILTER (region_ok) AS n_correct FROM k GROUP BY truth_region), z AS (SELECT *, n::DOUBLE AS m, n_correct::DOUBLE / n AS p, 1.959963984540054::DOUBLE AS z FROM a)
SELECT truth_region, n, n_called, n_correct, n_called::DOUBLE / n AS coverage, n_correct::DOUBLE / n_called AS accuracy,
  greatest(0.0, (p + z * z / (2 * m)) / (1 + z * z / m) - z * sqrt(p * (1 - p) / m + z * z / (4 * m * m)) / (1 + z * z / m)) AS low, least(1.0, (p + z * z / (2 * m)) / (1 + z * z / m) + z * sqrt(p * (1 - p) / m + z * z / (4 * m * m)) / (1 + z * z / m)) AS high FROM z""")
def wilson(spark, sf):
    return scoring.coverage(_cells(spark, sf), ["truth_region"], "region_ok")


@query(_CELLS + """SELECT CASE WHEN grouping(truth_region) = 1 THEN 'all' ELSE truth_region END AS truth_region, CASE WHEN grouping(band) = 1 THEN 'all' ELSE band END AS band, count(*) AS n, count(nation_ok) AS n_called, count(*) FILTER (nation_ok) AS n_correct
FROM (SELECT *, CASE WHEN p_partkey % 2 = 0 THEN 'even' ELSE 'odd' END AS band FROM k) GROUP BY CUBE (truth_region, band)""")
def coverage_rollup(spark, sf):
    c = _cells(spark, sf).withColumn("band", F.when(F.col("p_partkey") % 2 == 0, "even").otherwise("odd"))
    return scoring.rolled(c, [], ["truth_region", "band"], "nation_ok")


@query(_CELLS + "SELECT truth_nation, called_nation, count(*) AS n FROM k WHERE truth_nation <> called_nation GROUP BY 1, 2")
def confusion(spark, sf):
    return scoring.confusion(_cells(spark, sf), "truth_nation", "called_nation")


@query(_CELLS + """, u AS (SELECT p_partkey AS u, truth_region AS g, bool_or(nation_ok) AS c FROM k WHERE nation_ok IS NOT NULL GROUP BY 1, 2)
SELECT a.g AS group_a, b.g AS group_b, count(*) AS n, count(*) FILTER (a.c AND b.c) AS "both", count(*) FILTER (a.c AND NOT b.c) AS only_a, count(*) FILTER (NOT a.c AND b.c) AS only_b FROM u a JOIN u b ON a.u = b.u AND a.g < b.g GROUP BY 1, 2""")
def mcnemar_counts(spark, sf):
    u = _cells(spark, sf).where("nation_ok is not null").groupBy("p_partkey", "truth_region").agg(F.bool_or("nation_ok").alias("c"))
    return scoring.paired(u, "p_partkey", "truth_region", "c").drop("p")


@query()
def mcnemar_holm(spark, sf):
    u = _cells(spark, sf).where("nation_ok is not null").groupBy("p_partkey", "truth_region").agg(F.bool_or("nation_ok").alias("c"))
    return scoring.holm(scoring.paired(u, "p_partkey", "truth_region", "c"), "p", [], ["group_a", "group_b"])


@query("""WITH p AS (SELECT o_orderpriority AS name, count(*)::DOUBLE / (SELECT count(*) FROM orders) / 10 AS p FROM orders GROUP BY 1), i AS (SELECT *, row_number() OVER (ORDER BY p, name) AS i, count(*) OVER () AS m FROM p)
SELECT name, p, max(least(1.0, (m - i + 1) * p)) OVER (ORDER BY p, name ROWS UNBOUNDED PRECEDING) AS p_holm FROM i""")
def holm(spark, sf):
    o = t(spark, sf, "orders")
    n = o.count()
    p = o.groupBy(F.col("o_orderpriority").alias("name")).agg((F.count("*").cast("double") / n / 10).alias("p"))
    return scoring.holm(p, "p", [], ["name"]).select("name", "p", "p_holm")


@query("""WITH v AS (SELECT l_suppkey, p_brand AS name, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2), w AS (SELECT *, max(n) OVER (PARTITION BY l_suppkey) AS top, sum(n) OVER (PARTITION BY l_suppkey) AS total FROM v)
SELECT l_suppkey, CASE WHEN count(*) > 1 THEN 'AMBIG' ELSE min(name) END AS winner, max(top)::DOUBLE / max(total) AS strength FROM w WHERE n = top GROUP BY l_suppkey""")
def majority_vote(spark, sf):
    v = t(spark, sf, "lineitem").join(t(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return hits.majority(v, ["l_suppkey"], F.col("p_brand"))


@query(HITS_SQL + """, v AS (SELECT query_id, family, count(*) AS n, min(rank) AS f FROM hits WHERE family <> '' GROUP BY 1, 2), w AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY n DESC, f) AS k FROM v) SELECT query_id, family FROM w WHERE k = 1""")
def select_consensus(spark, sf):
    """The most frequent family; of equally frequent ones the first seen."""
    v = hit_table(spark, sf).where("family <> ''").groupBy("query_id", "family").agg(F.count("*").alias("n"), F.min("rank").alias("f"))
    return v.groupBy("query_id").agg(F.max_by("family", F.struct("n", -F.col("f"))).alias("family"))


@query(HITS_SQL + """, q AS (SELECT query_id, bool_or(CASE WHEN rank = 1 THEN taxon_id % 4 = query_id % 4 END) AS best, bool_or(taxon_id % 4 = query_id % 4) AS anyhit, max(coalesce(o_totalprice, 0)) AS w FROM hits JOIN orders ON query_id = o_orderkey GROUP BY query_id)
SELECT count(*) AS n, round(avg(best::INT), 9) AS best, round(avg(anyhit::INT), 9) AS "any", round(sum(best::INT * w) / greatest(sum(w), 1e-9), 9) AS weighted FROM q""")
def concordance_weighted(spark, sf):
    h = hit_table(spark, sf).join(t(spark, sf, "orders"), F.col("query_id") == F.col("o_orderkey"))
    c = scoring.concordance(h, "query_id", F.col("taxon_id") % 4 == F.col("query_id") % 4, F.col("o_totalprice"))
    return c.select("n", *[F.round(x, 9).alias(x) for x in ("best", "any", "weighted")])


_ANI = HITS_SQL + """, a AS (SELECT *, 80 + 20 * (identity - 0.9) * 10 AS ani, aligned_len - 850 AS af FROM hits), b AS (SELECT *, af >= 15 AS af_pass, row_number() OVER (PARTITION BY query_id ORDER BY af >= 15 DESC, ani DESC, rank) AS k FROM a)
"""


def _ani(spark: SparkSession, sf: str) -> DataFrame:
    h = hit_table(spark, sf).withColumn("ani", 80 + 20 * (F.col("identity") - 0.9) * 10).withColumn("af", F.col("aligned_len") - 850)
    return scoring.best_genome(h, "query_id", "af", "ani", "rank")


@query(_ANI + "SELECT query_id, genome_id, ani, af, af_pass FROM b WHERE k = 1")
def ani_best_hit(spark, sf):
    return _ani(spark, sf).select("query_id", "genome_id", "ani", "af", "af_pass")


@query(_ANI + "SELECT CASE WHEN NOT af_pass THEN 'low_af' WHEN ani >= 95 THEN 'same_species' WHEN ani >= 85 THEN 'same_genus' ELSE 'distant' END AS class, count(*) AS n FROM b WHERE k = 1 GROUP BY 1")
def ani_class(spark, sf):
    return _ani(spark, sf).groupBy(scoring.identity_class(F.col("ani"), F.col("af_pass")).alias("class")).agg(F.count("*").alias("n"))


@query("""WITH x AS (SELECT l_suppkey, l_quantity AS a, l_extendedprice AS b FROM lineitem), r AS (SELECT l_suppkey, rank() OVER (PARTITION BY l_suppkey ORDER BY a) + (count(*) OVER (PARTITION BY l_suppkey, a) - 1) / 2.0::DOUBLE AS ra, rank() OVER (PARTITION BY l_suppkey ORDER BY b) + (count(*) OVER (PARTITION BY l_suppkey, b) - 1) / 2.0::DOUBLE AS rb FROM x)
SELECT l_suppkey, round(corr(ra, rb), 9) AS spearman FROM r GROUP BY l_suppkey""")
def spearman(spark, sf):
    def avg_rank(c: str) -> Column:
        return F.rank().over(Window.partitionBy("l_suppkey").orderBy(c)) + (F.count("*").over(Window.partitionBy("l_suppkey", c)) - 1) / 2.0

    r = t(spark, sf, "lineitem").select("l_suppkey", avg_rank("l_quantity").alias("ra"), avg_rank("l_extendedprice").alias("rb"))
    return r.groupBy("l_suppkey").agg(F.round(F.corr("ra", "rb"), 9).alias("spearman"))


@query("SELECT l_returnflag, round(corr(l_extendedprice, l_quantity), 9) AS r, round(regr_slope(l_extendedprice, l_quantity), 6) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept FROM lineitem GROUP BY 1")
def ols(spark, sf):
    y, x = "l_extendedprice", "l_quantity"
    return t(spark, sf, "lineitem").groupBy("l_returnflag").agg(F.round(F.corr(y, x), 9).alias("r"), F.round(F.regr_slope(y, x), 6).alias("slope"), F.round(F.regr_intercept(y, x), 4).alias("intercept"))


# Sampling

@query("""WITH c AS (SELECT c_nationkey, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY CASE WHEN c_acctbal >= 5000 THEN 0 ELSE 1 END, c_acctbal DESC, c_custkey) AS k FROM customer) SELECT c_nationkey, c_custkey FROM c WHERE k = 1""")
def species_rep(spark, sf):
    """The best of each group, from the upper tier if it has any."""
    return hits.best_per(t(spark, sf, "customer"), ["c_nationkey"], [F.when(F.col("c_acctbal") >= 5000, 0).otherwise(1), F.desc("c_acctbal"), F.col("c_custkey")]).select("c_nationkey", "c_custkey")


@query("""WITH s AS (SELECT n_regionkey, n_nationkey, count(*) AS available FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2), a AS (SELECT *, 40 * sqrt(available::DOUBLE) / sum(sqrt(available::DOUBLE)) OVER (PARTITION BY n_regionkey) AS share FROM s),
b AS (SELECT *, least(floor(share)::BIGINT, available) AS base FROM a), c AS (SELECT *, available - base AS room, greatest(0, 40 - sum(base) OVER (PARTITION BY n_regionkey)) AS lo FROM b),
d AS (SELECT *, sum(room) OVER (PARTITION BY n_regionkey ORDER BY round(share - floor(share), 9) DESC, n_nationkey ROWS UNBOUNDED PRECEDING) - room AS before FROM c)
SELECT n_regionkey, n_nationkey, available, (base + greatest(0, least(room, lo - before)))::BIGINT AS allocated FROM d""")
def level_allocation(spark, sf):
    s = t(spark, sf, "customer").join(t(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_regionkey", "n_nationkey").agg(F.count("*").alias("available"))
    return scoring.allocate(s, "n_regionkey", "n_nationkey", "available", 40)


# Tables behind figures, pivots, zero-filled counts

@query("""SELECT l.lang, s.source, count(d.doc_id) AS n FROM (SELECT DISTINCT lang FROM documents) l CROSS JOIN (SELECT DISTINCT source FROM documents) s LEFT JOIN documents d ON d.lang = l.lang AND d.source = s.source GROUP BY 1, 2""")
def amplification_zero_fill(spark, sf):
    d = t(spark, sf, "documents")
    n = d.groupBy("lang", "source").agg(F.count("*").alias("n"))
    langs = d.select("lang").distinct().agg(F.collect_set("lang").alias("langs"))
    every = d.select("source").distinct().join(F.broadcast(langs)).select("source", F.explode("langs").alias("lang"))
    return every.join(n, ["lang", "source"], "left").select("lang", "source", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


@query("SELECT source, count(*) FILTER (lang = 'en') AS en, count(*) FILTER (lang = 'de') AS de, count(*) FILTER (lang = 'fr') AS fr, count(*) FILTER (lang = 'es') AS es FROM documents GROUP BY source")
def region_meta_pivot(spark, sf):
    p = t(spark, sf, "documents").groupBy("source").pivot("lang", ["en", "de", "fr", "es"]).agg(F.count("doc_id"))
    return p.select("source", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("en", "de", "fr", "es")])


@query("SELECT doc_id, metric, v::BIGINT AS value FROM (SELECT doc_id, quality, toxic FROM labels) UNPIVOT (v FOR metric IN (quality, toxic))")
def wide_to_long(spark, sf):
    d = t(spark, sf, "labels").select("doc_id", F.col("quality").cast("long"), F.col("toxic").cast("long"))
    return d.unpivot(["doc_id"], ["quality", "toxic"], "metric", "value")


@query("SELECT s_suppkey, s_acctbal, cume_dist() OVER (ORDER BY s_acctbal) AS ecdf FROM supplier")
def ecdf(spark, sf):
    df = t(spark, sf, "supplier")
    n = df.where("s_acctbal is not null").count()
    return df.join(stats.running_counts(df, "s_acctbal"), "s_acctbal").select("s_suppkey", "s_acctbal", (F.col("upto") / F.lit(n)).alias("ecdf"))


@query("SELECT p_brand, sum(l_quantity)::BIGINT AS total FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1 ORDER BY total DESC, p_brand LIMIT 15")
def top_categories(spark, sf):
    v = t(spark, sf, "lineitem").join(t(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return v.groupBy("p_brand").agg(F.sum("l_quantity").cast("long").alias("total")).orderBy(F.desc("total"), "p_brand").limit(15)


@query("SELECT l_shipmode, n, n::DOUBLE / sum(n) OVER (PARTITION BY l_shipmode) AS share, flag FROM (SELECT l_returnflag AS l_shipmode, l_linestatus AS flag, count(*) AS n FROM lineitem GROUP BY 1, 2)")
def row_shares(spark, sf):
    n = t(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("l_shipmode"), F.col("l_linestatus").alias("flag")).agg(F.count("*").alias("n"))
    return n.withColumn("share", F.col("n").cast("double") / F.sum("n").over(Window.partitionBy("l_shipmode")))


@query("""SELECT CASE WHEN identity < 0.865 THEN 0 WHEN identity < 0.945 THEN 1 WHEN identity < 0.987 THEN 2 WHEN identity < 0.995 THEN 3 ELSE 4 END AS bin, count(*) AS n FROM (SELECT 1 - l_discount AS identity FROM lineitem) GROUP BY 1""")
def identity_bins(spark, sf):
    x = 1 - F.col("l_discount")
    b = F.when(x < 0.865, 0).when(x < 0.945, 1).when(x < 0.987, 2).when(x < 0.995, 3).otherwise(4)
    return t(spark, sf, "lineitem").groupBy(b.alias("bin")).agg(F.count("*").alias("n"))


@query(HITS_SQL + """, i AS (SELECT query_id, max(identity) AS best FROM hits GROUP BY 1), e AS (SELECT query_id, max(identity) AS best FROM hits WHERE taxon_id % 5 <> query_id % 5 GROUP BY 1) SELECT i.query_id, i.best AS include_best, e.best AS exclude_best, i.best - e.best AS gap FROM i JOIN e ON i.query_id = e.query_id""")
def leakage_gap(spark, sf):
    h = hit_table(spark, sf)
    a = h.groupBy("query_id").agg(F.max("identity").alias("include_best"))
    b = h.where("taxon_id % 5 <> query_id % 5").groupBy("query_id").agg(F.max("identity").alias("exclude_best"))
    return a.join(b, "query_id").withColumn("gap", F.col("include_best") - F.col("exclude_best"))


@query("""SELECT DISTINCT k AS genome_id FROM (SELECT l_orderkey || '.' || l_partkey AS k FROM lineitem)""")
def id_harvest(spark, sf):
    from .sources.tables import genome_ids

    return genome_ids(t(spark, sf, "lineitem").select(F.to_json(F.struct(F.concat_ws(".", "l_orderkey", "l_partkey").alias("genome_id"), F.lit("x").alias("y"))).alias("j")), "j")


@query("""SELECT key, v FROM (SELECT key, v, row_number() OVER (PARTITION BY key ORDER BY p DESC, v) AS r FROM (SELECT s_suppkey % 30 AS key, s_name AS v, 0 AS p FROM supplier UNION ALL SELECT c_custkey % 20, c_name, 1 FROM customer)) WHERE r = 1""")
def merged_sources(spark, sf):
    from .sources.tables import merged

    a = t(spark, sf, "supplier").select((F.col("s_suppkey") % 30).alias("key"), F.col("s_name").alias("v"))
    b = t(spark, sf, "customer").select((F.col("c_custkey") % 20).alias("key"), F.col("c_name").alias("v"))
    return merged([a, b], "key")


@query()
def watch_ingest(spark, sf):
    """Events as a file stream, taken in by availableNow batches, each event once."""
    import uuid

    from .plans.stages import exists
    from .streaming import watch

    base = (spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")).rstrip("/") + f"/watch-{uuid.uuid4().hex}"
    src = t(spark, sf, "events")
    src.write.parquet(f"{base}/in")
    assert exists(spark, f"{base}/in")
    stream = watch.arrivals(spark, f"{base}/in", src._jdf.schema().toDDL())
    watch.ingest(stream, f"{base}/out", f"{base}/checkpoint", "event_id", lambda b: b.select("event_id", "event_type")).awaitTermination()
    return spark.read.parquet(f"{base}/out").select("event_id", "event_type")


# Retrieval, reports, intervals

@query(_TWO + """, c AS (SELECT a.query_id, a.rank AS true_rank, b.rank AS pos FROM a LEFT JOIN b ON a.query_id = b.query_id AND a.ref_id = b.ref_id WHERE a.rank <= 5),
e AS (SELECT query_id, k.k, bool_or(true_rank = 1 AND pos <= k.k) AS first, count(*) FILTER (pos <= k.k) AS n_in, count(*) AS n_true FROM c, (VALUES (1), (5), (10), (20)) k(k) GROUP BY 1, 2)
SELECT k::INTEGER AS k, count(*) AS n, round(avg(first::INT), 9) AS first_found, round(avg((n_in = n_true)::INT), 9) AS all_found, sum(n_in)::DOUBLE / sum(n_true) AS recall FROM e GROUP BY k""")
def recall_at_k(spark, sf):
    r = retrieval.recall_at(*_two(spark, sf))
    return r.withColumns({c: F.round(c, 9) for c in ("first_found", "all_found")})


@query(_TWO + "SELECT a.query_id, (b.rank - 1)::BIGINT AS place FROM a LEFT JOIN b ON a.query_id = b.query_id AND a.ref_id = b.ref_id WHERE a.rank = 1")
def known_item_place(spark, sf):
    a, b = _two(spark, sf)
    return retrieval.place_of(b, a.where("rank = 1").select("query_id", "ref_id"))


@query(HITS_SQL + """, f AS (SELECT query_id, align_score AS floor FROM hits WHERE rank = 3), n AS (SELECT h.query_id, count(*) FILTER (h.align_score >= f.floor) AS n_as_good FROM hits h JOIN f ON h.query_id = f.query_id WHERE h.identity >= 0.93 GROUP BY 1)
SELECT query_id, n_as_good, n_as_good >= 3 AS equivalent FROM n""")
def equivalent_top(spark, sf):
    h = hit_table(spark, sf)
    return retrieval.equivalent_top(h, h.where("identity >= 0.93"), "align_score", 3)


@query(UNION_SQL + """, s AS (SELECT query_id, min(tier) AS tier, count(*) FILTER (disposition = 'selected') AS k FROM u GROUP BY 1), x AS (SELECT CASE WHEN tier = 'below' THEN 'abstain_below_family' WHEN k = 0 THEN 'abstain_reliability' ELSE 'ok' END AS status FROM s)
SELECT status, count(*) AS n, CASE status WHEN 'ok' THEN 'mapped' WHEN 'abstain_reliability' THEN 'no hit passed the reliability gate' ELSE 'too far from every reference' END AS explanation FROM x GROUP BY status""")
def abstention(spark, sf):
    return reports.abstentions(select.summary(_union(spark, sf)))


@query(UNION_SQL + """, s AS (SELECT query_id, min(tier) AS tier, max(CASE WHEN role = 'anchor' THEN genome_id END) AS anchor, count(*) FILTER (disposition = 'selected') AS n_selected, count(*) AS n_hits, max(CASE WHEN role = 'anchor' THEN identity END) AS anchor_identity, max(CASE WHEN role = 'anchor' THEN species END) AS anchor_species FROM u GROUP BY 1)
SELECT o_orderkey AS query_id, CASE WHEN s.query_id IS NULL THEN 'no_hits' WHEN tier = 'below' THEN 'abstain_below_family' WHEN n_selected = 0 THEN 'abstain_reliability' ELSE 'ok' END AS status, tier, anchor, coalesce(n_selected, 0) AS n_selected, anchor_identity, anchor_species, coalesce(n_hits, 0) AS n_hits FROM orders LEFT JOIN s ON o_orderkey = s.query_id""")
def mapping_summary(spark, sf):
    u = _union(spark, sf)
    return reports.mapping(select.summary(u), u, t(spark, sf, "orders").select(F.col("o_orderkey").alias("query_id")))


_PICKED = "SELECT query_id, list(DISTINCT genome_id) FILTER (disposition = 'selected') AS s, max(CASE WHEN role = 'anchor' THEN genome_id END) AS anchor FROM {0} GROUP BY 1"


@query(f"""WITH a AS ({UNION_SQL} SELECT query_id, genome_id, rank, disposition, role FROM u), b AS ({UNION_SQL.replace("bk - identity > 0.0 ", "bk - identity > 0.01 ")} SELECT query_id, genome_id, rank, disposition, role FROM u),
pa AS ({_PICKED.format("a")}), pb AS ({_PICKED.format("b")}), r AS (SELECT query_id, genome_id, min(rank)::BIGINT AS rank FROM b GROUP BY 1, 2),
j AS (SELECT pa.query_id, coalesce(pa.s, []) AS x, coalesce(pb.s, []) AS y, pa.anchor AS anchor_a, pb.anchor AS anchor_b FROM pa JOIN pb USING (query_id))
SELECT j.query_id, len(list_intersect(x, y))::DOUBLE / nullif(len(list_distinct(list_concat(x, y))), 0) AS jaccard, anchor_a IS NOT DISTINCT FROM anchor_b AS same_anchor, r.rank AS anchor_rank, len(x) = 0 AS abstains_a, len(y) = 0 AS abstains_b
FROM j LEFT JOIN r ON r.query_id = j.query_id AND r.genome_id = anchor_a""")
def audits_agree(spark, sf):
    from dataclasses import replace

    h = hit_table(spark, sf)
    return reports.audits_agree(select.union(h), select.union(h, replace(select.EXACT_TIE, window=0.01)))


@query(UNION_SQL + """, sl AS (SELECT query_id, rank, stage, CASE WHEN taxon_id % 20 = query_id % 20 THEN 0 WHEN taxon_id % 5 = query_id % 5 THEN 1 ELSE 2 END AS d FROM u), sb AS (SELECT query_id, arg_min(d, d * 1000 + rank) AS lvl, arg_min(stage, d * 1000 + rank) AS stage FROM sl GROUP BY 1)
SELECT CASE lvl WHEN 0 THEN 'genome' WHEN 1 THEN 'genus' ELSE 'none' END AS level, stage, count(*) AS n FROM sb GROUP BY 1, 2""")
def salvage_levels(spark, sf):
    m = lambda k: F.col("taxon_id") % k == F.col("query_id") % k
    return reports.salvage(_union(spark, sf), {"genome": m(20), "genus": m(5)})


@query(_GENES + "SELECT query_id, CASE WHEN count(genome_id) FILTER (genome_id % 3 <> 0) = 0 THEN 'failed' ELSE 'built' END AS status, count(*) FILTER (genome_id % 3 = 0) AS n_failed FROM chosen GROUP BY query_id")
def function_union_status(spark, sf):
    g, c = _gene_tables(spark, sf)
    fetched = t(spark, sf, "supplier").select(F.col("s_suppkey").alias("genome_id")).where("genome_id % 3 <> 0")
    _, status = reports.function_union(c, g.withColumnRenamed("gene", "function"), fetched)
    return status.select("query_id", "status", F.size("failed").cast("long").alias("n_failed"))


@query("""WITH RECURSIVE o AS (SELECT doc_id, n_chars, row_number() OVER (ORDER BY doc_id) AS i FROM documents),
b AS (SELECT i, doc_id, n_chars, 0 AS batch, n_chars AS held, 1 AS n FROM o WHERE i = 1 UNION ALL
  SELECT o.i, o.doc_id, o.n_chars, b.batch + (b.held + o.n_chars > 50000 OR b.n >= 40)::INTEGER, o.n_chars + CASE WHEN b.held + o.n_chars > 50000 OR b.n >= 40 THEN 0 ELSE b.held END, 1 + CASE WHEN b.held + o.n_chars > 50000 OR b.n >= 40 THEN 0 ELSE b.n END FROM b JOIN o ON o.i = b.i + 1)
SELECT doc_id, n_chars, batch::INTEGER AS batch FROM b""")
def upload_batches(spark, sf):
    d = t(spark, sf, "documents").select("doc_id", "n_chars")
    return reports.upload_batches(d, "doc_id", "n_chars", 50_000, 40)


@query()
def t_intervals(spark, sf):
    from .functions.stats import t_interval

    return t_interval(t(spark, sf, "customer"), ["c_nationkey"], "c_acctbal")


@query()
def bootstrap_interval(spark, sf):
    from .functions.stats import bootstrap_corr

    return bootstrap_corr(t(spark, sf, "part").groupBy("p_brand").agg(F.avg("p_size").alias("x"), F.avg("p_retailprice").alias("y")), "p_brand", "x", "y")


@query()
def cluster_routing(spark, sf):
    """Whether a query's true nearest vector lies in the clusters whose representatives are nearest to it."""
    from .operators import knn

    v = t(spark, sf, "embeddings")
    model, assigned = retrieval.clusters(v, "vec_id", "embedding")
    reps = retrieval.representatives(v, assigned, model, "vec_id", "embedding")
    near = knn.top_k(v, v.join(reps, "vec_id", "left_semi"), "vec_id", "embedding", 10)
    order = near.join(reps.withColumnRenamed("vec_id", "ref_id"), "ref_id").select("query_id", "cluster", "rank")
    return retrieval.routed(_neighbours(spark, sf, 1).select("query_id", "ref_id"), assigned, order, "vec_id")


@query()
def encode_search(spark, sf):
    """Benchmark texts against documents by hashed k-mer vectors, the substitute encoder."""
    from .operators import knn

    q = retrieval.encode(t(spark, sf, "benchmark").select(F.col("item_id").alias("k"), "text"), "text")
    d = retrieval.encode(t(spark, sf, "documents").select(F.col("doc_id").alias("k"), "text"), "text")
    return knn.top_k(q, d, "k", "embedding", 5, skip_self=False)
