"""Queries against their SQL on keys and sets that the test tables are too small for."""

import random

import duckdb
from pyspark.sql import functions as F

from strandwork import queries_hits, queries_more  # noqa: F401  register their queries
from strandwork.operators import genes
from strandwork.queries import ORACLE_SQL, QUERIES


def same_as_sql(spark, folder, name, tables):
    con = duckdb.connect()
    for table, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{table}.parquet")
        con.sql(f"CREATE OR REPLACE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet/*.parquet'")
    got = QUERIES[name](spark, str(folder))
    columns = ", ".join(f'"{c}"' for c in got.columns)
    want = con.sql(f"SELECT {columns} FROM ({ORACLE_SQL[name]})").fetchall()
    rows = [tuple(r) for r in got.collect()]
    assert sorted(rows, key=repr) == sorted(want, key=repr)
    return rows


def test_pool_misses_with_refs_beyond_a_million(spark, tmp_path):
    """A cent more is worth 10,000 of the ref: the dearer part, with the far larger key, is not the best."""
    rows = [(q, *x) for q in range(20) for x in ((1_200_000, 50.0, 900.02), (6, 49.0, 100.0), (5, 1.0, 900.01))]
    li = spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_quantity double, l_extendedprice double")
    n, _, same_first = same_as_sql(spark, tmp_path, "pool_misses", {"lineitem": li})[0]
    assert n == 20 and same_first < 20


def test_gene_union_counts_by_masks(spark):
    """Repeated rows, null and negative queries, ids across masks, another type, against plain sets."""
    r = random.Random(4)
    chosen = [(r.choice([None, -1, -64, 0, 5, 63, 64, 700, 2**40]), r.choice([None, *range(12)])) for _ in range(150)] * 2
    pairs = [(r.choice([None, *range(12)]), r.choice([None, *range(30)])) for _ in range(200)] * 2
    want = {}
    for q, a in chosen:
        for b, gene in pairs:
            if a is not None and a == b:
                want.setdefault((q, gene), set()).add(a)
    c, g = spark.createDataFrame(chosen, "query_id long, genome_id long"), spark.createDataFrame(pairs, "genome_id long, gene long")
    assert {(x["query_id"], x["gene"]): x["n_genomes"] for x in genes.union(c, g).collect()} == {k: len(v) for k, v in want.items()}
    text = genes.union(c.withColumn("query_id", F.col("query_id").cast("string")), g).collect()
    assert {(x["query_id"], x["gene"]): x["n_genomes"] for x in text} == {(None if q is None else str(q), gene): len(v) for (q, gene), v in want.items()}


def test_gene_union_joins_a_genome_once_a_mask(spark):
    """Fifty queries with all genomes: the join's rows are those of the gene table."""
    c = spark.range(50).withColumnRenamed("id", "query_id").crossJoin(spark.range(40).withColumnRenamed("id", "genome_id"))
    g = spark.range(4000).select((F.col("id") % 40).alias("genome_id"), F.floor(F.col("id") / 40).alias("gene"))
    out = genes.union(c, g)
    assert out.count() == 5000
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "bit_or" in plan and out.where("n_genomes <> 40").isEmpty()


def test_pangenome_equals_its_sql(spark, tmp_path):
    """A null supplier is a genome of the totals, but has no genes."""
    r = random.Random(6)
    li = spark.createDataFrame([(r.randint(0, 150), r.choice([None, *range(60)]), r.choice([None, *range(9)])) for _ in range(900)], "l_orderkey long, l_partkey long, l_suppkey long")
    o = spark.createDataFrame([(k, r.choice([None, *range(200)])) for k in range(150)], "o_orderkey long, o_custkey long")
    for name in ("gene_union", "pangenome"):
        same_as_sql(spark, tmp_path, name, {"lineitem": li, "orders": o})
