"""Mixing sources to target weights by systematic sampling.

Every document of a source has the same expected number of copies, target /
source size, as an integer multiple of 2^-24.  Expected copies are prefix-summed
within the source, one offset (from the seed) is added, and the document is
emitted once per integer boundary that its interval crosses.  Documents are
ordered by size class, then by md5 of the id, so the words taken come near the
target.  The prefix sums are windowed in levels (source, size class,
ever longer beginnings of the md5, 256 to a level), so a source with a third of all rows is many small groups.

Targets: sources by code point (null last) have weights that repeat; each gets
its share of the total, at most max_repeat times its own size, and what is over
is shared among the others by weight until none is above.  That fixed point is
computed in one pass: by ascending cap / weight, sources are capped for as long
as the cap is below the level that the rest would get.

Nulls: a null text has size 0; a null source is a source; a null id is ordered
by the md5 of the column `otherwise` (mix() and the query give the text).  Repeated rows are separate documents.  A source of size 0
has target 0 and every document of it no copies.  Empty tables give empty
results.  Extra columns are kept by mix() and ignored by plan().
"""

from __future__ import annotations

from collections.abc import Sequence
from hashlib import md5

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD, prefix_sums, slices, small, stored

#: Expected copies are multiples of 1 / UNIT.
UNIT = 1 << 24


def offset(seed: int) -> int:
    """The random offset in units of 1 / UNIT."""
    return int(md5(f"mix-{seed}".encode()).hexdigest()[:6], 16)


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sized: DataFrame, weights: Sequence[int] = (5, 2, 1), max_repeat: int = 3) -> DataFrame:
    """(source, source_size, target) from rows with source and size."""
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank % len(weights) + 1).cast("int"))
    level = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = level.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    t = sources.withColumn("weight", weight).withColumn("cap", max_repeat * F.col("source_size"))
    t = t.withColumn("left_size", F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0)))
    t = t.withColumn("left_weight", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    t = t.withColumn("level", F.col("left_size") / F.col("left_weight"))
    t = t.withColumn("free", F.col("level") * F.col("weight") < F.col("cap"))
    free = F.min(F.when(F.col("free"), F.col("cap") / F.col("weight"))).over(every)
    final = F.min(F.when(F.col("cap") / F.col("weight") == free, F.col("level"))).over(every)
    capped = free.isNull() | (F.col("cap") / F.col("weight") < free)
    return t.select("source", "source_size", F.when(capped, F.col("cap").cast("double")).otherwise(final * F.col("weight")).alias("target"))


def plan(docs: DataFrame, size: Column, source: Column, doc_id: Column, weights: Sequence[int] = (5, 2, 1), max_repeat: int = 3, seed: int = 1, keep_row: bool = False, otherwise: Column | None = None) -> DataFrame:
    """(doc_id, size, source_size, target, copies, taken) for every row; keep_row adds row, a struct of the row's columns."""
    row = [F.struct("*").alias("row")] if keep_row else []
    other = F.lit("") if otherwise is None else F.coalesce(otherwise.cast("string"), F.lit(""))
    key = F.md5(F.when(doc_id.isNotNull(), doc_id.cast("string")).otherwise(other).cast("binary"))
    sized = docs.select(doc_id.alias("doc_id"), source.cast("string").alias("source"), size.alias("size"), key.alias("key"), *row)
    goal = stored(targets(sized, weights, max_repeat), "targets")
    bits = F.length(F.bin("size"))
    out, beginnings = slices(sized, "key", docs.count())
    out = out.withColumn("size_class", (8 * bits + F.expr("shiftright(size * 8, int(length(bin(size))))")).cast("long"))
    out = out.withColumn("has_source", F.col("source").isNotNull().cast("int")).withColumn("source", F.coalesce("source", F.lit("")))
    goal = goal.withColumn("has_source", F.col("source").isNotNull().cast("int")).withColumn("source", F.coalesce("source", F.lit("")))
    out = out.join(small(goal), ["has_source", "source"])
    rate = F.when(F.col("source_size") > 0, F.floor(F.col("target") * UNIT / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    out = out.withColumn("rate", F.least(rate, F.lit(max_repeat * UNIT)))
    base = ["has_source", "source", "size_class"]
    levels = [base[:2], base, *([*base, *beginnings[: k + 1]] for k in range(len(beginnings)))]
    out = out.withColumn("content", F.xxhash64("row") if keep_row else F.lit(0))  # rows with the same id keep their order in reruns
    out = prefix_sums(out, levels, ["key", "doc_id", "size", "content"], "rate", "before")
    u = F.lit(offset(seed))
    crossed = lambda x: F.shiftright(x + u, 24)
    out = out.withColumn("copies", (crossed(F.col("before") + F.col("rate")) - crossed(F.col("before"))).cast("long"))
    return out.select("doc_id", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), *(["row"] if keep_row else []))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[int] = (5, 2, 1), max_repeat: int = 3, seed: int = 1) -> DataFrame:
    """docs with each row repeated (or left out) as the mix takes it; the same columns."""
    planned = plan(docs, word_count(F.col(text_col)), F.col(source_col), F.col(id_col), weights, max_repeat, seed, keep_row=True, otherwise=F.col(text_col))
    rows = planned.where("copies > 0").select("row", F.explode(F.expr("sequence(1L, copies)")).alias("copy"))
    return rows.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


SQL = f"""
WITH sized AS (
  SELECT doc_id, source, text, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size FROM documents),
sources AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighted AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END::DOUBLE AS weight,
         3 * source_size AS cap FROM sources),
levels AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER b, 0))::DOUBLE
            / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0.0)) AS level
  FROM weighted
  WINDOW b AS (ORDER BY cap::DOUBLE / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
freed AS (SELECT *, min(CASE WHEN level * weight < cap THEN cap::DOUBLE / weight END) OVER () AS free FROM levels),
leveled AS (SELECT *, min(CASE WHEN cap::DOUBLE / weight = free THEN level END) OVER () AS final FROM freed),
goals AS (
  SELECT source, source_size, CASE WHEN free IS NULL OR cap::DOUBLE / weight < free THEN cap::DOUBLE ELSE final * weight END AS target
  FROM leveled),
rated AS (
  SELECT s.doc_id, s.source, s.size, g.source_size, g.target, md5(coalesce(s.doc_id::VARCHAR, s.text, '')) AS key,
         8 * length(bin(s.size)) + ((s.size * 8) >> length(bin(s.size))) AS size_class,
         CASE WHEN g.source_size > 0 THEN least(floor(g.target * {UNIT} / g.source_size)::BIGINT, {3 * UNIT}) ELSE 0 END AS rate
  FROM sized s JOIN goals g ON s.source IS NOT DISTINCT FROM g.source),
summed AS (
  SELECT *, (sum(rate) OVER (PARTITION BY source ORDER BY size_class, key, doc_id, size ROWS UNBOUNDED PRECEDING))::BIGINT AS upto FROM rated)
SELECT doc_id, size, source_size, target,
       ((upto + {offset(1)}) >> 24) - ((upto - rate + {offset(1)}) >> 24) AS copies,
       (((upto + {offset(1)}) >> 24) - ((upto - rate + {offset(1)}) >> 24)) * size AS taken
FROM summed
"""
