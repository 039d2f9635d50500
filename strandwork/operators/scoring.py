"""Rank-by-rank scoring, rollups, tests, concordance and genome-identity classes."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import stats


def cell(truth: Column, called: Column) -> Column:
    """True, False, or null where there is no call (or no truth)."""
    blank = lambda c: F.coalesce(c, F.lit("")) == ""
    return F.when(blank(truth) | blank(called), F.lit(None).cast("boolean")).otherwise(truth == called)


def deepest(cells: list[tuple[str, Column]]) -> Column:
    """Name of the last rank of the unbroken run of correct ranks from the top, or none."""
    out, run = F.lit("none"), F.lit(True)
    for name, c in cells:
        run = run & F.coalesce(c, F.lit(False))
        out = F.when(run, F.lit(name)).otherwise(out)
    return out


def first_wrong(cells: list[tuple[str, Column]]) -> Column:
    return F.coalesce(*[F.when(~c, F.lit(n)) for n, c in cells])


def coverage(df: DataFrame, keys: list[str], c: str) -> DataFrame:
    """n, n_called, n_correct, shares and the Wilson interval of correct among all."""
    out = df.groupBy(*keys).agg(F.count("*").alias("n"), F.count(c).alias("n_called"), F.count_if(F.col(c)).alias("n_correct"))
    low, high = stats.wilson(F.col("n_correct"), F.col("n"))
    return out.withColumns({"coverage": F.col("n_called").cast("double") / F.col("n"), "accuracy": stats.ratio(F.col("n_correct"), F.col("n_called")), "low": low, "high": high})


def rolled(df: DataFrame, fixed: list[str], rolled_keys: list[str], c: str) -> DataFrame:
    """coverage() over every combination of the rolled keys and their total, which is called all."""
    grouped = df.cube(*rolled_keys) if not fixed else df.groupingSets([[F.col(k) for k in fixed] + [F.col(k) for k, on in zip(rolled_keys, bits, strict=True) if on] for bits in _masks(len(rolled_keys))], *[F.col(k) for k in [*fixed, *rolled_keys]])
    out = grouped.agg(F.count("*").alias("n"), F.count(c).alias("n_called"), F.count_if(F.col(c)).alias("n_correct"), *[F.grouping(k).alias(f"__{k}") for k in rolled_keys])
    return out.select(*fixed, *[F.when(F.col(f"__{k}") == 1, "all").otherwise(F.col(k).cast("string")).alias(k) for k in rolled_keys], "n", "n_called", "n_correct")


def _masks(n: int) -> list[list[int]]:
    return [[m >> i & 1 for i in range(n)] for m in range(1 << n)]


def paired(df: DataFrame, unit: str, group: str, correct: str) -> DataFrame:
    """For each pair of groups on common units: both, only first, only second, none, and the McNemar p."""
    a, b = df.select(F.col(unit).alias("u"), F.col(group).alias("group_a"), F.col(correct).alias("ca")), df.select(F.col(unit).alias("u"), F.col(group).alias("group_b"), F.col(correct).alias("cb"))
    counts = a.join(b, "u").where("group_a < group_b").groupBy("group_a", "group_b").agg(
        F.count("*").alias("n"), F.count_if(F.col("ca") & F.col("cb")).alias("both"), F.count_if(F.col("ca") & ~F.col("cb")).alias("only_a"), F.count_if(~F.col("ca") & F.col("cb")).alias("only_b")
    )

    @F.pandas_udf("double")
    def p(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([stats.mcnemar_p(int(i), int(j)) for i, j in zip(x, y, strict=True)])

    return counts.withColumn("p", p("only_a", "only_b"))


def holm(df: DataFrame, p: str, keys: list[str], order: list[str]) -> DataFrame:
    """Adds p_holm, the step-down adjusted p within keys; order breaks ties."""
    w = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    o = w.orderBy(p, *order)
    m, i = F.count("*").over(w), F.row_number().over(o)
    return df.withColumn("__a", F.least(F.lit(1.0), (m - i + 1) * F.col(p))).withColumn("p_holm", F.max("__a").over(o.rowsBetween(Window.unboundedPreceding, Window.currentRow))).drop("__a")


def confusion(df: DataFrame, truth: str, called: str) -> DataFrame:
    return df.where(F.col(truth) != F.col(called)).groupBy(truth, called).agg(F.count("*").alias("n"))


def concordance(hits: DataFrame, query: str, agree: Column, weight: Column) -> DataFrame:
    """best, any of the list, and weighted agreement over queries whose truth is known (agree not null)."""
    q = hits.withColumn("agree", agree).withColumn("w", F.coalesce(weight, F.lit(0.0))).groupBy(query).agg(F.bool_or(F.when(F.col("rank") == 1, F.col("agree"))).alias("best"), F.bool_or("agree").alias("some"), F.max("w").alias("w"))
    q = q.where(F.col("best").isNotNull())
    c = F.col("best").cast("int")
    return q.agg(F.count("*").alias("n"), F.avg(c).alias("best"), F.avg(F.col("some").cast("int")).alias("any"), (F.sum(c * F.col("w")) / F.greatest(F.sum("w"), F.lit(1e-9))).alias("weighted"))


def identity_class(ani: Column, passes: Column) -> Column:
    return F.when(ani.isNull(), "no_hit").when(~passes, "low_af").when(ani >= 95, "same_species").when(ani >= 85, "same_genus").otherwise("distant")


def best_genome(hits: DataFrame, query: str, af: str, ani: str, order: str, least: float = 15.0) -> DataFrame:
    """The best hit of each query: those with enough aligned first, then by identity, then input order."""
    h = hits.withColumn("af_pass", F.col(af) >= least)
    w = Window.partitionBy(query).orderBy(F.desc("af_pass"), F.desc(ani), order)
    return h.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def allocate(strata: DataFrame, parent: str, child: str, available: str, total: int) -> DataFrame:
    """Square-root shares of `total` among children of each parent, at most what is available; what is left is filled greedily in order of the fractions."""
    w = Window.partitionBy(parent)
    s = strata.withColumn("root", F.sqrt(F.col(available).cast("double"))).withColumn("share", total * F.col("root") / F.sum("root").over(w))
    s = s.withColumn("base", F.least(F.floor("share"), F.col(available).cast("long"))).withColumn("room", F.col(available).cast("long") - F.col("base"))
    s = s.withColumn("left_over", F.greatest(F.lit(0).cast("long"), total - F.sum("base").over(w)))
    o = w.orderBy(F.desc(F.col("share") - F.floor("share")), child)
    s = s.withColumn("before", F.sum("room").over(o.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("room"))
    extra = F.greatest(F.lit(0).cast("long"), F.least(F.col("room"), F.col("left_over") - F.col("before")))
    return s.select(parent, child, F.col(available).cast("long").alias(available), (F.col("base") + extra).alias("allocated"))


Cells = list[tuple[str, Column]]


def shared_to(cells: Cells) -> Column:
    """Name of the deepest correct rank, whatever is wrong above it; null if none is."""
    return F.coalesce(*[F.when(c, F.lit(n)) for n, c in reversed(cells)])


def _depth(values: list[Column]) -> Column:
    """1-based place of the deepest rank that has a name; null if none has."""
    return F.coalesce(*[F.when(F.coalesce(v, F.lit("")) != "", F.lit(i)) for i, v in reversed(list(enumerate(values, 1)))])


def off_by(cells: Cells, truths: list[Column]) -> Column:
    """For a wrong call, ranks between the truth's depth and the last of the unbroken run of correct ranks."""
    run, right = F.lit(0), F.lit(True)
    for _, c in cells:
        right = right & F.coalesce(c, F.lit(False))
        run = run + right.cast("int")
    return F.when(first_wrong(cells).isNotNull(), _depth(truths) - run)


def overconfident(truths: list[Column], calls: list[Column], ambiguous: str = "AMBIG") -> Column:
    """Whether a name is called at a rank deeper than the truth has."""
    depth, out = _depth(truths), F.lit(False)
    for i, c in enumerate(calls, 1):
        out = out | (F.coalesce(depth < i, F.lit(False)) & ~F.coalesce(c, F.lit("")).isin("", ambiguous))
    return out


def misassigned(cells: Cells, self_found: Column) -> Column:
    """self_displaced (its own source was among the hits), sibling (right at the rank above the first wrong one) or cross_lineage; null if nothing is wrong."""
    kind = F.lit("cross_lineage")
    for (_, above), (name, _) in zip(cells, cells[1:], strict=False):
        kind = F.when((first_wrong(cells) == name) & F.coalesce(above, F.lit(False)), "sibling").otherwise(kind)
    return F.when(first_wrong(cells).isNull(), F.lit(None).cast("string")).when(self_found, "self_displaced").otherwise(kind)


def common_in_all(df: DataFrame, unit: str, group: str) -> DataFrame:
    """n_units, and n_common: units that occur in every group."""
    n = df.agg(F.count_distinct(group).alias("n"))
    per = df.groupBy(unit).agg(F.count_distinct(group).alias("k"))
    return per.join(F.broadcast(n)).agg(F.count("*").alias("n_units"), F.count_if(F.col("k") == F.col("n")).alias("n_common"))  # n is one row


def against(df: DataFrame, levels: dict[str, tuple[str, str]], name: str = "level") -> DataFrame:
    """Per level of (own, reference) names: rows with a blank own name, else a blank reference, else compared, and how many agree."""
    blank = lambda c: F.coalesce(c, F.lit("")) == ""
    long = df.select(F.inline(F.array(*[F.struct(F.lit(k).alias(name), F.col(a).alias("own"), F.col(b).alias("ref")) for k, (a, b) in levels.items()])))
    own, ref = F.col("own"), F.col("ref")
    compared = ~blank(own) & ~blank(ref)
    out = long.groupBy(name).agg(F.count_if(blank(own)).alias("own_blank"), F.count_if(~blank(own) & blank(ref)).alias("ref_blank"), F.count_if(compared).alias("compared"), F.count_if(compared & (own == ref)).alias("agree"))
    return out.withColumn("share", stats.ratio(F.col("agree"), F.col("compared")))


def described(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Count, mean, sample deviation, extremes and quartiles."""
    q = lambda p: F.percentile(value, F.lit(p))
    return df.groupBy(*keys).agg(F.count(value).alias("n"), F.round(F.avg(value), 9).alias("mean"), F.round(F.stddev_samp(value), 9).alias("std"), F.min(value).alias("low"), q(0.25).alias("q1"), q(0.5).alias("median"), q(0.75).alias("q3"), F.max(value).alias("high"))


def known_means(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Greatest value, mean and number of those values that are neither null nor NaN."""
    x = F.nanvl(F.col(value), F.lit(None).cast("double"))
    return df.groupBy(*keys).agg(F.max(x).alias("high"), F.round(F.avg(x), 9).alias("mean"), F.count(x).alias("n"))


def leakage(df: DataFrame, keys: list[str], include: str, exclude: str) -> DataFrame:
    """How much the mean falls once a query's own source is excluded: over resolved rows, and over all with 0 for those without a value."""
    zero = lambda c: F.avg(F.coalesce(c, F.lit(0.0)))
    return df.groupBy(*keys).agg(F.round(F.avg(include) - F.avg(exclude), 9).alias("gap_resolved"), F.round(zero(include) - zero(exclude), 9).alias("gap_population"))


def _largest_remainder(nodes: DataFrame, parents: list[str], child: str, alpha: float, cap_share: float) -> DataFrame:
    """Adds allocated to nodes (available, budget): shares by available^alpha, at most cap_share of the budget; caps give way only when all are reached."""
    w = Window.partitionBy(*parents) if parents else Window.partitionBy(F.lit(0))  # a parent's children
    upto = lambda o: o.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    a, b, zero = F.col("available"), F.col("budget"), F.lit(0).cast("long")
    n = nodes.withColumn("weight", F.pow(a.cast("double"), F.lit(alpha))).withColumn("raw", b * F.col("weight") / F.sum("weight").over(w)).withColumn("cap", F.least(a, F.ceil(b * cap_share)))
    n = n.withColumn("base", F.least(F.floor("raw"), F.col("cap"))).withColumn("room", F.col("cap") - F.col("base")).withColumn("over", b - F.sum("base").over(w))
    by_rest = w.orderBy(F.desc(F.col("raw") - F.floor("raw")), child)
    n = n.withColumn("before", F.sum("room").over(upto(by_rest)) - F.col("room"))
    n = n.withColumn("one", F.col("base") + F.greatest(zero, F.least(F.col("room"), F.col("over") - F.col("before"))))
    # beyond the caps one by one in turn: every child up to a level, and one more for the first ones
    n = n.withColumn("rest", b - F.sum("one").over(w)).withColumn("room", a - F.col("one"))
    by_room = w.orderBy("room", child)
    n = n.withColumn("turn", F.row_number().over(by_room)).withColumn("level", F.floor((F.col("rest") - (F.sum("room").over(upto(by_room)) - F.col("room"))) / (F.count("*").over(w) - F.col("turn") + 1)))
    level = F.min(F.when(F.col("level") < F.col("room"), F.struct("turn", "level"))).over(w)["level"]
    n = n.withColumn("level", F.coalesce(level, F.col("room"))).withColumn("two", F.least("room", "level"))
    n = n.withColumn("rest", F.col("rest") - F.sum("two").over(w)).withColumn("more", F.col("room") > F.col("level"))
    first = F.row_number().over(w.orderBy(F.desc("more"), child))
    extra = (F.col("more") & (first <= F.col("rest"))).cast("long")
    fits = F.sum("available").over(w) <= b
    n = n.withColumn("allocated", F.when(b <= 0, zero).when(fits, a).otherwise(F.col("one") + F.col("two") + extra).cast("long"))
    return n.select(*parents, child, "available", "allocated")


def allocate_tree(leaves: DataFrame, levels: list[str], available: str, budget: int, alpha: float = 0.5, cap_share: float = 0.35) -> DataFrame:
    """Deals a budget down a tree of levels: each node's share is dealt to its children by largest remainders under a cap."""
    out = None
    for i, child in enumerate(levels):
        parents = levels[:i]
        nodes = leaves.groupBy(*parents, child).agg(F.sum(available).cast("long").alias("available"))
        nodes = nodes.withColumn("budget", F.lit(budget).cast("long")) if out is None else nodes.join(out.select(*parents, F.col("allocated").alias("budget")), parents)
        out = _largest_remainder(nodes, parents, child, alpha, cap_share)
    return out


def cell_rate(queries: DataFrame, refs: DataFrame, query: str, ref: str, seconds: float) -> DataFrame:
    """One row: cells of an exhaustive alignment of all queries with all references, and billions of them a second."""
    q = queries.agg(F.coalesce(F.sum(F.length(query)), F.lit(0)).alias("query_letters"), F.count("*").alias("n_queries"))
    r = refs.agg(F.coalesce(F.sum(F.length(ref)), F.lit(0)).alias("ref_letters"), F.count("*").alias("n_refs"))
    cells = F.col("query_letters") * F.col("ref_letters")
    return q.join(F.broadcast(r)).select("n_queries", "n_refs", cells.alias("cells"), (cells / F.lit(seconds) / 1e9).alias("billions_a_second"))  # one row each
