"""Train-only profile: coverage, target distribution, group rates, airport
coverage, distance, class balance. Every table is one or two aggregation
jobs over the (pruned) train table; only fixed-size results (a handful of
quantiles, at most a few hundred level counts) ever reach the driver.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as C
from ..session import reliable_checkpoint
from .checks import DataQualityError
from .evaluate import descending_prefix_sums


def level_totals(df: DataFrame, cols: Sequence[str]) -> dict[str, int]:
    """Distinct non-null values per column, from one GROUPING SETS count.

    The scan expands to one narrow row per column, collapsed map-side, where
    several ``count_distinct`` would carry every other aggregate along.
    """
    g = df.select(*cols).groupingSets([[F.col(c)] for c in cols], *cols).agg(F.grouping_id().alias("_gid"))
    gid = [int("".join("0" if j == i else "1" for j in range(len(cols))), 2) for i in range(len(cols))]
    row = g.agg(*[F.count_if((F.col("_gid") == k) & F.col(c).isNotNull()).alias(c) for c, k in zip(cols, gid)]).collect()[0]
    return {c: int(row[c]) for c in cols}


def _level_columns(df: DataFrame) -> list[Column]:
    n = level_totals(df, ("airline", "origin", "dest"))
    return [F.lit(n[c]).cast("bigint").alias(a)
            for c, a in (("airline", "n_airlines"), ("origin", "n_origins"), ("dest", "n_dests"))]


def coverage(df: DataFrame) -> DataFrame:
    base = df.agg(F.count(F.lit(1)).alias("n_rows"), F.min("flight_date").alias("min_date"),
                  F.max("flight_date").alias("max_date"))
    return base.select("*", *_level_columns(df))


def _pct_name(p: float) -> str:
    return "p" + (f"{p:g}".replace(".", "_"))


def exact_quantiles(df: DataFrame, col: str | Column, probs: Sequence[float]) -> list[float | None]:
    """Quantiles with linear interpolation between order statistics, whatever the number of distinct values.

    Rows collapse to (value, count), partial sums first; a distributed prefix
    sum of the counts places every value, and one aggregation picks the order
    statistics at floor and ceil of (n - 1) * p. Only those numbers reach the
    driver; no task holds the column's values.
    """
    x = (F.col(col) if isinstance(col, str) else col).cast("double")
    counts = reliable_checkpoint(df.select((-x).alias("score")).filter("score IS NOT NULL")
                                 .groupBy("score").agg(F.count(F.lit(1)).alias("n")))
    total = counts.agg(F.sum("n")).collect()[0][0]
    if not total:
        return [None] * len(probs)
    at = sorted({k for p in probs for k in (math.floor((total - 1) * p), math.ceil((total - 1) * p))})
    placed = descending_prefix_sums(counts, ["n"])       # descending -x: ascending x
    row = placed.agg(*[F.max(F.when(F.col("cum_n") > k, F.col("score"))).alias(f"v{i}") for i, k in enumerate(at)]).collect()[0]
    value = {k: -row[f"v{i}"] + 0.0 for i, k in enumerate(at)}
    out = []
    for p in probs:
        h = (total - 1) * p
        lo, hi = value[math.floor(h)], value[math.ceil(h)]
        out.append(lo + (hi - lo) * (h - math.floor(h)))
    return out


def _quantile_columns(df: DataFrame, col: str, levels_pct: Sequence[float]) -> list[Column]:
    levels = sorted(set([25.0, 50.0, 75.0] + [float(p) for p in levels_pct]))
    return [F.lit(q).cast("double").alias(_pct_name(p))
            for p, q in zip(levels, exact_quantiles(df, col, [p / 100.0 for p in levels]))]


def describe(df: DataFrame, col: str = "arr_delay",
             levels_pct: Sequence[float] = C.QUANTILE_LEVELS_PCT) -> DataFrame:
    """count, mean, sample std, min, quartiles, max and the extra percentiles (exact)."""
    base = df.agg(
        F.count(col).alias("count"),
        F.avg(col).alias("mean"),
        F.stddev_samp(col).alias("std"),
        F.min(col).alias("min"),
        F.max(col).alias("max"),
    )
    return base.select("*", *_quantile_columns(df, col, levels_pct))


def target_shares(df: DataFrame, col: str = "arr_delay") -> DataFrame:
    x = F.col(col)
    pct = lambda c: F.avg(c.cast("double")) * F.lit(100.0)
    return df.agg(
        pct(x < 0).alias("pct_early"),
        pct(x == 0).alias("pct_on_time"),
        pct(x > 0).alias("pct_late"),
        pct(F.col("is_delayed")).alias("pct_delayed15"),
        F.count_if(x > 0).alias("n_late"),
    )


def top_levels(df: DataFrame, col: str, n: int) -> list:
    """The n most frequent levels (ties broken by the level): at most n values."""
    rows = (df.groupBy(col).agg(F.count(F.lit(1)).alias("_n"))
            .orderBy(F.col("_n").desc(), F.col(col)).limit(n).collect())
    return [r[col] for r in rows]


def all_levels_by_count(df: DataFrame, col: str) -> list:
    """Every level of a factor, most frequent first (ties by level).

    A factor's level list is model metadata and must be complete: the design
    has a column for each level, so whoever fits it can hold the list.
    """
    counts = df.groupBy(col).agg(F.count(F.lit(1)).alias("_n"))
    return [r[col] for r in counts.orderBy(F.col("_n").desc(), F.col(col)).collect()]


def level_counts(df: DataFrame, col: str) -> DataFrame:
    """Value counts, most frequent first, ties by the level (one grouped count)."""
    return df.groupBy(col).agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), F.col(col))


def airport_coverage(df: DataFrame, cols: Sequence[str] = ("origin", "dest"),
                     top_ns: Sequence[int] = C.COVERAGE_TOP_NS) -> DataFrame:
    """Share of flights covered by the top-N airports, N in top_ns.

    One scan: GROUPING SETS give the per-airport counts of every column at
    once; a rank window then runs over those per-airport rows (partitioned by
    column, a few hundred rows each) and one conditional aggregate gives the
    covered count for every N -- no join, no second scan.
    """
    cols = list(cols)
    g = (df.select(*cols).groupingSets([[F.col(c)] for c in cols], *cols)
         .agg(F.grouping_id().alias("_gid"), F.count(F.lit(1)).alias("n")))
    feature, level = F.lit(None).cast("string"), F.lit(None).cast("string")
    for i, c in enumerate(cols):
        gid = int("".join("0" if j == i else "1" for j in range(len(cols))), 2)
        feature = F.when(F.col("_gid") == gid, F.lit(c)).otherwise(feature)
        level = F.when(F.col("_gid") == gid, F.col(c)).otherwise(level)
    counts = g.select(feature.alias("feature"), level.alias("level"), "n")
    ranked = counts.withColumn("rk", F.row_number().over(
        Window.partitionBy("feature").orderBy(F.col("n").desc(), F.col("level"))))
    per = ranked.groupBy("feature").agg(
        F.count(F.lit(1)).alias("n_levels"), F.sum("n").alias("total"),
        *[F.sum(F.when(F.col("rk") <= t, F.col("n")).otherwise(0)).alias(f"_c{t}") for t in top_ns])
    tops = F.explode(F.array(*[F.struct(F.lit(t).alias("top_n"), F.col(f"_c{t}").alias("covered"))
                               for t in top_ns])).alias("_t")
    out = per.select("feature", "n_levels", "total", tops)
    return out.select("feature", F.col("_t.top_n").alias("top_n"), "n_levels",
                      F.col("_t.covered").cast("bigint").alias("covered"), "total",
                      (F.col("_t.covered") / F.col("total") * F.lit(100.0)).alias("pct"))


def distance_correlation(df: DataFrame) -> DataFrame:
    return df.agg(
        F.corr("distance", "arr_delay").alias("corr_arr_delay"),
        F.corr(F.col("distance"), F.col("is_delayed").cast("int").cast("double")).alias("corr_is_delayed"),
    )


def quantile_edges(df: DataFrame, col: str, k: int) -> list[float]:
    return exact_quantiles(df, col, [i / k for i in range(k + 1)])


def quantile_bin(x: Column, edges: Sequence[float], labels: Sequence[str]) -> Column:
    """qcut-style: first bin closed on both sides, the rest right-closed."""
    expr = F.when(x.isNull() | (x < F.lit(edges[0])), F.lit(None).cast("string"))
    for e, lab in zip(edges[1:], labels):
        expr = expr.when(x <= F.lit(e), F.lit(lab))
    return expr.otherwise(F.lit(None).cast("string"))


def distance_quintiles(df: DataFrame, labels: Sequence[str] = C.QUINTILE_LABELS) -> DataFrame:
    edges = quantile_edges(df, "distance", len(labels))
    if None in edges or any(b <= a for a, b in zip(edges, edges[1:])):
        raise DataQualityError(f"quintile edges are not unique: {edges}")
    b = quantile_bin(F.col("distance"), edges, labels)
    return (df.groupBy(b.alias("quintile"))
            .agg(F.count(F.lit(1)).alias("n"),
                 F.avg(F.col("is_delayed").cast("double")).alias("delay_rate"),
                 F.avg("arr_delay").alias("mean_arr_delay"),
                 F.min("distance").alias("distance_min"),
                 F.max("distance").alias("distance_max"))
            .filter(F.col("quintile").isNotNull()))


def histograms(df: DataFrame, specs: dict[str, tuple[str | Column, int, Column | None]]) -> DataFrame:
    """Equal-width histograms of several columns at once: ``histogram, bin, bin_lo, bin_hi, n``.

    ``specs``: name -> (column, number of bins, row filter or None). Each is
    over its own [min, max]: edges are lo + i*(hi-lo)/bins with the last edge
    exactly hi; a value goes to the bin whose [edge_i, edge_i+1) holds it, the
    last bin is closed. Two passes for all of them: min/max, then one grouped
    count. All bins are returned, empty ones with 0; without any value they
    lie over [0, 1].
    """
    names = list(specs)
    values = []
    for name in names:
        col, _, keep = specs[name]
        x = (F.col(col) if isinstance(col, str) else col).cast("double")
        values.append((x if keep is None else F.when(keep, x)).alias(name))
    vals = df.select(*values)
    mm = vals.agg(*[f(n).alias(f"{k}_{i}") for i, n in enumerate(names) for k, f in (("lo", F.min), ("hi", F.max))]).collect()[0]
    grids = []
    for i, name in enumerate(names):
        lo, hi = (0.0, 1.0) if mm[f"lo_{i}"] is None else (mm[f"lo_{i}"], mm[f"hi_{i}"])
        if lo == hi:
            lo, hi = lo - 0.5, hi + 0.5
        bins = specs[name][1]
        step = (hi - lo) / bins
        grids.append((name, lo, hi, bins, [*(float(k) * step + lo for k in range(bins)), hi]))
    # each value once: its histogram, bin count, range and edges ride along as literals
    one = F.explode(F.array(*[F.struct(F.lit(i).alias("h"), F.col(g[0]).alias("v")) for i, g in enumerate(grids)]))
    long = vals.select(one.alias("x")).select("x.*").filter(F.col("v").isNotNull())

    def pick(values):
        out = F.lit(values[0])
        for i, v in enumerate(values[1:], 1):
            out = F.when(F.col("h") == i, F.lit(v)).otherwise(out)
        return out

    edges = F.array(*[F.array(*[F.lit(e) for e in g[4]]) for g in grids])
    lo, width, bins = (pick([f(g) for g in grids]) for f in (lambda g: g[1], lambda g: g[2] - g[1], lambda g: float(g[3])))
    # guess, then step at most one bin down or up; each step is a column of its own
    long = long.withColumn("last", pick([g[3] - 1 for g in grids]))
    long = long.withColumn("b", F.least(F.floor((F.col("v") - lo) / width * bins).cast("int"), F.col("last")))
    long = long.withColumn("e", F.get(edges, F.col("h")))
    long = long.withColumn("b", F.when(F.col("v") < F.get("e", F.col("b")), F.col("b") - 1).otherwise(F.col("b")))
    long = long.withColumn("b", F.when((F.col("b") < F.col("last")) & (F.col("v") >= F.get("e", F.col("b") + 1)),
                                       F.col("b") + 1).otherwise(F.col("b")))
    counts = long.groupBy("h", "b").agg(F.count(F.lit(1)).alias("n"))
    grid = df.sparkSession.createDataFrame(
        [(i, g[0], k, g[4][k], g[4][k + 1]) for i, g in enumerate(grids) for k in range(g[3])],
        "h int, histogram string, bin int, bin_lo double, bin_hi double")
    return (grid.join(counts.withColumnRenamed("b", "bin"), ["h", "bin"], "left")
            .select("histogram", "bin", "bin_lo", "bin_hi", F.coalesce("n", F.lit(0)).cast("bigint").alias("n")))


def histogram(df: DataFrame, col: str | Column, bins: int) -> DataFrame:
    """One equal-width histogram: ``bin, bin_lo, bin_hi, n`` (see ``histograms``)."""
    return histograms(df, {"v": (col, bins, None)}).drop("histogram")


def delay_histograms(df: DataFrame) -> DataFrame:
    """The four delay histograms of the profile in two passes."""
    x, (lo, hi) = F.col("arr_delay"), C.ZOOM_RANGE
    return histograms(df, {"arr_delay": (x, C.HIST_BINS, None), "arr_delay_zoom": (x, C.ZOOM_BINS, x.between(lo, hi)),
                           "late": (x, C.HIST_BINS, x > 0), "late_log": (F.when(x > 0, F.log(x)), C.HIST_BINS, x > 0)})


def class_balance(df: DataFrame, label: str = "is_delayed") -> DataFrame:
    y = F.col(label)
    return df.agg(
        F.avg(y.cast("double")).alias("positive_rate"),
        F.count_if(y).alias("n_pos"),
        F.count_if(~y).alias("n_neg"),
    ).withColumn("no_skill_pr_auc", F.col("positive_rate"))


def train_profile_one_pass(df: DataFrame, col: str = "arr_delay",
                           levels_pct: Sequence[float] = C.QUANTILE_LEVELS_PCT) -> DataFrame:
    """Coverage, describe + quantiles, target shares, class balance and the
    distance correlations: one plain aggregation, one level count, one value count."""
    x, y = F.col(col), F.col("is_delayed")
    pct = lambda c: F.avg(c.cast("double")) * F.lit(100.0)
    row = df.agg(
        F.count(F.lit(1)).alias("n_rows"), F.min("flight_date").alias("min_date"),
        F.max("flight_date").alias("max_date"),
        F.count(col).alias("count"), F.avg(col).alias("mean"), F.stddev_samp(col).alias("std"),
        F.min(col).alias("min"), F.max(col).alias("max"),
        pct(x < 0).alias("pct_early"), pct(x == 0).alias("pct_on_time"), pct(x > 0).alias("pct_late"),
        pct(y).alias("pct_delayed15"), F.count_if(x > 0).alias("n_late"),
        F.avg(y.cast("double")).alias("positive_rate"), F.count_if(y).alias("n_pos"), F.count_if(~y).alias("n_neg"),
        F.corr("distance", col).alias("corr_arr_delay"),
        F.corr(F.col("distance"), y.cast("int").cast("double")).alias("corr_is_delayed"),
    )
    return row.select("*", *_level_columns(df), *_quantile_columns(df, col, levels_pct))
