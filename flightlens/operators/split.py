"""Time-based splits with proof of partition, and the exact-size seeded sample."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import reliable_checkpoint
from .checks import DataQualityError


def _d(x: str) -> Column:
    return F.lit(x).cast("date")


def time_split(df: DataFrame, split_date: str, date_col: str = "flight_date"):
    """(before, on_or_after); both filters push down to the Parquet scan."""
    d = F.col(date_col)
    return df.filter(d < _d(split_date)), df.filter(d >= _d(split_date))


def split_proof(df: DataFrame, split_date: str, date_col: str = "flight_date") -> DataFrame:
    """One row proving the split: bounds on each side, counts add up, no NULL dates."""
    d = F.col(date_col)
    left, right = d < _d(split_date), d >= _d(split_date)
    return df.agg(
        F.count(F.lit(1)).alias("rows_total"),
        F.count_if(left).alias("rows_before"),
        F.count_if(right).alias("rows_after"),
        F.max(F.when(left, d)).alias("max_before"),
        F.min(F.when(right, d)).alias("min_after"),
        F.count_if(d.isNull()).alias("null_dates"),
    )


def check_split(row, split_date: str) -> None:
    import datetime as dt
    s = dt.date.fromisoformat(split_date)
    problems = []
    if row["max_before"] is not None and not row["max_before"] < s:
        problems.append("rows before the split reach the split date")
    if row["min_after"] is not None and not row["min_after"] >= s:
        problems.append("rows after the split start before it")
    if row["max_before"] is not None and row["min_after"] is not None and not row["max_before"] < row["min_after"]:
        problems.append("date ranges overlap")
    if row["rows_before"] + row["rows_after"] != row["rows_total"]:
        problems.append("counts do not add up")
    if problems:
        raise DataQualityError("split: " + "; ".join(problems))


def window_proof(df: DataFrame, masks: dict[str, Column]) -> DataFrame:
    """Counts per mask plus rows in none / in more than one (exhaustive + disjoint)."""
    hits = sum((F.when(m, F.lit(1)).otherwise(F.lit(0)) for m in masks.values()), F.lit(0))
    return df.agg(
        *[F.count_if(m).alias(f"rows_{k}") for k, m in masks.items()],
        F.count_if(hits == 0).alias("rows_in_none"),
        F.count_if(hits > 1).alias("rows_in_several"),
    )


def check_windows(row, stage: str) -> None:
    if row["rows_in_none"] or row["rows_in_several"]:
        raise DataQualityError(f"{stage}: slices not exhaustive/disjoint "
                               f"(none={row['rows_in_none']}, several={row['rows_in_several']})")


# --- exact-size seeded sample -------------------------------------------------

HOT_COPIES = 1 << 16         # copies of one row written by one record at most


def row_text(df: DataFrame) -> Column:
    """A row as text, the same in any engine: columns in order, joined by ``|``.

    NULL is ``\\N``; a fractional number is its millionths as a whole number
    (rows that differ only beyond that are told apart by their values).
    """
    parts = []
    for f in df.schema.fields:
        c, text = F.col(f.name), F.col(f.name).cast("string")
        if f.dataType.typeName() in ("double", "float"):
            text = F.coalesce((c.cast("double") * F.lit(1e6)).try_cast("decimal(38,0)").cast("string"), text)
        parts.append(F.coalesce(text, F.lit("\\N")))
    return F.concat_ws("|", *parts)


def rank_key(df: DataFrame, seed: int) -> Column:
    """md5 of the seed and the row's text: 32 hex digits."""
    return F.md5(F.concat(F.lit(f"{seed}|"), row_text(df)))


def _unit(key: Column) -> Column:
    """Hex digest -> [0, 1), monotone in the digest (its first 52 bits)."""
    return F.conv(F.substring(key, 1, 13), 16, 10).cast("double") / F.lit(2.0 ** 52)


def _expand(kept: DataFrame, cols: list[str]) -> DataFrame:
    """Each row ``_k`` times; a hot row is cut into chunks that are dealt over the tasks first."""
    def times(df, k):
        return df.select(*cols, F.explode(F.sequence(F.lit(1).cast("bigint"), k)).alias("_i")).select(*cols)
    k = F.col("_k").cast("bigint")
    cool = times(kept.filter(k <= HOT_COPIES), k)
    chunk = F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((k - 1) / HOT_COPIES))).alias("_chunk")
    hot = kept.filter(k > HOT_COPIES).select(*cols, "_k", chunk)
    hot = hot.select(*cols, F.least(F.lit(HOT_COPIES), k - F.col("_chunk") * HOT_COPIES).cast("bigint").alias("_k"))
    return cool.unionByName(times(hot.repartition(hot.sparkSession.sparkContext.defaultParallelism), F.col("_k")))


def exact_sample(df: DataFrame, n: int, seed: int, buckets: int | None = None,
                 oversample: float = 1.1, total: int | None = None) -> DataFrame:
    """Exactly ``min(n, rows)`` rows, the same ones on every run and partitioning.

    Rows are ranked by (md5 of the seed and the row's text, all columns): a
    seeded random permutation that needs no row key and that SQL elsewhere can
    repeat; identical rows are interchangeable, so the chosen multiset is
    unique. The n smallest are found without a global sort of the table:

    1. count rows, unless the caller knows ``total``: then the candidates' scan
       is the only one;
    2. keep candidates whose digest falls in the lowest ~1.1 n/N of the range,
       collapsed to (distinct row, copies) -- partial aggregation first, so a
       row repeated a billion times is one record -- and write them to the
       checkpoint folder (one scan);
    3. histogram the candidate copies into ``buckets`` ranges (about n/50,000
       and 1024 at least; one number each reaches the driver) and find the
       range holding the n-th row;
    4. every candidate of lower ranges, plus the first ones of that range by
       the full key with a running count of copies (~n/buckets distinct rows);
       each kept row is expanded to the number of copies it contributes.
    """
    cols = df.columns
    total = df.count() if total is None else total
    if n >= total:
        return df
    buckets = buckets or max(1024, n // 50_000)
    q = min(1.0, n / total * oversample + 64.0 / total)
    keyed = df.select(*cols, rank_key(df, seed).alias("_h"))
    while True:
        cand = reliable_checkpoint(keyed.filter(_unit(F.col("_h")) <= F.lit(q))
                                   .groupBy("_h", *cols).agg(F.count(F.lit(1)).alias("_c")))
        bucket = F.least(F.floor(_unit(F.col("_h")) / F.lit(q) * F.lit(buckets)),
                         F.lit(buckets - 1)).cast("int")
        cand = cand.withColumn("_b", bucket)
        hist = {r["_b"]: r["cnt"] for r in cand.groupBy("_b").agg(F.sum("_c").alias("cnt")).collect()}
        if sum(hist.values()) >= n or q >= 1.0:
            break
        q = min(1.0, q * 2.0)
    cum, b_star = 0, None
    for b in sorted(hist):
        if cum + hist[b] >= n:
            b_star = b
            break
        cum += hist[b]
    if b_star is None:  # q reached 1: everything is a candidate
        raise DataQualityError("exact_sample: fewer candidate rows than requested")
    need = n - cum
    below = cand.filter(F.col("_b") < b_star).select(*cols, F.col("_c").alias("_k"))
    # the boundary range holds ~n/buckets distinct rows: a window over it is bounded
    w = Window.orderBy(F.col("_h"), *[F.col(c) for c in cols]).rowsBetween(Window.unboundedPreceding, -1)
    edge = (cand.filter(F.col("_b") == b_star)
            .withColumn("_before", F.coalesce(F.sum("_c").over(w), F.lit(0)))
            .filter(F.col("_before") < F.lit(need))
            .select(*cols, F.least(F.col("_c"), F.lit(need) - F.col("_before")).alias("_k")))
    return _expand(below.unionByName(edge), cols)
