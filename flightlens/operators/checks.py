"""Data-quality checks that stop a run.

Each stage gathers all of its checks into ONE aggregation job (a handful of
``count_if``s over the stage output), collects the single result row and
raises on the driver. No ``assert_true`` inside plans: a failed check should
be one clear error, not a storm of task failures.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


class DataQualityError(AssertionError):
    pass


def violation_counts(df: DataFrame, rules: Mapping[str, Column]) -> dict[str, int]:
    """rules: name -> boolean Column that is TRUE for a violating row."""
    if not rules:
        return {}
    aggs = [F.count_if(F.coalesce(c, F.lit(False))).alias(n) for n, c in rules.items()]
    row = df.agg(*aggs).collect()[0]
    return {n: int(row[n]) for n in rules}


def require(df: DataFrame, rules: Mapping[str, Column], stage: str) -> None:
    require_none(violation_counts(df, rules), stage)


def require_none(counts: Mapping[str, int | None], stage: str) -> None:
    """Raise if any of the named violation counts is above zero."""
    bad = {k: v for k, v in counts.items() if v}
    if bad:
        raise DataQualityError(f"{stage}: failed checks {bad}")


# --- rows that break rules, kept as evidence --------------------------------------

@dataclass
class Quarantine:
    """The two sides of a checked table, both written: rows that keep all rules, and the others with the rules they break."""

    good: DataFrame
    bad: DataFrame            # with ``broken_rules``, in the order of the rules
    counts: dict[str, int]    # per rule
    rows_bad: int
    path: str

    def raise_if_any(self, stage: str, show: int = 5) -> None:
        """Stop the run, naming the rules, the side table and its first rows."""
        if self.rows_bad:
            rows = [str(r.asDict()) for r in self.bad.limit(show).collect()]
            raise DataQualityError(f"{stage}: failed checks { {k: v for k, v in self.counts.items() if v} }; "
                                   f"{self.rows_bad} rows in {self.path}, such as " + "; ".join(rows))


def quarantine(df: DataFrame, rules: Mapping[str, Column], path: str) -> Quarantine:
    """Write ``df`` in one pass, rows that break a rule apart from the rest, and count them per rule meanwhile.

    rules: name -> boolean Column that is TRUE for a violating row (null: not
    violated). The counts are taken in the write, without a second scan; a row
    that breaks several rules is one row with several names. The counts of the
    written side table are the ones returned: a repeated task cannot change them.
    """
    spark, seen = df.sparkSession, Observation()
    hit = {n: F.coalesce(c, F.lit(False)) for n, c in rules.items()}
    broken = F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in hit.items()]), lambda x: x.isNotNull()) if hit else \
        F.array().cast("array<string>")
    marked = df.withColumn("broken_rules", broken).withColumn("violating", F.size("broken_rules") > 0)
    marked.observe(seen, F.count_if("violating").alias("bad")).write.mode("overwrite").partitionBy("violating").parquet(path)
    back = spark.read.schema(marked.schema).parquet(path)
    good = back.filter("NOT violating").select(*df.columns)
    bad = back.filter("violating").select(*df.columns, "broken_rules")
    counts, rows_bad = {n: 0 for n in rules}, 0
    if seen.get["bad"]:                 # the folder of the bad rows alone is read
        row = bad.agg(F.count(F.lit(1)).alias("rows"), *[
            F.count_if(F.array_contains("broken_rules", n)).alias(f"rule_{i}") for i, n in enumerate(rules)]).first()
        rows_bad, counts = row["rows"], {n: row[f"rule_{i}"] for i, n in enumerate(rules)}
    return Quarantine(good, bad, counts, rows_bad, path)


def rule_counts(q: Quarantine) -> DataFrame:
    """``rule, n_rows, n_only``: rows per rule, and rows that break no other one."""
    return (q.bad.select(F.explode("broken_rules").alias("rule"), (F.size("broken_rules") == 1).alias("only"))
            .groupBy("rule").agg(F.count(F.lit(1)).alias("n_rows"), F.count_if("only").alias("n_only")))
