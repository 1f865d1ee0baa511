"""Flights-shaped raw table over the shipped TPC-H-shaped test tables.

No flight files ship with the tests, so a raw on-time-performance table
(upper-case source column names, 23 columns) is derived from
lineitem/orders/customer/supplier/part/nation. ``RAW_FLIGHTS_SQL`` is the same
mapping as SQL text for an independent engine (the oracle); both must stay
in step.

Mapping: one lineitem row = one flight. ship date -> flight date, part brand
-> carrier, supplier nation -> origin, customer nation -> destination; line 7
is cancelled, line 6 of an open order is diverted; the delay is a skewed
function of the extended price.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FLIGHT_TABLES = ["lineitem", "orders", "customer", "supplier", "part", "nation"]
TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def raw_flights(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read_table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice",
        "l_linestatus", "l_shipdate")
    orders = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    cust = read_table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    supp = read_table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    part = read_table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    nation = read_table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    origin_n = nation.select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("origin_name"))
    dest_n = nation.select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("dest_name"))

    # the smaller tables meet first: a flight row is moved once for its order and the customer together
    buyers = orders.join(cust, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_nationkey")
    j = (li.join(buyers, li.l_orderkey == buyers.o_orderkey)
           .join(supp, F.col("l_suppkey") == F.col("s_suppkey"))
           .join(part, F.col("l_partkey") == F.col("p_partkey"))
           .join(origin_n, "s_nationkey")
           .join(dest_n, "c_nationkey"))

    price = F.col("l_extendedprice")
    raw = (F.floor(price * price * price / F.lit(5e12)) - F.lit(20)).cast("double")
    line = F.col("l_linenumber")
    is_c = line == F.lit(7)
    is_d = (line == F.lit(6)) & (F.col("l_linestatus") == F.lit("O"))
    gone = is_c | is_d
    pk = F.col("l_partkey")
    crs_dep = F.when(pk % 25 == 24, F.lit(2400)).otherwise((pk % 25) * 100 + line).cast("int")
    dep_delay = raw - F.lit(4.0) + line.cast("double")
    null_d = F.lit(None).cast("double")
    delayed = (~gone) & (raw >= F.lit(15.0))
    half = F.floor(raw / F.lit(2.0)).cast("double")

    return j.select(
        F.col("l_shipdate").cast("date").alias("FL_DATE"),
        F.col("p_brand").alias("OP_UNIQUE_CARRIER"),
        (F.col("l_orderkey") % 10000).cast("int").alias("OP_CARRIER_FL_NUM"),
        F.col("origin_name").alias("ORIGIN"),
        F.col("dest_name").alias("DEST"),
        crs_dep.alias("CRS_DEP_TIME"),
        F.when(is_c, null_d).otherwise((crs_dep % 2400).cast("double")).alias("DEP_TIME"),
        F.when(is_c, null_d).otherwise(dep_delay).alias("DEP_DELAY"),
        F.when(is_c, null_d).otherwise(F.greatest(dep_delay, F.lit(0.0))).alias("DEP_DELAY_NEW"),
        ((crs_dep + 200) % 2400).cast("int").alias("CRS_ARR_TIME"),
        F.when(gone, null_d).otherwise(((crs_dep + 200) % 2400).cast("double")).alias("ARR_TIME"),
        F.when(gone, null_d).otherwise(raw).alias("ARR_DELAY"),
        F.when(gone, null_d).otherwise(F.greatest(raw, F.lit(0.0))).alias("ARR_DELAY_NEW"),
        F.when(is_c, F.lit(1.0)).otherwise(F.lit(0.0)).alias("CANCELLED"),
        F.when(is_c, F.when(F.col("l_orderkey") % 3 == 0, F.lit("A"))
                       .when(F.col("l_orderkey") % 3 == 1, F.lit("B"))
                       .otherwise(F.lit("C"))).alias("CANCELLATION_CODE"),
        F.when(is_d, F.lit(1.0)).otherwise(F.lit(0.0)).alias("DIVERTED"),
        F.when(gone, null_d).otherwise((pk % 2500).cast("double") * F.lit(0.125) + F.lit(20.0)).alias("AIR_TIME"),
        (F.lit(50) + pk % 2500).cast("double").alias("DISTANCE"),
        F.when(delayed, half).otherwise(null_d).alias("CARRIER_DELAY"),
        F.when(delayed, F.lit(0.0)).otherwise(null_d).alias("WEATHER_DELAY"),
        F.when(delayed, raw - half).otherwise(null_d).alias("NAS_DELAY"),
        F.when(delayed, F.lit(0.0)).otherwise(null_d).alias("SECURITY_DELAY"),
        F.when(delayed, F.lit(0.0)).otherwise(null_d).alias("LATE_AIRCRAFT_DELAY"),
    )


# The same mapping for the oracle engine (tables registered under their own names).
RAW_FLIGHTS_SQL = """
SELECT
  CAST(l.l_shipdate AS DATE) AS FL_DATE,
  p.p_brand AS OP_UNIQUE_CARRIER,
  CAST(l.l_orderkey % 10000 AS INTEGER) AS OP_CARRIER_FL_NUM,
  sn.n_name AS ORIGIN,
  cn.n_name AS DEST,
  CAST(CASE WHEN l.l_partkey % 25 = 24 THEN 2400 ELSE (l.l_partkey % 25) * 100 + l.l_linenumber END AS INTEGER) AS CRS_DEP_TIME,
  CASE WHEN l.l_linenumber = 7 THEN NULL
       ELSE CAST((CASE WHEN l.l_partkey % 25 = 24 THEN 2400 ELSE (l.l_partkey % 25) * 100 + l.l_linenumber END) % 2400 AS DOUBLE) END AS DEP_TIME,
  CASE WHEN l.l_linenumber = 7 THEN NULL
       ELSE CAST(floor(l.l_extendedprice * l.l_extendedprice * l.l_extendedprice / CAST(5e12 AS DOUBLE)) - 20 AS DOUBLE) - 4.0 + CAST(l.l_linenumber AS DOUBLE) END AS DEP_DELAY,
  CASE WHEN l.l_linenumber = 7 THEN NULL
       ELSE greatest(CAST(floor(l.l_extendedprice * l.l_extendedprice * l.l_extendedprice / CAST(5e12 AS DOUBLE)) - 20 AS DOUBLE) - 4.0 + CAST(l.l_linenumber AS DOUBLE), CAST(0 AS DOUBLE)) END AS DEP_DELAY_NEW,
  CAST(((CASE WHEN l.l_partkey % 25 = 24 THEN 2400 ELSE (l.l_partkey % 25) * 100 + l.l_linenumber END) + 200) % 2400 AS INTEGER) AS CRS_ARR_TIME,
  CASE WHEN l.l_linenumber = 7 OR (l.l_linenumber = 6 AND l.l_linestatus = 'O') THEN NULL
       ELSE CAST(((CASE WHEN l.l_partkey % 25 = 24 THEN 2400 ELSE (l.l_partkey % 25) * 100 + l.l_linenumber END) + 200) % 2400 AS DOUBLE) END AS ARR_TIME,
  CASE WHEN l.l_linenumber = 7 OR (l.l_linenumber = 6 AND l.l_linestatus = 'O') THEN NULL
       ELSE CAST(floor(l.l_extendedprice * l.l_extendedprice * l.l_extendedprice / CAST(5e12 AS DOUBLE)) - 20 AS DOUBLE) END AS ARR_DELAY,
  CASE WHEN l.l_linenumber = 7 OR (l.l_linenumber = 6 AND l.l_linestatus = 'O') THEN NULL
       ELSE greatest(CAST(floor(l.l_extendedprice * l.l_extendedprice * l.l_extendedprice / CAST(5e12 AS DOUBLE)) - 20 AS DOUBLE), CAST(0 AS DOUBLE)) END AS ARR_DELAY_NEW,
  CASE WHEN l.l_linenumber = 7 THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS CANCELLED,
  CASE WHEN l.l_linenumber = 7 THEN (CASE l.l_orderkey % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'B' ELSE 'C' END) END AS CANCELLATION_CODE,
  CASE WHEN l.l_linenumber = 6 AND l.l_linestatus = 'O' THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS DIVERTED,
  CASE WHEN l.l_linenumber = 7 OR (l.l_linenumber = 6 AND l.l_linestatus = 'O') THEN NULL
       ELSE CAST(l.l_partkey % 2500 AS DOUBLE) * 0.125 + 20.0 END AS AIR_TIME,
  CAST(50 + l.l_partkey % 2500 AS DOUBLE) AS DISTANCE,
  CASE WHEN NOT (l.l_linenumber = 7 OR (l.l_linenumber = 6 AND l.l_linestatus = 'O'))
        AND CAST(floor(l.l_extendedprice * l.l_extendedprice * l.l_extendedprice / CAST(5e12 AS DOUBLE)) - 20 AS DOUBLE) >= 15
       THEN CAST(floor(CAST(floor(l.l_extendedprice * l.l_extendedprice * l.l_extendedprice / CAST(5e12 AS DOUBLE)) - 20 AS DOUBLE) / 2.0) AS DOUBLE) END AS CARRIER_DELAY,
  CASE WHEN NOT (l.l_linenumber = 7 OR (l.l_linenumber = 6 AND l.l_linestatus = 'O'))
        AND CAST(floor(l.l_extendedprice * l.l_extendedprice * l.l_extendedprice / CAST(5e12 AS DOUBLE)) - 20 AS DOUBLE) >= 15
       THEN CAST(0 AS DOUBLE) END AS WEATHER_DELAY,
  CASE WHEN NOT (l.l_linenumber = 7 OR (l.l_linenumber = 6 AND l.l_linestatus = 'O'))
        AND CAST(floor(l.l_extendedprice * l.l_extendedprice * l.l_extendedprice / CAST(5e12 AS DOUBLE)) - 20 AS DOUBLE) >= 15
       THEN CAST(floor(l.l_extendedprice * l.l_extendedprice * l.l_extendedprice / CAST(5e12 AS DOUBLE)) - 20 AS DOUBLE)
            - CAST(floor(CAST(floor(l.l_extendedprice * l.l_extendedprice * l.l_extendedprice / CAST(5e12 AS DOUBLE)) - 20 AS DOUBLE) / 2.0) AS DOUBLE) END AS NAS_DELAY,
  CASE WHEN NOT (l.l_linenumber = 7 OR (l.l_linenumber = 6 AND l.l_linestatus = 'O'))
        AND CAST(floor(l.l_extendedprice * l.l_extendedprice * l.l_extendedprice / CAST(5e12 AS DOUBLE)) - 20 AS DOUBLE) >= 15
       THEN CAST(0 AS DOUBLE) END AS SECURITY_DELAY,
  CASE WHEN NOT (l.l_linenumber = 7 OR (l.l_linenumber = 6 AND l.l_linestatus = 'O'))
        AND CAST(floor(l.l_extendedprice * l.l_extendedprice * l.l_extendedprice / CAST(5e12 AS DOUBLE)) - 20 AS DOUBLE) >= 15
       THEN CAST(0 AS DOUBLE) END AS LATE_AIRCRAFT_DELAY
FROM lineitem l
JOIN orders o ON l.l_orderkey = o.o_orderkey
JOIN customer c ON o.o_custkey = c.c_custkey
JOIN supplier s ON l.l_suppkey = s.s_suppkey
JOIN part p ON l.l_partkey = p.p_partkey
JOIN nation sn ON s.s_nationkey = sn.n_nationkey
JOIN nation cn ON c.c_nationkey = cn.n_nationkey
"""
