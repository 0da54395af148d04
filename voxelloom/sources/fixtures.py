"""Projections of the star-schema tables into scans, points with normals, viewpoints, surfels and poses.

The SQL is FIXTURES.md's; it runs unchanged in Spark and in DuckDB.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Orders in one part of a scan, which one task numbers.
PART = 1024

FIXTURES = {
    "fx_points": (
        "lineitem",
        """
WITH p AS (SELECT l_linenumber AS scan_id,
  row_number() OVER (PARTITION BY l_linenumber ORDER BY l_orderkey,l_partkey,l_suppkey,l_extendedprice,l_quantity,l_shipdate,l_discount,l_tax) AS point_idx,
  CAST(1 + l_partkey % 58 AS INT) AS u0, CAST(1 + l_orderkey % 43 AS INT) AS v0, l_discount AS d FROM {lineitem}),
a AS (SELECT *, -radians(106.0)/2 + u0*radians(106.0)/59 AS yaw0, -radians(86.0)/2 + v0*radians(86.0)/44 AS pitch0,
  CASE WHEN scan_id <= 4 THEN 2.0 ELSE 2.3 END + 0.02*d AS x FROM p)
SELECT scan_id, point_idx, u0, v0, CAST(x AS DOUBLE) AS x, x*tan(yaw0) AS y, sqrt(x*x + x*tan(yaw0)*x*tan(yaw0))*tan(pitch0) AS z FROM a""",
    ),
    "fx_pwn": (
        "lineitem",
        """
SELECT l_linenumber AS scan_id, l_orderkey, l_partkey, l_suppkey,
  CAST(CASE WHEN l_returnflag = 'R' THEN 2.3 ELSE 2.0 END AS DOUBLE) + 0.02*l_discount AS x,
  CAST(l_partkey % 400 AS DOUBLE)*0.01 - 1.995 AS y, CAST(l_orderkey % 250 AS DOUBLE)*0.01 + 0.305 AS z,
  CAST(-1.0 AS DOUBLE) AS nx, CAST(0.0 AS DOUBLE) AS ny, CAST(0.0 AS DOUBLE) AS nz, l_quantity/50.0 AS w FROM {lineitem}""",
    ),
    "fx_viewpoints": (
        "supplier",
        """
SELECT s_suppkey AS vp_id, CAST(s_suppkey % 5 AS DOUBLE)*0.25 - 1.0 AS x, CAST(s_suppkey % 8 AS DOUBLE)*0.4 - 1.4 AS y,
  CAST(s_suppkey % 3 AS DOUBLE)*0.5 + 0.6 AS z, (CAST(s_suppkey % 7 AS DOUBLE) - 3)*0.15 AS yaw FROM {supplier}""",
    ),
    "fx_surfels_b": (
        "part",
        """
SELECT p_partkey AS idx, CAST(2.0 AS DOUBLE) AS cx, CAST(p_partkey % 40 AS DOUBLE)*0.1 - 1.95 AS cy, CAST(floor(p_partkey/40.0) AS DOUBLE)*0.1 + 0.35 AS cz,
  CAST(-1.0 AS DOUBLE)/sqrt(1+pow((CAST(p_partkey % 5 AS DOUBLE)-2)*0.05,2)) AS nx, (CAST(p_partkey % 5 AS DOUBLE)-2)*0.05/sqrt(1+pow((CAST(p_partkey % 5 AS DOUBLE)-2)*0.05,2)) AS ny, CAST(0.0 AS DOUBLE) AS nz,
  CAST(0.0025 AS DOUBLE)*(1+CAST(p_size AS DOUBLE)/50) AS l0, CAST(0.005 AS DOUBLE)*(1+CAST(p_size AS DOUBLE)/50) AS l1, CAST(0.1 AS DOUBLE)+CAST(0.01 AS DOUBLE)*p_size AS confidence FROM {part}""",
    ),
    "fx_pose_events": (
        "events",
        """
SELECT user_id AS drone_id, event_id, ts, value*0.01 AS px, CAST(event_id % 17 AS DOUBLE)*0.1 AS py, CAST(1.5 AS DOUBLE) AS pz, (CAST(event_id % 9 AS DOUBLE)-4)*0.1 AS yaw FROM {events} WHERE event_type = 'view'""",
    ),
    "fx_scan_events": ("events", "SELECT user_id AS drone_id, event_id AS scan_id, ts FROM {events} WHERE event_type = 'purchase'"),
}


NUMBER = re.compile(r"row_number\(\) OVER \(PARTITION BY (\w+) ORDER BY ([\w,]+)\)")


def numbered(rows: DataFrame, by: str, order: list[str], name: str) -> DataFrame:
    """rows with their place, from 1 on, in the order within each value of `by`, as row_number tells it.

    One task would sort a whole value of `by`. Ranges of PART values of the first order column are
    numbered each by itself instead, and begin after the rows of the ranges before them.
    """
    part = F.floor(F.col(order[0]) / PART)
    sizes = rows.groupBy(F.col(by).alias("_by"), part.alias("_at")).agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy("_by").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop("_n")
    own = F.row_number().over(Window.partitionBy(by, "_part").orderBy(*order))
    out = rows.withColumn("_part", part).withColumn("_own", own)
    same = F.col(by).eqNullSafe(F.col("_by")) & F.col("_part").eqNullSafe(F.col("_at"))
    return out.join(sizes, same).withColumn(name, F.col("_own") + F.col("_before")).drop("_part", "_own", "_by", "_at", "_before")


def fixture(spark: SparkSession, sf_dir: str, name: str, stream: bool = False) -> DataFrame:
    """stream: the table's files as a stream (fixtures without windows)."""
    table, sql = FIXTURES[name]
    path = f"{sf_dir}/{table}.parquet"
    rows = spark.read.parquet(path)
    number = NUMBER.search(sql)
    if number:
        rows = numbered(rows, number[1], number[2].split(","), "_number")
        sql = sql.replace(number[0], "_number")
    # A stream's path is a folder or a pattern, and a table may be one file.
    return spark.sql(sql, **{table: spark.readStream.schema(rows.schema).parquet(f"{sf_dir}/{table}.parque[t]") if stream else rows})


def cte(name: str) -> str:
    """The fixture as a named subquery for an engine where the tables are views."""
    table, sql = FIXTURES[name]
    return f"{name} AS ({sql.replace('{' + table + '}', table)})"
