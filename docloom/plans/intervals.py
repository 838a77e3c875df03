"""Queries over intervals: the days that order lines are under way (one for five pieces, from the ship date on), by part and by supplier, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import intervals
from ..sources.tables import table


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = lambda c: F.datediff(F.col(c), F.lit("1970-01-01").cast("date")).cast("long")
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", day("l_shipdate").alias("start"))
    return rows.withColumns({"line": F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"), "stop": F.col("start") + F.ceil(F.col("l_quantity") / 5).cast("long")})


def overlapping_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each order line how many other lines of its part are under way on one of its days, and how many of them all the time."""
    rows = _lines(spark, sf_dir).select("line", "l_partkey", "start", "stop")
    return intervals.overlap_counts(rows, ["l_partkey"], "line")


def clear_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines of a quantity up to 25 whose days meet no line of their part with a greater one."""
    rows = _lines(spark, sf_dir).select("line", "l_partkey", "l_quantity", "start", "stop")
    return intervals.clear_of(rows.where("l_quantity <= 25"), rows.where("l_quantity > 25"), ["l_partkey"], "line").select("line", "l_partkey")


def accepted_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines that a supplier with one van can serve, taken in order of their first day: each that meets none taken before."""
    return intervals.accepted(_lines(spark, sf_dir).select("line", "l_suppkey", "start", "stop"), ["l_suppkey"], "line").select("line", "l_suppkey")


_LINES = "SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS line, l_partkey, l_suppkey, l_quantity, date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE)) AS s, s + CAST(ceil(l_quantity / 5) AS BIGINT) AS e FROM lineitem"
QUERIES = {f.__name__: f for f in (overlapping_lines, clear_lines, accepted_lines)}
ORACLE_SQL = {
    "overlapping_lines": f"""WITH l AS ({_LINES}), p AS (SELECT a.line, b.s <= a.s AND a.e <= b.e AS whole FROM l a JOIN l b ON a.l_partkey = b.l_partkey AND a.line <> b.line AND a.s < b.e AND b.s < a.e)
SELECT i.line, count(p.line) AS n_overlapping, count(*) FILTER (WHERE p.whole) AS n_containing FROM (SELECT DISTINCT line FROM l) i LEFT JOIN p ON i.line = p.line GROUP BY i.line""",
    "clear_lines": f"""WITH l AS ({_LINES}) SELECT line, l_partkey FROM l WHERE l_quantity <= 25 AND NOT EXISTS (SELECT 1 FROM l b WHERE b.l_quantity > 25 AND b.l_partkey = l.l_partkey AND l.s < b.e AND b.s < l.e)""",
    "accepted_lines": f"""WITH RECURSIVE l AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY s, e, line) AS i FROM ({_LINES}) WHERE s < e),
n AS (SELECT a.l_suppkey, a.i, (SELECT min(b.i) FROM l b WHERE b.l_suppkey = a.l_suppkey AND b.s >= a.e) AS j FROM l a),
t AS (SELECT l_suppkey, CAST(1 AS BIGINT) AS i FROM (SELECT DISTINCT l_suppkey FROM l) UNION ALL SELECT n.l_suppkey, n.j FROM t JOIN n ON t.l_suppkey = n.l_suppkey AND t.i = n.i WHERE n.j IS NOT NULL)
SELECT l.line, l.l_suppkey FROM l JOIN t ON l.l_suppkey = t.l_suppkey AND l.i = t.i""",
}
