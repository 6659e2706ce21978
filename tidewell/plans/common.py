"""What all query modules share: registration, and the DuckDB form of the sources."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

_BAR = "arg_min(p, k) AS open, max(p) AS high, min(p) AS low, arg_max(p, k) AS close, sum(p) AS volume"
BARS = f"""bars AS (SELECT asset_id, date, {_BAR} FROM (
  SELECT 'market' AS asset_id, o_orderdate::DATE AS date, o_totalprice AS p, o_orderkey AS k FROM orders
  UNION ALL SELECT o_orderpriority, o_orderdate::DATE, o_totalprice, o_orderkey FROM orders) GROUP BY asset_id, date)"""
MARKET = BARS.replace("UNION ALL SELECT o_orderpriority, o_orderdate::DATE, o_totalprice, o_orderkey FROM orders", "")
MACRO = """macro AS (SELECT last_day(l_shipdate::DATE) AS date, sum(l_extendedprice * (1 - l_discount)) AS revenue,
  sum(l_quantity) AS quantity, count(*) AS n_lines, (last_day(l_shipdate::DATE) + INTERVAL 30 DAY)::DATE AS available_after
  FROM lineitem GROUP BY 1, 5)"""
#: The windows of a series, as in operators.windows.
S = "PARTITION BY asset_id ORDER BY date"


def r(x: str, scale: str = "1e4") -> str:
    return f"floor(({x}) * {scale} + 0.5) / {scale}"


def query(name: str, sql: str | None = None):
    """Register a query under a name, with the DuckDB SQL of its rows."""

    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return add


def over(frame: str) -> str:
    return f"OVER ({S} {frame})"


def last_rows(n: int) -> str:
    return over(f"ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW")


def rows_before(n: int) -> str:
    return over(f"ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING")
