"""Named queries with the SQL that states their expected result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return add


def fin(df: DataFrame, *cols, digits: int = 6) -> DataFrame:
    """Final projection: doubles rounded, negative zero removed."""
    d = df.select(*cols) if cols else df
    return d.select(*[(F.round(c.name, digits) + F.lit(0.0)).alias(c.name) if isinstance(c, T.StructField) and isinstance(c.dataType, T.DoubleType) else F.col(c.name)
                      for c in d.schema.fields])


def r(*cols: str, digits: int = 6) -> str:
    """SQL list rounding the given columns the same way."""
    return ", ".join(f'round("{c}", {digits}) + 0.0 AS "{c}"' for c in cols)


def rx(expr: str, name: str, digits: int = 6) -> str:
    return f"round({expr}, {digits}) + 0.0 AS {name}"


def bars_cte(unit: str = "hour", name: str = "bars") -> str:
    bucket = {"hour": "date_trunc('hour', ts)", "4h": "time_bucket(INTERVAL 4 HOUR, ts, TIMESTAMP '1970-01-01')", "day": "date_trunc('day', ts)",
              "30m": "time_bucket(INTERVAL 30 MINUTE, ts, TIMESTAMP '1970-01-01')"}[unit]
    return f"""{name}_raw AS MATERIALIZED (SELECT symbol, t AS ts, first(p ORDER BY o, id) AS open, max(p) AS high, min(p) AS low,
      last(p ORDER BY o, id) AS close, CAST(count(*) AS DOUBLE) AS volume
      FROM (SELECT event_type AS symbol, {bucket} AS t, ts AS o, event_id AS id, 100 + value AS p FROM events) GROUP BY symbol, t),
    {name} AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS rn, count(*) OVER (PARTITION BY symbol) AS n FROM {name}_raw)"""


def daily_cte(name: str = "bars") -> str:
    return f"""{name}_raw AS MATERIALIZED (SELECT symbol, t AS ts, first(p ORDER BY o, id) AS open, max(p) AS high, min(p) AS low,
      last(p ORDER BY o, id) AS close, CAST(count(*) AS DOUBLE) AS volume
      FROM (SELECT o_orderpriority AS symbol, CAST(date_trunc('day', o_orderdate) AS TIMESTAMP) AS t, o_orderdate AS o, o_orderkey AS id, o_totalprice AS p FROM orders) GROUP BY symbol, t),
    {name} AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS rn, count(*) OVER (PARTITION BY symbol) AS n FROM {name}_raw)"""


OVER = "PARTITION BY symbol ORDER BY rn"


def secs(c: str) -> str:
    return f"(epoch_us({c}) / 1e6)"


def u01(seed: str, *ids: str) -> str:
    parts = ", ".join(f"CAST({i} AS VARCHAR)" for i in ids)
    return f"(CAST('0x' || substr(md5(concat_ws('|', '{seed}', {parts})), 1, 15) AS BIGINT) / {float(16 ** 15)!r})"
