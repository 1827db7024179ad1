"""Bar sources: ticks to bars, canonical columns, upserts, fallbacks, cleaning."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.blocks import close_blocks, index_rows, open_blocks, block_window, running, span

BAR_SCHEMA = T.StructType([
    T.StructField("symbol", T.StringType(), False), T.StructField("ts", T.TimestampNTZType(), False),
    *[T.StructField(c, T.DoubleType()) for c in ("open", "high", "low", "close", "volume")]])
OHLCV = ["open", "high", "low", "close", "volume"]

# Interval names and their length in seconds.
INTERVAL_SECONDS = {"1m": 60, "5m": 300, "15m": 900, "30m": 1800, "1h": 3600, "4h": 14400,
                    "1d": 86400, "1w": 604800}


def seconds(ts: Column) -> Column:
    """Seconds since the epoch as a double (timestamps are read as UTC)."""
    return F.unix_micros(ts.cast("timestamp")) / F.lit(1e6)


def floor_ts(ts: Column, interval: str) -> Column:
    step = INTERVAL_SECONDS[interval]
    secs = F.floor(F.unix_seconds(ts.cast("timestamp")) / step) * step
    return F.timestamp_seconds(secs).cast("timestamp_ntz")


def number_or_null(c: Column) -> Column:
    """A double in which not-a-number is missing."""
    c = c.cast("double")
    return F.when(~F.isnan(c), c)


def make_bars(df: DataFrame, key: str, ts: str, price: Column, interval: str,
              qty: Column | None = None, tiebreak: str | None = None) -> DataFrame:
    """Ticks to OHLCV bars in one hash aggregation (partial sums run before the shuffle).

    Open and close are the first and last priced tick by ``(ts, tiebreak)``; not-a-number is missing.
    """
    ordr = F.struct(ts, tiebreak) if tiebreak else F.col(ts)
    d = df.select(F.col(key).cast("string").alias("symbol"), floor_ts(F.col(ts), interval).alias("_t"),
                  ordr.alias("_ord"), number_or_null(price).alias("_p"),
                  number_or_null(qty if qty is not None else F.lit(1.0)).alias("_q"))
    priced = F.col("_p").isNotNull()
    return (d.groupBy("symbol", F.col("_t").alias("ts"))
             .agg(F.min_by("_p", F.when(priced, F.col("_ord"))).alias("open"), F.max("_p").alias("high"),
                  F.min("_p").alias("low"), F.max_by("_p", F.when(priced, F.col("_ord"))).alias("close"),
                  F.sum("_q").alias("volume")))


def month_bucket(ts: str = "ts") -> list[Column]:
    return [F.year(ts) * 100 + F.month(ts)]


def number_bars(bars: DataFrame, key: Sequence[str] = ("symbol",), total: str | None = None) -> DataFrame:
    """Add ``rn``; a bar is unique per key and time, so one month of bars is a bounded group."""
    return index_rows(bars, list(key), ["ts"], month_bucket(), total=total)


def canonical_bars(df: DataFrame, mapping: dict[str, str], ts_unit: str = "ms",
                   key: Sequence[str] = ("symbol",)) -> DataFrame:
    """Rename raw columns, turn epochs into timestamps, cast, keep the first row per time."""
    cols = {out: F.col(raw) for raw, out in mapping.items()}
    if ts_unit == "ms":
        cols["ts"] = F.timestamp_millis(cols["ts"]).cast("timestamp_ntz")
    elif ts_unit == "s":
        cols["ts"] = F.timestamp_seconds(cols["ts"]).cast("timestamp_ntz")
    keep = [*key, "ts", *OHLCV]
    extra = [c for c in cols if c not in keep]
    d = df.select(*[number_or_null(cols[c]).alias(c) if c in OHLCV else cols[c].alias(c)
                    for c in [*keep, *extra]])
    first = F.min_by(F.struct(*OHLCV), F.struct(*extra) if extra else F.struct(*OHLCV))
    return d.groupBy(*key, "ts").agg(first.alias("_b")).select(*key, "ts", "_b.*")


def scan_bars(df: DataFrame, symbol: str | None = None, source: str | None = None,
              start: str | None = None, end: str | None = None) -> DataFrame:
    """Filters are plain comparisons, so they reach the parquet scan."""
    if symbol is not None:
        df = df.filter(F.col("symbol") == symbol)
    if source is not None:
        df = df.filter(F.col("source") == source)
    if start is not None:
        df = df.filter(F.col("ts") >= F.lit(start).cast("timestamp_ntz"))
    if end is not None:
        df = df.filter(F.col("ts") <= F.lit(end).cast("timestamp_ntz"))
    return df


def coverage(df: DataFrame, start: str, end: str, slack_days: int = 5) -> DataFrame:
    """Does the stored range of each symbol cover the request, give or take some days?"""
    lo, hi = F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz")
    slack = F.expr(f"INTERVAL {int(slack_days)} DAYS")
    return (df.groupBy("symbol").agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
              .withColumn("covered", (F.col("first_ts") <= lo + slack) & (F.col("last_ts") >= hi - slack)))


def upsert_bars(old: DataFrame, new: DataFrame, nk: Sequence[str] = ("symbol", "ts", "source")) -> DataFrame:
    """New rows replace stored rows with the same natural key (one aggregation, no join)."""
    u = old.withColumn("_v", F.lit(0)).unionByName(new.withColumn("_v", F.lit(1)))
    rest = [c for c in old.columns if c not in nk]
    return u.groupBy(*nk).agg(F.max_by(F.struct(*rest), "_v").alias("_r")).select(*nk, "_r.*")


def backfill(primary: DataFrame, secondary: DataFrame, start: str, min_gap_days: int = 30) -> DataFrame:
    """Prepend secondary bars, marked synthetic, where the primary source starts too late."""
    first = primary.groupBy("symbol").agg(F.min("ts").alias("_first"))
    late = first.filter(F.col("_first") > F.lit(start).cast("timestamp_ntz")
                        + F.expr(f"INTERVAL {int(min_gap_days)} DAYS"))
    older = (secondary.join(late, "symbol").filter(F.col("ts") < F.col("_first"))
             .filter(F.col("ts") >= F.lit(start).cast("timestamp_ntz")).drop("_first"))
    return (primary.withColumn("synthetic", F.lit(False))
            .unionByName(older.withColumn("synthetic", F.lit(True))))


def first_source(df: DataFrame, priority: Sequence[str], min_rows: int) -> DataFrame:
    """Keep, per symbol, the first source in ``priority`` that has at least ``min_rows`` bars."""
    rank = F.array_position(F.array(*[F.lit(p) for p in priority]), F.col("source"))
    ok = (df.groupBy("symbol", "source").agg(F.count(F.lit(1)).alias("_n"))
            .withColumn("_rank", rank).filter((F.col("_n") >= min_rows) & (F.col("_rank") > 0)))
    best = ok.groupBy("symbol").agg(F.min_by("source", "_rank").alias("source"))
    return df.join(best, ["symbol", "source"], "left_semi")


def concat_chunks(*parts: DataFrame, nk: Sequence[str] = ("symbol", "ts")) -> DataFrame:
    """Chunked pulls overlap at their borders; the earlier chunk wins."""
    u = parts[0].withColumn("_part", F.lit(0))
    for i, p in enumerate(parts[1:], 1):
        u = u.unionByName(p.withColumn("_part", F.lit(i)))
    rest = [c for c in parts[0].columns if c not in nk]
    return u.groupBy(*nk).agg(F.min_by(F.struct(*rest), "_part").alias("_r")).select(*nk, "_r.*")


def clean_bars(df: DataFrame, key: Sequence[str] = ("symbol",)) -> DataFrame:
    """Drop inverted bars, carry the last close forward, drop null prices, weekdays only."""
    d = df.filter((F.col("high") >= F.col("low")) | F.col("high").isNull() | F.col("low").isNull())
    d = running(number_bars(d, key), key, {"_close": ("last", "close")})
    d = d.withColumn("close", F.col("_close")).drop("_close", "rn")
    return d.na.drop(subset=["open", "high", "low", "close"]).filter(F.weekday("ts") < 5)


def last_rows(df: DataFrame, key: Sequence[str], n: int, rn: str = "rn", total: str = "n") -> DataFrame:
    """Last ``n`` rows of each key, given positions and totals (no sort)."""
    return df.filter(F.col(rn) > F.col(total) - n)


def with_warmup(hist: DataFrame, paths: DataFrame, n: int = 64) -> DataFrame:
    """Put the last ``n`` history bars in front of every path of the same symbol.

    ``hist`` carries ``rn`` and ``n``; in the result history has positions <= 0.
    """
    tail = (hist.filter(F.col("rn") > F.col("n") - n)
            .withColumn("step", (F.col("rn") - F.col("n")).cast("long")))
    ids = paths.select("symbol", "path_id").distinct()
    head = tail.join(ids, "symbol").select("symbol", "path_id", "step", *OHLCV)
    return head.unionByName(paths.select("symbol", "path_id", "step", *OHLCV))


def universe(dim: DataFrame, bars: DataFrame) -> DataFrame:
    """Sweep universe: one row per listed symbol and interval with its number of bars."""
    cnt = bars.groupBy("symbol", "interval").agg(F.count(F.lit(1)).alias("bars"))
    return dim.join(cnt, "symbol")


def append_outcomes(df: DataFrame, path: str) -> None:
    """Append to the outcome log; parameter and regime structs are stored as JSON text."""
    js = {f.name: F.to_json(f.name) for f in df.schema.fields
          if isinstance(f.dataType, (T.StructType, T.MapType))}
    df.withColumns(js).write.mode("append").partitionBy("strategy").parquet(path)


def write_leaderboard(df: DataFrame, path: str, fmt: str = "csv") -> None:
    w = df.write.mode("overwrite")
    w.option("header", True).csv(path) if fmt == "csv" else w.parquet(path)


# The results table's columns and the metrics they hold.
RESULT_FIELDS = {"total_return": "total_return_usd", "total_return_pct": "total_return_pct", "sharpe_ratio": "sharpe_ratio", "sortino_ratio": "sortino_ratio",
                 "max_drawdown": "max_drawdown_pct", "profit_factor": "profit_factor", "win_rate": "win_rate", "num_trades": "num_trades",
                 "trades_per_day": "trades_per_day", "avg_trade_duration": "avg_trade_duration", "best_trade": "best_trade", "worst_trade": "worst_trade"}
TRADE_FIELDS = ("entry_time", "entry_price", "exit_time", "exit_price", "quantity", "pnl", "pnl_pct", "fees")
ENDLESS = 9999.0          # an infinite profit factor


def result_rows(metrics: DataFrame, key: Sequence[str]) -> DataFrame:
    """Rows of the results table: its own columns (null for metrics that are absent) and all metrics as JSON text."""
    names = [c for c in metrics.columns if c not in key]
    finite = {c: F.when(F.isnan(c) | (F.abs(c) == float("inf")), None).otherwise(F.col(c)) for c in names if isinstance(metrics.schema[c].dataType, T.DoubleType)}
    own = {o: F.col(m) if m in names else F.lit(None).cast("double") for o, m in RESULT_FIELDS.items()}
    own["profit_factor"] = F.when(own["profit_factor"] == float("inf"), ENDLESS).otherwise(own["profit_factor"])
    return metrics.select(*key, *[c.alias(o) for o, c in own.items()], F.to_json(F.struct(*[finite.get(c, F.col(c)).alias(c) for c in names])).alias("results_json"))


def write_results(metrics: DataFrame, trades: DataFrame, key: Sequence[str], path: str, batch: str) -> None:
    """Store a batch of runs below ``path/results`` and ``path/trades``.

    A batch is a partition that is replaced as a whole, so a repeated job leaves no rows twice.
    """
    tables = {"results": result_rows(metrics, key), "trades": trades.select(*key, "trade_no", *TRADE_FIELDS)}
    for name, rows in tables.items():
        rows.withColumn("batch", F.lit(batch)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(f"{path}/{name}")
