"""Streaming plans drained with ``availableNow`` over the stored tables, and file sinks."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import signals as G
from ..operators.presets import preset_flags
from ..session import stage, stage_folder
from ..sources import bars as B
from ..sources.tables import event_bars, fills, raw_bars, table
from ..streaming import streams as S
from .oracle import latch_tail
from .position_queries import LEDGER
from .registry import bars_cte, fin, query, r, rx
from .signal_queries import K, SMA_SIGNALS


def scratch(s) -> str:
    return f"{stage_folder(s)}/stream-{uuid.uuid4().hex}"


def source(s, d, name):
    """A stored table as a file stream (one file per micro-batch)."""
    t = table(s, d, name)
    return s.readStream.schema(t.schema).option("maxFilesPerTrigger", 1).option("pathGlobFilter", f"{name}.parquet").parquet(d)


def replay(s, df, parts: int = 3, order: str = "ts", key: str | None = None, rows_per_file: int = 100_000):
    """A table written in parts, one after the other in the given order, and read as a stream of a part per micro-batch.

    With ``key``, a last part closes every key by a row far ahead, so that rows waiting in state leave.
    """
    p = scratch(s)
    num = F.col(order) if order != "ts" else F.unix_micros(F.col("ts").cast("timestamp"))
    d = df.withColumn("_o", num.cast("double"))
    cuts = d.approxQuantile("_o", [i / parts for i in range(1, parts)], 0.01)
    bounds = [float("-inf"), *cuts, float("inf")]
    files = max(1, df.count() // parts // rows_per_file)      # each file of a part gets rows, dealt in turn
    for lo, hi in zip(bounds, bounds[1:]):
        d.filter((F.col("_o") > lo) & (F.col("_o") <= hi)).drop("_o").repartition(files).write.mode("append").parquet(p)
    if key:
        end = {key: F.col(key), order: F.lit("2262-01-01" if order == "ts" else 2**61)}
        df.select(key).distinct().select(*[end.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in df.schema]).write.mode("append").parquet(p)
    return s.readStream.schema(df.schema).option("maxFilesPerTrigger", files).parquet(p)


def run(s, df, mode="append"):
    p = scratch(s)
    return S.drain(df, f"{p}/out", f"{p}/cp", mode)


def run_closed(s, src, plan):
    """``plan`` over all rows of ``src`` and, by a closing marker, all its windows."""
    p = scratch(s)
    return S.drain_closed(plan(S.closable(src, f"{p}/end")), f"{p}/out", f"{p}/cp", src.schema, f"{p}/end")


@query("stream_bars", f"WITH {bars_cte()} SELECT symbol, ts, open, high, low, close, volume FROM bars")
def _(s, d):
    return ntz(run_closed(s, source(s, d, "events"), lambda e: S.stream_bars(e, "event_type", "ts", 100 + F.col("value"), "1h", tiebreak="event_id")), "ts")


def ntz(df, *cols):
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in cols})


@query("stream_event_counts", "SELECT event_type, date_trunc('day', ts)::TIMESTAMP AS window_start, count(*) AS count FROM events GROUP BY 1, 2")
def _(s, d):
    return ntz(run_closed(s, source(s, d, "events"), lambda e: S.stream_event_counts(e, "event_type", "ts", "1 day")), "window_start")


@query("stream_sliding_vwap", f"""WITH w AS (SELECT event_type AS symbol, 100 + value AS p, (user_id % 5 + 1)::DOUBLE AS q, date_trunc('hour', ts) - to_hours(k::BIGINT) AS window_start FROM events, (SELECT unnest(range(0, 4)) AS k))
   SELECT symbol, window_start, {rx('sum(q)', 'volume')}, {rx('sum(p * q) / sum(q)', 'vwap', 9)} FROM w GROUP BY symbol, window_start""")
def _(s, d):
    q = run_closed(s, source(s, d, "events"), lambda e: S.stream_sliding_vwap(e, "event_type", "ts", 100 + F.col("value"), (F.col("user_id") % 5 + 1), "4 hours", "1 hour"))
    return ntz(q, "window_start").select("symbol", "window_start", (F.round("volume", 6) + 0.0).alias("volume"), (F.round("vwap", 9) + 0.0).alias("vwap"))


@query("stream_dedupe", f"WITH {bars_cte()} SELECT symbol, ts, close, source FROM (SELECT symbol, ts, close, 'binance' AS source FROM bars)")
def _(s, d):
    b = raw_bars(s, d).select("symbol", "ts", "close", F.lit("binance").alias("source"))
    twice = stage(b.unionByName(b))
    return ntz(run(s, S.stream_dedupe(replay(s, twice), ["symbol", "ts", "source"])), "ts")


@query("stream_run_stats", f"SELECT l_returnflag AS scenario, count(*) AS runs, {rx('avg(CASE WHEN l_discount > 0.05 THEN 1.0 ELSE 0 END)', 'profitable')}, {rx('avg(l_discount * 100 - 5)', 'mean')}, {rx('min(l_discount * 100 - 5)', 'worst')}, {rx('max(l_discount * 100 - 5)', 'best')}, {', '.join(rx(f'quantile_disc(l_discount * 100 - 5, {q})', n) for n, q in (('p5', 0.05), ('p50', 0.5), ('p95', 0.95)))} FROM lineitem GROUP BY 1")
def _(s, d):
    src = source(s, d, "lineitem").select(F.col("l_returnflag").alias("scenario"), (F.col("l_discount") * 100 - 5).alias("return_pct"))
    src = src.withColumn("return_pct", F.when(F.abs("return_pct") < 1e-9, 0.0).otherwise(F.col("return_pct")))
    p = scratch(s)
    return fin(S.drain_complete(S.stream_run_stats(src, ["scenario"]), f"{p}/out", f"{p}/cp"))


@query("stream_latch", f"WITH RECURSIVE {SMA_SIGNALS} SELECT symbol, ts, signal FROM signals")
def _(s, d):
    f = stage(preset_flags(event_bars(s, d), K, "SMA_CROSS").select("symbol", "ts", "entry", "exit"))
    return ntz(run(s, S.stream_latch(replay(s, f, key="symbol"))).drop("rejects"), "ts")


# a fee whose decimals never end keeps sums of amounts in cents away from rounding ties
@query("stream_ledger", LEDGER.replace("0.001", "(1.0 / 700)") + f""", moves AS (SELECT st.account, st.rn, st.held, st.sold, st.pnl, CASE WHEN side = 'BUY' THEN -price * qty * (1 + 1.0 / 700) ELSE price * sold * (1 - 1.0 / 700) END AS paid FROM st JOIN f ON f.account = st.account AND f.rn = st.rn)
   SELECT account, rn AS seq, {rx('held', 'held', 4)}, {rx('sold', 'sold', 4)}, {rx('pnl', 'realised_pnl', 3)}, {rx('sum(paid) OVER (PARTITION BY account ORDER BY rn)', 'cash', 0)} FROM moves""")
def _(s, d):
    f = stage(fills(s, d).select("account", F.col("rn").alias("seq"), "side", "price", "qty"))
    out = run(s, S.stream_ledger(replay(s, f, order="seq", key="account"), 1 / 700))
    return out.select("account", "seq", *[(F.round(c, n) + F.lit(0.0)).alias(c) for c, n in (("held", 4), ("sold", 4), ("realised_pnl", 3), ("cash", 0))])


@query("stream_upsert", f"WITH {bars_cte()} SELECT symbol, ts, 'binance' AS source, CASE WHEN day(ts) = 5 THEN close * 2 ELSE close END AS close FROM bars")
def _(s, d):
    b = raw_bars(s, d).select("symbol", "ts", F.lit("binance").alias("source"), "close")
    p = scratch(s)
    b.write.parquet(f"{p}/in/a")
    fix = b.filter("day(ts) = 5").withColumn("close", F.col("close") * 2)
    src = lambda x: s.readStream.schema(b.schema).parquet(f"{p}/in/{x}")
    S.stream_upsert(src("a"), f"{p}/table", f"{p}/cp-a").awaitTermination()
    fix.write.parquet(f"{p}/in/b")
    S.stream_upsert(src("b"), f"{p}/table", f"{p}/cp-b").awaitTermination()
    return S.current(s, f"{p}/table", b.schema)


# ------------------------------------------------------------------ sinks

@query("append_outcomes", "SELECT event_type AS strategy, event_id, '{\"length\":' || user_id || ',\"level\":' || (user_id % 7) || '}' AS params FROM events")
def _(s, d):
    e = table(s, d, "events").select(F.col("event_type").alias("strategy"), "event_id", F.struct(F.col("user_id").alias("length"), (F.col("user_id") % 7).alias("level")).alias("params"))
    p = scratch(s)
    B.append_outcomes(e.filter("event_id % 2 = 0"), p)
    B.append_outcomes(e.filter("event_id % 2 = 1"), p)
    return s.read.parquet(p).select("strategy", "event_id", "params")


@query("write_leaderboard", "SELECT p_partkey AS run_id, p_name AS strategy, p_retailprice AS score FROM part")
def _(s, d):
    p = scratch(s)
    B.write_leaderboard(table(s, d, "part").select(F.col("p_partkey").alias("run_id"), F.col("p_name").alias("strategy"), F.col("p_retailprice").alias("score")), p)
    return s.read.schema("run_id long, strategy string, score double").option("header", True).csv(p)
