"""Structured Streaming versions of bar building, signals, ledgers and counters."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..sources.bars import INTERVAL_SECONDS, upsert_bars


def event_time(df: DataFrame, ts: str = "ts") -> DataFrame:
    """Watermarks need TIMESTAMP; zone-less timestamps are read as UTC."""
    return df.withColumn(ts, F.col(ts).cast("timestamp"))


# An event time no row reaches: the marker that closes a stream.
CLOSED = "9999-01-01"


def watermarked(df: DataFrame, ts: str, delay: str) -> DataFrame:
    """Rows under a watermark.  The closing marker moves the watermark and goes no further.

    The condition reads the event time, so the optimizer leaves it above the watermark.
    """
    return event_time(df, ts).withWatermark(ts, delay).filter(F.col(ts) < F.lit(CLOSED).cast("timestamp"))


def closable(src: DataFrame, folder: str) -> DataFrame:
    """``src`` with a second file source: the folder into which ``close_stream`` puts its marker."""
    spark = src.sparkSession
    spark.createDataFrame([], src.schema).write.mode("ignore").parquet(folder)
    return src.unionByName(spark.readStream.schema(src.schema).parquet(folder))


def close_stream(spark: SparkSession, schema: T.StructType, folder: str, ts: str = "ts") -> None:
    """Say that no more rows will come: one row whose only value is the event time ``CLOSED``."""
    marker = [(F.lit(CLOSED) if f.name == ts else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema]
    spark.range(1).select(*marker).write.mode("append").parquet(folder)


def stream_bars(src: DataFrame, key: str, ts: str, price: Column, interval: str, watermark: str = "1 hour",
                tiebreak: str | None = None) -> DataFrame:
    """Ticks to tumbling OHLCV bars; ticks later than the watermark are dropped."""
    order = F.struct(ts, tiebreak) if tiebreak else F.col(ts)
    d = watermarked(src, ts, watermark).withColumns({"_p": price.cast("double"), "_o": order})
    d = d.groupBy(F.col(key).alias("symbol"), F.window(ts, f"{INTERVAL_SECONDS[interval]} seconds").alias("_w")).agg(
        F.min_by("_p", "_o").alias("open"), F.max("_p").alias("high"), F.min("_p").alias("low"), F.max_by("_p", "_o").alias("close"),
        F.count(F.lit(1)).cast("double").alias("volume"))
    return d.select("symbol", F.col("_w.start").alias("ts"), "open", "high", "low", "close", "volume")


def stream_sliding_vwap(src: DataFrame, key: str, ts: str, price: Column, qty: Column, length: str, slide: str,
                        watermark: str = "1 hour") -> DataFrame:
    d = watermarked(src, ts, watermark).withColumns({"_p": price.cast("double"), "_q": qty.cast("double")})
    d = d.groupBy(F.col(key).alias("symbol"), F.window(ts, length, slide).alias("_w")).agg(
        F.sum("_q").alias("volume"), F.sum(F.col("_p") * F.col("_q")).alias("_pv"))
    return d.select("symbol", F.col("_w.start").alias("window_start"), "volume", (F.col("_pv") / F.nullif(F.col("volume"), F.lit(0.0))).alias("vwap"))


def stream_event_counts(src: DataFrame, name: str, ts: str, interval: str, watermark: str = "1 hour") -> DataFrame:
    d = watermarked(src, ts, watermark).groupBy(name, F.window(ts, interval).alias("_w")).agg(F.count(F.lit(1)).alias("count"))
    return d.select(name, F.col("_w.start").alias("window_start"), "count")


def stream_dedupe(src: DataFrame, keys: Sequence[str], ts: str = "ts", watermark: str = "1 hour") -> DataFrame:
    """First arrival of each natural key within the watermark; state is dropped after it."""
    return event_time(src, ts).withWatermark(ts, watermark).dropDuplicatesWithinWatermark(list(keys))


def stream_run_stats(src: DataFrame, key: Sequence[str], value: str = "return_pct", k: int = 4000) -> DataFrame:
    """Running count, profitable share, mean, extremes and 5 / 50 / 95 % quantiles of finished runs.

    The quantiles come from a mergeable sketch kept as aggregation state: its size grows with ``k`` and
    the logarithm of the runs, and a quantile's rank is off by about 2.3 / k ** 0.9 of the runs (0.13 %
    at 4000) with 99 % certainty.  Up to ``k`` runs are kept as they are.
    """
    d = src.groupBy(*key).agg(F.count(F.lit(1)).alias("runs"), F.avg((F.col(value) > 0).cast("double")).alias("profitable"), F.avg(value).alias("mean"),
                              F.min(value).alias("worst"), F.max(value).alias("best"), F.kll_sketch_agg_double(F.col(value).cast("double"), F.lit(k)).alias("_s"))
    return d.withColumns({n: F.kll_sketch_get_quantile_double("_s", F.lit(q)) for n, q in (("p5", 0.05), ("p50", 0.5), ("p95", 0.95))}).drop("_s")


# Rows that wait in state, packed: one binary value instead of lists of values.  ``key`` numbers the keys of a state.
LATCH_ROW = np.dtype([("key", "<i4"), ("at", "<i8"), ("entry", "?"), ("exit", "?")])
LEDGER_ROW = np.dtype([("key", "<i4"), ("at", "<i8"), ("buy", "?"), ("price", "<f8"), ("qty", "<f8")])
LEDGER_HEAD = np.dtype([("qty", "<f8"), ("cost", "<f8"), ("fees", "<f8"), ("cash", "<f8"), ("seen", "<i8"), ("rejects", "<i8")])


def _released(new: np.ndarray, held: bytes, seen: np.ndarray, delay: int) -> tuple[np.ndarray, np.ndarray, bytes]:
    """(rows to apply, late rows, rows still held), both by key and position; ``seen``, the keys' largest positions, is brought up to date.

    A key's own watermark is its largest position less ``delay``: rows up to it leave, later ones wait, and
    new rows up to the watermark of the batches before are late, as rows after them may have been applied.
    Rows wait in order of arrival and are sorted when they leave; equal positions keep that order.
    """
    late = new["at"] <= seen[new["key"]] - delay
    known = np.concatenate([np.frombuffer(held, new.dtype), new[~late]])
    np.maximum.at(seen, new["key"], new["at"])
    due = known["at"] <= seen[known["key"]] - delay
    ordered = lambda r: r[np.lexsort((r["at"], r["key"]))]
    return ordered(known[due]), ordered(new[late]), known[~due].tobytes()


def _records(pdfs: Iterator[pd.DataFrame], kind: np.dtype, **values: Callable[[pd.DataFrame], np.ndarray]) -> np.ndarray:
    out = []
    for pdf in pdfs:
        out.append(np.zeros(len(pdf), kind))
        for name, f in values.items():
            out[-1][name] = f(pdf)
    return np.concatenate(out)


def _counted(applied: int, late: np.ndarray, rejects: np.ndarray) -> pd.arrays.IntegerArray:
    """``rejects`` of the output: null in applied rows, then each key's running count of late ones, which is brought up to date."""
    first = np.searchsorted(late["key"], late["key"])
    counts = rejects[late["key"]] + np.arange(len(late)) - first + 1
    np.add.at(rejects, late["key"], 1)
    return pd.arrays.IntegerArray(np.r_[np.zeros(applied, "int64"), counts], np.arange(applied + len(late)) < applied)


LATCH_OUT = T.StructType([T.StructField("symbol", T.StringType()), T.StructField("ts", T.TimestampType()), T.StructField("signal", T.StringType()),
                          T.StructField("rejects", T.LongType())])
LATCH_STATE = T.StructType([T.StructField(n, T.LongType()) for n in ("inside", "seen", "rejects")] + [T.StructField("held", T.BinaryType())])


def _latch_step(delay: int):
    def step(key, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        inside, seen, rejects, held = state.get if state.exists else (0, -2**62, 0, b"")
        new = _records(pdfs, LATCH_ROW, at=lambda d: d["ts"].to_numpy().astype("datetime64[us]").astype("int64"), entry=lambda d: d["entry"].to_numpy() == True, exit=lambda d: d["exit"].to_numpy() == True)  # noqa: E712
        seen, rejects = np.array([seen]), np.array([rejects])
        due, late, held = _released(new, held, seen, delay)
        signals = []
        for e, x in zip(due["entry"].tolist(), due["exit"].tolist()):
            if not inside and e:
                inside, sig = 1, "BUY"
            elif inside and x:
                inside, sig = 0, "SELL"
            else:
                sig = "HOLD"
            signals.append(sig)
        counted = _counted(len(due), late, rejects)
        state.update((int(inside), int(seen[0]), int(rejects[0]), held))
        if len(counted):
            yield pd.DataFrame({"symbol": key[0], "ts": pd.to_datetime(np.r_[due["at"], late["at"]], unit="us"), "signal": np.array(signals + [None] * len(late), object), "rejects": counted})
    return step


def stream_latch(src: DataFrame, delay_seconds: int = 3600) -> DataFrame:
    """Live long-only latch per symbol over ``symbol, ts, entry, exit`` rows.

    Rows wait in state until the symbol's latest time is ``delay_seconds`` ahead, then they are
    applied in order, whichever micro-batch brought them.  A row later than that cannot be applied
    any more: it comes out with a null ``signal`` and the symbol's count of such rows in ``rejects``
    (null in applied rows).
    """
    return event_time(src).groupBy("symbol").applyInPandasWithState(_latch_step(delay_seconds * 1_000_000), LATCH_OUT, LATCH_STATE, "append", GroupStateTimeout.NoTimeout)


LEDGER_OUT = T.StructType([T.StructField("account", T.StringType()), T.StructField("seq", T.LongType()), T.StructField("held", T.DoubleType()),
                           T.StructField("sold", T.DoubleType()), T.StructField("realised_pnl", T.DoubleType()), T.StructField("cash", T.DoubleType()),
                           T.StructField("rejects", T.LongType())])
LEDGER_STATE = T.StructType([T.StructField("accounts", T.ArrayType(T.StringType())), T.StructField("heads", T.BinaryType()), T.StructField("held", T.BinaryType())])


def _ledger_step(fee: float, delay: int):
    def step(key, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        accounts, heads, held = state.get if state.exists else ([], b"", b"")
        number = {a: i for i, a in enumerate(accounts)}
        numbered = lambda d: [number.setdefault(a, len(number)) for a in d["account"].tolist()]
        new = _records(pdfs, LEDGER_ROW, key=numbered, at=lambda d: d["seq"].to_numpy(), buy=lambda d: d["buy"].to_numpy(), price=lambda d: d["price"].to_numpy(), qty=lambda d: d["qty"].to_numpy())
        start = np.zeros(len(number) - len(accounts), LEDGER_HEAD)
        start["seen"] = -2**62
        books, accounts = np.concatenate([np.frombuffer(heads, LEDGER_HEAD), start]), list(number)
        due, late, held = _released(new, held, books["seen"], delay)
        rows, at = [], None
        for k, buy, px, q in zip(*[due[c].tolist() for c in ("key", "buy", "price", "qty")]):
            if k != at:
                if at is not None:
                    books[["qty", "cost", "fees", "cash"]][at] = (qty, cost, fees, cash)
                at, (qty, cost, fees, cash, _, _) = k, books[k].tolist()
            sold, pnl = 0.0, np.nan
            if buy:
                qty, cost, fees, cash = qty + q, cost + px * q, fees + px * q * fee, cash - px * q * (1 + fee)
            elif qty > 0:
                sold = min(q, qty)
                share = sold / qty
                charge = px * sold * fee + fees * share
                pnl = (px - cost / qty) * sold - charge
                cash += px * sold * (1 - fee)
                qty, cost, fees = qty - sold, cost * (1 - share), fees * (1 - share)
                if qty <= 1e-10:
                    qty, cost, fees = 0.0, 0.0, 0.0
            rows.append((qty, sold, pnl, cash))
        if at is not None:
            books[["qty", "cost", "fees", "cash"]][at] = (qty, cost, fees, cash)
        counted = _counted(len(due), late, books["rejects"])
        state.update((accounts, books.tobytes(), held))
        if len(counted):
            amounts = np.array(rows + [(np.nan,) * 4] * len(late))
            yield pd.DataFrame({"account": np.array(accounts, object)[np.r_[due["key"], late["key"]]], "seq": np.r_[due["at"], late["at"]],
                                **{c: amounts[:, i] for i, c in enumerate(("held", "sold", "realised_pnl", "cash"))}, "rejects": counted})
    return step


def stream_ledger(src: DataFrame, fee: float = 0.0, delay: int = 1000, groups: int = 4096) -> DataFrame:
    """Live weighted-average-cost ledger per account over ``account, seq, side, price, qty``.

    Rows wait in state until the account's largest ``seq`` is ``delay`` ahead, then they are applied
    in order.  A row later than that comes out with null amounts and the account's count of such
    rows in ``rejects`` (null in applied rows).

    Accounts are dealt by hash over ``groups`` states, as a call for each account costs more than its
    rows; a micro-batch rewrites the states that it brings rows for.  Take more groups where a state,
    some 30 bytes a waiting row, would grow past a few megabytes.
    """
    buy = F.coalesce(F.col("side") == "BUY", F.lit(False)).alias("buy")
    dealt = src.select("account", "seq", buy, "price", "qty", F.pmod(F.xxhash64("account"), F.lit(groups)).alias("_group"))
    return dealt.groupBy("_group").applyInPandasWithState(_ledger_step(fee, delay), LEDGER_OUT, LEDGER_STATE, "append", GroupStateTimeout.NoTimeout)


def stream_upsert(src: DataFrame, path: str, checkpoint: str, nk: Sequence[str] = ("symbol", "ts", "source"), bucket: str = "ts"):
    """Merge each micro-batch into a parquet table, rewriting only the days it touches.

    Rows live under ``day=<date>/v=<version>``; a batch writes a new version of its days and
    readers take the newest version of each day (``current``).  A replayed batch merges the
    same keys again, so the result does not change.
    """
    def merge(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        schema = batch.schema
        d = batch.withColumn("day", F.to_date(bucket))
        days = d.select("day").distinct()
        stored = _versions(spark, path, schema)
        top = 0
        if stored is not None:
            top = stored.agg(F.max("v")).first()[0] or 0
            d = upsert_bars(_newest(stored.join(days, "day", "left_semi")).select(*schema.names, "day"), d, nk)
        d.withColumn("v", F.lit(top + 1)).write.mode("append").partitionBy("day", "v").parquet(path)
    return src.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _versions(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame | None:
    full = T.StructType([*schema.fields, T.StructField("day", T.DateType()), T.StructField("v", T.IntegerType())])
    try:
        return spark.read.schema(full).parquet(path)
    except AnalysisException:
        return None


def _newest(stored: DataFrame) -> DataFrame:
    """Rows of the newest version of each day; versions come from the partition columns."""
    last = stored.groupBy("day").agg(F.max("v").alias("v"))
    return stored.join(last, ["day", "v"], "left_semi")


def current(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return _newest(_versions(spark, path, schema)).select(*schema.names)


def drain(df: DataFrame, out: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Run a streaming plan over what is available into parquet and return that table."""
    q = df.writeStream.outputMode(mode).format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(out)


def drain_closed(df: DataFrame, out: str, checkpoint: str, schema: T.StructType, folder: str, ts: str = "ts") -> DataFrame:
    """Drain a plan over ``closable`` rows, close the stream, and drain what its last windows hold.

    The marker comes after every row has been read, so it makes no row late; a failed run starts
    again from the checkpoint.
    """
    drain(df, out, checkpoint)
    close_stream(df.sparkSession, schema, folder, ts)
    return drain(df, out, checkpoint)


def drain_complete(df: DataFrame, out: str, checkpoint: str) -> DataFrame:
    """Complete-mode results through ``foreachBatch``: the last snapshot wins."""
    def save(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(out)
    q = df.writeStream.outputMode("complete").foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(out)
