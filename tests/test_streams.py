from datetime import datetime, timedelta

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from barweave.plans.stream_queries import scratch
from barweave.streaming import streams as S


def batches(spark, schema, *parts):
    """A stream that brings each part as a micro-batch of its own."""
    p = scratch(spark)
    for rows in parts:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(p)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(p)


def drained(spark, df):
    p = scratch(spark)
    return S.drain(df, f"{p}/out", f"{p}/cp").collect()


def test_latch_waits_for_late_rows_and_counts_rejects(spark):
    at = lambda m: datetime(2024, 1, 1) + timedelta(minutes=m)
    src = batches(spark, "symbol string, ts timestamp, entry boolean, exit boolean",
                  [("a", at(0), False, False), ("a", at(30), False, True)],
                  [("a", at(10), True, False), ("a", at(30), False, False)],          # late within the delay; a time seen before
                  [("a", at(200), False, False)], [("a", at(20), True, False), ("a", at(25), True, False)], [("a", at(900), False, False)])
    got = drained(spark, S.stream_latch(src))
    applied = sorted((r.ts, r.signal) for r in got if r.rejects is None)
    assert applied == [(at(0), "HOLD"), (at(10), "BUY"), (at(30), "HOLD"), (at(30), "SELL"), (at(200), "HOLD")]
    assert sorted((r.ts, r.signal, r.rejects) for r in got if r.rejects) == [(at(20), None, 1), (at(25), None, 2)]


def test_ledger_waits_for_late_rows_and_counts_rejects(spark):
    src = batches(spark, "account string, seq long, side string, price double, qty double",
                  [("a", 2, "SELL", 12.0, 1.0)], [("a", 1, "BUY", 10.0, 2.0)], [("a", 50, "BUY", 1.0, 1.0)], [("a", 3, "BUY", 5.0, 1.0)], [("a", 99, "BUY", 1.0, 1.0)])
    got = drained(spark, S.stream_ledger(src, delay=10))
    assert sorted((r.seq, r.held, r.realised_pnl) for r in got if r.rejects is None) == [(1, 2.0, None), (2, 1.0, 2.0), (50, 2.0, None)]
    assert [(r.seq, r.held, r.rejects) for r in got if r.rejects] == [(3, None, 1)]


def test_ledger_accounts_share_states(spark):
    """Accounts of one state keep their own books, order, delay and rejects; a state's rows are one call, not one for each account."""
    part = lambda *seqs: [(a, q, s, p, n) for a in ("a", "b", None) for q, s, p, n in seqs]
    src = batches(spark, "account string, seq long, side string, price double, qty double",
                  part((2, "SELL", 12.0, 1.0)) + [("c", 7, "BUY", 3.0, 4.0)], part((1, "BUY", 10.0, 2.0), (1, "BUY", 10.0, None))[::-1], part((50, "BUY", 1.0, 1.0)),
                  part((3, "BUY", 5.0, 1.0), (2, "SELL", 5.0, 1.0))[:5], part((99, "BUY", 1.0, 1.0)))
    for groups in (1, 4096):
        got = drained(spark, S.stream_ledger(src, delay=10, groups=groups))
        assert not [r for r in got if r.account == "c"]
        for a in ("a", "b", None):
            assert [r.seq for r in got if r.account == a and r.rejects is None] == [1, 1, 2, 50]
        late = sorted((r.account or "", r.rejects, r.seq, r.held) for r in got if r.rejects)
        assert late == [("", 1, 3, None), ("a", 1, 2, None), ("a", 2, 3, None), ("b", 1, 2, None), ("b", 2, 3, None)]
    calls = []
    step = S._ledger_step(0.0, 10)
    state = type("State", (), {"exists": False, "update": lambda self, v: calls.append(v)})()
    pdf = pd.DataFrame({"account": ["a", "b", "a"], "seq": [2, 5, 1], "buy": [False, True, True], "price": [12.0, 1.0, 10.0], "qty": [1.0, 2.0, 2.0]})
    assert list(step((0,), iter([pdf]), state)) == [] and len(calls) == 1
    accounts, heads, held = calls[0]
    assert accounts == ["a", "b"] and len(held) == 3 * S.LEDGER_ROW.itemsize and len(heads) == 2 * S.LEDGER_HEAD.itemsize


def test_closing_marker_brings_out_the_last_windows(spark):
    """Parts out of order within the delay; without the marker the windows after the watermark stay in state."""
    at = lambda m: datetime(2024, 1, 1) + timedelta(minutes=m)
    src = batches(spark, "symbol string, ts timestamp, p double", [("a", at(70), 3.0), ("a", at(20), 1.0)], [("a", at(50), 2.0), ("b", at(5), 7.0)], [("a", at(130), 4.0)])
    plan = lambda d: S.stream_bars(d, "symbol", "ts", F.col("p"), "1h", "2 hours")
    assert len(drained(spark, plan(src))) == 0
    p = scratch(spark)
    got = S.drain_closed(plan(S.closable(src, f"{p}/end")), f"{p}/out", f"{p}/cp", src.schema, f"{p}/end").collect()
    assert sorted((r.symbol, r.ts, r.open, r.close, r.volume) for r in got) == [
        ("a", at(0), 1.0, 2.0, 2.0), ("a", at(60), 3.0, 3.0, 1.0), ("a", at(120), 4.0, 4.0, 1.0), ("b", at(0), 7.0, 7.0, 1.0)]
    counts = S.drain_closed(S.stream_event_counts(S.closable(src, f"{p}/end2"), "symbol", "ts", "1 day"), f"{p}/out2", f"{p}/cp2", src.schema, f"{p}/end2").collect()
    assert sorted((r.symbol, r["count"]) for r in counts) == [("a", 4), ("b", 1)]


def test_run_quantiles_stay_within_their_rank_error(spark):
    v = np.random.default_rng(3).normal(0, 10, 30_000)
    src = batches(spark, "scenario string, return_pct double", *[[("x", float(x)) for x in part] for part in np.array_split(v, 3)])
    p = scratch(spark)
    got = S.drain_complete(S.stream_run_stats(src, ["scenario"], k=400), f"{p}/out", f"{p}/cp").first()
    for name, q in (("p5", 0.05), ("p50", 0.5), ("p95", 0.95)):
        assert abs((v <= got[name]).mean() - q) < 2 * 2.3 / 400 ** 0.9
    assert got.runs == 30_000 and got.worst == v.min() and got.best == v.max()
