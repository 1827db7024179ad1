import numpy as np
import pytest
from pyspark.sql import functions as F

from barweave.functions import scalar as S
from barweave.operators import montecarlo as C
from barweave.operators import scenarios as X
from barweave.operators import sweep as W
from barweave.operators import validation as V
from barweave.session import stage

K = ["symbol"]
P = ["open", "high", "low", "close"]


def test_scenarios_keep_the_envelope_and_the_input(spark, walk):
    pdf, df = walk
    x = X.apply_scenario(df, X.plan_runs(df, spark, 2), size=300)
    bad = x.filter("high < greatest(open, close) or low > least(open, close) or low < 1e-6").count()
    assert bad == 0 and x.count() == 17 * 2 * len(pdf)


def test_runs_do_not_depend_on_partitioning(spark, walk):
    _, df = walk
    plans = [stage(X.plan_runs(df.repartition(n), spark, 2)) for n in (1, 9)]
    a, b = (X.apply_scenario(df.repartition(n, "rn"), p, size=s).groupBy("symbol", "scenario", "run_id").agg(F.round(F.sum("close"), 6).alias("s")) for n, p, s in ((1, plans[0], 4096), (9, plans[1], 100)))
    assert a.exceptAll(b).count() == 0 and a.count() == 68


def test_gaps_and_outliers_against_a_loop(spark, walk):
    """Random positions are read from the run rows; the price changes are recomputed in numpy."""
    pdf, df = walk
    names = ["yes_bank_2020", "outlier_injection"]
    runs = stage(X.plan_runs(df, spark, 1, names=names))
    got = X.apply_scenario(df, runs, size=200).toPandas()
    for r in runs.collect():
        g = got[(got.symbol == r.symbol) & (got.scenario == r.scenario)].sort_values("rn").reset_index(drop=True)
        b = pdf[pdf.symbol == r.symbol].sort_values("rn").reset_index(drop=True)
        i = np.arange(len(b))
        if r.scenario == "outlier_injection":
            assert len(set(r.out_at)) == 5 and all(0 <= p < r.n for p in r.out_at)
            ratio = (g.close / b.close).to_numpy()
            np.testing.assert_allclose(np.delete(ratio, r.out_at), 1.0)
            assert ((ratio[r.out_at] >= 0.7 - 1e-9) & (ratio[r.out_at] <= 0.8 + 1e-9)).all()
        else:
            assert len(set(r.gap_at)) == 6 and all(r.start <= p < r.end for p in r.gap_at)
            d = r.drift[0]
            f = np.where(i < d.s, 1.0, np.where(i < d.e, d.m ** ((i - d.s + 1) / (d.e - d.s)), d.m))
            np.testing.assert_allclose(g.close, b.close * f, rtol=1e-12)
            drop = g.open[r.gap_at].to_numpy() / (b.close * f)[np.array(r.gap_at) - 1].to_numpy()
            assert ((drop <= 0.95 + 1e-9) & (drop >= 0.85 - 1e-9)).all()
            rest = np.delete(i, r.gap_at)
            np.testing.assert_allclose(g.open[rest], (b.open * f)[rest], rtol=1e-12)


def test_mean_reverting_noise_hits_its_target(spark, walk):
    _, df = walk
    runs = stage(X.plan_runs(df, spark, 2, names=["whipsaw_chop"]))
    x = X.apply_scenario(df, runs, size=150).join(df.select("symbol", "rn", F.col("close").alias("c0")), ["symbol", "rn"])
    x = x.join(runs.select("symbol", "run_id", "c_s", "c_e", "c_pct"), ["symbol", "run_id"])
    a = x.filter("rn - 1 >= c_s and rn - 1 < c_e").groupBy("symbol", "run_id").agg(F.stddev_pop(F.ln(F.col("close") / F.col("c0"))).alias("sd"), F.first("c_pct").alias("p"))
    assert all(r.sd * 100 == pytest.approx(r.p, rel=1e-9) for r in a.collect())
    assert x.filter("rn - 1 < c_s and abs(close - c0) > 1e-9").count() == 0


def test_bootstrap_steps_come_from_history(spark, walk):
    pdf, df = walk
    b = X.block_bootstrap(df, 5, 70, 20).toPandas()
    assert len(b) == 2 * 5 * 70 and (b.high >= b[["open", "close"]].max(axis=1) - 1e-12).all()
    for sym, g in b.groupby("symbol"):
        hist = pdf[pdf.symbol == sym].sort_values("rn").close.to_numpy()
        known = np.sort(hist[1:] / hist[:-1])
        for _, p in g.groupby("path_id"):
            c = np.concatenate([[hist[-1]], p.sort_values("step").close])
            step = c[1:] / c[:-1]
            near = known[np.clip(np.searchsorted(known, step), 0, len(known) - 1)], known[np.clip(np.searchsorted(known, step) - 1, 0, len(known) - 1)]
            assert (np.minimum(abs(near[0] - step), abs(near[1] - step)) < 1e-9).all()


def test_resampling_needs_three_trades(spark):
    t = spark.createDataFrame([("a", 1, 5.0), ("a", 2, -3.0)] + [("b", i, float(i)) for i in range(1, 21)], "symbol string, trade_no int, pnl double")
    t = t.withColumns({"entry_time": F.lit("2022-01-01").cast("timestamp_ntz"), "exit_time": F.lit("2022-06-01").cast("timestamp_ntz")})
    r = C.resample_trades(t, K, 6, 1000.0, bucket_rows=3).collect()
    assert {x.symbol for x in r} == {"b"} and len(r) == 6 and all(x.num_trades == 18 for x in r)
    assert all(x.final_equity == pytest.approx(1000 * (1 + x.return_pct / 100), abs=0.02) for x in r)


def test_robustness_needs_two_runs(spark):
    d = spark.createDataFrame([("a", 1, 5.0, 10500.0), ("b", 1, 5.0, 10500.0), ("b", 2, -60.0, 4000.0)], "symbol string, run_id int, return_pct double, final_equity double")
    r = {x.symbol: x for x in C.robustness(d, K).collect()}
    assert r["a"].score is None and r["a"].grade is None and 0 <= r["b"].score <= 100 and r["b"].provisional


def test_grids_of_any_size(spark, walk):
    assert W.param_grid(spark, a=[1, 2], b=[3, 4, 5]).count() == 6
    grid = W.param_grid(spark, fast=list(range(2, 5)), slow=list(range(6, 73)))
    assert grid.count() == 201
    flags = W.ma_cross_flags(walk[1].filter("symbol = 'COLD' and rn <= 90"), K, grid)
    assert flags.count() == 201 * 90 and flags.select("param_id").distinct().count() == 201
    assert W.ma_cross_flags(walk[1], K, grid.limit(0)).count() == 0


def test_distinct_positions_of_any_size(spark):
    from barweave.functions.draws import distinct_positions
    d = spark.createDataFrame([(1, 5, 257), (2, 257, 257), (3, 200, 300), (4, 9, 3), (5, 0, 4), (6, 3, 0)], "id long, k long, n long")
    for r in d.withColumn("at", distinct_positions(7, F.col("k"), F.col("n"), "id")).collect():
        assert len(set(r["at"])) == len(r["at"]) == min(r.k, r.n) and all(0 <= p < r.n for p in r["at"])


def test_plateau_after_many_rounds(spark):
    d = spark.createDataFrame([("a", i, float(i)) for i in range(1, 9)] + [("a", 9, 8.0)], "k string, round long, score double")
    r = W.plateau(d, ["k"]).first()
    assert (r.best_round, r.plateau_round, r.rounds_run) == (8, 9, 9)


def test_walk_forward_picks_the_best_training_set(spark, walk):
    _, df = walk
    w = V.walk_forward(df, W.param_grid(spark, fast=[3, 8], slow=[20]), K, 900, 600, size=300)
    rows = w.collect()
    assert {(r.symbol, r.fold) for r in rows} >= {("HOT", 0), ("HOT", 1), ("COLD", 0)}


def test_symbol_helpers(spark):
    d = spark.createDataFrame([("BTCUSD", "BINANCE", "1D"), ("ethusdt", "crypto", "1h"), ("BNBBUSD", None, "9m"), ("reliance.NS", "nse", "15m")], "symbol string, source string, interval string")
    got = [tuple(r)[3:] for r in S.norm_suggestion(d).collect()]
    assert got == [("BTC/USDT", "binance", "1d"), ("ETH/USDT", "binance", "1h"), ("BNB/BUSD", None, None), ("RELIANCE", "nse", "15m")]
    e = spark.createDataFrame([(x,) for x in ("AUDCAD", "GBP/JPY", "BTC/USDT", "AAPL")], "s string")
    assert [r[0] for r in e.select(S.is_forex_pair("s")).collect()] == [True, True, False, False]
    assert [r[0] for r in e.select(S.to_ticker("s")).collect()] == ["AUDCAD=X", "GBPJPY=X", "BTC-USD", "AAPL"]


def test_cache_key_equals_sorted_json(spark):
    import hashlib
    import json

    def want(strategy, params, symbol, timeframe):
        blob = json.dumps({"strategy": strategy, "params": params, "symbol": symbol, "timeframe": timeframe}, sort_keys=True)
        return hashlib.sha256(blob.encode()).hexdigest()[:32]

    values = {"n": 10, "s": "10", "q": 'a "b" \\', "e": "café 😀", "x": 0.5, "tiny": 1e-05, "big": 12345678.0, "flag": True, "list": [1, 2]}
    lits = {k: F.array(*[F.lit(i) for i in v]) if isinstance(v, list) else F.lit(v) for k, v in values.items()}
    k = spark.range(1).select(S.cache_key(F.lit("rsi"), lits, F.lit("btc"), F.lit("1h")), S.cache_key(F.lit("RSI"), dict(reversed(lits.items())), F.lit("BTC"), F.lit("1h")),
                              S.cache_key(F.lit("RSI"), {"n": F.lit(10)}, F.lit("BTC"), F.lit("4h")), S.cache_key(F.lit("RSI"), {"n": F.lit("10")}, F.lit("BTC"), F.lit("4h"))).first()
    assert k[0] == k[1] == want("RSI", values, "BTC", "1h")
    assert k[2] == want("RSI", {"n": 10}, "BTC", "4h") != k[3]
