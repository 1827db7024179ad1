"""Runs from a table of jobs against the single-strategy operators, run by run."""
import pytest
from pyspark.sql import functions as F

from barweave.operators import jobs as J
from barweave.operators import signals as G
from barweave.operators.metrics import performance
from barweave.operators.positions import equity_curve, round_trips
from barweave.operators.presets import preset_signals
from barweave.session import stage

K = ["symbol"]
SETS = [J.job("GRID", "exponential", num_levels=6, invest=400, lower=60, upper=160), J.job("DCA", "time", hours=6, invest=100, hold_days=3),
        J.job("DCA", "profit", hours=6, invest=100, hold_days=3, target=2), J.job("PLA", "take_profit", (0.0, -2.0), (300.0, 600.0), fast=5, slow=12, target=3),
        J.job("SMA_CROSS", fast=3, slow=10), J.job("NO_SUCH"), J.job("GRID", num_levels=1), J.job("RSI", oversold=0.5, overbought=99.5), J.job(None)]
ERRORS = {6: "unknown strategy NO_SUCH", 7: "GRID needs 2 to 10000 levels", 8: "no trades", 9: "unknown strategy null"}


def alone(bars, i):
    if i == 1:
        return G.grid_signals(bars, K, F.lit(60.0), F.lit(160.0), 6, "exponential", 400.0)
    if i == 2:
        return G.dca_signals(bars, K, 6, 100.0, 3)
    if i == 3:
        return G.dca_profit_signals(bars, K, 6, 100.0, 3, 2.0)
    if i == 4:
        return G.pla_signals(bars, K, 5, 12, (0.0, -2.0), (300.0, 600.0), "take_profit", 3.0)
    return preset_signals(bars, K, "SMA_CROSS", fast=3, slow=10)


def numbers(df):
    return {(r.symbol, r.param_id): r for r in df.collect()}


@pytest.fixture(scope="module")
def ran(spark, walk):
    _, bars = walk
    keys = bars.select("symbol").distinct().unionByName(spark.createDataFrame([("GHOST",)], "symbol string"))
    return numbers(J.run_jobs(bars, J.jobs_for(keys, SETS), K, 10_000.0))


def test_every_job_has_a_row(ran):
    assert len(ran) == 3 * len(SETS)
    for sym in ("HOT", "COLD"):
        assert {i: ran[sym, i].error for i in ERRORS} == ERRORS
        assert all(ran[sym, i].error is None and ran[sym, i].num_trades > 0 for i in range(1, 6))
    assert ran["GHOST", 1].error == "no data" and ran["GHOST", 6].error == ERRORS[6]
    assert ran["GHOST", 1].final_equity == 10_000.0 and ran["GHOST", 1].num_trades == 0


@pytest.mark.parametrize("i", range(1, 6))
def test_runs_equal_single_strategies(walk, ran, i):
    sig = stage(alone(walk[1], i))
    m = performance(stage(equity_curve(sig, K, 10_000.0)), round_trips(sig, K), K).collect()
    assert len(m) == 2
    for r in m:
        got = ran[r.symbol, i]
        for c in J.METRICS:
            assert got[c] == pytest.approx(r[c], abs=2e-4), c


def test_no_jobs_and_no_runnable_job(spark, walk):
    _, bars = walk
    none = J.jobs_for(bars.select("symbol").distinct(), SETS).filter("false")
    assert J.run_jobs(bars, none, K).count() == 0
    bad = J.run_jobs(bars, J.jobs_for(bars.select("symbol").distinct(), [J.job("NO_SUCH")]), K).collect()
    assert len(bad) == 2 and all(r.error == ERRORS[6] and r.final_equity == 100_000.0 for r in bad)


def test_slippage_is_a_column(walk):
    _, bars = walk
    b = stage(bars.withColumn("slip", F.when(F.col("symbol") == "HOT", 0.01).otherwise(0.001)))
    j = J.jobs_for(b.select("symbol").distinct(), [SETS[4]])
    got = numbers(J.run_jobs(b, j, K, 10_000.0, "slip"))
    sig = stage(alone(bars, 5))
    for sym, s in (("HOT", 0.01), ("COLD", 0.001)):
        one = sig.filter(F.col("symbol") == sym)
        m = performance(stage(equity_curve(one, K, 10_000.0, s)), round_trips(one, K, s), K).first()
        assert got[sym, 1].final_equity == pytest.approx(m.final_equity, abs=1e-4)


def test_fan_out_keeps_every_bar_of_a_hot_key(walk):
    _, bars = walk
    j = J.jobs_for(bars.select("symbol").distinct(), SETS[:3])
    for cells in (1, 3):
        d = J.fan_out(bars, j, K, cells)
        assert d.count() == 3 * bars.count() and d.select("symbol", "rn", "param_id").distinct().count() == d.count()


def test_walk_forward_takes_bounds_from_the_train_window(walk):
    pdf, bars = walk
    sets = [J.job("GRID", num_levels=n, invest=300) for n in (3, 9)]
    got = J.walk_forward_jobs(bars, J.jobs_for(bars.select("symbol").distinct(), sets), K, 900, 600, capital=10_000.0).collect()
    folds = {r.fold: r for r in got if r.symbol == "HOT"}
    assert sorted(folds) == [0, 1, 2]
    hot = pdf[pdf.symbol == "HOT"].sort_values("rn")
    train = hot.iloc[600:1500]
    lo, hi = train.close.min(), train.close.max()
    pad = (hi - lo) * 0.1
    n = (3, 9)[folds[1].param_id - 1]
    test = stage(bars.filter("symbol = 'HOT' and rn > 1500 and rn <= 2100").withColumn("rn", F.col("rn") - 1500))
    sig = stage(G.grid_signals(test, K, F.lit(float(max(lo * 0.5, lo - pad))), F.lit(float(hi + pad)), n, invest=300.0))
    m = performance(stage(equity_curve(sig, K, 10_000.0)), round_trips(sig, K), K).first()
    assert folds[1].return_pct == pytest.approx(m.total_return_pct, abs=1e-3) and folds[1].num_trades == m.num_trades


def test_classic_grids_are_runnable_jobs(walk):
    j = J.jobs_for(walk[1].select("symbol").distinct(), J.classic_jobs())
    got = j.groupBy("symbol", "strategy").agg(F.count(F.lit(1)).alias("sets"), F.count(J.job_problem()).alias("bad")).collect()
    assert {(r.strategy, r.sets, r.bad) for r in got} == {("GRID", 24, 0), ("DCA", 108, 0), ("PLA", 81, 0)} and len(got) == 6
