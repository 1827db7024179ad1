import json

from pyspark.sql import functions as F

from barweave.operators import indicators as I
from barweave.operators import montecarlo as C
from barweave.operators import positions as P
from barweave.operators import quality as Q
from barweave.operators import signals as G
from barweave.plans.stream_queries import scratch
from barweave.sources.bars import write_results

K = ["symbol"]


def test_round_trip_percentage_sums_both_sides(spark):
    legs = spark.createDataFrame([("options", 10_000.0), ("equity_delivery", 10_000.0), ("futures", 0.0)], "market_type string, turnover double")
    got = {r.market_type: r.effective_pct for r in P.effective_pct(legs).collect()}
    both = P.indian_cost(legs.withColumn("side", F.explode(F.array(F.lit("BUY"), F.lit("SELL"))))).groupBy("market_type").agg(F.sum("cost.total").alias("t"))
    want = {r.market_type: round(r.t / 100, 3) for r in both.collect() if r.market_type != "futures"}
    assert got == {**want, "futures": None} and 0 < got["equity_delivery"]


def test_shape_counts_in_the_score(spark, walk):
    _, df = walk
    clean = {r.symbol: r.score for r in Q.quality_report(df, K).collect()}
    for shaped, lost, text in ((df.drop("volume"), 30, "missing columns: volume"), (df.withColumn("open", F.col("open").cast("string")), 10, "column open is not numeric"),
                               (df.drop("ts", "volume"), 30, "missing columns: ts, volume")):
        for r in Q.quality_report(shaped, K).collect():
            assert r.issues == [text] and abs(r.score - (clean[r.symbol] - lost)) < 1e-9


def test_median_spacing_by_rank(spark):
    rows = [("a", i + 1, 3600 * t) for i, t in enumerate([0, 1, 2, 5, 9])] + [("one", 1, 0)]
    df = spark.createDataFrame(rows, "symbol string, rn long, s long").withColumn("ts", F.timestamp_seconds("s"))
    assert {r.symbol: r.spacing_h for r in G.spacing_hours(df, K).collect()} == {"a": 2.0, "one": 24.0}


def test_keys_without_runs_say_why(spark):
    day = lambda n: f"timestamp '2024-01-{n:02d}'"
    trades = spark.range(1, 8).selectExpr("if(id <= 5, 'many', 'few') AS symbol", "id AS trade_no", f"{day(1)} AS entry_time", f"{day(9)} AS exit_time", "cast(id AS double) AS pnl")
    keys = spark.createDataFrame([("many",), ("few",), ("none",)], "symbol string")
    got = C.resample_report(keys, trades, C.resample_trades(trades, K, 4), K).collect()
    assert {(r.symbol, r.trades, r.runs, r.note) for r in got} == {("many", 5, 4, None), ("few", 2, 0, "fewer than 3 trades"), ("none", 0, 0, "no trades")}


def test_catalog_names_missing_outputs(spark, walk):
    _, df = walk
    b = I.compute_all(df, K, [I.use("sma"), I.use("bbands")]).drop(I.REGISTRY["bbands"].outputs[0])
    got = {r.key: r for r in I.catalog_report(b, K).filter("symbol = 'COLD'").collect()}
    assert len(got) == len(I.REGISTRY) and got["sma"].status == "PASS" and 0 < got["sma"].null_fraction < 0.2
    assert got["bbands"].missing == I.REGISTRY["bbands"].outputs[0] and got["bbands"].null_fraction is not None
    assert got["rsi"].status == "FAIL" and got["rsi"].null_fraction is None


def test_repeated_batches_leave_no_rows_twice(spark):
    p = scratch(spark)
    metrics = spark.createDataFrame([("a", 1.5, float("inf")), ("b", -2.0, 0.5)], "symbol string, total_return_pct double, profit_factor double")
    trades = spark.range(3).selectExpr("'a' AS symbol", "id AS trade_no", *[f"cast(id AS double) AS {c}" for c in ("entry_time", "entry_price", "exit_time", "exit_price", "quantity", "pnl", "pnl_pct", "fees")])
    for batch in ("x", "x", "y"):
        write_results(metrics, trades, K, p, batch)
    back = spark.read.parquet(f"{p}/results").filter("batch = 'x'").collect()
    assert sorted((r.symbol, r.total_return_pct, r.profit_factor, r.sharpe_ratio) for r in back) == [("a", 1.5, 9999.0, None), ("b", -2.0, 0.5, None)]
    assert json.loads(next(r.results_json for r in back if r.symbol == "b")) == {"total_return_pct": -2.0, "profit_factor": 0.5}
    assert spark.read.parquet(f"{p}/trades").groupBy("batch").count().filter("count = 3").count() == 2
