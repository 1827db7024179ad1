import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barweave.operators.blocks import chained_fold, exact_percentiles, index_rows, open_blocks, close_blocks, running, running_latch
from barweave.operators.positions import running_affine
from barweave.session import checkpoint_root, stage

K = ["symbol"]


def test_stages_go_to_the_checkpoint_folder(spark):
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    d = stage(spark.range(3))
    assert d.count() == 3 and all(f.replace("file://", "").startswith(checkpoint_root(spark)) for f in d.inputFiles())
    assert root is None or checkpoint_root(spark) == root.rstrip("/")


def test_index_rows_is_dense_per_key(spark, walk):
    pdf, df = walk
    d = df.drop("rn").repartition(7)
    got = index_rows(d, K, ["ts"], [F.year("ts") * 100 + F.month("ts")], total="total").toPandas()
    want = pdf.set_index(["symbol", "ts"])["rn"]
    got = got.set_index(["symbol", "ts"])
    assert (got["rn"].sort_index() == want.sort_index()).all()
    assert (got["total"] == got["n"]).all()


def test_index_rows_keeps_null_keys(spark):
    d = spark.createDataFrame([(None, 1), (None, 2), ("a", 1)], "k string, v int")
    got = index_rows(d, ["k"], ["v"], [F.col("v") % 2 * 0]).collect()
    assert sorted((r.k or "", r.rn) for r in got) == [("", 1), ("", 2), ("a", 1)]


def test_index_rows_shuffles_its_rows_once(spark):
    d = stage(spark.range(50).selectExpr("cast(id % 3 as string) k", "id v", "id * 2 payload"))
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = index_rows(d, ["k"], ["v"], [F.floor(F.col("v") / 10)])._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
    assert plan.count("Exchange hashpartitioning") == 4          # rows once; counts by bucket, by key, and back by bucket


@pytest.mark.parametrize("halo,size", [(3, 10), (25, 10), (0, 64)])
def test_halo_rows_come_back_once(walk, halo, size):
    pdf, df = walk
    o = open_blocks(df, halo, size)
    per_block = o.groupBy("symbol", "_blk").count().agg(F.max("count")).first()[0]
    assert per_block <= size + halo          # no group grows with the key
    assert close_blocks(o).count() == len(pdf)


@pytest.mark.parametrize("size", [7, 256, 100000])
def test_running_matches_pandas(walk, size):
    pdf, df = walk
    d = df.withColumn("gap", F.when(F.col("rn") % 3 == 0, F.col("close")))
    got = running(d, K, {"s": ("sum", "close"), "lo": ("min", "close"), "hi": ("max", "close"), "c": ("count", "gap"), "l": ("last", "gap")}, size)
    got = got.toPandas().sort_values(["symbol", "rn"]).reset_index(drop=True)
    p = pdf.sort_values(["symbol", "rn"]).reset_index(drop=True)
    g = p.groupby("symbol")["close"]
    gap = p["close"].where(p["rn"] % 3 == 0)
    np.testing.assert_allclose(got["s"], g.cumsum(), rtol=1e-12)
    np.testing.assert_array_equal(got["lo"], g.cummin())
    np.testing.assert_array_equal(got["hi"], g.cummax())
    np.testing.assert_array_equal(got["c"], gap.notna().groupby(p["symbol"]).cumsum())
    np.testing.assert_array_equal(got["l"], gap.groupby(p["symbol"]).ffill())


@pytest.mark.parametrize("size", [1, 7, 4096])
def test_latch_matches_a_loop(spark, walk, size):
    pdf, df = walk
    d = df.withColumns({"entry": F.hash("rn") % 5 == 0, "exit": F.hash("close") % 5 == 0})
    rows = running_latch(stage(d), K, "entry", "exit", size=size, hold="close").collect()
    for sym in ("HOT", "COLD"):
        state, held = 0, None
        for r in sorted((r for r in rows if r.symbol == sym), key=lambda r: r.rn):
            before = state
            if not state and r.entry:
                state, held = 1, r.close
            elif state and r.exit:
                state = 0
            assert (r.state_before, r.state, r.state_held) == (before, state, held)


def test_chained_fold_repairs_wrong_borders(spark, walk):
    """A fold that never forgets its past still equals one sequential pass."""
    pdf, df = walk

    def fold(p, s):
        out = s[0] + np.cumsum(p["close"].to_numpy() > 100).astype(float)
        return pd.DataFrame({"y": out}), [float(out[-1]) if len(out) else s[0]]
    got = chained_fold(df, K, fold, [0.0], T.StructType([T.StructField("y", T.DoubleType())]), ["close"], halo=5, size=500).toPandas()
    want = pdf.assign(y=(pdf["close"] > 100).groupby(pdf["symbol"]).cumsum())
    m = got.merge(want, on=["symbol", "rn"])
    assert len(m) == len(pdf) and (m["y_x"] == m["y_y"]).all()


def test_chained_fold_through_more_than_a_thousand_blocks(walk):
    """A state carried from the first to the last of 1050 blocks, where every provisional border is wrong."""
    pdf, df = walk
    pdf, df = pdf[pdf["rn"] <= 2100], df.filter("rn <= 2100")

    def fold(p, s):
        out = s[0] + np.cumsum(p["volume"].to_numpy())
        return pd.DataFrame({"y": out}), [float(out[-1]) if len(out) else s[0]]
    got = chained_fold(df, K, fold, [0.0], T.StructType([T.StructField("y", T.DoubleType())]), ["volume"], halo=2, size=2).toPandas()
    m = got.merge(pdf.assign(y=pdf.groupby("symbol")["volume"].cumsum()), on=["symbol", "rn"])
    assert len(m) == len(pdf) and (m["y_x"] == m["y_y"]).all()


@pytest.mark.parametrize("size", [3, 50])
def test_running_affine_with_restarts(spark, walk, size):
    pdf, df = walk
    d = stage(df.filter("rn <= 300").withColumns({"a": F.when(F.col("rn") % 40 == 0, 0.0).when(F.col("rn") % 2 == 0, 0.5).otherwise(1.0), "b": F.col("close")}))
    got = running_affine(d, K, "a", ["b"], size).toPandas().sort_values(["symbol", "rn"])
    for _, g in got.groupby("symbol"):
        y = 0.0
        for a, b, v, before in zip(g["a"], g["b"], g["b_y"], g["b_before"]):
            assert abs(y - before) < 1e-9
            y = a * y + b
            assert abs(y - v) < 1e-9
    assert list(got.columns) == [*d.columns, "b_y", "b_before"]


def test_running_affine_over_several_levels(spark):
    """Chunks of three rows: five levels of maps; a state carried on through all of them."""
    d = stage(spark.range(1, 251).select(F.lit("a").alias("k"), F.col("id").alias("rn"), F.lit(0.999).alias("f"), F.when(F.col("id") == 1, 1000.0).otherwise(0.0).alias("b")))
    got = {r["rn"]: r["b_y"] for r in running_affine(d, ["k"], "f", ["b"], 3).collect()}
    assert len(got) == 250 and all(abs(got[n] - 1000 * 0.999 ** (n - 1)) < 1e-8 for n in got)
    assert running_affine(d.limit(0), ["k"], "f", ["b"], 3).count() == 0


@pytest.mark.parametrize("values", ["normal", "ties", "tail", "one"])
def test_exact_percentiles(spark, values):
    rng = np.random.default_rng(1)
    x = {"normal": rng.normal(size=3001), "ties": rng.integers(0, 5, 2000).astype(float), "tail": np.exp(rng.normal(size=2500) * 5), "one": np.array([4.0])}[values]
    d = spark.createDataFrame(pd.DataFrame({"k": "a", "x": x}))
    ps = {"p5": 0.05, "q": 0.25, "m": 0.5, "p95": 0.95, "z": 1.0}
    got = exact_percentiles(d, ["k"], "x", ps).first()
    for n, p in ps.items():
        assert got[n] == pytest.approx(np.percentile(x, 100 * p), rel=1e-12, abs=1e-12)
