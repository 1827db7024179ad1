"""What-if scenarios over bars, and resampled futures.

Every run is described by one small row (window, severities, drawn positions); bars meet it by
an equi-join on the symbol and are changed by column expressions.  Scaling steps multiply all
prices of a row, so drift, noise and outliers are factors; only gaps and wicks need an order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.draws import distinct_positions, normal, uniform
from ..session import stage
from .blocks import BLOCK, block_window, close_blocks, open_blocks, span

FIELDS = ("depth", "days", "wick", "up", "up_days", "bounces", "bounce_pct", "slip_mult", "spread_mult", "gaps", "gap_lo", "gap_hi",
          "outliers", "out_lo", "out_hi", "mean_revert", "direction")

# The 17 scenarios; fields not given are 0 (multipliers 1, direction down).
PRESETS = {
    "gfc_2008": dict(depth=37, days=252, wick=1.5, bounces=2, bounce_pct=15),
    "covid_crash": dict(depth=34, days=30, wick=2.5, up=60, up_days=45),
    "flash_crash_2010": dict(depth=9, days=1, wick=3, outliers=1, out_lo=9, out_hi=20),
    "luna_collapse": dict(depth=95, days=7, wick=4),
    "liquidity_drought": dict(days=10, wick=1.2, slip_mult=5, spread_mult=3, direction="both"),
    "pump_dump": dict(depth=60, days=3, wick=2, up=50, up_days=5),
    "whipsaw_chop": dict(depth=5, days=60, wick=2.5, direction="both", mean_revert=1),
    "slow_bleed": dict(depth=40, days=180),
    "vol_spike": dict(days=30, wick=3, direction="both"),
    "gap_risk": dict(gaps=10, gap_lo=3, gap_hi=8, direction="both"),
    "range_bound": dict(depth=2, days=90, direction="both", mean_revert=1),
    "trend_reversal": dict(depth=25, days=20, wick=1.5, up=30, up_days=60),
    "outlier_injection": dict(outliers=5, out_lo=20, out_hi=30),
    "demonetization_2016": dict(depth=15, days=30, wick=2, up=8, up_days=20, gaps=4, gap_lo=2, gap_hi=6),
    "covid_nifty_mar2020": dict(depth=38, days=40, wick=3.5, up=70, up_days=90, gaps=5, gap_lo=3, gap_hi=8),
    "yes_bank_2020": dict(depth=85, days=120, wick=3, gaps=6, gap_lo=5, gap_hi=15),
    "expiry_gamma_squeeze": dict(wick=4, direction="both", outliers=4, out_lo=5, out_hi=12, gaps=4, gap_lo=2, gap_hi=6),
}


def scenario_rows(extra_outliers: int = 0, overrides: dict[str, float] | None = None) -> list[tuple]:
    base = {**dict.fromkeys(FIELDS, 0.0), "wick": 1.0, "slip_mult": 1.0, "spread_mult": 1.0, "direction": "down"}
    rows = []
    for name, given in PRESETS.items():
        v = {**base, **given, **(overrides or {})}
        v["outliers"] = v["outliers"] + extra_outliers
        rows.append((name, *[v[f] if f == "direction" else float(v[f]) for f in FIELDS]))
    return rows


def scenarios(spark: SparkSession, extra_outliers: int = 0, overrides: dict[str, float] | None = None) -> DataFrame:
    """Scenario dimension (17 rows), with optional overrides of any field."""
    rows = scenario_rows(extra_outliers, overrides)
    return spark.createDataFrame(rows, "scenario string, " + ", ".join(f"{f} {'string' if f == 'direction' else 'double'}" for f in FIELDS))


def run_severity(df: DataFrame, severity: float, seed: int, jitter: bool, ids: Sequence[str]) -> DataFrame:
    """The given severity, varied by up to 25 % per run with ``jitter``."""
    drawn = F.lit(severity) * (0.75 + 0.5 * uniform(f"{seed}sev", *ids)) if jitter else F.lit(severity)
    return df.withColumn("severity", drawn)


def regime_severity(df: DataFrame, scales: DataFrame, severity: float, seed: int, ids: Sequence[str]) -> DataFrame:
    """Draw a regime by its share and scale severity with its volatility, +-15 %.

    ``scales``: ``symbol, regime, vol_scale, fraction`` (three rows per symbol).
    """
    w = span(["symbol"]).orderBy("regime").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    c = scales.withColumn("_hi", F.sum("fraction").over(w)).withColumn("_lo", F.col("_hi") - F.col("fraction"))
    d = df.withColumn("_u", uniform(f"{seed}reg", *ids)).join(c, "symbol")
    top = F.max("_hi").over(Window.partitionBy("symbol", *[i for i in ids if i != "symbol"]))
    d = d.withColumn("_top", top)
    hit = (F.col("_u") * F.col("_top") >= F.col("_lo")) & (F.col("_u") * F.col("_top") < F.col("_hi"))
    return (d.filter(hit).withColumn("severity", F.lit(severity) * F.col("vol_scale") * (0.85 + 0.3 * uniform(f"{seed}sev", *ids)))
            .withColumnRenamed("regime", "drawn_regime").drop("_u", "_hi", "_lo", "_top", "fraction"))


def series_shape(bars: DataFrame, key: Sequence[str] = ("symbol",)) -> DataFrame:
    """Rows and bars per calendar day of each series."""
    days = bars.groupBy(*key, F.to_date("ts").alias("_d")).agg(F.count(F.lit(1)).alias("_c"))
    a = days.groupBy(*key).agg(F.sum("_c").alias("n"), F.count(F.lit(1)).alias("_days"))
    return a.withColumn("bpd", F.greatest(F.lit(1.0), F.col("n") / F.col("_days"))).drop("_days")


def shock_window(runs: DataFrame, seed: int, ids: Sequence[str]) -> DataFrame:
    """Start uniform in [5 %, 60 %) of the rows, length in trading days of the series."""
    lo = F.floor(F.col("n") * 0.05)
    hi = F.greatest(lo + 1, F.floor(F.col("n") * 0.60))
    start = (lo + F.floor(uniform(f"{seed}start", *ids) * (hi - lo))).cast("long")
    dur = F.greatest(F.lit(1), F.rint(F.col("days") * F.col("bpd"))).cast("long")
    return runs.withColumn("start", start).withColumn("dur", dur).withColumn("end", F.least(F.col("start") + F.col("dur"), F.col("n")))


def _seg(s: Column, e: Column, pct: Column, up: bool, persist: bool) -> Column:
    return F.struct(s.cast("long").alias("s"), F.least(e, F.col("n")).cast("long").alias("e"),
                    (1 + pct / 100 if up else 1 - pct / 100).alias("m"), (pct > 0).alias("on"), F.lit(persist).alias("p"))


def plan_runs(bars: DataFrame, spark: SparkSession, runs: int, severity: float = 1.0, seed: int = 7,
              names: Sequence[str] | None = None, extra_outliers: int = 0, key: Sequence[str] = ("symbol",), jitter: bool | None = None) -> DataFrame:
    """One row per (key, scenario, run) with everything the run draws; severities differ with several runs or ``jitter``."""
    ids = [*key, "scenario", "run_id"]
    # the fixed scenario rows are a literal array: each series fans out without a join
    dim = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(("scenario", *FIELDS), row)])
                    for row in scenario_rows(extra_outliers) if not names or row[0] in names])
    d = series_shape(bars, key).withColumn("_d", F.explode(dim)).select(*key, "n", "bpd", "_d.*")
    d = d.withColumn("run_id", F.explode(F.sequence(F.lit(1), F.lit(runs))))
    d = shock_window(run_severity(d, severity, seed, jitter if jitter is not None else runs > 1, ids), seed, ids)
    c, sev, name = F.col, F.col("severity"), F.col("scenario")
    shock = c("depth") * sev
    shock = F.when(name.isin("luna_collapse", "yes_bank_2020"), F.least(shock, F.lit(99.0))).otherwise(shock)
    vm = 1 + (c("wick") - 1) * sev
    up_dur = F.greatest(F.lit(1), F.rint(c("up_days") * c("bpd"))).cast("long")
    s, e, n = c("start"), c("end"), c("n")
    d = d.withColumns({"_shock": shock, "_vm": vm, "_up": c("up") * sev, "_ud": up_dur})
    pe = F.least(s + c("_ud"), n)
    re = F.least(pe + c("dur"), n)
    bounce = lambda i: _seg(s + F.floor(c("dur") * i / 3), F.least(s + F.floor(c("dur") * i / 3) + F.greatest(F.lit(1), F.floor(c("dur") / 8)), e),
                            c("bounce_pct") * sev, True, False)
    down = _seg(s, e, c("_shock"), False, True)
    drift = (F.when(name == "gfc_2008", F.array(down, bounce(1), bounce(2)))
             .when(name.isin("covid_crash", "covid_nifty_mar2020"), F.array(down, _seg(e, e + c("_ud"), c("_up"), True, True)))
             .when(name.isin("luna_collapse", "slow_bleed", "yes_bank_2020"), F.array(down))
             .when(name.isin("pump_dump", "trend_reversal"), F.array(_seg(s, pe, c("_up"), True, False), _seg(pe, re, c("_shock"), False, True)))
             .when(name == "demonetization_2016", F.array(_seg(s, e, c("_shock"), False, False), _seg(e, e + c("_ud"), c("_up"), True, False))))
    spread = F.greatest(F.lit(1.0), c("spread_mult") * sev)
    wick_m = (F.when(name == "liquidity_drought", spread)
              .when(name.isin("pump_dump", "slow_bleed", "gap_risk", "outlier_injection"), 1.0).otherwise(c("_vm")))
    wick_e = (F.when(name == "flash_crash_2010", F.least(s + 3, n)).when(name == "trend_reversal", re)
              .when(name == "expiry_gamma_squeeze", n).otherwise(e))
    chop = (F.when(name == "liquidity_drought", (spread - 1) * 0.4 * sev).when(name.isin("whipsaw_chop", "range_bound"), c("_shock"))
            .when(name == "vol_spike", (c("_vm") - 1) * 1.5 * sev).when(name == "gap_risk", (c("gap_lo") + c("gap_hi")) / 2 * 0.25 * sev).otherwise(0.0))
    whole = name.isin("gap_risk", "expiry_gamma_squeeze")
    g_lo = F.when(whole, 0).otherwise(s).cast("long")
    g_n = F.greatest(F.lit(1), F.when(whole, n - 1).otherwise(e - s)).cast("long")
    k = lambda x: F.when(x > 0, F.greatest(F.lit(1), F.rint(x * sev))).otherwise(0).cast("long")
    none = F.array().cast("array<bigint>")
    d = d.withColumns({"drift": F.coalesce(drift, F.array().cast("array<struct<s:bigint,e:bigint,m:double,on:boolean,p:boolean>>")),
                       "w_s": F.when(name == "expiry_gamma_squeeze", 0).otherwise(s).cast("long"), "w_e": wick_e.cast("long"), "w_m": wick_m,
                       "c_s": F.when(name == "gap_risk", 0).otherwise(s).cast("long"), "c_e": F.when(name == "gap_risk", n).otherwise(e).cast("long"),
                       "c_pct": chop, "_g_lo": g_lo, "_g_n": g_n, "_gk": k(c("gaps")), "_ok": k(c("outliers"))})
    d = d.withColumns({
        "gap_at": F.when(c("_gk") > 0, F.transform(distinct_positions(f"{seed}gap", c("_gk"), c("_g_n"), *ids), lambda i: i + F.col("_g_lo"))).otherwise(none),
        "out_at": F.when(c("_ok") > 0, distinct_positions(f"{seed}out", c("_ok"), n.cast("long"), *ids)).otherwise(none),
        "spike_at": F.when(name == "flash_crash_2010", s).otherwise(F.lit(None).cast("long")),
        "gap_dir": F.when(name.isin("gap_risk", "expiry_gamma_squeeze"), "both").otherwise("down"),
        "gap_first": name.isin("covid_nifty_mar2020", "yes_bank_2020")})
    return d.select(*ids, "n", "severity", "start", "end", "drift", "w_s", "w_e", "w_m", "c_s", "c_e", "c_pct", "mean_revert", "gap_at",
                    "gap_lo", "gap_hi", "gap_dir", "gap_first", "out_at", "out_lo", "out_hi", "spike_at", "direction", F.col("_shock").alias("shock"))


def drift_factor(i: Column, drift: Column) -> Column:
    """Product of geometric drifts at 0-based row ``i``; a persistent one keeps its end level."""
    def one(acc, d):
        inside = (i >= d["s"]) & (i < d["e"])
        part = F.when(inside, F.pow(d["m"], (i - d["s"] + 1) / (d["e"] - d["s"]))).when(d["p"] & (i >= d["e"]), d["m"]).otherwise(1.0)
        return acc * F.when(d["on"] & (d["e"] > d["s"]), part).otherwise(1.0)
    return F.aggregate(drift, F.lit(1.0), one)


def _sign(direction: Column, u: Column) -> Column:
    return F.when(direction == "down", -1.0).when(direction == "up", 1.0).otherwise(F.when(u < 0.5, -1.0).otherwise(1.0))


def wick(h: Column, lo: Column, c: Column, m: Column, on: Column) -> tuple[Column, Column]:
    grow = on & (m > 1)
    return (F.when(grow, c + F.greatest(F.lit(0.0), h - c) * m).otherwise(h), F.when(grow, c - F.greatest(F.lit(0.0), c - lo) * m).otherwise(lo))


def repair_ohlc(df: DataFrame) -> DataFrame:
    """Prices at least 1e-6, high and low around open and close."""
    d = df.withColumns({c: F.greatest(F.col(c), F.lit(1e-6)) for c in ("open", "high", "low", "close")})
    return d.withColumns({"high": F.greatest("open", "high", "close"), "low": F.least("open", "low", "close")})


def chop_factor(d: DataFrame, key: Sequence[str], seed: int, size: int) -> DataFrame:
    """Noise factor ``exp(r)``; the mean-reverting kind is an AR(-0.5) rescaled to its target.

    The recursion fades by half per row, so 54 rows of halo reproduce it to double precision.
    """
    on = (F.col("_i") >= F.col("c_s")) & (F.col("_i") < F.col("c_e")) & (F.col("c_pct") > 0)
    d = d.withColumn("_z", F.when(on, normal(f"{seed}chop", *key, "rn") * F.col("c_pct") / 100))
    plain = d.filter("mean_revert = 0").withColumn("_r", F.col("_z"))
    o = open_blocks(d.filter("mean_revert > 0"), 54, size)
    near = F.collect_list("_z").over(block_window(key).rowsBetween(-53, Window.currentRow))
    ar = F.aggregate(near, F.lit(0.0), lambda acc, v: v - 0.5 * acc)
    o = close_blocks(o.withColumn("_a", F.when(F.col("_z").isNotNull(), ar)))
    sd = o.groupBy(*key).agg(F.stddev_pop("_a").alias("_sd"))
    o = o.join(sd, list(key)).withColumn("_r", F.when(F.col("_sd") > 1e-12, F.col("_a") * (F.col("c_pct") / 100) / F.col("_sd")).otherwise(F.col("_a")))
    return plain.unionByName(o.drop("_a", "_sd")).withColumn("_chop", F.exp(F.coalesce("_r", F.lit(0.0)))).drop("_z", "_r")


def apply_scenario(bars: DataFrame, runs: DataFrame, seed: int = 7, size: int = BLOCK, key: Sequence[str] = ("symbol",),
                   noise: bool = True) -> DataFrame:
    """Bars of every (symbol, scenario, run) after its shock, ordered columns as in ``bars``.

    ``bars`` carries ``rn``; the previous close comes from a one-row halo before the fan-out.
    """
    o = open_blocks(bars, 1, size)
    b = close_blocks(o.withColumn("_pc", F.lag("close").over(block_window(key))))
    k3 = [*key, "scenario", "run_id"]
    d = b.drop("n").join(runs, list(key)).withColumn("_i", F.col("rn") - 1)
    i = F.col("_i")
    f, fp = drift_factor(i, F.col("drift")), drift_factor(i - 1, F.col("drift"))
    d = d.withColumns({"_f": f, "_pc": F.col("_pc") * fp})
    d = d.withColumns({x: F.col(x) * F.col("_f") for x in ("open", "high", "low", "close")})
    inside = (i >= F.col("w_s")) & (i < F.col("w_e"))
    h, lo = wick(F.col("high"), F.col("low"), F.col("close"), F.col("w_m"), inside & ~F.col("gap_first"))
    d = d.withColumns({"high": h, "low": lo})
    hit = F.array_contains("gap_at", i) & (i > 0)
    pct = F.col("gap_lo") + uniform(f"{seed}gp", *k3, "rn") * (F.col("gap_hi") - F.col("gap_lo"))
    new = F.greatest(F.lit(1e-6), F.col("_pc") * (1 + _sign(F.col("gap_dir"), uniform(f"{seed}gs", *k3, "rn")) * pct / 100))
    d = d.withColumn("_new", F.when(hit, new))
    d = d.withColumn("_k", F.when(F.col("_new").isNotNull(), F.when(F.col("open") > 0, F.col("_new") / F.nullif(F.col("open"), F.lit(0.0))).otherwise(1.0)))
    gap = F.col("_new").isNotNull()
    d = d.withColumns({"open": F.coalesce("_new", "open"), "high": F.when(gap, F.greatest(F.col("_new"), F.col("high") * F.col("_k"))).otherwise(F.col("high")),
                       "low": F.when(gap, F.least(F.col("_new"), F.col("low") * F.col("_k"))).otherwise(F.col("low"))})
    h, lo = wick(F.col("high"), F.col("low"), F.col("close"), F.col("w_m"), inside & F.col("gap_first"))
    d = d.withColumns({"high": h, "low": lo})
    d = chop_factor(d, k3, seed, size) if noise else d.withColumn("_chop", F.lit(1.0))
    opct = F.col("out_lo") + uniform(f"{seed}op", *k3, "rn") * (F.col("out_hi") - F.col("out_lo"))
    out = F.when(F.array_contains("out_at", i), F.greatest(F.lit(0.001), 1 + _sign(F.col("direction"), uniform(f"{seed}os", *k3, "rn")) * opct / 100)).otherwise(1.0)
    spike = F.when(i == F.col("spike_at"), F.greatest(F.lit(0.001), 1 - F.col("shock") / 100)).otherwise(1.0)
    d = d.withColumn("_m", F.col("_chop") * out * spike)
    d = d.withColumns({x: F.col(x) * F.col("_m") for x in ("open", "high", "low", "close")})
    return repair_ohlc(d).select(*k3, "rn", "ts", "open", "high", "low", "close", "volume", "severity")


def stressed_slippage(base: float, mult: Column, severity: Column) -> Column:
    return F.when(mult > 1, base * mult * severity).otherwise(F.lit(base))


# ------------------------------------------------------------------ resampled futures

def bar_ratios(bars: DataFrame, key: Sequence[str] = ("symbol",), size: int = BLOCK) -> DataFrame:
    """Row-to-row ratios from which bars can be rebuilt; ``idx`` runs from 0."""
    o = open_blocks(bars, 1, size)
    pc = F.lag("close").over(block_window(key))
    prev = F.when(pc != 0, pc).otherwise(1e-10)
    cur = F.when(F.col("close") != 0, F.col("close")).otherwise(1e-10)
    # a close of zero is floored in its own ratio and in the next one, so the two floors cancel
    o = o.withColumns({"r_ret": F.greatest(F.col("close"), F.lit(1e-10)) / prev, "r_high": F.col("high") / cur, "r_low": F.col("low") / cur,
                       "r_open": F.col("open") / prev, "_has": pc.isNotNull()})
    return close_blocks(o).filter("_has").select(*key, (F.col("rn") - 2).alias("idx"), "r_ret", "r_high", "r_low", "r_open", F.col("volume").alias("vol"))


def block_bootstrap(bars: DataFrame, paths: int, horizon: int, block: int = 20, seed: int = 7,
                    key: Sequence[str] = ("symbol",), size: int = BLOCK) -> DataFrame:
    """Circular block bootstrap: ``paths`` futures of ``horizon`` bars per symbol.

    Only ids are exploded; ratios join late on (symbol, position).  A path is a bounded group,
    so its cumulative product is one small window.
    """
    key = list(key)
    base = bars.groupBy(*key).agg((F.max("rn") - 1).alias("m"), F.max_by("close", "rn").alias("last"))
    blocks = -(-horizon // block)
    d = (base.withColumn("path_id", F.explode(F.sequence(F.lit(1), F.lit(paths))))
         .withColumn("_b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))))
    d = d.withColumn("_s", F.floor(uniform(f"{seed}bb", *key, "path_id", "_b") * F.col("m")))
    d = d.withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(block - 1))))
    d = d.select(*key, "path_id", "last", (F.col("_b") * block + F.col("_k") + 1).alias("step"), ((F.col("_s") + F.col("_k")) % F.col("m")).alias("idx"))
    d = d.filter(F.col("step") <= horizon).join(bar_ratios(bars, key, size), [*key, "idx"])
    w = Window.partitionBy(*key, "path_id").orderBy("step")
    d = d.withColumn("close", F.greatest(F.col("last") * F.exp(F.sum(F.ln("r_ret")).over(w.rowsBetween(Window.unboundedPreceding, 0))), F.lit(1e-10)))
    d = d.withColumn("open", F.greatest(F.coalesce(F.lag("close").over(w), F.col("last")) * F.col("r_open"), F.lit(1e-10)))
    d = d.withColumns({"high": F.greatest(F.col("close") * F.col("r_high"), F.col("open"), F.col("close")),
                       "low": F.greatest(F.least(F.col("close") * F.col("r_low"), F.col("open"), F.col("close")), F.lit(1e-10)),
                       "volume": F.greatest(F.col("vol"), F.lit(0.0))})
    return d.select(*key, "path_id", "step", "open", "high", "low", "close", "volume")


def crisis_overlay(paths: DataFrame, spark: SparkSession, names: Sequence[str], severity: float = 1.0, seed: int = 7,
                   size: int = BLOCK, key: Sequence[str] = ("symbol",)) -> DataFrame:
    """Put each named scenario on top of every resampled path, severity jittered per path."""
    k = [*key, "path_id"]
    p = paths.withColumns({"rn": F.col("step").cast("long"), "ts": F.timestamp_seconds(F.col("step") * 86400).cast("timestamp_ntz")}).drop("step")
    runs = plan_runs(p, spark, 1, severity, seed, names, key=k, jitter=True)
    d = apply_scenario(p, runs, seed, size, k)
    return d.select(*k, "scenario", F.col("rn").cast("int").alias("step"), "open", "high", "low", "close", "volume", "severity")
