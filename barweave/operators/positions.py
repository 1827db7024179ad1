"""Round trips, ledgers, equity and costs as table operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stage
from ..sources.bars import seconds
from .blocks import BLK, BLOCK, block_of, block_window, index_rows, running, span

CHUNK = 32           # rows folded into one map by running_affine, and listed at once by the ledger's fold

# Indian transaction-cost rates (2024) per market and side.
STT_RATES = {"equity_delivery_buy": 0.001, "equity_delivery_sell": 0.001, "equity_intraday_sell": 0.00025,
             "futures_sell": 0.0002, "options_sell": 0.001}
EXCHANGE_RATES = {"equity_delivery": 0.0000297, "equity_intraday": 0.0000297, "futures": 0.0000173,
                  "options": 0.0003503}
STAMP_RATES = {"equity_delivery": 0.00015, "equity_intraday": 0.00003, "futures": 0.00003, "options": 0.00003}
SEBI_RATE, GST_RATE = 0.000001, 0.18
COST_FIELDS = ["brokerage", "stt", "exchange_charges", "sebi_charges", "gst", "stamp_duty", "total"]


def rate_card(spark) -> DataFrame:
    """One row per market and side (8 rows), to be broadcast."""
    rows = [(m, s, STT_RATES.get(f"{m}_{s.lower()}", 0.0), EXCHANGE_RATES[m],
             STAMP_RATES[m] if s == "BUY" else 0.0, 0.001 if m == "equity_delivery" else 0.025)
            for m in EXCHANGE_RATES for s in ("BUY", "SELL")]
    return spark.createDataFrame(rows, "market_type string, side string, stt_rate double, exch_rate double, "
                                       "stamp_rate double, flat_cap double")


def indian_cost(df: DataFrame, turnover: str = "turnover", side: str = "side", market: str = "market_type",
                model: str = "flat", flat: float = 20.0, pct: float = 0.005) -> DataFrame:
    """Add the itemised cost struct ``cost`` of one trade leg; nothing is charged below zero turnover."""
    rates = F.broadcast(rate_card(df.sparkSession).withColumnsRenamed({"market_type": market, "side": side}))
    t = F.greatest(F.col(turnover), F.lit(0.0))
    brokerage = {"flat": F.least(F.lit(flat), t * F.col("flat_cap")), "percentage": t * pct,
                 "zero": F.lit(0.0)}[model]
    d = df.join(rates, [market, side])
    d = d.withColumns({"_b": brokerage, "_s": t * F.col("stt_rate"), "_e": t * F.col("exch_rate"),
                       "_r": t * SEBI_RATE, "_d": t * F.col("stamp_rate")})
    d = d.withColumn("_g", (F.col("_b") + F.col("_e") + F.col("_r")) * GST_RATE)
    total = F.col("_b") + F.col("_s") + F.col("_e") + F.col("_r") + F.col("_g") + F.col("_d")
    parts = dict(zip(COST_FIELDS, [F.col(c) for c in ("_b", "_s", "_e", "_r", "_g", "_d")] + [total]))
    return (d.withColumn("cost", F.struct(*[c.alias(n) for n, c in parts.items()]))
             .drop("stt_rate", "exch_rate", "stamp_rate", "flat_cap", "_b", "_s", "_e", "_r", "_g", "_d"))


def cost_totals(df: DataFrame, key: Sequence[str], cost: str = "cost") -> DataFrame:
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("legs"),
                                *[F.sum(F.col(cost)[f]).alias(f) for f in COST_FIELDS])


def simple_fee(turnover: Column, pct: float) -> Column:
    return F.round(turnover * pct, 4)


def effective_pct(df: DataFrame, model: str = "flat", market: str = "market_type", turnover: str = "turnover") -> DataFrame:
    """``df`` with the cost of buying and selling each row's turnover as a percentage of it (null where it is zero)."""
    d = df
    for side in ("BUY", "SELL"):
        d = indian_cost(d.withColumn("_side", F.lit(side)), side="_side", market=market, turnover=turnover, model=model).withColumn(f"_{side}", F.col("cost.total")).drop("_side", "cost")
    pct = (F.col("_BUY") + F.col("_SELL")) / F.nullif(F.col(turnover), F.lit(0.0)) * 100
    return d.withColumn("effective_pct", F.round(pct, 3)).drop("_BUY", "_SELL")


def slip(price: Column, side: Column, s: float) -> Column:
    return price * F.when(side == "BUY", 1 + s).otherwise(1 - s)


def lot_floor(q: Column, lot: Column | int) -> Column:
    return F.floor(q / lot) * lot


def apply_lots(signals: DataFrame, lot: Column | int) -> DataFrame:
    """Round quantities down to lots; a sub-lot buy is skipped, a sub-lot sell becomes one lot."""
    lot = F.lit(lot) if isinstance(lot, int) else lot
    q = lot_floor(F.col("quantity"), lot)
    skip = (F.col("signal") == "BUY") & (q <= 0)
    q = F.when(skip, 0.0).when((F.col("signal") == "SELL") & (q <= 0), lot).otherwise(q)
    return signals.withColumns({"lot_skipped": skip, "lot_quantity": q.cast("double"),
                                "signal": F.when(skip, "HOLD").otherwise(F.col("signal"))})


# ------------------------------------------------------------------ round trips and equity

def floored_sum(d: DataFrame, key: Sequence[str], size: int = BLOCK) -> DataFrame:
    """``d`` with the running sum of ``_d`` floored at zero: ``_before`` and ``_after`` each row.

    It is the sum minus its running minimum.  Both run inside blocks in one sort; a block is summed
    up as (sum, smallest prefix), and those rows are scanned.
    """
    key = list(key)
    d = d.withColumn(BLK, block_of(F.col("rn"), size))
    w = block_window(key)
    upto, before = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("_s", F.sum("_d").over(upto))
    d = stage(d.withColumns({"_m": F.min("_s").over(upto), "_mb": F.min("_s").over(before), "_sb": F.coalesce(F.lag("_s").over(w), F.lit(0.0))}))
    ends = d.groupBy(*key, BLK).agg(F.max_by("_s", "rn").alias("_sum"), F.min("_m").alias("_low"))
    earlier = span(key).orderBy(BLK).rowsBetween(Window.unboundedPreceding, -1)
    heads = ends.withColumn("_c", F.coalesce(F.sum("_sum").over(earlier), F.lit(0.0)))
    heads = heads.withColumn("_f", F.least(F.lit(0.0), F.coalesce(F.min(F.col("_c") + F.col("_low")).over(earlier), F.lit(0.0)))).select(*key, BLK, "_c", "_f")
    d = d.join(heads, [*key, BLK])
    was = F.col("_c") + F.col("_sb") - F.least("_f", F.coalesce(F.col("_c") + F.col("_mb"), F.col("_f")))
    now = F.col("_c") + F.col("_s") - F.least(F.col("_f"), F.col("_c") + F.col("_m"))
    return d.withColumns({"_before": was, "_after": now}).drop(BLK, "_s", "_m", "_mb", "_sb", "_c", "_f")


def holdings(signals: DataFrame, key: Sequence[str], size: int = BLOCK) -> DataFrame:
    """Each bar with ``bought``, ``sold`` (capped at what is held), ``held_before`` and ``held``: a running sum floored at zero."""
    key = list(key)
    q = F.coalesce("quantity", F.lit(0.0))
    move = F.when(F.col("signal") == "BUY", q).when(F.col("signal") == "SELL", -q).otherwise(0.0)
    d = floored_sum(signals.select(*key, "rn", "ts", "close", "signal", move.alias("_d")), key, size)
    d = d.withColumn("held_before", F.when(F.col("_before") > 1e-10, F.col("_before")).otherwise(0.0))
    d = d.withColumns({"bought": F.greatest(F.col("_d"), F.lit(0.0)), "sold": F.least(F.greatest(-F.col("_d"), F.lit(0.0)), "held_before")})
    left = F.col("held_before") + F.col("bought") - F.col("sold")
    return d.withColumn("held", F.when(left > 1e-10, left).otherwise(0.0)).select(*key, "rn", "ts", "close", "signal", "bought", "sold", "held_before", "held")


def round_trips(signals: DataFrame, key: Sequence[str], slippage: float = 0.001, fee: float = 0.001,
                size: int = BLOCK) -> DataFrame:
    """One trade per realised sale against the weighted-average entry; what is held at the end closes on the last bar.

    Buys may repeat and sales may be partial; a sale is capped at the holding.  A stretch from flat to
    flat without a buy after a sale has one average, a plain aggregate of its buys; only stretches
    that mix them follow the ledger's recurrence.  Entry time is the first buy of the stretch, fees
    are those of the sale and its share of the entry fees.
    """
    key = list(key)
    h = holdings(signals, key, size)
    last = h.groupBy(*key).agg(F.max_by(F.struct("rn", "ts", "close", "held"), "rn").alias("z")).filter("z.held > 0")
    close = last.select(*key, (F.col("z.rn") + 1).alias("rn"), "z.ts", "z.close", F.lit("SELL").alias("signal"), F.lit(0.0).alias("bought"),
                        F.col("z.held").alias("sold"), F.col("z.held").alias("held_before"), F.lit(0.0).alias("held"), F.lit(True).alias("open_end"))
    ev = h.filter("bought > 0 or sold > 0").withColumn("open_end", F.lit(False)).unionByName(close)
    ev = stage(index_rows(ev, key, ["rn"], [block_of(F.col("rn"), size)], out="en"))
    opens = (F.col("bought") > 0) & (F.col("held_before") <= 0)
    ev = running(ev, key, {"cycle": ("sum", F.when(opens, 1).otherwise(0)), "trade_no": ("sum", F.when(F.col("sold") > 0, 1).otherwise(0))}, size, rn="en")
    value = F.col("bought") * F.col("close") * (1 + slippage)
    ev = stage(ev.withColumns({"_cost": value, "_fee": simple_fee(value, fee), "_a": F.when(F.col("bought") > 0, F.when(F.col("held_before") > 0, 1.0).otherwise(0.0)).otherwise(F.col("held") / F.col("held_before"))}))
    cyc = [*key, "cycle"]
    c = ev.groupBy(*cyc).agg(F.sum("_cost").alias("cost"), F.sum("_fee").alias("entry_fees"), F.sum("bought").alias("qty"), F.min("ts").alias("entry_time"),
                             F.coalesce(F.max(F.when(F.col("bought") > 0, F.col("en"))) > F.min(F.when(F.col("sold") > 0, F.col("en"))), F.lit(False)).alias("mixed"))
    c = stage(c)
    sales = ev.filter("sold > 0").join(c, cyc)
    plain = sales.filter("not mixed").withColumns({"_e": F.col("cost") / F.col("qty"), "_ef": F.col("entry_fees") / F.col("qty") * F.col("sold")})
    cols = [*key, "trade_no", "entry_time", F.col("ts").alias("exit_time"), F.col("close").alias("_x"), F.col("sold").alias("quantity"), "_e", "_ef", "open_end"]
    t = plain.select(*cols)
    mixed = c.filter("mixed")
    if not mixed.isEmpty():
        m = ev.join(mixed.select(*cyc, "entry_time"), cyc)
        m = stage(index_rows(m, key, ["en"], [block_of(F.col("en"), size)], out="mn"))
        y = running_affine(m, key, "_a", ["_cost", "_fee"], rn="mn").filter("sold > 0")
        y = y.withColumns({"_e": F.col("_cost_before") / F.col("held_before"), "_ef": F.col("_fee_before") * F.col("sold") / F.col("held_before")})
        t = t.unionByName(y.select(*cols))
    return trade_pnl(t, key, slippage, fee)


def trade_pnl(t: DataFrame, key: Sequence[str], slippage: float, fee: float) -> DataFrame:
    """Slipped exit, fees of the exit and the entry's share, profit and its share of the entry value; ``_e`` is the slipped entry."""
    q = F.col("quantity")
    d = t.withColumns({"entry_price": F.col("_e"), "exit_price": F.col("_x") * (1 - slippage)})
    d = d.withColumn("fees", F.col("_ef") + simple_fee(F.col("exit_price") * q, fee))
    d = d.withColumn("pnl", (F.col("exit_price") - F.col("entry_price")) * q - F.col("fees"))
    return d.select(*key, "trade_no", "entry_time", "entry_price", "exit_time", "exit_price", "quantity", "pnl",
                    (F.col("pnl") / (F.col("entry_price") * q)).alias("pnl_pct"), "fees",
                    F.lit("long").alias("side"), "open_end")


def equity_curve(signals: DataFrame, key: Sequence[str], capital: float = 10_000.0, slippage: float = 0.001,
                 fee: float = 0.001, size: int = BLOCK) -> DataFrame:
    """Mark-to-market equity per bar; row 0 is the starting capital, the last row is realised; sales are capped at the holding."""
    key = list(key)
    d = holdings(signals, key, size)
    bought, sold = F.col("bought") * F.col("close") * (1 + slippage), F.col("sold") * F.col("close") * (1 - slippage)
    flow = F.when(F.col("bought") > 0, -(bought + simple_fee(bought, fee))).when(F.col("sold") > 0, sold - simple_fee(sold, fee)).otherwise(0.0)
    last = d.groupBy(*key).agg(F.max("rn").alias("_n"), F.min("ts").alias("_t0"))
    d = running(d, key, {"_cash": ("sum", flow)}, size).join(last, key)
    exit_ = F.col("held") * F.col("close") * (1 - slippage)
    open_ = F.col("held") > 1e-9
    value = F.when(open_ & (F.col("rn") == F.col("_n")), exit_ - simple_fee(exit_, fee)).when(
        open_, F.col("held") * F.col("close")).otherwise(0.0)
    # Rounded far below a cent: a flat stretch must not show last-bit noise as returns.
    rows = d.select(*key, "rn", "ts", F.round(F.lit(capital) + F.col("_cash") + value, 8).alias("equity"))
    head = last.select(*key, F.lit(0).cast("long").alias("rn"), F.col("_t0").alias("ts"),
                       F.lit(float(capital)).alias("equity"))
    return head.unionByName(rows)


# ------------------------------------------------------------------ weighted-average-cost ledger

def running_affine(df: DataFrame, key: Sequence[str], a: str, bs: Sequence[str], size: int = CHUNK, rn: str = "rn") -> DataFrame:
    """``df`` with ``<b>_y``, where ``y = a*y + b`` with a factor per row (0 restarts), and ``<b>_before``, its value before the row.

    Affine maps compose, so ``size`` rows in order are folded into one map and the state each row meets
    is known up to the state at the chunk's head.  The maps are rows of the same problem, ``size`` times
    fewer: they are solved the same way until every key is one chunk, so no group ever holds more than
    ``size`` rows.  Rows travel inside their chunk: one shuffle, no join back to ``df``.
    """
    key, bs = list(key), list(bs)
    rest = [c for c in df.columns if c not in key]
    row = F.struct(F.col(rn).alias("at"), F.struct(*rest).alias("row"))
    chunks = df.withColumn(BLK, block_of(F.col(rn), size)).groupBy(*key, BLK).agg(F.sort_array(F.collect_list(row)).alias("_rows"))
    met = ["p", *[f"y{i}" for i in range(len(bs))]]
    state = F.struct(F.lit(1.0).alias("p"), *[F.lit(0.0).alias(m) for m in met[1:]], F.array().cast(f"array<struct<{','.join(f'{m}:double' for m in met)}>>").alias("met"))

    def step(acc, r):
        f = r["row"][a]
        seen = F.concat(acc["met"], F.array(F.struct(*[acc[m].alias(m) for m in met])))
        return F.struct((acc["p"] * f).alias("p"), *[(acc[m] * f + r["row"][b]).alias(m) for m, b in zip(met[1:], bs)], seen.alias("met"))

    chunks = stage(chunks.withColumn("_map", F.aggregate("_rows", state, step)))
    heads = [f"_in{i}" for i in range(len(bs))]
    if (chunks.agg(F.max(BLK)).first()[0] or 0) > 0:
        ends = chunks.select(*key, (F.col(BLK) + 1).alias("rn"), F.col("_map.p").alias("f"), *[F.col(f"_map.{m}").alias(m) for m in met[1:]])
        solved = running_affine(ends, key, "f", met[1:], size)
        chunks = chunks.join(solved.select(*key, (F.col("rn") - 1).alias(BLK), *[F.col(f"{m}_before").alias(h) for m, h in zip(met[1:], heads)]), [*key, BLK])
    else:
        chunks = chunks.withColumns({h: F.lit(0.0) for h in heads})
    rows = chunks.select(*key, *heads, F.explode(F.arrays_zip(F.col("_rows").alias("r"), F.col("_map.met").alias("m"))).alias("z"))
    rows = rows.select(*key, *heads, "z.r.row.*", F.col("z.m").alias("_m"))
    rows = rows.withColumns({f"{b}_before": F.col(f"_m.{m}") + F.col("_m.p") * F.col(h) for b, m, h in zip(bs, met[1:], heads)})
    return rows.withColumns({f"{b}_y": F.col(a) * F.col(f"{b}_before") + F.col(b) for b in bs}).select(*df.columns, *[f"{b}_{x}" for b in bs for x in ("y", "before")])


def _let(value: Column, f) -> Column:
    """``f(value)`` with ``value`` computed once (inside a fold Spark does not share common expressions)."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _move(r: Column) -> Column:
    return F.when(r["side"] == "BUY", r["qty"]).otherwise(-r["qty"])


def _held(h: Column, move: Column) -> Column:
    """Holding after a move, never below zero; null as long as no quantity is known."""
    return F.when(move.isNull(), h).otherwise(F.greatest(F.lit(0.0), F.coalesce(h, F.lit(0.0)) + move))


def _kept(h: Column, held: Column, buy: Column) -> Column:
    """Share of the book that a fill leaves: ``h`` before it, ``held`` after it."""
    a = F.when(held <= 1e-10, 0.0).when(buy, 1.0).otherwise(F.when(h != 0, held / h))
    return F.coalesce(a, F.lit(0.0))


def _fold_fills(rows: Column, head: Column, fee: float, met: bool = False) -> Column:
    """State after ``rows`` from ``head`` = (h, p, c, f): holding, share kept, book cost, unspent entry fees.

    With ``met`` also lists of the states that rows meet, one list for each ``CHUNK`` rows, so that no list is copied
    once per row.  After a fill of unknown cost the amounts are null to the end of its ``CHUNK`` rows; the next
    ones go on from what is left of the cost known before these.
    """
    names, book = ["h", "p", "c", "f"], "struct<h:double,c:double,f:double>"

    def step(acc: Column, r: Column) -> Column:
        r = r["row"]
        buy = r["side"] == "BUY"
        cost = F.when(buy, r["price"] * r["qty"]).otherwise(0.0)
        seen = [F.concat(acc["met"], F.array(F.struct(*[acc[n].alias(n) for n in ("h", "c", "f")]))).alias("met")] if met else []
        return _let(_held(acc["h"], _move(r)), lambda held: _let(_kept(acc["h"], held, buy), lambda a: F.struct(
            held.alias("h"), (acc["p"] * a).alias("p"), (acc["c"] * a + cost).alias("c"), (acc["f"] * a + cost * fee).alias("f"), *seen)))

    def part_step(acc: Column, part: Column) -> Column:
        none = [F.array().cast(f"array<{book}>").alias("met")] if met else []
        start = F.struct(acc["h"].alias("h"), F.lit(1.0).alias("p"), acc["c"].alias("c"), acc["f"].alias("f"), *none)
        left = lambda z, n: F.coalesce(z[n], acc[n] * z["p"]).alias(n)
        return _let(F.aggregate(part, start, step), lambda z: F.struct(z["h"].alias("h"), (acc["p"] * z["p"]).alias("p"), left(z, "c"), left(z, "f"),
                                                                       *([F.concat(acc["met"], F.array(z["met"])).alias("met")] if met else [])))

    last = F.floor((F.size(rows) - 1) / CHUNK).cast("int")
    parts = F.transform(F.sequence(F.lit(0), last), lambda i: F.slice(rows, i * CHUNK + 1, F.lit(CHUNK)))
    none = [F.array().cast(f"array<array<{book}>>").alias("met")] if met else []
    return F.aggregate(parts, F.struct(*[head[n].alias(n) for n in names], *none), part_step)


def _chunk_heads(chunks: DataFrame, key: Sequence[str], fee: float) -> DataFrame:
    """The state (``_h``, ``_c``, ``_f``) each chunk starts from; ``chunks`` are all those of their keys, staged."""
    def moved(acc: Column, r: Column) -> Column:
        q = _move(r["row"])
        return _let(acc["s"] + F.coalesce(q, F.lit(0.0)), lambda s: F.struct(s.alias("s"), F.least(acc["m"], s).alias("m"), (acc["n"] + q.isNotNull().cast("int")).alias("n")))

    zero = F.struct(F.lit(0.0).alias("s"), F.lit(None).cast("double").alias("m"), F.lit(0).alias("n"))
    ends = chunks.select(*key, BLK, F.aggregate("_rows", zero, moved).alias("_e"))
    earlier = span(key).orderBy(BLK).rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.withColumns({"_sum": F.coalesce(F.sum("_e.s").over(earlier), F.lit(0.0)), "_known": F.sum("_e.n").over(earlier)})
    low = F.least(F.lit(0.0), F.min(F.col("_sum") + F.col("_e.m")).over(earlier))
    held = ends.select(*key, BLK, F.when(F.col("_known") > 0, F.col("_sum") - low).alias("_h"))
    head = F.struct(F.col("_h").alias("h"), F.lit(1.0).alias("p"), F.lit(0.0).alias("c"), F.lit(0.0).alias("f"))
    maps = chunks.join(held, [*key, BLK]).select(*key, (F.col(BLK) + 1).alias("rn"), "_h", _fold_fills(F.col("_rows"), head, fee).alias("_e"))
    y = running_affine(maps.select(*key, "rn", "_h", F.col("_e.p").alias("p"), F.col("_e.c").alias("c"), F.col("_e.f").alias("f")), key, "p", ["c", "f"])
    return stage(y.select(*key, (F.col("rn") - 1).alias(BLK), "_h", F.col("c_before").alias("_c"), F.col("f_before").alias("_f")))


def wacb_ledger(fills: DataFrame, key: Sequence[str], fee: float = 0.0, size: int = BLOCK) -> DataFrame:
    """Weighted-average-cost ledger of a numbered fills table (``rn, ts, side, price, qty``).

    Sells are capped at what is held; each sell realises profit against the running average.  The fills of
    a key travel once, into chunks of ``size`` rows, and are folded there.  A key of one chunk is done with
    that.  Of longer keys each chunk is summed up first: holdings are a running sum floored at zero (a prefix
    minimum), book cost and unspent entry fees then follow ``y = a*y + b`` with ``a`` = share of the holding
    kept, so the state at the head of every chunk comes from those summaries.
    """
    key = list(key)
    d = fills.withColumn(BLK, block_of(F.col("rn"), size))
    for c in [*key, "rn"]:
        d = d.filter(F.col(c).isNotNull())
    row = F.struct(F.col("rn").alias("at"), F.struct(*[c for c in fills.columns if c not in key]).alias("row"))
    chunks = stage(d.repartition(*key, BLK).groupBy(*key, BLK).agg(F.sort_array(F.collect_list(row)).alias("_rows")))
    whole = (F.col(BLK) == 0) & (F.size("_rows") < size)
    zero = {"_h": F.lit(None).cast("double"), "_c": F.lit(0.0), "_f": F.lit(0.0)}
    ready, rest = chunks.filter(whole).withColumns(zero), chunks.filter(~whole)
    if not rest.isEmpty():
        ready = ready.unionByName(rest.join(_chunk_heads(rest, key, fee), [*key, BLK]))
    head = F.struct(F.col("_h").alias("h"), F.lit(1.0).alias("p"), F.col("_c").alias("c"), F.col("_f").alias("f"))
    met = F.flatten(_fold_fills(F.col("_rows"), head, fee, met=True)["met"])
    y = ready.select(*key, F.explode(F.arrays_zip(F.col("_rows").alias("r"), met.alias("m"))).alias("z"))
    y = y.select(*key, "z.r.row.*", F.col("z.m.h").alias("_h"), F.col("z.m.c").alias("_c"), F.col("z.m.f").alias("_f")).select(*fills.columns, "_h", "_c", "_f")
    buy = F.col("side") == "BUY"
    y = y.withColumns({"held_before": F.coalesce("_h", F.lit(0.0)), "held": _held(F.col("_h"), F.when(buy, F.col("qty")).otherwise(-F.col("qty")))})
    y = y.withColumn("sold", F.when(buy, 0.0).otherwise(F.least(F.col("qty"), F.col("held_before"))))
    share = F.col("sold") / F.nullif(F.col("held_before"), F.lit(0.0))
    avg_before = F.col("_c") / F.nullif(F.col("held_before"), F.lit(0.0))
    fees = F.col("price") * F.col("sold") * fee + F.col("_f") * share
    pnl = F.when(F.col("sold") > 0, (F.col("price") - avg_before) * F.col("sold") - fees)
    cost = F.col("_c") * _kept(F.col("_h"), F.col("held"), buy) + F.when(buy, F.col("price") * F.col("qty")).otherwise(0.0)
    return y.withColumns({"avg_cost": cost / F.when(F.col("held") > 1e-10, F.col("held")),
                          "entry_avg": F.when(F.col("sold") > 0, avg_before), "realised_pnl": pnl,
                          "pnl_pct": pnl / F.nullif(avg_before * F.col("sold"), F.lit(0.0)),
                          "trade_fees": F.when(F.col("sold") > 0, fees)}).drop("_h", "_c", "_f")


# ------------------------------------------------------------------ reports

def trade_log_summary(trades: DataFrame, key: Sequence[str]) -> DataFrame:
    return trades.groupBy(*key).agg(F.count(F.lit(1)).alias("trades"), F.count_if(F.col("pnl") > 0).alias("winners"),
                                    F.sum("pnl").alias("total_pnl"), F.max("pnl").alias("best"),
                                    F.min("pnl").alias("worst"))


def bar_timeline(bars: DataFrame, trades: DataFrame, key: Sequence[str]) -> DataFrame:
    """Bars with the trade that closed (preferred) or opened on them."""
    key = list(key)
    opened = trades.select(*key, F.col("entry_time").alias("ts"), F.col("trade_no").alias("_o"))
    closed = trades.select(*key, F.col("exit_time").alias("ts"), F.col("trade_no").alias("_c"),
                           F.col("pnl").alias("closed_pnl"))
    closed = closed.groupBy(*key, "ts").agg(F.max("_c").alias("_c"), F.max_by("closed_pnl", "_c").alias("closed_pnl"))
    d = bars.join(opened, [*key, "ts"], "left").join(closed, [*key, "ts"], "left")
    return d.withColumns({"trade_no": F.coalesce("_c", "_o"),
                          "event": F.when(F.col("_c").isNotNull(), "closed").when(F.col("_o").isNotNull(), "opened")}
                         ).drop("_o", "_c")
