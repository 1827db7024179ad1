"""Sources, scalar functions, quality, exploration and usage reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalar as S
from ..functions import text as X
from ..operators import eda, positions, quality, usage
from ..operators.blocks import exact_percentiles
from ..operators.indicators import catalog, clamp
from ..sources import bars as B
from ..sources.tables import cost_legs, event_bars, event_ticks, fills, order_bars, raw_bars, raw_fills, table
from .oracle import Sql
from .registry import OVER, bars_cte, daily_cte, fin, query, r, rx, secs

# ------------------------------------------------------------------ sources

OHLCV = "open, high, low, close, volume"


@query("make_bars", f"WITH {bars_cte()} SELECT symbol, ts, {OHLCV} FROM bars")
def _(s, d):
    return raw_bars(s, d)


@query("make_bars_30m", f"WITH {bars_cte('30m')} SELECT symbol, ts, {OHLCV} FROM bars")
def _(s, d):
    return raw_bars(s, d, "30m")


@query("make_bars_daily_orders", f"WITH {daily_cte()} SELECT symbol, ts, {OHLCV} FROM bars")
def _(s, d):
    return order_bars(s, d).select("symbol", "ts", *B.OHLCV)


@query("number_bars", f"WITH {bars_cte()} SELECT symbol, ts, rn, n FROM bars")
def _(s, d):
    return event_bars(s, d).select("symbol", "ts", "rn", "n")


@query("canonical_bars", """SELECT symbol, ts, open, high, low, close, volume FROM (SELECT event_type AS symbol, make_timestamp(CAST(floor(epoch_us(ts) / 1000) AS BIGINT) * 1000) AS ts,
   value AS open, value + 1 AS high, value - 1 AS low, value AS close, CAST(user_id AS DOUBLE) AS volume, row_number() OVER (PARTITION BY event_type, floor(epoch_us(ts) / 1000) ORDER BY event_id) AS k FROM events) WHERE k = 1""")
def _(s, d):
    raw = event_ticks(s, d).select(F.col("event_type").alias("k"), F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000).alias("openTime"), F.col("value").alias("o"),
                                   (F.col("value") + 1).alias("h"), (F.col("value") - 1).alias("l"), F.col("value").alias("c"), F.col("user_id").alias("v"), "event_id")
    m = {"symbol": "k", "ts": "openTime", "open": "o", "high": "h", "low": "l", "close": "c", "volume": "v", "event_id": "event_id"}
    return B.canonical_bars(raw, {raw_name: out for out, raw_name in m.items()}).select("symbol", "ts", *B.OHLCV)


@query("scan_bars", f"WITH {bars_cte()} SELECT symbol, ts, {OHLCV} FROM bars WHERE symbol = 'click' AND ts >= TIMESTAMP '2024-01-05' AND ts <= TIMESTAMP '2024-01-20'")
def _(s, d):
    return B.scan_bars(raw_bars(s, d), "click", None, "2024-01-05", "2024-01-20")


@query("coverage", f"WITH {bars_cte()} SELECT symbol, min(ts) AS first_ts, max(ts) AS last_ts, (min(ts) <= TIMESTAMP '2023-12-30' + INTERVAL 5 DAY AND max(ts) >= TIMESTAMP '2024-02-03' - INTERVAL 5 DAY) AS covered FROM bars GROUP BY symbol")
def _(s, d):
    return B.coverage(raw_bars(s, d), "2023-12-30", "2024-02-03")


SRC = "CASE WHEN hour(ts) % 2 = 0 THEN 'binance' ELSE 'yfinance' END"


def sourced(s, d):
    return raw_bars(s, d).withColumn("source", F.when(F.hour("ts") % 2 == 0, "binance").otherwise("yfinance"))


@query("upsert_bars", f"""WITH {bars_cte()}, a AS (SELECT symbol, ts, {SRC} AS source, {OHLCV} FROM bars),
  nw AS (SELECT symbol, ts, source, open, high, low, close * 2 AS close, volume FROM a WHERE ts >= TIMESTAMP '2024-01-15'
         UNION ALL SELECT symbol, ts, 'bse' AS source, {OHLCV} FROM a WHERE day(ts) = 3)
  SELECT a.* FROM a WHERE NOT EXISTS (SELECT 1 FROM nw WHERE nw.symbol = a.symbol AND nw.ts = a.ts AND nw.source = a.source) UNION ALL SELECT * FROM nw""")
def _(s, d):
    a = sourced(s, d).select("symbol", "ts", "source", *B.OHLCV)
    new = a.filter("ts >= timestamp_ntz'2024-01-15'").withColumn("close", F.col("close") * 2)
    new = new.unionByName(a.filter("day(ts) = 3").withColumn("source", F.lit("bse")))
    return B.upsert_bars(a, new)


@query("backfill", f"""WITH {bars_cte()}, p AS (SELECT * FROM bars WHERE symbol <> 'view' OR ts >= TIMESTAMP '2024-01-10'),
   f AS (SELECT symbol, min(ts) AS m FROM p GROUP BY symbol)
   SELECT symbol, ts, close, false AS synthetic FROM p UNION ALL SELECT b.symbol, b.ts, b.close * 0.5, true FROM bars b JOIN f USING (symbol)
   WHERE f.m > TIMESTAMP '2024-01-01' + INTERVAL 7 DAY AND b.ts < f.m AND b.ts >= TIMESTAMP '2024-01-01'""")
def _(s, d):
    b = raw_bars(s, d).select("symbol", "ts", "close")
    p = b.filter("symbol <> 'view' or ts >= timestamp_ntz'2024-01-10'")
    return B.backfill(p, b.withColumn("close", F.col("close") * 0.5), "2024-01-01", 7)


@query("first_source", f"""WITH {bars_cte()}, a AS (SELECT *, CASE WHEN symbol < 'd' THEN 'bse' WHEN hour(ts) = 3 THEN 'nse' ELSE 'yfinance' END AS source FROM bars),
   c AS (SELECT symbol, source, count(*) AS k, CASE source WHEN 'nse' THEN 1 WHEN 'bse' THEN 2 ELSE 3 END AS pr FROM a GROUP BY symbol, source),
   best AS (SELECT symbol, first(source ORDER BY pr) AS source FROM c WHERE k >= 60 GROUP BY symbol)
   SELECT a.symbol, a.source, a.ts, a.close FROM a JOIN best USING (symbol, source)""")
def _(s, d):
    a = raw_bars(s, d).withColumn("source", F.when(F.col("symbol") < "d", "bse").when(F.hour("ts") == 3, "nse").otherwise("yfinance"))
    return B.first_source(a, ["nse", "bse", "yfinance"], 60).select("symbol", "source", "ts", "close")


@query("concat_chunks", f"WITH {bars_cte()} SELECT symbol, ts, CASE WHEN ts <= TIMESTAMP '2024-01-12' THEN close ELSE close + 1 END AS close FROM bars")
def _(s, d):
    b = raw_bars(s, d).select("symbol", "ts", "close")
    return B.concat_chunks(b.filter("ts <= timestamp_ntz'2024-01-12'"), b.filter("ts >= timestamp_ntz'2024-01-10'").withColumn("close", F.col("close") + 1))


@query("clean_bars", f"""WITH {bars_cte()}, h AS (SELECT symbol, ts, rn, open, CASE WHEN rn % 11 = 0 THEN low - 1 ELSE high END AS high, low, CASE WHEN rn % 7 = 0 THEN NULL ELSE close END AS close, volume FROM bars),
   k AS (SELECT symbol, ts, open, high, low, last_value(close IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts) AS close, volume FROM h WHERE high >= low)
   SELECT symbol, ts, {OHLCV} FROM k WHERE open IS NOT NULL AND high IS NOT NULL AND low IS NOT NULL AND close IS NOT NULL AND isodow(ts) <= 5""")
def _(s, d):
    b = event_bars(s, d).withColumns({"high": F.when(F.col("rn") % 11 == 0, F.col("low") - 1).otherwise(F.col("high")),
                                      "close": F.when(F.col("rn") % 7 == 0, None).otherwise(F.col("close"))})
    return B.clean_bars(b.drop("rn", "n")).select("symbol", "ts", *B.OHLCV)


@query("universe", f"""WITH {bars_cte()}, {bars_cte('4h', 'b4')}, u AS (SELECT symbol, '1h' AS "interval" FROM bars UNION ALL SELECT symbol, '4h' FROM b4)
   SELECT symbol, "interval", count(*) AS bars, CASE WHEN symbol < 'e' THEN 'crypto' ELSE 'stock' END AS class FROM u GROUP BY symbol, "interval" """)
def _(s, d):
    u = raw_bars(s, d).withColumn("interval", F.lit("1h")).unionByName(raw_bars(s, d, "4h").withColumn("interval", F.lit("4h")))
    dim = event_ticks(s, d).select(F.col("event_type").alias("symbol")).distinct().withColumn("class", F.when(F.col("symbol") < "e", "crypto").otherwise("stock"))
    return B.universe(dim, u)


@query("last_bars", f"WITH {bars_cte()} SELECT symbol, ts, rn, close FROM bars WHERE rn > n - 64")
def _(s, d):
    return B.last_rows(event_bars(s, d), ["symbol"], 64).select("symbol", "ts", "rn", "close")


# ------------------------------------------------------------------ scalar functions

def mag(c):
    return f"pow(10.0, floor(log10({c})) - 1)"


@query("round_nice", f"SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice, {rx('floor(l_extendedprice / ' + mag('l_extendedprice') + ') * ' + mag('l_extendedprice'), 'nice_floor')}, "
       f"{rx('ceil(l_extendedprice / ' + mag('l_extendedprice') + ') * ' + mag('l_extendedprice'), 'nice_ceil')} FROM lineitem")
def _(s, d):
    li = table(s, d, "lineitem")
    return fin(li, "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", S.round_nice("l_extendedprice").alias("nice_floor"), S.round_nice("l_extendedprice", "ceil").alias("nice_ceil"))


@query("sanitize_cap", """SELECT event_id, CASE WHEN value < 1 THEN 9999.0 WHEN value < 2 THEN -9999.0 WHEN value < 3 THEN 0.0 ELSE value END AS clean,
   CASE WHEN value < 1 THEN 20.0 WHEN value < 2 THEN -20.0 WHEN value < 3 THEN -20.0 ELSE least(greatest(value - 30, -20.0), 20.0) END AS capped FROM events""")
def _(s, d):
    from ..operators.sweep import cap
    v = F.col("value")
    x = lambda base: F.when(v < 1, float("inf")).when(v < 2, float("-inf")).when(v < 3, float("nan")).otherwise(base)
    return event_ticks(s, d).select("event_id", S.sanitize(x(v)).alias("clean"), cap(x(v - 30)).alias("capped"))


@query("clamp_params", """SELECT event_id, indicator, CASE name WHEN 'length' THEN name END AS name, CASE WHEN v IS NULL THEN dflt ELSE least(greatest(v, lo), hi) END AS clean FROM (
   SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'sma' WHEN 1 THEN 'rsi' ELSE 'cci' END AS indicator, CASE WHEN event_id % 7 = 0 THEN 'bogus' ELSE 'length' END AS name,
     CASE WHEN event_id % 5 = 0 THEN NULL ELSE value - 10 END AS v, CASE event_id % 3 WHEN 1 THEN 14.0 ELSE 20.0 END AS dflt, 2.0 AS lo,
     CASE event_id % 3 WHEN 0 THEN 400.0 WHEN 1 THEN 100.0 ELSE 200.0 END AS hi FROM events) WHERE name = 'length'""")
def _(s, d):
    e = event_ticks(s, d).select("event_id", F.when(F.col("event_id") % 3 == 0, "sma").when(F.col("event_id") % 3 == 1, "rsi").otherwise("cci").alias("indicator"),
                                 F.when(F.col("event_id") % 7 == 0, "bogus").otherwise("length").alias("name"),
                                 F.when(F.col("event_id") % 5 == 0, "abc").otherwise((F.col("value") - 10).cast("string")).alias("value"))
    return S.clamp_params(e, catalog(s)).select("event_id", "indicator", "name", "clean")


# symbols made from part names and brands, so that the work grows with the table
SYM = ("CASE p_partkey % 12 WHEN 0 THEN 'BTC/USDT' WHEN 1 THEN 'ethusdt' WHEN 2 THEN 'RELIANCE.NS' WHEN 3 THEN 'audcad' WHEN 4 THEN 'GBP/JPY' WHEN 5 THEN 'XAUUSD' WHEN 6 THEN '^NSEI' "
       "WHEN 7 THEN 'NIFTY 50' WHEN 8 THEN 'btcusd' WHEN 9 THEN 'TCS.BO' WHEN 10 THEN 'infy' ELSE replace(upper(p_brand), '#', '') END")
SPARK_SYM = SYM


def symbols(s, d):
    return table(s, d, "part").select("p_partkey", F.expr(SPARK_SYM).alias("symbol"))


FIATS = ", ".join(f"'{c}'" for c in S.FIAT)
BARE = "replace(replace(upper(trim(symbol)), '/', ''), '-', '')"
FOREX = f"(length({BARE}) = 6 AND substr({BARE}, 1, 3) IN ({FIATS}) AND substr({BARE}, 4, 3) IN ({FIATS}))"


def case_map(expr, table_, otherwise):
    return f"CASE {expr} " + " ".join(f"WHEN '{k}' THEN {v if isinstance(v, int) else repr(v)}" for k, v in table_.items()) + f" ELSE {otherwise} END"


SYMS = f"WITH q AS (SELECT p_partkey, {SYM} AS symbol FROM part) "


@query("norm_binance", SYMS + "SELECT p_partkey, upper(regexp_replace(symbol, '[/-]', '', 'g')) AS pair, upper(split_part(symbol, '/', 1)) AS base FROM q")
def _(s, d):
    return symbols(s, d).select("p_partkey", S.norm_binance("symbol").alias("pair"), S.base_currency("symbol").alias("base"))


@query("is_forex_pair", SYMS + f"SELECT p_partkey, symbol, {FOREX} AS is_forex FROM q")
def _(s, d):
    return symbols(s, d).select("p_partkey", "symbol", S.is_forex_pair("symbol").alias("is_forex"))


COMM = ", ".join(f"'{k}'" for k in S.COMMODITY)


@query("to_ticker", SYMS + f"""SELECT p_partkey, symbol, CASE WHEN symbol LIKE '%.NS' OR symbol LIKE '%.BO' OR symbol LIKE '^%' OR symbol LIKE '%=X' OR symbol LIKE '%=F' THEN symbol
   WHEN upper(symbol) IN ({COMM}) THEN {case_map('upper(symbol)', S.COMMODITY, 'NULL')} WHEN {FOREX} THEN {BARE} || '=X'
   WHEN contains(symbol, '/') THEN split_part(symbol, '/', 1) || '-' || CASE WHEN upper(split_part(symbol, '/', 2)) = 'USDT' THEN 'USD' ELSE split_part(symbol, '/', 2) END ELSE symbol END AS ticker FROM q""")
def _(s, d):
    return symbols(s, d).select("p_partkey", "symbol", S.to_ticker("symbol").alias("ticker"))


CLEAN = "replace(replace(upper(trim(symbol)), '.NS', ''), '.BO', '')"
IDX = ", ".join(f"'{k}'" for k in S.INDEX)
LOTK = ", ".join(f"'{k}'" for k in S.LOTS)


@query("indian_symbols", SYMS + f"""SELECT p_partkey, symbol, CASE WHEN upper(symbol) LIKE '%.NS' OR upper(symbol) LIKE '%.BO' OR symbol LIKE '^%' THEN upper(symbol)
   ELSE {case_map('upper(symbol)', S.INDEX, "upper(symbol) || CASE WHEN p_partkey % 2 = 0 THEN '.BO' ELSE '.NS' END")} END AS ticker, {CLEAN} AS cleaned,
   (upper(symbol) LIKE '%.NS' OR upper(symbol) LIKE '%.BO' OR {CLEAN} IN ({IDX}) OR {CLEAN} IN ({LOTK})) AS is_indian, {case_map(CLEAN, S.LOTS, 1)} AS lot FROM q""")
def _(s, d):
    ex = F.when(F.col("p_partkey") % 2 == 0, "BSE").otherwise("NSE")
    return symbols(s, d).select("p_partkey", "symbol", S.to_indian_ticker("symbol", ex).alias("ticker"), S.clean_symbol("symbol").alias("cleaned"),
                                S.is_indian("symbol").alias("is_indian"), S.lot_size("symbol").alias("lot"))


CAND = "CASE WHEN sym LIKE '%USD' AND sym NOT LIKE '%BUSD' THEN substr(sym, 1, length(sym) - 3) || 'USDT' ELSE sym END"


@query("norm_suggestion", SYMS + f""", k AS (SELECT p_partkey, upper(trim(symbol)) AS sym, CASE p_partkey % 5 WHEN 0 THEN 'Crypto ' WHEN 1 THEN 'Yahoo Finance' WHEN 2 THEN 'NSE (India)' WHEN 3 THEN 'oanda' ELSE 'BINANCE' END AS source,
    CASE p_partkey % 4 WHEN 0 THEN ' 1H' WHEN 1 THEN '3m' WHEN 2 THEN '1d' ELSE '15M' END AS iv FROM q),
   m AS (SELECT *, CASE lower(trim(source)) WHEN 'crypto' THEN 'binance' WHEN 'yahoo finance' THEN 'yfinance' WHEN 'nse (india)' THEN 'nse' WHEN 'binance' THEN 'binance' END AS src, {CAND} AS cand FROM k)
   SELECT p_partkey, CASE WHEN (src IS NULL OR src = 'binance') AND NOT contains(sym, '/') THEN
       CASE WHEN regexp_matches(cand, '^.+(USDT|USDC|BUSD|BTC|ETH)$') THEN regexp_replace(cand, '^(.+?)(USDT|USDC|BUSD|BTC|ETH)$', '\\1/\\2') ELSE sym END
     WHEN src IN ('nse', 'bse') THEN split_part(sym, '.', 1) ELSE sym END AS norm_symbol, src AS norm_source,
     CASE WHEN lower(trim(iv)) IN ('1m','5m','15m','30m','1h','4h','1d','1w') THEN lower(trim(iv)) END AS norm_interval FROM m""")
def _(s, d):
    k = symbols(s, d).withColumns({
        "source": F.expr("CASE p_partkey % 5 WHEN 0 THEN 'Crypto ' WHEN 1 THEN 'Yahoo Finance' WHEN 2 THEN 'NSE (India)' WHEN 3 THEN 'oanda' ELSE 'BINANCE' END"),
        "interval": F.expr("CASE p_partkey % 4 WHEN 0 THEN ' 1H' WHEN 1 THEN '3m' WHEN 2 THEN '1d' ELSE '15M' END")})
    return S.norm_suggestion(k).select("p_partkey", "norm_symbol", "norm_source", "norm_interval")


@query("resolve_source", SYMS + f"SELECT p_partkey, CASE WHEN {FOREX} THEN 'yfinance' WHEN p_partkey % 3 = 0 THEN 'binance' WHEN p_partkey % 3 = 1 THEN 'auto' ELSE 'nse' END AS src FROM q")
def _(s, d):
    return symbols(s, d).select("p_partkey", S.resolve_source("symbol", F.expr("CASE p_partkey % 3 WHEN 0 THEN 'BINANCE' WHEN 1 THEN 'forex' ELSE ' nse' END")).alias("src"))


@query("clamp_interval", """SELECT o_orderkey, iv, days, CASE WHEN iv IN ('1d') THEN iv WHEN iv = '1m' AND days <= 6 THEN iv WHEN iv = '15m' AND days <= 59 THEN iv WHEN iv = '1h' AND days <= 729 THEN iv
   WHEN iv = '1h' THEN '1d' WHEN days <= 729 THEN '1h' ELSE '1d' END AS clamped FROM (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN '1m' WHEN 1 THEN '15m' WHEN 2 THEN '1h' ELSE '1d' END AS iv, o_custkey AS days FROM orders)""")
def _(s, d):
    o = table(s, d, "orders").select("o_orderkey", F.expr("CASE o_orderkey % 4 WHEN 0 THEN '1m' WHEN 1 THEN '15m' WHEN 2 THEN '1h' ELSE '1d' END").alias("iv"), F.col("o_custkey").alias("days"))
    return o.withColumn("clamped", S.clamp_interval("iv", "days"))


@query("search_symbols", "SELECT p_name AS symbol, p_brand AS label, p_partkey FROM part WHERE contains(upper(p_name), 'RED') OR contains(upper(p_brand), 'RED') ORDER BY p_partkey LIMIT 20")
def _(s, d):
    p = table(s, d, "part").select(F.col("p_name").alias("sym_name"), F.col("p_brand").alias("label"), "p_partkey")
    return S.search_symbols(p.withColumn("symbol", F.col("p_partkey")).withColumn("label", F.concat_ws("|", "label", "sym_name")), "red").select(
        F.col("sym_name").alias("symbol"), F.split("label", "\\|")[0].alias("label"), "p_partkey")


@query("param_summary", """SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'lvl=' || (o_custkey % 10) || ' | spc=lin | inv=' || (o_custkey % 7)
   WHEN 1 THEN 'int=' || (o_custkey % 72) || 'h | inv=' || (o_custkey % 7) || ' | hold=30d | exit=time' ELSE 'f=9 | s=21 | exit=crossover | tp=' || (o_custkey % 5) || '%' END AS summary FROM orders""")
def _(s, d):
    t = lambda e: f"cast({e} as string)"
    p = f"""CASE o_orderkey % 3 WHEN 0 THEN map('num_levels', {t('o_custkey % 10')}, 'spacing', 'linear', 'invest', {t('o_custkey % 7')})
      WHEN 1 THEN map('buy_interval_hours', {t('o_custkey % 72')}, 'invest', {t('o_custkey % 7')}, 'hold_days', '30', 'exit_type', 'time')
      ELSE map('fast', '9', 'slow', '21', 'exit_type', 'crossover', 'take_profit_pct', {t('o_custkey % 5')}) END"""
    o = table(s, d, "orders").select("o_orderkey", F.expr(p).alias("p"), F.expr("CASE o_orderkey % 3 WHEN 0 THEN 'GRID' WHEN 1 THEN 'DCA' ELSE 'PLA' END").alias("s"))
    return o.select("o_orderkey", S.param_summary("s", "p").alias("summary"))


@query("calendar_parts", "SELECT o_orderkey, year(o_orderdate) AS year, month(o_orderdate) AS month, isodow(o_orderdate) - 1 AS weekday, hour(o_orderdate) AS hour, strftime(o_orderdate, '%b') AS month_name, strftime(o_orderdate, '%a') AS day_name FROM orders")
def _(s, d):
    o = table(s, d, "orders")
    return o.select("o_orderkey", *[c.alias(n) for n, c in S.calendar_parts("o_orderdate").items()])


@query("grid_levels", f"""WITH {bars_cte()}, b AS (SELECT symbol, min(close) AS lo, max(close) AS hi FROM bars GROUP BY symbol), k AS (SELECT unnest(range(0, 7)) AS i)
   SELECT symbol, CAST(i AS INTEGER) AS pos, {rx('lo + i * (hi - lo) / 6', 'linear')}, {rx('exp(ln(lo) + i * (ln(hi) - ln(lo)) / 6)', 'exponential')} FROM b, k""")
def _(s, d):
    from ..operators.signals import grid_levels
    b = raw_bars(s, d).groupBy("symbol").agg(F.min("close").alias("lo"), F.max("close").alias("hi"))
    z = F.arrays_zip(grid_levels(F.col("lo"), F.col("hi"), 7).alias("linear"), grid_levels(F.col("lo"), F.col("hi"), 7, "exponential").alias("exponential"))
    return fin(b.select("symbol", F.posexplode(z).alias("pos", "z")).select("symbol", "pos", F.col("z")["linear"].alias("linear"), F.col("z")["exponential"].alias("exponential")))


@query("cache_key", """SELECT o_orderkey, substr(sha256('{"params": {"fast": ' || (o_orderkey % 20) || ', "label": "caf\\u00e9 \\"' || o_orderpriority || '\\"", "ratio": ' || (o_custkey % 50) * 0.5::DOUBLE || '}, "strategy": "SMA_CROSS", "symbol": "' || upper(o_orderpriority) || '", "timeframe": "1d"}'), 1, 32) AS cache_key FROM orders""")
def _(s, d):
    o = table(s, d, "orders")
    p = {"ratio": F.col("o_custkey") % 50 * 0.5, "fast": F.col("o_orderkey") % 20, "label": F.concat(F.lit('café "'), "o_orderpriority", F.lit('"'))}
    return o.select("o_orderkey", S.cache_key(F.lit("sma_cross"), p, F.lower("o_orderpriority"), F.lit("1d")).alias("cache_key"))


COST = """WITH q AS (SELECT *, CASE WHEN l_linestatus = 'F' THEN 'futures' WHEN l_discount > 0.05 THEN 'equity_intraday' ELSE 'equity_delivery' END AS m, CASE WHEN l_returnflag = 'R' THEN 'SELL' ELSE 'BUY' END AS side, l_extendedprice AS t FROM lineitem),
 c AS (SELECT *, CASE WHEN m = 'equity_delivery' THEN least(20.0, t * 0.001) ELSE least(20.0, t * 0.025) END AS brokerage,
   t * CASE WHEN m = 'equity_delivery' THEN 0.001 WHEN side = 'SELL' AND m = 'equity_intraday' THEN 0.00025 WHEN side = 'SELL' AND m = 'futures' THEN 0.0002 ELSE 0.0 END AS stt,
   t * CASE WHEN m = 'futures' THEN 0.0000173 ELSE 0.0000297 END AS exchange_charges, t * 0.000001 AS sebi_charges, CASE WHEN side = 'BUY' THEN t * CASE WHEN m = 'equity_delivery' THEN 0.00015 ELSE 0.00003 END ELSE 0.0 END AS stamp_duty FROM q),
 e AS (SELECT *, (brokerage + exchange_charges + sebi_charges) * 0.18 AS gst FROM c), f AS (SELECT *, brokerage + stt + exchange_charges + sebi_charges + gst + stamp_duty AS total FROM e) """
PARTS = ["brokerage", "stt", "exchange_charges", "sebi_charges", "gst", "stamp_duty", "total"]


@query("indian_cost", COST + f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, side, m AS market_type, {r(*PARTS, digits=12)} FROM f")
def _(s, d):
    c = positions.indian_cost(cost_legs(s, d))
    return fin(c, "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "side", "market_type", *[F.col("cost")[p].alias(p) for p in PARTS], digits=12)


@query("cost_totals", COST + f"SELECT m AS market_type, side, count(*) AS legs, {', '.join(rx(f'sum({p})', p, 4) for p in PARTS)} FROM f GROUP BY m, side")
def _(s, d):
    return fin(positions.cost_totals(positions.indian_cost(cost_legs(s, d)), ["market_type", "side"]), digits=4)


BOTH = COST.replace("CASE WHEN l_returnflag = 'R' THEN 'SELL' ELSE 'BUY' END AS side", "unnest(['BUY', 'SELL']) AS side").replace("FROM lineitem)", "FROM (SELECT *, row_number() OVER () AS leg FROM lineitem))")


@query("effective_pct", BOTH + "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, m AS market_type, round(sum(total) / any_value(t) * 100, 3) + 0.0 AS effective_pct FROM f GROUP BY leg, l_orderkey, l_linenumber, l_partkey, l_suppkey, m")
def _(s, d):
    legs = cost_legs(s, d).drop("side")
    return fin(positions.effective_pct(legs), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "market_type", "effective_pct")


@query("simple_fee_slip", """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(l_extendedprice * 0.00123457, 4) AS fee, round(l_extendedprice * CASE WHEN l_returnflag = 'R' THEN 1 - 1.0 / 7000 ELSE 1 + 1.0 / 7000 END, 6) AS slipped,
   floor(l_quantity / 15) * 15.0 AS lots, round(CASE WHEN l_discount > 0.02 THEN 1000.0 / l_extendedprice ELSE 0.01 END, 9) AS qty, greatest(100.0, least(l_extendedprice * 0.1, 2000.0)) AS default_size FROM lineitem""")
def _(s, d):
    from ..operators.signals import order_qty
    li = table(s, d, "lineitem")
    px = F.col("l_extendedprice")
    side = F.when(F.col("l_returnflag") == "R", "SELL").otherwise("BUY")
    return li.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", positions.simple_fee(px, 0.00123457).alias("fee"), F.round(positions.slip(px, side, 1 / 7000), 6).alias("slipped"),
                     (positions.lot_floor(F.col("l_quantity"), 15) * F.lit(1.0)).alias("lots"), F.round(order_qty(px, F.when(F.col("l_discount") > 0.02, 1000.0).otherwise(0.0), 0.01), 9).alias("qty"),
                     S.order_default("l_extendedprice").alias("default_size"))


@query("min_invest", f"""WITH {bars_cte()}, m AS (SELECT symbol, ceil(50 * median(close) * 1.05 / 1000) * 1000 AS lo FROM bars GROUP BY symbol), k AS (SELECT unnest([1.0, 1.5, 2.0]::DOUBLE[]) AS multiple)
   SELECT symbol, multiple, round_even(lo * multiple / 1000, 0) * 1000 AS invest FROM m, k""")
def _(s, d):
    return S.min_invest(raw_bars(s, d), ["symbol"], 50)


def nice(e, fn):
    return f"{fn}(({e}) / {mag(e)}) * {mag(e)}"


@query("grid_bounds", f"""WITH {bars_cte()}, a AS (SELECT symbol, count(*) AS candles, min(close) AS lo, max(close) AS hi, last(close ORDER BY ts) AS cur, first(close ORDER BY ts) AS op FROM bars GROUP BY symbol),
   b AS (SELECT *, {nice('greatest(0.0, lo - (hi - lo) * 0.10)', 'floor')} AS x, {nice('hi + (hi - lo) * 0.10', 'ceil')} AS y FROM a)
   SELECT symbol, candles, round(cur, 8) AS current_price, round(lo, 8) AS period_low, round(hi, 8) AS period_high, round((cur / op - 1) * 100, 2) AS price_change_pct, round(x, 6) AS suggested_lower, round(y, 6) AS suggested_upper,
   CAST(greatest(3, least(20, round_even((y - x) / cur * 100 / 2, 0))) AS INTEGER) AS suggested_levels FROM b""")
def _(s, d):
    return S.grid_bounds(raw_bars(s, d), ["symbol"])


# every other symbol asks for bounds that are unset, inverted or off the data
@query("grid_auto_bounds", f"""WITH {bars_cte()}, a AS (SELECT symbol, min(close) AS lo, max(close) AS hi, CASE ascii(symbol) % 4 WHEN 0 THEN 0 WHEN 1 THEN 240 WHEN 2 THEN 105 ELSE 1e6 END AS l, CASE ascii(symbol) % 4 WHEN 0 THEN 0 WHEN 1 THEN 105 WHEN 2 THEN 240 ELSE 2e6 END AS u FROM bars GROUP BY symbol),
   b AS (SELECT *, l >= u OR l > hi OR u < lo AS auto, {nice('greatest(lo * 0.5, lo - (hi - lo) * 0.10)', 'floor')} AS x, {nice('hi + (hi - lo) * 0.10', 'ceil')} AS y FROM a)
   SELECT symbol, auto AS auto_set, {rx('CASE WHEN auto THEN x ELSE l END', 'lower_bound')}, {rx('CASE WHEN auto THEN y ELSE u END', 'upper_bound')} FROM b""")
def _(s, d):
    bars = raw_bars(s, d)
    kind = F.ascii("symbol") % 4
    asked = bars.select("symbol").distinct().select("symbol", F.when(kind == 0, 0.0).when(kind == 1, 240.0).when(kind == 2, 105.0).otherwise(1e6).alias("lower_bound"), F.when(kind == 0, 0.0).when(kind == 1, 105.0).when(kind == 2, 240.0).otherwise(2e6).alias("upper_bound"))
    return fin(S.ensure_grid_bounds(bars, asked, ["symbol"]), "symbol", "auto_set", "lower_bound", "upper_bound")


@query("json_props", "SELECT event_id, CAST(json_extract(props, '$.k') AS DOUBLE) AS k FROM events")
def _(s, d):
    return event_ticks(s, d).select("event_id", F.get_json_object("props", "$.k").cast("double").alias("k"))


@query("clean_text", """SELECT doc_id, t AS cleaned, length(t) AS length, length(t) > 12000 AS over_limit FROM (SELECT doc_id, regexp_replace(text, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f]', '', 'g') AS t FROM documents)""")
def _(s, d):
    return table(s, d, "documents").select("doc_id", X.clean_text("text").alias("cleaned")).select("doc_id", "cleaned", F.length("cleaned").cast("long").alias("length"), X.over_limit("cleaned").alias("over_limit"))


def rep_sql(n):
    """First position (1-based) at which a word differs from the word n places before it."""
    run = f"coalesce(list_min([i FOR i IN range({n} + 1, len(w) + 1) IF w[i] <> w[i - {n}]]), len(w) + 1) - 1"
    return f"(len(w) >= {4 * n} AND floor(({run}) / {n}) >= 4 AND floor(({run}) / {n}) * {n} / len(w) >= 0.6)"


# every third text is repeated whole, the others stay as they are
@query("repetition_loop", f"""WITH q AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN repeat(text || ' ', 5) ELSE text END AS t FROM documents),
   k AS (SELECT doc_id, list_filter(regexp_split_to_array(t, '\\s+'), lambda x: x <> '') AS w FROM q)
   SELECT doc_id, CASE WHEN len(w) < 8 THEN false ELSE {' OR '.join(rep_sql(n) for n in range(1, 7))} END AS looping FROM k""")
def _(s, d):
    t = F.when(F.col("doc_id") % 3 == 0, F.repeat(F.concat("text", F.lit(" ")), 5)).otherwise(F.col("text"))
    return table(s, d, "documents").select("doc_id", X.words(t).alias("w")).select("doc_id", X.is_repetition_loop(F.col("w")).alias("looping"))


@query("asset_list", """WITH q AS (SELECT DISTINCT event_type AS symbol, event_type || ' fund' AS label FROM events UNION ALL SELECT 'TCS', 'Tata ETF' UNION ALL SELECT 'INFY', 'Infosys')
   SELECT symbol, label, CASE symbol WHEN 'TCS' THEN 150 WHEN 'INFY' THEN 300 ELSE 1 END AS lot_size, contains(upper(label), 'ETF') AS is_etf FROM q""")
def _(s, d):
    dim = event_ticks(s, d).select(F.col("event_type").alias("symbol")).distinct().withColumn("label", F.concat("symbol", F.lit(" fund")))
    dim = dim.unionByName(s.createDataFrame([("TCS", "Tata ETF"), ("INFY", "Infosys")], "symbol string, label string"))
    return S.asset_list(dim, S.lots_dim(s))


RET = f"WITH {bars_cte()}, x AS (SELECT symbol, ts, rn, close, volume, close / lag(close) OVER ({OVER}) - 1 AS ret, ln(close / lag(close) OVER ({OVER})) AS lr FROM bars)"


@query("histogram_equal", RET + f""", g AS (SELECT symbol, min(ret) AS lo, max(ret) AS hi FROM x GROUP BY symbol), k AS (SELECT unnest(range(0, 20)) AS i),
   c AS (SELECT symbol, least(floor((ret - lo) / ((hi - lo) / 20)), 19) AS b, count(*) AS c FROM x JOIN g USING (symbol) WHERE ret IS NOT NULL GROUP BY 1, 2)
   SELECT g.symbol, CAST(k.i AS INTEGER) AS bin, {rx('lo + (k.i + 0.5) * ((hi - lo) / 20)', 'mid')}, coalesce(c.c, 0) AS count FROM g CROSS JOIN k LEFT JOIN c ON c.symbol = g.symbol AND c.b = k.i""")
def _(s, d):
    return fin(eda.histogram(eda.returns(event_bars(s, d), ["symbol"]), ["symbol"], "ret", 20))


@query("histogram_width", f"""WITH c AS (SELECT event_type AS symbol, floor(value / 5) * 5 AS bucket, count(*) AS c FROM events GROUP BY 1, 2), g AS (SELECT symbol, min(bucket) AS lo, max(bucket) AS hi FROM c GROUP BY 1),
   e AS (SELECT symbol, unnest(range(CAST(lo / 5 AS BIGINT), CAST(hi / 5 AS BIGINT) + 1)) * 5.0 AS bucket FROM g) SELECT e.symbol, e.bucket, coalesce(c.c, 0) AS count FROM e LEFT JOIN c ON c.symbol = e.symbol AND c.bucket = e.bucket""")
def _(s, d):
    return eda.histogram_width(event_ticks(s, d).withColumn("symbol", F.col("event_type")), ["symbol"], "value", 5.0)


EDGES = [-50, -20, -5, 0, 5, 20]


@query("histogram_edges", "SELECT event_type, CASE WHEN v >= 20 THEN 6 WHEN v >= 5 THEN 5 WHEN v >= 0 THEN 4 WHEN v >= -5 THEN 3 WHEN v >= -20 THEN 2 WHEN v >= -50 THEN 1 ELSE 0 END AS bucket, count(*) AS count FROM (SELECT event_type, value - 30 AS v FROM events) GROUP BY 1, 2")
def _(s, d):
    return eda.histogram_edges(event_ticks(s, d).withColumn("v", F.col("value") - 30), ["event_type"], "v", EDGES)


# ------------------------------------------------------------------ quality

DIRTY = f"""{bars_cte()}, z AS (SELECT symbol, ts, rn, CASE WHEN rn % 97 = 0 THEN -1.0 ELSE open END AS open, CASE WHEN rn % 89 = 0 THEN low - 5 ELSE high END AS high, low,
   CASE WHEN rn % 101 = 0 THEN NULL WHEN rn % 103 = 0 THEN 'Infinity'::DOUBLE ELSE close END AS close, CASE WHEN rn % 53 = 0 THEN -volume ELSE volume END AS volume FROM bars)"""


def dirty(s, d):
    m = lambda k: F.col("rn") % k == 0
    return event_bars(s, d).withColumns({"open": F.when(m(97), -1.0).otherwise(F.col("open")), "high": F.when(m(89), F.col("low") - 5).otherwise(F.col("high")),
                                         "close": F.when(m(101), None).when(m(103), float("inf")).otherwise(F.col("close")), "volume": F.when(m(53), -F.col("volume")).otherwise(F.col("volume"))})


@query("quality_ranges", f"""WITH {DIRTY} SELECT symbol, count(*) AS rows, count(*) FILTER (open <= 0) AS nonpos_open, count(*) FILTER (volume < 0) AS neg_volume, count(*) FILTER (high < low) AS high_below_low,
   count(*) FILTER (high < open OR high < close) AS high_below_body, count(*) FILTER (low > open OR low > close) AS low_above_body, count(*) FILTER (close IS NULL) AS null_close, count(*) FILTER (close = 'Infinity'::DOUBLE) AS inf_close FROM z GROUP BY symbol""")
def _(s, d):
    return quality.checks(dirty(s, d), ["symbol"]).select("symbol", "rows", "nonpos_open", "neg_volume", "high_below_low", "high_below_body", "low_above_body", "null_close", "inf_close")


CLEANQ = f"""WITH {bars_cte()}, x AS (SELECT *, {secs('ts')} - lag({secs('ts')}) OVER ({OVER}) AS gap, (close - lag(close) OVER ({OVER})) / lag(close) OVER ({OVER}) AS ret FROM bars),
   m AS (SELECT symbol, median(gap) AS mg, avg(ret) AS mr, stddev_samp(ret) AS sr, count(*) AS rows, count(*) - count(DISTINCT ts) AS dups FROM x GROUP BY symbol),
   k AS (SELECT symbol, count(*) FILTER (gap > mg * 3) AS gaps, count(*) FILTER (abs((ret - mr) / sr) > 3) AS outliers, count(*) FILTER (high < open OR high < close) AS hb, any_value(rows) AS rows, any_value(dups) AS dups,
     avg(close) AS cm, min(close) AS c0, max(close) AS c1, sum(volume) AS vt FROM x JOIN m USING (symbol) GROUP BY symbol)"""


@query("quality_gaps_outliers", CLEANQ + "SELECT symbol, rows, dups AS dup_ts, gaps, outliers FROM k")
def _(s, d):
    return quality.checks(event_bars(s, d), ["symbol"], z=3.0).select("symbol", "rows", "dup_ts", "gaps", "outliers")


@query("quality_report", CLEANQ + f"""SELECT symbol, rows, {rx('greatest(0.0, 100 - CASE WHEN gaps > 0 THEN least(20.0, gaps / rows * 200.0) ELSE 0 END - CASE WHEN outliers > 0 THEN least(10.0, outliers * 2.0) ELSE 0 END)', 'score')}, true AS passed,
   CASE WHEN gaps > 0 THEN gaps || ' gaps' ELSE '' END || CASE WHEN gaps > 0 AND outliers > 0 THEN '; ' ELSE '' END || CASE WHEN outliers > 0 THEN outliers || ' extreme returns' ELSE '' END AS warnings, {rx('cm', 'close_mean')}, {rx('c0', 'close_min')}, {rx('c1', 'close_max')}, vt AS volume_total FROM k""")
def _(s, d):
    q = quality.quality_report(event_bars(s, d), ["symbol"], z=3.0)
    return fin(q, "symbol", "rows", "score", "passed", F.array_join("warnings", "; ").alias("warnings"), "close_mean", "close_min", "close_max", "volume_total")


# volume is missing, close is text that is not always a number
SHAPED = CLEANQ.replace("FROM bars)", "FROM (SELECT * REPLACE (CASE WHEN rn % 31 = 0 THEN NULL ELSE close END AS close) FROM bars))", 1).replace("sum(volume) AS vt", "count(*) FILTER (close IS NULL) AS nc")


@query("quality_shape", SHAPED + f"""SELECT symbol, rows, {rx('greatest(0.0, 60 - CASE WHEN nc > 0 THEN 5 ELSE 0 END - CASE WHEN hb > 0 THEN 3 ELSE 0 END - CASE WHEN gaps > 0 THEN least(20.0, gaps / rows * 200.0) ELSE 0 END - CASE WHEN outliers > 0 THEN least(10.0, outliers * 2.0) ELSE 0 END)', 'score')},
   'missing columns: volume; column close is not numeric' || CASE WHEN nc > 0 THEN '; ' || nc || ' null close' ELSE '' END AS issues, gaps, outliers FROM k""")
def _(s, d):
    b = event_bars(s, d).drop("volume").withColumn("close", F.when(F.col("rn") % 31 == 0, "n/a").otherwise(F.col("close").cast("string")))
    return fin(quality.quality_report(b, ["symbol"], z=3.0), "symbol", "rows", "score", F.array_join("issues", "; ").alias("issues"), "gaps", "outliers")


# ------------------------------------------------------------------ exploration

@query("eda_stats", RET + """SELECT symbol, count(*) AS candles, min(ts) AS first_ts, max(ts) AS last_ts, CAST(floor((epoch_us(max(ts)) - epoch_us(min(ts))) / 86400e6) AS BIGINT) AS days, round(avg(close), 4) AS close_mean, round(median(close), 4) AS close_median,
   round(stddev_samp(close), 4) AS close_std, round(min(close), 4) AS close_min, round(max(close), 4) AS close_max, round(quantile_cont(close, 0.25), 4) AS close_q25, round(quantile_cont(close, 0.75), 4) AS close_q75,
   round(sum(volume), 2) AS volume_total, round(avg(volume), 2) AS volume_mean, round(max(volume), 2) AS volume_max, round(avg(ret) * 100, 4) AS ret_mean_pct, round(stddev_samp(ret) * 100, 4) AS ret_std_pct,
   round((last(close ORDER BY rn) / first(close ORDER BY rn) - 1) * 100, 2) AS ret_total_pct FROM x GROUP BY symbol""")
def _(s, d):
    return eda.eda_stats(event_bars(s, d), ["symbol"])


@query("exact_percentiles", "SELECT l_returnflag, l_linestatus, round(quantile_cont(l_extendedprice, 0.05), 6) AS p5, round(quantile_cont(l_extendedprice, 0.5), 6) AS p50, round(quantile_cont(l_extendedprice, 0.95), 6) AS p95 FROM lineitem GROUP BY 1, 2")
def _(s, d):
    return fin(exact_percentiles(table(s, d, "lineitem"), ["l_returnflag", "l_linestatus"], "l_extendedprice", {"p5": 0.05, "p50": 0.5, "p95": 0.95}))


@query("eda_distribution", RET + """, m AS (SELECT symbol, avg(ret) AS mu, CAST(count(ret) AS DOUBLE) AS n FROM x GROUP BY symbol), q AS (SELECT symbol, any_value(n) AS n, avg(pow(ret - mu, 2)) AS m2, avg(pow(ret - mu, 3)) AS m3, avg(pow(ret - mu, 4)) AS m4, stddev_samp(lr) AS ls,
     avg(CASE WHEN ret > 0 THEN 1.0 ELSE 0.0 END) AS up FROM x JOIN m USING (symbol) WHERE ret IS NOT NULL GROUP BY symbol),
   g AS (SELECT *, m3 / pow(m2, 1.5) AS g1, m4 / (m2 * m2) AS b2 FROM q),
   z AS (SELECT *, g1 * sqrt((n+1)*(n+3)/(6*(n-2))) AS y, 3*(n*n+27*n-70)*(n+1)*(n+3)/((n-2)*(n+5)*(n+7)*(n+9)) AS beta, (b2-3*(n-1)/(n+1))/sqrt(24*n*(n-2)*(n-3)/((n+1)*(n+1)*(n+3)*(n+5))) AS xx, 6*(n*n-5*n+2)/((n+7)*(n+9))*sqrt(6*(n+3)*(n+5)/(n*(n-2)*(n-3))) AS sb FROM g),
   zz AS (SELECT *, sqrt(2*(beta-1))-1 AS w2, 6+8/sb*(2/sb+sqrt(1+4/(sb*sb))) AS a FROM z),
   p AS (SELECT *, asinh(y/sqrt(2/(w2-1)))/sqrt(0.5*ln(w2)) AS zs, 1+xx*sqrt(2/(a-4)) AS qd FROM zz),
   e AS (SELECT *, (1-2/(9*a)-sign(qd)*pow((1-2/a)/abs(qd), 1.0/3))/sqrt(2/(9*a)) AS zk FROM p)
   SELECT symbol, round(g1, 4) AS skewness, round(b2 - 3, 4) AS kurtosis, round(exp(-(zs*zs+zk*zk)/2), 6) AS normality_p_value, exp(-(zs*zs+zk*zk)/2) > 0.05 AS is_normal, round(ls, 6) AS log_return_std, round(up * 100, 2) AS positive_pct FROM e""")
def _(s, d):
    return eda.eda_distribution(event_bars(s, d), ["symbol"])


DRET = f"WITH {daily_cte()}, x AS (SELECT *, close / lag(close) OVER ({OVER}) - 1 AS ret FROM bars)"


def season(part, expr, fmt):
    return DRET + f""", a AS (SELECT symbol, {expr} AS {part}, strftime(min(ts), '{fmt}') AS name, round(avg(ret), 6) AS avg_return, round(stddev_samp(ret), 6) AS volatility, count(ret) AS candles FROM x GROUP BY 1, 2)
    SELECT *, avg_return = max(avg_return) OVER (PARTITION BY symbol) AS best, avg_return = min(avg_return) OVER (PARTITION BY symbol) AS worst FROM a"""


@query("eda_seasonality_month", season("month", "month(ts)", "%b"))
def _(s, d):
    return eda.eda_seasonality(order_bars(s, d), ["symbol"], "month")


@query("eda_seasonality_weekday", season("weekday", "isodow(ts) - 1", "%a"))
def _(s, d):
    return eda.eda_seasonality(order_bars(s, d), ["symbol"], "weekday")


CORR = [(a, b) for i, a in enumerate(B.OHLCV) for b in B.OHLCV[i:]]


def _trend_sql() -> str:
    q = Sql()
    macd, _ = q.indicator("macd", clamp("macd", {}))
    mas = ", ".join(f"CASE WHEN rn >= {n} THEN avg(close) OVER (PARTITION BY symbol ORDER BY rn ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) END AS ma_{n}" for n in (20, 50, 200))
    return f"""WITH RECURSIVE {bars_cte()}, {', '.join(q.ctes)}, g AS (SELECT symbol, rn, close - lag(close) OVER ({OVER}) AS dl FROM bars), a AS (SELECT *, {mas} FROM bars),
   u AS (SELECT symbol, rn, avg(greatest(dl, 0)) OVER w AS up, avg(greatest(-dl, 0)) OVER w AS dn FROM g WINDOW w AS (PARTITION BY symbol ORDER BY rn ROWS BETWEEN 13 PRECEDING AND CURRENT ROW)),
   x AS (SELECT symbol, max(high) AS ath, min(low) AS atl FROM bars GROUP BY symbol)
   SELECT a.symbol, round(close, 4) AS last_close, round(ma_20, 4) AS ma_20, round(ma_50, 4) AS ma_50, round(ma_200, 4) AS ma_200, round(100 - 100 / (1 + up / nullif(dn, 0)), 2) AS rsi_14,
     round(macd, 4) AS macd, round(macd_signal, 4) AS macd_signal, round(ath, 4) AS ath, round(atl, 4) AS atl, round((close - ath) / ath * 100, 2) AS pct_from_ath
   FROM a JOIN u USING (symbol, rn) JOIN {macd} m USING (symbol, rn) JOIN x USING (symbol) WHERE rn = n"""


@query("eda_trend", _trend_sql())
def _(s, d):
    return eda.eda_trend(event_bars(s, d), ["symbol"])


@query("eda_corr", f"WITH {daily_cte()} " + " UNION ALL ".join(f"SELECT symbol, '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 4) AS corr FROM bars GROUP BY symbol" for a, b in CORR))
def _(s, d):
    return eda.eda_corr(order_bars(s, d), ["symbol"])


@query("eda_volatility", RET + f""", v AS (SELECT *, CASE WHEN count(ret) OVER w = 30 THEN stddev_samp(ret) OVER w END * sqrt(252) AS v FROM x WINDOW w AS ({OVER} ROWS BETWEEN 29 PRECEDING AND CURRENT ROW))
   SELECT symbol, round(stddev_samp(ret) * 100, 4) AS daily_vol_pct, round(stddev_samp(ret) * sqrt(252) * 100, 2) AS annual_vol_pct, round(max(v) * 100, 2) AS max_roll30_pct, round(min(v) * 100, 2) AS min_roll30_pct,
   round(last(v ORDER BY rn) * 100, 2) AS cur_roll30_pct FROM v GROUP BY symbol""")
def _(s, d):
    return eda.eda_volatility(event_bars(s, d), ["symbol"])


# ------------------------------------------------------------------ usage events

@query("usage_totals", "SELECT count(*) AS events, count(DISTINCT user_id) AS sessions, count(DISTINCT CASE WHEN user_id % 3 > 0 THEN user_id END) AS users FROM events")
def _(s, d):
    e = event_ticks(s, d).select(F.col("user_id").alias("session_id"), F.when(F.col("user_id") % 3 > 0, F.col("user_id")).alias("user_name"))
    return usage.usage_totals(e)


@query("top_events", "SELECT event_type || '-' || (user_id % 10) AS event_name, count(*) AS count FROM events GROUP BY 1 ORDER BY count DESC, event_name LIMIT 20")
def _(s, d):
    return usage.top_events(event_ticks(s, d).select(F.concat("event_type", F.lit("-"), (F.col("user_id") % 10).cast("string")).alias("event_name")))


@query("user_activity", "SELECT user_id AS user_name, count(*) AS events, max(ts) AS last_seen FROM events GROUP BY 1 ORDER BY last_seen DESC")
def _(s, d):
    return usage.user_activity(event_ticks(s, d).select(F.col("user_id").alias("user_name"), F.col("ts").alias("created_at")))


@query("feedback_counts", "SELECT CASE WHEN value > 50 THEN 'bug' WHEN value > 20 THEN 'idea' ELSE 'other' END AS category, count(*) AS count FROM events GROUP BY 1")
def _(s, d):
    return usage.feedback_counts(event_ticks(s, d).select(F.when(F.col("value") > 50, "bug").when(F.col("value") > 20, "idea").otherwise("other").alias("category")))


@query("events_page", "SELECT event_id, ts, event_type FROM events WHERE event_type = 'click' ORDER BY ts DESC LIMIT 50 OFFSET 100")
def _(s, d):
    return usage.events_page(event_ticks(s, d).select("event_id", "ts", "event_type"), F.col("event_type") == "click", 50, 100, [F.desc("ts")])


@query("api_latency", f"SELECT event_type, count(k) AS calls, {rx('avg(k)', 'avg_value')}, min(k) AS min_value, max(k) AS max_value, {rx('quantile_cont(k, 0.5)', 'p50')}, {rx('quantile_cont(k, 0.95)', 'p95')} FROM (SELECT event_type, CAST(json_extract(props, '$.k') AS DOUBLE) AS k FROM events) GROUP BY 1")
def _(s, d):
    return fin(usage.api_latency(event_ticks(s, d), ["event_type"]))
