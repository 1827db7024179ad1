"""Scalar functions: numbers, symbols, intervals, keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


# ------------------------------------------------------------------ numbers

def round_nice(c: Column | str, direction: str = "floor") -> Column:
    """Two significant digits, down or up; not positive -> 0."""
    c = _c(c)
    mag = F.pow(F.lit(10.0), F.floor(F.log10(F.when(c > 0, c))) - 1)
    fn = F.floor if direction == "floor" else F.ceil
    return F.when(c <= 0, 0.0).otherwise(fn(c / mag) * mag)


def sanitize(c: Column | str, bound: float = 9999.0) -> Column:
    c = _c(c)
    inf = float("inf")
    return (F.when(c.isNull() | F.isnan(c), 0.0).when(c == inf, bound).when(c == -inf, -bound).otherwise(c))


def order_default(capital: Column | str) -> Column:
    """A tenth of the capital, at least 100 and at most 2000."""
    return F.greatest(F.lit(100.0), F.least(_c(capital) * 0.1, F.lit(2000.0)))


def clamp_params(df: DataFrame, catalog: DataFrame) -> DataFrame:
    """Long parameter rows (``indicator, name, value`` text) forced into the catalog's ranges.

    Unknown names are dropped, unreadable values take the default.  The catalog is the fixed
    small side.
    """
    spec = catalog.select(F.col("key").alias("indicator"), F.explode("params").alias("_p")).select("indicator", F.col("_p.name").alias("name"), "_p.default", "_p.lo", "_p.hi")
    v = F.expr("try_cast(value as double)")
    return (df.join(F.broadcast(spec), ["indicator", "name"])
            .withColumn("clean", F.when(v.isNull(), F.col("default")).otherwise(F.least(F.greatest(v, F.col("lo")), F.col("hi"))))
            .drop("default", "lo", "hi"))


def min_invest(df: DataFrame, key: Sequence[str], lot: int) -> DataFrame:
    """Smallest round amount that buys one lot at the median close, and 1.5x / 2x of it."""
    from ..operators.blocks import exact_percentiles
    m = exact_percentiles(df, key, "close", {"_m": 0.5})
    d = m.select(*key, (F.ceil(F.lit(lot) * F.col("_m") * 1.05 / 1000) * 1000).cast("double").alias("_min"))
    d = d.withColumn("_x", F.explode(F.array(F.lit(1.0), F.lit(1.5), F.lit(2.0))))
    return d.select(*key, F.col("_x").alias("multiple"), (F.rint(F.col("_min") * F.col("_x") / 1000) * 1000).alias("invest"))


def grid_bounds(bars: DataFrame, key: Sequence[str]) -> DataFrame:
    """Suggested grid: padded, rounded bounds around the current price, number of levels."""
    a = bars.groupBy(*key).agg(F.count(F.lit(1)).alias("candles"), F.min("close").alias("_lo"), F.max("close").alias("_hi"),
                               F.max_by("close", "ts").alias("_cur"), F.min_by("close", "ts").alias("_open"))
    pad = (F.col("_hi") - F.col("_lo")) * 0.10
    a = a.withColumns({"_a": round_nice(F.greatest(F.lit(0.0), F.col("_lo") - pad), "floor"), "_b": round_nice(F.col("_hi") + pad, "ceil")})
    a = a.withColumns({"_a": F.when(F.col("_cur") < F.col("_a"), round_nice(F.col("_cur") * 0.85, "floor")).otherwise(F.col("_a")),
                       "_b": F.when(F.col("_cur") > F.col("_b"), round_nice(F.col("_cur") * 1.15, "ceil")).otherwise(F.col("_b"))})
    pct = F.when(F.col("_cur") > 0, (F.col("_b") - F.col("_a")) / F.nullif(F.col("_cur"), F.lit(0.0)) * 100).otherwise(20.0)
    return a.select(*key, "candles", F.round("_cur", 8).alias("current_price"), F.round("_lo", 8).alias("period_low"), F.round("_hi", 8).alias("period_high"),
                    F.when(F.col("_open") > 0, F.round((F.col("_cur") / F.col("_open") - 1) * 100, 2)).otherwise(0.0).alias("price_change_pct"),
                    F.round("_a", 6).alias("suggested_lower"), F.round("_b", 6).alias("suggested_upper"),
                    F.greatest(F.lit(3), F.least(F.lit(20), F.rint(pct / 2))).cast("int").alias("suggested_levels"))


def ensure_grid_bounds(bars: DataFrame, asked: DataFrame, key: Sequence[str]) -> DataFrame:
    """The asked ``lower_bound`` and ``upper_bound``; where they are unset, inverted or off the data, padded bounds of the data."""
    lo, hi = F.coalesce("lower_bound", F.lit(0.0)), F.coalesce("upper_bound", F.lit(0.0))
    a = bars.groupBy(*key).agg(F.min("close").alias("_lo"), F.max("close").alias("_hi")).join(asked, list(key))
    auto = (lo >= hi) | (lo > F.col("_hi")) | (hi < F.col("_lo"))
    pad = (F.col("_hi") - F.col("_lo")) * 0.10
    return a.select(*key, auto.alias("auto_set"), F.when(auto, round_nice(F.greatest(F.col("_lo") * 0.5, F.col("_lo") - pad), "floor")).otherwise(lo).alias("lower_bound"),
                    F.when(auto, round_nice(F.col("_hi") + pad, "ceil")).otherwise(hi).alias("upper_bound"))


# ------------------------------------------------------------------ symbols

# Fiat currency codes.
FIAT = ("USD", "EUR", "GBP", "JPY", "AUD", "NZD", "CAD", "CHF", "INR", "CNY", "CNH", "SGD", "HKD", "ZAR", "MXN", "SEK", "NOK", "DKK",
        "TRY", "KRW", "THB", "BRL", "PLN", "RUB", "AED", "SAR", "IDR", "MYR", "PHP", "TWD")

# Commodity and currency names and their tickers.
COMMODITY = {"XAUUSD": "GC=F", "XAU/USD": "GC=F", "GOLD": "GC=F", "XAGUSD": "SI=F", "XAG/USD": "SI=F", "SILVER": "SI=F", "WTI": "CL=F",
             "USOIL": "CL=F", "CRUDEOIL": "CL=F", "NATGAS": "NG=F", "NATURALGAS": "NG=F", "EURUSD": "EURUSD=X", "EUR/USD": "EURUSD=X",
             "GBPUSD": "GBPUSD=X", "GBP/USD": "GBPUSD=X", "USDJPY": "USDJPY=X", "USD/JPY": "USDJPY=X", "USDINR": "USDINR=X",
             "USD/INR": "USDINR=X", "AUDUSD": "AUDUSD=X", "AUD/USD": "AUDUSD=X", "USDCAD": "USDCAD=X", "USD/CAD": "USDCAD=X"}

# Indian index names and their tickers.
INDEX = {"NIFTY50": "^NSEI", "NIFTY": "^NSEI", "NIFTY 50": "^NSEI", "BANKNIFTY": "^NSEBANK", "BANK NIFTY": "^NSEBANK", "NIFTYNEXT50": "^NSMIDCP100",
         "NIFTYMID50": "^NSEMDCP50", "NIFTYIT": "^CNXIT", "NIFTY IT": "^CNXIT", "NIFTY100": "^CNX100", "NIFTY200": "^CNX200", "NIFTY500": "^CNX500",
         "FINNIFTY": "NIFTY_FIN_SERVICE.NS", "SENSEX": "^BSESN", "BSE500": "^BSE500", "VIX": "^INDIAVIX", "INDIA VIX": "^INDIAVIX"}

# Lot sizes of Indian futures and options.
LOTS = {"NIFTY50": 50, "NIFTY": 50, "BANKNIFTY": 15, "FINNIFTY": 40, "MIDCPNIFTY": 75, "SENSEX": 10, "ADANIENT": 125, "ADANIPORTS": 1250,
        "APOLLOHOSP": 125, "ASIANPAINT": 200, "AXISBANK": 1200, "BAJAJ-AUTO": 75, "BAJFINANCE": 125, "BAJAJFINSV": 125, "BHARTIARTL": 1000,
        "BPCL": 3000, "BRITANNIA": 200, "CIPLA": 650, "COALINDIA": 4200, "DIVISLAB": 200, "DRREDDY": 125, "EICHERMOT": 150, "GRASIM": 475,
        "HCLTECH": 700, "HDFCBANK": 550, "HDFCLIFE": 1100, "HEROMOTOCO": 300, "HINDALCO": 3500, "HINDUNILVR": 300, "ICICIBANK": 700,
        "INDUSINDBK": 525, "INFY": 300, "ITC": 3200, "JSWSTEEL": 1350, "KOTAKBANK": 400, "LT": 300, "M&M": 700, "MARUTI": 75, "NESTLEIND": 50,
        "NTPC": 4800, "ONGC": 3850, "POWERGRID": 4800, "RELIANCE": 250, "SBIN": 1500, "SBILIFE": 750, "SHREECEM": 25, "SUNPHARMA": 700,
        "TATAMOTORS": 2400, "TATACONSUM": 875, "TATASTEEL": 5500, "TCS": 150, "TECHM": 600, "TITAN": 375, "ULTRACEMCO": 100, "UPL": 1300,
        "WIPRO": 2800, "ZOMATO": 4500, "IRCTC": 875, "HAL": 175, "IDFCFIRSTB": 7000, "TVSMOTOR": 350, "ASHOKLEY": 6500, "NMDC": 7500,
        "VEDL": 3250, "TATAPOWER": 3375, "INDUSTOWER": 2800, "PERSISTENT": 250, "MPHASIS": 400, "LTIM": 150, "COFORGE": 200}

# Source aliases, allowed intervals, quote currencies.
SOURCES = {"binance": "binance", "crypto": "binance", "cryptocurrency": "binance", "binance (crypto)": "binance", "binance spot": "binance",
           "binance futures": "binance", "yfinance": "yfinance", "yahoo": "yfinance", "yahoo finance": "yfinance",
           "yahoo finance (us stocks)": "yfinance", "stocks": "yfinance", "us stocks": "yfinance", "nse": "nse", "nse (india)": "nse",
           "bse": "bse", "bse (india)": "bse"}
INTERVALS = ("1m", "5m", "15m", "30m", "1h", "4h", "1d", "1w")
QUOTES = ("USDT", "USDC", "BUSD", "BTC", "ETH")

# History limits of intraday intervals in days.
MAX_DAYS = {"1m": 7, "2m": 60, "5m": 60, "15m": 60, "30m": 60, "90m": 60, "1h": 730}


def lookup(c: Column, table: dict, default: Column | None = None) -> Column:
    """Literal map lookup; the tables here are fixed and short, so no join is needed."""
    m = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    hit = F.try_element_at(m, c)
    return hit if default is None else F.coalesce(hit, default)


def bare(c: Column) -> Column:
    return F.replace(F.replace(F.upper(F.trim(c)), F.lit("/"), F.lit("")), F.lit("-"), F.lit(""))


def norm_binance(c: Column | str) -> Column:
    return F.upper(F.regexp_replace(_c(c), "[/-]", ""))


def base_currency(c: Column | str) -> Column:
    return F.upper(F.split(_c(c), "/")[0])


def is_forex_pair(c: Column | str) -> Column:
    s = bare(_c(c))
    return (F.length(s) == 6) & F.substring(s, 1, 3).isin(*FIAT) & F.substring(s, 4, 3).isin(*FIAT)


def to_ticker(c: Column | str) -> Column:
    s = F.trim(_c(c))
    up = F.upper(s)
    base, quote = F.split(s, "/")[0], F.get(F.split(s, "/"), F.lit(1))
    return (F.when(s.endswith(".NS") | s.endswith(".BO") | s.startswith("^") | s.endswith("=X") | s.endswith("=F"), s)
            .when(up.isin(*COMMODITY), lookup(up, COMMODITY)).when(is_forex_pair(s), F.concat(bare(s), F.lit("=X")))
            .when(s.contains("/"), F.concat(base, F.lit("-"), F.when(F.upper(quote) == "USDT", "USD").otherwise(quote))).otherwise(s))


def to_indian_ticker(c: Column | str, exchange: Column | str = "NSE") -> Column:
    s = F.upper(F.trim(_c(c)))
    ex = F.lit(exchange) if isinstance(exchange, str) else exchange
    return (F.when(s.endswith(".NS") | s.endswith(".BO") | s.startswith("^"), s)
            .otherwise(lookup(s, INDEX, F.concat(s, F.when(F.upper(ex) == "BSE", ".BO").otherwise(".NS")))))


def clean_symbol(c: Column | str) -> Column:
    return F.replace(F.replace(F.upper(F.trim(_c(c))), F.lit(".NS"), F.lit("")), F.lit(".BO"), F.lit(""))


def is_indian(c: Column | str) -> Column:
    up = F.upper(_c(c))
    return up.endswith(".NS") | up.endswith(".BO") | clean_symbol(c).isin(*INDEX) | clean_symbol(c).isin(*LOTS)


def lot_size(c: Column | str) -> Column:
    return lookup(clean_symbol(c), LOTS, F.lit(1))


def lots_dim(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(LOTS.items()), "symbol string, lot_size int")


def norm_source(c: Column | str) -> Column:
    return lookup(F.lower(F.trim(_c(c))), SOURCES)


def norm_interval(c: Column | str) -> Column:
    v = F.lower(F.trim(_c(c)))
    return F.when(v.isin(*INTERVALS), v)


def norm_suggestion(df: DataFrame, symbol: str = "symbol", source: str = "source", interval: str = "interval") -> DataFrame:
    """Coerce suggested symbol, source and interval to known spellings, else null."""
    src, sym = norm_source(source), F.upper(F.trim(F.col(symbol)))
    sym = F.when(sym != "", sym)
    cand = F.when(sym.endswith("USD") & ~sym.endswith("BUSD"), F.concat(F.substring(sym, F.lit(1), F.length(sym) - 3), F.lit("USDT"))).otherwise(sym)
    slashed = F.when(cand.rlike(f"^.+({'|'.join(QUOTES)})$"), F.regexp_replace(cand, f"^(.+?)({'|'.join(QUOTES)})$", "$1/$2")).otherwise(sym)
    out = (F.when(F.coalesce(src, F.lit("binance")).isin("binance") & ~sym.contains("/"), slashed)
           .when(src.isin("nse", "bse"), F.split(sym, "\\.")[0]).otherwise(sym))
    return df.withColumns({"norm_symbol": out, "norm_source": src, "norm_interval": norm_interval(interval)})


def resolve_source(symbol: Column | str, source: Column | str) -> Column:
    """Unknown sources become ``auto``; fiat pairs exist only at one source."""
    s = F.lower(F.trim(_c(source)))
    ok = F.when(s.isin("binance", "yfinance", "nse", "bse", "auto"), s).otherwise("auto")
    return F.when(is_forex_pair(symbol), "yfinance").otherwise(ok)


def clamp_interval(interval: Column | str, days: Column | str) -> Column:
    """Step down to an interval whose history is long enough (fine -> 1h -> 1d)."""
    i, d = _c(interval), _c(days)
    fits = d <= lookup(i, MAX_DAYS) - 1
    hour = F.when(d <= MAX_DAYS["1h"] - 1, "1h").otherwise("1d")
    return F.when(lookup(i, MAX_DAYS).isNull(), i).when(fits, i).when(i == "1h", "1d").otherwise(hour)


def search_symbols(df: DataFrame, q: str, n: int = 20, symbol: str = "symbol", label: str = "label") -> DataFrame:
    up = q.upper()
    return df.filter(F.upper(symbol).contains(up) | F.upper(label).contains(up)).orderBy(symbol).limit(n)


def asset_list(dim: DataFrame, lots: DataFrame) -> DataFrame:
    """Symbols with label, lot size (1 where none is listed) and fund flag."""
    return dim.join(lots, "symbol", "left").select("symbol", "label", F.coalesce("lot_size", F.lit(1)).alias("lot_size"),
                                                              F.upper("label").contains("ETF").alias("is_etf"))


def param_summary(strategy: Column | str, params: Column | str) -> Column:
    """Short text for the parameters of the classic strategies (``params`` is a string map)."""
    s, p = _c(strategy), _c(params)
    g = lambda k: F.coalesce(F.try_element_at(p, F.lit(k)), F.lit(""))
    return (F.when(s == "GRID", F.concat(F.lit("lvl="), g("num_levels"), F.lit(" | spc="), F.substring(g("spacing"), 1, 3), F.lit(" | inv="), g("invest")))
            .when(s == "DCA", F.concat(F.lit("int="), g("buy_interval_hours"), F.lit("h | inv="), g("invest"), F.lit(" | hold="), g("hold_days"), F.lit("d | exit="), g("exit_type")))
            .when(s == "PLA", F.concat(F.lit("f="), g("fast"), F.lit(" | s="), g("slow"), F.lit(" | exit="), g("exit_type"), F.lit(" | tp="), g("take_profit_pct"), F.lit("%")))
            .otherwise(""))


def json_text(value: Column) -> Column:
    """A value as JSON: text quoted and escaped, numbers plain, lists with a blank after the comma."""
    t = F.to_json(F.array(value))
    t = F.substring(t, F.lit(2), F.length(t) - 2)
    small = F.regexp_replace(F.regexp_replace(t, r"^(-?\d+)\.0E", "$1E"), r"E-(\d)$", "E-0$1")
    wide = F.regexp_replace(t.cast("decimal(38,6)").cast("string"), r"(\.\d+?)0+$", "$1")
    return (F.when(t.rlike(r"^-?\d+\.\d+E-\d+$"), F.lower(small)).when(t.rlike(r"^-?\d+\.\d+E\d+$") & (F.abs(t.cast("double")) < 1e16), wide)
            .when(t.startswith("["), F.replace(t, F.lit(","), F.lit(", "))).otherwise(t))


def ascii_json(text: Column) -> Column:
    """Characters beyond ASCII as ``\\uXXXX``, those beyond the base plane as two."""
    unit = lambda n: F.concat(F.lit("\\u"), F.lpad(F.lower(F.hex(n)), 4, "0"))
    over = lambda n: F.concat(unit(F.floor((n - 65536) / 1024) + 0xD800), unit((n - 65536) % 1024 + 0xDC00))
    return F.array_join(F.transform(F.split(text, ""), lambda c: F.when(F.ascii(c) > 65535, over(F.ascii(c))).when(F.ascii(c) > 127, unit(F.ascii(c))).otherwise(c)), "")


def cache_key(strategy: Column | str, params: dict[str, Column], symbol: Column | str, timeframe: Column | str) -> Column:
    """Stable key: sha-256 over ASCII JSON with sorted names, first 32 hex digits; 10 and "10" differ."""
    items = F.concat_ws(", ", *[F.concat(json_text(F.lit(k)), F.lit(": "), json_text(params[k])) for k in sorted(params)])
    blob = F.concat(F.lit('{"params": {'), items, F.lit('}, "strategy": '), json_text(F.upper(_c(strategy))), F.lit(', "symbol": '),
                    json_text(F.upper(_c(symbol))), F.lit(', "timeframe": '), json_text(_c(timeframe)), F.lit("}"))
    return F.substring(F.sha2(ascii_json(blob), 256), 1, 32)


def calendar_parts(ts: Column | str) -> dict[str, Column]:
    t = _c(ts)
    return {"year": F.year(t), "month": F.month(t), "weekday": F.weekday(t), "hour": F.hour(t), "month_name": F.date_format(t, "MMM"), "day_name": F.date_format(t, "EEE")}
