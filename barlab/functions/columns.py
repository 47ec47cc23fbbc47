"""Scalar columns and predicates over bars. Prices are whole thousandths of a currency unit."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barlab.functions.frames import FRAME, Frame

MILLI = 1000.0
PRICES = ("open", "high", "low", "close")


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


# ---------------------------------------------------------------- projections


def currency(price: Column | str) -> Column:
    """Thousandths to currency units."""
    return _col(price) / MILLI


def scale_prices(bars: DataFrame, columns: Iterable[str] = PRICES) -> DataFrame:
    return bars.withColumns({c: currency(c) for c in columns})


def turnover_pct(v: Column | str) -> Column:
    """Turnover as a percentage: fractions up to 1 are scaled, null is 0."""
    v = F.coalesce(_col(v), F.lit(0.0))
    return F.when(v <= 1, v * 100).otherwise(v)


def format_units(v: Column | str, unit: str = "", plain_small: bool = False) -> Column:
    """Large numbers in units of 1e8 and 1e4 with two decimals, half up; ``plain_small`` leaves others as they are."""
    v = _col(v).cast("double")
    small = v.cast("string") if plain_small else F.format_string("%.2f", v)
    text = F.when(v >= 1e8, F.format_string("%.2f亿", v / 1e8)).when(v >= 1e4, F.format_string("%.2f万", v / 1e4)).otherwise(small)
    finite = v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    return F.when(finite, F.concat(text, F.lit(unit))).otherwise("0")


def normalize_time(t: Column | str) -> Column:
    """Numbers over 1e10 are milliseconds since the epoch, others seconds."""
    t = _col(t)
    return F.when(t > 10_000_000_000, F.timestamp_millis(t.cast("long"))).otherwise(F.timestamp_seconds(t))


def price_rescale(bars: DataFrame, frame: Frame = FRAME, columns: tuple[str, ...] = PRICES) -> DataFrame:
    """Divides a symbol's prices by 1000 if any of them is over 1000."""
    top = F.max(F.greatest(*columns)).over(frame.whole)
    return bars.withColumn("_top", top).withColumns({c: F.when(F.col("_top") > 1000, F.col(c) / MILLI).otherwise(F.col(c).cast("double")) for c in columns}).drop("_top")


def bar_direction() -> Column:
    return F.when(F.col("close") >= F.col("open"), "up").otherwise("down")


def signal_label(signal: Column | str) -> Column:
    s = _col(signal)
    return F.when(s == 1, "buy").when(s == -1, "sell").otherwise("hold")


def date_label(ts: Column | str = "ts") -> Column:
    return F.date_format(ts, "yy-MM-dd")


@dataclass(frozen=True)
class Settings:
    """Of a backtest: cash, lots bought at once, fees, slippage; stop-loss and take-profit shares (0: none)."""

    cash: float = 100_000.0
    size: int = 1
    fee_rate: float = 0.0005
    min_fee: float = 5.0
    slippage: float = 0.0
    stop_loss: float = 0.0
    take_profit: float = 0.0


def with_defaults(params: DataFrame, defaults: Settings = Settings()) -> DataFrame:
    """Puts defaults where cash, size, fee_rate or min_fee are not positive; nulls too."""
    return params.withColumns({c: F.when(F.col(c) > 0, F.col(c)).otherwise(F.lit(getattr(defaults, c)).cast(params.schema[c].dataType)) for c in ("cash", "size", "fee_rate", "min_fee")})


# ---------------------------------------------------------------- predicates


def on_exchange(exchange: str, symbol: Column | str = "symbol") -> Column:
    return _col(symbol).startswith(exchange)


def no_buy_limit(symbol: Column | str = "symbol") -> Column:
    """Symbols of the main boards, open to every account."""
    return _col(symbol).startswith("sh60") | _col(symbol).startswith("sz0")


def in_codes(bars: DataFrame, codes: DataFrame | Iterable[str], symbol: str = "symbol") -> DataFrame:
    """Rows of the given symbols; a DataFrame of them is joined, so it may be large."""
    if isinstance(codes, DataFrame):
        return bars.join(codes.select(F.col(codes.columns[0]).alias(symbol)).distinct(), symbol, "left_semi")
    return bars.where(F.col(symbol).isin(list(codes)))


def search_symbols(query: str, symbol: Column | str = "symbol", name: Column | str = "name") -> Column:
    """Case-insensitive substring of the symbol or of ``name-symbol``."""
    q = query.lower()
    both = F.concat(F.coalesce(_col(name), F.lit("")), F.lit("-"), _col(symbol))
    return F.lower(_col(symbol)).contains(q) | F.lower(both).contains(q)


def time_range(start: datetime | str | None = None, end: datetime | str | None = None, ts: str = "ts") -> Column:
    """Strictly between the bounds; a missing bound is open. A plain filter, so it reaches the scan."""
    kept = F.lit(True)
    if start is not None:
        kept = F.col(ts) > F.lit(start).cast("timestamp")
    if end is not None:
        kept = kept & (F.col(ts) < F.lit(end).cast("timestamp"))
    return kept


def min_history(n: int, frame: Frame = FRAME) -> Column:
    return frame.has(n)
