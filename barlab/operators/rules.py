"""Signal rules, each a boolean column that is valid at every bar.

A rule says at bar t what it would say of the history that ends at t, so screening (the last bar) and
backtests (all bars) share it. Averages are compared as integer sums, multiplied crosswise, so equal
averages are equal. A rule may be

- a column: ``@rule("name")`` on ``fn(frame) -> Column``;
- a series function: ``@pandas_rule("name")`` on ``fn(pdf) -> bools`` over a symbol's ordered bars; with ``arrays=True`` its columns are numpy arrays;
- a prefix function: ``@prefix_rule("name")`` on ``fn(symbol, pdf) -> bool`` over each prefix, which takes
  quadratic time where the function reads it all, and serves as a compatible form and as a test oracle; with ``arrays=True`` a prefix's
  columns are numpy arrays, and a function that reads the last bars of it takes as long at every bar.

Rules may also see a symbol's snapshot (``info``) and its minute bars, of which those up to the end of each bar's day count:

- ``@rule("name", info=True, minutes=lambda: {"top": F.max("high")})``: the columns ``info`` and ``minute`` are structs, of the snapshot and of
  aggregates of the day's minute bars (null where it has none);
- ``@pandas_rule("name", full=True)`` on ``fn(info, day, minute) -> bools``, and ``@prefix_rule("name", full=True)`` on ``fn(info,
  day, minute) -> bool``: day and minute bars of a symbol come together; ``info`` is a dict.

Minute bars and names are passed as ``feeds``; without them there are none. The snapshot is of the symbol's last bar in the range,
also for earlier bars, as in the blueprint (its decision Q6): a rule that reads its price looks ahead.

Names are looked up in one registry; a later registration shadows an earlier one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barlab.functions.columns import no_buy_limit, on_exchange
from barlab.functions.frames import FRAME, Frame, unused
from barlab.operators.streams import Prefix, arrays_of, in_order, to_pandas, whole_symbols

#: (bars, frame, name of the new column) -> bars with the boolean column.
Rule = Callable[[DataFrame, Frame, str], DataFrame]
_RULES: dict[str, Rule] = {}


def _from_column(fn: Callable[[Frame], Column]) -> Rule:
    return lambda bars, frame, out: bars.withColumn(out, F.coalesce(fn(frame), F.lit(False)))


@dataclass(frozen=True)
class Feeds:
    """What rules may see beside the bars: minute bars of the same symbols, and (symbol, name)."""

    minutes: DataFrame | None = None
    names: DataFrame | None = None

    def minutes_of(self, bars: DataFrame) -> DataFrame:
        """The minute bars; where there are none, an empty table like ``bars``."""
        return bars.sparkSession.createDataFrame([], bars.schema) if self.minutes is None else self.minutes


@dataclass(frozen=True)
class Fed:
    """A rule that sees feeds; called like any other rule, it has none."""

    run: Callable[[DataFrame, Frame, str, Feeds], DataFrame]

    def __call__(self, bars: DataFrame, frame: Frame, out: str) -> DataFrame:
        return self.run(bars, frame, out, Feeds())


#: Fields of the snapshot, in the order and with the types of the blueprint.
INFO = "code string, name string, price long, turnover double, float_stock long, total_stock long, float_value long, total_value long"


def info_of(bars: DataFrame, frame: Frame = FRAME, feeds: Feeds = Feeds()) -> DataFrame:
    """(symbol, info): each symbol's snapshot as a struct; null fields where bars have no such column."""
    have = {c: F.max_by(c, frame.ts) for c in ("turnover", "float_stock", "total_stock") if c in bars.columns}
    last = bars.groupBy(frame.symbol).agg(F.max_by("close", frame.ts).alias("price"), *[v.alias(c) for c, v in have.items()])
    if feeds.names is not None:
        last = last.join(feeds.names.groupBy("symbol").agg(F.min("name").alias("name")).withColumnRenamed("symbol", frame.symbol), frame.symbol, "left")
    value = lambda c: F.col(c) if c in last.columns else F.lit(None)
    made = {"code": F.col(frame.symbol), "float_value": value("float_stock") * F.col("price"), "total_value": value("total_stock") * F.col("price")}
    fields = [made.get(n, value(n)).cast(k).alias(n) for n, k in (f.split(" ") for f in INFO.split(", "))]
    return last.select(frame.symbol, F.struct(*fields).alias("info"))


def _day(ts: str) -> Column:
    return F.to_date(ts)


def _with_feeds(fn: Callable[[Frame], Column], info: bool, minutes: Callable[[], dict[str, Column]] | None) -> Fed:
    """The rule of a column that reads ``info`` and ``minute``."""

    def run(bars: DataFrame, frame: Frame, out: str, feeds: Feeds) -> DataFrame:
        rows, taken = bars, {c.lower() for c in bars.columns}
        if taken & {"info", "minute"}:
            raise ValueError("bars have a column info or minute already")
        (day,) = unused(bars, "_day")
        if minutes:
            source = feeds.minutes_of(bars)
            parts = minutes()
            made = source.groupBy(frame.symbol, _day(frame.ts).alias(day)).agg(*[a.alias(c) for c, a in parts.items()])
            own = made.select(frame.symbol, day, F.struct(*parts).alias("minute"))
            rows = rows.withColumn(day, _day(frame.ts)).join(own, [frame.symbol, day], "left").drop(day)
        if info:
            rows = rows.join(info_of(bars, frame, feeds), frame.symbol, "left")
        return _from_column(fn)(rows, frame, out).select(*bars.columns, out)

    return Fed(run)


def rule(name: str, info: bool = False, minutes: Callable[[], dict[str, Column]] | None = None) -> Callable:
    """Registers a rule given as a column; ``minutes`` makes the aggregates of a day's minute bars that it reads."""

    def add(fn: Callable[[Frame], Column]) -> Callable[[Frame], Column]:
        _RULES[name] = _with_feeds(fn, info, minutes) if info or minutes else _from_column(fn)
        return fn

    return add


def staged_rule(name: str) -> Callable:
    """Registers a rule that adds its column in several steps."""

    def add(fn: Rule) -> Rule:
        _RULES[name] = fn
        return fn

    return add


def _bools(made: Iterable[bool], n: int) -> list[bool] | np.ndarray:
    """What a rule says of ``n`` bars."""
    given = np.asarray(made) if isinstance(made, (pd.Series, np.ndarray)) and made.dtype == bool else [bool(x) for x in made]
    if len(given) != n:
        raise ValueError(f"a rule gave {len(given)} values for {n} bars")
    return given


def _flagged(rows: pa.RecordBatch, names: list[str], parts: list[list[bool] | np.ndarray]) -> pa.RecordBatch:
    """``rows`` and the bools of their symbols."""
    flags = pa.array(np.concatenate([np.asarray(p, bool) for p in parts]))
    return pa.RecordBatch.from_arrays([*rows.columns, flags], names)


def _frames(rows: pa.RecordBatch, cuts: np.ndarray, **more: np.ndarray) -> Iterator[pd.DataFrame]:
    """A table of its own for each symbol."""
    made = to_pandas(rows).assign(**more)
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        yield made.iloc[a:b].reset_index(drop=True)


def _grouped(series: Callable[[list[str], pa.RecordBatch, np.ndarray], Iterator[Iterable[bool]]]) -> Rule:
    """The rule that ``series`` gives for (symbols, their bars, where these begin and end), symbol by symbol."""

    def apply(bars: DataFrame, frame: Frame, out: str) -> DataFrame:
        names = [*bars.columns, out]
        key = [c.lower() for c in bars.columns].index(frame.symbol.lower())

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for rows, cuts in whole_symbols(batches, [key]):
                symbols = rows.column(key).take(pa.array(cuts[:-1])).to_pylist()
                parts = [_bools(made, n) for made, n in zip(series(symbols, rows, cuts), np.diff(cuts), strict=True)]
                yield _flagged(rows, names, parts)

        schema = T.StructType([*bars.schema.fields, T.StructField(out, T.BooleanType())])
        return in_order(bars, [frame.symbol], [F.asc_nulls_last(frame.ts)]).mapInArrow(run, schema)

    return apply


#: Kinds of rows that are streamed together.
_NAME, _DAY, _MINUTE = 0, 1, 2
#: (snapshots, day bars, their cuts, minute bars, their cuts, number of minute bars of the symbol up to the end of each day) -> bools of each symbol.
_Series = Callable[[list[dict], pa.RecordBatch, np.ndarray, pa.RecordBatch, np.ndarray, np.ndarray], Iterator[Iterable[bool]]]


def _snapshots(bars: DataFrame) -> Column:
    """The snapshot that a symbol has if a bar is its last, without code and name; fields that ``bars`` say nothing of are left out."""
    have = {"price": F.col("close"), **{c: F.col(c) for c in ("turnover", "float_stock", "total_stock") if c in bars.columns}}
    have |= {v: F.col(c) * F.col("close") for v, c in (("float_value", "float_stock"), ("total_value", "total_stock")) if c in have}
    types = dict(f.split(" ") for f in INFO.split(", "))
    return F.struct(*[v.cast(types[c]).alias(c) for c, v in have.items()])


def _cogrouped(series: _Series) -> Fed:
    """The rule over snapshots, day and minute bars, which are one stream: of each symbol its name, then its day bars, then its minute bars.

    The snapshot is read from the last day bar of the stream. An aggregate for it would make the day bars again, from other columns, so that
    no exchange below it serves both.
    """

    def apply(bars: DataFrame, frame: Frame, out: str, feeds: Feeds) -> DataFrame:
        minutes = feeds.minutes_of(bars)
        snapshots = bars.select(_snapshots(bars).alias("info")).schema["info"].dataType
        whole, part = (T.StructType([T.StructField(f.name, f.dataType) for f in b.schema]) for b in (bars, minutes))
        # Day and minute bars of the same columns share one.
        of_minutes = "_bar" if whole == part else "_minute"
        kinds = {"_name": T.StringType(), "_info": snapshots, "_bar": whole, of_minutes: part}

        def of_kind(rows: DataFrame, kind: int, symbol: str, ts: Column, **values: Column) -> DataFrame:
            made = [values.get(c, F.lit(None)).cast(t).alias(c) for c, t in kinds.items()]
            return rows.select(F.col(symbol).alias("_symbol"), F.lit(kind).alias("_kind"), ts.cast("timestamp").alias("_ts"), F.unix_date(_day(ts)).cast("long").alias("_date"), *made)

        rows = of_kind(bars, _DAY, frame.symbol, F.col(frame.ts), _info=_snapshots(bars), _bar=F.struct("*"))
        rows = rows.unionAll(of_kind(minutes, _MINUTE, frame.symbol, F.col(frame.ts), **{of_minutes: F.struct("*")}))
        if feeds.names is not None:
            named = feeds.names.where("symbol is not null").groupBy("symbol").agg(F.min("name").alias("name"))
            rows = rows.unionAll(of_kind(named, _NAME, "symbol", F.lit(None).cast("timestamp"), _name=F.col("name")))
        names, fields = [*bars.columns, out], [f.split(" ")[0] for f in INFO.split(", ")]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for rows, cuts in whole_symbols(batches, [0]):
                kind = rows.column("_kind").to_numpy()
                mine = [kind == k for k in (_NAME, _DAY, _MINUTE)]
                # Symbols of minute bars alone have no rows to give.
                wanted = np.add.reduceat(mine[_DAY], cuts[:-1], dtype=np.int64) > 0
                if not wanted.any():
                    continue
                sums = lambda m: np.concatenate([[0], np.cumsum(m)])
                cut = lambda k: sums(mine[k])[cuts]
                of = lambda c, k: rows.column(c).filter(pa.array(mine[k]))
                day, minute = (pa.RecordBatch.from_struct_array(of(c, k)) for c, k in (("_bar", _DAY), (of_minutes, _MINUTE)))
                # Without a time: after all others.
                date = rows.column("_date").fill_null(np.iinfo(np.int64).max).to_numpy()
                days, ends, (begin, end) = date[mine[_DAY]], date[mine[_MINUTE]], (cut(_DAY), cut(_MINUTE))
                seen = np.concatenate([np.searchsorted(ends[c:d], days[a:b], side="right") for a, b, c, d in zip(begin, begin[1:], end, end[1:])])
                # The last bar that has a time.
                timed = np.diff(sums(of("_ts", _DAY).is_valid().to_numpy(zero_copy_only=False))[begin])
                last = pa.array(begin[:-1] + timed - 1, mask=timed == 0).filter(pa.array(wanted))
                infos = [dict.fromkeys(fields) | (found or {}) for found in of("_info", _DAY).take(last).to_pylist()]
                codes = rows.column(0).take(pa.array(cuts[:-1][wanted])).cast(pa.string()).to_pylist()
                first = rows.column("_name").take(pa.array(cuts[:-1][wanted])).to_pylist()
                for info, code, name in zip(infos, codes, first, strict=True):
                    info["code"], info["name"] = code, name
                given = series(infos, day, begin, minute, end, seen)
                parts = [_bools(g, n) for g, n in zip(given, np.diff(begin)[wanted], strict=True)]
                yield _flagged(day, names, parts)

        schema = T.StructType([*bars.schema.fields, T.StructField(out, T.BooleanType())])
        return in_order(rows, ["_symbol"], ["_kind", F.asc_nulls_last("_ts")]).mapInArrow(run, schema)

    return Fed(apply)


def pandas_rule(name: str, full: bool = False, arrays: bool = False) -> Callable:
    """Registers a rule given as a function of a symbol's whole ordered series; ``full``: of its snapshot, day bars and minute bars.

    Minute bars come whole; the column ``minutes_seen`` of the day bars says how many of them there are up to each day's end. ``arrays``: series
    are no tables but ``Prefix``, whose columns are numpy arrays. A table of its own takes a fifth of a millisecond for each symbol, and each operation on its columns more.
    """

    def add(fn: Callable[..., Iterable[bool]]) -> Callable:
        def tables(rows: pa.RecordBatch, cuts: np.ndarray, **more: np.ndarray) -> Iterator[pd.DataFrame | Prefix]:
            if not arrays:
                return _frames(rows, cuts, **more)
            columns = arrays_of(rows)
            columns.update(more)
            return (Prefix(columns, a, b) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True))

        def fed(infos, day, begin, minute, end, seen):
            own = iter(infos)
            for d, m in zip(tables(day, begin, minutes_seen=seen), tables(minute, end), strict=True):
                if len(d):
                    yield fn(next(own), d, m)

        _RULES[name] = _cogrouped(fed) if full else _grouped(lambda _, rows, cuts: map(fn, tables(rows, cuts)))
        return fn

    return add


def prefix_rule(name: str, full: bool = False, arrays: bool = False) -> Callable:
    """Registers a rule given as a function of the symbol and each prefix of its series; ``full``: of its snapshot, and prefixes of day and minute bars.

    ``arrays``: prefixes are no tables but ``Prefix``, whose columns are numpy arrays. Cutting a table takes some fifty times as long as cutting an array.
    """

    def add(fn: Callable[..., bool]) -> Callable:
        def tables(rows: pa.RecordBatch, cuts: np.ndarray) -> Iterator[Callable[[int], pd.DataFrame | Prefix]]:
            """For each symbol, what gives its first n bars."""
            if arrays:
                columns = arrays_of(rows)
                return (lambda n, a=a: Prefix(columns, a, a + n) for a in cuts[:-1].tolist())
            return (lambda n, pdf=pdf: pdf.iloc[:n] for pdf in _frames(rows, cuts))

        def alone(symbols, rows, cuts):
            for symbol, first, n in zip(symbols, tables(rows, cuts), np.diff(cuts).tolist(), strict=True):
                yield [bool(fn(symbol, first(i))) for i in range(1, n + 1)]

        def fed(infos, day, begin, minute, end, seen):
            own, counts = iter(infos), seen.tolist()
            for first, minutes, a, b in zip(tables(day, begin), tables(minute, end), begin[:-1].tolist(), begin[1:].tolist(), strict=True):
                if a < b:
                    info = next(own)
                    yield [bool(fn(info, first(i), minutes(n))) for i, n in enumerate(counts[a:b], 1)]

        _RULES[name] = _cogrouped(fed) if full else _grouped(alone)
        return fn

    return add


def remove(name: str) -> None:
    _RULES.pop(name, None)


def names() -> list[str]:
    return sorted(_RULES)


def lookup(given: str | Rule) -> Rule:
    if callable(given):
        return given
    if given not in _RULES:
        raise KeyError(f"no rule {given!r}; there are {', '.join(names())}")
    return _RULES[given]


def apply_rule(chosen: Rule, bars: DataFrame, frame: Frame, out: str, feeds: Feeds) -> DataFrame:
    return chosen.run(bars, frame, out, feeds) if isinstance(chosen, Fed) else chosen(bars, frame, out)


def all_of(given: Iterable[str | Rule]) -> Rule:
    """The rule that holds where all of ``given`` do."""
    rules = [lookup(r) for r in given]
    if not rules:
        raise ValueError("no rule is chosen")

    def run(bars: DataFrame, frame: Frame, out: str, feeds: Feeds) -> DataFrame:
        parts = unused(bars, *[f"_{out}_{k}" for k in range(len(rules))])
        for r, part in zip(rules, parts, strict=True):
            bars = apply_rule(r, bars, frame, part, feeds)
        both = reduce(lambda a, b: a & b, [F.coalesce(F.col(p), F.lit(False)) for p in parts])
        return bars.withColumn(out, both).drop(*parts)

    return Fed(run)


def with_signal(bars: DataFrame, given: str | Rule | Iterable[str | Rule], out: str = "flag", frame: Frame = FRAME, feeds: Feeds = Feeds()) -> DataFrame:
    """``bars`` with the boolean column of a rule, or of all of several."""
    chosen = lookup(given) if isinstance(given, str) or callable(given) else all_of(given)
    return apply_rule(chosen, bars, frame, out, feeds)


def signal_series(bars: DataFrame, given: str | Rule | Iterable[str | Rule], frame: Frame = FRAME, feeds: Feeds = Feeds()) -> DataFrame:
    """``bars`` with ``signal``, 1 where the rule holds and else 0."""
    return with_signal(bars, given, "signal", frame, feeds).withColumn("signal", F.col("signal").cast("int"))


# ---------------------------------------------------------------- built-in rules


def ma(n: int, frame: Frame = FRAME, price: str = "close") -> Column:
    """Mean of the last ``n`` prices; 0 where there are fewer."""
    return F.when(frame.has(n), frame.total(price, n) / n).otherwise(0.0)


def rise(n: int = 3) -> Callable[[Frame], Column]:
    """Each of the last ``n`` closes above the one before."""
    return lambda f: reduce(lambda a, b: a & b, [f.lag("close", k) > f.lag("close", k + 1) if k else F.col("close") > f.lag("close", 1) for k in range(n - 1)])


def bullish_alignment(lengths: tuple[int, ...] = (5, 10, 20, 30)) -> Callable[[Frame], Column]:
    """Shorter means above longer ones, every mean rising, and not so ordered one bar before."""
    pairs = list(zip(lengths, lengths[1:], strict=False))

    def fn(f: Frame) -> Column:
        def ordered(back: int) -> Column:
            return reduce(lambda a, b: a & b, [f.total("close", m, back) * n > f.total("close", n, back) * m for m, n in pairs])

        rising = reduce(lambda a, b: a & b, [f.total("close", n) > f.total("close", n, 1) for n in lengths])
        return f.has(max(lengths) + 1) & ordered(0) & ~ordered(1) & rising

    return fn


def sma_cross(fast: int = 5, slow: int = 20) -> Callable[[Frame], Column]:
    """The fast mean is above the slow one and was not one bar before."""

    def fn(f: Frame) -> Column:
        above = lambda back: f.total("close", fast, back) * slow > f.total("close", slow, back) * fast
        return f.has(slow + 1) & above(0) & ~above(1)

    return fn


def rsi(bars: DataFrame, n: int = 14, out: str = "rsi", frame: Frame = FRAME) -> DataFrame:
    """``bars`` with 100 * gains / (gains + losses) over the last ``n`` changes; null without any change."""
    step = F.col("close") - frame.lag("close")
    gain, loss, i = unused(bars, "_up", "_down", "_i")
    bars = bars.withColumn(gain, F.greatest(step, F.lit(0))).withColumn(loss, F.greatest(-step, F.lit(0))).withColumn(i, frame.index())
    up, down = frame.total(gain, n), frame.total(loss, n)
    value = F.when((F.col(i) >= n) & (up + down > 0), 100.0 * up / F.when(up + down > 0, up + down))
    return bars.withColumn(out, value).drop(gain, loss, i)


def rsi_below(threshold: float = 30.0, n: int = 14) -> Rule:
    def apply(bars: DataFrame, frame: Frame, out: str) -> DataFrame:
        (value,) = unused(bars, "_rsi")
        return rsi(bars, n, value, frame).withColumn(out, F.coalesce(F.col(value) < threshold, F.lit(False))).drop(value)

    return apply


def limit_up_gap(threshold: float = 0.098, recent: int = 20, bull: int = 2, vol: int = 5) -> Rule:
    """A recent limit-up, a gap above it on the next bar, rising bars from there, and today a surge of volume.

    A pattern is known at its last bar, ``max(bull, 1)`` bars after the limit-up; it counts while the
    limit-up is among the last ``recent`` bars.
    """
    after = max(bull, 1)

    def apply(bars: DataFrame, frame: Frame, out: str) -> DataFrame:
        close, before = frame.lag("close", after), frame.lag("close", after + 1)
        gap = frame.lag("open", after - 1) if after > 1 else F.col("open")
        pattern = (before != 0) & ((close.cast("double") - before.cast("double")) / F.nullif(before.cast("double"), F.lit(0.0)) >= threshold) & (gap > close)
        for k in range(bull):
            at = lambda c, k=k: frame.lag(c, k) if k else F.col(c)
            pattern = pattern & (at("close") > at("open"))
        (found,) = unused(bars, "_pattern")
        held = F.max(F.coalesce(F.col(found), F.lit(False))).over(frame.rows(-(recent - 1 - after), 0))
        past = frame.rows(-vol, -1)
        surge = (F.col("volume") * F.count("volume").over(past) > F.sum("volume").over(past)) & (F.col("volume") > frame.lag("volume"))
        bars = bars.withColumn(found, pattern)
        return bars.withColumn(out, F.coalesce(frame.has(recent) & held & surge, F.lit(False))).drop(found)

    return apply


rule("exchange_sh")(lambda f: on_exchange("sh", f.symbol))
rule("exchange_sz")(lambda f: on_exchange("sz", f.symbol))
rule("exchange_bj")(lambda f: on_exchange("bj", f.symbol))
rule("no_buy_limit")(lambda f: no_buy_limit(f.symbol))
rule("rise_three")(rise(3))
rule("bullish_alignment")(bullish_alignment())
rule("sma_cross")(sma_cross())
staged_rule("rsi_below")(rsi_below())
staged_rule("limit_up_gap")(limit_up_gap())


def registered() -> Iterator[tuple[str, Rule]]:
    yield from sorted(_RULES.items())
