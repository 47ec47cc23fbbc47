"""Symbols streamed through tasks in Arrow batches.

A group of its own, in grouped pandas functions, costs milliseconds however few bars it has. Here a task reads batches of
bars in order, and takes each batch's symbols as slices of the same columns. A task holds a batch, or one symbol where that is longer.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame


def in_order(rows: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """``rows`` with equal ``keys`` next to each other in one task, by ``order``.

    A number of partitions is given, as adaptive coalescing looks at bytes and the work in Python is per byte heavy.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, *keys).sortWithinPartitions(*keys, *order)


def _begins(columns: Sequence[pa.Array]) -> np.ndarray:
    """Rows whose keys differ from those of the row before."""
    changes = [np.diff(c.dictionary_encode().indices.fill_null(-1).to_numpy()) != 0 for c in columns]
    return np.flatnonzero(np.logical_or.reduce(changes)) + 1


def whole_symbols(batches: Iterator[pa.RecordBatch], keys: Sequence[int]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Batches cut between symbols, with the rows at which these begin and the end; ``keys``: numbers of the columns that tell symbols apart."""
    held: list[pa.RecordBatch] = []
    value = lambda batch: [batch.column(k)[0].as_py() for k in keys]

    def joined() -> tuple[pa.RecordBatch, np.ndarray]:
        whole = held[0] if len(held) == 1 else pa.concat_batches(held)
        return whole, np.concatenate([[0], _begins([whole.column(k) for k in keys]), [whole.num_rows]])

    for batch in batches:
        if not batch.num_rows:
            continue
        begins = _begins([batch.column(k) for k in keys])
        last = int(begins[-1]) if len(begins) else 0
        if held and (last or value(held[-1]) != value(batch)):
            held += [batch.slice(0, last)] if last else []
            yield joined()
            held = []
        elif last:
            held = [batch.slice(0, last)]
            yield joined()
            held = []
        held.append(batch.slice(last))
    if held:
        yield joined()


def to_pandas(rows: pa.RecordBatch | pa.Array) -> pd.DataFrame | pd.Series:
    """As Spark's own pandas functions get them: times without a zone, in that of the session."""
    made = rows.to_pandas(coerce_temporal_nanoseconds=True)
    if isinstance(made, pd.Series):
        return made.dt.tz_localize(None) if isinstance(made.dtype, pd.DatetimeTZDtype) else made
    zoned = [c for c, t in made.dtypes.items() if isinstance(t, pd.DatetimeTZDtype)]
    return made.assign(**{c: made[c].dt.tz_localize(None) for c in zoned})


class _Arrays(dict):
    """Columns as read-only numpy arrays, converted when first asked for."""

    def __init__(self, rows: pa.RecordBatch):
        super().__init__()
        self.rows = rows

    def __missing__(self, name: str) -> np.ndarray:
        made = to_pandas(self.rows.column(name)).to_numpy().view()
        made.flags.writeable = False
        self[name] = made
        return made


class Prefix:
    """A symbol's first bars: ``len()`` of them, and columns by name as numpy arrays, which are cut when they are asked for."""

    __slots__ = ("_arrays", "_first", "_last")

    def __init__(self, arrays: _Arrays, first: int, last: int):
        self._arrays, self._first, self._last = arrays, first, last

    def __len__(self) -> int:
        return self._last - self._first

    def __getitem__(self, name: str) -> np.ndarray:
        return self._arrays[name][self._first : self._last]


def arrays_of(rows: pa.RecordBatch) -> _Arrays:
    return _Arrays(rows)
