"""The windows that all operators share: per symbol, in time order.

Using one partitioning and one order everywhere lets Spark serve any number of rules and indicators
with one exchange and one sort.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Frame:
    """Windows over bars of ``symbol`` ordered by ``ts``.

    Where symbols are cut (``barlab.operators.slices``), ``slice``, ``number``, ``size_of`` and ``own`` name the columns of a bar's slice, of its
    number within the symbol, of the symbol's number of bars, and of whether it is no copy. Windows then end with the slice, so frames must not be unbounded.
    """

    symbol: str = "symbol"
    ts: str = "ts"
    slice: str | None = None
    number: str | None = None
    size_of: str | None = None
    own: str | None = None

    @property
    def ordered(self) -> WindowSpec:
        if self.slice is None:
            return Window.partitionBy(self.symbol).orderBy(self.ts)
        return Window.partitionBy(self.symbol, self.slice).orderBy(self.number)

    def _unbounded(self) -> None:
        if self.slice is not None:
            raise ValueError("a frame over a whole symbol, whose bars are cut into slices")

    @property
    def whole(self) -> WindowSpec:
        self._unbounded()
        return self.ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)

    @property
    def so_far(self) -> WindowSpec:
        self._unbounded()
        return self.ordered.rowsBetween(Window.unboundedPreceding, 0)

    def rows(self, first: int, last: int) -> WindowSpec:
        """Rows from ``first`` to ``last`` relative to the current one."""
        if first <= Window.unboundedPreceding or last >= Window.unboundedFollowing:
            self._unbounded()
        return self.ordered.rowsBetween(first, last)

    def index(self) -> Column:
        """Number of the bar within its symbol, from 0."""
        return F.row_number().over(self.ordered) - 1 if self.number is None else F.col(self.number)

    def size(self) -> Column:
        """Number of bars of the symbol."""
        return F.count("*").over(self.whole) if self.size_of is None else F.col(self.size_of)

    def lag(self, column: str | Column, n: int = 1) -> Column:
        return F.lag(column, n).over(self.ordered)

    def total(self, column: str | Column, n: int, back: int = 0) -> Column:
        """Sum over the ``n`` bars that end ``back`` bars ago; of fewer, where there are not as many."""
        return F.sum(column).over(self.rows(-(n - 1) - back, -back))

    def has(self, n: int) -> Column:
        """Whether the symbol has at least ``n`` bars up to the current one."""
        return self.index() >= n - 1


FRAME = Frame()


def unused(df: DataFrame, *names: str) -> list[str]:
    """``names`` for columns that are added for a while, with underscores after those that ``df`` has."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out
