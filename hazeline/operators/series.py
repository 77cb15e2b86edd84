"""History features over the readings of one place.

A window partition is one (country, city). The daily fact has one row per place
and date, so a partition is bounded by the calendar (about 366 rows a year),
however many raw readings a place has. Frames count rows and ignore gaps in the
dates; ``calendar=True`` frames by days instead.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import Window, WindowSpec

PLACE = ["country", "city"]


def place_window(keys: Sequence[str] = PLACE, order: str = "date") -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(order)


def calendar_window(keys: Sequence[str] = PLACE, order: str = "date") -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(F.unix_date(order))


def _frame(first: int, last: int, calendar: bool) -> WindowSpec:
    if calendar:
        return calendar_window().rangeBetween(first, last)
    return place_window().rowsBetween(first, last)


def rolling_mean(c: str | Column, n: int, calendar: bool = False) -> Column:
    """Mean of the n rows before the current one."""
    return F.avg(c).over(_frame(-n, -1, calendar))


def rolling_std(c: str | Column, n: int, calendar: bool = False) -> Column:
    return F.stddev_samp(c).over(_frame(-n, -1, calendar))


def rolling_min(c: str | Column, n: int, calendar: bool = False) -> Column:
    return F.min(c).over(_frame(-n, -1, calendar))


def rolling_max(c: str | Column, n: int, calendar: bool = False) -> Column:
    return F.max(c).over(_frame(-n, -1, calendar))


def trend_delta(c: str | Column, near: int = 7, far: int = 30, calendar: bool = False) -> Column:
    """Mean of the last ``near`` rows less the mean of the rows before those, back to ``far``."""
    earlier = F.avg(c).over(_frame(-far, -near - 1, calendar))
    return rolling_mean(c, near, calendar) - earlier


def lag(c: str | Column, n: int) -> Column:
    return F.lag(c, n).over(place_window())


def lags(c: str, steps: Sequence[int], stem: str) -> dict[str, Column]:
    return {f"{stem}_lag_{n}d": lag(c, n) for n in steps}


def forward_mean(c: str | Column, n: int, calendar: bool = False) -> Column:
    """Mean of the current row and the n-1 that follow."""
    return F.avg(c).over(_frame(0, n - 1, calendar))
