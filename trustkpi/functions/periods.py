"""Calendar periods as dense integers.

Each period kind maps a timestamp to a whole number that grows by one per
period, and maps the number back to the label. "Previous period" is then
``index - 1`` and the number of periods is ``max - min + 1``.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# Remainder (days since 1970-01-01, modulo 7) of the last day of
# a week that ends on the named day.
_WEEK_END = {"SUN": 3, "MON": 4, "TUE": 5, "WED": 6, "THU": 0, "FRI": 1, "SAT": 2}
# Period names with their base and label side.
_MONTHLIKE = {
    "M": ("month", "end"), "ME": ("month", "end"), "MS": ("month", "start"),
    "Q": ("quarter", "end"), "QE": ("quarter", "end"), "QS": ("quarter", "start"),
    "Y": ("year", "end"), "A": ("year", "end"), "YE": ("year", "end"), "YS": ("year", "start"), "AS": ("year", "start"),
}
_MONTHS = {"month": 1, "quarter": 3, "year": 12}
_NAMES = "JAN FEB MAR APR MAY JUN JUL AUG SEP OCT NOV DEC".split()
_SECONDS = {"h": 3600, "H": 3600, "min": 60, "T": 60, "s": 1, "S": 1}


@dataclass(frozen=True)
class Period:
    """``anchor`` is the seconds of a unit, the remainder of a week's last day, or the first month's place in a year."""

    base: str
    multiple: int = 1
    anchor: int = 0
    side: str = "start"

    @property
    def rebins(self) -> bool:
        """Bins of several units are counted from the first unit of the series."""
        return self.multiple > 1

    @property
    def sub_day(self) -> bool:
        return self.base == "seconds"

    def index(self, ts: Column) -> Column:
        """Fine index, before any multiple is applied."""
        if self.base == "seconds":
            return F.floor(F.unix_seconds(ts.cast("timestamp")) / self.anchor).cast("bigint")
        day = F.unix_date(F.to_date(ts)).cast("bigint")
        if self.base == "day":
            return day
        if self.base == "week":
            return -F.floor((F.lit(self.anchor) - day) / 7).cast("bigint")
        if self.base == "workday":
            # Weeks from Monday; a weekend counts to its Friday.
            since = day + 3
            return (F.floor(since / 7) * 5 + F.least(F.pmod(since, F.lit(7)), F.lit(4))).cast("bigint")
        months = F.year(ts).cast("bigint") * 12 + F.month(ts) - 1 - self.anchor
        return F.floor(months / _MONTHS[self.base]).cast("bigint")

    def origin(self, first_index: Column) -> Column:
        """Fine index at which the first bin starts, or ends where labels are ends."""
        if self.base == "seconds":
            per_day = 86400 // self.anchor
            return (F.floor(first_index / per_day) * per_day).cast("bigint")
        return first_index

    def bin(self, index: Column, origin: Column) -> Column:
        """Fine index that labels the bin of ``index``: its first one, or its last where labels are ends."""
        steps = (index - origin) / self.multiple
        whole = F.ceil(steps) if self.side == "end" else F.floor(steps)
        return (origin + whole * self.multiple).cast("bigint")

    def label(self, index: Column) -> Column:
        """Label of a fine index."""
        if self.base == "seconds":
            return F.timestamp_seconds(index * self.anchor)
        if self.base == "day":
            return F.date_from_unix_date(index.cast("int"))
        if self.base == "week":
            return F.date_from_unix_date((index * 7 + self.anchor).cast("int"))
        if self.base == "workday":
            return F.date_from_unix_date((F.floor(index / 5) * 7 + F.pmod(index, F.lit(5)) - 3).cast("int"))
        step = _MONTHS[self.base]
        # Month arithmetic counts from year 0.
        first = index * step + self.anchor + (0 if self.side == "start" else step - 1)
        month_start = F.make_date(
            F.floor(first / 12).cast("int"), (F.pmod(first, F.lit(12)) + 1).cast("int"), F.lit(1)
        )
        return month_start if self.side == "start" else F.last_day(month_start)


def period(freq: str) -> Period:
    """Parse ``D``, ``B``, ``W``, ``W-MON``, ``ME``, ``MS``, ``QE-OCT``, ``YS-JUL``, ``h`` … with a number before it.

    A quarter or year is anchored at its last month where labels are ends, at its first where they are starts.
    Bins of several units start with the first unit of the series; where labels are ends, that unit ends the first bin.
    """
    match = re.fullmatch(r"(\d*)([A-Za-z]+)(?:-([A-Z]{3}))?", freq.strip())
    if not match:
        raise ValueError(f"Unknown period: {freq}")
    multiple, name, suffix = int(match[1] or 1), match[2], match[3]
    if multiple < 1:
        raise ValueError(f"Unknown period: {freq}")
    if name in ("D", "d") and not suffix:
        return Period("day", multiple)
    if name == "B" and not suffix:
        return Period("workday", multiple)
    if name in _SECONDS and not suffix:
        return Period("seconds", multiple, _SECONDS[name])
    if name == "W" and (suffix or "SUN") in _WEEK_END:
        return Period("week", multiple, _WEEK_END[suffix or "SUN"], "end")
    if name in _MONTHLIKE:
        base, side = _MONTHLIKE[name]
        if not suffix:
            return Period(base, multiple, 0, side)
        if base != "month" and suffix in _NAMES:
            place = _NAMES.index(suffix) + (1 if side == "end" else 0)
            return Period(base, multiple, place % _MONTHS[base], side)
    raise ValueError(f"Unknown period: {freq}")
