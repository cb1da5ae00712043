"""Mixed-format date parsing."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from trustkpi.functions.text import as_column

# The first and last moment a nanosecond timestamp covers.
_FIRST, _LAST = "1677-09-21 00:12:43.145225", "2262-04-11 23:47:16.854775"
_YEAR = r"(\d{4})"
_TIME = r"([ T]\d{1,2}:\d{2}(:\d{2}(\.\d{1,9})?)?)?"
_HALF_DAY = r" \d{1,2}:\d{2}(:\d{2})? [AaPp][Mm]"
_OPTIONAL_TIME = "[ H:mm[:ss][.SSSSSSSSS][.SSSSSS][.SSS]]"

# Fixed values: (shape of the text, patterns to try in order). One shape test
# picks the patterns, so a value is not thrown at a dozen failing parsers.
DATE_SHAPES = [
    (rf"^{_YEAR}-\d{{1,2}}-\d{{1,2}}{_TIME}$", ["yyyy-M-d" + _OPTIONAL_TIME]),
    (rf"^{_YEAR}/\d{{1,2}}/\d{{1,2}}{_TIME}$", ["yyyy/M/d" + _OPTIONAL_TIME]),
    (rf"^\d{{1,2}}/\d{{1,2}}/{_YEAR}{_TIME}$", ["M/d/yyyy" + _OPTIONAL_TIME, "d/M/yyyy" + _OPTIONAL_TIME]),
    (rf"^\d{{1,2}}-\d{{1,2}}-{_YEAR}{_TIME}$", ["M-d-yyyy" + _OPTIONAL_TIME, "d-M-yyyy" + _OPTIONAL_TIME]),
    (rf"^\d{{1,2}}\.\d{{1,2}}\.{_YEAR}{_TIME}$", ["M.d.yyyy" + _OPTIONAL_TIME, "d.M.yyyy" + _OPTIONAL_TIME]),
    (rf"^{_YEAR}\.\d{{1,2}}\.\d{{1,2}}{_TIME}$", ["yyyy.M.d" + _OPTIONAL_TIME]),
    (rf"^{_YEAR}-\d{{1,2}}-\d{{1,2}}{_HALF_DAY}$", ["yyyy-M-d h:mm[:ss] a"]),
    (rf"^\d{{1,2}}/\d{{1,2}}/{_YEAR}{_HALF_DAY}$", ["M/d/yyyy h:mm[:ss] a", "d/M/yyyy h:mm[:ss] a"]),
    (rf"^\d{{1,2}}/\d{{1,2}}/\d{{2}}$", ["M/d/yy", "d/M/yy"]),
    (rf"^\d{{1,2}}-\d{{1,2}}-\d{{2}}$", ["M-d-yy", "d-M-yy"]),
    (rf"^\d{{1,2}}\.\d{{1,2}}\.\d{{2}}$", ["M.d.yy", "d.M.yy"]),
    (rf"^[A-Za-z]{{3}} \d{{1,2}},? {_YEAR}{_TIME}$", ["MMM d[,] yyyy" + _OPTIONAL_TIME]),
    (rf"^[A-Za-z]{{4,9}} \d{{1,2}},? {_YEAR}{_TIME}$", ["MMMM d[,] yyyy" + _OPTIONAL_TIME]),
    (rf"^\d{{1,2}} [A-Za-z]{{3}} {_YEAR}{_TIME}$", ["d MMM yyyy" + _OPTIONAL_TIME]),
    (rf"^\d{{1,2}} [A-Za-z]{{4,9}} {_YEAR}{_TIME}$", ["d MMMM yyyy" + _OPTIONAL_TIME]),
    (rf"^{_YEAR} [A-Za-z]{{3}} \d{{1,2}}$", ["yyyy MMM d"]),
    (rf"^\d{{1,2}}-[A-Za-z]{{3}}-{_YEAR}$", ["d-MMM-yyyy"]),
    (rf"^\d{{1,2}}-[A-Za-z]{{3}}-\d{{2}}$", ["d-MMM-yy"]),
    (rf"^\d{{1,2}}/{_YEAR}$", ["M/yyyy"]),
    (rf"^{_YEAR}\d{{4}}[ T]\d{{6}}$", ["yyyyMMdd HHmmss"]),
    (rf"^[A-Za-z]{{3}} {_YEAR}$", ["MMM yyyy"]),
    (rf"^[A-Za-z]{{4,9}} {_YEAR}$", ["MMMM yyyy"]),
    (rf"^{_YEAR}\d{{4}}$", ["yyyyMMdd"]),
    (rf"^{_YEAR}-\d{{1,2}}$", ["yyyy-M"]),
    (rf"^{_YEAR}$", ["yyyy"]),
]
_ZONED = rf"^{_YEAR}-\d{{2}}-\d{{2}}[ T]\d{{2}}:\d{{2}}(:\d{{2}}(\.\d{{1,9}})?)?(Z|[+-]\d{{2}}:?\d{{2}})$"
_WEEKDAY = r"(?i)^(mon|tue|wed|thu|fri|sat|sun)[a-z]*,? +"
_QUARTER = rf"^{_YEAR}[- ]?[Qq]([1-4])$"


def _test(pattern: str) -> str:
    """The pattern without captures, which every search would have to reset."""
    return re.sub(r"(?<!\\)\((?!\?)", "(?:", pattern)


_ANY_SHAPE = _test("|".join([*(shape for shape, _ in DATE_SHAPES), _ZONED, _QUARTER]))


def parse_date(c: Column | str) -> Column:
    """Timestamp from text in any known format, month first where ambiguous, else NULL.

    Two-digit years from 69 on lie in the 1900s.
    """
    raw = F.regexp_replace(F.regexp_replace(F.trim(as_column(c)), _WEEKDAY, ""), r"(?i)\bsept\b", "Sep")
    first, last = (F.lit(t).cast("timestamp") for t in (_FIRST, _LAST))
    # As an array's only element the text is made ready once for all shapes, and the long expression is evaluated once.
    return F.get(F.filter(F.transform(F.array(raw), _parsed), lambda x: x.between(first, last)), F.lit(0))


def _parsed(raw: Column) -> Column:
    text = F.regexp_replace(raw, r"(?<=\d)T(?=\d)", " ")
    parsed = F.when(raw.rlike(_test(_ZONED)), raw.try_cast("timestamp"))
    for shape, patterns in DATE_SHAPES:
        subject = text if "[ T]" in shape else raw
        attempts = [F.try_to_timestamp(subject, F.lit(p)) for p in patterns]
        value = F.coalesce(*attempts)
        if "yy" in patterns[0] and "yyyy" not in patterns[0]:
            late = F.year(value) >= 2069
            value = F.when(late, value - F.expr("INTERVAL 100 YEAR")).otherwise(value)
        parsed = parsed.when(raw.rlike(_test(shape)), value)
    quarter = F.try_to_timestamp(
        F.concat_ws(
            "-",
            F.regexp_extract(raw, _QUARTER, 1),
            (F.regexp_extract(raw, _QUARTER, 2).try_cast("int") * 3 - 2).cast("string"),
        ),
        F.lit("yyyy-M"),
    )
    parsed = parsed.when(raw.rlike(_test(_QUARTER)), quarter)
    # One test turns away everything that has no date shape at all.
    return F.when(raw.rlike(_ANY_SHAPE), parsed)
