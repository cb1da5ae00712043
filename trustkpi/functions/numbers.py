"""Loose numeric parsing and numeric shape tests."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from trustkpi.functions.text import SPACE, as_column

_INTEGER = r"^\s*[+-]?[0-9]+\s*$"
_PLAIN = r"^-?[0-9]{1,15}(\.[0-9]{1,15})?$"
_NUMBER = r"(?i)^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)(e[+-]?[0-9]+)?\s*$"
_PARENTHESES = rf"^{SPACE}*\((.*)\){SPACE}*$"
_OTHER = r"^(?![+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$).*$"


def parse_number(c: Column | str) -> Column:
    """Number in loosely written text, else NULL: ``$1,234.50``, ``(12)``, ``10%``.

    Text too large for a double is missing. Unreadable text is recognised before
    the cast, because a failing cast is far slower than a pattern.
    """
    c = as_column(c)
    digits = F.regexp_replace(F.regexp_replace(c, _PARENTHESES, "-$1"), r"[^0-9.+eE\-]", "")
    loose = F.regexp_replace(digits, _OTHER, "NaN").try_cast("double")
    # NaN sorts above infinity, so one comparison turns both away.
    finite = F.when(F.abs(loose) < F.lit(float("inf")), loose)
    return F.when(c.rlike(_PLAIN), c.try_cast("double")).when(c.rlike("[0-9]"), finite)


def integer_text(c: Column | str) -> Column:
    """A whole number of any length in one spelling: no plus sign, no leading zeros, no minus zero."""
    bare = F.regexp_replace(as_column(c), r"^\+?(-?)0*(?=[0-9])", "$1")
    return F.when(bare == "-0", "0").otherwise(bare)


def looks_integer(c: Column | str) -> Column:
    return as_column(c).rlike(_INTEGER)


def looks_number(c: Column | str) -> Column:
    return as_column(c).rlike(_NUMBER)


def looks_boolean(c: Column | str) -> Column:
    return F.lower(as_column(c)).isin("true", "false")
