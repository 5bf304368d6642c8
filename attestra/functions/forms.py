"""Columns that bring one value written in several ways to one form.

All of these are built-in expressions. Each is a straight chain of replacements, where a pattern
that does not match changes nothing, so the generated code stays small and no value is computed
twice.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Ways to say that there is no value, after trimming, in any case.
NO_VALUE = ("none", "null", "nan", "nat", "na", "n/a", "nil", "-", "--", "unset", "unknown", "undefined")

#: Outer white space, with no-break spaces, zero-width space and byte order mark.
BLANKS = " \t\r\n\x0b\x0c\u00a0\u2007\u202f\ufeff\u200b"

_MONTH = r"(?:(?i:(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec))[a-z]*\.?)"


def _chain(c: Column, steps: list[tuple[str, str]]) -> Column:
    return reduce(lambda x, step: F.regexp_replace(x, *step), steps, c)


def trimmed(c: Column) -> Column:
    """Without outer white space of any kind, zero-width marks and no-break spaces included."""
    return F.btrim(c, F.lit(BLANKS))


def present(c: Column) -> Column:
    """The trimmed text, or null where it says that there is no value."""
    words = "|".join(NO_VALUE)
    return F.nullif(F.regexp_replace(trimmed(c), f"(?i)^(?:{words})$", ""), F.lit(""))


def notebook_file(c: Column) -> Column:
    """File name of a notebook path: outer spaces, folder and extension aside. Blank is null."""
    return F.nullif(_chain(trimmed(c), [(r"^.*[/\\]", ""), (r"(?<=.)\.[A-Za-z][A-Za-z0-9]{0,9}$", "")]), F.lit(""))


_DAY_STEPS = [
    (r"^(\d{4})([-/.])(\d{1,2})\2(\d{1,2})(?:[T\s].*|[Zz])?$", "$1-$3-$4"),
    (r"^(\d{4})(\d{2})(\d{2})(?:[T\s].*)?$", "$1-$2-$3"),
    (r"^(\d{4})[-/.](\d{1,2})$", "$1-$2-1"),
    (rf"^(?:[A-Za-z]+,?\s+)?(\d{{1,2}})(?:st|nd|rd|th)?[\s-]+{_MONTH},?[\s-]+(\d{{4}})(?!\d).*$", "$3-$2-$1"),
    (rf"^{_MONTH}\s+(\d{{1,2}})(?:st|nd|rd|th)?,?\s+(\d{{4}})(?!\d).*$", "$3-$1-$2"),
    (rf"^{_MONTH},?[\s-]+(\d{{4}})$", "$2-$1-1"),
    (r"^(\d{1,2})\.(\d{1,2})\.(\d{4})(?:[T\s].*)?$", "$3-$2-$1"),
]


def written_day(c: Column) -> Column:
    """The day that a text names, as ``YYYY-MM-DD``; null where it names none.

    A month alone is its first day. Time of day and zone are left aside: it is the day as
    written. Understood are ``Y-M-D`` with any of ``- / .`` or nothing between, ``Y-M``,
    ``D Mon Y``, ``Mon D, Y``, ``Mon Y``, ``D.M.Y``, and epoch seconds or milliseconds (UTC).
    Days that no calendar has are null.
    """
    plain = c.rlike(r"^\d{4}-\d\d-\d\d$")
    text = _chain(trimmed(c), _DAY_STEPS)
    epoch = F.date_from_unix_date((F.try_divide(F.substring(text, 1, 10).try_cast("bigint"), F.lit(86400))).cast("int"))
    named = F.try_to_timestamp(F.initcap(text), F.lit("yyyy-MMM-d")).cast("date")
    day = F.when(text.rlike(r"^\d{10}(\d{3})?$"), epoch).when(text.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), text.try_cast("date")).when(text.rlike(r"^\d{4}-[A-Za-z]"), named)
    return F.when(plain & c.try_cast("date").isNotNull(), c).otherwise(F.date_format(day, "yyyy-MM-dd"))


_INSTANT_STEPS = [
    (r"(?i) *(?:UTC|GMT|UT)$", "Z"),
    (r"(\d) ([+-]\d{2}:?\d{0,2})$", "$1$2"),
    (r"^(\d{4}-\d{1,2}-\d{1,2})$", "$1T00:00Z"),
    (r"^(\d{4}-\d{1,2}-\d{1,2}[T ][\d:.]+)$", "$1Z"),
    (r"(:\d{2}(?:\.\d+)?[+-]\d{2})(\d{2})$", "$1:$2"),
]


def instant(c: Column) -> Column:
    """Microseconds since 1970 (UTC) of a written time; null where it can't be read.

    Without a zone the time is UTC, whatever the zone of the session. Understood are ISO 8601,
    RFC 1123, a day alone, and epoch seconds or milliseconds.
    """
    iso = _chain(trimmed(c), _INSTANT_STEPS)
    named = F.try_to_timestamp(
        _chain(trimmed(c), [(r"^[A-Za-z]+,\s*", ""), (r"^(\d{1,2}) ([A-Za-z]{3})[a-z]* (\d{4})$", "$1 $2 $3 00:00:00"), (r"(?i)(:\d\d) *(?:GMT|UTC|UT|Z)?$", "$1 +0000"), (r"([+-]\d\d):(\d\d)$", "$1$2")]),
        F.lit("d MMM yyyy HH:mm:ss Z"),
    )
    first, number = F.substring(c, 1, 1), trimmed(c).try_cast("bigint")
    return (
        F.when(c.rlike(r"^\s*\d{13}\s*$"), number * 1000)
        .when(c.rlike(r"^\s*\d{9,10}\s*$"), number * 1000000)
        .when(c.rlike(r"^\s*\d{4}-"), F.unix_micros(iso.try_cast("timestamp")))
        .when(first.isNotNull(), F.unix_micros(named))
    )


def is_number(c: Column) -> Column:
    """Neither null nor NaN."""
    return c.isNotNull() & ~F.isnan(c)
