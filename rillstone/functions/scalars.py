"""Scalar functions whose results differ from Spark's own of the same name. All are Columns that stay in the JVM."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters of date patterns that Spark formats itself.
DATE_LETTERS = "GyMLdDEaHkKhmsSzZXVOn"


def divide(a: Column, b: Column, scale: int = 0, other_scale: int = 0) -> Column:
    """Quotient with the scale of ``a``, halves rounded away from zero: 7 / 2 is 4, 1 / 3 is 0, 7.0 / 2 is 3.5.

    ``scale`` and ``other_scale`` are the decimal places of the two; whole numbers have 0 and give a whole number.
    """
    if not scale and not other_scale:
        size = 2 * F.abs(b)
        exact = F.call_function("div", 2 * F.abs(a) + F.abs(b), size)
        return F.when((a < 0) != (b < 0), -exact).otherwise(exact)
    whole = lambda x, places: (x.cast(f"decimal(28,{places})") * F.lit(10**places).cast("decimal(10,0)")).cast("decimal(28,0)")
    quotient = divide(whole(a, scale) * F.lit(10**other_scale).cast("decimal(9,0)"), whole(b, other_scale))
    return (quotient.cast("decimal(28,0)") / F.lit(10**scale).cast("decimal(10,0)")).cast(f"decimal(28,{scale})")


def divide_double(a: Column, b: Column) -> Column:
    """Quotient of doubles, rounded as ``divide`` to the decimal places that ``a`` shows; exact as far as doubles are."""
    shown = F.split(F.upper(a.cast("string")), "E")
    places = F.length(F.regexp_extract(shown[0], r"\.([0-9]*)$", 1)) - F.coalesce(F.get(shown, F.lit(1)).try_cast("int"), F.lit(0))
    step = F.pow(F.lit(10.0), places)
    return F.signum(a) * F.signum(b) * F.floor(F.abs(a) / F.abs(b) * step + 0.5) / step


def modulo(a: Column, b: Column) -> Column:
    """Remainder of both cut to whole numbers; it has the sign of ``a``."""
    return a.cast("long") % b.cast("long")


def differs(a: Column, b: Column) -> Column:
    """Not equal, where null differs from every value."""
    return ~a.eqNullSafe(b)


def negated(condition: Column) -> Column:
    """True unless the condition is true; null counts as not true."""
    return ~F.coalesce(condition, F.lit(False))


def same(a: Column, b: Column, kind: str, other: str | None = None) -> Column:
    """``a = b`` by the rule of the left side, whose kind is text, number or boolean; null is never equal.

    Text equals any value that has the same text, a number only a number, a boolean whatever is as true as it is.
    """
    if kind == "text":
        return F.coalesce(a == b.cast("string"), F.lit(False))
    if kind == "number":
        return F.coalesce(a == b, F.lit(False)) if (other or kind) == "number" else F.lit(False)
    true = b if (other or kind) == "boolean" else b.cast("string") == "true" if other == "text" else F.lit(False)
    return F.coalesce(a == F.coalesce(true, F.lit(False)), F.lit(False))


def within(a: Column, items: list[Column] | Column, kind: str = "text") -> Column:
    """``a`` equals one of the items, which may be columns; a single item is equality."""
    found = F.lit(False)
    for item in items if isinstance(items, list) else [items]:
        found = found | same(a, item, kind)
    return found


def list_contains(items: Column, value: Column) -> Column:
    """One of the items has the text of the value."""
    return F.coalesce(F.exists(items, lambda x: F.coalesce(x.cast("string") == value.cast("string"), F.lit(False))), F.lit(False))


def matches(text: Column, pattern: str) -> Column:
    """The pattern matches the whole text, a line end included; null does not."""
    return F.coalesce(text.rlike(rf"\A(?:{pattern})\z"), F.lit(False))


def length(value: Column) -> Column:
    """Length of a value's text in UTF-16 units: characters beyond the basic plane count two."""
    text = value.cast("string")
    return (F.length(text) + F.regexp_count(text, F.lit(r"[\x{10000}-\x{10FFFF}]"))).cast("long")


def substring(text: Column, start: int, end: int | None = None) -> Column:
    """Characters from ``start`` (from 0) up to but not including ``end``; without an end, a start past the text is an error."""
    if end is not None:
        return F.substring(text, start + 1, max(end - start, 0))
    return F.when(F.length(text) < start, F.raise_error(F.lit(f"substring starts at {start}, past the end"))).otherwise(F.substring(text, start + 1, 2**31 - 1 - start))


def joined(items: Column, separator: str) -> Column:
    """Items as text with a separator; a null item shows as <Null>."""
    return F.array_join(F.transform(items, lambda x: F.coalesce(x.cast("string"), F.lit("<Null>"))), separator)


def instant(millis: Column, zone: str = "UTC") -> Column:
    """Zoneless local time of epoch milliseconds."""
    utc = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(secs=(millis.cast("decimal(20,3)") / 1000).cast("decimal(18,6)"))
    return utc if zone == "UTC" else F.convert_timezone(F.lit("UTC"), F.lit(zone), utc)


def _date_field(at: Column, letter: str) -> Column:
    """The fields that Spark has no letter for (or another meaning)."""
    if letter == "F":
        return F.ceil(F.dayofmonth(at) / 7)
    if letter == "u":
        return F.weekday(at) + 1
    sunday = F.date_sub(at.cast("date"), F.dayofweek(at) - 1)
    if letter == "w":
        new_year = F.trunc(F.date_add(sunday, 6), "year")
        first = F.date_sub(new_year, F.dayofweek(new_year) - 1)
    else:
        month = F.trunc(at.cast("date"), "month")
        first = F.date_sub(month, F.dayofweek(month) - 1)
    return F.floor(F.datediff(sunday, first) / 7) + 1


def format_date(millis: Column, pattern: str = "yyyy-MM-dd HH:mm:ss", zone: str = "UTC") -> Column:
    """Local time as text.

    F is which one of its weekday in the month a day is, w and W the week of the year and month (weeks start on Sunday, the
    first holds the first day), u the number of the weekday from Monday; the rest are Spark's. Other letters are an error.
    """
    at, parts, plain = instant(millis, zone), [], ""
    for piece in (m[0] for m in re.finditer(r"'(?:[^']|'')*'|([A-Za-z])\1*|[^A-Za-z']+", pattern)):
        if piece[0] in "FwWu":
            parts += [F.date_format(at, plain)] if plain else []
            number = _date_field(at, piece[0]).cast("string")
            parts, plain = parts + [F.when(F.length(number) >= len(piece), number).otherwise(F.lpad(number, len(piece), "0"))], ""
        elif piece[0].isalpha() and piece[0] not in DATE_LETTERS:
            raise ValueError(f"date pattern letter {piece[0]!r} is not known")
        else:
            plain += piece
    parts += [F.date_format(at, plain)] if plain else []
    return parts[0] if len(parts) == 1 else F.concat(*parts) if parts else F.lit("")


def day(millis: Column) -> Column:
    """Which one of its weekday in the month it is, as text: the 23rd is the fourth Thursday."""
    return format_date(millis, "F")


def week(millis: Column) -> Column:
    """Week of the year as text: weeks start on Sunday, and the one that holds January 1 is the first of its year."""
    return format_date(millis, "w")


def month(millis: Column) -> Column:
    """Two digits."""
    return format_date(millis, "MM")


def year(millis: Column) -> Column:
    """Four digits."""
    return format_date(millis, "yyyy")


def hour(millis: Column) -> Column:
    """Two digits, from 00."""
    return format_date(millis, "HH")
