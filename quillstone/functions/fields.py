"""Field transformers: a text column to a value and an error, both Columns.

An empty text is null and no error, as long as a transformer does not say otherwise.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Field:
    """What a transformer makes of a column: the value, and a message where it cannot be made."""

    value: Column
    error: Column


Transformer = Callable[[Column], Field]


def _fine(value: Column) -> Field:
    return Field(value, F.lit(None).cast("string"))


def _checked(text: Column, value: Column, kind: str) -> Field:
    """An error where a non-empty text gave no value."""
    bad = (text != "") & value.isNull()
    return Field(F.when(text != "", value), F.when(bad, F.concat(F.lit("invalid "), F.lit(kind), F.lit(": "), text)))


def identity() -> Transformer:
    return _fine


to_string = identity


def _whole(kind: str) -> Transformer:
    def apply(c: Column) -> Field:
        text = F.trim(c)
        return _checked(text, F.when(text.rlike(r"^[+-]?\d+$"), text.try_cast(kind)), kind)

    return apply


def to_int() -> Transformer:
    return _whole("int")


def to_int64() -> Transformer:
    return _whole("bigint")


def _real(text: Column) -> Column:
    return F.when(text.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), text.try_cast("double"))


def to_float64() -> Transformer:
    return lambda c: _checked(F.trim(c), _real(F.trim(c)), "number")


def to_bool() -> Transformer:
    """true, 1, yes, false, 0, no in any case."""

    def apply(c: Column) -> Field:
        text = F.lower(F.trim(c))
        return _checked(text, F.when(text.isin("true", "1", "yes"), True).when(text.isin("false", "0", "no"), False), "truth value")

    return apply


# Parts of reference-time layouts and the patterns that Spark has for them, longer ones first.
_LAYOUT = (
    ("2006", "yyyy"), ("January", "MMMM"), ("Monday", "EEEE"), ("-07:00", "xxx"), ("Z07:00", "XXX"), ("Jan", "MMM"), ("Mon", "EEE"),
    ("01", "MM"), ("02", "dd"), ("15", "HH"), ("03", "hh"), ("04", "mm"), ("05", "ss"), ("PM", "a"), ("MST", "z"), ("06", "yy"),
)


def layout_pattern(layout: str) -> str:
    """The datetime pattern of a layout that shows how 2006-01-02 15:04:05 would be written."""
    out, at = "", 0
    while at < len(layout):
        for part, pattern in _LAYOUT:
            if layout.startswith(part, at):
                out, at = out + pattern, at + len(part)
                break
        else:
            out, at = out + (f"'{layout[at]}'" if layout[at].isalpha() else layout[at]), at + 1
    return out


def _dated(layouts: tuple[str, ...], out: str, kind: str) -> Transformer:
    def apply(c: Column) -> Field:
        text = F.trim(c)
        times = [F.try_to_timestamp(text, F.lit(layout_pattern(one))) for one in layouts]
        return _checked(text, F.date_format(F.coalesce(*times), out), kind)

    return apply


def to_date(layout: str = "2006-01-02") -> Transformer:
    """``YYYY-MM-DD``."""
    return _dated((layout,), "yyyy-MM-dd", "date")


def to_datetime(layout: str) -> Transformer:
    """RFC 3339 in UTC."""
    return _dated((layout,), "yyyy-MM-dd'T'HH:mm:ss'Z'", "time")


def to_datetime_iso8601() -> Transformer:
    """RFC 3339 in UTC from the usual ISO forms."""
    forms = ("2006-01-02T15:04:05Z07:00", "2006-01-02T15:04:05", "2006-01-02T15:04Z07:00", "2006-01-02 15:04:05", "2006-01-02T15:04", "2006-01-02")
    return _dated(forms, "yyyy-MM-dd'T'HH:mm:ss'Z'", "time")


def split(separator: str) -> Transformer:
    """An array of the trimmed parts that are not empty."""

    def apply(c: Column) -> Field:
        parts = F.transform(F.split(c, "\\Q" + separator.replace("\\E", "\\E\\\\E\\Q") + "\\E"), lambda p: F.trim(p))
        return _fine(F.when(F.trim(c) != "", F.filter(parts, lambda p: p != "")))

    return apply


def custom(fn: Callable[[Column], Column], error: Callable[[Column], Column] | None = None) -> Transformer:
    """Any function of columns, a pandas UDF included. `error` gives the message for a text, null where there is none."""

    def apply(c: Column) -> Field:
        if error is None:
            return _fine(fn(c))
        message = error(c)
        return Field(F.when(message.isNull(), fn(c)), message)

    return apply


def enum(*allowed: str) -> Transformer:
    return lambda c: _checked(F.trim(c), F.when(F.trim(c).isin(*allowed), F.trim(c)), "choice")


def default(value: Any, inner: Transformer | None = None) -> Transformer:
    """`value` where the text is empty or null, else what `inner` makes of it."""

    def apply(c: Column) -> Field:
        made = (inner or identity())(c)
        empty = F.coalesce(F.trim(c) == "", F.lit(True))
        return Field(F.when(empty, F.lit(value)).otherwise(made.value), F.when(~empty, made.error))

    apply.takes_empty = True
    return apply


def takes_empty(transformer: Transformer) -> bool:
    """Whether a transformer gives empty texts a value of their own."""
    return getattr(transformer, "takes_empty", False)


def _text(change: Callable[[Column], Column], inner: Transformer | None = None) -> Transformer:
    inner = inner or identity()

    def apply(c: Column) -> Field:
        return inner(change(F.trim(c)))

    apply.takes_empty = takes_empty(inner)
    return apply


def trim(inner: Transformer | None = None) -> Transformer:
    return _text(lambda c: c, inner)


def to_lower() -> Transformer:
    return _text(F.lower)


def to_upper() -> Transformer:
    return _text(F.upper)


def to_price() -> Transformer:
    """A number without currency signs and thousands separators; null for prices on request and for a sign alone."""

    def apply(c: Column) -> Field:
        text = F.trim(c)
        asked = F.lower(text).contains("request") | F.lower(text).contains("price on")
        bare = F.trim(F.regexp_replace(text, "[$€£¥,]", ""))
        value = F.when(~asked, _real(bare))
        return Field(value, F.when((bare != "") & ~asked & value.isNull(), F.concat(F.lit("invalid price: "), text)))

    return apply


def to_year() -> Transformer:
    """The year before the first blank or bracket; null if unknown, an error outside 1900 to 2100."""

    def apply(c: Column) -> Field:
        text = F.trim(c)
        year = F.when(F.lower(text) != "unknown", F.trim(F.regexp_extract(text, r"^([^ (]*)", 1)))
        number = year.rlike(r"^[+-]?\d+$")
        fits = F.coalesce(F.when(number, year.try_cast("bigint")).between(1900, 2100), F.lit(False))
        return Field(F.when(fits, year.try_cast("int")), F.when(number & ~fits, F.concat(F.lit("year out of range: "), text)))

    return apply


def is_year_approximate() -> Transformer:
    def apply(c: Column) -> Field:
        text = F.lower(F.trim(c))
        known = (text != "") & (text != "unknown")
        return _fine(F.when(known, text.contains("approx") | text.contains("circa") | text.contains("~")))

    return apply


def _measure(place: int) -> Transformer:
    def apply(c: Column) -> Field:
        parts = F.split(F.trim(F.replace(F.trim(c), F.lit("mm"), F.lit(""))), "x")
        return _fine(_real(F.trim(F.get(parts, F.lit(place)))))

    return apply


def to_size_width() -> Transformer:
    """42 of ``42 mm`` and of ``42 x 54 mm``."""
    return _measure(0)


def to_size_height() -> Transformer:
    """54 of ``42 x 54 mm``; null for one dimension."""
    return _measure(1)


def first_error(fields: list[tuple[str, str, Column, Field]]) -> Column:
    """The first error of (column, path, source, field) as struct<column, path, value, reason>."""
    parts = [
        F.when(f.error.isNotNull(), F.struct(F.lit(c).alias("column"), F.lit(p).alias("path"), s.alias("value"), f.error.alias("reason")))
        for c, p, s, f in fields
    ]
    return reduce(lambda a, b: F.coalesce(a, b), parts)
