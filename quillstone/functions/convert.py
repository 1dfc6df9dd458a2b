"""Scalar conversions as Columns; bad input gives null, never an error."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the alphabet of the unpadded base-32 form of ids.
BASE32 = "abcdefghijklmnopqrstuvwxyz156789"


def to_text(value: Column) -> Column:
    return value.cast("string")


def to_number(value: Column) -> Column:
    """A double from a trimmed string."""
    text = F.trim(value.cast("string"))
    return F.when(text.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), text.try_cast("double"))


def parse_number(value: Column) -> Column:
    """How a literal reads: struct of `whole` (bigint), `real` (double) and `text`, of which one is set."""
    text = value.cast("string")
    whole = text.try_cast("bigint")
    real = to_number(text)
    return F.struct(
        whole.alias("whole"), F.when(whole.isNull(), real).alias("real"), F.when(whole.isNull() & real.isNull(), text).alias("text")
    )


def to_time(value: Column) -> Column:
    """A timestamp from epoch milliseconds, RFC 3339, ``YYYY-MM-DD`` or ``YYYY-MM``; without a zone in the session's."""
    text = F.trim(value.cast("string"))
    millis = F.when(text.rlike(r"^-?\d{5,}$"), F.timestamp_millis(text.try_cast("bigint")))
    month = F.try_to_timestamp(F.when(text.rlike(r"^\d{4}-\d{2}$"), F.concat(text, F.lit("-01"))))
    whole = F.try_to_timestamp(F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}([T ].*)?$"), text))
    return F.coalesce(millis, whole, month)


def to_bool(value: Column) -> Column:
    """1, t, true, 0, f, false in any case, and numbers other than 0."""
    text = F.lower(F.trim(value.cast("string")))
    number = to_number(text)
    return F.when(text.isin("1", "t", "true"), True).when(text.isin("0", "f", "false"), False).otherwise(number != 0)


def to_bool_strict(value: Column) -> Column:
    """As attribute-value rows read truth: the texts ``true`` and ``1``, and numbers above one half."""
    text = value.cast("string")
    return (text == "true") | F.coalesce(to_number(text) > 0.5, F.lit(False))


def to_uuid(value: Column) -> Column:
    """The canonical lower-case form of a UUID."""
    text = F.lower(F.trim(value.cast("string")))
    bare = F.regexp_replace(F.regexp_replace(text, r"^(urn:uuid:|\{)|\}$", ""), "-", "")
    shaped = F.concat_ws("-", *(F.substring(bare, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))))
    return F.when(bare.rlike("^[0-9a-f]{32}$"), shaped)


def uuid7(millis: Column | None = None, random_hex: Column | None = None) -> Column:
    """A time-ordered UUID (version 7) of epoch milliseconds and 20 or more random hex digits."""
    millis = F.unix_millis(F.current_timestamp()) if millis is None else millis
    noise = F.regexp_replace(F.uuid(), "-", "") if random_hex is None else random_hex
    time = F.lower(F.lpad(F.hex(millis), 12, "0"))
    variant = F.substring(F.lit("89ab"), (F.conv(F.substring(noise, 4, 1), 16, 10).cast("int") % 4 + 1), F.lit(1))
    return F.concat_ws(
        "-", F.substring(time, 1, 8), F.substring(time, 9, 4), F.concat(F.lit("7"), F.substring(noise, 1, 3)),
        F.concat(variant, F.substring(noise, 5, 3)), F.substring(noise, 8, 12),
    )


def _bits(hexed: Column) -> Column:
    """The bits of hex digits."""
    digits = F.split(hexed, "")
    return F.concat_ws("", F.transform(F.filter(digits, lambda d: d != ""), lambda d: F.lpad(F.conv(d, 16, 2), 4, "0")))


def base32_encode(value: Column) -> Column:
    """The base-32 form of binary data; of a text, of its UTF-8."""
    bits = _bits(F.hex(value.cast("binary")))
    padded = F.rpad(bits, (F.ceil(F.length(bits) / 5) * 5).cast("int"), F.lit("0"))
    groups = F.filter(F.split(padded, "(?<=\\G.{5})"), lambda g: g != "")
    return F.concat_ws("", F.transform(groups, lambda g: F.substring(F.lit(BASE32), F.conv(g, 2, 10).cast("int") + 1, F.lit(1))))


def base32_decode(value: Column) -> Column:
    """The binary data of a base-32 form; null if a letter is not in the alphabet."""
    letters = F.filter(F.split(value, ""), lambda c: c != "")
    fives = F.transform(letters, lambda c: F.lpad(F.conv((F.call_function("instr", F.lit(BASE32), c) - 1).cast("string"), 10, 2), 5, "0"))
    bits = F.concat_ws("", fives)
    eights = F.filter(F.split(bits, "(?<=\\G.{8})"), lambda g: F.length(g) == 8)
    data = F.concat_ws("", F.transform(eights, lambda g: F.lpad(F.conv(g, 2, 16), 2, "0")))
    return F.when(value.rlike(f"^[{BASE32}]*$"), F.unhex(data))


def uuid_base32(value: Column) -> Column:
    """The base-32 form of a UUID's 16 bytes."""
    return base32_encode(F.unhex(F.regexp_replace(to_uuid(value), "-", "")))
