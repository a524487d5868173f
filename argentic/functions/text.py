"""Texts of a photo: names, dates, sizes and camera values, as Catalyst expressions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def unsigned_hex(x: Column) -> Column:
    """A 64-bit number as 16 hex digits; their order is the unsigned order."""
    return F.lpad(F.lower(F.hex(x)), 16, "0")


def parse_hex(x: Column) -> Column:
    """The number of up to 16 hex digits; null for anything else."""
    return F.when(x.rlike("^[0-9a-fA-F]{1,16}$"), F.conv(x, 16, -10).cast("long"))


def bytes_of(x: Column) -> Column:
    """UTF-8 bytes of a name, as an array of long; each one is looked up from the start, so this is for short texts."""
    packed = F.hex(x.cast("binary"))
    each = F.transform(F.sequence(F.lit(1), (F.length(packed) / 2).cast("int")), lambda i: F.conv(F.substring(packed, 2 * i - 1, F.lit(2)), 16, 10).cast("long"))
    return F.when(F.length(packed) > 0, each).otherwise(F.array().cast("array<bigint>"))


def fnv1a64(x: Column) -> Column:
    """FNV-1a of the UTF-8 bytes, signed.  Two halves of 32 bits, so that no product overflows under ANSI."""
    low32 = F.lit(0xFFFFFFFF)
    prime = F.lit(435)  # the prime is 2**40 + 435

    def step(s: Column, b: Column) -> Column:
        low = s["lo"].bitwiseXOR(b)
        high = s["hi"] * prime + F.shiftright(low * prime, 32) + F.shiftleft(low.bitwiseAND(F.lit(0xFFFFFF)), 8)
        return F.struct(high.bitwiseAND(low32).alias("hi"), (low * prime).bitwiseAND(low32).alias("lo"))

    start = F.struct(F.lit(0xCBF29CE4).cast("long").alias("hi"), F.lit(0x84222325).cast("long").alias("lo"))
    return F.aggregate(bytes_of(x), start, step, lambda s: F.shiftleft(s["hi"], 32).bitwiseOR(s["lo"]))


def slashes(path: Column) -> Column:
    return F.translate(path, "\\", "/")


def relative(root: str, path: Column) -> Column:
    root = root.rstrip("/") + "/"
    return F.when(path.startswith(root), F.substring(path, F.lit(len(root) + 1), F.length(path))).otherwise(path)


def last_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def display_path(path: Column) -> Column:
    return F.regexp_replace(slashes(path), r"^//\?/", "")


@F.pandas_udf(StringType())
def _fixed(x: pd.Series, digits: pd.Series) -> pd.Series:
    return pd.Series([None if pd.isna(v) else f"{v:.{d}f}" for v, d in zip(x, digits, strict=True)])


def fixed(x: Column, digits: int) -> Column:
    """Decimal text of the exact binary value, halves to even; Java's own rounds its shortest decimal half up."""
    return _fixed(x.cast("double"), F.lit(digits))


def exposure_text(n: Column, d: Column) -> Column:
    ratio = n.cast("double") / F.nullif(d.cast("double"), F.lit(0.0))
    inverse = F.concat(F.lit("1/"), F.floor(d.cast("double") / F.nullif(n.cast("double"), F.lit(0.0)) + 0.5).cast("string"))
    return F.when(n.isNull() | d.isNull(), None).when(d == 0, "-").when(n == 0, "0s").when(d > n, inverse).otherwise(F.concat(fixed(ratio, 1), F.lit("s")))


def aperture_text(n: Column, d: Column) -> Column:
    return F.when(d != 0, F.concat(F.lit("f/"), fixed(n.cast("double") / F.nullif(d.cast("double"), F.lit(0.0)), 1)))


def human_bytes(n: Column, most: str = "TB") -> Column:
    """Steps of 1024 up to the unit ``most``; one decimal below 10, else whole."""
    value, unit = n.cast("double"), F.lit("B")
    names = ("KB", "MB", "GB", "TB")
    for step, name in enumerate(names[: names.index(most) + 1], 1):
        over = n.cast("double") >= float(1024**step)
        value, unit = F.when(over, n / float(1024**step)).otherwise(value), F.when(over, F.lit(name)).otherwise(unit)
    whole = F.floor(value + 0.5).cast("string")
    return F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B"))).otherwise(F.concat_ws(" ", F.when(value < 10, fixed(value, 1)).otherwise(whole), unit))


def camera(make: Column, model: Column) -> Column:
    both = F.when(F.startswith(F.lower(model), F.lower(make)), model).otherwise(F.concat_ws(" ", make, model))
    return F.when(make.isNotNull() & model.isNotNull(), both).otherwise(F.coalesce(model, make))


def epoch_seconds(y: Column, mo: Column, d: Column, h: Column, mi: Column, s: Column) -> Column:
    """Linear calendar: a day past the end of a month is one of the next month."""
    first = F.make_date(y.cast("int"), mo.cast("int"), F.lit(1))
    days = F.datediff(first, F.lit("1970-01-01").cast("date")).cast("long") + d - 1
    return days * 86400 + h * 3600 + mi * 60 + s


def parse_exif_datetime(raw: Column) -> Column:
    """Seconds of ``YYYY:MM:DD hh:mm:ss`` by position; separators may be anything, day 31 is in every month and second 60 in every minute."""
    marks = F.lit(" \t\n\x0b\x0c\r")

    def seconds(text: Column) -> Column:
        fields = F.array(*(F.btrim(F.substring(text, at + 1, n), marks).try_cast("long") for at, n in ((0, 4), (5, 2), (8, 2), (11, 2), (14, 2), (17, 2))))
        return F.when(F.octet_length(text) >= 19, F.get(F.transform(F.array(fields), checked), F.lit(0)))

    def checked(x: Column) -> Column:
        y, mo, d, h, mi, s = (x[i] for i in range(6))
        valid = (y >= 1826) & mo.between(1, 12) & d.between(1, 31) & h.between(0, 23) & mi.between(0, 59) & s.between(0, 60)
        return F.when(valid, epoch_seconds(y, mo, d, h, mi, s))

    # through arrays of one, so that each step is worked out once and the generated code stays small
    return F.get(F.transform(F.array(F.btrim(F.regexp_replace(raw, "\\x00+$", ""), marks)), seconds), F.lit(0))


def day_text(seconds: Column) -> Column:
    return F.date_format(F.date_add(F.lit("1970-01-01").cast("date"), F.floor(seconds / 86400).cast("int")), "yyyy-MM-dd")


def pretty_day(day: Column) -> Column:
    return F.date_format(day.cast("date"), "d MMMM yyyy")


def whole_seconds(micros: Column) -> Column:
    """Toward zero, unlike floor."""
    return F.expr("coalesce({} div 1000000, 0)".format(micros)) if isinstance(micros, str) else F.coalesce((F.signum(micros) * F.floor(F.abs(micros) / 1000000)).cast("long"), F.lit(0))


def degrees(parts: Column, reference: Column, limit: int, negative: str) -> Column:
    """Degrees of (n, d) triples: 0/0 counts nothing, n/0 or a missing reference voids all, as does a value past the limit."""
    scaled = F.zip_with(
        parts,
        F.array(F.lit(1.0), F.lit(60.0), F.lit(3600.0)),
        lambda p, s: F.when(p["d"] != 0, p["n"].cast("double") / F.nullif(p["d"].cast("double"), F.lit(0.0)) / s).when(p["n"] == 0, F.lit(0.0)),
    )
    total = F.aggregate(scaled, F.lit(0.0), lambda a, b: a + b)
    signed = F.when(reference.startswith(negative), -total).otherwise(total)
    return F.when(reference.isNotNull() & (F.abs(signed) <= limit), signed)
