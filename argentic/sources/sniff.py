"""Formats by content, never by name."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: First bytes of each format, and the brands of HEIF images.
MAGIC = (("jpeg", "FFD8FF"), ("png", "89504E470D0A1A0A"), ("gif", "474946383761"), ("gif", "474946383961"))
BRANDS = ("heic", "heix", "heim", "heis", "hevc", "hevm", "hevs", "mif1")
MIME = {"jpeg": "image/jpeg", "png": "image/png", "gif": "image/gif", "heic": "image/heic"}
SNIFF_BYTES = 16


def sniff(content: Column) -> Column:
    """jpeg, png, gif, heic, or null for what is no image."""
    head = F.hex(F.substring(content, 1, SNIFF_BYTES))
    brand = head.rlike("^.{8}66747970(" + "|".join(b.encode().hex().upper() for b in BRANDS) + ")")
    tests = [*((name, head.startswith(magic)) for name, magic in MAGIC), ("heic", brand)]
    return reduce(lambda out, t: F.when(t[1], F.lit(t[0])).otherwise(out), reversed(tests), F.lit(None).cast("string"))


def mime(format_: Column) -> Column:
    return F.create_map(*(F.lit(x) for kv in MIME.items() for x in kv))[format_]


def state(format_: Column, error: Column) -> Column:
    """(state, reason): HEIC has no preview, an error that starts with "unsupported" neither; other errors fail."""
    name = F.when(format_ == "heic", "nopreview").when(error.isNull(), "ok").when(error.startswith("unsupported"), "nopreview").otherwise("failed")
    reason = F.when(format_ == "heic", "HEVC").when(error.startswith("unsupported"), "unsupported").otherwise(error)
    return F.struct(name.alias("state"), reason.alias("reason"))
