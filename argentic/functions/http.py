"""Pure parts of the catalogue's HTTP interface, as Catalyst expressions."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .text import unsigned_hex

#: Status texts.
STATUS = {
    200: "OK", 206: "Partial Content", 304: "Not Modified", 400: "Bad Request", 404: "Not Found", 405: "Method Not Allowed",
    413: "Payload Too Large", 414: "URI Too Long", 416: "Range Not Satisfiable", 500: "Internal Server Error", 503: "Service Unavailable",
}


def status_text(code: Column) -> Column:
    return F.coalesce(F.create_map(*(F.lit(x) for kv in STATUS.items() for x in kv))[code], F.lit("Unknown"))


def etag(id_: Column, mtime: Column, size: Column) -> Column:
    return F.concat(F.lit('"'), unsigned_hex(id_), F.lit("-"), F.lower(F.hex(mtime)), F.lit("-"), F.lower(F.hex(size)), F.lit('"'))


def etag_matches(header: Column, tag: Column) -> Column:
    return F.coalesce(F.array_contains(F.transform(F.split(header, ","), lambda x: F.trim(x)), tag), F.lit(False))


def byte_range(header: Column, total: Column) -> Column:
    """(kind, start, end): 'all' for none or several ranges, 'bad' for one out of reach, 'part' else."""
    spec = F.trim(F.substring(header, F.lit(7), F.length(header)))
    plain = header.startswith("bytes=") & ~spec.contains(",") & (total > 0) & spec.contains("-")
    first = F.trim(F.substring_index(spec, "-", 1))
    second = F.trim(F.substring(spec, F.locate("-", spec) + 1, F.length(spec)))
    number = lambda x: F.when(x.rlike(r"^\+?\d+$"), x.try_cast("long"))
    raw_first = F.substring_index(spec, "-", 1)
    a, b = number(first), number(second)
    tail = raw_first == ""
    start = F.when(tail, F.greatest(total - b, F.lit(0))).otherwise(a)
    end = F.when(tail | (second == ""), total - 1).otherwise(F.least(b, total - 1))
    known = F.coalesce(plain, F.lit(False)) & F.when(tail, b.isNotNull()).otherwise(a.isNotNull() & ((second == "") | b.isNotNull()))
    bad = F.when(tail, b == 0).otherwise((start > end) | (start >= total))
    kind = F.when(~F.coalesce(known, F.lit(False)), "all").when(bad, "bad").otherwise("part")
    return F.struct(kind.alias("kind"), F.when(kind == "part", start).alias("start"), F.when(kind == "part", end).alias("end"))


def is_routable(ip: Column) -> Column:
    """Whether others can reach this IPv4 address: not none, loopback, link-local or broadcast."""
    return ~(ip.isin("0.0.0.0", "255.255.255.255") | ip.startswith("127.") | ip.startswith("169.254."))


def is_local_peer(peer: Column, own: Column) -> Column:
    """Whether a request comes from this machine: loopback, or its own IPv4 address; no peer is not."""
    v6 = peer.contains(":")
    return F.coalesce(F.when(v6, peer == "::1").otherwise(peer.startswith("127.") | F.coalesce(peer == own, F.lit(False))), F.lit(False))


_ESCAPE = re.compile(rb"%([0-9a-fA-F]{2})")


@F.pandas_udf(StringType())
def percent_decode(x: pd.Series) -> pd.Series:
    """Escapes become bytes, broken ones stay, and bytes that are no UTF-8 become the replacement character."""

    def one(s):
        return None if s is None else _ESCAPE.sub(lambda m: bytes([int(m[1], 16)]), s.encode()).decode("utf-8", "replace")

    return x.map(one)


def query_param(query: Column, key: str) -> Column:
    """The first value of a key, decoded; plus signs are spaces."""
    pairs = F.filter(F.split(query, "&"), lambda p: F.substring_index(p, "=", 1) == key)
    value = F.get(F.transform(pairs, lambda p: F.when(p.contains("="), F.substring(p, F.lit(len(key) + 2), F.length(p)))), F.lit(0))
    return percent_decode(F.translate(value, "+", " "))


def parse_request(head: Column) -> Column:
    """(method, path, query, version, headers, close) of a request's head; null if the first line has not three parts."""
    lines = F.split(head, "\r\n")
    words = F.split(F.element_at(lines, 1), " ")
    target = F.get(words, F.lit(1))
    rest = F.filter(F.slice(lines, F.lit(2), F.size(lines)), lambda x: x.contains(":"))
    name = lambda x: F.lower(F.trim(F.substring_index(x, ":", 1)))
    headers = F.transform(rest, lambda x: F.struct(name(x).alias("k"), F.trim(F.substring(x, F.locate(":", x) + 1, F.length(x))).alias("v")))
    version = F.get(words, F.lit(2))
    connection = F.lower(F.get(F.transform(F.filter(headers, lambda h: h["k"] == "connection"), lambda h: h["v"]), F.lit(0)))
    close = F.when(connection.isNotNull(), connection == "close").otherwise(version == "HTTP/1.0")
    whole = F.struct(
        F.get(words, F.lit(0)).alias("method"), F.substring_index(target, "?", 1).alias("path"),
        F.when(target.contains("?"), F.substring(target, F.locate("?", target) + 1, F.length(target))).otherwise("").alias("query"),
        version.alias("version"), headers.alias("headers"), close.alias("close"),
    )
    return F.when(F.size(words) == 3, whole)
