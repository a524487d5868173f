import pytest
from pyspark.sql import functions as F

from argentic.functions import http, text
from argentic.sources import sniff


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("value,digits", [("", "cbf29ce484222325"), ("a", "af63dc4c8601ec8c"), ("foobar", "85944171f73967e8")])
def test_fnv(spark, value, digits):
    assert one(spark, text.unsigned_hex(text.fnv1a64(F.lit(value)))) == digits


@pytest.mark.parametrize(
    "raw,seconds",
    [("1970:01:01 00:00:01", 1), ("1970:01:31 00:00:60\0\0", 30 * 86400 + 60), ("2026:02:31 00:00:00", 1772496000), ("0000:00:00 00:00:00", None), ("2026:13:01 00:00:00", None), ("2026:01:01 25:00:00", None), ("2026", None)],
)
def test_exif_date(spark, raw, seconds):
    assert one(spark, text.parse_exif_datetime(F.lit(raw))) == seconds


@pytest.mark.parametrize("n,d,shown", [(1, 60, "1/60"), (3, 24, "1/8"), (2, 7, "1/4"), (7, 2, "3.5s"), (0, 9, "0s"), (5, 0, "-"), (9, 4, "2.2s")])
def test_exposure(spark, n, d, shown):
    assert one(spark, text.exposure_text(F.lit(n), F.lit(d))) == shown


@pytest.mark.parametrize("n,shown", [(0, "0 B"), (999, "999 B"), (1024, "1.0 KB"), (5 << 20, "5.0 MB"), (100 << 20, "100 MB"), (1 << 50, "1024 TB")])
def test_human_bytes(spark, n, shown):
    assert one(spark, text.human_bytes(F.lit(n).cast("long"))) == shown


@pytest.mark.parametrize("n,most,shown", [(3 << 30, "MB", "3072 MB"), (3 << 30, "TB", "3.0 GB"), (3 << 20, "MB", "3.0 MB"), (3 << 20, "KB", "3072 KB")])
def test_human_bytes_up_to_a_unit(spark, n, most, shown):
    assert one(spark, text.human_bytes(F.lit(n).cast("long"), most)) == shown


@pytest.mark.parametrize("make,model,shown", [("Canon", "Canon EOS 5D", "Canon EOS 5D"), ("NIKON CORPORATION", "NIKON D850", "NIKON CORPORATION NIKON D850"), (None, "X", "X"), ("Y", None, "Y"), (None, None, None)])
def test_camera(spark, make, model, shown):
    assert one(spark, text.camera(F.lit(make).cast("string"), F.lit(model).cast("string"))) == shown


@pytest.mark.parametrize("seconds,day", [(0, "1970-01-01"), (-1, "1969-12-31"), (1786882193, "2026-08-16")])
def test_day(spark, seconds, day):
    assert one(spark, text.day_text(F.lit(seconds).cast("long"))) == day


@pytest.mark.parametrize(
    "header,found",
    [("bytes=7-7", ("part", 7, 7)), ("bytes=998-", ("part", 998, 999)), ("bytes=-3", ("part", 997, 999)), ("bytes=-4000", ("part", 0, 999)), ("bytes=250-1000", ("part", 250, 999)), ("bytes=1000-", ("bad", None, None)), ("bytes=2-4,9-", ("all", None, None)), ("lines=1-2", ("all", None, None)), (None, ("all", None, None))],
)
def test_range(spark, header, found):
    assert tuple(one(spark, http.byte_range(F.lit(header).cast("string"), F.lit(1000)))) == found


@pytest.mark.parametrize("query,value", [("path=a+b", "a b"), ("path=%2Ftmp&x=1", "/tmp"), ("x=1", None), ("path=100%", "100%")])
def test_query_param(spark, query, value):
    assert one(spark, http.query_param(F.lit(query), "path")) == value


def test_status_and_request(spark):
    assert one(spark, http.status_text(F.lit(416))) == "Range Not Satisfiable"
    assert one(spark, http.status_text(F.lit(299))) == "Unknown"
    r = one(spark, http.parse_request(F.lit("GET /a?b=c HTTP/1.1\r\nHost: x\r\nConnection: close\r\n\r\n")))
    assert (r["method"], r["path"], r["query"], r["close"]) == ("GET", "/a", "b=c", True)
    assert one(spark, http.parse_request(F.lit("nonsense"))) is None


def test_sniff_of_short_and_null(spark):
    assert one(spark, sniff.sniff(F.lit(bytearray(b"\xff\xd8\xff")))) == "jpeg"
    assert one(spark, sniff.sniff(F.lit(bytearray(b"")))) is None
    assert one(spark, sniff.sniff(F.lit(None).cast("binary"))) is None


def test_names_and_days(spark):
    assert one(spark, text.display_path(F.lit("\\\\?\\C:\\x\\y"))) == "C:/x/y"
    assert one(spark, text.pretty_day(F.lit("2024-03-09"))) == "9 March 2024"
    assert [one(spark, text.whole_seconds(F.lit(n).cast("long"))) for n in (1_999_999, -1_999_999, 0)] == [1, -1, 0]
    assert one(spark, http.etag_matches(F.lit('"a", "b"'), F.lit('"b"'))) and not one(spark, http.etag_matches(F.lit('"a"'), F.lit('"b"')))
