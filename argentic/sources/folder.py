"""Photo folders: the walk, the per-file work, and the index kept as Parquet."""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from argentic.functions import text
from argentic.operators import palette, raster

from . import exif, gif, jpeg, png
from .png import ImageError
from .sniff import BRANDS, MAGIC, SNIFF_BYTES

INDEX_VERSION = 1
RATIO = "struct<n:bigint,d:bigint>"
SIZE = "struct<w:bigint,h:bigint>"
META = (
    f"struct<make:string,model:string,lens:string,iso:bigint,exposure:{RATIO},f_number:{RATIO},orientation:int,"
    f"gps:struct<lat:double,lon:double>,dims:{SIZE},original:string,digitized:string,modified:string>"
)
SIG = "struct<dhash:bigint,phash:bigint,rots:array<bigint>>"
WORK = f"path string, bytes long, mtime long, format string, raw {META}, sig {SIG}, thumb binary, dims {SIZE}, state string, reason string"


def walk(spark: SparkSession, root: str) -> DataFrame:
    """(path, bytes, mtime) of all files below a folder: no links, nothing whose name starts with a dot, sorted by path segments.

    A folder below that can't be read is passed over; the root must be readable.
    """
    os.scandir(root).close()
    found, open_ = [], [root]
    while open_:
        try:
            entries = list(os.scandir(open_.pop()))
        except OSError:
            continue
        for e in entries:
            if e.name.startswith(".") or e.is_symlink():
                continue
            if e.is_dir():
                open_.append(e.path)
            elif e.is_file():
                s = e.stat()
                found.append((e.path.replace("\\", "/"), s.st_size, int(s.st_mtime)))
    found.sort(key=lambda x: x[0].split("/"))
    return spark.createDataFrame(found, "path string, bytes long, mtime long")


def sniff_bytes(head: bytes) -> str | None:
    for name, magic in MAGIC:
        if head.startswith(bytes.fromhex(magic)):
            return name
    return "heic" if head[4:8] == b"ftyp" and head[8:12].decode("latin1") in BRANDS else None


def develop(data: bytes, format_: str) -> dict:
    """Metadata, signature, thumbnail, size and state of one image; an image that can't be decoded keeps its metadata."""
    meta = exif.parse(data)
    out = {"raw": meta, "sig": None, "thumb": None, "dims": meta["dims"], "state": "nopreview", "reason": "HEVC"}
    if format_ == "heic":
        return out
    try:
        px = {"jpeg": jpeg, "png": png, "gif": gif}[format_].decode(data)
    except ImageError as e:
        plain = str(e).startswith("unsupported")
        return out | {"state": "nopreview" if plain else "failed", "reason": "unsupported" if plain else str(e)}
    px = raster.orient(px, meta["orientation"])
    d, p, turned = raster.signature(px)
    sig = {"dhash": d - (1 << 64) if d >> 63 else d, "phash": p, "rots": turned}
    thumb = palette.encode_thumbnail(raster.thumbnail(px))
    return out | {"sig": sig, "thumb": thumb, "dims": {"w": px.shape[1], "h": px.shape[0]}, "state": "ok", "reason": None}


def read_images(files: DataFrame, opener=None) -> DataFrame:
    """The images among ``files(path, bytes, mtime)``, developed.  First bytes decide before the rest is read.

    A file that can't be read, or that ends its own work in any other way, is a
    row of state "unreadable" and ends nothing else.
    """

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for row in b.to_dict("records"):
                try:
                    with (opener or open)(row["path"], "rb") as f:
                        head = f.read(SNIFF_BYTES)
                        format_ = sniff_bytes(head)
                        if format_ is None:
                            continue
                        done = develop(head + f.read(), format_)
                except Exception as e:  # one bad file must not end the job
                    format_, done = None, {"raw": None, "sig": None, "thumb": None, "dims": None, "state": "unreadable", "reason": str(e)}
                yield pd.DataFrame([row | {"format": format_} | done])

    return files.select("path", "bytes", "mtime").mapInPandas(each, WORK)


def with_dates(images: DataFrame) -> DataFrame:
    """taken and date_source: the first of the three dates that parses, else the file's own time."""
    dates = [("taken", "original"), ("digitized", "digitized"), ("file-tag", "modified")]
    parsed = [text.parse_exif_datetime(F.col(f"raw.{c}")) for _, c in dates]
    source = F.coalesce(*(F.when(p.isNotNull(), F.lit(n)) for p, (n, _) in zip(parsed, dates, strict=True)), F.lit("mtime"))
    return images.withColumns({"taken": F.coalesce(*parsed, F.col("mtime")), "date_source": source})


@contextmanager
def lock(root: str):
    """Whether this process may write the index below ``root``; an older lock file means no."""
    path = Path(root, ".argentic.lock")
    try:
        path.touch(exist_ok=False)
    except FileExistsError:
        yield False
        return
    try:
        yield True
    finally:
        path.unlink(missing_ok=True)


def store_index(images: DataFrame, root: str, at: str) -> None:
    """A new directory, then a pointer to it that is replaced at once: a reader sees the old index or the new one."""
    base = Path(at)
    base.mkdir(parents=True, exist_ok=True)
    name = f"v{len(list(base.glob('v*'))) + 1}"
    images.write.mode("overwrite").parquet(str(base / name))
    draft = base / "CURRENT.new"
    draft.write_text(json.dumps({"version": INDEX_VERSION, "root": root, "name": name}))
    os.replace(draft, base / "CURRENT")


def load_index(spark: SparkSession, root: str, at: str) -> DataFrame | None:
    """The stored images of this root; null if there are none, they are of another root or version, or can't be read."""
    try:
        now = json.loads(Path(at, "CURRENT").read_text())
        if now["version"] != INDEX_VERSION or now["root"] != root:
            return None
        table = spark.read.schema(WORK).parquet(str(Path(at, now["name"])))
        table.limit(1).count()
        return table
    except Exception:  # any damage means: build anew
        return None
