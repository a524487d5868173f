"""The catalogue of photos: incremental build, identities, timeline, clusters and JSON views."""

from __future__ import annotations

import time

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from argentic.functions import http, text
from argentic.operators import similarity
from argentic.sources import folder, sniff


def split_fresh(found: DataFrame, previous: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(previous rows whose path, size and time are unchanged, found rows to read); what is gone is in neither."""
    key = ["path", "bytes", "mtime"]
    return previous.join(found.select(*key), key, "left_semi"), found.join(previous.select(*key), key, "left_anti")


def with_ids(images: DataFrame, root: str) -> DataFrame:
    """rel, name and id.  The id is the hash of rel; of equal hashes the later ones, by rel, hash rel and their number."""
    named = images.withColumn("rel", text.relative(root, text.slashes(F.col("path"))))
    hashed = named.withColumn("h_", text.fnv1a64(F.col("rel")))
    rank = F.row_number().over(Window.partitionBy("h_").orderBy("rel")) - 1
    salted = text.fnv1a64(F.concat(F.col("rel"), F.lit("\0"), F.col("n_").cast("string")))
    return (
        hashed.withColumn("n_", rank)
        .withColumn("id", F.when(F.col("n_") == 0, F.col("h_")).otherwise(salted))
        .withColumn("name", text.last_name(F.col("rel")))
        .drop("h_", "n_")
    )


def with_positions(entries: DataFrame) -> DataFrame:
    """pos from 0 in the timeline's order, newest first: row numbers within ranges of time plus the rows before each range."""
    spark = entries.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = entries.repartitionByRange(parts, F.desc("taken"), F.asc("rel")).withColumn("p_", F.spark_partition_id())
    ranged = ranged.persist()
    counts = ranged.groupBy("p_").agg(F.count(F.lit(1)).alias("n_"))
    before = F.coalesce(F.sum("n_").over(Window.orderBy("p_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    own = F.row_number().over(Window.partitionBy("p_").orderBy(F.desc("taken"), F.asc("rel")))
    offsets = F.broadcast(counts.select("p_", before.alias("before_")))  # a row for each partition
    return ranged.withColumn("own_", own).join(offsets, "p_").withColumn("pos", F.col("before_") + F.col("own_") - 1).drop("p_", "own_", "before_")


def cluster_items(entries: DataFrame, threshold: int = similarity.DEFAULT_THRESHOLD) -> DataFrame:
    """(ids, best, wasted_bytes) of ``entries(pos, id, sig, bytes, pixels)``."""
    entries = entries.select("pos", "id", "sig", "bytes", "pixels").persist(StorageLevel.MEMORY_AND_DISK)
    views = F.concat(F.array("sig.phash"), F.col("sig.rots"))
    items = entries.filter("sig is not null").select(F.col("pos").alias("ord"), views.alias("views"), F.col("sig.phash").alias("upright"))
    members = similarity.clusters(items, threshold).join(entries.select(F.col("pos").alias("ord"), "id", "bytes", "pixels"), "ord")
    return similarity.summarise(members)


def run_stats(images: DataFrame) -> DataFrame:
    """Counts of ``images(reused, state, bytes)``; unreadable files are counted, but are no images."""
    image = F.col("state") != "unreadable"
    return images.agg(
        F.count_if(image).alias("images"), F.count_if(image & F.col("reused")).alias("reused"), F.count_if(image & ~F.col("reused")).alias("decoded"),
        F.count_if(F.col("state") == "failed").alias("failed"), F.count_if(F.col("state") == "nopreview").alias("no_preview"),
        F.count_if(~image).alias("unreadable"), F.coalesce(F.sum(F.when(image, F.col("bytes"))), F.lit(0)).alias("bytes"),
    )


def summary(stats: DataFrame, most: str = "TB") -> DataFrame:
    """(line, text): what a run tells, of run_stats with files_seen, clusters, wasted_bytes and elapsed_ms; lines without news are left out.

    ``most`` is the largest unit of all bytes.
    """
    n = lambda c: F.col(c).cast("string")
    first = F.concat(n("files_seen"), F.lit(" files, "), n("images"), F.lit(" images, "), text.human_bytes(F.col("bytes"), most), F.lit(", "), n("elapsed_ms"), F.lit(" ms"))
    plural = F.when(F.col("clusters") == 1, "cluster").otherwise("clusters")
    each = F.concat(text.fixed(F.col("elapsed_ms").cast("double") / F.nullif(F.col("decoded"), F.lit(0)), 1), F.lit(" ms per image decoded"))
    lines = [
        first,
        F.when(F.col("reused") > 0, F.concat(n("reused"), F.lit(" reused from the index, "), n("decoded"), F.lit(" decoded"))),
        F.when(F.col("unreadable") > 0, F.concat(n("unreadable"), F.lit(" unreadable, skipped"))),
        F.when((F.col("failed") > 0) | (F.col("no_preview") > 0), F.concat(n("failed"), F.lit(" failed to decode, "), n("no_preview"), F.lit(" without a preview"))),
        F.when(F.col("clusters") > 0, F.concat(n("clusters"), F.lit(" duplicate "), plural, F.lit(", "), text.human_bytes(F.col("wasted_bytes")), F.lit(" reclaimable"))),
        F.when(F.col("images") == 0, F.lit("no images here")).when(F.col("decoded") > 0, each),
    ]
    return stats.select(F.posexplode(F.array_compact(F.array(*lines))).alias("line", "text"))


def _arranged(images: DataFrame, root: str) -> DataFrame:
    pixels = F.coalesce(F.when(F.col("state") == "ok", F.col("dims.w") * F.col("dims.h")), F.lit(0))
    return with_positions(with_ids(folder.with_dates(images), root)).withColumn("pixels", pixels)


def serve(spark: SparkSession, root: str, index_at: str) -> DataFrame:
    """The entries of an index that is there, without a walk; an error if there is none of this root."""
    images = folder.load_index(spark, root, index_at)
    if images is None:
        raise ValueError(f"no index of {root} in {index_at}")
    return _arranged(images, root)


def build(spark: SparkSession, root: str, index_at: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(entries in timeline order, run statistics) of a folder; unchanged files come from the index, which is then replaced.

    Statistics are those of run_stats, with the files seen and the milliseconds that
    the walk and the decoding took.
    """
    began = time.monotonic()
    found = folder.walk(spark, root)
    previous = folder.load_index(spark, root, index_at) if index_at else None
    reused, jobs = split_fresh(found, previous) if previous is not None else (None, found)
    decoded = folder.read_images(jobs)
    told = decoded.withColumn("reused", F.lit(False))
    if reused is not None:
        told = told.unionByName(reused.withColumn("reused", F.lit(True)))
    told = told.persist()
    stats = run_stats(told).crossJoin(spark.range(1).select(F.lit(found.count()).alias("files_seen")))  # one row each
    counted = stats.collect()
    stats = spark.createDataFrame(counted, stats.schema).withColumn("elapsed_ms", F.lit(int((time.monotonic() - began) * 1000)))
    images = told.filter("state <> 'unreadable'").drop("reused")
    if index_at:
        with folder.lock(root) as mine:
            if mine:
                folder.store_index(images, root, index_at)
    return _arranged(images, root), stats


def photo_json(entries: DataFrame) -> DataFrame:
    """(id, json) of each photo; absent values have no key."""
    make, model = F.col("raw.make"), F.col("raw.model")
    exposure, f = F.col("raw.exposure"), F.col("raw.f_number")
    gps = F.when(F.col("raw.gps").isNotNull(), F.array(text.fixed(F.col("raw.gps.lat"), 6), text.fixed(F.col("raw.gps.lon"), 6)))
    fields = {
        "id": text.unsigned_hex(F.col("id")), "name": F.col("name"), "rel": F.col("rel"), "bytes": F.col("bytes"), "taken": F.col("taken"),
        "day": text.day_text(F.col("taken")), "dateSource": F.col("date_source"), "format": F.col("format"), "thumb": F.col("thumb").isNotNull(),
        "w": F.col("dims.w"), "h": F.col("dims.h"), "camera": text.camera(make, model), "lens": F.col("raw.lens"), "iso": F.col("raw.iso"),
        "exposure": F.when(exposure.isNotNull(), text.exposure_text(exposure["n"], exposure["d"])), "aperture": text.aperture_text(f["n"], f["d"]),
        "gps": gps, "state": F.col("state"), "reason": F.col("reason"),
    }
    return entries.select("id", "pos", F.to_json(F.struct(*(c.alias(k) for k, c in fields.items()))).alias("json"))


def cluster_json(found: DataFrame) -> DataFrame:
    ids = F.transform("ids", text.unsigned_hex)
    return found.select(F.to_json(F.struct(text.unsigned_hex(F.col("best")).alias("best"), F.col("wasted_bytes").alias("wasted"), ids.alias("ids"))).alias("json"))


def by_id(entries: DataFrame, digits: str) -> DataFrame:
    """The entry of a hex id; none for what is no id."""
    ok = 1 <= len(digits) <= 16 and all(c in "0123456789abcdefABCDEF" for c in digits)
    value = int(digits, 16) if ok else 0
    value = value - (1 << 64) if value >> 63 else value
    return entries.filter(F.lit(ok) & (F.col("id") == value))


def by_ids(entries: DataFrame, asked: DataFrame) -> DataFrame:
    """``asked(digits)`` with the entry of each hex id; null columns for what is no id or has no entry."""
    wanted = asked.withColumn("wanted_", text.parse_hex(F.col("digits")))
    return wanted.join(entries, F.col("wanted_") == F.col("id"), "left").drop("wanted_")


def thumb_responses(entries: DataFrame, asked: DataFrame) -> DataFrame:
    """``asked(digits, if_none_match)`` with status, etag and body of each one's thumbnail, which is in the index."""
    met = by_ids(entries, asked).withColumn("etag", http.etag(F.col("id"), F.col("mtime"), F.col("bytes")))
    status = F.when(F.col("thumb").isNull(), 404).when(http.etag_matches(F.col("if_none_match"), F.col("etag")), 304).otherwise(200)
    met = met.withColumn("status", status)
    return met.select(*asked.columns, "status", F.when(F.col("status") != 404, F.col("etag")).alias("etag"), F.when(F.col("status") == 200, F.col("thumb")).alias("body"))


def orig_responses(entries: DataFrame, asked: DataFrame, files: DataFrame) -> DataFrame:
    """``asked(digits, if_none_match, range)`` with status, content type and range, etag and body of each one's file.

    ``files(path, content)`` are the originals as they are now, such as Spark's
    binaryFile source reads them; an entry without one is gone.  No path comes
    from the asker.
    """
    now = files.select(F.col("path").alias("path_"), "content", F.octet_length("content").cast("long").alias("total_"))
    met = by_ids(entries, asked).join(now, F.col("path") == F.col("path_"), "left")
    met = met.withColumn("etag", http.etag(F.col("id"), F.col("mtime"), F.col("total_"))).withColumn("r_", http.byte_range(F.col("range"), F.col("total_")))
    bad, part = F.col("r_.kind") == "bad", F.col("r_.kind") == "part"
    status = F.when(F.col("content").isNull(), 404).when(http.etag_matches(F.col("if_none_match"), F.col("etag")), 304).when(bad, 416).when(part, 206).otherwise(200)
    met = met.withColumn("status", status)
    some = F.substring(F.col("content"), (F.col("r_.start") + 1).cast("int"), (F.col("r_.end") - F.col("r_.start") + 1).cast("int"))
    text_ = lambda x: x.cast("string")
    reach = F.concat(F.lit("bytes "), text_(F.col("r_.start")), F.lit("-"), text_(F.col("r_.end")), F.lit("/"), text_(F.col("total_")))
    return met.select(
        *asked.columns, "status", F.when(F.col("status").isin(200, 206), sniff.mime(F.col("format"))).alias("content_type"),
        F.when(F.col("status") == 206, reach).when(F.col("status") == 416, F.concat(F.lit("bytes */"), text_(F.col("total_")))).alias("content_range"),
        F.when(F.col("status").isin(200, 206, 304), F.col("etag")).alias("etag"),
        F.when(F.col("status") == 200, F.col("content")).when(F.col("status") == 206, some).alias("body"),
    )


def day_groups(entries: DataFrame) -> DataFrame:
    """(day, n, by_mtime): by_mtime if the first photo of the day, in the timeline's order, has only its file's time."""
    first = F.max_by("date_source", F.struct(F.col("taken"), -F.col("pos")))
    return entries.groupBy(text.day_text(F.col("taken")).alias("day")).agg(F.count(F.lit(1)).alias("n"), (first == "mtime").alias("by_mtime"))
