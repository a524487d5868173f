"""Benchmark decontamination: size-partitioned MinHash containment search, in DataFrame operations only.

An item and a document are sets of word shingles, and an item is found in a
document that contains at least a share ``t`` of its shingles, however long the
document is.  The similarity of a short set to a long one is near nothing, so
signatures of equal length could not find it.  Here the items are partitioned by
the size of their sets, and each partition has a signature length of its own: of
the u shingles that its largest item can have, u - ceil(t * u) + 1 of least
hash.  A document with a share t of an item lacks fewer shingles than the item's
signature has, so at least one MinHash of it is in the document: no item is
missed.  Documents that contain a MinHash are candidates, verified by counting
the item's shingles in them exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import Scratch, load, lower_ascii, words

#: Tables of so many rows and bytes of text at most are sent to every executor; larger ones are joined by shuffles.
MAX_BROADCAST, MAX_BYTES = 200_000, 32 << 20


def _small(df: DataFrame, text: Column | None = None) -> DataFrame:
    """``df``, to be sent to every executor if it is small; ``text``: bytes of what its rows hold besides numbers."""
    rows, size = df.agg(F.count(F.lit(1)), F.sum(F.lit(0) if text is None else text)).first()
    return F.broadcast(df) if rows <= MAX_BROADCAST and (size or 0) <= MAX_BYTES else df


def _windows(width: Column | int, ws: str = "ws") -> Column:
    """All runs of ``width`` words as strings; none if there are fewer words."""
    return F.expr(
        f"CASE WHEN size({ws}) >= {width} AND {width} > 0 THEN "
        f"transform(sequence(1, size({ws}) - {width} + 1), i -> array_join(slice({ws}, i, {width}), ' ')) ELSE array() END"
    )


def _chain(width: int) -> Column:
    """Hashes of all runs of ``width`` words."""
    inner = "42L"
    for k in range(width):
        inner = f"xxhash64({inner}, {'x' if not k else f'get(ws, i + {k})'})"
    return F.expr(f"slice(transform(ws, (x, i) -> {inner}), 1, greatest(size(ws) - {width - 1}, 0))")


def item_shingles(items: DataFrame, width: int) -> DataFrame:
    """(item_id, width, shingles) with distinct shingles; an item of fewer words than ``width`` is one shingle, one of none is left out."""
    ws = items.select("item_id", words(lower_ascii(F.col("text"))).alias("ws")).filter(F.size("ws") > 0)
    ws = ws.withColumn("width", F.least(F.lit(width), F.size("ws")))
    return ws.select("item_id", "width", F.array_distinct(_windows("width")).alias("shingles"))


def signatures(shingled: DataFrame, share: float) -> DataFrame:
    """(item_id, width, part, hash): the MinHashes of each item, as many as its size partition asks for."""
    part = F.floor(F.log2(F.size("shingles").cast("double"))).cast("int")
    largest = F.pow(F.lit(2.0), F.col("part") + 1) - 1
    length = (largest - F.ceil(largest * F.lit(share) - F.lit(1e-9)) + 1).cast("int")
    hashed = F.transform("shingles", _hash_of)
    least = F.slice(F.array_sort(hashed), F.lit(1), F.col("length"))
    return (
        shingled.withColumn("part", part)
        .withColumn("length", length)
        .select("item_id", "width", "part", F.explode(least).alias("hash"))
    )


def _hash_of(shingle: Column) -> Column:
    """The hash that _chain gives the shingle's words."""
    return F.aggregate(F.split(shingle, " "), F.lit(42).cast("long"), lambda h, w: F.xxhash64(h, w))


def find_items(docs: DataFrame, items: DataFrame, width: int = 5, share: float = 0.8) -> DataFrame:
    """(doc_id, item_id, n_shingles, n_found, containment) of every item that a document contains to ``share`` or more.

    Words in small letters, divided by white space.  Null and blank texts contain
    nothing and blank items are in nothing; repeated documents and items give a
    row each for their ids, once.  Other columns are not read.
    """
    return _find(docs, items, width, share).drop("h").distinct()


def _find(docs: DataFrame, items: DataFrame, width: int, share: float) -> DataFrame:
    """The rows of find_items with h, the hash of the text: ids may be null or name several texts."""
    scratch = Scratch(docs.sparkSession)
    shingled = scratch.save(item_shingles(items, width))
    sign = scratch.save(signatures(shingled, share).distinct())
    widths = [r[0] for r in shingled.select("width").distinct().collect()]  # at most ``width`` numbers
    text = docs.select("doc_id", F.xxhash64("text").alias("h"), words(lower_ascii(F.col("text"))).alias("ws"))
    found = None
    for w in sorted(widths):
        each = text.select("doc_id", "h", F.explode(F.array_distinct(_chain(w))).alias("hash"))
        hits = each.join(_small(sign.filter(F.col("width") == w).select("item_id", "hash")), "hash").select("doc_id", "h", "item_id")
        found = hits if found is None else found.unionByName(hits)
    if found is None:
        kinds = [x.schema[c].dataType.simpleString() for x, c in ((docs, "doc_id"), (items, "item_id"))]
        return docs.sparkSession.createDataFrame([], "doc_id {}, h long, item_id {}, n_shingles int, n_found int, containment double".format(*kinds))
    candidates = scratch.save(found.distinct())
    per_doc = scratch.save(candidates.groupBy("doc_id", "h").agg(F.count(F.lit(1)).alias("n_")).select(F.col("doc_id").alias("d_"), F.col("h").alias("h_")))
    same = F.col("doc_id").eqNullSafe(F.col("d_")) & (F.col("h") == F.col("h_"))
    held = text.join(_small(per_doc), same, "left_semi").dropDuplicates(["doc_id", "h"])
    held = held.join(candidates.select(F.col("doc_id").alias("d_"), F.col("h").alias("h_"), "item_id"), same).select("doc_id", "h", "ws", "item_id")
    weight = F.aggregate("shingles", F.lit(0).cast("long"), lambda s, x: s + F.octet_length(x) + 16)
    pairs = held.join(_small(shingled, weight), "item_id")
    shared = F.size(F.array_intersect(F.col("shingles"), _windows("width")))
    counted = pairs.select("doc_id", "h", "item_id", F.size("shingles").alias("n_shingles"), shared.alias("n_found"))
    kept = counted.filter(F.col("n_found") >= F.ceil(F.col("n_shingles") * F.lit(share) - F.lit(1e-9)))
    return kept.withColumn("containment", F.col("n_found") / F.col("n_shingles"))


def clean_documents(docs: DataFrame, items: DataFrame, width: int = 5, share: float = 0.8) -> DataFrame:
    """The documents that contain no item, all columns kept; a clean text stays whatever else has its id."""
    bad = _find(docs, items, width, share).select(F.col("doc_id").alias("contaminated_id__"), F.col("h").alias("contaminated_h__")).distinct()
    same = F.col("doc_id").eqNullSafe(F.col("contaminated_id__")) & (F.xxhash64(docs["text"]) == F.col("contaminated_h__"))
    return docs.join(bad, same, "left_anti")


def op6_decontamination(spark, sf_dir):
    return find_items(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents
), i AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM benchmark
), iw AS (
  SELECT item_id, ws, least(5, len(ws)) AS width FROM i WHERE len(ws) > 0
), si AS (
  SELECT DISTINCT item_id, width, array_to_string(ws[k:k + width - 1], ' ') AS s
  FROM (SELECT *, unnest(generate_series(1, len(ws) - width + 1)) AS k FROM iw)
), sd AS (
  SELECT DISTINCT doc_id, width, array_to_string(ws[k:k + width - 1], ' ') AS s
  FROM (SELECT doc_id, ws, width, unnest(generate_series(1, len(ws) - width + 1)) AS k
        FROM d, (SELECT DISTINCT width FROM iw) WHERE len(ws) >= width)
), n AS (
  SELECT item_id, count(*) AS n_shingles FROM si GROUP BY item_id
), f AS (
  SELECT doc_id, item_id, count(*) AS n_found FROM sd JOIN si USING (width, s) GROUP BY doc_id, item_id
)
SELECT doc_id, item_id, n_shingles::INTEGER AS n_shingles, n_found::INTEGER AS n_found, n_found::DOUBLE / n_shingles AS containment
FROM f JOIN n USING (item_id) WHERE n_found >= ceil(n_shingles * 0.8 - 1e-9)
"""
