"""Sharding: minimax contiguous partition.

Groups of equal texts are atomic and stand in order of their text's hash.  The
smallest shard capacity for which a greedy pass needs no more than the wanted
number of shards is found by binary search, and the groups are cut there.

The driver never holds the groups.  It holds totals of hash ranges; greedy
passes that may cut inside a range and passes that may not bound both the
capacity and each cut from two sides, and only the few ranges between these
bounds are split further, until the capacity is exact.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import Scratch, load

#: Most ranges that one round brings to the driver.
MAX_RANGES = 1 << 19
#: A group above this share of all bytes is a range of its own; at most as many exist.
HEAVY_SHARE = 4096
BUCKETS = 1024


@dataclass
class Plan:
    """cuts: first hash of shards 1, 2, ...; None where no group is left for a shard."""

    cuts: list[int | None]
    capacity: int
    total: int


def _step(edges: np.ndarray, solid: np.ndarray | None, at: int, capacity: int) -> int:
    """The furthest a shard that starts at byte ``at`` may reach; ranges not solid may be cut anywhere."""
    to = at + capacity
    if to >= edges[-1]:
        return int(edges[-1])
    i = int(np.searchsorted(edges, to, side="right")) - 1
    return to if solid is not None and not solid[i] else int(edges[i])


def _ends(edges: np.ndarray, solid: np.ndarray | None, shards: int, capacity: int) -> list[int]:
    out, at = [], 0
    for _ in range(shards):
        at = max(at, _step(edges, solid, at, capacity))
        out.append(at)
    return out


def _least(edges: np.ndarray, solid: np.ndarray | None, shards: int, low: int) -> int:
    """Binary search of the smallest capacity whose greedy pass covers everything."""
    high = int(edges[-1])
    while low < high:
        mid = (low + high) // 2
        if _ends(edges, solid, shards, mid)[-1] >= edges[-1]:
            high = mid
        else:
            low = mid + 1
    return low


def _even(sizes: np.ndarray, shards: int) -> float:
    """The even share of what is left once groups larger than it have shards of their own."""
    large = 0
    for size in np.sort(sizes)[::-1]:
        share = sizes.sum() / max(shards - large, 1)
        if large >= shards - 1 or size <= share:
            return share
        large, sizes = large + 1, np.delete(sizes, np.argmax(sizes))
    return 0.0


def _cut(edges: np.ndarray, shards: int, capacity: int) -> list[int]:
    """Cuts under the capacity, as even as it lets them be; a group larger than an even share has its own shard if it can."""
    total, sizes = int(edges[-1]), np.diff(edges)
    need = [total]  # from here on, the shards that follow suffice
    for _ in range(shards - 1):
        need.append(int(edges[np.searchsorted(edges, need[-1] - capacity, side="left")]))
    need = need[::-1]  # need[j]: least end of shard j
    cuts, at = [], 0
    for j in range(shards - 1):
        i = int(np.searchsorted(edges, at))
        rest = sizes[i:]
        share = _even(rest, shards - j)
        large = np.flatnonzero(rest > share) if len(rest) else rest
        run = int(edges[i + large[0]]) - at if len(large) else total - at
        parts = max(round(run / share), 1) if share else 1
        ideal = at + (run / min(parts, shards - j) if run else int(rest[0]) if len(rest) else 0)
        near = int(np.searchsorted(edges, ideal))
        end = min((int(edges[x]) for x in (near - 1, near) if 0 <= x < len(edges)), key=lambda e: abs(e - ideal))
        at = min(max(end, need[j], at), max(at, _step(edges, None, at, capacity)))
        cuts.append(at)
    return cuts


def _ranges(groups: DataFrame, shift: int) -> pd.DataFrame:
    return (
        groups.groupBy(F.shiftright("h", shift).alias("bin"), "sub")
        .agg(F.min("h").alias("first"), F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("n"))
        .toPandas()
        .assign(shift=shift)
    )


def plan_shards(sized: DataFrame, shards: int) -> Plan:
    """The cuts for rows ``(h, size)``: rows of equal h stay together."""
    scratch = Scratch(sized.sparkSession)
    groups = scratch.save(sized.groupBy("h").agg(F.sum("size").alias("bytes")))
    total, largest = groups.agg(F.sum("bytes"), F.max("bytes")).first()
    if not total:
        return Plan([None] * (shards - 1), 0, 0)
    heavy: dict[int, list[int]] = {}
    for (h,) in groups.filter(F.col("bytes") > total // HEAVY_SHARE).select("h").collect():  # at most HEAVY_SHARE rows
        heavy.setdefault(h >> 48, []).append(h)
    rows = [(b, sorted(x)) for b, x in heavy.items()] or [(1 << 20, [0])]
    own = groups.sparkSession.createDataFrame(rows, "hot long, hs array<long>")
    groups = groups.join(F.broadcast(own), F.shiftright("h", 48) == F.col("hot"), "left").select(
        "h",
        "bytes",
        F.coalesce(F.expr("size(filter(hs, x -> x < h)) + size(filter(hs, x -> x <= h))"), F.lit(0)).alias("sub"),
    )
    shift, table = 48, _ranges(groups, 48)
    while True:
        table = table.sort_values("first", ignore_index=True)
        edges = np.concatenate([[0], np.cumsum(table["bytes"].to_numpy(np.int64))])
        solid = table["n"].to_numpy() == 1
        low = _least(edges, solid, shards, max(-(-total // shards), largest))
        high = _least(edges, None, shards, low)
        if low == high:
            break
        unsure = np.zeros(len(table), dtype=bool)
        for a, b in zip(_ends(edges, None, shards, low), _ends(edges, solid, shards, high), strict=True):
            unsure[max(0, np.searchsorted(edges, a, side="right") - 1) : np.searchsorted(edges, b, side="right")] = True
        unsure &= ~solid
        if not unsure.any() or not shift:
            break
        open_ = table[unsure & (table["shift"] == shift)]
        if open_.empty:
            break
        finer = 0 if open_["n"].sum() <= MAX_RANGES else max(0, shift - max(1, int(np.log2(MAX_RANGES / len(open_)))))
        keys = groups.sparkSession.createDataFrame(open_[["bin", "sub"]].astype({"bin": "int64", "sub": "int32"}))
        groups = groups.join(  # at most MAX_RANGES keys
            F.broadcast(keys.withColumnsRenamed({"bin": "b", "sub": "s"})),
            (F.shiftright("h", shift) == F.col("b")) & (F.col("sub") == F.col("s")),
            "left_semi",
        )
        table = pd.concat([table.drop(open_.index), _ranges(groups, finer)], ignore_index=True)
        shift = finer
    firsts = table["first"].to_numpy()
    at = np.searchsorted(edges, _cut(edges, shards, high))
    return Plan([int(firsts[i]) if i < len(firsts) else None for i in at], high, int(total))


def _shard_of(h: Column, cuts: list[int | None]) -> Column:
    out = F.lit(0)
    for c in cuts:
        if c is not None:
            out = out + (h >= F.lit(c)).cast("int")
    return out


def _slots(df: DataFrame, order: list[str]) -> DataFrame:
    """Adds ``slot``, gapless from 0 in each shard: a row number in each of BUCKETS parts of a shard, plus the rows of the parts before."""
    parted = df.withColumn("part_", F.pmod(F.xxhash64("doc_id"), F.lit(BUCKETS)))
    before = Window.partitionBy("shard").orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)
    counts = parted.groupBy("shard", "part_").agg(F.count(F.lit(1)).alias("n_"))
    offsets = counts.select("shard", "part_", F.coalesce(F.sum("n_").over(before), F.lit(0)).alias("before_"))
    number = F.row_number().over(Window.partitionBy("shard", "part_").orderBy(*order))
    return (  # offsets: shards x BUCKETS rows at most
        parted.withColumn("row_", number)
        .join(F.broadcast(offsets), ["shard", "part_"])
        .withColumn("slot", F.col("before_") + F.col("row_") - 1)
        .drop("part_", "row_", "before_")
    )


def sized(docs: DataFrame) -> DataFrame:
    """(doc_id, size, text_crc32, h): size is the text's UTF-8 bytes plus 1; null counts as no bytes."""
    text = F.col("text")
    return docs.select(
        "doc_id",
        (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1).alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("h"),
    )


def shard_documents(docs: DataFrame, shards: int = 16) -> DataFrame:
    """Each document's shard and its slot there, by the law of bytes.

    Rows of equal text (nulls form one text) share a shard; the largest shard is
    as small as contiguous cuts of the groups allow.  Other columns of ``docs``
    are not read.  Repeated rows each get a slot; an empty table gives an empty one.
    """
    table = Scratch(docs.sparkSession).save(sized(docs))
    plan = plan_shards(table, shards)
    placed = table.withColumn("shard", _shard_of(F.col("h"), plan.cuts))
    return _slots(placed, ["doc_id", "h"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def shard_rows(docs: DataFrame, shards: int = 16) -> DataFrame:
    """All rows and columns of ``docs`` with their shard, by the same cuts."""
    scratch = Scratch(docs.sparkSession)
    table = scratch.save(sized(docs).select("h", "size"))
    plan = plan_shards(table, shards)
    return docs.drop("shard").withColumn("shard", _shard_of(F.xxhash64("text"), plan.cuts))


def op1_sharding(spark, sf_dir):
    return shard_documents(load(spark, sf_dir, "documents"))
