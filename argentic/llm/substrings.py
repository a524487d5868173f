"""Removal of byte strings that occur twice, over a sampled suffix array.

Prefix doubling ranks suffixes by ever longer prefixes and lets go of those that
are unique.  Ranking every byte position would shuffle some 16 bytes for each
byte of text in each round, so the suffixes ranked here are those that start at
the anchors of _anchors.py, about one in 77 positions, chosen by content alone:
equal windows have equal anchors.  Names are 64-bit hashes, as in Karp, Miller
and Rosenberg's doubling:

1. rank by the GRAM bytes at the anchor; suffixes of unique rank are let go;
2. rerank by the pair of that rank and the whole span around it; spans met twice
   are settled, with all their windows;
3. the spans left, of which others share the anchor only, are compared window by
   window: within one list if few share an anchor, else by hashes, of blocks of
   windows and then of the windows in blocks that are neither settled nor unique.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._anchors import Rolling, U, mix, spans
from ._common import Scratch, load

GRAM = 48
#: Bytes looked at together; a longer text is looked at in tiles that overlap by a window.
TILE = 1 << 19
#: So many spans of one anchor are compared in one list; more of them by hashes over the cluster.
LISTED = 64
#: Windows that are first compared as one, where many spans share an anchor.
BLOCK = 16
#: A run of window starts is one long: start << SHIFT | count.
SHIFT = 20


def _tiles(texts: list[bytes], window: int) -> Iterator[tuple[list[int], list[int], list[bytes]]]:
    """(rows, offsets, pieces): pieces of at most TILE window starts, several texts together."""
    rows, offsets, pieces, held = [], [], [], 0
    for i, t in enumerate(texts):
        for at in range(0, max(len(t) - window + 1, 0), TILE):
            piece = t[at : at + TILE + window - 1]
            if held and held + len(piece) > TILE + window:
                yield rows, offsets, pieces
                rows, offsets, pieces, held = [], [], [], 0
            rows.append(i), offsets.append(at), pieces.append(piece)
            held += len(piece)
    if held:
        yield rows, offsets, pieces


def _texts(column: pa.Array) -> list[bytes]:
    return [t or b"" for t in column.to_pylist()]


def _rows(docs: DataFrame) -> DataFrame:
    """(doc_id, h, t): h tells apart texts under one id; rows equal in both count as repeats of each other."""
    return docs.select("doc_id", F.xxhash64("text").alias("h"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("t"))


def _anchored(rows: DataFrame, window: int) -> DataFrame:
    """(doc_id, h, run, key, span): the spans of all texts; key names the anchor, span the whole."""
    kind = rows.schema["doc_id"].dataType.simpleString()

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for own, offsets, pieces in _tiles(_texts(b.column(2)), window):
                ends = np.cumsum([len(p) for p in pieces])
                data = np.frombuffer(b"".join(pieces), dtype=np.uint8)
                first, last, key, span, _ = spans(data, ends, window, GRAM)
                which = np.searchsorted(ends, first, side="right")
                start = first - (ends - [len(p) for p in pieces])[which] + np.array(offsets)[which]
                row = pa.array(np.array(own)[which])
                run = (start << SHIFT) | (last - first + 1)
                columns = [b.column(0).take(row), b.column(1).take(row), pa.array(run), pa.array(key.view(np.int64)), pa.array(span.view(np.int64))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "h", "run", "key", "span"])

    return rows.mapInArrow(each, f"doc_id {kind}, h long, run long, key long, span long")


def _bytes_of(rows: DataFrame, wanted: DataFrame, window: int) -> DataFrame:
    """``wanted(doc_id, h, run, key, n, m)`` with the bytes of each span.

    Equal rows give a span once each; all their spans have n > 1, which more of them doesn't change.
    """
    packed = wanted.groupBy("doc_id", "h").agg(F.collect_list(F.struct("run", "key", "n", "m")).alias("w"))
    packed = packed.select(F.col("doc_id").alias("d_"), F.col("h").alias("h_"), "w")
    once = rows.join(packed, F.col("doc_id").eqNullSafe(F.col("d_")) & (F.col("h") == F.col("h_")))
    cut = F.transform(
        "w",
        lambda x: F.struct(
            *(x[c].alias(c) for c in ("run", "key", "n", "m")),
            F.substring(F.col("t"), (F.shiftright(x["run"], SHIFT) + 1).cast("int"), (x["run"].bitwiseAND((1 << SHIFT) - 1) + window - 1).cast("int")).alias("s"),
        ),
    )
    return once.select("doc_id", "h", F.explode(cut).alias("x")).select("doc_id", "h", "x.*")


def _runs(starts: np.ndarray) -> np.ndarray:
    """Sorted window starts as packed runs."""
    if not len(starts):
        return np.zeros(0, dtype=np.int64)
    breaks = np.flatnonzero(np.diff(starts) != 1) + 1
    first, count = starts[np.append(0, breaks)], np.diff(np.concatenate([[0], breaks, [len(starts)]]))
    return (first << SHIFT) | count


def _compare_lists(spans_: DataFrame, window: int) -> DataFrame:
    """Runs of windows that occur again, among the few spans of each anchor."""
    kind = spans_.schema["doc_id"].dataType.simpleString()
    lists = spans_.groupBy("key").agg(F.collect_list(F.struct("doc_id", "h", "run", "n", "s")).alias("x"))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            column = b.column(0)
            flat, bounds = column.flatten(), column.offsets.to_numpy()
            bounds = bounds - bounds[0]
            run, n, s = (flat.field(i).to_numpy(zero_copy_only=False) for i in (2, 3, 4))
            out_row, out_run = [], []
            for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
                seen: dict[bytes, int] = {}
                for i in range(lo, hi):
                    text, weight = s[i], int(n[i])
                    for j in range(len(text) - window + 1):
                        piece = text[j : j + window]
                        seen[piece] = seen.get(piece, 0) + weight
                for i in range(lo, hi):
                    if n[i] == 1:
                        text, start = s[i], int(run[i]) >> SHIFT
                        again = [start + j for j in range(len(text) - window + 1) if seen[text[j : j + window]] > 1]
                        found = _runs(np.array(again, dtype=np.int64))
                        out_row += [i] * len(found)
                        out_run.append(found)
            if out_row:
                at = pa.array(out_row)
                yield pa.RecordBatch.from_arrays([flat.field(0).take(at), flat.field(1).take(at), pa.array(np.concatenate(out_run))], ["doc_id", "h", "run"])

    return lists.select("x").mapInArrow(each, f"doc_id {kind}, h long, run long")


def _at(names: list[str], at: pa.Array, batch: pa.RecordBatch) -> list[pa.Array]:
    return [batch.column(batch.schema.get_field_index(c)).take(at) for c in names]


def _cut_blocks(spans_: DataFrame, window: int) -> DataFrame:
    """The windows of spans in blocks of BLOCK, aligned to the anchor.

    inner names the bytes that all windows of a whole block share, u1 and u2 the
    block's own windows; s has its bytes.
    """
    kind = spans_.schema["doc_id"].dataType.simpleString()

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, starts, counts, inner, units, texts = [], [], [], [], [], []
            for i, (run, text) in enumerate(zip(b.column(2).to_pylist(), b.column(4).to_pylist(), strict=True)):
                roll = Rolling(np.frombuffer(text, dtype=np.uint8))
                windows = len(text) - window + 1
                anchor = int(np.argmin(roll.every(GRAM)[: window - GRAM + 1] >> U(32)))
                for block in range((anchor - windows + 1) // BLOCK, anchor // BLOCK + 1):
                    first = max(anchor - block * BLOCK - BLOCK + 1, 0)
                    last = min(anchor - block * BLOCK, windows - 1)
                    if first > last:
                        continue
                    core = anchor - block * BLOCK  # the last start of a whole block; its first window ends BLOCK - 1 sooner
                    ends = np.array([[core, core + window - BLOCK + 1], [first, last + window]])
                    ends = np.clip(ends, 0, len(text))
                    inner.append(roll.at(ends[:1, 0], ends[:1, 1])[0] ^ U(block & 0xFFFF))
                    units.append(roll.at(ends[1:, 0], ends[1:, 1])[0])
                    rows.append(i), starts.append((run >> SHIFT) + first), counts.append(last - first + 1)
                    texts.append(text[first : last + window])
            if rows:
                at, u = pa.array(rows), np.array(units, dtype=U)
                second = mix(u + np.array(inner, dtype=U) + U(1) * np.array(counts, dtype=U))
                made = [starts, counts, np.array(inner, dtype=U).view(np.int64), u.view(np.int64), second.view(np.int64)]
                columns = [*_at(["doc_id", "h", "n"], at, b), *(pa.array(x, type=pa.int64()) for x in made), pa.array(texts, type=pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "h", "n", "start", "count", "inner", "u1", "u2", "s"])

    schema = f"doc_id {kind}, h long, n long, start long, count long, inner long, u1 long, u2 long, s binary"
    return spans_.select("doc_id", "h", "run", "n", "s").mapInArrow(each, schema)


def _cut_windows(blocks: DataFrame, window: int) -> DataFrame:
    kind = blocks.schema["doc_id"].dataType.simpleString()

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            start, texts = b.column(3).to_numpy(), b.column(4).to_pylist()
            for lo in range(0, len(texts), 1024):
                pieces = texts[lo : lo + 1024]
                size = np.array([len(p) for p in pieces])
                roll = Rolling(np.frombuffer(b"".join(pieces), dtype=np.uint8))
                counts = size - window + 1
                row = np.repeat(np.arange(len(size)), counts)
                within = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
                at = (np.cumsum(size) - size)[row] + within
                names = roll.at(at, at + window), mix(roll.at(at, at + window // 2) + U(1))
                columns = [*_at(["doc_id", "h", "n"], pa.array(row + lo), b), pa.array(start[lo : lo + 1024][row] + within), *(pa.array(x.view(np.int64)) for x in names)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "h", "n", "start", "w1", "w2"])

    return blocks.select("doc_id", "h", "n", "start", "s").mapInArrow(each, f"doc_id {kind}, h long, n long, start long, w1 long, w2 long")


def _met(table: DataFrame, names: list[str], found: DataFrame) -> DataFrame:
    """Rows of ``table`` whose names are in ``found``, which is a written table: either side of the join can be split if a name is frequent."""
    other = found.select(*(F.col(c).alias(f"{c}_") for c in names))
    return table.join(other, reduce(lambda a, b: a & b, (F.col(c) == F.col(f"{c}_") for c in names)), "left_semi")


def _compare_hashes(spans_: DataFrame, window: int, scratch: Scratch) -> DataFrame:
    """The same for anchors that any number of spans share: blocks of windows meet by hash, then the windows of blocks left open."""
    blocks = scratch.save(_cut_blocks(spans_, window))
    unit = ["inner", "u1", "u2"]
    units = blocks.groupBy(*unit).agg(F.sum("n").alias("n"), *(F.first(c).alias(c) for c in ("doc_id", "h", "start", "s")))
    units = scratch.save(units)
    settled = _met(blocks.filter("n = 1"), unit, units.filter("n > 1")).select("doc_id", "h", (F.shiftleft("start", SHIFT) + F.col("count")).alias("run"))
    several = scratch.save(units.groupBy("inner").agg(F.count(F.lit(1)).alias("m")).filter("m > 1"))
    windows = scratch.save(_cut_windows(_met(units, ["inner"], several), window))
    again = scratch.save(windows.groupBy("w1", "w2").agg(F.sum("n").alias("all_")).filter("all_ > 1"))
    found = _met(windows.filter("n = 1"), ["w1", "w2"], again)
    return settled.unionByName(found.select("doc_id", "h", (F.shiftleft("start", SHIFT) + 1).alias("run")))


def repeated_runs(docs: DataFrame, window: int, scratch: Scratch) -> DataFrame:
    """(doc_id, h, run): runs of window starts whose bytes also start anywhere else."""
    rows = _rows(docs)
    suffixes = scratch.save(_anchored(rows, window))
    ranks = scratch.save(suffixes.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("key"))
    shared = scratch.save(_met(suffixes, ["key"], ranks))
    scratch.drop(suffixes, ranks)
    pairs = shared.groupBy("key", "span").agg(F.count(F.lit(1)).alias("n"), *(F.first(c).alias(c) for c in ("doc_id", "h", "run")))
    pairs = scratch.save(pairs)
    settled = scratch.save(_met(shared, ["key", "span"], pairs.filter("n > 1")).select("doc_id", "h", "run"))
    scratch.drop(shared)
    several = scratch.save(pairs.groupBy("key").agg(F.count(F.lit(1)).alias("m")).filter("m > 1").select(F.col("key").alias("k_"), "m"))
    open_ = scratch.save(pairs.join(several, F.col("key") == F.col("k_")).select("doc_id", "h", "run", "key", "n", "m"))
    read = scratch.save(_bytes_of(rows, open_, window))
    scratch.drop(pairs, open_)
    few, many = read.filter(F.col("m") <= LISTED), read.filter(F.col("m") > LISTED)
    return settled.unionByName(_compare_lists(few, window)).unionByName(_compare_hashes(many, window, scratch))


def _covered(runs: np.ndarray, window: int) -> list[tuple[int, int]]:
    """Byte spans that the windows of the runs cover, merged."""
    start = runs >> SHIFT
    stop = start + (runs & ((1 << SHIFT) - 1)) + window - 1
    order = np.argsort(start, kind="stable")
    start, stop = start[order], np.maximum.accumulate(stop[order])
    new = np.flatnonzero(np.append(True, start[1:] > stop[:-1]))
    return list(zip(start[new].tolist(), stop[np.append(new[1:], len(stop)) - 1].tolist(), strict=True))


def _with_spans(docs: DataFrame, window: int, make, fields: dict[str, str], types: list[pa.DataType]) -> DataFrame:
    """``make(text, spans) -> tuple`` of every document and its repeated byte spans."""
    scratch = Scratch(docs.sparkSession)
    runs = repeated_runs(docs, window, scratch)
    packed = runs.groupBy("doc_id", "h").agg(F.collect_list("run").alias("runs")).select(F.col("doc_id").alias("d_"), F.col("h").alias("h_"), "runs")
    joined = _rows(docs).join(packed, F.col("doc_id").eqNullSafe(F.col("d_")) & (F.col("h") == F.col("h_")), "left").select("doc_id", "t", "runs")
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = list(fields)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for text, runs_ in zip(_texts(b.column(1)), b.column(2), strict=True):
                out.append(make(text, _covered(runs_.values.to_numpy(), window) if runs_.is_valid else []))
            columns = [pa.array(list(x), type=kind_) for x, kind_ in zip(zip(*out, strict=True), types, strict=True)] if out else []
            if columns:
                yield pa.RecordBatch.from_arrays([b.column(0), *columns], ["doc_id", *names])

    return joined.mapInArrow(each, ", ".join([f"doc_id {kind}", *(f"{n} {x}" for n, x in fields.items())]))


def _kept(text: bytes, removed: list[tuple[int, int]]) -> bytes:
    at, out = 0, []
    for a, b in removed:
        out.append(text[at:a])
        at = b
    return b"".join([*out, text[at:]])


def remove_repeats(docs: DataFrame, window: int = 200) -> DataFrame:
    """(doc_id, kept, spans): what is left of each text, as bytes, and the removed byte spans [start, end).

    A byte goes if a ``window``-byte string that covers it also starts anywhere
    else, in another document or at another place of the same one; overlaps
    count.  Null and short texts lose nothing; equal rows repeat one another.
    Other columns of docs are not read.
    """
    types = [pa.binary(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))]
    return _with_spans(docs, window, lambda t, s: (_kept(t, s), [{"start": a, "end": b} for a, b in s]), {"kept": "binary", "spans": "array<struct<start:long,end:long>>"}, types)


def repeat_digest(docs: DataFrame, window: int = 200) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of remove_repeats."""

    def make(text: bytes, removed: list[tuple[int, int]]) -> tuple:
        return len(text), sum(b - a for a, b in removed), len(removed), hashlib.sha256(_kept(text, removed)).hexdigest()

    fields = {"n_bytes": "long", "n_removed": "long", "n_spans": "long", "kept_sha256": "string"}
    return _with_spans(docs, window, make, fields, [pa.int64()] * 3 + [pa.string()])


def op4_substrings(spark, sf_dir):
    return repeat_digest(load(spark, sf_dir, "documents"))
