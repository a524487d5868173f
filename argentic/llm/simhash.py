"""SimHash near-duplicates: a byte-position inverted index with count filtering.

Two 64-bit fingerprints that differ in at most ``d`` bits agree in at least
``8 - d`` of their eight bytes, at the same positions.  A posting key is a
choice of that many byte positions with the bytes there, so two fingerprints
under one key already share the guaranteed number of positional bytes: the
tally and its threshold are in the key.  A posting list holds distinct
fingerprints that can differ in ``d`` bytes only, 65,536 of them at most for
d = 2, so it is safe to verify one list in one task.  From a list come the links
of a spanning forest, not all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import Scratch, load
from ._graph import connected_components

U = np.uint64
SEED = 42
#: Shingles hashed at a time, so that a very long text needs no more memory than a short one.
BLOCK = 1 << 16


def _bit_counts(hashes: list[int]) -> np.ndarray:
    rows = np.array(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8)
    return np.unpackbits(rows, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)


def fingerprint(text: bytes | None, width: int) -> int:
    """SimHash of the text's word shingles, repeats included; 0 for no words."""
    ws = (text or b"").lower().split()  # bytes: A-Z alone become small, and ASCII spaces alone divide
    if not ws:
        return 0
    width = min(width, len(ws))
    flat = b" ".join(ws)
    ends = np.cumsum(np.fromiter(map(len, ws), dtype=np.int64, count=len(ws)) + 1) - 1
    starts = np.append(0, ends[:-1] + 1)[: len(ws) - width + 1].tolist()
    stops = ends[width - 1 :].tolist()
    h, n = xxhash.xxh64_intdigest, len(starts)
    counts = np.zeros(64, dtype=np.int64)
    for i in range(0, n, BLOCK):
        counts += _bit_counts([h(flat[a:b], SEED) for a, b in zip(starts[i : i + BLOCK], stops[i : i + BLOCK], strict=True)])
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """(doc_id, fp): fingerprints as signed longs."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            fps = np.fromiter((fingerprint(t, width) for t in b["t"]), dtype=np.uint64, count=len(b))
            yield pd.DataFrame({"doc_id": b["doc_id"], "fp": fps.view(np.int64)})

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("binary").alias("t")).mapInPandas(each, f"doc_id {kind}, fp long")


@lru_cache
def _flips(open_bits: int, bits: int) -> np.ndarray:
    """All ways to change 1 to ``bits`` of the open bits."""
    one = [1 << i for i in range(64) if open_bits >> i & 1]
    return np.array([sum(c) for k in range(1, bits + 1) for c in combinations(one, k)], dtype=U)


def _forest(fps: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links member - root of the components, within one posting list, of pairs that differ in at most ``bits`` bits."""
    fps = np.unique(fps)
    label = np.arange(len(fps))
    if len(fps) <= 128:
        near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= bits
        a, b = np.nonzero(np.triu(near, 1))
    else:
        varying = int(np.bitwise_or.reduce(fps ^ fps[0]))
        found = []
        for flip in _flips(varying, bits):  # 136 ways at most in two bytes
            at = np.minimum(np.searchsorted(fps, fps ^ flip), len(fps) - 1)
            hit = np.flatnonzero(fps[at] == fps ^ flip)
            found.append((hit, at[hit]))
        a, b = (np.concatenate(x) for x in zip(*found, strict=True))
    while len(a):
        old = label.copy()
        np.minimum.at(label, a, label[b])
        np.minimum.at(label, b, label[a])
        label = label[label]
        if (old == label).all():
            break
    member = np.flatnonzero(label != np.arange(len(fps)))
    return fps[member], fps[label[member]]


def link_fingerprints(distinct: DataFrame, bits: int = 2) -> DataFrame:
    """Links (a, b) that span the components of ``distinct(fp)`` under "at most ``bits`` bits differ"."""
    masks = []
    for open_bytes in combinations(range(8), bits):
        mask = (1 << 64) - 1 - sum(0xFF << 8 * i for i in open_bytes)
        masks.append(mask - (1 << 64) if mask >> 63 else mask)
    keys = F.array(*(F.struct(F.lit(i).alias("c"), F.col("fp").bitwiseAND(F.lit(m)).alias("k")) for i, m in enumerate(masks)))
    postings = distinct.select("fp", F.explode(keys).alias("key")).groupBy("key.c", "key.k").agg(F.collect_list("fp").alias("fps"))

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            lists = b["fps"].to_numpy()
            size = np.fromiter(map(len, lists), dtype=np.int64, count=len(lists))
            out = []
            if (size == 2).any():
                two = np.stack(lists[size == 2]).astype(np.int64).view(U)
                two = two[np.bitwise_count(two[:, 0] ^ two[:, 1]) <= bits]
                out.append((two[:, 0], two[:, 1]))
            out += [_forest(np.asarray(x, dtype=np.int64).view(U), bits) for x in lists[size > 2]]
            if out:
                a, b_ = (np.concatenate(x).view(np.int64) for x in zip(*out, strict=True))
                yield pd.DataFrame({"a": a, "b": b_})

    return postings.filter(F.size("fps") > 1).select("fps").mapInPandas(verify, "a long, b long")


def near_duplicates(docs: DataFrame, width: int = 3, bits: int = 2) -> DataFrame:
    """(doc_id, fp, component_id): the least doc_id that a document reaches over links of near fingerprints.

    Null and blank texts have fingerprint 0 and are linked like any other; equal
    fingerprints are one node, so copies cost one row each.  A null doc_id takes
    the component of its fingerprint.  Columns other than doc_id and text are
    not read; an empty table gives an empty one.
    """
    scratch = Scratch(docs.sparkSession)
    table = scratch.save(fingerprints(docs, width))
    nodes = scratch.save(table.groupBy("fp").agg(F.min("doc_id").alias("least_")))
    links = scratch.save(link_fingerprints(nodes.select("fp"), bits))
    roots = connected_components(links, scratch)
    rooted = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "least_", F.coalesce("root", "fp").alias("root"))
    rooted = scratch.save(rooted)
    least = rooted.groupBy("root").agg(F.min("least_").alias("component_id"))
    named = rooted.join(least, "root").select(F.col("fp").alias("fp_"), "component_id")
    return table.join(named, F.col("fp") == F.col("fp_"), "left").select("doc_id", "fp", "component_id")


def op3_simhash(spark, sf_dir):
    found = near_duplicates(load(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


# Similarity of 0.8, which is past the reach of few differing bits ---------------------------------------------------

#: At a similarity of 0.8 some ten of a SimHash's 64 bits differ, so no byte need be intact and the guaranteed count is
#: zero.  So a wide fingerprint has a SimHash of 8 bits for each of POSITIONS samples of the shingles; a sample is the
#: shingle of least hash, so two texts agree in a byte as often as they are similar.  RUNS posting keys have RUN bytes
#: each, from the first positions; all positions are tallied: texts of similarity 0.8 share none of them once in 4,500 times, of 0.9 once in 26 million.
POSITIONS, RUN, RUNS = 256, 4, 16
#: Pairs with fewer equal bytes are not verified: 3.5 standard deviations below what a similarity of 0.8 gives.
LEAST_EQUAL = 182
#: All pairs of so short a posting list are candidates; in a longer one each entry is paired with HUBS others.
LISTED, HUBS = 4, 3
#: Entries that the hubs of a long list don't reach are held against the whole list, in blocks of about so many bytes,
#: where an entry counts for ROW_BYTES more than it has.
BLOCK_BYTES, ROW_BYTES = 1 << 21, 1 << 11
#: Hashes of so many texts are sent to every executor to pick the texts; more of them are joined, with the copies of one
#: text dealt to SALTS parts before one of them is taken.
MAX_SENT, SALTS = 500_000, 32
_WAYS = np.random.default_rng(11).integers(0, 1 << 63, (2, POSITIONS), dtype=U) * U(2) + U(1)


def shingle_hashes(text: bytes | None, width: int) -> np.ndarray:
    """Distinct hashes of the text's word shingles; fewer words than ``width`` are one shingle."""
    ws = (text or b"").lower().split()
    if not ws:
        return np.zeros(0, dtype=U)
    width = min(width, len(ws))
    flat = b" ".join(ws)
    ends = np.cumsum(np.fromiter(map(len, ws), dtype=np.int64, count=len(ws)) + 1) - 1
    starts = np.append(0, ends[:-1] + 1)[: len(ws) - width + 1]
    h = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((h(flat[a:b], SEED) for a, b in zip(starts.tolist(), ends[width - 1 :].tolist(), strict=True)), dtype=U, count=len(starts)))


def wide_fingerprint(hashes: np.ndarray) -> np.ndarray:
    """A byte for each sample; all zero for no shingles."""
    if not len(hashes):
        return np.zeros(POSITIONS, dtype=np.uint8)
    least = np.full(POSITIONS, ~U(0), dtype=U)
    for i in range(0, len(hashes), 4096):
        ranks = (hashes[i : i + 4096, None] ^ _WAYS[0]) * _WAYS[1]
        np.minimum(least, ranks.min(axis=0), out=least)
    return (least & U(0xFF)).astype(np.uint8)


def _wide(rows: DataFrame, width: int) -> DataFrame:
    """(h, fp) of ``rows(h, t)``."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                yield pd.DataFrame({"h": b["h"], "fp": [wide_fingerprint(shingle_hashes(t, width)).tobytes() for t in b["t"]]})

    return rows.mapInPandas(each, "h long, fp binary")


def _postings(nodes: DataFrame) -> DataFrame:
    """(key, h) of ``nodes(h, fp)``: a key is the place of a run and its bytes."""
    run = lambda i: F.conv(F.hex(F.substring("fp", RUN * i + 1, RUN)), 16, 10).cast("long")
    return nodes.select(F.explode(F.array(*(run(i) + F.lit(i << 8 * RUN) for i in range(RUNS)))).alias("key"), "h")


def _shared(postings: DataFrame) -> DataFrame:
    """(key, h, n) of the postings of lists with n > 1 entries; most keys have one entry, and only their counts are shuffled."""
    lists = postings.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").withColumnRenamed("key", "k_")
    return postings.join(lists, F.col("key") == F.col("k_")).select("key", "h", "n")


def _candidates(met: DataFrame) -> DataFrame:
    """Pairs a < b of ``met(key, h, n)`` that share a key: all in short lists, each with some hubs in long ones."""
    short = met.filter(F.col("n") <= LISTED).groupBy("key").agg(F.sort_array(F.collect_list("h")).alias("hs"))
    pairs = F.flatten(F.transform("hs", lambda a, i: F.transform(F.slice(F.col("hs"), i + 2, F.size("hs")), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    near = short.select(F.explode(pairs).alias("p")).select("p.a", "p.b")
    long_ = met.filter(F.col("n") > LISTED)
    hubs = long_.groupBy("key").agg(*(F.min_by("h", F.xxhash64("h", F.lit(i))).alias(f"hub{i}") for i in range(HUBS))).withColumnRenamed("key", "k_")
    far = long_.join(hubs, F.col("key") == F.col("k_")).select("h", F.explode(F.array(*(f"hub{i}" for i in range(HUBS)))).alias("hub")).filter("h <> hub")
    return near.unionByName(far.select(F.least("h", "hub").alias("a"), F.greatest("h", "hub").alias("b"))).distinct()


def _tallied(pairs: DataFrame, fps: DataFrame) -> DataFrame:
    """Pairs of enough equal bytes."""
    one, other = (fps.select(F.col("h").alias(f"h_{x}"), F.col("fp").alias(f"fp_{x}")) for x in "ab")
    joined = pairs.join(one, F.col("a") == F.col("h_a")).join(other, F.col("b") == F.col("h_b")).select("a", "b", "fp_a", "fp_b")

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                x, y = (np.frombuffer(b"".join(b[c]), dtype=np.uint8).reshape(-1, POSITIONS) for c in ("fp_a", "fp_b"))
                yield b.loc[(x == y).sum(axis=1) >= LEAST_EQUAL, ["a", "b"]]

    return joined.mapInPandas(each, "a long, b long")


def _verified(pairs: DataFrame, texts: DataFrame, width: int, share: float) -> DataFrame:
    """Pairs whose sets of shingles have a Jaccard similarity of ``share`` or more."""
    one, other = (texts.select(F.col("h").alias(f"h_{x}"), F.col("t").alias(f"t_{x}")) for x in "ab")
    joined = pairs.join(one, F.col("a") == F.col("h_a")).join(other, F.col("b") == F.col("h_b")).select("a", "b", "t_a", "t_b")

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            alike = [_is_similar(shingle_hashes(x, width), shingle_hashes(y, width), share) for x, y in zip(b["t_a"], b["t_b"], strict=True)]
            yield b.loc[np.array(alike, dtype=bool), ["a", "b"]]

    return joined.mapInPandas(each, "a long, b long")


def _is_similar(x: np.ndarray, y: np.ndarray, share: float) -> bool:
    """Whether two sets of hashes have a Jaccard similarity of ``share`` or more."""
    if min(len(x), len(y)) < share * max(len(x), len(y)):
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both >= share * (len(x) + len(y) - both)


class _Cell:
    """Two blocks of a posting list, and the pairs between them that may be links.

    Of the entries, ``x`` are outsiders and ``y`` any.  A pair has different roots
    and enough equal bytes, and belongs to the first key that its texts share: it
    is looked at there alone.
    """

    def __init__(self, group: pd.DataFrame):
        outside = (group["root"] != group["main"]).to_numpy()
        any_ = (group["side"] == 1).to_numpy()
        masks = outside & (~any_ | (group["own_x"] == group["x"]).to_numpy()), any_
        self.x, self.y = (group[m] for m in masks)
        self.known, labels = np.unique(group["root"].to_numpy(), return_inverse=True)
        self.mine, self.theirs = (labels[m] for m in masks)
        self.at = self.to = np.zeros(0, dtype=np.int64)
        if len(self.x) and len(self.y):
            self._tally(int(group["key"].iat[0]) >> (8 * RUN), int(group["main"].iat[0]))

    def _tally(self, place: int, main: int) -> None:
        fps, others = (np.frombuffer(b"".join(v["fp"]), dtype=np.uint8).reshape(-1, POSITIONS) for v in (self.x, self.y))
        runs, others_runs = (np.ascontiguousarray(f[:, : RUN * RUNS]).view(f"<u{RUN}") for f in (fps, others))
        h, others_h = self.x["h"].to_numpy(), self.y["h"].to_numpy()
        in_main = self.y["root"].to_numpy() == main
        found = []
        for i in range(0, len(fps), 32):
            same = (fps[i : i + 32, None, :] == others[None, :, :]).sum(axis=2, dtype=np.int16)
            x, y = np.nonzero(same >= LEAST_EQUAL)
            n = same[x, y]
            x += i
            # two outsiders meet in either order, of which one counts
            own = (self.mine[x] != self.theirs[y]) & (in_main[y] | (h[x] < others_h[y]))
            x, y, n = x[own], y[own], n[own]
            first = (runs[x] == others_runs[y]).argmax(axis=1) == place
            found.append((x[first], y[first], n[first]))
        self.at, self.to, equal = (np.concatenate(v) for v in zip(*found, strict=True))
        order = np.argsort(-equal, kind="stable")
        self.at, self.to = self.at[order], self.to[order]

    def open_entries(self) -> pd.DataFrame:
        """Entries of any such pair."""
        return pd.concat([self.x.iloc[np.unique(self.at)], self.y.iloc[np.unique(self.to)]])[["key", "h"]].drop_duplicates()

    def links(self, share: float) -> pd.DataFrame:
        """Links (a, b) of a spanning forest over the groups known before: pairs are verified, the likeliest first, unless links found here join their groups."""
        parent = list(range(len(self.known)))

        def find(x: int) -> int:
            while parent[x] != x:
                parent[x] = x = parent[parent[x]]
            return x

        sets, others = self.x["s"].to_numpy(), self.y["s"].to_numpy()
        h, others_h = self.x["h"].to_numpy(), self.y["h"].to_numpy()
        found = []
        for x, y in zip(self.at.tolist(), self.to.tolist(), strict=True):
            p, q = find(self.mine[x]), find(self.theirs[y])
            if p != q and _is_similar(np.frombuffer(sets[x], dtype=U), np.frombuffer(others[y], dtype=U), share):
                parent[max(p, q)] = min(p, q)
                found.append((h[x], others_h[y]))
        pairs = np.array(found, dtype=np.int64).reshape(-1, 2)
        return pd.DataFrame({"a": pairs[:, 0], "b": pairs[:, 1]})


def _cells(entries: DataFrame, more: list[str]) -> DataFrame:
    """``entries(key, h, root, main, fp, size)`` dealt to pairs (x, y) of blocks of their lists: a block of outsiders and a block of any.

    An outsider is sent once to the pair in which both of its blocks are.
    """
    outside = F.col("root") != F.col("main")
    blocks = lambda total: F.greatest(F.ceil(F.coalesce(total, F.lit(0)) / BLOCK_BYTES), F.lit(1)).cast("int")
    sizes = entries.groupBy("key").agg(blocks(F.sum(F.when(outside, F.col("size")))).alias("n_x"), blocks(F.sum("size")).alias("n_y"))
    dealt = entries.join(sizes.withColumnRenamed("key", "k_"), F.col("key") == F.col("k_"))
    own = lambda n: F.pmod(F.xxhash64("h"), F.col(n)).cast("int")
    every = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    to_any = F.transform(every("n_x"), lambda i: F.struct(F.lit(1).alias("side"), i.alias("x"), own("n_y").alias("y")))
    to_others = F.transform(F.filter(every("n_y"), lambda i: i != own("n_y")), lambda i: F.struct(F.lit(0).alias("side"), own("n_x").alias("x"), i.alias("y")))
    places = F.explode(F.when(outside, F.concat(to_any, to_others)).otherwise(to_any)).alias("p")
    dealt = dealt.select("key", "h", "root", "main", "fp", *more, own("n_x").alias("own_x"), places).select("*", "p.*").drop("p")
    return dealt.repartition("key", "x", "y").groupBy("key", "x", "y")  # else all cells of a key stay where the join has put the key


def _texts_of(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """(h, t) of the ``wanted(w)`` texts, a written table of hashes, once each; partial sums or parts keep many copies of one text apart."""
    if wanted.count() <= MAX_SENT:
        met = rows.join(F.broadcast(wanted), F.col("h") == F.col("w"), "left_semi")
    else:
        spread = wanted.select("w", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt_w"))
        salted = rows.withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int"))
        met = salted.join(spread, (F.col("h") == F.col("w")) & (F.col("salt") == F.col("salt_w")), "left_semi")
    return met.groupBy("h").agg(F.first("t").alias("t"))


def _outsiders(met: DataFrame, nodes: DataFrame, rows: DataFrame, roots: DataFrame, width: int, share: float, scratch: Scratch) -> DataFrame:
    """Links (a, b) that the hubs of long posting lists left open.

    Most entries of a list are of one group by now.  All others are held against
    the whole list, block by block, so that every pair of different groups that
    shares a key is tallied, and those of enough equal bytes are verified: first
    only the fingerprints go to the pairs of blocks, then the sets of shingles of
    entries that have such a pair.  A pair of blocks is work of bounded size,
    whatever the length of the list, and gives links of a forest alone.
    """
    met = met.filter(F.col("n") > LISTED)
    met = scratch.save(met.join(roots, F.col("h") == F.col("node"), "left").select("key", "h", "n", F.coalesce("root", "h").alias("root")))
    shares = met.groupBy("key", "root").agg(F.count(F.lit(1)).alias("part"), F.first("n").alias("n"))
    main = shares.groupBy("key").agg(F.max_by("root", F.struct("part", "root")).alias("main"), (F.first("n") - F.max("part")).alias("r"))
    main = main.filter("r > 0").select(F.col("key").alias("k_"), "main")
    fps = nodes.select(F.col("h").alias("h_"), "fp")
    entries = met.join(main, F.col("key") == F.col("k_")).select("key", "h", "root", "main").join(fps, F.col("h") == F.col("h_")).drop("h_")
    entries = scratch.save(entries.withColumn("size", F.lit(POSITIONS + ROW_BYTES)))
    scratch.drop(met)
    open_ = scratch.save(_cells(entries, []).applyInPandas(lambda g: _Cell(g).open_entries(), "key long, h long"))
    same = [F.col("key") == F.col("k_"), F.col("h") == F.col("h_")]
    left = entries.drop("size").join(open_.distinct().select(F.col("key").alias("k_"), F.col("h").alias("h_")), same, "left_semi")
    left = scratch.save(left)
    wanted = scratch.save(left.select(F.col("h").alias("w")).distinct())
    texts = _texts_of(rows, wanted)

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"h_": b["h"], "s": [shingle_hashes(t, width).tobytes() for t in b["t"]]})

    sets = scratch.save(texts.mapInPandas(each, "h_ long, s binary"))
    scratch.drop(entries, open_)
    held = left.join(sets, F.col("h") == F.col("h_")).withColumn("size", F.length("s") + POSITIONS + ROW_BYTES)
    found = scratch.save(_cells(held, ["s"]).applyInPandas(lambda g: _Cell(g).links(share), "a long, b long"))
    scratch.drop(left, sets, wanted)
    return found


def similar_groups(docs: DataFrame, width: int = 5, share: float = 0.8) -> DataFrame:
    """(doc_id, h, root): documents of one root are linked by texts whose word shingles are similar to ``share`` or more.

    h is the hash of the text: copies are one node.  Texts without words, null
    ones too, are similar to each other and to no other text.
    """
    scratch = Scratch(docs.sparkSession)
    rows = docs.select("doc_id", F.xxhash64("text").alias("h"), F.coalesce("text", F.lit("")).cast("binary").alias("t"))
    ids = scratch.save(rows.select("doc_id", "h"))
    wide = scratch.save(_wide(rows.select("h", "t"), width))
    nodes = scratch.save(wide.groupBy("h").agg(F.first("fp").alias("fp")))
    scratch.drop(wide)
    postings = scratch.save(_postings(nodes))
    met = scratch.save(_shared(postings))
    scratch.drop(postings)
    pairs = scratch.save(_tallied(_candidates(met), nodes))
    wanted = scratch.save(pairs.select(F.col("a").alias("w")).unionByName(pairs.select(F.col("b").alias("w"))).distinct())
    texts = scratch.save(_texts_of(rows.select("h", "t"), wanted))
    links = scratch.save(_verified(pairs, texts, width, share))
    scratch.drop(pairs, texts, wanted)
    roots = connected_components(links, scratch)
    more = _outsiders(met, nodes, rows.select("h", "t"), roots, width, share, scratch)
    if not more.isEmpty():
        roots = connected_components(links.unionByName(more), scratch)
    scratch.drop(met, nodes)
    return ids.join(roots, F.col("h") == F.col("node"), "left").select("doc_id", "h", F.coalesce("root", "h").alias("root"))


def keep_one(docs: DataFrame, width: int = 5, share: float = 0.8) -> DataFrame:
    """``docs`` with one row of each group of similar documents, that of the least doc_id; all columns stay.

    A null doc_id stays only where no document of the group has one.  Of rows of
    one doc_id and text, one stays.
    """
    scratch = Scratch(docs.sparkSession)
    groups = scratch.save(similar_groups(docs, width, share))
    first = scratch.save(groups.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h")).alias("x")).select(F.col("x.doc_id").alias("kept_id__"), F.col("x.h").alias("kept_h__")))
    same = F.col("doc_id").eqNullSafe(F.col("kept_id__")) & (F.xxhash64("text") == F.col("kept_h__"))
    kept = docs.join(first, same, "left_semi")
    repeated = groups.groupBy("doc_id", "h").count().filter("count > 1").limit(1).count()
    return kept.dropDuplicates(["doc_id", "text"]) if repeated else kept
