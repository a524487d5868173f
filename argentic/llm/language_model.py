"""Language-model scores by deleted interpolation.

A token's probability mixes the maximum-likelihood estimates of the bigram, the
unigram and the uniform model.  The weights belong to the bucket of the context's
count (powers of two) and are learned by expectation-maximisation on held-out
counts: each training token is deleted from the counts before it is predicted.

Counts are exact and grow with the corpus, so they are never sent to one place.
Documents are read in chunks of tokens.  A chunk sends the distinct keys (64-bit
hashes) of its unigrams and bigrams, sorted and packed, to the buckets of a hash
partition; a bucket adds up the counts of all chunks and answers each chunk in
the order in which it asked.  So one shuffled row carries thousands of keys, a
frequent key is sent once a chunk, and no task holds more than a chunk or a
bucket.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._anchors import U, mix
from ._common import Scratch, fold, load

#: Tokens in a chunk, and keys in a bucket, as a rule at most.
CHUNK = 1 << 20
BUCKET_KEYS = 1 << 22
START, END = U(0), U(1)
#: Buckets of context counts: 0, then powers of two; cells of a probability's logarithm, 4 an octave, the last for zero.
CONTEXTS, CELLS = 34, 160


def _pack(x: np.ndarray) -> bytes:
    """Numbers as planes of bytes, compressed: high bytes of small numbers cost next to nothing."""
    planes = np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.itemsize).T
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def _unpack(b: bytes, kind: str) -> np.ndarray:
    flat = np.frombuffer(zstandard.ZstdDecompressor().decompress(b), dtype=np.uint8)
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(flat.reshape(size, -1).T).view(kind).ravel()


def _pack_sorted(keys: np.ndarray) -> bytes:
    return _pack(np.diff(keys, prepend=U(0)))


def _unpack_sorted(b: bytes) -> np.ndarray:
    return np.cumsum(_unpack(b, "<u8"), dtype=U)


def _ids(text: bytes | None) -> np.ndarray:
    """Keys of the tokens: words, with A-Z in small letters, and the end."""
    ws = (text or b"").lower().split()
    out = np.empty(len(ws) + 1, dtype=U)
    out[:-1] = np.fromiter(map(xxhash.xxh3_64_intdigest, ws), dtype=U, count=len(ws))
    out[-1] = END
    return out


PAYLOAD = "chunk long, doc_ids array<{kind}>, rows array<long>, held array<boolean>, sizes array<long>, before array<long>, keys binary, stream binary"


def _chunks(docs: DataFrame, held) -> DataFrame:
    """Documents as chunks: pieces of documents, the distinct token keys, and the tokens as places among them.

    before: key of the token before a piece, START at a document's start.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        draw = random.SystemRandom()
        pieces, n = [], 0
        doc_type = None

        def chunk():
            tokens = np.concatenate([p[4] for p in pieces])
            ids = np.concatenate([tokens, np.array([p[3] for p in pieces], dtype=U)])  # contexts of cut documents are looked up too
            keys, places, counts = np.unique(ids, return_inverse=True, return_counts=True)
            order = np.argsort(-counts, kind="stable")  # frequent keys get small numbers, which pack well
            rank = np.empty(len(keys), dtype=np.uint32)
            rank[order] = np.arange(len(keys), dtype=np.uint32)
            columns = [
                pa.array([draw.getrandbits(62)]),
                pa.array([[p[0] for p in pieces]], type=pa.list_(doc_type)),
                pa.array([[p[1] for p in pieces]], type=pa.list_(pa.int64())),
                pa.array([[p[2] for p in pieces]], type=pa.list_(pa.bool_())),
                pa.array([[len(p[4]) for p in pieces]], type=pa.list_(pa.int64())),
                pa.array([np.array([p[3] for p in pieces], dtype=U).view(np.int64)], type=pa.list_(pa.int64())),
                pa.array([keys[order].tobytes()], type=pa.binary()),
                pa.array([_pack(rank[places.ravel()[: len(tokens)]])], type=pa.binary()),
            ]
            return pa.RecordBatch.from_arrays(columns, ["chunk", "doc_ids", "rows", "held", "sizes", "before", "keys", "stream"])

        for b in batches:
            doc_type = b.schema.field(0).type
            for doc_id, out, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                row, ids, before = draw.getrandbits(62), _ids(text.as_py()), START
                at = 0
                while at < len(ids):
                    part = ids[at : at + CHUNK - n]
                    pieces.append((doc_id, row, out, before, part))
                    before, at, n = part[-1], at + len(part), n + len(part)
                    if n >= CHUNK:
                        yield chunk()
                        pieces, n = [], 0
        if pieces:
            yield chunk()

    rows = docs.select("doc_id", held.alias("held"), F.col("text").cast("binary").alias("t"))
    return rows.mapInArrow(each, PAYLOAD.format(kind=kind))


class _Chunk:
    """A row of _chunks, unpacked."""

    def __init__(self, row: dict):
        self.keys = np.frombuffer(row["keys"], dtype="<u8")
        self.stream = _unpack(row["stream"], "<u4")
        self.sizes = np.array(row["sizes"], dtype=np.int64)
        self.first = np.cumsum(self.sizes) - self.sizes
        self.before = np.array(row["before"], dtype=np.int64).view(U)
        self.train = np.repeat(~np.array(row["held"], dtype=bool), self.sizes)

    def contexts(self) -> np.ndarray:
        out = np.empty(len(self.stream), dtype=U)
        out[1:] = self.keys[self.stream[:-1]]
        out[self.first] = self.before
        return out

    def bigrams(self) -> tuple[np.ndarray, np.ndarray]:
        pairs = mix(self.contexts() * U(0x9E3779B97F4A7C15) + mix(self.keys)[self.stream])
        keys, places = np.unique(pairs, return_inverse=True)
        return keys, places.ravel()


def _bucket_edges(buckets: int) -> np.ndarray:
    return np.array([(i << 64) // buckets for i in range(1, buckets)], dtype=U)


def _questions(chunks: DataFrame, buckets: int) -> DataFrame:
    """A row for each chunk and bucket in which it has keys: these and how often they occur in training documents.

    A chunk has no more rows than keys, so there are never more rows than tokens, however many buckets the corpus asks for.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges = _bucket_edges(buckets)
        for b in batches:
            for row in b.to_pylist():
                c = _Chunk(row)
                order = np.argsort(c.keys)
                once = np.bincount(c.stream[c.train], minlength=len(c.keys))[order]
                pairs, places = c.bigrams()
                twice = np.bincount(places[c.train], minlength=len(pairs))
                cut = {n: np.concatenate([[0], np.searchsorted(k, edges), [len(k)]]) for n, k in (("1", c.keys[order]), ("2", pairs))}
                full = np.flatnonzero(np.diff(cut["1"]) + np.diff(cut["2"]))
                out = {"chunk": [row["chunk"]] * len(full), "bucket": full}
                for name, keys, counts in (("1", c.keys[order], once), ("2", pairs, twice)):
                    cells = [slice(a, z) for a, z in zip(cut[name][full], cut[name][full + 1], strict=True)]
                    out["k" + name] = [_pack_sorted(keys[x]) for x in cells]
                    out["n" + name] = [_pack(counts[x].astype("<u4")) for x in cells]
                yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("chunk", pa.int64()), ("bucket", pa.int64()), *((f"{x}{i}", pa.binary()) for i in "12" for x in "kn")]))

    needed = chunks.select("chunk", "held", "sizes", "before", "keys", "stream")
    return needed.mapInArrow(each, "chunk long, bucket long, k1 binary, n1 binary, k2 binary, n2 binary")


def _answer(group: pd.DataFrame) -> pd.DataFrame:
    """Corpus counts of one bucket's keys, for each chunk in its own order; the first row tells the bucket's tokens and types."""
    out = {"chunk": group["chunk"], "bucket": group["bucket"], "tokens": 0, "types": 0}
    for name in "12":
        keys = [_unpack_sorted(x) for x in group["k" + name]]
        counts = np.concatenate([_unpack(x, "<u4") for x in group["n" + name]])
        unique, places = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.bincount(places.ravel(), weights=counts, minlength=len(unique)).astype(np.int64)
        ends = np.cumsum([len(k) for k in keys])
        out["c" + name] = [_pack(x.astype("<u8")) for x in np.split(total[places.ravel()], ends[:-1])]
        if name == "1":
            first = np.arange(len(group)) == 0
            out["tokens"] = np.where(first, total.sum(), 0)
            out["types"] = np.where(first, (total > 0).sum(), 0)
    return pd.DataFrame(out)[["chunk", "bucket", "tokens", "types", "c1", "c2"]]


def _resolve(chunks: DataFrame, answers: DataFrame) -> DataFrame:
    """Chunks with the corpus counts: ``once`` of each of its keys, ``twice`` of each token's bigram."""
    per_chunk = answers.groupBy("chunk").agg(F.collect_list(F.struct("bucket", "c1", "c2")).alias("answers"))
    joined = chunks.join(per_chunk, "chunk")
    kept = ["doc_ids", "rows", "held", "sizes", "before", "stream"]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in chunks.schema if f.name in kept) + ", once binary, twice binary, starts binary"

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                row = b.slice(i, 1)
                r = {k: row.column(k)[0].as_py() for k in ("held", "sizes", "before", "keys", "stream", "answers")}
                c, got = _Chunk(r), sorted(r["answers"], key=lambda x: x["bucket"])
                once = np.empty(len(c.keys), dtype="<u8")
                once[np.argsort(c.keys)] = np.concatenate([_unpack(x["c1"], "<u8") for x in got])
                twice = np.concatenate([_unpack(x["c2"], "<u8") for x in got])[c.bigrams()[1]]
                order = np.argsort(c.keys)
                starts = once[order[np.searchsorted(c.keys[order], c.before)]]
                columns = [row.column(k) for k in kept] + [pa.array([_pack(x)], type=pa.binary()) for x in (once, twice, starts)]
                yield pa.RecordBatch.from_arrays(columns, [*kept, "once", "twice", "starts"])

    return joined.mapInArrow(each, schema)


def _estimates(row: dict, tokens: int, ends: int, deleted: bool):
    """(context bucket, bigram estimate, unigram estimate, unigram count) of each token; ``deleted``: without the token itself."""
    once, twice = _unpack(row["once"], "<u8").astype(np.int64), _unpack(row["twice"], "<u8").astype(np.int64)
    stream = _unpack(row["stream"], "<u4")
    sizes = np.array(row["sizes"], dtype=np.int64)
    first = np.cumsum(sizes) - sizes
    known = once[stream]
    context = np.empty(len(stream), dtype=np.int64)
    context[1:] = known[:-1]
    before = np.array(row["before"], dtype=np.int64).view(U)
    context[first] = np.where(before == START, ends, _unpack(row["starts"], "<u8").astype(np.int64))
    one = int(deleted)
    context = np.maximum(context - one, 0)
    bigram = np.where(context > 0, np.maximum(twice - one, 0) / np.maximum(context, 1), 0.0)
    unigram = np.maximum(known - one, 0) / max(tokens - one, 1)
    bucket = np.zeros(len(stream), dtype=np.int64)
    bucket[context > 0] = np.minimum(np.log2(context[context > 0]).astype(np.int64) + 1, CONTEXTS - 1)
    return bucket, bigram, unigram, known


def _cell(p: np.ndarray) -> np.ndarray:
    out = np.full(len(p), CELLS - 1, dtype=np.int64)
    out[p > 0] = np.minimum(np.floor(-4 * np.log2(p[p > 0])).astype(np.int64), CELLS - 2)
    return out


def learn_weights(cells: np.ndarray, counts: np.ndarray, types: int, rounds: int = 200) -> np.ndarray:
    """Weights [bucket, (bigram, unigram, uniform)] by expectation-maximisation over the cells of deleted tokens."""
    value = np.append(2.0 ** (-(np.arange(CELLS - 1) + 0.5) / 4), 0.0)
    value[0] = 1.0
    bucket, p2, p1 = cells // CELLS**2, value[cells // CELLS % CELLS], value[cells % CELLS]
    p = np.stack([p2, p1, np.full(len(cells), 1 / (types + 1))], axis=1)
    weights = np.tile([0.4, 0.4, 0.2], (CONTEXTS, 1))
    weights[0] = [0.0, 0.8, 0.2]
    for _ in range(rounds):
        share = weights[bucket] * p
        share *= (counts / np.maximum(share.sum(axis=1), 1e-300))[:, None]
        new = np.stack([np.bincount(bucket, weights=share[:, i], minlength=CONTEXTS) for i in range(3)], axis=1)
        seen = new.sum(axis=1) > 0
        before = weights.copy()
        weights[seen] = new[seen] / new[seen].sum(axis=1, keepdims=True)
        if np.abs(weights - before).max() < 1e-7:
            break
    weights[:, 2] = np.maximum(weights[:, 2], 1e-6)  # no token is impossible
    return weights / weights.sum(axis=1, keepdims=True)


def score_documents(docs: DataFrame, held) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of all documents.

    ``held`` is a Boolean column of docs: rows to learn nothing from.  Null and
    blank texts are one token, the end.  Every row gets its own result, repeated
    ones too.  With nothing to learn from, every token has the uniform
    probability of a vocabulary of none, 1.  Other columns are not read.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession)
    held = F.coalesce(held, F.lit(False))
    kind = docs.schema["doc_id"].dataType.simpleString()
    chunks = scratch.save(_chunks(docs, held), packed=True)
    size = chunks.agg(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, b: a + b))).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // BUCKET_KEYS))
    answers = scratch.save(_questions(chunks, buckets).groupBy("bucket").applyInPandas(_answer, "chunk long, bucket long, tokens long, types long, c1 binary, c2 binary"), packed=True)
    tokens, types = (x or 0 for x in answers.agg(F.sum("tokens"), F.sum("types")).first())
    resolved = scratch.save(_resolve(chunks, answers), packed=True)
    scratch.drop(chunks, answers)
    ends = docs.filter(~held).count()

    def cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for row in b.to_dict("records"):
                bucket, bigram, unigram, _ = _estimates(row, tokens, ends, True)
                train = np.repeat(~np.array(row["held"], dtype=bool), np.array(row["sizes"], dtype=np.int64))
                cell, n = np.unique(((bucket * CELLS + _cell(bigram)) * CELLS + _cell(unigram))[train], return_counts=True)
                yield pd.DataFrame({"cell": cell, "n": n})

    found = resolved.select("held", "sizes", "before", "stream", "once", "twice", "starts").mapInPandas(cells, "cell long, n long")
    table = found.groupBy("cell").agg(F.sum("n").alias("n")).toPandas()  # CONTEXTS * CELLS**2 rows at most
    weights = learn_weights(table["cell"].to_numpy(np.int64), table["n"].to_numpy(np.float64), types)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                row = b.slice(i, 1)
                r = {k: row.column(k)[0].as_py() for k in ("sizes", "before", "stream", "once", "twice", "starts")}
                bucket, bigram, unigram, known = _estimates(r, tokens, ends, False)
                w = weights[bucket]
                p = w[:, 0] * bigram + w[:, 1] * unigram + w[:, 2] / (types + 1)
                sizes = np.array(r["sizes"], dtype=np.int64)
                first = np.cumsum(sizes) - sizes
                total = lambda x, first=first: np.add.reduceat(x, first)
                columns = [row.column(k).flatten() for k in ("doc_ids", "rows", "held")]
                columns += [pa.array(sizes), pa.array(total((known > 0).astype(np.int64)))]
                columns += [pa.array(total(np.log10((known + 1) / (tokens + types + 1)))), pa.array(total(np.log10(p)))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "row", "held_out", "n_tokens", "n_known", "base_score", "score"])

    pieces = resolved.mapInArrow(score, f"doc_id {kind}, row long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    sums = [F.sum(c).alias(c) for c in ("n_tokens", "n_known", "base_score", "score")]
    return pieces.groupBy("doc_id", "row", "held_out").agg(*sums).select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), "base_score", "score"
    )


def op8_language_model(spark, sf_dir):
    docs = load(spark, sf_dir, "documents")
    return score_documents(docs, fold(F.col("doc_id"), 7) == 2)
