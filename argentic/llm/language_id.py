"""Language identification: multinomial naive Bayes over hashed character n-grams.

Learned from a bounded sample of labelled documents in one task; the matrix of
log-probabilities, of fixed size, is broadcast, and batches of documents are
scored in numpy.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import fold, load, small_batches
from ._features import char_grams, grouped, sums_by_row

BITS = 15
GRAMS = (2, 4)
#: Labelled documents that the model is learned from, at most, chosen by a hash of their id.
SAMPLE = 6000
#: Texts of more bytes are not learned from, so that the sample has a bound.
LONGEST = 1 << 18
#: Added to every count.
PRIOR = 0.5
UNKNOWN = "und"


def _features(texts: list[bytes | None]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    for rows, ends, data in grouped(texts):
        found = [char_grams(data, ends, n, BITS) for n in GRAMS]
        yield np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found]), rows


def train(texts: list[bytes | None], langs: list[str]) -> tuple[list[str], np.ndarray]:
    """(languages, log-probabilities [bucket + 1, language]); the last row has the log-priors."""
    names = sorted(set(langs))
    place = {x: i for i, x in enumerate(names)}
    counts = np.full((len(names), 1 << BITS), PRIOR)
    priors = np.zeros(len(names))
    for text, lang in zip(texts, langs, strict=True):
        priors[place[lang]] += 1
        for bucket, _, _ in _features([text]):
            counts[place[lang]] += np.bincount(bucket, minlength=1 << BITS)
    logs = np.log(counts / counts.sum(axis=1, keepdims=True))
    return names, np.vstack([logs.T, np.log(priors / priors.sum())]).astype(np.float32)


def fit(docs: DataFrame, usable: Column, sample: int = SAMPLE) -> tuple[list[str], bytes]:
    small_batches(docs.sparkSession)
    rows = docs.filter(usable & F.col("lang").isNotNull() & (F.octet_length("text") <= LONGEST))
    ids = rows.select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).distinct()  # the bound of the sample
    texts = rows.join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.max(F.struct("lang", "text")).alias("x"))
    texts = texts.select("doc_id", "x.lang", F.col("x.text").cast("binary").alias("t"))

    def learn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        frames = [b for b in batches if len(b)]
        if frames:
            rows_ = pd.concat(frames).sort_values("doc_id")
            names, matrix = train(rows_["t"].tolist(), rows_["lang"].tolist())
            yield pd.DataFrame({"names": [json.dumps(names)], "model": [matrix.tobytes()]})

    found = texts.coalesce(1).mapInPandas(learn, "names string, model binary").collect()
    return (json.loads(found[0]["names"]), bytes(found[0]["model"])) if found else ([], b"")


def identify(docs: DataFrame, learn_from=None) -> DataFrame:
    """(doc_id, lang_pred, score): the likeliest language and its posterior probability.

    ``learn_from``: Boolean column of doc_id, which rows may be learned from.
    UNKNOWN with score 0 where the text is null or has no letter, and everywhere
    if nothing can be learned.  Every row gets its own result.
    """
    names, model = fit(docs.select("doc_id", "text", "lang"), F.lit(True) if learn_from is None else learn_from)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # buckets x languages, a language for each sampled row at most
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letters"), F.col("text").cast("binary").alias("t"))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matrix = np.frombuffer(shared.value, dtype=np.float32).reshape(-1, max(len(names), 1))
        for b in batches:
            n = b.num_rows
            letters = b.column(1).to_numpy(zero_copy_only=False).astype(bool) & bool(names)
            if not names:
                best, score = np.zeros(n, dtype=int), np.zeros(n)
            else:
                logs = np.tile(matrix[-1].astype(np.float64), (n, 1))
                for bucket, piece, at in _features(b.column(2).to_pylist()):
                    logs += sums_by_row(matrix[bucket], piece, at, n)
                best = logs.argmax(axis=1)
                score = 1 / np.exp(logs - logs.max(axis=1, keepdims=True)).sum(axis=1)
            pred = [names[i] if ok else UNKNOWN for i, ok in zip(best, letters, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(pred, type=pa.string()), pa.array(np.where(letters, score, 0.0))], ["doc_id", "lang_pred", "score"])

    return rows.mapInArrow(each, f"doc_id {kind}, lang_pred string, score double")


def op10_language_id(spark, sf_dir):
    held = fold(F.col("doc_id"), 4) == 2
    found = identify(load(spark, sf_dir, "documents"), ~held)
    return found.select("doc_id", held.alias("held_out"), "lang_pred", "score")
