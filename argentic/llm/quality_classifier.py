"""Quality classifier: supervised subword embeddings.

Words and character n-grams of a text are hashed to rows of one table of vectors; a
document is the mean of its vectors (and of PADDING zeros), and a softmax over two outputs gives the
score.  Trained by stochastic gradient descent in numpy on a bounded sample of
labelled rows, in one task; scoring needs one number for each table row, since
the mean of vectors times the output weights is the mean of their products.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import fold, load, small_batches
from ._features import char_grams, grouped, sums_by_row, word_grams

BITS = 16
GRAMS = (3, 5)
#: Parameters of training: labelled rows at most, chosen by a hash of their id; vector size; passes; step.
SAMPLE = 4000
#: Texts of more bytes are scored, but not learned from, so that the sample has a bound.
LONGEST = 1 << 18
VECTOR, PASSES, STEP = 12, 15, 0.5
#: So many features without effect count towards each mean: few features tell little.
PADDING = 100
THRESHOLD = 0.7


def _features(texts: list[bytes | None]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(bucket, piece, row of each piece) of all features, some texts at a time."""
    for rows, ends, data in grouped(texts):
        found = [word_grams(data, ends, BITS), *(char_grams(data, ends, n, BITS) for n in GRAMS)]
        yield np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found]), rows


def train(texts: list[bytes], labels: np.ndarray) -> tuple[np.ndarray, float]:
    """One number for each bucket, and the bias: the log-odds of label 1 are their mean over a text's features, plus the bias."""
    rng = np.random.default_rng(7)
    docs: list[tuple[np.ndarray, np.ndarray]] = []
    for t in texts:
        total = np.zeros(1 << BITS, dtype=np.float32)
        for bucket, _, _ in _features([t]):
            total += np.bincount(bucket, minlength=1 << BITS)
        ids = np.flatnonzero(total)
        docs.append((ids.astype(np.int32), (total[ids] / (total.sum() + PADDING)).astype(np.float32)))
    table = rng.uniform(-1 / VECTOR, 1 / VECTOR, (1 << BITS, VECTOR)).astype(np.float32)
    out, bias = np.zeros((VECTOR, 2), dtype=np.float32), np.zeros(2, dtype=np.float32)
    for done in range(PASSES):
        step = STEP * (1 - done / PASSES)
        for i in rng.permutation(len(docs)):
            ids, share = docs[i]
            mean = share @ table[ids]
            z = mean @ out + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[int(labels[i])] -= 1
            back = out @ p
            out -= step * np.outer(mean, p)
            bias -= step * p
            table[ids] -= (step * len(ids) ** 0.5) * share[:, None] * back
    logits = table @ out
    return (logits[:, 1] - logits[:, 0]).astype(np.float64), float(bias[1] - bias[0])


def fit(docs: DataFrame, labels: DataFrame, usable: Column, sample: int = SAMPLE) -> bytes:
    """The model learned from labelled rows where ``usable`` (a Boolean of doc_id) holds; labels other than 0 and 1 are left out.

    A document labelled both ways counts as 1.
    """
    small_batches(docs.sparkSession)
    labelled = labels.filter(usable & F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    chosen = labelled.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)  # the bound of the sample
    short = docs.filter(F.coalesce(F.octet_length("text"), F.lit(0)) <= LONGEST)
    texts = short.select("doc_id", F.col("text").cast("binary").alias("t")).join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.first("quality").alias("quality"), F.max("t").alias("t"))

    def learn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        frames = [b for b in batches if len(b)]
        if frames:
            rows = pd.concat(frames).sort_values("doc_id")
            scores, bias = train([t or b"" for t in rows["t"]], rows["quality"].to_numpy())
            yield pd.DataFrame({"model": [np.append(scores, bias).tobytes()]})

    found = texts.coalesce(1).mapInPandas(learn, "model binary").collect()
    return bytes(found[0]["model"]) if found else np.zeros((1 << BITS) + 1).tobytes()


def score_rows(docs: DataFrame, model: bytes) -> DataFrame:
    """``docs`` with score: 0 to 1, the probability of label 1; a text without features has the score of the bias."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size
    names = [c for c in docs.columns if c != "score"]
    schema = docs.select(*names).schema.add("score", "double")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values = np.frombuffer(shared.value)
        for b in batches:
            n = b.num_rows
            total, count = np.zeros(n), np.zeros(n)
            for bucket, piece, rows in _features(b.column(b.num_columns - 1).to_pylist()):
                total += sums_by_row(values[bucket], piece, rows, n)
                count += np.bincount(rows[piece], minlength=n)
            odds = total / (count + PADDING) + values[-1]
            score = 1 / (1 + np.exp(-np.clip(odds, -500, 500)))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(score)], [*names, "score"])

    return docs.select(*names, F.col("text").cast("binary").alias("__bytes__")).mapInArrow(each, schema)


def classify(docs: DataFrame, labels: DataFrame, learn_from=None) -> DataFrame:
    """``docs`` with score and predicted (1 if score >= THRESHOLD).

    ``learn_from``: Boolean column of doc_id, which labels may be used.  Null text
    counts as empty; rows without a usable label only get a score; without any
    label all scores are 0.5.  Extra columns stay; ones named score or predicted
    are replaced.
    """
    model = fit(docs, labels.select("doc_id", "quality"), F.lit(True) if learn_from is None else learn_from)
    return score_rows(docs.drop("predicted"), model).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def op9_quality(spark, sf_dir):
    held = fold(F.col("doc_id"), 4) == 2
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    scored = classify(docs, load(spark, sf_dir, "labels"), ~held)
    return scored.select("doc_id", held.alias("held_out"), "score", "predicted")
