"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trigflow.llm.arrow import sliced, texts

#: Bound on the labelled rows that the classifier is fitted on.
TRAIN_ROWS = 6_000
GRAMS = (2, 3, 4, 5)
BITS = 18
ROUNDS = 60
RATE = 0.5
PENALTY = 1e-6
SMOOTHING = 1.0
THRESHOLD = 0.7
#: Documents whose gradients are added up at once.
CHUNK = 128


class Features:
    """Hashed character n-grams of a text, each once. Letters A-Z are lower-cased, white space is one blank."""

    def __init__(self, grams=GRAMS, bits: int = BITS):
        self.grams, self.shift = grams, np.uint32(32 - bits)
        self.mark = np.zeros(1 << bits, np.int32)

    def of(self, text: bytes) -> np.ndarray:
        a = np.frombuffer(b" " + b" ".join(text.lower().split()) + b" ", np.uint8).astype(np.uint32)
        rolled, out = np.zeros(len(a), np.uint32), []
        for n in range(1, max(self.grams) + 1):
            if len(a) < n:
                break
            rolled = rolled[:len(a) - n + 1] * np.uint32(0x01000193)
            rolled += a[n - 1:]
            rolled += np.uint32(1)
            if n in self.grams:
                x = rolled ^ np.uint32(n * 0x9E3779B1 & 0xFFFFFFFF)
                x *= np.uint32(0x85EBCA6B)
                x ^= x >> np.uint32(15)
                x *= np.uint32(0xC2B2AE35)
                x >>= self.shift
                out.append(x)
        every = np.concatenate(out)
        place = np.arange(len(every), dtype=np.int32)
        self.mark[every] = place
        return every[self.mark[every] == place]


def fit(rows: list[tuple[bytes, int]], grams=GRAMS, bits: int = BITS, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, float]:
    """Log-count ratios, weights times ratios, and bias of a logistic regression on scaled, normalised features.

    With one class only, the ratios and weights are zero and the bias is the smoothed share of that class.
    """
    size, make = 1 << bits, Features(grams, bits)
    y = np.array([label for _, label in rows], np.float64)
    positive, negative = y.sum(), (1 - y).sum()
    if not positive or not negative:
        zero = np.zeros(size, np.float32)
        return zero, zero, float(np.log((positive + 1) / (negative + 1)))
    found = [make.of(text) for text, _ in rows]
    counts = np.full((2, size), SMOOTHING)
    for f, label in zip(found, y):
        counts[int(label)][f] += 1
    ratio = (np.log(counts[1] / (positive + 2 * SMOOTHING)) - np.log(counts[0] / (negative + 2 * SMOOTHING)))
    ratio = ratio.astype(np.float32)
    norms = np.array([1 / np.sqrt(np.square(ratio[f], dtype=np.float64).sum() + 1e-9) for f in found])
    weights, bias = np.zeros(size), 0.0
    squares, bias_square = np.full(size, 1e-8), 1e-8
    blocks = [range(at, min(at + CHUNK, len(rows))) for at in range(0, len(rows), CHUNK)]
    for _ in range(rounds):
        scaled = (weights * ratio).astype(np.float32)
        gradient, slope = PENALTY * weights, 0.0
        for block in blocks:
            z = np.array([scaled[found[i]].sum(dtype=np.float64) * norms[i] + bias for i in block])
            g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[block.start:block.stop]) / len(rows)
            index = np.concatenate([found[i] for i in block])
            each = np.repeat(g * norms[block.start:block.stop], [len(found[i]) for i in block])
            gradient += np.bincount(index, ratio[index] * each, minlength=size)
            slope += g.sum()
        squares += gradient * gradient
        weights -= RATE * gradient / np.sqrt(squares)
        bias_square += slope * slope
        bias -= RATE * slope / np.sqrt(bias_square)
    return ratio, (weights * ratio).astype(np.float32), float(bias)


def held_out(c):
    """Rows that the fit never sees: crc32 of the id's text is 1 modulo 3; a NULL id is not held out."""
    return F.coalesce(F.crc32(c.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "toxic", rows: int = TRAIN_ROWS) -> bytes:
    """The fitted model as bytes: 4-byte ratios, 4-byte weights, 8-byte bias.

    Fitted in one task on at most ``rows`` labelled rows that are not held out, chosen by a hash
    of the id. An id with several labels counts with its largest; NULL labels are void; the
    text of a repeated id is its smallest. Without such rows every score is 0.5.
    """
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(F.col(id_col)))
    chosen = (known.groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).cast("int").alias("_label"))
              .orderBy(F.xxhash64("_id"), "_id").limit(rows))  # at most `rows` rows, so safe to broadcast
    sample = (docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
              .join(F.broadcast(chosen), "_id").groupBy("_id", "_label").agg(F.min("_text").alias("_text")))

    def run(batches):
        seen = [(i, t, y) for b in batches
                for i, t, y in zip(b.column(0).to_pylist(), texts(b.column(1)), b.column(2).to_pylist())]
        ratio, weights, bias = fit([(t, y) for _, t, y in sorted(seen)])
        data = ratio.tobytes() + weights.tobytes() + np.float64(bias).tobytes()
        yield pa.RecordBatch.from_arrays([pa.array([data], pa.binary())], names=["model"])

    fitted = sample.select("_id", "_text", "_label").coalesce(1).mapInArrow(run, "model binary").first()
    return bytes(fitted["model"]) if fitted else bytes((8 << BITS) + 8)  # without a row to learn from


def score(docs: DataFrame, model: bytes, id_col: str = "doc_id", text_col: str = "text",
          threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) of each row; NULL and empty texts are scored like a blank.

    The model has a fixed size of a few megabytes, so every task can hold it.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    size = 1 << BITS

    def run(batches):
        data = shared.value
        ratio = np.frombuffer(data, np.float32, size)
        weights = np.frombuffer(data, np.float32, size, 4 * size)
        bias = float(np.frombuffer(data, np.float64, 1, 8 * size)[0])
        square, make = ratio * ratio, Features()

        def one(text: bytes) -> float:
            f = make.of(text)
            z = weights[f].sum(dtype=np.float64) / np.sqrt(square[f].sum(dtype=np.float64) + 1e-9) + bias
            return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            scores = pa.array([one(t) for t in texts(batch.column(2))], pa.float64())
            return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), scores], names=["doc_id", "held_out", "score"])

        yield from sliced(work, 2)(batches)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(F.col(id_col)).alias("held_out"),
                       F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double").withColumn(
        "predicted", (F.col("score") >= threshold).cast("int"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity scores of all ``documents`` from ``labels`` that are not held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
