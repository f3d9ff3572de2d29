"""Quality classifier: supervised subword embeddings.

Words and their character n-grams hash into a table of learned vectors; a
document is the mean of the vectors of its features, a softmax layer gives
class probabilities, and both are trained by plain numpy stochastic gradient
descent.  Because the layer is linear in the mean, scoring needs one number
per bucket: its vector times the difference of the class weights.

Training rows are a bounded sample (``max_train`` labelled rows with the
smallest hash of their id), so the driver's share doesn't grow with the input.
Scoring covers every row and the whole text.

Nulls: null texts score like empty ones; an empty text has only the class bias
(a finite score).  Labelled rows with null ids or labels other than 0 and 1
aren't learned from.  Without any usable label every score is 0.5.  Repeated
rows are scored alike; an empty table gives an empty result.  Very long texts are
scored whole.  Only key and text are read for scores, so other columns may have
any names; ``keep_good`` returns all columns as they are.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import by_bytes
from .common import bound_batches, tidy

BUCKETS = 1 << 18
DIM = 12
#: a feature of its own for a word that repeats the word before it: an addition to the plain method
SAME = b"\x00same"
#: neutral features that each text has besides, so that few words decide little: an addition too
PRIOR = 30
MEMO = 200_000


def word_features(word: str, buckets: int = BUCKETS) -> list[int]:
    """Buckets of a word and its character 3- and 4-grams."""
    w = b"<" + word.encode("utf-8", "surrogatepass") + b">"
    crc = zlib.crc32
    out = [crc(w)]
    out += [crc(w[i : i + 3]) for i in range(len(w) - 2)]
    out += [crc(w[i : i + 4]) for i in range(len(w) - 3)]
    return [x % buckets for x in out]


class WordMemo(dict):
    """Word -> sum of its features' scores + 1j x their number; emptied when full,
    long words aren't kept."""

    def __init__(self, table: np.ndarray):
        self.table = table

    def __missing__(self, word: str) -> complex:
        if len(self) >= MEMO:
            self.clear()
        feats = word_features(word, len(self.table))
        out = complex(float(self.table[feats].sum()), len(feats))
        if len(word) <= 64:
            self[word] = out
        return out


@dataclass
class Model:
    """Learned numbers; ``bucket_score`` and ``bias`` are all that scoring needs."""

    bucket_score: np.ndarray
    bias: float
    memo: WordMemo | None = field(default=None, repr=False)

    def __getstate__(self):
        return {"bucket_score": self.bucket_score, "bias": self.bias}

    def __setstate__(self, state):
        self.__dict__.update(state, memo=None)

    def scores(self, texts: list[str]) -> np.ndarray:
        """Probability of class 1 for each text."""
        table = self.bucket_score
        if self.memo is None:
            self.memo = WordMemo(table)
        look, same = self.memo.__getitem__, float(table[zlib.crc32(SAME) % len(table)])
        out = np.empty(len(texts))
        for n, text in enumerate(texts):
            words = text.split()
            got = np.fromiter(map(look, words), np.complex128, len(words)).sum()
            again = sum(map(str.__eq__, words[1:], words))
            out[n] = (got.real + again * same) / (got.imag + again + PRIOR) + self.bias
        return 1 / (1 + np.exp(-np.clip(out, -50, 50)))


def _counted(text: str, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct feature buckets of a text and their shares."""
    words, seen, all_ = text.split(), {}, []
    for w in words:
        if w not in seen:
            seen[w] = word_features(w, buckets)
        all_ += seen[w]
    all_ += [zlib.crc32(SAME) % buckets] * sum(map(str.__eq__, words[1:], words))
    ids, n = np.unique(np.array(all_, np.int64), return_counts=True)
    return ids, (n / (PRIOR + n.sum())).astype(np.float32)


def train(
    texts: list[str], labels: list[int], epochs: int = 8, rate: float = 1.0, buckets: int = BUCKETS, dim: int = DIM, seed: int = 7
) -> Model:
    """Stochastic gradient descent over documents in a new order each epoch,
    the rate falling linearly to zero.  Class weights even out the labels.

    A run that ends with a loss on its own rows above that of knowing nothing
    (or none at all) has diverged: it starts anew at half the rate, down to a
    1024th of it; if all diverge, every score is 0.5."""
    y = np.array(labels, np.int64)
    if not len(y):
        return Model(np.zeros(buckets), 0.0)
    rows = [_counted(t, buckets) for t in texts]
    for halvings in range(11):
        with np.errstate(over="ignore", invalid="ignore"):
            vectors, out, bias = _descend(rows, y, epochs, rate / 2**halvings, buckets, dim, seed)
            table, level = vectors @ (out[1] - out[0]), bias[1] - bias[0]
            if _loss(rows, y, table, level) <= np.log(2):
                return Model(table.astype(np.float64), float(level))
    return Model(np.zeros(buckets), 0.0)


def _class_weights(y: np.ndarray) -> np.ndarray:
    return len(y) / (2 * np.maximum(1, np.bincount(y, minlength=2)))


def _loss(rows: list, y: np.ndarray, table: np.ndarray, level: float) -> float:
    """Weighted mean of the cross-entropy; log 2 for scores of 0.5, not a number where a score is none."""
    gap = np.array([share @ table[ids] + level for ids, share in rows], np.float64)
    weight = _class_weights(y)[y]
    return float((np.logaddexp(0, np.where(y == 1, -gap, gap)) * weight).sum() / weight.sum())


def _descend(rows: list, y: np.ndarray, epochs: int, rate: float, buckets: int, dim: int, seed: int) -> tuple:
    """One run of the descent: vectors of the buckets, softmax layer and its bias."""
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / dim, 1 / dim, (buckets, dim)).astype(np.float32)
    out, bias = np.zeros((2, dim), np.float32), np.zeros(2, np.float32)
    total, done = epochs * len(rows), 0
    weight = _class_weights(y)
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            ids, share = rows[i]
            lr = rate * (1 - done / total)
            done += 1
            h = share @ vectors[ids] if len(ids) else np.zeros(dim, np.float32)
            z = out @ h + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y[i]] -= 1
            g = (p * weight[y[i]] * lr).astype(np.float32)
            if len(ids):
                # mean of features: fastText-like, each feature moves by the whole gradient of the mean
                vectors[ids] -= np.outer(share * min(50.0, len(ids)), g @ out)
            out -= np.outer(g, h)
            bias -= 0.1 * g
    return vectors, out, bias


def fold(key: str = "doc_id", folds: int = 5):
    """crc32 of the id's text form modulo ``folds``; null ids are in fold 0."""
    return F.coalesce(F.crc32(F.encode(F.col(key).cast("string"), "UTF-8")) % folds, F.lit(0))


def fit(
    docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", max_train: int = 2000, **options
) -> Model:
    """Learn from labelled rows outside fold 0, ``max_train`` of them at most."""
    chosen = (
        labels.select(F.col(key).alias("key"), F.col(label).alias("label"))
        .where(F.col("key").isNotNull() & F.col("label").isin(0, 1) & (fold("key") != 0))
        .groupBy("key").agg(F.max("label").alias("label"))
        .orderBy(F.xxhash64("key"), "key").limit(max_train)
    )
    picked = chosen.collect()
    ids = docs.sparkSession.createDataFrame(picked, chosen.schema)
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).join(F.broadcast(ids), "key")
    rows = rows.groupBy("key", "label").agg(F.max(F.coalesce("text", F.lit(""))).alias("text")).collect()
    rows.sort(key=lambda r: zlib.crc32(str(r["key"]).encode()))
    return train([r["text"] for r in rows], [int(r["label"]) for r in rows], **options)


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text", threshold: float = 0.3) -> DataFrame:
    """key, held_out, score, predicted for every row.  The model sent along is
    one number per bucket, a fixed 2 MB."""
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        for part, texts in by_bytes(batches, "text"):
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(m.scores(texts))], ["key", "held_out", "score"])
        m.memo = None
        tidy()

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("key"), (fold(key) == 0).alias("held_out"), F.col(text).alias("text"))
    out = rows.mapInArrow(run, f"key {kind}, held_out boolean, score double")
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int")).withColumnRenamed("key", key)


def keep_good(docs: DataFrame, model: Model, text: str = "text", threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs`` (all columns) that aren't rejected."""
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        for batch in batches:
            for part, texts in by_bytes([batch], text):
                yield part.filter(pa.array(m.scores(texts) >= threshold))
        m.memo = None
        tidy()

    return docs.mapInArrow(run, docs.schema)
