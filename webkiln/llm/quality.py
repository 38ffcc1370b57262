"""Quality classifier: naive Bayes support vectors.

A text's features are indicators of n-grams, hashed to ``N_FEATURES`` slots: word
unigrams and bigrams, byte trigrams, and unigrams to trigrams of word shapes.  A word's
shape is the kinds of its first, second and last byte and whether it repeats the word
before.  Every indicator is scaled by its class log-count ratio, the vector is brought to
length one, and a linear model with hinge loss is fitted by dual coordinate descent.
Margins become scores by a logistic curve fitted on rows kept out of the descent.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from webkiln.llm import words

#: Slots: words and word pairs, byte trigrams, word shapes.
N_WORDS, N_BYTES, N_SHAPES = 1 << 17, 1 << 17, 1 << 12
N_FEATURES = N_WORDS + N_BYTES + N_SHAPES
#: Kinds of bytes (0 other, 1 capital, 2 small letter, 3 digit, 4 mark).
_KIND = np.zeros(256, np.uint64)
_KIND[0x41:0x5B], _KIND[0x61:0x7B], _KIND[0x30:0x3A] = 1, 2, 3
_KIND[0x21:0x30] = _KIND[0x3A:0x41] = _KIND[0x5B:0x61] = _KIND[0x7B:0x7F] = 4


def shapes(data: np.ndarray, hashed: words.Words) -> np.ndarray:
    """A number for every word's shape."""
    begin, end = hashed.begin, hashed.end
    same = np.r_[False, hashed.hashes[1:] == hashed.hashes[:-1]][: len(begin)]
    first, second, last = _KIND[data[begin]], _KIND[data[np.minimum(begin + 1, end - 1)]], _KIND[data[end - 1]]
    return ((first * np.uint64(5) + second) * np.uint64(5) + last) * np.uint64(2) + same.astype(np.uint64) + np.uint64(1)


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Distinct feature numbers of all texts end to end, ascending in each, and len + 1 offsets."""
    data, offsets = words.text_bytes(texts)
    hashed = words.hash_words(texts, "raw")
    text = hashed.text_of
    found = []

    def add(slots: np.ndarray, owner: np.ndarray, k: int, base: int) -> None:
        inside = owner[: len(slots)] == owner[k - 1 : k - 1 + len(slots)]
        found.append((owner[: len(slots)][inside] << 32) | (slots[inside].astype(np.int64) + base))

    for k in (1, 2):
        grams = hashed.hashes if k == 1 else words.ngrams(hashed.hashes, k)
        add(grams & np.uint64(N_WORDS - 1), text, k, 0)
    if len(data) > 2:
        wide = data.astype(np.uint32)
        three = ((wide[:-2] << 16) | (wide[1:-1] << 8) | wide[2:]) * np.uint32(0x9E3779B1) >> np.uint32(15)
        add(three, np.repeat(np.arange(len(offsets) - 1), np.diff(offsets)), 3, N_WORDS)
    shape = shapes(data, hashed)
    for k in (1, 2, 3):
        add(words.ngrams(shape, k) & np.uint64(N_SHAPES - 1), text, k, N_WORDS + N_BYTES)
    flat = np.sort(np.concatenate(found))
    flat = flat[np.diff(flat, prepend=-1) != 0]
    edges = np.searchsorted(flat, np.arange(len(offsets), dtype=np.int64) << 32)
    return (flat & 0xFFFFFFFF).astype(np.int32), edges


def rows_of(found: np.ndarray, edges: np.ndarray) -> list[np.ndarray]:
    return [found[a:b] for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]


def scaled(ratio: np.ndarray, found: np.ndarray) -> np.ndarray:
    """The values of a text's features: ratios, brought to length one."""
    x = ratio[found]
    norm = np.sqrt(x @ x)
    return x / norm if norm else x


@dataclass
class Model:
    ratio: np.ndarray
    weight: np.ndarray
    bias: float
    slope: float
    shift: float

    def margins(self, found: np.ndarray, edges: np.ndarray) -> np.ndarray:
        """One margin per text; a text without features has the bias."""
        ratio = self.ratio[found]
        dot, square = (
            np.add.reduceat(np.r_[x, 0.0], np.minimum(edges[:-1], len(x))) for x in (self.weight[found] * ratio, ratio * ratio)
        )
        some = (np.diff(edges) > 0) & (square > 0)
        return np.where(some, dot / np.sqrt(np.where(some, square, 1.0)), 0.0) + self.bias

    def scores(self, found: np.ndarray, edges: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.margins(found, edges) + self.shift, -500, 500)))


def log_count_ratio(rows: list[np.ndarray], y: np.ndarray, smooth: float = 1.0) -> np.ndarray:
    counts = [np.full(N_FEATURES, smooth), np.full(N_FEATURES, smooth)]
    for found, label in zip(rows, y, strict=True):
        counts[int(label > 0)][found] += 1
    good, bad = counts[1] / counts[1].sum(), counts[0] / counts[0].sum()
    return np.log(good / bad)


def descend(rows: list[np.ndarray], y: np.ndarray, ratio: np.ndarray, c: float, rounds: int, seed: int):
    """Dual coordinate descent for the hinge loss; classes weigh the same in all."""
    rng = np.random.default_rng(seed)
    values = [scaled(ratio, found).astype(np.float32) for found in rows]
    most = np.where(y > 0, c * len(y) / (2 * max((y > 0).sum(), 1)), c * len(y) / (2 * max((y < 0).sum(), 1)))
    weight, bias, alpha = np.zeros(N_FEATURES), 0.0, np.zeros(len(y))
    for _ in range(rounds):
        for i in rng.permutation(len(y)):
            found, x = rows[i], values[i]
            gradient = y[i] * (weight[found] @ x + bias) - 1
            new = min(max(alpha[i] - gradient / (x @ x + 1), 0.0), most[i])
            if new != alpha[i]:
                step = (new - alpha[i]) * y[i]
                weight[found] += step * x
                bias += step
                alpha[i] = new
    return weight, bias


def calibrate(margins: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic curve through the margins (Newton steps, small ridge)."""
    target = np.where(y > 0, ((y > 0).sum() + 1) / ((y > 0).sum() + 2), 1 / ((y < 0).sum() + 2))
    design, beta = np.c_[margins, np.ones(len(margins))], np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        hessian = design.T @ (design * (p * (1 - p))[:, None]) + 1e-3 * np.eye(2)
        step = np.linalg.solve(hessian, design.T @ (target - p) - 1e-3 * beta)
        beta = beta + np.clip(step, -5, 5)
    return float(max(beta[0], 0.0)), float(beta[1])


def fit(rows: list[np.ndarray], labels: np.ndarray, c: float = 1.0, rounds: int = 15, seed: int = 5) -> Model:
    """Fit on four fifths, calibrate on the last fifth.

    Without rows, or with one class only, the model scores every text by the share
    of label 1 (one half without rows).
    """
    y = np.where(np.asarray(labels) > 0, 1, -1)
    if len(set(y.tolist())) < 2:
        share = (1 + (y > 0).sum()) / (2 + len(y))
        return Model(np.zeros(N_FEATURES), np.zeros(N_FEATURES), 0.0, 0.0, float(np.log(share / (1 - share))))
    order = np.random.default_rng(seed).permutation(len(y))
    order = np.concatenate([order[y[order] > 0], order[y[order] < 0]])
    held = np.zeros(len(y), bool)
    held[order[::5]] = True
    if len(set(y[~held].tolist())) < 2 or len(set(y[held].tolist())) < 2:
        held[:] = False
    train = np.flatnonzero(~held)
    kept = [rows[i] for i in train]
    ratio = log_count_ratio(kept, y[train])
    weight, bias = descend(kept, y[train], ratio, c, rounds, seed)
    model = Model(ratio, weight, bias, 1.0, 0.0)
    check = np.flatnonzero(held) if held.any() else train
    sizes = [len(rows[i]) for i in check]
    margins = model.margins(np.concatenate([rows[i] for i in check]), np.r_[0, np.cumsum(sizes)])
    model.slope, model.shift = calibrate(margins, y[check])
    return model


def held_out(id_: Column) -> Column:
    """Documents whose labels are never learned from."""
    return F.coalesce(F.pmod(F.crc32(id_.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, most_rows: int) -> Model:
    """Fit a model on at most ``most_rows`` labelled documents outside the held-out fold.

    The rows are those with the smallest hash of their id among the labels that have
    a document; null labels are left out and of repeated labels of one id the largest
    counts.
    """
    known = (
        labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(F.col(id_col)))
        .groupBy(F.col(id_col).alias("id"))
        .agg(F.max(label_col).cast("int").alias("label"))
        .join(docs.select(F.col(id_col).alias("id")), "id", "left_semi")
        .orderBy(F.xxhash64("id"), "id")
        .limit(most_rows)
    )

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in words.slices(batches, "text"):
            found = [f.astype("<i4").tobytes() for f in rows_of(*features(batch.column("text")))]
            yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(found, pa.binary())], ["label", "found"])

    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    sample = texts.join(F.broadcast(known), "id").select("id", "label", "text")  # at most most_rows rows
    rows = sample.select("label", "text").mapInArrow(words.releasing(extract), "label int, found binary").toArrow()
    rows = rows.sort_by([("found", "ascending"), ("label", "ascending")])  # whatever order they arrive in
    model = fit([np.frombuffer(x.as_buffer(), "<i4") for x in rows.column("found")], rows.column("label").to_numpy())
    del rows
    words.release()  # the driver outlives the fit
    return model


def score_quality(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    most_rows: int = 5000,
    threshold: float = 0.7,
) -> DataFrame:
    """``docs`` with held_out, score and predicted added.

    The score is between 0 and 1, higher where label 1 is likelier, and depends on
    the text alone.  Null and empty texts have no features and get the model's bias.
    Every row is scored, repeated ones and those with null ids too; columns of docs
    named like the three results are replaced, all others pass through.  A text of any
    length is scored whole; a task holds about a megabyte of text or one longer text.
    Scores equal to ``threshold`` count as label 1.  An empty table gives no rows.
    ``most_rows`` bounds the labelled rows that the model is fitted on.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(learn(docs, labels, id_col, text_col, label_col, most_rows))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in words.slices(batches, "__text"):
            scores = shared.value.scores(*features(batch.column("__text")))
            keep = [c for c in batch.schema.names if c != "__text"]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(scores)], [*keep, "score"])

    rows = docs.drop("held_out", "score", "predicted")
    out = T.StructType([*rows.schema.fields, T.StructField("score", T.DoubleType())])
    scored = rows.withColumn("__text", F.col(text_col)).mapInArrow(words.releasing(score), out)
    return scored.select(
        "*",
        held_out(F.col(id_col)).alias("held_out"),
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )
