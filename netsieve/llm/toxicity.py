"""Toxicity scores by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features are the words, word pairs and pairs with one word between them that a text has, and the beginnings of its
words, which inflected forms share; all hashed to `1 << BITS` coordinates, each with the same value. FTRL-proximal keeps for each coordinate the sum of squared gradients, which sets
its own rate, and a dual sum that L1 cuts to zero, so few weights remain: these are broadcast, and scoring is a map.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from netsieve.llm.common import short_batches
from netsieve.llm.decontaminate import words_of

BITS = 20
STEM_BYTES = 5
#: Odd multipliers that tell words, stems, pairs and skip-pairs apart.
WORD, STEM, LEFT, PAIR, SKIP = (
    np.uint64(x)
    for x in (0x9E3779B97F4A7C15, 0xA0761D6478BD642F, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)
)


@dataclass(frozen=True)
class Settings:
    """Of the fit. `max_rows` bounds the sample of labelled rows; the first by a hash of doc_id are taken, with up to `max_texts`
    different texts of each."""

    max_rows: int = 10_000
    max_texts: int = 8
    epochs: int = 4
    alpha: float = 0.7
    beta: float = 1.0
    l1: float = 3.0
    l2: float = 0.1


def features(text: bytes | None) -> np.ndarray:
    """The coordinates of a text, with repeats."""
    words = words_of(text)
    h = np.fromiter(map(zlib.crc32, words), np.uint64, len(words))
    stems = np.fromiter((zlib.crc32(w[:STEM_BYTES]) for w in words), np.uint64, len(words))
    with np.errstate(over="ignore"):
        mixed = [h * WORD, stems * STEM, (h[:-1] * LEFT + h[1:]) * PAIR, (h[:-2] * LEFT + h[2:]) * SKIP]
    return (np.concatenate(mixed) >> np.uint64(64 - BITS)).astype(np.int64)


def _sigmoid(x: np.ndarray | float) -> np.ndarray | float:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Ftrl:
    """FTRL-proximal. The last coordinate is the bias, without L1."""

    def __init__(self, settings: Settings):
        self.s = settings
        self.z, self.n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)

    def weights(self, at: np.ndarray) -> np.ndarray:
        z, s = self.z[at], self.s
        l1 = np.where(at == 1 << BITS, 0.0, s.l1)
        scale = (s.beta + np.sqrt(self.n[at])) / s.alpha + s.l2
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / scale)

    def learn(self, at: np.ndarray, label: int) -> None:
        w = self.weights(at)
        g = _sigmoid(w.sum()) - label
        before = self.n[at]
        sigma = (np.sqrt(before + g * g) - np.sqrt(before)) / self.s.alpha
        self.z[at] += g - sigma * w
        self.n[at] = before + g * g


def train(rows: list[tuple[np.ndarray, int]], settings: Settings) -> tuple[np.ndarray, np.ndarray]:
    """(coordinates, weights) other than zero."""
    model, bias = Ftrl(settings), np.array([1 << BITS])
    for epoch in range(settings.epochs):
        for i in np.random.default_rng(epoch).permutation(len(rows)):
            at, label = rows[i]
            model.learn(np.concatenate([at, bias]), label)
    every = np.arange((1 << BITS) + 1)
    w = model.weights(every)
    kept = np.flatnonzero(w)
    return kept, w[kept]


def _train_rows(batches: Iterator[pa.RecordBatch], settings: Settings) -> Iterator[pa.RecordBatch]:
    rows = []
    for batch in batches:
        texts, labels = batch.column("text").cast(pa.large_binary()), batch.column("label").to_pylist()
        for order, text, label in zip(batch.column("place").to_pylist(), texts, labels):
            rows.append((order, np.unique(features(text.as_py())).astype(np.int32), label))
    rows.sort(key=lambda r: r[0])  # the same weights however rows arrive
    at, weights = train([r[1:] for r in rows], settings)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(weights)], ["at", "weight"])


def held_out(doc_id: str = "doc_id", folds: int = 4, fold: int = 2):
    """Whether the checksum of the id as text leaves `fold`; not so for a null id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds == fold, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, held: Column, max_rows: int, max_texts: int) -> DataFrame:
    """(place, text, label) of at most `max_rows` rows of `docs` that have a label and are not `held`; `place` orders them.

    The sample is chosen from the narrow table of labels, the first by a hash of doc_id; it is then bounded, so documents are
    filtered by a broadcast. A doc_id with several labels takes the largest; equal rows count once, and one with several texts
    gives up to `max_texts`, chosen by hash, where the sample has room after the first text of every doc_id.
    """
    chosen = (
        labels.where(F.col("doc_id").isNotNull() & F.col("label").isNotNull())
        .where(~held)
        .groupBy("doc_id")
        .agg(F.max("label").cast("int").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(max_rows)
    )
    labelled = docs.select("doc_id", "text", F.xxhash64("text").alias("t"))
    # One text for each of `max_texts` classes of hashes: a doc_id with very many texts is never gathered.
    part = F.pmod("t", F.lit(max_texts)).alias("part")
    texts = labelled.select("doc_id", "t").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label", part).agg(F.min("t").alias("t"))
    nth = F.row_number().over(Window.partitionBy("doc_id").orderBy("t"))
    taken = texts.withColumn("nth", nth).orderBy("nth", F.xxhash64("doc_id"), "doc_id").limit(max_rows).select("doc_id", "label", "t")
    found = labelled.join(F.broadcast(taken), ["doc_id", "t"]).select("doc_id", "t", "text", "label").distinct()
    place = F.concat_ws(" ", F.xxhash64("doc_id").cast("string"), F.col("doc_id").cast("string"), F.col("t").cast("string"))
    return found.select(place.alias("place"), "text", "label")


def fit(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> tuple[np.ndarray, np.ndarray]:
    """The sparse weights from rows of `labels` (doc_id, label) that have a label and are not held out.

    One task learns from at most `max_rows` of them. No labels give no weights: every score is one half.
    """
    sample = labelled_sample(docs, labels, held_out(), settings.max_rows, settings.max_texts)
    short_batches(docs.sparkSession)
    rows = sample.repartition(1).mapInArrow(lambda it: _train_rows(it, settings), "at long, weight double")
    found = rows.toPandas()
    return found["at"].to_numpy(np.int64), found["weight"].to_numpy(np.float64)


def with_score(docs: DataFrame, weights: tuple[np.ndarray, np.ndarray], into: str = "score") -> DataFrame:
    """`docs` with a column of scores from 0 to 1; a null or empty text is scored by the bias alone."""
    short_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        w = np.zeros((1 << BITS) + 1, np.float64)
        at, values = shared.value
        w[at] = values
        bias, known = w[1 << BITS], w != 0
        sums = np.empty(len(texts))
        for i, text in enumerate(texts.cast(pa.large_binary())):
            own = features(text.as_py())
            sums[i] = bias + w[np.unique(own[known[own]])].sum()
        return pa.array(_sigmoid(sums))

    return docs.withColumn(into, score("text"))


def score_documents(
    docs: DataFrame, labels: DataFrame, threshold: float = 0.3, settings: Settings = Settings()
) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of documents (doc_id, text); other columns are left out.

    `labels` has (doc_id, label), label 1 for toxic. Rows that repeat each give a row; a null doc_id is not held out.
    """
    scored = with_score(docs.select("doc_id", "text"), fit(docs, labels, settings))
    return scored.select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )
