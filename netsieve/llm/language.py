"""Language identification by nearest centroids of TF-IDF n-gram vectors.

A text is the vector of its byte n-grams (1 to 3 bytes of letters and gaps), hashed to DIMENSIONS coordinates, weighed by
(1 + log tf) * idf and normalised. Each language has a few centroids, found by spherical k-means over a bounded sample of
its rows; a text takes the language of the centroid with the largest cosine. A text farther from its centroid than
nearly all rows that the centroid was made of is marked as rejected.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from netsieve.llm.common import short_batches
from netsieve.llm.toxicity import held_out
from netsieve.session import stage_table

DIMENSIONS = 1 << 13
UNKNOWN = "und"
#: A-Z to a-z; letters and bytes beyond ASCII stay; all others become gaps.
TO_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


@dataclass(frozen=True)
class Settings:
    """Of the fit: rows of the sample for each language (about), centroids, rounds, and the share of rows that may be far."""

    max_rows: int = 1000
    centroids: int = 4
    rounds: int = 8
    far_share: float = 0.005
    max_languages: int = 1000


@dataclass(frozen=True)
class Model:
    idf: np.ndarray
    languages: list[str]  # of each centroid
    centroids: np.ndarray  # dimensions x centroids
    nearest: np.ndarray  # the cosine below which a text is far, for each centroid


def gram_counts(text: bytes | None) -> np.ndarray:
    data = np.frombuffer(b" ".join((text or b"").translate(TO_LETTERS).split()), np.uint8).astype(np.uint32)
    if not len(data):
        return np.zeros(DIMENSIONS, np.int64)
    codes = [data + 1, data[:-1] << 8 | data[1:] | 1 << 24, (data[:-2] << 16 | data[1:-1] << 8 | data[2:]) + (1 << 25)]
    hashed = (np.concatenate(codes) * np.uint32(0x9E3779B1)) >> np.uint32(19)
    return np.bincount(hashed, minlength=DIMENSIONS)


def vector(text: bytes | None, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(coordinates, values) of the normalised vector; empty without letters."""
    counts = gram_counts(text)
    at = np.flatnonzero(counts)
    values = (1 + np.log(counts[at])) * idf[at]
    return at, values / np.linalg.norm(values) if len(at) else values


def cluster(rows: np.ndarray, settings: Settings) -> tuple[np.ndarray, np.ndarray]:
    """(centroids, least cosines): spherical k-means from seeds that are farthest apart. Ties go to the first row."""
    seeds = [int(np.argmax(rows @ rows.mean(axis=0)))]
    near = rows @ rows[seeds[0]]
    while len(seeds) < min(settings.centroids, len(rows)) and near.min() < 1 - 1e-6:
        seeds.append(int(np.argmin(near)))
        near = np.maximum(near, rows @ rows[seeds[-1]])
    centres = rows[seeds]
    for _ in range(settings.rounds):
        own = np.argmax(rows @ centres.T, axis=1)
        sums = np.stack([rows[own == c].sum(axis=0) if (own == c).any() else centres[c] for c in range(len(centres))])
        centres = sums / np.linalg.norm(sums, axis=1, keepdims=True)
    cosines = rows @ centres.T
    own, best = np.argmax(cosines, axis=1), cosines.max(axis=1)
    least = [np.quantile(best[own == c], settings.far_share) if (own == c).any() else 1.0 for c in range(len(centres))]
    return centres, np.array(least)


def fit(docs: DataFrame, settings: Settings = Settings()) -> Model:
    """The model of rows (doc_id, text, lang) with a language, not held out and with some letter.

    Document frequencies are those of all such rows. Centroids come from a sample: texts of a language are taken by a hash at a
    rate that follows from how many different ones it has, so about `max_rows` of each are read, and the first by hash in any
    case; equal texts count once. The sample is the only thing that is gathered: one task per language.
    """
    spark = docs.sparkSession
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}") & ~held_out(folds=5, fold=0))
    hashed = rows.select("lang", "text", F.xxhash64("text").alias("h"))
    kinds = hashed.groupBy("lang").agg(F.approx_count_distinct("h", 0.02).alias("n"), F.min("h").alias("first"))
    counts = kinds.limit(settings.max_languages + 1).toPandas()
    if len(counts) > settings.max_languages:
        raise ValueError(f"more than {settings.max_languages} languages")
    if counts.empty:
        return Model(np.ones(DIMENSIONS), [], np.zeros((DIMENSIONS, 0), np.float32), np.zeros(0))
    # Rows are ordered by 31 bits of a hash of the text; a rate is a bound on these.
    counts["bound"] = (settings.max_rows / counts["n"] * (1 << 31)).clip(upper=1 << 31).astype("int64")
    rates = spark.createDataFrame(counts[["lang", "bound", "first"]])
    chosen = (F.pmod("h", F.lit(1 << 31)) < F.col("bound")) | (F.col("h") == F.col("first"))
    taken = hashed.join(F.broadcast(rates), "lang").where(chosen).dropDuplicates(["lang", "h"])
    sample = stage_table(taken.select("lang", "text", "h"), "language-sample")

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(DIMENSIONS + 1, np.int64), 0
        for batch in batches:
            for text in batch.column(0).cast(pa.large_binary()):
                df[:-1] += gram_counts(text.as_py()) > 0
                n += 1
        df[-1] = n
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(df[at])], ["at", "df"])

    short_batches(spark)
    found = rows.select("text").mapInArrow(frequencies, "at long, df long").groupBy("at").agg(F.sum("df").alias("df")).toPandas()
    df = np.zeros(DIMENSIONS + 1)
    df[found["at"]] = found["df"]
    idf = np.log((1 + df[-1]) / (1 + df[:-1])) + 1

    def centres(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("h")
        dense = np.zeros((len(group), DIMENSIONS), np.float32)
        for i, text in enumerate(group["text"]):
            at, values = vector(text.encode(), idf)
            dense[i, at] = values
        made, least = cluster(dense, settings)
        return pd.DataFrame({"lang": group["lang"].iloc[0], "place": range(len(made)), "centre": [c.tobytes() for c in made], "least": least})

    models = sample.groupBy("lang").applyInPandas(centres, "lang string, place int, centre binary, least double").toPandas()
    models = models.assign(order=models["lang"].map(lambda x: x.encode())).sort_values(["order", "place"])
    matrix = np.stack([np.frombuffer(c, np.float32) for c in models["centre"]]).T
    return Model(idf, models["lang"].tolist(), np.ascontiguousarray(matrix), models["least"].to_numpy())


def with_language(docs: DataFrame, model: Model, into: str = "language") -> DataFrame:
    """`docs` with a struct `into` of lang_pred, score (the cosine) and rejected.

    A null text, or one without a letter, is `und` with score 0 and rejected; so is every text if nothing was learned.
    Equal cosines go to the language that sorts first.
    """
    short_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("lang_pred string, score double, rejected boolean")
    def nearest(texts: pa.Array, letters: pa.Array) -> pa.Array:
        m = shared.value
        names, scores, far = [], np.zeros(len(texts)), np.ones(len(texts), bool)
        for i, (text, some) in enumerate(zip(texts.cast(pa.large_binary()), letters)):
            if not some.as_py() or not m.languages:
                names.append(UNKNOWN)
                continue
            at, values = vector(text.as_py(), m.idf)
            cosines = values @ m.centroids[at] if len(at) else np.zeros(len(m.languages))
            best = int(np.argmax(cosines))
            names.append(m.languages[best])
            scores[i] = min(1.0, max(0.0, float(cosines[best])))
            far[i] = cosines[best] < m.nearest[best]
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores), pa.array(far)], ["lang_pred", "score", "rejected"])

    letters = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    return docs.withColumn(into, nearest("text", letters))


def identify_languages(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, rejected) of every row of documents (doc_id, text, lang); other columns are
    left out. Rows that repeat each give a row; a null doc_id is not held out; a null lang is not learned."""
    rows = docs.select("doc_id", "text", "lang")
    found = with_language(rows.select("doc_id", "text"), fit(rows, settings))
    return found.select("doc_id", held_out(folds=5, fold=0).alias("held_out"), "language.*")
