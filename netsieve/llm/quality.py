"""Quality scores by a generalised additive model with pairwise interactions.

A text becomes a few numbers (`measure`). Each number is cut into bins, and the model is one lookup table per number and
one per chosen pair of numbers: a score is a sum of entries. Tables are learned by cyclic boosting. A round goes through
the numbers one after the other, and fits a shallow tree over the bins of that one number alone to the gradient of the
logistic loss; the tree's steps are added to its table at a small rate. When the single tables stand, the pairs whose trees
would lower the loss most get tables of their own in the same way. Tables are a few thousand numbers, so they are broadcast
and scoring is a map.
"""

from __future__ import annotations

import pickle
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from netsieve.llm.common import short_batches
from netsieve.llm.toxicity import held_out, labelled_sample

FOLDS, FOLD = 5, 0
#: What a text is measured by, in the order of `measure`.
NAMES = (
    "log_bytes", "log_words", "letters", "digits", "capitals", "spaces", "stops", "commas", "signs", "word_length",
    "distinct_words", "top_word", "same_as_before", "distinct_pairs", "short_words", "long_words", "wordless",
    "capital_starts", "longest_word", "log_lines", "words_a_line", "distinct_lines", "closed_lines", "deflated",
    "byte_entropy", "words_a_stop",
)
_SIGN, _LETTER, _DIGIT, _CAPITAL, _SPACE, _STOP, _COMMA = range(7)
_KINDS = np.full(256, _SIGN, np.int8)
_KINDS[[*range(97, 123), *range(128, 256)]] = _LETTER
_KINDS[48:58] = _DIGIT
_KINDS[65:91] = _CAPITAL
_KINDS[[9, 10, 11, 12, 13, 32]] = _SPACE
_KINDS[[33, 46, 63]] = _STOP
_KINDS[[44, 59, 58]] = _COMMA


def measure(text: bytes | None) -> np.ndarray:
    """The numbers of NAMES of a whole text; a null or empty text is all zeros."""
    out = np.zeros(len(NAMES))
    if not text:
        return out
    data = np.frombuffer(text, np.uint8)
    kinds = _KINDS[data]
    signs, letters, digits, capitals, spaces, stops, commas = np.bincount(kinds, minlength=7) / len(data)
    shares = np.bincount(data) / len(data)
    shares = shares[shares > 0]
    words = text.split()
    n = max(1, len(words))
    edges = np.flatnonzero(np.diff(kinds != _SPACE, prepend=False, append=False))
    starts, lengths = edges[::2], edges[1::2] - edges[::2] if words else np.zeros(1, np.int64)
    lettered = np.cumsum((kinds == _LETTER) | (kinds == _CAPITAL))
    wordless = (lettered[edges[1::2] - 1] - lettered[starts] + np.isin(kinds[starts], (_LETTER, _CAPITAL)) == 0).sum()
    seen = Counter(words)
    same = sum(map(bytes.__eq__, words, words[1:]))
    lines = [x for x in map(bytes.strip, text.split(b"\n")) if x]
    m = max(1, len(lines))
    return np.array([
        np.log1p(len(data)), np.log1p(len(words)), letters, digits, capitals, spaces, stops, commas, signs, lengths.mean(),
        len(seen) / n, max(seen.values(), default=0) / n, same / n, len(set(zip(words, words[1:]))) / n,
        (lengths <= 3).mean(), (lengths >= 12).mean(), wordless / n,
        (kinds[starts] == _CAPITAL).sum() / n, np.log1p(lengths.max()), np.log1p(len(lines)), n / m, len(set(lines)) / m,
        sum(1 for x in lines if x[-1:] in (b".", b"!", b"?")) / m, len(zlib.compress(text, 1)) / len(data),
        -(shares * np.log2(shares)).sum(), n / (1 + stops * len(data)),
    ])


@dataclass(frozen=True)
class Settings:
    """Of the fit. `max_rows` bounds the labelled rows that it reads, the first by a hash of doc_id, with up to `max_texts` texts of
    each; every `check_every`th of them only tells when to stop."""

    max_rows: int = 20_000
    max_texts: int = 8
    bins: int = 48
    pair_bins: int = 12
    pairs: int = 10
    rounds: int = 240
    patience: int = 20
    rate: float = 0.1
    depth: int = 2
    l2: float = 1.0
    least_rows: int = 10
    check_every: int = 5


@dataclass
class Model:
    """`edges` and `tables` of each number; `pairs` are (number, number, edges of both, table of both)."""

    base: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)

    def margins(self, rows: np.ndarray) -> np.ndarray:
        """Sums of entries, for a matrix of rows and numbers."""
        total = np.full(len(rows), self.base)
        for i, (edges, table) in enumerate(zip(self.edges, self.tables)):
            total += table[np.searchsorted(edges, rows[:, i], "right")]
        for i, j, left, right, table in self.pairs:
            total += table[np.searchsorted(left, rows[:, i], "right"), np.searchsorted(right, rows[:, j], "right")]
        return total


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def log_loss(margins: np.ndarray, labels: np.ndarray) -> float:
    return float(np.mean(np.logaddexp(0, margins) - labels * margins)) if len(labels) else 0.0


def cuts(values: np.ndarray, bins: int) -> np.ndarray:
    """Places between bins of about equal counts; values that repeat share a bin."""
    return np.unique(np.quantile(values, np.arange(1, bins) / bins, method="higher"))


def shallow_tree(g: np.ndarray, h: np.ndarray, n: np.ndarray, depth: int, settings: Settings) -> tuple[np.ndarray, float]:
    """(step of each cell, gain) of a tree over a grid of cells with sums of gradients, curvatures and rows; a cut runs across
    one axis, at the place of the largest gain, the first of equal ones."""
    gain = lambda g, h: g * g / (h + settings.l2)
    whole = gain(g.sum(), h.sum())
    best, place = 1e-9, None
    for axis in range(2) if depth else ():
        sums = [np.cumsum(x.sum(axis=1 - axis))[:-1] for x in (g, h, n)]
        if not len(sums[0]):
            continue
        gains = gain(sums[0], sums[1]) + gain(g.sum() - sums[0], h.sum() - sums[1]) - whole
        gains[(sums[2] < settings.least_rows) | (n.sum() - sums[2] < settings.least_rows)] = 0
        if gains.max() > best:
            best, place = gains.max(), (axis, int(np.argmax(gains)) + 1)
    if place is None:
        return np.full(g.shape, -g.sum() / (h.sum() + settings.l2)), whole
    axis, at = place
    halves = [shallow_tree(*(np.split(x, [at], axis)[side] for x in (g, h, n)), depth - 1, settings) for side in (0, 1)]
    return np.concatenate([x[0] for x in halves], axis), halves[0][1] + halves[1][1]


class _Cells:
    """The cells of a grid that rows fall into, with the sums that trees are made of."""

    def __init__(self, left: np.ndarray, right: np.ndarray, shape: tuple[int, int]):
        self.shape, self.at = shape, left * shape[1] + right
        self.rows = self.sums(np.ones(len(left)))

    def sums(self, values: np.ndarray) -> np.ndarray:
        return np.bincount(self.at, values, minlength=self.shape[0] * self.shape[1]).reshape(self.shape)

    def tree(self, g: np.ndarray, h: np.ndarray, settings: Settings) -> tuple[np.ndarray, float]:
        return shallow_tree(self.sums(g), self.sums(h), self.rows, settings.depth, settings)


def _slopes(margins: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    p = sigmoid(margins)
    return p - labels, p * (1 - p)


def _boost(
    cells: list[_Cells], checks: list[_Cells], margins: np.ndarray, check_margins: np.ndarray, y: np.ndarray, check_y: np.ndarray, settings: Settings
) -> list[np.ndarray]:
    """A table for each grid, cyclically boosted; those of the round with the least loss of the rows set aside. `margins` and
    `check_margins` follow them."""
    tables = [np.zeros(c.shape) for c in cells]
    kept, best, since = [t.copy() for t in tables], log_loss(check_margins, check_y), 0
    for _ in range(settings.rounds):
        for table, own, other in zip(tables, cells, checks):
            step = settings.rate * own.tree(*_slopes(margins, y), settings)[0]
            table += step
            margins += step.ravel()[own.at]
            check_margins += step.ravel()[other.at]
        loss = log_loss(check_margins, check_y)
        since += 1
        if loss < best - 1e-6 or not len(check_y):
            kept, best, since = [t.copy() for t in tables], loss, 0
        if since > settings.patience:
            break
    for table, last, own, other in zip(kept, tables, cells, checks):
        margins += (table - last).ravel()[own.at]
        check_margins += (table - last).ravel()[other.at]
    return kept


def train(rows: np.ndarray, labels: np.ndarray, settings: Settings = Settings()) -> Model:
    """The model of a matrix of rows and numbers, and of labels 0 and 1. Without rows a model that scores one half."""
    model = Model()
    if not len(rows):
        return model
    aside = np.arange(len(rows)) % settings.check_every == settings.check_every - 1
    fit, y, check, check_y = rows[~aside], labels[~aside], rows[aside], labels[aside]
    share = (y.sum() + 1) / (len(y) + 2)
    model.base = float(np.log(share / (1 - share)))
    margins, check_margins = np.full(len(y), model.base), np.full(len(check_y), model.base)
    bin_of = lambda edges, part, i: np.searchsorted(edges, part[:, i], "right")
    model.edges = [cuts(fit[:, i], settings.bins) for i in range(rows.shape[1])]
    one = [[_Cells(bin_of(e, part, i), np.zeros(len(part), np.int64), (len(e) + 1, 1)) for i, e in enumerate(model.edges)] for part in (fit, check)]
    model.tables = [t[:, 0] for t in _boost(one[0], one[1], margins, check_margins, y, check_y, settings)]
    coarse = [cuts(fit[:, i], settings.pair_bins) for i in range(rows.shape[1])]
    grid = lambda part, i, j: _Cells(bin_of(coarse[i], part, i), bin_of(coarse[j], part, j), (len(coarse[i]) + 1, len(coarse[j]) + 1))
    g, h = _slopes(margins, y)
    gains = sorted((-grid(fit, i, j).tree(g, h, settings)[1], i, j) for i, j in combinations(range(rows.shape[1]), 2))
    chosen = [(i, j) for _, i, j in gains[: settings.pairs]]
    two = [[grid(part, i, j) for i, j in chosen] for part in (fit, check)]
    tables = _boost(two[0], two[1], margins, check_margins, y, check_y, settings)
    model.pairs = [(i, j, coarse[i], coarse[j], table) for (i, j), table in zip(chosen, tables)]
    return model


def _measured(texts: pa.Array) -> np.ndarray:
    made = [measure(t.as_py()) for t in texts.cast(pa.large_binary())]
    return np.stack(made) if made else np.zeros((0, len(NAMES)))


def fit(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> Model:
    """The model of rows of `docs` (doc_id, text) that `labels` (doc_id, label) marks and that are not held out.

    At most `max_rows` labelled texts are measured where they lie (see `labelled_sample` for repeated ids and texts); one task
    learns from their numbers. No labels give a model that scores every text one half.
    """
    short_batches(docs.sparkSession)

    @F.arrow_udf("binary")
    def numbers(texts: pa.Array) -> pa.Array:
        return pa.array([row.tobytes() for row in _measured(texts)], pa.binary())

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted(r for b in batches for r in zip(*(b.column(c).to_pylist() for c in ("place", "label", "numbers"))))
        matrix = np.stack([np.frombuffer(r[2]) for r in rows]) if rows else np.zeros((0, len(NAMES)))
        model = train(matrix, np.array([min(1, max(0, r[1])) for r in rows], np.float64), settings)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], ["model"])

    sample = labelled_sample(docs, labels, held_out(folds=FOLDS, fold=FOLD), settings.max_rows, settings.max_texts)
    made = sample.select("place", "label", numbers("text").alias("numbers")).repartition(1).mapInArrow(learn, "model binary").collect()
    return pickle.loads(made[0]["model"]) if made else Model()


def with_quality(docs: DataFrame, model: Model, into: str = "score") -> DataFrame:
    """`docs` with a column of scores from 0 to 1, which replaces one of that name; a null text is scored like an empty one."""
    short_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        return pa.array(sigmoid(shared.value.margins(_measured(texts))))

    return docs.withColumn(into, score("text"))


def score_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, settings: Settings = Settings()) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of documents (doc_id, text); other columns are left out.

    `labels` has (doc_id, label), label 1 for good. Rows that repeat each give a row; a null doc_id is not held out. Equal
    texts have equal scores.
    """
    scored = with_quality(docs.select("doc_id", "text"), fit(docs, labels, settings))
    return scored.select(
        "doc_id",
        held_out(folds=FOLDS, fold=FOLD).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )
