"""Hard negatives by angular triangle filtering, with exact integer scores.

Vectors become integers, floor(scale * x), and a score is an inner product of integers. Every row stores its norm and its
angles to a few reference directions. For two rows and one reference, the angle between the rows is at least the difference
of their angles to it and at most their sum, so angles and norms bound a score from both sides, rounded outwards.

1. Rows are dealt to windows by their nearest reference and the angle to it. A window is summed up by the least and largest
   angle to each reference and norm; there are at most references * bins windows, whatever the table.
2. An anchor asks for the best rows whose score lies in some ranges. A window takes part only if its bounds overlap a range.
   Windows with the highest bound come first; the scores found there raise the lower ends of the ranges for the others.
3. Anchors meet the rows of their windows in groups of bounded size: a window is split by hashes of its rows and of its
   anchors. In a group rows lie by their angle to the reference, so the rows whose own bounds overlap are one run, found by
   bisection, and only that run is scored, as a product of matrices that is exact for integers.

The positives of an anchor are one such search among the rows of its label, its negatives another among those of others, with
one range for each positive.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from netsieve.session import stage_table

#: Scores stay below this, so that a hundred times a score fits 64 bits.
LARGEST = 1 << 55
#: Integers below this are exact in a double.
EXACT = float(1 << 52)


@dataclass(frozen=True)
class Settings:
    """`sample_rows` bounds the rows that references are fitted to. `slack` is added to angles against their rounding."""

    sample_rows: int = 20_000
    references: int = 8
    rounds: int = 6
    bins: int = 32
    part_rows: int = 16_384
    part_anchors: int = 4_096
    first_rows: int = 4_096
    slack: float = 1e-6
    chunk: int = 256


@dataclass
class Windows:
    """References (unit vectors) and, of each window, its number, nearest reference, ranges of angles and norms, and rows."""

    references: np.ndarray
    number: np.ndarray
    home: np.ndarray
    angles: np.ndarray  # windows x references x 2
    norms: np.ndarray  # windows x 2
    rows: np.ndarray
    slack: float

    def bounds(self, angles: np.ndarray, norm: float) -> tuple[np.ndarray, np.ndarray]:
        """(least, largest) score of a row with these angles and norm, for each window."""
        low, high = self.angles[..., 0], self.angles[..., 1]
        nearest = np.maximum(0, np.maximum(angles - high, low - angles)).max(axis=1, initial=0)
        ends = np.stack([_turned(angles + low), _turned(angles + high)])
        crosses = (angles + low <= np.pi) & (np.pi <= angles + high)
        farthest = np.where(crosses, np.pi, ends.max(axis=0)).min(axis=1, initial=np.pi)
        least, most = np.cos(np.minimum(np.pi, farthest + self.slack)), np.cos(np.maximum(0, nearest - self.slack))
        small, large = self.norms[:, 0] * norm, self.norms[:, 1] * norm
        return outward(least * np.where(least < 0, large, small), most * np.where(most > 0, large, small))


def _turned(x: np.ndarray) -> np.ndarray:
    """The angle between two directions that lie x apart on a circle."""
    return np.minimum(x, 2 * np.pi - x)


def outward(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whole numbers that hold the bounds and what rounding may have taken from them."""
    return np.floor(low - 1 - 1e-9 * np.abs(low)), np.ceil(high + 1 + 1e-9 * np.abs(high))


def _matrix(column: pa.Array, kind: type = np.float64) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(n, -1) if n else np.zeros((0, 1), kind)


def fit_references(rows: np.ndarray, settings: Settings) -> np.ndarray:
    """Directions that rows gather around: seeds far apart, then a few rounds of spherical means."""
    norms = np.linalg.norm(rows, axis=1)
    units = np.unique(rows[norms > 0] / norms[norms > 0, None], axis=0)
    if not len(units):
        return np.zeros((0, rows.shape[1]))
    places = [0]
    near = units @ units[0]
    while len(places) < settings.references and near.min() < 1 - 1e-9:
        places.append(int(np.argmin(near)))
        near = np.maximum(near, units @ units[places[-1]])
    means = units[places]
    for _ in range(settings.rounds):
        own = np.argmax(units @ means.T, axis=1)
        sums = np.stack([units[own == i].sum(axis=0) if (own == i).any() else means[i] for i in range(len(means))])
        length = np.linalg.norm(sums, axis=1, keepdims=True)
        means = np.where(length > 1e-9, sums / np.maximum(length, 1e-9), means)
    return means


def angles_to(rows: np.ndarray, references: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(angles to each reference, norms); a zero row has right angles."""
    norms = np.linalg.norm(rows, axis=1)
    cosines = rows @ references.T / np.where(norms > 0, norms, 1)[:, None]
    return np.arccos(np.clip(cosines, -1, 1)), norms


def whole_vectors(table: DataFrame, scale: int) -> DataFrame:
    """(row, vec_id, label, vector array<int>) of the rows of (vec_id, label, vector) that take part."""
    odd = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = table.where(F.col("label").isNotNull() & F.col("vector").isNotNull() & ~odd)
    lengths = rows.where(F.size("vector") > 0).groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    whole = F.transform("vector", lambda x: F.floor(x.cast("double") * scale).cast("double"))
    size = F.aggregate("whole", F.lit(0.0), lambda total, x: total + x * x)
    return (
        rows.where(F.size("vector") == (lengths["n"] if lengths else -1))
        .select("vec_id", F.col("label").cast("long").alias("label"), whole.alias("whole"))
        .where(size < float(LARGEST))
        .select(F.monotonically_increasing_id().alias("row"), "vec_id", "label", F.col("whole").cast("array<int>").alias("vector"))
    )


def build_index(rows: DataFrame, settings: Settings) -> tuple[DataFrame, Windows]:
    """Rows with `angles`, `norm`, `home` angle and `window`, written once, and the windows."""
    spark = rows.sparkSession
    share = min(1.0, settings.sample_rows / max(rows.count(), 1))

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [_matrix(b.column("vector")) for b in batches if b.num_rows]
        if parts:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit_references(np.concatenate(parts), settings))])], ["made"])

    chosen = F.pmod(F.xxhash64("vec_id", "vector"), F.lit(1 << 31)) < int(share * (1 << 31))
    sample = rows.where(chosen).select("vector").limit(2 * settings.sample_rows).repartition(1)
    made = sample.mapInArrow(fit, "made binary").collect()
    shared = spark.sparkContext.broadcast(pickle.loads(made[0]["made"]) if made else None)

    @F.arrow_udf("angles array<double>, norm double, home double, window int")
    def place(vectors: pa.Array) -> pa.Array:
        matrix = _matrix(vectors)
        references = shared.value if shared.value is not None else np.zeros((0, matrix.shape[1]))
        angles, norms = angles_to(matrix, references)
        nearest = np.argmin(angles, axis=1) if len(references) else np.zeros(len(matrix), np.int64)
        home = angles[np.arange(len(matrix)), nearest] if len(references) else np.full(len(matrix), np.pi / 2)
        window = nearest * settings.bins + np.minimum(settings.bins - 1, (home / np.pi * settings.bins).astype(np.int64))
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(matrix) + 1, dtype=np.int32) * len(references)), pa.array(angles.ravel()))
        return pa.StructArray.from_arrays([lists, pa.array(norms), pa.array(home), pa.array(window.astype(np.int32))], ["angles", "norm", "home", "window"])

    index = stage_table(rows.withColumn("place", place("vector")).select("row", "vec_id", "label", "vector", "place.*"), "angles")
    n = len(shared.value) if shared.value is not None else 0
    ends = [f(F.col("angles")[i]).alias(f"a{i}{f.__name__}") for i in range(n) for f in (F.min, F.max)]
    # At most references * bins rows.
    found = index.groupBy("window").agg(F.count("*").alias("rows"), F.min("norm").alias("least"), F.max("norm").alias("most"), *ends).orderBy("window").toPandas()
    number = found["window"].to_numpy(np.int64)
    angles = found.iloc[:, 4:].to_numpy(np.float64).reshape(len(found), n, 2)
    norms = found[["least", "most"]].to_numpy(np.float64).reshape(-1, 2)
    references = shared.value if shared.value is not None else np.zeros((0, 1))
    return index, Windows(references, number, number // settings.bins, angles, norms, found["rows"].to_numpy(np.int64), settings.slack)


def best_in_ranges(index: DataFrame, windows: Windows, anchors: DataFrame, k: int, same: bool, settings: Settings) -> DataFrame:
    """(anchor, range, rank, vec_id, score): of each range of each anchor the k best rows of its own label (`same`) or of others,
    highest score first, ties to the smaller vec_id, a null one last.

    `anchors` has (anchor, label, vector, angles, norm, ranges array<struct<low long, high long>>); a row is none of its own
    candidates.
    """
    visits = _visits(anchors, windows, settings)
    first = stage_table(_meet(index, visits.where("early").drop("early"), k, same, settings), "found")
    ranked = Window.partitionBy("anchor", "range").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "row")
    top = lambda df: df.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k)
    floors = top(first).where(F.col("rank") == k).groupBy("anchor").agg(F.collect_list(F.struct("range", "score")).alias("floors"))
    late = visits.where("NOT early").drop("early").join(floors, "anchor", "left")
    raised = F.transform(
        "ranges",
        lambda r, i: F.struct(
            F.greatest(r["low"], F.get(F.filter("floors", lambda f: f["range"] == i), F.lit(0))["score"]).alias("low"), r["high"].alias("high")
        ),
    )
    late = late.withColumn("ranges", F.when(F.col("floors").isNull(), F.col("ranges")).otherwise(raised)).drop("floors")
    # What the first windows have shown may rule a window out as a whole.
    late = late.where(F.exists("ranges", lambda r: (r["low"] <= r["high"]) & (r["low"] <= F.col("most")) & (r["high"] >= F.col("least"))))
    return top(first.unionByName(_meet(index, late, k, same, settings))).drop("row")


_VISIT = (
    "anchor long, label long, vector array<int>, norm double, ranges array<struct<low:bigint,high:bigint>>, "
    "window int, home double, least double, most double, early boolean"
)


def _visits(anchors: DataFrame, windows: Windows, settings: Settings) -> DataFrame:
    """Each anchor with each window whose bounds overlap one of its ranges, and its angle to the reference of that window. `early` are
    those of the highest bounds, until they hold `first_rows` rows."""
    shared = anchors.sparkSession.sparkContext.broadcast(windows)

    def plan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            out: dict[str, list[np.ndarray]] = {c: [] for c in ("at", "window", "home", "least", "most", "early")}
            asked = zip(batch.column("angles").to_pylist(), batch.column("norm").to_pylist(), batch.column("ranges").to_pylist())
            for i, (angles, norm, ranges) in enumerate(asked):
                angles = np.array(angles, np.float64)
                least, most = own.bounds(angles, norm)
                fits = np.zeros(len(least), bool)
                for r in ranges:
                    fits |= (r["low"] <= r["high"]) & (most >= r["low"]) & (least <= r["high"])
                order = np.argsort(-most, kind="stable")
                order = order[fits[order]]
                before = np.cumsum(own.rows[order]) - own.rows[order]
                out["at"].append(np.full(len(order), i))
                out["window"].append(own.number[order])
                out["home"].append(angles[own.home[order]] if len(angles) else np.full(len(order), np.pi / 2))
                out["least"].append(least[order])
                out["most"].append(most[order])
                out["early"].append(before < settings.first_rows)
            made = {c: np.concatenate(x) if x else np.zeros(0) for c, x in out.items()}
            take = pa.array(made["at"].astype(np.int64))
            columns = [batch.column(c).take(take) for c in ("anchor", "label", "vector", "norm", "ranges")]
            columns += [pa.array(made["window"].astype(np.int32)), pa.array(made["home"]), pa.array(made["least"]), pa.array(made["most"])]
            columns.append(pa.array(made["early"].astype(bool)))
            yield pa.RecordBatch.from_arrays(columns, ["anchor", "label", "vector", "norm", "ranges", "window", "home", "least", "most", "early"])

    return anchors.select("anchor", "label", "vector", "angles", "norm", "ranges").mapInArrow(plan, _VISIT)


def _meet(index: DataFrame, visits: DataFrame, k: int, same: bool, settings: Settings) -> DataFrame:
    """(anchor, range, row, vec_id, score): of each group the k best rows of every range of its anchors."""
    cell = ["window", "label"] if same else ["window"]
    parts = index.groupBy(*cell).agg(F.count("*").alias("rows")).join(visits.groupBy(*cell).agg(F.count("*").alias("asked")), cell)
    parts = parts.select(
        *cell,
        F.ceil(F.col("rows") / settings.part_rows).alias("row_parts"),
        F.ceil(F.col("asked") / settings.part_anchors).alias("anchor_parts"),
    )
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    part = lambda key, n: F.pmod(F.xxhash64(key), F.col(n))
    kind = F.col("label") if same else F.lit(0).cast("long")
    candidates = index.join(parts, cell).select(
        "window", kind.alias("kind"), part("row", "row_parts").alias("rp"), every("anchor_parts").alias("ap"),
        "row", "vec_id", "label", "vector", "norm", "home",
    )
    asking = visits.join(parts, cell).select(
        "window", kind.alias("kind"), every("row_parts").alias("rp"), part("anchor", "anchor_parts").alias("ap"),
        "anchor", "label", "vector", "norm", "home", "ranges",
    )

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        kind = pa.schema([("anchor", pa.int64()), ("range", pa.int32()), ("row", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])
        if not len(left) or not len(right):
            return kind.empty_table()
        return pa.table(list(_scored(left, right, k, same, settings)), schema=kind)

    groups = ("window", "kind", "rp", "ap")
    return candidates.groupBy(*groups).cogroup(asking.groupBy(*groups)).applyInArrow(compare, "anchor long, range int, row long, vec_id long, score long")


def runs(homes: np.ndarray, norms: tuple[float, float], home: np.ndarray, norm: np.ndarray, low: np.ndarray, high: np.ndarray, slack: float):
    """(starts, stops) for each anchor of the run of rows, by their angles to the reference in order, whose scores may lie between its
    `low` and `high`."""
    with np.errstate(divide="ignore", invalid="ignore"):
        # cos(difference) * norms >= low, and so a largest difference; none if the norms alone forbid it.
        most = np.where(low > 0, low - 1 - 1e-9 * low, -np.inf) / (norm * norms[1])
        reach = np.where(low > 0, np.arccos(np.clip(np.nan_to_num(most, nan=2), -1, 1)) + slack, np.pi)
        empty = (low > 0) & ~(most <= 1)
        # cos(sum) * norms > high, and so a sum below which all scores are too large.
        least = (high + 1 + 1e-9 * np.abs(high)) / (norm * norms[0])
        inner = np.where(least < 1, np.arccos(np.clip(np.nan_to_num(least, nan=2), -1, 1)) - slack, -1.0)
    # A low of 0 or less, or a high below 0, turns the signs that this rests on: such anchors take all rows.
    starts = np.searchsorted(homes, np.maximum(home - reach, np.where(high >= 0, inner - home, -1.0)), "left")
    stops = np.searchsorted(homes, home + reach, "right")
    return np.where(empty, 0, starts), np.where(empty, 0, np.maximum(starts, stops))


def _scored(left: pa.Table, right: pa.Table, k: int, same: bool, settings: Settings) -> Iterator[pa.Array]:
    homes, home = left["home"].to_numpy(), right["home"].to_numpy()
    order, asked = np.argsort(homes, kind="stable"), np.argsort(home, kind="stable")
    homes, home = homes[order], home[asked]
    norms, norm = left["norm"].to_numpy()[order], right["norm"].to_numpy()[asked]
    kind = np.float64 if norms.max() * norm.max() < EXACT else np.int64
    rows, questions = _matrix(left["vector"], kind)[order], _matrix(right["vector"], kind)[asked]
    row, label = left["row"].to_numpy()[order], left["label"].to_numpy()[order]
    vec_id = left["vec_id"].take(pa.array(order))
    # Null ids come last.
    tie = vec_id.combine_chunks().fill_null(np.iinfo(np.int64).max).to_numpy()
    anchor, own_label = right["anchor"].to_numpy()[asked], right["label"].to_numpy()[asked]
    ranges = [right["ranges"][int(i)].as_py() for i in asked]
    low = np.array([min((r["low"] for r in x if r["low"] <= r["high"]), default=LARGEST) for x in ranges], np.float64)
    high = np.array([max((r["high"] for r in x if r["low"] <= r["high"]), default=-LARGEST) for x in ranges], np.float64)
    starts, stops = runs(homes, (norms.min(), norms.max()), home, norm, low, high, settings.slack)
    out: list[tuple[np.ndarray, ...]] = []
    for begin in range(0, len(asked), settings.chunk):
        some = slice(begin, begin + settings.chunk)
        live = stops[some] > starts[some]
        if not live.any():
            continue
        start, stop = starts[some][live].min(), stops[some][live].max()
        products = (questions[some] @ rows[start:stop].T).astype(np.int64)
        for i in range(begin, min(begin + settings.chunk, len(asked))):
            scores = products[i - begin]
            fits = ((label[start:stop] == own_label[i]) == same) & (row[start:stop] != anchor[i])
            fits &= (scores >= low[i]) & (scores <= high[i])
            at = np.flatnonzero(fits)
            for j, r in enumerate(ranges[i]):
                inside = at[(scores[at] >= r["low"]) & (scores[at] <= r["high"])]
                if len(inside) > k:
                    inside = inside[scores[inside] >= np.partition(scores[inside], len(inside) - k)[len(inside) - k]]
                best = inside[np.lexsort((row[start + inside], tie[start + inside], -scores[inside]))[:k]]
                out.append((np.full(len(best), anchor[i]), np.full(len(best), j, np.int32), start + best, scores[best]))
    owners, which, at, scores = (np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64),) * 4
    yield pa.array(owners, pa.int64())
    yield pa.array(which.astype(np.int32), pa.int32())
    yield pa.array(row[at], pa.int64())
    yield vec_id.take(pa.array(at.astype(np.int64)))
    yield pa.array(scores, pa.int64())


def mine(
    table: DataFrame,
    is_anchor: Column,
    n_positives: int = 5,
    n_negatives: int = 10,
    low_percent: int = 30,
    high_percent: int = 90,
    scale: int = 256,
    settings: Settings = Settings(),
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of a table (vec_id, label, vector).

    Anchors are the rows that `is_anchor`. The positives of an anchor are its `n_positives` best other rows of its label; for each of
    them the `n_negatives` best rows of other labels with low_percent * positive <= 100 * negative <= high_percent * positive are
    returned, highest score first, ties to the smaller vec_id and a null one last. All that there are count where there are
    fewer. A search is exact, whatever the references.

    Rows with a null label, a null vector, or a null or non-finite component take no part, nor do empty vectors or those of
    another length than most, nor those whose integer components have a sum of squares of 2**55 or more, for their scores would not fit. A
    zero vector scores 0. Every row stands for itself: a repeated vec_id is as many anchors, positives and negatives as
    it has rows. A null vec_id takes part. Other columns are left out.
    """
    index, windows = build_index(whole_vectors(table.select("vec_id", "label", "vector"), scale), settings)
    chosen = index.where(is_anchor).select(F.col("row").alias("anchor"), F.col("vec_id").alias("anchor_id"), "label", "vector", "angles", "norm")
    anchors = stage_table(chosen, "anchors")
    everything = F.array(F.struct(F.lit(-LARGEST).alias("low"), F.lit(LARGEST).alias("high")))
    found = best_in_ranges(index, windows, anchors.withColumn("ranges", everything), n_positives, True, settings)
    named = found.select("anchor", (F.col("rank") - 1).alias("range"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    positives = stage_table(named, "positives")
    low = F.ceil(F.col("positive_score") * low_percent / F.lit(100).cast("decimal(3,0)"))
    high = F.floor(F.col("positive_score") * high_percent / F.lit(100).cast("decimal(3,0)"))
    ends = F.struct("range", low.cast("long").alias("low"), high.cast("long").alias("high"))
    wanted = positives.groupBy("anchor").agg(F.sort_array(F.collect_list(ends)).alias("ranges"))
    wanted = wanted.withColumn("ranges", F.transform("ranges", lambda r: F.struct(r["low"].alias("low"), r["high"].alias("high"))))
    negatives = best_in_ranges(index, windows, anchors.join(wanted, "anchor"), n_negatives, False, settings)
    return (
        negatives.join(positives, ["anchor", "range"])
        .join(anchors.select("anchor", "anchor_id"), "anchor")
        .select(
            "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"),
            "positive_score", F.col("score").alias("negative_score"),
        )
    )
