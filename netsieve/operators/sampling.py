"""Balanced samples, quota caps and stratified batches."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from netsieve.operators.ordered import running_totals
from netsieve.session import shuffle_width


def hash_order(seed: object, id_column: str) -> Column:
    """Seeded, engine-independent shuffle order."""
    return F.sha2(F.concat_ws("|", F.lit(str(seed)), F.col(id_column).cast("string")), 256)


def balanced_sample(
    df: DataFrame, label: str, classes: Sequence, n: int, id_column: str, seed: int = 42
) -> DataFrame:
    """Exactly `n` rows of each class in hash order, with `sample_index` interleaving the classes.

    The rank filter is applied per input task first, so a class of any size ships at most `n` rows per task.
    """
    rows = df.where(F.col(label).isin(*classes))
    have = {r[0]: r[1] for r in rows.groupBy(label).count().collect()}
    short = {c: n - have.get(c, 0) for c in classes if have.get(c, 0) < n}
    if short:
        raise ValueError(f"balanced sample is short of rows: {short}")
    ranked = rows.withColumn("_h", hash_order(seed, id_column)).withColumn(
        "_rank", F.row_number().over(Window.partitionBy(label).orderBy("_h", id_column))
    )
    place = F.array_position(F.array(*[F.lit(c) for c in classes]), F.col(label)) - 1
    chosen = ranked.where(F.col("_rank") <= n)
    return chosen.withColumn("sample_index", (F.col("_rank") - 1) * len(classes) + place).drop("_h", "_rank")


def quota_cap(df: DataFrame, label: str, order: Sequence[str], total: int = 1000) -> DataFrame:
    """At most `total` rows: an equal quota of first rows per class, the rest filled in index order."""
    present = df.select(label).distinct().count()
    quota = max(1, total // max(1, present))
    rank = F.row_number().over(Window.partitionBy(label).orderBy(*order))
    # No class can place more than `total` rows, and that rank trims each task before the shuffle.
    candidates = df.withColumn("_rank", rank).where(F.col("_rank") <= total)
    by_quota = F.col("_rank") <= quota
    return (
        candidates.orderBy(~by_quota, F.when(by_quota, F.col(label)), *order)
        .limit(total)
        .drop("_rank")
    )


def _structs(rows: list[tuple], names: tuple[str, ...], kind: str) -> Column:
    """A literal array of structs of whole numbers."""
    return F.array(*[F.struct(*[F.lit(v).cast(kind).alias(n) for n, v in zip(names, row)]) for row in rows])


def _fill_batch(q: Column, counts: dict, size: int, batches: int) -> Column:
    """Batch of the q-th filler row: the batches' free slots, counted through.

    Batch b keeps size - (classes with more than b rows) slots free, which changes only at class sizes, so
    a short list of stretches (start, free slots before it, free slots per batch) describes all of them.
    """
    def free_before(b: int) -> int:
        return b * size - sum(min(n, b) for n in counts.values())

    last = batches - 1
    knots = sorted({0, *[n for n in counts.values() if n < last]})
    stretches = [(b, free_before(b), size - sum(1 for n in counts.values() if n > b)) for b in knots if b < last]
    stretches = [s for s in stretches if s[2] > 0] + [(last, free_before(last), 1 << 62)]
    found = F.element_at(
        F.filter(_structs(stretches, ("start", "free", "slots"), "bigint"), lambda s: s["free"] <= q), -1
    )
    return F.transform(F.array(found), lambda s: s["start"] + F.call_function("div", q - s["free"], s["slots"]))[0]


def _merged_rank(place: Column, label: Column, rest: dict) -> Column:
    """Rank of row `place` of its class when the classes' remaining rows are spread evenly over each other.

    Row p of n sits at (2p+1)/2n; the rows of another class before it follow by integer division, ties
    going to the class listed first.
    """
    classes = sorted(c for c, n in rest.items() if n > 0)
    if not classes:
        return place
    kind = "decimal(38,0)" if max(rest.values()) > 1 << 30 else "bigint"
    others = [
        [(rest[o], rest[c] if j < i else rest[c] - 1, 2 * rest[c]) for j, o in enumerate(classes) if o != c]
        for i, c in enumerate(classes)
    ]
    if len(classes) == 1:
        return place
    table = F.create_map(
        *[v for c, rows in zip(classes, others) for v in (F.lit(c), _structs(rows, ("n", "tie", "step"), kind))]
    )
    odd = (place * 2 + 1).cast(kind)
    return F.aggregate(
        F.try_element_at(table, label),
        place.cast("bigint"),
        lambda rank, o: rank + F.call_function("div", odd * o["n"] + o["tie"], o["step"]).cast("bigint"),
    )


def assign_batches(
    df: DataFrame, label: str, size: int, id_column: str, seed: int = 42, epoch: int = 0, drop_last: bool = False
) -> DataFrame:
    """Add `batch`: every row once, full batches but the last, each with every class that still has rows.

    Rows are shuffled within their class by a seeded hash. Row r of a class opens batch r; the remaining
    rows, classes evenly mixed, fill the free slots. Ranks run over hash ranges, never over a whole class,
    and everything behind the rank is arithmetic on the class sizes.
    """
    counts = {r[0]: r[1] for r in df.groupBy(label).count().limit(size + 1).collect()}
    if size < len(counts):
        raise ValueError("the batch size must reach the number of classes")
    total = sum(counts.values())
    batches = max(1, math.ceil(total / size))
    opening = batches - 1
    hashed = F.xxhash64(F.lit(seed + epoch), F.col(id_column))
    width = shuffle_width(df.sparkSession)
    ranked = running_totals(
        df.withColumn("_h", F.struct(hashed.alias("hash"), F.col(id_column).alias("id"))).withColumn(
            "_one", F.lit(1).cast("long")
        ),
        "_h",
        ["_one"],
        [label],
        bucket=F.floor((F.col("_h.hash") / F.lit(2.0**64) + 0.5) * width),
    )
    place = F.col("cum__one") - 1
    rest = {c: max(0, n - opening) for c, n in counts.items()}
    mixed = ranked.withColumn("_q", F.when(place >= opening, _merged_rank(place - opening, F.col(label), rest)))
    filler = _fill_batch(F.col("_q"), counts, size, batches)
    out = mixed.withColumn("batch", F.when(place < opening, place).otherwise(filler).cast("long")).drop(
        "_h", "_one", "_q", "cum__one", "total__one"
    )
    return out.where(F.col("batch") < total // size) if drop_last else out
