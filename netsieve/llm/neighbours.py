"""Approximate nearest neighbours by a hierarchical k-means tree with best-bin-first traversal.

1. A tree is fitted on a bounded sample; it holds means only and is small enough to broadcast.
2. Every row is dealt to the leaf that it reaches from the root by the nearest means, and written with it.
3. A search keeps unvisited branches in a priority queue by their distance and takes the nearest first. How many leaves
   it visits is calibrated: for a few queries the exact neighbours among all rows are computed, and visits are widened
   until the wanted share of these stands in the visited leaves.
4. Queries meet the rows of their leaves in groups (leaf, part of its rows, part of its queries), so a leaf with a third
   of all rows is no single task. Each group gives its nearest rows for each query, and these are ranked. The first few
   leaves of a query come first: from the others only rows within the distance found there are passed on.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from netsieve.session import stage_table


@dataclass(frozen=True)
class Settings:
    """sample_rows bounds the rows of the fit; leaf_rows is the wanted size of a leaf over all rows."""

    sample_rows: int = 20_000
    leaf_rows: int = 512
    branches: int = 8
    rounds: int = 8
    recall: float = 0.98
    calibration_queries: int = 128
    part_rows: int = 1024
    part_queries: int = 2048
    first_leaves: int = 4


@dataclass
class Tree:
    """Nodes by number: their mean, and the numbers of their children or of their leaf."""

    means: list[np.ndarray] = field(default_factory=list)
    children: list[list[int]] = field(default_factory=list)
    leaf: list[int] = field(default_factory=list)
    leaves: int = 0

    def add(self, mean: np.ndarray) -> int:
        self.means.append(mean)
        self.children.append([])
        self.leaf.append(-1)
        return len(self.means) - 1

    def assign(self, rows: np.ndarray) -> np.ndarray:
        """The leaf of each row."""
        found = np.empty(len(rows), np.int64)
        waiting = [(0, np.arange(len(rows)))]
        while waiting:
            node, at = waiting.pop()
            if not self.children[node]:
                found[at] = self.leaf[node]
            elif len(at):
                own = _nearest(rows[at], np.stack([self.means[c] for c in self.children[node]]))
                waiting += [(c, at[own == i]) for i, c in enumerate(self.children[node])]
        return found

    def visit(self, query: np.ndarray) -> Iterator[int]:
        """Leaves, best bin first."""
        queue = [(0.0, 0)]
        while queue:
            _, node = heapq.heappop(queue)
            while self.children[node]:
                own = self.children[node]
                gaps = ((np.stack([self.means[c] for c in own]) - query) ** 2).sum(axis=1)
                best = int(np.argmin(gaps))
                for i, c in enumerate(own):
                    if i != best:
                        heapq.heappush(queue, (float(gaps[i]), c))
                node = own[best]
            yield self.leaf[node]


def _nearest(rows: np.ndarray, means: np.ndarray) -> np.ndarray:
    return np.argmin((means**2).sum(axis=1) - 2 * (rows @ means.T), axis=1)


def grow(rows: np.ndarray, leaf_size: int, settings: Settings) -> Tree:
    """k-means within k-means until nodes have `leaf_size` rows of the sample or no two different ones."""
    tree, rng = Tree(), np.random.default_rng(0)
    waiting = [(tree.add(rows.mean(axis=0)), rows)]
    while waiting:
        node, own = waiting.pop()
        means = np.unique(own[rng.permutation(len(own))[: 4 * settings.branches]], axis=0) if len(own) > leaf_size else own[:0]
        if len(means) > 1:
            means = means[rng.permutation(len(means))[: settings.branches]]
            for _ in range(settings.rounds):
                near = _nearest(own, means)
                means = np.stack([own[near == i].mean(axis=0) for i in np.unique(near)])
            near = _nearest(own, means)
            parts = [own[near == i] for i in range(len(means)) if (near == i).any()]
        if len(means) < 2 or len(parts) < 2:
            tree.leaf[node] = tree.leaves
            tree.leaves += 1
            continue
        for part in parts:
            child = tree.add(part.mean(axis=0))
            tree.children[node].append(child)
            waiting.append((child, part))
    return tree


def usable(vector: Column) -> Column:
    """Neither null, empty nor zero, and no component null or not finite."""
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(~odd & F.exists(vector, lambda x: x != 0), F.lit(False))


def _matrix(column: pa.ListArray) -> np.ndarray:
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1) if n else np.zeros((0, 1))


def nearest_rows(
    queries: np.ndarray, rows: np.ndarray, ids: np.ndarray, own: np.ndarray, k: int, within: np.ndarray | None = None
) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(query, places, distances) of the k nearest rows; ties go to the smaller id, rows with the query's id are left out, and
    so are those farther than `within`.

    Products of matrices give the candidates, generously; distances are then taken from the differences themselves.
    """
    norms, own_norms = (rows**2).sum(axis=1), (queries**2).sum(axis=1)
    for i in range(len(queries)):
        rough = norms + own_norms[i] - 2 * (rows @ queries[i])
        others = np.flatnonzero(ids != own[i])
        rough = rough[others]
        if len(others) > k:
            bound = np.partition(rough, k - 1)[k - 1] + 1e-9 * (own_norms[i] + norms.max())
            others = others[rough <= bound]
        gaps = np.sqrt(((rows[others] - queries[i]) ** 2).sum(axis=1))
        best = np.lexsort((ids[others], gaps))[:k]
        if within is not None:
            best = best[gaps[best] <= within[i]]
        yield i, others[best], gaps[best]


def _top(df: DataFrame, k: int) -> DataFrame:
    ranks = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return df.withColumn("rank", ranks).where(F.col("rank") <= k)


def calibrate(index: DataFrame, tree: Tree, queries: DataFrame, k: int, settings: Settings) -> int:
    """The least number of visited leaves that holds the wanted share of the exact neighbours of some queries."""
    some = queries.orderBy(F.xxhash64("vec_id"), "vec_id").limit(settings.calibration_queries).toPandas()
    if some.empty:
        return 1
    ids, vectors = some["vec_id"].to_numpy(), np.stack([np.asarray(v, np.float64) for v in some["vector"]])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, row_ids = _matrix(batch.column("vector")), batch.column("vec_id").to_numpy()
            leaves = batch.column("leaf").to_numpy()
            out = [(ids[i], row_ids[a], leaves[a], d) for i, at, gaps in nearest_rows(vectors, rows, row_ids, ids, k) for a, d in zip(at, gaps)] if len(rows) else []
            columns = list(zip(*out)) if out else [[], [], [], []]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.float64()))],
                ["query_id", "vec_id", "leaf", "score"],
            )

    exact = _top(index.mapInArrow(scan, "query_id long, vec_id long, leaf long, score double"), k).select("query_id", "leaf").toPandas()
    places = []
    for query_id, vector in zip(ids, vectors):
        order = {leaf: i for i, leaf in enumerate(tree.visit(vector))}
        places += [order[leaf] for leaf in exact.loc[exact["query_id"] == query_id, "leaf"]]
    visits = 1
    while places and np.mean(np.array(places) < visits) < settings.recall:
        visits += 1
    return visits


def build_index(vectors: DataFrame, settings: Settings) -> tuple[DataFrame, Tree, np.ndarray]:
    """(rows with their leaf, the tree, rows of each leaf) of a table (vec_id, vector) of usable vectors of one length."""
    spark = vectors.sparkSession
    n = vectors.count()
    share = min(1.0, settings.sample_rows / max(n, 1))
    chosen = F.pmod(F.xxhash64("vec_id"), F.lit(1 << 31)) < int(share * (1 << 31))

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [(b.column("vec_id").to_numpy(), _matrix(b.column("vector"))) for b in batches if b.num_rows]
        if parts:
            rows = np.concatenate([p[1] for p in parts])[np.argsort(np.concatenate([p[0] for p in parts]), kind="stable")]
            leaf_size = max(4, round(settings.leaf_rows * share))
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(grow(rows, leaf_size, settings))])], ["tree"])

    made = vectors.where(chosen).limit(2 * settings.sample_rows).repartition(1).mapInArrow(fit, "tree binary").collect()
    if made:
        tree = pickle.loads(made[0]["tree"])
    else:  # hardly any rows: one leaf
        tree = Tree()
        tree.leaf[tree.add(np.zeros(1))], tree.leaves = 0, 1
    shared = spark.sparkContext.broadcast(tree)

    @F.arrow_udf("long")
    def leaf_of(column: pa.Array) -> pa.Array:
        return pa.array(shared.value.assign(_matrix(column)))

    index = stage_table(vectors.withColumn("leaf", leaf_of("vector")), "leaves")
    sizes = np.zeros(tree.leaves, np.int64)
    for row in index.groupBy("leaf").count().collect():  # at most one row for each leaf of the tree
        sizes[row["leaf"]] = row["count"]
    return index, tree, sizes


def search(vectors: DataFrame, is_query: Column, k: int = 10, settings: Settings = Settings()) -> DataFrame:
    """(query_id, rank, vec_id, score) of a table (vec_id, vector): the nearest rows by Euclidean distance of each row that
    `is_query`.

    Rows whose vector is null, empty, zero, or holds null or non-finite components take no part, nor does a null vec_id, nor
    a vector of another length than most. A row is no candidate for queries with its own vec_id; a repeated vec_id is
    one query, by the vector of it that sorts first, but each of its rows a candidate for others. Ties go to the smaller vec_id. All candidates are given
    if there are no more than k. Other columns are left out. The share of exact neighbours that are found is about
    `settings.recall`; scores are exact.
    """
    spark = vectors.sparkSession
    rows = vectors.select("vec_id", "vector").where(F.col("vec_id").isNotNull() & usable(F.col("vector")))
    lengths = rows.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    length = lengths["n"] if lengths else 0
    index, tree, sizes = build_index(rows.where(F.size("vector") == length), settings)
    queries = index.where(is_query).groupBy("vec_id").agg(F.min("vector").alias("vector"))
    visits = calibrate(index, tree, queries, k, settings)
    shared = spark.sparkContext.broadcast((tree, sizes))

    def plan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each query with each leaf that it visits: `visits` of them, and more while these hold too few rows."""
        own_tree, own_sizes = shared.value
        for batch in batches:
            at, leaves, steps = [], [], []
            for i, query in enumerate(_matrix(batch.column("vector"))):
                seen = 0
                for step, leaf in enumerate(own_tree.visit(query)):
                    if step >= visits and seen > k:
                        break
                    at.append(i)
                    leaves.append(leaf)
                    steps.append(step)
                    seen += int(own_sizes[leaf])
            take = pa.array(np.array(at, np.int64))
            columns = [batch.column("vec_id").take(take), batch.column("vector").take(take)]
            columns += [pa.array(np.array(x, np.int64)) for x in (leaves, steps)]
            yield pa.RecordBatch.from_arrays(columns, ["query_id", "query", "leaf", "step"])

    kind = index.schema["vector"].dataType.simpleString()
    visited = stage_table(queries.mapInArrow(plan, f"query_id long, query {kind}, leaf long, step long"), "visits")
    early = F.col("step") < settings.first_leaves
    first = stage_table(_meet(index, visited.where(early).withColumn("within", F.lit(float("inf"))), sizes, k, settings), "near")
    bounds = _top(first, k).groupBy("query_id").agg(F.max("score").alias("within"), F.count("*").alias("n"))
    bounds = bounds.select("query_id", F.when(F.col("n") == k, F.col("within")).otherwise(float("inf")).alias("within"))
    late = visited.where(~early).join(bounds, "query_id", "left").withColumn("within", F.coalesce("within", F.lit(float("inf"))))
    found = first.unionByName(_meet(index, late, sizes, k, settings))
    return _top(found, k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _meet(index: DataFrame, visited: DataFrame, sizes: np.ndarray, k: int, settings: Settings) -> DataFrame:
    """(query_id, vec_id, score): of each visited leaf and part the k nearest rows that are not farther than `within`."""
    asked = visited.groupBy("leaf").agg(F.count("*").alias("asked"))
    parts = (
        index.sparkSession.createDataFrame(pd.DataFrame({"leaf": np.arange(len(sizes)), "rows": sizes}))
        .join(asked, "leaf")  # as many rows as the tree has leaves
        .select(
            "leaf",
            F.ceil(F.col("rows") / settings.part_rows).alias("row_parts"),
            F.ceil(F.col("asked") / settings.part_queries).alias("query_parts"),
        )
        .where("row_parts > 0")
    )
    parts = F.broadcast(parts)
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    part = lambda key, n: F.pmod(F.xxhash64(key), F.col(n))
    candidates = index.join(parts, "leaf").select(
        "leaf", part("vec_id", "row_parts").alias("rp"), every("query_parts").alias("qp"), "vec_id", "vector"
    )
    asking = visited.join(parts, "leaf").select(
        "leaf", every("row_parts").alias("rp"), part("query_id", "query_parts").alias("qp"), "query_id", "query", "within"
    )

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        kind = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])
        if not len(left) or not len(right):
            return kind.empty_table()
        ids, own, within = left["vec_id"].to_numpy(), right["query_id"].to_numpy(), right["within"].to_numpy()
        rows, asked = _matrix(left["vector"].combine_chunks()), _matrix(right["query"].combine_chunks())
        found = [(np.full(len(at), own[i]), ids[at], gaps) for i, at, gaps in nearest_rows(asked, rows, ids, own, k, within)]
        return pa.table([pa.array(np.concatenate(c)) for c in zip(*found)], schema=kind)

    groups = ("leaf", "rp", "qp")
    return (
        candidates.groupBy(*groups)
        .cogroup(asking.groupBy(*groups))
        .applyInArrow(compare, "query_id long, vec_id long, score double")
    )
