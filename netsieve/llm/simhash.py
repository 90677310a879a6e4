"""SimHash near-duplicates by covering locality-sensitive hashing.

Fingerprints within `radius` bits are linked. Their bits are dealt to `parts` groups, so that a pair within the radius
differs in at most r = radius // parts bits of some group. Each group has 2**(r + 1) - 1 tables: bit i carries a vector
m(i) of r + 1 bits, and table v keeps the bits with an odd number of common ones in m(i) and v. The vectors of at most
r differing bits leave some v orthogonal to all of them, so the pair agrees on all the bits that table v keeps. Every
pair within the radius therefore meets in some bucket.

The work is on distinct fingerprints, so exact copies cost nothing. A larger bucket yields a spanning forest of its
links, not its pairs. A bucket above `crowd` is split by the same construction over the bits its table does not keep,
which loses no pair either. More parts mean fewer tables and larger buckets: a matter of cost, not of results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from netsieve.llm.common import short_batches, text_digest
from netsieve.llm.components import connected_components
from netsieve.session import stage_table

SEED = 42
CHUNK = 1 << 15
#: Buckets of up to so many fingerprints are compared by shifts of the whole batch, larger ones by a search each.
SHIFTS = 24
ROUNDS = 3
THIN = 1 << 17


def fingerprint(text: bytes | None, width: int = 4, bits: int = 64) -> np.ndarray:
    """SimHash over the `width`-word shingles of a text as 64-bit words, the first with the lowest bits; 0 without words.

    64 bits take XXH64 of a shingle, 128 bits XXH3.
    """
    words = (text or b"").lower().split()
    if not words:
        return np.zeros(bits // 64, np.uint64)
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    count = max(1, len(words) - width + 1)
    starts, stops = (ends - lengths)[:count].tolist(), ends[min(width, len(words)) - 1 :].tolist()
    digest = xxhash.xxh64_digest if bits == 64 else xxhash.xxh3_128_digest
    ones = np.zeros(bits, np.int64)
    for at in range(0, count, CHUNK):
        part = b"".join([digest(joined[a:b], SEED) for a, b in zip(starts[at : at + CHUNK], stops[at : at + CHUNK])])
        # Digests are big-endian: read backwards, the bits come lowest first.
        rows = np.frombuffer(part, np.uint8).reshape(-1, bits // 8)
        ones += np.unpackbits(rows, axis=1).sum(axis=0, dtype=np.int64)[::-1]
    return np.packbits(ones * 2 > count, bitorder="little").view("<u8")


def with_fingerprints(docs: DataFrame, width: int = 4, bits: int = 64) -> DataFrame:
    """(doc_id, digest, f0, ...) of every row: the fingerprint in words of 64 bits."""
    names = [f"f{i}" for i in range(bits // 64)]
    short_batches(docs.sparkSession)

    @F.arrow_udf(", ".join(f"{n} long" for n in names))
    def simhash(texts: pa.Array) -> pa.Array:
        whole = texts.cast(pa.large_binary())
        values = np.zeros((len(whole), len(names)), np.uint64)
        for i, text in enumerate(whole):
            values[i] = fingerprint(text.as_py(), width, bits)
        return pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(v).view(np.int64)) for v in values.T], names)

    return docs.select("doc_id", text_digest(F.col("text")).alias("digest"), simhash("text").alias("f")).select(
        "doc_id", "digest", "f.*"
    )


def covering_masks(radius: int, open_bits: list[int], parts: int = 1) -> list[int]:
    """Masks over `open_bits` such that any set of at most `radius` of these bits is left out by some mask."""
    vectors = (1 << (radius // parts + 1)) - 1
    return [
        sum(1 << b for k, b in enumerate(open_bits[p::parts]) if (k % vectors + 1 & v).bit_count() % 2)
        for p in range(parts)
        for v in range(1, vectors + 1)
    ]


def _words(mask: int, n: int) -> list[int]:
    """A mask as signed 64-bit words."""
    low = [mask >> (64 * i) & (1 << 64) - 1 for i in range(n)]
    return [w - (1 << 64) if w >> 63 else w for w in low]


def _near(a: np.ndarray, b: np.ndarray, radius: int) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int16) <= radius


def _forest(bucket: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(node, linked nodes): a spanning forest of the links of one bucket, each node being visited once."""
    waiting = bucket
    while len(waiting) > 1:
        queue, waiting = [waiting[0]], waiting[1:]
        while queue and len(waiting):
            node = queue.pop()
            near = _near(waiting, node, radius)
            if near.any():
                linked, waiting = waiting[near], waiting[~near]
                yield node, linked
                queue.extend(linked)


def _bucket_links(fps: np.ndarray, bounds: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links within the buckets that `bounds` delimit in `fps`."""
    sizes = np.diff(bounds)
    small = (sizes > 1) & (sizes <= SHIFTS)
    inside = np.repeat(small, sizes)
    rows, bucket = fps[inside], np.repeat(np.arange(small.sum()), sizes[small])
    left, right = [fps[:0]], [fps[:0]]
    for k in range(1, int(sizes[small].max()) if small.any() else 1):
        at = np.flatnonzero(bucket[k:] == bucket[:-k])
        at = at[_near(rows[at], rows[at + k], radius)]
        left.append(rows[at])
        right.append(rows[at + k])
    for at, size in zip(bounds[:-1][sizes > SHIFTS].tolist(), sizes[sizes > SHIFTS].tolist()):
        for node, linked in _forest(fps[at : at + size], radius):
            left.append(np.broadcast_to(node, linked.shape))
            right.append(linked)
    return np.concatenate(left), np.concatenate(right)


def _link_rows(batches: Iterator[pa.RecordBatch], n: int, radius: int, crowd: int | None) -> Iterator[pa.RecordBatch]:
    """Over rows (mask, kept words, fingerprint words) sorted by bucket: the links of the buckets, and with their mask the
    rows of crowded buckets as they are. A bucket may go over batches; without `crowd` all its rows are held."""
    names = ["mask", *(f"a{i}" for i in range(n)), *(f"b{i}" for i in range(n))]
    most = crowd or 1 << 62

    def out(mask: np.ndarray, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        values = [mask, *a.T, *b.T]
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(v).astype(np.int64)) for v in values], names)

    def solve(rows: np.ndarray, bounds: np.ndarray) -> Iterator[pa.RecordBatch]:
        sizes = np.diff(bounds)
        crowded = np.repeat(sizes > most, sizes)
        if crowded.any():
            over = rows[crowded]
            yield out(over[:, 0], over[:, 1 + n :], over[:, 1 + n :])
        kept = sizes[sizes <= most]
        fps = np.ascontiguousarray(rows[~crowded][:, 1 + n :]).view(np.uint64)
        a, b = _bucket_links(fps, np.concatenate([[0], np.cumsum(kept)]).astype(np.int64), radius)
        yield out(np.full(len(a), -1), a.view(np.int64), b.view(np.int64))

    held = np.zeros((0, 1 + 2 * n), np.int64)  # the last bucket, which may go on
    flowing: np.ndarray | None = None  # the key of the bucket that is known to be crowded
    for batch in batches:
        rows = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns], axis=1)
        if flowing is not None:
            same = (rows[:, : 1 + n] == flowing).all(axis=1)
            if same.any():
                yield out(rows[same][:, 0], rows[same][:, 1 + n :], rows[same][:, 1 + n :])
                rows = rows[~same]
        if not len(rows):
            continue
        flowing, rows = None, np.concatenate([held, rows])
        change = np.flatnonzero((rows[1:, : 1 + n] != rows[:-1, : 1 + n]).any(axis=1)) + 1
        last = int(change[-1]) if len(change) else 0
        if last:
            yield from solve(rows[:last], np.concatenate([[0], change]))
        held = rows[last:]
        if len(held) > most:
            yield out(held[:, 0], held[:, 1 + n :], held[:, 1 + n :])
            flowing, held = held[0, : 1 + n].copy(), held[:0]
    if len(held):
        yield from solve(held, np.array([0, len(held)]))


def _thin(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    """Links without those that close a circle among at most THIN of them: the tables find the same pairs over and over."""

    def forest(rows: np.ndarray) -> np.ndarray:
        nodes, at = np.unique(np.concatenate([rows[:, :n], rows[:, n:]]), axis=0, return_inverse=True)
        at, root, keep = at.reshape(-1), list(range(len(nodes))), []
        for i, (a, b) in enumerate(zip(at[: len(rows)].tolist(), at[len(rows) :].tolist())):
            while root[a] != a:
                root[a] = a = root[root[a]]
            while root[b] != b:
                root[b] = b = root[root[b]]
            if a != b:
                root[max(a, b)] = min(a, b)
                keep.append(i)
        return rows[keep]

    held, size, names = [], 0, [f"{s}{i}" for s in "ab" for i in range(n)]
    for batch in batches:
        held.append(np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns], axis=1))
        size += batch.num_rows
        if size >= THIN:
            held = [forest(np.concatenate(held))]
            if len(held[0]) > THIN // 2:
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in held[0].T], names)
                held = []
            size = sum(map(len, held))
    if size:
        rows = forest(np.concatenate(held))
        yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in rows.T], names)


def link_fingerprints(
    fingerprints: DataFrame, radius: int = 4, parts: int = 1, crowd: int = 8192, rounds: int = ROUNDS
) -> DataFrame:
    """(a, b), structs of the words: links between distinct fingerprints that join every pair within `radius` bits.

    `fingerprints` has only the words f0, f1, ... in distinct rows. Each link is itself within the radius. The buckets
    above `crowd` go to the next round; those still above it in the last are searched whole, in the order of their
    size: 16 bytes a fingerprint.
    """
    spark, words = fingerprints.sparkSession, fingerprints.columns
    n = len(words)
    work, masks, found = fingerprints.withColumn("mask", F.lit(0).cast("long")), {0: 0}, None
    for step in range(rounds):
        finer: list[tuple[int, int]] = []
        for key, mask in masks.items():
            open_bits = [b for b in range(64 * n) if not mask >> b & 1]
            finer += [(key, mask | new) for new in covering_masks(radius, open_bits, parts)]
        table = spark.createDataFrame(
            [(key, i, *_words(mask, n)) for i, (key, mask) in enumerate(finer)],
            "mask long, next long, " + ", ".join(f"m{i} long" for i in range(n)),
        )
        # Not many rows: tables of the crowded masks only. What is dealt does not hold the kept bits; they follow from it.
        dealt = work.join(F.broadcast(table), "mask").select("next", *[f"m{i}" for i in range(n)], *words)
        kept = [F.col(f"f{i}").bitwiseAND(F.col(f"m{i}")) for i in range(n)]
        rows = dealt.repartition("next", *kept).select("next", *[k.alias(f"k{i}") for i, k in enumerate(kept)], *words)
        columns = ["mask", *(f"a{i}" for i in range(n)), *(f"b{i}" for i in range(n))]
        limit = crowd if step < rounds - 1 else None
        solved = stage_table(
            rows.sortWithinPartitions("next", *[f"k{i}" for i in range(n)], *words).mapInArrow(
                lambda it, limit=limit: _link_rows(it, n, radius, limit), ", ".join(f"{c} long" for c in columns)
            ),
            "covering",
        )
        side = lambda s: F.struct(*[F.col(f"{s}{i}").alias(f"f{i}") for i in range(n)])
        flat = solved.where("mask = -1").select(*columns[1:])
        links = flat.mapInArrow(lambda it: _thin(it, n), ", ".join(f"{c} long" for c in columns[1:])).select(
            side("a").alias("a"), side("b").alias("b")
        )
        found = links if found is None else found.unionByName(links)
        crowded = solved.where("mask >= 0")
        masks = {r[0]: finer[r[0]][1] for r in crowded.select("mask").distinct().collect()}  # ids of tables
        if not masks:
            break
        work = crowded.select(*[F.col(f"a{i}").alias(f"f{i}") for i in range(n)], "mask").distinct()
    return found


def near_duplicates(
    docs: DataFrame, width: int = 4, radius: int = 4, bits: int = 64, parts: int = 1, crowd: int = 8192
) -> DataFrame:
    """(doc_id, digest, fingerprint, component_id) of every row of documents (doc_id, text).

    `fingerprint` is in lower-case hex, `component_id` is the smallest doc_id that links lead to. `digest` tells texts
    apart. A null or empty text has the fingerprint zero and is linked like any other; a null doc_id is a component_id
    only of a component without any other. Rows that repeat each give a row. Other columns are left out. An empty
    table gives an empty one.
    """
    words = [f"f{i}" for i in range(bits // 64)]
    rows = stage_table(with_fingerprints(docs, width, bits).withColumn("node", F.struct(*words)), "fingerprints")
    first = rows.groupBy("node").agg(F.min("doc_id").alias("first"))
    roots = connected_components(link_fingerprints(rows.select(*words).distinct(), radius, parts, crowd))
    rooted = stage_table(
        first.join(roots, "node", "left").select("node", "first", F.coalesce("root", "node").alias("root")), "roots"
    )
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    known = stage_table(rooted.join(least, "root").select("node", "component_id"), "classes")
    digits = F.concat(*[F.lpad(F.hex(w), 16, "0") for w in reversed(words)])
    return rows.join(known, "node").select("doc_id", "digest", F.lower(digits).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """The rows of `docs` (all columns) that stay if one document of each component does.

    `classes` is what `near_duplicates` gives for them. The row of the smallest doc_id stays, null last; of rows equal
    in doc_id and text one stays.
    """
    keep = classes.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest")).alias("k"))
    keys = keep.select(F.coalesce("k.doc_id", F.lit(0)).alias("_id"), F.col("k.none").alias("_none"), F.col("k.digest").alias("_digest"))
    keyed = docs.select(
        F.struct(*docs.columns).alias("_row"),
        F.coalesce("doc_id", F.lit(0)).alias("_id"),
        F.col("doc_id").isNull().alias("_none"),
        text_digest(F.col("text")).alias("_digest"),
    )
    on = ["_id", "_none", "_digest"]
    return keyed.join(keys, on, "left_semi").dropDuplicates(on).select("_row.*")
