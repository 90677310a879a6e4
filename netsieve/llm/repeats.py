"""Removal of repeated passages by longest-previous-factor arrays.

A string of `length` bytes that starts at two places is repeated. Suffix order is needed only where repeats can be:

1. Each window of `length` bytes has an anchor, the leftmost of its `gram`-byte strings with the smallest hash. Equal
   windows have equal anchors at equal offsets. Windows of one document with one anchor are consecutive; they make a piece, the
   bytes that they cover. Pieces are rows (hash of the anchor, hash of the bytes, place); no text is sent.
2. Equal pieces are counted. Of each class of equal ones, the first stands for all.
3. Different pieces with one anchor may share some of their windows. Their texts are gathered by anchor, and a task
   builds suffix order and longest-previous-factor arrays over whole groups of them: a window is removed if it has an
   earlier match (or, on demand, any). Groups above `crowd` pieces are first cut: windows that start in the left and
   in the right half of the piece go on separately, keyed by the bytes common to all windows of a half. At one window
   per piece that key is the window, so every group becomes small.
4. The spans of a document are merged and cut from its text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from netsieve.llm.common import short_batches
from netsieve.llm.suffixes import repeated_starts
from netsieve.session import drop_table, stage_table

CHUNK_BITS = 18
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
MIX = 0xD6E8FEB86659FD93
#: Bytes of pieces whose suffix order is built at once.
BATCH_BYTES = 1 << 18
SPANS = "array<struct<start int, stop int>>"


class Pieces:
    """Cuts texts into pieces, some at a time."""

    def __init__(self, length: int, gram: int):
        self.length, self.gram = length, gram
        self.power, self.inverse = (self._powers(b, 1 << CHUNK_BITS) for b in (BASE, INVERSE))

    @staticmethod
    def _powers(base: int, count: int) -> np.ndarray:
        factors = np.full(count, base, np.uint64)
        factors[0] = 1
        return np.cumprod(factors, dtype=np.uint64)

    def anchors(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each window in `data`: the place of its anchor and the anchor's hash."""
        n, gram = len(data), self.gram
        with np.errstate(over="ignore"):
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.power[:n])])
            grams = (sums[gram:] - sums[:-gram]) * self.inverse[: n - gram + 1]
            grams ^= grams >> np.uint64(32)
            grams *= np.uint64(MIX)
            grams ^= grams >> np.uint64(29)
        low = np.uint64((1 << CHUNK_BITS) - 1)
        value = (grams & ~low) | np.arange(len(grams), dtype=np.uint64)
        width = self.length - gram + 1
        blocks = -(-len(value) // width)
        padded = np.full(blocks * width, np.iinfo(np.uint64).max)
        padded[: len(value)] = value
        grid = padded.reshape(blocks, width)
        ahead = np.minimum.accumulate(grid, axis=1).reshape(-1)
        behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].reshape(-1)
        count = n - self.length + 1
        place = (np.minimum(behind[:count], ahead[width - 1 : width - 1 + count]) & low).astype(np.int64)
        return place, grams[place]

    def cut(self, data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, ...]:
        """(text, first window from the text's start, windows, place of the anchor from there, anchor hash, piece hash) of
        texts that begin at `starts`."""
        if len(data) < self.length:
            return tuple(np.zeros(0, np.int64) for _ in range(6))
        place, anchor = self.anchors(data)
        stops = np.append(starts[1:], len(data))
        owner = np.repeat(np.arange(len(starts)), stops - starts)[: len(place)]
        whole = np.arange(len(place)) + self.length <= stops[owner]
        edge = np.concatenate([[True], (place[1:] != place[:-1]) | (owner[1:] != owner[:-1]) | (whole[1:] != whole[:-1])])
        first = np.flatnonzero(edge)
        count = np.diff(np.append(first, len(place)))
        first, count = first[whole[first]], count[whole[first]]
        view, digest, more = memoryview(data), xxhash.xxh3_64_intdigest, self.length - 1
        hashes = np.fromiter(
            (digest(view[a:b]) for a, b in zip(first.tolist(), (first + count + more).tolist())), np.uint64, len(first)
        )
        text = owner[first]
        return text, first - starts[text], count, place[first] - first, anchor[first].view(np.int64), hashes.view(np.int64)


def _texts(column: pa.Array) -> list[bytes]:
    return [v.as_py() or b"" for v in column.cast(pa.large_binary())]


def _cut_batches(batches: Iterator[pa.RecordBatch], length: int, gram: int) -> Iterator[pa.RecordBatch]:
    """Rows (id, digest, text) to PIECE."""
    pieces, room = Pieces(length, gram), 1 << CHUNK_BITS

    def emit(parts: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
        """parts: row, offset of the part in its text, bytes."""
        data = np.frombuffer(b"".join(p[2] for p in parts), np.uint8)
        starts = np.cumsum([0, *[len(p[2]) for p in parts]])[:-1]
        part, first, count, at_anchor, anchor, piece = pieces.cut(data, starts)
        rows, offsets = np.array([p[0] for p in parts]), np.array([p[1] for p in parts])
        at = pa.array(rows[part])
        place = (first + offsets[part]) << 2 * FIELD | count << FIELD | at_anchor
        columns = [ids.take(at), digests.take(at), pa.array(place), pa.array(anchor), pa.array(piece)]
        return pa.RecordBatch.from_arrays(columns, ["id", "digest", "place", "key", "piece"])

    for batch in batches:
        ids, digests = batch.column("id"), batch.column("digest")
        parts, held = [], 0
        for row, text in enumerate(_texts(batch.column("text"))):
            step = room - length + 1
            for at in range(0, max(1, len(text) - length + 1), step):
                part = text[at : at + room]
                if len(part) < length:
                    continue
                if held + len(part) > room:
                    yield emit(parts)
                    parts, held = [], 0
                parts.append((row, at, part))
                held += len(part)
        if parts:
            yield emit(parts)


#: `place` packs the first window of a piece, the number of its windows and the place of its anchor, in this order.
PIECE = "id long, digest long, place long, key long, piece long"
RUN = "id long, digest long, first int, windows int"
WANTED = ("key", "at", "low", "high", "id", "digest", "first", "windows")
BODY = "key long, at int, low int, high int, id long, digest long, first int, windows int, body binary"
FIELD = 12


def _match_groups(batches: Iterator[pa.RecordBatch], length: int, keep: str) -> Iterator[pa.RecordBatch]:
    """Over BODY sorted by key and place: RUN of the windows that are repeated. Groups are never divided."""

    def solve(rows: dict) -> pa.RecordBatch:
        bodies = rows["body"]
        sizes = np.fromiter(map(len, bodies), np.int64, len(bodies)) + 1
        starts = np.cumsum(sizes) - sizes
        symbols = np.frombuffer(b"\x00".join(bodies) + b"\x00", np.uint8).astype(np.int64) + 1
        symbols[starts + sizes - 1] = 0
        earlier, later = repeated_starts(symbols, length)
        marked = earlier if keep == "first" else earlier | later
        windows = np.array(rows["windows"], np.int64)
        inside = np.zeros(len(symbols) + 1, np.int64)
        np.add.at(inside, starts, 1)
        np.add.at(inside, starts + windows, -1)
        marked &= np.cumsum(inside)[:-1] > 0  # only starts of windows; they have `length` bytes before the end
        # Runs do not go over pieces, for the end of a piece is no start of a window.
        edges = np.diff(np.concatenate([[0], marked.view(np.int8), [0]]))
        a, b = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
        piece = np.searchsorted(starts, a, "right") - 1
        pick = lambda name: np.array(rows[name], np.int64)[piece]
        return pa.RecordBatch.from_arrays(
            [pa.array(pick("id")), pa.array(pick("digest")), pa.array((pick("first") + a - starts[piece]).astype(np.int32)),
             pa.array((b - a).astype(np.int32))], ["id", "digest", "first", "windows"],
        )

    names = ["key", "id", "digest", "first", "windows", "body"]
    held: dict[str, list] = {n: [] for n in names}
    size = 0
    for batch in batches:
        for row in zip(*[batch.column(n).to_pylist() for n in names]):
            if size >= BATCH_BYTES and row[0] != held["key"][-1]:
                yield solve(held)
                held, size = {n: [] for n in names}, 0
            for n, v in zip(names, row):
                held[n].append(v)
            size += len(row[5])
    if held["key"]:
        yield solve(held)


def _body_batch(rows: list[tuple], more: tuple[str, ...] = ("body",)) -> pa.RecordBatch:
    names = [*WANTED, *more]
    columns = list(zip(*rows)) if rows else [[] for _ in names]
    long = ("key", "id", "digest", "place", "piece")
    kinds = [pa.int64() if n in long else pa.binary() if n == "body" else pa.int32() for n in names]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)


def _unpack(place: int) -> tuple[int, int, int]:
    field = (1 << FIELD) - 1
    return place >> 2 * FIELD, place >> FIELD & field, place & field


def _bodies(batches: Iterator[pa.RecordBatch], length: int, low: int) -> Iterator[pa.RecordBatch]:
    """Rows (id, digest, text, wanted) to BODY. Windows start up to -`low` bytes before the anchor."""
    rows: list[tuple] = []
    size = 0
    for batch in batches:
        texts, wanted = batch.column("text").cast(pa.large_binary()), batch.column("wanted")
        for i, (id_, digest) in enumerate(zip(batch.column("id").to_pylist(), batch.column("digest").to_pylist())):
            text = texts[i].as_py() or b""
            for w in wanted[i].as_py():
                first, windows, at = _unpack(w["place"])
                body = text[first : first + windows + length - 1]
                rows.append((w["key"], at, low, 1, id_, digest, first, windows, body))
                size += len(body)
            if size > 2 << 20:
                yield _body_batch(rows)
                rows, size = [], 0
    yield _body_batch(rows)


def _halve(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Pieces, with their texts, to their left and right halves, keyed by what all windows of a half have in common.

    Starts of windows are counted from the byte `at` of a piece, which has the same part in all pieces of its group: they
    may go from `low` to `high` - 1 there, all at or before it. Equal windows of two pieces thus go to the same half.
    """
    unsigned = (1 << 64) - 1
    signed = lambda h: h - (1 << 64) if h >> 63 else h
    for batch in batches:
        rows: list[tuple] = []
        for key, at, low, high, id_, digest, first, windows, body in zip(*[batch.column(n).to_pylist() for n in (*WANTED, "body")]):
            middle = (low + high) // 2
            for a, b in ((low, middle), (middle, high)):
                s, e = max(0, at + a), min(windows, at + b)
                if s >= e:
                    continue
                common = xxhash.xxh3_64_intdigest(body[at + b - 1 : at + a + length], (key ^ a) & unsigned)
                own = body[s : e + length - 1]
                place = first + s << 2 * FIELD | e - s << FIELD
                rows.append((signed(common), at - s, a, b, id_, digest, first + s, e - s, own, place, signed(xxhash.xxh3_64_intdigest(own))))
        yield _body_batch(rows, ("body", "place", "piece"))


def _classes(pieces: DataFrame) -> DataFrame:
    """(key, piece, n, m, r) of the classes of equal pieces that matter: n members, m classes with the key, r the first.

    Members are counted before the shuffle, and so are the classes of a key. What is joined is written first, so that a hot
    key is split; and it is joined by merging at every size.
    """
    classes = pieces.groupBy("key", "piece").agg(F.count("*").alias("n"), F.min(F.struct("id", "digest", "place")).alias("r"))
    classes = stage_table(classes, "classes")
    groups = stage_table(classes.groupBy("key").agg(F.count("*").alias("m")).where("m > 1"), "class-groups")
    return classes.join(groups.hint("merge"), "key", "left").where("n > 1 or m is not null")


def _covered(pieces: DataFrame, classes: DataFrame, keep: str) -> DataFrame:
    """RUN of pieces that equal another: all of them, or all but the first."""
    repeated = classes.where("n > 1").select("key", "piece", *(["r"] if keep == "first" else []))
    found = pieces.join(repeated.hint("merge"), ["key", "piece"])
    if keep == "first":
        found = found.where((F.col("r.id") != F.col("id")) | (F.col("r.digest") != F.col("digest")) | (F.col("r.place") != F.col("place")))
    windows = F.shiftright("place", FIELD).bitwiseAND(F.lit((1 << FIELD) - 1))
    return found.select(
        "id", "digest", F.shiftright("place", 2 * FIELD).cast("int").alias("first"), windows.cast("int").alias("windows")
    )


def keyed_documents(docs: DataFrame) -> DataFrame:
    """(id, digest, text, row): documents are told apart by doc_id and, should any repeat, all 64 bits of a hash of the text. Where
    every doc_id stands once, null being one too, digests are zero, which takes hardly any room in what is shuffled.
    `row` holds all columns but the text."""
    none = F.col("doc_id").isNull()
    # A number stands for itself and a null for 0, so both may meet.
    own = F.coalesce(F.col("doc_id").cast("long"), F.lit(0))
    unique = docs.groupBy(own).count().where("count > 1").isEmpty()
    return docs.select(
        own.alias("id"),
        # No constant, which the optimizer would carry into the joins and so deal texts twice.
        F.pmod(own, F.lit(1)).alias("digest") if unique else F.xxhash64(F.coalesce("text", F.lit("")), none).alias("digest"),
        "text",
        F.struct(*[c for c in docs.columns if c != "text"]).alias("row"),
    )


def with_repeats(
    docs: DataFrame, length: int = 200, keep: str = "first", gram: int = 32, crowd: int = 4096
) -> DataFrame:
    """(text, row, spans): for every row of `docs` the spans of bytes, merged and in order, that repeat others.

    A byte is in a span if a string of `length` bytes that covers it also starts elsewhere in the texts, whole texts and
    the same one included. With keep="first" only strings that start somewhere earlier count (in the order of doc_id,
    then of a hash of the text, then of the place), so the first copy stays; with keep="none" no copy does.
    `row` holds all other columns. A null or short text has no spans. Rows that agree in doc_id and text are copies of each
    other; where the first copy stays, they all keep what the first of them keeps. A null doc_id counts as 0.
    """
    if not 1 <= gram <= length < 1 << FIELD:
        raise ValueError(f"lengths must be 1 <= gram <= length < {1 << FIELD}")
    spark = docs.sparkSession
    short_batches(spark)
    keyed = keyed_documents(docs)
    pieces = stage_table(
        keyed.select("id", "digest", "text").mapInArrow(lambda it: _cut_batches(it, length, gram), PIECE), "pieces"
    )
    # Most anchors stand once: without them everything that follows is smaller.
    shared = stage_table(pieces.groupBy("key").count().where("count > 1").select("key"), "shared-keys")
    every, pieces = pieces, stage_table(pieces.join(shared.hint("merge"), "key", "left_semi"), "shared-pieces")
    drop_table(every, shared)
    classes = stage_table(_classes(pieces), "piece-classes")
    runs = [_covered(pieces, classes, keep)]
    most = classes.agg(F.max("m")).first()[0] or 0

    def bodies(groups: DataFrame) -> DataFrame:
        wanted = groups.select("key", "r.id", "r.digest", "r.place").groupBy("id", "digest").agg(
            F.collect_list(F.struct("key", "place")).alias("wanted")
        )
        texts = keyed.select("id", "digest", "text")
        found = texts.join(wanted.hint("merge"), ["id", "digest"]).dropDuplicates(["id", "digest"])
        return found.mapInArrow(lambda it: _bodies(it, length, gram - length), BODY)

    def matches(rows: DataFrame) -> DataFrame:
        ordered = rows.repartition("key").sortWithinPartitions("key", "id", "digest", "first")
        return ordered.mapInArrow(lambda it: _match_groups(it, length, keep), RUN)

    # Written before spans are gathered, so that texts of pieces no longer take up disks then.
    runs.append(stage_table(matches(bodies(classes.where(F.col("m") <= crowd))), "runs"))
    crowded = bodies(classes.where(F.col("m") > crowd))
    shared_pieces, all_classes = pieces, classes
    while most > crowd:
        halves = stage_table(crowded.mapInArrow(lambda it: _halve(it, length), BODY + ", place long, piece long"), "halves")
        classes = stage_table(_classes(halves), "half-classes")
        runs.append(stage_table(_covered(halves, classes, keep), "half-runs"))
        most = classes.agg(F.max("m")).first()[0] or 0
        firsts = classes.where("m is not null").select("key", "piece", "m", "r.*")
        rest = halves.join(firsts, ["key", "piece", "id", "digest", "place"]).select(*WANTED, "body", "m")
        runs.append(stage_table(matches(rest.where(F.col("m") <= crowd).drop("m")), "half-runs"))
        crowded = rest.where(F.col("m") > crowd).drop("m")
    found = runs[0]
    for more in runs[1:]:
        found = found.unionByName(more)
    gathered = found.groupBy("id", "digest").agg(F.collect_list(F.struct("first", "windows")).alias("found"))

    @F.arrow_udf(SPANS)
    def merged(found: pa.Array) -> pa.Array:
        return _merge(found, length)

    # Whole texts are dealt only now, when all else is written and removed.
    spans = stage_table(gathered.select("id", "digest", merged("found").alias("spans")), "spans")
    drop_table(shared_pieces, all_classes)
    joined = keyed.join(spans.hint("merge"), ["id", "digest"], "left")
    return joined.select("text", "row", F.coalesce("spans", F.array().cast(SPANS)).alias("spans"))


def _merge(found: pa.Array, length: int) -> pa.Array:
    """Runs of windows (first, windows) to merged spans of the bytes that they cover."""
    out = []
    for value in found:
        runs = value.as_py() or []
        spans: list[dict] = []
        for a, b in sorted((r["first"], r["first"] + r["windows"] + length - 1) for r in runs):
            if spans and a <= spans[-1]["stop"]:
                spans[-1]["stop"] = max(b, spans[-1]["stop"])
            else:
                spans.append({"start": a, "stop": b})
        out.append(spans)
    return pa.array(out, pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())])))


def kept_bytes(text: bytes, spans: list[dict]) -> bytes:
    out, at = [], 0
    for s in spans:
        out.append(text[at : s["start"]])
        at = s["stop"]
    return b"".join([*out, text[at:]])


def kept_digest(text: Column, spans: Column) -> Column:
    """SHA-256, in lower-case hex, of the bytes outside the spans; a null text has none."""

    @F.arrow_udf("string")
    def digest(texts: pa.Array, spans: pa.Array) -> pa.Array:
        pairs = zip(texts.cast(pa.large_binary()), spans)
        return pa.array([hashlib.sha256(kept_bytes(t.as_py() or b"", s.as_py())).hexdigest() for t, s in pairs], pa.string())

    return digest(text, spans)


def cut_text(text: Column, spans: Column) -> Column:
    """The text without the spans; characters that a span holds only in part stay. A null text stays null."""

    @F.arrow_udf("string")
    def cut(texts: pa.Array, spans: pa.Array) -> pa.Array:
        out = []
        for value, found in zip(texts.cast(pa.large_binary()), spans):
            text, whole = value.as_py(), []
            for s in found.as_py() if text else []:
                a, b = s["start"], s["stop"]
                while a < b and text[a] & 0xC0 == 0x80:
                    a += 1
                while b > a and b < len(text) and text[b] & 0xC0 == 0x80:
                    b -= 1
                whole.append({"start": a, "stop": b})
            out.append(text if text is None else kept_bytes(text, whole).decode())
        return pa.array(out, pa.string())

    return cut(text, spans)


def repeat_report(docs: DataFrame, length: int = 200, keep: str = "none", **limits: int) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans) of every row; other columns are left out."""
    found = with_repeats(docs.select("doc_id", "text"), length, keep, **limits)
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda t, s: t + s["stop"] - s["start"])
    return found.select(
        F.col("row.doc_id").alias("doc_id"),
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
        removed.alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        kept_digest(F.col("text"), F.col("spans")).alias("kept_sha256"),
        "spans",
    )
