"""Which tokens of one tokenizer stand for which tokens of another, by whitespace-token anchors.

A text is encoded whole by a byte-level BPE (A) and by a piece model (B); both see a space before it. Where tokens of both end
at the same byte, a group ends. Groups are not sought over whole texts: a token of A and one of B that start with a space at
the same byte are an anchor, for then the tokens before them end there too. Anchors cut a text into windows of token ids, about
one a word. Texts are taken some at a time; a window whose ids have come before among them is not aligned again.

1. A task encodes its texts, aligns them, and writes the alignment and the linked pairs of each, compressed; beside them it
   counts in how many texts a pair of ids is linked, and writes these counts whenever they have grown to a bound.
2. Counts are added up by pair, and a pair is best if no other has a larger count for its A id.
3. Each text gets the sums over its pairs. A pair table of proven size is broadcast; a larger one is joined.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
import tokenizers
from pyspark.sql import DataFrame, functions as F, types as T

from netsieve.llm.common import short_batches
from netsieve.llm.token_counts import PATTERN
from netsieve.session import stage_table

DEFAULT_BYTES = "/opt/tokenizers/byte_bpe_50k.json"
DEFAULT_PIECES = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"


@dataclass(frozen=True)
class Settings:
    """Texts are aligned together up to `chunk_tokens`, and alignments of windows are remembered as long. `max_counts` bounds the pairs that
    a task counts before it writes them, and `max_broadcast` the pairs of a table that is sent to every worker. Texts beyond
    `piece_chars` are encoded in pieces."""

    chunk_tokens: int = 1 << 18
    max_counts: int = 1 << 20
    max_broadcast: int = 1 << 21
    piece_chars: int = 1 << 18


def byte_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: visible bytes stand for themselves, the others follow
    from letter 256 on."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in visible]
    return {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Tokenizers:
    """Both tokenizers, and the bytes of their tokens by id."""

    def __init__(self, a: bytes, b: bytes):
        model = json.loads(a)["model"]
        letters = byte_letters()
        bytes_of = lambda token: bytes(letters[c] for c in token)
        ids = {bytes_of(token): i for token, i in model["vocab"].items()}
        merged = [ids[bytes_of("".join(m) if isinstance(m, list) else m.replace(" ", ""))] for m in model["merges"]]
        if all(x < y for x, y in zip(merged, merged[1:])):
            # Merges go by their ids, which ranks can state; this library takes a quarter of the time.
            ranks = tiktoken.Encoding("a", pat_str=PATTERN, mergeable_ranks=ids, special_tokens={})
            self.encode_a = ranks.encode_ordinary
        else:
            whole = tokenizers.Tokenizer.from_str(a.decode())
            whole.encode_special_tokens = True
            self.encode_a = lambda text: whole.encode(text, add_special_tokens=False).ids
        self.pieces = sentencepiece.SentencePieceProcessor(model_proto=b)
        self.bytes_a = [b""] * (max(ids.values()) + 1)
        for token, i in ids.items():
            self.bytes_a[i] = token
        names = [self.pieces.id_to_piece(i) for i in range(self.pieces.get_piece_size())]
        self.bytes_b = [bytes([int(n[1:-1], 16)]) if self.pieces.is_byte(i) else n.replace(SPACE, " ").encode() for i, n in enumerate(names)]
        self.lengths = tuple(np.array([len(x) for x in own], np.int64) for own in (self.bytes_a, self.bytes_b))
        # Ids as text with what follows them within a group and at its end.
        self.spelt = tuple(
            np.array([f"{i}{mark}" for mark in (",", end) for i in range(len(own))], object) for own, end in ((self.bytes_a, "|"), (self.bytes_b, ";"))
        )
        self.marked = tuple(np.array([x[:1] == b" " for x in own]) for own in (self.bytes_a, self.bytes_b))
        #: No piece spans the end of a word, so pieces of a text that begin with single spaces can be encoded by themselves.
        self.splits = not any(SPACE in n.lstrip(SPACE) for n in names)

    def encode(self, text: str, piece_chars: int) -> tuple[np.ndarray, np.ndarray] | None:
        """The ids of both, None if the tokens of either do not spell the text."""
        a: list[int] = []
        b: list[int] = []
        for piece in pieces_of(text, piece_chars if self.splits else len(text) + 1):
            a += self.encode_a(" " + piece)
            b += self.pieces.encode(piece)
        spelt = b" " + text.encode()
        if b"".join(map(self.bytes_a.__getitem__, a)) != spelt or b"".join(map(self.bytes_b.__getitem__, b)) != spelt:
            return None
        return np.array(a, np.uint32), np.array(b, np.uint32)


def pieces_of(text: str, size: int) -> Iterator[str]:
    """Parts of a text of about `size` letters. One space between parts is left out, and no white space stands beside it."""
    start = 0
    while len(text) - start > size:
        cut = text.find(" ", start + size)
        while cut >= 0 and (cut + 1 >= len(text) or text[cut - 1].isspace() or text[cut + 1].isspace()):
            cut = text.find(" ", cut + 1)
        if cut < 0:
            break
        yield text[start:cut]
        start = cut + 1
    yield text[start:]


#: Odd multipliers of the hash that finds equal windows.
_ODD = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93))


@dataclass
class Aligned:
    """Of some texts: how many groups and links, the groups as text, and of all linked pairs of each text, one after the other, how
    often they are linked; `until` is where those of a text end."""

    n_groups: np.ndarray
    n_links: np.ndarray
    groups: list[str]
    pairs: np.ndarray
    times: np.ndarray
    until: np.ndarray


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places starts[0], starts[0] + 1, ..., of sizes[0] in all, then those of starts[1], and so on."""
    return np.arange(sizes.sum()) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)


def windows(a: np.ndarray, b: np.ndarray, t: Tokenizers) -> tuple[np.ndarray, np.ndarray]:
    """Where windows begin among the tokens of either: at anchors. The first tokens of a text are one."""
    starts = [np.cumsum(n[own]) - n[own] for n, own in zip(t.lengths, (a, b))]
    spaced = [np.flatnonzero(m[own]) for m, own in zip(t.marked, (a, b))]
    left, right = (s[at] for s, at in zip(starts, spaced))
    place = np.minimum(np.searchsorted(right, left), len(right) - 1)
    shared = right[place] == left
    return spaced[0][shared], spaced[1][place[shared]]


@dataclass
class Kinds:
    """Of different windows: groups and links, the pairs of all links one after the other, and the groups as text, each with `;` behind."""

    n_groups: np.ndarray
    n_links: np.ndarray
    pairs: np.ndarray
    groups: list[str]


def align_windows(a: np.ndarray, b: np.ndarray, sizes: tuple[np.ndarray, np.ndarray], t: Tokenizers) -> Kinds:
    """Alignments of windows whose tokens stand one after the other. A pair is one number: the A id, then 32 bits of the B id."""
    ends = [np.cumsum(n[own]) for n, own in zip(t.lengths, (a, b))]
    # Windows end in both, so the offsets of one window after the other agree, and no group reaches beyond its window.
    shared = np.intersect1d(*ends, assume_unique=True)
    until = [np.searchsorted(e, shared) + 1 for e in ends]
    many = [np.diff(u, prepend=0) for u in until]
    owner = np.searchsorted(np.cumsum(sizes[0]), until[0])
    links = many[0] * many[1]
    group = np.repeat(np.arange(len(shared)), links)
    within = ragged(np.zeros(len(shared), np.int64), links)
    left, right = ((u - m)[group] for u, m in zip(until, many))
    pairs = a[left + within // many[1][group]].astype(np.int64) << 32 | b[right + within % many[1][group]]
    # Tokens in the order of the text: those of a group of A, then those of B.
    spelt = np.empty(len(a) + len(b), object)
    places = [ragged(until[0] - many[0] + until[1] - many[1], many[0]), ragged(until[0] + until[1] - many[1], many[1])]
    for own, place, names, stop in zip((a, b), places, t.spelt, until):
        last = np.zeros(len(own), np.int64)
        last[stop - 1] = len(names) // 2
        spelt[place] = names[own + last]
    whole, bounds = spelt.tolist(), np.cumsum([0, *(sizes[0] + sizes[1])]).tolist()
    n = len(sizes[0])
    return Kinds(
        np.bincount(owner, minlength=n),
        np.bincount(owner, links, n).astype(np.int64),
        pairs,
        ["".join(whole[x:y]) for x, y in zip(bounds, bounds[1:])],
    )


def align(texts: list[tuple[np.ndarray, np.ndarray]], t: Tokenizers) -> Aligned:
    """Alignments of texts with tokens from those of their windows, each kind of which is aligned once."""
    a, b = (np.concatenate([x[side] for x in texts]) for side in (0, 1))
    i, j = windows(a, b, t)
    sizes = np.diff(i, append=len(a)), np.diff(j, append=len(b))
    first, own = _equal_windows((a, b), (i, j), sizes)
    chosen = tuple(size[first] for size in sizes)
    kinds = align_windows(a[ragged(i[first], chosen[0])], b[ragged(j[first], chosen[1])], chosen, t)
    bounds = np.searchsorted(i, np.cumsum([0, *(len(x[0]) for x in texts)]))
    text = np.repeat(np.arange(len(texts)), np.diff(bounds))
    order = own.tolist()
    spelt = ["".join(map(kinds.groups.__getitem__, order[x:y]))[:-1] for x, y in zip(bounds.tolist(), bounds[1:].tolist())]
    pairs, at = np.unique(kinds.pairs, return_inverse=True)
    # Each window once a text, then each pair once a text, with how often they come.
    seen, times = np.unique(text * len(first) + own, return_counts=True)
    owner, kind = np.divmod(seen, len(first))
    many = kinds.n_links[kind]
    linked = at[ragged((np.cumsum(kinds.n_links) - kinds.n_links)[kind], many)]
    codes, back = np.unique(np.repeat(owner, many) * len(pairs) + linked, return_inverse=True)
    owner, which = np.divmod(codes, len(pairs))
    return Aligned(
        np.bincount(text, kinds.n_groups[own], len(texts)).astype(np.int64),
        np.bincount(text, kinds.n_links[own], len(texts)).astype(np.int64),
        spelt,
        pairs[which],
        np.bincount(back, np.repeat(times, many)).astype(np.int64),
        np.searchsorted(owner, np.arange(len(texts)), "right"),
    )


def _equal_windows(ids: tuple[np.ndarray, ...], starts: tuple[np.ndarray, ...], sizes: tuple[np.ndarray, ...]) -> tuple[np.ndarray, np.ndarray]:
    """(a window of each kind, the kind of each window). Should two kinds share a hash, every window is a kind of its own."""
    n = len(starts[0])
    hashed, places = np.zeros(n, np.uint64), []
    with np.errstate(over="ignore"):
        for own, start, size, odd in zip(ids, starts, sizes, _ODD):
            within = ragged(np.zeros(n, np.int64), size)
            mixed = (own.astype(np.uint64) + _ODD[2]) * odd * (2 * within.astype(np.uint64) + _ODD[3])
            mixed = (mixed ^ mixed >> np.uint64(29)) * _ODD[3]
            hashed = hashed * _ODD[2] + np.add.reduceat(mixed ^ mixed >> np.uint64(32), start) + size.astype(np.uint64)
            places.append(within)
    _, first, kind = np.unique(hashed, return_index=True, return_inverse=True)
    model = first[kind]
    same = all((size == size[model]).all() for size in sizes) and all(
        (own == own[np.repeat(start[model], size) + within]).all() for own, start, size, within in zip(ids, starts, sizes, places)
    )
    return (first, kind) if same else (np.arange(n), np.arange(n))


@dataclass(frozen=True)
class Vocabularies:
    """The files of both tokenizers, about two MB; they are broadcast."""

    a: bytes
    b: bytes

    @staticmethod
    def read(a: str = DEFAULT_BYTES, b: str = DEFAULT_PIECES) -> Vocabularies:
        with open(a, "rb") as left, open(b, "rb") as right:
            return Vocabularies(left.read(), right.read())


_MADE: dict[bytes, Tokenizers] = {}


def _tokenizers(vocabularies: Vocabularies) -> Tokenizers:
    """Made once in a worker."""
    name = hashlib.sha256(vocabularies.a + vocabularies.b).digest()
    if name not in _MADE:
        _MADE[name] = Tokenizers(vocabularies.a, vocabularies.b)
    return _MADE[name]


class _Counts:
    """In how many texts each pair is linked, with a bound on what is held."""

    def __init__(self, bound: int):
        self.bound, self.held, self.waiting = bound, 0, []

    def add(self, pairs: np.ndarray) -> None:
        self.waiting.append(np.unique(pairs, return_counts=True))
        self.held += len(self.waiting[-1][0])

    def fold(self) -> tuple[np.ndarray, np.ndarray]:
        if len(self.waiting) > 1:
            pairs, at = np.unique(np.concatenate([w[0] for w in self.waiting]), return_inverse=True)
            self.waiting = [(pairs, np.bincount(at, np.concatenate([w[1] for w in self.waiting]), minlength=len(pairs)).astype(np.int64))]
        if not self.waiting:
            self.waiting = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        self.held = len(self.waiting[0][0])
        return self.waiting[0]

    def full(self) -> bool:
        return self.held > 4 * self.bound and len(self.fold()[0]) > self.bound


#: Pairs and counts of one row.
COUNTS_A_ROW = 1 << 16


def encode_texts(docs: DataFrame, vocabularies: Vocabularies, settings: Settings = Settings()) -> DataFrame:
    """`docs` (with text) aligned, written once: (row, n_a, n_b, n_groups, n_links, groups, n_text, links, n_pairs), with rows among them
    that hold counts of pairs instead.

    `row` is a struct of the columns of `docs` but text. `groups` is the alignment as text and `links` its pairs with how often each is
    linked, both compressed; a text without tokens has none.
    """
    short_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(vocabularies)
    others = [c for c in docs.columns if c != "text"]
    packed = docs.select(F.struct(*others).alias("row"), "text")
    schema = T.StructType([T.StructField("row", packed.schema["row"].dataType)])
    number, numbers = T.LongType(), T.ArrayType(T.LongType())
    for name in ("n_a", "n_b", "n_groups", "n_links"):
        schema.add(name, number)
    schema.add("groups", T.BinaryType()).add("n_text", number).add("links", T.BinaryType()).add("n_pairs", number)
    schema.add("pairs", numbers).add("counts", numbers)
    names, lists = schema.names, pa.list_(pa.int64())

    def aligned(t: Tokenizers, counts: _Counts, rows: pa.Array, texts: list[bytes | None]) -> Iterator[pa.RecordBatch]:
        encoded = [_encoded(t, text, settings) for text in texts]
        whole = [i for i, e in enumerate(encoded) if e is not None]
        values = np.zeros((6, len(texts)), np.int64)
        groups: list[bytes | None] = [None] * len(texts)
        links: list[bytes | None] = [None] * len(texts)
        if whole:
            found = align([encoded[i] for i in whole], t)
            counts.add(found.pairs)
            values[2, whole], values[3, whole] = found.n_groups, found.n_links
            start = 0
            for i, text, stop in zip(whole, found.groups, found.until.tolist()):
                values[0, i], values[1, i], values[4, i], values[5, i] = len(encoded[i][0]), len(encoded[i][1]), len(text), stop - start
                groups[i] = pa.compress(text.encode(), codec="zstd", asbytes=True)
                links[i] = _packed(found.pairs[start:stop], found.times[start:stop])
                start = stop
        n, numbers = len(texts), [pa.array(v) for v in values]
        columns = [rows, *numbers[:4], pa.array(groups, pa.binary()), numbers[4], pa.array(links, pa.binary()), numbers[5]]
        yield pa.RecordBatch.from_arrays([*columns, pa.nulls(n, lists), pa.nulls(n, lists)], names)

    def counted(counts: _Counts, rows: pa.DataType) -> Iterator[pa.RecordBatch]:
        found = counts.fold()
        counts.waiting, counts.held = [], 0
        none = [pa.nulls(1, t) for t in [rows, *[pa.int64()] * 4, pa.binary(), pa.int64(), pa.binary(), pa.int64()]]
        for at in range(0, len(found[0]), COUNTS_A_ROW):
            parts = [x[at : at + COUNTS_A_ROW] for x in found]
            own = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x)) for x in parts]
            yield pa.RecordBatch.from_arrays([*none, *own], names)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, counts, kind = _tokenizers(shared.value), _Counts(settings.max_counts), pa.null()
        for batch in batches:
            rows, texts = batch.column("row"), batch.column("text").cast(pa.large_binary())
            kind, start, held = rows.type, 0, 0
            for i in range(len(texts)):
                # A token has some three bytes of either tokenizer.
                held += len(texts[i].as_py() or b"") * 2 // 3
                if held >= settings.chunk_tokens or i == len(texts) - 1:
                    yield from aligned(t, counts, rows[start : i + 1], texts[start : i + 1].to_pylist())
                    start, held = i + 1, 0
            if counts.full():
                yield from counted(counts, kind)
        yield from counted(counts, kind)

    # Rows are numbered here, once, for later readings may be dealt otherwise.
    return stage_table(packed.mapInArrow(encode, schema).withColumn("at", F.monotonically_increasing_id()), "alignments")


def _packed(pairs: np.ndarray, times: np.ndarray) -> bytes:
    """Sorted pairs and how often they come; differences of the A ids are small."""
    a = np.diff(pairs >> 32, prepend=0)
    return pa.compress(np.concatenate([a, pairs & 0xFFFFFFFF, times]).astype(np.uint32).tobytes(), codec="zstd", asbytes=True)


def _unpacked(links: bytes | None, n: int) -> tuple[np.ndarray, np.ndarray]:
    if not links:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    a, b, times = np.frombuffer(pa.decompress(links, 12 * n, "zstd", asbytes=True), np.uint32).astype(np.int64).reshape(3, n)
    return np.cumsum(a) << 32 | b, times


def _encoded(t: Tokenizers, text: bytes | None, settings: Settings) -> tuple[np.ndarray, np.ndarray] | None:
    if not text:
        return None
    try:
        return t.encode(text.decode(), settings.piece_chars)
    except UnicodeDecodeError:  # no tokens spell it
        return None


def pair_counts(encoded: DataFrame) -> DataFrame:
    """(pair, a, b, documents, is_best), written once: how many texts link a pair of ids, and whether no pair of its A id has more."""
    partial = encoded.where("pairs IS NOT NULL").select(F.explode(F.arrays_zip("pairs", "counts")).alias("x"))
    totals = partial.groupBy(F.col("x.pairs").alias("pair")).agg(F.sum("x.counts").alias("documents"))
    a, b = F.shiftright("pair", 32), F.col("pair").bitwiseAND(F.lit((1 << 32) - 1))
    totals = stage_table(totals.select("pair", a.alias("a"), b.alias("b"), "documents"), "pairs")
    # One row for each id of A at most, so never more than its vocabulary.
    most = totals.groupBy("a").agg(F.max("documents").alias("most"))
    return totals.join(F.broadcast(most), "a").select("pair", "a", "b", "documents", (F.col("documents") == F.col("most")).alias("is_best"))


def align_documents(
    docs: DataFrame, vocabularies: Vocabularies | None = None, settings: Settings = Settings()
) -> tuple[DataFrame, DataFrame]:
    """(documents, pairs). Documents are the rows of `docs` with their columns but text, and with n_a, n_b, n_groups, n_links,
    n_best, count_sum and `groups`, the alignment as text (`a1,a2|b1;a3|b2,b3`: ids of A and of B of each group). Pairs are
    those of `pair_counts`.

    Each row is a document, repeated rows and null ids included. A text that is null or empty, or that the tokens of either do
    not spell, has zeros and an empty `groups`. Columns of `docs` that are named like the new ones raise an error. Texts of any
    length are encoded whole; beyond `piece_chars`, in pieces where neither tokenizer joins what stands on both sides.
    """
    added = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"]
    clash = sorted(set(added) & set(docs.columns))
    if clash:
        raise ValueError(f"columns would be replaced: {clash}")
    vocabularies = vocabularies or Vocabularies.read()
    if docs.columns == ["text"]:
        docs = docs.withColumn("_", F.lit(0))
    encoded = encode_texts(docs, vocabularies, settings)
    pairs = pair_counts(encoded)
    texts = encoded.where("pairs IS NULL").drop("pairs", "counts")
    small = pairs.limit(settings.max_broadcast + 1).count() <= settings.max_broadcast
    summed = _with_broadcast(texts, pairs) if small else _with_join(texts, pairs)
    kept = [F.col(f"row.`{c}`").alias(c) for c in docs.columns if c not in ("text", "_")]
    return summed.select(*kept, *added[:-1], _spelt("groups", "n_text").alias("groups")), pairs


@F.arrow_udf(T.StringType())
def _spelt(groups: pa.Array, sizes: pa.Array) -> pa.Array:
    whole = zip(groups.to_pylist(), sizes.to_pylist())
    return pa.array([pa.decompress(x, n, "zstd", asbytes=True).decode() if x else "" for x, n in whole], pa.string())


def _with_broadcast(texts: DataFrame, pairs: DataFrame) -> DataFrame:
    table = pairs.select("pair", "documents", "is_best").toPandas().sort_values("pair")  # at most `max_broadcast` rows
    columns = (table["pair"].to_numpy(np.int64), table["documents"].to_numpy(np.int64), table["is_best"].to_numpy(bool))
    known = texts.sparkSession.sparkContext.broadcast(columns)

    @F.arrow_udf("n_best long, count_sum long")
    def sums(links: pa.Array, n_pairs: pa.Array) -> pa.Array:
        names, documents, best = known.value
        out = np.zeros((2, len(links)), np.int64)
        for i, (own, n) in enumerate(zip(links.to_pylist(), n_pairs.to_pylist())):
            found, times = _unpacked(own, n)
            at = np.searchsorted(names, found)
            out[:, i] = times @ best[at], times @ documents[at]
        return pa.StructArray.from_arrays([pa.array(x) for x in out], ["n_best", "count_sum"])

    return texts.withColumn("made", sums("links", "n_pairs")).select(*texts.columns, "made.*")


def _with_join(texts: DataFrame, pairs: DataFrame) -> DataFrame:
    """The same where pairs are too many to be sent to every worker."""

    @F.arrow_udf("array<struct<pair:bigint,times:bigint>>")
    def listed(links: pa.Array, n_pairs: pa.Array) -> pa.Array:
        found = [_unpacked(own, n) for own, n in zip(links.to_pylist(), n_pairs.to_pylist())]
        until = np.cumsum([0, *(len(x[0]) for x in found)])
        flat = [pa.array(np.concatenate([x[i] for x in found] or [np.zeros(0, np.int64)])) for i in (0, 1)]
        return pa.ListArray.from_arrays(pa.array(until, pa.int32()), pa.StructArray.from_arrays(flat, ["pair", "times"]))

    each = texts.select("at", F.explode(listed("links", "n_pairs")).alias("x")).select("at", "x.*").join(pairs, "pair")
    best = F.when(F.col("is_best"), F.col("times")).otherwise(0)
    totals = each.groupBy("at").agg(F.sum(F.col("times") * F.col("documents")).alias("count_sum"), F.sum(best).alias("n_best"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return texts.join(totals, "at", "left").select(*texts.columns, zero("n_best"), zero("count_sum"))
