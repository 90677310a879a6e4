"""Token counts that follow edits: a segment tree over the pre-tokens of each document.

A byte-level BPE cuts a text into pre-tokens and merges inside each, so the count of a text is the sum over its
pre-tokens. A document keeps two segment trees over them, of tokens and of characters. An edit finds its place by the
tree of characters, cuts the text anew from two pre-tokens before it until a new boundary falls on an old one behind it,
encodes only that region and updates the sums above it. The pattern reads left to right and a match depends only on
what follows its start, so what lies behind a common boundary stays as it was.
"""

from __future__ import annotations

import base64
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import Column, DataFrame, functions as F

from netsieve.llm.common import short_batches

DEFAULT_RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The pattern that the public vocabulary was made with. A fixed value.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pre-tokens before an edit that may end elsewhere because of it: the one it touches, and one that looks ahead at it.
CONTEXT = 2
CACHE = 1 << 18


class SegmentTree:
    """Sums over leaves, in one array: node i has the children 2i and 2i + 1."""

    def __init__(self, values: np.ndarray):
        self.width = 1 << max(0, (len(values) - 1).bit_length())
        self.sums = np.zeros(2 * self.width, np.int64)
        self.sums[self.width : self.width + len(values)] = values
        size = self.width
        while size > 1:
            self.sums[size // 2 : size] = self.sums[size : 2 * size].reshape(-1, 2).sum(axis=1)
            size //= 2

    def set(self, leaf: int, value: int) -> None:
        node = leaf + self.width
        change = value - self.sums[node]
        while node and change:
            self.sums[node] += change
            node //= 2

    def total(self) -> int:
        return int(self.sums[1])

    def find(self, at: int) -> tuple[int, int]:
        """(leaf, sum before it) of the leaf whose values hold the place `at`; the last leaf beyond the end."""
        node, before = 1, 0
        while node < self.width:
            node *= 2
            if before + self.sums[node] <= at:
                before += int(self.sums[node])
                node += 1
        return node - self.width, before


class Counter:
    """Tokens of pre-tokens, remembered up to a bound."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN):
        self.pattern = regex.compile(pattern)
        self.encoding = tiktoken.Encoding("counts", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.known: dict[str, int] = {}

    def of(self, pieces: list[str]) -> list[int]:
        counts = list(map(self.known.get, pieces))
        for i, n in enumerate(counts):
            if n is None:
                counts[i] = n = len(self.encoding.encode_ordinary(pieces[i]))
                if len(self.known) >= CACHE:
                    self.known.clear()
                self.known[pieces[i]] = n
        return counts


class CountedText:
    """A text with its pre-tokens and their trees. A leaf is one pre-token at first, and what has replaced it after edits."""

    def __init__(self, text: str, counter: Counter):
        self.counter = counter
        self.leaves = counter.pattern.findall(text) or [""]
        self.chars = SegmentTree(np.fromiter(map(len, self.leaves), np.int64, len(self.leaves)))
        self.tokens = SegmentTree(np.array(counter.of(self.leaves) if text else [0], np.int64))
        self.encoded = 0

    def edit(self, start: int, stop: int, put: str) -> None:
        """Replaces the characters from `start` to `stop` of the present text."""
        first, before = self.chars.find(start)
        if first >= len(self.leaves):
            first = len(self.leaves) - 1
            before = self.chars.total() - len(self.leaves[first])
        back = 0
        while first and back < CONTEXT:
            first -= 1
            before -= len(self.leaves[first])
            back += bool(self.leaves[first])
        last, end = first + 1, before + len(self.leaves[first])
        while last < len(self.leaves) and end < stop:
            end += len(self.leaves[last])
            last += 1
        region = "".join(self.leaves[first:last])
        region = region[: start - before] + put + region[stop - before :]
        while True:
            # Look beyond the region, since the last match may go on there.
            ahead, more = last, ""
            while ahead < len(self.leaves) and len(more) < 64:
                more += self.leaves[ahead]
                ahead += 1
            pieces, at, whole = [], 0, ahead == len(self.leaves)
            text = region + more
            for match in self.counter.pattern.finditer(text):
                if at == len(region):
                    break
                if match.end() == len(text) and not whole:
                    at = -1  # it may go on further
                    break
                pieces.append(match.group())
                at = match.end()
            if at == len(region) or (whole and at == len(text)):
                if at != len(region):
                    last = ahead
                break
            # No common boundary yet: take one more leaf, or more if a match reaches the end of what was looked at.
            step = ahead if at == -1 else last + 1
            region += "".join(self.leaves[last:step])
            last = step
        self.encoded += len(pieces)
        counts, room = self.counter.of(pieces), last - first
        for i in range(room):  # spread over the leaves of the region, so that none grows with the number of edits
            low, high = (i * len(pieces) // room, (i + 1) * len(pieces) // room) if len(pieces) > room else (i, i + 1)
            self.leaves[first + i] = "".join(pieces[low:high])
            self.chars.set(first + i, len(self.leaves[first + i]))
            self.tokens.set(first + i, sum(counts[low:high]))

    def text(self) -> str:
        return "".join(self.leaves)


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


EDITS = "array<struct<start int, stop int, put string>>"


def with_edited_counts(
    docs: DataFrame, edits: Column, ranks: dict[bytes, int], into: str = "counts", pattern: str = PATTERN
) -> DataFrame:
    """`docs` with a struct `into`: n_tokens of the text, n_edits, n_tokens_edited, n_pretokens, n_encoded, n_chars_edited.

    `edits` is of type EDITS: replacements of characters of the text as it is given, in any order, not overlapping; those
    out of bounds, or overlapping an earlier one, are left out. `n_encoded` is the number of pre-tokens encoded for them.
    A null text counts as empty and null edits as none. The vocabulary, of some 50,000 entries, is broadcast.
    """
    short_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(ranks)
    made: list[Counter] = []
    names = ["n_tokens", "n_edits", "n_tokens_edited", "n_pretokens", "n_encoded", "n_chars_edited"]

    @F.arrow_udf(", ".join(f"{n} long" for n in names))
    def count(texts: pa.Array, edits: pa.Array) -> pa.Array:
        if not made:  # once a task
            made.append(Counter(shared.value, pattern))
        counter = made[0]
        rows = np.zeros((len(texts), len(names)), np.int64)
        for i, (text, own) in enumerate(zip(texts, edits)):
            rows[i] = _count(text.as_py() or "", own.as_py() or [], counter)
        return pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(c)) for c in rows.T], names)

    return docs.withColumn(into, count("text", edits))


def _count(text: str, edits: list[dict], counter: Counter) -> tuple[int, ...]:
    counted = CountedText(text, counter)
    before, pieces = counted.tokens.total(), sum(map(bool, counted.leaves))
    shift, done, free = 0, 0, 0
    for e in sorted(edits, key=lambda e: (e["start"], e["stop"])):
        if not free <= e["start"] <= e["stop"] <= len(text):
            continue
        put = e["put"] or ""
        counted.edit(e["start"] + shift, e["stop"] + shift, put)
        shift += len(put) - (e["stop"] - e["start"])
        done, free = done + 1, e["stop"]
    return before, done, counted.tokens.total(), pieces, counted.encoded, counted.chars.total()


def masking_edits(rules: list[tuple[str, str]]) -> Callable[[Column], Column]:
    """A function of a text to EDITS that replace what the patterns of `rules` match, the first rule going before."""
    compiled = [(regex.compile(p), put) for p, put in rules]

    @F.arrow_udf(EDITS)
    def find(texts: pa.Array) -> pa.Array:
        out = []
        for text in texts:
            own: list[dict] = []
            whole = text.as_py() or ""
            taken = bytearray(len(whole))
            for pattern, put in compiled:
                for m in pattern.finditer(whole):
                    if not any(taken[m.start() : m.end()]):
                        own.append({"start": m.start(), "stop": m.end(), "put": put})
                        taken[m.start() : m.end()] = b"\x01" * (m.end() - m.start())
            out.append(own)
        kind = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("put", pa.string())]))
        return pa.array(out, kind)

    return find
