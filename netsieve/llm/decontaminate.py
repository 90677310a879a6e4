"""Benchmark decontamination: the phrases of test items are searched in FM-indexes of shards of the training texts.

A shard is about a megabyte of whole documents inside one task, so nothing is shuffled. Its words become numbers by the
vocabulary of the items; a word that no item has cannot be part of a phrase, and it cuts the sequence. Runs shorter
than the shortest phrase are left out of the index. All phrases are searched backwards at once through the ranks of a
wavelet tree; occurrences are located by sampled suffix positions and their spans merged.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, functions as F

from netsieve.llm.common import short_batches
from netsieve.llm.fm_index import FMIndex
from netsieve.session import stage_table

#: Word characters are a-z, 0-9 and all beyond ASCII, after A-Z have been lower-cased; the others become spaces.
TO_WORDS = bytes(
    b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or 48 <= b <= 57 or b >= 128 else 32 for b in range(256)
)
WORD = re.compile(rb"[^ ]+")
SHARD_BYTES = 1 << 20
FOUND = "struct<n_words long, n_hit long, items array<string>, spans array<struct<start int, stop int>>>"


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(TO_WORDS).split()


@dataclass(frozen=True)
class Phrases:
    """The windows of a set of items: by length a matrix of word numbers, and the items that have each window."""

    vocabulary: dict[bytes, int]
    windows: list[tuple[np.ndarray, list[list[str]]]]

    @property
    def shortest(self) -> int:
        return min((w.shape[1] for w, _ in self.windows), default=0)

    @classmethod
    def of(cls, items: list[tuple[str, bytes | None]], width: int) -> Phrases:
        vocabulary: dict[bytes, int] = {}
        owners: dict[tuple[int, ...], set[str]] = {}
        for name, text in items:
            numbers = [vocabulary.setdefault(w, len(vocabulary) + 1) for w in words_of(text)]
            for i in range(max(1, len(numbers) - width + 1) if numbers else 0):
                owners.setdefault(tuple(numbers[i : i + width]), set()).add(name)
        windows = []
        for length in sorted({len(w) for w in owners}):
            own = [w for w in owners if len(w) == length]
            windows.append((np.array(own, np.int64), [sorted(owners[w]) for w in own]))
        return cls(vocabulary, windows)


def scan_shard(texts: list[bytes], phrases: Phrases) -> list[dict]:
    """What FOUND describes, for each text; spans are of bytes, from the first to the last word of a run of hit words."""
    get = phrases.vocabulary.get
    numbers, sizes = [], np.zeros(len(texts), np.int64)
    for i, text in enumerate(texts):
        words = words_of(text)
        sizes[i] = len(words)
        numbers.append(np.fromiter(map(get, words, repeat(0)), np.int64, len(words)))
        numbers.append(np.zeros(1, np.int64))  # phrases do not go over documents
    every = np.concatenate([np.zeros(1, np.int64), *numbers])
    starts = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]]) + 1  # of each document in `every`
    hit = np.zeros(len(every) + 1, np.int64)
    items: list[set[str]] = [set() for _ in texts]
    # Runs of known words, each with the zero before it.
    edges = np.diff(np.concatenate([[0], (every != 0).view(np.int8), [0]]))
    run_start, run_stop = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    long = run_stop - run_start >= max(1, phrases.shortest)
    run_start, run_stop = run_start[long], run_stop[long]
    if len(run_start):
        spans = run_stop - run_start + 1
        first = np.cumsum(spans) - spans
        origin = np.repeat(run_start - 1 - first, spans) + np.arange(spans.sum())  # where each symbol of the index stood
        sequence = every[origin]
        sequence[first] = 0
        index = FMIndex(np.append(sequence, 0), len(phrases.vocabulary))
        for windows, owners in phrases.windows:
            low, high = index.search(windows)
            counts = high - low
            which = np.repeat(np.arange(len(counts)), counts)
            rows = np.repeat(low - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
            at = origin[index.locate(rows)]
            np.add.at(hit, at, 1)
            np.add.at(hit, at + windows.shape[1], -1)
            doc = np.searchsorted(starts, at, "right") - 1
            pairs = np.unique(doc * len(counts) + which)
            for d, w in zip((pairs // len(counts)).tolist(), (pairs % len(counts)).tolist()):
                items[d].update(owners[w])
    covered = np.cumsum(hit)[:-1] > 0
    found = []
    for i, text in enumerate(texts):
        mask = covered[starts[i] : starts[i] + sizes[i]]
        spans = []
        if items[i]:
            words = list(WORD.finditer(text.translate(TO_WORDS)))
            edges = np.diff(np.concatenate([[0], mask.view(np.int8), [0]]))
            for a, b in zip(np.flatnonzero(edges == 1).tolist(), np.flatnonzero(edges == -1).tolist()):
                spans.append({"start": words[a].start(), "stop": words[b - 1].end()})
        found.append({"n_words": int(sizes[i]), "n_hit": int(mask.sum()), "items": sorted(items[i]), "spans": spans})
    return found


def _merge(old: dict | None, new: dict, text: bytes) -> dict:
    """Results of two sets of items for one text."""
    if not old or not old["items"]:
        return new
    marks = bytearray(len(text))
    for span in [*old["spans"], *new["spans"]]:
        marks[span["start"] : span["stop"]] = b"\x01" * (span["stop"] - span["start"])
    plain = text.translate(TO_WORDS)
    words = [(m.start(), m.end()) for m in WORD.finditer(plain)]
    spans: list[dict] = []
    last = -2
    for i, (a, b) in enumerate(words):
        if marks[a]:
            if i == last + 1:
                spans[-1]["stop"] = b
            else:
                spans.append({"start": a, "stop": b})
            last = i
    return {
        "n_words": new["n_words"],
        "n_hit": sum(marks[a] for a, _ in words),
        "items": sorted({*old["items"], *new["items"]}),
        "spans": spans,
    }


def _scanner(shared: Broadcast):
    @F.arrow_udf(FOUND)
    def scan(texts: pa.Array, before: pa.Array) -> pa.Array:
        return _scan(texts, before, shared.value)

    return scan


def _scan(texts: pa.Array, before: pa.Array, phrases: Phrases) -> pa.Array:
    whole = texts.cast(pa.large_binary())
    found: list[dict] = []
    shard: list[bytes] = []
    held = 0
    for value in whole:
        shard.append(value.as_py() or b"")
        held += len(shard[-1])
        if held >= SHARD_BYTES:
            found += scan_shard(shard, phrases)
            shard, held = [], 0
    if shard:
        found += scan_shard(shard, phrases)
    if before.null_count < len(before):  # what earlier blocks of items have found
        found = [_merge(b.as_py(), f, t.as_py() or b"") for b, f, t in zip(before, found, whole)]
    kind = pa.struct([
        ("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string())),
        ("spans", pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))),
    ])
    return pa.array(found, kind)


def with_contamination(
    docs: DataFrame, items: DataFrame, width: int = 10, into: str = "found", block_chars: int = 8_000_000
) -> DataFrame:
    """`docs` with a column `into` of type FOUND: words, hit words, the items with occurring windows, spans of bytes.

    A window is `width` consecutive words of an item; an item of fewer words, but not none, is one window. A word of a
    text inside any occurrence of a window is hit. A null or empty text has no words, a null or empty item no window;
    items of one item_id count as one, a null item_id as the empty name; rows of items that repeat count once. Items are searched in blocks of about
    `block_chars` characters, each block in a pass of its own, so that what is broadcast stays within bounds.
    """
    spark = docs.sparkSession
    short_batches(spark)
    given = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("name"), "text").where("text is not null")
    # Rows that repeat would fall into one block.
    given = given.distinct()
    chars = given.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-chars // block_chars))
    for block in range(blocks):
        own = given.where(F.pmod(F.xxhash64("name", "text"), F.lit(blocks)) == block) if blocks > 1 else given
        phrases = Phrases.of([(r["name"], r["text"].encode()) for r in own.collect()], width)
        scan = _scanner(spark.sparkContext.broadcast(phrases))
        if block:
            docs = stage_table(docs, "contamination")
        docs = docs.withColumn(into, scan("text", into if block else F.lit(None).cast(FOUND)))
    return docs


def contamination_report(docs: DataFrame, items: DataFrame, width: int = 10) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items, spans, contaminated) of every row; other columns are left out."""
    found = with_contamination(docs.select("doc_id", "text"), items, width).select("doc_id", "found.*")
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), "items", "spans",
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def names_digest(names: Column) -> Column:
    """SHA-256, in lower-case hex, of names sorted and joined by commas."""
    return F.sha2(F.array_join(F.array_sort(names), ","), 256)
