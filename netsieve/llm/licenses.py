"""License scans: MinHash bands over overlapping windows retrieve templates, exact containment of shingles confirms them.

A text is a sequence of shingles of five words. For templates of at most c shingles, c a power of two, it is read through
windows of 2c shingles that start every c shingles, so every run of c shingles lies in some window. Each band is one
MinHash value: a window and a template collide in a band with a probability equal to their Jaccard similarity. A window
that holds the wanted share s of a template of m > c / 2 shingles has a similarity of at least s * m / (2c + (1 - s) * m),
0.19 for s = 0.8, so that 48 bands miss it with a probability below 5e-5; a whole template has 0.25 and is missed below
1.1e-6. What collides is compared by the words themselves.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from netsieve.llm.common import short_batches
from netsieve.llm.decontaminate import words_of

#: The words of public license notices.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
    "MIT": "Released under the MIT License.",
    "MIT-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}
WIDTH = 5
BANDS = 48
MOST_SHINGLES = 64
SHARD_WORDS = 1 << 17
MULTIPLIERS = np.random.default_rng(11).integers(0, 1 << 63, BANDS, dtype=np.uint64) << np.uint64(1) | np.uint64(1)
STEP = np.uint64(0x9E3779B97F4A7C15)
LAST = np.uint64(0xFFFFFFFFFFFFFFFF)


def shingle_hashes(words: list[bytes]) -> np.ndarray:
    h = np.fromiter(map(zlib.crc32, words), np.uint64, len(words))
    count = max(0, len(words) - WIDTH + 1)
    mixed = np.zeros(count, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(WIDTH):
            mixed = (mixed ^ h[i : i + count]) * STEP
            mixed ^= mixed >> np.uint64(29)
    return mixed


@dataclass(frozen=True)
class Library:
    """Templates: their names, shingles as words, size classes, and the MinHash values of each."""

    names: list[str]
    shingles: list[frozenset[tuple[bytes, ...]]]
    classes: dict[int, list[int]]
    values: np.ndarray  # templates x BANDS

    @classmethod
    def of(cls, templates: dict[str, str]) -> Library:
        names, shingles, classes, values = [], [], {}, []
        for name in sorted(templates):
            words = words_of(templates[name].encode())
            own = frozenset(tuple(words[i : i + WIDTH]) for i in range(len(words) - WIDTH + 1))
            if not 0 < len(own) <= MOST_SHINGLES:
                raise ValueError(f"{name}: a template has 1 to {MOST_SHINGLES} shingles of {WIDTH} words")
            size = 1 << (len(own) - 1).bit_length()
            classes.setdefault(size, []).append(len(names))
            with np.errstate(over="ignore"):
                values.append((shingle_hashes(words)[None, :] * MULTIPLIERS[:, None]).min(axis=1))
            names.append(name)
            shingles.append(own)
        return cls(names, shingles, classes, np.array(values))


def candidates(hashes: np.ndarray, there: np.ndarray, library: Library) -> list[tuple[int, int, int]]:
    """(template, first shingle, end) of windows that collide with a template in some band.

    The shingles are of whole documents, each filled up to a multiple of MOST_SHINGLES; `there` tells real ones.
    """
    found: set[tuple[int, int, int]] = set()
    for band in range(BANDS):
        with np.errstate(over="ignore"):
            least = np.where(there, hashes * MULTIPLIERS[band], LAST)
        size = 1
        while True:
            if size in library.classes:
                # Windows of two blocks; the last block is a window of its own.
                windows = np.minimum(least, np.append(least[1:], LAST))
                for t in library.classes[size]:
                    for w in np.flatnonzero(windows == library.values[t, band]).tolist():
                        found.add((t, w * size, (w + 2) * size))
            if size >= max(library.classes):
                break
            least = least.reshape(-1, 2).min(axis=1)
            size *= 2
    return sorted(found)


def scan(texts: list[bytes], library: Library, least_share: float) -> list[dict]:
    """For each text the templates found: the name and the largest share of its shingles that one window holds."""
    words = [words_of(t) for t in texts]
    parts, bounds, at = [], [], 0
    for own in words:
        n = max(0, len(own) - WIDTH + 1)
        room = -(-n // MOST_SHINGLES) * MOST_SHINGLES
        bounds.append((at, n))
        parts.append((shingle_hashes(own), room - n))
        at += room
    hashes = np.concatenate([np.zeros(0, np.uint64), *[np.append(h, np.zeros(pad, np.uint64)) for h, pad in parts]])
    there = np.concatenate([np.zeros(0, bool), *[np.arange(len(h) + pad) < len(h) for h, pad in parts]])
    out: list[dict[str, float]] = [{} for _ in texts]
    starts = np.array([b[0] for b in bounds])
    if len(hashes) and library.names:
        for t, first, end in candidates(hashes, there, library):
            # A window that goes over the end of a document belongs to the document of its start; equal starts: the last.
            doc = int(np.searchsorted(starts, first, "right")) - 1
            begin, n = bounds[doc]
            low, high = first - begin, min(end - begin, n)
            held = {tuple(words[doc][i : i + WIDTH]) for i in range(low, high)}
            share = len(held & library.shingles[t]) / len(library.shingles[t])
            if share >= least_share:
                name = library.names[t]
                out[doc][name] = max(share, out[doc].get(name, 0.0))
    return [{"found": [{"license": k, "share": v} for k, v in sorted(o.items())]} for o in out]


FOUND = "array<struct<license string, share double>>"


def with_licenses(docs: DataFrame, templates: dict[str, str] = TEMPLATES, least_share: float = 0.8, into: str = "licenses") -> DataFrame:
    """`docs` with a column `into` of type FOUND: the templates whose shingles a window of the text holds to `least_share` or
    more, by name. A null, empty or short text has none. Templates have 1 to MOST_SHINGLES shingles."""
    short_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(Library.of(templates))

    @F.arrow_udf(FOUND)
    def look(texts: pa.Array) -> pa.Array:
        found: list[list[dict]] = []
        for shard in _shards(v.as_py() or b"" for v in texts.cast(pa.large_binary())):
            found += [r["found"] for r in scan(shard, shared.value, least_share)]
        return pa.array(found, pa.list_(pa.struct([("license", pa.string()), ("share", pa.float64())])))

    return docs.withColumn(into, look("text"))


def _shards(texts: Iterator[bytes]) -> Iterator[list[bytes]]:
    held: list[bytes] = []
    size = 0
    for text in texts:
        held.append(text)
        size += len(text)
        if size >= 6 * SHARD_WORDS:
            yield held
            held, size = [], 0
    yield held


def license_report(docs: DataFrame, templates: dict[str, str] = TEMPLATES, least_share: float = 0.8) -> DataFrame:
    """(doc_id, n_licenses, licenses, share) of every row: names joined by commas, and the largest share (0 if none). Rows
    that repeat each give a row; other columns are left out."""
    found = with_licenses(docs.select("doc_id", "text"), templates, least_share)
    return found.select(
        "doc_id",
        F.size("licenses").cast("long").alias("n_licenses"),
        F.array_join(F.transform("licenses", lambda x: x["license"]), ",").alias("licenses"),
        F.coalesce(F.array_max(F.transform("licenses", lambda x: x["share"])), F.lit(0.0)).alias("share"),
    )
