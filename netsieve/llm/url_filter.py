"""URL filtering: a blocked Bloom filter of listed canonical URLs, then an exact join of the possible hits.

A list entry is (host, path, verdict). It fits its host and all subdomains, if the path of a url starts with its
path. For each url the candidate entries are the strings `host suffix + path prefix` of the shapes that occur in the
list, a shape being the pair (labels of the host, length of the path). Candidates that the filter lets pass go to a
hash join with the list, which removes the filter's false positives; of several entries the longest wins.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from netsieve.llm.common import ascii_lower

#: Odd multipliers, one for each 32-bit word of a block, unrelated to each other.
SALTS = tuple(int(x) | 1 for x in np.random.default_rng(5).integers(1 << 31, 1 << 32, 8))
BLOCK_BYTES = 32


@dataclass(frozen=True)
class BlockedBloom:
    """Blocks of eight 32-bit words; a key sets one bit in each word of one block."""

    words: np.ndarray  # uint32, blocks x 8

    def may_hold(self, hashes: np.ndarray) -> np.ndarray:
        h = hashes.astype(np.int64).view(np.uint64)
        block = ((h >> np.uint64(32)) % np.uint64(len(self.words))).astype(np.int64)
        low = h & np.uint64(0xFFFFFFFF)
        found = np.ones(len(h), bool)
        for i, salt in enumerate(SALTS):
            bit = ((low * np.uint64(salt)) & np.uint64(0xFFFFFFFF)) >> np.uint64(27)
            found &= (self.words[block, i] >> bit.astype(np.uint32)) & np.uint32(1) == 1
        return found


def host_of(url: Column) -> Column:
    """What stands after the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; empty without `://`."""
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to `?`, `#` or the end; empty without `://`."""
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical_list(rules: DataFrame) -> DataFrame:
    """(rule, verdict, labels, path_length, rank) of a list (host, path, verdict).

    Entries with a null in any of the three are left out. Of equal entries with different verdicts block wins.
    """
    host = ascii_lower(F.col("host"))
    return (
        rules.where(F.col("host").isNotNull() & F.col("path").isNotNull() & F.col("verdict").isNotNull())
        .select(
            F.concat(host, F.col("path")).alias("rule"),
            "verdict",
            F.size(F.split(host, r"\.", -1)).alias("labels"),
            F.length("path").alias("path_length"),
        )
        .groupBy("rule", "labels", "path_length")
        .agg(F.max("verdict").alias("verdict"))  # "block" sorts after "allow"
        .withColumn("rank", F.length("rule") * 65_536 + F.col("labels"))
    )


def _times(low: Column, salt: int) -> Column:
    """The product of two 32-bit numbers modulo 2**32, from 16-bit halves so that no long overflows."""
    upper = (F.shiftright(low, 16) * (salt & 0xFFFF)).bitwiseAND(F.lit(0xFFFF))
    return (low.bitwiseAND(F.lit(0xFFFF)) * salt + F.shiftleft(upper, 16)).bitwiseAND(F.lit(0xFFFFFFFF))


def build_filter(listed: DataFrame, bits_per_key: int = 16, max_bytes: int = 32 << 20) -> BlockedBloom:
    """The filter of all entries. Its size follows the list up to `max_bytes`; beyond that only the share of false
    positives rises, which the exact join removes. Bits are gathered by `bit_or` before the shuffle."""
    n = listed.count()
    blocks = max(1, min(max_bytes // BLOCK_BYTES, -(-n * bits_per_key // (BLOCK_BYTES * 8))))
    h = F.xxhash64("rule")
    high, low = F.shiftrightunsigned(h, 32), h.bitwiseAND(F.lit(0xFFFFFFFF))
    bits = [
        F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright(_times(low, s), 27).cast("int")).alias(f"w{i}")
        for i, s in enumerate(SALTS)
    ]
    rows = (
        listed.select((high % blocks).alias("block"), *bits)
        .groupBy("block")
        .agg(*[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(8)])
        .toPandas()
    )
    words = np.zeros((blocks, 8), np.uint32)
    if len(rows):
        words[rows["block"].to_numpy()] = rows[[f"w{i}" for i in range(8)]].to_numpy().astype(np.uint32)
    return BlockedBloom(words)


def judge_urls(
    pages: DataFrame,
    rules: DataFrame,
    page_id: str = "page_id",
    url: str = "url",
    otherwise: str = "allow",
    broadcast_rows: int = 200_000,
) -> DataFrame:
    """(page_id, host, path, rule, verdict) of every row of `pages`; other columns are left out.

    A null url, or one without `://`, has an empty host and path, which no entry fits: rule null, verdict `otherwise`.
    Repeated rows each give a row. An empty list gives `otherwise` throughout. The list is broadcast for the join
    only if it has at most `broadcast_rows` entries; a longer one is joined by shuffle, hot keys split by AQE.
    """
    spark = pages.sparkSession
    listed = canonical_list(rules)
    bloom = build_filter(listed)
    shapes = sorted({(r.labels, r.path_length) for r in listed.select("labels", "path_length").distinct().collect()})
    rows = pages.select(
        F.col(page_id).alias("page_id"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path")
    )
    if not shapes:
        return rows.select("*", F.lit(None).cast("string").alias("rule"), F.lit(otherwise).alias("verdict"))
    filter_words = spark.sparkContext.broadcast(bloom.words)

    @F.pandas_udf("boolean")
    def may_be_listed(hashes: pd.Series) -> pd.Series:
        return pd.Series(BlockedBloom(filter_words.value).may_hold(hashes.to_numpy()))

    def candidate(labels: int, length: int) -> Column:
        fits = (F.size(F.split("host", r"\.", -1)) >= labels) & (F.length("path") >= length)
        key = F.concat(F.substring_index("host", ".", -labels), F.substring("path", 1, length))
        return F.when(fits, key)

    candidates = [candidate(*s).alias(f"c{i}") for i, s in enumerate(shapes)]
    names = [f"c{i}" for i in range(len(shapes))]
    keyed = rows.select("*", F.monotonically_increasing_id().alias("row"), *candidates)
    passed = [F.when(F.col(c).isNotNull() & may_be_listed(F.coalesce(F.xxhash64(c), F.lit(0))), F.col(c)) for c in names]
    probed = keyed.select("page_id", "host", "path", "row", F.array_compact(F.array(*passed)).alias("hits"))
    small = listed.limit(broadcast_rows + 1).count() <= broadcast_rows
    known = listed.select("rule", "verdict", "rank")
    exact = (
        probed.where(F.size("hits") > 0)
        .withColumn("rule", F.explode("hits"))
        .drop("hits")
        .join(F.broadcast(known) if small else known, "rule", "left")
        .groupBy("row", "page_id", "host", "path")
        .agg(
            F.max_by(F.when(F.col("rank").isNotNull(), F.col("rule")), "rank").alias("rule"),
            F.max_by("verdict", "rank").alias("verdict"),
        )
        .select("page_id", "host", "path", "rule", F.coalesce("verdict", F.lit(otherwise)).alias("verdict"))
    )
    clear = probed.where(F.size("hits") == 0).select(
        "page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(otherwise).alias("verdict")
    )
    return exact.unionByName(clear)
