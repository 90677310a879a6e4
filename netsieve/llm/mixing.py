"""Mixing sources to target weights by a low-discrepancy schedule of equal-token blocks.

1. Targets: the sources share the mix by weight; a source takes at most `repeats` times its words, and what it cannot
   take is shared by the others by weight.
2. Each source is shuffled (by a hash of the document id) and laid out as one stream of words, read again from its
   start as often as needed, and cut into blocks of equally many words.
3. Slots of the mix are dealt to sources by the multiples of the golden ratio modulo 1, mapped through the cumulative
   shares; so any run of slots holds each source nearly in proportion.
4. The k-th slot of a source takes its k-th block: slots are ranked per source and joined with the blocks.

Ranks and stream positions are prefix sums over (source, bucket) totals plus a window inside a bucket, so that a
source with a third of all rows is no single task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from netsieve.llm.common import prefix_sums
from netsieve.session import stage_table

#: The golden ratio's fraction in 31 bits, odd: its multiples modulo 2**31 visit every residue once.
GOLDEN, TURN = 1_327_217_885, 1 << 31
CELLS = 4096
SLOT_CHUNK = 16_384
#: Rows that follow each other in a task, up to 2 ** CHUNK_BITS, make a chunk.
CHUNK_BITS = 12


def word_count(text: Column) -> Column:
    """Runs of characters other than space and the controls 09 to 0D; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_key(source: Column) -> Column:
    """A text that is never null, so that null is a source of its own."""
    return F.coalesce(F.concat(F.lit("s"), source), F.lit(""))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), repeats: int = 3) -> DataFrame:
    """(src, source, source_size, weight, target, quota) from rows (src, source, size).

    Sources in order of code points, null last, weigh `weights` in turn. A source is at its limit if its share of what
    the more limited ones leave is above it; sources are ordered by limit over weight, so those are the first few.
    `quota` is the target in whole words. The windows hold one row per source.
    """
    totals = sizes.groupBy("src", "source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weighed = totals.withColumn("place", place).withColumn(
        "weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int"))
    )
    limited = weighed.withColumn("limit", F.col("source_size") * repeats)
    by_limit = Window.orderBy(F.col("limit").cast("double") / F.col("weight"), "place")
    before = by_limit.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_limit.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    left = (
        limited.withColumn("total", F.sum("source_size").over(everything))
        .withColumn("taken_before", F.coalesce(F.sum("limit").over(before), F.lit(0)))
        .withColumn("weight_onward", F.sum("weight").over(onward))
    )
    share = lambda rest, w: rest.cast("double") * F.col("weight").cast("double") / w.cast("double")
    marked = left.withColumn("full", F.col("limit").cast("double") <= share(F.col("total") - F.col("taken_before"), F.col("weight_onward")))
    open_weight = F.coalesce(F.sum(F.when(~F.col("full"), F.col("weight"))).over(everything), F.lit(1))
    full_limit = F.coalesce(F.sum(F.when(F.col("full"), F.col("limit"))).over(everything), F.lit(0))
    target = F.when(F.col("full"), F.col("limit").cast("double")).otherwise(share(F.col("total") - full_limit, open_weight))
    return marked.withColumn("target", target).select(
        "src", "source", "source_size", "weight", "target", F.floor("target").alias("quota")
    )


def lay_out(sizes: DataFrame) -> DataFrame:
    """Adds `start`: the words of the source before this row, in the order of `shuffle_key`, then of size, of rows
    (src, shuffle_key, size, row) that `row` numbers.

    Rows that agree in key and size, such as those without a doc_id, are counted first and stand for each other, so no
    window holds more than their different sizes; a row's place among them is that of its chunk and its place there.
    """
    kind = ["src", "shuffle_key", "size"]
    classes = sizes.groupBy(*kind).agg(F.count("*").alias("n")).withColumn("bucket", F.substring("shuffle_key", 1, 3))
    words = F.col("n") * F.col("size")
    buckets = classes.groupBy("src", "bucket").agg(F.sum(words).alias("bucket_size"))
    offsets = prefix_sums(buckets, ["src"], "bucket", "bucket_size", "offset").drop("bucket_size")
    inside = Window.partitionBy("src", "bucket").orderBy("shuffle_key", "size").rowsBetween(Window.unboundedPreceding, -1)
    begin = F.col("offset") + F.coalesce(F.sum(words).over(inside), F.lit(0))
    placed = classes.join(offsets, ["src", "bucket"]).withColumn("begin", begin).select(*kind, "n", "begin")
    joined = stage_table(sizes.join(placed, kind), "mix-classes")
    alone = joined.where("n = 1").withColumn("start", F.col("begin"))
    copies = joined.where("n > 1").withColumn("chunk", F.shiftright("row", CHUNK_BITS))
    chunks = copies.groupBy(*kind, "chunk").agg(F.count("*").alias("rows"))
    before = prefix_sums(chunks, kind, "chunk", "rows", "earlier").drop("rows")
    place = F.col("earlier") + F.row_number().over(Window.partitionBy(*kind, "chunk").orderBy("row")) - 1
    numbered = copies.join(before, [*kind, "chunk"]).withColumn("start", F.col("begin") + place * F.col("size"))
    return alone.unionByName(numbered.drop("chunk", "earlier")).drop("n", "begin")


def slot_schedule(targets: DataFrame, block_words: int) -> DataFrame:
    """(slot, src, rank): which block of which source each slot takes; `slot` orders the mix."""
    spark = targets.sparkSession
    blocks = targets.where("quota > 0").select(
        "src", F.ceil(F.col("quota") / F.lit(block_words)).cast("long").alias("blocks")
    )
    n = blocks.agg(F.coalesce(F.sum("blocks"), F.lit(0))).first()[0]
    by_source = Window.orderBy("src").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    upto = F.sum("blocks").over(by_source)
    # A source owns the points [low, high) of the circle of TURN points.
    point = lambda x: F.floor(x.cast("double") / F.lit(max(n, 1)) * TURN)
    arcs = blocks.select("src", "blocks", point(upto - F.col("blocks")).alias("low"), point(upto).alias("high")).where("low < high")
    width = TURN // CELLS
    cells = arcs.withColumn("cell", F.explode(F.sequence(F.floor(F.col("low") / width), F.floor((F.col("high") - 1) / width))))
    points = spark.range(n).select(
        F.col("id").alias("slot"), ((F.col("id") % TURN) * GOLDEN % TURN).alias("at")
    ).withColumn("cell", F.floor(F.col("at") / width))
    dealt = points.join(cells, "cell").where("at >= low and at < high").select("slot", "src")
    chunked = dealt.withColumn("chunk", F.floor(F.col("slot") / SLOT_CHUNK))
    counts = chunked.groupBy("src", "chunk").agg(F.count("*").alias("n"))
    offsets = prefix_sums(counts, ["src"], "chunk", "n", "offset").drop("n")
    inside = Window.partitionBy("src", "chunk").orderBy("slot")
    ranked = chunked.join(offsets, ["src", "chunk"]).select(
        "slot", "src", (F.col("offset") + F.row_number().over(inside) - 1).alias("rank")
    )
    # The points miss an exact share by a few slots: surplus slots stay empty, missing ones follow at the end.
    given = counts.groupBy("src").agg(F.sum("n").alias("given"))
    missing = (
        blocks.join(given, "src", "left")
        .withColumn("given", F.coalesce("given", F.lit(0)))
        .where("given < blocks")
        .select("src", F.explode(F.sequence("given", F.col("blocks") - 1)).alias("rank"))
        .select((F.lit(n) + F.col("rank")).alias("slot"), "src", "rank")
    )
    return ranked.join(blocks, "src").where("rank < blocks").select("slot", "src", "rank").unionByName(missing)


def mix_sources(
    docs: DataFrame,
    weights: tuple[int, ...] = (1, 2, 3),
    repeats: int = 3,
    block_words: int = 2048,
    carry: Sequence[str] = (),
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Mixes documents (doc_id, text, source). Returns (documents, pieces, targets).

    * documents: doc_id, source, size, source_size, target, taken, and the columns of `carry`, which must have other names than
      these; one row per input row. `taken` counts the words the mix takes, repeats counted.
    * pieces: slot, source, doc_id, first, words: what each slot of the mix holds, `first` counted from 0 in the document.
    * targets: what `source_targets` gives.

    A null source is a source; a null or empty text has no words and is taken 0 times; rows that repeat are documents
    of their own, told apart by their place in the stream; a null doc_id is shuffled like any other. Without words all targets are 0. Other columns are left out.
    """
    sized = stage_table(
        docs.select(
            "doc_id",
            "source",
            source_key(F.col("source")).alias("src"),
            word_count(F.col("text")).alias("size"),
            F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")).alias("shuffle_key"),
            F.monotonically_increasing_id().alias("row"),
            *[F.col(c).alias(f"carried_{c}") for c in carry],
        ),
        "mix-sizes",
    )
    targets = stage_table(source_targets(sized, weights, repeats), "mix-targets")
    streams = stage_table(
        lay_out(sized).join(targets.select("src", "source_size", "target", "quota"), "src").drop("shuffle_key"), "mix-streams"
    )
    slots = slot_schedule(targets, block_words)
    turns = F.explode(F.sequence(F.lit(0), F.lit(repeats - 1)))
    read = (
        streams.where("size > 0 and start < quota")
        .withColumn("turn", turns)
        .withColumn("from", F.col("start") + F.col("turn") * F.col("source_size"))
        .withColumn("to", F.least(F.col("from") + F.col("size"), F.col("quota")))
        .where("from < to")
        .withColumn("rank", F.explode(F.sequence(F.floor(F.col("from") / block_words), F.floor((F.col("to") - 1) / block_words))))
        .withColumn("begin", F.greatest("from", F.col("rank") * block_words))
        .withColumn("words", F.least("to", (F.col("rank") + 1) * block_words) - F.col("begin"))
    )
    pieces = read.join(slots, ["src", "rank"]).select(
        "slot", "source", "src", "start", "doc_id", (F.col("begin") - F.col("from")).alias("first"), "words"
    )
    # Rows with words are told apart by their place in the stream.
    taken = pieces.groupBy("src", "start").agg(F.sum("words").alias("taken"))
    some = streams.where("size > 0").join(taken, ["src", "start"], "left")
    none = streams.where("size = 0").withColumn("taken", F.lit(0).cast("long"))
    documents = some.unionByName(none, allowMissingColumns=True).select(
        "doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"),
        *[F.col(f"carried_{c}").alias(c) for c in carry],
    )
    return documents, pieces.drop("src", "start"), targets
