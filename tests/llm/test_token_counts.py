import random

import pytest
from pyspark.sql import functions as F

from netsieve.llm.token_counts import DEFAULT_RANKS, EDITS, Counter, CountedText, SegmentTree, masking_edits, read_ranks, with_edited_counts


@pytest.fixture(scope="module")
def ranks():
    return read_ranks(DEFAULT_RANKS)


def test_segment_tree():
    import numpy as np

    rng = np.random.default_rng(0)
    for n in (1, 2, 5, 8, 13):
        values = rng.integers(0, 4, n)
        tree = SegmentTree(values)
        for _ in range(30):
            i, v = int(rng.integers(n)), int(rng.integers(0, 5))
            values[i] = v
            tree.set(i, v)
            assert tree.total() == values.sum()
            for at in range(int(values.sum())):
                leaf, before = tree.find(at)
                assert before == values[:leaf].sum() and before <= at < before + values[leaf]


def test_edits_equal_a_full_count(ranks):
    counter, rng = Counter(ranks), random.Random(5)
    parts = ["a", "b ", " ", "  ", "\n", "'", "v", "e", "'ll", "12", "é", "!?", "wörd", "\t \t", "x" * 90, " " * 80, "漢"]
    for _ in range(400):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 40)))
        counted = CountedText(text, counter)
        for _ in range(rng.randint(1, 5)):
            a = rng.randint(0, len(text))
            b = rng.randint(a, min(len(text), a + rng.choice([0, 1, 3, 30])))
            put = "".join(rng.choice(parts) for _ in range(rng.randint(0, 3)))
            text = text[:a] + put + text[b:]
            counted.edit(a, b, put)
            assert counted.text() == text
            assert counted.tokens.total() == len(counter.encoding.encode_ordinary(text))
            assert counted.chars.total() == len(text)


def test_only_the_region_is_encoded(ranks):
    counted = CountedText("word " * 10_000, Counter(ranks))
    counted.edit(25_000, 25_004, "other")
    assert counted.encoded < 10


def test_table(spark, ranks):
    rows = [(1, "call 5551234 now", "x"), (2, None, "x"), (3, "", "x"), (None, "a@b.org 1234", "x"), (1, "call 5551234 now", "x"), (4, "99999 " * 20_000, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, counts string")
    find = masking_edits([(r"\S+@\S+", "<mail>"), (r"\d{4,}", "<number>")])
    got = with_edited_counts(docs.drop("counts"), find("text"), ranks).select("doc_id", "text", "counts.*").collect()
    counter = Counter(ranks)
    import re

    for r in got:
        text = r.text or ""
        edited = re.sub(r"\d{4,}", "<number>", re.sub(r"\S+@\S+", "<mail>", text))
        assert r.n_tokens == len(counter.encoding.encode_ordinary(text))
        assert r.n_tokens_edited == len(counter.encoding.encode_ordinary(edited))
        assert r.n_chars_edited == len(edited)
    assert with_edited_counts(docs.limit(0), find("text"), ranks, "n").collect() == []


def test_edits_out_of_bounds_are_left_out(spark, ranks):
    docs = spark.createDataFrame([(1, "one two three")], "doc_id long, text string")
    edits = F.array(*[F.struct(F.lit(a).alias("start"), F.lit(b).alias("stop"), F.lit(p).alias("put")) for a, b, p in [(0, 3, "x"), (2, 5, "y"), (-1, 1, "z"), (5, 99, "z"), (4, 4, None)]]).cast(EDITS)
    r = with_edited_counts(docs, edits, ranks).first().counts
    assert (r.n_edits, r.n_chars_edited) == (2, len("x two three"))
    assert with_edited_counts(docs, F.lit(None).cast(EDITS), ranks).first().counts.n_edits == 0
