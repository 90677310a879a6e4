import hashlib
import random

import numpy as np
import pytest

from netsieve.llm.repeats import cut_text, repeat_report, with_repeats
from netsieve.llm.suffixes import prefix_classes, previous_smaller, repeated_starts, suffix_ranks


def plain_report(rows, length):
    """Every string of `length` bytes by itself."""
    texts = [(t or "").encode() for _, t in rows]
    seen = {}
    for i, t in enumerate(texts):
        for a in range(len(t) - length + 1):
            seen.setdefault(t[a : a + length], []).append((i, a))
    marks = [bytearray(len(t)) for t in texts]
    for places in seen.values():
        if len(places) > 1:
            for i, a in places:
                marks[i][a : a + length] = b"\x01" * length
    out = []
    for (doc, _), t, m in zip(rows, texts, marks):
        spans = sum(1 for i in range(len(m)) if m[i] and (i == 0 or not m[i - 1]))
        kept = bytes(b for b, x in zip(t, m) if not x)
        out.append((str(doc), len(t), sum(m), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def corpus(seed, n, letters="abcdeé "):
    rng = random.Random(seed)
    word = lambda k: "".join(rng.choice(letters) for _ in range(k))
    shared = [word(rng.choice([30, 60, 100])) for _ in range(4)]
    made = []
    for _ in range(n):
        roll = rng.random()
        if made and roll < 0.2:
            made.append(rng.choice(made))
        elif made and roll < 0.4:
            t = list(rng.choice(made) or "x")
            t[rng.randrange(len(t))] = "Z"
            made.append("".join(t))
        else:
            made.append("".join(rng.choice([rng.choice(shared), word(rng.randint(0, 50))]) for _ in range(rng.randint(0, 5))))
    return made


def test_suffix_order():
    rng = np.random.default_rng(3)
    for sigma in (1, 2, 5):
        s = rng.integers(1, sigma + 1, 80)
        ranks = suffix_ranks(s)
        assert list(np.argsort(ranks)) == sorted(range(80), key=lambda i: tuple(s[i:]))
        for length in (1, 5, 8, 13):
            classes = prefix_classes(s, length)
            keys = [tuple(s[i : i + length]) for i in range(80)]
            for i in range(80):
                for j in range(80):
                    assert (classes[i] < classes[j]) == (keys[i] < keys[j])


def test_previous_smaller():
    rng = np.random.default_rng(5)
    for values in (rng.permutation(200), np.arange(50), np.arange(50)[::-1].copy()):
        got = previous_smaller(values)
        for i, g in enumerate(got):
            before = [j for j in range(i) if values[j] < values[i]]
            assert g == (before[-1] if before else -1)


def test_repeated_starts():
    rng = np.random.default_rng(8)
    s = np.append(rng.integers(1, 3, 150), 0)
    earlier, later = repeated_starts(s, 6)
    keys = [tuple(s[i : i + 6]) for i in range(len(s))]
    for i, k in enumerate(keys):
        if len(k) == 6:
            assert earlier[i] == (k in keys[:i]) and later[i] == (k in keys[i + 1 :])


@pytest.mark.parametrize("length,gram,crowd", [(40, 12, 4096), (40, 12, 2), (33, 1, 3)])
def test_against_brute_force(spark, length, gram, crowd):
    rows = list(enumerate(corpus(length + crowd, 60)))
    rows += [(100, None), (101, ""), (None, rows[3][1]), (None, "é" * 30), (4, rows[4][1]), (4, "other " * 30), (102, "ab" * 400)]
    docs = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, digest string").repartition(5)
    got = repeat_report(docs, length=length, gram=gram, crowd=crowd).drop("spans").collect()
    assert sorted((str(r[0]), *r[1:]) for r in got) == plain_report(rows, length)


def test_first_copy_stays(spark):
    for crowd in (4096, 2):
        rows = list(enumerate(corpus(21, 60)))
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
        found = with_repeats(docs, 40, "first", gram=12, crowd=crowd).select("row.*", "spans")
        spans = {r.doc_id: r.spans for r in found.collect()}
        # A window goes exactly if it starts somewhere earlier, in the order of documents and places.
        seen = set()
        for doc, text in rows:
            t = text.encode()
            marks = bytearray(len(t))
            for a in range(len(t) - 39):
                if t[a : a + 40] in seen:
                    marks[a : a + 40] = b"\x01" * 40
                seen.add(t[a : a + 40])
            got = bytearray(len(t))
            for s in spans[doc]:
                got[s.start : s.stop] = b"\x01" * (s.stop - s.start)
            assert got == marks


def test_cut_keeps_characters_whole(spark):
    from pyspark.sql import functions as F

    rows = [("aéb", [(2, 3)]), ("aéb", [(1, 3)]), ("aéb", [(0, 2)]), (None, [])]
    df = spark.createDataFrame(rows, "text string, spans array<struct<start int, stop int>>")
    assert [r[0] for r in df.select(cut_text(F.col("text"), F.col("spans"))).collect()] == ["aéb", "ab", "éb", None]


def test_long_text_over_chunks(spark):
    rng = random.Random(4)
    long = "".join(rng.choice("abcdefgh") for _ in range(600_000))
    docs = spark.createDataFrame([(1, long), (2, long[261_900:262_500])], "doc_id long, text string")
    got = {r.doc_id: r.n_removed for r in repeat_report(docs).collect()}
    assert got == {1: 600, 2: 600}


def test_empty_table(spark):
    assert repeat_report(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_texts_of_one_id_are_told_apart(spark):
    from pyspark.sql import functions as F

    # Two texts of null id whose hashes agree in the low 31 bits.
    text = F.concat(F.repeat(F.md5(F.col("id").cast("string")), 2), F.lit(" "))
    low = F.xxhash64("text", F.lit(True)).bitwiseAND(F.lit((1 << 31) - 1))
    made = spark.range(200_000).select(text.alias("text")).withColumn("low", low)
    pair = made.groupBy("low").agg(F.collect_list("text").alias("t")).where("size(t) > 1").orderBy("low").first().t
    rows = [(None, t) for t in pair] + [(1, pair[0][:50] + "x" * 20), (2, "y" * 20 + pair[1][:45])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = repeat_report(docs, length=40, gram=12).drop("spans").collect()
    assert sorted((str(r[0]), *r[1:]) for r in got) == plain_report(rows, 40)
