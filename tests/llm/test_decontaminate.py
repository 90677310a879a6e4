import hashlib
import random
import re

import numpy as np
import pytest

from netsieve.llm.decontaminate import contamination_report, names_digest, with_contamination
from netsieve.llm.fm_index import FMIndex, WaveletTree


def words(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def plain(docs, items, width):
    out = []
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for item, t in items:
            own = words(t)
            n = min(width, len(own))
            windows = {tuple(own[i : i + n]) for i in range(len(own) - n + 1)} if own else set()
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in windows:
                    hit.update(range(i, i + n))
                    found.add("" if item is None else str(item))
        names = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((str(doc), len(w), len(hit), len(found), names, bool(hit)))
    return sorted(out)


def tables(seed):
    rng = random.Random(seed)
    vocabulary = ["a", "b", "c", "Über", "d9", "é"]
    text = lambda n: rng.choice([" ", ", ", "\n"]).join(rng.choice(vocabulary + ["zz", "yy"] * 2) for _ in range(n))
    items = [(i, text(rng.randint(0, 9))) for i in range(30)] + [(1, None), (None, "a b c"), (7, "")]
    docs = [(i, text(rng.randint(0, 80))) for i in range(60)]
    docs += [(90, None), (91, ""), (None, items[0][1]), (5, docs[5][1]), (5, docs[5][1]), (92, "a B c! " * 5000)]
    return docs, items


@pytest.mark.parametrize("width", [3, 10])
def test_against_brute_force(spark, width):
    docs, items = tables(width)
    d = spark.createDataFrame([(*r, 1) for r in docs], "doc_id long, text string, found int")
    report = contamination_report(d, spark.createDataFrame(items, "item_id long, text string"), width)
    got = report.select("doc_id", "n_words", "n_hit", "n_items", names_digest(report.items), "contaminated").collect()
    assert sorted((str(r[0]), *r[1:]) for r in got) == plain(docs, items, width)


def test_blocks_of_items_give_the_same(spark):
    docs, items = tables(4)
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    key = lambda r: (str(r.doc_id), r.text or "", str(r.found))
    whole = sorted(map(key, with_contamination(d, i, 3).collect()))
    assert sorted(map(key, with_contamination(d, i, 3, block_chars=100).collect())) == whole


def test_spans_hold_the_hit_words(spark):
    docs = spark.createDataFrame([(1, "Start é: ONE two,three! end one two three")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "one two three")], "item_id long, text string")
    found = with_contamination(docs, items).first()
    text = found.text.encode()
    assert [text[s.start : s.stop].decode() for s in found.found.spans] == ["ONE two,three", "one two three"]


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    items = spark.createDataFrame([], "item_id long, text string")
    assert contamination_report(docs, items).first().n_words == 2
    assert contamination_report(docs.limit(0), items).collect() == []


def test_wavelet_ranks():
    rng = np.random.default_rng(1)
    s = rng.integers(0, 6, 300)
    tree = WaveletTree(s, 3)
    symbols, at = rng.integers(0, 6, 500), rng.integers(0, 301, 500)
    assert list(tree.rank(symbols, at)) == [int((s[:a] == c).sum()) for c, a in zip(symbols, at)]


def test_search_and_locate():
    rng = np.random.default_rng(2)
    s = rng.integers(0, 4, 400)
    s[0] = s[-1] = 0
    index = FMIndex(s, 3)
    phrases = rng.integers(1, 4, (50, 3))
    low, high = index.search(phrases)
    for p, a, b in zip(phrases, low, high):
        want = [i for i in range(len(s) - 2) if (s[i : i + 3] == p).all()]
        assert sorted(index.locate(np.arange(a, b)).tolist()) == want


def test_repeated_items_count_once(spark):
    docs, items = tables(3)
    d = spark.createDataFrame(docs, "doc_id long, text string")
    kind = "item_id long, text string"
    once, often = (contamination_report(d, spark.createDataFrame(r, kind), 3).drop("spans") for r in (items, items * 40))
    assert sorted(map(str, once.collect())) == sorted(map(str, often.collect()))
