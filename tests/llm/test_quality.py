import random
import zlib
from collections import Counter
from itertools import product

import numpy as np
from pyspark.sql import functions as F

from netsieve.llm.quality import NAMES, Model, Settings, cuts, fit, measure, score_quality, shallow_tree, sigmoid, train


def made(n, seed=1):
    """Good texts of sentences; bad ones are lists of words or say one word again and again."""
    rng = random.Random(seed)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300)]
    rows = []
    for i in range(n):
        text = [rng.choice(words) for _ in range(rng.randint(8, 80))]
        good = int(rng.random() < 0.6)
        if not good:
            text = [text[0]] * len(text) if i % 2 else " | ".join(text).split(" ")
        rows.append((i, " ".join(text).capitalize() + "." * good, good))
    return rows


def frames(spark, rows):
    docs = spark.createDataFrame([(i, t, "x", 0.5) for i, t, _ in rows], "doc_id long, text string, lang string, score double")
    return docs, spark.createDataFrame([(i, x) for i, _, x in rows], "doc_id long, label int")


def test_held_out_accuracy(spark):
    rows = made(500)
    docs, labels = frames(spark, rows)
    got = {r.doc_id: r for r in score_quality(docs, labels).collect()}
    assert len(got) == 500
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    assert np.mean([got[i].predicted == x for i, _, x in rows if got[i].held_out]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got.values())


def same(a: Model, b: Model) -> bool:
    return (
        a.base == b.base
        and all(map(np.array_equal, a.edges, b.edges))
        and all(map(np.array_equal, a.tables, b.tables))
        and [p[:2] for p in a.pairs] == [p[:2] for p in b.pairs]
        and all(np.array_equal(p[4], q[4]) for p, q in zip(a.pairs, b.pairs))
    )


def test_held_out_labels_and_the_order_of_rows_change_nothing(spark):
    rows = made(200)
    docs, labels = frames(spark, rows)
    flipped = [(i, 1 - x if zlib.crc32(str(i).encode()) % 5 == 0 else x) for i, _, x in rows]
    want = fit(docs, labels)
    assert same(want, fit(docs, spark.createDataFrame(flipped, "doc_id long, label int")))
    assert same(want, fit(docs.orderBy(F.desc("text")), labels.repartition(7)))


def test_sample_is_bounded(spark):
    rows = made(120)
    docs, labels = frames(spark, rows)
    few = fit(docs.union(docs).union(docs), labels, Settings(max_rows=40))
    assert same(few, fit(docs, labels, Settings(max_rows=40)))


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (None, "some words"), (3, "long " * 100_000), (4, "a"), (4, "a"), (5, " \n\t "), (6, "été \U0001f600 x y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(4, 1), (4, None), (None, 1), (1, 0), (77, 1), (3, 5)], "doc_id long, label int")
    got = score_quality(docs, labels).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    assert got[0].score == got[1].score and [r.held_out for r in got if r.doc_id is None] == [False]
    none = spark.createDataFrame([], "doc_id long, label int")
    assert [r.score for r in score_quality(docs, none).collect()] == [0.5] * len(rows)
    assert score_quality(docs.limit(0), labels).collect() == []


def plain_measure(text: str) -> dict[str, float]:
    """The numbers once more, letter by letter."""
    data = text.encode()
    words, lines = data.split(), [x.strip() for x in data.split(b"\n") if x.strip()]
    letter = lambda b: 97 <= b <= 122 or 65 <= b <= 90 or b >= 128
    n = max(1, len(words))
    stops = sum(b in b".!?" for b in data)
    share = [k / len(data) for k in Counter(data).values()]
    return {
        "letters": sum(letter(b) and not 65 <= b <= 90 for b in data) / len(data),
        "capitals": sum(65 <= b <= 90 for b in data) / len(data),
        "digits": sum(48 <= b <= 57 for b in data) / len(data),
        "stops": stops / len(data),
        "word_length": sum(map(len, words)) / n,
        "distinct_words": len(set(words)) / n,
        "top_word": max(Counter(words).values(), default=0) / n,
        "same_as_before": sum(a == b for a, b in zip(words, words[1:])) / n,
        "distinct_pairs": len({*zip(words, words[1:])}) / n,
        "short_words": sum(len(w) <= 3 for w in words) / n if words else 1.0,
        "wordless": sum(not any(map(letter, w)) for w in words) / n,
        "capital_starts": sum(65 <= w[0] <= 90 for w in words) / n,
        "longest_word": float(np.log1p(max(map(len, words), default=0))),
        "words_a_line": n / max(1, len(lines)),
        "distinct_lines": len(set(lines)) / max(1, len(lines)),
        "closed_lines": sum(x[-1:] in (b".", b"!", b"?") for x in lines) / max(1, len(lines)),
        "byte_entropy": float(-sum(p * np.log2(p) for p in share)),
        "words_a_stop": n / (1 + stops),
    }


def test_numbers_of_a_text():
    texts = ["One two, two three!\n\nfour | | 5 6.7\n  Four. ", "a", " ", "|| 12 --", "Été chez\tnous été été", "x " * 999 + "End"]
    for text in texts:
        got = dict(zip(NAMES, measure(text.encode())))
        for name, value in plain_measure(text).items():
            assert abs(got[name] - value) < 1e-9, (text[:20], name)
    assert not measure(None).any() and not measure(b"").any()


def best_tree(g, h, n, depth, settings):
    """The gain of the greedy tree, with every cut tried by itself."""
    gain = lambda x, y: x.sum() ** 2 / (y.sum() + settings.l2)
    options = []
    for axis in (0, 1):
        for at in range(1, g.shape[axis]):
            parts = [np.split(x, [at], axis) for x in (g, h, n)]
            if min(p.sum() for p in parts[2]) >= settings.least_rows:
                options.append((gain(parts[0][0], parts[1][0]) + gain(parts[0][1], parts[1][1]), -axis, -at, parts))
    if not depth or not options or max(o[0] for o in options) <= gain(g, h) + 1e-9:
        return gain(g, h)
    parts = max(options, key=lambda o: o[:3])[3]
    return sum(best_tree(*(p[side] for p in parts), depth - 1, settings) for side in (0, 1))


def test_trees_against_every_cut():
    rng = np.random.default_rng(3)
    settings = Settings(least_rows=3)
    for shape in [(1, 1), (7, 1), (5, 6), (9, 4)]:
        n = rng.integers(0, 5, shape).astype(float)
        g, h = rng.normal(size=shape) * n, rng.random(shape) * n
        step, gain = shallow_tree(g, h, n, 2, settings)
        assert abs(gain - best_tree(g, h, n, 2, settings)) < 1e-9
        for value in np.unique(step):  # each leaf takes the Newton step of its cells
            leaf = step == value
            assert abs(value + g[leaf].sum() / (h[leaf].sum() + settings.l2)) < 1e-9


def test_scores_are_sums_of_table_entries():
    rng = np.random.default_rng(5)
    rows = np.round(rng.normal(size=(400, 4)), 1)
    labels = ((rows[:, 0] > 0) ^ (rows[:, 1] > 0)).astype(float)  # no single number tells anything, a pair tells all
    model = train(rows, labels, Settings(pairs=2))
    assert model.pairs[0][:2] == (0, 1)
    got = model.margins(rows)
    assert np.mean((got > 0) == (labels == 1)) > 0.97
    for row, margin in zip(rows[:50], got):
        want = model.base + sum(t[sum(e <= x for e in edges)] for x, edges, t in zip(row, model.edges, model.tables))
        want += sum(t[sum(e <= row[i] for e in a), sum(e <= row[j] for e in b)] for i, j, a, b, t in model.pairs)
        assert abs(want - margin) < 1e-9


def test_bins_of_values_that_repeat():
    assert cuts(np.zeros(10), 8).tolist() == [0.0]
    assert len(cuts(np.arange(100.0), 8)) == 7
    for share, n in product((0.0, 1.0), (1, 6)):
        model = train(np.zeros((n, len(NAMES))), np.full(n, share))
        assert 0 < sigmoid(model.margins(np.zeros((1, len(NAMES)))))[0] < 1
