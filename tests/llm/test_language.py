import random
import zlib

import numpy as np

from netsieve.llm.language import DIMENSIONS, Settings, cluster, fit, identify_languages, with_language

WORDS = {
    "xx": ["the", "and", "with", "house", "thing", "over", "water"],
    "yy": ["und", "der", "straße", "über", "nicht", "schön", "haus"],
    "zz": ["вода", "дом", "не", "и", "над", "вещь"],
}


def made(n, seed=3):
    rng = random.Random(seed)
    return [(i, " ".join(rng.choice(WORDS[k]) for _ in range(rng.randint(3, 40))), k) for i in range(n) for k in [rng.choice(list(WORDS))]]


def test_held_out_accuracy(spark):
    rows = made(400)
    docs = spark.createDataFrame([(*r, 1.0) for r in rows], "doc_id long, text string, lang string, score double")
    got = {r.doc_id: r for r in identify_languages(docs).collect()}
    assert len(got) == 400
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    held = [got[i].lang_pred == k for i, _, k in rows if got[i].held_out]
    assert len(held) > 40 and np.mean(held) > 0.97
    assert all(0 <= r.score <= 1 for r in got.values())


def test_odd_rows(spark):
    odd = [(900, None, "xx"), (901, "", "xx"), (902, "123 !? €", "yy"), (None, "the house", None), (903, "q", "xx"), (904, "the " * 200_000, None)]
    odd += [(905, "漢字漢字", None), (3, "the", "xx"), (3, "the", "xx")]
    docs = spark.createDataFrame(made(100) + odd, "doc_id long, text string, lang string")
    got = identify_languages(docs)
    rows = {r.doc_id: r for r in got.collect()}
    assert got.count() == 109
    assert [rows[i].lang_pred for i in (900, 901, 902)] == ["und"] * 3
    assert rows[904].lang_pred == "xx" and rows[None].lang_pred == "xx" and not rows[None].held_out
    assert rows[905].lang_pred in WORDS and rows[905].rejected
    empty = identify_languages(docs.limit(0))
    assert empty.collect() == []


def test_nothing_learned(spark):
    docs = spark.createDataFrame([(1, "the", None)], "doc_id long, text string, lang string")
    assert identify_languages(docs).first().lang_pred == "und"


def test_held_out_languages_change_nothing(spark):
    rows = made(150)
    flipped = [(i, t, "xx" if zlib.crc32(str(i).encode()) % 5 == 0 else k) for i, t, k in rows]
    kind = "doc_id long, text string, lang string"
    a, b = (sorted(map(tuple, identify_languages(spark.createDataFrame(x, kind)).collect())) for x in (rows, flipped))
    assert a == b


def test_clusters_of_equal_rows():
    rows = np.ones((5, 4), np.float32) / 2
    centres, least = cluster(rows, Settings())
    assert len(centres) == 1 and least[0] > 0.99


def plain_grams(text):
    """Counts of hashed byte n-grams, one after the other."""
    letters = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in text.encode())
    data, counts = b" ".join(letters.split()), np.zeros(DIMENSIONS)
    for i in range(len(data)):
        codes = [data[i] + 1]
        if i + 1 < len(data):
            codes.append((data[i] << 8 | data[i + 1]) | 1 << 24)
        if i + 2 < len(data):
            codes.append((data[i] << 16 | data[i + 1] << 8 | data[i + 2]) + (1 << 25))
        for code in codes:
            counts[code * 0x9E3779B1 % (1 << 32) >> 19] += 1
    return counts


def test_model_and_choice_against_plain_vectors(spark):
    rows = made(120, seed=9)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = fit(docs)
    every = [(k, t) for i, t, k in rows if zlib.crc32(str(i).encode()) % 5]
    learned = set(every)
    df = sum((plain_grams(t) > 0).astype(float) for _, t in every)
    np.testing.assert_allclose(model.idf, np.log((1 + len(every)) / (1 + df)) + 1)

    def vector(text):
        counts = plain_grams(text)
        weighed = np.where(counts > 0, 1 + np.log(np.maximum(counts, 1)), 0) * model.idf
        return weighed / np.linalg.norm(weighed)

    for at, language in enumerate(model.languages):  # a centroid is the normalised sum of the texts that are nearest to it
        own = [k for k, x in enumerate(model.languages) if x == language]
        members = [v for v in (vector(t) for k, t in sorted(learned) if k == language) if own[int(np.argmax(v @ model.centroids[:, own]))] == at]
        total = np.sum(members, axis=0)
        assert model.centroids[:, at] @ (total / np.linalg.norm(total)) > 0.98
    for r in with_language(docs, model).collect():
        cosines = vector(r.text) @ model.centroids
        assert r.language.lang_pred == model.languages[int(np.argmax(cosines))] and abs(r.language.score - cosines.max()) < 1e-5


def test_a_language_of_few_texts_is_learned_however_often_they_come(spark):
    rows = made(100, seed=6) + [(1000 + i, "quux flob zzyx grault " * 3, "ww") for i in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = fit(docs, Settings(max_rows=20))
    assert set(model.languages) == {*WORDS, "ww"}
