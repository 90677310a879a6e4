import random

import pytest
import xxhash

from netsieve.llm.simhash import covering_masks, keep_one, link_fingerprints, near_duplicates


def plain_fingerprint(text, width=4):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    shingles = [b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))] if words else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(rows, radius=4):
    fps = [plain_fingerprint(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                root[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(i)] = min(doc, least.get(find(i), doc))
    return sorted((str(d), f"{fps[i]:016x}", str(least.get(find(i)))) for i, (d, _) in enumerate(rows))


def texts(seed, n):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)] + ["É", "ß", "Über"]
    made = []
    for i in range(n):
        if made and rng.random() < 0.6:
            base = rng.choice(made).split(" ")
            for _ in range(rng.randint(0, 2)):
                base[rng.randrange(len(base))] = rng.choice(words)
            made.append(" ".join(base))
        else:
            made.append(" ".join(rng.choice(words) for _ in range(rng.randint(1, 120))))
    return made


def test_covering_guarantee():
    rng = random.Random(1)
    for radius, bits, parts in ((4, 64, 1), (4, 31, 1), (19, 128, 5)):
        masks = covering_masks(radius, list(range(bits)), parts)
        for _ in range(400):
            differing = sum(1 << b for b in rng.sample(range(bits), radius))
            assert any(not m & differing for m in masks)


def test_against_brute_force(spark):
    rows = list(enumerate(texts(2, 150)))
    rows += [(500, None), (501, ""), (502, " \n"), (None, "w1 w2 w3"), (None, "w1 w2 w3"), (3, rows[3][1]), (600, "x " * 40_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fingerprint", clash("clash"))
    for crowd in (8192, 3):
        found = near_duplicates(docs, crowd=crowd)
        got = sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in found.collect())
        assert got == plain_components(rows)


def clash(value):
    from pyspark.sql import functions as F

    return F.lit(value)


@pytest.mark.parametrize("parts,radius,crowd", [(1, 4, 8192), (1, 4, 4), (2, 9, 16), (3, 9, 8192)])
def test_every_pair_is_joined(spark, parts, radius, crowd):
    rng = random.Random(7)
    centre = rng.getrandbits(64)
    fps = {centre}
    while len(fps) < 120:
        x = rng.choice(sorted(fps))
        for b in rng.sample(range(64), rng.randint(1, radius + 2)):
            x ^= 1 << b
        fps.add(x)
    signed = [(f - (1 << 64) if f >> 63 else f,) for f in fps]
    links = link_fingerprints(spark.createDataFrame(signed, "f0 long"), radius, parts, crowd).collect()
    group = {f: f for (f,) in signed}

    def find(a):
        while group[a] != a:
            a = group[a]
        return a

    for r in links:
        assert ((r.a.f0 ^ r.b.f0) & (1 << 64) - 1).bit_count() <= radius
        group[find(r.a.f0)] = find(r.b.f0)
    for (a,) in signed:
        for (b,) in signed:
            if ((a ^ b) & (1 << 64) - 1).bit_count() <= radius:
                assert find(a) == find(b)


def test_keep_one(spark):
    base = " ".join(f"w{i}" for i in range(300))
    rows = [(5, base, "a"), (2, base, "b"), (2, base, "c"), (7, base.replace("w9 ", "v "), "d"), (9, "other words", "e"), (None, None, "f")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, digest string")
    kept = keep_one(docs, near_duplicates(docs, width=5, radius=19, bits=128, parts=5))
    assert kept.columns == docs.columns
    assert sorted((str(r.doc_id) for r in kept.collect())) == ["2", "9", "None"]


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert near_duplicates(docs).collect() == []
