import random

from netsieve.llm.decontaminate import words_of
from netsieve.llm.licenses import MOST_SHINGLES, TEMPLATES, WIDTH, Library, license_report


def plain(text, least=0.8):
    """Every window of every template's size class, compared by words."""
    words = words_of((text or "").encode())
    shingles = [tuple(words[i : i + WIDTH]) for i in range(len(words) - WIDTH + 1)]
    found = {}
    for name, template in TEMPLATES.items():
        own = words_of(template.encode())
        want = {tuple(own[i : i + WIDTH]) for i in range(len(own) - WIDTH + 1)}
        size = 1 << (len(want) - 1).bit_length()
        for start in range(0, len(shingles), size):
            share = len(want & set(shingles[start : start + 2 * size])) / len(want)
            if share >= least:
                found[name] = max(share, found.get(name, 0.0))
    return ",".join(sorted(found)), max(found.values(), default=0.0)


def texts():
    rng = random.Random(6)
    words = [f"w{i}" for i in range(50)] + ["the", "license", "under"]
    noise = lambda n: [rng.choice(words) for _ in range(n)]
    made = []
    for i in range(160):
        text = noise(rng.randint(0, 90))
        for name in rng.sample(sorted(TEMPLATES), rng.randint(0, 2)):
            own = TEMPLATES[name].split()
            if rng.random() < 0.4:
                own[rng.randrange(len(own))] = "changed"
            text += own + noise(rng.randint(0, 30))
        made.append((rng.choice([" ", "\n", "### "])).join(text))
    return made


def test_against_brute_force(spark):
    rows = list(enumerate(texts())) + [(900, None), (901, ""), (None, TEMPLATES["MIT"]), (902, "released UNDER the mit license"), (3, "x"), (3, "x")]
    rows.append((903, "word " * 60_000 + TEMPLATES["GPL-3.0"]))
    docs = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, licenses string")
    got = sorted((str(r.doc_id), r.licenses, r.share) for r in license_report(docs).collect())
    want = sorted((str(i), *plain(t)) for i, t in rows)
    assert got == want
    assert sum(bool(w[1]) for w in want) > 60


def test_empty_table(spark):
    assert license_report(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_templates_fit():
    library = Library.of(TEMPLATES)
    assert len(library.names) == len(TEMPLATES) and max(library.classes) <= MOST_SHINGLES
