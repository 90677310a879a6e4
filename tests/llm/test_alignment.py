import random
from collections import Counter

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from netsieve.llm.alignment import DEFAULT_BYTES, DEFAULT_PIECES, Settings, Tokenizers, Vocabularies, align, align_documents, pieces_of, windows

ODD = [" ", "  ", "\n", "\t", "é", "ß", "漢字", "\U0001f600", "<|endoftext|>", "<s>", "</s>", "<unk>", "<0x0A>", "▁", "'s", "12,5", " ", "\x00", "ab", "word", "|"]


@pytest.fixture(scope="module")
def both():
    own = Vocabularies.read()
    return Tokenizers(own.a, own.b)


class Plain:
    """Whole texts by the libraries themselves, and every group by walking over bytes."""

    def __init__(self):
        self.a = Tokenizer.from_file(DEFAULT_BYTES)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=DEFAULT_PIECES)
        visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
        self.letters = {chr(b): b for b in visible}
        for i, b in enumerate(x for x in range(256) if x not in visible):
            self.letters[chr(256 + i)] = b

    def groups(self, text):
        """[(A ids, B ids)], None without tokens."""
        if not text:
            return None
        a = self.a.encode(" " + text, add_special_tokens=False).ids
        b = self.b.encode(text)
        left = [bytes(self.letters[c] for c in self.a.id_to_token(i)) for i in a]
        right = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i in b for p in [self.b.id_to_piece(i)]]
        if b"".join(left) != (" " + text).encode() or b"".join(right) != (" " + text).encode():
            return None
        out, i, j, at, to = [], 0, 0, 0, 0
        own = ([], [])
        while i < len(a) or j < len(b):
            if at <= to:
                own[0].append(a[i])
                at += len(left[i])
                i += 1
            else:
                own[1].append(b[j])
                to += len(right[j])
                j += 1
            if at == to:
                out.append(own)
                own = ([], [])
        return out

    def report(self, texts):
        found = [self.groups(t) for t in texts]
        linked = [Counter((x, y) for left, right in g or [] for x in left for y in right) for g in found]
        counts = Counter(p for own in linked for p in own)
        most = Counter()
        for (x, _), n in counts.items():
            most[x] = max(most[x], n)
        rows = []
        for g, own in zip(found, linked):
            name = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in g or [])
            sizes = (sum(len(x) for x, _ in g or []), sum(len(y) for _, y in g or []), len(g or []), sum(own.values()))
            best = sum(n for p, n in own.items() if counts[p] == most[p[0]])
            rows.append((*sizes, best, sum(n * counts[p] for p, n in own.items()), name))
        return rows, counts


def texts(n, seed=0):
    rng = random.Random(seed)
    words = ["the", "Anblewh", "laeureaux", "Straße", "ción", "don't", "x1y2", "running", "tokenization", "thth", "Ouwhea"]
    out = []
    for i in range(n):
        out.append("".join(rng.choice(words) + rng.choice([" ", " ", " ", ". ", "\n", "  ", rng.choice(ODD)]) for _ in range(rng.randint(1, 60))))
    return out + out[:3] + [rng.choice(ODD) * 3 for _ in range(20)] + ["".join(rng.choices(ODD, k=30)) for _ in range(20)]


NAMES = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"]


@pytest.mark.parametrize("settings", [Settings(), Settings(max_broadcast=10, max_counts=20, chunk_tokens=50, piece_chars=40)])
def test_against_plain_alignment(spark, settings):
    rows = [*texts(60), "", None, "a", "word " * 20_000, "x" * 3000]
    docs = spark.createDataFrame([(i, t, "kept") for i, t in enumerate(rows)], "doc_id long, text string, row string").repartition(5)
    aligned, pairs = align_documents(docs, settings=settings)
    want, counts = Plain().report(rows)
    got = {r.doc_id: r for r in aligned.collect()}
    assert len(got) == len(rows) and all(r.row == "kept" for r in got.values())
    for i, expected in enumerate(want):
        assert tuple(got[i][n] for n in NAMES) == expected, rows[i]
    assert any(w[0] for w in want) and {(r.a, r.b): r.documents for r in pairs.collect()} == dict(counts)


def test_odd_rows(spark):
    rows = [(None, "one two"), (None, "one two"), (1, None), (1, ""), (2, "▁x"), (3, "café")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [tuple(r)[1:] for r in align_documents(docs)[0].collect()]
    assert sorted(got) == sorted(Plain().report([t for _, t in rows])[0])
    assert got.count((0, 0, 0, 0, 0, 0, "")) == 3  # without a text, or with the mark of a space in it
    assert align_documents(docs.limit(0))[0].collect() == []
    assert align_documents(docs.where("text IS NULL"))[0].count() == 1
    with pytest.raises(ValueError, match="groups"):
        align_documents(docs.withColumn("groups", F.lit(1)))
    assert align_documents(docs.select("text"))[0].columns == NAMES


def test_bytes_that_are_no_text(spark):
    docs = spark.createDataFrame([(1,)], "doc_id long").withColumn("text", F.expr("cast(x'61ff62' as string)"))
    assert [tuple(r) for r in align_documents(docs)[0].collect()] == [(1, 0, 0, 0, 0, 0, 0, "")]


def test_ids_are_those_of_the_libraries(both):
    plain = Plain()
    rng = random.Random(4)
    for _ in range(300):
        text = "".join(rng.choices(ODD + [chr(rng.randrange(32, 0x2FFF))], k=rng.randint(1, 20)))
        assert list(both.encode_a(" " + text)) == plain.a.encode(" " + text, add_special_tokens=False).ids


def test_pieces_leave_out_one_space_each(both):
    for text in texts(20, seed=9):
        for size in (1, 5, 17, 10_000):
            parts = list(pieces_of(text, size))
            assert " ".join(parts) == text
            whole, cut = both.encode(text, 10**9), both.encode(text, size)
            assert (whole is None) == (cut is None)
            assert whole is None or all((x == y).all() for x, y in zip(whole, cut))


def test_windows_begin_at_shared_spaces(both):
    a, b = both.encode("the cat sat on the mat and the dog sat too", 100)
    assert [len(x) for x in windows(a, b, both)] == [11, 11]
    for n in (1, 3):
        found = align([(a, b)] * n, both)
        assert found.n_groups.tolist() == [len(found.groups[0].split(";"))] * n
        assert found.times.sum() == found.n_links.sum() and len(found.until) == n


def test_windows_that_share_a_hash_stay_apart(both, monkeypatch):
    ids = [both.encode(t, 100) for t in ("one two one", "three two")]
    want = align(ids, both)
    monkeypatch.setattr("netsieve.llm.alignment._ODD", (np.uint64(0),) * 4)  # every window of one size has the same hash
    got = align(ids, both)
    assert got.groups == want.groups and (got.pairs == want.pairs).all() and (got.times == want.times).all()
