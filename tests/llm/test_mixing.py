import hashlib
import re

from pyspark.sql import functions as F

from netsieve.llm.mixing import mix_sources

KIND = "doc_id long, text string, source string, size int"


def plain(rows, weights=(1, 2, 3), repeats=3):
    """Targets by resharing until none is above its limit; words taken by walking along each source."""
    sized = [(d, len(re.findall(r"[^\x20\x09-\x0D]+", t or "")), s) for d, t, s, _ in rows]
    sources = sorted({s for *_, s in sized}, key=lambda s: (s is None, (s or "").encode()))
    total = {s: sum(n for _, n, x in sized if x == s) for s in sources}
    weight = {s: weights[i % len(weights)] for i, s in enumerate(sources)}
    left, open_, target = sum(total.values()), set(sources), {}
    while open_:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        full = {s for s in open_ if share[s] >= repeats * total[s]}
        if not full:
            target.update(share)
            break
        target.update({s: float(repeats * total[s]) for s in full})
        left -= sum(repeats * total[s] for s in full)
        open_ -= full
    out = []
    for s in sources:
        own = [(hashlib.md5(("" if d is None else str(d)).encode()).hexdigest(), d is not None, d or 0, n, d) for d, n, x in sized if x == s]
        quota, at = int(target[s] + 1e-9), 0
        for *_, n, d in sorted(own):
            whole = quota // total[s] if total[s] else 0
            rest = min(n, max(0, quota % total[s] - at)) if total[s] else 0
            out.append((d, n, total[s], round(target[s], 6), whole * n + rest if n else 0))
            at += n
    return sorted(map(str, out))


def rows():
    made = [(i, "w " * (7 * i % 50), f"s{i % 5}", 1) for i in range(120)]
    made += [(200, None, "s1", 1), (201, "", None, 1), (202, "one two", None, 1), (None, "a b c", "s0", 1), (None, "a b c", "s0", 1)]
    return made + [(203, "x\u00a0y z" * 3000, "rare", 1), (3, made[3][1], "s3", 1), (204, "only", "tiny", 1), (205, None, "empty", 1)]


def test_against_plain_version(spark):
    docs = spark.createDataFrame(rows(), KIND).repartition(6)
    documents, _, _ = mix_sources(docs, block_words=16)
    got = documents.select("doc_id", F.col("size"), "source_size", F.round("target", 6), "taken").collect()
    assert sorted(str(tuple(r)) for r in got) == plain(rows())
    assert all(r.taken <= 3 * r["size"] for r in documents.collect())


def test_slots_hold_equal_blocks_and_interleave(spark):
    docs = spark.createDataFrame([(i, "w " * 100, f"s{i % 3}", 1) for i in range(300)], KIND)
    documents, pieces, targets = mix_sources(docs, block_words=50)
    slots = pieces.groupBy("slot", "source").agg(F.sum("words").alias("n")).orderBy("slot").collect()
    assert len({r.slot for r in slots}) == len(slots)
    assert sum(r.n != 50 for r in slots) <= 3
    share = {r.source: r.target / 30_000 for r in targets.collect()}
    for size in (50, 200):
        for source, wanted in share.items():
            assert abs(sum(r.source == source for r in slots[:size]) / size - wanted) < 4 / size
    assert sum(r.taken for r in documents.collect()) == sum(r.n for r in slots)


def test_reruns_agree_and_empty_tables(spark):
    docs = spark.createDataFrame(rows(), KIND)
    a, b = (sorted(map(str, mix_sources(d)[0].collect())) for d in (docs, docs.repartition(3)))
    assert a == b
    assert mix_sources(docs.limit(0))[0].collect() == []
    assert [r.taken for r in mix_sources(docs.where("text is null"))[0].collect()] == [0, 0]


def test_rows_of_one_id_are_spread(spark, monkeypatch):
    """Many rows without a doc_id, in few sizes: every place of the stream is taken once."""
    monkeypatch.setattr("netsieve.llm.mixing.CHUNK_BITS", 2)
    rows = [(None, " ".join(["w"] * (1 + i % 3)), "a") for i in range(200)] + [(i, "x y", "a") for i in range(50)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(7)
    documents, pieces, _ = mix_sources(df, carry=["text"])
    got = documents.collect()
    assert len(got) == 250 and all(r.size == len(r.text.split()) for r in got)
    assert sum(r.taken for r in got) == pieces.agg(F.sum("words")).first()[0] == sum(len(t.split()) for _, t, _ in rows)
    assert all(r.taken == r.size for r in got)  # one source takes its own words once
