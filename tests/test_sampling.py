import pytest

from netsieve.operators.sampling import assign_batches, balanced_sample, quota_cap


def labelled(spark, *sizes):
    rows = [(i * 100_000 + j, i) for i, n in enumerate(sizes) for j in range(n)]
    return spark.createDataFrame(rows, "id long, label int")


@pytest.mark.parametrize("sizes,size", [((700, 260, 5), 32), ((40, 40, 40), 3), ((1000, 1), 7), ((5,), 8), ((64, 64), 32)])
def test_batches(spark, sizes, size):
    rows = assign_batches(labelled(spark, *sizes), "label", size, "id").collect()
    total = sum(sizes)
    assert len(rows) == total and len({r.id for r in rows}) == total
    batches = {}
    for r in rows:
        batches.setdefault(r.batch, []).append(r.label)
    last = (total - 1) // size
    assert sorted(batches) == list(range(last + 1))
    assert all(len(batches[b]) == size for b in range(last))
    left = dict(enumerate(sizes))
    for b in range(last):
        assert {c for c, n in left.items() if n > 0} <= set(batches[b])
        for c in batches[b]:
            left[c] -= 1


def test_drop_last_and_epochs(spark):
    df = labelled(spark, 50, 20)
    kept = assign_batches(df, "label", 32, "id", drop_last=True)
    assert kept.count() == 64
    a, b = ({(r.id, r.batch) for r in assign_batches(df, "label", 32, "id", epoch=e).collect()} for e in (0, 1))
    assert a != b
    with pytest.raises(ValueError):
        assign_batches(labelled(spark, 1, 1, 1), "label", 2, "id")


def test_balanced_sample(spark):
    out = balanced_sample(labelled(spark, 100, 30, 10), "label", [0, 1, 2], 10, "id").orderBy("sample_index").collect()
    assert [r.sample_index for r in out] == list(range(30)) and [r.label for r in out] == [0, 1, 2] * 10
    with pytest.raises(ValueError, match="short"):
        balanced_sample(labelled(spark, 100, 3), "label", [0, 1], 10, "id")


def test_ranks_trim_each_task_before_the_shuffle(spark):
    df = labelled(spark, 100, 30)
    for out in (balanced_sample(df, "label", [0, 1], 10, "id"), quota_cap(df, "label", ["id"], 50)):
        assert "WindowGroupLimit" in out._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("sizes,total", [((500, 700, 20), 300), ((10, 10), 1000), ((5, 5, 5), 2)])
def test_quota_cap(spark, sizes, total):
    df = labelled(spark, *sizes)
    index = [(r.id, r.label) for r in df.orderBy("id").collect()]
    quota = max(1, total // len(sizes))
    chosen = [x for c in range(len(sizes)) for x in [y for y in index if y[1] == c][:quota]]
    chosen += [x for x in index if x not in set(chosen)][: max(0, total - len(chosen))]
    got = [(r.id, r.label) for r in quota_cap(df, "label", ["id"], total).collect()]
    assert sorted(got) == sorted(chosen[:total])
