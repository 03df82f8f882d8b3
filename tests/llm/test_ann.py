"""Approximate neighbours against brute force."""

import math
import random

import numpy as np
import pytest

from regiopanel.llm.ann import Lists, lift, nearest


def brute(rows, k, step):
    dims = [len(v) for _, v in rows if v]
    good = {i: np.array(v, float) for i, v in rows
            if v and None not in v and all(map(math.isfinite, v)) and any(v) and len(v) == max(set(dims), key=dims.count)}
    out = {}
    for q in good:
        if q % step == 0:
            near = sorted((-float(good[q] @ v), i) for i, v in good.items() if i != q)[:k]
            out[q] = [(i, -s) for s, i in near]
    return out


def run(spark, rows, k, step=5, **options):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {}
    for r in nearest(df, f"vec_id % {step} = 0", k=k, **options).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(got[r.query_id])
    return got


def vectors(seed, n=400, d=8):
    r = np.random.default_rng(seed)
    centers = r.normal(size=(12, d))
    x = (centers[r.integers(0, 12, n)] + 0.3 * r.normal(size=(n, d))).astype(np.float32)
    return [(i, v.tolist()) for i, v in enumerate(x)]


def test_exact_when_all_lists_are_read(spark):
    rows = vectors(1)
    rows += [(1000 + i, rows[7][1]) for i in range(60)]  # equal vectors, more than k
    rows += [(2000, None), (2005, [0.0] * 8), (2010, [1.0, None] + [0.0] * 6), (2015, [float("nan")] * 8), (2020, [float("inf")] * 8),
             (2025, [1.0, 2.0]), (2030, []), (5, rows[5][1])]
    got, expected = run(spark, rows, 10, prune=9.0, list_size=50), brute(rows, 10, 5)
    assert got.keys() == expected.keys()
    for q in got:
        assert [i for i, _ in got[q]] == [i for i, _ in expected[q]]
        assert np.allclose([s for _, s in got[q]], [s for _, s in expected[q]], atol=0, rtol=1e-12)


def test_recall_with_pruned_lists(spark):
    rows = vectors(2, 2000, 16)
    got, expected = run(spark, rows, 20, 20, list_size=64), brute(rows, 20, 20)
    hit = [len({i for i, _ in got[q]} & {i for i, _ in expected[q]}) / 20 for q in expected]
    assert np.mean(hit) >= 0.9


def test_few_rows_and_empty_table(spark):
    rows = [(0, [1.0, 0.0]), (5, [0.5, 0.5]), (7, [-1.0, 0.0])]
    got = run(spark, rows, 20)
    assert {q: [i for i, _ in v] for q, v in got.items()} == {0: [5, 7], 5: [0, 7]}
    assert run(spark, [], 20) == {}
    assert run(spark, [(0, [1.0])], 20) == {}
    extra = spark.createDataFrame([(0, [1.0], 3), (5, [2.0], 4)], "vec_id long, embedding array<float>, list int")
    assert nearest(extra, "vec_id % 5 = 0").count() == 2


def test_graph_search_finds_the_lists_that_a_scan_finds():
    r = np.random.default_rng(3)
    x = lift(r.normal(size=(3000, 12)), 9.0)
    lists = Lists(x, 200)
    assert len(lists.centers) == 200
    found = total = 0
    for v in x[::50]:
        d = np.sqrt(((lists.centers - v) ** 2).sum(1))
        want = set(np.flatnonzero(d <= 1.1 * d.min()).tolist())
        found += len(want & set(lists.near(v, 0.1)))
        total += len(want)
    assert found / total > 0.95
    sizes = np.bincount([lists.near(v, 0.0)[0] for v in x], minlength=200)
    assert sizes.max() < 8 * sizes.mean()


def test_entries_are_combined_over_lists():
    import pyarrow as pa

    from regiopanel.llm.ann import _Best

    r = random.Random(1)
    best, rows = _Best(3), []
    for _ in range(40):
        part = [(r.randrange(4), r.choice([0.5, 0.25, 0.125, r.random()]), [r.randrange(30)]) for _ in range(r.randrange(1, 9))]
        part = [(q, (i[0] % 8) / 8, i) for q, _, i in part]  # an entry has one score
        rows += part
        best.add(np.array([p[0] for p in part]), np.array([p[1] for p in part]), pa.array([p[2] for p in part], pa.list_(pa.int64())))
        if r.random() < 0.3:
            best.prune()
    best.prune()
    got = sorted((x["query"], x["score"], x["ids"]) for x in best.take().to_pylist())
    expected = []
    for q in range(4):
        own = sorted({(-s, i[0]) for p, s, i in rows if p == q})
        expected += [(q, -s, [i]) for s, i in own if s <= own[min(3, len(own)) - 1][0]]
    assert got == sorted(expected) and best.take().num_rows == 0


def test_small_buffers_change_nothing(spark, monkeypatch):
    from regiopanel.llm import ann

    rows = vectors(4)
    expected = run(spark, rows, 10, list_size=40)
    monkeypatch.setattr(ann, "HELD", 5)
    assert run(spark, rows, 10, list_size=40) == expected
