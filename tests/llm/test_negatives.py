"""Hard negatives, against brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from bibspark.llm import negatives

KIND = "vec_id long, embedding array<double>, label int, x long, pivot int, away double"


def expected(rows, step, scale=256, k=5, share=80):
    """By all pairs, in Python's integers."""
    rows = [r for r in rows if r[0] is not None and r[1] is not None and r[2] is not None and len(r[1]) and all(x is not None and math.isfinite(x) and abs(scale * x) < negatives.LARGE for x in r[1])]
    if not rows:
        return []
    sizes = [len(r[1]) for r in rows]
    d = min(set(sizes), key=lambda n: (-sizes.count(n), n))
    least = {}
    for i, e, label, *_ in rows:
        if len(e) == d:
            v = (label, [math.floor(scale * x) for x in e])
            least[i] = min(least.get(i, v), v)
    out = []
    for a, (label, v) in least.items():
        if a % step:
            continue
        others = sorted((-sum(x * y for x, y in zip(v, w)), i, other) for i, (other, w) in least.items() if i != a)
        for s, p, _ in [o for o in others if o[2] == label][:k]:
            fit = [o for o in others if o[2] != label and share * -s <= 100 * -o[0] <= 100 * -s][:k]
            out += [(a, p, r + 1, i, -s, -t) for r, (t, i, _) in enumerate(fit)]
    return sorted(out)


def mined(spark, rows, step, **kw):
    df = spark.createDataFrame([(*r, i, i, 0.5) for i, r in enumerate(rows)], KIND)
    return sorted(tuple(r) for r in negatives.mine(df, F.col("vec_id") % step == 0, **kw).collect())


def clusters(n, d, seed, groups=20, spread=0.15):
    r = np.random.default_rng(seed)
    c = r.standard_normal((groups, d))
    x = c[r.integers(groups, size=n)] + spread * r.standard_normal((n, d))
    return x * np.exp(0.3 * r.standard_normal((n, 1)))  # uneven norms


@pytest.fixture
def small(monkeypatch):
    """Many pivots, slabs, blocks, groups of anchors."""
    for name, value in {"PER_PIVOT": 20, "SLAB": 16, "BLOCK": 100, "ASKED": 7, "PART": 10}.items():
        monkeypatch.setattr(negatives, name, value)


def test_data_of_several_shapes(spark, small):
    r = random.Random(1)
    plain = [(i, np.random.default_rng(i).standard_normal(8).tolist(), i % 3) for i in range(400)]
    clustered = [(i, x.tolist(), r.randrange(4)) for i, x in enumerate(clusters(400, 8, 2))]
    separate = [(i, x.tolist(), int(x[0] > 0)) for i, x in enumerate(clusters(400, 4, 3))]
    copies = [(i, [0.5, 0.25, -1.0] if i % 3 else [math.sin(i), math.cos(i), 0.1], i % 7 % 4) for i in range(400)]  # two thirds are one vector
    rare = [(i, [math.sin(i), math.cos(i)], 0 if i < 380 else i) for i in range(400)]  # labels of one row; one that most have
    for rows in (plain, clustered, separate, copies, rare):
        assert mined(spark, rows, 10) == expected(rows, 10)


def test_odd_rows(spark, small):
    nan, inf = float("nan"), float("inf")
    rows = [(None, [1.0, 1.0], 1), (1, None, 1), (2, [1.0, None], 1), (3, [1.0, nan], 1), (4, [inf, 1.0], 1), (5, [1.0, 1.0], None), (6, [], 1), (7, [1.0, 2.0, 3.0], 1), (8, [1e300, 1.0], 1)]
    assert mined(spark, rows[:-2], 1) == []
    assert mined(spark, [], 1) == []
    rows += [(0, [0.0, 0.0], 1), (10, [0.0, 0.0], 1), (20, [0.0, 0.0], 2), (30, [-1.0, 0.5], 2), (30, [1.0, 0.5], 1), (30, [1.0, 0.5], 1)]  # repeated ids
    rows += [(i, [math.sin(i), 1.0], i % 2) for i in range(11, 29)]
    got = mined(spark, rows, 1)
    assert got == expected(rows, 1) and got
    assert mined(spark, [(100, [1.0], 1)], 1) == [] and mined(spark, [(0, [-1.0], 1), (1, [1.0], 1), (2, [1.0], 2)], 1) == expected([(0, [-1.0], 1), (1, [1.0], 1), (2, [1.0], 2)], 1)


def test_scores_beyond_double_precision(spark, small):
    r = random.Random(4)
    rows = [(i, [float(r.randrange(-(2**25), 2**25)) for _ in range(40)], i % 3) for i in range(120)]
    rows = [(i, [abs(x) for x in e], label) for i, e, label in rows]
    assert mined(spark, rows, 5, scale=1) == expected(rows, 5, scale=1)


def test_other_numbers_of_rows(spark):
    rows = [(i, x.tolist(), i % 5) for i, x in enumerate(clusters(300, 6, 7, spread=0.6))]
    assert mined(spark, rows, 3, scale=100, positives=2, negatives=9, share=37) == expected(rows, 3, scale=100, k=2, share=37)[:0] + by_numbers(rows)


def by_numbers(rows):
    """2 positives, 9 negatives, 37 percent."""
    best = expected(rows, 3, scale=100, k=9, share=37)
    out, seen = [], {}
    for row in sorted(best, key=lambda r: (r[0], -r[4], r[1], r[2])):
        mine = seen.setdefault(row[0], [])
        if row[1] not in mine:
            mine.append(row[1])
    vectors = {i: ([math.floor(100 * x) for x in e], label) for i, e, label in rows}
    for a, (v, label) in vectors.items():
        first = sorted((-sum(x * y for x, y in zip(v, w)), i) for i, (w, other) in vectors.items() if i != a and other == label)[:2]
        out += [r for r in best if r[0] == a and r[1] in [i for _, i in first]]
    return sorted(out)


def test_annuli_leave_most_of_clustered_data_out(monkeypatch):
    """The scan multiplies the slabs that the bounds ask for, and no others."""
    x = np.floor(256 * clusters(8000, 16, 5, groups=40, spread=0.05)).astype(np.int64)
    monkeypatch.setattr(negatives, "PER_PIVOT", 100)
    space = negatives.Space(x[::4], float((x * x).sum(axis=1).max()), int(np.abs(x).max()), len(x))
    away = space.distances(space.augmented(x))
    pivot = away.argmin(axis=1)
    key = away[np.arange(len(x)), pivot]
    order = np.lexsort((key, pivot))
    labels, read = np.arange(len(x)) % 3, []

    class Counted(np.ndarray):
        def astype(self, *a, **kw):
            read.append(len(self))
            return np.asarray(self).astype(*a, **kw)

    slabs = []
    for p in np.unique(pivot):
        mine = order[pivot[order] == p]
        for at in range(0, len(mine), 64):
            part = mine[at : at + 64]
            slabs.append((int(p), key[part[0]], key[part[-1]], part.astype(np.int64), labels[part], x[part].view(Counted)))
    for a in range(0, 8000, 400):
        got = negatives.scan(space, slabs, np.array([a]), labels[[a]], x[[a]], np.array([[-negatives.NONE]]), np.array([[negatives.NONE]]), True, 5)
        score = x @ x[a]
        score[(labels != labels[a]) | (np.arange(len(x)) == a)] = -negatives.NONE
        want = np.lexsort((np.arange(len(x)), -score))[:5]
        assert got[2].tolist() == want.tolist()
    assert sum(read) < 0.35 * 8000 * 20  # 28 %


def test_query_against_brute_force(spark):
    from bibspark.llm import queries

    rows = [(r["vec_id"], r["embedding"], (r["label"] + 1) % 10 if r["vec_id"] % 7 == 0 else r["label"]) for r in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()]
    assert sorted(tuple(r) for r in queries.QUERIES["op11_hard_negatives"](spark, "/root/testdata/sf0.001").collect()) == expected(rows, 100)
