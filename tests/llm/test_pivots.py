import math

import numpy as np
import pytest

from scholarframe.llm.pivots import _candidates, vector_groups


def brute(rows, least=0.9):
    own = {}
    for k, v in rows:
        ok = v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)
        if k is not None:
            own[k] = np.array(v) if ok else None
    keys = [k for k, v in own.items() if v is not None]
    if keys:
        x = np.array([own[k] for k in keys])
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        like = (x @ x.T >= least) & ~np.eye(len(keys), dtype=bool)
    links = {k: 0 for k in own}
    root = {k: k for k in own}

    def up(k):
        while root[k] != k:
            k = root[k]
        return k

    for i, k in enumerate(keys):
        links[k] = int(like[i].sum())
        for j in np.flatnonzero(like[i]):
            a, b = sorted((up(k), up(keys[j])))
            root[b] = a
    return {k: (links[k], up(k), up(k) == k) for k in own}


def near(rng, v, cosine):
    g = rng.normal(size=len(v))
    g -= (g @ v) * v
    return cosine * v + math.sqrt(1 - cosine**2) * g / np.linalg.norm(g)


def cases(seed, n=600, copies=40, cluster=150):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n, 32))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    out = [v.tolist() for v in base]
    out += [base[0].tolist()] * copies + [(3 * base[1]).tolist()]
    out += [near(rng, base[2], 0.985).tolist() for _ in range(cluster)]
    out += [near(rng, base[int(rng.integers(n))], c).tolist() for c in (0.93, 0.95, 0.97) for _ in range(40)]
    out += [None, [0.0] * 32, [math.nan] * 32, [None] + [1.0] * 31, [math.inf] * 32, []]
    ids = rng.permutation(len(out) * 2)[: len(out)]
    return [(int(k), v) for k, v in zip(ids, out, strict=True)]


@pytest.mark.parametrize("together", [4096, 60])
def test_groups_match_brute_force(spark, together):
    rows = cases(3)
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<double>, label int, rep string").repartition(4)
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in vector_groups(df, together=together).collect()}
    want = brute(rows)
    assert got.keys() == want.keys()
    found, there = sum(v[0] for v in got.values()), sum(v[0] for v in want.values())
    assert all(got[k][0] <= want[k][0] for k in want)
    assert found >= 0.999 * there
    assert sum(got[k] == want[k] for k in want) >= 0.99 * len(want)


def test_few_and_odd_rows(spark):
    rows = [(5, [1.0, 0.0]), (3, [1.0, 0.1]), (9, [0.0, 1.0]), (7, None), (None, [1.0, 0.0]), (5, [1.0, 0.0]), (11, [2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = sorted(((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in vector_groups(df).collect()), key=str)
    assert got == sorted([(3, 2, 3, True), (5, 2, 3, False), (5, 2, 3, False), (7, 0, 7, True), (9, 0, 9, True), (11, 2, 3, False), (None, 0, None, False)], key=str)


@pytest.mark.parametrize("rows", [[], [(1, None)]])
def test_nothing_to_link(spark, rows):
    got = vector_groups(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    assert [(r["vec_id"], r["n_links"]) for r in got] == [(k, 0) for k, _ in rows]


def test_shared_pivots_are_counted_from_the_lists():
    rng = np.random.default_rng(6)
    near = np.array([rng.choice(40, 6, replace=False) for _ in range(150)])
    for shared in (1, 2, 3):
        got = sorted((int(a), int(b)) for i, j in _candidates(near, shared) for a, b in zip(i, j))
        assert got == [(a, b) for a in range(150) for b in range(a + 1, 150) if len(set(near[a]) & set(near[b])) >= shared]
