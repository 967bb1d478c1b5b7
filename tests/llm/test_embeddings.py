import math

import numpy as np
from tidemark.llm import embeddings as E

SCHEMA = "vec_id long, embedding array<float>, label int, extra string, links long"


def brute(rows, threshold):
    ok = [r for r in rows if r[0] is not None and r[2] is not None and r[1]
          and all(x is not None and math.isfinite(x) for x in r[1]) and any(r[1])]
    links, parent = {}, {r[0]: r[0] for r in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for i, a in enumerate(ok):
        for j, b in enumerate(ok):
            if i != j and a[2] == b[2] and len(a[1]) == len(b[1]):
                x, y = np.array(a[1], "f4").astype(float), np.array(b[1], "f4").astype(float)
                if x @ y / math.sqrt(x @ x) / math.sqrt(y @ y) >= threshold:
                    links[i] = links.get(i, 0) + 1
                    u, v = find(a[0]), find(b[0])
                    parent[max(u, v)] = min(u, v)
    count = {}
    for i, r in enumerate(ok):
        count[r[0]] = max(count.get(r[0], 0), links.get(i, 0))
    return {r[0]: (count.get(r[0], 0), None if r[0] is None else find(r[0])) for r in rows}


def test_links_are_those_of_double_precision(spark):
    rng = np.random.default_rng(7)
    rows = []
    for i in range(300):
        base = rng.normal(size=16) if i % 3 == 0 else base
        rows.append((i * 11 % 307, (base + rng.normal(size=16) * 0.06 * (i % 4)).tolist(), i % 2))
    rows += [(1000 + i, [1.0, 0.0] * 8, 5) for i in range(5)]
    want = brute(rows, 0.98)
    assert sum(n for n, _ in want.values()) > 50
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    for block in (E.BLOCK, 20):
        got = {r.vec_id: (r.n_links, r.component_id) for r in E.near_vectors(df, block=block).collect()}
        assert got == want


def test_bounds_hold_and_decide(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(60, 24)) * rng.lognormal(size=(60, 1))
    unit, codes, scale, length, error = E.quantise(x)
    assert np.abs(codes).max() <= 127
    exact = unit @ unit.T
    product = (codes.astype(float) @ codes.T.astype(float)) * scale[:, None] * scale
    assert (np.abs(exact - product) <= length[:, None] * error + error[:, None] + 1e-12).all()
    for threshold in (0.1, 0.3, 0.98):
        pairs = {(i, j) for a, b in E.tile_links(x, x, threshold, 7) for i, j in zip(a, b)}
        assert pairs == set(zip(*np.nonzero(exact >= threshold)))


def test_awkward_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0], 0), (1, [1.0, 0.0], 0), (2, [2.0, 0.0], 0), (3, None, 0), (4, [0.0, 0.0], 0),
            (5, [nan, 1.0], 0), (6, [inf, 1.0], 0), (7, [None, 1.0], 0), (8, [1.0, 0.0], None), (9, [], 0),
            (None, [1.0, 0.0], 0), (10, [1.0, 0.0, 0.0], 0), (11, [1.0, -0.0], 0), (12, [1.0, 0.0], 1)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    got = [(r.vec_id, r.n_links, r.component_id, r.kept) for r in E.near_vectors(df).collect()]
    assert len(got) == len(rows)
    found = {r[0]: r[1:] for r in got}
    assert found[2] == (3, 1, False) and found[11] == (3, 1, False) and found[1] == (3, 1, True)
    assert all(found[i] == (0, i, True) for i in (3, 4, 5, 6, 7, 8, 9, 10, 12))
    assert found[None][0] == 0
    assert E.near_vectors(df.where("false")).count() == 0
