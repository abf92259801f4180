import numpy as np
import pytest

from voltweave.llm import embedding_dedup as ed


def brute(rows, threshold=0.9):
    ok = {}
    for k, (i, v) in enumerate(rows):
        if v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            ok[k] = np.array(v, np.float32).astype(float)
    links = {k: set() for k in range(len(rows))}
    for a in ok:
        for b in ok:
            if a != b and len(ok[a]) == len(ok[b]) and ok[a] @ ok[b] / np.sqrt((ok[a] @ ok[a]) * (ok[b] @ ok[b])) >= threshold:
                links[a].add(b)
    out = []
    for k, (i, v) in enumerate(rows):
        seen, todo = {k}, [k]
        while todo:
            for x in links[todo.pop()] - seen:
                seen.add(x)
                todo.append(x)
        ids = [rows[x][0] for x in seen if rows[x][0] is not None]
        least = min(ids) if ids else None
        out.append((i, len(links[k]), least, i == least))
    return sorted(map(str, out))


@pytest.fixture
def rows():
    rng = np.random.default_rng(2)
    base = rng.normal(size=(12, 16))
    out = [(i, (base[i % 12] + rng.normal(size=16) * rng.choice([0.05, 0.3, 0.5])).astype(np.float32).tolist()) for i in range(150)]
    out += [(200 + i, out[3][1]) for i in range(5)] + [(3, out[3][1]), (400, None), (401, []), (402, [0.0] * 16), (403, [float("nan")] * 16), (404, [None] + [1.0] * 15), (405, [float("inf")] * 16), (None, out[7][1]), (406, out[7][1][:8]), (407, [x * 2 for x in out[5][1]])]
    return out


@pytest.mark.parametrize("block", [20, 40, 2048])
def test_against_brute_force(spark, rows, block):
    frame = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<float>, n long, label string")
    got = ed.near_duplicates(frame, block).collect()
    assert sorted(str(tuple(r)) for r in got) == brute(rows)


def test_empty_table(spark):
    assert ed.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_bounds_hold():
    rng = np.random.default_rng(3)
    a, b = rng.normal(size=(60, 33)) ** 3, rng.normal(size=(70, 33))
    (qa, sa, ea), (qb, sb, eb) = ed.quantise(a), ed.quantise(b)
    true = (a @ b.T) / np.linalg.norm(a, axis=1)[:, None] / np.linalg.norm(b, axis=1)[None, :]
    margin = ea[:, None] + (1 + ea[:, None]) * eb[None, :] + 1e-9
    assert qa.dtype == np.int8 and (np.abs(true - ed.code_products(qa, qb) * sa[:, None] * sb[None, :]) <= margin).all()
    wide = rng.normal(size=(5, 3000))
    q = ed.quantise(wide)[0]
    assert np.array_equal(ed.code_products(q, q), (q.astype(np.int64) @ q.astype(np.int64).T).astype(float))
    i, j, sure = ed.bounded(ed.quantise(a), ed.quantise(a), True, 0.3)
    true = (a @ a.T) / np.linalg.norm(a, axis=1)[:, None] / np.linalg.norm(a, axis=1)[None, :]
    want = {(x, y) for x, y in zip(*np.nonzero(true >= 0.3)) if x < y}
    assert want <= set(zip(i, j)) and set(zip(i[sure], j[sure])) <= want and 0 < (~sure).sum() < len(want)


def test_doubles_of_any_magnitude(spark):
    v = [[1e-200, 1e-200], [1e-200, 2e-200], [1e200, 1e200], [2e200, 2.1e200], [-1e300, 1e-300], [-5e-324, 0.0]]
    got = ed.near_duplicates(spark.createDataFrame(list(enumerate(v)), "vec_id long, embedding array<double>")).collect()
    assert {r.vec_id: (r.n_links, r.component_id) for r in got} == {0: (3, 0), 1: (3, 0), 2: (3, 0), 3: (3, 0), 4: (1, 4), 5: (1, 4)}


def test_long_vectors_near_the_threshold(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=2500)
    rows = []
    for k, c in enumerate(np.linspace(0.897, 0.903, 40)):
        y = rng.normal(size=2500)
        y -= x * (x @ y) / (x @ x)
        rows.append((k + 1, (c * x / np.linalg.norm(x) + np.sqrt(1 - c * c) * y / np.linalg.norm(y)).tolist()))
    rows.append((0, x.tolist()))
    got = {r.vec_id: r.n_links for r in ed.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 16).collect()}
    m = np.array([r[1] for r in rows])
    cos = (m @ m.T) / np.linalg.norm(m, axis=1)[:, None] / np.linalg.norm(m, axis=1)[None, :]
    assert got == {r[0]: int((c >= 0.9).sum() - 1) for r, c in zip(rows, cos)}
