import duckdb
import pytest

from voltweave.llm import mixing


def sized(n, seed=1):
    import random

    rng = random.Random(seed)
    return [(i, "w " * rng.randint(1, 60), "en", rng.choice(["a", "a", "a", "b", "c", "dd", None])) for i in range(n)]


def oracle(rows):
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, source VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?)", [((r + (None,) * 4)[0], (r + (None,) * 4)[1], (r + (None,) * 4)[3]) for r in rows])
    return con.execute(f"SELECT doc_id, size, source_size, target, taken FROM ({mixing.ORACLE})").fetchall()


def plain(rows):
    return sorted(tuple(map(str, r)) for r in rows)


def test_against_sql_and_targets(make):
    rows = sized(700)
    got = mixing.mix(make(rows)).collect()
    assert plain(got) == plain(oracle(rows))
    total, by = 0, {}
    source = {r[0]: r[3] for r in rows}
    for r in got:
        assert r.taken in (0, r.size, 2 * r.size)
        t = by.setdefault(source[r.doc_id], [0, r.target, 0])
        t[0], t[2], total = t[0] + r.taken, max(t[2], r.size), total + r.size
    assert sum(t[1] for t in by.values()) == pytest.approx(1.5 * total)
    assert all(abs(taken - target) <= largest for taken, target, largest in by.values())
    assert plain(mixing.mix(make(rows[::-1])).collect()) == plain(got)


def test_targets_stop_and_share_again(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 0), (None, 500)], "source string, source_size long")
    got = {r.source: r.target for r in mixing.targets(sizes).collect()}
    # 1.5 * 1510 = 2265; a stops at 20, c at 0; b : null = 2 : 5, null stops at 1000, b takes the rest
    assert got == {"a": 20.0, "c": 0.0, None: 1000.0, "b": 1245.0}


def test_odd_rows_and_documents_of_the_mix(make, odd):
    frame = make(odd)
    got = mixing.mix(frame).collect()
    assert len(got) == len(odd) and plain(got) == plain(oracle(odd))
    rows = sized(200, 4)
    frame = make(rows)
    mix = mixing.Mix(frame)
    copies = mix.apply(frame)
    assert copies.columns == frame.columns
    want = {r.doc_id: r.taken // r.size for r in mix.taken().collect()}
    seen = {}
    for r in copies.collect():
        seen[r.doc_id] = seen.get(r.doc_id, 0) + 1
    assert seen == {d: n for d, n in want.items() if n}
    assert mixing.mix(frame.filter("false")).count() == 0
    assert mixing.Mix(frame.filter("false")).apply(frame.filter("false")).count() == 0
