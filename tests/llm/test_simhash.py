import numpy as np
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from voltweave.llm import simhash


def plain(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hs = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def components(prints):
    """doc_id -> smallest reachable, by brute force."""
    ids = list(prints)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in ids:
        for b in ids:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= 3:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in ids}


@given(st.lists(st.integers(0, 63), max_size=3, unique=True), st.integers(0, 2**64 - 1))
def test_every_pair_within_the_radius_collides(bits, fp):
    other = fp
    for b in bits:
        other ^= 1 << b
    tables = [k for k, m in enumerate(simhash.TABLES) if fp & m == other & m]
    assert tables
    for k in tables:
        assert any(fp & m == other & m for m in simhash.DEEPER[k])
        assert all((m | simhash.TABLES[k]).bit_count() >= 48 for m in simhash.DEEPER[k])


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(max_size=40), max_size=5))
def test_fingerprints(texts):
    found = [simhash.shingle_hashes(t) for t in texts]
    counts = np.array([len(f) for f in found], np.int64)
    got = simhash.majority(np.array([h for f in found for h in f], np.uint64), counts, step=3)
    assert got.tolist() == [plain(t) for t in texts]


def test_documents(make, odd):
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa".split()
    rng = np.random.default_rng(5)
    long = [" ".join(rng.choice(words, 300)) + f" {i}" for i in range(6)]
    near = [long[0].replace("alpha", "alphas", 1), long[1] + " tail"]
    docs = odd[:3] + odd[4:] + [(20 + i, t) for i, t in enumerate(long + near + long[:2])]
    got = simhash.near_duplicates(make(docs)).collect()
    assert len(got) == len(docs)
    prints = {d: plain(t) for d, t, *_ in docs}
    want = components(prints)
    for r in got:
        assert r.fingerprint == f"{prints[r.doc_id]:016x}" and r.component_id == want[r.doc_id]


def test_null_ids_and_empty_table(make):
    frame = make([(None, "one two three four"), (None, "one two three four"), (None, "quite different words in here")])
    assert {r.component_id for r in simhash.near_duplicates(frame).collect()} == {None}
    assert simhash.near_duplicates(make([]).filter("false")).count() == 0


def test_hot_buckets_lose_nothing(spark):
    rng = np.random.default_rng(7)
    base = int(rng.integers(0, 2**63))
    fps = {base}
    while len(fps) < 300:
        fp = base
        for b in rng.choice(64, rng.integers(1, 7), replace=False):
            fp ^= 1 << int(b)
        fps.add(fp)
    fps |= {int(x) for x in rng.integers(0, 2**63, 200)}
    signed = [f - 2**64 if f >> 63 else f for f in fps]
    frame = spark.createDataFrame([(f,) for f in signed], "fp long")
    want = components(dict(zip(signed, [f % 2**64 for f in signed])))
    for bucket in (8, 4096):
        labels = {r.node: r.label for r in simhash.connected(simhash.links(frame, bucket)).collect()}
        groups, truth = {}, {}
        for f in signed:
            groups.setdefault(labels.get(f, f), set()).add(f)
            truth.setdefault(want[f], set()).add(f)
        assert sorted(map(sorted, groups.values())) == sorted(map(sorted, truth.values()))
