import math
import zlib
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from voltweave.llm import lm_score as lm


def tokens(text):
    return (text or "").encode().lower().split() + [None]


@settings(max_examples=80, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(max_size=30)), min_size=1, max_size=5))
def test_token_keys_tell_words_apart(texts):
    keys, counts = lm.token_keys(texts)
    flat = [w for t in texts for w in tokens(t)]
    assert counts.tolist() == [len(tokens(t)) for t in texts]
    assert len(set(keys.tolist())) == len(set(flat)) == len(set(zip(keys.tolist(), flat)))


def test_a_workers_tables_stay_small(monkeypatch):
    # Tables of a stretch's size stay with a worker, whatever is hashed; the keys are those of each text alone.
    monkeypatch.setattr(lm, "_powers", [])
    texts = [f"Some words {i} " * 200 for i in range(1500)] + [None, "one long text " * 60_000, "", "the last"]
    keys, counts = lm.token_keys(texts)
    assert sum(x.nbytes for x in lm._powers) <= 32 * lm.HASH_BYTES
    alone = [lm.token_keys([t]) for t in texts]
    assert np.array_equal(keys, np.concatenate([k for k, _ in alone])) and np.array_equal(counts, np.concatenate([n for _, n in alone]))


def test_heaps_settle_before_scoring(make, monkeypatch):
    steps, learn = [], lm.learn
    monkeypatch.setattr(lm, "settle", lambda spark: steps.append("settle"))
    monkeypatch.setattr(lm, "learn", lambda *a: (steps.append("learn"), learn(*a))[1])
    lm.score(make(corpus()))
    assert steps == ["settle", "learn", "settle"]


def test_numbers_round_trip():
    x = np.sort(np.random.default_rng(1).integers(0, 2**62, 1000, dtype=np.uint64))
    assert np.array_equal(lm.grow_sorted(lm.shrink_sorted(x)), x) and len(lm.grow(lm.shrink(x[:0]))) == 0


def corpus():
    rng = np.random.default_rng(4)
    vocab = [f"w{i}" for i in range(40)]
    docs = []
    for i in range(200):
        at, out = int(rng.integers(40)), []
        for _ in range(int(rng.integers(0, 60))):
            out.append(vocab[at] if rng.random() > 0.02 else f"rare{rng.integers(1000)}")
            at = (at * 3 + int(rng.integers(2))) % 40
        docs.append((i, " ".join(out)))
    return docs + [(300, None), (301, ""), (300, None), (None, "W1 w2"), (302, "Ünder w1 " * 500)]


def test_against_brute_force(make, monkeypatch):
    monkeypatch.setattr(lm, "PART_TOKENS", 2000)
    monkeypatch.setattr(lm, "CHUNK_BYTES", 3000)
    docs = corpus()
    fold = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 7
    one, two, context, tuning = Counter(), Counter(), Counter(), []
    for d, t in docs:
        if fold(d) != 2:
            w = tokens(t)
            one.update(w)
            two.update(zip(["^"] + w, w))
            context.update((["^"] + w)[:-1])
            if fold(d) == 3:
                tuning += list(zip(["^"] + w, w))
    n, v = sum(one.values()), len(one)
    bucket = lambda c: math.frexp(c)[1]
    weights = {}
    monkeypatch.setattr(lm, "SETTLED", 0)
    monkeypatch.setattr(lm, "ROUNDS", 12)
    for _ in range(lm.ROUNDS):
        sums = {}
        for a, b in tuning:
            cc, c2, c1 = context[a] - 1, two[a, b] - 1, one[b] - 1
            w = weights.get(bucket(cc), (1 / 3,) * 3)
            parts = [w[0] * (c2 / cc if cc else 0), w[1] * c1 / (n - 1), w[2] / (v + 1)]
            s = sums.setdefault(bucket(cc), [1e-3] * 3)
            for k in range(3):
                s[k] += parts[k] / sum(parts)
        weights = {k: [x / sum(s) for x in s] for k, s in sums.items()}
    got = {}
    rows = lm.score(make(docs)).collect()
    assert len(rows) == len(docs)
    for r in rows:
        got[r.doc_id] = r
    for d, t in docs:
        w, r = tokens(t), got[d]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (fold(d) == 2, len(w), sum(one[x] > 0 for x in w), n)
        assert math.isclose(r.base_score, sum(math.log10((one[x] + 1) / (n + v + 1)) for x in w), rel_tol=1e-9)
        want = 0.0
        for a, b in zip(["^"] + w, w):
            l2, l1, l0 = weights.get(bucket(context[a]), (1 / 3,) * 3)
            if not context[a]:
                l2, l1, l0 = 0, l1 / (l1 + l0), l0 / (l1 + l0)
            want += math.log10(l2 * (two[a, b] / context[a] if context[a] else 0) + l1 * one[b] / n + l0 / (v + 1))
        assert math.isclose(r.score, want, rel_tol=1e-6, abs_tol=1e-9), (d, r.score, want)
    held = [r for r in rows if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_probabilities_sum_to_one(spark):
    counts = spark.createDataFrame([(3, 5, 2, 7, 5), (3, 5, 0, 3, 9), (0, 0, 0, 4, 2)], "b int, cc long, c2 long, c1 long, times long")
    weights = lm.learn(counts, 100, 1e-4)
    assert np.allclose(weights.sum(axis=1), 1) and weights[0, 0] == 0 and (weights >= 0).all()


def test_small_and_empty(make, odd):
    assert lm.score(make([]).filter("false")).count() == 0
    rows = lm.score(make(odd)).collect()
    assert len(rows) == len(odd) and all(math.isfinite(r.score) for r in rows)
    alone = make([(i, "a b") for i in range(30) if zlib.crc32(str(i).encode()) % 7 == 2])
    assert {r.train_tokens for r in lm.score(alone).collect()} == {0}
