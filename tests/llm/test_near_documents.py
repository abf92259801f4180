import numpy as np
import pytest

import corpus_pipeline
from voltweave.llm import near_documents as nd


def shingles(text):
    w = (text or "").encode().lower().split()
    return {b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def kept(docs):
    """Smallest id of each component, by all pairs."""
    sets, root = {d: shingles(t) for d, t in docs}, {d: d for d, _ in docs}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return sorted({find(d) for d in sets})


@pytest.fixture
def docs():
    rng = np.random.default_rng(3)
    words = np.array([f"w{i}" for i in range(2000)])
    out = []
    for n in (100, 100, 300, 1000) * 5:
        base = rng.choice(words, n)
        out.append(base)
        for changed in (1, 2, 3, 5, 8):
            other = base.copy()
            other[rng.choice(n, changed, replace=False)] = "changed"
            out.append(other)
    passage = rng.choice(words, 60)  # shared by texts that don't match
    out += [np.concatenate([passage, rng.choice(words, 60)]) for _ in range(20)]
    chain = rng.choice(words, 200)
    out += [chain[k : k + 100] for k in range(0, 100, 9)]  # neighbours match, the ends don't
    texts = [" ".join(x) for x in out]
    texts += [None, "", " \n ", "three words here", "Three  words\nhere", texts[0].replace(" ", "\n")]
    return [(i, t) for i, t in enumerate(texts)]


@pytest.mark.parametrize("bits", [20, 6])
def test_the_stage_against_all_pairs(spark, make, docs, monkeypatch, bits):
    monkeypatch.setattr(nd, "COUNT_BITS", bits)
    want = kept(docs)
    got = corpus_pipeline.drop_near_duplicates(spark, make(docs), "")
    assert sorted(r.doc_id for r in got.collect()) == want and len(want) < len(docs) - 60
    assert got.columns == ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.mark.parametrize("bits", [27, 15])
def test_only_shared_tokens_are_exchanged_again(spark, make, docs, monkeypatch, bits):
    monkeypatch.setattr(nd, "MAP_BITS", bits)
    rng = np.random.default_rng(9)
    lists = [[int(x) for x in rng.integers(-(1 << 63), 1 << 63, n)] for n in (0, 1, 400, 3000, 700, 0)]
    prints = spark.createDataFrame([(i, len(x), x) for i, x in enumerate(lists)], "node long, n int, tokens array<long>").coalesce(1)
    shared = sorted({t for x in lists for t in x[::20]})
    got = nd._sifted(prints, spark.createDataFrame([(t, 0) for t in shared], "token long, least long")).collect()
    pairs = {(r.node, r.n, r.token) for r in got}
    want = {(i, len(x), t) for i, x in enumerate(lists) for t in x if t in set(shared)}
    assert want <= pairs <= {(i, len(x), t) for i, x in enumerate(lists) for t in x}
    assert len(got) == len(pairs) < len(want) * 1.8
    monkeypatch.setattr(nd, "BROADCAST_TOKENS", 0)
    assert sorted(r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, make(docs), "").collect()) == kept(docs)


def test_counts_are_of_all_texts(make, docs):
    got = nd.token_counts(make(docs).select("text"))
    tokens = np.concatenate([nd.token_set(t) for _, t in docs])
    assert np.array_equal(got, np.bincount((tokens >> np.uint64(64 - nd.COUNT_BITS)).astype(int), minlength=1 << nd.COUNT_BITS))


def test_clean_rows_stay(spark, make):
    # A null id and null text beside the id that is the hash of null; one id with different texts; reruns agree.
    words = [f"w{i}" for i in range(400)]
    rows = [(42, " ".join(words[:80])), (None, None), (5, " ".join(words[100:180])), (5, " ".join(words[200:280])), (6, " ".join(words[300:380])), (7, " ".join(words[301:380]))]
    want = sorted([(42, rows[0][1]), (None, None), (5, rows[2][1]), (5, rows[3][1]), (6, rows[4][1])], key=str)
    for some in (rows, rows[::-1]):
        assert sorted(((r.doc_id, r.text) for r in corpus_pipeline.drop_near_duplicates(spark, make(some), "").collect()), key=str) == want


def test_rows_of_one_id(spark, make):
    rows = [(1, "one two three four five six"), (1, "other words that are not like it"), (1, "one two three four five six"), (None, "one two three four five six"), (None, "a text of a row without id"), (None, "another one of these")]
    got = corpus_pipeline.drop_near_duplicates(spark, make(rows), "").collect()
    assert sorted((str(r.doc_id), r.text) for r in got) == sorted((str(d), t) for d, t in [rows[0], rows[1], rows[4], rows[5]])
    assert nd.keep_first(make([]).filter("false")).count() == 0
