import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from voltweave.llm import language_id as li

WORDS = {"aa": "the of and ing tion er on".split(), "bb": "der die und ung schön lich ge".split(), "cc": "que los está ción para el ñandú".split()}


def corpus(n):
    rng = random.Random(3)
    out = []
    for i in range(n):
        lang = rng.choice(list(WORDS))
        out.append((i, " ".join("".join(rng.choices(WORDS[lang], k=rng.randint(1, 3))) for _ in range(rng.randint(8, 40))), lang))
    return out


def test_held_out_accuracy(make):
    docs = corpus(300)
    frame = make(docs)
    model = li.fit(frame.filter(~li.held_out(3, 1)))
    got = {r.doc_id: r for r in li.identify(frame, model).collect()}
    assert len(got) == 300
    test = [(i, lang) for i, _, lang in docs if zlib.crc32(str(i).encode()) % 3 == 1]
    assert sum(got[i].lang_pred == lang for i, lang in test) >= 0.98 * len(test)
    assert all(0 <= r.score <= 1 for r in got.values())


def test_bounded_sample_learns_as_well(make):
    frame = make(corpus(600))
    model = li.fit(frame, train_docs=40)
    got = li.identify(frame, model).join(frame.select("doc_id", "lang"), "doc_id").filter("lang <=> lang_pred").count()
    assert got > 590


def test_odd_rows(make, odd):
    frame = make(odd)
    model = li.fit(frame)
    got = li.identify(frame, model).collect()
    assert len(got) == len(odd)
    by = {r.doc_id: r for r in got}
    for d in (1, 2, 3, 7):
        assert (by[d].lang_pred, by[d].score) == ("und", 0.0)
    assert by[4].lang_pred in ("en", "fr")


def test_nothing_to_learn(make):
    frame = make([(1, "words", None), (2, None, "en")])
    model = li.fit(frame)
    assert {r.lang_pred for r in li.identify(frame, model).collect()} == {"und"}
    assert li.identify(frame.filter("false"), model).count() == 0


@pytest.mark.parametrize("fit_at_once", [10, 2, 1])
def test_against_plain_naive_bayes(make, fit_at_once):
    docs = corpus(150) + [(500, "zz", "aa"), (501, "", "bb"), (502, "los que der the", "cc"), (502, "los que der the", "cc")]
    frame = make(docs)
    model = li.fit(frame, matrix_bytes=fit_at_once * li.BUCKETS * 4)
    assert model.languages == 3 and model.block == fit_at_once
    # The same sample and buckets, counted and added up one by one.
    tuning = {r.doc_id for r in frame.filter("pmod(xxhash64(1, coalesce(cast(doc_id as string), '')), 10) = 0").collect()}
    assert 0 < len(tuning) < 60
    names = sorted({d[2] for d in docs})
    counts = {x: Counter() for x in names}
    for i, text, lang in docs:
        if i not in tuning:
            counts[lang].update(li.grams([text], li.BUCKETS)[0].tolist())
    prior = {x: math.log(sum(d[2] == x for d in docs) / len(docs)) for x in names}

    def means(text):
        g = li.grams([text], li.BUCKETS)[0].tolist()
        total = {x: sum(counts[x].values()) + li.BUCKETS for x in names}
        return len(g), {x: (prior[x] + sum(math.log((counts[x][b] + 1) / total[x]) for b in g)) / max(1, len(g)) for x in names}

    loss = [sum(math.log(sum(math.exp(v / t) for v in m.values())) - m[lang] / t for i, text, lang in docs if i in tuning for n, m in [means(text)] if n) for t in li.TEMPERATURES]
    assert model.temperature == pytest.approx(li.TEMPERATURES[int(np.argmin(loss))])
    got = {r.doc_id: r for r in li.identify(frame, model).collect()}
    for i, text, _ in docs:
        n, m = means(text)
        best = max(names, key=lambda x: m[x])
        if not n:
            assert (got[i].lang_pred, got[i].score) == ("und", 0.0)
            continue
        share = 1 / sum(math.exp((v - m[best]) / model.temperature) for v in m.values())
        assert got[i].lang_pred == best and got[i].score == pytest.approx(share, rel=1e-3), (text, got[i])


def test_grams_are_told_apart():
    texts = ["Ab c", "abc", "", "x1y", "é"]
    hashed, owner, letters = li.grams(texts, li.BUCKETS)
    assert letters.tolist() == [True, True, False, True, True]
    seen = {}
    for k, text in enumerate(texts):
        padded = "".join(c if c.isalpha() else " " for c in text.lower()) + " "
        want = Counter()
        for n in (1, 2, 3):
            for at in range(len(padded) - n + 1):
                part = padded[at : at + n]
                if n == 1 and part == " " or "  " in part or not part.strip():
                    continue
                want[part] += 1
        assert (owner == k).sum() == sum(want.values()), text
        seen[k] = want
    assert len(set(hashed.tolist())) == len(set().union(*seen.values()))


def test_filter_keeps_columns(make):
    mixed = "the der que of die los and und"
    frame = make(corpus(60) + [(1000, "123 !!", "aa"), (1001, None, "aa"), (1002, "der die und schön lich", None), (1003, "der die und schön lich", "cc")])
    got = li.keep_identified(frame)
    rows = {r.doc_id: r.lang for r in got.collect()}
    assert got.schema == frame.schema and len(rows) == 62 and not {1000, 1001} & set(rows)
    assert rows[1002] == rows[1003] == "bb"
    doubtful = make(corpus(300) + [(1000, mixed, None)])
    scores = {r.doc_id: r.score for r in li.identify(doubtful, li.fit(doubtful.filter(~li.held_out(3, 1)))).collect()}
    assert scores[1000] == min(scores.values()) and {r.doc_id for r in li.keep_identified(doubtful, scores[1000] + 1e-9).collect()} == set(range(300))
    assert li.keep_identified(make([(1, "words", None)])).count() == 0
