"""The pipeline's rows against plain versions of its stages, each on what the stage before kept."""

import os
import random

import numpy as np
import pytest

import corpus_pipeline
from voltweave.llm import language_id
from test_language_id import WORDS
from test_line_dedup import brute
from test_mixing import oracle
from test_simhash import components, plain
from test_tokens import check_packing

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs():
    rng = random.Random(11)
    made = []

    def line(lang, n=None):
        return " ".join("".join(rng.choices(WORDS[lang], k=rng.randint(1, 3))) for _ in range(n or rng.randint(4, 40)))

    shared = line("aa", 55)
    for i in range(160):
        lang = rng.choice(list(WORDS))
        text = "\n".join(line(lang) for _ in range(rng.randint(1, 6)))
        if i % 9 == 0:
            text += "\n" + shared
        made.append((i, text, lang, rng.choice(["a", "a", "b", "c", None])))
    made += [(200 + i, made[i][1], made[i][2], "a") for i in range(8)]  # copies
    made += [(300 + i, made[i][1] + " addedword", made[i][2], "b") for i in range(8)]  # near copies
    made += [(400, None, None, "a"), (401, "", "aa", "a"), (402, "12 34 !!", "bb", "b")]
    return [(*r, len(r[1] or "")) for r in made]


def test_each_stage(spark, docs, tmp_path):
    folder = str(tmp_path / "sf")
    os.mkdir(folder)
    spark.createDataFrame(docs, SCHEMA).write.parquet(f"{folder}/documents.parquet")
    frame = spark.read.parquet(f"{folder}/documents.parquet")
    kept = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        frame = stage(spark, frame, folder)
        frame.write.parquet(f"{folder}/{k}.parquet")
        frame = spark.read.parquet(f"{folder}/{k}.parquet")
        kept.append([tuple(r) for r in frame.collect()])
        assert k == 4 or frame.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    # 1: what has no letters goes, the rest stays as it is but for its language
    first = spark.read.parquet(f"{folder}/documents.parquet")
    told = {r.doc_id: r.lang_pred for r in language_id.identify(first, language_id.fit(first.filter(~language_id.held_out(3, 1)))).collect()}
    want = [(d[0], d[1], told[d[0]], *d[3:]) for d in docs if d[0] not in (400, 401, 402)]
    assert sum(told[d[0]] == d[2] for d in docs) >= len(docs) - 6
    assert sorted(kept[0], key=str) == sorted(want, key=str)
    # 2: lines that match an earlier one go, and documents left without any
    gone = brute([d[:2] for d in kept[0]])
    want = []
    for d in kept[0]:
        lines = [x for k, x in enumerate(d[1].split("\n")) if k not in gone[d[0]]]
        if lines:
            want.append((d[0], "\n".join(lines), d[2], d[3], len("\n".join(lines))))
    assert sorted(kept[1], key=str) == sorted(want, key=str)
    assert not {200, 201, 202} & {d[0] for d in kept[1]}
    # 3: one document of each group
    least = components({d[0]: plain(d[1]) for d in kept[1]})
    assert sorted(kept[2], key=str) == sorted((d for d in kept[1] if least[d[0]] == d[0]), key=str)
    # 4: as often as the mix takes them
    times = {r[0]: r[4] // r[1] for r in oracle([d[:4] for d in kept[2]]) if r[1]}
    assert sorted(kept[3], key=str) == sorted((d for d in kept[2] for _ in range(times[d[0]])), key=str)
    assert sum(times.values()) > len(kept[2])
    # 5: every token of every copy in one piece
    pieces = frame.collect()
    copies = {}
    for d in kept[3]:
        copies.setdefault(d[0], []).append(d[1])
    for d, texts in copies.items():
        own = [r for r in pieces if r.doc_id == d]
        assert sum(r.length for r in own) == len(texts) * own[0].doc_tokens
    once = [r for r in pieces if len(copies[r.doc_id]) == 1]
    assert once and {r.doc_id for r in pieces} == set(copies)
    # run() does the same
    again = corpus_pipeline.run(spark, folder).collect()
    total = lambda rows: sorted((r.doc_id, r.start, r.length, r.ids_crc32) for r in rows if r.start == 0 and len(copies[r.doc_id]) == 1)
    assert {r[0] for r in total(again)} == {r[0] for r in total(pieces)}
    assert np.sum([r.length for r in again]) == np.sum([r.length for r in pieces])


def test_unique_documents_are_packed_whole(spark, docs):
    unique = [d for d in docs if d[0] < 160]
    got = corpus_pipeline.pack_windows(spark, spark.createDataFrame(unique, SCHEMA).coalesce(1), "").collect()
    assert check_packing(got, {d[0]: d[1] for d in unique}) > 0.95


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_rows_that_ids_and_labels_say_nothing_of(spark, docs):
    """Null and repeated ids, null labels: clean rows of different texts stay through the filtering stages."""
    own = [d for d in docs if d[0] < 60]
    texts = [" ".join(x) for x in (WORDS["aa"] * 5, WORDS["bb"] * 5, WORDS["cc"] * 5, WORDS["aa"][::-1] * 6, WORDS["bb"][::-1] * 6)]
    odd = [(None, texts[0], "aa", "a"), (None, texts[1], None, None), (7, texts[2], "cc", "b"), (7, texts[3], None, "b"), (8, texts[4], "cc", None), (8, texts[4], "cc", None)]
    frame = spark.createDataFrame([*own, *((*r, len(r[1])) for r in odd)], SCHEMA)
    for _, stage in corpus_pipeline.STAGES[:3]:
        frame = stage(spark, frame, "")
        left = [(r.doc_id, r.text) for r in frame.collect()]
        assert {(d[0], d[1]) for d in odd} <= set(left)
    assert left.count((8, texts[4])) == 1
    assert {r.lang for r in frame.filter("text is not null").collect()} == {"aa", "bb", "cc"}


def test_executors_give_back_memory(spark, make, monkeypatch):
    import gc

    from voltweave.llm import common

    runtime, arrays = spark._jvm.java.lang.Runtime.getRuntime(), spark.sparkContext._gateway
    garbage = arrays.new_array(spark._jvm.byte, 150_000_000)
    before = runtime.totalMemory() - runtime.freeMemory()
    del garbage
    gc.collect()
    common.settle(spark)
    assert runtime.totalMemory() - runtime.freeMemory() < before - 100_000_000
    # Stages that run Python do so first.
    calls = []
    monkeypatch.setattr(corpus_pipeline, "settle", lambda s: calls.append(s))
    docs = make([(1, "some words of a text that is here", "en", "a")])
    for name, function in corpus_pipeline.STAGES:
        calls.clear()
        function(spark, docs, "")
        assert bool(calls) == (name in ("language id", "simhash near-dedup", "packing")), name


def test_language_id_holds_little_at_once():
    import tracemalloc

    from voltweave.llm import language_id

    text = "some plain words of no great length " * (language_id.BATCH_BYTES // 36)
    language_id.grams(["warm"], language_id.BUCKETS)
    tracemalloc.start()
    language_id.grams([text], language_id.BUCKETS)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40e6
