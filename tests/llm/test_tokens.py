import io
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from voltweave.llm import packing, token_files
from voltweave.llm.tokenize import Encoder, default_tokenizer

WHOLE = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
ENCODER = Encoder(default_tokenizer(), 50)


def whole(text, end):
    return WHOLE.encode(text or "", add_special_tokens=False).ids + [end]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.characters(exclude_categories=["Cs"]), max_size=60), max_size=4))
def test_words_give_the_ids_of_whole_texts(texts):
    ids, counts = ENCODER.encode(texts, 2)
    at = 0
    for t, n in zip(texts, counts):
        assert ids[at : at + n].tolist() == whole(t, 2)
        at += n


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("abzAZéÉßİıſŸÿłŁŒœnN̈̃'.,! 1", max_size=40), max_size=4))
def test_letters_and_marks(texts):
    test_words_give_the_ids_of_whole_texts.hypothesis.inner_test(texts)


def test_another_tokenizer_encodes_whole_texts():
    path = public_tokenizers.path("byte_bpe_50k.json")
    texts = ["Hello  world", "", None, " a b"]
    ids, counts = Encoder(path).encode(texts, 7)
    other = Tokenizer.from_file(path)
    assert ids.tolist() == [i for t in texts for i in [*other.encode(t or "", add_special_tokens=False).ids, 7]] and counts.sum() == len(ids)


def test_files_round_trip(make, odd):
    got = token_files.write_and_read(make(odd)).collect()
    assert len(got) == len(odd)
    got = sorted(got, key=lambda r: r.start)
    assert got[0].doc_id is None
    assert [r.doc_id for r in got[1:]] == sorted(r.doc_id for r in got[1:])
    want = sorted((str(d), len(ids := whole(t, 2)), crc(ids)) for d, t, *_ in odd)
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_crc32) for r in got) == want
    assert [r.start for r in got] == [0, *np.cumsum([r.n_tokens for r in got])[:-1]]


def test_empty_tables(make):
    assert token_files.write_and_read(make([]).filter("false")).count() == 0
    assert packing.pack(make([]).filter("false")).count() == 0


def test_frames_are_read_alone_and_checked():
    out = io.BytesIO()
    writer = token_files.Writer(out)
    docs = [(d, np.arange(n, dtype=np.uint32)) for d, n in zip([None, 1, 1, 5, 9, 12], [3, 60_000, 70_000, 0, 4, 65_000])]
    for d in docs:
        writer.add(*d)
    writer.close()
    data = out.getvalue()
    reader = token_files.Reader(io.BytesIO(data), len(data))
    assert len(reader.table) > 2
    for k, (d, ids) in enumerate(docs):
        got = reader.row(k)
        assert got[0] == d and np.array_equal(got[1], ids)
    assert [len(x) for x in reader.find(1)] == [60_000, 70_000] and [len(x) for x in reader.find(9)] == [4] and not reader.find(7)
    import zstandard

    assert zstandard.ZstdDecompressor().stream_reader(io.BytesIO(data), read_across_frames=True).read(64)
    broken = bytearray(data)
    broken[int(reader.offsets[1]) + 40] ^= 1
    with pytest.raises(Exception):
        token_files.Reader(io.BytesIO(bytes(broken)), len(data)).frame(1)


def check_packing(rows, docs):
    """Every id in exactly one piece; windows gapless and at most 2048."""
    pieces, windows = {}, {}
    for r in rows:
        pieces.setdefault(r.doc_id, []).append(r)
        windows.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for d, text in docs.items():
        ids, own = whole(text, 1), sorted(pieces.pop(d), key=lambda r: r.start)
        assert sum(r.length for r in own) == len(ids)
        at = 0
        for r in own:
            assert r.start == at and r.length > 0 and r.doc_tokens == len(ids)
            assert r.ids_crc32 == crc(ids[at : at + r.length])
            at += r.length
    assert not pieces
    used = padded = 0
    for w in windows.values():
        at = 0
        for offset, n in sorted(w):
            assert offset == at
            at += n
        assert at <= 2048
        used, padded = used + at, padded + (at if at & (at - 1) == 0 else 2048)
    return used / padded


def test_packing(make, odd):
    docs = {d: t for d, t, *_ in odd}
    unique = list({r[0]: r for r in odd}.values())
    assert check_packing(packing.pack(make(unique).coalesce(1)).collect(), docs) == 1
    assert packing.pack(make(odd)).filter("doc_id = 4 and start = 0").count() == 2


def test_packing_fills_windows(make):
    rng = np.random.default_rng(1)
    docs = {i: "the and " * int(rng.integers(1, 1500)) for i in range(300)}
    got = packing.pack(make(list(docs.items())).coalesce(1)).collect()
    assert check_packing(got, docs) > 0.97


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(1, 2047), min_size=1, max_size=60), st.integers(1, 8))
def test_differencing_keeps_all_pieces(sizes, k):
    windows = packing.difference(sizes, k)
    assert len(windows) == k and sorted(i for w in windows for i in w) == list(range(len(sizes)))
    sums = [sum(sizes[i] for i in w) for w in windows]
    assert max(sums) - min(sums) <= max(sizes)
