import duckdb
import numpy as np
import pytest

from voltweave.llm import line_dedup as ld


def tokens(line):
    w = line.lower().replace("\t", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ")
    w = [x for x in w if x]
    if len(w) < 5:
        return {tuple(w)} if w else None
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def brute(docs):
    """doc_id -> numbers of removed lines."""
    seen, out = [], {}
    for d, text in sorted(docs, key=lambda r: (r[0] is not None, r[0] or 0)):
        out[d] = []
        for k, line in enumerate(text.split("\n") if text is not None else []):
            t = tokens(line)
            if t is None:
                continue
            if any(len(t & s) * 5 >= 4 * len(t | s) for s in seen):
                out[d].append(k)
            seen.append(t)
    return out


@pytest.fixture
def docs():
    rng = np.random.default_rng(8)
    words = [f"word{i}" for i in range(300)] + ["the", "of", "and"] * 40
    lines = [" ".join(rng.choice(words, rng.integers(1, 60))) for _ in range(40)]

    def near(line):
        w = line.split()
        for _ in range(int(rng.integers(0, 4))):
            w[int(rng.integers(len(w)))] = str(rng.choice(words))
        return " ".join(w)

    out = [(i, "\n".join(near(lines[j]) if rng.random() < 0.7 else lines[j] for j in rng.choice(40, rng.integers(1, 9)))) for i in range(120)]
    hot = "a very long line that many documents hold " + " ".join(lines[0].split() + lines[1].split()[:20])
    out += [(200 + i, f"{hot} ending {i}\nshort\n\nown {i} " + " ".join(rng.choice(words, 30))) for i in range(40)]
    return out + [(500, None), (501, ""), (502, "\n\n"), (None, "first of all come the null ones"), (503, "First  of all come\tthe null ones")]


def test_against_brute_force(make, docs):
    want = brute(docs)
    dedup = ld.LineDedup(make(docs))
    got = {r.doc_id: r for r in dedup.report().collect()}
    assert len(got) == len(docs)
    for d, text in docs:
        r = got[d]
        assert r.removed == ",".join(map(str, want[d])) and r.n_removed == len(want[d]), d
        assert r.n_lines == (0 if text is None else text.count("\n") + 1)
    kept = {r.doc_id: r for r in dedup.apply(make(docs)).collect()}
    for d, text in docs:
        rest = None if text is None else [x for k, x in enumerate(text.split("\n")) if k not in want[d]]
        if rest == []:
            assert d not in kept
        else:
            assert kept[d].text == (None if rest is None else "\n".join(rest)) and kept[d].n_chars == len(kept[d].text or "")
    assert dedup.apply(make(docs)).schema == make(docs).schema


def test_against_sql(make, docs):
    some = [d for d in docs if d[0] is not None]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", [list(d) for d in some])
    want = sorted(con.execute(f"SELECT doc_id, n_lines, n_removed, removed FROM ({ld.ORACLE})").fetchall())
    assert sorted(map(tuple, ld.LineDedup(make(some)).report().collect())) == want


def test_shuffled_texts_take_the_other_way(make, docs, monkeypatch):
    dedup = ld.LineDedup(make(docs))
    small = sorted(map(str, dedup.apply(make(docs)).collect()))
    monkeypatch.setattr(ld, "BROADCAST_IDS", 0)
    again = ld.LineDedup(make(docs))
    assert sorted(map(str, again.apply(make(docs)).collect())) == small
    assert sorted(map(str, again.report().collect())) == sorted(map(str, dedup.report().collect()))


def test_odd_rows(make, odd):
    dedup = ld.LineDedup(make(odd))
    assert dedup.report().count() == len({r[0] for r in odd})
    assert dedup.apply(make(odd)).count() == len(odd)
    empty = make([]).filter("false")
    assert ld.LineDedup(empty).report().count() == 0 and ld.LineDedup(empty).apply(empty).count() == 0


def test_rows_that_share_an_id(make):
    rng = np.random.default_rng(2)
    a, b, c, d, e = (" ".join(f"w{x}" for x in rng.integers(0, 5000, 20)) for _ in range(5))
    rows = [(None, f"{a}\n{b}"), (None, f"{c}\n{a}"), (None, f"{d}\n{e}"), (7, f"{b} tail"), (7, "a clean line of one row here"), (8, f"{d}\nown line of the row is this")]
    for twice in ([], rows[:2]):
        frame = make(rows + twice)
        dedup = ld.LineDedup(frame)
        want = [(None, f"{a}\n{b}"), (None, c), (None, f"{d}\n{e}"), (7, rows[4][1]), (8, "own line of the row is this")] + ([(None, f"{a}\n{b}"), (None, c)] if twice else [])
        assert sorted(((r.doc_id, r.text) for r in dedup.apply(frame).collect()), key=str) == sorted(want, key=str)


def test_lines_of_rows_at_one_place_meet_later_ones(make):
    # Both rows' lines hold the tokens of the later one; it matches the second only.
    words = [f"x{i}" for i in range(60)]
    rows = [(None, " ".join(words[:30] + ["p"] * 40)), (None, " ".join(words[:30])), (3, " ".join([*words[:30], "end"]))]
    for some in (rows, rows[::-1]):
        got = ld.LineDedup(make(some)).apply(make(some)).collect()
        assert sorted(str(r.doc_id) for r in got) == ["None", "None"]


def test_short_lines(spark, make):
    import corpus_pipeline

    rows = [(1, "All rights reserved.\n\nown words of the first text here\n \t"), (2, "all  rights reserved.\n\nand of the second text other words\nAll rights"), (3, "Yes\nYes"), (4, "yes"), (5, None), (6, "")]
    got = {r.doc_id: r.text for r in corpus_pipeline.drop_repeated_lines(spark, make(rows), "").collect()}
    assert got == {1: rows[0][1], 2: "\nand of the second text other words\nAll rights", 3: "Yes", 5: None, 6: ""}
    assert {r.doc_id: r.removed for r in ld.LineDedup(make(rows)).report().collect()} == {1: "", 2: "0", 3: "1", 4: "0", 5: "", 6: ""}


def test_repeated_words_and_the_prefix(make):
    # Lines of few different words, whose shingles begin with the same ones again and again.
    rng = np.random.default_rng(5)
    lines = [" ".join(rng.choice(["a", "b", "c", "d"], rng.integers(5, 40), p=[0.7, 0.2, 0.05, 0.05])) for _ in range(120)]
    lines += [x + " a" for x in lines[:40]] + ["a " * 30 + "b", "a " * 31]
    rows = [(i, x) for i, x in enumerate(lines)]
    want = brute(rows)
    got = {r.doc_id: r.removed for r in ld.LineDedup(make(rows)).report().collect()}
    assert got == {d: ",".join(map(str, w)) for d, w in want.items()}


def test_few_lines_are_candidates(make, monkeypatch):
    # Lines that share a phrase only are no candidates; those that match are.
    rng = np.random.default_rng(7)
    own = lambda n: [f"w{x}" for x in rng.integers(0, 100_000, n)]
    phrases = [own(5) for _ in range(60)]
    lines = [" ".join([*own(12), *phrases[i % 60], *own(13)]) for i in range(240)]
    rows = list(enumerate([*lines, *(x + " end" for x in lines[:10]), "a b c d e", "z a b c d e", "a b c d e f g h i", "b c d e f g h i"]))
    sizes, real = {}, ld.stage

    def stage(df, name):
        out = real(df, name)
        sizes.setdefault(name, out.count())
        return out

    monkeypatch.setattr(ld, "stage", stage)
    got = {r.doc_id: r.removed for r in ld.LineDedup(make(rows)).report().collect()}
    assert got == {d: ",".join(map(str, w)) for d, w in brute(rows).items()}
    assert 20 <= sizes["line-sets"] <= 30


def test_prefix_holds_the_smallest_tokens(make):
    rng = np.random.default_rng(4)
    lines = [" ".join(rng.choice(["a", "b", "c", "d", "e"], n)) for n in range(5, 70)] + ["a " * 40 + "b", "a b " * 30]
    table = make(list(enumerate(lines))).selectExpr("doc_id", "split(trim(text), ' ') w").withColumn("h", ld._hashes(ld.F.col("w")))
    for r in ld._tokens(ld._prefix(table)).collect():
        whole, n = sorted(r.tokens), len(r.tokens)
        least = n - -(-4 * n // 5) + min(ld.SHARED, -(-4 * n // 5))
        assert len(set(r.prefix)) == len(r.prefix) >= least and sorted(r.prefix) == whole[: len(r.prefix)]


def test_rounds_read_the_sets_of_open_lines_only(make, monkeypatch):
    # Lines put together from phrases of their own and common ones: most are no candidates of the rounds any more.
    rng = np.random.default_rng(9)
    own = lambda n: [f"w{x}" for x in rng.integers(0, 100_000, n)]
    phrases = [own(22) for _ in range(6)]
    lines = [" ".join([*own(12), *phrases[i % 6], *own(6)]) for i in range(60)]
    pool = [own(14) for _ in range(5)]
    lines += [" ".join(sum((pool[k] for k in rng.permutation(5)[:3]), [])) for _ in range(40)]
    sizes, real = {}, ld.stage

    def stage(df, name):
        out = real(df, name)
        sizes.setdefault(name, out.count())
        return out

    monkeypatch.setattr(ld, "stage", stage)
    rows = list(enumerate(lines))
    got = {r.doc_id: r.removed for r in ld.LineDedup(make(rows)).report().collect()}
    assert got == {d: ",".join(map(str, w)) for d, w in brute(rows).items()}
    assert 0 < sizes["line-open-sets"] <= sizes["line-sets"] / 2


def test_a_line_keeps_hashes_and_no_words(make):
    # Classes are told by the hashes of the words, so the words themselves are not carried from step to step.
    rows = [(1, "Some words\nsome  words \nsome words more\n\n \t"), (2, None), (3, "")]
    built = ld._words(ld._lines(make(rows).selectExpr("doc_id doc", "0L row", "text")))
    keys = [(r.k1, r.k2) for r in built.select("doc", "line", *ld._class(ld._word_hashes(ld.F.col("words")))).orderBy("doc", "line").collect()]
    assert keys[0] == keys[1] != keys[2] and keys[3] == keys[4] == keys[6] != keys[5]


def test_prefixes_are_written_once(make, docs, monkeypatch):
    # Only the table of lines holds prefixes; classes are found without them.
    written, real = [], ld.stage

    def stage(df, name):
        written.append((name, df.columns))
        return real(df, name)

    monkeypatch.setattr(ld, "stage", stage)
    ld.LineDedup(make(docs))
    assert [name for name, columns in written if "prefix" in columns] == ["lines"]


def test_hashes_do_not_depend_on_white_space(make):
    rows = list(enumerate(["a b c d e", " a b  c d e ", "a b\tc d e", "A B c\r\x0bd\x0ce\r", "  a b c d e", "", " \t", "b a c d e", None]))
    hashes = [r["all"] for r in ld._hashed(make(rows).selectExpr("doc_id", "text words")).orderBy("doc_id").collect()]
    assert all(h == hashes[0] and len(h) == 5 for h in hashes[:5])
    assert len(hashes[5]) == 1 and hashes[5] == hashes[6] and sorted(hashes[7]) == sorted(hashes[0]) and hashes[7] != hashes[0] and hashes[8] is None


def test_equal_rows_give_a_line_once(make, monkeypatch):
    words = [f"x{i}" for i in range(30)]
    rows = [(None, " ".join(words))] * 3 + [(3, " ".join([*words, "end"])), (3, "a line of its own that nothing matches")]
    later, real = [], ld.stage

    def stage(df, name):
        out = real(df, name)
        if name == "line-later":
            later.extend(out.collect())
        return out

    monkeypatch.setattr(ld, "stage", stage)
    got = ld.LineDedup(make(rows)).apply(make(rows)).collect()
    assert sorted(str(r.doc_id) for r in got) == ["3", "None", "None", "None"]
    assert later and all(r.rank == 2 and r.doc == 3 and r.l_doc == ld.FIRST and r.line == r.l_line == 0 and r.l_row != 0 for r in later)
