"""Line de-duplication by an exact set-similarity join (operator 9).  DataFrame operations only.

A line's tokens are its five-word shingles, lower-cased, as a set of 64-bit values.
Two lines match if the Jaccard similarity of their sets is 0.8 or more; a line of
one to four words has no shingle and matches those that equal it word by word.  A
line is removed if it matches any earlier one: earlier by doc_id, then by its
number in the document.  The layout of what is left stays.

1. Equal lines are one class, held by its first line.
2. A first prefix filter orders tokens by the hash of their first word, then by their
   own (a token's upper bits are of the one, its lower bits of the other): two sets that
   match share SHARED of their first n - ceil(0.8 n) + SHARED tokens (of fewer tokens
   in all, all).  A line's words are hashed and sorted, and only the shingles that begin with the
   smallest of them are built.  They meet in one sorted exchange, and lines with fewer than
   SHARED tokens that others have go.  The rest are the candidates.
3. Among the candidates tokens are counted, and the rare ones decide: in the order by
   rarity those that no other candidate has come first.  A line that has more than
   a fifth of such tokens can't match.  Of a pair, the first shared token stands
   behind them on either side (positional filter), and lengths must fit.
4. Each class is first compared with the first class that has the token, before tokens
   are counted; what is not settled with ever larger stretches of those that follow.  A large group of
   near copies is settled at the cost of a few pairs each, and classes that settle
   nowhere meet every earlier class of the token: nothing is missed.  Within the join
   parity sketches drop pairs whose sets differ too much.
5. Similarities are verified on whole sets, built for candidate lines only.

Tables of a step are deleted once the next ones are written; the lines' is kept.

Defined cases: null text has no lines and stays null; a null doc_id comes first;
rows that share a doc_id are told apart by a hash of their texts: lines with one
number in them are not earlier than each other, but what happens to a line
happens to the lines of its class only.  Empty lines stay.  An empty table gives no rows.
Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import drop, plain, stage

WIDTH = 5
#: Tokens of their prefixes that two lines which match share at least.  Up to 4: sets of as few tokens match only if they are equal.
SHARED = 3
#: Documents with candidate lines up to which their ids are broadcast (about 16 bytes each).
BROADCAST_IDS = 2_000_000
SPACE = r"[\x20\x09-\x0D]+"
#: Low bits of a token that are its own hash; those above are of its first word's hash.
OWN_BITS = 44
FIRST = -(1 << 63)
#: What tells a line from all others.
PLACE = ["doc", "row", "line"]


def _doc() -> Column:
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(FIRST))


def _lines(documents: DataFrame) -> DataFrame:
    return documents.select("doc", "row", F.posexplode_outer(F.split("text", "\n")).alias("line", "words"))


def _words(lines: DataFrame) -> DataFrame:
    """``words``: of the line, parted by a pattern."""
    return lines.withColumn("words", F.split(F.trim(F.lower("words"), F.lit(" \t\x0b\x0c\r")), SPACE))


def _hashed(lines: DataFrame) -> DataFrame:
    """``all``, the hash of each word, instead of the line ``words``.

    Words that are parted by single blanks alone, as most are, need no pattern; an empty
    word or other white space tells where they are not.
    """
    parted = lines.withColumn("all", _word_hashes(F.split(F.lower("words"), " ")))
    odd = F.array_contains("all", F.xxhash64(F.lit("")))
    for x in ("\t", "\r", "\x0b", "\x0c"):
        odd = odd | F.contains(F.col("words"), F.lit(x))
    again = F.when(F.col("odd"), _word_hashes(F.col("words"))).otherwise(F.col("all"))
    return _words(parted.withColumn("odd", odd)).withColumn("all", again).drop("words", "odd")


def _upper(x: Column) -> Column:
    return F.shiftright(x, OWN_BITS)


def _joined(first: Column, own: Column) -> Column:
    """The upper bits of ``first`` with the lower bits of ``own``."""
    return _placed(first, own.bitwiseAND(F.lit((1 << OWN_BITS) - 1)))


def _placed(first: Column, i: Column) -> Column:
    """The upper bits of ``first`` with a number that has no others than the lower ones."""
    return first.bitwiseAND(F.lit(-(1 << OWN_BITS))).bitwiseOR(i)


def _word_hashes(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def _long(hashes: Column) -> Column:
    """Null for lines of fewer than five words."""
    return F.when(F.size(hashes) >= WIDTH, hashes)


def _hashes(words: Column) -> Column:
    """The hash of each word, null for lines of fewer than five."""
    return F.when(F.size(words) >= WIDTH, _word_hashes(words))


def _shingles(places: Column) -> Column:
    """The shingles that begin with the words ``places`` of the column ``h`` of hashes, which is read from the row once."""

    def token(h: Column, i: Column) -> Column:
        first = F.get(h, i)
        return _joined(first, F.xxhash64(first, *[F.get(h, i + k) for k in range(1, WIDTH)]))

    return F.get(F.transform(F.array("h"), lambda h: F.transform(places, lambda i: token(h, i))), F.lit(0))


def _tokens(lines: DataFrame) -> DataFrame:
    """Adds the set ``tokens`` of lines with hashes ``h``; each step is a column of its own, so it is computed once."""
    return lines.withColumn("tokens", F.array_distinct(_shingles(F.sequence(F.lit(0), F.size("h") - WIDTH))))


def _prefix(lines: DataFrame) -> DataFrame:
    """Adds ``prefix`` to lines with hashes ``h``: their first n - ceil(0.8 n) + SHARED tokens, or all.

    Built are the shingles that begin with the smallest first words, as many as tokens
    are needed, and all that begin with the last of these words; all shingles of the
    line where repeated ones leave too few.
    n is counted with repeats, which makes the prefix longer and never shorter.
    """
    n = F.size("h") - (WIDTH - 1)
    places = F.slice(F.transform("h", lambda x, i: _placed(x, i.cast("long"))), F.lit(1), n)
    least = F.ceil(n * 4 / 5 - 1e-9)
    out = lines.withColumn("need", (n - least + F.least(least, F.lit(SHARED))).cast("int")).withColumn("places", F.sort_array(places))
    last, following = (_upper(F.get("places", F.col("need") - k)) for k in (1, 0))
    out = out.withColumn("taken", F.when(last == following, F.filter("places", lambda x: _upper(x) <= last)).otherwise(F.slice("places", F.lit(1), F.col("need"))))
    tokens = lambda places: F.array_distinct(_shingles(F.transform(places, lambda x: x.bitwiseAND(F.lit((1 << OWN_BITS) - 1)).cast("int"))))
    out = out.withColumn("first", tokens(F.col("taken")))
    out = out.withColumn("built", F.when((F.size("first") < F.col("need")) & (F.size("taken") < F.size("places")), tokens(F.col("places"))).otherwise(F.col("first")))
    return out.withColumn("prefix", F.when(F.size("built") <= F.col("need"), F.col("built")).otherwise(F.slice(F.sort_array("built"), F.lit(1), F.col("need"))))


def _class(hashes: Column) -> list[Column]:
    """128 bits of the hashes of a line's words; the words themselves need not be kept for it."""
    return [F.xxhash64(hashes).alias("k1"), F.xxhash64(F.lit(1), hashes).alias("k2")]


def _few(rows: DataFrame, derived: DataFrame | None = None) -> DataFrame:
    """``rows`` (or what is derived of them and no larger), to be broadcast if they are few."""
    out = rows if derived is None else derived
    return F.broadcast(out) if rows.count() <= BROADCAST_IDS else out


def _overlap_needed(n: Column, m: Column) -> Column:
    """Least overlap for a similarity of 0.8: ceil(4 (n + m) / 9)."""
    return F.ceil((n + m) * 4 / 9 - 1e-9)


def _can_match() -> Column:
    """Filters for two sets by their sizes (n), shared tokens (held) and parities.

    Length: the smaller has at least 0.8 of the larger.  Position: behind the
    tokens of their own there must be as many as the overlap needs.  Sketch: two
    sets differ by at least as many tokens as their parities (of tokens by their
    low six bits) by bits.
    """
    n, m = F.col("n"), F.col("l_n")
    need = _overlap_needed(n, m)
    return (F.least(n, m) * 5 >= F.greatest(n, m) * 4) & (F.least("held", "l_held") >= need) & (F.bit_count(F.col("parity").bitwiseXOR(F.col("l_parity"))) <= n + m - 2 * need)


class LineDedup:
    def __init__(self, documents: DataFrame):
        self.documents = documents.select("doc_id", "text")
        repeated = stage(self.documents.groupBy(_doc().alias("__vw_repeated")).agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("__vw_repeated"), "line-ids")
        self.repeated, self.n_repeated = repeated, repeated.count()
        hashed = _hashed(_lines(self._keyed(self.documents, "doc", "row")))
        empty = F.get("all", F.lit(0)) == F.xxhash64(F.lit(""))  # the one word of an empty line
        hashed = hashed.select(*PLACE, *_class(F.col("all")), F.coalesce(~empty, F.lit(False)).alias("used"), _long(F.col("all")).alias("h"))
        built = _prefix(hashed).select(*PLACE, "k1", "k2", "prefix", "used")
        #: All lines, with their prefixes, which only the first lines of classes need.
        self.lines = stage(plain(built, "k1", "k2", "prefix.list.element"), "lines")
        used = self.lines.filter("used")
        members = used.groupBy("k1", "k2").agg(F.min(F.struct("doc", "line", "row")).alias("f"), F.count(F.lit(1)).alias("members"))
        firsts = stage(members.select("k1", "k2", "members", "f.*"), "line-firsts")
        later = self._later(self._firsts(used, firsts))
        removed = stage(self._matches(later), "line-removed")
        several = firsts.join(_few(removed).withColumn("gone", F.lit(True)), PLACE, "left").filter("members > 1 or gone")
        #: Classes of more than one line and those that go, with their first line.
        self.classes = stage(several.select("k1", "k2", *[F.col(c).alias(f"f_{c}") for c in PLACE], F.coalesce("gone", F.lit(False)).alias("gone")), "line-classes")
        drop(firsts, removed)

    def _keyed(self, documents: DataFrame, doc: str, row: str) -> DataFrame:
        """``documents`` with the columns ``doc`` and ``row``: a hash of the text where rows share a doc_id, else 0."""
        keyed = documents.withColumn(doc, _doc())
        if not self.n_repeated:
            return keyed.withColumn(row, F.lit(0).cast("long"))
        ids = F.broadcast(self.repeated) if self.n_repeated <= BROADCAST_IDS else self.repeated
        keyed = keyed.join(ids, F.col(doc) == F.col("__vw_repeated"), "left")
        return keyed.withColumn(row, F.when(F.col("__vw_repeated").isNotNull(), F.xxhash64("text")).otherwise(F.lit(0).cast("long"))).drop("__vw_repeated")

    def _firsts(self, used: DataFrame, firsts: DataFrame) -> DataFrame:
        """Places and prefixes of the first lines of all classes; only classes of several lines are looked up."""
        several = firsts.filter("members > 1").select("k1", "k2", *[F.col(c).alias(f"f_{c}") for c in PLACE])
        same = " and ".join(f"{c} = f_{c}" for c in PLACE)
        out = used.join(_few(several), ["k1", "k2"], "left").filter(f"f_doc is null or ({same})").select(*PLACE, "prefix")
        if self.n_repeated:  # equal rows are one
            out = out.filter("row = 0").unionByName(out.filter("row <> 0").dropDuplicates(PLACE))
        return out

    def _later(self, firsts: DataFrame) -> DataFrame:
        """token, place, rank, l_place: the candidates that hold a token of their prefix after another; l_place is the first of all.

        Every token is exchanged here, so its rows are kept short: ``at`` is the line's number with the
        number of tokens it must share in the low bits, and ``row`` comes along only where ids repeat.
        """
        place = ["doc", "at", "row"] if self.n_repeated else ["doc", "at"]
        of_token, of_line = Window.partitionBy("token"), Window.partitionBy(*place)
        many = lambda rows, of, least: rows.withColumn("c", F.count(F.lit(1)).over(of)).filter(F.col("c") >= least).drop("c")
        at = F.shiftleft(F.col("line").cast("long"), 3).bitwiseOR(F.least(F.size("prefix"), F.lit(SHARED)).cast("long"))
        shared = many(firsts.withColumn("at", at).select(F.explode("prefix").alias("token"), *place), of_token, 2)
        order = of_token.orderBy(*place)
        ranked = many(shared, of_line, F.col("at").bitwiseAND(F.lit(7))).select("token", *place, F.row_number().over(order).alias("rank"), *[F.first(c).over(order).alias(f"l_{c}") for c in place])
        line = {f"{x}line": F.shiftright(f"{x}at", 3).cast("int") for x in ("", "l_")}
        row = {} if self.n_repeated else {f"{x}row": F.lit(0).cast("long") for x in ("", "l_")}
        later = ranked.filter("rank > 1").withColumns(line | row)
        return stage(later.select("token", *PLACE, "rank", *[f"l_{c}" for c in PLACE]), "line-later")

    def _matches(self, later: DataFrame) -> DataFrame:
        """(doc, row, line) of the first lines of classes that match an earlier class."""
        first = [F.col(f"l_{c}").alias(c) for c in PLACE]
        both = [*PLACE, *[f"l_{c}" for c in PLACE]]
        met = stage(later.select(*both).distinct(), "line-met")
        sets = self._sets(met.select(*PLACE).unionByName(met.select(*first)).distinct())
        # The first class with the token, once for each pair of classes whatever number of tokens they share.
        own = sets.select(*PLACE, "n", F.col("n").alias("held"), "parity")
        done = self._verified(stage(self._near(met.filter("doc <> l_doc or line <> l_line"), own).select(*both), "line-near"), sets)
        drop(met)
        settled = [done]
        # The others, where a token has more than two classes, of which one is open.
        many = later.filter("rank > 2").join(_few(done), PLACE, "left_anti").select("token").distinct()
        shared = later.join(many, "token", "left_semi")
        shared = stage(shared.select("token", *PLACE, "rank").unionByName(shared.select("token", *first, F.lit(1).alias("rank")).distinct()), "line-many")
        drop(later)
        some = stage(shared.select(*PLACE).distinct(), "line-some")
        own = stage(self._held(sets.join(_few(some), PLACE, "left_semi")), "line-own")
        # Tokens of their own come first in the order by rarity, so they fill places of a line's prefix.
        places = F.col("held") - F.ceil(F.col("n") * 4 / 5 - 1e-9) + 1
        ranked = shared.join(own, PLACE).withColumn("place", F.row_number().over(Window.partitionBy(*PLACE).orderBy("token")))
        few = stage(ranked.filter(F.col("place") <= places).drop("place"), "line-shared")
        # The rounds read only the sets that may still match.
        whole, sets = sets, stage(sets.join(_few(own, own.select(*PLACE)), PLACE, "left_semi"), "line-open-sets")
        drop(shared, own, some, whole)
        # In growing stretches: most of a group of near copies is settled by the first of them.
        open_, low, high = stage(few.filter("rank > 2").join(done, PLACE, "left_anti"), "line-open"), 2, 2
        while top := open_.agg(F.max("rank")).first()[0]:
            earlier = few.filter(F.col("rank").between(low, high)).withColumnsRenamed({c: f"l_{c}" for c in few.columns if c != "token"})
            pairs = open_.join(earlier, "token").filter("l_rank < rank and (doc <> l_doc or line <> l_line)").filter(_can_match())
            settled.append(self._verified(stage(pairs.select(*both).distinct(), "line-near"), sets))
            if high + 1 >= top:
                break
            before, open_ = open_, stage(open_.filter(F.col("rank") > high + 1).join(settled[-1], PLACE, "left_anti"), "line-open")
            drop(before)
            low, high = high + 1, 4 * high
        drop(sets, few, open_)
        for more in settled[1:]:
            done = done.unionByName(more)
        return done.distinct()

    def _near(self, pairs: DataFrame, own: DataFrame) -> DataFrame:
        """Of pairs those that lengths and parities allow.  own: place, n, held, parity."""
        other = own.withColumnsRenamed({c: f"l_{c}" for c in own.columns})
        return pairs.join(own, PLACE).join(other, [f"l_{c}" for c in PLACE]).filter(_can_match())

    def _held(self, sets: DataFrame) -> DataFrame:
        """doc, line, n, held, parity of the lines that can match at all; held: tokens that another candidate line has too.

        In the order by rarity the tokens that no other line has come first, so the
        first token that two sets share stands behind them in both.
        """
        owner = sets.select("sid", F.explode("tokens").alias("token")).groupBy("token").agg(F.min("sid").alias("sid"), F.max("sid").alias("top"))
        alone = owner.filter("sid = top").groupBy("sid").agg(F.count(F.lit(1)).alias("alone"))
        held = F.col("n") - F.coalesce("alone", F.lit(0))
        return sets.drop("tokens").join(alone, "sid", "left").filter(held * 5 >= F.col("n") * 4).select(*PLACE, "n", held.cast("int").alias("held"), "parity")

    def _sets(self, places: DataFrame) -> DataFrame:
        """Whole token sets and their parities of the given lines, built from their texts."""
        wanted = stage(places.groupBy("doc", "row").agg(F.collect_set("line").alias("lines"), F.count(F.lit(1)).alias("n")), "line-wanted")
        size = wanted.agg(F.count(F.lit(1)), F.sum("n")).first()
        small = size[0] + (size[1] or 0) <= BROADCAST_IDS
        texts = self._keyed(self.documents, "doc", "row").join(F.broadcast(wanted) if small else wanted, ["doc", "row"])
        if self.n_repeated:  # equal rows are one
            texts = texts.filter("row = 0").unionByName(texts.filter("row <> 0").dropDuplicates(["doc", "row"]))
        split = texts.withColumn("split", F.split("text", "\n"))
        wanted_lines = F.transform("lines", lambda k: F.struct(k.alias("line"), F.get("split", k).alias("words")))
        lines = split.select("doc", "row", F.explode(wanted_lines).alias("l")).select("doc", "row", "l.*").filter("words is not null")
        parity = F.aggregate("tokens", F.lit(0).cast("long"), lambda acc, t: acc.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), t.bitwiseAND(F.lit(63)).cast("int"))))
        whole = _tokens(_hashed(lines).filter(F.size("all") >= WIDTH).withColumnRenamed("all", "h"))
        out = whole.select(F.monotonically_increasing_id().alias("sid"), *PLACE, F.size("tokens").alias("n"), "tokens", parity.alias("parity"))
        out = stage(plain(out, "tokens.list.element"), "line-sets")
        drop(wanted)
        return out

    def _verified(self, near: DataFrame, sets: DataFrame) -> DataFrame:
        """(doc, row, line) of the staged pairs ``near`` whose sets have a similarity of 0.8 or more."""
        earlier = [f"l_{c}" for c in PLACE]
        left = sets.join(_few(near), PLACE).select(*PLACE, *earlier, "tokens")
        right = sets.join(_few(near, near.select(*[F.col(f"l_{c}").alias(c) for c in PLACE]).distinct()), PLACE, "left_semi")
        both = left.join(right.select(*[F.col(c).alias(f"l_{c}") for c in PLACE], F.col("tokens").alias("l_tokens")), earlier)
        overlap = F.size(F.array_intersect("tokens", "l_tokens"))
        out = stage(both.filter(overlap >= _overlap_needed(F.size("tokens"), F.size("l_tokens"))).select(*PLACE).distinct(), "line-settled")
        drop(near)
        return out

    def gone(self) -> DataFrame:
        """doc, row and line of every line that goes."""
        used = self.lines.filter("used").select(*PLACE, "k1", "k2").join(_few(self.classes), ["k1", "k2"])
        return used.filter((F.col("gone")) | (F.col("doc") != F.col("f_doc")) | (F.col("line") != F.col("f_line"))).select(*PLACE)

    def report(self) -> DataFrame:
        """doc_id, n_lines, n_removed and the numbers of the removed lines (from 0, as text) of each document."""
        every = self.lines.groupBy("doc").agg(F.count("line").alias("n_lines"))
        numbers = F.concat_ws(",", F.array_sort(F.collect_set("line")).cast("array<string>"))
        gone = self.gone().groupBy("doc").agg(F.count(F.lit(1)).alias("n"), numbers.alias("numbers"))
        removed = [F.coalesce("n", F.lit(0)).alias("n_removed"), F.coalesce("numbers", F.lit("")).alias("removed")]
        return every.join(gone, "doc", "left").select(F.when(F.col("doc") != FIRST, F.col("doc")).alias("doc_id"), "n_lines", *removed)

    def apply(self, documents: DataFrame) -> DataFrame:
        """``documents`` without the removed lines, and without those that lost all of theirs; n_chars follows.

        The removed lines' numbers are broadcast if they are few; else texts are shuffled once.
        """
        gone = self.gone().groupBy(F.col("doc").alias("__vw_doc"), F.col("row").alias("__vw_row")).agg(F.collect_set("line").alias("__vw_gone"), F.count(F.lit(1)).alias("__vw_n"))
        gone = stage(gone, "line-gone")
        size = gone.agg(F.count(F.lit(1)), F.sum("__vw_n")).first()
        small = size[0] + (size[1] or 0) <= BROADCAST_IDS
        joined = self._keyed(documents, "__vw_doc", "__vw_row").join(F.broadcast(gone) if small else gone, ["__vw_doc", "__vw_row"], "left")
        kept = F.filter(F.split("text", "\n"), lambda x, i: ~F.array_contains("__vw_gone", i))
        cut = joined.withColumn("__vw_kept", F.when(F.col("__vw_gone").isNotNull(), kept)).filter("__vw_kept is null or size(__vw_kept) > 0")
        text = F.coalesce(F.array_join("__vw_kept", "\n"), F.col("text"))
        changed = {"text": text.alias("text")} | ({"n_chars": F.when(F.col("__vw_kept").isNull(), F.col("n_chars")).otherwise(F.length(text)).cast(documents.schema["n_chars"].dataType).alias("n_chars")} if "n_chars" in documents.columns else {})
        return cut.select(*[changed.get(c, F.col(c)) for c in documents.columns])


ORACLE = r"""
WITH lines AS (
  SELECT doc_id, generate_subscripts(l, 1) - 1 AS line, unnest(l) AS t FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL)),
words AS (
  SELECT doc_id, line, string_split_regex(trim(translate(lower(t), chr(9) || chr(11) || chr(12) || chr(13), '    ')), ' +') AS w FROM lines),
sets AS (
  SELECT doc_id, line, list_distinct(CASE WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s, array_to_string(w, ' ') AS k FROM words WHERE w[1] <> ''),
classes AS (SELECT k, min((doc_id, line)) AS first, any_value(s) AS s, len(any_value(s)) AS n FROM sets GROUP BY k),
tokens AS (SELECT k, first, n, unnest(s) AS t FROM classes),
counts AS (SELECT t, count(*) AS c FROM tokens GROUP BY t),
ranked AS (SELECT k, first, n, t, row_number() OVER (PARTITION BY k ORDER BY c, t) AS i FROM tokens JOIN counts USING (t)),
prefix AS (SELECT * FROM ranked WHERE i <= n - ceil(n * 4 / 5 - 1e-9) + 1),
pairs AS (SELECT DISTINCT b.k AS later, a.k AS earlier FROM prefix a JOIN prefix b ON a.t = b.t AND a.first < b.first AND least(a.n, b.n) * 5 >= greatest(a.n, b.n) * 4),
gone AS (
  SELECT DISTINCT p.later AS k FROM pairs p JOIN classes a ON a.k = p.earlier JOIN classes b ON b.k = p.later
  WHERE len(list_intersect(a.s, b.s)) * 9 >= 4 * (a.n + b.n)),
flagged AS (
  SELECT l.doc_id, l.line, coalesce(g.k IS NOT NULL OR c.first <> (l.doc_id, l.line), false) AS gone
  FROM lines l LEFT JOIN sets s ON s.doc_id = l.doc_id AND s.line = l.line LEFT JOIN classes c ON c.k = s.k LEFT JOIN gone g ON g.k = s.k)
SELECT d.doc_id, count(f.line) AS n_lines, count(*) FILTER (f.gone) AS n_removed, coalesce(string_agg(f.line::VARCHAR, ',' ORDER BY f.line) FILTER (f.gone), '') AS removed
FROM (SELECT DISTINCT doc_id FROM documents) d LEFT JOIN flagged f ON f.doc_id = d.doc_id GROUP BY d.doc_id
"""
