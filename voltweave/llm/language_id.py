"""Language identification (operator 1).

Multinomial naive Bayes over hashed character 1- to 3-grams.  Counts are taken
on a bounded, documented sample of labelled rows.  The log-probability matrix is
broadcast, and batches are scored in numpy by sparse look-ups: each n-gram of a text
gathers one number a language, sums run per text.  A matrix holds at most
MATRIX_BYTES; where languages are more than fit it, texts are scored in several
passes, a block of languages in each, with the same result.

Log-likelihoods of overlapping n-grams are far too sure of themselves, so the score
is the softmax of the mean log-likelihood an n-gram, over a temperature that fits the
labels of a tenth of the sample best, which the counts leave out.

Defined cases: a text that is null or has no letter gets ``und`` and score 0;
so does every text when nothing could be learned (no labelled row).  A text of any
length is read whole.  A null ``doc_id`` counts as the empty string for the fold.
Repeated rows are kept.  Ties go to the language that is first by code point.  An
empty table gives no rows.  Only ``doc_id``, ``text`` and ``lang`` are read, so other
columns never clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import drop, rows, stage

UNKNOWN = "und"
BUCKETS = 1 << 16
MATRIX_BYTES = 64 << 20
#: Bytes of text that are scored at once; the n-grams of a stretch take about a hundred times that.
BATCH_BYTES = 250_000
#: Labelled rows that are learned from, of each language at most (in expectation); one in TUNING of them sets the temperature.
TRAIN_DOCS, TUNING = 20_000, 10
TEMPERATURES = np.geomspace(0.02, 5, 25)
USUAL = 0.3
#: Languages up to which their table of counts is broadcast (about 30 bytes each).
BROADCAST_LANGUAGES = 100_000

_tables: list[np.ndarray] = []


def _lower_letters() -> np.ndarray:
    """By code point: the lower-case letter, or a space if it is no letter."""
    if not _tables:
        import unicodedata

        table = np.full(0x110000, 32, dtype=np.uint32)
        for i in range(0x110000):
            c = chr(i)
            if unicodedata.category(c)[0] == "L":
                low = c.lower()
                table[i] = ord(low) if len(low) == 1 else i
        _tables.append(table)
    return _tables[0]


def has_letter(codes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """For each text of ``codes`` that starts at ``at`` (none empty): any letter?"""
    return np.logical_or.reduceat(codes != 32, at)


def grams(texts: list[str], buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket of each n-gram, index of its text, whether each text has a letter)."""
    raw = np.frombuffer("".join(f" {t} " for t in texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    sizes = np.fromiter((len(t) + 2 for t in texts), dtype=np.int64, count=len(texts))
    codes = _lower_letters()[raw]
    owner = np.repeat(np.arange(len(texts), dtype=np.int32), sizes)
    letters = has_letter(codes, np.concatenate([[0], np.cumsum(sizes)[:-1]])) if len(texts) else np.zeros(0, bool)
    keep = codes != 32
    keep[1:] |= codes[:-1] != 32
    codes, owner = codes[keep], owner[keep]
    mixed = [codes * np.uint32(0x9E3779B1), codes * np.uint32(0x85EBCA77), codes * np.uint32(0xC2B2AE3D)]
    shift = np.uint32(32 - int(buckets).bit_length() + 1)
    found, owners = [], []
    for n in (1, 2, 3):
        m = len(codes) - n + 1
        if m <= 0:
            continue
        h = mixed[0][:m].copy()
        for k in range(1, n):
            h ^= mixed[k][k : k + m]
        h = (h + np.uint32(n)) * np.uint32(0x27D4EB2F)
        ok = owner[:m] == owner[n - 1 : n - 1 + m]
        if n == 1:
            ok = ok & (codes != 32)
        found.append((h >> shift)[ok])
        owners.append(owner[:m][ok])
    if not found:
        return np.zeros(0, np.uint32), np.zeros(0, np.int32), letters
    return np.concatenate(found), np.concatenate(owners), letters


@dataclass
class Model:
    #: k, lang, prior (log), weights (log probabilities by bucket, 32-bit floats): a row for each language.
    table: DataFrame | None
    languages: int
    block: int
    temperature: float = USUAL

    def matrices(self) -> Iterator[tuple[np.ndarray, list[str], np.ndarray, np.ndarray]]:
        """(numbers, names, priors, languages x buckets) of each block of languages; one at a time is held."""
        for low in range(0, self.languages, self.block):
            got = self.table.filter(F.col("k").between(low, low + self.block - 1)).collect()
            got.sort(key=lambda r: r["k"])
            yield np.array([r["k"] for r in got]), [r["lang"] for r in got], np.array([r["prior"] for r in got]), np.stack([np.frombuffer(r["weights"], np.float32) for r in got])


#: What scoring adds to a row: the best language and its mean log-likelihood, the n-grams, and for each temperature the log of the sum over languages.
STATE = "__vw_name string, __vw_best double, __vw_n long, __vw_sum array<double>, __vw_own double"


def _scored(documents: DataFrame, model: Model, temperatures: np.ndarray, keep: list[str]) -> DataFrame:
    """The columns ``keep`` of ``documents`` with STATE; __vw_own: the mean log-likelihood of the language numbered by the column __vw_k, if there is one."""
    names, temperatures = documents.columns, np.asarray(temperatures)
    at, labelled = names.index("text"), "__vw_k" in names
    added = [c.split()[0] for c in STATE.split(", ")]

    def score(shared, first: bool, out: list[str]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    yield from one(batch)

        def one(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            numbers, languages, prior, weights = shared.value
            done = 0
            for (texts,) in rows(iter([batch.select([at])]), 0, BATCH_BYTES):
                m, part = len(texts), batch.slice(done, len(texts))
                done += m
                hashed, owner, _ = grams([t or "" for t in texts], BUCKETS)
                n = np.bincount(owner, minlength=m)
                like = np.stack([np.bincount(owner, weights=w[hashed], minlength=m) for w in weights], axis=1) + prior
                like /= np.maximum(n, 1)[:, None]
                best, top = like.argmax(axis=1), like.max(axis=1)
                total = np.stack([np.log(np.exp((like - top[:, None]) / t).sum(axis=1)) + top / t for t in temperatures], axis=1)
                found = [languages[b] for b in best]
                own = np.full(m, np.nan)
                if labelled:
                    k = np.asarray(part.column(names.index("__vw_k")), dtype=np.int64) - numbers[0]
                    here = (k >= 0) & (k < len(languages))
                    own[here] = like[here, k[here]]
                if not first:
                    before = [part.column(len(names) + i) for i in range(len(added))]
                    was = np.asarray(before[1])
                    found = [x if keep else y for x, y, keep in zip(before[0].to_pylist(), found, was >= top)]
                    top = np.maximum(was, top)
                    total = np.logaddexp(np.asarray(before[3].flatten()).reshape(m, -1), total)
                    own = np.where(np.isnan(own), np.asarray(before[4].fill_null(np.nan)), own)
                sums = pa.ListArray.from_arrays(pa.array(np.arange(0, total.size + 1, len(temperatures)), pa.int32()), pa.array(total.reshape(-1)))
                state = [pa.array(found, pa.string()), pa.array(top), pa.array(n.astype(np.int64)), sums, pa.array(own)]
                yield pa.RecordBatch.from_arrays([*(part.column(names.index(c)) for c in out), *state], [*out, *added])

        return run

    out, spark = documents, documents.sparkSession
    for i, matrix in enumerate(model.matrices()):
        if i:
            out = stage(out, "language-pass")
        columns = keep if (i + 1) * model.block >= model.languages else names
        schema = ", ".join([*(f"`{c}` {documents.schema[c].dataType.simpleString()}" for c in columns), STATE])
        out = out.mapInArrow(score(spark.sparkContext.broadcast(matrix), i == 0, columns), schema)
    return out


def _answers(temperature: float) -> tuple:
    """(lang_pred, score) as columns of what _scored gives for one temperature."""
    known = F.col("__vw_n") > 0
    share = F.exp(F.col("__vw_best") / F.lit(float(temperature)) - F.get("__vw_sum", F.lit(0)))
    return F.when(known, F.col("__vw_name")).otherwise(UNKNOWN), F.when(known, F.least(share, F.lit(1.0))).otherwise(0.0)


def fit(labelled: DataFrame, train_docs: int = TRAIN_DOCS, matrix_bytes: int = MATRIX_BYTES) -> Model:
    """Learn from ``labelled`` (doc_id, text, lang), of each language at most about ``train_docs`` rows.

    Which rows are taken depends on a hash of doc_id alone.
    """
    labelled = labelled.select("doc_id", "text", "lang").filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    counted = labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    numbered = counted.select("lang", "n", (F.row_number().over(Window.orderBy("lang")) - 1).alias("k"), F.log(F.col("n") / F.sum("n").over(Window.partitionBy())).alias("prior"))
    languages = stage(numbered, "languages")
    size = languages.count()
    block = max(1, matrix_bytes // (BUCKETS * 4))
    if not size:
        return Model(None, 0, block)
    scale = 1 << 30
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    of = languages.select(F.col("lang").alias("of"), "n", "k")
    own = labelled.join(F.broadcast(of) if size <= BROADCAST_LANGUAGES else of, F.col("lang") == F.col("of"))
    taken = own.filter(F.pmod(F.xxhash64(key), F.lit(scale)) < F.floor(F.lit(float(scale * train_docs)) / F.col("n")))
    sample = taken.select("text", F.col("k").cast("long").alias("__vw_k"), (F.pmod(F.xxhash64(F.lit(1), key), F.lit(TUNING)) == 0).alias("tuning"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}

        def out() -> Iterator[pa.RecordBatch]:
            for k, v in total.items():
                at = np.flatnonzero(v)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), k, np.int64)), pa.array(at.astype(np.int32)), pa.array(v[at].astype(np.int64))], ["k", "bucket", "n"])
            total.clear()

        for texts, numbers in rows(batches, 0, BATCH_BYTES):
            hashed, owner, _ = grams(texts, BUCKETS)
            of_ = np.array(numbers, dtype=np.int64)[owner]
            for k in np.unique(of_):
                total[k] = total.get(k, 0) + np.bincount(hashed[of_ == k], minlength=BUCKETS)
            if len(total) > 64:
                yield from out()
        yield from out()

    def logs(table: pa.Table) -> pa.Table:
        n = np.ones(BUCKETS)
        n[np.asarray(table["bucket"])] += np.asarray(table["n"])
        return pa.table({"of": table["k"][:1], "weights": pa.array([np.log(n / n.sum()).astype(np.float32).tobytes()], pa.binary())})

    counts = sample.filter("not tuning").select("text", "__vw_k").mapInArrow(count, "k long, bucket int, n long").groupBy("k", "bucket").agg(F.sum("n").alias("n"))
    weights = counts.groupBy("k").applyInArrow(logs, "of long, weights binary")
    none = F.lit(np.log(np.full(BUCKETS, 1 / BUCKETS)).astype(np.float32).tobytes())
    joined = languages.join(weights, F.col("k") == F.col("of"), "left")
    model = Model(stage(joined.select("k", "lang", "prior", F.coalesce("weights", none).alias("weights")), "language-model"), size, block)
    tuning = _scored(sample.filter("tuning").select("text", "__vw_k"), model, TEMPERATURES, []).filter("__vw_n > 0")
    loss = tuning.agg(F.count(F.lit(1)), *[F.sum(F.get("__vw_sum", F.lit(i)) - F.col("__vw_own") / float(t)) for i, t in enumerate(TEMPERATURES)]).first()
    drop(languages)
    if loss[0]:
        model.temperature = float(TEMPERATURES[int(np.argmin(loss[1:]))])
    return model


def identify(documents: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score of every row of ``documents``."""
    documents = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    if not model.languages:
        return documents.select("doc_id", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    scored = _scored(documents, model, [model.temperature], ["doc_id"])
    name, score = _answers(model.temperature)
    return scored.select("doc_id", name.alias("lang_pred"), score.alias("score"))


def held_out(folds: int, fold: int):
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % folds == fold


def keep_identified(documents: DataFrame, least: float = 0.5) -> DataFrame:
    """Rows of ``documents`` whose language can be told, with that language in the column ``lang``.

    Those that are ``und`` or score less than ``least`` go.  All other columns stay as they
    are.  The model is learned from the rows' own labels outside the held-out fold;
    without any nothing can be told, and no row stays.
    """
    model = fit(documents.filter(~held_out(3, 1)))
    if not model.languages:
        return documents.filter(F.lit(False))
    scored = _scored(documents, model, [model.temperature], documents.columns)
    name, score = _answers(model.temperature)
    kept = scored.withColumn("__vw_pred", name).filter((F.col("__vw_pred") != UNKNOWN) & (score >= least))
    return kept.select(*[F.col("__vw_pred").alias("lang") if c == "lang" else F.col(c) for c in documents.columns])
