"""I-Match fingerprints: hashes of randomised subsets of a lexicon of mid-frequency terms.

The lexicon keeps terms whose document frequency lies within a band, as a share of all documents
(a band of inverse document frequency). ``SUBSETS`` random subsets of it keep a term with chances from 1/2 down to
1/2^11, so that for a text of any length some subsets hold a few of its terms. A fingerprint has one
signature per subset: the hash of the text's distinct terms in the subset, sorted. An edit leaves the
signatures of the subsets whose terms it does not touch, and dense subsets hardly ever escape it. So
the likeness of two fingerprints is the share of equal signatures among the subsets in which either
text has terms (``LEAST`` at least), taken from the sparsest ones up to the level where that share is largest.

The lexicon's size does not grow with the corpus: terms in at least ``LOW`` of all documents
number at most the mean count of distinct terms of a document divided by ``LOW``. It goes to the tasks
with the function, as sorted 64-bit hashes.

Defined results: a null text counts as empty; a text without lexicon terms has, in place of signatures,
the hash of all its distinct terms (empty text: of none), which is like an equal one only; null ids stand before all
others and rows of one id in the order of their texts; the next of a table's only row is itself; an empty
table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import prepared, table

LOW, HIGH = 0.0005, 0.2  # band of document frequency, as a share of documents
SUBSETS, LEVELS = 64, 11
DIGITS = 4  # hex digits of a signature
LEAST = 6  # signatures that a likeness is a share of, at least

_TERM = re.compile(r"[^\W_]+")


def term_hashes(text: str) -> np.ndarray:
    """Hashes of the distinct terms (lower-case runs of letters and digits) of a text."""
    h = xxhash.xxh64_intdigest
    terms = set(_TERM.findall(text.lower()))
    return np.fromiter((h(t.encode("utf-8", "surrogatepass")) for t in terms), np.uint64, len(terms))


def document_frequencies(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``term, n``: in how many documents each hashed term stands."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0
        for b in batches:
            for text in b["text"]:
                if text:
                    held.append(term_hashes(text))
                    size += len(held[-1])
                if size > 2_000_000:  # 16 MB
                    yield counted(held)
                    held, size = [], 0
        if held:
            yield counted(held)

    def counted(held):
        terms, n = np.unique(np.concatenate(held), return_counts=True)
        return pd.DataFrame({"term": terms.view(np.int64), "n": n.astype(np.int64)})

    return docs.select(F.col(text_col).alias("text")).mapInPandas(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))


def lexicon(spark: SparkSession, docs: DataFrame, text_col: str = "text", low: float = LOW, high: float = HIGH) -> np.ndarray:
    """Sorted hashes of the terms in the band, over all documents."""
    total = docs.count()
    band = document_frequencies(prepared(spark) and docs, text_col).where((F.col("n") >= low * total) & (F.col("n") <= max(high * total, 1.0)))
    terms = band.select("term").toPandas()["term"].to_numpy(np.int64)  # bounded: see the module's text
    return np.sort(terms.view(np.uint64))


def subset_masks(lex: np.ndarray) -> np.ndarray:
    """For each lexicon term, whether each subset holds it (rows of booleans); depends on the term alone."""
    out = np.empty((len(lex), SUBSETS), bool)
    for k in range(SUBSETS):
        x = lex ^ np.uint64(0x9E3779B97F4A7C15 * (k + 1) % (1 << 64))
        for _ in range(2):  # mixes the bits
            x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        out[:, k] = (x >> np.uint64(40)) < np.uint64((1 << 24) >> (1 + k % LEVELS))
    return out


class Fingerprinter:
    """Fingerprints of texts for one lexicon."""

    def __init__(self, lex: np.ndarray):
        self.lex, self.masks = lex, subset_masks(lex)

    def __call__(self, text: str) -> str:
        h = term_hashes(text)
        if len(h) and len(self.lex):
            at = np.minimum(np.searchsorted(self.lex, h), len(self.lex) - 1)
            at = np.sort(at[self.lex[at] == h])
            if len(at):
                held, terms = self.masks[at], self.lex[at]
                return "".join(self._signature(terms[held[:, k]]) for k in range(SUBSETS))
        return "all:" + xxhash.xxh64_hexdigest(np.sort(h).tobytes())

    @staticmethod
    def _signature(terms: np.ndarray) -> str:
        if not len(terms):
            return "0" * DIGITS
        return f"{xxhash.xxh64_intdigest(terms.tobytes()) % ((1 << 4 * DIGITS) - 1) + 1:0{DIGITS}x}"


def likeness(a: str, b: str) -> float:
    """Largest share of equal signatures, among the subsets from some level on in which either text has terms."""
    if a == b:
        return 1.0
    if a.startswith("all:") or b.startswith("all:"):
        return 0.0
    same, some = [0] * LEVELS, [0] * LEVELS
    for k in range(SUBSETS):
        x, y = a[k * DIGITS:(k + 1) * DIGITS], b[k * DIGITS:(k + 1) * DIGITS]
        some[k % LEVELS] += x != "0" * DIGITS or y != "0" * DIGITS
        same[k % LEVELS] += x == y != "0" * DIGITS
    best, s, n = 0.0, 0, 0
    for level in reversed(range(LEVELS)):  # from the sparsest subsets on
        s, n = s + same[level], n + some[level]
        best = max(best, s / max(n, LEAST))
    return best


def fingerprints(spark: SparkSession, docs: DataFrame, lex: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fingerprint`` for each row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = Fingerprinter(lex)
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"].astype("Int64"), "fingerprint": [own(t or "") for t in b["text"]]})

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInPandas(run, "doc_id long, fingerprint string")


def with_next(docs: DataFrame, run, schema: str, slices: int) -> DataFrame:
    """``run`` over an iterator of ``(row, next row)`` in ascending order of ids, rows as ``(doc_id, text)``; after the last comes the first.

    The ids are cut into slices by approximate quantiles. A slice's first row also goes, as a guest behind
    all others, to the slice before, so that every row meets its next one in a sorted stream. The text is
    shuffled once; no slice is held in memory.
    """
    spark, low = docs.sparkSession, -(1 << 63)
    d = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("doc_id", F.lit(low)).alias("at"))
    cuts = d.select(F.percentile_approx("at", [i / slices for i in range(1, slices)], 20 * slices).alias("q")).first()["q"] if slices > 1 else None
    cuts = sorted(set(cuts or []))
    slice_of = F.size(F.filter(F.array(*[F.lit(c).cast("long") for c in cuts]), lambda c: c <= F.col("at"))) if cuts else F.lit(0)
    d = d.withColumn("slice", slice_of)
    heads = sorted((r["slice"], r["head"]) for r in d.groupBy("slice").agg(F.min("at").alias("head")).collect())  # a row for each slice
    before = [(heads[i][1], heads[i - 1][0]) for i in range(len(heads))]
    guests = spark.createDataFrame(before, "head long, host int")
    d = d.join(F.broadcast(guests), F.col("at") == F.col("head"), "left")
    here = F.struct(F.col("slice"), F.lit(False).alias("guest"))
    there = F.struct(F.col("host").alias("slice"), F.lit(True).alias("guest"))
    d = d.select("doc_id", "text", "at", F.explode(F.when(F.col("host").isNull(), F.array(here)).otherwise(F.array(here, there))).alias("x"))
    d = d.select("x.slice", "x.guest", "at", "doc_id", "text").repartition("slice").sortWithinPartitions("slice", "guest", "at", "text")

    def pairs(batches):
        last = None
        for b in batches:
            cols = [b.column(i).to_pylist() for i in (0, 1, 3, 4)]
            for part, guest, doc_id, text in zip(*cols, strict=True):
                if last is not None and last[0] == part and not last[1]:
                    yield last[2:], (doc_id, text)
                last = (part, guest, doc_id, text)

    return d.mapInArrow(lambda batches: run(pairs(batches)), schema)


def op5_imatch(spark, sf_dir):
    """Fingerprints of every document and of its edited text, and their likeness to each other and to the next document's."""
    docs = table(prepared(spark), sf_dir, "documents").select("doc_id", "text")
    lex = lexicon(spark, docs)

    def run(pairs):
        own, known, rows = Fingerprinter(lex), (None, None), []

        def of(text):
            return known[1] if known[0] == text else own(text)

        for (doc_id, text), (_, following) in pairs:
            mine, theirs = of(text), own(following)
            known, n = (following, theirs), len(text)
            edited = text[: n - n // 4] + following[: n // 4]
            changed = own(edited)
            rows.append((doc_id, n, hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), mine, changed, likeness(mine, changed), likeness(mine, theirs)))
            if len(rows) == 1000:
                yield batch(rows)
                rows = []
        yield batch(rows)

    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def batch(rows):
        import pyarrow as pa

        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        cols = list(zip(*rows, strict=True)) or [()] * len(kinds)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)

    slices = min(4096, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))  # only how finely the work is dealt
    return with_next(docs, run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double", slices)
