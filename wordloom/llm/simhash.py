"""SimHash near-duplicates: fingerprints, links within a few bits, connected groups.

Fingerprints come from Python tasks over Arrow batches; all linking is DataFrame work on *distinct*
fingerprints, so thousands of copies count once.

Links follow the general pigeonhole principle. The 64 bits are grouped into parts, correlated
bits together; a threshold per part is allotted with ``sum(thresholds) = max_bits - parts + 1`` (-1 leaves a
part out), so that fingerprints within ``max_bits`` agree within its threshold in one part at
least. A dynamic programme picks the thresholds with the least estimated cost: probes (all
values within the threshold) and candidates, counted exactly for threshold 0 by a histogram and carried on to
higher thresholds by the chance that the part's bits differ. The number of parts is the cheapest
by the same estimate. All choices change cost only, never the links found.

A large group of near copies would make all its pairs candidates. So links go in two rounds: first every
fingerprint is compared with the smallest of its bucket; then only pairs of different
components are compared. A verified link is needed for each step, and no link between components is left
out, so the components are those of all links.

Defined results: null or wordless text has fingerprint 0 and is linked like any other; equal texts
share a fingerprint; repeated rows stay; a null id never is a component's id unless all its ids are
null; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.components import components
from .common import materialize, prepared, table

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_CHUNK = 1 << 16  # shingles hashed at once


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """The 64-bit SimHash of the word shingles of ``text`` (repeats count; fewer words: the whole sequence)."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return 0
    joined, k = b" ".join(words), min(shingle, len(words))
    lens = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(lens) - 1
    starts = ends - lens + 1
    n = len(words) - k + 1
    starts, ends = starts[:n], ends[k - 1:]
    ones, h64 = np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for i in range(0, n, _CHUNK):
        h = [h64(joined[a:b], 42) for a, b in zip(starts[i:i + _CHUNK].tolist(), ends[i:i + _CHUNK].tolist(), strict=True)]
        bits = np.unpackbits(np.array(h, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, text_hash, fp`` (the fingerprint as a signed long) for each row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            fps = np.array([fingerprint(t, shingle) for t in b["text"]], np.uint64)
            yield pd.DataFrame({"doc_id": b["doc_id"].astype("Int64"), "text_hash": b["text_hash"], "fp": fps.view(np.int64)})

    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("text_hash"))
    return d.mapInPandas(run, "doc_id long, text_hash long, fp long")


def _bit_sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    gram = np.zeros((65, 65))
    for b in batches:
        bits = np.unpackbits(b["fp"].to_numpy(np.int64).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        x = np.hstack([bits, np.ones((len(bits), 1), np.uint8)]).astype(np.float32)
        gram += x.T @ x
    i, j = np.divmod(np.arange(65 * 65), 65)
    yield pd.DataFrame({"i": i, "j": j, "n": gram.ravel()})


def _group_bits(gram: np.ndarray, parts: int) -> list[list[int]]:
    """Bits in ``parts`` groups, correlated bits together (greedy, by mean absolute correlation)."""
    n = max(gram[64, 64], 1.0)
    p = gram[:64, 64] / n
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    corr = np.abs((gram[:64, :64] / n - np.outer(p, p)) / np.outer(sd, sd))
    np.fill_diagonal(corr, 0)
    left, groups = list(range(64)), []
    for g in range(parts):
        size = (64 - sum(map(len, groups))) // (parts - g)
        group = [max(left, key=lambda b: (corr[b, left].sum(), -b))]
        left.remove(group[0])
        while len(group) < size:
            group.append(max(left, key=lambda b: (corr[b, group].mean(), -b)))
            left.remove(group[-1])
        groups.append(sorted(group))
    return groups


def _within(gram: np.ndarray, bits: list[int], most: int) -> list[float]:
    """The chance that two fingerprints differ in at most 0, 1, ... ``most`` of ``bits``, taken as independent."""
    n = max(gram[64, 64], 1.0)
    dist = np.array([1.0])
    for b in bits:
        q = 2 * (gram[b, 64] / n) * (1 - gram[b, 64] / n)
        dist = np.convolve(dist, [1 - q, q])
    return [float(x) for x in np.cumsum(dist)[: most + 1]]


def _allot(costs: list[list[float]], max_bits: int) -> tuple[float, list[int]]:
    """Thresholds t with ``sum(t) = max_bits - parts + 1`` and least ``sum(costs[part][t])``; t = -1 is free."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for cost in costs:
        new: dict[int, tuple[float, list[int]]] = {}
        for used, (c, ts) in best.items():
            for t in range(-1, max_bits + 1):
                x = c + (cost[t] if t >= 0 else 0.0)
                if used + t + 1 <= max_bits + 1 and (used + t + 1 not in new or x < new[used + t + 1][0]):
                    new[used + t + 1] = (x, [*ts, t])
        best = new
    return best[max_bits + 1]


def _probes(bits: int, t: int) -> int:
    return sum(math.comb(bits, i) for i in range(t + 1))


#: Cost of one probe row (exploded, shuffled, joined) against one candidate (a bit count in the join).
PROBE_COST = 50.0
#: Probes of a part, at most.
PROBES = 2048


def _mask(bits) -> int:
    m = sum(1 << b for b in bits)
    return m - (1 << 64) if m >> 63 else m


def _plan(fps: DataFrame, max_bits: int) -> list[tuple[int, list[int]]]:
    """``(mask of the part, masks to flip in a probe)`` for each part that is probed."""
    sums = fps.select("fp").mapInPandas(_bit_sums, "i int, j int, n double").groupBy("i", "j").agg(F.sum("n").alias("n")).collect()
    gram = np.zeros((65, 65))
    for r in sums:  # 65 x 65 sums, whatever the input
        gram[r.i, r.j] = r.n
    n = gram[64, 64]

    def costs(groups, factor):
        out = []
        for g, f in zip(groups, factor, strict=True):
            out.append([PROBE_COST * n * _probes(len(g), t) + f * n * n * c if _probes(len(g), t) <= PROBES else math.inf for t, c in enumerate(_within(gram, g, max_bits))])
        return out

    tried = [_group_bits(gram, m) for m in range(1, max_bits + 2)]
    groups = min(tried, key=lambda g: _allot(costs(g, [1.0] * len(g)), max_bits)[0])
    parts = F.explode(F.array(*[F.struct(F.lit(i).alias("part"), F.col("fp").bitwiseAND(F.lit(_mask(g))).alias("value")) for i, g in enumerate(groups)]))
    pairs = {r.part: r.c for r in fps.select(parts.alias("x")).groupBy("x.part", "x.value").count()
             .groupBy("part").agg(F.sum(F.col("count").cast("double") * F.col("count")).alias("c")).collect()}
    factor = [pairs.get(i, 0.0) / max(n * n * _within(gram, g, 0)[0], 1e-9) for i, g in enumerate(groups)]
    _, ts = _allot(costs(groups, factor), max_bits)
    return [(_mask(g), [_mask(c) for k in range(t + 1) for c in combinations(g, k)]) for g, t in zip(groups, ts, strict=True) if t >= 0]


def _differ(a: str, b: str):
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def link_groups(spark: SparkSession, fps: DataFrame, max_bits: int = 3) -> DataFrame:
    """``fp, root``: distinct fingerprints and the smallest one that links within ``max_bits`` reach."""
    if not fps.limit(1).count():
        return fps.select("fp", F.col("fp").alias("root"))
    plan = _plan(fps, max_bits)

    def index(df):
        return df.select("*", F.explode(F.array(*[
            F.struct(F.lit(i).alias("part"), F.col("fp").bitwiseAND(F.lit(m)).alias("value")) for i, (m, _) in enumerate(plan)])).alias("x")).select("*", "x.*").drop("x")

    buckets = index(fps.select("fp"))
    heads = buckets.groupBy("part", "value").agg(F.min("fp").alias("head"), F.max("fp").alias("last")).where("head < last").drop("last")
    star = buckets.join(heads, ["part", "value"]).where((F.col("fp") != F.col("head")) & (_differ("fp", "head") <= max_bits))
    star = materialize(spark, star.select(F.col("fp").alias("u"), F.col("head").alias("v")).distinct(), "simhash-star")
    known = materialize(spark, fps.select("fp").join(components(spark, star).withColumnRenamed("node", "fp"), "fp", "left")
                        .select("fp", F.coalesce("root", "fp").alias("root")), "simhash-known")
    targets = index(known).select("part", "value", F.col("fp").alias("v"), F.col("root").alias("v_root"))
    probes = known.select("*", F.explode(F.array(*[
        F.struct(F.lit(i).alias("part"), F.col("fp").bitwiseAND(F.lit(m)).bitwiseXOR(F.lit(f)).alias("value")) for i, (m, flips) in enumerate(plan) for f in flips])).alias("x"))
    probes = probes.select("x.part", "x.value", F.col("fp").alias("u"), F.col("root").alias("u_root"))
    # a probe that would meet its own component alone has nothing to find
    met = targets.groupBy("part", "value").agg(F.min("v_root").alias("low"), F.max("v_root").alias("high"))
    probes = probes.join(met, ["part", "value"]).where("low <> u_root OR high <> u_root").drop("low", "high")
    near = (F.col("u") < F.col("v")) & (F.col("u_root") != F.col("v_root")) & (_differ("u", "v") <= max_bits)
    links = probes.join(targets, ["part", "value"]).where(near).select(F.col("u_root").alias("u"), F.col("v_root").alias("v"))
    over = components(spark, materialize(spark, links.distinct(), "simhash-links"))
    return known.join(over.select(F.col("node").alias("root"), F.col("root").alias("top")), "root", "left").select("fp", F.coalesce("top", "root").alias("root"))


def near_duplicates(spark: SparkSession, docs: DataFrame, shingle: int = 3, max_bits: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, text_hash, fp, component_id, root`` for each row; component_id is the smallest id of the group."""
    marks = materialize(prepared(spark), fingerprints(docs, shingle, id_col, text_col), "simhash-fp")
    distinct = materialize(spark, marks.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-distinct")
    roots = materialize(spark, link_groups(spark, distinct, max_bits), "simhash-roots")
    firsts = roots.join(distinct, "fp").groupBy("root").agg(F.min("first").alias("component_id"))
    return marks.join(roots.join(firsts, "root"), "fp", "left").select("doc_id", "text_hash", "fp", "component_id", "root")


def one_of_each_group(spark: SparkSession, docs: DataFrame, shingle: int = 3, max_bits: int = 3) -> DataFrame:
    """``docs`` with one row of each group: one of the smallest id (of several such rows, one of the smallest text hash)."""
    groups = near_duplicates(spark, docs, shingle, max_bits).where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    key = ["simhash_id", "simhash_null", "simhash_text"]
    at = lambda text: [F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)).alias(key[0]), F.col("doc_id").isNull().alias(key[1]), text.alias(key[2])]
    keep = groups.groupBy("root").agg(F.min(F.struct(*at(F.col("text_hash")))).alias("keep")).select("keep.*")
    # rows that repeat in id and text meet at the join's key, so the last step needs no shuffle of its own
    return docs.select("*", *at(F.xxhash64("text"))).join(keep, key).dropDuplicates(key).select(*docs.columns)


def hex_digits(fp):
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def op2_simhash(spark, sf_dir):
    """Fingerprint and component of every document: 3-word shingles, links at 3 or fewer bits."""
    d = near_duplicates(spark, table(spark, sf_dir, "documents"))
    return d.select("doc_id", hex_digits(F.col("fp")).alias("fingerprint"), "component_id")
