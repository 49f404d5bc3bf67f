"""Mixing sources to target weights by systematic sampling (DataFrame functions only).

Every document of a source expects ``rate = target / source size`` copies. The documents of a
source stand in one fixed order; the running sum of expected copies plus one random offset of
the source crosses an integer boundary now and then, and a document is emitted once for each
boundary that its own share crosses. With ``rate <= cap`` no document is emitted more than
``ceil(cap)`` times, and as the order goes by size, the words taken stay near the target.

The running sum is ``rate * rank``. Ranks come without a task that sees a whole source: a
document falls into a cell (source, size class, id bucket), cells are counted by a partial
aggregate, offsets are summed over at most ~1,000 classes of a source and then over the
buckets of a class, and only the rows of one cell are numbered together.

Defined results: a null source is a source of its own and stands last; a null text has size 0;
null ids stand first in a cell; rows equal in every column are separate documents; an empty
table gives an empty mix; a source of size 0 has target 0 and gives no document; columns of the input keep their
names (the operator's own carry the prefix ``mix_``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize, table, word_count

BUCKETS = 1024  # id buckets of a size class
SEED = "17"


def _class_of(size: Column) -> Column:
    """Size classes of a relative width of 1/32, in the order of sizes."""
    shift = F.greatest(F.lit(0), F.length(F.bin(size)) - 6)
    return (shift * 64 + F.expr("mix_size") / F.pow(F.lit(2.0), shift)).cast("long")


def _key(source: str) -> list[Column]:
    return [F.col(source).isNull().cast("int").alias("mix_null"), F.coalesce(F.col(source).cast("string"), F.lit("")).alias("mix_src")]


SRC = ["mix_null", "mix_src"]
CELL = [*SRC, "mix_class", "mix_bucket"]


def source_targets(totals: DataFrame, weights: tuple[float, ...], cap: float) -> DataFrame:
    """Targets for ``mix_null, mix_src, mix_total`` (a row per source).

    Sources in code point order take the weights in turn and share the sum of all totals. A target
    stops at ``cap`` times its source's total, and the excess is shared by weight again:
    ``target = min(cap * total, level * weight)`` for the one level at which nothing is left.
    """
    every = W.partitionBy().orderBy(*SRC)
    n = len(weights)
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.row_number().over(every) - 1) % n + 1).cast("int"))
    t = totals.withColumn("mix_weight", w).withColumn("mix_cap", F.lit(float(cap)) * F.col("mix_total"))
    whole = W.partitionBy()
    filled = W.partitionBy().orderBy(F.col("mix_cap") / F.col("mix_weight"), *SRC)
    before = filled.rowsBetween(W.unboundedPreceding, -1)
    onward = filled.rowsBetween(W.currentRow, W.unboundedFollowing)
    t = t.withColumn("mix_all", F.sum("mix_total").over(whole).cast("double"))
    level = (F.col("mix_all") - F.coalesce(F.sum("mix_cap").over(before), F.lit(0.0))) / F.sum("mix_weight").over(onward)
    t = t.withColumn("mix_full", F.col("mix_cap") <= level * F.col("mix_weight"))
    left = F.col("mix_all") - F.sum(F.when(F.col("mix_full"), F.col("mix_cap")).otherwise(0.0)).over(whole)
    open_w = F.sum(F.when(F.col("mix_full"), 0.0).otherwise(F.col("mix_weight"))).over(whole)
    target = F.when(F.col("mix_full"), F.col("mix_cap")).otherwise(left / open_w * F.col("mix_weight"))
    return t.withColumn("mix_target", target).select(*SRC, "mix_total", "mix_target")


def copies(
    docs: DataFrame,
    *,
    weights: tuple[float, ...] = (1.0, 2.0, 3.0),
    cap: float = 3.0,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
    size: Column | None = None,
    seed: str = SEED,
) -> DataFrame:
    """``docs`` with ``mix_size``, ``mix_total``, ``mix_target`` and ``mix_copies`` (0 or more) for each row."""
    d = docs.withColumn("mix_size", word_count(F.col(text_col)) if size is None else size.cast("long"))
    d = d.select("*", *_key(source_col), _class_of(F.col("mix_size")).alias("mix_class"),
                 F.coalesce(F.pmod(F.col(id_col), F.lit(BUCKETS)), F.lit(0)).cast("int").alias("mix_bucket"))
    cells = d.groupBy(*CELL).agg(F.count(F.lit(1)).alias("mix_n"), F.sum("mix_size").alias("mix_words"))
    by_class = cells.groupBy(*SRC, "mix_class").agg(F.sum("mix_n").alias("mix_n"), F.sum("mix_words").alias("mix_words"))
    up_to = (W.unboundedPreceding, -1)
    classes = by_class.select(
        *SRC, "mix_class",
        F.coalesce(F.sum("mix_n").over(W.partitionBy(*SRC).orderBy("mix_class").rowsBetween(*up_to)), F.lit(0)).alias("mix_before"),
    )
    targets = source_targets(by_class.groupBy(*SRC).agg(F.sum("mix_words").alias("mix_total")), weights, cap)
    in_class = W.partitionBy(*SRC, "mix_class").orderBy("mix_bucket").rowsBetween(*up_to)
    offsets = (
        cells.select(*CELL, F.coalesce(F.sum("mix_n").over(in_class), F.lit(0)).alias("mix_in"))
        .join(classes, [*SRC, "mix_class"])
        .join(targets, SRC)
        .select(*CELL, (F.col("mix_before") + F.col("mix_in")).alias("mix_before"), "mix_total", "mix_target")
    )
    rank = F.row_number().over(W.partitionBy(*CELL).orderBy("mix_size", F.col(id_col).asc_nulls_first())) + F.col("mix_before")
    rate = F.when(F.col("mix_total") > 0, F.col("mix_target") / F.col("mix_total")).otherwise(0.0)
    offset = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}|"), F.col("mix_src")).cast("binary")), 1, 8), 16, 10).cast("double") / 4294967296.0
    out = d.join(offsets, CELL).withColumn("mix_rank", rank)
    share = lambda r: F.floor(offset + rate * r)
    out = out.withColumn("mix_copies", (share(F.col("mix_rank")) - share(F.col("mix_rank") - 1)).cast("long"))
    return out.select(*docs.columns, "mix_size", "mix_total", "mix_target", "mix_copies")


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: every document as often as the sampling takes it, with ``mix_copy`` from 1."""
    d = copies(docs, **options).where("mix_copies > 0")
    return d.withColumn("mix_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("mix_copies"))))


def op1_mix(spark, sf_dir):
    """Every document with its size, its source's size and target, and the words that the mix takes of it."""
    sized = table(spark, sf_dir, "documents").select("doc_id", "source", word_count(F.col("text")).alias("size"))
    d = copies(materialize(spark, sized, "mix-sizes"), size=F.col("size"))
    return d.select("doc_id", "size", F.col("mix_total").alias("source_size"), F.col("mix_target").alias("target"),
                    (F.col("mix_copies") * F.col("size")).alias("taken"), F.col("mix_copies").alias("copies"))


OP1_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS src, (source IS NULL)::INT AS nul,
                  coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
s AS (SELECT nul, src, sum(size)::BIGINT AS total FROM d GROUP BY ALL),
w AS (SELECT *, 1 + (row_number() OVER (ORDER BY nul, src) - 1) % 3 AS w, 3.0::DOUBLE * total AS cap,
             sum(total) OVER ()::DOUBLE AS everything FROM s),
l AS (SELECT *, cap <= w * ((everything - coalesce(sum(cap) OVER (ORDER BY cap / w, nul, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
             / sum(w) OVER (ORDER BY cap / w, nul, src ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::DOUBLE) AS full_ FROM w),
t AS (SELECT nul, src, total, CASE WHEN full_ THEN cap ELSE
             (everything - sum(CASE WHEN full_ THEN cap ELSE 0 END) OVER ()) / sum(CASE WHEN full_ THEN 0 ELSE w END) OVER ()::DOUBLE * w END AS target,
             ('0x' || substr(md5('17|' || src), 1, 8))::BIGINT::DOUBLE / 4294967296.0 AS u FROM l),
c AS (SELECT *, greatest(0, length(bin(size)) - 6) AS shift FROM d),
r AS (SELECT c.doc_id, size, total, target, u, CASE WHEN total > 0 THEN target / total ELSE 0 END AS rate,
             row_number() OVER (PARTITION BY c.nul, c.src ORDER BY shift * 64 + (size >> shift::INT), coalesce(((c.doc_id % 1024) + 1024) % 1024, 0), size, c.doc_id NULLS FIRST) AS rk
      FROM c JOIN t ON c.nul = t.nul AND c.src = t.src),
k AS (SELECT *, (floor(u + rate * rk) - floor(u + rate * (rk - 1)))::BIGINT AS copies FROM r)
SELECT doc_id, size, total AS source_size, target, copies * size AS taken, copies FROM k
"""
