"""Item counts per label and per-group top-k (A1–A4, L1, L2, L6).

Items (words or n-grams) are exploded with their position, counted per
``(group, item)`` with map-side partial aggregation, and ranked with
``row_number() <= k``, which Catalyst plans as a partial ``WindowGroupLimit``
before the shuffle: each map task sends at most ``k`` rows per group, so a
group holding a third of all rows never lands whole in one task.

N-grams are mostly distinct, so their counts grow with the text. :func:`top_ngrams` deals them out to as many tasks as the
text needs, whatever the session's number of shuffle partitions: each map task adds up the grams of rows of about ``TOKENS`` tokens at
a time (a frequent gram is one row of these), the grams go to a task for each ``CHARS_PER_TASK`` characters, and of a task's
counts only those that can be among a group's top ``k`` are sorted.

Ties keep first-seen order, as ``Counter.most_common`` does: every item carries
``first = min(row_key * 10^9 + position)`` — a DECIMAL(38,0) so the aggregate
stays in the hash aggregate's fixed-width buffer — and ranks by
``(cnt desc, first asc)``.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from ..functions.tokens import tokens

POS_SCALE = 10**9  # positions inside one text (of 2 GB at most) stay below this; with a 28-digit row key the sum has 37 digits

CHARS_PER_TASK = 4_000_000  # of text, whose n-grams one task counts
LEAST_CHARS = 500_000  # of text, that are worth a task
TOKENS = 1_000_000  # whose n-grams a map task adds up at a time
HELD = 100_000  # counts that a task gathers before it picks the most frequent


def first_seen_key(row_key: Column, pos: Column) -> Column:
    """DECIMAL(38,0) key ordering (row_key, pos) lexicographically."""
    return row_key.cast("decimal(38,0)") * F.lit(POS_SCALE).cast("decimal(38,0)") + pos.cast("decimal(38,0)")


def item_counts(
    df: DataFrame,
    items: Column,
    group_col: str = "label",
    row_col: str = "row_id",
    groups: Sequence | None = None,
) -> DataFrame:
    """A1: ``group, item, cnt, first`` — occurrences of each item per group.

    ``items`` is an ARRAY column computed from ``df`` (tokens, n-grams...).
    ``groups`` restricts to known group values (rows of other groups ignored).
    """
    src = df if groups is None else df.where(F.col(group_col).isin(list(groups)))
    exploded = src.select(
        F.col(group_col).alias(group_col),
        F.col(row_col).alias("_row"),
        F.posexplode(items).alias("_pos", "item"),
    )
    return exploded.groupBy(group_col, "item").agg(
        F.count(F.lit(1)).alias("cnt"),
        F.min(first_seen_key(F.col("_row"), F.col("_pos"))).alias("first"),
    )


def _ngram_counts(df: DataFrame, n: int, group_col: str, row_col: str, parts: int) -> DataFrame:
    """:func:`item_counts` of the ``n``-grams of ``tokens``, added up in ``parts`` tasks."""

    def added(b, pa, pc):
        """The grams of some rows: their counts, and row and position where each comes first."""
        words = b.column(2)
        offsets = words.offsets.to_numpy()
        lens = np.diff(offsets)
        many = np.maximum(lens - n + 1, 0)
        row = np.repeat(np.arange(len(lens)), many)
        pos = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
        at = offsets[:-1][row] + pos
        gram = pc.binary_join_element_wise(*[words.values.take(pa.array(at + i)) for i in range(n)], " ")
        rank = pc.rank(b.column(1), sort_keys="ascending", null_placement="at_end", tiebreaker="dense").to_numpy().astype(np.int64) - 1
        held = np.zeros(len(rank), np.int64)
        held[rank] = np.arange(len(rank))  # a row of each rank
        t = pa.table({"g": b.column(0).take(pa.array(row)), "item": gram, "key": rank[row] * POS_SCALE + pos})
        t = t.group_by(["g", "item"], use_threads=False).aggregate([([], "count_all"), ("key", "min")])
        t = t.sort_by([("g", "ascending"), ("item", "ascending")])  # grams that begin alike compress better
        key = t["key_min"].to_numpy()
        cols = [t["g"].combine_chunks(), t["item"].combine_chunks(), t["count_all"].combine_chunks(), b.column(1).take(pa.array(held[key // POS_SCALE])), pa.array(key % POS_SCALE)]
        return pa.RecordBatch.from_arrays(cols, names=[group_col, "item", "cnt", "_row", "_pos"])

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import pyarrow.compute as pc

        for b in batches:
            ends, start = b.column(2).offsets.to_numpy(), 0
            while start < b.num_rows:
                stop = max(start + 1, int(np.searchsorted(ends, ends[start] + TOKENS, side="right")) - 1)
                yield added(b.slice(start, stop - start), pa, pc)
                start = stop

    rows = df.select(group_col, row_col, "tokens")
    schema = StructType([rows.schema[group_col], StructField("item", StringType()), StructField("cnt", LongType()), StructField("_row", rows.schema[row_col].dataType), StructField("_pos", LongType())])
    some = rows.mapInArrow(run, schema).repartition(parts, group_col, "item")
    return some.groupBy(group_col, "item").agg(F.sum("cnt").alias("cnt"), F.min(first_seen_key(F.col("_row"), F.col("_pos"))).alias("first"))


def _leaders(counts: DataFrame, k: int, group_col: str) -> DataFrame:
    """Of each task's ``counts`` the top ``k`` of each group, in the order of :func:`top_k_per_group`."""

    def best(t):
        import pyarrow as pa
        import pyarrow.compute as pc

        t = t.combine_chunks()
        codes = pc.fill_null(pc.dictionary_encode(t[group_col]).combine_chunks().indices, -1)
        cnt = t["cnt"].to_numpy()
        code = codes.to_numpy()
        order = np.lexsort((-cnt, code))  # by count alone: of counts below a group's k-th none can be among its first k
        starts = np.flatnonzero(np.r_[True, code[order][1:] != code[order][:-1]])
        at = np.searchsorted(starts, np.arange(len(order)), side="right") - 1
        sizes = np.diff(np.r_[starts, len(order)])
        least = cnt[order][starts + np.minimum(k, sizes) - 1][at]
        few = np.sort(order[cnt[order] >= least])
        t, code = t.take(pa.array(few)), code[few]
        keys = pa.table({"g": code, "cnt": t["cnt"], "first": t["first"]})
        order = pc.sort_indices(keys, sort_keys=[("g", "ascending"), ("cnt", "descending"), ("first", "ascending")], null_placement="at_start").to_numpy()
        starts = np.flatnonzero(np.r_[True, code[order][1:] != code[order][:-1]])
        rank = np.arange(len(order)) - starts[np.searchsorted(starts, np.arange(len(order)), side="right") - 1]
        return t.take(pa.array(order[rank < k])).to_batches()

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        held, size, least = [], 0, HELD
        for b in batches:
            held.append(b)
            size += b.num_rows
            if size >= least:
                held = best(pa.Table.from_batches(held))
                size = sum(x.num_rows for x in held)
                least = max(HELD, 2 * size)  # a large table is not sorted again for every batch
        if size:
            yield from best(pa.Table.from_batches(held))

    return counts.mapInArrow(run, counts.schema)


def top_ngrams(df: DataFrame, n: int, k: int, group_col: str = "label", row_col: str = "row_id", groups: Sequence | None = None, stopwords=None) -> DataFrame:
    """:func:`top_k_per_group` of the ``n``-grams of ``text``; grams never cross texts, stopwords go first."""
    if k < 1:
        raise ValueError("k must be at least 1")
    chars = df.agg(F.sum(F.length("text").cast("long"))).first()[0] or 0
    parts = max(1, -(-chars // CHARS_PER_TASK), min(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-chars // LEAST_CHARS)))
    src = df if groups is None else df.where(F.col(group_col).isin(list(groups)))
    rows = with_tokens(src.select(group_col, row_col, "text"), stopwords)
    return top_k_per_group(_leaders(_ngram_counts(rows, n, group_col, row_col, parts), k, group_col), k, group_col)


def top_k_per_group(counts: DataFrame, k: int, group_col: str = "label") -> DataFrame:
    """L1: ``group, rank, item, cnt`` for the ``k`` most frequent items of each group."""
    if k < 1:
        raise ValueError("k must be at least 1")
    w = Window.partitionBy(group_col).orderBy(F.col("cnt").desc(), F.col("first").asc())
    ranked = counts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return ranked.select(group_col, F.col("rank").cast("long").alias("rank"), "item", F.col("cnt").cast("long").alias("cnt"))


def top_words_by_label(df: DataFrame, k: int = 25, stopwords=None, labels: Sequence[str] | None = None) -> DataFrame:
    """A2: top ``k`` words per label."""
    return top_k_per_group(item_counts(df, tokens("text", stopwords), groups=labels), k)


def top_ngrams_by_label(
    df: DataFrame, n: int = 2, k: int = 25, stopwords=None, labels: Sequence[str] | None = None
) -> DataFrame:
    """A3: top ``k`` n-grams per label; grams never cross texts, stopwords go first."""
    return top_ngrams(df, n, k, groups=labels, stopwords=stopwords)


def with_tokens(df: DataFrame, stopwords=None, text_col: str = "text") -> DataFrame:
    """Materialise ``tokens`` once as a column; n-gram lambdas then index a column,
    not the whole token chain again for every gram."""
    return df.withColumn("tokens", tokens(text_col, stopwords))


def global_top_k(counts: DataFrame, k: int) -> DataFrame:
    """L6: the ``k`` most frequent items overall; planned as TakeOrderedAndProject."""
    return counts.orderBy(F.col("cnt").desc(), F.col("first").asc()).limit(int(k))


def tokens_per_row(df: DataFrame, stopwords=None) -> DataFrame:
    """T1/T2 per row: ``row_id, n_tokens, tokens`` (tokens joined by one space)."""
    with_tokens = df.select("row_id", tokens("text", stopwords).alias("_t"))
    return with_tokens.select(
        "row_id",
        F.size("_t").cast("long").alias("n_tokens"),
        F.array_join("_t", " ").alias("tokens"),
    )
