"""Vocabulary (A4) and boolean bag-of-words features (T7, T8).

The vocabulary is the ``top_words`` most frequent tokens over the *training*
rows (total occurrences; ties by first appearance in the seeded training order).
It is bounded by ``top_words``, which is what makes broadcasting it safe.
Feature indices follow the lexicographic order of the words, as a dict
vectorizer fitted on ``has(word)`` keys orders them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .freq import first_seen_key


def vocabulary(train_tokens: DataFrame, top_words: int = 2000, order_col: str = "shuffle_key") -> DataFrame:
    """``term, cnt, freq_rank, feature_index`` for the training rows' top words.

    ``train_tokens`` holds ``tokens`` (ARRAY<STRING>) and ``order_col`` (the
    training order key).  The final ranking runs on at most ``top_words`` rows.
    """
    if top_words < 1:
        raise ValueError("top_words must be at least 1")
    exploded = train_tokens.select(F.col(order_col).alias("_o"), F.posexplode("tokens").alias("_pos", "term"))
    counts = exploded.groupBy("term").agg(
        F.count(F.lit(1)).alias("cnt"), F.min(first_seen_key(F.col("_o"), F.col("_pos"))).alias("_first")
    )
    top = counts.orderBy(F.col("cnt").desc(), F.col("_first").asc()).limit(int(top_words))
    one = Window.partitionBy(F.lit(0))  # the cut table: ≤ top_words rows
    return top.select(
        "term",
        F.col("cnt").cast("long").alias("cnt"),
        F.row_number().over(one.orderBy(F.col("cnt").desc(), F.col("_first").asc())).cast("long").alias("freq_rank"),
        (F.row_number().over(one.orderBy("term")) - 1).cast("long").alias("feature_index"),
    )


def bow_long(rows: DataFrame, vocab: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
    """T7 relational form: ``row_id, term, feature_index`` (and ``carry``) for each vocabulary word a row has.

    The ``has(word) = False`` entries are implicit.  ``vocab`` is bounded by
    ``top_words`` and broadcast.
    """
    words = rows.select("row_id", *carry, F.explode(F.array_distinct("tokens")).alias("term"))
    return words.join(F.broadcast(vocab.select("term", "feature_index")), "term").select("row_id", "term", "feature_index", *carry)


def vocab_terms(vocab: DataFrame) -> list[str]:
    """The vocabulary in feature-index order (bounded by ``top_words``)."""
    return [r["term"] for r in vocab.orderBy("feature_index").select("term").collect()]


def bow_vectors(rows: DataFrame, terms: list[str], input_col: str = "tokens", output_col: str = "features") -> DataFrame:
    """T8: binary SparseVector per row from a fixed vocabulary (no fitting pass)."""
    model = CountVectorizerModel.from_vocabulary(terms, inputCol=input_col, outputCol=output_col, binary=True)
    return model.transform(rows)
