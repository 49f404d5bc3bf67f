"""M2/M7: Naive Bayes over boolean ``has(word)`` features, as DataFrame algebra.

Estimates follow the expected-likelihood rule (add one half):

* prior ``P(c) = (N_c + 0.5) / (N + 0.5 L)``;
* ``P(has=v | c, w) = (count_{c,w}(v) + 0.5) / (N_c + 0.5 B_w)``, where ``B_w``
  is the number of distinct values ``has(w)`` takes in training (1 when ``w``
  occurs in every training row, else 2).

Training is one aggregation over ``(label, term)`` pairs of the training rows.
The parameter table has a row for each label and vocabulary word; how it meets the
rows to score is left to the optimiser.  A row's score is
``log P(c) + Σ_w log P(False|c,w) + Σ_{w in row} (log P(True|c,w) - log P(False|c,w))``:
only the words a row has are touched (sparse scoring).  The predicted label is
the arg-max; ties go to the larger label value.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def fit(train_bow: DataFrame, train_rows: DataFrame, vocab: DataFrame) -> DataFrame:
    """Parameter table ``label, term, n_c, n_cw, bins, log_p_true, log_p_false, log_prior``.

    ``train_bow``: ``row_id, label, term`` (vocabulary words present); ``train_rows``:
    ``row_id, label``; ``vocab``: ``term``.
    """
    n_cw = train_bow.groupBy("label", "term").agg(F.count(F.lit(1)).alias("n_cw"))
    df_w = n_cw.groupBy("term").agg(F.sum("n_cw").alias("df_w"))
    every = Window.partitionBy(F.lit(0))  # a row for each label
    sizes = train_rows.groupBy("label").agg(F.count(F.lit(1)).alias("n_c")).select(
        "label", "n_c", F.sum("n_c").over(every).alias("n_all"), F.count(F.lit(1)).over(every).alias("n_labels"))
    sizes = sizes.withColumn("log_prior", F.log((F.col("n_c") + 0.5) / (F.col("n_all") + 0.5 * F.col("n_labels"))))
    grid = _with_each(sizes, vocab.select("term"))
    params = (
        grid.join(n_cw, ["label", "term"], "left")
        .join(df_w, "term", "left")
        .fillna(0, ["n_cw", "df_w"])
        .withColumn("bins", F.when(F.col("df_w") >= F.col("n_all"), F.lit(1)).otherwise(F.lit(2)))
    )
    denom = F.col("n_c") + F.lit(0.5) * F.col("bins")
    return params.select(
        "label",
        "term",
        F.col("n_c").cast("long").alias("n_c"),
        F.col("n_cw").cast("long").alias("n_cw"),
        "bins",
        F.log((F.col("n_cw") + 0.5) / denom).alias("log_p_true"),
        F.log((F.col("n_c") - F.col("n_cw") + 0.5) / denom).alias("log_p_false"),
        "log_prior",
    )


def _with_each(df: DataFrame, few: DataFrame) -> DataFrame:
    """Each row of ``df`` with each row of ``few``: a table of words (at most ``top_words``) or of labels, held as one array."""
    one = few.agg(F.collect_list(F.struct(*few.columns)).alias("_few")).withColumn("_one", F.lit(1))
    return df.withColumn("_one", F.lit(1)).join(F.broadcast(one), "_one").select(*df.columns, F.explode("_few").alias("_x")).select(*df.columns, "_x.*")


def scores(params: DataFrame, bow: DataFrame, rows: DataFrame) -> DataFrame:
    """``row_id, label, score`` (natural-log joint likelihood) for every row × label."""
    base = params.groupBy("label").agg((F.first("log_prior") + F.sum("log_p_false")).alias("base"))
    delta = params.select("label", "term", (F.col("log_p_true") - F.col("log_p_false")).alias("delta"))
    gain = bow.select("row_id", "term").join(delta, "term").groupBy("row_id", "label").agg(F.sum("delta").alias("gain"))
    return _with_each(rows.select("row_id"), base).join(gain, ["row_id", "label"], "left").select(
        "row_id", "label", (F.col("base") + F.coalesce(F.col("gain"), F.lit(0.0))).alias("score")
    )


def predict(params: DataFrame, bow: DataFrame, rows: DataFrame) -> DataFrame:
    """``row_id, predicted``: arg-max label per row (ties → larger label)."""
    s = scores(params, bow, rows)
    return s.groupBy("row_id").agg(F.max_by("label", F.struct("score", "label")).alias("predicted"))


def informative_features(params: DataFrame, top_n: int) -> DataFrame:
    """M7: ``rank, term, value, ratio`` — most informative (word, value) pairs.

    For each (word, value) the probability is compared across the labels in
    which that value was observed; ``ratio = max / min``.  Order: min/max
    ascending, then word, then value (false before true).
    """
    if top_n < 1:
        raise ValueError("top_n must be at least 1")
    denom = F.col("n_c") + F.lit(0.5) * F.col("bins")
    p_true = (F.col("n_cw") + F.lit(0.5)) / denom
    p_false = (F.col("n_c") - F.col("n_cw") + F.lit(0.5)) / denom
    both = F.array(
        F.struct(F.lit(True).alias("value"), p_true.alias("p"), (F.col("n_cw") > 0).alias("seen")),
        F.struct(F.lit(False).alias("value"), p_false.alias("p"), (F.col("n_c") - F.col("n_cw") > 0).alias("seen")),
    )
    long = params.select("term", F.explode(both).alias("v")).where(F.col("v.seen"))
    agg = long.groupBy("term", F.col("v.value").alias("value")).agg(F.max("v.p").alias("pmax"), F.min("v.p").alias("pmin"))
    agg = agg.where(F.col("pmin") > 0).withColumn("_k", F.col("pmin") / F.col("pmax"))
    order = [F.col("_k"), F.col("term"), F.col("value").cast("int")]
    top = agg.orderBy(*order).limit(int(top_n))
    w = Window.partitionBy(F.lit(0)).orderBy(*order)  # ≤ top_n rows
    return top.select(
        F.row_number().over(w).cast("long").alias("rank"),
        "term",
        F.col("value").cast("string").alias("value"),
        (F.col("pmax") / F.col("pmin")).alias("ratio"),
    )
