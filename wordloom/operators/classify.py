"""Classifier metrics (A5, A6), linear models (M3, M4), their optimality check and metric series (M8)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import LogisticRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import svm

# Classifier ids and display names of the reference.
CLASSIFIER_NAMES = {
    "naive_bayes": "Naive Bayes",
    "svm": "Linear SVM",
    "logistic_regression": "Logistic Regression",
}
# Accepted spellings of each classifier id.
CLASSIFIER_ALIASES = {
    "nb": "naive_bayes",
    "naivebayes": "naive_bayes",
    "naive-bayes": "naive_bayes",
    "logreg": "logistic_regression",
    "logistic": "logistic_regression",
    "logisticregression": "logistic_regression",
    "logistic-regression": "logistic_regression",
    "linear_svm": "svm",
    "linear-svm": "svm",
}


def normalize_classifier_id(name: str) -> str:
    """Trim, lower-case, spaces → underscores, then resolve aliases; unknown ids fail."""
    token = name.strip().lower().replace(" ", "_")
    token = CLASSIFIER_ALIASES.get(token, token)
    if token not in CLASSIFIER_NAMES:
        raise ValueError(f"unknown classifier {name!r}; supported: {sorted(CLASSIFIER_NAMES)}")
    return token


def _ratio(num: Column, den: Column) -> Column:
    return F.when(den > 0, num / den).otherwise(F.lit(0.0))


def confusion_metrics(pred: DataFrame, positive_label: str, group_cols: Sequence[str] = ("classifier_id",)) -> DataFrame:
    """A5+A6 in one aggregation: ``group…, accuracy, precision, recall, f1, correct, total, tp, fp, fn``.

    ``pred`` holds ``label`` (truth) and ``predicted``.  Zero denominators give 0.0.
    """
    pos = F.lit(positive_label)
    c = pred.groupBy(*group_cols).agg(
        F.count(F.lit(1)).alias("total"),
        F.sum(F.when(F.col("predicted") == F.col("label"), 1).otherwise(0)).alias("correct"),
        F.sum(F.when((F.col("predicted") == pos) & (F.col("label") == pos), 1).otherwise(0)).alias("tp"),
        F.sum(F.when((F.col("predicted") == pos) & (F.col("label") != pos), 1).otherwise(0)).alias("fp"),
        F.sum(F.when((F.col("predicted") != pos) & (F.col("label") == pos), 1).otherwise(0)).alias("fn"),
    )
    p = _ratio(F.col("tp"), F.col("tp") + F.col("fp"))
    r = _ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return c.select(
        *group_cols,
        _ratio(F.col("correct"), F.col("total")).alias("accuracy"),
        p.alias("precision"),
        r.alias("recall"),
        _ratio(F.lit(2.0) * p * r, p + r).alias("f1"),
        *[F.col(x).cast("long").alias(x) for x in ("correct", "total", "tp", "fp", "fn")],
    )


def _label_index(labels: Sequence[str]) -> Column:
    return (F.array_position(F.array(*[F.lit(x) for x in labels]), F.col("label")) - 1).cast("double")


def fit_logistic(train: DataFrame, labels: Sequence[str], n_train: int, features_col: str = "features"):
    """M4: L2-penalised logistic regression with C = 1: Spark scales the data term by 1/n, so ``regParam = 1/n_train``; no standardisation."""
    est = LogisticRegression(featuresCol=features_col, labelCol="label_idx", regParam=1.0 / max(int(n_train), 1), elasticNetParam=0.0,
                             standardization=False, maxIter=1000, tol=1e-10)
    return est.fit(train.select("row_id", features_col, _label_index(labels).alias("label_idx")))


def fit_predict_linear(
    train: DataFrame,
    test: DataFrame,
    algorithm: str,
    labels: Sequence[str],
    n_train: int,
    features_col: str = "features",
) -> DataFrame:
    """M3/M4: fit on ``train`` (``features``, ``label``) and predict ``test``.

    Returns ``row_id, label, predicted``.
    """
    labels = list(labels)
    if algorithm == "svm":
        return svm.fit(train, labels, features_col).predict(test, features_col)
    if algorithm != "logistic_regression":
        raise ValueError(f"not a linear classifier: {algorithm}")
    out = fit_logistic(train, labels, n_train, features_col).transform(test.select("row_id", "label", features_col))
    label_arr = F.array(*[F.lit(x) for x in labels])
    return out.select("row_id", "label", F.element_at(label_arr, F.col("prediction").cast("int") + 1).alias("predicted"))


def residual_gradient(bow: DataFrame, rows: DataFrame, weights: DataFrame, positive_label: str, algorithm: str) -> DataFrame:
    """Gradient of a two-label linear model's objective at its weights, by joins over the relational features.

    ``bow`` holds ``row_id, term`` of the training rows, ``rows`` their ``row_id, label``, ``weights`` ``term, weight`` with the
    intercept under a null term.  Returns ``term, gradient`` for each row of ``weights``: zero at the optimum.  It shares
    no code with the solvers.  ``weights`` is bounded by the vocabulary.
    """
    intercept = weights.where(F.col("term").isNull()).agg(F.first("weight").alias("_b"))  # one row
    sums = bow.join(weights, "term").groupBy("row_id").agg(F.sum("weight").alias("_s"))
    decision = F.coalesce(F.col("_s"), F.lit(0.0)) + F.col("_b")
    truth = F.col("label") == F.lit(positive_label)
    if algorithm == "svm":
        sign = F.when(truth, 1.0).otherwise(-1.0)
        slope = -2.0 * sign * F.greatest(1.0 - sign * decision, F.lit(0.0))
    elif algorithm == "logistic_regression":
        slope = 1.0 / (1.0 + F.exp(-decision)) - truth.cast("double")
    else:
        raise ValueError(f"not a linear classifier: {algorithm}")
    slopes = rows.join(sums, "row_id", "left").join(F.broadcast(intercept)).select("row_id", slope.alias("_slope"))
    by_term = bow.join(slopes, "row_id").groupBy("term").agg(F.sum("_slope").alias("_g"))
    overall = slopes.agg(F.lit(None).cast("string").alias("term"), F.sum("_slope").alias("_g"))
    free = F.lit(0.0) if algorithm == "logistic_regression" else F.col("weight")  # the penalty on the intercept
    penalty = F.when(F.col("term").isNull(), free).otherwise(F.col("weight"))
    found = weights.alias("w").join(by_term.unionByName(overall).alias("g"), F.expr("w.term <=> g.term"), "left")
    return found.select(F.col("w.term").alias("term"), F.col("weight"), F.coalesce("_g", F.lit(0.0)).alias("_g")).select(
        "term", (penalty + F.col("_g")).alias("gradient"))


def metric_series(metrics: DataFrame, name_col: str = "classifier_id",
                  metrics_cols: Sequence[str] = ("accuracy", "precision", "recall", "f1")) -> DataFrame:
    """M8: long form ``name, metric, value`` (null values become 0.0, as in the chart)."""
    stack = ", ".join(f"'{m}', CAST({m} AS DOUBLE)" for m in metrics_cols)
    return metrics.selectExpr(name_col, f"stack({len(metrics_cols)}, {stack}) AS (metric, value)").select(
        name_col, "metric", F.coalesce(F.col("value"), F.lit(0.0)).alias("value")
    )
