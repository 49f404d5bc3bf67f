import math

from wordloom.operators import classify, naive_bayes


def test_metrics_zero_denominators(spark):
    pred = spark.createDataFrame([("a", "ham", "ham"), ("a", "ham", "ham")], "classifier_id string, label string, predicted string")
    r = classify.confusion_metrics(pred, "spam").first()
    assert (r["accuracy"], r["precision"], r["recall"], r["f1"], r["correct"], r["total"]) == (1.0, 0.0, 0.0, 0.0, 2, 2)
    empty = spark.createDataFrame([], "classifier_id string, label string, predicted string")
    assert classify.confusion_metrics(empty, "spam").count() == 0


def test_metrics_values(spark):
    pred = spark.createDataFrame([("a", "spam", "spam"), ("a", "ham", "spam"), ("a", "spam", "ham"), ("a", "ham", "ham")],
                                 "classifier_id string, label string, predicted string")
    r = classify.confusion_metrics(pred, "spam").first()
    assert (r["tp"], r["fp"], r["fn"]) == (1, 1, 1)
    assert math.isclose(r["f1"], 0.5)


def test_naive_bayes_bins_and_absent_word(spark):
    rows = spark.createDataFrame([(0, "ham"), (1, "ham"), (2, "spam")], "row_id long, label string")
    bow = spark.createDataFrame([(0, "ham", "all"), (1, "ham", "all"), (2, "spam", "all"), (0, "ham", "hamonly")],
                                "row_id long, label string, term string")
    vocab = spark.createDataFrame([("all",), ("hamonly",)], "term string")
    p = {(r["label"], r["term"]): r for r in naive_bayes.fit(bow, rows, vocab).collect()}
    # 'all' is in every training row: one observed value, so P(True|c) = 1
    assert p[("ham", "all")]["bins"] == 1 and math.isclose(math.exp(p[("ham", "all")]["log_p_true"]), 1.0)
    # 'hamonly' never occurs in spam: (0 + .5) / (1 + 1)
    assert math.isclose(math.exp(p[("spam", "hamonly")]["log_p_true"]), 0.25)
    assert math.isclose(math.exp(p[("ham", "hamonly")]["log_prior"]), (2 + 0.5) / (3 + 1.0))
    pred = {r["row_id"]: r["predicted"] for r in naive_bayes.predict(naive_bayes.fit(bow, rows, vocab), bow, rows).collect()}
    assert pred[0] == "ham"


def test_classifier_aliases():
    assert classify.normalize_classifier_id(" Naive Bayes ") == "naive_bayes"
    assert classify.normalize_classifier_id("logreg") == "logistic_regression"
    assert classify.normalize_classifier_id("linear-svm") == "svm"
