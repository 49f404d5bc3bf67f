import duckdb
import pytest

from wordloom.functions.tokens import duck_ngrams, duck_tokens, ngrams, tokens

CASES = [
    ("don't can't it's", ["do", "ca", "it"]),
    ("cannot gonna", ["can", "not", "gon", "na"]),
    ("crazy.. ok", ["crazy", "ok"]),
    ("1,000 3.5 £100 free-msg a/b", []),
    ("a,b", ["a", "b"]),
    ("", []),
    ("?!... ,;", []),
    ("Hello World. Bye", ["hello", "world", "bye"]),
    ("«quoted» (paren) [x] {y}", ["quoted", "paren", "x", "y"]),
    ("tab\there nbsp", ["tab", "here", "nbsp"]),
    ("Ünïcödé WÖRDS ok", ["ünïcödé", "wörds", "ok"]),
]


@pytest.mark.parametrize("text,expected", CASES)
def test_tokens_match_spec_and_duckdb(spark, text, expected):
    got = spark.createDataFrame([(text,)], "t string").select(tokens("t").alias("x")).first()["x"]
    assert got == expected
    duck = duckdb.sql(f"SELECT {duck_tokens('t')} FROM (SELECT $${text}$$ AS t)").fetchall()[0][0]
    assert duck == expected


def test_stopwords_removed_after_lowercase(spark):
    got = spark.createDataFrame([("The cat and THE dog",)], "t string").select(tokens("t", True).alias("x")).first()["x"]
    assert got == ["cat", "dog"]


def test_ngrams_edges(spark):
    df = spark.createDataFrame([(["a", "b", "c"],), (["a"],), ([],)], "t array<string>")
    rows = [r["g"] for r in df.select(ngrams("t", 2).alias("g")).collect()]
    assert rows == [["a b", "b c"], [], []]
    assert [r["g"] for r in df.select(ngrams("t", 1).alias("g")).collect()][0] == ["a", "b", "c"]
    duck = duckdb.sql(f"SELECT {duck_ngrams('t', 2)} FROM (SELECT ['a','b','c'] AS t)").fetchall()[0][0]
    assert duck == ["a b", "b c"]


def test_grams_across_removed_stopwords(spark):
    df = spark.createDataFrame([("cat and dog",)], "t string")
    g = df.select(ngrams(tokens("t", True), 2).alias("g")).first()["g"]
    assert g == ["cat dog"]


def test_one_very_long_token_is_linear(spark):
    import time

    df = spark.createDataFrame([("a" * 1_000_000 + " b-c d",)], "t string")
    df.select(tokens("t")).collect()
    began = time.perf_counter()
    got = df.select(tokens("t").alias("t")).first()["t"]
    assert [len(x) for x in got] == [1_000_000, 1] and time.perf_counter() - began < 2
