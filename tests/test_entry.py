import __spark_entry__ as entry


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.columns == ["label", "rank", "item", "cnt"]
    assert df.count() > 0


def test_every_query_has_a_name_and_oracles_are_known_queries():
    qs, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(qs)
    assert len(qs) >= 40
