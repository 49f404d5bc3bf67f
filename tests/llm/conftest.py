import pytest
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
                     T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])


@pytest.fixture
def make_docs(spark):
    """A documents table from ``(doc_id, text[, source[, lang]])`` rows."""

    def make(rows):
        full = [(r[0], r[1], r[3] if len(r) > 3 else None, r[2] if len(r) > 2 else None, len(r[1]) if r[1] is not None else None) for r in rows]
        return spark.createDataFrame(full, DOCS)

    return make


@pytest.fixture
def as_dir(tmp_path):
    """Write tables as ``<dir>/<name>.parquet`` and give the folder."""

    def write(**tables):
        for name, df in tables.items():
            df.write.parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return write
