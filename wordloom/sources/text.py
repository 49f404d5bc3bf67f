"""Labelled-text scans (S1–S3) and adapters from the driver's tables.

A labelled message file is UTF-8 text, one record per line: the whole line is
stripped, blank lines are skipped, the line is split on its *first* tab and
records that do not give two parts are dropped (so ``"ham\\t"`` disappears,
because stripping runs first).  The CSV reader is not used: texts may start
with a quote character.

Every labelled DataFrame carries ``row_id`` (a numeric key that orders rows as
in the source), ``label`` and ``text``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.tokens import strip_ws

LABELLED_COLUMNS = ("row_id", "label", "text")


def parse_labelled_lines(lines: DataFrame, value_col: str = "value", keep: tuple[str, ...] = ()) -> DataFrame:
    """Apply the record rules to a DataFrame holding one line per row."""
    stripped = lines.select(*keep, strip_ws(F.col(value_col)).alias("_line"))
    parts = stripped.where(F.col("_line") != "").select(*keep, F.split(F.col("_line"), "\t", 2).alias("_p"))
    return parts.where(F.size("_p") == 2).select(
        *keep, F.col("_p").getItem(0).alias("label"), F.col("_p").getItem(1).alias("text")
    )


def with_file_order_id(lines: DataFrame) -> DataFrame:
    """Add ``row_id``: the 0-based position of each line in file order.

    Spark packs file splits into partitions by size, so the raw
    ``monotonically_increasing_id`` is not file order across splits.  Lines are
    keyed by (file path, split start, offset inside the split); the per-split
    row counts (one row per split, bounded by input size / split size) give
    exact global offsets without moving any line through one task.
    """
    tagged = lines.select(
        "*",
        F.col("_metadata.file_path").alias("_fp"),
        F.col("_metadata.file_block_start").alias("_bs"),
        F.monotonically_increasing_id().alias("_mid"),
    )
    splits = tagged.groupBy("_fp", "_bs").agg(F.min("_mid").alias("_m0"), F.count(F.lit(1)).alias("_n"))
    order = Window.orderBy("_fp", "_bs").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.select(
        "_fp", "_bs", "_m0", F.coalesce(F.sum("_n").over(order), F.lit(0)).alias("_off")
    )
    out = tagged.join(splits, ["_fp", "_bs"]).withColumn(
        "row_id", (F.col("_off") + F.col("_mid") - F.col("_m0")).cast("long")
    )
    return out.drop("_fp", "_bs", "_mid", "_m0", "_off")


def read_labelled_text(spark: SparkSession, path: str, limit: int = 0) -> DataFrame:
    """S1+S2+S3: ``row_id, label, text`` from tab-separated labelled text files."""
    lines = with_file_order_id(spark.read.text(path))
    out = parse_labelled_lines(lines, keep=("row_id",)).select(*LABELLED_COLUMNS)
    return head(out, limit)


def head(df: DataFrame, limit: int, order_col: str = "row_id") -> DataFrame:
    """S3: first ``limit`` rows in source order; 0 keeps all rows."""
    if limit and limit > 0:
        return df.orderBy(order_col).limit(int(limit))
    return df


# ------------------------------------------------------------ driver tables
def load_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def load_text_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A text table; how it is split is the reader's business (``spark.sql.files.maxPartitionBytes``)."""
    return load_table(spark, sf_dir, name)


def documents_by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as labelled text: label = language, key = doc_id."""
    docs = load_text_table(spark, sf_dir, "documents")
    return docs.select(F.col("doc_id").alias("row_id"), F.col("lang").alias("label"), "text")


def conversations_by_role(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns as labelled text: label = role, key orders by (conv_id, turn)."""
    conv = load_text_table(spark, sf_dir, "conversations")
    return conv.select(conversation_key(F.col("conv_id"), F.col("turn")).alias("row_id"), F.col("role").alias("label"), "text")


def conversation_key(conv_id: Column, turn: Column) -> Column:
    """Numeric key ordered like (conv_id, turn); turns stay below 10^9."""
    return conv_id.cast("decimal(38,0)") * F.lit(10**9).cast("decimal(38,0)") + turn.cast("decimal(38,0)")


TOXIC_LABELS = ("clean", "toxic")


def documents_by_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents for the classifiers: label = toxic/clean from ``labels``."""
    docs = load_text_table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = load_table(spark, sf_dir, "labels").select("doc_id", "toxic")
    return docs.join(labels, "doc_id").select(
        F.col("doc_id").alias("row_id"),
        F.when(F.col("toxic") == 1, F.lit("toxic")).otherwise(F.lit("clean")).alias("label"),
        "text",
    )
