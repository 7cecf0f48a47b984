"""The corpus pipeline: documents to packed training sequences.

``STAGES`` lists (name, function) in order. Each function takes (spark, docs, sf_dir) and
returns a DataFrame; the caller writes it as Parquet and hands it, read again, to the next
stage. All but the last return the columns of ``docs`` unchanged, without the rows that the
stage rejects; models are fitted on the rows that the stage gets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark import ship
from quillspark.llm import decontam, langid, neardup, packing, toxicity
from quillspark.llm.common import materialize
from quillspark.llm.queries import table, tokenizer_path

#: A toxic document has at least this probability at the end of the classifier chain.
TOXIC = 0.5
#: A document whose best language has a lower posterior is rejected, as is one without letters.
LEAST_LANGUAGE = 0.5
#: Names for columns that a stage adds for its decision and drops again.
OWN = "__stage_"


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the classifier chain calls toxic; nulls and empty texts stay."""
    ship(spark)
    scored = toxicity.toxic_documents(docs, table(spark, sf_dir, "labels"), prefix=OWN)
    return scored.where(F.col(f"{OWN}toxic") < TOXIC).select(*docs.columns)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter and those that fit no learned language better than the rest."""
    ship(spark)
    predicted = langid.predict(docs, langid.fit(docs), names=(f"{OWN}lang", f"{OWN}score"))
    kept = (F.col(f"{OWN}lang") != langid.UNKNOWN) & (F.col(f"{OWN}score") >= LEAST_LANGUAGE)
    return predicted.where(kept).select(*docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each near-duplicate class: the first of those with its smallest doc_id."""
    ship(spark)
    columns = docs.columns
    # Written once: row numbers must not change between the two uses.
    docs = materialize(docs.withColumn(f"{OWN}row", F.monotonically_increasing_id()))
    classes = neardup.near_duplicates(docs, row_col=f"{OWN}row")
    first = classes.groupBy("class_id", "comp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "row")).alias("m"))
    kept = materialize(first.select(F.col("m.row").alias(f"{OWN}row")))
    return docs.join(kept, f"{OWN}row", "left_semi").select(*columns)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item within 5 % edits."""
    ship(spark)
    return decontam.without_matches(docs, table(spark, sf_dir, "benchmark"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packed sequences of at most 1024 ids: a row for each piece, with its ids."""
    ship(spark)
    return packing.pack(docs, tokenizer_path(), capacity=1024, end_id=0)


STAGES = [
    ("toxicity", toxicity_stage),
    ("language_id", language_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("packing", packing_stage),
]

#: SQL can express neither the fitted models nor the sampling; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written in the shared folder before the next."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
