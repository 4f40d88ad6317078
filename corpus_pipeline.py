"""The corpus pipeline: quality rules, line dedup, near-dedup, decontamination, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept;
all but the last return the columns of ``documents``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkseek.llm import common, decontam, line_dedup, near_dup, packing, quality, queries


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules and the outlier test keep.

    Null and empty texts have no words and go.  Rows that share a doc_id are judged
    each by its own text, language and source; a null doc_id is as good as any.
    """
    rejected = quality.judge(docs).where(~F.col("kept")).select("doc_id", "row_hash").distinct()
    same = F.col("d.doc_id").eqNullSafe(F.col("r.doc_id")) & (F.col("d.__row_hash") == F.col("r.row_hash"))
    rows = docs.withColumn("__row_hash", quality.row_hash()).alias("d").join(rejected.alias("r"), same, "left_anti")
    return rows.select(*[F.col(f"`{c}`") for c in docs.columns])


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without superfluous lines; a document left without any line goes.

    Null, empty and blank texts have no line to lose and stay.
    """
    rows = line_dedup.dedup_lines(docs).where((F.col("lines_dropped") == 0) | (F.col("lines_dropped") < F.col("lines_seen")))
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.when(F.col("lines_dropped") == 0, F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    return rows.select(docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies.

    Documents without words and those with a null doc_id stay.  Rows that share a
    doc_id are one document and stay or go together.
    """
    gone = near_dup.near_duplicates(docs).where(~F.col("kept")).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark; null and empty texts stay."""
    return decontam.decontaminate(docs, queries.table(spark, sf_dir, "benchmark"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of every piece of every document; a null text is an empty one."""
    return packing.pack(docs, queries.tokenizer_path(), keep_ids=False)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup_stage),
    ("near-dedup", near_dedup),
    ("decontamination", decontamination),
    ("best-fit packing", best_fit_packing),
]

#: Outliers, banding, alignment and tokenisation are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written as Parquet and reread."""
    docs = queries.table(spark, sf_dir, "documents")
    folder = f"{common.shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for i, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}")
        docs = spark.read.parquet(f"{folder}/{i}")
    return STAGES[-1][1](spark, docs, sf_dir)
