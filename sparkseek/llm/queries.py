"""The queries of the corpus operators, as the driver registers them."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

TOKENIZER = "byte_bpe_50k.json"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def op1_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(table(spark, sf_dir, "documents"), tokenizer_path(), keep_ids=False)


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontam import contamination

    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .near_dup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), size=2)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import toxicity

    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .common import shared_folder
    from .secrets import digest, scan_with_ledger

    # A ledger for each table outlives the query: texts scanned before are not scanned again.
    name = hashlib.sha256(sf_dir.encode()).hexdigest()[:16]
    return digest(scan_with_ledger(table(spark, sf_dir, "documents"), f"{shared_folder(spark)}/secret-ledger-{name}"))


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .licenses import licenses

    return licenses(table(spark, sf_dir, "documents"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import BASE, judge

    return judge(table(spark, sf_dir, "documents")).select("doc_id", *BASE, "base_failed", "kept", "distance")


def op8_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lm_score import pseudo_likelihood

    return pseudo_likelihood(table(spark, sf_dir, "documents"))


def op9_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .url_rules import judge

    return judge(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_dedup import dedup_lines

    return dedup_lines(table(spark, sf_dir, "documents")).select("doc_id", "lines_seen", "lines_dropped", "text")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in sorted(globals().items()) if name.startswith("op")}


def oracle_sql() -> dict[str, str]:
    return {}
