"""A corpus-cleaning pipeline over ``documents``: each stage works on all that the one before kept.

Stages: quality rules (rejected documents go), line dedup (texts keep the lines that stay), SimHash near-dedup (the document with the
smallest doc_id of each component stays), benchmark decontamination (documents that overlap with an item go), byte-level BPE
(adds ids and the text decoded from them). All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from thicket.llm import bpe, decontaminate, line_dedup, quality_rules, simhash
from thicket.llm.common import free_name, materialize, tuned
from thicket.llm.queries import PATTERN, VOCABULARY


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep. Null, empty and short texts fail the base rules; the verdict of equal texts is the same."""
    tuned(spark)
    return quality_rules.kept(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that many documents share; n_chars follows the text. A text that loses all its lines is empty."""
    tuned(spark)
    shorter = line_dedup.dedup(docs)
    dropped = free_name(docs, "n_dropped")
    if "n_chars" in docs.columns:
        shorter = shorter.withColumn("n_chars", F.when(F.col(dropped) > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return shorter.select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component: that with the smallest doc_id. Of rows that share this doc_id, all stay; rows without one too."""
    tuned(spark)
    copy = free_name(docs, "copy")
    found = simhash.near_duplicates(docs).where("doc_id IS NOT NULL AND doc_id != component_id").select(F.col("doc_id").alias(copy)).distinct()
    return docs.join(found, F.col("doc_id") == F.col(copy), "left_anti")


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap with no benchmark item. Rows without a doc_id, and null and empty texts, stay."""
    tuned(spark)
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' ids, their number, and the text decoded from the ids, in place of the text; a null text becomes an empty one.

    The columns ids and n_tokens get underscores before them where the table has such columns already.
    """
    tuned(spark)
    ranks = VOCABULARY("byte_bpe_multi_50k.tiktoken")
    coded = bpe.encode(docs, ranks, PATTERN)
    ids = coded.columns[-1]
    decoded = bpe.decode(coded.drop("text"), ranks, PATTERN, ids)
    text, n_tokens = decoded.columns[-1], free_name(coded, "n_tokens")
    return decoded.withColumns({n_tokens: F.size(ids).cast("long"), "text": F.col(text).cast("string")}).drop(text)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("lines", lines),
    ("near_duplicates", near_duplicates),
    ("decontaminated", decontaminated),
    ("tokens", tokens),
]

#: Perplexity, fingerprints and BPE are not for SQL; tests hold each stage against a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each returns is written to the shared folder and read again."""
    docs = tuned(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
