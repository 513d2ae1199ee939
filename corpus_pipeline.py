"""A corpus pipeline: each stage works on all that the one before it kept, as a written table.

Quality rules, near-duplicates, benchmark passages, personal data, packing. Each stage calls one operator
of ``hirespan.llm``; its decisions take effect, and all but the last return the columns of documents.

Defined results: null and empty texts fail the quality rules. Of rows with equal ids the least stays behind
the near-duplicate stage; rows without an id are held against each other by equal text only. An empty table gives
no pieces. Columns beyond those of documents are carried on to the last stage, which does not look at them.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hirespan.llm import decontaminate, neardup, packing, pii, quality
from hirespan.llm.queries import TOKENIZER
from hirespan.llm.tables import table, written

SHINGLE_WORDS, SIMILAR = 5, 80


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality.passing(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id stays."""
    groups = neardup.near_duplicates(docs, width=SHINGLE_WORDS, share=SIMILAR)
    kept = docs.join(groups.where("kept").select("doc_id").distinct(), "doc_id", "left_semi")
    return _least(kept, "doc_id").unionByName(_least(docs.where("doc_id is null"), "text"))


def _least(docs: DataFrame, key: str) -> DataFrame:
    """The least row of each key, by the columns in order; the same one in every run."""
    rest = [c for c in docs.columns if c != key]
    least = docs.groupBy(key).agg(F.min(F.struct(*rest)).alias("row"))
    return least.select(*[F.col(c) if c == key else F.col("row").getField(c).alias(c) for c in docs.columns])


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    found = decontaminate.findings(docs, table(spark, sf_dir, "benchmark"))
    found = written(found.select("doc_id").distinct(), "contaminated")
    return docs.join(found, "doc_id", "left_anti").select(*docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind; ``n_chars`` follows the new text."""
    out = pii.redacted(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids cut into pieces that fill sequences."""
    pieces = packing.packed(docs, public_tokenizers.path(TOKENIZER))
    return pieces.withColumn("ids_crc32", F.crc32("ids")).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"
    )


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("benchmark_passages", benchmark_passages),
    ("personal_data", personal_data),
    ("packing", packed),
]
#: Tokens and latent semantic retrieval are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
