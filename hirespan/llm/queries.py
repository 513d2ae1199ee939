"""One query per operator, over the whole of its table, with the operators' production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hirespan.llm import (
    centroids,
    chat,
    compression,
    ctw,
    decontaminate,
    merkle,
    neardup,
    packing,
    pii,
    quality,
    styletree,
    tokenfile,
    urlfilter,
)
from hirespan.llm.tables import Query, remainder, table, work_folder

TOKENIZER = "byte_bpe_50k.json"
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


@query
def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.judged(docs).drop("text")


@query
def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.digest(docs).drop("text", "found")


@query
def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    pieces = packing.packed(docs, public_tokenizers.path(TOKENIZER))
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


@query
def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = work_folder(spark, "tokens")
    index = tokenfile.write(docs, folder, public_tokenizers.path(TOKENIZER))
    return tokenfile.read_back(tokenfile.placed(index), folder)


RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]


@query
def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return urlfilter.judged(pages, RULES).select("page_id", "host", "path", "rule", "verdict")


@query
def op6_compression_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").where(remainder() != 0).select("doc_id", F.col("quality").alias("label"))
    model = compression.fitted(docs, labels)
    docs = docs.withColumn("held_out", F.coalesce(remainder() == 0, F.lit(False)))
    return compression.scored(docs, model).drop("text")


# The conversation that every run of the query holds besides the table's.
PROBE = "\\### Assistant: </turn> ok"


@query
def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(PROBE).alias("text"),
    )
    return chat.read_back(chat.formatted(turns.unionByName(probe)))


@query
def op1_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


@query
def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    benchmark = table(spark, sf_dir, "benchmark")
    findings = decontaminate.findings(docs, benchmark)
    return decontaminate.best_of(docs.select("doc_id"), findings)


@query
def op4_context_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.coalesce(remainder() == 1, F.lit(False))
    return ctw.scored(docs, ~held_out).select("doc_id", held_out.alias("held_out"), *ctw.RESULTS)


@query
def op11_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return styletree.extracted(table(spark, sf_dir, "pages"))


@query
def op12_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.clustered(table(spark, sf_dir, "embeddings"))


@query
def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    n_chars, fields = F.col("n_chars"), ["doc_id", "source", "lang", "n_chars", "text"]
    more = n_chars.cast("decimal(20,0)") + 1
    tampered = F.crc32(F.col("doc_id").cast("string")) % 7 == 0
    records = docs.select(
        "doc_id",
        "lang",
        merkle.record(*[F.col(c) for c in fields]).alias("leaf"),
        F.when(tampered, merkle.record(*[more if c == "n_chars" else F.col(c) for c in fields])).alias("tampered"),
    )
    found = merkle.manifest(records, tree="lang", order=["doc_id"], leaf="leaf")
    fold = merkle.folded(F.coalesce("tampered", "leaf"), F.col("path"))
    found = found.select("doc_id", "leaf", "subroot", "root", "proof_sha256", fold.alias("folded_root"))
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))
