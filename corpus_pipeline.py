"""The corpus pipeline: five stages, each over all that the one before kept.

Every stage reads doc_id, text, lang, source and n_chars and ignores other columns; an empty table stays empty. Any column may be null and any
doc_id may repeat: documents are rows, told apart by doc_id and text."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notelake.llm import bpe, decontam, dedup, langid, pii
from notelake.llm.common import checkpoint

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: A stage or the whole in SQL: none of its models can be expressed there.
ORACLE_SQL = None


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the language model rejects: no letters (null and empty texts too), or less sure than its calibrated threshold. Rows are
    judged one by one, so repeated rows stay or go together."""
    return langid.identify(docs.select(*COLUMNS), langid.train(docs)).where("not rejected").select(*COLUMNS)


def _row(docs: DataFrame) -> DataFrame:
    """docs with row: a 64-bit hash of doc_id and text, which null and repeated doc_ids have as well."""
    return docs.select(*COLUMNS, F.xxhash64("doc_id", "text").alias("row"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of near-duplicates (five-word shingles, similarity 0.8): that of the smallest doc_id, nulls last.

    Decided by row: rows of one doc_id with different texts are different documents, and of rows with equal doc_id and text one stays (the
    smallest by the other columns). Texts without words are in no group, so all their rows stay."""
    rows = _row(docs)
    ids = rows.select("row", "doc_id").distinct()
    found = dedup.near_duplicates(rows.select(F.col("row").alias("doc_id"), "text")).where("n_shingles > 0")
    found = checkpoint(found.groupBy(F.col("doc_id").alias("row"), "component_id").count().join(ids, "row"))
    first = found.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("x")).select(F.col("x.row").alias("row"))
    gone = found.select("row").join(first, "row", "left_anti")
    again = found.where("count > 1").select("row").join(first, "row", "left_semi")
    if again.isEmpty():
        return rows.join(gone, "row", "left_anti").select(*COLUMNS)
    one = rows.join(again, "row", "left_semi").groupBy("row").agg(F.min(F.struct("lang", "source", "n_chars", "doc_id", "text")).alias("x")).select("x.*")
    return rows.join(gone.unionByName(again), "row", "left_anti").select(*COLUMNS).unionByName(one.select(*COLUMNS))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops rows that hold a ten-word window of a benchmark item. Decided by doc_id (nulls too) and text, so a clean row stays where another
    text of its doc_id goes, and repeated rows stay or go together."""
    found = decontam.contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    hit = found.where("size(hits) > 0").select(F.col("doc_id").alias("d2"), F.col("h").alias("h2")).distinct()
    rows = docs.select(*COLUMNS, F.xxhash64("text").alias("h"))
    return rows.join(hit, (rows.h == hit.h2) & rows.doc_id.eqNullSafe(hit.d2), "left_anti").select(*COLUMNS)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by its kind in brackets, and counts n_chars anew. All rows stay; a null text stays null, with null n_chars."""
    found = pii.find_personal(docs.select(*COLUMNS))
    text = pii.redact(F.coalesce("text", F.lit("")), F.concat("base", "added"))
    return found.withColumn("text", F.when(F.col("text").isNotNull(), text)).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each row, with their number and the digest of what they decode to. All rows stay; a null text has no ids."""
    out = bpe.encode_documents(docs.select("doc_id", "text", "lang", "source"), public_tokenizers.path("word_bpe_49k.json"))
    return out.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("decontaminate", decontaminate), ("personal_data", personal_data), ("encode", encode)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents. What a stage keeps is written to the shared checkpoint folder once, as later stages read it several times."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = checkpoint(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
