"""The corpus pipeline: language ID, near-dedup, decontamination, secret scans, packing.

Every stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept. The filtering stages and the
redaction return the columns of documents; the last one returns packed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trendloom.llm import decontaminate, langid, packing, secrets, similar
from trendloom.llm.common import materialize, table

KEY = "near_dedup_key"  #: of a text, while groups are formed


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose language the classifier accepts; a text without letters is rejected."""
    return langid.keep_known(docs)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near duplicates, five words a shingle and a similarity of 0.8: that of the smallest doc_id, rows
    without id last, then of the smallest text hash; a repeated row once.

    A row is known by its id and its text, so different texts of one id stay, and rows without id are compared like others.
    """
    key = F.xxhash64(F.coalesce(F.col("text"), F.lit("")))
    parts = similar.classes(docs.select(key.alias("doc_id"), "text")).select(F.col("id").alias("key"), "component").distinct()
    rows = docs.select(key.alias("key"), F.col("doc_id").alias("id")).join(materialize(parts), "key")
    first = rows.groupBy("component").agg(F.min(F.struct(F.col("id").isNull().alias("unnamed"), "id", "key")).alias("first"))
    chosen = materialize(first.select("first.id", "first.key"))
    kept = docs.withColumn(KEY, key).join(chosen, (F.col(KEY) == chosen["key"]) & F.col("doc_id").eqNullSafe(chosen["id"]), "left_semi")
    return kept.dropDuplicates([KEY, "doc_id"]).select(docs.columns)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that contain no test item."""
    return decontaminate.remove(docs, table(spark, sf_dir, "benchmark"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, secrets replaced by the name of their kind; n_chars follows a changed text."""
    clean = secrets.redact(docs, ledger=secrets.ledger_of(spark, sf_dir))
    if "n_chars" in docs.columns:
        clean = clean.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.length("text").cast(docs.schema["n_chars"].dataType)))
    return clean.select(docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences."""
    return packing.pack(docs)


STAGES = [
    ("language_id", known_language),
    ("near_dedup", one_of_each_group),
    ("decontamination", without_benchmark),
    ("secret_scans", without_secrets),
    ("packing", packed),
]

#: Hashes, a trained model and a tokenizer are beyond SQL; a test holds the stages to a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs


def queries() -> dict:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
