"""Artifacts that people and other jobs exchange: candidate lines, review sheets, and safe tables for spreadsheets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trendloom.functions.reasons import first_reason
from trendloom.functions.text import csv_safe

BOM = "﻿"
CORRUPT = "_corrupt"
#: CSV that keeps every text as it is: quotes doubled, line breaks, blanks and zero bytes inside values kept
SHEET = {"header": True, "quote": '"', "escape": '"', "charToEscapeQuoteEscaping": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False, "encoding": "UTF-8", "emptyValue": "", "nullValue": "\\N"}


def content_hash(columns: list[str]) -> F.Column:
    """SHA-256 of a row as JSON with its fields by name, nulls included."""
    return F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}), 256)


def write_candidates(rows: DataFrame, path: str) -> None:
    """JSON lines with ``candidate_sha256``, the hash of all other fields."""
    rows.withColumn("candidate_sha256", content_hash(rows.columns)).write.option("ignoreNullFields", "false").json(path)


def scan_candidates(spark: SparkSession, path: str, schema: str, key: str = "id") -> DataFrame:
    """Candidate lines with ``reason``: null for accepted rows, else malformed, no_id, hash_mismatch or duplicate_id.

    ``schema`` lists the fields without candidate_sha256. Of an id the row of the smallest content hash is accepted, so the result depends on
    no order of lines; a repeated line is a duplicate. Lines that are no JSON stay in ``_corrupt``, and blank lines are no rows.
    """
    fields = [f.name for f in T.StructType.fromDDL(schema)]
    raw = spark.read.schema(f"{schema}, candidate_sha256 string, {CORRUPT} string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT).json(path)
    raw = raw.withColumn("_own", content_hash(fields)).withColumn("_row", F.monotonically_increasing_id())
    raw = raw.withColumn(
        "reason",
        first_reason((F.col(CORRUPT).isNotNull(), "malformed"), (F.coalesce(F.trim(F.col(key).cast("string")), F.lit("")) == "", "no_id"), (~F.col("candidate_sha256").eqNullSafe(F.col("_own")), "hash_mismatch")),
    )
    good = raw.where("reason is null")
    first = good.groupBy(key).agg(F.min(F.struct("_own", "_row")).alias("_first"))  # map-side, so a frequent id costs one row a task
    good = good.join(first, key).withColumn("reason", F.when(F.struct("_own", "_row") != F.col("_first"), "duplicate_id"))
    return good.select(*fields, CORRUPT, "reason").unionByName(raw.where("reason is not null").select(*fields, CORRUPT, "reason"))


def split_rejects(scanned: DataFrame, path: str, count: bool = False) -> DataFrame:
    """The accepted rows; rejected ones are written to ``path`` with their reasons, for whoever mends them."""
    scanned.where("reason is not null").write.partitionBy("reason").json(path)
    return scanned.where("reason is null").drop("reason", CORRUPT)


def write_sheet(rows: DataFrame, path: str, bom: bool = True) -> None:
    """CSV with a header; texts that a spreadsheet would run as formulas get a leading quote. An empty text is quoted, null is ``\\N``, and a text
    of backslashes and N gets a backslash more, which ``read_sheet`` takes off."""
    marked = lambda x: F.when(x.rlike(r"^\\+N\z"), F.concat(F.lit("\\"), x)).otherwise(csv_safe(x))
    named = rows.select(*[marked(F.col(f.name)).alias(f.name) if isinstance(f.dataType, T.StringType) else F.col(f.name) for f in rows.schema])
    (named.withColumnRenamed(rows.columns[0], BOM + rows.columns[0]) if bom else named).write.options(**SHEET | {"emptyValue": '""'}).csv(path)


def read_sheet(spark: SparkSession, path: str, required: list[str], optional: tuple[str, ...] = ()) -> DataFrame:
    """Rows of CSV files with a header, all as strings: a byte order mark and blanks around names go, a missing optional column is empty, a missing
    required one or a name that comes twice is an error."""
    rows = spark.read.options(**SHEET, multiLine=True, enforceSchema=False).csv(path)
    names = [c.removeprefix(BOM).strip() for c in rows.columns]
    if twice := {n for n in names if names.count(n) > 1}:
        raise ValueError(f"columns that come twice: {', '.join(sorted(twice))}")
    if missing := [c for c in required if c not in names]:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    rows = rows.toDF(*names)
    value = lambda c: F.when(F.col(c).rlike(r"^\\{2,}N\z"), F.expr(f"substring(`{c}`, 2)")).otherwise(F.col(c))
    return rows.select(*[value(c).alias(c) for c in required], *[F.coalesce(value(c), F.lit("")).alias(c) if c in names else F.lit("").alias(c) for c in optional])
