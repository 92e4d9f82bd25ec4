"""Secret scans over an incremental blob ledger, in DataFrame functions only.

Every version of a document is a blob under its SHA-256. Only pairs of blob and rule version that the ledger lacks are
scanned, each blob once however many paths hold it, and the findings are joined back to all paths.
"""

from __future__ import annotations

import hashlib
import uuid
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import keep, shared_folder
from .spans import places, spans

FOUND = "array<struct<start:int,end:int>>"
LEDGER = f"blob string, rule string, version int, digest string, found {FOUND}"


@dataclass(frozen=True)
class Rule:
    """A pattern with its version; ``group`` of a match needs ``least`` characters, other matches are dropped."""

    name: str
    pattern: str
    group: int = 0
    least: int = 0
    version: int = 1
    base: bool = False

    @property
    def digest(self) -> str:
        """Of all that decides what the rule finds: an edited rule is another one, whatever its version says."""
        return hashlib.sha256("\x1f".join([self.pattern, str(self.group), str(self.least)]).encode()).hexdigest()[:16]

    @property
    def key(self) -> str:
        return f"{self.name}:{self.version}:{self.digest}"

    def find(self, text: Column) -> Column:
        found = spans(text, self.pattern)
        if self.least:
            found = F.filter(found, lambda s: F.length(F.regexp_extract(s["hit"], self.pattern, self.group)) >= self.least)
        return places(found)


#: In the order of kinds. A hex or access run is maximal, so a least length inside the pattern finds the same matches.
RULES = (
    Rule(
        "assign",
        "((?i)password|passwd|secret|token|api_?key)[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
        group=2, least=12, base=True,
    ),
    Rule("access", "AKIA[A-Z0-9]{14,}", base=True),
    Rule("hex", "[0-9a-f]{16,}", base=True),
    Rule("github", "gh[opsur]_[A-Za-z0-9]{36,}"),
    Rule("slack", "xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", "eyJ[A-Za-z0-9_-]{10,}\\.[A-Za-z0-9_-]{10,}\\.[A-Za-z0-9_-]{5,}"),
    Rule("private_key", "-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
)


def blob_id(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def scan(docs: DataFrame, rules=RULES, ledger: DataFrame | None = None, text_col: str = "text") -> DataFrame:
    """The ledger after this run: (blob, rule, version, digest, found), one row per blob and rule version.

    ``ledger``: rows of earlier runs, which are kept and not scanned again. Null texts are the empty blob.
    """
    new = unseen(docs, rules, ledger, text_col)
    return new if ledger is None else ledger.select("blob", "rule", "version", "digest", "found").unionByName(new)


def unseen(docs: DataFrame, rules=RULES, ledger: DataFrame | None = None, text_col: str = "text") -> DataFrame:
    """(blob, rule, version, digest, found) of the pairs of blob and rule version that ``ledger`` lacks."""
    blobs = docs.select(blob_id(F.col(text_col)).alias("blob"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).dropDuplicates(["blob"])
    if ledger is None:
        blobs = blobs.withColumn("seen", F.array().cast("array<string>"))
    else:
        known = ledger.groupBy("blob").agg(F.collect_set(F.concat_ws(":", "rule", "version", "digest")).alias("seen"))
        blobs = blobs.join(known, "blob", "left").withColumn("seen", F.coalesce("seen", F.array().cast("array<string>")))
    each = [
        F.struct(
            F.lit(r.name).alias("rule"), F.lit(r.version).alias("version"), F.lit(r.digest).alias("digest"),
            F.when(~F.array_contains("seen", r.key), r.find(F.col("text"))).alias("found"),
        )
        for r in rules
    ]
    return blobs.select("blob", F.inline(F.array(*each))).where("found is not null")


def ledger_of(spark: SparkSession, corpus: str) -> str:
    """Where the ledger of a corpus is: at ``spark.trendloom.ledger`` if set, else in the shared folder, one for each corpus path.

    The shared folder lives as long as the application; a ledger for later applications needs the setting.
    """
    return spark.conf.get("spark.trendloom.ledger", None) or f"{shared_folder(spark)}/ledger-{hashlib.sha256(corpus.encode()).hexdigest()}"


def stored(spark: SparkSession, path: str) -> DataFrame | None:
    """The ledger at ``path``; none before its first run."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)
    return spark.read.schema(LEDGER).parquet(path) if there else None


def findings(docs: DataFrame, rules=RULES, text_col: str = "text", ledger: str | None = None) -> DataFrame:
    """(blob, one array of spans for each rule) of the blobs in which a rule found something.

    ``ledger``: path of the ledger table. Pairs it lacks are scanned and added to it; without a path, the ledger is new.
    """
    spark = docs.sparkSession
    path = ledger or f"{shared_folder(spark)}/{uuid.uuid4().hex}.parquet"
    unseen(docs, rules, stored(spark, path), text_col).write.mode("append").option("compression", "zstd").parquet(path)
    hits = stored(spark, path).where(F.size("found") > 0)
    now = {r.name: (F.col("rule") == r.name) & (F.col("version") == r.version) & (F.col("digest") == r.digest) for r in rules}
    empty = F.array().cast(FOUND)
    found = hits.where(reduce(lambda a, b: a | b, now.values())).groupBy("blob").agg(
        *[F.coalesce(F.first(F.when(now[r.name], F.col("found")), ignorenulls=True), empty).alias(r.name) for r in rules]
    )
    # kept as a table: a join with it can split the many paths of one blob
    return keep(found)


def tagged(found: Column, kind: int) -> Column:
    return F.transform(found, lambda s: F.struct(s["start"].alias("start"), F.lit(kind).alias("kind"), s["end"].alias("end")))


def joined(rules, columns: dict[str, Column]) -> Column:
    """All spans by start, then in the order of the rules, comma-joined."""
    every = F.concat(*[tagged(columns[r.name], i) for i, r in enumerate(rules)])
    names = F.array(*[F.lit(r.name) for r in rules])
    return F.array_join(
        F.transform(F.array_sort(every), lambda s: F.concat(F.element_at(names, s["kind"] + 1), F.lit(":"), s["start"], F.lit(":"), s["end"])), ","
    )


def per_document(docs: DataFrame, rules=RULES, text_col: str = "text", ledger: str | None = None) -> DataFrame:
    """One row for each row of ``docs``: doc_id, counts, digest and list of spans.

    Null and empty texts have no findings; repeated rows and copies repeat the findings of their one blob; the match
    that starts first wins within a kind, and kinds may overlap. An empty table gives an empty result; further columns
    are ignored.
    """
    paths = docs.select("doc_id", blob_id(F.col(text_col)).alias("blob"))
    rows = paths.join(findings(docs, rules, text_col, ledger), "blob", "left")
    arrays = {r.name: F.coalesce(F.col(r.name), F.array().cast(FOUND)) for r in rules}
    base = [r for r in rules if r.base]
    return rows.select(
        "doc_id",
        *[F.size(arrays[r.name]).cast("long").alias(f"n_{r.name}") for r in base],
        F.sha2(joined(base, arrays), 256).alias("base_sha256"),
        joined(rules, arrays).alias("spans"),
    )


def redact(docs: DataFrame, rules=RULES, text_col: str = "text", ledger: str | None = None) -> DataFrame:
    """``docs`` with every found span replaced by its kind in brackets, in all rows that hold the blob; same columns.

    Overlapping spans become one, named after the rule that comes first. Other columns and rows stay as they are.
    """
    found = findings(docs, rules, text_col, ledger)
    every = F.array_sort(F.concat(*[tagged(F.col(r.name), i) for i, r in enumerate(rules)]))
    names = F.array(*[F.lit(f"[{r.name}]") for r in rules])
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    # one plan at every size: the findings grow with the corpus, so they are merged and never broadcast
    hits = found.select("blob", every.alias("spans")).hint("merge")
    rows = docs.select(whole.alias("row"), blob_id(F.col(text_col)).alias("blob")).join(hits, "blob", "left")

    def step(acc: Column, s: Column) -> Column:
        fresh = s["start"] >= acc["at"]
        piece = F.concat(F.substring(acc["text"], acc["at"] + 1, s["start"] - acc["at"]), F.element_at(names, s["kind"] + 1))
        return F.struct(
            acc["text"].alias("text"), F.greatest(acc["at"], s["end"]).alias("at"),
            F.when(fresh, F.concat(acc["out"], piece)).otherwise(acc["out"]).alias("out"),
        )

    start = F.struct(F.col(f"row.`{text_col}`").alias("text"), F.lit(0).alias("at"), F.lit("").alias("out"))
    clean = F.aggregate("spans", start, step, lambda acc: F.concat(acc["out"], F.substring(acc["text"], acc["at"] + 1, F.lit(2**31 - 1))))
    return rows.select(
        *[
            (F.when(F.col("spans").isNull(), F.col(f"row.`{c}`")).otherwise(clean) if c == text_col else F.col(f"row.`{c}`")).alias(c)
            for c in docs.columns
        ]
    )
