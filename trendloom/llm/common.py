"""Helpers shared by the corpus operators."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trendloom.operators.components import connected_components  # noqa: F401  shared with the operators of this package


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder that all executors share.

    It comes from ``spark.checkpoint.dir``; only where that is unset (tests on one machine) is one made.
    """
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="spark-"))
    return context._jsc.sc().getCheckpointDir().get()


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and cut its lineage."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def keep(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the shared checkpoint folder: for larger intermediate tables of few columns."""
    path = f"{shared_folder(df.sparkSession)}/{uuid.uuid4().hex}.parquet"
    df.write.option("compression", "zstd").option("parquet.block.size", 16 << 20).parquet(path)  # small row groups: readers can split files
    return df.sparkSession.read.parquet(path)


def utf8(column: str = "text") -> F.Column:
    """The text's bytes, with null as the empty text."""
    return F.coalesce(F.col(column), F.lit("")).cast("binary")


def crc32_of_id(column: str = "doc_id") -> F.Column:
    return F.crc32(F.col(column).cast("string").cast("binary"))


def partitions_for(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def min_labels(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the edges (u, v): each node that isn't the smallest of its component, and that smallest."""
    if not len(u):
        return u, v
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        np.minimum.at(label, before, label)  # hook the old root as well
        label = label[label]
        if np.array_equal(before, label):
            keep = label != np.arange(len(nodes))
            return nodes[keep], nodes[label[keep]]


def sorted_groups(batches, keys: list[str]):
    """From batches in the order of ``keys``, yield tables that hold whole groups only.

    A group is carried over to the next batch while it may go on, so memory is bounded by a batch and the largest group.
    """
    carry: list[pa.Table] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        now = pa.Table.from_batches([batch])
        cols = [now.column(k).to_numpy() for k in keys]
        change = np.zeros(now.num_rows, bool)
        for c in cols:
            change[1:] |= c[1:] != c[:-1]
        if carry:
            change[0] = any(carry[-1].column(k)[-1].as_py() != now.column(k)[0].as_py() for k in keys)
        starts = np.flatnonzero(change)
        if not len(starts):
            carry.append(now)
            continue
        cut = int(starts[-1])
        done = pa.concat_tables([*carry, now.slice(0, cut)])
        carry = [now.slice(cut)]
        if done.num_rows:
            yield done
    if carry:
        yield pa.concat_tables(carry)
