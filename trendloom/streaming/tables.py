"""Tables that micro-batches merge into, each batch once, across restarts.

A table is a folder of parts and of manifests, one a batch, which name the parts that make it up. A batch writes its own rows as one more
part and then its manifest, in one rename; a batch whose manifest is there is left out, so a batch that runs again changes nothing. Readers
merge the parts of the newest manifest by key. Many parts are brought together now and then, so a batch does not rewrite the table.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

COMPACT = 8  #: parts above which a batch brings all together


class MergedTable:
    """``merge`` takes rows and leaves one for each key; it must not matter in which order or how often it is applied."""

    def __init__(self, spark: SparkSession, path: str, schema: str, merge: Callable[[DataFrame], DataFrame]):
        self.spark, self.path, self.schema, self.merge = spark, path, schema, merge
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self.fs = self._path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _manifest(self, batch: int):
        return self._path(f"{self.path}/manifests/{batch:020d}.json")

    def batches(self) -> list[int]:
        folder = self._path(f"{self.path}/manifests")
        if not self.fs.exists(folder):
            return []
        names = [f.getPath().getName() for f in self.fs.listStatus(folder)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json"))

    def parts(self) -> list[str]:
        done = self.batches()
        if not done:
            return []
        stream = self.fs.open(self._manifest(done[-1]))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())["parts"]
        finally:
            stream.close()

    def _rows(self, parts: list[str]) -> DataFrame:
        if not parts:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.path}/{p}" for p in parts])

    def read(self) -> DataFrame:
        return self.merge(self._rows(self.parts()))

    def apply(self, rows: DataFrame, batch: int) -> bool:
        """Merge a batch; False if it was merged before."""
        done = self.batches()
        if batch in done or (done and batch < done[-1]):
            return False
        parts = self.parts()
        name = f"parts/{batch:020d}-{uuid.uuid4().hex}"  # a run that was broken off leaves a part that no manifest names
        if len(parts) >= COMPACT:
            rows, parts = self._rows(parts).unionByName(rows), []
        self.merge(rows).select(*[c.split()[0] for c in self.schema.split(", ")]).write.parquet(f"{self.path}/{name}")
        draft = self._path(f"{self.path}/drafts/{uuid.uuid4().hex}")
        out = self.fs.create(draft)
        out.write(bytearray(json.dumps({"batch": batch, "parts": [*parts, name]}).encode()))
        out.close()
        self.fs.mkdirs(self._manifest(batch).getParent())
        return bool(self.fs.rename(draft, self._manifest(batch)))


def run_into(stream: DataFrame, table: MergedTable, change: Callable[[DataFrame, int], DataFrame] = lambda rows, batch: rows) -> MergedTable:
    """Merge what is available of a stream, changed batch by batch, into a table and stop. Called again with the table, it goes on where it ended."""

    def merge(rows: DataFrame, batch: int) -> None:
        rows = rows.persist()  # a change may read its batch several times
        try:
            table.apply(change(rows, batch), batch)
        finally:
            rows.unpersist()

    stream.writeStream.foreachBatch(merge).option("checkpointLocation", f"{table.path}/state").trigger(availableNow=True).start().awaitTermination()
    return table
