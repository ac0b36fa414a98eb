"""Keyed tables kept as Parquet by partition: upserts, deletes and purges rewrite only the partitions they touch.

A partition's files are immutable; a manifest says which of them are current. Manifests are numbered and created without
overwriting, so of two writers that started from the same state one fails, and readers see a state before or after a
write and none between. Only names of partitions are on the driver.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Conflict(RuntimeError):
    """Another writer was faster."""


class KeyedTable:
    """Rows of ``schema`` (DDL) with a unique key, in partitions by the column ``by``; creating it twice changes nothing."""

    def __init__(self, spark: SparkSession, root: str, schema: str, keys: list[str], by: str):
        self.spark, self.root, self.keys, self.by = spark, root.rstrip("/"), keys, by
        self.schema = T.StructType.fromDDL(schema)
        self._jvm, self._conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        at = self._path("_manifest")
        self._fs = at.getFileSystem(self._conf)
        self._fs.mkdirs(at)

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def _state(self) -> tuple[int, dict[str, str]]:
        found = [s.getPath().getName() for s in self._fs.listStatus(self._path("_manifest"))]
        last = max((int(n.removesuffix(".json")) for n in found if n.endswith(".json") and n[:1].isdigit()), default=0)
        if not last:
            return 0, {}
        stream = self._fs.open(self._path(f"_manifest/{last:08d}.json"))
        text = self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        stream.close()
        return last, json.loads(text)

    def _commit(self, version: int, parts: dict[str, str]) -> None:
        """Written aside and renamed, so that no reader sees half a manifest."""
        aside, target = self._path(f"_manifest/_{uuid.uuid4().hex}"), self._path(f"_manifest/{version:08d}.json")
        stream = self._fs.create(aside, False)
        stream.write(bytearray(json.dumps(parts).encode()))
        stream.close()
        if self._fs.exists(target) or not self._fs.rename(aside, target):
            raise Conflict(f"version {version} of {self.root} exists already")

    def rows(self, only: list | None = None) -> DataFrame:
        """All current rows, or those of some partitions."""
        parts = self._state()[1]
        return self._read([p for k, p in parts.items() if only is None or json.loads(k) in only])

    def _read(self, paths: list[str]) -> DataFrame:
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*paths)

    def _change(self, touched: list, change: Callable[[DataFrame], DataFrame]) -> None:
        version, parts = self._state()
        names = [json.dumps(x) for x in touched]
        if not names:
            return
        at = f"{self.root}/data-{version + 1:08d}-{uuid.uuid4().hex}"
        new = change(self._read([parts[n] for n in names if n in parts])).select(*self.schema.names)
        # rows lie below a name of their partition, so a partition is a folder and the column stays in the rows
        new.withColumn("_part", F.sha2(F.coalesce(F.col(self.by).cast("string"), F.lit("")), 256)).write.partitionBy("_part").parquet(at)
        have = {s.getPath().getName() for s in self._fs.listStatus(self._jvm.org.apache.hadoop.fs.Path(at))}
        for name, value in zip(names, touched, strict=True):
            folder = f"_part={_digest(value)}"
            if folder in have:
                parts[name] = f"{at}/{folder}"
            else:
                parts.pop(name, None)
        self._commit(version + 1, parts)

    def rewrite(self, touched: list, change: Callable[[DataFrame], DataFrame]) -> None:
        """Replaces the rows of the partitions ``touched`` by what ``change`` makes of them, in one step for readers. Its rows have unique keys."""
        self._change(touched, change)

    def upsert(self, rows: DataFrame) -> None:
        """Inserts rows, replacing those with the same key. Rows given twice count once."""
        new = rows.select(*self.schema.names).dropDuplicates(self.keys)
        touched = [r[0] for r in new.select(self.by).distinct().collect()]  # names of partitions
        self._change(touched, lambda old: old.join(new.select(*self.keys), self.keys, "left_anti").unionByName(new))

    def delete(self, gone: DataFrame) -> None:
        """Removes the rows that ``gone`` names by some of the columns, the partition's among them."""
        on = gone.columns
        touched = [r[0] for r in gone.select(self.by).distinct().collect()]
        self._change(touched, lambda old: old.join(gone.distinct(), on, "left_anti"))

    def purge(self, value) -> None:
        """Drops a whole partition; no row is read."""
        version, parts = self._state()
        if parts.pop(json.dumps(value), None) is not None:
            self._commit(version + 1, parts)

    def count(self, value) -> int:
        return self.rows([value]).count()


def _digest(value) -> str:
    import hashlib

    text = "" if value is None else str(value).lower() if isinstance(value, bool) else str(value)
    return hashlib.sha256(text.encode()).hexdigest()
