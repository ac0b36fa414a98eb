"""Facts of file contents, kept by content hash: a content is scanned once, however often files move, return or repeat."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

KEY = ["repo_id", "language", "content_hash"]


class FactStore:
    """Rows of facts (``schema``, DDL, with the key's columns), appended in batches; a batch counts once it is complete.

    One run of a repository adds at a time, as index runs do; runs of different repositories never share a key.
    """

    def __init__(self, spark: SparkSession, root: str, schema: str):
        self.spark, self.root, self.schema = spark, root.rstrip("/"), T.StructType.fromDDL(schema)
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self._path = lambda name="": jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)
        self._fs = self._path().getFileSystem(conf)
        self._fs.mkdirs(self._path())

    def _batches(self) -> list[str]:
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path())]  # one for each run
        return [f"{self.root}/{n}" for n in sorted(names) if self._fs.exists(self._path(f"{n}/_SUCCESS"))]

    def rows(self) -> DataFrame:
        at = self._batches()
        return self.spark.read.schema(self.schema).parquet(*at) if at else self.spark.createDataFrame([], self.schema)

    def add(self, files: DataFrame, scan: Callable[[DataFrame], DataFrame]) -> int:
        """Scans those contents of ``files`` (the key's columns, content) that aren't known; how many they were."""
        wanted = files.dropDuplicates(KEY).join(self.rows().select(*KEY), KEY, "left_anti")
        at = f"{self.root}/batch-{len(self._batches()):06d}-{uuid.uuid4().hex}"
        scan(wanted).select(*self.schema.names).write.parquet(at)
        return self.spark.read.schema(self.schema).parquet(at).count()

    def of(self, files: DataFrame) -> DataFrame:
        """repo_id, path and facts of ``files`` (path, the key's columns); files that nothing is known of are left out."""
        return files.select("path", *KEY).join(self.rows(), KEY)
