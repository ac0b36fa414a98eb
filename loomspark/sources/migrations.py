"""Migrations: SQL files applied once each, in the order of their names."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..operators.incremental import pending
from .stores import KeyedTable


def statements(text: str) -> list[str]:
    """Statements of a file: what semicolons at line ends part, without comment lines."""
    body = "\n".join(x for x in text.split("\n") if not x.lstrip().startswith("--"))
    return [s.strip() for s in body.split(";\n") if s.strip().rstrip(";")]


def apply(spark: SparkSession, folder: str, state: str) -> list[str]:
    """Names of the migrations that were pending and are applied now. One is recorded as soon as all its statements ran."""
    done = KeyedTable(spark, state, "all_of string, name string", ["all_of", "name"], "all_of")
    files = spark.read.text(folder, wholetext=True, pathGlobFilter="*.sql").select(F.element_at(F.split("_metadata.file_path", "/"), -1).alias("name"), F.col("value").alias("text"))
    todo = [(r["name"], r["text"]) for r in pending(files, done.rows().select("name")).collect()]  # a few small files
    for name, text in todo:
        for s in statements(text + "\n"):
            spark.sql(s.rstrip(";"))
        done.upsert(spark.createDataFrame([("migrations", name)], "all_of string, name string"))
    return [name for name, _ in todo]
