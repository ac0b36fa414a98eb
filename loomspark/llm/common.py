"""What the operators of this subpackage share: inputs, written tables, words.

Nothing here swallows an import error, and nothing outside ``llm`` imports it.
"""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T



def tokenizer(name: str) -> str:
    """Where a public tokenizer's file lies; every operator takes another file as a parameter."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


_ROOT = str(Path(__file__).resolve().parents[2])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> SparkSession:
    """Lets Python workers of local sessions import this package; on a cluster it is installed or sent with --py-files."""
    env = spark.sparkContext.environment
    have = env.get("PYTHONPATH", "")
    if _ROOT not in have.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (_ROOT, have) if x)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; in a local session without that setting a folder of its own."""
    if at := spark.conf.get("spark.checkpoint.dir", None):
        return at.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    at = f"{tempfile.gettempdir()}/loomspark-{spark.sparkContext.applicationId}"
    os.makedirs(at, exist_ok=True)
    return f"file://{at}"


def new_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder, deleted when the session's JVM ends."""
    at = f"{shared_dir(spark)}/loom-{label}-{uuid.uuid4().hex}"
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    where = jvm.org.apache.hadoop.fs.Path(at)
    where.getFileSystem(conf).deleteOnExit(where)
    return at


def saved(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared folder and read again: later steps restart from there, whichever executor is lost."""
    spark = df.sparkSession
    df.write.parquet(at := new_path(spark, label))
    return spark.read.schema(df.schema).parquet(at)


def trim() -> None:
    """Gives memory that Python and Arrow have freed back to the system, where the C library can."""
    pa.default_memory_pool().release_unused()
    free = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if free is not None:
        free(0)


def give_back_arrays(least: int = 1 << 20) -> None:
    """From now on memory of arrays of ``least`` bytes and more goes back to the system as soon as they are freed, where the
    C library can; by itself it keeps more and more of it for later."""
    set_option = getattr(ctypes.CDLL(None), "mallopt", None)
    if set_option is not None:
        set_option(-3, least)


def tidy(run, *caches):
    """``run`` for mapInArrow, giving memory back when a task ends; what ``caches`` hold is dropped before."""

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            for drop in caches:
                drop()
            trim()

    return wrapped


def spread(df: DataFrame, rows: int, per: int) -> DataFrame:
    """``df`` in no more partitions than ``rows`` (at most so many it has) of ``per`` each need, so that small tables are few files."""
    return df.coalesce(max(1, -(-rows // per)))


def digest(*columns: Column) -> Column:
    """128 bits of the SHA-256 of columns, as binary: equal only for equal values, nulls told apart from all others."""
    parts = []
    for c in columns:
        text = c.cast("string")
        parts += [F.coalesce(F.octet_length(text), F.lit(-1)).cast("string"), F.lit(":"), F.coalesce(text, F.lit(""))]
    return F.unhex(F.substring(F.sha2(F.concat(*parts) if len(parts) > 3 else F.coalesce(columns[0].cast("string"), F.lit("")), 256), 1, 32))


def held_out(doc_id: Column, mod: int) -> Column:
    """crc32 of the id as text divides by ``mod``; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % F.lit(mod) == 0, F.lit(False))


#: Maps A-Z to a-z and every other ASCII character that isn't a letter or digit to a space; bytes from 0x80 on stay.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def folded_words(text: str | None) -> list[bytes]:
    """The words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of a text with A-Z lower-cased."""
    return text.encode("utf-8", "surrogatepass").translate(FOLD).split() if text else []


def spaced_words(text: str | None, lower: bool = True) -> list[bytes]:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text, with A-Z lower-cased if ``lower``; bytes.split() cuts at just these."""
    if not text:
        return []
    b = text.encode("utf-8", "surrogatepass")
    return (b.lower() if lower else b).split()


def ascii_lower(c: Column) -> Column:
    """A-Z lower-cased and nothing else; ``lower`` does that by itself where all is ASCII."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(
        F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    )


def input_bytes(spark: SparkSession, df: DataFrame) -> int:
    """Catalyst's estimate of the size of ``df``; only for plain scans it is the size of the files."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def partitions_for(df: DataFrame, mb: int = 12) -> int:
    """A number of partitions that follows the input, and at least the session's."""
    spark = df.sparkSession
    least = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    return max(least, min(100_000, -(-input_bytes(spark, df) // (mb << 20))))


def with_fields(df: DataFrame, dropped: set[str], added: str) -> tuple[T.StructType, list[int]]:
    """The schema of ``df`` without the columns ``dropped`` and with those of the DDL ``added``; the places of the columns that stay."""
    new = T.StructType.fromDDL(added)
    gone = dropped | {f.name for f in new}
    kept = [(i, f) for i, f in enumerate(df.schema.fields) if f.name not in gone]
    return T.StructType([f for _, f in kept] + new.fields), [i for i, _ in kept]
