"""File and log sources and sinks."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import MAX_READ_BYTES, is_ignored, language_of


def keep_sources(files: DataFrame) -> DataFrame:
    """files (path, ...) of a supported language outside ignored places, with their language."""
    return files.where(~is_ignored(F.col("path"))).withColumn("language", language_of(F.col("path"))).where("language is not null")


def scan_tree(spark: SparkSession, root: str, repo_id: str) -> DataFrame:
    """repo_id, path, language, content, content_hash of the source files below ``root``.

    Paths and sizes are listed first, without contents; only files that stay are read. Their names, and no contents, are
    on the driver, which lists them anyway.
    """
    base = root if "://" in root or root.startswith("file:") else f"file:{root}"
    prefix = base.rstrip("/").replace("file://", "file:") + "/"
    path = F.expr(f"substring(replace(path, 'file:///', 'file:/'), {len(prefix) + 1})")
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select(F.col("path").alias("_at"), path.alias("path"), "length")
    kept = [r[0] for r in keep_sources(listed.where(F.col("length") <= MAX_READ_BYTES)).where(~hidden_by(spark, root, F.col("path"))).select("_at").collect()]
    if not kept:
        return spark.createDataFrame([], "repo_id string, path string, language string, content binary, content_hash string")
    rows = keep_sources(spark.read.format("binaryFile").load(kept).select(path.alias("path"), "content")).where(~is_generated(F.col("content")))
    return rows.select(F.lit(repo_id).alias("repo_id"), "path", "language", "content", F.sha2("content", 256).alias("content_hash"))


#: The file at a tree's top whose lines name what is left out: folders, files, or patterns with ``*``.
IGNORE_FILE = ".scanignore"


def hidden_by(spark: SparkSession, root: str, path):
    """Whether the tree's own ignore file hides a path; false where there is none."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/{IGNORE_FILE}")
    fs = at.getFileSystem(conf)
    if not fs.exists(at):
        return F.lit(False)
    stream = fs.open(at)  # Spark's readers pass over names that start with a dot
    lines = [x.strip() for x in jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8").split("\n")]
    stream.close()
    out = F.lit(False)
    for line in filter(lambda x: x and not x.startswith("#"), lines):
        pattern = "".join("[^/]*" if c == "*" else re.escape(c) for c in line.strip("/"))
        out = out | path.rlike(f"^{pattern}(/|$)" if line.startswith("/") else f"(^|/){pattern}(/|$)")
    return out


def is_generated(content):
    """Whether one of the first lines says that a program wrote the file."""
    return F.coalesce(F.substring(content, 1, 500).cast("string").rlike("(?i)(code generated .* do not edit|@generated|auto-?generated)"), F.lit(False))


def write_snapshot(files: DataFrame, target: str, commit_sha: str) -> None:
    """Files of a commit, by repository and commit; a second write of the same commit replaces it."""
    files.withColumn("commit_sha", F.lit(commit_sha)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("repo_id", "commit_sha").parquet(target)


LOG_EVENT = "ts timestamp, org_id string, source_id string, service string, severity string, message string, attributes map<string,string>, trace_id string, host string"


def parse_logs(lines: DataFrame, column: str = "value") -> DataFrame:
    """Log events of JSON lines; what doesn't parse, or has no time, is left out."""
    return lines.select(F.from_json(F.col(column), LOG_EVENT, {"mode": "PERMISSIVE"}).alias("e")).where("e.ts is not null").select("e.*")


def read_logs(spark: SparkSession, path: str) -> DataFrame:
    return parse_logs(spark.read.text(path))


def archive_logs(events: DataFrame, target: str) -> None:
    """Events as Parquet by day, for retention by partition."""
    events.withColumn("day", F.to_date("ts")).write.mode("append").partitionBy("day").parquet(target)


def parse_syslog(lines: DataFrame, column: str = "value") -> DataFrame:
    """service, severity, message of lines ``<severity> service: message``; other lines are messages of severity info."""
    pattern = r"^<(\w+)> ([^:\s]+): (.*)$"
    hit = F.col(column).rlike(pattern)
    part = lambda i, other: F.when(hit, F.regexp_extract(column, pattern, i)).otherwise(other)
    return lines.select("*", part(2, F.lit(None).cast("string")).alias("service"), F.lower(part(1, F.lit("info"))).alias("severity"), part(3, F.col(column)).alias("message"))


#: Adapters: lines of a kind to ts, severity, service, message.
_RFC3164 = r"^<(\d{1,3})>([A-Z][a-z]{2} [ \d]\d \d\d:\d\d:\d\d) (\S+) ([^:\[ ]+)(?:\[\d+\])?: ?(.*)$"
_CRI = r"^(\S+) (stdout|stderr) [FP] (.*)$"
_DB = r"^(\d{4}-\d\d-\d\d \d\d:\d\d:\d\d(?:\.\d+)?) \w+ \[\d+\] (?:\S+ )?(DEBUG|LOG|INFO|NOTICE|WARNING|ERROR|FATAL|PANIC): +(.*)$"
_LEVELS = {"0": "fatal", "1": "fatal", "2": "fatal", "3": "error", "4": "warn", "5": "info", "6": "info", "7": "debug"}
_DB_LEVELS = {"DEBUG": "debug", "LOG": "info", "INFO": "info", "NOTICE": "info", "WARNING": "warn", "ERROR": "error", "FATAL": "fatal", "PANIC": "fatal"}


def normalised(lines: DataFrame, kind, column: str = "value", year: str = "1970") -> DataFrame:
    """lines with ts (string), severity, service and message by their ``kind`` (a column): app, docker, k8s, syslog or db.

    What doesn't have its kind's form is a message of severity info. Syslog lines have no year; ``year`` is put before.
    """
    v = F.col(column)
    of = lambda names: F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    none = F.lit(None).cast("string")
    app = F.from_json(v, "ts string, severity string, service string, message string")
    docker = F.from_json(v, "log string, stream string, time string")
    part = lambda pattern, i: F.regexp_extract(v, pattern, i)
    stream = lambda x: F.when(x == "stderr", "error").otherwise("info")
    forms = (
        ("app", app["message"].isNotNull(), app["ts"], F.lower(F.coalesce(app["severity"], F.lit("info"))), app["service"], app["message"]),
        ("docker", docker["log"].isNotNull(), docker["time"], stream(docker["stream"]), none, F.rtrim(F.regexp_replace(docker["log"], "\n$", ""))),
        ("k8s", v.rlike(_CRI), part(_CRI, 1), stream(part(_CRI, 2)), none, part(_CRI, 3)),
        ("syslog", v.rlike(_RFC3164), F.concat(F.lit(f"{year} "), part(_RFC3164, 2)), F.element_at(of(_LEVELS), (part(_RFC3164, 1).cast("int") % 8).cast("string")), part(_RFC3164, 4), part(_RFC3164, 5)),
        ("db", v.rlike(_DB), part(_DB, 1), F.element_at(of(_DB_LEVELS), part(_DB, 2)), none, part(_DB, 3)),
    )
    fields = []
    for i, (name, other) in enumerate((("ts", none), ("severity", F.lit("info")), ("service", none), ("message", v)), 2):
        c = None
        for form in forms:
            hit = (kind == form[0]) & form[1]
            c = F.when(hit, form[i]) if c is None else c.when(hit, form[i])
        fields.append(c.otherwise(other).alias(name))
    return lines.select("*", *fields)


def is_binary(content):
    """Whether bytes hold a NUL in their first 8000."""
    return F.contains(F.substring(content, 1, 8000), F.unhex(F.lit("00")))


def shebang_language(text):
    """The language a first line ``#!`` names; null if it names none that is supported."""
    program = F.regexp_extract(text, r"^#!\s*\S*?(?:/env\s+)?([a-z]+)[0-9.]*\s*(?:\n|$)", 1)
    return F.when(program.isin("python", "pypy"), "python").when(program.isin("node", "deno", "bun"), "javascript")
