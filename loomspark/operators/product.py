"""Analytic queries over tenants, sessions, audit rows and token use."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import resource_type, role_rank


def allowed(members: DataFrame, required: str, role: str = "role") -> DataFrame:
    """Members whose role ranks at least as high as ``required``."""
    return members.where(role_rank(F.col(role)) >= role_rank(F.lit(required)))


def token_rollup(usage: DataFrame, keys: list[str]) -> DataFrame:
    return usage.groupBy(*keys).agg(F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("completion_tokens").alias("completion_tokens"), F.sum(F.col("prompt_tokens") + F.col("completion_tokens")).alias("total_tokens"))


def audit_rollup(audit: DataFrame, keys: list[str]) -> DataFrame:
    return audit.groupBy(*keys).agg(F.count(F.lit(1)).alias("actions"), F.min("us").alias("first_us"), F.max("us").alias("last_us"))


def live_sessions(sessions: DataFrame, now) -> DataFrame:
    """Sessions that are neither revoked nor expired."""
    return sessions.where(F.col("revoked_at").isNull() & (F.col("expires_at") >= now))


def partial_update(old: DataFrame, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """old with the values that ``new`` gives; nulls there leave the old ones."""
    patch = new.select(key, *[F.col(c).alias(f"_{c}") for c in columns])
    joined = old.join(patch, key, "left")
    return joined.select(*[F.coalesce(F.col(f"_{c}"), F.col(c)).alias(c) if c in columns else F.col(c) for c in old.columns])


#: Methods that change something, and the path whose requests aren't audited.
MUTATING, AUTH_PREFIX = ("POST", "PUT", "PATCH", "DELETE"), "/api/v1/auth"


def audit_rows(requests: DataFrame) -> DataFrame:
    """Requests (method, url, status, ...) that leave an audit row: successful ones that change something, auth aside."""
    ok = F.col("status").between(200, 399) & F.upper("method").isin(*MUTATING) & ~F.col("url").contains(AUTH_PREFIX)
    action = F.concat(F.upper("method"), F.lit(" "), F.regexp_extract("url", r"(/api/v1/[^?]*)", 1))
    return requests.where(ok).withColumn("action", action).withColumn("resource_type", resource_type(F.col("url")))


def insert_unique(stored: DataFrame, new: DataFrame, unique: list[str], order: str) -> tuple[DataFrame, DataFrame]:
    """New rows that take effect, and those in conflict: with a stored row of the same values, or an earlier new one."""
    first = new.groupBy(*unique).agg(F.min(order).alias("_first"))
    free = new.join(first, unique).join(stored.select(*unique), unique, "left_anti").where(F.col(order) == F.col("_first")).select(*new.columns)
    return free, new.join(free.select(order), order, "left_anti")
