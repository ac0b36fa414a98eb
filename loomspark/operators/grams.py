"""A stored trigram index for fuzzy names: posting lists of grams, with prefix and length filters before any similarity.

A name that is similar enough to a query shares at least ``o`` of its grams, ``o`` being that part of the query's. So it shares
one of any ``size - o + 1`` of them, and the rarest are looked up: a gram that most names have is hardly ever read. Of the names
found there, only those whose number of grams allows the similarity are compared. The result is that of comparing all names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import jaccard, trigrams

#: Similarities are rounded to five places before they are held against the least one.
_SLACK = 5e-6


class GramIndex:
    """The index below ``root``: ``grams`` (gram, name, size) in order of gram, and ``counts`` (gram, names)."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    @classmethod
    def build(cls, names: DataFrame, root: str, column: str = "name") -> GramIndex:
        """Indexes the distinct names; null names aren't found."""
        ix = cls(names.sparkSession, root)
        each = names.select(F.col(column).alias("name")).where("name is not null").distinct().withColumn("g", trigrams(F.col("name")))
        rows = each.select(F.explode("g").alias("gram"), "name", F.size("g").alias("size"))
        rows.write.parquet(f"{root}/cut")
        rows = ix.spark.read.parquet(f"{root}/cut")
        parts = int(ix.spark.conf.get("spark.sql.shuffle.partitions"))
        rows.repartitionByRange(parts, "gram", "name").sortWithinPartitions("gram", "size").write.parquet(f"{root}/grams")
        rows.groupBy("gram").agg(F.count(F.lit(1)).alias("names")).write.parquet(f"{root}/counts")
        return ix

    def compared(self, queries: DataFrame, least: float = 0.3, column: str = "query") -> DataFrame:
        """query, name: the pairs that are compared."""
        t = least - _SLACK
        asked = queries.select(F.col(column).alias("query")).where("query is not null").distinct().withColumn("g", trigrams(F.col("query")))
        cut = asked.select("query", F.explode("g").alias("gram"), F.size("g").alias("asked"))
        counts = self.spark.read.parquet(f"{self.root}/counts")
        w = Window.partitionBy("query").orderBy("names", "gram")  # the grams of one query
        nth = cut.join(counts, "gram", "left").na.fill(0, ["names"]).withColumn("_n", F.row_number().over(w))
        rare = nth.where(F.col("_n") <= F.col("asked") - F.ceil(F.col("asked") * t - 1e-9) + 1)
        lists = self.spark.read.parquet(f"{self.root}/grams")
        found = lists.join(rare.select("query", "gram", "asked"), "gram")
        return found.where(F.col("size").between(F.col("asked") * t, F.col("asked") / t)).select("query", "name").distinct()

    def search(self, queries: DataFrame, least: float = 0.3, column: str = "query") -> DataFrame:
        """query, name, score (trigram similarity, rounded to five places) of all names that are as similar as ``least`` (above 0)."""
        if not least > _SLACK:
            raise ValueError("names that share nothing with a query aren't in its lists")
        score = F.round(jaccard(trigrams(F.col("name")), trigrams(F.col("query"))), 5)
        return self.compared(queries, least, column).withColumn("score", score).where(F.col("score") >= least)
