"""A training-data pipeline over ``documents``: toxicity, line dedup, near-dedup, decontamination, SentencePiece.

Each stage works on all that its predecessor kept, is written as Parquet and read again, so a lost executor costs a
stage's tasks at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomspark.llm import common, decontaminate, line_dedup, near_dups, sentencepiece_stream, toxicity_kn


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the class-conditional models accept.

    A null or empty text gets the score of no words; rows that repeat are scored alike; a
    score of exactly one half is toxic; an empty table stays empty. Columns pass by, whatever their names.
    """
    return toxicity_kn.accepted(docs, common.table(spark, sf_dir, "labels").select("doc_id", "toxic"))


def line_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that ten or more of them share.

    A null text stays null; rows that repeat an id are one document in the count and are each cut; empty lines always stay; of
    columns only text and n_chars change.
    """
    return line_dedup.cleaned(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar ones: five-word shingles, similarity of 0.8 or more.

    The least doc_id of a group stays; texts without words are similar to none; rows that repeat id and text all stay, of rows
    without an id that repeat one does.
    """
    return near_dups.one_each(docs, n=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth is benchmark text.

    Null and empty texts hold none and stay; items without words match nothing; rows that repeat are judged alike.
    """
    return decontaminate.decontaminated(docs, common.table(spark, sf_dir, "benchmark"))


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_pieces and ids of what is left; a null text has null ids and no pieces, an empty one no ids."""
    model = sentencepiece_stream.read_model()
    coded = sentencepiece_stream.encode(docs.select("doc_id", "lang", "source", "text"), model)
    return coded.selectExpr("doc_id", "lang", "source", "cast(coalesce(size(ids), 0) as long) as n_pieces", "ids")


STAGES = [("toxicity", toxicity), ("line_dedup", line_duplicates), ("near_dedup", near_duplicates), ("decontamination", decontamination), ("sentencepiece", sentencepiece)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.saved(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


#: The toxicity models aren't expressible in SQL; the tests hold the stages against brute force.
ORACLE_SQL = None
