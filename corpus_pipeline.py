"""From raw documents to a training mix: five stages, each reread from Parquet by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codegraph.llm.common import free, fresh, materialise, table
from codegraph.llm.decontaminate import drop_contaminated
from codegraph.llm.mixing import mix_sources
from codegraph.llm.neardup import drop_near_duplicates
from codegraph.llm.quality import keep_good
from codegraph.llm.suffixdedup import strip_documents


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows that the classifier, fitted on the labelled ones, keeps.

    Null and empty texts are graded like any other text; without labels all rows stay; rows with
    a null doc_id teach nothing; repeated rows are judged alike; an empty table stays empty.
    """
    return keep_good(spark, docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates, that of the smallest doc_id.

    Null texts, texts without words and rows with a null doc_id stay; repeated rows of a kept
    doc_id all stay.
    """
    return drop_near_duplicates(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that a document with a smaller doc_id holds too; the first copy stays.

    A text that loses everything takes its row along; null and empty texts stay; rows with a
    null doc_id come last.
    """
    return strip_documents(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows whose text holds no benchmark item, each judged by its own text, whatever its doc_id; null and empty texts stay."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix takes, with copies and taken; own columns of these names are replaced.

    Rows equal in doc_id, source and text share the larger count; texts without words are not
    taken; a null source is a source.
    """
    (key,) = fresh(docs, "key")
    taken = mix_sources(docs).where("copies > 0").groupBy("key").agg(F.max("copies").alias("copies"), F.max("taken").alias("taken"))
    own = docs.drop("copies", "taken").withColumn(key, F.xxhash64("doc_id", "source", "text"))
    return own.join(taken.withColumnRenamed("key", key), key).drop(key)


STAGES = [
    ("quality classifier", quality),
    ("MinHash near-dedup", near_duplicates),
    ("suffix-array dedup", repeated_passages),
    ("benchmark decontamination", decontamination),
    ("mixing sources to target weights", mixture),
]

#: SQL can't express the classifier, the sketches and the rounding; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        free(before)
    return STAGES[-1][1](spark, docs, sf_dir)
