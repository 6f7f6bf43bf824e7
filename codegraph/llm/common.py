"""Helpers shared by the corpus operators: sessions, tables, column names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..storage import components, free, materialise, ship

__all__ = ["WORD", "components", "free", "fresh", "materialise", "prepare", "table"]

#: Rule for words in all contracts: maximal runs of anything but these bytes.
WORD = "[^\\x20\\x09-\\x0D]+"
#: Rows and bytes of a batch that a Python worker gets, where the session has the defaults: texts are long.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "1000"), "spark.sql.execution.arrow.maxBytesPerBatch": ("67108864b", "8m")}


def prepare(spark: SparkSession) -> None:
    """Batch sizes for long texts, and this package for the executors."""
    for name, (default, ours) in BATCH.items():
        if spark.conf.get(name, default) == default:
            spark.conf.set(name, ours)
    ship(spark)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """names, each with as many underscores in front as it takes to clash with no column of df (Spark folds case)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out
