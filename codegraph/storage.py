"""Intermediate tables on storage that the driver and all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once an application."""
    app = spark.sparkContext.applicationId
    if getattr(ship, "app", None) != app:
        root = Path(__file__).resolve().parent
        target = Path(tempfile.mkdtemp(prefix="codegraph-")) / "codegraph.zip"
        with zipfile.ZipFile(target, "w") as z:
            for f in sorted(root.rglob("*.py")):
                z.write(f, f.relative_to(root.parent))
        spark.sparkContext.addPyFile(str(target))
        ship.app = app


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where it is unset, a temporary one, in local mode only."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to storage that the driver and all executors share")
        found = getattr(shared_dir, "local", None)
        if not found:
            shared_dir.local = found = "file://" + tempfile.mkdtemp(prefix="codegraph-")
    return f"{found.rstrip('/')}/codegraph-{spark.sparkContext.applicationId}"


def _delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def _release_at_exit(spark: SparkSession) -> None:
    try:
        _delete(spark, shared_dir(spark))
    except Exception:  # the session is gone already; nothing is left to do at exit
        pass


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage: write df to the shared folder, in the denser of Parquet's usual codecs, and read it back."""
    spark = df.sparkSession
    if not getattr(_release_at_exit, "set", False):
        _release_at_exit.set = True
        atexit.register(_release_at_exit, spark)
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written = path
    return out


def is_written(df: DataFrame) -> bool:
    """Whether df is a table of materialise() as it was written."""
    return bool(df.__dict__.get("written"))


def free(*tables: DataFrame) -> None:
    """Delete tables of materialise(), once all that reads them has been written itself."""
    for df in tables:
        if path := df.__dict__.get("written"):
            _delete(df.sparkSession, path)


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """Connected components of links(u, v), by alternating large-star and small-star rounds.

    Returns (u, root): every node that has a link, with the smallest node it reaches
    (roots themselves are left out). Only counts and checksums reach the driver; each round
    is written to the shared folder. Rounds are logarithmic in the size of a component.
    """
    edges = links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges = materialise(edges, "links")
    state = _state(edges)
    while state[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        stars = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v")
        old, edges = edges, materialise(stars.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "stars")
        free(old)
        before, state = state, _state(edges)
        if state == before:
            break
    return edges.select("u", F.col("v").alias("root"))
