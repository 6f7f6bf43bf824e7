"""A property graph derived from the star-schema tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.columns import geid, short_name


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """label, fqn, kind, file_path, start_line, end_line, docstring, community_id, repo, geid, name."""
    t = lambda n: read(spark, sf_dir, n)
    nation = t("nation").join(F.broadcast(t("region")), F.col("n_regionkey") == F.col("r_regionkey"))
    none, number = F.lit(None).cast("string"), F.lit(None).cast("long")
    shape = lambda df, label, fqn, kind=none, path=none, start=number, end=number, doc=none, community=number, repo=none: df.select(F.lit(label).alias("label"), fqn.alias("fqn"), kind.alias("kind"), path.alias("file_path"), start.cast("long").alias("start_line"), end.cast("long").alias("end_line"), doc.alias("docstring"), community.cast("long").alias("community_id"), F.coalesce(repo, F.lit("all")).alias("repo"))
    place = F.concat_ws(".", "r_name", "n_name")
    repo = F.lower("n_name")
    customer = t("customer").join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey"))
    supplier = t("supplier").join(F.broadcast(nation), F.col("s_nationkey") == F.col("n_nationkey"))
    path = lambda name, side=F.lit("main"): F.concat(F.lit("mirror/"), F.col("n_name"), F.lit("/src/"), side, F.lit("/java/"), name, F.lit(".java"))
    orders = t("orders").join(customer, F.col("o_custkey") == F.col("c_custkey"))
    start = 10 * F.row_number().over(W.partitionBy("o_custkey").orderBy("o_orderkey"))
    unit = orders.withColumn("start", start)
    side = F.when(F.col("o_orderstatus") == "P", "test").otherwise("main")
    parts = [
        shape(t("region"), "Project", F.col("r_name")),
        shape(nation, "Module", place, repo=repo),
        shape(customer, "Component", F.concat_ws(".", place, "c_name"), F.lit("class"), path(F.col("c_name")), F.lit(1), F.lit(1000), F.col("c_mktsegment"), F.col("c_nationkey"), repo),
        shape(supplier, "Component", F.concat_ws(".", place, "s_name"), F.lit("interface"), path(F.col("s_name")), F.lit(1), F.lit(1000), none, F.col("s_nationkey"), repo),
        shape(unit, "LogicUnit", F.concat(F.concat_ws(".", place, "c_name"), F.lit(".order_"), F.col("o_orderkey")), F.lit("method"), path(F.col("c_name"), side), F.col("start"), F.col("start") + 9, F.col("o_orderpriority"), F.col("c_nationkey"), repo),
        shape(t("part"), "DatabaseTable", F.concat_ws("_", "p_name", "p_partkey")),
        shape(t("part").select("p_brand").distinct(), "Configuration", F.col("p_brand")),
        shape(t("customer").select("c_mktsegment").distinct(), "AnnotationType", F.col("c_mktsegment")),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.withColumn("geid", geid(F.col("repo"), F.col("fqn"))).withColumn("name", short_name(F.col("fqn")))


def follows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(l_orderkey, next): the keys behind CALLS, pairs as often as parts give them, next null for a part's last order."""
    # Dealt out by part once: pairs are made distinct and ordered where they lie.
    pairs = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey").repartition("l_partkey").distinct()
    return pairs.select("l_orderkey", F.lead("l_orderkey").over(W.partitionBy("l_partkey").orderBy("l_orderkey")).alias("next"))


def edges(spark: SparkSession, sf_dir: str, *types: str) -> DataFrame:
    """(edge_type, src, dst) with ids like o12, c3, s4, n5, r1, p7; only the types named, all if none."""
    t = lambda n: read(spark, sf_dir, n)
    key = lambda letter, column: F.concat(F.lit(letter), F.col(column))
    # Pairs are made distinct as numbers, before they become text.
    once = lambda df, a, src, b, dst: df.select(src, dst).distinct().select(key(a, src).alias("src"), key(b, dst).alias("dst"))
    line = t("lineitem").select("l_orderkey", "l_partkey", "l_suppkey")
    owned = line.join(t("orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    part = t("part").select("p_partkey", "p_brand")
    both = owned.join(t("customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")).join(t("supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    made = {
        "CONTAINS": lambda: t("nation").select(key("r", "n_regionkey").alias("src"), key("n", "n_nationkey").alias("dst")),
        "DECLARES": lambda: t("customer").select(key("n", "c_nationkey").alias("src"), key("c", "c_custkey").alias("dst")).unionByName(t("supplier").select(key("n", "s_nationkey").alias("src"), key("s", "s_suppkey").alias("dst"))),
        "HAS_METHOD": lambda: t("orders").select(key("c", "o_custkey").alias("src"), key("o", "o_orderkey").alias("dst")),
        "CALLS": lambda: once(follows(spark, sf_dir).where("next is not null"), "o", "l_orderkey", "o", "next"),
        "QUERIES_TABLE": lambda: once(owned, "c", "o_custkey", "p", "l_partkey"),
        "READS_CONFIG": lambda: once(owned.select("o_custkey", "l_partkey").distinct().join(part, F.col("l_partkey") == F.col("p_partkey")), "c", "o_custkey", "b", "p_brand"),
        "INSTANTIATES": lambda: once(line, "o", "l_orderkey", "s", "l_suppkey"),
        "DEPENDS_ON": lambda: once(both.where("c_nationkey <> s_nationkey"), "n", "c_nationkey", "n", "s_nationkey"),
        "ANNOTATED_WITH": lambda: t("customer").select(key("c", "c_custkey").alias("src"), key("a", "c_mktsegment").alias("dst")),
    }
    out = None
    for name in types or made:
        part_ = made[name]().withColumn("edge_type", F.lit(name))
        out = part_ if out is None else out.unionByName(part_)
    return out.select("edge_type", "src", "dst")
