"""Lexical search, context windows, budgets, nearest neighbours and keyed upserts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..storage import materialise, ship
from .neighbours import cosine_distance, nearest

__all__ = ["budget", "candidates", "context", "cosine_distance", "delete_calls", "delete_nodes", "first_hits", "fitting", "grep", "last_wins", "lines", "nearest", "orphans", "upsert"]


def lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, line_number from 1, line)."""
    return docs.select(key, F.posexplode(F.split(text, "\n", -1)).alias("p", "line")).select(key, (F.col("p") + 1).cast("long").alias("line_number"), "line")


def grep(table: DataFrame, words: list[str], per_file: int, most: int, key: str = "doc_id") -> DataFrame:
    """(symbol, key, line_number, line) of exact, case-sensitive hits: the first per_file of a file, the first `most` of a symbol."""
    return first_hits(table.withColumn("symbol", F.explode(F.filter(F.array(*map(F.lit, words)), lambda w: F.col("line").contains(w)))), per_file, most, key)


def first_hits(found: DataFrame, per_file: int, most: int, key: str = "doc_id") -> DataFrame:
    """Of hits(symbol, key, line_number, line) the first per_file of a file, and of these the first `most` of a symbol."""
    found = found.withColumn("a", F.row_number().over(W.partitionBy("symbol", key).orderBy("line_number"))).where(F.col("a") <= per_file)
    # Each file's hits are few by now; files rank by their own order, so no symbol is sorted whole in one task.
    return found.withColumn("b", F.row_number().over(W.partitionBy("symbol").orderBy(key, "line_number"))).where(F.col("b") <= most).select("symbol", key, "line_number", "line")


def context(table: DataFrame, hits: DataFrame, around: int, key: str = "doc_id") -> DataFrame:
    """(key, hit_line, line_number, line): the lines around each hit, clamped to the file."""
    wanted = hits.select(key, F.col("line_number").alias("hit_line"), F.explode(F.sequence(F.col("line_number") - around, F.col("line_number") + around)).alias("line_number"))
    return wanted.join(table, [key, "line_number"]).select(key, "hit_line", "line_number", "line")


def _local_prefix(group: str, order: list[str], most: int, keep_first: bool):
    """Of each task's rows, those that the group's prefix can hold, and the first beyond: a row's sum within the task is at most that within the group."""

    def cut(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values([group, *order], kind="stable", na_position="first")
        by = rows.groupby(group, dropna=False, sort=False)
        size = rows["tokens"].fillna(0)
        fits = size.groupby(rows[group], dropna=False, sort=False).cumsum() - size <= most
        return rows[fits | (by.cumcount() == 0)] if keep_first else rows[fits]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for part in parts:
            held = [cut(pd.concat([*held, part]))]
        yield from held

    return run


def budget(rows: DataFrame, group: str, order: list[str], tokens: Column, most: int, keep_first: bool = False) -> DataFrame:
    """The longest prefix of each group, in order, whose tokens fit; with keep_first its first row always.

    Each task cuts its own rows to what can be in a prefix before any are shuffled, so a group
    sorts no more than the budget's rows of each task. Give keys and small columns only.
    """
    ship(rows.sparkSession)
    counted = rows.withColumn("tokens", tokens.cast("long"))
    own = [c for c in counted.columns if c in (group, *order, "tokens")]
    near = counted.select(own).mapInPandas(_local_prefix(group, order, most, keep_first), counted.select(own).schema)
    w = W.partitionBy(group).orderBy(*order)
    out = near.withColumn("cum_tokens", F.sum("tokens").over(w.rowsBetween(W.unboundedPreceding, 0))).withColumn("rn", F.row_number().over(w))
    return out.where((F.col("cum_tokens") <= most) | (F.col("rn") == 1 if keep_first else F.lit(False))).drop("rn")


def fitting(lines: DataFrame, group: str, order: str, text: str, tokens: Column, most: int, keep: int = 0) -> DataFrame:
    """(group, kept, truncated): lines of each group joined in order, dropped from the end until their tokens fit, but for the first `keep`.

    Lines are dealt out by ranges of (group, order). Sums of these ranges, a row each, say what
    stands before a range; only ranges that begin within the budget or the first `keep` are opened,
    and each is summed by itself, so a group of any size is never sorted in one task.
    """
    own = lines.select(F.col(group).alias("g"), F.col(order).alias("o"), F.col(text).alias("t"), F.coalesce(tokens.cast("long"), F.lit(0)).alias("n"))
    own = materialise(own.repartitionByRange("g", "o").withColumn("part", F.spark_partition_id()), "dealt")
    sums = own.groupBy("g", "part").agg(F.sum("n").alias("sum"), F.count("*").alias("rows"))
    before = W.partitionBy("g").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select(F.col("g").alias("gg"), F.col("part").alias("pp"), F.coalesce(F.sum("sum").over(before), F.lit(0)).alias("sum0"), F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("rows0"), "rows")
    begun = sums.where((F.col("sum0") <= most) | (F.col("rows0") < keep)).drop("rows")
    w = W.partitionBy("g", "part").orderBy("o")
    opened = own.join(begun, F.col("g").eqNullSafe(F.col("gg")) & (F.col("part") == F.col("pp")))
    opened = opened.withColumn("sum", F.col("sum0") + F.sum("n").over(w.rowsBetween(W.unboundedPreceding, 0))).withColumn("rn", F.col("rows0") + F.row_number().over(w))
    held = opened.where((F.col("sum") <= most) | (F.col("rn") <= keep)).groupBy("g").agg(F.array_sort(F.collect_list(F.struct("rn", "t"))).alias("held"), F.count("*").alias("stay"))
    whole = sums.groupBy(F.col("gg").alias("whole")).agg(F.sum("rows").alias("all"))
    out = whole.join(held, F.col("whole").eqNullSafe(F.col("g")), "left")
    kept = F.array_join(F.transform(F.coalesce("held", F.array().cast("array<struct<rn:bigint,t:string>>")), lambda x: x["t"]), "\n")
    return out.select(F.col("whole").alias(group), kept.alias("kept"), (F.col("all") > F.coalesce("stay", F.lit(0))).alias("truncated"))


def candidates(total: int, wanted: int = 20) -> int:
    """How many communities a change is held against: a quarter of all, wanted at least, 50 at most, and no more than there are."""
    return min(min(max(wanted, total // 4), 50), total)


def delete_nodes(nodes: DataFrame, edges: DataFrame, paths: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """nodes and edges without the methods and types of paths(file_path) and all their edges, and how many nodes that were."""
    gone = nodes.where("label in ('LogicUnit', 'Component')").join(paths.select("file_path").distinct(), "file_path", "left_semi").select("id").distinct()
    return nodes.join(gone, "id", "left_anti"), edges.join(gone.withColumnRenamed("id", "src"), "src", "left_anti").join(gone.withColumnRenamed("id", "dst"), "dst", "left_anti").select(edges.columns), gone.count()


def delete_calls(edges: DataFrame, sources: DataFrame) -> tuple[DataFrame, int]:
    """edges without the CALLS of sources(id), and how many those were."""
    gone = (F.col("edge_type") == "CALLS") & F.col("__gone").isNotNull()
    marked = edges.join(sources.select(F.col("id").alias("src"), F.lit(True).alias("__gone")).distinct(), "src", "left")
    return marked.where(~gone).select(edges.columns), marked.where(gone).count()


def orphans(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Methods that no type has."""
    return nodes.where("label = 'LogicUnit'").join(edges.where("edge_type = 'HAS_METHOD'").select(F.col("dst").alias("id")).distinct(), "id", "left_anti")


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old with the rows of new merged in by key: columns of new win, columns it lacks survive."""
    own = [c for c in new.columns if c not in keys]
    side = new.select(*keys, *(F.col(c).alias(f"__{c}") for c in own), F.lit(True).alias("__new"))
    both = old.join(side, keys, "full_outer")
    names = [*old.columns, *(c for c in own if c not in old.columns)]
    pick = lambda c: F.when(F.col("__new"), F.col(f"__{c}")).otherwise(F.col(c) if c in old.columns else F.lit(None)).alias(c) if c in own else F.col(c)
    return both.select(*(pick(c) for c in names))


def last_wins(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key; max_by sums partially, so a key with many rows is no hot task."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r")).select(*keys, "r.*")
