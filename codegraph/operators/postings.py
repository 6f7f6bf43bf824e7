"""Literal search over a table of postings: the three-character grams of each text, and which rows hold them.

Postings are written once, in segments: the keys of some rows' grams, sorted by gram, a list for each.
A segment is made within a task, so nothing is shuffled or sorted whole, a gram that stands in most
rows has a list in each segment like any other, and a lookup reads its grams' pages. A literal is
answered by its rarest grams: rows that hold all of these are candidates, and those whose text
really contains it are hits. Literals of under three characters have no gram and are looked for
in all rows.

Edge cases: null texts and texts of under three characters have no postings; an empty literal is
contained in every non-null text; repeated keys are one row to the postings and are all verified.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import materialise, ship
from . import text

#: Characters of a gram, and grams of a literal that are looked up.
GRAM, RAREST = 3, 4
#: Characters of a segment's texts.
PIECE = 1 << 21


def grams(value: str) -> list[str]:
    return sorted({value[i : i + GRAM] for i in range(len(value) - GRAM + 1)})


def packed(gram: str) -> int:
    """A gram as a long, 21 bits a character."""
    return ord(gram[0]) << 42 | ord(gram[1]) << 21 | ord(gram[2])


def _segment(keys: pa.Array, texts: list[tuple[str, ...]], schema: pa.Schema) -> pa.RecordBatch:
    """The postings of some rows, each with the texts of its columns."""
    row = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    flat = [x for t in texts for x in t]
    size = np.array([len(x) for x in flat], np.int64)
    code = np.frombuffer("".join(flat).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    of = np.repeat(np.arange(len(flat)), size)
    within = of[: -GRAM + 1] == of[GRAM - 1 :]
    gram = (code[:-2] << 42 | code[1:-1] << 21 | code[2:])[within]
    at = row[of[: -GRAM + 1][within]]
    order = np.argsort(gram, kind="stable")  # rows stay in order within a gram
    gram, at = gram[order], at[order]
    once = np.append(True, (gram[1:] != gram[:-1]) | (at[1:] != at[:-1]))[: len(gram)]
    gram, at = gram[once], at[once]
    first = np.flatnonzero(np.append(True, gram[1:] != gram[:-1])[: len(gram)])
    lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(gram)), pa.int32()), keys.take(pa.array(at)).cast(schema.field("keys").type.value_type))
    return pa.RecordBatch.from_arrays([pa.array(gram[first]), lists.cast(schema.field("keys").type)], schema=schema)


def _segments(key: str, columns: list[str], schema: pa.Schema):
    def cut(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            texts = list(zip(*([x or "" for x in part[c].to_pylist()] for c in columns), strict=True))
            start = held = 0
            for i, t in enumerate(texts):
                held += sum(map(len, t))
                if held >= PIECE or i + 1 == len(texts):
                    if held >= GRAM:
                        yield _segment(part[key].slice(start, i + 1 - start), texts[start : i + 1], schema)
                    start, held = i + 1, 0

    return cut


def build(rows: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(gram, keys): the rows that hold each gram in one of the text columns, a list for each gram and segment."""
    ship(rows.sparkSession)
    kind = dict(rows.dtypes)[key]
    schema = pa.schema([("gram", pa.int64()), ("keys", pa.list_({"string": pa.string(), "int": pa.int32(), "bigint": pa.int64()}[kind]))])
    return materialise(rows.select(key, *columns).mapInArrow(_segments(key, columns, schema), f"gram long, keys array<{kind}>"), "postings")


def candidates(postings: DataFrame, literals: list[str], key: str) -> DataFrame:
    """(symbol, key): rows that hold the rarest grams of each literal; literals without grams give none."""
    spark = postings.sparkSession
    wanted = [(x, g) for x in dict.fromkeys(literals) for g in grams(x)]
    found = postings.select("gram", F.explode("keys").alias(key))
    if not wanted:
        return spark.createDataFrame([], "symbol string, gram long").join(found, "gram").select("symbol", key)
    # A count for each distinct gram of the literals.
    count = dict(postings.where(F.col("gram").isin(sorted({packed(g) for _, g in wanted}))).groupBy("gram").agg(F.sum(F.size("keys"))).collect())
    rarest = {x: sorted(grams(x), key=lambda g: (count.get(packed(g), 0), g))[:RAREST] for x in dict.fromkeys(literals) if grams(x)}
    looked = sorted({g for gs in rarest.values() for g in gs})
    asked = F.create_map(*(F.lit(v) for g in looked for v in (packed(g), [x for x, gs in rarest.items() if g in gs])))
    need = F.create_map(*(F.lit(v) for x, gs in rarest.items() for v in (x, len(gs))))
    found = postings.where(F.col("gram").isin([packed(g) for g in looked])).select("gram", F.explode("keys").alias(key)).select("gram", key, F.explode(asked[F.col("gram")]).alias("symbol"))
    return found.groupBy("symbol", key).agg(F.count_distinct("gram").alias("n")).where(F.col("n") == need[F.col("symbol")]).select("symbol", key)


def contains(rows: DataFrame, postings: DataFrame, literals: list[str], key: str, columns: list[str]) -> DataFrame:
    """rows with symbol: those any of whose text columns contains the literal, once for each such literal."""
    holds = F.lit(False)
    for c in columns:
        holds = holds | F.coalesce(F.col(c).contains(F.col("symbol")), F.lit(False))
    long_ = [x for x in dict.fromkeys(literals) if grams(x)]
    short = [x for x in dict.fromkeys(literals) if not grams(x)]
    out = rows.join(candidates(postings, long_, key), key).where(holds)
    if short:
        out = out.unionByName(rows.withColumn("symbol", F.explode(F.array(*map(F.lit, short)))).where(holds).select(out.columns))
    return out


def grep(docs: DataFrame, postings: DataFrame, words: list[str], per_file: int, most: int, key: str = "doc_id", column: str = "text") -> DataFrame:
    """What text.grep() finds in the lines of docs, reading those of candidate documents only."""
    hits = contains(docs.select(key, column), postings, words, key, [column])
    each = hits.select("symbol", key, F.posexplode(F.split(column, "\n", -1)).alias("p", "line"))
    each = each.select("symbol", key, (F.col("p") + 1).cast("long").alias("line_number"), "line").where(F.col("line").contains(F.col("symbol")))
    return text.first_hits(each, per_file, most, key)
