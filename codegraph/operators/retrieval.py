"""Finding code: by name, by text, by vector, and the four routes of a question."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..model import Embedder
from ..sources.files import place, production
from ..storage import ship
from . import communities, graph, links, postings, text


def find_nodes(nodes: DataFrame, name: str, most: int = 20, index: DataFrame | None = None) -> DataFrame:
    """Methods and types on production paths whose fqn or doc comment holds name, or that bear it, in order of fqn.

    With postings.build(nodes, "id", ["fqn", "name", "docstring"]) as index only candidates are looked at.
    """
    if index is not None and postings.grams(name):
        nodes = nodes.join(postings.candidates(index, [name], "id").select("id"), "id", "left_semi")
    named = F.col("fqn").contains(name) | (F.col("name") == name) | F.col("fqn").endswith(f".{name}") | F.coalesce(F.col("docstring").contains(name), F.lit(False))
    return nodes.where(F.col("label").isin("LogicUnit", "Component") & production(F.col("file_path")) & named).orderBy("fqn", "id").limit(most)


def find_by_fqns(nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """Methods and types whose fqn is in wanted(fqn)."""
    return nodes.where("label in ('LogicUnit', 'Component')").join(wanted.select("fqn").distinct(), "fqn", "left_semi")


def throw_sites(nodes: DataFrame, name: str, most: int = 20) -> DataFrame:
    """Methods on production paths whose doc comment or fqn holds the name of an exception."""
    held = F.coalesce(F.col("docstring").contains(name), F.lit(False)) | F.col("fqn").contains(name)
    return nodes.where((F.col("label") == "LogicUnit") & production(F.col("file_path")) & held).orderBy("fqn", "id").limit(most)


def _halved(texts: list[str], embedder: Embedder) -> list[tuple[list[float] | None, str | None]]:
    """A vector or an error for each text: a batch that fails is tried again in halves, down to single texts."""
    try:
        found = embedder.embed(texts)
        if len(found) != len(texts):
            raise ValueError(f"{len(found)} vectors for {len(texts)} texts")
        return [(v, None) for v in found]
    except Exception as e:  # any fault of the embedder is that text's result
        if len(texts) == 1:
            return [(None, f"{type(e).__name__}: {e}")]
        half = len(texts) // 2
        return _halved(texts[:half], embedder) + _halved(texts[half:], embedder)


def tried(rows: DataFrame, embedder: Embedder, column: str = "text", batch: int = 64) -> DataFrame:
    """rows with embedding and error, one of them null: texts go to the embedder in batches, null ones as empty."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            texts = part[column].fillna("").tolist()
            got = [x for i in range(0, len(texts), batch) for x in _halved(texts[i : i + batch], embedder)]
            yield part.assign(embedding=pd.Series([v for v, _ in got], part.index, object), error=pd.Series([e for _, e in got], part.index, object))

    ship(rows.sparkSession)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInPandas(run, f"{fields}, embedding array<float>, error string")


def embed(rows: DataFrame, embedder: Embedder, column: str = "text") -> DataFrame:
    """rows with embedding, null where the embedder fails."""
    return tried(rows, embedder, column).drop("error")


def semantic(spark: SparkSession, question: str, vectors: DataFrame, embedder: Embedder, k: int, where: str | None = None) -> DataFrame:
    """vectors(vec_id, embedding, ...) nearest to the question, with rank and distance; where filters their metadata first."""
    asked = spark.createDataFrame([(0, embedder.embed([question])[0])], "query_id long, query array<float>")
    near = text.nearest(asked, vectors, k, literal=F.expr(where) if where else None)
    return near.drop("query_id").join(vectors.drop("embedding"), "vec_id").orderBy("rank")


def by_geid(chunks: DataFrame, geid: str) -> DataFrame:
    return chunks.where(F.col("geid") == geid).orderBy("chunk_id").limit(1)


def literal_in_intents(spark: SparkSession, name: str, vectors: DataFrame, embedder: Embedder, k: int = 20) -> DataFrame:
    """Of the intents nearest to a name, those that hold it."""
    return semantic(spark, name, vectors, embedder, k).where(F.col("text").contains(name))


def find(spark: SparkSession, nodes: DataFrame, name: str, vectors: DataFrame | None, embedder: Embedder | None) -> DataFrame:
    """(id, fqn): find_nodes(), or if it finds none, the methods whose intents hold the name."""
    found = find_nodes(nodes, name).select("id", "fqn")
    if vectors is None or embedder is None or not found.isEmpty():
        return found
    return literal_in_intents(spark, name, vectors, embedder).select(F.col("geid").alias("id"), "fqn").distinct()


def search(lines: DataFrame, symbol: str, most: int = 50, per_file: int = 50, repos: list[str] | None = None, suffix: str | None = None) -> DataFrame:
    """(symbol, file_path, line_number, line) of exact hits in lines(repo, file_path, line_number, line), trimmed; repos and suffix narrow the files first."""
    own = lines if repos is None else lines.where(F.col("repo").isin(repos))
    own = own if suffix is None else own.where(F.col("file_path").endswith(suffix))
    return text.grep(own.select("file_path", "line_number", "line"), [symbol], per_file, most, "file_path").withColumn("line", F.btrim("line"))


def placed_hits(hits: DataFrame) -> DataFrame:
    """hits with place: production, test or other."""
    return hits.withColumn("place", place(F.col("file_path")))


def follow_constants(snippets: DataFrame, lines: DataFrame, most: int = 3, hits_each: int = 10) -> DataFrame:
    """(constant, file_path, line_number): the first production hit of each constant that snippets(file_path, code) name, in a file not seen yet.

    The longest constants come first; each file is taken once, by the first constant that reaches it.
    """
    whole = snippets.agg(F.concat_ws("\n", F.collect_list("code")).alias("code"))  # a question's snippets, a dozen
    named = [r.c for r in whole.select(F.explode(C.constants(F.col("code"), most)).alias("c")).collect()]
    if not named:
        return lines.sparkSession.createDataFrame([], "constant string, file_path string, line_number long")
    found = text.grep(lines.select("file_path", "line_number", "line"), named, hits_each, hits_each, "file_path")
    found = found.where(production(F.col("file_path")) & ~F.col("file_path").contains("Test")).join(snippets.select("file_path").distinct(), "file_path", "left_anti")
    rows = sorted(((named.index(r.symbol), r.file_path, r.line_number) for r in found.collect()))  # ten hits each at most
    taken, out = set(), []
    for i, path, line in rows:
        if path not in taken and not any(x[0] == named[i] for x in out):
            taken.add(path)
            out.append((named[i], path, line))
    return lines.sparkSession.createDataFrame(out, "constant string, file_path string, line_number long")


def summaries_of(summaries: DataFrame, wanted: DataFrame) -> DataFrame:
    """summaries whose community is in wanted(community_id); absent ones are left out."""
    return summaries.join(wanted.select("community_id").distinct(), "community_id", "left_semi")


@dataclass
class Found:
    """What a route gives: its name, hits, seeds, affected nodes and summaries (some may be None)."""

    route: str
    summaries: DataFrame | None = None
    seeds: DataFrame | None = None
    affected: DataFrame | None = None
    hits: DataFrame | None = None


@dataclass
class Base:
    """The tables that questions are answered from; text tables may be None."""

    spark: SparkSession
    nodes: DataFrame
    edges: DataFrame
    lines: DataFrame | None = None
    intents: DataFrame | None = None
    summaries: DataFrame | None = None
    subsystems: DataFrame | None = None
    whole: DataFrame | None = None
    embedder: Embedder | None = None
    depth: int = 3


def global_route(base: Base, question: str) -> Found:
    """The text of the whole, else of every subsystem, else the semantic route."""
    if base.whole is not None and not base.whole.isEmpty():
        return Found("global", base.whole.select("id", "text"))
    if base.subsystems is not None and not base.subsystems.isEmpty():
        return Found("global_l2", base.subsystems.select("id", "text"))
    return Found("global_fallback", semantic_route(base, question).summaries)


def semantic_route(base: Base, question: str, k: int = 20) -> Found:
    if base.summaries is None or base.embedder is None:
        return Found("semantic")
    return Found("semantic", semantic(base.spark, question, base.summaries.withColumnRenamed("community_id", "vec_id"), base.embedder, k).withColumnRenamed("vec_id", "community_id"))


def _traverse(base: Base, seeds: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Affected nodes of seeds(id), and the communities of both."""
    hit = graph.affected_units(base.edges, base.nodes, seeds, base.depth)
    own = base.nodes.join(seeds.select("id").distinct(), "id", "left_semi").where("community_id is not null").select("community_id")
    return hit, communities.ids(hit.select("community_id").unionByName(own))


def symbolic_route(base: Base, question: str, symbols: list[str]) -> Found:
    """Symbols to lines, lines to nodes, nodes to what they affect, that to summaries; semantic where a step finds nothing."""
    hits = None
    for s in symbols:
        part = search(base.lines, s) if base.lines is not None else None
        hits = part if hits is None else hits.unionByName(part) if part is not None else hits
    if hits is None or hits.isEmpty():
        return Found("symbolic_fallback", semantic_route(base, question).summaries)
    numbered = hits.select(F.concat_ws(":", "file_path", F.format_string("%09d", "line_number")).alias("hit_id"), "file_path", F.col("line_number").alias("line")).distinct()
    seeds = links.bridge_seeds(numbered, base.nodes).join(base.nodes.select("id", "fqn"), "fqn")
    if seeds.isEmpty():
        return Found("symbolic_no_bridge", semantic_route(base, question).summaries, hits=hits)
    hit, wanted = _traverse(base, seeds)
    return Found("symbolic", summaries_of(base.summaries, wanted) if base.summaries is not None else None, seeds, hit, hits)


def exact_route(base: Base, question: str, entities: list[str]) -> Found:
    """Entities to nodes, what they affect, and its summaries; those of the seeds only where nothing is affected."""
    seeds = None
    for name in entities:
        part = find(base.spark, base.nodes, name, base.intents, base.embedder)
        seeds = part if seeds is None else seeds.unionByName(part)
    if seeds is None or seeds.isEmpty():
        return Found("semantic", semantic_route(base, question).summaries)
    seeds = seeds.distinct()
    hit = graph.affected_units(base.edges, base.nodes, seeds, base.depth)
    wanted = communities.ids(hit) if not hit.isEmpty() else communities.affected(base.nodes, seeds)
    return Found("exact", summaries_of(base.summaries, wanted) if base.summaries is not None else None, seeds, hit)


def route(base: Base, question: str) -> Found:
    """The question's way by its names and phrases."""
    q = base.spark.createDataFrame([(question,)], "q string")
    r = q.select(C.dispatch(F.col("q")).alias("way"), C.symbols(F.col("q")).alias("symbols"), C.entities(F.col("q")).alias("entities")).first()
    if r.way == "global":
        return global_route(base, question)
    if r.way == "symbolic":
        return symbolic_route(base, question, r.symbols)
    return exact_route(base, question, r.entities) if r.way == "exact" else semantic_route(base, question)


def shown(traversal: DataFrame, most: int = 8) -> DataFrame:
    """The first rows of each hop of traversal(hop, fqn), for display."""
    from pyspark.sql import Window as W

    rn = F.row_number().over(W.partitionBy("hop").orderBy("fqn"))
    return traversal.withColumn("rn", rn).where(F.col("rn") <= most).drop("rn")


def gathered(hits: DataFrame, semantic_hits: DataFrame, seeds: DataFrame, affected: DataFrame, most: int = 20) -> DataFrame:
    """(source, fqn, file_path): all evidence with where it is from, duplicates kept, the first of what is affected."""
    tag = lambda df, name: df.select(F.lit(name).alias("source"), F.col("fqn"), F.col("file_path"))
    return tag(hits, "grep").unionByName(tag(semantic_hits, "semantic")).unionByName(tag(seeds, "seed")).unionByName(tag(affected.orderBy("fqn").limit(most), "affected"))


def with_lines(hits: DataFrame, nodes: DataFrame, most: int = 15) -> DataFrame:
    """The first hits(fqn, rank) with the lines of their nodes, null where there is none."""
    own = nodes.select("fqn", F.col("file_path").alias("in_file"), "start_line", "end_line").dropDuplicates(["fqn"])
    return hits.orderBy("rank").limit(most).join(own, "fqn", "left")
