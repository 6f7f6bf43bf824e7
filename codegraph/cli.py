"""Command line: python -m codegraph.cli <command> --store DIR ...; prints text, or JSON lines with --json."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kb
from .config import Options
from .functions.columns import intent
from .model import embedder, text_model
from .operators import answers, graph, links, retrieval, text, web


def _show(df: DataFrame, as_json: bool) -> None:
    """All rows, one partition at a time in the driver."""
    for row in (df.select(F.to_json(F.struct("*"))) if as_json else df).toLocalIterator():
        print(row[0] if as_json else "  ".join(str(x) for x in row if x is not None))


def _first(base: retrieval.Base, name: str) -> str | None:
    row = retrieval.find(base.spark, base.nodes, name, base.intents, base.embedder).first()
    return row.id if row else None


def _walk(base: retrieval.Base, node: str, depth: int, incoming: bool, most: int = 30) -> DataFrame:
    """(hop, fqn, file_path): callers or callees of a node by hop and fqn."""
    seed = base.spark.createDataFrame([(node,)], "id string")
    found = graph.walks(base.edges.where("edge_type = 'CALLS'"), seed, depth, incoming)
    return found.join(base.nodes.select(F.col("id").alias("node"), "fqn", "file_path"), "node").select("hop", "fqn", "file_path").orderBy("hop", "fqn").limit(most)


def _code(base: retrieval.Base, ids: DataFrame, context: int = 0) -> DataFrame:
    spans = base.nodes.join(ids.select("id"), "id", "left_semi").select(F.col("id").alias("range_id"), "file_path", "start_line", "end_line")
    return kb.scan.read_range(base.lines, spans, context).select(F.col("range_id").alias("ord"), "file_path", "code")


def run(args: argparse.Namespace, spark: SparkSession) -> int:
    o = Options.load()
    store, model, vectors = kb.Store(spark, args.store), text_model(o), embedder(o)
    if args.command in ("ingest", "update"):
        print(json.dumps(getattr(kb, args.command)(spark, args.mirror, args.store, model, vectors, at=args.at, gamma=o.leiden_gamma, levels=o.leiden_max_levels, options=o), default=str))
        return 0
    if args.command == "validate":
        bad = kb.validate(store)
        _show(bad, args.json)
        return int(not bad.isEmpty())
    if args.command == "stats":
        _show(kb.stats(store).orderBy("kind", "name"), args.json)
        return 0
    base = kb.base(store, vectors, args.depth or o.traversal_depth)
    if args.command == "find":
        hits = retrieval.placed_hits(retrieval.search(base.lines, args.name, args.max))
        _show(hits.orderBy("place", "file_path", "line_number").select("place", "file_path", "line_number", "line"), args.json)
        _show(text.context(base.lines.select("file_path", "line_number", "line"), hits.where("place = 'production'").select("file_path", "line_number"), args.context, "file_path").orderBy("file_path", "hit_line", "line_number"), args.json)
        return 0
    if args.command in ("callers", "trace", "explain"):
        node = _first(base, args.name)
        if node is None:
            print(f"nothing found for {args.name}")
            return 1
        callers = _walk(base, node, args.depth, True, args.max)
        callees = _walk(base, node, 1 if args.command == "explain" else args.depth, False, args.max)
        if args.command == "explain":
            prompt = answers.prompt_for(f"Explain {args.name}.", "general", "", answers.snippets_text(_code(base, spark.createDataFrame([(node,)], "id string"))).first().kept, answers.nodes_text(callers.limit(12).unionByName(callees.limit(8)).withColumn("edge_type", F.lit("CALLS"))))
            print(model.call(prompt, 600))
            return 0
        _show(retrieval.shown(callers).orderBy("hop", "fqn"), args.json)
        if args.command == "trace":
            _show(retrieval.shown(callees).orderBy("hop", "fqn"), args.json)
        return 0
    if args.command == "debug":
        trace = sys.stdin.read() if args.name == "-" else open(args.name).read()
        frames = web.stack_trace(spark.createDataFrame([(0, trace)], "trace long, text string"), [x for x in o.stack_packages.split(",") if x])
        _show(frames, args.json)
        hits = frames.select(F.col("frame_no").alias("hit_id"), F.col("file").alias("file_path"), "line")
        _show(links.bridged(hits, base.nodes).orderBy("hit_id", "rn"), args.json)
        said = frames.select("exception").first()
        if said and said.exception:
            thrown = retrieval.search(base.lines, f"throw new {said.exception.rsplit('.', 1)[-1]}", 15)
            _show(thrown, args.json)
            units = links.bridged(hits, base.nodes).where("rn = 1").join(base.nodes, "fqn").select("id").distinct()
            code = answers.snippets_text(_code(base, units)).first()
            shown = "\n".join(f"{x.class_fqn}.{x.method} ({x.file}:{x.line})" for x in frames.orderBy("frame_no").collect())
            sites = "\n".join(f"{x.file_path}:{x.line_number}  {x.line}" for x in thrown.collect())
            print(model.call(answers.debug_prompt(said.exception, shown, code.kept if code else "", sites), 900))
        return 0
    if args.command == "analyze-pr":
        near = [] if base.summaries is None else [r.community_id for r in retrieval.semantic_route(base, args.name, text.candidates(base.summaries.count(), args.candidates)).summaries.collect()]
        print(json.dumps(answers.analyse_change(args.name, base.summaries, near, model) if near else {"answer": answers.NO_COMMUNITIES, "evaluated": 0, "communities_scored": 0}))
        return 0
    found = retrieval.route(base, args.name)
    kind = spark.createDataFrame([(args.name,)], "q string").select(intent(F.col("q")).alias("i")).first().i
    results = None
    if found.summaries is not None and "community_id" in found.summaries.columns:
        score = F.lit(100)
        if "distance" in found.summaries.columns:
            from .functions.columns import distance_score

            score = distance_score(F.col("distance"))
        results = found.summaries.select("community_id", score.cast("long").alias("score"), "text").where("score > 0")
    elif found.summaries is not None:
        results = found.summaries.select(F.lit(0).alias("community_id"), F.lit(100).alias("score"), "text")
    seeds = None if found.seeds is None else base.nodes.join(found.seeds.select("id"), "id", "left_semi").select("fqn", "file_path", F.lit("").alias("edge_type"))
    code = None if found.seeds is None else _code(base, found.seeds.orderBy("fqn").limit(12))
    print(json.dumps({"route": found.route} | answers.reduce(args.name, kind, results, code, seeds, model)))
    return 0


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    o = Options.load()
    p = argparse.ArgumentParser(prog="codegraph")
    sub = p.add_subparsers(dest="command", required=True)
    for name, depth in (("ingest", None), ("update", None), ("validate", None), ("stats", None), ("query", None), ("explain", 2), ("trace", 2), ("callers", 2), ("find", 1), ("debug", 1), ("analyze-pr", None)):
        c = sub.add_parser(name)
        c.add_argument("--store", required=True)
        c.add_argument("--json", action="store_true")
        if name in ("ingest", "update"):
            c.add_argument("mirror")
            c.add_argument("--at", default="1970-01-01T00:00:00")
        elif name not in ("validate", "stats"):
            c.add_argument("name", help="question, name, or file of a stack trace (- for standard input)")
        c.add_argument("--depth", type=int, default=depth)
        c.add_argument("--max", type=int, default=o.grep_max_hits if name == "find" else 30)
        c.add_argument("--context", type=int, default=o.context_lines)
        c.add_argument("--candidates", type=int, default=o.candidates)
    return run(p.parse_args(argv), spark or SparkSession.builder.appName("codegraph").getOrCreate())


if __name__ == "__main__":
    sys.exit(main())
