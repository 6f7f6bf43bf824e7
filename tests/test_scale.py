"""Ways that large inputs take, against the plain ones on small inputs."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from codegraph.operators import graph, java, web


@pytest.mark.parametrize("most", [1 << 16, 12])
def test_blast_radius_of_many_seeds(spark, most):
    """Arrays a level find what rows find: over circles, several types, hubs (12: most seeds are), targets left out."""
    r = random.Random(3)
    rows = [(r.choice(["CALLS", "INJECTS"]), f"n{r.randrange(40)}", f"n{r.randrange(40)}") for _ in range(70)] + [("CALLS", f"n{i}", "n0") for i in range(15)]
    edges = spark.createDataFrame(rows, "edge_type string, src string, dst string")
    seeds = spark.createDataFrame([(f"n{i}",) for i in range(40)] + [("n1",), ("none",)], "id string")
    targets = spark.createDataFrame([(f"n{i}", i % 3 if i % 7 else None) for i in range(40) if i % 5], "id string, community_id int")
    found = graph.blast_radius_of_many(edges, seeds, targets, 3, most)
    plain = graph.blast_radius(edges, seeds, 3).join(targets, graph.F.col("affected") == targets["id"])
    names = ["seed", "affected", "hop", "edge_type", "community_id"]
    key = lambda x: tuple(map(str, x))
    assert sorted(map(tuple, found.select(names).collect()), key=key) == sorted(map(tuple, plain.select(names).collect()), key=key) != []


def test_types_are_given_out_in_pieces():
    """What a task holds at once follows neither the batch nor its types: many files come out as several small batches, with the same rows."""
    from codegraph.operators import java

    text = "package a;\nclass A {\n" + "    void f() { g(); new B(); }\n" * 2000 + "}\n"
    n = 4 * java.PIECE // len(text)
    part = pa.RecordBatch.from_pydict({"file_path": [f"f{i}" for i in range(n)], "repo": ["r"] * n, "text": [text] * n})
    out = list(java._rows(iter([part])))
    assert sum(b.num_rows for b in out) == n and len(out) >= 4 and max(b.num_rows for b in out) <= n // 3
    assert [r["file_path"] for b in out for r in b.to_pylist()] == [f"f{i}" for i in range(n)]


def test_names_are_cut_out_where_one_may_begin(spark):
    """Names within pieces, overlapping, short and beyond the BMP, by brute force; of a long text only what may be a name becomes a row."""
    from codegraph.operators import web

    names = ["N_1", "N_12", "T_7_X", "A", "É\U0001f600Z", "T_", "ZZZZ", ""]
    texts = {"f": ["XN_12Y T_7_XX", "ZZZ"], "g": ["É\U0001f600ZA", None, ""], "h": ["Q" * 3000 + "N_1" + "Q" * 3000], "i": []}
    want = sorted({(f, x) for f, ps in texts.items() for p in ps for x in names if x and p and x in p})
    t = spark.createDataFrame(list(texts.items()), "file_path string, pieces array<string>")
    known = spark.createDataFrame([(x,) for x in names], "name string")
    assert sorted(map(tuple, web._contained(t, known).collect())) == want
    cut = web._cutter({"N_1": [3, 4]})(iter([pa.RecordBatch.from_pydict({"file_path": ["h"], "pieces": [texts["h"]]})]))
    assert sum(b.num_rows for b in cut) <= 2


def test_postings_are_lists_of_segments(spark):
    """A gram is one row a segment, not one for each row that holds it; keys are those that a scan finds, repeated ones once."""
    from codegraph.operators import postings

    rows = [(i, "the sea" if i % 3 else "ab", "és\U0001f600x" if i % 5 == 0 else None) for i in range(3000)] + [(1, "theory", None)]
    d = spark.createDataFrame(rows, "doc_id long, text string, more string").coalesce(1)
    index = postings.build(d, "doc_id", ["text", "more"])
    assert index.count() < 100
    got = sorted(map(tuple, postings.candidates(index, ["the", "és\U0001f600", "theory"], "doc_id").collect()))
    assert got == sorted({(w, i) for i, a, b in rows for w in ("the", "és\U0001f600", "theory") if w in a or w in (b or "")})


@pytest.mark.parametrize("name", ["callers_d2", "callees_d2"])
def test_walks_carry_no_names(spark, name):
    """What is ranked for each target are numbers; the names are ordered once, before they meet the walks."""
    from codegraph.queries import QUERIES

    plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" in plan and "fqn" not in plan


@pytest.mark.parametrize("metric", ["cosine", "l2"])
def test_nearest_makes_no_row_for_each_pair(spark, monkeypatch, metric):
    """A block gives out k vectors for each query at most; distances and ties, also of copies, are those of the metric's expression."""
    import numpy as np
    from pyspark.sql import Window as W

    from codegraph.functions.columns import squared_l2
    from codegraph.operators import neighbours

    for name, small in (("BLOCK", 40), ("ASKED", 16), ("CELLS", 300), ("PAIRS", 7)):
        monkeypatch.setattr(neighbours, name, small)
    F, way = graph.F, {"cosine": neighbours.cosine_distance, "l2": squared_l2}[metric]
    x = np.random.default_rng(5).normal(size=(600, 9)).astype(np.float32)
    x[200:300] = x[7]
    v = spark.createDataFrame([(i, [float(a) for a in row]) for i, row in enumerate(x)], "vec_id long, embedding array<float>")
    q = v.where("vec_id % 9 = 7").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    d = q.crossJoin(v).select("query_id", "vec_id", way(F.col("embedding"), F.col("query")).alias("d"))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy("d", "vec_id")).cast("long")
    want = d.withColumn("rank", rank).where("rank <= 12").select("query_id", "vec_id", "rank", F.round("d", 6).alias("distance"))
    found = neighbours.nearest(q, v, 12, way)
    assert "zip_with" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect()))
    side = pa.table({"query_id": [1, 2], "query": [[1.0, 2.0], [2.0, 1.0]]})
    assert neighbours._met(way, 3, ("query_id", "vec_id"), False)(side, pa.table({"vec_id": list(range(500)), "embedding": [[1.0, 2.0]] * 500})).num_rows == 6


def test_groups_of_a_source_are_looked_up():
    """A group's end and the calls of a body are found without going over their tokens again: 4,000 groups that never end take no 4,000 ways to the end of the file."""
    import time

    from codegraph.operators import java

    text = "class A {\n  void f() {\n" + "    new B<x(1); g(2);\n" * 4000 + "  }\n}\n"
    began = time.process_time()
    unit = next(java.Source(text).types())["logic_units"][0]
    assert time.process_time() - began < 3
    assert unit["name"] == "f" and unit["end_line"] == 4003
    odd = next(java.Source("/** d */ class É { // x\n int a = 1; /* ( */ void f(B b) { é.g(\"(\"); this . h(); new C<D>(); } }").types())
    assert odd["docstring"] == "/** d */" and [(u["calls"], u["instantiates"], u["start_line"]) for u in odd["logic_units"]] == [(["é.g", "this.h"], ["C"], 2)]


def test_endpoints_take_one_pass_over_the_files(spark):
    """Annotations of all kinds in one reading of the texts for Spring and one for JAX-RS; files without one are neither cut nor searched."""
    from codegraph.operators import java, web

    texts = ['@RequestMapping("/r") class A { @GetMapping("/a") public int f() { } @PostMapping("/b")\n public int g() { } @GetMapping("/c") }', '\r\n@Path("/p")\r\n@POST\r\nclass B { public X h() { } }\n@Path( "/q" )\nint z;\n', "class C { String path; }", "@GetMapping(value) class D { }"]
    files = spark.createDataFrame([(f"f{i}", "r", t) for i, t in enumerate(texts)], "file_path string, repo string, text string")
    types = java.parse(files).cache()
    found = web.endpoints(files, types, java.units(types))
    got = [(*r.ord, r.path, r.verb, r.handler_fqn) for r in found.orderBy("ord").collect()]
    assert got == [("f0", 0, 0, "/a", "GET", "A.f"), ("f0", 0, 1, "/c", "GET", "A.handler"), ("f0", 1, 0, "/b", "POST", "A.g"), ("f0", 6, 0, "/r", "GET", "A.f"), ("f1", 7, 1, "/p", "POST", "B.h"), ("f1", 7, 4, "/q", "POST", "B.handler")]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") and plan.count("Generate ") <= 4


def test_edges_are_distinct_before_they_are_text(spark):
    """Pairs are grouped as numbers: no plan of an edge kind groups by ids made of text."""
    from codegraph.sources.derived import edges

    for kind in ("CALLS", "QUERIES_TABLE", "READS_CONFIG", "INSTANTIATES", "DEPENDS_ON"):
        plan = edges(spark, "/root/testdata/sf0.001", kind)._jdf.queryExecution().optimizedPlan().toString()
        assert all("src" not in x.split("Aggregate [")[1].split("]")[0] for x in plan.splitlines() if "Aggregate [" in x), kind


def test_parse_leaves_out_what_is_not_read(spark):
    """Without units types and fields are the same; without bodies all but texts, calls and creations is."""
    text = """package p; import q.Base;
    /** A. */ @Component public class A<T extends Comparable<T>> extends Base implements I, J<Map<String, T>> {
        @Autowired private B b, c[]; int n = f(1, new int[] { 2 });
        static { g(); }
        public A(@Named("x,y)") Map<String, List<T>> m, int... many) throws E, F { this.b = new B(m); h("}"); }
        /** Doc. */ @Override public <X> X run(final X x) [] { if (x == null) { return make(x); } return x; }
        abstract void none();
        enum K { ONE { int z() { return 1; } }, TWO; void in() { } }
    }
    interface I { default int one() { return two(); } int two(); }"""
    files = spark.createDataFrame([("r", "A.java", text), ("r", "broken.java", "class C { void m(int a { } "), ("r", "none.java", None)], "repo string, file_path string, text string")
    rows = lambda **how: {r.fqn: r.asDict(True) for r in java.parse(files, **how).collect()}
    whole, types, heads = rows(), rows(units=False), rows(bodies=False)
    assert set(whole) >= {"p.A", "p.A.K", "p.I"} and len(whole["p.A"]["logic_units"]) == 3
    assert [u["calls"] for u in whole["p.A"]["logic_units"]] == [["h"], ["make"], []]
    assert types == {k: v | {"logic_units": []} for k, v in whole.items()}
    lean = {"body_text": None, "calls": [], "instantiates": []}
    assert heads == {k: v | {"logic_units": [u | lean for u in v["logic_units"]]} for k, v in whole.items()}


def test_cutter_hands_on_many_files_at_once():
    """What is cut out of many files comes in few batches, each file's names once."""
    files = pa.RecordBatch.from_pydict({"file_path": pa.array([f"f{i}" for i in range(3000)]), "pieces": pa.array([[f"x t_{i}_x", None, f"t_{i}_x"] if i % 3 else None for i in range(3000)], pa.list_(pa.string()))})
    out = list(web._cutter({"t_1": [5, 6, 7], "t_2": [5]})(iter([files, files.slice(0, 0)])))
    assert len(out) == 1 and 0 < out[0].num_rows < web.CUTS
    found = sorted(zip(out[0]["file_path"].to_pylist(), out[0]["name"].to_pylist(), strict=True))
    want = sorted((f"f{i}", f"t_{i}_x"[:k]) for i in range(3000) if i % 3 for k in ({"1": (5, 6, 7), "2": (5,)}.get(str(i)[0], ())) if k <= len(f"t_{i}_x"))
    assert found == want


def test_sources_travel_as_numbers(spark):
    """Texts are written after the last shuffle and parsed where they lie; intermediate tables are dense."""
    from pathlib import Path

    from codegraph.operators import java
    from codegraph.sources import java_text
    from codegraph.storage import materialise

    df = java_text.sources(spark, "/root/testdata/sf0.001", 7)
    plan = lambda d: d._jdf.queryExecution().optimizedPlan().toString()
    assert plan(df).index("public class C") < plan(df).index("RepartitionByExpression") and df.rdd.getNumPartitions() == 7
    repartitions = lambda d: plan(d).count("RepartitionBy")
    assert repartitions(java.parse(df, dealt=True)) == repartitions(df) == repartitions(java.parse(df)) - 1
    assert java.parse(df, dealt=True).count() == df.count() == 150
    assert list(Path(materialise(df, "dense").written.removeprefix("file://")).glob("*.zstd.parquet"))


def test_bodies_that_may_ask(spark):
    """What may_ask() leaves out holds no client call."""
    bodies = ['restTemplate.get("http://h/a")', 'x.get("/b")', "return 1;", None, 'new HttpPut( "/c")', "restTemplate"]
    df = spark.createDataFrame([(f"u{i}", str(i), b) for i, b in enumerate(bodies)], "fqn string, geid string, body_text string")
    assert {r.fqn for r in df.where(web.may_ask(F.col("body_text"))).collect()} == {"u0", "u1", "u4"} == {r.caller_fqn for r in web.outbound(df).collect()}


def test_calls_meet_once(spark):
    """A method's targets are distinct without a shuffle of their own; edges are, whoever calls."""
    from codegraph.operators import build

    units = spark.createDataFrame([(1, "a.A.f", "a.A", ["g", "this.g", "a.B.h"]), (1, "a.A.f", "a.A", ["g"]), (2, "a.A.g(int)", "a.A", []), (3, "a.B.h", "a.B", ["a.A.g"])], "geid long, fqn string, owner string, calls array<string>")
    found = build.calls(units)
    assert sorted(tuple(r) for r in found.collect()) == [(1, 2), (1, 3), (3, 2)]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Aggregate") == 1


def test_blast_radius_of_many_shuffles_narrow_rows(spark):
    """One array of ids, one of hops and one a column, whatever the depth; ids stay of the type given, types are places."""
    from codegraph.operators import graph

    edges = spark.createDataFrame([("CALLS", 1, 2), ("CALLS", 2, 3), ("A", 2, 3), ("CALLS", 3, 1)], "edge_type string, src int, dst int")
    nodes = spark.createDataFrame([(i, i % 2) for i in (1, 2, 3)], "id int, community_id byte")
    found = graph.blast_radius_of_many(edges, nodes.select("id"), nodes, 3)
    assert {tuple(r) for r in found.collect()} == {(2, 1, 1, "CALLS", 1), (2, 3, 2, "CALLS", 1), (3, 2, 1, "A", 0), (3, 1, 2, "A", 1), (1, 3, 1, "CALLS", 1), (1, 2, 2, "CALLS", 0)}
    assert dict(found.dtypes)["affected"] == "int"
    last = found._jdf.queryExecution().optimizedPlan().toString()
    last = last[last.index("RepartitionByExpression [seed#") :].split("\n")[1]
    assert last.count("#") <= 8 and "Project [at#" in last and "type#" in last


def test_numbers_say_ids(spark):
    """Ids become numbers of either width and back, whatever the letter."""
    from codegraph.queries import LETTERS, _kind, _letter, _number

    ids = [f"{x}{k}" for x in LETTERS for k in (0, 1, 77, (1 << 26) - 1)]
    df = spark.createDataFrame([(x,) for x in ids], "id string")
    for kind in ("int", "long"):
        n = df.select("id", _number(F.col("id"), kind).alias("n"))
        assert n.select("n").distinct().count() == len(ids) and all(r[0] == r[1] for r in n.select("id", _letter(F.col("n"))).collect())
    big = df.limit(1).select(_letter(_number(F.lit("o9000000000"))).alias("x"))
    assert big.first().x == "o9000000000" and _kind(spark, "/root/testdata/sf0.001") == "int"


@pytest.mark.parametrize("incoming,most,piece", [(True, 30, 4096), (False, 4, 2)])
def test_first_walks(spark, incoming, most, piece):
    """What walks() finds, ranked: over circles, loops, nodes without a name, neighbours in several pieces; ends are shuffled once."""
    r = random.Random(8)
    rows = {("CALLS", r.randrange(25), r.randrange(25)) for _ in range(70)} | {("CALLS", i, 3) for i in range(9)} | {("CALLS", 3, 3)}
    edges = spark.createDataFrame(sorted(rows), "edge_type string, src int, dst int")
    names = spark.createDataFrame([(i, f"f{(i * 7) % 25:02}") for i in range(25) if i % 6], "id int, fqn string")
    places = graph.placed(names)
    assert [x.id for x in places.orderBy("place").collect()] == [x.id for x in names.orderBy("fqn").collect()] and dict(places.dtypes)["place"] == "int"
    assert sorted(x.place for x in places.collect()) == list(range(20))
    of, want = {x.id: x.place for x in places.collect()}, set()
    found = {}
    for x in graph.walks(edges, spark.range(25), 2, incoming).collect():
        if x.node in of:
            found.setdefault(x.target, set()).add((x.hop, of[x.node], x.node))
    for target, ends in found.items():
        want |= {(target, node, hop, i + 1) for i, (hop, _, node) in enumerate(sorted(ends)[:most])}
    got = graph.first_walks(edges, places, most, incoming, piece)
    assert {tuple(x) for x in got.collect()} == want != set()
    assert got._jdf.queryExecution().optimizedPlan().toString().count("RepartitionByExpression [target") == 2  # neighbours and ends


def test_written_edges_are_read_both_ways(spark, monkeypatch):
    """Paths over edges that are on storage write no copy of them; edges that are there twice, or both ways, change no path."""
    from codegraph.storage import materialise

    rows = [("CALLS", "a", "b"), ("CALLS", "b", "a"), ("HAS_METHOD", "a", "b"), ("CALLS", "c", "b"), ("CALLS", "c", "b"), ("CALLS", "a", "x"), ("CALLS", "x", "c")]
    edges = spark.createDataFrame(rows, "edge_type string, src string, dst string")
    pairs, names = spark.createDataFrame([("a", "c"), ("x", "b")], "entry string, sink string"), []
    monkeypatch.setattr(graph, "materialise", lambda df, name: names.append(name) or materialise(df, name))
    got = lambda e: sorted((r.entry, r.sink, r.path) for r in graph.shortest_paths(e, pairs).collect())
    assert got(edges) == [("a", "c", ["a", "b", "c"]), ("x", "b", ["x", "a", "b"])] and "both" in names
    names.clear()
    assert got(materialise(edges, "side")) == got(edges.distinct()) and names.count("both") == 1


@pytest.mark.parametrize("most", [15, 4])
def test_path_lengths_of_all_pairs(spark, most):
    """All entries to all sinks, more than a row's bits of them, against brute force: circles, loops, parts without a way, ends that are both."""
    r = random.Random(4)
    rows = {(f"n{r.randrange(150)}", f"n{r.randrange(150)}") for _ in range(150)} | {("n1", "n1")}
    ways = {}
    for a, b in rows:
        ways.setdefault(a, set()).add(b)
        ways.setdefault(b, set()).add(a)
    entries, sinks, want = [f"n{i}" for i in range(140)], {f"n{i}" for i in range(9, 150, 2)}, set()
    for e in entries:
        seen, front = {e}, {e}
        for n in range(2, most + 1):
            front = {y for x in front for y in ways.get(x, ())} - seen
            seen |= front
            want |= {(e, x, n) for x in front & sinks}
    edges = spark.createDataFrame([("CALLS", a, b) for a, b in rows], "edge_type string, src string, dst string")
    ids = lambda xs: spark.createDataFrame([(x,) for x in [*xs, *list(xs)[:3]]], "id string")
    got = [tuple(x) for x in graph.path_lengths(edges, ids(entries), ids(sinks), most).collect()]
    assert len(got) == len(want) and set(got) == want and len(want) > 200


def test_flow_path_lengths_leaves_out_no_pair(spark):
    """More entry points and sinks than 200, which once was all the query took."""
    from codegraph.queries import QUERIES

    found = QUERIES["flow_path_lengths"](spark, "/root/testdata/sf0.001")
    n, entries, sinks = found.agg(F.count("*"), F.count_distinct("entry"), F.count_distinct("sink")).first()
    assert (n, entries, sinks) == (682686, 414, 1650)
