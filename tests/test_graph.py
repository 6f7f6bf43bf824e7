"""Graph operators on small graphs with known answers, and against plain Python on random ones."""

import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from codegraph.operators import communities, graph, links, tags, text


def edges(spark, rows):
    return spark.createDataFrame(rows, "edge_type string, src string, dst string")


def ids(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "id string")


def test_blast_radius_cases(spark):
    e = edges(spark, [("CALLS", "b", "a"), ("INJECTS", "c", "a"), ("CALLS", "d", "b"), ("CALLS", "d", "c"), ("CALLS", "a", "b"), ("CALLS", "a", "a"), ("CALLS", "x", "d")])
    got = {tuple(r) for r in graph.blast_radius(e, ids(spark, "a"), 2).collect()}
    assert got == {("a", "b", 1, "CALLS"), ("a", "c", 1, "INJECTS"), ("a", "d", 2, "CALLS")}
    assert graph.blast_radius(e, ids(spark, "x"), 5).count() == 0
    assert {(r.seed, r.affected) for r in graph.blast_radius(e, ids(spark, "a", "c"), 1).collect()} == {("a", "b"), ("a", "c"), ("c", "d")}


def test_blast_radius_random(spark):
    rng = random.Random(5)
    rows = [("CALLS", f"n{rng.randrange(30)}", f"n{rng.randrange(30)}") for _ in range(60)]
    back = {}
    for _, a, b in rows:
        back.setdefault(b, set()).add(a)
    want = set()
    for s in {x for r in rows for x in r[1:]}:
        seen, front = {s}, {s}
        for hop in range(1, 6):
            front = {y for x in front for y in back.get(x, ())} - seen
            seen |= front
            want |= {(s, x, hop) for x in front}
    nodes = ids(spark, *{x for r in rows for x in r[1:]})
    assert {tuple(r)[:3] for r in graph.blast_radius(edges(spark, rows), nodes, 5).collect()} == want


def test_affected_units_falls_back(spark):
    e = edges(spark, [("CALLS", "b", "a"), ("CALLS", "c", "b"), ("THROWS", "z", "a"), ("CALLS", "q", "p")])
    n = spark.createDataFrame([("a", "LogicUnit", "src/main/java/A.java", 1), ("b", "LogicUnit", "src/main/java/B.java", None), ("c", "LogicUnit", "src\\main\\java\\C.java", 2), ("q", "LogicUnit", "src/main/java/Q.java", None), ("z", "LogicUnit", "src/main/java/Z.java", 3)], "id string, label string, file_path string, community_id long")
    got = {(r.seed, r.affected, r.hop, r.community_id) for r in graph.affected_units(e, n, ids(spark, "a", "p")).collect()}
    assert got == {("a", "c", 2, 2), ("p", "q", 1, None)}


def test_paths(spark):
    e = edges(spark, [("CALLS", "a", "b"), ("CALLS", "c", "b"), ("QUERIES_TABLE", "c", "t"), ("CALLS", "a", "x"), ("CALLS", "x", "y"), ("READS_CONFIG", "b", "k"), ("QUERIES_TABLE", "b", "u")])
    pairs = spark.createDataFrame([("a", "t"), ("a", "a"), ("a", "none"), ("y", "t")], "entry string, sink string")
    got = {(r.entry, r.sink): r for r in graph.enriched(graph.shortest_paths(e, pairs), e).collect()}
    assert set(got) == {("a", "t"), ("y", "t")}
    assert got["a", "t"].path == ["a", "b", "c", "t"] and got["a", "t"].path_length == 4
    assert got["a", "t"].tables == ["t", "u"] and got["a", "t"].config_keys == ["k"]
    assert graph.shortest_paths(e, pairs, 3).count() == 0
    nodes = spark.createDataFrame([("a", "f.a", None), ("b", "f.b", None), ("c", "f.c", None), ("t", None, "T")], "id string, fqn string, name string")
    shown = {r.sink: r.names for r in graph.described(graph.shortest_paths(e, pairs.limit(1)), nodes).collect()}
    assert shown == {"t": ["f.a", "f.b", "f.c", "T"]}
    sinks = spark.createDataFrame([("t", "1"), ("u", "2"), ("a", "0")], "id string, fqn string")
    assert [(r.sink, r.path_length) for r in graph.flows_of(e, "a", sinks).collect()] == [("u", 3), ("t", 4)]
    assert [(r.entry, r.sink) for r in graph.flows(e, sinks.where("id = 'a'"), sinks).collect()] == [("a", "u"), ("a", "t")]


def test_evidence(spark):
    e = edges(spark, [("CALLS", "m", "n"), ("HAS_METHOD", "C", "m"), ("HAS_METHOD", "C", "s"), ("HAS_METHOD", "D", "n"), ("INSTANTIATES", "i", "D"), ("HAS_METHOD", "D", "o")])
    n = spark.createDataFrame([(x, "Component" if x.isupper() else "LogicUnit", f"f.{x}", "p/src/main/java/X.java", 1, 2) for x in "mnsoiCD"], "id string, label string, fqn string, file_path string, start_line int, end_line int")
    assert {(r.role, r.fqn) for r in graph.evidence(e, n, ids(spark, "m")).collect()} == {("callee", "f.n")}
    assert {(r.role, r.fqn) for r in graph.evidence(e, n, ids(spark, "n")).collect()} == {("sibling", "f.o"), ("invoker", "f.i")}


def test_leiden_two_cliques(spark):
    rows = [(a, b) for k in ("p", "q") for a, b in combinations([f"{k}{i}" for i in range(5)], 2)] + [("p0", "q0")]
    nodes = spark.createDataFrame([(f"{k}{i}", "LogicUnit") for k in "pq" for i in range(5)] + [("u", "DatabaseTable")], "id string, label string")
    e = edges(spark, [("CALLS", a, b) for a, b in rows] + [("THROWS", "p1", "q1"), ("CALLS", "p1", "u")])
    links_ = communities.projection(e, nodes)
    assert links_.count() == len(rows)
    found, score, ran = communities.leiden(links_, 1.0)
    by = {}
    for r in found.collect():
        by.setdefault(r.community_id, set()).add(r.id[0])
    assert by == {0: {"p"}, 1: {"q"}} and ran >= 1
    m = len(rows)
    assert score == pytest.approx(sum(10 / m - (21 / (2 * m)) ** 2 for _ in "pq"))
    none, score, ran = communities.leiden(links_.where("w > 9"), 1.0)
    assert none.count() == 0 and (score, ran) == (0.0, 0)


def test_leiden_is_connected_and_better_than_single_nodes(spark):
    rng = random.Random(1)
    rows = {tuple(sorted(rng.sample(range(40), 2))) for _ in range(90)}
    nodes = spark.createDataFrame([(f"n{i}", "LogicUnit") for i in range(40)], "id string, label string")
    links_ = communities.projection(edges(spark, [("CALLS", f"n{a}", f"n{b}") for a, b in rows]), nodes)
    found, score, _ = communities.leiden(links_, 1.0, 5)
    of = {r.id: r.community_id for r in found.collect()}
    assert sorted(set(of.values())) == list(range(len(set(of.values()))))
    parts = communities.connected_components(links_.join(found.select(F.col("id").alias("a"), F.col("community_id").alias("x")), "a").join(found.select(F.col("id").alias("b"), F.col("community_id").alias("y")), "b").where("x = y"))
    assert parts.select("component").distinct().count() <= len(set(of.values()))
    degree = {n: sum(n in (f"n{a}", f"n{b}") for a, b in rows) for n in of}
    m = len(rows)
    exact = sum(sum(of[f"n{a}"] == c == of[f"n{b}"] for a, b in rows) / m - (sum(d for n, d in degree.items() if of[n] == c) / (2 * m)) ** 2 for c in set(of.values()))
    assert score == pytest.approx(exact) and score > 0.2


def test_tags(spark):
    n = spark.createDataFrame(
        [("a", "Component", "x.AServlet", None, None), ("b", "Component", "x.B", None, None), ("p", "Component", "x.HttpServlet", None, None), ("c", "Component", "x.C", None, None), ("d", "Component", "x.UserDAO", None, None),
         ("m", "LogicUnit", "x.B.m", ['@GetMapping("/")'], None), ("k", "LogicUnit", "x.B.k", [], "st.executeUpdate(q)"), ("l", "LogicUnit", "x.UserDAO.l", None, "return 1"), ("z", "LogicUnit", "x.C.z", ["@Path"], None)],
        "id string, label string, fqn string, annotations array<string>, body_text string",
    )
    e = edges(spark, [("EXTENDS", "b", "p"), ("HAS_METHOD", "b", "m"), ("HAS_METHOD", "b", "k"), ("HAS_METHOD", "d", "l"), ("HAS_METHOD", "c", "z"), ("ANNOTATED_WITH", "c", "Repository"), ("QUERIES_TABLE", "b", "T")])
    assert {tuple(r) for r in tags.entry_points(n, e).collect()} == {("a", "name"), ("b", "parent"), ("p", "name"), ("m", "method")}
    sinks = tags.data_sinks(n, e)
    assert {tuple(r) for r in sinks.collect()} == {("c", "annotation"), ("d", "name"), ("b", "table"), ("l", "method"), ("z", "method"), ("m", "method"), ("k", "method")}
    assert {tuple(r) for r in tags.counts(sinks).collect()} == {("annotation", 1), ("name", 1), ("table", 1), ("method", 4)}


def test_bridge(spark):
    n = spark.createDataFrame([("LogicUnit", "A.in", "r/src/main/java/A.java", 10, 20), ("LogicUnit", "A.out", "r/src/main/java/A.java", 1, 50), ("Component", "A", "r/src/main/java/A.java", 1, 60), ("Component", "B", "r/src/main/java/B.java", 1, 9), ("LogicUnit", "AdminA.x", "r/src/main/java/AdminA.java", 1, 99)], "label string, fqn string, file_path string, start_line int, end_line int")
    h = spark.createDataFrame([(1, "A.java", 15), (2, "q/A.java", 55), (3, "B.java", 3), (4, "None.java", 1)], "hit_id int, file_path string, line int")
    assert {tuple(r) for r in links.bridged(h, n).collect()} == {(1, "span", "A.in", 1), (1, "span", "A.out", 2), (2, "file", "A.in", 1), (2, "file", "A.out", 2), (3, "type", "B", 1)}
    assert {tuple(r) for r in links.bridge_seeds(h, n).collect()} == {("A.in", 1, "span"), ("A.out", 1, "span"), ("B", 3, "type")}


def test_budgets(spark):
    rng = random.Random(2)
    rows = [(f"g{rng.randrange(4)}", i, rng.choice([0, 1, 5, 30])) for i in range(200)]
    df = spark.createDataFrame(rows, "g string, i long, t long").repartition(7)
    for most, first in ((40, False), (0, False), (29, True)):
        want = set()
        for g in {r[0] for r in rows}:
            total = 0
            for k, (_, i, t) in enumerate(sorted(r for r in rows if r[0] == g)):
                total += t
                if total <= most or first and not k:
                    want.add((g, i, total))
        assert {(r.g, r.i, r.cum_tokens) for r in text.budget(df, "g", ["i"], F.col("t"), most, first).collect()} == want
    lines = spark.createDataFrame([("a", i, f"x{i}") for i in range(5)], "g string, i int, line string")
    fit = lambda most, keep=0: text.fitting(lines, "g", "i", "line", F.lit(2), most, keep).first()
    assert tuple(fit(10)) == ("a", "x0\nx1\nx2\nx3\nx4", False) and tuple(fit(5)) == ("a", "x0\nx1", True) and tuple(fit(1)) == ("a", "", True) and tuple(fit(1, 1)) == ("a", "x0", True)


def test_deletes(spark):
    n = spark.createDataFrame([("a", "LogicUnit", "f"), ("b", "LogicUnit", "g"), ("t", "DatabaseTable", None)], "id string, label string, file_path string")
    e = edges(spark, [("CALLS", "a", "b"), ("CALLS", "b", "a"), ("HAS_METHOD", "c", "b"), ("CALLS", "b", "b")])
    left, rest, gone = text.delete_nodes(n, e, spark.createDataFrame([("f",)], "file_path string"))
    assert gone == 1 and {r.id for r in left.collect()} == {"b", "t"} and {(r.src, r.dst) for r in rest.collect()} == {("c", "b"), ("b", "b")}
    rest, gone = text.delete_calls(e, ids(spark, "b"))
    assert gone == 2 and {tuple(r) for r in rest.collect()} == {("CALLS", "a", "b"), ("HAS_METHOD", "c", "b")}
    assert [r.id for r in text.orphans(n, e).collect()] == ["a"]
    assert [text.candidates(x) for x in (0, 10, 60, 100, 1000)] == [0, 10, 20, 25, 50]




def test_half_sweep_tells_the_score_before(spark):
    """The score read off a half sweep is that of the communities it began with, with links within nodes too; one half stays."""
    r = random.Random(7)
    rows = {(a, b): float(r.randint(1, 5)) for a, b in (sorted((r.choice("abcdefghij"), r.choice("abcdefghij"))) for _ in range(40))}
    graph_ = spark.createDataFrame([(a, b, w) for (a, b), w in rows.items()], "a string, b string, w double")
    k = {x: sum(w * ((a == x) + (b == x)) for (a, b), w in rows.items()) for x in "abcdefghij"}
    both = spark.createDataFrame([(a, b, w, k[a]) for (a, b), w in rows.items()] + [(b, a, w, k[b]) for (a, b), w in rows.items() if a != b], "a string, b string, w double, k double")
    m, loops = sum(rows.values()), sum(w for (a, b), w in rows.items() if a == b)
    members = spark.createDataFrame([(x, "abc"[i % 3], d) for i, (x, d) in enumerate(k.items()) if d], "id string, community string, k double")
    moved, score = communities._half_sweep(both, members, 1.5, m, loops, 0, 3)
    assert loops and abs(score - communities._score(graph_, members, 1.5, m)) < 1e-12
    before, after = ({r.id: r.community for r in df.collect()} for df in (members, moved))
    assert before.keys() == after.keys() and before != after
    still = {r.id for r in members.where("pmod(xxhash64(id, 3), 2) = 1").collect()}
    assert all(before[x] == after[x] for x in still)
