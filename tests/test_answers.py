"""Questions, budgets and answers with a model that is written for the test."""

import json

import pytest
from pyspark.sql import functions as F

from codegraph import model
from codegraph.functions import columns as C
from codegraph.model import Extractive, HashEmbedder, reflect
from codegraph.operators import answers, extract, graph, retrieval


@pytest.fixture(scope="module", autouse=True)
def shipped(spark):
    """Executors unpickle the model below by this module's name."""
    spark.sparkContext.addPyFile(__file__)


class Fixed:
    def __init__(self, reply):
        self.reply, self.calls = reply, 0

    def call(self, prompt, max_tokens):
        self.calls += 1
        if self.reply is None:
            raise ValueError("down")
        return self.reply


@pytest.mark.parametrize(
    "question, intent",
    [("Show me getUser", "code"), ("is the old api unused", "safety"), ("Does this enforce mTLS", "capability"), ("what breaks here", "impact"), ("walkthrough of login", "narrative"), ("tell of tokens", "general"), ("give me what breaks", "code"), ("showing", "general")],
)
def test_intent(spark, question, intent):
    assert spark.createDataFrame([(question,)], "q string").select(C.intent(F.col("q")).alias("i")).first().i == intent


@pytest.mark.parametrize(
    "question, way, bucket, confidence",
    [
        ("Describe the architecture", "global", "global", 0.95),
        ("Where is MAX_SIZE and JWT", "symbolic", "symbolic", 0.8),
        ("How is 'token_ttl' read", "symbolic", "symbolic", 0.7),
        ("What is OrderService", "exact", "exact", 0.6),
        ("what does getUser return", "semantic", "exact", 0.6),
        ("see org.acme.core.api.rest.v1x", "exact", "exact", 0.8),
        ("why is login slow", "semantic", "conceptual", 0.3),
    ],
)
def test_routes(spark, question, way, bucket, confidence):
    b, c = C.classify(F.col("q"))
    r = spark.createDataFrame([(question,)], "q string").select(C.dispatch(F.col("q")).alias("way"), b.alias("b"), c.alias("c")).first()
    assert (r.way, r.b, r.c) == (way, bucket, pytest.approx(confidence))


def test_terms_and_constants(spark):
    q = spark.createDataFrame([("How does UserStore support the claim handler in org.acme.core",)], "q string")
    r = q.select(C.entities(F.col("q")).alias("e"), C.search_terms(F.col("q")).alias("t"), C.merged_terms(F.array(F.lit("x"), F.lit("UserStore"), F.lit("ttl")), F.col("q")).alias("m")).first()
    assert r.e == ["org.acme.core", "UserStore"] and r.t == ["org.acme.core", "UserStore", "UserStore", "userstore", "handler"] and r.m == ["UserStore", "ttl", "org.acme.core"]
    c = spark.createDataFrame([("MAX_SIZE NULL ERROR TOKEN_TTL_SECONDS KEY_A KEY_BC X1 AUTHORIZATION",)], "t string")
    assert c.select(C.constants(F.col("t")).alias("c")).first().c == ["TOKEN_TTL_SECONDS", "MAX_SIZE", "KEY_BC"]


def test_reply_scores(spark):
    replies = ['```json\n{"score": 130}\n```', '{"score": 55, "reason": "x"}', "no idea", '{"score": -4}', "", None, 'I say {"score": 70.5} at most', '{"score": "8"}', '{"other": 1}']
    got = spark.createDataFrame([(i, r) for i, r in enumerate(replies)], "i int, r string").select("i", extract.reply_score(F.col("r")).alias("s")).orderBy("i").collect()
    assert [r.s for r in got] == [100, 55, 0, 0, 0, 0, 70, 8, 0]


def test_scoring_and_reduction(spark):
    pairs = spark.createDataFrame([("q", i, f"text {i}") for i in range(3)], "question string, community_id long, text string")
    assert answers.scored(pairs, Fixed('{"score": 0}')).count() == 0 and answers.scored(pairs, Fixed("broken")).count() == 0
    got = answers.scored(pairs, Fixed('{"score": 60, "reason": "r"}')).collect()
    assert [(r.community_id, r.score, r.reason) for r in got] == [(0, 60, "r"), (1, 60, "r"), (2, 60, "r")]
    model = Fixed("said")
    assert answers.reduce("q", "general", None, None, None, model)["answer"] == answers.NO_COMMUNITIES and model.calls == 0
    assert answers.reduce("q", "safety", answers.scored(pairs, Fixed('{"score": 60}')), None, None, model)["answer"] == "said" and model.calls == 1
    assert answers.analyse_change("q", pairs, [0, 1], Fixed("nothing")) == {"answer": answers.NO_COMMUNITIES, "evaluated": 2, "communities_scored": 0}
    assert answers.analyse_change("q", pairs, [0, 1], Fixed('{"score": 60}'))["communities_scored"] == 2


@pytest.mark.parametrize("n", [1, 5, 60, 200])
def test_summaries_stay_in_budget(spark, n):
    rows = spark.createDataFrame([(i, 100 - i % 50, "word " * 80) for i in range(n)], "community_id long, score long, text string")
    r = answers.summaries_text(rows).first()
    assert 1 <= r.kept.count("Community") <= n and (n == 1 or answers.prompt_tokens(r.kept) <= answers.SUMMARIES) and r.truncated == (r.kept.count("Community") < n)
    low = rows.withColumn("score", F.lit(10))
    assert answers.summaries_text(low).first().kept.count("Community") == min(n, 10)


def test_community_prompts(spark):
    nodes = spark.createDataFrame([(1, "LogicUnit", f"f.m{i:04d}", "doc " * 125) for i in range(500)] + [(2, "Component", "f.C", None), (2, "LogicUnit", "f.C.m", "short")], "community_id long, label string, fqn string, docstring string")
    boundary = spark.createDataFrame([(2, "CALLS", 1, 4, 1)], "community_id long, edge_type string, target_community long, cnt long, rn long")
    got = {r.community_id: r for r in answers.community_prompts(nodes, boundary).collect()}
    assert got[1].truncated and answers.prompt_tokens(got[1].prompt) <= 6800 and not got[2].truncated
    lines = got[2].prompt.split("\n")
    assert lines[1:3] == ["- f.C", "- f.C.m: short"] and "to community 1 (4)" in lines[-1]


def test_summaries_and_rollup(spark):
    prompts = spark.createDataFrame([(1, "p", False), (2, "p", False)], "community_id long, prompt string, truncated boolean")
    names = spark.createDataFrame([(1, ["a"])], "community_id long, top_fqns array<string>")
    good, bad = answers.summarise(prompts, names, Fixed("login and password"), "now")
    assert {(r.summary_id, r.text, r.top_fqns) for r in good.collect()} == {("community_1", "login and password", '["a"]'), ("community_2", "login and password", "[]")} and bad.count() == 0
    _, bad = answers.summarise(prompts, names, Fixed(None), "now")
    assert bad.count() == 2
    second, third = answers.rollup(good, Extractive(), "now")
    assert [(r.id, r.community_count, r.community_ids) for r in second.collect()] == [("l2:Authentication", 2, "1,2")] and third.first().id == "l3:global_architecture"
    second, third = answers.rollup(good.limit(0), Extractive(), "now")
    assert second.count() == 0 and third.first().text == answers.NO_SUMMARIES


def test_domains_ties_and_none(spark):
    got = answers.by_domain(spark.createDataFrame([(1, "a session token"), (2, "xyz"), (3, None), (4, "SESSION cookie")], "community_id long, text string")).orderBy("community_id").collect()
    assert [r.domain for r in got] == ["OAuth2 / Token Management", answers.OTHER, answers.OTHER, "Session Management"]


def test_flow_prompt(spark):
    flows = spark.createDataFrame([("a", "t", ["T"], ["k"])], "entry string, sink string, tables array<string>, config_keys array<string>")
    named = spark.createDataFrame([("a", "t", [f"f.n{i}" for i in range(40)])], "entry string, sink string, names array<string>")
    r = answers.flow_prompts(flows, named, 20).first()
    assert r.id == "flow:a→t" and r.truncated and len(r.prompt.split("\n")) == 10
    r = answers.flow_prompts(flows, named).first()
    assert not r.truncated and r.prompt.endswith("Tables: T\nConfiguration: k")


def test_grep_counts(spark):
    hits = spark.createDataFrame([("src/main/java/A.java", "public static final int X = 1;"), ("src/main/java/B.java", "import a.X;"), ("src/test/T.java", "use(X)"), ("src/main/java/C.java", "use(X)"), ("src/test/T.java", "static final int X = 2;")], "file_path string, text string")
    got = {r.category: (r.n, r.files) for r in answers.grep_counts(hits, C.grep_category(F.col("text"), F.col("file_path"))).collect()}
    assert got == {"definition": (1, "src/main/java/A.java"), "import": (1, "src/main/java/B.java"), "test": (2, "src/test/T.java"), "production": (1, "src/main/java/C.java")}


def test_reflection():
    assert reflect("  ", "x", Fixed("more")) == "  "
    m = Fixed("NO_ADDITIONS")
    assert reflect("Doc", "x", m) == "Doc" and m.calls == 1
    m = Fixed("more")
    assert reflect("Doc", "x", m) == "Doc\nmore\nmore" and m.calls == 2


def test_vectors(spark):
    e = HashEmbedder(64)
    rows = spark.createDataFrame([("v1", "order storage", "r1"), ("v2", "login of users", "r2"), ("v3", "order login", "r2")], "vec_id string, text string, repo string")
    v = retrieval.embed(rows, e)
    assert retrieval.semantic(spark, "order storage", v, e, 2).first().vec_id == "v1"
    assert {r.vec_id for r in retrieval.semantic(spark, "order storage", v, e, 5, "repo = 'r2'").collect()} == {"v2", "v3"}
    assert [r.vec_id for r in retrieval.literal_in_intents(spark, "storage", v, e).collect()] == ["v1"]


def test_search_and_constants(spark):
    lines = spark.createDataFrame([("r", f"r/src/main/java/{n}.java", i, t) for n, ts in {"A": ["  KEY_LONG = 1", "x"], "B": ["KEY_LONG", "OTHER_KEY"], "BTest": ["OTHER_KEY"]}.items() for i, t in enumerate(ts, 1)], "repo string, file_path string, line_number long, line string")
    got = [tuple(r) for r in retrieval.search(lines, "KEY_LONG").orderBy("file_path").collect()]
    assert got == [("KEY_LONG", "r/src/main/java/A.java", 1, "KEY_LONG = 1"), ("KEY_LONG", "r/src/main/java/B.java", 1, "KEY_LONG")]
    assert retrieval.search(lines, "KEY", repos=["q"]).count() == 0 and retrieval.search(lines, "KEY", suffix=".xml").count() == 0
    seen = spark.createDataFrame([("r/src/main/java/A.java", "KEY_LONG OTHER_KEY")], "file_path string, code string")
    assert [tuple(r) for r in retrieval.follow_constants(seen, lines).collect()] == [("OTHER_KEY", "r/src/main/java/B.java", 2)]


def test_json_of_extractive():
    assert json.loads(Extractive().call('Question: order storage\nSummary: storage of things\nAnswer {"score": 0-100}', 9)) == {"score": 50, "reason": "storage"}


def test_prompts_by_intent():
    """Each kind of answer has all evidence once, in its own order; what is missing is said."""
    orders = {}
    for kind in answers.TASKS:
        p = answers.prompt_for("why?", kind, "SUM", "CODE", "GRAPH")
        assert p.startswith(answers.TASKS[kind] + "\n\nQuestion: why?") and all(p.count(x) == 1 for x in ("\nSUM", "\nCODE", "\nGRAPH"))
        orders[kind] = tuple(sorted(("SUM", "CODE", "GRAPH"), key=lambda x: p.index("\n" + x)))
    assert orders["code"][0] == "CODE" and orders["impact"][0] == orders["safety"][0] == "GRAPH" and orders["general"] == ("SUM", "CODE", "GRAPH")
    assert answers.prompt_for("q", "code", "", "", "G").count("(none)") == 2
    said = answers.debug_prompt("a.B", "f1\nf2", "", "x.java:3  throw new B()")
    assert "Error:\na.B" in said and "Stack frames:\nf1\nf2" in said and "(not in the store)" in said and said.endswith("throw new B()")


def test_models_by_options(monkeypatch):
    from codegraph.config import Options

    assert isinstance(model.text_model(Options()), model.Extractive) and len(model.embedder(Options(embedding_size=7)).embed(["a b"])[0]) == 7
    monkeypatch.setenv("TEXT_MODEL", "collections:Counter")
    monkeypatch.setenv("EMBEDDING_BATCH_SIZE", "3")
    monkeypatch.setenv("LEIDEN_RELATIONSHIPS", "CALLS, INJECTS,")
    o = Options.load()
    with pytest.raises(TypeError):  # the function named gets the options
        model.text_model(o)
    assert o.embedding_batch_size == 3 and o.relationships() == ("CALLS", "INJECTS")
    with pytest.raises(ValueError):
        model.embedder(Options(embedder="azure"))


def test_order_by_community(spark):
    found = spark.createDataFrame([("s", "b", 2), ("s", "a", 2), ("s", "c", 1), ("r", "a", 2), ("s", "d", None)], "seed string, affected string, community_id long")
    nodes = spark.createDataFrame([("a", "z.A"), ("b", "y.B"), ("c", "x.C"), ("d", "a.D")], "id string, fqn string")
    assert [(r.seed, r.affected) for r in graph.by_community(found, nodes).collect()] == [("r", "a"), ("s", "c"), ("s", "b"), ("s", "a"), ("s", "d")]
