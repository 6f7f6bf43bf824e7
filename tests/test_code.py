"""Parsing, scanning and linking of the sample repositories, against what they hold."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

import codegraph
from codegraph.operators import build, docs, java, web
from codegraph.operators.extract import toml_keys
from codegraph.operators.java import Source
from codegraph.sources import files
from codegraph.storage import materialise

SAMPLES = str(Path(codegraph.__file__).parent / "samples")

JAVA = """package a.b; import x.y.Base; import java.util.*;
/** Old. */
@RestController("x") public class A<T extends Foo<T>> extends Base<T> implements I1, z.I2<String> {
  private int a = 1, b[] = {1,2};
  @Autowired private Map<String, List<Foo>> m = new HashMap<>();
  static { int k = 0; foo(); }
  /** Doc. */ @Override public <X> List<X> run(final String s, int... v) throws java.io.IOException, E2 { if (v.length > 0) { return Base.go(s).stream().map(x -> new Foo<Bar>(x).baz()).collect(q()); } this.x(1); String t = "new Q( { /* ' "; return null; }
  abstract int none();
  enum Color { RED { void f() { g(); } }, BLUE(1); int h() { return 1; } }
  interface Inner extends J<K>, L { default void d() { super.toString(); } }
  @interface Ann { String value() default "x"; }
  A(int x) { super(x); int[] y = new int[3]; }
}
record P(int x, String y) implements Q { P { check(x); } int z() { return x; } }
"""


@pytest.fixture(scope="module")
def parsed():
    return {t["fqn"]: t for t in Source(JAVA).types()}


def test_types(parsed):
    assert {k: v["kind"] for k, v in parsed.items()} == {"a.b.A": "class", "a.b.A.Color": "enum", "a.b.A.Inner": "interface", "a.b.A.Ann": "annotation", "a.b.P": "class"}
    a = parsed["a.b.A"]
    assert (a["extends"], a["implements"], a["annotations"], a["docstring"]) == ("x.y.Base", ["I1", "z.I2"], ['@RestController("x")'], "/** Old. */")
    assert (a["start_line"], a["end_line"]) == (3, 13)
    assert parsed["a.b.A.Inner"]["implements"] == ["J", "L"] and parsed["a.b.A.Inner"]["extends"] is None


def test_fields(parsed):
    assert [(f["name"], f["type_name"], f["is_injected"]) for f in parsed["a.b.A"]["fields"]] == [("a", "int", False), ("b", "int", False), ("m", "Map<String, List<Foo>>", True)]


def test_units(parsed):
    units = {u["fqn"]: u for u in parsed["a.b.A"]["logic_units"]}
    assert set(units) == {"a.b.A.run(String,int[])", "a.b.A.none", "a.b.A.A(int)"}
    run = units["a.b.A.run(String,int[])"]
    assert (run["return_type"], run["throws"], run["overrides"], run["docstring"], run["annotations"]) == ("List<X>", ["java.io.IOException", "E2"], "x.y.Base.run", "/** Doc. */", ["@Override"])
    assert run["calls"] == ["x.y.Base.go", "Base.go(s).stream", "Base.go(s).stream().map", "new Foo<Bar>(x).baz", "Base.go(s).stream().map(x->newFoo<Bar>(x).baz()).collect", "q", "this.x"]
    assert run["instantiates"] == ["Foo"] and units["a.b.A.A(int)"]["instantiates"] == [] and units["a.b.A.A(int)"]["kind"] == "constructor"
    assert [u["fqn"] for u in parsed["a.b.A.Color"]["logic_units"]] == ["a.b.A.Color.h"]
    assert [u["fqn"] for u in parsed["a.b.P"]["logic_units"]] == ["a.b.P.P", "a.b.P.z"]


@pytest.mark.parametrize("text", ["", "class", "class A {", "class A { int f( }", "}}}", "package", "/** open", 'class A { String s = "open; }', "class A { void m() { new } }", "enum E { A, B", "@", "class A { @", "class A { int x = ; , }"])
def test_broken_sources_end(text):
    list(Source(text).types())


def test_docs(spark):
    text = "/**\n * Reads {@code x} by {@link B#y}.\n * More.\n * @param id key of it\n * @param n\n * @return the row\n * @throws E if none\n * @exception F\n * @see B\n * @deprecated use z\n */"
    d = spark.createDataFrame([(1, text), (2, "/** Plain. */"), (3, None), (4, "/***/")], "i int, t string").select("i", docs.parse(F.col("t")).alias("d")).withColumn("s", docs.as_text(F.col("d"))).collect()
    one = d[0].d
    assert (one.description, [tuple(p) for p in one.params], one.returns, one.throws, one.see, one.deprecated, one.links) == ("Reads {@code x} by {@link B#y}.\nMore.", [("id", "key of it"), ("n", "")], "the row", ["E: if none", "F"], ["B"], "use z", ["x", "B#y"])
    assert d[0].s == "Reads {@code x} by {@link B#y}.\nMore.\nParameters: id — key of it; n\nReturns: the row\nThrows: E: if none; F\nDeprecated: use z"
    assert d[1].s == "Plain." and d[1].d.deprecated is None and d[3].s in ("", "*")


def test_chunks(spark):
    types = java.parse(spark.createDataFrame([("A.java", "r", "class A { /** Doc. */ int f(int a) { return a; } int g() { return 1; } }")], "file_path string, repo string, text string"))
    got = {(r.chunk_type, r.fqn): r for r in docs.chunks(java.units(types)).collect()}
    assert set(got) == {("code_logic", "A.f(int)"), ("code_intent", "A.f(int)"), ("code_logic", "A.g")}
    assert all(r.chunk_id == f"{r.geid}_{r.chunk_type}" and len(r.geid) == 16 for r in got.values())
    assert got["code_logic", "A.g"].text == "int g()\nint g() { return 1; }" and got["code_intent", "A.f(int)"].text == "Doc."


def linked(table):
    source = table.where("file_path like '%.java'")
    types = materialise(java.parse(source), "types")
    return source, types, materialise(java.units(types), "units")


def modules(table):
    d = F.transform("dependencies", lambda x: F.concat_ws(":", x["group_id"], x["artifact_id"], x["version"], x["scope"]))
    return files.modules(table).select("repo", "group_id", "artifact_id", "version", F.array_join(d, ",").alias("dependencies"))


def endpoints(table):
    return web.endpoints(*linked(table)).select("path", "verb", "handler_fqn")


def remote_calls(table):
    source, types, units = linked(table)
    return web.remote_calls(units, web.endpoints(source, types, units)).select("caller_fqn", "callee_fqn", "verb", "path")


def named_edges(table):
    source, types, units = linked(table)
    m, tables, keys = files.modules(table), files.sql_tables(table), files.config_keys(table)
    n = build.nodes(types, units, m, tables, keys).select("id", F.coalesce("fqn", "name").alias("n"))
    found = build.edges(types, units, m, tables, keys, web.table_uses(source, types, tables), web.config_uses(source, types, keys), web.remote_calls(units, web.endpoints(source, types, units)))
    return found.join(n.toDF("src", "a"), "src").join(n.toDF("dst", "b"), "dst").select("edge_type", F.col("a").alias("src"), F.col("b").alias("dst")).distinct()


def rows(spark, f):
    return {tuple(r) for r in f(files.files(spark, SAMPLES)).collect()}


def test_toml_lines_are_trimmed(spark):
    text = "early = 1\r\n  [a]\r\n  x = 1\n\ty.z=2\n# no = 1\n [ b.c]\n q = 1"
    table = spark.createDataFrame([("f", text), ("g", ""), ("h", None)], "file string, text string")
    assert {tuple(r) for r in toml_keys(table).collect()} == {("f", "[a]"), ("f", "a.x"), ("f", "a.y.z"), ("f", "[ b.c]"), ("f", " b.c.q")}


def test_deepest_module_declares(spark):
    """Folders are compared whole: k1 doesn't hold k10's types, and a type outside every module has none."""
    pom = "<project><groupId>g</groupId><artifactId>{}</artifactId></project>"
    rows_ = [("r", "r/k1/pom.xml", pom.format("k1")), ("r", "r/k1/in/pom.xml", pom.format("in")), ("r", "r/k1/A.java", "class A {}"), ("r", "r/k1/in/x/B.java", "class B {}"), ("r", "r/k10/C.java", "class C {}"), ("o", "o/D.java", "class D {}")]
    got = {e for e in {tuple(r) for r in named_edges(spark.createDataFrame(rows_, "repo string, file_path string, text string")).collect()} if e[0] == "DECLARES"}
    assert got == {("DECLARES", "g:k1", "A"), ("DECLARES", "g:in", "B")}


def test_sql_tables(spark):
    assert rows(spark, files.sql_tables) == {("billing", "INVOICES", "billing/sql/schema.sql"), ("shop", "SHOP_ORDERS", "shop/dbscripts/h2.sql"), ("shop", "SHOP_ITEMS", "shop/dbscripts/h2.sql"), ("shop", "SHOP_LATE", "shop/src/main/resources/late.sql")}


def test_config_keys(spark):
    got = {(r[0], r[1], r[2]) for r in rows(spark, files.config_keys)}
    assert got == {("shop", "[server]", "toml"), ("shop", "server.port", "toml"), ("shop", "[db.main]", "toml"), ("shop", "db.main.url", "toml"), ("shop", "shop.limit", "xml"), ("shop", "xml:beans.cacheSize", "xml"), ("billing", "billing", "yaml"), ("billing", "server.port", "yaml")}


def test_pom_modules(spark):
    assert rows(spark, modules) == {("shop", "com.acme", "shop", "2.0", "org.lib:managed:1.1:test,com.acme:billing:1.0:compile"), ("billing", "com.acme", "billing", "UNKNOWN", "")}


def test_endpoints(spark):
    assert rows(spark, endpoints) == {("/api/orders/{id}", "GET", "com.acme.shop.OrderController.find"), ("/api/orders", "POST", "com.acme.shop.OrderController.create"), ("/invoices", "GET", "com.acme.billing.InvoiceResource.handler"), ("/invoices/{id}", "GET", "com.acme.billing.InvoiceResource.read")}
    assert rows(spark, remote_calls) == {("com.acme.billing.BillingClient.order(String)", "com.acme.shop.OrderController.find", "GET", "/api/orders")}


def test_endpoint_matching(spark):
    registry = spark.createDataFrame([(1, "/api/users/{id}"), (2, "/api/users"), (3, "/{any}/{id}"), (4, "/a.b/{x}/c")], "ord int, path string")
    paths = ["/api/users/7", "/api/users", "/api/orders", "/x/1", "/api/users/7/8", "/a.b/1/c", "/aXb/1/c", "/"]
    got = {r.path: r.template for r in web.match_endpoints(spark.createDataFrame([(p,) for p in paths], "path string"), registry).collect()}
    assert got == {"/api/users/7": "/api/users/{id}", "/api/users": "/api/users/{id}", "/api/orders": "/{any}/{id}", "/x/1": "/{any}/{id}", "/a.b/1/c": "/a.b/{x}/c"}


def test_edges(spark):
    got = rows(spark, named_edges)
    c, b = "com.acme.shop.", "com.acme.billing."
    some = {
        ("CONTAINS", "shop", "com.acme:shop"), ("DECLARES", "com.acme:billing", b + "BillingClient"), ("DEPENDS_ON", "com.acme:shop", "com.acme:billing"), ("HAS_METHOD", c + "Auditable", c + "Auditable.audit"),
        ("IMPLEMENTS", c + "OrderController", c + "Auditable"), ("EXTENDS", c + "OrderController", c + "BaseController"), ("CALLS", c + "OrderController.audit", b + "BillingClient.ping"), ("CALLS", c + "OrderRepository.byId(Long)", c + "OrderRepository.run(String)"),
        ("RETURNS", c + "OrderController.find(Long)", c + "Order"), ("RECEIVES", c + "Invoice.Invoice(Order)", c + "Order"), ("INJECTS", c + "OrderController", c + "OrderRepository"), ("INSTANTIATES", c + "OrderController.check(Order)", c + "MissingException"),
        ("ANNOTATED_WITH", c + "OrderRepository", "Repository"), ("THROWS", c + "OrderController.find(Long)", "MissingException"), ("HANDLES_EVENT", b + "InvoiceResource", "AbstractEventHandler"),
        ("QUERIES_TABLE", c + "OrderRepository", "SHOP_ORDERS"), ("READS_CONFIG", b + "BillingClient", "server.port"), ("REMOTE_CALLS", b + "BillingClient.order(String)", c + "OrderController.find(Long)"),
    }
    assert some <= got
    assert not any(e[0] == "ANNOTATED_WITH" and e[2] == "Override" for e in got) and {e[0] for e in got} == {e[0] for e in some}
    assert {e for e in got if e[0] in ("CALLS", "QUERIES_TABLE", "READS_CONFIG")} == {e for e in some if e[0] in ("CALLS", "QUERIES_TABLE", "READS_CONFIG")} | {("CALLS", c + "OrderController.create(Order,int[])", c + "OrderController.check(Order)")}


def test_config_fallback(spark):
    table = spark.createDataFrame([("A.java", "r", "class A { void f() { IdentityConfigParser.get(); use(\"timeout\"); } }"), ("B.java", "r", "class B { }")], "file_path string, repo string, text string")
    keys = spark.createDataFrame([("session.Timeout",), ("session.abc",), ("x.y",)], "key string")
    assert [r.config_key for r in web.config_uses(table, java.parse(table), keys).collect()] == ["session.Timeout"]


def test_stack_trace(spark):
    text = "Exception in thread \"main\" com.acme.LostException: no\n\tat com.acme.A.run(A.java:12)\n\tat org.other.B.go(B.java:3)\n\tat com.acme.C$D.<init>(C.java:7)"
    got = web.stack_trace(spark.createDataFrame([("t", text), ("empty", "")], "trace string, text string"), ["acme"]).collect()
    assert [tuple(r) for r in got] == [("t", "com.acme.LostException", 1, "com.acme.A", "run", "A.java", 12), ("t", "com.acme.LostException", 2, "com.acme.C$D", "<init>", "C.java", 7)]


def test_ranges_and_paths(spark):
    lines = spark.createDataFrame([("a", i, f"l{i}") for i in range(1, 6)], "file_path string, line_number long, line string")
    ranges = spark.createDataFrame([(1, "a", 2, 3), (2, "a", 5, 9)], "range_id int, file_path string, start_line int, end_line int")
    got = {r.range_id: r.code for r in files.read_range(lines, ranges, 1).collect()}
    assert got == {1: "   1 │ l1\n   2 │ l2\n   3 │ l3\n   4 │ l4", 2: "   4 │ l4\n   5 │ l5"}
    p = spark.createDataFrame([("/x/mirror/r/src/main/java/A.java",), ("r\\src\\main\\java\\ATest.java",), ("r/src/test/B.java",), ("doc.md",)], "p string")
    got = p.select(files.place(F.col("p")).alias("a"), files.trimmed(F.col("p")).alias("b"), files.language(F.col("p")).alias("c")).collect()
    assert [r.a for r in got] == ["production", "test", "test", "other"] and got[0].b == "mirror/r/src/main/java/A.java" and [r.c for r in got] == ["java", "java", "java", "markdown"]


def test_manifest(tmp_path):
    (tmp_path / "shop").mkdir()
    (tmp_path / "repos.yaml").write_text("repositories:\n  - name: shop\n    url: u\n")
    found = files.manifest(str(tmp_path / "repos.yaml"))
    assert found == [{"branch": "main", "name": "shop", "url": "u"}] and files.mirrored(found, str(tmp_path)) == [f"{tmp_path}/shop"]
    (tmp_path / "none.yaml").write_text("other: 1\n")
    assert files.manifest(str(tmp_path / "none.yaml")) == []
    with pytest.raises(files.MirrorError):
        files.mirrored([{"name": "gone"}], str(tmp_path))

