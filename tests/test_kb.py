"""Ingest, incremental update, checks and the command line on the sample repositories."""

import io
import json
import shutil
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import codegraph
from codegraph import cli, kb
from codegraph.model import Extractive
from codegraph.operators import retrieval

SAMPLES = str(Path(codegraph.__file__).parent / "samples")


@pytest.fixture(scope="module")
def place(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("kb")
    shutil.copytree(SAMPLES, root / "mirror")
    stats = kb.ingest(spark, str(root / "mirror"), str(root / "store"), Extractive(), levels=2)
    return root, stats


def edge_set(store):
    return {tuple(r) for r in store.read("edges").select("edge_type", "src", "dst").collect()}


def test_ingest(spark, place):
    root, stats = place
    assert (stats["components"], stats["logic_units"], stats["event_handlers"], stats["summary_failures"]) == (11, 17, 1, 0)
    store = kb.Store(spark, str(root / "store"))
    n = {(r.kind, r.name): r.n for r in kb.stats(store).collect()}
    assert n["nodes", "LogicUnit"] == 17 and n["edges", "HAS_METHOD"] == 17 and n["chunks", "code_logic"] == 17 and n["chunks", "code_intent"] == 3
    assert kb.validate(store).count() == 0
    assert store.has("flows") and store.has("whole") and not store.has("nothing")


@pytest.mark.parametrize(
    "argv, found",
    [
        (["find", "ORDERS_TABLE_NAME"], "production  shop/src/main/java/com/acme/shop/OrderRepository.java  7"),
        (["callers", "OrderRepository.run"], "com.acme.shop.OrderRepository.byId(Long)"),
        (["trace", "OrderController.create"], "com.acme.shop.OrderController.check(Order)"),
        (["query", "Where is ORDERS_TABLE_NAME"], '"route": "symbolic"'),
        (["query", "big picture"], '"route": "global"'),
        (["query", "what is OrderController"], '"route": "exact"'),
        (["query", "how are things kept"], '"route": "semantic"'),
        (["explain", "OrderRepository.byId"], ""),
        (["analyze-pr", "change of order storage"], "communities_scored"),
        (["stats", "--json"], '"LogicUnit"'),
        (["validate"], ""),
    ],
)
def test_commands(spark, place, capsys, argv, found):
    assert cli.main([argv[0], "--store", str(place[0] / "store"), *argv[1:]], spark) == 0
    assert found in capsys.readouterr().out


def test_debug_from_input(spark, place, capsys, monkeypatch):
    monkeypatch.setattr("sys.stdin", io.StringIO("com.acme.shop.MissingException: no\n\tat com.acme.shop.OrderController.check(OrderController.java:37)\n"))
    assert cli.main(["debug", "--store", str(place[0] / "store"), "-"], spark) == 0
    out = capsys.readouterr().out
    assert "com.acme.shop.OrderController.check(Order)" in out and "throw new MissingException" in out


def test_update_is_a_full_ingest(spark, place, tmp_path):
    """Changed, new and removed files: the updated store has the nodes and edges of a new one."""
    shutil.copytree(place[0] / "mirror", tmp_path / "mirror")
    shutil.copytree(place[0] / "store", tmp_path / "store")
    java = tmp_path / "mirror/shop/src/main/java/com/acme/shop"
    text = (java / "OrderRepository.java").read_text()
    (java / "OrderRepository.java").write_text(text.replace("return run(sql);", "return other(sql);").replace("Order run(String sql)", "Order other(String sql)"))
    (java / "Extra.java").write_text("package com.acme.shop; class Extra { void go() { Auditable.audit(); } }")
    (tmp_path / "mirror/billing/src/main/java/com/acme/billing/InvoiceResource.java").unlink()
    stats = kb.update(spark, str(tmp_path / "mirror"), str(tmp_path / "store"), levels=1)
    assert stats["changed_files"] == 3 and stats["affected_communities"]
    kb.ingest(spark, str(tmp_path / "mirror"), str(tmp_path / "new"), levels=1)
    old, new = kb.Store(spark, str(tmp_path / "store")), kb.Store(spark, str(tmp_path / "new"))
    assert edge_set(old) == edge_set(new)
    ids = lambda s: {(r.label, r.id, r.fqn, r.start_line) for r in s.read("nodes").collect()}
    assert ids(old) == ids(new) and not any("InvoiceResource" in (x[2] or "") for x in ids(old))
    again = kb.update(spark, str(tmp_path / "mirror"), str(tmp_path / "store"), levels=1)
    assert again["changed_files"] == 0 and edge_set(old) == edge_set(new)


def test_counters(spark, place):
    """What the writes counted is what the tables hold."""
    root, got = place
    store = kb.Store(spark, str(root / "store"))
    nodes, types = store.read("nodes"), [r.asDict() for r in store.read("types").collect()]
    label = {r.label: r.n for r in nodes.groupBy("label").agg(F.count("*").alias("n")).collect()}
    files = store.read("files")
    want = {
        "repos_mirrored": 2, "files_parsed": files.where("file_path like '%.java'").count(), "components": label["Component"], "logic_units": label["LogicUnit"],
        "call_edges": sum(len(u["calls"]) for t in types for u in t["logic_units"]), "implements_edges": sum(len(t["implements"]) + (t["extends"] is not None) for t in types),
        "depends_on_edges": 2, "remote_calls": 1, "db_tables": 4, "config_entries": 8, "entry_points": nodes.where("is_entry_point").count(), "data_sinks": nodes.where("is_data_sink").count(),
        "flow_paths": got["flow_narratives"], "flow_narratives": store.read("flows").count(), "communities": nodes.where("community_id is not null").select("community_id").distinct().count(),
        "l2_subsystems": store.read("subsystems").count(), "l3_global": True, "embedding_failures": 0, "version": 1,
    }
    assert {k: got[k] for k in want} == want and want["flow_paths"] > 0 and want["entry_points"] > 0


def test_versions(spark, tmp_path):
    """A writer that stops half-way changes nothing; of two from one version the second fails; readers keep what they saw."""
    root = str(tmp_path / "s")
    first = kb.Store(spark, root)
    assert not first.has("a") and first.version == 0
    first.write("a", spark.range(3))
    first.write("b", spark.range(1))
    assert not kb.Store(spark, root).has("a") and first.has("a")
    assert first.commit() == 1
    reader, one, two = (kb.Store(spark, root) for _ in range(3))
    one.write("a", spark.range(5))
    del one  # it never commits
    two.write("a", spark.range(7))
    late = kb.Store(spark, root)
    late.write("b", spark.range(9))
    assert two.commit() == 2
    with pytest.raises(kb.Conflict):
        late.commit()
    assert (reader.read("a").count(), reader.read("b").count()) == (3, 1)
    reader.refresh()
    assert (reader.version, reader.read("a").count(), reader.read("b").count()) == (2, 7, 1)
    late.refresh()
    late.write("b", spark.range(9))
    assert late.commit() == 3 and [x.name for x in sorted((tmp_path / "s/_versions").iterdir()) if not x.name.endswith(".crc")] == [f"{i:012d}" for i in (1, 2, 3)]
    assert late.clean() == 0
    assert late.clean(-1) == 4  # the first a and b, the a never committed, the b in conflict
    last = kb.Store(spark, root)
    assert (last.version, last.read("a").count(), last.read("b").count()) == (3, 7, 9)
    shutil.move(root, tmp_path / "moved")
    assert kb.Store(spark, str(tmp_path / "moved")).read("a").count() == 7


def test_embedding_in_halves(spark):
    class Picky:
        """Fails on batches of more than four texts and on every text that holds 'bad'; gives one vector too few for 'short'."""

        def embed(self, texts):
            if len(texts) > 4 or any("bad" in t for t in texts):
                raise ConnectionError("connection reset")
            return [[float(len(t))] for t in texts if t != "short"]

    texts = [f"t{i}" for i in range(30)] + ["bad", None, "", "short", "also bad"]
    rows = spark.createDataFrame(list(enumerate(texts)), "chunk_id int, text string").coalesce(1)
    got = {r.chunk_id: r for r in retrieval.tried(rows, Picky(), batch=16).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        fails = t is not None and ("bad" in t or t == "short")
        assert (got[i].embedding is None) == fails and (got[i].error is not None) == fails and (fails or got[i].embedding == [float(len(t or ""))])
    assert got[30].error == "ConnectionError: connection reset" and got[33].error.startswith("ValueError")
    assert retrieval.tried(rows.limit(0), Picky()).count() == 0


def test_json_lines(spark, place, capsys):
    cli.main(["stats", "--store", str(place[0] / "store"), "--json"], spark)
    assert all(json.loads(x) for x in capsys.readouterr().out.splitlines())
