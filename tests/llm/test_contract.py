"""The registered queries on small tables with nulls, repeated rows, ties and clashing columns, and on empty ones."""

import base64
import hashlib
import random
import zlib

import pytest

import corpus_pipeline
from codegraph.llm.queries import QUERIES

COLUMNS = {
    "op1_decontamination": {"doc_id", "item_id"},
    "op2_language_id": {"doc_id", "held_out", "lang_pred", "score"},
    "op3_media_columns": {"doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"},
    "op4_quality_classifier": {"doc_id", "kept"},
    "op5_near_duplicates": {"doc_id", "n_shingles", "component_id", "kept"},
    "op6_substring_dedup": {"doc_id", "n_words", "n_removed", "kept_sha256"},
    "op7_html_extraction": {"page_id", "url", "text", "n_chars"},
    "op8_warc": {"page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"},
    "op9_suffix_dedup": {"doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"},
    "op10_mix_sources": {"doc_id", "size", "source_size", "target", "taken"},
}
DOCS = "doc_id long, text string, lang string, source string, n_chars int, score double, kept int, copies string, key string, spans int, gone int, lang_pred string"


def rows():
    rng = random.Random(4)
    make = lambda n: " ".join(f"w{rng.randrange(3000)}" for _ in range(n))
    base = make(300)
    passage = make(80)
    texts = [base, base, base.replace(base.split()[5], "edited"), f"{make(90)} {passage} {make(50)}", f"{make(70)} {passage}", None, "", " \n", "one two", "ü" * 900, make(30000), "item " + " ".join(f"b{i}" for i in range(30)), make(60)]
    out = [(i, t, ["en", "de", None][i % 3], [f"s{i % 3}", None][i % 7 == 6], None if t is None else len(t), 0.5, 1, "c", "k", 2, 3, "xx") for i, t in enumerate(texts)]
    return [*out, out[0], (None, base, "en", "s0", len(base), 0.1, 1, "c", "k", 2, 3, "xx"), (None, passage, None, None, 1, 0.1, 1, "c", "k", 2, 3, "xx")]


PAGES = [(1, "http://h/1", "<article><p>text</p><p class='related'>kept words</p><math>1</math></article>", "x"), (2, None, None, "x"), (3, "u", "", "x"), (3, "u", "", "x"), (None, "u", "<p>a</p>", "x"), (5, "http://h/1", "<article><p>text</p><iframe><p>open</p></article>", "y")]


@pytest.fixture(scope="module")
def place(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("contract"))
    spark.createDataFrame(rows(), DOCS).write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame(PAGES, "page_id long, url string, html string, text string").write.parquet(f"{root}/pages.parquet")
    spark.createDataFrame([(1, " ".join(f"b{i}" for i in range(30))), (2, None), (3, ""), (None, "w1 w2")], "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(13)] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    empty = root + "/empty"
    for n in ("documents", "pages", "benchmark", "labels"):
        spark.read.parquet(f"{root}/{n}.parquet").limit(0).write.parquet(f"{empty}/{n}.parquet")
    return root


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns_and_empty_tables(spark, place, name):
    got = QUERIES[name](spark, place)
    assert COLUMNS[name] <= set(got.columns) and len(set(c.lower() for c in got.columns)) == len(got.columns)
    n = got.count()
    assert n == (len(PAGES) if name[2] in "78" else n if name.startswith("op1_") else len(rows()))
    assert QUERIES[name](spark, place + "/empty").count() == 0


def by(spark, place, name):
    out = {}
    for r in QUERIES[name](spark, place).collect():
        out.setdefault(r.doc_id, []).append(r)
    return out


def test_decontamination(spark, place):
    assert {(r.doc_id, r.item_id) for r in QUERIES["op1_decontamination"](spark, place).collect()} == {(11, 1)}


def test_language(spark, place):
    got = by(spark, place, "op2_language_id")
    for i, found in got.items():
        assert all(r.held_out == (i is not None and zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in found)
    assert all(r.lang_pred == "und" and r.score == 0 for i in (5, 6, 7) for r in got[i])


def test_media(spark, place):
    got = by(spark, place, "op3_media_columns")
    for i, t, *_ in rows():
        raw = (t or "").encode()
        whole = raw + b"\0" * (-len(raw) % 64 or (0 if raw else 64))
        for r in got[i] if i is not None else []:
            assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(whole), hashlib.sha256(whole).hexdigest(), zlib.crc32(whole[-64:]))
    assert got[0][0].media_sha256 == got[1][0].media_sha256 and got[0][0].feature == got[1][0].feature


def test_near_duplicates(spark, place):
    got = by(spark, place, "op5_near_duplicates")
    assert {got[i][0].component_id for i in (0, 1, 2)} == {0} and [got[i][0].kept for i in (0, 1, 2, 3)] == [True, False, False, True]
    assert all(r.kept and r.component_id is None for r in got[None]) and got[5][0].n_shingles == got[7][0].n_shingles == 0 and got[8][0].n_shingles == 1


def test_substrings(spark, place):
    got = by(spark, place, "op6_substring_dedup")
    assert got[0][0].n_removed == 0 and got[1][0].n_removed == 300 and got[4][0].n_removed == 80 and got[3][0].n_removed == 0
    nine = by(spark, place, "op9_suffix_dedup")
    assert nine[0][0].n_removed == nine[0][0].n_bytes and nine[10][0].n_removed == 0
    assert nine[9][0].n_removed == 1800 and nine[9][0].n_spans == 1 and nine[5][0].kept_sha256 == hashlib.sha256(b"").hexdigest()


def test_pages(spark, place):
    got = {r.page_id: r for r in QUERIES["op7_html_extraction"](spark, place).collect()}
    assert got[1].text == "text\n\nkept words\n\n1" and got[5].text == "text\n\nopen" and got[2].text == "" and got[None].text == "a"
    got = sorted(QUERIES["op8_warc"](spark, place).collect(), key=str)
    for r in got:
        if r.page_id == 1:
            assert r.payload_digest == base64.b32encode(hashlib.sha1(PAGES[0][2].encode()).digest()).decode() and r.record_type == "response"
    assert {(r.page_id, r.record_type, r.refers_to) for r in got if r.page_id in (2, 3)} == {(2, "revisit", 3), (3, "response", None)}


def test_mixing(spark, place):
    got = [r for rs in by(spark, place, "op10_mix_sources").values() for r in rs]
    sizes = sorted(len((t or "").split()) for _, t, *_ in rows())
    assert sorted(r.size for r in got) == sizes and all(0 <= r.taken <= 2 * r.size for r in got)
    assert sorted((str(r.doc_id), r.taken) for r in got) == sorted((str(r.doc_id), r.taken) for rs in by(spark, place, "op10_mix_sources").values() for r in rs)


@pytest.mark.parametrize("k", range(5))
def test_stages(spark, place, k):
    """Each stage on rows with nulls, repeats and clashing names; all but the last return the columns and types they get."""
    name, stage = corpus_pipeline.STAGES[k]
    docs = spark.read.parquet(f"{place}/documents.parquet")
    out = stage(spark, docs, place)
    if k < 4:
        assert out.dtypes == docs.dtypes
    else:
        assert set(out.columns) == set(docs.columns) | {"taken"}
    ids = sorted(str(r.doc_id) for r in out.select("doc_id").collect())
    whole = sorted(str(r[0]) for r in rows())
    if name == "quality classifier":
        assert ids == whole
    elif name == "MinHash near-dedup":
        assert ids == sorted(x for x in whole if x not in ("1", "2"))
    elif name == "benchmark decontamination":
        assert ids == sorted(x for x in whole if x != "11")
    elif name == "suffix-array dedup":
        left = {r.doc_id: r for r in out.collect()}
        assert 1 not in left and left[0].text == rows()[0][1] and left[5].text is None and left[6].text == ""
        assert left[4].n_chars == len(left[4].text) < rows()[4][4] and rows()[3][1] == left[3].text
    assert stage(spark, docs.limit(0), place + "/empty").count() == 0


def test_passages_of_fifty_words(spark):
    """Passages of 51 and more words of the shared kind are found, and the first copy stays."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("aeionrst") for _ in range(rng.randrange(3, 9)))
    passage = " ".join(word() for _ in range(51))
    text = lambda: " ".join(word() for _ in range(120))
    docs = spark.createDataFrame([(i, f"{text()} {passage} {text()}" if i < 3 else text()) for i in range(6)], "doc_id long, text string")
    got = {r.doc_id: r.text for r in corpus_pipeline.repeated_passages(spark, docs, "").collect()}
    was = {r.doc_id: r.text for r in docs.collect()}
    assert passage in got[0] and all(passage not in got[i] and len(got[i]) < len(was[i]) for i in (1, 2)) and all(got[i] == was[i] for i in (3, 4, 5))
