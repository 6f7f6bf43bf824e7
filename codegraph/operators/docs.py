"""Doc comments and the chunks of text that are embedded, in column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def clean(comment: Column) -> Column:
    """A doc comment without its marks."""
    return F.btrim(F.regexp_replace(F.regexp_replace(F.regexp_replace(comment, "^\\s*/\\*\\*", ""), "\\*/\\s*$", ""), "(?m)^[ \\t]*\\*[ \\t]?", ""), F.lit(" \t\r\n"))


def parse(comment: Column) -> Column:
    """struct(description, params, returns, throws, see, deprecated, links); inline tags stay in the text they are in."""
    plain = clean(comment)
    pieces = F.split(plain, "(?<![{\\w])@(?=\\w)")
    trim = lambda x: F.btrim(x, F.lit(" \t\r\n"))
    tags = F.transform(F.slice(pieces, 2, 1 << 20), lambda p: F.struct(F.lower(F.regexp_extract(p, "^(\\w+)", 1)).alias("tag"), trim(F.regexp_replace(p, "^\\w+", "")).alias("body")))
    of = lambda *names: F.transform(F.filter(tags, lambda t: t["tag"].isin(*names)), lambda t: t["body"])
    first = lambda x: F.regexp_extract(x, "^(\\S+)", 1)
    rest = lambda x: trim(F.regexp_replace(x, "^\\S+", ""))
    return F.struct(
        trim(F.get(pieces, F.lit(0))).alias("description"),
        F.transform(of("param"), lambda b: F.struct(first(b).alias("name"), rest(b).alias("doc"))).alias("params"),
        F.get(of("return"), F.lit(0)).alias("returns"),
        F.transform(of("throws", "exception"), lambda b: F.when(rest(b) == "", first(b)).otherwise(F.concat(first(b), F.lit(": "), rest(b)))).alias("throws"),
        of("see").alias("see"),
        F.get(of("deprecated"), F.lit(0)).alias("deprecated"),
        F.transform(F.regexp_extract_all(plain, F.lit("\\{@(?:link|code)\\s+([^}]*)\\}"), 1), trim).alias("links"),
    )


def as_text(doc: Column) -> Column:
    """The lines of a parsed comment for embedding; what is empty is left out."""
    full = lambda x: F.when(F.length(x) > 0, x)
    listed = lambda head, x: F.when(F.size(x) > 0, F.concat(F.lit(head), F.array_join(x, "; ")))
    params = F.transform(doc["params"], lambda p: F.when(p["doc"] == "", p["name"]).otherwise(F.concat(p["name"], F.lit(" — "), p["doc"])))
    said = lambda head, x: F.concat(F.lit(head), full(x))
    return F.concat_ws("\n", full(doc["description"]), listed("Parameters: ", params), said("Returns: ", doc["returns"]), listed("Throws: ", doc["throws"]), said("Deprecated: ", doc["deprecated"]))


def logic_text(unit: DataFrame) -> Column:
    """Signature and body: return type or void, last dot segment of the fqn, parameters."""
    shown = F.array_join(F.transform("parameters", lambda p: F.concat_ws(" ", p["type_name"], p["name"])), ", ")
    name = F.concat(F.element_at(F.split("fqn", "\\."), -1), F.lit("("), shown, F.lit(")"))
    return F.concat_ws("\n", F.concat_ws(" ", F.coalesce("return_type", F.lit("void")), name), "body_text")


def chunks(units: DataFrame) -> DataFrame:
    """(chunk_id, geid, chunk_type, fqn, repo, text): a logic chunk of each unit with text, an intent chunk of each with a doc comment."""
    blank = F.btrim(F.col("c.text"), F.lit(" \t\r\n"))
    made = F.array(F.struct(F.lit("code_logic").alias("chunk_type"), F.when(F.length(F.btrim("body_text")) > 0, logic_text(units)).alias("text")), F.struct(F.lit("code_intent").alias("chunk_type"), F.when(F.length(F.btrim("docstring")) > 0, as_text(parse(F.col("docstring")))).alias("text")))
    out = units.select("geid", "fqn", "repo", F.explode(made).alias("c")).where(F.length(blank) > 0)
    return out.select(F.concat_ws("_", "geid", "c.chunk_type").alias("chunk_id"), "geid", "c.chunk_type", "fqn", "repo", "c.text")
