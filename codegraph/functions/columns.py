"""Column functions: identity, names, paths, routing and intent."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Phrases that ask for the whole system.
GLOBAL_PHRASES = (
    "overarching architecture", "overall architecture", "global architecture", "big picture", "full architecture", "entire system", "whole system",
    "system overview", "architecture overview", "high-level architecture", "complete architecture", "architectural overview", "how does the system work",
    "what does the system do", "describe the architecture", "how is the system structured", "codebase overview",
)
#: Intents in order of precedence, each with the patterns that show it (whole words, any case).
CODE = ("show me", "show the", "give me", "display", "print", "what does .+ look like", "how is .+ implemented", "implementation of", "source of", "code for", "source code of", "how does .+ work", "read the", "view the", "open the")
SAFETY = ("can i", "is it safe", "safely", "should i", "ok to", "okay to", "safe to", "remove", "delete", "drop", "deprecate", "eliminate", "is .+ used", "still used", "unused", "dead code")
CAPABILITY = (
    "does this", "does it", "is this", "is it", "can .+ be done", "can i .+ without", "support", "supports", "enforce", "enforces", "require", "requires", "mandatory", "optional",
    "without .+ token", "possible to", "allowed to", "is .+ enforced", "is .+ required", "is .+ checked", "is .+ validated", "can .+ bypass", "can .+ skip",
)
NARRATIVE = (
    "story", "full story", "full flow", "end.to.end", "start.to.end", "e2e flow", "walk me through", "walkthrough", "walk through", "trace through",
    "how does .+ work", "how do .+ work", "how is .+ implemented", "how does .+ get ", "how is .+ evaluated", "how does .+ evaluate", "how are .+ evaluated",
    "how does .+ run", "how does .+ execute", "how does .+ process", "how does .+ handle", "how does .+ perform", "explain how", "explain the flow", "explain the process", "explain the sequence",
    "from start", "beginning to end", "step by step", "step-by-step", "full picture", "overall flow", "full journey", "complete flow", "how this implements", "how the .+ implements", "how it implements",
)
#: Phrases of the impact intent, anywhere in the question.
IMPACT = ("blast radius", "what breaks", "what calls", "callers", "what changes", "impact", "dependency", "depends")
#: Words of a question that are no search terms, and constants that are no names.
TERM_NOISE = ("token", "claim", "which", "files", "should", "change", "currently", "introduce", "implement", "single", "multiple", "support", "method")
CONSTANT_NOISE = ("AUTHORIZATION", "OAUTH", "STRING", "OBJECT", "EXCEPTION", "NULL", "TRUE", "FALSE", "RETURN", "STATIC", "FINAL", "PUBLIC", "PRIVATE", "PROTECTED", "CLASS", "VOID", "OVERRIDE", "IMPORT", "PACKAGE", "THROWS", "ERROR")
#: Names in questions. Types, methods, quoted names, dotted names.
UPPER_CAMEL = "\\b([A-Z][a-z]+(?:[A-Z][a-z0-9]+)+)\\b"
LOWER_CAMEL = "\\b([a-z][a-z0-9]+(?:[A-Z][a-z0-9]+)+)\\b"
QUOTED_NAME = "[\"']([A-Za-z][A-Za-z0-9_$.]+)[\"']"
DOTTED = "\\b([a-z][a-z0-9]+\\.[a-z][a-z0-9]+(?:\\.[a-z][a-z0-9]+)*)\\b"


def geid(repo: Column, fqn: Column) -> Column:
    return F.substring(F.sha2(F.concat(repo, F.lit("::"), fqn), 256), 1, 16)


def short_name(fqn: Column) -> Column:
    return F.substring_index(F.substring_index(fqn, "(", 1), ".", -1)


def url_path(url: Column) -> Column:
    """Path of a URL or path without query and trailing slashes, led by a slash; / if none."""
    web = F.regexp_extract(url, "https?://[^/]+(/.+)", 1)
    path = F.when(web != "", web).when(url.rlike("^https?://"), "").when(url.startswith("/"), url).otherwise(F.concat(F.lit("/"), url))
    path = F.regexp_replace(F.split(path, "\\?")[0], "/+$", "")
    return F.when(path == "", "/").otherwise(path)


def token_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit("[A-Za-z0-9_]+|[^A-Za-z0-9_ \\t\\r\\n]"))


def symbols(text: Column) -> Column:
    """Upper-snake symbols and quoted identifiers, first occurrences in order."""
    snake = F.regexp_extract_all(text, F.lit("\\b([A-Z][A-Z0-9_]{2,})\\b"), 1)
    quoted = F.regexp_extract_all(text, F.lit("[\"']([A-Za-z_][A-Za-z0-9_]{2,})[\"']"), 1)
    return F.array_distinct(F.concat(snake, quoted))


def _longest(x: Column) -> Column:
    """An array of distinct strings, longest first, then by name."""
    by = lambda a, b: F.when(F.length(a) != F.length(b), F.length(b) - F.length(a)).when(a < b, -1).when(a > b, 1).otherwise(0)
    return F.array_sort(F.array_distinct(x), by)


def entities(text: Column) -> Column:
    """Names of types and methods, quoted names and dotted names, longest first, then by name."""
    return _longest(F.concat(*(F.regexp_extract_all(text, F.lit(p), 1) for p in (UPPER_CAMEL, LOWER_CAMEL, QUOTED_NAME, DOTTED))))


def is_global(text: Column) -> Column:
    out = F.lit(False)
    for phrase in GLOBAL_PHRASES:
        out = out | F.lower(text).contains(phrase)
    return out


def classify(text: Column) -> tuple[Column, Column]:
    """(bucket, confidence) of a question: global, symbolic, exact or conceptual, in that order."""
    sym, ent = F.size(symbols(text)), F.size(entities(text))
    dots = F.coalesce(F.array_max(F.transform(entities(text), lambda x: F.length(x) - F.length(F.replace(x, F.lit("."))))), F.lit(0))
    wide = is_global(text)
    bucket = F.when(wide, "global").when(sym > 0, "symbolic").when(ent > 0, "exact").otherwise("conceptual")
    sure = F.when(wide, 0.95).when(sym > 0, F.least(F.lit(1.0), 0.6 + 0.1 * sym)).when(ent > 0, F.least(F.lit(1.0), 0.5 + 0.1 * ent + 0.04 * dots)).otherwise(0.3)
    return bucket, F.round(sure, 6)


def dispatch(text: Column, threshold: float = 0.7) -> Column:
    """The route a question takes: global, symbolic, exact or semantic; exact needs a type name or the threshold."""
    bucket, sure = classify(text)
    typed = F.exists(entities(text), lambda x: x.rlike("^[A-Z][a-z]+(?:[A-Z][a-z0-9]+)+$"))
    return F.when(bucket.isin("global", "symbolic"), bucket).when((bucket == "exact") & (typed | (sure >= threshold)), "exact").otherwise("semantic")


def intent(text: Column) -> Column:
    """code, safety, capability, impact, narrative or general, in that order of precedence."""
    shown = lambda words: F.lower(text).rlike("\\b(" + "|".join(words) + ")\\b")
    hit = F.lit(False)
    for phrase in IMPACT:
        hit = hit | F.lower(text).contains(phrase)
    return F.when(shown(CODE), "code").when(shown(SAFETY), "safety").when(shown(CAPABILITY), "capability").when(hit, "impact").when(shown(NARRATIVE), "narrative").otherwise("general")


def search_terms(text: Column, most: int = 10) -> Column:
    """Terms to look up: three entities, then camel-case names and plain words of five letters and more, ten in all."""
    camel = F.regexp_extract_all(text, F.lit("([A-Za-z][a-z0-9]+(?:[A-Z][a-z0-9]+)+)"), 1)
    plain = F.filter(F.regexp_extract_all(F.lower(text), F.lit("([a-z]{5,})"), 1), lambda x: ~x.isin(*TERM_NOISE))
    return F.slice(F.concat(F.slice(entities(text), 1, 3), F.array_distinct(F.concat(camel, plain))), 1, most)


def merged_terms(given: Column, text: Column, most: int = 10) -> Column:
    """Terms that a model gave, then up to three entities, distinct in order."""
    return F.slice(F.array_distinct(F.concat(F.filter(given, lambda x: F.length(x) >= 2), F.slice(entities(text), 1, 3))), 1, most)


def constants(text: Column, most: int = 3) -> Column:
    """The longest upper-snake names of five characters and more that say something, then by name."""
    found = F.array_except(F.regexp_extract_all(text, F.lit("\\b([A-Z][A-Z0-9_]{4,})\\b"), 1), F.array(*map(F.lit, CONSTANT_NOISE)))
    return F.slice(_longest(found), 1, most)


def shortened(text: Column, most: int, mark: str = "...") -> Column:
    return F.when(F.length(text) > most, F.concat(F.left(text, F.lit(most)), F.lit(mark))).otherwise(text)


def squared_l2(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda p, q: (p.cast("double") - q.cast("double")) * (p.cast("double") - q.cast("double"))), F.lit(0.0), lambda s, v: s + v)


def grep_category(line: Column, path: Column) -> Column:
    """definition, import, test or production, in that order of precedence."""
    test = path.contains("src/test") | path.endswith("Test.java")
    constant = (line.contains("static final") | line.contains("public static")) & line.contains("=")
    return F.when(constant & ~test, "definition").when(F.ltrim(line).startswith("import "), "import").when(test, "test").otherwise("production")


def distance_score(distance: Column) -> Column:
    """0 to 100 from a cosine distance, rounded half to even."""
    return F.greatest(F.lit(0), F.bround((1 - distance / 2) * 100, 0)).cast("long")
