"""Java sources to types, methods and fields: a tokenizer and a descent over declarations.

The grammar is followed down to members; method bodies are scanned for calls and object
creations only. Files are parsed independently, one row in, one row per type out.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import partial
from itertools import accumulate, compress

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import geid
from ..storage import ship

#: Annotations of injected fields, and base types of event handlers.
INJECTING = ("@Autowired", "@Inject", "@Resource", "@Reference", "@OSGiService")
EVENT_HANDLERS = ("AbstractEventHandler", "EventHandler", "IdentityEventHandler", "AbstractIdentityHandler", "UserOperationEventListener", "AbstractUserOperationEventListener")

_SAID = r'//[^\n]*|/\*.*?(?:\*/|\Z)|"""(?:\\.|.)*?(?:"""|\Z)|"(?:\\.|[^"\\\n])*"?|\'(?:\\.|[^\'\\\n])*\'?|\.\.\.|->|::|\S'
#: White space and what follows it: names, numbers, comments, literals, marks, and no character is passed over. Text of ASCII alone, which most is, goes by plain sets of characters.
_TOKEN = re.compile(rf"\s*(?:[^\W\d][\w$]*|\$[\w$]*|\d[\w.]*|{_SAID})", re.S)
_TOKEN_ASCII = re.compile(rf"[\t-\r\x1c-\x20]*(?:[A-Za-z_$][A-Za-z0-9_$]*|[0-9][A-Za-z0-9_.]*|{_SAID})", re.S)
_CLOSING = {"(": ")", "{": "}", "[": "]"}
_SPOTS = {"new", *_CLOSING, *_CLOSING.values()}
#: What may go on after the first name of a type.
_GOES_ON = {".", "?", "&", "<", "[", "extends", "super"}
_MODIFIERS = {"public", "protected", "private", "static", "final", "abstract", "native", "synchronized", "transient", "volatile", "strictfp", "default", "sealed"}
_NOT_CALLS = {"if", "for", "while", "switch", "catch", "return", "synchronized", "super", "this", "throw", "assert", "try", "new", "else", "do", "case", "yield", "instanceof"}
_BEFORE = {"@", "non", *_MODIFIERS}
_KINDS = {"class": "class", "record": "class", "interface": "interface", "enum": "enum"}

UNIT = "struct<fqn string, name string, kind string, parameters array<struct<name string, type_name string>>, return_type string, body_text string, docstring string, annotations array<string>, calls array<string>, throws array<string>, overrides string, instantiates array<string>, start_line int, end_line int>"
FIELD = "struct<name string, type_name string, annotations array<string>, is_injected boolean>"
SCHEMA = f"file_path string, repo string, fqn string, kind string, implements array<string>, extends string, docstring string, annotations array<string>, is_event_handler boolean, start_line int, end_line int, fields array<{FIELD}>, logic_units array<{UNIT}>"


def _bare(name: str) -> str:
    return name.split("<")[0].strip() if "<" in name else name.strip()


class Source:
    """One compilation unit; types() yields its types, nested ones as Outer.Inner.

    Without units methods and constructors are passed over; without bodies they come without texts, calls and creations.
    """

    def __init__(self, text: str, units: bool = True, bodies: bool = True):
        self.text, self.doc, self.units, self.bodies = text, {}, units, bodies
        found = (_TOKEN_ASCII if text.isascii() else _TOKEN).findall(text)
        word, ends = list(map(str.lstrip, found)), list(accumulate(map(len, found)))
        if "//" in text or "/*" in text:
            plain = [True] * len(word)
            said = {w for w in set(word) if w[:2] in ("//", "/*")}
            for n, k in enumerate([k for k, w in enumerate(word) if w in said]):
                plain[k] = False
                if word[k].startswith("/**") and len(word[k]) > 4:
                    self.doc[k - n] = word[k]
            word, ends = list(compress(word, plain)), list(compress(ends, plain))
        self.word, self.ends = word, ends
        self.names = {w for w in set(self.word) if w[0] in "_$" or w[0].isalnum() and not w[0].isdecimal()}
        self.lines = list(accumulate(len(x) + 1 for x in text.split("\n")))
        # Groups, calls and creations are looked up, so that no loop runs over the tokens of a body.
        self.groups: dict[str, dict[int, int]] = {}
        self.spots = [k for k, w in enumerate(self.word) if w in _SPOTS]
        self.open = [k for k in self.spots if self.word[k] == "("]
        self.new = [k for k in self.spots if self.word[k] == "new"]
        self.i, self.package, self.imports = 0, "", {}

    # Moves over tokens

    def now(self, ahead: int = 0) -> str:
        return self.word[self.i + ahead] if self.i + ahead < len(self.word) else ""

    def begin(self, k: int) -> int:
        return self.ends[k] - len(self.word[k])

    def row(self, k: int) -> int:
        """Line of token k, counted from 1."""
        return bisect_right(self.lines, self.begin(k)) + 1

    def over(self, opening: str, closing: str) -> None:
        """Past a balanced group that begins here; brackets of other kinds don't matter."""
        if opening not in self.groups:
            self.groups[opening], held = {}, []
            for k in self.spots if opening in _SPOTS else range(len(self.word)):
                w = self.word[k]
                if w == opening:
                    held.append(k)
                elif w == closing and held:
                    self.groups[opening][held.pop()] = k + 1
        self.i = self.groups[opening].get(self.i, len(self.word))

    def until(self, *marks: str) -> None:
        """To the next of marks outside of parentheses, brackets and braces."""
        word, i, n = self.word, self.i, len(self.word)
        while i < n and word[i] not in marks:
            group = _CLOSING.get(word[i])
            if group:
                self.i = i
                self.over(word[i], group)
                i = self.i
            else:
                i += 1
        self.i = i

    def raw(self, start: int, end: int) -> str:
        end = min(end, len(self.ends))
        return self.text[self.begin(start) : self.ends[end - 1]] if end > start else ""

    def dotted(self) -> str:
        word, names, i, n = self.word, self.names, self.i, len(self.word)
        while i < n and (word[i] in names or word[i] == "*"):
            i += 1
            if i == n or word[i] != ".":
                break
            i += 1
        start, self.i = self.i, i
        return "".join(word[start:i])

    def type_name(self) -> str:
        """A type with its arguments and dimensions, as written."""
        start, word, names, n = self.i, self.word, self.names, len(self.word)
        if start + 1 < n and word[start] in names and word[start] not in _GOES_ON and word[start + 1] not in _GOES_ON:
            self.i += 1
            return word[start]
        while self.now() == "@":
            self.annotation()
            start = self.i
        while self.i < n:
            w = word[self.i]
            if w in names or w in (".", "?", "&"):
                if w in names and self.i > start and word[self.i - 1] not in (".", "?", "&", "extends", "super") and w not in ("extends", "super"):
                    break
                self.i += 1
            elif w == "<":
                self.over("<", ">")
            elif w == "[" and self.now(1) == "]":
                self.i += 2
            else:
                break
        return self.raw(start, self.i)

    def annotation(self) -> str:
        start = self.i
        self.i += 1
        self.dotted()
        if self.now() == "(":
            self.over("(", ")")
        return self.raw(start, self.i)

    def modifiers(self) -> tuple[list[str], str | None, int]:
        """Annotations, the doc comment directly before them, and the first token."""
        word, start, found, n = self.word, self.i, [], len(self.word)
        doc = self.doc.get(start) if start < n else None
        while self.i < n and word[self.i] in _BEFORE:
            w = word[self.i]
            if w == "@" and self.now(1) != "interface":
                found.append(self.annotation())
            elif w in _MODIFIERS and self.now(1) not in ("(", ":"):
                self.i += 1
            elif w == "non" and self.now(1) == "-":
                self.i += 3
            else:
                break
        return found, doc, start

    def resolve(self, name: str) -> str:
        bare = _bare(name)
        return self.imports.get(bare, bare)

    # Declarations

    def types(self) -> Iterator[dict]:
        while self.i < len(self.word):
            found, doc, start = ([], None, self.i) if self.word[self.i] in ("import", ";") else self.modifiers()
            if self.now() == "package":
                self.i += 1
                self.package = self.dotted()
            elif self.now() == "import":
                self.i += 1
                if self.now() == "static":
                    self.i += 1
                name = self.dotted()
                if not name.endswith("*"):
                    self.imports[name.rsplit(".", 1)[-1]] = name
            elif self.declares():
                yield from self.type_(found, doc, start, "")
            else:
                self.i += 1

    def declares(self) -> bool:
        w = self.now()
        if w == "@":
            return self.now(1) == "interface"
        return w in _KINDS and self.i + 1 < len(self.word) and self.word[self.i + 1] in self.names and (w != "record" or self.now(2) in ("(", "<"))

    def list_of_types(self) -> list[str]:
        out = [self.resolve(self.type_name())]
        while self.now() == ",":
            self.i += 1
            out.append(self.resolve(self.type_name()))
        return out

    def type_(self, annotations: list[str], doc: str | None, start: int, outer: str) -> Iterator[dict]:
        kind = "annotation" if self.now() == "@" else _KINDS[self.now()]
        self.i += 2 if kind == "annotation" else 1
        name = f"{outer}.{self.now()}" if outer else self.now()
        self.i += 1
        if self.now() == "<":
            self.over("<", ">")
        if self.now() == "(":
            self.over("(", ")")
        extends, implements = None, []
        while self.now() in ("extends", "implements", "permits"):
            word = self.now()
            self.i += 1
            found = self.list_of_types()
            if word == "extends" and kind != "interface":
                extends = found[0]
            elif word != "permits":
                implements += found
        fqn = f"{self.package}.{name}" if self.package else name
        row = {"fqn": fqn, "kind": kind, "implements": implements, "extends": extends, "docstring": doc, "annotations": annotations, "start_line": self.row(start), "fields": [], "logic_units": []}
        row["is_event_handler"] = any(x.rsplit(".", 1)[-1] in EVENT_HANDLERS for x in [extends or "", *implements])
        nested: list[dict] = []
        if self.now() == "{":
            self.i += 1
            if kind == "enum":
                self.until(";", "}")
            while self.i < len(self.word) and self.now() != "}":
                nested += self.member(row, name)
            self.i += 1
        row["end_line"] = self.row(min(self.i, len(self.ends)) - 1)
        yield row
        yield from nested

    def member(self, row: dict, owner: str) -> list[dict]:
        annotations, doc, start = self.modifiers()
        if self.declares():
            return list(self.type_(annotations, doc, start, owner))
        w = self.now()
        if w == "{":
            self.over("{", "}")
            return []
        if w == "<":
            self.over("<", ">")
            w = self.now()
        first = self.i
        simple = owner.rsplit(".", 1)[-1]
        if w == simple and self.now(1) in ("(", "{"):
            self.i += 1
            self.unit(row, simple, None, "constructor", annotations, doc, start)
            return []
        kind = self.type_name()
        name = self.now()
        if kind and self.i < len(self.word) and self.word[self.i] in self.names:
            self.i += 1
            if self.now() == "(":
                self.unit(row, name, kind, "method", annotations, doc, start)
            else:
                inject = any(a.split("(")[0].strip() in INJECTING for a in annotations)
                while True:
                    row["fields"].append({"name": name, "type_name": kind, "annotations": annotations, "is_injected": inject})
                    self.until(",", ";", "}")
                    if self.now() != ",":
                        break
                    self.i += 1
                    name = self.now()
                if self.now() == ";":
                    self.i += 1
        elif self.i == first or self.now() == ";":
            self.i += 1
        return []

    def unit(self, row: dict, name: str, returns: str | None, kind: str, annotations: list[str], doc: str | None, start: int) -> None:
        parameters, word, names, n = [], self.word, self.names, len(self.word)
        if not self.units:
            if self.now() == "(":
                self.over("(", ")")
            self.until("{", ";")
            if self.now() == "{":
                self.over("{", "}")
            else:
                self.i += 1
            return
        if self.now() == "(":
            self.i += 1
            while self.i < n and word[self.i] != ")":
                before = self.i
                if word[before] in _BEFORE:
                    self.modifiers()
                type_ = self.type_name()
                w = self.now()
                if w == "...":
                    type_ += "[]"
                    self.i += 1
                    w = self.now()
                if w in names:
                    parameters.append({"name": w, "type_name": type_})
                self.until(",", ")")
                self.i += self.now() == ","
                if self.i == before:
                    self.i += 1
            self.i += 1
        while self.now() == "[":
            self.over("[", "]")
        throws = []
        if self.now() == "throws":
            self.i += 1
            throws = self.list_of_types()
        if self.now() not in ("{", ";"):
            self.until("{", ";")
        begin = self.i
        if self.now() == "{":
            self.over("{", "}")
        else:
            self.i += 1
        calls, made = self.scan(begin, self.i) if self.bodies else ([], [])
        fqn = f"{row['fqn']}.{name}" + (f"({','.join(p['type_name'] for p in parameters)})" if parameters else "")
        above = f"{row['extends']}.{name}" if row["extends"] and any("@Override" in a for a in annotations) else None
        row["logic_units"].append({"fqn": fqn, "name": name, "kind": kind, "parameters": parameters, "return_type": returns, "body_text": self.raw(start, self.i) if self.bodies else None, "docstring": doc, "annotations": annotations, "calls": calls, "throws": throws, "overrides": above, "instantiates": made, "start_line": self.row(start), "end_line": self.row(min(self.i, len(self.ends)) - 1)})

    def scan(self, begin: int, end: int) -> tuple[list[str], list[str]]:
        """Targets of calls and names of created types between two tokens, first occurrences in order."""
        calls, made = {}, {}
        skip, last = -1, min(end, len(self.word))
        new = self.new[bisect_left(self.new, begin) : bisect_left(self.new, last)]
        open_ = self.open[bisect_left(self.open, begin + 1) : bisect_left(self.open, last)]
        for k in sorted({*new, *(p - 1 for p in open_)}) if new or open_ else ():
            if self.word[k] == "new":
                at, self.i = self.i, k + 1
                name, skip = self.type_name(), self.i
                if self.now() == "(":
                    made[self.resolve(name)] = None
                self.i = at
            elif k >= skip and self.word[k] in self.names and self.word[k] not in _NOT_CALLS:
                if self.word[k - 1] != ".":
                    receiver = ""
                elif k - 2 > begin and self.word[k - 2] in self.names and self.word[k - 3] not in (".", "new"):
                    receiver = self.word[k - 2]
                else:
                    receiver = self.receiver(k, begin)
                hint = self.imports.get(receiver)
                calls[f"{hint or receiver}.{self.word[k]}" if receiver else self.word[k]] = None
        return list(calls), list(made)

    def receiver(self, k: int, begin: int) -> str:
        """The expression before the dot that precedes token k."""
        j = k - 1
        while j > begin and self.word[j] == ".":
            j -= 1
            while j > begin and self.word[j] in (")", "]"):
                closing, opening, depth = self.word[j], {")": "(", "]": "["}[self.word[j]], 0
                while j > begin:
                    depth += (self.word[j] == closing) - (self.word[j] == opening)
                    if not depth:
                        break
                    j -= 1
                if self.word[j - 1] == ">":  # arguments of a created type
                    j -= 1
                    while j > begin and self.word[j] != "<":
                        j -= 1
                if self.word[j - 1] in self.names and self.word[j - 1] not in _NOT_CALLS - {"this", "super"}:
                    j -= 1
                elif self.word[j - 1] in (")", "]"):
                    j -= 1
                else:
                    break
            if self.word[j - 1] == "new":
                j -= 1
                break
            if self.word[j - 1] != ".":
                break
            j -= 1
        return re.sub(r"\s+", "", self.raw(j, k - 1)) if self.word[j] != "new" else re.sub(r"\s+", " ", self.raw(j, k - 1))


#: Characters of source text whose types are held at once.
PIECE = 1 << 20
_ARROW = {"string": pa.string(), "int": pa.int32(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string())}


def _arrow(kind: str) -> pa.DataType:
    """The Arrow type of a type of SCHEMA."""
    if kind in _ARROW:
        return _ARROW[kind]
    inner = kind.partition("<")[2][:-1]
    if kind.startswith("array<"):
        return pa.list_(_arrow(inner))
    return pa.struct([(name, _arrow(of)) for name, of in _fields(inner)])


def _fields(ddl: str) -> list[tuple[str, str]]:
    out, depth, start = [], 0, 0
    for i, c in enumerate(ddl + ","):
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            name, _, kind = ddl[start:i].strip().partition(" ")
            out.append((name, kind))
            start = i + 1
    return out


def _rows(parts: Iterator[pa.RecordBatch], units: bool = True, bodies: bool = True) -> Iterator[pa.RecordBatch]:
    """The types of some files at a time, so that memory follows neither the batch nor the table."""
    schema = pa.schema([(name, _arrow(kind)) for name, kind in _fields(SCHEMA)])
    for part in parts:
        out, held = [], 0
        for path, repo, text in zip(part["file_path"], part["repo"], part["text"], strict=True):
            source = text.as_py() or ""
            names = {"file_path": path.as_py(), "repo": repo.as_py()}
            out += ({**names, **found} for found in Source(source, units, bodies).types())
            held += len(source)
            if held >= PIECE:
                yield pa.RecordBatch.from_pylist(out, schema)
                out, held = [], 0
        yield pa.RecordBatch.from_pylist(out, schema)


def tasks(spark: SparkSession) -> int:
    """How many tasks files are dealt out to."""
    return max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def parse(files: DataFrame, units: bool = True, bodies: bool = True, dealt: bool = False) -> DataFrame:
    """One row per type of files(file_path, repo, text), with its fields and logic units nested and its geid.

    Who reads no units, or nothing of their bodies, says so; logic_units are then empty, or lack
    body_text, calls and instantiates.
    Files are dealt out anew: what comes from joins or from few large files would else lie in as many
    tasks as its bytes need, not its parsing. Who has dealt them to tasks() already says so, and no
    text is shuffled.
    """
    spark = files.sparkSession
    ship(spark)
    files = files.select("file_path", "repo", "text")
    return (files if dealt else files.repartition(tasks(spark), "repo", "file_path")).mapInArrow(partial(_rows, units=units, bodies=bodies), SCHEMA).withColumn("geid", geid(F.col("repo"), F.col("fqn")))


def units(types: DataFrame) -> DataFrame:
    """One row per method or constructor, with the type it belongs to and its geid."""
    out = types.select("file_path", "repo", F.col("fqn").alias("owner"), F.col("geid").alias("owner_geid"), F.explode("logic_units").alias("u")).select("file_path", "repo", "owner", "owner_geid", "u.*")
    return out.withColumn("geid", geid(F.col("repo"), F.col("fqn")))
