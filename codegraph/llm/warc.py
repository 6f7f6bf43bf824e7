"""WARC archives: writing with segmented records, and reassembly of segments.

Archives are rows (archive, data) of a table in shared storage, each a run of gzip members,
one member a record, as in a .warc.gz file. A long HTTP message is cut into a first record
and continuation records, which may stand in other archives. Reading groups continuation
records by origin identifier, orders them by segment number, checks that numbers are without
gap and lengths add up to the stated total, and decodes chunked transfer framing.

Edge cases: null html is an empty payload; null page_id and url are written as empty fields
and read back as null; repeated rows give repeated records, of which each is returned; an
empty table gives no archive and an empty result. A record whose segments are incomplete
or whose lengths disagree is returned with complete = false and null payload.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterable, Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, prepare, table
from .textops import batches, column

#: Bytes of an archive before the next begins; bytes of an HTTP message in one record; bytes of a transfer chunk.
ARCHIVE, SEGMENT, TRANSFER = 2 << 20, 32 << 10, 8 << 10
_RECORD = "kind string, record_id string, origin string, segment long, total long, page_id long, url string, refers_to long, digest string, block binary, copy long"
_NAMES = [x.split()[0] for x in _RECORD.split(", ")]


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def chunked(payload: bytes, size: int = TRANSFER) -> bytes:
    parts = [b"%x\r\n%s\r\n" % (len(x := payload[i : i + size]), x) for i in range(0, len(payload), size)]
    return b"".join(parts) + b"0\r\n\r\n"


def unchunked(body: bytes) -> bytes:
    """Decode chunked framing, with chunk extensions and trailers; ValueError where it is malformed."""
    out, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        size = int(body[at:end].split(b";")[0].strip(), 16)
        at = end + 2
        if size == 0:
            return b"".join(out)
        if body[at + size : at + size + 2] != b"\r\n":
            raise ValueError("chunk without its end")
        out.append(body[at : at + size])
        at += size + 2


def http_payload(message: bytes) -> bytes:
    head, found, body = message.partition(b"\r\n\r\n")
    if not found:
        raise ValueError("HTTP message without end of headers")
    coded = any(x.lower().replace(b" ", b"") == b"transfer-encoding:chunked" for x in head.split(b"\r\n"))
    return unchunked(body) if coded else body


def _record(fields: list[tuple[str, object]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", len(block))] if v is not None)
    return zlib.compress(b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n", 1, 31)


def records(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, copy: int = 0) -> Iterator[bytes]:
    """The records of one page: a response in as many segments as it needs, or a revisit."""
    sha = digest(payload)
    own = f"<urn:x-page:{'' if page_id is None else page_id}:{sha}:{copy}>"
    common = [("WARC-Target-URI", None if url is None else quote(url, safe=":/?#[]@!$&'()*+,;=%")), ("WARC-Date", "2024-01-01T00:00:00Z"), ("WARC-Payload-Digest", f"sha1:{sha}")]
    if refers_to is not None:
        head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
        profile = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
        yield _record([("WARC-Type", "revisit"), ("WARC-Record-ID", own), *common, ("WARC-Profile", profile), ("WARC-Refers-To", f"<urn:x-page:{refers_to}:{sha}:0>"), ("Content-Type", "application/http; msgtype=response")], head)
        return
    message = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n" + chunked(payload)
    n = max(1, -(-len(message) // SEGMENT))
    for i in range(n):
        part = message[i * SEGMENT : (i + 1) * SEGMENT]
        last = ("WARC-Segment-Total-Length", len(message) if n > 1 and i == n - 1 else None)
        number = ("WARC-Segment-Number", i + 1 if n > 1 else None)
        if i == 0:
            yield _record([("WARC-Type", "response"), ("WARC-Record-ID", own), *common, number, last, ("Content-Type", "application/http; msgtype=response")], part)
        else:
            yield _record([("WARC-Type", "continuation"), ("WARC-Record-ID", f"{own[:-1]}:{i + 1}>"), ("WARC-Segment-Origin-ID", own), *common[:2], number, last], part)


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers with lower-case names, block) of each record of an archive."""
    while data:
        one = zlib.decompressobj(31)
        raw = one.decompress(data) + one.flush()
        data = one.unused_data
        head, _, rest = raw.partition(b"\r\n\r\n")
        lines = head.decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError("not a WARC record")
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        n = int(fields["content-length"])
        if len(rest) < n:
            raise ValueError("truncated WARC record")
        yield fields, rest[:n]


def _pack(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out, size = [], 0

    def done() -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"data": pa.array([b"".join(out)], pa.binary())})

    info = _record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", "<urn:x-page:info>"), ("WARC-Date", "2024-01-01T00:00:00Z"), ("Content-Type", "application/warc-fields")], b"software: codegraph\r\nformat: WARC File Format 1.1\r\n")
    for batch, _, _ in batches(rows, "html"):
        for page_id, url, html, refers_to in zip(*(column(batch, x).to_pylist() for x in ("page_id", "url", "html", "refers_to")), strict=True):
            payload = (html or "").encode()
            for record in records(page_id, url, payload, refers_to, 0):
                if not out:
                    out.append(info)
                out.append(record)
                size += len(record)
                if size >= ARCHIVE:
                    yield done()
                    out, size = [], 0
    if out:
        yield done()


def _unpack(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([(n, {"long": pa.int64(), "binary": pa.binary()}.get(t, pa.string())) for n, t in (x.split() for x in _RECORD.split(", "))])

    def batch(held: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)

    for whole in rows:
        for data in column(whole, "data"):
            held, size = [], 0
            for f, block in parse(data.as_py()):
                if f["warc-type"] == "warcinfo":
                    continue
                number = lambda x: int(x) if x else None
                own = f.get("warc-segment-origin-id", f["warc-record-id"])
                refers = f.get("warc-refers-to")
                url = f.get("warc-target-uri")
                held.append((f["warc-type"], f["warc-record-id"], own, int(f.get("warc-segment-number", 1)), number(f.get("warc-segment-total-length")), number(own.split(":")[2]), None if url is None else unquote(url), number(refers.split(":")[2]) if refers else None, f.get("warc-payload-digest", "").removeprefix("sha1:"), block, 0 if "warc-segment-number" in f else 1))
                size += len(block)
                if size >= ARCHIVE:
                    yield batch(held)
                    held, size = [], 0
            if held:
                yield batch(held)


def reassemble(segments: Iterable[tuple[int, int | None, bytes]]) -> bytes | None:
    """The HTTP message of (segment number, total length, block) in any order; None if a part is missing or lengths disagree."""
    by = {n: (total, block) for n, total, block in segments}
    if sorted(by) != list(range(1, len(by) + 1)):
        return None
    message = b"".join(by[n][1] for n in sorted(by))
    return message if by[len(by)][0] == len(message) else None


_PAGE = "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long, complete boolean"
_ORIGIN = "kind string, page_id long, url string, refers_to long, digest string, message binary, n long"


def _join_segments(key: tuple, rows: pa.Table) -> pa.Table:
    r = rows.to_pylist()
    first = [x for x in r if x["segment"] == 1]
    message = reassemble((x["segment"], x["total"], x["block"]) for x in r)
    x = first[0] if first else r[0]
    n = max(1, len(first))
    return pa.table({"kind": ["response"] * n, "page_id": pa.array([x["page_id"]] * n, pa.int64()), "url": pa.array([x["url"]] * n, pa.string()), "refers_to": pa.array([None] * n, pa.int64()), "digest": pa.array([x["digest"]] * n, pa.string()), "message": pa.array([message] * n, pa.binary()), "n": pa.array([len(r)] * n, pa.int64())})


def _decode(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in rows:
        out = {x.split()[0]: [] for x in _PAGE.split(", ")}
        for kind, page_id, url, refers_to, sha, message in zip(*(column(batch, x).to_pylist() for x in ("kind", "page_id", "url", "refers_to", "digest", "message")), strict=True):
            payload, size = None, None
            if kind == "revisit":
                size = next((int(x.split(b":")[1]) for x in message.split(b"\r\n") if x.lower().startswith(b"content-length:")), None)
            elif message is not None:
                try:
                    payload = http_payload(message)
                    size, ok = len(payload), digest(payload) == sha
                    sha = digest(payload)
                    if not ok:
                        payload = None
                except ValueError:
                    payload = None
            whole = size is not None and (kind == "revisit" or payload is not None)
            for k, v in zip(out, (page_id, url, payload, size, sha, kind, refers_to, whole), strict=True):
                out[k].append(v)
        types = {"long": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_(), "string": pa.string()}
        yield pa.RecordBatch.from_pydict({n: pa.array(out[n], types[t]) for n, t in (x.split() for x in _PAGE.split(", "))})


def write_warc(pages: DataFrame, revisit_from: int = 0) -> DataFrame:
    """Archives of pages(page_id, url, html): rows (data). Of equal payloads of at least revisit_from bytes, all but that with the largest page_id are revisits."""
    prepare(pages.sparkSession)
    hashed = pages.select("page_id", "url", "html", F.sha2(F.coalesce("html", F.lit("")), 256).alias("sha"))
    last = hashed.where(F.octet_length(F.coalesce("html", F.lit(""))) >= revisit_from).groupBy("sha").agg(F.max("page_id").alias("last"))
    refers = F.when(F.col("last").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("last")), F.col("last"))
    return hashed.join(last, "sha", "left").select("page_id", "url", "html", refers.alias("refers_to")).mapInArrow(_pack, "data binary")


def read_warc(archives: DataFrame) -> DataFrame:
    """Pages of archives: page_id, url, payload, payload_bytes, payload_digest, record_type, refers_to, complete."""
    prepare(archives.sparkSession)
    found = archives.mapInArrow(_unpack, _RECORD)
    whole = found.where("copy = 1").select("kind", "page_id", "url", "refers_to", "digest", F.col("block").alias("message"))
    cut = found.where("copy = 0").groupBy("origin").applyInArrow(_join_segments, _ORIGIN).drop("n")
    return whole.unionByName(cut).mapInArrow(_decode, _PAGE)


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = materialise(write_warc(table(spark, sf_dir, "pages")), "warc")
    return read_warc(archives).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


QUERIES = {"op8_warc": op8_warc}
