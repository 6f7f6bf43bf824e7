"""Media columns: texts stored as progressive JPEG files and read back.

The payload (UTF-8 bytes, zero-padded to a positive multiple of 64) is stored in the
format's own unit, the quantised DCT coefficient: each run of 64 bytes is one block in
zigzag order. Blocks fill 16 x 16 units of four luma and two chroma blocks (4:2:0). The
file has spectral-selection and successive-approximation scans. Reading accumulates all
scans into coefficient arrays, which give the payload back exactly, then inverse-transforms
them in numpy, upsamples the chroma and makes a full-resolution RGB tensor.

The coefficient of a byte b is 256 + b, and of the first byte of a block 512 + b with
alternating sign, so that within a scan all codes with their extra bits have one width; the
decoder reads such scans as arrays, and any other progressive scan symbol by symbol.

Edge cases: a null text is an empty one, stored as 64 zero bytes; equal texts have equal
files, hashes and features; null doc_ids and repeated rows pass through; restart intervals
raise ValueError.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import prepare, table
from .textops import batches, column

UNIT = 64
#: Zigzag order by its rule: diagonals, run through in alternating direction.
ZIGZAG = np.array([r * 8 + c for r, c in sorted(((r, c) for r in range(8) for c in range(8)), key=lambda p: (p[0] + p[1], p[0] if (p[0] + p[1]) % 2 else p[1]))])
_k, _n = np.mgrid[0:8, 0:8]
_DCT = (np.where(_k == 0, np.sqrt(0.125), 0.5) * np.cos((2 * _n + 1) * _k * np.pi / 16)).astype(np.float32)
_ONES = b"\x01" * 64


def padded(text: bytes) -> bytes:
    return text + bytes(-len(text) % UNIT if text else UNIT)


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _table(kind: int, symbols: list[int]) -> bytes:
    """A Huffman table whose first symbol's code is 0, the next's 10, then 110."""
    counts = bytes([1] * len(symbols) + [0] * (16 - len(symbols)))
    return _segment(0xC4, bytes([kind]) + counts + bytes(symbols))


def _scan(parts: list[tuple[int, int]], low: int, high: int, past: int, now: int, bits: bytes) -> bytes:
    head = bytes([len(parts)]) + b"".join(bytes(p) for p in parts) + bytes([low, high, past << 4 | now])
    return _segment(0xDA, head) + bits.replace(b"\xff", b"\xff\x00")


def _pack(bits: np.ndarray) -> bytes:
    tail = -len(bits) % 8
    return np.packbits(np.concatenate([bits, np.ones(tail, np.uint8)]) if tail else bits).tobytes()


def _wide(fields: np.ndarray, width: int) -> np.ndarray:
    return ((fields[:, None] >> np.arange(width - 1, -1, -1)) & 1).astype(np.uint8).ravel()


def _nine(values: np.ndarray) -> bytes:
    """Fields of a zero bit and eight bits each, packed."""
    n = len(values)
    f = np.full(-(-n // 8) * 8, 0x1FF, np.uint16)
    f[:n] = values
    f = f.reshape(-1, 8)
    out = np.empty((len(f), 9), np.uint8)
    for j in range(9):
        high = f[:, j] >> (j + 1) if j < 8 else 0
        out[:, j] = (f[:, j - 1] << (8 - j)) & 0xFF | high if j else high
    return out.tobytes()[: -(-9 * n // 8)]


def _refinement(coefficients: np.ndarray) -> tuple[list[int], bytes]:
    """Symbols of the table and bits of a refinement scan of blocks whose coefficients all are non-zero."""
    n, used, out = len(coefficients), [], []
    for low in range(0, n, 32767):
        part = coefficients[low : low + 32767]
        size = len(part).bit_length() - 1
        if size << 4 not in used:
            used.append(size << 4)
        code = [1] * used.index(size << 4) + [0] + [int(x) for x in f"{len(part) - (1 << size):0{size}b}"[:size]] if size else [1] * used.index(0) + [0]
        out += [np.array(code, np.uint8), (part & 1).astype(np.uint8).ravel()]
    return used, _pack(np.concatenate(out))


def _signs(n: int) -> np.ndarray:
    return 1 - 2 * (np.arange(n) & 1)


def encode(payload: bytes) -> bytes:
    """A progressive JPEG file of a payload of a positive multiple of 64 bytes."""
    units = -(-len(payload) // 384)
    across = max(1, min(4095, int(np.ceil(np.sqrt(units)))))
    down = -(-units // across)
    data = np.zeros(across * down * 384, np.int16)
    data[: len(payload)] = np.frombuffer(payload, np.uint8)
    blocks = data.reshape(-1, 6, 64) + 256
    m = len(blocks)
    blocks[:, :4, 0] = (blocks[:, :4, 0] + 256) * _signs(4 * m).reshape(m, 4)
    blocks[:, 4:, 0] = (blocks[:, 4:, 0] + 256) * _signs(m)[:, None]
    dc = blocks[:, :, 0].astype(np.int32) >> 1
    diff = np.empty_like(dc)
    y = dc[:, :4].ravel()
    diff[:, :4] = np.diff(y, prepend=0).reshape(m, 4)
    diff[:, 4:] = np.diff(dc[:, 4:], axis=0, prepend=0)
    fields = np.where(diff > 0, diff, diff + 1023)
    first = fields.ravel()
    for i in (0, 4, 5):  # the first of each component, of one bit less, after the code 10
        first[i] = 1 << 10 | int(diff.ravel()[i])
    luma = blocks[:, :4].reshape(down, across, 2, 2, 64).transpose(0, 2, 1, 3, 4).reshape(-1, 64)
    blue, red = blocks[:, 4], blocks[:, 5]
    frame = struct.pack(">BHHB", 8, down * 16, across * 16, 3) + bytes([1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])
    out = [b"\xff\xd8", _segment(0xEF, b"payload\0" + struct.pack(">Q", len(payload))), _segment(0xDB, b"\0" + _ONES), _segment(0xC2, frame)]
    out += [_table(0x00, [10, 9]), _table(0x10, [0x08])]
    every = [(1, 0), (2, 0), (3, 0)]
    out.append(_scan(every, 0, 0, 0, 1, _pack(_wide(first, 11))))
    for part, own, low, high in ((1, luma, 1, 5), (2, blue, 1, 63), (3, red, 1, 63), (1, luma, 6, 63)):
        out.append(_scan([(part, 0)], low, high, 0, 1, _nine((own[:, low : high + 1] >> 1).ravel())))
    out.append(_scan(every, 0, 0, 1, 0, _pack((blocks[:, :, 0] & 1).astype(np.uint8).ravel())))
    for part, own in ((1, luma), (2, blue), (3, red)):
        symbols, bits = _refinement(own[:, 1:])
        out += [_table(0x10, symbols), _scan([(part, 0)], 1, 63, 1, 0, bits)]
    return b"".join([*out, b"\xff\xd9"])


class _Bits:
    def __init__(self, raw: bytes) -> None:
        self.bits, self.at = np.unpackbits(np.frombuffer(raw, np.uint8)), 0

    def take(self, n: int) -> int:
        out = 0
        for b in self.bits[self.at : self.at + n].tolist():
            out = out << 1 | b
        self.at += n
        return out

    def array(self, n: int) -> np.ndarray:
        self.at += n
        if self.at > len(self.bits):
            raise ValueError("scan ends early")
        return self.bits[self.at - n : self.at]

    def symbol(self, codes: dict[tuple[int, int], int]) -> int:
        code = size = 0
        while size < 16:
            code, size = code << 1 | int(self.bits[self.at]), size + 1
            self.at += 1
            if (size, code) in codes:
                return codes[size, code]
        raise ValueError("unknown code")

    def signed(self, size: int) -> int:
        x = self.take(size)
        return x if not size or x >> (size - 1) else x - (1 << size) + 1


def _codes(counts: bytes, symbols: bytes) -> dict[tuple[int, int], int]:
    out, code, at = {}, 0, 0
    for size, n in enumerate(counts, 1):
        for _ in range(n):
            out[size, code] = symbols[at]
            code, at = code + 1, at + 1
        code <<= 1
    return out


def _fixed(codes: dict[tuple[int, int], int], ac: bool) -> int:
    """The width that all codes have with their extra bits; 0 if they differ or skip coefficients."""
    widths = {size + (s & 15) for (size, _), s in codes.items()}
    return widths.pop() if len(widths) == 1 and all(0 < s < 16 for s in codes.values()) and (not ac or len(codes) == 1) else 0


def _fields(bits: _Bits, n: int, width: int, codes: dict[tuple[int, int], int]) -> np.ndarray:
    """n values of a scan of fixed width."""
    got = bits.array(n * width)
    weights = 1 << np.arange(width - 1, -1, -1)
    raw = (got.reshape(n, width).astype(np.float32) @ weights.astype(np.float32)).astype(np.int32)
    out, known = np.zeros(n, np.int32), np.zeros(n, bool)
    for (size, code), s in codes.items():
        mine = raw >> (width - size) == code
        x = raw & ((1 << s) - 1)
        out = np.where(mine, np.where(x >> (s - 1), x, x - (1 << s) + 1), out)
        known |= mine
    if not known.all():
        raise ValueError("unknown code")
    return out


def _refine(bits: _Bits, codes: dict, blocks: np.ndarray, low: int, high: int, one: int) -> None:
    i = 0
    while i < len(blocks):
        k, run = low, 0
        own = blocks[i]
        while k <= high:
            s = bits.symbol(codes)
            skip, size, new = s >> 4, s & 15, 0
            if size:
                new = one if bits.take(1) else -one
            elif skip < 15:
                run = (1 << skip) + bits.take(skip)
                break
            while k <= high:
                if own[k]:
                    if bits.take(1) and not own[k] & one:
                        own[k] += one if own[k] > 0 else -one
                elif not skip:
                    break
                else:
                    skip -= 1
                k += 1
            if new and k <= high:
                own[k] = new
            k += 1
        if run:
            # The rest of this block and whole blocks after it hold correction bits alone.
            rest = blocks[i : i + run, low : high + 1]
            there = rest != 0
            if k > low:
                there[0, : k - low] = False
            if there.all():
                bit = bits.array(there.size).reshape(there.shape)
                plus = bit if one == 1 else bit.astype(rest.dtype) * one
                rest += np.where(rest > 0, plus, -plus.astype(rest.dtype)) * ((rest & one) == 0)
            else:
                bit = np.zeros(there.shape, rest.dtype)
                bit[there] = bits.array(int(there.sum()))
                rest += np.where((bit == 1) & ((np.abs(rest) & one) == 0), np.where(rest > 0, one, -one), 0).astype(rest.dtype)
            i += run
        else:
            i += 1


def decode(data: bytes) -> dict:
    """Components (raster order of blocks, coefficients in zigzag order), quantisers, size and APP15 payload length of a progressive JPEG."""
    if data[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG file")
    at, tables, quant, out = 2, {}, {}, {"payload": None}
    parts: dict[int, dict] = {}
    end = re.compile(rb"\xff[^\x00\xd0-\xd7\xff]")
    while True:
        marker = data[at + 1]
        if marker == 0xD9:
            break
        size = struct.unpack(">H", data[at + 2 : at + 4])[0]
        body = data[at + 4 : at + 2 + size]
        at += 2 + size
        if marker == 0xEF and body.startswith(b"payload\0"):
            out["payload"] = struct.unpack(">Q", body[8:16])[0]
        elif marker == 0xDB:
            while body:
                wide = 2 if body[0] >> 4 else 1
                quant[body[0] & 15] = np.frombuffer(body[1 : 1 + 64 * wide], ">u2" if wide == 2 else np.uint8).astype(np.float32)
                body = body[1 + 64 * wide :]
        elif marker == 0xC4:
            while body:
                n = sum(body[1:17])
                tables[body[0]] = _codes(body[1:17], body[17 : 17 + n])
                body = body[17 + n :]
        elif marker == 0xDD and any(body):
            raise ValueError("restart intervals are not read")
        elif marker == 0xC2:
            _, height, width, n = struct.unpack(">BHHB", body[:6])
            spec = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]
            hm, vm = max(s[1] for s in spec), max(s[2] for s in spec)
            across, down = -(-width // (8 * hm)), -(-height // (8 * vm))
            for c, h, v, q in spec:
                parts[c] = {"h": h, "v": v, "q": q, "rows": down * v, "cols": across * h, "own": (-(-(-(-height * v // vm)) // 8), -(-(-(-width * h // hm)) // 8)), "blocks": np.zeros((down * v * across * h, 64), np.int16)}
            out |= {"height": height, "width": width, "units": (down, across)}
        elif marker in (0xC0, 0xC1):
            raise ValueError("not progressive")
        elif marker == 0xDA:
            n = body[0]
            chosen = [(body[1 + 2 * i], body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15) for i in range(n)]
            low, high, past, now = body[1 + 2 * n], body[2 + 2 * n], body[3 + 2 * n] >> 4, body[3 + 2 * n] & 15
            stop = end.search(data, at).start()
            bits = _Bits(data[at:stop].replace(b"\xff\x00", b"\xff"))
            at = stop
            down, across = out["units"]
            if low == 0:
                # Blocks of each component in the order of the scan, and which component each belongs to.
                order, owner = [], []
                for i, (c, _, _) in enumerate(chosen):
                    p = parts[c]
                    grid = np.arange(p["rows"] * p["cols"]).reshape(p["rows"], p["cols"])
                    if n > 1:
                        grid = grid.reshape(down, p["v"], across, p["h"]).transpose(0, 2, 1, 3).reshape(down * across, -1)
                    else:
                        grid = grid[: p["own"][0], : p["own"][1]].reshape(-1, 1)
                    order.append(grid)
                    owner.append(np.full(grid.shape[1], i))
                order, owner = np.concatenate(order, 1), np.concatenate(owner)
                if past:
                    got = bits.array(order.size).reshape(order.shape).astype(np.int16) << now
                    for i, (c, _, _) in enumerate(chosen):
                        parts[c]["blocks"][order[:, owner == i].ravel(), 0] |= got[:, owner == i].ravel()
                else:
                    used = [tables[t] for _, t, _ in chosen]
                    width = _fixed(used[0], False) if all(u == used[0] for u in used) else 0
                    if width:
                        diff = _fields(bits, order.size, width, used[0]).reshape(order.shape)
                    else:
                        diff = np.array([[bits.signed(bits.symbol(used[i])) for i in owner] for _ in range(len(order))])
                    for i, (c, _, _) in enumerate(chosen):
                        parts[c]["blocks"][order[:, owner == i].ravel(), 0] = np.cumsum(diff[:, owner == i].ravel()) << now
                continue
            c, _, ac = chosen[0]
            p, codes = parts[c], tables[0x10 | ac]
            inside = (np.arange(p["rows"] * p["cols"]).reshape(p["rows"], p["cols"])[: p["own"][0], : p["own"][1]]).ravel()
            whole = len(inside) == len(p["blocks"])
            blocks = p["blocks"] if whole else p["blocks"][inside]
            if past:
                _refine(bits, codes, blocks, low, high, 1 << now)
            elif (width := _fixed(codes, True)) and len(bits.bits) >= blocks[:, low : high + 1].size * width:
                blocks[:, low : high + 1] = _fields(bits, blocks[:, low : high + 1].size, width, codes).reshape(len(blocks), -1) << now
            else:
                run = 0
                for own in blocks:
                    if run:
                        run -= 1
                        continue
                    k = low
                    while k <= high:
                        s = bits.symbol(codes)
                        skip, size = s >> 4, s & 15
                        if size:
                            k += skip
                            own[k] = bits.signed(size) << now
                            k += 1
                        elif skip == 15:
                            k += 16
                        else:
                            run = (1 << skip) + bits.take(skip) - 1
                            break
            if not whole:
                p["blocks"][inside] = blocks
        # other segments carry nothing that is needed
    return out | {"parts": parts, "quant": quant}


def payload(image: dict) -> bytes:
    """The bytes that encode() stored."""
    down, across = image["units"]
    y, b, r = (image["parts"][c]["blocks"] for c in (1, 2, 3))
    out = np.empty((down * across, 6, 64), np.int16)
    out[:, :4] = y.reshape(down, 2, across, 2, 64).transpose(0, 2, 1, 3, 4).reshape(-1, 4, 64)
    out[:, 4], out[:, 5] = b, r
    out[:, :, 0] = np.abs(out[:, :, 0]) - 256
    return (out - 256).astype(np.uint8).tobytes()[: image["payload"]]


def tensor(image: dict) -> np.ndarray:
    """Full-resolution RGB (height, width, 3): inverse transform, upsampled chroma, colour conversion."""
    planes = []
    hm, vm = (max(p[x] for p in image["parts"].values()) for x in ("h", "v"))
    for p in image["parts"].values():
        flat = np.empty((len(p["blocks"]), 64), np.float32)
        flat[:, ZIGZAG] = p["blocks"] * image["quant"][p["q"]]
        x = np.matmul(np.matmul(_DCT.T, flat.reshape(-1, 8, 8)), _DCT)
        plane = x.reshape(p["rows"], p["cols"], 8, 8).transpose(0, 2, 1, 3).reshape(p["rows"] * 8, p["cols"] * 8)
        plane = np.clip(np.rint(plane + 128), 0, 255)
        if p["h"] < hm or p["v"] < vm:
            plane = np.repeat(np.repeat(plane, vm // p["v"], 0), hm // p["h"], 1)
        planes.append(plane[: image["height"], : image["width"]])
    if len(planes) == 1:
        return np.repeat(planes[0].astype(np.uint8)[:, :, None], 3, 2)
    y, b, r = planes[0], planes[1] - 128, planes[2] - 128
    out = np.empty((*y.shape, 3), np.uint8)
    for i, x in enumerate((y + 1.402 * r, y - 0.344136 * b - 0.714136 * r, y + 1.772 * b)):
        out[:, :, i] = np.clip(np.rint(x), 0, 255)
    return out


def feature(rgb: np.ndarray) -> str:
    """Size, mean of each channel, and a 64-bit difference hash of an 8 x 9 grid of green sums."""
    h, w, _ = rgb.shape
    means = (rgb.reshape(-1, 3).sum(0, dtype=np.int64) * 100 // (h * w)).tolist()
    green = rgb[:, :, 1].astype(np.int64)
    grid = np.add.reduceat(np.add.reduceat(green, np.arange(8) * h // 8, 0), np.arange(9) * w // 9, 1)
    bits = np.packbits((grid[:, 1:] > grid[:, :-1]).ravel()).tobytes().hex()
    return f"{w}x{h}:{'-'.join(map(str, means))}:{bits}"


_NAMES = {"doc_id": pa.int64(), "n_bytes": pa.int64(), "payload_bytes": pa.int64(), "payload_sha256": pa.string(), "tail_crc32": pa.int64(), "media_bytes": pa.int64(), "media_sha256": pa.string(), "feature": pa.string(), "media": pa.binary(), "height": pa.int64(), "width": pa.int64(), "rgb": pa.binary()}
_KIND = {pa.int64(): "long", pa.string(): "string", pa.binary(): "binary"}


def media_columns(docs: DataFrame, files: bool = True) -> DataFrame:
    """docs(doc_id, text) as media rows; with files also the file, and its tensor as height, width and rgb bytes."""
    prepare(docs.sparkSession)
    names = list(_NAMES) if files else list(_NAMES)[:8]

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offs in batches(rows):
            out: dict[str, list] = {x: [] for x in names}
            raw = data.tobytes()
            for doc_id, a, b in zip(column(batch, "doc_id").to_pylist(), offs[:-1].tolist(), offs[1:].tolist(), strict=True):
                file = encode(padded(raw[a:b]))
                image = decode(file)
                back = payload(image)
                rgb = tensor(image)
                row = (doc_id, b - a, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(file), hashlib.sha256(file).hexdigest(), feature(rgb), file, *rgb.shape[:2], rgb.tobytes() if files else None)
                for x, v in zip(names, row, strict=False):
                    out[x].append(v)
            yield pa.RecordBatch.from_pydict({x: pa.array(out[x], _NAMES[x]) for x in names})

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, ", ".join(f"{x} {_KIND[_NAMES[x]]}" for x in names))


def op3_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_columns(table(spark, sf_dir, "documents"), files=False)


QUERIES = {"op3_media_columns": op3_media_columns}
