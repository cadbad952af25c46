"""Secret scans through nested encodings.

A text is a layer. Each layer is scanned for three kinds of secrets, and for stretches that are encoded: percent escapes,
Unicode escapes (`\\u0041`, `\\x41`, `&#65;`, `&amp;`), base64, also broken over lines, and, behind base64, gzip (all
members), zlib or zstandard, one in the other as often as may be. What a stretch decodes to is a new layer on the worklist,
until none is new: a layer whose content was seen in the same document under the same place is not opened again, nor are
bytes unpacked twice, which ends cycles; every other step shortens the text or is bounded by the size it unpacks to.
Each character of a layer knows the stretch of the text that it came from, so a secret found at any depth has a span in the
document. A percent or Unicode layer is the whole layer with its escapes replaced, so that a secret split by them is found;
a base64 layer is its own stretch. As characters beside base64 may look like it (`data/<base64>`), a stretch is decoded at
each of the four places where its groups may begin. Bytes are read as UTF-8, as UTF-16 if that shows, and else as Latin-1.

Defined cases: null and empty texts have no spans; repeated rows give repeated results; very long texts are scanned whole;
spans that lie at equal places with equal kinds are listed once; a percent escape that isn't UTF-8 stays while its neighbours
are decoded; empty tables give empty results; other columns aren't read. A compressed stretch of more than MAX_UNPACKED
bytes is not opened (a guard against bombs); its own text still is. Base64 under 16 characters is not decoded.
"""

from __future__ import annotations

import binascii
import bisect
import codecs
import re
import zlib
from collections.abc import Iterator
from hashlib import blake2b, sha256
from html.entities import html5

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession

from seqloom.llm import common

KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")  # a maximal run either way, so the length may be asked for at once
MIN_ASSIGN, MIN_ACCESS = 12, 18
MAX_UNPACKED = 16_000_000
_PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
_ESCAPE = re.compile(r"\\u\{([0-9A-Fa-f]{1,6})\}|\\u([0-9A-Fa-f]{4})|\\x([0-9A-Fa-f]{2})|&#x([0-9A-Fa-f]{1,6});|&#([0-9]{1,7});|&([A-Za-z][A-Za-z0-9]{1,31});")
_BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
_WRAPPED = re.compile(r"[A-Za-z0-9+/_-]{16,}(?:\r?\n[\t ]*[A-Za-z0-9+/_-]+)+={0,2}")
_PACKED = re.compile(rb"\x1f\x8b\x08|\x28\xb5\x2f\xfd|\x78[\x01\x5e\x9c\xda]")
codecs.register_error("stays", lambda e: ("".join(f"%{x:02X}" for x in e.object[e.start : e.end]), e.end))


def scan(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind number) of the secrets of one layer: leftmost, not overlapping within a kind."""
    found = []
    if "=" in text or ":" in text:
        found += [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= MIN_ASSIGN]
    if "AKIA" in text:
        found += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text) if m.end() - m.start() >= MIN_ACCESS]
    found += [(m.start(), m.end(), 2) for m in HEX.finditer(text)]
    return found


class Layer:
    """A text, and the places in the document of its stretches: characters from starts[k] on come from one for one, or all
    from the same span."""

    def __init__(self, text: str, starts: list[int], spans: list[tuple[int, int, bool]]) -> None:
        self.text, self.starts, self.spans = text, starts, spans

    def place(self, start: int, end: int) -> tuple[int, int]:
        a, b = self._one(start), self._one(end - 1)
        return a[0], b[1]

    def _one(self, at: int) -> tuple[int, int]:
        k = bisect.bisect_right(self.starts, at) - 1
        lo, hi, exact = self.spans[k]
        return (lo + at - self.starts[k], lo + at - self.starts[k] + 1) if exact else (lo, hi)


def _replaced(layer: Layer, parts: list[tuple[int, int, str]]) -> Layer:
    """The layer with stretches (start, end) replaced by other text."""
    out, starts, spans, length, at = [], [], [], 0, 0

    def add(text: str, lo: int, hi: int, exact: bool) -> None:
        nonlocal length
        if text:
            starts.append(length)
            spans.append((lo, hi, exact))
            out.append(text)
            length += len(text)

    def copy(lo: int, hi: int) -> None:
        k = bisect.bisect_right(layer.starts, lo) - 1
        while lo < hi:
            end = min(hi, layer.starts[k + 1] if k + 1 < len(layer.starts) else len(layer.text))
            a, b, exact = layer.spans[k]
            first = a + lo - layer.starts[k] if exact else a
            add(layer.text[lo:end], first, first + end - lo if exact else b, exact)
            lo, k = end, k + 1

    for start, end, text in parts:
        copy(at, start)
        add(text, *layer.place(start, end), False)
        at = end
    copy(at, len(layer.text))
    return Layer("".join(out), starts, spans)


def _percent(text: str) -> list[tuple[int, int, str]]:
    found = ((m.start(), m.end(), bytes.fromhex(m[0].replace("%", "")).decode(errors="stays")) for m in _PERCENT.finditer(text))
    return [x for x in found if x[2] != text[x[0] : x[1]]]


def _escapes(text: str) -> list[tuple[int, int, str]]:
    out = []
    for m in _ESCAPE.finditer(text):
        if m[6]:
            plain = html5.get(f"{m[6]};")
        else:
            code = int(m[5]) if m[5] else int(m[1] or m[2] or m[3] or m[4], 16)
            plain = chr(code) if code < 0x110000 and not 0xD800 <= code < 0xE000 else None
        if plain:
            out.append((m.start(), m.end(), plain))
    return out


def _inflated(raw: bytes) -> bytes | None:
    out, size = [], 0
    while raw:
        engine = zlib.decompressobj(47)
        out.append(engine.decompress(raw, MAX_UNPACKED - size + 1))
        size += len(out[-1])
        if not engine.eof or size > MAX_UNPACKED:
            return None
        raw = engine.unused_data
        if raw[:3] != b"\x1f\x8b\x08":
            break  # not another member
    return b"".join(out)


def _unpacked(raw: bytes) -> bytes | None:
    """What raw, which begins as a compressed stream, unpacks to, if it does and within bounds."""
    try:
        if raw[0] != 0x28:
            return _inflated(raw)
        with zstandard.ZstdDecompressor().stream_reader(raw, read_across_frames=True) as reader:
            data = reader.read(MAX_UNPACKED + 1)
        return data if len(data) <= MAX_UNPACKED else None
    except (zlib.error, zstandard.ZstdError):
        return None


def _opened(raw: bytes) -> list[bytes]:
    """raw and all that is compressed in it, at any depth."""
    work, out, seen = [raw], [], set()
    while work:
        data = work.pop()
        mark = blake2b(data, digest_size=16).digest()
        if mark in seen:
            continue
        seen.add(mark)
        out.append(data)
        for m in _PACKED.finditer(data):
            more = _unpacked(data[m.start() :])
            if more:
                work.append(more)
    return out


def _read(raw: bytes) -> str:
    try:
        plain = raw.decode()
        if "\0" not in plain:
            return plain
    except UnicodeDecodeError:
        pass
    for kind, mark, high in (("utf-16-le", b"\xff\xfe", 1), ("utf-16-be", b"\xfe\xff", 0)):
        if raw[:2] == mark or raw[high::2].count(0) > len(raw) // 4:
            return raw.decode(kind, errors="replace")
    return raw.decode("latin-1")


def _base64(text: str) -> list[tuple[int, int, str]]:
    out = []
    stretches = list(_BASE64.finditer(text))
    if stretches and "\n" in text:
        stretches += _WRAPPED.finditer(text)
    for m in stretches:
        body = "".join(m[0].split()).rstrip("=").replace("-", "+").replace("_", "/")
        for at in range(4):
            part = body[at:]
            part = part[: len(part) - (len(part) % 4 == 1)]
            for raw in _opened(binascii.a2b_base64(part + "=" * (-len(part) % 4))):
                out.append((m.start(), m.end(), _read(raw)))
    return out


def find(text: str | None) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans and all spans, each (start, end, kind number) by start, kind, end."""
    text = text or ""
    by = lambda s: (s[0], s[2], s[1])
    base = sorted(scan(text), key=by)
    spans = set(base)
    seen: set[bytes] = set()
    work = [Layer(text, [0], [(0, len(text), True)])]
    while work:
        layer = work.pop()
        known = blake2b(f"{layer.spans[0][0] if layer.spans else 0} {layer.text}".encode("utf-8", "surrogatepass"), digest_size=16).digest()
        if known in seen:
            continue
        seen.add(known)
        if layer.text is not text:
            spans.update((*layer.place(a, b), kind) for a, b, kind in scan(layer.text))
        if "%" in layer.text and (parts := _percent(layer.text)):
            work.append(_replaced(layer, parts))
        if ("\\" in layer.text or "&" in layer.text) and (parts := _escapes(layer.text)):
            work.append(_replaced(layer, parts))
        for start, end, plain in _base64(layer.text):
            work.append(Layer(plain, [0], [(*layer.place(start, end), False)]))
    return base, sorted(spans, key=by)


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in spans)


def report(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans. A map over rows."""
    common.prepare(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, digests, lists = ([], [], []), [], []
            for text in batch.column(1):
                base, spans = find(text.as_py())
                for k in range(3):
                    counts[k].append(sum(s[2] == k for s in base))
                digests.append(sha256(written(base).encode()).hexdigest())
                lists.append(written(spans))
            arrays = [batch.column(0), *[pa.array(c, pa.int64()) for c in counts], pa.array(digests, pa.string()), pa.array(lists, pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
