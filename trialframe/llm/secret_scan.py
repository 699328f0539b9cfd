"""Secrets in plain and encoded text: a worklist of layers, unwrapped until nothing new appears."""

from __future__ import annotations

import base64
import binascii
import bz2
import hashlib
import html
import lzma
import re
import zlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, text_of

# fixed values: the kinds in their order and what each must match
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ASSIGN_HINTS = ("passw", "secret", "token", "apikey", "api_key")
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
# encoded forms
PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
ESCAPED = re.compile(r"(?:\\u[0-9A-Fa-f]{4})+|\\U[0-9A-Fa-f]{8}|(?:\\x[0-9A-Fa-f]{2})+|&#[0-9]{1,7};|&#[xX][0-9A-Fa-f]{1,6};")
BLOB = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
WRAPPED = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}+(?:[ \t]*\r?\n[ \t]*[A-Za-z0-9+/_-]+)+={0,2}")
PART = re.compile(r"[A-Za-z0-9+/_-]+")
MAGIC = re.compile(rb"\x1f\x8b\x08|\x78[\x01\x5e\x9c\xda]|BZh[1-9]|\xfd7zXZ\x00")
READABLE = re.compile(rb"[\t\n\r\x20-\x7e]{12,}")  # the shortest secret has 12 characters
MAX_LAYER_BYTES = 1 << 26
OVERLAP_BYTES = 1 << 20


def _escape_style(mark: str, byte, token: str) -> tuple[str, re.Pattern, re.Pattern]:
    """An escape style: its mark, a pattern of the first bytes of compressed streams and one of a single byte."""
    one = lambda b: f"(?:{byte(b)}" + (f"|{re.escape(chr(b))}" if b > 32 else "") + ")"
    word = lambda bs: "".join(map(one, bs))
    starts = [word(b"\x1f\x8b\x08"), word(b"x") + "(?:" + "|".join(map(one, b"\x01\x5e\x9c\xda")) + ")", word(b"BZh") + "(?:" + "|".join(map(one, b"123456789")) + ")", word(b"\xfd7zXZ\x00")]
    return mark, re.compile("|".join(starts)), re.compile(f"{token}|[\\x20-\\xff]")


STYLES = (
    _escape_style("%", lambda b: f"(?i:%{b:02x})", r"%([0-9A-Fa-f]{2})"),
    _escape_style("\\", lambda b: rf"(?i:\\x{b:02x}|\\u00{b:02x})", r"\\(?:x|u00)([0-9A-Fa-f]{2})|\\[abfnrtv0\\'\"/]"),
    _escape_style("&#", lambda b: rf"(?i:&#0*{b};|&#x0*{b:x};)", r"&#[xX]0*([0-9A-Fa-f]{1,2});|&#[0-9]{1,7};|&(?:amp|lt|gt|quot);"),
)
SHORT = dict(zip("abfnrtv0", b"\a\b\f\n\r\t\v\0", strict=True))

SCHEMA = "id long, kinds array<string>, starts array<long>, ends array<long>, layers array<int>, n_oversized long"


def base_spans(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) of the plain matches, leftmost and non-overlapping per kind."""
    out = []
    low = text.lower()
    if any(h in low for h in ASSIGN_HINTS):
        out += [(m.start(), "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), "access", m.end()) for m in ACCESS.finditer(text)]
    return out + [(m.start(), "hex", m.end()) for m in HEX.finditer(text)]


def _unescape(found: str) -> str:
    if found[0] == "&":
        return html.unescape(found)
    if found[1] == "u":
        units = bytes.fromhex("".join(found.split("\\u")))
        return units.decode("utf-16-be", "replace")
    if found[1] == "U":
        code = int(found[2:], 16)
        return chr(code) if code < 0x110000 and not 0xD800 <= code < 0xE000 else "�"
    return bytes.fromhex("".join(found.split("\\x"))).decode("utf-8", "replace")


def _unpercent(found: str) -> str:
    return bytes.fromhex("".join(found.split("%"))).decode("utf-8", "replace")


class Layer:
    """A text and where its characters come from: [lo[i], hi[i]) of the document, or one span for all of them."""

    def __init__(self, text: str, depth: int, lo=None, hi=None, whole: tuple[int, int] | None = None):
        self.text, self.depth, self.lo, self.hi, self.whole = text, depth, lo, hi, whole

    def origin(self, start: int, end: int) -> tuple[int, int]:
        if self.whole:
            return self.whole
        if self.lo is None:
            return start, end
        return self.lo[start], self.hi[end - 1]


class Stream:
    """A compressed stream too long for one layer, of one span of the document: read in windows."""

    def __init__(self, data: bytes, depth: int, whole: tuple[int, int]):
        self.data, self.depth, self.whole = data, depth, whole

    def layers(self, size: int):
        """Its text in layers of about ``size`` bytes, each with the end of the one before it."""
        kept, wide = b"", None
        overlap = min(OVERLAP_BYTES, size // 2 & ~1)
        for part in _parts(self.data, size):
            kept += part
            if len(kept) >= size:
                wide = _wide(kept) if wide is None else wide
                yield Layer(_stream_text(kept, wide), self.depth, whole=self.whole)
                kept = kept[len(kept) - overlap - len(kept) % 2 :]
        if kept:
            yield Layer(_stream_text(kept, wide if wide is not None else _wide(kept)), self.depth, whole=self.whole)


def _rewritten(layer: Layer, pattern: re.Pattern, decode) -> Layer | None:
    """The whole layer with every match decoded, so that secrets crossing an encoded part are seen."""
    text, parts, lo, hi, at = layer.text, [], [], [], 0
    for m in pattern.finditer(text):
        plain = decode(m[0])
        s, e = layer.origin(m.start(), m.end())
        for i in range(at, m.start()):
            a, b = layer.origin(i, i + 1)
            lo.append(a)
            hi.append(b)
        parts += [text[at:m.start()], plain]
        lo += [s] * len(plain)
        hi += [e] * len(plain)
        at = m.end()
    if not parts:
        return None
    for i in range(at, len(text)):
        a, b = layer.origin(i, i + 1)
        lo.append(a)
        hi.append(b)
    return Layer("".join([*parts, text[at:]]), layer.depth + 1, lo, hi)


def _engine(data: bytes):
    if data[:2] == b"\x1f\x8b" or (data[:1] == b"\x78" and len(data) > 1 and (data[0] * 256 + data[1]) % 31 == 0):
        return zlib.decompressobj(47)
    if data[:3] == b"BZh":
        return bz2.BZ2Decompressor()
    return lzma.LZMADecompressor() if data[:6] == b"\xfd7zXZ\x00" else None


def _inflated(data: bytes, limit: int) -> tuple[bytes | None, bool]:
    """The decompressed bytes of all members, if ``data`` is a compressed stream, and whether they are more than ``limit``."""
    out, size = [], 0
    while engine := _engine(data):
        try:
            out.append(engine.decompress(data, limit + 1 - size))
        except (zlib.error, OSError, lzma.LZMAError, EOFError):
            break
        size += len(out[-1])
        if size > limit:
            return None, True
        if not engine.eof:
            break
        data = engine.unused_data.lstrip(b"\0")  # padding between members
    return (b"".join(out) if out else None), False


def _parts(data: bytes, size: int):
    """The decompressed bytes of all members, at most ``size`` at a time."""
    while engine := _engine(data):
        left = data
        try:
            while True:
                part = engine.decompress(left, size)
                if part:
                    yield part
                left = getattr(engine, "unconsumed_tail", b"")
                if engine.eof or not (part or left):
                    break
        except (zlib.error, OSError, lzma.LZMAError, EOFError):
            return
        data = engine.unused_data.lstrip(b"\0") if engine.eof else b""


def _wide(data: bytes) -> str:
    """The UTF-16 codec whose text ``data`` looks like, by its mark or by the zeros of ASCII characters, else nothing."""
    if data[:2] in (b"\xff\xfe", b"\xfe\xff"):
        return "utf-16-le" if data[:1] == b"\xff" else "utf-16-be"
    low, high = data[0:4096:2], data[1:4096:2]
    if len(high) >= 4:
        for codec, zeros, others in (("utf-16-le", high, low), ("utf-16-be", low, high)):
            if zeros.count(0) >= 0.6 * len(zeros) and others.count(0) <= 0.1 * len(others):
                return codec
    return ""


def _stream_text(data: bytes, wide: str | None = None) -> str:
    """What a stream that has been inflated says: bytes that are no text in it don't hide the rest. What looks like UTF-16
    is read as both."""
    codec, text = _wide(data) if wide is None else wide, data.decode("utf-8", "replace")
    return f"{data.decode(codec, 'replace')}\n{text}" if codec else text


def _text(data: bytes) -> str | None:
    try:
        text = data.decode("utf-8")
    except UnicodeDecodeError:
        return None
    return None if any(ord(c) < 32 and c not in "\t\n\r\x0b\x0c" for c in text) else text


def _unpacked(data: bytes, limit: int) -> tuple[bytes, bool, int]:
    """``data`` without its compression, whether it had one, and the streams left packed."""
    passed: list[bytes] = []
    while True:  # compressed streams may hold compressed streams, or themselves
        inner, large = _inflated(data, limit)
        if inner is None or inner in passed:
            return data, bool(passed), int(large)
        passed.append(data)
        data = inner


def _blobs(text: str):
    """(body, the place of each of its characters): base64 in one line, and over line breaks.

    Wrapped lines are of one length but for the last: such a stretch is a body with and without the line after it, since
    that may be prose. All lines together are one too.
    """
    for m in BLOB.finditer(text):
        body = m[0].rstrip("=")
        yield body, range(m.start(), m.start() + len(body))
    for m in WRAPPED.finditer(text):
        lines = [(x.start(), x.end()) for x in PART.finditer(text, m.start(), m.end())]
        cuts, at = {(0, len(lines))}, 0
        while at < len(lines):
            width, end = lines[at][1] - lines[at][0], at + 1
            while end < len(lines) and lines[end][1] - lines[end][0] == width:
                end += 1
            cuts |= {(at, end)} | ({(at, end + 1)} if end < len(lines) and lines[end][1] - lines[end][0] < width else set())
            at = end
        for i, j in sorted(cuts):
            if j - i > 1:
                yield "".join(text[a:b] for a, b in lines[i:j]), [p for a, b in lines[i:j] for p in range(a, b)]


def _decoded(body: str) -> bytes | None:
    body = body[: len(body) - (len(body) % 4 == 1)]
    try:
        return base64.b64decode(body.replace("-", "+").replace("_", "/") + "=" * (-len(body) % 4))
    except (binascii.Error, ValueError):
        return None


def _unblobbed(layer: Layer, limit: int) -> tuple[list[Layer], int]:
    out, oversized = [], 0

    def add(text: str, skip: int, byte: int) -> None:
        """A text that starts at a byte of what is decoded from the body's character ``skip`` on."""
        lo, hi = [], []
        for c in text:
            size = len(c.encode())
            first, last = skip + byte * 4 // 3, min(skip - (-(byte + size) * 4 // 3), len(places)) - 1
            lo.append(layer.origin(places[first], places[first] + 1)[0])
            hi.append(layer.origin(places[last], places[last] + 1)[1])
            byte += size
        out.append(Layer(text, layer.depth + 1, whole=span) if layer.whole else Layer(text, layer.depth + 1, lo, hi))

    for body, places in _blobs(layer.text):
        span = layer.origin(places[0], places[-1] + 1)
        data = _decoded(body)
        if data is None:
            continue
        if len(body) % 4 != 1:
            plain, packed, large = _unpacked(data, limit)
            if large or packed:
                oversized += large
                out.append(Stream(plain, layer.depth + 1, span) if large else Layer(_stream_text(plain), layer.depth + 1, whole=span))
                continue
            if text := _text(plain):
                add(text, 0, 0)
                continue
            if codec := _wide(plain):
                out.append(Layer(plain.decode(codec, "replace"), layer.depth + 1, whole=span))
        for skip in range(4):  # something else stands before or behind the encoded part
            data = _decoded(body[skip:]) or b""
            for m in READABLE.finditer(data):
                add(m[0].decode(), skip, m.start())
            for m in MAGIC.finditer(data):
                plain, packed, large = _unpacked(data[m.start() :], limit)
                oversized += large
                if large:
                    out.append(Stream(plain, layer.depth + 1, span))
                elif packed:
                    out.append(Layer(_stream_text(plain), layer.depth + 1, whole=span))
    return out, oversized


def _unescaped_streams(layer: Layer, limit: int) -> tuple[list[Layer], int]:
    """Compressed streams whose bytes are written as escapes, with printable bytes as they are."""
    out, oversized, text = [], 0, layer.text
    for mark, start, token in STYLES:
        if mark not in text:
            continue
        for m in start.finditer(text):
            data, at = bytearray(), m.start()
            while t := token.match(text, at):
                found = t[0]
                if t[1]:
                    data.append(int(t[1], 16))
                elif len(found) == 1:
                    data.append(ord(found))
                elif found[0] == "\\":
                    data.append(SHORT.get(found[1], ord(found[1])))
                elif found[1] == "#":
                    if int(found[2:-1]) > 255:
                        break
                    data.append(int(found[2:-1]))
                else:
                    data += html.unescape(found).encode()
                at = t.end()
                if len(data) == 64 and _inflated(bytes(data), limit)[0] is None:
                    break
            plain, packed, large = _unpacked(bytes(data), limit)
            oversized += large
            if large:
                out.append(Stream(plain, layer.depth + 1, layer.origin(m.start(), at)))
            elif packed:
                out.append(Layer(_stream_text(plain), layer.depth + 1, whole=layer.origin(m.start(), at)))
    return out, oversized


def scan(text: str, limit: int = MAX_LAYER_BYTES) -> tuple[list[tuple[int, str, int, int]], int]:
    """All spans (start, kind, end, depth of the first layer showing it), sorted, and the streams read in windows for size."""
    found: dict[tuple[int, str, int], int] = {}
    seen: set[bytes] = set()
    oversized = 0

    def drain(work: list) -> None:
        nonlocal oversized
        while work:
            layer = work.pop()
            if isinstance(layer, Stream):  # a window at a time, with all that is inside it
                mark = hashlib.blake2b(layer.data + repr(layer.whole).encode(), digest_size=16).digest()
                if mark not in seen:
                    seen.add(mark)
                    for window in layer.layers(limit):
                        drain([window])
                continue
            mark = hashlib.blake2b(layer.text.encode("utf-8", "surrogatepass") + repr(layer.whole or (layer.lo or [0])[:1]).encode(), digest_size=16).digest() if layer.depth else b""
            if mark in seen:  # a cycle, or the same text from the same place
                continue
            seen.add(mark)
            for s, kind, e in base_spans(layer.text):
                a, b = layer.origin(s, e)
                found[a, kind, b] = min(found.get((a, kind, b), layer.depth), layer.depth)
            if "%" in layer.text and (new := _rewritten(layer, PERCENT, _unpercent)):
                work.append(new)
            if ("\\" in layer.text or "&#" in layer.text) and (new := _rewritten(layer, ESCAPED, _unescape)):
                work.append(new)
            for unwrap in (_unblobbed, _unescaped_streams):
                new, large = unwrap(layer, limit)
                work += new
                oversized += large

    drain([Layer(text, 0)])
    order = {k: i for i, k in enumerate(KINDS)}
    return sorted(((a, k, b, d) for (a, k, b), d in found.items()), key=lambda x: (x[0], order[x[1]], x[2])), oversized


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = MAX_LAYER_BYTES) -> DataFrame:
    """Per row: ``id`` and the arrays ``kinds``, ``starts``, ``ends``, ``layers`` of its secrets, in code points.

    Layer 0 is the text itself. URL escapes, Unicode and HTML escapes, base64 (also over line breaks, or with something
    else before it) and compressed streams of any number of members inside base64 or escapes are unwrapped until no new
    layer appears; a layer seen before at the same place ends its branch. Spans of inner layers
    are those of the encoded characters in the document. Null counts as empty; repeated rows are scanned each; other
    columns are not read. A compressed stream of more than ``limit`` bytes stays packed and is counted in
    ``n_oversized``. Map-only: no shuffle, no state between rows.
    """

    def start():
        def step(cols):
            ids, texts = cols["id"], cols["text"]
            out = [scan(t, limit) for t in texts]
            spans = [s for s, _ in out]
            return {
                "id": ids, "kinds": [[k for _, k, _, _ in s] for s in spans], "starts": [[a for a, _, _, _ in s] for s in spans],
                "ends": [[b for _, _, b, _ in s] for s in spans], "layers": [[d for _, _, _, d in s] for s in spans], "n_oversized": [n for _, n in out],
            }

        return step

    return map_batches(docs.select(F.col(id_col).cast("long").alias("id"), text_of(text_col).alias("text")), start, SCHEMA)
