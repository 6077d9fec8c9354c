"""Secrets in texts, also below layers of encoding.

Patterns are run over a text and then over whatever it unwraps to: URL escapes, Unicode and
character escapes, base64, and compressed data inside base64. A worklist holds the layers still to
be looked at; every unwrapped layer joins it, until none is new. A layer that has been seen with
the same place is not looked at again, which ends cycles. Each character of a layer knows the
characters of the text it comes from, so a hit in any layer is a span of the text.

Escapes are unwrapped line by line with the rest of the line around them, so that a keyword before
an escaped value still counts. Base64 and compressed data are layers of their own. Base64 in lines is
unwrapped line by line and as one run over single line breaks (with indents), from every line that
starts at another place in a group of four. Bytes that are no UTF-8 are kept one by one, and those
with NULs are read as UTF-16 too. Compressed data may have several members.

Defined results: a null text is an empty text without spans. Rows are scanned one by one, repeated
rows alike. An empty table gives an empty table. Compressed data that grows beyond
``MOST_UNPACKED`` bytes is scanned in overlapping windows of about that size, each unwrapped in turn.
A run that is open at the end of a window is held until it ends, so a window has it whole, unless it
grows beyond that size and beyond ``HELD`` times the compressed data. Such a run is cut at a whole group
of base64 digits, with an overlap; so a decompression bomb takes a few windows of memory, and all
of it is scanned. Only compressed data inside such a cut run is read up to the cut. The hits of
a compressed layer map to its whole span.

The worklist is a stack of iterators, each with its next layer at hand; one that has no further layer
is dropped before its last layer is unwrapped, so a long chain of escapes keeps none of its parents.
"""

from __future__ import annotations

import base64
import bz2
import hashlib
import lzma
import re
import zlib
from array import array
from collections.abc import Iterable, Iterator, Sequence

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import (
    ArrayType,
    LongType,
    StringType,
    StructField,
    StructType,
)

from flowloom.llm.batches import map_batches, pieces, tidied

KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    re.IGNORECASE | re.ASCII,
)
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
LEAST_VALUE = 8

PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
ESCAPE = re.compile(
    r"(?:\\u[0-9A-Fa-f]{4}|\\u\{[0-9A-Fa-f]{1,6}\}|\\U[0-9A-Fa-f]{8}|\\x[0-9A-Fa-f]{2}"
    r"|&#x[0-9A-Fa-f]{1,6};|&#[0-9]{1,7};)"
)
LEAST_RUN = 16
DIGITS = re.compile(r"[A-Za-z0-9+/_-]+")
BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}+(?:[ \t]*\r?\n[ \t]*[A-Za-z0-9+/_-]++)*+={0,2}")
LINE_END = re.compile(r"""["'<>)\]},;]?[ \t]*(?:\r?\n|\Z)""")
#: The end, read backwards, of a run of base64 or escapes that may go on.
OPEN_END = re.compile(rb"(?:[A-Za-z0-9+/_.=%\\&#;{}\x00-]++|[ \t]*+\n\r?[ \t]*+)*+")
#: The digits, read backwards, that a run of base64 ends with.
DIGITS_END = re.compile(rb"[A-Za-z0-9+/_-]*+")
MOST_UNPACKED = 4 << 20
HELD = 2
#: Compressed bytes given to a decompressor at once.
FED = 1 << 16
WINDOW_OVERLAP = 4096

Span = tuple[str, int, int]


def matches(text: str) -> Iterator[Span]:
    """Spans of the base patterns: leftmost, not overlapping within a kind."""
    for m in ASSIGN.finditer(text):
        if len(m[2]) >= LEAST_VALUE:
            yield "assign", m.start(), m.end()
    for m in ACCESS.finditer(text):
        yield "access", m.start(), m.end()
    for m in HEX.finditer(text):
        yield "hex", m.start(), m.end()


class Layer:
    """A text and where it comes from: each character, or all of them from one span (none: itself)."""

    def __init__(
        self,
        text: str,
        starts: array | None = None,
        ends: array | None = None,
        whole: tuple[int, int] | None = None,
    ):
        self.text, self.starts, self.ends, self.whole = text, starts, ends, whole

    def origin(self, start: int, end: int) -> tuple[int, int]:
        if self.whole is not None:
            return self.whole
        if self.starts is None:
            return start, end
        return min(self.starts[start:end]), max(self.ends[start:end])

    def key(self) -> tuple[bytes, int, int]:
        digest = hashlib.blake2b(self.text.encode("utf-8", "surrogatepass"), digest_size=16)
        return (digest.digest(), *(self.origin(0, len(self.text)) if self.text else (0, 0)))


def places(values: Iterable[int] = ()) -> array:
    """Places in a text, four bytes each."""
    return array("i", values)


def char_widths(text: str) -> bytes:
    """Bytes of each character in UTF-8; a surrogate stands for one byte that is none."""
    return bytes(
        1 if c < "\x80" or "\ud800" <= c < "\ue000" else 2 if c < "\u0800" else 3 if c < "\U00010000" else 4
        for c in text
    )


def percent_value(m: re.Match) -> list[tuple[str, int, int]] | None:
    """Characters of a run of URL escapes, each with its place in the run."""
    raw = bytes(int(h, 16) for h in m[0][1:].split("%"))
    out, at = [], 0
    text = raw.decode("utf-8", "replace")
    if "\ufffd" in text:
        text = raw.decode("latin-1")
        widths = bytes([1]) * len(raw)
    else:
        widths = char_widths(text)
    for c, w in zip(text, widths, strict=True):
        out.append((c, 3 * at, 3 * (at + w)))
        at += w
    return out


def escape_value(m: re.Match) -> list[tuple[str, int, int]] | None:
    digits = m[0].strip("\\uUx&#{};")
    decimal = m[0].startswith("&#") and m[0][2] not in "xX"
    code = int(digits or "0", 10 if decimal else 16)
    return [(chr(code), 0, len(m[0]))] if code < 0x110000 and not 0xD800 <= code < 0xE000 else None


def unescaped(layer: Layer, pattern: re.Pattern, value) -> Iterator[Layer]:
    """Lines of the layer that hold escapes, with the escapes replaced."""
    text, done = layer.text, 0
    while found := pattern.search(text, done):
        first = text.rfind("\n", 0, found.start()) + 1
        last = text.find("\n", found.end())
        last = len(text) if last < 0 else last
        chars: list[str] = []
        starts, ends = places(), places()

        def copy(a: int, b: int, chars=chars, starts=starts, ends=ends) -> None:
            chars.append(text[a:b])
            if layer.whole is not None:
                return
            starts.extend(layer.starts[a:b] if layer.starts is not None else range(a, b))
            ends.extend(layer.ends[a:b] if layer.ends is not None else range(a + 1, b + 1))

        at, changed = first, False
        for m in pattern.finditer(text, found.start(), last):
            made = value(m)
            if made is None:
                continue
            copy(at, m.start())
            for c, a, b in made:
                chars.append(c)
                if layer.whole is not None:
                    continue
                start, end = layer.origin(m.start() + a, m.start() + b)
                starts.append(start)
                ends.append(end)
            at, changed = m.end(), True
        copy(at, last)
        if changed:
            yield Layer("".join(chars), starts, ends, layer.whole)
        done = last


def decompressor(data: bytes):
    """What decompresses the data, by its first bytes; None when it is not compressed."""
    if data[:2] == b"\x1f\x8b":
        return zlib.decompressobj(31)
    if data[:1] == b"\x78" and len(data) > 1 and (data[0] * 256 + data[1]) % 31 == 0:
        return zlib.decompressobj(15)
    if data[:3] == b"BZh":
        return bz2.BZ2Decompressor()
    if data[:6] == b"\xfd7zXZ\x00":
        return lzma.LZMADecompressor()
    return None


def members(data: bytes, at: int, ends: list[int]) -> Iterator[bytes]:
    """Pieces of what all members from ``at`` on hold; ``ends`` gets where each member ends."""
    while engine := decompressor(data[at : at + 6]):
        try:
            while not engine.eof:
                feed = getattr(engine, "unconsumed_tail", b"")
                if not feed and getattr(engine, "needs_input", True):
                    feed = data[at : at + FED]
                    at += len(feed)
                piece = engine.decompress(feed, MOST_UNPACKED)
                if piece:
                    yield piece
                elif not feed and not engine.eof:
                    return
        except (zlib.error, OSError, EOFError, lzma.LZMAError):
            return
        at -= len(engine.unused_data)
        ends.append(at)
        # Members may have zeros between them.
        while data[at : at + 1] == b"\0":
            at += 1


def inflated(data: bytes, at: int, ends: list[int]) -> Iterator[bytes]:
    """Windows of what compressed data from ``at`` on holds; nothing when it is not compressed."""
    held = max(MOST_UNPACKED, HELD * len(data))
    parts: list[bytes] = []
    size = 0
    for piece in members(data, at, ends):
        parts.append(piece)
        size += len(piece)
        if size < MOST_UNPACKED or (size < held and OPEN_END.fullmatch(piece[::-1])):
            continue
        window = b"".join(parts)
        back = window[::-1]
        tail = OPEN_END.match(back).end()
        if tail < held:
            first = len(window) - tail
            if first:
                yield window[:first]
            rest = window[max(0, first - WINDOW_OVERLAP) :]
        else:
            # The next window begins a group of four digits, if it begins amid digits.
            more = max(0, DIGITS_END.match(back).end() - WINDOW_OVERLAP) % 4
            yield window
            rest = window[-WINDOW_OVERLAP - more :]
        parts, size = [rest], len(rest)
    if window := b"".join(parts):
        yield window


def readable(data: bytes) -> str | None:
    """The bytes as text, if they are text without control characters."""
    try:
        text = data.decode("utf-8")
    except UnicodeDecodeError:
        return None
    return None if any(c < " " and c not in "\t\n\r\f" for c in text) else text


def texts(data: bytes) -> Iterator[tuple[str, bool]]:
    """The bytes as text, with NULs also as UTF-16 (marked so)."""
    yield data.decode("utf-8", "surrogateescape"), False
    if b"\0" in data:
        for name in ("utf-16-le", "utf-16-be"):
            yield data[: len(data) // 2 * 2].decode(name, "surrogatepass"), True


def from_digits(digits: str) -> bytes:
    body = digits.replace("-", "+").replace("_", "/")
    body = body[:-1] if len(body) % 4 == 1 else body
    return base64.b64decode(body + "=" * (-len(body) % 4))


def text_layers(layer: Layer, data: bytes, where: Sequence[int]) -> Iterator[Layer]:
    """Texts of bytes whose base64 characters are at the places ``where``."""
    for text, wide in texts(data):
        if layer.whole is not None:
            yield Layer(text, whole=layer.whole)
            continue
        widths = bytes(4 if c >= "\U00010000" else 2 for c in text) if wide else char_widths(text)
        starts, ends, at = places(), places(), 0
        for w in widths:
            # Byte k lies in the base64 characters from 4k/3 on.
            a = at * 4 // 3
            b = max(a + 1, min(len(where), -(-(at + w) * 4 // 3)))
            start, end = layer.origin(where[a], where[b - 1] + 1)
            starts.append(start)
            ends.append(end)
            at += w
        yield Layer(text, starts, ends)


def layers_of(
    layer: Layer, data: bytes, where: Sequence[int], last: int, lines: Iterable[int] = (0,), whole: int = -1
) -> Iterator[Layer]:
    """Layers in decoded base64; compressed data begins at one of the ``lines`` (places in the run)."""
    if readable(data) is None:
        packed, done = False, 0
        for line in lines:
            at = line * 3 // 4
            # A line amid what an earlier one began is no beginning.
            if at < done or decompressor(data[at : at + 6]) is None:
                continue
            span = layer.origin(where[line], last)
            ends: list[int] = []
            for window in inflated(data, at, ends):
                packed |= line == 0
                for inner, _ in texts(window):
                    yield Layer(inner, whole=span)
            done = max(ends, default=0)
        if packed:
            return
    if data := data if whole < 0 else data[: whole * 3 // 4]:
        yield from text_layers(layer, data, where)


def joined_lines(layer: Layer, begins: array, stops: array, last: int) -> Iterator[Layer]:
    """Layers of base64 that goes on over the lines at those places, up to ``last`` with its padding."""
    digits = "".join(layer.text[a:b] for a, b in zip(begins, stops, strict=True))
    where = places(k for a, b in zip(begins, stops, strict=True) for k in range(a, b))
    lines = places([0])
    for a, b in zip(begins, stops, strict=True):
        lines.append(lines[-1] + b - a)
    lines.pop()
    tail, padded = lines[-1], last > stops[-1]
    # A word that begins the next line of prose is no part of the text.
    sure = padded or LINE_END.match(layer.text, last) is not None
    tried = set()
    for first in lines:
        if first % 4 in tried:
            continue
        tried.add(first % 4)
        whole = -1
        if not sure:
            cut = tail + (first - tail) % 4
            if readable(from_digits(digits[cut:])) is None:
                whole = max(0, tail - first)
        same = places(n - first for n in lines if n >= first and n % 4 == first % 4)
        yield from layers_of(layer, from_digits(digits[first:]), where[first:], last, same, whole)


def decoded(layer: Layer) -> Iterator[Layer]:
    """Layers inside runs of base64, plain or compressed, each line alone and all lines as one."""
    for m in BASE64.finditer(layer.text):
        begins, stops = places(), places()
        for d in DIGITS.finditer(layer.text, m.start(), m.end()):
            begins.append(d.start())
            stops.append(d.end())
        for a, b in zip(begins, stops, strict=True):
            if b - a >= LEAST_RUN and (b - a) % 4 != 1:
                last = m.end() if b == stops[-1] else b
                yield from layers_of(layer, from_digits(layer.text[a:b]), range(a, b), last)
        if len(begins) > 1:
            yield from joined_lines(layer, begins, stops, m.end())


def unwrap(layer: Layer) -> Iterator[Layer]:
    """Layers right below; escapes, which make the longest chains, come last."""
    yield from decoded(layer)
    if "%" in layer.text:
        yield from unescaped(layer, PERCENT, percent_value)
    if "\\" in layer.text or "&#" in layer.text:
        yield from unescaped(layer, ESCAPE, escape_value)


def scan(text: str) -> tuple[list[Span], list[Span]]:
    """(base spans, all spans) of a text, in order of start, then kind."""

    def order(s: Span) -> tuple[int, int, int]:
        return s[1], KINDS.index(s[0]), s[2]

    base = sorted(matches(text), key=order)
    found, seen = set(base), set()
    work: list[tuple[Layer, Iterator[Layer]]] = []

    def add(layers: Iterator[Layer]) -> None:
        if (following := next(layers, None)) is not None:
            work.append((following, layers))

    add(unwrap(Layer(text)))
    while work:
        layer, others = work.pop()
        add(others)
        key = layer.key()
        if key in seen:
            continue
        seen.add(key)
        for kind, start, end in matches(layer.text):
            found.add((kind, *layer.origin(start, end)))
        add(unwrap(layer))
    return base, sorted(found, key=order)


SPAN = ArrayType(
    StructType(
        [
            StructField("kind", StringType()),
            StructField("start", LongType()),
            StructField("end", LongType()),
        ]
    )
)
SCANNED = StructType(
    [StructField("doc_id", LongType()), StructField("base", SPAN), StructField("spans", SPAN)]
)


def _struct(spans: list[Span]) -> list[dict]:
    return [{"kind": k, "start": s, "end": e} for k, s, e in spans]


def secret_spans(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, base, spans): arrays of (kind, start, end) in code points, end exclusive."""

    def run(batch):
        found = [scan(t or "") for t in batch.column("text").to_pylist()]
        return {
            "doc_id": batch.column("doc_id"),
            "base": [_struct(b) for b, _ in found],
            "spans": [_struct(s) for _, s in found],
        }

    source = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return map_batches(source, "text", run, SCANNED)


def masked(text: str, spans: list[Span], mark: str = "[secret]") -> str:
    """The text with every span, overlapping ones joined, replaced by a mark."""
    out, at = [], 0
    for _, start, end in spans:
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join([*out, text[at:]])


def mask_secrets(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with secrets masked in the text, and ``n_chars`` counted again where it exists."""
    schema = docs.schema

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for piece in pieces(batch, text):
                made = []
                for t in piece.column(text).to_pylist():
                    spans = scan(t)[1] if t else []
                    made.append(masked(t, spans) if spans else t)
                at = piece.schema.get_field_index(text)
                yield piece.set_column(at, piece.schema.field(at), pa.array(made, pa.string()))

    out = docs.mapInArrow(tidied(run), schema)
    if "n_chars" in docs.columns:
        kind = schema["n_chars"].dataType
        return out.withColumn("n_chars", F.length(F.coalesce(F.col(text), F.lit(""))).cast(kind))
    return out
