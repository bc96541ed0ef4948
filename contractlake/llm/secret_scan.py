"""Secret scan with a recursive decoding worklist.

Three kinds of secrets are looked for in every text and in every layer that can be unwrapped from it: percent-encoded (URL) and
escaped (Unicode) characters, base64 runs, also over several lines or behind other characters of their class, and gzip or zlib data
inside those. Bytes that are no text become U+FFFD, the rest is read. A layer that was unwrapped goes on the worklist and is
scanned and unwrapped in turn, until no new layer turns up; a layer that repeats one seen before in the same document ends its
branch, so cycles end too. Each character of a layer knows the span of the original text that it came from; a match in a layer is
given as the span of the original characters it rests on. Spans count code points, end exclusive.

Compressed data of any size is inflated in stretches of some megabytes that overlap; each stretch is a layer whose characters all rest on the whole of the packed data, so it
holds one span and not one for each character. A stretch begins where the base64 run that reaches into it begins, up to 16 MB before it; runs of 1,024 spaces and more count as one
space there. All members of concatenated gzip data are read, behind whatever bytes they stand, in each kind of run.

Null text: empty, no spans. Texts of any length are read whole. One span found on several ways counts once. Repeated rows give equal results each; equal spans are ordered by kind.
Input columns that carry the name of a new column are replaced, all others are kept, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .frames import arrow_columns

# Kinds, their patterns, and the length that makes a match count.
KINDS = ("assign", "access", "hex")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")
_ASSIGN_VALUE = 6
_ASSIGN_WORDS = ("passw", "secret", "token", "apikey", "api_key")

_PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
_ESCAPE = re.compile(r"(?:\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8}|\\u\{[0-9A-Fa-f]{1,6}\}|\\x[0-9A-Fa-f]{2}|&#x[0-9A-Fa-f]{1,6};|&#[0-9]{1,7};)+")
_ESCAPE_ONE = re.compile(r"\\u\{([0-9A-Fa-f]+)\}|\\[uUx]([0-9A-Fa-f]+)|&#x([0-9A-Fa-f]+);|&#([0-9]+);")
LEAST_RUN = 16
_BREAK = r"(?:\r?\n|\r|(?:\\r)?\\n)[ \t]*"
_BASE64 = re.compile(rf"[A-Za-z0-9+/_-]{{16,}}(?:{_BREAK}[A-Za-z0-9+/_-]+)*={{0,2}}")
_SEAM = re.compile(_BREAK)
_LINE_END = re.compile(rf"=|[ \t]*(?:{_BREAK}|$)|[\"'`<]")
_URL_SAFE = str.maketrans("-_", "+/")
_CONTROL = re.compile(r"[\x00-\x08\x0e-\x1f\x7f]")
_BROKEN = re.compile("[\udc80-\udcff]")
# The shortest secret, or layer that holds one, is a longer stretch of such bytes.
_READABLE = re.compile(rb"[\t\n\r\x20-\x7e]{12}")
_PACK = re.compile(rb"\x1f\x8b\x08|\x78[\x01\x5e\x9c\xda]")
_PACKED = (b"\x1f\x8b", b"\x78\x01", b"\x78\x5e", b"\x78\x9c", b"\x78\xda")
_GAP = re.compile(" {1024,}")
_RUN_CHARACTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-=\r\n"
# Bytes of inflated data in a stretch, characters that a stretch shares with the one before, at least and for a base64 run.
STRETCH = 8 << 20
OVERLAP = 1 << 16
RUN_OVERLAP = 16 << 20
_BLOCK, _PIECE = 1 << 16, 1 << 20


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the secrets in plain text, leftmost and non-overlapping within each kind, in order."""
    found = []
    lowered = text.lower()
    if any(word in lowered for word in _ASSIGN_WORDS):
        found += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= _ASSIGN_VALUE]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(found)


@dataclass
class Layer:
    """A decoded text; character i came from starts[i]:ends[i] of the original."""
    text: str
    starts: np.ndarray
    ends: np.ndarray


class _Inflated:
    """Pieces of what gzip or zlib data unpacks to, up to the first broken byte; `used` is the place behind the data once all pieces are read."""

    def __init__(self, data: bytes, at: int):
        self.data, self.used = data, at

    def __iter__(self) -> Iterator[bytes]:
        reader, data = zlib.decompressobj(47), memoryview(self.data)  # gzip or zlib, by its header
        while self.used < len(data) and not reader.eof:
            block, before = data[self.used:self.used + _BLOCK], reader.copy()
            done = 0
            try:
                for piece in self._feed(reader, block):
                    done += len(piece)
                    yield piece
            except zlib.error:  # byte by byte, so that what comes before the broken one is kept
                reader = before
                yield from self._up_to_the_broken_byte(reader, block, done)
                self.used = len(data)
                return
            self.used += len(block) - len(reader.unused_data)

    @staticmethod
    def _feed(reader, block) -> Iterator[bytes]:
        while True:
            piece = reader.decompress(block, _PIECE)
            if piece:
                yield piece
            block = reader.unconsumed_tail
            if reader.eof or not block and len(piece) < _PIECE:
                return

    def _up_to_the_broken_byte(self, reader, block, given: int) -> Iterator[bytes]:
        for k in range(len(block)):
            try:
                for piece in self._feed(reader, block[k:k + 1]):
                    yield piece[given:]
                    given = max(0, given - len(piece))
            except zlib.error:
                return


def _packs(data: bytes) -> Iterator[tuple[int, int]]:
    """Places from:to of compressed data among the bytes; such that begins them, or that holds readable text."""
    at = 0
    while found := _PACK.search(data, at):
        at, inflated, readable, size, tail = found.start() + 1, _Inflated(data, found.start()), False, 0, b""
        for piece in inflated:
            readable = readable or bool(_READABLE.search(tail + piece))
            size, tail = size + len(piece), piece[-16:]
        if size and (readable or not found.start()):
            yield found.start(), inflated.used
            at = max(at, inflated.used)


def _stretches(pieces) -> Iterator[str]:
    """The text of inflated pieces in overlapping parts."""
    carry, held, size = "", [], 0

    def text_of(data: bytes) -> str:
        nonlocal carry
        text = _GAP.sub(" ", carry + _text(data)[0])
        keep = max(OVERLAP, min(len(text) - len(text.rstrip(_RUN_CHARACTERS)), RUN_OVERLAP))
        carry = text[-keep:]
        return text

    for piece in pieces:
        held.append(piece)
        size += len(piece)
        if size >= STRETCH:
            data = b"".join(held)
            # a character that is not complete waits for its other bytes
            cut = next((k for k in range(1, 4) if data[-k] >= 0xC0), 0)
            yield text_of(data[:len(data) - cut])
            held, size = [data[len(data) - cut:]], cut
    if size:
        yield text_of(b"".join(held))


def _text(data: bytes) -> tuple[str, np.ndarray]:
    """Text of the bytes with U+FFFD for each byte that is not UTF-8, and how many bytes each character takes."""
    text = data.decode(errors="surrogateescape")
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    broken = (points >= 0xDC80) & (points <= 0xDCFF)
    if broken.any():
        text = _BROKEN.sub("\ufffd", text)
    return text, np.where(broken, 1, 1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF))


def _clean(data: bytes) -> bool:
    try:
        return bool(data) and not _CONTROL.search(data.decode())
    except UnicodeDecodeError:
        return False


def _replaced(layer: Layer, parts: list[tuple[int, int, str, np.ndarray, np.ndarray]]) -> Layer:
    """The layer with the ranges from:to replaced by texts; of each new character the range of the layer's characters is given."""
    texts, starts, ends, at = [], [], [], 0
    one = layer.starts.strides == (0,)
    for a, b, text, low, high in parts:
        texts += [layer.text[at:a], text]
        if not one:
            starts += [layer.starts[at:a], layer.starts[low]]
            ends += [layer.ends[at:a], layer.ends[high - 1]]
        at = b
    whole = "".join([*texts, layer.text[at:]])
    if one:
        return _whole(layer, 0, 1, whole)
    return Layer(whole, np.concatenate([*starts, layer.starts[at:]]), np.concatenate([*ends, layer.ends[at:]]))


def _whole(layer: Layer, a: int, b: int, text: str) -> Layer:
    """A text that rests on all of the layer's range a:b: one span, seen from every character."""
    return Layer(text, np.broadcast_to(layer.starts[a], len(text)), np.broadcast_to(layer.ends[b - 1], len(text)))


def _unpacked(layer: Layer, a: int, b: int, data: bytes, at: int) -> Iterator[Layer]:
    """Layers of compressed data at a place of the bytes that the layer's range a:b holds."""
    return (_whole(layer, a, b, text) for text in _stretches(_Inflated(data, at)))


def _percent(layer: Layer) -> Iterator[Layer]:
    parts = []
    for m in _PERCENT.finditer(layer.text):
        data = binascii.unhexlify(m[0].replace("%", ""))
        whole = False
        for low, used in _packs(data):
            whole = whole or (low, used) == (0, len(data))
            yield from _unpacked(layer, m.start() + 3 * low, m.start() + 3 * used, data, low)
        if not whole:
            text, sizes = _text(data)
            high = m.start() + 3 * np.cumsum(sizes)
            parts.append((m.start(), m.end(), text, np.append(m.start(), high[:-1]), high))
    if parts:
        yield _replaced(layer, parts)


def _escapes(layer: Layer) -> Iterator[Layer]:
    parts = []
    for m in _ESCAPE.finditer(layer.text):
        chars, low, high = [], [], []
        for one in _ESCAPE_ONE.finditer(m[0]):
            digits = one[1] or one[2] or one[3]
            value = int(digits, 16) if digits else int(one[4])
            if 0xDC00 <= value < 0xE000 and chars and 0xD800 <= chars[-1] < 0xDC00:  # second half of a pair
                chars[-1] = 0x10000 + ((chars[-1] - 0xD800) << 10) + value - 0xDC00
                high[-1] = m.start() + one.end()
                continue
            chars.append(value if value < 0x110000 else 0xFFFD)
            low.append(m.start() + one.start())
            high.append(m.start() + one.end())
        whole = False
        if all(c < 256 for c in chars):
            data = bytes(chars)
            for first, used in _packs(data):
                whole = whole or (first, used) == (0, len(data))
                yield from _unpacked(layer, low[first], high[used - 1], data, first)
        if not whole:
            text = "".join(chr(c if not 0xD800 <= c < 0xE000 else 0xFFFD) for c in chars)
            parts.append((m.start(), m.end(), text, np.array(low), np.array(high)))
    if parts:
        yield _replaced(layer, parts)


def _blocks(text: str, m: re.Match) -> list[list[tuple[int, int]]]:
    """The runs of a match, as blocks of those that are lines of one wrapped run.

    Lines of one run are equally long, the last one may be shorter and has nothing behind it; the first one may begin inside its line.
    """
    stop, at, runs = m.start() + len(m[0].rstrip("=")), m.start(), []
    for seam in _SEAM.finditer(text, at, stop):
        runs.append((at, seam.start()))
        at = seam.end()
    runs.append((at, stop))
    blocks, k = [], 0
    while k < len(runs):
        block, size = [runs[k]], runs[k][1] - runs[k][0]
        inside = k == 0 and m.start() > 0 and text[m.start() - 1] not in "\r\n"
        k += 1
        while k < len(runs):
            own = runs[k][1] - runs[k][0]
            if inside and len(block) == 1 and own >= LEAST_RUN:
                size = own
            if own > size or own < size and not _LINE_END.match(text, runs[k][1]):
                break
            block.append(runs[k])
            k += 1
            if own < size:
                break
        blocks.append(block)
    return blocks


def _base64(layer: Layer) -> Iterator[Layer]:
    for m in _BASE64.finditer(layer.text):
        blocks = _blocks(layer.text, m)
        for block in blocks:
            yield from _decoded(layer, block, m.end() if block is blocks[-1] else block[-1][1])


def _decoded(layer: Layer, block: list[tuple[int, int]], end: int) -> Iterator[Layer]:
    """Layers of a run that may stand in several lines.

    A run that is readable as a whole is one layer. In any other one a layer may begin behind characters that don't belong to it, so it is decoded from
    each of the first four places, and what can be read of that, or be unpacked, is kept. A short last line with unreadable bytes is text below the run.
    """
    run = "".join(layer.text[a:b] for a, b in block).translate(_URL_SAFE)
    if len(run) < LEAST_RUN:
        return
    place = np.concatenate([np.arange(a, b) for a, b in block])
    last = block[-1][1] - block[-1][0]
    for phase in range(4):
        own = run[phase:]
        own = own[:len(own) - (len(own) % 4 == 1)]
        data = base64.b64decode(own + "=" * (-len(own) % 4))
        if len(block) > 1 and last < LEAST_RUN and not _PACK.search(data) and not _clean(data[-(-(len(run) - last - phase) * 3 // 4):]):
            # the last line is no part of it
            own = run[phase:len(run) - last]
            own = own[:len(own) - (len(own) % 4 == 1)]
            data = base64.b64decode(own + "=" * (-len(own) % 4))
        readable = not data.startswith(_PACKED) and _clean(data)
        if not readable and not _READABLE.search(data) and not _PACK.search(data):
            continue
        at = place[phase:phase + len(own)]
        whole = False
        for low, used in () if readable else _packs(data):
            high = end if used == len(data) and len(own) == len(run) - phase else int(at[min(-(-used * 4 // 3), len(at)) - 1]) + 1
            yield from _unpacked(layer, int(at[low * 4 // 3]), high, data, low)
            whole = whole or low == phase == 0
        if not whole and (readable or _READABLE.search(data)):
            text, sizes = _text(data)
            after = np.cumsum(sizes)
            low = np.append(0, after[:-1]) * 4 // 3
            high = np.minimum(-(-after * 4 // 3), len(at))
            yield Layer(text, layer.starts[at[low]], layer.ends[at[high - 1]])
        if phase == 0 and (readable and len(own) == len(run) or whole):
            break


def _opened(layer: Layer) -> Iterator[Layer]:
    text = layer.text
    if "%" in text:
        yield from _percent(layer)
    if "\\" in text or "&#" in text:
        yield from _escapes(layer)
    yield from _base64(layer)


def all_spans(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Base spans and those found in unwrapped layers, in order."""
    places = np.arange(len(text) + 1)
    work = [_opened(Layer(text, places[:-1], places[1:]))]
    seen, spans = set(), set(base)
    while work:  # one layer of each depth is held
        layer = next(work[-1], None)
        if layer is None:
            work.pop()
            continue
        if layer.text == text or not layer.text:
            continue
        key = (hashlib.blake2b(layer.text.encode(errors="surrogatepass"), digest_size=16).digest(), int(layer.starts[0]), int(layer.ends[-1]))
        if key in seen:
            continue
        seen.add(key)
        spans.update((int(layer.starts[a]), kind, int(layer.ends[b - 1])) for a, kind, b in base_spans(layer.text))
        work.append(_opened(layer))
    return sorted(spans)


def spans_text(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{a}:{b}" for a, kind, b in spans)


def masked(text: str, spans: list[tuple[int, int, int]], mask: str = "[SECRET]") -> str:
    """text with every span replaced; overlapping spans become one."""
    out, at = [], 0
    for a, _, b in spans:
        if a >= at:
            out += [text[at:a], mask]
        at = max(at, b)
    return "".join([*out, text[at:]]) if spans else text


COLUMNS = (("base_spans", "string"), ("spans", "string"), ("n_assign", "bigint"), ("n_access", "bigint"), ("n_hex", "bigint"), ("base_sha256", "string"))


def with_spans(docs: DataFrame, mask: bool = False) -> DataFrame:
    """docs with `COLUMNS`: base spans, all spans, base counts by kind, and the digest of the base spans.

    With mask, `text` is replaced by the text without its secrets (null stays null).
    """
    def setup():
        def work(batch):
            texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
            base = [base_spans(t or "") for t in texts]
            full = [all_spans(t or "", b) for t, b in zip(texts, base)]
            named = [spans_text(b) for b in base]
            out = [pa.array(named, pa.string()), pa.array([spans_text(s) for s in full], pa.string())]
            out += [pa.array([sum(k == kind for _, k, _ in b) for b in base], pa.int64()) for kind in range(len(KINDS))]
            out.append(pa.array([hashlib.sha256(n.encode()).hexdigest() for n in named], pa.string()))
            if mask:
                out.append(pa.array([t if t is None else masked(t, s) for t, s in zip(texts, full)], pa.string()))
            return out
        return work
    held = "_" * max(len(c) for c in docs.columns) + "_masked"  # longer than any name of an input column
    found = arrow_columns(docs, [*COLUMNS, *([(held, "string")] if mask else [])], setup)
    return found.withColumn("text", found[held]).drop(held) if mask else found
