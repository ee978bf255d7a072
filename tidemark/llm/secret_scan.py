"""Secret scans (operator 4): a recursive decoding worklist.

The text is layer 0. Every layer is scanned for secrets and for encoded parts, and each encoded
part is a new layer on the worklist until none is left:

- URL and Unicode escapes are replaced in place, all at once, in the stretch of text around them
  that a secret could reach. An escape that yields the sign that leads the next one (``%2525…``) is
  followed on the spot: what stands between is a part of what was scanned before. Escapes that
  come to light so are replaced round by round, and only what stands around the changed
  characters is scanned again.
- Base64 runs, also those folded over lines, are decoded at each of the four places where they may
  begin, since a run may be glued to what stands before it.
- Compressed data (gzip, zlib, bzip2, xz), wherever it begins in a decoded layer or a base64 run, is
  inflated, all its members, as often as it holds compressed data again. It is read as a stream, in
  windows that end where no secret can stand, so memory is bounded and nothing is left out.

Decoded layers are read as bytes, one character each: secrets are ASCII, so a byte that is no text
hides nothing beside it. A secret in a deeper layer is mapped back, layer by layer, to the span of
the original text that encodes it (in compressed data: the whole part). Every occurrence of an
encoded part is mapped on its own; the same decoded text at the same place isn't followed twice,
and a stream that begins with the same 64 KiB as one that it came out of is a cycle and ends there.
Base64 runs under 16 characters hold no secret: the shortest one has 12 bytes. What looks like the
head of compressed data is followed if its fields are such as the format defines and its first bytes
inflate.

Defined results: a null text counts as empty and has no spans; repeated rows are scanned each on
their own; spans are code points, end exclusive, sorted by start, kind and end, without
repetition; other input columns are ignored; an empty table gives an empty result. Texts of any
length are scanned whole, in time about proportional to their length and that of what they
decode to. In inflated data, an unbroken run of more than ``WINDOW`` bytes is decoded in windows
that overlap, so compressed data within such a run is unwrapped as far as a window holds it.
"""

from __future__ import annotations

import base64
import bisect
import bz2
import hashlib
import lzma
import re
import zlib
from collections.abc import Callable, Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The kinds in their order, their patterns and least lengths.
KINDS = ("assign", "access", "hex")
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ASSIGN_LEAST = 6
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
ACCESS_LEAST = 20
HEX = re.compile(r"[0-9a-f]{24,}")

#: What an escape's lead is followed by, and the digits in it.
AFTER_LEAD = {
    "%": re.compile(r"([0-9A-Fa-f]{2})"),
    "\\": re.compile(r"(?:u([0-9A-Fa-f]{4})|u\{([0-9A-Fa-f]{1,6})\}|U([0-9A-Fa-f]{8})|x([0-9A-Fa-f]{2}))"),
}
ESCAPE = re.compile(r"%[0-9A-Fa-f]{2}|\\(?:u[0-9A-Fa-f]{4}|u\{[0-9A-Fa-f]{1,6}\}|U[0-9A-Fa-f]{8}|x[0-9A-Fa-f]{2})")
#: Characters that a secret or an encoded part may hold; all others end a stretch.
STRETCH = re.compile(r"""[A-Za-z0-9+/_.=\-"': \r\n%\\{}!~*()]+""")
WITHIN = frozenset(chr(c) for c in range(128) if STRETCH.fullmatch(chr(c))) - AFTER_LEAD.keys()
BREAK = re.compile(rb"""[^A-Za-z0-9+/_.=\-"': \r\n%\\{}!~*()]""")
BLANKS = re.compile(rb" {3,}")
BASE64_LEAST = 16
BASE64_RUN = re.compile(r"[A-Za-z0-9+/_-]{16,}+")
#: Lines that hold nothing else after a line's last run; the last one may be short.
FOLDED = re.compile(r"[A-Za-z0-9+/_-]{16,}+(?:\r?\n[ \t]*+[A-Za-z0-9+/_-]{16,}+(?=\r?\n|=|$))*+(?:\r?\n[ \t]*+[A-Za-z0-9+/_-]{2,15}+(?=\r?\n|=|$))?")
LINE = re.compile(r"[A-Za-z0-9+/_-]+")
URL_SAFE = str.maketrans("-_", "+/")
#: How compressed data begins: as bytes, and in base64.
PACKED = re.compile(rb"\x1f\x8b\x08|BZh[1-9]1AY&SY|\xfd7zXZ\x00|\x78[\x01\x5e\x9c\xda]")
PACKED_WITHIN = re.compile("\x1f\x8b\x08|BZh[1-9]1AY&SY|\xfd7zXZ\x00|\x78[\x01\x9c\xda]")
PACKED_FIRST = "\x1fB\xfdx"
PACKED_BASE64 = re.compile(r"H4sI|Qlpo[MNO][TDjzTDjz]FBWSZTW|Qlpo[MNO]|/Td6WFoA|_Td6WFoA|(?:^|(?<=[/_.+-]))e[AFJN]")
CHUNK, WINDOW, OVERLAP, HEAD, PROBE = 1 << 20, 1 << 22, 1 << 20, 1 << 16, 192

SPAN_TYPE = "array<struct<kind:string,start:int,end:int,base:boolean,depth:int>>"


def find(text: str) -> list[tuple[int, int, int]]:
    """(kind's index, start, end) of one layer: leftmost, non-overlapping per kind."""
    found = []
    lowered = text.lower()
    if any(k in lowered for k in KEYWORDS):
        found += [(0, m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_LEAST]
    if "AKIA" in text:
        found += [(1, m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    found += [(2, m.start(), m.end()) for m in HEX.finditer(text)]
    return found


class Layer:
    """A text that was decoded out of a parent, and where its characters stand there. ``escapes``
    tells how often its escapes have been replaced: 0, 1, or 2 for until none was left."""

    def __init__(self, text: str, parent: Layer | None = None, place: Callable[[int, int], tuple[int, int]] | None = None, escapes: int = 0, rounds: int = 1):
        self.text, self.parent, self._place, self.escapes = text, parent, place, escapes
        self.depth = parent.depth + rounds if parent else 0

    def origin(self, a: int, b: int) -> tuple[int, int]:
        """The span of the original text that holds the characters from a to b."""
        layer = self
        while layer.parent is not None:
            a, b = layer._place(a, b)
            layer = layer.parent
        return a, b


def _unescaped(layer: Layer, begin: int, end: int) -> Layer:
    """The stretch with every escape replaced."""
    text, pieces, parts, at, length = layer.text, [], [], begin, 0
    while (m := ESCAPE.search(text, at, end)) is not None:
        lead, stop = m[0][0], m.start() + 1
        code = None
        while lead in AFTER_LEAD and (body := AFTER_LEAD[lead].match(text, stop, end)) is not None:
            code, stop = int(body[body.lastindex], 16), body.end()
            lead = chr(code) if code < 128 else ""
        if m.start() > at:
            pieces.append(text[at : m.start()])
            parts.append((length, at, 0))
            length += m.start() - at
        pieces.append(chr(code) if code <= 0x10FFFF else "\ufffd")
        parts.append((length, m.start(), stop))
        length += 1
        at = stop
    pieces.append(text[at:end])
    parts.append((length, at, 0))
    starts = [p[0] for p in parts]

    def place(a: int, b: int) -> tuple[int, int]:
        here, there, _ = parts[bisect.bisect_right(starts, a) - 1]
        last, its, stop = parts[bisect.bisect_right(starts, b - 1) - 1]
        return there + a - here, stop or its + b - last

    return Layer("".join(pieces), layer, place, 1)


def _settled(layer: Layer, begin: int, end: int) -> Iterator[Layer]:
    """Round by round, what stands around the characters that the escapes of a stretch turn into.
    The stretch is a linked list, so a round costs what it changes and scans."""
    n = end - begin
    chars, stop = list(layer.text[begin:end]), list(range(begin + 1, end + 1))
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))

    def ahead(i: int, most: int = 10) -> list[int]:
        out = []
        while i < n and len(out) < most:
            out.append(i)
            i = after[i]
        return out

    def body(i: int) -> tuple[re.Match, list[int]] | None:
        if chars[i] not in AFTER_LEAD:
            return None
        nodes = ahead(after[i])
        m = AFTER_LEAD[chars[i]].match("".join(chars[j] for j in nodes))
        return m and (m, nodes)

    rounds, leads = 0, [m.start() - begin for m in ESCAPE.finditer(layer.text, begin, end)]
    while leads:
        rounds += 1
        for i in leads:
            while (found := body(i)) is not None:
                m, nodes = found
                code, last = int(m[m.lastindex], 16), nodes[m.end() - 1]
                chars[i] = chr(code) if code <= 0x10FFFF else "\ufffd"
                stop[i], after[i] = stop[last], after[last]
                if after[i] < n:
                    before[after[i]] = i
        changed, leads, covered, packed = leads, {}, set(), {}
        for i in changed:
            lead = i
            for _ in range(10):
                if lead < 0 or chars[lead] in AFTER_LEAD:
                    break
                if chars[lead] in PACKED_FIRST:
                    packed[lead] = None
                lead = before[lead]
            if lead >= 0 and body(lead) is not None:
                leads[lead] = None
            if i in covered:
                continue
            low = high = i
            while before[low] >= 0 and chars[before[low]] in WITHIN:
                low = before[low]
            while after[high] < n and chars[after[high]] in WITHIN:
                high = after[high]
            nodes = [low]
            while nodes[-1] != high:
                nodes.append(after[nodes[-1]])
            covered.update(nodes)
            stops = [stop[j] for j in nodes]
            yield Layer("".join(chars[j] for j in nodes), layer, lambda a, b, nodes=nodes, stops=stops: (begin + nodes[a], stops[b - 1]), 2, rounds)
        for i in packed:
            if PACKED_WITHIN.match("".join(chars[j] for j in ahead(i))):
                if not _opens("".join(chars[j] for j in ahead(i, PROBE)).encode("latin-1", "ignore")):
                    continue
                nodes = ahead(i, n)
                data = "".join(chars[j] for j in nodes)
                data = data[: next((k for k, c in enumerate(data) if c > "\xff"), len(data))]
                yield from _unpacked(layer, data.encode("latin-1"), begin + i, stop[nodes[len(data) - 1]])


def _inflate(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """Inflated chunks of all members that follow each other; what can't be inflated ends it."""
    data, d = b"", None
    while True:
        if not data:
            data = next(chunks, b"")
            if not data:
                return
        try:
            if d is None:
                while len(data) < 10 and (more := next(chunks, b"")):
                    data += more
                if not PACKED.match(data):
                    return
                first = data[0]
                d = zlib.decompressobj(31) if first == 0x1F else zlib.decompressobj() if first == 0x78 else bz2.BZ2Decompressor() if first == 0x42 else lzma.LZMADecompressor(memlimit=1 << 28)
            is_zlib = hasattr(d, "unconsumed_tail")
            out = d.decompress(data, CHUNK)
            data = d.unconsumed_tail if is_zlib else b""
            if out:
                yield out
            while not is_zlib and not d.eof and not d.needs_input:
                if out := d.decompress(b"", CHUNK):
                    yield out
            if d.eof:
                data, d = d.unused_data, None
        except (zlib.error, OSError, EOFError, lzma.LZMAError, ValueError):
            return


def _inflated(data: bytes) -> Iterator[bytes] | None:
    """Chunks of what is left when nothing in the data is compressed as a whole; None if it isn't."""
    make: Callable[[], Iterator[bytes]] = lambda: iter((data,))
    heads, opened = [data[:HEAD]], False
    while True:
        deeper = lambda make=make: _inflate(make())
        stream = deeper()
        head = next(stream, b"")
        if not head or head[:HEAD] in heads:
            return make() if opened else None
        opened = True
        heads.append(head[:HEAD])
        make = deeper if next(stream, None) is not None else lambda head=head: iter((head,))
        if not PACKED.match(head):
            return make()


def _windows(chunks: Iterator[bytes]) -> Iterator[str]:
    """The stream in windows that end at a break, or overlap where there is none."""
    held = b""
    for chunk in chunks:
        held = BLANKS.sub(b"  ", held + chunk) if b"   " in chunk else held + chunk
        if len(held) > WINDOW:
            m = BREAK.search(held[::-1])
            cut = len(held) - m.start() if m else 0
            yield (held[:cut] if cut > OVERLAP else held).decode("latin-1")
            held = held[cut:] if cut > OVERLAP else held[-OVERLAP:]
    if held:
        yield held.decode("latin-1")


def _opens(data: bytes) -> bool:
    """Whether compressed data may begin so: what is no header, or fails at once, isn't followed."""
    if not PACKED.match(data):
        return False
    if data[0] == 0x1F and len(data) >= 10 and (data[3] & 0xE0 or data[8] not in (0, 2, 4) or 13 < data[9] < 255):
        return False
    try:
        if data[0] in (0x1F, 0x78):
            zlib.decompressobj(31 if data[0] == 0x1F else 15).decompress(data, PROBE)
        return True
    except zlib.error:
        return False


def _unpacked(layer: Layer, data: bytes, a: int, b: int) -> Iterator[Layer]:
    """Layers of the compressed data that stands from a to b of the layer."""
    chunks = _inflated(data)
    for text in _windows(chunks) if chunks is not None else ():
        yield Layer(text, layer, lambda _a, _b: (a, b))


def _decoded(body: str) -> bytes:
    body = body[: len(body) - (len(body) % 4 == 1)]
    return base64.b64decode(body + "=" * (-len(body) % 4))


def _base64(layer: Layer, first: bool, seen: set) -> Iterator[Layer]:
    """What the base64 runs of a layer hold, at each place where they may begin."""
    runs: dict[tuple[int, int], list[tuple[int, int]] | None] = {m.span(): None for m in BASE64_RUN.finditer(layer.text)}
    if runs and "\n" in layer.text:
        runs |= {m.span(): [(n.start(), n.end()) for n in LINE.finditer(layer.text, *m.span())] for m in FOLDED.finditer(layer.text) if "\n" in m[0]}
    for (a, b), lines in runs.items():
        body = layer.text[a:b] if lines is None else "".join(layer.text[x:y] for x, y in lines)
        if not first:  # deeper layers repeat what stood in the ones before
            key = ("run", *layer.origin(a, b), hashlib.blake2b(body.encode(), digest_size=16).digest())
            if key in seen:
                continue
            seen.add(key)
        ends, n = [], 0
        for x, y in lines or [(a, b)]:
            n += y - x
            ends.append((n, y))

        def where(i: int, ends=ends) -> int:
            """The place of the i-th character of the body."""
            n, y = ends[bisect.bisect_right(ends, (i, 1 << 62))]
            return y - (n - i)

        body = body.translate(URL_SAFE)
        for k in range(min(4, len(body) - BASE64_LEAST + 1)):

            def place(i: int, j: int, k=k, where=where, n=n) -> tuple[int, int]:
                return where(k + i * 4 // 3), where(min(n, k - (-j * 4 // 3)) - 1) + 1

            yield Layer(_decoded(body[k:]).decode("latin-1"), layer, place)
        for m in PACKED_BASE64.finditer(body):
            if _opens(_decoded(body[m.start() : m.start() + 4 * PROBE // 3])):
                yield from _unpacked(layer, _decoded(body[m.start() :]), where(m.start()), b)


def _deeper(layer: Layer, seen: set) -> Iterator[Layer]:
    text = layer.text
    if layer.escapes < 2 and ("%" in text or "\\" in text) and ESCAPE.search(text):
        for m in STRETCH.finditer(text):
            if ("%" in m[0] or "\\" in m[0]) and ESCAPE.search(m[0]):
                if layer.escapes:
                    yield from _settled(layer, *m.span())
                else:
                    yield _unescaped(layer, *m.span())
    yield from _base64(layer, not layer.depth, seen)
    if layer.depth and layer.escapes < 2:
        for m in PACKED_WITHIN.finditer(text):
            if not _opens(text[m.start() : m.start() + PROBE].encode("latin-1", "ignore")):
                continue
            end = next((i for i in range(m.start(), len(text)) if text[i] > "\xff"), len(text))
            yield from _unpacked(layer, text[m.start() : end].encode("latin-1"), m.start(), end)


def scan(text: str) -> list[tuple[int, int, int, bool, int]]:
    """All secrets of a text: (kind's index, start, end, found in the text itself, depth)."""
    spans: dict[tuple[int, int, int], int] = {}
    seen: set = set()
    work: list[Iterator[Layer]] = [iter((Layer(text),))]
    while work:
        layer = next(work[-1], None)
        if layer is None:
            work.pop()
            continue
        if layer.depth:
            key = (*layer.origin(0, len(layer.text)), hashlib.blake2b(layer.text.encode("utf-8", "surrogatepass"), digest_size=16).digest()) if layer.text else None
            if key is None or key in seen:
                continue
            seen.add(key)
        for kind, a, b in find(layer.text):
            a, b = layer.origin(a, b)
            spans[a, kind, b] = min(spans.get((a, kind, b), layer.depth), layer.depth)
        work.append(_deeper(layer, seen))
    return [(kind, a, b, depth == 0, depth) for (a, kind, b), depth in sorted(spans.items())]


def redact(text: str, spans: list[tuple[int, int, int, bool, int]], mark: str = "[SECRET]") -> str:
    """The text with each maximal union of overlapping spans replaced by ``mark``."""
    out, at, end = [], 0, -1
    for _, a, b, _, _ in sorted(spans, key=lambda s: s[1]):
        if a >= end:
            out += [text[at:a], mark] if a >= at else []
            at = b
        end = max(end, b)
        at = max(at, end)
    out.append(text[at:])
    return "".join(out)


def scan_secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", batch_rows: int = 256, with_text: bool = False) -> DataFrame:
    """Scan every whole text. Returns id_col, spans (array of kind, start, end, base, depth) and,
    with ``with_text``, redacted (the text with every span replaced; null stays null). Without a
    shuffle: each task streams its texts in slices of ``batch_rows``."""
    source = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_()), ("depth", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, batch_rows):
                part = batch.slice(at, batch_rows)
                texts = part.column(1).to_pylist()
                found = [scan(t) if t else [] for t in texts]
                rows = [[{"kind": KINDS[k], "start": a, "end": b, "base": base, "depth": depth} for k, a, b, base, depth in f] for f in found]
                columns = [part.column(0), pa.array(rows, span)]
                if with_text:
                    columns.append(pa.array([redact(t, f) if f else t for t, f in zip(texts, found, strict=True)], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, ["id", "spans", "redacted"][: len(columns)])

    schema = f"id {source.schema['id'].dataType.simpleString()}, spans {SPAN_TYPE}" + ", redacted string" * with_text
    return source.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def span_text(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact_texts(df: DataFrame, text_col: str = "text", batch_rows: int = 256) -> DataFrame:
    """All rows and columns of the input, text_col with its secrets replaced (null stays null)."""
    at_column = df.columns.index(text_col)
    out = df.withColumn(text_col, F.col(text_col).cast("string"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, batch_rows):
                part = batch.slice(at, batch_rows)
                texts = [redact(t, found) if t and (found := scan(t)) else t for t in part.column(at_column).to_pylist()]
                columns = part.columns
                columns[at_column] = pa.array(texts, part.schema.field(at_column).type)
                yield pa.RecordBatch.from_arrays(columns, schema=part.schema)

    return out.mapInArrow(run, out.schema)
