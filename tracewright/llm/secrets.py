r"""Secret scans that unwrap nested encodings.

Three kinds are sought (assign, access, hex; see KINDS) in the text itself, the base layer, and then in every layer
that decoding uncovers. A worklist holds layers: each is scanned, and its whole text with the percent-encoded or the \u-
and \x-escaped characters decoded in place, its base64 runs and, below base64 or escapes, gzip, zlib, bz2 and xz data
become new layers until none is new. Base64 is read from each of a run's first four characters on, so a prefix does no
harm, and over wrapped lines; streams may begin anywhere in decoded bytes, and bytes that are no text hide none around
them. A layer whose content was seen before at the same place of the document is not taken again, so cycles end, and each
copy of an encoded secret has its own span. Positions in escaped layers map back character by character; a finding below
base64 or compression covers the encoded run in the text, or the wrapped lines that it comes from.

Signs that are themselves escaped over and over count as written plainly, and after `LEVELS` levels of other nested escapes
all that are left are decoded in one pass: a secret holds none of these signs, so none is lost, and the time stays in
proportion to the text.

Compressed data are unwrapped to their end, all members of a stream in one, by way of a temporary file of the task if they
are long. That file is read in pieces of about `CHUNK` bytes, cut where no secret and no encoded run can stand, so memory
does not follow the unpacked size. (Only where no such place comes within `MORE` bytes, pieces are cut anywhere, with an
overlap.) What a cut-off or damaged stream gives up to there is scanned. Documents are independent, so the scan needs no
shuffle and no group is ever gathered.

Defined cases: null and empty texts have no spans; repeated rows get equal rows; null ids are scanned like others;
other columns are ignored, whatever their names (redact() passes them through); an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import bz2
import hashlib
import lzma
import mmap
import re
import zlib
from tempfile import SpooledTemporaryFile

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Kinds in the order that breaks ties of position: pattern, group whose length counts, least length.
KINDS = {
    "assign": (re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 6),
    "access": (re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
    "hex": (re.compile(r"[0-9a-f]+"), 0, 24),
}
ORDER = {kind: i for i, kind in enumerate(KINDS)}
LONG_HEX = re.compile(r"[0-9a-f]{24,}")
#: Bytes of a piece of unpacked data, how far its end may be put off, and how much pieces share then; bytes that a
#: decompressor takes and gives at once.
CHUNK, MORE, OVERLAP = 8 << 20, 64 << 20, 1 << 16
TAKEN, GIVEN = 1 << 14, 1 << 20
MIN_BASE64 = 16

_KEYWORDS = (b"passw", b"secret", b"token", b"api")
_HEX_CLASS = bytes(104 if chr(b) in "0123456789abcdef" else 32 for b in range(256))
_B64_CLASS = bytes(104 if (chr(b).isalnum() and b < 128) or chr(b) in "+/-_" else 32 for b in range(256))
#: One escape; a percent sign or backslash that is itself escaped, however often, counts as written plainly. No secret holds
#: such a sign, so what the levels between could show is in the outer one, too.
_ONE_PERCENT = r"%(?:25)*[0-9A-Fa-f]{2}"
_ONE_ESCAPE = r"\\(?:u005[cC]|x5[cC])*(?:u[0-9A-Fa-f]{4}|x[0-9A-Fa-f]{2})"
_PERCENT_RUN = re.compile(rf"(?<![^\s%])[^\s%]*(?:{_ONE_PERCENT}[^\s%]*)+")
_PERCENT = re.compile(rf"(?:{_ONE_PERCENT})+")
_ESCAPE_RUN = re.compile(rf"(?<![^\s\\])[^\s\\]*(?:{_ONE_ESCAPE}[^\s\\]*)+")
_ESCAPE = re.compile(rf"(?:{_ONE_ESCAPE})+")
#: Levels of escapes that are decoded one by one; below, all that are left are decoded at once.
LEVELS = 6
_BASE64_RUN = re.compile(r"[A-Za-z0-9+/_-]{%d,}={0,2}" % MIN_BASE64)
#: Lines of base64 under each other, also with written line ends; the last may be short.
_WRAPPED = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{%d,}+(?:[ \t]*+(?:\r?\n|(?:\\r)?\\n)[ \t>]*+[A-Za-z0-9+/_-]++)+" % MIN_BASE64)
_BREAK = re.compile(r"[ \t]*(?:\r?\n|(?:\\r)?\\n)[ \t>]*")
#: The first bytes of gzip, zlib, bz2 and xz.
_MAGIC = re.compile(rb"\x1f\x8b\x08|x[\x01\x5e\x9c\xda]|BZh[1-9]|\xfd7zXZ\0")
_PADDING = re.compile(rb"\0*+")
#: A byte that stands in no pattern and in no encoded run.
_GAP = re.compile(rb"""[^\w+/=%\\\r\n \t>:"'.-]""")
_WIDE = re.compile(rb"(?:[\x01-\x7f]\0{1,3}){6,}+[\x01-\x7f]?")
_BYTE_ESCAPES = {"%": re.compile("%[0-9A-Fa-f]{2}"), "\\": re.compile(r"""\\(?:u[0-9A-Fa-f]{4}|x[0-9A-Fa-f]{2}|[0-7]{1,3}|[abfnrtv\\'"])""")}
_SIMPLE = dict(zip("abfnrtv", "\a\b\f\n\r\t\v"))
_ESCAPED_MAGIC = {
    "%": re.compile("%1f%8b|(?:x|%78)(?:%01|%5e|\\^|%9c|%da)|BZh|%42%5a|%fd(?:7|%37)", re.I),
    "\\": re.compile(r"\\(?:x|u00)1f\\(?:x|u00)8b|\\037\\213|(?:x|\\(?:x|u00)78)(?:\\(?:x|u00)(?:01|5e|9c|da)|\^|\\(?:1|001|234|332))|BZh|\\(?:x|u00)fd|\\375", re.I),
}


def find(text: str) -> list[tuple[str, int, int]]:
    """Spans of the three kinds in one layer, leftmost and non-overlapping within a kind."""
    data = text.encode("utf-8", "surrogatepass")
    out = []
    if b"AKIA" in data:
        out += _matches("access", text)
    if b"h" * 24 in data.translate(_HEX_CLASS):
        out += [("hex", *m.span()) for m in LONG_HEX.finditer(text)]  # maximal runs, so the length can stand in the pattern
    low = data.lower()
    if any(word in low for word in _KEYWORDS):
        out += _matches("assign", text)
    return out


def _matches(kind: str, text: str) -> list[tuple[str, int, int]]:
    pattern, group, least = KINDS[kind]
    return [(kind, *m.span()) for m in pattern.finditer(text) if len(m[group]) >= least]


class Layer:
    """Decoded text whose character i came from [starts[i], ends[i]) of the document; without maps, all of it from `whole`.
    `cuts` are stretches that are also scanned alone; `step` is how much deeper than its parent it lies, `level` how many
    levels of escapes were decoded in place before."""

    def __init__(self, text: str, starts: np.ndarray | None = None, ends: np.ndarray | None = None, whole: tuple[int, int] | None = None, cuts=(), step: int = 1, level: int = 0):
        self.text, self.starts, self.ends, self.whole, self.cuts, self.step, self.level = text, starts, ends, whole, cuts, step, level

    def locate(self, start: int, end: int) -> tuple[int, int]:
        if self.whole:
            return self.whole
        return (start, end) if self.starts is None else (int(self.starts[start]), int(self.ends[end - 1]))

    def key(self):
        """What the layer holds and where: with equal keys, all that is found below is equal."""
        text = self.text if len(self.text) < 1000 else hashlib.blake2b(self.text.encode("utf-8", "surrogatepass"), digest_size=16).digest()
        return text, self.whole or hashlib.blake2b(self.starts.tobytes() + self.ends.tobytes(), digest_size=16).digest()

    def found(self):
        """Spans of the document that hold a secret in this layer."""
        for kind, start, end in find(self.text):
            yield kind, *self.locate(start, end)
        for a, b in self.cuts:
            for kind, start, end in find(self.text[a:b]):
                yield kind, *self.locate(a + start, a + end)

    def children(self):
        text = self.text
        percent = "%" in text and _PERCENT.search(text)
        escape = ("\\u" in text or "\\x" in text) and _ESCAPE.search(text)
        if self.level >= LEVELS:
            if percent or escape:
                yield self._settled()
        else:
            if percent:
                yield self._escaped(_PERCENT_RUN, _PERCENT, _percent)
            if escape:
                yield self._escaped(_ESCAPE_RUN, _ESCAPE, _unescape)
        yield from self._packed()
        if b"h" * MIN_BASE64 in text.encode("utf-8", "surrogatepass").translate(_B64_CLASS):
            for m in _BASE64_RUN.finditer(text):
                for data, _ in aligned(m[0].rstrip("=")):
                    yield from decoded(data, lambda a, b, m=m: self.locate(*m.span()))
            for m in _WRAPPED.finditer(text):
                breaks = [x.span() for x in _BREAK.finditer(text, *m.span())]
                lines = list(zip([m.start(), *(b for _, b in breaks)], [*(a for a, _ in breaks), m.end()]))
                line = np.repeat(np.arange(len(lines)), [b - a for a, b in lines])  # of each character
                for data, skip in aligned("".join(text[a:b] for a, b in lines)):

                    def place(a, b, skip=skip, line=line, lines=lines):  # the lines that bytes a to b come from
                        return self.locate(lines[line[skip + 4 * a // 3]][0], lines[line[skip + (8 * b - 1) // 6]][1])

                    yield from decoded(data, place, by_byte=not self.whole)

    def _packed(self):
        """Compressed data whose bytes are written with escapes."""
        for sign, escapes in _BYTE_ESCAPES.items():
            if _ESCAPED_MAGIC[sign].search(self.text):
                data, starts, ends, at = bytearray(), [], [], 0
                for m in escapes.finditer(self.text):
                    value = _byte(m[0])
                    data += self.text[at : m.start()].encode("latin-1", "replace") + value
                    starts += [*range(at, m.start()), *[m.start()] * len(value)]
                    ends += [*range(at + 1, m.start() + 1), *[m.end()] * len(value)]
                    at = m.end()
                data += self.text[at:].encode("latin-1", "replace")
                starts += range(at, len(self.text))
                ends += range(at + 1, len(self.text) + 1)
                forms = [bytes(data)]
                if sign == "%" and b"+" in data:  # in forms + is a blank, and a plus sign is escaped
                    forms.append(bytes(32 if c == 43 and self.text[i] == "+" else c for c, i in zip(data, starts)))
                for form in forms:
                    yield from streams(form, lambda a, b: self.locate(starts[a], ends[b - 1]), 1)

    def _escaped(self, runs: re.Pattern, part: re.Pattern, decode) -> Layer:
        """The whole text with its escapes decoded in place, so that what stands around a run is read with it. The runs
        are its cuts: what stands before one may take its start for a short value."""
        text, mapped, at, size = self.text, not self.whole, 0, 0
        pieces, starts, ends, moved = [], [], [], []  # moved: where an escape ends in the text, and then in the layer
        origin = (np.arange(len(text)), np.arange(1, len(text) + 1)) if self.starts is None else (self.starts, self.ends)
        for e in part.finditer(text):
            chars = list(decode(e[0]))
            pieces += [text[at : e.start()], *(c for c, _, _ in chars)]
            if mapped:
                starts += [origin[0][at : e.start()], origin[0][[e.start() + a for _, a, _ in chars]]]
                ends += [origin[1][at : e.start()], origin[1][[e.start() + b - 1 for _, _, b in chars]]]
            size += e.start() - at + len(chars)
            at = e.end()
            moved.append((at, size))
        pieces.append(text[at:])
        if mapped:
            starts, ends = np.concatenate([*starts, origin[0][at:]]), np.concatenate([*ends, origin[1][at:]])
        else:
            starts = ends = None
        cuts, i = [], 0
        for m in runs.finditer(text):  # no run cuts an escape
            while i < len(moved) and moved[i][0] <= m.start():
                i += 1
            first = m.start() - (moved[i - 1][0] - moved[i - 1][1] if i else 0)
            while i < len(moved) and moved[i][0] <= m.end():
                i += 1
            cuts.append((first, m.end() - (moved[i - 1][0] - moved[i - 1][1] if i else 0)))
        return Layer("".join(pieces), starts, ends, self.whole, cuts, level=self.level + 1)

    def _settled(self) -> Layer:
        """The text with all escapes decoded, also those that decoding makes, in one pass: a character that ends an escape
        takes it off the end of what is read so far. Its cuts are what was literal and what was not."""
        read: list[str] = []
        starts: list[int] = []
        origin: list[bool] = []
        stops: list[int] = []
        for i, char in enumerate(self.text):
            start, made = i, False
            while char in _HEX:
                size = _closed(read, char)
                if not size:
                    break
                code = int("".join(read[-(size - (1 if read[-size] == "%" else 2)) :]) + char, 16)
                start, made = starts[-size], True
                del read[-size:], starts[-size:], origin[-size:], stops[-size:]
                char = chr(code) if code < 128 else "\ufffd"
            read.append(char)
            starts.append(start)
            stops.append(i + 1)
            origin.append(made)
        edges = np.concatenate([[0], np.flatnonzero(np.diff(np.array(origin))) + 1, [len(read)]]).tolist() if read else [0]
        cuts = [(a, b) for a, b in zip(edges, edges[1:]) if b - a >= 6]
        if self.whole:
            return Layer("".join(read), whole=self.whole, cuts=cuts, level=self.level + 1)
        first, last = np.array(starts, np.int64), np.array(stops, np.int64) - 1
        if self.starts is None:
            return Layer("".join(read), first, last + 1, cuts=cuts, level=self.level + 1)
        return Layer("".join(read), self.starts[first], self.ends[last], cuts=cuts, level=self.level + 1)


_HEX = frozenset("0123456789abcdefABCDEF")


def _closed(read: list[str], char: str) -> int:
    """How many characters at the end of what is read make an escape with the next one, a hexadecimal digit; 0 if none do."""
    if len(read) > 1 and read[-1] in _HEX:
        if read[-2] == "%":
            return 2
        if len(read) > 2 and read[-2] == "x" and read[-3] == "\\":
            return 3
        if len(read) > 4 and read[-4] == "u" and read[-5] == "\\" and read[-2] in _HEX and read[-3] in _HEX:
            return 5
    return 0


def _percent(run: str):
    """(character, start, end) of a run of percent escapes; bytes outside UTF-8 become U+FFFD."""
    spots = [m.span() for m in re.finditer(_ONE_PERCENT, run)]
    i = 0
    for char in bytes(int(run[b - 2 : b], 16) for _, b in spots).decode("utf-8", "replace"):
        size = len(char.encode()) if char != "�" else 1
        upto = min(len(spots), i + size)
        yield char, spots[min(i, upto - 1)][0], spots[upto - 1][1]
        i = upto


def _unescape(run: str):
    parts = [(int(re.search("[0-9A-Fa-f]+$", m[0])[0][-4 if m[0][-5:-4] == "u" else -2 :], 16), m.start(), m.end()) for m in re.finditer(_ONE_ESCAPE, run)]
    i = 0
    while i < len(parts):
        code, a, b = parts[i]
        if 0xD800 <= code < 0xDC00 and i + 1 < len(parts) and 0xDC00 <= parts[i + 1][0] < 0xE000:
            code, b = 0x10000 + (code - 0xD800 << 10) + parts[i + 1][0] - 0xDC00, parts[i + 1][2]
            i += 1
        yield ("�" if 0xD800 <= code < 0xE000 else chr(code)), a, b
        i += 1


def _byte(escape: str) -> bytes:
    if escape[0] == "%":
        return bytes.fromhex(escape[1:])
    if escape[1] in "xu":
        return bytes([code]) if (code := int(escape[2:], 16)) < 256 else b"?"
    return bytes([int(escape[1:], 8) & 255]) if escape[1].isdigit() else _SIMPLE.get(escape[1], escape[1]).encode()


def aligned(body: str):
    """What a base64 run without its padding decodes to from each of its first four characters on, and how many are left
    out before: a prefix of any length may stand before the data."""
    body = body.replace("-", "+").replace("_", "/")
    for skip in range(4):
        part = body[skip:]
        part = part[:-1] if len(part) % 4 == 1 else part
        yield base64.b64decode(part + "=" * (-len(part) % 4)), skip


def decoded(data: bytes, place, step: int = 1, by_byte: bool = False):
    """Layers of decoded bytes: their text, whatever else stands in it (bytes outside UTF-8 become U+FFFD, which is in no
    finding), stretches of UTF-16 or UTF-32, and compressed streams. place(a, b): where bytes a to b come from."""
    if by_byte:
        spots = np.array([place(i, i + 1) for i in range(len(data))], np.int64).reshape(-1, 2)
        yield Layer(data.decode("latin-1"), spots[:, 0].copy(), spots[:, 1].copy(), step=step)
    else:
        for a, b in pieces(data):
            yield Layer(data[a:b].decode("utf-8", "replace"), whole=place(a, b), step=step)
    for m in _WIDE.finditer(data):
        for a in range(m.start(), m.end(), CHUNK):
            a, b = max(m.start(), a - OVERLAP), min(m.end(), a + CHUNK)
            yield Layer(data[a:b].replace(b"\0", b"").decode(), whole=place(a, b), step=step)
    yield from streams(data, place, step)


def pieces(data):
    """Bounds of pieces that hold all of data; no pattern and no encoding reaches over a cut at a _GAP."""
    at = 0
    while at < len(data):
        end, back = min(len(data), at + CHUNK), at
        if end < len(data):
            gap = _GAP.search(data, end, end + MORE)
            end = gap.start() if gap else min(len(data), end + MORE)
        if at and not _GAP.match(data, at):
            back = max(0, at - OVERLAP)
        yield back, end
        at = end


def streams(data, place, step: int):
    """The compressed streams that begin anywhere in data."""
    at = 0
    while m := _MAGIC.search(data, at):
        inner, at = unpacked(data, m.start())
        if inner:
            yield Packed(inner, place(m.start(), at), step)


def unpacked(data, start: int):
    """What the stream at the start and the members that follow it hold, and where they end. A stream that breaks off
    counts as one byte long, since another may begin in it."""
    end = start
    with SpooledTemporaryFile(CHUNK) as out:
        while (m := _MAGIC.match(data, _PADDING.match(data, end).end() if end > start else start)) and data[m.start()] == data[start]:
            upto = _member(data, m.start(), out)
            if upto is None:
                end = end if end > start else start + 1
                break
            end = upto
        size = out.tell()
        out.seek(0)
        return out.read() if size <= CHUNK else mmap.mmap(out.fileno(), 0, access=mmap.ACCESS_READ), end


def _member(data, at: int, out) -> int | None:
    """Write what one member holds; where it ends, or None if it does not."""
    first = data[at]
    tool = zlib.decompressobj(31) if first == 0x1F else zlib.decompressobj() if first == 0x78 else bz2.BZ2Decompressor() if first == 0x42 else lzma.LZMADecompressor()
    deflated = first in (0x1F, 0x78)
    try:
        while at < len(data) and not tool.eof:
            taken = data[at : at + TAKEN]
            at += len(taken)
            out.write(tool.decompress(taken, GIVEN))
            while not tool.eof and (tool.unconsumed_tail if deflated else not tool.needs_input):
                out.write(tool.decompress(tool.unconsumed_tail if deflated else b"", GIVEN))
        if deflated:
            out.write(tool.flush())
    except (zlib.error, OSError, EOFError, lzma.LZMAError, ValueError):
        return None
    return at - len(tool.unused_data) if tool.eof else None


class Packed:
    """Decompressed bytes from `whole` of the document."""

    def __init__(self, data, whole: tuple[int, int], step: int):
        self.data, self.whole, self.step = data, whole, step

    def key(self):
        return "packed", hashlib.blake2b(self.data, digest_size=16).digest(), self.whole

    def found(self):
        return ()

    def children(self):
        return decoded(self.data, lambda a, b: self.whole, 0)


def scan_text(text: str) -> list[tuple[str, int, int, int]]:
    """(kind, start, end, depth) in code points of the text, by start, kind and end; depth 0 is the text itself.
    A span found at several depths is listed once, at the smallest."""
    found: dict[tuple[str, int, int], int] = {}
    seen: dict = {}  # the least depth of each layer so far
    work = [(iter([Layer(text)]), 0)]  # layers on the way down, so that one piece of unpacked data is held at a time
    while work:
        layers, above = work[-1]
        layer = next(layers, None)
        if layer is None:
            work.pop()
            continue
        depth = above + layer.step if len(work) > 1 else 0
        if len(work) > 1:
            key = layer.key()
            if seen.get(key, depth + 1) <= depth:
                continue
            seen[key] = depth
        for span in layer.found():
            found[span] = min(depth, found.get(span, depth))
        work.append((layer.children(), depth))
    return sorted(((k, a, b, d) for (k, a, b), d in found.items()), key=lambda x: (x[1], ORDER[x[0]], x[2]))


SPANS = "array<struct<kind:string,start:bigint,stop:bigint,depth:int>>"


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and spans (kind, start, stop, depth) for each row of df."""

    def kernel():
        def step(batch):
            rows = [[dict(zip(("kind", "start", "stop", "depth"), s)) for s in scan_text(t)] for t in common.texts_of(batch.column(1))]
            return [batch.column(0), rows]

        return step

    return common.map_texts(df, [F.col(f"`{id_col}`").alias("doc_id"), common.text_column(df, text_col)], f"doc_id {dict(df.dtypes)[id_col]}, spans {SPANS}", kernel)


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scan(common.table(spark, sf_dir, "documents"))
    label = lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.stop.cast("string"))
    base = F.filter("spans", lambda s: s.depth == 0)
    count = lambda kind: F.size(F.filter(base, lambda s: s.kind == kind)).cast("long")
    return rows.select(
        "doc_id",
        count("assign").alias("n_assign"),
        count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        F.sha2(F.array_join(F.transform(base, label), ","), 256).alias("base_sha256"),
        F.array_join(F.transform("spans", label), ",").alias("spans"),
    )


def redacted(text: str, mark: str) -> str:
    """text with each stretch of overlapping spans replaced by the mark."""
    out, at = [], 0
    for _, start, end, _ in scan_text(text):
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join([*out, text[at:]])


def redact(df: DataFrame, text_col: str = "text", chars_col: str | None = None, mark: str = "[SECRET]") -> DataFrame:
    """df with the secrets of the text replaced; other columns pass through, and chars_col, if given, is counted anew."""
    index, schema = df.columns.index(text_col), common.arrow_schema(df.schema)

    def run(batches):
        for batch in batches:
            for part in common.slices(batch, index):
                texts = [None if t is None else redacted(t, mark) for t in part.column(index).to_pylist()]
                columns = list(part.columns)
                columns[index] = pa.array(texts, schema.field(index).type)
                yield pa.RecordBatch.from_arrays([c.cast(schema.field(i).type) for i, c in enumerate(columns)], schema=schema)

    out = df.mapInArrow(run, df.schema)
    return out.withColumn(chars_col, F.length(text_col).cast(df.schema[chars_col].dataType)) if chars_col else out
