"""Secret scan with a worklist of decoded layers.

A text is searched for assignments, access keys and hex runs. Then encoded parts are
unwrapped (percent escapes, Unicode escapes, base64, also over line ends, and gzip or zlib data inside
base64 or escaped bytes), each result, text or bytes, is searched in the same way and unwrapped further,
until nothing new appears. Bytes that aren't text are searched too, with replacement characters. A layer that was seen for the same place is not entered again, so layers
that decode to themselves end too. Spans found in a layer are mapped back to the original text: by
character through escapes, to the whole token through base64 and compression.

Cases: a null or empty text has no spans; very long texts are searched whole; rows are
independent, so repeated rows give repeated results; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex")
_WORDS = ("passw", "secret", "token", "apikey", "api_key")
_ASSIGN = re.compile(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
_ESCAPE = re.compile(r"(?:%[0-9A-Fa-f]{2})+|(?:\\u[0-9A-Fa-f]{4})+|(?:\\x[0-9A-Fa-f]{2})+|&#(?:[xX][0-9A-Fa-f]{1,6}|[0-9]{1,7});")
_BASE64 = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}={0,2}")
#: A line end in base64, real or written as \n.
_BREAK = re.compile(r"[ \t]*+(?:\r\n?|\n|\\r\\n|\\n)[ \t]*+")
_WRAPPED = re.compile(rf"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{{16,}}+(?:{_BREAK.pattern}[A-Za-z0-9+/_-]++)++={{0,2}}(?:{_BREAK.pattern}={{1,2}})?")
_PART = re.compile(r"[A-Za-z0-9+/_-]+")
_CUT = re.compile(r"[/+_-]")
_STANDARD = str.maketrans("-_", "+/")
#: The start of a gzip or zlib stream, and byte order marks.
_STREAM = re.compile(rb"\x1f\x8b\x08|" + b"|".join(re.escape(bytes([x, y])) for x in range(0x08, 0x79, 16) for y in range(256) if (x * 256 + y) % 31 == 0 and not y & 32))
_MARKS = (b"\xff\xfe", b"\xfe\xff")
#: Other escapes in the written form of bytes.
_SHORT = {r"\n": b"\n", r"\r": b"\r", r"\t": b"\t", r"\\": b"\\", r"\'": b"'", r"\"": b'"'}


def find(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the secrets of one layer; leftmost and non-overlapping in each kind."""
    found = []
    lower = text.lower()
    if any(w in lower for w in _WORDS):
        found += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[1]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(found)


def _unescape(part: str) -> bytes | str | None:
    """What an escape stands for: bytes of unknown encoding, or characters; None if it's no character."""
    try:
        if part[0] == "%":
            return bytes.fromhex(part.replace("%", ""))
        if part[0] == "&":
            return chr(int(part[3:-1], 16) if part[2] in "xX" else int(part[2:-1]))
        if part[1] == "u":
            return bytes.fromhex(part.replace("\\u", "")).decode("utf-16-be", errors="replace")
        return bytes.fromhex(part.replace("\\x", ""))
    except (ValueError, OverflowError):
        return None


def _escaped_lines(text: str):
    """(start, end, escapes as (start, end, what it stands for)) of the lines with escapes."""
    last = -1
    for m in _ESCAPE.finditer(text):
        if m.start() < last:
            continue
        lo = text.rfind("\n", 0, m.start()) + 1
        last = hi = end if (end := text.find("\n", m.end())) >= 0 else len(text)
        found = [(e.start(), e.end(), plain) for e in _ESCAPE.finditer(text, lo, hi) if (plain := _unescape(e[0])) is not None]
        if found:
            yield lo, hi, found


def _unescaped(text: str, lo: int, hi: int, found):
    """(line with its escapes resolved, start and end in `text` of each of its characters), in each encoding its bytes may have."""
    wide = any(isinstance(plain, bytes) and (b"\0" in plain or plain[:2] in _MARKS) for _, _, plain in found)
    for code in ("utf-8", "utf-16-le", "utf-16-be") if wide else ("utf-8",):
        out, starts, ends, at = [], [], [], lo
        for start, end, plain in found:
            if isinstance(plain, bytes):
                plain = plain.decode(code, errors="replace")
            out += (text[at:start], plain)
            starts += range(at, start)
            ends += range(at + 1, start + 1)
            starts += [start] * len(plain)
            ends += [end] * len(plain)
            at = end
        out.append(text[at:hi])
        starts += range(at, hi)
        ends += range(at + 1, hi + 1)
        yield "".join(out), starts, ends


def _escaped_streams(text: str, lo: int, hi: int, found):
    """(bytes, start, end) that compressed streams in escapes, with the plain characters between, unfold to."""
    if not any(isinstance(plain, bytes) and max(plain) > 126 for _, _, plain in found):
        return
    data, places, at = bytearray(), [], lo

    def literal(x, y):
        while x < y:
            n = 2 if text[x : x + 2] in _SHORT else 1
            raw = _SHORT.get(text[x : x + 2]) or text[x].encode(errors="surrogatepass")
            data.extend(raw)
            places.extend([(x, x + n)] * len(raw))
            x += n

    for start, end, plain in found:
        literal(at, start)
        width = (end - start) // len(plain) if isinstance(plain, bytes) else 0
        raw = plain if width else plain.encode(errors="surrogatepass")
        data.extend(raw)
        places.extend((start + k * width, start + (k + 1) * width) if width else (start, end) for k in range(len(raw)))
        at = end
    literal(at, hi)
    data, taken = bytes(data), 0
    for m in _STREAM.finditer(data):
        if m.start() >= taken:
            plain, used, _ = _inflated(data[m.start() :])
            if plain:
                taken = m.start() + used
                yield plain, places[m.start()][0], places[taken - 1][1]


def _inflated(data: bytes) -> tuple[bytes, int, bool]:
    """(what the gzip or zlib stream at the start of `data` unfolds to, bytes that it takes, whether it's whole).

    A stream that breaks off or is damaged gives what comes before.
    """
    if not _STREAM.match(data):
        return b"", 0, False
    stream, out = zlib.decompressobj(47), []
    for at in range(0, len(data), 1 << 14):
        part, before = data[at : at + (1 << 14)], stream.copy()
        try:
            out.append(stream.decompress(part))
        except zlib.error:
            try:
                for byte in part:
                    out.append(before.decompress(bytes([byte])))
            except zlib.error:
                pass
            return b"".join(out), len(data), False
        if stream.eof:
            return b"".join(out), at + len(part) - len(stream.unused_data), True
    return b"".join(out), len(data), False


def _readings(data: bytes):
    """The next layers of bytes: what they unfold to and the bytes behind, else texts. Bytes that aren't text stay in as replacement characters."""
    plain, used, whole = _inflated(data)
    if plain:
        yield plain
    if whole:
        if data[used:].strip(b"\0"):
            yield data[used:]
        return
    yield data.decode(errors="replace")
    if b"\0" in data or data[:2] in _MARKS:
        yield data.decode("utf-16-le", errors="replace")
        yield data.decode("utf-16-be", errors="replace")


def _tokens(text: str):
    """(characters, start, end) of the base64 tokens: those of one line, and those that go on over line ends."""
    for m in _BASE64.finditer(text):
        yield m[0].rstrip("="), m.start(), m.end()
    at = 0
    while m := _WRAPPED.search(text, at):
        parts = [(x.start(), x.end()) for x in _PART.finditer(_BREAK.sub(lambda b: " " * len(b[0]), m[0]))]
        size = [y - x for x, y in parts]
        # A line shorter than the one before is the last, unless the next one is no mere word.
        last = next((k for k in range(1, len(parts) - 1) if size[k] < size[k - 1] and size[k + 1] < 16), len(parts) - 1)
        at = m.end() if last == len(parts) - 1 else m.start() + parts[last][1]
        yield "".join(m[0][x:y] for x, y in parts[: last + 1]), m.start(), at


def _unwrapped(text: str):
    """(bytes, start, end) of each base64 token.

    What stands before a / + - or _ may be no part of it, as in a path. Only the place modulo 4 counts
    for what follows, so a token is decoded at most four times.
    """
    for token, start, end in _tokens(text):
        cuts = [0, *(m.end() for m in _CUT.finditer(token))]
        token = token.translate(_STANDARD)
        for phase in {c % 4 for c in cuts}:
            part = token[phase:]
            part = part[: len(part) - (len(part) % 4 == 1)]
            data = base64.b64decode(part + "=" * (-len(part) % 4))
            if data:
                yield data, start, end
            for c in cuts:
                if c > 3 and c % 4 == phase and _STREAM.match(data, c // 4 * 3) and (plain := _inflated(data[c // 4 * 3 :])[0]):
                    yield plain, start, end


def scan(text: str) -> tuple[list[tuple[int, int, int]], set[tuple[int, int, int]], int]:
    """(base spans, all spans, layers of text entered) as (start, kind, end) in `text`."""
    base = find(text)
    spans, seen, layers = set(base), set(), 0
    # A layer with the place in the original of each character; None: every character, or byte, is where the token is.
    work = [(text, None, None, None)]
    while work:
        layer, starts, ends, whole = work.pop()

        def place(lo, hi, starts=starts, ends=ends, whole=whole):
            return whole or ((starts[lo], ends[hi - 1]) if starts else (lo, hi))

        if isinstance(layer, bytes):
            below = [(data, None, None, whole) for data in _readings(layer)]
        else:
            if layer is not text:
                layers += 1
                for lo, kind, hi in find(layer):
                    at = place(lo, hi)
                    spans.add((at[0], kind, at[1]))
            below = []
            for line in _escaped_lines(layer):
                below += [(plain, [place(x, y)[0] for x, y in zip(s, e, strict=True)], [place(x, y)[1] for x, y in zip(s, e, strict=True)], whole) for plain, s, e in _unescaped(layer, *line)]
                below += [(data, None, None, place(lo, hi)) for data, lo, hi in _escaped_streams(layer, *line)]
            below += [(data, None, None, place(lo, hi)) for data, lo, hi in _unwrapped(layer)]
        for item in below:
            if not item[0]:
                continue
            raw = item[0] if isinstance(item[0], bytes) else item[0].encode(errors="surrogatepass")
            mark = (type(item[0]), hashlib.sha256(raw).digest(), item[3] or (item[1][0], item[2][-1]))
            if mark not in seen:
                seen.add(mark)
                work.append(item)
    return base, spans, layers


def _joined(spans) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in sorted(spans))


def _rows(batches):
    kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()] * 2
    names = ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_decoded", "n_layers"]
    for batch in batches:
        out: list[list] = [[] for _ in names]
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
            base, spans, layers = scan(text.as_py() or "")
            counts = [sum(s[1] == k for s in base) for k in range(3)]
            row = (doc_id, *counts, hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(spans), len(spans) - len(base), layers)
            for to, value in zip(out, row, strict=True):
                to.append(value)
        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, kinds, strict=True)], names)


def secret_scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, counts and SHA-256 of the base spans, all spans, n_decoded (spans the layers add), n_layers."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_rows, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_decoded long, n_layers long")
