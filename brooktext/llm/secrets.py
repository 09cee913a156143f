"""Secret scanning with a recursive decoding worklist.

Every text is scanned as it stands (the base layer). Then a worklist unwraps what is nested in it: URL, Unicode and
hexadecimal escapes, base64 runs, and compressed bytes inside either. Each new layer is scanned again and unwrapped further
until no new layer appears; spans are mapped back to code points of the document.

Escapes are unwrapped to their own fixpoint at once, in time linear in the text: what an escape decodes to may complete
another (as `%2541` does), and is decoded on the spot. The order can't matter, since no escape's beginning occurs inside
another. Half-decoded states aren't scanned; as none of the escapes' first characters belongs to a secret's pattern, they
show nothing but parts of what the text or its fixpoint shows. What a base64 run holds is found once a document and reported for each
of its places; digests of the layers that were seen end cycles, as of a stream that inflates to itself.

Base64 is tried at all four alignments, so that a run that begins with other characters (`blob/...`) is read, and across
line breaks. Of bytes that aren't text as a whole, compressed streams and stretches of printable text (8-bit or UTF-16)
are taken. Each beginning of a stream is tried, and a broken one may be read to the end of its bytes before it shows: bytes
that are nothing but beginnings of gzip streams take time that grows faster than their length.

Defined results: null and empty texts have no spans; repeated rows give equal rows; a text of any length is scanned
whole; an empty table gives an empty one; columns other than id and text are not carried, so their names can't clash. A
compressed stream of more than `max_layer` bytes is left packed, as a guard against decompression bombs, and counted in
`n_left_packed`; the base layer has no such bound.
"""

from __future__ import annotations

import base64
import bz2
import hashlib
import lzma
import re
import zlib
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from urllib.parse import unquote_to_bytes

import pyarrow as pa
from pyspark.sql import DataFrame

from .shared import texts, tidy

#: Kinds in the order in which spans that start at one place are listed.
KINDS = ("assign", "access", "hex")
MAX_LAYER = 64 << 20

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{16,}")  # a run is matched from its first character, so this is the runs of 16 or more

#: Where escapes may be: from an opening character on, all that may be part of one.
_ESCAPES = re.compile(r"[%\\&][%\\&#uUx{};0-9A-Fa-f]+")
_ESCAPE = re.compile(r"%([0-9A-Fa-f]{2})|\\u([0-9A-Fa-f]{4})|(?:\\U([0-9A-Fa-f]{8})|\\u\{([0-9A-Fa-f]{1,6})\}|\\x([0-9A-Fa-f]{2})|&#x([0-9A-Fa-f]{1,6});)|&#([0-9]{1,7});")
_OPENS, _CLOSES, _LONGEST = frozenset("%\\&"), frozenset("0123456789abcdefABCDEF};"), 10
_BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
_WRAPPED = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}+(?:\r?\n[\x20\t]*+[A-Za-z0-9+/_-]++)+={0,2}")
_QUOTED = re.compile(r"(?<![\w.~!*'()+/-])(?:%[0-9A-Fa-f]{2}|[\w.~!*'()+/-])+", re.A)
_STREAM = re.compile(rb"\x1f\x8b\x08|\x78[\x01\x5e\x9c\xda]|BZh[1-9]1AY&SY|\xfd7zXZ\x00|\x28\xb5\x2f\xfd", re.S)
_STRETCH = re.compile(rb"(?:[\t\n\r\x20-\x7e]\0){12,}|(?:\0[\t\n\r\x20-\x7e]){12,}|[\t\n\r\x20-\x7e]{12,}")

Span = tuple[int, int, str]


def scan_layer(text: str) -> list[Span]:
    """(start, end, kind) of one layer, by start and then kind as listed."""
    found = []
    if ":" in text or "=" in text:
        found += [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text) if m.end() - m.start() >= 18]
    found += [(m.start(), m.end(), "hex") for m in _HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


class _Unescaped:
    """A text with all escapes decoded, and where its characters were: as they stood between the places kept here."""

    def __init__(self, text: str):
        parts = []
        self.starts, self.origins = [0], [(0, -1, "")]  # of a stretch: its first character; that one's place, its end (-1: as it stands) and sort
        at = size = 0
        for m in _ESCAPES.finditer(text):
            items = _decoded(m[0], m.start())
            if not any(x[3] for x in items):
                continue
            parts.append(text[at : m.start()])
            size += m.start() - at
            for new, start, end, sort in self._whole(items):
                parts.append(new)
                self.starts.append(size)
                self.origins.append((start, end if sort else -1, sort))
                size += len(new)
            at = m.end()
            self.starts.append(size)
            self.origins.append((at, -1, ""))
        self.changed = at > 0
        self.text = "".join([*parts, text[at:]]) if at else text

    @staticmethod
    def _whole(items):
        """Items with their runs of escaped bytes as text."""
        k = 0
        while k < len(items):
            if items[k][3] != "url":
                yield items[k]
                k += 1
                continue
            last = k
            while last < len(items) and items[last][3] == "url":
                last += 1
            run = items[k:last]
            data = bytes(x[0] if isinstance(x[0], int) else ord(x[0]) for x in run)
            if data.isascii():
                yield from run
            else:
                yield data.decode("utf-8", "replace"), run[0][1], run[-1][2], "url"
            k = last

    def outer(self, start: int, end: int) -> tuple[int, int, str]:
        """The place in the text of a stretch of the decoded text, and the sorts of escapes in it."""
        first, last = bisect_right(self.starts, start) - 1, bisect_right(self.starts, end - 1) - 1
        s, e, _ = self.origins[first]
        begin = s if e >= 0 else s + start - self.starts[first]
        s, e, _ = self.origins[last]
        stop = e if e >= 0 else s + end - self.starts[last]
        return begin, stop, "".join(f"{n}>" for n in ("url", "unicode") if any(o[2] == n for o in self.origins[first : last + 1]))


def _decoded(text: str, base: int) -> list[tuple]:
    """The text's characters with all escapes decoded: (character, or a byte from 128 on; start; end; sort of escape or "")."""
    out: list[tuple] = []
    opened: list[int] = []
    for i, c in enumerate(text):
        item = (c, base + i, base + i + 1, "")
        while True:  # what was decoded may complete an escape
            while opened and opened[-1] >= len(out):
                opened.pop()
            out.append(item)
            c = item[0]
            if c in _OPENS:
                opened.append(len(out) - 1)
                break
            if c not in _CLOSES or not opened or len(out) - opened[-1] > _LONGEST:
                break
            first = opened[-1]
            m = _ESCAPE.fullmatch("".join(x[0] if isinstance(x[0], str) else "\0" for x in out[first:]))
            if not m or (new := _character(m)) is None:
                break
            start, end = out[first][1], item[2]
            del out[first:]
            opened.pop()
            if isinstance(new, str) and "\udc00" <= new <= "\udfff" and out and isinstance(out[-1][0], str) and "\ud800" <= out[-1][0] <= "\udbff":
                high = out.pop()  # the two halves of one character
                new, start = chr(0x10000 + (ord(high[0]) - 0xD800 << 10) + ord(new) - 0xDC00), high[1]
            item = (new, start, end, "url" if m[1] else "unicode")
    return [("�", *x[1:]) if isinstance(x[0], str) and "\ud800" <= x[0] <= "\udfff" and x[3] else x for x in out]


def _character(m: re.Match) -> str | int | None:
    if m[1]:
        code = int(m[1], 16)
        return chr(code) if code < 128 else code
    code = int(m[7]) if m[7] else int(m[2] or m[3] or m[4] or m[5] or m[6], 16)
    return chr(code) if code < 0x110000 else None


class _TooLarge(Exception):
    pass


def _inflated(data: memoryview, max_layer: int) -> tuple[bytes, int] | None:
    """The bytes of a compressed stream that data begins with, and the stream's length; None if there is none or it is broken."""
    try:
        if data[:4] == b"\x28\xb5\x2f\xfd":
            import zstandard

            d = zstandard.ZstdDecompressor().decompressobj()
            out, size = [], 0
            for at in range(0, len(data), 1 << 12):
                out.append(d.decompress(data[at : at + (1 << 12)]))
                size += len(out[-1])
                if size > max_layer:
                    raise _TooLarge
                if d.eof:
                    return b"".join(out), min(at + (1 << 12), len(data)) - len(d.unused_data)
            return None
        d = bz2.BZ2Decompressor() if data[:3] == b"BZh" else lzma.LZMADecompressor() if data[:1] == b"\xfd" else zlib.decompressobj(47)
        out = d.decompress(data, max_layer + 1)
        if len(out) > max_layer:
            raise _TooLarge
        return (out, len(data) - len(d.unused_data)) if d.eof else None
    except (_TooLarge, MemoryError):
        raise
    except Exception:  # each codec has an exception of its own for what isn't its stream
        return None


#: ASCII that a text may hold.
_PLAIN_ASCII = bytes([9, 10, 13, *range(32, 127)])


def _readable(data: bytes) -> str | None:
    """The text that the bytes are, if one in twenty characters at most can't be printed. Counted without a look at each character where it can be."""
    try:
        text = data.decode("utf-8")
    except UnicodeDecodeError:
        return None
    if text.isascii():
        odd = len(data.translate(None, _PLAIN_ASCII))
    else:
        bare = text.replace("\t", "").replace("\n", "").replace("\r", "")
        odd = 0 if bare.isprintable() else sum(n for c, n in Counter(bare).items() if not c.isprintable())
    return text if text and odd * 20 <= len(text) else None


class _Packed:
    """What a document's packed layers show, each found once."""

    def __init__(self, max_layer: int):
        self.max_layer, self.left, self.known = max_layer, 0, {}

    def kinds(self, packed: str | bytes) -> dict[str, str]:
        """The kinds that a base64 run, or bytes, and all layers nested in it show, each with the names of its layers."""
        raw = packed.encode("ascii") if isinstance(packed, str) else packed
        key = hashlib.blake2b(raw, digest_size=16, key=b"run" if isinstance(packed, str) else b"bytes").digest()
        if key not in self.known:
            self.known[key] = found = {}
            seen: set[bytes] = set()
            work = [*self._in_run(packed, "", seen)] if isinstance(packed, str) else [*self._in_bytes(packed, "url>", seen, streams_only=True)]
            while work:
                text, chain = work.pop()
                for *_, k in scan_layer(text):
                    found.setdefault(k, chain + k)
                plain = _Unescaped(text)
                if plain.changed:
                    for s, e, k in scan_layer(plain.text):
                        if k not in found:
                            found[k] = chain + plain.outer(s, e)[2] + k
                    work += (x for run, _, _ in _runs(plain.text) for x in self._in_run(run, chain, seen))
                for data, *_ in _quoted(text):
                    work += self._in_bytes(data, f"{chain}url>", seen, streams_only=True)
                work += (x for run, _, _ in _runs(text) for x in self._in_run(run, chain, seen))
        return self.known[key]

    def _in_run(self, run: str, chain: str, seen: set[bytes]) -> Iterator[tuple[str, str]]:
        run = run.rstrip("=").replace("-", "+").replace("_", "/")
        for first in range(4):
            part = run[first : len(run) - ((len(run) - first) % 4 == 1)]
            data = base64.b64decode(part + "=" * (-len(part) % 4))
            if first == 0 and (text := _readable(data)) is not None:
                if self._new(data, seen):
                    yield text, f"{chain}base64>"
                return
            yield from self._in_bytes(data, f"{chain}base64>", seen)

    def _new(self, data: bytes, seen: set[bytes]) -> bool:
        key = hashlib.blake2b(data, digest_size=16).digest()
        if key in seen:
            return False
        seen.add(key)
        return True

    def _in_bytes(self, data: bytes, chain: str, seen: set[bytes], streams_only: bool = False) -> Iterator[tuple[str, str]]:
        """The texts in bytes: all of them, or their printable stretches and what their compressed streams hold."""
        work = [(data, chain, streams_only)]
        while work:
            data, chain, streams_only = work.pop()
            if not self._new(data, seen):
                continue
            if not streams_only and (text := _readable(data)) is not None:
                yield text, chain
                continue
            view, at = memoryview(data), 0
            while m := _STREAM.search(data, at):
                at = m.start() + 1
                try:
                    if held := _inflated(view[m.start() :], self.max_layer):
                        work.append((held[0], f"{chain}compressed>", False))
                        at = m.start() + max(1, held[1])
                except _TooLarge:
                    self.left += 1
            if not streams_only and (parts := [p[1::2] if p[:1] == b"\0" else p[::2] if p[1:2] == b"\0" else p for p in _STRETCH.findall(data)]):
                yield "\n\n".join(p.decode("ascii") for p in parts), chain


def _runs(text: str) -> Iterator[tuple[str, int, int]]:
    """Base64 runs and their places: each as it stands, and those that stand on lines of one length joined."""
    for m in _BASE64.finditer(text):
        yield m[0], m.start(), m.end()
    if "\n" in text:
        for m in _WRAPPED.finditer(text):
            lines = [(x[0], m.start() + x.start(), m.start() + x.end()) for x in re.finditer(r"\S+", m[0])]
            first = 0
            while first < len(lines):  # a block: lines as long as its first, and one that may be shorter
                size, last = len(lines[first][0]), first + 1
                while last < len(lines) and len(lines[last][0]) == size:
                    last += 1
                stop = last + (last < len(lines) and len(lines[last][0]) < size)
                if stop - first > 1 and size >= 16:
                    yield "".join(x for x, *_ in lines[first:stop]), lines[first][1], lines[stop - 1][2]
                first = last


def _quoted(text: str) -> Iterator[tuple[bytes, int, int]]:
    """The bytes of percent-encoded runs that may hold compressed streams, and the runs' places."""
    if "%" in text:
        for m in _QUOTED.finditer(text):
            if "%" in m[0] and _STREAM.search(data := unquote_to_bytes(m[0])):
                yield data, m.start(), m.end()


def scan(text: str | None, max_layer: int = MAX_LAYER) -> tuple[list[Span], list[Span], int]:
    """(base spans, spans that only a decoded layer shows, streams left packed). The second ones' kinds name the layers, as in url>assign."""
    text = text or ""
    base = scan_layer(text)
    have, added, packed = set(base), {}, _Packed(max_layer)

    def add(s, e, k, name):
        if (s, e, k) not in have:
            have.add((s, e, k))
            added[s, e, k] = (s, e, name)

    for run, s, e in _runs(text):
        for k, name in packed.kinds(run).items():
            add(s, e, k, name)
    for data, s, e in _quoted(text):
        for k, name in packed.kinds(data).items():
            add(s, e, k, name)
    plain = _Unescaped(text)
    if plain.changed:
        for s, e, k in scan_layer(plain.text):
            start, end, chain = plain.outer(s, e)
            add(start, end, k, chain + k)
        for run, s, e in _runs(plain.text):
            start, end, chain = plain.outer(s, e)
            for k, name in packed.kinds(run).items():
                add(start, end, k, chain + name)
    return base, sorted(added.values()), packed.left


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in spans)


def scan_secrets(df: DataFrame, text: str = "text", id_col: str = "doc_id", max_layer: int = MAX_LAYER) -> DataFrame:
    """Per row: id, counts of the base kinds, the base spans' digest, all spans, how many only layers show, streams left packed.

    No shuffle; one pass over the text."""

    def run(batches):
        for b in batches:
            rows = [scan(t, max_layer) for t in texts(b)]
            kinds = [[k for *_, k in base] for base, *_ in rows]
            cols = [b.column("id")] + [pa.array([k.count(x) for k in kinds], pa.int64()) for x in KINDS]
            cols.append(pa.array([hashlib.sha256(joined(base).encode()).hexdigest() for base, *_ in rows], pa.string()))
            cols.append(pa.array([joined(sorted(base + more, key=lambda s: (s[0], KINDS.index(s[2]) if s[2] in KINDS else 9, s[1], s[2]))) for base, more, _ in rows], pa.string()))
            cols.append(pa.array([len(more) for _, more, _ in rows], pa.int64()))
            cols.append(pa.array([left for *_, left in rows], pa.int64()))
            yield pa.RecordBatch.from_arrays(cols, names=[id_col, "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_layered", "n_left_packed"])

    src = df.select(df[id_col].cast("long").alias("id"), df[text].cast("string").alias("text"))
    return src.mapInArrow(tidy(run), f"`{id_col}` long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_layered long, n_left_packed long")
