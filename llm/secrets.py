"""Secret scans that look through encodings.

A worklist holds layers of a document: the text itself, and each text that decoding a part of another layer gives.  Every
layer is scanned with the same patterns, and every layer is unwrapped again, until nothing new appears:

* percent escapes and Unicode escapes are decoded in place, so that a match may lie across escaped and plain characters;
* stretches of base64 (both alphabets; lines of equal width are joined) become layers of their own, after decompression if
  they hold gzip, zlib, bzip2, xz or zstd data.  They are read from each of the first four letters on, so that letters
  glued to the front don't matter, and compressed data from each place where it may start.  Bytes that are no text
  stand for themselves; a layer without ASCII characters enough for a secret is left out.  UTF-16 is a layer too.

Each character of a layer knows the span of the document that it came from, so each match is reported as a span of
the document; of compressed data it is the whole stretch.  A layer that was seen before is not opened again, which ends
cycles.  ``max_bytes`` bounds what a document's compressed parts may unfold to; parts beyond it are counted in n_unopened.
"""

from __future__ import annotations

import base64
import bz2
import hashlib
import lzma
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.common import batch_rows, texts

KINDS = ("assign", "access", "hex")
MAX_BYTES = 1 << 26
MARK = "[secret]"
SCHEMA = ("doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_layers long, "
          "n_unopened long")

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                     re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
_UNICODE = re.compile(r"\\u\{([0-9A-Fa-f]{1,6})\}|\\u([0-9A-Fa-f]{4})|\\U([0-9A-Fa-f]{8})|\\x([0-9A-Fa-f]{2})")
_BASE64 = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}={0,2}")
_WRAPPED = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}(?:\r?\n[ \t]*[A-Za-z0-9+/_-]+)+")
_LETTERS = re.compile(r"[A-Za-z0-9+/_-]+")
_PACKED = re.compile(r"H4sI|Qlpo|/Td6WFoA|KLUv/|(?:(?<=[/+])|^)e[A-P]")  # beginnings of compressed data; zlib's after a mark only
_ENOUGH = re.compile(rb"[\x09-\x0d\x20-\x7e]{12}")  # no secret, open or encoded, is shorter


@dataclass
class Layer:
    """A text, and for each of its characters where it starts and ends in the document (None: the same place)."""

    text: str
    start: np.ndarray | None = None
    end: np.ndarray | None = None

    def span(self, a: int, b: int) -> tuple[int, int]:
        return (a, b) if self.start is None else (int(self.start[a]), int(self.end[b - 1]))

    def places(self) -> tuple[np.ndarray, np.ndarray]:
        if self.start is None:
            at = np.arange(len(self.text) + 1)
            return at[:-1], at[1:]
        return self.start, self.end


def matches(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's number, end) of the matches in one layer, sorted."""
    found = []
    low = text.lower()
    if any(w in low for w in _WORDS):
        found += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(found)


def unescaped(layer: Layer) -> Iterator[Layer]:
    """The layer with its percent escapes, or its Unicode escapes, decoded."""
    if "%" in layer.text and (found := list(_PERCENT.finditer(layer.text))):
        yield _replaced(layer, [(m.start(), m.end(), *_decoded_escapes(m[0])) for m in found])
    if "\\" in layer.text and (found := list(_UNICODE.finditer(layer.text))):
        parts = []
        for m in found:
            point = int(m[m.lastindex], 16)
            if point < 0x110000 and not 0xD800 <= point < 0xE000:
                parts.append((m.start(), m.end(), chr(point), [0], [m.end() - m.start()]))
        if parts:
            yield _replaced(layer, parts)


def _decoded_escapes(run: str) -> tuple[str, list[int], list[int]]:
    text, starts, ends = _characters(bytes.fromhex(run.replace("%", "")))
    return text, [3 * s for s in starts], [3 * e for e in ends]


def _characters(data: bytes) -> tuple[str, list[int], list[int]]:
    """UTF-8 data as text, with the first byte and the end of each character; bad bytes stand for themselves."""
    text = data.decode("utf-8", errors="surrogateescape")
    starts, ends, at = [], [], 0
    for c in text:
        n = 1 if "\ud800" <= c <= "\udfff" else len(c.encode())
        starts.append(at)
        at += n
        ends.append(at)
    return "".join("�" if "\ud800" <= c <= "\udfff" else c for c in text), starts, ends


def _replaced(layer: Layer, parts: list[tuple[int, int, str, list[int], list[int]]]) -> Layer:
    """A layer with parts (start, end, new text, start and end of each new character within the part) exchanged."""
    start, end = layer.places()
    text, first, last, at = [], [], [], 0
    for a, b, new, starts, ends in parts:
        text += [layer.text[at:a], new]
        first += [start[at:a], start[a + np.array(starts, np.int64)]]
        last += [end[at:a], end[a + np.array(ends, np.int64) - 1]]
        at = b
    text.append(layer.text[at:])
    return Layer("".join(text), np.concatenate([*first, start[at:]]), np.concatenate([*last, end[at:]]))


def unfolded(data: bytes, limit: int) -> bytes | None:
    """Decompressed data (of all its members); the data as it is if it is not compressed; None if it unfolds to more than
    ``limit`` bytes."""
    if data[:4] == b"\x28\xb5\x2f\xfd":
        import zstandard

        out, size = [], 0
        try:
            with zstandard.ZstdDecompressor().stream_reader(data, read_across_frames=True) as stream:
                while size <= limit and (part := stream.read(min(1 << 16, limit + 1 - size))):
                    out.append(part)
                    size += len(part)
        except zstandard.ZstdError:
            pass  # what came before it stays
        return None if size > limit else b"".join(out) or data
    out, size, rest = [], 0, data
    while opener := _opener(rest):
        try:
            part = opener.decompress(rest, limit + 1 - size)
        except (zlib.error, OSError, lzma.LZMAError, EOFError):
            break
        out.append(part)
        size += len(part)
        if size > limit:
            return None
        if not opener.eof:
            break
        rest = opener.unused_data
    return b"".join(out) or data


def _opener(data: bytes):
    if data[:2] == b"\x1f\x8b" or data[:1] == b"\x78" and len(data) > 6 and int.from_bytes(data[:2], "big") % 31 == 0:
        return zlib.decompressobj(zlib.MAX_WBITS | 32)
    if data[:3] == b"BZh":
        return bz2.BZ2Decompressor()
    if data[:6] == b"\xfd7zXZ\x00":
        return lzma.LZMADecompressor()
    return None


def stretches(text: str) -> Iterator[tuple[str, np.ndarray]]:
    """Letters of base64 in the standard alphabet, and where each stands: of each run, and of runs on lines of equal width."""
    alphabet = {0x2D: "+", 0x5F: "/"}
    for m in _BASE64.finditer(text):
        body = m[0].rstrip("=")
        yield body.translate(alphabet), np.arange(m.start(), m.start() + len(body))
    if "\n" not in text:
        return
    for m in _WRAPPED.finditer(text):
        lines = [(m.start() + x.start(), x[0]) for x in _LETTERS.finditer(m[0])]
        k = 0
        while k + 1 < len(lines):
            last, wide = k, len(lines[k][1])
            while last + 1 < len(lines) and len(lines[last][1]) == wide >= len(lines[last + 1][1]):
                last += 1
            if last > k and wide >= 16:
                part = lines[k:last + 1]
                yield ("".join(x for _, x in part).translate(alphabet),
                       np.concatenate([np.arange(at, at + len(x)) for at, x in part]))
            k = max(last, k + 1)


def _bytes(letters: str) -> bytes:
    letters = letters[:-1] if len(letters) % 4 == 1 else letters
    return base64.b64decode(letters + "=" * (-len(letters) % 4))


def _wide(data: bytes) -> Iterator[tuple[bytes, int]]:
    """ASCII text that stands in every second byte between zeros (UTF-16), and the place of its first byte."""
    if data.count(0) * 4 >= len(data):
        for m in re.finditer(rb"(?:[\x09-\x0d\x20-\x7e]\x00){12,}", data):
            yield m[0][::2], m.start()
        for m in re.finditer(rb"(?:\x00[\x09-\x0d\x20-\x7e]){12,}", data):
            yield m[0][1::2], m.start()


def decoded(layer: Layer, budget: list[int]) -> Iterator[Layer]:
    """The texts in the layer's stretches of base64.  budget: bytes that may still be unfolded, and parts left closed."""
    start, end = layer.start, layer.end
    for letters, where in stretches(layer.text):
        if start is None:
            start, end = layer.places()
        for at in sorted({m.start() for m in _PACKED.finditer(letters)}):
            data = whole = _bytes(letters[at:])
            while True:  # compressed data may be compressed again
                opened = unfolded(whole, budget[0])
                if opened is None:
                    budget[1] += 1
                    break
                if opened is whole:
                    break
                budget[0] -= len(opened)
                whole = opened
            if opened is None or whole is data:
                continue
            a, b = int(start[where[at]]), int(end[where[-1]])
            for part in [whole] * bool(_ENOUGH.search(whole)) + [x for x, _ in _wide(whole)]:
                text = _characters(part)[0]
                yield Layer(text, np.full(len(text), a), np.full(len(text), b))
        for at in range(4):
            data = _bytes(letters[at:])
            if _ENOUGH.search(data):
                text, starts, ends = _characters(data)
                yield _placed(text, np.array(starts), np.array(ends), start, end, where[at:])
            for part, first in _wide(data):
                starts = first + 2 * np.arange(len(part))
                yield _placed(part.decode(), starts, starts + 2, start, end, where[at:])


def _placed(text: str, starts: np.ndarray, ends: np.ndarray, start: np.ndarray, end: np.ndarray, where: np.ndarray) -> Layer:
    """A layer whose characters are these bytes of decoded base64, whose letters stand at ``where``."""
    return Layer(text, start[where[starts * 8 // 6]], end[where[-(-ends * 8 // 6) - 1]])


def scan(text: str, max_bytes: int = MAX_BYTES) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]], int, int]:
    """(matches in the text itself, those of all layers as spans of the text, number of layers, parts left closed)."""
    base = matches(text)
    spans, seen, budget, work = set(base), set(), [max_bytes, 0], [Layer(text)]
    n = 0
    while work:
        layer = work.pop()
        a, b = layer.span(0, len(layer.text)) if layer.text else (0, 0)
        key = (hashlib.blake2b(layer.text.encode("utf-8", "surrogatepass"), digest_size=16).digest(), a, b) if n else None
        if key in seen:
            continue
        seen.add(key)
        n += 1
        if n > 1:
            for s, kind, e in matches(layer.text):
                s, e = layer.span(s, e)
                spans.add((s, kind, e))
        work.extend(unescaped(layer))
        work.extend(decoded(layer, budget))
    return base, sorted(spans), n, budget[1]


def _listed(found: list[tuple[int, int, int]]) -> str:
    return ",".join([f"{KINDS[kind]}:{start}:{end}" for start, kind, end in found])


def secret_spans(docs: DataFrame, max_bytes: int = MAX_BYTES) -> DataFrame:
    """One row per row of ``docs``: numbers of secrets of each kind in the text itself, SHA-256 of their list, the list of all
    spans (those in decoded layers too), the number of layers, and the compressed parts left closed.

    Spans count code points.  A null text is empty and has none; repeated rows are scanned each on its own; an empty
    table gives no rows; other columns are ignored.
    """
    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batch_rows(batches, 512):
            rows = []
            for text in batch["text"].to_pylist():
                base, spans, layers, closed = scan(text, max_bytes)
                kinds = [kind for _, kind, _ in base]
                rows.append((*(kinds.count(k) for k in range(3)), hashlib.sha256(_listed(base).encode()).hexdigest(),
                             _listed(spans), layers, closed))
            types = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64()] * 2
            columns = zip(*rows, strict=True) if rows else [[]] * 7
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], *(pa.array(c, t) for c, t in zip(columns, types, strict=True))],
                names=[f.split()[0] for f in SCHEMA.split(", ")])

    return texts(docs).select(F.col("doc_id").cast("long"), "text").mapInArrow(scanned, SCHEMA)


def redacted(text: str, max_bytes: int = MAX_BYTES) -> str:
    """The text with every secret, overlapping ones together, replaced by MARK."""
    spans = scan(text, max_bytes)[1]
    out, at, k = [], 0, 0
    while k < len(spans):
        start, _, end = spans[k]
        while k < len(spans) and spans[k][0] < end:
            end = max(end, spans[k][2])
            k += 1
        out += [text[at:start], MARK]
        at = end
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, max_bytes: int = MAX_BYTES) -> DataFrame:
    """``docs`` with secrets in ``text`` replaced by MARK, and n_chars (if there is one) to match; null texts stay."""
    has_length = "n_chars" in docs.columns

    def cleaned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batch_rows(batches, 512):
            old = batch["text"].to_pylist()
            new = [None if t is None else redacted(t, max_bytes) for t in old]
            at = batch.schema.get_field_index("text")
            batch = batch.set_column(at, batch.schema.field(at), pa.array(new, batch.schema.field(at).type))
            if has_length:
                at = batch.schema.get_field_index("n_chars")
                lengths = [n if a == b else len(b) for n, a, b in zip(batch["n_chars"].to_pylist(), old, new, strict=True)]
                batch = batch.set_column(at, batch.schema.field(at), pa.array(lengths, batch.schema.field(at).type))
            yield batch

    return docs.mapInArrow(cleaned, docs.schema)
