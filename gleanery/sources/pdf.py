"""Text of PDF files without a library: pages in order, text operators of their content streams.

Covers streams without a filter or with Flate, strings in brackets or hexadecimal, and fonts with a one-byte encoding
that agrees with ASCII. Encrypted files and fonts with encodings of their own give no text and are unsupported, like
scanned pages. An installed reader (pypdf) is preferred.
"""

from __future__ import annotations

import re
import zlib

from gleanery.sources.markup import normalised

_OBJECT = re.compile(rb"(?<!\d)(\d+)\s+\d+\s+obj\b(.*?)\bendobj", re.DOTALL)
_STREAM = re.compile(rb"\bstream\r?\n(.*?)\r?\n?endstream", re.DOTALL)
_TOKEN = re.compile(rb"\((?:\\.|[^\\()])*\)|<[0-9A-Fa-f\s]*>|\[|\]|[-+]?\d*\.?\d+|[A-Za-z'\"*]+", re.DOTALL)
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


def _string(token: bytes) -> str:
    if token[:1] == b"<":
        digits = re.sub(rb"\s", b"", token[1:-1])
        return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode()).decode("latin-1")
    octal = lambda m: bytes([int(m[1], 8) & 255]) if m[1].isdigit() else _ESCAPES.get(m[1], b"" if m[1] in b"\r\n" else m[1])
    return re.sub(rb"\\([0-7]{1,3}|.)", octal, token[1:-1], flags=re.DOTALL).decode("latin-1")


def _shown(content: bytes) -> str:
    """Text of a content stream; moves to another line end lines."""
    out, waiting = [], []
    for token in _TOKEN.findall(content):
        if token[:1] in b"(<":
            waiting.append(_string(token))
        elif token in (b"Tj", b"TJ"):
            out += waiting
            waiting = []
        elif token in (b"'", b'"'):
            out += ["\n", *waiting]
            waiting = []
        elif token in (b"Td", b"TD", b"T*", b"Tm", b"ET"):
            out.append("\n")
        elif token[:1].isalpha():
            waiting = []
    return "".join(out)


def _content(body: bytes) -> bytes:
    found = _STREAM.search(body)
    if not found:
        return b""
    return zlib.decompress(found[1]) if b"/FlateDecode" in body[: found.start()] else found[1]


def read(body: bytes, max_pages: int | None = None) -> dict:
    """``text, status, error, pages, pages_read`` of a PDF file."""
    none = {"text": "", "status": "unsupported", "error": "unreadable PDF", "pages": None, "pages_read": None}
    if not body.startswith(b"%PDF-") or b"/Encrypt" in body:
        return none
    try:
        objects = {int(m[1]): m[2] for m in _OBJECT.finditer(body)}
        pages = [b for _, b in sorted(objects.items()) if re.search(rb"/Type\s*/Page\b", b)]
        order = next((re.findall(rb"(\d+)\s+\d+\s+R", m[1]) for b in objects.values() if (m := re.search(rb"/Kids\s*\[(.*?)\]", b, re.DOTALL))), [])
        pages = [objects[int(k)] for k in order if int(k) in objects] or pages
        read_ = pages[:max_pages] if max_pages else pages
        texts = []
        for page in read_:
            named = re.search(rb"/Contents\s*(\[.*?\]|\d+\s+\d+\s+R)", page, re.DOTALL)
            parts = re.findall(rb"(\d+)\s+\d+\s+R", named[1]) if named else []
            texts.append("\n".join(_shown(_content(objects.get(int(k), b""))) for k in parts))
    except (ValueError, zlib.error):
        return none
    text = normalised("\n".join(texts))
    good = bool(text)
    return {
        "text": text,
        "status": "ok" if good else "unsupported",
        "error": None if good else "no text in the PDF",
        "pages": len(pages),
        "pages_read": len(read_),
    }


def written(lines: list[str]) -> bytes:
    """A small PDF file with one line on each page, for tests and demonstrations."""
    objects = [
        "<< /Type /Catalog /Pages 2 0 R >>".encode(),
        b"<< /Type /Pages /Count %d /Kids [%s] >>" % (len(lines), b" ".join(b"%d 0 R" % (4 + 2 * k) for k in range(len(lines)))),
        b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica >>",
    ]
    for k, line in enumerate(lines):
        shown = re.sub(r"([\\()])", r"\\\1", line).encode("latin-1")
        stream = zlib.compress(b"BT /F1 12 Tf 72 720 Td (" + shown + b") Tj ET")
        objects.append(b"<< /Type /Page /Parent 2 0 R /Resources << /Font << /F1 3 0 R >> >> /Contents %d 0 R >>" % (5 + 2 * k))
        objects.append(b"<< /Length %d /Filter /FlateDecode >>\nstream\n" % len(stream) + stream + b"\nendstream")
    out, places = b"%PDF-1.4\n", []
    for k, body in enumerate(objects, 1):
        places.append(len(out))
        out += b"%d 0 obj\n" % k + body + b"\nendobj\n"
    table = b"".join(b"%010d 00000 n \n" % p for p in places)
    return out + b"xref\n0 %d\n0000000000 65535 f \n" % (len(objects) + 1) + table + b"trailer << /Size %d /Root 1 0 R >>\nstartxref\n%d\n%%%%EOF\n" % (len(objects) + 1, len(out))
