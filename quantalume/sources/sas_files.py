"""A writer of SAS data sets (SAS7BDAT), from the public descriptions of the layout: 32-bit pages, little-endian, UTF-8."""

from __future__ import annotations

import os
import re
import struct
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .stat_files import _SAS_DAYS

# The first bytes of a file, subheader signatures, the missing number '.'.
_MAGIC = bytes.fromhex("000000000000000000000000c2ea8160b31411cfbd92080009c7318c181f1011")
_ROW_SIZE, _COLUMN_SIZE, _TEXT, _NAMES, _ATTRIBUTES, _FORMAT = 0xF7F7F7F7, 0xF6F6F6F6, 0xFFFFFFFD, 0xFFFFFFFF, 0xFFFFFFFC, 0xFFFFFBFE
_MISSING = np.uint64(0xFFFFFE0000000000)
_HEADER, _PAGE, _PAGE_HEAD, _POINTER = 1024, 65_536, 24, 12
#: Bytes of a text block, whose offsets have 16 bits, and columns of one subheader.
_BLOCK, _COLUMNS = 30_000, 2000
_RUN = re.compile(rb"\x00{3,}| {3,}|([^\x00 ])\1{3,}", re.S)


class _Texts:
    """Names, labels and formats in numbered blocks; a text is (block, offset, length)."""

    def __init__(self, compressed: bool):
        # a block begins with its size; the first one names the compression
        self.blocks = [bytearray(12) + bytearray(b"SASYZCRL" if compressed else b" " * 8) + bytearray(40)]

    def add(self, text: bytes) -> tuple[int, int, int]:
        if len(self.blocks[-1]) + len(text) > _BLOCK:
            self.blocks.append(bytearray(4))
        block = self.blocks[-1]
        at = len(block)
        block += text + bytes(-len(text) % 4)
        return len(self.blocks) - 1, at, len(text)

    def subheaders(self) -> list[bytes]:
        return [struct.pack("<IH", _TEXT, len(b)) + bytes(b[2:]) for b in self.blocks]


def squeeze(row: bytes) -> bytes:
    """A row in run-length commands; as it is where they don't make it shorter."""
    out = []

    def copy(part: bytes) -> None:
        for i in range(0, len(part), 64):
            piece = part[i : i + 64]
            out.append(bytes([0x80 + len(piece) - 1]) + piece)

    at = 0
    for m in _RUN.finditer(row):
        copy(row[at : m.start()])
        n, byte, at = m.end() - m.start(), row[m.start()], m.end()
        if m[1]:
            while n >= 3:
                k = n if n <= 18 else min(18, n - 3)
                out.append(bytes([0xC0 + k - 3, byte]))
                n -= k
            continue
        short, long = (0xE0, 0x60) if byte == 32 else (0xF0, 0x70)
        while n:
            k = n if n <= 4112 else min(4112, n - 2)
            out.append(bytes([short + k - 2]) if k < 17 else bytes([long + (k - 17 >> 8), k - 17 & 255]))
            n -= k
    copy(row[at:])
    packed = b"".join(out)
    return packed if len(packed) < len(row) else row


def _page(kind: int, pointers: list[tuple[int, int, int, int]], blocks: int, parts: list[tuple[int, bytes]], size: int) -> bytes:
    page = bytearray(size)
    struct.pack_into("<HHH", page, 16, kind, blocks, len(pointers))
    for i, p in enumerate(pointers):
        struct.pack_into("<IIBB", page, _PAGE_HEAD + i * _POINTER, *p)
    for at, part in parts:
        page[at : at + len(part)] = part
    return bytes(page)


def _row_pages(bodies: Iterator[tuple[int, bytes]], width: int, size: int, compressed: bool) -> Iterator[tuple[int, bytes]]:
    """(rows, page) of encoded rows."""
    if not compressed:
        most, rest = min((size - _PAGE_HEAD) // width, 0xFFFF), b""
        for _, body in bodies:
            rest += body
            whole = len(rest) // (most * width) * most * width
            for at in range(0, whole, most * width):
                yield most, _page(0x100, [], most, [(_PAGE_HEAD, rest[at : at + most * width])], size)
            rest = rest[whole:]
        if rest:
            yield len(rest) // width, _page(0x100, [], len(rest) // width, [(_PAGE_HEAD, rest)], size)
        return
    # rows are subheaders: pointers grow from the head, rows from the end
    pointers, parts, end = [], [], size
    for _, body in bodies:
        at = 0
        while at < len(body):
            (n,) = struct.unpack_from("<I", body, at)
            row, at = body[at + 4 : at + 4 + n], at + 4 + n
            if end - n < _PAGE_HEAD + (len(pointers) + 1) * _POINTER:
                yield len(pointers), _page(0, pointers, len(pointers), parts, size)
                pointers, parts, end = [], [], size
            end -= n
            pointers.append((end, n, 4, 1))
            parts.append((end, row))
    if pointers:
        yield len(pointers), _page(0, pointers, len(pointers), parts, size)


def write_sas7bdat(df: DataFrame, path: str, label: str = "", compression: str = "none") -> int:
    """Write a SAS data set and return the number of rows; NULL numbers become missing, NULL texts blank.

    Names may have 32 characters, texts 32,767 bytes, labels 256; longer ones
    raise. ``compression``: none, or rows (rle). The head tells the number of
    rows (or of pages), so a first pass counts rows and longest texts, and with
    compression pages; then tasks encode the rows and the driver appends them.
    """
    from .xpt import check_types, checked_name, encoded_rows, longest_texts, output, padded

    compression = {"rle": "rows"}.get(compression.lower(), compression.lower())
    if compression not in ("none", "rows"):
        raise ValueError(f"SAS7BDAT COMPRESSION must be 'none' or 'rows', got '{compression}'")
    if len(label.encode()) > 256:
        raise ValueError("LABEL is too long for SAS7BDAT")
    check_types(df)
    compressed = compression == "rows"
    fields = df.schema.fields
    names = [checked_name(f.name, "SAS7BDAT", 32, upper=False) for f in fields]
    if len({n.upper() for n in names}) < len(names):
        raise ValueError("column names must differ in SAS7BDAT, whatever their case")
    longest = longest_texts(df)
    texts, shapes, entries = _Texts(compressed), [], []
    # eight zero bytes lead a compressed row, so that no row begins like another subheader
    at = 8 if compressed else 0
    order = sorted(range(len(fields)), key=lambda i: fields[i].name in longest)  # numbers first, as they are aligned
    places = {}
    for i in order:
        width = max(1, longest[fields[i].name] or 1) if fields[i].name in longest else 8
        if width > 32_767:
            raise ValueError(f"column '{fields[i].name}' holds a text of {width} bytes; SAS7BDAT takes 32767")
        places[i] = (at, width)
        at += width
    row_width = at
    for i, f in enumerate(fields):
        kind = f.dataType.typeName()
        day, stamp = kind == "date", kind.startswith("timestamp")
        shown = b"DATE" if day else b"DATETIME" if stamp else b"TIME" if kind.startswith("time") else b""
        comment = (f.metadata or {}).get("comment", "").encode()
        if len(comment) > 256:
            raise ValueError(f"label of column '{f.name}' is too long for SAS7BDAT")
        shapes.append((f.name in longest, _SAS_DAYS if day else _SAS_DAYS * 86400 if stamp else 0))
        entries.append((texts.add(names[i].encode()), texts.add(shown), texts.add(comment)))
    file_label = texts.add(label.encode())
    n = len(fields)
    subheaders = texts.subheaders()
    for first in range(0, n, _COLUMNS):
        part = range(first, min(first + _COLUMNS, n))
        body = b"".join(struct.pack("<HHHH", *entries[i][0], 0) for i in part)
        subheaders.append(struct.pack("<IHHI", _NAMES, len(body) + 8, 0, 0) + body + bytes(8))
        body = b"".join(struct.pack("<IIHBB", *places[i], 0x400 if len(names[i]) <= 8 else 0x800, 2 if shapes[i][0] else 1, 0) for i in part)
        subheaders.append(struct.pack("<IHHI", _ATTRIBUTES, len(body) + 8, 0, 0) + body + bytes(8))
    for _, shown, comment in entries:
        subheaders.append(struct.pack("<I", _FORMAT) + bytes(30) + struct.pack("<HHHHHH", *shown, *comment) + bytes(6))
    total = _PAGE_HEAD + (len(subheaders) + 2) * _POINTER + 480 + 28 + sum(len(s) for s in subheaders)
    size = -(-max(_PAGE, total, _PAGE_HEAD + _POINTER + row_width) // 1024) * 1024

    def encode(columns: list) -> bytes:
        cells: list = [np.zeros((len(columns[0]), 8), np.uint8)] if compressed else []
        for i in order:
            text, days = shapes[i]
            if text:
                cells.append(padded(columns[i], places[i][1]))
                continue
            y = np.asarray(columns[i], np.float64) + days
            cells.append(np.where(np.isnan(y), _MISSING, y.view(np.uint64)).astype("<u8")[:, None].view(np.uint8))
        table = np.concatenate(cells, axis=1).tobytes()
        if not compressed:
            return table
        rows = (squeeze(table[a : a + row_width]) for a in range(0, len(table), row_width))
        return b"".join(struct.pack("<I", len(r)) + r for r in rows)

    rows = df.agg(F.count("*").alias("n")).first()["n"]
    if rows >= 1 << 32:
        raise ValueError("SAS7BDAT with 32-bit pages takes fewer than 2^32 rows")
    if compressed:
        pages = sum(1 for _ in _row_pages(encoded_rows(df, encode), row_width, size, True))
    else:
        most = min((size - _PAGE_HEAD) // row_width, 0xFFFF)
        pages = -(-rows // most)
    head = bytearray(_HEADER)
    head[:32] = _MAGIC
    head[32:40] = bytes([0x22, 0, 0, 0x22, 0, 1, 0, ord("1")])
    head[70] = 20  # UTF-8
    name = re.sub(r"\W", "_", os.path.splitext(os.path.basename(path))[0], flags=re.A)[:32].upper() or "DATASET"
    head[84:92], head[92:156], head[156:164] = b"SAS FILE", name.encode().ljust(64), b"DATA    "
    struct.pack_into("<dd", head, 164, 0.0, 0.0)
    struct.pack_into("<III", head, 196, _HEADER, size, pages + 1)
    head[216:224], head[224:240], head[256:272], head[272:288] = b"9.0401M6", b"Linux".ljust(16), b"".ljust(16), b"".ljust(16)
    row_size = bytearray(480)
    struct.pack_into("<I", row_size, 0, _ROW_SIZE)
    for place, value in ((20, row_width), (24, rows), (36, n), (52, size)):
        struct.pack_into("<I", row_size, place, value)
    struct.pack_into("<HHH", row_size, 350, *file_label)
    if compressed:
        struct.pack_into("<HHH", row_size, 362, 0, 12, 8)  # where the first block names it
    subheaders = [bytes(row_size), struct.pack("<II", _COLUMN_SIZE, n) + bytes(4), *subheaders]
    pointers, parts, end = [], [], size
    for s in subheaders:
        end -= len(s) + (-len(s) % 4)
        pointers.append((end, len(s), 0, 1 if s[:4] in (struct.pack("<I", t) for t in (_TEXT, _NAMES, _ATTRIBUTES)) else 0))
        parts.append((end, s))
    written = wrote_pages = 0
    with output(df.sparkSession, path) as out:
        out.write(bytes(head))
        out.write(_page(0, pointers, len(pointers), parts, size))
        for k, page in _row_pages(encoded_rows(df, encode), row_width, size, compressed):
            out.write(page)
            written += k
            wrote_pages += 1
    if (written, wrote_pages) != (rows, pages):
        raise ValueError(f"'{path}': the query gave {rows} rows at first and {written} when written; write its result to a table before")
    return written
