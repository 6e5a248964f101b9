"""SAS transport (XPORT versions 5 and 8) files, from the public layout.

Records are 80 bytes; variables are described by 140-byte NAMESTR entries;
observations are fixed-width rows, decoded with numpy a range at a time; missing numbers (a letter or '.' or '_' in the
first byte, zeros after) become NULL.
"""

from __future__ import annotations

import datetime
import os
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from . import stat_files

RECORD = 80
_HEADER = b"HEADER RECORD*******%s HEADER RECORD!!!!!!!"
_EPOCH = datetime.date(1960, 1, 1).toordinal() - datetime.date(1970, 1, 1).toordinal()
#: Bytes that are read and decoded at once, and the most tasks of a scan.
RANGE_BYTES, TASKS = 2 << 20, 10_000
# SAS formats of dates, datetimes and times.
_DATES = ("DATE", "DDMMYY", "MMDDYY", "YYMMDD", "E8601DA", "B8601DA", "JULIAN", "MONYY", "WEEKDATE", "WORDDATE", "YYMON", "IS8601DA")
_DATETIMES = ("DATETIME", "E8601DT", "B8601DT", "DATEAMPM", "IS8601DT")
_TIMES = ("TIME", "HHMM", "E8601TM", "B8601TM", "TOD", "IS8601TM")
EXTENSIONS = {".xpt": "xpt", ".sas7bdat": "sas7bdat", ".sav": "sav", ".zsav": "zsav", ".por": "por", ".dta": "dta"}


def ibm_to_ieee(raw: np.ndarray) -> np.ndarray:
    """IBM hexadecimal doubles (n, 8) uint8 as float64; missing values as NaN."""
    word = np.ascontiguousarray(raw).view(">u8")[:, 0].astype(np.uint64)
    mantissa = (word & np.uint64(0x00FFFFFFFFFFFFFF)).astype(np.float64)
    exponent = ((word >> np.uint64(56)) & np.uint64(0x7F)).astype(np.int64) - 64
    value = np.ldexp(mantissa, (4 * exponent - 56).astype(np.int32))
    value = np.where(word >> np.uint64(63), -value, value)
    missing = ((word & np.uint64(0x00FFFFFFFFFFFFFF)) == 0) & (word != 0) & (word != np.uint64(1 << 63))
    return np.where(missing, np.nan, value)


def ieee_to_ibm(values: np.ndarray) -> np.ndarray:
    """float64 as IBM hexadecimal doubles (n, 8) uint8; NaN and infinities as missing ('.')."""
    v = np.asarray(values, np.float64)
    good = np.isfinite(v) & (v != 0)
    fraction, exponent = np.frexp(np.where(good, np.abs(v), 1.0))
    four = -(-exponent // 4)
    mantissa = np.ldexp(fraction, 56 - (4 * four - exponent)).astype(np.uint64)
    word = ((four + 64).astype(np.uint64) << np.uint64(56)) | mantissa | (np.signbit(v).astype(np.uint64) << np.uint64(63))
    word = np.where(good, word, np.where(v == 0, np.uint64(0), np.uint64(0x2E << 56)))
    return word.astype(">u8")[:, None].view(np.uint8)


class Layout:
    """Names, types, positions and row range of the first data set in a file."""

    def __init__(self, head: bytes, size: int, path: str):
        long = head.startswith(_HEADER % b"LIBV8  ")
        if not long and not head.startswith(_HEADER % b"LIBRARY"):
            raise ValueError(f"Failed to read '{path}': not a SAS transport file")
        at = head.find(_HEADER % (b"NAMSTV8" if long else b"NAMESTR"))
        if at < 0:
            raise ValueError(f"Failed to read '{path}': no variable descriptors")
        count, width = int(head[at + 54 : at + 58]), 140
        member = head.find(_HEADER % (b"MEMBV8 " if long else b"MEMBER "))
        if member >= 0 and head[member + 75 : member + 78].strip().isdigit():
            width = int(head[member + 75 : member + 78])
        at += RECORD
        self.variables = []
        for i in range(count):
            e = head[at + i * width : at + (i + 1) * width]
            kind, _, length, _ = struct.unpack(">hhhh", e[:8])
            text = lambda a, b, e=e: e[a:b].decode("utf-8", "replace").rstrip(" \0")
            (position,) = struct.unpack(">i", e[84:88])
            self.variables.append({"name": text(88, 120) if long else text(8, 16), "label": text(16, 56), "format": text(56, 64), "numeric": kind == 1, "length": length, "at": position})
        at += -(-count * width // RECORD) * RECORD
        if long and head[at:].startswith(_HEADER % b"LABELV8"):
            count = int(head[at + 48 : at + RECORD].split()[0])
            at += RECORD
            first = at
            for _ in range(count):
                number, n, m = struct.unpack(">hhh", head[at : at + 6])
                self.variables[number - 1]["label"] = head[at + 6 + n : at + 6 + n + m].decode("utf-8", "replace")
                at += 6 + n + m
            at = first + -(-(at - first) // RECORD) * RECORD
        if not head[at:].startswith(_HEADER % (b"OBSV8  " if long else b"OBS    ")):
            raise ValueError(f"Failed to read '{path}': no observation header")
        self.start = at + RECORD
        self.width = sum(v["length"] for v in self.variables)
        self.rows = max(0, size - self.start) // self.width if self.width else 0

    def kind(self, v: dict) -> str:
        name = re.sub(r"[\d.]+$", "", v["format"].upper()) if not v["format"].upper().startswith(("E8601", "B8601", "IS8601")) else v["format"].upper()[:8].rstrip(".0123456789") or v["format"]
        if not v["numeric"]:
            return "string"
        for kind, names in (("timestamp", _DATETIMES), ("time", _TIMES), ("date", _DATES)):
            if name in names or any(n.startswith(("E8601", "B8601", "IS8601")) and v["format"].upper().startswith(n) for n in names):
                return kind
        return "double"

    def schema(self) -> T.StructType:
        kinds = {"string": T.StringType(), "double": T.DoubleType(), "date": T.DateType(), "timestamp": T.TimestampNTZType(), "time": T.TimeType(6)}
        return T.StructType([T.StructField(v["name"], kinds[self.kind(v)], True, {"comment": v["label"]} if v["label"] else {}) for v in self.variables])

    def decode(self, raw: bytes) -> pa.RecordBatch:
        rows = np.frombuffer(raw, np.uint8).reshape(-1, self.width)
        columns = []
        for v in self.variables:
            cell = rows[:, v["at"] : v["at"] + v["length"]]
            kind = self.kind(v)
            if kind == "string":
                texts = np.ascontiguousarray(cell).view(f"S{v['length']}")[:, 0]
                columns.append(pa.array([t.decode("utf-8", "replace").rstrip(" \0") for t in texts.tolist()], pa.string()))
                continue
            full = np.zeros((len(cell), 8), np.uint8)
            full[:, : v["length"]] = cell
            x = ibm_to_ieee(full)
            gone = np.isnan(x)
            y = np.where(gone, 0, x)
            if kind == "double":
                columns.append(pa.array(x, pa.float64(), mask=gone))
            elif kind == "date":
                columns.append(pa.array((np.floor(y) + _EPOCH).astype(np.int32), pa.int32(), mask=gone).cast(pa.date32()))
            elif kind == "timestamp":
                columns.append(pa.array(np.rint((y + _EPOCH * 86400) * 1e6).astype(np.int64), pa.int64(), mask=gone).cast(pa.timestamp("us")))
            else:
                columns.append(pa.array(np.rint(y * 1e6).astype(np.int64) * 1000, pa.int64(), mask=gone).cast(pa.time64("ns")))
        return pa.RecordBatch.from_arrays(columns, [v["name"] for v in self.variables])


def _ranged(spark: SparkSession, path: str, offset: int, length: int) -> bytes:
    """Bytes of a file through Hadoop's file system, so any store that Spark reads will do."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    size = fs.getFileStatus(p).getLen()
    length = max(0, min(length, size - offset))
    stream = fs.open(p)
    try:
        stream.seek(offset)
        return bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(stream, length))
    finally:
        stream.close()


def _layout(spark: SparkSession, path: str) -> Layout:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    size = p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).getLen()
    length = 1 << 16
    while True:  # the header only; long ones are read in growing steps
        head = _ranged(spark, path, 0, length)
        try:
            return Layout(head, size, path)
        except ValueError:
            if not head.startswith(b"HEADER RECORD") or length >= size:
                raise
            length *= 4


def _format(path: str, format: str | None) -> str:
    found = format or EXTENSIONS.get(os.path.splitext(path)[1].lower())
    if not found:
        raise ValueError(f"Cannot detect file format of '{path}'")
    return found


def _other(spark: SparkSession, path: str, format: str, encoding: str | None):
    """The description of an SPSS, Stata or SAS data set, from as much of its head as that takes."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    size = p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).getLen()
    length = 1 << 18
    while True:
        try:
            return stat_files.FILES[format](_ranged(spark, path, 0, length), encoding)
        except Exception as e:
            if length >= size:
                raise ValueError(f"Failed to read '{path}': {e or 'the file ends early'}") from None
            length *= 8


def _allow_time(spark: SparkSession, schema: T.StructType) -> T.StructType:
    """Columns of the type TIME are off by default; a file that has some turns them on for the session."""
    if any(isinstance(f.dataType, T.TimeType) for f in schema):
        spark.conf.set("spark.sql.timeType.enabled", "true")
    return schema


def _opener(spark: SparkSession, path: str):
    """A function that opens a file in a task, seekable, or None where only Spark's own readers reach it.

    Local and shared folders are opened directly, stores through Arrow's file systems.
    """
    if "://" not in path or path.startswith("file:"):
        place = path.removeprefix("file://").removeprefix("file:")
        default = spark._jsc.hadoopConfiguration().get("fs.defaultFS", "file:///")
        return (lambda: open(place, "rb")) if os.path.exists(place) and (path.startswith("file:") or default.startswith("file:")) else None

    def remote():
        from pyarrow import fs

        store, place = fs.FileSystem.from_uri(path)
        return store.open_input_file(place)

    try:
        remote().close()
    except (pa.ArrowException, OSError, ImportError):
        return None
    return remote


def read_stat(spark: SparkSession, path: str, format: str | None = None, encoding: str | None = None) -> DataFrame:
    """A statistics file as a DataFrame; the schema comes from the header alone.

    Rows of a transport file have one width, so tasks read and decode ranges of
    rows, in the file's order. Other formats, and transport files in stores that
    only Spark's readers reach, are decoded in one task and stay under 2 GB.
    """
    if (found := _format(path, format)) != "xpt":
        other = _other(spark, path, found, encoding)

        def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for content in batch.column(0):
                    yield from other.batches(content.as_py())

        return spark.read.format("binaryFile").load(path).select("content").mapInArrow(decode, _allow_time(spark, stat_files.schema_of(other.variables)))
    layout = _layout(spark, path)
    width, start = layout.width, layout.start
    schema = _allow_time(spark, layout.schema())
    rows = _full_rows(spark, path, layout)
    if not rows:
        return spark.createDataFrame([], schema)
    names = [f"`{v['name']}`" for v in layout.variables]
    step = max(1, RANGE_BYTES // width)
    opened = _opener(spark, path)

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number in batch.column(0).to_pylist():
                with opened() as file:
                    file.seek(start + number * step * width)
                    yield layout.decode(file.read(min(step, rows - number * step) * width))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                raw = content.as_py()[start : start + rows * width]
                for at in range(0, len(raw), step * width):
                    yield layout.decode(raw[at : at + step * width])

    if opened:
        count = -(-rows // step)
        return spark.range(0, count, 1, min(count, TASKS)).mapInArrow(ranges, schema).select(*names)
    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(whole, schema).select(*names)


def _full_rows(spark: SparkSession, path: str, layout: Layout) -> int:
    """Rows of the data set without the blank ones that only fill its last 80-byte record."""
    n, width = layout.rows, layout.width
    last = min(n, RECORD // width + 1) if width else 0
    tail = _ranged(spark, path, layout.start + (n - last) * width, last * width) if last else b""
    while last and tail[(last - 1) * width : last * width] == b" " * width:
        last, n = last - 1, n - 1
    return n


def read_stat_metadata(spark: SparkSession, path: str, format: str | None = None, encoding: str | None = None) -> DataFrame:
    """column_name, type, format and label, from the header alone."""
    try:
        found = _format(path, format)
        if found == "xpt":
            layout = _layout(spark, path)
        else:
            other = _other(spark, path, found, encoding)
    except ValueError as e:
        raise ValueError(str(e).replace("Failed to read '", "Failed to read metadata from '")) from None
    if found != "xpt":
        rows = [(v["name"], v["type"], v["format"], v["label"]) for v in other.variables]
        return spark.createDataFrame(rows, "column_name string, type string, format string, label string")
    rows = [(v["name"], "DOUBLE" if v["numeric"] else "STRING", v["format"], v["label"]) for v in layout.variables]
    return spark.createDataFrame(rows, "column_name string, type string, format string, label string")


def checked_name(name: str, label: str, longest: int, role: str = "column name", upper: bool = True) -> str:
    """A name as a file format takes it; what doesn't fit is an error, never cut."""
    if not name:
        raise ValueError(f"Empty {role} not allowed in {label} export")
    if len(name) > longest:
        raise ValueError(f"{role} '{name}' is too long for {label} (max {longest} chars). Rename in your SELECT.")
    name = name.upper() if upper else name
    if not re.fullmatch(r"[A-Za-z0-9_]*", name):
        raise ValueError(f"{role} '{name}' contains characters not allowed in {label} (only A-Z a-z 0-9 _ permitted)")
    if name[0].isdigit():
        raise ValueError(f"{role} '{name}' starts with a digit, not allowed in {label}")
    return name


def output(spark: SparkSession, path: str):
    """A binary file to write: a local one, or through Hadoop's file system where the path names a store."""
    if "://" not in path or path.startswith("file://"):
        return open(path.removeprefix("file://"), "wb")
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return _Stream(p.getFileSystem(spark._jsc.hadoopConfiguration()).create(p, True))


class _Stream:
    def __init__(self, stream):
        self._stream = stream

    def write(self, data: bytes) -> None:
        self._stream.write(bytearray(data))

    def __enter__(self):
        return self

    def __exit__(self, *_) -> None:
        self._stream.close()


def check_types(df: DataFrame) -> None:
    """Statistics files hold numbers, texts, dates and times only."""
    for f in df.schema.fields:
        simple = isinstance(f.dataType, (T.NumericType, T.BooleanType, T.StringType, T.DateType, T.TimestampType, T.TimestampNTZType))
        if not simple and not isinstance(f.dataType, T.TimeType):
            raise ValueError(f"column '{f.name}' has unsupported type {f.dataType.simpleString().upper()} for export")


def longest_texts(df: DataFrame) -> dict[str, int]:
    """Bytes of the longest text in each string column."""
    from pyspark.sql import functions as F

    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    return df.agg(*[F.max(F.octet_length(f"`{c}`")).alias(c) for c in texts]).first().asDict() if texts else {}


def encoded_rows(df: DataFrame, encode) -> Iterator[tuple[int, bytes]]:
    """(rows, bytes) of ``df`` batch by batch, in order: tasks encode, the driver only gets bytes to append.

    ``encode`` gets a list of arrays: float64 with NaN for NULL (seconds since
    1970 for timestamps, days for dates, seconds for times) or lists of bytes.
    """
    from pyspark.sql import functions as F

    fields = df.schema.fields
    columns = []
    for f in fields:
        c, kind = F.col(f"`{f.name}`"), f.dataType
        if isinstance(kind, T.TimestampType):
            c = c.cast("timestamp_ntz")
        elif not isinstance(kind, (T.StringType, T.DateType, T.TimestampNTZType)) and not kind.typeName().startswith("time"):
            c = c.cast("double")
        columns.append(c)

    def values(x: pa.Array) -> np.ndarray | list[bytes]:
        if pa.types.is_string(x.type) or pa.types.is_large_string(x.type):
            return [b"" if v is None else v.encode() for v in x.to_pylist()]
        scale = 1.0
        if pa.types.is_date(x.type):
            x = x.cast(pa.int32())
        elif pa.types.is_timestamp(x.type) or pa.types.is_time(x.type):
            scale = {"s": 1.0, "ms": 1e3, "us": 1e6, "ns": 1e9}[x.type.unit]
            x = x.cast(pa.int64())
        return x.cast(pa.float64()).to_numpy(zero_copy_only=False) / scale if scale != 1 else x.cast(pa.float64()).to_numpy(zero_copy_only=False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            body = encode([values(c) for c in batch.columns])
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64()), pa.array([body], pa.binary())], ["n", "body"])

    for row in df.select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).mapInArrow(run, "n bigint, body binary").toLocalIterator(prefetchPartitions=True):
        yield row["n"], bytes(row["body"])


def padded(texts: list[bytes], width: int) -> np.ndarray:
    """Texts filled with spaces to ``width`` bytes, as (n, width) bytes."""
    return np.frombuffer(b"".join(t.ljust(width) for t in texts), np.uint8).reshape(len(texts), width)


def write_xpt(df: DataFrame, path: str, table_name: str | None = None, label: str = "", version: int = 5) -> int:
    """Write a SAS transport file of version 5 or 8 and return the number of rows.

    NULL numbers become missing, NULL texts blank. Version 5 takes names of 8
    characters and texts of 200 bytes, version 8 of 32 and 32,767, and labels of
    256; longer ones raise, nothing is cut. Tasks encode the rows; the driver
    appends their bytes in order.
    """
    if version not in (5, 8):
        raise ValueError(f"XPT VERSION must be 5 or 8, got {version}")
    kind, long = f"XPT v{version}", version == 8
    most, widest = (32, 32_767) if long else (8, 200)
    if table_name is not None:
        name = checked_name(table_name, kind, most, "TABLE_NAME")
    else:
        try:
            name = checked_name(os.path.splitext(os.path.basename(path))[0][:most], kind, most)
        except ValueError:
            name = "DATASET"
    check_types(df)
    fields = df.schema.fields
    names = [checked_name(f.name, kind, most) for f in fields]
    if len(set(names)) < len(names):
        raise ValueError(f"column names must differ in {kind}, whatever their case")
    if len(label.encode()) > (256 if long else 40):
        raise ValueError(f"LABEL is too long for {kind}")
    longest = longest_texts(df)
    formats = {T.DateType: "DATE", T.TimestampNTZType: "DATETIME", T.TimestampType: "DATETIME"}
    widths = {"DATE": 9, "DATETIME": 19, "TIME": 8}
    at, entries, lengths, labels = 0, b"", [], b""
    n_labels = 0
    for i, (f, n) in enumerate(zip(fields, names)):
        text = isinstance(f.dataType, T.StringType)
        fmt = formats.get(type(f.dataType), "TIME" if f.dataType.typeName().startswith("time") and not text else "")
        length = max(1, longest.get(f.name) or 1) if text else 8
        if length > widest:
            raise ValueError(f"column '{f.name}' holds a text of {length} bytes; {kind} takes {widest}")
        comment = (f.metadata or {}).get("comment", "").encode()
        if len(comment) > (256 if long else 40):
            raise ValueError(f"label of column '{f.name}' is too long for {kind}")
        if len(comment) > 40:
            labels += struct.pack(">hhh", i + 1, len(n), len(comment)) + n.encode() + comment
            n_labels += 1
        entries += struct.pack(">hhhh", 2 if text else 1, 0, length, i + 1) + n.encode()[:8].ljust(8) + comment[:40].ljust(40) + fmt.encode().ljust(8)
        entries += struct.pack(">hhh2s", widths.get(fmt, 0), 0, 0, b"\0\0") + b" " * 8 + struct.pack(">hhi", 0, 0, at)
        entries += n.encode().ljust(32) + struct.pack(">h", len(comment)) + b"\0" * 18 if long else b"\0" * 52
        lengths.append(length)
        at += length
    stamp = datetime.datetime(2000, 1, 1).strftime("%d%b%y:%H:%M:%S").upper().encode()
    fill = lambda b: b.ljust(-(-len(b) // RECORD) * RECORD)
    part = lambda five, eight: _HEADER % (eight if long else five)
    head = fill(part(b"LIBRARY", b"LIBV8  ") + b"0" * 30) + fill(b"SAS     SAS     SASLIB  9.4     SPARK   " + b" " * 24 + stamp) + fill(stamp)
    head += fill(part(b"MEMBER ", b"MEMBV8 ") + b"000000000000000001600000000140") + fill(part(b"DSCRPTR", b"DSCPTV8") + b"0" * 30)
    own = name.encode().ljust(32 if long else 8) + b"SASDATA 9.4     SPARK   "
    head += fill(b"SAS     " + own + b" " * (0 if long else 24) + stamp) + fill(stamp + b" " * 16 + label.encode()[:40].ljust(40))
    head += fill(part(b"NAMESTR", b"NAMSTV8") + b"%010d" % len(names) + b"0" * 20) + fill(entries)
    if labels:
        head += fill(_HEADER % b"LABELV8" + b"%d" % n_labels) + fill(labels)
    head += fill(part(b"OBS    ", b"OBSV8  ") + b"0" * 30)
    epochs = [float(_EPOCH) if isinstance(f.dataType, T.DateType) else _EPOCH * 86400.0 if fmt_is_stamp(f.dataType) else 0.0 for f in fields]

    def encode(columns: list) -> bytes:
        cells = [padded(x, k) if isinstance(x, list) else ieee_to_ibm(x - e) for x, k, e in zip(columns, lengths, epochs)]
        return np.concatenate(cells, axis=1).tobytes()

    rows = 0
    with output(df.sparkSession, path) as out:
        out.write(head)
        for n, body in encoded_rows(df, encode):
            out.write(body)
            rows += n
        out.write(b" " * (-(rows * at) % RECORD))
    return rows


def fmt_is_stamp(kind: T.DataType) -> bool:
    return isinstance(kind, (T.TimestampType, T.TimestampNTZType))
