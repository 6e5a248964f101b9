import datetime
import struct
import zlib

import numpy as np
import pandas as pd
import pytest

from quantalume.sources.stat_files import SpssFile, write_sav
from quantalume.sources.xpt import read_stat, read_stat_metadata

ROWS = [
    ("é" * 20, 1.5, datetime.date(2018, 5, 6), datetime.datetime(1880, 1, 2, 3, 4, 5), 7),
    (None, None, None, None, None),
    ("", -1e300, datetime.date(1583, 1, 1), datetime.datetime(1960, 1, 1), -100),
]
SCHEMA = "a_long_name string, v double, day date, at timestamp_ntz, n int"


@pytest.mark.parametrize("compression", ["none", "rows"])
def test_sav_round_trip(spark, tmp_path, compression):
    path = str(tmp_path / "t.sav")
    write_sav(spark.createDataFrame(ROWS, SCHEMA), path, compression=compression)
    got = [tuple(r) for r in read_stat(spark, "file://" + path).collect()]
    assert got == [ROWS[0], ("", None, None, None, None), ROWS[2]]
    shown = [tuple(r) for r in read_stat_metadata(spark, "file://" + path).collect()]
    assert shown[0][:2] == ("a_long_name", "STRING") and shown[2][2] == "DATE11"


def test_zsav_and_missing_ranges(spark, tmp_path):
    """A hand-made file: codes for small numbers, a missing range with one value, zlib blocks."""
    head = b"$FL3" + b" " * 60 + struct.pack("<iiiiid", 2, 1, 2, 0, -1, 100.0) + b" " * 84
    head += struct.pack("<6i", 2, 0, 0, -3, 5 << 16 | 8 << 8, 5 << 16 | 8 << 8) + b"X       " + struct.pack("<3d", 5, 7, 99)
    head += struct.pack("<ii", 999, 0)
    block = zlib.compress(bytes([101, 104, 105, 107, 108, 199, 255, 253]) + struct.pack("<d", 2.25) + bytes([252] + [0] * 7))
    start = len(head)
    trailer = start + 24 + len(block)
    raw = head + struct.pack("<qqq", start, trailer, 48) + block
    raw += struct.pack("<qqii", -100, 0, 0x3FF000, 1) + struct.pack("<qqii", start, start + 24, 24, len(block))
    (tmp_path / "z.zsav").write_bytes(raw)
    got = [r[0] for r in read_stat(spark, f"file://{tmp_path}/z.zsav").collect()]
    assert got == [1.0, 4.0, None, None, 8.0, None, None, 2.25]
    with pytest.raises(EOFError):
        SpssFile(raw[:200])


def test_stata(spark, tmp_path):
    df = pd.DataFrame({"s": ["x", "é", ""], "i": np.array([1, 2, 3], np.int16), "d": pd.to_datetime(["2018-05-06", "1950-01-02", None]), "f": [0.5, np.nan, -2]})
    path = str(tmp_path / "t.dta")
    df.to_stata(path, write_index=False, convert_dates={"d": "td"}, version=118, variable_labels={"f": "half"})
    got = [tuple(r) for r in read_stat(spark, "file://" + path).collect()]
    assert got == [("x", 1, datetime.date(2018, 5, 6), 0.5), ("é", 2, datetime.date(1950, 1, 2), None), ("", 3, None, -2.0)]
    assert [tuple(r) for r in read_stat_metadata(spark, "file://" + path).collect()][3] == ("f", "DOUBLE", "%10.0g", "half")


def test_bad_files(spark, tmp_path):
    for name in ("a.sav", "a.dta", "a.sas7bdat"):
        (tmp_path / name).write_text("<html>")
        with pytest.raises(ValueError, match="Failed to read"):
            read_stat(spark, f"file://{tmp_path}/{name}")
