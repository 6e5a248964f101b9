"""Statements: test aggregates, COPY, marks, and their errors."""

import datetime

import pytest

from quantalume.operators import describe, hypothesis, ranks, regression
from quantalume.plans.sql import sql
from quantalume.sources.stat_files import from_base30, to_base30


@pytest.fixture(scope="module")
def pairs(spark):
    rows = [("abc"[i % 3] if i % 7 else None, (i * 37 % 101) / 7.0, (i * 53 % 89) / 5.0 if i % 11 else None, "uv"[i % 2]) for i in range(120)]
    df = spark.createDataFrame(rows, "g string, x double, y double, k string")
    df.createOrReplaceTempView("pairs")
    return df


CALLS = {
    "ttest_1samp(x, 6.5, 0.1, 'less')": lambda df, by: hypothesis.ttest_1samp(df, "x", 6.5, 0.1, "less", by=by),
    "ttest_2samp(x, y, true)": lambda df, by: hypothesis.ttest_2samp(df, "x", "y", True, by=by),
    "mann_whitney_u(x, y, 'greater', true)": lambda df, by: ranks.mann_whitney_u(df, "x", "y", "greater", True, by=by),
    "spearman_test(x, y)": lambda df, by: ranks.spearman_test(df, "x", "y", by=by),
    "anova_oneway(x, k)": lambda df, by: hypothesis.anova_oneway(df, "x", "k", by=by),
    "summary_stats(x, false, 5)": lambda df, by: describe.summary_stats(df, "x", False, 5, by=by),
    "lm_fit(y, [x], 'HC3')": lambda df, by: regression.lm_fit(df, "y", ["x"], "HC3", by=by),
}


@pytest.mark.parametrize("call", CALLS)
def test_aggregates_equal_operators(spark, pairs, call):
    for by in ([], ["g"]):
        tail = " GROUP BY g" if by else ""
        got = sql(spark, f"SELECT {', '.join([*by, call + ' AS r'])} FROM pairs{tail}").collect()
        expected = CALLS[call](pairs, by).collect()
        key = lambda r: str(r["g"]) if by else ""
        assert [str(r["r"]) for r in sorted(got, key=key)] == [str(r["result"]) for r in sorted(expected, key=key)]


def test_statements_around_aggregates(spark, pairs):
    rows = sql(spark, "SELECT g, count(*) AS n, (ttest_1samp(x)).t_statistic, kendall_test(x, y).n AS m FROM pairs WHERE x > 1 GROUP BY g HAVING count(*) > 1 ORDER BY g NULLS LAST".replace("HAVING count(*) > 1 ", ""))
    assert rows.columns == ["g", "n", "t_statistic", "m"] and [r["g"] for r in rows.collect()] == ["a", "b", "c", None]
    inner = sql(spark, "WITH t AS (SELECT * FROM pairs WHERE g = 'a') SELECT round(r.t_statistic, 3) AS t FROM (SELECT ttest_1samp(x) AS r FROM t)")
    outer = hypothesis.ttest_1samp(pairs.where("g = 'a'"), "x").first()["result"]["t_statistic"]
    assert inner.first()["t"] == round(outer, 3)
    kept = sql(spark, "SELECT upper(g) AS u, ttest_1samp(x) FILTER (WHERE k = 'u') AS r FROM pairs GROUP BY upper(g) HAVING ttest_1samp(x).df > 3 ORDER BY 1").collect()
    one = hypothesis.ttest_1samp(pairs.where("k = 'u' and g = 'b'"), "x").first()["result"]
    assert [r["u"] for r in kept] == [None, "A", "B", "C"] and str(kept[2]["r"]) == str(one)
    assert sql(spark, "SELECT 'ttest_1samp(x)' AS s").first()["s"] == "ttest_1samp(x)"
    many = sql(spark, "SELECT size(bootstrap(x, 'median', 10 * 5, 7)) AS n, bin_edges(x, 'rice')[0] AS e FROM pairs").first()
    assert (many["n"], many["e"]) == (50, 0.0)


@pytest.mark.parametrize(
    "call, message",
    [
        ("ttest_1samp(x, y)", "Parameter must be a constant value"),
        ("mann_whitney_u(x, y, 'two-sided', k)", "continuity must be a constant boolean"),
        ("bootstrap(x, g, 10)", "'statistic' must be a constant string"),
        ("ttest_2samp(x, y, false, 1.5)", "alpha must be between 0 and 1"),
        ("pearson_test(x, y, 0.05, 'both')", "alternative must be"),
        ("summary_stats(x, true, 6)", "quantile_type must be 5"),
        ("bin_edges(x, 'odd')", "unknown method"),
        ("bootstrap(x, 'mode', 9)", "unknown statistic"),
        ("bootstrap(x, 'mean', 0)", "'n_iters' must be > 0"),
        ("lm_fit(y, [x], 'HC8')", "unknown vcov"),
        ("lm_fit(y, [x], 'CR0')", "requires a cluster"),
        ("lm_fit(y, [x], 'HC0', k)", "cluster-robust"),
    ],
)
def test_aggregate_errors(spark, pairs, call, message):
    with pytest.raises(ValueError, match=message):
        sql(spark, f"SELECT {call} FROM pairs")


def test_marks_tell_their_needs(spark):
    row = sql(spark, "SELECT visualize_mark_v1_heatmap() AS h, visualize_mark_v1_rule() AS r").first()
    assert tuple(row) == ('{"name":"heatmap","required_aesthetics":["x","y","color"]}', '{"name":"rule","required_aesthetics":[]}')


ROWS = [
    (1, 0.1, "first", datetime.date(2031, 3, 4), datetime.datetime(1959, 7, 8, 9, 10, 11), datetime.time(5, 6, 7)),
    (-7, -2.5e-9, "", datetime.date(1931, 12, 30), datetime.datetime(2000, 2, 29, 23, 59, 59), None),
    (None, None, None, None, None, datetime.time(23, 0, 1)),
    (123456789, 6.02e23, "é" * 9, datetime.date(1970, 1, 1), None, None),
]


@pytest.mark.parametrize("name", ["a.xpt", "b.xpt", "c.sav", "d.sav", "e.por", "f.sas7bdat", "g.sas7bdat"])
def test_copy_round_trips(spark, tmp_path, name):
    spark.conf.set("spark.sql.timeType.enabled", "true")
    df = spark.createDataFrame(ROWS, "n int, v double, s string, d date, ts timestamp_ntz, t time")
    df.createOrReplaceTempView("mixed")
    options = {"b.xpt": "(VERSION 8, TABLE_NAME 'long_table_name', LABEL 'all kinds')", "d.sav": "(COMPRESSION rows)", "g.sas7bdat": "(COMPRESSION rle, LABEL 'all kinds')"}.get(name, "")
    path = str(tmp_path / name)
    assert sql(spark, f"COPY mixed TO '{path}' {options}").first()[0] == 4
    got = sql(spark, f"SELECT * FROM 'file://{path}'")
    assert [c.upper() for c in got.columns] == ["N", "V", "S", "D", "TS", "T"]
    for r, e in zip(got.collect(), ROWS):
        assert r[0] == e[0] and r[2] == (e[2] or "") and tuple(r[3:]) == e[3:]
        assert r[1] == (pytest.approx(e[1], rel=1e-15) if e[1] is not None else None)
    part = str(tmp_path / ("part_" + name))
    assert sql(spark, f"COPY (SELECT n, s FROM mixed WHERE n > 0) TO '{part}'").first()[0] == 2
    assert sql(spark, f"SELECT count(*) AS c FROM 'file://{part}'").first()["c"] == 2


@pytest.mark.parametrize("compression", ["none", "rows"])
def test_sas7bdat_of_many_pages_and_columns(spark, tmp_path, compression):
    """Rows over several pages, runs of all lengths, more columns than a subheader takes, labels, and no rows at all."""
    from quantalume.sources.sas_files import write_sas7bdat
    from quantalume.sources.xpt import read_stat, read_stat_metadata

    df = spark.range(700).selectExpr("id", "id / 7 as x", "repeat(' ', int(id % 41)) || repeat('zé', int(id)) || '.' as s", "if(id % 3 = 0, null, repeat('q', int(id % 23))) as t")
    df = df.withMetadata("x", {"comment": "sevenths"})
    path = str(tmp_path / "t.sas7bdat")
    assert write_sas7bdat(df, path, label="seven hundred", compression=compression) == 700
    got = read_stat(spark, "file://" + path)
    assert [tuple(r) for r in got.orderBy("id").collect()] == [(float(i), i / 7, " " * (i % 41) + "zé" * i + ".", "" if i % 3 == 0 else "q" * (i % 23)) for i in range(700)]
    assert read_stat_metadata(spark, "file://" + path).collect()[1]["label"] == "sevenths"
    assert b"seven hundred" in open(path, "rb").read()
    wide = spark.range(2).selectExpr(*[f"double(id + {i}) as column_{i}" for i in range(2100)])
    write_sas7bdat(wide, path, compression=compression)
    assert sorted(r[2099] for r in read_stat(spark, "file://" + path).collect()) == [2099.0, 2100.0]
    write_sas7bdat(df.limit(0), path, compression=compression)
    assert read_stat(spark, "file://" + path).count() == 0


def test_transport_files_are_read_in_ranges(spark, tmp_path, monkeypatch):
    """Ranges of few rows, and the one-task way, give the same rows in the same order; blank rows at the end are padding."""
    from quantalume.sources import xpt

    path = str(tmp_path / "r.xpt")
    xpt.write_xpt(spark.range(0, 500, 1, 3).selectExpr("id as n", "concat('k', id) as s"), path)
    monkeypatch.setattr(xpt, "RANGE_BYTES", 100)
    got = xpt.read_stat(spark, "file://" + path)
    assert got.rdd.getNumPartitions() > 50
    expected = [(float(i), f"k{i}") for i in range(500)]
    assert [tuple(r) for r in got.collect()] == expected
    monkeypatch.setattr(xpt, "_opener", lambda *_: None)
    assert [tuple(r) for r in xpt.read_stat(spark, "file://" + path).collect()] == expected
    for rows in range(1, 5):
        xpt.write_xpt(spark.range(rows).selectExpr("concat('x', id) as s"), path)
        assert xpt.read_stat(spark, "file://" + path).count() == rows


def test_version_8_keeps_long_names_texts_and_labels(spark, tmp_path):
    from quantalume.sources.xpt import read_stat, read_stat_metadata, write_xpt

    df = spark.createDataFrame([("x" * 3000, 1.0)], "a_rather_long_name string, v double")
    df = df.withMetadata("v", {"comment": "a label of more than forty characters, which version 5 can't hold"})
    path = str(tmp_path / "long.xpt")
    write_xpt(df, path, version=8)
    got = read_stat(spark, "file://" + path)
    assert got.columns == ["A_RATHER_LONG_NAME", "V"] and tuple(got.first()) == ("x" * 3000, 1.0)
    assert read_stat_metadata(spark, "file://" + path).collect()[1]["label"].endswith("hold")


@pytest.mark.parametrize(
    "select, path, options, message",
    [
        ("repeat('y', 201) AS s", "a.xpt", "", "holds a text of 201 bytes"),
        ("1 AS a_long_name", "a.xpt", "", "too long for XPT v5"),
        ("1 AS `a-b`", "a.xpt", "", "characters not allowed"),
        ("1 AS `1a`", "a.por", "", "starts with a digit"),
        ("1 AS a", "a.xpt", "(VERSION 6)", "must be 5 or 8"),
        ("1 AS a", "a.sav", "(VERSION 5)", "VERSION option is only meaningful for XPT"),
        ("1 AS a", "a.por", "(COMPRESSION rows)", "COMPRESSION option is only meaningful"),
        ("1 AS a", "a.xpt", "(COLOUR 'red')", "Unrecognized XPT option"),
        ("1 AS a", "a.xpt", "(TABLE_NAME '9lives')", "starts with a digit"),
        ("1 AS a", "a.sav", "(COMPRESSION zip)", "must be 'none' or 'rows'"),
        ("1 AS a", "a.sas7bdat", "(TABLE_NAME 'b')", "TABLE_NAME option is only meaningful for XPT export, not SAS7BDAT"),
        ("1 AS a", "a.sas7bdat", "(COMPRESSION zip)", "SAS7BDAT COMPRESSION must be 'none' or 'rows'"),
        ("1 AS a_name_of_thirty_three_characters", "a.sas7bdat", "", "too long for SAS7BDAT"),
        ("array(1) AS a", "a.sas7bdat", "", "unsupported type ARRAY<INT>"),
        ("array(1) AS a", "a.xpt", "", "unsupported type"),
        ("1 AS a", "a.txt", "", "Cannot detect file format"),
    ],
)
def test_copy_errors(spark, tmp_path, select, path, options, message):
    with pytest.raises(ValueError, match=message):
        sql(spark, f"COPY (SELECT {select}) TO '{tmp_path / path}' {options}")


def test_base_30_numbers_read_back():
    import random

    r = random.Random(1)
    for _ in range(2000):
        x = r.uniform(-1, 1) * 10 ** r.randint(-300, 300)
        assert from_base30(to_base30(x)[:-1]) == x
    assert to_base30(900.0) == "100/" and to_base30(-31.0) == "-11/" and to_base30(float("nan")) == "*." and from_base30("1.F") == 1.5
