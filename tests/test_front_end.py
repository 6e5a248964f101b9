import datetime

import pytest

from quantalume.plans.sql import sql
from quantalume.plans.visualize import VisualizeError, to_spec
from quantalume.sources.xpt import read_stat, read_stat_metadata, write_xpt


def test_bar_spec():
    spec, layers = to_spec("VISUALIZE cat AS x, val AS y FROM sales DRAW bar")
    assert spec == (
        '{"$schema":"https://vega.github.io/schema/vega-lite/v5.json","data":{"name":"layer_0"},"mark":"bar","encoding":'
        '{"x":{"field":"x","type":"ordinal"},"y":{"field":"y","type":"quantitative"}}}'
    )
    assert layers == {"layer_0": "SELECT x, SUM(y) AS y FROM (SELECT cat AS x, val AS y FROM sales) GROUP BY x ORDER BY x"}


@pytest.mark.parametrize(
    "text, message",
    [
        ("VISUALIZE a AS x FROM t DRAW bar", "'bar' requires 'y' aesthetic"),
        ("VISUALIZE a AS x FROM t DRAW zzz", "unknown mark 'zzz'"),
        ("VISUALIZE a AS x FROM t", "At least one 'DRAW <mark>'"),
        ("VISUALIZE a AS x, b AS y FROM t DRAW point FACET species", "Expected 'BY'"),
        ("VISUALIZE a AS x, b AS y FROM t DRAW point FACET BY", "Expected expression after 'FACET BY'"),
        ("VISUALIZE 'a AS x FROM t DRAW point", "Unterminated string literal"),
    ],
)
def test_errors(text, message):
    with pytest.raises(VisualizeError, match=message):
        to_spec(text)


def test_table_functions_in_sql(spark):
    spark.createDataFrame([(1, 2.0), (2, 4.1), (3, 6.2), (4, 7.9)], "a int, b double").createOrReplaceTempView("tiny")
    rows = sql(spark, "SELECT term FROM lm('tiny', y := 'b', x := ['a']) ORDER BY 1").collect()
    assert [r[0] for r in rows] == ["(Intercept)", "a"]
    assert sql(spark, "SELECT * FROM meta('tiny')").count() == 2


def test_transport_round_trip(spark, tmp_path):
    path = str(tmp_path / "t.xpt")
    rows = [("é1", 1.5, datetime.date(2018, 5, 6), 1e-5), (None, None, None, -123456.789)]
    write_xpt(spark.createDataFrame(rows, "name string, v double, day date, w double"), path)
    got = read_stat(spark, "file://" + path).collect()
    assert [tuple(r) for r in got] == [rows[0], ("", None, None, -123456.789)]
    assert read_stat_metadata(spark, "file://" + path).count() == 4
    (tmp_path / "bad.xpt").write_text("<html>")
    with pytest.raises(ValueError, match="Failed to read"):
        read_stat(spark, "file://" + str(tmp_path / "bad.xpt"))
    with pytest.raises(ValueError, match="Cannot detect file format"):
        read_stat(spark, "x.csv")
