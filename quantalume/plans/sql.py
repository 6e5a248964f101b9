"""SQL front end: VISUALIZE, COPY, test aggregates, named table functions and statistics files, else plain Spark SQL."""

from __future__ import annotations

import ast
import re

from pyspark.sql import DataFrame, SparkSession

from ..operators import describe, regression
from ..sources import sas_files, stat_files, xpt
from . import aggregates, visualize

_CALL = re.compile(r"\b(meta|table_one|corr_matrix|lm_summary|lm|read_stat|read_stat_metadata)\s*\(", re.I)
_COPY = re.compile(r"\s*COPY\s+(?P<what>\(.*\)|[\w.`\"]+)\s+TO\s+'(?P<path>(?:[^']|'')+)'\s*(?:\((?P<options>.*)\))?\s*;?\s*$", re.I | re.S)
_FILE = re.compile(r"\b(from|join)\s+'([^']+\.(?:xpt|sav|zsav|por|dta|sas7bdat))'", re.I)


def _closing(text: str, start: int) -> int:
    depth, quote = 0, ""
    for i in range(start, len(text)):
        c = text[i]
        if quote:
            quote = "" if c == quote else quote
        elif c in "'\"":
            quote = c
        elif c in "([":
            depth += 1
        elif c in ")]":
            depth -= 1
            if not depth:
                return i
    raise ValueError("unbalanced parentheses")


def _arguments(text: str) -> tuple[list, dict]:
    """Positional and ``name := value`` arguments: strings, lists of strings, numbers, booleans."""
    python = re.sub(r"(\w+)\s*:=", r"\1=", text)
    python = re.sub(r"\b(true|false|null)\b", lambda m: {"true": "True", "false": "False", "null": "None"}[m[1].lower()], python, flags=re.I)
    call = ast.parse(f"f({python})", mode="eval").body
    return [ast.literal_eval(a) for a in call.args], {k.arg: ast.literal_eval(k.value) for k in call.keywords}


def _table_function(spark: SparkSession, name: str, args: list, named: dict) -> DataFrame:
    if name.startswith("read_stat"):
        return (xpt.read_stat if name == "read_stat" else xpt.read_stat_metadata)(spark, *args, **named)
    if not args and "data" not in named:
        raise ValueError(f"{name}: 'data' (source table name) is required")
    df = spark.table(args[0] if args else named.pop("data"))
    function = {"meta": describe.meta, "table_one": describe.table_one, "corr_matrix": describe.corr_matrix, "lm": regression.lm, "lm_summary": regression.lm_summary}[name]
    return function(df, **named)


def _copy(spark: SparkSession, m: re.Match) -> DataFrame:
    """COPY table | (query) TO 'file' (option value, ..): writes a statistics file and returns the number of rows."""
    options = {}
    for part in aggregates.split(m["options"] or ""):
        name, _, value = part.strip().partition(" ")
        if not value.strip():
            raise ValueError(f"COPY: option {name.upper()} requires exactly one argument")
        options[name.lower()] = aggregates.constant(spark, value.strip() if not re.fullmatch(r"\w+", value.strip()) or value.strip().isdigit() else f"'{value.strip()}'", name)
    path = m["path"].replace("''", "'")
    kind = str(options.pop("format", "") or path.rpartition(".")[2]).lower()
    labels = {"xpt": "XPT", "sas7bdat": "SAS7BDAT", "sav": "SAV", "por": "POR"}
    if kind not in labels:
        raise ValueError(f"Cannot detect file format of '{path}': COPY writes xpt, sas7bdat, sav and por files")
    known = {"xpt": ("version", "table_name", "label"), "sas7bdat": ("label", "compression"), "sav": ("label", "compression"), "por": ("label",)}[kind]
    every = {"version": "XPT", "table_name": "XPT", "compression": "SAS7BDAT and SAV"}
    for name in options:
        if name not in known:
            raise ValueError(f"{name.upper()} option is only meaningful for {every[name]} export, not {labels[kind]}" if name in every else f"Unrecognized {labels[kind]} option: {name}")
    what = m["what"].strip()
    df = sql(spark, what[1:-1]) if what.startswith("(") else spark.table(what)
    writer = {"xpt": xpt.write_xpt, "sas7bdat": sas_files.write_sas7bdat, "sav": stat_files.write_sav, "por": stat_files.write_por}[kind]
    return spark.createDataFrame([(writer(df, path, **options),)], "Count bigint")


def sql(spark: SparkSession, text: str) -> DataFrame:
    """Run a statement. Table functions, test aggregates and files in FROM become temporary views."""
    if m := _COPY.match(text):
        return _copy(spark, m)
    if visualize.is_visualize(text):
        spec, layers = visualize.to_spec(text)
        return spark.createDataFrame([(spec, layers)], "spec string, layer_sqls map<string,string>")
    n = 0
    while m := _CALL.search(text):
        if not re.search(r"\b(from|join)\s+$|,\s*$", text[: m.start()], re.I):
            break
        end = _closing(text, m.end() - 1)
        args, named = _arguments(text[m.end() : end])
        view = f"_quantalume_{abs(hash((text, n)))}_{n}"
        _table_function(spark, m[1].lower(), args, named).createOrReplaceTempView(view)
        text, n = text[: m.start()] + view + text[end + 1 :], n + 1
    for m in reversed(list(_FILE.finditer(text))):
        view = f"_quantalume_{abs(hash((text, n)))}_{n}"
        xpt.read_stat(spark, m[2]).createOrReplaceTempView(view)
        text, n = text[: m.start(2) - 1] + view + text[m.end(2) + 1 :], n + 1
    # marks tell what they need: visualize_mark_v1_<name>()
    for m in reversed(list(re.finditer(r"\bvisualize_mark_v1_(\w+)\s*\(\s*\)", aggregates.masked(text), re.I))):
        text = text[: m.start()] + "'" + visualize.describe_mark(m[1].lower()) + "'" + text[m.end() :]
    if aggregates.has_tests(text):
        text = aggregates.rewrite(spark, text)
    return spark.sql(text)
