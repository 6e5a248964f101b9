"""Line dedup by winnowing, in built-in expressions only.

A window starts at every line and takes the next lines until it holds
``min_words`` words, however many lines that takes; another ends at every line
and takes the lines before it likewise.

1. Winnow: every window selects its least line hash (the last of equal ones) as
   fingerprint. Two equal runs of ``min_words`` words have equal windows, which
   select the same place in both, so every repeat shares a fingerprint.
2. Join positions: fingerprints selected at one place only are dropped, and with
   them all windows around them; most of a corpus ends here.
3. Extend both ways: around a fingerprint that stands elsewhere too, the windows
   that selected it are compared by a hash of all their lines, each with its
   first place in the corpus (never all pairs). The windows inside a repeated
   run cover all of its lines, so joining those that stood earlier extends the
   match to both ends, whichever earlier texts hold its parts.
4. The lines of these runs are deleted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_table, materialize, text_of, unused_name

_LAST = 9223372036854775807
#: Rows of fixed size that are broadcast after a count, at most.
BROADCAST_ROWS = 500_000


def window_table(docs: DataFrame, min_words: int) -> DataFrame:
    """d, t (the document's key), first, last (lines of a window), low, at (its least line hash and where) and key (hash of all).

    Blocks of 1, 2, 4 ... lines with fewer than ``min_words`` words are hashed
    first, so a window is put together from a few blocks and a document of n
    lines costs n log n, with many blank lines too.
    """
    lines = F.split(text_of(), "\n")
    words = lambda x: F.size(F.split(F.trim(F.translate(x, "\t\x0b\x0c\r", "    ")), " +"))
    count = lambda x: F.when(F.length(F.trim(F.translate(x, "\t\x0b\x0c\r", "    "))) == 0, 0).otherwise(words(x))
    line = lambda x, i: F.struct(F.xxhash64(x).alias("low"), i.alias("at"), F.xxhash64(x, F.hash(x)).alias("key"), count(x).alias("w"))
    # the least of two neighbouring parts, the right one where they are equal
    least = lambda x, y: (F.least(x["low"], y["low"]).alias("low"), F.when(y["low"] <= x["low"], y["at"]).otherwise(x["at"]).alias("at"))

    def doubled(levels: Column, _: Column) -> Column:
        b, m = levels[0]["b"], levels[0]["m"]

        def join(x: Column, i: Column) -> Column:
            y = F.get(b, i + m)
            both = F.struct(*least(x, y), F.xxhash64(x["key"], y["key"]).alias("key"), (x["w"] + y["w"]).alias("w"))
            return F.when(x["w"] + y["w"] < min_words, both)

        pairs = F.transform(F.slice(b, F.lit(1), F.greatest(F.size(b) - m, F.lit(0))), join)
        return F.concat(F.array(F.struct((m * 2).alias("m"), pairs.alias("b"))), levels)

    def window(i: Column, back: bool) -> Column:
        state = lambda to, low, at, key, w: F.struct(to.alias("to"), low.alias("low"), at.alias("at"), key.alias("key"), w.alias("w"))
        joined = lambda s, x: least(x, s) if back else least(s, x)

        def take(s: Column, level: Column) -> Column:
            x = F.get(level["b"], s["to"] - level["m"] + 1 if back else s["to"])
            to = s["to"] - level["m"] if back else s["to"] + level["m"]
            more = state(to, *joined(s, x), F.xxhash64(s["key"], x["key"]), s["w"] + x["w"])
            return F.when(s["w"] + x["w"] < min_words, more).otherwise(s)

        def whole(s: Column) -> Column:
            x, end = F.get("a", s["to"]), F.get("a", i)
            (low, at), key = joined(s, x), F.xxhash64(s["key"], x["key"]).alias("key")
            first, last = (s["to"], i) if back else (i, s["to"])
            # a window that ends at a line and is also the one that starts at its first line counts once
            good = x.isNotNull() & (s["w"] + x["w"] - end["w"] >= min_words) if back else x.isNotNull()
            return F.when(good, F.struct(first.alias("first"), last.alias("last"), low, at, key))

        return F.aggregate("levels", state(i, F.lit(_LAST), i, F.lit(int(back)).cast("long"), F.lit(0)), take, whole)

    df = docs.select(*_key(docs), F.transform(lines, line).alias("a"))
    steps = F.sequence(F.lit(0), F.floor(F.log2(F.size("a"))).cast("int"))
    ones = F.transform("a", lambda x: F.when(x["w"] < min_words, x))
    df = df.select("d", "t", "a", F.aggregate(steps, F.array(F.struct(F.lit(1).alias("m"), ones.alias("b"))), doubled).alias("levels"))
    windows = F.flatten(F.transform("a", lambda _, i: F.array(window(i, False), window(i, True))))
    df = df.select("d", "t", F.explode_outer(F.filter(windows, lambda x: x.isNotNull())).alias("x"))
    return df.where("x is not null").select("d", "t", "x.first", "x.last", "x.low", "x.at", "x.key")


def _key(docs: DataFrame) -> tuple[Column, Column]:
    return F.coalesce(F.col("doc_id"), F.lit(_LAST)).alias("d"), F.xxhash64("text").alias("t")


def repeated_runs(docs: DataFrame, min_words: int = 50) -> DataFrame:
    """(d, t, first, last): runs of lines that stood earlier in the corpus.

    d is the doc_id (null: after all others), t the hash of the text; earlier
    means less (d, t, line number).
    """
    windows = materialize(window_table(docs, min_words), "windows")
    spot = F.xxhash64("d", "t", "at")
    shared = windows.groupBy("low").agg(F.min(spot).alias("a"), F.max(spot).alias("b")).where("a != b").select("low")
    shared = materialize(shared, "fingerprints")
    near = materialize(windows.join(_small(shared), "low", "left_semi"), "near")
    place = F.struct("d", "t", "first")
    firsts = near.groupBy("low", "key").agg(F.min(place).alias("src"), F.count(F.lit(1)).alias("n")).where("n > 1")
    firsts = materialize(firsts, "firsts")
    met = near.join(_small(firsts), ["low", "key"]).where(place != F.col("src")).select("d", "t", "first", "last").distinct()
    line = Window.partitionBy("d", "t").orderBy("first", "last")
    reach = F.max("last").over(line.rowsBetween(Window.unboundedPreceding, -1))
    runs = met.withColumn("new", F.when(F.col("first") <= reach + 1, 0).otherwise(1)).withColumn("run", F.sum("new").over(line))
    runs = materialize(runs.groupBy("d", "t", "run").agg(F.min("first").alias("first"), F.max("last").alias("last")).drop("run"), "runs")
    drop_table(windows, shared, near, firsts)
    return runs


def _small(rows: DataFrame) -> DataFrame:
    """A table to be broadcast if it has few rows, each of fixed size; else it is joined by a shuffle."""
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows


def winnow_lines(docs: DataFrame, min_words: int = 50) -> DataFrame:
    """``docs`` with later repeated runs of lines deleted from ``text``, plus n_lines and n_deleted (long).

    Lines end at \\n and are compared exactly. Rows that agree in doc_id and
    text are one document: they share the decision. Null text stays null and
    has 0 lines; an empty text has one empty line; a text that loses all lines
    becomes empty. Null doc_ids come after all others. Columns named like the
    two counts are replaced, other columns pass through.
    """
    docs = docs.drop("n_lines", "n_deleted")
    runs = repeated_runs(docs, min_words)
    dead = runs.groupBy("d", "t").agg(F.collect_list(F.struct("first", "last")).alias("dead"))
    d, t, x = (unused_name(docs, n) for n in ("key_d", "key_t", "dead_"))
    key_d, key_t = _key(docs)
    # few runs: their places go to the texts, which then need no shuffle
    dead = F.broadcast(dead) if runs.count() <= BROADCAST_ROWS else dead
    dead = dead.select(F.col("d").alias(d), F.col("t").alias(t), F.col("dead").alias(x))
    columns = docs.columns
    df = docs.withColumns({d: key_d, t: key_t}).join(dead, [d, t], "left")
    keep = F.filter(F.split("text", "\n"), lambda line, i: ~F.exists(x, lambda r: (i >= r["first"]) & (i <= r["last"])))
    text = F.when(F.col(x).isNull(), F.col("text")).otherwise(F.array_join(keep, "\n"))
    n = F.coalesce(F.size(F.split("text", "\n")), F.lit(0))
    n = F.when(F.col("text").isNull(), 0).otherwise(n).cast("long")
    gone = F.when(F.col(x).isNull(), F.lit(0)).otherwise(n - F.size(keep)).cast("long")
    return df.select(
        *[text.alias("text") if c == "text" else F.col(f"`{c}`") for c in columns], n.alias("n_lines"), gone.alias("n_deleted")
    )
