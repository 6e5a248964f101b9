"""A corpus pipeline of five stages over the documents table.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes
each as Parquet in the shared folder and rereads it for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quantalume.llm import line_dedup, mixing, ngram_join, packing, toxicity
from quantalume.llm.common import materialize, read_table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Toxicity: the documents that the model predicts toxic go."""
    model = toxicity.fit(docs, read_table(spark, sf_dir, "labels"))
    return toxicity.toxicity(docs, model).where("predicted = 0").select(*docs.columns)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Line dedup: later repeated runs of lines go; a document left without any text goes too."""
    done = line_dedup.winnow_lines(docs)
    return done.where("n_deleted = 0 or length(trim(text)) > 0").select(*docs.columns)


def join_ngrams(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """N-gram Jaccard join: one document of each group stays."""
    return ngram_join.one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing to target weights: small sources repeat, no more than twice; none is cut."""
    return mixing.temperature_mix(docs).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Best-fit packing into sequences of 1024 tokens."""
    return packing.best_fit_pack(docs)


STAGES = [("toxicity", drop_toxic), ("line dedup", dedup_lines), ("n-gram Jaccard join", join_ngrams), ("mixing", mix_sources), ("best-fit packing", pack)]

#: Packing by a tokenizer and the fitted model can't be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
