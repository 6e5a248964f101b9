"""Thin queries over the operators, and SQL for those whose result SQL expresses."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from . import audio, line_dedup, mixing, ngram_join, packing, quality, sharding, token_counts, token_store, toxicity
from .common import materialize, read_table, shared_dir


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_fit_pack(read_table(spark, sf_dir, "documents"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.temperature_mix(read_table(spark, sf_dir, "documents")).select("doc_id", "source", "epoch")


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.uniform_shards(read_table(spark, sf_dir, "documents"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_cascade(read_table(spark, sf_dir, "documents")).select("doc_id", *quality.BASE, "base_failed", "kept")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, read_table(spark, sf_dir, "labels"))
    scored = toxicity.toxicity(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", toxicity.held_out(scored["doc_id"]).alias("held_out"), "score", "predicted", "n_passages")


def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(read_table(spark, sf_dir, "documents"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(read_table(spark, sf_dir, "documents"))


def op8_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/quantalume/store-{uuid.uuid4().hex}"
    token_store.write_token_store(read_table(spark, sf_dir, "documents"), path)
    return token_store.read_token_store(spark, path)


def op9_telephony_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = materialize(audio.texts_as_audio(read_table(spark, sf_dir, "documents")), "media")
    return audio.media_features(stored)


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.winnow_lines(read_table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_deleted", "text")


def queries() -> dict:
    own = [
        op1_best_fit_packing, op2_mixing, op3_sharding, op4_quality_rules, op5_toxicity, op6_ngram_jaccard, op7_token_counts,
        op8_token_store, op9_telephony_audio, op10_line_dedup,
    ]
    return {f.__name__: f for f in own}


_WORDS = r"list_filter(regexp_split_to_array({}, '[\x20\x09-\x0D]+'), lambda x: x<>'')"

OP4_SQL = rf"""WITH d AS (SELECT row_number() OVER () k, doc_id, coalesce(text,'') t FROM documents), w AS (SELECT *, {_WORDS.format("t")} w, string_split(t, chr(10)) l FROM d),
 v AS (SELECT *, list_filter(l, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) m FROM w),
 g AS (SELECT k, i, w[i] a, w[i+1] b, w[i+2] c FROM (SELECT k, w, unnest(range(1, len(w)-1)) i FROM w)), r AS (SELECT k, i FROM g QUALIFY count(*) OVER (PARTITION BY k, a, b, c)>1),
 p AS (SELECT k, count(DISTINCT j) n FROM (SELECT k, unnest([i,i+1,i+2]) j FROM r) GROUP BY 1),
 f AS (SELECT v.k, doc_id, t, w, l, len(w)::BIGINT n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))),0)::BIGINT word_chars, length(regexp_replace(t,'[^#*$%&|<>]','','g'))::BIGINT n_symbols,
 (len(m)-len(list_distinct(m)))::BIGINT n_dup_lines, coalesce(p.n,0)::BIGINT n_repeat_words FROM v LEFT JOIN p ON v.k=p.k),
 b AS (SELECT *, n_words<50 OR 100*n_repeat_words>50*n_words base_failed FROM f)
 SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT (base_failed OR n_symbols*10>n_words OR word_chars<2*n_words OR word_chars>15*n_words OR n_dup_lines*2>len(l)
 OR 2*length(regexp_replace(t,'[^A-Z]','','g'))>word_chars OR 5*length(regexp_replace(t,'[^!]','','g'))>n_words OR 10*len(list_filter(w, lambda x: regexp_full_match(x, '[\x00-\x40\x5B-\x60\x7B-\x7F]+')))>3*n_words
 OR 10*len(list_filter(l, lambda x: x LIKE '%...' OR x LIKE '%…'))>3*len(l)) AS kept FROM b"""

OP6_SQL = rf"""WITH RECURSIVE d AS (SELECT row_number() OVER () k, doc_id, {_WORDS.format("translate(coalesce(text,''),'ABCDEFGHIJKLMNOPQRSTUVWXYZ','abcdefghijklmnopqrstuvwxyz')")} w FROM documents),
 s AS (SELECT DISTINCT k, CASE WHEN len(w)<5 THEN array_to_string(w,' ') ELSE array_to_string(w[i:i+4],' ') END g FROM (SELECT k, w, unnest(range(1, greatest(2, len(w)-3))) i FROM d WHERE len(w)>0)),
 n AS (SELECT k, count(*) n FROM s GROUP BY 1), c AS (SELECT a.k a, b.k b, count(*) c FROM s a JOIN s b ON a.g=b.g AND a.k<b.k GROUP BY 1,2),
 e AS (SELECT a, b FROM c JOIN n x ON x.k=a JOIN n y ON y.k=b WHERE 100*c>=80*(x.n+y.n-c)), f AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
 r AS (SELECT k, k j FROM d UNION SELECT r.k, f.b FROM r JOIN f ON f.a=r.j), m AS (SELECT r.k, min(o.doc_id) m FROM r JOIN d o ON o.k=r.j GROUP BY 1)
 SELECT doc_id, coalesce(n,0)::BIGINT AS n_shingles, m AS component_id FROM d LEFT JOIN n ON n.k=d.k LEFT JOIN m ON m.k=d.k"""

# windows of 50 words from each line on, and up to each line, as whole texts; every one that stood earlier is deleted
OP10_SQL = rf"""WITH d AS (SELECT row_number() OVER (ORDER BY doc_id NULLS LAST) k, doc_id, text t FROM documents),
 l AS (SELECT k, unnest(range(1, len(x)+1)) i, unnest(x) s FROM (SELECT k, string_split(t, chr(10)) x FROM d WHERE t IS NOT NULL)), w AS (SELECT *, len({_WORDS.format("s")}) n FROM l),
 c AS (SELECT *, sum(n) OVER (PARTITION BY k ORDER BY i) c FROM w), a AS (SELECT a.k, a.i f, min(b.i) g FROM c a JOIN c b ON a.k=b.k AND b.i>=a.i AND b.c>=a.c-a.n+50 GROUP BY 1,2),
 b AS (SELECT b.k, max(a.i) f, b.i g FROM c a JOIN c b ON a.k=b.k AND b.i>=a.i AND b.c>=a.c-a.n+50 GROUP BY 1,3), u AS (SELECT * FROM a UNION SELECT * FROM b),
 v AS (SELECT u.k, f, g, string_agg(s, chr(10) ORDER BY i) x FROM u JOIN l ON l.k=u.k AND i BETWEEN f AND g GROUP BY 1,2,3),
 z AS (SELECT k, f, g FROM v QUALIFY row_number() OVER (PARTITION BY x ORDER BY k, f)>1), q AS (SELECT DISTINCT l.k, i FROM z JOIN l ON l.k=z.k AND i BETWEEN f AND g),
 o AS (SELECT l.k, count(*) n, count(q.i) g, coalesce(string_agg(s, chr(10) ORDER BY l.i) FILTER (q.i IS NULL),'') x FROM l LEFT JOIN q ON q.k=l.k AND q.i=l.i GROUP BY 1)
 SELECT doc_id, coalesce(n,0)::BIGINT AS n_lines, coalesce(g,0)::BIGINT AS n_deleted, CASE WHEN t IS NULL THEN NULL ELSE x END AS text FROM d LEFT JOIN o ON o.k=d.k"""


def oracle_sql() -> dict[str, str]:
    """SQL of the operators whose whole result it expresses.

    None for the others: tokenizer ids (1, 7, 8), a hash order of documents (2,
    3), a fitted model (5) and decoded samples (9); tests compare those with
    brute force, round trips or held-out rows.
    """
    return {"op4_quality_rules": OP4_SQL, "op6_ngram_jaccard": OP6_SQL, "op10_line_dedup": OP10_SQL}
