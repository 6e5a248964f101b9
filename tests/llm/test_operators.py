"""Edge cases (nulls, empty and long texts, ties, repeats, clashing columns, empty tables) and brute force."""

import random
import zlib
from array import array

import numpy as np
import pytest
from pyspark.sql import functions as F

from quantalume.llm import audio, line_dedup, mixing, ngram_join, packing, quality, sharding, token_counts, token_store, tokens, toxicity

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, epoch string, n_words string"
WORDS = [f"w{i}x" for i in range(400)]


def long_text(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


def texts():
    base = long_text(1, 300)
    near = base.replace(" w5x ", " w6x ")
    passage = long_text(2, 60)
    return [
        (1, base), (2, near), (3, base), (4, None), (5, ""), (6, "one two"), (7, "One  two"), (None, "lonely words here"), (8, long_text(3, 3000)),
        (9, "first line\n" + passage), (10, "other start\n" + passage + "\ntail"), (6, "one two"), (11, " \n\t "), (12, "idiot " + long_text(4, 80)),
    ]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "en", "a" if k % 3 else None, 0, 1.0, "e", "n") for k, (i, t) in enumerate(texts())], SCHEMA)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokens.vocabulary_path())


def test_encoder_equals_library(library):
    odd = ["  a  b", "\n", "a\n\nb", " a", "a ", "x<|endoftext|> y", "don't 's it's", "é, ü. ß!", "日本語 テスト, 12", "a\r\nb c\x0b d", "word### word,word."]
    for t in [*odd, *[t for _, t in texts() if t]]:
        for _ in range(3):
            assert tokens.encoder(tokens.vocabulary_path()).encode(t) == array("I", library.encode(t, add_special_tokens=False).ids).tobytes()


def test_encoder_keeps_few_pieces_and_equals_library(library):
    import pyarrow as pa

    r = random.Random(7)
    bits, gaps = ["a", "the", "é", "日本", "'s", "|", "<|endoftext|>", "12", "%%%", ",", "\x00", "\u01c6"], [" ", " ", " ", "\n", "  ", "\n\n", "\t", " \n", "\x0b", "\x1f", "\x85", "\xa0", "\u3000"]
    odd = ["".join(r.choice(bits) + r.choice(bits) + r.choice(gaps) for _ in range(r.randrange(30))) for _ in range(150)]
    many = [None, "", *odd, *(" ".join(f"w{k * 50 + i}x," for i in range(100)) for k in range(100)), " \n"]
    enc = tokens.PieceEncoder(tokens.vocabulary_path(), max_entries=500, slice_bytes=2000)
    for kind in (pa.string(), pa.large_string()):
        got = list(enc.encode_all(pa.array(["cut", *many], kind)[1:]))
        assert got == [array("I", library.encode(t or "", add_special_tokens=False).ids).tobytes() for t in many]
        assert 0 < len(enc._keys) <= 500 and len(enc._keys) == len(enc._ids)
    assert list(enc.encode_all(pa.array([], pa.string()))) == []


def test_packing(docs, empty, library):
    rows = packing.best_fit_pack(docs, partition_rows=4).toPandas()
    ids = [array("I", library.encode(t or "", add_special_tokens=False).ids + [2]).tobytes() for _, t in texts()]
    assert rows["length"].sum() == sum(len(x) // 4 for x in ids)
    assert rows.groupby("sequence_id")["length"].sum().max() <= 1024
    s = rows.sort_values(["sequence_id", "offset"])
    assert (s.groupby("sequence_id")["length"].cumsum() - s["length"] == s["offset"]).all()
    assert set(rows[rows.doc_id == 4]["ids_crc32"]) == {zlib.crc32(ids[3])}
    assert rows["sequence_id"].nunique() <= packing.lower_bound(rows["length"].to_numpy(), 1024) + 1
    assert packing.best_fit_pack(empty).count() == 0


def test_bounds_and_best_fit_against_brute_force():
    rng = np.random.default_rng(1)
    for _ in range(30):
        sizes = rng.integers(1, 13, 7)
        best = 7

        def place(i, bins):
            nonlocal best
            if len(bins) >= best:
                return
            if i == len(sizes):
                best = len(bins)
                return
            for b in range(len(bins)):
                if bins[b] + sizes[i] <= 12:
                    place(i + 1, bins[:b] + [bins[b] + sizes[i]] + bins[b + 1 :])
            place(i + 1, [*bins, sizes[i]])

        place(0, [])
        used = len(packing.best_fit_decreasing(sizes, 12)[2])
        assert packing.lower_bound(sizes, 12) <= best <= used


def test_sharding(docs, empty):
    rows = sharding.uniform_shards(docs, shards=5, bucket_rows=3).toPandas()
    counts = rows.groupby("shard").size()
    assert len(rows) == len(texts()) and counts.max() - counts.min() <= 1
    assert all(sorted(g) == list(range(len(g))) for _, g in rows.groupby("shard")["slot"])
    assert sharding.uniform_shards(empty).count() == 0
    m = sharding.communication_matrix([5, 0, 9], [5, 5, 4], 1)
    assert m.sum(1).tolist() == [5, 0, 9] and m.sum(0).tolist() == [5, 5, 4]


def brute_base(text):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    hit = {j for i, g in enumerate(grams) if grams.count(g) > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(hit)


def test_quality(docs, empty, spark):
    rows = quality.quality_cascade(docs).collect()
    assert "score" in rows[0].asDict()
    for r in rows:
        assert tuple(r[c] for c in quality.BASE) == brute_base(r["text"])
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"])
    more = spark.createDataFrame([(1, "a b c a b c a b\nx\nx\n#x"), (2, "De De De De asga asga")], "doc_id long, text string")
    for r in quality.with_base(more).collect():
        assert tuple(r[c] for c in quality.BASE) == brute_base(r["text"])
    assert quality.quality_cascade(empty).count() == 0


def test_toxicity(spark, empty):
    rng = random.Random(5)
    rows, labels = [], []
    for i in range(400):
        bad = i % 4 == 0
        words = [rng.choice(WORDS) for _ in range(60)]
        if bad:
            words[rng.randrange(60)] = rng.choice(["idiot", "scum"])
        rows.append((i, " ".join(words)))
        labels.append((i, int(bad)))
    docs, lab = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.fit(docs, lab)
    got = {r["doc_id"]: r for r in toxicity.toxicity(docs, model).where(toxicity.held_out(F.col("doc_id"))).collect()}
    assert got and sum(r["predicted"] == (i % 4 == 0) for i, r in got.items()) >= 0.97 * len(got)
    assert 0 <= model.score(None) == model.score("") < 0.3
    assert toxicity.toxicity(empty, model).count() == 0


def test_toxicity_learns_from_all_training_rows(spark):
    rng = random.Random(6)
    rare, rows, labels = [f"vile{chr(97 + k)}" for k in range(12)], [], []
    for i in range(1300):
        words = [rng.choice(WORDS) for _ in range(40)]
        if i % 10 == 0:
            words[rng.randrange(40)] = rare[i // 10 % 12]
        rows.append((i, " ".join(words)))
        labels.append((i, int(i % 10 == 0)))
    docs, lab = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.fit(docs, lab)
    assert set(rare) <= set(model.lexicon)
    got = toxicity.toxicity(docs, model).where(toxicity.held_out(F.col("doc_id"))).collect()
    assert all(r["predicted"] == (r["doc_id"] % 10 == 0) for r in got)


def test_toxic_passages_of_long_texts():
    model = toxicity.ToxicityModel({"bad": 10.06}, 1.0)
    assert len(model.passages("bad " + "word " * 500)) == 1 and model.passages("bad " + "word " * 20_000) == []


def test_maximal_segments_hold_the_best_sum():
    rng = random.Random(2)
    for _ in range(50):
        score = {i: rng.choice([1.0, 2.0]) for i in range(30) if rng.random() < 0.3}
        v = [score.get(i, -0.7) for i in range(30)]
        best = max(sum(v[i:j]) for i in range(30) for j in range(i + 1, 31))
        found = toxicity.maximal_segments(sorted(score.items()), -0.7)
        assert max((s for *_, s in found), default=-0.7) == pytest.approx(best)


def brute_components(rows):
    sets = [set(ngram_join.shingle_set(t).tolist()) for _, t in rows]
    near = lambda a, b: a and b and 100 * len(a & b) >= 80 * len(a | b)
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if near(sets[i], sets[j]):
                a, b = group[i], group[j]
                group = [min(a, b) if g in (a, b) else g for g in group]
    return {rows[i][0]: min(rows[k][0] for k in range(len(rows)) if group[k] == group[i]) for i in range(len(rows))}


def test_ngram_join(docs, empty, spark):
    got = {r["doc_id"]: r for r in ngram_join.jaccard_components(docs).collect()}
    assert got[2]["component_id"] == got[3]["component_id"] == 1 and got[7]["component_id"] == 6 and got[None]["component_id"] is None
    assert got[4]["n_shingles"] == got[5]["n_shingles"] == got[11]["n_shingles"] == 0 and got[6]["n_shingles"] == 1
    rng, rows = random.Random(7), []
    for i in range(120):
        words = long_text(i % 9, rng.choice([6, 9, 14, 40, 120])).split()
        for _ in range(rng.randrange(4)):
            words[rng.randrange(len(words))] = rng.choice(WORDS)
        rows.append((i, " ".join(words)))
    found = ngram_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["component_id"] for r in found} == brute_components(rows)
    assert ngram_join.jaccard_components(empty).count() == 0


def test_parity_bitmap_keeps_every_match():
    r = np.random.default_rng(5)
    for n in (1, 4, 9, 40, 300, 3000):
        for _ in range(20):
            pool = np.unique(r.integers(0, 2**63, n, np.uint64))
            a, b = (np.unique(np.concatenate([pool, r.integers(0, 2**63, int(r.integers(0, max(1, n // 9) + 1)), np.uint64)])) for _ in range(2))
            differ = sum(bin(int(x) & (2**64 - 1)).count("1") for x in ngram_join.parity_bitmap(a) ^ ngram_join.parity_bitmap(b))
            assert differ <= len(np.setxor1d(a, b))
            if ngram_join.matches(a, b):
                assert 9 * differ <= len(a) + len(b)


def test_pairs_across_components_against_brute_force(spark):
    r = random.Random(8)
    # odd buckets are of 2-subsets
    rows = [(2 * h + odd, r.randint(1, 3), i, 100 + i % 5, i // 3) for i in range(40) for odd, most in ((0, 60), (1, 12)) for h in r.sample(range(most), most // 6)]
    wide = {h: w for h, w, *_ in rows}
    rows = [(h, wide[h], *x) for h, _, *x in rows]
    signs = spark.createDataFrame([(i, *[0] * len(ngram_join.SIGNS)) for i in range(40)], "id bigint, " + ", ".join(f"{s} bigint" for s in ngram_join.SIGNS))
    entries = spark.createDataFrame(rows, "h bigint, w bigint, id bigint, n int, component bigint")
    got = ngram_join._across(ngram_join._earlier(entries), signs).collect()
    lists = {i: {h for h, _, j, *_ in rows if j == i} for i in range(40)}
    expected = set()
    for a in range(40):
        for b in range(a + 1, 40):
            both = lists[a] & lists[b]
            enough = any(h & 1 for h in both) or sum(wide[x] for x in both) >= 4
            if a // 3 != b // 3 and enough:
                expected.add((a, b))
    assert len(got) == len({tuple(x) for x in got}) and {(x["a"], x["b"]) for x in got} == expected


def test_ngram_join_of_null_equal_and_repeated_ids(spark):
    base, other = long_text(1, 300), long_text(2, 300)
    near = base.replace(" w5x ", " w6x ")
    rows = [(5, base), (None, near), (7, other), (7, base), (9, other), (9, other), (None, other + " z"), (None, "alone here"), (3, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r["doc_id"], r["text_hash"]): r["component_id"] for r in ngram_join._members(df).collect()}
    keys = [(r["doc_id"], r["t"]) for r in df.select("doc_id", F.xxhash64("text").alias("t")).collect()]
    assert [got[k] for k in keys] == [5, 5, 7, 5, 7, 7, 7, None, 3]
    kept = [tuple(r) for r in ngram_join.one_of_each(df).collect()]
    assert sorted(kept, key=str) == sorted([(5, base), (7, other), (None, near), (None, other + " z"), (None, "alone here"), (3, None)], key=str)
    again = spark.createDataFrame([(1, base, 1), (1, base, 2), (2, near, 3)], "doc_id long, text string, d_ int")
    kept = ngram_join.one_of_each(again).collect()
    assert len(kept) == 1 and kept[0]["doc_id"] == 1


def test_frequency_sketch_counts_all_documents(spark):
    rows = [(i, long_text(i, 30) + " " + long_text(99, 12)) for i in range(300)]
    counts, mean_list = ngram_join._statistics(spark.createDataFrame(rows, "doc_id long, text string").repartition(7))
    sets = [ngram_join.shingle_set(t) for _, t in rows]
    every = np.concatenate(sets)
    assert counts.sum() == len(every) and (counts == np.bincount((every >> ngram_join.SLOT_SHIFT).astype(int), minlength=ngram_join.SLOTS)).all()
    assert mean_list == pytest.approx(len(every) / len(np.unique(every)), rel=0.1)


def test_token_counts_equal_the_unigram_model(docs, empty):
    from tokenizers import Tokenizer, models, pre_tokenizers

    vocabulary = token_counts.unigram_vocabulary(tokens.vocabulary_path("piece_bpe_32k.model"))
    model = Tokenizer(models.Unigram([("<unk>", 0.0), *vocabulary], unk_id=0))
    model.pre_tokenizer = pre_tokenizers.Metaspace()
    own = token_counts.CountOnlyViterbi((("<unk>", 0.0), *vocabulary))
    for t in ["", "hello world", "  two  spaces ", "naïve ﷽ﷻ text", "tab\tand\nline", long_text(9, 50), "Ünverzüglich 日本"]:
        assert own.count(t) == len(model.encode(t).ids), t
    assert token_counts.token_counts(docs).count() == len(texts()) and token_counts.token_counts(empty).count() == 0


def test_token_store(docs, empty, spark, tmp_path, library):
    path = "file://" + str(tmp_path / "store")
    token_store.write_token_store(docs, path, block_tokens=500)
    rows = token_store.read_token_store(spark, path).orderBy("start").collect()
    order = sorted(texts(), key=lambda x: (x[0] is not None, x[0] or 0, x[1] or ""))
    ids = [array("I", library.encode(t or "", add_special_tokens=False).ids + [2]).tobytes() for _, t in order]
    assert [r["doc_id"] for r in rows] == [i for i, _ in order]
    assert [r["ids_crc32"] for r in rows] == [zlib.crc32(x) for x in ids]
    assert [r["start"] for r in rows] == np.cumsum([0, *[len(x) // 4 for x in ids]])[:-1].tolist()
    token_store.write_token_store(empty, path + "0")
    assert token_store.read_token_store(spark, path + "0").count() == 0


def test_elias_fano():
    rng = np.random.default_rng(4)
    for n in (1, 2, 63, 64, 65, 1000):
        v = np.cumsum(rng.integers(1, 900, n))
        ef = token_store.EliasFano.of(v)
        assert (ef.all() == v).all() and [ef.select(i) for i in range(n)] == v.tolist()
        assert len(ef.high) + len(ef.low) + len(ef.samples) < 2.5 * n + 16


def test_audio(docs, empty):
    rows = audio.media_features(audio.texts_as_audio(docs)).collect()
    assert len(rows) == len(texts()) and all(r["payload_bytes"] % 64 == 0 and r["payload_bytes"] >= max(64, r["n_bytes"]) for r in rows)
    assert audio.media_features(audio.texts_as_audio(empty)).count() == 0
    assert audio.mulaw_table()[[0, 127, 128, 255]].tolist() == [-32124, 0, 32124, 0]
    assert audio.alaw_table()[[0x55, 0xD5, 0x2A, 0xAA]].tolist() == [-8, 8, -32256, 32256]
    t = (8000 * np.sin(np.arange(2000) / 9)).astype(np.int16)
    back = audio.decode_adpcm(audio.encode_adpcm(t)).ravel()[:2000].astype(int)
    assert np.abs(back - t)[50:].mean() < 400
    rate, pcm = audio.decode_wave(audio.wave(audio.encode_adpcm(t).tobytes(), audio.IMA_ADPCM, block=64))
    assert rate == 8000 and len(audio.resample_double(pcm)) == 2 * len(pcm)


def test_line_dedup(docs, empty):
    rows = {r["doc_id"]: r for r in line_dedup.winnow_lines(docs).collect()}
    assert rows[10]["text"] == "other start\ntail" and rows[9]["n_deleted"] == 0
    assert rows[3]["text"] == "" and rows[1]["n_deleted"] == 0 and rows[4]["text"] is None and rows[5]["n_lines"] == 1
    assert line_dedup.winnow_lines(empty).count() == 0


def test_line_dedup_extends_runs(spark):
    run = [f"line {k} " + long_text(k, 17) for k in range(5)] + ["short end"]
    rows = [(1, "\n".join(["a", *run, "b"])), (2, "\n".join(["c", *run, "d"])), (3, "\n".join(run[:2])), (4, "\n".join(run[1:5]))]
    got = {r["doc_id"]: r for r in line_dedup.winnow_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[2]["text"] == "c\nd" and got[3]["n_deleted"] == 0 and got[4]["text"] == ""


def brute_dedup(rows, min_words=50):
    """Lines left of each text: those in a run of min_words words that stood at an earlier place go."""
    seen, out = set(), {}
    for i, text in rows:
        lines = text.split("\n")
        dead = set()
        for a in range(len(lines)):
            for b in range(a + 1, len(lines) + 1):
                if sum(len(x.split()) for x in lines[a:b]) >= min_words:
                    if tuple(lines[a:b]) in seen:
                        dead |= set(range(a, b))
                    seen.add(tuple(lines[a:b]))
        out[i] = "\n".join(x for k, x in enumerate(lines) if k not in dead)
    return out


def test_line_dedup_of_short_lines_against_brute_force(spark):
    x = [f"line {k} " + long_text(k, 9) for k in range(1, 6)]
    rows = [(1, "\n".join(x[:4])), (2, "\n".join(x[1:])), (3, "\n".join(["own 3", *x, "end 3"])), (4, "\n".join(["own 4", *x, "end 4"]))]
    ha = [(11, "\n".join(["ha ha ha"] * 4)), (12, "\n".join(["ha ha ha"] * 20)), (13, "\n".join(["ha ha ha"] * 20))]
    r, pool = random.Random(3), [long_text(k, n) for k, n in enumerate([1, 2, 3, 5, 9, 14, 30, 55])] + ["", " \t"]
    base = [[r.choice(pool) for _ in range(30)] for _ in range(3)]
    mixed = []
    for i in range(60):
        b, at = r.choice(base), r.randrange(25)
        part = b[at : at + r.randrange(1, 25)]
        mixed.append((20 + i, "\n".join([f"own {i}"] * r.randrange(2) + part + [r.choice(pool)] * r.randrange(3))))
    rows += ha + mixed + [(100, "\n" * 3000 + x[0]), (101, "a\nb")]
    got = {d["doc_id"]: d["text"] for d in line_dedup.winnow_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[4] == "own 4\nend 4" and got[13] == ""
    assert got == brute_dedup([x for x in rows if x[0] != 100]) | {100: rows[-2][1]}


def test_mixing(docs, empty, spark):
    out = mixing.temperature_mix(docs)
    assert "epoch" in out.columns and out.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()
    assert mixing.temperature_mix(empty).count() == 0
    rows = [(i, "x " * 9, "big" if i % 4 else "small") for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    counts = dict(mixing.temperature_mix(df, max_repeats=1.5, block_rows=30).groupBy("source").count().collect())
    assert counts["big"] == 300 and 148 <= counts["small"] <= 150
    totals = mixing.token_shares(mixing.keyed(df))
    a = mixing.find_exponent(totals, max_repeats=1.5)
    assert (0.25 / 0.75) ** (a - 1) == pytest.approx(1.5, abs=1e-4)
    cut = mixing.temperature_mix(df, max_repeats=None, target_entropy=0.69, budget_tokens=1000, block_rows=30)
    assert 900 <= cut.count() * 10 <= 1000


def test_long_scans_are_linear_and_find_all_maximal_segments():
    rng = random.Random(12)

    def brute(v):
        """Maximal segments by their definition: the best-scoring stretch (shortest, then first), then both sides of it."""
        best = max(((sum(v[i:j]), i - j, -i) for i in range(len(v)) for j in range(i + 1, len(v) + 1)), default=(0, 0, 0))
        if best[0] <= 1e-9:
            return []
        i = -best[2]
        j = i - best[1]
        return brute(v[:i]) + [(i, j - 1)] + [(a + j, b + j) for a, b in brute(v[j:])]

    for _ in range(60):
        score = {i: rng.choice([1.0, 2.25, 0.5]) for i in range(24) if rng.random() < 0.4}
        v = [score.get(i, -0.71) for i in range(24)]
        assert [(a, b) for a, b, _ in toxicity.maximal_segments(sorted(score.items()), -0.71)] == brute(v)
    falling = [(3 * i, 0.1) for i in range(300_000)]
    assert len(toxicity.maximal_segments(falling, -0.2)) == 300_000


def test_token_store_widths_and_documents(docs, spark, tmp_path, library):
    with pytest.raises(ValueError, match="70000"):
        token_store._block(0, 0, 0, [1], [np.array([70000, 2], "<u4").tobytes()], 2)
    path = "file://" + str(tmp_path / "store")
    token_store.write_token_store(docs, path, block_tokens=300)
    by_id = {i: t for i, t in texts() if i in (1, 5, 8)}
    got = {r["doc_id"]: r["ids"] for r in token_store.read_documents(spark, path, [8, 1, 5, 12345]).collect()}
    assert got == {i: library.encode(t or "", add_special_tokens=False).ids + [2] for i, t in by_id.items()}


def test_sharding_against_the_texts_and_repeated_rows(docs, spark):
    rows = sharding.uniform_shards(docs, shards=3, bucket_rows=4).toPandas()
    expected = sorted((i if i is not None else -1, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in texts())
    assert sorted(zip(rows.doc_id.fillna(-1).astype(int), rows["size"], rows.text_crc32)) == expected
    same = spark.range(4000).selectExpr("7L as doc_id", "'same' as text")
    spread = sharding.uniform_shards(same, shards=4, bucket_rows=100).toPandas()
    assert spread.groupby("shard").size().tolist() == [1000] * 4 and all(sorted(g) == list(range(1000)) for _, g in spread.groupby("shard")["slot"])


def test_hypergeometric_draws_beyond_numpy():
    rng = np.random.default_rng(3)
    good, bad, take = 300, 700, 50
    own = np.array([sharding._by_inversion(u, good, bad, take) for u in rng.random(20_000)])
    law = rng.hypergeometric(good, bad, take, 20_000)
    assert abs(own.mean() - 15) < 0.1 and abs(own.var() - law.var()) < 0.4
    cells = [(np.bincount(x, minlength=51)[8:23]) for x in (own, law)]
    assert np.abs(cells[0] - cells[1]).max() < 250
    m = sharding.communication_matrix([5 * 10**9, 7 * 10**9], [4 * 10**9] * 3, 1)
    assert m.sum(1).tolist() == [5 * 10**9, 7 * 10**9] and m.sum(0).tolist() == [4 * 10**9] * 3
    assert np.abs(m[0] - 5 * 10**9 / 3).max() < 10 * np.sqrt(10**9)


def test_sharding_matrix_of_groups_adds_up(spark):
    counts = spark.createDataFrame([(b, 3 + b % 5) for b in range(700)], "bucket int, n long")
    n = sum(3 + b % 5 for b in range(700))
    got = {r["bucket"]: r["cuts"] for r in sharding.cuts_of_buckets(counts, sharding.shard_sizes(n, 6), 5).collect()}
    cells = np.diff(np.array([[0, *got[b]] for b in range(700)]), axis=1)
    assert cells.min() >= 0 and cells.sum(1).tolist() == [3 + b % 5 for b in range(700)] and cells.sum(0).tolist() == sharding.shard_sizes(n, 6)


def test_packing_exchanges_until_it_stops_paying(spark):
    rng = random.Random(4)
    df = spark.createDataFrame([(i, long_text(i, rng.randrange(20, 330))) for i in range(300)], "doc_id long, text string")
    one = packing.best_fit_pack(df, capacity=512).toPandas()
    many = packing.best_fit_pack(df, capacity=512, partition_rows=20).toPandas()
    s = many.sort_values(["sequence_id", "offset"])
    assert (s.groupby("sequence_id")["length"].cumsum() - s["length"] == s["offset"]).all() and s.groupby("sequence_id")["length"].sum().max() <= 512
    pieces = packing.pieces_of(df, tokens.vocabulary_path(), 512, 2).withColumn("row", F.monotonically_increasing_id())
    alone = packing._pack_groups(pieces, -(-len(one) // 20), 512, 0).select("sequence_id").distinct().count()
    assert len(many) == len(one) and one["sequence_id"].nunique() <= many["sequence_id"].nunique() < alone
    same = spark.range(500).selectExpr("1L as doc_id", "'x y' as text")
    assert packing.best_fit_pack(same, partition_rows=50).select("sequence_id").distinct().count() <= 10


def test_mixing_against_brute_force(spark):
    """Passes, budgets and shares of every source, from its words."""
    rng = random.Random(10)
    rows = [(i, " ".join(["w"] * rng.randrange(1, 12)), rng.choice("aaaaaabbc")) for i in range(500)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = mixing.temperature_mix(df, max_repeats=2.0, block_rows=40).collect()
    words = {i: len(t.split()) + 1 for i, t, _ in rows}
    tokens_ = {s: sum(words[i] for i, _, x in rows if x == s) for s in "abc"}
    whole, a = sum(tokens_.values()), mixing.find_exponent(mixing.token_shares(mixing.keyed(df)), max_repeats=2.0)
    p = {s: n / whole for s, n in tokens_.items()}
    budget = whole * sum(x**a for x in p.values()) * max(x ** (1 - a) for x in p.values())
    for s in "abc":
        due = p[s] ** a / sum(x**a for x in p.values()) * budget
        got = sum(words[r["doc_id"]] for r in out if r["source"] == s)
        assert due - 12 * 2 <= got <= due + 1, s
        for e in range(int(round(due) // tokens_[s])):
            assert {r["doc_id"] for r in out if r["source"] == s and r["epoch"] == e} == {i for i, _, x in rows if x == s}


def test_audio_against_brute_force(docs, spark):
    import hashlib

    def decode(block):
        """IMA ADPCM, sample by sample."""
        value, index = int.from_bytes(block[:2], "little", signed=True), min(block[2], 88)
        out = [value]
        for byte in block[4:]:
            for nibble in (byte & 15, byte >> 4):
                step = int(audio.STEPS[index])
                diff = (step >> 3) + (step if nibble & 4 else 0) + (step >> 1 if nibble & 2 else 0) + (step >> 2 if nibble & 1 else 0)
                value = max(-32768, min(32767, value - diff if nibble & 8 else value + diff))
                index = max(0, min(88, index + int(audio.INDEX_CHANGE[nibble])))
                out.append(value)
        return out

    got = {(r["doc_id"], r["n_bytes"]): r for r in audio.media_features(audio.texts_as_audio(docs)).collect()}
    for i, t in texts():
        raw = (t or "").encode()
        data = raw + b"\0" * (max(64, -(-len(raw) // 64) * 64) - len(raw))
        r, media = got[i, len(raw)], audio.wave(data)
        assert r["payload_sha256"] == hashlib.sha256(data).hexdigest() and r["tail_crc32"] == zlib.crc32(data[-64:]) and r["payload_bytes"] == len(data)
        assert r["media_sha256"] == hashlib.sha256(media).hexdigest() and r["media_bytes"] == len(media)
        pcm = [x for k in range(0, len(data), 64) for x in decode(data[k : k + 64])]
        parts = []
        for table in (audio.mulaw_table(), audio.alaw_table()):
            x = [int(table[b]) for b in data]
            parts += [max(map(abs, x)), sum(v * v for v in x) // len(x)]
        parts += [max(map(abs, pcm)), sum(v * v for v in pcm) // len(pcm)]
        assert r["feature"].split()[1:3] + r["feature"].split()[4:6] + r["feature"].split()[7:9] == [str(v) for v in parts]
    odd = spark.createDataFrame([(1, 3, None), (2, 3, bytearray(audio.wave(b"abc"))), (3, 0, bytearray(audio.wave(b"")))], "doc_id long, n_bytes long, media binary")
    rows = {r["doc_id"]: r for r in audio.media_features(odd).collect()}
    assert rows[1]["feature"] is None and rows[2]["payload_bytes"] == 3 and rows[3]["feature"].startswith("mulaw 0 0 alaw 0 0 adpcm 0 0")


def test_decode_media_stores_resampled_pcm(spark, tmp_path):
    t = (8000 * np.sin(np.arange(500) / 9)).astype(np.int16)
    media = [audio.wave(bytes(range(256))), audio.wave(bytes(range(256)), audio.ALAW), audio.wave(audio.encode_adpcm(t).tobytes(), audio.IMA_ADPCM, block=64), audio.wave(b""), None]
    df = spark.createDataFrame([(i, None if m is None else bytearray(m), "x") for i, m in enumerate(media)], "id int, media binary, rate string")
    audio.decode_media(df).write.parquet(str(tmp_path / "pcm"))
    got = {r["id"]: r for r in spark.read.parquet(str(tmp_path / "pcm")).collect()}
    for i, m in enumerate(media[:4]):
        pcm = np.frombuffer(got[i]["pcm"], "<i2")
        assert got[i]["rate"] == 16000 and (pcm[0::2] == audio.decode_wave(m)[1]).all() and len(pcm) == 2 * len(audio.decode_wave(m)[1])
    assert got[4]["pcm"] is None and got[4]["rate"] is None


def test_line_dedup_extends_over_parts_of_several_sources(spark):
    """Every four lines stood earlier in another document, the whole run in one of them only."""
    run = [f"line {k} " + long_text(k, 3) for k in range(20)]
    rows = [(k + 1, "\n".join([f"own {k}", *run[k : k + 4], "end"])) for k in range(17)]
    rows += [(100, "\n".join(["a", *run, "b"])), (101, "\n".join(["c", *run, "d"]))]
    got = {r["doc_id"]: r["text"] for r in line_dedup.winnow_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_dedup(rows) and got[101] == "c\nd" and got[100] == rows[-2][1]


def test_line_dedup_of_long_texts_and_repeated_rows(spark):
    rows = [(1, "w " * 3000 + "\n" + "x" * 1_000_000), (2, "y\n" * 20_000), (3, "w " * 3000 + "\n" + "x" * 1_000_000), (3, "w " * 3000 + "\n" + "x" * 1_000_000)]
    got = [(r["doc_id"], len(r["text"]), r["n_lines"], r["n_deleted"]) for r in line_dedup.winnow_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    # the second text repeats its own lines: each window but the first stood a line earlier
    assert sorted(got) == [(1, 1_006_001, 2, 0), (2, 2, 20_001, 19_999), (3, 0, 2, 2), (3, 0, 2, 2)]


def test_quality_order_follows_rejections_per_cost():
    order = quality.cascade_order([(["a", "b"], 10), (["b"], 1), (["c"], 3), ([], 90)], {"a": 1.0, "b": 2.0, "c": 1.0})
    assert order == ["a", "c", "b"]


def test_quality_verdict_does_not_depend_on_order(docs):
    rows = quality.quality_cascade(docs)
    found = quality.rules()
    again = rows.select("kept", "base_failed", *[F.coalesce(r, F.lit(False)).alias(n) for n, r in found.items()]).collect()
    assert all(r["kept"] == (not r["base_failed"] and not any(r[n] for n in found)) for r in again)
