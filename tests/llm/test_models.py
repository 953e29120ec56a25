"""The trained networks, and the pipeline over planted documents."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from strandloom.llm import language, toxicity

EN = "the of and that with from have this which their about would there".split()
DE = "und der die nicht mit sich auch nach über zwischen größer möchte schön".split()


def held(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


def sentence(rng, words, n):
    return " ".join(rng.choice(words) + rng.choice(["", "", ","]) for _ in range(n))


def test_gradients_of_the_recurrent_network():
    rng = np.random.default_rng(0)
    p = {k: v.astype(np.float64) for k, v in toxicity.initial(rng).items()}
    words = toxicity.Words(pa.array(["one two three two", "four five", "x " * 40]))
    first, size, _ = words.windows(toxicity.WINDOW)
    side = rng.standard_normal(len(first))

    def loss():
        vectors, gates = toxicity._inputs(p, words)
        logit, cache = toxicity._forward(p, gates, words.index, first, size, True)
        return float(logit @ side), vectors, cache

    _, vectors, cache = loss()
    gradients = toxicity._backward(p, words, vectors, cache, side)
    for name, g in gradients.items():
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        old, step = p[name][at], 1e-3
        p[name][at] = old + step
        up = loss()[0]
        p[name][at] = old - step
        down = loss()[0]
        p[name][at] = old
        assert np.isclose((up - down) / (2 * step), g[at], rtol=0.05, atol=1e-3), name


def test_windows_cover_every_word():
    words = toxicity.Words(pa.array(["", "a " * 31, "b " * 33, "c " * 100, "...", "d"]))
    first, size, text = words.windows()
    assert set(text) == {1, 2, 3, 5}
    seen = {int(w) for f, s in zip(first, size) for w in range(f, f + s)}
    assert seen == set(range(len(words.index)))


@pytest.fixture(scope="module")
def toxic_tables(spark):
    rng = random.Random(1)
    docs, labels = [], []
    for i in range(300):
        bad = i % 4 == 0
        words = sentence(rng, EN + DE, rng.randrange(30, 120)).split()
        if bad:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(["scum", "IDIOT!", "moron"]))
        docs.append((i, " ".join(words), "en", "s", len(words), 0.5))
        if i % 3 or bad:
            labels.append((i, 1, int(bad)))
    docs += [(1000, None, None, None, None, 0.5), (None, "", "en", "s", 0, 0.5), (1001, "scum idiot moron " + "the " * 20_000, "en", "s", 1, 0.5), (0, docs[0][1], "en", "s", 1, 0.5)]
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long, _score double")
    return d, spark.createDataFrame(labels + [(None, 1, 1), (5, 1, None)], "doc_id long, quality int, toxic int")


def test_toxicity(spark, toxic_tables, tmp_path):
    d, labels = toxic_tables
    p = toxicity.fitted(d, labels)
    rows = toxicity.scored(d, p).collect()
    assert len(rows) == d.count() and all(0 <= r["score"] <= 1 for r in rows)
    of = {r["doc_id"]: r for r in rows}
    assert all(r["held_out"] == held(i) for i, r in of.items() if i is not None)
    tested = [(i % 4 == 0, of[i]["predicted"] == 1) for i in range(300) if held(i)]
    assert np.mean([a == b for a, b in tested]) > 0.9
    assert of[1001]["predicted"] == 1 and of[1000]["predicted"] == 0
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    left = toxicity.toxicity_stage(spark, d, str(tmp_path))
    assert left.columns == d.columns
    clean = {i for i, r in of.items() if r["predicted"] == 0}
    assert {r["doc_id"] for r in left.collect()} == clean
    nested = d.withColumn("c0", F.struct(F.lit(1).alias("a-b c"), F.array(F.col("lang")).alias("x"))).withColumn("n.c", F.lit(None).cast("date"))
    passed = toxicity.toxicity_stage(spark, nested, str(tmp_path))
    assert passed.columns == nested.columns and passed.where("c0.`a-b c` = 1").count() == left.count()
    empty = toxicity.toxicity_stage(spark, d.where("false"), str(tmp_path))
    assert empty.columns == d.columns and empty.count() == 0
    assert {r["score"] for r in toxicity.scored(d, toxicity.fitted(d, labels.where("toxic = 0"))).collect()} == {0.0}
    assert toxicity.scored(d.where("false"), p).count() == 0


def test_language(spark):
    rng = random.Random(2)
    docs = [(i, sentence(rng, DE if i % 2 else EN, rng.randrange(5, 200)).upper() if i % 9 == 0 else sentence(rng, DE if i % 2 else EN, rng.randrange(5, 200)), "de" if i % 2 else "en", 1) for i in range(400)]
    docs += [(500, None, "en", 1), (501, "", "de", 1), (502, "123 !?", "en", 1), (503, "und der " * 30_000, None, 1), (None, "the of", "en", 1), (4, docs[4][1], "en", 1)]
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string, lang_pred int")
    rows = language.identified(d, language.fitted(d)).collect()
    of = {r["doc_id"]: r for r in rows}
    assert len(rows) == len(docs) and all(0 <= r["score"] <= 1 for r in rows)
    assert [of[i]["lang_pred"] for i in (500, 501, 502)] == ["und"] * 3 and of[503]["lang_pred"] == "de"
    assert np.mean([of[i]["lang_pred"] == ("de" if i % 2 else "en") for i in range(400) if held(i)]) > 0.97
    assert language.fitted(d.where("lang is null")) is None
    assert {r["lang_pred"] for r in language.identified(d, None).collect()} == {"und"}
    assert language.identified(d.where("false"), None).count() == 0


def test_language_tables_equal_the_convolution():
    rng = np.random.default_rng(3)
    x = rng.integers(0, 256, (4, language.WINDOW)).astype(np.uint8)
    p = language.train(x, np.array([0, 1, 2, 0]), 3)
    pooled = []
    for w in language.WIDTHS:
        slides = np.stack([p["embed"][x[:, k : language.WINDOW - w + 1 + k]] for k in range(w)], axis=2)
        pooled.append(np.einsum("nlkd,kdf->nlf", slides, p[f"filter{w}"]).max(axis=1))
    pooled = np.maximum(np.concatenate(pooled, axis=1) + p["bias"], 0)
    want = language.softmax(pooled @ p["out"] + p["out_bias"])
    assert np.allclose(language.Scorer(p, ["a", "b", "c"]).windows(x), want, atol=1e-5)


def test_byte_windows_cover_every_byte():
    data, begins, sizes = language.bytes_of(pa.array(["", "Ab" * 127, "é" * 700, "x"]))
    x, length, text = language.tiled(data, begins, sizes)
    step = language.WINDOW - max(language.WIDTHS) + 1
    for t in range(4):
        parts = [bytes(r[:n]) for r, n, o in zip(x, length, text) if o == t]
        joined = b"".join(p[:step] for p in parts[:-1]) + (parts[-1] if parts else b"")
        assert joined == bytes(data[begins[t] : begins[t] + sizes[t]])


def test_pipeline_over_planted_documents(spark, toxic_tables, tmp_path):
    """Toxic rows go, of copies and near copies one stays, every other document is packed as often as its copies say."""
    d, labels = toxic_tables
    rng = random.Random(7)
    base = sentence(rng, EN, 400)
    extra = [(2000, base), (2001, base), (2002, " " + base), (2003, base.replace(" ", "  ", 3))]
    more = spark.createDataFrame([(i, t, "en", "s", 1, 0.5) for i, t in extra], d.schema)
    docs = d.unionByName(more).drop("_score")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    sizes, now = {}, spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, str(tmp_path)).cache()
        sizes[name] = sorted(r["doc_id"] if r["doc_id"] is not None else -1 for r in now.collect())
        if name != "packing":
            assert now.columns == docs.columns
    assert 1001 not in sizes["toxicity"] and {2000, 2001, 2002, 2003, 1000} <= set(sizes["toxicity"])
    assert len({2000, 2001, 2002, 2003} & set(sizes["exact_dedup"])) == 1
    assert len(set(sizes["near_dedup"])) == len(sizes["near_dedup"])
    clean = [i for i in range(300) if i % 4]
    assert np.mean([i in sizes["near_dedup"] for i in clean]) > 0.9
    assert set(sizes["mixing"]) <= set(sizes["near_dedup"]) and set(sizes["packing"]) == set(sizes["mixing"])
    result = corpus_pipeline.run(spark, str(tmp_path))
    assert result.columns == now.columns and result.count() == now.count()
