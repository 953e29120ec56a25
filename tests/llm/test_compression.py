"""The compression classifier: held-out accuracy, a plain computation of scores, and odd inputs."""

import random

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from strandloom.llm.compression import ACCEPTED, FRAME, LEVEL, SEGMENT, Calibration, Model, Sizes, dictionary, fitted, scored, segments, spread_segments

DOCS = "doc_id bigint, text string, score string, label int"
LABELS = "doc_id bigint, quality int, toxic int"


def a_text(rng, good, words=120):
    vocabulary = [f"{a}{b}" for a in ("ran", "til", "mor", "sed") for b in ("ing", "ed", "a", "or", "un")]
    return " ".join(rng.choice(vocabulary) + ("" if good else rng.choice(["$$", "%%", "&&"])) for _ in range(words))


@pytest.fixture(scope="module")
def labelled():
    rng = random.Random(1)
    docs = [(i, a_text(rng, i % 3 > 0, 5 + i % 200)) for i in range(900)]
    return docs, [(i, int(i % 3 > 0), 0) for i in range(900)]


@pytest.fixture(scope="module")
def model(spark, labelled):
    docs, labels = labelled
    return fitted(spark.createDataFrame([(i, t, "x", 1) for i, t in docs], DOCS), spark.createDataFrame(labels, LABELS))


def test_held_out_rows_are_told_apart(spark, labelled, model):
    docs, labels = labelled
    found = scored(spark.createDataFrame([(i, t, "x", 1) for i, t in docs], DOCS), model).collect()
    known = {i: q for i, q, _ in labels}
    held = [r for r in found if r["held_out"]]
    assert len(found) == 900 and 150 < len(held) < 300
    assert np.mean([r["predicted"] == known[r["doc_id"]] for r in held]) > 0.97
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= ACCEPTED) for r in found)


def test_held_out_labels_do_not_matter(spark, labelled, model):
    docs, labels = labelled
    table = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], DOCS)
    held = {r["doc_id"] for r in scored(table, model).where("held_out").collect()}
    turned = [(i, 1 - q if i in held else q, t) for i, q, t in labels]
    again = fitted(table, spark.createDataFrame(turned, LABELS))
    assert again.good == model.good and again.bad == model.bad and (again.calibration.weights == model.calibration.weights).all()


def plain_score(model, text):
    """Score of a text by a frame per segment and dictionary, written out."""
    data = text.encode()
    sizes = []
    for known in (model.good, model.bad):
        total = 0
        for i in range(0, len(data), SEGMENT):
            made = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(known), write_content_size=False, write_checksum=False, write_dict_id=False)
            total += max(len(made.compress(data[i : i + SEGMENT])) - FRAME, 1)
        sizes.append(total)
    good, bad = sizes
    x = [(bad - good) / (good + bad + 20), np.log((good + bad + 20) / (2 * len(data) + 20))]
    c = model.calibration
    a, r = (max(-6, min(6, (v - m) / s)) for v, m, s in zip(x, c.mean, c.scale))
    z = float(np.dot(c.weights, [1, a, r, a * a, a * r, r * r]))
    return 1 / (1 + np.exp(-max(-30, min(30, z))))


def test_scores_against_plain_computation(spark, model):
    rng = random.Random(2)
    rows = [(1, None), (2, ""), (3, "é😀" * 500), (4, a_text(rng, True, 3000)), (5, a_text(rng, False, 3000)), (6, " "), (6, " "), (None, "no id"), (7, "x" * 300_000)]
    found = scored(spark.createDataFrame([(i, t, "s", 2) for i, t in rows], DOCS), model).collect()
    want = [(i, plain_score(model, t or "")) for i, t in rows]
    assert sorted((r["doc_id"] or -1, round(r["score"], 6)) for r in found) == sorted((i or -1, round(s, 6)) for i, s in want)


def test_whole_text_counts(model):
    rng = random.Random(3)
    head = a_text(rng, True, 400)
    sizes = Sizes(model.good, model.bad)
    scores = model.scores(sizes, iter([head, head + " " + a_text(rng, False, 4000)]))
    assert scores[0] > ACCEPTED > scores[1]


def test_missing_labels(spark):
    docs = spark.createDataFrame([(i, f"text {i}", "", 0) for i in range(20)], DOCS)
    for labels, score in (([], 0.0), ([(i, 1, 0) for i in range(20)], 1.0), ([(i, 0, 0) for i in range(20)], 0.0), ([(None, 1, 0), (3, None, 0), (4, 7, 0)], 0.0)):
        found = scored(docs, fitted(docs, spark.createDataFrame(labels, LABELS))).agg(F.min("score"), F.max("score")).first()
        assert tuple(found) == (score, score)
    none = docs.where("false")
    assert scored(none, fitted(none, spark.createDataFrame([(1, 1, 0), (2, 0, 0)], LABELS))).collect() == []


def test_few_labels_still_give_scores(spark):
    rng = random.Random(4)
    docs = spark.createDataFrame([(i, a_text(rng, i % 2 == 0), "", 0) for i in range(12)], DOCS)
    found = scored(docs, fitted(docs, spark.createDataFrame([(i, int(i % 2 == 0), 0) for i in range(6)], LABELS))).collect()
    assert all(0 <= r["score"] <= 1 for r in found)


def test_samples_and_dictionaries_are_bounded():
    assert len(spread_segments("z" * 1_000_000)) == 16 and spread_segments("") == [] and spread_segments("ab") == [b"ab"]
    assert b"".join(segments("é" * 1000)) == ("é" * 1000).encode()
    assert 0 < len(dictionary([b"only one"])) <= 32768
    assert Model().constant == 0.0
    flat = Calibration(np.zeros((4, 2)), np.array([1.0, 0, 1, 1]))
    assert 0 < flat.score(np.zeros((1, 2)))[0] < 1
