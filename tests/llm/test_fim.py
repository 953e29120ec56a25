"""Fill-in-the-middle: against plain strings, and restoration from the output alone."""

import hashlib
import random

import pyarrow as pa
from pyspark.sql import functions as F

from strandloom.llm import fim
from strandloom.llm.fim import CHUNK, MARKS, outputs, plan, transformed

SCHEMA = "doc_id bigint, text string, rid string, place string, n string, piece int"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_output(form, text, a, b):
    if form == "plain":
        return text
    return f"<P>{text[:a]}<S>{text[b:]}<M>{text[a:b]}" if form == "psm" else f"<S>{text[b:]}<P>{text[:a]}<M>{text[a:b]}"


def plain_row(doc_id, text):
    text = text or ""
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    a, b = sorted((h1 % (len(text) + 1), h2 % (len(text) + 1)))
    form = "plain" if not text or any(m in text for m in MARKS) or h3 % 100 >= 90 else "spm" if h4 % 100 < 20 else "psm"
    sizes = (None, None) if form == "plain" else (a, b - a)
    return (doc_id, len(text), form, *sizes, sha(plain_output(form, text, a, b)), sha(text))


def some_rows():
    rng = random.Random(5)
    texts = [None, "", "a", "<P>", "x<M>y", "<", "<S", "M><", "<P<S<M>>", "é😀" * 7, "\n", "<P" * 3000, "word " * 50_000, "😀é<" * (CHUNK // 2), "x" * CHUNK, "y" * (CHUNK + 1)]
    rows = [(i, t) for i, t in enumerate(texts)]
    rows += [(100 + i, "".join(rng.choice("<>PSM a") for _ in range(rng.randrange(40)))) for i in range(300)]
    return rows + [(7, "again"), (7, "again"), (7, "other"), (None, "no id"), (None, "no id"), (-3, "below nought")]


def test_rows_against_plain_strings(spark):
    rows = some_rows()
    docs = spark.createDataFrame([(i, t, "r", "p", "n", 1) for i, t in rows], SCHEMA)
    found = [tuple(r) for r in transformed(docs).collect()]
    assert sorted(found, key=repr) == sorted((plain_row(i, t) for i, t in rows), key=repr)
    assert {r[2] for r in found} == {"plain", "psm", "spm"}


def test_pieces_give_the_outputs(spark):
    rows = some_rows()
    pieces = outputs(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    built = {}
    for r in pieces:
        assert r["piece"] is None or len(r["piece"]) <= CHUNK
        if r["place"] >= 0:
            assert len(built.setdefault(r["rid"], "")) == r["place"]
            built[r["rid"]] += r["piece"]
    want = sorted(plain_output(*(lambda p: (p[0], t or "", p[1], p[2]))(plan(i, t or ""))) for i, t in rows)
    assert sorted([*built.values(), *[""] * (len(rows) - len(built))]) == want


def test_marks_that_cross_pieces_are_found():
    text = "ab<<PS>cd" * 5
    output = plain_output("spm", text, 3, 20)
    for size in range(1, 6):
        reader = fim._Reader(0, (1, len(text), "spm", 3, 17))
        parts = [p for i in range(0, len(output), size) for p in reader.read(output[i : i + size])] + list(reader.end())
        assert "".join(t for _, _, t in sorted(parts)) == text
        assert reader.digest.hexdigest() == sha(output)


def test_empty_table_and_one_shuffle(spark):
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    assert transformed(empty).collect() == []
    plan_text = transformed(spark.range(10).select(F.col("id").alias("doc_id"), F.lit("text").alias("text")))._jdf.queryExecution().executedPlan().toString()
    assert plan_text.count("Exchange hashpartitioning") == 1


def test_batches_are_bounded(monkeypatch):
    monkeypatch.setattr(fim, "AT_ONCE", 10 * CHUNK)
    batch = pa.RecordBatch.from_arrays([pa.array([0]), pa.array([1]), pa.array(["z" * (100 * CHUNK)])], names=["rid", "doc_id", "text"])
    sizes = [sum(len(p or "") for p in b.column("piece").to_pylist()) for b in fim._cut_batches(iter([batch]))]
    assert max(sizes) <= 11 * CHUNK and sum(sizes) >= 100 * CHUNK
