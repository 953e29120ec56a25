import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strandloom.functions import kernel
from strandloom.functions import kmers as K
from strandloom.functions import sequences as S
from strandloom.operators import kmerset, sketch
from strandloom.params import SketchParams, multiplier
from strandloom.plans import fixtures as fx
from tests import plain

SF001, SF01 = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
PARAMS = st.builds(SketchParams, st.sampled_from([1, 2, 3, 7, 15, 31]), st.sampled_from([1, 2, 5, 9]), st.sampled_from([0, 17, 42]))
READS = st.lists(st.text("ACGTNacgtx é", max_size=60), min_size=1, max_size=6)


def test_multipliers():
    assert multiplier(17) == 5273868790340039597
    assert multiplier(0) == multiplier(1) == 7749363893351949255
    assert multiplier(42) == 308705783040459877


def test_parameter_bounds():
    for bad in (dict(k=0), dict(k=32), dict(w=0)):
        with pytest.raises(ValueError):
            SketchParams(**bad)


@settings(max_examples=150, deadline=None)
@given(READS, PARAMS)
def test_sampling_kernel(reads, p):
    codes, bounds = kernel.decode(pa.array(reads))
    got = kernel.sample_hits(codes, bounds, p.k, p.w, p.factor)
    want = [(i, n, *hit) for i, seq in enumerate(reads) for n, hit in enumerate(plain.sampled(seq, p))]
    assert list(zip(*(got[c].tolist() for c in ("_read", "ord", "pos", "kmer", "is_fwd")))) == want


@settings(max_examples=150, deadline=None)
@given(READS, PARAMS)
def test_minimizer_kernel(reads, p):
    codes, bounds = kernel.decode(pa.array(reads))
    got = kernel.jumping_minima(codes, bounds, p.k, p.w, p.factor)
    want = [(i, *hit) for i, seq in enumerate(reads) for hit in plain.jumping(seq, p)]
    assert list(zip(*(got[c].tolist() for c in ("_read", "pos", "hash")))) == want


def test_sampling_across_chunks_and_slices(monkeypatch):
    rng = random.Random(5)
    reads = ["".join(rng.choice("ACGTN") for _ in range(n)) for n in (0, 400, 3, 1500, 90)] + [None, "ACGT" * 50]
    batch = pa.record_batch({"id": list(range(7)), "seq": reads})
    p = SketchParams(9, 3)

    def run():
        mapper = kernel.arrow_mapper(kernel.sample_hits, "seq", ["id"], ["ord", "kmer", "is_fwd", "pos", "len"], (p.k, p.w, p.factor))
        return pa.Table.from_batches(mapper(iter([batch, batch.slice(2, 3)]))).to_pylist()

    whole = run()
    monkeypatch.setattr(kernel, "CHUNK", 16)
    monkeypatch.setattr(kernel, "SLICE_BYTES", 100)
    assert run() == whole and len(whole) > 300


@pytest.mark.parametrize("reads", [8000, 1])
def test_sampling_and_byte_counts_in_bounded_memory(reads):
    """Arrays stay small beside a batch of 24 MB of text, of many reads or of one, and do not grow with it."""
    unit = "".join(random.Random(8).choices("ACGT the quick brown fox", k=3000))
    batch = pa.record_batch({"read_id": list(range(reads)), "seq": [unit * (8000 // reads)] * reads})
    p = SketchParams(19, 31)
    mapper = kernel.arrow_mapper(kernel.sample_hits, "seq", ["read_id"], ["kmer", "pos"], (p.k, p.w, p.factor))
    for run in (mapper, kernel.byte_counter("seq")):
        tracemalloc.start()
        rows = sum(out.num_rows for out in run(iter([batch])))
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert rows > 10 and peak < (12e6 if reads > 1 else 80e6)


def test_reverse_complement_keeps_the_sample(spark):
    rng = random.Random(3)
    p = SketchParams(13, 5)
    seqs = [(i, "".join(rng.choice("ACGT") for _ in range(300))) for i in range(5)]
    reads = spark.createDataFrame(seqs, "read_id long, seq string")
    turned = reads.withColumn("seq", S.reverse_complement(F.col("seq")))
    a = {(r.read_id, 300 - 13 - r.pos, r.kmer, not r.is_fwd) for r in sketch.sampled_kmers(reads, p).collect()}
    b = {(r.read_id, r.pos, r.kmer, r.is_fwd) for r in sketch.sampled_kmers(turned, p).collect()}
    assert a == b and 100 < len(a) < 600


def test_golden_documents(spark):
    hits = sketch.sampled_kmers(fx.documents(spark, SF01), fx.DEFAULT)
    row = hits.agg(
        F.count(F.lit(1)), F.sum("pos"), F.sum("kmer"), F.sum(F.col("is_fwd").cast("int")), F.count_distinct("kmer")
    ).first()
    assert tuple(row) == (23006, 32159855, 2589287943378882, 12621, 13693)
    histogram = kmerset.depth_histogram(kmerset.count_kmers(fx.documents(spark, SF001), fx.DEFAULT))
    assert {r.depth: r.n_kmers for r in histogram.collect()} == {
        1: 2779, 2: 309, 3: 82, 4: 12, 5: 8, 6: 3, 13: 1, 15: 1, 68: 1, 1225: 1,
    }


def test_code_and_decode(spark):
    texts = ["acgt", "aacgt", "t" * 31, "a" * 31, "gattacagattacagattacagattacagat"[:31]]
    frame = spark.createDataFrame([(t,) for t in texts], "t string")
    rows = frame.select("t", K.encode(F.col("t")).alias("c")).select("t", "c", K.decode(F.col("c"), 31).alias("d")).collect()
    assert rows[0].c == 27 and rows[2].c == 4**31 - 1
    assert all(r.d == r.t.rjust(31, "a") for r in rows)


@pytest.mark.parametrize("k", [1, 5, 15, 19, 29, 30, 31])
def test_hash_expression(spark, k):
    p = SketchParams(k, 3)
    rng = random.Random(k)
    values = [0, 4**k - 1] + [rng.randrange(4**k) for _ in range(50)]
    frame = spark.createDataFrame([(v,) for v in values], "v long")
    got = {r.v: r.h for r in frame.select("v", K.hash_code(F.col("v"), p).alias("h")).collect()}
    assert got == {v: (v * p.factor % 2**64) >> p.shift for v in values}
    assert kernel.hashed(np.array(values, np.uint64), k, p.factor).tolist() == [got[v] for v in values]


def test_sequence_functions(spark):
    mixed = "GCGGTTTGAGTGAnNCGAGACGAGAcgcgcccctcccaCGCGGGGAAGGG"
    row = spark.createDataFrame([(mixed, "acgtN", [5, 30, 20], [3, 3, 1, 10])], "m string, s string, q array<int>, l array<long>").select(
        S.compress_homopolymers(F.col("m")).alias("h"),
        S.reverse_complement(F.col("s")).alias("rc"),
        S.quality_text(F.col("q"), F.lit(3)).alias("qt"),
        S.quality_text(F.lit(None).cast("array<int>"), F.lit(2)).alias("missing"),
        S.quality_bits(F.col("q"), 20).alias("bits"),
        S.deltas(F.col("l")).alias("d"),
        S.running_totals(S.deltas(F.col("l"))).alias("back"),
        S.complement_iupac(F.lit("ARYN")).alias("iupac"),
        S.letter_codes(F.lit("aC-n!"), S.IUPAC_MASK).alias("codes"),
    ).first()
    assert row.h == "GCGTGAGTGAnCGAGACGAGAcgcgctcaCGCGAG"
    assert row.rc == "Nacgt" and row.iupac == "TYRN"
    assert row.qt == "&?5" and row.missing == "!!" and row.bits == [False, True, True]
    assert row.d == [3, 0, -2, 9] and row.back == [3, 3, 1, 10]
    assert row.codes == [1, 2, 0, 15]


def test_kmer_table_recipe(spark):
    """Two sets, merged both ways, pruned, classed and compared."""
    p = SketchParams(11, 4)
    x = kmerset.count_kmers(fx.documents(spark, SF001), p)
    y = kmerset.count_kmers(fx.conversations(spark, SF001), p)
    xy, yx = kmerset.merge(x, y, p, p), kmerset.merge(y, x, p, p)
    assert sorted(map(tuple, xy.select("kmer", "depth").collect())) == sorted(map(tuple, yx.select("kmer", "depth").collect()))
    total = xy.agg(F.sum("depth")).first()[0]
    assert total == x.agg(F.sum("depth")).first()[0] + y.agg(F.sum("depth")).first()[0]
    classed = kmerset.set_copy(kmerset.prune(xy, 2), 3, 6, 20)
    summary = kmerset.summarize(classed).first()
    assert summary.n_kmers == classed.count() == sum(summary[f"copy{c}"] for c in range(4))
    compared = kmerset.compare_depths(classed, {"x": x, "y": y})
    assert compared.where("depth <> x + y").count() == 0
    with pytest.raises(ValueError):
        kmerset.merge(x, y, p, SketchParams(11, 4, 3))


def test_merge_and_saturation_rules(spark):
    left = spark.createDataFrame([(1, 65000, 1), (2, 5, 1 | K.REPEAT), (3, 7, 2 | K.MINOR)], "kmer long, depth int, info int")
    right = spark.createDataFrame([(1, 9000, 1), (3, 1, 0), (4, 2, 2)], "kmer long, depth int, info int")
    p = SketchParams()
    got = {r.kmer: (r.depth, r.info) for r in kmerset.merge(left, right, p, p).collect()}
    assert got == {1: (65535, 3), 2: (5, 1 | K.REPEAT), 3: (8, 2), 4: (2, 2)}
