import random
import time
import tracemalloc
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strandloom import session
from strandloom.functions import chain, kernel
from strandloom.functions import kmers as K
from strandloom.functions.sequences import reverse_complement
from strandloom.functions.walk import Track, greedy_walk
from strandloom.operators import assembly, kmerset, linkage, mapping, overlaps, readset, repeats
from strandloom.params import SketchParams
from tests import plain

P = SketchParams(15, 3)


def _genome(n, seed):
    rng = random.Random(seed)
    return "".join(rng.choice("ACGT") for _ in range(n))


@pytest.fixture(scope="module")
def tiles(spark):
    """Reads of 300 bases every 100 along a random sequence, every third one turned around."""
    genome = _genome(1500, 8)
    reads = spark.createDataFrame([(i + 1, genome[100 * i : 100 * i + 300]) for i in range(13)], "read_id long, seq string")
    turned = F.when(F.col("read_id") % 3 == 0, reverse_complement(F.col("seq"))).otherwise(F.col("seq"))
    reads = reads.withColumn("seq", turned)
    table = kmerset.set_copy(kmerset.count_kmers(reads, P), 1, 5, 20)
    return reads, readset.load(reads, table, P).materialized()


@pytest.mark.parametrize("strict", [False, True])
def test_chaining_against_plain_fold(spark, strict):
    rng = random.Random(4)
    refs = [(loc, loc // 200) for loc in range(600)]
    ref_of = dict(refs)
    seeds, queries = [], {}
    for q in range(40):
        loc, rows = rng.randrange(600), []
        for order in range(rng.randrange(1, 120)):
            loc = (loc + rng.choice([1, 1, 1, 1, 2, -1, 60])) % 600 if q % 2 else (loc - rng.choice([1, 1, 1, 2, -3])) % 600
            kind = rng.random()
            places = [loc] if kind < 0.6 else sorted({loc, rng.randrange(600)})
            if kind > 0.9:
                continue
            rows.append((order, order * 7, places))
            struct = [(p, ref_of[p], p * 3) for p in places]
            seeds.append((q, order, order * 7, len(places), struct[0], struct[1] if len(struct) > 1 else None))
        queries[q] = rows
    place = "struct<loc:bigint,ref_id:bigint,offset:int>"
    frame = spark.createDataFrame(seeds, f"read_id long, ord int, pos int, copy int, first {place}, second {place}")
    got = mapping.chain_blocks(frame, strict).collect()
    assert Counter((r.read_id, r.query_start, r.query_end, r.ref_start, r.ref_end, r.n1, r.n2) for r in got) == Counter(
        (q, q0, qn, s * 3, e * 3, n1, n2) for q, rows in queries.items() for q0, qn, s, e, n1, n2 in plain.chain(rows, ref_of, strict)
    )
    assert len(got) > 40


def _seed_batches(rows, size):
    """Seeds (query, ord, pos, places) of the stream that ``chain.blocks`` reads; a place is its loc, with ref loc // 100000."""
    columns = {"read_id": [r[0] for r in rows], "ord": [r[1] for r in rows], "pos": [r[2] for r in rows], "single": [len(r[3]) == 1 for r in rows]}
    for which, k in (("first", 0), ("second", 1)):
        at = [r[3][k] if len(r[3]) > k else None for r in rows]
        columns |= {f"{which}_ref_id": [None if x is None else x // 100_000 for x in at], f"{which}_offset": at, f"{which}_loc": at}
    return pa.table(columns).to_batches(max_chunksize=size)


@pytest.mark.parametrize("size", [1, 5, 64, 100_000])
def test_chain_stream_against_plain_fold(size):
    """Long steady runs, turns, jumps and two-copy seeds, with batch borders anywhere."""
    rng, rows, queries = random.Random(11), [], {}
    for q in range(12):
        loc, way, found = rng.randrange(300_000), 1, []
        for order in range(rng.choice([1, 2, 40, 400])):
            if rng.random() < 0.02:
                loc, way = rng.randrange(300_000), rng.choice([1, -1])
            loc = max(loc + way * rng.choice([1, 1, 1, 2]), 0)
            found.append((order, order * 7, [loc] if rng.random() < 0.8 else sorted({loc, rng.randrange(300_000)})))
        queries[q] = found
        rows += [(q, *r) for r in found]
    ref_of = {x: x // 100_000 for x in range(-5, 301_000)}
    for strict in (False, True):
        got, singles = [], {}
        for batch in chain.blocks(2, 50, strict)(_seed_batches(rows, size)):
            for r in batch.to_pylist():
                if r["q0"] is None:
                    singles[r["read_id"]] = r["n_single"]
                else:
                    got.append((r["read_id"], r["q0"], r["qN"], r["start_loc"], r["end_loc"], r["n1"], r["n2"]))
        want = [(q, *block) for q, found in queries.items() for block in plain.chain(found, ref_of, strict)]
        assert Counter(got) == Counter(want) and len(got) > 5
        assert singles == {q: sum(len(r[2]) == 1 for r in queries[q]) for q in {w[0] for w in want}}


def test_chain_of_a_million_seeds_in_bounded_memory():
    """One query, read batch by batch: what stays between batches does not grow."""

    def batches():
        for start in range(0, 1_000_000, 10_000):
            at = np.arange(start, start + 10_000, dtype=np.int64) + 1
            none = pa.nulls(len(at), pa.int64())
            zero = np.zeros(len(at), np.int64)
            columns = {"read_id": zero, "ord": at, "pos": at, "single": np.ones(len(at), bool), "first_ref_id": zero, "first_offset": at, "first_loc": at}
            yield pa.RecordBatch.from_pydict({**{k: pa.array(v) for k, v in columns.items()}, **{f"second_{c}": none for c in chain.PLACE}})

    tracemalloc.start()
    rows = [r for batch in chain.blocks(2, 50, False)(batches()) for r in batch.to_pylist()]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [(r["q0"], r["qN"], r["n1"], r["n_single"]) for r in rows] == [(1, 1_000_000, 1_000_000, None), (None, None, None, 1_000_000)]
    assert peak < 20e6


@pytest.mark.parametrize("size", [1, 3, 50, 10_000])
@pytest.mark.parametrize("gap", [0, 1, 9, 1000])
def test_spaced_rows_against_plain_loop(size, gap):
    """Ties, places before 0 and reads across batch borders."""
    rng, rows, want = random.Random(gap), [], []
    for read in range(30):
        rows += [(read, x) for x in sorted(rng.randrange(-5, 200) for _ in range(rng.choice([1, 2, 30])))]
    current, free_from = None, 0
    for read, x in rows:
        if read != current:
            current, free_from = read, 0
        if x >= free_from:
            want.append((read, x))
            free_from = x + gap
    table = pa.table({"read_id": [r[0] for r in rows], "x": pa.array([r[1] for r in rows], pa.int32())})
    got = [(r["read_id"], r["x"]) for batch in kernel.spaced_rows(gap)(table.to_batches(max_chunksize=size)) for r in batch.to_pylist()]
    assert got == want


def test_mapping_places_reads(spark):
    genome = _genome(2000, 9)
    refs = spark.createDataFrame([(5, _genome(500, 1)), (6, genome)], "read_id long, seq string")
    queries = spark.createDataFrame([(1, genome[700:1400]), (2, _genome(400, 2)), (3, "ACG")], "read_id long, seq string")
    queries = queries.withColumn("seq", F.when(F.col("read_id") == 1, reverse_complement(F.col("seq"))).otherwise(F.col("seq")))
    places = mapping.reference_kmers(mapping.index_reference(refs, P))
    seeds = mapping.query_seeds(queries, places, P)
    block = mapping.chain_blocks(seeds).collect()
    assert len(block) == 1 and block[0].ref_id == 6 and block[0].ref_start > block[0].ref_end
    assert 700 <= block[0].ref_end and block[0].ref_start < 1400
    summary = {r.read_id: r for r in mapping.query_summary(queries, seeds).collect()}
    assert summary[1].hit_fraction == 1.0 and summary[3].hit_fraction is None and summary[3].n_miss == 0


def test_overlaps_of_tiles(tiles):
    reads, loaded = tiles
    pairs = overlaps.overlaps(loaded).collect()
    seen = {(r.x, r.y): r for r in pairs}
    # Neighbours share 200 bases, next ones 100, others nothing.
    assert set(seen) == {(a, b) for a in range(1, 14) for b in range(1, 14) if abs(a - b) <= 2}
    assert all(r.is_plus == ((r.x % 3 == 0) == (r.y % 3 == 0)) and not r.is_bad for r in pairs)
    hits = [(r.read_id, r.pos, r.kmer) for r in loaded.hits.where(K.copy_class(F.col("info")) == 1).collect()]
    counts = {pair: n for pair, n in plain.overlap_counts(hits).items() if n >= 3}
    assert {pair: r.n_hit for pair, r in seen.items()} == counts


def test_spreading_hot_kmers_changes_nothing(tiles, monkeypatch):
    _, loaded = tiles
    before = sorted(overlaps.candidates(loaded).collect())
    details = sorted(overlaps.shared_details(loaded, overlaps.overlaps(loaded)).collect())
    monkeypatch.setattr(overlaps, "SPREAD", 1)
    assert sorted(overlaps.candidates(loaded).collect()) == before
    assert sorted(overlaps.shared_details(loaded, overlaps.overlaps(loaded)).collect()) == details


def test_no_block_of_a_hot_kmer_grows(spark, monkeypatch):
    """One k-mer in half of 400 reads, thirty times in one of them: cells stay small, pairs are all there."""
    hits = [(read, 300, 7, True, 10 * read, 0) for read in range(0, 400, 2)]
    hits += [(0, 300, 7, True, 5000 + i, 0) for i in range(29)] + [(read, 300, 1000 + read // 2, True, 3, 0) for read in range(400)]
    seeds = spark.createDataFrame(hits, "read_id long, len long, kmer long, is_fwd boolean, pos int, info int").withColumn("info", F.lit(1))
    counts = seeds.groupBy("kmer").agg(F.count(F.lit(1)).alias("n_hits"), F.count(F.lit(1)).cast("int").alias("depth"))
    seeds = seeds.join(counts, "kmer")
    loaded = readset.Readset(seeds.select("read_id", "len").distinct(), seeds, counts, P)
    monkeypatch.setattr(overlaps, "SPREAD", 16)
    for side, spread_by in ((False, ["read_id", "pos"]), (True, ["read_id", "pos"])):
        cells = overlaps._in_grid(seeds, side, *spread_by).groupBy("kmer", "cell").count()
        assert cells.agg(F.max("count")).first()[0] <= 3 * 16
        assert cells.where("kmer = 7").count() == 15 * 15  # 229 hits in blocks of 16
    got = Counter((r.x, r.y) for r in overlaps.shared_hits(loaded).collect())
    want = Counter()
    by_kmer = {}
    for read, _, kmer, *_ in hits:
        by_kmer.setdefault(kmer, []).append(read)
    for reads in by_kmer.values():
        for x in set(reads):
            for y in reads:
                want[x, y] += 1
    assert got == want


def test_contained_and_repeat_reads(spark):
    genome = _genome(900, 11)
    rows = [(1, genome), (2, genome[200:600]), (3, genome[:300] + genome[:300]), (4, _genome(80, 12))]
    reads = spark.createDataFrame(rows, "read_id long, seq string")
    table = kmerset.set_copy(kmerset.count_kmers(reads, P), 1, 5, 20)
    loaded = readset.load(reads, table, P).materialized()
    pairs = overlaps.checkpointed(overlaps.overlaps(loaded))
    flags = overlaps.read_flags(loaded, pairs)
    by_read = {r.read_id: r for r in flags.collect()}
    assert by_read[3].bad & readset.BAD_REPEAT and not by_read[1].bad & readset.BAD_REPEAT
    # Read 3 repeats: it is dropped as a target only for x at or after it.
    assert {(r.x, r.y) for r in pairs.collect()} >= {(1, 3), (2, 1)}
    assert not {(r.x, r.y) for r in pairs.collect()} & {(3, 3), (4, 3)}
    contained = {r.read_id: r.contained_in for r in overlaps.mark_contained(flags, pairs).collect()}
    assert contained[2] == 1 and contained[1] is None


def test_bad_read_rounds(spark):
    """Twelve reads object to 20, each of 1 and 2 also to several good ones, 3 to one."""
    flags = spark.createDataFrame([(i, 1 if i == 30 else 0) for i in range(1, 41)], "read_id long, bad int")
    edges = [(x, 20) for x in range(1, 13)] + [(1, 21), (1, 22), (2, 1), (3, 23), (4, 1), (5, 30)]
    pairs = spark.createDataFrame([(x, y, True) for x, y in edges] + [(6, 7, False)], "x long, y long, is_bad boolean")
    got = {r.read_id: r.bad for r in overlaps.mark_bad(flags, pairs).collect() if r.bad}
    assert got == {1: 4, 3: 4, 20: 2, 30: 1}


def test_clusters_with_hub_and_path(spark):
    rng = random.Random(6)
    edges = [(100, 100 + i) for i in range(1, 60)] + [(i, i + 1) for i in range(200, 260)]
    edges += [(rng.randrange(300, 400), rng.randrange(300, 400)) for _ in range(60)] + [(7, 7)]
    rng.shuffle(edges)
    got = {r.read_id: r.cluster for r in overlaps.clusters(spark.createDataFrame(edges, "x long, y long")).collect()}
    assert got == plain.components([e for e in edges if e[0] != e[1]])


def test_least_reachable_follows_pairs_one_way(spark):
    rng = random.Random(16)
    edges = [(i + 1, i) for i in range(500, 530)] + [(i, i + 1) for i in range(600, 630)] + [(40, 3), (7, 7)]
    edges += [(rng.randrange(300, 400), rng.randrange(300, 400)) for _ in range(130)]
    edges += [(b, a) for a, b in edges if a % 3 == 0]
    rng.shuffle(edges)
    follow = {}
    for a, b in edges:
        if a != b:
            follow.setdefault(a, set()).add(b)
    expected = {}
    for a in follow:
        seen, front = {a}, [a]
        while front:
            front = [c for b in front for c in follow.get(b, ()) if c not in seen and not seen.add(c)]
        expected[a] = min(seen)
    rows = overlaps.least_reachable(spark.createDataFrame(edges, "x long, y long")).collect()
    assert len(rows) == len(expected) and {r.read_id: r.cluster for r in rows} == expected


@pytest.mark.parametrize("cell_hits, at_once, tile", [(1 << 20, 1 << 18, 4096), (7, 40, 50)])
def test_linkage_pairs_stay_in_their_cells(spark, monkeypatch, cell_hits, at_once, tile):
    """Pairs and verdicts against plain loops, in few and in many cells and portions; no pair is shuffled."""
    monkeypatch.setattr(linkage, "CELL_HITS", cell_hits)
    monkeypatch.setattr(linkage, "TILE", tile)
    monkeypatch.setattr(linkage.pairing, "PAIRS_AT_ONCE", at_once)
    rng, rows = random.Random(21), []
    depth = {k: rng.choice([2, 3, 4, 9, 19, 20, 40]) for k in range(60)}
    for read in range(40):
        length = rng.choice([60, 200, 400])
        for pos in sorted(rng.sample(range(length - 15), rng.randrange(1, 30))):
            k = rng.randrange(60)
            rows.append((read, length, k, rng.random() < 0.5, pos, depth[k], 0 if k % 13 == 0 else 33))
    seeds = spark.createDataFrame(rows, "read_id long, len long, kmer long, is_fwd boolean, pos int, depth int, info int")
    loaded = readset.Readset(None, seeds, None, P)
    hits, first, pairs = [r for r in rows if r[6]], {}, []
    for read, length, k, fwd, pos, d, _ in sorted(hits, key=lambda r: (r[0], r[4])):
        if 3 <= d < 20:
            first.setdefault((k, read), (pos, fwd, length))
    for (k, read), (pos, fwd, _) in first.items():
        pairs += [(k, depth[k], r[2], r[5], read, (r[4] - pos) * (1 if fwd else -1)) for r in hits if r[0] == read and r[4] != pos]
    got = linkage.anchor_pairs(loaded, 3, 20)
    assert sorted(tuple(r)[:6] for r in got.collect()) == sorted(pairs) and len(pairs) > 2000
    groups = {}
    for k, _, mod, _, _, dx in pairs:
        groups.setdefault((k, mod), []).append(dx)
    assert got.where("is_first").count() == len(groups)
    want = {}
    for (k, mod), dxs in groups.items():
        n, low, high = len(dxs), min(dxs), max(dxs)
        down, split = low > 0, low <= 0 < high
        dist = low if down else -low if split else -high
        reaches = [at[2] - at[0] - P.w if at[1] == down else at[0] for (a, _), at in first.items() if a == k]
        reaching = sum(r >= dist for r in reaches)
        d = depth[mod]
        want[k, mod] = (down, split, n, dist, reaching, n < d and 2 * n < reaching, n == d or n >= 0.8 * reaching, n == 1 and reaching >= 10)
    verdicts = linkage.test_pairs(loaded, 3, 20)
    assert {(r.anchor, r.mod): tuple(r)[4:] for r in verdicts.collect()} == want
    plan = verdicts._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan[: plan.index("MapInArrow")] and "Window" not in plan


def _shuffle_files(spark):
    blocks = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n")
    return {f for f in blocks.split("\n") if "shuffle_" in f}


def test_linkage_rounds_hold_a_share_of_the_copies(spark, monkeypatch, tmp_path):
    """Rounds give the same counts and reports as all cells at once; each copies few hits, and its shuffle files and old sums go."""
    monkeypatch.setattr(linkage, "CELL_HITS", 200)
    monkeypatch.setattr(linkage, "TILE", 50)
    monkeypatch.setattr(linkage, "ROUND_HITS", 500)
    rng, rows = random.Random(22), []
    depth = {k: rng.choice([2, 3, 4, 9, 19, 20]) for k in range(200)}
    for read in range(80):
        rows += [(read, 400, k, rng.random() < 0.5, pos, depth[k], 33) for pos, k in enumerate(rng.sample(range(200), 12))]
    loaded = readset.Readset(None, spark.createDataFrame(rows, "read_id long, len long, kmer long, is_fwd boolean, pos int, depth int, info int"), None, P)
    whole = {run: sorted(linkage.linkage_counts(linkage.test_pairs(loaded, 3, 20), run).collect()) for run in (1, 4)}
    pairs = linkage.anchor_pairs(loaded, 3, 20).groupBy("anchor").agg(F.count("*"), F.sum("dx"), F.count_if("is_first")).collect()
    folder = Path(session.shared_folder(spark, "x").removeprefix("file:")).parent
    kept, files = set(folder.iterdir()), _shuffle_files(spark)
    dealt = linkage.deal(loaded, 3, 20)
    assert dealt.rounds > 3 and {p.name.split("-")[0] for p in set(folder.iterdir()) - kept} == {"dealt"}
    got = linkage.by_anchor(dealt, False, lambda p: p.groupBy("anchor").agg(F.count("*"), F.sum("dx"), F.count_if("is_first")))
    counts = {run: linkage.counts_of_rounds(dealt, run) for run in whole}
    assert sorted(p.name.split("-")[0] for p in set(folder.iterdir()) - kept) == ["counts", "counts", "dealt", "reports"]
    for _ in range(100):  # files go a moment after their query
        if not _shuffle_files(spark) - files:
            break
        time.sleep(0.1)
    assert not _shuffle_files(spark) - files
    assert sorted(got.collect()) == sorted(pairs) and len(pairs) > 100
    assert {run: sorted(c.collect()) for run, c in counts.items()} == whole
    copies = dealt.reads.select(F.size("m_mod").alias("n"), F.explode("dealt.cell").alias("cell"))
    turns = copies.groupBy((F.col("cell") % dealt.rounds).alias("turn")).agg(F.sum("n").alias("hits")).collect()
    most = max(500, 2 * len(rows))
    assert sum(r["hits"] for r in turns) > 2 * most and max(r["hits"] for r in turns) <= 1.5 * most


def test_thinning(spark):
    rng = random.Random(7)
    hits = sorted({(rng.randrange(9), rng.randrange(400)) for _ in range(900)})
    frame = spark.createDataFrame([(r, 1, x) for r, x in hits], "read_id long, kmer long, x int")
    assert sorted((r.read_id, r.x) for r in repeats.thin_hits(frame, 11).collect()) == plain.thin(hits, 11)


def test_strand_vote_and_repeat_analysis(spark):
    unit = _genome(1200, 13)
    refs = spark.createDataFrame([(1, unit)], "read_id long, seq string")
    rng, rows = random.Random(14), []
    for i in range(1, 41):
        read = list(unit)
        for at in range(50, 1200, 100):
            # Two haplotypes differ every 100 bases.
            if i % 2:
                read[at] = "ACGT"[("ACGT".index(read[at]) + 1) % 4]
        rows.append((i, "".join(read)))
    rows.append((41, _genome(1200, 15)))
    reads = spark.createDataFrame(rows, "read_id long, seq string")
    reads = reads.withColumn("seq", F.when(F.col("read_id") % 5 == 0, reverse_complement(F.col("seq"))).otherwise(F.col("seq")))
    reference = repeats.reference_kmers(refs, P, strict=True)
    votes = overlaps.checkpointed(repeats.strand_vote(reads, reference, P, first=50))
    by_read = {r.read_id: r for r in votes.collect()}
    assert by_read[41].is_bad and not any(by_read[i].is_bad for i in range(1, 41))
    assert all(by_read[i].is_forward == (i % 5 != 0) for i in range(1, 41))
    found = repeats.analyse(reads, votes, kmerset.count_kmers(reads, P), P)
    blocks = repeats.read_blocks(found["reads"], found["hits"]).collect()
    assert sum(b.n_reads for b in blocks) == 40
    with pytest.raises(Exception, match="repeated reference"):
        repeats.reference_kmers(refs.union(refs), P, strict=True).collect()


def test_informative_kmers(spark):
    """2 repeats 1 exactly; 3 joins two chains; 5 is only seen between varying neighbours."""
    counts = {1: 10, 2: 10, 3: 18, 4: 8, 5: 12}
    edges = [(1, 2, 10), (2, 3, 10), (4, 3, 8)] + [(5, n, 2) for n in range(10, 16)] + [(n, 5, 2) for n in range(10, 16)]
    edges += [(n, n + 100, 6) for n in range(10, 16)]
    mods = spark.createDataFrame(list(counts.items()), "kmer long, n long")
    links = spark.createDataFrame(edges, "k0 long, k1 long, n long")
    assert {r.kmer for r in repeats.informative_mods(mods, links).collect()} == {1, 3, 4}


def test_hubs_among_links(spark, monkeypatch):
    """A k-mer with 300 neighbours and a pair in 300 reads, with many and one hot key; 3 only repeats 2."""
    edges = [(1, n, 6) for n in range(10, 310)] + [(n, 2, 7) for n in range(10, 310)] + [(2, 3, 9)]
    mods = spark.createDataFrame([(k, 9) for k in (1, 2, 3, *range(10, 310))], "kmer long, n long")
    links = spark.createDataFrame(edges, "k0 long, k1 long, n long")
    hits = [(read, kmer, 10 * i) for read in range(300) for i, kmer in enumerate([5, 6] + ([7 + read] if read < 3 else []))]
    frame = spark.createDataFrame(hits, "read_id long, kmer long, x int")

    def run():
        return {r.kmer for r in repeats.informative_mods(mods, links).collect()}, {r.read_id for r in repeats.weak_reads(frame).collect()}

    assert run() == ({1, 2, *range(10, 310)}, {0, 1, 2})
    for module in (repeats, session):
        monkeypatch.setattr(module, "HOT_KEYS", 1)
    assert run() == ({1, 2, *range(10, 310)}, {0, 1, 2})


def test_a_read_in_many_overlaps(tiles, monkeypatch):
    _, loaded = tiles
    pairs = overlaps.checkpointed(overlaps.overlaps(loaded))
    before = sorted(assembly.consensus_hits(loaded, pairs).collect())
    monkeypatch.setattr(assembly, "SPREAD", 1)
    assert before and sorted(assembly.consensus_hits(loaded, pairs).collect()) == before


def test_blocks_and_weak_reads(spark):
    lists = {1: [5, 6, 7], 2: [5, 6, 7], 3: [5, 7], 4: [], 5: [5, 6, 7], 6: [5, 6, 7], 7: [5, 6, 7]}
    hits = [(read, kmer, 10 * i) for read, kmers in lists.items() for i, kmer in enumerate(kmers)]
    frame = spark.createDataFrame(hits, "read_id long, kmer long, x int")
    reads = spark.createDataFrame([(r,) for r in lists], "read_id long")
    blocks = {tuple(b.kmers): (b.n_reads, b.first_read) for b in repeats.read_blocks(reads, frame).collect()}
    assert blocks == {(5, 6, 7): (5, 1), (5, 7): (1, 3), (): (1, 4)}
    assert [r.read_id for r in repeats.weak_reads(frame).collect()] == [3]
    assert {r.kmer: r.n for r in repeats.count_without_last(frame).collect()} == {5: 6, 6: 5}


def test_links_are_symmetric(tiles):
    _, loaded = tiles
    rows = assembly.links(loaded).collect()
    steps = {(r.read_id, r.from_kmer, r.from_fwd, r.to_kmer, r.to_fwd) for r in rows if r.to_kmer is not None}
    assert steps == {(i, tk, not tf, fk, not ff) for i, fk, ff, tk, tf in steps}
    assert sum(r.to_kmer is None for r in rows) == 2 * 13


def test_walk_lays_out_tiles(spark, tiles):
    """From a seed in the middle the reads are laid out at their true distances."""
    _, loaded = tiles
    hits = loaded.hits.where("read_id = 7").orderBy("pos").collect()
    seed = next(h for h in hits if h.pos >= 150 and h.depth == 3)
    seeds = spark.createDataFrame([(seed.kmer, 1000)], "seed long, offset long")
    rows = {r.read_id: r for r in assembly.layouts(loaded, seeds, forward=seed.is_fwd).collect()}
    holders = [r.read_id for r in loaded.hits.where(F.col("kmer") == seed.kmer).collect()]
    assert set(rows) == set(holders) and len(holders) == 3
    base = rows[7].start
    # Positions in a turned read are counted from its end, k further on.
    turned = {i: (i % 3 == 0) != (7 % 3 == 0) for i in rows}
    assert all(rows[i].start - base == 100 * (i - 7) - P.k * turned[i] for i in rows)


def test_walk_takes_the_supported_branch():
    """Two of three reads step to (True, 2); the third leaves by another k-mer."""
    s, a, b = (True, 1), (True, 2), (True, 3)
    tracks = {1: Track([(10, s), (20, a)], 50, 10, 0), 2: Track([(15, s), (25, a)], 60, 15, 0), 3: Track([(5, s), (15, b)], 40, 5, 0)}
    layout, path = greedy_walk(tracks, s, 0, 1)
    assert path == [(1, True, 0, 2, 3), (2, True, 10, 0, 3)]
    assert layout == [(2, -15, 45, 1), (1, -10, 40, 1), (3, -5, 35, 0)]


def test_walk_rejoins_a_read_that_meets_the_path_again():
    s, a, b, c = (True, 1), (True, 2), (True, 3), (True, 4)
    tracks = {i: Track([(0, s), (10, a), (20, c)], 60, 0, 0) for i in (1, 2)} | {3: Track([(0, s), (9, b), (21, c)], 60, 0, 0)}
    layout, path = greedy_walk(tracks, s, 0, 1)
    assert [p[0] for p in path] == [1, 2, 4] and {r[0]: r[3] for r in layout} == {1: 2, 2: 2, 3: 1}
    assert {r[0]: r[2] for r in layout} == {1: 60, 2: 60, 3: 59}


def test_walk_over_tandem_reads_ends():
    """Staggered reads over an array of three k-mers: every read is placed once and the path is no longer than the stops."""
    unit = [(True, 1), (True, 2), (True, 3)]
    tracks = {}
    for i in range(40):
        stops = [(x, unit[(x // 10) % 3]) for x in range(0, 300 + 30 * (i % 5), 10)]
        tracks[i] = Track(stops, stops[-1][0] + 10, 30 * (i % 7), 0)
    layout, path = greedy_walk(tracks, unit[0], 0, 1)
    assert len(layout) == 40 and len(path) <= 1 + sum(len(t.stops) for t in tracks.values())
    assert [p[2] for p in path] == sorted(p[2] for p in path)


def test_reference_marks_and_resets(spark):
    unit = _genome(600, 21)
    rows = [(i, unit[50 * (i % 3) :] + _genome(100, 100 + i)) for i in range(1, 7)]
    reads = spark.createDataFrame(rows, "read_id long, seq string")
    table = kmerset.set_copy(kmerset.count_kmers(reads, P), 1, 100, 200)
    loaded = readset.load(reads, table, P).materialized()
    marks = linkage.mark_reference(loaded, spark.createDataFrame([(1, unit)], "read_id long, seq string"), core=3, multi=100)
    kinds = Counter(r.kind for r in marks.collect())
    assert kinds["core"] > 50 and kinds["multi"] == 0
    covered = linkage.covered_hits(loaded, marks, n=20)
    assert linkage.repeat_reads(covered).count() == 6
    core = {r.kmer for r in marks.collect() if r.kind == "core"}
    reset = {r.kmer for r in linkage.reset_core(marks).collect() if r.info & K.COPY_MASK == 1}
    assert reset == core
    summary = {(r.in_ref, r["class"]): r.n_kmers for r in linkage.mark_summary(marks).collect()}
    assert summary[True, "core"] == len(core)


def test_hits_are_stored_and_shuffled_once(spark):
    """New bits in the table do not store the hits again, and only hits of the k-mers asked for are looked up."""
    from pathlib import Path

    from strandloom.plans import linkage_queries
    from strandloom.session import shared_folder

    folder = Path(shared_folder(spark, "").removeprefix("file:"))
    before = set(folder.glob("hits-*"))
    flagged = linkage_queries._flagged(spark, "/root/testdata/sf0.001")
    assert len(set(folder.glob("hits-*")) - before) == 1
    repeats = flagged.table.where("info & 8 <> 0")
    some = readset.with_info(flagged, repeats, sparse=True)
    every = readset.with_info(flagged, flagged.table).hits.where("info & 8 <> 0")
    names = ["read_id", "kmer", "pos", "depth", "info"]
    want = sorted(map(tuple, every.select(names).collect()))
    assert sorted(map(tuple, some.hits.select(names).collect())) == want and 0 < len(want) < flagged.seeds.count()
