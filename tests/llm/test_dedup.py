"""Exact and near duplicates, and the helpers under them, against plain versions."""

import hashlib
import random
import re

import numpy as np
import xxhash
from pyspark.sql import functions as F

from strandloom.llm import simhash
from strandloom.llm.common import boxed, components, maybe_member, without
from strandloom.llm.exact_dedup import exact_dedup_stage, exact_duplicates

SCHEMA = "doc_id long, text string, lang string, _maybe string, norm string"


def rows(spark, texts):
    return spark.createDataFrame([(i, t, None, "x", "y") for i, t in texts], SCHEMA)


def plain_exact(texts):
    groups = {}
    for i, t in texts:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", "", t or ""), []).append((-len(t or ""), i is None, i or 0, i))
    out = []
    for i, t in texts:
        norm = re.sub(r"[\x20\x09-\x0D]+", "", t or "")
        keep = min(groups[norm])[3]
        out.append((i, keep, len(groups[norm]), i == keep, hashlib.sha256(norm.encode()).hexdigest()))
    return sorted(out, key=str)


TEXTS = [(1, "a b"), (2, "ab"), (3, "a\tb "), (4, None), (5, ""), (6, " \n"), (7, "é x"), (8, "éx"), (9, "c" * 50_000), (10, "c" * 50_000 + " "), (None, "ab"), (11, "zz"), (11, "zz"), (12, "zz"), (12, "other")]


def test_exact_duplicates(spark):
    got = exact_duplicates(rows(spark, TEXTS)).drop("content_hash").collect()
    assert sorted(map(tuple, got), key=str) == plain_exact(TEXTS)


def test_exact_duplicates_with_colliding_hashes(spark):
    weak = lambda norm: F.unhex(F.md5(F.substring(norm, 1, 1)))
    texts = [(i, t) for i, t in enumerate(["ab", "a b", "ac", "ac", "ad", None, "b", "bb"])]
    got = exact_duplicates(rows(spark, texts), weak).drop("content_hash").collect()
    assert sorted(map(tuple, got), key=str) == plain_exact(texts)


def test_exact_dedup_stage_keeps_one_row_of_each_group(spark):
    docs = rows(spark, TEXTS)
    left = exact_dedup_stage(spark, docs, "")
    assert left.columns == docs.columns
    kept = sorted((r["doc_id"], r["text"]) for r in left.collect())
    assert kept == [(3, "a\tb "), (6, " \n"), (7, "é x"), (8, "éx"), (10, "c" * 50_000 + " "), (11, "zz"), (12, "other")]


def test_empty_tables(spark):
    empty = rows(spark, [])
    assert exact_duplicates(empty).count() == 0
    assert exact_dedup_stage(spark, empty, "").count() == 0
    assert simhash.near_duplicates(empty).count() == 0
    assert simhash.near_dedup_stage(spark, empty, "").count() == 0


def plain_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    shingles = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints):
    values = np.array([p for _, p in prints], np.uint64)
    parent = list(range(len(prints)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x in range(len(prints)):
        for y in np.flatnonzero(np.bitwise_count(values[x] ^ values[:x]) <= 2):
            a, b = root(x), root(int(y))
            parent[max(a, b)] = min(a, b)
    least = {}
    for x, (i, _) in enumerate(prints):
        least[root(x)] = min(i, least.get(root(x), i))
    return {i: least[root(x)] for x, (i, _) in enumerate(prints)}


def test_fingerprints(spark):
    texts = [None, "", " \t", "A b", "x", "one two three four", "ÀB c d É e F", "w " * 40_000, "Aa bB cC " * 7]
    for t in texts:
        assert simhash.fingerprint(t) & (1 << 64) - 1 == plain_fingerprint(t)
    found = simhash.near_duplicates(rows(spark, list(enumerate(texts)))).collect()
    assert {r["doc_id"]: r["fingerprint"] for r in found} == {i: f"{plain_fingerprint(t):016x}" for i, t in enumerate(texts)}


def test_links_reach_every_pair_within_two_bits(spark):
    rng = random.Random(3)
    values = {0, (1 << 64) - 1, 1 << 63}
    for _ in range(60):
        base = rng.getrandbits(64)
        values.add(base)
        for _ in range(4):
            near = base
            for b in rng.sample(range(64), rng.choice([1, 2, 2, 3])):
                near ^= 1 << b
            values.add(near)
    values |= {1 << 63 ^ 1, 3, 5, 1 << 62 | 1 << 63}
    prints = sorted((v - (1 << 64) if v >> 63 else v, v) for v in values)
    frame = spark.createDataFrame([(s,) for s, _ in prints], "fp long")
    pairs = simhash.links(frame)
    masks = simhash._reach_masks()
    assert max(map(len, masks)) == 33
    found = {r["node"]: r["root"] for r in components(pairs).collect()}
    want = plain_components(prints)
    assert {s: found.get(s, s) for s, _ in prints} == want


def test_hot_ball_of_fingerprints_gives_a_spanning_set(spark):
    ball = [0] + [1 << b for b in range(63)] + [1 << a | 1 << b for a in range(63) for b in range(a)]
    frame = spark.createDataFrame([(v,) for v in ball], "fp long")
    linked = simhash.links(frame)
    assert linked.count() < 40 * len(ball)
    assert components(linked).select("root").distinct().count() == 1


def test_near_dedup_stage(spark):
    base = " ".join(f"word{i}" for i in range(400))
    texts = [(5, base), (3, base), (9, base.replace("word7 ", "word7  ")), (4, "quite another text"), (8, None), (2, "")]
    left = simhash.near_dedup_stage(spark, rows(spark, texts), "")
    assert sorted(r["doc_id"] for r in left.collect()) == [2, 3, 4]


def test_components_of_chains_and_stars(spark):
    rng = random.Random(5)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 100 + i) for i in range(1, 300)] + [(500, 500), (-7, -9), (-9, 600)]
    rng.shuffle(edges)
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    want = {i: 0 for i in range(61)} | {100 + i: 100 for i in range(300)} | {-7: -9, -9: -9, 600: -9}
    assert got == want
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_without_removes_exactly_the_keys_even_in_a_full_bitmap(spark):
    df = spark.createDataFrame([(i % 50 if i else None, str(i)) for i in range(200)], "k long, v string")
    drop = spark.createDataFrame([(i,) for i in range(0, 50, 3)] + [(None,)], "k long")
    want = sorted(str(i) for i in range(1, 200) if (i % 50) % 3)
    kept = without(boxed(df, k=F.col("k")), drop, ["k"]).select("_row.*")
    assert sorted(r["v"] for r in kept.collect()) == want
    assert maybe_member(df, drop, ["k"], bits=64).where("_maybe").count() >= 200 - len(want)


def words_text(seed, n=60):
    rng = random.Random(seed)
    return " ".join(f"{rng.choice('bcdfg')}{rng.choice('aeiou')}{rng.randrange(99)}" for _ in range(n))


def test_near_dedup_stage_tells_rows_of_one_id_apart(spark):
    a, b, c = words_text(1), words_text(2), words_text(3)
    docs = rows(spark, [(1, a), (5, a), (5, b), (9, c), (9, c)])
    left = simhash.near_dedup_stage(spark, docs, "")
    assert left.columns == docs.columns
    assert sorted((r["doc_id"], r["text"]) for r in left.collect()) == sorted([(1, a), (5, b), (9, c)])


def test_near_dedup_stage_keeps_one_row_of_each_component(spark):
    rng = random.Random(7)
    texts = [words_text(i) for i in range(12)] + [None, "", " \n", "x", "long " * 50_000]
    table = [(rng.choice([None, *range(8)]), rng.choice(texts)) for _ in range(120)]
    table += [(1, words_text(0) + " more"), (1, words_text(0) + " other")]
    docs = rows(spark, table)
    left = [(r["doc_id"], r["text"]) for r in simhash.near_dedup_stage(spark, docs, "").collect()]
    prints = {t: simhash.fingerprint(t) % (1 << 64) for _, t in table}
    root = {p: p for p in prints.values()}
    for _ in root:
        root = {p: min(root[q] for q in root if (p ^ q).bit_count() <= 2) for p in root}
    groups = {}
    for i, t in table:
        groups.setdefault(root[prints[t]], []).append((i is None, i or 0, hashlib.md5((t or "").encode()).digest(), i, t))
    want = [min(g, key=lambda r: r[:3])[3:] for g in groups.values()]
    blank = {None: ""}
    assert sorted((i is None, i or 0, blank.get(t, t)) for i, t in left) == sorted((i is None, i or 0, blank.get(t, t)) for i, t in want)


def test_near_dedup_stage_of_an_empty_table(spark):
    assert simhash.near_dedup_stage(spark, rows(spark, []), "").collect() == []


def test_maybe_member_has_no_false_negatives_and_few_false_positives(spark):
    keys = spark.range(0, 40_000, 2).withColumnRenamed("id", "k")
    found = maybe_member(spark.range(80_000).withColumnRenamed("id", "k"), keys, ["k"])
    assert found.where("k < 40000 and k % 2 = 0 and not _maybe").count() == 0
    assert found.where("_maybe and not (k < 40000 and k % 2 = 0)").count() < 6000
