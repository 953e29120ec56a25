import random

from pyspark.sql import functions as F

from strandloom import session


def _rows(spark, n=500):
    rng = random.Random(1)
    values = [(i, rng.randrange(5), rng.choice("abc")) for i in range(n)]
    rng.shuffle(values)
    return spark.createDataFrame(values, "i long, v int, s string"), sorted(values)


def test_ordinal_and_previous(spark):
    frame, rows = _rows(spark)
    got = {r.i: r.n for r in session.with_ordinal(frame, [F.desc("i")], "n", start=1).collect()}
    assert got == {i: 500 - i for i in range(500)}
    previous = {r.i: (r.prev_v, r.prev_s) for r in session.with_previous(frame, ["i"], ["v", "s"]).collect()}
    assert previous == {i: (rows[i - 1][1:] if i else (None, None)) for i in range(500)}


def test_lookup_with_hot_keys(spark, monkeypatch):
    monkeypatch.setattr(session, "HOT_KEYS", 2)
    rng = random.Random(2)
    facts = [(i, 7 if i % 3 == 0 else rng.randrange(20)) for i in range(900)]
    keyed = [(k, sum(f[1] == k for f in facts), f"k{k}" if k % 2 else None) for k in range(15)]
    found = session.lookup(
        spark.createDataFrame(facts, "i long, k long"), spark.createDataFrame(keyed, "k long, n long, name string"), "k", "i", weight="n"
    )
    counted = session.lookup(
        spark.createDataFrame(facts, "i long, k long"), spark.createDataFrame(keyed, "k long, n long, name string"), "k", "i"
    )
    assert sorted(counted.collect()) == sorted(found.collect())
    info = {k: (n, name) for k, n, name in keyed}
    assert sorted((r.i, r.k, r.n, r.name) for r in found.collect()) == [(i, k, *info.get(k, (None, None))) for i, k in facts]


def test_configured_checkpoint_folder_is_kept(spark):
    before = spark.sparkContext.getCheckpointDir()
    session.ensure_checkpoint_dir(spark)
    after = spark.sparkContext.getCheckpointDir()
    assert after and before in (None, after)
