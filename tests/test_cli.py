import random

import pytest

from strandloom import cli
from strandloom.operators import mapping
from strandloom.params import SketchParams
from strandloom.sources import kmer_tables, stores


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    folder = tmp_path_factory.mktemp("cli")
    rng = random.Random(31)
    genome = "".join(rng.choice("ACGT") for _ in range(3000))
    tiles = [genome[i : i + 600] for i in range(0, 2401, 200)]
    (folder / "a.fa").write_text("".join(f">r{i}\n{s}\n" for i, s in enumerate(tiles)))
    (folder / "b.fa").write_text("".join(f">q{i}\n{s[50:300]}\n" for i, s in enumerate(tiles)))
    (folder / "unit.fa").write_text(f">unit\n{genome}\n")
    return folder


def _run(spark, files, text):
    cli.main([w.replace("@", f"{files}/") for w in text.split()], spark)


def _rows(spark, path):
    return spark.read.csv(str(path), sep="\t", header=True).collect()


def test_kmer_commands(spark, files):
    _run(spark, files, "kmers -c 28 15 5 17 -a @a.fa -w @x")
    _run(spark, files, "kmers -c 28 15 5 17 -a @b.fa -w @y")
    _run(spark, files, "kmers -r @x -m @y -H @hist -w @xy")
    _run(spark, files, "kmers -r @xy -p 2 200 -s 3 6 50 -w @xy2 -wt @xy2.txt -o @out -d @depths @x @y -P @unit.fa")
    _run(spark, files, "kmers -c 28 15 5 17 -a @a.fa -a @b.fa -w @both")
    merged, _ = kmer_tables.read_table(spark, f"{files}/xy")
    both, params = kmer_tables.read_table(spark, f"{files}/both")
    assert params.k == 15 and sorted((r.kmer, r.depth) for r in merged.collect()) == sorted((r.kmer, r.depth) for r in both.collect())
    pruned, _ = kmer_tables.read_table(spark, f"{files}/xy2")
    text, _ = kmer_tables.read_text(spark, f"{files}/xy2.txt")
    assert sorted((r.kmer, r.info) for r in text.collect()) == sorted((r.kmer, r.info) for r in pruned.collect())
    depths = _rows(spark, files / "depths")
    assert all(int(r.depth) == int(r.d0) + int(r.d1) for r in depths) and len(depths) == pruned.count()
    assert len(_rows(spark, files / "out/01-paint")) >= pruned.count()


def test_map_commands(spark, files):
    _run(spark, files, "map -K 15 -W 5 -o @map -f @unit.fa -w @index -q @b.fa")
    _run(spark, files, "map -r @index -o @map2 -q @b.fa")
    first, second = _rows(spark, files / "map/03-M"), _rows(spark, files / "map2/02-M")
    assert sorted(first) == sorted(second) and len(first) == 13
    assert {(r.query_name, r.ref_name) for r in first} == {(f"q{i}", "unit") for i in range(13)}


def test_pruning_renumbers(spark, files):
    _run(spark, files, "kmers -c 28 15 5 17 -a @a.fa -wt @whole.txt")
    _run(spark, files, "kmers -rt @whole.txt -p 3 100 -wt @pruned.txt")
    pruned = kmer_tables.read_text(spark, f"{files}/pruned.txt")[0]
    assert sorted(r.idx for r in pruned.collect()) == list(range(1, pruned.count() + 1))
    assert pruned.count() < kmer_tables.read_text(spark, f"{files}/whole.txt")[0].count()


def test_ambiguity_letters_stay(spark, files):
    (files / "amb.fa").write_text(">a\nACGTRYKM-nacgt\n")
    _run(spark, files, "convert -i @amb.fa @amb.parquet parquet")
    assert [r.seq for r in spark.read.parquet(f"{files}/amb.parquet").collect()] == ["ACGTRYKM-nacgt"]
    _run(spark, files, "stats -o @ambs -i @amb.fa")
    assert int(_rows(spark, files / "ambs/01-lengths")[0].total) == 14


def test_screen_reports_are_whole(spark, files, capsys):
    _run(spark, files, "kmers -c 28 15 5 17 -a @a.fa -P @unit.fa")
    shown = [line for line in capsys.readouterr().out.splitlines() if line.startswith("paint\t")]
    assert len(shown) > 100


def test_read_commands(spark, files):
    _run(spark, files, "kmers -c 28 15 5 17 -a @a.fa -s 1 5 20 -w @t")
    _run(spark, files, "reads -m @t -f @a.fa -w @set -o @reads -S -o1 5 -o3 5 6 -b -c -u -P -a1 5 -C -o2 3")
    _run(spark, files, "reads -r @set -o @reads2 -C -R @unit.fa 1 100 10 -rb 2 -T 2 5")
    assert {int(r.y) for r in _rows(spark, files / "reads/02-RH")} == {3, 4, 5, 6, 7}
    assert [int(r.n_reads) for r in _rows(spark, files / "reads/06-CLUSTER")] == [13]
    assert len(_rows(spark, files / "reads2/02-TEST")) > 0
    loaded = stores.read_readset(spark, f"{files}/set")
    seed = loaded.hits.where("read_id = 6 and depth = 3").first()
    _run(spark, files, f"reads -r @set -o @walk -a2 {seed.kmer} 100")
    assert len(_rows(spark, files / "walk/01-LAYOUT")) == 3


def test_other_commands(spark, files):
    _run(spark, files, "kmers -c 28 15 5 17 -a @unit.fa -w @u")
    _run(spark, files, "kmers -c 28 15 5 17 -a @a.fa -w @t2")
    kmers = [str(r.kmer) for r in kmer_tables.read_table(spark, f"{files}/u")[0].orderBy("kmer").limit(4).collect()]
    _run(spark, files, f"repeats -R @unit.fa @u -o @rep -s1 @a.fa @t2 -s3 @a.fa @t2 -s2 @a.fa @t2 {' '.join(kmers)}")
    assert len(_rows(spark, files / "rep/03-BLOCK")) >= 1
    _run(spark, files, "stats -o @stats -i @a.fa -b -l")
    assert int(_rows(spark, files / "stats/01-lengths")[0].total) == 13 * 600
    _run(spark, files, "convert -i @a.fa @a.rec records")
    _run(spark, files, "compress -i @a.rec @a.hoco.fa")
    _run(spark, files, "stats -o @stats2 -i @a.hoco.fa")
    assert int(_rows(spark, files / "stats2/01-lengths")[0].total) < 13 * 600
    with pytest.raises(SystemExit):
        _run(spark, files, "kmers -zz")


def test_stored_kmers_are_not_shuffled(spark, tmp_path):
    """A lookup in a stored reference moves the queries' side only; a second write replaces the first."""
    params = SketchParams(11, 3)
    names = spark.createDataFrame([(1, "a", 40)], "read_id long, name string, len int")
    texts = ["ACGTTGCATGCATCGGATCATTACGGATCTAGGATCAACGT", "TTGACCAGATTACAGGACCATAGGCATTAGGACCATTGACC"]
    for text in texts:
        refs = spark.createDataFrame([(1, text)], "read_id long, seq string")
        stores.write_reference(mapping.index_reference(refs, params), names, params, str(tmp_path / "ref"))
    stored = stores.read_reference_kmers(spark, str(tmp_path / "ref"))
    assert sorted(stored.collect()) == sorted(mapping.reference_kmers(mapping.index_reference(refs, params)).collect())
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("stored_")]
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        seeds = mapping.query_seeds(refs, stored, params, kept=True)
        plan = seeds._jdf.queryExecution().executedPlan().toString()
        found = seeds.collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert "hashpartitioning(_probe" in plan and "hashpartitioning(_cold_key" not in plan and "Bucketed: true" in plan
    assert found and all(r.copy for r in found)
