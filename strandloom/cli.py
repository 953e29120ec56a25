"""Command line: ``python -m strandloom <program> <commands>``.

Commands run left to right over the state the earlier ones built, so parameters
come first. ``-o FOLDER`` sends the reports that follow to tab-separated files;
without it the first rows are shown.
"""

from __future__ import annotations

import inspect
import sys
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.functions.sequences import ALPHABETS, bases, compress_homopolymers, convert_alphabet
from strandloom.operators import assembly, composition, kmerset, linkage, mapping, overlaps, readset, repeats
from strandloom.params import SketchParams
from strandloom.session import checkpointed, spread, with_ordinal
from strandloom.sources import kmer_tables, sequence_files, stores, variants


def command(*names: str):
    """Register a method; its parameters are the command's values, defaults may be left out."""

    def mark(method):
        method.names = names
        return method

    return mark


class Program:
    def __init__(self, spark: SparkSession):
        self.spark, self.output, self.verbose, self.reports = spark, None, False, 0

    def reads(self, path: str, alphabet: str = "text") -> DataFrame:
        return spread(sequence_files.read_sequences(self.spark, path, alphabet), "read_id")

    def report(self, tag: str, frame: DataFrame) -> None:
        if self.output:
            self.reports += 1
            flat = [F.concat_ws(",", c).alias(c) if t.startswith("array") else F.col(c) for c, t in frame.dtypes]
            tagged = frame.select(F.lit(tag).alias("tag"), *flat)
            tagged.write.mode("overwrite").csv(f"{self.output}/{self.reports:02d}-{tag}", sep="\t", header=True)
        else:
            print(tag, *frame.columns, sep="\t")
            for row in frame.toLocalIterator():  # one partition at a time
                print(tag, *row, sep="\t")

    @command("-o", "--output")
    def set_output(self, folder):
        self.output = None if folder == "-" else folder

    @command("-v", "--verbose")
    def toggle_verbose(self):
        self.verbose = not self.verbose

    @command("-t", "--threads")
    def threads(self, n):
        """Parallelism is the cluster's; the value is accepted and unused."""

    def run(self, words: list[str]) -> None:
        methods = {n: m for _, m in inspect.getmembers(self, callable) for n in getattr(m, "names", ())}
        while words:
            method = methods.get(words[0])
            if method is None:
                raise SystemExit(f"unknown command {words[0]}; known: {' '.join(sorted(methods))}")
            end = 1
            while end < len(words) and words[end] not in methods:
                end += 1
            start = time.perf_counter()
            method(*words[1:end])
            if self.verbose:
                print(f"{words[0]} {time.perf_counter() - start:.1f} s", file=sys.stderr)
            words = words[end:]


class Kmers(Program):
    """Build, merge, prune, classify and report k-mer tables."""

    table: DataFrame | None = None
    params = SketchParams()

    @command("-c", "--create", "--modcreate")
    def create(self, bits=28, k=19, w=31, seed=17):
        self.params, self.table = SketchParams(int(k), int(w), int(seed)), None

    @command("-r", "--read")
    def read(self, path):
        self.table, self.params = kmer_tables.read_table(self.spark, path)

    @command("-w", "--write")
    def write(self, path):
        kmer_tables.write_table(self.table, self.params, path)

    @command("-rt", "--readtext")
    def read_text(self, path):
        self.table, self.params = kmer_tables.read_text(self.spark, path)

    @command("-wt", "--writetext")
    def write_text(self, path):
        indexed = self.table if "idx" in self.table.columns else with_ordinal(self.table, ["kmer"], "idx", start=1)
        kmer_tables.write_text(indexed, self.params, path)

    def _add(self, reads):
        new = kmerset.count_kmers(reads, self.params)
        merged = new if self.table is None else kmerset.add_counts(self.table, new)
        self.table = checkpointed(merged)
        self.report("added", kmerset.add_summary(reads, self.table, self.params))

    @command("-a", "--add")
    def add(self, path):
        self._add(self.reads(path))

    @command("-x", "--add10x")
    def add_linked(self, path):
        self._add(kmerset.linked_reads(self.reads(path)))

    @command("-m", "--merge")
    def merge(self, path):
        other, params = kmer_tables.read_table(self.spark, path)
        self.table = checkpointed(kmerset.merge(self.table, other, self.params, params))
        self.report("summary", kmerset.summarize(self.table))

    @command("-p", "--prune")
    def prune(self, low, high):
        self.table = kmerset.prune(self.table, int(low), int(high))
        if "idx" in self.table.columns:
            self.table = kmerset.reindex(self.table)

    @command("-s", "--setcopy")
    def set_copy(self, single, double, many):
        self.table = kmerset.set_copy(self.table, int(single), int(double), int(many))

    @command("-sM", "--setcopyM")
    def set_copy_many(self, many):
        self.table = kmerset.set_copy_many(self.table, int(many))

    @command("-H", "--hist")
    def histogram(self, path):
        kmerset.depth_histogram(self.table).orderBy("depth").write.mode("overwrite").csv(path, sep="\t")

    @command("-d", "--depth", "--depths")
    def depths(self, path, *others):
        named = {f"d{i}": kmer_tables.read_table(self.spark, other)[0] for i, other in enumerate(others)}
        kmerset.compare_depths(self.table, named).write.mode("overwrite").csv(path, sep="\t", header=True)

    @command("-P", "--refpaint")
    def paint(self, path):
        self.report("paint", mapping.paint(self.reads(path), self.table, self.params))


class Map(Program):
    """Index a reference and map queries to it."""

    k, w, seed = 19, 31, 17

    @command("-K", "--kmer")
    def set_k(self, value):
        self.k = int(value)

    @command("-W", "--window")
    def set_w(self, value):
        self.w = int(value)

    @command("-S", "--seed")
    def set_seed(self, value):
        self.seed = int(value)

    @command("-B", "--tableBits")
    def set_bits(self, value):
        """Tables grow as needed; the value is accepted and unused."""

    @command("-f", "--referenceFasta")
    def index(self, path):
        refs, self.params = self.reads(path), SketchParams(self.k, self.w, self.seed)
        self.names = refs.select("read_id", "name", F.length(bases(F.col("seq"))).alias("len"))
        self.occurrences = mapping.index_reference(refs, self.params)
        self.report("copies", mapping.copy_class_counts(mapping.reference_kmers(self.occurrences)))

    @command("-w", "--referenceWrite")
    def write(self, path):
        stores.write_reference(self.occurrences, self.names, self.params, path)

    @command("-r", "--referenceRead")
    def read(self, path):
        self.occurrences, self.names, self.params = stores.read_reference(self.spark, path)

    @command("-q", "--query")
    def query(self, path):
        queries = self.reads(path)
        seeds = mapping.query_seeds(queries, checkpointed(mapping.reference_kmers(self.occurrences)), self.params)
        self.report("Q", mapping.query_summary(queries, seeds))
        query_names = queries.select("read_id", F.col("name").alias("query_name"))
        ref_names = self.names.select(F.col("read_id").alias("ref_id"), F.col("name").alias("ref_name"))
        blocks = mapping.chain_blocks(seeds)
        self.report("M", blocks.join(query_names, "read_id", "left").join(ref_names, "ref_id", "left").select(*blocks.columns, "query_name", "ref_name"))


class Reads(Program):
    """Overlap, check, contain, cluster and lay out long reads."""

    marks: DataFrame | None = None
    flags: DataFrame | None = None
    runs = 0

    @command("-m", "--modset")
    def read_table(self, path):
        self.table, self.params = kmer_tables.read_table(self.spark, path)

    @command("-f", "--seqfile")
    def load(self, path):
        self.set = readset.load(self.reads(path), self.table, self.params).materialized()

    @command("-w", "--write")
    def write(self, path):
        stores.write_readset(self.set, path)

    @command("-r", "--read")
    def read(self, path):
        self.set = stores.read_readset(self.spark, path)

    def _retable(self, table):
        self.set, self.pairs = readset.with_info(self.set, table).materialized(), None

    pairs: DataFrame | None = None

    def _overlaps(self):
        if self.pairs is None:
            self.pairs = checkpointed(overlaps.overlaps(self.set))
        return self.pairs

    def _unmarked(self):
        """Overlaps whose other read has not been marked bad."""
        if self.flags is None:
            return self._overlaps()
        marked = self.flags.where("bad <> 0").select(F.col("read_id").alias("y"))
        return self._overlaps().join(marked, "y", "left_anti")

    @command("-S", "--stats")
    def stats(self):
        self.report("RS", readset.statistics(self.set, self.flags))

    @command("-o1", "--overlap1")
    def overlaps_of(self, read):
        self.report("RH", self._unmarked().where(F.col("x") == int(read)).orderBy(F.desc("n_hit"), "y"))

    @command("-o2", "--overlap2")
    def every_kth(self, k):
        self.report("RR", overlaps.read_flags(self.set, self._unmarked()).where(F.col("read_id") % int(k) == 0))

    @command("-o3", "--overlap3")
    def detail(self, x, y):
        pair = self.spark.range(1).select(F.lit(int(x)).cast("bigint").alias("x"), F.lit(int(y)).cast("bigint").alias("y"))
        self.report("RO", overlaps.shared_details(self.set, pair).orderBy("x_pos", "y_pos"))

    @command("-b", "--markBadReads")
    def mark_bad(self):
        flags = overlaps.read_flags(self.set, self._overlaps())
        self.flags = checkpointed(overlaps.mark_bad(flags, self._overlaps()))
        self.report("MB", self.flags.groupBy("bad").count())

    @command("-c", "--markContained")
    def mark_contained(self):
        flags = self.flags if self.flags is not None else overlaps.read_flags(self.set, self._overlaps())
        self.report("MC", overlaps.mark_contained(flags, self._overlaps()))

    @command("-a1", "--assemble1")
    def consensus(self, read):
        hits = checkpointed(assembly.consensus_hits(self.set, self._unmarked().where(F.col("x") == int(read))))
        self.report("AR", assembly.consensus_totals(hits))
        self.report("AH", assembly.consensus_table(hits))

    @command("-a2", "--assemble2")
    def layout(self, kmer, offset=0):
        seeds = self.spark.range(1).select(F.lit(int(kmer)).cast("bigint").alias("seed"), F.lit(int(offset)).cast("bigint").alias("offset"))
        self.report("LAYOUT", assembly.layouts(self.set, seeds))

    @command("-u", "--cluster")
    def cluster(self):
        self.report("CLUSTER", overlaps.cluster_sizes(overlaps.clusters(overlaps.candidates(self.set))))

    @command("-C", "--cleanmods")
    def clean(self):
        self._retable(readset.apply_flags(self.set.table, readset.kmer_flags(self.set)))

    @command("-R", "--ref")
    def reference(self, path, core=linkage.CORE_DEPTH, multi=linkage.MULTI_DEPTH, nth=200):
        marks = checkpointed(linkage.mark_reference(self.set, self.reads(path), int(core), int(multi)))
        covered = linkage.covered_hits(self.set, marks, int(nth))
        self.marks = checkpointed(linkage.infer_positions(marks, covered, int(core), int(multi)))
        self._retable(self.marks)
        self.report("REF", linkage.mark_summary(self.marks))

    @command("-rb", "--resetbits")
    def reset(self, op):
        resets = {
            1: lambda: linkage.reset_core(self.marks),
            2: lambda: linkage.reset_core(self.marks, skip_repeats=True),
            3: lambda: linkage.reset_core_by_read(self.marks, self.set, 1),
        }
        self.marks = checkpointed(resets[int(op)]())
        self._retable(self.marks)

    @command("-T", "--testmods")
    def test(self, low, high):
        self.runs += 1
        counts = checkpointed(linkage.linkage_counts(linkage.test_pairs(self.set, int(low), int(high)), self.runs))
        self.report("TEST", counts)
        self.marks = checkpointed(linkage.zero_unlinked(self.marks, counts, self.runs))
        self._retable(self.marks)

    @command("-P", "--readProperties")
    def properties(self):
        self.report("READ", readset.read_properties(self.set))
        self.report("RM", readset.repeated_kmers(self.set))


class Repeats(Program):
    """Reads over one tandem repeat unit."""

    @command("-R", "--ref")
    def reference(self, path, table):
        known, self.params = kmer_tables.read_table(self.spark, table)
        found = repeats.reference_kmers(self.reads(path), self.params, strict=True)
        self.unit = checkpointed(found.join(known.select("kmer"), "kmer", "left_semi"))

    def _prepare(self, path, table):
        reads, known = self.reads(path), kmer_tables.read_table(self.spark, table)[0]
        return reads, known, checkpointed(repeats.strand_vote(reads, self.unit, self.params))

    @command("-s1", "--seq1")
    def analyse(self, path, table):
        reads, known, votes = self._prepare(path, table)
        self.report("BADREAD", votes.where("is_bad"))
        found = repeats.analyse(reads, votes, known, self.params)
        self.report("MOD", repeats.commonest_neighbour(found["links"]))
        self.report("BLOCK", repeats.read_blocks(found["reads"], found["hits"]))

    @command("-s2", "--seq2")
    def boundaries(self, path, table, *kmers):
        self.report("RING", repeats.boundary_cooccurrence(self.reads(path), [int(k) for k in kmers], self.params))

    @command("-s3", "--seq3")
    def duplicates(self, path, table):
        reads, known, votes = self._prepare(path, table)
        hits = checkpointed(repeats.oriented_hits(reads, votes, known, self.params))
        self.report("DUP", repeats.duplicate_summary(votes, hits, known))


class Variants(Program):
    """Load a reference, a site file and a sample file and check them."""

    @command("-i", "--input")
    def load(self, reference, sites, samples):
        contigs = self.reads(reference).select("name", F.length("seq").alias("len"))
        named = variants.check_unique_names(contigs)
        self.report("SITES", variants.valid_sites(variants.read_sites(self.spark, sites, named)))
        self.report("SAMPLES", variants.read_samples(self.spark, samples))


class Stats(Program):
    """Length, base and quality statistics."""

    @command("-i", "--input")
    def load(self, path):
        self.set = self.reads(path, "letters").withColumn("len", F.length("seq"))
        self.report("lengths", composition.length_summary(self.set))

    @command("-b", "--bases")
    def base_counts(self):
        self.report("bases", composition.base_composition(self.set, letters=ALPHABETS["letters"]["from"]))

    @command("-q", "--qualities")
    def quality_counts(self):
        self.report("qualities", composition.quality_histogram(self.set).orderBy("qual"))

    @command("-l", "--length")
    def length_bins(self):
        self.report("N50", composition.length_n50(self.set))
        self.report("length-bins", composition.length_distribution(self.set).orderBy("length_from"))


class Convert(Program):
    """Convert sequence files; the kind is fasta, fastq, records or parquet."""

    @command("-i", "--input")
    def convert(self, source, target, kind=None):
        sequence_files.convert(self.spark, source, target, kind)


class Compress(Program):
    """Homopolymer-compress a sequence file to FASTA."""

    @command("-i", "--input")
    def compress(self, source, target):
        seq = compress_homopolymers(convert_alphabet(F.col("seq"), "text"))
        reads = self.reads(source).select("read_id", "name", F.lit("").alias("desc"), seq.alias("seq"))
        sequence_files.write_sequences(reads, target)


PROGRAMS = {
    "kmers": Kmers, "map": Map, "reads": Reads, "repeats": Repeats,
    "variants": Variants, "stats": Stats, "convert": Convert, "compress": Compress,
}


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    words = sys.argv[1:] if argv is None else argv
    if not words or words[0] not in PROGRAMS:
        raise SystemExit("usage: python -m strandloom {" + "|".join(PROGRAMS) + "} <commands>")
    spark = spark or SparkSession.builder.appName(f"strandloom {words[0]}").getOrCreate()
    PROGRAMS[words[0]](spark).run(list(words[1:]))
