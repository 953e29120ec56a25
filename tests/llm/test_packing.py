"""Token ids, the configuration program and the packed sequences."""

import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from strandloom.llm import packing
from strandloom.llm.tokens import WordIds

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = ["", "  a  b ", "İstanbul <|endoftext|> don't DON'T x's 'sx", "éa  ÉÁ ß ẞ ǅ Ǆ", "naïve...,!! word's\n\tnew line 3rd 12a", "ΣΑΣ ΣΑΣ. '", "😀a 日本語テキスト １２", "à ́b", "x´y µm ªº", "<|startoftext|>abc A_B-C", "l'd 'll''", "\x00\x01 \x85 a", "ab" * 3000]


def encode(text):
    return Tokenizer.from_file(PATH).encode(text, add_special_tokens=False).ids


def test_ids_equal_the_tokenizers():
    words = WordIds(PATH)
    ids, stops = words.of(pa.array(ODD))
    assert [ids[a:b].tolist() for a, b in zip([0, *stops], stops)] == [encode(t) for t in ODD]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.characters(codec="utf-8"), max_size=30), min_size=1, max_size=4))
def test_ids_of_any_text(texts):
    ids, stops = WORDS.of(pa.array(texts, pa.string()))
    assert [ids[a:b].tolist() for a, b in zip([0, *stops], stops)] == [TOKENIZER.encode(t, add_special_tokens=False).ids for t in texts]


WORDS, TOKENIZER = WordIds(PATH), Tokenizer.from_file(PATH)


def test_knapsack_is_optimal():
    rng = np.random.default_rng(0)
    for _ in range(20):
        values = np.where(rng.random(31) < 0.4, rng.random(31), -1.0)
        best, choice = packing.knapsack(values)
        plain = np.zeros(31)
        for room in range(1, 31):
            plain[room] = max([plain[room - 1]] + [plain[room - n] + values[n] for n in range(1, room + 1) if values[n] > 0])
        assert np.allclose(best, plain)
        taken = packing.filled(choice, 30)
        assert sum(taken) <= 30 and np.isclose(sum(values[n] for n in taken), best[30])


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(1, 60), max_size=200), st.integers(60, 64))
def test_configurations_hold_every_piece_once(lengths, capacity):
    histogram = np.bincount(np.array(lengths, int), minlength=capacity + 1)
    chosen = packing.configurations(histogram)
    got = np.zeros(capacity + 1, int)
    for pattern, n in chosen:
        assert sum(pattern) <= capacity and n > 0
        np.add.at(got, list(pattern), n)
    assert (got == histogram).all()
    # Never worse than first fit decreasing by more than one sequence.
    rooms = []
    for n in sorted(lengths, reverse=True):
        at = next((i for i, r in enumerate(rooms) if r >= n), None)
        if at is None:
            rooms.append(capacity - n)
        else:
            rooms[at] -= n
    assert sum(n for _, n in chosen) <= len(rooms) + 1


def test_pack(spark):
    texts = [(1, "a b c"), (2, None), (3, ""), (4, "word " * 40), (5, "word " * 15), (5, "word " * 15), (None, "x" * 50), (7, "é " * 33)]
    docs = spark.createDataFrame([(i, t, "s", 3) for i, t in texts], "doc_id long, text string, source string, length long")
    got = packing.pack(docs, PATH, 16).collect()
    want = []
    for i, t in texts:
        ids = [*encode(t or ""), 0]
        for k, start in enumerate(range(0, len(ids), 16)):
            piece = np.array(ids[start : start + 16], "<u4")
            want.append((i, k, start, len(piece), zlib.crc32(piece.tobytes())))
    assert sorted((tuple(r)[:5] for r in got), key=str) == sorted(want, key=str)
    sequences = {}
    for r in got:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in sequences.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 16
    assert len(sequences) <= -(-sum(w[3] for w in want) // 16) + 1
    assert packing.pack(docs.where("false"), PATH).count() == 0


def plain_best_fit(lengths, capacity):
    rooms = []
    for n in sorted(lengths, reverse=True):
        at = min((i for i, r in enumerate(rooms) if r >= n), key=lambda i: rooms[i], default=None)
        if at is None:
            rooms.append(capacity - n)
        else:
            rooms[at] -= n
    return len(rooms)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=120))
def test_best_fit_of_equal_pieces_at_once(lengths):
    chosen = packing.best_fit(np.bincount(np.array(lengths, int), minlength=51))
    assert sum(n for _, n in chosen) == plain_best_fit(lengths, 50)
    assert sorted(x for pattern, n in chosen for x in pattern * n) == sorted(lengths) and all(sum(p) <= 50 for p, _ in chosen)


def hard_histograms():
    rng = np.random.default_rng(0)
    lists = {
        "thirds and halves": rng.choice([660, 670, 690, 700, 710, 1000, 1010, 1020, 1030, 1040], 5000),
        "long and middle": np.r_[rng.integers(1100, 1900, 3000), rng.integers(300, 900, 3000)],
        "long and a few short": np.r_[rng.integers(1100, 1900, 3000), rng.integers(10, 100, 200)],
        "near a third": rng.integers(600, 761, 4000),
        "all lengths": rng.integers(1, 2049, 6000),
    }
    return {k: np.bincount(v, minlength=2049) for k, v in lists.items()}


def test_sequences_against_the_programs_bound_and_best_fit():
    """At most 3 % over the linear program's bound on histograms without fitting short pieces, and never over best fit."""
    for name, histogram in hard_histograms().items():
        chosen = packing.configurations(histogram)
        got, program = sum(n for _, n in chosen), packing.Program(histogram)
        program.run(packing.STEPS)
        assert got <= sum(n for _, n in packing.best_fit(histogram)), name
        assert program.bound <= got <= 1.03 * program.bound, name
        total = np.zeros_like(histogram)
        for pattern, n in chosen:
            np.add.at(total, list(pattern), n)
        assert (total == histogram).all(), name


def test_bound_of_a_program_with_a_known_optimum():
    histogram = np.zeros(101, np.int64)
    histogram[[34, 51]] = 300, 100  # two of 34, or 51 and 34
    program = packing.Program(histogram)
    program.run(2000)
    assert 199 <= program.bound <= 200 and sum(n for _, n in packing.configurations(histogram)) == 200
