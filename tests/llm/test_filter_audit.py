"""The filter audit against plain counting over documents, and the diagrams against counting over masks."""

import random
import re
from itertools import permutations

from pyspark.sql import functions as F

from strandloom.llm.filter_audit import FILTERS, Diagram, audit, audit_counts, failure_masks, plain_changes

DOCS = "doc_id bigint, text string, source string, mask int, part string, n_chars bigint"
LABELS = "doc_id bigint, quality int, toxic int"


def plain_rows(docs, labels):
    """All rows of the audit by walking every document through every order."""
    firsts, known = {}, {}
    for doc_id, text, *_ in docs:
        if doc_id is not None:
            firsts[text or ""] = min(firsts.get(text or "", doc_id), doc_id)
    for doc_id, quality, toxic in labels:
        q, t = known.get(doc_id, (0, 0))
        known[doc_id] = (max(q, quality or 0), max(t, toxic or 0))
    known.pop(None, None)
    parts = {}
    for doc_id, text, source, *_ in docs:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = {
            "A": len(words) < 200,
            "B": 100 * len(set(words)) < 50 * len(words),
            "C": 100 * len(re.findall("[A-Z]", text)) > 2 * len(text),
            "D": bool(re.search(r"[#$%&*|]", text)),
            "E": doc_id is not None and firsts[text] < doc_id,
        }
        parts.setdefault(source or "", []).append((fails, known.get(doc_id, (0, 0))))
    rows = []
    for part, members in parts.items():
        removed_in_all = dict.fromkeys(FILTERS, 0)
        mine = []
        for order in map("".join, permutations(FILTERS)):
            left = members
            for step, letter in enumerate(order, 1):
                out = [m for m in left if m[0][letter]]
                left = [m for m in left if not m[0][letter]]
                redundant = sum(m[0][letter] for m in members) - len(out)
                unique = sum(m[0][letter] and sum(m[0].values()) == 1 for m in members)
                removed_in_all[letter] += len(out)
                mine.append([part, order, step, len(left), len(out), redundant, unique, sum(m[1][0] == 1 for m in out), sum(m[1][1] == 1 for m in out), letter])
        rows += [tuple(r[:-1]) + (removed_in_all[r[-1]],) for r in mine]
    return sorted(rows)


def long_text(seed, words=260, vocabulary=1000, extra=""):
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(words)) + extra


def some_documents():
    same = long_text(1)
    docs = [(i, long_text(i, extra=" #" * (i % 3 == 0)), ("x", "y", None)[i % 3], 7, "p", 1) for i in range(2, 20)]
    docs += [(30, same, "x", 1, "p", 1), (31, same, "y", 1, "p", 1), (31, same, "y", 1, "p", 1), (None, same, "y", 1, "p", 1), (29, same, "", 1, "p", 1)]
    docs += [(40, None, "x", 1, "p", 1), (41, "", None, 1, "p", 1), (42, " \t\x0b ", "x", 1, "p", 1), (43, "AB " * 300, "x", 1, "p", 1)]
    docs += [(44, long_text(5, 40_000, 5, " é😀|"), "z", 1, "p", 1), (45, " ".join("ab" for _ in range(300)), "z", 1, "p", 1), (46, long_text(6, 200), "z", 1, "p", 1)]
    labels = [(30, 1, 0), (31, 1, 1), (31, 0, 0), (40, None, 1), (43, 0, None), (None, 1, 1), (2, 1, 0), (999, 1, 1), (44, 1, 1)]
    return docs, labels


def test_audit_against_plain_counting(spark):
    docs, labels = some_documents()
    found = audit(failure_masks(spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS)))
    assert sorted(map(tuple, found.collect())) == plain_rows(docs, labels)


def test_empty_tables(spark):
    docs, labels = some_documents()
    none = spark.createDataFrame([], DOCS), spark.createDataFrame([], LABELS)
    assert audit(failure_masks(none[0], spark.createDataFrame(labels, LABELS))).collect() == []
    found = audit(failure_masks(spark.createDataFrame(docs, DOCS), none[1])).agg(F.sum("good_lost"), F.sum("toxic_lost"), F.count("*")).first()
    assert tuple(found) == (0, 0, 600 * 4)


def test_one_text_holds_most_rows(spark):
    rows = spark.range(20_000).select("id", F.when(F.col("id") % 3 == 0, F.concat(F.lit("own "), "id")).otherwise("copy").alias("text"), F.lit("hot").alias("source"))
    masks = failure_masks(rows.withColumnRenamed("id", "doc_id"), spark.createDataFrame([], LABELS))
    assert {r["mask"]: r["n"] for r in masks.collect()} == {1: 6667 + 1, 17: 20_000 - 6668}


def test_swaps_visit_all_orders():
    for n in range(1, 6):
        order = list(range(n))
        seen = {tuple(order)}
        for place in plain_changes(n):
            order[place], order[place + 1] = order[place + 1], order[place]
            seen.add(tuple(order))
        assert len(seen) == len(list(permutations(range(n)))) and sum(1 for _ in plain_changes(n)) == len(seen) - 1


def test_swapped_diagram_equals_one_built_in_that_order():
    rng = random.Random(3)
    counts = {m: tuple(rng.randrange(3) for _ in range(3)) for m in range(32) if rng.random() < 0.6}
    diagram = Diagram(FILTERS, counts)
    for place in plain_changes(len(FILTERS)):
        diagram.swap(place)
        order = "".join(diagram.order)
        turned = {sum((m >> FILTERS.index(f) & 1) << k for k, f in enumerate(order)): c for m, c in counts.items()}
        fresh = Diagram(order, turned)
        assert list(diagram.passing_path()) == list(fresh.passing_path())
        assert [len(level) for level in diagram.levels] == [len(level) for level in fresh.levels]


def test_equal_parts_of_a_diagram_are_one_node():
    diagram = Diagram(FILTERS, dict.fromkeys(range(32), (1, 0, 0)))
    assert [len(level) for level in diagram.levels] == [1] * 5
    assert len(audit_counts({0: (2, 1, 0)})) == 600
