"""Fill-in-the-middle by secondary sort.

A text is cut into prefix, middle and suffix at two places that a hash of its id chooses, and
each section into chunks of at most ``CHUNK`` code points. Chunks and marks are rows keyed by document and
place in the output. One repartition by document with a sort inside the partitions brings
each output in order, which streams through an incremental digest: no output is ever built as one string,
however long. The same stream reads the marks back out of the output and hands on its text with
section and place; a second sort inside the same partitions, without another shuffle, streams
the restored text through a digest of its own.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.llm.common import documents, text_of

MARKS = ("<P>", "<S>", "<M>")
MARK = re.compile("<[PSM]>")
CHUNK = 4096
# Of 100: plain from this number on; of the others, spm below that one.
PLAIN_FROM, SPM_BELOW = 90, 20
# Code points per Arrow batch that leaves a task.
AT_ONCE = 4_000_000

SQL = """
with t as (
  select doc_id, coalesce(text, '') as text, length(coalesce(text, '')) as n, sha256('1:' || coalesce(cast(doc_id as varchar), '')) as h from documents),
v as (
  select *, ('0x' || substr(h, 1, 8))::bigint % (n + 1) as c1, ('0x' || substr(h, 9, 8))::bigint % (n + 1) as c2,
    case when n = 0 or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') or ('0x' || substr(h, 17, 8))::bigint % 100 >= 90 then 'plain'
         when ('0x' || substr(h, 25, 8))::bigint % 100 < 20 then 'spm' else 'psm' end as form from t),
c as (
  select *, least(c1, c2) as a, greatest(c1, c2) as b from v),
s as (
  select *, substr(text, 1, a) as prefix, substr(text, a + 1, b - a) as middle, substr(text, b + 1) as suffix from c)
select doc_id, cast(n as bigint) as n, form, case when form <> 'plain' then cast(a as bigint) end as prefix_chars,
  case when form <> 'plain' then cast(b - a as bigint) end as middle_chars,
  sha256(case form when 'plain' then text when 'psm' then '<P>' || prefix || '<S>' || suffix || '<M>' || middle
         else '<S>' || suffix || '<P>' || prefix || '<M>' || middle end) as output_sha256,
  sha256(text) as restored_sha256
from s
"""


def plan(doc_id: int | None, text: str) -> tuple[str, int, int]:
    """Form and the two cuts of a text."""
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[i : i + 8], 16) for i in range(0, 32, 8))
    cuts = sorted((h1 % (len(text) + 1), h2 % (len(text) + 1)))
    if not text or h3 % 100 >= PLAIN_FROM or MARK.search(text):
        return "plain", *cuts
    return "spm" if h4 % 100 < SPM_BELOW else "psm", *cuts


def output_parts(form: str, text: str, a: int, b: int) -> list[tuple[int, int] | str]:
    """The output as marks and ranges of the text, in order."""
    prefix, middle, suffix = (0, a), (a, b), (b, len(text))
    if form == "plain":
        return [(0, len(text))]
    if form == "psm":
        return ["<P>", prefix, "<S>", suffix, "<M>", middle]
    return ["<S>", suffix, "<P>", prefix, "<M>", middle]


PIECES = "rid bigint, place bigint, doc_id bigint, n bigint, form string, prefix_chars bigint, middle_chars bigint, piece string"
SECTIONS = "rid bigint, section int, place bigint, doc_id bigint, n bigint, form string, prefix_chars bigint, middle_chars bigint, output_sha256 string, piece string"
OUT = "doc_id bigint, n bigint, form string, prefix_chars bigint, middle_chars bigint, output_sha256 string, restored_sha256 string"
_ARROW = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}


class Rows:
    """Rows gathered into Arrow batches of some ``AT_ONCE`` code points."""

    def __init__(self, schema: str):
        self.schema = pa.schema([(c.split()[0], _ARROW[c.split()[1]]) for c in schema.split(", ")])
        self.rows, self.size = [], 0

    def add(self, *row) -> bool:
        """Whether the batch is full."""
        self.rows.append(row)
        self.size += 64 + len(row[-1] or "")
        return self.size > AT_ONCE

    def batch(self) -> pa.RecordBatch:
        columns = list(zip(*self.rows)) or [()] * len(self.schema)
        made = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, self.schema)], schema=self.schema)
        self.rows, self.size = [], 0
        return made


def _cut_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A head row (place -1) per document, and its output as pieces with their places."""
    out = Rows(PIECES)
    for batch in batches:
        for rid, doc_id, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
            text = value.as_py()
            form, a, b = plan(doc_id, text)
            sizes = (None, None) if form == "plain" else (a, b - a)
            out.add(rid, -1, doc_id, len(text), form, *sizes, None)
            place = 0
            for part in output_parts(form, text, a, b):
                pieces = [part] if isinstance(part, str) else (text[i : min(i + CHUNK, part[1])] for i in range(part[0], part[1], CHUNK))
                for piece in pieces:
                    if out.add(rid, place, None, None, None, None, None, piece):
                        yield out.batch()
                    place += len(piece)
    yield out.batch()


class _Reader:
    """One document's output, read in order: its digest, and its text with the section it belongs to."""

    def __init__(self, rid: int, head: tuple):
        self.rid, self.head, self.plain = rid, head, head[2] == "plain"
        self.digest, self.left, self.section, self.place = hashlib.sha256(), "", 0, 0

    def read(self, piece: str) -> Iterator[tuple[int, int, str]]:
        self.digest.update(piece.encode("utf-8", "surrogatepass"))
        if self.plain:
            yield from self._text(piece)
            return
        seen = self.left + piece
        at = 0
        for mark in MARK.finditer(seen):
            yield from self._text(seen[at : mark.start()])
            self.section, self.place = "PMS".index(mark.group()[1]), 0
            at = mark.end()
        # A mark may go on in the next piece.
        stop = max(at, len(seen) - 2)
        yield from self._text(seen[at:stop])
        self.left = seen[stop:]

    def end(self) -> Iterator[tuple[int, int, str]]:
        yield from self._text(self.left)

    def _text(self, text: str) -> Iterator[tuple[int, int, str]]:
        if text:
            yield self.section, self.place, text
            self.place += len(text)


def _assemble_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digest of every output; its text again, by section and place in it. Sections -1: the head with the digest."""
    out, now = Rows(SECTIONS), None

    def send(found: Iterator[tuple[int, int, str]]) -> Iterator[pa.RecordBatch]:
        for section, place, text in found:
            if out.add(now.rid, section, place, None, None, None, None, None, None, text):
                yield out.batch()

    def close() -> Iterator[pa.RecordBatch]:
        if now:
            yield from send(now.end())
            out.add(now.rid, -1, 0, *now.head, now.digest.hexdigest(), None)

    for batch in batches:
        for rid, place, *head, piece in zip(*(c.to_pylist() for c in batch.columns)):
            if place < 0:
                yield from close()
                now = _Reader(rid, tuple(head))
            else:
                yield from send(now.read(piece))
    yield from close()
    yield out.batch()


def _restore_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out, head, digest = Rows(OUT), None, None
    for batch in batches:
        for _, section, _, *fields, piece in zip(*(c.to_pylist() for c in batch.columns)):
            if section < 0:
                if head and out.add(*head, digest.hexdigest()):
                    yield out.batch()
                head, digest = fields, hashlib.sha256()
            else:
                digest.update(piece.encode("utf-8", "surrogatepass"))
    if head:
        out.add(*head, digest.hexdigest())
    yield out.batch()


def outputs(docs: DataFrame) -> DataFrame:
    """rid, place, piece of every output, ordered by place inside the partition that holds ``rid``; place -1 has the head.

    ``rid`` numbers the rows as they are scanned, so repeated ids and rows stay apart. If ``docs``
    is not read from a table, write it first: a number must not change when a task runs again.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("bigint").alias("doc_id"), text_of().alias("text"))
    return rows.mapInArrow(_cut_batches, PIECES).repartition("rid").sortWithinPartitions("rid", "place")


def transformed(docs: DataFrame) -> DataFrame:
    """One row per document: columns as in ``OUT``.

    Null text counts as empty, empty texts are plain; a null doc_id is the hash of ``1:`` alone. Repeated rows
    give equal rows. A text that holds a mark is plain, and a mark cannot arise where a
    section and a mark meet, so the output alone restores the text. Other columns are ignored.
    """
    sections = outputs(docs).mapInArrow(_assemble_batches, SECTIONS).sortWithinPartitions("rid", "section", "place")
    return sections.mapInArrow(_restore_batches, OUT)


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transformed(documents(spark, sf_dir))
