"""Typed record files: one-letter line types with a declared schema, text form.

Each line is ``type field field ...``; strings and lists carry their length first.
Upper-case lines belong to objects, one lower-case type may group objects.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import takewhile

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from strandloom.functions.sequences import quality_text, quality_values
from strandloom.sources.lines import head_lines, read_lines, running_counts, split_totals, write_lines

# Field type names, format version and header line marks.
FIELD_TYPES = {
    "INT": T.LongType(),
    "REAL": T.DoubleType(),
    "CHAR": T.StringType(),
    "STRING": T.StringType(),
    "INT_LIST": T.ArrayType(T.LongType()),
    "REAL_LIST": T.ArrayType(T.DoubleType()),
    "STRING_LIST": T.ArrayType(T.StringType()),
    "DNA": T.StringType(),
}
LIST_FIELDS = ("STRING", "INT_LIST", "REAL_LIST", "STRING_LIST", "DNA")
MAJOR, MINOR = 1, 0
GROUP, OBJECT, DATA = "G", "O", "D"
PROVENANCE, REFERENCE, DEFERRED, SCHEMA_LINE, SPACER = "!", "<", ">", "~", "."


@dataclass(frozen=True)
class LineType:
    kind: str
    fields: tuple[str, ...]


@dataclass(frozen=True)
class RecordSchema:
    """Line types of one file type; exactly one object type, at most one group type."""

    file_type: str
    lines: dict[str, LineType]
    subtypes: tuple[str, ...] = ()

    def letter(self, kind: str) -> str | None:
        return next((letter for letter, line in self.lines.items() if line.kind == kind), None)

    def declared_in(self, other: "RecordSchema") -> bool:
        """Every line type also exists in ``other`` with the same fields."""
        return all(
            letter in other.lines and other.lines[letter].fields == line.fields for letter, line in self.lines.items()
        )

    def struct(self, letter: str) -> T.StructType:
        kinds = self.lines[letter].fields
        return T.StructType([T.StructField(f"f{i}", FIELD_TYPES[k]) for i, k in enumerate(kinds)])


@dataclass(frozen=True)
class Header:
    """What precedes the data: provenance rows and referenced files."""

    provenance: tuple[tuple[str, str, str, str], ...] = ()
    references: tuple[tuple[str, int], ...] = ()
    deferred: tuple[str, ...] = field(default=())

    def inherit(self, other: "Header") -> "Header":
        """Entries of ``other`` followed by our own."""
        return Header(
            other.provenance + self.provenance, other.references + self.references, other.deferred + self.deferred
        )


def parse_schema(text: str) -> dict[str, RecordSchema]:
    """Schemas by file type from ``P``/``S``/``G``/``O``/``D`` declaration lines."""
    found: dict[str, RecordSchema] = {}
    current = None
    for line in text.splitlines():
        words = line.split()
        if not words or words[0] not in ("P", "S", GROUP, OBJECT, DATA):
            continue
        if words[0] == "P":
            current = words[2]
            found[current] = RecordSchema(current, {})
        elif words[0] == "S":
            old = found[current]
            found[current] = RecordSchema(current, old.lines, (*old.subtypes, words[2]))
        else:
            found[current].lines[words[1]] = _line_type(words[0], words[2:])
    for schema in found.values():
        _check(schema)
    return found


def _line_type(kind: str, words: list[str]) -> LineType:
    names = tuple(words[2 : 2 + 2 * int(words[0]) : 2])
    unknown = [name for name in names if name not in FIELD_TYPES]
    if unknown or len(names) != int(words[0]):
        raise ValueError(f"bad field list {words}")
    if sum(name in LIST_FIELDS for name in names) > 1:
        raise ValueError("a line type may have one list field")
    return LineType(kind, names)


def _check(schema: RecordSchema) -> None:
    kinds = [line.kind for line in schema.lines.values()]
    if kinds.count(GROUP) > 1 or kinds.count(OBJECT) > 1:
        raise ValueError(f"schema {schema.file_type} has several group or object types")


def _header_text(spark: SparkSession, path: str) -> list[str]:
    """Everything before the first data line."""
    return list(takewhile(lambda line: not line[:1].isalpha(), head_lines(spark, path)))


def embedded_schema(spark: SparkSession, path: str) -> RecordSchema:
    """Schema from the file's own ``~`` lines."""
    head = _header_text(spark, path)
    if not head or not head[0].startswith("1 ") or len(head[0].split()) < 5:
        raise ValueError(f"{path} has no type line")
    _, _, file_type, major, minor = head[0].split()[:5]
    if int(major) != MAJOR or int(minor) > MINOR:
        raise ValueError(f"unsupported version {major}.{minor}")
    lines = {}
    for words in (line.split() for line in head if line.startswith(f"{SCHEMA_LINE} ")):
        lines[words[2]] = _line_type(words[1], words[3:])
    schema = RecordSchema(file_type, lines)
    _check(schema)
    return schema


def read_records(spark: SparkSession, path: str, schema: RecordSchema | None = None, group_line: bool = False) -> DataFrame:
    """All data lines: line_no, line_type, value, object_id, group_id.

    Ids count the object and group lines up to and including the line (0 before the first).
    With ``group_line`` each line also has the text of its group's line (null before the first group).
    """
    schema = schema or embedded_schema(spark, path)
    return _placed_records(read_lines(spark, path), schema, group_line)


def _data_lines(lines: DataFrame, schema: RecordSchema) -> DataFrame:
    kind = F.substring("value", 1, 1)
    return lines.where(kind.isin(*schema.lines) & ((F.length("value") == 1) | F.substring("value", 2, 1).eqNullSafe(" ")))


def _parser_state(schema: RecordSchema) -> tuple[dict[str, Column], dict[str, Column]]:
    """What a reader knows at a line: counts of lines, objects and groups, and the last group line."""
    kind = F.substring("value", 1, 1)
    opened, grouped = schema.letter(OBJECT), schema.letter(GROUP)
    counts = {
        "line_no": F.lit(1),
        "object_id": (kind == F.lit(opened)).cast("int") if opened else F.lit(0),
        "group_id": (kind == F.lit(grouped)).cast("int") if grouped else F.lit(0),
    }
    return counts, {"group_line": F.when(kind == F.lit(grouped), F.col("value")) if grouped else F.lit(None)}


def _placed_records(lines: DataFrame, schema: RecordSchema, group_line: bool, start: DataFrame | None = None) -> DataFrame:
    counts, carried = _parser_state(schema)
    carried = carried if group_line else {}
    numbered = running_counts(_data_lines(lines, schema), counts, carried, start)
    return numbered.select("line_no", F.substring("value", 1, 1).alias("line_type"), "value", "object_id", "group_id", *carried)


def _token(rest: Column) -> Column:
    return F.substring_index(rest, " ", 1)


def _after(rest: Column, n: Column) -> Column:
    """Drop ``n`` characters and the separating blank."""
    return F.substring(rest, n + 2, F.length(rest))


def _string_list(rest: Column, n: Column) -> Column:
    """``items``: ``n`` length-prefixed strings as an array, consuming from the left; ``rest``: the text behind them."""
    start = F.struct(rest.alias("rest"), F.array().cast("array<string>").alias("items"))

    def step(state: Column, _: Column) -> Column:
        size = _token(state["rest"])
        tail = _after(state["rest"], F.length(size))
        return F.struct(
            _after(tail, size.cast("int")).alias("rest"),
            F.array_append(state["items"], F.substring(tail, F.lit(1), size.cast("int"))).alias("items"),
        )

    steps = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(steps, start, step)


def _leading(schema: RecordSchema, letter: str) -> int:
    """Number of fields before a list field."""
    kinds = schema.lines[letter].fields
    return next((i for i, kind in enumerate(kinds) if kind in LIST_FIELDS), len(kinds))


def _fields(schema: RecordSchema, letter: str, words: Column) -> list[Column]:
    """Field columns of a line cut at its first ``_leading + 2`` blanks; text after the fields is a comment."""
    kinds, at = schema.lines[letter].fields, _leading(schema, letter)
    found = [F.get(words, F.lit(i + 1)).cast(FIELD_TYPES[kind]) for i, kind in enumerate(kinds[:at])]
    if at == len(kinds):
        return found
    n, rest = F.get(words, F.lit(at + 1)).cast("int"), F.coalesce(F.get(words, F.lit(at + 2)), F.lit(""))
    if kinds[at] in ("STRING", "DNA"):
        found.append(F.substring(rest, F.lit(1), n))
        behind, first = F.split(_after(rest, n), " "), F.lit(0)
    elif kinds[at] == "STRING_LIST":
        listed = _string_list(rest, n)
        found.append(listed["items"])
        behind, first = F.split(listed["rest"], " "), F.lit(0)
    else:
        behind, first = F.split(rest, " "), n
        found.append(F.slice(behind, F.lit(1), n).cast(FIELD_TYPES[kinds[at]]))
    later = kinds[at + 1 :]
    return found + [F.get(behind, first + i).cast(FIELD_TYPES[kind]) for i, kind in enumerate(later)]


def typed_lines(records: DataFrame, schema: RecordSchema, **letters: str) -> DataFrame:
    """Lines of several types in one pass: line_no, line_type, object_id, group_id and one struct column
    (``f0``, ``f1`` ...) for each ``name=letter``, null in lines of other types.

    Where ``records`` has a ``group_line``, a column with the group type's letter holds the fields of the
    line's group in every line. Lines of types not named are left out.
    """
    kind, group = F.col("line_type"), schema.letter(GROUP)
    carried = "group_line" in records.columns
    limit = F.lit(2)
    for letter in letters.values():
        limit = F.when(kind == letter, _leading(schema, letter) + 3).otherwise(limit)
    # Cut once per line; the fields are taken from the words in a projection of their own.
    cut = records.where(kind.isin(*letters.values())).withColumn("_words", F.split("value", " ", limit))
    if carried and group:
        cut = cut.withColumn("_group_words", F.split("group_line", " ", _leading(schema, group) + 3))
    columns = []
    for name, letter in letters.items():
        from_group = carried and letter == group
        words, present = (F.col("_group_words"), F.col("_group_words").isNotNull()) if from_group else (F.col("_words"), kind == letter)
        fields = [c.alias(f"f{i}") for i, c in enumerate(_fields(schema, letter, words))]
        columns.append(F.when(present, F.struct(*fields)).alias(name))
    return cut.select("line_no", "line_type", "object_id", "group_id", *columns)


def objects(records: DataFrame, schema: RecordSchema, **letters: str) -> DataFrame:
    """One row per object: object_id, group_id, line_no of its own line, and the struct of its first line of each
    named type (null where it has none; with ``group_line`` also of its group's line).

    Lines before the first object are left out. Lines of one object meet in one shuffle on object_id, combined
    map-side, as they lie together in the file.
    """
    opened, group = schema.letter(OBJECT), schema.letter(GROUP)
    if group in letters.values() and "group_line" not in records.columns:
        raise ValueError("fields of the group need records with a group_line")
    wanted = letters if opened in letters.values() else {**letters, "_object": opened}
    # A group's own line counts under the object before it.
    lines = typed_lines(records.where(~F.col("line_type").eqNullSafe(group)), schema, **wanted).where(F.col("object_id") > 0)
    first = [F.min_by(name, F.when(F.col(name).isNotNull(), F.col("line_no"))).alias(name) for name in letters]
    own = F.col("line_type") == opened
    return lines.groupBy("object_id").agg(
        F.min(F.when(own, F.col("group_id"))).alias("group_id"), F.min(F.when(own, F.col("line_no"))).alias("line_no"), *first
    )


def parse_lines(records: DataFrame, schema: RecordSchema, letter: str) -> DataFrame:
    """Lines of one type with fields ``f0``, ``f1`` ...; text after the fields is a comment."""
    names = [f"f{i}" for i in range(len(schema.lines[letter].fields))]
    typed = typed_lines(records.drop("group_line"), schema, _line=letter)
    return typed.select("line_no", "object_id", "group_id", *[F.col("_line")[name].alias(name) for name in names])


def format_line(letter: str, kinds: tuple[str, ...], columns: list[Column]) -> Column:
    """One data line from its field columns."""
    parts: list[Column] = [F.lit(letter)]
    for kind, column in zip(kinds, columns):
        if kind in ("INT", "REAL", "CHAR"):
            parts.append(column.cast("string"))
        elif kind in ("STRING", "DNA"):
            parts += [F.length(column).cast("string"), column]
        elif kind == "STRING_LIST":
            prefixed = F.transform(column, lambda s: F.concat(F.length(s).cast("string"), F.lit(" "), s))
            parts += [F.size(column).cast("string"), F.array_join(prefixed, " ")]
        else:
            parts += [F.size(column).cast("string"), F.array_join(column.cast("array<string>"), " ")]
    text = parts[0]
    for part in parts[1:]:
        text = F.concat(text, F.lit(" "), part)
    return F.regexp_replace(text, " $", "") if kinds and kinds[-1].endswith("_LIST") else text


def list_size(records: DataFrame, schema: RecordSchema) -> DataFrame:
    """Add ``size``: list length of each line (bytes of text for string lists), else 0."""
    size = F.lit(0)
    for letter, line in schema.lines.items():
        at = next((i for i, kind in enumerate(line.fields) if kind in LIST_FIELDS), None)
        if at is None:
            continue
        n = F.element_at(F.split("value", " "), F.lit(at + 2)).cast("bigint")
        if line.fields[at] == "STRING_LIST":
            rest = F.regexp_replace("value", r"^(\S+ ){%d}" % (at + 2), "")
            n = F.aggregate(_string_list(rest, n.cast("int"))["items"], F.lit(0).cast("bigint"), lambda a, s: a + F.length(s))
        size = F.when(F.col("line_type") == letter, n).otherwise(size)
    return records.withColumn("size", size.cast("bigint"))


def line_counts(records: DataFrame, schema: RecordSchema) -> DataFrame:
    """Per line type: count, longest and total list, and the most of each within one group.

    Group maxima come from a first aggregate per (type, group), so a large group
    is combined map-side.
    """
    sized = list_size(records, schema)
    per_group = sized.groupBy("line_type", "group_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum("size").alias("total"), F.max("size").alias("longest")
    )
    in_group = (F.col("group_id") > 0) & F.col("line_type").rlike("[A-Z]")
    return per_group.groupBy("line_type").agg(
        F.sum("n").alias("n"),
        F.max("longest").alias("longest"),
        F.sum("total").alias("total"),
        F.coalesce(F.max(F.when(in_group, F.col("n"))), F.lit(0)).alias("group_n"),
        F.coalesce(F.max(F.when(in_group, F.col("total"))), F.lit(0)).alias("group_total"),
    )


def goto_object(records: DataFrame, i: int) -> DataFrame:
    """The lines of object ``i`` (from 1)."""
    return records.where(F.col("object_id") == i)


def goto_group(records: DataFrame, i: int) -> DataFrame:
    """The lines of group ``i`` (from 1)."""
    return records.where(F.col("group_id") == i)


def index_path(path: str) -> str:
    """Where the index of a folder of part files lies; readers of the folder pass over it."""
    return f"{path.rstrip('/')}/_index"


def _stamps(spark: SparkSession, files: str | list[str]) -> DataFrame:
    """Size and time of each file, without its content."""
    found = spark.read.format("binaryFile").load(files)
    return found.select(F.col("_metadata.file_path").alias("_file"), F.col("length").alias("_bytes"), F.col("modificationTime").alias("_time"))


def write_index(spark: SparkSession, path: str, schema: RecordSchema | None = None, index: str | None = None) -> None:
    """Index of a folder of record files: for each part file the lines, objects and groups before it and in it, and the
    group line that holds at its start. One scan; one row per file."""
    schema = schema or embedded_schema(spark, path)
    counts, carried = _parser_state(schema)
    splits = split_totals(_data_lines(read_lines(spark, path), schema), counts, carried)
    last = [F.max_by(n, F.when(F.col(n).isNotNull(), F.col("_block"))).alias(n) for n in carried]
    files = splits.groupBy("_file").agg(*[F.sum(n).alias(n) for n in counts], *last)
    before = W.orderBy("_file").rowsBetween(W.unboundedPreceding, -1)
    at = [F.coalesce(F.sum(n).over(before), F.lit(0)).alias(n) for n in counts] + [F.last(n, ignorenulls=True).over(before).alias(n) for n in carried]
    ends = [F.sum(n).over(W.orderBy("_file")).alias(f"last_{n}") for n in counts]
    table = files.select("_file", *at, *ends).join(_stamps(spark, path), "_file")
    table.orderBy("_file").write.mode("overwrite").parquet(index or index_path(path))


def read_indexed(
    spark: SparkSession,
    path: str,
    object_id: int | None = None,
    group_id: int | None = None,
    schema: RecordSchema | None = None,
    index: str | None = None,
) -> DataFrame:
    """Lines of one object or one group (from 1), as ``read_records`` gives them with the group line.

    Only part files that hold lines of it are opened; their names come from the index, read with a
    pushed filter. A part file changed since then is an error. An id that is not there gives no rows.
    """
    schema = schema or embedded_schema(spark, path)
    name, i = ("object_id", object_id) if object_id is not None else ("group_id", group_id)
    table = spark.read.parquet(index or index_path(path)).where((F.col(name) <= i) & (F.col(f"last_{name}") >= i))
    rows = table.select("_file", "_bytes", "_time").collect()
    if not rows:
        return spark.createDataFrame([], "line_no long, line_type string, value string, object_id long, group_id long, group_line string")
    files = [row._file for row in rows]
    if sorted(_stamps(spark, files).collect()) != sorted(rows):
        raise ValueError(f"{path} has changed since its index was written")
    lines = _placed_records(read_lines(spark, files), schema, True, table)
    return lines.where(F.col(name) == i)


def _sized(text: str) -> str:
    return f"{len(text)} {text}"


def header_lines(schema: RecordSchema, header: Header, counts: list[Row] | None = None, subtype: str = "") -> list[str]:
    """Header text; ``counts`` has one row per line type."""
    out = [f"1 {_sized(schema.file_type)} {MAJOR} {MINOR}"]
    if subtype:
        out.append(f"2 {_sized(subtype)}")
    out += [f"{PROVENANCE} 4 " + " ".join(map(_sized, entry)) for entry in header.provenance] + [SPACER]
    links = [f"{REFERENCE} {_sized(name)} {n}" for name, n in header.references]
    links += [f"{DEFERRED} {_sized(name)}" for name in header.deferred]
    out += links + [SPACER] if links else []
    rank = {GROUP: 0, OBJECT: 1, DATA: 2}
    for letter, line in sorted(schema.lines.items(), key=lambda item: (rank[item[1].kind], item[0])):
        out.append(f"{SCHEMA_LINE} {line.kind} {letter} {len(line.fields)}" + "".join(f" {_sized(f)}" for f in line.fields))
    out.append(SPACER)
    group = schema.letter(GROUP)
    for row in sorted(counts or [], key=lambda row: row.line_type):
        out.append(f"# {row.line_type} {row.n}")
        for mark, value in (("@", row.longest), ("+", row.total)):
            out += [f"{mark} {row.line_type} {value}"] if value else []
        for mark, value in (("#", row.group_n), ("+", row.group_total)):
            out += [f"% {group} {mark} {row.line_type} {value}"] if value else []
    return out


def write_records(
    lines: DataFrame,
    order: list[str],
    schema: RecordSchema,
    path: str,
    header: Header = Header(),
    gzip: bool = False,
    lines_per_file: int | None = None,
) -> None:
    """Write data lines (``value``, ``order`` columns, ``group_id``) behind a full header.

    ``lines_per_file`` bounds the part files (about), so that an index can lead to small ones.
    """
    typed = lines.withColumn("line_type", F.substring("value", 1, 1))
    spark = lines.sparkSession
    counts = line_counts(typed, schema).collect()
    head = header_lines(schema, header, counts)
    files = -(-sum(row.n for row in counts) // lines_per_file) if lines_per_file else 0
    body = lines.select(F.lit(1).alias("_body"), F.lit(0).alias("_head"), F.col("value"), *order)
    empty = [F.lit(None).cast(lines.schema[c].dataType).alias(c) for c in order]
    rows = spark.range(1).select(F.posexplode(F.array(*[F.lit(line) for line in head])).alias("_head", "value"))
    top = rows.select(F.lit(0).alias("_body"), "_head", "value", *empty)
    write_lines(top.unionByName(body), ["_body", "_head", *order], path, gzip, files)


def read_header(spark: SparkSession, path: str) -> Header:
    """Provenance, reference and deferred entries (driver-side, a few rows)."""
    provenance, references, deferred = [], [], []
    for line in _header_text(spark, path):
        if line[:2] not in (f"{PROVENANCE} ", f"{REFERENCE} ", f"{DEFERRED} "):
            continue
        mark, rest = line[0], line[2:]
        if mark == PROVENANCE:
            rest, items = rest.split(" ", 1)[1], []
            while rest:
                size, tail = rest.split(" ", 1)
                items.append(tail[: int(size)])
                rest = tail[int(size) + 1 :]
            provenance.append(tuple(items))
        else:
            size, tail = rest.split(" ", 1)
            name = tail[: int(size)]
            if mark == DEFERRED:
                deferred.append(name)
            else:
                references.append((name, int(tail[int(size) + 1 :])))
    return Header(tuple(provenance), tuple(references), tuple(deferred))


# Line types of a sequence file.
SEQUENCE_SCHEMA = parse_schema(
    """P 3 seq
S 3 irp
S 3 pbr
S 3 10x
S 3 ctg
S 3 kmr
G g 2 3 INT 6 STRING
O S 1 3 DNA
D I 1 6 STRING
D Q 1 6 STRING
"""
)["seq"]


def sequence_lines(reads: DataFrame) -> DataFrame:
    """``read_id``, ``part`` and ``value``: sequence, name and quality lines of each read."""
    has_quality = "qual" in reads.columns
    lines = [
        F.struct(F.lit(0).alias("part"), format_line("S", ("DNA",), [F.col("seq")]).alias("value")),
        F.struct(F.lit(1).alias("part"), format_line("I", ("STRING",), [F.col("name")]).alias("value")),
    ]
    if has_quality:
        quality = quality_text(F.col("qual"), F.length("seq"))
        lines.append(F.struct(F.lit(2).alias("part"), format_line("Q", ("STRING",), [quality]).alias("value")))
    return reads.select("read_id", F.inline(F.array(*lines))).withColumn("group_id", F.lit(0))


def write_sequence_records(reads: DataFrame, path: str, gzip: bool = False, header: Header = Header()) -> None:
    write_records(sequence_lines(reads), ["read_id", "part"], SEQUENCE_SCHEMA, path, header, gzip)


def read_sequence_records(spark: SparkSession, path: str) -> DataFrame:
    schema = embedded_schema(spark, path)
    names = {name: letter for name, letter in {"S": "S", "I": "I", "Q": "Q"}.items() if letter in schema.lines}
    reads = objects(read_records(spark, path, schema), schema, **names)
    text = {name: F.col(name)["f0"] if name in names else F.lit(None).cast("string") for name in "SIQ"}
    return reads.select(
        F.col("object_id").alias("read_id"),
        F.coalesce(text["I"], F.lit("")).alias("name"),
        F.lit("").alias("desc"),
        text["S"].alias("seq"),
        quality_values(text["Q"]).alias("qual"),
    )
