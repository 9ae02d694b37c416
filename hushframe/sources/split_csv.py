"""Delimited text files whose records are cut in parallel, also where quoted fields hold line ends.

Whether a line begins inside a quoted field depends on all lines before it. But a line can do only one of four things to
that state: leave it, turn it over, end inside or end outside. Such effects can be chained, so every split of a file is
read on its own: a first pass chains the effects of its lines into one and counts the records that would begin in it, for
either state at its start; one row per split then tells the state and the record number at which each split begins; and
a second pass cuts records. A record that crosses the border of splits is put together from its pieces.

The lines never move for that: both passes follow the order of the scan. What they need besides is broadcast, one row
for each split of the scan; beyond `SPLITS` of them the lines are dealt out by split instead.

Records that do not fit their table (surplus or missing fields, bytes that are no UTF-8, a quote that never closes) are
listed whole beside it, so that nothing in them goes unseen.
"""

from __future__ import annotations

import csv
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hushframe.functions.text import na_to_null, once
from hushframe.sources.delimited import DELIMITERS, HEAD_LINES
from hushframe.storage import estimated_bytes, gathered, written

#: Up to so many splits are broadcast, one row each.
SPLITS = 100_000
#: Records with more fields than this are not parsed, only listed.
MOST_FIELDS = 20_000
REASONS = ("surplus_fields", "missing_fields", "undecodable", "unclosed_quote")
PATH, ROW_INDEX = "_path", "_row_idx"


def scan_lines(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """(path, start, id, line) of each line that ends in a newline: `start` names the split, `id` orders its lines.

    A carriage return stays at the end of its line, and bytes that are no UTF-8 stay as they are. A task reads many splits
    if they are small.
    """
    lines = spark.read.option("lineSep", "\n").text(paths if isinstance(paths, str) else list(paths))
    named = lines.select(
        F.regexp_replace("_metadata.file_path", "^file:(?=/)(//)?", "").alias("path"), F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("id"), F.col("value").alias("line"),
    )
    # Ids are made below, so that they do not depend on which splits a task gets.
    return gathered(named, estimated_bytes(lines))


def beside_splits(lines: DataFrame, per_split: DataFrame) -> DataFrame:
    """The lines with the columns of their split, still in the order of the scan."""
    if per_split.count() <= SPLITS:
        return lines.join(F.broadcast(per_split), ["path", "start"])
    return lines.join(per_split, ["path", "start"]).sortWithinPartitions("path", "start", "id")


def _ends_inside(text: Column, delimiter: str) -> Column:
    """Whether a line that begins outside quotes ends inside. Doubled quotes, which change nothing, are gone already.

    Only a quote at the start of a field opens it; any other one is a plain character.
    """
    sep = "\\" + delimiter if delimiter == "|" else delimiter
    plain = F.regexp_replace(text, rf'(^|{sep})"[^"]*"(?={sep}|\r?$)', "$1")
    return plain.rlike(rf'(?:^|{sep})"[^"]*$')


def effects(line: Column, delimiter: str) -> tuple[Column, Column]:
    """Whether a line ends inside a quoted field if it begins outside one, and if it begins inside one."""
    single = F.replace(line, F.lit('""'), F.lit(""))
    rest = F.concat(F.lit("x"), F.substring(single, F.instr(single, '"') + 1, F.length(single)))
    quoted = F.contains(line, F.lit('"'))
    from_outside = F.when(quoted, _ends_inside(single, delimiter)).otherwise(False)
    from_inside = F.when(F.contains(single, F.lit('"')), _ends_inside(rest, delimiter)).otherwise(True)
    return from_outside, from_inside


def states_before(outside: np.ndarray, inside: np.ndarray, state: bool) -> tuple[np.ndarray, bool]:
    """The state before each line, and after the last one, if the first begins in `state`: the chained effects."""
    fixed, turns = outside == inside, outside & ~inside
    count = len(fixed)
    turned = np.append(0, np.cumsum(turns))
    last = np.maximum.accumulate(np.append(-1, np.where(fixed, np.arange(count), -1)))
    since = turned - np.where(last >= 0, turned[last + 1], 0)
    value = np.where(last >= 0, outside[last] if count else False, state)
    states = value ^ (since % 2 == 1)
    return states[:-1], bool(states[-1])


def _flags(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).to_numpy(zero_copy_only=False).astype(bool)


def _runs(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The parts of a batch that belong to one split each."""
    split = batch.column("split").to_numpy()
    cuts = [0, *(np.flatnonzero(split[1:] != split[:-1]) + 1).tolist(), len(split)]
    for a, b in zip(cuts, cuts[1:], strict=False):
        if b > a:
            yield batch.slice(a, b - a)


def _chained(lines: DataFrame) -> DataFrame:
    """(path, start, states, starts) of each split, for a beginning outside and inside: the state at its end, the records
    that begin in it."""
    names = ["path", "start", "end_0", "end_1", "starts_0", "starts_1"]
    kinds = (pa.string(), pa.int64(), pa.bool_(), pa.bool_(), pa.int64(), pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, place, state, starts = None, (), [False, True], [0, 0]

        def made(done: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([row[i] for row in done], k) for i, k in enumerate(kinds)], names)

        for batch in batches:
            done = []
            for part in _runs(batch):
                own = part.column("split")[0].as_py()
                if split != own:
                    if split is not None:
                        done.append((*place, *state, *starts))
                    split, place = own, (part.column("path")[0].as_py(), part.column("start")[0].as_py())
                    state, starts = [False, True], [0, 0]
                outside, inside, blank = (_flags(part, c) for c in ("outside", "inside", "blank"))
                for k in (0, 1):
                    before, state[k] = states_before(outside, inside, state[k])
                    starts[k] += int((~before & ~blank).sum())
            if done:
                yield made(done)
        if split is not None:
            yield made([(*place, *state, *starts)])

    flags = lines.select(F.xxhash64("path", "start").alias("split"), "path", "start", "outside", "inside", "blank")
    return flags.mapInArrow(run, "path string, start long, end_0 boolean, end_1 boolean, starts_0 long, starts_1 long")


def _beginnings(per_split: DataFrame) -> DataFrame:
    """(path, start, begin, number, last): state and record number at which each split begins, and whether it ends its file.

    A file's splits are folded in order: one small row for each of them.
    """
    splits = F.sort_array(F.collect_list(F.struct("start", "end_0", "end_1", "starts_0", "starts_1")))
    first = F.struct(F.lit(False).alias("state"), F.lit(0).cast("long").alias("number"), F.expr("cast(array() as array<struct<start:bigint,begin:boolean,number:bigint>>)").alias("out"))

    def step(at: Column, one: Column) -> Column:
        here = F.struct(one["start"].alias("start"), at["state"].alias("begin"), at["number"].alias("number"))
        return F.struct(
            F.when(at["state"], one["end_1"]).otherwise(one["end_0"]).alias("state"),
            (at["number"] + F.when(at["state"], one["starts_1"]).otherwise(one["starts_0"])).alias("number"),
            F.concat(at["out"], F.array(here)).alias("out"),
        )

    folded = per_split.groupBy("path").agg(F.aggregate(splits, first, step)["out"].alias("out"), F.max("start").alias("end"))
    return folded.select("path", "end", F.inline("out")).select("path", "start", "begin", "number", (F.col("start") == F.col("end")).alias("last"))


def _cut(lines: DataFrame) -> DataFrame:
    """(split, record_no, record, head, open): records and pieces of records; `head` has the beginning, `open` no end."""
    names = ["split", "record_no", "record", "head", "open"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, state, number, held = None, False, 0, []

        def rest() -> pa.RecordBatch:
            """What is left at the end of a split: its last record, or what the split before has begun."""
            piece, head = b"\n".join(held[1:]), held[0]
            return pa.RecordBatch.from_arrays([pa.array([x]) for x in (split, number - 1, piece, head, state)], names)

        for batch in batches:
            for part in _runs(batch):
                if split != part.column("split")[0].as_py():
                    if held:
                        yield rest()
                    split, state, number = (part.column(c)[0].as_py() for c in ("split", "begin", "number"))
                    held = [False] if state else []
                outside, inside, blank = (_flags(part, c) for c in ("outside", "inside", "blank"))
                before, state = states_before(outside, inside, state)
                lines_in = part.column("line")
                starts = ~before & ~blank
                kept = starts | before
                if not kept.all():
                    lines_in, starts = lines_in.filter(pa.array(kept)), starts[kept]
                heads = np.flatnonzero(starts)
                if not len(heads):
                    held += lines_in.to_pylist()
                    continue
                if held:
                    piece = [*held[1:], *lines_in.slice(0, int(heads[0])).to_pylist()]
                    yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (split, number - 1, b"\n".join(piece), held[0], False)], names)
                # All but the last record of the batch are whole.
                cuts = pa.array(heads.astype(np.int32))
                whole = pc.binary_join(pa.ListArray.from_arrays(cuts, lines_in), b"\n")
                count = len(heads) - 1
                columns = [np.full(count, split), np.arange(number, number + count), whole, np.ones(count, bool), np.zeros(count, bool)]
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names)
                number += len(heads)
                held = [True, *lines_in.slice(int(heads[-1])).to_pylist()]
        if held:
            yield rest()

    columns = lines.select(F.xxhash64("path", "start").alias("split"), "begin", "number", "outside", "inside", "blank", F.col("line").cast("binary").alias("line"))
    return columns.mapInArrow(run, "split long, record_no long, record binary, head boolean, open boolean")


def csv_records(spark: SparkSession, paths: str | Sequence[str], delimiter: str = ",") -> DataFrame:
    """(path, record_no, record, closed) of all records: the header has number 0. Written once, read by whoever needs it.

    Blank lines between records are no records. Line ends inside a field stay; `closed` is false where a quoted field has
    no end, so that it holds the rest of its file. Files without a record are absent.
    """
    lines = scan_lines(spark, paths)
    outside, inside = effects(F.col("line"), delimiter)
    marked = lines.select("*", outside.alias("outside"), inside.alias("inside"), F.rtrim(F.col("line"), F.lit("\r")).isin("").alias("blank"))
    begins = written(_beginnings(_chained(marked)), "split-states")
    pieces = gathered(written(_cut(beside_splits(marked, begins)), "csv-pieces"))
    named = begins.select(F.xxhash64("path", "start").alias("split"), "path", "start", "last")
    placed = pieces.join(F.broadcast(named) if begins.count() <= SPLITS else named, "split")
    whole = placed.filter("head and not open").select("path", "record_no", "record", F.lit(True).alias("closed"))
    ordered = F.sort_array(F.collect_list(F.struct("start", "record", (F.col("last") & F.col("open")).alias("never"))))
    crossing = placed.filter("not (head and not open)").groupBy("path", "record_no").agg(ordered.alias("parts"))
    joined = F.aggregate(
        F.slice("parts", 2, F.size("parts")), F.get("parts", F.lit(0))["record"], lambda text, part: F.concat(text, F.lit("\n").cast("binary"), part["record"])
    )
    crossing = crossing.select("path", "record_no", joined.alias("record"), (~F.exists("parts", lambda p: p["never"])).alias("closed"))
    text = F.rtrim(F.col("record").cast("string"), F.lit("\r"))
    no_mark = F.when((F.col("record_no") == 0) & F.startswith(text, F.lit("\ufeff")), F.substring(text, 2, F.length(text))).otherwise(text)
    return whole.unionByName(crossing).select("path", "record_no", no_mark.alias("record"), "closed")


def field_count(record: Column, delimiter: str) -> Column:
    """Fields of a record: delimiters outside quotes, and one."""
    plain = F.when(F.contains(record, F.lit('"')), F.regexp_replace(record, '"[^"]*"', "")).otherwise(record)
    return F.length(plain) - F.length(F.replace(plain, F.lit(delimiter), F.lit(""))) + 1


def _delimiter_of(records: DataFrame) -> DataFrame:
    """(path, delimiter): the one whose count is the same in the most head records of a file."""
    counts = F.array(*[F.struct(F.lit(i).alias("preference"), F.lit(d).alias("delimiter"), (field_count(F.col("record"), d) - 1).alias("n")) for i, d in enumerate(DELIMITERS)])
    per_file = (
        records.filter(F.col("record_no") < HEAD_LINES).select("path", F.inline(counts)).groupBy("path", "preference", "delimiter")
        .agg(F.mode("n", deterministic=True).alias("usual"), F.variance("n").alias("spread"))
    )
    rank = Window.partitionBy("path").orderBy(F.desc(F.col("usual") > 0), F.coalesce("spread", F.lit(0.0)), F.desc("usual"), "preference")
    return per_file.withColumn("rank", F.row_number().over(rank)).filter("rank = 1").select("path", "delimiter")


@dataclass
class SplitTable:
    """`rows` has `_path` and `_row_idx` (from 0, in file order) and every column of the header as text; `quarantine` has
    (path, row_idx, reasons, record) of the records that do not fit, of which the header has -1. `paths` are the files."""

    delimiter: str
    header: str
    paths: list[str]
    rows: DataFrame
    quarantine: DataFrame


def column_names(fields: Sequence[str]) -> list[str]:
    """Empty names are `_c0`, `_c1`, ...; a name that comes again, whatever its case, gets its position behind it."""
    lower = [f.lower() for f in fields]
    return [f"_c{i}" if not f else f if lower.count(f.lower()) == 1 else f"{f}{i}" for i, f in enumerate(fields)]


def _table(records: DataFrame, delimiter: str, header: str, paths: list[str], na_values: bool) -> SplitTable:
    """The files of one header. An unclosed quote spoils its record, and a damaged name its column: both are listed."""
    names = column_names(next(csv.reader([header], delimiter=delimiter), [""]))
    count = field_count(F.col("record"), delimiter)
    shape = ", ".join([*(f"c{i} string" for i in range(len(names))), "_whole string"])
    options = {"sep": delimiter, "quote": '"', "escape": '"', "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_whole", "maxColumns": str(MOST_FIELDS + 480)}
    valid = F.is_valid_utf8("record")
    record = F.when(valid, F.col("record")).otherwise(F.make_valid_utf8("record"))
    parsed = records.select(
        "path", "record_no", "closed", record.alias("record"), valid.alias("valid"), count.alias("fields"),
        F.from_csv(F.when(count <= MOST_FIELDS, record), shape, options).alias("row"),
    )
    body = parsed.filter("record_no > 0")
    value = (lambda c: na_to_null(c)) if na_values else (lambda c: c)
    rows = body.select(F.col("path").alias(PATH), (F.col("record_no") - 1).alias(ROW_INDEX), *[value(F.col("row")[f"c{i}"]).alias(n) for i, n in enumerate(names)])
    # The quarantine tests a record many times over: what it tests comes from a generator, which runs once.
    tested = records.select("path", "record_no", "closed", once(record=record, valid=valid, fields=count))
    whole = F.from_csv(F.when(F.col("fields") <= MOST_FIELDS, F.col("record")), shape, options)["_whole"]
    tested = tested.select("path", "record_no", "closed", "record", "valid", "fields", once(damaged=whole.isNotNull()))
    misfit = (F.col("record_no") > 0) & (F.col("damaged") | (F.col("fields") > MOST_FIELDS) | (F.col("fields") != len(names)))
    tests = (misfit & (F.col("fields") > len(names)), misfit & (F.col("fields") <= len(names)), ~F.col("valid"), ~F.col("closed"))
    reasons = F.array_compact(F.array(*[F.when(t, F.lit(r)) for t, r in zip(tests, REASONS, strict=True)]))
    listed = tested.select("path", (F.col("record_no") - 1).alias("row_idx"), "record", once(reasons=reasons))
    listed = listed.select("path", "row_idx", "reasons", "record").filter(F.size("reasons") > 0)
    return SplitTable(delimiter, header, paths, rows, listed)


def read_split_tables(
    spark: SparkSession, paths: Sequence[str], always: bool = False, na_values: bool = True, records: DataFrame | None = None
) -> list[SplitTable]:
    """One table per (delimiter, header record) in use, in their order; only files with the same header are read together.

    A file is read with commas unless some record has more fields than its header then; such a file, or with `always`
    every one, gets the delimiter that its first records hold most regularly. If even that one leaves surplus fields, the
    records with them are in the quarantine. Files without a record are in no table. The list of files passes through the
    driver, as in every scan, but not their content.
    """
    if not paths:
        return []
    found = csv_records(spark, paths) if records is None else records
    fields = field_count(F.col("record"), ",")
    first = F.when(F.col("record_no") == 0, fields)
    files = found.groupBy("path").agg(F.max(fields).alias("most"), F.max(first).alias("own"))
    other = files.filter(F.lit(True) if always else F.col("most") > F.col("own")).select("path").join(_delimiter_of(found), "path")
    headers = found.filter("record_no = 0").join(other, "path", "left").select("path", F.coalesce("delimiter", F.lit(",")).alias("delimiter"), "record")
    by_group = headers.groupBy("delimiter", "record").agg(F.sort_array(F.collect_list("path")).alias("paths")).collect()
    recut = {}
    for d in sorted({r["delimiter"] for r in by_group} - {","}):
        recut[d] = csv_records(spark, sorted(p for r in by_group if r["delimiter"] == d for p in r["paths"]), d)
    tables = {}
    for r in by_group:
        # With another delimiter, another part of the text may be the first record.
        if r["delimiter"] in recut:
            own = recut[r["delimiter"]].filter((F.col("record_no") == 0) & F.col("path").isin(r["paths"]))
            groups = own.groupBy("record").agg(F.sort_array(F.collect_list("path")).alias("paths")).collect()
            for g in groups:
                tables.setdefault((r["delimiter"], g["record"]), []).extend(g["paths"])
        else:
            tables[",", r["record"]] = r["paths"]
    made = []
    for (delimiter, header), own in sorted(tables.items()):
        source = recut.get(delimiter, found)
        files_of = spark.createDataFrame([(p,) for p in sorted(own)], "path string")
        made.append(_table(source.join(F.broadcast(files_of), "path"), delimiter, header, sorted(own), na_values))
    return made
