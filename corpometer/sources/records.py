"""CSV records from files of any size, cut into byte ranges that are read by as many tasks.

A line break inside quotes belongs to its cell, so a range cannot tell from its own bytes whether it begins inside
a cell. Each range is therefore read under both assumptions: what the cell state is at its end if it begins outside
quotes, and what if inside. Put one after the other, these give the state at the start of every range, and with it
each range is cut into records by itself. A record that runs over the end of a range is put together from the ends
of the ranges it touches.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from corpometer.session import stored

BATCH_CHARS = 2_000_000
RANGES = 1_000_000  # twenty bytes each: what is broadcast stays small


def lines_of(spark: SparkSession, paths: str | Sequence[str], encoding: str = "UTF-8") -> DataFrame:
    """(file, begin, line): every line and the start of the byte range it was read from.

    Lines end in a line feed; a carriage return before it is still part of the line. A range is what Spark makes
    of ``spark.sql.files.maxPartitionBytes``; a compressed file is one.
    """
    lines = spark.read.option("lineSep", "\n").text(paths if isinstance(paths, str) else list(paths))
    raw = F.col("value").cast("binary")
    text = F.col("value") if encoding.upper() in ("UTF-8", "UTF8") else F.decode(raw, encoding)
    return lines.select(
        F.xxhash64("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("begin"),
        text.cast("binary").alias("line"),
    )


def state_after(line: str, inside: bool) -> bool:
    """Whether a cell is open at the end of a line, if one was open (or not) at its start.

    A quote opens a cell at its very start only and two quotes in it stand for one; whatever else follows a closing
    quote up to the next comma is part of the cell.
    """
    at = 0
    while True:
        if inside:
            at = line.find('"', at)
            if at < 0:
                return True
            if line.startswith('"', at + 1):
                at += 2
                continue
            inside = False
        elif line.startswith('"', at):
            at, inside = at + 1, True
            continue
        at = line.find(",", at) + 1
        if at == 0:
            return False


def cells_of(record: str) -> int:
    """Number of cells of a record."""
    if '"' not in record:
        return record.count(",") + 1
    at, cells, inside = 0, 1, False
    while True:
        if inside:
            at = record.find('"', at)
            if at < 0:
                return cells
            if record.startswith('"', at + 1):
                at += 2
                continue
            inside = False
        elif record.startswith('"', at):
            at, inside = at + 1, True
            continue
        at = record.find(",", at) + 1
        if at == 0:
            return cells
        cells += 1


def _ranges(batches: Iterator[pa.RecordBatch], keys: Sequence[str]) -> Iterator[tuple[tuple, list[bytes | None], bool]]:
    """(values of the keys, lines, whether they begin the range): the lines of a range, a batch at most at a time."""
    last = None
    for batch in batches:
        place = batch.column("file").to_numpy(zero_copy_only=False), batch.column("begin").to_numpy(zero_copy_only=False)
        turns = np.flatnonzero((np.diff(place[0]) != 0) | (np.diff(place[1]) != 0)) + 1
        for low, high in zip([0, *turns.tolist()], [*turns.tolist(), batch.num_rows], strict=True):
            if low < high:
                key = tuple(batch.column(n)[low].as_py() for n in keys)
                yield key, batch.column("line").slice(low, high - low).to_pylist(), key[:2] != last
                last = key[:2]


def _effects(lines: DataFrame) -> DataFrame:
    """(file, begin, if_out, if_in, closes): the state at a range's end for either state at its start.

    ``closes`` tells whether a record that is open at the start ends in the range.
    """
    names = ["file", "begin", "if_out", "if_in", "closes"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row: list = []
        for key, values, begins in _ranges(batches, names[:2]):
            if begins:
                if row:
                    yield pa.RecordBatch.from_arrays([pa.array([v]) for v in row], names=names)
                row = [*key, False, True, False]
            for line in values:
                if line is not None:
                    text = line.decode("utf-8", "replace")
                    row[2], row[3] = state_after(text, row[2]), state_after(text, row[3])
                    row[4] = row[4] or not row[3]
        if row:
            yield pa.RecordBatch.from_arrays([pa.array([v]) for v in row], names=names)

    # A line without a quote leaves the state as it is and need not be sent; its range must be seen, though.
    sent = F.when(F.contains("line", F.lit(b'"')), F.col("line")).alias("line")
    return lines.select("file", "begin", sent).mapInArrow(run, "file long, begin long, if_out boolean, if_in boolean, closes boolean")


def _starts(effects: DataFrame) -> DataFrame:
    """(file, begin, inside, opener): the state at each range's start, and the range where the open record began.

    A range does one of four things to the state: keep it, turn it, open it, close it. What counts is the last
    range that sets it and the number of turns since. A file has one short row for each of its ranges here.
    """
    along = Window.partitionBy("file").orderBy("begin")
    upto, before = along.rowsBetween(Window.unboundedPreceding, 0), along.rowsBetween(Window.unboundedPreceding, -1)
    rows = effects.withColumn("turns", F.sum((F.col("if_out") & ~F.col("if_in")).cast("int")).over(upto))
    sets = F.when(F.col("if_out") == F.col("if_in"), F.struct(F.col("if_out").cast("int").alias("to"), "turns"))
    rows = rows.withColumns({"last": F.last(sets, ignorenulls=True).over(before), "turned": F.coalesce(F.lag("turns").over(along), F.lit(0))})
    state = F.coalesce(F.col("last.to"), F.lit(0)) + F.col("turned") - F.coalesce(F.col("last.turns"), F.lit(0))
    rows = rows.withColumn("inside", state % 2 == 1)
    ends_open = F.when(F.col("inside"), F.col("if_in") & F.col("closes")).otherwise(F.col("if_out"))
    opener = F.last(F.when(ends_open, F.col("begin")), ignorenulls=True).over(before)
    return rows.select("file", "begin", "inside", F.when(F.col("inside"), opener).alias("opener"))


def _cut(lines: DataFrame, parts: bool) -> DataFrame:
    """Whole records of each range, or else the parts of those that run over its ends; (file, begin, part, record).

    ``begin`` is the range where the record begins. ``part`` is the range that a part is from, null for a whole
    record; the first part of a file's header has -1 there.
    """
    names = ["file", "begin", "part", "record"]
    types = (pa.int64(), pa.int64(), pa.int64(), pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        held, place, pieces, inside, opener, header = 0, None, [], False, None, False

        def flush() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], names=names)
            out.clear()
            return batch

        def left_open() -> None:
            if parts and pieces:
                begin = place[1] if opener is None else opener
                out.append((place[0], begin, -1 if header else place[1], "\n".join(pieces)))

        for key, values, begins in _ranges(batches, ["file", "begin", "inside", "opener"]):
            if begins:
                left_open()
                place, pieces, inside, opener, header = key[:2], [], key[2], key[3], key[1] == 0
            for line in values:
                text = line.decode("utf-8", "replace")
                inside = state_after(text, inside) if '"' in text else inside
                pieces.append(text)
                if inside:
                    continue
                record = "\n".join(pieces)
                if opener is not None:
                    if parts:
                        out.append((place[0], opener, place[1], record))
                elif record not in ("", "\r"):
                    if not parts and not header:
                        out.append((*place, None, record.removesuffix("\r")))
                        held += len(record)
                    header = False
                pieces, opener = [], None
                if held > BATCH_CHARS:
                    yield flush()
                    held = 0
        left_open()
        yield flush()

    return lines.mapInArrow(run, "file long, begin long, part long, record string")


def _joined(parts: DataFrame) -> DataFrame:
    """Whole records of the parts of records; a record has one part in each range that it touches."""
    ordered = F.sort_array(F.collect_list(F.struct("part", "record")))
    whole = parts.groupBy("file", "begin").agg(ordered.alias("parts")).where(F.col("parts")[0]["part"] >= 0)
    text = F.array_join(F.transform("parts", lambda p: p["record"]), "\n")
    return whole.select("file", "begin", F.regexp_replace(text, r"\r\z", "").alias("record"))


def records(spark: SparkSession, paths: str | Sequence[str], encoding: str = "UTF-8") -> DataFrame:
    """(file, begin, record) of all CSV records but the first of each file, which is its header.

    Empty lines between records are left out. Records end in a line feed or in a carriage return and a line feed;
    breaks inside quotes stay as they are. A file is read once for the states of its ranges, and then for the whole
    records and for those that run over the end of a range; nothing but a short row for each range is kept.
    """
    lines = lines_of(spark, paths, encoding)
    starts = stored(_starts(stored(_effects(lines), "effects")), "starts")
    if starts.count() > RANGES:
        raise ValueError(f"more than {RANGES:,} byte ranges: raise spark.sql.files.maxPartitionBytes")
    # Rows of a range must keep their order, so the ranges' states go to them and the lines stay where they are.
    placed = lines.join(F.broadcast(starts), ["file", "begin"])
    return _cut(placed, parts=False).select("file", "begin", "record").unionByName(_joined(_cut(placed, parts=True)))


def cell_count(record: Column) -> Column:
    """Number of cells of each record."""

    @F.pandas_udf("int")
    def count(texts: pd.Series) -> pd.Series:
        return texts.map(cells_of)

    return count(record)


def parsed(record: Column, schema: StructType) -> Column:
    """A record's cells as a struct; cells that are missing are null and those beyond the schema are left out."""
    fields = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in schema.fields)
    return F.from_csv(record, fields, {"quote": '"', "escape": '"', "multiLine": "true", "mode": "PERMISSIVE"})
