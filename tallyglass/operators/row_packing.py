"""Packing consecutive rows into chunks, in two passes whatever the data.

What a part of the rows does to a chunk that is open at its start depends on how full that chunk is alone, and a chunk
holds at most ``size`` characters.  So a task lists, for every possible fill on entry, the fill on exit and the number of
chunks opened.  The tables of all parts, one small row each, are followed from part to part in one step, and a second pass
writes the chunks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyglass.scale import durable, staged

CLOSED = 0  # the fill of a chunk that takes no further row, or of none
FRAGMENT = "file_id {file}, chunk_index bigint, part int, whole boolean, sheet string, row_start {row}, row_end {row}, text string"


@dataclass
class Rows:
    """A run of rows of one file: where the chunk that opens at each of them would end."""

    sheets: np.ndarray
    total: np.ndarray  # characters and line ends before each row, and after the last
    turn: int  # the first row of another sheet than the first row's
    ends: np.ndarray

    @staticmethod
    def of(sheets: np.ndarray, lengths: np.ndarray, size: int) -> Rows:
        n = len(sheets)
        total = np.concatenate(([0], np.cumsum(lengths.astype(np.int64) + 1)))
        turns = np.append(np.flatnonzero(sheets[1:] != sheets[:-1]) + 1, n)
        fits = np.searchsorted(total[1:], size + 1 + total[:-1], side="right")
        ends = np.minimum(np.maximum(fits, np.arange(1, n + 1)), turns[np.searchsorted(turns, np.arange(n), side="right")])
        return Rows(sheets, total, int(turns[0]), ends)

    def fill(self, start: int, size: int, before: int = 0) -> int:
        """Of a chunk that holds ``before`` and the rows from ``start`` on."""
        used = before + int(self.total[-1] - self.total[start])
        return used if used <= size else CLOSED

    def first_break(self, fills: np.ndarray, size: int) -> np.ndarray:
        """The row at which chunks so full on entry close; a closed one takes no row."""
        fits = np.searchsorted(self.total[1:], size + 1 - fills, side="right")
        return np.where(fills == CLOSED, 0, np.minimum(fits, self.turn))


def transition(rows: Rows, size: int) -> tuple[np.ndarray, np.ndarray]:
    """For every fill on entry (0 to ``size``) the fill on exit and the number of chunks opened."""
    n = len(rows.sheets)
    fills, opened, ends = [CLOSED] * n, [1] * n, rows.ends.tolist()
    for row in range(n - 1, -1, -1):
        if ends[row] < n:
            fills[row], opened[row] = fills[ends[row]], opened[ends[row]] + 1
        else:
            fills[row] = rows.fill(row, size)
    entry = np.arange(size + 1)
    at = rows.first_break(entry, size)
    through = entry + rows.total[-1]
    inside, row = at < n, np.minimum(at, n - 1)
    out = np.where(inside, np.array(fills)[row], np.where(through <= size, through, CLOSED))
    return out, np.where(inside, np.array(opened)[row], 0)


def _objects(column: pa.Array) -> np.ndarray:
    """Values with null as None, whatever their type: nulls are equal to each other."""
    return np.array(column.to_pylist() + [None], object)[:-1]


def _runs(files: np.ndarray) -> list[tuple[int, int]]:
    """Runs of equal files; null is a file like any other."""
    cuts = [0, *(np.flatnonzero(files[1:] != files[:-1]) + 1).tolist(), len(files)]
    return list(zip(cuts, cuts[1:]))


def _tables(parts: DataFrame, size: int) -> dict[int, dict]:
    """Per part: its first and last file and sheet, and what it does to the file that is open at its start."""
    def report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entry = np.arange(size + 1)
        first = file = sheet = None
        part, seen, single, kind = -1, False, True, None
        fills, opened = entry, np.zeros(size + 1, np.int64)
        for batch in batches:
            files, sheets = _objects(batch.column(1)), _objects(batch.column(2))
            lengths = batch.column(3).to_numpy()
            for a, b in _runs(files) if batch.num_rows else []:
                kind = batch.schema.field(1).type
                if not seen:
                    part, first, file, sheet, seen = batch.column(0)[0].as_py(), (files[a], sheets[a]), files[a], sheets[a], True
                if files[a] != file:
                    # From here on nothing depends on what came before: all fills are one.
                    file, sheet, single = files[a], sheets[a], False
                    fills, opened = np.zeros(size + 1, np.int64), np.zeros(size + 1, np.int64)
                if sheets[a] != sheet:
                    fills = np.zeros(size + 1, np.int64)
                out, more = transition(Rows.of(sheets[a:b], lengths[a:b], size), size)
                opened, fills, sheet = opened + more[fills], out[fills], sheets[b - 1]
        if seen:
            # Only as many entries as differ: a part that a chunk border settles has one.
            keep = np.flatnonzero(np.concatenate(([True], (np.diff(fills) != 0) | (np.diff(opened) != 0))))
            yield pa.RecordBatch.from_arrays([
                pa.array([part], pa.int32()), pa.array([first[0]], kind), pa.array([first[1]], pa.string()), pa.array([file], kind),
                pa.array([sheet], pa.string()), pa.array([single]), *(pa.array([x[keep].tolist()], pa.list_(pa.int64()))
                                                                      for x in (entry, fills, opened))], names)

    names = ["part", "first_file", "first_sheet", "last_file", "last_sheet", "single", "entry", "fill", "opened"]
    file = parts.schema["file_id"].dataType.simpleString()
    schema = (f"part int, first_file {file}, first_sheet string, last_file {file}, last_sheet string, single boolean, "
              "entry array<bigint>, fill array<bigint>, opened array<bigint>")
    narrow = parts.select("_part", "file_id", "sheet", "_length")
    return {r.part: r.asDict() for r in narrow.mapInArrow(report, schema).collect()}


def _entries(tables: dict[int, dict]) -> dict[int, tuple]:
    """The state ``(sheet, fill, chunks so far)`` in which a part finds its first file, where that began earlier."""
    found, last = {}, None
    for part in sorted(tables):
        table = tables[part]
        sheet, fill, count = None, CLOSED, 0
        if last is not None and last[0] == table["first_file"]:
            _, sheet, fill, count = last
            found[part] = (sheet, fill, count)
        if not table["single"]:
            count = 0
        at = fill if table["single"] and sheet == table["first_sheet"] else CLOSED
        row = int(np.searchsorted(table["entry"], at, side="right")) - 1
        last = (table["last_file"], table["last_sheet"], table["fill"][row], count + table["opened"][row])
    return found


def _fragments(parts: DataFrame, size: int, entries: dict[int, tuple]) -> DataFrame:
    """Chunks as far as one part holds them; ``whole`` where no other part can hold more of them."""
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # The open chunk: file, number, sheet, fill, whether it began here, first and last row, texts.
        file, number, sheet, fill, whole, rows, texts = None, -1, None, CLOSED, True, [], []
        part, started = -1, False
        done: list[tuple] = []

        def close(ended: bool) -> None:
            if texts:
                done.append((file, number, part, whole and ended, sheet, rows[0], rows[1], "\n".join(texts)))

        def flushed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done), fields)], schema=fields)

        for batch in batches:
            if not batch.num_rows:
                continue
            fields = pa.schema([("file_id", batch.schema.field(1).type), ("chunk_index", pa.int64()), ("part", pa.int32()), ("whole", pa.bool_()),
                                ("sheet", pa.string()), ("row_start", batch.schema.field(4).type), ("row_end", batch.schema.field(4).type),
                                ("text", pa.string())])
            files, sheets = _objects(batch.column(1)), _objects(batch.column(2))
            lengths, numbers = batch.column(3).to_numpy(), batch.column(4)
            body = batch.column(5).to_pylist()
            if not started:
                part, started, file = batch.column(0)[0].as_py(), True, files[0]
                if part in entries:
                    sheet, fill, count = entries[part]
                    number, whole = count - 1, False
            for a, b in _runs(files):
                if files[a] != file:
                    close(True)
                    file, number, sheet, fill, texts = files[a], -1, None, CLOSED, []
                run = Rows.of(sheets[a:b], lengths[a:b], size)
                at, n = 0, b - a
                if fill != CLOSED and sheets[a] == sheet:
                    at = int(run.first_break(np.array([fill]), size)[0])
                    if at:
                        rows = [rows[0] if texts else numbers[a].as_py(), numbers[a + at - 1].as_py()]
                        texts.extend(body[a:a + at])
                    if at >= n:
                        fill = run.fill(0, size, fill)
                while at < n:
                    close(True)
                    end = int(run.ends[at])
                    number, sheet, whole = number + 1, sheets[a + at], True
                    rows, texts = [numbers[a + at].as_py(), numbers[a + end - 1].as_py()], body[a + at:a + end]
                    fill = run.fill(at, size) if end >= n else CLOSED
                    at = end
            if done:
                yield flushed()
                done.clear()
        if started:
            close(False)
            if done:
                yield flushed()

    file, row = (parts.schema[c].dataType.simpleString() for c in ("file_id", "row"))
    return parts.select("_part", "file_id", "sheet", "_length", "row", "text").mapInArrow(write, FRAGMENT.format(file=file, row=row))


def pack_rows(units: DataFrame, size: int) -> DataFrame:
    """Pack consecutive sheet rows into chunks of up to ``size``; a row is never split, sheets never mix.

    ``units(file_id, unit_pos, sheet, row, text)`` -> one row per chunk with its exact row range.  Rows are laid out once,
    in even parts by (file, place), so one file may fill many tasks; they are read once for the tables, without texts,
    and once to write.  Only the pieces of chunks that a part's border cuts are shuffled again.  A null text counts as
    empty; a null file is a file of its own, a null place comes first, rows of one place follow in the order they were
    read.  An empty table gives an empty result.
    """
    text = F.coalesce("text", F.lit(""))
    rows = units.select("file_id", "unit_pos", "sheet", "row", text.alias("text"), F.length(text).alias("_length"),
                        F.monotonically_increasing_id().alias("_row"))
    order = ["file_id", "unit_pos", "_row"]
    parts = durable(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()))
    fragments = staged(_fragments(parts, size, _entries(_tables(parts, size))), "row-chunks")
    pieces = F.array_sort(F.collect_list(F.struct("part", "row_start", "row_end", "text")))
    cut = fragments.where("NOT whole").groupBy("file_id", "chunk_index").agg(F.max("sheet").alias("sheet"), pieces.alias("p"))
    cut = cut.select("file_id", "chunk_index", "sheet", F.col("p")[0]["row_start"].alias("row_start"),
                     F.element_at("p", -1)["row_end"].alias("row_end"),
                     F.array_join(F.transform("p", lambda x: x["text"]), "\n").alias("text"))
    chunks = fragments.where("whole").drop("part", "whole").unionByName(cut)
    return chunks.withColumn("text", F.concat(F.lit("Sheet "), "sheet", F.lit(":\n"), "text"))
