"""Records of delimited files with line breaks inside cells, read in byte ranges of any size.

Where a range starts, nothing tells whether a cell is open. So every range first says, for both cases, whether a cell
is open at its end and how many records begin in it. These pairs are maps of two states; composed along each file they
give every range its true start, with one row per range. Then the ranges are cut at true record ends, in parallel.
Only the pieces of records that cross a border meet again.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from ..session import materialize

#: The rest of an open cell up to its closing quote; two quotes are one in the cell.
_CLOSE = re.compile('[^"]*(?:""[^"]*)*"(?!")')
#: Rows of one batch of output.
_ROWS = 8192
#: Ranges whose states are sent to every task; further ones are joined.
_FEW_RANGES = 50_000

_RANGE = "file STRING, start BIGINT, closed_end BOOLEAN, open_end BOOLEAN, closed_begins BIGINT, open_begins BIGINT"
_PIECE = "file STRING, start BIGINT, home BIGINT, first BOOLEAN, whole BOOLEAN, value STRING"


def cell_open(line: str, is_open: bool, sep: str) -> bool:
    """Whether a cell is open after a line. A quote opens a cell only at its begin."""
    at = 0
    while True:
        if is_open:
            end = _CLOSE.match(line, at)
            if not end:
                return True
            at, is_open = end.end(), False
        if at == 0 and line.startswith('"'):
            at, is_open = 1, True
            continue
        found = line.find(f'{sep}"', at)
        if found < 0:
            return False
        at, is_open = found + len(sep) + 1, True


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """file, start (of the byte range), value: lines in the order of the file within a task; carriage returns stay."""
    meta = F.col("_metadata")
    return spark.read.option("lineSep", "\n").text(path).select(
        meta["file_path"].alias("file"), meta["file_block_start"].alias("start"), "value"
    )


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[str, int, pa.Array, list[int]]]:
    """Stretches of a batch from one range: file, start, lines, and which of them have quotes."""
    files, starts = batch.column("file"), batch.column("start").to_numpy(zero_copy_only=False)
    names = files.dictionary_encode().indices.to_numpy()
    borders = [0, *(((names[1:] != names[:-1]) | (starts[1:] != starts[:-1])).nonzero()[0] + 1).tolist(), batch.num_rows]
    for a, b in zip(borders, borders[1:]):
        if b > a:
            lines = batch.column("value").slice(a, b - a)
            quoted = pc.match_substring(lines, '"').to_numpy(zero_copy_only=False).nonzero()[0]
            yield files[a].as_py(), int(starts[a]), lines, quoted.tolist()


def _survey(sep: str):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, found = None, []

        def packed() -> pa.RecordBatch:
            names = ["file", "start", "closed_end", "open_end", "closed_begins", "open_begins"]
            return pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*found)], names=names)

        for batch in batches:
            for file, start, lines, quoted in _runs(batch):
                if now is None or (file, start) != (now[0], now[1]):
                    if now is not None:
                        found.append(tuple(now))
                    now = [file, start, False, True, 0, 0]
                last = 0
                for i in [*quoted, len(lines)]:
                    for case in (2, 3):
                        if not now[case]:
                            now[case + 2] += i - last
                    if i < len(lines):
                        line = lines[i].as_py()
                        for case in (2, 3):
                            now[case + 2] += not now[case]
                            now[case] = cell_open(line, now[case], sep)
                    last = i + 1
        if now is not None:
            found.append(tuple(now))
            yield packed()

    return scan


def range_starts(ranges: DataFrame) -> DataFrame:
    """file, start, is_open, home: whether a cell is open where a range starts, and the range in which its record began.

    A range that ends alike in both cases settles the state; after it, only the number of ranges that turn it counts.
    """
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, 0)
    turns = (F.col("closed_end") & ~F.col("open_end")).cast("int")
    settled = F.col("closed_end") == F.col("open_end")
    counted = ranges.withColumn("turned", F.sum(turns).over(upto))
    last = F.last(F.when(settled, F.struct(F.col("closed_end").cast("int").alias("state"), "turned")), True).over(before)
    turned = F.coalesce(F.last("turned").over(before), F.lit(0))
    state = F.coalesce(last["state"], F.lit(0)) + turned - F.coalesce(last["turned"], F.lit(0))
    known = counted.withColumn("is_open", state % 2 == 1)
    begins = F.when(F.col("is_open"), F.col("open_begins")).otherwise(F.col("closed_begins")) > 0
    return known.withColumn("home", F.last(F.when(begins, F.col("start")), True).over(before)).select("file", "start", "is_open", "home")


def _cut(sep: str):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows: file, start, home, first, whole, value. ``held`` is the record at hand, which may go on."""
        now = home = None
        is_open, held, held_home, first, out = False, None, None, False, []

        def packed() -> pa.RecordBatch:
            rows = list(zip(*out))
            out.clear()
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds)], names=["file", "start", "home", "first", "whole", "value"])

        def release() -> None:
            # A record that began before this range, or is still open at its end, is a piece.
            if held is not None:
                out.append((*now, held_home, first, held_home == now[1] and not is_open, "\n".join(held)))

        for batch in batches:
            states = batch.column("is_open"), batch.column("home")
            at = 0
            for file, start, lines, quoted in _runs(batch):
                if (file, start) != now:
                    release()
                    now, is_open, home = (file, start), states[0][at].as_py(), states[1][at].as_py()
                    held, held_home, first = ([], home if home is not None else start, False) if is_open else (None, None, False)
                    new = True
                quotes = set(quoted)
                for i, line in enumerate(lines.to_pylist()):
                    if is_open:
                        held.append(line)
                    else:
                        if held is not None:
                            release()
                        held, held_home, first = [line], start, new and start == 0
                    new = False
                    if i in quotes:
                        is_open = cell_open(line, is_open, sep)
                    if len(out) >= _ROWS:
                        yield packed()
                at += len(lines)
        release()
        if out:
            yield packed()

    return scan


def split_records(spark: SparkSession, path: str, sep: str, few_ranges: int = _FEW_RANGES) -> DataFrame:
    """first, value: every record of delimited files as one text, with its line breaks; first marks the first one of a file.

    Files are read twice, in as many tasks as Spark makes of their bytes. Quotes are doubled inside quoted cells. A
    cell that is never closed reaches to the end of its file.
    """
    lines = _lines(spark, path)
    starts = materialize(range_starts(lines.mapInArrow(_survey(sep), _RANGE)), "ranges")
    if starts.count() <= few_ranges:
        # The lines of a task stay in their order.
        placed = lines.join(F.broadcast(starts), ["file", "start"])
    else:
        # Too many ranges to send around: lines travel to their range's state and are put in order again.
        numbered = lines.withColumn("at", F.monotonically_increasing_id())
        placed = numbered.join(starts, ["file", "start"]).repartition("file", "start").sortWithinPartitions("file", "start", "at")
    pieces = placed.select("file", "start", "value", "is_open", "home").mapInArrow(_cut(sep), _PIECE)
    joined = pieces.where("NOT whole").groupBy("file", "home").agg(
        F.array_sort(F.collect_list(F.struct("start", "value", "first"))).alias("parts")
    ).select(F.exists("parts.first", lambda x: x).alias("first"), F.array_join("parts.value", "\n").alias("value"))
    # A carriage return before a line break that ends a record belongs to that break.
    return pieces.where("whole").select("first", "value").unionAll(joined).withColumn("value", F.regexp_replace("value", r"\r\z", ""))


def read_records(spark: SparkSession, path: str, sep: str, schema: T.StructType | str | None = None) -> DataFrame:
    """A table of delimited files with a header record each, whose cells may hold line breaks.

    Rows are those of a reader that takes each file in one task. Without a ``schema``, types are inferred in a pass of
    their own. Blank lines between records are no rows. Line breaks in cells stay as they are written.
    """
    records = materialize(split_records(spark, path, sep), "records")
    head = records.where("first").agg(F.min("value").alias("value")).head().value
    if head is None:
        raise ValueError(f"no header record in {path}")
    rest = records.where("NOT first").select("value")
    reader = spark.read.options(sep=sep, quote='"', escape='"', multiLine="true")
    if schema is not None:
        reader = reader.schema(schema)
    else:
        # The header is the first row of what is read, and gives the names.
        reader = reader.options(header="true", inferSchema="true")
        rest = spark.createDataFrame([(head.removeprefix("\ufeff"),)], "value string").unionAll(rest)
    # Python's reader takes texts only as an RDD, by which they would go through Python once more.
    strings = getattr(rest._jdf, "as")(spark._jvm.org.apache.spark.sql.Encoders.STRING())
    return reader._df(reader._jreader.csv(strings))
