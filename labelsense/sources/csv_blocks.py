"""CSV files with line breaks inside quotes, read by many tasks.

Where a block of a file begins, nobody knows whether a quote is open. So a line is a function: for
both states at its beginning, whether a quote is open at its end. Functions of lines combine to one
of their block, and blocks of a file are put in order to find the state at the beginning of each; the
list of those that begin inside a quoted field is all that tasks need to know of each other. Each
then makes whole records of its lines. Only what crosses the end of a block is shuffled: the
beginning of a block up to the end of a record begun earlier, and the unfinished record at its end.

Lines are split by Spark's text source, and records are parsed by its CSV parser, so types, nulls and
malformed fields are as in its own reader. The list of blocks is one entry of a path and a place for a
block of ``spark.sql.files.maxPartitionBytes``.
"""

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

WHOLE, HEAD, TAIL = 0, 1, 2


def line_states(line: Column, separator: str = ",", quote: str = '"') -> tuple[Column, Column]:
    """Whether a quote is open at the end of a line, if none was open at its beginning, and if one was.

    A quote opens a field only at its beginning; inside, two stand for one.
    """
    s, q = re.escape(separator), re.escape(quote)
    inside = f"[^{q}]*+(?:{q}{q}[^{q}]*+)*+"
    field = f"(?:{q}{inside}{q}[^{s}]*+|[^{s}{q}][^{s}]*+)?+"
    opened = f"(?:{field}{s})*+{q}{inside}"
    no_quote = ~line.contains(quote)
    return (
        ~no_quote & line.rlike(rf"\A{opened}\z"),
        no_quote | line.rlike(rf"\A{inside}(?:\z|{q}[^{s}]*+{s}{opened}\z)"),
    )


def states_after(start: bool, if_closed: np.ndarray, if_open: np.ndarray) -> np.ndarray:
    """The state after each line, given the one before the first."""
    fixed = if_closed == if_open
    at = np.arange(len(fixed))
    last = np.maximum.accumulate(np.where(fixed, at, -1))
    turns = np.cumsum(if_closed & ~if_open)
    base = np.where(last >= 0, if_closed[np.maximum(last, 0)], start)
    since = turns - np.where(last >= 0, turns[np.maximum(last, 0)], 0)
    return base ^ (since % 2 == 1)


def _stretches(batch: pa.RecordBatch) -> Iterator[tuple[str, int, pa.RecordBatch]]:
    """Runs of lines of one block."""
    files, blocks = batch.column("file").dictionary_encode(), batch.column("block").to_numpy()
    codes = files.indices.to_numpy()
    cuts = np.flatnonzero((np.diff(codes) != 0) | (np.diff(blocks) != 0)) + 1
    for low, high in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
        if high > low:
            yield files.dictionary[int(codes[low])].as_py(), int(blocks[low]), batch.slice(low, high - low)


def _flags(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    return tuple(part.column(c).to_numpy(zero_copy_only=False) for c in ("if_closed", "if_open"))


def _block_functions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(file, block, if_closed, if_open): the function of each block, for both states at its beginning."""
    ends: dict[tuple[str, int], list[bool]] = {}
    for batch in batches:
        for file, block, part in _stretches(batch):
            held = ends.setdefault((file, block), [False, True])
            ends[file, block] = [bool(states_after(state, *_flags(part))[-1]) for state in held]
    columns = [[f for f, _ in ends], [b for _, b in ends], [e[0] for e in ends.values()], [e[1] for e in ends.values()]]
    kinds = [pa.string(), pa.int64(), pa.bool_(), pa.bool_()]
    yield pa.RecordBatch.from_arrays(
        [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["file", "block", "if_closed", "if_open"]
    )


def _records(opened):
    """(file, block, kind, first, record): whole records, and the parts of those that cross a block's end."""

    def rows(file: str, block: int, kinds: list[int], first: list[bool], texts: pa.Array) -> pa.RecordBatch:
        n = len(texts)
        return pa.RecordBatch.from_arrays(
            [pa.array([file] * n, pa.string()), pa.array([block] * n, pa.int64()), pa.array(kinds, pa.int32()),
             pa.array(first, pa.bool_()), texts.cast(pa.string())],
            ["file", "block", "kind", "first", "record"],
        )

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, kept, kind, begun = None, False, [], WHOLE, False

        def rest() -> Iterator[pa.RecordBatch]:
            """What a block ends with."""
            if now is not None and kept:
                last = HEAD if kind == HEAD else TAIL if state else WHOLE
                yield rows(*now, [last], [not begun and now[1] == 0], pa.array(["\n".join(kept)]))

        for batch in batches:
            for file, block, part in _stretches(batch):
                if (file, block) != now:
                    yield from rest()
                    now, state, kept, begun = (file, block), (file, block) in opened.value, [], False
                    kind = HEAD if state else WHOLE
                after = states_after(state, *_flags(part))
                before = np.concatenate([[state], after[:-1]])
                starts = np.flatnonzero(~before)
                lines = part.column("value")
                kept += lines.slice(0, starts[0] if len(starts) else len(lines)).to_pylist()
                state = bool(after[-1])
                if not len(starts):
                    continue
                if kept:
                    yield rows(file, block, [kind], [not begun and block == 0 and kind == WHOLE], pa.array(["\n".join(kept)]))
                    begun = True
                if len(starts) > 1:
                    at = pa.array((starts - starts[0]).astype(np.int64))
                    whole = lines.slice(starts[0], starts[-1] - starts[0])
                    joined = pc.binary_join(pa.LargeListArray.from_arrays(at, pa.concat_arrays([whole.cast(pa.large_string())])), pa.scalar("\n", pa.large_string()))
                    yield rows(file, block, [WHOLE] * len(joined), [not begun and block == 0, *[False] * (len(joined) - 1)], joined)
                    begun = True
                kind, kept = WHOLE, lines.slice(starts[-1]).to_pylist()
        yield from rest()

    return read


def records(spark: SparkSession, path: str, separator: str = ",", quote: str = '"') -> DataFrame:
    """(file, first, record): every record of the files as it stands there; ``first`` of a file."""
    lines = spark.read.option("lineSep", "\n").text(path)
    lines = lines.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    closed, open_ = line_states(F.col("value"), separator, quote)
    lines = lines.withColumns({"if_closed": closed, "if_open": open_})
    blocks = lines.drop("value").mapInArrow(_block_functions, "file string, block bigint, if_closed boolean, if_open boolean")
    opened = spark.sparkContext.broadcast(_open_blocks(blocks))
    schema = "file string, block bigint, kind int, first boolean, record string"
    found = lines.mapInArrow(_records(opened), schema)
    parts = found.filter(F.col("kind") != WHOLE)
    order = Window.partitionBy("file").orderBy("block", "kind")  # two parts of a block at most
    numbered = parts.withColumn("_no", F.sum((F.col("kind") == TAIL).cast("int")).over(order))
    together = numbered.groupBy("file", "_no").agg(
        F.max("first").alias("first"), F.array_sort(F.collect_list(F.struct("block", "record"))).alias("_parts")
    )
    joined = together.select("file", "first", F.array_join(F.transform("_parts", lambda p: p["record"]), "\n").alias("record"))
    return found.filter(F.col("kind") == WHOLE).select("file", "first", "record").unionByName(joined)


def _open_blocks(blocks: DataFrame) -> set[tuple[str, int]]:
    """The blocks that begin inside a quoted field."""
    found, now, state = set(), None, False
    for row in blocks.orderBy("file", "block").toLocalIterator():  # a row per block
        if row["file"] != now:
            now, state = row["file"], False
        if state:
            found.add((row["file"], row["block"]))
        state = row["if_open"] if state else row["if_closed"]
    return found


def read_csv(
    spark: SparkSession, path: str, schema: T.StructType, header: bool = True, separator: str = ",", options: dict[str, str] | None = None
) -> DataFrame:
    """The rows of CSV files whose quoted fields may hold line breaks; a file is read by as many tasks as it has blocks."""
    found = records(spark, path, separator)
    if header:
        found = found.filter(~F.col("first"))
    record = F.regexp_replace("record", r"\r$", "")
    settings = {"sep": separator, "escape": '"', "multiLine": "true", **(options or {})}
    parsed = F.from_csv(record, _ddl(schema), settings)
    return found.filter(F.length(record) > 0).select(parsed.alias("_row")).select("_row.*")


def _ddl(schema: T.StructType) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
