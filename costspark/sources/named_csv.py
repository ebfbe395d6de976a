"""Gzip CSV files read by the column names of their own headers."""

from __future__ import annotations

import io
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.csv as csv
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _closed(lines: pa.Array) -> int:
    """How many of ``lines`` lie before the last record that a quote leaves open."""
    quotes = pc.count_substring(lines, '"').to_numpy(zero_copy_only=False)
    if not quotes.any():
        return len(lines)
    escaped = pc.count_substring(lines, '\\"').to_numpy(zero_copy_only=False)
    whole = np.flatnonzero(np.cumsum(quotes - escaped) % 2 == 0)
    return int(whole[-1]) + 1 if len(whole) else 0


def _parsed(header: list[str], lines: pa.Array, wanted: Sequence[str]) -> pa.Table:
    """The columns ``wanted`` of the records, as text; those that the header lacks are null."""
    lower = [h.strip().lower() for h in header]
    place = {name: lower.index(name.lower()) for name in wanted if name.lower() in lower}
    own = [f"c{i}" for i in range(len(header))]  # a header may repeat a name; the first counts
    kinds = {own[i]: pa.string() for i in place.values()}
    text = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(lines)], pa.int32()), lines), "\n")[0]
    table = csv.read_csv(
        pa.BufferReader(text.as_buffer()),
        read_options=csv.ReadOptions(column_names=own, block_size=max(1 << 26, len(text.as_buffer()) + 1), use_threads=False),
        parse_options=csv.ParseOptions(escape_char="\\", newlines_in_values=True),
        convert_options=csv.ConvertOptions(
            include_columns=list(kinds) or own[:1], column_types=kinds or {own[0]: pa.string()},
            strings_can_be_null=True, quoted_strings_can_be_null=False, null_values=[""],
        ),
    )
    none = lambda: pa.nulls(len(table), pa.string())
    return pa.table({f"v{i}": table[own[place[n]]] if n in place else none() for i, n in enumerate(wanted)})


def _as(column: Column, kind: T.DataType) -> Column:
    """Text as ``kind``; maps, lists and structs are JSON."""
    if isinstance(kind, (T.MapType, T.ArrayType, T.StructType)):
        return F.from_json(column, kind)
    return column if isinstance(kind, T.StringType) else column.cast(kind)


def read_named_csv(
    spark: SparkSession,
    paths: str | Sequence[str],
    schema: T.StructType,
    partition: str,
    mark: Column | None = None,
    mark_name: str = "mark",
    base: str | None = None,
    within: Column | None = None,
    stream: bool = False,
) -> DataFrame:
    """Gzip CSV files with a header each, as ``schema``: columns are found by name, not by place.

    Files may order their columns as they like, lack some (null) and have others (not read); names match in
    either case.  A value that is no value of its type fails under ANSI rules, as a cast does; a record
    with more or fewer values than its header fails always.  A quoted value may hold line ends.

    One scan: a gzip file can't be split, so its lines reach one task in order, the header first, and
    batches of lines are parsed under the header seen last.  ``partition`` is the partition column (text),
    by which ``within`` prunes folders; ``mark``, an expression over ``_metadata``, is carried as ``mark_name``.  With ``stream`` the folder is
    a source of files that arrive.
    """
    wanted = [f.name for f in schema.fields if f.name != partition]
    reader = (spark.readStream if stream else spark.read).schema(f"value string, `{partition}` string").option("pathGlobFilter", "*.gz")
    if base:
        reader = reader.option("basePath", base)
    rows = reader.text(paths if isinstance(paths, str) else list(paths))
    lines = rows.filter(F.lit(True) if within is None else within).select(
        F.col("value").alias("line"),
        F.xxhash64("_metadata.file_path").alias("file"),
        (F.lit(None).cast("string") if mark is None else mark).alias("mark"),
        F.col(partition).alias("period"),
    )

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = pa.array([], pa.string())
        file, header, open_lines = None, [], none
        carried: tuple = (None, None)

        def records(own: pa.Array) -> Iterator[pa.RecordBatch]:
            if pc.any(pc.not_equal(own, "")).as_py():
                table = _parsed(header, own, wanted)
                for name, value in zip(("mark", "period"), carried):
                    table = table.append_column(name, pa.repeat(pa.scalar(value, pa.string()), len(table)))
                yield from table.combine_chunks().to_batches()

        for batch in batches:
            texts, files = batch.column(0).cast(pa.string()), batch.column(1).to_numpy()
            start = 0
            while start < len(texts):
                other = files[start:] != files[start]
                end = start + int(other.argmax()) if other.any() else len(texts)
                first = start
                if files[start] != file:
                    yield from records(open_lines)
                    file, open_lines = files[start], none
                    carried = (batch.column(2)[start].as_py(), batch.column(3)[start].as_py())
                    header = _names(texts[start].as_py().lstrip("\ufeff"))
                    first += 1
                own = pa.concat_arrays([open_lines, texts[first:end]])
                n = _closed(own)
                yield from records(own[:n])
                open_lines = own[n:]
                start = end
        yield from records(open_lines)

    out = ", ".join([*(f"v{i} string" for i in range(len(wanted))), "mark string, period string"])
    found = lines.mapInArrow(parsed, out)
    kinds = {f.name: f.dataType for f in schema.fields}
    columns = [_as(F.col(f"v{i}"), kinds[n]).alias(n) for i, n in enumerate(wanted)]
    extra = [] if mark is None else [F.col("mark").alias(mark_name)]
    return found.select(*columns, F.col("period").alias(partition), *extra)


def _names(line: str) -> list[str]:
    """The names of a header line."""
    kinds = csv.ConvertOptions(column_types={f"f{i}": pa.string() for i in range(line.count(",") + 1)}, strings_can_be_null=False)
    table = csv.read_csv(
        io.BytesIO(f"{line}\n".encode()), read_options=csv.ReadOptions(autogenerate_column_names=True),
        parse_options=csv.ParseOptions(escape_char="\\"), convert_options=kinds,
    )
    return [column[0].as_py() for column in table.columns]
