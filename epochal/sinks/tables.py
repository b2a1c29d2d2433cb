"""Tables of text: CSV lines in blocks, what earlier conversions left, and reading tables back.

A conversion writes rows (recording, table, value, n_rows, header), where a value is a
block of lines, in one job; ``committed`` makes a file a table of them. Fields are
quoted only where they hold a quote, a comma or a line end, lines end in LF, NULL is an
empty cell.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import csv_field
from ..sources.files import opened
from .committed import BLOCK, BLOCKS

MARK = "\ufeff"
#: Columns of the tables with their types, in order.
TYPES = {
    "annotations": "onset_s double, duration_s double, description string, record_index long",
    "channels": "column string, signal_index int, label string, unit string, sampling_rate_hz double, samples_per_record long, physical_min double, physical_max double, digital_min long, digital_max long, transducer string, prefiltering string, output_file string, converted string",
    "long": "time_s double, channel string, value double",
}


def field(text: str) -> str:
    return '"' + text.replace('"', '""') + '"' if any(c in text for c in '",\r\n') else text


def line(*cells: Column) -> Column:
    """A CSV line of text columns; NULL is an empty cell."""
    return F.concat_ws(",", *(F.coalesce(csv_field(c), F.lit("")) for c in cells))


def in_blocks(lines: DataFrame, header: str, size: int = 5000) -> DataFrame:
    """Rows (recording, table, line) in order, as blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []

        def flush():
            nonlocal held
            out, held = (*key, "\n".join(held), len(held), header), []
            return pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(out, BLOCK.types, strict=True)], schema=BLOCK)

        for batch in batches:
            for recording, table, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and (len(held) >= size or (recording, table) != key):
                    yield flush()
                key = (recording, table)
                held.append(text)
        if held:
            yield flush()

    return lines.select("recording", "table", "line").mapInArrow(run, BLOCKS)


OWN = re.compile(r"(?:signals(?:_[\w-]+hz(?:_\d+)?)?|channels|annotations)\.csv(?:\.gz)?|metadata\.json")


def stale(written: DataFrame, out: str) -> DataFrame:
    """(recording, table) of earlier conversions' tables beside those of ``written``, listed by tasks."""

    def run(found: pa.Table) -> pa.Table:
        name, tables = found["recording"][0].as_py(), set(found["table"].to_pylist())
        store, plain = opened(f"{out}/{name}")
        left = sorted(i.base_name for i in store.get_file_info(fs.FileSelector(plain)) if OWN.fullmatch(i.base_name) and i.base_name not in tables)
        return pa.table({"recording": pa.array([name] * len(left), pa.string()), "table": pa.array(left, pa.string())})

    return written.select("recording", "table").groupBy("recording").applyInArrow(run, "recording string, table string")


def read_table(spark: SparkSession, path: str, kind: str = "wide") -> DataFrame:
    """A written table with its types. ``kind``: a name of ``TYPES``, or wide, whose
    columns are those of the header and numbers all."""
    reader = spark.read.option("header", "true").option("escape", '"').option("emptyValue", "").option("multiLine", kind in ("annotations", "channels"))
    if kind != "wide":
        return reader.schema(TYPES[kind]).csv(path)
    names = reader.csv(path).columns
    return reader.schema(", ".join(f"`{n.replace('`', '``')}` double" for n in names)).csv(path)
