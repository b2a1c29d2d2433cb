"""Command line: ``python -m epochal.cli PATH... [options]``.

Exits with 0, with 1 where a recording failed (or, under --strict, anything is to
note), and with 2 where the request itself is wrong.
"""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import DataFrame, SparkSession

from .functions.lists import counted
from .functions.timespec import TimeSpecError, seconds_of
from .operators.selection import SelectionError
from .plans.convert import TimeRangeError, convert, root_of
from .plans.survey import printed, survey
from .sinks.committed import OutputExists


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="epochal", description="Binary recordings to tables.")
    p.add_argument("paths", nargs="+", help="recordings, or folders of them")
    p.add_argument("-o", "--out", help="folder of the results; beside the input if not given")
    p.add_argument("--channels", help="labels or #positions, with commas")
    p.add_argument("--start", help="such as 90, 1:30 or 1m30s, on the recording's clock")
    p.add_argument("--end")
    p.add_argument("--duration")
    p.add_argument("--layout", choices=["wide", "long"], default="wide")
    p.add_argument("--decimals", type=digits)
    for flag, text in (("gzip", "compress tables"), ("bom", "begin tables with a byte order mark"), ("force", "write into a folder that is there"), ("annotations-only", "no signals"), ("checksum", "tell the input's SHA-256"), ("info", "survey, and convert nothing"), ("stdout", "print the one signal table"), ("json", "tell what was done as JSON"), ("strict", "fail on anything to note"), ("quiet", "say nothing")):
        p.add_argument(f"--{flag}", action="store_true", help=text)
    p.add_argument("--master", default="local[*]", help="where Spark runs, unless it is set")
    return p


def digits(text: str) -> int:
    if not text.isascii() or not text.isdigit() or int(text) > 20:
        raise argparse.ArgumentTypeError("decimals are 0 to 20")
    return int(text)


def worst(codes: list[int]) -> int:
    """1 beats 2, which beats 0."""
    return 1 if 1 in codes else max(codes, default=0)


def told(notes: DataFrame) -> list[dict]:
    return [r.asDict() for r in notes.orderBy("path", "stage", "code", "message").select("path", "code", "severity", "message", "hint").collect()]


def main(argv: list[str] | None = None, spark: SparkSession | None = None, out=sys.stdout) -> int:
    try:
        a = parser().parse_args(argv)
    except SystemExit as e:
        return 2 if e.code else 0
    say = lambda text: None if a.quiet else print(text, file=out)
    spark = spark or SparkSession.builder.master(a.master).appName("epochal").getOrCreate()
    codes, totals = [], {"converted": 0, "failed": 0, "notes": 0}
    for path in a.paths:
        try:
            times = {k: seconds_of(v, k != "duration") for k in ("start", "end", "duration") if (v := getattr(a, k)) is not None}
            terms = a.channels.split(",") if a.channels is not None else None
            if a.info:
                rows = survey(spark, path, terms, times.get("start"), times.get("end"), times.get("duration"), a.layout, a.decimals).collect()
                for row in rows:
                    print(json.dumps(row.asDict(True), default=str) if a.json else printed(row), file=out)
                codes.append(int(any(r.error for r in rows) or a.strict and any(r.notes for r in rows)))
                continue
            target = a.out or root_of(path) or "."  # each recording's folder is beside it
            if a.stdout:
                codes.append(print_table(spark, path, terms, times, a, out))
                continue
            done = convert(spark, path, target, terms, times.get("start"), times.get("end"), a.layout, a.gzip, a.force, times.get("duration"), a.decimals, a.bom, a.annotations_only, a.checksum)
            notes = told(done.diagnostics)
            failed = [n for n in notes if n["severity"] == "error"]
            totals["converted"] += len(done.written)
            totals["failed"] += len(failed)
            totals["notes"] += len(notes)
            files = [r.asDict() for r in done.files.orderBy("recording", "table").collect()]
            say(json.dumps({"files": files, "notes": notes}) if a.json else "\n".join([*(f"{f['recording']}/{f['table']}" + (f": {f['n_rows']:,} rows" if f["n_rows"] is not None else "") for f in files), *(f"{n['severity']}: {n['code']} {n['message']}" + (f" ({n['hint']})" if n["hint"] else "") for n in notes)]))
            codes.append(int(bool(failed) or a.strict and bool(notes)))
        except (TimeSpecError, TimeRangeError, SelectionError, OutputExists, ValueError) as e:
            say(f"{path}: {e}")
            codes.append(2)
            totals["failed"] += 1
        except Exception as e:  # noqa: BLE001  a recording that fails doesn't stop the others
            say(f"{path}: {str(e).splitlines()[0]}")
            codes.append(1)
            totals["failed"] += 1
    if len(a.paths) > 1 and not a.info:
        say(json.dumps(totals) if a.json else f"{counted(totals['converted'], 'recording')} converted, {totals['failed']} failed, {counted(totals['notes'], 'note')}")
    return worst(codes)


def print_table(spark: SparkSession, path: str, terms, times: dict, a, out) -> int:
    """Print the one signal table of the one recording, a block at a time."""
    from .plans.convert import open_recordings, with_tables
    from .plans.render import rendered
    from .sinks.committed import BLOCKS

    found = open_recordings(spark, path)
    windows = found.windows(times.get("start"), times.get("end"), times.get("duration")).where("fault is null")
    groups = with_tables(found.rate_groups(terms, a.layout, a.decimals, windows), a.layout, ".csv")
    names = [(r.path, r.table) for r in groups.select("path", "table").distinct().limit(2).collect()]
    if len(names) != 1:
        raise ValueError("there is not one signal table to print")
    bounds = windows.first()
    options = {"layout": a.layout, "gzip": False, "decimals": a.decimals, "bom": a.bom, "window": (bounds.start_seconds, bounds.end_seconds)}
    blocks = found.packed(terms, bounds.start_seconds, bounds.end_seconds).mapInArrow(lambda batches: rendered(batches, lambda _: "printed", options), BLOCKS)
    header = None
    for row in blocks.select("header", "value").toLocalIterator():
        if header is None:
            print(header := row.header, file=out)
        print(row.value, file=out)
    return 0


if __name__ == "__main__":
    sys.exit(main())
