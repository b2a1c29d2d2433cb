"""Binary recordings from rows of records: a task writes each file.

A file's records go to one task, so a file is to hold a bounded part of a table;
give ``path`` as many values as the data need. For tests and for handing decoded
data back; the layout is the public one that ``sources.header`` reads.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from ..sources.files import opened


def padded(value, width: int) -> bytes:
    return str(value).encode("latin-1").ljust(width)[:width]


def header_bytes(signals: list[dict], records: int, duration=1, reserved: str = "", patient: str = "X", recording: str = "", date: str = "02.03.04", time: str = "05.06.07", wide: bool = False) -> bytes:
    """``signals``: label, unit, physical_min/max, digital_min/max, samples_per_record."""
    head = (b"\xffBIOSEMI" if wide else padded("0", 8)) + padded(patient, 80) + padded(recording, 80) + padded(date, 8) + padded(time, 8)
    head += padded(256 * (len(signals) + 1), 8) + padded(reserved, 44) + padded(records, 8) + padded(duration, 8) + padded(len(signals), 4)
    for name, size in (("label", 16), ("transducer", 80), ("unit", 8), ("physical_min", 8), ("physical_max", 8), ("digital_min", 8), ("digital_max", 8), ("prefiltering", 80), ("samples_per_record", 8), ("", 32)):
        head += b"".join(padded(s.get(name, ""), size) for s in signals)
    return head


def encoded(codes: np.ndarray, width: int) -> bytes:
    """Little-endian signed samples of two or three bytes."""
    if width == 2:
        return codes.astype("<i2").tobytes()
    return codes.astype("<i4").view(np.uint8).reshape(-1, 4)[:, :3].tobytes()


def write_recordings(records: DataFrame, signals: list[dict], wide: bool = False, **header) -> DataFrame:
    """Write ``records`` (path, record_index, codes array<int>, slot binary, reserved string).

    ``codes`` are a record's samples channel by channel; ``slot`` fills the annotation
    channel, which is the last signal if there is one. Returns (path, bytes)."""
    width = 3 if wide else 2
    room = signals[-1]["samples_per_record"] * width if signals[-1]["label"].endswith("Annotations") else 0

    def write(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("record_index")
        path = rows.path.iloc[0]
        store, plain = opened(path)
        size = 0
        with store.open_output_stream(plain) as out:
            out.write(header_bytes(signals, len(rows), reserved=rows.reserved.iloc[0], wide=wide, **header))
            for codes, slot in zip(rows.codes, rows.slot, strict=True):
                body = encoded(np.asarray(codes), width) + bytes(slot or b"").ljust(room, b"\0")[:room]
                out.write(body)
                size += len(body)
        return pd.DataFrame({"path": [path], "bytes": [size + 256 * (len(signals) + 1)]})

    return records.groupBy("path").applyInPandas(write, "path string, bytes long")
