"""Writes small recordings for tests, from the format's public layout."""

import numpy as np


def field(value, width):
    return str(value).encode("latin-1").ljust(width)[:width]


def slot(texts: bytes, n_bytes: int) -> bytes:
    return texts.ljust(n_bytes, b"\0")


def write(path, signals, records, duration=1, reserved="", starts=None, wide=False, declared=None, date="02.03.04", time="05.06.07"):
    """``signals``: (label, unit, pmin, pmax, dmin, dmax, spr); ``records``: a
    list per record of sample arrays, or bytes for annotation slots."""
    head = (b"\xffBIOSEMI" if wide else field("0", 8)) + field("X", 80) + field("Startdate", 80) + field(date, 8) + field(time, 8)
    head += field(256 * (len(signals) + 1), 8) + field(reserved, 44) + field(len(records) if declared is None else declared, 8) + field(duration, 8) + field(len(signals), 4)
    blank = [("", 80)] * len(signals)
    for k, width in ((0, 16), (None, 80), (1, 8), (2, 8), (3, 8), (4, 8), (5, 8), (None, 80), (6, 8), (None, 32)):
        head += b"".join(field("" if k is None else s[k], width) for s, _ in zip(signals, blank))
    body = b""
    for record in records:
        for s, data in zip(signals, record, strict=True):
            if isinstance(data, bytes):
                body += slot(data, s[6] * (3 if wide else 2))
            elif wide:
                body += b"".join(int(x).to_bytes(3, "little", signed=True) for x in data)
            else:
                body += np.array(data, "<i2").tobytes()
    with open(path, "wb") as f:
        f.write(head + body)
    return str(path)
