"""Numbers: decimals that a rate or a step needs, and exact fixed-point text."""

from __future__ import annotations

import math
from decimal import ROUND_HALF_UP, Decimal, localcontext

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def quantization_step(pmin, pmax, dmin, dmax) -> Column:
    return F.coalesce(F.abs(F.try_divide(pmax - pmin, (dmax - dmin).cast("double"))), F.lit(0.0))


def value_decimals(step: Column) -> Column:
    """Two more decimals than the step's first digit; 3 where there is no step."""
    needed = F.ceil(-F.log10(F.when(step > 0, step))) + 2
    return F.when(step > 0, F.least(F.greatest(needed, F.lit(0)), F.lit(100))).otherwise(3).cast("int")


def time_decimals(rate: Column) -> Column:
    """The fewest decimals, at least 3, that print each sample time exactly;
    without an exact number, three more than the rate's magnitude."""
    tens = F.filter(F.sequence(F.lit(0), F.lit(15)), lambda d: F.pow(F.lit(10.0), d) / rate == F.floor(F.pow(F.lit(10.0), d) / rate).cast("double"))
    close = F.least(F.lit(15), F.greatest(F.lit(3), F.ceil(F.log10(rate)) + 3))
    exact = F.when(F.size(tens) > 0, F.greatest(F.array_min(tens), F.lit(3)))
    return F.when(rate > 0, F.coalesce(exact, close)).otherwise(3).cast("int")


def decimals_of(pmin: float, pmax: float, dmin: int, dmax: int) -> int:
    """``value_decimals`` of one channel."""
    step = abs((pmax - pmin) / (dmax - dmin)) if dmax != dmin else 0.0
    return min(100, max(0, math.ceil(-math.log10(step)) + 2)) if 0 < step < math.inf else 0 if step else 3


def decimals_of_rate(rate: float) -> int:
    """``time_decimals`` of one rate."""
    if not 0 < rate < math.inf:
        return 3
    exact = next((d for d in range(16) if (x := 10.0**d / rate) == math.floor(x)), None)
    return max(3, exact) if exact is not None else min(15, max(3, math.ceil(math.log10(rate)) + 3))


def clamped(step: Column) -> Column:
    """Whether a step needs more decimals than can be printed."""
    return F.coalesce((step > 0) & (F.ceil(-F.log10(F.when(step > 0, step))) + 2 > 100), F.lit(False))


def nearly_equal(a: Column, b: Column) -> Column:
    return F.abs(a - b) <= F.greatest(F.abs(a), F.abs(b)) * 1e-12


def can_carry(origin: Column, finest: Column) -> Column:
    """Whether a start and the finest interval after it are different numbers."""
    return F.coalesce((F.abs(origin) < float("inf")) & (origin + finest > origin), F.lit(False))


def cell_width(magnitude: Column, decimals: Column, signed: Column) -> Column:
    """Characters of a number of this size, printed to ``decimals`` places."""
    size, sign = F.abs(magnitude), signed.cast("int")
    fraction = F.when(decimals > 0, decimals + 1).otherwise(0)
    grown = F.floor(size + F.pow(F.lit(10.0), -decimals) / 2)  # a carry can make a digit
    digits = F.when(size < 1e18, F.length(F.greatest(grown, F.lit(0)).cast("decimal(20,0)").cast("string"))).otherwise(F.floor(F.log10(size)) + 1)
    return F.when(size < float("inf"), sign + digits + fraction).otherwise(sign + 1 + fraction).cast("long")


def thousands(n: Column) -> Column:
    return F.format_number(n, 0)


def number_text(x: float) -> str:
    """``shortest_text`` of one number."""
    if x == 0 or abs(x) == math.inf or x != x:
        return {math.inf: "Infinity", -math.inf: "-Infinity"}.get(x, "0" if x == 0 else "NaN")
    digits, _, power = f"{Decimal(repr(x)):e}".partition("e")
    if 1e-7 < abs(x) * 1.0000000000000002 < 1e21 and abs(x) >= 1e-6:
        text = f"{Decimal(repr(x)):f}"
        return text.rstrip("0").rstrip(".") if "." in text else text
    digits = digits.rstrip("0").rstrip(".") if "." in digits else digits
    return f"{digits}e{'-' if power.startswith('-') else '+'}{power.lstrip('+-').lstrip('0') or '0'}"


def rate_text(hz: float) -> str:
    """A rate without noise: at most six decimals, or an exponent where those are all zero."""
    if hz == math.inf or hz == math.floor(hz):
        return number_text(hz)
    short = float(fixed(hz, 6))
    if short:
        return number_text(short)
    digits, _, power = f"{hz:.3e}".partition("e")
    return f"{digits}e{power[0]}{power[1:].lstrip('0')}"


def rate_texts(rates: list[float]) -> list[str]:
    """Rates that differ read as differing: where two would not, all are written in full."""
    short = [rate_text(r) for r in rates]
    return short if len(set(short)) == len(set(rates)) else [number_text(r) for r in rates]


def rate_slugs(rates: list[float]) -> list[str]:
    """Names for tables, one a rate."""
    out: list[str] = []
    for text in rate_texts(rates):
        base = name = f"{text.replace('.', '_', 1)}hz"
        n = 2
        while name in out:
            name, n = f"{base}_{n}", n + 1
        out.append(name)
    return out


def seconds_text(seconds: float) -> str:
    text = fixed(seconds, 3)
    return f"{text.rstrip('0').rstrip('.') if '.' in text else text}s"


def fixed_texts(values, decimals: int) -> list[str]:
    """``fixed`` of many numbers. C's rounding is exact too, and differs on ties alone."""
    out = []
    for x in values:
        y = x * 10.0**decimals
        if x != x or not abs(y) < 1e15 or abs(y - math.floor(y) - 0.5) < 1e-6 * (1 + abs(y)):
            out.append(fixed(x, decimals))
        else:
            text = f"{x:.{decimals}f}"
            out.append(text[1:] if text[0] == "-" and not text.strip("-0.") else text)
    return out


def fixed(value: float | None, decimals: int) -> str:
    """The exact binary value to ``decimals`` places, halves away from zero."""
    if value is None or value != value or value in (float("inf"), float("-inf")):
        return ""
    with localcontext() as context:
        context.prec = 1200
        text = f"{Decimal(value).quantize(Decimal(1).scaleb(-decimals), ROUND_HALF_UP):f}"
    return text[1:] if text.startswith("-") and not text.strip("-0.") else text


@F.pandas_udf(StringType())
def fixed_text(values: pd.Series, decimals: pd.Series) -> pd.Series:
    """Meant for distinct values, joined back: Spark's own rounding starts from
    the shortest decimal text and so differs in the last place."""
    return pd.Series([fixed(v, int(d)) for v, d in zip(values, decimals, strict=True)])


def shortest_text(value: Column) -> Column:
    """Shortest text that reads back as the same double: 7, 0.5, 1e+21, 1e-7."""
    text = value.cast("string")
    whole = F.regexp_replace(text, r"\.0$", "")
    parts = F.regexp_extract(text, r"^(-?\d+(?:\.\d+)?)E(-?)(\d+)$", 1)
    power = F.concat(F.regexp_replace(parts, r"\.0$", ""), F.lit("e"), F.when(F.regexp_extract(text, r"E(-?)", 1) == "-", "-").otherwise("+"), F.regexp_extract(text, r"E-?(\d+)$", 1))
    size = F.abs(value)
    plain = F.when((size == F.floor(size)) & (size < 1e15), value.cast("long").cast("string")).otherwise(F.regexp_replace(value.cast("decimal(38,17)").cast("string"), r"\.?0+$", ""))
    return F.when(~text.contains("E"), whole).when((size >= 1e21) | (size < 1e-6), power).otherwise(plain)


def bytes_text(n: int) -> str:
    units, k, size = ["B", "KB", "MB", "GB", "TB", "PB"], 0, float(n)
    while k + 1 < len(units) and float(fixed(size, 1 if k and size < 100 else 0)) >= 1024:
        size, k = size / 1024, k + 1
    return f"{fixed(size, 1 if k and size < 100 else 0)} {units[k]}"


def duration_text(seconds: float) -> str:
    if seconds != seconds or abs(seconds) == float("inf"):
        return "unknown"
    if seconds < 0 or seconds >= 2**53:
        return f"{seconds:g}s"
    ms = int(Decimal(seconds * 1000).quantize(Decimal(1), ROUND_HALF_UP))
    hours, ms = divmod(ms, 3_600_000)
    minutes, ms = divmod(ms, 60_000)
    rest = f"{ms / 1000:.3f}".rstrip("0").rstrip(".")
    if hours:
        return f"{hours}h {minutes:02d}m {ms // 1000:02d}s"
    return f"{minutes}m {ms // 1000:02d}s" if minutes else f"{rest}s"


def physical(codes: np.ndarray, pmin: float, pmax: float, dmin: int, dmax: int) -> np.ndarray:
    """The values of codes in the order of operations of ``plans.convert.scaled``; nan where undefined."""
    if dmax == dmin:
        return np.full(len(codes), np.nan)
    gain = (pmax - pmin) / (dmax - dmin)
    if pmax == pmin:
        return np.full(len(codes), pmin)
    if gain == 0 or not abs(gain) < np.inf:
        return np.full(len(codes), np.nan)
    with np.errstate(over="ignore", invalid="ignore"):
        offset = np.float64(pmax) / gain - dmax
        return gain * (offset + codes) if abs(offset) < np.inf else (codes - dmin) * gain + pmin
