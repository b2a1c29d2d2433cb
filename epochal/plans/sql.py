"""Functions for SQL: annotation lists as a table function, calibration as expressions."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from ..operators.annotations import NUMBER, ONSET, PADDING

LISTS = "ordinal int, onset_s double, duration_s double, text_ordinal int, description string, duration_unreadable boolean"
ONSETS, NUMBERS, BLANK = re.compile(ONSET.encode()), re.compile(rf"[+-]?{NUMBER}".encode()), re.compile(PADDING.encode())
# What SQL calls a physical value, its step, and the decimals that show the step, by the rules of ``plans.convert.scaled`` and ``functions.numbers``.
EXPRESSIONS = {
    "sample_gain(pmin DOUBLE, pmax DOUBLE, dmin BIGINT, dmax BIGINT) RETURNS DOUBLE": "try_divide(pmax - pmin, CAST(dmax - dmin AS DOUBLE))",
    "physical_value(digital INT, pmin DOUBLE, pmax DOUBLE, dmin BIGINT, dmax BIGINT) RETURNS DOUBLE": """CASE WHEN dmax <> dmin AND abs(sample_gain(pmin, pmax, dmin, dmax)) < double('infinity') THEN
        CASE WHEN pmax = pmin THEN pmin
        WHEN sample_gain(pmin, pmax, dmin, dmax) <> 0 AND abs(try_divide(pmax, sample_gain(pmin, pmax, dmin, dmax)) - dmax) < double('infinity') THEN sample_gain(pmin, pmax, dmin, dmax) * (try_divide(pmax, sample_gain(pmin, pmax, dmin, dmax)) - dmax + digital)
        WHEN sample_gain(pmin, pmax, dmin, dmax) <> 0 THEN (digital - dmin) * sample_gain(pmin, pmax, dmin, dmax) + pmin END END""",
    "epoch_of(time_s DOUBLE, seconds DOUBLE) RETURNS BIGINT": "CAST(floor(time_s / seconds) AS BIGINT)",
}


def finite(number: bytes) -> float | None:
    value = float(number)
    return value if abs(value) < float("inf") else None


class TalDecode:
    """A row per text that isn't blank of the lists of a slot, as ``operators.annotations`` reads them."""

    def eval(self, slot: bytes) -> Iterator[tuple]:
        for ordinal, raw in enumerate((slot or b"").split(b"\0")):
            found = ONSETS.search(raw)
            onset = finite(found[1]) if found and not BLANK.search(raw) else None
            if onset is None:
                continue
            length = (found[2] or b"").strip(b" ")
            duration = finite(length) if NUMBERS.fullmatch(length) else None
            try:
                text = raw.decode()
            except UnicodeDecodeError:
                text = raw.decode("latin-1")
            for k, description in enumerate(text.split("\x14")[1:]):
                if not re.search(PADDING, description):
                    yield ordinal, onset, duration, k, description, bool(length) and duration is None


def register(spark: SparkSession) -> None:
    """``tal_decode(slot)``, a table, and the expressions above in this session's SQL."""
    spark.udtf.register("tal_decode", udtf(TalDecode, returnType=LISTS))
    for signature, body in EXPRESSIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURN {body}")
