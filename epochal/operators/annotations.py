"""Time-stamped annotation lists: slots of bytes to events, record starts and losses.

A slot holds lists that end in NUL. A list is an onset with its sign, perhaps
0x15 and a duration, then texts between 0x14. The first list of the slot of a
recording's first annotation channel states when the record starts, whether it
can be read or not. A list is UTF-8 as a whole, or else Latin-1.

``slots`` has (path, record_index, signal_index, timekeeping, slot).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import decode_text

NUMBER = r"(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?"
ONSET = rf"^([+-]{NUMBER})\s*(?:\x15([^\x14]*))?(?:\x14|$)"
PADDING = r"^[ \t\r\n\x00]*$"
TEXT_AFTER = r"\x14[^\x14]*[^ \t\r\n\x00\x14]"


def finite(text: Column) -> Column:
    value = text.try_cast("double")
    return F.when(F.abs(value) < float("inf"), value)


def lists(slots: DataFrame) -> DataFrame:
    """A row per list: its ordinal in the slot, onset, duration and its texts."""
    chunk = F.split(F.decode("slot", "ISO-8859-1"), "\x00")
    rows = slots.select("path", "record_index", "signal_index", "timekeeping", F.posexplode(chunk).alias("place", "raw")).where(~F.rlike("raw", F.lit(PADDING)))
    first = F.col("place") == F.min("place").over(Window.partitionBy("path", "record_index", "signal_index"))
    onset, duration = F.regexp_extract("raw", ONSET, 1), F.trim(F.regexp_extract("raw", ONSET, 2))
    length = F.when(F.rlike(duration, F.lit(rf"^[+-]?{NUMBER}$")), finite(duration))
    return rows.select(
        "path", "record_index", "signal_index", F.col("place").alias("ordinal"), "raw",
        (F.col("timekeeping") & first).alias("keeps_time"),
        F.when(onset != "", finite(onset)).alias("onset_s"),
        length.alias("duration_s"),
        ((duration != "") & length.isNull()).alias("duration_unreadable"),
        F.slice(F.split(decode_text(F.encode("raw", "ISO-8859-1")), "\x14"), 2, 1 << 30).alias("texts"),
    )


def events(slots: DataFrame) -> DataFrame:
    """A row per text that isn't blank, with the ordinals that order ties."""
    rows = lists(slots).where("onset_s is not null").select("*", F.posexplode("texts").alias("text_ordinal", "description")).where(~F.rlike("description", F.lit(PADDING)))
    return rows.select("path", "onset_s", "duration_s", "description", "record_index", "signal_index", "ordinal", "text_ordinal", "duration_unreadable")


ORDER = ["onset_s", "record_index", "signal_index", "ordinal", "text_ordinal"]


def ordered(found: DataFrame) -> DataFrame:
    return found.orderBy("path", *ORDER)


def within(found: DataFrame, start: Column | float | None = None, end: Column | float | None = None) -> DataFrame:
    """Events whose onset lies in the half-open window as it was asked for."""
    lower = F.lit(True) if start is None else F.col("onset_s") >= start
    return found.where(lower & (F.lit(True) if end is None else F.col("onset_s") < end))


def declared_starts(slots: DataFrame) -> DataFrame:
    """(path, record_index, declared_s): the first list of the timekeeping slot, even if unreadable."""
    return lists(slots).where("keeps_time").select("path", "record_index", F.col("onset_s").alias("declared_s"))


def decode_faults(slots: DataFrame) -> DataFrame:
    """Counts a recording: lists that no event could be read from, records whose start
    couldn't be read, how many of those held texts too, and events whose duration is
    negative or isn't a number. A lost list is malformed unless it only kept time."""
    held = F.rlike("raw", F.lit(TEXT_AFTER))
    lost = F.col("onset_s").isNull()
    texts = F.when(~lost, F.size(F.filter("texts", lambda t: ~F.rlike(t, F.lit(PADDING))))).otherwise(0)
    counts = {"malformed": lost & (~F.col("keeps_time") | held), "lost_starts": lost & F.col("keeps_time"), "lost_starts_with_text": lost & F.col("keeps_time") & held}
    return lists(slots).groupBy("path").agg(
        *(F.count_if(v).alias(k) for k, v in counts.items()),
        F.sum(F.when(F.col("duration_unreadable"), texts).otherwise(0)).alias("unreadable_durations"),
        F.sum(F.when(F.col("duration_s") < 0, texts).otherwise(0)).alias("negative_durations"),
    )
