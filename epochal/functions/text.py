"""Text as column expressions: decoding, header fields, dates, CSV fields."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space of header fields, with the no-break space.
SPACE = r"[\s\x0B ]"
NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def decode_latin1(raw: Column) -> Column:
    return F.decode(raw, "ISO-8859-1")


def decode_text(raw: Column) -> Column:
    """UTF-8 where the bytes are valid, else Latin-1."""
    return F.coalesce(F.try_validate_utf8(raw.cast("string")), decode_latin1(raw))


def trim_field(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"[\s\x0B \x00]+$", ""), f"^{SPACE}+", "")


def header_number(text: Column) -> Column:
    """A decimal number, with one comma for the point allowed; else NULL."""
    pointed = F.when(text.contains("."), text).otherwise(F.regexp_replace(text, r"^([^,]*),", "$1."))
    return F.when(F.rlike(pointed, F.lit(NUMBER)), pointed).try_cast("double")


def stated_date(recording_id: Column) -> Column:
    """struct(day, month, year) of a recording field's Startdate, or NULL."""
    part = [F.regexp_extract(recording_id, r"^\s*Startdate\s+(\d{2})-([A-Za-z]{3})-(\d{4})(?:\s|$)", k) for k in (1, 2, 3)]
    month = (F.position(F.upper(part[1]), F.lit("JANFEBMARAPRMAYJUNJULAUGSEPOCTNOVDEC")) + 2) / 3
    known = (part[0] != "") & (month == F.floor(month)) & (month >= 1)
    return F.when(known, F.struct(part[0].try_cast("int").alias("day"), month.cast("int").alias("month"), part[2].try_cast("int").alias("year")))


def date_parts(date: Column) -> list[Column]:
    """Day, month and two-digit year of dd.mm.yy, or NULL."""
    return [F.regexp_extract(date, r"^(\d\d)[./-](\d\d)[./-](\d\d)$", k).try_cast("int") for k in (1, 2, 3)]


def start_datetime(date: Column, time: Column, recording_id: Column | None = None) -> Column:
    """dd.mm.yy and hh.mm.ss; 85 to 99 are 19xx, unless the recording field states the same
    day, month and short year in full; a 60th second is the 59th; a date that the calendar
    lacks is NULL."""
    t = [F.regexp_extract(time, r"^(\d\d)[.:-](\d\d)[.:-](\d\d)$", k).try_cast("int") for k in (1, 2, 3)]
    (day, month, yy), (hour, minute, second) = date_parts(date), t
    year = F.when(yy >= 85, yy + 1900).otherwise(yy + 2000)
    if recording_id is not None:
        told = stated_date(recording_id)
        year = F.when(same_date(told, day, month, yy), told["year"]).otherwise(year)
    second = F.when(second == 60, 59).otherwise(second)
    return F.try_to_timestamp(F.format_string("%04d-%02d-%02d %02d:%02d:%02d", year, month, day, hour, minute, second), F.lit("yyyy-MM-dd HH:mm:ss")).cast("timestamp_ntz")


def same_date(told: Column, day: Column, month: Column, yy: Column) -> Column:
    return F.coalesce((told["day"] == day) & (told["month"] == month) & (told["year"] % 100 == yy), F.lit(False))


def date_mismatch(date: Column, recording_id: Column) -> Column:
    """Whether the two dates of a header contradict each other."""
    told, (day, month, yy) = stated_date(recording_id), date_parts(date)
    return F.coalesce(told.isNotNull() & day.isNotNull() & ~same_date(told, day, month, yy), F.lit(False))


def clock_text(instant: Column) -> Column:
    return F.date_format(instant, "yyyy-MM-dd'T'HH:mm:ss")


def printable(text: Column) -> Column:
    """Control characters as \\xNN; few texts have any, so each is replaced in turn."""
    codes = [*range(32), *range(127, 160)]
    shown = text
    for k in codes:
        shown = F.replace(shown, F.lit(chr(k)), F.lit(f"\\x{k:02x}"))
    return F.when(has_control(text), shown).otherwise(text)


def starts_formula(text: Column) -> Column:
    """Whether a spreadsheet would take the text for a formula."""
    number = F.rlike(text, F.lit(r"^-(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"))
    return F.rlike(text, F.lit(r"^[=+@]")) | (text.startswith("-") & (F.length(text) > 1) & ~number)


def has_control(text: Column) -> Column:
    return F.rlike(text, F.lit(r"[\x00-\x1f\x7f-\x9f]"))


def csv_field(text: Column) -> Column:
    return F.when(F.rlike(text, F.lit('["\\r\\n,]')), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)


def format_name(is_bdf: Column, continuity: Column) -> Column:
    kind = F.when(is_bdf, "BDF").otherwise("EDF")
    return F.when(continuity.isNull(), kind).otherwise(F.concat(kind, F.when(continuity.endswith("C"), "+ (continuous)").otherwise("+ (discontinuous)")))


def wall_clock(start: Column, seconds: Column) -> Column:
    """Zone-less instant of a sample, cut to microseconds."""
    return start + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds.cast("decimal(18,6)"))
