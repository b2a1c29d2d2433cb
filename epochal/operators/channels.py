"""Channels: naming, selection, rate groups. These frames hold a row a channel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lists import listed
from .selection import SelectionError

__all__ = ["SelectionError"]


def base_name() -> Column:
    return F.when(F.col("label") == "", F.concat(F.lit("signal_"), "signal_index")).otherwise(F.col("label"))


def column_names(channels: DataFrame, reserved: str = "time_s", rounds: int = 8) -> DataFrame:
    """``channels`` with column_name: the label, or with _ch<n> where it is shared, until
    no two are equal or the rounds are over."""
    suffixed = F.concat("column_name", F.lit("_ch"), "signal_index")
    shared = F.count(F.lit(1)).over(Window.partitionBy("path", "column_name")) > 1
    named = channels.withColumn("column_name", base_name()).withColumn("shared", shared).withColumn("column_name", F.when(F.col("shared"), suffixed).otherwise(F.col("column_name")))
    for _ in range(rounds):
        named = named.withColumn("shared", shared | (F.col("column_name") == reserved)).withColumn("column_name", F.when(F.col("shared"), suffixed).otherwise(F.col("column_name")))
    return named.drop("shared")


def renamed(channels: DataFrame) -> DataFrame:
    """Channels (with column_name) that lost a name of their own to another column."""
    alone = F.count(F.lit(1)).over(Window.partitionBy("path", base_name())) == 1
    return channels.withColumn("alone", alone).where(F.col("alone") & (F.col("column_name") != base_name())).drop("alone")


def select(channels: DataFrame, terms: list[str]) -> DataFrame:
    """Channels by label (any case, all that share it) or by #position."""
    terms = [t for t in (t.strip().lower() for t in terms) if t]
    label = F.lower(F.trim("label"))
    literal = channels.where(label.isin(terms)).select(label.alias("term")).distinct()
    known = {r.term for r in literal.collect()}  # at most the given terms
    places = [t for t in terms if t.startswith("#") and t not in known]
    if bad := [t for t in places if not t[1:].isascii() or not t[1:].isdigit()]:
        raise SelectionError(f"{bad[0]!r} is not a position such as #0")
    found = channels.where(label.isin(terms) | F.col("signal_index").isin([int(t[1:]) for t in places]))
    present = {f"#{r.signal_index}" for r in found.select("signal_index").distinct().collect()} | known  # bounded by the selection
    missing = [t for t in terms if t not in present]
    if missing or not terms:
        close = [r.label for t in missing[:1] for r in suggest(channels, t).collect()]
        raise SelectionError(f"no channel {', '.join(map(repr, missing))}; close: {listed(close, 3)}")
    return found


def suggest(channels: DataFrame, term: str, most: int = 3) -> DataFrame:
    """The labels nearest to ``term``, at most a third of it away."""
    away = F.levenshtein(F.lower("label"), F.lit(term.lower()))
    near = channels.where(F.col("label") != "").select("label", away.alias("distance")).groupBy("label").agg(F.min("distance").alias("distance"))
    return near.where(F.col("distance") <= max(2, len(term) // 3)).orderBy("distance", "label").limit(most)


def rate_groups(channels: DataFrame) -> DataFrame:
    """Channels with samples, by their number a record; fastest first."""
    members = F.array_sort(F.collect_list("signal_index"))
    return channels.where("samples_per_record > 0").groupBy("path", "samples_per_record").agg(members.alias("members")).orderBy("path", F.desc("samples_per_record"))


def duplicate_labels(channels: DataFrame) -> DataFrame:
    return channels.groupBy("path", "label").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list("signal_index")).alias("members")).where("n > 1")
