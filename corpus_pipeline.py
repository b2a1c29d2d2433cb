"""From documents to packed sequences: one operator a stage, each stage's rows
written and read again as the next one's documents."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from epochal.llm.common import Workspace, table, written
from epochal.llm.decontaminate import decontaminated
from epochal.llm.neardup import near_duplicates
from epochal.llm.packing import packed
from epochal.llm.pii import redact
from epochal.llm.quality import quality

#: Ids of near-duplicates that are broadcast at most, so that texts stay where they are.
MOST_DROPPED = 2_000_000


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows ride along as a whole, so that no column of theirs meets a drawn one, and
    aren't stored, so that no copy of all documents lies beside the next stages' tables."""
    whole = docs.select("text", F.struct(*docs.columns).alias("__row"))
    return quality(whole, carry=["__row"], stored=False).where("kept").select("__row.*")


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row without an id stays, and so do rows that repeat an id that stays."""
    ids = near_duplicates(docs).groupBy(F.col("doc_id").alias("__id")).agg(F.max("kept").alias("kept"))
    dropped = written(ids.where("NOT kept").select("__id"), "dropped-ids")
    few = dropped.count() <= MOST_DROPPED
    return docs.join(dropped.hint("broadcast" if few else "merge"), F.col("doc_id") == F.col("__id"), "left_anti")


def cut_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminated(docs, table(spark, sf_dir, "benchmark"))


def hide_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return redact(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packed(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality", keep_good), ("near-dedup", keep_one_of_each), ("decontamination", cut_benchmarks), ("pii", hide_personal_data), ("packing", pack_sequences)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stage's documents are deleted once the next one's are written."""
    docs, work = table(spark, sf_dir, "documents"), Workspace(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        docs = work.write(stage(spark, docs, sf_dir), name)
        work.clear(docs)
    return STAGES[-1][1](spark, docs, sf_dir)
