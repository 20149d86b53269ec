"""A corpus pipeline: stages over the documents table, each written as Parquet and read again as the next one's documents.

All stages but the last return the columns of documents, whatever their names. A stage takes a table read from files, as rows are told
apart by their place in them; run() sees to that.

Cases, for all stages: a null doc_id, source or lang is a value like others; null texts and texts without a letter go in the first stage, as they have
no language, and match nothing in later ones; texts are read whole, however long; rows alike in doc_id and text are copies, of which the second stage
keeps one; ties (which of a class stays, which of rows alike are taken or cut apart) go to the least doc_id, then to a hash of all columns, so that a rerun keeps
the same rows; an empty table gives an empty table at every stage; extra
columns are kept, but for any named shard or slot in the last stage, which are replaced.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowtide.llm import common, decontam, langid, mixing, neardup, sharding
from flowtide.session import ship, temporary

#: Names of the columns that the stages add on the way; documents may have columns of any other name.
COPIES, COPY = "_flowtide_copies", "_flowtide_copy"


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a letter and those of which no language holds 30 % of the letters."""
    ship(spark)
    return langid.known_only(docs, langid.learn(docs.where(~langid.held_out()).select("doc_id", "text", "lang")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each class of near duplicates, the one with the least doc_id."""
    ship(spark)
    columns, docs = common.quoted(docs.columns), common.with_row(docs.withColumn(common.ALIKE, common.alike(docs)))
    heads = neardup.near_duplicates(docs).where("keep").select(common.ROW)
    return docs.join(heads, common.ROW, "left_semi").select(*columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a passage of the benchmark table."""
    ship(spark)
    return decontam.clean_only(docs, common.table(spark, sf_dir, "benchmark"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat or drop documents by the words that the mix takes of them; a part of a document becomes a whole one or none by a seeded draw."""
    columns, docs = common.quoted(docs.columns), common.with_row(docs.withColumn(common.ALIKE, common.alike(docs)))
    taken = mixing.mix(docs, keep=(common.ROW, common.ALIKE), tie=(common.ALIKE,)).where("taken > 0")
    draw = F.pmod(F.xxhash64(F.lit(mixing.SEED), "doc_id", common.ALIKE), F.lit(1 << 20)) / (1 << 20)
    copies = taken.select(common.ROW, F.floor(F.col("taken") / F.col("size") + draw).cast("int").alias(COPIES)).where(F.col(COPIES) > 0)
    return docs.join(copies, common.ROW).withColumn(COPY, F.explode(F.sequence(F.lit(1), COPIES))).select(*columns)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lay the documents, landed by source, into shards of equal bytes; adds shard and slot."""
    columns = common.quoted([c for c in docs.columns if c not in ("shard", "slot")])
    rows = sharding.keyed(common.with_row(docs), sharding.landed_shard(), sharding.size_of(), tuple(docs.columns))
    placed = sharding.plan(rows).placed(rows.drop("shard"))
    return sharding.with_slots(placed).select(*columns, "shard", "slot")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language ID", language),
    ("MinHash near-dedup", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("mixing to target weights", source_mix),
    ("sharding", shards),
]

#: No SQL expresses the language model, the signatures or the banded alignment of the first three stages; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        with temporary(spark) as made:
            docs = common.store(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
            made.pop()  # the result stays, the tables on the way to it go
    return docs
