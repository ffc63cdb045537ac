"""The corpus pipeline: quality rules, language, near-duplicates, mixture order, packing.

Each stage takes (spark, docs, sf_dir); what it returns is written as Parquet and read
again as the next stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

import re
import threading
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from firmscope.llm import langid, mixing, neardup, packing, quality
from firmscope.llm.common import column, drop, fresh, noting, stage

#: Tables that the last stage staged for itself, by the run it belongs to: its thread and its folder of tables.
_left: dict[tuple[int, str], list[str]] = {}


def _alone(apply):
    """A stage that first drops what the stage before it in this run left behind, unless docs still reads it (an unwritten result)."""

    @wraps(apply)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        left = _left.setdefault((threading.get_ident(), sf_dir), [])
        if left and not any(p.rsplit("/", 1)[-1] in f for p in left for f in docs.inputFiles()):
            drop(spark, left)
            left.clear()
        with noting() as made:
            out = apply(spark, docs, sf_dir)
        left.extend(made)
        return out

    return run_stage


@_alone
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rule or are outliers of their language and source go.

    Null and empty texts fail the base rule; repeated rows stay or go together; null languages and sources are groups; an empty table stays empty.
    """
    return quality.keep_good(docs)


@_alone
def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can't be told go: no letter (null and empty texts too), or no language of at least even odds.

    Where no row names a language, nothing can be told and all go. Repeated rows stay or go together; an empty table stays empty.
    """
    return langid.keep_identified(docs)


@_alone
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays, the one with the least doc_id, and of repeated rows of a doc_id one.

    Texts without words are linked with nothing and stay, as do rows without a doc_id; an empty table stays empty.
    """
    return neardup.keep_one_each(docs)


@_alone
def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in the order of the Pfair schedule, so every prefix of the written table holds the target weights until a source runs out.

    A null source is a source; rows without a doc_id come first in theirs; repeated rows all stay, in any order among themselves; an empty table stays empty.
    """
    mixed = mixing.mix_sources(docs)
    return mixed.repartitionByRange("mix_slot").sortWithinPartitions("mix_slot", "mix_place").select(*docs.columns)


def in_written_order(spark: SparkSession, docs: DataFrame) -> tuple[DataFrame, str]:
    """The rows of a table read from Parquet with their number from 0 in the order they were written in, and its column's name.

    That order is all the mixing stage can hand on, as it returns the columns of documents. Spark's
    writer numbers a file by its partition, and a row has a place in its file, however files are split for reading.
    """
    at, first, path = docs.metadataColumn("_metadata"), fresh(docs, "first"), fresh(docs, "path")
    place = fresh(docs, "place")
    sizes = docs.groupBy(at["file_path"].alias("path")).agg(F.count(F.lit(1)).alias("n")).collect()  # one row a file

    def number(r) -> tuple:
        name = r["path"].rsplit("/", 1)[-1]
        part = re.match(r"part-(\d+)-.*-c(\d+)", name)
        return (int(part[1]), int(part[2]), r["path"]) if part else (-1, -1, r["path"])

    starts, n = [], 0
    for r in sorted(sizes, key=number):
        starts.append((r["path"], n))
        n += r["n"]
    before = spark.createDataFrame(starts, f"`{path}` string, `{first}` long")
    rows = docs.select("*", at["file_path"].alias(place + "_path"), at["row_index"].alias(place + "_row"))
    rows = rows.join(F.broadcast(before), F.col(place + "_path") == F.col(path))
    return rows.select(*[column(docs, c) for c in docs.columns], (F.col(first) + F.col(place + "_row")).alias(place)), place


@_alone
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents' ids in sequences of at most 2048, in the order of the mixture; tasks share their memory with what earlier stages left in it.

    A null or empty text is its end id alone; very long texts are cut into full windows; repeated rows are packed each; an empty table gives no pieces.
    """
    placed, place = in_written_order(spark, docs)
    return packing.pack_documents(placed, remember=300_000, place_col=place)


STAGES = [
    ("quality rules", quality_rules),
    ("language ID", language),
    ("MinHash near-dedup", near_duplicates),
    ("mixing sources to target weights", mix),
    ("packing", pack),
]

#: Stages of learned and iterative kind have no SQL form; tests/llm/test_pipeline.py holds run() against a plain Python pipeline.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir, each read from what the one before wrote, which is dropped once it is read."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, apply in STAGES:
        with noting() as written:
            docs = stage(apply(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
        drop(spark, before)
        before = [p for p in written if p.rsplit("/", 1)[-1].startswith("stage-")]
    left = _left.pop((threading.get_ident(), sf_dir), [])
    drop(spark, left)
    return docs
