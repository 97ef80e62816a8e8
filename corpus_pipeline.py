"""From raw documents to packed training sequences: five stages, each an operator of papyra.llm.

Every stage takes (spark, docs, sf_dir), docs with at least doc_id, text and source, and all but the last return the
columns of docs as they came, whatever else these hold and are called. Nulls in any column, empty and very long
texts, repeated rows and empty tables are taken as the operators say: a null or empty text is never toxic, has no
lines or near copies, is left out by the mix (it has no words to give) and packs as the end token alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papyra.llm import linededup, mixing, neardup, packing, toxicity
from papyra.llm._util import fresh, settle
from papyra.llm.queries import _vocabulary


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose expected severity is toxic go; rows are judged each."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    names = tuple(fresh(docs, n) for n in ("severity", "grade", "toxic"))
    return toxicity.grade(docs, labels, names=names).filter(~F.col(names[2])).select(docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of runs of lines go; a document of which nothing is left goes too. Where there is n_chars, it is told anew for texts that lost lines."""
    lines, gone = fresh(docs, "n_lines"), fresh(docs, "n_removed")
    out = linededup.dedup(docs, names=(lines, gone)).filter((F.col(gone) == 0) | (F.col(gone) < F.col(lines)))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(F.col(gone) > 0, F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return out.select(docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, that with the smallest id; texts without words all stay."""
    return neardup.drop_near_duplicates(docs).select(docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the schedule takes it (its taken words by its size, rounded: 0, 1 or 2 times), in the order of the schedule."""
    return mixing.mixed(docs).select(docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 2048 tokens."""
    return packing.pack(docs, _vocabulary("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_repeated_lines),
    ("near dedup", drop_near_duplicates),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: No SQL tells what a learned model rejects or what a tokeniser yields; tests/llm/test_pipeline.py holds the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the table documents; each reads what the one before it wrote."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = settle(docs, "stage-" + name.replace(" ", "-"))
    return docs
