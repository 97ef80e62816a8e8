"""Readers of the tables and the views of them that the engine works on."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def chunks(docs: DataFrame) -> DataFrame:
    """Delimiter chunks: the lines of each text that aren't blank; (doc_id, source, idx, text)."""
    pieces = F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")
    return docs.select("doc_id", "source", F.posexplode(pieces).alias("i", "text")).select("doc_id", "source", F.col("i").cast("long").alias("idx"), "text")


def _decoded(raw: bytes) -> str:
    try:
        return raw.decode("utf-8-sig")
    except UnicodeDecodeError:
        return raw.decode("gb18030", "replace")


def text_files(spark: SparkSession, path: str) -> DataFrame:
    """Whole text files (txt, md, csv, json, log are plain text): path, name and text; a BOM goes, bytes that aren't UTF-8 are read as GB18030."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    name = F.element_at(F.split("path", "/"), -1)

    @F.pandas_udf("string")
    def decode(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for raws in parts:
            yield pd.Series([_decoded(bytes(b)) for b in raws], dtype=object)

    return raw.select("path", name.alias("name"), decode("content").alias("text")).filter(~F.col("name").startswith("~$") & F.lower("name").rlike(r"[.](txt|md|markdown|mdx|csv|json|log)$")).orderBy("path")


def gold(spark: SparkSession, path: str) -> DataFrame:
    """A gold question set (JSON lines); rows that break a rule carry it in ``problem``."""
    schema = "question_id string, question string, gold_answer string, expected_abstain boolean, category string, gold_evidence_locators array<struct<document: string, needle: string>>"
    q = spark.read.schema(schema).json(path)
    n = F.coalesce(F.size("gold_evidence_locators"), F.lit(0))
    abstain = F.coalesce("expected_abstain", F.lit(False))
    twice = q.groupBy("question_id").count().filter("count > 1").select("question_id", F.lit(True).alias("twice"))
    return q.join(twice, "question_id", "left").withColumn(
        "problem",
        F.when(F.coalesce("question_id", F.lit("")) == "", "no id").when(F.col("twice"), "repeated id").when(F.coalesce("question", F.lit("")) == "", "no question")
        .when(abstain & (n > 0), "abstains with evidence").when(~abstain & ((n == 0) | F.col("gold_answer").isNull()), "no evidence or answer"),
    ).drop("twice")
