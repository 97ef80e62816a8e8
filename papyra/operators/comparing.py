"""Two states of a base compared unit by unit: by key, then by what units say, so that renamed and split ones are told from new ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from papyra.sources.store import written

#: Share of words that two units have in common from which one is the other renamed, and share of a unit's words that stand in another from which it is a part of it.
SIMILAR, PART = 0.6, 0.8


def _worded(units: DataFrame) -> DataFrame:
    """(type, key, words): the distinct words of each unit's content in lower case."""
    words = F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce("content", F.lit(""))), F.lit(r"([\p{L}\p{Nd}]+)"), 1))
    return units.select("type", "key", words.alias("words"))


def _prefixes(words: DataFrame, order: DataFrame, share: float) -> DataFrame:
    """(type, key, words, word): the rarest words of each unit, so many that one that shares ``share`` of all must share one of these."""
    each = words.select("type", "key", F.explode("words").alias("word")).join(order, "word")
    ranked = each.groupBy("type", "key").agg(F.array_sort(F.collect_list(F.struct("n", "word"))).alias("w"))
    n = F.size("w")
    first = F.slice("w", 1, F.when(n > 0, n - F.ceil(n * share - 1e-9) + 1).otherwise(0).cast("int"))
    return ranked.select("type", "key", F.explode(F.transform(first, lambda x: x["word"])).alias("word")).join(words, ["type", "key"])


def compared(before: DataFrame, after: DataFrame, similar: float = SIMILAR, part: float = PART) -> DataFrame:
    """(type, key, status, other, share) of units (type, key, content, sources) of two states; each unit of either has a row.

    Of equal type and key: same, moved (the same content from other sources), or changed. Of the others, a unit that is
    gone and one that is new are one renamed if each is the other's best match by words in common of all words of both,
    ``similar`` or more. A unit that is gone is split if ``part`` or more of the words of two or more new ones, not
    renamed, stand in it; each of these is a part of the one it shares most with. What is left is removed or added.
    ``other`` is the counterpart (of a split unit none), ``share`` what decided. Ties go to the smaller key. Pairs are
    met by their rarest words, so frequent words pair nothing, and no pair over the thresholds is missed.
    """
    a, b = (written(u.select("type", "key", "content", F.array_sort(F.array_distinct("sources")).alias("sources")), "units") for u in (before, after))
    both = a.join(b.select("type", "key", F.col("content").alias("now"), F.col("sources").alias("from")), ["type", "key"])
    equal = F.col("content").eqNullSafe(F.col("now"))
    status = F.when(~equal, "changed").when(F.col("sources").eqNullSafe(F.col("from")), "same").otherwise("moved")
    kept = both.select("type", "key", status.alias("status"), F.col("key").alias("other"), F.lit(None).cast("double").alias("share"))
    gone, new = (written(_worded(x.join(y, ["type", "key"], "left_anti")), "apart") for x, y in ((a, b), (b, a)))
    order = written(gone.unionByName(new).select(F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("n")), "order")
    mine, theirs = _prefixes(gone, order, similar), _prefixes(new, order, similar)
    met = mine.join(theirs.select("type", "word", F.col("key").alias("other"), F.col("words").alias("said")), ["type", "word"]).dropDuplicates(["type", "key", "other"])
    common = F.size(F.array_intersect("words", "said"))
    share = common / (F.size("words") + F.size("said") - common)
    pairs = met.select("type", "key", "other", F.round(share, 6).alias("share")).filter(F.col("share") >= similar)
    best = lambda me, you: F.row_number().over(Window.partitionBy("type", me).orderBy(F.desc("share"), you))
    renamed = written(pairs.withColumns({"i": best("key", "other"), "j": best("other", "key")}).filter("i = 1 AND j = 1").drop("i", "j"), "renamed")
    left = gone.join(renamed.select("type", "key"), ["type", "key"], "left_anti")
    rest = new.join(renamed.select("type", F.col("other").alias("key")), ["type", "key"], "left_anti")
    whole = left.select("type", F.col("key").alias("whole"), "words", F.explode("words").alias("word"))
    parts = _prefixes(rest, order, part).select("type", "key", F.col("words").alias("said"), "word").join(whole, ["type", "word"]).dropDuplicates(["type", "key", "whole"])
    held = parts.select("type", "key", "whole", F.round(F.size(F.array_intersect("words", "said")) / F.size("said"), 6).alias("share")).filter(F.col("share") >= part)
    held = held.withColumn("i", F.row_number().over(Window.partitionBy("type", "key").orderBy(F.desc("share"), "whole"))).filter("i = 1").drop("i")
    split = written(held.withColumn("n", F.count("*").over(Window.partitionBy("type", "whole"))).filter("n > 1").drop("n"), "split")
    none = lambda t: F.lit(None).cast(t)
    wholes = split.groupBy("type", F.col("whole").alias("key")).agg(F.max("share").alias("share"))
    out = kept
    for rows in (
        renamed.select("type", "key", F.lit("renamed").alias("status"), "other", "share"),
        renamed.select("type", F.col("other").alias("key"), F.lit("renamed").alias("status"), F.col("key").alias("other"), "share"),
        wholes.select("type", "key", F.lit("split").alias("status"), none("string").alias("other"), none("double").alias("share")),
        split.select("type", "key", F.lit("part").alias("status"), F.col("whole").alias("other"), "share"),
        left.join(wholes, ["type", "key"], "left_anti").select("type", "key", F.lit("removed").alias("status"), none("string").alias("other"), none("double").alias("share")),
        rest.join(split, ["type", "key"], "left_anti").select("type", "key", F.lit("added").alias("status"), none("string").alias("other"), none("double").alias("share")),
    ):
        out = out.unionByName(rows)
    return out
