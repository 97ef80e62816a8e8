"""Line dedup: a suffix array over line ids by distributed prefix doubling; later copies of repeated runs go.

A document is a sequence of line ids (128-bit hashes). Suffixes that start at a
line which occurs once cannot repeat, so only stretches of repeated lines are
carried on. Their suffixes are rows (document, position, rank). In the first
round the rank is the place of the line's id in the sorted list of all ids; each
later round sorts the pairs of ranks at i and i + h of all suffixes, over all
tasks, and the place of a pair is the rank at depth 2h. Suffixes whose pair
occurs once leave the array.

Suffixes of equal rank at depth h are an interval of the suffix array with a
longest common prefix of h lines or more; the pair of ranks of two overlapping
stretches of h lines names the interval of any depth between h and 2h. A run of
lines is deleted if it has ``min_words`` words or more and its interval has an
earlier member. A line lies in such a run exactly if it lies in the shortest such
run that starts at some line, or in the shortest that ends at some line, so two
intervals per line decide, the array need be sorted only as deep as the longest
of these, and the runs found are put together to the maximal repeated ones.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from papyra.llm._util import WORD, cut, fresh, join_counted, numbered, parts_for, sent_if_small


def row_key(doc_id: Column, text: Column, row: Column) -> Column:
    """128 bits that stand for a document's id and text; for a row without an id, for its place in the table."""
    said = F.concat(doc_id.cast("string"), F.lit(":"), F.coalesce(text, F.lit("")))
    lone = F.concat_ws(":", F.lit("row"), row["file"].cast("string"), row["at"].cast("string"))
    return F.unhex(F.md5(F.coalesce(said, lone).cast("binary")))


def shortest_runs(words: np.ndarray, least: int) -> set[tuple[int, int]]:
    """(start, length) of the shortest run with ``least`` words that starts, and that ends, at each line."""
    total = np.concatenate([[0], np.cumsum(words)])
    out = set()
    ends = np.searchsorted(total, total[:-1] + least)
    out.update((s, int(e) - s) for s, e in enumerate(ends) if e < len(total))
    starts = np.searchsorted(total, total[1:] - least, side="right") - 1
    out.update((int(s), e + 1 - int(s)) for e, s in enumerate(starts) if s >= 0)
    return out


def _stretches(min_words: int):
    """Of each document the repeated lines that lie in a stretch with words enough, and the runs to be looked up."""

    def f(batches):
        for b in batches:
            rows = []
            for key, lines in zip(b["key"], b["lines"], strict=True):
                pos, rank, words = (np.array([x[c] for x in lines], np.int64) for c in ("pos", "r", "words"))
                order = np.argsort(pos)
                pos, rank, words = pos[order], rank[order], words[order]
                at, starts, lengths = [], [], []
                for own in np.split(np.arange(len(pos)), np.flatnonzero(np.diff(pos) > 1) + 1):
                    if words[own].sum() >= min_words:
                        at.append(own)
                        runs = sorted(shortest_runs(words[own], min_words))
                        starts += [int(pos[own[0]]) + s for s, _ in runs]
                        lengths += [n for _, n in runs]
                if at:
                    at = np.concatenate(at)
                    rows.append((key, pos[at], rank[at], starts, lengths))
            out = pd.DataFrame(rows, columns=["key", "pos", "r", "start", "n"])
            yield out.merge(b.drop(columns="lines"), on="key")

    return f


def _kept(batches):
    """From runs that go, put together to maximal ones, the ranges of lines that stay."""
    for b in batches:
        keep = []
        for starts, lengths, lines in zip(b["start"], b["n"], b["n_lines"], strict=True):
            at, own = 0, []
            for s, n in sorted(zip(starts, lengths, strict=True)):
                if s > at:
                    own.append({"from": at, "to": s})
                at = max(at, s + n)
            if at < lines:
                own.append({"from": at, "to": lines})
            keep.append(own)
        yield pd.DataFrame({"key": b["key"], "keep": keep})


def ranked(table: DataFrame, keys: list, name: str) -> DataFrame:
    """A written table, sorted over all tasks; the column ``name`` numbers its rows in that order."""
    n = parts_for(table, 32, least=1)
    return cut(table.repartitionByRange(n, *keys).sortWithinPartitions(*keys).withColumn(name, F.monotonically_increasing_id()), "ranked")


def doubled(level: DataFrame, h: int) -> DataFrame:
    """(d, pos, r) at depth 2h from the same at depth h, for suffixes that share so many lines with another.

    Between i and i + h all suffixes of a repeated pair are repeated themselves, so they are the next h rows.
    """
    w = Window.partitionBy("d").orderBy("pos")
    pairs = level.select("d", "pos", F.col("r").alias("r1"), F.lead("r", h).over(w).alias("r2"), F.lead("pos", h).over(w).alias("p2"))
    pairs = cut(pairs.filter(F.col("p2") == F.col("pos") + h).drop("p2"), "pairs")
    groups = cut(pairs.groupBy("r1", "r2").agg(F.count("*").alias("n")).filter("n > 1"), "groups")
    return cut(join_counted(pairs, ranked(groups, ["r1", "r2"], "r"), ["r1", "r2"], "n").select("d", "pos", "r"), "level")


def find(docs: DataFrame, min_words: int = 20) -> DataFrame:
    """(key, keep) of (doc_id, key, text): the ranges of lines, from 0, that do not repeat earlier ones, for each document that has any that do."""
    lines = docs.select("doc_id", "key", F.split(F.coalesce("text", F.lit("")), "\n").alias("lines"))
    seqs = lines.select(
        "doc_id",
        "key",
        F.transform("lines", lambda x: F.xxhash64(x)).alias("a"),
        F.transform("lines", lambda x: F.xxhash64(F.lit(1), x)).alias("b"),
        F.transform("lines", lambda x: F.regexp_count(x, F.lit(WORD))).alias("words"),
    )
    seqs = cut(seqs.dropDuplicates(["key"]), "lines")
    at = seqs.select("key", F.posexplode(F.arrays_zip("a", "b", "words")).alias("pos", "x")).select("key", "pos", "x.a", "x.b", "x.words")
    names = cut(at.groupBy("a", "b").agg(F.count("*").alias("n")).filter("n > 1"), "names")
    open_ = join_counted(at, ranked(names, ["a", "b"], "r"), ["a", "b"], "n")
    of_doc = open_.groupBy("key").agg(F.collect_list(F.struct("pos", "r", "words")).alias("lines"))
    of_doc = of_doc.join(seqs.select("key", "doc_id", F.size("a").alias("n_lines")), "key")
    id_type = docs.schema["doc_id"].dataType.simpleString()
    schema = f"key binary, pos array<int>, r array<long>, start array<int>, n array<int>, doc_id {id_type}, n_lines int"
    # null ids come last, by their keys; equal ids are told apart by their texts
    order = [F.col("doc_id").isNull(), F.col("doc_id"), F.col("key")]
    kept = ranked(cut(of_doc.mapInPandas(_stretches(min_words), schema), "stretches"), order, "d")
    level = cut(kept.select("d", F.explode(F.arrays_zip("pos", "r")).alias("x")).select("d", "x.pos", "x.r"), "level")
    runs = kept.select("d", F.explode(F.arrays_zip("start", "n")).alias("x")).select("d", "x.start", "x.n")
    runs = cut(runs.withColumn("k", F.floor(F.log2("n") + 1e-9).cast("int")), "runs")
    deepest, named = runs.agg(F.max("k")).first()[0], None
    for k in range(0 if deepest is None else deepest + 1):
        if k:
            level = doubled(level, 1 << (k - 1))
        own = runs.filter(F.col("k") == k).withColumn("tail", F.col("start") + F.col("n") - (1 << k))
        own = own.join(level.select("d", F.col("pos").alias("start"), F.col("r").alias("r1")), ["d", "start"])
        own = own.join(level.select("d", F.col("pos").alias("tail"), F.col("r").alias("r2")), ["d", "tail"]).select("d", "start", "n", "r1", "r2")
        named = own if named is None else named.unionByName(own)
    if named is None:
        return docs.sparkSession.createDataFrame([], "key binary, keep array<struct<from:int,to:int>>")
    named, place = cut(named, "intervals"), F.struct("d", "start")
    firsts = cut(named.groupBy("n", "r1", "r2").agg(F.min(place).alias("first"), F.count("*").alias("members")).filter("members > 1"), "firsts")
    later = join_counted(named, firsts, ["n", "r1", "r2"], "members").filter(place > F.col("first"))
    gone = later.groupBy("d").agg(F.collect_list("start").alias("start"), F.collect_list("n").alias("n"))
    return gone.join(kept.select("d", "key", "n_lines"), "d").mapInPandas(_kept, "key binary, keep array<struct<from:int,to:int>>")


def dedup(docs: DataFrame, min_words: int = 20, names: tuple[str, str] = ("n_lines", "n_removed")) -> DataFrame:
    """``docs`` (doc_id, text, ...) without the lines that belong to a later copy of a run of ``min_words`` words or more.

    The earliest copy, by (doc_id, text, line), stays. Adds the number of lines and of those removed under ``names``;
    all other columns stay as they are, and an input column of one of these names is replaced. Order of lines and the
    text of those that stay are kept; a document all of whose lines go has the text ''. Null texts stay null and have
    no lines. Rows with equal doc_id and equal text count as one document: they are treated alike and are no copies of
    each other. Rows without an id are a document each and come after all others, in an order of their own. Copies within one document count. A text of any length is one
    sequence; an empty table gives an empty table. Lines are told apart by 128 bits.
    """
    key, keep = fresh(docs, "key"), fresh(docs, "keep")
    docs, row = numbered(docs, "linededup-docs")
    docs = docs.withColumn(key, row_key(F.col("doc_id"), F.col("text"), F.col(row))).drop(row)
    found = cut(find(docs.select("doc_id", F.col(key).alias("key"), "text"), min_words), "kept")
    found = sent_if_small(found, F.size("keep") * 16 + 64).select(F.col("key").alias(key), F.col("keep").alias(keep))
    both = docs.join(found, key, "left")
    lines = F.split("text", "\n")
    rest = F.flatten(F.transform(keep, lambda r: F.slice(lines, r["from"] + 1, r["to"] - r["from"])))
    n = F.when(F.col("text").isNull(), 0).otherwise(F.size(lines)).cast("long")
    gone = F.when(F.col(keep).isNull(), 0).otherwise(n - F.aggregate(keep, F.lit(0), lambda s, r: s + r["to"] - r["from"])).cast("long")
    text = F.when(F.col(keep).isNull(), F.col("text")).otherwise(F.array_join(rest, "\n"))
    return both.withColumns({names[0]: n, names[1]: gone, "text": text}).drop(key, keep)
