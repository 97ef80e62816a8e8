"""Histories of versions: order, ranges and their events, phases, what stands for a time."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from papyra.functions import questions as Q
from papyra.functions import versions as V
from papyra.operators.context import in_span

#: Most phases, key changes of one, units that stand for a version.
PHASES, CHANGES, PER_VERSION = 4, 4, 4
#: Kinds of units as a history lists them, and what says that something came.
KINDS = ("fact", "summary", "concept", "topic", "knowledge_page")
CAME = "introduced|added|shipped|released"


def with_order(units: DataFrame) -> DataFrame:
    """Units that aren't deleted and whose version can be ordered, with its family and numbers."""
    n = V.normalize(F.col("version"))
    return units.filter((F.col("status") != "deleted") & V.known(n)).withColumns({"family": n.startswith("rel-"), "parts": V.parts(n)})


def versions(units: DataFrame) -> DataFrame:
    """(version, place, units): distinct versions, oldest first; families one after the other."""
    g = with_order(units).groupBy("version", "family", "parts").agg(F.count("*").alias("units"))
    return g.select("version", (F.row_number().over(Window.orderBy("family", "parts", "version"))).alias("place"), "units")


def grouped(units: DataFrame) -> DataFrame:
    """Units by version and kind: version, place in it (facts first, then by key), key."""
    rank = F.array_position(F.array(*map(F.lit, KINDS)), F.col("type"))
    return with_order(units).select("version", "key", "type", F.row_number().over(Window.partitionBy("version").orderBy(rank, "key")).alias("place"))


def boundary(units: DataFrame, event: str) -> str | None:
    """The version at which an event came: the oldest of the units that name it and say it came, else of those that name it."""
    said = F.lower(F.concat_ws(" ", "title", "content"))
    u = with_order(units).filter(F.contains(said, F.lit(Q.plain(event)))).withColumn("came", said.rlike(CAME))
    r = u.agg(F.min_by("version", F.when(F.col("came"), F.struct("family", "parts"))).alias("a"), F.min_by("version", F.struct("family", "parts")).alias("b")).first()
    return r["a"] or r["b"]


def in_range(units: DataFrame, span: Q.Range) -> DataFrame:
    """Units of a range, oldest first within (version or time), then by key; nothing for a vague range or an event that no unit names."""
    if span.ambiguous:
        return units.limit(0)
    if span.kind == "event":
        at = boundary(units, span.start or span.end)
        if at is None:
            return units.limit(0)
        span = Q.Range("version", at if span.start else None, at if span.end else None, span.start_in, span.end_in)
    if span.kind == "version":
        return with_order(units).filter(in_span(F.col("version"), span)).select(*units.columns)
    at = F.coalesce(F.nullif("published", F.lit(0)), F.nullif("effective", F.lit(0)))
    out = (F.col("status") != "deleted") & at.isNotNull()
    if span.start is not None:
        out &= (at >= span.start) if span.start_in else (at > span.start)
    if span.end is not None:
        out &= (at <= span.end) if span.end_in else (at < span.end)
    return units.filter(out)


def phases(units: DataFrame, most: int = PHASES) -> DataFrame:
    """(phase, first, last, versions, units, changes, next): a family's versions in runs of one major number, or of equal count where there are more majors than ``most``; up to ``CHANGES`` titles say what changed; ``next`` is where the next begins."""
    u = with_order(units)
    v = u.select("version", "family", "parts").distinct()
    w = Window.partitionBy("family").orderBy("parts", "version")
    all_ = Window.partitionBy("family")
    v = v.withColumns({"i": F.row_number().over(w) - 1, "n": F.count("*").over(all_), "major": F.dense_rank().over(Window.partitionBy("family").orderBy(F.col("parts")[0])) - 1})
    majors = F.max("major").over(all_) + 1
    v = v.withColumn("phase", F.when((majors <= most) & (majors > 1), F.col("major")).otherwise(F.floor(F.col("i") * F.least(F.lit(most), F.col("n")) / F.col("n"))).cast("int"))
    x = u.join(v.select("version", "phase", "i"), "version")
    titles = F.slice(F.transform(F.array_sort(F.collect_set(F.when(F.col("type") == "fact", F.struct(-F.col("i"), "title")))), lambda t: t["title"]), 1, CHANGES)
    g = x.groupBy("family", "phase").agg(F.min(F.struct("i", "version")).alias("a"), F.max(F.struct("i", "version")).alias("b"), F.countDistinct("version").alias("versions"), F.count("*").alias("units"), titles.alias("changes"))
    return g.select("family", "phase", F.col("a.version").alias("first"), F.col("b.version").alias("last"), "versions", "units", "changes", F.lead("a.version").over(Window.partitionBy("family").orderBy("phase")).alias("next"))


def evidence_of(units: DataFrame, chunks: DataFrame, wanted: list[str], per: int = PER_VERSION) -> DataFrame:
    """(version, place, doc_id, chunk, text, score): of each wanted version ``per`` pieces of evidence, by the units' sureness; ``units`` has doc_id and chunk, or node where that is null; the first scores 1000."""
    own = units.filter(F.col("version").isin(wanted))
    by_chunk = own.filter("chunk is not null").join(chunks.select("doc_id", "chunk", "text"), ["doc_id", "chunk"])
    by_node = own.filter("chunk is null").drop("chunk").join(chunks.select("doc_id", "node", "chunk", "text"), ["doc_id", "node"]).select(by_chunk.columns)
    place = F.row_number().over(Window.partitionBy("version").orderBy(F.desc("confidence"), "key", "doc_id", "chunk")) - 1
    e = by_chunk.unionByName(by_node).withColumn("place", place).filter(F.col("place") < per)
    return e.select("version", "place", "doc_id", "chunk", "text", (1000 - F.col("place")).alias("score"))


def differing(old: DataFrame, new: DataFrame, key: str, value: str) -> DataFrame:
    """(key, state) of two tables: added, removed, changed or unchanged. One row a key."""
    a, b = old.select(key, F.struct(F.col(value).alias("v")).alias("a")), new.select(key, F.struct(F.col(value).alias("v")).alias("b"))
    state = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(F.col("a.v").eqNullSafe(F.col("b.v")), "unchanged").otherwise("changed")
    return a.join(b, key, "full").select(key, state.alias("state"))


def sampled(rows: DataFrame, group: str, order: list, best: list, buckets: int) -> DataFrame:
    """Rows that stand for a group's history: it is cut, in order, into ``buckets`` equal stretches, and the best row of each stays, with its bucket from 0."""
    w, all_ = Window.partitionBy(group).orderBy(*order), Window.partitionBy(group)
    r = rows.withColumn("bucket", F.floor((F.row_number().over(w) - 1) * buckets / F.count("*").over(all_)).cast("int"))
    return r.withColumn("__r", F.row_number().over(Window.partitionBy(group, "bucket").orderBy(*best))).filter("__r = 1").drop("__r")


def latest(units: DataFrame, scope: str) -> DataFrame:
    """(scope, family, version): the newest version of each scope and family of those that can be ordered."""
    n = V.normalize(F.col("version"))
    known = units.filter(V.known(n))
    return known.groupBy(scope, n.startswith("rel-").alias("releases")).agg(F.max_by("version", F.struct(V.parts(n), "version")).alias("version"))
