"""Stored files held against what refers to them: what is lost, left over, damaged or miscounted, and its repair."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value: how long a file that nothing refers to is kept in quarantine, in milliseconds.
KEPT_MS = 7 * 24 * 3600 * 1000


def listed(spark: SparkSession, folder: str) -> DataFrame:
    """(path, bytes, changed) of all files under a folder, by their names in it; their content isn't read."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "length", F.unix_millis("modificationTime").alias("changed"))
    home = spark._jvm.org.apache.hadoop.fs.Path(folder)
    home = home.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(home).toString()
    return raw.select(F.substring("path", F.lit(len(home) + 2), F.length("path")).alias("path"), F.col("length").alias("bytes"), "changed")


def reconciled(files: DataFrame, references: DataFrame) -> DataFrame:
    """(path, finding, bytes): files (path, bytes and, if known, sha256) against references (path, bytes, sha256) of documents and of generations.

    orphan: a file that nothing refers to; missing: a reference without a file; damaged: another size or digest than the
    reference's. Sound files have no row; what is null on either side isn't compared. Files and references of one path
    count once.
    """
    digest = F.max("sha256") if "sha256" in files.columns else F.lit(None).cast("string")
    f = files.groupBy("path").agg(F.max("bytes").alias("have"), digest.alias("is"))
    r = references.filter("path is not null and path <> ''").groupBy("path").agg(F.max("bytes").alias("want"), F.max("sha256").alias("said"))
    both = f.withColumn("there", F.lit(True)).join(r.withColumn("told", F.lit(True)), "path", "full")
    wrong = (F.col("have") != F.col("want")) | (F.col("is") != F.col("said"))
    finding = F.when(F.col("told").isNull(), "orphan").when(F.col("there").isNull(), "missing").when(wrong, "damaged")
    return both.select("path", finding.alias("finding"), F.coalesce("have", "want").alias("bytes")).filter("finding is not null")


def miscounted(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """(doc_id, told, counted) of documents (doc_id, chunk_count) whose number of chunks (doc_id) isn't what they say; a null count is 0."""
    n = chunks.groupBy("doc_id").agg(F.count("*").alias("counted"))
    both = documents.select("doc_id", F.coalesce("chunk_count", F.lit(0)).cast("long").alias("told")).join(n, "doc_id", "left")
    return both.withColumn("counted", F.coalesce("counted", F.lit(0).cast("long"))).filter("told <> counted")


def recounted(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """The documents with their chunk_count as it is."""
    n = chunks.groupBy("doc_id").agg(F.count("*").alias("n"))
    kind = documents.schema["chunk_count"].dataType
    return documents.join(n, "doc_id", "left").withColumn("chunk_count", F.coalesce("n", F.lit(0)).cast(kind)).select(documents.columns)


def quarantine(spark: SparkSession, folder: str, orphans: DataFrame, now_ms: int) -> int:
    """Move files (path) of a folder to its quarantine, under the time of now; how many. A file that has gone meanwhile is passed over."""
    jvm, moved = spark._jvm, 0
    path = jvm.org.apache.hadoop.fs.Path
    fs = path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    for r in orphans.select("path").toLocalIterator():  # one partition's names at a time
        old, new = path(f"{folder}/{r['path']}"), path(f"{folder}/.quarantine/{now_ms}/{r['path']}")
        if fs.exists(old):
            fs.mkdirs(new.getParent())
            moved += bool(fs.rename(old, new))
    return moved


def purge(spark: SparkSession, folder: str, now_ms: int, kept_ms: int = KEPT_MS) -> list[int]:
    """Delete what was moved to quarantine longer than ``kept_ms`` ago; the times of what went."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    home = path(f"{folder}/.quarantine")
    fs = home.getFileSystem(spark._jsc.hadoopConfiguration())
    times = sorted(int(s.getPath().getName()) for s in fs.listStatus(home)) if fs.exists(home) else []
    gone = [t for t in times if t < now_ms - kept_ms]
    for t in gone:
        fs.delete(path(f"{folder}/.quarantine/{t}"), True)
    return gone


def cited(raw: DataFrame, doc_id, version: int) -> bytes:
    """The bytes of a document's stored version (doc_id, version, content, sha256) that a citation names; a version that isn't stored, or isn't what it was, is an error."""
    own = raw.filter((F.col("doc_id") == doc_id) & (F.col("version") == version)).select("content", "sha256", F.sha2("content", 256).alias("now")).first()
    if own is None:
        raise KeyError(f"VERSION_NOT_FOUND: {doc_id} {version}")
    if own["sha256"] != own["now"]:
        raise ValueError(f"VERSION_DAMAGED: {doc_id} {version}")
    return bytes(own["content"])
