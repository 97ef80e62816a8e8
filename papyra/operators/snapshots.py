"""Published states of a library: numbered snapshots of its tables, put in force by compare-and-set.

A snapshot is a small file that names the folder of each of its tables. Its number, the epoch, is taken by creating the
file of that number, which only one publisher can do; whoever built on an older epoch loses and knows it. A search pins
one epoch for all it reads, so lanes, evidence and what is read on later agree; what has been deleted meanwhile is told by
a second look at the newest epoch when the hits are known. Tables that no snapshot in force or within its grace names
are removed.
"""

from __future__ import annotations

import base64
import binascii
import json
import time
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papyra.operators import search as S
from papyra.operators import trigrams as T

#: Fixed value: how long a retired snapshot can still be read on, in milliseconds.
GRACE_MS = 5 * 60 * 1000
#: Chunks that are read on at a time, at most.
MOST = 50


class Conflict(RuntimeError):
    """Another publisher has taken the epoch."""


class Expired(KeyError):
    """The snapshot asked for isn't there any more."""


@dataclass(frozen=True)
class Snapshot:
    root: str
    epoch: int
    tables: dict[str, str]
    made: int

    def read(self, spark: SparkSession, name: str) -> DataFrame:
        return spark.read.parquet(self.tables[name])


class _Files:
    """The few things done to files, in whatever store the folder is."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm, self.conf, self.gateway = spark._jvm, spark._jsc.hadoopConfiguration(), spark.sparkContext._gateway
        self.fs = self.path(root).getFileSystem(self.conf)

    def path(self, p: str):
        return self.jvm.org.apache.hadoop.fs.Path(p)

    def names(self, folder: str) -> dict[str, int]:
        """Names in a folder, and when each was last changed."""
        at = self.path(folder)
        return {s.getPath().getName(): s.getModificationTime() for s in self.fs.listStatus(at)} if self.fs.exists(at) else {}

    def text(self, p: str) -> str:
        stream = self.fs.open(self.path(p))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def create(self, p: str, text: str) -> bool:
        """Make a file with all its text at once, unless there is one of its name; says whether it did."""
        made, at = self.path(f"{p}.{uuid.uuid4().hex}.tmp"), self.path(p)
        out = self.fs.create(made, False)
        out.write(bytearray(text.encode()))
        out.close()
        try:
            if self.fs.getUri().getScheme() == "file":  # a rename there replaces what is in its way; a link doesn't
                local = lambda x: self.jvm.java.io.File(x.toUri().getPath()).toPath()
                self.jvm.java.nio.file.Files.createLink(local(at), local(made))
            else:
                options = self.gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 0)
                self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(at.toUri(), self.conf).rename(made, at, options)
        except Exception as e:
            if "AlreadyExists" not in str(e) and "already exists" not in str(e):
                raise
            return False
        finally:
            self.fs.delete(made, False)
        return True

    def remove(self, p: str) -> None:
        self.fs.delete(self.path(p), True)


def _commit(root: str, epoch: int) -> str:
    return f"{root}/epochs/{epoch:020d}.json"


def _now(now_ms: int | None) -> int:
    return int(time.time() * 1000) if now_ms is None else now_ms


def epochs(spark: SparkSession, root: str) -> list[int]:
    """The epochs that can be read, ascending."""
    return sorted(int(n.removesuffix(".json")) for n in _Files(spark, root).names(f"{root}/epochs") if n.endswith(".json"))


def at(spark: SparkSession, root: str, epoch: int | None = None) -> Snapshot:
    """The snapshot of an epoch, or the newest one."""
    known = epochs(spark, root)
    if not known or epoch is not None and epoch not in known:
        raise Expired(f"SNAPSHOT_EXPIRED: {epoch}")
    epoch = known[-1] if epoch is None else epoch
    said = json.loads(_Files(spark, root).text(_commit(root, epoch)))
    return Snapshot(root, epoch, said["tables"], said["made"])


def publish(spark: SparkSession, root: str, tables: dict[str, DataFrame], expected: int = 0, now_ms: int | None = None) -> Snapshot:
    """Write tables and put them in force as epoch ``expected`` + 1, if ``expected`` is still the newest epoch (0: there is none).

    Tables of the expected epoch that aren't given are carried over by name. If another publisher was faster, nothing is
    in force of what was written, and ``Conflict`` is raised; what was written is removed with the next ``collect``.
    """
    files, known = _Files(spark, root), epochs(spark, root)
    if (known[-1] if known else 0) != expected:
        raise Conflict(f"epoch {expected} was expected, {known[-1] if known else 0} is in force")
    carried = dict(at(spark, root, expected).tables) if expected else {}
    folder = f"{root}/data/{uuid.uuid4().hex}"
    for name, df in tables.items():
        df.write.option("compression", "zstd").parquet(f"{folder}/{name}")
        carried[name] = f"{folder}/{name}"
    made = _now(now_ms)
    if not files.create(_commit(root, expected + 1), json.dumps({"tables": carried, "made": made})):
        raise Conflict(f"epoch {expected + 1} is taken")
    return Snapshot(root, expected + 1, carried, made)


def collect(spark: SparkSession, root: str, now_ms: int | None = None, grace_ms: int = GRACE_MS) -> tuple[list[int], list[str]]:
    """Remove snapshots retired longer than the grace, then folders that no snapshot names and that are older than it. Returns both.

    A snapshot is retired when its successor is made. The newest one always stays, and so does what a publisher at work has just written.
    """
    files, now, known = _Files(spark, root), _now(now_ms), epochs(spark, root)
    made = {e: at(spark, root, e).made for e in known}
    old = [e for e, after in zip(known, known[1:]) if made[after] < now - grace_ms]
    for e in old:
        files.remove(_commit(root, e))
    named = {p.split("/data/")[1].split("/")[0] for e in known if e not in old for p in at(spark, root, e).tables.values()}
    gone = sorted(n for n, changed in files.names(f"{root}/data").items() if n not in named and changed < now - grace_ms)
    for n in gone:
        files.remove(f"{root}/data/{n}")
    return old, gone


# --- a library in snapshots ---------------------------------------------
def tables_of(documents: DataFrame, chunks: DataFrame, vectors: DataFrame | None = None, anchors: DataFrame | None = None) -> dict[str, DataFrame]:
    """What a library's search needs, to be published: the tables, and the index of the chunks' words and their trigrams."""
    g, spark = T.build(chunks), chunks.sparkSession
    sizes = spark.createDataFrame([(g.chunks, float(g.average))], "chunks long, average double")
    out = {"documents": documents, "chunks": chunks.repartitionByRange("doc_id", "idx").sortWithinPartitions("doc_id", "idx")}
    out |= {"words": g.postings, "grams": g.grams, "gram_counts": g.counts, "texts": g.texts, "sizes": sizes}
    return out | ({"vectors": vectors} if vectors is not None else {}) | ({"anchors": anchors} if anchors is not None else {})


def library(spark: SparkSession, snap: Snapshot) -> S.Library:
    """The library as a snapshot has it."""
    size = snap.read(spark, "sizes").first()
    g = T.Index(snap.read(spark, "words"), snap.read(spark, "grams"), snap.read(spark, "gram_counts"), snap.read(spark, "texts"), size["chunks"], size["average"])
    some = lambda name: snap.read(spark, name) if name in snap.tables else None
    return S.Library(snap.read(spark, "documents"), snap.read(spark, "chunks"), None, some("vectors"), g, some("anchors"))


def fenced(spark: SparkSession, root: str, hits: DataFrame) -> DataFrame:
    """Hits (doc_id, ...; as many as a search returns) whose documents are in the newest epoch and not being deleted there."""
    ids = [r["doc_id"] for r in hits.select("doc_id").distinct().collect()]
    there = at(spark, root).read(spark, "documents").filter(F.col("doc_id").isin(ids) & (F.col("status") != "deleting")).select("doc_id")
    return hits.join(F.broadcast(there.distinct()), "doc_id", "left_semi").select(hits.columns)


def search(spark: SparkSession, root: str, question: str, vector: list[float] | None = None, options: S.Options | None = None, epoch: int | None = None) -> DataFrame:
    """``papyra.operators.search.search`` within one epoch (the newest, or that asked for), with ``epoch`` and a ``cursor`` to read on from each hit.

    All lanes, filters and texts are of that epoch. The hits are then held against the newest epoch's documents: one that
    was deleted since the search began isn't returned, and no other takes its place.
    """
    snap = at(spark, root, epoch)
    hits = S.search(library(spark, snap), question, vector, options)
    rows = hits.collect()  # top_k rows: from here on the search is over, and the fence looks again
    hits = fenced(spark, root, spark.createDataFrame(rows, hits.schema))
    cursors = spark.createDataFrame([(r["doc_id"], r["idx"], cursor(snap.epoch, r["doc_id"], r["idx"])) for r in rows], "doc_id long, idx long, cursor string")
    return hits.join(cursors, ["doc_id", "idx"]).withColumn("epoch", F.lit(snap.epoch).cast("long")).select("rank", *[c for c in hits.columns if c != "rank"], "epoch", "cursor")


def cursor(epoch: int, doc_id: int, idx: int) -> str:
    """A place in a document of an epoch, as a string that means nothing to its holder; a changed one is refused."""
    said = json.dumps([epoch, doc_id, idx]).encode()
    return base64.urlsafe_b64encode(binascii.crc32(said).to_bytes(4, "big") + said).decode().rstrip("=")


def place(of: str) -> tuple[int, int, int]:
    """The epoch, document and chunk of a cursor."""
    try:
        raw = base64.urlsafe_b64decode(of + "=" * (-len(of) % 4))
        if binascii.crc32(raw[4:]).to_bytes(4, "big") != raw[:4]:
            raise ValueError
        epoch, doc_id, idx = json.loads(raw[4:])
    except ValueError as e:
        raise ValueError("INVALID_CURSOR") from e
    return epoch, doc_id, idx


def read_on(spark: SparkSession, root: str, of: str, count: int = 3, back: bool = False) -> tuple[DataFrame, str | None]:
    """The next ``count`` chunks (``MOST`` at most) after a cursor's place in its own epoch, or before it, in reading order, and the cursor to go on from (none at the end).

    A snapshot that is gone is an error (``Expired``), as newer chunks may be cut at other places; so is a document deleted since.
    """
    epoch, doc_id, idx = place(of)
    snap, n = at(spark, root, epoch), max(1, min(count, MOST))
    here = at(spark, root).read(spark, "documents").filter((F.col("doc_id") == doc_id) & (F.col("status") != "deleting"))
    if not here.head(1):
        raise KeyError(f"DOCUMENT_NOT_FOUND: {doc_id}")
    near = F.col("idx").between(idx - n, idx - 1) if back else F.col("idx").between(idx + 1, idx + n)
    rows = snap.read(spark, "chunks").filter((F.col("doc_id") == doc_id) & near).orderBy("idx")
    ends = rows.agg(F.min("idx").alias("a"), F.max("idx").alias("b")).first()
    last = ends["a"] if back else ends["b"]
    return rows, None if last is None else cursor(epoch, doc_id, last)
