"""What the operators of this package share."""

from __future__ import annotations

import gc
import pickle
import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space; a word is a longest run of anything else.
WORD = r"[^\x20\x09-\x0D]+"

#: Plans made of these alone yield the same rows in the same partitions each time they run.
_STEADY = re.compile(r"^[\s+\-:|]*(Project|Filter|Relation|LocalRelation|LogicalRDD|SubqueryAlias|LogicalRelation)\b")


def words(text: str | None) -> list[bytes]:
    """The words of a text as UTF-8; ``bytes.split`` splits at just the ASCII white space."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: the cluster's, or on a single machine where none is set (in tests) a new one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="papyra-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts the lineage and survives lost executors.

    The folder belongs to the run; who owns spark.checkpoint.dir removes it when the result is written.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/papyra-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def cut(df: DataFrame, name: str) -> DataFrame:
    """``settle``, after which the driver collects its garbage: so Spark drops broadcasts and shuffle files that only the lineage before it needed.

    For operators of many rounds. A broadcast table of a few rows takes a page of memory in every executor (32 MB at 2 GB of heap)
    until the driver no longer knows of it, which without this may be never.
    """
    out = settle(df, name)
    gc.collect()
    df.sparkSession._jvm.System.gc()
    return out


def fresh(df: DataFrame, name: str) -> str:
    """A column name like ``name`` that the table does not have, whatever the case."""
    taken, name = {c.lower() for c in df.columns}, "__" + name
    while name.lower() in taken:
        name += "_"
    return name


def numbered(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """The table with a column that names each row, and that column's name; the same however often and by whom it is read.

    Rows of Parquet files are named by file and place in it, which don't depend on how tasks share the files out as
    row numbers made by tasks do. Any other table is written first.
    """
    row = fresh(df, "row")
    plan = df._jdf.queryExecution().optimizedPlan().toString().strip().splitlines()
    if "_metadata" in df.columns or not all(_STEADY.match(line) for line in plan) or not plan[-1].rstrip().endswith("parquet"):
        df = settle(df, name)
    return df.withColumn(row, F.struct(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at"))), row


def steady(df: DataFrame, name: str) -> DataFrame:
    """``df`` itself if it is a plain scan, else a written copy: some operators read their input twice and need the same partitions."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    if all(_STEADY.match(line) for line in plan.strip().splitlines()):
        return df
    return settle(df, name)


def small_batches(df: DataFrame, rows: int = 1000) -> DataFrame:
    """``df``, with the session's Arrow batches held to ``rows`` rows if nobody has set their size: whole texts are long, and Spark's default is 10,000."""
    conf = df.sparkSession.conf
    if conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    return df


def share(spark: SparkSession, thing):
    """A function for tasks that returns ``thing``, which is sent to each executor once."""
    sent = spark.sparkContext.broadcast(cloudpickle.dumps(thing))
    return lambda: pickle.loads(sent.value)


def sure_broadcast(df: DataFrame) -> DataFrame:
    """``df``, sent to every task; for tables whose rows a parameter bounds."""
    return F.broadcast(df)


#: Bytes of a table up to which it is sent to every task; larger ones are shuffled.
SEND_BYTES = 32 << 20


def sent_if_small(df: DataFrame, row_bytes: Column | int, most: int = SEND_BYTES) -> DataFrame:
    """``df`` (a written table) marked to be sent to every task if its rows are ``most`` bytes or fewer, as counted."""
    size = F.lit(row_bytes) if isinstance(row_bytes, int) else row_bytes
    return F.broadcast(df) if (df.agg(F.sum(size)).first()[0] or 0) <= most else df


#: Keys that may count as frequent; a key is if it has more than this share of all rows.
HOT_KEYS = 2000


def join_counted(many: DataFrame, one: DataFrame, keys: list[str], n: str) -> DataFrame:
    """Inner join of ``many`` with ``one`` (a written table, one row per key; ``n`` counts the rows of ``many`` that have it).

    Fewer than ``HOT_KEYS`` keys can have over 1 / HOT_KEYS of all rows; those are sent to every task. The others are
    joined by a shuffle, in which no key then has more than that share. The column ``n`` is dropped.
    """
    total = one.agg(F.sum(n)).first()[0] or 0
    hot = F.col(n) > max(1000, total // HOT_KEYS)
    got = [c for c in one.columns if c not in keys and c != n]
    frequent = one.filter(hot).drop(n).withColumn("__hot", F.lit(True))
    rest = one.filter(~hot).drop(n)
    told = many.join(F.broadcast(frequent), keys, "left")
    cold = told.filter(F.col("__hot").isNull()).drop("__hot", *got).join(rest, keys)
    return told.filter("__hot").drop("__hot").unionByName(cold)


def plan_bytes(df: DataFrame) -> int:
    """Catalyst's estimate of the input's size; no job runs."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def parts_for(df: DataFrame, mb: int, least: int = 16, most: int = 1_000_000) -> int:
    """How many groups to make so that each holds about ``mb`` MB of the input."""
    return max(least, min(most, plan_bytes(df) // (mb << 20)))


def sample_by_hash(df: DataFrame, key: Column, rows: int) -> DataFrame:
    """About ``rows`` rows of a table, those whose key hashes low, or all if there are no more; no task sends more than it keeps."""
    n = df.count()
    return df if n <= rows else df.filter(F.pmod(F.xxhash64(key), F.lit(1 << 31)) < int(rows / n * (1 << 31)))


def _zstd() -> pa.Codec:
    return pa.Codec("zstd", compression_level=1)


def pack(a: np.ndarray) -> bytes:
    """An array as bytes: its byte planes one after another, compressed. Sorted keys and small counts shrink well."""
    a = np.ascontiguousarray(a)
    raw = a.view(np.uint8).reshape(len(a), a.itemsize).T.tobytes() if len(a) else b""
    return len(raw).to_bytes(8, "little") + (_zstd().compress(raw, asbytes=True) if raw else b"")


def unpack(b: bytes, dtype: type) -> np.ndarray:
    size = int.from_bytes(b[:8], "little")
    if not size:
        return np.empty(0, dtype)
    raw = np.frombuffer(_zstd().decompress(b[8:], size, asbytes=True), np.uint8)
    wide = np.dtype(dtype).itemsize
    return np.ascontiguousarray(raw.reshape(wide, -1).T).view(dtype).ravel()


def squeeze(raw: bytes) -> bytes:
    return len(raw).to_bytes(8, "little") + (_zstd().compress(raw, asbytes=True) if raw else b"")


def unsqueeze(b: bytes) -> bytes:
    size = int.from_bytes(b[:8], "little")
    return _zstd().decompress(b[8:], size, asbytes=True) if size else b""


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words whose output bits all depend on all input bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def worker_cache() -> dict:
    """A dict that lives as long as the Python worker, so one task can use what an earlier one has learned."""
    import sys
    import types

    return sys.modules.setdefault("papyra_worker", types.ModuleType("papyra_worker")).__dict__.setdefault("kept", {})


class WordHashes(dict):
    """64-bit hashes of words, kept for the words seen lately; emptied when it has ``most`` of them."""

    def __init__(self, most: int = 250_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= self.most:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h

    def of(self, ws: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, ws), np.uint64, len(ws))


def shingle_hashes(h: np.ndarray, width: int = 5) -> np.ndarray:
    """Hashes of all runs of ``width`` words; of a shorter text, one hash of the whole; of none, nothing."""
    n = min(width, len(h))
    if not n:
        return h
    out = np.zeros(len(h) - n + 1, np.uint64)
    for i in range(n):
        out = mix64(out * np.uint64(0x9E3779B97F4A7C15) + h[i : len(h) - n + 1 + i] + np.uint64(i + 1))
    return out
