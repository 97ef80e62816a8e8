"""Compile what changes: a stream of changed and deleted documents keeps a library's units and relations up to date.

Each batch compiles its own documents alone, merges them into the units in force and publishes the result as the next
snapshot, together with the number of the batch. A batch that is handed over again, as after a crash between the
publication and the stream's checkpoint, finds its number in force and changes nothing; one that another publisher
overtakes is merged again into what that has published.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papyra.operators import semantic as S
from papyra.operators import snapshots as Sn
from papyra.streaming.queue import drain

#: Times that a batch is merged anew because another publisher was faster.
TRIES = 5
APPLIED = "stream string, batch long"


def applied(spark: SparkSession, root: str) -> dict[str, int]:
    """The last batch of each stream that is in force; one row a stream."""
    if not Sn.epochs(spark, root):
        return {}
    snap = Sn.at(spark, root)
    return {r["stream"]: r["batch"] for r in snap.read(spark, "applied").collect()} if "applied" in snap.tables else {}


def apply(changes: DataFrame, batch: int, root: str, nodes_of: Callable[[DataFrame], DataFrame], stream: str = "changes") -> bool:
    """Put a batch of changes (doc_id, deleted) in force; whether anything was done.

    ``nodes_of`` gives the nodes of (doc_id) documents as they are now; of a changed document without nodes nothing is
    left, as of a deleted one. Documents must be in a batch once.
    """
    spark = changes.sparkSession
    for _ in range(TRIES):
        done = applied(spark, root)
        if batch <= done.get(stream, -1):
            return False
        epoch = Sn.epochs(spark, root)
        epoch = epoch[-1] if epoch else 0
        dirty = changes.select("doc_id")
        units, relations = S.compile_units(nodes_of(changes.filter(~F.coalesce("deleted", F.lit(False))).select("doc_id")))
        if epoch and "units" in (snap := Sn.at(spark, root, epoch)).tables:
            before = snap.read(spark, "units"), snap.read(spark, "relations")
            units = S.merge_units(before[0], units, dirty)
            relations = S.merge_relations(before[1], relations, units)
        told = spark.createDataFrame(sorted((done | {stream: batch}).items()), APPLIED)
        try:
            Sn.publish(spark, root, {"units": units, "relations": relations, "applied": told}, epoch)
            return True
        except Sn.Conflict:
            continue
    raise Sn.Conflict(f"batch {batch} of {stream} was overtaken {TRIES} times")


def follow(stream: DataFrame, root: str, nodes_of: Callable[[DataFrame], DataFrame], checkpoint: str, name: str = "changes"):
    """Compile a stream of (doc_id, at, deleted) up to its present end: of each batch the last change of a document counts."""
    return drain(stream, "doc_id", "at", checkpoint, lambda df, n: apply(df, n, root, nodes_of, name) and None)
