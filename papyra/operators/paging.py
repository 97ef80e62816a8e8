"""Positions and running sums over whole tables without one task for all rows: ranges are sorted side by side, then shifted by what is before them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from papyra.sources.store import written


def running(rows: DataFrame, order: list[Column], value: Column, name: str) -> DataFrame:
    """``rows`` with the sum of ``value`` up to each row in the order, which must tell all rows apart.

    Rows are dealt by ranges of the order; a range is one task's share. What stands before a range is told from one row
    a range.
    """
    at = [c.alias(f"__o{i}") for i, c in enumerate(order)]
    keys = [F.col(f"__o{i}") for i in range(len(order))]
    dealt = rows.select("*", *at, value.alias("__v")).repartitionByRange(*keys).withColumn("__part", F.spark_partition_id())
    dealt = written(dealt, "ranges")
    sums = dealt.groupBy("__part").agg(F.sum("__v").alias("__s"))
    before = sums.select("__part", F.coalesce(F.sum("__s").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__b"))
    inside = F.sum("__v").over(Window.partitionBy("__part").orderBy(*keys).rowsBetween(Window.unboundedPreceding, 0))
    return dealt.withColumn("__i", inside).join(F.broadcast(before), "__part").withColumn(name, F.col("__i") + F.col("__b")).select(*rows.columns, name)


def positions(rows: DataFrame, order: list[Column], name: str = "position") -> DataFrame:
    """``rows`` with their places from 1 in the order."""
    return running(rows, order, F.lit(1).cast("long"), name)


def walk(rows: DataFrame, order: list[str], size: int = 128, upto: tuple | None = None) -> DataFrame:
    """``rows`` with the page (from 0) in which a walk by keys meets them: ``size`` rows a page, in the order of columns that tell all rows apart.

    The walk ends at the key ``upto``, taken before it began, so rows that come later are in no page.
    """
    if upto is not None:
        end = F.struct(*(F.lit(v).cast(rows.schema[c].dataType).alias(c) for c, v in zip(order, upto, strict=True)))
        rows = rows.filter(F.struct(*order) <= end)
    at = positions(rows, [F.col(c) for c in order], "__at")
    return at.withColumn("page", F.floor((F.col("__at") - 1) / size)).drop("__at")


def page(rows: DataFrame, order: list[Column], offset: int, size: int) -> DataFrame:
    """Rows ``offset`` to ``offset + size`` in the order, with ``total`` and ``has_more``; the whole is counted, not sorted."""
    total = rows.count()
    return rows.orderBy(*order).offset(offset).limit(size).withColumns({"total": F.lit(total).cast("long"), "has_more": F.lit(offset + size < total)})


def within(rows: DataFrame, order: list[Column], cost: Column, budget: float) -> DataFrame:
    """The rows that come first in the order and together cost no more than the budget."""
    return running(rows, order, cost, "used").filter(F.col("used") <= budget)


def folded(rows: DataFrame, group: str, id_: str, part: Column, width: int = 1000) -> DataFrame:
    """(group, fingerprint): a hash of a group's parts in the order of integer ids, however rows come: of ranges of ``width`` ids first, then of the ranges' hashes, so no string holds a whole group."""
    said = F.concat(F.length(part).cast("string"), F.lit(":"), part)
    r = rows.select(group, F.floor(F.col(id_) / width).alias("r"), F.col(id_).alias("id"), said.alias("p"))
    r = r.groupBy(group, "r").agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.struct("id", "p")))["p"], ","), 256).alias("h"))
    return r.groupBy(group).agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.struct("r", "h")))["h"], ","), 256).alias("fingerprint"))


def ancestors(tree: DataFrame, leaves: DataFrame, depth: int = 64) -> DataFrame:
    """(leaf, path): the names from the root to each leaf of (id, parent, name); a way of more than ``depth`` steps is an error, as it is a circle."""
    up = leaves.select(F.col("id").alias("leaf"), F.col("id").alias("at"), F.array().cast("array<string>").alias("path"))
    done = None
    for _ in range(depth + 1):
        step = written(up.join(tree.select(F.col("id").alias("at"), "parent", "name"), "at").select("leaf", F.col("parent").alias("at"), F.concat(F.array("name"), "path").alias("path")), "up")
        end = step.filter("at is null").select("leaf", "path")
        done = end if done is None else done.unionByName(end)
        up = step.filter("at is not null")
        if up.isEmpty():
            return done
    raise ValueError(f"a way to the root is longer than {depth}")
