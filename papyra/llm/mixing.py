"""Mixing sources to target weights by a low-discrepancy schedule, in DataFrame operations only.

Slot n of the schedule is the golden-ratio point frac((n + 1/2) / phi);
cumulative target weights map it to a source, and its rank among the slots of
that source says which block of the source's shuffled documents it takes. Blocks
hold equal numbers of words. A source's blocks are taken in turn, and again from
the first after the last. So the points decide how many blocks a source gives
(within a block or two of its target, as they are no exact quotas; nothing is
topped up) and in what order sources alternate: ``mixed`` lays documents out by
their slots.

Running sums and ranks are made in two levels (inside hash ranges of a source,
then over them), so a source with a third of the rows is no single task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from papyra.llm._util import WORD, fresh, numbered, parts_for, plan_bytes, sent_if_small, settle

#: Blocks into which all words taken are cut, one for each slot of the schedule; fewer if there are fewer words.
BLOCKS = 1 << 17
WEIGHTS = (5.0, 2.0, 1.0)
SHARE, MOST = 1.5, 2.0
#: 1 / phi.
STEP = 0.6180339887498949
#: Times a block can be taken.
TURNS = 2


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """Target words by source from (skey, source_size): weights repeat over the sources in order, no target is over ``most`` times its size.

    Sources fill up in the order of size by weight. Before each, the level is what is left for the rest by their
    weight; the highest such level is where no source is above its bound any more.
    """
    order = Window.orderBy("skey")
    w = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    s = sizes.withColumns({"w": w, "bound": F.col("source_size") * F.lit(float(most))})
    fill = Window.orderBy(F.col("bound") / F.col("w"), "skey")
    before = F.sum("bound").over(fill.rowsBetween(Window.unboundedPreceding, 0)) - F.col("bound")
    rest = F.sum("w").over(fill.rowsBetween(0, Window.unboundedFollowing))
    every = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    s = s.withColumn("total", F.sum("source_size").over(every) * F.lit(float(share)))
    s = s.withColumn("level", (F.col("total") - before) / rest)
    return s.withColumn("target", F.least("bound", F.max("level").over(every) * F.col("w"))).select("skey", "source_size", "w", "total", "target")


def shuffled(docs: DataFrame) -> DataFrame:
    """(row, doc_id, skey, size, start): where each document begins among the words of its source in shuffled order."""
    digits = 2
    while plan_bytes(docs) >> (22 + 4 * digits):
        digits += 1
    sized = settle(
        docs.select(
            "row",
            "doc_id",
            F.when(F.col("source").isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), "source")).alias("skey"),
            n_words(F.col("text")).alias("size"),
            F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")).alias("h"),
            F.xxhash64("text").alias("th"),
        ).withColumn("part", F.substring("h", 1, digits)),
        "sized",
    )
    sums = sized.groupBy("skey", "part").agg(F.sum("size").alias("words"))
    earlier = Window.partitionBy("skey").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("skey", "part", F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("base"))
    inside = Window.partitionBy("skey", "part").orderBy("h", "doc_id", "size", "th").rowsBetween(Window.unboundedPreceding, 0)
    return sized.withColumn("upto", F.sum("size").over(inside)).join(sums, ["skey", "part"]).select("row", "doc_id", "skey", "size", (F.col("base") + F.col("upto") - F.col("size")).alias("start"))


def block_words(total, blocks: int):
    return F.greatest(F.ceil(total / F.lit(blocks)), F.lit(1)).cast("long")


def schedule(goal: DataFrame, blocks: int = BLOCKS, step: float = STEP) -> DataFrame:
    """One row per slot that takes words: skey, rank, slot, turn, block, begin, end (word range in the source, end exclusive), block_words.

    ``goal`` is what ``targets`` returns. The number of slots is ``blocks`` or fewer, whatever the input's size; a source
    whose target is under a block may have none. Slots that would take a block a third time are left empty: a source
    whose target is twice its size may have one or two.
    """
    spark = goal.sparkSession
    goal = goal.withColumn("b", block_words(F.col("total"), blocks))
    most = goal.agg(F.max(F.ceil(F.col("total") / F.col("b")))).first()[0] or 0
    cum = Window.orderBy("skey").rowsBetween(Window.unboundedPreceding, -1)
    lows = goal.filter("target > 0").select(F.coalesce(F.sum("target").over(cum) / F.col("total"), F.lit(0.0)).alias("x"), F.lit(-1).cast("long").alias("n"), "skey")
    points = spark.range(most).select(((F.col("id") + 0.5) * step % 1.0).alias("x"), F.col("id").alias("n"), F.lit(None).cast("string").alias("skey"))
    # each point belongs to the last source that begins at or before it
    mapped = lows.unionByName(points).withColumn("skey", F.last("skey", True).over(Window.orderBy("x", "n").rowsBetween(Window.unboundedPreceding, 0))).filter("n >= 0")
    ranked = mapped.select("skey", F.col("n").alias("slot"), (F.row_number().over(Window.partitionBy("skey").orderBy("n")) - 1).cast("long").alias("rank"))
    per = F.ceil(F.col("source_size") / F.col("b")).cast("long")  # blocks in one pass of the source
    slots = ranked.join(goal.filter("source_size > 0").select("skey", "source_size", "b", per.alias("per")), "skey")
    slots = slots.withColumns({"block": F.col("rank") % F.col("per"), "turn": F.expr("rank div per")}).filter(F.col("turn") < TURNS)
    begin = F.col("block") * F.col("b")
    return slots.select("skey", "rank", "slot", "turn", "block", begin.alias("begin"), F.least(begin + F.col("b"), "source_size").alias("end"), F.col("b").alias("block_words"))


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST, blocks: int = BLOCKS, step: float = STEP) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text, source): size, source_size, target, taken, first_slot.

    A size is a number of words; null and empty texts have 0 and are never taken. Sources come in code-point order,
    null last as a source of its own (the empty string is another). All targets together are ``share`` times all
    words. A document's taken words are those that the slots' blocks hold, repeats counted, at most twice its size;
    first_slot is the first slot that takes some, else null. Documents are shuffled by the md5 of
    doc_id (null as ''), then id and text, so reruns agree; equal rows may swap places, which leaves the same rows.
    An empty table gives an empty table. Other columns are ignored.
    """
    return _taken(docs.select("doc_id", "source", "text", F.lit(0).alias("row")), weights, share, most, blocks, step).drop("row", "next_slot")


def mixed(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST, blocks: int = BLOCKS) -> DataFrame:
    """``docs`` with each row as often as the mix takes it, as a whole: taken words by size, rounded. Rows without words go.

    Rows come in the order of the schedule, the first copy at the first slot that takes some of it and the second at the
    first one of the source's second turn: partitions are ranges of slots, sorted. Columns stay as they are, whatever
    their names. A document of over half its source's size may come once or twice more or less than its target asks.
    """
    docs, row = numbered(docs, "mixing-docs")
    slots = fresh(docs, "slots")
    taken = _taken(docs.select("doc_id", "source", "text", F.col(row).alias("row")), weights, share, most, blocks, STEP).filter("taken > 0")
    copies = F.floor(F.col("taken") / F.col("size") + 0.5).cast("int")
    again = F.when(copies > 1, F.coalesce("next_slot", "first_slot"))
    copies = settle(taken.filter(copies > 0).select(F.col("row").alias(row), F.array_compact(F.array("first_slot", again)).alias(slots)), "copies")
    out = docs.join(sent_if_small(copies, 128), row).withColumn(slots, F.explode(slots))
    return out.repartitionByRange(parts_for(docs, 32), slots, row).sortWithinPartitions(slots, row).drop(row, slots)


def _taken(docs: DataFrame, weights, share: float, most: float, blocks: int, step: float) -> DataFrame:
    if not 0 < share <= most <= 2:
        raise ValueError("0 < share <= most <= 2 is needed")
    at = settle(shuffled(docs), "shuffled")
    goal = settle(targets(at.groupBy("skey").agg(F.sum("size").alias("source_size")), weights, share, most), "targets")
    slots = schedule(goal, blocks, step)
    full = at.join(goal.select("skey", "source_size", "target", block_words(F.col("total"), blocks).alias("b")), "skey")
    words = full.filter("size > 0").withColumn("block", F.explode(F.sequence(F.expr("start div b"), F.expr("(start + size - 1) div b"))))
    share_ = F.greatest(F.lit(0), F.least(F.col("start") + F.col("size"), F.col("end")) - F.greatest("start", "begin"))
    took = words.join(slots.select("skey", "block", "turn", "slot", "begin", "end"), ["skey", "block"], "left").withColumn("got", F.when(F.col("slot").isNull(), 0).otherwise(share_))
    some = F.col("got") > 0
    rows = took.groupBy("skey", "start", "row", "doc_id", "size", "source_size", "target").agg(
        F.sum("got").cast("long").alias("taken"),
        F.min(F.when(some, F.col("slot"))).alias("first_slot"),
        F.min(F.when(some & (F.col("turn") > 0), F.col("slot"))).alias("next_slot"),
    )
    cols = ["row", "doc_id", "size", "source_size", "target", "taken", "first_slot", "next_slot"]
    none = full.filter("size = 0").select("row", "doc_id", "size", "source_size", "target", F.lit(0).cast("long").alias("taken"), F.lit(None).cast("long").alias("first_slot"), F.lit(None).cast("long").alias("next_slot"))
    return rows.select(*cols).unionByName(none)
