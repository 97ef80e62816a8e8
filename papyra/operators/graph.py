"""Traversal of relation graphs, and what units rest on."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from papyra.sources.store import written

#: Default and most hops, nodes, edges a node and seeds of a traversal.
HOPS, NODES, FAN_OUT, SEEDS = (1, 4), (64, 256), (16, 64), (8, 32)


def bounds(hops: int | None = None, nodes: int | None = None, fan_out: int | None = None, seeds: int | None = None) -> dict[str, int]:
    """What a traversal may take: defaults for what isn't given or not positive, the most for what is more."""
    given = {"hops": (hops, HOPS), "nodes": (nodes, NODES), "fan_out": (fan_out, FAN_OUT), "seeds": (seeds, SEEDS)}
    return {k: min(v, most) if v and v > 0 else default for k, (v, (default, most)) in given.items()}


def directed(edges: DataFrame, direction: str = "out") -> DataFrame:
    """Edges (src, dst, edge_id) as they are followed: out, in or both."""
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "edge_id")
    return {"out": edges.select("src", "dst", "edge_id"), "in": back, "both": edges.select("src", "dst", "edge_id").unionByName(back)}[direction]


def bfs(edges: DataFrame, seeds: DataFrame, hops: int = 2, fan_out: int = 64, direction: str = "out", nodes: int | None = None) -> DataFrame:
    """(node, hop, parent, edge_id): nodes reached from (node) seeds over (src, dst, edge_id) in at most ``hops`` steps, by the first edge of the fewest steps.

    ``fan_out`` edges of a node are followed, in the order of edge_id, and ``nodes`` nodes are visited, those of earlier
    hops and smaller edges first: these bounds are the operator's meaning. Every step is one join on the frontier and
    is written; seen nodes are left out by an anti join, so nothing grows but the result.
    """
    first = F.row_number().over(Window.partitionBy("src").orderBy("edge_id", "dst"))
    own = written(directed(edges, direction).withColumn("n", first).filter(F.col("n") <= fan_out).drop("n"), "edges")
    none = F.lit(None).cast("string")
    seen = written(seeds.select("node").distinct().select("node", F.lit(0).alias("hop"), none.alias("parent"), none.alias("edge_id")), "hop")
    frontier = seen
    for hop in range(1, hops + 1):
        out = own.join(frontier.select(F.col("node").alias("src")), "src").join(seen.select(F.col("node").alias("dst")), "dst", "left_anti")
        new = out.groupBy(F.col("dst").alias("node")).agg(F.min(F.struct("edge_id", "src")).alias("e")).select("node", F.lit(hop).alias("hop"), F.col("e.src").cast("string").alias("parent"), F.col("e.edge_id").cast("string").alias("edge_id"))
        if nodes is not None:
            new = new.orderBy("edge_id", "node").limit(max(0, nodes - seen.count()))
        frontier = written(new, "hop")
        seen = seen.unionByName(frontier)
        if frontier.isEmpty():
            break
    return seen


def paths(reached: DataFrame, hops: int) -> DataFrame:
    """(node, path): the nodes from a seed to each reached node, by parents."""
    out = reached.filter("hop = 0").select("node", F.array(F.col("node").cast("string")).alias("path"))
    last = out
    for hop in range(1, hops + 1):
        step = reached.filter(F.col("hop") == hop).join(last.select(F.col("node").cast("string").alias("parent"), "path"), "parent")
        last = step.select("node", F.concat("path", F.array(F.col("node").cast("string"))).alias("path"))
        out = out.unionByName(last)
    return out


def evidence(derived: DataFrame, sources: DataFrame) -> DataFrame:
    """(id, source): the sources that each unit rests on, its own and those of all units it is made from, directly or not.

    ``derived`` is (id, target), ``sources`` (id, source). Each round carries on only what the last one added; cycles
    end, as nothing is added twice.
    """
    seen = written(sources.select("id", "source").distinct(), "evidence")
    new = seen
    while True:
        up = derived.join(new.select(F.col("id").alias("target"), "source"), "target").select("id", "source").distinct()
        new = written(up.join(seen, ["id", "source"], "left_anti"), "evidence")
        if new.isEmpty():
            return seen
        seen = seen.unionByName(new)


def unsound(derived: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, fault): units made from ones that don't exist, and units of which some origin leads in a circle or into one.

    Units that are made from nothing are taken away, then those made from nothing else, and so on; what is left when a
    round takes nothing is in a circle or rests on one.
    """
    lost = derived.join(ids.select(F.col("id").alias("target")), "target", "left_anti").select("id", F.lit("missing origin").alias("fault")).distinct()
    left = written(derived.join(ids.select(F.col("id").alias("target")), "target", "left_semi").select("id", "target").distinct(), "origins")
    n = left.count()
    while n:
        rest = left.select("id").distinct().withColumnRenamed("id", "target")
        left, before = written(left.join(rest, "target", "left_semi"), "origins"), n
        n = left.count()
        if n == before:
            break
    return lost.unionByName(left.select("id", F.lit("circle").alias("fault")).distinct())


def unsupported(derived: DataFrame, ids: DataFrame, sourced: DataFrame) -> DataFrame:
    """(id): units to be dropped, as they have no source and nothing they are made from is kept; targets that are no units count as kept."""
    bare = written(ids.select("id").join(sourced.select("id"), "id", "left_anti"), "bare")
    return fallen(written(derived.select("id", "target").join(bare, "id", "left_semi").distinct(), "open"), bare)


def fallen(open_: DataFrame, bare: DataFrame) -> DataFrame:
    """``unsupported`` of what each of the (id) ``bare`` units, which have no source, is made from, (id, target). A round looks only for what the last one dropped."""
    gone = written(bare.join(open_.select("id"), "id", "left_anti"), "dropped")
    new = gone
    while not new.isEmpty():
        open_ = written(open_.join(new.select(F.col("id").alias("target")), "target", "left_anti"), "open")
        new = written(bare.join(open_.select("id"), "id", "left_anti").join(gone, "id", "left_anti"), "dropped")
        gone = gone.unionByName(new)
    return gone.distinct()


def sharing(rows: DataFrame, heavy: int = 256) -> DataFrame:
    """(doc_id, related, nearest): how many other documents share a key of (doc_id, key) with each, and the least of them; none for documents that share none.

    Keys with the same documents count as one set. Sets of over ``heavy`` documents are united once for all documents in the
    same ones of them; what the others add is told once for all documents of the same sets, so documents aren't paired.
    """
    own = written(rows.select("doc_id", "key").distinct(), "keyed")
    of = own.groupBy("key").agg(F.array_sort(F.collect_set("doc_id")).alias("docs")).filter(F.size("docs") > 1)
    name = F.concat_ws(":", F.size("docs"), F.xxhash64("docs"), F.xxhash64(F.reverse("docs")))  # 128 bits
    keys = written(of.select("key", name.alias("set"), F.size("docs").alias("n"), F.slice("docs", 1, 2).alias("least")), "sets")
    chosen = keys.groupBy("set").agg(F.min("key").alias("key"))
    lists = written(own.join(chosen, "key").select("set", F.col("doc_id").alias("other")), "members")
    some = lambda c: F.array_sort(F.collect_set(F.when(c, F.col("set"))))
    d = own.join(keys, "key").groupBy("doc_id").agg(some(F.col("n") > heavy).alias("big"), some(F.col("n") <= heavy).alias("small"), F.array_distinct(F.flatten(F.collect_set("least"))).alias("least"))
    near = F.array_min(F.filter("least", lambda x: x != F.col("doc_id")))
    told = lambda *c: F.sha2(F.concat_ws("|", *c), 256)
    d = written(d.select("doc_id", "big", "small", near.alias("nearest"), told("big").alias("b"), told(F.array_join("big", ","), F.array_join("small", ",")).alias("c")), "classes")
    united = written(d.select("b", "big").distinct().select("b", F.explode("big").alias("set")).join(lists, "set").select("b", "other").distinct(), "united")
    added = d.select("c", "b", "small").distinct().select("c", "b", F.explode("small").alias("set")).join(lists, "set").select("c", "b", "other").distinct().join(united, ["b", "other"], "left_anti")
    of_big, of_small = united.groupBy("b").agg(F.count("*").alias("x")), added.groupBy("c").agg(F.count("*").alias("y"))
    both = d.join(of_big, "b", "left").join(of_small, "c", "left")
    return both.select("doc_id", (F.coalesce("x", F.lit(0)) + F.coalesce("y", F.lit(0)) - 1).cast("long").alias("related"), "nearest")


def expand(units: DataFrame, relations: DataFrame, keys: list[str], kinds: list[str] | None = None, direction: str = "out", hops: int | None = None, nodes: int | None = None, fan_out: int | None = None, visible=None) -> tuple[DataFrame, DataFrame, bool]:
    """What is reached from units (by key) over relations (type, subject, object): (node, hop, parent, edge_id), the edges among them, and whether bounds cut it off.

    Keys that don't exist or aren't visible are an error; invisible units are not passed through. ``kinds`` are the types of
    relations that are followed.
    """
    from papyra.functions.questions import Temporal
    from papyra.operators.context import visible as seen

    b = bounds(hops, nodes, fan_out)
    live = written(units.filter(seen(Temporal("current")) if visible is None else visible).select("key").distinct(), "visible")
    found = {r["key"] for r in live.filter(F.col("key").isin(keys)).collect()}
    if missing := sorted(set(keys) - found):
        raise KeyError(f"no visible units: {missing[:5]}")
    r = relations if kinds is None else relations.filter(F.col("type").isin(kinds))
    edges = r.select(F.col("subject").alias("src"), F.col("object").alias("dst"), F.concat_ws(":", "type", "subject", "object").alias("edge_id"))
    for end in ("src", "dst"):
        edges = edges.join(live.withColumnRenamed("key", end), end, "left_semi")
    edges = written(edges.select("src", "dst", "edge_id"), "edges")
    start = units.sparkSession.createDataFrame([(k,) for k in sorted(set(keys))], "node string")
    reached = written(bfs(edges, start, b["hops"], b["fan_out"], direction, b["nodes"]), "reached")
    ids = reached.select("node")
    among = edges.join(ids.withColumnRenamed("node", "src"), "src", "left_semi").join(ids.withColumnRenamed("node", "dst"), "dst", "left_semi")
    more = directed(edges, direction).join(ids.withColumnRenamed("node", "src"), "src", "left_semi").join(ids.withColumnRenamed("node", "dst"), "dst", "left_anti")
    inner = reached.filter(F.col("hop") < b["hops"]).select(F.col("node").alias("src"))
    cut = more.join(inner, "src", "left_semi").limit(1).count() > 0
    return reached, among, cut


def explore(units: DataFrame, relations: DataFrame, question: str, seeds: int | None = None, **traversal) -> tuple[DataFrame, DataFrame, bool]:
    """As ``expand``, from the facts that a question finds."""
    from papyra.operators.semantic import search_units

    top = search_units(units, question, ("fact",), bounds(seeds=seeds)["seeds"])
    return expand(units, relations, [r["key"] for r in top.select("key").collect()], **traversal)
