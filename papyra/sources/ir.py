"""Texts as rows of structure: a document node, headings and paragraphs in reading order."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from papyra.functions.text import stable_id
from papyra.sources.store import written

#: Node types whose texts state nothing: structure, running titles and code.
STRUCTURAL = ("document", "heading", "section", "header", "footer", "footnote", "code")
#: Node types that are tables or describe something.
TABULAR = ("table", "table_row", "table_cell", "caption")

#: Characters and rows of nodes that a task sends off at once, bytes of texts that it takes in.
BATCH_CHARS, BATCH_ROWS = 1 << 22, 1 << 15
TAKEN_BYTES = 1 << 22

SCHEMA = "ord int, type string, parent int, text string, path array<string>"
BARE = ("doc_id", "ord", "type", "parent")
COLUMNS = ("doc_id", "title", "ord", "type", "parent", "text", "path")


def parse(text: str | None) -> list[tuple]:
    """(ord, type, parent, text, path) of a text: blank lines part its nodes, one that begins with # is a heading of that many signs, but at most one level under the last."""
    body = (text or "").strip()
    rows, path, parent = [(0, "document", None, body, [])], [], 0
    for part in body.split("\n\n"):
        part = part.strip()
        if not part:
            continue
        label = part.lstrip("#").strip()
        if part.startswith("#"):
            if not label:
                continue
            level = min(len(part) - len(part.lstrip("#")), len(path) + 1)
            path = [*path[: level - 1], label]
            rows.append((len(rows), "heading", parent, label, path))
            parent = len(rows) - 1
        else:
            rows.append((len(rows), "paragraph", parent, part, path))
    return rows


def batched(batches: Iterator[pa.RecordBatch], texts: bool, chars: int = BATCH_CHARS, rows: int = BATCH_ROWS) -> Iterator[pa.RecordBatch]:
    """The nodes of batches of (doc_id, title, text); a batch is sent off when it holds so many characters or rows, so a task keeps no more than one text's nodes beyond that."""
    for b in batches:
        at, ords, kinds, parents, said, sizes, flat, held = [], [], [], [], [], [0], [], 0
        for i, one in enumerate(b.column(2)):
            for n, kind, parent, text, path in parse(one.as_py()):
                at.append(i)
                ords.append(n)
                kinds.append(kind)
                parents.append(parent)
                if texts:
                    said.append(text)
                    flat += path
                    sizes.append(len(flat))
                    held += len(text)
            if held >= chars or len(at) >= rows or i == b.num_rows - 1:
                row = pa.array(at, pa.int32())
                columns = {"doc_id": b.column(0).take(row), "ord": pa.array(ords, pa.int32()), "type": pa.array(kinds, pa.string()), "parent": pa.array(parents, pa.int32())}
                if texts:
                    paths = pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(flat, pa.string()))
                    columns |= {"title": b.column(1).take(row), "text": pa.array(said, pa.string()), "path": paths}
                yield pa.RecordBatch.from_pydict({c: columns[c] for c in (COLUMNS if texts else BARE)})
                at, ords, kinds, parents, said, sizes, flat, held = [], [], [], [], [], [0], [], 0


def nodes(docs: DataFrame, texts: bool = True) -> DataFrame:
    """A row for each node of the texts of (doc_id, title, text): doc_id, title, ord, type, parent, text, path, node_id, parent_id. Null texts are a document node alone.

    Without ``texts`` the rows have no title, text and path. The session's Arrow batches are held to ``TAKEN_BYTES`` if
    nobody has set how many bytes they may have; at Spark's 64 MB a worker holds some copies of that many.
    """
    conf, bound_ = docs.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if conf.get(bound_) == "67108864b":
        conf.set(bound_, str(TAKEN_BYTES))
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, " + (f"title string, {SCHEMA}" if texts else "ord int, type string, parent int")
    return bound(docs.select("doc_id", "title", "text").mapInArrow(lambda batches: batched(batches, texts), schema))


def bound(n: DataFrame) -> DataFrame:
    """Nodes with deterministic ids in place of their order in the document."""
    of = lambda o: F.when(o.isNotNull(), stable_id(F.col("doc_id"), F.lit("node"), o))
    return n.withColumns({"node_id": of(F.col("ord")), "parent_id": of(F.col("parent"))})


def faults(n: DataFrame) -> DataFrame:
    """(doc_id, node_id, fault) of nodes that break a rule: a repeated id, a missing parent, a parent that comes later, no document node."""
    twice = n.groupBy("doc_id", "node_id").count().filter("count > 1").select("doc_id", "node_id", F.lit("repeated id").alias("fault"))
    # files of ids and places are small beside their rows, so Spark would send all nodes to the driver and every task
    own = n.select("doc_id", F.col("node_id").alias("parent_id"), F.col("ord").alias("at")).hint("merge")
    up = n.filter("parent_id is not null").join(own, ["doc_id", "parent_id"], "left")
    fault = F.when(F.col("at").isNull(), "missing parent").when(F.col("at") >= F.col("ord"), "parent comes later")
    astray = up.select("doc_id", "node_id", fault.alias("fault")).filter("fault is not null")
    rootless = n.groupBy("doc_id").agg(F.max((F.col("type") == "document").cast("int")).alias("r")).filter("r = 0").select("doc_id", F.lit(None).cast("string").alias("node_id"), F.lit("no document node").alias("fault"))
    return twice.unionByName(astray).unionByName(rootless)


def text_of(n: DataFrame) -> DataFrame:
    """(doc_id, text): the searchable text of a document, its nodes in order with blank lines between."""
    full = n.filter((F.col("type") != "document") & (F.trim("text") != ""))
    return full.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("ord", F.trim("text").alias("t")))).alias("x")).select("doc_id", F.array_join("x.t", "\n\n").alias("text"))


def section(path: Column) -> Column:
    return F.array_join(path, " / ")


def context(title: Column, path: Column, most: int = 600) -> Column:
    """What a chunk stands under, for search: title and headings, ``most`` characters at most."""
    return F.left(F.concat_ws(" ", F.nullif(F.trim(title), F.lit("")), F.nullif(section(path), F.lit(""))), F.lit(most))


def pieces(n: DataFrame) -> DataFrame:
    """(doc_id, idx, type, path, text, search_text): a piece for each table, caption or paragraph; a sheet, page or slide bounds one only if it holds no finer node.

    Containers with children are left out, as their text is that of the children.
    """
    holders = n.filter("parent_id is not null").select("doc_id", F.col("parent_id").alias("node_id")).distinct()
    leaf = n.filter(~F.col("type").isin("document", "heading", "section")).join(holders, ["doc_id", "node_id"], "left_anti").filter(F.trim("text") != "")
    from pyspark.sql import Window

    idx = F.row_number().over(Window.partitionBy("doc_id").orderBy("ord")) - 1
    said = F.trim(F.concat_ws(" ", context(F.col("title"), F.col("path")), F.col("text")))
    return leaf.select("doc_id", idx.cast("long").alias("idx"), "type", "path", "text", said.alias("search_text"))


def provenance(links: DataFrame, n: DataFrame) -> DataFrame:
    """(doc_id, generation, chunk, node_id, score): of the nodes that a chunk is linked with, the most specific, ties to the smaller id. ``links``: doc_id, generation, chunk, node_id; ``n`` has generation, header and type."""
    from papyra.functions.sources import anchor_score

    j = links.join(n.select("doc_id", "generation", "node_id", "type", "header"), ["doc_id", "generation", "node_id"])
    best = F.min(F.struct((-anchor_score(F.col("type"), F.col("header"))).alias("less"), "node_id"))
    return j.groupBy("doc_id", "generation", "chunk").agg(best.alias("b")).select("doc_id", "generation", "chunk", "b.node_id", (-F.col("b.less")).alias("score"))


def nodes_of(pieces_: DataFrame, n: DataFrame, most: int = 8) -> DataFrame:
    """(doc_id, idx, node_id, how): the nodes a piece (doc_id, idx, text, heading) comes from, ``most`` at most, in order.

    Nodes of exactly its text, by a join on the text's hash; where there are none, nodes of its document of which one
    text holds the other, or that stand under its heading; else the document's first node.
    """
    from pyspark.sql import Window

    from papyra.functions.text import normalize

    real = n.filter("type <> 'document'").select("doc_id", "node_id", "ord", normalize(F.col("text")).alias("t"), F.array_join("path", " ").alias("under"))
    p = pieces_.select("doc_id", "idx", normalize(F.col("text")).alias("target"), F.trim(F.coalesce("heading", F.lit(""))).alias("heading"))
    told = lambda c: F.sha2(c, 256).alias("told")  # noqa: E731  hashes are shuffled, texts aren't
    same = written(p.select("doc_id", "idx", told("target")).join(real.select("doc_id", "node_id", "ord", told("t")), ["doc_id", "told"]).select("doc_id", "idx", "node_id", "ord", F.lit("text").alias("how")), "same")
    other = written(p.select("doc_id", "idx").join(same.select("doc_id", "idx").distinct(), ["doc_id", "idx"], "left_anti"), "other")
    rest = p.join(other, ["doc_id", "idx"], "left_semi")
    near = F.contains("t", "target") | F.contains("target", "t") | ((F.col("heading") != "") & F.contains("under", "heading"))
    part = rest.join(real, "doc_id").filter((F.col("t") != "") & near).select("doc_id", "idx", "node_id", "ord", F.lit("part").alias("how"))
    lone = other.join(part.select("doc_id", "idx").distinct(), ["doc_id", "idx"], "left_anti")
    first = real.groupBy("doc_id").agg(F.min(F.struct("ord", "node_id")).alias("f"))
    lone = lone.join(first, "doc_id").select("doc_id", "idx", F.col("f.node_id").alias("node_id"), F.col("f.ord").alias("ord"), F.lit("first").alias("how"))
    every = same.unionByName(part).unionByName(lone)
    return every.withColumn("n", F.row_number().over(Window.partitionBy("doc_id", "idx").orderBy("ord"))).filter(F.col("n") <= most).select("doc_id", "idx", "node_id", "how")
