"""Documents as trees of containers and leaves: pages, slides, sheets and tables bound what may stand in one chunk.

A node is a row: doc_id, ord (reading order), parent (the ord of the node it lies in, null for the document), type, text,
path (headings above), page, slide, sheet, cells, and the parser that made it. What a container says of itself holds for
all that lies in it; it is carried down by doubling the distance to the node asked, so a tree of any depth takes rounds
by the logarithm of its depth, and all joins are on (doc_id, ord).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from papyra.functions.text import normalize, token_estimate
from papyra.sources import chunker
from papyra.sources.store import written

#: Types that hold others and are read as units, tables and what belongs to them, and the leaves of flowing text.
UNITS, TABLES, LEAVES = ("page", "slide", "sheet"), ("table", "table_row", "figure", "caption", "footnote"), ("section", "heading", "paragraph", "block", "list_item")
#: Parsers whose leaves are pieces of their own, characters of a summary, parts of a section that it tells, words that name a document's subject.
FLOWING, SUMMARY, PARTS, CONCEPTS = ("docx", "epub"), 280, 3, 8
PLACE = ("page", "slide", "sheet")
FIELDS = ("doc_id", "ord", "parent", "type", "text", "path", "page", "slide", "sheet", "cells", "parser")


def placed(n: DataFrame) -> DataFrame:
    """Nodes with the page, slide and sheet of the nearest container that tells one, the node itself first."""
    level = written(n.select("doc_id", "ord", F.col("parent").alias("up"), *PLACE), "places")
    while level.filter("up is not null").head(1):
        above = level.select("doc_id", F.col("ord").alias("up"), F.col("up").alias("next"), *(F.col(c).alias(f"above_{c}") for c in PLACE))
        both = level.join(above, ["doc_id", "up"], "left")
        level = written(both.select("doc_id", "ord", F.col("next").alias("up"), *(F.coalesce(c, f"above_{c}").alias(c) for c in PLACE)), "places")
    return n.drop(*PLACE).join(level.drop("up"), ["doc_id", "ord"])


def included(n: DataFrame) -> DataFrame:
    """Nodes that are pieces by themselves: containers and tables with text, but no sheet whose rows or tables are nodes; leaves only in flowing documents without pages and slides."""
    paged = n.groupBy("doc_id").agg(F.max(F.col("type").isin("page", "slide")).alias("paged"))
    rows = n.filter(F.col("type").isin("table", "table_row")).select("doc_id", F.col("parent").alias("ord")).distinct().withColumn("ruled", F.lit(True))
    met = n.join(paged, "doc_id").join(rows, ["doc_id", "ord"], "left")
    leaf = F.col("type").isin(*LEAVES) & ~F.col("paged") & F.coalesce("parser", F.lit("")).isin(*FLOWING)
    kept = (F.col("type").isin(*UNITS, *TABLES) | leaf) & ~((F.col("type") == "sheet") & F.coalesce("ruled", F.lit(False)))
    return met.filter(kept & (F.trim(F.regexp_replace("text", r"\s", " ")) != "")).drop("paged", "ruled")


def label(type_: Column, path: Column, page: Column, slide: Column, sheet: Column, cells: Column) -> Column:
    """The heading of a piece: the headings above it, else the name of its container."""
    own = F.when(type_ == "page", F.concat(F.lit("Page "), page.cast("string"))).when(type_ == "slide", F.concat(F.lit("Slide "), slide.cast("string")))
    own = own.when(type_ == "sheet", sheet).when(type_ == "table_row", cells).when(type_ == "table", "Table")
    return F.trim(F.coalesce(F.nullif(F.array_join(path, " / "), F.lit("")), own, F.lit("")))


def _cut(size: int, limit: int, overlap: int):
    @F.pandas_udf("array<struct<text: string, heading: string>>")
    def cut(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            yield pd.Series([[{"text": t, "heading": h} for t, h in chunker.refine(chunker.smart(x, size, overlap), limit)] for x in texts], dtype=object)

    return cut


def pieces(n: DataFrame, size: int = chunker.SIZE, limit: int = 0, overlap: int = 0) -> DataFrame:
    """(doc_id, idx, ord, type, heading, text, page, slide, sheet, cells): the chunks of nodes, none of which crosses a page, slide, sheet or table.

    A node's text is cut by the smart chunker of ``size`` tokens and halved beyond ``limit``. A document without any node
    to be included is cut as one text, its document node's, with the chunker's own headings. Null texts are empty; a
    document of empty texts has no pieces.
    """
    n = written(placed(n.withColumn("text", F.coalesce("text", F.lit("")))), "nodes")
    cut = _cut(size, limit, overlap)
    own = included(n)
    bound = own.withColumn("label", label(*(F.col(c) for c in ("type", "path", "page", "slide", "sheet", "cells"))))
    flat = n.filter("type = 'document'").join(own.select("doc_id").distinct(), "doc_id", "left_anti").withColumn("label", F.lit(None).cast("string"))
    every = bound.select(*flat.columns).unionByName(flat).withColumn("p", cut(normalize(F.col("text"))))
    out = every.select("doc_id", "ord", "type", "label", "page", "slide", "sheet", "cells", F.posexplode("p").alias("i", "p"))
    idx = F.row_number().over(Window.partitionBy("doc_id").orderBy("ord", "i")) - 1
    return out.select("doc_id", idx.cast("long").alias("idx"), "ord", "type", F.coalesce("label", "p.heading").alias("heading"), "p.text", "page", "slide", "sheet", "cells")


def anchors(pieces_: DataFrame) -> DataFrame:
    """(doc_id, idx, pages, slides, sheets, types): where each piece lies, as ``search`` filters by it."""
    one = lambda c: F.array_compact(F.array(F.col(c)))
    return pieces_.select("doc_id", "idx", one("page").alias("pages"), one("slide").alias("slides"), one("sheet").alias("sheets"), F.array("type").alias("types"))


def row_text(cells: Column, headers: Column) -> Column:
    """A sheet's row as ``header=value / ...``: empty cells are left out, cells without a header stand alone."""
    said = F.transform(F.arrays_zip(cells.alias("v"), headers.alias("h")), lambda x: F.when(F.coalesce(F.trim(x["v"]), F.lit("")) != "", F.when(F.coalesce(F.trim(x["h"]), F.lit("")) != "", F.concat(F.trim(x["h"]), F.lit("="), F.trim(x["v"]))).otherwise(F.trim(x["v"]))))
    return F.array_join(F.array_compact(said), " / ")


def of_office(files: DataFrame) -> DataFrame:
    """Nodes of office files as ``office_files`` reads them: slides and sheets become containers of what has their place; doc_id is the path."""
    kind = F.lower(F.element_at(F.split("name", "[.]"), -1))
    at = files.filter("idx is not null").select("path", kind.alias("parser"), "idx", "kind", "level", "place", "text")
    slide = F.when(F.col("parser") == "pptx", F.regexp_extract("place", r"^slide (\d+)$", 1).cast("int"))
    sheet = F.when(F.col("parser").isin("xlsx", "xlsm"), F.regexp_extract("place", "^(.*)!", 1))
    cells = F.when(sheet.isNotNull(), F.regexp_extract("place", "([^!]*)$", 1))
    at = at.withColumns({"slide": slide, "sheet": sheet, "cells": cells})
    holds = at.groupBy("path", "parser", "slide", "sheet").agg(F.min("idx").alias("idx"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "text"))), lambda x: x["text"]), "\n").alias("text")).filter("slide is not null or sheet is not null")
    # a container comes before what it holds, the document before all; twice the index leaves room between
    top = at.groupBy("path", "parser").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "text"))), lambda x: x["text"]), "\n\n").alias("text"))
    none = lambda t: F.lit(None).cast(t)
    empty = F.array().cast("array<string>")
    doc = top.select(F.col("path").alias("doc_id"), F.lit(-1).alias("ord"), none("int").alias("parent"), F.lit("document").alias("type"), "text", empty.alias("path"), none("int").alias("page"), none("int").alias("slide"), none("string").alias("sheet"), none("string").alias("cells"), "parser")
    box = holds.select(F.col("path").alias("doc_id"), (2 * F.col("idx")).cast("int").alias("ord"), F.lit(-1).alias("parent"), F.when(F.col("slide").isNotNull(), "slide").otherwise("sheet").alias("type"), "text", empty.alias("path"), none("int").alias("page"), "slide", "sheet", none("string").alias("cells"), "parser")
    first = holds.select("path", F.col("slide").alias("s"), F.col("sheet").alias("t"), (2 * F.col("idx")).cast("int").alias("box"))
    inner = at.join(first.withColumnRenamed("path", "of"), (F.col("path") == F.col("of")) & F.col("slide").eqNullSafe(F.col("s")) & F.col("sheet").eqNullSafe(F.col("t")), "left")
    type_ = F.when(F.col("sheet").isNotNull(), "table_row").when(F.col("kind") == "row", "table_row").when(F.col("kind") == "slide", "block").otherwise(F.col("kind"))
    leaf = inner.select(F.col("path").alias("doc_id"), (2 * F.col("idx") + 1).cast("int").alias("ord"), F.coalesce("box", F.lit(-1)).alias("parent"), type_.alias("type"), "text", empty.alias("path"), none("int").alias("page"), none("int").alias("slide"), none("string").alias("sheet"), "cells", "parser")
    return doc.unionByName(box).unionByName(leaf)


# --- what is told of a document from its nodes --------------------------
def said(n: DataFrame) -> DataFrame:
    """(doc_id, text): all texts but the document's own, in order, with blank lines between; where there are none, the document's own."""
    t = F.trim("text")
    parts = F.array_sort(F.collect_list(F.when((F.col("type") != "document") & (t != ""), F.struct("ord", t.alias("t")))))
    own = F.min_by(t, "ord")
    g = n.groupBy("doc_id").agg(parts.alias("p"), own.alias("own"))
    return g.select("doc_id", F.when(F.size("p") > 0, F.array_join(F.transform("p", lambda x: x["t"]), "\n\n")).otherwise(F.coalesce("own", F.lit(""))).alias("text"))


def summary(text: Column, most: int = SUMMARY) -> Column:
    """A text in one line, cut behind ``most`` characters with a sign of it."""
    line = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(F.length(line) > most, F.concat(F.left(line, F.lit(most)), F.lit("…"))).otherwise(line)


def sections(n: DataFrame) -> DataFrame:
    """(doc_id, ord, summary, sources): a row for each heading and section: its own text and the next two that aren't blank, up to the next heading; ``sources`` are the ords told of."""
    head = F.col("type").isin("heading", "section")
    order = Window.partitionBy("doc_id").orderBy("ord")
    own = n.filter("type <> 'document'").withColumn("s", F.sum(head.cast("long")).over(order)).filter("s > 0").filter(head | (F.trim("text") != ""))
    kept = own.withColumn("i", F.row_number().over(Window.partitionBy("doc_id", "s").orderBy("ord"))).filter(F.col("i") <= PARTS)
    g = kept.groupBy("doc_id", "s").agg(F.array_sort(F.collect_list(F.struct("ord", F.trim("text").alias("t")))).alias("p"))
    return g.select("doc_id", F.col("p")[0]["ord"].alias("ord"), summary(F.array_join(F.transform("p", lambda x: x["t"]), " ")).alias("summary"), F.transform("p", lambda x: x["ord"]).alias("sources"))


def concepts(texts: DataFrame, most: int = CONCEPTS) -> DataFrame:
    """(doc_id, concepts): the ``most`` most frequent words of (doc_id, text), of any script, ties by the word; words count from four characters and two tokens on. Texts without any have no row."""
    words = F.regexp_extract_all(F.lower("text"), F.lit(r"([\p{L}\p{Nd}]+)"), 1)
    w = texts.select("doc_id", F.explode(words).alias("w")).filter((F.length("w") >= 4) & (token_estimate(F.col("w")) > 1))
    c = w.groupBy("doc_id", "w").agg(F.count("*").alias("n"))
    top = c.withColumn("i", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("n"), "w"))).filter(F.col("i") <= most)
    return top.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "w"))), lambda x: x["w"]), ", ").alias("concepts"))


def derived(n: DataFrame) -> DataFrame:
    """(doc_id, kind, ord, content): document_summary, section_summary (by the heading's ord) and key_concepts of documents; blank ones have no row."""
    n = n.withColumn("text", F.coalesce("text", F.lit("")))
    text = said(n)
    none = F.lit(None).cast("int").alias("ord")
    whole = text.filter("text <> ''").select("doc_id", F.lit("document_summary").alias("kind"), none, summary(F.col("text")).alias("content"))
    each = sections(n).select("doc_id", F.lit("section_summary").alias("kind"), "ord", F.col("summary").alias("content"))
    return whole.unionByName(each).unionByName(concepts(text).select("doc_id", F.lit("key_concepts").alias("kind"), none, F.col("concepts").alias("content")))
