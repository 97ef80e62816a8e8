"""Queries of document trees: pages of web captures, sheets of parts, sections of documents."""

from __future__ import annotations

from papyra.plans.catalogue import F, docs, query, table
from papyra.sources import ir
from papyra.sources import structure as St

SIZE = 64


def none(kind: str):
    return F.lit(None).cast(kind)


def _node(df, doc, ord_, parent, type_, text, page=None, slide=None, sheet=None, cells=None, parser="pdf"):
    pick = lambda c, t: none(t) if c is None else c.cast(t)
    return df.select(
        doc.alias("doc_id"), ord_.cast("int").alias("ord"), parent.cast("int").alias("parent"), F.lit(type_).alias("type"), text.alias("text"), F.array().cast("array<string>").alias("path"),
        pick(page, "int").alias("page"), pick(slide, "int").alias("slide"), pick(sheet, "string").alias("sheet"), pick(cells, "string").alias("cells"), F.lit(parser).alias("parser"))


def captured(spark, sf):
    """Web captures as documents: five captures are the pages of one (every third such document has slides in their place), each page with the capture's words and, as paragraphs in it, its host and the words again."""
    words = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace("html", "<[^>]*>", " "), r"[^\p{L}\p{N}]", " "), " +", " "))
    p = table(spark, sf, "pages").select(F.floor(F.col("page_id") / 5).alias("d"), (F.col("page_id") % 5).alias("i"), "url", words.alias("words"))
    doc, at, slides = F.concat(F.lit("capture "), F.col("d").cast("string")), 10 * (F.col("i") + 1), F.col("d") % 3 == 0
    number = F.col("i") + 1
    top = _node(p.select("d").distinct(), doc, F.lit(0), none("int"), "document", F.lit("all"))
    pages = _node(p.filter(~slides), doc, at, F.lit(0), "page", F.col("words"), page=number)
    shown = _node(p.filter(slides), doc, at, F.lit(0), "slide", F.col("words"), slide=number)
    inner = _node(p, doc, at + 1, at, "heading", F.col("url")).unionByName(_node(p, doc, at + 2, at + 1, "paragraph", F.col("words")))
    noted = _node(p.filter("i = 2"), doc, at + 3, at + 2, "footnote", F.concat(F.lit("note to "), F.col("url")))  # deep in a page
    return top.unionByName(pages).unionByName(shown).unionByName(inner).unionByName(noted)


def ruled(spark, sf):
    """Parts as sheets of twenty rows; sheets of even number have rows as nodes, with cells in them, the others only their text."""
    p = table(spark, sf, "part").select(F.floor(F.col("p_partkey") / 20).alias("s"), (F.col("p_partkey") % 20).alias("i"), "p_name", "p_brand", F.when(F.col("p_size") % 3 == 0, "").otherwise(F.col("p_size").cast("string")).alias("size"))
    doc, even = F.concat(F.lit("workbook "), F.floor(F.col("s") / 4).cast("string")), F.col("s") % 2 == 0
    at = 1000 * (F.col("s") % 4 + 1)
    name = F.concat(F.lit("Sheet "), F.col("s").cast("string"))
    cells = F.array("p_name", "p_brand", "size")
    row = St.row_text(cells, F.array(F.lit("name"), F.lit(""), F.lit("size")))
    top = _node(p.select("s").distinct().withColumn("w", F.floor(F.col("s") / 4)).dropDuplicates(["w"]), doc, F.lit(0), none("int"), "document", F.lit("all"), parser="xlsx")
    sheets = p.groupBy("s").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "p_name"))), lambda x: x["p_name"]), " ").alias("names"))
    boxes = _node(sheets, doc, at, F.lit(0), "sheet", F.col("names"), sheet=name, parser="xlsx")
    rows = _node(p.filter(even), doc, at + 2 * F.col("i") + 1, at, "table_row", row, cells=F.concat(F.lit("A"), (F.col("i") + 1).cast("string")), parser="xlsx")
    inner = _node(p.filter(even), doc, at + 2 * F.col("i") + 2, at + 2 * F.col("i") + 1, "table_cell", F.col("p_name"), parser="xlsx")
    return top.unionByName(boxes).unionByName(rows).unionByName(inner)


def _slices(text: str) -> str:
    """Pieces of a line of words: whole if it fits the budget, else slices as wide as it."""
    room = f"greatest(64, CAST(floor({SIZE} * length({text}) / greatest(1, ceil(length({text}) / 4.0)) + 0.5) AS BIGINT))"
    whole = f"strlen({text}) <= {room} OR length({text}) <= {room}"
    return f"CASE WHEN {whole} THEN [{text}] ELSE list_filter(list_transform(generate_series(0, (length({text}) - 1) // {room}), lambda i: trim(substr({text}, CAST(1 + i * {room} AS BIGINT), {room}))), lambda x: x <> '') END"


_BOUND = rf"""w AS (SELECT page_id // 5 AS d, page_id % 5 AS i, url, trim(regexp_replace(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '[^\p{{L}}\p{{N}}]', ' ', 'g'), ' +', ' ', 'g')) AS words FROM pages),
r AS (SELECT p_partkey // 20 AS s, p_partkey % 20 AS i, p_name, p_brand, CASE WHEN p_size % 3 = 0 THEN '' ELSE CAST(p_size AS VARCHAR) END AS size FROM part),
n AS (SELECT 'capture ' || d AS doc_id, 10 * (i + 1) AS ord, CASE WHEN d % 3 = 0 THEN 'slide' ELSE 'page' END AS type, CASE WHEN d % 3 = 0 THEN 'Slide ' ELSE 'Page ' END || (i + 1) AS heading, words AS text, CASE WHEN d % 3 <> 0 THEN i + 1 END AS page, CASE WHEN d % 3 = 0 THEN i + 1 END AS slide, NULL AS sheet FROM w
 UNION ALL SELECT 'capture ' || d, 10 * (i + 1) + 3, 'footnote', '', 'note to ' || url, CASE WHEN d % 3 <> 0 THEN i + 1 END, CASE WHEN d % 3 = 0 THEN i + 1 END, NULL FROM w WHERE i = 2
 UNION ALL SELECT 'workbook ' || (s // 4), 1000 * (s % 4 + 1) + 2 * i + 1, 'table_row', 'A' || (i + 1), 'name=' || p_name || ' / ' || p_brand || CASE WHEN size <> '' THEN ' / size=' || size ELSE '' END, NULL, NULL, 'Sheet ' || s FROM r WHERE s % 2 = 0
 UNION ALL SELECT 'workbook ' || (s // 4), 1000 * (s % 4 + 1), 'sheet', 'Sheet ' || s, string_agg(p_name, ' ' ORDER BY i), NULL, NULL, 'Sheet ' || s FROM r WHERE s % 2 = 1 GROUP BY s),
c AS (SELECT *, unnest(generate_series(1, len(p))) AS j FROM (SELECT n.*, {_slices("text")} AS p FROM n WHERE text <> ''))"""


@query(f"WITH {_BOUND} SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY ord, j) - 1 AS idx, type, heading, p[j] AS text, CAST(page AS INTEGER) AS page, CAST(slide AS INTEGER) AS slide, sheet FROM c")
def structure_bounds(spark, sf):
    """Pieces of pages, slides, sheets and rows: none crosses a bound, and each knows where it lies, however deep its node is."""
    n = captured(spark, sf).unionByName(ruled(spark, sf))
    return St.pieces(n, size=SIZE).select("doc_id", "idx", "type", "heading", "text", "page", "slide", "sheet")


def sectioned(spark, sf):
    """Documents as Markdown of which every seventh line is a heading."""
    lines = F.filter(F.transform(F.split(F.replace("text", F.lit("#"), F.lit("")), "\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")
    body = F.array_join(F.transform(lines, lambda x, i: F.when(i % 7 == 0, F.concat(F.lit("# "), x)).otherwise(x)), "\n\n")
    return ir.nodes(docs(spark, sf).select("doc_id", "source", body.alias("text")).withColumnRenamed("source", "title"))


_SECTIONS = r"""np AS (SELECT doc_id, list_filter(list_transform(string_split(replace(text, '#', ''), chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS p FROM documents),
nn AS (SELECT doc_id, i, p[i] AS text FROM (SELECT *, unnest(generate_series(1, len(p))) AS i FROM np)),
wh AS (SELECT doc_id, string_agg(text, chr(10) || chr(10) ORDER BY i) AS t FROM nn GROUP BY doc_id),
se AS (SELECT doc_id, min(i) AS ord, string_agg(text, ' ' ORDER BY i) AS t FROM nn WHERE (i - 1) % 7 < 3 GROUP BY doc_id, (i - 1) // 7),
ww AS (SELECT doc_id, unnest(regexp_extract_all(lower(t), '[\p{L}\p{Nd}]+')) AS w FROM wh),
wc AS (SELECT doc_id, w, row_number() OVER (PARTITION BY doc_id ORDER BY count(*) DESC, w) AS i FROM ww WHERE length(w) >= 5 GROUP BY doc_id, w QUALIFY i <= 8)"""
_SHORT = r"CASE WHEN length(trim(regexp_replace({0}, '\s+', ' ', 'g'))) > 280 THEN left(trim(regexp_replace({0}, '\s+', ' ', 'g')), 280) || '…' ELSE trim(regexp_replace({0}, '\s+', ' ', 'g')) END"


@query(f"""WITH {_SECTIONS} SELECT doc_id, 'document_summary' AS kind, CAST(NULL AS INTEGER) AS ord, {_SHORT.format('t')} AS content FROM wh
UNION ALL SELECT doc_id, 'section_summary', CAST(ord AS INTEGER), {_SHORT.format('t')} FROM se UNION ALL SELECT doc_id, 'key_concepts', NULL, string_agg(w, ', ' ORDER BY i) FROM wc GROUP BY doc_id""")
def derived_knowledge(spark, sf):
    """Summaries of documents and of their sections, and the words that are frequent in them."""
    return St.derived(sectioned(spark, sf))
