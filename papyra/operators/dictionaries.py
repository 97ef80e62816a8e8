"""Data dictionaries in spreadsheets: tables and fields from rows, search over them, joins they suggest, what a requirement lacks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from papyra.functions import dictionary as D
from papyra.functions.language import identifier, one_space, schema_terms
from papyra.functions.text import stable_id

#: What a field's sureness is of its table's, and what joins score.
OF_TABLE = 0.92
SAME_NAME, RELATED_NAME, SHARED_CONCEPT, SAME_TYPE, BOTH_KEYS, LEAST, MOST = 0.45, 0.22, 0.28, 0.12, 0.08, 0.45, 0.85


def regions(rows: DataFrame) -> DataFrame:
    """Rows (doc_id, sheet, row, cells) of sheets with what they are: region, header (cells of its header row), title, score, kind (header, data or outside).

    A header row begins a region, which ends at the next header, or where row numbers leave a gap. Rows outside with a
    single cell are titles; the last one before a header names its region. A title right above a header is put before
    the header's cells where that makes a surer header.
    """
    own = Window.partitionBy("doc_id", "sheet").orderBy("row")
    r = rows.withColumns({"is_header": D.is_header(F.col("cells")), "gap": F.col("row") > F.lag("row").over(own) + 1, "above": F.lag("cells").over(own)})
    r = r.withColumn("region", F.sum(F.col("is_header").cast("int")).over(own))
    inside = Window.partitionBy("doc_id", "sheet", "region").orderBy("row")
    broken = F.max((F.coalesce("gap", F.lit(False)) & ~F.col("is_header")).cast("int")).over(inside) == 1
    r = r.withColumn("kind", F.when(F.col("is_header"), "header").when((F.col("region") == 0) | broken, "outside").otherwise("data"))
    first = F.try_element_at(F.filter(F.transform("cells", lambda c: one_space(F.coalesce(c, F.lit("")))), lambda c: c != ""), F.lit(1))
    r = r.withColumn("label", F.when((F.col("kind") == "outside") & D.is_title(F.col("cells")), first))
    seen = Window.partitionBy("doc_id", "sheet", F.col("region") - F.col("is_header").cast("int")).orderBy("row")
    r = r.withColumn("named", F.when(F.col("is_header"), F.last("label", True).over(seen)))
    joined = F.zip_with("cells", F.coalesce("above", F.array().cast("array<string>")), lambda c, a: F.trim(F.concat_ws(" ", F.nullif(one_space(F.coalesce(a, F.lit(""))), F.lit("")), one_space(F.coalesce(c, F.lit(""))))))
    joined = F.slice(joined, 1, F.size("cells"))
    surer = D.is_title(F.col("above")) & (D.header_score(joined) > D.header_score(F.col("cells")))
    head = F.when(F.col("is_header"), F.when(F.coalesce(surer, F.lit(False)), joined).otherwise(F.col("cells")))
    carry = lambda c: F.first(c, True).over(inside.rowsBetween(Window.unboundedPreceding, 0))
    r = r.withColumn("head", head).withColumns({"header": carry("head"), "title": carry("named")})
    return r.select("doc_id", "sheet", "row", "cells", "region", "header", "title", D.header_score(F.col("header")).alias("score"), "kind")


def fields(rows: DataFrame) -> DataFrame:
    """Fields of the dictionaries in sheets: doc_id, sheet, region, table, name, type, meaning, enum, concepts, aliases, primary, join_hint, time_hint, confidence, row, field_id, repeats.

    Of rows with the same name in a table the first counts; ``repeats`` is true if a later one defines it otherwise.
    """
    d = regions(rows).filter("kind = 'data'")
    cell = lambda key: one_space(F.coalesce(F.when(D.header_column(F.col("header"), key) >= 0, F.get("cells", D.header_column(F.col("header"), key).cast("int"))), F.lit("")))
    table = F.coalesce(F.nullif(one_space(F.col("title")), F.lit("")), F.nullif(one_space(F.col("sheet")), F.lit("")), F.lit("logical_table"))
    f = d.select("doc_id", "sheet", "region", "row", "score", table.alias("table"), cell("field").alias("name"), cell("type").alias("type"), cell("meaning").alias("meaning"), cell("enum").alias("mapping"), cell("primary").alias("primary_cell")).filter("name <> ''")
    said = F.concat_ws("\x00", "type", "meaning", "mapping")
    same = Window.partitionBy("doc_id", "sheet", "region", "name")
    f = f.withColumns({"n": F.row_number().over(same.orderBy("row")), "kinds": F.size(F.collect_set(said).over(same))}).filter("n = 1")
    return f.select(
        "doc_id", "sheet", "region", "table", "name", "type", "meaning", D.enum_values(F.col("mapping")).alias("enum"), D.concepts(F.concat_ws(" ", "name", "meaning", "table")).alias("concepts"), D.aliases(F.col("name")).alias("aliases"),
        (F.col("primary_cell") != "").alias("primary"), D.join_hint(F.col("name")).alias("join_hint"), D.time_hint(F.col("name")).alias("time_hint"), F.least(F.col("score") * OF_TABLE, F.lit(1.0)).alias("confidence"), "row",
        stable_id(F.col("doc_id"), F.col("sheet"), F.col("region"), F.col("table"), F.col("name")).alias("field_id"), (F.col("kinds") > 1).alias("repeats"))


def tables(fields_: DataFrame) -> DataFrame:
    """(doc_id, sheet, region, table, fields, concepts, confidence)."""
    g = fields_.groupBy("doc_id", "sheet", "region", "table").agg(F.count("*").alias("fields"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("concepts")))).alias("concepts"), F.max("confidence").alias("c"))
    return g.select("doc_id", "sheet", "region", "table", "fields", "concepts", (F.col("c") / OF_TABLE).alias("confidence"))


def concept_index(fields_: DataFrame) -> DataFrame:
    """(concept, doc_id, fields): the fields of each document that speak of a concept."""
    return fields_.select("doc_id", "field_id", F.explode("concepts").alias("concept")).groupBy("concept", "doc_id").agg(F.count("*").alias("fields"), F.lit(0.62).alias("confidence"))


#: Words of each intent, in the order in which they are looked for.
INTENTS = (
    ("join_candidate", "可能通过|关联|join|candidate key"),
    ("cross_table", "哪些表|跨工作簿|跨表"),
    ("data_requirement", "需要哪些|分析|resolve"),
    ("enum_lookup", "取值|枚举|enum"),
    ("exact_table", "有哪些字段| fields|字段列表"),
    ("exact_field", "是什么|what is"),
    ("semantic_field", "字段|field"),
)


def intent(question: Column) -> Column:
    q, out = identifier(question), F.lit("table_discovery")
    for name, words in reversed(INTENTS):
        out = F.when(q.rlike(words), name).otherwise(out)
    return F.when(q == "", "unknown").otherwise(out)


def scored(fields_: DataFrame, question: str) -> DataFrame:
    """Fields that a question finds, with score: one for each term of the question that a field's name, aliases, meaning or type holds, two more for the whole question, four for a shared concept, one for an enumeration that is asked for."""
    spark = fields_.sparkSession
    q = spark.range(1).select(schema_terms(F.lit(question)).alias("terms"), identifier(F.lit(question)).alias("q"), D.concepts(F.lit(question)).alias("c"), intent(F.lit(question)).alias("i")).first()  # the question alone
    text = identifier(F.concat_ws(" ", "name", F.array_join("aliases", " "), "meaning", "type"))
    score = F.lit(0.0)
    for t in q["terms"]:
        score += text.contains(t).cast("double")
    score += F.when(text.contains(q["q"]), 2.0).otherwise(0.0)
    if q["c"]:
        score += F.when(F.arrays_overlap("concepts", F.array(*map(F.lit, q["c"]))), 4.0).otherwise(0.0)
    found = fields_.withColumn("score", score)
    if q["i"] == "enum_lookup":
        found = found.withColumn("score", F.col("score") + F.when((F.size("enum") > 0) & ((F.col("score") > 0) | F.contains(F.lit(q["q"]), identifier(F.col("name")))), 1.0).otherwise(0.0))
    return found.filter("score > 0")


def search(fields_: DataFrame, question: str, top_k: int = 10) -> DataFrame:
    """The best ``top_k`` (100 at most) of the fields that a question finds."""
    return scored(fields_, question).orderBy(F.desc("score"), "table", "name", "field_id").limit(max(1, min(top_k, 100)))


def search_tables(fields_: DataFrame, question: str, top_k: int = 10) -> DataFrame:
    """Tables with score, best first: terms and the whole question in the name, two for a shared concept and a tenth for each field that shares one."""
    q = fields_.sparkSession.range(1).select(schema_terms(F.lit(question)).alias("terms"), identifier(F.lit(question)).alias("q"), D.concepts(F.lit(question)).alias("c")).first()
    hit = F.arrays_overlap("concepts", F.array(*map(F.lit, q["c"]))) if q["c"] else F.lit(False)
    t = fields_.groupBy("doc_id", "sheet", "region", "table").agg(F.sum(F.coalesce(hit, F.lit(False)).cast("int")).alias("hits"), F.count("*").alias("fields"))
    name = identifier(F.col("table"))
    score = sum((name.contains(x).cast("double") for x in q["terms"]), F.lit(0.0)) + F.when(name.contains(q["q"]), 2.0).otherwise(0.0) + F.when(F.col("hits") > 0, 2 + F.col("hits") * 0.1).otherwise(0.0)
    return t.withColumn("score", F.round(score, 6)).filter("score > 0").orderBy(F.desc("score"), "table", "doc_id", "region").limit(max(1, min(top_k, 100)))


def tables_with(fields_: DataFrame, wanted: list[str]) -> DataFrame:
    """(doc_id, sheet, region, table) that have fields of every concept."""
    c = fields_.select("doc_id", "sheet", "region", "table", F.explode("concepts").alias("c")).filter(F.col("c").isin(wanted))
    return c.groupBy("doc_id", "sheet", "region", "table").agg(F.countDistinct("c").alias("n")).filter(F.col("n") == len(set(wanted))).drop("n")


def candidate_joins(left: DataFrame, right: DataFrame, side: str | None = None) -> DataFrame:
    """(left_id, right_id, score) of fields of different tables that may join: names, concepts, types and key hints add up to ``LEAST`` or more.

    No pair reaches it without an equal name or a shared concept, so pairs come from joins on these. ``side`` is a
    column of both that says which tables are compared with which; without it, each of one side with each of the other,
    which is for two tables and not for a library.
    """
    own = F.lit(0) if side is None else F.col(side)
    one = lambda f, p: f.select(own.alias(f"{p}_side"), F.col("field_id").alias(f"{p}_id"), F.struct("doc_id", "sheet", "region").alias(f"{p}_table"), identifier(F.col("name")).alias(f"{p}_name"), identifier(F.col("type")).alias(f"{p}_type"), F.col("concepts").alias(f"{p}_concepts"), F.col("join_hint").isNotNull().alias(f"{p}_key"))
    a, b = one(left, "left"), one(right, "right")
    by_name = a.join(b, (F.col("left_side") == F.col("right_side")) & (F.col("left_name") == F.col("right_name")))
    by_concept = a.withColumn("c", F.explode("left_concepts")).join(b.withColumn("d", F.explode("right_concepts")), (F.col("left_side") == F.col("right_side")) & (F.col("c") == F.col("d"))).drop("c", "d")
    pairs = by_name.unionByName(by_concept).filter(F.col("left_table") != F.col("right_table")).dropDuplicates(["left_id", "right_id"])
    n, m = F.col("left_name"), F.col("right_name")
    shared = F.size(F.array_intersect("left_concepts", "right_concepts"))
    score = F.when(n == m, SAME_NAME).when(F.contains(n, m) | F.contains(m, n), RELATED_NAME).otherwise(0.0) + shared * SHARED_CONCEPT
    score += F.when((F.col("left_type") == F.col("right_type")) & (F.col("left_type") != ""), SAME_TYPE).otherwise(0.0) + F.when(F.col("left_key") & F.col("right_key"), BOTH_KEYS).otherwise(0.0)
    return pairs.select("left_id", "right_id", F.round(F.least(score, F.lit(MOST)), 6).alias("score")).filter(F.col("score") >= LEAST)


def requirement(fields_: DataFrame, question: str, per_concept: int = 5) -> DataFrame:
    """(concept, field_id, name, table, confidence) of what a question needs; a concept that no field speaks of comes with nulls: it is unknown, not made up."""
    wanted = fields_.sparkSession.range(1).select(F.explode(D.concepts(F.lit(question))).alias("concept"))
    own = fields_.select(F.explode("concepts").alias("concept"), "field_id", "name", "table", "confidence")
    ranked = own.withColumn("n", F.row_number().over(Window.partitionBy("concept").orderBy(F.desc("confidence"), "name", "field_id"))).filter(F.col("n") <= per_concept).drop("n")
    return wanted.join(ranked, "concept", "left")


def faults(fields_: DataFrame) -> DataFrame:
    """(field_id, fault): repeated ids, fields without a name or table, sureness outside 0 to 1, definitions that differ."""
    twice = fields_.groupBy("field_id").count().filter("count > 1").select("field_id", F.lit("repeated id").alias("fault"))
    bare = fields_.filter("trim(name) = '' or trim(table) = ''").select("field_id", F.lit("nameless").alias("fault"))
    odd = fields_.filter("confidence < 0 or confidence > 1").select("field_id", F.lit("confidence").alias("fault"))
    differs = fields_.filter("repeats").select("field_id", F.lit("defined twice").alias("fault"))
    return twice.unionByName(bare).unionByName(odd).unionByName(differs)


def positional(cells: DataFrame) -> DataFrame:
    """(doc_id, sheet, row, cells): rows as arrays by column, gaps null, from (doc_id, sheet, ref, text) with references like B7."""
    c = cells.withColumns({"col": D.column_number(F.col("ref")), "row": D.row_number(F.col("ref"))})
    g = c.groupBy("doc_id", "sheet", "row").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("col", "text")))).alias("m"), F.max("col").alias("wide"))
    return g.select("doc_id", "sheet", "row", F.transform(F.sequence(F.lit(1), "wide"), lambda i: F.try_element_at("m", i)).alias("cells"))


def replaced(old: DataFrame, new: DataFrame) -> DataFrame:
    """The dictionary after documents were compiled anew: all fields of these come from the new one."""
    return old.join(new.select("doc_id").distinct(), "doc_id", "left_anti").unionByName(new)
