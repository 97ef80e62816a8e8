"""Queries of data dictionaries: sheets made of parts, twenty to a document, in two regions with a gap and titles between."""

from __future__ import annotations

from functools import reduce

from papyra.functions import dictionary as D
from papyra.operators import dictionaries as Di
from papyra.plans.catalogue import F, query, table


def sheets(spark, sf):
    """Row 1 a title, 2 a header, 3 to 12 fields; after a gap rows 30 to 34 of one cell each; 50 a header, 51 to 55 fields, of which two have one name."""
    p = table(spark, sf, "part")
    i, d = F.col("p_partkey") % 20, F.floor(F.col("p_partkey") / 20)
    row = F.when(i < 10, i + 3).when(i < 15, i + 20).otherwise(i + 36)
    cells = F.when(i < 10, F.array(F.concat_ws("_", "p_name", i.cast("string"), F.lit("id")), "p_type", F.concat(F.lit("order "), "p_brand"), F.when(F.col("p_size") % 2 == 1, "1:on;2=off").otherwise(""), F.when(F.col("p_size") % 5 == 0, "Y").otherwise("")))
    cells = cells.when(i < 15, F.array("p_name", F.lit(""))).otherwise(F.array(F.when(i >= 18, F.lit("user_state")).otherwise(F.concat_ws(" ", F.lit("start  date"), i.cast("string"))), F.lit("text"), F.concat_ws(" ", "p_type", F.lit("site"))))
    body = p.select(d.alias("doc_id"), F.lit("Sheet 1").alias("sheet"), row.alias("row"), cells.alias("cells"))
    docs_ = body.select("doc_id", "sheet").distinct()
    title = docs_.select("doc_id", "sheet", F.lit(1).cast("long").alias("row"), F.array(F.concat(F.lit("Catalogue "), F.col("doc_id").cast("string")), F.lit("")).alias("cells"))
    head = docs_.select("doc_id", "sheet", F.lit(2).cast("long").alias("row"), F.array(*map(F.lit, ("Field name", "Data type", "Description", "Enum", "Primary key"))).alias("cells"))
    again = docs_.select("doc_id", "sheet", F.lit(50).cast("long").alias("row"), F.array(*map(F.lit, ("Column name", "TYPE", "notes"))).alias("cells"))
    return reduce(lambda a, b: a.unionByName(b), (body, title, head, again))


_FIELDS = """p AS (SELECT *, p_partkey // 20 AS doc_id, p_partkey % 20 AS i FROM part),
nm AS (SELECT doc_id, max(p_name) FILTER (i = 14) AS second FROM p GROUP BY doc_id),
fd AS (SELECT doc_id, 1 AS region, 'Catalogue ' || doc_id AS tab, p_name || '_' || i || '_id' AS name, p_type AS type, 'order ' || p_brand AS meaning, p_size % 2 = 1 AS enum, p_size % 5 = 0 AS primary_key, 1.0 * 0.92 AS confidence FROM p WHERE i < 10
UNION ALL SELECT doc_id, 2, second, CASE WHEN i >= 18 THEN 'user_state' ELSE 'start date ' || i END, 'text', p_type || ' site', false, false, 0.88 * 0.92 FROM p JOIN nm USING (doc_id) WHERE i BETWEEN 15 AND 18),
cf AS (SELECT *, lower(name || ' ' || meaning || ' ' || tab) AS t FROM fd),
cs AS (""" + " UNION ALL ".join(f"SELECT doc_id, region, tab, name, '{n}' AS c FROM cf WHERE regexp_matches(t, '{'|'.join(w)}')" for n, w in D.CONCEPTS.items()) + ")"  # fmt: skip


@query(f"WITH {_FIELDS} SELECT doc_id, region::BIGINT AS region, tab AS table_name, name, type, meaning, enum, primary_key, round(least(confidence, 1)::DOUBLE, 6) AS confidence FROM fd")
def dictionary_fields(spark, sf):
    f = Di.fields(sheets(spark, sf))
    return f.select("doc_id", "region", F.col("table").alias("table_name"), "name", "type", "meaning", (F.size("enum") > 0).alias("enum"), F.col("primary").alias("primary_key"), F.round("confidence", 6).alias("confidence"))


@query("""WITH p AS (SELECT p_partkey // 20 AS doc_id, p_partkey % 20 AS i FROM part) SELECT doc_id, 'title' AS kind, 1 + count(*) FILTER (i BETWEEN 10 AND 14) AS n FROM p GROUP BY doc_id
UNION ALL SELECT doc_id, 'header', 2 FROM p GROUP BY doc_id UNION ALL SELECT doc_id, 'data', count(*) FILTER (i < 10 OR i >= 15) FROM p GROUP BY doc_id""")
def dictionary_regions(spark, sf):
    r = Di.regions(sheets(spark, sf)).groupBy("doc_id", F.when(F.col("kind") == "outside", "title").otherwise(F.col("kind")).alias("kind")).agg(F.count("*").alias("n"))
    return r.select("doc_id", "kind", "n")


@query(f"WITH {_FIELDS} SELECT c AS concept, doc_id, count(*) AS fields FROM cs GROUP BY c, doc_id")
def concept_index(spark, sf):
    return Di.concept_index(Di.fields(sheets(spark, sf))).select("concept", "doc_id", "fields")


@query(f"WITH {_FIELDS} SELECT doc_id, region::BIGINT AS region, tab AS table_name FROM cs WHERE c IN ('User Identifier', 'Site') GROUP BY doc_id, region, tab HAVING count(DISTINCT c) = 2")
def concept_division(spark, sf):
    return Di.tables_with(Di.fields(sheets(spark, sf)), ["User Identifier", "Site"]).select("doc_id", "region", F.col("table").alias("table_name"))


@query(f"""WITH {_FIELDS}, s AS (SELECT doc_id, region, tab, name, lower(name || ' ' || replace(lower(name), '_', ' ') || ' ' || meaning || ' ' || type) AS t, EXISTS (SELECT 1 FROM cs WHERE cs.doc_id = cf.doc_id AND cs.region = cf.region AND cs.name = cf.name AND c IN ('Time', 'Order')) AS hit FROM cf),
x AS (SELECT *, CASE WHEN contains(t, 'order') THEN 1 ELSE 0 END + CASE WHEN contains(t, 'date') THEN 1 ELSE 0 END + CASE WHEN contains(t, 'order date') THEN 2 ELSE 0 END + CASE WHEN hit THEN 4 ELSE 0 END AS score FROM s)
SELECT score::DOUBLE AS score, count(*) AS n FROM x WHERE score > 0 GROUP BY score""")
def schema_search(spark, sf):
    """How many fields have each score for a question; the best hundred are what a user sees."""
    return Di.scored(Di.fields(sheets(spark, sf)), "order date").groupBy("score").agg(F.count("*").alias("n"))


@query(f"""WITH {_FIELDS}, s AS (SELECT DISTINCT doc_id, region, tab, name FROM cs WHERE c IN ('User Identifier', 'Status')), h AS (SELECT doc_id, region, tab, count(*) AS hits FROM s GROUP BY doc_id, region, tab)
SELECT doc_id, region::BIGINT AS region, tab AS table_name, round(2 + hits * 0.1::DOUBLE + CASE WHEN contains(lower(tab), 'user') THEN 1 ELSE 0 END + CASE WHEN contains(lower(tab), 'state') THEN 1 ELSE 0 END, 6) AS score FROM h ORDER BY score DESC, tab, doc_id, region LIMIT 100""")
def schema_table_search(spark, sf):
    return Di.search_tables(Di.fields(sheets(spark, sf)), "user state", 100).select("doc_id", "region", F.col("table").alias("table_name"), "score")


@query(f"""WITH {_FIELDS}, f AS (SELECT *, doc_id || '/' || region || '/' || name AS id FROM fd), e AS (SELECT *, doc_id || '/' || region || '/' || name AS id FROM cs),
sc AS (SELECT a.id AS l, b.id AS r, count(*) AS n FROM e a JOIN e b ON a.c = b.c AND b.doc_id = a.doc_id + 1 GROUP BY a.id, b.id),
x AS (SELECT a.doc_id || '/' || a.region || '/' || a.name AS l, b.doc_id || '/' || b.region || '/' || b.name AS r, least(0.85, CASE WHEN lower(a.name) = lower(b.name) THEN 0.45 WHEN contains(lower(a.name), lower(b.name)) OR contains(lower(b.name), lower(a.name)) THEN 0.22 ELSE 0 END + 0.28 * coalesce(n, 0)
 + CASE WHEN lower(a.type) = lower(b.type) THEN 0.12 ELSE 0 END + CASE WHEN regexp_matches(lower(a.name), '(id|key|no|number)$') AND regexp_matches(lower(b.name), '(id|key|no|number)$') THEN 0.08 ELSE 0 END) AS score
 FROM f a JOIN f b ON b.doc_id = a.doc_id + 1 LEFT JOIN sc ON sc.l = a.id AND sc.r = b.doc_id || '/' || b.region || '/' || b.name)
SELECT l, r, round(score::DOUBLE, 6) AS score FROM x WHERE score >= 0.45""")
def candidate_joins(spark, sf):
    """Fields of each document against those of the next."""
    f = Di.fields(sheets(spark, sf)).withColumn("field_id", F.concat_ws("/", F.col("doc_id").cast("string"), F.col("region").cast("string"), "name"))
    return Di.candidate_joins(f.withColumn("pair", F.col("doc_id") + 1), f.withColumn("pair", F.col("doc_id")), "pair").select(F.col("left_id").alias("l"), F.col("right_id").alias("r"), "score")


@query(f"""WITH {_FIELDS}, r AS (SELECT c, cs.name, cs.tab, round(least(confidence, 1)::DOUBLE, 6) AS confidence, row_number() OVER (PARTITION BY c ORDER BY round(least(confidence, 1)::DOUBLE, 9) DESC, cs.name) AS n FROM cs JOIN fd USING (doc_id, region, tab, name))
SELECT q.c AS concept, count(r.name) AS found, max(confidence) AS confidence FROM (VALUES ('Status'), ('Roaming'), ('Time')) AS q(c) LEFT JOIN r ON r.c = q.c AND n <= 5 GROUP BY q.c""")
def data_requirement(spark, sf):
    """What a question about status, roaming and time needs: fields, or nothing where no field speaks of it."""
    r = Di.requirement(Di.fields(sheets(spark, sf)), "roaming state by date")
    return r.groupBy("concept").agg(F.count("name").alias("found"), F.round(F.max("confidence"), 6).alias("confidence"))


@query(f"WITH {_FIELDS} SELECT count(*) AS n, 'defined twice' AS fault FROM (SELECT doc_id FROM p WHERE i >= 18 GROUP BY doc_id HAVING count(DISTINCT p_type) > 1) HAVING count(*) > 0")
def dictionary_faults(spark, sf):
    return Di.faults(Di.fields(sheets(spark, sf))).groupBy("fault").agg(F.count("*").alias("n"))


@query("SELECT p_partkey AS row, p_name || '|' || coalesce(NULL, '') || '|' || p_type AS cells FROM part WHERE p_partkey > 0")
def cell_rows(spark, sf):
    """Cells in columns A and C as rows of three."""
    p = table(spark, sf, "part").filter("p_partkey > 0")
    cell = lambda c, t: p.select(F.lit(1).alias("doc_id"), F.lit("S").alias("sheet"), F.concat(F.lit(c), F.col("p_partkey").cast("string")).alias("ref"), F.col(t).alias("text"))
    r = Di.positional(cell("C", "p_type").unionByName(cell("A", "p_name")))
    return r.select("row", F.array_join("cells", "|", "").alias("cells"))


@query(r"""SELECT conv_id, turn, CASE WHEN regexp_matches(q, 'join|candidate key') THEN 'join_candidate' WHEN regexp_matches(q, 'resolve') THEN 'data_requirement' WHEN regexp_matches(q, 'enum') THEN 'enum_lookup' WHEN contains(q, ' fields') THEN 'exact_table'
WHEN contains(q, 'what is') THEN 'exact_field' WHEN contains(q, 'field') THEN 'semantic_field' ELSE 'table_discovery' END AS intent
FROM (SELECT conv_id, turn, ['which tables join on ', 'resolve ', 'the enum of ', 'orders fields ', 'what is ', 'a field about ', ''][turn % 7 + 1] || lower(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS q FROM conversations)""")
def schema_intent(spark, sf):
    c = table(spark, sf, "conversations")
    lead = F.element_at(F.array(*map(F.lit, ("which tables JOIN on ", "resolve ", "the enum of ", "orders fields ", "What is ", "a field about ", ""))), (F.col("turn") % 7 + 1).cast("int"))
    return c.select("conv_id", "turn", Di.intent(F.concat(lead, "text")).alias("intent"))
