"""Queries of versions: identities, order, ranges, what changed, what stands for a history."""

from __future__ import annotations

from papyra.functions import questions as Q
from papyra.functions import versions as V
from papyra.operators import comparing as Cm
from papyra.operators import history as H
from papyra.operators.context import in_span
from papyra.plans.catalogue import F, query, table

#: Ways to write versions, made of a part's number and size.
_V = """v AS (SELECT p_partkey AS k, p_type AS scope, CASE p_partkey % 8 WHEN 0 THEN (p_size % 3 + 1) || '.' || p_size || '.' || p_partkey % 4 WHEN 1 THEN 'V' || (p_size % 3 + 1) || '.' || p_size WHEN 2 THEN 'v02' || lpad(p_size::VARCHAR, 2, '0') || '01' WHEN 3 THEN 'rel-' || p_size
 WHEN 4 THEN 'Release ' || p_size WHEN 5 THEN '1.' || p_size || '-beta' WHEN 6 THEN 'private' ELSE ' 2.' || p_size || '.0' END AS v, p_size AS z FROM part),
n AS (SELECT *, CASE k % 8 WHEN 0 THEN v WHEN 1 THEN substr(v, 2) WHEN 2 THEN '2.' || z || '.1' WHEN 3 THEN v WHEN 4 THEN 'rel-' || z WHEN 5 THEN v WHEN 6 THEN v ELSE trim(v) END AS n, k % 8 NOT IN (5, 6) AS known, k % 8 IN (3, 4) AS rel FROM v),
q AS (SELECT *, CASE WHEN known THEN list_slice(list_concat(list_transform(string_split(replace(n, 'rel-', ''), '.'), lambda s: CAST(s AS BIGINT)), [0::BIGINT, 0, 0, 0]), 1, 4) END AS parts FROM n)"""


def version_rows(spark, sf):
    k, z = F.col("p_partkey"), F.col("p_size")
    s = lambda c: c.cast("string")
    major = s(z % 3 + 1)
    ways = [
        F.concat_ws(".", major, s(z), s(k % 4)), F.concat(F.lit("V"), major, F.lit("."), s(z)), F.concat(F.lit("v02"), F.lpad(s(z), 2, "0"), F.lit("01")), F.concat(F.lit("rel-"), s(z)),
        F.concat(F.lit("Release "), s(z)), F.concat(F.lit("1."), s(z), F.lit("-beta")), F.lit("private"), F.concat(F.lit(" 2."), s(z), F.lit(".0")),
    ]
    v = F.element_at(F.array(*ways), (k % 8 + 1).cast("int"))
    return table(spark, sf, "part").select(k.alias("k"), F.col("p_type").alias("scope"), v.alias("v")).withColumn("n", V.normalize(F.col("v")))


@query(f"WITH {_V} SELECT k, v, n AS normalized, known FROM q")
def version_normalize(spark, sf):
    return version_rows(spark, sf).select("k", "v", F.col("n").alias("normalized"), V.known(F.col("n")).alias("known"))


@query(f"""WITH {_V} SELECT a.k, CAST(CASE WHEN a.n = b.n THEN 0 WHEN a.rel = b.rel AND a.known AND b.known THEN CASE WHEN a.parts < b.parts THEN -1 WHEN a.parts > b.parts THEN 1 ELSE 0 END END AS INTEGER) AS c FROM q a JOIN q b ON b.k = a.k + 7""")
def version_compare(spark, sf):
    """Each version against that of the part seven numbers on, so most pairs are written in different ways."""
    a = version_rows(spark, sf)
    b = a.select((F.col("k") - 7).alias("k"), F.col("n").alias("m"))
    return a.join(b, "k").select("k", V.compare(F.col("n"), F.col("m")).alias("c"))


@query(f"WITH {_V} SELECT scope, rel AS releases, arg_max(v, struct_pack(p := parts, v := v)) AS version FROM q WHERE known GROUP BY scope, rel")
def latest_comparable(spark, sf):
    return H.latest(version_rows(spark, sf).withColumnRenamed("v", "version"), "scope")


@query(f"WITH {_V} SELECT k, v FROM q WHERE known AND NOT rel AND parts[1] * 1000 + parts[2] >= 1020 AND parts[1] * 1000 + parts[2] < 2030")
def version_range(spark, sf):
    span = Q.Range("version", "1.20", "2.30", end_in=False)
    return version_rows(spark, sf).filter(in_span(F.col("v"), span)).select("k", "v")


@query("""WITH prior AS (SELECT o_custkey AS doc, count(*) || ':' || max(o_orderkey) AS sig FROM orders WHERE o_orderdate < TIMESTAMP '1996-01-01' GROUP BY o_custkey), now AS (SELECT o_custkey AS doc, count(*) || ':' || max(o_orderkey) AS sig FROM orders WHERE o_orderstatus <> 'F' GROUP BY o_custkey)
SELECT coalesce(p.doc, n.doc) AS doc, CASE WHEN p.doc IS NULL THEN 'added' WHEN n.doc IS NULL THEN 'removed' WHEN p.sig <> n.sig THEN 'changed' ELSE 'unchanged' END AS state FROM prior p FULL JOIN now n ON p.doc = n.doc""")
def dirty_documents(spark, sf):
    """Customers as documents, their orders' number and last one as signature, before a date and now."""
    o = table(spark, sf, "orders")
    sig = lambda d: d.groupBy(F.col("o_custkey").alias("doc")).agg(F.concat_ws(":", F.count("*").cast("string"), F.max("o_orderkey").cast("string")).alias("sig"))
    return H.differing(sig(o.filter("o_orderdate < timestamp'1996-01-01'")), sig(o.filter("o_orderstatus <> 'F'")), "doc", "sig")


@query("""WITH f AS (SELECT p_name, p_brand, max(p_size) AS v FROM part GROUP BY p_name, p_brand), a AS (SELECT p_name AS k, max(v) AS v FROM f WHERE p_brand < 'Brand#3' GROUP BY p_name), b AS (SELECT p_name AS k, max(v) AS v FROM f WHERE p_brand >= 'Brand#2' GROUP BY p_name)
SELECT coalesce(a.k, b.k) AS k, CASE WHEN a.k IS NULL THEN 'added' WHEN b.k IS NULL THEN 'removed' WHEN a.v <> b.v THEN 'changed' ELSE 'unchanged' END AS state FROM a FULL JOIN b ON a.k = b.k""")
def version_diff(spark, sf):
    p = table(spark, sf, "part")
    top = lambda d: d.groupBy(F.col("p_name").alias("k")).agg(F.max("p_size").alias("v"))
    return H.differing(top(p.filter("p_brand < 'Brand#3'")), top(p.filter("p_brand >= 'Brand#2'")), "k", "v")


@query("""WITH o AS (SELECT o_orderkey, o_custkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS i, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders),
b AS (SELECT *, CAST(floor(i * 4.0::DOUBLE / n) AS INT) AS bucket FROM o), r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey, bucket ORDER BY o_totalprice DESC, o_orderkey) AS r FROM b) SELECT o_custkey, bucket, o_orderkey FROM r WHERE r = 1""")
def history_sample(spark, sf):
    o = table(spark, sf, "orders").select("o_custkey", "o_orderdate", "o_orderkey", "o_totalprice")
    return H.sampled(o, "o_custkey", ["o_orderdate", "o_orderkey"], [F.desc("o_totalprice"), "o_orderkey"], 4).select("o_custkey", "bucket", "o_orderkey")


#: Passages as units of two states: of seven one is gone, one renamed and shortened, one moved, one changed, one split; as many are new as are gone.
_STATES = r"""p AS (SELECT item_id AS i, item_id % 7 AS m, text, string_split(text, ' ') AS w FROM benchmark),
a AS (SELECT 'fact' AS type, 'k' || i AS key, text AS content, [i % 3] AS sources FROM p),
b AS (SELECT 'fact' AS type, 'k' || i AS key, CASE WHEN m = 3 THEN text || ' indeed' ELSE text END AS content, [CASE WHEN m = 2 THEN 99 ELSE i % 3 END] AS sources FROM p WHERE m IN (2, 3, 5, 6)
 UNION ALL SELECT 'fact', 'n' || i, array_to_string(w[3:], ' '), [i % 3] FROM p WHERE m = 1 UNION ALL SELECT 'fact', 'k' || i || 'a', array_to_string(w[:len(w) // 2], ' '), [i % 3] FROM p WHERE m = 4
 UNION ALL SELECT 'fact', 'k' || i || 'b', array_to_string(w[len(w) // 2 + 1:], ' '), [i % 3] FROM p WHERE m = 4 UNION ALL SELECT 'fact', 'add' || i, array_to_string(list_transform(w, lambda x: 'z' || x), ' '), [1] FROM p WHERE m = 0),
k AS (SELECT type, key, CASE WHEN a.content <> b.content THEN 'changed' WHEN a.sources = b.sources THEN 'same' ELSE 'moved' END AS status, key AS other, NULL::DOUBLE AS share FROM a JOIN b USING (type, key)),
g AS (SELECT key, list_distinct(regexp_extract_all(lower(content), '[\p{L}\p{Nd}]+')) AS w FROM a WHERE key NOT IN (SELECT key FROM b)), n AS (SELECT key, list_distinct(regexp_extract_all(lower(content), '[\p{L}\p{Nd}]+')) AS w FROM b WHERE key NOT IN (SELECT key FROM a)),
j AS (SELECT g.key, n.key AS other, round(len(list_intersect(g.w, n.w)) / (len(g.w) + len(n.w) - len(list_intersect(g.w, n.w)))::DOUBLE, 6) AS share FROM g, n),
r AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY share DESC, other) AS x, row_number() OVER (PARTITION BY other ORDER BY share DESC, key) AS y FROM j WHERE share >= 0.6) WHERE x = 1 AND y = 1),
h AS (SELECT n.key, g.key AS whole, round(len(list_intersect(g.w, n.w)) / len(n.w)::DOUBLE, 6) AS share FROM g, n WHERE len(n.w) > 0 AND g.key NOT IN (SELECT key FROM r) AND n.key NOT IN (SELECT other FROM r)),
s AS (SELECT *, count(*) OVER (PARTITION BY whole) AS c FROM (SELECT * FROM h WHERE share >= 0.8 QUALIFY row_number() OVER (PARTITION BY key ORDER BY share DESC, whole) = 1)), t AS (SELECT * FROM s WHERE c > 1)"""


@query(f"""WITH {_STATES} SELECT * FROM k UNION ALL SELECT 'fact', key, 'renamed', other, share FROM r UNION ALL SELECT 'fact', other, 'renamed', key, share FROM r UNION ALL SELECT DISTINCT 'fact', whole, 'split', NULL, NULL::DOUBLE FROM t
UNION ALL SELECT 'fact', key, 'part', whole, share FROM t UNION ALL SELECT 'fact', key, 'removed', NULL, NULL FROM g WHERE key NOT IN (SELECT key FROM r) AND key NOT IN (SELECT whole FROM t)
UNION ALL SELECT 'fact', key, 'added', NULL, NULL FROM n WHERE key NOT IN (SELECT other FROM r) AND key NOT IN (SELECT key FROM t)""")
def base_comparison(spark, sf):
    """Two states of a base: what is the same, moved, changed, renamed, split, gone and new."""
    i, w = F.col("item_id"), F.split("text", " ")
    m, n = i % 7, F.size(w)
    p = table(spark, sf, "benchmark")
    unit = lambda rows, key, content, source: rows.select(F.lit("fact").alias("type"), key.alias("key"), content.alias("content"), F.array(source.cast("long")).alias("sources"))
    k, own, join = F.concat(F.lit("k"), i.cast("string")), i % 3, lambda x: F.array_join(x, " ")
    half = F.floor(n / 2).cast("int")
    before = unit(p, k, F.col("text"), own)
    after = unit(p.filter(m.isin(2, 3, 5, 6)), k, F.when(m == 3, F.concat("text", F.lit(" indeed"))).otherwise(F.col("text")), F.when(m == 2, 99).otherwise(own))
    after = after.unionByName(unit(p.filter(m == 1), F.concat(F.lit("n"), i.cast("string")), join(F.slice(w, F.lit(3), n)), own))
    after = after.unionByName(unit(p.filter(m == 4), F.concat(k, F.lit("a")), join(F.slice(w, F.lit(1), half)), own)).unionByName(unit(p.filter(m == 4), F.concat(k, F.lit("b")), join(F.slice(w, half + 1, n)), own))
    after = after.unionByName(unit(p.filter(m == 0), F.concat(F.lit("add"), i.cast("string")), join(F.transform(w, lambda x: F.concat(F.lit("z"), x))), F.lit(1)))
    return Cm.compared(before, after)
