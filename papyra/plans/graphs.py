"""Queries of traversal, of what units rest on and of incremental merges."""

from __future__ import annotations

from papyra.operators import graph as G
from papyra.operators import semantic as S
from papyra.plans.catalogue import F, docs, query, table
from papyra.plans.compiler import _EVERY, _STATED, compiled, compiled_units, every_step, structured, told_facts


def supply(spark, sf):
    """Suppliers and parts as one graph."""
    li = table(spark, sf, "lineitem").select(F.concat(F.lit("s"), "l_suppkey").alias("s"), F.concat(F.lit("p"), "l_partkey").alias("p")).distinct()
    return li.select(F.col("s").alias("src"), F.col("p").alias("dst"), F.concat_ws(">", "s", "p").alias("edge_id"))


_SUPPLY = "e AS (SELECT DISTINCT 's' || l_suppkey AS src, 'p' || l_partkey AS dst, 's' || l_suppkey || '>p' || l_partkey AS edge_id FROM lineitem), b AS (SELECT src, dst, edge_id FROM e UNION ALL SELECT dst, src, edge_id FROM e), f AS (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY src ORDER BY edge_id, dst) <= 16)"


@query(f"""WITH RECURSIVE {_SUPPLY}, w(node, hop) AS (SELECT 's1', 0 UNION SELECT f.dst, hop + 1 FROM w JOIN f ON f.src = w.node WHERE hop < 3), m AS (SELECT node, min(hop) AS hop FROM w GROUP BY node)
SELECT m.node, m.hop, (SELECT min(f.edge_id) FROM f JOIN m AS q ON q.node = f.src AND q.hop = m.hop - 1 WHERE f.dst = m.node) AS edge_id FROM m""")
def graph_bfs(spark, sf):
    """Three steps in both directions from the first supplier, 16 edges a node."""
    return G.bfs(supply(spark, sf), spark.createDataFrame([("s1",)], "node string"), hops=3, fan_out=16, direction="both").select("node", "hop", "edge_id")


@query(f"""WITH RECURSIVE {_SUPPLY}, n1 AS (SELECT dst AS node, min(edge_id) AS edge_id FROM f WHERE src = 's1' GROUP BY dst ORDER BY edge_id, node LIMIT 23),
n2 AS (SELECT dst AS node, min((edge_id, src)) AS e FROM f WHERE src IN (SELECT node FROM n1) AND dst <> 's1' AND dst NOT IN (SELECT node FROM n1) GROUP BY dst ORDER BY e[1], node LIMIT greatest(0, 23 - (SELECT count(*) FROM n1)))
SELECT 's1' AS node, 's1' AS path UNION ALL SELECT node, 's1>' || node FROM n1 UNION ALL SELECT node, 's1>' || e[2] || '>' || node FROM n2""")
def graph_explore(spark, sf):
    """Two steps, 24 nodes at most, each with its way from the seed."""
    r = G.bfs(supply(spark, sf), spark.createDataFrame([("s1",)], "node string"), hops=2, fan_out=16, direction="both", nodes=24)
    return G.paths(r, 2).select("node", F.array_join("path", ">").alias("path"))


#: Parts made from parts of half and a third of their number; the first ten rest on their brand.
_MADE = "d AS (SELECT p_partkey AS id, p_partkey // 2 AS target FROM part WHERE p_partkey >= 10 UNION SELECT p_partkey, p_partkey // 3 FROM part WHERE p_partkey >= 10), s AS (SELECT p_partkey AS id, p_brand AS source FROM part WHERE p_partkey < 10)"


def made(spark, sf):
    p = table(spark, sf, "part")
    k = F.col("p_partkey")
    d = p.filter(k >= 10).select(k.alias("id"), F.explode(F.array(F.floor(k / 2), F.floor(k / 3))).alias("target")).distinct()
    return p.select(k.alias("id")), d, p.filter(k < 10).select(k.alias("id"), F.col("p_brand").alias("source"))


@query(f"WITH RECURSIVE {_MADE}, c(id, source) AS (SELECT id, source FROM s UNION SELECT d.id, c.source FROM c JOIN d ON d.target = c.id) SELECT id, source FROM c")
def evidence_closure(spark, sf):
    _, derived, sources = made(spark, sf)
    return G.evidence(derived, sources)


#: The same with parts 40 to 44 in a circle, and some made from parts that aren't there.
_ROUND = "x AS (SELECT id, CASE WHEN id BETWEEN 40 AND 44 AND target = id // 2 THEN 40 + (id - 39) % 5 WHEN id % 17 = 0 THEN -target ELSE target END AS target FROM d)"


@query(f"""WITH RECURSIVE {_MADE}, {_ROUND}, u(id) AS (SELECT DISTINCT id FROM x WHERE id BETWEEN 40 AND 44 UNION SELECT x.id FROM u JOIN x ON x.target = u.id)
SELECT id, 'circle' AS fault FROM u UNION ALL SELECT DISTINCT id, 'missing origin' FROM x WHERE target < 0""")
def provenance_faults(spark, sf):
    ids, derived, _ = made(spark, sf)
    i, t = F.col("id"), F.col("target")
    x = derived.withColumn("target", F.when(i.between(40, 44) & (t == F.floor(i / 2)), 40 + (i - 39) % 5).when(i % 17 == 0, -t).otherwise(t))
    return G.unsound(x, ids)


@query(f"""WITH RECURSIVE {_MADE}, k(id) AS (SELECT id FROM s WHERE id > 3 UNION SELECT d.id FROM k JOIN d ON d.target = k.id) SELECT p_partkey AS id FROM part WHERE p_partkey NOT IN (SELECT id FROM k)""")
def fixpoint_drop(spark, sf):
    """Units that lose all support when the first parts' sources go."""
    ids, derived, sources = made(spark, sf)
    return G.unsupported(derived, ids, sources.filter("id > 3"))


@query(f"""WITH {_STATED}, le AS (SELECT k, string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY doc_id) AS docs FROM (SELECT DISTINCT k, doc_id FROM sp WHERE doc_id % 5 <> 0 OR doc_id % 10 = 0) GROUP BY k),
up AS (SELECT k, arg_min(c, (doc_id, ord, j)) AS text FROM sp WHERE doc_id % 10 = 0 GROUP BY k)
SELECT 'fact' AS type, le.k AS key, sha256(coalesce(up.text, fx.text)) AS said, docs AS sources, 0.68::DOUBLE AS confidence, 'active' AS status FROM le JOIN fx USING (k) LEFT JOIN up USING (k)
UNION ALL SELECT 'summary', 'summary:doc:' || doc_id, NULL, NULL, NULL, NULL FROM documents WHERE doc_id % 5 <> 0 OR doc_id % 10 = 0""")
def incremental_merge(spark, sf):
    """A fifth of the documents is dirty; half of these are compiled anew, the others are gone: every fact that is left, with its sources, and every summary."""
    i = F.col("doc_id")
    after = S.unit_rows(*S.compile_facts(structured(spark, sf, some=i % 10 == 0)))
    m = S.merge_units(compiled_units(spark, sf), after, docs(spark, sf).filter(i % 5 == 0))
    fact = lambda c: F.when(F.col("type") == "fact", c)
    own = told_facts(m.filter(F.col("type").isin("fact", "summary")))  # both in one pass
    return own.select("type", "key", *(fact(F.col(c)).alias(c) for c in ("said", "sources", "confidence", "status")))


@query(f"""WITH RECURSIVE {_STATED}, e AS (SELECT f.p[1] AS src, f.k AS dst FROM fx f JOIN fx g ON g.k = f.p[1]), b AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e), s AS (SELECT min(src) AS k FROM e),
w(node, hop) AS (SELECT k, 0 FROM s UNION SELECT b.dst, hop + 1 FROM w JOIN b ON b.src = w.node WHERE hop < 3) SELECT node, min(hop) AS hop FROM w GROUP BY node""")
def graph_expand(spark, sf):
    """Three steps in both directions from the first fact that another follows."""
    units, r = compiled(spark, sf)
    units = units.filter("type = 'fact'")
    r = r.filter("type = 'related_to'")
    first = r.agg(F.min("subject")).first()[0]
    return G.expand(units, r, [first], ["related_to"], "both", hops=3, nodes=256, fan_out=64)[0].select("node", "hop")


@query(f"""WITH {_EVERY}, e AS (SELECT f.p[1] AS a, f.k AS b FROM fx f JOIN fx g ON g.k = f.p[1]) SELECT DISTINCT x.a AS src, y.b AS dst FROM e x JOIN e y ON x.b = y.a WHERE x.a <> y.b""")
def graph_two_hop(spark, sf):
    """Facts two steps apart in reading order, of all statements. An object has one subject, so no pair comes twice."""
    r = every_step(spark, sf)
    return r.select(F.col("subject").alias("src"), F.col("object").alias("mid")).join(r.select(F.col("subject").alias("mid"), F.col("object").alias("dst")), "mid").filter("src <> dst").select("src", "dst")
