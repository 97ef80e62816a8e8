"""Queries of scopes, visibility, positions, pages, budgets and trees over whole tables."""

from __future__ import annotations

from functools import reduce

from papyra.functions import sources as So
from papyra.functions.vectors import unit
from papyra.operators import evaluation as Ev
from papyra.operators import paging as P
from papyra.operators import search as Se
from papyra.plans.answers import described
from papyra.plans.catalogue import F, docs, query, table


@query("SELECT 'all' AS scope, count(*) AS n FROM documents UNION ALL SELECT 'none', 0 UNION ALL SELECT 'some', count(*) FROM documents WHERE doc_id IN (3, 5, 7)")
def scope_fail_closed(spark, sf):
    d = docs(spark, sf)
    return reduce(lambda a, b: a.union(b), (d.filter(Se.in_scope(F.col("doc_id"), ids)).agg(F.count("*").alias("n")).select(F.lit(name).alias("scope"), "n") for name, ids in (("all", None), ("none", []), ("some", [3, 5, 7]))))


@query("WITH g AS (SELECT conv_id, max(turn) AS active FROM conversations GROUP BY conv_id) SELECT c.conv_id, c.turn, c.role FROM conversations c JOIN g ON c.conv_id = g.conv_id AND c.turn = g.active WHERE c.conv_id % 13 <> 0")
def visible_chunks(spark, sf):
    """A conversation's turns are its generations: the newest is in force; every 13th conversation is being deleted."""
    c = table(spark, sf, "conversations")
    active = c.groupBy("conv_id").agg(F.max("turn").alias("turn")).withColumn("status", F.when(F.col("conv_id") % 13 == 0, "deleting").otherwise("ready"))
    in_force = c.join(active.select("conv_id", "turn"), ["conv_id", "turn"]).withColumnRenamed("conv_id", "doc_id")
    return Se.visible(in_force, active.withColumnRenamed("conv_id", "doc_id")).select(F.col("doc_id").alias("conv_id"), "turn", "role")


_STATE = "CASE WHEN toxic = 1 THEN 'INCOMPLETE' WHEN quality = 0 THEN 'LOW_QUALITY' ELSE 'GOOD' END"
_QUALITY = f"lb AS (SELECT doc_id, max(toxic) AS toxic, min(quality) AS quality FROM labels GROUP BY doc_id), q AS (SELECT d.doc_id, n_chars, {_STATE} AS status FROM documents d LEFT JOIN lb USING (doc_id))"


@query(f"WITH {_QUALITY} SELECT doc_id, row_number() OVER (ORDER BY status = 'LOW_QUALITY', n_chars DESC, doc_id) AS place FROM q WHERE status <> 'INCOMPLETE'")
def quality_guard_order(spark, sf):
    hits = docs(spark, sf).select("doc_id", "n_chars")
    g = Se.guarded(hits, described(spark, sf))
    return P.positions(g, [F.col("low"), -F.col("n_chars"), F.col("doc_id")], "place").select("doc_id", "place")


@query(f"WITH {_QUALITY} SELECT status, count(*) AS documents FROM q GROUP BY status")
def quality_summary(spark, sf):
    return Ev.quality_summary(described(spark, sf))


@query("SELECT doc_id, source, (SELECT count(*) FROM documents) AS total, (SELECT count(*) FROM documents) > 60 AS has_more FROM documents ORDER BY doc_id LIMIT 20 OFFSET 40")
def offset_page(spark, sf):
    return P.page(docs(spark, sf).select("doc_id", "source"), [F.col("doc_id")], 40, 20)


@query("SELECT doc_id FROM (SELECT doc_id, sum((n_chars + 3) / 4.0::DOUBLE) OVER (ORDER BY doc_id) AS used FROM documents) WHERE used <= 4096")
def context_budget(spark, sf):
    return P.within(docs(spark, sf).select("doc_id", "n_chars"), [F.col("doc_id")], (F.col("n_chars") + 3) / 4, 4096).select("doc_id")


@query("""WITH r AS (SELECT source, doc_id // 1000 AS r, sha256(string_agg(length(sha256(text)) || ':' || sha256(text), ',' ORDER BY doc_id)) AS h FROM documents GROUP BY source, r) SELECT source, sha256(string_agg(h, ',' ORDER BY r)) AS fingerprint FROM r GROUP BY source""")
def reindex_fingerprint(spark, sf):
    return P.folded(docs(spark, sf), "source", "doc_id", F.sha2("text", 256))


@query("SELECT doc_id, CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY md5(text)) THEN 'skip' ELSE 'import' END AS plan FROM documents")
def hash_dedup_plan(spark, sf):
    """The first document of a text is imported; one is told by the least id of its hash, so copies are not sorted."""
    d = docs(spark, sf).select("doc_id", F.md5(F.col("text").cast("binary")).alias("h"))
    return d.join(d.groupBy("h").agg(F.min("doc_id").alias("first")), "h").select("doc_id", F.when(F.col("doc_id") > F.col("first"), "skip").otherwise("import").alias("plan"))


@query("SELECT a.p_partkey FROM part a WHERE EXISTS (SELECT 1 FROM part b WHERE b.p_name = a.p_name AND b.p_partkey < a.p_partkey)")
def title_conflicts(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", "p_name")
    return p.join(p.groupBy("p_name").agg(F.min("p_partkey").alias("first")), "p_name").filter("p_partkey > first").select("p_partkey")


def places(spark, sf):
    """Regions, nations and suppliers as a tree of (id, parent, name, kind)."""
    s = lambda c: F.col(c).cast("string")
    none = F.lit(None).cast("string")
    r = table(spark, sf, "region").select(F.concat(F.lit("r"), s("r_regionkey")).alias("id"), none.alias("parent"), F.col("r_name").alias("name"), F.lit(0).alias("kind"))
    n = table(spark, sf, "nation").select(F.concat(F.lit("n"), s("n_nationkey")), F.concat(F.lit("r"), s("n_regionkey")), "n_name", F.lit(0))
    return r.union(n).union(table(spark, sf, "supplier").select(F.concat(F.lit("s"), s("s_suppkey")), F.concat(F.lit("n"), s("s_nationkey")), "s_name", F.lit(1)))


@query("SELECT 's' || s_suppkey AS leaf, r_name || '/' || n_name || '/' || s_name AS path FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def breadcrumb(spark, sf):
    t = places(spark, sf)
    return P.ancestors(t, t.filter("kind = 1")).select("leaf", F.array_join("path", "/").alias("path"))


@query("""WITH t AS (SELECT 'r' || r_regionkey AS id, r_name AS name, 0 AS kind FROM region UNION ALL SELECT 'n' || n_nationkey, n_name, 0 FROM nation UNION ALL SELECT 's' || s_suppkey, s_name, 1 FROM supplier) SELECT id, row_number() OVER (ORDER BY kind, name, id) AS position FROM t""")
def directory_first_sort(spark, sf):
    return P.positions(places(spark, sf), [F.col("kind"), F.col("name"), F.col("id")]).select("id", "position")


@query("SELECT p_partkey, [100, 90, 90, 80, 70, 20][p_partkey % 6 + 1]::INT AS score FROM part")
def anchor_scores(spark, sf):
    k = F.col("p_partkey") % 6
    kind = F.element_at(F.array(*map(F.lit, ("table_cell", "table_cell", "slide", "paragraph", "figure", "section"))), (k + 1).cast("int"))
    return table(spark, sf, "part").select("p_partkey", So.anchor_score(kind, k == 1).alias("score"))


@query("""WITH w AS (SELECT label, vec_id % 5 + 1 AS w, embedding::DOUBLE[] AS e, unnest(generate_series(1, len(embedding))) AS i FROM embeddings), m AS (SELECT label, i, sum(e[i] * w) / sum(w) AS m FROM w GROUP BY label, i), n AS (SELECT label, sqrt(sum(m * m)) AS n FROM m GROUP BY label)
SELECT label, CAST(i - 1 AS INTEGER) AS i, round(m / n, 6) AS x FROM m JOIN n USING (label)""")
def weighted_mean_vectors(spark, sf):
    """The weighted mean of each label's vectors, of length 1, by component."""
    w = F.col("vec_id") % 5 + 1
    e = table(spark, sf, "embeddings").select("label", w.alias("w"), F.posexplode("embedding").alias("i", "x"))
    m = e.groupBy("label", "i").agg((F.sum(F.col("x").cast("double") * F.col("w")) / F.sum("w")).alias("m"))
    v = m.groupBy("label").agg(unit(F.array_sort(F.collect_list(F.struct("i", "m")))["m"]).alias("v"))
    return v.select("label", F.posexplode(F.transform("v", lambda x: F.round(x, 6))).alias("i", "x"))
