"""Queries of imports, scans, generations, operations, queues and conversations, with states taken from orders, events and parts."""

from __future__ import annotations

from pyspark.sql import Window

from papyra.functions import questions as Q
from papyra.operators import leases as Le
from papyra.operators import library as Li
from papyra.operators import paging as Pg
from papyra.operators import storage as St
from papyra.plans.catalogue import CHUNKS, F, docs, query, table
from papyra.plans.scalars import _STOP
from papyra.sources.tables import chunks

#: Names that a third of the parts want; the others have names already, some of them numbered.
_NAMES = "w AS (SELECT p_partkey AS id, p_name || '.txt' AS name FROM part WHERE p_partkey % 3 = 0), t AS (SELECT DISTINCT p_name || CASE WHEN p_partkey % 2 = 0 THEN '' ELSE '_' || (p_partkey % 5 + 1) END || '.txt' AS name FROM part WHERE p_partkey % 3 <> 0)"


@query(f"""WITH {_NAMES}, n AS (SELECT id, name, left(name, length(name) - 4) AS stem, row_number() OVER (PARTITION BY name ORDER BY id) AS n FROM w), c AS (SELECT name, stem, count(*) AS k FROM n GROUP BY name, stem),
g AS (SELECT name, stem || '_' || i || '.txt' AS final, i FROM (SELECT name, stem, unnest(generate_series(1, k + 6)) AS i FROM c) UNION ALL SELECT name, name, 0 FROM c),
f AS (SELECT name, final, row_number() OVER (PARTITION BY name ORDER BY i) AS n FROM g WHERE final NOT IN (SELECT name FROM t)) SELECT id, n.name, final FROM n JOIN f USING (name, n)""")
def rename_available(spark, sf):
    p = table(spark, sf, "part")
    k = F.col("p_partkey")
    taken = p.filter(k % 3 != 0).select(F.concat("p_name", F.when(k % 2 == 0, "").otherwise(F.concat(F.lit("_"), (k % 5 + 1).cast("string"))), F.lit(".txt")).alias("name"))
    return Li.free_names(p.filter(k % 3 == 0).select(k.alias("id"), F.concat("p_name", F.lit(".txt")).alias("name")), taken)


@query("""WITH f AS (SELECT p_partkey AS id, p_name || '.md' AS name, md5(p_type || p_brand || p_size) AS hash FROM part ORDER BY p_partkey DESC LIMIT 20), e AS (SELECT p_name || '.md' AS name, md5(p_type || p_brand || p_size) AS hash FROM part WHERE p_partkey NOT IN (SELECT id FROM f)),
n AS (SELECT *, row_number() OVER (PARTITION BY hash ORDER BY id) AS n FROM f) SELECT id, name, CASE WHEN hash IN (SELECT hash FROM e) OR n > 1 THEN 'skip' WHEN name IN (SELECT name FROM e) THEN 'replace' ELSE 'import' END AS action FROM n""")
def import_plan(spark, sf):
    p = table(spark, sf, "part")
    k = F.col("p_partkey")
    files = p.select(k.alias("id"), F.concat("p_name", F.lit(".md")).alias("name"), F.md5(F.concat("p_type", "p_brand", F.col("p_size").cast("string")).cast("binary")).alias("hash"))
    new = files.orderBy(F.desc("id")).limit(Li.IMPORT)  # an import's bound
    return Li.import_plan(new, files.join(new, "id", "left_anti").withColumnRenamed("id", "doc_id"), "replace").select("id", "name", "action")


_FILES = "a AS (SELECT 'dir/' || doc_id AS path, md5(text) AS hash FROM documents WHERE doc_id % 4 <> 0), b AS (SELECT 'dir/' || doc_id AS path, md5(CASE WHEN doc_id % 7 = 0 THEN text || '.' ELSE text END) AS hash FROM documents WHERE doc_id % 5 <> 0)"


@query(f"WITH {_FILES} SELECT path, CASE WHEN a.hash IS NULL THEN 'new' WHEN b.hash IS NULL THEN 'missing' WHEN a.hash = b.hash THEN 'unchanged' ELSE 'changed' END AS state FROM a FULL JOIN b USING (path)")
def directory_rescan(spark, sf):
    d = docs(spark, sf)
    i = F.col("doc_id")
    f = d.select("doc_id", F.concat(F.lit("dir/"), i.cast("string")).alias("path"), F.md5(F.col("text").cast("binary")).alias("hash"), F.md5(F.concat("text", F.lit(".")).cast("binary")).alias("other"))
    return Li.rescan(f.filter(i % 4 != 0), f.filter(i % 5 != 0).withColumn("hash", F.when(i % 7 == 0, F.col("other")).otherwise(F.col("hash"))))


_URLS = "u AS (SELECT o_orderkey AS doc_id, o_orderpriority AS base, CASE WHEN o_orderkey % 3 = 0 THEN 'file' ELSE 'url' END AS kind, CASE WHEN o_orderkey % 2 = 0 THEN 0 ELSE epoch_ms(o_orderdate::TIMESTAMP) END AS updated, epoch_ms(o_orderdate::TIMESTAMP) - 86400000 AS created FROM orders)"


@query(f"WITH {_URLS} SELECT doc_id FROM u WHERE kind = 'url' AND left(base, 1) <> '5' AND coalesce(nullif(updated, 0), created) + CAST(left(base, 1) AS BIGINT) * 86400000 * 365 <= 852076800000")
def stale_urls(spark, sf):
    o = table(spark, sf, "orders")
    ms, k = F.unix_millis(F.col("o_orderdate").cast("timestamp")), F.col("o_orderkey")
    d = o.select(k.alias("doc_id"), F.col("o_orderpriority").alias("base"), F.when(k % 3 == 0, "file").otherwise("url").alias("source_type"), F.when(k % 2 == 0, 0).otherwise(ms).alias("updated"), (ms - 86400000).alias("created"))
    n = F.left("base", F.lit(1)).cast("long")
    return Li.stale_urls(d, d.select("base").distinct().withColumn("interval_ms", F.when(n == 5, 0).otherwise(n * 86400000 * 365)), 852076800000)


@query("SELECT p_name AS path, min(p_partkey) AS doc_id FROM part GROUP BY p_name")
def path_lookup(spark, sf):
    return Li.by_path(table(spark, sf, "part").select(F.col("p_name").alias("path"), F.lit(0).alias("created"), F.col("p_partkey").alias("doc_id")))


#: Conversations as bases: turns are generations, the last building, the one before active, a few bases in other states.
_GENERATIONS = """g AS (SELECT conv_id AS base, turn AS generation, length(text) AS changed, max(turn) OVER (PARTITION BY conv_id) - turn AS back, conv_id % 7 AS kind FROM conversations),
s AS (SELECT base, generation, changed, kind, CASE WHEN kind = 3 AND back = 0 THEN 'active' WHEN kind = 4 AND back = 0 THEN 'failed' WHEN back = 0 THEN 'building' WHEN back = 1 THEN CASE WHEN kind = 3 THEN 'building' ELSE 'active' END ELSE 'retired' END AS state FROM g),
w AS (SELECT base, max(generation) + CASE WHEN max(kind) = 5 THEN 1 WHEN max(kind) = 3 THEN -1 ELSE 0 END AS want FROM s WHERE kind <> 6 GROUP BY base)"""


def generations(spark, sf):
    """(states, requests) of ``_GENERATIONS``."""
    back = F.max("turn").over(Window.partitionBy("conv_id")) - F.col("turn")
    g = table(spark, sf, "conversations").select(F.col("conv_id").alias("base"), F.col("turn").alias("generation"), F.length("text").alias("changed"), back.alias("back"), (F.col("conv_id") % 7).alias("kind"))
    late, last, before = F.col("kind") == 3, F.col("back") == 0, F.col("back") == 1
    state = F.when(late & last, "active").when((F.col("kind") == 4) & last, "failed").when(last, "building").when(before & late, "building").when(before, "active").otherwise("retired")
    states = g.select("base", "generation", state.alias("state"), "changed", "kind")
    step = F.max("generation") + F.when(F.max("kind") == 5, 1).when(F.max("kind") == 3, -1).otherwise(0)
    return states.drop("kind"), states.filter("kind <> 6").groupBy("base").agg(step.alias("generation"))


@query(f"""WITH {_GENERATIONS}, o AS (SELECT w.base, want, CASE WHEN coalesce(own.state, '') <> 'building' THEN 'not building' WHEN want < (SELECT max(a.generation) FROM s a WHERE a.base = w.base AND a.state = 'active') THEN 'overtaken' ELSE 'published' END AS outcome, own.state IS NULL AS lost
 FROM w LEFT JOIN s own ON own.base = w.base AND own.generation = want),
r AS (SELECT s.*, outcome, want, CASE WHEN outcome = 'published' AND generation = want THEN 'active' WHEN outcome = 'published' AND state = 'active' THEN 'retired' ELSE state END AS new FROM s LEFT JOIN o USING (base))
SELECT base, generation, new AS state, CASE WHEN new <> state THEN 900 ELSE changed END AS changed, CASE WHEN generation = want THEN outcome END AS outcome FROM r UNION ALL SELECT base, want, NULL, NULL, outcome FROM o WHERE lost""")
def generation_publish(spark, sf):
    """Every base's last generation is asked for: most are published, others overtaken, failed or not there."""
    states, asked = generations(spark, sf)
    return Li.publish_all(states, asked, 900)


@query("SELECT conv_id, turn, md5(text) AS hash FROM conversations WHERE turn = 1")
def pinned_generation_read(spark, sf):
    c = table(spark, sf, "conversations").withColumnRenamed("turn", "generation")
    return Li.pinned(c, c.select("generation").distinct(), 1).select("conv_id", F.col("generation").alias("turn"), F.md5(F.col("text").cast("binary")).alias("hash"))


@query("""SELECT doc_id, label AS model, vec_id AS source FROM (SELECT d.doc_id, e.label, min(v.doc_id) AS vec_id FROM documents d JOIN documents v ON md5(d.text) = md5(v.text) JOIN embeddings e ON e.vec_id = v.doc_id WHERE d.doc_id NOT IN (SELECT vec_id FROM embeddings) GROUP BY d.doc_id, e.label)""")
def vector_reuse_by_hash(spark, sf):
    """Vectors for documents without one, from documents of the same text; the vector here is the id it was made for."""
    d = docs(spark, sf).select("doc_id", F.md5(F.col("text").cast("binary")).alias("hash"))
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("label").alias("model"))
    old = d.join(e, "doc_id").groupBy("hash", "model").agg(F.array(F.min("doc_id")).alias("embedding"))
    new = d.join(e.select("doc_id"), "doc_id", "left_anti").withColumnRenamed("doc_id", "chunk")
    return Li.carried(old, new).select(F.col("chunk").alias("doc_id"), "model", F.col("embedding")[0].alias("source"))


@query("""WITH s AS (SELECT vec_id AS chunk, label AS model, embedding[1]::DOUBLE AS x FROM embeddings WHERE vec_id % 2 = 0), n AS (SELECT vec_id AS chunk, label AS model, -embedding[1]::DOUBLE AS x FROM embeddings WHERE vec_id % 3 = 0)
SELECT chunk, model, x FROM n UNION ALL SELECT chunk, model, x FROM s WHERE chunk NOT IN (SELECT chunk FROM n)""")
def vector_upsert(spark, sf):
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("chunk"), F.col("label").alias("model"), F.transform("embedding", lambda x: x.cast("double")).alias("embedding"))
    new = e.filter("chunk % 3 = 0").withColumn("embedding", F.transform("embedding", lambda x: -x))
    once = Li.merge_vectors(e.filter("chunk % 2 = 0"), new)
    return Li.merge_vectors(once, new).select("chunk", "model", F.col("embedding")[0].alias("x"))


#: Events of users as steps of operations: the kind of the event and its place say the state asked for.
_STEPS = "CASE WHEN n = 1 THEN 'queued' WHEN event_type IN ('view', 'click') THEN 'running' WHEN event_type = 'purchase' THEN 'succeeded' WHEN event_type = 'error' THEN 'failed' ELSE 'queued' END"


@query(f"""WITH RECURSIVE e AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events), s AS (SELECT user_id, n, {_STEPS} AS want FROM e),
r(user_id, n, state, revision, faults) AS (SELECT user_id, 1::BIGINT, 'queued', 1, 0 FROM s WHERE n = 1 UNION ALL
 SELECT r.user_id, s.n, CASE WHEN ok THEN want ELSE state END, revision + ok::INT, faults + (NOT ok)::INT FROM r JOIN (SELECT * FROM s) s ON s.user_id = r.user_id AND s.n = r.n + 1,
 LATERAL (SELECT (state = 'queued' AND want = 'running') OR (state = 'running' AND want IN ('succeeded', 'failed')) OR (state = 'failed' AND want = 'queued') AS ok) o)
SELECT user_id AS op, state, revision, faults FROM r QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC) = 1""")
def operation_states(spark, sf):
    from pyspark.sql import Window

    e = table(spark, sf, "events").withColumn("n", F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")))
    return Li.replay(e.select(F.col("user_id").alias("op"), F.col("n").alias("seq"), F.expr(_STEPS).alias("state")))


_OPS = "ops AS (SELECT o_orderkey AS op, o_orderpriority AS type, CASE o_orderstatus WHEN 'F' THEN 'running' WHEN 'O' THEN 'queued' ELSE 'cancelling' END AS state, o_orderkey % 11 = 0 AS cancel, o_orderkey % 3 <> 0 AS retryable, o_orderkey % 5 AS attempt FROM orders)"


def operations(spark, sf):
    k = F.col("o_orderkey")
    return table(spark, sf, "orders").select(k.alias("op"), F.col("o_orderpriority").alias("type"), F.when(F.col("o_orderstatus") == "F", "running").when(F.col("o_orderstatus") == "O", "queued").otherwise("cancelling").alias("state"), (k % 11 == 0).alias("cancel"), (k % 3 != 0).alias("retryable"), (k % 5).alias("attempt"), "o_custkey", "o_orderdate")


@query(f"WITH {_OPS} SELECT op, CASE WHEN state = 'queued' THEN 'queued' WHEN cancel OR state = 'cancelling' THEN 'cancelled' WHEN left(type, 1) IN ('1', '2') AND retryable AND attempt < 3 THEN 'queued' ELSE 'interrupted' END AS state FROM ops")
def crash_recovery(spark, sf):
    o = operations(spark, sf)
    kinds = [r["type"] for r in o.select("type").distinct().collect() if r["type"][:1] in "12"]  # a few types
    return Li.recovered(o, kinds).select("op", "state")


@query("""WITH q AS (SELECT o_orderkey AS op, left(o_orderpriority, 1) AS class, o_custkey AS base, o_orderstatus, CAST(left(o_orderpriority, 1) AS BIGINT) + (1000000000 - epoch(o_orderdate::TIMESTAMP)::BIGINT) // 86400 AS aged, o_orderdate FROM orders),
f AS (SELECT * FROM q WHERE o_orderstatus = 'O' ORDER BY aged DESC, o_orderdate, op LIMIT 32), b AS (SELECT * FROM f WHERE base NOT IN (SELECT base FROM q WHERE o_orderstatus = 'P') QUALIFY row_number() OVER (PARTITION BY base ORDER BY aged DESC, o_orderdate, op) = 1),
u AS (SELECT class, count(*) AS used FROM q WHERE o_orderstatus = 'P' GROUP BY class) SELECT op, class, base, aged FROM (SELECT b.*, row_number() OVER (PARTITION BY b.class ORDER BY aged DESC, o_orderdate, op) AS c, 1000000 - coalesce(used, 0) AS room FROM b LEFT JOIN u ON u.class = b.class) WHERE c <= least(room, 1000000)""")
def priority_aging(spark, sf):
    """Waiting orders by priority, one more for each day waited; a customer has one under way at most."""
    o = table(spark, sf, "orders")
    days = F.unix_timestamp(F.col("o_orderdate").cast("timestamp"))
    q = o.select(F.col("o_orderkey").alias("op"), F.left("o_orderpriority", F.lit(1)).alias("class"), F.col("o_custkey").alias("base"), F.left("o_orderpriority", F.lit(1)).cast("long").alias("priority"), F.floor(days / 86.4).cast("long").alias("requested"), F.when(F.col("o_orderstatus") == "O", "queued").when(F.col("o_orderstatus") == "P", "running").otherwise("succeeded").alias("state"))
    return Li.claim(q, 11574074, {str(i): 1000000 for i in range(10)}).select("op", "class", "base", "aged")


@query("""WITH o AS (SELECT event_type AS type, user_id % 3 AS state, CASE WHEN event_id % 4 = 0 THEN 'E' || event_id % 2 END AS code, event_id AS requested, event_id + 7 - event_id % 11 AS started, event_id + 20 - event_id % 31 AS finished FROM events)
SELECT type, state, coalesce(code, '') AS error_code, count(*) AS n, sum(greatest(started - requested, 0))::BIGINT AS waited, sum(CASE WHEN started > 0 THEN greatest(finished - started, 0) ELSE 0 END)::BIGINT AS ran FROM o GROUP BY 1, 2, 3""")
def op_metrics(spark, sf):
    i = F.col("event_id")
    return Li.metrics(table(spark, sf, "events").select(F.col("event_type").alias("type"), (F.col("user_id") % 3).alias("state"), F.when(i % 4 == 0, F.concat(F.lit("E"), (i % 2).cast("string"))).alias("error_code"), i.alias("requested"), (i + 7 - i % 11).alias("started"), (i + 20 - i % 31).alias("finished")))


@query("""WITH l AS (SELECT user_id, max(event_id) AS last, arg_max(event_type, event_id) AS kind FROM events GROUP BY user_id), d AS (SELECT user_id, max(event_id) AS done FROM events WHERE event_type = 'purchase' GROUP BY user_id)
SELECT l.user_id AS doc_id, last AS "at", kind FROM l LEFT JOIN d USING (user_id) WHERE done IS NULL OR done < last""")
def latest_event_state(spark, sf):
    """Users as documents: their last event is pending unless it resolved them."""
    e = table(spark, sf, "events").select(F.col("user_id").alias("doc_id"), F.col("event_id").alias("at"), F.col("event_type").alias("kind"))
    return Li.pending(e, e.filter("kind = 'purchase'"))


@query("""WITH h AS (SELECT conv_id * 100 + turn AS turn, conv_id % 4 AS base, doc, score, text, q, 150 + doc * 20 AS tokens FROM (SELECT c.conv_id, c.turn, i AS doc, c.text, c.text AS q, ((c.conv_id * 7 + c.turn * 3 + i * 11) % 50) / 50.0::DOUBLE AS score FROM conversations c, range(6) t(i))),
b AS (SELECT *, max(score) OVER (PARTITION BY turn) AS best FROM h), f AS (SELECT * FROM b WHERE best >= 0.12 AND score >= 0.6::DOUBLE * best), s AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY turn, base ORDER BY score DESC, doc) <= 3),
u AS (SELECT *, sum(least(tokens, 180)) OVER (PARTITION BY turn ORDER BY score DESC, doc ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS used FROM s), r AS (SELECT *, row_number() OVER (PARTITION BY turn ORDER BY score DESC, doc) AS r FROM u WHERE coalesce(used, 0) < 640), z AS (SELECT *, max(score) FILTER (r = 2) OVER (PARTITION BY turn) AS second FROM r)
SELECT turn, base, doc AS doc_id, score FROM z WHERE best >= 0.24 OR second IS NULL OR best >= second * 1.2::DOUBLE""")
def auto_gate(spark, sf):
    """Six hits for each turn of a conversation, whose texts are the turn's own and so share its words."""
    c = table(spark, sf, "conversations").withColumn("doc_id", F.explode(F.sequence(F.lit(0), F.lit(5)))).withColumn("score", (F.col("conv_id") * 7 + F.col("turn") * 3 + F.col("doc_id") * 11) % 50 / F.lit(50.0))
    h = c.select((F.col("conv_id") * 100 + F.col("turn")).alias("turn"), (F.col("conv_id") % 4).alias("base"), "doc_id", "score", "text", F.col("text").alias("question"), (150 + F.col("doc_id") * 20).alias("tokens"))
    return Li.gate(h)


@query("SELECT o_orderkey, o_orderdate FROM orders WHERE (o_orderdate, o_orderkey) < (TIMESTAMP '1996-06-01', 1000) ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 51")
def keyset_page(spark, sf):
    import datetime

    return Li.page(table(spark, sf, "orders").select("o_orderdate", "o_orderkey"), ["o_orderdate", "o_orderkey"], 50, (datetime.datetime(1996, 6, 1), 1000)).select("o_orderkey", "o_orderdate")


@query("SELECT p_partkey, '[source: ' || p_type || '; docId=' || p_partkey || '; chunkId=c(1); chunkIndex=' || p_size || '; title=' || p_name || ']' AS label FROM part")
def injected_label(spark, sf):
    return table(spark, sf, "part").select("p_partkey", Li.label(F.col("p_type"), F.col("p_partkey"), F.lit("c[1]"), F.col("p_size"), F.col("p_name")).alias("label"))


_CLEAN = "array_to_string(list_filter(list_transform(regexp_extract_all({0}, '[A-Za-z0-9一-鿿]+'), lambda s: CASE WHEN length(s) >= 2 AND NOT list_contains(" + _STOP + ", lower(s)) THEN lower(s) ELSE '' END), lambda s: s <> ''), ' ')"
_SIGNS = "'" + "|".join(Li.FOLLOW_UP) + "'"


@query(f"""WITH c AS (SELECT p_partkey // 10 AS conv_id, p_partkey % 10 AS turn, CASE WHEN p_size % 3 = 0 THEN 'show this ' || p_name WHEN p_size % 3 = 1 THEN p_type ELSE p_name || ' made by the owner of ' || p_brand || ' for sale' END AS t FROM part), h AS (SELECT conv_id, turn, t, lag(t) OVER w AS h1, lag(t, 2) OVER w AS h2 FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
k AS (SELECT conv_id, turn, t, {_CLEAN.format("t")} AS p, {_CLEAN.format("h1")} AS p1, {_CLEAN.format("h2")} AS p2 FROM h),
n AS (SELECT *, length(trim(t)) <= 40 AND (regexp_matches(lower(t), {_SIGNS}) OR len(list_distinct(list_filter(string_split(p, ' '), lambda x: x <> ''))) < 2) AS needs FROM k)
SELECT conv_id, turn, p AS main, CASE WHEN needs AND trim(p || coalesce(' ' || CASE WHEN p1 NOT IN ('', p) THEN p1 END, '') || coalesce(' ' || CASE WHEN p2 NOT IN ('', p) THEN p2 END, '')) <> p THEN p || coalesce(' ' || CASE WHEN p1 NOT IN ('', p) THEN p1 END, '') || coalesce(' ' || CASE WHEN p2 NOT IN ('', p) THEN p2 END, '') END AS enhanced FROM n""")
def auto_followup_plan(spark, sf):
    """Questions about parts as the turns of talks of ten: short ones that point, short ones of one word, long ones."""
    from pyspark.sql import Window

    w, z = Window.partitionBy("conv_id").orderBy("turn"), F.col("p_size") % 3
    t = F.when(z == 0, F.concat(F.lit("show this "), "p_name")).when(z == 1, F.col("p_type")).otherwise(F.concat("p_name", F.lit(" made by the owner of "), "p_brand", F.lit(" for sale")))
    c = table(spark, sf, "part").select(F.floor(F.col("p_partkey") / 10).alias("conv_id"), (F.col("p_partkey") % 10).alias("turn"), t.alias("t"))
    c = c.withColumn("h", F.array_compact(F.array(F.lag("t").over(w), F.lag("t", 2).over(w))))
    return c.select("conv_id", "turn", Li.follow_up(F.col("t"), F.col("h")).alias("q")).select("conv_id", "turn", "q.main", "q.enhanced")


#: What is asked about parts, and the intent that each way of asking has.
_ASKS = {"compare the sizes of ": "comparison", "summarize ": "global", "why does it need ": "multi_hop", "in this file ": "local_document", "how many ": "fact", "what is the latest ": "temporal", "across documents ": "cross_document"}


@query(f"SELECT p_partkey, {list(_ASKS.values())!r}[p_size % 7 + 1] AS intent FROM part")
def route_query(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", F.concat(F.element_at(F.array(*map(F.lit, _ASKS)), (F.col("p_size") % 7 + 1).cast("int")), "p_name").alias("q"))

    def f(batches):
        for b in batches:
            b["intent"] = [Q.route(q).intent for q in b["q"]]
            yield b[["p_partkey", "intent"]]

    return p.mapInPandas(f, "p_partkey long, intent string")


_WHEN = {"what changed in 1.{}": "evolution", "is {} still valid": "validity", "before 2024-01-{}": "historical", "after the {} merger": "range_history", "compare 1.{0} and 2.{0}": "compare_versions", "what does rel-{} need": "explicit_version", "current price {}": "current", "red {}": "none", "from 1.{0} to 3.{0}": "compare_versions"}


@query(f"SELECT p_partkey, {list(_WHEN.values())!r}[p_partkey % 9 + 1] AS intent FROM part")
def temporal_questions(spark, sf):
    ways = list(_WHEN)

    def f(batches):
        for b in batches:
            said = [ways[k % 9].format(f"{z % 28 + 1:02d}") for k, z in zip(b["p_partkey"], b["p_size"], strict=True)]
            b["intent"] = [Q.parse_temporal(q).intent for q in said]
            yield b[["p_partkey", "intent"]]

    return table(spark, sf, "part").select("p_partkey", "p_size").mapInPandas(f, "p_partkey long, intent string")


#: Users' events as actions of workers on an operation each, by type and value.
_ACTION = "CASE event_type WHEN 'signup' THEN CASE WHEN event_id % 2 = 0 THEN 'submit' ELSE 'retry' END WHEN 'click' THEN 'claim' WHEN 'view' THEN 'heartbeat' WHEN 'purchase' THEN CASE WHEN event_id % 5 = 0 THEN 'complete' ELSE 'claim' END WHEN 'error' THEN CASE WHEN event_id % 7 = 0 THEN 'cancel' WHEN event_id % 3 = 0 THEN 'fail' ELSE 'heartbeat' END END"
_LEASE_S = 6 * 3600


@query(f"""WITH RECURSIVE e AS (SELECT user_id AS op, event_id AS seq, CAST(floor(epoch(ts)) AS BIGINT) AS tm, {_ACTION} AS a, 'w' || (event_id % 2) AS w, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events WHERE user_id IS NOT NULL),
r(op, n, seq, a, w, tm, outcome, state, holder, until, attempt) AS (
 SELECT op, 0::BIGINT, NULL::BIGINT, NULL::VARCHAR, NULL::VARCHAR, NULL::BIGINT, NULL::VARCHAR, NULL::VARCHAR, NULL::VARCHAR, NULL::BIGINT, 0 FROM (SELECT DISTINCT op FROM e)
 UNION ALL SELECT op, n, seq, a, w, tm, o, CASE o WHEN 'ok' THEN CASE a WHEN 'submit' THEN 'queued' WHEN 'retry' THEN 'queued' WHEN 'claim' THEN 'running' WHEN 'heartbeat' THEN s WHEN 'complete' THEN 'succeeded' WHEN 'fail' THEN 'failed' ELSE CASE s WHEN 'queued' THEN 'cancelled' ELSE 'cancelling' END END
   WHEN 'takeover' THEN 'running' WHEN 'again' THEN 'queued' WHEN 'cancelled' THEN 'cancelled' WHEN 'exhausted' THEN 'failed' ELSE s END,
  CASE WHEN o = 'takeover' OR o = 'ok' AND a IN ('claim', 'heartbeat') THEN w WHEN o IN ('again', 'cancelled', 'exhausted') OR o = 'ok' AND NOT (a = 'cancel' AND s = 'running') THEN NULL ELSE h END,
  CASE WHEN o = 'takeover' OR o = 'ok' AND a IN ('claim', 'heartbeat') THEN tm + {_LEASE_S} WHEN o IN ('again', 'cancelled', 'exhausted') OR o = 'ok' AND NOT (a = 'cancel' AND s = 'running') THEN NULL ELSE u END,
  CASE WHEN a = 'claim' AND o IN ('ok', 'takeover') THEN t + 1 WHEN a IN ('submit', 'retry') AND o = 'ok' THEN 0 ELSE t END
 FROM (SELECT *, CASE a WHEN 'submit' THEN CASE WHEN s IS NULL THEN 'ok' ELSE 'exists' END
   WHEN 'claim' THEN CASE WHEN s = 'queued' THEN 'ok' WHEN stale AND s = 'running' AND t < 3 THEN 'takeover' WHEN stale AND s = 'cancelling' THEN 'cancelled' WHEN stale THEN 'exhausted' WHEN live THEN 'busy' ELSE 'refused' END
   WHEN 'cancel' THEN CASE WHEN s IN ('queued', 'running') THEN 'ok' ELSE 'refused' END WHEN 'retry' THEN CASE WHEN s IN ('failed', 'cancelled') THEN 'ok' ELSE 'refused' END
   ELSE CASE WHEN NOT (live AND w = h) THEN CASE WHEN live OR stale THEN 'lost' ELSE 'refused' END WHEN a = 'heartbeat' THEN 'ok' WHEN s = 'cancelling' THEN 'cancelled' WHEN a = 'complete' THEN 'ok' WHEN t < 3 THEN 'again' ELSE 'ok' END END AS o
  FROM (SELECT e.op, e.n, e.seq, e.a, e.w, e.tm, r.state AS s, r.holder AS h, r.until AS u, r.attempt AS t, coalesce(r.state IN ('running', 'cancelling') AND e.tm > r.until, false) AS stale, coalesce(r.state IN ('running', 'cancelling') AND e.tm <= r.until, false) AS live FROM r JOIN e ON e.op = r.op AND e.n = r.n + 1)))
SELECT op, seq, a AS action, w AS worker, tm AS "at", outcome, state, holder, until, attempt FROM r WHERE n > 0""")
def operation_leases(spark, sf):
    """Every action with what came of it: claims, takeovers of ended leases, late reports, retries and cancels."""
    e = table(spark, sf, "events")
    log = e.select(F.col("user_id").alias("op"), F.col("event_id").alias("seq"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("at"), F.expr(_ACTION).alias("action"), F.concat(F.lit("w"), (F.col("event_id") % 2).cast("string")).alias("worker"))
    return Le.replayed(log, _LEASE_S)


#: Documents as stored files: some are lost, some of another content, and customers' files belong to nobody.
_STORED = """d AS (SELECT doc_id, 'raw/' || source || '/' || doc_id AS path, strlen(coalesce(text, '')) AS bytes, sha256(coalesce(text, '')) AS sha FROM documents)"""


@query(f"""WITH {_STORED} SELECT path, CASE WHEN doc_id % 7 = 0 THEN 'missing' ELSE 'damaged' END AS finding, CASE WHEN doc_id % 7 <> 0 AND doc_id % 11 = 0 THEN bytes + 1 ELSE bytes END AS bytes FROM d WHERE doc_id % 7 = 0 OR doc_id % 11 = 0 OR doc_id % 13 = 0
UNION ALL SELECT 'raw/customer/' || c_custkey, 'orphan', c_custkey FROM customer""")
def storage_reconcile(spark, sf):
    """Files against the documents that refer to them, by size and digest."""
    d = docs(spark, sf)
    i, text = F.col("doc_id"), F.coalesce("text", F.lit(""))
    refs = d.select("doc_id", F.concat_ws("/", F.lit("raw"), "source", i.cast("string")).alias("path"), F.octet_length(text).cast("long").alias("bytes"), F.sha2(text, 256).alias("sha256"))
    there = refs.filter(i % 7 != 0).select("path", F.when(i % 11 == 0, F.col("bytes") + 1).otherwise(F.col("bytes")).alias("bytes"), F.when(i % 13 == 0, F.sha2("sha256", 256)).otherwise(F.col("sha256")).alias("sha256"))
    others = table(spark, sf, "customer").select(F.concat(F.lit("raw/customer/"), F.col("c_custkey").cast("string")).alias("path"), F.col("c_custkey").cast("long").alias("bytes"), F.lit("x").alias("sha256"))
    return St.reconciled(there.unionByName(others), refs.drop("doc_id"))


@query(f"""WITH {CHUNKS}, n AS (SELECT doc_id, count(*) AS counted FROM chunks GROUP BY doc_id) SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 0 ELSE coalesce(counted, 0) + 2 END AS told, coalesce(counted, 0) AS counted FROM documents LEFT JOIN n USING (doc_id)
WHERE doc_id % 9 = 0 AND doc_id % 5 <> 0 OR doc_id % 5 = 0 AND coalesce(counted, 0) <> 0""")
def chunk_counts(spark, sf):
    """Documents that say a wrong number of chunks; after the repair none does."""
    c, d = chunks(docs(spark, sf)), docs(spark, sf)
    n = c.groupBy("doc_id").agg(F.count("*").alias("n"))
    i = F.col("doc_id")
    told = d.select("doc_id").join(n, "doc_id", "left").select("doc_id", F.when(i % 5 == 0, None).when(i % 9 == 0, F.coalesce("n", F.lit(0)) + 2).otherwise(F.coalesce("n", F.lit(0))).cast("int").alias("chunk_count"))
    return St.miscounted(told, c).unionByName(St.miscounted(St.recounted(told, c), c))


@query("SELECT event_id AS seq, event_type AS kind FROM events WHERE user_id = 3 AND event_id > 200 ORDER BY event_id LIMIT 100")
def operation_tail(spark, sf):
    """What one operation's log has behind a cursor."""
    e = table(spark, sf, "events").select(F.col("user_id").alias("op"), F.col("event_id").alias("seq"), F.col("event_type").alias("kind"))
    return Le.tail(e, 3, 200).select("seq", "kind")


@query("""SELECT doc_id, ['ready', 'pending', 'processing', 'failed'][doc_id % 4 + 1] AS status FROM documents WHERE doc_id % 4 IN (1, 2) AND doc_id % 5 <> 0 ORDER BY n_chars % 100, doc_id LIMIT 200""")
def indexing_status(spark, sf):
    """Documents that wait for their index, the first 200."""
    i = F.col("doc_id")
    status = F.element_at(F.array(*map(F.lit, ("ready", "pending", "processing", "failed"))), (i % 4 + 1).cast("int"))
    d = docs(spark, sf).select("doc_id", status.alias("status"), F.when(i % 5 == 0, "deleting").alias("lifecycle"), (F.col("n_chars") % 100).alias("updated"))
    return Li.indexing(d).select("doc_id", "status")


@query("""WITH d AS (SELECT n_chars % 100 AS created, doc_id FROM documents WHERE (n_chars % 100, doc_id) <= (80, 150)), p AS (SELECT *, (row_number() OVER (ORDER BY created, doc_id) - 1) // 16 AS page FROM d)
SELECT page, count(*) AS documents, min(created) AS first, max(created) AS last, sum(doc_id)::BIGINT AS ids FROM p GROUP BY page""")
def reindex_walk(spark, sf):
    """Pages of sixteen documents by creation and id, up to the key at which the walk began."""
    d = docs(spark, sf).select((F.col("n_chars") % 100).alias("created"), "doc_id")
    return Pg.walk(d, ["created", "doc_id"], 16, (80, 150)).groupBy("page").agg(F.count("*").alias("documents"), F.min("created").alias("first"), F.max("created").alias("last"), F.sum("doc_id").alias("ids"))
