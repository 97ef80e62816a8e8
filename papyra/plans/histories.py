"""Queries of sources' versions and dates, histories, provenance, evaluation and trees."""

from __future__ import annotations

from papyra.functions import questions as Q
from papyra.functions import sources as So
from papyra.operators import evaluation as Ev
from papyra.operators import history as H
from papyra.operators import lexical as Lex
from papyra.operators import ranking as Ra
from papyra.plans.catalogue import CHUNKS, F, docs, query, table
from papyra.plans.retrieval import index
from papyra.sources import ir
from papyra.sources.store import written


def titled(spark, sf):
    """Parts as sources: a title that names a version or a date, metadata for some."""
    k, z = F.col("p_partkey"), F.col("p_size").cast("string")
    day = F.lpad((F.col("p_size") % 28 + 1).cast("string"), 2, "0")
    title = F.when(k % 5 == 0, F.concat("p_name", F.lit(" release "), z, F.lit(" notes.md"))).when(k % 5 == 1, F.concat("p_name", F.lit("-v1."), z, F.lit(".txt"))).when(k % 5 == 2, F.concat(F.lit("2024-03-"), day, F.lit(" "), "p_name")).when(k % 5 == 3, F.concat("p_name", F.lit(" v0203"), day)).otherwise(F.col("p_name"))
    meta = F.when(k % 3 == 0, F.create_map(F.lit("version"), F.concat(F.lit("9."), z), F.lit("date"), F.concat(F.lit("2023-01-"), day, F.lit("T00:00:00Z")), F.lit("source_authority"), F.when(k % 2 == 0, "Docs").otherwise(z)))
    return table(spark, sf, "part").select("p_partkey", title.alias("title"), F.coalesce(meta, F.create_map().cast("map<string,string>")).alias("meta"))


@query("""WITH p AS (SELECT *, p_partkey AS k, p_size % 28 + 1 AS d FROM part) SELECT p_partkey, CASE WHEN k % 3 = 0 THEN '9.' || p_size WHEN k % 5 = 0 THEN 'rel-' || p_size WHEN k % 5 = 1 THEN '1.' || p_size WHEN k % 5 = 3 THEN '2.3.' || d END AS version,
CASE WHEN k % 5 = 2 THEN epoch(make_date(2024, 3, d::INT))::BIGINT WHEN k % 3 = 0 THEN epoch(make_date(2023, 1, d::INT))::BIGINT ELSE 0 END AS published, 0::BIGINT AS effective, CASE WHEN k % 3 <> 0 THEN 8 WHEN k % 2 = 0 THEN 2 ELSE p_size END::INT AS authority FROM p""")
def source_descriptions(spark, sf):
    return titled(spark, sf).select("p_partkey", So.described(F.col("title"), F.col("meta")).alias("d")).select("p_partkey", "d.version", "d.published", "d.effective", "d.authority")


@query("""SELECT event_id, CASE event_id % 6 WHEN 0 THEN event_id WHEN 1 THEN epoch(date_trunc('second', ts))::BIGINT WHEN 2 THEN epoch(date_trunc('second', ts))::BIGINT - 7200 WHEN 3 THEN epoch(date_trunc('day', ts))::BIGINT WHEN 4 THEN epoch(date_trunc('second', ts))::BIGINT ELSE 0 END AS seconds FROM events""")
def timestamps(spark, sf):
    i, t = F.col("event_id"), F.col("ts")
    at = lambda f: F.date_format(t, f)
    said = F.when(i % 6 == 0, i.cast("string")).when(i % 6 == 1, at("yyyy-MM-dd'T'HH:mm:ss'Z'")).when(i % 6 == 2, F.concat(at("yyyy-MM-dd'T'HH:mm:ss"), F.lit("+02:00"))).when(i % 6 == 3, at("yyyy-MM-dd")).when(i % 6 == 4, at("yyyy-MM-dd HH:mm:ss")).otherwise("13/01/2024")
    return table(spark, sf, "events").select("event_id", So.timestamp(said).alias("seconds"))


@query("SELECT p_partkey, [1, 2, 3, 4, 5, 8, 100, 8][p_partkey % 8 + 1]::INT AS priority FROM part")
def source_authority(spark, sf):
    names = F.array(*map(F.lit, (" Changelog", "SPEC", "code", "readme", "old-design", "blog", "100", "101")))
    return table(spark, sf, "part").select("p_partkey", So.authority(F.element_at(names, (F.col("p_partkey") % 8 + 1).cast("int"))).alias("priority"))


#: Parts as units: versions 1.0 to 3.9 by size and key, every ninth deleted, every eleventh without order.
_UNITS = "u AS (SELECT p_partkey, lpad(p_partkey::VARCHAR, 9, '0') AS key, CASE WHEN p_partkey % 11 = 0 THEN '1.0-beta' ELSE (p_size % 3 + 1) || '.' || p_partkey % 10 END AS version, p_size % 3 + 1 AS major, p_partkey % 10 AS minor, p_partkey % 9 = 0 AS gone, p_name, p_type FROM part), o AS (SELECT * FROM u WHERE NOT gone AND p_partkey % 11 <> 0)"


def units(spark, sf):
    k = F.col("p_partkey")
    v = F.when(k % 11 == 0, "1.0-beta").otherwise(F.concat((F.col("p_size") % 3 + 1).cast("string"), F.lit("."), (k % 10).cast("string")))
    return table(spark, sf, "part").select(F.lpad(k.cast("string"), 9, "0").alias("key"), v.alias("version"), F.when(k % 9 == 0, "deleted").otherwise("active").alias("status"), F.when(k % 2 == 0, "concept").otherwise("fact").alias("type"), F.col("p_name").alias("title"), F.concat("p_type", F.when(k % 7 == 0, " introduced").otherwise("")).alias("content"))


@query(f"WITH {_UNITS} SELECT version, row_number() OVER (ORDER BY major, minor)::INT AS place, count(*) AS units FROM o GROUP BY version, major, minor")
def version_order(spark, sf):
    return H.versions(units(spark, sf))


@query(f"WITH {_UNITS} SELECT key, version, row_number() OVER (PARTITION BY version ORDER BY p_partkey % 2 = 0, key)::INT AS place FROM o")
def version_groups(spark, sf):
    return H.grouped(units(spark, sf)).select("key", "version", "place")


@query(f"WITH {_UNITS}, b AS (SELECT min(major * 100 + minor) FILTER (p_partkey % 7 = 0) AS b FROM o WHERE contains(lower(p_name || ' ' || p_type), 'red')) SELECT key, version FROM o, b WHERE major * 100 + minor > b UNION ALL SELECT key, '<' || version FROM o WHERE major * 100 + minor <= 203 UNION ALL SELECT key, '=' || version FROM o WHERE major * 100 + minor BETWEEN 105 AND 202")
def history_range(spark, sf):
    """After an event, until a version, and between two."""
    u = units(spark, sf)
    a, b, c = (H.in_range(u, Q.parse_range(q)) for q in ("after red", "until 2.3", "from 2.2 to 1.5"))
    sign = lambda s, d: d.select("key", F.concat(F.lit(s), "version").alias("version"))
    return sign("", a).union(sign("<", b)).union(sign("=", c))


@query(f"WITH {_UNITS}, v AS (SELECT major, min(minor) AS a, max(minor) AS b, count(DISTINCT minor) AS versions, count(*) AS units FROM o GROUP BY major) SELECT (row_number() OVER (ORDER BY major) - 1)::INT AS phase, major || '.' || a AS first, major || '.' || b AS last, versions, units, lead(major || '.' || a) OVER (ORDER BY major) AS next FROM v")
def timeline_phases(spark, sf):
    return H.phases(units(spark, sf)).select("phase", "first", "last", "versions", "units", "next")


@query(f"""WITH {_UNITS}, c AS (SELECT *, row_number() OVER (PARTITION BY version ORDER BY p_partkey % 5 DESC, key) - 1 AS place FROM u WHERE version IN ('1.2', '2.4')) SELECT version, place::INT AS place, (1000 - place)::INT AS score, p_partkey AS doc_id FROM c WHERE place < 4""")
def version_evidence(spark, sf):
    u = units(spark, sf)
    k = F.col("key").cast("long")
    own = u.withColumns({"doc_id": k, "confidence": (k % 5) / 5.0, "chunk": F.when(k % 2 == 0, F.lit(0)), "node": F.concat(F.lit("n"), "key")})
    texts = own.select("doc_id", F.lit(0).alias("chunk"), "node", F.col("title").alias("text"))
    return H.evidence_of(own, texts, ["1.2", "2.4"]).select("version", "place", "score", "doc_id")


# --- provenance ---------------------------------------------------------
@query("""WITH n AS (SELECT p_partkey, p_partkey // 5 AS chunk, ['table_cell', 'page', 'paragraph', 'caption', 'section'][p_size % 5 + 1] AS type, p_size % 2 = 0 AS header FROM part),
s AS (SELECT *, CASE WHEN type = 'table_cell' THEN CASE WHEN header THEN 90 ELSE 100 END WHEN type = 'page' THEN 90 WHEN type = 'paragraph' THEN 80 WHEN type = 'caption' THEN 70 ELSE 20 END AS score FROM n)
SELECT chunk, arg_min(lpad(p_partkey::VARCHAR, 9, '0'), (-score, lpad(p_partkey::VARCHAR, 9, '0'))) AS node_id, max(score)::INT AS score FROM s GROUP BY chunk""")
def chunk_provenance(spark, sf):
    k, z = F.col("p_partkey"), F.col("p_size")
    n = table(spark, sf, "part").select(F.lit(1).alias("doc_id"), F.lit(1).alias("generation"), F.floor(k / 5).alias("chunk"), F.lpad(k.cast("string"), 9, "0").alias("node_id"), F.element_at(F.array(*map(F.lit, ("table_cell", "page", "paragraph", "caption", "section"))), (z % 5 + 1).cast("int")).alias("type"), (z % 2 == 0).alias("header"))
    return ir.provenance(n.select("doc_id", "generation", "chunk", "node_id"), n.drop("chunk")).select("chunk", "node_id", "score")


@query(f"WITH {CHUNKS} SELECT doc_id, count(*) AS pieces, count(*) AS linked FROM chunks WHERE trim(replace(text, '#', '')) <> '' GROUP BY doc_id")
def piece_nodes(spark, sf):
    """Pieces of structured texts, each found in at least one node by its text."""
    from papyra.plans.compiler import structured

    n = written(structured(spark, sf).withColumn("text", F.when(F.col("type") != "document", F.col("text"))), "nodes")  # a document's own text is that of its nodes
    p = written(ir.pieces(n).select("doc_id", "idx", "text", F.lit("").alias("heading")), "pieces")
    found = ir.nodes_of(p, n).filter("how = 'text'").select("doc_id", "idx").distinct().groupBy("doc_id").agg(F.count("*").alias("linked"))
    return p.groupBy("doc_id").agg(F.count("*").alias("pieces")).join(found, "doc_id")


# --- evaluation ---------------------------------------------------------
_ASK = "SELECT item_id, array_to_string(list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z0-9_]{2,}'), lambda x: length(x) >= 8)), ' ') AS q FROM benchmark"


@query(f"""WITH {CHUNKS}, t AS (SELECT doc_id, idx, regexp_extract_all(lower(text), '[a-z0-9_]{{2,}}') AS t FROM chunks), n AS (SELECT count(*) AS n, avg(len(t)) AS a FROM t), q AS (SELECT item_id, unnest(string_split(q, ' ')) AS term FROM ({_ASK}) WHERE q <> ''),
p AS (SELECT doc_id, idx, len(t) AS len, term, count(*) AS tf FROM (SELECT doc_id, idx, t, unnest(t) AS term FROM t) WHERE term IN (SELECT term FROM q) GROUP BY doc_id, idx, t, term), d AS (SELECT term, count(*)::DOUBLE AS df FROM p GROUP BY term),
s AS (SELECT item_id, doc_id, idx, round(sum(ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE) + 1) * tf / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len / a))), 6) AS score FROM p JOIN q USING (term) JOIN d USING (term), n GROUP BY item_id, doc_id, idx)
SELECT item_id AS question, doc_id, idx, score FROM s QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id, idx) <= 3""")
def gold_hits(spark, sf):
    """The three best chunks for every benchmark passage, asked by its long words."""
    return asked_hits(spark, sf).select("question", "doc_id", "idx", "score")


def asked_hits(spark, sf):
    words = F.array_distinct(F.filter(F.regexp_extract_all(F.lower("text"), F.lit("([a-z0-9_]{2,})"), 1), lambda w: F.length(w) >= 8))
    q = table(spark, sf, "benchmark").select(F.col("item_id").alias("question"), F.array_join(words, " ").alias("text"))
    return Lex.bm25_many(index(spark, sf), q, 3)


@query(f"""WITH {CHUNKS}, t AS (SELECT doc_id, idx, regexp_extract_all(lower(text), '[a-z0-9_]{{2,}}') AS t FROM chunks), n AS (SELECT count(*) AS n, avg(len(t)) AS a FROM t), q AS (SELECT item_id, unnest(string_split(q, ' ')) AS term FROM ({_ASK}) WHERE q <> ''),
p AS (SELECT doc_id, idx, len(t) AS len, term, count(*) AS tf FROM (SELECT doc_id, idx, t, unnest(t) AS term FROM t) WHERE term IN (SELECT term FROM q) GROUP BY doc_id, idx, t, term), d AS (SELECT term, count(*)::DOUBLE AS df FROM p GROUP BY term),
s AS (SELECT item_id, doc_id, idx, round(sum(ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE) + 1) * tf / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len / a))), 6) AS score FROM p JOIN q USING (term) JOIN d USING (term), n GROUP BY item_id, doc_id, idx),
l AS (SELECT item_id, doc_id, idx, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id, idx) AS lr FROM s QUALIFY lr <= 12),
v AS (SELECT b.item_id, e.vec_id AS doc_id, 0::BIGINT AS idx, row_number() OVER (PARTITION BY b.item_id ORDER BY round(least(1, greatest(0, list_dot_product(e.embedding::DOUBLE[], o.embedding::DOUBLE[]))), 6) DESC, e.vec_id) AS vr FROM benchmark b JOIN embeddings o ON o.vec_id = b.item_id, embeddings e QUALIFY vr <= 12),
f AS (SELECT coalesce(l.item_id, v.item_id) AS item_id, coalesce(l.doc_id, v.doc_id) AS doc_id, coalesce(l.idx, v.idx) AS idx, lr, vr, round(coalesce(1.0::DOUBLE / (60 + lr), 0) + coalesce(2.0::DOUBLE / (60 + vr), 0), 9) AS score FROM l FULL JOIN v ON l.item_id = v.item_id AND l.doc_id = v.doc_id AND l.idx = v.idx)
SELECT item_id AS question, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id, idx) AS INTEGER) AS rank, doc_id, idx, score, CAST(lr AS INTEGER) AS lexical_rank, CAST(vr AS INTEGER) AS vector_rank FROM f QUALIFY rank <= 5""")
def ranked_questions(spark, sf):
    """Every benchmark passage as a question, asked by its long words and by the vector of its number: five chunks each, all at once."""
    words = F.array_distinct(F.filter(F.regexp_extract_all(F.lower("text"), F.lit("([a-z0-9_]{2,})"), 1), lambda w: F.length(w) >= 8))
    e = table(spark, sf, "embeddings")
    own = e.select(F.col("vec_id").alias("question"), F.col("embedding").alias("vector"))
    q = table(spark, sf, "benchmark").select(F.col("item_id").alias("question"), F.array_join(words, " ").alias("text")).join(own, "question", "left")
    v = e.select(F.col("vec_id").alias("doc_id"), F.lit(0).cast("long").alias("idx"), "embedding")
    return Ra.rank(index(spark, sf), v, q, k=5, weights=(1.0, 2.0))



#: As ``_ASK``, with every word.
_ASK_ALL = "SELECT item_id, array_to_string(list_distinct(regexp_extract_all(lower(text), '[a-z0-9_]{2,}')), ' ') AS q FROM benchmark"


@query("""WITH h AS (SELECT e.vec_id % 7 AS q, e.vec_id, e.label, row_number() OVER (PARTITION BY e.vec_id % 7 ORDER BY e.vec_id * 31 % 101, vec_id) AS r FROM embeddings e), g AS (SELECT q, vec_id, r FROM h WHERE label = 1),
m AS (SELECT q, min(CASE WHEN r <= 10 THEN r END) AS first, count(*) FILTER (r <= 3) AS in3, count(*) FILTER (r <= 10) AS seen, count(*) AS n FROM g GROUP BY q)
SELECT round(avg(coalesce((first = 1)::INT, 0)), 6) AS hit1, round(avg(coalesce((first <= 3)::INT, 0)), 6) AS hit3, round(avg(in3 / n::DOUBLE), 6) AS recall3, round(avg(coalesce(1.0::DOUBLE / first, 0)), 6) AS mrr, round(avg(seen / n::DOUBLE), 6) AS context_recall FROM m""")
def retrieval_metrics(spark, sf):
    """Seven rankings of ten vectors; those of one label are what was to be found."""
    from pyspark.sql import Window

    e = table(spark, sf, "embeddings").select((F.col("vec_id") % 7).alias("question"), F.col("vec_id").alias("doc_id"), "label")
    ranked = e.withColumn("rank", F.row_number().over(Window.partitionBy("question").orderBy(F.col("doc_id") * 31 % 101, "doc_id"))).filter("rank <= 10")
    m = Ev.ranking(ranked.select("question", "rank", "doc_id"), e.filter("label = 1").select("question", "doc_id"))
    return m.select(*(F.round(c, 6).alias(c) for c in m.columns))


@query(f"""WITH {CHUNKS}, t AS (SELECT doc_id, idx, regexp_extract_all(lower(text), '[a-z0-9_]{{2,}}') AS t FROM chunks), n AS (SELECT count(*) AS n, avg(len(t)) AS a FROM t), q AS (SELECT item_id, unnest(string_split(q, ' ')) AS term FROM ({_ASK_ALL}) WHERE q <> ''),
p AS (SELECT doc_id, idx, len(t) AS len, term, count(*) AS tf FROM (SELECT doc_id, idx, t, unnest(t) AS term FROM t) WHERE term IN (SELECT term FROM q) GROUP BY doc_id, idx, t, term), d AS (SELECT term, count(*)::DOUBLE AS df FROM p GROUP BY term),
s AS (SELECT item_id, doc_id, idx, round(sum(ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE) + 1) * tf / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len / a))), 6) AS score FROM p JOIN q USING (term) JOIN d USING (term), n GROUP BY item_id, doc_id, idx),
h AS (SELECT item_id, doc_id, score FROM s QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id, idx) <= 3),
g AS (SELECT b.item_id, x.doc_id FROM benchmark b JOIN documents x ON contains(x.text, b.text) WHERE b.text <> ''),
f AS (SELECT g.item_id, count(*) AS wanted, count(*) FILTER (EXISTS (SELECT 1 FROM h WHERE h.item_id = g.item_id AND h.doc_id = g.doc_id)) AS found FROM g GROUP BY g.item_id),
o AS (SELECT item_id, max(score) AS top FROM h GROUP BY item_id)
SELECT b.item_id AS question, round(coalesce(found / wanted::DOUBLE, 0), 6) AS recall, coalesce(found = wanted, false) AS "full", coalesce(top, 0) <= 0 AS abstained, coalesce(top, 0) > 0 AND coalesce(found = wanted, false) AS correct
FROM benchmark b LEFT JOIN f USING (item_id) LEFT JOIN o USING (item_id)""")
def gold_run(spark, sf):
    """A run over all benchmark passages as gold questions, each asked by all of its words: which of the documents that hold a passage its three best chunks come from."""
    from papyra.plans.retrieval import needles

    b = table(spark, sf, "benchmark").select(F.col("item_id").alias("question"), F.col("text").alias("needle"))
    gold = needles(spark, sf).select(F.col("item_id").alias("question"), F.col("doc_id").alias("document")).join(b, "question")
    asked = b.select("question", F.col("needle").alias("text"))
    hits = Lex.bm25_many(index(spark, sf), asked, 3).join(docs(spark, sf).select("doc_id", "text"), "doc_id")
    q = b.select("question", F.lit("needle").alias("category"), F.lit(False).alias("abstains"), F.lit(1.0).alias("ms"))
    r = Ev.answered(hits.select("question", "doc_id", "text", "score"), gold, q)
    return r.select("question", F.round("recall", 6).alias("recall"), "full", "abstained", "correct")


@query("""WITH r AS (SELECT event_type AS category, value AS ms, event_id % 10 / 10.0 AS recall, event_id % 10 = 9 AS whole, event_id % 3 = 0 AS abstained, event_id % 4 = 0 AS abstains FROM events WHERE value IS NOT NULL), c AS (SELECT *, (abstained = abstains) AND (abstains OR whole) AS correct FROM r),
g AS (SELECT category, count(*) AS questions, round(avg(recall), 6) AS recall, round(avg(correct::INT), 6) AS accuracy, list_sort(list(ms))[greatest(1, floor(count(*) * 0.95::DOUBLE)::BIGINT)] AS p95_ms FROM c GROUP BY ROLLUP (category)) SELECT coalesce(category, 'all') AS category, questions, recall, accuracy, p95_ms FROM g""")
def eval_summary(spark, sf):
    i = F.col("event_id")
    r = table(spark, sf, "events").filter("value is not null").select(F.col("event_type").alias("category"), F.col("value").alias("ms"), ((i % 10) / 10.0).alias("recall"), (i % 10 == 9).alias("full"), (i % 3 == 0).alias("abstained"), (i % 4 == 0).alias("abstains"))
    r = r.withColumn("correct", (F.col("abstained") == F.col("abstains")) & (F.col("abstains") | F.col("full")))
    return Ev.summary(r).select(F.coalesce("category", F.lit("all")).alias("category"), "questions", F.round("recall", 6).alias("recall"), F.round("accuracy", 6).alias("accuracy"), "p95_ms")


@query("""WITH a AS (SELECT event_type AS metric, round(avg(value), 6) AS v FROM events WHERE user_id % 2 = 0 GROUP BY event_type), b AS (SELECT event_type AS metric, round(avg(value), 6) AS v FROM events WHERE user_id % 2 = 1 GROUP BY event_type)
SELECT metric, round(b.v - a.v, 5) AS delta, round(CASE WHEN a.v = 0 THEN 0 ELSE (b.v - a.v) / a.v END, 5) AS relative FROM a JOIN b USING (metric)""")
def arm_compare(spark, sf):
    e = table(spark, sf, "events").groupBy(F.col("event_type").alias("metric"), (F.col("user_id") % 2).alias("side")).agg(F.round(F.avg("value"), 6).alias("value"))
    c = Ev.compared(e.filter("side = 0"), e.filter("side = 1"))
    return c.select("metric", F.round("delta", 5).alias("delta"), F.round("relative", 5).alias("relative"))


@query("""WITH t AS (SELECT n_regionkey AS directory, s_suppkey AS place, CASE WHEN s_acctbal < -500 THEN 'failed:' || s_suppkey WHEN s_acctbal < 0 THEN 'pending' ELSE 'ready' END AS status FROM supplier JOIN nation ON s_nationkey = n_nationkey)
SELECT directory, coalesce(arg_min(status, place) FILTER (starts_with(status, 'failed')), CASE WHEN bool_or(status = 'pending') THEN 'processing' ELSE 'ready' END) AS status FROM t GROUP BY directory""")
def tree_status(spark, sf):
    s = table(spark, sf, "supplier").join(table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    bal = F.col("s_acctbal")
    return Ev.directory_status(s.select(F.col("n_regionkey").alias("directory"), F.col("s_suppkey").alias("place"), F.when(bal < -500, F.concat(F.lit("failed:"), F.col("s_suppkey").cast("string"))).when(bal < 0, "pending").otherwise("ready").alias("status")))
