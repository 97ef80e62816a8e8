"""Queries of search as a whole, evidence windows, temporal rules and context packages."""

from __future__ import annotations

from papyra.functions import questions as Q
from papyra.operators import context as C
from papyra.operators import evidence as E
from papyra.operators import retrieval as R
from papyra.operators import search as Se
from papyra.operators import snapshots as Sn
from papyra.plans.catalogue import CHUNKS, F, docs, query, table
from papyra.plans.compiler import compiled
from papyra.plans.retrieval import _BM25, _VEC, QUERY, index, parts, vector
from papyra.sources.store import fingerprint, shared_dir
from papyra.sources.tables import chunks

#: Documents are fine, poor or incomplete by their labels; those of every 13th id are being deleted.
_STATE = "CASE WHEN toxic = 1 THEN 'INCOMPLETE' WHEN quality = 0 THEN 'LOW_QUALITY' ELSE 'GOOD' END"


def described(spark, sf):
    """The library's documents, for what needs neither texts nor an index."""
    d = docs(spark, sf)
    labels = table(spark, sf, "labels").groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min("quality").alias("quality"))
    day = lambda n: F.date_add(F.lit("2024-01-01").cast("date"), n.cast("int"))
    i = F.col("doc_id")
    return d.join(labels, "doc_id", "left").select(
        "doc_id", F.concat_ws(" ", F.lit("page"), F.col("source"), i.cast("string")).alias("title"), "source", F.when(i % 3 == 0, day(i % 300)).alias("updated"), day(i % 100).alias("created"),
        F.when(i % 13 == 0, "deleting").otherwise("ready").alias("status"), F.expr(_STATE).alias("quality"))


def library(spark, sf, words: bool = True) -> Se.Library:
    """The library, with its index of words where these are searched."""
    c = chunks(docs(spark, sf))
    heads = c.withColumn("heading", F.concat(F.lit("part "), F.floor(F.col("idx") / 4).cast("string")))
    v = table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), F.lit(0).cast("long").alias("idx"), F.lit("m").alias("model"), "embedding")
    return Se.Library(described(spark, sf), heads.select("doc_id", "idx", "heading", "text"), index(spark, sf) if words else None, v)


def asked_vector(spark, sf) -> list[float]:
    return list(table(spark, sf, "embeddings").filter("vec_id = 0").select("embedding").first()[0])


_LIB = f"""lb AS (SELECT doc_id, max(toxic) AS toxic, min(quality) AS quality FROM labels GROUP BY doc_id), ab AS (SELECT d.doc_id, source, DATE '2024-01-01' + CAST(CASE WHEN d.doc_id % 3 = 0 THEN d.doc_id % 300 ELSE d.doc_id % 100 END AS INTEGER) AS day, d.doc_id % 13 = 0 AS gone, {_STATE} AS q, 'page ' || source || ' ' || d.doc_id AS title FROM documents d LEFT JOIN lb USING (doc_id))"""
_HITS = """la AS (SELECT doc_id, idx, score / (score + 1) AS s, row_number() OVER (ORDER BY score / (score + 1) DESC, doc_id, idx) AS r FROM bm{0} QUALIFY r <= {1}),
lv AS (SELECT vec_id AS doc_id, 0 AS idx, score AS s, row_number() OVER (ORDER BY score DESC, vec_id) AS r FROM vec WHERE vec_id IN (SELECT doc_id FROM ab{2}) QUALIFY r <= {1}),
fu AS (SELECT coalesce(la.doc_id, lv.doc_id) AS doc_id, coalesce(la.idx, lv.idx) AS idx, round(coalesce(1.0::DOUBLE / (60 + la.r), 0) + coalesce(1.0::DOUBLE / (60 + lv.r), 0), 9) AS score, la.r AS lr, lv.r AS vr, la.s AS ls, lv.s AS vs FROM la FULL JOIN lv ON la.doc_id = lv.doc_id AND la.idx = lv.idx),
ok AS (SELECT fu.*, q = 'LOW_QUALITY' AS low FROM fu JOIN ab USING (doc_id) WHERE (coalesce(ls, 0) > 0 OR coalesce(vs, 0) >= 0.35) AND NOT gone AND q <> 'INCOMPLETE'),
top AS (SELECT row_number() OVER (ORDER BY low, score DESC, doc_id, idx) AS rank, doc_id, idx, score, lr AS lexical_rank, vr AS vector_rank, low FROM ok QUALIFY rank <= {3})"""


@query(f"WITH {_BM25}, {_VEC}, {_LIB}, {_HITS.format('', 30, '', 10)} SELECT CAST(rank AS INTEGER) AS rank, doc_id, idx, score, CAST(lexical_rank AS INTEGER) AS lexical_rank, CAST(vector_rank AS INTEGER) AS vector_rank, low FROM top")
def search_hybrid(spark, sf):
    hits = Se.search(library(spark, sf), QUERY, asked_vector(spark, sf), Se.Options(top_k=10))
    return hits.select("rank", "doc_id", "idx", "score", "lexical_rank", "vector_rank", "low")


def anchors(spark, sf):
    """Chunks lie on pages of 40 and slides of 100, in a sheet named by the language; every fifth is a table."""
    c = chunks(docs(spark, sf)).join(docs(spark, sf).select("doc_id", "lang"), "doc_id")
    one = lambda x: F.array(x)
    i = F.col("idx")
    return c.select("doc_id", "idx", one(F.floor(i / 40).cast("int") + 1).alias("pages"), one(F.floor(i / 100).cast("int") + 1).alias("slides"), one(F.concat(F.lit("Sheet "), "lang")).alias("sheets"), one(F.when(i % 5 == 0, "table").otherwise("paragraph")).alias("types"))


#: Searches of every mode, each without a threshold and with two.
_LEAST = {"hybrid": (0.5, 0.95), "vector": (0.2, 0.4), "lexical": (0.7, 0.9)}
_MODE = {"hybrid": "TRUE", "vector": "vr IS NOT NULL", "lexical": "lr IS NOT NULL"}
_SAID = {"hybrid": "round(score / (SELECT max(score) FROM fu), 6)", "vector": "round(vs, 6)", "lexical": "round(ls, 6)"}
_BEFORE = {"hybrid": "score", "vector": "round(1.0::DOUBLE / (60 + vr), 9)", "lexical": "round(1.0::DOUBLE / (60 + lr), 9)"}
_ALL_HITS = _HITS.format("", 30, "", 10).split("ok AS (")[0] + "am AS (SELECT fu.*, q = 'LOW_QUALITY' AS low FROM fu JOIN ab USING (doc_id) WHERE NOT gone AND q <> 'INCOMPLETE')"
_RANKED = " UNION ALL ".join(
    f"SELECT * FROM (SELECT '{m}' AS mode, {t} AS threshold, row_number() OVER (ORDER BY low, {_BEFORE[m]} DESC, doc_id, idx) AS rank, doc_id, idx, {_SAID[m]} AS relevance FROM am WHERE {_MODE[m]} AND {_SAID[m]} >= {max(t, 0.35) if m == 'vector' and not t else t}"
    f" {'AND (coalesce(ls, 0) > 0 OR coalesce(vs, 0) >= 0.35)' if m == 'hybrid' else ''}) WHERE rank <= 10"
    for m in _LEAST
    for t in (0.0, *_LEAST[m])
)


@query(f"WITH {_BM25}, {_VEC}, {_LIB}, {_ALL_HITS} SELECT mode, threshold::DOUBLE AS threshold, CAST(rank AS INTEGER) AS rank, doc_id, idx, relevance FROM ({_RANKED})")
def search_threshold(spark, sf):
    """Thresholds hold for the relevance of each mode; a vector search without one needs 0.35, a hybrid hit without a word of the question always."""
    lib, v, out = library(spark, sf), asked_vector(spark, sf), None
    for m, ts in _LEAST.items():
        for t in (None, *ts):
            hits = Se.search(lib, QUERY, v, Se.Options(top_k=10, mode=m, threshold=t))
            hits = hits.select(F.lit(m).alias("mode"), F.lit(t or 0.0).alias("threshold"), "rank", "doc_id", "idx", "relevance")
            out = hits if out is None else out.unionByName(hits)
    return out


@query(f"""WITH {_BM25}, {_VEC}, {_LIB}, {_ALL_HITS}, an AS (SELECT am.* FROM am JOIN documents USING (doc_id) WHERE (coalesce(ls, 0) > 0 OR coalesce(vs, 0) >= 0.35) AND idx // 40 IN (0, 1) AND idx // 100 = 0 AND lang IN ('en', 'fr') AND idx % 5 = 0)
SELECT CAST(row_number() OVER (ORDER BY low, score DESC, doc_id, idx) AS INTEGER) AS rank, doc_id, idx, score FROM an QUALIFY rank <= 10""")
def search_structure(spark, sf):
    """Hits on the first two pages and the first slide, in two sheets, that are tables."""
    lib = library(spark, sf)
    lib.anchors = anchors(spark, sf)
    where = Se.Structure([1, 2], [1], ["SHEET en", " sheet fr "], ["Table"])
    return Se.search(lib, QUERY, asked_vector(spark, sf), Se.Options(top_k=10, structure=where)).select("rank", "doc_id", "idx", "score")


_PINNED: dict[tuple, str] = {}


def published(spark, sf) -> str:
    """The folder of a library in two snapshots, made once a session: in the first all documents are ready, in the second those of every 13th id are being deleted."""
    key = (spark.sparkContext.applicationId, fingerprint(docs(spark, sf)))
    if key not in _PINNED:
        root, lib = f"{shared_dir(spark)}/papyra-library-{key[1][:16]}-{len(_PINNED)}", library(spark, sf, words=False)
        ready = lib.documents.withColumn("status", F.lit("ready"))
        first = Sn.publish(spark, root, Sn.tables_of(ready, lib.chunks, lib.vectors, anchors(spark, sf)))
        Sn.publish(spark, root, {"documents": lib.documents}, first.epoch)
        _PINNED[key] = root
    return _PINNED[key]


_SNAP = f"""WITH {parts(f"q AS (SELECT 0 AS question, '{QUERY}' AS q)")}, {_VEC}, {_LIB.replace("d.doc_id % 13 = 0 AS gone", "false AS gone")},
{_HITS.format('', 30, '', 10).replace("score / (score + 1)", "score").replace("FROM bm", "FROM k")}"""


@query(f"{_SNAP} SELECT CAST(rank AS INTEGER) AS rank, doc_id, idx, score, 1::BIGINT AS epoch FROM top WHERE doc_id % 13 <> 0")
def search_snapshot(spark, sf):
    """Ten hits of the first snapshot, by parts of words and vectors; those of documents deleted since are not returned, and leave a gap."""
    hits = Sn.search(spark, published(spark, sf), QUERY, asked_vector(spark, sf), Se.Options(top_k=10), epoch=1)
    return hits.select("rank", "doc_id", "idx", "score", "epoch")


@query(f"{_SNAP}, hit AS (SELECT rank, doc_id, idx FROM top WHERE doc_id % 13 <> 0 ORDER BY rank LIMIT 1) SELECT x.doc_id, x.idx, x.text FROM hit JOIN chunks x ON x.doc_id = hit.doc_id AND (x.idx BETWEEN hit.idx + 1 AND hit.idx + 8 OR x.idx BETWEEN hit.idx - 2 AND hit.idx - 1)")
def read_on(spark, sf):
    """What follows the best hit, five chunks and then three from the new cursor, and the two before it, in the hit's own snapshot."""
    root = published(spark, sf)
    best = Sn.search(spark, root, QUERY, asked_vector(spark, sf), Se.Options(top_k=10), epoch=1).orderBy("rank").first()
    one, at = Sn.read_on(spark, root, best["cursor"], 5)
    out = one.unionByName(Sn.read_on(spark, root, at, 3)[0]) if at else one
    return out.unionByName(Sn.read_on(spark, root, best["cursor"], 2, back=True)[0]).select("doc_id", "idx", "text")


_KEPT = " WHERE doc_id IN (SELECT doc_id FROM ab WHERE contains(lower(title), 'e') AND day BETWEEN DATE '2024-01-20' AND DATE '2024-06-30')"


@query(f"WITH {_BM25}, {_VEC}, {_LIB}, {_HITS.format(_KEPT, 12, _KEPT.replace(' WHERE doc_id IN (SELECT doc_id FROM ab', '').removesuffix(')'), 4)} SELECT CAST(rank AS INTEGER) AS rank, doc_id, idx, score FROM top")
def search_filtered(spark, sf):
    """Documents by title and date of change, else of creation."""
    import datetime

    f = Se.Filters(title="e", updated_from=datetime.date(2024, 1, 20), updated_to=datetime.date(2024, 6, 30))
    return Se.search(library(spark, sf), QUERY, asked_vector(spark, sf), Se.Options(filters=f)).select("rank", "doc_id", "idx", "score")


@query(f"WITH {_LIB} SELECT doc_id FROM ab WHERE contains(lower(title), '1%_') OR (contains(lower(title), ' 1') AND day >= DATE '2024-02-01')")
def title_filter(spark, sf):
    import datetime

    d = described(spark, sf)
    return Se.allowed(d, Se.Filters(title="1%_")).union(Se.allowed(d, Se.Filters(title=" 1", updated_from=datetime.date(2024, 2, 1)))).distinct()


@query("SELECT doc_id, doc_id % 5 IN (1, 3) AND lang IN ('en', 'de') AS hit FROM documents")
def structure_filter(spark, sf):
    d = docs(spark, sf)
    hit = Se.structure_matches(F.array(F.col("doc_id") % 5), F.array(F.concat(F.lit(" "), F.upper("lang"))), F.array(F.lit("table")), [1, 3], ["en", "De "], ["TABLE"])
    return d.select("doc_id", hit.alias("hit"))


@query(f"""WITH {_BM25}, top AS (SELECT doc_id, idx FROM bm ORDER BY score DESC, doc_id, idx LIMIT 10), r AS (SELECT t.doc_id, t.idx, c.idx AS n, c.text FROM top t JOIN chunks c ON c.doc_id = t.doc_id AND abs(c.idx - t.idx) <= 1 AND c.idx // 4 = t.idx // 4)
SELECT doc_id, idx, min(n) AS first, max(n) AS last, string_agg(CASE WHEN n = idx THEN '>>> ' ELSE '' END || '[part ' || CAST(n // 4 AS VARCHAR) || '] ' || text, chr(10) || chr(10) ORDER BY n) AS evidence FROM r GROUP BY doc_id, idx""")
def evidence_windows(spark, sf):
    """Windows of the ten best chunks, bounded by heading; the budget is large enough for all."""
    from papyra.plans.retrieval import lexical

    w = E.windows(lexical(spark, sf, 10), library(spark, sf).chunks, budget=1_000_000)
    return w.select("doc_id", "idx", "first", "last", "evidence")


@query("SELECT 10::BIGINT AS windows, 0::BIGINT AS over")
def evidence_budget(spark, sf):
    """Of the ten best chunks' windows of 96 tokens none is over the budget."""
    from papyra.plans.retrieval import lexical

    w = E.windows(lexical(spark, sf, 10), library(spark, sf).chunks, radius=3, budget=96, focus=QUERY)
    return w.agg(F.count("*").alias("windows"), F.coalesce(F.sum((F.col("tokens") > 96).cast("long")), F.lit(0)).alias("over"))


_POOL = "pool AS (SELECT v.vec_id AS id, v.score AS rel, e.embedding::DOUBLE[] AS x FROM (SELECT * FROM vec ORDER BY score DESC, vec_id LIMIT 12) v JOIN embeddings e USING (vec_id)), fit AS (SELECT * FROM pool WHERE rel >= 0.6 * (SELECT max(rel) FROM pool))"
_STEPS = ", ".join(
    f"c{i} AS ({'' if i == 1 else f'SELECT * FROM c{i - 1} UNION ALL '}SELECT * FROM (SELECT {i} AS n, id, x FROM fit p WHERE id NOT IN (SELECT id FROM {'(SELECT NULL AS id WHERE false)' if i == 1 else f'c{i - 1}'}) "
    f"ORDER BY 0.75 * rel - 0.25 * {'0' if i == 1 else f'(SELECT max(list_cosine_similarity(p.x, q.x)) FROM c{i - 1} q)'} DESC, id LIMIT 1))"
    for i in range(1, 9)
)


@query(f"WITH {_VEC}, {_POOL}, {_STEPS}, rest AS (SELECT (SELECT count(*) FROM c8) + row_number() OVER (ORDER BY rel DESC, id) AS n, id FROM pool WHERE id NOT IN (SELECT id FROM c8)) SELECT CAST(n AS INTEGER) AS rank, id AS vec_id FROM (SELECT n, id FROM c8 UNION ALL SELECT n, id FROM rest) WHERE n <= 8")
def mmr_diverse(spark, sf):
    """The pool is a fixed number of rows, so the greedy choice runs on the driver."""
    top = vector(spark, sf, 12)
    rows = [(r["vec_id"], r["score"], list(r["embedding"])) for r in top.join(table(spark, sf, "embeddings"), "vec_id").orderBy(F.desc("score"), "vec_id").collect()]
    return spark.createDataFrame([(i, v) for i, v in enumerate(R.mmr(rows, 8), 1)], "rank int, vec_id long")


#: Parts as units with versions 1.0 to 1.50 and four kinds of status.
_UNITS = "u AS (SELECT p_partkey, CASE WHEN p_size % 7 = 0 THEN NULL ELSE p_size END AS v, ['active', 'conflicted', 'superseded', 'deleted'][p_partkey % 4 + 1] AS s FROM part)"
_QUESTIONS = {"now": "what is current", "at": "compare 1.10 and 1.20", "one": "what does 1.30 support", "span": "what was there before 1.25", "any": "red parts"}


def version_units(spark, sf):
    z = F.col("p_size")
    status = F.element_at(F.array(*map(F.lit, ("active", "conflicted", "superseded", "deleted"))), (F.col("p_partkey") % 4 + 1).cast("int"))
    return table(spark, sf, "part").select("p_partkey", F.when(z % 7 != 0, F.concat(F.lit("1."), z.cast("string"))).alias("version"), status.alias("status"))


@query(f"""WITH {_UNITS} SELECT p_partkey, s IN ('active', 'conflicted') AS now, s <> 'deleted' AND CASE WHEN v IS NULL THEN s <> 'superseded' ELSE v IN (10, 20) END AS at, CASE WHEN v IS NULL THEN s = 'active' ELSE s <> 'deleted' AND v = 30 END AS one,
s <> 'deleted' AND (v IS NULL OR v < 25) AS span, s = 'active' AS any FROM u""")
def temporal_visibility(spark, sf):
    return version_units(spark, sf).select("p_partkey", *(C.visible(Q.parse_temporal(q)).alias(n) for n, q in _QUESTIONS.items()))


@query(f"""WITH {_UNITS} SELECT p_partkey, CASE WHEN v IS NULL THEN -0.25::DOUBLE WHEN v = 49 OR v = 48 AND false THEN 6 ELSE -2 END AS now, CASE WHEN v IN (10, 20) THEN 3.5::DOUBLE ELSE 0 END AS at, CASE WHEN v IS NULL THEN -0.5::DOUBLE WHEN v = 30 THEN 8 ELSE 0 END AS one FROM u""")
def temporal_boost(spark, sf):
    u = version_units(spark, sf)
    return u.select("p_partkey", *(C.boost(Q.parse_temporal(_QUESTIONS[n]), "1.49").alias(n) for n in ("now", "at", "one")))


@query(f"WITH {_UNITS} SELECT '1.' || CAST(max(v) AS VARCHAR) AS version FROM u")
def current_version(spark, sf):
    return spark.createDataFrame([(C.current_version(version_units(spark, sf)),)], "version string")


@query("SELECT event_id, CASE WHEN event_id % 4 = 0 THEN false ELSE epoch(date_trunc('second', ts))::BIGINT >= 1704499200 AND epoch(date_trunc('second', ts))::BIGINT < 1705276800 END AS inside FROM events")
def time_range(spark, sf):
    """Events published (else in effect) since 2024-01-06 and before 2024-01-15; every fourth has no time."""
    a, b = Q.parse_range("since 2024-01-06"), Q.parse_range("before 2024-01-15")
    seconds = F.unix_timestamp("ts")
    e = table(spark, sf, "events").select("event_id", F.when(F.col("event_id") % 2 == 1, seconds).otherwise(0).alias("published"), F.when(F.col("event_id") % 4 != 0, seconds).alias("effective"))
    at = F.coalesce(F.nullif("published", F.lit(0)), "effective")
    inside = (at >= F.lit(a.start)) & (at < F.lit(b.end))
    return e.select("event_id", F.coalesce(inside, F.lit(False)).alias("inside"))


@query("""WITH e AS (SELECT doc_id, doc_id % 5 AS chunk, text, n_chars % 100 / 10.0 AS score FROM documents UNION ALL SELECT doc_id, doc_id % 5, text, 3.5 FROM documents WHERE doc_id % 2 = 0 UNION ALL SELECT doc_id, NULL, text, 1.0 FROM documents UNION ALL SELECT doc_id, NULL, text, 2.0 FROM documents)
SELECT doc_id, chunk, round(max(score)::DOUBLE, 6) AS score FROM e WHERE trim(coalesce(text, '')) <> '' GROUP BY doc_id, chunk, CASE WHEN chunk IS NULL THEN sha256(text) END""")
def evidence_dedup(spark, sf):
    d = docs(spark, sf)
    part = lambda c, s: d.select("doc_id", c.cast("long").alias("chunk"), F.lit("t").alias("title"), F.lit("h").alias("heading"), "text", s.cast("double").alias("score"), F.lit(None).cast("string").alias("version"))
    i, none = F.col("doc_id"), F.lit(None)
    e = part(i % 5, F.col("n_chars") % 100 / 10).union(part(i % 5, F.lit(3.5)).filter("doc_id % 2 = 0")).union(part(none, F.lit(1.0))).union(part(none, F.lit(2.0)))
    return C.distinct_evidence(e).select("doc_id", "chunk", F.round("score", 6).alias("score"))


@query("""WITH e AS (SELECT p_partkey, CASE WHEN p_size % 7 = 0 THEN NULL ELSE p_size END AS v FROM part) SELECT p_partkey, CASE WHEN v = 30 THEN 9.0::DOUBLE ELSE 0.7::DOUBLE END AS score FROM e WHERE v = 30 OR v IS NULL""")
def temporal_evidence(spark, sf):
    e = version_units(spark, sf).select("p_partkey", "version", F.lit(1.0).alias("score"))
    return C.temporal_evidence(e, Q.parse_temporal("what does 1.30 support"), None).select("p_partkey", "score")


@query("SELECT 'fact' AS intent, true AS within, true AS evidence, true AS orientation UNION ALL SELECT 'global', true, true, true UNION ALL SELECT 'multi_hop', true, true, true")
def context_package(spark, sf):
    """Three questions of different intent, each compiled under 1000 tokens: does the text keep the budget and hold evidence and orientation?"""
    units, relations = compiled(spark, sf)
    lib = library(spark, sf)
    hits = Se.search(lib, QUERY, asked_vector(spark, sf))
    e = Se.with_evidence(lib, hits, QUERY).select("doc_id", F.col("idx").alias("chunk"), "title", F.lit("").alias("heading"), F.col("evidence").alias("text"), "score", F.lit(None).cast("string").alias("version")).persist()
    rows = []
    for q in ("en texts page", "summarize the en texts", "why does the fr texts page cause it"):
        p = C.compile_context(units, relations, e, q, 1000)
        rows.append((p.intent, p.tokens <= 1000, bool(p.evidence), bool(p.sections.get("orientation") or p.sections.get("concepts"))))
    e.unpersist()
    return spark.createDataFrame(rows, "intent string, within boolean, evidence boolean, orientation boolean")
