"""Queries on texts, chunks and pages."""

from __future__ import annotations

from pyspark.sql import Window

from papyra.functions import text as X
from papyra.plans.catalogue import CHUNKS, F, both, docs, query, table
from papyra.sources.html import pages_to_text
from papyra.sources.chunker import embedded, semantic_chunks, smart_chunks
from papyra.sources.tables import chunks

_CJK = r"\x{3040}-\x{30ff}\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}\x{ac00}-\x{d7af}"
_EST = rf"""CASE WHEN length(text) = 0 THEN 0 ELSE greatest(1, CAST(ceil(length(regexp_replace(text, '[^{_CJK}]', '', 'g')) / 1.5::DOUBLE
 + (length(text) - length(regexp_replace(text, '[^{_CJK}]', '', 'g'))) / 4.0::DOUBLE) AS BIGINT)) END"""
_NORM = r"regexp_replace(regexp_replace(regexp_replace(text, '\r\n?', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')"
_PROTECTED = "text"
for _one in (r"(\p{Nd})\.(\p{Nd})", r"(\p{L})\.(\p{L})"):
    for _ in range(2):  # matches that share a letter are found by a second pass
        _PROTECTED = rf"regexp_replace({_PROTECTED}, '{_one}', '\1' || chr(1) || '\2', 'g')"
_SENT = rf"list_filter(list_transform(string_split_regex({_PROTECTED}, '[.!?。！？\n]'), lambda s: replace(trim(s), chr(1), '.')), lambda s: s <> '')"


@query(f"SELECT doc_id, CAST({_EST} AS BIGINT) AS tokens FROM documents")
def token_estimate(spark, sf):
    return docs(spark, sf).select("doc_id", X.token_estimate(F.col("text")).alias("tokens"))


@query(f"SELECT doc_id, round(CASE WHEN length(text) = 0 THEN 1.0::DOUBLE ELSE length(text)::DOUBLE / ({_EST}) END, 6) AS ratio FROM documents")
def chars_per_token(spark, sf):
    t = F.col("text")
    return docs(spark, sf).select("doc_id", F.round(F.when(F.length(t) == 0, 1.0).otherwise(F.length(t).cast("double") / X.token_estimate(t)), 6).alias("ratio"))


@query(f"SELECT doc_id, CAST(length({_NORM}) AS BIGINT) AS n, sha256({_NORM}) AS hash FROM documents")
def normalize_text(spark, sf):
    n = X.normalize(F.col("text"))
    return docs(spark, sf).select("doc_id", F.length(n).cast("long").alias("n"), F.sha2(n, 256).alias("hash"))


@query("SELECT doc_id, sha256(text) AS hash FROM documents")
def content_hash(spark, sf):
    return docs(spark, sf).select("doc_id", F.sha2("text", 256).alias("hash"))


@query(f"WITH {CHUNKS} SELECT doc_id, idx, substr(sha256(CAST(doc_id AS VARCHAR) || chr(0) || 'paragraph' || chr(0) || CAST(idx AS VARCHAR)), 1, 32) AS node_id FROM chunks")
def node_ids(spark, sf):
    return chunks(docs(spark, sf)).select("doc_id", "idx", X.stable_id(F.col("doc_id"), F.lit("paragraph"), F.col("idx")).alias("node_id"))


@query("""WITH t AS (SELECT doc_id, regexp_extract_all(lower(text), '([a-z0-9_]{2,})', 1) AS t FROM documents)
SELECT doc_id, CAST(len(t) AS BIGINT) AS n, CAST(len(list_distinct(t)) AS BIGINT) AS n_distinct, sha256(array_to_string(t, ' ')) AS hash FROM t""")
def tokenize_terms(spark, sf):
    t = docs(spark, sf).select("doc_id", X.terms(F.col("text")).alias("t"))
    return t.select("doc_id", F.size("t").cast("long").alias("n"), F.size(F.array_distinct("t")).cast("long").alias("n_distinct"), F.sha2(F.array_join("t", " "), 256).alias("hash"))


@query(f"WITH s AS (SELECT doc_id, {_SENT} AS s FROM documents) SELECT doc_id, CAST(len(s) AS BIGINT) AS n, sha256(array_to_string(s, '|')) AS hash FROM s")
def sentence_split(spark, sf):
    s = docs(spark, sf).select("doc_id", X.sentences(F.col("text")).alias("s"))
    return s.select("doc_id", F.size("s").cast("long").alias("n"), F.sha2(F.array_join("s", "|"), 256).alias("hash"))


@query(r"""WITH t AS (SELECT conv_id, turn, list_filter(regexp_extract_all(text, '[A-Za-z0-9_-]+'), lambda x: length(x) BETWEEN 3 AND 64 AND regexp_matches(x, '[0-9]')) AS t FROM conversations)
SELECT conv_id, turn, array_to_string(t, ' ') AS identifiers FROM t""")
def strict_identifiers(spark, sf):
    t = F.regexp_extract_all("text", F.lit("([A-Za-z0-9_-]+)"), 1)
    found = F.filter(t, lambda x: F.length(x).between(3, 64) & x.rlike("[0-9]"))
    return table(spark, sf, "conversations").select("conv_id", "turn", F.array_join(found, " ").alias("identifiers"))


@query("""WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '([a-z]{4,})', 1)) AS w FROM documents),
c AS (SELECT doc_id, w, count(*) AS n FROM w GROUP BY ALL HAVING count(*) > 1)
SELECT doc_id, w AS word, n, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, w) AS INTEGER) AS rank FROM c
QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, w) <= 8""")
def key_concepts_top8(spark, sf):
    w = docs(spark, sf).select("doc_id", F.explode(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]{4,})"), 1)).alias("word"))
    n = w.groupBy("doc_id", "word").agg(F.count("*").alias("n")).filter("n > 1")
    return n.withColumn("rank", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("n"), "word"))).filter("rank <= 8")


@query("SELECT doc_id, CASE WHEN length(text) > 280 THEN left(text, 280) || '…' ELSE text END AS summary FROM documents")
def summary_clip(spark, sf):
    return docs(spark, sf).select("doc_id", X.clip(F.col("text"), 280).alias("summary"))


@query("SELECT page_id, trim(regexp_replace(regexp_extract(html, '<title[^>]*>([^<]*)</title>', 1), '\\s+', ' ', 'g')) AS title FROM pages")
def html_title(spark, sf):
    t = F.regexp_extract("html", "<title[^>]*>([^<]*)</title>", 1)
    return table(spark, sf, "pages").select("page_id", F.trim(F.regexp_replace(t, r"\s+", " ")).alias("title"))


@query("SELECT page_id, sha256(regexp_replace(html, '<[^>]*>', '', 'g')) AS hash FROM pages")
def html_strip(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.sha2(F.regexp_replace("html", "<[^>]*>", ""), 256).alias("hash"))


@query()
def html_to_text(spark, sf):
    return pages_to_text(table(spark, sf, "pages"))


@query(f"WITH {CHUNKS} SELECT doc_id, idx, text, sha256(text) AS hash FROM chunks")
def chunk_delimiter(spark, sf):
    return chunks(docs(spark, sf)).withColumn("hash", F.sha2("text", 256)).drop("source")


@query(f"""WITH {CHUNKS}, m AS (SELECT *, length(regexp_replace(text, '[^\\p{{L}}\\p{{Nd}}]', '', 'g')) >= 10 AS healthy FROM chunks),
i AS (SELECT *, greatest(1, sum(healthy::INT) OVER (PARTITION BY doc_id ORDER BY idx)) AS island FROM m)
SELECT doc_id, CAST(island AS BIGINT) AS island, count(*) AS pieces, string_agg(text, chr(10) ORDER BY idx) AS text FROM i GROUP BY doc_id, island""")
def chunk_hygiene(spark, sf):
    """Pieces with under ten letters and digits join the healthy one before them, at the start the one after."""
    healthy = (X.meaningful(F.col("text")) >= 10).cast("long")
    m = chunks(docs(spark, sf)).withColumn("island", F.greatest(F.lit(1).cast("long"), F.sum(healthy).over(Window.partitionBy("doc_id").orderBy("idx"))))
    g = m.groupBy("doc_id", "island").agg(F.count("*").alias("pieces"), F.sort_array(F.collect_list(F.struct("idx", "text"))).alias("t"))
    return g.select("doc_id", "island", "pieces", F.array_join(F.col("t.text"), "\n").alias("text"))


@query(f"""WITH {CHUNKS} SELECT doc_id, sha256(string_agg(text, chr(10) ORDER BY idx)) AS hash, count(*) AS nodes FROM chunks GROUP BY doc_id""")
def searchable_projection(spark, sf):
    g = chunks(docs(spark, sf)).groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("idx", "text"))).alias("t"), F.count("*").alias("nodes"))
    return g.select("doc_id", F.sha2(F.array_join(F.col("t.text"), "\n"), 256).alias("hash"), "nodes")


@query("SELECT doc_id, idx, trim('doc-' || CAST(doc_id AS VARCHAR) || ' ' || text) AS search_text FROM (WITH " + CHUNKS + " SELECT * FROM chunks)")
def retrieval_text(spark, sf):
    return chunks(docs(spark, sf)).select("doc_id", "idx", F.trim(F.concat(F.lit("doc-"), F.col("doc_id").cast("string"), F.lit(" "), F.col("text"))).alias("search_text"))


_Q = """WITH l AS (SELECT doc_id, text, list_transform(string_split(text, chr(10)), lambda x: length(trim(x))) AS n, length(text) AS chars,
 length(text) - length(replace(text, chr(65533), '')) AS bad, length(regexp_replace(text, '[^\\p{L}\\p{Nd}]', '', 'g')) AS alnum FROM documents),
m AS (SELECT doc_id, chars, round(bad::DOUBLE / greatest(chars, 1), 6) AS replacement_ratio, round(alnum::DOUBLE / greatest(chars, 1), 6) AS alnum_ratio,
 list_sort(list_filter(n, lambda x: x > 0)) AS n FROM l)
SELECT doc_id, CAST(chars AS BIGINT) AS chars, replacement_ratio, alnum_ratio, CAST(coalesce(n[len(n) // 2 + 1], 0) AS BIGINT) AS median_line,
 round(coalesce(list_sum(n)::DOUBLE / len(n), 0), 6) AS mean_line FROM m"""


@query(_Q)
def text_health(spark, sf):
    """Character ratios and line lengths; the median of an even number of lines is the upper one."""
    t, chars = F.col("text"), F.length("text")
    n = F.array_sort(F.filter(F.transform(F.split(t, "\n"), lambda x: F.length(F.trim(x))), lambda x: x > 0))
    m = docs(spark, sf).select("doc_id", chars.alias("chars"), t, n.alias("n"))
    ratio = lambda x: F.round(x.cast("double") / F.greatest(F.col("chars"), F.lit(1)), 6)
    total = F.aggregate("n", F.lit(0), lambda s, x: s + x)
    return m.select(
        "doc_id",
        F.col("chars").cast("long").alias("chars"),
        ratio(F.col("chars") - F.length(F.replace(t, F.lit("�"), F.lit("")))).alias("replacement_ratio"),
        ratio(X.meaningful(t)).alias("alnum_ratio"),
        F.coalesce(F.get("n", F.expr("cast(size(n) div 2 as int)")), F.lit(0)).cast("long").alias("median_line"),
        F.round(F.when(F.size("n") > 0, total / F.size("n")).otherwise(0.0), 6).alias("mean_line"),
    )


@query()
def chunk_smart(spark, sf):
    return smart_chunks(docs(spark, sf))


@query()
def chunk_refined(spark, sf):
    """Smart pieces of at most 256 tokens where separators allow it."""
    return smart_chunks(docs(spark, sf), limit=256)


@query()
def semantic_merge(spark, sf):
    return semantic_chunks(docs(spark, sf))


@query("""WITH u AS (SELECT sha256(text) AS h FROM documents WHERE text IS NOT NULL) SELECT h AS text_hash, count(*) AS chunks, 1.0::DOUBLE AS norm FROM u GROUP BY h""")
def embedding_ingest(spark, sf):
    """Every distinct text is embedded once and its vector has length 1."""
    whole = docs(spark, sf).filter(F.col("text").isNotNull()).select("doc_id", F.lit(0).cast("long").alias("idx"), "text")
    none = spark.createDataFrame([], "text_hash string, model string, vector array<double>")
    norm = F.round(F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x)), 6)
    return embedded(whole, none).groupBy("text_hash").agg(F.count("*").alias("chunks"), F.max(norm).alias("norm"))


# a page captured again under its URL is a refresh if its content is another
both(
    "url_refresh_changed",
    """SELECT page_id, url FROM (SELECT page_id, url, md5(html) AS h, lag(md5(html)) OVER (PARTITION BY url ORDER BY page_id) AS earlier FROM {pages}) AS p
WHERE earlier IS NULL OR earlier <> h""",
)
both("pages_per_host", "SELECT split_part(split_part(url, '://', 2), '/', 1) AS host, count(*) AS pages, CAST(sum(length(html)) AS BIGINT) AS chars FROM {pages} GROUP BY 1")
