"""Queries of the scalar functions: each function over a table, and the same rule in SQL.

Where a table's texts lack what a rule is about (CJK characters, digits, replacement signs), both sides write it in by
the same translation of letters.
"""

from __future__ import annotations

from papyra.functions import dictionary as D
from papyra.functions import language as L
from papyra.functions import quality as Q
from papyra.functions import text as X
from papyra.plans.catalogue import CHUNKS, F, docs, query, table
from papyra.sources.tables import chunks

#: Letters of a text written as characters of other kinds, so rules about those have work to do.
_FROM, _TO = "aeiouqz", "知识库0 7-"
_HAN = "㐀-䶿一-鿿"


def asked(spark, sf):
    """Turns of conversations as questions, some of their letters in Han and digits: (conv_id, turn, q)."""
    return table(spark, sf, "conversations").select("conv_id", "turn", F.translate("text", _FROM, _TO).alias("q"))


_ASKED = f"asked AS (SELECT conv_id, turn, translate(text, '{_FROM}', '{_TO}') AS q FROM conversations)"


def _list(c):
    return F.array_join(c, "|")


def _grams(run: str, n: int) -> str:
    return f"list_transform(generate_series(1, length({run}) - {n - 1}), lambda i: substr({run}, CAST(i AS BIGINT), {n}))"


@query(rf"""WITH {_ASKED}, t AS (SELECT conv_id, turn, unnest(regexp_extract_all(q, '[\p{{L}}\p{{N}}_]+')) AS t FROM asked),
r AS (SELECT conv_id, turn, unnest(regexp_extract_all(t, '[\p{{Han}}\p{{Hiragana}}\p{{Katakana}}]+|[^\p{{Han}}\p{{Hiragana}}\p{{Katakana}}]+')) AS r FROM t),
g AS (SELECT conv_id, turn, unnest(CASE WHEN regexp_matches(r, '^[\p{{Han}}\p{{Hiragana}}\p{{Katakana}}]') AND length(r) > 3 THEN {_grams("r", 3)} WHEN length(r) >= 3 THEN [r] ELSE [] END) AS g FROM r),
d AS (SELECT DISTINCT conv_id, turn, g FROM g), n AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY g) AS n FROM d QUALIFY n <= 64),
j AS (SELECT conv_id, turn, string_agg(g, '|' ORDER BY g) AS terms FROM n GROUP BY conv_id, turn)
SELECT a.conv_id, a.turn, coalesce(terms, '') AS terms, array_to_string(list_filter(regexp_extract_all(q, '[\p{{L}}\p{{N}}_]+'), lambda x: length(x) < 3 AND regexp_matches(x, '\p{{Nd}}')), '|') AS locators
FROM asked a LEFT JOIN j USING (conv_id, turn)""")
def lexical_query_terms(spark, sf):
    return asked(spark, sf).select("conv_id", "turn", _list(L.lexical_terms(F.col("q"))).alias("terms"), _list(L.locator_terms(F.col("q"))).alias("locators"))


@query(rf"""WITH {_ASKED}, t AS (SELECT conv_id, turn, list_transform(regexp_extract_all(lower(q), '\p{{Han}}+|[^\p{{Han}}\P{{L}}]+(?:[^\p{{Han}}\P{{L}}]|\p{{Nd}})*|\p{{Nd}}(?:[^\p{{Han}}\P{{L}}]|\p{{Nd}})*'), lambda x: x) AS r FROM asked),
e AS (SELECT conv_id, turn, i, r[i] AS r FROM (SELECT *, unnest(generate_series(1, len(r))) AS i FROM t)),
g AS (SELECT conv_id, turn, i, CASE WHEN regexp_matches(r, '^\p{{Han}}') THEN CASE WHEN length(r) = 1 THEN [r] ELSE {_grams("r", 2)} END WHEN length(r) >= 2 THEN [r] ELSE [] END AS g FROM e),
x AS (SELECT conv_id, turn, i, j, g[j] AS t FROM (SELECT *, unnest(generate_series(1, len(g))) AS j FROM g)),
f AS (SELECT conv_id, turn, t, min((i, j)) AS ord_ FROM x GROUP BY conv_id, turn, t)
SELECT a.conv_id, a.turn, coalesce(string_agg(t, '|' ORDER BY ord_), '') AS terms FROM asked a LEFT JOIN f USING (conv_id, turn) GROUP BY a.conv_id, a.turn""")
def semantic_search_terms(spark, sf):
    return asked(spark, sf).select("conv_id", "turn", _list(L.search_terms(F.col("q"))).alias("terms"))


@query(rf"""WITH {_ASKED}, t AS (SELECT conv_id, turn, regexp_extract_all(lower(q), '[^\x00-\x7F]?[a-z0-9_]+[^\x00-\x7F]?|[^\x00-\x7F]{{2}}') AS r FROM asked),
x AS (SELECT conv_id, turn, i, r[i] AS t FROM (SELECT *, unnest(generate_series(1, len(r))) AS i FROM t)),
f AS (SELECT conv_id, turn, t, min(i) AS ord_ FROM x WHERE length(t) > 1 GROUP BY conv_id, turn, t)
SELECT a.conv_id, a.turn, coalesce(string_agg(t, '|' ORDER BY ord_), '') AS terms FROM asked a LEFT JOIN f USING (conv_id, turn) GROUP BY a.conv_id, a.turn""")
def schema_query_terms(spark, sf):
    return asked(spark, sf).select("conv_id", "turn", _list(L.schema_terms(F.col("q"))).alias("terms"))


_STOP = "['" + "','".join(L.STOPWORDS) + "']"
_GENERIC = "['" + "','".join(L.GENERIC_PAIRS) + "']"
_KEYWORDS = rf"""{_ASKED}, sg AS (SELECT conv_id, turn, regexp_extract_all(q, '[A-Za-z0-9一-鿿]+') AS s FROM asked),
e AS (SELECT conv_id, turn, i, s[i] AS s FROM (SELECT *, unnest(generate_series(1, len(s))) AS i FROM sg)),
g AS (SELECT conv_id, turn, i, CASE WHEN NOT regexp_matches(s, '^[A-Za-z0-9]+$') THEN {_grams("s", 2)} WHEN length(s) >= 2 AND NOT list_contains({_STOP}, lower(s)) THEN [lower(s)] ELSE [] END AS g FROM e),
x AS (SELECT conv_id, turn, i, j, g[j] AS t FROM (SELECT *, unnest(generate_series(1, len(g))) AS j FROM g)),
f AS (SELECT conv_id, turn, t, min((i, j)) AS ord_ FROM x GROUP BY conv_id, turn, t)"""


@query(rf"""WITH {_KEYWORDS} SELECT a.conv_id, a.turn, coalesce(string_agg(t, '|' ORDER BY ord_), '') AS keywords, coalesce(string_agg(t, '|' ORDER BY ord_) FILTER (NOT list_contains({_GENERIC}, t)), '') AS topic
FROM asked a LEFT JOIN f USING (conv_id, turn) GROUP BY a.conv_id, a.turn""")
def auto_keywords(spark, sf):
    return asked(spark, sf).select("conv_id", "turn", _list(L.keywords(F.col("q"))).alias("keywords"), _list(L.topic_keywords(F.col("q"))).alias("topic"))


@query(rf"""WITH {_KEYWORDS}, k AS (SELECT conv_id, turn, list(t) AS ks FROM f GROUP BY conv_id, turn), n AS (SELECT *, lead(q) OVER (PARTITION BY conv_id ORDER BY turn) AS answer FROM asked)
SELECT n.conv_id, n.turn, coalesce(len(ks), 0) = 0 OR len(list_filter(ks, lambda k: contains(lower(answer), k))) > 0 AS shares FROM n LEFT JOIN k USING (conv_id, turn) WHERE answer IS NOT NULL""")
def keyword_gate(spark, sf):
    from pyspark.sql import Window

    n = asked(spark, sf).withColumn("answer", F.lead("q").over(Window.partitionBy("conv_id").orderBy("turn"))).filter("answer is not null")
    return n.select("conv_id", "turn", L.shares_keywords(F.col("answer"), L.keywords(F.col("q"))).alias("shares"))


#: Texts about parts, with numbers and codes to be found.
_CODED = "coded AS (SELECT p_partkey, 'Part ' || CAST(900000 + p_partkey AS VARCHAR) || ' (' || p_brand || '), code AB-' || CAST(p_size AS VARCHAR) || '/x_' || CAST(p_partkey AS VARCHAR) || ' see www.p' || CAST(p_size AS VARCHAR) || '.com or ' || p_name || '1234567' || p_type AS t FROM part)"


def coded(spark, sf):
    k, z = F.col("p_partkey"), F.col("p_size").cast("string")
    parts = ["Part ", (k + 900000).cast("string"), " (", F.col("p_brand"), "), code AB-", z, "/x_", k.cast("string"), " see www.p", z, ".com or ", F.col("p_name"), "1234567", F.col("p_type")]
    return table(spark, sf, "part").select("p_partkey", F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts)).alias("t"))


@query(rf"""WITH {_CODED}, m AS (SELECT p_partkey, t, list_concat(list_transform(regexp_extract_all(t, '(?:^|[^A-Za-z0-9_])[0-9]{{6,32}}(?:$|[^A-Za-z0-9_])'), lambda x: regexp_extract(x, '[0-9]+')),
 list_filter(regexp_extract_all(t, '[A-Za-z0-9][A-Za-z0-9._:/-]*[A-Za-z0-9]'), lambda x: length(x) BETWEEN 3 AND 64 AND regexp_matches(x, '[0-9]') AND NOT regexp_matches(lower(x), '^(https?://|ftp://|www[.])'))) AS l FROM coded),
x AS (SELECT p_partkey, i, l[i] AS v FROM (SELECT *, unnest(generate_series(1, len(l))) AS i FROM m)), f AS (SELECT p_partkey, lower(v) AS k, arg_min(v, i) AS v, min(i) AS i FROM x GROUP BY p_partkey, lower(v))
SELECT p_partkey, string_agg(v, '|' ORDER BY i) AS ids FROM f GROUP BY p_partkey""")
def identifier_list(spark, sf):
    return coded(spark, sf).select("p_partkey", _list(L.strict_identifiers(F.col("t"))).alias("ids"))


@query(rf"""WITH {_CODED} SELECT p_partkey, regexp_matches(lower(t), '(^|[^a-z0-9_])ab-' || CAST(p_partkey % 7 AS VARCHAR) || '([^a-z0-9_]|$)') AS code, regexp_matches(lower(t), '(^|[^a-z0-9_])1234567([^a-z0-9_]|$)') AS inside FROM coded""")
def identifier_containment(spark, sf):
    t = F.col("t")
    return coded(spark, sf).select("p_partkey", L.contains_identifier(t, F.concat(F.lit("AB-"), (F.col("p_partkey") % 7).cast("string"))).alias("code"), L.contains_identifier(t, F.lit("1234567")).alias("inside"))


@query(rf"""WITH {_CODED}, s AS (SELECT p_partkey, t, list_filter(list_transform(regexp_extract_all(t, '[A-Za-z0-9]+'), lambda s: CASE WHEN length(s) >= 2 AND NOT list_contains({_STOP}, lower(s)) THEN lower(s) ELSE '' END), lambda s: s <> '') AS p FROM coded),
i AS (SELECT p_partkey, t, list_concat(list_transform(regexp_extract_all(t, '(?:^|[^A-Za-z0-9_])[0-9]{{6,32}}(?:$|[^A-Za-z0-9_])'), lambda x: regexp_extract(x, '[0-9]+')),
 list_filter(regexp_extract_all(t, '[A-Za-z0-9][A-Za-z0-9._:/-]*[A-Za-z0-9]'), lambda x: length(x) BETWEEN 3 AND 64 AND regexp_matches(x, '[0-9]') AND NOT regexp_matches(lower(x), '^(https?://|ftp://|www[.])'))) AS l FROM coded),
x AS (SELECT p_partkey, i, l[i] AS v FROM (SELECT *, unnest(generate_series(1, len(l))) AS i FROM i)), f AS (SELECT p_partkey, lower(v) AS k, arg_min(v, i) AS v, min(i) AS i FROM x GROUP BY p_partkey, lower(v)),
j AS (SELECT f.p_partkey, list(v ORDER BY i) AS more FROM f JOIN s USING (p_partkey) WHERE NOT list_contains(p, k) GROUP BY f.p_partkey), q AS (SELECT s.p_partkey, array_to_string(list_concat(p, coalesce(more, [])), ' ') AS q FROM s LEFT JOIN j USING (p_partkey))
SELECT p_partkey, CASE WHEN length(q) <= 60 THEN q ELSE left(q, 36) || ' ' || right(q, 23) END AS q FROM q""")
def cleaned_query(spark, sf):
    return coded(spark, sf).select("p_partkey", L.clean_query(F.col("t"), 60).alias("q"))


_TOK = "CASE WHEN length(text) = 0 THEN 0 ELSE greatest(1, ceil(length(regexp_replace(text, '[^぀-ヿ㐀-䶿一-鿿가-힯]', '', 'g')) / 1.5::DOUBLE + length(regexp_replace(text, '[぀-ヿ㐀-䶿一-鿿가-힯]', '', 'g')) / 4.0::DOUBLE)) END"


@query(f"""WITH d AS (SELECT doc_id, translate(text, 'ae', '知识') AS text FROM documents), n AS (SELECT *, CAST({_TOK} AS BIGINT) AS n FROM d)
SELECT doc_id, CASE WHEN n <= 50 THEN text ELSE left(text, CAST(floor(CAST(length(text) AS DOUBLE) / n * 50) AS BIGINT)) END AS clipped FROM n""")
def token_clip(spark, sf):
    d = docs(spark, sf).select("doc_id", F.translate("text", "ae", "知识").alias("text"))
    return d.select("doc_id", L.clip_to_tokens(F.col("text"), 50).alias("clipped"))


@query(f"""WITH d AS (SELECT doc_id, translate(text, 'ae', '知识') AS text FROM documents), n AS (SELECT *, {_TOK} AS n FROM d),
h AS (SELECT doc_id, text, n, list_max(list_filter(generate_series(0, least(81, length(text))), lambda h: 8 * length(regexp_replace(left(text, h), '[^一-鿿]', '', 'g')) + 3 * length(regexp_replace(left(text, h), '[一-鿿]', '', 'g')) <= 240)) AS h FROM n)
SELECT doc_id, CASE WHEN n <= 20 THEN text ELSE regexp_replace(left(text, h), '^\\s+|\\s+$', '', 'g') END AS fitted FROM h""")
def token_fit(spark, sf):
    d = docs(spark, sf).select("doc_id", F.translate("text", "ae", "知识").alias("text"))
    return d.select("doc_id", L.fit_to_tokens(F.col("text"), 20).alias("fitted"))


@query("SELECT doc_id, CASE WHEN length(trim(text)) <= 90 THEN trim(text) ELSE left(trim(text), 54) || ' ' || right(trim(text), 35) END AS q FROM documents")
def query_bound(spark, sf):
    return docs(spark, sf).select("doc_id", L.bound_query(F.col("text"), 90).alias("q"))


@query(r"""WITH t AS (SELECT doc_id, translate(trim(regexp_replace(replace(text, 'e', '['), '\s+', ' ', 'g')), '[]', '()') AS t FROM documents) SELECT doc_id, CASE WHEN length(t) > 200 THEN left(t, 197) || '...' ELSE t END AS label FROM t""")
def label_sanitize(spark, sf):
    return docs(spark, sf).select("doc_id", L.safe_label(F.replace("text", F.lit("e"), F.lit("["))).alias("label"))


@query("SELECT event_id, round(abs(value) / (abs(value) + 1), 6) AS score FROM events")
def score_squash(spark, sf):
    return table(spark, sf, "events").select("event_id", F.round(L.squash(F.abs("value")), 6).alias("score"))


_CJK_TEXT = "d AS (SELECT doc_id, translate(text, 'aeiout', '知识库本 ' || chr(65533)) AS t FROM documents)"


def _mixed(spark, sf):
    return docs(spark, sf).select("doc_id", F.translate("text", "aeiout", "知识库本 �").alias("t"))


#: Without look-around: a space folds after each pass of non-overlapping pairs, so three passes fold all.
_FOLD = "t"
for _ in range(3):
    _FOLD = rf"regexp_replace({_FOLD}, '([{_HAN}])[ \t]+([{_HAN}])', '\1\2', 'g')"


@query(f"WITH {_CJK_TEXT} SELECT doc_id, {_FOLD} AS folded, round(length(regexp_replace(t, '[^a-zA-Z0-9{_HAN}]', '', 'g')) / CAST(length(t) AS DOUBLE), 6) AS useful FROM d WHERE t <> ''")
def ocr_spaces(spark, sf):
    return _mixed(spark, sf).filter("t <> ''").select("doc_id", L.fold_cjk_spaces(F.col("t")).alias("folded"), F.round(L.useful_ratio(F.col("t")), 6).alias("useful"))


@query(f"WITH {_CJK_TEXT} SELECT doc_id, replace(t, chr(65533), '') AS clean FROM d")
def replacement_strip(spark, sf):
    return _mixed(spark, sf).select("doc_id", L.without_replacements(F.col("t")).alias("clean"))


_PROJECT = "t"
for _ in range(2):
    _PROJECT = rf"regexp_replace({_PROJECT}, '(\p{{L}})\x{{FFFD}}(\p{{L}})', '\1 \2', 'g')"


@query(rf"WITH {_CJK_TEXT} SELECT doc_id, regexp_replace(regexp_replace({_PROJECT}, '\x{{FFFD}}', '', 'g'), '^\s+|\s+$', '', 'g') AS said FROM d")
def projection_text(spark, sf):
    return _mixed(spark, sf).select("doc_id", L.projection(F.col("t")).alias("said"))


@query(r"""WITH l AS (SELECT doc_id, unnest(string_split(replace(translate(text, 'qz', '|' || chr(9)), 'y', ' | '), chr(10))) AS l FROM documents), t AS (SELECT doc_id, regexp_replace(l, '^\s+|\s+$', '', 'g') AS t FROM l),
c AS (SELECT doc_id, t, CASE WHEN contains(t, '|') THEN list_filter(list_transform(string_split(t, '|'), lambda x: trim(x)), lambda x: x <> '') WHEN contains(t, chr(9)) THEN list_filter(list_transform(string_split(t, chr(9)), lambda x: trim(x)), lambda x: x <> '') END AS c FROM t)
SELECT doc_id, count(*) FILTER (len(c) >= 2) AS table_rows, coalesce(sum(len(c)), 0)::BIGINT AS cells, round(avg(length(t)) FILTER (t <> ''), 6) AS line FROM c GROUP BY doc_id""")
def table_row_split(spark, sf):
    t = F.replace(F.translate("text", "qz", "|\t"), F.lit("y"), F.lit(" | "))
    lines = docs(spark, sf).select("doc_id", F.explode(F.split(t, "\n")).alias("l"))
    c = lines.select("doc_id", L.table_cells(F.col("l")).alias("c"), F.length(F.regexp_replace("l", r"^\s+|\s+$", "")).alias("n"))
    return c.groupBy("doc_id").agg(F.count(F.when(F.size("c") >= 2, 1)).alias("table_rows"), F.coalesce(F.sum(F.when(F.col("c").isNotNull(), F.size("c"))), F.lit(0)).cast("long").alias("cells"), F.round(F.avg(F.when(F.col("n") > 0, F.col("n"))), 6).alias("line"))


@query("""SELECT source, CAST(to_json(list(DISTINCT lang ORDER BY lang) FILTER (lang IS NOT NULL)) AS VARCHAR) AS langs FROM documents GROUP BY source""")
def json_lists(spark, sf):
    return docs(spark, sf).groupBy("source").agg(L.json_list(F.array_sort(F.collect_set("lang"))).alias("langs"))


@query("SELECT event_id, props->>'k' AS k FROM events")
def json_maps(spark, sf):
    return table(spark, sf, "events").select("event_id", L.from_json_map(F.col("props"))["k"].alias("k"))


@query(r"SELECT page_id, lower(trim(regexp_replace(html, '\s+', ' ', 'g'))) AS id FROM pages")
def identifier_normalize(spark, sf):
    return table(spark, sf, "pages").select("page_id", L.identifier(F.col("html")).alias("id"))


# --- quality ------------------------------------------------------------
_DAMAGED = f"damaged AS (SELECT doc_id, doc_id % 4 AS pages, translate(text, CASE WHEN doc_id % 3 = 0 THEN 'ea' WHEN doc_id % 5 = 0 THEN ' e' ELSE '' END, CASE WHEN doc_id % 3 = 0 THEN chr(65533) || '知' WHEN doc_id % 5 = 0 THEN chr(10) || 'e' ELSE '' END) AS t FROM documents)"


def damaged(spark, sf):
    i = F.col("doc_id")
    t = F.when(i % 3 == 0, F.translate("text", "ea", "�知")).when(i % 5 == 0, F.translate("text", " e", "\ne")).otherwise(F.col("text"))
    return docs(spark, sf).select("doc_id", (i % 4).alias("pages"), t.alias("t"))


_MEASURES = rf"""{_DAMAGED}, dl AS (SELECT doc_id, pages, t, list_filter(list_transform(string_split(t, chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS l FROM damaged),
dm AS (SELECT doc_id, pages, t, l, array_to_string(l, '') AS b, list_sort(list_transform(l, lambda x: length(x))) AS z FROM dl),
m AS (SELECT doc_id, pages, length(b) AS chars, CASE WHEN length(b) > 0 THEN length(regexp_replace(b, '[^\x{{FFFD}}]', '', 'g')) / length(b)::DOUBLE ELSE 1 END AS replaced,
 CASE WHEN length(b) > 0 THEN length(regexp_replace(b, '[\x{{FFFD}}\p{{C}}\p{{Zl}}\p{{Zp}}\x{{00A0}}\x{{2000}}-\x{{200A}}\x{{202F}}\x{{205F}}\x{{3000}}]', '', 'g')) / length(b)::DOUBLE ELSE 0 END AS printable,
 CASE WHEN length(b) > 0 THEN length(regexp_replace(b, '[^\p{{Han}}]', '', 'g')) / length(b)::DOUBLE ELSE 0 END AS cjk, CASE WHEN length(b) > 0 THEN length(regexp_replace(b, '[^\p{{L}}\p{{Nd}}]', '', 'g')) / length(b)::DOUBLE ELSE 0 END AS alnum,
 CASE WHEN len(l) > 0 THEN length(b) / len(l)::DOUBLE ELSE 0 END AS average_line, CASE WHEN len(l) > 0 THEN z[len(l) // 2 + 1] ELSE 0 END AS median_line, CASE WHEN len(l) > 0 THEN len(list_filter(z, lambda s: s < 5)) / len(l)::DOUBLE ELSE 0 END AS fragments,
 CASE WHEN pages > 0 THEN length(b) / pages::DOUBLE ELSE 0 END AS a_page FROM dm),
mh AS (SELECT *, chars > 0 AND replaced <= 0.05 AND printable >= 0.8 AND average_line >= 5 AND fragments <= 0.5 AS healthy FROM m)"""
_NAMES = "chars replaced printable cjk alnum average_line median_line fragments a_page".split()


@query(f"WITH {_MEASURES} SELECT doc_id, " + ", ".join(f"round({n}::DOUBLE, 6) AS {n}" for n in _NAMES) + ", healthy FROM mh")
def text_quality(spark, sf):
    m = damaged(spark, sf).select("doc_id", Q.measures(F.col("t"), F.col("pages")).alias("m"))
    return m.select("doc_id", *(F.round(F.col(f"m.{n}").cast("double"), 6).alias(n) for n in _NAMES), Q.healthy(F.col("m")).alias("healthy"))


@query(f"""WITH {_MEASURES}, p AS (SELECT a.doc_id, a.healthy AS ah, b.healthy AS bh, a.chars AS ac, b.chars AS bc, a.replaced AS ar, b.replaced AS br, a.median_line AS al, b.median_line AS bl FROM mh a JOIN mh b ON b.doc_id = a.doc_id + 1)
SELECT doc_id, CASE WHEN ah <> bh THEN ah WHEN ah THEN CASE WHEN ac <> bc THEN ac > bc WHEN abs(ar - br) > 0.005 THEN ar < br ELSE al >= bl END WHEN ar <> br THEN ar < br ELSE al >= bl END AS better FROM p""")
def candidate_choice(spark, sf):
    a = damaged(spark, sf).select("doc_id", Q.measures(F.col("t"), F.col("pages")).alias("a"))
    b = a.select((F.col("doc_id") - 1).alias("doc_id"), F.col("a").alias("b"))
    return a.join(b, "doc_id").select("doc_id", Q.better(F.col("a"), F.col("b")).alias("better"))


@query(f"""WITH {_MEASURES}, x AS (SELECT h.*, length(t) AS n, healthy OR (chars > 0 AND cjk + alnum >= 0.5 AND (pages <= 0 OR a_page >= 1)) AS readable FROM mh h JOIN damaged USING (doc_id, pages))
SELECT doc_id, readable AND chars > 0 AND CASE WHEN doc_id % 2 = 0 THEN chars >= n // 4 ELSE chars > n * 2 END AS wins FROM x""")
def recognised_replacement(spark, sf):
    d = damaged(spark, sf)
    return d.select("doc_id", Q.recognised_wins(F.col("t"), F.col("doc_id") % 2 != 0, F.col("t"), F.col("pages")).alias("wins"))


@query(f"""WITH {_MEASURES}, s AS (SELECT doc_id, CASE WHEN pages * 60 <= 0 THEN CASE WHEN chars <= 0 THEN 'INCOMPLETE' WHEN NOT healthy THEN 'LOW_QUALITY' ELSE 'GOOD' END WHEN pages * 60 >= 100 AND chars / (pages * 60)::DOUBLE < 40 THEN 'INCOMPLETE' WHEN chars <= 0 THEN 'INCOMPLETE'
 WHEN NOT healthy THEN 'LOW_QUALITY' WHEN doc_id % 11 = 0 THEN 'WARNING' WHEN chars / (pages * 60)::DOUBLE < 100 AND doc_id % 7 <> 0 THEN 'WARNING' ELSE 'GOOD' END AS status FROM mh)
SELECT doc_id, status, CASE status WHEN 'GOOD' THEN 1.0::DOUBLE WHEN 'WARNING' THEN 0.7::DOUBLE WHEN 'LOW_QUALITY' THEN 0.3::DOUBLE ELSE 0.0::DOUBLE END AS score FROM s""")
def extraction_status(spark, sf):
    m = damaged(spark, sf).select("doc_id", (F.col("pages") * 60).alias("pages"), Q.measures(F.col("t"), F.col("pages")).alias("m"))
    i = F.col("doc_id")
    s = m.select("doc_id", Q.status(F.col("m.chars"), Q.healthy(F.col("m")), F.col("pages"), i % 11 == 0, F.when(i % 7 == 0, "ocr").otherwise("text")).alias("status"))
    return s.select("doc_id", "status", Q.score(F.col("status")).alias("score"))


# --- dictionaries -------------------------------------------------------
@query(r"""WITH a AS (SELECT p_partkey, unnest([p_name, lower(p_name), p_brand || '_Id-1', lower(p_brand) || '_id-1', lower(p_brand) || ' id-1', lower(p_brand) || '_id 1']) AS a FROM part WHERE p_name IS NOT NULL)
SELECT p_partkey, string_agg(DISTINCT a, '|' ORDER BY a) AS aliases FROM a GROUP BY p_partkey""")
def alias_generation(spark, sf):
    return table(spark, sf, "part").select("p_partkey", _list(D.aliases(F.col("p_name"), F.concat("p_brand", F.lit("_Id-1")))).alias("aliases"))


@query(r"""WITH m AS (SELECT p_partkey, string_split_regex(CAST(p_size AS VARCHAR) || ':' || p_name || '; 2=' || p_type || '|  :odd;plain；' || p_brand || '：', '[;；\n|]') AS l FROM part),
p AS (SELECT p_partkey, i, trim(regexp_replace(l[i], '\s+', ' ', 'g')) AS p FROM (SELECT *, unnest(generate_series(1, len(l))) AS i FROM m)),
v AS (SELECT p_partkey, i, CASE WHEN regexp_matches(p, '[:：=]') THEN trim(regexp_extract(p, '^([^:：=]*)[:：=]', 1)) ELSE p END AS v, CASE WHEN regexp_matches(p, '[:：=]') THEN trim(regexp_extract(p, '^[^:：=]*[:：=](.*)$', 1)) ELSE '' END AS l FROM p WHERE p <> '')
SELECT p_partkey, string_agg(CASE WHEN v = '' THEN l || '>' ELSE v || '>' || l END, '|' ORDER BY i) AS pairs FROM v WHERE v <> '' OR l <> '' GROUP BY p_partkey""")
def enum_mapping(spark, sf):
    m = F.concat(F.col("p_size").cast("string"), F.lit(":"), "p_name", F.lit("; 2="), "p_type", F.lit("|  :odd;plain；"), "p_brand", F.lit("："))
    return table(spark, sf, "part").select("p_partkey", _list(F.transform(D.enum_values(m), lambda e: F.concat_ws(">", e["value"], e["label"]))).alias("pairs"))


_CONCEPT_SQL = " ".join(f"SELECT p_partkey, '{n}' AS c, {i} AS o FROM n WHERE regexp_matches(t, '{'|'.join(w)}') UNION ALL" for i, (n, w) in enumerate(D.CONCEPTS.items())).removesuffix("UNION ALL")


@query(f"WITH n AS (SELECT p_partkey, lower(translate(p_name || ' ' || p_type, 'bg', 'tr')) || CASE WHEN p_size % 5 = 0 THEN ' order_date' WHEN p_size % 5 = 1 THEN ' 用户 cell' ELSE '' END AS t FROM part), c AS ({_CONCEPT_SQL}) SELECT p_partkey, string_agg(c, '|' ORDER BY o) AS concepts FROM c GROUP BY p_partkey")
def concept_tagger(spark, sf):
    t = F.concat(F.lower(F.translate(F.concat("p_name", F.lit(" "), "p_type"), "bg", "tr")), F.when(F.col("p_size") % 5 == 0, " order_date").when(F.col("p_size") % 5 == 1, " 用户 cell").otherwise(""))
    return table(spark, sf, "part").select("p_partkey", _list(D.concepts(t)).alias("concepts")).filter("concepts <> ''")


@query("""WITH c AS (SELECT p_partkey, [p_name, CASE WHEN p_size % 2 = 0 THEN 'Field Name' ELSE ' Column name' END, CASE WHEN p_size % 3 = 0 THEN 'Data  type' WHEN p_size % 3 = 1 THEN NULL ELSE 'x' END, CASE WHEN p_size % 5 = 0 THEN '备注' ELSE '' END, CASE WHEN p_size % 7 = 0 THEN 'Primary Key' ELSE 'Length' END] AS c, p_size FROM part),
s AS (SELECT p_partkey, p_size % 3 = 0 AS t, p_size % 5 = 0 AS m, p_size % 7 = 0 AS k FROM c)
SELECT p_partkey, CASE WHEN t OR m THEN round(0.10::DOUBLE + 0.38 + CASE WHEN t THEN 0.22 ELSE 0 END + CASE WHEN m THEN 0.18 ELSE 0 END + CASE WHEN k THEN 0.07 ELSE 0.05 END, 6) ELSE 0 END AS score, (t OR m) AS header FROM s""")
def header_rows(spark, sf):
    z = F.col("p_size")
    cells = F.array("p_name", F.when(z % 2 == 0, "Field Name").otherwise(" Column name"), F.when(z % 3 == 0, "Data  type").when(z % 3 == 2, "x"), F.when(z % 5 == 0, "备注").otherwise(""), F.when(z % 7 == 0, "Primary Key").otherwise("Length"))
    return table(spark, sf, "part").select("p_partkey", F.round(D.header_score(cells), 6).alias("score"), D.is_header(cells).alias("header"))


@query("""SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN length(p_name) >= 2 WHEN 3 THEN true ELSE false END AS title FROM part""")
def title_rows(spark, sf):
    z = F.col("p_size") % 4
    cells = F.when(z == 0, F.array(F.col("p_name"), F.lit(" "), F.lit(None))).when(z == 1, F.array("p_name", "p_type")).when(z == 2, F.array(F.lit(""), F.lit("\n"))).otherwise(F.array(F.lit("字")))
    return table(spark, sf, "part").select("p_partkey", D.is_title(cells).alias("title"))


@query("""SELECT p_partkey, 'Field: ' || p_name || '; Table: ' || p_type || '; Scope: base' || CASE WHEN p_size % 2 = 0 THEN '; Type: ' || p_brand ELSE '' END || '; Enum: 1=on,2' || CASE WHEN p_size % 3 = 0 THEN '; Concepts: Order,Time' ELSE '' END AS field,
'Table: ' || p_type || '; Scope: base' || CASE WHEN p_size % 2 = 0 THEN '; Purpose: ' || p_brand || ' (inferred)' ELSE '; Purpose: ' || p_brand END || CASE WHEN p_size > 1 THEN '; Field count: ' || CAST(p_size - 1 AS VARCHAR) ELSE '' END AS tab FROM part""")
def entity_texts(spark, sf):
    z, none = F.col("p_size"), F.lit("")
    enum = F.array(F.struct(F.lit("1").alias("value"), F.lit("on").alias("label")), F.struct(F.lit("2").alias("value"), F.lit("").alias("label")))
    field = D.field_text(F.col("p_name"), F.col("p_type"), F.lit("base"), F.when(z % 2 == 0, F.col("p_brand")), none, enum, F.when(z % 3 == 0, F.array(F.lit("Order"), F.lit("Time"))))
    tab = D.table_text(F.col("p_type"), F.lit("base"), none, F.col("p_brand"), z % 2 == 0, z - 1)
    return table(spark, sf, "part").select("p_partkey", field.alias("field"), tab.alias("tab"))


@query("""WITH r AS (SELECT p_partkey, p_partkey * 7 % 18278 + 1 AS c FROM part) SELECT p_partkey, CASE WHEN c > 702 THEN chr(CAST(65 + ((c - 703) // 676) % 26 AS INT)) ELSE '' END || CASE WHEN c > 26 THEN chr(CAST(65 + ((c - 27) // 26) % 26 AS INT)) ELSE '' END || chr(CAST(65 + (c - 1) % 26 AS INT)) AS name, c AS number, p_partkey AS row FROM r""")
def sheet_references(spark, sf):
    c = F.col("p_partkey") * 7 % 18278 + 1
    r = table(spark, sf, "part").select("p_partkey", D.column_name(c).alias("name"))
    ref = F.concat("name", F.col("p_partkey").cast("string"))
    return r.select("p_partkey", "name", D.column_number(ref).cast("long").alias("number"), D.row_number(ref).alias("row"))


@query("""WITH n AS (SELECT p_partkey, lower(trim(regexp_replace(p_name || ['_id', ' KEY ', ' time', 'No', '', ' Created at'][p_partkey % 6 + 1], '\\s+', ' ', 'g'))) AS name FROM part)
SELECT p_partkey, CASE WHEN regexp_matches(name, '(id|key|no|number)$') THEN 0.6::DOUBLE END AS joins, CASE WHEN regexp_matches(name, 'time|date|created|updated|时间|日期') THEN 0.5::DOUBLE END AS times FROM n""")
def key_hint_names(spark, sf):
    """Names of parts with six kinds of endings: which are keys or times by their names alone."""
    k = F.col("p_partkey")
    name = F.concat("p_name", F.element_at(F.array(*map(F.lit, ("_id", " KEY ", " time", "No", "", " Created at"))), (k % 6 + 1).cast("int")))
    return table(spark, sf, "part").select("p_partkey", D.join_hint(name).alias("joins"), D.time_hint(name).alias("times"))


@query(rf"""WITH {CHUNKS}, t AS (SELECT doc_id, idx, lower(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS k FROM chunks)
SELECT doc_id, idx, length(k) BETWEEN 2 AND 96 AND NOT starts_with(k, 'http') AND regexp_matches(k, '[\p{{L}}\p{{Nd}}]') AND NOT regexp_matches(k, '^v?[0-9]+([.-][0-9a-z]+)*$') AND k NOT IN ('notes', 'steps', 'overview') AS concept FROM t""")
def useful_concepts(spark, sf):
    c = chunks(docs(spark, sf))
    return c.select("doc_id", "idx", X.is_concept(X.concept_key(F.col("text"))).alias("concept"))
