"""The queries of this package: each applies its operator to the whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papyra.llm import ann, contamination, fertility, linededup, lm, mixing, neardup, negatives, packing, pii, prefixes, secrets, toxicity


def _vocabulary(name: str) -> str:
    """Where a public vocabulary file lies; the operators take its path as a parameter."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(_table(spark, sf_dir, "documents"))


def op2_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(_table(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.grade(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")).select("doc_id", "severity", "grade", "toxic")


def op4_tokenizer_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fertility.rate(_table(spark, sf_dir, "documents"), _vocabulary("piece_bpe_32k.model"))


def op5_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.dedup(_table(spark, sf_dir, "documents")).select("doc_id", "text", "n_lines", "n_removed")


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(_table(spark, sf_dir, "documents"), vocabulary=_vocabulary("word_bpe_49k.json"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.scan(_table(spark, sf_dir, "documents"))


def op10_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), _vocabulary("word_bpe_49k.json"))


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = prefixes.turns(_table(spark, sf_dir, "conversations"))
    first = F.crc32(F.col("conv_id").cast("string").cast("binary")) % 9
    return prefixes.trie(prefixes.rebuilt(turns, F.col("conv_id") - F.col("conv_id") % 5, first, 8))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(_table(spark, sf_dir, "embeddings"), label, F.col("vec_id") % 100 == 0)


def op13_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination.scan(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")).drop("spans")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        f.__name__: f
        for f in (
            op1_minhash_near_dedup,
            op2_lm_score,
            op3_toxicity,
            op4_tokenizer_fertility,
            op5_nearest,
            op6_mix_sources,
            op7_line_dedup,
            op8_secret_scan,
            op9_pii,
            op10_pack,
            op11_conversation_trie,
            op12_hard_negatives,
            op13_decontaminate,
            pipeline,
        )
    }


#: op6 told from the points: a source gives the blocks that as many ranks have as points fall to it.
_MIX = r"""
WITH d AS (
  SELECT doc_id, CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS skey, text,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS h
  FROM documents),
s AS (SELECT skey, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY skey),
w AS (
  SELECT *, 2.0::DOUBLE * source_size AS bound,
         CASE (row_number() OVER (ORDER BY skey) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w
  FROM s),
f AS (
  SELECT *, 1.5::DOUBLE * sum(source_size) OVER () AS total,
         (1.5::DOUBLE * sum(source_size) OVER () - (sum(bound) OVER (ORDER BY bound / w, skey ROWS UNBOUNDED PRECEDING) - bound))
            / sum(w) OVER (ORDER BY bound / w, skey ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM w),
g AS (
  SELECT skey, source_size, total, least(bound, max(level) OVER () * w) AS target,
         CAST(greatest(ceil(total / 131072::DOUBLE), 1) AS BIGINT) AS b
  FROM f),
points AS (
  SELECT n, ((n::DOUBLE + 0.5::DOUBLE) * 0.6180339887498949::DOUBLE) % 1.0::DOUBLE AS x
  FROM range(131072) AS t(n) WHERE n < (SELECT max(ceil(total / b)) FROM g)),
lows AS (
  SELECT skey, coalesce(sum(target) OVER (ORDER BY skey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) / total, 0::DOUBLE) AS x
  FROM g WHERE target > 0),
slots AS (
  SELECT skey, n AS slot, row_number() OVER (PARTITION BY skey ORDER BY n) - 1 AS rank
  FROM points ASOF JOIN lows ON points.x >= lows.x),
given AS (SELECT skey, count(*) AS slots FROM slots GROUP BY skey),
q AS (
  SELECT g.*, CAST(ceil(source_size / b::DOUBLE) AS BIGINT) AS per, coalesce(slots, 0) AS slots FROM g LEFT JOIN given USING (skey)),
p AS (SELECT *, sum(size) OVER (PARTITION BY skey ORDER BY h, doc_id, size ROWS UNBOUNDED PRECEDING) - size AS start FROM d),
o AS (
  SELECT *, CAST(start // b AS BIGINT) AS rank, least(least(slots, per) * b, source_size) AS once,
         least(greatest(least(slots, 2 * per) - per, 0) * b, source_size) AS twice
  FROM p JOIN q USING (skey))
SELECT doc_id, size, source_size, target,
       CAST(greatest(0, least(start + size, once) - start) + greatest(0, least(start + size, twice) - start) AS BIGINT) AS taken,
       CAST(CASE WHEN size > 0 THEN slot END AS BIGINT) AS first_slot
FROM o LEFT JOIN slots USING (skey, rank)
"""


#: op11 told by the paths of all conversations as strings, each node's sums by those of all its ancestors. The inner
#: reductions are CRC-32, bit by bit.
_TRIE = """
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS d
  FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT DISTINCT conv_id, conv_id - conv_id % 5 AS base, string_split(CAST(conv_id AS VARCHAR), '') AS s FROM t),
h AS (
  SELECT conv_id, base,
         xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(s, lambda x: CAST(ord(x) AS BIGINT))),
                         lambda c, x: list_reduce(list_prepend(xor(c, x), range(8)), lambda v, i: CASE WHEN v % 2 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END)),
             4294967295::BIGINT) % 9 AS h
  FROM c),
r AS (
  SELECT h.conv_id, t.d, t.role, t.text FROM h JOIN t ON t.conv_id = h.base AND t.d <= h.h
  UNION ALL SELECT h.conv_id, t.d, t.role, t.text FROM h JOIN t ON t.conv_id = h.conv_id AND t.d > h.h),
q AS (
  SELECT conv_id, list(sha256(len(role) || ':' || role || text) ORDER BY d) AS x, list(CAST(strlen(text) AS BIGINT) ORDER BY d) AS b FROM r GROUP BY conv_id
  UNION ALL SELECT conv_id, [], [] FROM h WHERE conv_id NOT IN (SELECT conv_id FROM r)),
p AS (
  SELECT conv_id, d, array_to_string(x[1:d], ',') AS k, array_to_string(x[1:d - 1], ',') AS up, CASE WHEN d > 0 THEN b[d] ELSE 0 END AS bytes, d = len(x) AS ends
  FROM (SELECT conv_id, x, b, unnest(generate_series(0, len(x))) AS d FROM q)),
n AS (
  SELECT k, d, max(up) AS up, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * max(bytes) AS saved,
         sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE ends), '')) AS ends_sha256
  FROM p GROUP BY k, d),
kids AS (SELECT up AS k, count(*) AS n FROM n WHERE d > 0 GROUP BY up),
m AS (SELECT n.*, coalesce(kids.n, 0) AS n_children FROM n LEFT JOIN kids USING (k)),
sums AS (
  SELECT array_to_string(string_split(k, ',')[1:i], ',') AS k, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS leaves, sum(saved) AS saved
  FROM (SELECT k, n_children, saved, unnest(generate_series(0, d)) AS i FROM m) GROUP BY 1)
SELECT m.conv_id, CAST(m.d AS BIGINT) AS depth, CASE WHEN m.d > 0 THEN o.conv_id END AS parent_conv_id, CAST(m.n_convs AS BIGINT) AS n_convs,
       CAST(m.n_children AS BIGINT) AS n_children, CAST(sums.leaves AS BIGINT) AS n_leaves, CAST(sums.saved AS BIGINT) AS saved_tokens, m.ends_sha256
FROM m JOIN sums USING (k) LEFT JOIN n AS o ON o.k = m.up
"""

#: op12 told by all scores of all anchors.
_NEGATIVES = """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256::DOUBLE * CAST(x AS DOUBLE))) AS e
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.r AS anchor, a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_dot_product(a.e, b.e) AS BIGINT) AS score
  FROM v AS a JOIN v AS b ON a.r <> b.r WHERE a.vec_id % 100 = 0),
p AS (SELECT *, row_number() OVER (PARTITION BY anchor ORDER BY score DESC, vec_id) AS nth FROM s WHERE same QUALIFY nth <= 5),
n AS (
  SELECT p.anchor_id, p.vec_id AS positive_id, CAST(row_number() OVER (PARTITION BY p.anchor, p.nth ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank,
         s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score
  FROM p JOIN s ON p.anchor = s.anchor AND NOT s.same
  WHERE 80 * p.score <= 100 * s.score AND 100 * s.score <= 100 * p.score)
SELECT * FROM n WHERE rank <= 5
"""

#: op13 told by joining all windows of all documents with the items' windows as strings.
_TESTS = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS r,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, m, array_to_string(w[i:i + m - 1], ' ') AS g
  FROM (SELECT item_id, w, least(len(w), 10) AS m, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS i FROM b WHERE len(w) > 0)),
dw AS (
  SELECT r, m, i, array_to_string(w[i:i + m - 1], ' ') AS g
  FROM (SELECT r, w, m, unnest(generate_series(1, len(w) - m + 1)) AS i FROM d CROSS JOIN (SELECT DISTINCT m FROM bw))),
hits AS (SELECT r, m, i, item_id FROM dw JOIN bw USING (m, g)),
words AS (SELECT r, count(DISTINCT k) AS n FROM (SELECT r, unnest(generate_series(i, i + m - 1)) AS k FROM hits) GROUP BY r),
items AS (
  SELECT r, count(DISTINCT item_id) AS n, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids
  FROM hits GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(words.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(items.n, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(words.n, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (r) LEFT JOIN items USING (r)
"""


def oracle_sql() -> dict[str, str]:
    """The other operators learn, iterate or run tokenisers; tests/llm holds them against brute force."""
    return {"op6_mix_sources": _MIX, "op11_conversation_trie": _TRIE, "op12_hard_negatives": _NEGATIVES, "op13_decontaminate": _TESTS}
