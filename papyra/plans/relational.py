"""Queries of scopes, pages, trees, imports, quality, operations and sessions."""

from __future__ import annotations

from papyra.plans.catalogue import both

both("doc_filter", r"SELECT doc_id FROM {documents} WHERE lang IN ('en', 'de') AND ('doc-' || CAST(doc_id AS STRING)) LIKE '%1%' AND n_chars BETWEEN 200 AND 5000".replace("STRING", "VARCHAR"), r"SELECT doc_id FROM {documents} WHERE lang IN ('en', 'de') AND concat('doc-', doc_id) LIKE '%1%' AND n_chars BETWEEN 200 AND 5000")
both("base_stats", "SELECT source, count(*) AS documents, CAST(coalesce(sum(n_chars), 0) AS BIGINT) AS chars, CAST(coalesce(sum(length(text)), 0) AS BIGINT) AS measured FROM {documents} GROUP BY source")
both("history_top50", "SELECT event_id, ts FROM {events} ORDER BY ts DESC, event_id DESC LIMIT 50")
both("history_trim", "SELECT count(*) AS dropped FROM {orders} o LEFT ANTI JOIN (SELECT o_orderkey FROM {orders} ORDER BY o_orderdate DESC, o_orderkey LIMIT 50) k ON o.o_orderkey = k.o_orderkey".replace("LEFT ANTI JOIN", "ANTI JOIN"), "SELECT count(*) AS dropped FROM {orders} o LEFT ANTI JOIN (SELECT o_orderkey FROM {orders} ORDER BY o_orderdate DESC, o_orderkey LIMIT 50) k ON o.o_orderkey = k.o_orderkey")
both("orphan_anti", "SELECT c_custkey FROM {customer} c WHERE NOT EXISTS (SELECT 1 FROM {orders} o WHERE o.o_custkey = c.c_custkey)")
both("semi_documents_with_labels", "SELECT count(DISTINCT doc_id) AS n FROM {documents} d WHERE EXISTS (SELECT 1 FROM {labels} l WHERE l.doc_id = d.doc_id)")
both("union_generations", "SELECT o_orderpriority AS g FROM {orders} UNION SELECT c_mktsegment FROM {customer}")
both("group_names", "SELECT name, min(position) AS position FROM (SELECT r_name AS name, r_regionkey AS position FROM {region} UNION ALL SELECT c_mktsegment, 100 FROM {customer}) x GROUP BY name")
both("retired_generations", "SELECT o_orderkey FROM {orders} WHERE o_orderdate < (SELECT max(o_orderdate) FROM {orders}) - INTERVAL 30 DAY AND o_orderstatus = 'F'")

# regions, nations, customers and suppliers as a tree
_TREE = """tree(id, parent, kind, name) AS (SELECT 'r' || CAST(r_regionkey AS VARCHAR(9)), CAST(NULL AS VARCHAR(20)), 1, r_name FROM {region}
UNION ALL SELECT 'n' || CAST(n_nationkey AS VARCHAR(9)), 'r' || CAST(n_regionkey AS VARCHAR(9)), 1, n_name FROM {nation} UNION ALL SELECT 's' || CAST(s_suppkey AS VARCHAR(9)), 'n' || CAST(s_nationkey AS VARCHAR(9)), 0, s_name FROM {supplier})"""
both("tree_descend", f"WITH RECURSIVE {_TREE}, down(id, depth) AS (SELECT id, 0 FROM tree WHERE id = 'r1' UNION ALL SELECT t.id, d.depth + 1 FROM tree t JOIN down d ON t.parent = d.id WHERE d.depth < 64) SELECT id, CAST(depth AS INT) AS depth FROM down")
both("tree_ancestors", f"WITH RECURSIVE {_TREE}, up(leaf, id, depth) AS (SELECT id, parent, 1 FROM tree WHERE kind = 0 UNION ALL SELECT u.leaf, t.parent, u.depth + 1 FROM tree t JOIN up u ON t.id = u.id WHERE t.parent IS NOT NULL AND u.depth < 64) SELECT leaf, id, CAST(depth AS INT) AS depth FROM up")
both("delete_fence", f"WITH RECURSIVE {_TREE}, down(id, depth) AS (SELECT id, 0 FROM tree WHERE id = 'n3' UNION ALL SELECT t.id, d.depth + 1 FROM tree t JOIN down d ON t.parent = d.id WHERE d.depth < 64) SELECT t.id, CASE WHEN d.id IS NULL THEN 'active' ELSE 'deleting' END AS state FROM tree t LEFT JOIN down d ON t.id = d.id")

both("queue_depth", "SELECT event_type, count(*) AS depth FROM {events} GROUP BY event_type")
both("idempotency_dedup", "SELECT event_id FROM (SELECT event_id, ts, lag(ts) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS before FROM {events}) x WHERE before IS NULL OR ts > before + INTERVAL 10 MINUTE")
both("event_tail", "SELECT event_id, event_type FROM {events} WHERE event_id > 500 ORDER BY event_id LIMIT 100")

both("session_turns", "SELECT conv_id, turn, lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM {conversations} WHERE role = 'user'")
both("capabilities", "SELECT d.source, count(*) AS documents, count(l.doc_id) AS labelled, max(CASE WHEN l.quality = 1 THEN 1 ELSE 0 END) AS good FROM {documents} d LEFT JOIN {labels} l ON d.doc_id = l.doc_id GROUP BY d.source")
