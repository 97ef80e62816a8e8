"""Small cases with known results."""

import random

from pyspark.sql import functions as F

from papyra.functions import text as X
from papyra.functions import versions as V
from papyra.operators import retrieval as R
from papyra.operators.graph import bfs
from papyra.sources.html import to_text
from papyra.sources.tables import gold, text_files
from papyra.streaming import queue


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "t string").select(f(F.col("t"))).first()[0]


def test_token_estimate(spark):
    assert one(spark, "", X.token_estimate) == 0
    assert one(spark, "a", X.token_estimate) == 1
    assert one(spark, "知识库", X.token_estimate) == 2
    assert one(spark, "abcdefgh", X.token_estimate) == 2


def test_terms_and_sentences(spark):
    assert one(spark, "A1b x 知识库 单", X.terms) == ["a1b", "知识", "识库", "单"]
    assert one(spark, "Uses 1.5 GB. See a.b! 好。", X.sentences) == ["Uses 1.5 GB", "See a.b", "好"]


def test_versions(spark):
    for a, b, c in [("1.2", "1.10", -1), ("v2.0", "2.0.0", 0), ("rel-17", "1.7", None), ("rel 18", "rel-17", 1), ("1.0-beta", "1.0", None)]:
        got = spark.createDataFrame([(a, b)], "a string, b string").select(V.compare(V.normalize(F.col("a")), V.normalize(F.col("b")))).first()[0]
        assert got == c, (a, b)


def test_rrf_ignores_the_order_of_rows(spark):
    lane = [(i, i + 1) for i in range(20)]
    mixed = random.Random(1).sample(lane, 20)
    a, b = ({r.id: r.score for r in R.rrf([(spark.createDataFrame(x, "id int, rank int"), 1.0)], "id").collect()} for x in (lane, mixed))
    assert a == b and a[0] == round(1 / 61, 9)


def test_mmr_prefers_what_is_new():
    assert R.mmr([(1, 1.0, [1, 0]), (2, 0.99, [1, 0]), (3, 0.9, [0, 1]), (4, 0.1, [0, 1])], 3) == [1, 3, 2]
    assert R.mmr([], 3) == []


def test_html():
    title, text = to_text("<title> T </title><h2>Head</h2><p>a  <b>b</b></p><script>x()</script><ul><li>i<li>j</ul>")
    assert (title, text) == ("T", "## Head\na b\n- i\n- j")
    assert to_text(None) == ("", "")


def test_bfs_bounds(spark):
    e = spark.createDataFrame([("a", "b", 1), ("b", "c", 2), ("c", "d", 3), ("b", "a", 4)], "src string, dst string, edge_id int")
    got = {r.node: r.hop for r in bfs(e, spark.createDataFrame([("a",)], "node string"), hops=2).collect()}
    assert got == {"a": 0, "b": 1, "c": 2}


def test_queue_keeps_the_last_change(spark, tmp_path):
    src, seen = str(tmp_path / "in"), []
    spark.createDataFrame([(1, 1, "a"), (1, 3, "c"), (2, 2, "b"), (1, 2, "x")], "doc long, at long, state string").coalesce(1).write.json(src)
    stream = spark.readStream.schema("doc long, at long, state string").json(src)
    queue.drain(stream, "doc", "at", str(tmp_path / "check"), lambda df, n: seen.extend(map(tuple, df.collect()))).awaitTermination()
    assert sorted(seen) == [(1, 3, "c"), (2, 2, "b")]


def test_text_files_and_gold(spark, tmp_path):
    (tmp_path / "d" / "e").mkdir(parents=True)
    (tmp_path / "d" / "a.TXT").write_bytes(b"\xef\xbb\xbfhi")
    (tmp_path / "d" / "e" / "b.md").write_bytes("中文内容".encode("gb18030"))
    (tmp_path / "d" / "~$c.txt").write_bytes(b"lock")
    assert [(r.name, r.text) for r in text_files(spark, str(tmp_path / "d")).collect()] == [("a.TXT", "hi"), ("b.md", "中文内容")]
    (tmp_path / "g.jsonl").write_text('{"question_id":"1","question":"q","gold_answer":"a","gold_evidence_locators":[{"document":"d","needle":"n"}]}\n{"question_id":"2","question":"q"}\n')
    assert {r.question_id: r.problem for r in gold(spark, str(tmp_path / "g.jsonl")).collect()} == {"1": None, "2": "no evidence or answer"}


def test_sharing_tells_unions_without_pairs(spark):
    from papyra.operators import graph as G

    keys = {1: "abc", 2: "abc", 3: "bx", 4: "cx", 5: "z", 6: "bcy", 7: "y", 8: "ab"}
    want = {}
    for d, own in keys.items():
        others = {e for e, k in keys.items() if e != d and set(k) & set(own)}
        if others:
            want[d] = (len(others), min(others))
    rows = spark.createDataFrame([(d, k) for d, own in keys.items() for k in own * 2], "doc_id long, key string")
    for heavy in (0, 2, 3, 256):
        assert {r.doc_id: (r.related, r.nearest) for r in G.sharing(rows, heavy).collect()} == want
