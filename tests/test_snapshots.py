"""Publication by compare-and-set, pinned reads, fences, cursors, and what is removed when."""

import threading

import pytest
from pyspark.sql import functions as F

from papyra.operators import library as Li
from papyra.operators import search as Se
from papyra.operators import snapshots as Sn


def docs(spark, status):
    return spark.createDataFrame([(i, f"t{i}", "s", None, 1, s, "GOOD") for i, s in enumerate(status)], "doc_id long, title string, source string, updated int, created int, status string, quality string")


def chunks(spark, n=3, words="red fox"):
    return spark.createDataFrame([(d, i, "", f"{words} {d} {i}") for d in range(n) for i in range(6)], "doc_id long, idx long, heading string, text string")


@pytest.fixture
def root(spark, tmp_path):
    root = f"file://{tmp_path}/library"
    Sn.publish(spark, root, Sn.tables_of(docs(spark, ["ready"] * 3), chunks(spark)), now_ms=1000)
    return root


def test_of_racing_publishers_one_wins(spark, tmp_path):
    root, won, lost = f"file://{tmp_path}/race", [], []
    df = spark.range(3)

    def run(n):
        try:
            won.append(Sn.publish(spark, root, {"t": df.withColumn("by", F.lit(n))}).epoch)
        except Sn.Conflict:
            lost.append(n)

    threads = [threading.Thread(target=run, args=(n,)) for n in range(6)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert won == [1] and len(lost) == 5 and Sn.epochs(spark, root) == [1]
    assert Sn.at(spark, root).read(spark, "t").select("by").distinct().count() == 1
    with pytest.raises(Sn.Conflict):
        Sn.publish(spark, root, {"t": df}, expected=0)
    with pytest.raises(Sn.Conflict):
        Sn.publish(spark, root, {"t": df}, expected=2)


def test_tables_are_carried_over_and_old_ones_removed_after_the_grace(spark, root):
    first = Sn.at(spark, root)
    second = Sn.publish(spark, root, {"documents": docs(spark, ["ready", "deleting", "ready"])}, 1, now_ms=2000)
    assert second.tables["chunks"] == first.tables["chunks"] and second.tables["documents"] != first.tables["documents"]
    far = 10**15
    assert Sn.collect(spark, root, now_ms=2000 + Sn.GRACE_MS) == ([], [])  # within the grace
    old, gone = Sn.collect(spark, root, now_ms=far)
    assert old == [1] and gone == []  # epoch 2 still names tables of that folder
    third = Sn.publish(spark, root, Sn.tables_of(docs(spark, ["ready"]), chunks(spark, 1)), 2, now_ms=3000)
    old, gone = Sn.collect(spark, root, now_ms=far)
    assert old == [2] and len(gone) == 2 and third.read(spark, "chunks").count() == 6
    with pytest.raises(Sn.Expired):
        Sn.at(spark, root, 1)


def test_a_document_deleted_during_a_search_is_not_returned(spark, root):
    """The reranker stands for work that takes time: while it runs, a document is deleted and new chunks are published."""

    def slow(question, texts):
        if len(Sn.epochs(spark, root)) == 1:
            Sn.publish(spark, root, Sn.tables_of(docs(spark, ["ready", "deleting", "ready"]), chunks(spark, words="blue cat")), 1)
        return [0.5] * len(texts)

    found = Sn.search(spark, root, "red fox", options=Se.Options(top_k=18, rerank=slow)).collect()
    assert {r.doc_id for r in found} == {0, 2} and {r.epoch for r in found} == {1} and len(found) == 12
    assert Sn.search(spark, root, "red fox").count() == 0 and Sn.search(spark, root, "blue cat", options=Se.Options(top_k=50)).count() == 12
    assert {r.doc_id for r in Sn.search(spark, root, "red fox", epoch=1).collect()} <= {0, 2}


def test_reading_on_from_a_cursor_stays_in_its_snapshot(spark, root):
    hit = Sn.search(spark, root, "fox 0", options=Se.Options(top_k=50)).filter("doc_id = 1 AND idx = 0").first()
    Sn.publish(spark, root, Sn.tables_of(docs(spark, ["ready"] * 3), chunks(spark, words="blue cat")), 1)
    rows, on = Sn.read_on(spark, root, hit.cursor, 2)
    assert [(r.idx, r.text) for r in rows.collect()] == [(1, "red fox 1 1"), (2, "red fox 1 2")]
    rows, on = Sn.read_on(spark, root, on, 9)
    assert [r.idx for r in rows.collect()] == [3, 4, 5]
    assert Sn.read_on(spark, root, on)[1] is None and [r.idx for r in Sn.read_on(spark, root, on, 2, back=True)[0].collect()] == [3, 4]
    Sn.publish(spark, root, {"documents": docs(spark, ["ready", "deleting", "ready"])}, 2)
    with pytest.raises(KeyError, match="DOCUMENT_NOT_FOUND"):
        Sn.read_on(spark, root, hit.cursor)
    Sn.collect(spark, root, now_ms=10**15)
    with pytest.raises(Sn.Expired, match="SNAPSHOT_EXPIRED"):
        Sn.read_on(spark, root, hit.cursor)
    for bad in ("", "abc", hit.cursor[:-2] + "AA", hit.cursor + "x"):
        with pytest.raises(ValueError, match="INVALID_CURSOR"):
            Sn.read_on(spark, root, bad)


def test_publication_of_many_bases(spark):
    rows = [("a", 1, "active", 5), ("a", 2, "building", 6), ("b", 1, "building", 5), ("b", 2, "active", 6), ("c", 1, "failed", 5), ("d", 1, "active", 1), ("e", 1, "building", 3)]
    states = spark.createDataFrame(rows, "base string, generation int, state string, changed long")
    asked = spark.createDataFrame([("a", 2), ("b", 1), ("c", 1), ("d", 4), ("z", 1)], "base string, generation int")
    got = {(r.base, r.generation): (r.state, r.changed, r.outcome) for r in Li.publish_all(states, asked, 9).collect()}
    assert got == {
        ("a", 1): ("retired", 9, None), ("a", 2): ("active", 9, "published"), ("b", 1): ("building", 5, "overtaken"), ("b", 2): ("active", 6, None), ("c", 1): ("failed", 5, "not building"),
        ("d", 1): ("active", 1, None), ("d", 4): (None, None, "not building"), ("e", 1): ("building", 3, None), ("z", 1): (None, None, "not building")}
