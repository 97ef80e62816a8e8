"""Leases, admission, stored files: small cases."""

import hashlib

import pytest
from pyspark.sql import functions as F

from papyra.operators import leases as Le
from papyra.operators import library as Li
from papyra.operators import storage as St


def run(spark, *actions, lease=10):
    rows = [("a", n, at, action, worker) for n, (action, worker, at) in enumerate(actions)]
    got = Le.replayed(spark.createDataFrame(rows, "op string, seq long, at long, action string, worker string"), lease).orderBy("seq").collect()
    return [r.outcome for r in got], (got[-1].state, got[-1].holder, got[-1].until, got[-1].attempt)


def test_a_lease_is_renewed_lost_and_taken_over(spark):
    outcomes, last = run(spark, ("submit", None, 0), ("submit", None, 0), ("claim", "x", 1), ("claim", "y", 5), ("heartbeat", "x", 10), ("heartbeat", "y", 11), ("claim", "y", 21), ("complete", "x", 22), ("complete", "y", 23), ("heartbeat", "y", 24))
    assert outcomes == ["ok", "exists", "ok", "busy", "ok", "lost", "takeover", "lost", "ok", "refused"] and last == ("succeeded", None, None, 2)


def test_failures_are_tried_again_then_end(spark):
    outcomes, last = run(spark, ("submit", None, 0), *[x for n in range(3) for x in (("claim", "x", n), ("fail", "x", n))], ("claim", "x", 9), ("retry", None, 9), ("claim", "x", 9))
    assert outcomes == ["ok", "ok", "again", "ok", "again", "ok", "ok", "refused", "ok", "ok"] and last == ("running", "x", 19, 1)
    outcomes, last = run(spark, ("submit", None, 0), ("claim", "x", 0), ("claim", "y", 20), ("claim", "z", 40), ("claim", "x", 60))
    assert outcomes == ["ok", "ok", "takeover", "takeover", "exhausted"] and last[0] == "failed"


def test_a_wish_to_cancel_is_met_by_the_holder_or_the_end_of_its_lease(spark):
    assert run(spark, ("submit", None, 0), ("cancel", None, 1), ("cancel", None, 2)) == (["ok", "ok", "refused"], ("cancelled", None, None, 0))
    begun = [("submit", None, 0), ("claim", "x", 1), ("cancel", None, 2)]
    assert run(spark, *begun, ("heartbeat", "x", 3), ("complete", "x", 4))[0][3:] == ["ok", "cancelled"]
    assert run(spark, *begun, ("claim", "y", 30)) == (["ok", "ok", "ok", "cancelled"], ("cancelled", None, None, 1))
    assert run(spark, ("none", "x", 0), (None, None, 1))[0] == ["refused", "refused"]


def test_many_actions_of_one_operation_pass_by(spark):
    d = spark.range(30_000).select(F.when(F.col("id") % 3 == 0, None).otherwise(F.lit("a")).alias("op"), F.col("id").alias("seq"), F.col("id").alias("at"), F.when(F.col("id") == 1, "submit").otherwise("heartbeat").alias("action"), F.lit(None).cast("string").alias("worker"))
    got = Le.replayed(d.repartition(7), 10)
    assert got.count() == 20_000 and {r.outcome for r in got.select("outcome").distinct().collect()} == {"ok", "refused"}
    assert Le.replayed(d.limit(0), 10).count() == 0


def test_admission_looks_at_all_resources_at_once(spark):
    rows = [(1, "io", "a", "running", 0, 0, 50, 5), (2, "io", "b", "queued", 9, 0, 60, 1), (3, "io", "b", "queued", 5, 0, 10, 1), (4, "io", "c", "queued", 4, 0, 10, 1), (5, "cpu", "a", "queued", 3, 0, 1, 1), (6, "cpu", None, "queued", 2, 0, 10, None), (7, "cpu", None, "queued", 1, 0, 10, 1), (8, "odd", "d", "queued", 0, 0, 0, 9)]
    ops = spark.createDataFrame(rows, "op long, class string, base string, state string, priority int, requested long, memory long, disk long")
    got = Le.admitted(ops, 0, {"io": 3, "cpu": 2}, {"memory": 100, "disk": 10}).orderBy("place").collect()
    # 2 is too large, 3 and 4 fill the class, 5 shares a base with 1, 8 needs more disk than is left
    assert [r.op for r in got] == [3, 4, 6, 7]
    assert Le.admitted(ops.filter("state = 'x'"), 0, {}, {"memory": 1}).count() == 0


def test_files_and_references_are_reconciled(spark, tmp_path):
    home = tmp_path / "raw"
    for name, text in (("a/1", "one"), ("a/2", "two"), ("b/3", "left over"), ("b/4", "changed")):
        (home / name).parent.mkdir(parents=True, exist_ok=True)
        (home / name).write_text(text)
    files = St.listed(spark, f"file://{home}")
    assert {(r.path, r.bytes) for r in files.collect()} == {("a/1", 3), ("a/2", 3), ("b/3", 9), ("b/4", 7)}
    refs = spark.createDataFrame([("a/1", 3, None), ("a/1", 3, None), ("a/2", None, "x"), ("b/4", 8, None), ("c/5", 1, None), ("", 1, None), (None, 1, None)], "path string, bytes long, sha256 string")
    found = {r.path: (r.finding, r.bytes) for r in St.reconciled(files, refs).collect()}
    assert found == {"b/3": ("orphan", 9), "b/4": ("damaged", 7), "c/5": ("missing", 1)}
    orphans = St.reconciled(files, refs).filter("finding = 'orphan'")
    assert St.quarantine(spark, f"file://{home}", orphans, 1000) == 1 and not (home / "b/3").exists() and (home / ".quarantine/1000/b/3").read_text() == "left over"
    assert St.purge(spark, f"file://{home}", 1000 + St.KEPT_MS) == [] and St.purge(spark, f"file://{home}", 1001 + St.KEPT_MS) == [1000]
    assert not (home / ".quarantine/1000").exists() and (home / "a/1").exists()


def test_cited_versions_are_read_as_they_were(spark, tmp_path):
    files = spark.createDataFrame([(1, 1, bytearray(b"old")), (1, 2, bytearray(b"new"))], "doc_id long, version long, content binary")
    Li.save_raw(files, str(tmp_path / "raw"))
    raw = spark.read.parquet(str(tmp_path / "raw"))
    assert St.cited(raw, 1, 1) == b"old" and St.cited(raw, 1, 2) == b"new"
    with pytest.raises(KeyError, match="VERSION_NOT_FOUND"):
        St.cited(raw, 1, 3)
    bad = raw.withColumn("sha256", F.lit(hashlib.sha256(b"x").hexdigest()))
    with pytest.raises(ValueError, match="VERSION_DAMAGED"):
        St.cited(bad, 1, 1)
