"""Nearest neighbours: equal vectors, odd vectors, leaves that don't grow."""

import numpy as np
from pyspark.sql import functions as F

from papyra.llm import ann


def test_equal_and_odd_vectors(spark):
    rows = [(i, [1.0, 2.0, 3.0], "x", 0.5) for i in range(0, 300, 3)] + [(1, [1.0, 2.0, 3.0], "x", 0.5)] * 3
    rows += [(2, [1e200, -1e200, 1e200], None, None), (4, [1e-200, 0.0, 0.0], "y", None), (5, [1.0, None, 0.0], None, 1.0), (7, [float("inf"), 0.0, 0.0], None, 1.0), (8, [], None, 1.0)]
    e = spark.createDataFrame(rows, "vec_id long, embedding array<double>, leaf string, score double")
    got = {}
    for r in ann.search(e, F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert set(got) == {0, 150}
    assert [v for _, v, _ in got[0]] == [1, 3, 6, 9, 12] and [v for _, v, _ in got[150]] == [0, 1, 3, 6, 9]
    assert [r for r, _, _ in got[0]] == [1, 2, 3, 4, 5]
    (far,) = ann.search(e.filter("vec_id in (2, 4)"), F.col("vec_id") == 2).collect()
    assert far.vec_id == 4 and abs(far.score - 3**-0.5) < 1e-15


def test_leaves_do_not_grow_with_the_table(spark):
    rng = np.random.default_rng(1)
    for n in (2_000, 12_000):
        x = rng.normal(size=(n, 8))
        rows = spark.createDataFrame([(row.tolist(), i) for i, row in enumerate(x)], "v array<double>, h long").withColumn("h", F.xxhash64("v"))
        tree = ann.grow(rows, 8, x[:1500], n, "double")
        assert np.bincount(tree.place(ann._unit(x))).max() <= 2 * ann.LEAF_ROWS


def test_recall_of_the_real_run(spark):
    """Recall against brute force of the query's own parameters on the larger table."""
    e = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    got = ann.search(e, F.col("vec_id") % 50 == 0).toPandas()
    all_ = e.toPandas()
    ids, x = all_.vec_id.to_numpy(), np.stack(all_.embedding.to_numpy()).astype(float)
    hit = 0
    for q, own in got.groupby("query_id"):
        s = ann.cosine(x[ids == q][0], x)
        s[ids == q] = -2
        hit += len(set(ids[np.lexsort((ids, -s))[:5]]) & set(own.vec_id))
    assert hit >= 0.9 * len(got)


def test_a_task_sends_off_visits_in_the_midst_of_a_batch(monkeypatch):
    import pandas as pd

    monkeypatch.setattr(ann, "HELD", 2048)
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 8))
    tree = ann.Tree(8)
    tree.graft([(0, *ann.fit(ann._unit(x), 32))])
    asked = pd.DataFrame({"vec_id": np.arange(1000), "v": list(x[:1000])})
    sent = list(ann._visit(lambda: tree, 20, np.full(tree.leaves, 32), 5)(iter([asked])))
    visits = [sum(len(q) // 8 for q in b["qids"]) for b in sent]
    assert sum(visits) == 20 * 1000 and max(visits) <= 2048
    seen = {(leaf, q) for b in sent for leaf, qids in zip(b["leaf"], b["qids"], strict=True) for q in np.frombuffer(qids, np.int64)}
    assert len(seen) == 20 * 1000
