"""Hard negatives against plain sorting; exact scores; defined results of odd rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from papyra.llm import negatives as N
from papyra.llm import queries



def mine(d, **options):
    return N.mine(d, F.col("label"), F.col("vec_id") % 10 == 0, **options)


def plain(rows, positives=5, k=5, low=80, high=100):
    """(anchor, positive, rank, negative, scores) of rows (vec_id, vector, label) by sorting all scores."""
    ok = [(i, [int(np.floor(256.0 * float(x))) for x in v], y) for i, v, y in rows if y is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for n, (i, a, y) in enumerate(ok):
        if i is None or i % 10:
            continue
        s = [(-sum(p * q for p, q in zip(a, v)), j is None, j or 0, z == y) for m, (j, v, z) in enumerate(ok) if m != n and len(v) == len(a)]
        s.sort()
        for sp, none, j, _ in [x for x in s if x[3]][:positives]:
            neg = [x for x in s if not x[3] and low * -sp <= 100 * -x[0] <= high * -sp][:k]
            out += [(i, None if none else j, r, None if x[1] else x[2], -sp, -x[0]) for r, x in enumerate(neg, 1)]
    return sorted(map(repr, out))


def told(df):
    return sorted(repr((r.anchor_id, r.positive_id, r["rank"], r.negative_id, r.positive_score, r.negative_score)) for r in df.collect())


@pytest.mark.parametrize("chunk_bytes", [N.CHUNK_BYTES, 2000])
def test_equal_to_sorting_all_scores(spark, monkeypatch, chunk_bytes):
    rng = np.random.default_rng(5)
    rows = [(int(i), [float(x) for x in np.round(rng.normal(0.3, 1, 4), 1)], int(rng.integers(0, 4))) for i in rng.integers(0, 250, 300)]
    same = [float(x) for x in rows[0][1]]
    rows += [(i, same, i % 3) for i in range(300, 400)]  # one vector again and again
    rows += [(10, same, 1), (10, same, 1), (None, same, 1), (None, same, 2), (400, None, 1), (401, [1.0, None, 0.0, 0.0], 1), (410, [float("nan")] * 4, 1), (420, [1.0, 1.0, 1.0, 1.0], None)]
    rows += [(430, [1.0, 2.0], 1), (431, [1.0, 2.0], 1), (432, [1.0, 2.0], 2), (440, [], 1), (441, [], 1), (442, [], 2), (450, [0.0] * 4, 1), (451, [float("inf")] * 4, 0)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3)
    rows = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], y) for i, v, y in rows]
    got = mine(d.withColumn("file", F.lit("x")).withColumn("rank", F.lit(1)), chunk_bytes=chunk_bytes)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert told(got) == plain(rows)
    assert mine(d.limit(0)).count() == 0 and N.mine(d, F.col("label"), F.lit(False)).count() == 0


def test_tiles_and_limits(spark, monkeypatch):
    rng = np.random.default_rng(6)
    rows = [(i, [float(x) for x in rng.normal(0, 1, 3)], i % 2) for i in range(200)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label long").coalesce(1)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "17")
    try:
        assert told(mine(d, positives=3, k=7, low=50, high=90)) == plain(rows, 3, 7, 50, 90)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")


def test_scores_are_exact_while_they_fit_a_long():
    a, x = np.array([[3.0e9, 1.0], [1.0, 2.0]]), np.array([[2.0e9, 7.0], [-1.0, 5.0], [4.0e18, 0.0]])
    want = [[max(-(2**63) + 1, min(2**63 - 1, int(p[0]) * int(q[0]) + int(p[1]) * int(q[1]))) for q in x] for p in a]
    assert N.scores(a, x).tolist() == want
    assert N.scores(np.empty((2, 0)), np.empty((3, 0))).tolist() == [[0] * 3] * 2


def test_query_is_told_by_its_sql(spark, sf):
    import duckdb

    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    cols = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    want = duck.execute(queries.oracle_sql()["op12_hard_negatives"]).df()[cols]
    got = queries.op12_hard_negatives(spark, sf).toPandas()[cols]
    assert len(got) and sorted(map(tuple, got.values.tolist())) == sorted(map(tuple, want.values.tolist()))
