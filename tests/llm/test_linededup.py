"""Prefix doubling against plain prefixes; defined results of odd documents."""

import collections

import numpy as np

from papyra.llm import linededup


def test_doubling_ranks_suffixes_by_their_prefixes(spark):
    rng = np.random.default_rng(3)
    seqs = [rng.integers(0, 3, 30).tolist() for _ in range(6)]
    level = spark.createDataFrame([(d, i, int(x)) for d, s in enumerate(seqs) for i, x in enumerate(s)], "d long, pos int, r long")
    h = 1
    while h < 8:
        level, h = linededup.doubled(level, h), 2 * h
        by = collections.defaultdict(list)
        for d, s in enumerate(seqs):
            for i in range(len(s) - h + 1):
                by[tuple(s[i : i + h])].append((d, i))
        want = {p: at for p, at in by.items() if len(at) > 1}
        got = {(r.d, r.pos): r.r for r in level.collect()}
        assert set(got) == {at for places in want.values() for at in places}
        ranks = [sorted({got[at] for at in want[p]}) for p in sorted(want)]
        assert all(len(r) == 1 for r in ranks)
        if h == 2:  # first ranks are the ids, so the order is that of the prefixes
            assert ranks == sorted(ranks)


def test_odd_documents_have_defined_results(spark):
    run = "\n".join(f"line {i} of a passage that repeats" for i in range(5))
    gap = "one two three four five six seven eight nine ten\n" + "\n" * 40 + "eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty"
    rows = [
        (3, run, 30.0, "k", "x"),
        (1, run + "\nown end", 1.0, "k", "x"),
        (None, "own start\n" + run, None, None, None),
        (2, None, 2.0, "k", None),
        (4, "", 2.0, "k", None),
        (5, gap, 2.0, None, None),
        (6, gap, 2.0, None, None),
        (6, gap, 2.0, None, None),
        (7, "few words\nfew words\nfew words", 0.0, None, None),
    ]
    d = spark.createDataFrame(rows, "doc_id long, text string, n_lines double, key string, keep string")
    got = linededup.dedup(d)
    assert got.columns == ["doc_id", "text", "n_lines", "key", "keep", "n_removed"]
    out = sorted(((r.doc_id is None, r.doc_id or 0, r.text, r.n_lines, r.n_removed, r.key) for r in got.collect()), key=repr)
    assert out == sorted(
        [
            (False, 1, run + "\nown end", 6, 0, "k"),
            (False, 2, None, 0, 0, "k"),
            (False, 3, "", 5, 5, "k"),
            (False, 4, "", 1, 0, "k"),
            (False, 5, gap, 42, 0, None),
            (False, 6, "", 42, 42, None),
            (False, 6, "", 42, 42, None),
            (False, 7, "few words\nfew words\nfew words", 3, 0, None),
            (True, 0, "own start", 6, 5, None),
        ],
        key=repr,
    )
    own = linededup.dedup(d, names=("a", "b"))
    assert own.columns == d.columns + ["a", "b"] and {r.n_lines for r in own.collect()} == {30.0, 1.0, None, 2.0, 0.0}
    assert linededup.dedup(d.limit(0)).count() == 0


def test_rows_without_an_id_are_documents_of_their_own(spark, tmp_path):
    run = "\n".join(f"line {i} of a passage that repeats" for i in range(5))
    rows = [(None, run), (None, run), (None, "own words\n" + run), (None, None), (4, run)]
    path = str(tmp_path / "docs")
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(path)
    for d, left in ((spark.createDataFrame(rows[:4], "doc_id long, text string"), 1), (spark.read.parquet(path), 1)):
        got = [r.text for r in linededup.dedup(d).collect()]
        assert sum(run in (t or "") for t in got) == left and got.count(None) == 1 and len(got) == d.count()
    kept = {r.doc_id for r in linededup.dedup(spark.read.parquet(path)).collect() if r.text == run}
    assert kept == {4}
