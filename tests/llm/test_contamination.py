"""Decontamination against plain windows; cut texts; defined results of odd rows."""

import hashlib
import re

import numpy as np
import pytest

from papyra.llm import contamination as C

LOW = {i: i + 32 for i in range(65, 91)}


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOW))


def plain(docs, tests, n=10):
    """(words, hit words, items) of each text by all windows of all items."""
    wins = {}
    for item, t in tests:
        w = words(t)
        m = min(len(w), n)
        for i in range(len(w) - m + 1 if m else 0):
            wins.setdefault(tuple(w[i : i + m]), set()).add(item)
    sizes, out = {len(w) for w in wins}, []
    for t in docs:
        w, hit, items = words(t), set(), set()
        for m in sizes:
            for i in range(len(w) - m + 1):
                found = wins.get(tuple(w[i : i + m]))
                if found is not None:
                    hit |= set(range(i, i + m))
                    items |= found - {None}
        out.append((len(w), len(hit), len(items), hashlib.sha256(",".join(sorted(map(str, items))).encode()).hexdigest(), bool(hit)))
    return out


def made(seed=0):
    rng = np.random.default_rng(seed)
    few = [f"w{i}" for i in range(6)]
    tests = [(i, " ".join(rng.choice(few, rng.integers(1, 40)))) for i in range(40)] + [(5, "other text of item five, " * 3), (None, "nameless words stand here"), (77, None), (78, " -- ")]
    docs = []
    for i in range(120):
        w = list(rng.choice(few, rng.integers(0, 300)))
        if i % 3 == 0:
            w.insert(0, tests[i % 40][1].upper().replace(" ", ", "))
        docs.append((i % 100, " ".join(w)))
    return docs + [(None, "Nameless WORDS stand. here"), (1, None), (2, ""), (3, "ünï 知识 × "), (3, "ünï 知识 × ")], tests


@pytest.mark.parametrize("set_bytes", [C.SET_BYTES, 700])
def test_hits_are_those_of_all_windows(spark, set_bytes, tmp_path):
    docs, tests = made()
    path = str(tmp_path / "docs")
    spark.createDataFrame(docs, "doc_id long, text string").repartition(3).write.parquet(path)
    d = spark.read.parquet(path)
    b = spark.createDataFrame(tests, "item_id long, text string")
    got = C.scan(d, b, set_bytes=set_bytes).collect()
    want = [(i, *r) for (i, _), r in zip(docs, plain([t for _, t in docs], tests), strict=True)]
    assert sorted(map(repr, ((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got))) == sorted(map(repr, want))
    assert all(sum(s["to"] - s["from"] for s in r.spans) == r.n_hit and all(a["to"] < b["from"] for a, b in zip(r.spans, r.spans[1:])) for r in got)
    assert C.scan(d.limit(0), b, set_bytes=set_bytes).count() == 0 and not any(r.n_hit for r in C.scan(d, b.limit(0)).collect())


def test_long_tests_are_cut_into_segments_without_loss(spark, monkeypatch):
    monkeypatch.setattr(C, "SEGMENT", 7)
    docs, tests = made(1)
    segments = next(C._segments(10)([__import__("pandas").DataFrame({"item": ["a"], "text": [" ".join(f"x{i}" for i in range(50))]})]))
    assert len(segments) == 6 and segments["words"].str.len().max() < 80
    rows = [(None if i is None else str(i), w) for b in C._segments(10)([__import__("pandas").DataFrame(tests, columns=["item", "text"]).astype({"item": object})]) for i, w in b.itertuples(index=False) if not (isinstance(i, float) and i != i)]
    named = [(i, t) for i, t in tests if i is not None]
    got = [(n, sum(s["to"] - s["from"] for s in spans)) for n, spans, _ in C.Tests([(str(int(float(i))), w) for i, w in rows], 10).scan([t for _, t in docs])]
    assert got == [r[:2] for r in plain([t for _, t in docs], named)]


def test_a_hash_alone_is_no_hit():
    t = C.Tests([("a", b"one two three")], 10)
    t.sets[0].words = [b"one", b"two", b"four"]
    assert list(t.scan(["one two three"])) == [(3, [], [])]


def test_spans_or_documents_are_removed_and_columns_stay(spark):
    item = "Which of these words, of ten or more, was in the test?"
    rows = [(1, "Start. which of THESE words of ten or more was in the test! End", 5, "x", None), (2, "clean", None, None, 3), (3, None, 1, "y", 4), (4, item, 1, "z", 4)]
    d = spark.createDataFrame(rows, "doc_id long, text string, items long, spans string, __n long")
    b = spark.createDataFrame([(9, item, "extra")], "item_id long, text string, n_words string")
    cut = C.clean(d, b)
    assert cut.columns == d.columns
    assert {r.doc_id: (r.text, r["items"], r.spans, r["__n"]) for r in cut.collect()} == {1: ("Start. ! End", 5, "x", None), 2: ("clean", None, None, 3), 3: (None, 1, "y", 4), 4: ("?", 1, "z", 4)}
    left = C.clean(d, b, remove="documents")
    assert left.columns == d.columns and {r.doc_id for r in left.collect()} == {2, 3}
    pieces = C.clean(d, spark.createDataFrame([(9, item), (10, "clean"), (11, "was in the test")], "item_id long, text string"), set_bytes=20)
    assert {r.doc_id: r.text for r in pieces.collect()} == {1: "Start. ! End", 2: "", 3: None, 4: "?"}
    with pytest.raises(ValueError):
        C.clean(d, b, remove="all")


def test_very_long_text(spark):
    text = " ".join(f"w{i % 997}" for i in range(300_000))
    r = C.scan(spark.createDataFrame([(1, text)], "doc_id long, text string"), spark.createDataFrame([("i", " ".join(f"w{i}" for i in range(990, 997)) + " w0 w1 w2")], "item_id string, text string")).first()
    assert r.n_words == 300_000 and r.n_hit == 300 * 10 and r.n_items == 1
