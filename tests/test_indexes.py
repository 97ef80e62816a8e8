"""The indexes of words and of parts of words: counted without shuffles, many questions scored as one by one."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from papyra.operators import lexical as Lex
from papyra.operators import trigrams as T


def chunks(spark):
    texts = ["red fox runs, red!", "the red dog", "", None, "a redder bird 7", "the the the", "green frog 12"]
    return spark.createDataFrame([(i // 2, i % 2, t) for i, t in enumerate(texts)], "doc_id long, idx long, text string")


def test_words_are_counted_within_a_row(spark):
    index = Lex.build(chunks(spark))
    got = {(r.term, r.doc_id, r.idx): (r.tf, r.len) for r in index.postings.collect()}
    assert got["red", 0, 0] == (2, 4) and got["the", 2, 1] == (3, 3) and len(got) == 12
    assert (index.chunks, index.average) == (7, 15 / 6)


def test_many_questions_join_no_chunks(spark):
    index = Lex.build(chunks(spark))
    q = spark.createDataFrame([(0, "red the"), (1, "zzz"), (2, ""), (3, "the")], "question int, text string")
    df = Lex.bm25_many(index, q, 2)
    assert "Join" not in df._jdf.queryExecution().optimizedPlan().toString()
    got = [(r.question, r.doc_id, r.idx, r.score) for r in df.orderBy("question", "rank").collect()]
    for n, text in ((0, "red the"), (3, "the")):
        one = [(n, r.doc_id, r.idx, r.score) for r in Lex.bm25(index, text).orderBy(F.desc("score"), "doc_id", "idx").limit(2).collect()]
        assert [r for r in got if r[0] == n] == one
    assert {r[0] for r in got} == {0, 3}


def test_documents_of_one_id_are_counted_together(spark):
    d = spark.createDataFrame([(1, "red red"), (1, "red fox"), (2, "fox"), (None, "fox"), (None, "fox")], "doc_id long, text string")
    got = sorted(((r.doc_id or 0, r.term, r.tf) for r in Lex.by_document(d).collect()))
    assert got == [(0, "fox", 2), (1, "fox", 1), (1, "red", 3), (2, "fox", 1)]


def test_many_questions_for_parts_of_words_find_what_each_finds(spark):
    index = T.build(chunks(spark))
    assert {r.word for r in index.grams.filter("gram = 'red'").collect()} == {"red", "redder"}
    asked = ["EDD", "red the", "7", "ird 7", "ird 8", "zzz", "", "een 12"]
    many = spark.createDataFrame([(i, asked[i % len(asked)]) for i in range(T.FEW + 8)], "question int, text string")
    got = {}
    for r in T.search(index, many, 3).orderBy("question", "rank").collect():
        got.setdefault(r.question, []).append((r["rank"], r.doc_id, r.idx, r.score))
    few = {}
    for r in T.search(index, many.limit(len(asked)), 3).orderBy("question", "rank").collect():
        few.setdefault(r.question, []).append((r["rank"], r.doc_id, r.idx, r.score))
    assert few.keys() == {0, 1, 2, 3, 7} and all(got.get(i) == few.get(i % len(asked)) for i in range(T.FEW + 8))


@pytest.fixture
def forms(monkeypatch):
    """Names of the forms of an index that are written."""
    seen, real = [], Lex.written
    monkeypatch.setattr(Lex, "written", lambda df, n: seen.append(n) or real(df, n))
    return seen


def test_one_question_writes_postings_alone(spark, forms):
    index = Lex.build(chunks(spark))
    assert Lex.bm25(index, "red fox").count() == 2 and forms == ["postings"] and (index.chunks, index.average) == (7, 15 / 6)


def test_many_questions_write_no_postings(spark, forms):
    index = Lex.build(chunks(spark))
    assert Lex.bm25_many(index, spark.createDataFrame([(0, "red fox")], "question int, text string"), 9).count() == 2
    assert "postings" not in forms and (index.chunks, index.average) == (7, 15 / 6)
    assert index.postings.count() == 12 and forms.count("counted") == 1


def test_no_chunks_are_an_index(spark):
    index = Lex.build(chunks(spark).limit(0))
    assert Lex.bm25(index, "red").count() == 0 and (index.chunks, index.average) == (0, 0.0)


def test_tasks_are_dealt_by_bytes(spark, tmp_path, monkeypatch):
    """However few partitions a shuffle has, a task sorts the postings of so many bytes of files."""
    monkeypatch.setattr(Lex, "DEALT", 200)
    chunks(spark).coalesce(1).write.parquet(str(tmp_path / "c"))
    c = spark.read.parquet(str(tmp_path / "c"))
    n = -(-sum(f.stat().st_size for f in (tmp_path / "c").glob("*.parquet")) // 200)
    assert n > 4 and Lex.dealt(c).rdd.getNumPartitions() == n


def test_a_gold_run_asks_every_word(spark, tmp_path):
    """A passage of short words alone is asked too."""
    import duckdb

    from papyra.plans import catalogue

    con = duckdb.connect()
    con.execute("CREATE TABLE documents AS SELECT i::BIGINT AS doc_id, t AS text, 'en' AS lang, 'web' AS source, 9::BIGINT AS n_chars FROM (VALUES (1, 'a red fox ran off at noon'), (2, 'blue birds sing in the old tree'), (3, 'something altogether different')) v(i, t)")
    con.execute("CREATE TABLE benchmark AS SELECT i::BIGINT AS item_id, t AS text FROM (VALUES (1, 'red fox ran off at'), (2, 'something altogether')) v(i, t)")
    for t in ("documents", "benchmark"):
        con.execute(f"COPY {t} TO '{tmp_path}/{t}.parquet' (FORMAT parquet)")
    got = sorted(tuple(r) for r in catalogue.queries()["gold_run"](spark, str(tmp_path)).collect())
    assert got == sorted(con.execute(catalogue.oracle_sql()["gold_run"]).fetchall()) == [(1, 1.0, True, False, True), (2, 1.0, True, False, True)]


def test_many_questions_for_parts_of_words_read_texts_once(spark, monkeypatch):
    """They write no words and no dictionary, and texts are cut into words by one pass."""
    seen, real = [], T.written
    monkeypatch.setattr(T, "written", lambda df, n: seen.append(n) or real(df, n))
    index = T.build(chunks(spark))
    assert (index.chunks, index.average) == (7, 58 / 7)
    q = spark.createDataFrame([(i, "edd 7" if i % 2 else "reen") for i in range(T.FEW + 8)], "question int, text string")
    assert {(r.question % 2, r.doc_id, r.idx) for r in T.search(index, q, 3).collect()} == {(0, 3, 0), (1, 2, 0)}
    assert seen == ["texts", "holding", "scored"]
    assert index.counts.count() and seen[3:] == ["words", "grams", "gram-counts"]


def test_terms_add_to_the_questions_that_ask_them(monkeypatch):
    rng = np.random.default_rng(1)
    weights = rng.random((9, 5)) * (rng.random((9, 5)) < 0.4)
    chunk = np.sort(rng.integers(0, 30, 200))
    term, part = rng.integers(0, 9, 200), rng.random(200)
    want = np.zeros((31, 5))
    np.add.at(want, chunk, weights[term] * part[:, None])
    for added in (32, 32 * 40, 32 << 20):
        monkeypatch.setattr(Lex, "ADDED", added)
        assert np.allclose(Lex.summed(chunk, part, weights, term, 31), want, atol=1e-12)
    assert not Lex.summed(chunk[:0], part[:0], weights, term[:0], 31).any()
