"""Steps that must not be repeated or grow with a batch, as larger tables would show."""

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from papyra.functions import language as L
from papyra.functions import sources as So
from papyra.operators import semantic as S
from papyra.plans import catalogue, compiler
from papyra.sources import ir


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.fixture
def names(monkeypatch):
    """Names of the tables that the compiler writes."""
    seen, real = [], S.written
    for m in (S, compiler):
        monkeypatch.setattr(m, "written", lambda df, n: seen.append(n) or real(df, n))
    monkeypatch.setattr(compiler, "_COMPILED", {})
    return seen


def test_relations_make_no_units(spark, sf, names):
    catalogue.queries()["graph_two_hop"](spark, sf)
    assert {"facts", "relations"} <= set(names) and not {"nodes", "named", "units"} & set(names)


def test_statements_are_cleaned_once(spark, sf):
    p = plan(S.stated(compiler.structured(spark, sf)))
    assert p.count("split(text") == 1 and p.count("\r;,") == 1


def test_statements_keep_their_places(spark):
    t = "Short. ;, The a.b is 1.5 of it now ;, . 这个系统必须使用全部数据进行完整的处理！x\u0001y is what is said here"
    d = spark.createDataFrame([(1, "t", t)], "doc_id long, title string, text string")
    s = S.stated(ir.nodes(d).withColumn("version", F.lit(None).cast("string"))).orderBy("pos").collect()
    assert [(r["pos"], r["text"]) for r in s] == [(1, "The a.b is 1.5 of it now"), (2, "这个系统必须使用全部数据进行完整的处理"), (3, "x.y is what is said here")]


@pytest.mark.parametrize("name", ["structure_faults", "piece_nodes"])
def test_texts_are_parsed_once(spark, sf, name):
    assert "MapIn" not in plan(catalogue.queries()[name](spark, sf))


def test_tokens_are_counted_once(spark):
    d = spark.createDataFrame([("Steel release 12 notes.md",)], "t string")
    assert plan(d.select(L.clip_to_tokens(F.col("t"), 5).alias("x"))).count("regexp_replace") == 1


def test_titles_are_cut_once(spark):
    d = spark.createDataFrame([("Steel release 12 notes.md",)], "t string")
    assert plan(d.select(So.version_in(F.col("t")).alias("x"))).count("regexp_extract_all") == 1


@pytest.mark.parametrize("texts", [True, False])
def test_nodes_leave_in_bounded_batches(texts):
    body = ["# a\n\n" + "b" * 1000 + "\n\n## c\n\nd", None, "", "e"] * 50
    b = pa.RecordBatch.from_pydict({"doc_id": list(range(200)), "title": ["t"] * 200, "text": body})
    out = list(ir.batched(iter([b]), texts, chars=5000, rows=64))
    assert all(x.num_rows <= 64 + 5 for x in out) and len(out) > 3
    got = [tuple(r.values()) for x in out for r in x.to_pylist()]
    want = [(i, "t", *r) if texts else (i, *r[:3]) for i, t in enumerate(body) for r in ir.parse(t)]
    assert got == want


def test_merge_makes_no_relations(spark, sf, names):
    catalogue.queries()["incremental_merge"](spark, sf)
    assert names.count("units") == 1 and not {"nodes", "relations"} & set(names)


class Seen(Exception):
    pass


def test_update_reads_its_own_documents(spark, sf, monkeypatch):
    def see(nodes):
        raise Seen(plan(nodes))

    monkeypatch.setattr(S, "compile_facts", see)
    with pytest.raises(Seen) as seen:
        catalogue.queries()["incremental_merge"](spark, sf)
    assert "% 10" in str(seen.value).split("MapInArrow")[1]


def units_of(spark, rows):
    kinds = "type string, key string, title string, content string, aliases array<string>, confidence double, status string, version string, superseded_by string, derived array<string>, sources array<string>"
    return spark.createDataFrame([(t, k, k, c, [], 0.5, "active", None, None, d, s) for t, k, c, d, s in rows], kinds)


def test_merge_reads_units_once(spark):
    """Units meet documents only where a summary or a source names one, and facts only where they state a version."""
    fact = ("Version 1.1 supports the cache", "Version 1.2 supports the cache", "plain words")
    old = units_of(spark, [("fact", "a", fact[0], [], ["1", "2", None]), ("fact", "b", fact[1], [], ["2"]), ("fact", "c", fact[2], [], ["1"]), ("concept", "x", "", ["fact:a", "fact:c"], []), ("concept", "y", "", ["fact:c"], []),
                           ("topic", "t", "", ["concept:y", "summary:summary:doc:1"], []), ("summary", "summary:doc:1", "", ["fact:a"], []), ("summary", "summary:doc:2", "", ["fact:a", "fact:c"], [])])
    m = S.merge_units(old, units_of(spark, [("fact", "d", "new", [], ["3"])]), spark.createDataFrame([(1,)], "doc_id long"))
    assert {(r.type, r.key): (r.status, r.superseded_by, r.derived, r.sources) for r in m.collect()} == {
        ("fact", "a"): ("superseded", "b", [], ["2"]), ("fact", "b"): ("active", None, [], ["2"]), ("fact", "d"): ("active", None, [], ["3"]),
        ("concept", "x"): ("active", None, ["fact:a"], []), ("summary", "summary:doc:2"): ("active", None, ["fact:a"], []),
    }
    p = plan(m)
    assert p.count("parquet") == 2 and "Window" not in p and "Aggregate" not in p


def test_texts_come_in_bounded_batches(spark, monkeypatch):
    def sizes(batches, texts):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"doc_id": pa.array([0]), "ord": pa.array([b.nbytes], pa.int32()), "type": pa.array(["n"]), "parent": pa.array([0], pa.int32())})

    monkeypatch.setattr(ir, "batched", sizes)
    d = spark.range(0, 200, 1, 1).select(F.col("id").alias("doc_id"), F.lit("t").alias("title"), F.repeat(F.lit("x"), 100_000).alias("text"))
    seen = [r["ord"] for r in ir.nodes(d, False).collect()]
    assert sum(seen) > 20_000_000 and max(seen) < ir.TAKEN_BYTES + 200_000


def test_facts_meet_concepts_once_made(spark, sf):
    """Texts are parsed for the facts alone, not again for those that no concept is found in."""
    assert "MapIn" not in plan(catalogue.queries()["fact_concept_match"](spark, sf))


def test_nodes_are_sent_to_no_task(spark, sf):
    """Nodes take few bytes of files; that must not make Spark collect their ids and send them about."""
    df = catalogue.queries()["structure_faults"](spark, sf)
    assert df.collect()
    p = df._jdf.queryExecution().executedPlan().toString()
    assert "isFinalPlan=true" in p and "Broadcast" not in p


def test_each_fault_is_told(spark):
    rows = [(1, 0, "document", None), (1, 1, "p", 2), (1, 2, "p", 0), (1, 3, "p", 9), (2, 0, "document", None), (2, 1, "p", 0), (2, 1, "p", 0), (3, 1, "p", None)]
    n = ir.bound(spark.createDataFrame(rows, "doc_id long, ord int, type string, parent int"))
    own = n.select("doc_id", "node_id", "ord").distinct()
    got = sorted(((r.doc_id, r.ord or -1, r.fault) for r in ir.faults(n).join(own, ["doc_id", "node_id"], "left").collect()))
    assert got == [(1, 1, "parent comes later"), (1, 3, "missing parent"), (2, 1, "repeated id"), (3, -1, "no document node")]


def test_two_hops_take_every_statement(spark, tmp_path):
    """Statements of a text count however many there are."""
    lines = "\n".join(f"The first part is {i}a. The second part is {i}b. The third part is {i}c." for i in range(60))
    p = str(tmp_path / "documents.parquet")
    duckdb.sql(f"COPY (SELECT 1::BIGINT AS doc_id, '{lines}' AS text, 'en' AS lang, 'web' AS source, 1::BIGINT AS n_chars) TO '{p}' (FORMAT parquet)")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{p}'")
    got = catalogue.queries()["graph_two_hop"](spark, str(tmp_path)).collect()
    assert len(got) == 60 and {tuple(r) for r in got} == set(con.execute(catalogue.oracle_sql()["graph_two_hop"]).fetchall())
