"""From a question to an answer: modes, policies, and the text of a package."""

import pytest

from papyra.functions import questions as Q
from papyra.operators import answering as A
from papyra.operators import context as C
from papyra.operators import search as Se
from papyra.operators import semantic as S
from papyra.operators import trigrams as T
from papyra.sources import ir

TEXTS = {
    1: ("Alpha guide", "# Setup\n\nversion 1.0 supports ten users.\n\nThe red service requires a key."),
    2: ("Beta guide", "# Setup\n\nversion 2.0 supports ten users.\n\nThe red service uses a lock."),
}


@pytest.fixture(scope="module")
def base(spark):
    docs = spark.createDataFrame([(i, t, "s", None, 1, "ready", "GOOD") for i, (t, _) in TEXTS.items()], "doc_id long, title string, source string, updated int, created int, status string, quality string")
    nodes = ir.nodes(spark.createDataFrame([(i, t, x) for i, (t, x) in TEXTS.items()], "doc_id long, title string, text string")).selectExpr("*", "cast(null as string) AS version")
    chunks = nodes.filter("type = 'paragraph'").selectExpr("doc_id", "cast(ord as long) AS idx", "array_join(path, ' / ') AS heading", "text")
    return Se.Library(docs, chunks, None, None, T.build(chunks)), S.compile_units(nodes)


def test_modes_take_what_they_ask_for(base):
    lib, known = base
    q = "what does the red service require"
    both = A.ask(q, lib, known)
    assert both.mode == "hybrid" and both.hits and both.units and both.package.tokens <= both.package.budget and not both.degraded
    assert [h["doc_id"] for h in both.hits] == sorted(h["doc_id"] for h in both.hits) and all(h["citation"].startswith("[source: ") for h in both.hits)
    alone = A.ask(q, lib, known, mode="evidence")
    assert alone.hits == both.hits and not alone.units and alone.package is None
    knowing = A.ask(q, lib, known, mode="semantic")
    assert knowing.units == both.units and not knowing.hits and "requires a key" in str(knowing.units)
    assert A.ask(q, lib, mode="nonsense").mode == "evidence" and A.ask(q, None, known).mode == "semantic"
    assert A.ask(q, None, known, mode="hybrid").degraded == ["no passages"] and A.ask(q, lib, None, mode="hybrid").degraded == ["no compiled knowledge"]
    assert A.ask(q, lib, known, vector=None, options=Se.Options(mode="vector")).degraded == ["no vectors"]
    assert A.ask("  ", lib, known).hits == []


def test_a_policy_goes_before_what_the_question_says(base):
    lib, known = base
    q = "how many users are supported"
    said = lambda **p: {u["content"] for u in A.ask("version supports ten users", None, known, policy=A.Policy(**p) if p else None).units if u["type"] == "fact" and "ten users" in u["content"]}
    assert said(kind="current") == {"version 2.0 supports ten users"} and said(kind="as_of", as_of="1.0") == {"version 1.0 supports ten users"}
    assert said(kind="all") == {"version 1.0 supports ten users", "version 2.0 supports ten users"}
    assert A.ask(q, lib, known, policy=A.Policy("range", start="1.0", end="2.0")).temporal == "range_history" and A.ask("what did 1.0 support", None, known).temporal == "explicit_version"
    for bad in (A.Policy("current", as_of="1.0"), A.Policy("as_of"), A.Policy("range", start="2.0", end="1.0"), A.Policy("other"), A.Policy(as_of="1.0")):
        with pytest.raises(ValueError):
            A.ask(q, lib, known, policy=bad)


def test_the_text_of_a_package(spark, base):
    lib, known = base
    versions = spark.createDataFrame([(1, "1.0"), (2, "2.0")], "doc_id long, version string")
    p = A.ask("what did 1.0 support for ten users", lib, known, versions=versions, options=Se.Options(radius=0)).package
    assert p.text == EXPECTED, p.text


def test_what_units_are_made_from_stays_where_it_is(spark, monkeypatch):
    """A concept of many facts: relations of all of them are found, the first by type and ends, and no list of them is collected."""
    kinds = "type string, key string, title string, content string, aliases array<string>, confidence double, status string, version string, superseded_by string, derived array<string>, sources array<string>"
    many = [f"k{i:03}" for i in range(300)]
    rows = [("concept", "engine", "engine", "", [], 0.7, "active", None, None, ["fact:" + k for k in many], ["1"]), *(("fact", k, "t", f"said {k}", [], 0.7, "active", None, None, [], ["1"]) for k in [*many, "z1", "z2"])]
    units = spark.createDataFrame(rows, kinds)
    pairs = [("k001", "k000"), ("z1", "k002"), ("k002", "z1"), ("k003", "k003"), ("z1", "z2"), ("z2", "z2"), *((k, "k000") for k in many[4:])]
    relations = spark.createDataFrame([("related_to", a, b, f"{a} to {b}", 0.7) for a, b in pairs], "type string, subject string, object string, statement string, confidence double")
    near = spark.createDataFrame([(k,) for k in ["k002", "k003", "k003", "zz"]], "key string")
    assert [r.statement for r in C.adjacent(relations, near, 9)] == ["k002 to z1", "k003 to k003", "z1 to k002"]
    assert [r.statement for r in C.adjacent(relations, near, 2)] == ["k002 to z1", "k003 to k003"]
    seen, kind = [], type(units)
    real = kind.collect
    monkeypatch.setattr(kind, "collect", lambda self: seen.append(self.columns) or real(self))
    lines = C._lines(units, relations, Q.route("why does the engine cause it"), "why does the engine cause it", None)
    assert seen and not any("derived" in c for c in seen)
    assert lines["relations"][:3] == ["k001 to k000", "k002 to z1", "k003 to k003"] and lines["concepts"] == ["engine (confidence 0.70, 301 evidence pointers)"]
    assert lines["facts"] == [f"said k{i:03}" for i in range(12)]


EXPECTED = """# Knowledge Context
Query: what did 1.0 support for ten users
## Temporal selection
- intent: explicit_version
- version: 1.0
## Critical facts
- version 1.0 supports ten users

## Exact evidence
[1] Alpha guide / Setup
>>> [Setup] version 1.0 supports ten users.

## Citations
[1] Alpha guide#2
"""
