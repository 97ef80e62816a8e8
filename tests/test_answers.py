"""Questions, windows, search options, contexts, dictionaries and library states on small cases."""

import datetime

import pytest
from pyspark.sql import functions as F

from papyra.functions import dictionary as D
from papyra.functions import language as L
from papyra.functions import questions as Q
from papyra.functions import text as X
from papyra.operators import context as C
from papyra.operators import dictionaries as Di
from papyra.operators import evidence as E
from papyra.operators import graph as G
from papyra.operators import library as Li
from papyra.operators import search as Se
from papyra.operators import semantic as S
from papyra.sources import ir


def val(spark, f, *values):
    d = spark.createDataFrame([values], ", ".join(f"c{i} {'string' if isinstance(v, str) or v is None else 'array<string>' if isinstance(v, list) else 'long'}" for i, v in enumerate(values)))
    return d.select(f(*(F.col(f"c{i}") for i in range(len(values)))).alias("x")).first()["x"]


def test_terms_of_questions(spark):
    assert val(spark, L.lexical_terms, "do 知识库管理 page 12 of AB c_d") == ["c_d", "page", "库管理", "知识库", "识库管"]
    assert val(spark, L.locator_terms, "page 12 of E2 or 123") == ["12", "E2"]
    assert val(spark, L.search_terms, "The 知识库 a 5G 网") == ["the", "知识", "识库", "5g", "网"]
    assert val(spark, L.schema_terms, "user_id 用户状态x") == ["user_id", "用户", "状态"]
    assert val(spark, L.topic_keywords, "请问什么是 Traffic KPI") == ["问什", "么是", "traffic", "kpi"]
    assert val(spark, L.strict_identifiers, "id 123456 x1234567 AB-1 www.a1.com http://x9 ab-1") == ["123456", "x1234567", "AB-1"]
    assert L.separator("a\\nb\\t") == "a\nb\t" and L.separator(None) == "\n\n"


def test_texts_as_search_sees_them(spark):
    assert val(spark, L.projection, "知�3a�b,�c\x07d\t") == "知 3a b,cd"
    assert val(spark, L.fold_cjk_spaces, "知 识　库 a 知\n识") == "知识库 a 知\n识"
    assert val(spark, lambda c: L.fit_to_tokens(c, 2), "知识库abcd") == "知识库" and val(spark, lambda c: L.fit_to_tokens(c, 0), "x") == ""
    assert val(spark, X.sentences, "Use 1.2.3 of a.b.c now. Done! v2.x") == ["Use 1.2.3 of a.b.c now", "Done", "v2", "x"]
    facts = ("https://x.y is here and long", "see https://x.y as it is good", "系统支持知识库检索与管理功能呢呢呢", "name: value of sixteen", "nothing stated at all here")
    assert [val(spark, X.is_fact, t) for t in facts] == [False, True, True, True, False]
    assert [val(spark, X.is_concept, k) for k in ("overview", "v1.2", "http x", "knowledge base", "知识", "--")] == [False, False, False, True, True, False]
    assert not val(spark, X.is_heading_concept, "1. Step", "1. step")


def test_dictionary_rules(spark):
    got = val(spark, D.enum_values, "1：开;0=off|x; :y")
    assert [(e["value"], e["label"]) for e in got] == [("1", "开"), ("0", "off"), ("x", ""), ("y", "")]
    assert val(spark, D.aliases, "User_Id") == ["User_Id", "user id", "user_id"]
    assert val(spark, D.concepts, "5G user state") == ["User Identifier", "Status", "Network Generation"]
    assert [val(spark, D.column_name, n) for n in (1, 26, 27, 703)] == ["A", "Z", "AA", "AAA"] and val(spark, D.column_number, "AB12") == 28
    assert val(spark, D.is_title, ["", "Orders"]) and not val(spark, D.is_title, ["a", "b"])


def test_routes_and_ranges():
    assert Q.route("What is the latest version?").intent == "temporal" and Q.route("canvas and adverse parts").intent == "fact"
    assert Q.route("summarize the release history").temporal.intent == "historical"
    r = Q.parse_range("from v2.0 to 1.2")
    assert (r.kind, r.start, r.end) == ("version", "1.2", "2.0") and r.holds("1.10") and not r.holds("2.0.1") and not r.holds("rel-3") and not r.holds("1.5-beta")
    assert Q.parse_range("before 1.5").holds("1.4.9") and not Q.parse_range("before 1.5").holds("1.5") and Q.parse_range("until 1.5").holds("1.5")
    assert Q.parse_range("after the great merge?").start == "the great merge" and Q.parse_range("recent changes").ambiguous and Q.parse_range("plain words") is None
    t = Q.parse_range("since 2024-02-30")
    assert t is None or t.kind != "time"
    assert Q.parse_temporal("knowledge of snow").intent == "none" and Q.parse_temporal("什么时候引入").intent == "evolution"
    assert Q.policy("as_of", as_of="v1.2").versions == ["1.2"] and Q.policy("range", start="1.2", end="1.10").span.holds("1.9")
    for bad in ({"kind": "current", "as_of": "1"}, {"kind": "range", "start": "2.0", "end": "1.0"}, {"kind": "range", "start": "2.0", "end": "rel-3"}, {"kind": "never"}, {"kind": "as_of"}):
        with pytest.raises(ValueError):
            Q.policy(**bad)


def test_scopes_modes_pools(spark):
    assert Q.scope(False, None, ["a"]) == [] and Q.scope(True, [], None) == [] and Q.scope(True, ["a", "b"], ["b", "c", "a"]) == ["b", "a"] and Q.scope(True, None, None) is None
    assert Q.agent_scope({"a": True, "b": True}, ["b", "a", "b"]) == ["a", "b"]
    for error, asked in ((KeyError, ["x"]), (PermissionError, ["a"])):
        with pytest.raises(error):
            Q.agent_scope({"a": False}, asked)
    assert (Q.mode("vector", False), Q.mode("", True), Q.mode("odd", False)) == ("lexical", "hybrid", "lexical")
    assert (Q.pool(None), Q.pool(99), Q.pool(2)) == ((4, 12), (50, 150), (2, 12))
    assert Q.variants(" a ", ["b", "a", "", "c", "d", "e"]) == ["a", "b", "c", "d"]
    assert G.bounds(hops=9, nodes=-1) == {"hops": 4, "nodes": 64, "fan_out": 16, "seeds": 8}
    d = spark.createDataFrame([(1,), (2,), (3,)], "doc_id long")
    assert [d.filter(Se.in_scope(F.col("doc_id"), ids)).count() for ids in (None, [], [1, 3, 9])] == [3, 0, 2]
    with pytest.raises(ValueError):
        Se.in_scope(F.col("doc_id"), list(range(501)))


def test_windows_keep_budget_heading_and_order():
    chunks = [(i, "h" if i != 4 else "k", f"Sentence {i} begins. " + "word " * 40 + f"It ends {i}.") for i in range(8)]
    text, first, last = E.compose(chunks, 2, radius=3, budget=10_000)
    assert (first, last) == (0, 3) and text.split("\n\n")[2].startswith(">>> [h] Sentence 2")
    for budget in (1, 5, 20, 50, 77, 130, 300):
        text, first, last = E.compose(chunks, 2, radius=3, budget=budget, focus="ends")
        assert Q.tokens(text) <= budget and first <= 2 <= last
    assert "ends 2" in E.compose(chunks, 2, budget=30, focus="ends 2")[0]
    gap = [c for c in chunks if c[0] != 1]
    assert E.compose(gap, 2, radius=3, budget=10_000)[1] == 2
    shared = "this stretch is held by both of the chunks"
    text, *_ = E.compose([(0, "", "left " + shared), (1, "", shared + " middle " + shared), (2, "", shared + " right")], 1, budget=1000)
    assert text.count(shared) == 2


def test_structure_of_texts(spark):
    rows = ir.parse("intro\n\n# A\n\n### B\n\npara\n\n#\n\n# C\n\nlast")
    assert [(r[1], r[3], r[4]) for r in rows[1:]] == [("paragraph", "intro", []), ("heading", "A", ["A"]), ("heading", "B", ["A", "B"]), ("paragraph", "para", ["A", "B"]), ("heading", "C", ["C"]), ("paragraph", "last", ["C"])]
    n = ir.nodes(spark.createDataFrame([(1, "t", None), (2, "t", "")], "doc_id long, title string, text string"))
    assert n.count() == 2 and ir.faults(n).count() == 0 and ir.pieces(n).count() == 0


def compiled(spark, texts):
    docs = spark.createDataFrame([(i, f"Guide {i}", t) for i, t in enumerate(texts)], "doc_id long, title string, text string")
    return S.compile_units(ir.nodes(docs).withColumn("version", F.lit(None).cast("string")))


def test_compiler_supersedes_and_relates(spark):
    units, relations = compiled(spark, ["# Scheduler\n\nVersion 1.0 supports 10 retry queues. The scheduler is a part of it.", "# Scheduler\n\nVersion 2.0 supports 20 retry queues. Version 3.0 supports retry queues."])
    status = {r["content"]: r["status"] for r in units.filter("type = 'fact'").collect()}
    assert status["Version 1.0 supports 10 retry queues"] == status["Version 2.0 supports 20 retry queues"] == "superseded" and status["Version 3.0 supports retry queues"] == "active"
    kinds = {r["type"]: r["n"] for r in relations.groupBy("type").agg(F.count("*").alias("n")).collect()}
    assert kinds == {"related_to": 2, "supersedes": 2}
    assert S.faults(units, relations).count() == 0
    c = units.filter("type = 'concept' AND key = 'scheduler'").first()
    assert len(c["derived"]) == 4 and c["content"].startswith("Scheduler appears in 2 source document(s). Observed headings: Scheduler")
    left = S.merge_units(units, units.limit(0), spark.createDataFrame([(1,)], "doc_id long"))
    by = {r["content"]: r["status"] for r in left.filter("type = 'fact'").collect()}
    assert by == {"Version 1.0 supports 10 retry queues": "active", "The scheduler is a part of it": "active"}
    assert left.filter("type = 'summary'").count() == 1
    package = C.compile_context(units, relations, spark.createDataFrame([(0, 1, "Guide 0", "", "The scheduler is a part of it", 1.0, None)], "doc_id long, chunk long, title string, heading string, text string, score double, version string"), "why does the scheduler lead to retry", 600)
    assert package.intent == "multi_hop" and package.tokens <= 600 and package.citations == ["[1] Guide 0#1"] and package.sections["relations"]


def test_versions_decide_what_is_seen(spark):
    u = spark.createDataFrame([("1.0", "superseded"), ("2.0", "active"), (None, "active"), ("2.0", "deleted")], "version string, status string")
    seen = lambda q: [r["version"] for r in u.filter(C.visible(Q.parse_temporal(q))).collect()]
    assert seen("what did 1.0 do") == ["1.0", None] and seen("current") == ["2.0", None] and seen("before 1.5") == ["1.0", None] and seen("plain") == ["2.0", None]
    assert C.current_version(u) == "2.0" and C.current_version(u.union(spark.createDataFrame([("rel-3", "active")], u.schema))) is None


def test_search_falls_back_when_a_reranker_fails(spark):
    hits = spark.createDataFrame([(1, 0, 1.0, None), (2, 0, 2.0, None), (3, 0, 3.0, None)], "doc_id long, idx long, place double, rerank_score double")
    chunks = spark.createDataFrame([(1, 0, "a"), (2, 0, "b"), (3, 0, "c")], "doc_id long, idx long, text string")
    told, failed = Se.reranked(hits, chunks, "q", lambda q, t: [0.1, 0.9], 2)
    assert failed is None and [(r.doc_id, r.place, r.rerank_score) for r in told.orderBy("place").collect()] == [(2, 1.0, 0.9), (1, 2.0, 0.1)]
    for broken, said in ((lambda q, t: [2.0, 0.1], "beyond"), (lambda q, t: [0.5], "1 scores for 2"), (lambda q, t: 1 / 0, "ZeroDivisionError")):
        same, failed = Se.reranked(hits, chunks, "q", broken, 2)
        assert said in failed and [r["rerank_score"] for r in same.collect()] == [None] * 3


@pytest.fixture(scope="module")
def small_library(spark):
    from papyra.operators import lexical as Lex
    from papyra.operators import trigrams as T

    texts = ["red fox runs", "red red dog", "blue cat sleeps", "a redder bird", "green frog", "red fish"]
    docs = spark.createDataFrame([(i, f"t{i}", "s", None, 1, "ready", "LOW_QUALITY" if i == 1 else "INCOMPLETE" if i == 5 else "GOOD") for i in range(6)], "doc_id long, title string, source string, updated int, created int, status string, quality string")
    chunks = spark.createDataFrame([(i, 0, "", t) for i, t in enumerate(texts)], "doc_id long, idx long, heading string, text string")
    vectors = spark.createDataFrame([(i, 0, "m", v) for i, v in enumerate([[1.0, 0.0], [0.8, 0.6], [0.9, 0.1], [0.0, 1.0], [0.3, 0.9]])], "doc_id long, idx long, model string, embedding array<double>")
    anchors = spark.createDataFrame([(i, 0, [i], [i % 2], ["Sheet A" if i % 2 else "b"], ["table"]) for i in range(5)], "doc_id long, idx long, pages array<int>, slides array<int>, sheets array<string>, types array<string>")
    return Se.Library(docs, chunks, Lex.build(chunks), vectors, T.build(chunks), anchors)


def ids(hits):
    return [r.doc_id for r in hits.orderBy("rank").collect()]


def test_thresholds_hold_for_the_relevance_of_the_mode(spark, small_library):
    lib, q, v = small_library, "red fox", [1.0, 0.0]
    # 0, 1 and 3 hold a term, 2 is near; 4 is no match and far, 5 isn't extracted, 1 comes last
    assert ids(Se.search(lib, q, v)) == [0, 3, 2, 1] and ids(Se.search(lib, q, v, Se.Options(mode="vector"))) == [0, 2, 1]
    assert ids(Se.search(lib, q, v, Se.Options(mode="vector", threshold=0.85))) == [0, 2]
    assert ids(Se.search(lib, q, v, Se.Options(threshold=0.99))) == [0]
    low = Se.search(lib, q, v, Se.Options(mode="lexical"))
    scores = {r.doc_id: r.lexical_score for r in low.collect()}
    assert set(scores) == {0, 1, 3} and all(r.relevance == round(r.lexical_score, 6) and r.score == r.lexical_score for r in low.collect())
    assert ids(Se.search(lib, q, v, Se.Options(mode="lexical", threshold=max(scores.values())))) == [0]
    # a reranker's scores are the relevance, and only those it judged stay
    judged = Se.search(lib, q, v, Se.Options(top_k=3, rerank=lambda q, t: [0.2, 0.9, 0.5], threshold=0.3))
    assert [(r.doc_id, r.relevance, r.score) for r in judged.orderBy("rank").collect()][0][1:] == (0.9, 0.9) and judged.count() == 2


def test_what_search_could_not_do_is_told(spark, small_library):
    lib, q, v = small_library, "red fox", [1.0, 0.0]
    said = lambda hits: {(r["mode"], r.degraded) for r in hits.collect()}
    assert said(Se.search(lib, q, v)) == {("hybrid", None)} and said(Se.search(lib, q, None)) == {("lexical", None)}
    assert said(Se.search(lib, q, None, Se.Options(mode="hybrid"))) == {("lexical", "no vectors")}
    assert said(Se.search(lib, q, v, Se.Options(mode="vector", model="other"))) == {("lexical", "no vectors of this model")}
    assert "TimeoutError" in list(said(Se.search(lib, q, v, Se.Options(rerank=lambda q, t: (_ for _ in ()).throw(TimeoutError())))))[0][1]


def test_search_by_structure(spark, small_library):
    lib, q, v = small_library, "red fox", [1.0, 0.0]
    find = lambda **w: ids(Se.search(lib, q, v, Se.Options(structure=Se.Structure(**w))))
    assert find(pages=[0, 3]) == [0, 3] and find(sheets=[" SHEET a"]) == [3, 1] and find(slides=[0], types=["Table"]) == [0, 2] and find(types=["cell"]) == []
    assert len(find()) == 4
    with pytest.raises(ValueError):
        Se.search(Se.Library(lib.documents, lib.chunks, lib.index), q, None, Se.Options(structure=Se.Structure(pages=[1])))


def test_parts_of_words_are_found(spark, small_library):
    from papyra.operators import trigrams as T

    g = small_library.grams
    one = lambda q: sorted((r.doc_id, r.idx) for r in T.lane(g, q, 10).collect())
    assert one("EDD") == [(3, 0)] and one("redde irdx") == [(3, 0)] and one("re do") == [] and one("zzz") == []
    han = spark.createDataFrame([(1, 0, "关于知识库检索的说明 12"), (2, 0, "知识图谱"), (3, 0, "检索 7"), (4, 0, None), (5, 1, "page 7"), (5, 0, "7")], "doc_id long, idx long, text string")
    h = T.build(han)
    find = lambda q, **o: [(r.doc_id, r.idx) for r in T.search(h, spark.createDataFrame([(0, q)], "question int, text string"), 5, **o).orderBy("rank").collect()]
    assert find("识库检索") == [(1, 0)] and find("知识库检索 12") == [(1, 0)] and find("知识库检索 13") == [] and find("知识图谱") == [(2, 0)]
    assert find("7") == [(3, 0), (5, 0), (5, 1)] and find("7", scope=spark.createDataFrame([(5,)], "doc_id long")) == [(5, 0), (5, 1)] and find("知识") == [] and find("") == []


def test_library_states(spark, tmp_path):
    files = spark.createDataFrame([(i, f"f{i}", str(i)) for i in range(21)], "id int, name string, hash string")
    none = spark.createDataFrame([], "doc_id int, name string, hash string")
    with pytest.raises(ValueError):
        Li.import_plan(files, none)
    two = spark.createDataFrame([(1, "a.md", "x"), (2, "b.md", "y"), (3, "c.md", "y")], "id int, name string, hash string")
    old = spark.createDataFrame([(9, "a.md", "z"), (8, "a_1.md", "w")], "doc_id int, name string, hash string")
    got = {r["id"]: (r["action"], r["final"]) for r in Li.import_plan(two, old, "rename").collect()}
    assert got == {1: ("rename", "a_2.md"), 2: ("import", "b.md"), 3: ("skip", "c.md")}
    states = spark.createDataFrame([(1, "active", 5), (2, "building", 6)], "generation int, state string, changed long")
    with pytest.raises(ValueError):
        Li.publish(states, 1, 9)
    after = Li.publish(states, 2, 9)
    assert {r["generation"]: r["state"] for r in after.collect()} == {1: "retired", 2: "active"} and Li.expired(after, 400_000).count() == 1
    with pytest.raises(KeyError):
        Li.pinned(spark.createDataFrame([(1, "t")], "generation int, text string"), states, 7)
    raw = spark.createDataFrame([(1, 1, bytearray(b"ab"))], "doc_id int, version int, content binary")
    path = "file://" + str(tmp_path / "raw")
    for _ in range(2):
        stored = Li.save_raw(raw, path)
    assert [(r["bytes"], r["version"]) for r in stored.collect()] == [(2, 1)]
    at = "file://" + str(tmp_path / "active")
    assert Li.pointer(spark, at) is None and Li.pointer(spark, at, "7") == "7" and Li.pointer(spark, at, "8") and Li.pointer(spark, at) == "8"
    with pytest.raises(ValueError):
        v = spark.createDataFrame([(1, "m", [1.0]), (2, "m", [1.0, 2.0])], "chunk int, model string, embedding array<double>")
        Li.merge_vectors(v, v.limit(0))


def test_sessions_remember_what_was_shown(spark):
    t = lambda m: datetime.datetime(2024, 1, 1, 0, m)
    rows = [("s", 1, t(0), "a", 1, 0.9), ("s", 1, t(0), "a", 2, 0.8), ("s", 2, t(2), "a", 1, 0.9), ("s", 2, t(2), "a", 3, 0.7), ("s", 2, t(2), "a", 4, 0.6), ("s", 3, t(9), "a", 4, 0.5), ("s", 3, t(9), "a", 5, 0.4), ("z", 1, t(0), "a", 1, 0.9)]
    got = Li.remembered(spark.createDataFrame(rows, "session string, turn int, at timestamp, topic string, doc_id int, score double"))
    assert sorted((r["session"], r["turn"], r["doc_id"]) for r in got.collect()) == [("s", 1, 1), ("s", 1, 2), ("s", 2, 3), ("s", 3, 4), ("s", 3, 5), ("z", 1, 1)]


def test_dictionary_regions_need_a_header(spark):
    rows = spark.createDataFrame([(1, "S", 1, ["name", "x"]), (1, "S", 2, ["a", "b"])], "doc_id int, sheet string, row int, cells array<string>")
    assert Di.fields(rows).count() == 0


def test_expand_keeps_to_bounds_and_visible_units(spark):
    units = spark.createDataFrame([(k, "deleted" if k == "x" else "active", None) for k in "abcdex"], "key string, status string, version string")
    relations = spark.createDataFrame([("related_to", "a", "b"), ("related_to", "b", "c"), ("related_to", "a", "x"), ("related_to", "x", "e"), ("supersedes", "a", "d")], "type string, subject string, object string")
    reached, edges, cut = G.expand(units, relations, ["a"], ["related_to"], hops=1)
    assert {r["node"] for r in reached.collect()} == {"a", "b"} and edges.count() == 1 and not cut
    reached, _, cut = G.expand(units, relations, ["a"], hops=4, nodes=2)
    assert reached.count() == 2 and cut
    for bad in (["x"], ["zz"]):
        with pytest.raises(KeyError):
            G.expand(units, relations, bad)


def test_concepts_are_named_alike_in_shards(spark, monkeypatch):
    facts = spark.createDataFrame([(f"k{i}", "zeta / alpha", t) for i, t in enumerate(["the Alpha beta", "beta", "none here", "alphabet soup", "gamma  ray"])], "key string, heading string, text string")
    keys = spark.createDataFrame([("alpha",), ("beta",), ("alpha beta",), ("gamma ray",), ("bet",)], "key string")
    want = {"k0": "alpha beta", "k1": "beta", "k2": "alpha", "k3": "alpha", "k4": "gamma ray"}
    assert {r["key"]: r["concept"] for r in S.named_concept(facts, keys).collect()} == want
    monkeypatch.setattr(S, "SHARD", 2)
    monkeypatch.setattr(S, "FACT_BLOCK", 2)
    assert {r["key"]: r["concept"] for r in S.named_concept(facts, keys).collect()} == want
    assert S.named_concept(facts, keys.limit(0)).count() == 0
