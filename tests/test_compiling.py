"""Compiling what changes on a stream: merges, replays, overtaken batches."""

import json
import shutil
from pathlib import Path

import pytest

from papyra.operators import semantic as S
from papyra.operators import snapshots as Sn
from papyra.sources import ir
from papyra.streaming import compiling as Co

BASE = {1: "Alpha guide", 2: "Beta guide", 3: "Gamma guide"}
TEXT = {
    1: "# Setup\n\nThe red service requires a key. The blue service uses a lock.",
    2: "# Setup\n\nThe red service requires a key. The old store contains many rows.",
    3: "# Limits\n\nversion 1.0 supports ten users\n\nThe green service provides a door.",
}


def nodes_of(spark, texts):
    def f(ids):
        want = {r.doc_id for r in ids.collect()}
        rows = [(i, BASE.get(i, f"Doc {i}"), t) for i, t in texts.items() if i in want]
        return ir.nodes(spark.createDataFrame(rows, "doc_id long, title string, text string")).selectExpr("*", "cast(null as string) AS version")

    return f


def batch(spark, *rows):
    return spark.createDataFrame(list(rows), "doc_id long, deleted boolean")


def state(spark, root):
    snap = Sn.at(spark, root)
    units = {(r.type, r.key): (r.content, tuple(r.sources), tuple(r.derived), round(r.confidence, 6), r.status, tuple(r.aliases)) for r in snap.read(spark, "units").collect()}
    relations = {(r.type, r.subject, r.object, r.statement, r.confidence) for r in snap.read(spark, "relations").collect()}
    return snap.epoch, units, relations


def whole(spark, texts):
    units, relations = S.compile_units(nodes_of(spark, texts)(spark.createDataFrame([(i,) for i in texts], "doc_id long")))
    return ({(r.type, r.key): (r.content, tuple(r.sources), tuple(r.derived), round(r.confidence, 6), r.status, tuple(r.aliases)) for r in units.collect()}, {(r.type, r.subject, r.object, r.statement, r.confidence) for r in relations.collect()})


def test_batches_are_merged_and_replays_change_nothing(spark, tmp_path):
    root, texts = f"file://{tmp_path}/lib", dict(TEXT)
    assert Co.apply(batch(spark, (1, False), (2, False), (3, False)), 0, root, nodes_of(spark, texts))
    epoch, units, relations = state(spark, root)
    assert (epoch, units, relations) == (1, *whole(spark, texts))
    assert not Co.apply(batch(spark, (1, True)), 0, root, nodes_of(spark, texts)) and state(spark, root) == (epoch, units, relations)
    # one document changes, one goes: what only they said goes, what others say too keeps its other sources
    texts[2] = "# Setup\n\nThe red service requires a key. The new store contains few rows."
    del texts[3]
    assert Co.apply(batch(spark, (2, False), (3, True)), 1, root, nodes_of(spark, texts))
    epoch, units, relations = state(spark, root)
    want, told = whole(spark, texts)
    said = {u[0]: u for k, u in units.items() if k[0] == "fact"}
    assert epoch == 2 and set(said) == {u[0] for k, u in want.items() if k[0] == "fact"} and relations == told
    assert said["The red service requires a key"][1] == ("1", "2") and "The green service provides a door" not in said
    assert {k: u[1:4] for k, u in units.items() if k[0] in ("fact", "summary")} == {k: u[1:4] for k, u in want.items() if k[0] in ("fact", "summary")}
    assert ("summary", "summary:doc:3") not in units and S.faults(*(Sn.at(spark, root).read(spark, t) for t in ("units", "relations"))).count() == 0
    assert Co.applied(spark, root) == {"changes": 1}


def test_newer_versions_in_a_batch_supersede_what_is_there(spark, tmp_path):
    root, texts = f"file://{tmp_path}/lib", {1: "version 1.0 supports ten users"}
    Co.apply(batch(spark, (1, False)), 0, root, nodes_of(spark, texts))
    texts[2] = "version 2.0 supports ten users"
    Co.apply(batch(spark, (2, False)), 1, root, nodes_of(spark, texts))
    _, units, relations = state(spark, root)
    assert sorted((u[0], u[4]) for k, u in units.items() if k[0] == "fact") == [("version 1.0 supports ten users", "superseded"), ("version 2.0 supports ten users", "active")]
    assert [(r[0], r[3]) for r in relations] == [("supersedes", "version 1.0 supports ten users is superseded by version 2.0 supports ten users")]
    Co.apply(batch(spark, (2, True)), 2, root, nodes_of(spark, {1: texts[1]}))
    _, units, relations = state(spark, root)
    assert [u[4] for k, u in units.items() if k[0] == "fact"] == ["active"] and not relations


def test_an_overtaken_batch_is_merged_again(spark, tmp_path, monkeypatch):
    root, publish, calls = f"file://{tmp_path}/lib", Sn.publish, []

    def racing(spark_, root_, tables, expected=0, now_ms=None):
        calls.append(expected)
        if len(calls) == 1:
            publish(spark_, root_, {"other": spark.range(2)}, expected)
        return publish(spark_, root_, tables, expected, now_ms)

    monkeypatch.setattr(Co.Sn, "publish", racing)
    assert Co.apply(batch(spark, (1, False)), 0, root, nodes_of(spark, TEXT)) and calls == [0, 1]
    snap = Sn.at(spark, root)
    assert snap.epoch == 2 and {"other", "units", "relations", "applied"} <= set(snap.tables)


def test_a_stream_is_followed_and_survives_a_crash_before_its_checkpoint(spark, tmp_path):
    root, inbox, mark = f"file://{tmp_path}/lib", tmp_path / "inbox", tmp_path / "mark"
    inbox.mkdir()
    texts = dict(TEXT)

    def put(name, *rows):
        (inbox / name).write_text("\n".join(json.dumps({"doc_id": i, "at": at, "deleted": gone}) for i, at, gone in rows))

    def run():
        stream = spark.readStream.schema("doc_id long, at long, deleted boolean").json(f"file://{inbox}")
        Co.follow(stream, root, nodes_of(spark, texts), f"file://{mark}").awaitTermination()

    put("a.json", (1, 1, True), (1, 2, False), (2, 1, False))  # the last change of a document counts
    run()
    epoch, units, _ = state(spark, root)
    assert epoch == 1 and {k[1] for k in units if k[0] == "summary"} == {"summary:doc:1", "summary:doc:2"}
    put("b.json", (2, 5, True))
    run()
    after = state(spark, root)
    assert after[0] == 2 and {k[1] for k in after[1] if k[0] == "summary"} == {"summary:doc:1"}
    last = max(Path(mark, "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    last.unlink()  # the batch is in force, but its end was never marked
    for crc in Path(mark, "commits").glob(f".{last.name}.crc"):
        crc.unlink()
    run()
    assert state(spark, root) == after
    shutil.rmtree(mark)


def test_a_batch_gives_up_when_always_overtaken(spark, tmp_path, monkeypatch):
    root = f"file://{tmp_path}/lib"
    monkeypatch.setattr(Co.Sn, "publish", lambda *a, **k: (_ for _ in ()).throw(Sn.Conflict("taken")))
    monkeypatch.setattr(Co, "TRIES", 2)
    with pytest.raises(Sn.Conflict, match="overtaken 2 times"):
        Co.apply(batch(spark, (1, False)), 0, root, nodes_of(spark, TEXT))
