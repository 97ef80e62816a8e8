"""Prefix tries against plain dictionaries; the succinct form itself; defined results of odd rows."""

import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from papyra.llm import prefixes as P
from papyra.llm import queries

COLS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def plain_turns(rows):
    out = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            out.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    return {c: [x[2:] for x in sorted(t)] for c, t in out.items()}


def rebuild(convs):
    out = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = convs.get(c - c % 5, [])[:h] + own[h:]
    return out


def plain(convs):
    """The nodes by walking all prefixes."""
    members, ends = {}, {}
    for c, t in convs.items():
        for d in range(len(t) + 1):
            members.setdefault(tuple(t[:d]), []).append(c)
        ends.setdefault(tuple(t), []).append(c)
    kids = {}
    for k in members:
        if k:
            kids.setdefault(k[:-1], []).append(k)
    leaves, saved = {}, {}
    for k in sorted(members, key=len, reverse=True):
        leaves[k] = sum(leaves[x] for x in kids.get(k, [])) or 1
        saved[k] = (len(members[k]) - 1) * (len(k[-1][1].encode()) if k else 0) + sum(saved[x] for x in kids.get(k, []))
    sha = lambda k: hashlib.sha256(",".join(map(str, sorted(ends.get(k, [])))).encode()).hexdigest()
    return sorted((min(m), len(k), min(members[k[:-1]]) if k else None, len(m), len(kids.get(k, [])), leaves[k], saved[k], sha(k)) for k, m in members.items())


def told(df):
    return sorted(tuple(r[c] for c in COLS) for r in df.collect())


def made(seed=1):
    rng = np.random.default_rng(seed)
    rows = []
    for c in range(150):
        for t in range(int(rng.integers(1, 9))):
            rows.append((c, t, ["user", "assistant", None][int(rng.integers(0, 3)) if rng.random() < 0.2 else t % 2], f"text {rng.integers(0, 1 + t % 3)} ü" * (t % 4)))
    rows += [(c, t, "user", "copied " * t) for c in range(1000, 1100) for t in range(5)]  # equal conversations
    long = [("user", f"turn {t}") for t in range(130)]
    rows += [(2000 + c, t, *x) for c in range(4) for t, x in enumerate(long + [("user", f"end {c}")])]
    rows += [(3000, None, "user", "null turn"), (3000, None, None, None), (3000, 1, "b", "x"), (3000, 1, "a", "y"), (3000, 1, "a", "y"), (None, 1, "user", "no id"), (3001, 5, None, None), (3004, 1, "user", "t")]
    rows += [(c, 1, "user", "lone") for c in range(4001, 4020) if c % 5]
    return rows


@pytest.fixture(scope="module")
def made_turns(spark):
    d = spark.createDataFrame(made(), "conv_id long, turn long, role string, text string").withColumn("d", F.lit("clash")).withColumn("a", F.lit(None).cast("string"))
    return P.turns(d.repartition(5)).cache()


@pytest.mark.parametrize("shard_rows", [P.SHARD_ROWS, 200, 3])
def test_nodes_are_those_of_plain_prefixes(spark, made_turns, shard_rows):
    assert told(P.trie(made_turns, shard_rows)) == plain(plain_turns(made()))


def test_rebuilt_conversations(spark, made_turns):
    first = F.crc32(F.col("conv_id").cast("string").cast("binary")) % 9
    got = told(P.trie(P.rebuilt(made_turns, F.col("conv_id") - F.col("conv_id") % 5, first, 8), 40))
    want = rebuild(plain_turns(made()))
    assert any(not t for t in want.values())  # there are conversations without turns
    assert got == plain(want)


def test_blocks_of_ids_make_one_digest(spark, monkeypatch):
    monkeypatch.setattr(P, "BLOCK", 7)
    d = spark.createDataFrame([(c, 1, "user", "same") for c in range(3000)], "conv_id int, turn int, role string, text string")
    got = told(P.trie(P.turns(d.repartition(7))))
    assert got == plain({c: [("user", "same")] for c in range(3000)})


def test_empty_tables_have_no_nodes(spark):
    d = spark.createDataFrame([(None, 1, "user", "x")], "conv_id long, turn int, role string, text string")
    assert told(P.trie(P.turns(d))) == [] and told(P.trie(P.turns(d.limit(0)))) == []


def test_succinct_form():
    seq, level = np.array([0, 0, 1, 1, 2, 0, 1]), np.array([1, 2, 1, 2, 1, 3, 3])
    a = np.array([5, 6, 5, 6, 9, 1, 2])
    t = P.Louds(seq, level, a, a)
    # 0 has the children 1 (5) and 2 (9); 1 has 3 (6); 3 has 4 (1) and 5 (2)
    assert "".join("01"[x] for x in t.bits.astype(int)) == "11010011000" and t.labels[0].tolist() == [5, 9, 6, 1, 2]
    assert t.parents().tolist() == [0, 0, 1, 3, 3] and t.degrees().tolist() == [2, 1, 0, 2, 0, 0]
    assert t.up(np.array([0, 1, 1, 1, 1, 1])).tolist() == [5, 4, 1, 3, 1, 1] and t.node.tolist() == [1, 3, 1, 3, 2, 4, 5]
    assert len(P.Louds(*[np.array([], np.int64)] * 4)) == 1


def test_query_is_told_by_its_sql(spark, sf):
    import duckdb

    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW conversations AS SELECT * FROM '{sf}/conversations.parquet'")
    want = duck.execute(f"SELECT {', '.join(COLS)} FROM ({queries.oracle_sql()['op11_conversation_trie'].strip()})").fetchall()
    assert told(queries.op11_conversation_trie(spark, sf)) == sorted(want)
