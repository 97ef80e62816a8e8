"""Each stage of the pipeline against plain Python on a small table, and on odd and empty ones."""

import collections
import hashlib
import math

import pytest

public = pytest.importorskip("public_tokenizers")
import corpus_pipeline as p  # noqa: E402
from papyra.llm import mixing  # noqa: E402

COLS = "doc_id long, text string, lang string, source string, n_chars long, severity double, toxic string, grade int, n_lines int, n_removed int, key string, row int, __row string, keep string, node int, size string"


def table(spark, rows):
    """Documents with columns of the very names that the operators use."""
    return spark.createDataFrame([(i, t, "en", s, None if t is None else len(t), -1.0, "own", 7, 8, 9, "k", 3, "r", "x", 4, "big") for i, t, s in rows], COLS)


def words(t):
    return t.split() if t else []


def plain_lines(docs, least=20):
    """doc_id to text without the lines of later copies of runs of ``least`` words."""
    lines = [(i, n, x) for i, t, _ in sorted(docs) if t is not None for n, x in enumerate(t.split("\n"))]
    gone = set()
    for b in range(len(lines)):
        for a in range(b):
            n = 0
            while b + n < len(lines) and lines[a + n][2] == lines[b + n][2] and lines[a + n][0] == lines[a][0] and lines[b + n][0] == lines[b][0]:
                n += 1
            if sum(len(words(lines[b + k][2])) for k in range(n)) >= least:
                gone.update(range(b, b + n))
    left = collections.defaultdict(list)
    for n, (i, _, x) in enumerate(lines):
        if n not in gone:
            left[i].append(x)
    return {i: "\n".join(left[i]) for i, t, _ in docs if t is not None and left[i]} | {i: None for i, t, _ in docs if t is None}


def plain_near(docs):
    """Ids that stay: of each chain of texts of Jaccard 0.8 or more the smallest."""
    sets = {i: {tuple(w[j : j + min(5, len(w))]) for j in range(len(w) - min(5, len(w)) + 1)} if (w := words(t)) else {i} for i, t, _ in docs}
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                up[y] = x
    return {i for i in up if root(i) == i}


def plain_mix(docs):
    """doc_id to copies: golden-ratio points through cumulative targets, blocks of equal words, documents by md5 of their ids."""
    size = {i: len(words(t)) for i, t, _ in docs}
    sources = sorted({s for _, _, s in docs}, key=lambda s: (s is None, s or ""))
    total = {s: sum(size[i] for i, _, x in docs if x == s) for s in sources}
    weight = {s: (5, 2, 1)[n % 3] for n, s in enumerate(sources)}
    goal, target, open_ = 1.5 * sum(total.values()), {}, list(sources)
    while open_:
        level = (goal - sum(target.values())) / sum(weight[s] for s in open_)
        over = [s for s in open_ if level * weight[s] > 2 * total[s]]
        target.update({s: 2 * total[s] for s in over} if over else {s: level * weight[s] for s in open_})
        open_ = [s for s in open_ if s not in target]
    block = max(1, math.ceil(goal / mixing.BLOCKS))
    given, lows, upto = collections.Counter(), [], 0.0
    for s in sources:
        if target[s] > 0:
            lows.append((upto / goal, s))
        upto += target[s]
    for n in range(math.ceil(goal / block)):
        x = (n + 0.5) * mixing.STEP % 1.0
        given[max(low for low in lows if low[0] <= x)[1]] += 1
    out = {}
    for s in sources:
        per, at = math.ceil(total[s] / block), 0
        for _, i in sorted((hashlib.md5(str(i).encode()).hexdigest(), i) for i, _, x in docs if x == s):
            ends = [min(max(min(given[s], (turn + 1) * per) - turn * per, 0) * block, total[s]) for turn in (0, 1)]
            taken = sum(max(0, min(at + size[i], e) - at) for e in ends)
            at += size[i]
            if size[i] and (n := math.floor(taken / size[i] + 0.5)):
                out[i] = n
    return out


@pytest.fixture(scope="module")
def small(spark, sf):
    """Real documents with planted passages, copies and odd rows."""
    rows = [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{sf}/documents.parquet").filter("doc_id < 40 AND length(text) < 3000").collect()]
    passage = "\n".join(f"a planted line of words number {i} stands in many texts" for i in range(4))
    rows += [(1000 + i, f"own words {i} " * 9 + "\n" + passage + f"\nend {i}", "abc"[i % 3]) for i in range(6)]
    rows += [(2000, None, "a"), (2001, "", None), (2002, " \n\t", "b"), (2003, "word " * 20_000, None)]
    near = [f"w{j}x{j * j % 97}" for j in range(120)]
    rows += [(3000 + i, " ".join([*near[:-1], f"last{i}"]), "c") for i in range(5)]
    return rows


def test_stages_equal_plain_python(spark, sf, small):
    d = table(spark, small)
    for name, stage in p.STAGES[:-1]:
        assert stage(spark, d, sf).columns == d.columns, name
    got = p.drop_repeated_lines(spark, d, sf).collect()
    want = plain_lines(small)
    assert {r.doc_id: r.text for r in got} == want and len(got) == len(want)
    assert all(r.n_chars == (None if r.text is None else len(r.text)) and (r.n_lines, r.n_removed, r.keep) == (8, 9, "x") for r in got)
    got = p.drop_near_duplicates(spark, d, sf).collect()
    assert {r.doc_id for r in got} == plain_near(small) and all((r["__row"], r.node) == ("r", 4) for r in got)
    got = p.mix_sources(spark, d, sf).collect()
    assert collections.Counter(r.doc_id for r in got) == plain_mix(small) and all((r.row, r.size) == (3, "big") for r in got)
    kept = p.drop_toxic(spark, d, sf).collect()
    assert {i for i, t, _ in small if not words(t)} <= {r.doc_id for r in kept} and all((r.severity, r.grade, r.toxic) == (-1.0, 7, "own") for r in kept)


def test_toxic_documents_go_and_clean_ones_stay(spark, sf):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    kept = {r.doc_id for r in p.drop_toxic(spark, docs, "/root/testdata/sf0.01").select("doc_id").collect()}
    rows = [(r.doc_id in kept, r.toxic) for r in labels.join(docs, "doc_id").collect()]
    assert sum(not k for k, t in rows if t) >= 0.9 * sum(t for _, t in rows)
    assert sum(k for k, t in rows if not t) >= 0.98 * sum(not t for _, t in rows)


def test_packing_stage_holds_every_token(spark, sf, small):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(str(public.path("word_bpe_49k.json")))
    got = collections.Counter()
    for r in p.pack_sequences(spark, table(spark, small), sf).collect():
        got[r.doc_id] += r.length
    assert got == {i: len(tok.encode(t or "", add_special_tokens=False).ids) + 1 for i, t, _ in small}


def test_empty_tables_and_repeated_rows(spark, sf, small):
    empty = table(spark, small[:1]).limit(0)
    for _, stage in p.STAGES:
        assert stage(spark, empty, sf).count() == 0
    twice = table(spark, [(5, "some text of words", "a")] * 3 + [(None, "some text of words", None)] * 2)
    assert p.drop_near_duplicates(spark, twice, sf).count() == 1
    assert p.drop_repeated_lines(spark, twice, sf).count() == 5
    assert p.mix_sources(spark, twice, sf).select("doc_id").distinct().count() == 2


def test_run_chains_the_stages(spark, sf):
    out = p.run(spark, sf)
    assert out.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] and out.count() > 0
