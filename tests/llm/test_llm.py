"""Operators against brute force, round trips and odd input."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from papyra.llm import ann, fertility, linededup, lm, mixing, neardup, packing, pii, secrets, toxicity

public = pytest.importorskip("public_tokenizers")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, row string, node long"
LONG = " ".join(f"w{i % 997}" for i in range(30_000))


def odd(spark):
    """Nulls in every column, empty and long texts, repeated rows and ids, extra columns with clashing names."""
    rows = [
        (1, None, "en", "a", 0, "x", 1),
        (None, "some words here that repeat", None, None, None, None, None),
        (2, "", "en", "a", 0, "x", 2),
        (2, "", "en", "a", 0, "x", 2),
        (3, " \t\n ", "de", "b", 4, "y", 3),
        (4, LONG, "en", "", 9, "y", 4),
        (5, LONG, "en", "b", 9, "y", 4),
        (5, "other text for id five", "fr", "b", 9, "z", 5),
        (6, "🙂 ünï 知识 <|endoftext|> x", None, "b", 9, "z", 5),
    ]
    return spark.createDataFrame(rows, DOCS)


def ops(spark):
    labels = spark.createDataFrame([(1, 0), (4, 1), (None, 1), (5, None)], "doc_id long, toxic int")
    return {
        "near": neardup.near_duplicates,
        "lm": lm.score,
        "toxic": lambda d: toxicity.grade(d, labels),
        "fertility": lambda d: fertility.rate(d, str(public.path("piece_bpe_32k.model"))),
        "mix": mixing.mix,
        "lines": linededup.dedup,
        "secrets": secrets.scan,
        "pii": pii.scan,
    }


@pytest.mark.parametrize("name", "near lm toxic fertility mix lines secrets pii".split())
def test_odd_and_empty_tables(spark, name):
    f = ops(spark)[name]
    assert f(odd(spark)).count() == 9
    assert f(odd(spark).limit(0)).count() == 0


def by_text(rows, *names):
    """Sorted values of a result's rows."""
    return sorted((tuple(r[n] for n in names) for r in rows), key=repr)


def test_odd_rows_have_defined_values(spark):
    f, d = ops(spark), odd(spark)
    near = by_text(f["near"](d).collect(), "doc_id", "class_id", "class_rows", "stays")
    assert near == sorted([(1, 1, 1, True), (2, 2, 1, True), (2, 2, 1, True), (3, 3, 1, True), (4, 4, 2, True), (5, 4, 2, False), (5, 5, 1, True), (6, 6, 1, True), (None, None, 1, True)], key=repr)
    scores = by_text(f["lm"](d).collect(), "doc_id", "n_tokens", "held_out")
    assert [x[:2] for x in scores] == sorted([(1, 1), (2, 1), (2, 1), (3, 1), (4, 30_001), (5, 30_001), (5, 6), (6, 6), (None, 6)], key=repr)
    assert all(h == (zlib.crc32(b"" if i is None else str(i).encode()) % 5 == 1) for i, _, h in scores)
    toxic = f["toxic"](d)
    assert toxic.columns == d.columns + ["severity", "grade", "toxic"]
    blank = {round(r.severity, 9) for r in toxic.filter("doc_id in (1, 2, 3)").collect()}
    assert len(blank) == 1 and all(0 <= r.severity <= 2 and r.grade in (0, 1, 2) for r in toxic.collect())
    assert {(r.severity, r.grade, r.toxic) for r in toxicity.grade(d, d.limit(0).selectExpr("doc_id", "1 AS toxic")).collect()} == {(0.0, 0, False)}
    rated = by_text(f["fertility"](d).filter("coalesce(doc_id, 0) < 4 OR doc_id = 6").collect(), "doc_id", "n_words", "base_failed", "kept")
    assert rated == sorted([(1, 0, True, False), (2, 0, True, False), (2, 0, True, False), (3, 0, True, False), (6, 5, True, False), (None, 5, True, False)], key=repr)
    mixed = f["mix"](d).collect()
    assert all(r.taken == 0 and r.first_slot is None for r in mixed if r.size == 0) and {r.source_size for r in mixed if r.doc_id is None} == {5}
    assert sum(r.taken for r in mixed) == pytest.approx(sum(r.target for r in {r.source_size: r for r in mixed}.values()), abs=12)
    for name, counts in (("secrets", ("n_assign", "n_access", "n_hex")), ("pii", ("n_email", "n_ip", "n_card", "n_phone"))):
        assert {tuple(r[c] for c in counts) + (r.spans,) for r in f[name](d).collect()} == {(0,) * len(counts) + ("",)}


def docs_of(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


def plain_similarity(x, y):
    """Probability Jaccard of two counters, as it is defined."""
    keys = list(x.keys() | y.keys())
    a, b = np.array([x.get(k, 0) for k in keys], float), np.array([y.get(k, 0) for k in keys], float)
    return sum(1 / np.maximum(a / x[i], b / y[i]).sum() for i in x.keys() & y.keys())


def plain_classes(texts):
    """The smallest number of each text's class, by comparing all pairs."""

    def shingles(t):
        w = t.encode().split()
        k = min(5, len(w))
        return collections.Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if k else collections.Counter()

    sets, up = [shingles(t) for t in texts], list(range(len(texts)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, x in enumerate(sets):
        for b in range(a):
            y = sets[b]
            if root(a) == root(b):
                continue
            # the weight that both put on the same shingles is no less than the similarity
            if x and y and sum(min(n / x.total(), y[k] / y.total()) for k, n in x.items()) >= 0.8 - 1e-9 and (x == y or plain_similarity(x, y) >= 0.8 - 1e-9):
                lo, hi = sorted((root(a), root(b)))
                up[hi] = lo
    return [root(i) for i in range(len(texts))]


def test_near_duplicates_equal_brute_force(spark, sf):
    d = docs_of(spark, sf)
    rows = sorted((r.doc_id, r.text) for r in d.collect())
    want = plain_classes([t for _, t in rows])
    got = neardup.near_duplicates(d).collect()
    assert {r.doc_id: r.class_id for r in got} == {i: rows[c][0] for (i, _), c in zip(rows, want, strict=True)}
    assert sum(r.stays for r in got) == len(set(want))


def test_similarity_of_weighted_shingles_is_exact():
    rng = np.random.default_rng(4)
    for _ in range(50):
        x, y = ({int(k): int(rng.integers(1, 6)) for k in rng.choice(30, rng.integers(1, 25), replace=False)} for _ in range(2))
        arrays = [np.array(sorted(x)), np.array([x[k] for k in sorted(x)]), np.array(sorted(y)), np.array([y[k] for k in sorted(y)])]
        assert math.isclose(neardup.prob_jaccard(*arrays), plain_similarity(x, y), abs_tol=1e-12)


def test_weights_make_and_break_links(spark):
    base = [f"a{j}" for j in range(100)]
    passage = [f"p{j}" for j in range(30)]
    texts = [
        " ".join(base + passage),  # 0: the passage once
        " ".join(base + passage * 2),  # 1: by sets over 0.8 like 0, and by weights a fifth of it is elsewhere
        " ".join(base + passage * 9),  # 2: by sets like 0 and 1, by weights not
        " ".join((base + passage) * 3),  # 3: all of it three times, so the weights are those of 0
    ]
    want = plain_classes(texts)
    got = {r.doc_id: r.class_id for r in neardup.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [got[i] for i in range(4)] == want and want[3] == 0 and want[2] == 2


def test_registers_agree_as_often_as_probability_jaccard():
    rng = np.random.default_rng(0)
    h = rng.integers(0, 2**63, 300).astype(np.uint64)
    wa, wb = rng.random(300) + 0.1, rng.random(300) + 0.1
    wa[:60] = wb[-60:] = 0
    x, y = wa > 0, wb > 0
    m = 4096
    sig = neardup.prob_minhash(np.concatenate([h[x], h[y]]), np.repeat([0, 1], [x.sum(), y.sum()]), np.concatenate([wa[x], wb[y]]), 2, m)
    both = np.flatnonzero(x & y)
    jp = sum(1 / np.maximum(wa / wa[i], wb / wb[i]).sum() for i in both)
    assert abs((sig[0] == sig[1]).mean() - jp) < 4 * math.sqrt(jp * (1 - jp) / m)


def test_groups_just_under_the_threshold_lose_no_link(spark):
    """A large group whose members are mostly too far from each other to be links; some say a stretch twice."""
    rng, base = np.random.default_rng(3), [f"w{i}" for i in range(120)]
    texts = []
    for i in range(150):
        w = list(base)
        for j in rng.choice(120, rng.integers(0, 6), replace=False):
            w[j] = f"n{i}x{j}"
        texts.append(" ".join(w + (w[:20] if i % 3 == 0 else [])))
    got = {r.doc_id: r.class_id for r in neardup.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [got[i] for i in range(150)] == plain_classes(texts)


def test_repeated_passages_weigh_as_often_as_they_occur(spark):
    """The second of each pair holds a passage of 200 words again and again: it is another text. Where both hold it as often, they are near copies."""
    rows = []
    for i in range(10):
        text = " ".join(f"a{i}x{j}" for j in range(1000))
        again = " " + " ".join([f"b{i}x{j}" for j in range(200)] * 100)
        rows += [(4 * i, text), (4 * i + 1, text + again), (4 * i + 2, text.replace(f"a{i}x500", "other") + again), (4 * i + 3, text.replace(f"a{i}x500", "other"))]
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.class_id for r in got} == {i: i - i % 4 + (i % 4 in (1, 2)) for i in range(40)}


def test_lm_base_score_and_gain(spark, sf):
    d = docs_of(spark, sf)
    rows = d.collect()
    low = {i: i + 32 for i in range(65, 91)}
    tokens = {r.doc_id: [*re.findall(r"[^\x20\x09-\x0D]+", r.text.translate(low)), None] for r in rows}
    held = {i for i in tokens if zlib.crc32(str(i).encode()) % 5 == 1}
    c = collections.Counter(w for i, t in tokens.items() if i not in held for w in t)
    n, v = sum(c.values()), len(c)
    got = {r.doc_id: r for r in lm.score(d).collect()}
    for i, t in tokens.items():
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (i in held, len(t), sum(c[w] > 0 for w in t), n)
        assert math.isclose(r.base_score, sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t), rel_tol=1e-9)
    assert sum(got[i].score for i in held) > sum(got[i].base_score for i in held)


def test_lm_probabilities_sum_to_one():
    w = lm.learn_weights(np.array([0, 1, 1]), np.array([5.0, 3, 2]), np.array([[0.1, 0.2, 0], [0.1, 0.2, 0.5], [0.1, 0.1, 0]]))
    assert np.allclose(w.sum(1), 1) and w[1, 2] > 0


def test_toxicity_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    d, labels = docs_of(spark, sf), spark.read.parquet(f"{sf}/labels.parquet")
    got = toxicity.grade(d, labels.filter("doc_id % 3 != 0")).join(labels.filter("doc_id % 3 = 0").withColumnRenamed("toxic", "y"), "doc_id").toPandas()
    assert got.severity[got.y == 1].mean() > 4 * got.severity[got.y == 0].mean()
    assert got.toxic[got.y == 0].mean() < 0.03


def test_cumulative_link_orders_grades():
    rng = np.random.default_rng(1)
    x = rng.random(600)
    y = np.digitize(x + rng.normal(0, 0.05, 600), [0.4, 0.7])
    m = toxicity.CumulativeLink(1, 3)
    m.fit(np.arange(600), np.zeros(600, int), x, y, penalty=1e-5)
    assert (np.diff(m.theta()) > 0).all()
    assert (m.probabilities(x * m.w[0]).argmax(1) == y).mean() > 0.85


def test_fertility_base_counts(spark, sf):
    def brute(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        runs = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        at = {j for i in range(len(w) - 7) if runs[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(at)

    got = fertility.rate(docs_of(spark, sf), str(public.path("piece_bpe_32k.model"))).collect()
    want = {r.doc_id: brute(r.text) for r in docs_of(spark, sf).collect()}
    for r in got:
        b = (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)
        assert b == want[r.doc_id]
        assert r.base_failed == (b[0] < 20 or 100 * b[4] > 30 * b[0]) and not (r.base_failed and r.kept)
    assert sum(r.kept for r in got) > 0.9 * sum(not r.base_failed for r in got)


def test_fertility_rejects_junk_that_passes_the_base_rules(spark):
    """Labels are not what the bands are learned from: they tell how much junk goes, and how much else."""
    sf, path = "/root/testdata/sf0.1", str(public.path("piece_bpe_32k.model"))
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "quality")
    got = fertility.rate(docs_of(spark, sf), path).filter("not base_failed").join(labels, "doc_id").toPandas()
    assert (~got.kept[got.quality == 0]).mean() >= 0.85
    assert (~got.kept[got.quality == 1]).mean() <= 0.015


def test_fertility_bands_are_not_narrowed_by_copies(spark):
    rng, words = np.random.default_rng(4), [f"{a}{b}ing" for a in "bcdfghlmnprst" for b in "aeiou"]
    texts = [" ".join(rng.choice(words, 150)) for _ in range(60)]
    rows = [(i, t, "en") for i, t in enumerate(texts + texts[:1] * 300)]
    got = fertility.rate(spark.createDataFrame(rows, "doc_id long, text string, lang string"), str(public.path("piece_bpe_32k.model"))).collect()
    assert sum(r.kept for r in got) >= 355


def test_nearest_recall_and_ties(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(3000, 16))
    x[100:400] = x[7]  # many equal vectors
    rows = [(i, [float(v) for v in row]) for i, row in enumerate(x)]
    rows += [(9001, None), (9002, [0.0] * 16), (9003, [float("nan")] * 16), (9004, [1.0]), (None, [1.0] * 16)]
    e = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = collections.defaultdict(list)
    for r in ann.search(e, F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect():
        got[r.query_id].append(r.vec_id)
    hit = 0
    for q in range(0, 3000, 50):
        s = ann.cosine(x[q], x)
        s[q] = -2
        want = np.lexsort((np.arange(3000), -s))[:5].tolist()
        hit += len(set(want) & set(got[q]))
        if 100 <= q < 400:
            assert got[q] == want
    assert hit / 300 >= 0.9
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0])], "vec_id long, embedding array<double>")
    assert [r.vec_id for r in ann.search(few, F.col("vec_id") == 0).collect()] == [1]
    assert ann.search(e.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_mix_meets_targets_and_agrees_with_itself(spark, sf):
    d = docs_of(spark, sf)
    a, b = (sorted(map(tuple, mixing.mix(d).collect()), key=repr) for _ in range(2))
    assert a == b
    took = collections.Counter()
    for _, size, source, target, taken, slot in a:
        assert taken <= 2 * size and (slot is None) == (taken == 0)
        took[(source, target)] += taken
    block = max(1, math.ceil(1.5 * sum(r[1] for r in a) / mixing.BLOCKS))
    assert all(abs(n - target) <= 4 * block for (_, target), n in took.items())


def test_points_decide_what_a_source_gives(spark, sf):
    d = docs_of(spark, sf)
    rows = [{r.doc_id: r.taken for r in mixing.mix(d, blocks=500, step=x).collect()} for x in (mixing.STEP, 0.7548776662466927, 0.0)]
    assert rows[0] != rows[1] and sum(n > 0 for n in rows[2].values()) < sum(n > 0 for n in rows[0].values())


def test_mix_equals_its_sql(spark, sf):
    import duckdb

    from papyra.llm import queries

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    q = queries.op6_mix_sources(spark, sf)
    want = con.execute(f"SELECT {','.join(q.columns)} FROM ({queries.oracle_sql()['op6_mix_sources']})").fetchall()
    plain = lambda rows: sorted(repr([round(v, 6) if isinstance(v, float) else v for v in r]) for r in rows)
    assert plain(map(tuple, q.collect())) == plain(want)


def test_mixed_documents_come_in_the_order_of_the_schedule(spark):
    """A table stored by source: every stretch of the mix holds each source by its target, and rows are as often there as the mix takes them."""
    rows = [(i, " ".join(f"w{i}x{j}" for j in range(50)), "abc"[i // 400]) for i in range(1200)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string").coalesce(1)
    want = {r.doc_id: math.floor(r.taken / r.size + 0.5) for r in mixing.mix(d).collect()}
    got = mixing.mixed(d).collect()
    assert collections.Counter(r.doc_id for r in got) == {i: n for i, n in want.items() if n}
    share = {k: n / len(got) for k, n in collections.Counter(r.source for r in got).items()}
    for at in range(0, len(got) - 99, 100):
        part = collections.Counter(r.source for r in got[at : at + 100])
        assert all(abs(part[k] - 100 * share[k]) <= 12 for k in "abc"), (at, part)


def test_lines_equal_brute_force(spark, sf):
    rng = np.random.default_rng(2)
    lines = [" ".join(f"t{rng.integers(0, 50)}" for _ in range(rng.integers(1, 9))) for _ in range(40)]
    texts = ["\n".join(lines[i] for i in rng.integers(0, 40, 12)) for _ in range(60)]
    for i in range(10, 30):
        texts[i] += "\n" + "\n".join(lines[3:9])
    every = [(d, p, x) for d, t in enumerate(texts) for p, x in enumerate(t.split("\n"))]
    by = collections.defaultdict(list)
    for n, (_, _, x) in enumerate(every):
        by[x].append(n)
    gone = set()
    for x in by.values():
        for s in x[1:]:
            for j in x[: x.index(s)]:
                n = 0
                while max(s, j) + n < len(every) and every[s + n][2] == every[j + n][2] and every[s + n][0] == every[s][0] and every[j + n][0] == every[j][0]:
                    n += 1
                if sum(len(every[s + k][2].split()) for k in range(n)) >= 20:
                    gone.update(range(s, s + n))
    want = collections.defaultdict(list)
    for n, (d, _, x) in enumerate(every):
        if n not in gone:
            want[d].append(x)
    got = linededup.dedup(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert sum(r.n_removed for r in got) == len(gone) > 0
    assert {r.doc_id: r.text for r in got} == {d: "\n".join(want[d]) for d in range(60)}


def test_guess_costs_order():
    cost = secrets.guess_cost
    assert cost("") == 0 and cost("password") < cost("password1990") < cost("qwertyuiopasdf") + 4
    assert cost("aaaaaaaaaaaaaaaa") < 5 < 10 <= cost("X7f!kd92Lq#p")


@pytest.mark.parametrize("text", ["pwd: Xk9#mQ2!z", "password=Xk9#mQ2!", "pwd = kqzvhtrmwpxbnd", "auth: QZKVHWTRMXPBNDLFGJCYSKQZVWXHTR", "credentials = 83027491655302", "pwd: kqzvhtrm", "login: 'xK4pQ7mZ'"])
def test_random_credential_values_of_any_characters_are_spans(text):
    ((s, e, kind),) = secrets.added_spans(text, secrets.base_spans(text))
    assert kind == "guess" and text[s:e] == re.split("[:= ']+", text)[1]


def test_cheap_credential_values_are_no_spans():
    for text in ("pwd: password1990", "pwd = aaaaaaaaaaaaaaaaaaaaaaaa", "pin: 12345678", "auth = qwertyuiop", "login: Welcome123", "pwd: abcabcabcabc", "pwd: 19900412"):
        assert secrets.added_spans(text, []) == []


def test_secret_spans(spark):
    t = "🙂 api_key = abcdefghijkl1 AKIAABCDEFGHIJKLMN9 deadbeefdeadbeef pwd: 'X7f!kd92Lq#p' secret=short token: Password1"
    base = secrets.base_spans(t)
    assert [(t[s:e][:7], k) for s, e, k in base] == [("api_key", "assign"), ("AKIAABC", "access"), ("deadbee", "hex")]
    r = secrets.scan(spark.createDataFrame([(1, t), (2, None)], "doc_id long, text string")).orderBy("doc_id").collect()
    assert r[0].n_guess == 1 and r[0].base_sha256 == hashlib.sha256(secrets.joined(base).encode()).hexdigest()
    assert (r[1].spans, r[1].base_sha256) == ("", hashlib.sha256(b"").hexdigest())


def test_pii_base_equals_the_patterns(spark, sf):
    email = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
    ip = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
    card = re.compile(r"[0-9]([\x20-]?[0-9])+")
    phone = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

    def brute(t):
        digits = lambda m: re.sub("[^0-9]", "", m[0])
        out = [("email", m) for m in email.finditer(t)] + [("ip", m) for m in ip.finditer(t) if all(int(p) < 256 for p in m[0].split("."))]
        out += [("card", m) for m in card.finditer(t) if 16 <= len(digits(m)) <= 19 and pii.luhn(digits(m))]
        out += [("phone", m) for m in phone.finditer(t) if 8 <= len(digits(m)) <= 15]
        return [(k, m.start(), m.end()) for k, m in out]

    tricky = ["a@b a.b@c.d@e.f x@@y.z@w.v", "1.2.3.4.5.6.7.8 999.1.1.1 00001.2.3.4", "4111 1111 1111 1111 4111-1111-1111-1111", "+1 (22) 333-4444 +12 +49.30.1234567-"]
    for t in tricky + [r.text for r in docs_of(spark, "/root/testdata/sf0.01").collect()]:
        assert pii.base_spans(t) == brute(t)


def test_skip_edges_carry_labels():
    f = pii.Field()
    f.w[0] = [1.0, 0, 0, 0, 0]
    x = np.zeros((2, pii.N_FEATURES))
    x[:, 0] = 1
    f.w[1, 3], x[0, 1] = 6.0, 1
    none = np.empty(0, int)
    f.pair[1] = 4 * np.eye(5)
    assert f.marginals(x, none, none, none)[1].argmax() == 0
    assert f.marginals(x, np.array([0]), np.array([1]), np.array([1]))[1].argmax() == 3


def test_packing_round_trip(spark, sf):
    from tokenizers import Tokenizer

    path = str(public.path("word_bpe_49k.json"))
    tok = Tokenizer.from_file(path)
    d = docs_of(spark, sf).select("doc_id", "text").unionByName(odd(spark).filter("doc_id in (1, 6)").selectExpr("doc_id + 1000000 AS doc_id", "text"))
    ids = {r.doc_id: np.array([*tok.encode(r.text or "", add_special_tokens=False).ids, 1], "<u4") for r in d.collect()}
    pieces = packing.pack(d, path).collect()
    upto = collections.defaultdict(int)
    for r in sorted(pieces, key=lambda r: (r.doc_id, r.start)):
        assert r.start == upto[r.doc_id] and r.doc_tokens == len(ids[r.doc_id])
        upto[r.doc_id] += r.length
        assert r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes())
    assert dict(upto) == {i: len(x) for i, x in ids.items()}
    at = collections.defaultdict(int)
    for r in sorted(pieces, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == at[r.sequence_id]
        at[r.sequence_id] += r.length
    assert all(n == 2048 or n & (n - 1) == 0 for n in at.values())
    assert packing.pack(odd(spark), path).filter("doc_id is null").count() >= 1
    assert packing.pack(odd(spark).limit(0), path).count() == 0


def test_sum_of_squares_level():
    levels = packing.Levels(8)
    for size in (5, 5, 3):
        box = levels.place(size)
        box[0] += size
        box[1].append(size)
        levels.filled(box)
    assert levels.count[5] == 1 and levels.count.sum() == 1  # the 3 filled up one of the 5s
