"""Scores, grades and verdicts of the learned operators against plain recomputations."""

import collections
import math
import zlib

import numpy as np
import pytest

from papyra.llm import fertility, lm, toxicity

public = pytest.importorskip("public_tokenizers")


def docs_of(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.mark.parametrize("order", [2, 3])
def test_lm_scores_equal_a_plain_model(spark, sf, order):
    """Deleted interpolation told token by token, with likelihoods as they are: cells cost a thousandth of the score or two."""
    d = docs_of(spark, sf)
    low = {i: i + 32 for i in range(65, 91)}
    texts = {r.doc_id: ["<s>"] * (order - 1) + [*r.text.translate(low).encode().split(), "</s>"] for r in d.collect()}
    role = {i: zlib.crc32(str(i).encode()) % 5 for i in texts}

    def counts(ids):
        grams = [collections.Counter() for _ in range(order)]
        for i in ids:
            for k, g in enumerate(grams):
                g.update(zip(*(texts[i][m:] for m in range(k + 1))))
        own = [c for w, c in grams[0].items() if w != ("<s>",)]
        return grams, sum(own), len(own)

    def estimates(model, i):
        grams, n, v = model
        t = texts[i]
        for at in range(order - 1, len(t)):
            p, told, c = [1 / (v + 1), grams[0][t[at],] / n], [1, 1], n
            for k in range(1, order):
                c = grams[k - 1][tuple(t[at - k : at])]
                p.append(grams[k][tuple(t[at - k : at + 1])] / c if c else 0.0)
                told.append(c > 0)
            yield (1 + int(math.log2(c)) if c else 0), p, told

    kept = counts([i for i in texts if role[i] > 1])
    rows = [x for i in texts if role[i] == 0 for x in estimates(kept, i)]
    bucket, p = np.array([x[0] for x in rows]), np.array([x[1] for x in rows])
    w = lm.learn_weights(bucket, np.ones(len(bucket)), p)
    train = counts([i for i in texts if role[i] != 1])
    got = {r.doc_id: r.score for r in lm.score(d, order).collect()}
    for i in texts:
        want = 0.0
        for b, q, seen in estimates(train, i):
            x = w[b] * seen
            want += math.log10((x @ q) / x.sum())
        assert math.isclose(got[i], want, rel_tol=2e-3), (i, got[i], want)


def test_lm_probabilities_of_all_words_sum_to_one():
    """After a seen context and after an unseen one, over the vocabulary and one unknown word."""
    weights = np.full((lm.CONTEXT_BUCKETS, 3), [0.2, 0.3, 0.5])
    vocabulary, n = 9, 40.0
    one = np.array([10, 8, 7, 5, 4, 3, 1, 1, 1, 0.0])
    two = np.array([3, 2, 1, 0, 0, 0, 0, 0, 0, 0.0])
    for context, told in ((6.0, [1, 1, 1]), (0.0, [1, 1, 0])):
        p = np.stack([np.full(10, 1 / (vocabulary + 1)), one / n, two / context if context else 0 * two])
        w = weights[0] * told
        assert math.isclose(((w / w.sum()) @ p).sum(), 1.0)


def test_toxicity_equals_plain_features_and_weights(spark):
    sf = "/root/testdata/sf0.01"
    d, labels = docs_of(spark, sf), spark.read.parquet(f"{sf}/labels.parquet")
    half = labels.filter("doc_id % 2 = 0")
    chosen, model = toxicity.fit(d.select("doc_id", "text"), half.select("doc_id", "toxic"))
    theta = model.theta()
    got = {r.doc_id: r for r in toxicity.grade(d, half).collect()}
    for r in d.collect():
        ws = r.text.split()
        n = collections.Counter(chosen[f] for w in ws for f in toxicity.features_of(w) if f in chosen)
        s = sum(model.w[i] * math.log1p(100 * c / max(len(ws), 20)) for i, c in n.items())
        below = [1 / (1 + math.exp(min(s - t, 700))) for t in theta]
        severity = (below[1] - below[0]) + 2 * (1 - below[1])
        assert math.isclose(got[r.doc_id].severity, severity, abs_tol=1e-6)
        assert got[r.doc_id].toxic == (got[r.doc_id].severity >= toxicity.TOXIC_FROM)


def test_toxicity_of_labels_that_were_held_back(spark):
    """Half the labels of the larger table are enough; README tells what fewer come to."""
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    got = toxicity.grade(docs_of(spark, sf), labels.filter("doc_id % 2 = 0")).select("doc_id", "toxic").join(labels.filter("doc_id % 2 = 1").withColumnRenamed("toxic", "y"), "doc_id").toPandas()
    assert got.toxic[got.y == 1].mean() >= 0.93 and got.toxic[got.y == 0].mean() <= 0.005


def test_fertility_verdicts_equal_plain_bands(spark):
    import sentencepiece

    sf, path = "/root/testdata/sf0.01", str(public.path("piece_bpe_32k.model"))
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    got = {r.doc_id: r for r in fertility.rate(docs_of(spark, sf), path).collect()}
    for r in docs_of(spark, sf).filter("doc_id % 10 = 0").collect():
        ids = [i for w in r.text.encode().split() for i in sp.encode(w.decode())]
        g = got[r.doc_id]
        n = collections.Counter(ids)
        assert g.n_tokens == len(ids) and math.isclose(g.chars_per_token, g.word_chars / len(ids))
        assert math.isclose(g.byte_share, sum(map(sp.is_byte, ids)) / len(ids), abs_tol=1e-12)
        assert math.isclose(g.entropy, -sum(c / len(ids) * math.log2(c / len(ids)) for c in n.values()), abs_tol=1e-9)
    names = ("chars_per_token", "byte_share", "entropy")
    passed = {(g.band, int(math.log2(g.n_tokens)), g.n_tokens, *(g[c] for c in names)) for g in got.values() if not g.base_failed}

    def band(rows, k, one):
        x = sorted(r[3 + k] for r in rows)
        a, m, b = (x[math.ceil(q * len(x)) - 1] for q in (0.25, 0.5, 0.75))
        least = (fertility.LEAST if one else fertility.ALL_LEAST)[names[k]]
        wide = fertility.WIDE if one else fertility.ALL_WIDE
        floor = least if names[k] == "byte_share" else m * least
        top = m * max(least, fertility.LEAST_RICH) if names[k] == "entropy" else floor
        return m - max(wide * (m - a), floor), m + max(wide * (b - m), top)

    dropped = 0
    for g in got.values():
        rows = [r for r in passed if r[0] == g.band]
        own = [r for r in rows if r[1] == int(math.log2(max(g.n_tokens, 1)))]
        one = len(own) >= fertility.CLASS_TEXTS
        ends = [band(own if one else rows, k, one) for k in range(3)] if rows else []
        fine = all(lo - 1e-9 <= g[c] <= hi + 1e-9 for c, (lo, hi) in zip(names, ends))
        assert g.kept == (not g.base_failed and fine), g.doc_id
        dropped += not g.base_failed and not g.kept
    assert dropped > 10
