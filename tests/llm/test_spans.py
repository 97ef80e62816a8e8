"""Guess costs against all segmentations, marginals against all labellings, spans that the methods add."""

import itertools
import math
import random

import numpy as np
import pytest

from papyra.llm import pii, secrets

public = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def ranks():
    return secrets.word_ranks(str(public.path("word_bpe_49k.json")))


def test_guess_cost_is_that_of_the_cheapest_of_all_segmentations(ranks):
    rng = random.Random(4)
    parts = ["pass", "word", "dragon", "19", "1990", "abc", "aaa", "X", "!", "qwe", "q7", "r2d2", "sun"]
    for _ in range(300):
        v = "".join(rng.choices(parts, k=rng.randint(1, 3)))[:9]
        one = secrets.char_cost(v)
        cost = {(i, j): one * (j - i) for i in range(len(v)) for j in range(i + 1, len(v) + 1)}
        for j, spans in enumerate(secrets._pieces(v, ranks)):
            for i, c in spans:
                cost[i, j] = min(cost[i, j], c)
        want = math.inf
        for cuts in itertools.product((0, 1), repeat=len(v) - 1):
            ends = [0, *(i + 1 for i, c in enumerate(cuts) if c), len(v)]
            m = len(ends) - 1
            want = min(want, sum(cost[a, b] for a, b in itertools.pairwise(ends)) + sum(math.log10(min(k, 8)) for k in range(1, m + 1)))
        assert math.isclose(secrets.guess_cost(v, ranks), want, abs_tol=1e-9), v


def test_words_of_the_vocabulary_are_no_secrets(ranks):
    assert len(ranks) > 20_000 and ranks["password"] == 1
    for v in ("encyclopedia", "photographer", "International", "government"):
        assert secrets.guess_cost(v, ranks) < 6
        assert secrets.added_spans(f"token_name password: {v}s", [], ranks=ranks) == []
    (span,) = secrets.added_spans("pwd: correct7Horse!battery", [], ranks=ranks)
    assert span[2] == "guess"


def exact(field, x, u, v, kind):
    n, labels = len(x), len(pii.KINDS) + 1
    p = np.zeros((n, labels))
    for y in itertools.product(range(labels), repeat=n):
        s = sum((x[i] @ field.w)[y[i]] for i in range(n)) + sum(field.pair[k, y[a], y[b]] for a, b, k in zip(u, v, kind, strict=True))
        for i in range(n):
            p[i, y[i]] += math.exp(s)
    return p / p.sum(1, keepdims=True)


def test_marginals_of_small_graphs():
    rng = np.random.default_rng(2)
    field = pii.Field()
    field.w, field.pair = rng.normal(size=field.w.shape), rng.normal(size=field.pair.shape)
    x = rng.random((5, pii.N_FEATURES)) < 0.3
    tree = np.array([[0, 1, 1], [1, 2, 3], [0, 1, 2]])  # edges 0-1, 1-2, 1-3; node 4 stands alone
    assert np.allclose(field.marginals(x * 1.0, *tree), exact(field, x * 1.0, *tree), atol=1e-3)
    field.pair *= 0.3
    loop = np.array([[0, 1, 2, 0], [1, 2, 3, 3], [0, 1, 2, 1]])
    assert np.abs(field.marginals(x * 1.0, *loop) - exact(field, x * 1.0, *loop)).max() < 0.03


def test_forms_link_all_mentions_to_the_first():
    g, text = pii.Graph(), "call +49 30 5551234 or 0305551234. Later (030)5551234 x 030-5551234; a.b@c.de and A.B@C.DE, z@c.de, so a.b@ and 10.1.2.3 or 10-1-2-3"
    g.add(0, text)
    assert [text[s:e] for s, e in g.span] == ["+49 30 5551234", "0305551234", "(030)5551234", "030-5551234", "a.b@c.de", "A.B@C.DE", "z@c.de", "a.b@", "10.1.2.3", "10-1-2-3"]
    edges = {(u, v, k) for u, v, k in zip(g.u, g.v, g.kind, strict=True)}
    assert {(0, 1, 2), (0, 2, 2), (4, 5, 1), (4, 6, 3), (4, 7, 2), (8, 9, 2)} <= edges and all(u < v for u, v, _ in edges)


def test_groups_of_digits_are_one_node_up_to_the_longest_number():
    nodes = lambda t: [t[s:e] for _, s, e in pii.Graph().runs(t)]
    assert nodes("pay 4111 1111 1111 1111, or 12  34 and 5 x7 8") == ["4111 1111 1111 1111", "12", "34", "5", "x7", "8"]
    assert nodes("1111 2222 3333 4444 5555 6666") == ["1111 2222 3333 4444", "5555 6666"] and nodes("no marks") == [] and nodes("+49 (30) 123") == ["+49 (30) 123"]


def made_texts(n, seed):
    rng = np.random.default_rng(seed)
    d = lambda k: "".join(map(str, rng.integers(0, 10, k)))
    out = []
    for i in range(n):
        card = d(15)
        card += next(c for c in "0123456789" if pii.luhn(card + c))
        parts = [f"Call +1 {d(3)} {d(7)} today.", f"Mail user{d(4)}@host{i % 9}.org now.", f"Host 10.{i % 200}.{rng.integers(255)}.{rng.integers(255)} is up.", f"Card {card[:4]} {card[4:8]} {card[8:12]} {card[12:]} was used.", f"Order {rng.integers(10, 99999)} of {rng.integers(1, 31)} May, part {d(9)}."]
        out.append(" ".join(parts[int(k)] for k in rng.permutation(5)[: rng.integers(2, 6)]))
    return out


def test_bare_mentions_are_found_and_made_up_ones_are_not():
    """Held-out texts: entities of all four kinds mentioned once more in forms that no pattern finds, beside others of the same forms."""
    field = pii.learn(made_texts(400, 1))
    texts, where, decoys = pii.planted(made_texts(200, 2), seed=3)
    base = [pii.base_spans(t) for t in texts]
    got = pii.added_spans(field, texts, base)
    hidden = [[x for x in own if not any(a < x[2] and x[1] < b for _, a, b in found)] for own, found in zip(where, base, strict=True)]
    right = sum(x in own for own, more in zip(hidden, got, strict=True) for x in more)
    told, there = sum(map(len, got)), sum(map(len, hidden))
    assert there > 300 and right / there > 0.9 and right / told > 0.95
    kinds = {k for own, more in zip(hidden, got, strict=True) for k, *_ in set(own) & set(more)}
    assert kinds == set(pii.KINDS)
    clean = [t for t in made_texts(200, 4)]
    assert not any(pii.added_spans(field, clean, [pii.base_spans(t) for t in clean]))


def test_plain_repeats_of_each_kind_are_added():
    field = pii.learn(made_texts(400, 1))
    for kind, text, bare in (
        ("phone", "Tel +49 30 1234567 was given. Ask again at 0301234567 there, on day 30, part 9285550199.", "0301234567"),
        ("phone", "Tel +49 30 1234567 was given. Ask for 1234567 there.", "1234567"),
        ("email", "Write to jane.doe@example.com soon. Else jane.doe@example will do, not john@sample or 12.", "jane.doe@example"),
        ("card", "Paid by 4111 1111 1111 1111 first. Then 4111/1111/1111/1111 once more, room 12.", "4111/1111/1111/1111"),
        ("ip", "From 10.121.32.203 at noon. Then 10-121-32-203 again and 10-90-81-177.", "10-121-32-203"),
    ):
        got = pii.added_spans(field, [text], [pii.base_spans(text)])[0]
        assert [(k, text[s:e]) for k, s, e in got] == [(kind, bare)], (text, got)
