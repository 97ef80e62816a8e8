"""Personal data: fixed patterns, and a skip-chain conditional random field that adds to them.

Nodes of the field are the words of a text that hold a digit or an at sign; groups
of digits with one space between are one node, as numbers are written so.
Neighbouring nodes share a chain potential. A node and the first one of equal
form (the same digits, or the same letters without case) share a skip potential,
and so do, by weights of their own, a node and the first one of similar form (the
same last seven digits, the same four numbers, the same local part of an address)
and of the same domain: all mentions are two edges apart at most, and an entity
that is plain in one place carries over to where it is not. Words before a node
that announce a kind ("tel", "server") are features too.

Weights are learned by pseudo-likelihood on a bounded number of texts whose labels
are the fixed patterns. Patterns alone would teach the field nothing but themselves,
so entities found in a text are mentioned once more in it for the fit, in forms that
no pattern finds, beside made-up ones of the same forms that stand for nothing.
Loopy message passing, until messages settle, gives each node's marginals; nodes that
are surely of a kind and that no fixed pattern found are added.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papyra.llm._util import sample_by_hash, small_batches

KINDS = ("email", "ip", "card", "phone")
#: About so many texts, those with low hashes, and characters of one, on which the field is fitted.
FIT_ROWS, FIT_CHARS = 2_000, 32_768
#: Digits from which a run of groups is as long as any number.
LONGEST = 19
#: A word's marginal from which it is added.
SURE = 0.95
#: What speaks for a label that a fixed pattern has found.
KNOWN = 30.0
#: Message passing ends when no message changes by more than STILL, or after ROUNDS.
ROUNDS, STILL, DAMP = 100, 1e-4, 0.3
#: Words that announce each kind.
CUES = (
    frozenset("email e-mail mail mailto contact write".split()),
    frozenset("ip host server address addr node client gateway".split()),
    frozenset("card visa mastercard credit debit payment pan".split()),
    frozenset("phone tel telephone call fax mobile cell number".split()),
)
#: Kinds of edges: neighbours, equal forms, similar forms, domains.
EDGES = 4

_LOCAL = frozenset(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-".decode())
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_MARK = re.compile(r"[0-9@]")
_NODE = re.compile(r"[^\x20\x09-\x0D]+")
_GROUP = re.compile(r"[+(]{0,2}[0-9][0-9()./-]*")
_EDGE = ".,;:!?\"'<>[]{}#*&$|"


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end), by kind as listed, then start."""
    out, upto, at = [], 0, text.find("@")
    while at >= 0:  # a local part holds no at sign, so the one match for this sign begins where the run before it does
        s = at
        while s > upto and text[s - 1] in _LOCAL:
            s -= 1
        m = _DOMAIN.match(text, at + 1) if s < at else None
        if m:
            out.append(("email", s, m.end()))
            upto = m.end()
        at = text.find("@", max(at + 1, upto))
    if not _MARK.search(text):
        return out
    out += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", m.start(), m.end()))
    if "+" in text:
        out += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 8 <= sum(c.isdigit() for c in m[0]) <= 15]
    return out


_DIGITS = [0, 1, 2, 3, 4, 5, 8, 11, 13, 16, 17, 20]
N_FEATURES = 1 + len(_DIGITS) + 5 + len(CUES) + 9


def features(word: str, before: list[str] = ()) -> np.ndarray:
    """What a word looks like (how many digits and dots, which signs) and what the words before it announce."""
    x = np.zeros(N_FEATURES)
    digits, dots = sum("0" <= c <= "9" for c in word), word.count(".")
    x[0] = 1
    x[int(np.searchsorted(_DIGITS, digits, side="right"))] = 1
    x[1 + len(_DIGITS) + min(dots, 4)] = 1
    parts = word.split(".")
    signs = (
        "@" in word[1:-1] and "." in word[word.find("@") :],
        "@" in word,
        len(parts) == 4 and all(p.isdigit() and len(p) < 4 and int(p) < 256 for p in parts),
        word.startswith("+"),
        any(c.isalpha() for c in word),
        "-" in word,
        "(" in word or ")" in word,
        word.isdigit(),
        16 <= digits <= 19 and not any(c.isalpha() for c in word) and luhn("".join(c for c in word if "0" <= c <= "9")),
    )
    x[-9:] = signs
    said = {w.strip(_EDGE).lower() for w in before}
    x[-9 - len(CUES) : -9] = [not said.isdisjoint(c) for c in CUES]
    return x


def forms(word: str) -> list[tuple[int, str]]:
    """(kind of edge, form): words that share one are linked."""
    digits, low = "".join(c for c in word if "0" <= c <= "9"), word.lower()
    out = [(1, digits if len(digits) >= 6 else low)]
    if len(digits) >= 7:
        out.append((2, "#" + digits[-7:]))
    numbers = re.split("[-._ ]", word)
    if len(numbers) == 4 and all(n.isascii() and n.isdigit() and len(n) < 4 for n in numbers):
        out.append((2, ".".join(numbers)))
    if "@" in low[1:]:
        local, domain = low.split("@", 1)
        out.append((2, local + "@"))
        if domain:
            out.append((3, "@" + domain.split(".")[0]))
    return out


class Graph:
    """Nodes and edges of the fields of several texts."""

    def __init__(self) -> None:
        self.x, self.span, self.doc, self.u, self.v, self.kind = [], [], [], [], [], []
        self.tail = 0

    def add(self, number: int, text: str) -> None:
        first: dict[tuple[int, str], int] = {}
        end, before = -10, -1
        for start, s, e in self.runs(text):
            w = text[s:e]
            me = len(self.x)
            self.x.append(features(w, text[max(0, start - 40) : start].split()[-3:]))
            self.span.append((s, e))
            self.doc.append(number)
            linked = set()
            if start - end == 1:
                linked.add(before)
                self.u.append(before), self.v.append(me), self.kind.append(0)
            for kind, form in forms(w):
                to = first.setdefault((kind, form), me)
                if to != me and to not in linked:
                    linked.add(to)
                    self.u.append(to), self.v.append(me), self.kind.append(kind)
            before, end = me, e + self.tail

    def runs(self, text: str):
        """(start of the first word, start, end) of each node: a word without the signs around it, or groups of digits with single spaces between, as many as make no number longer than any."""
        held: list[tuple[int, int, int]] = []  # start of the word, start and end without signs
        size = 0

        def done():
            yield held[0][0], held[0][1], held[-1][2]

        for m in self.words(text):
            raw = m[0]
            w = raw.strip(_EDGE)
            if not _MARK.search(w):
                continue
            s = m.start() + raw.find(w)
            e, digits = s + len(w), sum("0" <= c <= "9" for c in w)
            group = bool(_GROUP.fullmatch(w))
            joins = held and group and s == m.start() and m.start() - held[-1][2] == 1 and text[m.start() - 1] == " " and size + digits <= LONGEST and size > 0
            if not joins and held:
                yield from done()
                held = []
            held.append((m.start(), s, e))
            size = (size if joins else 0) + digits if group else 0
            self.tail = m.end() - e
            if not group:
                yield from done()
                held = []
        if held:
            yield from done()

    @staticmethod
    def words(text: str):
        """Words with a digit or at sign, from mark to mark, so texts without marks cost one search."""
        at = 0
        while m := _MARK.search(text, at):
            s = m.start()
            while s > at and text[s - 1] not in " \t\n\x0b\x0c\r":
                s -= 1
            w = _NODE.match(text, s)
            yield w
            at = w.end()


class Field:
    """Unary weights and two pair potentials over the labels none and KINDS."""

    def __init__(self) -> None:
        n = len(KINDS) + 1
        self.w, self.pair = np.zeros((N_FEATURES, n)), np.zeros((EDGES, n, n))

    def fit(self, x: np.ndarray, y: np.ndarray, u: np.ndarray, v: np.ndarray, kind: np.ndarray, steps: int = 600, rate: float = 0.1, penalty: float = 1e-3) -> None:
        """Pseudo-likelihood: each word given its neighbours' labels."""
        n, labels = len(y), len(KINDS) + 1
        one = np.eye(labels)
        moments = [[np.zeros_like(a), np.zeros_like(a)] for a in (self.w, self.pair)]
        for t in range(1, steps + 1):
            s = x @ self.w
            np.add.at(s, v, self.pair[kind, y[u]])
            np.add.at(s, u, self.pair[kind, :, y[v]])
            p = np.exp(s - s.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            d = (p - one[y]) / n
            g = np.zeros_like(self.pair)
            np.add.at(g, (kind, y[u]), d[v])
            np.add.at(g.transpose(0, 2, 1), (kind, y[v]), d[u])
            for a, grad, m in zip((self.w, self.pair), (x.T @ d + penalty * self.w / n, g + penalty * self.pair / n), moments, strict=True):
                m[0] = 0.9 * m[0] + 0.1 * grad
                m[1] = 0.99 * m[1] + 0.01 * grad * grad
                a -= rate * (m[0] / (1 - 0.9**t)) / (np.sqrt(m[1] / (1 - 0.99**t)) + 1e-8)

    def marginals(self, x: np.ndarray, u: np.ndarray, v: np.ndarray, kind: np.ndarray, known: np.ndarray | None = None) -> np.ndarray:
        """Loopy sum-product: all messages at once, damped, until they settle. Exact where edges form no loop. Nodes whose label is ``known`` (else 0) have it."""
        s = x @ self.w
        if known is not None:
            s = s + KNOWN * (known[:, None] == np.arange(s.shape[1])) * (known > 0)[:, None]
        a, b = np.concatenate([u, v]), np.concatenate([v, u])
        back = np.concatenate([np.arange(len(u)) + len(u), np.arange(len(u))])
        pot = np.concatenate([self.pair[kind], self.pair[kind].transpose(0, 2, 1)])
        m = np.zeros((len(a), s.shape[1]))
        total = s.copy()
        for _ in range(ROUNDS if len(a) else 0):
            out = (total[a] - m[back])[:, :, None] + pot
            top = out.max(1)
            new = top + np.log(np.exp(out - top[:, None, :]).sum(1))
            new -= new.max(1, keepdims=True)
            moved = np.abs(new - m).max()
            m = DAMP * m + (1 - DAMP) * new
            total = s.copy()
            np.add.at(total, b, m)
            if moved < STILL:
                break
        p = np.exp(total - total.max(1, keepdims=True))
        return p / p.sum(1, keepdims=True)


def _arrays(g: Graph) -> tuple:
    x = np.array(g.x).reshape(len(g.x), N_FEATURES)
    return x, *(np.array(a, np.int64) for a in (g.u, g.v, g.kind))


def _labels(g: Graph, base: list[list[tuple[str, int, int]]]) -> np.ndarray:
    y = np.zeros(len(g.x), np.int64)
    for i, (d, (s, e)) in enumerate(zip(g.doc, g.span, strict=True)):
        for kind, a, b in base[d]:
            if a < e and s < b:
                y[i] = KINDS.index(kind) + 1
                break
    return y


def bare(kind: str, said: str, rng) -> str:
    """An entity in a form that no fixed pattern finds."""
    n = "".join(c for c in said if "0" <= c <= "9")
    pick = lambda *xs: xs[int(rng.integers(len(xs)))]
    if kind == "phone":
        return pick(n, n[-7:], "0" + n[-9:], f"{n[:-7]} {n[-7:-4]} {n[-4:]}".strip(), f"({n[:-7]}) {n[-7:]}" if n[:-7] else n, f"{n[-7:-4]}-{n[-4:]}")
    if kind == "card":
        return pick(".".join(n[i : i + 4] for i in range(0, len(n), 4)), "/".join(n[i : i + 4] for i in range(0, len(n), 4)), n[-12:], n[-8:])
    if kind == "ip":
        return pick(said.replace(".", "-"), said.replace(".", "_"))
    local, domain = said.split("@", 1)
    return pick(local + "@", f"{local}@{domain.split('.')[0]}", (local + "@").upper())


def _other(said: str, rng) -> str:
    """The same form with other digits and letters."""
    return "".join(str(rng.integers(10)) if "0" <= c <= "9" else chr(97 + rng.integers(26)) if c.isalpha() else c for c in said)


def planted(texts: list[str], seed: int = 0, most: int = 3) -> tuple[list[str], list[list[tuple[str, int, int]]], list[list[tuple[int, int]]]]:
    """Texts with up to ``most`` of their entities mentioned once more, in bare forms, each beside a made-up one; where these stand: (kind, start, end), and (start, end)."""
    rng, out, where, decoys = np.random.default_rng(seed), [], [], []
    for t in texts:
        found = base_spans(t)
        picked = [found[i] for i in rng.permutation(len(found))[:most]]
        own, fake = [], []
        words = [w for w in t.split(" ")[:200] if w.isalpha()] or ["and"]
        for kind, s, e in picked:
            for real in (True, False):
                mention = bare(kind, t[s:e] if real else _other(t[s:e], rng), rng)
                t += " " + " ".join(words[int(i)] for i in rng.integers(len(words), size=2)) + " "
                (own if real else fake).append((kind, len(t), len(t) + len(mention)))
                t += mention + ("." if rng.random() < 0.3 else "")
        out.append(t)
        where.append(own)
        decoys.append([(s, e) for _, s, e in fake])
    return out, where, decoys


def learn(texts: list[str], seed: int = 0) -> Field:
    """A field fitted on texts as they are and on the same with planted mentions."""
    field, g = Field(), Graph()
    made, where, _ = planted(texts, seed)
    labels = [base_spans(t) for t in texts]
    for t, m, own in zip(texts, made, where, strict=True):
        labels.append(base_spans(m) + own if own else [])
    for i, t in enumerate([*texts, *(m if own else "" for m, own in zip(made, where, strict=True))]):
        g.add(i, t)
    if g.x:
        x, u, v, kind = _arrays(g)
        field.fit(x, _labels(g, labels), u, v, kind)
    return field


def fit(docs: DataFrame, fit_rows: int = FIT_ROWS, fit_chars: int = FIT_CHARS) -> Field:
    """A field fitted on about ``fit_rows`` texts that hold a digit or an at sign and no more than ``fit_chars`` characters; copies count once."""
    marked = docs.filter(F.col("text").rlike("[0-9@]") & (F.length("text") <= fit_chars)).select("text")
    some = sample_by_hash(marked, F.col("text"), fit_rows).groupBy(F.xxhash64("text").alias("h")).agg(F.first("text").alias("text"))
    return learn([r["text"] for r in sorted(some.collect(), key=lambda r: r["h"])])


def added_spans(field: Field, texts: list[str], base: list[list[tuple[str, int, int]]], sure: float = SURE) -> list[list[tuple[str, int, int]]]:
    """For each text the spans that the field adds: sure words apart from all base spans, neighbours of a kind as one."""
    g, out = Graph(), [[] for _ in texts]
    for i, t in enumerate(texts):
        g.add(i, t)
    if not g.x:
        return out
    p = field.marginals(*_arrays(g), known=_labels(g, base))
    best = p.argmax(1)
    for i in np.flatnonzero((best > 0) & (p.max(1) >= sure)):
        (s, e), d, kind = g.span[i], g.doc[i], KINDS[best[i] - 1]
        if any(a < e and s < b for _, a, b in base[d]):
            continue
        if out[d] and out[d][-1][0] == kind and s - out[d][-1][2] == 1:
            out[d][-1] = (kind, out[d][-1][1], e)
        else:
            out[d].append((kind, s, e))
    return out


def joined(spans: list[tuple[str, int, int]]) -> str:
    """kind:start:end by kind as listed, then start."""
    return ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(spans, key=lambda x: (KINDS.index(x[0]), x[1:])))


def _scan(field: Field, sure: float):
    def f(batches):
        for big in batches:
            for at in range(0, len(big), 1000):
                b = big.iloc[at : at + 1000]
                texts = [t or "" for t in b["text"]]
                base = list(map(base_spans, texts))
                more = added_spans(field, texts, base, sure)
                counts = [[sum(k == kind for k, _, _ in x) for x in base] for kind in KINDS]
                out = pd.DataFrame({"doc_id": b["doc_id"].astype("Int64").to_numpy()})
                for kind, n in zip(KINDS, counts, strict=True):
                    out[f"n_{kind}"] = n
                out["n_added"] = [len(x) for x in more]
                out["base_sha256"] = [hashlib.sha256(joined(x).encode()).hexdigest() for x in base]
                out["spans"] = [joined(x + y) for x, y in zip(base, more, strict=True)]
                yield out.astype({"doc_id": "Int64"})

    return f


def scan(docs: DataFrame, fit_rows: int = FIT_ROWS, sure: float = SURE) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): counts by kind, a digest of the base spans, and all spans as text.

    Spans are code points, end exclusive. Null and empty texts have no spans. Where no text holds a digit or an at sign
    nothing is learned or found. Rows are scanned each, repeated ones and null ids too; a text of any length is
    scanned whole. Columns other than doc_id and text are ignored. An empty table gives an empty table.
    """
    own = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    schema = "doc_id long, " + ", ".join(f"n_{k} long" for k in KINDS) + ", n_added long, base_sha256 string, spans string"
    return own.mapInPandas(_scan(fit(own, fit_rows), sure), schema)
