"""Secret scans: fixed patterns, and values in credential contexts that would cost many guesses.

The guess cost of a value is that of its cheapest segmentation into words, dates,
repeats, keyboard walks or sequences, and brute-force spans, found by dynamic
programming. Words cost their rank: first those that people put into passwords,
then the whole words of a public tokenizer's vocabulary in its order, which is that
of how often they are met. A brute-force character costs as many guesses as the kinds of
characters in the value have members. Values that stand where a credential would (after "pwd =",
"client_secret:", "Bearer" and the like) and cost enough guesses are spans of
the kind ``guess``, beside the spans of the fixed patterns.
"""

from __future__ import annotations

import hashlib
import json
import math
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papyra.llm._util import small_batches

KINDS = ("assign", "access", "hex", "guess")

_ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
_HEX = re.compile(r"[0-9a-f]{16,}")
_HINT = re.compile(r"p(?:ass|wd|in\b)|secret|token|key|cred|auth|bearer|login", re.I | re.A)
#: Shortest value of a credential context.
SHORTEST = 8
#: Where a credential's value begins: a name, then a sign, or the word bearer or basic.
_CONTEXT = re.compile(
    r"""(?:(?:pass(?:word|wd|phrase|code)?|pwd|pin|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|credentials?|auth(?:orization)?|login)["']?[\x20\t]{0,3}(?::=|=>|[:=])[\x20\t]{0,3}(?:bearer\x20+|basic\x20+)?|\bbearer\x20+)["']?([^\s"'<>]{%d,})"""
    % SHORTEST,
    re.I | re.A,
)

#: log10 of the guesses from which a value counts as a secret.
GUESSES = 10.0
#: Kinds of characters and how many there are of each, of those outside ASCII about.
ALPHABETS = (("[a-z]", 26), ("[A-Z]", 26), ("[0-9]", 10), ("[\\x00-/:-@\\[-`{-\\x7f]", 33), ("[^\\x00-\\x7f]", 100))
#: Longest span that is matched as one piece.
LONGEST = 64

#: Words that people put into passwords, the commonest first.
WORDS = """password admin welcome login letmein dragon monkey master football baseball sunshine princess shadow
superman batman hello freedom whatever trust love secret summer winter spring autumn test user root guest default
changeme example sample demo temp null none true false token string value your here insert placeholder company
computer internet server service client private public access account system office house money happy family
january february march april june july august september october november december monday friday sunday""".split()

#: Rows of a keyboard, digits and the alphabet, along which fingers walk.
WALKS = ("qwertyuiop", "asdfghjkl", "zxcvbnm", "1234567890", "abcdefghijklmnopqrstuvwxyz", "qazwsxedcrfvtgbyhnujmikolp")

#: Letters that digits and signs are written for.
LEET = {"4": "a", "@": "a", "8": "b", "3": "e", "1": "i", "!": "i", "0": "o", "5": "s", "$": "s", "7": "t"}

#: Letters of the shortest and longest words that are looked up.
WORD_LETTERS = (3, 20)


def word_ranks(vocabulary: str | None = None) -> dict[str, int]:
    """Ranks of words: WORDS, then those of a vocabulary file of the library tokenizers whose tokens end words with </w>."""
    known = dict.fromkeys(WORDS)
    if vocabulary:
        with open(vocabulary, encoding="utf-8") as f:
            tokens = json.load(f)["model"]["vocab"]
        whole = (t[:-4] for t in sorted(tokens, key=tokens.get) if t.endswith("</w>"))
        known.update(dict.fromkeys(w for w in whole if w.isalpha() and WORD_LETTERS[0] <= len(w) <= WORD_LETTERS[1]))
    return {w: i for i, w in enumerate(known, 1)}


_RANK = word_ranks()
_NEXT = {(a, b) for row in WALKS for x in (row, row[::-1]) for a, b in zip(x, x[1:], strict=False)}
_DATE = re.compile(r"(?:19|20)\d\d[-/._]?(?:0[1-9]|1[0-2])[-/._]?(?:0[1-9]|[12]\d|3[01])|(?:0[1-9]|[12]\d|3[01])[-/._]?(?:0[1-9]|1[0-2])[-/._]?(?:19|20)\d\d|(?:19|20)\d\d")


def char_cost(v: str) -> float:
    """log10 of the guesses for a character of a value, by the alphabet that the value uses."""
    return math.log10(max(1, sum(n for kind, n in ALPHABETS if re.search(kind, v))))


def _pieces(v: str, ranks: dict[str, int]) -> list[list[tuple[int, float]]]:
    """For each end, (start, log10 guesses) of the spans that are cheaper than brute force."""
    out: list[list[tuple[int, float]]] = [[] for _ in range(len(v) + 1)]
    low = v.lower()
    plain = "".join(LEET.get(c, c) for c in low)
    one = char_cost(v)
    for i in range(len(v)):
        for n in range(WORD_LETTERS[0], min(WORD_LETTERS[1], len(v) - i) + 1):
            rank = ranks.get(low[i : i + n]) or 2 * ranks.get(plain[i : i + n], 0)
            if rank:
                out[i + n].append((i, math.log10(rank * (1 if v[i : i + n] == low[i : i + n] else 2) + 1)))
        m = _DATE.match(v, i)
        if m:
            out[m.end()].append((i, math.log10(365 * 60 if m.end() - i > 4 else 120)))
        j = i + 1
        while j < len(v) and j - i < LONGEST and (low[j - 1], low[j]) in _NEXT:
            j += 1
            if j - i >= 3:
                out[j].append((i, math.log10(94 * (j - i))))
        for size in range(1, 17):  # the same few characters again and again
            unit, j = v[i : i + size], i + size
            while len(unit) == size and v.startswith(unit, j):
                j += size
                if j - i >= 3:
                    out[j].append((i, size * one + math.log10((j - i) // size)))
                if j - i > LONGEST and not v.startswith(unit, j + size):
                    break
    return out


def guess_cost(value: str, ranks: dict[str, int] = _RANK) -> float:
    """log10 of the guesses for the cheapest segmentation; pieces in any order cost their number's factorial."""
    n = len(value)
    at, one = _pieces(value, ranks), char_cost(value)
    # best[k][j]: cheapest of the first j characters in k pieces; beyond a few pieces order is paid for at the last rate
    most = min(n, 8)
    best = [[math.inf] * (n + 1) for _ in range(most + 1)]
    best[0][0] = 0.0
    for j in range(1, n + 1):
        spans = at[j] + [(i, one * (j - i)) for i in range(max(0, j - LONGEST), j)]
        for i, cost in spans:
            for k in range(most):
                c = best[k][i] + cost + math.log10(k + 1)
                if c < best[k + 1][j]:
                    best[k + 1][j] = c
            c = best[most][i] + cost + math.log10(most)
            if c < best[most][j]:
                best[most][j] = c
    return min((best[k][n] for k in range(1, most + 1)), default=0.0) if n else 0.0


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the fixed patterns."""
    out = []
    if _HINT.search(text):
        out += [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 12]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text)]
    return out + [(m.start(), m.end(), "hex") for m in _HEX.finditer(text)]


def added_spans(text: str, base: list[tuple[int, int, str]], guesses: float = GUESSES, ranks: dict[str, int] = _RANK) -> list[tuple[int, int, str]]:
    """Credential values that no base span overlaps and that cost enough guesses, whatever kinds of characters they have."""
    out = []
    if not _HINT.search(text):
        return out
    for m in _CONTEXT.finditer(text):
        v = m[1].rstrip(".,;:!?)]}")
        if len(v) < SHORTEST:  # the signs at the end are no end of a sentence if the value needs them
            v = m[1]
        s, e = m.start(1), m.start(1) + len(v)
        if not any(a < e and s < b for a, b, _ in base) and guess_cost(v, ranks) >= guesses:
            out.append((s, e, "guess"))
    return out


def joined(spans: list[tuple[int, int, str]]) -> str:
    """kind:start:end by start, then kind."""
    return ",".join(f"{k}:{s}:{e}" for s, e, k in sorted(spans, key=lambda x: (x[0], KINDS.index(x[2]), x[1])))


def _scan(guesses: float, vocabulary: str | None):
    def f(batches):
        ranks = word_ranks(vocabulary)
        for b in batches:
            rows = []
            for d, t in zip(b["doc_id"], b["text"], strict=True):
                t = t or ""
                base = base_spans(t)
                more = added_spans(t, base, guesses, ranks)
                n = [sum(k == kind for _, _, k in base) for kind in KINDS[:3]]
                rows.append((d, *n, len(more), hashlib.sha256(joined(base).encode()).hexdigest(), joined(base + more)))
            yield pd.DataFrame(rows, columns=["doc_id", "n_assign", "n_access", "n_hex", "n_guess", "base_sha256", "spans"]).astype({"doc_id": "Int64"})

    return f


def scan(docs: DataFrame, guesses: float = GUESSES, vocabulary: str | None = None) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): counts by kind, a digest of the base spans, and all spans as text.

    Spans are code points, end exclusive, of the whole match (for ``guess``, of the value). A value of a credential
    context has SHORTEST characters or more. ``vocabulary`` is a file that the tasks can read, of the library
    tokenizers, whose whole words count as such (without it, those of WORDS alone). Null and empty texts have no spans. Rows are scanned each, repeated ones and null ids too; a text of any length is scanned whole. Columns
    other than doc_id and text are ignored. An empty table gives an empty table.
    """
    return small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(
        _scan(guesses, vocabulary), "doc_id long, n_assign long, n_access long, n_hex long, n_guess long, base_sha256 string, spans string"
    )
