"""Evidence windows: a hit with its neighbours under the same heading, within a token budget."""

from __future__ import annotations

import re
from dataclasses import dataclass, replace

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papyra.functions.questions import tokens
from papyra.operators.retrieval import without_overlap

#: Tokens of a hit's window, neighbours on a side and the most there can be, how far a cut looks for a sentence's end, characters that count as an overlap.
BUDGET, NEIGHBOURS, MOST, REACH, OVERLAP = 768, 1, 10, 96, 24

_END = re.compile(r"[\n\r。！？；.!?;]")
_GENERIC = {"请问", "什么", "如何", "怎么", "这个", "那个", "please", "what", "how", "this", "that"}


@dataclass
class Excerpt:
    idx: int
    heading: str
    text: str
    cut: bool = False

    def line(self, anchor: bool = False) -> str:
        h = self.heading.strip()
        return (">>> " if anchor else "") + (f"[{h}] " if h else "") + self.text


def ahead(text: str, at: int) -> int:
    """The end of the sentence at a place, if it is near, else the place."""
    m = _END.search(text, max(0, at), min(len(text), at + REACH))
    return m.end() if m else at


def back(text: str, at: int) -> int:
    """The start of the sentence before a place, if it is near, else the place."""
    ends = [m.end() for m in _END.finditer(text, max(0, at - REACH), min(at, len(text)))]
    return ends[-1] if ends else at


def focus_at(text: str, focus: str) -> tuple[int, int] | None:
    """Where the focus stands in a text: whole, else its longest word or pair of CJK characters that is there."""
    low, f = text.lower(), focus.strip().lower()
    words = [w for w in re.findall(r"[a-z0-9_./:-]+|[㐀-鿿]+", f) if w not in _GENERIC]
    words += [w[i : i + 2] for w in words if not w.isascii() for i in range(len(w) - 1)]
    for w in [f, *sorted(words, key=len, reverse=True)]:
        if len(w) >= 2 and (at := low.find(w)) >= 0:
            return at, at + len(w)
    return None


def cropped(e: Excerpt, n: int, keep: str, focus: str = "") -> Excerpt:
    """About ``n`` characters of an excerpt: its head, its tail, or what is around the focus, cut at sentences where one ends near."""
    if n >= len(e.text):
        return e
    at = focus_at(e.text, focus) if keep == "focus" else None
    if n <= 0:
        a = b = 0
    elif keep == "tail":
        a, b = back(e.text, len(e.text) - n), len(e.text)
    elif at is None:
        a, b = 0, ahead(e.text, n)
    else:
        middle = sum(at) // 2
        a = back(e.text, max(0, min(len(e.text) - n, middle - n // 2)))
        b = ahead(e.text, min(len(e.text), a + n))
        if b - a > n:  # a sentence's end too much: the focus stays inside
            a = min(max(a, at[1] - n), at[0])
            b = min(len(e.text), a + n)
    return replace(e, text=e.text[a:b], cut=True)


def fitted(e: Excerpt, budget: int, keep: str, anchor: bool = False, focus: str = "") -> Excerpt:
    """The longest crop that costs no more than the budget with its marks; a heading that would eat the budget is left out."""
    cost = lambda x: tokens(x.line(anchor))
    if cost(e) <= budget:
        return e
    if e.heading and cost(replace(e, text="")) >= budget:
        e = replace(e, heading="")
    best, lo, hi = replace(e, text="", cut=True), 0, len(e.text)
    while lo <= hi and budget > 0:
        n = (lo + hi) // 2
        c = cropped(e, n, keep, focus)
        if cost(c) <= budget:
            best, lo = c, n + 1
        else:
            hi = n - 1
    return best


def _side(nearest: list[Excerpt], room: int, keep: str) -> list[Excerpt]:
    """Excerpts nearest first as long as they fit; the first that doesn't is cropped and ends the side."""
    out = []
    for e in nearest:
        if room <= 0:
            break
        cost = tokens(e.line())
        if cost > room:
            e = fitted(e, room, keep)
            if e.text:
                out.append(e)
            break
        out.append(e)
        room -= cost
    return out


def serialized(before: list[Excerpt], anchor: Excerpt, after: list[Excerpt]) -> str:
    return "\n\n".join([*(e.line() for e in before), anchor.line(True), *(e.line() for e in after)])


def compose(chunks: list[tuple[int, str, str]], anchor: int, radius: int = NEIGHBOURS, budget: int = BUDGET, focus: str = "", cross_heading: bool = False) -> tuple[str, int, int]:
    """(evidence, first idx, last idx) around the chunk ``anchor`` of (idx, heading, text).

    Neighbours reach from the anchor to the first gap or other heading, ``radius`` on a side. The anchor is cropped
    around the focus if it alone is over the budget; what is left is halved between the sides, and what one doesn't use
    the other gets. Text that an excerpt shares with the one nearer to the anchor is read once. If the whole is still
    over the budget, the farthest excerpts are cut, then dropped.
    """
    known = {i: Excerpt(i, h or "", t) for i, h, t in chunks}
    hit = fitted(known[anchor], budget, "focus", True, focus)
    same = lambda e: cross_heading or e.heading.strip() == known[anchor].heading.strip()

    def reach(step: int) -> list[Excerpt]:
        out, i = [], anchor + step
        while i in known and same(known[i]) and len(out) < min(radius, MOST):
            out.append(known[i])
            i += step
        return out

    before, after = reach(-1), reach(1)  # nearest first
    inner = hit
    for n, e in enumerate(after):
        text = without_overlap(inner.text, e.text, OVERLAP)
        after[n] = inner = replace(e, text=text)
    inner = hit
    for n, e in enumerate(before):
        shared = without_overlap(e.text, inner.text, OVERLAP)
        k = len(inner.text) - len(shared)
        before[n] = replace(e, text=e.text[: len(e.text) - k]) if k else e
        inner = e
    before, after = [e for e in before if e.text], [e for e in after if e.text]
    left = max(0, budget - tokens(hit.line(True)))
    half = left // 2 if before and after else (left if before else 0)
    used = lambda side: tokens("\n\n".join(e.line() for e in side))
    b, a = _side(before, half, "tail"), _side(after, left - half if after else 0, "head")
    if after and used(b) < half:
        a = _side(after, left - used(b), "head")
    if before and used(a) < left - half:
        b = _side(before, left - used(a), "tail")
    while (over := tokens(serialized(b[::-1], hit, a)) - budget) > 0 and (a or b):
        far, keep = (a, "head") if not b or (a and a[-1].idx - anchor >= anchor - b[-1].idx) else (b, "tail")
        e = far.pop()
        less = fitted(e, max(0, tokens(e.line()) - over - 1), keep)
        if less.text and len(less.text) < len(e.text):
            far.append(less)
    ids = [e.idx for e in (*b, hit, *a)]
    return serialized(b[::-1], hit, a), min(ids), max(ids)


def windows(hits: DataFrame, chunks: DataFrame, radius: int = NEIGHBOURS, budget: int = BUDGET, focus: str = "", cross_heading: bool = False) -> DataFrame:
    """(doc_id, idx, first, last, tokens, evidence) of (doc_id, idx) hits in (doc_id, idx, heading, text).

    The neighbours of a hit are found by a join on equal keys; a window's rows are at most 2 * radius + 1, so each is put
    together by itself.
    """
    around = hits.select("doc_id", F.col("idx").alias("hit"), F.explode(F.sequence(F.col("idx") - radius, F.col("idx") + radius)).alias("idx"))
    near = chunks.select("doc_id", "idx", "heading", "text").join(around, ["doc_id", "idx"])
    key = chunks.schema["doc_id"].dataType.simpleString()

    def f(g: pd.DataFrame) -> pd.DataFrame:
        hit = int(g["hit"].iloc[0])
        text, first, last = compose(list(zip(g["idx"], g["heading"], g["text"], strict=True)), hit, radius, budget, focus, cross_heading)
        return pd.DataFrame({"doc_id": [g["doc_id"].iloc[0]], "idx": [hit], "first": [first], "last": [last], "tokens": [tokens(text)], "evidence": [text]})

    return near.groupBy("doc_id", "hit").applyInPandas(f, f"doc_id {key}, idx long, first long, last long, tokens long, evidence string")
