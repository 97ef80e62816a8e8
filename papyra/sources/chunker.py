"""Chunks that follow a text's structure: headings, fences, scored breaks, and merging by likeness of vectors.

One text at a time is cut, with work in proportion to its length, so these run in Arrow batches of whole texts.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papyra.functions.text import CJK, normalize

#: Sizes in tokens, the share of a window that is searched for a break, and what a break's score loses over it.
SIZE, LEAST, TAIL, DECAY, SIMILAR = 800, 64, 0.22, 0.7, 0.75
#: How good a place for a cut is.
SCORES = {"h1": 100, "h2": 90, "h3": 80, "h4": 70, "h5": 60, "h6": 50, "fence": 80, "rule": 60, "paragraph": 20, "sentence": 8, "list": 5}
#: Where a piece with too many tokens is halved, best first.
HALVES = ("\n\n", "。", "！", "？", "，", ", ", " ")

_CJK = re.compile(f"[{CJK}]")
_FENCE = re.compile(r"[ \t]*(`{3,}|~{3,})")
_HEADING = re.compile(r"[ \t]*(?:(?P<marks>#{1,6})[ \t](?P<title>.*)|(?P<number>\d+(?:\.\d+)+)[ \t]+(?P<name>\S.*))")
_KINDS = [
    ("paragraph", re.compile(r"[ \t]*$")),
    ("heading", re.compile(r"[ \t]*(#{1,6})[ \t]")),
    ("fence", _FENCE),
    ("rule", re.compile(r"[ \t]*(?:-{3,}|\*{3,}|_{3,})$")),
    ("list", re.compile(r"[ \t]*(?:[-*] |\d+\.[ \t])")),
]

Piece = tuple[str, str]  #: text, and the path of headings above it


def tokens(text: str) -> int:
    """The estimate of papyra.functions.text.token_estimate."""
    cjk = len(_CJK.findall(text))
    return max(1, int(np.ceil(cjk / 1.5 + (len(text) - cjk) / 4))) if text else 0


def characters(text: str, size: int) -> int:
    """A budget of tokens as characters of this text."""
    return max(LEAST, int(max(size, LEAST) * len(text) / max(tokens(text), 1) + 0.5))


def blocks(text: str) -> Iterator[Piece]:
    """Paragraphs and fenced parts with their heading paths; a fence is kept whole, headings themselves are in the paths."""
    above: dict[int, str] = {}
    held: list[str] = []
    fence = ""

    def done() -> Iterator[Piece]:
        if whole := "\n".join(held).strip():
            yield whole, " > ".join(above[k] for k in sorted(above) if above[k])
        held.clear()

    for line in text.split("\n"):
        if fence:
            held.append(line)
            if len(mark := line.strip()) >= len(fence) and not mark.strip(fence[0]):
                fence = ""
        elif opened := _FENCE.match(line):
            yield from done()
            fence = opened[1]
            held.append(line)
        elif head := _HEADING.match(line):
            yield from done()
            level = len(head["marks"]) if head["marks"] else min(6, head["number"].count(".") + 1)
            above = {k: v for k, v in above.items() if k < level}
            above[level] = head["title"].strip() if head["marks"] else f"{head['number']} {head['name'].strip()}"
        elif line.strip():
            held.append(line)
        else:
            yield from done()
    yield from done()


def breaks(text: str, low: int) -> Iterator[tuple[int, int]]:
    """(place, score) of the cuts that structure offers after ``low``: the end of a marked line, behind an empty one, behind a CJK full stop."""
    at = low
    for line in text[low:].split("\n"):
        end = at + len(line)
        for kind, form in _KINDS:
            if found := form.match(line):
                name = f"h{len(found[1])}" if kind == "heading" else kind
                yield (min(end + 1, len(text)) if kind == "paragraph" else end), SCORES[name]
                break
        at = end + 1
    for stop in re.finditer("[。！？]", text[low:]):
        yield low + stop.end(), SCORES["sentence"]


def windows(text: str, size: int, overlap: int = 0) -> Iterator[str]:
    """A long block in windows of at most ``size`` characters, each cut at the best break of its last 22 %."""
    start = 0
    while len(text) - start > size:
        part = text[start : start + size]
        low = max(1, size - max(1, int(size * TAIL + 0.5)))
        span = len(part[low:].encode()) or 1  # a break fades by its distance in bytes
        rated = [(score * DECAY ** (len(part[low:p].encode()) / span), -p) for p, score in breaks(part, low) if p > low]
        cut = -max(rated)[1] if rated else size
        if piece := part[:cut].strip():
            yield piece
        start += max(1, cut - min(overlap, cut - 1))
    if piece := text[start:].strip():
        yield piece


def smart(text: str | None, size: int = SIZE, overlap: int = 0) -> list[Piece]:
    """Pieces of a normalised text. A block stays whole if its bytes fit the budget; a text that is all headings gives its beginning, null or empty none.

    ``overlap`` is 0 by default: neighbours are found by evidence windows, so repeated text serves nothing.
    """
    if not text:
        return []
    room = characters(text, size)
    repeat = int(overlap * len(text) / max(tokens(text), 1) + 0.5)
    out = []
    for block, path in blocks(text):
        out += [(block, path)] if len(block.encode()) <= room else [(w, path) for w in windows(block, room, repeat)]
    return out or [(text[:room], "")]


def refine(pieces: list[Piece], limit: int) -> list[Piece]:
    """Pieces over ``limit`` tokens halved near the middle at the best separator, again and again; those that offer none stay."""
    if limit <= 0:
        return list(pieces)
    out, todo = [], list(reversed(pieces))
    while todo:
        text, path = todo.pop()
        half = _halves(text) if tokens(text) > limit and len(text.encode("utf-8", "surrogatepass")) >= 40 else None
        if half:
            todo += [(half[1], path), (half[0], path)]
        else:
            out.append((text, path))
    return out


def _halves(text: str) -> tuple[str, str] | None:
    """A text in two at the last of the best separators within a quarter of its bytes around the middle; a UTF-8 separator is found at characters only."""
    raw = text.encode("utf-8", "surrogatepass")
    reach = max(1, len(raw) // 4)
    low, high = max(0, len(raw) // 2 - reach), min(len(raw), len(raw) // 2 + reach)
    for mark in HALVES:
        at = raw.rfind(mark.encode(), low, high)
        if at >= 0:
            cut = at + len(mark.encode())
            left, right = (x.decode("utf-8", "surrogatepass").strip() for x in (raw[:cut], raw[cut:]))
            if left and right:
                return left, right
    return None


def merge(segments: list[Piece], vectors: list[np.ndarray | None], size: int = SIZE, threshold: float = SIMILAR) -> list[tuple[str, str, list[float] | None]]:
    """Neighbours joined, greedily, while they fit and their cosine reaches the threshold; a joined vector is the mean weighted by bytes.

    A segment without a vector joins if it fits. The first segment's heading path stays.
    """
    room = characters("\n".join(s for s, _ in segments), size) if segments else 0
    out: list[list] = []  # text, path, vector, weight
    for (text, path), v in zip(segments, vectors, strict=True):
        n = len(text.encode())
        v = None if v is None else np.asarray(v, float)
        if out and len(out[-1][0].encode()) + n + 1 <= room and _alike(out[-1][2], v, threshold):
            last = out[-1]
            if last[2] is not None and v is not None:
                last[2] = (last[2] * last[3] + v * n) / (last[3] + n)
                last[3] += n
            last[0] += "\n" + text
        else:
            out.append([text, path, v, n])
    return [(t, p, None if v is None else v.tolist()) for t, p, v, _ in out]


def _alike(a: np.ndarray | None, b: np.ndarray | None, threshold: float) -> bool:
    if a is None or b is None:
        return True
    norm = np.linalg.norm(a) * np.linalg.norm(b)
    return bool(norm > 0 and a @ b / norm >= threshold)


def hashed_words(texts: list[str], dims: int = 64) -> np.ndarray:
    """The embedder that needs no model: words counted in ``dims`` cells by crc32, length 1; the first axis for a text without words."""
    from zlib import crc32

    out = np.zeros((len(texts), dims))
    for row, text in zip(out, texts, strict=True):
        for word in re.findall(r"\w+", (text or "").lower()):
            row[crc32(word.encode()) % dims] += 1
        if not row.any():
            row[0] = 1
    return out / np.linalg.norm(out, axis=1, keepdims=True)


_PIECES = "array<struct<text: string, heading: string>>"


def smart_chunks(docs: DataFrame, size: int = SIZE, limit: int = 0, overlap: int = 0) -> DataFrame:
    """(doc_id, idx, heading, text): smart pieces of ``text``, halved where they pass ``limit`` tokens. Null and empty texts give no row."""

    @F.pandas_udf(_PIECES)
    def cut(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            yield pd.Series([[{"text": t, "heading": h} for t, h in refine(smart(x, size, overlap), limit)] for x in texts], dtype=object)

    return _laid_out(docs, cut(normalize(F.col("text"))))


def semantic_chunks(docs: DataFrame, embed: Callable[[list[str]], np.ndarray] = hashed_words, size: int = SIZE, threshold: float = SIMILAR) -> DataFrame:
    """(doc_id, idx, heading, text): blocks of ``text`` merged while their vectors are alike. Null and empty texts give no row."""

    @F.pandas_udf(_PIECES)
    def cut(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            out = []
            for x in texts:
                found = list(blocks(x or ""))
                joined = merge(found, list(embed([t for t, _ in found])) if found else [], size, threshold)
                out.append([{"text": t, "heading": h} for t, h, _ in joined])
            yield pd.Series(out, dtype=object)

    return _laid_out(docs, cut(normalize(F.col("text"))))


def _laid_out(docs: DataFrame, pieces) -> DataFrame:
    found = docs.select("doc_id", F.posexplode(pieces).alias("i", "p"))
    return found.select("doc_id", F.col("i").cast("long").alias("idx"), "p.heading", "p.text")


def embedded(chunks: DataFrame, known: DataFrame, embed: Callable[[list[str]], np.ndarray] = hashed_words, model: str = "hashed-words", batch: int = 256) -> DataFrame:
    """(doc_id, idx, text_hash, model, vector, reused) of chunks (doc_id, idx, text).

    ``known`` (text_hash, model, vector) gives vectors made before by the same model; every other distinct text is embedded once.
    """
    hashed = chunks.select("doc_id", "idx", "text", F.sha2("text", 256).alias("text_hash"))
    old = known.filter(F.col("model") == model).select("text_hash", "vector").dropDuplicates(["text_hash"])

    @F.pandas_udf("array<double>")
    def vectors(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            made = [embed(list(texts[i : i + batch])) for i in range(0, len(texts), batch)]
            if sum(map(len, made)) != len(texts) or any(not np.isfinite(m).all() for m in made):
                raise ValueError("an embedder must return one finite vector a text")
            yield pd.Series([v.tolist() for m in made for v in m], dtype=object)

    new = hashed.select("text_hash", "text").dropDuplicates(["text_hash"]).join(old, "text_hash", "left_anti").select("text_hash", vectors("text").alias("vector"))
    every = old.withColumn("reused", F.lit(True)).unionByName(new.withColumn("reused", F.lit(False)))
    return hashed.drop("text").join(every, "text_hash").select("doc_id", "idx", "text_hash", F.lit(model).alias("model"), "vector", "reused")
