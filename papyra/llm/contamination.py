"""Benchmark decontamination: windows of the documents' words are looked up in a hash set of the tests' windows.

Words are compared in lower case (A-Z) and without signs. The tests' windows are a sorted array of hashes that goes to
every task; it is made of pieces of ``SET_BYTES`` of test text at most, and where tests are larger than that, each
piece is looked up in a pass of its own and the hits are put together by document. A hit by hash counts only if its
words are those of the test. Hit words, or documents with any, are taken out.
"""

from __future__ import annotations

import re
import uuid
from collections import defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from papyra.llm._util import WordHashes, fresh, mix64, numbered, settle, share, shingle_hashes, small_batches, worker_cache

#: Words in a window, windows in a segment of a test, bytes of test words that one set holds, words looked up at a time.
WINDOW, SEGMENT, SET_BYTES, AT_ONCE = 10, 4096, 8 << 20, 200_000
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
_SPANS = pa.list_(pa.struct([("from", pa.int32()), ("to", pa.int32())]))


def folded(text: str | None) -> list[bytes]:
    """The words of a text, A-Z in lower case: longest runs of ASCII letters, digits and anything beyond ASCII."""
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).split() if text else []


def _segments(width: int):
    """Tests as runs of words with all their windows; a long test is several that overlap by a window less one word."""

    def f(batches):
        for b in batches:
            rows = []
            for item, text in zip(b["item"], b["text"], strict=True):
                ws = folded(text)
                rows += [(item, b" ".join(ws[i : i + SEGMENT + width - 1])) for i in range(0, max(len(ws) - width + 1, 1), SEGMENT) if ws]
            yield pd.DataFrame(rows, columns=["item", "words"])

    return f


class _Windows:
    """Distinct windows of ``m`` words by hash, the place of one copy of each, and the items that hold it."""

    def __init__(self, m: int, segments: list[tuple[int, list[bytes]]], hashes: WordHashes):
        self.m, self.words, at, of = m, [], [], []
        for item, ws in segments:
            at.append(len(self.words) + np.arange(len(ws) - m + 1))
            of.append(np.full(len(at[-1]), item))
            self.words += ws
        at, of, h = np.concatenate(at), np.concatenate(of), hashes.of(self.words)
        a, b = shingle_hashes(h, m)[at], shingle_hashes(mix64(h + np.uint64(1)), m)[at]
        order = np.lexsort((of, b, a))
        a, b, at, of = a[order], b[order], at[order], of[order]
        new = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
        self.hash, self.place = a[new], at[new]
        first = new | np.concatenate([[True], of[1:] != of[:-1]])  # an item counts once
        self.items, self.ends = of[first], np.append(np.cumsum(first)[np.flatnonzero(new)] - 1, first.sum())

    def found(self, words: list[bytes], at: int, h: int) -> int | None:
        """The window whose words stand at ``at``, looked up by hash and held against them."""
        ws = words[at : at + self.m]
        for i in range(*np.searchsorted(self.hash, [h, h + np.uint64(1)])):
            if self.words[(q := self.place[i]) : q + self.m] == ws:
                return i
        return None


class Tests:
    """One piece of the tests, ready to be looked up."""

    def __init__(self, rows: list[tuple[str | None, bytes]], width: int):
        self.names = sorted({i for i, _ in rows if i is not None})
        number, by = {n: i for i, n in enumerate(self.names)}, defaultdict(list)
        seen: dict[bytes, bytes] = {}
        for item, ws in rows:
            ws = [seen.setdefault(w, w) for w in ws.split()]
            by[min(len(ws), width)].append((number.get(item, -1), ws))
        self.hashes = WordHashes()
        self.sets = [_Windows(m, by[m], self.hashes) for m in sorted(by)]

    def scan(self, texts: list[str | None]):
        """Of each text the number of words, the spans of hit words and the names of the items found."""
        held: list[list[bytes]] = []
        for i, t in enumerate(texts):
            held.append(folded(t))
            if i == len(texts) - 1 or sum(map(len, held)) >= AT_ONCE:
                yield from self._scan(held)
                held = []

    def _scan(self, docs: list[list[bytes]]):
        sizes = np.array([len(d) for d in docs])
        words, ends = [w for d in docs for w in d], np.cumsum(sizes)
        doc = np.repeat(np.arange(len(docs)), sizes)
        wh, cover, items = self.hashes.of(words), np.zeros(len(words) + 1, np.int64), defaultdict(set)
        for s in self.sets:
            if len(words) < s.m:
                continue
            h = shingle_hashes(wh, s.m)
            i = np.minimum(np.searchsorted(s.hash, h), len(s.hash) - 1)
            own = np.arange(len(h)) + s.m <= ends[doc[: len(h)]]
            for p in np.flatnonzero((s.hash[i] == h) & own):
                w = s.found(words, p, h[p])
                if w is not None:
                    cover[p] += 1
                    cover[p + s.m] -= 1
                    items[doc[p]].update(s.items[s.ends[w] : s.ends[w + 1]].tolist())
        hit = np.cumsum(cover)[:-1] > 0
        for d, (n, end) in enumerate(zip(sizes, ends, strict=True)):
            edges = np.flatnonzero(np.diff(np.concatenate([[False], hit[end - n : end], [False]])))
            yield int(n), [{"from": int(a), "to": int(b)} for a, b in edges.reshape(-1, 2)], [self.names[i] for i in sorted(items[d]) if i >= 0] if d in items else []


def _scan(shared, width: int, key: str, names: tuple[str, str, str], only_hits: bool):
    def f(batches):
        kept = worker_cache()
        if key not in kept:
            kept.clear()
            kept[key] = Tests(shared(), width)
        for b in batches:
            n, spans, items = zip(*kept[key].scan(b.column("__text").to_pylist()), strict=True) if b.num_rows else ((), (), ())
            b = b.drop_columns(["__text"])
            added = [pa.array(n, pa.int64()), pa.array(spans, _SPANS), pa.array(items, pa.list_(pa.string()))]
            out = pa.RecordBatch.from_arrays(b.columns + added, names=b.schema.names + list(names))
            yield out.filter(pa.array([bool(s) for s in spans], pa.bool_())) if only_hits else out

    return f


def find(docs: DataFrame, benchmark: DataFrame, text: Column, names: tuple[str, str, str], width: int = WINDOW, set_bytes: int = SET_BYTES) -> DataFrame:
    """``docs`` with its number of words, array of hit spans (``from``, ``to`` in words, end exclusive, apart) and sorted item ids added under ``names``."""
    spark = docs.sparkSession
    tests = settle(benchmark.select(F.col("item_id").cast("string").alias("item"), "text").mapInPandas(_segments(width), "item string, words binary"), "tests")
    size = tests.agg(F.sum(F.octet_length("words"))).first()[0] or 0
    pieces = max(1, -(-size // set_bytes))
    row = None
    if pieces > 1:
        docs, row = numbered(docs, "decontaminate-docs")
    added = StructType.fromDDL(f"{names[0]} long, {names[1]} array<struct<from:int,to:int>>, {names[2]} array<string>")

    def hits(p: int, keep: list[str]) -> DataFrame:
        own = tests.filter(F.pmod(F.xxhash64("words", "item"), F.lit(pieces)) == p).collect()  # about set_bytes
        shared = share(spark, [(r["item"], bytes(r["words"])) for r in own])
        kept = docs.select(*keep, text.alias("__text"))
        schema = StructType(kept.schema.fields[:-1] + added.fields)
        return small_batches(kept).mapInArrow(_scan(shared, width, uuid.uuid4().hex, names, bool(p)), schema)

    first = hits(0, docs.columns)
    if pieces == 1:
        return first
    rest = hits(1, [row])
    for p in range(2, pieces):
        rest = rest.unionByName(hits(p, [row]))
    more = fresh(first, "rest")
    rest = rest.groupBy(row).agg(F.struct(F.flatten(F.collect_list(names[1])).alias("spans"), F.flatten(F.collect_list(names[2])).alias("items")).alias(more))
    both, none = first.join(rest, row, "left"), F.array()
    spans = F.array_sort(F.concat(names[1], F.coalesce(F.col(more)["spans"], none.cast("array<struct<from:int,to:int>>"))))
    items = F.array_sort(F.array_distinct(F.concat(names[2], F.coalesce(F.col(more)["items"], none.cast("array<string>")))))
    return both.withColumns({names[1]: apart(spans), names[2]: items}).drop(more, row)


def apart(spans: Column) -> Column:
    """Sorted spans, those that touch or overlap put together."""
    kind = "array<struct<from:int,to:int>>"

    def add(done: Column, s: Column) -> Column:
        last = F.element_at(done, -1)
        grown = F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(last["from"].alias("from"), F.greatest(last["to"], s["to"]).alias("to"))))
        return F.when((F.size(done) > 0) & (s["from"] <= F.try_element_at(done, F.lit(-1))["to"]), grown).otherwise(F.concat(done, F.array(s)))

    return F.aggregate(spans, F.array().cast(kind), lambda done, s: add(done, s).cast(kind))


def scan(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW, set_bytes: int = SET_BYTES) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): n_words, n_hit, n_items, items_sha256, contaminated, and spans.

    A window is ``width`` words of an item of ``benchmark`` (item_id, text), or all words of a shorter item; a document's
    word is hit if it lies in any copy of a window. ``spans`` tells the hit words by their numbers, end exclusive;
    items_sha256 is the digest of the item_ids found, sorted as strings, comma-joined. Null, empty and blank texts have
    no words, and items without words no windows. Rows are scanned each, repeated ones and null ids too; texts of any
    length are scanned whole. Items of equal item_id are one item; an item without an id marks words but isn't told
    among the items. Other columns are ignored. Empty documents give an empty table, an empty benchmark no hits.
    ``set_bytes`` bounds what goes to a task; larger benchmarks take a pass over the documents for each such piece.
    """
    found = find(docs.select("doc_id", "text"), benchmark, F.col("text"), ("n_words", "spans", "items"), width, set_bytes)
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + (s["to"] - s["from"]))
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
        "spans",
    )


def without_spans(text: str, spans: list[dict]) -> str:
    """The text without the hit words, from the first to the last of each span."""
    at = [(m.start(), m.end()) for m in _WORD.finditer(text)]
    out, last = [], 0
    for s in spans:
        out.append(text[last : at[s["from"]][0]])
        last = at[s["to"] - 1][1]
    return "".join(out) + text[last:]


def _cut(spans: str):
    def f(batches):
        for b in batches:
            i = b.schema.get_field_index("text")
            rest = [without_spans(t, s) if s else t for t, s in zip(b.column("text").to_pylist(), b.column(spans).to_pylist(), strict=True)]
            yield b.set_column(i, b.schema.field(i), pa.array(rest, b.schema.field(i).type)).drop_columns([spans])

    return f


def clean(docs: DataFrame, benchmark: DataFrame, remove: str = "spans", width: int = WINDOW, set_bytes: int = SET_BYTES) -> DataFrame:
    """``docs`` (text, ...) without what ``scan`` hits, all columns as they were.

    ``remove='documents'`` leaves out rows with any hit; ``'spans'`` keeps all rows and cuts each span out of the text,
    from its first to its last word (signs and space around stay; a text all of which is hit keeps its signs).
    """
    if remove not in ("spans", "documents"):
        raise ValueError("remove spans or documents")
    names = tuple(fresh(docs, n) for n in ("n", "spans", "items"))
    found = find(docs, benchmark, F.col("text"), names, width, set_bytes)
    if remove == "documents":
        return found.filter(F.size(names[1]) == 0).select(docs.columns)
    kept = found.select(*docs.columns, names[1])
    return small_batches(kept).mapInArrow(_cut(names[1]), docs.schema)
