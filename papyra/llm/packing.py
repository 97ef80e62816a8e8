"""Packing: sum-of-squares online packing of tokenised documents into fixed windows.

Each input partition is a shard that packs its own documents in order, so
nothing is shuffled and a lost task repeats alone. A document is cut into whole
windows and a rest; the rest goes to the fill level that makes the sum of
squares of the counts of partly filled windows smallest. At the shard's end the
windows still open are poured together; what is left is cut into lengths that
are powers of two, which need no padding.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papyra.llm._util import small_batches, worker_cache

#: Words whose ids a Python worker keeps; when there are more, those longer than so many bytes, which are seldom seen again, go.
CACHE_WORDS, KEPT_LETTERS = 900_000, 10

#: ASCII signs, none of them a letter or digit.
SIGNS = b"!\"#$%&'()*+,-./:;=?@[\\]^_`{}~|<>"

#: A dot above makes of "I" one letter whose small form isn't that of "i" and the dot, so such texts keep their case.
DOT = "\u0307".encode()

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class Levels:
    """How many open windows have each fill level, and which."""

    def __init__(self, window: int):
        self.window = window
        self.count = np.zeros(window + 1, np.int64)
        self.open: dict[int, list[list]] = {}
        self._all = np.arange(window)

    def place(self, size: int) -> list:
        """The pieces of the window that an item of ``size`` joins; the caller appends to them, then calls ``filled``."""
        room = self.window - size
        n, to = self.count[: room + 1], self.count[size : self.window + 1]
        change = 2 * to + 1 - (2 * n - 1)  # N(h) falls by one, N(h + size) rises by one
        change[room] -= 2 * to[room] + 1  # a full window counts no more
        change[0] += 2 * n[0] - 1  # a new window leaves no level
        change[1:][n[1:] == 0] = np.iinfo(np.int64).max
        h = int(len(change) - 1 - np.argmin(change[::-1]))  # of equals the fullest
        if h == 0:
            return [0, []]
        self.count[h] -= 1
        return self.open[h].pop()

    def filled(self, box: list) -> bool:
        """Whether the window is full; if not it is open at its level."""
        if box[0] == self.window:
            return True
        self.count[box[0]] += 1
        self.open.setdefault(box[0], []).append(box)
        return False


def pack_documents(docs: Iterator[tuple[object, bytes]], window: int, first: int) -> Iterator[tuple]:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset) of all pieces; ``docs`` are ids and their tokens as 32-bit words."""
    levels, seq = Levels(window), first

    def out(pieces: list[tuple]) -> Iterator[tuple]:
        nonlocal seq
        offset = 0
        for doc, start, raw, total in pieces:
            yield doc, start, len(raw) // 4, zlib.crc32(raw), total, seq, offset
            offset += len(raw) // 4
        seq += 1

    for doc, raw in docs:
        total = len(raw) // 4
        whole = total // window * window
        for at in range(0, whole, window):
            yield from out([(doc, at, raw[4 * at : 4 * (at + window)], total)])
        if whole < total:
            box = levels.place(total - whole)
            box[0] += total - whole
            box[1].append((doc, whole, raw[4 * whole :], total))
            if levels.filled(box):
                yield from out(box[1])
    rest = [p for h in sorted(levels.open, reverse=True) for box in levels.open[h] for p in box[1]]
    left = sum(len(p[2]) // 4 for p in rest)
    pieces, need = [], min(window, 1 << max(left.bit_length() - 1, 0)) if left else 0
    for doc, start, raw, total in rest:
        while raw:
            take = raw[: 4 * need]
            pieces.append((doc, start, take, total))
            raw, start, need = raw[len(take) :], start + len(take) // 4, need - len(take) // 4
            left -= len(take) // 4
            if not need:
                yield from out(pieces)
                pieces, need = [], min(window, 1 << max(left.bit_length() - 1, 0)) if left else 0


#: Pairs that must have equal ids for a vocabulary to be read word by word: case ignored, white space dropped, letters parted from signs.
BY_WORDS = (("Ab cD", "ab cd"), ("ab  cd\n", "ab cd"), ("ab cd", ("ab", "cd")), ("ab.!", ("ab", ".!")), ("ab\t.!", ("ab", ".!")))


class WordIds(dict):
    """Token ids of words, as little-endian 32-bit words, for a vocabulary whose tokens never cross white space.

    Where the vocabulary ignores the case of letters and splits at white space and between letters and signs (it is
    tried at load), texts come in lower-cased A-Z unless they hold one of its special strings, and "word.!" is encoded
    as "word" and ".!"; each last letter beyond a-z is tried once before, as some are taken apart by the vocabulary's
    normaliser. Any other vocabulary encodes whole texts.
    """

    def __init__(self, path: str):
        super().__init__()
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.ends = np.zeros(self.model.get_vocab_size(), bool)
        for token, i in self.model.get_vocab().items():
            self.ends[i] = token.endswith("</w>")
        self.parted: dict[str, bool] = {}
        self.by_words = all(self._ids(a) == (self._ids(b) if isinstance(b, str) else self._ids(b[0]) + self._ids(b[1])) for a, b in BY_WORDS)

    def _ids(self, text: str) -> list[int]:
        return self.model.encode(text, add_special_tokens=False).ids

    def _parts(self, letter: str) -> bool:
        """Whether no token holds the end of this letter and a sign after it."""
        if letter not in self.parted:
            self.parted[letter] = letter.isalpha() and self._ids(letter + "!") == self._ids(letter) + self._ids("!")
        return self.parted[letter]

    def _encode(self, ws: list[bytes]) -> None:
        """Words of letters alone are one piece before merging, so each ends with the one token that ends a word: they are encoded many at once. Others one by one."""
        plain = [w for w in ws if w.decode().isalpha()]
        own = list(set(ws).difference(plain)) if len(plain) < len(ws) else []
        for i in range(0, len(plain), 2_000):
            part = plain[i : i + 2_000]
            e = self.model.encode_batch_fast([b" ".join(part).decode()], add_special_tokens=False)[0]
            ids = np.array(e.ids, "<u4")
            ends = np.flatnonzero(self.ends[ids]) + 1
            if len(ends) != len(part):
                own += part
                continue
            raw, ends = ids.tobytes(), (4 * ends).tolist()
            self.update(zip(part, map(raw.__getitem__, map(slice, [0, *ends], ends)), strict=True))
        for w, e in zip(own, self.model.encode_batch_fast([w.decode() for w in own], add_special_tokens=False), strict=True):
            self[w] = np.array(e.ids, "<u4").tobytes()

    def learn(self, ws: set[bytes]) -> None:
        whole, stems, tails = [], [], []  # plain lists: pairs would keep the garbage collector busy
        for w in ws:
            stem = w.rstrip(SIGNS)
            if stem and len(stem) < len(w) and (97 <= stem[-1] <= 122 or self._parts(stem.decode()[-1])) and b"<|" not in w:
                whole.append(w)
                stems.append(stem)
                tails.append(w[len(stem) :])
        need = ws.difference(whole)
        need.update(stems, tails)
        self._encode([w for w in need if w not in self])
        self.update(zip(whole, map(bytes.__add__, map(self.__getitem__, stems), map(self.__getitem__, tails)), strict=True))

    def of(self, texts: list[bytes | None]) -> Iterator[bytes]:
        if not self.by_words:
            for e in self.model.encode_batch_fast([(raw or b"").decode() for raw in texts], add_special_tokens=False):
                yield np.array(e.ids, "<u4").tobytes()
            return
        split = []
        for raw in texts:
            raw = raw or b""
            split.append((raw if b"<|" in raw or DOT in raw else raw.lower()).split())
        if len(self) > CACHE_WORDS:
            if sum(len(w) <= KEPT_LETTERS for w in self) > CACHE_WORDS // 2:
                self.clear()
            for w in [w for w in self if len(w) > KEPT_LETTERS]:
                del self[w]
        found = [list(map(self.get, ws)) for ws in split]
        open_ = [[i for i, x in enumerate(got) if x is None] if None in got else [] for got in found]
        self.learn({ws[i] for ws, at in zip(split, open_, strict=True) for i in at})
        for ws, got, at in zip(split, found, open_, strict=True):
            for i in at:
                got[i] = self[ws[i]]
            yield b"".join(got)


def _run(tokenizer: str, end_id: int, window: int):
    def f(batches):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from pyspark import TaskContext

        kept, end = worker_cache(), end_id.to_bytes(4, "little")
        ids = kept[tokenizer] = kept.get(tokenizer) or WordIds(tokenizer)

        def docs():
            for big in batches:
                for at in range(0, len(big), 1000):
                    b = big.iloc[at : at + 1000]
                    for d, raw in zip(b["doc_id"], ids.of(list(b["text"])), strict=True):
                        yield (None if pd.isna(d) else int(d)), raw + end

        held = []
        for r in pack_documents(docs(), window, TaskContext.get().partitionId() << 33):
            held.append(r)
            if len(held) == 10_000:
                yield _frame(held)
                held = []
        yield _frame(held)

    return f


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=[c.split()[0] for c in SCHEMA.split(", ")]).astype({"doc_id": "Int64"})


def pack(docs: DataFrame, tokenizer: str, end_id: int = 1, window: int = 2048) -> DataFrame:
    """Pack ``docs`` (doc_id, text) into windows of ``window`` tokens (a power of two); one row per piece of a document.

    ``tokenizer`` is a vocabulary file of the library tokenizers. A document is its ids and then
    ``end_id``; each id lies in exactly one piece. Null and empty texts are ``end_id`` alone. Rows are packed each,
    repeated ones and those with a null or repeated doc_id too. Sequence ids are unique and the offsets in a sequence
    have no gaps; they follow the input's partitions. A document of any length is cut into whole windows and a rest.
    An empty table gives an empty table; other columns are ignored.
    """
    if window & (window - 1):
        raise ValueError("the window must be a power of two")
    return small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInPandas(_run(tokenizer, end_id, window), SCHEMA)
