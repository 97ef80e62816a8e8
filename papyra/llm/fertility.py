"""Quality rules by tokeniser fertility.

A public vocabulary says how strange a text is: characters per token, the share
of tokens that are byte fallbacks, and the entropy of the tokens. A text is kept
if all three lie in the band of its language (or, without one, its script) and
length class, as short texts scatter more and have less entropy. Bands are learned
from all documents: the median of those that pass the base rules, texts of equal
measures counted once, and a multiple of the distance to the quartiles on either
side. A length class with few texts takes a wide band of the whole language.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papyra.llm._util import WordHashes, settle, shingle_hashes, small_batches

SPACE, SYMBOLS = " \t\n\x0b\x0c\r", "#*$%&|<>"
MIN_WORDS, REPEAT_PERCENT, REPEAT_WIDTH = 20, 30, 8
#: Half a band is this many quartile distances, and at least this much (of the median, for the share as it is).
WIDE = 5.0
LEAST = {"chars_per_token": 0.03, "byte_share": 0.05, "entropy": 0.03}
#: The same above the median of entropy, where texts of a rich vocabulary are and junk isn't.
LEAST_RICH = 0.1
#: Texts from which a length class (a power of two of tokens) has a band of its own, and the same two for the band of all lengths.
CLASS_TEXTS = 20
ALL_WIDE = 8.0
ALL_LEAST = {"chars_per_token": 0.25, "byte_share": 0.05, "entropy": 0.35}
CACHE_WORDS = 250_000
#: Languages up to which the bands are sent to every task (100 bytes each).
BROADCAST_BANDS = 10_000

#: First code points of scripts, by block; what stands between two begins belongs to the earlier.
_SCRIPTS = [(0x41, "latin"), (0x370, "greek"), (0x400, "cyrillic"), (0x530, "other"), (0x590, "hebrew"), (0x600, "arabic"), (0x780, "other"), (0x900, "indic"), (0xE00, "thai"), (0xE80, "other"), (0x3040, "kana"), (0x3100, "other"), (0x3400, "han"), (0xA000, "other"), (0xAC00, "hangul"), (0xD7B0, "other")]


def script_of(text: str) -> str:
    """The script of most letters."""
    points = np.frombuffer("".join(filter(str.isalpha, text)).encode("utf-32-le", "surrogatepass"), np.uint32)
    if not len(points):
        return "none"
    at = np.searchsorted([p for p, _ in _SCRIPTS], points, side="right") - 1
    return _SCRIPTS[max(int(np.bincount(np.maximum(at, 0)).argmax()), 0)][1]


def repeat_words(h: np.ndarray, width: int = REPEAT_WIDTH) -> int:
    """Words that lie in a run of ``width`` words found twice or more."""
    if len(h) <= width:
        return 0
    s = shingle_hashes(h, width)
    o = np.sort(s)
    twice = o[1:][o[1:] == o[:-1]]
    if not len(twice):
        return 0
    marks = np.zeros(len(h) + 1, np.int64)
    at = np.flatnonzero(np.isin(s, twice))
    np.add.at(marks, at, 1)
    np.add.at(marks, at + width, -1)
    return int((np.cumsum(marks[:-1]) > 0).sum())


def base_counts(text: str | None, hashes: WordHashes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    if not text:
        return 0, 0, 0, 0, 0
    ws = text.encode("utf-8", "surrogatepass").split()
    lines = [x for x in text.split("\n") if x.strip(SPACE)]
    return (
        len(ws),
        len(text) - sum(map(text.count, SPACE)),
        sum(map(text.count, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeat_words(hashes.of(ws)),
    )


class Pieces(dict):
    """Token ids of a word, as 32-bit words, by a vocabulary whose tokens don't cross white space."""

    def __init__(self, path: str):
        super().__init__()
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.fallback = np.array([self.model.is_byte(i) for i in range(self.model.vocab_size())])

    def of(self, texts: list[list[bytes]]) -> list[np.ndarray]:
        new = list({w for ws in texts for w in ws if w not in self})
        if len(self) + len(new) > CACHE_WORDS:
            self.clear()
            new = list({w for ws in texts for w in ws})
        for i in range(0, len(new), 20_000):
            part = new[i : i + 20_000]
            for w, ids in zip(part, self.model.encode([w.decode("utf-8", "replace") for w in part], num_threads=1), strict=True):
                self[w] = np.array(ids, np.int32).tobytes()
        return [np.frombuffer(b"".join(map(self.__getitem__, ws)), np.int32) for ws in texts]


def entropy(ids: np.ndarray) -> float:
    """Bits per token of a text's own token frequencies."""
    n = np.diff(np.flatnonzero(np.concatenate([[True], np.diff(np.sort(ids)) != 0, [True]])))
    return float(np.log2(len(ids)) - (n * np.log2(n)).sum() / len(ids)) if len(ids) else 0.0


_MEASURED = "doc_id long, lang string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_tokens long, chars_per_token double, byte_share double, entropy double"


def _measure(vocabulary: str):
    def f(batches):
        hashes, pieces = WordHashes(), Pieces(vocabulary)
        for big in batches:
            for at in range(0, len(big), 500):
                b = big.iloc[at : at + 500]
                rows = []
                ids = pieces.of([t.encode("utf-8", "surrogatepass").split() if t else [] for t in b["text"]])
                for d, t, lang, i in zip(b["doc_id"], b["text"], b["lang"], ids, strict=True):
                    base = base_counts(t, hashes)
                    n = len(i)
                    rows.append((d, lang if lang is not None else "script:" + script_of(t or ""), *base, n, base[1] / n if n else 0.0, float(pieces.fallback[i].mean()) if n else 0.0, entropy(i)))
                yield pd.DataFrame(rows, columns=[c.split()[0] for c in _MEASURED.split(", ")]).astype({"doc_id": "Int64"})

    return f


def rate(docs: DataFrame, vocabulary: str, wide: float = WIDE) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text, lang): the base counts, base_failed, the three measures and kept.

    ``vocabulary`` is a sentencepiece file. A word's tokens are those of the word alone. Null, empty and blank texts have no
    words and fail. ``wide`` is the width of the bands of length classes; a class with under CLASS_TEXTS texts takes the
    language's band of all lengths. A null lang is replaced by the script of most letters ('script:latin', ...); a language none of
    whose documents passes the base rules has no band, and nothing to reject by. Rows are rated each. Columns
    other than these three are ignored. An empty table gives an empty table.
    """
    own = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    m = settle(own.mapInPandas(_measure(vocabulary), _MEASURED), "fertility")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    m = m.withColumn("base_failed", failed)
    q = lambda c: F.percentile_approx(c, [0.25, 0.5, 0.75], 10_000).alias(c)
    m = m.withColumn("length", F.floor(F.log2(F.col("n_tokens"))))
    passed = m.filter("not base_failed").select("lang", "length", "n_tokens", *LEAST).distinct()
    bands = passed.rollup("lang", "length").agg(F.count("*").alias("texts"), *(q(c) for c in LEAST)).filter("lang is not null")
    ends, fine, out = [], F.lit(True), []
    for c in LEAST:
        x, one = F.col(c), F.col("length").isNotNull()
        least, width = F.when(one, LEAST[c]).otherwise(ALL_LEAST[c]), F.when(one, wide).otherwise(ALL_WIDE)
        floor = least if c == "byte_share" else x[1] * least
        top = x[1] * F.greatest(least, F.lit(LEAST_RICH)) if c == "entropy" else floor
        ends += [(x[1] - F.greatest(width * (x[1] - x[0]), floor)).alias(f"{c}_low"), (x[1] + F.greatest(width * (x[2] - x[1]), top)).alias(f"{c}_high")]
        low, high = (F.coalesce(F.col(f"b.{c}_{end}"), F.col(f"a.{c}_{end}")) for end in ("low", "high"))
        out += [low.alias(f"{c}_low"), high.alias(f"{c}_high")]
        fine &= F.coalesce(F.col(f"m.{c}").between(low, high), F.lit(True))
    bands = settle(bands.filter((F.col("texts") >= CLASS_TEXTS) | F.col("length").isNull()).select("lang", "length", *ends), "bands")
    every, own_band = bands.filter("length is null"), bands.filter("length is not null")
    if bands.count() <= BROADCAST_BANDS:
        every, own_band = F.broadcast(every), F.broadcast(own_band)
    found = m.alias("m").join(own_band.alias("b"), (F.col("m.lang") == F.col("b.lang")) & (F.col("m.length") == F.col("b.length")), "left")
    return found.join(every.alias("a"), F.col("m.lang") == F.col("a.lang"), "left").select(
        *(F.col(f"m.{c}") for c in ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")),
        (~F.col("m.base_failed") & fine).alias("kept"),
        F.col("m.lang").alias("band"),
        *(F.col(f"m.{c}") for c in ("n_tokens", *LEAST)),
        *out,
    )
