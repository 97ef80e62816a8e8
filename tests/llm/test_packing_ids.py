"""Ids of words put together are the ids of the text."""

import random
import sys

import numpy as np
import pytest

from papyra.llm import packing

public = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def ids():
    return packing.WordIds(str(public.path("word_bpe_49k.json")))


def differing(ids, texts):
    got = ids.of([t.encode() for t in texts])
    return [t for t, raw in zip(texts, got, strict=True) if np.frombuffer(raw, "<u4").tolist() != ids.model.encode(t, add_special_tokens=False).ids]


def test_every_letter_before_and_after_a_sign(ids):
    letters = [c for c in map(chr, range(128, sys.maxunicode + 1)) if c.isalpha()]
    assert ids.by_words and len(letters) > 100_000
    assert differing(ids, [f"a{c}! .{c} x{c}'s {c}-" for c in letters]) == []


def test_random_strings(ids):
    rng = random.Random(7)
    alphabet = list("abAZ09 .,!'\"-<|>\n\t") + list("\u0130\u095c\u03a3\u03c2\u00df\u01c5\u0301\u0307\u09bc\u1100\u1161\u11a8\u3000\u00a0\ud55c\u77e5\U0001f642\u2126\ufb01\u0344\u200d") + ["<|endoftext|>", "'s", "aI\u0307"]
    assert differing(ids, ["".join(rng.choices(alphabet, k=rng.randint(1, 9))) for _ in range(60_000)]) == []


def test_other_vocabularies_encode_whole_texts():
    other = packing.WordIds(str(public.path("byte_bpe_50k.json")))
    assert not other.by_words
    assert differing(other, ["Ab  cd.!\n", "", "\u0130! x"]) == []
