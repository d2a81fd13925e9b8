"""Operator 5 hashes a text's grams once a pass and refines by one-key sorts."""

import random
from collections import Counter

import numpy as np
import pytest

from talweg.llm import suffixdup


def test_grams_are_hashed_once(monkeypatch):
    calls, real = [], suffixdup.gram_hashes
    monkeypatch.setattr(suffixdup, "gram_hashes", lambda data, k: calls.append(k) or real(data, k))
    text = bytes(random.Random(2).choices(b"abcd", k=3000))
    (found,) = suffixdup.runs(text, 200, 64)
    assert calls == [64]
    assert found[3].tolist() == [int(real(np.frombuffer(text[a : a + 64], np.uint8), 64)[0]) for a in found[2].tolist()]


@pytest.mark.parametrize("signs", [b"ab", b"\0a", b"\0\xff"])
def test_windows_that_repeat(monkeypatch, signs):
    if 0 not in signs:  # a short suffix can't be taken for one that goes on with zero bytes
        monkeypatch.setattr(suffixdup.np, "lexsort", lambda *_: pytest.fail("a sort of two keys"))
    rnd = random.Random(7)
    for _ in range(30):
        strings = [bytes(rnd.choices(signs, k=rnd.randint(1, 60))) for _ in range(6)]
        seen = Counter(s[i : i + 10] for s in strings for i in range(len(s) - 9))
        found = suffixdup.repeated_windows(strings, np.ones(6, int), 10)
        assert [f.tolist() for f in found] == [[seen[s[i : i + 10]] > 1 for i in range(len(s) - 9)] for s in strings]
