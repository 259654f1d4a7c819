"""Words of a text, as every operator here counts them, and hashes of word sequences."""

from __future__ import annotations

import re
import unicodedata

import numpy as np
import xxhash

INVISIBLE = re.compile("[­͏؜ᅟᅠ឴឵᠋-᠎​-‏‪-‮⁠-⁯︀-️﻿]")
_WORD = re.compile(r"[^\W_]+")
_PLAIN = re.compile(r"[\x00-\x7f]*\Z")


def words(text: str) -> list[str]:
    """Maximal runs of letters and digits, lower-cased; invisible characters are dropped, compatibility forms resolved."""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", INVISIBLE.sub("", text))
    return _WORD.findall(text.lower())


class WordIds:
    """64-bit ids of words; a bounded memory of the words seen spares hashing them again."""

    def __init__(self, most: int = 1_000_000):
        self.known: dict[str, int] = {}
        self.most = most

    def of(self, tokens: list[str]) -> np.ndarray:
        known = self.known
        if len(known) > self.most:
            known.clear()
        new = set(tokens).difference(known)
        for t in new:
            known[t] = xxhash.xxh3_64_intdigest(t)
        return np.fromiter(map(known.__getitem__, tokens), np.uint64, len(tokens))


_MIX = np.uint64(0x9E3779B97F4A7C15)


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread 64-bit values so that every bit depends on every other (finaliser of splitmix64)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def rolling(ids: np.ndarray, n: int) -> np.ndarray:
    """Hash of every n consecutive ids; entry i stands for ids[i : i + n]."""
    m = len(ids) - n + 1
    if m <= 0:
        return np.empty(0, np.uint64)
    h = np.zeros(m, np.uint64)
    for k in range(n):
        h = h * _MIX + ids[k : k + m]
    return mixed(h)
