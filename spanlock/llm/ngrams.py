"""Hashed character n-grams of text batches, in numpy."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np

SPACE, END = 32, 10
#: Characters that end a sentence.
ENDS = "\n.!?"

#: Characters worked on at a time; longer texts are cut at white space into pieces.
BLOCK = 1 << 20


@lru_cache(maxsize=1)
def folded() -> np.ndarray:
    """Code point to code point: letters in lower case, sentence ends to END, anything else to SPACE."""
    out = np.full(1 << 16, SPACE, dtype=np.uint32)
    for c in range(1 << 16):
        ch = chr(c)
        if ch.isalpha():
            low = ch.lower()
            out[c] = ord(low) if len(low) == 1 else c
        elif ch in ENDS:
            out[c] = END
    return out


def codes_of(text: str) -> np.ndarray:
    """Folded code points, one for each of the text."""
    raw = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    low = folded()[np.minimum(raw, 0xFFFF)]
    beyond = raw > 0xFFFF
    if beyond.any():
        values, at = np.unique(raw[beyond], return_inverse=True)
        low[beyond] = np.array([ord(chr(c).lower()) if chr(c).isalpha() else SPACE for c in values.tolist()], dtype=np.uint32)[at]
    return low


def blocks(texts: list[str], limit: int = BLOCK) -> Iterator[tuple[list[int], list[int], np.ndarray]]:
    """(documents, lengths, codes): pieces of about ``limit`` characters together, each of one document."""
    docs: list[int] = []
    parts: list[str] = []
    held = 0
    for i, text in enumerate(texts):
        at = 0
        while True:
            stop = len(text)
            if stop - at > limit:
                stop = max(text.rfind(c, at, at + limit) for c in " \n") + 1
                stop = stop if stop > at else at + limit
            docs.append(i)
            parts.append(text[at:stop])
            held += stop - at
            if held >= limit:
                yield docs, [len(p) for p in parts], codes_of("".join(parts))
                docs, parts, held = [], [], 0
            at = stop
            if at >= len(text):
                break
    if docs:
        yield docs, [len(p) for p in parts], codes_of("".join(parts))


def hashed(codes: np.ndarray, n: int, bits: int) -> np.ndarray:
    """The bucket of the n-gram that begins at each position (positions too near the end wrap; mask them)."""
    h = np.full(len(codes), n * 0x9E3779B1 & 0xFFFFFFFF, dtype=np.uint32)
    for k in range(n):
        h = (h ^ np.roll(codes, -k).astype(np.uint32)) * np.uint32(0x85EBCA6B)
        h ^= h >> np.uint32(15)
    return (h >> np.uint32(32 - bits)).astype(np.int32)
