"""Hashed word and character n-grams of whole texts, in numpy."""

from __future__ import annotations

import numpy as np

from lodestar.llm.common import BLANK, mix, span_hashes, word_spans

_rng = np.random.default_rng(7_177)
#: A random 64-bit value for each byte at each place of a character n-gram.
_PLACE = [_rng.integers(1, 1 << 63, 256, dtype=np.uint64) for _ in range(3)]
_FIRST, _SECOND = (np.uint64(x) for x in _rng.integers(1, 1 << 63, 2) | 1)
_TWICE = _rng.integers(1, 1 << 63, 6, dtype=np.uint64) * _FIRST


def buckets(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, bits: int) -> np.ndarray:
    """Bucket of every word, word pair and run of 3 bytes of a text; repeats included.

    All pairs of a word with itself share one bucket, and so do n-grams of one word 3, 5, 9, 17
    and 33 times.
    """
    shift = np.uint64(64 - bits)
    found = []
    if len(starts):
        words = span_hashes(data, starts, ends)
        pairs = mix(words[:-1] * _FIRST + words[1:] * _SECOND)
        same = words[:-1] == words[1:]
        pairs[same] = _TWICE[0]
        found += [words, pairs]
        for longer, bucket in enumerate(_TWICE[1:]):
            step = 1 << longer
            same = same[:-step] & same[step:]
            if not same.any():
                break
            found.append(np.full(int(same.sum()), bucket))
    if len(data) >= 3:
        found.append((_PLACE[0][data[:-2]] + _PLACE[1][data[1:-1]] + _PLACE[2][data[2:]]) * _FIRST)
    if not found:
        return np.empty(0, dtype=np.int64)
    return (np.concatenate(found) >> shift).astype(np.int64)


def text_buckets(text: str, bits: int) -> np.ndarray:
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)
    return buckets(data, *word_spans(data, BLANK), bits)


def distinct(found: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """The distinct buckets, ascending. ``seen``: a false flag for each bucket, false again after."""
    seen[found] = True
    out = np.flatnonzero(seen)
    seen[out] = False
    return out
