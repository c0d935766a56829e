"""64-bit hashes of words and word shingles of many texts at once, in numpy."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

U = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_random = np.random.default_rng(20240229)
_CODE = _random.integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
_CODE[_SPACE] = 0
_PLACE = np.multiply.accumulate(np.full(4096, 0x9E3779B97F4A7C15, np.uint64))
_WORD = _random.integers(1, 2**63, 16, dtype=np.uint64) * U(2) + U(1)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that scatters them (the finalizer of splitmix64)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all words, A to Z lower-cased, one text after another; and where each text's words begin (one more at the end)."""
    parts = [(t or "").encode("utf-8", "surrogatepass").lower() for t in texts]  # bytes.lower() changes A to Z only
    buf = np.frombuffer(b" ".join(parts) + b" ", np.uint8)
    starts = np.cumsum([0] + [len(p) + 1 for p in parts])
    space = _SPACE[buf]
    first = np.flatnonzero(~space & np.concatenate(([True], space[:-1])))
    begins = np.searchsorted(first, starts)
    if not len(first):
        return np.empty(0, np.uint64), begins
    place = np.arange(len(buf)) - np.repeat(first, np.diff(np.append(first, len(buf)))) if first[0] == 0 else np.concatenate((np.zeros(first[0], np.int64), np.arange(first[0], len(buf)) - np.repeat(first, np.diff(np.append(first, len(buf))))))
    powers = _PLACE
    if (longest := int(place.max())) >= len(powers):  # white space counts as well, but has code 0
        powers = np.multiply.accumulate(np.full(longest + 1, _PLACE[0], np.uint64))
    return mixed(np.add.reduceat(_CODE[buf] * powers[place], first)), begins


def ranges(sizes: Iterable[int], most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about this size together, one row at least."""
    at = end = total = 0
    for size in sizes:
        end += 1
        total += size
        if total >= most:
            yield at, end
            at, total = end, 0
    if at < end:
        yield at, end


def in_parts(texts: list[str | None], most: int = 1_000_000) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about so many characters together, one text at least."""
    return ranges((len(t or "") for t in texts), most)


def shingle_sets(texts: list[str | None], words: int = 5) -> Iterator[np.ndarray]:
    """For every text the sorted hashes of its distinct shingles; a text of fewer words is one shingle, one without words none."""
    for a, b in in_parts(texts):
        hashes, begins = word_hashes(texts[a:b])
        n = len(hashes)
        whole = np.zeros(max(n - words + 1, 0), np.uint64)
        for k in range(words):
            whole += hashes[k : n - words + 1 + k] * _WORD[k] if n >= words else U(0)
        whole = mixed(whole)
        for s, e in zip(begins[:-1], begins[1:]):
            if e - s >= words:
                yield np.unique(whole[s : e - words + 1])
            elif e > s:
                yield mixed((hashes[s:e] * _WORD[8 : 8 + e - s]).sum(dtype=np.uint64, keepdims=True) + U(e - s))
            else:
                yield np.empty(0, np.uint64)
