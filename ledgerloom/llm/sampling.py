"""Word shingles with weights, and consistent weighted samples of them.

A text's shingles are runs of five words (all its words, if fewer), lower case, split at white space.  A
shingle weighs ``(1 + ln tf) * idf``.  The idf runs from 1 for a shingle in every document to ``TOP`` for one
in at most ``COMMON`` of them, so the table of shingles that weigh less has at most (mean shingles of a
document) / ``COMMON`` entries however many documents there are.
"""

from __future__ import annotations

import functools
import math
import re
from collections.abc import Iterator

import numpy as np
import xxhash

SIZE = 5
COMMON = 0.01
TOP = 1.5
SAMPLES = 64
DRAW_BITS = 18
_M = [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD]


#: Bytes of text that are hashed at once; longer words are hashed by themselves.
CHUNK = 1 << 17
#: White space, as text methods split at it; what is not ASCII becomes a space first.
_WIDE = re.compile("[\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_BLANK = re.compile(rb"[\t-\r\x1c- ]")
_IS_BLANK = np.zeros(256, bool)
_IS_BLANK[[*range(9, 14), *range(28, 33)]] = True
_BASE = 0x9E3779B97F4A7C15


@functools.cache
def _powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse, modulo 2 ** 64."""
    out = []
    for base in (_BASE, pow(_BASE, -1, 1 << 64)):
        powers = np.full(2 * CHUNK + 2, base, np.uint64)
        powers[0] = 1
        out.append(np.cumprod(powers))
    return out[0], out[1]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ h >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ h >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ h >> np.uint64(32)


def _folded(text: str) -> bytes:
    text = text.lower()
    return (text if text.isascii() else _WIDE.sub(" ", text)).encode("utf-8", "surrogatepass")


def _chunks(data: bytes) -> Iterator[tuple[bytes, bool]]:
    """Parts of a long text cut at white space, and whether one is a single word of more than ``CHUNK`` bytes."""
    begin = 0
    while begin < len(data):
        end = begin + CHUNK
        if end < len(data):
            blank = _BLANK.search(data, end)
            end = blank.start() if blank else len(data)
            word = next((k + 1 for k in range(begin + CHUNK - 1, begin - 1, -1) if _IS_BLANK[data[k]]), begin)
            if end - word > CHUNK:
                yield data[begin:word], False
                yield data[word:end], True
                begin = end
                continue
        yield data[begin:end], False
        begin = end


def _hashed(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of some bytes, and where they begin; a word is a polynomial of its bytes."""
    code = np.frombuffer(data, np.uint8)
    blank = np.concatenate([[True], _IS_BLANK[code], [True]])
    edge = np.flatnonzero(blank[1:] != blank[:-1])
    begin, end = edge[::2], edge[1::2]
    up, down = _powers()
    sums = np.zeros(len(code) + 1, np.uint64)
    np.cumsum((code.astype(np.uint64) + np.uint64(1)) * up[: len(code)], out=sums[1:])
    return _mixed((sums[end] - sums[begin]) * down[begin] + (end - begin).astype(np.uint64)), begin


def word_lists(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of texts, one after the other, and how many each text has.

    Words are lower case, split at white space; short texts are hashed together.
    """
    found, counts = [], np.zeros(len(texts), np.int64)
    held: list[bytes] = []
    first = size = 0

    def settle(stop: int) -> None:
        h, begin = _hashed(b" ".join(held))
        found.append(h)
        starts = np.cumsum([0, *(len(x) + 1 for x in held)])
        counts[first:stop] = np.diff(np.searchsorted(begin, starts))

    for k, text in enumerate(texts):
        data = _folded(text) if text else b""
        if held and size + len(data) + 1 > CHUNK:
            settle(k)
            held, first, size = [], k, 0
        if len(data) > CHUNK:
            for part, alone in _chunks(data):
                h = np.array([xxhash.xxh64_intdigest(part)], np.uint64) if alone else _hashed(part)[0]
                found.append(h)
                counts[k] += len(h)
            first = k + 1
            continue
        held.append(data)
        size += len(data) + 1
    if held:
        settle(len(texts))
    return np.concatenate(found) if found else np.zeros(0, np.uint64), counts


def word_hashes(text: str | None) -> np.ndarray:
    """Hashes of the words of a text, in order."""
    return word_lists([text])[0]


def _runs(h: np.ndarray, size: int) -> np.ndarray:
    """A hash for each run of ``size`` words."""
    total = np.full(len(h) - size + 1, size, np.uint64)
    for k in range(size):
        total += _mixed(h[k : len(h) - size + 1 + k] * np.uint64(_M[k]))
    return _mixed(total)


def shingles_of(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of the words with these hashes, ascending, and how often each occurs."""
    if not len(h):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.unique(_runs(h, min(SIZE, len(h))), return_counts=True)


def shingle_lists(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each text its distinct shingles as ascending 64-bit hashes, and how often each occurs."""
    h, counts = word_lists(texts)
    runs = _runs(h, SIZE) if len(h) >= SIZE else None
    end = 0
    for n in counts.tolist():
        begin, end = end, end + n
        if n < SIZE:
            yield shingles_of(h[begin:end])
            continue
        own = np.sort(runs[begin : end - SIZE + 1])
        new = np.concatenate([[True], own[1:] != own[:-1]])
        at = np.flatnonzero(new)
        yield own[at], np.diff(np.append(at, len(own)))


def shingles(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """The same of one text."""
    return shingles_of(word_hashes(text))


class Weights:
    """Weights of shingles by how many of ``documents`` documents hold the common ones."""

    def __init__(self, documents: int, common: np.ndarray, held_by: np.ndarray):
        self.documents = documents
        order = np.argsort(common)
        self.common = np.asarray(common, np.uint64)[order]
        share = np.asarray(held_by, np.float64)[order] / max(1, documents)
        self.idf = 1 + (TOP - 1) * np.minimum(1, np.log(1 / np.maximum(share, 1e-300)) / math.log(1 / COMMON))

    def __call__(self, hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
        idf = np.full(len(hashes), TOP)
        if len(self.common) and len(hashes):
            at = np.minimum(np.searchsorted(self.common, hashes), len(self.common) - 1)
            idf = np.where(self.common[at] == hashes, self.idf[at], TOP)
        return (1 + np.log(counts)) * idf


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two (ascending hashes, weights); 1 for two empty ones."""
    if not len(a[0]) and not len(b[0]):
        return 1.0
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = float(np.minimum(a[1][i], b[1][j]).sum())
    return both / (float(a[1].sum()) + float(b[1].sum()) - both)


class Sampler:
    """Improved consistent weighted sampling (Ioffe 2010) with draws from a table.

    A sample of a weighted set is an element and a step; two sets give the same sample with the probability
    of their weighted Jaccard similarity.  An element's draws (r, beta and ln c together) are a table entry chosen by
    its hash, so that an element of the usual weight, ``TOP``, costs one look-up; equal costs go to the smaller hash.
    """

    def __init__(self, samples: int = SAMPLES, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.factors = rng.integers(0, 1 << 32, samples, dtype=np.uint32) | np.uint32(1)
        n = 1 << DRAW_BITS
        self.r, self.beta = rng.gamma(2, 1, n).astype(np.float32), rng.random(n, dtype=np.float32)
        self.log_c = np.log(rng.gamma(2, 1, n)).astype(np.float32)
        self.usual = self._cost(np.arange(n), np.float32(math.log(TOP)))

    def _steps(self, draw: np.ndarray, log_weight) -> np.ndarray:
        return np.floor(log_weight / self.r[draw] + self.beta[draw])

    def _cost(self, draw: np.ndarray, log_weight) -> np.ndarray:
        r = self.r[draw]
        return self.log_c[draw] - (r * (self._steps(draw, log_weight) - self.beta[draw]) + r)

    def __call__(self, hashes: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """One 64-bit value for each sample."""
        logs = np.log(weights).astype(np.float32)
        odd = np.abs(weights - TOP) > 1e-12
        best = np.full(len(self.factors), np.inf, np.float32)
        element = np.zeros(len(self.factors), np.uint64)
        step = np.zeros(len(self.factors), np.float32)
        each = np.arange(len(self.factors))
        for begin in range(0, len(hashes), 1024):
            h, log, special = hashes[begin : begin + 1024], logs[begin : begin + 1024], np.flatnonzero(odd[begin : begin + 1024])
            draw = (h >> np.uint64(32)).astype(np.uint32)[None, :] * self.factors[:, None] >> np.uint32(32 - DRAW_BITS)
            cost = np.take(self.usual, draw, mode="wrap")
            if len(special):
                cost[:, special] = self._cost(draw[:, special], log[special])
            at = cost.argmin(axis=1)
            least = cost[each, at]
            wins = least < best
            best = np.where(wins, least, best)
            element = np.where(wins, h[at], element)
            step = np.where(wins, self._steps(draw[each, at], log[at]), step)
        return _mixed(element + step.astype(np.int64).astype(np.uint64) * np.uint64(_M[1]))
