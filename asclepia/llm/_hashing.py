"""Vectorised 64-bit hashes of the words of many texts, over their UTF-8 bytes, in windows of bounded memory."""

from __future__ import annotations

import numpy as np

#: Bytes hashed at once; a longer text is hashed window by window, cut at white space.
WINDOW = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_powers = [np.ones(1, np.uint64)]


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit numbers (the finaliser of splitmix64)."""
    h = (h ^ (h >> np.uint64(30))) * _M1
    h = (h ^ (h >> np.uint64(27))) * _M2
    return h ^ (h >> np.uint64(31))


def powers(n: int) -> np.ndarray:
    if len(_powers[0]) < n:
        _powers[0] = np.concatenate([[np.uint64(1)], np.cumprod(np.full(n * 2 - 1, _BASE, np.uint64))])
    return _powers[0]


def classes(punctuation: bool) -> np.ndarray:
    """1 for bytes of words (ASCII letters, digits, underscore, all beyond ASCII), 2 for other visible bytes, 0 for the rest."""
    out = np.zeros(256, np.uint8)
    for b in range(256):
        if b >= 128 or chr(b).isalnum() or chr(b) == "_":
            out[b] = 1
        elif punctuation and b > 32 and b != 127:
            out[b] = 2
    return out


FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32


def _window(data: np.ndarray, lut: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and hashes of the runs of equal class other than 0."""
    kind = lut[data]
    edge = np.flatnonzero(kind[1:] != kind[:-1]) + 1
    starts = np.concatenate([[0], edge])
    ends = np.append(edge, len(data))
    real = kind[starts] > 0
    sizes = ends - starts
    at = np.arange(len(data)) - np.repeat(starts, sizes)
    sums = np.add.reduceat((data.astype(np.uint64) + np.uint64(1)) * powers(int(sizes.max()) + 1)[at], starts)
    return starts[real], mix(sums[real] + sizes[real].astype(np.uint64))


def word_hashes(texts: list[str | None], punctuation: bool = False, fold: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of all texts, one after the other, and where each text's begin (one entry more than texts)."""
    lut = classes(punctuation)
    hashes, counts = [], np.zeros(len(texts), np.int64)
    group: list[bytes] = []
    first, held = 0, 0

    def flush(upto: int) -> None:
        nonlocal group, held, first
        if group:
            data = np.frombuffer(b"\n".join(group) + b"\n", np.uint8)
            starts, got = _window(FOLD[data] if fold else data, lut)
            ends = np.cumsum([len(g) + 1 for g in group])
            counts[first:upto] = np.diff(np.searchsorted(starts, ends), prepend=0)
            hashes.append(got)
        group, held, first = [], 0, upto

    for i, text in enumerate(texts):
        raw = (text or "").encode()
        if len(raw) > WINDOW:
            flush(i)
            at = 0
            while at < len(raw):
                end = at + WINDOW
                if end < len(raw):
                    cut = max(raw.rfind(b" ", at, end), raw.rfind(b"\n", at, end))
                    if cut <= at:  # one run without white space: as long as it is
                        cut = min((p for p in (raw.find(b" ", end), raw.find(b"\n", end)) if p >= 0), default=len(raw))
                    end = cut
                data = np.frombuffer(raw, np.uint8, min(end, len(raw)) - at, at)
                _, got = _window(FOLD[data] if fold else data, lut)
                hashes.append(got)
                counts[i] += len(got)
                at = end
            first = i + 1
            continue
        group.append(raw)
        held += len(raw)
        if held > WINDOW:
            flush(i + 1)
    flush(len(texts))
    return np.concatenate(hashes) if hashes else np.empty(0, np.uint64), np.concatenate([[0], np.cumsum(counts)])
