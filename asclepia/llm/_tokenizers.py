"""The tokenizers library over chunks that it can never join: each distinct chunk of a batch is encoded once.

A whole text's ids are the chunks' ids in order whenever the cuts are where the library's own pre-tokenizer always cuts.
Most chunks of a corpus repeat, so that looking up a chunk costs less than encoding it. Arrow cuts and counts the chunks of a batch and
finds those that are known, so that Python only sees the new ones. What a worker remembers is bounded in chunks and in
characters: beyond that it keeps the half that was used most.
"""

from __future__ import annotations

import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Distinct chunks, and characters of them, that a worker remembers.
MAX_CHUNKS, MAX_CHARS = 600_000, 16 << 20
#: New chunks that go to the library in one text.
TOGETHER = 1_024

_loaded: dict = {}


def resolve(path: str) -> str:
    """A path as it is, or the name of a vocabulary file of the public tokenizers on this machine."""
    if "/" in path:
        return path
    import public_tokenizers

    return public_tokenizers.path(path)


def tokenizer(path: str):
    if path not in _loaded:
        os.environ["TOKENIZERS_PARALLELISM"], os.environ["RAYON_NUM_THREADS"] = "false", "1"
        from tokenizers import Tokenizer

        made = Tokenizer.from_file(resolve(path))
        made.no_truncation()
        made.no_padding()
        _loaded[path] = made
    return _loaded[path]


class Growing:
    """An array that grows by doubling."""

    def __init__(self, kind) -> None:
        self.held, self.n = np.zeros(1024, kind), 0

    def extend(self, more: np.ndarray) -> None:
        if self.n + len(more) > len(self.held):
            self.held = np.concatenate([self.held[: self.n], np.zeros(max(self.n, len(more)) + len(more), self.held.dtype)])
        self.held[self.n : self.n + len(more)] = more
        self.n += len(more)

    @property
    def all(self) -> np.ndarray:
        return self.held[: self.n]


class Chunks(dict):
    """Chunk to its number; what ``encode`` gives for number i is flat[starts[i]:starts[i + 1]].

    ``encode`` takes chunks and gives their values one after the other, as one array, and how many each has.
    """

    def __init__(self, encode, kind=np.uint32, most: int = MAX_CHUNKS, most_chars: int = MAX_CHARS) -> None:
        self.encode, self.kind, self.most, self.most_chars = encode, kind, most, most_chars
        self._reset()

    def _reset(self) -> None:
        self.flat, self.starts, self.used, self.new, self.chars = Growing(self.kind), Growing(np.int64), Growing(np.int64), [], 0
        self.starts.extend(np.zeros(1, np.int64))

    def __missing__(self, chunk: str) -> int:
        number = self[chunk] = len(self)
        self.new.append(chunk)
        return number

    def numbers(self, chunks: list[str], uses: np.ndarray | None = None) -> np.ndarray:
        """Their numbers; new ones are encoded. ``uses`` says how often each is used, once if None."""
        out = np.fromiter(map(self.__getitem__, chunks), np.int64, len(chunks))
        if self.new:
            flat, sizes = self.encode(self.new)
            self.flat.extend(flat)
            self.starts.extend(self.starts.all[-1] + np.cumsum(sizes))
            self.used.extend(np.zeros(len(sizes), np.int64))
            self.chars += sum(map(len, self.new))
            self.new = []
        np.add.at(self.used.all, out, 1 if uses is None else uses)
        return out

    def trim(self) -> None:
        """Forgets the half that was used least, once there are too many; numbers change."""
        if len(self) <= self.most and self.chars <= self.most_chars:
            return
        chunks = list(self)
        order = np.argsort(-self.used.all, kind="stable")
        chars = np.cumsum(np.fromiter(map(len, chunks), np.int64, len(chunks))[order])
        kept = np.sort(order[: self.most // 2][chars[: self.most // 2] <= self.most_chars // 2])
        flat, sizes, used = self.values(kept), self.sizes(kept), self.used.all[kept] // 2
        names = [chunks[i] for i in kept.tolist()]
        self.clear()
        self._reset()
        self.update(zip(names, range(len(names)), strict=True))
        self.flat.extend(flat)
        self.starts.extend(np.cumsum(sizes))
        self.used.extend(used)
        self.chars = sum(map(len, names))

    def sizes(self, numbers: np.ndarray) -> np.ndarray:
        starts = self.starts.all
        return starts[numbers + 1] - starts[numbers]

    def values(self, numbers: np.ndarray) -> np.ndarray:
        sizes = self.sizes(numbers)
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        at = np.arange(total, dtype=np.int64) + np.repeat(self.starts.all[numbers] - (ends - sizes), sizes)
        return self.flat.all[at]


class KnownChunks:
    """The same for Arrow arrays of distinct chunks: what is remembered is an Arrow array, too, a tenth of a dictionary's size."""

    def __init__(self, encode, most: int = MAX_CHUNKS, most_chars: int = MAX_CHARS) -> None:
        self.encode, self.most, self.most_chars = encode, most, most_chars
        self._reset(pa.array([], pa.string()))

    def _reset(self, chunks: pa.Array) -> None:
        self.chunks, self.flat, self.starts, self.used = chunks, Growing(np.uint32), Growing(np.int64), Growing(np.int64)
        self.starts.extend(np.zeros(1, np.int64))

    def numbers(self, chunks: pa.Array, uses: np.ndarray) -> np.ndarray:
        """Their numbers, and new ones are encoded; ``uses`` says how often each is used."""
        found = pc.index_in(chunks, value_set=self.chunks)
        new = chunks.filter(found.is_null())
        out = found.fill_null(-1).to_numpy().astype(np.int64)
        if len(new):
            out[out < 0] = np.arange(len(self.chunks), len(self.chunks) + len(new))
            flat, sizes = self.encode(new.to_pylist())
            self.flat.extend(flat)
            self.starts.extend(self.starts.all[-1] + np.cumsum(sizes))
            self.used.extend(np.zeros(len(new), np.int64))
            self.chunks = pa.concat_arrays([self.chunks, new])
        self.used.all[out] += uses
        return out

    def trim(self) -> None:
        """Forgets the half that was used least, once there are too many; numbers change."""
        chars = pc.binary_length(self.chunks).to_numpy().astype(np.int64)
        if len(chars) <= self.most and chars.sum() <= self.most_chars:
            return
        order = np.argsort(-self.used.all, kind="stable")[: self.most // 2]
        kept = np.sort(order[np.cumsum(chars[order]) <= self.most_chars // 2])
        starts = self.starts.all
        sizes = starts[kept + 1] - starts[kept]
        flat, used, chunks = spread(self.flat.all, starts[kept], sizes), self.used.all[kept] // 2, self.chunks.take(pa.array(kept))
        self._reset(chunks)
        self.flat.extend(flat)
        self.starts.extend(np.cumsum(sizes))
        self.used.extend(used)


def spread(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The pieces of ``flat`` from ``starts`` on, one after the other."""
    at = np.arange(int(sizes.sum()), dtype=np.int64)
    return flat[at + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)]


#: Where a space has other white space beside it; only there a cut before a space may be wrong. What patterns call \s, and four separators.
_SPACE = "[\\t-\\r\\x1c-\\x20\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]".encode().decode("unicode_escape")
_TOUCHING = f" {_SPACE}|{_SPACE} "
_CUT = re.compile(r"(?<=\S) (?=\S)")


def cut_at_spaces(texts: pa.Array, single: bool) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """All chunks of texts without nulls one after the other, how many each text has, and which text they are of.

    Texts are cut at each space or, if ``single``, only at spaces between two characters other than white space.
    """
    if not single:
        cut = pc.split_pattern(texts, " ")
        return cut.flatten(), np.diff(cut.offsets.to_numpy()), np.arange(len(texts))
    touching = pc.match_substring_regex(texts, _TOUCHING).to_numpy(zero_copy_only=False)
    plain = pc.split_pattern(texts.filter(pa.array(~touching)), " ")
    odd = [_CUT.split(t) for t in texts.filter(pa.array(touching)).to_pylist()]
    flat = plain.flatten()
    if odd:
        flat = pa.concat_arrays([flat, pa.array([c for x in odd for c in x], flat.type)])
    counts = np.concatenate([np.diff(plain.offsets.to_numpy()), np.array([len(x) for x in odd], np.int64)]).astype(np.int64)
    return flat, counts, np.concatenate([np.flatnonzero(~touching), np.flatnonzero(touching)])


def byte_level_chunks(path: str) -> KnownChunks:
    """Ids of chunks that follow a space, by the library."""
    key = ("byte-level", path)
    if key not in _loaded:
        t = tokenizer(path)
        spaced = np.zeros(max(t.get_vocab().values()) + 1, bool)  # ids of tokens that begin with a space
        spaced[[i for token, i in t.get_vocab().items() if token.startswith("Ġ")]] = True

        def encode(chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
            # Behind a space, a chunk without one begins with its only token that begins with a space; so many go in one text.
            together = [i for i, c in enumerate(chunks) if c and " " not in c and not c[0].isspace() and not c[-1].isspace()]
            texts = [" " + " ".join([chunks[i] for i in together[a : a + TOGETHER]]) for a in range(0, len(together), TOGETHER)]
            found = [np.array(e.ids, np.uint32) for e in t.encode_batch_fast(texts, add_special_tokens=False)]
            ids = np.concatenate(found) if found else np.empty(0, np.uint32)
            at = np.append(np.flatnonzero(spaced[ids]), len(ids))
            sizes = np.zeros(len(chunks), np.int64)
            sizes[together] = np.diff(at)
            if len(together) == len(chunks):
                return ids, sizes
            alone = sorted(set(range(len(chunks))).difference(together))
            rest = [np.array(e.ids, np.uint32) for e in t.encode_batch_fast([" " + chunks[i] for i in alone], add_special_tokens=False)]
            sizes[alone] = [len(x) for x in rest]
            out = np.zeros(int(sizes.sum()), np.uint32)
            lone = np.zeros(len(chunks), bool)
            lone[alone] = True
            of = np.repeat(lone, sizes)
            out[of], out[~of] = np.concatenate(rest), ids
            return out, sizes

        _loaded[key] = KnownChunks(encode)
    return _loaded[key]


def encode_texts(path: str, texts: pa.Array) -> list[np.ndarray]:
    """Each text's ids as the library gives them for the whole text, without added special tokens; null as empty.

    The library's byte-level pattern always cuts before a single space between two other characters: a match that ends there has no
    white space at its end, and the next one starts with the space. The chunk that a text begins with follows no space and is encoded by itself.
    """
    if not len(texts):
        return []
    known = byte_level_chunks(path)
    flat, counts, owners = cut_at_spaces(pc.fill_null(texts, ""), single=True)
    first = np.cumsum(counts) - counts
    heads = [np.array(e.ids, np.uint32) for e in tokenizer(path).encode_batch_fast(flat.take(pa.array(first)).to_pylist(), add_special_tokens=False)]
    coded = flat.dictionary_encode()
    index = coded.indices.to_numpy()
    uses = np.bincount(index, minlength=len(coded.dictionary))
    numbers = known.numbers(coded.dictionary, uses)
    starts, sizes = known.starts.all[numbers], np.diff(known.starts.all)[numbers]
    starts, sizes = starts[index], sizes[index]
    of_heads = np.array([len(x) for x in heads])
    starts[first], sizes[first] = known.flat.n + np.cumsum(of_heads) - of_heads, of_heads
    ids = spread(np.concatenate([known.flat.all, *heads]), starts, sizes)
    ends = np.concatenate([[0], np.cumsum(sizes)])[np.cumsum(counts)]
    known.trim()
    out: list = [None] * len(owners)
    for i, a, b in zip(owners.tolist(), np.concatenate([[0], ends[:-1]]).tolist(), ends.tolist(), strict=True):
        out[i] = ids[a:b]
    return out
