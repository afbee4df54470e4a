"""Exact token counts at every prefix of a text, by dynamic programming, stored so that questions need no encoding.

Of a word's prefixes that end after i bytes, the last token is the one token t that ends there and that the encoding of the prefix
without t can be followed by; the count is one more than that of the prefix without t. Whether a token can follow another is
whether byte-pair encoding leaves the two as they are, side by side. Two such tables run along a word: one for prefixes inside a word, and one
for prefixes that are the whole of it, whose last token bears the mark of a word's end. Words don't affect each other, so a text's counts are its
words' counts added up. Each distinct word's count is compared with the library's; should they differ, the library counts each of its prefixes.

A text is stored as the change of the count at each character, in as few bytes as hold it (one, in practice). Counts, truncation to a
budget and what fits a budget are then sums over that column, without tokenizer or encoding.
"""

from __future__ import annotations

import json
import re
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from asclepia.llm._base import arrow, written
from asclepia.llm._tokenizers import TOGETHER, Chunks, _loaded, cut_at_spaces, resolve, tokenizer

#: Words whose tables a worker remembers, and pairs of tokens.
MAX_WORDS, MAX_PAIRS = 400_000, 1_000_000


def _byte_letters() -> list[str]:
    """The characters that stand for bytes in the vocabulary: visible ones for themselves, the others from 256 on."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in visible]
    return [chr(b) if b in visible else chr(256 + rest.index(b)) for b in range(256)]


def _lower(text: str) -> str:
    """Lower case character by character, without the rule for a sigma at a word's end."""
    return text.replace("Σ", "σ").lower() if "Σ" in text else text.lower()


class Words:
    """The counts at all prefixes of words, of a byte-pair encoding with marked word ends over bytes."""

    def __init__(self, path: str) -> None:
        with open(resolve(path), encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.library, self.vocab, self.end = tokenizer(path), model["vocab"], model["end_of_word_suffix"] or ""
        merges = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        self.ranks = {(a, b): r for r, (a, b) in enumerate(merges)}
        self.longest = max(map(len, self.vocab))
        self.letters = dict(enumerate(_byte_letters()))
        self.pattern = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.special = [t["content"] for t in spec["added_tokens"] if t["special"]]
        self.specials = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        # Of each string that is a token, inside a word or at its end, what is known of which tokens it can follow there.
        self.tokens: dict[str, tuple[dict | None, dict | None]] = {}
        for token in self.vocab:
            ended = bool(self.end) and token.endswith(self.end)
            plain = token[: -len(self.end)] if ended else token
            inside, at_end = self.tokens.get(plain, (None, None))
            self.tokens[plain] = (inside, {}) if ended else ({}, at_end if self.end else {})
        # The longest token that ends with three given letters.
        self.reach: dict[str, int] = {}
        for plain in self.tokens:
            if len(plain) > 2:
                self.reach[plain[-3:]] = max(self.reach.get(plain[-3:], 2), len(plain))
        self.pairs = 0
        self.known = Chunks(self.learn, np.int32, MAX_WORDS)

    def _merged(self, symbols: list[str]) -> list[str]:
        """Byte-pair encoding, plainly: the pair of the lowest rank first, from the left."""
        while len(symbols) > 1:
            rank, at = min((self.ranks.get(p, 1 << 60), i) for i, p in enumerate(zip(symbols, symbols[1:], strict=False)))
            if rank == 1 << 60:
                break
            symbols[at : at + 2] = ["".join(symbols[at : at + 2])]
        return symbols

    def _follows(self, left: str, right: str, last: bool) -> bool:
        """Whether ``left`` and then ``right`` stay as they are; ``last``: right ends the word."""
        tail = [*right]
        if last:
            tail[-1] += self.end
        found = self._merged([*left, *tail]) == [left][: len(left)] + [right + self.end * last]
        self.pairs += 1
        if self.pairs >= MAX_PAIRS:
            self.pairs = 0
            for known in self.tokens.values():
                for x in known:
                    if x:
                        x.clear()
        self.tokens[right][last][left] = found
        return found

    def _bytes(self, text: str) -> str:
        return text if text.isascii() and text.isprintable() and " " not in text else text.encode().decode("latin-1").translate(self.letters)

    def _run(self, s: str, ends: list[bool], tokens: list[str], counts: list[int], whole: list[int]) -> None:
        """Continues over ``s`` the last token (``tokens``) and the count inside a word (``counts``) after i bytes, and the count of a
        word that ends there (``whole``, 0 where no character ends)."""
        known, reach = self.tokens.get, self.reach.get
        for i in range(len(tokens), len(s) + 1):
            inside, ended = "", 0 if ends[i - 1] else -1
            longest = reach(s[i - 3 : i], 2) if i > 2 else 2
            for k in range(i - longest if i > longest else 0, i):
                t = s[k:i]
                found = known(t)
                if found is not None:
                    left = tokens[k]
                    a, b = found
                    if not inside and a is not None:
                        good = a.get(left)
                        if good or (good is None and self._follows(left, t, False)):
                            inside, n = t, counts[k] + 1
                            if ended:
                                break
                    if ended == 0 and b is not None:
                        good = b.get(left)
                        if good or (good is None and self._follows(left, t, True)):
                            ended = counts[k] + 1
                            if inside:
                                break
            if not inside or ended == 0:
                raise ValueError(f"the vocabulary doesn't hold {s[i - 1]!r}")
            tokens.append(inside)
            counts.append(n)
            whole.append(ended if ended > 0 else 0)

    def counts(self, word: str) -> list[int]:
        """The counts of all prefixes of a word, a match of the pattern in normalised text."""
        if len(word) > 1 and word[0] == "'" and word[1].isalpha():  # "'re": its prefix "'r" is two words
            return [sum(self.counts(w)[-1] if w != word else self._plain(word)[-1] for w in self.pattern.findall(word[:k])) for k in range(1, len(word) + 1)]
        return self._plain(word)

    def _plain(self, word: str) -> list[int]:
        whole: list[int] = []
        self._run(self._bytes(word), _ends(word), [""], [0], whole)
        return [n for n in whole if n]

    def _sorted_counts(self, words: list[str]) -> list[list[int]]:
        """As counts, for words in order: what a word shares with the one before isn't done again."""
        out, before, tokens, counts, whole = [], "", [""], [0], []
        for word in words:
            if word[0] == "'":
                out.append(self.counts(word))
                continue
            s = self._bytes(word)
            same, most = 0, min(len(s), len(before))
            while same < most and s[same] == before[same]:
                same += 1
            ends = _ends(word)
            while same and (whole[same - 1] > 0) != ends[same - 1]:
                same -= 1
            del tokens[same + 1 :], counts[same + 1 :], whole[same:]
            self._run(s, ends, tokens, counts, whole)
            out.append(whole[:] if len(s) == len(word) else [n for n in whole if n])
            before = s
        return out

    def learn(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The change of the count at each character of new words, one after the other, and their lengths; checked against the library."""
        order = sorted(range(len(words)), key=words.__getitem__)
        tables: list = [None] * len(words)
        for i, table in zip(order, self._sorted_counts([words[i] for i in order]), strict=True):
            tables[i] = table
        if self.special:
            sep = self.special[-1]
            sep_id = self.library.token_to_id(sep)
            said: list[int] = []
            for e in self.library.encode_batch_fast([sep.join(words[a : a + TOGETHER]) for a in range(0, len(words), TOGETHER)], add_special_tokens=False):
                ids = np.array(e.ids)
                said += (np.diff(np.concatenate([[-1], np.flatnonzero(ids == sep_id), [len(ids)]])) - 1).tolist()
        else:
            said = [len(e.ids) for e in self.library.encode_batch_fast(words, add_special_tokens=False)]
        for i, (word, n) in enumerate(zip(words, said, strict=True)):
            if tables[i][-1] != n:
                tables[i] = [len(e.ids) for e in self.library.encode_batch_fast([word[:k] for k in range(1, len(word) + 1)], add_special_tokens=False)]
        sizes = np.fromiter(map(len, tables), np.int64, len(tables))
        flat = np.array([n for table in tables for n in table], np.int32)
        starts = np.cumsum(sizes) - sizes
        changes = np.diff(flat, prepend=0).astype(np.int32)
        changes[starts] = flat[starts]
        return changes, sizes

    def _odd(self, chunk: str) -> bool:
        """Whether normalising changes how many characters a chunk has, or it has a special string."""
        return ("<|" in chunk and bool(self.specials and self.specials.search(chunk))) or len(_lower(chunk)) != len(chunk) or not unicodedata.is_normalized("NFC", chunk)

    def changes(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The change of the count at each character of all chunks, in any order, and where each chunk's begin and how many they are.

        The words of plain chunks cover all their characters but white space, where the count doesn't change.
        """
        sizes = np.fromiter(map(len, chunks), np.int64, len(chunks))
        starts = np.zeros(len(chunks), np.int64)
        together = "\n".join(chunks)
        odd = [i for i, c in enumerate(chunks) if self._odd(c)] if self._odd(together) else []
        plain = np.ones(len(chunks), bool)
        plain[odd] = False
        if odd:
            together = "\n".join([chunks[i] for i in np.flatnonzero(plain).tolist()])
        flat = self._plain_changes(_lower(together))
        starts[plain] = np.cumsum(sizes[plain] + 1) - sizes[plain] - 1
        pieces = [flat]
        at = len(flat)
        for i in odd:
            pieces.append(self._with_specials(chunks[i]) if self.specials and self.specials.search(chunks[i]) else self._by_clusters(chunks[i]))
            starts[i] = at
            at += len(pieces[-1])
        return np.concatenate(pieces) if odd else flat, starts, sizes

    def _plain_changes(self, text: str) -> np.ndarray:
        """Of normalised text."""
        words = self.pattern.findall(text)
        values = self.known.values(self.known.numbers(words)) if words else np.empty(0, np.int32)
        points = np.frombuffer(text.encode("utf-32-le"), "<u4")
        out = np.zeros(len(points), np.int32)
        out[~_spaces()[points]] = values
        return out

    def _with_specials(self, chunk: str) -> np.ndarray:
        """A special string counts one once it is whole, ordinary text until then."""
        parts = self.specials.split(chunk)
        one = lambda text: self._by_clusters(text) if self._odd(text) else self._plain_changes(_lower(text))
        out = []
        for part, special in zip(parts[::2], [*parts[1::2], ""], strict=True):
            inside = one(part + special[:-1])
            out.append(inside)
            if special:
                out.append(np.array([int(one(part).sum()) + 1 - int(inside.sum())], np.int32))
        return np.concatenate(out)

    def _by_clusters(self, chunk: str) -> np.ndarray:
        """Where characters compose or change in number: cluster by cluster, since neither reaches beyond one.

        The text up to a cluster's end is a prefix of the normalised text. Up to a place inside, it mostly is, too; if not, the last word's
        tables go on from its last bytes over what the cluster's beginning becomes.
        """
        clusters = regex.findall(r"\X", chunk)
        forms = [_lower(unicodedata.normalize("NFC", c)) for c in clusters]
        text = "".join(forms)
        counts = np.concatenate([[0], np.cumsum(self._plain_changes(text))])
        spans = [m.span() for m in self.pattern.finditer(text)]
        out, at, w, tables = [], 0, 0, (-1, [], [])
        for cluster, form in zip(clusters, forms, strict=True):
            while w < len(spans) and spans[w][1] < at:
                w += 1
            for k in range(1, len(cluster)):
                part = _lower(unicodedata.normalize("NFC", cluster[:k]))
                if text.startswith(part, at):
                    out.append(counts[at + len(part)])
                    continue
                start = spans[w][0] if w < len(spans) and spans[w][0] < at <= spans[w][1] else at
                word = text[start:at]
                if len(word + part) <= 2 and text[start - 1 : start] == "'" and (start - 1, start) in spans[max(0, w - 1) : w]:
                    start, word = start - 1, "'" + word  # may become a word like "'re"
                if word and (word + part).isalpha():
                    if tables[0] != start:
                        whole = text[start : spans[w][1]]
                        tokens, held = [""], [0]
                        s = self._bytes(whole)
                        self._run(s, [False] * len(s), tokens, held, [])
                        tables = (start, np.cumsum([0, *(len(c.encode()) for c in whole)]).tolist(), (s, tokens, held))
                    s, tokens, held = tables[2]
                    n = tables[1][at - start]
                    low = max(0, n - self.longest)
                    more = self._bytes(part)
                    ended: list[int] = []
                    self._run(s[low:n] + more, [False] * (n - low + len(more) - 1) + [True], tokens[low : n + 1], held[low : n + 1], ended)
                    out.append(counts[start] + ended[-1])
                else:
                    out.append(counts[start] + sum(self.counts(x)[-1] for x in self.pattern.findall(word + part)))
            at += len(form)
            out.append(counts[at])
        return np.diff(np.array(out, np.int32), prepend=0).astype(np.int32)


_white: list[np.ndarray] = []


def _spaces() -> np.ndarray:
    """Which code points a pattern's \\s matches."""
    if not _white:
        _white.append(np.zeros(0x110000, bool))
        _white[0][[ord(c) for c in regex.findall(r"\s", "".join(map(chr, range(0x4000))))]] = True
    return _white[0]


_ALL = [True] * 1024


def _ends(word: str) -> list[bool]:
    """For each byte of a word whether a character ends there."""
    if word.isascii():
        return _ALL if len(word) <= len(_ALL) else [True] * len(word)
    out: list[bool] = []
    for c in word:
        out += [False] * (len(c.encode()) - 1) + [True]
    return out


def words_of(path: str) -> Words:
    key = ("words", path)
    if key not in _loaded:
        _loaded[key] = Words(path)
    return _loaded[key]


def prefixes_of(texts: pa.Array, path: str = "word_bpe_49k.json") -> tuple[list[bytes], list[int]]:
    """Each text's stored table, and the count of the whole text; null as empty."""
    words = words_of(path)
    flat, counts, _ = cut_at_spaces(pc.fill_null(texts, ""), single=False)
    coded = flat.dictionary_encode()
    changes, starts, sizes = words.changes(coded.dictionary.to_pylist())
    index = coded.indices.to_numpy()
    starts, sizes = starts[index], sizes[index]
    # All texts, each chunk's changes and then 0 for the space after it.
    to = np.cumsum(sizes + 1) - sizes - 1
    spread = np.zeros(int(sizes.sum()) + len(sizes), np.int32)
    at = np.arange(int(sizes.sum()), dtype=np.int64)
    before = np.cumsum(sizes) - sizes
    spread[at + np.repeat(to - before, sizes)] = changes[at + np.repeat(starts - before, sizes)]
    words.known.trim()
    lasts = np.cumsum(counts) - 1
    ends = to[lasts] + sizes[lasts]
    begins = np.concatenate([[0], ends[:-1] + 1])
    sums = np.concatenate([[0], np.cumsum(spread, dtype=np.int64)])
    totals = (sums[ends] - sums[begins]).tolist()
    narrow = spread.astype(np.int8)
    fits = bool((narrow == spread).all())
    tables = []
    for a, b in zip(begins.tolist(), ends.tolist(), strict=True):
        byte = fits or bool((narrow[a:b] == spread[a:b]).all())
        tables.append((b"\1" + narrow[a:b].tobytes()) if byte else (b"\4" + spread[a:b].astype("<i4").tobytes()))
    return tables, totals


def counts_of(table: bytes) -> np.ndarray:
    """The counts of the first 0, 1, 2, ... characters, from a stored table."""
    changes = np.frombuffer(table, {1: np.int8, 4: np.dtype("<i4")}[table[0]], offset=1)
    return np.concatenate([[0], np.cumsum(changes, dtype=np.int64)])


def longest_within(table: bytes, budget: int) -> int:
    """The most characters of the text, from its start, that have no more than ``budget`` tokens; -1 if the budget is below 0.

    A longer prefix may have fewer tokens than a shorter one: all are looked at.
    """
    found = np.flatnonzero(counts_of(table) <= budget)
    return int(found[-1]) if len(found) else -1


def prefix_table(docs: DataFrame, tokenizer_path: str = "word_bpe_49k.json", with_text: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens and prefixes (see counts_of) of every whole text, and text if asked for."""
    spark = docs.sparkSession
    arrow(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "text")
    schema = "doc_id long, n_bytes long, n_tokens long, prefixes binary" + ", text string" * with_text
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches):
        for batch in batches:
            tables, totals = prefixes_of(batch.column(2), tokenizer_path)
            columns = [batch.column(0), batch.column(1), pa.array(totals, pa.int64()), pa.array(tables, pa.binary())]
            yield pa.RecordBatch.from_arrays([*columns, batch.column(2)][: len(names)], names=names)

    return rows.mapInArrow(run, schema)


def token_counts(docs: DataFrame, tokenizer_path: str = "word_bpe_49k.json", limit: int = 2048, with_prefixes: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every whole text, and prefixes if asked for, from a stored prefix table.

    n_tokens is what the library gives for the whole text without added special tokens, truncation or padding; special
    strings inside a text are taken as the library takes them. Null text counts as empty: 0 bytes, 0 tokens; an empty table
    gives no rows; repeated rows and null ids stay; other columns are not looked at.
    """
    stored = written(prefix_table(docs, tokenizer_path, id_col=id_col, text_col=text_col), "prefix-counts")
    return stored.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"), *["prefixes"] * with_prefixes)


def truncated(stored: DataFrame, budget: int) -> DataFrame:
    """``stored`` (a prefix table with text) with chars, how many characters the budget allows, text cut there, and its n_tokens.

    Only the stored counts are read; nothing is encoded. A budget below 0 allows nothing: null chars, text and n_tokens. Null tables stay null.
    """
    arrow(stored.sparkSession)
    rows = stored.select("doc_id", "prefixes", "text")

    def run(batches):
        for batch in batches:
            tables, texts = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            chars = [None if t is None else longest_within(t, budget) for t in tables]
            chars = [None if k is None or k < 0 else k for k in chars]
            kept = [None if k is None else int(counts_of(t)[k]) for t, k in zip(tables, chars, strict=True)]
            cut = [None if k is None or x is None else x[:k] for x, k in zip(texts, chars, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(chars, pa.int64()), pa.array(kept, pa.int64()), pa.array(cut, pa.string())], names=["doc_id", "chars", "n_tokens", "text"])

    return rows.mapInArrow(run, "doc_id long, chars long, n_tokens long, text string")


def fits(stored: DataFrame, budgets: list[int]) -> DataFrame:
    """doc_id, fits (for each budget whether the whole text is within it) and chars (for each the most characters that are, -1 for none)."""
    arrow(stored.sparkSession)

    def run(batches):
        for batch in batches:
            tables = [t if t is not None else b"\1" for t in batch.column(1).to_pylist()]
            whole = [int(counts_of(t)[-1]) for t in tables]
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array([[n <= b for b in budgets] for n in whole], pa.list_(pa.bool_())), pa.array([[longest_within(t, b) for b in budgets] for t in tables], pa.list_(pa.int64())),
            ], names=["doc_id", "fits", "chars"])

    return stored.select("doc_id", "prefixes").mapInArrow(run, "doc_id long, fits array<boolean>, chars array<long>")
