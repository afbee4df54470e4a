"""Language identification by rank-order profiles: how far a document's most frequent n-grams are out of place in each language's.

N-grams are runs of 1 to 3 characters of lower-cased letters, with one mark before and after each word; other characters only part
words. A profile is the ``TOP`` most frequent n-grams in rank order. A language's distance is the sum, over the document's profile, of the
difference of ranks, or ``TOP`` for an n-gram that its profile lacks.
"""

from __future__ import annotations

import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from asclepia.llm._base import arrow, map_rows, small_side, written

TOP = 300
#: Profiles are fitted on about this many documents of each language at most, picked by a hash of the id.
TRAIN_DOCS = 2_000
#: Characters of a text that are counted at once; longer texts are counted piece by piece and summed.
PIECE = 1 << 20
_PLAIN_LETTERS = ("Lu", "Ll", "Lt", "Lo")
_MARK = 1  # stands for the edge of a word; no letter has this code point

_letters: list[np.ndarray] = []


def letters() -> np.ndarray:
    """Which code points are letters, as Python's str.isalpha has it."""
    if not _letters:
        _letters.append(np.array([chr(i).isalpha() for i in range(0x110000)], bool))
    return _letters[0]


def _symbols(points: np.ndarray, inside: bool) -> np.ndarray:
    """Letters, and one mark for what is between two words; ``inside``: a word goes on from before."""
    letter = letters()[points]
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    keep[:1] |= inside
    return np.where(letter, points, _MARK)[keep].astype(np.uint64)


def _grams(tail: np.ndarray, new: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams that end in the symbols ``new``, which come after ``tail``: two symbols, or the mark at the start of a text."""
    y = np.concatenate([tail, new])
    real = y != _MARK
    pairs = y[:-1] << np.uint64(21) | y[1:]
    triples = (pairs[:-1] << np.uint64(21) | y[2:])[real[1:-1]]
    return np.unique(np.concatenate([new[new != _MARK], pairs[len(tail) - 1 :], triples]), return_counts=True)


def _cut(text: str, at: int) -> int:
    """The first place from ``at`` on where lower-casing both sides apart is lower-casing the whole.

    That is behind white space, or between two letters that have no part in the rule for a sigma at a word's end.
    """
    while at < len(text):
        a, b = text[at - 1], text[at]
        if a.isspace() or (unicodedata.category(a) in _PLAIN_LETTERS and unicodedata.category(b) in _PLAIN_LETTERS and "\u03a3" not in (a, b)):
            return at
        at += 1
    return at


def count_grams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """The distinct n-grams of a whole text as numbers, ascending, and how often each comes."""
    text = text or ""
    codes, counts, at = [], [], 0
    tail = np.array([_MARK], np.uint64)
    while at < len(text):
        end = _cut(text, at + PIECE) if len(text) - at > PIECE else len(text)
        points = np.frombuffer(text[at:end].lower().encode("utf-32-le", "surrogatepass"), "<u4")
        at = end
        new = _symbols(points, bool(tail[-1] != _MARK))
        if at == len(text) and len(new) and new[-1] != _MARK:
            new = np.append(new, np.uint64(_MARK))
        elif at == len(text) and not len(new) and tail[-1] != _MARK:
            new = np.array([_MARK], np.uint64)
        if not len(new):
            continue
        c, n = _grams(tail, new)
        tail = np.concatenate([tail, new])[-2:]
        codes.append(c)
        counts.append(n)
        if len(codes) == 8:
            codes, counts = ([x] for x in _summed(codes, counts))
    if not codes:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    return (codes[0], counts[0]) if len(codes) == 1 else _summed(codes, counts)


def _summed(codes: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    flat, where = np.unique(np.concatenate(codes), return_inverse=True)
    return flat, np.bincount(where, np.concatenate(counts), len(flat)).astype(np.int64)


def ranked(codes: np.ndarray, counts: np.ndarray, top: int = TOP) -> np.ndarray:
    """The ``top`` most frequent n-grams in rank order; ties by number."""
    if len(codes) > top:
        least = np.partition(counts, len(counts) - top)[len(counts) - top]
        sure, tied = counts > least, np.flatnonzero(counts == least)
        sure[tied[: top - int(sure.sum())]] = True
        codes, counts = codes[sure], counts[sure]
    return codes[np.lexsort((codes, -counts))]


class Profiles:
    """Ranked n-grams of each language, by n-gram: which languages have it, and at which rank. As large as the profiles are."""

    def __init__(self, profiles: dict[str, np.ndarray], top: int = TOP) -> None:
        self.top, self.langs = top, sorted(profiles)
        codes = [profiles[k] for k in self.langs]
        flat = np.concatenate(codes) if codes else np.empty(0, np.uint64)
        order = np.argsort(flat, kind="stable")
        self.known, starts = np.unique(flat[order], return_index=True)
        self.starts = np.append(starts, len(flat))
        self.owner = np.repeat(np.arange(len(codes), dtype=np.int32), [len(c) for c in codes])[order]
        self.rank = np.concatenate([np.arange(len(c), dtype=np.int32) for c in codes])[order] if codes else np.empty(0, np.int32)

    def distances(self, codes: np.ndarray) -> np.ndarray:
        """How far the ranked n-grams ``codes`` are out of place in each language: ``top`` for one that its profile lacks."""
        at = np.searchsorted(self.known, codes)
        hit = np.flatnonzero(self.known[np.minimum(at, len(self.known) - 1)] == codes) if len(self.known) else np.empty(0, np.int64)
        lo, n = self.starts[at[hit]], self.starts[at[hit] + 1] - self.starts[at[hit]]
        found = np.arange(int(n.sum())) + np.repeat(lo - (np.cumsum(n) - n), n)
        nearer = self.top - np.abs(self.rank[found] - np.repeat(hit, n))
        return self.top * len(codes) - np.bincount(self.owner[found], nearer, len(self.langs)).astype(np.int64)

    def predict(self, text: str | None) -> tuple[str, float]:
        """Language and 1 - distance / largest possible distance; ("und", 0) if there is no letter or nothing was learned."""
        codes = ranked(*count_grams(text), self.top)
        if not len(codes) or not self.langs:
            return "und", 0.0
        distance = self.distances(codes)
        best = int(distance.argmin())  # languages are sorted: ties go to the first by code point
        return self.langs[best], float(1 - distance[best] / (self.top * len(codes)))


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def fit(docs: DataFrame, train_docs: int = TRAIN_DOCS, top: int = TOP, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Profiles:
    """Profiles from text and non-null lang of documents that aren't held out, at most about ``train_docs`` of each language.

    All languages are learned; their profiles, ``top`` rows each, come to the driver and go to the executors as one broadcast.
    """
    arrow(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    rows = rows.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("id")))
    share = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    share = written(share.select(F.col("lang").alias("_lang"), (F.lit(float(train_docs)) / F.col("n")).alias("share")), "language-shares")
    picked = rows.join(small_side(share, share.count()), F.col("lang") == F.col("_lang"))
    picked = picked.filter(F.pmod(F.xxhash64("id", F.lit("language")), F.lit(1 << 20)) < F.col("share") * (1 << 20)).select("lang", "text")

    def run(batches):
        codes: dict[str, list] = {}
        counts: dict[str, list] = {}
        for batch in batches:
            for lang, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                c, n = count_grams(text)
                codes.setdefault(lang, []).append(c)
                counts.setdefault(lang, []).append(n)
                if len(codes[lang]) == 256:
                    summed = _summed(codes[lang], counts[lang])
                    codes[lang], counts[lang] = [summed[0]], [summed[1]]
        for lang in codes:
            c, n = _summed(codes[lang], counts[lang])
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(c), pa.string()), pa.array(c.astype(np.int64)), pa.array(n)], names=["lang", "code", "n"])

    counted = picked.mapInArrow(run, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    best = W.partitionBy("lang").orderBy(F.desc("n"), "code")
    table = counted.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top).select("lang", "code", "rank").collect()
    profiles: dict[str, list] = {}
    for lang, code, _ in sorted(table, key=lambda r: (r[0], r[2])):
        profiles.setdefault(lang, []).append(code)
    return Profiles({k: np.array(v, np.uint64) for k, v in profiles.items()}, top)


def predicted(docs: DataFrame, profiles: Profiles, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, lang_pred, score of every whole text; only the text is looked at for the prediction.

    ``und`` with score 0 if the text is null or has no letter, or nothing could be learned; equal distances go to the first language by
    code point; an empty table gives no rows; repeated rows and null ids (not held out) stay; other columns are not looked at.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), held_out(F.col(id_col)).alias("held"), F.col(text_col).alias("text"))
    arrow(docs.sparkSession)
    learned = docs.sparkSession.sparkContext.broadcast(profiles)

    def run(ids: list, held: list, texts: list) -> dict:
        got = [learned.value.predict(t) for t in texts]
        return {"doc_id": ids, "held_out": held, "lang_pred": [g[0] for g in got], "score": [g[1] for g in got]}

    return map_rows(rows, run, "doc_id long, held_out boolean, lang_pred string, score double")


def identified(docs: DataFrame, **options) -> DataFrame:
    return predicted(docs, fit(docs, **options))
