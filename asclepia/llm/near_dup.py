"""Near-duplicate detection: improved consistent weighted sampling over TF-IDF shingles, banded, verified by weighted Jaccard.

A shingle is five words (runs of letters, digits and bytes beyond ASCII, lower-cased A-Z; a shorter text is one shingle).
Its weight in a document is tf * idf, idf = 1 + ln((1 + N) / (1 + df)), and df how many of all documents have it, counted exactly for
every shingle. Equal word sequences are one text, linked by that alone.

0. Hashes of shingles are dealt over parts by their value. Each chunk of documents sends a part each of its shingles once, with its df in the chunk;
   the part adds these up. It keeps the df of 2 and more, and tells each document how many shingles it alone has. A text can't be similar
   to another if these weigh too much (:func:`_open`); such texts take no further part. The others ask the parts, again by chunks, for
   each shingle's df, which stays with the text from there on. No part or chunk grows with a shingle's df, and none is broadcast.
1. Each text gets ``BANDS * ROWS`` samples; two texts agree on a sample with their weighted Jaccard similarity as probability.
2. Texts that agree on all samples of a band share a bucket, and every two texts of a bucket end in one component or are
   compared on their whole vectors. First each is compared with the leader of each of its buckets, the text that most others share
   buckets with, and links are joined. What that leaves apart in a bucket is then compared exactly: each text outside the bucket's largest
   component with all texts of the bucket that aren't in its own. Both times a bucket is dealt in units of bounded rows and characters on
   average, and a unit's pairs are counted in a worker (by an inverted index of shingles), so that they are never rows. No bucket is collected, none is capped.
3. Verified links are joined to components by label propagation with pointer jumping, in tables.

A key with a thousandth of the rows or more (there are a thousand at most) is joined by broadcast, so that no task gets a hot bucket or class.
"""

from __future__ import annotations

import hashlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from asclepia.llm._base import MAX_BROADCAST_KEYS, arrow, at_rest, dropped, joined, located, map_rows, small_side, written
from asclepia.llm._hashing import mix, word_hashes

WORDS, SIMILAR = 5, 0.8
#: Sums of weights in another order differ in their last digits: so much less than SIMILAR still counts as that.
CLOSE = 1e-9
#: A pair at similarity 0.8 shares no band with probability (1 - 0.8 ** ROWS) ** BANDS = 0.0002.
BANDS, ROWS = 16, 4
#: Of a bucket's texts so many rows, and so many characters, on average make a block; two blocks are in a worker's memory at once.
BLOCK_ROWS, BLOCK_CHARS = 256, 4 << 20
#: Shingles that make up less than 1 / KNOWN of all (document, shingle) pairs weigh as if they made up that; so much that none does: every df is its own.
KNOWN = 1 << 62
#: Shingles that are counted or looked up at once; parts and chunks hold so many on average.
CHUNK = 1 << 20
#: Parts and chunks at least, so that a small table is dealt over the machines too.
PARTS = 64
_STEP = np.uint64(0xD6E8FEB86659FD93)
_C1, _C2, _C3 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53), np.uint64(0x9E3779B97F4A7C15)
_SEEDS = mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64) * _C3)


def _gamma2() -> np.ndarray:
    """65,536 quantiles of Gamma(2, 1), from its distribution function 1 - (1 + x) exp(-x)."""
    x = np.linspace(0, 40, 400_001)
    return np.interp((np.arange(1 << 16) + 0.5) / (1 << 16), 1 - (1 + x) * np.exp(-x), x).astype(np.float32)


_GAMMA = _gamma2()
_INVERSE = (1 / _GAMMA).astype(np.float32)


class Idf(NamedTuple):
    """Frequent shingles, ascending, their idf, and the idf of all others."""

    shingles: np.ndarray
    values: np.ndarray
    rare: float


class Exact(NamedTuple):
    """idf of any df among ``n`` documents; a df counts as ``least`` at least (1: as it is)."""

    n: int
    least: int

    def of(self, df: np.ndarray) -> np.ndarray:
        return 1 + np.log((1 + self.n) / (1 + np.minimum(np.maximum(df, self.least), self.n)))


def shingles_of(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of a document, ascending, and how often each comes."""
    n = len(words)
    if not n:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    k = min(WORDS, n)
    h = words[: n - k + 1].copy()
    for j in range(1, k):
        h = h * _STEP + words[j : n - k + 1 + j]
    return np.unique(mix(h), return_counts=True)


def vector(words: np.ndarray, idf: Idf) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of a document, ascending, and their tf * idf."""
    shingles, tf = shingles_of(words)
    weights = np.full(len(shingles), idf.rare)
    if len(idf.shingles):
        at = np.minimum(np.searchsorted(idf.shingles, shingles), len(idf.shingles) - 1)
        known = idf.shingles[at] == shingles
        weights[known] = idf.values[at[known]]
    return shingles, weights * tf


def vectors_of(texts: list[str | None], idf: Idf | Exact, dfs: list[bytes] | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
    """Vectors by the df of each text's shingles (see :func:`_signed`), or, without, by a table of frequent ones."""
    words, at = word_hashes(texts)
    if dfs is None:
        return [vector(words[at[i] : at[i + 1]], idf) for i in range(len(texts))]
    found = [shingles_of(words[at[i] : at[i + 1]]) for i in range(len(texts))]
    return [(s, tf * idf.of(_numbers(df, len(s)))) for (s, tf), df in zip(found, dfs, strict=True)]


def _group_vectors(group: pa.Table, idf: Idf | Exact) -> list[tuple[np.ndarray, np.ndarray]]:
    return vectors_of(group["text"].to_pylist(), idf, group["df"].to_pylist() if "df" in group.column_names else None)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard: sum of minima over sum of maxima; two empty documents are equal."""
    if not len(a[0]) or not len(b[0]):
        return float(len(a[0]) == len(b[0]))
    at = np.minimum(np.searchsorted(a[0], b[0]), len(a[0]) - 1)
    same = a[0][at] == b[0]
    shared = np.minimum(a[1][at[same]], b[1][same]).sum()
    return float(shared / (a[1].sum() + b[1].sum() - shared))


def samples(shingles: np.ndarray, weights: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Improved consistent weighted samples, a row of BANDS * ROWS 32-bit numbers for each document of one or more shingles."""
    out = np.empty((len(starts), len(_SEEDS)), np.uint32)
    log_w = np.log(weights).astype(np.float32)
    for k, seed in enumerate(_SEEDS):
        m = shingles ^ seed
        m *= _C1
        m ^= m >> np.uint64(32)
        m *= _C2
        m ^= m >> np.uint64(29)
        u = ((m & np.uint64(0xFFFFFF)).astype(np.float32) + np.float32(0.5)) * (((m >> np.uint64(24)) & np.uint64(0xFFFFFF)).astype(np.float32) + np.float32(0.5))
        c = np.log(-np.log(u * np.float32(2.0**-48)) + np.float32(1e-30))
        pick = (m >> np.uint64(48)).astype(np.int64)
        r = _GAMMA[pick]
        beta = ((m * _C3) >> np.uint64(40)).astype(np.float32) * np.float32(2.0**-24)
        t = np.floor(log_w * _INVERSE[pick] + beta)
        a = c - r * (t - beta + np.float32(1))
        # Floats as ordered integers, with the sample's name below: one minimum gives both.
        bits = a.view(np.int32)
        order = (bits ^ ((bits >> 31) & np.int32(0x7FFFFFFF))).astype(np.int64) + (1 << 31)
        name = (shingles + t.astype(np.int64).astype(np.uint64) * _C1) * _C2 >> np.uint64(32)
        out[:, k] = np.minimum.reduceat((order.astype(np.uint64) << np.uint64(32)) | name, starts) & np.uint64(0xFFFFFFFF)
    return out


def inverse_frequencies(texts: DataFrame) -> Idf:
    """idf of the frequent shingles alone (``near_duplicates`` doesn't use it: it has each shingle's own), in two passes over their texts that shuffle little and bring 2 * KNOWN rows at most to the driver.

    A shingle with 1 / KNOWN of all T pairs has, in some chunk of C pairs, C / KNOWN or more; chunks that hold fewer than half of that
    together miss half of its df at most. So those whose reported counts reach T / (2 * KNOWN), 2 * KNOWN at most, include every such shingle
    however the chunks fall; the second pass counts these exactly.
    """

    def report(batches):
        n, total, held, size = 0, 0, [], 0

        def chunk() -> pa.RecordBatch:
            found, df = np.unique(np.concatenate(held), return_counts=True)
            most = df * (2 * KNOWN) >= size
            return _counts(0, found[most], df[most])

        for batch in batches:
            words, at = word_hashes(batch.column(0).to_pylist())
            n += len(at) - 1
            for i in range(len(at) - 1):
                held.append(shingles_of(words[at[i] : at[i + 1]])[0])
                size += len(held[-1])
                if size >= CHUNK:
                    yield chunk()
                    total, held, size = total + size, [], 0
        if size:
            yield chunk()
        yield _counts(1, np.zeros(1, np.uint64), np.array([n]))
        yield _counts(2, np.zeros(1, np.uint64), np.array([total + size]))

    summed = lambda df: df.groupBy("kind", "code").agg(F.sum("n").alias("n"))
    reported = written(summed(texts.mapInArrow(report, "kind int, code long, n long")), "shingles-reported")
    sums = {r.kind: r.n for r in reported.filter("kind > 0").collect()}
    n, total = sums.get(1, 0), sums.get(2, 0)
    least = max(1, -(-total // KNOWN))
    some = reported.filter((F.col("kind") == 0) & (F.col("n") * (2 * KNOWN) >= total)).select("code").toArrow()
    candidates = np.sort(some["code"].to_numpy().astype(np.int64).view(np.uint64))
    dropped(reported)
    rare = 1 + np.log((1 + n) / (1 + min(least, n)))
    if not len(candidates):
        return Idf(candidates, np.empty(0), rare)
    asked = texts.sparkSession.sparkContext.broadcast(candidates)

    def count(batches):
        known = asked.value
        df = np.zeros(len(known), np.int64)
        for batch in batches:
            words, at = word_hashes(batch.column(0).to_pylist())
            for i in range(len(at) - 1):
                shingles = shingles_of(words[at[i] : at[i + 1]])[0]
                to = np.minimum(np.searchsorted(known, shingles), len(known) - 1)
                df[to[known[to] == shingles]] += 1
        yield _counts(0, known[df > 0], df[df > 0])

    table = summed(texts.mapInArrow(count, "kind int, code long, n long")).select("code", "n").toArrow()
    code, df = table["code"].to_numpy().astype(np.int64).view(np.uint64), table["n"].to_numpy()
    code, df = code[df >= least], df[df >= least]
    order = np.argsort(code)
    return Idf(code[order], 1 + np.log((1 + n) / (1 + df[order])), rare)


def _counts(kind: int, codes: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(codes), kind, np.int32)), pa.array(codes.view(np.int64)), pa.array(n.astype(np.int64))], names=["kind", "code", "n"])


def _packed(x: np.ndarray) -> bytes:
    """Whole numbers of 0 or more, in as many bytes each as the largest needs."""
    return x.astype(np.min_scalar_type(int(x.max()) if len(x) else 0)).tobytes()


def _numbers(blob: bytes, n: int) -> np.ndarray:
    return np.frombuffer(blob, f"u{len(blob) // n}").astype(np.int64) if n else np.empty(0, np.int64)


def _planes(hashes: np.ndarray) -> bytes:
    """Ascending hashes, all first bytes, then all second ones: the leading ones compress."""
    return hashes.astype(">u8").view(np.uint8).reshape(-1, 8).T.tobytes()


def _hashes(blob: bytes) -> np.ndarray:
    if not blob:
        return np.empty(0, np.uint64)
    return np.ascontiguousarray(np.frombuffer(blob, np.uint8).reshape(8, -1).T).view(">u8").ravel().astype(np.uint64)


def _firsts(ordered: np.ndarray) -> np.ndarray:
    """Where in ascending numbers each begins."""
    return np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(ordered) else np.empty(0, np.int64)


def _cuts(shingles: np.ndarray, parts: int) -> np.ndarray:
    """Where in ascending hashes each part begins, and the end."""
    return np.searchsorted(((shingles >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32), np.arange(parts + 1, dtype=np.uint64))


def _digested(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, _file, _row, d (a digest of the text's words), chars, and tf (the shingles, repeated ones too) of each row."""
    rows = located(docs, {"id": F.col(id_col).cast("long"), "text": F.col(text_col)})

    def run(ids: list, texts: list, files: list, at_rows: list) -> dict:
        words, at = word_hashes(texts)
        names = [hashlib.blake2b(words[at[i] : at[i + 1]].tobytes(), digest_size=16).digest() for i in range(len(texts))]
        n = np.diff(at)
        return {"id": ids, "_file": files, "_row": at_rows, "d": names, "chars": [len(t or "") for t in texts], "tf": np.where(n, np.maximum(n - WORDS + 1, 1), 0)}

    return map_rows(rows, run, "id long, _file string, _row long, d binary, chars long, tf long")


def _counted(rows: DataFrame, parts: int) -> DataFrame:
    """What the parts know of the shingles of ``rows`` (text, _file, _row).

    A row of each part: part, its shingles with a df of 2 or more as ``at``, these as ``n``, and the sum of all its df as ``pairs``. Rows of each part and
    chunk: file and base (the chunk's first row), in ``at`` the rows, less base, that alone have some shingles, and in ``n`` how many.
    """
    schema = pa.schema([("part", pa.int32()), ("file", pa.string()), ("base", pa.int64()), ("shingles", pa.binary()), ("n", pa.binary()), ("owner", pa.binary())])

    def ask(batches):
        held, places, size, file = [], [], 0, None

        def chunk() -> pa.RecordBatch:
            s = np.concatenate(held)
            order = np.argsort(s)
            s = s[order]
            first = _firsts(s)
            n = np.diff(np.append(first, len(s)))
            base = min(places)
            owner = np.repeat(np.array(places) - base, [len(x) for x in held])[order[first]]
            s = s[first]
            at = _cuts(s, parts)
            some = np.flatnonzero(np.diff(at))
            cut = [slice(at[p], at[p + 1]) for p in some]
            columns = [some, [file] * len(some), [base] * len(some), [_planes(s[c]) for c in cut], [_packed(n[c]) for c in cut], [_packed(owner[c]) for c in cut]]
            return pa.RecordBatch.from_arrays([pa.array(x, type=f.type) for x, f in zip(columns, schema, strict=True)], schema=schema)

        for batch in batches:
            texts, files, at_rows = (c.to_pylist() for c in batch.columns)
            words, at = word_hashes(texts)
            for i, (f, row) in enumerate(zip(files, at_rows, strict=True)):
                if size and (size >= CHUNK or f != file):
                    yield chunk()
                    held, places, size = [], [], 0
                file = f
                held.append(shingles_of(words[at[i] : at[i + 1]])[0])
                places.append(row)
                size += len(held[-1])
        if size:
            yield chunk()

    def count(group: pa.Table) -> pa.Table:
        shingles = [_hashes(x) for x in group["shingles"].to_pylist()]
        sizes = [len(x) for x in shingles]
        n, owner = (np.concatenate([_numbers(x, k) for x, k in zip(group[c].to_pylist(), sizes, strict=True)]) for c in ("n", "owner"))
        s = np.concatenate(shingles)
        order = np.argsort(s)
        s = s[order]
        first = _firsts(s)
        df = np.add.reduceat(n[order], first)
        alone = order[first[df == 1]]
        rows, of_rows = np.unique((np.repeat(np.arange(len(sizes)), sizes)[alone] << 40) | owner[alone], return_counts=True)
        at = np.searchsorted(rows >> 40, np.arange(len(sizes) + 1))
        some = [k for k in range(len(sizes)) if at[k] < at[k + 1]]
        files, bases = group["file"].to_pylist(), group["base"].to_pylist()
        known = df > 1
        return pa.table({
            "part": pa.array([None] * len(some) + [group["part"][0].as_py()], pa.int32()),
            "file": pa.array([files[k] for k in some] + [None], pa.string()),
            "base": pa.array([bases[k] for k in some] + [None], pa.int64()),
            "at": pa.array([_packed(rows[at[k] : at[k + 1]] & ((1 << 40) - 1)) for k in some] + [_planes(s[first][known])], pa.binary()),
            "n": pa.array([_packed(of_rows[at[k] : at[k + 1]]) for k in some] + [_packed(df[known])], pa.binary()),
            "of": pa.array([int(at[k + 1] - at[k]) for k in some] + [int(known.sum())], pa.int64()),
            "pairs": pa.array([0] * len(some) + [int(n.sum())], pa.int64()),
        })

    asked = rows.mapInArrow(ask, "part int, file string, base long, shingles binary, n binary, owner binary")
    return asked.groupBy("part").applyInArrow(count, "part int, file string, base long, at binary, n binary, of long, pairs long")


def _open(unique: DataFrame, counted: DataFrame, idf: Exact, similar: float) -> DataFrame:
    """d, chars, tf and the place of a row of each text that may be similar to another one.

    Shingles that no other document has weigh ``idf.of(1)`` each or more, and add to no minimum; the rest of a text weighs ``idf.of(2)`` each at most. So if
    the rest is less than ``similar`` of both, no link is possible. Rows of one text share their shingles: none is theirs alone.
    """

    def add(group: pa.Table) -> pa.Table:
        of = group["of"].to_pylist()
        at, n = (np.concatenate([_numbers(x, k) for x, k in zip(group[c].to_pylist(), of, strict=True)]) for c in ("at", "n"))
        rows, which = np.unique(at, return_inverse=True)
        return pa.table({"_known_file": pa.array([group["file"][0].as_py()] * len(rows), pa.string()), "_known_row": pa.array(rows + group["base"][0].as_py()), "alone": pa.array(np.bincount(which, n).astype(np.int64))})

    alone = counted.filter("file IS NOT NULL").groupBy("file", "base").applyInArrow(add, "_known_file string, _known_row long, alone long")
    texts = unique.filter("tf > 0").select("d", "chars", "tf", F.col("head._file").alias("_known_file"), F.col("head._row").alias("_known_row"))
    own, shared = (float(x) for x in idf.of(np.array([1, 2])))
    n = F.coalesce("alone", F.lit(0))
    rest = (F.col("tf") - n) * shared
    return texts.join(alone, ["_known_file", "_known_row"], "left").filter(rest >= (similar - CLOSE) * (rest + n * own)).drop("alone")


def _bands(vectors: list) -> list:
    """The band keys of each text; none for one without a shingle."""
    bands: list = [[] for _ in vectors]
    held: list[int] = []

    def flush() -> None:
        if held:
            sizes = np.array([len(vectors[i][0]) for i in held])
            got = samples(np.concatenate([vectors[i][0] for i in held]), np.concatenate([vectors[i][1] for i in held]), np.cumsum(sizes) - sizes)
            keys = np.full((len(held), BANDS), 0, np.uint64)
            for b in range(BANDS):
                key = np.full(len(held), b + 1, np.uint64)
                for row in range(ROWS):
                    key = mix(key * _C1 + got[:, b * ROWS + row])
                keys[:, b] = key
            for j, i in enumerate(held):
                bands[i] = keys[j].view(np.int64)
            held.clear()

    n = 0
    for i, v in enumerate(vectors):
        if len(v[0]):
            held.append(i)
            n += len(v[0])
            if n > 1 << 15:
                flush()
                n = 0
    flush()
    return bands


def _signed(texts: DataFrame, counted: DataFrame, parts: int, idf) -> DataFrame:
    """d, chars, bands, df (of each shingle, ascending by shingle) and text of each text; ``texts`` has c, its chunk."""

    def distinct(group: pa.Table) -> tuple[list[np.ndarray], np.ndarray]:
        words, at = word_hashes(group["text"].to_pylist())
        each = [shingles_of(words[at[i] : at[i + 1]]) for i in range(len(at) - 1)]
        return each, np.unique(np.concatenate([s for s, _ in each]))

    def ask(group: pa.Table) -> pa.Table:
        s = distinct(group)[1]
        at = _cuts(s, parts)
        some = np.flatnonzero(np.diff(at))
        return pa.table({"part": pa.array(some, pa.int32()), "c": pa.array([group["c"][0].as_py()] * len(some), pa.int32()), "shingles": pa.array([_planes(s[at[p] : at[p + 1]]) for p in some], pa.binary())})

    def answer(asked: pa.Table, table: pa.Table) -> pa.Table:
        """The df of the shingles that each chunk asks for, in their order."""
        out = []
        if len(asked):
            known = _hashes(table["at"][0].as_py())
            df = _numbers(table["n"][0].as_py(), len(known))
            for s in map(_hashes, asked["shingles"].to_pylist()):
                n = np.ones(len(s), np.int64)
                if len(known):
                    to = np.minimum(np.searchsorted(known, s), len(known) - 1)
                    same = known[to] == s
                    n[same] = df[to[same]]
                out.append(_packed(n))
        return pa.table({"c": asked["c"] if len(asked) else pa.array([], pa.int32()), "part": asked["part"] if len(asked) else pa.array([], pa.int32()), "of": pa.array([len(x) // 8 for x in asked["shingles"].to_pylist()] if len(asked) else [], pa.int64()), "n": pa.array(out, pa.binary())})

    def sign(mine: pa.Table, answers: pa.Table) -> pa.Table:
        each, s = distinct(mine)
        answers = answers.sort_by("part")
        df = np.concatenate([_numbers(x, k) for x, k in zip(answers["n"].to_pylist(), answers["of"].to_pylist(), strict=True)])
        if len(df) != len(s):
            raise ValueError("a part has not answered")
        dfs = [df[np.searchsorted(s, x)] for x, _ in each]
        vectors = [(x, tf * idf.value.of(n)) for (x, tf), n in zip(each, dfs, strict=True)]
        return pa.table({
            "d": mine["d"].cast(pa.binary()), "chars": mine["chars"].cast(pa.int64()), "bands": pa.array(_bands(vectors), pa.list_(pa.int64())),
            "df": pa.array([_packed(n) for n in dfs], pa.binary()), "text": mine["text"].cast(pa.string()),
        })

    table = counted.filter("part IS NOT NULL").select("part", "at", "n")
    asked = texts.select("c", "text").groupBy("c").applyInArrow(ask, "part int, c int, shingles binary")
    answers = asked.groupBy("part").cogroup(table.groupBy("part")).applyInArrow(answer, "c int, part int, of long, n binary")
    return texts.groupBy("c").cogroup(answers.groupBy("c")).applyInArrow(sign, "d binary, chars long, bands array<long>, df binary, text string")


def _with_texts(rows: DataFrame, texts: DataFrame) -> DataFrame:
    return rows.join(texts.select("d", "text", *[c for c in texts.columns if c == "df"]).hint("merge"), "d")


def _parts(n: Column, chars: Column) -> Column:
    return F.greatest(F.ceil(n / BLOCK_ROWS), F.ceil(chars / BLOCK_CHARS), F.lit(1)).cast("int")


def _led(unique: DataFrame, total: int) -> DataFrame:
    """band, d, chars, n, bucket_chars, a: each text's buckets of two or more texts, their size, and their leader ``a``."""
    banded = unique.select("d", "chars", F.explode("bands").alias("band"))
    sizes = written(banded.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.sum("chars").alias("bucket_chars")).filter("n > 1"), "bucket-sizes")
    # How central a text is: the sizes of all its buckets, of which it has BANDS at most. A bucket's leader is its most central text.
    own = joined(banded, sizes, "band", "n", total).groupBy("d").agg(F.sum("n").alias("score"), F.first("chars").alias("chars"), F.collect_list(F.struct("band", "n", "bucket_chars")).alias("b"))
    buckets = written(own.select("d", "chars", "score", F.inline("b")), "buckets")
    lead = buckets.groupBy("band").agg(F.max(F.struct("score", F.xxhash64("d").alias("h"), "d")).alias("l"), F.max("n").alias("n")).select("band", F.col("l.d").alias("a"), F.col("n").alias("_n"))
    out = written(joined(buckets, written(lead, "leaders"), "band", "_n", total).drop("_n", "score"), "led")
    dropped(sizes, buckets)
    return out


def _star_links(led: DataFrame, texts: DataFrame, idf, similar: float) -> DataFrame:
    """a, b: leaders and the texts of their buckets that are similar to them."""
    members = led.filter("a != d").groupBy("a", "d").agg(F.max(_parts(F.col("n"), F.col("bucket_chars"))).alias("parts"))
    members = members.select("a", F.pmod(F.xxhash64("d"), "parts").cast("int").alias("part"), "d")
    # Each unit has its leader's text once.
    asked = written(members, "members")
    rows = asked.unionByName(asked.select("a", "part").distinct().withColumn("d", F.col("a")))

    def run(group: pa.Table) -> pa.Table:
        d, a = group["d"].to_pylist(), group["a"][0].as_py()
        vectors = _group_vectors(group, idf.value)
        lead = vectors[d.index(a)]
        found = [x for x, v in zip(d, vectors, strict=True) if x != a and similarity(lead, v) >= similar - CLOSE]
        return pa.table({"a": pa.array([a] * len(found), pa.binary()), "b": pa.array(found, pa.binary())})

    return _with_texts(rows, texts).groupBy("a", "part").applyInArrow(run, "a binary, b binary")


def block_links(vectors: list, comps: np.ndarray, asks: np.ndarray, member: np.ndarray, apart: np.ndarray, similar: float) -> list[tuple[int, int]]:
    """Links that join the components of a block's texts, each asking text (``asks``) compared with each ``member`` not in its component.

    Of two texts that are both ``apart`` (outside the bucket's largest component) the first asks. ``comps`` is changed as components join.
    """
    held = np.flatnonzero(member)
    sizes = np.array([len(vectors[i][0]) for i in held])
    at = np.repeat(np.arange(len(held)), sizes)
    shingles, weights = (np.concatenate([vectors[i][k] for i in held]) for k in (0, 1))
    order = np.argsort(shingles, kind="stable")
    shingles, weights, at = shingles[order], weights[order], at[order]
    totals = np.array([vectors[i][1].sum() for i in held])
    links = []
    for u in np.flatnonzero(asks):
        open_ = (comps[held] != comps[u]) & (~apart[held] | (held > u))
        if not open_.any():
            continue
        h, w = vectors[u]
        lo, n = np.searchsorted(shingles, h), np.searchsorted(shingles, h, "right")
        n -= lo
        found = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())
        shared = np.bincount(at[found], np.minimum(weights[found], np.repeat(w, n)), len(held))
        # The verdict is similarity()'s.
        for k in np.flatnonzero(open_ & (shared >= (similar - 1e-6) * (w.sum() + totals - shared))):
            v = held[k]
            if comps[v] != comps[u] and similarity(vectors[u], vectors[v]) >= similar - CLOSE:
                links.append((int(u), int(v)))
                comps[comps == comps[v]] = comps[u]
    return links


def components(edges: DataFrame) -> DataFrame:
    """node and root, the least node of its component, of an edge table (a, b): label propagation with pointer jumping."""
    both = written(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    labels = written(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("root")), "labels")
    while True:
        heard = both.join(labels.select(F.col("node").alias("b"), "root"), "b").groupBy("a").agg(F.min("root").alias("heard"))
        near = labels.join(heard, labels.node == heard.a).select("node", F.col("root").alias("old"), F.least("root", "heard").alias("root"))
        jump = labels.select(F.col("node").alias("_n"), F.col("root").alias("_r"))
        seen = Observation()
        new = near.join(jump, F.col("root") == F.col("_n")).select("node", "old", F.least("root", "_r").alias("root")).observe(seen, F.count_if(F.col("old") != F.col("root")).alias("changed"))
        before, labels = labels, written(new.select("node", "root"), "labels")
        dropped(before)
        if not seen.get.get("changed"):
            dropped(both)
            return labels


def _components_of(here: DataFrame, labels: DataFrame | None) -> DataFrame:
    """``here`` with c, the component of each d."""
    if labels is None:
        return here.withColumn("c", F.col("d"))
    return here.join(labels.select(F.col("node").alias("d"), "root"), "d", "left").withColumn("c", F.coalesce("root", "d")).drop("root")


def _blocks(led: DataFrame, labels: DataFrame | None, total: int) -> DataFrame:
    """band, i, j, d, c, asks, member, apart: which texts of a bucket meet in which pair of blocks, so that all pairs that are left do.

    The leader has been compared with all and is left out.
    """
    here = written(_components_of(led.filter("a != d").select("band", "d", "chars"), labels), "bucket-members")
    sums = [F.sum("n").alias("n"), F.sum("chars").alias("chars"), F.max(F.struct("n", "c", "chars")).alias("main"), F.count(F.lit(1)).alias("comps")]
    buckets = here.groupBy("band", "c").agg(F.count(F.lit(1)).alias("n"), F.sum("chars").alias("chars")).groupBy("band").agg(*sums).filter("comps > 1")
    buckets = written(buckets.select(
        "band", F.col("main.c").alias("main"), F.col("n").alias("_n"), _parts(F.col("n") - F.col("main.n"), F.col("chars") - F.col("main.chars")).alias("is"), _parts(F.col("n"), F.col("chars")).alias("js"),
    ), "open-buckets")
    rows = joined(here.select("band", "d", "c"), buckets, "band", "_n", total).withColumn("apart", F.col("c") != F.col("main"))
    rows = rows.withColumns({"my_i": F.pmod(F.xxhash64("d", F.lit(1)), "is").cast("int"), "my_j": F.pmod(F.xxhash64("d", F.lit(2)), "js").cast("int")})
    as_member = F.transform(F.sequence(F.lit(0), F.col("is") - 1), lambda i: F.struct(i.alias("i"), F.col("my_j").alias("j"), (F.col("apart") & (i == F.col("my_i"))).alias("asks"), F.lit(True).alias("member")))
    as_asking = F.transform(F.sequence(F.lit(0), F.col("js") - 1), lambda j: F.struct(F.col("my_i").alias("i"), j.alias("j"), F.lit(True).alias("asks"), F.lit(False).alias("member")))
    as_asking = F.filter(as_asking, lambda x: F.col("apart") & (x["j"] != F.col("my_j")))
    return rows.select("band", "d", "c", "apart", F.explode(F.concat(as_member, as_asking)).alias("x")).select("band", "x.i", "x.j", "d", "c", "x.asks", "x.member", "apart")


def _block_links(blocks: DataFrame, texts: DataFrame, idf, similar: float) -> DataFrame:
    """a, b: the links that join components, and those components, from every pair of blocks."""

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by("d")
        d, c = group["d"].to_pylist(), group["c"].to_pylist()
        asks, member, apart = (group[k].to_numpy() for k in ("asks", "member", "apart"))
        numbers = {x: i for i, x in enumerate(dict.fromkeys(c))}
        comps = np.array([numbers[x] for x in c])
        links = []
        if asks.any() and member.any() and len(numbers) > 1:
            links = block_links(_group_vectors(group, idf.value), comps, asks, member, apart, similar)
        return pa.table({"a": pa.array([c[u] for u, _ in links], pa.binary()), "b": pa.array([c[v] for _, v in links], pa.binary())})

    return _with_texts(blocks, texts).groupBy("band", "i", "j").applyInArrow(run, "a binary, b binary")


def _linked(led: DataFrame, texts: DataFrame, idf, similar: float, total: int) -> DataFrame | None:
    """node and root of every text whose component, after both rounds, has another text; None if no two are linked."""
    stars = written(_star_links(led, texts, idf, similar), "star-links")
    labels = components(stars) if stars.limit(1).count() else None
    met = written(_block_links(_blocks(led, labels, total), texts, idf, similar).distinct(), "block-links")
    if not met.limit(1).count():
        return labels
    roots = components(met)  # of the components of the first round
    if labels is None:
        return roots
    old = labels.join(roots.select(F.col("node").alias("root"), F.col("root").alias("last")), "root", "left").select("node", F.coalesce("last", "root").alias("root"))
    return old.unionByName(roots.join(labels.select("node"), "node", "left_anti"))


def near_duplicates(docs: DataFrame, similar: float = SIMILAR, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, class_id (the class's least doc_id), class_size, kept, _file, _row.

    A class is a component of links of weighted Jaccard similarity ``similar`` or more; equal word sequences are linked, texts without
    a word among themselves too. The row with the least id of a class is kept (a null id comes last, repeated rows tie by place). Null text
    counts as empty; an empty table gives no rows; other columns are not looked at.
    """
    spark = docs.sparkSession
    arrow(spark)
    docs = at_rest(docs)
    digests = written(_digested(docs, id_col, text_col), "digests")
    head = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "_file", "_row")).alias("head")
    unique = written(digests.groupBy("d").agg(F.first("tf").alias("tf"), F.max("chars").alias("chars"), head, F.count(F.lit(1)).alias("copies")), "unique-texts")
    n = unique.count()
    total, pairs = digests.agg(F.count(F.lit(1)), F.coalesce(F.sum("tf"), F.lit(0))).first()
    parts = max(PARTS, -(-pairs // CHUNK))
    counted = written(_counted(located(docs, {"text": F.col(text_col)}), parts), "shingles")
    exact = Exact(total, max(1, -(-(counted.agg(F.sum("pairs")).first()[0] or 0) // KNOWN)))
    idf = spark.sparkContext.broadcast(exact)
    known = written(_open(unique, counted, exact, similar), "candidates")
    open_texts, pairs = known.agg(F.count(F.lit(1)), F.coalesce(F.sum("tf"), F.lit(0))).first()
    at = (F.col("_file") == F.col("_known_file")) & (F.col("_row") == F.col("_known_row"))
    rows = located(docs, {"text": F.col(text_col)}).join(small_side(known, open_texts), at)
    chunked = written(rows.select("d", "chars", "text", F.pmod(F.xxhash64("d"), F.lit(max(PARTS, -(-pairs // CHUNK)))).cast("int").alias("c")), "open-texts")
    signed = written(_signed(chunked, counted, parts, idf), "signatures")
    dropped(counted, known, chunked)
    led = _led(signed.select("d", "chars", "bands"), open_texts * BANDS)
    met = written(led.select("d").distinct(), "met")
    texts = written(signed.select("d", "text", "df").join(small_side(met, met.count()), "d", "left_semi"), "candidate-texts")
    dropped(met, signed)
    labels = _linked(led, texts, idf, similar, open_texts * BANDS)
    moved = _components_of(unique.select("d", "head", "copies"), labels)
    classes = moved.groupBy("c").agg(F.min("head").alias("head"), F.sum("copies").alias("class_size"), F.count(F.lit(1)).alias("texts")).filter("class_size > 1")
    named = written(joined(moved.select("d", "copies", "c"), written(classes, "classes"), "c", "texts", n).select("d", "copies", "head", "class_size"), "named")
    dropped(texts, led)
    slim = digests.select("id", "_file", "_row", "d")
    out = slim.join(F.broadcast(named), "d", "left") if named.count() <= MAX_BROADCAST_KEYS else joined(slim, named, "d", "copies", total, "left")
    own = (F.col("_file") == F.col("head._file")) & (F.col("_row") == F.col("head._row"))
    return out.select(
        F.col("id").alias(id_col), F.when(F.col("head").isNull(), F.col("id")).otherwise(F.col("head.id")).alias("class_id"), F.coalesce("class_size", F.lit(1)).cast("long").alias("class_size"),
        F.coalesce(own, F.lit(True)).alias("kept"), "_file", "_row",
    )
