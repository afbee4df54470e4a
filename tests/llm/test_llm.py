"""The training-data operators against brute force, exact round trips and held-out accuracy, and their edge cases."""

import base64
import hashlib
import math
import random
import re
import struct
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from asclepia.llm import _base, bpe_codec, exact_dedup, language_id, media_mpeg, mixing, near_dup, quality, token_counts, token_store, warc
from asclepia.llm._hashing import word_hashes
from asclepia.llm._tokenizers import encode_texts, tokenizer

SF = "/root/testdata/sf0.001"
#: Nulls, empties, ties, repeated rows, odd characters, and columns whose names the operators use inside.
ROWS = [
    (1, "Hello World again and Again", "s1", "en"), (2, "hello world again and again", "s1", "en"), (3, None, "s1", None), (4, "", None, "en"), (None, "null id", None, None), (6, "É é", "s2", "fr"), (7, "é é", "s2", "fr"),
    (8, "x", "s3", "de"), (8, "x", "s3", "de"), (9, " \t\n ", "", "en"), (10, "one two three four five six seven " * 3, "s1", "en"), (11, "<|endoftext|> a\x00b \x1c c", "s2", None),
]
EDGE = "doc_id long, text string, source string, lang string"
CLASH = lambda: {"id": F.lit(1), "size": F.lit("s"), "place": F.lit(0), "d": F.lit("d"), "n": F.lit(2), "kept": F.lit(False), "taken": F.lit(1), "p": F.lit(1), "block": F.lit(1), "good": F.lit(True), "content": F.lit("c"), "band": F.lit(1)}


@pytest.fixture(scope="module")
def edge(spark):
    return spark.createDataFrame(ROWS, EDGE).withColumns(CLASH())


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], EDGE)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


# 1. Exact dedup.


def dedup_reference(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""), []).append(i)
    return sorted((str(i), str(max((x for x in g if x is not None), default=None)), len(g), hashlib.sha256(t.encode()).hexdigest()) for t, g in groups.items() for i in g)


@pytest.mark.parametrize("key_bytes", [32, 1])
def test_dedup(spark, edge, empty, docs, key_bytes):
    for df in (edge, docs):
        got = exact_dedup.exact_dedup(df, key_bytes=key_bytes, files_per_trigger=1).collect()
        assert sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.text_sha256) for r in got) == dedup_reference([(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()])
        assert Counter(r.text_sha256 for r in got if r.kept) == Counter({r.text_sha256 for r in got})
        assert all(r.doc_id == r.keep_id for r in got if r.kept)
    assert exact_dedup.exact_dedup(empty).count() == 0


def test_dedup_state_remembers(spark, tmp_path):
    state = exact_dedup.DedupState(spark, str(tmp_path))
    event = lambda *rows: spark.createDataFrame([(bytearray(d), i, "f", i) for d, i in rows], "digest binary, id long, _file string, _row long")
    state.add(event((b"a", 1), (b"b", 2)))
    state.add(event((b"a", 5), (b"a", 3)))
    assert {bytes(r.digest): (r.n, r.head.id) for r in state.groups().collect()} == {b"a": (3, 5), b"b": (1, 2)}


def test_dedup_keeps_columns(edge):
    kept = exact_dedup.kept_documents(edge)
    assert kept.columns == edge.columns and kept.count() == 9


# 2. Mixing.


def targets(sizes):
    order = sorted(s for s in sizes if s is not None) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total, target, open_ = sum(sizes.values()), {}, set(order)
    target = {s: total * weight[s] / sum(weight.values()) for s in order}
    while over := [s for s in open_ if target[s] > 3 * sizes[s] + 1e-9]:
        spare = sum(target[s] - 3 * sizes[s] for s in over)
        open_ -= set(over)
        for s in over:
            target[s] = 3 * sizes[s]
        for s in open_:
            target[s] += spare * weight[s] / sum(weight[x] for x in open_)
    return target


def test_mixing(edge, docs, empty):
    for df in (edge, docs):
        got, rows = mixing.mix(df).collect(), df.select("doc_id", "text", "source").collect()
        size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
        assert sorted((str(r.doc_id), r.size) for r in got) == sorted((str(r.doc_id), size(r.text)) for r in rows)
        sizes = Counter()
        for r in rows:
            sizes[r.source] += size(r.text)
        want = targets(dict(sizes))
        assert sorted({round(r.target, 6) for r in got}) == sorted({round(t, 6) for t in want.values()})
        assert all(r.taken <= 3 * r.size and r.taken == r.copies * r.size for r in got)
        assert all(r.copies in (int(r.target / r.source_size), int(r.target / r.source_size) + 1) for r in got if r.size)
    source = {r.doc_id: r.source for r in docs.collect()}
    taken, target, largest = Counter(), {}, Counter()
    out = mixing.mix(docs).collect()
    for r in out:
        taken[source[r.doc_id]] += r.taken
        target[source[r.doc_id]] = r.target
        largest[source[r.doc_id]] = max(largest[source[r.doc_id]], r.size)
    assert all(abs(taken[s] - target[s]) <= largest[s] / 2 + 1 for s in target)
    again = mixing.mix(docs.repartition(3)).collect()
    assert len(again) == len(out) and mixing.mix(empty).count() == 0
    assert sorted((r.doc_id, r.taken) for r in mixing.mix(docs).collect()) == sorted((r.doc_id, r.taken) for r in out)


@pytest.mark.parametrize("n", [0, 1, 2, 7, 3_000])
def test_targets_of_many_sources(spark, n):
    """Order by code point, null last, and the fixed point of shares and caps, in many ranges."""
    rnd = random.Random(n)
    sizes = {rnd.choice(["", "Z", "a", "é", "\U0001f600", "\uffee"]) + str(i): rnd.choice([0, 1, 50, rnd.randrange(10_000), 10**9]) for i in range(n)} | ({None: 77} if n > 2 else {})
    frame = spark.createDataFrame([*sizes.items()], "source string, source_size long").repartition(5)
    got = {r.source: r.target for r in mixing.targets(frame).collect()}
    want = targets(sizes) if sizes else {}
    assert got.keys() == want.keys() and all(abs(got[s] - want[s]) <= 1e-6 * (1 + want[s]) for s in want)


def test_mixing_many_blocks(spark):
    df = spark.range(40_000).select(F.col("id").alias("doc_id"), F.expr("repeat('w ', cast(id % 7 + 1 as int))").alias("text"), F.when(F.col("id") % 3 == 0, "hot").otherwise("cold").alias("source"))
    got = mixing.mix(df).groupBy((F.col("doc_id") % 3 == 0).alias("hot")).agg(F.sum("taken").alias("taken"), F.first("target").alias("target")).collect()
    assert all(abs(r.taken - r.target) <= 7 for r in got)
    assert mixing.mixed_documents(df).count() == mixing.mix(df).agg(F.sum("copies")).first()[0]


def test_mixing_reruns_agree(spark, docs, tmp_path):
    """Row by row, whatever the files and their order."""
    docs.repartition(5, "n_chars").write.parquet(f"{tmp_path}/docs")
    rows = lambda df: sorted((r.doc_id, r.size, r.target, r.taken) for r in mixing.mix(df).collect())
    assert rows(docs) == rows(spark.read.parquet(f"{tmp_path}/docs")) == rows(docs.orderBy(F.desc("doc_id")))


def test_mixing_repeated_rows(spark):
    """Many wholly equal rows, and rows without ids, are dealt to blocks like others."""
    df = spark.range(20_000).select(F.when(F.col("id") % 4 > 0, F.lit(1)).when(F.col("id") % 8 == 0, F.col("id")).alias("doc_id"), F.lit("a b c").alias("text"), (F.col("id") % 16 == 0).cast("string").alias("source"))
    got = mixing.mix(df).groupBy("target").agg(F.sum("taken").alias("taken"), F.count(F.lit(1)).alias("n")).collect()
    assert sorted(r.n for r in got) == [1_250, 18_750] and all(abs(r.taken - r.target) <= 3 for r in got)


def test_mixing_is_native(docs):
    plan = mixing.mix(docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


# Rows have no identity but their place, and a place counts only in a plain file scan.


def test_copies_of_rows(spark, docs):
    twice = docs.withColumn("_metadata", F.explode(F.array(F.lit(1), F.lit(2))))
    distinct = len({"".join(c.lower() if "A" <= c <= "Z" else c for c in r.text or "") for r in docs.collect()})
    assert exact_dedup.kept_documents(twice).count() == distinct
    assert exact_dedup.kept_documents(spark.read.parquet(f"{SF}/documents.parquet", f"{SF}/documents.parquet")).count() == distinct
    assert sum(r.kept for r in near_dup.near_duplicates(docs.union(docs)).collect()) == len(brute_force([(r.doc_id, r.text) for r in docs.collect()] * 2))
    got = mixing.mix(twice).groupBy("target", "source_size").agg(F.sum("taken").alias("taken"), F.max("size").alias("largest")).collect()
    assert all(abs(r.taken - r.target) <= r.largest / 2 + 1 for r in got)
    names = docs.withColumns({c: F.lit(c) for c in ("_metadata", "_file", "_row", "_at_file", "_AT_ROW", "_gone_file", "_gone_row", "_mix_file", "_mix_row", "_mix_copies", "_mix_copy", "a b.c", "`")})
    kept = exact_dedup.kept_documents(names)
    assert kept.columns == names.columns and kept.count() == distinct
    mixed = mixing.mixed_documents(names)
    assert mixed.columns == names.columns and mixed.count() == mixing.mix(docs).agg(F.sum("copies")).first()[0]


def test_cluster_needs_a_shared_folder(spark, monkeypatch):
    monkeypatch.setattr(_base, "conf", lambda *a: None)
    monkeypatch.setattr(spark.sparkContext, "master", "spark://host:7077")
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        _base.shared_dir(spark, "x")


# 3. Language.


def test_language(edge, empty, spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language_id.identified(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert held and sum(r.lang == r.lang_pred for r in held) / len(held) > 0.97
    assert all((zlib.crc32(str(r.doc_id).encode()) % 4 == 2) == r.held_out and 0 <= r.score <= 1 for r in got)
    out = language_id.identified(edge)
    assert out.count() == len(ROWS) and by_id(out)[3].lang_pred == "und" and by_id(out)[9].lang_pred == "und"
    assert language_id.identified(empty).count() == 0


def grams_reference(text):
    out = Counter()
    for word in re.findall(r"[^\W\d_]+", (text or "").lower()):
        w = [1, *map(ord, word), 1]
        for i in range(len(w)):
            out.update([w[i]] * (w[i] != 1))
            out.update([w[i] << 21 | w[i + 1]] if i + 1 < len(w) else [])
            out.update([w[i] << 42 | w[i + 1] << 21 | w[i + 2]] if i + 2 < len(w) else [])
    return out


def grams_of(text):
    return dict(zip(*(x.tolist() for x in language_id.count_grams(text)), strict=True))


def test_language_grams_by_brute_force(monkeypatch):
    texts = ["Über den Fluß, l'été ... 123 straße\n" * 9, "", " 12 ", "x", "wordwithoutend" * 40, "ΑΣ ΣΑΣ'Σ" * 9, "ΑΣΑΣ" * 30, " a", "a ", "ab1cd", None]
    for piece in (1 << 20, 20, 7, 1):
        monkeypatch.setattr(language_id, "PIECE", piece)
        for text in texts:
            assert grams_of(text) == dict(grams_reference(text)), (piece, text)


def test_language_distance_by_brute_force(spark):
    """Profiles, distances, ties and scores in plain Python, on more languages than a thousand."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang").collect()
    more = [(10_000 + k, " ".join(f"{chr(97 + k % 26)}{chr(97 + k // 26 % 26)}{x}" for x in ("ba", "ro", "ti")), f"x{k:04}") for k in range(1_100)]
    rows = [tuple(r) for r in docs] + more + [(20_000, "aa bb", "tie2"), (20_001, "aa bb", "tie1"), (20_002, "aa bb", None)]
    got = {r.doc_id: r for r in language_id.identified(spark.createDataFrame(rows, "doc_id long, text string, lang string"), top=50).collect()}
    learned = {}
    for i, text, lang in rows:
        if text is not None and lang is not None and zlib.crc32(str(i).encode()) % 4 != 2:
            learned.setdefault(lang, Counter()).update(grams_reference(text))
    rank = lambda c: [g for g, _ in sorted(c.items(), key=lambda x: (-x[1], x[0]))[:50]]
    places = {lang: {g: k for k, g in enumerate(rank(c))} for lang, c in learned.items()}
    assert len(places) > 800
    for i, text, _ in rows[:60] + rows[-23:]:
        own = rank(grams_reference(text))
        far = {lang: sum(abs(p[g] - k) if g in p else 50 for k, g in enumerate(own)) for lang, p in places.items()}
        best = min(far.items(), key=lambda x: (x[1], x[0])) if own else ("und", 0)
        assert got[i].lang_pred == best[0]
        assert abs(got[i].score - (1 - best[1] / (50 * len(own)) if own else 0)) < 1e-12


# 4. Token files.


def test_token_store(edge, docs, empty):
    for df in (edge, docs):
        got = token_store.stored_tokens(df, with_ids=True).orderBy("start").collect()
        rows = sorted(((r.doc_id, r.text or "") for r in df.select("doc_id", "text").collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        start = 0
        for g, (i, t) in zip(got, rows, strict=True):
            ids = [*tokenizer("byte_bpe_50k.json").encode(t, add_special_tokens=False).ids, 0]
            assert (g.doc_id, g.start, g.n_tokens, g.ids, g.ids_crc32) == (i, start, len(ids), ids, zlib.crc32(np.array(ids, "<u4").tobytes()))
            start += len(ids)
    assert token_store.stored_tokens(empty).count() == 0


@pytest.mark.parametrize("bits", [1, 7, 8, 16, 17, 31])
def test_packing(bits):
    ids = np.random.default_rng(bits).integers(0, 1 << bits, 70_001).astype(np.uint32)
    assert (token_store.unpack(token_store.pack(ids, bits), len(ids), bits) == ids).all()
    with pytest.raises(ValueError):
        token_store.pack(np.array([1 << bits], np.uint64), bits)


def test_random_access(tmp_path):
    rng = np.random.default_rng(0)
    texts = [rng.integers(0, 1 << 17, n).astype(np.uint32) for n in (0, 5, 200_000, 1, 70_000)]
    w = token_store.ShardWriter(str(tmp_path), "x.tok", 17)
    for i, t in enumerate(texts):
        w.add(i if i != 3 else None, t)
    w.close()
    s = token_store.Shard(w.uri)
    assert s.doc_ids == [0, 1, 2, None, 4] and all((s.document(k) == t).all() for k, t in enumerate(texts))
    flat = np.concatenate(texts)
    assert (s.ids(65_530, 131_080) == flat[65_530:131_080]).all()
    assert [len(x[2]) for x in s.documents(batch_ids=10)] == [len(t) for t in texts]
    (tmp_path / "bad.tok").write_bytes(b"\0" * 100)
    with pytest.raises(ValueError):
        token_store.Shard(f"{tmp_path}/bad.tok")


def random_texts(n, seed=3):
    rnd = random.Random(seed)
    alphabet = ["a", "the", " ", "  ", "\n", " \n", "'s", "é", "ß", "中", "12", "!", "<|endoftext|>", "\0", "\x1c", "\xa0", " ", "é", "İ", "👍🏽", "_", "\x85", "　"]
    return ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 30))) for _ in range(n)]


def test_chunked_encoding():
    texts = [*random_texts(3000), None, "", " ", "\0", " \0 \0", "\0a b"]
    want = [e.ids for e in tokenizer("byte_bpe_50k.json").encode_batch([t or "" for t in texts], add_special_tokens=False)]
    assert [x.tolist() for x in encode_texts("byte_bpe_50k.json", pa.array(texts))] == want


@pytest.mark.parametrize("most,most_chars", [(30, 1 << 20), (1 << 20, 60)])
def test_chunk_memory_is_bounded(most, most_chars):
    from asclepia.llm._tokenizers import Chunks

    chunks = Chunks(lambda cs: (np.array([ord(x) for c in cs for x in c], np.uint32), np.array([len(c) for c in cs])), most=most, most_chars=most_chars)
    for k in range(20):
        words = [f"w{(k * 7 + i) % 60}" for i in range(25)] + ["x" * 100]
        n = chunks.numbers(words)
        assert chunks.values(n).tolist() == [ord(x) for w in words for x in w]
        chunks.trim()
        assert len(chunks) <= most and chunks.chars <= most_chars == sum(map(len, chunks)) or chunks.chars == sum(map(len, chunks)) <= most_chars
    assert len(chunks) > 0


@pytest.mark.parametrize("most,most_chars", [(30, 1 << 20), (1 << 20, 60)])
def test_known_chunks_are_bounded(most, most_chars):
    from asclepia.llm._tokenizers import KnownChunks, spread

    known = KnownChunks(lambda cs: (np.array([ord(x) for c in cs for x in c], np.uint32), np.array([len(c) for c in cs])), most, most_chars)
    for k in range(20):
        words = list(dict.fromkeys(["often", *[f"w{(k * 7 + i) % 60}" for i in range(25)], "x" * 100, ""]))
        n = known.numbers(pa.array(words), np.array([9, *[1] * (len(words) - 1)]))
        starts = known.starts.all
        assert spread(known.flat.all, starts[n], np.diff(starts)[n]).tolist() == [ord(x) for w in words for x in w]
        known.trim()
        assert len(known.chunks) <= most and len("".join(known.chunks.to_pylist())) <= most_chars
    assert "often" in known.chunks.to_pylist()


def test_long_texts_to_ids():
    rnd = random.Random(4)
    texts = ["x" * 300_000, "ab " * 100_000, "\n" * 50_000 + "a", " " * 30_000, "".join(rnd.choice(["a", " ", "é", "中", "\0"]) for _ in range(100_000)), None]
    want = [e.ids for e in tokenizer("byte_bpe_50k.json").encode_batch([t or "" for t in texts], add_special_tokens=False)]
    assert [x.tolist() for x in encode_texts("byte_bpe_50k.json", pa.array(texts))] == want and encode_texts("byte_bpe_50k.json", pa.array([], pa.string())) == []


# 5. WARC.


@pytest.mark.parametrize("hot", [1, 1_000])
def test_warc(spark, tmp_path, monkeypatch, hot):
    monkeypatch.setattr(_base, "LUKEWARM", hot)
    rows = [(3, "u3", "<p>é</p>"), (1, "u1", "<p>é</p>"), (2, "u\r\n2", None), (5, None, ""), (None, "u", "<p>é</p>"), (7, "u7", "x" * 300_000), (7, "u7", "x" * 300_000), (9, "", "WARC-Type: x\r\n\r\nWARC/1.1\r\n"), (10, " ü ", "\0")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit(1) for c in ("key", "payload", "records", "id", "date", "bytes")})
    warc.write_archive(pages, str(tmp_path), date=F.when(F.col("page_id") > 2, F.lit("2020-02-03T04:05:06Z")))
    got = warc.read_archive(spark, str(tmp_path)).withColumn("record", warc.record_bytes()).collect()
    assert sorted((str(r.page_id), str(r.url)) for r in got) == sorted((str(i), str(u)) for i, u, _ in rows)
    for r in got:
        body = next((h or "").encode() for i, _, h in rows if i == r.page_id)
        assert bytes(r.payload) == body and r.payload_bytes == len(body)
        assert r.payload_digest == base64.b32encode(hashlib.sha1(body).digest()).decode()
        record = bytes(r.record)
        assert record.startswith(bytes(r.header))
        ((fields, block),) = warc.records_of(record)
        assert {"WARC-Type", "WARC-Record-ID", "WARC-Date", "WARC-Target-URI", "Content-Length"} <= fields.keys()
        assert fields["WARC-Date"] == ("2020-02-03T04:05:06Z" if (r.page_id or 0) > 2 else warc.DATE)
        http, _, payload = block.partition(b"\r\n\r\n")
        assert http.startswith(b"HTTP/1.1 200 OK") and payload == (b"" if r.record_type == "revisit" else body)
    named = {warc_id(r): r.page_id for r in got}
    assert all(named[dict(f for f in header_fields(r))["WARC-Refers-To"]] == r.refers_to for r in got if r.record_type == "revisit")
    kinds = {(r.page_id, r.record_type, r.refers_to) for r in got}
    assert kinds == {(1, "response", None), (3, "revisit", 1), (None, "revisit", 1), (2, "response", None), (5, "revisit", 2), (7, "response", None), (9, "response", None), (10, "response", None)}
    assert spark.read.parquet(f"{tmp_path}/payloads").count() == 5
    assert all(r.record_type == "response" for r in warc.archived(pages, least=1_000_000).collect())
    assert warc.archived(pages.limit(0)).count() == 0


def header_fields(r):
    return [line.partition(": ")[::2] for line in bytes(r.header).decode().split("\r\n")]


def warc_id(r):
    return dict(header_fields(r))["WARC-Record-ID"]


@pytest.mark.parametrize("compressed", [False, True])
def test_warc_files(spark, tmp_path, compressed):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    records = warc.archived(pages).repartition(3)
    files = warc.export_warc(records, f"{tmp_path}/files", compressed).collect()
    assert sum(f.records for f in files) == pages.count() and all((tmp_path / "files" / f.path.rsplit("/", 1)[1]).stat().st_size == f.bytes for f in files)
    payloads, pages_of = {}, {}
    for f in files:
        for fields, block in warc.records_of((tmp_path / "files" / f.path.rsplit("/", 1)[1]).read_bytes()):
            pages_of[int(fields["X-Page-ID"])] = fields
            if fields["WARC-Type"] == "response":
                payloads[fields["WARC-Record-ID"]] = block.partition(b"\r\n\r\n")[2]
    for r in pages.collect():
        fields = pages_of[r.page_id]
        assert payloads[fields.get("WARC-Refers-To", fields["WARC-Record-ID"])] == (r.html or "").encode()
        assert r.url is None or fields["WARC-Target-URI"] == r.url


def test_warc_finds_damage(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "abc")], "page_id long, url string, html string")
    warc.write_archive(pages, f"{tmp_path}/a")
    store = spark.read.parquet(f"{tmp_path}/a/payloads").withColumn("payload", F.lit(b"abd"))
    store.write.parquet(f"{tmp_path}/b/payloads")
    spark.read.parquet(f"{tmp_path}/a/headers").write.parquet(f"{tmp_path}/b/headers")
    with pytest.raises(Exception, match="differs"):
        warc.read_archive(spark, f"{tmp_path}/b").collect()


# 6. Token counts.


def library_counts(text, t=None):
    """Tokens of the first 0, 1, 2, ... characters, each prefix encoded by the library."""
    return [len(e.ids) for e in (t or tokenizer("word_bpe_49k.json")).encode_batch([text[:k] for k in range(len(text) + 1)], add_special_tokens=False)]


def test_counts(edge, docs, empty):
    t = tokenizer("word_bpe_49k.json")
    for df in (edge, docs):
        rows = df.select("doc_id", "text").collect()
        got = token_counts.token_counts(df, with_prefixes=True, limit=10).collect()
        want = sorted((str(r.doc_id), len((r.text or "").encode()), len(t.encode(r.text or "", add_special_tokens=False).ids)) for r in rows)
        assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens) for r in got) == want
        assert all(r.over_limit == (r.n_tokens > 10) and token_counts.counts_of(r.prefixes)[-1] == r.n_tokens for r in got)
    assert token_counts.token_counts(empty).count() == 0


def test_every_prefix():
    """Of odd texts and of one of the corpus, the count at each prefix is the library's; each budget's answer is the longest prefix within it."""
    rnd = random.Random(3)
    alphabet = ["a", "the", "ing", "A", " ", "  ", "\n", " \n", "'s", "'", "'re", "'r", "e\u0301", "\u0301", "\u00df", "\u4e2d", "12", "!", "<|endoftext|>", "<|end", "\0", "\x1c", "\xa0", "\u2028", "\u0130", "\u03a3", "\u0391\u03a3", "\u1100", "\u1161", "\u11a8", "\u0308", "o\u0323\u0302", "\u00bd", "\ufb01", "\u200d", "\u2126", "\u01c6", "\U0001f44d\U0001f3fd", "_", "\x85", "\u3000"]
    texts = ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 14))) for _ in range(3000)]
    texts += [None, "", " ", "Hello,  WORLD's 123 thtibl\u00e9 x", "'re're're 'r don't we'll", "<|startoftext|><|endoftext|>!<|endoftext|", *random_texts(60)]
    tables, totals = token_counts.prefixes_of(pa.array(texts))
    for text, table, total in zip(texts, tables, totals, strict=True):
        counts = library_counts(text or "")
        assert token_counts.counts_of(table).tolist() == counts and total == counts[-1], text
        for budget in {0, 1, total // 2, total, total + 1}:
            assert token_counts.longest_within(table, budget) == max(k for k, n in enumerate(counts) if n <= budget)


def test_prefixes_of_long_words():
    for text in ("x" * 50_000, "\u00e9" * 20_000, "e\u0301" * 5_000, "\u4e2d" * 20_000, "!?" * 20_000, "abc" * 10_000 + " \u0130" * 3_000):
        (table,), (total,) = token_counts.prefixes_of(pa.array([text]))
        counts = token_counts.counts_of(table)
        t = tokenizer("word_bpe_49k.json")
        assert total == len(t.encode(text, add_special_tokens=False).ids) and len(counts) == len(text) + 1
        for k in (1, 31, 32, 33, 100, len(text) // 2, len(text) // 2 + 1, len(text) - 1):
            assert counts[k] == len(t.encode(text[:k], add_special_tokens=False).ids)


def test_a_word_that_the_library_counts_otherwise(monkeypatch):
    """Then the library counts each of its prefixes."""
    words = token_counts.Words("word_bpe_49k.json")
    monkeypatch.setattr(words, "_sorted_counts", lambda ws: [[99] * len(w) for w in ws])
    changes, sizes = words.learn(["hello", "thtibl"])
    assert changes.cumsum()[:5].tolist() == library_counts("hello")[1:] and sizes.tolist() == [5, 6]


def test_budget_questions(edge, docs, empty):
    """Truncation and budgets from the stored table, against the library."""
    for df in (edge, docs.filter("n_chars < 3000").limit(40)):
        stored = token_counts.written(token_counts.prefix_table(df, with_text=True), "prefixes")
        texts = Counter((str(r.doc_id), r.text or "") for r in df.select("doc_id", "text").collect())
        want = Counter()
        for (i, x), n in texts.items():
            counts = library_counts(x)
            k = max(j for j, c in enumerate(counts) if c <= 7)
            want[i, k, counts[k], x[:k]] += n
        assert Counter((str(r.doc_id), r.chars, r.n_tokens, r.text) for r in token_counts.truncated(stored, 7).collect()) == want
        for r in token_counts.fits(stored, [-1, 0, 7, 1 << 40]).collect():
            assert r.fits[0] is False and r.fits[3] is True and r.chars[0] == -1 and r.chars[2] <= r.chars[3]
        assert all(r.chars is None and r.text is None for r in token_counts.truncated(stored, -1).collect())
    assert token_counts.truncated(token_counts.prefix_table(empty, with_text=True), 3).count() == 0


# 7. Quality.


def test_quality(spark, edge, empty):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = quality.classified(docs, labels)
    judged = got.join(labels, "doc_id").collect()
    good, bad = [r for r in judged if r.quality == 1], [r for r in judged if r.quality == 0]
    assert sum(r.kept for r in good) / len(good) > 0.98 and sum(r.kept for r in bad) / len(bad) < 0.2
    again = {(r.doc_id, r.kept) for r in quality.classified(docs, labels).collect()}
    assert again == {(r.doc_id, r.kept) for r in got.collect()}
    assert quality.classified(edge, labels.limit(0)).filter("kept").count() == len(ROWS)
    assert quality.classified(empty, labels).count() == 0
    assert quality.classified(edge, spark.createDataFrame([(1, 1, 0), (1, 0, 0), (8, 0, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")).count() == len(ROWS)


def ngram_buckets(text):
    """Buckets of a text's words, punctuation runs and pairs of neighbours, in plain Python."""
    word = 0xFFFFFFFFFFFFFFFF

    def spread(h):
        h = (h ^ h >> 30) * 0xBF58476D1CE4E5B9 & word
        h = (h ^ h >> 27) * 0x94D049BB133111EB & word
        return h ^ h >> 31

    def one(w):
        return spread((sum((b + 1) * pow(0x9E3779B97F4A7C15, j, 1 << 64) for j, b in enumerate(w)) + len(w)) & word)

    ws = [one(w) for w in re.findall(rb"[0-9A-Za-z_\x80-\xff]+|[!-/:-@\[-^`{-~]+", (text or "").encode())]
    return Counter(h % quality.BUCKETS for h in [*ws, *(spread(a * 0x9FB21C651E98DF25 + b & word) for a, b in zip(ws, ws[1:]))])


def test_quality_by_brute_force(spark):
    """Both models, each weight, the threshold and what is kept."""
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    rows = {r.doc_id: r.text for r in docs.collect()}
    sample = {r._id: (r.good, r.model) for r in quality.labelled_sample(labels)[0].collect()}
    grams = {i: ngram_buckets(t) for i, t in rows.items()}
    raw, target = Counter(range(quality.BUCKETS)), Counter(range(quality.BUCKETS))
    for i, g in grams.items():
        raw.update(g)
        if sample.get(i) == (True, True):
            target.update(g)
    weight = {i: sum(n * (math.log(target[b] / target.total()) - math.log(raw[b] / raw.total())) for b, n in g.items()) for i, g in grams.items()}
    got = {r.doc_id: r for r in quality.classified(docs, labels).collect()}
    assert all(abs(got[i].log_weight - w) < 1e-6 * (1 + abs(w)) for i, w in weight.items())
    judged = [(weight[i], good) for i, (good, model) in sample.items() if not model and i in weight]
    errors = lambda cut: sum((w >= cut) != good for w, good in judged)
    cut = quality.threshold(quality.weighed(docs, labels))
    assert errors(cut) == min(map(errors, [-math.inf, math.inf, *(w + 1e-9 for w, _ in judged)]))
    k = sum(w >= cut for w in weight.values())
    assert {i for i, r in got.items() if r.kept} == set(sorted(got, key=lambda i: (-got[i].gumbel_key, i))[:k])


def test_quality_on_unseen_labels(spark):
    """Labelled documents that neither the model nor the threshold saw."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    seen = {r._id for r in quality.labelled_sample(labels, 1_500)[0].collect()}
    unseen = [r for r in quality.classified(docs, labels, most_labelled=1_500).join(labels, "doc_id").collect() if r.doc_id not in seen]
    good, bad = [r for r in unseen if r.quality == 1], [r for r in unseen if r.quality == 0]
    assert len(seen) < 1_700 and len(unseen) > 1_500
    assert sum(r.kept for r in good) / len(good) > 0.98 and sum(r.kept for r in bad) / len(bad) < 0.1


def test_threshold_counts_each_id_once(spark):
    """More rows than the sample has ids; a label that repeats doesn't move the cut."""
    rows = [(i, float(i), i >= 50) for i in range(100)] + [(10, 80.0, False)] * 500 + [(90, 1.0, True)] * 500
    scores = spark.createDataFrame([(i, w, g, "f", k) for k, (i, w, g) in enumerate(rows)], "id long, log_weight double, good boolean, _file string, _row long")
    assert 49 < quality.threshold(scores) <= 50


def test_quality_buckets():
    texts = ["a b!! c", None, "", "a b!! c", "x" * 10]
    codes, at = quality.buckets(texts)
    assert np.diff(at).tolist() == [7, 0, 0, 7, 1]
    assert sorted(codes[at[0] : at[1]]) == sorted(codes[at[3] : at[4]])


@pytest.mark.parametrize("n,k", [(50_000, 12_345), (50_000, 1), (100, 0), (100, 100), (40_000, 15_000)])
def test_largest(spark, n, k):
    ties = n == 40_000
    rows = spark.range(n).select("id", (F.lit(1.0) if ties else F.rand(1)).alias("gumbel_key"), F.lit("f").alias("_file"), F.col("id").alias("_row"))
    rows = quality.written(rows, "largest")
    got = quality.largest(rows, k).filter("taken")
    order = sorted(((-r.gumbel_key, r.id) for r in rows.collect()))[:k]
    assert sorted(r.id for r in got.collect()) == sorted(i for _, i in order)


def test_largest_among_equal_rows(spark):
    """Ties of key, id and row number: null ids first, then small ids; values too near for a range."""
    ids = [None] * 3 + [(1 << 62) + i // 4 for i in range(4_000)] + [-(1 << 63)] * 2
    rows = spark.createDataFrame([(i, 0.5, f"f{n % 7}", n // 7) for n, i in enumerate(ids)], "id long, gumbel_key double, _file string, _row long")
    order = sorted(rows.collect(), key=lambda r: (-(1 << 63) if r.id is None else r.id, r._row, r._file))
    for k in (1, 2, 4, 6, 1_237, 4_004):
        got = quality.largest(rows, k).filter("taken").collect()
        assert sorted((r._file, r._row) for r in got) == sorted((r._file, r._row) for r in order[:k])


def test_hashing_windows(monkeypatch):
    import asclepia.llm._hashing as h

    texts = ["Aa bb, cc\n" * 50, None, "x", "longrun" * 100, "aa BB cc", ""]
    one, at = word_hashes(texts, punctuation=True)
    monkeypatch.setattr(h, "WINDOW", 64)
    two, at2 = word_hashes(texts, punctuation=True)
    assert (one == two).all() and (at == at2).all()
    assert one[0] == one[at[4]] and np.diff(at).tolist() == [200, 0, 1, 1, 3, 0]


# 8. Media.


def test_media(edge, docs, empty):
    for df in (edge, docs):
        rows = {r.doc_id: (r.text or "").encode() for r in df.select("doc_id", "text").collect()}
        for r in media_mpeg.stored_media(df, with_frames=True).collect():
            raw = rows[r.doc_id]
            padded = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
            media = media_mpeg.encode(padded, len(raw))
            assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest())
            assert (r.tail_crc32, r.media_bytes, r.media_sha256) == (zlib.crc32(padded[-64:]), len(media), hashlib.sha256(media).hexdigest())
            assert "vbr=sound skipped=0" in r.feature and r.duration_num * 32000 == len(r.frame_offsets) * 1152 * r.duration_den
    assert media_mpeg.stored_media(empty).count() == 0


def test_media_damage():
    good = media_mpeg.encode(b"\xff\xfa\xe8\x00" * 5000)
    n = len(media_mpeg.parse(good).offsets)
    inserted = media_mpeg.parse(good[:5000] + b"\0junk\xff\xfa" + good[5000:])
    assert len(inserted.offsets) == n and inserted.skipped > 0
    flipped = bytearray(good)
    flipped[media_mpeg.parse(good).offsets[2] + 10] ^= 1
    assert len(media_mpeg.parse(bytes(flipped)).damaged) == 1
    tagged = media_mpeg.parse(good + b"TAG" + b"title".ljust(125, b"\0"))
    assert tagged.tags["TIT2"] == "title" and len(tagged.offsets) == n
    assert media_mpeg.parse(b"").samples == 0 and media_mpeg.parse(b"\xff" * 1000).offsets == []
    s = media_mpeg.parse(good)
    assert s.seek(0) == s.offsets[0] and s.seek(s.duration) == s.offsets[-1]


def test_media_payload_that_looks_like_tags():
    """TAG or APETAGEX where such tags would begin, but inside the last frame."""
    room = media_mpeg.KBITS_1[-1] * 9 // 2 - media_mpeg.HEAD
    for mark, back in ((b"TAG", 128), (b"APETAGEX" + struct.pack("<4I", 2000, 64, 1, 0) + b"\0" * 8, 32)):
        payload = bytearray(b"x" * room * 3)
        payload[len(payload) - back : len(payload) - back + len(mark)] = mark
        media = media_mpeg.encode(bytes(payload))
        assert media[-back:].startswith(mark) and media_mpeg.payload_of(media) == bytes(payload)


def bare_header(version, layer, index, rate, padding=0, mode=0, extension=0, protected=False):
    return bytes([0xFF, 0xE0 | version << 3 | (4 - layer) << 1 | (not protected), index << 4 | rate << 2 | padding << 1, mode << 6 | extension << 4])


def bare_frame(*a, **k):
    head = bare_header(*a, **k)
    return head + bytes(media_mpeg.header(head).length - 4)


def test_media_layers_and_rates():
    """Lengths and samples of the standard's formulas for every version, layer, bit rate and sampling rate; exact durations over changing rates."""
    for version in (3, 2, 0):
        for layer in (1, 2, 3):
            for index in range(1, 15):
                for rate in range(3):
                    for padding in (0, 1):
                        h = media_mpeg.header(bare_header(version, layer, index, rate, padding))
                        samples = 384 if layer == 1 else 1152 if layer == 2 or version == 3 else 576
                        slot = 4 if layer == 1 else 1
                        assert h.samples == samples and h.length == (samples * h.kbits * 1000 // 8 // slot // h.rate + padding) * slot
                        assert h.rate == (44100, 48000, 32000)[rate] // {3: 1, 2: 2, 0: 4}[version]
    kinds = [(3, 3, 9, 0), (3, 3, 9, 1), (2, 3, 5, 2), (3, 1, 4, 0), (0, 2, 6, 1)]
    frames = [bare_frame(*k) for k in kinds for _ in range(7)]
    s = media_mpeg.parse(b"".join(frames))
    assert s.skipped == 0 and s.lengths == [len(f) for f in frames]
    want = sum(Fraction(media_mpeg.header(f[:4]).samples, media_mpeg.header(f[:4]).rate) for f in frames)
    assert s.duration == want and len(s.kinds) == 4
    assert s.seek(Fraction(1152, 44100) * 7) == s.offsets[7] and s.seek(s.duration - Fraction(1, 10**6)) == s.offsets[-1] and s.seek(-1) == s.offsets[0]


@pytest.mark.parametrize("mode,extension", [(0, 0), (1, 0), (1, 2), (3, 0)])
def test_media_checksums(mode, extension):
    """Of all layers, against a bitwise remainder over the bits that the standard names."""
    def remainder(bits):
        crc = 0xFFFF
        for b in bits:
            crc = (crc << 1 ^ (0x8005 if (crc >> 15) ^ b else 0)) & 0xFFFF
        return crc

    rnd, channels = random.Random(mode * 4 + extension), 1 if mode == 3 else 2
    bound = (extension + 1) * 4 if mode == 1 else 32
    bits_of = lambda x: [b >> (7 - i) & 1 for b in x for i in range(8)]
    cases = [(3, 1, 9, 0), (2, 1, 5, 1), (3, 3, 9, 0), (2, 3, 8, 0)]
    # Layer II: MPEG version, bit rate index, rate index, and the allocation's bits for each subband.
    tables = [(3, 10, 0, [4] * 11 + [3] * 12 + [2] * 7), (3, 4, 0, [4] * 11 + [3] * 12 + [2] * 4) if mode == 3 else (3, 9, 0, [4] * 11 + [3] * 12 + [2] * 4), (3, 1 if mode == 3 else 2, 0, [4] * 2 + [3] * 6), (3, 1 if mode == 3 else 2, 2, [4] * 2 + [3] * 10), (2, 8, 0, [4] * 4 + [3] * 7 + [2] * 19)]
    frames = []
    for version, layer, index, rate, *bands in [*cases, *((v, 2, i, r, b) for v, i, r, b in tables)]:
        head = bare_header(version, layer, index, rate, mode=mode, extension=extension, protected=True)
        h = media_mpeg.header(head)
        body = bytes(rnd.randrange(256) for _ in range(h.length - 6))
        if layer == 3:
            n = 8 * ((17 if mode == 3 else 32) if version == 3 else (9 if mode == 3 else 17))
        elif layer == 1:
            n = 4 * (channels * min(bound, 32) + 32 - min(bound, 32))
        else:
            bits, n, chosen = bits_of(body), 0, 0
            for band, size in enumerate(bands[0]):
                for _ in range(channels if band < bound else 1):
                    chosen += any(bits[n : n + size]) * (channels if band >= bound else 1)
                    n += size
            n += 2 * chosen
        crc = remainder(bits_of(head[2:4]) + bits_of(body)[:n])
        frames.append(head + struct.pack(">H", crc) + body)
    s = media_mpeg.parse(b"".join(frames))
    assert len(s.offsets) == s.checked == len(frames) and s.damaged == []
    flipped = [f[:7] + bytes([f[7] ^ 0x10]) + f[8:] for f in frames]
    assert len(media_mpeg.parse(b"".join(flipped)).damaged) == len(frames)


def test_media_free_format():
    frames = [bare_header(3, 3, 0, 0, padding=k % 2) + bytes(700 + k % 2) for k in range(9)]
    s = media_mpeg.parse(b"".join(frames) + b"TAG" + bytes(125))
    assert s.lengths == [len(f) for f in frames] and s.skipped == 0 and s.duration == Fraction(1152 * 9, 44100)
    s = media_mpeg.parse(b"junk" + b"".join(frames[:4]) + b"??" + b"".join(frames[4:]))
    assert len(s.offsets) == 9 and s.skipped == 6
    assert media_mpeg.parse(frames[0]).offsets == []


def test_media_tables():
    frame = bare_frame(3, 3, 9, 0)
    vbri = bytearray(frame)
    vbri[36:62] = b"VBRI" + struct.pack(">HHHIIHHHH", 1, 0, 75, 10 * len(frame), 9, 3, 2, 2, 3)
    vbri[62:68] = struct.pack(">3H", *[3 * len(frame) // 2] * 3)
    s = media_mpeg.parse(bytes(vbri) + frame * 9)
    assert s.vbr["kind"] == "VBRI" and s.sound_table and len(s.offsets) == 9 and s.duration == Fraction(1152 * 9, 44100)
    assert s.hint(s.duration / 2) == 3 * len(frame) // 2 * 2
    media = media_mpeg.encode(b"a" * 100_000)
    s = media_mpeg.parse(media)
    assert s.sound_table and all(abs(s.hint(s.duration * k / 100) - s.seek(s.duration * k / 100)) <= len(media) // 64 for k in range(100))
    assert media_mpeg.parse(frame * 3).hint(0) is None and media_mpeg.parse(b"").seek(1) == -1
    short = bytes([0xFF, 0xF3, 0x14, 0xC4]) + b"\0" * 9 + b"Xing\0\0\0\xff" + b"\0" * 5  # a table that ends with its frame
    assert media_mpeg.header(short[:4]).length < 30 and media_mpeg.parse(short[:26]) is not None


def test_media_tags():
    frame = bare_frame(3, 3, 9, 0)
    sync = lambda n: bytes(n >> s & 0x7F for s in (21, 14, 7, 0))
    v22 = b"TT2\0\0\x06\0title" + b"TXX\0\0\x06\0k\0val"
    v23 = struct.pack(">IHI", 6, 0, 0) + b"TIT2\0\0\0\x05\0\0\1\xff\xfea\0" + b"TPE1\0\0\0\x03\0\x80\0no" + b"TALB\0\0\0\x03\0\0\0ok"
    unsync = v23.replace(b"\xff\xfe", b"\xff\0\xfe")
    v24 = sync(6) + b"\1\0" + b"TIT2" + sync(9) + b"\0\x01" + sync(5) + b"\3\xc3\xa9tc" + b"TALB" + sync(5) + b"\0\x02\3a\xff\0b"
    for version, flags, body, tags in ((2, 0, v22, {"TT2": "title", "k": "val"}), (3, 0x40, v23, {"TIT2": "a", "TALB": "ok"}), (3, 0xC0, unsync, {"TIT2": "a", "TALB": "ok"}), (4, 0x50, v24, {"TIT2": "étc", "TALB": "a\ufffdb"})):
        tag = b"ID3" + bytes([version, 0, flags]) + sync(len(body)) + body + (b"3DI" + bytes([version, 0, flags]) + sync(len(body)) if flags & 0x10 and version == 4 else b"")
        s = media_mpeg.parse(tag + frame * 3)
        assert s.tags == tags and len(s.offsets) == 3 and s.skipped == 0, version
        assert media_mpeg.parse(tag + tag + frame * 3).offsets[0] == 2 * len(tag)
    item = struct.pack("<2I", 3, 0) + b"Artist\0xyz"
    foot = lambda flags: b"APETAGEX" + struct.pack("<4I", 2000, len(item) + 32, 1, flags) + bytes(8)
    for ape in (item + foot(0), foot(0xA0000000) + item + foot(0x80000000)):
        s = media_mpeg.parse(frame * 3 + ape + b"TAG" + b"t".ljust(125, b"\0"))
        assert s.tags == {"Artist": "xyz", "TIT2": "t"} and len(s.offsets) == 3 and s.skipped == 0


def test_media_parser_never_fails():
    rnd = random.Random(1)
    seeds = [media_mpeg.encode(bytes(rnd.randrange(256) for _ in range(3000))), b"".join(bare_frame(*k) for k in ((3, 1, 4, 0), (2, 3, 1, 1), (3, 2, 2, 2))), b"ID3\4\0\xd0\0\0\0\x20" + bytes(40), b"APETAGEX" * 8]
    marks = [b"Xing", b"VBRI", b"ID3\4", b"TAG", b"APETAGEX", b"\xff\xfb", b"\xff\xf3\x14\xc4", b"\xff\xfb\0\0"]
    for _ in range(3000):
        data = bytearray(rnd.choice(seeds))
        for _ in range(rnd.randint(1, 6)):
            at = rnd.randrange(len(data) + 1)
            data[at : at + rnd.randint(0, 8)] = rnd.choice([*marks, bytes(rnd.randrange(256) for _ in range(rnd.randint(0, 9)))])
        data = bytes(data[: rnd.randint(0, len(data))] if rnd.random() < 0.5 else data)
        s = media_mpeg.parse(data)
        media_mpeg.feature(s)
        assert s.skipped + sum(s.lengths) + (s.vbr or {}).get("length", 0) <= len(data) and s.hint(0.1) != 0.1
        assert all(a + n <= b for a, n, b in zip(s.offsets, s.lengths, [*s.offsets[1:], len(data)], strict=False))


# 9. Near duplicates.


def classes(rows):
    out = {}
    for i, c in rows:
        out.setdefault(c, set()).add(i)
    return sorted(map(sorted, out.values()))


def shingle_counts(text):
    """Five-word shingles of a text and how often each comes, in plain Python."""
    words = re.findall(rb"[0-9A-Za-z_\x80-\xff]+", (text or "").encode())
    words = [bytes(b + 32 if 65 <= b <= 90 else b for b in w) for w in words]
    k = min(5, len(words))
    return Counter(tuple(words[i : i + k]) for i in range(len(words) - k + 1)) if k else Counter()


def idf_reference(counts, known):
    """idf of each shingle, of those rarer than 1 / ``known`` of all pairs as if they had just that."""
    df = Counter(s for c in counts for s in c)
    least = max(1, -(-df.total() // known))
    return {s: 1 + math.log((1 + len(counts)) / (1 + min(max(n, least), len(counts)))) for s, n in df.items()}


def weighted_jaccard(a, b):
    if not a or not b:
        return float(not a and not b)
    return sum(min(w, b[s]) for s, w in a.items() if s in b) / sum(max(a.get(s, 0), b.get(s, 0)) for s in {*a, *b})


def brute_force(rows, similar=0.8, known=near_dup.KNOWN):
    """Classes by comparing all pairs."""
    counts = [shingle_counts(t) for _, t in rows]
    idf = idf_reference(counts, known)
    vectors = [{s: n * idf[s] for s, n in c.items()} for c in counts]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if find(a) != find(b) and (bool(vectors[a]) == bool(vectors[b])) and (not vectors[a] or not vectors[a].keys().isdisjoint(vectors[b])) and weighted_jaccard(vectors[a], vectors[b]) >= similar - 1e-9:
                parent[find(a)] = find(b)
    return classes((rows[k][0], find(k)) for k in range(len(rows)))


def edited_copies(docs):
    """The small documents, and copies of one text that are edited further and further: chains, and some too far."""
    rnd = random.Random(5)
    vocabulary = [f"w{i}" for i in range(3000)]
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    base = [rnd.choice(vocabulary) for _ in range(200)]
    for k in range(60):
        words = base[:]
        for _ in range(k % 6):
            words[rnd.randrange(200)] = rnd.choice(vocabulary)
        rows.append((10_000 + k, " ".join(words)))
    return rows


@pytest.mark.parametrize("known", [near_dup.KNOWN, 1 << 9])
def test_near_duplicates(spark, docs, monkeypatch, known):
    monkeypatch.setattr(near_dup, "KNOWN", known)
    rows = edited_copies(docs)
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns(CLASH())
    got = near_dup.near_duplicates(df).collect()
    assert classes((r.doc_id, r.class_id) for r in got) == brute_force(rows, known=known)
    size = Counter(r.class_id for r in got)
    least = {c: min(r.doc_id for r in got if r.class_id == c) for c in size}
    assert all(r.class_size == size[r.class_id] and r.class_id == least[r.class_id] and r.kept == (r.doc_id == r.class_id) for r in got)


def test_near_duplicates_with_hot_keys(spark, docs, monkeypatch):
    """Every bucket and class is joined as a hot one."""
    monkeypatch.setattr(_base, "LUKEWARM", 1)
    monkeypatch.setattr(_base, "HOT", 1 << 40)
    monkeypatch.setattr(near_dup, "MAX_BROADCAST_KEYS", 0)
    rows = edited_copies(docs)
    got = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows) and classes((r.doc_id, r.class_id) for r in got) == brute_force(rows)


def test_links_at_exactly_the_threshold(spark, monkeypatch):
    """Pairs of texts that share 4 of 5 shingles, or 40 of 50, all of one weight, whatever the order of sums."""
    monkeypatch.setattr(near_dup, "KNOWN", 100)
    rows = []
    for k in range(40):
        n = 4 if k % 2 else 40  # n of 9n / 8 shingles shared each: n / (n + n / 8 + n / 8) = 0.8
        words = [f"t{k}x{i}" for i in range(n + n // 4 + 4)]
        rows += [(2 * k, " ".join(words[: n + n // 8 + 4] if n == 40 else words[:8] + ["q"])), (2 * k + 1, " ".join(words[n // 8 : n + n // 4 + 4] if n == 40 else words[:8]))]
    got = {r.doc_id: r.class_id for r in near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    counts = [shingle_counts(t) for _, t in rows]
    idf = idf_reference(counts, 100)
    want = [abs(weighted_jaccard(*({s: n * idf[s] for s, n in counts[i + j].items()} for j in (0, 1))) - 0.8) < 1e-12 for i in range(0, len(rows), 2)]
    assert sum(want) == 40 and all(got[rows[2 * k][0]] == got[rows[2 * k + 1][0]] for k, w in enumerate(want) if w)


def test_near_duplicates_of_long_and_repeated_rows(spark):
    long = " ".join(f"v{i * i % 9973}" for i in range(300_000))
    rows = [(1, long), (2, long + " more"), (3, "a b"), (3, "a b"), (3, "a b"), (4, "a  B!"), (5, "b a"), (6, "x" * 3_000_000), (7, "x" * 3_000_000 + " y"), (8, long[: len(long) // 2])]
    got = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.class_id, r.class_size) for r in got) == [(1, 1, 2), (2, 1, 2), (3, 3, 4), (3, 3, 4), (3, 3, 4), (4, 3, 4), (5, 5, 1), (6, 6, 1), (7, 7, 1), (8, 8, 1)]
    assert sum(r.kept for r in got) == 6


@pytest.mark.parametrize("known", [1 << 16, 1 << 9, 1 << 6, 2])
def test_shingle_frequencies(spark, docs, monkeypatch, known):
    """Both passes, over many chunks, give each frequent shingle its df in all documents."""
    monkeypatch.setattr(near_dup, "KNOWN", known)
    monkeypatch.setattr(near_dup, "CHUNK", 5_000)
    near_dup.arrow(spark)
    texts = [r.text for r in docs.select("text").collect()] + [None, "", "one two"]
    got = near_dup.inverse_frequencies(spark.createDataFrame([(t,) for t in texts], "text string").repartition(7))
    counts = [shingle_counts(t) for t in texts]
    df = Counter(s for c in counts for s in c)
    least = max(1, -(-df.total() // known))
    frequent = {int(near_dup.shingles_of(word_hashes([b" ".join(s).decode()])[0])[0][0]): n for s, n in df.items() if n >= least}
    assert {int(s): round(math.expm1(math.log1p(len(texts)) + 1 - v)) for s, v in zip(got.shingles, got.values, strict=True)} == frequent
    assert abs(got.rare - 1 - math.log((1 + len(texts)) / (1 + min(least, len(texts))))) < 1e-12 and len(frequent) <= known and got.rare >= 1


def rows_with_rare_shingles():
    """Of 300,000 pairs of texts and shingles: 0 and 1 are linked if all with a df up to 5 weigh alike, 2 and 3 if each weighs by its own."""
    run = lambda name, n: [f"{name}{i}" for i in range(n)]
    s, t = run("s", 43), run("t", 44)
    rows = [(0, run("a", 5) + t), (1, run("b", 5) + t), (2, run("p", 5) + s), (3, run("q", 5) + s)]
    for k in range(300):
        rows.append((10 + k, run("p" if k < 3 else "q", 5) + s[:4] + run(f"f{k}x", 1_000) if k < 6 else run(f"f{k}x", 1_000)))
    return [(i, " ".join(words)) for i, words in rows]


def test_rare_shingles_weigh_by_their_own_df(spark):
    rows = rows_with_rare_shingles()
    counts = [shingle_counts(x) for _, x in rows]
    similar = {}
    for known in (1 << 62, 1 << 16):
        idf = idf_reference(counts, known)
        similar[known] = [weighted_jaccard(*({x: n * idf[x] for x, n in counts[i + j].items()} for j in (0, 1))) > 0.8 - 1e-9 for i in (0, 2)]
    assert similar == {1 << 62: [False, True], 1 << 16: [True, False]}
    got = {r.doc_id: r.class_id for r in near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: i for i, _ in rows} | {3: 2}


def test_each_text_has_the_df_of_its_shingles(spark, docs, monkeypatch):
    """Over many chunks and parts, and with repeated rows."""
    monkeypatch.setattr(near_dup, "CHUNK", 2_000)
    seen = []
    monkeypatch.setattr(near_dup, "_linked", lambda led, texts, *rest, f=near_dup._linked: (seen.extend(texts.collect()), f(led, texts, *rest))[1])
    rows = edited_copies(docs)
    assert near_dup.near_duplicates(spark.createDataFrame(rows + rows[:50], "doc_id long, text string")).count() == len(rows) + 50
    df = Counter()
    for _, text in rows + rows[:50]:
        df.update({int(x) for x in near_dup.shingles_of(word_hashes([text])[0])[0]})
    assert len(seen) > 50
    for r in seen:
        shingles = near_dup.shingles_of(word_hashes([r.text])[0])[0]
        assert near_dup._numbers(bytes(r.df), len(shingles)).tolist() == [df[int(x)] for x in shingles]


PLAIN = near_dup.Idf(np.empty(0, np.uint64), np.empty(0), 1.0)


def linked(spark, texts, buckets):
    """Components, as sets of names, of texts by name in the given buckets of (leader, others)."""
    name = {k: k.encode() for k in texts}
    frame = near_dup.written(spark.createDataFrame([(name[k], t) for k, t in texts.items()], "d binary, text string"), "texts")
    rows = [(b, name[k], len(texts[k]), len(names), sum(len(texts[x]) for x in names), name[names[0]]) for b, names in enumerate(buckets) for k in names]
    led = near_dup.written(spark.createDataFrame(rows, "band long, d binary, chars long, n long, bucket_chars long, a binary"), "led")
    near_dup.arrow(spark)
    labels = near_dup._linked(led, frame, spark.sparkContext.broadcast(PLAIN), 0.8, len(rows))
    got = {}
    for r in near_dup._components_of(frame.select("d"), labels).collect():
        got.setdefault(bytes(r.c), set()).add(bytes(r.d).decode())
    return {frozenset(x) for x in got.values()}


def numbered(a, b):
    return " ".join(f"n{i}" for i in range(a, b))


def test_texts_of_different_leaders_meet(spark):
    """u and v share a bucket, are similar and below 0.8 with its leader; v has another leader too, which u doesn't know."""
    texts = {"u": numbered(0, 200), "v": numbered(0, 195), "L1": numbered(60, 300), "L2": numbered(-80, 140)} | {f"x{k}": numbered(1_000 * k, 1_000 * k + 50) for k in range(1, 9)}
    others = [k for k in texts if k[0] == "x"]
    got = linked(spark, texts, [["L1", "u", "v"], ["L1", *others[:3]], ["L2", "v"], ["L2", *others]])
    assert frozenset(("u", "v")) in got and len(got) == len(texts) - 1


def test_truncated_copies_meet(spark):
    """Two copies of a long text, cut at three quarters: similar to each other, wholly within their leader, below 0.8 with it."""
    texts = {"W": numbered(0, 200), "t1": numbered(0, 150), "t2": numbered(0, 148)} | {f"x{k}": numbered(1_000 * k, 1_000 * k + 50) for k in range(1, 5)}
    got = linked(spark, texts, [["W", "t1", "t2"], ["W", *[k for k in texts if k[0] == "x"]]])
    assert frozenset(("t1", "t2")) in got and len(got) == len(texts) - 1


def test_rounds_add_up(spark):
    """The first round links L and p, q and r; the second links p and q: one component; s stays apart."""
    texts = {"L": numbered(0, 200), "p": numbered(10, 210), "q": numbered(20, 220), "M": numbered(38, 232), "r": numbered(30, 225), "s": numbered(500, 700)}
    assert linked(spark, texts, [["L", "p"], ["M", "q", "r"], ["s", "p", "q"]]) == {frozenset("LpqMr"), frozenset("s")}
    assert linked(spark, texts, [["s", "p", "q"]]) == {frozenset("pq"), *(frozenset([k]) for k in "LMrs")}
    assert len(linked(spark, texts, [["s", "L"]])) == 6


@pytest.mark.parametrize("hot", [1, 1_000])
def test_blocks_hold_every_pair(spark, monkeypatch, hot):
    """However a bucket is dealt, each two texts outside its largest component, and each of them and one inside, meet once to be compared."""
    monkeypatch.setattr(near_dup, "BLOCK_ROWS", 4)
    monkeypatch.setattr(_base, "LUKEWARM", hot)
    name = lambda k: bytes([k])
    led = near_dup.written(spark.createDataFrame([(7, name(k), 10, 40, 400, name(0)) for k in range(40)], "band long, d binary, chars long, n long, bucket_chars long, a binary"), "led")
    labels = spark.createDataFrame([(name(k), name(1)) for k in range(1, 20)], "node binary, root binary")
    units = {}
    for r in near_dup._blocks(led, labels, 40).collect():
        units.setdefault((r.i, r.j), []).append(r)
    met = [(bytes(u.d), bytes(v.d)) for x in units.values() for u in x for v in x if u.asks and v.member and u.c != v.c and (not v.apart or v.d > u.d)]
    assert len(units) > 4 and len(met) == len(set(met))
    assert {frozenset(m) for m in met} == {frozenset((name(a), name(b))) for a in range(20, 40) for b in range(1, 40) if a != b}


def test_near_duplicates_edge(edge, empty):
    got = near_dup.near_duplicates(edge).collect()
    assert len(got) == len(ROWS)
    group = {r.doc_id: r.class_id for r in got}
    assert group[1] == group[2] == 1 and group[3] == group[4] == group[9] == 3 and sum(r.kept for r in got if r.doc_id == 8) == 1
    assert near_dup.near_duplicates(empty).count() == 0


def test_samples_estimate_similarity():
    rng = np.random.default_rng(0)
    agree = []
    for _ in range(40):
        h = rng.integers(0, 1 << 63, 400).astype(np.uint64)
        w = rng.uniform(2, 30, 400)
        other = h.copy()
        other[:44] = rng.integers(0, 1 << 63, 44).astype(np.uint64)
        a, b = (np.sort(h), w[np.argsort(h)]), (np.sort(other), w[np.argsort(other)])
        s = near_dup.samples(np.concatenate([a[0], b[0]]), np.concatenate([a[1], b[1]]), np.array([0, 400]))
        agree.append((s[0] == s[1]).mean() - near_dup.similarity(a, b))
    assert abs(np.mean(agree)) < 0.02


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(30)] + [(100, 101), (102, 101), (7, 7)], "a long, b long")
    got = {r.node: r.root for r in near_dup.components(edges).collect()}
    assert got == {**dict.fromkeys(range(31), 0), 100: 100, 101: 100, 102: 100}


# 10. BPE.


def test_codec(edge, docs, empty):
    ranks = "byte_bpe_multi_50k.tiktoken"
    c = bpe_codec.codec(ranks)
    for df in (edge, docs):
        texts = {r.doc_id: r.text or "" for r in df.select("doc_id", "text").collect()}
        for r in bpe_codec.encoded_documents(df, columns=("ids", "decoded", "ids_sha256", "decoded_sha256")).collect():
            want = c.encode_ordinary(texts[r.doc_id])
            assert r.ids == want and bytes(r.decoded) == texts[r.doc_id].encode() and r.n_tokens == len(want)
            assert r.ids_sha256 == hashlib.sha256(",".join(map(str, want)).encode()).hexdigest()
            assert r.decoded_sha256 == hashlib.sha256(bytes(r.decoded)).hexdigest()
    assert bpe_codec.encoded_documents(empty).count() == 0


def test_codec_pieces():
    ranks = "byte_bpe_multi_50k.tiktoken"
    c = bpe_codec.codec(ranks)
    for text in [*random_texts(2000, 9), "x" + " " * 12_000 + "yz"]:
        assert bpe_codec.encode(ranks, text, 7) == c.encode_ordinary(text)
    long = "x" + " " * 30_000 + "yz" + "\n" * 1_200_000 + "k" * 100_000
    assert bpe_codec.decode(ranks, bpe_codec.encode(ranks, long)) == long.encode()


# The pipeline.


def test_pipeline(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    seen = [docs]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = corpus_pipeline.written(stage(spark, seen[-1], sf), "test-stage")
        assert out.columns == docs.columns, name
        seen.append(out)
    texts = [[(r.doc_id, r.text) for r in s.select("doc_id", "text").collect()] for s in seen]
    assert set(texts[1]) <= set(texts[0]) and len(texts[1]) > 0.7 * len(texts[0])
    lowered = ["".join(ch.lower() if "A" <= ch <= "Z" else ch for ch in t) for _, t in texts[2]]
    assert len(set(lowered)) == len(lowered) == len({"".join(ch.lower() if "A" <= ch <= "Z" else ch for ch in t) for _, t in texts[1]})
    assert len(texts[3]) == len(brute_force(texts[2]))
    assert set(texts[4]) <= set(texts[3])
    final = corpus_pipeline.run(spark, sf)
    assert final.count() == len(texts[4])
    assert all(bpe_codec.decode("byte_bpe_multi_50k.tiktoken", r.ids) == t.encode() for r, (i, t) in zip(sorted(final.collect(), key=lambda r: r.doc_id), sorted(texts[4]), strict=True))


def test_stages_begin_with_a_full_collection(spark, monkeypatch):
    import corpus_pipeline

    beans = [b for b in spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans() if "Old" in b.getName() or "MarkSweep" in b.getName()]
    before = sum(b.getCollectionCount() for b in beans)
    _base.trimmed(spark)
    assert sum(b.getCollectionCount() for b in beans) > before

    class Begun(Exception):
        pass

    def begun(spark):
        raise Begun

    monkeypatch.setattr(corpus_pipeline, "trimmed", begun)
    for _, stage in corpus_pipeline.STAGES:
        with pytest.raises(Begun):
            stage(spark, None, "")


def test_pipeline_weighs_rare_shingles_by_their_own_df(spark):
    import corpus_pipeline

    rows = rows_with_rare_shingles()
    got = corpus_pipeline.dissimilar_documents(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").select("doc_id").collect()
    assert sorted(r.doc_id for r in got) == [i for i, _ in rows if i != 3]


def test_pipeline_edge(spark, edge, empty, tmp_path):
    """Nulls, empty and long texts, ties, repeated rows, clashing names: each stage by brute force; then empty tables."""
    import corpus_pipeline

    clash = {c: F.lit(c) for c in ("_metadata", "_file", "_row", "_at_file", "_gone_row", "_mix_copies", "d", "band", "head", "target", "log_weight", "taken", "text_sha256")}
    long = spark.createDataFrame([(100, "very long " * 60_000, "s1", "en"), (101, "very long " * 60_000 + "end", "s1", "en"), (102, "y" * 1_000_000, "s2", None)], EDGE).withColumns(CLASH())
    docs = edge.unionByName(long).withColumns(clash)
    docs.write.parquet(f"{tmp_path}/a/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (8, 0, 0), (None, 1, None), (3, None, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/a/labels.parquet")
    at = f"{tmp_path}/a"
    seen = [spark.read.parquet(f"{at}/documents.parquet")]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        seen.append(corpus_pipeline.written(stage(spark, seen[-1], at), "edge-stage"))
        assert seen[-1].columns == docs.columns, name
    rows = [[(r.doc_id, r.text) for r in s.select("doc_id", "text").collect()] for s in seen]
    assert Counter(rows[1]) == Counter(rows[0])  # one good and one bad label are not enough to reject anything
    lowered = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    groups = {}
    for i, t in rows[1]:
        groups.setdefault(lowered(t), []).append(-1 if i is None else i)
    assert Counter((-1 if i is None else i, lowered(t)) for i, t in rows[2]) == Counter((max(g), t) for t, g in groups.items())
    known = [(10**9 if i is None else i, t) for i, t in rows[2]]
    assert sorted(10**9 if i is None else i for i, _ in rows[3]) == sorted(min(c) for c in brute_force(known))
    assert set(rows[4]) <= set(rows[3]) and all(re.search(mixing.WORD, t or "") for _, t in rows[4])
    final = corpus_pipeline.run(spark, at).collect()
    assert Counter(r.doc_id for r in final) == Counter(i for i, _ in rows[4])
    empty.write.parquet(f"{tmp_path}/b/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/b/labels.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/b").count() == 0


def test_long_texts(spark):
    """Texts of half a million words and of one word of a million letters, through every operator on texts."""
    texts = ["lorem ipsum dolor " * 170_000, "z" * 1_000_000, "Ä" * 300_000 + " \n" * 100_000, None]
    docs = _base.written(spark.createDataFrame([(i, t, f"s{i % 2}", "en") for i, t in enumerate(texts)], EDGE), "long")
    assert {r.doc_id: r.text_sha256 for r in exact_dedup.exact_dedup(docs).collect()} == {i: hashlib.sha256("".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").encode()).hexdigest() for i, t in enumerate(texts)}
    assert {r.doc_id: r.size for r in mixing.mix(docs).collect()} == {i: len(re.findall(mixing.WORD, t or "")) for i, t in enumerate(texts)}
    codec = bpe_codec.codec("byte_bpe_multi_50k.tiktoken")
    assert all(bytes(r.decoded) == (texts[r.doc_id] or "").encode() for r in bpe_codec.encoded_documents(docs, columns=("decoded",)).collect()) and codec
    words = tokenizer("word_bpe_49k.json")
    assert {r.doc_id: r.n_tokens for r in token_counts.token_counts(docs).collect()} == {i: len(words.encode(t or "", add_special_tokens=False).ids) for i, t in enumerate(texts)}
    ids = tokenizer("byte_bpe_50k.json")
    assert {r.doc_id: r.n_tokens for r in token_store.stored_tokens(docs).collect()} == {i: len(ids.encode(t or "", add_special_tokens=False).ids) + 1 for i, t in enumerate(texts)}
    assert {r.doc_id: r.payload_sha256 for r in media_mpeg.stored_media(docs).collect()} == {i: hashlib.sha256((raw := (t or "").encode()) + bytes(-len(raw) % 64 or (0 if raw else 64))).hexdigest() for i, t in enumerate(texts)}
    weights = {r.doc_id: r.log_weight for r in quality.classified(docs, spark.createDataFrame([(0, 1), (1, 0)], "doc_id long, quality int")).collect()}
    assert len(weights) == 4 and weights[3] == 0
    assert {r.doc_id: r.class_size for r in near_dup.near_duplicates(docs).collect()} == {0: 1, 1: 1, 2: 1, 3: 1}
    assert {r.doc_id: r.lang_pred for r in language_id.identified(docs).collect()}[3] == "und"
