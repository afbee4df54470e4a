"""Token ids in files: fixed-width bit packing, with block offsets for random access and vectorised numpy unpacking.

A shard file (all numbers little-endian): magic, version, bits, ids per block, documents, ids, blocks; then the blocks, each
a whole number of bytes with its ids in ``bits`` bits from the lowest bit on; then the byte offset of each block, the
documents' ids, flags of null ids and the number of ids before each document; then the offset of that index.
Shards are written in ascending order of doc_id by one task each, to a temporary name that is renamed when whole, so a
task that runs again leaves the same file. A manifest table has a row per shard.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from asclepia.llm._base import arrow, shared_dir, written
from asclepia.llm._tokenizers import encode_texts, tokenizer

MAGIC, HEAD = b"ATOK1\0\0\0", "<8sIIQQQ"
BLOCK_IDS = 1 << 16
#: Texts that are cut and looked up together.
TOGETHER_ROWS, TOGETHER_BYTES = 2_000, 8 << 20
#: A shard is closed at the first document that takes it over this many ids.
SHARD_IDS = 8 << 20


def bits_for(vocabulary: int) -> int:
    """The fewest bits that hold every id below ``vocabulary``."""
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    if len(ids) and int(ids.max()) >> bits:
        raise ValueError(f"an id needs more than {bits} bits")
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    spread = (ids.astype(np.uint32)[:, None] >> np.arange(bits, dtype=np.uint32)).astype(np.uint8) & 1
    return np.packbits(spread, bitorder="little").tobytes()


def unpack(data: bytes, n: int, bits: int) -> np.ndarray:
    if bits in (8, 16, 32):
        return np.frombuffer(data, f"<u{bits // 8}", n).astype(np.uint32)
    spread = np.unpackbits(np.frombuffer(data, np.uint8), count=n * bits, bitorder="little").reshape(n, bits)
    return (spread.astype(np.uint32) << np.arange(bits, dtype=np.uint32)).sum(1, dtype=np.uint32)


class ShardWriter:
    """Packs block by block: holds one block's ids, not the shard's."""

    def __init__(self, folder: str, name: str, bits: int) -> None:
        self.fs, path = pafs.FileSystem.from_uri(folder)
        self.fs.create_dir(path, recursive=True)
        self.path, self.uri, self.temporary = f"{path}/{name}", f"{folder}/{name}", f"{path}/.{name}.{uuid.uuid4().hex}"
        self.bits, self.out = bits, self.fs.open_output_stream(self.temporary)
        self.out.write(b"\0" * struct.calcsize(HEAD))
        self.at, self.held, self.n_held, self.offsets = struct.calcsize(HEAD), [], 0, []
        self.docs, self.starts, self.n = [], [], 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append(doc_id)
        self.starts.append(self.n)
        self.n += len(ids)
        self.held.append(ids)
        self.n_held += len(ids)
        if self.n_held >= BLOCK_IDS:
            self._blocks(False)

    def _blocks(self, last: bool) -> None:
        ids = np.concatenate(self.held) if self.held else np.empty(0, np.uint32)
        upto = len(ids) if last else len(ids) // BLOCK_IDS * BLOCK_IDS
        for at in range(0, upto, BLOCK_IDS):
            data = pack(ids[at : min(at + BLOCK_IDS, upto)], self.bits)
            self.offsets.append(self.at)
            self.out.write(data)
            self.at += len(data)
        self.held, self.n_held = [ids[upto:]], len(ids) - upto

    def close(self) -> tuple[int, int, int]:
        """Documents, ids, bytes."""
        self._blocks(True)
        head = struct.pack(HEAD, MAGIC, self.bits, BLOCK_IDS, len(self.docs), self.n, len(self.offsets))
        index = np.array(self.offsets, "<u8").tobytes() + np.array([d or 0 for d in self.docs], "<i8").tobytes()
        index += np.array([d is None for d in self.docs], np.uint8).tobytes() + np.array(self.starts, "<u8").tobytes()
        self.out.write(index + head + struct.pack("<Q", self.at))  # the head comes last: streams can't go back
        self.out.close()
        self.fs.move(self.temporary, self.path)
        return len(self.docs), self.n, self.at + len(index) + len(head) + 8


class Shard:
    """Random access to a shard: reads the index, then only the blocks that are asked for."""

    def __init__(self, uri: str) -> None:
        fs, path = pafs.FileSystem.from_uri(uri)
        self.file = fs.open_input_file(path)
        size = self.file.size()
        tail = struct.calcsize(HEAD) + 8
        raw = self.file.read_at(tail, size - tail)
        magic, self.bits, self.block_ids, n_docs, self.n_ids, n_blocks = struct.unpack(HEAD, raw[:-8])
        (at,) = struct.unpack("<Q", raw[-8:])
        if magic != MAGIC:
            raise ValueError(f"not a whole shard: {uri}")
        index = self.file.read_at(size - tail - at, at)
        cut = np.cumsum([0, 8 * n_blocks, 8 * n_docs, n_docs, 8 * n_docs])
        offsets, ids, nulls, starts = (index[a:b] for a, b in zip(cut, cut[1:], strict=False))
        self.offsets = np.append(np.frombuffer(offsets, "<u8"), np.uint64(at)).astype(np.int64)
        self.doc_ids = [None if gone else int(i) for i, gone in zip(np.frombuffer(ids, "<i8"), np.frombuffer(nulls, np.uint8), strict=True)]
        self.starts = np.append(np.frombuffer(starts, "<u8"), np.uint64(self.n_ids)).astype(np.int64)

    def ids(self, start: int, end: int) -> np.ndarray:
        """The ids from ``start`` to before ``end``, from the blocks that hold them."""
        if end <= start:
            return np.empty(0, np.uint32)
        first, last = start // self.block_ids, (end - 1) // self.block_ids
        data = self.file.read_at(int(self.offsets[last + 1] - self.offsets[first]), int(self.offsets[first]))
        out = []
        for b in range(first, last + 1):
            n = min(self.block_ids, self.n_ids - b * self.block_ids)
            at = int(self.offsets[b] - self.offsets[first])
            out.append(unpack(data[at : int(self.offsets[b + 1] - self.offsets[first])], n, self.bits))
        return np.concatenate(out)[start - first * self.block_ids : end - first * self.block_ids]

    def document(self, k: int) -> np.ndarray:
        return self.ids(int(self.starts[k]), int(self.starts[k + 1]))

    def documents(self, batch_ids: int = 1 << 20) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """doc_id, start and ids of each document, read about ``batch_ids`` ids at a time."""
        k, n = 0, len(self.doc_ids)
        while k < n:
            upto = max(k + 1, int(np.searchsorted(self.starts, self.starts[k] + batch_ids, "right")) - 1)
            base, ids = int(self.starts[k]), self.ids(int(self.starts[k]), int(self.starts[upto]))
            for j in range(k, upto):
                yield self.doc_ids[j], int(self.starts[j]), ids[int(self.starts[j]) - base : int(self.starts[j + 1]) - base]
            k = upto


def gathered(batches: Iterator[pa.RecordBatch], rows: int = TOGETHER_ROWS, size: int = TOGETHER_BYTES) -> Iterator[tuple[pa.Array, pa.Array]]:
    """The two columns of batches put together up to about so many rows or bytes: the more texts, the fewer distinct chunks each."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= rows or sum(b.nbytes for b in held) >= size:
            yield tuple(pa.concat_arrays([b.column(k) for b in held]) for k in (0, 1))
            held = []
    if held:
        yield tuple(pa.concat_arrays([b.column(k) for b in held]) for k in (0, 1))


def write_tokens(docs: DataFrame, folder: str, tokenizer_path: str = "byte_bpe_50k.json", end_id: int | None = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes every whole text, appends ``end_id`` (none if None), and writes shards in ascending doc_id order.

    Returns the manifest: part, shard, path, docs, ids, bytes, and base, the number of ids in all shards before. A null
    text is empty, null ids come first, repeated ids are ordered by text; an empty table makes no shards; other columns are not looked at.
    """
    spark = docs.sparkSession
    arrow(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    ordered = rows.repartitionByRange(F.col("id")).sortWithinPartitions("id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, shard, writer = TaskContext.get().partitionId(), 0, None
        bits = bits_for(max(tokenizer(tokenizer_path).get_vocab_size(), (end_id or 0) + 1))
        ending = np.array([] if end_id is None else [end_id], np.uint32)

        def closed(w: ShardWriter, k: int) -> pa.RecordBatch:
            n_docs, n_ids, n_bytes = w.close()
            return pa.RecordBatch.from_pydict({"part": [part], "shard": [k], "path": [w.uri], "docs": [n_docs], "ids": [n_ids], "bytes": [n_bytes]}, schema=out)

        for ids_of, texts in gathered(batches):
            for doc_id, ids in zip(ids_of.to_pylist(), encode_texts(tokenizer_path, texts), strict=True):
                writer = writer or ShardWriter(folder, f"part-{part:06d}-{shard:04d}.tok", bits)
                writer.add(doc_id, np.concatenate([ids, ending]))
                if writer.n >= SHARD_IDS:
                    yield closed(writer, shard)
                    writer, shard = None, shard + 1
        if writer:
            yield closed(writer, shard)

    schema = "part int, shard int, path string, docs long, ids long, bytes long"
    out = pa.schema([("part", pa.int32()), ("shard", pa.int32()), ("path", pa.string()), ("docs", pa.int64()), ("ids", pa.int64()), ("bytes", pa.int64())])
    manifest = written(ordered.mapInArrow(run, schema), "token-manifest")
    before = W.orderBy("part", "shard").rowsBetween(W.unboundedPreceding, -1)  # one row per shard, not per document
    return manifest.withColumn("base", F.coalesce(F.sum("ids").over(before), F.lit(0)))


def read_tokens(manifest: DataFrame, with_ids: bool = True) -> DataFrame:
    """Reads the shards back, one task or more: doc_id, start, n_tokens, ids_crc32, and ids (array) if ``with_ids``."""
    arrow(manifest.sparkSession)
    shards = max(1, manifest.count())
    dealt = manifest.select("path", "base").repartition(shards)
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids
    fields = [("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())] + [("ids", pa.list_(pa.int32()))] * with_ids
    out = pa.schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows = []
                for doc_id, start, ids in Shard(path).documents():
                    row = (doc_id, base + start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()))
                    rows.append(row + (ids.astype(np.int32),) if with_ids else row)
                    if len(rows) == 2000:
                        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, (_, t) in zip(zip(*rows, strict=True), fields, strict=True)], schema=out)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, (_, t) in zip(zip(*rows, strict=True), fields, strict=True)], schema=out)

    return dealt.mapInArrow(run, schema)


def stored_tokens(docs: DataFrame, with_ids: bool = False, **options) -> DataFrame:
    """Writes ``docs`` to a fresh folder of shards in the shared folder and reads them back."""
    folder = shared_dir(docs.sparkSession, "tokens")
    if "://" not in folder and folder.startswith("file:"):
        folder = folder.removeprefix("file:")
    return read_tokens(write_tokens(docs, folder, **options), with_ids)

