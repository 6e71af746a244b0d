"""Token-id files of byte or bit planes.

A shard holds the ids of consecutive documents (ascending ``doc_id``) in blocks of ``BLOCK`` ids. A
block is transposed into four byte planes (or 32 bit planes): plane k holds byte (bit) k of every id.
The high planes are nearly constant, so each plane is compressed with zstandard by itself. Behind the
blocks stand the document index (ids and lengths) and the chunk index (offset, ids and plane sizes of
each block), found through a fixed trailer; a reader can fetch any block alone.

    magic | block planes ... | document index | chunk index | trailer

Files are written by the tasks that hold the documents, in the shared folder, under a name of the
attempt and then renamed; a retried task writes the same bytes again, and an attempt that fails removes
what it wrote. There are as many shards as keep a file's texts near ``SHARD_BYTES``.
"""

from __future__ import annotations

import os
import struct
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracewright.llm.common import held, partitions, scratch, slices, trimmed, written
from tracewright.llm.transducer import Splitter, byte_characters

MAGIC = b"TWPLANE1"
BLOCK = 65_536
SHARD_BYTES = 256 << 20
TRAILER = struct.Struct("<QQQQQIB8s")  # documents, their index's place and size, chunk index's place and size, blocks, planes, magic


def to_planes(ids: np.ndarray, bits: bool = False) -> list[bytes]:
    """Planes of a block of unsigned 32-bit ids, lowest first."""
    raw = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    if not bits:
        return [np.ascontiguousarray(raw[:, k]).tobytes() for k in range(4)]
    flat = np.unpackbits(raw, axis=1, bitorder="little")
    return [np.packbits(flat[:, k], bitorder="little").tobytes() for k in range(32)]


def from_planes(planes: list[bytes], n: int) -> np.ndarray:
    if len(planes) == 4:
        raw = np.empty((n, 4), np.uint8)
        for k, p in enumerate(planes):
            raw[:, k] = np.frombuffer(p, np.uint8)
    else:
        flat = np.empty((n, 32), np.uint8)
        for k, p in enumerate(planes):
            flat[:, k] = np.unpackbits(np.frombuffer(p, np.uint8), count=n, bitorder="little")
        raw = np.packbits(flat, axis=1, bitorder="little")
    return raw.reshape(-1).view("<u4")


class ShardWriter:
    """Writes one shard with one block of ids in memory."""

    def __init__(self, sink, bits: bool = False, level: int = 3) -> None:
        self.sink, self.bits, self.at, self.held, self.waiting = sink, bits, 0, 0, []
        self.zip = zstandard.ZstdCompressor(level=level)
        self.chunks: list[tuple[int, ...]] = []
        self.doc_ids, self.lengths, self.known = array("q"), array("q"), bytearray()
        self._put(MAGIC)

    def _put(self, data: bytes) -> None:
        self.sink.write(data)
        self.at += len(data)

    def add(self, doc_id: int | None, ids: bytes) -> None:
        """Append one document's little-endian unsigned 32-bit ids."""
        self.doc_ids.append(doc_id or 0)
        self.known.append(doc_id is not None)
        self.lengths.append(len(ids) // 4)
        self.waiting.append(ids)
        self.held += len(ids) // 4
        if self.held >= BLOCK:
            self._flush(False)

    def _flush(self, all_of_it: bool) -> None:
        ids = np.frombuffer(b"".join(self.waiting), "<u4")
        full = len(ids) if all_of_it else len(ids) // BLOCK * BLOCK
        for a in range(0, full, BLOCK):
            block = ids[a : min(a + BLOCK, full)]
            planes = [self.zip.compress(p) for p in to_planes(block, self.bits)]
            self.chunks.append((self.at, len(block), *map(len, planes)))
            for p in planes:
                self._put(p)
        self.waiting, self.held = [ids[full:].tobytes()], len(ids) - full

    def close(self) -> None:
        self._flush(True)
        ids = np.frombuffer(self.doc_ids, np.int64).astype("<i8")
        lengths = np.frombuffer(self.lengths, np.int64).astype("<u8")
        docs = self.zip.compress(ids.tobytes() + lengths.tobytes() + np.packbits(np.frombuffer(self.known, bool)).tobytes())
        docs_at = self.at
        self._put(docs)
        index = np.array(self.chunks, "<u8").tobytes()
        index_at = self.at
        self._put(index)
        self._put(TRAILER.pack(len(ids), docs_at, len(docs), index_at, len(index), len(self.chunks), 32 if self.bits else 4, MAGIC))


class ShardReader:
    """Reads a shard block by block; ``source`` is a seekable file."""

    def __init__(self, source, size: int) -> None:
        self.source, self.zip = source, zstandard.ZstdDecompressor()
        n, docs_at, docs_n, index_at, index_n, blocks, planes, magic = TRAILER.unpack(self._get(size - TRAILER.size, TRAILER.size))
        if magic != MAGIC:
            raise ValueError("not a plane file")
        docs = self.zip.decompress(self._get(docs_at, docs_n))
        self.known = np.unpackbits(np.frombuffer(docs[16 * n :], np.uint8), count=n).astype(bool)
        self.doc_ids = np.frombuffer(docs[: 8 * n], "<i8").astype(np.int64)
        self.lengths = np.frombuffer(docs[8 * n : 16 * n], "<u8").astype(np.int64)
        self.chunks = np.frombuffer(self._get(index_at, index_n), "<u8").reshape(blocks, 2 + planes).astype(np.int64)

    def _get(self, at: int, n: int) -> bytes:
        self.source.seek(at)
        return self.source.read(n)

    def block(self, k: int) -> np.ndarray:
        at, n, *sizes = self.chunks[k].tolist()
        data = self._get(at, sum(sizes))
        edges = np.cumsum([0, *sizes]).tolist()
        return from_planes([self.zip.decompress(data[a:b]) for a, b in zip(edges, edges[1:])], n)

    def documents(self) -> Iterator[tuple[int | None, int, int]]:
        """``doc_id, n_tokens, crc32`` of each document's ids, in order, one block in memory."""
        block, at, k = np.zeros(0, "<u4"), 0, 0
        for i in range(len(self.lengths)):
            doc_id, n = int(self.doc_ids[i]) if self.known[i] else None, int(self.lengths[i])
            crc, left = 0, n
            while left:
                if at == len(block):
                    block, at, k = self.block(k), 0, k + 1
                part = block[at : at + left]
                crc = zlib.crc32(part.tobytes(), crc)
                at += len(part)
                left -= len(part)
            yield doc_id, n, crc


class Encoder:
    """Ids as the tokenizers library gives them, with short pieces remembered up to ``most_bytes``
    (reckoned with Python's overhead); pieces of 64 characters and more are not. The pieces of a call are
    told apart by Arrow; Python sees each different one once."""

    def __init__(self, path: str, most_bytes: int = 64 << 20) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.splitter = Splitter(self.library)
        self.model = self.library.model  # a piece needs no more than the merges
        self.letters = np.zeros(256, "<u2")
        for c, b in byte_characters().items():
            self.letters[b] = ord(c)
        self.known: dict[str, bytes] = {}
        self.most_bytes, self.known_bytes = most_bytes, 0

    @classmethod
    def of(cls, path: str) -> Encoder:
        """One per worker process."""
        return held((cls, path), lambda: cls(path))

    def _merged(self, pieces: pa.LargeStringArray) -> list[bytes]:
        """The ids of each piece, by the library's merges over its bytes' stand-ins."""
        edges = np.frombuffer(pieces.buffers()[1], np.int64).tolist()
        letters = self.letters[np.frombuffer(pieces.buffers()[2] or b"", np.uint8)].tobytes().decode("utf-16-le")
        ids, upto = array("I"), [0]
        for tokens in map(self.model.tokenize, (letters[a:b] for a, b in zip(edges, edges[1:]))):
            ids.extend([t.id for t in tokens])
            upto.append(4 * len(ids))
        raw = np.array(ids, "<u4").tobytes()
        return [raw[a:b] for a, b in zip(upto, upto[1:])]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        plain = [not any(s in t for s in self.special) for t in texts]
        pieces, ends = self.splitter.piece_array([t for t, p in zip(texts, plain) if p])
        coded = pieces.dictionary_encode()
        words = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        ids = list(map(self.known.get, words))
        new = [k for k, i in enumerate(ids) if i is None]
        if new:
            for k, i in zip(new, self._merged(coded.dictionary.take(pa.array(new)))):
                ids[k] = i
            if self.known_bytes < self.most_bytes:
                short = {words[k]: ids[k] for k in new if len(words[k]) < 64}
                self.known.update(short)
                self.known_bytes += sum(190 + len(p) + len(i) for p, i in short.items())
        flat = pa.array(ids, pa.large_binary()).take(coded.indices)
        raw = memoryview(flat.buffers()[2] or b"")
        edges = [0, *np.frombuffer(flat.buffers()[1], np.int64)[ends].tolist()] if len(ends) else [0]
        whole = (bytes(raw[a:b]) for a, b in zip(edges, edges[1:]))
        return [next(whole) if p else np.array(self.library.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t, p in zip(texts, plain)]


def _open(path: str):
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def shard_count(docs: DataFrame, shard_bytes: int = SHARD_BYTES) -> int:
    """Shards for ``docs``: a file for each ``shard_bytes`` of text, and one a shuffle partition at least."""
    total = docs.agg(F.sum(F.octet_length(F.col("text").cast("string")).cast("long"))).first()[0] or 0
    return max(partitions(docs.sparkSession), -(-total // shard_bytes))


def write_shards(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 2, bits: bool = False, shards: int | None = None, slice_bytes: int = 1 << 20) -> DataFrame:
    """Encode ``docs`` (``doc_id``, ``text``; other columns are ignored) and write them as shards in ``folder``.

    Documents go to shards by ranges of ``doc_id``, ascending, with ties ordered by the hash of their text
    (rows equal in both are interchangeable and may stand in neighbouring shards, whatever their number);
    ``end_id`` closes each. Returns the manifest, a row a file: ``shard, path, n_docs, n_ids, size``.

    ``folder`` is a URI that the executors reach and that pyarrow opens (a shared mount, or a store
    it has a client for). A null text counts as empty and has the end id alone; rows with null
    ``doc_id`` go first and stay null in the index; an empty table writes no file.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = Encoder.of(tokenizer), np.array([end_id], "<u4").tobytes()
        task = TaskContext.get()
        fs, base = _open(folder)
        part = f"{base}/.{task.partitionId()}-{task.taskAttemptId()}"
        final = f"shard-{task.partitionId():06d}.planes"
        writer = sink = None
        try:
            for b in slices(batches, 1, slice_bytes):
                for doc_id, found in zip(b.column(0).to_pylist(), encoder.encode(b.column(1).to_pylist())):
                    if writer is None:
                        fs.create_dir(base, recursive=True)
                        sink = fs.open_output_stream(part)
                        writer = ShardWriter(sink, bits)
                    writer.add(doc_id, found + end)
            if writer is not None:
                writer.close()
                sink.close()
                fs.move(part, f"{base}/{final}")
        except BaseException:
            if sink is not None:
                sink.close()
                if fs.get_file_info(part).type != pafs.FileType.NotFound:
                    fs.delete_file(part)
            raise
        if writer is not None:
            row = [[task.partitionId()], [f"{folder}/{final}"], [len(writer.lengths)], [sum(writer.lengths)], [writer.at]]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()))], ["shard", "path", "n_docs", "n_ids", "size"])
        trimmed()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    # The last key only deals equal rows out, so that one of them repeated without end is no partition of its own.
    keyed = rows.withColumns({"h": F.xxhash64("text"), "r": F.monotonically_increasing_id()})
    dealt = keyed.repartitionByRange(shards or shard_count(rows), "doc_id", "h", "r").sortWithinPartitions("doc_id", "h", "text")
    return dealt.select("doc_id", "text").mapInArrow(run, "shard long, path string, n_docs long, n_ids long, size long")


def read_shards(manifest: DataFrame, batch_rows: int = 20_000) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32, shard`` of every document, from the files themselves.

    A file is read block by block and its rows go out in batches. Null ids come back as null, an empty
    document as its end id alone; an empty manifest gives an empty result.
    """
    names = ["doc_id", "start", "n_tokens", "ids_crc32", "shard"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for shard, path, size, start in zip(*(c.to_pylist() for c in b.columns)):
                fs, at = _open(path)
                with fs.open_input_file(at) as source:
                    rows: list[tuple] = []
                    for doc_id, n, crc in ShardReader(source, size).documents():
                        rows.append((doc_id, start, n, crc, shard))
                        start += n
                        if len(rows) == batch_rows:
                            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names)
                            rows = []
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names)
        trimmed()

    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # over the manifest: a row a file
    rows = manifest.select("shard", "path", "size", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("start"))
    rows = rows.repartition(partitions(manifest.sparkSession))
    return rows.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long, shard long")


def encoded_documents(docs: DataFrame, tokenizer: str, folder: str | None = None, **settings) -> DataFrame:
    """Write ``docs`` as token-id shards and return what the files say of each document (and copy).

    Null ids, null and empty texts, repeated rows and empty tables are as in ``write_shards`` and
    ``read_shards``; other columns of ``docs`` are ignored.
    """
    spark = docs.sparkSession
    manifest = written(write_shards(docs, folder or scratch(spark, "planes"), tokenizer, **settings), "planes-manifest")
    return read_shards(manifest)


def op8_bit_plane_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = encoded_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return out.select("doc_id", "start", "n_tokens", "ids_crc32", "shard")
