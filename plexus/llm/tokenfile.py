"""Token-id files: documents compressed one by one under a shared zstandard dictionary.

A shard file is laid out as

    magic 8 bytes | dictionary hash 8
    frames, one zstandard frame a document (ids as little-endian uint16, or
    uint32 where the vocabulary needs it: the flag in the magic's last byte)
    index: doc_id int64[n], first id uint64[n + 1], frame offset uint64[n + 1], null bitmap uint8[n]
    documents 8 | ids 8 | index offset 8

so one document is read with its index entry, one seek and one small frame, and
a file is written in one go. The dictionary lies beside the shards; its hash in
every shard ties them together. ``manifest.json`` lists the shard files in order
with their documents and the ids before each: shards are ranges of ascending
doc_id. A file's name holds the task attempt that wrote it, and the manifest
names the attempts that Spark committed, so a retried or doubled task is harmless.

Each text is encoded once, where it is read; what moves to its range is the
compressed frame. Memory holds a block of frames and a shard's index.

The dictionary is trained on a bounded sample: of the ``SAMPLE_DOCS`` documents
with the smallest hash of their doc_id, those of at most ``SAMPLE_BYTES``. It
affects file size only, never ids, and serves short documents.

Defined results: null texts count as empty and hold the end id alone; null
doc_ids sort first; rows with an equal doc_id all stay, ordered by their text's hash.
"""

from __future__ import annotations

import json
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_sample, discard, each, filesystem, materialize, new_folder, write_file
from .tokens import public_path, word_encoder

MAGIC = b"PXTOKF2"
HEADER = np.dtype([("magic", "S7"), ("width", "u1"), ("dictionary", "<u8")])
TRAILER = np.dtype([("docs", "<u8"), ("ids", "<u8"), ("index", "<u8")])
SAMPLE_DOCS = 1500
SAMPLE_BYTES = 16_384
DICTIONARY_BYTES = 65_536
LEVEL = 3
FLUSH = 1 << 20


def train_dictionary(samples: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A zstandard dictionary; raw content where there is too little to train on."""
    samples = [s for s in samples if s]
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(samples)[-size:] or b"\0" * 8


class FrameWriter:
    """Compresses id arrays under the dictionary, whose tables are made once."""

    def __init__(self, dictionary: bytes, width: int):
        self.width = width
        shared = zstandard.ZstdCompressionDict(dictionary)
        shared.precompute_compress(level=LEVEL)
        self.compressor = zstandard.ZstdCompressor(dict_data=shared)

    def frame(self, ids: np.ndarray) -> bytes:
        return self.compressor.compress(ids.astype(f"<u{self.width}").tobytes())


class ShardWriter:
    """Lays frames out as a shard file; memory holds the index."""

    def __init__(self, dictionary: bytes, width: int):
        self.hash, self.width = xxhash.xxh64_intdigest(dictionary), width
        self.keys, self.sizes, self.counts = [], [], []

    def header(self) -> bytes:
        return np.array([(MAGIC, self.width, self.hash)], HEADER).tobytes()

    def add(self, keys: list, counts: list, frames: list) -> bytes:
        """The bytes of a block of documents."""
        self.keys += keys
        self.counts += counts
        self.sizes += map(len, frames)
        return b"".join(frames)

    def close(self) -> bytes:
        """Index and trailer."""
        starts = np.concatenate([[0], np.cumsum(self.counts, dtype="<u8")]).astype("<u8")
        offsets = np.concatenate([[0], np.cumsum(self.sizes, dtype="<u8")]).astype("<u8") + np.uint64(HEADER.itemsize)
        keys = np.array([k or 0 for k in self.keys], "<i8")
        absent = np.array([k is None for k in self.keys], "u1")
        trailer = np.array([(len(keys), int(starts[-1]), int(offsets[-1]))], TRAILER)
        return b"".join(x.tobytes() for x in (keys, starts, offsets, absent, trailer))


class ShardReader:
    """Reads single documents of a shard file by position."""

    def __init__(self, file: str, dictionary: bytes):
        system, name = filesystem(file)
        self.source = system.open_input_file(name)
        head = np.frombuffer(self.source.read_at(HEADER.itemsize, 0), HEADER)[0]
        if head["magic"] != MAGIC or head["dictionary"] != xxhash.xxh64_intdigest(dictionary):
            raise ValueError(f"{file} was not written with this dictionary")
        trailer = np.frombuffer(self.source.read_at(TRAILER.itemsize, self.source.size() - TRAILER.itemsize), TRAILER)[0]
        n, at = int(trailer["docs"]), int(trailer["index"])
        raw = self.source.read_at(8 * n + 16 * (n + 1) + n, at)
        self.keys = np.frombuffer(raw, "<i8", n)
        self.starts = np.frombuffer(raw, "<u8", n + 1, 8 * n).astype(np.int64)
        self.offsets = np.frombuffer(raw, "<u8", n + 1, 8 * n + 8 * (n + 1)).astype(np.int64)
        self.absent = np.frombuffer(raw, "u1", n, 8 * n + 16 * (n + 1)).astype(bool)
        self.width = int(head["width"])
        self.decompressor = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary))

    def ids(self, i: int) -> np.ndarray:
        a, b = self.offsets[i], self.offsets[i + 1]
        return np.frombuffer(self.decompressor.decompress(self.source.read_at(int(b - a), int(a))), f"<u{self.width}")

    def blocks(self, size: int = 8 << 20):
        """(position, ids) of all documents in order, reading block by block."""
        i, n = 0, len(self.keys)
        while i < n:
            j = max(i + 1, int(np.searchsorted(self.offsets, self.offsets[i] + size, "right")) - 1)
            raw = self.source.read_at(int(self.offsets[j] - self.offsets[i]), int(self.offsets[i]))
            base = int(self.offsets[i])
            for k in range(i, j):
                yield k, np.frombuffer(self.decompressor.decompress(raw[int(self.offsets[k]) - base : int(self.offsets[k + 1]) - base]), f"<u{self.width}")
            i = j

    def close(self) -> None:
        self.source.close()


@dataclass
class TokenFiles:
    """A written set of shard files."""

    folder: str
    shards: list[tuple[str, int, int]]  # (file, documents, ids before it), in doc_id order

    @classmethod
    def open(cls, folder: str) -> TokenFiles:
        return cls(folder, [tuple(x) for x in json.loads(read_whole(f"{folder}/manifest.json"))])

    def dictionary(self) -> bytes:
        return read_whole(f"{self.folder}/dictionary")

    def read(self, spark: SparkSession) -> DataFrame:
        """(doc_id, start, n_tokens, ids_crc32) of every document, read back from the files."""
        folder = self.folder
        # A short entry a shard file.
        table = spark.sparkContext.broadcast([(file, before) for file, _, before in self.shards])

        def run(batches):
            dictionary = read_whole(f"{folder}/dictionary")
            for batch in batches:
                for shard in batch.column(0).to_pylist():
                    if shard >= len(table.value):
                        continue
                    file, base = table.value[shard]
                    reader, crcs, counts = ShardReader(f"{folder}/{file}", dictionary), [], []
                    for _, ids in reader.blocks():
                        crcs.append(zlib.crc32(ids.astype("<u4").tobytes()))
                        counts.append(len(ids))
                    keys = pa.array(reader.keys, mask=reader.absent)
                    starts = pa.array(reader.starts[:-1] + base)
                    reader.close()
                    whole = pa.Table.from_arrays([keys, starts, pa.array(counts, pa.int64()), pa.array(crcs, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])
                    yield from whole.to_batches(max_chunksize=50_000)

        shards = max(1, len(self.shards))
        return spark.range(0, shards, 1, shards).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def read_whole(file: str) -> bytes:
    system, name = filesystem(file)
    with system.open_input_stream(name) as source:
        return source.read()


def write_tokens(docs: DataFrame, tokenizer: str = "word_bpe_49k.json", end_id: int = 2, folder: str | None = None, sample_docs: int = SAMPLE_DOCS, sample_bytes: int = SAMPLE_BYTES) -> TokenFiles:
    """Encode every text, append ``end_id`` and write shard files in ascending doc_id order."""
    spark = docs.sparkSession
    path = public_path(tokenizer)
    folder = folder or new_folder(spark, "tokens")
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    sample = bounded_sample(slim, "doc_id", sample_docs).where(F.octet_length("text") <= sample_bytes).select("text").collect()
    encoder = word_encoder(path)
    width = 2 if encoder.tokenizer.get_vocab_size() <= 1 << 16 and end_id < 1 << 16 else 4
    dictionary = train_dictionary([np.frombuffer(encoder.encode(r.text), "<u4").astype(f"<u{width}").tobytes() for r in sample])
    write_file(f"{folder}/dictionary", dictionary)

    def encode(batches):
        encoder, out, end = word_encoder(path), FrameWriter(dictionary, width), np.array([end_id], "<u4").tobytes()
        keys, ties, counts, frames, size = [], [], [], [], 0

        def block():
            columns = [pa.array(keys, pa.int64()), pa.array(ties, pa.int64()), pa.array(counts, pa.int64()), pa.array(frames, pa.binary())]
            return pa.RecordBatch.from_arrays(columns, ["doc_id", "tie", "n_ids", "frame"])

        for batch in batches:
            for key, text in zip(each(batch.column(0)), each(batch.column(1)), strict=True):
                ids = encoder.encode(text) + end
                keys.append(key)
                ties.append(xxhash.xxh64_intdigest(ids) >> 1)
                counts.append(len(ids) // 4)
                frames.append(out.frame(np.frombuffer(ids, "<u4")))
                size += len(frames[-1])
                if size >= FLUSH:
                    yield block()
                    keys, ties, counts, frames, size = [], [], [], [], 0
        if keys:
            yield block()

    def write(batches):
        task, out = TaskContext.get(), ShardWriter(dictionary, width)
        name = f"shard-{task.partitionId():06d}-{task.taskAttemptId()}.tok"
        sink = None
        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                part = batch.slice(a, 500)
                if sink is None:
                    system, file = filesystem(f"{folder}/{name}")
                    sink = system.open_output_stream(file)
                    sink.write(out.header())
                sink.write(out.add(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2).to_pylist()))
        if sink is not None:
            sink.write(out.close())
            sink.close()
            yield pa.RecordBatch.from_arrays([pa.array([task.partitionId()], pa.int32()), pa.array([name]), pa.array([len(out.keys)], pa.int64()), pa.array([sum(out.counts)], pa.int64())], ["shard", "file", "n_docs", "n_ids"])

    encoded = materialize(slim.mapInArrow(encode, "doc_id long, tie long, n_ids long, frame binary"), "frames")
    ordered = encoded.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "n_ids", "frame")
    # One short row a shard file comes back.
    shards, before = [], 0
    for _, file, n_docs, n_ids in sorted(tuple(r) for r in ordered.mapInArrow(write, "shard int, file string, n_docs long, n_ids long").collect()):
        shards.append((file, n_docs, before))
        before += n_ids
    discard(encoded)
    write_file(f"{folder}/manifest.json", json.dumps(shards).encode())
    return TokenFiles(folder, shards)
