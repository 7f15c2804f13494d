"""Token ids in files of fixed-width bits, written and read by Spark tasks.

A file holds the documents of one id range in ascending order::

    block 0 | block 1 | ... | block offsets (uint64) | document ends (uint64) | document ids (int64) | NULL flags (uint8) | footer (JSON) | its size (uint32) | magic

A block is ``BLOCK`` ids (the last one fewer) of ``width`` bits each, lowest bit first, padded
to whole bytes; ``width`` is the least that holds every id of the vocabulary. The offsets let a
reader seek to any block, and a block unpacks in a few NumPy calls.

A NULL or empty text holds the end id only. Rows with one doc_id are kept as so many documents;
NULL ids come first. An empty table writes no file and reads as no rows.
"""

from __future__ import annotations

import json
import struct
import uuid

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltmark.llm.common import arrow_map, shared_folder, worker_state
from siltmark.llm.tokens import library_encoder, read_definition

MAGIC = b"SILTIDS1"
BLOCK = 1 << 16
ROWS_PER_FILE = 8192
MAX_FILES = 1 << 16  # beyond it files get more rows


def bit_width(vocabulary: int) -> int:
    return max(1, int(vocabulary - 1).bit_length())


def pack(ids: np.ndarray, width: int) -> bytes:
    if width in (8, 16, 32):
        return ids.astype(f"<u{width // 8}").tobytes()
    bits = (ids[:, None] >> np.arange(width, dtype=ids.dtype)) & 1
    return np.packbits(bits.astype(np.uint8), bitorder="little").tobytes()


def unpack(data: bytes, width: int, n: int) -> np.ndarray:
    """The first ``n`` ids of a block."""
    if width in (8, 16, 32):
        return np.frombuffer(data, f"<u{width // 8}", n).astype(np.uint32)
    bits = np.unpackbits(np.frombuffer(data, np.uint8), count=n * width, bitorder="little").reshape(n, width)
    return bits.astype(np.uint32) @ (np.uint32(1) << np.arange(width, dtype=np.uint32))


class Writer:
    """Streams documents into one file; ids wait in memory for a block at most."""

    def __init__(self, out, width: int):
        self.out, self.width = out, width
        self.waiting, self.held = [], 0
        self.offsets, self.ends, self.ids, self.nulls, self.total, self.at = [], [], [], bytearray(), 0, 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.waiting.append(ids)
        self.held += len(ids)
        self.total += len(ids)
        self.ends.append(self.total)
        self.ids.append(doc_id or 0)
        self.nulls.append(doc_id is None)
        if self.held >= 16 * BLOCK:
            self._flush(self.held - self.held % BLOCK)

    def _flush(self, upto: int) -> None:
        flat = np.concatenate(self.waiting) if self.waiting else np.empty(0, np.uint32)
        for i in range(0, upto, BLOCK):
            data = pack(flat[i : min(i + BLOCK, upto)], self.width)
            self.offsets.append(self.at)
            self.at += len(data)
            self.out.write(data)
        self.waiting, self.held = [flat[upto:]], len(flat) - upto

    def close(self) -> None:
        self._flush(self.held)
        footer = json.dumps({"width": self.width, "block": BLOCK, "blocks": len(self.offsets), "documents": len(self.ids), "ids": self.total, "index": self.at}).encode()
        for part in (np.array(self.offsets, "<u8").tobytes(), np.array(self.ends, "<u8").tobytes(), np.array(self.ids, "<i8").tobytes(), bytes(self.nulls)):
            self.out.write(part)
        self.out.write(footer + struct.pack("<I", len(footer)) + MAGIC)


class Reader:
    """Random access to the content of one file."""

    def __init__(self, data: bytes):
        if data[-8:] != MAGIC:
            raise ValueError("not a token file, or cut off")
        size = struct.unpack("<I", data[-12:-8])[0]
        meta = json.loads(data[-12 - size : -12])
        self.data, self.width, self.block, self.total = data, meta["width"], meta["block"], meta["ids"]
        at, docs = meta["index"], meta["documents"]
        self.offsets = np.frombuffer(data, "<u8", meta["blocks"], at).astype(np.int64)
        at += 8 * meta["blocks"]
        self.ends = np.frombuffer(data, "<u8", docs, at).astype(np.int64)
        self.ids = np.frombuffer(data, "<i8", docs, at + 8 * docs)
        self.nulls = np.frombuffer(data, np.uint8, docs, at + 16 * docs).astype(bool)
        self.end_of_blocks = meta["index"]

    def tokens(self, first: int, last: int) -> np.ndarray:
        """Ids first..last (exclusive), reading only the blocks they lie in."""
        if first >= last:
            return np.empty(0, np.uint32)
        parts = []
        for b in range(first // self.block, (last - 1) // self.block + 1):
            stop = self.offsets[b + 1] if b + 1 < len(self.offsets) else self.end_of_blocks
            n = min(self.block, self.total - b * self.block)
            parts.append(unpack(self.data[self.offsets[b] : stop], self.width, n))
        base = first - first % self.block
        return np.concatenate(parts)[first - base : last - base]

    def __len__(self) -> int:
        return len(self.ends)


def write_tokens(docs: DataFrame, tokenizer: str, end_id: int, folder: str | None = None, rows_per_file: int = ROWS_PER_FILE) -> tuple[str, list]:
    """Encode every text, append ``end_id``, write the files; returns the folder and (file, documents, ids) of each file.

    Files are the partitions of a range partitioning by id, at most ``MAX_FILES``, so their list
    fits the driver. A file is written under another name and then renamed, so a repeated task
    leaves one whole file.
    """
    spark = docs.sparkSession
    folder = folder or shared_folder(spark)
    source = spark.sparkContext.broadcast(read_definition(tokenizer))  # the vocabulary file
    files = max(1, min(MAX_FILES, -(-docs.count() // rows_per_file)))
    width = bit_width(max(end_id + 1, _vocabulary(source.value)))

    def run(batches):
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        encoder = worker_state(f"ids {tokenizer}", lambda: library_encoder(source.value))
        part, name, out, writer = TaskContext.get().partitionId(), "", None, None
        end = np.array([end_id], np.uint32)
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                if writer is None:
                    store.create_dir(root, recursive=True)
                    name = f"{root}/.{part:08d}-{uuid.uuid4().hex}"
                    out = store.open_output_stream(name)
                    writer = Writer(out, width)
                writer.add(doc_id, np.concatenate([np.frombuffer(encoder(text or ""), "<u4"), end]))
        if writer is not None:
            writer.close()
            out.close()
            store.move(name, f"{root}/{part:08d}.ids")
            yield pa.RecordBatch.from_pydict({"file": pa.array([part]), "documents": pa.array([len(writer.ids)]), "ids": pa.array([writer.total])})

    ordered = docs.select(F.col("doc_id").cast("long"), "text").repartitionByRange(files, "doc_id").sortWithinPartitions("doc_id")
    made = ordered.mapInArrow(run, "file long, documents long, ids long").collect()
    return folder, sorted(tuple(r) for r in made)


def _vocabulary(source: str) -> int:
    from tokenizers import Tokenizer

    return Tokenizer.from_str(source).get_vocab_size()


def read_tokens(spark: SparkSession, folder: str, written: list) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of every document in the files; start counts the ids of all documents before it."""
    schema = "doc_id long, start long, n_tokens long, ids binary"
    if not written:
        return spark.createDataFrame([], schema)
    starts = dict(zip([f for f, _, _ in written], np.cumsum([0, *[n for _, _, n in written]]).tolist(), strict=False))
    shared = spark.sparkContext.broadcast(starts)  # MAX_FILES numbers at most, unless a task was given more partitions

    def each(batch: pa.RecordBatch):
        for path, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
            file = Reader(content.as_py())
            base = shared.value[int(path.rsplit("/", 1)[1].split(".")[0])]
            begins = np.concatenate([[0], file.ends[:-1]]).astype(np.int64)
            for i in range(0, len(file), 1024):
                at = slice(i, i + 1024)
                flat = file.tokens(int(begins[i]), int(file.ends[at][-1]))
                cuts = begins[at] - begins[i]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(file.ids[at], mask=file.nulls[at]), pa.array(base + begins[at]), pa.array(file.ends[at] - begins[at]),
                     pa.array([x.astype("<u4").tobytes() for x in np.split(flat, cuts[1:])], pa.binary())],
                    names=["doc_id", "start", "n_tokens", "ids"],
                )

    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.ids").load(folder).select("path", "content")
    return arrow_map(found, each, schema)
