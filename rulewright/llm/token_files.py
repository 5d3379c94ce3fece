"""Token ids in bit-packed files, in ascending order of document id.

A file holds, in this order: a magic number; blocks of ``BLOCK`` ids, each id in the fewest bits that hold the
largest id of the vocabulary; the document ids, null ones first; where each document ends; the byte offset of each
block; a footer with the numbers of all these and of the null ids. Block offsets let a reader unpack any range of ids without the rest of the file.

Every task writes a file of its own name, and only files named by the manifest, which is written after
the tasks have succeeded, are ever read: lost executors and repeated tasks leave no trace in the result.

Null or empty texts hold only the end id. A null document id sorts first and comes back as null; equal
ids are all kept, ordered by the hash of their text. An empty table gives an empty manifest.
"""

from __future__ import annotations

import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rulewright.llm.lib_tokens import lib_encoder
from rulewright.llm.shared import file_system, new_path, written

MAGIC, FOOTER = b"RWTOKEN2", struct.Struct("<QQQQHI8s")
BLOCK = 4096
MANIFEST = "shard int, path string, n_docs long, n_tokens long"


def bits_for(vocabulary_size: int) -> int:
    return max(1, (vocabulary_size - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """The ids one after the other, least significant bit first, padded to whole bytes."""
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    spread_bits = (ids.astype(np.uint32)[:, None] >> np.arange(bits, dtype=np.uint32)) & 1
    return np.packbits(spread_bits.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack(data: bytes, bits: int, begin: int, stop: int) -> np.ndarray:
    """Ids [begin, stop) of a packed block, each from the eight bytes around it."""
    if bits in (8, 16, 32):
        return np.frombuffer(data, f"<u{bits // 8}")[begin:stop].astype(np.uint32)
    raw = np.frombuffer(data + bytes(8), np.uint8)
    at = np.arange(begin, stop, dtype=np.int64) * bits
    byte, out = at >> 3, np.zeros(stop - begin, np.uint64)
    for k in range((bits + 14) // 8):
        out |= raw[byte + k].astype(np.uint64) << np.uint64(8 * k)
    return ((out >> (at & 7).astype(np.uint64)) & np.uint64((1 << bits) - 1)).astype(np.uint32)


class TokenWriter:
    """Streams one file; holds a block of ids and two numbers for each document."""

    def __init__(self, sink, bits: int):
        self.sink, self.bits, self.rest = sink, bits, np.zeros(0, np.uint32)
        self.at, self.tokens, self.nulls = len(MAGIC), 0, 0
        self.ids: list[np.ndarray] = []
        self.ends: list[np.ndarray] = []
        self.blocks: list[int] = []
        sink.write(MAGIC)

    def add(self, doc_ids: pa.Array, flat: np.ndarray, lens: np.ndarray) -> None:
        """Documents in order, null ids first."""
        self.nulls += doc_ids.null_count
        self.ids.append(pc.fill_null(doc_ids, 0).to_numpy(zero_copy_only=False))
        self.ends.append(self.tokens + np.cumsum(lens))
        self.tokens += len(flat)
        flat = np.concatenate([self.rest, flat.astype(np.uint32)])
        whole = len(flat) // BLOCK * BLOCK
        for i in range(0, whole, BLOCK):
            self._block(flat[i : i + BLOCK])
        self.rest = flat[whole:]

    def _block(self, ids: np.ndarray) -> None:
        data = pack(ids, self.bits)
        self.blocks.append(self.at)
        self.at += len(data)
        self.sink.write(data)

    def close(self) -> int:
        """Number of documents."""
        if len(self.rest):
            self._block(self.rest)
        n = sum(map(len, self.ids))
        for parts, kind in ((self.ids, "<i8"), (self.ends, "<u8"), ([np.array(self.blocks)], "<u8")):
            for x in parts:
                self.sink.write(x.astype(kind).tobytes())
        self.sink.write(FOOTER.pack(n, self.nulls, self.tokens, len(self.blocks), self.bits, BLOCK, MAGIC))
        return n


class TokenReader:
    """Random access to one file."""

    def __init__(self, source):
        self.source = source
        end = source.size()
        self.n_docs, self.n_nulls, self.n_tokens, self.n_blocks, self.bits, self.block, magic = FOOTER.unpack(self._read(end - FOOTER.size, FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a token file")
        self.table = end - FOOTER.size - 8 * (2 * self.n_docs + self.n_blocks)
        self.offsets = np.append(np.frombuffer(self._read(self.table + 16 * self.n_docs, 8 * self.n_blocks), "<u8"), self.table).astype(np.int64)

    def _read(self, at: int, size: int) -> bytes:
        self.source.seek(at)
        return self.source.read(size)

    def documents(self, begin: int, stop: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document ids, first token, end token) of the documents [begin, stop)."""
        ids = np.frombuffer(self._read(self.table + 8 * begin, 8 * (stop - begin)), "<i8")
        first = max(begin - 1, 0)
        ends = np.frombuffer(self._read(self.table + 8 * (self.n_docs + first), 8 * (stop - first)), "<u8").astype(np.int64)
        return (ids, ends[:-1], ends[1:]) if begin else (ids, np.append(0, ends[:-1]), ends)

    def tokens(self, begin: int, stop: int) -> np.ndarray:
        if stop <= begin:
            return np.zeros(0, np.uint32)
        a, b = begin // self.block, (stop - 1) // self.block + 1
        data = self._read(int(self.offsets[a]), int(self.offsets[b] - self.offsets[a]))
        base, out = int(self.offsets[a]), []
        for k in range(a, b):
            lo, hi = max(begin - k * self.block, 0), min(stop - k * self.block, self.block)
            out.append(unpack(data[int(self.offsets[k]) - base : int(self.offsets[k + 1]) - base], self.bits, lo, hi))
        return np.concatenate(out)


def write_token_files(docs: DataFrame, tokenizer_path: str, vocabulary_size: int, end_id: int | None = 1, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes whole texts, writes the files and returns their manifest (shard, path, n_docs, n_tokens).

    One shuffle: documents go to ranges of their id, where each task sorts (spilling) and streams to its file.
    """
    spark = docs.sparkSession
    folder = folder or new_path(spark, "tokens")
    with open(tokenizer_path, encoding="utf-8") as f:
        content = spark.sparkContext.broadcast(f.read())
    bits = bits_for(vocabulary_size)

    def run(batches):
        encode = lib_encoder(content.value)
        store, root = file_system(folder)
        store.create_dir(root, recursive=True)
        name = f"{root}/{uuid.uuid4().hex}.tokens"
        writer = sink = None
        for batch in batches:
            if not batch.num_rows:
                continue
            if writer is None:
                sink = store.open_output_stream(name, compression=None)
                writer = TokenWriter(sink, bits)
            for a in range(0, batch.num_rows, 1000):
                part = batch.slice(a, 1000)
                flat, lens = encode([t or "" for t in part.column(1).to_pylist()])
                if end_id is not None:
                    flat, lens = np.insert(flat, np.cumsum(lens), end_id), lens + 1
                writer.add(part.column(0), flat, lens)
        if writer is not None:
            n = writer.close()
            sink.close()
            path = name if store.type_name == "local" else folder + name[len(root) :]
            row = {"shard": TaskContext.get().partitionId(), "path": path, "n_docs": n, "n_tokens": writer.tokens}
            kinds = pa.schema([("shard", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())])
            yield pa.RecordBatch.from_pylist([row], schema=kinds)

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    order = [F.col("id").asc_nulls_first(), F.xxhash64("text")]
    return written(rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, MANIFEST), "token-manifest")


def read_token_files(spark: SparkSession, manifest: DataFrame, id_col: str = "doc_id", with_ids: bool = True) -> DataFrame:
    """(id, start, n_tokens, ids_crc32, ids): one row for each document, from the files alone.

    ``start`` counts the ids of all documents before it; the running total needs one row for each file.
    """
    before = F.coalesce(F.sum("n_tokens").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    files = manifest.select("path", before.alias("base"))
    schema = f"`{id_col}` long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids

    def run(batches):
        for batch in batches:
            for path, base in zip(*(c.to_pylist() for c in batch.columns)):
                store, name = file_system(path)
                with store.open_input_file(name) as source:
                    r = TokenReader(source)
                    a = 0
                    while a < r.n_docs:
                        ids, first, end = r.documents(a, min(a + 500, r.n_docs))
                        stop = max(1, int(np.searchsorted(end, first[0] + 2_000_000)))
                        ids, first, end = ids[:stop], first[:stop], end[:stop]
                        flat = r.tokens(int(first[0]), int(end[-1]))
                        ends = (end - first[0]).tolist()
                        parts = [flat[i:j] for i, j in zip([0, *ends], ends)]
                        cols = [pa.array(ids, mask=np.arange(a, a + stop) < r.n_nulls), pa.array(base + first), pa.array(end - first), pa.array([zlib.crc32(p) for p in parts], pa.int64())]
                        if with_ids:
                            cols.append(pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), pa.array(flat.astype(np.int32))))
                        yield pa.RecordBatch.from_arrays(cols, names=[id_col, "start", "n_tokens", "ids_crc32", "ids"][: len(cols)])
                        a += stop

    return files.repartition(max(1, manifest.count())).mapInArrow(run, schema)
