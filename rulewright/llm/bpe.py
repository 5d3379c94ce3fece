"""Byte-level BPE: vectorised pre-tokenisation, cached pair merging, decoding by kept offsets.

``encode_documents`` and ``decode_documents`` are narrow: one Arrow batch in, one out, no shuffle.
Null or empty text gives empty arrays; repeated rows and clashing column names are kept as they are
(only the id column passes through). Memory is bounded by the batch and by the cache limit.
"""

from __future__ import annotations

import base64
import hashlib
import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from rulewright.llm.pretok import TextEncoder, once, spread
from rulewright.llm.shared import text_slices


def read_ranks(content: bytes) -> dict[bytes, int]:
    """A rank file: lines of a base64 token and its rank."""
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in content.splitlines() if line)}


def merge_piece(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Joins the neighbours of least rank, leftmost first, until no join has a rank.

    A heap of candidate joins over a linked list: n log n, so very long pieces are safe.
    """
    if piece in ranks:
        return [ranks[piece]]
    n = len(piece)
    end = list(range(1, n + 1))  # of the part that starts here; 0: swallowed
    prev = list(range(-1, n - 1))
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        mid = end[i]
        if not mid or mid >= n or end[mid] != stop:
            continue  # one of the two parts has changed
        end[i], end[mid] = stop, 0
        if stop < n:
            prev[stop] = i
            if (r := ranks.get(piece[i : end[stop]])) is not None:
                heapq.heappush(heap, (r, i, end[stop]))
        before = prev[i]
        if before >= 0 and (r := ranks.get(piece[before:stop])) is not None:
            heapq.heappush(heap, (r, before, stop))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = end[i]
    return out


class Vocabulary:
    """Token bytes of all ids in one array, for encoding offsets and vectorised decoding."""

    def __init__(self, content: bytes):
        self.ranks = read_ranks(content)
        size = max(self.ranks.values(), default=-1) + 1
        tokens = [b""] * size
        for token, rank in self.ranks.items():
            tokens[rank] = token
        self.lens = np.fromiter(map(len, tokens), np.int64, size)
        self.starts = np.cumsum(self.lens) - self.lens
        self.blob = np.frombuffer(b"".join(tokens), np.uint8)
        self.encoder = TextEncoder(lambda pieces: [merge_piece(p.encode(), self.ranks) for p in pieces], "byte", limit=300_000)


def vocabulary(content: bytes) -> Vocabulary:
    return once(("ranks", hashlib.sha256(content).digest()), lambda: Vocabulary(content))


def _lists(flat: np.ndarray, lens: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(lens)).astype(np.int32)), pa.array(flat, pa.int32()))


def _run(docs: DataFrame, ranks_path: str, id_col: str, text_col: str, kinds: dict):
    """Encodes batches and returns the id and the columns ``kinds``; the rank file (about 1 MB) is broadcast."""
    spark = docs.sparkSession
    with open(ranks_path, "rb") as f:
        content = spark.sparkContext.broadcast(f.read())

    def run(batches):
        pa.set_memory_pool(pa.system_memory_pool())  # gives freed memory back
        v = vocabulary(content.value)
        for batch in batches:
            for part in text_slices(batch):
                ids, lens = v.encoder([t or "" for t in part.column(1).to_pylist()])
                sizes = v.lens[ids]
                ends = np.cumsum(sizes)
                base = np.append(ends - sizes, 0)[np.cumsum(lens) - lens]
                offsets = ends - sizes - np.repeat(base, lens)
                cols = {"ids": lambda: _lists(ids, lens), "offsets": lambda: _lists(offsets.astype(np.int32), lens), "decoded": lambda: pa.array(decode_all(ids, offsets, lens, v), pa.binary())}
                yield pa.RecordBatch.from_arrays([part.column(0), *(cols[c]() for c in kinds)], names=[id_col, *kinds])

    schema = T.StructType([docs.schema[id_col], *(T.StructField(c, kind) for c, kind in kinds.items())])
    return docs.select(id_col, text_col).mapInArrow(run, schema)


_INTS = T.ArrayType(T.IntegerType())


def encode_documents(docs: DataFrame, ranks_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>, offsets array<int>): token ids and the byte offset of each token in the UTF-8 text."""
    return _run(docs, ranks_path, id_col, text_col, {"ids": _INTS, "offsets": _INTS})


def round_trip(docs: DataFrame, ranks_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>, decoded binary): encoded, then decoded from ids and offsets in the same task."""
    return _run(docs, ranks_path, id_col, text_col, {"ids": _INTS, "decoded": T.BinaryType()})


def decode_documents(encoded: DataFrame, ranks_path: str, id_col: str = "doc_id") -> DataFrame:
    """(id, ids, decoded binary): each token's bytes go to its kept offset. Null ids give null."""
    spark = encoded.sparkSession
    with open(ranks_path, "rb") as f:
        content = spark.sparkContext.broadcast(f.read())
    schema = T.StructType([encoded.schema[id_col], T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.BinaryType())])

    def run(batches):
        v = vocabulary(content.value)
        for batch in batches:
            out = []
            for ids, offsets in zip(batch.column(1), batch.column(2)):
                if not ids.is_valid:
                    out.append(None)
                    continue
                out.append(decode_ids(ids.values.to_numpy(), offsets.values.to_numpy(), v))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], names=[id_col, "ids", "decoded"])

    return encoded.select(id_col, "ids", "offsets").mapInArrow(run, schema)


def decode_ids(ids: np.ndarray, offsets: np.ndarray, v: Vocabulary, begin: int = 0, stop: int | None = None) -> bytes:
    """Bytes of the tokens [begin, stop) of a text; refuses offsets that aren't those of the ids."""
    ids, offsets = ids[begin:stop], offsets[begin:stop].astype(np.int64)
    lens = v.lens[ids]
    if not np.array_equal(np.diff(offsets), lens[:-1]):
        raise ValueError("offsets and ids disagree")
    return v.blob[spread(v.starts[ids], lens)].tobytes()


def decode_all(ids: np.ndarray, offsets: np.ndarray, lens: np.ndarray, v: Vocabulary) -> list[bytes]:
    ends = np.cumsum(lens).tolist()
    return [decode_ids(ids[a:b], offsets[a:b], v) for a, b in zip([0, *ends], ends)]
