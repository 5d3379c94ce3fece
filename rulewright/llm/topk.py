"""Exact top-k search by inner product over integer vectors, term at a time.

The candidates are dealt evenly into blocks of about ``BLOCK`` rows, each packed into one row with the postings of every term: places in
the block and weights, zero weights left out. The queries are dealt into blocks of sparse rows. A task holds one candidate block at a time
and streams the query blocks past it: each term of a query adds its weight times the term's postings to a dense array of scores,
a partition of that array selects the block's best, and a ranked window merges the blocks' bests. So every query meets every
candidate, no task holds more than two blocks, and what is shuffled is a row for each pair of blocks and ``k`` rows for each query and block.

Vectors that are null or hold null or non-finite components take no part. An empty vector scores 0 with all; vectors of different lengths
meet in the terms that both have. Rows with the query's id are its own and no candidates of it; other repeated rows are candidates each. Of
query rows that share an id the one with the smallest vector is asked. A null id takes no part. Equal scores go to the smaller id. Scores are exact: a block whose scores may pass 64 bits is
added up in Python's integers, and a best score beyond them is an error (OverflowError). Empty tables and queries without candidates
give no rows. Other columns are not carried.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rulewright.llm.shared import give_back, written

#: Rows of a candidate block and of a query block.
BLOCK, QUERIES = 4096, 1024

PACKED_NAMES = ["ids", "ends", "terms", "weights", "wide"]
PACKED = "ids binary, ends binary, terms binary, weights binary, wide boolean"
FOUND = "query_id long, vec_id long, score long"


def integer_vectors(vectors: DataFrame, id_col: str, vector_col: str, scale: float) -> DataFrame:
    """(vec_id, v) with v = floor(scale * x) of each component, of the vectors that take part."""
    v = F.col(f"`{vector_col}`").cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    scaled = F.transform(v, lambda x: F.floor(F.lit(float(scale)) * x))
    return vectors.where(F.col(f"`{id_col}`").isNotNull() & v.isNotNull() & ~bad).select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), scaled.alias("v"))


@dataclass
class Sparse:
    """Rows by row (queries) or terms by term (postings): entries ``ends[i]`` to ``ends[i + 1]`` belong to i."""

    ids: np.ndarray
    ends: np.ndarray
    at: np.ndarray
    weights: np.ndarray

    @classmethod
    def unpacked(cls, row: dict) -> Sparse:
        kind = np.int64 if row["wide"] else np.int32
        return cls(np.frombuffer(row["ids"], np.int64), np.frombuffer(row["ends"], np.int64), np.frombuffer(row["terms"], np.int32), np.frombuffer(row["weights"], kind))

    def packed(self) -> tuple:
        wide = bool(len(self.weights)) and int(max(self.weights.max(), -self.weights.min())) > np.iinfo(np.int32).max
        return self.ids.tobytes(), self.ends.tobytes(), self.at.astype(np.int32).tobytes(), self.weights.astype(np.int64 if wide else np.int32).tobytes(), wide

    def part(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        a, b = self.ends[i : i + 2]
        return self.at[a:b], self.weights[a:b]


def rows_of(table: pa.Table) -> Sparse:
    """The sparse rows of (vec_id, v), zeros left out."""
    lists = table["v"].combine_chunks()
    lengths, values = np.diff(lists.offsets.to_numpy()), lists.flatten().to_numpy()
    row = np.repeat(np.arange(len(lengths)), lengths)
    term = np.arange(len(values)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    some = values != 0
    ends = np.concatenate([[0], np.cumsum(np.bincount(row[some], minlength=len(lengths)))]).astype(np.int64)
    return Sparse(table["vec_id"].to_numpy(), ends, term[some], values[some])


def postings_of(rows: Sparse) -> Sparse:
    """The postings of each term: places in ``ids``, which is in ascending order."""
    place = np.empty(len(rows.ids), np.int64)
    order = np.argsort(rows.ids, kind="stable")
    place[order] = np.arange(len(order))
    row = np.repeat(place, np.diff(rows.ends))
    by_term = np.lexsort((row, rows.at))
    ends = np.concatenate([[0], np.cumsum(np.bincount(rows.at))]).astype(np.int64)
    return Sparse(rows.ids[order], ends, row[by_term], rows.weights[by_term])


def block_best(query: Sparse, block: Sparse, k: int):
    """(query_id, vec_ids, scores) of each query row: its best k of the block, ties to the smaller id."""
    most = lambda s: max((abs(int(x)) for x in (s.weights.max(initial=0), s.weights.min(initial=0))), default=0)
    longest = int(np.diff(query.ends).max(initial=0))
    kind = np.int64 if most(query) * most(block) * max(longest, 1) < 1 << 62 else object
    weights = block.weights.astype(kind)
    for i, own in enumerate(query.ids.tolist()):
        scores = np.zeros(len(block.ids), kind)
        for term, w in zip(*query.part(i), strict=True):
            if term < len(block.ends) - 1:
                a, b = block.ends[term : term + 2]
                w = int(w)
                if b - a == len(scores):  # every row has the term
                    scores += w * weights[a:b]
                else:
                    scores[block.at[a:b]] += w * weights[a:b]
        at = np.nonzero(block.ids != own)[0]
        if len(at) > k:
            least = np.partition(scores[at], len(at) - k)[len(at) - k]
            above, equal = at[scores[at] > least], at[scores[at] == least]
            at = np.concatenate([above, equal[: k - len(above)]])  # places are in the order of ids
        if len(at):
            yield own, block.ids[at], scores[at]


def packed_blocks(rows: DataFrame, n_blocks: int, postings: bool) -> DataFrame:
    """One row for each of ``n_blocks`` evenly dealt partitions, numbered from 0; a partition without rows has none."""

    def pack(batches):
        held = [pa.Table.from_batches([b]) for b in batches if b.num_rows]
        if held:
            found = rows_of(pa.concat_tables(held))
            packed = (postings_of(found) if postings else found).packed()
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in packed], PACKED_NAMES)
        give_back()

    return rows.repartition(n_blocks).mapInArrow(pack, PACKED).withColumn("block", F.spark_partition_id())


def meet(batches, k: int):
    """The bests of every query in each candidate block, from rows sorted by (block, kind): candidates come first."""
    held, number = None, None
    for batch in batches:
        for row in batch.to_pylist():
            if row["kind"] == 0:
                held, number = Sparse.unpacked(row), row["block"]
            elif row["block"] == number:
                found = list(block_best(Sparse.unpacked(row), held, k))
                ids = np.repeat([q for q, _, _ in found], [len(x) for _, x, _ in found])
                of = lambda i: pa.array([x for f in found for x in f[i].tolist()], pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), of(1), of(2)], ["query_id", "vec_id", "score"])
    give_back()


def top_k(vectors: DataFrame, queries: DataFrame, k: int, scale: float = 256.0, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each id of ``queries`` the k rows of ``vectors`` with the largest inner products."""
    candidates = written(integer_vectors(vectors, id_col, vector_col, scale), "topk-vectors")
    asked = integer_vectors(queries, id_col, vector_col, scale).groupBy("vec_id").agg(F.min("v").alias("v"))
    asked = written(asked, "topk-queries")
    n_blocks, n_asked = (max(math.ceil(rows.count() / size), 1) for rows, size in ((candidates, BLOCK), (asked, QUERIES)))
    held = packed_blocks(candidates, n_blocks, postings=True).withColumn("kind", F.lit(0))
    passing = packed_blocks(asked, n_asked, postings=False).drop("block")
    passing = passing.withColumns({"block": F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))), "kind": F.lit(1)})
    dealt = held.unionByName(passing).repartition(n_blocks, "block").sortWithinPartitions("block", "kind")
    found = written(dealt.mapInArrow(lambda batches: meet(batches, k), FOUND), "topk-bests")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
