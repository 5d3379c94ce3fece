"""Best-fit packing of documents into sequences of a fixed number of tokens.

The method works in bulk-synchronous rounds on documents and gaps sorted by size. Sizes are whole numbers up to the
capacity, so both are held as runs: documents of one size with consecutive ranks, and gaps of one room with consecutive
sequences. A round takes the sizes between two fractions of the capacity, the largest left first. Documents and gaps
are dealt to ranges of their size; each range is swept for every document's successor, the smallest gap that
holds it; conflicts go by rank; what a range can't match is swept again over all ranges together. Then the gaps are
updated, sequences open for documents that no gap holds, and the next round begins. Documents for which this round made
much better gaps wait for the next one. A round is exactly single-document best fit over the gaps it began with.
The number of runs depends on the capacity, not on the number of documents. Ranks come from a distributed counting sort,
and one join deals every document its place.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rulewright.llm.lib_tokens import lib_encoder
from rulewright.llm.shared import give_back, new_path, written

#: Ranges of sizes that a round deals its runs to. A document waits if a gap made in its round would hold it WAIT times,
#: unless it is smaller than the capacity by a factor of WAIT_BELOW.
RANGES, WAIT, WAIT_BELOW = 8, 5, 10


def cut(n_tokens: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: only longer ones are cut, and the first piece takes the remainder."""
    if not n_tokens:
        return []
    first = (n_tokens - 1) % capacity + 1
    return [(0, first)] + [(a, capacity) for a in range(first, n_tokens, capacity)]


def tokenized_pieces(docs: DataFrame, tokenizer_path: str, end_id: int | None, capacity: int, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """(id, piece, start, length, ids_crc32, part, local_rank[, ids]) as a written table.

    ``local_rank`` numbers the pieces of one length within the task ``part`` that wrote them.
    Null text is empty: the end id alone. Repeated rows are pieces of their own. Narrow: no shuffle.
    """
    spark = docs.sparkSession
    with open(tokenizer_path, encoding="utf-8") as f:
        content = spark.sparkContext.broadcast(f.read())
    fields = [T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType()), T.StructField("part", T.IntegerType()), T.StructField("local_rank", T.LongType())]
    if with_ids:
        fields.append(T.StructField("ids", T.ArrayType(T.IntegerType())))
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int32())]

    def run(batches):
        encode, part, seen = lib_encoder(content.value), TaskContext.get().partitionId(), [0] * (capacity + 1)
        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                rows = batch.slice(a, 500)
                flat, lens = encode([t or "" for t in rows.column(1).to_pylist()])
                if end_id is not None:
                    flat, lens = np.insert(flat, np.cumsum(lens), end_id), lens + 1
                flat, out, owner, base = flat.astype("<u4"), [], [], 0
                for row, n in enumerate(lens.tolist()):
                    for piece, (start, length) in enumerate(cut(n, capacity)):
                        ids = flat[base + start : base + start + length]
                        out.append((piece, start, length, zlib.crc32(ids), part, seen[length], ids.tolist() if with_ids else None))
                        seen[length] += 1
                        owner.append(row)
                    base += n
                if out:
                    cols = [pa.array(c, k) for c, k in zip(list(zip(*out))[: len(fields)], kinds)]
                    yield pa.RecordBatch.from_arrays([rows.column(0).take(pa.array(owner, pa.int64())), *cols], names=[id_col, *(f.name for f in fields)])
        give_back()

    schema = T.StructType([docs.schema[id_col], *fields])
    return written(docs.select(id_col, text_col).mapInArrow(run, schema), "pieces")


class Round(NamedTuple):
    """What a round of the packing is told: its sizes (low, high], the capacity, and the sequences opened so far."""

    low: int
    high: int
    capacity: int
    opened: int


def size_class(size: int, capacity: int) -> tuple[int, int]:
    """The class (low, high] of a size: between fractions of the capacity, halves below the eighth."""
    parts = [*range(1, 9), *(2**i for i in range(4, 40))]
    bounds = [capacity // p for p in parts if capacity // p]
    high = min(b for b in bounds if b >= size)
    return max((b for b in bounds if b < high), default=0), high


def sweep(documents: list[tuple], gaps: list[tuple]) -> tuple[list[tuple], list[tuple], list[tuple]]:
    """(matches, documents left, gaps left): each document takes the smallest gap that holds it.

    ``documents`` are runs (size, first rank, n), ``gaps`` runs (room, first sequence, n). Conflicts go by rank: larger
    documents first, then smaller ranks. Documents of one size fill a gap as often as they fit. A match is
    (size, first rank, n, room, first sequence, documents in each gap).
    """
    gaps, matches, left = sorted(gaps), [], []
    for size, first, n in sorted(documents, key=lambda d: (-d[0], d[1])):
        while n:
            at = bisect_left(gaps, (size,))
            if at == len(gaps):
                left.append((size, first, n))
                break
            room, sequence, free = gaps[at]
            each = room // size
            used = min(free, -(-n // each))
            placed = min(n, used * each)
            matches.append((size, first, placed, room, sequence, each))
            first, n = first + placed, n - placed
            if used == free:
                del gaps[at]
            else:
                gaps[at] = (room, sequence + used, free - used)
    return matches, left, gaps


def settle(matches: list[tuple], documents: list[tuple], gaps: list[tuple], r: Round) -> tuple[list[tuple], list[tuple], list[tuple]]:
    """(matches that hold, documents left, gaps): the gaps after a round.

    From the first size on that a gap made by larger documents of this round would hold WAIT times or more, documents wait for the
    next round. Only when none waits, new sequences open for those that no gap holds.
    """
    matches = sorted(matches, key=lambda m: (-m[0], m[1]))
    documents, gaps, held = list(documents), list(gaps), []
    made, stopped = 0, False
    for i, (size, first, n, room, sequence, each) in enumerate(matches):
        if i and size < matches[i - 1][0]:
            stopped = stopped or (size * WAIT_BELOW >= r.capacity and made >= WAIT * size)
        used, (full, rest) = -(-n // each), divmod(n, each)
        if stopped:
            documents.append((size, first, n))
            gaps.append((room, sequence, used))
            continue
        held.append((size, first, n, room, sequence, each))
        for count, begin, inside in ((full, sequence, each), (min(rest, 1), sequence + full, rest)):
            after = room - inside * size
            if count:
                made = max(made, after)
                if after:
                    gaps.append((after, begin, count))
    if documents and not stopped:
        inside = r.capacity // max(size for size, _, _ in documents)
        gaps.append((r.capacity, r.opened, -(-sum(n for _, _, n in documents) // inside)))
    return held, documents, gaps


DOCUMENT, GAP, MATCH = ("size", "first", "n"), ("room", "sequence", "n"), ("size", "first", "n", "room", "sequence", "each")
STATE = "kind string, " + ", ".join(f"{c} long" for c in MATCH)


def _of_kinds(rows: pd.DataFrame) -> list[list[tuple]]:
    """The matches, documents and gaps of a part of the state."""
    kinds = (("match", MATCH), ("document", DOCUMENT), ("gap", GAP))
    return [list(rows.loc[rows["kind"] == kind, list(fields)].itertuples(index=False, name=None)) for kind, fields in kinds]


def _state(matches: list[tuple], documents: list[tuple], gaps: list[tuple]) -> pd.DataFrame:
    rows = [("match", *m) for m in matches]
    rows += [("document", *d, 0, 0, 0) for d in documents]
    rows += [("gap", 0, 0, n, room, sequence, 0) for room, sequence, n in gaps]
    return pd.DataFrame(rows, columns=["kind", *MATCH])


def _superstep(state: DataFrame, r: Round) -> DataFrame:
    """One round over the runs of documents and gaps: sweeps inside ranges of sizes, then one over what the ranges leave.

    The class's documents and the gaps that hold one are dealt to ranges of their size. What matches inside its range
    matches so in the whole, since no smaller document comes before and no larger one takes so small a gap.
    """
    at = F.when(F.col("kind") == "document", F.col("size")).otherwise(F.col("room"))
    ranges = F.floor((at - 1) * RANGES / r.capacity)
    now = ((F.col("kind") == "document") & (F.col("size") > r.low)) | ((F.col("kind") == "gap") & (F.col("room") > r.low))

    def inside(rows: pd.DataFrame) -> pd.DataFrame:
        return _state(*sweep(*_of_kinds(rows)[1:]))

    def across(rows: pd.DataFrame) -> pd.DataFrame:
        matches, documents, gaps = _of_kinds(rows)
        more, documents, gaps = sweep(documents, gaps)
        return _state(*settle(matches + more, documents, gaps, r))

    swept = state.where(now).groupBy(ranges.alias("range")).applyInPandas(inside, STATE)
    return swept.groupBy().applyInPandas(across, STATE).unionByName(state.where(~now))


def place_runs(counts: DataFrame, capacity: int) -> DataFrame:
    """Matches (size, first, n, room, sequence, each) for all documents of ``counts`` (length, n).

    The rounds repeat until no document is left. Each writes its state, whose rows depend on the capacity
    and not on the number of documents; the driver holds the largest size left and the number of sequences.
    """
    spark = counts.sparkSession
    folder = new_path(spark, "packing-rounds")
    zero = [F.lit(0).cast("long").alias(c) for c in ("room", "sequence", "each")]
    state = counts.select(F.lit("document").alias("kind"), F.col("length").cast("long").alias("size"), F.lit(0).cast("long").alias("first"), F.col("n").cast("long").alias("n"), *zero)
    largest, opened, step = counts.agg(F.max("length")).first()[0], 0, 0
    while largest:
        r = Round(*size_class(largest, capacity), capacity, opened)
        told = Observation()
        is_new = (F.col("kind") == "gap") & (F.col("sequence") >= opened)
        left = F.max(F.when(F.col("kind") == "document", F.col("size")))
        after = _superstep(state, r).observe(told, left.alias("largest"), F.max(F.when(is_new, F.col("sequence") + F.col("n"))).alias("opened"))
        after.write.parquet(f"{folder}/round={step}")
        largest, opened, step = told.get["largest"], told.get["opened"] or opened, step + 1
        state = spark.read.schema(STATE).parquet(f"{folder}/round={step - 1}").where("kind <> 'match'")
    if not step:
        return spark.createDataFrame([], STATE).drop("kind")
    return spark.read.schema(STATE).parquet(*[f"{folder}/round={i}" for i in range(step)]).where("kind = 'match'").drop("kind")


def pack_pieces(pieces: DataFrame, capacity: int) -> DataFrame:
    """Adds sequence_id and offset to a written table of pieces and drops part and local_rank.

    A piece's rank among those of its length is its rank in its task plus the pieces of the tasks before. One join of
    slim rows deals the places; Spark broadcasts the matches by their measured size.
    """
    by_part = written(pieces.groupBy("part", "length").agg(F.count("*").alias("n")), "piece-counts")
    runs = place_runs(by_part.groupBy("length").agg(F.sum("n").alias("n")), capacity)
    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = by_part.select("part", "length", before.alias("base"))
    ranked = pieces.join(bases, ["part", "length"]).withColumn("rank", F.col("base") + F.col("local_rank"))
    at = (F.col("length") == F.col("size")) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("first") + F.col("n"))
    index = F.col("rank") - F.col("first")
    places = {
        "sequence_id": F.col("sequence") + F.floor(index / F.col("each")),
        "offset": F.lit(capacity) - F.col("room") + index % F.col("each") * F.col("size"),
    }
    gone = ("part", "local_rank", "base", "rank", *MATCH)
    return ranked.join(runs, at).withColumns(places).drop(*gone)


def pack_documents(docs: DataFrame, tokenizer_path: str, end_id: int | None = 2, capacity: int = 1024, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """(id, piece, start, length, ids_crc32[, ids], sequence_id, offset) of all documents; an empty table gives none."""
    return pack_pieces(tokenized_pieces(docs, tokenizer_path, end_id, capacity, id_col, text_col, with_ids), capacity)


def assemble_sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids) from pieces packed with ids; a group holds at most the capacity."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda x: x["ids"])).alias("ids"))
