"""Near-duplicates of texts by MinHash: many universal hash minima, banding, verification, components.

Texts with equal shingle sets, told by a 128-bit digest, are one node. The minima of a node's set under multiply-shift hash
functions are cut into bands; nodes that agree in a band share a bucket. Nodes of a bucket are first compared with its
pivot, the node that shares most buckets with others. What is linked becomes one component, and only nodes of a bucket that
still lie in different components are then compared with each other, as pairs where a bucket has a few nodes, else in blocks of bounded
size inside the tasks: links inside a component can't change the result, so a bucket of a million copies costs a million comparisons, and no link between different
components is left out. Every comparison goes by signature first, with a margin of six standard deviations, and is
confirmed on the full sets. Within the banding (a pair at the threshold is missed with a probability of 1e-9 at
the defaults) the components are exact.

Null or empty text has an empty set and links with nothing; a null id stays alone. Rows with one id are one document: it
has the links of all its texts, and each of its rows its own n_shingles.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rulewright.llm.components import connected_components
from rulewright.llm.shared import give_back, sorted_groups, temporary_tables, text_slices, unique_name, written
from rulewright.llm.shingles import mix, set_digest, shingle_lanes

#: Rows of a band, chance to miss a pair at the threshold, nodes of an open bucket whose pairs become rows, rows of a block.
ROWS, MISS, FEW, BLOCK = 5, 1e-9, 8, 400


def band_count(threshold: float, rows: int = ROWS, miss: float = MISS) -> int:
    """Bands of so many rows, so that a pair at the threshold shares none with a probability of ``miss``."""
    return math.ceil(math.log(miss) / math.log1p(-(threshold**rows)))


class MinHasher:
    """Minima of a set of 64-bit hashes under ``size`` functions (a x + b mod 2^64) >> 32 of 32-bit keys."""

    def __init__(self, bands: int, rows: int):
        rng = np.random.Generator(np.random.PCG64(77))
        self.bands, self.rows, self.size = bands, rows, bands * rows
        self.a = (rng.integers(0, 2**63, self.size, np.uint64) * np.uint64(2) + np.uint64(1))[:, None]
        self.b = rng.integers(0, 2**64 - 1, self.size, np.uint64)[:, None]
        self.place = rng.integers(0, 2**63, rows, np.uint64) * np.uint64(2) + np.uint64(1)

    def minima(self, hashes: np.ndarray) -> np.ndarray:
        keys = hashes >> np.uint64(32)
        least = np.full(self.size, 2**64 - 1, np.uint64)
        for i in range(0, len(keys), 512):  # a tile stays in the cache
            tile = self.a * keys[None, i : i + 512]
            tile += self.b
            np.minimum(least, tile.min(axis=1), out=least)
        return least >> np.uint64(32)

    def band_keys(self, minima: np.ndarray) -> np.ndarray:
        """minima: (sets, size) -> (sets, bands) of 64 bits."""
        m = mix(minima.reshape(len(minima), self.bands, self.rows))
        return mix((m * self.place).sum(axis=2, dtype=np.uint64) + np.arange(self.bands, dtype=np.uint64))


def _features(docs: DataFrame, k: int, hasher: MinHasher) -> DataFrame:
    """(id, n_shingles, key1, key2, bands, signature): the digest of the whole set in two longs, the band keys, the minima's last bytes."""
    fields = "n_shingles long, key1 long, key2 long, bands array<long>, signature binary"
    schema = T.StructType([docs.schema["id"], *T.StructType.fromDDL(fields)])

    def run(batches):
        for batch in batches:
            for part in text_slices(batch):
                lanes = shingle_lanes([(t or "").encode() for t in part.column(1).to_pylist()], k)
                keys = np.frombuffer(b"".join(map(set_digest, lanes)), "<i8").reshape(-1, 2)
                minima = np.stack([hasher.minima(first) for first, _ in lanes])
                sizes = np.array([len(first) for first, _ in lanes], np.int64)
                bands = hasher.band_keys(minima).view(np.int64)[sizes > 0]
                ends = np.append(0, np.cumsum((sizes > 0) * hasher.bands)).astype(np.int32)
                signatures = [x.tobytes() for x in minima.astype(np.uint8)]
                columns = [
                    part.column(0),
                    pa.array(sizes),
                    pa.array(keys[:, 0]),
                    pa.array(keys[:, 1]),
                    pa.ListArray.from_arrays(pa.array(ends), pa.array(bands.ravel())),
                    pa.array(signatures, pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)
        give_back()

    return docs.mapInArrow(run, schema)


def _sets(docs: DataFrame, ids: DataFrame, k: int, repeats: bool) -> DataFrame:
    """(id, key1, key2, elements): the sorted hashes of the full sets of the documents with these ids, from their texts."""
    schema = T.StructType([docs.schema["id"], *T.StructType.fromDDL("key1 long, key2 long, elements binary")])

    def run(batches):
        for batch in batches:
            for part in text_slices(batch):
                lanes = shingle_lanes([(t or "").encode() for t in part.column(1).to_pylist()], k)
                keys = np.frombuffer(b"".join(map(set_digest, lanes)), "<i8").reshape(-1, 2)
                elements = pa.array([first.tobytes() for first, _ in lanes], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(keys[:, 0]), pa.array(keys[:, 1]), elements], names=schema.names)
        give_back()

    texts = docs.join(ids, "id", "left_semi")
    texts = texts.dropDuplicates(["id", "text"]) if repeats else texts
    return written(texts.mapInArrow(run, schema), "sets")


def _filter_pairs(pairs: DataFrame, test) -> DataFrame:
    """(u, v) of the rows (u, v, x binary, y binary) that pass ``test(x, y)``."""

    def run(batches):
        for batch in batches:
            xs, ys = batch.column(2), batch.column(3)
            ok = [test(np.frombuffer(x.as_buffer(), np.uint8), np.frombuffer(y.as_buffer(), np.uint8)) for x, y in zip(xs, ys)]
            yield batch.select([0, 1]).filter(pa.array(ok, pa.bool_()))
        give_back()

    return pairs.mapInArrow(run, T.StructType(pairs.schema.fields[:2]))


def _with_both(pairs: DataFrame, table: DataFrame, column: str) -> DataFrame:
    """pairs (u, v) with the column of u and that of v, by two joins that Spark can split."""
    left = table.select(F.col("id").alias("u"), F.col(column).alias("x"))
    right = table.select(F.col("id").alias("v"), F.col(column).alias("y"))
    return pairs.join(left, "u").join(right, "v").select("u", "v", "x", "y")


def _first_links(rows: pa.Table, percent: int, least_equal: float) -> tuple[np.ndarray, np.ndarray]:
    """The ids of the linked pairs between the two chunks of one group, one pair for each two labels.

    Only rows of different labels are compared: by signature first, each pair in the first band that the two share
    (they meet in all of them), then by the full sets, whose intersections one product of incidence matrices counts.
    """
    nothing = np.zeros(0, np.int64), np.zeros(0, np.int64)
    chunk, ids, label = (rows[c].to_numpy() for c in ("chunk", "id", "label"))
    a, b = np.flatnonzero(chunk == rows["low"][0].as_py()), np.flatnonzero(chunk == rows["high"][0].as_py())
    apart = label[a][:, None] != label[b][None, :]
    if not apart.any():
        return nothing
    signs = np.frombuffer(b"".join(rows["signature"].to_pylist()), np.uint8).reshape(len(ids), -1)
    bands, here = rows["bands"].combine_chunks().flatten().to_numpy().reshape(len(ids), -1), rows["band"][0].as_py()
    us, vs = [], []
    for i in np.flatnonzero(apart.any(axis=1)).tolist():
        others = b[apart[i]]
        others = others[(signs[others] == signs[a[i]]).sum(axis=1) >= least_equal]
        shared = bands[others] == bands[a[i]]
        others = others[bands[a[i]][shared.argmax(axis=1)] == here]
        us.append(np.full(len(others), a[i]))
        vs.append(others)
    u, v = np.concatenate(us), np.concatenate(vs)
    if not len(u):
        return nothing
    linked = 100 * (both := _intersections(rows, u, v)) >= percent * (_set_sizes(rows)[u] + _set_sizes(rows)[v] - both)
    u, v = u[linked], v[linked]
    two = np.stack([np.minimum(label[u], label[v]), np.maximum(label[u], label[v])])
    first = np.unique(two, axis=1, return_index=True)[1] if len(u) else []
    return ids[u[first]], ids[v[first]]


def _set_sizes(rows: pa.Table) -> np.ndarray:
    return pc.binary_length(rows["elements"]).to_numpy() // 8


def _intersections(rows: pa.Table, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the sets of the rows u and v, pair by pair."""
    left, at_left = np.unique(u, return_inverse=True)
    right, at_right = np.unique(v, return_inverse=True)
    of = lambda some: [np.frombuffer(rows["elements"][i].as_buffer(), np.uint64) for i in some.tolist()]
    xs, ys = of(left), of(right)
    both = np.zeros((len(left), len(right)), np.float32)
    values = np.intersect1d(np.concatenate(xs), np.concatenate(ys))
    for c in range(0, len(values), 8192):
        some = values[c : c + 8192]
        product = [np.stack([np.isin(some, x, assume_unique=True) for x in sets]).astype(np.float32) for sets in (xs, ys)]
        both += product[0] @ product[1].T
    return both[at_left, at_right].astype(np.int64)


def _bucket_links(batches, percent: int, least_equal: float):
    """Links (u, v) of rows (band, low, high, chunk, id, label, signature, bands, elements) sorted by (band, low, high)."""
    for t in sorted_groups(batches, ("band", "low", "high")):
        key = np.stack([t[c].to_numpy() for c in ("band", "low", "high")])
        start = np.flatnonzero(np.append(True, (key[:, 1:] != key[:, :-1]).any(axis=0)))
        found = [_first_links(t.slice(x, y - x), percent, least_equal) for x, y in zip(start.tolist(), [*start[1:].tolist(), t.num_rows])]
        u, v = (np.concatenate(x) for x in zip(*found))
        if len(u):
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(u, v)), pa.array(np.maximum(u, v))], names=["u", "v"])
    give_back()


def least_agreement(percent: int, size: int) -> float:
    """Least number of equal minima, of ``size``, of a pair that may reach the threshold: six standard deviations below its mean."""
    t = percent / 100
    return size * (t - 6 * math.sqrt(t * (1 - t) / size))


def _confirmed(docs: DataFrame, nodes: DataFrame, pairs: DataFrame, k: int, percent: int, least_equal: float, repeats: bool) -> DataFrame:
    """The links among the pairs (u, v) of nodes: likely ones by signature, then by the full sets of their texts."""

    def linked(x, y):
        x, y = x.view(np.uint64), y.view(np.uint64)
        both = len(np.intersect1d(x, y, assume_unique=True))
        return 100 * both >= percent * (len(x) + len(y) - both)

    with temporary_tables():
        likely = _filter_pairs(_with_both(pairs, nodes, "signature"), lambda x, y: int((x == y).sum()) >= least_equal)
        likely = written(likely.distinct() if repeats else likely, "likely")
        ids = likely.select(F.explode(F.array("u", "v")).alias("id")).distinct()
        sets = _sets(docs, written(ids, "likely-ids"), k, repeats)
        return written(_filter_pairs(_with_both(likely, sets, "elements"), linked).distinct(), "links", keep=True)


def _ordered(u, v) -> list:
    return [F.least(u, v).alias("u"), F.greatest(u, v).alias("v")]


def _open_buckets(members: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows (id, band, label), buckets (band, main, n_main, n)) of the buckets whose nodes lie in several components."""
    labelled = written(members.join(labels, "id", "left").select("id", "band", F.coalesce("component", "id").alias("label")), "labelled")
    per = labelled.groupBy("band", "label").agg(F.count("*").alias("n"))
    main = F.max_by("label", F.struct("n", "label")).alias("main")
    buckets = per.groupBy("band").agg(main, F.max("n").alias("n_main"), F.sum("n").alias("n"), F.count("*").alias("labels")).where("labels > 1")
    return labelled, written(buckets.drop("labels"), "open-buckets")


def _few_pairs(rows: DataFrame, buckets: DataFrame) -> DataFrame:
    """The pairs (u, v) of nodes of different components in open buckets of at most FEW nodes: FEW / 2 for a node at most."""
    few = rows.join(buckets.where(F.col("n") <= FEW).select("band"), "band")
    lists = few.groupBy("band").agg(F.sort_array(F.collect_set(F.struct("id", "label"))).alias("x"))
    each = F.transform("x", lambda a, i: F.transform(F.filter("x", lambda b, j: (j > i) & (b["label"] != a["label"])), lambda b: F.struct(a["id"].alias("u"), b["id"].alias("v"))))
    return written(lists.select(F.inline(F.flatten(each))).where("u <> v").distinct(), "few-pairs")


def _open_blocks(rows: DataFrame, buckets: DataFrame) -> DataFrame:
    """(band, low, high, chunk, id, label): larger open buckets, dealt into pairs of chunks.

    The nodes of a bucket's largest component meet all others but not each other; chunks have about BLOCK rows.
    """
    count = lambda n: F.ceil(n / BLOCK).cast("int")
    mains, others = count(F.col("n_main")).alias("mains"), count(F.col("n") - F.col("n_main")).alias("others")
    rows = rows.join(written(buckets.where(F.col("n") > FEW).select("band", "main", mains, others), "large-buckets"), "band")
    is_main = F.col("label") == F.col("main")
    dealt = F.pmod(F.xxhash64("id"), F.when(is_main, F.col("mains")).otherwise(F.col("others")))
    rows = rows.withColumn("chunk", F.when(is_main, dealt).otherwise(F.col("mains") + dealt).cast("int"))
    first, last = F.when(is_main, F.col("mains")).otherwise(0), F.col("mains") + F.col("others") - 1
    rows = rows.withColumn("other", F.explode(F.sequence(first, last)))
    rows = rows.select("band", F.least("chunk", "other").alias("low"), F.greatest("chunk", "other").alias("high"), "chunk", "id", "label")
    return written(rows, "blocks")


def _pivot_pairs(members: DataFrame) -> DataFrame:
    """Each node of a bucket with the bucket's pivot, the node that shares most buckets with others: linear in the bucket's size."""
    with temporary_tables():
        central = written(members.groupBy("id").agg(F.sum("n").alias("weight")), "central")
        most = F.max_by("id", F.struct("weight", -F.col("id")))
        pivots = written(members.join(central, "id").groupBy("band").agg(most.alias("pivot")), "pivots")
        met = members.join(pivots, "band").where("id <> pivot")
        return written(met.select(*_ordered("id", "pivot")).distinct(), "pairs", keep=True)


def _nodes(full: DataFrame) -> tuple[DataFrame, DataFrame, bool]:
    """(nodes (id, key1, key2, bands, signature), copies (u, v), whether an id has a set twice).

    A node is the smallest id of the rows with one set; a copy is another id with that set and its node. Only slim
    rows are shuffled; the bands move where an id has a set twice, since one of such rows is enough.
    """
    slim = full.groupBy("key1", "key2", "id").agg(F.count("*").alias("rows"))
    slim = written(slim, "sets-of-ids")
    shared = slim.groupBy("key1", "key2").agg(F.min("id").alias("node"), F.count("*").alias("ids")).where("ids > 1").drop("ids")
    copies = written(slim.join(written(shared, "classes"), ["key1", "key2"]).where("id <> node").select("id", "key1", "key2", "node"), "copies")
    nodes = full.select("id", "key1", "key2", "bands", "signature").join(copies.drop("node"), ["id", "key1", "key2"], "left_anti")
    twice = slim.where("rows > 1").select("id", "key1", "key2")
    repeats = not twice.isEmpty()
    if repeats:
        first = [F.first(c).alias(c) for c in ("bands", "signature")]
        some = nodes.join(twice, ["id", "key1", "key2"], "left_semi").groupBy("id", "key1", "key2").agg(*first)
        nodes = nodes.join(twice, ["id", "key1", "key2"], "left_anti").unionByName(some)
    return written(nodes, "nodes"), copies.select(F.col("id").alias("u"), F.col("node").alias("v")), repeats


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id) for every row: ids linked by 100 |A & B| >= percent |A | B| of k-word shingles, closed.

    A node is a set of shingles, named by the smallest id that has it; ids with several texts link their sets.
    The result is a written table; all others of the run are deleted.
    """
    docs = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    hasher = MinHasher(band_count(percent / 100), ROWS)
    least_equal = least_agreement(percent, hasher.size)
    with temporary_tables():
        features = written(_features(docs, k, hasher), "features")
        nodes, copies, repeats = _nodes(features.where("n_shingles > 0 AND id IS NOT NULL"))
        confirmed = lambda pairs: _confirmed(docs, nodes, pairs, k, percent, least_equal, repeats)

        members = nodes.select("id", F.explode("bands").alias("band"))
        shared = written(members.groupBy("band").agg(F.count("*").alias("n")).where("n > 1"), "shared-bands")
        members = written(members.join(shared, "band"), "members")
        labels = connected_components(copies.unionByName(confirmed(_pivot_pairs(members))))

        rows, buckets = _open_buckets(members, labels.withColumnRenamed("node", "id"))
        few = confirmed(_few_pairs(rows, buckets))
        blocks = _open_blocks(rows, buckets)
        ids = written(blocks.select("id").distinct(), "open-ids")
        sets = _sets(docs, ids, k, repeats)
        described = nodes.join(ids, "id", "left_semi").join(sets, ["id", "key1", "key2"]).select("id", "signature", "bands", "elements")
        group = ("band", "low", "high")
        wide = blocks.join(described, "id").select(*group, "chunk", "id", "label", "signature", "bands", "elements")
        wide = wide.repartition(*group).sortWithinPartitions(*group)
        more = written(wide.mapInArrow(lambda b: _bucket_links(b, percent, least_equal), "u long, v long").distinct(), "block-links")
        roots = labels.select(F.col("node").alias("u"), F.col("component").alias("v"))
        parts = connected_components(roots.unionByName(few).unionByName(more))
        found = features.select("id", "n_shingles").join(parts, F.col("id") == F.col("node"), "left")
        found = found.select(F.col("id").alias(id_col), "n_shingles", F.coalesce("component", "id").alias("component_id"))
        return written(found, "near-duplicates", keep=True)


def keep_one(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` without all but the smallest id of each group; rows with one id are one document,
    of which the row with the smallest text stays (any one of equal rows). Null ids and empty texts stay."""
    found = near_duplicates(docs, k, percent, id_col, text_col)
    id_ = F.col(f"`{id_col}`")
    name, row = unique_name("_gone", docs.columns), unique_name("_row", docs.columns)
    gone = found.where(F.col(id_col) != F.col("component_id")).select(F.col(id_col).alias(name)).distinct()
    kept = docs.join(written(gone, "gone"), id_ == F.col(name), "left_anti")
    twice = docs.where(id_.isNotNull()).groupBy(id_.alias(name)).agg(F.count("*").alias("n")).where("n > 1").select(name)
    twice = written(twice, "repeated-ids")
    if twice.isEmpty():
        return kept
    by_text = Window.partitionBy(f"`{id_col}`").orderBy(F.col(f"`{text_col}`").asc_nulls_first())
    first = kept.join(twice, id_ == F.col(name), "left_semi").withColumn(row, F.row_number().over(by_text))
    return kept.join(twice, id_ == F.col(name), "left_anti").unionByName(first.where(F.col(row) == 1).drop(row))
