"""Near-duplicates of embeddings: p-stable hashing of normalised vectors, exact cosine, components.

Equal vectors are one class first, so copies never meet each other. Each class's unit vector is rounded to 16-bit steps,
projected on quantised Gaussian directions, shifted and cut into cells of fixed width; vectors whose cells agree in a whole table
share a bucket. The projections are sums of whole numbers and so the same in every task. The projections of a table grow
with the logarithm of the number of classes, so that unrelated vectors rarely meet, and the tables with them, so that a
pair at the threshold is missed with the same small probability at every size.
Inside a bucket rows are dealt into blocks of bounded size and every pair of blocks is a group of its own, so that no task holds
a whole bucket and none is capped. A pair is told in the first table that it shares. The rounded vectors give its cosine within
a proven bound; where that bound decides, the task counts the link for both ends and keeps one chain of links for
each component of the group, so that a dense cluster makes no rows for its pairs. The pairs within the bound of
the threshold go by the cosine of the given vectors in double precision.

Vectors that are null, empty, zero or hold null or non-finite components link with nothing; a null id links with nothing;
vectors of different lengths are never compared. Each row is a vector of its own: rows with equal vectors count each other as
links, whatever their ids, and rows with one id are one node of the components. An empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rulewright.llm.components import connected_components
from rulewright.llm.shared import give_back, sorted_groups, temporary_tables, written

#: Cell width over the distance at the threshold, the chance to miss a pair at the threshold, rows of a block.
WIDTH, MISS, BLOCK = 4.0, 0.01, 1000
#: Steps of a rounded component, and of a projection's coefficient.
STEPS, LINE_STEPS = 32_767, 1 << 12


def cell_chance(distance: float, width: float) -> float:
    """Probability that a Gaussian projection puts two points of this distance into one cell."""
    r = width / distance
    normal = 0.5 * math.erfc(r / math.sqrt(2))
    return 1 - 2 * normal - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))


def plan_tables(cosine: float, n: int, miss: float = MISS) -> tuple[int, int]:
    """(projections of a table, tables) for n vectors: orthogonal vectors meet about once in a table of n."""
    far = cell_chance(math.sqrt(2) / math.sqrt(2 - 2 * cosine), WIDTH)
    k = max(6, round(math.log(max(n, 2)) / -math.log(far)))
    return k, math.ceil(math.log(miss) / math.log1p(-(cell_chance(1.0, WIDTH) ** k)))


def error_bound(dim: int) -> float:
    """Most by which the product of two rounded unit vectors differs from that of the vectors: half a step in each component, on either side."""
    off = 0.5 * math.sqrt(dim) / STEPS
    return 2 * off + off * off + 1e-12


class Tables:
    """The hash tables for vectors of one length."""

    def __init__(self, dim: int, cosine: float, k: int, tables: int):
        rng = np.random.Generator(np.random.PCG64([dim, 5]))
        self.shape = tables, k
        self.lines = np.rint(rng.standard_normal((dim, tables * k)) * LINE_STEPS)
        self.width = WIDTH * math.sqrt(2 - 2 * cosine) * STEPS * LINE_STEPS
        self.shift, self.place = rng.random(tables * k), rng.integers(0, 2**62, k) * 2 + 1
        self.dim = dim

    def buckets(self, codes: np.ndarray) -> np.ndarray:
        """(rows, tables) of 64 bits for rounded vectors. All sums are whole numbers below 2^53, so their order doesn't matter."""
        cells = np.floor(codes.astype(float) @ self.lines / self.width + self.shift).astype(np.int64).reshape(len(codes), *self.shape)
        with np.errstate(over="ignore"):
            return ((cells * 0x9E3779B1 + 12345) * self.place).sum(axis=2) * 31 + np.arange(self.shape[0]) * 1_000_003 + self.dim


def _hashed(vectors: DataFrame, cosine: float, k: int, tables: int) -> DataFrame:
    """(class, n, code binary, buckets array<long>): the rounded unit vector and its bucket in each table."""

    def run(batches):
        made: dict[int, Tables] = {}
        for batch in batches:
            sizes = batch.column(2).value_lengths().to_numpy()
            for dim in np.unique(sizes).tolist():
                rows = np.flatnonzero(sizes == dim)
                of = made.setdefault(dim, None) or Tables(dim, cosine, k, tables)
                made[dim] = of
                for at in range(0, len(rows), 500):
                    part = batch.take(pa.array(rows[at : at + 500]))
                    x = part.column(2).flatten().to_numpy().reshape(-1, dim)
                    # powers of two keep both very small and very large vectors in range and change no digit
                    x = np.ldexp(x, -np.frexp(np.abs(x).max(axis=1))[1][:, None])
                    codes = np.rint(x / np.linalg.norm(x, axis=1)[:, None] * STEPS).astype("<i2")
                    keys = of.buckets(codes)
                    ends = pa.array(np.arange(0, keys.size + 1, tables, dtype=np.int32))
                    columns = [part.column(0), part.column(1), pa.array([c.tobytes() for c in codes], pa.binary()), pa.ListArray.from_arrays(ends, pa.array(keys.ravel()))]
                    yield pa.RecordBatch.from_arrays(columns, names=["class", "n", "code", "buckets"])

    return vectors.mapInArrow(run, "class long, n long, code binary, buckets array<long>")


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (node, smallest node reached) that connect what the links (u, v) connect, fewer than there are nodes."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    label = np.arange(len(nodes))
    while True:
        least = np.minimum(label[a], label[b])
        after = label.copy()
        np.minimum.at(after, a, least)
        np.minimum.at(after, b, least)
        after = after[after]
        if (after == label).all():
            break
        label = after
    tail = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[tail], nodes[label[tail]]


COUNT, LINK, UNSURE = 0, 1, 2


def _close_pairs(batches, cosine: float, k: int, tables: int):
    """(kind, u, v) of rows (bucket, low, high, block, table, class, n, code) sorted by their group: COUNT, a class and how many
    rows it links with; LINK, two classes of one component; UNSURE, two classes whose cosine the bound doesn't decide."""
    made: dict[int, Tables] = {}

    def pairs_of(group: np.ndarray, start: np.ndarray, size: np.ndarray, codes: np.ndarray, block: np.ndarray, low: np.ndarray, least: float):
        """Row numbers of the pairs of each group, one row of either block, that reach ``least``."""
        few = np.repeat(size <= 8, size)
        for d in range(1, min(8, int(size.max(initial=0)))):
            i = np.flatnonzero(few[:-d] & (group[d:] == group[:-d]))
            yield i[np.einsum("ij,ij->i", codes[i], codes[i + d]) >= least], d
        for g in np.flatnonzero(size > 8).tolist():
            at = np.arange(start[g], start[g] + size[g])
            a, b = at[block[at] == low[start[g]]], at[block[at] != low[start[g]]]
            same = not len(b)
            i, j = np.nonzero(codes[a] @ codes[a if same else b].T >= least)
            i, j = (i[i < j], j[i < j]) if same else (i, j)
            yield a[i], (a if same else b)[j] - a[i]

    def compare(t: pa.Table):
        raw = t["code"].combine_chunks()
        lens = pc.binary_length(raw).to_numpy() // 2
        for dim in np.unique(lens).tolist():
            rows = t.filter(pa.array(lens == dim)) if (lens != dim).any() else t
            key = np.stack([rows[c].to_numpy() for c in ("bucket", "low", "high")])
            start = np.flatnonzero(np.append(True, (key[:, 1:] != key[:, :-1]).any(axis=0)))
            size = np.diff(np.append(start, rows.num_rows))
            whole = np.frombuffer(b"".join(rows["code"].to_pylist()), "<i2").reshape(-1, dim)
            codes, bound = whole / STEPS, error_bound(dim)
            found = [(i, i + d) for i, d in pairs_of(np.repeat(np.arange(len(size)), size), start, size, codes, rows["block"].to_numpy(), key[1], cosine - bound)]
            u, v = (np.concatenate(x) if found else np.zeros(0, np.int64) for x in (zip(*found) if found else ((), ())))
            if not len(u):
                continue
            if dim not in made:
                made[dim] = Tables(dim, cosine, k, tables)
            involved, at = np.unique(np.concatenate([u, v]), return_inverse=True)
            buckets = np.concatenate([made[dim].buckets(whole[involved[i : i + 500]]) for i in range(0, len(involved), 500)])
            x, y = at[: len(u)], at[len(u) :]
            first = np.concatenate([(buckets[x[i : i + 20_000]] == buckets[y[i : i + 20_000]]).argmax(axis=1) for i in range(0, len(x), 20_000)])
            here = first == rows["table"].to_numpy()[u]
            u, v = u[here], v[here]
            sure = np.einsum("ij,ij->i", codes[u], codes[v]) >= cosine + bound
            ids, n = rows["class"].to_numpy(), rows["n"].to_numpy()
            yield UNSURE, ids[u[~sure]], ids[v[~sure]]
            u, v = u[sure], v[sure]
            ends, back = np.unique(ids[np.concatenate([u, v])], return_inverse=True)
            yield COUNT, ends, np.bincount(back, np.concatenate([n[v], n[u]]), len(ends)).astype(np.int64)
            yield LINK, *forest(ids[u], ids[v])

    for t in sorted_groups(batches, ("bucket", "low", "high")):
        for kind, u, v in compare(t):
            if len(u):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(u), kind, np.int32)), pa.array(u), pa.array(v)], names=["kind", "u", "v"])
    give_back()


def _dealt(hashed: DataFrame) -> DataFrame:
    """(bucket, low, high, block, table, class, n, code): shared buckets dealt into pairs of blocks, in groups for the tasks."""
    keyed = hashed.select("class", F.posexplode("buckets").alias("table", "bucket"))
    shared = written(keyed.groupBy("bucket").agg(F.count("*").alias("rows")).where("rows > 1"), "shared-buckets")
    keyed = keyed.join(shared, "bucket").withColumn("blocks", F.ceil(F.col("rows") / BLOCK).cast("int"))
    keyed = keyed.withColumn("block", F.pmod(F.xxhash64("class"), "blocks").cast("int"))
    keyed = keyed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    keyed = keyed.select("bucket", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "table", "class")
    group = ("bucket", "low", "high")
    rows = keyed.join(hashed.select("class", "n", "code"), "class").select(*group, "block", "table", "class", "n", "code")
    return rows.repartition(*group).sortWithinPartitions(*group)


def _cosine(a: np.ndarray, b: np.ndarray) -> float:
    a, b = (np.ldexp(x, -int(np.frexp(np.abs(x).max())[1])) for x in (a, b))
    return float(a @ b / (math.sqrt(a @ a) * math.sqrt(b @ b)))


def embedding_links(classes: DataFrame, cosine: float) -> tuple[DataFrame, DataFrame]:
    """(counts (class, others), links (u, v)) of classes (class, n, vector): how many rows of other classes each class
    links with, and links that connect what all links do."""
    k, tables = plan_tables(cosine, classes.count())
    hashed = written(_hashed(classes.select("class", "n", "vector"), cosine, k, tables), "buckets")
    found = written(_dealt(hashed).mapInArrow(lambda b: _close_pairs(b, cosine, k, tables), "kind int, u long, v long"), "close-pairs")

    def confirm(batches):
        for batch in batches:
            ok = [_cosine(a.values.to_numpy(), b.values.to_numpy()) >= cosine for a, b in zip(batch.column("x"), batch.column("y"))]
            yield batch.select(["u", "v", "n_u", "n_v"]).filter(pa.array(ok, pa.bool_()))

    x = classes.select(F.col("class").alias("u"), F.col("vector").alias("x"), F.col("n").alias("n_u"))
    y = classes.select(F.col("class").alias("v"), F.col("vector").alias("y"), F.col("n").alias("n_v"))
    unsure = found.where(F.col("kind") == UNSURE).select("u", "v").join(x, "u").join(y, "v").select("u", "v", "n_u", "n_v", "x", "y")
    exact = written(unsure.mapInArrow(confirm, "u long, v long, n_u long, n_v long"), "exact-links")
    both = F.inline(F.array(F.struct(F.col("u").alias("class"), F.col("n_v").alias("others")), F.struct(F.col("v").alias("class"), F.col("n_u").alias("others"))))
    counts = found.where(F.col("kind") == COUNT).select(F.col("u").alias("class"), F.col("v").alias("others")).unionByName(exact.select(both))
    counts = counts.groupBy("class").agg(F.sum("others").alias("others"))
    return counts, found.where(F.col("kind") == LINK).select("u", "v").unionByName(exact.select("u", "v"))


def near_duplicate_vectors(df: DataFrame, cosine: float = 0.9, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, n_links, component_id) for every row, as a written table; n_links counts copies without making their pairs."""
    vector = F.col("vector")
    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vector_col}`").cast("array<double>").alias("vector"))
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    sound = F.col("id").isNotNull() & (F.size(vector) > 0) & finite & F.exists(vector, lambda x: x != 0)
    rows = rows.withColumn("sound", F.coalesce(sound, F.lit(False))).withColumn("vector", F.transform(vector, lambda x: x + 0.0))
    with temporary_tables():
        given = rows.where("sound")
        classes = given.groupBy("vector").agg(F.min("id").alias("least"), F.max("id").alias("most"), F.count("*").alias("n"))
        classes = written(classes.withColumn("class", F.monotonically_increasing_id()), "vector-classes")
        by_hash = classes.select(F.xxhash64("vector").alias("h"), F.col("vector").alias("v"), "class")
        members = given.withColumn("h", F.xxhash64("vector")).join(by_hash, "h").where("vector = v").select("id", "class")
        members = written(members, "vector-members")
        counts, links = embedding_links(classes, cosine)

        of_id = members.groupBy("id").agg(F.min("class").alias("u"), F.max("class").alias("last")).where("u < last").select("id", "u")
        same_id = members.join(written(of_id, "ids-of-several"), "id").select("u", F.col("class").alias("v"))
        parts = connected_components(links.unionByName(same_id)).withColumnRenamed("node", "class")
        named = classes.select("class", "least", "n").join(parts, "class", "left").withColumn("component", F.coalesce("component", "class"))
        named = written(named, "vector-parts")
        names = written(named.groupBy("component").agg(F.min("least").alias("component_id")), "vector-names")
        per_class = named.join(names, "component").join(written(counts, "vector-counts"), "class", "left")
        n_links = (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("n_links")
        per_class = written(per_class.select("class", n_links, "component_id"), "vector-results")
        linked = members.join(per_class, "class").select(F.col("id").alias(id_col), "n_links", "component_id")
        alone = rows.where("NOT sound").select(F.col("id").alias(id_col), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
        first = linked.groupBy(id_col).agg(F.min("component_id").alias("_component"))
        alone = alone.join(first, id_col, "left").select(id_col, "n_links", F.coalesce("_component", "component_id").alias("component_id"))
        return written(linked.unionByName(alone), "near-duplicate-vectors", keep=True)
