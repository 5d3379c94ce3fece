"""Gradient-boosted trees by histograms, as Spark sums, that can go on from trees fitted before.

A fit cuts each feature at its quantiles into at most ``BINS`` bins and packs the rows into blocks. Every level of a tree is one job: tasks add up
gradients, second derivatives and rows by (node, feature, bin) for their blocks, features are dealt out and added up, and each gives its best cut of
every node, so the driver gets a row for each node and feature, whatever the number of rows. The driver holds the trees.

Trees grow level by level to ``max_depth``, or best first to ``max_leaves`` leaves. Best first takes the cuts in the order of the smallest gain on the
way to them, so a level looks only at nodes that can still be among the first ``max_leaves - 1``. Rows and features of a tree are drawn by
share, rows by a hash of what they hold, so that equal rows are drawn together and the partitions don't matter. A round starts with a pass that adds the
last tree to the rows' margins and lays out what the round's levels read: bins of the drawn rows and features, gradients and second derivatives. It is kept
in memory for the round, and written every ``SNAPSHOT`` rounds. A task goes through several blocks and sends one sum for each node and feature, so what
is shuffled grows with the tasks and not with the blocks.
Where the tasks that can run at once hold all rows (``HELD_BYTES`` each), one barrier job runs all rounds instead: a task keeps its rows' bins and margins,
and the tasks exchange a level's sums through the shared folder and take the same cuts from them. There, features of two bins that no row has in the upper one together share a
column, and of two children only the smaller is added up, the other being what is left of their parent.
With ``start`` the first margins are those of its trees, which the result keeps.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import BarrierTaskContext
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rulewright.sources.scratch import file_system, job_settings, scratch_table, temporary_tables, written

#: Most bins of a feature, rows of a block, rounds between two writings of the margins.
BINS, BLOCK_ROWS, SNAPSHOT = 255, 50_000, 32
#: Fewest and most blocks of a task, as far as the cores allow, and the bytes of sums that a task adds up, about. A task takes a tenth of a second to start.
BLOCKS_OF_TASK, SUMS_OF_TASK = (4, 40), 16 << 20
#: Bytes that a task holds of its rows through all rounds, and of a row besides its bins; bytes of a level's sums of all tasks, which each of them gets.
HELD_BYTES, HELD_ROW, HELD_SUMS = 320 << 20, 150, 64 << 20

BLOCK = "n int, bins binary, y binary, w binary, key binary, margin binary"
#: A block with what its round reads: bins (feature by feature), gradients and second derivatives of the m drawn rows.
ROUND = f"{BLOCK}, m int, part binary, g binary, h binary"
SUMS = "feature int, sums binary"
TREE = "feature array<int>, bin array<int>, threshold array<double>, left array<int>, right array<int>, value array<double>"
CUTS = "node int, feature int, bin int, gain double, g_left double, h_left double, n_left long, g double, h double, n long"


@dataclass
class Tree:
    """Node i goes left where its feature's bin is at most ``bin[i]``, i.e. its value at most ``threshold[i]``; a leaf has feature -1."""

    feature: list[int] = field(default_factory=list)
    bin: list[int] = field(default_factory=list)
    threshold: list[float] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)
    value: list[float] = field(default_factory=list)

    def leaf(self, value: float) -> int:
        for column, x in ((self.feature, -1), (self.bin, 0), (self.threshold, 0.0), (self.left, -1), (self.right, -1), (self.value, value)):
            column.append(x)
        return len(self.feature) - 1

    def nodes_of(self, values: np.ndarray, by_bin: bool) -> np.ndarray:
        """The leaf of each row of bins or values."""
        feature, left, right = np.array(self.feature), np.array(self.left), np.array(self.right)
        limit = np.array(self.bin if by_bin else self.threshold)
        return _descend(len(values), feature, limit, left, right, lambda rows, j: values[rows, j])

    def margins(self, values: np.ndarray, by_bin: bool = False) -> np.ndarray:
        return np.array(self.value)[self.nodes_of(values, by_bin)]

    def depth(self) -> int:
        below = [0] * len(self.feature)
        for i in reversed(range(len(self.feature))):
            if self.feature[i] >= 0:
                below[i] = 1 + max(below[self.left[i]], below[self.right[i]])
        return below[0]


def _descend(n: int, feature: np.ndarray, limit: np.ndarray, left: np.ndarray, right: np.ndarray, value) -> np.ndarray:
    """The leaf of each of ``n`` rows; ``value`` gives the values of rows and features. Rows that have arrived are left alone."""
    out = np.zeros(n, np.int64)
    if feature[0] < 0:
        return out
    rows, at = np.arange(n), out
    while len(rows):
        at = np.where(value(rows, feature.take(at)) <= limit.take(at), left.take(at), right.take(at))
        out[rows] = at
        on = np.flatnonzero(feature.take(at) >= 0)
        rows, at = rows.take(on), at.take(on)
    return out


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(x / 2))


@dataclass
class BoostedTrees:
    trees: list[Tree]
    features_col: str = "features"

    def transform(self, df: DataFrame) -> DataFrame:
        """``df`` with ``margin``, ``probability_1`` and ``prediction``; trees are as large as rounds and leaves make them."""
        trees = [tuple(np.array(c) for c in (t.feature, t.threshold, t.left, t.right, t.value)) for t in self.trees]

        @F.pandas_udf(T.DoubleType())
        def margin(features: pd.Series) -> pd.Series:
            values = np.stack(features.to_list()) if len(features) else np.zeros((0, 1))
            flat, d, out = values.reshape(-1), values.shape[1], np.zeros(len(values))
            for *tree, value in trees:
                out += value.take(_descend(len(values), tree[0], tree[1], tree[2], tree[3], lambda rows, j: flat.take(rows * d + j)))
            return pd.Series(out)

        scored = df.withColumn("margin", margin(as_array(df, self.features_col)))
        return scored.withColumns({"probability_1": 1 / (1 + F.exp(-F.col("margin"))), "prediction": (F.col("margin") > 0).cast("double")})


def as_array(df: DataFrame, name: str):
    return F.col(f"`{name}`") if isinstance(df.schema[name].dataType, T.ArrayType) else vector_to_array(F.col(f"`{name}`"))


def drawn_rows(key: np.ndarray, round_: int, seed: int, share: float) -> np.ndarray:
    """Whether each row is in the tree's sample: its key, mixed with round and seed to 64 even bits."""
    with np.errstate(over="ignore"):
        x = key.view(np.uint64) + np.uint64((round_ * 0x9E3779B97F4A7C15 + seed * 0xD1B54A32D192ED03) % 2**64)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
        x = x ^ (x >> np.uint64(31))
    return x.astype(np.float64) < share * 2.0**64


@dataclass(frozen=True)
class Boosting:
    rounds: int
    step: float
    max_depth: int | None = None
    max_leaves: int | None = None
    row_share: float = 0.8
    column_share: float = 0.8
    l2: float = 1.0
    least_hessian: float = 1.0
    least_rows: int = 1
    seed: int = 42
    label_col: str = "label"
    features_col: str = "features"
    weight_col: str | None = None

    def fit(self, rows: DataFrame, start: BoostedTrees | None = None) -> BoostedTrees:
        first = start.trees if start else []
        with temporary_tables():
            values = as_array(rows, self.features_col)
            weight = F.col(f"`{self.weight_col}`").cast("double") if self.weight_col else F.lit(1.0)
            slim = written(rows.select(values.alias("x"), F.col(f"`{self.label_col}`").cast("double").alias("y"), weight.alias("w"), F.xxhash64(values, F.col(f"`{self.label_col}`").cast("double")).alias("key")), "boosting-rows")
            size = slim.agg(F.max(F.size("x")).alias("d"), F.count("*").alias("n")).first()
            if not size["n"]:
                raise ValueError("no rows to fit")
            edges = bin_edges(slim, size["d"])
            n_blocks = -(-size["n"] // BLOCK_ROWS)
            n_tasks = _tasks(n_blocks, rows.sparkSession.sparkContext.defaultParallelism)
            held = self._held_tasks(rows.sparkSession, size["n"], edges)
            if held:
                return BoostedTrees([*first, *self._rounds_held(slim, held, edges, first)], self.features_col)
            blocks, trees = self._written(_blocks(slim.repartition(n_tasks), edges, first)), []
            kept = [blocks]
            try:
                with job_settings(rows.sparkSession):
                    for round_ in range(self.rounds):
                        if round_ and round_ % SNAPSHOT == 0:
                            blocks = self._written(_with_margins(blocks, len(edges), trees[-1:]))
                            last = []
                        else:
                            last = trees[-1:]
                        blocks = self._of_round(blocks, len(edges), last, round_).persist()
                        kept.append(blocks)
                        columns = self.columns(round_, len(edges))
                        trees.append(self._grow(lambda tree, frontier, of=(blocks, n_tasks, columns): self._best_cuts(*of, tree, frontier), edges)[0])
                        for old in kept[:-1]:  # the round's first level has read them
                            old.unpersist()
                        kept = kept[-1:]
            finally:
                for old in kept:
                    old.unpersist()
        return BoostedTrees([*first, *trees], self.features_col)

    @staticmethod
    def _written(blocks: DataFrame) -> DataFrame:
        return written(blocks, "boosting-blocks")

    def _of_round(self, blocks: DataFrame, d: int, last: list[Tree], round_: int) -> DataFrame:
        """The blocks with the last tree in their margins, and what the levels of this round read."""

        def lay_out(batches):
            for batch in batches:
                for i in range(batch.num_rows):
                    yield pa.RecordBatch.from_pylist([self._laid_out(batch.slice(i, 1).to_pylist()[0], d, last, round_)], pa.schema(_arrow(ROUND)))

        return blocks.select(*_names(BLOCK)).mapInArrow(lay_out, ROUND)

    def _laid_out(self, row: dict, d: int, last: list[Tree], round_: int) -> dict:
        bins, y, w, key, margin = _unpacked(row, d)
        margin = _added(margin, bins, last)
        p, some = sigmoid(margin), drawn_rows(key, round_, self.seed, self.row_share)
        part = np.ascontiguousarray(bins[some][:, self.columns(round_, d)].T)
        return {c: row[c] for c in ("n", "bins", "y", "w", "key")} | {"margin": margin.tobytes(), "m": int(some.sum()), "part": part.tobytes(), "g": (w * (p - y))[some].tobytes(), "h": (w * p * (1 - p))[some].tobytes()}

    def _held_tasks(self, spark: SparkSession, n: int, edges: list[np.ndarray]) -> int:
        """How many tasks hold the rows through all rounds, 0 if they or a level's sums are too large for it."""
        n_tasks = min(-(-n // BLOCK_ROWS), _slots(spark))
        nodes = min([n, *([2 * self.max_leaves] if self.max_leaves else []), *([2**self.max_depth] if self.max_depth is not None else [])])
        fits = n_tasks and -(-n // n_tasks) * (2 * len(edges) + HELD_ROW) <= HELD_BYTES and n_tasks * nodes * sum(len(e) + 1 for e in edges) * 3 * 8 <= HELD_SUMS
        return n_tasks if fits else 0

    def _rounds_held(self, slim: DataFrame, n_tasks: int, edges: list[np.ndarray], first: list[Tree]) -> list[Tree]:
        """The trees of all rounds, from one job whose tasks hold the rows."""
        folder = scratch_table(slim.sparkSession, "boosting-sums")

        def grow(batches):
            exchange, me = (_Exchange(folder), BarrierTaskContext.get().partitionId()) if n_tasks > 1 else (lambda a: [a], 0)
            held = _Held(batches, edges, first, exchange)
            for round_ in range(self.rounds):
                tree = self._held_round(held, round_, edges, exchange)
                if me == 0:
                    yield pa.RecordBatch.from_pylist([{c: getattr(tree, c) for c in _names(TREE)}], pa.schema([(c, pa.list_(pa.float64() if c in ("threshold", "value") else pa.int32())) for c in _names(TREE)]))

        with job_settings(slim.sparkSession):
            return [Tree(**r.asDict()) for r in slim.repartition(n_tasks).mapInArrow(grow, TREE, barrier=n_tasks > 1).collect()]

    def _held_round(self, held: _Held, round_: int, edges: list[np.ndarray], exchange: Callable) -> Tree:
        drawn = drawn_rows(held.key, round_, self.seed, self.row_share)
        rows = np.flatnonzero(drawn)
        w, p = held.w[rows], sigmoid(held.margin[rows])
        levels = _Levels(self, held, rows, self.columns(round_, len(edges)), w * (p - held.y[rows]), w * p * (1 - p), exchange)
        tree, ends = self._grow(levels.best_cuts, edges)
        others, value = np.flatnonzero(~drawn), np.array(tree.value)
        held.margin[rows] += value[held.nodes_of(tree, rows, np.array(ends)[levels.node])]  # the last level's cuts are to be gone down yet
        held.margin[others] += value[held.nodes_of(tree, others, np.zeros(len(others), np.int64))]
        return tree

    def columns(self, round_: int, d: int) -> np.ndarray:
        n = max(1, int(self.column_share * d))
        return np.sort(np.random.default_rng([self.seed, round_]).permutation(d)[:n])

    def _value(self, g: float, h: float) -> float:
        return -self.step * g / (h + self.l2) if h + self.l2 > 0 else 0.0

    def _grow(self, best_cuts: Callable, edges: list[np.ndarray]) -> tuple[Tree, list[int]]:
        """One tree, from the best cuts of a level's nodes at a time; then the cuts that best first would take, of those looked at. And where in it
        the rows of each node that was looked at are."""
        full = Tree()
        frontier, cuts, reach = [full.leaf(0.0)], {}, {}  # cuts: node to its best cut; reach: the smallest gain on the way, its own included
        depth = 0
        while frontier and (self.max_depth is None or depth < self.max_depth):
            best = best_cuts(full, frontier)
            if depth == 0 and 0 in best:
                full.value[0] = self._value(best[0]["g"], best[0]["h"])
            parents = {full.left[i]: i for i in cuts} | {full.right[i]: i for i in cuts}
            for node in frontier:
                cut = best.get(node)
                if cut is not None and cut["gain"] > 1e-10:
                    cuts[node] = cut
                    reach[node] = min(cut["gain"], reach[parents[node]] if node in parents else np.inf)
            wanted = set(self._first(reach))
            frontier, depth = [], depth + 1
            for node in sorted(set(best) & set(cuts) & wanted):
                frontier += self._split(full, node, cuts[node], edges)
        wanted, out = set(self._first(reach)), Tree()
        out.leaf(full.value[0])
        todo, ends = [(0, 0)], [0] * len(full.feature)
        while todo:  # the taken cuts only
            old, node = todo.pop()
            ends[old] = node
            if old in wanted and full.feature[old] >= 0:
                out.feature[node], out.bin[node], out.threshold[node] = full.feature[old], full.bin[old], full.threshold[old]
                out.left[node], out.right[node] = out.leaf(full.value[full.left[old]]), out.leaf(full.value[full.right[old]])
                todo += [(full.left[old], out.left[node]), (full.right[old], out.right[node])]
        for old in range(len(full.feature)):  # children come after their parents
            if full.feature[old] >= 0 and out.feature[ends[old]] < 0:
                ends[full.left[old]] = ends[full.right[old]] = ends[old]
        return out, ends

    def _first(self, reach: dict[int, float]) -> list[int]:
        order = sorted(reach, key=lambda node: (-reach[node], node))  # a node comes after its parent
        return order if self.max_leaves is None else order[: self.max_leaves - 1]

    def _split(self, tree: Tree, node: int, cut: dict, edges: list[np.ndarray]) -> list[int]:
        j, b = cut["feature"], cut["bin"]
        tree.feature[node], tree.bin[node], tree.threshold[node] = j, b, float(edges[j][b])
        tree.left[node] = tree.leaf(self._value(cut["g_left"], cut["h_left"]))
        tree.right[node] = tree.leaf(self._value(cut["g"] - cut["g_left"], cut["h"] - cut["h_left"]))
        return [tree.left[node], tree.right[node]]

    def _best_cuts(self, blocks: DataFrame, n_tasks: int, columns: np.ndarray, tree: Tree, frontier: list[int]) -> dict[int, dict]:
        me = self

        def sums(batches):
            total = _sums((batch.slice(i, 1).to_pylist()[0] for batch in batches for i in range(batch.num_rows)), columns, tree, frontier)
            yield pa.RecordBatch.from_pydict({"feature": pa.array(list(total), pa.int32()), "sums": [t.tobytes() for t in total.values()]})

        def cuts(batches):
            total: dict[int, np.ndarray] = {}
            for batch in batches:
                for row in batch.to_pylist():
                    s = np.frombuffer(row["sums"]).reshape(3, len(frontier), BINS + 1)
                    total[row["feature"]] = total[row["feature"]] + s if row["feature"] in total else s
            yield pa.RecordBatch.from_pylist(me._found(total), pa.schema(_arrow(CUTS)))

        summed = blocks.select("m", "part", "g", "h").mapInArrow(sums, SUMS)
        if n_tasks > 1:
            size = n_tasks * len(columns) * len(frontier) * 3 * 8 * (BINS + 1)
            summed = summed.repartition(min(-(-size // SUMS_OF_TASK), len(columns)), "feature")
        return _best((cut.asDict() for cut in summed.mapInArrow(cuts, CUTS).collect()), frontier)

    def _found(self, total: dict[int, np.ndarray]) -> list[dict]:
        """The best cut of each node by each feature, from the sums of features."""
        return [dict(zip(_names(CUTS), (k, j, *cut), strict=True)) for j, s in total.items() for k, cut in enumerate(self._cuts_of(s))]

    def _cuts_of(self, s: np.ndarray) -> list[tuple]:
        """(bin, gain, left sums, sums) of the best cut of each node by one feature; the first of equal ones."""
        g, h, n = s
        gl, hl, nl = (np.cumsum(x, axis=1) for x in s)
        g_all, h_all, n_all = (x[:, -1:] for x in (gl, hl, nl))
        score = lambda a, b: a * a / np.maximum(b + self.l2, 1e-300)
        gain = score(gl, hl) + score(g_all - gl, h_all - hl) - score(g_all, h_all)
        ok = (np.minimum(hl, h_all - hl) >= self.least_hessian) & (np.minimum(nl, n_all - nl) >= max(self.least_rows, 1))
        gain = np.where(ok, gain, -np.inf)
        at = gain.argmax(axis=1)
        return [(int(b), float(gain[k, b]), float(gl[k, b]), float(hl[k, b]), int(nl[k, b]), float(g_all[k, 0]), float(h_all[k, 0]), int(n_all[k, 0])) for k, b in enumerate(at)]


class _Held:
    """A task's rows for all rounds: their bins, labels, weights, keys and margins.

    ``columns`` has a row of bins for each feature, but features of two bins next to each other, of which no row anywhere has two in the upper bin, share
    one: 0 where none is in it, else one more than the place of the one that is. ``members``: the features of a column.
    """

    def __init__(self, batches: Iterable[pa.RecordBatch], edges: list[np.ndarray], first: list[Tree], exchange: Callable):
        d, parts = len(edges), [(np.zeros((len(edges), 0), np.uint8), *(np.zeros(0, t) for t in (float, float, np.int64, float)))]
        for batch in batches:
            values = batch["x"].flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, d)
            bins = np.stack([np.searchsorted(e, values[:, j]) for j, e in enumerate(edges)]).astype(np.uint8)
            parts.append((bins, *(batch[c].to_numpy(zero_copy_only=False) for c in ("y", "w", "key")), sum((t.margins(values) for t in first), np.zeros(len(values)))))
        self.y, self.w, self.key, self.margin = (np.concatenate([p[i] for p in parts]) for i in range(1, 5))
        bins = [np.concatenate([p[0][j] for p in parts]) for j in range(d)]
        del parts
        ends = np.min(exchange(np.array(_exclusive(bins, [len(e) == 1 for e in edges]), np.float64)), axis=0).astype(int)
        self.members, j = [], 0
        while j < d:
            self.members.append(range(j, ends[j]))
            j = ends[j]
        self.column_of = np.repeat(np.arange(len(self.members)), [len(m) for m in self.members])
        self.widths = np.array([len(m) + 1 if len(m) > 1 else len(edges[m[0]]) + 1 for m in self.members])
        self.columns = np.empty((len(self.members), len(self.y)), np.uint8)
        for column, m in zip(self.columns, self.members, strict=True):
            column[:] = bins[m[0]]
            for k, j in enumerate(m):
                if k:
                    column[bins[j] > 0] = k + 1

    def goes_right(self, feature: int, limit: int) -> np.ndarray:
        """By the value in the feature's column, whether a row is above a cut."""
        m = self.members[self.column_of[feature]]
        return np.arange(BINS + 1) == feature - m[0] + 1 if len(m) > 1 else np.arange(BINS + 1) > limit

    def nodes_of(self, tree: Tree, rows: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The leaf of each of some rows, from the nodes that they are at."""
        inner = np.array([f >= 0 for f in tree.feature])
        to, column = np.zeros((len(inner), BINS + 1), np.int64), np.zeros(len(inner), np.int64)
        for i in np.flatnonzero(inner):
            column[i] = self.column_of[tree.feature[i]]
            to[i] = np.where(self.goes_right(tree.feature[i], tree.bin[i]), tree.right[i], tree.left[i])
        flat, n = self.columns.reshape(-1), len(self.y)
        left = np.flatnonzero(inner.take(at))
        out, at = at, at.take(left)
        while len(left):
            at = to.reshape(-1).take(at * (BINS + 1) + flat.take(column.take(at) * n + rows.take(left)))
            out[left] = at
            on = np.flatnonzero(inner.take(at))
            left, at = left.take(on), at.take(on)
        return out


def _exclusive(bins: list[np.ndarray], two: list[bool]) -> list[int]:
    """For each feature, where those from it on end that can share its column."""
    ends, end = [], 0
    for j, here in enumerate(bins):
        if end <= j:
            end, taken = j + 1, here > 0
        while two[j] and end < len(bins) and two[end] and end - j < BINS and not (taken & (bins[end] > 0)).any():
            taken, end = taken | (bins[end] > 0), end + 1
        ends.append(end)
        taken = taken & (here == 0)
    return ends


class _Exchange:
    """Gives the tasks of a barrier job each other's arrays, in the same order everywhere, through files of the shared folder: a message of Spark's own
    barrier takes a second."""

    def __init__(self, folder: str):
        context = BarrierTaskContext.get()
        self.store, path = file_system(folder)
        self.me, self.step = context.partitionId(), 0
        names = context.allGather(uuid.uuid4().hex)  # anew for each attempt, and all tasks run from here on
        self.n, self.path = len(names), f"{path}/{names[0]}"
        self.store.create_dir(self.path)

    def __call__(self, a: np.ndarray) -> list[np.ndarray]:
        mine = f"{self.path}/{self.step}-{self.me}"
        with self.store.open_output_stream(f"{mine}-part") as out:
            out.write(a.tobytes())
        self.store.move(f"{mine}-part", mine)
        got = [a if k == self.me else np.frombuffer(self._read(f"{self.path}/{self.step}-{k}")).reshape(a.shape) for k in range(self.n)]
        if self.step:  # whoever has sent this step's array has read those of the one before
            self.store.delete_file(f"{self.path}/{self.step - 1}-{self.me}")
        self.step += 1
        return got

    def _read(self, path: str) -> bytes:
        wait = 0.0003
        while True:
            try:
                with self.store.open_input_stream(path) as there:
                    return there.read()
            except FileNotFoundError:
                time.sleep(wait)
                wait = min(wait * 1.3, 0.02)


class _Levels:
    """The best cuts of a round's levels from rows that tasks hold. ``node``: of each drawn row, the last of the nodes looked at that it is in."""

    def __init__(self, settings: Boosting, held: _Held, rows: np.ndarray, features: np.ndarray, g: np.ndarray, h: np.ndarray, exchange: Callable):
        self.settings, self.held, self.g, self.h, self.exchange = settings, held, g, h, exchange
        used = np.unique(held.column_of[features])
        self.part = np.stack([held.columns[c].take(rows) for c in used])
        self.widths, self.place = held.widths[used], {int(c): i for i, c in enumerate(used)}
        self.starts = np.cumsum(self.widths) - self.widths
        drawn = set(features.tolist())
        self.members = [[(j, k) for k, j in enumerate(held.members[c]) if j in drawn] for c in used]
        self.shared = [len(held.members[c]) > 1 for c in used]
        self.node = np.zeros(len(rows), np.int32)
        self.rows, self.slot = np.arange(len(rows)), np.zeros(len(rows), np.int64)  # rows still in an open node, and in which
        self.frontier: list[int] = []

    def best_cuts(self, tree: Tree, frontier: list[int]) -> dict[int, dict]:
        if not self.frontier:
            self.sums = self._added_up(None, self.slot, 1)
        else:
            self._go_down(tree, frontier)
            parents = [self.frontier.index(i) for i in self.frontier if tree.feature[i] >= 0]
            right = np.array([2 * self.found[self.frontier[p]]["n_left"] > self.found[self.frontier[p]]["n"] for p in parents])  # the smaller child
            some = np.flatnonzero((self.slot & 1) == right[self.slot >> 1])
            one = self._added_up(self.rows[some], self.slot[some] >> 1, len(parents))
            other = self.sums[:, parents] - one
            other[:, other[2] == 0] = 0.0
            self.sums = np.empty((3, len(frontier), one.shape[2]))
            of = np.arange(len(parents)) * 2
            self.sums[:, of + right], self.sums[:, of + ~right] = one, other
        self.frontier = frontier
        self.found = self._found()
        return self.found

    def _go_down(self, tree: Tree, frontier: list[int]) -> None:
        at = {node: k for k, node in enumerate(frontier)}
        to, column = np.full((len(self.frontier), BINS + 1), -1), np.zeros(len(self.frontier), np.int64)
        for k, i in enumerate(self.frontier):
            if tree.feature[i] >= 0:
                column[k] = self.place[int(self.held.column_of[tree.feature[i]])]
                to[k] = np.where(self.held.goes_right(tree.feature[i], tree.bin[i]), at[tree.right[i]], at[tree.left[i]])
        values = self.part.reshape(-1).take((column * self.part.shape[1]).take(self.slot) + self.rows)
        slot = to.reshape(-1).take(self.slot * (BINS + 1) + values)
        stays = np.flatnonzero(slot >= 0)
        if len(stays) < len(slot):
            self.rows, slot = self.rows[stays], slot[stays]
        self.slot = slot
        self.node[self.rows] = np.array(frontier, np.int32).take(slot)

    def _added_up(self, rows: np.ndarray | None, slot: np.ndarray, n: int) -> np.ndarray:
        """Gradients, second derivatives and rows of all tasks by (slot, value of a column)."""
        out = np.empty((3, n, int(self.widths.sum())))
        g, h = (self.g, self.h) if rows is None else (self.g.take(rows), self.h.take(rows))
        for values, width, start in zip(self.part, self.widths, self.starts, strict=True):
            key = slot * width + (values if rows is None else values.take(rows))
            for to, weights in zip(out, (g, h, None), strict=True):
                to[:, start : start + width] = np.bincount(key, weights, n * width).reshape(n, width)
        first, *more = self.exchange(out)
        total = first.copy()
        for other in more:
            total += other
        return total

    def _found(self) -> dict[int, dict]:
        s, n = self.settings, len(self.frontier)
        best, feature, at, left = np.full(n, -np.inf), np.full(n, -1), np.zeros(n, np.int64), np.zeros((3, n))
        score = lambda a, b: a * a / np.maximum(b + s.l2, 1e-300)
        for members, shared, width, start in zip(self.members, self.shared, self.widths, self.starts, strict=True):
            up_to = np.cumsum(self.sums[:, :, start : start + width], axis=2)
            total = up_to[:, :, -1:]
            if feature[0] < 0:
                whole = total[:, :, 0]
                feature[:] = members[0][0]
                left[:] = whole
            below = total - self.sums[:, :, [start + 1 + k for _, k in members]] if shared else up_to[:, :, :-1]
            if not below.shape[2]:
                continue
            above = total - below
            gain = score(below[0], below[1]) + score(above[0], above[1]) - score(total[0], total[1])
            ok = (np.minimum(below[1], above[1]) >= s.least_hessian) & (np.minimum(below[2], above[2]) >= max(s.least_rows, 1))
            gain = np.where(ok, gain, -np.inf)
            k = gain.argmax(axis=1)
            most = gain[np.arange(n), k]
            more = np.flatnonzero(most > best)
            best[more], left[:, more] = most[more], below[:, more, k[more]]
            feature[more], at[more] = (np.array([j for j, _ in members])[k[more]], 0) if shared else (members[0][0], k[more])
        rows = zip(self.frontier, feature.tolist(), at.tolist(), best.tolist(), *left.tolist(), *whole.tolist(), strict=True)
        return {row[0]: dict(zip(_names(CUTS), row, strict=True)) for row in rows if row[-1]}


def _arrow(ddl: str) -> list[tuple]:
    kinds = {"int": pa.int32(), "double": pa.float64(), "long": pa.int64(), "binary": pa.binary()}
    return [(name, kinds[kind]) for name, kind in (c.split() for c in ddl.split(", "))]


def _tasks(n_blocks: int, cores: int) -> int:
    """A task for each core, fewer where they would have next to nothing to do, a whole number of times as many for very many blocks."""
    least, most = BLOCKS_OF_TASK
    return min(-(-n_blocks // least), cores * max(1, -(-n_blocks // (most * cores))))


def _slots(spark: SparkSession) -> int:
    """Tasks that a barrier job can run at once; 1, which needs no barrier, where executors come and go."""
    context = spark.sparkContext
    if context.getConf().get("spark.dynamicAllocation.enabled", "false").lower() == "true":
        return 1
    jvm = context._jsc.sc()
    return max(1, min(context.defaultParallelism, jvm.maxNumConcurrentTasks(jvm.resourceProfileManager().defaultResourceProfile())))


def bin_edges(slim: DataFrame, d: int) -> list[np.ndarray]:
    """The upper ends of each feature's bins but the last: its values but the largest if they are few, else quantiles of its distinct values. The driver
    gets at most ``BINS`` numbers for each feature."""
    long = slim.select(F.posexplode("x").alias("feature", "v")).where(~F.isnan("v")).groupBy("feature", "v").agg(F.count("*").alias("n"))
    at = [(i + 1) / (BINS + 1) for i in range(BINS)]
    found = long.groupBy("feature").agg(F.percentile_approx("v", at).alias("edges"), F.count("*").alias("k"), F.max("v").alias("most"))
    few = long.join(found.where(F.col("k") <= BINS).select("feature", "most"), "feature").where("v < most").groupBy("feature").agg(F.array_sort(F.collect_list("v")).alias("edges"))
    edges = {r["feature"]: r["edges"] for r in found.where(F.col("k") > BINS).select("feature", "edges").unionByName(few).collect()}
    return [np.unique(np.array(edges.get(j, []), np.float64)) for j in range(d)]


def _blocks(slim: DataFrame, edges: list[np.ndarray], first: list[Tree]) -> DataFrame:
    """Rows of about ``BLOCK_ROWS`` rows each: bins, labels, weights and the margins of the trees to start from."""

    def packed(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(parts)
        values = t["x"].combine_chunks().flatten().to_numpy().reshape(t.num_rows, len(edges))
        bins = np.stack([np.searchsorted(e, values[:, j]) for j, e in enumerate(edges)], axis=1).astype(np.uint8)
        margin = sum((x.margins(values) for x in first), np.zeros(len(values)))
        row = {"n": len(values), "bins": bins.tobytes()} | {c: t[c].to_numpy().tobytes() for c in ("y", "w", "key")} | {"margin": margin.tobytes()}
        return pa.RecordBatch.from_pylist([row], pa.schema(_arrow(BLOCK)))

    def pack(batches):
        parts, n = [], 0
        for batch in batches:
            while batch.num_rows:
                some = batch.slice(0, BLOCK_ROWS - n)
                parts, n, batch = [*parts, some], n + some.num_rows, batch.slice(some.num_rows)
                if n == BLOCK_ROWS:
                    yield packed(parts)
                    parts, n = [], 0
        if n:
            yield packed(parts)

    return slim.mapInArrow(pack, BLOCK)


def _sums(rows: Iterable[dict], columns: np.ndarray, tree: Tree, frontier: list[int]) -> dict[int, np.ndarray]:
    """Gradients, second derivatives and rows by (node, bin) for each drawn feature, of laid-out blocks."""
    total = {int(j): np.zeros((3, len(frontier) * (BINS + 1))) for j in columns}
    rank = np.full(len(tree.feature), -1)
    rank[frontier] = np.arange(len(frontier))
    feature, limit, left, right = (np.array(c) for c in (tree.feature, tree.bin, tree.left, tree.right))
    inner = np.where(feature < 0, -1, np.searchsorted(columns, feature))  # places among the drawn features
    for row in rows:
        m = row["m"]
        if not m:
            continue
        part, g, h = np.frombuffer(row["part"], np.uint8), np.frombuffer(row["g"]), np.frombuffer(row["h"])
        node = rank[_descend(m, inner, limit, left, right, lambda r, j: part[j * m + r])]
        some = np.flatnonzero(node >= 0)
        if len(some) < m:
            g, h, node = g[some], h[some], node[some]
        at = node * (BINS + 1)
        for k, t in enumerate(total.values()):
            bins = part[k * m : (k + 1) * m]
            key = at + (bins[some] if len(some) < m else bins)
            for to, weights in zip(t, (g, h, None), strict=True):
                to += np.bincount(key, weights, len(to))
    return {j: t.reshape(3, len(frontier), BINS + 1) for j, t in total.items()}


def _best(found: Iterable[dict], frontier: list[int]) -> dict[int, dict]:
    """The best cut of each node of a level; of equal ones that by the first feature."""
    best: dict[int, dict] = {}
    for cut in found:
        node, has = frontier[cut["node"]], best.get(frontier[cut["node"]])
        if cut["n"] and (has is None or (cut["gain"], -cut["feature"]) > (has["gain"], -has["feature"])):
            best[node] = cut
    return best


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def _unpacked(row: dict, d: int) -> tuple[np.ndarray, ...]:
    """bins, labels, weights, keys and margins of a block."""
    return np.frombuffer(row["bins"], np.uint8).reshape(row["n"], d), *(np.frombuffer(row[c], np.int64 if c == "key" else np.float64) for c in ("y", "w", "key", "margin"))


def _added(margin: np.ndarray, bins: np.ndarray, trees: list[Tree]) -> np.ndarray:
    return margin + sum((t.margins(bins, True) for t in trees), np.zeros(len(margin)))


def _with_margins(blocks: DataFrame, d: int, new: list[Tree]) -> DataFrame:
    def add(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                bins, *_, margin = _unpacked(row, d)
                yield pa.RecordBatch.from_pylist([row | {"margin": _added(margin, bins, new).tobytes()}], batch.schema)

    return blocks.select(*[c.split()[0] for c in BLOCK.split(", ")]).mapInArrow(add, BLOCK)
