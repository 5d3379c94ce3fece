"""A classification tree of two classes that tries every cut of every feature, without a bound on its depth.

Equal rows are added up first, so copies weigh but don't multiply. A node with more than ``task_rows`` different rows (eight million for twelve features) is cut by Spark: counts by (node,
feature, value) go to ranges of a sample sort, running sums inside the tasks and the totals of the tasks before give both classes below each value, and
the best cut of each node is an aggregation. A smaller node is grown to its end inside one task. Both ways score a cut by the same operations on the same
whole numbers, so where one ends and the other begins changes no cut. Cuts and subtrees are tables; the driver knows how many nodes are open.

A cut is the largest drop of weighted Gini impurity, of equal ones that of the first feature and smallest value, halfway to the next value. Nodes are
cut, also without a drop, until they hold one class or one row. A leaf predicts the heavier class, 0 of equal ones. Missing values and NaN count as 0.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rulewright.operators.boosting import _exclusive, as_array
from rulewright.sources.scratch import temporary_tables, written

#: Numbers (rows times features) that a task grows to the end, rows that a task has at least for it, rows that meet a subtree together.
NUMBERS, TASK_ROWS, MET_ROWS = 96_000_000, 50_000, 100_000
#: Rows whose cuts by a sorted feature are scored at once.
CUTS_AT_ONCE = 1 << 15

SUBTREE = "node long, feature array<int>, threshold array<double>, left array<int>, right array<int>, share array<double>"


def _score(l0, l1, r0, r1):
    """What is to be largest: the squared weights of the classes over the weight of each side. For Columns and numpy arrays alike."""
    return (l0 * l0 + l1 * l1) / (l0 + l1) + (r0 * r0 + r1 * r1) / (r0 + r1)


def _clean(df: DataFrame, name: str) -> Column:
    return F.transform(as_array(df, name).cast("array<double>"), lambda v: F.coalesce(F.nanvl(v, F.lit(0.0)), F.lit(0.0)))


def grown(x: np.ndarray, n: np.ndarray, weights: tuple[float, float]) -> dict[str, np.ndarray]:
    """The whole tree below rows ``x`` with counts ``n`` (rows, 2): node i goes left where its feature is at most its threshold; a leaf has feature -1."""
    return _grown([_slim(x)], n, weights)


def _slim(x: np.ndarray) -> list[np.ndarray]:
    """The columns of some rows, those of 0 and 1 only as bytes."""
    return [(v.astype(np.uint8) if ((v == 0) | (v == 1)).all() else v.copy()) for v in x.T]


def _grown(parts: list[list[np.ndarray]], n: np.ndarray, weights: tuple[float, float]) -> dict[str, np.ndarray]:
    """As ``grown``, from the columns of the rows' parts.

    All nodes of a level are cut together, and the rows are kept grouped by node in several orders: each feature is sorted once, and its order is parted
    as nodes are cut, left children before right ones, so a level costs a few passes over the rows of its open nodes, however many nodes they are. Features
    of 0 and 1 are counted and not sorted, together where no row has two of them (one-hot columns).
    """
    d, size = len(parts[0]), len(n)
    x = []
    for j in range(d):
        x.append(np.concatenate([p[j] for p in parts]))
        for p in parts:
            p[j] = None
    out: dict[str, list[np.ndarray]] = {c: [] for c in ("feature", "threshold", "left", "right", "share")}

    def add(totals: np.ndarray) -> np.ndarray:
        """New nodes, as leaves, of the rows' totals (2, nodes)."""
        first = sum(map(len, out["feature"]))
        w0, w1 = totals[0] * weights[0], totals[1] * weights[1]
        share = np.divide(w1, w0 + w1, out=np.zeros(len(w1)), where=w0 + w1 != 0)
        for c, values in (("feature", np.full(len(w1), -1)), ("threshold", np.zeros(len(w1))), ("left", np.full(len(w1), -1)), ("right", np.full(len(w1), -1)), ("share", share)):
            out[c].append(values)
        return np.arange(first, first + len(w1))

    counts = n.astype(np.int64 if size and n.max() > 2**31 - 1 else np.int32)
    total = n.sum(axis=0, dtype=np.int64)[:, None]
    ids, sizes = add(total), np.array([size])  # the open nodes, in the order that every layout of the rows has them in
    # layouts: the rows' numbers, counts and values in the order of a numeric feature; the first has the columns of bytes instead
    two = [v.dtype == np.uint8 for v in x]
    ends, groups, j = _exclusive([v if t else np.zeros(0, np.uint8) for v, t in zip(x, two, strict=True)], two), [], 0
    while j < d:
        if two[j]:
            groups.append(range(j, ends[j]))
        j = ends[j]
    shared = [sum((x[j] * np.uint8(k + 1) for k, j in enumerate(g)), np.zeros(size, np.uint8)) for g in groups]
    layouts = [[np.arange(size), counts[:, 0], counts[:, 1], *shared]]
    numeric = [j for j in range(d) if not two[j]]
    for j in numeric:
        o = np.argsort(x[j], kind="stable")
        layouts.append([o, counts[o, 0], counts[o, 1], x[j][o]])
        x[j] = None
    del x, shared, counts, n
    in_order = sorted([(g[0], k) for k, g in enumerate(groups)] + [(j, k) for k, j in enumerate(numeric)])
    if not (total > 0).all():
        ids = ids[:0]
    while len(ids):
        at = np.repeat(np.arange(len(ids)), sizes)
        before = np.cumsum(total, axis=1) - total
        best, feature, place = np.full(len(ids), -np.inf), np.full(len(ids), -1), np.zeros(len(ids), np.int64)
        low, high, left = np.zeros(len(ids)), np.zeros(len(ids)), np.zeros((2, len(ids)), np.int64)
        for j, k in in_order:
            if two[j]:
                _cut_bytes(groups[k], layouts[0][3 + k], layouts[0][1:3], at, total, weights, best, feature, place, low, high, left)
            else:
                _cut_sorted(j, layouts[1 + k], at, total, before, weights, best, feature, place, low, high, left)
        cut = feature >= 0
        goes_left = np.zeros(size, bool)
        for j, k in in_order:
            by = (feature >= j) & (feature < groups[k][-1] + 1) if two[j] else feature == j
            if not by.any():
                continue
            rows = np.flatnonzero(np.repeat(by, sizes))
            if two[j]:
                rows = rows[layouts[0][3 + k].take(rows) != place.take(at.take(rows))]
                goes_left[layouts[0][0].take(rows)] = True
            else:
                rows = rows[rows <= place.take(at.take(rows))]
                goes_left[layouts[1 + k][0].take(rows)] = True
        n_left = np.add.reduceat(goes_left[layouts[0][0]], np.cumsum(sizes) - sizes, dtype=np.int64)
        new = [add(left[:, cut]), add((total - left)[:, cut])]
        for c, values in (("feature", feature[cut]), ("threshold", _halfway_each(low[cut], high[cut])), ("left", new[0]), ("right", new[1])):
            _put(out[c], ids[cut], values)
        stays = [cut & (side > 0).all(axis=0) for side in (left, total - left)]
        stay = [np.repeat(s, sizes) for s in stays]
        for k, layout in enumerate(layouts):
            mine = goes_left.take(layout[0])
            keep = np.concatenate([np.flatnonzero(mine & stay[0]), np.flatnonzero(~mine & stay[1])])
            layouts[k] = [c.take(keep) for c in layout]
        ids = np.concatenate([new[k][stays[k][cut]] for k in (0, 1)])
        total = np.concatenate([left[:, stays[0]], (total - left)[:, stays[1]]], axis=1)
        sizes = np.concatenate([n_left[stays[0]], (sizes - n_left)[stays[1]]])
    return {c: np.concatenate(parts) for c, parts in out.items()}


def _cut_sorted(j, layout, at, total, before, weights, best, feature, place, low, high, left):
    """Betters the nodes' best cuts by those of a sorted feature; ``place`` is the last row below."""
    _, c0, c1, v = layout
    run = np.zeros(2, np.int64)
    for begin in range(0, len(v) - 1, CUTS_AT_ONCE):
        end = min(begin + CUTS_AT_ONCE, len(v) - 1)
        here = at[begin:end]
        up_to = [np.cumsum(c[begin:end], dtype=np.int64) + r for c, r in zip((c0, c1), run, strict=True)]
        run = np.array([u[-1] for u in up_to])
        some = np.flatnonzero((v[begin:end] < v[begin + 1 : end + 1]) & (here == at[begin + 1 : end + 1]))
        if not len(some):
            continue
        node = here.take(some)
        firsts = np.concatenate([[0], np.flatnonzero(node[1:] != node[:-1]) + 1])
        nodes, n_cuts = node[firsts], np.diff(np.append(firsts, len(node)))
        l0, l1 = (u.take(some) - np.repeat(b[nodes], n_cuts) for u, b in zip(up_to, before, strict=True))
        r0, r1 = (np.repeat(t[nodes], n_cuts) - below for t, below in zip(total, (l0, l1), strict=True))
        score = _score(l0 * weights[0], l1 * weights[1], r0 * weights[0], r1 * weights[1])
        most = np.maximum.reduceat(score, firsts)
        more = np.flatnonzero(most > best[nodes])
        if not len(more):
            continue
        if len(more) < len(nodes):
            most = np.where(most > best[nodes], most, np.inf)
        hit = np.flatnonzero(score == np.repeat(most, n_cuts))
        hit = hit[np.concatenate([[0], np.flatnonzero(node[hit[1:]] != node[hit[:-1]]) + 1])]  # the first of equal ones
        nodes, k = node[hit], some[hit] + begin
        best[nodes], feature[nodes], place[nodes], low[nodes], high[nodes] = score[hit], j, k, v[k], v[k + 1]
        left[0, nodes], left[1, nodes] = l0[hit], l1[hit]


def _cut_bytes(group, values, counts, at, total, weights, best, feature, place, low, high, left):
    """Betters the nodes' best cuts by those of features that share a column of bytes; ``place`` is the byte of the rows above."""
    width = len(group) + 1
    key = at * width + values
    a0, a1 = (np.bincount(key, c, len(best) * width).reshape(-1, width)[:, 1:].astype(np.int64) for c in counts)
    l0, l1 = total[0][:, None] - a0, total[1][:, None] - a1
    ok = (a0 + a1 > 0) & (l0 + l1 > 0)
    with np.errstate(divide="ignore", invalid="ignore"):
        score = np.where(ok, _score(l0 * weights[0], l1 * weights[1], (total[0][:, None] - l0) * weights[0], (total[1][:, None] - l1) * weights[1]), -np.inf)
    k = score.argmax(axis=1)
    nodes = np.flatnonzero(score[np.arange(len(best)), k] > best)
    k = k[nodes]
    best[nodes], feature[nodes], place[nodes], low[nodes], high[nodes] = score[nodes, k], group[0] + k, k + 1, 0.0, 1.0
    left[0, nodes], left[1, nodes] = l0[nodes, k], l1[nodes, k]


def _halfway_each(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Between a and b, but a where no number lies between."""
    mid = a + (b - a) / 2
    return np.where(mid < b, mid, a)


def _put(levels: list[np.ndarray], ids: np.ndarray, values: np.ndarray) -> None:
    """Sets entries of the two lists before the last two, a level's right nodes and its left ones, or of the first node."""
    if len(ids):
        parts = levels[-4:-2] if len(levels) > 3 else levels[:1]
        first = sum(map(len, levels[: -2 - len(parts)]))
        for part in parts:
            some = (ids >= first) & (ids < first + len(part))
            part[ids[some] - first] = values[some]
            first += len(part)


def _running(batches):
    """Rows of both classes up to each value of a (node, feature) in this task, from batches sorted by them."""
    last, total = None, np.zeros(2, np.int64)
    for batch in batches:
        if not batch.num_rows:
            continue
        key = np.stack([batch["node"].to_numpy(), batch["feature"].to_numpy().astype(np.int64)], axis=1)
        n = np.stack([batch["n0"].to_numpy(), batch["n1"].to_numpy()], axis=1)
        up_to = np.cumsum(n, axis=0)
        first = np.concatenate([[0], np.nonzero((key[1:] != key[:-1]).any(axis=1))[0] + 1])
        base = (up_to - n)[first]
        base[0] -= total if last == tuple(key[0]) else 0
        up_to -= np.repeat(base, np.diff(np.append(first, len(n))), axis=0)
        last, total = tuple(key[-1]), up_to[-1]
        yield batch.append_column("l0", pa.array(up_to[:, 0])).append_column("l1", pa.array(up_to[:, 1]))


@dataclass
class FittedTree:
    """``cuts``: a table of (node, feature, threshold, left, right) for each level that Spark cut; ``subtrees``: the rest below each node they end in."""

    root: int
    cuts: list[DataFrame]
    subtrees: DataFrame
    features_col: str = "features"

    def transform(self, df: DataFrame) -> DataFrame:
        """``df`` without its features, with ``probability_1`` and ``prediction``.

        Rows go down a level of cuts by a join, then meet their subtree in groups of about ``MET_ROWS``, however many reach one.
        """
        columns = [c for c in df.columns if c != self.features_col]
        at = df.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("_row"), _clean(df, self.features_col).alias("_x"), F.lit(self.root).cast("long").alias("_node"))
        for level in self.cuts:
            down = F.when(F.get("_x", F.col("feature")) <= F.col("threshold"), F.col("left")).otherwise(F.col("right"))
            at = at.join(level, F.col("_node") == F.col("node"), "left").select("_row", "_x", F.when(F.col("node").isNull(), F.col("_node")).otherwise(down).alias("_node"))
        at = written(at, "tree-rows", keep=True)
        parts = at.groupBy(F.col("_node").alias("node")).agg((1 + F.floor(F.count("*") / MET_ROWS)).alias("_parts"))
        trees = self.subtrees.join(parts, "node").withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_parts") - 1))).drop("_parts")
        dealt = at.join(parts, F.col("_node") == F.col("node")).select("_row", "_x", "node", F.pmod(F.monotonically_increasing_id(), F.col("_parts")).alias("_part"))

        def meet(rows: pa.Table, tree: pa.Table) -> pa.Table:
            t = {c: tree[c].combine_chunks().flatten().to_numpy() for c in ("feature", "threshold", "left", "right", "share")} if tree.num_rows else {"feature": np.array([-1]), "share": np.zeros(1)}
            feature, share, node = t["feature"], t["share"], np.zeros(rows.num_rows, np.int64)
            if len(feature) > 1 and rows.num_rows:
                x = rows["_x"].combine_chunks().flatten().to_numpy().reshape(rows.num_rows, -1)
                limit, left, right, each = t["threshold"], t["left"], t["right"], np.arange(rows.num_rows)
                while (inner := feature[node] >= 0).any():
                    r, a = each[inner], node[inner]
                    node[r] = np.where(x[r, feature[a]] <= limit[a], left[a], right[a])
            return pa.table({"_row": rows["_row"], "probability_1": pa.array(share[node])})

        schema = T.StructType([T.StructField("_row", at.schema["_row"].dataType), T.StructField("probability_1", T.DoubleType())])
        scored = dealt.groupBy("node", "_part").cogroup(trees.groupBy("node", "_part")).applyInArrow(meet, schema)
        return scored.select("_row.*", "probability_1", (F.col("probability_1") > 0.5).cast("double").alias("prediction"))


@dataclass(frozen=True)
class ExactTree:
    task_rows: int | None = None  # by the number of features
    label_col: str = "label"
    features_col: str = "features"
    weight_col: str | None = None

    def fit(self, rows: DataFrame) -> FittedTree:
        """Rows with a label other than 0 and 1 are left out; a weight is one number for each label. The fitted tree's tables live as long as the
        ``temporary_tables`` block around the call."""
        with temporary_tables():
            weight = F.col(f"`{self.weight_col}`").cast("double") if self.weight_col else F.lit(1.0)
            slim = rows.select(_clean(rows, self.features_col).alias("x"), F.col(f"`{self.label_col}`").cast("double").alias("y"), weight.alias("w")).where("y IN (0, 1)")
            of = F.count_if(F.col("y") == 0).alias("n0"), F.count_if(F.col("y") == 1).alias("n1")
            alike = slim.groupBy("x").agg(*of, *[f(F.when(F.col("y") == k, F.col("w"))).alias(f"{f.__name__}{k}") for k in (0, 1) for f in (F.min, F.max)])
            alike = written(alike.withColumn("id", F.monotonically_increasing_id()), "tree-alike")
            told = alike.agg(F.count("*").alias("n"), F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), F.min("id").alias("id"), F.max(F.size("x")).alias("d"), *[f(f"{f.__name__}{k}").alias(f"{f.__name__}{k}") for k in (0, 1) for f in (F.min, F.max)]).first()
            if not told["n"]:
                raise ValueError("no rows to fit")
            if any(told[f"min{k}"] != told[f"max{k}"] for k in (0, 1)):
                raise ValueError("rows of one label differ in weight")
            weights = tuple(1.0 if told[f"max{k}"] is None else told[f"max{k}"] for k in (0, 1))
            task_rows = self.task_rows or max(TASK_ROWS, NUMBERS // max(told["d"], 1))
            kind = "leaf" if not told["n0"] or not told["n1"] else "small" if told["n"] <= task_rows else "open"
            state = alike.select("id", "x", "n0", "n1", F.lit(told["id"]).cast("long").alias("node"), F.lit(kind).alias("kind"), F.lit(told["n0"]).alias("t0"), F.lit(told["n1"]).alias("t1"))
            cuts, small, leaves, n_open = [], [], [], int(kind == "open")
            while True:
                small.append(state.where("kind = 'small'").select("node", "x", "n0", "n1"))
                leaves.append(state.where("kind = 'leaf'").select("node", "t0", "t1").distinct() if not cuts else self._leaves(cuts[-1]))
                if not n_open:
                    break
                level, state = self._level(state.where("kind = 'open'"), weights, task_rows)
                cuts.append(level)
                n_open = level.agg(F.coalesce(F.sum((F.col("left_kind") == "open").cast("int") + (F.col("right_kind") == "open").cast("int")), F.lit(0))).first()[0]
            subtrees = self._subtrees(small, leaves, weights)
            return FittedTree(told["id"], [c.select("node", "feature", "threshold", "left", "right") for c in cuts], subtrees, self.features_col)

    @staticmethod
    def _level(open_: DataFrame, weights: tuple[float, float], task_rows: int) -> tuple[DataFrame, DataFrame]:
        """(the cut of each node with what its children hold, the rows of the children)."""
        long = open_.select("node", "n0", "n1", F.posexplode("x").alias("feature", "v"))
        counts = long.groupBy("node", "feature", "v").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
        key = "node", "feature", "v"
        placed = counts.repartitionByRange(*key).sortWithinPartitions(*key)
        schema = T.StructType([*placed.schema.fields, T.StructField("l0", T.LongType()), T.StructField("l1", T.LongType())])
        placed = written(placed.mapInArrow(_running, schema).withColumn("_part", F.spark_partition_id()), "tree-sums")
        parts = placed.groupBy("node", "feature", "_part").agg(F.sum("n0").alias("_n0"), F.sum("n1").alias("_n1"))
        earlier = Window.partitionBy("node", "feature").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
        before = parts.select("node", "feature", "_part", *[F.coalesce(F.sum(f"_n{k}").over(earlier), F.lit(0)).alias(f"_b{k}") for k in (0, 1)])
        totals = open_.groupBy("node").agg(F.first("t0").alias("t0"), F.first("t1").alias("t1"))
        l0, l1 = (F.col(f"l{k}") + F.col(f"_b{k}") for k in (0, 1))
        at = placed.join(before, ["node", "feature", "_part"]).join(totals, "node").where(l0 + l1 < F.col("t0") + F.col("t1"))
        w0, w1 = (F.lit(w) for w in weights)
        score = _score(l0 * w0, l1 * w1, (F.col("t0") - l0) * w0, (F.col("t1") - l1) * w1)
        best = at.groupBy("node").agg(F.max_by(F.struct("feature", "v"), F.struct(score, -F.col("feature"), -F.col("v"))).alias("cut")).select("node", "cut.*")

        x = F.get("x", F.col("feature"))
        sided = written(open_.select("id", "x", "n0", "n1", "node").join(best, "node").withColumn("below", x <= F.col("v")), "tree-sides")
        sums = []
        for name, here in (("left", F.col("below")), ("right", ~F.col("below"))):
            sums += [F.min(F.when(here, F.col("id"))).alias(name), F.count_if(here).alias(f"{name}_n")]
            sums += [F.coalesce(F.sum(F.when(here, F.col(f"n{k}"))), F.lit(0)).alias(f"{name}_{k}") for k in (0, 1)]
        a, b = F.col("_a"), F.col("_b")
        mid = a + (b - a) / 2
        cut = sided.groupBy("node", "feature").agg(F.max(F.when(F.col("below"), x)).alias("_a"), F.min(F.when(~F.col("below"), x)).alias("_b"), *sums)
        cut = cut.withColumn("threshold", F.when(mid < b, mid).otherwise(a)).drop("_a", "_b")
        for name in ("left", "right"):
            pure = (F.col(f"{name}_0") == 0) | (F.col(f"{name}_1") == 0)
            cut = cut.withColumn(f"{name}_kind", F.when(pure, "leaf").when(F.col(f"{name}_n") <= task_rows, "small").otherwise("open"))
        cut = written(cut, "tree-cuts", keep=True)
        mine = lambda c: F.when(F.col("below"), F.col(f"left{c}")).otherwise(F.col(f"right{c}"))
        rows = sided.drop("feature").join(cut.drop("feature"), "node")
        return cut, written(rows.select("id", "x", "n0", "n1", mine("").alias("node"), mine("_kind").alias("kind"), mine("_0").alias("t0"), mine("_1").alias("t1")), "tree-level")

    @staticmethod
    def _leaves(cut: DataFrame) -> DataFrame:
        sides = F.array(*[F.struct(F.col(s).alias("node"), F.col(f"{s}_0").alias("t0"), F.col(f"{s}_1").alias("t1"), F.col(f"{s}_kind").alias("kind")) for s in ("left", "right")])
        return cut.select(F.inline(sides)).where("kind = 'leaf'").drop("kind")

    @staticmethod
    def _subtrees(small: list[DataFrame], leaves: list[DataFrame], weights: tuple[float, float]) -> DataFrame:
        def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            parts, counts, node = [], [], None
            for batch in batches:
                if batch.num_rows:
                    node = batch["node"][0].as_py()
                    counts.append(np.stack([batch["n0"].to_numpy(), batch["n1"].to_numpy()], axis=1))
                    parts.append(_slim(batch["x"].flatten().to_numpy().reshape(batch.num_rows, -1)))
            counts[:] = [np.concatenate(counts)]
            tree = _grown(parts, counts.pop(), weights)
            kinds = {"feature": pa.int32(), "threshold": pa.float64(), "left": pa.int32(), "right": pa.int32(), "share": pa.float64()}
            yield pa.RecordBatch.from_pydict({"node": pa.array([node], pa.int64()), **{c: pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), pa.array(v, kinds[c])) for c, v in tree.items()}})

        below, ends = small[0], leaves[0]
        for s, e in zip(small[1:], leaves[1:], strict=True):
            below, ends = below.unionByName(s), ends.unionByName(e)
        one = {"feature": F.array(F.lit(-1)), "threshold": F.array(F.lit(0.0)), "left": F.array(F.lit(-1)), "right": F.array(F.lit(-1)), "share": F.array((F.col("t1") > 0).cast("double"))}
        return written(below.groupBy("node").applyInArrow(grow, SUBTREE).unionByName(ends.select("node", *[c.alias(name) for name, c in one.items()])), "tree-below", keep=True)
