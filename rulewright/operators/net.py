"""A net of rectified linear layers for two classes, fitted by mini-batch Adam over Spark tasks.

Rows are dealt into blocks of bounded size. A pass is one job: every task goes through the batches of its blocks from the same weights, and what the
tasks arrive at (weights and Adam's moments) is averaged by their rows: cut into slices, a shuffle brings each slice of all blocks together, and the
driver gets one vector. A table of one block is plain mini-batch Adam, for which a job makes several passes, as there is nothing to average; with more
blocks a pass has as many steps, each on more rows. The driver and every task hold three numbers for each weight and pass of a job, whatever the number of rows.

A share of the rows, drawn by a hash of what they hold and the number of the copy, is held out: the fit ends when its accuracy no longer rises, and
keeps the best weights. Without it, or where the draw leaves either part empty, all rows are fitted and the fit ends when the loss no longer falls.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rulewright.operators.boosting import as_array, sigmoid
from rulewright.sources.scratch import temporary_tables, written

#: Rows and bytes of a block, about; copies of a row that a task makes at a time; most slices of the averaged vector.
BLOCK_ROWS, BLOCK_BYTES, COPIES, SLICES = 50_000, 32 << 20, 10_000, 64
#: Rows that are scored together, few enough for a processor's cache.
CACHED_ROWS = 512
#: Passes of a job over one block, whose average is itself.
PASSES = 10
#: Adam's decay of the two moments, and what keeps its division finite.
DECAY_1, DECAY_2, EPSILON = 0.9, 0.999, 1e-8

BLOCK = "block long, n int, n_held int, x binary, y binary, held binary"
PASSED = "number int, part int, block long, rows long, loss double, hits long, held long, steps long, vector binary"
KINDS = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "binary": pa.binary()}


def layers_of(vector: np.ndarray, sizes: tuple[int, ...]) -> list[tuple[np.ndarray, np.ndarray]]:
    """The (weights, biases) of each layer, as views of the vector."""
    out, at = [], 0
    for a, b in zip(sizes, sizes[1:]):
        out.append((vector[at : at + a * b].reshape(a, b), vector[at + a * b : at + a * b + b]))
        at += a * b + b
    return out


def n_weights(sizes: tuple[int, ...]) -> int:
    return sum(a * b + b for a, b in zip(sizes, sizes[1:]))


def first_weights(sizes: tuple[int, ...], seed: int) -> np.ndarray:
    """Even draws within the root of 6 (of 2 for the last layer) over a layer's inputs and outputs."""
    rng, out = np.random.default_rng(seed), np.empty(n_weights(sizes))
    parts = layers_of(out, sizes)
    for i, (w, b) in enumerate(parts):
        most = np.sqrt((2.0 if i == len(parts) - 1 else 6.0) / sum(w.shape))
        w[:], b[:] = rng.uniform(-most, most, w.shape), rng.uniform(-most, most, b.shape)
    return out


def margins(vector: np.ndarray, sizes: tuple[int, ...], x: np.ndarray) -> np.ndarray:
    *hidden, (w, b) = layers_of(vector, sizes)
    out = np.empty(len(x))
    for at in range(0, len(x), CACHED_ROWS):
        a = x[at : at + CACHED_ROWS]
        for v, c in hidden:
            a = _rectified(a, v, c)
        out[at : at + CACHED_ROWS] = (a @ w + b)[:, 0]
    return out


def _rectified(x: np.ndarray, w: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = x @ w
    out += b
    return np.maximum(out, 0.0, out=out)


def loss_and_gradient(vector: np.ndarray, sizes: tuple[int, ...], x: np.ndarray, y: np.ndarray, l2: float) -> tuple[float, np.ndarray]:
    """Mean log loss of a batch, with l2 / 2 of the squared weights over its rows, and its gradient."""
    parts, out, n = layers_of(vector, sizes), np.empty_like(vector), len(y)
    inputs = [x]
    for w, b in parts[:-1]:
        inputs.append(_rectified(inputs[-1], w, b))
    z = (inputs[-1] @ parts[-1][0] + parts[-1][1])[:, 0]
    loss = float(np.mean(np.logaddexp(0.0, z) - y * z)) + l2 / 2 * sum(float((w * w).sum()) for w, _ in parts) / n
    delta = ((sigmoid(z) - y) / n)[:, None]
    for (w, _), (gw, gb), a in zip(reversed(parts), reversed(layers_of(out, sizes)), reversed(inputs)):
        np.matmul(a.T, delta, out=gw)
        gw += l2 / n * w
        delta.sum(axis=0, out=gb)
        if a is not x:
            delta = delta @ w.T
            delta *= a > 0
    return loss, out


@dataclass
class FittedNet:
    sizes: tuple[int, ...]
    vector: np.ndarray
    passes: int
    features_col: str = "features"

    def transform(self, df: DataFrame) -> DataFrame:
        """``df`` with ``margin``, ``probability_1`` and ``prediction``."""
        vector, sizes = self.vector, self.sizes

        @F.pandas_udf(T.DoubleType())
        def margin(features: pd.Series) -> pd.Series:
            return pd.Series(margins(vector, sizes, np.stack(features.to_list())) if len(features) else np.zeros(0))

        scored = df.withColumn("margin", margin(as_array(df, self.features_col)))
        return scored.withColumns({"probability_1": 1 / (1 + F.exp(-F.col("margin"))), "prediction": (F.col("margin") > 0).cast("double")})


@dataclass(frozen=True)
class Net:
    hidden: tuple[int, ...] = (256, 128)
    passes: int = 200
    batch: int = 256
    step: float = 1e-3
    l2: float = 1e-4
    held_out: float = 0.1
    patience: int = 10
    tolerance: float = 1e-4
    seed: int = 42
    label_col: str = "label"
    features_col: str = "features"

    def fit(self, rows: DataFrame, start: FittedNet | None = None) -> FittedNet:
        """The fitted net; with ``start``, from its weights, with moments of zero. Rows without a label are left out; no rows are an error."""
        with temporary_tables():
            x, y = as_array(rows, self.features_col), F.col(f"`{self.label_col}`").cast("double")
            slim = written(rows.select(x.alias("x"), y.alias("y"), F.xxhash64(x, y).alias("key")).where("y IS NOT NULL"), "net-rows")
            size = slim.agg(F.max(F.size("x")).alias("d"), F.count("*").alias("n")).first()
            if not size["n"]:
                raise ValueError("no rows to fit")
            sizes = (size["d"], *self.hidden, 1)
            n_blocks = -(-size["n"] // min(BLOCK_ROWS, max(self.batch, BLOCK_BYTES // (8 * max(size["d"], 1)))))
            drawn = F.pmod(F.xxhash64("key", "copy", F.lit(self.seed)), F.lit(1 << 20)) < int(self.held_out * (1 << 20))
            blocks = written(_blocks(_dealt(slim, n_blocks).withColumn("held", drawn)), "net-blocks").persist()
            held = blocks.agg(F.sum("n_held")).first()[0]
            watched = 0 < held < size["n"]
            try:
                return self._fitted(blocks, n_blocks, sizes, watched, first_weights(sizes, self.seed) if start is None else start.vector)
            finally:
                blocks.unpersist()

    def _fitted(self, blocks: DataFrame, n_blocks: int, sizes: tuple[int, ...], watched: bool, vector: np.ndarray) -> FittedNet:
        state, steps = np.concatenate([vector, np.zeros(2 * len(vector))]), 0
        best, best_vector, waited = -np.inf, vector, 0
        i, last, chunk = -1, self.passes + watched, PASSES if n_blocks == 1 else 1  # the accuracy of a pass is known in the next one
        while i + 1 < last and waited <= self.patience:
            for got, after in self._passes(blocks, n_blocks, sizes, state, steps, range(i + 1, min(i + 1 + chunk, last)), watched):
                i += 1
                score = got["hits"] / got["held"] if watched else -got["loss"] / got["rows"]
                if i or not watched:
                    waited = 0 if score >= best + self.tolerance else waited + 1
                    if score > best or not watched:
                        best, best_vector = max(best, score), (state if watched else after)[: len(vector)]
                if waited > self.patience:
                    break
                state, steps = after, steps + got["steps"]
        return FittedNet(sizes, best_vector, i + (not watched), self.features_col)

    def _passes(self, blocks: DataFrame, n_blocks: int, sizes: tuple[int, ...], state: np.ndarray, steps: int, numbers: range, watched: bool) -> list[tuple[dict, np.ndarray]]:
        """For each of the passes, one if there are several blocks: counts over all blocks, and the average state that they arrive at."""
        n_slices, size, me = min(n_blocks, SLICES), n_weights(sizes), self
        cuts = np.linspace(0, len(state), n_slices + 1).astype(int)

        def go(batches):
            for batch in batches:
                for row in batch.to_pylist():
                    x = np.frombuffer(row["x"]).reshape(row["n"], sizes[0])
                    y, held = np.frombuffer(row["y"]), np.frombuffer(row["held"], bool) & watched
                    n, now, done = int((~held).sum()), state, steps
                    for number in numbers:
                        hits = int(((margins(now[:size], sizes, x[held]) > 0) == (y[held] > 0.5)).sum())
                        loss, made = 0.0, 0
                        if number < me.passes and n:
                            loss, made, now = me._batches(x[~held], y[~held], sizes, now.copy(), done, [me.seed, number, row["block"] % 2**63])
                        done += made
                        told = {"number": number, "block": row["block"], "rows": n, "loss": loss, "hits": hits, "held": int(held.sum()), "steps": made}
                        yield _record([{"part": k, "vector": now[a:b].tobytes(), **told} for k, (a, b) in enumerate(zip(cuts, cuts[1:]))])

        def average(batches):
            rows = sorted((r for batch in batches for r in batch.to_pylist()), key=lambda r: (r["part"], r["block"]))
            out: dict[int, dict] = {}
            for r in rows:
                v = np.frombuffer(r["vector"]) * r["rows"]
                if r["part"] in out:
                    has = out[r["part"]]
                    has["vector"] += v
                    has["steps"] = max(has["steps"], r["steps"])
                    has |= {c: has[c] + r[c] for c in ("rows", "loss", "hits", "held")}
                else:
                    out[r["part"]] = r | {"vector": v}
            yield _record([r | {"vector": (r["vector"] / max(r["rows"], 1)).tobytes()} for r in out.values()])

        passed = blocks.mapInArrow(go, PASSED)
        if n_blocks > 1:
            passed = passed.repartition(n_slices, "part").mapInArrow(average, PASSED)
        got = sorted((r.asDict() for r in passed.collect()), key=lambda r: (r["number"], r["part"]))
        return [(got[k], np.concatenate([np.frombuffer(r["vector"]) for r in got[k : k + n_slices]])) for k in range(0, len(got), n_slices)]

    def _batches(self, x: np.ndarray, y: np.ndarray, sizes: tuple[int, ...], state: np.ndarray, steps: int, seed: list[int]) -> tuple[float, int, np.ndarray]:
        """(summed loss, steps, state) after all batches of a block, in an order drawn for the pass."""
        order, made, loss = np.random.default_rng(seed).permutation(len(y)), 0, 0.0
        w, m, v = np.split(state, 3)  # views
        a, b = np.empty_like(w), np.empty_like(w)
        for at in range(0, len(order), self.batch):
            some = order[at : at + self.batch]
            part, g = loss_and_gradient(w, sizes, x[some], y[some], self.l2)
            made, loss = made + 1, loss + part * len(some)
            np.subtract(g, m, out=a)
            a *= 1 - DECAY_1
            m += a
            np.multiply(g, g, out=a)
            a -= v
            a *= 1 - DECAY_2
            v += a
            t = steps + made
            np.sqrt(v, out=a)
            a += EPSILON
            np.multiply(self.step * np.sqrt(1 - DECAY_2**t) / (1 - DECAY_1**t), m, out=b)
            b /= a
            w -= b
        return loss, made, state


def _record(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, pa.schema([(name, KINDS[kind]) for name, kind in (c.split() for c in PASSED.split(", "))]))


def _dealt(slim: DataFrame, n_blocks: int) -> DataFrame:
    """The rows in ``n_blocks`` partitions by the hash of what they hold and the number of the copy, so that a fit doesn't depend on how its rows came
    and a row of very many copies is in all blocks. Copies are counted, then made again by many tasks."""
    same = slim.groupBy("x", "y", "key").agg(F.count("*").alias("n"))
    parts = same.withColumn("part", F.explode(F.expr(f"sequence(0, (n - 1) div {COPIES})"))).repartition(n_blocks, "key", "part")
    each = parts.withColumn("copy", F.explode(F.expr(f"sequence(part * {COPIES}, least(n, (part + 1) * {COPIES}) - 1)")))
    return each.repartition(n_blocks, "key", "copy").select("x", "y", "key", "copy")


def _blocks(dealt: DataFrame) -> DataFrame:
    """A row for each partition, its rows in the order of their hashes; its number is the first of them."""

    def pack(batches):
        parts = [pa.Table.from_batches([b]) for b in batches if b.num_rows]
        if not parts:
            return
        t = pa.concat_tables(parts).sort_by([("key", "ascending"), ("copy", "ascending")])
        held = t["held"].to_numpy()
        numbers = [pa.array([t["key"][0].as_py()]), pa.array([t.num_rows], pa.int32()), pa.array([int(held.sum())], pa.int32())]
        x = t["x"].combine_chunks().flatten().to_numpy()
        yield pa.RecordBatch.from_arrays([*numbers, *(pa.array([a.tobytes()], pa.binary()) for a in (x, t["y"].to_numpy(), held))], names=["block", "n", "n_held", "x", "y", "held"])

    return dealt.mapInArrow(pack, BLOCK)
