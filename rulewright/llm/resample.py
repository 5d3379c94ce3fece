"""Resampling of documents towards the word distribution of a target, by exact integer weights and Gumbel noise.

A feature is a run of consecutive words, its bucket a hash of its bytes. A bucket's gain says how much more frequent it is in
the target than in the corpus; a document's weight is the sum of the gains of its features. The sum is bit-sliced: bit i of
all bucket counts of a document is one plane of a bit for each bucket, bit j of the gains is a plane too (positive and negative
gains apart), and the weight is the sum of 2^(i+j) times the set bits that two planes share. It is exact at every size.

What the driver holds is one number a bucket. Corpus counts are summed in each task first, so a task sends at most
a row for each bucket. The draw is a rank over all documents, numbered by ranges.

A null or empty text has no features and a weight of 0. A null id hashes as an empty one. Rows that repeat an id have the same
noise; equal scores are ranked by the smaller id, rows equal in both in no stated order. Empty tables give empty results; an empty target
or corpus is smoothed like any other. Other columns are not carried.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rulewright.llm.shared import give_back, written
from rulewright.sources.tables import with_row_id

#: Bytes of a text that are split into words at once; words kept with their bucket in a worker.
SLICE, CACHED = 1 << 20, 1 << 20

#: Lower-cases A-Z and makes a space of every ASCII character but letters and digits; other bytes are parts of words.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


@dataclass(frozen=True)
class Features:
    """Runs of 1 to ``longest`` words, in one of ``buckets`` buckets."""

    longest: int = 1
    buckets: int = 10_000


class Buckets(dict):
    """The bucket of a feature's bytes; forgets all when it holds ``CACHED`` of them."""

    def __init__(self, buckets: int):
        super().__init__()
        self.buckets = buckets

    def __missing__(self, feature: bytes) -> int:
        if len(self) >= CACHED:
            self.clear()
        bucket = self[feature] = zlib.crc32(feature) % self.buckets
        return bucket


def word_slices(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text in order, ``SLICE`` bytes or one word at a time."""
    at = 0
    while at < len(text):
        end = at + SLICE
        while end < len(text) and FOLD[text[end]] != 32:
            end += 1
        yield text[at:end].translate(FOLD).split()
        at = end


def count_buckets(text: bytes | None, features: Features, bucket_of: Buckets) -> tuple[np.ndarray, int]:
    """(features in each bucket, number of words) of a text."""
    counts, n_words, before = np.zeros(features.buckets, np.int64), 0, []
    for words in word_slices(text or b""):
        n_words += len(words)
        found = list(map(bucket_of.__getitem__, words))
        for n in range(2, features.longest + 1):
            run = before[len(before) - (n - 1) :] + words if len(before) >= n - 1 else before + words
            found += [bucket_of[b" ".join(run[i : i + n])] for i in range(len(run) - n + 1)]
        before = (before + words)[-(features.longest - 1) :] if features.longest > 1 else []
        counts += np.bincount(found, minlength=features.buckets) if found else 0
    return counts, n_words


def bucket_totals(texts: DataFrame, text_col: str, features: Features) -> np.ndarray:
    """Features of all texts in each bucket. Each task adds up its texts; the driver gets one number for each bucket."""

    def count(batches):
        total, bucket_of = np.zeros(features.buckets, np.int64), Buckets(features.buckets)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                total += count_buckets(text, features, bucket_of)[0]
        at = np.nonzero(total)[0]
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])], ["bucket", "n"])
        give_back()

    counted = texts.select(F.col(f"`{text_col}`").cast("binary").alias("text")).mapInArrow(count, "bucket int, n long")
    total = np.zeros(features.buckets, np.int64)
    for row in counted.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        total[row["bucket"]] = row["n"]
    return total


def bucket_gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * ln(smoothed share in the target / smoothed share in the corpus)) of each bucket."""
    buckets, of_corpus, of_target = len(corpus), float(corpus.sum()), float(target.sum())
    ratio = lambda s, t: (t + 1) * (of_corpus + buckets) / ((s + 1) * (of_target + buckets))
    return np.array([math.floor(1000 * math.log(ratio(float(s), float(t)))) for s, t in zip(corpus.tolist(), target.tolist(), strict=True)], np.int64)


def plane(bits: np.ndarray) -> np.ndarray:
    """A bit for each bucket, 64 to a word."""
    packed = np.packbits(bits.astype(np.uint8))
    return np.pad(packed, (0, -len(packed) % 8)).view(np.uint64)


@dataclass(frozen=True)
class GainPlanes:
    """Row j of ``positive`` has bit j of the gains above 0, row j of ``negative`` that of the others' absolute values."""

    positive: np.ndarray
    negative: np.ndarray

    @classmethod
    def of(cls, gains: np.ndarray) -> GainPlanes:
        def sliced(values: np.ndarray) -> np.ndarray:
            return np.stack([plane(values >> j & 1) for j in range(max(int(values.max(initial=0)).bit_length(), 1))])

        return cls(sliced(np.maximum(gains, 0)), sliced(np.maximum(-gains, 0)))

    def weight(self, counts: np.ndarray) -> int:
        """The sum of counts times gains, by shared bits of planes."""
        total = 0
        for i in range(int(counts.max(initial=0)).bit_length()):
            bits = plane(counts >> i & 1)
            for sign, gains in ((1, self.positive), (-1, self.negative)):
                shared = np.bitwise_count(bits & gains).sum(axis=1, dtype=np.int64)
                total += sign * sum(n << (i + j) for j, n in enumerate(shared.tolist()))
        return total


def weigh(docs: DataFrame, gains: np.ndarray, features: Features, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, n_features, weight) of every row."""
    planes = GainPlanes.of(gains)

    def weights(batches):
        bucket_of = Buckets(features.buckets)
        for batch in batches:
            found = []
            for text in batch.column(1).to_pylist():
                counts, n_words = count_buckets(text, features, bucket_of)
                found.append((n_words, int(counts.sum()), planes.weight(counts)))
            columns = [pa.array(x, pa.int64()) for x in zip(*found, strict=True)] if found else [pa.array([], pa.int64())] * 3
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["id", "n_words", "n_features", "weight"])
        give_back()

    slim = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("binary").alias("text"))
    return slim.mapInArrow(weights, f"id {slim.schema['id'].dataType.simpleString()}, n_words long, n_features long, weight long").withColumnRenamed("id", id_col)


def resample(docs: DataFrame, target: DataFrame, features: Features = Features(), seed: int = 2024, percent: int = 10, least_words: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_features, weight, score, rank) of every row of ``docs``: rank 1, 2, .. for the draw of ``percent`` in a hundred of the
    rows with at least ``least_words`` words, null for all others."""
    gains = bucket_gains(bucket_totals(docs, text_col, features), bucket_totals(target, text_col, features))
    key = F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit(""))
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), key), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    scored = weigh(docs, gains, features, id_col, text_col).withColumn("score", F.col("weight") + noise)
    scored = written(scored.select(F.col(f"`{id_col}`").alias("id"), "n_words", "n_features", "weight", "score"), "resample-scores")
    drawn = percent * scored.where(F.col("n_words") >= least_words).count() // 100
    ordered = scored.withColumns({"_left_out": F.col("n_words") < least_words, "_falling": -F.col("score")})
    placed = with_row_id(ordered, ["_left_out", "_falling", "id"], "_place")
    return placed.select(F.col("id").alias(id_col), "n_features", "weight", "score", F.when(F.col("_place") < drawn, F.col("_place") + 1).alias("rank"))
