"""Toxicity by gradient-boosted trees over dense features, calibrated by isotonic regression.

Features of a text: densities of a lexicon, closeness of its hits to the second person, capitals, punctuation and
obfuscation. The lexicon, words and word stems that mark toxic documents, is learned from the labelled rows by
smoothed odds; the trees and the calibration are Spark ML models fitted on a bounded sample of labelled rows.

Null and empty texts have features too and get a score. Rows without a label, with one that is neither 0 nor 1 or with an id
that is null don't train; of contradicting labels of one id the toxic one holds. Without both labels every score is 0.
A quarter of each label's rows calibrates and trains neither lexicon nor trees; where a label has a single
row nothing is held back, the model says so (``calibration`` is None) and its scores are the trees' own.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rulewright.llm.langid import hash_share, hashed
from rulewright.llm.shared import give_back, unique_name, written

#: Labelled rows learned from, entries of the lexicon, least toxic documents and least odds ratio of an entry.
TRAIN_ROWS, LEXICON, LEAST_DOCS, LEAST_ODDS = 12_000, 2000, 4, 15.0
TREES, DEPTH, NEAR = 20, 3, 40
#: Second-person words of the languages expected.
SECOND = "you your yours yourself u ur tu te toi ton ta tes vous votre vos du dich dir dein deine ihr euch euer tú ti tus usted ustedes vosotros".split()
#: Signs and digits that stand for letters.
LEET = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"})
WORD = re.compile(r"[^\W\d_]+")
DISGUISED = re.compile(r"[^\W\d_]+(?:[*@$!0-9._-]+[^\W\d_]+)+")
STEMS = (4, 5, 6)
FEATURES = ("hits", "hits_per_word", "distinct", "weight_per_word", "most_weight", "second_per_word", "near_second", "near_share", "capitals", "shouting", "exclaim", "punctuation", "digits", "disguised", "disguised_hits", "log_words")


def tokens(text: str) -> set[str]:
    """Lower-cased words and their stems, marked by a star, with letters put back for signs."""
    words = set(WORD.findall(text.lower()))
    words.update(x.lower().translate(LEET) for x in DISGUISED.findall(text))
    return words | {w[:n] + "*" for w in words for n in STEMS if len(w) > n}


def _counted(batches):
    """(token, toxic documents, other documents) with it, summed over up to 300,000 entries at a time."""
    toxic, other = Counter(), Counter()

    def flush():
        names = list(toxic.keys() | other.keys())
        return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([toxic[t] for t in names], pa.int64()), pa.array([other[t] for t in names], pa.int64())], names=["token", "toxic", "other"])

    for batch in batches:
        for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            (toxic if label else other).update(tokens(text or ""))
            if len(toxic) + len(other) > 300_000:
                yield flush()
                toxic.clear()
                other.clear()
    yield flush()


def learn_lexicon(train: DataFrame, n_toxic: int, n_other: int) -> dict[str, float]:
    """Token -> log odds of the at most LEXICON strongest markers in (text, toxic)."""
    sums = train.select("text", "toxic").mapInArrow(_counted, "token string, toxic long, other long").groupBy("token").agg(F.sum("toxic").alias("a"), F.sum("other").alias("b"))
    odds = ((F.col("a") + 0.5) / (n_toxic + 1)) / ((F.col("b") + 0.5) / (n_other + 1))
    best = sums.where(F.col("a") >= LEAST_DOCS).withColumn("odds", odds).where(F.col("odds") >= LEAST_ODDS)
    rows = best.orderBy(F.desc("a"), F.desc("odds"), "token").limit(LEXICON).collect()
    return {r["token"]: float(np.log(r["odds"])) for r in rows}


class Featurizer:
    """Dense features of a text in one pass of an automaton over words, stems and the second person."""

    def __init__(self, lexicon: dict[str, float]):
        self.lexicon, self.automaton = lexicon, ahocorasick.Automaton()
        entries: dict[str, list] = {}
        for word in SECOND:
            entries.setdefault(word, [None, None, False])[2] = True
        for token, weight in lexicon.items():
            entries.setdefault(token.removesuffix("*"), [None, None, False])[token.endswith("*")] = weight
        for word, found in entries.items():
            self.automaton.add_word(word, (len(word), *found))
        self.automaton.make_automaton()

    def _hits(self, low: str) -> tuple[list[int], list[float], list[int]]:
        at, weights, second, size = [], [], [], len(low)
        best: dict[int, float] = {}
        for end, (n, whole, stem, you) in self.automaton.iter(low):
            begin = end - n + 1
            if begin and low[begin - 1].isalpha():
                continue
            closed = end + 1 == size or not low[end + 1].isalpha()
            if you and closed:
                second.append(begin)
            weight = max(whole if closed and whole is not None else 0.0, stem if not closed and stem is not None else 0.0)
            if weight:
                best[begin] = max(weight, best.get(begin, 0.0))
        at = sorted(best)
        weights = [best[i] for i in at]
        return at, weights, second

    def __call__(self, text: str) -> list[float]:
        low = text.lower()
        at, weights, second = self._hits(low)
        seen = np.bincount(np.frombuffer(text.encode(), np.uint8), minlength=256)
        white = int(seen[[32, *range(9, 14)]].sum())
        words, chars = white + 1, max(len(text), 1)
        upper, lower = int(seen[65:91].sum()), int(seen[97:123].sum())
        signs = int(seen[33:48].sum() + seen[58:65].sum() + seen[91:97].sum() + seen[123:127].sum())
        digits = int(seen[48:58].sum())
        disguised, cloaked = 0, 0
        if digits or seen[[42, 64, 36, 33, 95, 45]].any():
            for x in DISGUISED.findall(text):
                disguised += 1
                plain = x.lower().translate(LEET)
                cloaked += plain in self.lexicon or any(plain[:n] + "*" in self.lexicon for n in STEMS)
        places = np.array(second)
        near = int(sum(np.abs(places - i).min() <= NEAR for i in at)) if at and second else 0
        return [
            len(at), 100 * len(at) / words, len({low[i : i + 4] for i in at}), 100 * sum(weights) / words, max(weights, default=0.0),
            100 * len(second) / words, near, near / max(len(at), 1), upper / max(upper + lower, 1), float(upper > lower), 100 * int(seen[33]) / words,
            signs / chars, digits / chars, 100 * disguised / words, cloaked, float(np.log1p(words)),
        ]


@dataclass
class ToxicityModel:
    lexicon: dict[str, float]
    trees: GBTClassificationModel | None
    calibration: IsotonicRegressionModel | None

    def score(self, docs: DataFrame, text_col: str = "text", score_col: str = "score") -> DataFrame:
        """``docs`` with a score of 0 to 1; narrow. The lexicon has a bounded size."""
        if self.trees is None:
            return docs.withColumn(score_col, F.lit(0.0))
        dense, *made = (unique_name(c, [*docs.columns, score_col]) for c in ("_dense", "_features", "_raw", "_probability", "_prediction", "_chance", "_calibrated"))
        features, raw, probability, prediction, chance, calibrated = made
        df = featurized(docs, self.lexicon, text_col, dense).withColumn(features, array_to_vector(F.col(dense)))
        trees = self.trees.copy().setFeaturesCol(features).setRawPredictionCol(raw).setProbabilityCol(probability).setPredictionCol(prediction)
        df = trees.transform(df).withColumn(chance, vector_to_array(F.col(probability))[1])
        if self.calibration is None:
            df = df.withColumn(calibrated, F.col(chance))
        else:
            df = self.calibration.copy().setFeaturesCol(chance).setPredictionCol(calibrated).transform(df)
        return df.withColumn(score_col, F.least(F.greatest(F.col(calibrated), F.lit(0.0)), F.lit(1.0))).drop(dense, *made)


def featurized(docs: DataFrame, lexicon: dict[str, float], text_col: str, name: str) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)

    @F.pandas_udf("array<double>")
    def features(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        of = Featurizer(shared.value)
        for texts in batches:
            yield pd.Series([np.array(of(t or ""), float) for t in texts], dtype=object)
        give_back()

    return docs.withColumn(name, features(F.col(f"`{text_col}`").cast("string")))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", train_rows: int = TRAIN_ROWS) -> ToxicityModel:
    """Fits on about ``train_rows`` of the labelled rows, chosen by hash of the id; a quarter of each label calibrates.

    Only the sample's ids and labels are written and joined to the documents: a small table that Spark broadcasts
    below its limit. The sample's features go to the ML fits; the corpus never does.
    """
    label = F.col(f"`{label_col}`").try_cast("double")
    known = labels.select(F.col(f"`{id_col}`").alias("id"), label.alias("toxic")).where("id IS NOT NULL AND toxic IN (0, 1)")
    known = known.groupBy("id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    share = hash_share(train_rows, known.count())
    chosen = written(known.where(hashed(F.col("id")) < share), "labelled")
    of_label = Window.partitionBy("toxic").orderBy(F.xxhash64(F.col("id").cast("string"), F.lit(1)), F.col("id").cast("string"))
    chosen = chosen.withColumn("part", F.pmod(F.row_number().over(of_label), F.lit(4)))  # of a bounded sample
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text")).join(chosen, "id")
    rows = written(rows, "train")
    parts = rows.groupBy("toxic").agg(F.count("*").alias("n"), F.count_if(F.col("part") == 1).alias("held"), F.count_if(F.col("part") != 1).alias("fitted"))
    n = {r["toxic"]: r for r in parts.collect()}
    if len(n) < 2:
        return ToxicityModel({}, None, None)
    calibrates = all(r["held"] and r["fitted"] for r in n.values())
    fitted = F.col("part") != 1 if calibrates else F.lit(True)
    size = "fitted" if calibrates else "n"
    lexicon = learn_lexicon(rows.where(fitted), n[1][size], n[0][size])
    dense = featurized(rows, lexicon, "text", "dense").select("id", "dense", "part", F.col("toxic").cast("double").alias("label"))
    dense = written(dense.coalesce(8), "train-features").withColumn("features", array_to_vector("dense"))
    trees = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=0.2, seed=7, maxBins=64).fit(dense.where(fitted))
    if not calibrates:
        return ToxicityModel(lexicon, trees, None)
    held = trees.transform(dense.where(~fitted)).select("label", vector_to_array("probability")[1].alias("chance"))
    return ToxicityModel(lexicon, trees, IsotonicRegression(featuresCol="chance", labelCol="label").fit(held))


def keep_civil(docs: DataFrame, model: ToxicityModel, text_col: str = "text", limit: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score below the limit, with the columns of ``docs``."""
    score = unique_name("_score", docs.columns)
    return model.score(docs, text_col, score).where(F.col(score) < limit).drop(score)
