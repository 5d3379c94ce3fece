"""Language identification by mixture inference.

Each language has a smoothed distribution of character trigrams. A word's likelihood under a language is the product over
its letters' trigrams. Expectation-maximisation finds each document's language proportions from its words; then the
nested sets of the likeliest languages compete by penalised likelihood, and the largest share of the set that wins is
the prediction, its share the score; the whole set and its shares come with it.

Each fit runs until the shares are at rest, and sets of any number of languages compete.

Null text, or text without a letter, is ``und`` with score 0; so is every text where nothing was learned. Long texts
are scored whole, in bounded chunks of documents. Repeated rows are scored each by itself.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rulewright.llm.pretok import LETTER, chunks, class_table

#: Trigram buckets, rows learned from per language, price of a language in words' log.
BUCKETS, TRAIN_ROWS, PENALTY, SMOOTHING = 1 << 16, 4000, 2.0, 0.05
#: Expectation-maximisation ends when no share of a text moves by more than TOLERANCE, or after MOST_ROUNDS.
TOLERANCE, MOST_ROUNDS = 1e-3, 500
LANGUAGES = T.ArrayType(T.StructType([T.StructField("lang", T.StringType()), T.StructField("share", T.DoubleType())]))


@lru_cache(None)
def _lower_letters() -> np.ndarray:
    """Lower-case code point of each letter, 0 for all else."""
    table = np.where(class_table() == LETTER, np.arange(0x110000), 0).astype(np.uint32)
    for i in np.flatnonzero(table[:0x20000]).tolist():
        low = chr(i).lower()
        if len(low) == 1:
            table[i] = ord(low)
    return table


def trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket of the trigram around each letter, index of each word's first letter, words of each text)."""
    cp = np.frombuffer(("\n" + "\n".join(texts) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
    c = _lower_letters()[cp]
    at = np.flatnonzero(c)
    before, after = c[at - 1], c[at + 1]
    h = before * np.uint32(0x9E3779B1) + c[at] * np.uint32(0x85EBCA6B) + after * np.uint32(0xC2B2AE35)
    h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    first = np.flatnonzero(before == 0)
    ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
    return (h >> np.uint32(16)).astype(np.int64), first, np.diff(np.searchsorted(at[first], np.append(0, ends)))


def learn(rows: DataFrame, lang_col: str = "lang", text_col: str = "text", id_col: str = "doc_id", train_rows: int = TRAIN_ROWS) -> tuple[list[str], np.ndarray]:
    """(languages, log-probabilities (BUCKETS, languages)) from about ``train_rows`` rows of each language, chosen by hash of the id.

    Counts are summed by task and by a shuffle; the driver gets the totals, at most BUCKETS for each language.
    """
    rows = rows.select(F.col(f"`{id_col}`").cast("string").alias("id"), F.col(f"`{lang_col}`").cast("string").alias("lang"), F.col(f"`{text_col}`").cast("string").alias("text")).where("lang IS NOT NULL AND text IS NOT NULL")
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs = sorted(counts)
    if not langs:
        return [], np.zeros((BUCKETS, 0), np.float32)
    share = F.create_map(*[F.lit(x) for k in langs for x in (k, hash_share(train_rows, counts[k]))])
    sample = rows.where(hashed(F.col("id")) < share[F.col("lang")])

    def count(batches):
        for batch in batches:
            names = np.array(batch.column(0).to_pylist())
            for name in np.unique(names).tolist():
                texts = [t.as_py() for t in batch.column(1).filter(pa.array(names == name))]
                total = np.zeros(BUCKETS, np.int64)
                for a, b in chunks(texts):
                    total += np.bincount(trigrams(texts[a:b])[0], minlength=BUCKETS)
                some = np.flatnonzero(total)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(some), pa.string()), pa.array(some.astype(np.int32)), pa.array(total[some])], names=["lang", "bucket", "n"])

    sums = sample.select("lang", "text").mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    table = np.full((BUCKETS, len(langs)), SMOOTHING)
    table[sums["bucket"].to_numpy(), np.searchsorted(np.array(langs), np.array(sums["lang"].to_pylist(), dtype=str))] += sums["n"].to_numpy()
    return langs, np.log(table / table.sum(axis=0)).astype(np.float32)


def maximise(like: np.ndarray, n: np.ndarray, p: np.ndarray) -> np.ndarray:
    """The proportions at which expectation-maximisation from ``p`` ends, for texts of ``n`` words each.

    ``like`` holds the words' likelihoods by language. Texts that have come to rest leave the rounds.
    """
    out = p.copy()
    active = np.flatnonzero((p > 0).sum(axis=1) > 1)
    like = like if len(active) == len(p) else like[np.repeat(np.isin(np.arange(len(p)), active), n)]
    n, p = n[active], p[active]
    for _ in range(MOST_ROUNDS):
        if not len(active):
            break
        start = np.cumsum(n) - n
        r = like * np.repeat(p, n, axis=0)
        r /= np.maximum(r.sum(axis=1, keepdims=True), 1e-30)
        after = np.add.reduceat(r, start, axis=0) / n[:, None]
        moving = np.abs(after - p).max(axis=1) > TOLERANCE
        out[active], p = after, after
        if 2 * moving.sum() < len(moving):
            like, active, n, p = like[np.repeat(moving, n)], active[moving], n[moving], p[moving]
    return out


def proportions(texts: list[str], logp: np.ndarray) -> np.ndarray:
    """(texts, languages): the shares of the chosen set of languages, 0 for all others and for text without a letter."""
    shares = np.zeros((len(texts), logp.shape[1]))
    grams, first, words = trigrams(texts)
    full = np.flatnonzero(words)
    if not len(full) or not logp.shape[1]:
        return shares
    n = words[full]
    doc, start = np.repeat(np.arange(len(full)), n), np.cumsum(n) - n
    like = np.add.reduceat(logp[grams], first, axis=0)
    top = like.max(axis=1)
    like = np.exp(like - top[:, None])
    top = np.add.reduceat(top, start)

    def fit(allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(proportions, log-likelihood) with the allowed languages only."""
        p = maximise(like, n, allowed / allowed.sum(axis=1, keepdims=True))
        ll = np.log(np.maximum((like * p[doc]).sum(axis=1), 1e-30))
        return p, top + np.add.reduceat(ll, start)

    first_shares, _ = fit(np.ones((len(full), logp.shape[1]), np.float32))
    rank = np.argsort(np.argsort(-first_shares, axis=1, kind="stable"), axis=1)
    won, value = None, None
    for size in range(1, logp.shape[1] + 1):
        price = PENALTY * size * np.log1p(n)
        if won is not None and not (top - price > value).any():
            break  # even a likelihood of each word's best language would not win
        p, ll = fit((rank < size).astype(np.float32))
        ll = ll - price
        if won is None:
            won, value = p, ll
        else:
            better = ll > value
            won, value = np.where(better[:, None], p, won), np.where(better, ll, value)
    shares[full] = np.clip(won, 0, 1)
    return shares


def mixtures(texts: list[str], logp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(best language or -1, its share) of each text."""
    return _best(proportions(texts, logp))


def _best(shares: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not shares.shape[1]:
        return np.full(len(shares), -1), np.zeros(len(shares))
    score = shares.max(axis=1)
    return np.where(score > 0, shares.argmax(axis=1), -1), score


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score, languages): the last are the chosen set and its shares, largest first. Narrow; the model is broadcast: BUCKETS numbers for each language, whatever the corpus."""
    langs, logp = model
    shared = docs.sparkSession.sparkContext.broadcast((langs, logp))
    schema = T.StructType([docs.schema[id_col], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("languages", LANGUAGES)])

    def run(batches):
        langs, logp = shared.value
        names = pa.array([*langs, "und"], pa.string())
        most = max(20_000, 2_000_000 // max(4, len(langs)))
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            found = [proportions(texts[a:b], logp) for a, b in chunks(texts, most)]
            if found:
                shares = np.concatenate(found)
                best, score = _best(shares)
                order = np.argsort(-shares, axis=1, kind="stable")
                ranked = np.take_along_axis(shares, order, axis=1)
                in_set = ranked > 0
                ends = np.append(0, np.cumsum(in_set.sum(axis=1))).astype(np.int32)
                chosen = pa.StructArray.from_arrays([names.take(pa.array(order[in_set])), pa.array(ranked[in_set])], names=["lang", "share"])
                columns = [batch.column(0), names.take(pa.array(np.where(best < 0, len(langs), best))), pa.array(score), pa.ListArray.from_arrays(pa.array(ends), chosen)]
                yield pa.RecordBatch.from_arrays(columns, names=[id_col, "lang_pred", "score", "languages"])

    return docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`").cast("string")).mapInArrow(run, schema)


HASHES = 1 << 60


def hashed(id_: Column) -> Column:
    """A hash of the id below HASHES; fine enough for a share of any table."""
    return F.pmod(F.xxhash64(id_.cast("string")), F.lit(HASHES))


def hash_share(wanted: int, n: int) -> int:
    """The bound below which the hashes of about ``wanted`` of ``n`` rows lie."""
    return HASHES * min(wanted, n) // max(n, 1)


def fold(id_col: str, folds: int) -> Column:
    """crc32 of the id as text, modulo the number of folds."""
    return F.crc32(F.col(f"`{id_col}`").cast("string")) % folds
