"""Resampling, collocations and exact search against brute force, on small tables with nulls, ties, repeated rows and clashing columns."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest

from rulewright.llm import collocations, resample, topk

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
TEXTS = [None, "", "   ...", "Ünï CÖDE Ünï x1 x1", "The cat sat. The cat sat; the CAT\tsat on\x0bthe mat!", "a b c d e f g " * 30, "solo", "the cat sat. the cat sat; the cat sat on the mat!", "tab\there  two  spaces", "\x00odd \x7fbytes\x1f here", "a b a b a b a b a b, a b"]


def plain_features(text, longest, buckets):
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(LOWER))
    runs = [" ".join(words[i : i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)]
    return len(words), [zlib.crc32(r.encode()) % buckets for r in runs]


def plain_resample(docs, target, longest, buckets, seed, percent, least_words):
    found = {i: plain_features(t, longest, buckets) for i, t in enumerate(x for _, x in docs)}
    s, t = Counter(b for _, bs in found.values() for b in bs), Counter(b for x in target for b in plain_features(x, longest, buckets)[1])
    s_all, t_all = float(sum(s.values())), float(sum(t.values()))
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s_all + buckets) / ((s[b] + 1) * (t_all + buckets)))) for b in range(buckets)]
    out = []
    for i, (doc_id, _) in enumerate(docs):
        h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in found[i][1])
        out.append([doc_id, len(found[i][1]), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, found[i][0]])
    able = sorted((r for r in out if r[5] >= least_words), key=lambda r: (-r[3], -1 if r[0] is None else r[0]))
    for place, r in enumerate(able[: percent * len(able) // 100]):
        r[4] = place + 1
    return sorted((tuple(r[:5]) for r in out), key=str)


@pytest.mark.parametrize("longest, buckets", [(1, 10_000), (3, 37)])
def test_resampling(spark, longest, buckets, monkeypatch):
    monkeypatch.setattr(resample, "SLICE", 16)
    docs = [(i, t) for i, t in enumerate(TEXTS * 3)] + [(3, TEXTS[3]), (None, "the cat " * 20), (500, "mat " * 5000)]
    target = ["the mat", None, "a b c, the cat", "code x1"]
    df = spark.createDataFrame([(i, t, 1, 2, "x") for i, t in docs], "doc_id long, text string, weight int, n_words int, rank string").repartition(3)
    aim = spark.createDataFrame([(t, 1) for t in target], "text string, bucket int")
    got = resample.resample(df, aim, resample.Features(longest, buckets), seed=7, percent=40, least_words=3)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain_resample(docs, target, longest, buckets, 7, 40, 3)


def test_resampling_of_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    one = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert resample.resample(none, one).count() == 0
    assert [tuple(r)[:2] + (r["rank"],) for r in resample.resample(one, none, least_words=1, percent=100).collect()] == [(1, 2, 1)]


def test_planes_hold_the_weight_exactly():
    rng = np.random.default_rng(1)
    gains = np.append(rng.integers(-(2**40), 2**40, 99), 2**44)
    counts = np.append(rng.integers(0, 2**30, 99), 2**31)
    assert resample.GainPlanes.of(gains).weight(counts) == sum(int(a) * int(b) for a, b in zip(gains, counts, strict=True))
    assert resample.GainPlanes.of(gains).weight(np.zeros(100, np.int64)) == 0


def plain_collocations(docs, least, longest, top, percent):
    f, n = Counter(), Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            words = [w for w in re.split("[\x20\x09]+", piece) if w]
            n[lang] += len(words)
            f.update((lang, tuple(words[i : i + k])) for k in range(1, longest + 1) for i in range(len(words) - k + 1))
    candidates = {p: a for p, a in f.items() if len(p[1]) > 1 and a >= least}
    most = defaultdict(int)
    for (lang, p), a in candidates.items():
        for m in range(2, len(p)):
            for s in range(len(p) - m + 1):
                most[lang, p[s : s + m]] = max(most[lang, p[s : s + m]], a)
    by_lang = defaultdict(list)
    for (lang, p), a in candidates.items():
        if 100 * most[lang, p] < percent * a:
            score, k = min((math.floor(Fraction(1000 * a * n[lang], f[lang, p[:k]] * f[lang, p[k:]])), k) for k in range(1, len(p)))
            by_lang[lang].append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    return sorted((lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for lang, x in by_lang.items() for i, (s, a, p, l, r) in enumerate(sorted(x)[:top]))


@pytest.mark.parametrize("least, percent, size", [(2, 100, 1), (3, 100, 200), (7, 60, 1000), (30, 100, 1 << 20)])
def test_collocations(spark, least, percent, size, monkeypatch):
    rng = np.random.default_rng(5)
    made = [" ".join(rng.choice(["a", "b", "É", "d.", "e,", "F"], 40)) for _ in range(30)]
    docs = [([None, "en", "de", "und"][i % 4], t) for i, t in enumerate(TEXTS * 2 + made)] + [("en", "x " * 3000), ("fr", None)]
    df = spark.createDataFrame([(lang, t, "x", 1) for lang, t in docs], "lang string, text string, phrase string, n int").repartition(4)
    monkeypatch.setattr(collocations, "SLICE", 64)
    got = collocations.collocations(df, least=least, longest=5, top=25, percent=percent, size=size)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == plain_collocations(docs, least, 5, 25, percent)


def test_no_collocations(spark):
    assert collocations.collocations(spark.createDataFrame([], "lang string, text string")).count() == 0
    assert collocations.collocations(spark.createDataFrame([("en", "a b c")], "lang string, text string")).count() == 0


def test_a_frequent_phrase_reaches_the_support_of_a_shard():
    rng = np.random.default_rng(2)
    for _ in range(200):
        parts = rng.integers(1, 50, rng.integers(1, 40))
        counts = [collocations.local_support(100, int(p), int(parts.sum())) - 1 for p in parts]
        assert sum(counts) < 100


def test_shards_name_phrases_in_proportion_to_the_corpus(spark, monkeypatch):
    """Five times the texts in shards of one size: a support that falls with the corpus has every shard name more."""
    rng, named, real = np.random.default_rng(11), [], collocations.written

    def counted(df, name, *args, **kwargs):
        out = real(df, name, *args, **kwargs)
        if name == "collocation-shards":
            named[-1] += out.count()
        return out

    monkeypatch.setattr(collocations, "written", counted)
    share = 1 / np.arange(1, 41)
    made = [" ".join(f"w{i}" for i in rng.choice(40, 250, p=share / share.sum())) for _ in range(500)]
    for some in (made[:100], made):
        named.append(0)
        df = spark.createDataFrame([("en", t) for t in some], "lang string, text string").repartition(len(some) // 20)
        got = collocations.collocations(df, least=100, size=10_000)
        assert sorted(map(tuple, got.collect())) == plain_collocations([("en", t) for t in some], 100, 5, 2000, 100)
    assert named[1] < 9 * named[0]


def plain_top_k(vectors, ids, k):
    able = [(i, [math.floor(256 * x) for x in v]) for i, v in vectors if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q in sorted({i for i, _ in able if i in ids}):
        asked = min(v for i, v in able if i == q)
        best = sorted((-sum(a * b for a, b in zip(asked, v, strict=False)), i) for i, v in able if i != q)[:k]
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    return out


@pytest.mark.parametrize("scale", [1.0, 1e4, 2.0**21])
def test_top_k(spark, scale, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 7)
    monkeypatch.setattr(topk, "QUERIES", 3)
    rng = np.random.default_rng(3)
    vectors = [(i, [float(x) for x in np.round(rng.normal(size=6), 1) * scale * (rng.random(6) < 0.7)]) for i in range(60)]
    vectors += [(100, None), (101, [1.0, None]), (102, [float("nan")]), (103, [float("inf")]), (104, []), (105, [0.0] * 6), (106, [scale, -scale]), (None, [1.0]), (20, [scale] * 6), (20, [scale] * 6), (41, vectors[41][1])]
    df = spark.createDataFrame([(i, v, 1.0, 2) for i, v in vectors], "vec_id long, embedding array<double>, score double, block int").repartition(3)
    ids = {0, 10, 20, 30, 41, 100, 101, 104, 105}
    got = topk.top_k(df, df.where(df["vec_id"].isin(*ids)), k=5)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert sorted(map(tuple, got.collect())) == plain_top_k(vectors, ids, 5)


def test_top_k_of_few(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, [0.5])], "vec_id long, embedding array<float>")
    assert sorted(map(tuple, topk.top_k(df, df.where("vec_id = 1"), k=5).collect())) == [(1, 1, 2, 256 * 128)]
    assert topk.top_k(df.limit(0), df, k=5).count() == topk.top_k(df, df.limit(0), k=5).count() == 0
    assert topk.top_k(df.where("vec_id = 1"), df, k=5).count() == 1


def test_top_k_scores_beyond_64_bits_are_an_error(spark):
    df = spark.createDataFrame([(1, [2.0**30, 2.0**30]), (2, [2.0**30, 2.0**30])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="OverflowError"):
        topk.top_k(df, df, k=1).collect()
