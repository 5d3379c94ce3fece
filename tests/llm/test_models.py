import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from rulewright.llm import langid, quality, queries, toxicity
from tests.conftest import DATA

SF = f"{DATA}/sf0.01"


def brute_quality(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    seen = Counter(grams)
    covered = {i + k for i, g in enumerate(grams) if seen[g] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered), len(lines)


def fails(q, repeat=0.5, symbols=0.5, lines=0.5):
    return q[0] < 50 or 100 * q[4] > 50 * q[0] or q[4] > repeat * q[0] or q[2] > symbols * q[0] or q[3] > lines * q[5]


def brute_kept(rows):
    """(ids kept, verdict of each host) of rows (id, text, host)."""
    counts = {i: brute_quality(t) for i, t, _ in rows}
    hosts: dict = {}
    for i, _, h in rows:
        if h is not None:
            hosts.setdefault(h, []).append(fails(counts[i]))
    rates = [np.mean(x) for x in hosts.values()]
    mean, var = np.mean(rates), np.var(rates)
    between = var - mean * (1 - mean) * np.mean([1 / len(x) for x in hosts.values()])
    weight = mean * (1 - mean) / between - 1 if between > 0 else None  # none: the prior outweighs every host
    shrunk = {h: mean if weight is None else (sum(x) + mean * weight) / (len(x) + weight) for h, x in hosts.items()}
    verdict = {h: "rejected" if r >= 0.8 else "suspect" if r and r >= 1.25 * mean else "trusted" for h, r in shrunk.items()}
    strict = {i for i, _, h in rows if verdict.get(h) == "suspect" and fails(counts[i], 0.25, 0.1, 0.1)}
    return {i for i, _, h in rows if not fails(counts[i]) and verdict.get(h) != "rejected" and i not in strict}, verdict


def test_host_verdicts_decide(spark):
    """The given documents' hosts differ no more than by chance, so none stands out; two hosts that only their rates tell apart do."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want, verdict = brute_kept([(r["doc_id"], r["text"], r["source"]) for r in docs.collect()])
    judged, name = quality.judge_documents(docs)
    rows = judged.collect()
    assert {r["doc_id"] for r in rows if r[name["kept"]]} == want == {r["doc_id"] for r in rows if not r[name["rules_failed"]]}
    assert {r["source"]: r[name["host_verdict"]] for r in rows} == verdict and set(verdict.values()) == {"trusted"}
    lines = [" ".join(f"w{12 * k + i}" for i in range(12)) for k in range(5)]
    good, bad, doubtful = "\n".join(lines), "short", "\n".join([*lines, "x y", "x y"])
    texts = {"a": [good] * 36 + [bad] * 12 + [doubtful] * 2, "b": [good] * 44 + [bad] * 4 + [doubtful] * 2}
    some = [(i, t, h) for i, (h, t) in enumerate((h, t) for h in texts for t in texts[h])]
    judged, name = quality.judge_documents(spark.createDataFrame(some, "doc_id long, text string, source string"))
    kept = {r["doc_id"] for r in judged.collect() if r[name["kept"]]}
    assert kept == brute_kept(some)[0] and {i for i, t, _ in some if t == doubtful} & kept == {98, 99}


@pytest.mark.parametrize("times", [1, 20])
def test_the_prior_is_the_fitted_one_at_every_size(spark, times):
    """Rates and verdicts of hosts that differ by chance alone, and of hosts that do differ, on a table and on one with ``times`` as many documents."""
    chance = [(f"h{i}", n, n // 10 + i % 2) for i, n in enumerate([10] * 8)]
    differ = [("low", 10, 0), ("high", 10, 5), ("middle", 10, 2)]
    for hosts, known in ((chance, {"trusted"}), (differ, {"trusted", "suspect"})):
        rows = [(h, k < f * times) for h, n, f in hosts for k in range(n * times)]
        got = {r["host"]: r for r in quality.host_verdicts(spark.createDataFrame(rows, "source string, failed boolean"), "source", "failed").collect()}
        rates = np.array([f / n for _, n, f in hosts])
        between = rates.var() - rates.mean() * (1 - rates.mean()) * np.mean([1 / (n * times) for _, n, _ in hosts])
        weight = rates.mean() * (1 - rates.mean()) / between - 1 if between > 0 else math.inf
        for (h, n, _), rate in zip(hosts, rates, strict=True):
            want = rates.mean() if weight == math.inf else (rate * n * times + rates.mean() * weight) / (n * times + weight)
            assert got[h]["rate"] == pytest.approx(want)
        if times == 1 or hosts is differ:
            assert {r["verdict"] for r in got.values()} == known


def test_counts(spark):
    texts = [None, "", " \t\n", "a", "a b c a b c", "a a a a a", "x y z\nx y z\n\n \nq", "é 漢 #*$%&|<> \x0b\x0c end\r\nend\r\n", " ".join(["w"] * 3000), " ".join(str(i % 700) for i in range(20000))]
    df = spark.createDataFrame([(i, t, "h") for i, t in enumerate(texts)], "doc_id long, text string, n_words string")
    out, name = quality.with_counts(df)
    assert name["n_words"] != "n_words" and out.columns[:3] == df.columns
    for r in out.collect():
        assert tuple(r[name[c]] for c in quality.COUNTS) == brute_quality(texts[r["doc_id"]])


def test_hosts(spark):
    good, bad = " ".join(f"w{i}" for i in range(60)), "short"
    rows = [(i, good, "fine") for i in range(40)] + [(100 + i, bad, "awful") for i in range(60)] + [(200, good, "awful"), (201, good, None), (202, bad, None), (203, None, "fine"), (204, bad, "lone")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("kept", F.lit("clash"))
    judged, name = quality.judge_documents(df)
    kept = {r["doc_id"]: r[name["kept"]] for r in judged.collect()}
    assert all(kept[i] for i in range(40)) and not any(kept[100 + i] for i in range(60))
    assert kept[200] is False and kept[201] is True and not kept[202] and not kept[203]  # the host's verdict holds for its good page too
    out = quality.keep_good(df)
    assert out.columns == df.columns and {r["doc_id"] for r in out.collect()} == {*range(40), 201}
    assert quality.keep_good(df.limit(0)).count() == 0


def test_languages_held_out(spark):
    got = queries.op6_language_id(spark, SF)
    truth = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    rows = got.join(truth, "doc_id").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert np.mean([r["lang"] == r["lang_pred"] for r in held]) >= 0.97
    assert all(0 <= r["score"] <= 1 for r in rows) and len(rows) == 1000


def test_mixtures():
    rng = np.random.default_rng(1)
    word = lambda letters: "".join(rng.choice(list(letters), 5))
    texts = {k: " ".join(word(v) for _ in range(3000)) for k, v in {"a": "abcde", "b": "vwxyz", "c": "klmno"}.items()}
    table = np.stack([np.bincount(langid.trigrams([t])[0], minlength=langid.BUCKETS) + langid.SMOOTHING for t in texts.values()], axis=1)
    logp = np.log(table / table.sum(axis=0)).astype(np.float32)
    mixed = " ".join([word("abcde")] * 70 + [word("vwxyz")] * 30)
    best, score = langid.mixtures(["", "12 34", mixed, word("klmno")], logp)
    assert best.tolist() == [-1, -1, 0, 2] and score[2] == pytest.approx(0.7, abs=0.03) and score[3] == 1


def brute_em(like, allowed):
    """Shares by plain expectation-maximisation of one text's words, to rest."""
    p = [1 / len(allowed) if j in allowed else 0.0 for j in range(len(like[0]))]
    while True:
        new = [0.0] * len(p)
        for w in like:
            total = sum(a * b for a, b in zip(w, p))
            for j in range(len(p)):
                new[j] += w[j] * p[j] / total / len(like)
        if max(abs(a - b) for a, b in zip(new, p)) < 1e-7:
            return new
        p = new


def test_mixtures_match_brute_force():
    """Five languages: shares and the chosen set, against single words in plain Python."""
    rng = np.random.default_rng(3)
    alphabets = ["abcdefg", "efghijk", "ijklmno", "mnopqrs", "qrstuva"]
    word = lambda j: "".join(rng.choice(list(alphabets[j]), 4))
    learned = [" ".join(word(j) for _ in range(400)) for j in range(5)]
    table = np.stack([np.bincount(langid.trigrams([t])[0], minlength=langid.BUCKETS) + langid.SMOOTHING for t in learned], axis=1)
    logp = np.log(table / table.sum(axis=0)).astype(np.float32)
    mixes = [(1, 1, 1, 1, 1), (6, 3, 1, 0, 0), (1, 0, 0, 0, 0), (0, 5, 0, 5, 0), (9, 0, 0, 0, 1)]
    texts = [" ".join(word(j) for j in range(5) for _ in range(12 * m[j])) for m in mixes]
    got = langid.proportions(texts, logp)
    for text, shares in zip(texts, got):
        words = [langid.trigrams([w])[0] for w in text.split()]
        logs = [logp[g].sum(axis=0).astype(float) for g in words]
        like = [np.exp(x - x.max()) for x in logs]
        order = np.argsort([-x for x in brute_em(like, range(5))], kind="stable")
        best = None
        for size in range(1, 6):
            p = brute_em(like, set(order[:size].tolist()))
            value = sum(np.log(np.dot(w, p)) + x.max() for w, x in zip(like, logs)) - langid.PENALTY * size * np.log1p(len(words))
            if best is None or value > best[0]:
                best = value, p
        assert shares == pytest.approx(best[1], abs=0.02)
    assert (got[0] > 0).sum() == 5 and (got[2] > 0).sum() == 1


@pytest.mark.parametrize("n", [10**6, 5 * 10**9, 10**11])
def test_samples_of_any_table(n):
    for wanted in (4000, 12_000):
        assert langid.hash_share(wanted, n) / langid.HASHES * n == pytest.approx(wanted, rel=1e-6)
    assert langid.hash_share(4000, 10) == langid.HASHES


def test_language_edges(spark):
    docs = spark.createDataFrame([(1, "uno dos tres", "es"), (2, None, "es"), (3, "", None), (4, "123 !", "xx"), (None, "one two three", "en"), (5, "one two three four", "en"), (5, "one two", "en")], "doc_id long, text string, lang string")
    got = [(r["doc_id"], r["lang_pred"]) for r in langid.identify(docs, langid.learn(docs)).collect()]
    assert (2, "und") in got and (3, "und") in got and (4, "und") in got and (1, "es") in got and got.count((5, "en")) == 2
    assert {r["lang_pred"] for r in langid.identify(docs, langid.learn(docs.limit(0))).collect()} == {"und"}
    assert langid.identify(docs.limit(0), langid.learn(docs)).count() == 0


def test_toxicity_held_out(spark):
    got = queries.op7_toxicity(spark, f"{DATA}/sf0.1")
    labels = spark.read.parquet(f"{DATA}/sf0.1/labels.parquet")
    rows = [r for r in got.join(labels, "doc_id").collect() if r["held_out"]]
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 for r in rows)
    pos, neg = [r for r in rows if r["toxic"]], [r for r in rows if not r["toxic"]]
    assert np.mean([r["predicted"] for r in pos]) >= 0.88 and np.mean([r["predicted"] for r in neg]) <= 0.02
    assert got.count() == 10_000


def test_toxicity_edges(spark):
    rows = [(i, f"good words number {i} here" if i % 2 else f"you are a stupid idiot {i}") for i in range(400)] + [(None, "null id"), (900, None), (901, ""), (902, "x" * 200_000), (903, "y"), (903, "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"features": F.lit(1), "_dense": F.lit(2), "label": F.lit("z")})
    labels = spark.createDataFrame([(i, 1 - i % 2) for i in range(400)] + [(1, 0), (None, 1), (3, None)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    assert "idiot" in model.lexicon
    scored = model.score(docs)
    assert scored.columns == [*docs.columns, "score"] and scored.count() == len(rows) and scored.where("score BETWEEN 0 AND 1").count() == len(rows)
    by = {r["doc_id"]: r["score"] for r in scored.collect()}
    assert by[0] > 0.5 > by[1]
    kept = toxicity.keep_civil(docs, model)
    assert kept.columns == docs.columns and not any(r["doc_id"] is not None and r["doc_id"] < 400 and r["doc_id"] % 2 == 0 for r in kept.collect())
    nothing = toxicity.fit(docs, labels.limit(0))
    assert nothing.score(docs).where("score <> 0").count() == 0
    assert model.score(docs.limit(0)).count() == 0


def brute_features(text, lexicon):
    """The dense features of a text, place by place."""
    low = text.lower()
    hits, second = [], []
    for i in range(len(low)):
        if (i and low[i - 1].isalpha()) or not low[i].isalpha():
            continue
        word = re.match(r"[^\W\d_]+", low[i:]).group()
        weights = [lexicon[word]] if word in lexicon else []
        weights += [lexicon[word[:n] + "*"] for n in range(1, len(word)) if word[:n] + "*" in lexicon]
        if weights:
            hits.append((i, max(weights)))
        if word in toxicity.SECOND:
            second.append(i)
    words, chars = sum(c in " \t\n\x0b\x0c\r" for c in text) + 1, max(len(text), 1)
    upper, lower = (len(re.findall(x, text)) for x in ("[A-Z]", "[a-z]"))
    signs, digits = len(re.findall(r"[!-/:-@\[-`{-~]", text)), len(re.findall("[0-9]", text))
    masked = re.findall(r"[^\W\d_]+(?:[*@$!0-9._-]+[^\W\d_]+)+", text)
    plain = ["".join({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"}.get(c, c) for c in x.lower()) for x in masked]
    cloaked = sum(x in lexicon or any(x[:n] + "*" in lexicon for n in (4, 5, 6)) for x in plain)
    near = sum(any(abs(i - j) <= 40 for j in second) for i, _ in hits)
    return [
        len(hits), 100 * len(hits) / words, len({low[i : i + 4] for i, _ in hits}), 100 * sum(w for _, w in hits) / words, max((w for _, w in hits), default=0),
        100 * len(second) / words, near, near / max(len(hits), 1), upper / max(upper + lower, 1), float(upper > lower), 100 * text.count("!") / words,
        signs / chars, digits / chars, 100 * len(masked) / words, cloaked, np.log1p(words),
    ]


def isotonic(points):
    """Pool adjacent violators: (chance, value) of sorted distinct chances."""
    blocks = []
    for x in sorted({x for x, _ in points}):
        ys = [y for c, y in points if c == x]
        blocks.append([sum(ys), len(ys), [x]])
        while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]:
            s, n, xs = blocks.pop()
            blocks[-1] = [blocks[-1][0] + s, blocks[-1][1] + n, blocks[-1][2] + xs]
    return [x for _, _, xs in blocks for x in xs], [s / n for s, n, xs in blocks for _ in xs]


def test_toxicity_matches_brute_force(spark):
    """Features place by place, and the calibration by pooling adjacent violators over the held quarter."""
    docs = spark.read.parquet(f"{DATA}/sf0.1/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{DATA}/sf0.1/labels.parquet").select("doc_id", "toxic")
    model = toxicity.fit(docs, labels)
    some = [r["text"] for r in docs.join(labels.where("toxic = 1"), "doc_id").limit(80).collect()] + [r["text"] for r in docs.limit(60).collect()]
    some += ["", "You IDIOT! 1d10t y0u", "a" * 3000, "x\u0301 You, I.d.i.o.t id-iot"]
    of = toxicity.Featurizer(model.lexicon)
    for text in some:
        assert of(text or "") == pytest.approx(brute_features(text or "", model.lexicon), abs=1e-9)
    known = labels.where("toxic IN (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy("toxic", F.xxhash64(F.col("doc_id").cast("string"), F.lit(1)), F.col("doc_id").cast("string")).collect()
    place, held, fitted = Counter(), set(), set()
    for r in known:
        place[r["toxic"]] += 1
        (held if place[r["toxic"]] % 4 == 1 else fitted).add(r["doc_id"])
    raw = toxicity.ToxicityModel(model.lexicon, model.trees, None).score(docs, score_col="chance").join(labels, "doc_id").collect()
    xs, ys = isotonic([(r["chance"], r["toxic"]) for r in raw if r["doc_id"] in held])
    assert len(held) + len(fitted) <= 12_000 and all(sum(r["toxic"] == v and r["doc_id"] in held for r in raw) for v in (0, 1))
    final = {r["doc_id"]: r["score"] for r in model.score(docs).collect()}
    for r in raw:
        assert final[r["doc_id"]] == pytest.approx(float(np.interp(r["chance"], xs, ys)), abs=1e-6)


def test_toxicity_of_few_labels(spark):
    docs = spark.createDataFrame([(i, f"plain words {i}") for i in range(20)] + [(20, "stupid idiot")], "doc_id long, text string")
    model = toxicity.fit(docs, docs.select("doc_id", (F.col("doc_id") == 20).cast("int").alias("toxic")))
    assert model.trees is not None and model.calibration is None
    assert model.score(docs).where("score BETWEEN 0 AND 1").count() == 21
    odd = toxicity.fit(docs, docs.select("doc_id", (F.col("doc_id") + 2).alias("toxic")))
    assert odd.trees is None


def test_obfuscation_is_a_feature():
    f = toxicity.Featurizer({"idiot": 3.0, "stup*": 2.0})
    at = toxicity.FEATURES.index
    got = f("You IDIOT, stupidity! 1d10t id1ot")
    assert got[at("hits")] == 2 and got[at("near_second")] >= 1 and got[at("disguised_hits")] == 1 and f("")[at("hits")] == 0
    assert f("idiots")[at("hits")] == 0 and f("stup")[at("hits")] == 0


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    ids = lambda d: {r["doc_id"] for r in d.select("doc_id").collect()}
    (_, toxic), (_, good), (_, once), (_, pack) = corpus_pipeline.STAGES
    a = toxic(spark, docs, SF).persist()
    rejected = {r["doc_id"] for r in queries.toxicity_model(spark, SF).score(docs).where("score >= 0.5").collect()}
    assert a.columns == docs.columns and ids(a) == ids(docs) - rejected and rejected
    b = good(spark, a, SF).persist()
    want, _ = brute_kept([(r["doc_id"], r["text"], r["source"]) for r in a.collect()])
    assert b.columns == docs.columns and ids(b) == want and len(want) < a.count()
    c = once(spark, b, SF).persist()
    assert c.columns == docs.columns and 0 < c.count() < b.count()
    from tests.llm.test_duplicates import brute_sets, closed

    rows = b.select("doc_id", "text").collect()
    sets = dict(zip((r["doc_id"] for r in rows), brute_sets([r["text"] for r in rows], 5)))
    want = closed(list(sets), lambda i, j: bool(sets[i]) and bool(sets[j]) and 0.8 <= len(sets[i]) / len(sets[j]) <= 1.25 and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]))
    assert ids(c) == {i for i, k in want.items() if i == k}
    d = pack(spark, c, SF)
    assert ids(d) == ids(c)
    spark.catalog.clearCache()
