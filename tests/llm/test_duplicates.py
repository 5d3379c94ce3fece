import random
import re

import numpy as np
import pytest

from rulewright.llm import components, embeddings, minhash, queries, shingles

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_sets(texts, k):
    out = []
    for t in texts:
        w = re.findall("[^\x20\x09-\x0d]+", (t or "").translate(LOWER))
        out.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    return out


def closed(ids, linked):
    """Smallest id reachable, by search."""
    near = {i: {j for j in ids if linked(i, j)} for i in ids}
    out = {}
    for i in sorted(ids):
        if i not in out:
            todo = [i]
            while todo:
                x = todo.pop()
                if x not in out:
                    out[x] = i
                    todo += near[x]
    return out


def corpus(seed, n=160):
    """Bases with edited copies of many grades, and chains of ever more edits."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    texts = []
    while len(texts) < n:
        base = [word() for _ in range(rng.randint(20, 120))]
        for _ in range(rng.randint(1, 12)):
            copy = list(base)
            for _ in range(rng.randint(0, 5)):
                copy[rng.randrange(len(copy))] = word()
            texts.append(" ".join(copy))
            if rng.random() < 0.4:
                base = copy
    return [*texts, None, "", " \n", "one", "ONE", "one two", "Two one", texts[0], texts[0].upper().replace(" ", "\n\t"), "x" * 100_000, "É é"]


@pytest.mark.parametrize("k, percent", [(3, 85), (5, 80)])
def test_components_are_exact(spark, k, percent):
    texts = corpus(k)
    df = spark.createDataFrame([(i * 3, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, id string")
    sets = dict(zip(range(0, 3 * len(texts), 3), brute_sets(texts, k)))
    want = closed(list(sets), lambda i, j: bool(sets[i]) and bool(sets[j]) and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]))
    got = {r["doc_id"]: r for r in minhash.near_duplicates(df, k, percent).collect()}
    assert {i: r["component_id"] for i, r in got.items()} == want
    assert all(got[i]["n_shingles"] == len(s) for i, s in sets.items())


def test_op5_is_brute_force(spark, tmp_path):
    texts = corpus(8, 120)
    spark.createDataFrame([(i, t, "en", 1) for i, t in enumerate(texts)], "doc_id long, text string, lang string, id int").write.parquet(str(tmp_path / "documents.parquet"))
    sets = dict(enumerate(brute_sets(texts, 3)))
    parts = closed(list(sets), lambda i, j: bool(sets[i]) and bool(sets[j]) and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]))
    got = queries.op5_minhash_near_dedup(spark, str(tmp_path)).select("doc_id", "n_shingles", "component_id", "kept").collect()
    assert sorted(map(tuple, got)) == [(i, len(s), parts[i], parts[i] == i) for i, s in sets.items()]


def test_blocks_of_one_bucket_find_every_link(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 5)
    monkeypatch.setattr(minhash, "FEW", 2)
    texts = corpus(11, 120)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = dict(enumerate(brute_sets(texts, 3)))
    want = closed(list(sets), lambda i, j: bool(sets[i]) and bool(sets[j]) and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]))
    assert {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(df, 3, 85).collect()} == want


def test_one_of_each_group_stays(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(4, text, 1), (2, text, 2), (7, text + " more", 3), (9, "alone and short", 4), (9, "alone and short", 5), (9, "zzz", 6), (None, text, 7), (None, None, 8), (5, None, 9), (6, None, 10)]
    df = spark.createDataFrame(rows, "doc_id long, text string, component_id int")
    kept = minhash.keep_one(df)
    assert kept.columns == df.columns
    assert sorted((r["doc_id"] or -1, r["component_id"]) for r in kept.collect()) in ([(-1, 7), (-1, 8), (2, 2), (5, 9), (6, 10), (9, 4)], [(-1, 7), (-1, 8), (2, 2), (5, 9), (6, 10), (9, 5)])
    assert minhash.keep_one(df.limit(0)).count() == 0


def test_shingle_hashes_match_brute_force():
    texts = [t or "" for t in corpus(4, 40)]
    for k in (1, 3, 5):
        assert [len(s) for s in shingles.shingle_sets([t.encode() for t in texts], k)] == [len(s) for s in brute_sets(texts, k)]
    a, b = shingles.shingle_sets([b"a b c", b"A  B\tC"], 3)
    assert a.tolist() == b.tolist()


def thue_morse(letters):
    """A word and its complement, which collide under polynomial hashes modulo a power of two."""
    bits = [bin(i).count("1") % 2 for i in range(letters)]
    return tuple("".join("ab"[b ^ flip] for b in bits) for flip in (0, 1))


def test_words_that_break_polynomial_hashes(spark):
    pairs = [" ".join(w) for w in zip(thue_morse(1024), thue_morse(4096), thue_morse(2048))]
    long = [" ".join([w] * 3 + [f"{i}" for i in range(9)]) for w in thue_morse(1024)]
    texts = [*pairs, *long]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = brute_sets(texts, 3)
    want = closed(list(range(4)), lambda i, j: 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]))
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(df, 3, 85).collect()}
    assert got == want and len(set(got.values())) == 4


def test_ids_with_several_texts(spark):
    """Rows with one id are one document with the links of all its texts, whichever row is read first."""
    texts = corpus(21, 60)[:60]
    rows = [(i, t) for i, t in enumerate(texts)] + [(i + 5, texts[i]) for i in range(0, 50, 7)] + [(3, texts[3])] * 40 + [(59, None)]
    sets: dict = {}
    for i, t in rows:
        sets.setdefault(i, []).append(brute_sets([t], 3)[0])
    link = lambda a, b: bool(a) and bool(b) and 100 * len(a & b) >= 85 * len(a | b)
    want = closed(list(sets), lambda i, j: any(link(a, b) for a in sets[i] for b in sets[j]))
    for order in (rows, rows[::-1]):
        df = spark.createDataFrame(order, "doc_id long, text string").repartition(3)
        got = minhash.near_duplicates(df, 3, 85).collect()
        assert len(got) == len(rows) and {r["doc_id"]: r["component_id"] for r in got} == want


def test_temporary_tables_go(spark):
    import os

    from rulewright.llm.shared import new_path

    folder = os.path.dirname(new_path(spark, "x"))
    before = set(os.listdir(folder))
    df = spark.createDataFrame(list(enumerate(corpus(2, 40))), "doc_id long, text string")
    found = minhash.near_duplicates(df)
    assert len(set(os.listdir(folder)) - before) == 1 and found.count() == df.count()


def test_bands_meet_the_miss_rate():
    for t in (0.8, 0.85):
        b = minhash.band_count(t)
        assert (1 - t**minhash.ROWS) ** b <= 1e-9


def test_star_components(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(1, 60)] + [(100, 100 + i) for i in range(1, 50)] + [(rng.randrange(300, 400), rng.randrange(300, 400)) for _ in range(60)] + [(7, 7), (2, 1), (2, 1)]
    nodes = {x for e in edges for x in e if e[0] != e[1]}
    want = closed(list(nodes), lambda a, b: (a, b) in pairs)if (pairs := {p for a, b in edges for p in ((a, b), (b, a))}) else {}
    got = {r["node"]: r["component"] for r in components.connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == want
    assert components.connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_vectors(spark):
    rng = np.random.default_rng(1)
    rows, vid = [], 0
    for size in (1, 1, 5, 30, 2):
        base = rng.standard_normal(16)
        for _ in range(size):
            rows.append((vid * 2, (base + 0.08 * rng.standard_normal(16)).tolist()))
            vid += 1
    base = rows[-1][1]
    rows += [(1001, base), (1003, [2 * x for x in base]), (1005, [1e-200 * x for x in base]), (1007, [-x for x in base])]
    good = dict(rows)
    odd = [(2001, None), (2003, []), (2005, [0.0] * 16), (2007, [float("nan")] + base[1:]), (2009, [float("inf")] + base[1:]), (2011, [None, *base[1:]]), (2013, base[:8]), (None, base)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>").selectExpr("*", "1 AS class", "2 AS id")
    e = {i: np.array(v) / np.abs(v).max() for i, v in good.items()}
    cos = lambda i, j: float(e[i] @ e[j] / np.sqrt((e[i] @ e[i]) * (e[j] @ e[j])))
    links = {i: [j for j in e if j != i and cos(i, j) >= 0.9] for i in e}
    want = closed(list(e), lambda i, j: j in links[i])
    got = {r["vec_id"]: r for r in embeddings.near_duplicate_vectors(df).collect()}
    assert len(got) == len(rows) + len(odd)
    missing = sum(got[i]["n_links"] != len(links[i]) for i in e)
    assert missing == 0 and {i: got[i]["component_id"] for i in e} == want
    assert all(got[i]["n_links"] == 0 and got[i]["component_id"] == i for i, _ in odd if i != 2013 and i is not None) and got[None]["component_id"] is None
    assert embeddings.near_duplicate_vectors(df.limit(0)).count() == 0


def test_dense_clusters_and_repeated_ids(spark, monkeypatch):
    """Counts and components of clusters larger than a block, of pairs close to the threshold, and of ids with several vectors."""
    monkeypatch.setattr(embeddings, "BLOCK", 40)
    rng = np.random.default_rng(4)
    rows = []
    for size, spread in ((150, 0.05), (90, 0.24), (30, 0.3)):
        base = rng.standard_normal(24)
        rows += [(len(rows) + i, (base + spread * rng.standard_normal(24)).tolist()) for i in range(size)]
    rows += [(7, rows[200][1]), (7, rows[7][1]), (300, rows[3][1]), (12, [0.0] * 24)]
    x = np.array([v for _, v in rows[:-1]])
    x /= np.linalg.norm(x, axis=1)[:, None]
    near = (x @ x.T >= 0.9) & ~np.eye(len(x), dtype=bool)
    of_id: dict = {}
    for k, (i, _) in enumerate(rows[:-1]):
        of_id.setdefault(i, []).append(k)
    want = closed(list(of_id), lambda i, j: near[np.ix_(of_id[i], of_id[j])].any())
    got = embeddings.near_duplicate_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    expected = sorted([(i, int(near[k].sum()), want[i]) for k, (i, _) in enumerate(rows[:-1])] + [(12, 0, want[12])])
    found = sorted(map(tuple, got))
    assert [r[::2] for r in found] == [r[::2] for r in expected]
    links = sum(r[1] for r in expected)
    assert links - 0.01 * links <= sum(r[1] for r in found) <= links and all(a[1] <= b[1] for a, b in zip(found, expected))


def test_op10_is_brute_force(spark, tmp_path):
    rng, rows = np.random.default_rng(9), []
    for size in (1, 12, 5, 1, 30):
        base = rng.standard_normal(32)
        rows += [(3 * (len(rows) + i), (base + 0.1 * rng.standard_normal(32)).tolist(), i) for i in range(size)]
    rows.append((1, rows[2][1], 0))
    spark.createDataFrame([*rows, (2, None, 0)], "vec_id long, embedding array<double>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    x = {i: np.array(v) / np.linalg.norm(v) for i, v, _ in rows}
    links = {i: {j for j in x if j != i and x[i] @ x[j] >= 0.9} for i in x}
    parts = closed(list(x), lambda i, j: j in links[i])
    got = queries.op10_embedding_near_dedup(spark, str(tmp_path)).select("vec_id", "n_links", "component_id", "kept").collect()
    assert sorted(map(tuple, got)) == sorted([(i, len(links[i]), parts[i], parts[i] == i) for i in x] + [(2, 0, 2, True)])


def test_forest_connects():
    rng = np.random.default_rng(5)
    u, v = rng.integers(0, 60, 70), rng.integers(60, 120, 70)
    a, b = embeddings.forest(u, v)
    nodes = sorted({*u.tolist(), *v.tolist()})
    reach = lambda x, y: closed(nodes, lambda i, j: (i, j) in pairs) if (pairs := {p for i, j in zip(x.tolist(), y.tolist()) for p in ((i, j), (j, i))}) else {}
    assert reach(u, v) == reach(a, b) and len(a) < len(nodes)


def test_recall_at_the_threshold(spark):
    """Pairs a little above the threshold are missed no more often than stated."""
    rng = np.random.default_rng(2)
    rows = []
    for i in range(300):
        a = rng.standard_normal(64)
        a /= np.linalg.norm(a)
        b = rng.standard_normal(64)
        b -= (a @ b) * a
        b /= np.linalg.norm(b)
        c = 0.905
        rows += [(2 * i, a.tolist()), (2 * i + 1, (c * a + np.sqrt(1 - c * c) * b).tolist())]
    got = embeddings.near_duplicate_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    assert got.where("n_links > 0").count() >= 2 * 300 * 0.97
