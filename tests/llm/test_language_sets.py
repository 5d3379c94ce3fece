import numpy as np
import pytest

from rulewright.llm import langid

LETTERS = {"a": "abcde", "b": "vwxyz", "c": "klmno", "d": "fghij"}


def _word(rng, letters):
    return "".join(rng.choice(list(letters), 5))


def test_all_languages_of_a_text(spark):
    rng = np.random.default_rng(1)
    rows = [(i, " ".join(_word(rng, v) for _ in range(300)), k) for i, (k, v) in enumerate([*LETTERS.items()] * 5)]
    model = langid.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    mixed = [w for v in LETTERS.values() for w in (_word(rng, v) for _ in range(100))]
    two = [_word(rng, "abcde") for _ in range(70)] + [_word(rng, "vwxyz") for _ in range(30)]
    texts = [" ".join(mixed), " ".join(two), "12", _word(rng, "klmno")]
    best, score = langid.mixtures(texts[:1], model[1])
    assert score[0] == pytest.approx(0.25, abs=0.03)
    got = {r["doc_id"]: r for r in langid.identify(spark.createDataFrame([*enumerate(texts)], "doc_id long, text string"), model).collect()}
    assert {x["lang"]: pytest.approx(x["share"], abs=0.03) for x in got[0]["languages"]} == dict.fromkeys("abcd", 0.25)
    assert [x["lang"] for x in got[1]["languages"]] == ["a", "b"] and got[1]["languages"][1]["share"] == pytest.approx(0.3, abs=0.03)
    assert got[2]["languages"] == [] and got[2]["lang_pred"] == "und" and [x["lang"] for x in got[3]["languages"]] == ["c"]
    for r in got.values():
        assert not r["languages"] or (r["languages"][0]["share"] == r["score"] and sum(x["share"] for x in r["languages"]) == pytest.approx(1, abs=1e-4))
