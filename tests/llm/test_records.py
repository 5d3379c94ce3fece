import hashlib
import json

import duckdb
import pyarrow as pa
import pytest
import zstandard
from pyspark.sql import functions as F

from rulewright.llm import chat, queries, warc
from tests.conftest import DATA
from tests.test_queries import norm

SF = f"{DATA}/sf0.01"


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_same_as_sql(spark, name):
    duck = duckdb.connect()
    for t in ("documents", "pages", "conversations", "benchmark", "embeddings"):
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    found = duck.execute(queries.ORACLE_SQL[name])
    at = [d[0] for d in found.description]
    assert sorted(at) == columns
    assert sorted(tuple(map(norm, r)) for r in df.select(columns).collect()) == sorted(tuple(norm(r[at.index(c)]) for c in columns) for r in found.fetchall())


LAYOUTS = [
    ({"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": None}]}, "messages", [("user", "q"), ("assistant", "")]),
    ({"id": 7, "conversations": [{"from": "human", "value": "a"}, {"from": "gpt", "value": "b"}], "system": "s"}, "from_value", [("system", "s"), ("user", "a"), ("assistant", "b")]),
    ({"instruction": "do", "input": "this", "output": "done"}, "instruction", [("user", "do\n\nthis"), ("assistant", "done")]),
    ({"instruction": "do", "input": "", "output": "done"}, "instruction", [("user", "do"), ("assistant", "done")]),
    ({"prompt": "p", "completion": "c"}, "prompt_completion", [("user", "p"), ("assistant", "c")]),
    ({"prompt": "p", "response": "c"}, "prompt_response", [("user", "p"), ("assistant", "c")]),
    ({"context": "x", "question": "y", "answer": "z"}, "question_answer", [("user", "x\n\ny"), ("assistant", "z")]),
    ({"conv_id": 1, "turn": 0, "role": "bot", "text": "t"}, "turn_rows", [("bot", "t")]),
    ({"messages": []}, None, None),
    ({"other": {"deep": [1, 2]}}, None, None),
]


def test_layouts(spark):
    df = spark.createDataFrame([(i, json.dumps(r), "x") for i, (r, _, _) in enumerate(LAYOUTS)] + [(99, None, "y")], "k int, j string, _fingerprint string").withColumn("record", F.parse_json("j"))
    got = {r["k"]: r for r in chat.canonical_turns(df, "record").select("k", "layout", "turns").collect()}
    for i, (_, layout, turns) in enumerate(LAYOUTS):
        assert got[i]["layout"] == layout
        assert (None if got[i]["turns"] is None else [tuple(t) for t in got[i]["turns"]]) == turns
    assert got[99]["layout"] is None


def test_field_paths(spark):
    df = spark.createDataFrame([('{"b": {"c": [ {"d": 1, "e": [true]} ]}, "a": 1.5}',)], "j string")
    assert df.select(chat.field_paths(F.parse_json("j"))).first()[0] == "a,b.c[].d,b.c[].e[]"


def test_texts_come_back(spark):
    nasty = ["", "<|im_end|>", "<|im_start|>user\n", r"<\|im_end|>", r"<\\|x", "a\nb<|", "<<||", "é漢😀<|im_end|><|im_start|>assistant ok", "\\", "x" * 20000]
    rows = [(c, i, role, t) for c in range(2) for i, (role, t) in enumerate((["user", "assistant", "odd\nrole<|%0A"][k % 3], t) for k, t in enumerate(nasty))]
    df = spark.createDataFrame([(c, i, [(r, t)]) for c, i, r, t in rows], "c int, i int, turns array<struct<role:string,text:string>>")
    for got in chat.read_chats(chat.format_chats(df, "c", "i")).collect():
        want = [(r, t) for c, _, r, t in rows if c == got["c"]]
        assert [tuple(t) for t in got["turns"]] == want
        assert got["loss_texts"] == [t for r, t in want if r == "assistant"]
        assert all("<|" not in got["formatted"][m["start"] : m["start"] + m["length"]] for m in got["mask"])
    assert chat.format_chats(df.limit(0), "c", "i").count() == 0


def test_ties_nulls_and_repeats(spark):
    turns = "c int, i int, turns array<struct<role:string,text:string>>"
    df = spark.createDataFrame([(1, 0, [("user", "b")]), (1, 0, [("user", "a")]), (1, 0, [("user", "a")]), (None, None, [("user", "n")]), (None, None, [("user", "m")]), (2, 0, None)], turns)
    got = sorted(((r["c"] or 0, [t["text"] for t in r["turns"]]) for r in chat.read_chats(chat.format_chats(df, "c", "i")).collect()))
    assert got == [(0, ["m"]), (0, ["n"]), (1, ["a", "a", "b"])]  # records without a key don't merge


def test_archives(spark):
    long = "p" * 200
    rows = [(5, "http://x/5", long), (2, "http://x/2", long), (9, None, long), (1, "u", "short"), (3, "u", "short"), (4, "bad\r\nurl", None), (None, "n", long), (7, "u", "é" * 50), (8, "u", "é" * 50), (2, "http://x/2", long), (10, "r", "WARC/1.1\r\n\r\n" * 9)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("clash"))
    index = warc.write_bundles(warc.with_references(pages))
    got = warc.read_bundles(index, with_payload=True).collect()
    assert len(got) == len(rows)
    by = {r["page_id"]: r for r in got}
    assert {k: (r["record_type"], r["refers_to"]) for k, r in by.items()} == {5: ("revisit", 2), 2: ("response", None), 9: ("revisit", 2), 1: ("response", None), 3: ("response", None), 4: ("response", None), None: ("response", None), 7: ("response", None), 8: ("revisit", 7), 10: ("response", None)}
    for page, _, html in rows:
        data = (html or "").encode()
        assert (by[page]["payload_bytes"], by[page]["payload_digest"]) == (len(data), hashlib.sha256(data).hexdigest())
        if by[page]["record_type"] == "response":
            assert bytes(by[page]["payload"]) == data
    place = index.where("record LIKE '<urn:page:10:%'").first()
    head, payload = warc.read_record(place["path"], place["frame"], place["offset"], place["length"])
    assert payload.decode() == rows[-1][2] and head["WARC-Type"] == "response"
    assert warc.read_bundles(warc.write_bundles(warc.with_references(pages.limit(0)))).count() == 0


def test_bundles_have_independent_frames_and_a_seek_table(tmp_path):
    path = tmp_path / "b.warc.zst"
    with pa.OSFile(str(path), "wb") as f:
        w = warc.BundleWriter(f)
        records = [warc.record_bytes(i, "u", bytes([65 + i % 26]) * 300_000, "d" * 64, None) for i in range(12)]
        places = [w.add(r) for r in records]
        w.close()
    data = path.read_bytes()
    assert b"".join(zstandard.ZstdDecompressor().stream_reader(data, read_across_frames=True).read(-1) for _ in "x") == b"".join(records)
    with pa.OSFile(str(path), "rb") as f:
        bundle = warc.BundleReader(f)
        assert len(bundle.frames) == 3
        for r, (frame, at, n) in zip(records, places):
            assert bundle.frame(frame)[at : at + n] == r
