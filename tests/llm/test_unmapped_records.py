import json

from pyspark.sql import functions as F

from rulewright.llm import chat


def test_each_conversation_keeps_a_row(spark):
    known, named, empty = {"prompt": "p", "completion": "c"}, {"messages": [{"role": "user", "content": "q", "name": "n"}]}, {"messages": []}
    rows = [(1, 0, known), (1, 1, named), (1, 2, empty), (2, 0, named), (2, 1, empty), (3, 0, known), (None, 0, empty)]
    df = spark.createDataFrame([(c, i, json.dumps(r)) for c, i, r in rows], "c int, i int, j string").withColumn("record", F.parse_json("j"))
    made = chat.format_chats(chat.canonical_turns(df, "record"), "c", "i")
    got = {r["c"]: r for r in made.collect()}
    assert {k: r["unmapped"] for k, r in got.items()} == {1: 2, 2: 2, 3: 0, None: 1}
    assert got[1]["formatted"] == got[3]["formatted"] and got[1]["mask"] == got[3]["mask"] and got[2]["formatted"] is None and got[2]["mask"] == []
    assert {r["c"]: [tuple(t) for t in r["turns"]] for r in chat.read_chats(made).collect()} == dict.fromkeys((1, 3), [("user", "p"), ("assistant", "c")])
