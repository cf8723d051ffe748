from compare import oracle, rows
from pyspark.sql import functions as F

from pageloom.llm import chat as H

SCHEMA = "conv_id long, turn long, role string, text string"
CONVERSATIONS = [
    (1, 0, "user", "hi"), (1, 1, "assistant", "hello"), (1, 2, "user", "bye"), (1, 3, "assistant", "so long"),
    (2, 1, "assistant", "hello"), (2, 0, "user", "hi"), (2, 2, "user", "what?"), (2, 3, "assistant", None),
    (3, 0, "user", "hi"), (3, 1, "assistant", "hello"), (3, 2, "user", "bye"), (3, 3, "assistant", "so long"),
    (4, 0, None, "alone <|im_end|>"), (4, 0, None, "alone <|im_end|>"), (None, 0, "user", "hi"),
]


def test_same_as_sql(spark):
    sf = "/root/testdata/sf0.01"
    assert rows(H.op9_chat_formatting(spark, sf)) == oracle(H.OP9_SQL, sf)


def test_pairs(spark):
    df = spark.createDataFrame(CONVERSATIONS, SCHEMA).withColumn("prompt", F.lit("clash"))
    got = {r["chosen_id"]: r for r in H.preference_pairs(df).collect()}
    assert got.keys() == {1, 2, 3, 4}
    assert got[1]["rejected_id"] is None and got[1]["rejected"] is None and got[1]["n_prompt_turns"] == 3
    two = got[2]
    assert two["rejected_id"] == 1 and two["n_prompt_turns"] == 2
    assert two["prompt"] == "<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\nhello<|im_end|>\n"
    assert two["rejected"].endswith("assistant\nso long<|im_end|>\n")
    a, b = map(int, two["rejected_spans"].split(":"))
    assert two["rejected"][a:b] == "so long<|im_end|>"
    assert (got[3]["n_prompt_turns"], got[3]["chosen"], got[3]["rejected"]) == (4, "", "")
    assert got[4]["prompt"].count("<|im_end|>") == 2 and r"<\|im_end" in got[4]["prompt"]


def test_empty(spark):
    assert H.preference_pairs(spark.createDataFrame([], SCHEMA)).count() == 0


def test_long_conversations_and_turns_without_one(spark):
    rows = [(1, i, ("user", "assistant")[i % 2], f"turn {i}") for i in range(3000)] + [(2, i, ("user", "assistant")[i % 2], f"turn {i}" if i < 2999 else "x" * 500_000) for i in range(3000)]
    rows += [(None, i, "user", "lost") for i in range(2000)]
    got = {r["chosen_id"]: r for r in H.preference_pairs(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got.keys() == {1, 2} and got[2]["n_prompt_turns"] == 2999 and len(got[2]["chosen"]) > 500_000
    assert got[2]["rejected"].endswith("turn 2999<|im_end|>\n") and got[2]["prompt"].count("<|im_start|>") == 2999
