import random
import re

from compare import oracle, rows
from helpers import EDGES, docs, words

from pageloom.llm import quality as Q

SF = "/root/testdata/sf0.001"


def test_same_as_sql(spark):
    assert rows(Q.op1_quality_rules(spark, SF)) == oracle(Q.OP1_SQL, SF)


def repeats(text):
    w, seen, at = words(text), {}, set()
    for i in range(len(w) - 2):
        seen.setdefault(tuple(w[i : i + 3]), []).append(i)
    for places in seen.values():
        if len(places) > 1:
            at |= {i + k for i in places for k in range(3)}
    return len(at)


def test_edges_and_clashing_columns(spark):
    texts = [*EDGES, (20, "a b c a b c"), (21, "a b c d"), (22, "a a a a"), (23, "x y z\n\n x y z\n \nx y z")]
    got = Q.quality(docs(spark, texts, "n_words", "kept", "_x")).collect()
    assert len(got) == len(texts)
    want = sorted((repeats(t), len(words(t))) for _, t in texts)
    assert sorted((r["n_repeat_words"], r["n_words"]) for r in got) == want
    assert all(r["base_failed"] and not r["kept"] for r in got if r["doc_id"] in (1, 2, 3))
    assert {r["doc_id"]: r["n_dup_lines"] for r in got}[23] == 1


def test_empty_table_and_filter(spark):
    assert Q.quality(docs(spark, EDGES).limit(0)).count() == 0
    # a filter on the verdict must not paste the counts into itself
    plan = Q.quality(docs(spark, EDGES)).where("kept").select("doc_id")._jdf.queryExecution().toString()
    assert "Python" not in plan
    assert Q.quality(docs(spark, EDGES)).where("kept").select("doc_id").count() == 0


def test_rules_take_effect(spark):
    text = " ".join(f"the word{i} of line{i}" for i in range(60))
    df = docs(spark, [(1, text), (2, text.replace("word", "wo###rd")), (3, text.replace("the", "xx").replace(" of", " yy"))])
    assert [(r["doc_id"], r["kept"], r["failed_rules"]) for r in Q.quality(df).orderBy("doc_id").collect()] == [(1, True, []), (2, False, ["symbols"]), (3, False, ["stop words"])]


def test_lambdas_leave_the_row_alone(spark):
    # an array of the row that a lambda names is read anew, and a struct built anew, for each word: garbage by the word
    plan = Q.quality(docs(spark, EDGES))._jdf.queryExecution().optimizedPlan().toString()
    assert not re.search(r"#\d+L?\[", plan)
    assert "named_struct" not in plan


def test_repeats_and_stop_words_of_random_texts(spark):
    pick, some = random.Random(5), ["a", "b", "c", "THE", "Für", "FÜR", "MÁS", "más", "K", "İn", "nicht", "nichts"]
    texts = [(k, " ".join(pick.choices(some[: pick.randint(1, len(some))], k=pick.randint(0, 60)))) for k in range(200)]
    got = {r["doc_id"]: (r["n_repeat_words"], r["n_stop"]) for r in Q.quality(docs(spark, texts)).collect()}
    assert got == {k: (repeats(t), sum(w.lower() in Q.STOP_WORDS for w in words(t))) for k, t in texts}
    letters = set("".join(Q.STOP_WORDS))
    assert all(len(chr(c).encode()) == len(chr(c).lower().encode()) for c in range(0xD800) if chr(c).lower() in letters)
