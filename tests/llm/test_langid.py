import math
from collections import defaultdict

import numpy as np
from helpers import EDGES, SCHEMA, docs

from pageloom.llm import langid as G

SF = "/root/testdata/sf0.01"


def brute(texts):
    """Context trees as dicts, and the code length of a text by them."""
    tree = defaultdict(lambda: defaultdict(int))
    for t in texts:
        b = G.LEAD + t
        for i in range(3, len(b)):
            for n in range(4):
                tree[b[i - n : i]][b[i]] += 1

    def cost(context, x):
        seen = tree.get(context)
        if seen is None:
            return cost(context[1:], x)
        n, q = sum(seen.values()), len(seen)
        return -math.log2(seen[x] / (n + q)) if x in seen else -math.log2(q / (n + q)) + (cost(context[1:], x) if context else 8)

    return lambda t: sum(cost((G.LEAD + t)[i : i + 3], (G.LEAD + t)[i + 3]) for i in range(len(t)))


def test_exact_code_lengths(spark):
    train = {"en": ["the cat sat on the mat", "a dog"], "fr": ["le chat est sur le tapis", "un chien é"]}
    rows = [(lang, t) for lang, ts in train.items() for t in ts]
    counted = spark.createDataFrame(rows, "lang string, text string").mapInArrow(G._count, "lang string, n int, gram long, times long")
    counts = counted.groupBy("lang", "n", "gram").sum("times").withColumnRenamed("sum(times)", "times").toPandas()
    coder = G.Coder(G.build(counts))
    texts = [b"", b"the chat", "zq é 日本 \0".encode(), b"t", b"le cat sat " * 50]
    want = [[brute([t.encode() for t in train[lang]])(t) for lang in ("en", "fr")] for t in texts]
    assert np.allclose(coder.lengths(texts), want)
    window, G.WINDOW = G.WINDOW, 7  # windows of a few bytes must give the same
    try:
        assert np.allclose(coder.lengths(texts), want)
    finally:
        G.WINDOW = window


def test_held_out_accuracy(spark):
    got = G.op3_language_id(spark, SF).toPandas()
    lang = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").toPandas()
    both = got.merge(lang, on="doc_id")
    assert len(both) == len(lang) and both.score.between(0, 1).all()
    held = both[both.held_out]
    assert (held.lang == held.lang_pred).mean() > 0.98


def test_edges(spark):
    model = G.train(spark.createDataFrame([(i, "the cat and dog", "en", "s", 1) for i in range(20)] + [(50 + i, "le chat et", "fr", "s", 1) for i in range(20)], SCHEMA))
    got = G.identify(docs(spark, EDGES, "lang_pred2", "score2"), model, ["doc_id", "text"]).collect()
    assert len(got) == len(EDGES)
    und = {r["doc_id"] for r in got if r["lang_pred"] == "und"}
    assert und == {1, 2, 3} and all(r["score"] == 0 for r in got if r["lang_pred"] == "und")


def test_nothing_to_learn_from(spark):
    none = docs(spark, EDGES).limit(0)
    model = G.train(none)
    assert model.languages == []
    assert G.identify(none, model, ["doc_id"]).count() == 0
    assert {r["lang_pred"] for r in G.identify(docs(spark, EDGES), model, ["doc_id"]).collect()} == {"und"}
