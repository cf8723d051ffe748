import hashlib
from collections import Counter

import numpy as np
from helpers import EDGES, docs, edited, prose, rng, words
from pyspark.sql import functions as F

from pageloom.llm import fingerprints as P


def terms(text):
    w = words(text)
    return Counter(zip(w, w[1:], strict=False)) if len(w) > 1 else Counter(w)


def jaccard(x, y):
    keys = x.keys() | y.keys()
    return sum(min(x[k], y[k]) for k in keys) / max(1, sum(max(x[k], y[k]) for k in keys))


def test_likeness_is_generalised_jaccard(spark):
    r = rng(3)
    base = " ".join(r.choice("abcdef") for _ in range(400))  # pairs with weights of about ten
    rows = [(i, edited(r, base, share)) for i, share in enumerate((0, 0, 0.05, 0.1, 0.2, 0.3, 0.5))] + [(20, prose(r, 300)), (21, "other " * 40)]
    df = docs(spark, rows)
    drawn = {x["doc_id"]: np.array(x["signature"]) for x in P.signatures(df, "text", ["doc_id"], samples=96).collect()}
    for i, t in rows:
        assert abs((drawn[0] == drawn[i]).mean() - jaccard(terms(rows[0][1]), terms(t))) < 0.17
    assert (drawn[0] == drawn[1]).all()


def test_edits_edges_and_order(spark):
    rows = [*EDGES, *((100 + i, f"text number {i} " * i) for i in range(20))]
    kept, P.BUCKET_DOCS = P.BUCKET_DOCS, 3
    try:
        got = P.compare_edited(docs(spark, rows, "ord", "bucket", "fingerprint")).collect()
    finally:
        P.BUCKET_DOCS = kept
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got}
    order = sorted((i for i, _ in rows if i is not None and i > 9), reverse=True)
    text = dict(rows)
    for i, j in zip(order, [*order[1:], 9], strict=True):
        n, other = len(text[i] or ""), text[j] or ""
        want = (text[i] or "")[: n - n // 2] + other[: n // 2]
        assert by[i]["edited_sha256"] == hashlib.sha256(want.encode()).hexdigest() and by[i]["n_chars"] == n
    # after the last one, without an id, comes the first
    last, first = text[None], text[119]
    want = last[: len(last) - len(last) // 2] + first[: len(last) // 2]
    assert by[None]["edited_sha256"] == hashlib.sha256(want.encode()).hexdigest()
    same = [r for r in got if r["doc_id"] == 5]
    assert len(same) == 2 and same[0]["fingerprint"] == same[1]["fingerprint"]
    assert by[1]["fingerprint"] == by[2]["fingerprint"] == by[3]["fingerprint"] and by[1]["near_edited"] == 1.0
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in got)


def test_empty_and_alone(spark):
    assert P.compare_edited(docs(spark, EDGES).limit(0)).count() == 0
    (r,) = P.compare_edited(docs(spark, [(4, "abcd")])).collect()
    assert r["edited_sha256"] == hashlib.sha256(b"abab").hexdigest() and r["near_next"] == 1.0
    plan = P.compare_edited(docs(spark, [(4, "abcd")]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_enough_samples(spark):
    (r,) = P.compare_edited(docs(spark, [(4, "one row of a few words")])).collect()
    assert len(r["fingerprint"]) >= 8 * 32


def test_null_and_repeated_ids_are_split(spark):
    rows = [(None, f"text {i} of no id " * 3) for i in range(300)] + [(7, f"text {i} of seven " * 3) for i in range(300)] + [(100 + i, f"own {i}") for i in range(300)]
    kept, P.BUCKET_DOCS = P.BUCKET_DOCS, 16
    try:
        sizes = [r["count"] for r in P._bucketed(docs(spark, rows).select("doc_id", "text")).groupBy("bucket").count().collect()]
        got = P.compare_edited(docs(spark, rows)).collect()
    finally:
        P.BUCKET_DOCS = kept
    assert max(sizes) <= 64 and sum(sizes) == 900 + len(sizes) and len(got) == 900
    # by descending id, then digest: every text is the next of exactly one row
    order = [r["text"] for r in docs(spark, rows).withColumn("d", P.digest(F.col("text"))).orderBy(F.desc_nulls_last("doc_id"), F.desc("d")).collect()]
    want = sorted(hashlib.sha256((a[: len(a) - len(a) // 2] + b[: len(a) // 2]).encode()).hexdigest() for a, b in zip(order, [*order[1:], order[0]], strict=True))
    assert sorted(r["edited_sha256"] for r in got) == want


def test_likeness_of_the_query_rows_against_exact_similarity(spark):
    r = rng(17)
    rows = [(i, edited(r, prose(r, 120), 0.1)) for i in range(30)]
    got = {x["doc_id"]: x for x in P.compare_edited(docs(spark, rows)).collect()}
    text, error = dict(rows), []
    for i in range(30):
        other = text[(i - 1) % 30]
        n = len(text[i])
        error.append(got[i]["near_edited"] - jaccard(terms(text[i]), terms(text[i][: n - n // 2] + other[: n // 2])))
        error.append(got[i]["near_next"] - jaccard(terms(text[i]), terms(other)))
    # the standard error of 32 samples is 0.09 at most
    assert np.sqrt(np.mean(np.square(error))) < 0.09 and max(map(abs, error)) < 0.35
