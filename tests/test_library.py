import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pageloom import settings
from pageloom.functions import prompts as P
from pageloom.operators import flow, qa, search, store
from pageloom.operators import summary as S
from pageloom.operators import vectors as V
from pageloom.plans import library_queries  # noqa: F401  (registers itself)
from pageloom.plans.registry import QUERIES
from pageloom.sources import export


def test_collections_of_all_documents(spark):
    want, docs = {}, spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "source").collect()
    for k, source in docs:
        day = f"{k % 28 + 1:02}"
        new = k % 3 != 1
        want.setdefault(k // 100, {})[str(k)] = (f"2024-0{1 + new}-{day}", f"new {source}" if new else f"set {source}")
    for lib, own in want.items():
        for i in sorted(own, key=lambda i: (own[i][0], i)):
            if len(own) > 50 and i != str(lib * 100 + 1):
                del own[i]
    got = {r["id"]: r["name"].strip() for r in QUERIES["s28_collections"](spark, "/root/testdata/sf0.001").collect()}
    assert got == {i: name for own in want.values() for i, (_, name) in own.items()} and len(docs) > 90


def session(spark, pages, name="doc.pdf", summaries=None):
    row = ("h", name, pages, summaries or {}, "2024")
    return spark.createDataFrame([row], "doc_hash string, file_name string, page_texts array<string>, summaries map<string,string>, last_accessed string")


@pytest.mark.parametrize(
    ("pages", "name", "summaries", "query", "score", "snippet_pages"),
    [
        (["key", "key key", "none"], "a.pdf", {}, "key", 3, [1, 2]),
        (["x"], "lecture.pdf", {}, "lecture", 5, []),
        (["x"], "a.pdf", {"full": "has key"}, "key", 2, [0]),
        (["key"], "a.pdf", {"full": "key"}, "KEY", 3, [1]),
        (["key"] * 6, "a.pdf", {}, "key", 6, [1, 2, 3]),
        (["key"], "a.pdf", {}, "k", None, None),
        (["key"], "a.pdf", {}, "absent", None, None),
        ([None, "key"], "a.pdf", {}, "key", 1, [2]),
    ],
)
def test_keyword_search(spark, pages, name, summaries, query, score, snippet_pages):
    got = search.keyword_search(session(spark, pages, name, summaries), query).collect()
    if score is None:
        assert got == []
    else:
        assert got[0]["score"] == score and [s["page"] for s in got[0]["snippets"]] == snippet_pages


def vectors(spark, *vs):
    return spark.createDataFrame([(i, list(map(float, v))) for i, v in enumerate(vs)], "idx int, embedding array<float>")


def test_best_scores_work_through_queries_in_blocks(spark):
    queries = vectors(spark, (1, 0), (0, 1), (-1, 0), (0.6, 0.8), (0.5, 0))
    got = {r["idx"]: round(r["max_score"], 5) for r in V.best_scores(queries, vectors(spark, (1, 0), (0, 0.5)), "idx", block=2).collect()}
    assert got == {0: 1.0, 1: 0.5, 2: 0.0, 3: 0.6, 4: 0.5}
    assert V.best_scores(queries.limit(0), queries, "idx").count() == 0


def test_best_scores_embed_each_chunk_once(spark, tmp_path):
    log = str(tmp_path / "embedded")

    class Noted(V.HashingEmbedder):
        def embed(self, texts):
            with open(log, "a") as f:
                f.write("".join(t + "\n" for t in texts))
            return super().embed(texts)

    chunks = V.embedded(spark.createDataFrame([(f"chunk {i}",) for i in range(20)], "text string"), Noted())
    queries = V.embedded(spark.createDataFrame([(i, f"chunk {i}") for i in range(9)], "idx int, text string"), V.HashingEmbedder())
    got = {r["idx"]: r["max_score"] for r in V.best_scores(queries, chunks, "idx", block=2).collect()}
    assert len(got) == 9 and all(abs(x - 1) < 1e-6 for x in got.values())
    with open(log) as f:
        assert sorted(f.read().split("\n")[:-1]) == sorted(f"chunk {i}" for i in range(20))


@pytest.mark.parametrize("kind", ["float", "double"])
@pytest.mark.parametrize("block", [7, 1000])
def test_best_scores_are_exact(spark, kind, block):
    rng = np.random.default_rng(5)
    unit = lambda n: [v / np.linalg.norm(v) for v in rng.integers(-2, 3, (n, 16)) + rng.choice([0.0, 1e-7], (n, 16)) + 0.01]
    some, many = unit(30), unit(1500)
    # copies, and vectors that single precision cannot tell apart
    many += [q * (1 - k * 1e-8) for q in some[:10] for k in range(3)] + many[:50]
    frame = lambda vs: spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(vs)], f"idx int, embedding array<{kind}>")
    queries, chunks = frame(some + some[:5]), frame(many + [[1.0] * 8]).union(frame([[]]).withColumn("embedding", F.lit(None).cast(f"array<{kind}>")))
    pairs = queries.crossJoin(chunks.where("size(embedding) = 16").select(F.col("embedding").alias("c")))
    want = {r["idx"]: r["x"] for r in pairs.groupBy("idx").agg(F.max(V.dot(F.col("embedding"), F.col("c"))).alias("x")).collect()}
    got = {r["idx"]: r["max_score"] for r in V.best_scores(queries, chunks, "idx", block).collect()}
    assert len(want) == 35 and got == want
    assert V.best_scores(queries, frame([[1.0] * 8]), "idx", block).count() == 0
    big = V.best_scores(queries, frame([[1e30] * 16]), "idx", block).collect()
    assert {r["max_score"] for r in big} <= {0.0, 1.0}


def test_vector_search(spark):
    df = vectors(spark, [1, 0, 0], [0.7, 0.7, 0], [0, 1, 0]).withColumn("embedding", V.normalized(F.col("embedding")))
    got = V.search(df, [1.0, 0.0, 0.0], 5, 0.0).collect()
    assert [r["idx"] for r in got] == [0, 1, 2] and math.isclose(got[0]["score"], 1, abs_tol=1e-5)
    assert V.search(df, [1.0, 0.0]).collect() == []
    assert V.search(vectors(spark, [0, 0, 0]).withColumn("embedding", V.normalized(F.col("embedding"))), [1.0, 0.0, 0.0]).collect() == []
    assert V.one_dimension(vectors(spark, [1, 0, 0], [0, 1, 0])).count() == 2
    with pytest.raises(Exception, match="dimensions"):
        V.one_dimension(vectors(spark, [1, 0, 0], [1, 0])).collect()


def test_members_searched_are_the_active_one_and_the_first(spark):
    members = spark.createDataFrame([(29 - i, f"d{i:02}", "f") for i in range(30)], "pos long, doc_hash string, file_name string")
    chunks = spark.createDataFrame([(f"d{i:02}", 0, [1.0, 0.0]) for i in range(30)], "doc_hash string, idx long, embedding array<float>")
    got = {r["doc_hash"] for r in search.collection_hits(members, chunks, [1.0, 0.0], active="d03").collect()}
    assert got == {"d03", *(f"d{i:02}" for i in range(11, 30))}


def test_summary_names_given_twice(spark):
    sessions = spark.createDataFrame([("a", {"full": "old", "x": "kept"}), ("b", None)], "doc_hash string, summaries map<string,string>")
    news = spark.createDataFrame([("a", "full", "one", 1), ("a", "full", "two", 2), ("c", "full", "none", 1), ("b", None, "x", 1)], "doc_hash string, name string, content string, saved_at int")
    got = {r["doc_hash"]: r["summaries"] for r in store.merge_summaries(sessions, news).collect()}
    assert got == {"a": {"full": "two", "x": "kept"}, "b": {}}


def test_eviction_of_a_whole_table_against_loop(spark):
    rng = random.Random(8)
    entries = [(f"h{i}", f"2026-01-0{rng.randrange(1, 9)}T{rng.randrange(24):02}:{rng.randrange(60):02}", rng.randrange(1, 90), rng.random() < 0.2) for i in range(200)]
    count, size, want = len(entries), sum(e[2] for e in entries), set()
    for h, _, n, pinned in sorted(entries, key=lambda e: (e[1], e[0])):
        if not pinned and (count > 60 or size > 2000):
            want.add(h)
            count, size = count - 1, size - n
    df = spark.createDataFrame(entries, "doc_hash string, last_accessed string, byte_size long, pinned boolean")
    got = store.evicted(df, most=60, most_bytes=2000)
    assert {r["doc_hash"] for r in got.collect()} == want and got.columns == df.columns


def test_eviction_against_loop(spark):
    rng = random.Random(3)
    rows, want = [], set()
    for lib in range(30):
        entries = [(lib, f"h{lib}-{i}", f"{rng.random():.6f}", rng.randrange(1, 90), rng.random() < 0.2) for i in range(rng.randrange(0, 12))]
        rows += entries
        count, size = len(entries), sum(e[3] for e in entries)
        for e in sorted(entries, key=lambda e: (e[2], e[1])):
            if count <= 4 and size <= 200:
                break
            if not e[4]:
                want.add(e[1])
                count, size = count - 1, size - e[3]
    df = spark.createDataFrame(rows, "lib int, doc_hash string, last_accessed string, byte_size long, pinned boolean")
    assert {r["doc_hash"] for r in store.evicted(df, ["lib"], 4, 200).collect()} == want


def test_budget_skips(spark):
    df = spark.createDataFrame([([5, 9, 3, 4],)], "x array<int>").select(qa.within_budget(F.col("x"), lambda v: v, 12).alias("k"))
    assert df.first()["k"] == [5, 3, 4]


def test_embedding_boundary(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "id int, text string")
    got = V.embedded(docs, V.HashingEmbedder(16)).collect()
    assert [len(r["embedding"]) for r in got] == [16, 16]


def test_collection_members(spark):
    members = spark.createDataFrame([(0, "b"), (1, "b"), (2, "a")], "pos int, doc_hash string")
    manifest = spark.createDataFrame([("a", "A", "m", 3, 1)], "doc_hash string, file_name string, embed_model string, embed_dim int, chunk_count int")
    tabs = spark.createDataFrame([("b", "tab")], "doc_hash string, file_name string")
    got = search.resolve_members(members, manifest, tabs, {"doc_hash": "b", "model": "m", "dim": 3}).orderBy("pos").collect()
    assert [(r["doc_hash"], r["file_name"], r["status"]) for r in got] == [("b", "tab", "ready"), ("a", "A", "ready")]
    none = search.resolve_members(members, manifest, tabs, {"doc_hash": "b", "model": None, "dim": None}).collect()
    assert {r["status"] for r in none} == {"no-index"}


def test_documents_take_sections_then_headings_then_first_lines(spark):
    kind = "k long, units array<string>, sections array<struct<title:string,unit:int>>, headings array<struct<level:int,title:string,unit:int>>, images array<struct<unit:int>>"
    units = ["a", "b", "c"]
    rows = [
        (1, units, [("S", 1), ("T", 2), ("T", 3)], [(1, "H", 0)], [(9,), (-1,)]),
        (2, units, [("only", 0)], [(1, "x", 0), (2, "H", 1), (2, " ", 1), (2, "I", 7)], []),
        (3, units, None, [(1, "x", 0)], None),
        (4, [], None, [], []),
        (5, ["제1장 가", "b", "제2장 나"], None, None, None),
    ]
    got = {r["k"]: r for r in flow.documents(spark.createDataFrame(rows, kind), "k").collect()}
    chapters = {k: [(c["title"], c["start_page"], c["end_page"]) for c in r["chapters"]] for k, r in got.items()}
    assert chapters == {1: [("S", 1, 2), ("T", 3, 3)], 2: [("H", 1, 2), ("I", 3, 3)], 3: [("Pages 1-3", 1, 3)], 4: [], 5: [("제1장 가", 1, 2), ("제2장 나", 3, 3)]}
    assert [i["unit"] for i in got[1]["images"]] == [2, 0] and got[1]["chapters"][0]["text"] == "a\n\nb" and got[4]["page_count"] == 0


def test_ask_falls_back_verifies_and_refines(spark):
    class Loud:
        """A generator that answers drafts and rewrites differently; local, so that workers get it by value."""

        def generate(self, prompts):
            return ["Better answer [p.1]" if "[초안 답변]" in p else "A claim that nothing in the text supports at all. Another claim without any support here." for p in prompts]

    embedder = V.HashingEmbedder()
    docs = [("a", "a.pdf", ["alpha beta gamma delta"], "alpha beta gamma delta", None), ("b", "b.pdf", ["no index here"], "no index here", "sum")]
    sessions = spark.createDataFrame(docs, "doc_hash string, file_name string, page_texts array<string>, text string, summary string")
    chunks = V.embedded(spark.createDataFrame([("a", 0, "alpha beta gamma delta", 1, 0)], "doc_hash string, idx int, text string, page_start int, body_offset int"), embedder)
    got = {r["doc_hash"]: r for r in flow.ask(sessions, chunks, "alpha beta gamma", embedder, Loud()).collect()}
    assert (got["a"]["basis"], got["b"]["basis"]) == ("index", "keywords")
    assert got["a"]["refined"] and got["a"]["answer"] == "Better answer [p.1]" and not got["a"]["degraded"]
    # without an index of its own there is nothing to verify against
    assert not got["b"]["refined"] and got["b"]["answer"].startswith("A claim")
    # nothing to verify against: the draft stays
    got = flow.ask(sessions, chunks.limit(0), "alpha beta", embedder, Loud()).collect()
    assert len(got) == 2 and all(r["answer"].startswith("A claim") and not r["refined"] for r in got)
    assert flow.ask(sessions, chunks, "  ", embedder, Loud()).count() == 0
    members = spark.createDataFrame([(0, "a", "a.pdf")], "pos long, doc_hash string, file_name string")
    got = flow.ask(sessions, chunks, "alpha beta gamma", embedder, Loud(), members=members).collect()
    assert {r["basis"] for r in got} == {"collection"} and all(r["answer"] == "Better answer " for r in got)
    got = flow.ask(sessions, chunks.limit(0), "alpha", embedder, Loud(), members=members).collect()
    assert all(r["degraded"] and r["basis"] == "keywords" for r in got)


def test_verification_fails_open(spark):
    embedder = V.HashingEmbedder()
    answers = spark.createDataFrame([(1, "One sentence that is long enough."), (2, "short"), (3, None)], "k long, answer string")
    chunks = V.embedded(spark.createDataFrame([("One sentence that is long enough.",)], "text string"), embedder)
    got = {r["k"]: r for r in flow.verified(answers, chunks, embedder, "k").collect()}
    assert (got[1]["total"], got[1]["needs_refine"]) == (1, False) and got[1]["avg_score"] > 0.99 and (got[2]["total"], got[2]["avg_score"]) == (0, 1.0)
    other = V.embedded(spark.createDataFrame([("x",)], "text string"), V.HashingEmbedder(8))
    assert all(r["avg_score"] == 1.0 and not r["needs_refine"] for r in flow.verified(answers, other, embedder, "k").collect())


def test_settings():
    assert settings.accepted("maxChunkSize", 999) == (False, None) and settings.accepted("maxChunkSize", 1500.5) == (False, None) and settings.accepted("maxChunkSize", 16000)[0]
    assert not settings.accepted("ollamaBaseUrl", "http://example.org")[0] and settings.accepted("persistSessions", False) == (True, False)
    given = [{"id": "a", "name": "n" * 99, "prompt": "p", "strategy": "x"}, {"id": "", "name": "n", "prompt": "p"}, None, {"id": "b", "name": " ", "prompt": "p"}]
    assert settings.accepted("customSummaryTemplates", given * 30)[1] == [{"id": "a", "name": "n" * 60, "prompt": "p", "strategy": "single"}] * 20


def test_export(spark, tmp_path):
    df = spark.createDataFrame([("k1", "T <1>", "# Head\ntext **b** `c` <x>\n\n- one\n- *two*\n\n1. a\n\n> q\n\n---", "en"), ("k2", None, None, "xyz")], "k string, title string, summary string, language string")
    export.export(df, "k", str(tmp_path / "html"), "html")
    got = {r["k"]: r["value"] for r in spark.read.text(str(tmp_path / "html"), wholetext=True).collect()}
    for part in ('lang="en"', "<title>T &lt;1&gt;</title>", "<h1>Head</h1>", "<p>text <strong>b</strong> <code>c</code> &lt;x&gt;</p>", "<ul><li>one</li><li><em>two</em></li></ul>", "<ol><li>a</li></ol>", "<blockquote>q</blockquote>", "<hr>"):
        assert part in got["k1"], part
    assert 'lang="ko"' in got["k2"]
    export.export(df, "k", str(tmp_path / "md"))
    assert spark.read.text(str(tmp_path / "md"), wholetext=True).where("k = 'k1'").first()["value"].startswith("# Head\ntext")


def test_inline_summaries_and_korean_prompts(spark):
    class Echo:
        def generate(self, prompts):
            return ["" if p.endswith("silent") else "made " + p[-5:] + " [p.1]\n" for p in prompts]

    rows = [(1, 0, "a.pdf", "stored [p.3]", None, "x"), (1, 1, "b.pdf", None, ["", "paged"], "other"), (1, 2, "c.pdf", None, None, "plain"), (1, 3, "d.pdf", None, None, "silent"), (1, 4, "e.pdf", None, None, None), (1, 5, "f.pdf", None, [" "], "y" * 6001)]
    rows += [(1, 6 + i, f"{i}.pdf", None, None, f"late{i}") for i in range(6)]
    members = spark.createDataFrame(rows, "collection_id int, pos long, file_name string, summary string, page_texts array<string>, text string")
    df = S.inline_summaries(members, Echo())
    got = {r["pos"]: (r["summary"], r["unlabelled"], r["saved"]) for r in df.collect()}
    assert got[0] == ("stored [p.3]", False, None) and got[1] == ("made paged [p.1]\n", False, "made paged [p.1]\n")
    assert got[2] == ("made plain [p.1]\n", True, "made plain [p.1]\n") and got[3] == (None, False, None) and got[4] == (None, False, None)
    assert got[5][2] == "made yyyyy [p.1]\n\n" + S.INPUT_CUT["ko"] and got[9][0] is not None and got[10] == (None, False, None) and len(got) == 12
    blocks = {r["pos"]: r for r in S.collection_blocks(df).collect()}
    assert [p for p in blocks if not blocks[p]["page_citable"]] == [2, 3, 5, 6, 7, 8, 9] and blocks[3]["content"] == "silent"
    prompt = S.collection_prompt(S.collection_blocks(df), comparison=True, language="ko").collect()[0]["prompt"]
    assert prompt.startswith(S.COMPARISON_KO + "\n\n## a.pdf\nstored [a.pdf p.3]\n\n## b.pdf\n") and S.NO_PAGES_KO.replace("{name}", "c.pdf") in prompt


def test_prompt_of_each_kind(spark):
    kinds = [("full", "en", None), ("keywords", "ja", None), ("qa", "xx", None), ("custom", "zh", " mine\n"), ("custom", "zh", " "), ("other", "en", None), (None, None, None)]
    df = spark.createDataFrame(kinds, "kind string, lang string, own string")
    got = [r["p"] for r in df.select(P.build_prompt(F.lit("text ---\n\n more"), F.col("kind"), F.col("lang"), F.col("own")).alias("p")).collect()]
    tail = "\n\n---\n\ntext ---\n\n more"
    assert got[0] == P.TEMPLATES["en", "full"] + "\n\n" + P.CITATION_RULES["en"] + tail and got[1] == P.TEMPLATES["ja", "keywords"] + tail
    assert got[2] == P.TEMPLATES["ko", "qa"] + "\n\n" + P.CITATION_RULES["ko"] + tail and got[3] == "mine\n\n" + P.CITATION_RULES["zh"] + tail
    assert got[4:] == [None, None, None]
    both = spark.createDataFrame([(got[0],)], "p string").select(qa.split_prompt(F.col("p")).alias("s")).collect()[0]["s"]
    assert both["user"] == "text ---\n\n more" and both["system"] == got[0][: -len(tail)]
