import pytest
from pyspark.sql import functions as F

from pageloom.functions import text as T
from pageloom.operators import chunk as C
from pageloom.operators import layout as L
from pageloom.operators import summary as S


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"t {kind}").select(f(F.col("t")).alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("text [p.12] tail", [("text", None), ("citation", 12), ("text", None)]),
        ("[p. 12]", [("citation", 12)]),
        ("[P.5]", [("citation", 5)]),
        ("", []),
        ("[p.abc]", [("text", None)]),
        ("[p.0]", [("text", None)]),
        ("[p.1][p.2]", [("citation", 1), ("citation", 2)]),
    ],
)
def test_citations(spark, text, want):
    assert [(s["type"], s["page"]) for s in one(spark, text, T.parse_citations)] == want


def test_named_citation(spark):
    (s,) = one(spark, "[Beta.pdf p.5 | q]", T.parse_citations)
    assert (s["doc_name"], s["page"], s["raw"]) == ("Beta.pdf", 5, "[Beta.pdf p.5 | q]")


@pytest.mark.parametrize(("q", "want"), [("What is the main idea?", ["main", "idea"]), ("the a an is", []), ("AI", ["ai"]), ("A B C", []), ("계약의 해지 조건은?", ["계약의", "해지", "조건은"])])
def test_keywords(spark, q, want):
    assert one(spark, q, T.keywords) == want


def test_sanitize(spark):
    assert one(spark, "prefix\n---\nsuffix", T.sanitize_prompt) == "prefix\n\\-\\-\\-\nsuffix"
    assert one(spark, "a --- b", T.sanitize_prompt) == "a --- b"


def test_sentences(spark):
    text = "This is a first sentence. [p.3] Short. 이것은 충분히 긴 한국어 문장입니다。다음 문장도 충분히 긴 문장입니다. And so it ends here!"
    assert one(spark, text, T.sentences) == ["This is a first sentence.", "이것은 충분히 긴 한국어 문장입니다。", "다음 문장도 충분히 긴 문장입니다.", "And so it ends here!"]
    assert one(spark, "[p.1] [p.2]", T.sentences) == []


def test_placement(spark):
    assert one(spark, "Fact.\n- [p.3]\nNext ([p.4])", T.normalize_placement) == "Fact[p.3].\nNext [p.4]"
    assert one(spark, "[p.1]\nText", T.normalize_placement) == "[p.1]\nText"


def test_qualify(spark):
    got = one(spark, "a [p.2] b [Other p.3]", lambda c: T.qualify_citations(c, F.lit("My $1 [x].pdf")))
    assert got == "a [My $1 x .pdf p.2] b [Other p.3]"


def test_snippet(spark):
    got = one(spark, "X" * 200 + "keyword" + "Y" * 200, lambda c: T.keyword_snippet(c, F.lit("keyword")))
    assert got[0] == got[-1] == "…" and len(got) < 150


def test_label_paragraphs(spark):
    assert one(spark, ["one\n\ntwo", " ", "three"], T.label_paragraphs, "array<string>") == "[p.1] one\n\n[p.1] two\n\n[p.3] three"
    assert one(spark, ["", None], T.label_paragraphs, "array<string>") == ""
    long = one(spark, ["a" * 1000 + "\n" + "b" * 1000 + "\n" + "c" * 2000], T.label_paragraphs, "array<string>")
    assert [len(p) - len("[p.1] ") for p in long.split("\n\n")] == [1000, 1000, 1500, 500]


def test_page_range(spark):
    r = one(spark, ["p1", "p2", "p3", "p4", "p5"], lambda c: T.page_range(c, F.lit(4), F.lit(2)), "array<string>")
    assert (r["pages"], r["text"], r["start"], r["end"]) == (["", "p2", "p3", "p4", ""], "p2\n\np3\n\np4", 2, 4)


@pytest.mark.parametrize(
    ("blocks", "most", "units", "of"),
    [
        ([("a", True), ("b", True), ("c", True)], 100, ["a", "b", "c"], [0, 1, 2]),
        ([("x" * 60, False)] * 3, 100, ["x" * 60] * 3, [0, 1, 2]),
        ([("a", False), ("b", False), ("c", False)], 100, ["a\n\nb\n\nc"], [0, 0, 0]),
        ([("y" * 500, False)], 100, ["y" * 500], [0]),
        ([("a", False), (" ", False), (" ", True), ("b", False)], 100, ["a", "b"], [0, 0, 1, 1]),
        ([], 100, [], []),
    ],
)
def test_paginate(spark, blocks, most, units, of):
    r = one(spark, blocks, lambda c: C.paginate(c, most), "array<struct<text:string,break_before:boolean>>")
    assert (r["units"], r["unit_of_block"]) == (units, of)


@pytest.mark.parametrize(
    ("rows", "want"),
    [([["A", "B"]], "| A | B |\n| --- | --- |"), ([["a|b"], ["c\\d\ne", "x"]], "| a\\|b |  |\n| --- | --- |\n| c\\\\d e | x |"), ([], "")],
)
def test_grid(spark, rows, want):
    assert one(spark, rows, L.grid_markdown, "array<array<string>>") == want


def test_heading_tree(spark):
    texts = ["# 문서\n## 개요\n### 배경\n### 목표\n## 결론", "# **중요** 개요 [p.1]", "# a_b ~c~", "```\n# in an open fence\n# two", "~~~\n# no\n```\n~~~~\n# yes\n####### no", "", None]
    got = L.heading_trees(spark.createDataFrame(list(enumerate(texts)), "k long, md string"), "k", "md").orderBy("k", "id").collect()
    tree = lambda k: [r for r in got if r["k"] == k]
    assert [(r["title"], r["parent_id"]) for r in tree(0)] == [("문서", None), ("개요", 0), ("배경", 1), ("목표", 1), ("결론", 0)]
    assert (tree(1)[0]["title"], tree(1)[0]["page"]) == ("중요 개요", 1) and tree(2)[0]["title"] == "a_b ~c~"
    assert len(tree(3)) == 2 and [r["title"] for r in tree(4)] == ["yes"] and not tree(5) and not tree(6)


def test_math():
    assert L.math_normalized(r"a \(x+1\) b") == "a $$x+1$$ b"
    assert L.math_normalized(r"`\(x\)` \[p.3\] \(open") == r"`\(x\)` \[p.3\] \(open"
    assert L.math_normalized("```\n\\(x\\)\n```") == "```\n\\(x\\)\n```"
    assert len(L.math_normalized(r"\(" * 60_000)) == 120_000
    assert len(L.math_normalized(r"\[x" * 60_000 + r"\]$")) == 180_003
    assert L.math_normalized("\\[\na\n\\] \\(b\nc\\) \\\\(d\\) $\\(e\\)") == "$$\na\n$$ \\(b\nc\\) \\\\(d\\) $\\(e\\)"
    assert L.math_normalized(r"\[Beta.pdf p.5\] \(\) \( \) \[a $ b\]") == r"\[Beta.pdf p.5\] \(\) \( \) \[a $ b\]"


def test_folds_are_linear(spark):
    import time

    def seconds(n):
        lines = spark.createDataFrame([("\n\n".join(f"line {i} of many, some text" for i in range(n)),)], "t string").cache()
        lines.count()
        blocks = F.transform(F.split("t", "\n\n"), lambda x: F.struct(x.alias("text"), F.lit(False).alias("break_before")))
        began = time.perf_counter()
        lines.select(C.paginate(blocks).alias("p"), C.chunk_text(F.col("t"), 100).alias("c")).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - began

    seconds(1000)
    assert seconds(32_000) < 0.5 + 60 * max(0.05, min(seconds(1000), seconds(1000)))


def test_placement_of_lone_citations(spark):
    text = "[p.1]\nOne.\n- [p.2]\n\n[p.3] .\nTwo\n([p.4])\nThree! \n[p.5]"
    assert one(spark, text, T.normalize_placement) == "[p.1]\nOne[p.2][p.3].\n\nTwo[p.4]\nThree[p.5]! "


def test_chapters(spark):
    pages = ["intro", "제1장 시작\nx", "제1장 시작\n(repeated header)", "Chapter 2 ..... 9", "제2장 다음", "제1장 되돌아감"]
    df = spark.createDataFrame([(pages,)], "p array<string>").withColumn("s", C.chapter_starts(F.col("p")))
    got = df.select(C.detect_chapters(F.col("p"), F.col("s")).alias("c")).first()["c"]
    assert [(c["title"], c["start_page"], c["end_page"]) for c in got] == [("제1장 시작", 1, 4), ("제2장 다음", 5, 6)]


def test_shares(spark):
    assert one(spark, ["a" * 10, "b" * 100, "c" * 100], lambda c: S.fair_shares(c, 110), "array<string>") == [10, 50, 50]
    assert one(spark, ["a", "b"], lambda c: S.fair_shares(c, 10), "array<string>") == [1, 1]


def test_nulls(spark):
    for f in (T.keywords, T.sentences, T.parse_citations, T.normalize_placement, T.chars_per_token, T.token_estimate, T.strip_conversational, T.semantic_snippet):
        one(spark, None, f)
    assert one(spark, None, C.chunk_text) == []


def test_word_bounds_are_ascii(spark):
    from pageloom.functions import sanitize

    text = spark.createDataFrame([("étion tion_ tion. xtion 본tion",)], "t string")
    assert text.select(T.keyword_score(F.col("t"), F.array(F.lit("tion")))).first()[0] == 3
    key = "sk-" + "a1" * 12
    errors = spark.createDataFrame([(f"clé{key} x{key} 키{key}-é",)], "t string")
    assert errors.select(sanitize.error_body(F.col("t"))).first()[0] == f"clésk-[REDACTED] x{key} 키sk-[REDACTED]-é"
