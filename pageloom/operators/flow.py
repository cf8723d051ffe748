"""Whole flows: from extracted files to documents, from a question to a verified answer, and where a citation leads."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageloom.functions import text as T
from pageloom.operators import chunk as C
from pageloom.operators import qa, search
from pageloom.operators import summary as S
from pageloom.operators import vectors as V

# ---- extracted files


def documents(extracted: DataFrame, key: str) -> DataFrame:
    """key, page_count, text, page_texts, chapters and images of extracted files.

    extracted: key, units (array of texts), sections (array of title, unit; may be null), headings (array of level,
    title, unit) and images (array of structs with unit). Two sections or more are the chapters, else the headings,
    thinned, else what first lines say. Chapters are array<struct<index, title, start_page, end_page, text>>, indexed
    from 0 where the file names them and from 1 where they are found. Images lie on a page that there is.
    """
    pages = F.coalesce(F.col("units"), F.array().cast("array<string>"))
    df = extracted.withColumn("page_texts", F.transform(pages, lambda p: F.coalesce(p, F.lit(""))))
    n = F.size("page_texts")
    on_page = lambda unit: F.greatest(F.least(unit, n - 1), F.lit(0))
    named = F.transform("sections", lambda s: F.struct(T.trim(s["title"]).alias("title"), on_page(s["unit"]).alias("unit")))
    bounds = F.when(F.size(F.coalesce("sections", F.slice("sections", 1, 0))) >= 2, C.bounds_of(named)).otherwise(C.thin_headings(F.col("headings"), n))
    df = df.withColumns({"_bounds": F.when(n > 0, bounds), "_starts": C.chapter_starts(F.col("page_texts"))})

    def chapter(b: Column, i: Column) -> Column:
        last = F.coalesce(F.get("_bounds", i + 1)["start"], n)
        return F.struct(i.alias("index"), b["title"].alias("title"), (b["start"] + 1).alias("start_page"), last.alias("end_page"))

    found = C.detect_chapters(F.col("page_texts"), F.col("_starts"))
    chapters = F.when(F.size("_bounds") > 0, F.transform("_bounds", chapter).cast(C.CHAPTER)).otherwise(found)
    df = df.withColumn("_chapters", chapters)
    images = F.transform("images", lambda x, i: x.withField("unit", on_page(x["unit"])).withField("image_index", i))
    return df.select(
        key,
        n.cast("long").alias("page_count"),
        F.array_join("page_texts", "\n\n").alias("text"),
        "page_texts",
        C.with_text(F.col("_chapters"), F.col("page_texts")).alias("chapters"),
        images.alias("images"),
    )


# ---- images


class Describer(Protocol):
    """The boundary to a service that looks at pictures: one text or None for each."""

    def describe(self, images: list[bytes]) -> list[str | None]: ...


# fixed value: how a picture's description stands in a page's text
IMAGE_NOTE = "[이미지 분석: {0}]"
BATCHES = {"ollama": 3, "gemini": 3}
BATCH = 8


def described(images: DataFrame, describer: Describer, provider: str = "ollama") -> DataFrame:
    """images (key, page, pos, data) with note, asked for in batches of what the provider takes; failures are left out.

    A document whose first picture (by pos) fails has no notes at all: the service cannot see.
    """
    size = BATCHES.get(provider, BATCH)
    kinds = ", ".join(f"{c} {images.schema[c].dataType.simpleString()}" for c in ("key", "page", "pos"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = batch.column(3).to_pylist()
            notes = [n for at in range(0, len(data), size) for n in describer.describe(data[at : at + size])]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(notes, pa.string())], names=["key", "page", "pos", "note"])

    made = images.select("key", "page", "pos", "data").mapInArrow(run, f"{kinds}, note string")
    sees = made.groupBy("key").agg(F.min_by(F.col("note").isNotNull(), "pos").alias("_sees")).where("_sees").select("key")
    return made.where("note <> ''").join(sees, "key", "left_semi")


def enriched_pages(pages: DataFrame, notes: DataFrame, by: list[str]) -> DataFrame:
    """pages (by, page, text) with the notes (by, page, pos, note) of each page's pictures behind its text."""
    line = lambda x: F.replace(F.lit("\n" + IMAGE_NOTE), F.lit("{0}"), x["note"])
    lines = notes.groupBy(*by, "page").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "note"))), line), "").alias("_notes"))
    df = pages.join(lines, [*by, "page"], "left")
    return df.withColumn("text", F.concat("text", F.coalesce("_notes", F.lit("")))).drop("_notes")


# ---- citations


def citation_targets(citations: DataFrame, tabs: DataFrame, by: str) -> DataFrame:
    """citations (by, doc_name, page) with tab_id, target_page and state.

    tabs: by, tab_id, file_name, page_count, active. A name is compared in the form a citation can carry. state: open,
    ambiguous if several tabs have the name, closed if none has, invalid if there is no such page. A citation without a
    name, or with that of the active document, is of the active document.
    """
    named = tabs.withColumn("_label", T.doc_label(F.col("file_name")))
    one = F.struct("tab_id", "page_count", "active")
    others = named.groupBy(by, "_label").agg(F.count("*").alias("_n"), F.max(one).alias("_tab"))
    active = named.where("active").groupBy(by).agg(F.max(one).alias("_own"), F.max("_label").alias("_own_label"))
    df = citations.join(others.withColumnRenamed("_label", "doc_name"), [by, "doc_name"], "left").join(active, by, "left")
    cross = F.col("doc_name").isNotNull() & ~F.col("doc_name").eqNullSafe(F.col("_own_label"))
    tab = F.when(cross, F.col("_tab")).otherwise(F.col("_own"))
    page = T.clamp_page(F.col("page"), tab["page_count"])
    state = F.when(F.col("_n") > 1, "ambiguous").when(cross & F.col("_n").isNull(), "closed").when(page.isNull(), "invalid").otherwise("open")
    good = state == "open"
    out = [F.when(good, tab["tab_id"]).alias("tab_id"), F.when(good, page).cast("long").alias("target_page"), state.alias("state")]
    return df.select(*citations.columns, *out)


# ---- questions


def verified(answers: DataFrame, chunks: DataFrame, embedder: V.Embedder, key: str, text: str = "answer", own: bool = False) -> DataFrame:
    """key, total, avg_score, weak_count, needs_refine of each answer's sentences over all chunks (embedding), or, if
    own is set, over the chunks with the answer's key, which meet it in one join.

    What cannot be verified is not refined: an answer without sentences, or one where no chunk has the embedder's
    dimension; its average is 1.
    """
    parts = answers.select(key, F.posexplode(T.sentences(F.col(text))).alias("_i", "sentence"))
    parts = parts.withColumn("_id", F.concat_ws(":", F.col(key).cast("string"), F.col("_i").cast("string")))
    sentences = V.embedded(parts, embedder, "sentence")
    if own:
        fitting = chunks.where(F.size("embedding") == embedder.dim)
        score = F.coalesce(F.max(V.dot(F.col("embedding"), F.col("_chunk"))), F.lit(0.0))
        scores = sentences.join(fitting.select(key, F.col("embedding").alias("_chunk")), key, "left").groupBy(key, "_id").agg(score.alias("max_score"))
        usable = fitting.select(key).distinct().withColumn("_usable", F.lit(True))
        df = answers.select(key).join(usable, key, "left").join(qa.verification(scores, [key]), key, "left")
    else:
        scores = parts.select(key, "_id").join(V.best_scores(sentences.select("_id", "embedding"), chunks, "_id"), "_id", "left")
        # either all sentences have a score or, if no chunk fits, none has
        scores = scores.withColumn("_usable", F.when(F.col("max_score").isNotNull(), True))
        df = answers.select(key).join(qa.verification(scores, [key, "_usable"]), key, "left")
    counted, good = F.coalesce("total", F.lit(0)).cast("long"), F.col("_usable").isNotNull() & F.col("total").isNotNull()
    unless = lambda c: F.when(good, F.col(c)).otherwise(F.lit(qa.UNVERIFIED[c])).alias(c)
    return df.select(key, counted.alias("total"), unless("avg_score"), unless("weak_count"), unless("needs_refine"))


# fixed value: what a second answer is asked for, with the rule on citations for one document and for a collection
REFINE = """

[질문]
{question}

[초안 답변]
{draft}

위 초안 답변 중 원문(컨텍스트) 에서 근거를 찾을 수 있는 내용만 남기고 다시 작성하세요.
규칙:
- 원문에 명시되지 않은 주장은 제거하거나 "문서에서 확인되지 않음" 으로 표시
- 문체와 구조(문단/목록 형식) 는 초안을 그대로 유지
{rule}
- 새 정보를 추가하지 말고 초안의 정확성만 개선"""
REFINE_RULES = ("- [p.N] 인용은 근거 페이지를 찾으면 그대로, 찾을 수 없으면 제거", "- [문서명 p.N] 인용은 **문서명을 반드시 포함한 채로** 유지, 근거를 찾을 수 없으면 제거")


def refine_prompt(context: Column, question: Column, draft: Column, collection: Column) -> Column:
    rule = F.when(collection, F.lit(REFINE_RULES[1])).otherwise(REFINE_RULES[0])
    out = F.replace(F.lit(REFINE), F.lit("{rule}"), rule)
    # the draft goes in last, so that marks in it stay as they are
    out = F.replace(out, F.lit("{question}"), T.sanitize_prompt(question))
    return F.concat(context, F.replace(out, F.lit("{draft}"), T.sanitize_prompt(draft)))


def passages(sessions: DataFrame, chunks: DataFrame, question: str, vector: list[float], members: DataFrame | None = None) -> DataFrame:
    """sessions with passages, basis (collection, index or keywords) and degraded.

    sessions: doc_hash, page_texts, text, file_name; chunks: doc_hash, idx, text, page_start, body_offset, embedding.
    A collection's hits come first, then those of the document's own index, then the paragraphs with the question's
    keywords. degraded: members were searched that had no hit in what was kept, or the whole collection had none.
    """
    hits = V.scored(chunks, vector).where((F.col("score") >= V.MIN_SCORE) & ~F.isnan("score"))
    own = V.top_k(hits, ["doc_hash"], V.TOP_K, [F.desc("score"), F.col("idx")])
    segment = T.labeled_segment(F.col("text"), T.page_label(F.col("page_start")), F.col("body_offset"))
    found = qa.context(own, ["doc_hash"], segment).select("doc_hash", F.col("context").alias("_own"))
    labelled = F.nullif(T.label_paragraphs(F.coalesce("page_texts", F.array().cast("array<string>"))), F.lit(""))
    df = sessions.withColumn("_source", F.coalesce(labelled, F.col("text"), F.lit("")))
    df = qa.keyword_context(df, question, "_source").withColumnRenamed("context", "_words").drop("_source")
    df = df.join(found, "doc_hash", "left")
    shared, degraded = F.lit(None).cast("string"), F.lit(False)
    if members is not None:
        best = search.collection_hits(members, chunks, vector)
        text = qa.context(best.withColumn("_all", F.lit(0)), ["_all"], search.member_segment(), place=("doc_hash", "idx"))
        one = text.select(F.col("context").alias("_shared")).unionByName(sessions.sparkSession.createDataFrame([(None,)], "_shared string")).agg(F.max("_shared").alias("_shared"))
        df = df.crossJoin(F.broadcast(one))  # a single row
        shared = F.nullif(F.col("_shared"), F.lit(""))
        degraded = shared.isNull()
    basis = F.when(shared.isNotNull(), "collection").when(F.col("_own").isNotNull(), "index").otherwise("keywords")
    df = df.withColumns({"passages": F.coalesce(shared, "_own", "_words"), "basis": basis, "degraded": degraded})
    return df.drop("_own", "_words", "_shared")


def ask(sessions: DataFrame, chunks: DataFrame, question: str, embedder: V.Embedder, generator: S.Generator, past: DataFrame | None = None, members: DataFrame | None = None, verify: bool = True) -> DataFrame:
    """doc_hash, basis, degraded, refined and answer to one question for every document of sessions.

    sessions: doc_hash, file_name, page_texts, text, summary; past: doc_hash, history. The draft is verified sentence by
    sentence and, if too much of it has no support, written again; a blank second answer leaves the draft. A question
    that is blank or too long has no answers.
    """
    asked = question.strip()
    df = sessions.where(qa.gate(F.lit(asked)))
    df = passages(df, chunks, asked, embedder.embed([asked])[0], members)
    df = df.join(past, "doc_hash", "left") if past is not None else df.withColumn("history", F.lit(None).cast("string"))
    df = df.withColumn("_prompt", qa.question_prompt(F.col("summary"), F.col("passages"), F.col("history"), F.lit(asked)))
    df = S.generated(df.select("doc_hash", "basis", "degraded", "_prompt"), generator, "_prompt").withColumnRenamed("output", "_draft")
    again = F.lit(False)
    if verify:
        df = df.join(verified(df.select("doc_hash", "_draft"), chunks if members is None else chunks.join(members.select("doc_hash").distinct(), "doc_hash", "left_semi"), embedder, "doc_hash", "_draft", own=members is None).select("doc_hash", "needs_refine"), "doc_hash")
        again = F.col("needs_refine") & ~T.blank(F.col("_draft"))
    context = F.substring_index("_prompt", "\n[질문]\n", 1)
    second = F.when(again, refine_prompt(context, F.lit(asked), F.col("_draft"), F.col("basis") == "collection"))
    df = df.withColumns({"refined": again, "_second": second})
    # the generator is only asked where there is something to write again
    first, more = df.where("not refined").withColumn("_answer", F.col("_draft")), S.generated(df.where("refined"), generator, "_second")
    more = more.withColumn("_answer", qa.refined(F.col("output"), F.col("_draft"))).drop("output")
    df = first.unionByName(more)
    named = F.when(F.col("basis") == "collection", T.strip_bare_citations(F.col("_answer"))).otherwise(F.col("_answer"))
    return df.select("doc_hash", "basis", "degraded", "refined", T.normalize_placement(named).alias("answer"))
