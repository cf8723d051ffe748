"""Questions and answers: context within a budget, history, verification, refinement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pageloom.functions import text as T
from pageloom.operators.chunk import chunk_text

CONTEXT_CHARS, HISTORY_CHARS, SUMMARY_CHARS = 8000, 4000, 3000
FALLBACK_CHUNKS = 3
WEAK, WEAK_COUNT, WEAK_SHARE, LEAST_AVERAGE = 0.5, 2, 0.2, 0.65
MAX_LIVE, MAX_STORED = 20, 1000


def within_budget(items: Column, size, budget: int) -> Column:
    """Items in order, each taken if it still fits: one that does not is left out, later ones may fit."""

    def step(acc: Column, x: Column) -> Column:
        fits = acc["used"] + size(x) <= budget
        return F.struct((acc["used"] + F.when(fits, size(x)).otherwise(0)).alias("used"), F.when(fits, F.array_append(acc["kept"], x)).otherwise(acc["kept"]).alias("kept"))

    start = F.struct(F.lit(0).alias("used"), F.slice(items, 1, 0).alias("kept"))
    return F.aggregate(items, start, step, lambda acc: acc["kept"])


def context(hits: DataFrame, by: list[str], segment: Column, budget: int = CONTEXT_CHARS, place: tuple[str, ...] = ("idx",)) -> DataFrame:
    """by, context, kept: the best hits' segments that fit, put back into reading order. A group's hits are few (top k)."""
    item = F.struct((-F.col("score")).alias("rank"), *place, segment.alias("segment"))
    df = hits.groupBy(*by).agg(F.sort_array(F.collect_list(item)).alias("_items"))
    df = df.withColumn("_kept", within_budget(F.col("_items"), lambda x: F.char_length(x["segment"]), budget))
    read = F.sort_array(F.transform("_kept", lambda x: F.struct(*[x[p].alias(p) for p in place], x["segment"].alias("segment"))))
    text = F.array_join(F.transform(read, lambda x: x["segment"]), "\n\n")
    return df.select(*by, text.alias("context"), F.size("_kept").cast("long").alias("kept"))


def dropped_documents(hits: DataFrame, kept: DataFrame) -> DataFrame:
    """How many documents had hits but none in the context."""
    a = hits.agg(F.count_distinct("doc_hash").alias("_a"))
    b = kept.agg(F.count_distinct("doc_hash").alias("_b"))
    both = a.select("_a", F.lit(None).cast("long").alias("_b")).union(b.select(F.lit(None).cast("long"), "_b"))
    return both.agg(F.greatest(F.max("_a") - F.max("_b"), F.lit(0)).alias("dropped"))


def keyword_context(docs: DataFrame, question: str, text: str = "text", budget: int = CONTEXT_CHARS) -> DataFrame:
    """docs with context, for use without an index: the chunks with most keywords that fit, in reading order.

    A text within the budget is its own context. Without keywords, or without a match, it is the first and last chunk;
    if no chunk with a match fits, it is the start of the best one. Everything happens inside a document's row.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    tokens = F.greatest(F.lit(100), F.round((budget // FALLBACK_CHUNKS) / T.chars_per_token(t))).cast("int")
    df = docs.withColumn("_words", T.keywords(F.lit(question)))
    df = df.withColumn("_chunks", F.when(F.char_length(t) > budget, chunk_text(t, tokens)).otherwise(F.array(t)))
    scored = F.transform("_chunks", lambda c, i: F.struct((-T.keyword_score(c, F.col("_words"))).alias("rank"), i.alias("idx"), c.alias("chunk")))
    df = df.withColumn("_scored", F.filter(F.array_sort(scored), lambda x: x["rank"] < 0))
    df = df.withColumn("_kept", within_budget(F.col("_scored"), lambda x: F.char_length(x["chunk"]), budget))
    cut = lambda c: T.strip_partial_citation(F.left(c, F.lit(budget)))
    ends = cut(F.concat_ws("\n\n", F.get("_chunks", F.lit(0)), F.element_at("_chunks", -1)))
    read = F.array_sort(F.transform("_kept", lambda x: F.struct(x["idx"].alias("idx"), x["chunk"].alias("chunk"))))
    chosen = F.array_join(F.transform(read, lambda x: x["chunk"]), "\n\n")
    context_ = (
        F.when(F.char_length(t) <= budget, t)
        .when(F.size("_chunks") <= 1, cut(t))
        .when(F.size("_scored") == 0, ends)
        .when(F.size("_kept") == 0, cut(F.get("_scored", F.lit(0))["chunk"]))
        .otherwise(chosen)
    )
    return df.withColumn("context", context_).drop("_words", "_chunks", "_scored", "_kept")


# ---- history


def answered(messages: DataFrame) -> DataFrame:
    """messages (conv_id, turn, role, text, meta) without cancelled answers and the questions they were for."""
    after = F.lead("meta").over(Window.partitionBy("conv_id").orderBy("turn"))
    df = messages.withColumn("_after", after)
    gone = (F.col("role") == "user") & F.coalesce(F.col("_after") == "cancelled", F.lit(False))
    return df.where(~gone & ~F.coalesce(F.col("meta") == "cancelled", F.lit(False))).drop("_after")


def history(messages: DataFrame, most: int = HISTORY_CHARS) -> DataFrame:
    """conv_id, history: the latest lines that fit into ``most`` characters, the latest always, in order."""
    line = F.concat(F.when(F.col("role") == "user", "Q: ").otherwise("A: "), T.sanitize_prompt(F.coalesce("text", F.lit(""))))
    latest = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    df = answered(messages).withColumn("_line", line)
    df = df.withColumns({"_used": F.sum(F.char_length("_line") + 1).over(latest.rowsBetween(Window.unboundedPreceding, 0)), "_n": F.row_number().over(latest)})
    df = df.where((F.col("_n") == 1) | (F.col("_used") <= most))
    lines = F.transform(F.sort_array(F.collect_list(F.struct("turn", "_line"))), lambda x: x["_line"])
    text = F.concat(F.lit("\n[이전 대화]\n"), F.array_join(lines, "\n"), F.lit("\n"))
    return df.groupBy("conv_id").agg(text.alias("history"))


def latest_pairs(messages: DataFrame, most: int = MAX_LIVE) -> DataFrame:
    """The latest messages of each conversation, ``most`` at most, an even number of older ones dropped."""
    w = Window.partitionBy("conv_id")
    df = messages.withColumns({"_i": F.row_number().over(w.orderBy("turn")), "_n": F.count("*").over(w)})
    over = F.greatest(F.col("_n") - most, F.lit(0))
    return df.where(F.col("_i") > over + over % 2).drop("_i", "_n")


# ---- verification


def verification(scores: DataFrame, by: list[str]) -> DataFrame:
    """by, total, avg_score, weak_count, needs_refine from each sentence's max_score (below 0 counts as 0)."""
    s = F.greatest(F.coalesce("max_score", F.lit(0.0)), F.lit(0.0))
    df = scores.groupBy(*by).agg(F.count("*").alias("total"), F.avg(s).alias("avg_score"), F.count_if(s < WEAK).alias("weak_count"))
    again = (F.col("weak_count") >= WEAK_COUNT) | (F.col("weak_count") / F.col("total") > WEAK_SHARE) | (F.col("avg_score") < LEAST_AVERAGE)
    return df.withColumn("needs_refine", again)


#: What a verification says that could not be made: the draft stays.
UNVERIFIED = {"total": 0, "avg_score": 1.0, "weak_count": 0, "needs_refine": False}


def refined(answer: Column, draft: Column) -> Column:
    """The second answer, or the draft if that is blank."""
    return F.when(T.blank(answer), draft).otherwise(answer)


# ---- prompts


def question_prompt(summary: Column, chunks: Column, past: Column, question: Column) -> Column:
    """Summary, passages, history and question, each under its mark; what is missing leaves no mark."""
    part = lambda mark, c: F.when(T.blank(c), F.lit("")).otherwise(F.concat(F.lit(f"[{mark}]\n"), c, F.lit("\n\n")))
    short = T.strip_partial_citation(F.left(summary, F.lit(SUMMARY_CHARS)))
    return F.concat(
        part("요약 내용", T.sanitize_prompt(short)),
        part("원문 관련 부분", T.sanitize_prompt(chunks)),
        F.coalesce(past, F.lit("")),
        F.lit("\n[질문]\n"),
        T.sanitize_prompt(question),
    )


def split_prompt(prompt: Column) -> Column:
    """Struct of system and user, split at the first separator line; without one all is user."""
    at = F.position(F.lit("---\n\n"), prompt)
    whole = F.struct(F.lit("").alias("system"), prompt.alias("user"))
    parts = F.struct(T.trim(F.substring(prompt, F.lit(1), at - 1)).alias("system"), T.trim(F.substring(prompt, at + 5, F.char_length(prompt))).alias("user"))
    return F.when(at > 0, parts).otherwise(whole)


def gate(question: Column, most: int = 1000) -> Column:
    return F.char_length(T.trim(question)).between(1, most)
