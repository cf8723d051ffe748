"""Library search: by keyword and by meaning, over a library of documents, and over a saved collection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pageloom.functions import text as T
from pageloom.operators import vectors as V

NAME_BOOST, SUMMARY_BOOST = 5, 2
MAX_RESULTS, MAX_PAGE_SNIPPETS, MAX_HIT_SNIPPETS = 50, 3, 2
MIN_QUERY, MAX_QUERY = 2, 512
PER_DOCUMENT, PER_MEMBER, MAX_MEMBERS = 3, 5, 20


def keyword_query(query: str) -> str | None:
    """The query as it is looked for, or None if it is too short or too long."""
    q = query.strip().lower()
    return q if MIN_QUERY <= len(q) and len(query) <= MAX_QUERY else None


def keyword_search(sessions: DataFrame, query: str, limit: int = MAX_RESULTS) -> DataFrame:
    """doc_hash, file_name, page_count, score, in_summary, snippets of the best documents, best first.

    sessions: doc_hash, file_name, page_texts, summaries (map of name to text), last_accessed. A page's matches count 1
    each, a summary with a match 2, a file name with one 5. Everything is worked out inside a document's row, so the
    only exchange is that of the best rows. Ties go to the latest access, then to the hash.
    """
    found = keyword_query(query)
    if found is None:
        found, sessions = "", sessions.limit(0)
    q = F.lit(found)
    pages = F.coalesce("page_texts", F.array().cast("array<string>"))
    # a page that has no match is passed over before anything is counted
    count = lambda p: T.let(F.lower(p), lambda low: F.when(F.contains(low, q), T.occurrences(low, q)).otherwise(F.lit(0).cast("long")))
    hits = F.transform(pages, lambda p, i: F.struct((i + 1).alias("page"), F.coalesce(count(p), F.lit(0).cast("long")).alias("n")))
    df = sessions.withColumn("_hits", F.filter(hits, lambda h: h["n"] > 0))
    df = df.withColumn("_sums", F.filter(F.map_values(F.coalesce("summaries", F.create_map().cast("map<string,string>"))), lambda s: F.contains(F.lower(s), q)))
    on_pages = F.aggregate("_hits", F.lit(0).cast("long"), lambda a, h: a + h["n"])
    name = F.when(F.contains(F.lower("file_name"), q), NAME_BOOST).otherwise(0)
    df = df.withColumn("score", on_pages + SUMMARY_BOOST * F.size("_sums") + name)
    # a test of the score before the cut would be pushed down and count everything twice
    df = df.orderBy(F.desc("score"), F.desc("last_accessed"), "doc_hash").limit(limit).where("score > 0")
    page_snippets = F.transform(F.slice("_hits", 1, MAX_PAGE_SNIPPETS), lambda h: F.struct(h["page"].alias("page"), T.keyword_snippet(F.get(pages, h["page"] - 1), q).alias("text")))
    summary = F.array(F.struct(F.lit(0).alias("page"), T.keyword_snippet(F.get("_sums", F.lit(0)), q).alias("text")))
    snippets = F.when(F.size("_hits") > 0, page_snippets).when(F.size("_sums") > 0, summary).otherwise(F.slice(page_snippets, 1, 0))
    return df.select("doc_hash", "file_name", F.size(F.coalesce("page_texts", F.array().cast("array<string>"))).alias("page_count"), "score", (F.size("_sums") > 0).alias("in_summary"), snippets.alias("snippets"))


def index_state(manifest: Column | None = None, model: str = "", dim: int = 0) -> Column:
    """What a document's entry (embed_model, embed_dim, chunk_count) says: none, other or same."""
    none = F.col("embed_model").isNull() | F.col("embed_dim").isNull() | (F.col("chunk_count") <= 0)
    same = (F.col("embed_model") == model) & (F.col("embed_dim") == dim)
    return F.when(F.coalesce(none, F.lit(True)), "none").when(same, "same").otherwise("other")


def corrupted(dim: Column, vector: Column) -> Column:
    """A stored vector that does not have its index's dimension, or values that are no numbers."""
    return (dim <= 0) | F.coalesce(F.size(vector) != dim, F.lit(True)) | ~V.valid(vector)


def semantic_search(manifest: DataFrame, chunks: DataFrame, query: list[float], model: str, limit: int = MAX_RESULTS, least: float = V.MIN_SCORE) -> DataFrame:
    """doc_hash, file_name, score, snippets of the best documents by their best chunk.

    manifest: doc_hash, file_name, embed_model, embed_dim, chunk_count, last_accessed; chunks: doc_hash, idx, text,
    page_start, embedding. Documents under another model or dimension are not looked into, nor are those whose index
    is damaged. Three chunks of a document are kept, two shown.
    """
    own = manifest.where(index_state(model=model, dim=len(query)) == "same")
    # a damaged vector takes its whole index out
    bad = chunks.where(corrupted(F.lit(len(query)), F.col("embedding"))).select("doc_hash").distinct()
    hits = V.scored(chunks, query).where((F.col("score") >= least) & ~F.isnan("score"))
    hits = hits.join(own, "doc_hash", "left_semi").join(bad, "doc_hash", "left_anti")
    hits = V.top_k(hits, ["doc_hash"], PER_DOCUMENT, [F.desc("score"), F.col("idx")])
    hit = F.struct((-F.col("score")).alias("order"), "idx", F.coalesce("page_start", F.lit(0)).alias("page"), T.semantic_snippet(F.col("text")).alias("text"))
    docs = hits.groupBy("doc_hash").agg(F.max("score").alias("score"), F.sort_array(F.collect_list(hit)).alias("_hits"))
    shown = F.transform(F.slice("_hits", 1, MAX_HIT_SNIPPETS), lambda h: F.struct(h["page"].alias("page"), h["text"].alias("text")))
    docs = docs.join(own.select("doc_hash", "file_name", "last_accessed"), "doc_hash")
    docs = docs.orderBy(F.desc("score"), F.desc("last_accessed"), "doc_hash").limit(limit)
    return docs.select("doc_hash", "file_name", "score", shown.alias("snippets"))


def search_outcome(manifest: DataFrame, chunks: DataFrame, model: str, dim: int) -> DataFrame:
    """How many documents could not be searched: excluded (other model or dimension), corrupted, and without index."""
    state = manifest.withColumn("_state", index_state(model=model, dim=dim))
    bad = chunks.where(corrupted(F.lit(dim), F.col("embedding"))).select("doc_hash").distinct().withColumn("_bad", F.lit(True))
    state = state.join(bad, "doc_hash", "left")
    count = lambda test: F.count_if(test).cast("long")
    return state.agg(
        count(F.col("_state") == "other").alias("excluded"),
        count((F.col("_state") == "same") & F.col("_bad").isNotNull()).alias("corrupted"),
        count(F.col("_state") == "none").alias("no_index"),
    )


# ---- collections


def resolve_members(members: DataFrame, manifest: DataFrame, tabs: DataFrame, active: dict) -> DataFrame:
    """pos, doc_hash, file_name, source, status of each member, first mention only.

    members: pos, doc_hash; tabs: doc_hash, file_name; active: doc_hash, model, dim (None without an index).
    """
    first = members.groupBy("doc_hash").agg(F.min("pos").alias("pos"))
    names = tabs.where("doc_hash is not null").groupBy("doc_hash").agg(F.max("file_name").alias("_tab"))
    entry = manifest.select("doc_hash", F.col("file_name").alias("_name"), "embed_model", "embed_dim", "chunk_count", F.lit(True).alias("_known"))
    df = first.join(names, "doc_hash", "left").join(entry, "doc_hash", "left")
    is_active = F.col("doc_hash") == active["doc_hash"]
    indexed = active["model"] is not None and active["dim"] is not None
    state = index_state(model=active["model"] or "", dim=active["dim"] or 0)
    status = (
        F.when(is_active, F.lit("ready" if indexed else "no-index"))
        .when(F.lit(not indexed), "no-index")
        .when(F.col("_known").isNull(), "missing")
        .when(state == "none", "no-index")
        .when(state == "same", "ready")
        .otherwise("model-mismatch")
    )
    return df.select("pos", "doc_hash", F.coalesce("_tab", "_name", "doc_hash").alias("file_name"), F.when(is_active, "memory").otherwise("session").alias("source"), status.alias("status"))


def searchable_members(resolved: DataFrame, active_hash: str, most: int = MAX_MEMBERS) -> DataFrame:
    """At most ``most`` ready members, the active one first."""
    ready = resolved.where("status = 'ready'")
    return ready.orderBy(F.desc(F.col("doc_hash") == active_hash), "pos").limit(most)


def merged(hits: DataFrame, k: int = 0) -> DataFrame:
    """All members' hits, best first, then by hash and idx; k of them, or all if k is not positive."""
    ordered = hits.orderBy(F.desc("score"), "doc_hash", "idx")
    return ordered.limit(k) if k > 0 else ordered


def collection_hits(members: DataFrame, chunks: DataFrame, query: list[float], k: int = PER_MEMBER, least: float = V.MIN_SCORE, active: str | None = None) -> DataFrame:
    """The k best chunks of each member searched: 20 at most, the active document first, then by pos (or hash, without
    one). That few members are sent to the chunks, which are not moved before the cut."""
    place = [F.desc(F.col("doc_hash").eqNullSafe(F.lit(active)))] + [F.col(c) for c in ("pos", "doc_hash") if c in members.columns]
    few = members.orderBy(*place).limit(MAX_MEMBERS).select("doc_hash", "file_name")
    hits = V.scored(chunks, query).where((F.col("score") >= least) & ~F.isnan("score"))
    hits = hits.join(F.broadcast(few), "doc_hash")
    return V.top_k(hits, ["doc_hash"], k, [F.desc("score"), F.col("idx")])


def member_segment() -> Column:
    """A hit's text under its source, [name p.N], [name] or [p.N]."""
    name, page = T.doc_label(F.col("file_name")), T.page_label(F.col("page_start"))
    inner = F.regexp_replace(page, r"^\[|\]$", "")
    label = F.when(name != "", F.concat(F.lit("["), name, F.when(inner != "", F.concat(F.lit(" "), inner)).otherwise(""), F.lit("]"))).otherwise(page)
    return T.labeled_segment(F.col("text"), label, F.col("body_offset"))
