"""Queries of search, vectors, collections, questions and answers, and the store.

Documents stand for sessions, embeddings (by label) for indexed documents, conversations for histories.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from pageloom.functions import text as T
from pageloom.operators import chunk as C
from pageloom.operators import qa, search, store
from pageloom.operators import vectors as V
from pageloom.plans.document_queries import chunks_sql, cpt_sql
from pageloom.plans.registry import query, table



def doc_hash():
    return F.sha2(F.col("doc_id").cast("string"), 256)


HASH_SQL = "sha256(CAST(doc_id AS VARCHAR))"
DAY = "concat('2024-01-', lpad(cast(doc_id % 28 + 1 as string), 2, '0'))"
DAY_SQL = "concat('2024-01-', lpad(CAST(doc_id % 28 + 1 AS VARCHAR), 2, '0'))"


def sessions(spark, d):
    summaries = F.when(F.col("doc_id") % 4 == 0, F.create_map(F.lit("full"), F.left("text", F.lit(300)))).otherwise(F.create_map().cast("map<string,string>"))
    return table(spark, d, "documents").select(
        doc_hash().alias("doc_hash"),
        F.concat("source", F.lit("-"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("file_name"),
        F.split("text", "\n").alias("page_texts"),
        summaries.alias("summaries"),
        F.expr(DAY).alias("last_accessed"),
        "doc_id",
        F.col("n_chars").alias("byte_size"),
    )


_S = f"""s AS (SELECT doc_id, {HASH_SQL} AS doc_hash, concat(source, '-', CAST(doc_id AS VARCHAR), '.txt') AS file_name, text, string_split(text, chr(10)) AS p,
  CASE WHEN doc_id % 4 = 0 THEN left(text, 300) END AS sm, {DAY_SQL} AS last_accessed, n_chars AS byte_size FROM documents)"""
_SNIP = r"CASE WHEN b > 0 THEN '…' ELSE '' END || regexp_replace(regexp_replace(substring(t, b + 1, e - b), '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g') || CASE WHEN e < length(t) THEN '…' ELSE '' END"


def _keyword_sql(q: str) -> str:
    return f"""WITH {_S},
    h AS (SELECT *, list_filter(range(1, len(p) + 1), lambda i: contains(lower(p[i]), '{q}')) AS hit, contains(lower(coalesce(sm, '')), '{q}') AS ins FROM s),
    r AS (SELECT *, (length(lower(text)) - length(replace(lower(text), '{q}', ''))) // {len(q)} + CASE WHEN ins THEN 2 ELSE 0 END + CASE WHEN contains(lower(file_name), '{q}') THEN 5 ELSE 0 END AS score FROM h),
    t AS (SELECT * FROM r WHERE score > 0 ORDER BY score DESC, last_accessed DESC, doc_hash LIMIT 50),
    x AS (SELECT *, CASE WHEN len(hit) > 0 THEN p[hit[1]] ELSE sm END AS t FROM t),
    y AS (SELECT *, strpos(lower(t), '{q}') AS a FROM x),
    z AS (SELECT *, greatest(a - 1 - 50, 0) AS b, least(length(t), a - 1 + {len(q)} + 50) AS e FROM y)
    SELECT doc_hash, file_name, CAST(len(p) AS BIGINT) AS page_count, CAST(score AS BIGINT) AS score, ins AS in_summary,
           CAST(CASE WHEN len(hit) > 0 THEN least(len(hit), 3) WHEN ins THEN 1 ELSE 0 END AS BIGINT) AS n_snippets,
           CAST(CASE WHEN len(hit) > 0 THEN hit[1] WHEN ins THEN 0 END AS BIGINT) AS first_page,
           CASE WHEN len(hit) > 0 OR ins THEN {_SNIP} END AS first_snippet FROM z"""


def _keyword(spark, d, q):
    df = search.keyword_search(sessions(spark, d), q)
    first = F.get("snippets", F.lit(0))
    return df.select("doc_hash", "file_name", F.col("page_count").cast("long").alias("page_count"), "score", "in_summary", F.size("snippets").cast("long").alias("n_snippets"), first["page"].cast("long").alias("first_page"), first["text"].alias("first_snippet"))


@query("c11_keyword_search", _keyword_sql("ther"))
def c11(spark, d):
    return _keyword(spark, d, " Ther ")


@query("a1_file_name_search", _keyword_sql("src1"))
def a1(spark, d):
    return _keyword(spark, d, "src1")


@query("a2_summary_search", _keyword_sql("tion"))
def a2(spark, d):
    return _keyword(spark, d, "tion")


# ---- vectors


def first_vector(spark, d) -> list[float]:
    return table(spark, d, "embeddings").where("vec_id = 0").select("embedding").first()[0]


def chunks(spark, d):
    return table(spark, d, "embeddings").select(
        F.concat(F.lit("L"), F.col("label").cast("string")).alias("doc_hash"),
        F.col("vec_id").alias("idx"),
        F.concat(F.lit("chunk "), F.col("vec_id").cast("string"), F.repeat(F.lit(" word"), (F.col("vec_id") % 90).cast("int"))).alias("text"),
        (F.col("vec_id") % 5 + 1).cast("int").alias("page_start"),
        (F.col("vec_id") % 4).cast("int").alias("body_offset"),
        "embedding",
        "label",
    )


def manifest(spark, d):
    df = chunks(spark, d).groupBy("doc_hash", "label").agg(F.count("*").alias("chunk_count"), F.sum("idx").alias("byte_size"))
    model = F.when(F.col("label") % 4 == 3, "old").when(F.col("label") % 5 == 4, F.lit(None)).otherwise("new")
    return df.select("doc_hash", F.concat(F.lit("doc "), "doc_hash").alias("file_name"), model.alias("embed_model"), F.lit(64).alias("embed_dim"), "chunk_count", F.concat(F.lit("2024-01-1"), F.col("label").cast("string")).alias("last_accessed"), "byte_size")


_V = """q AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 0),
 c AS (SELECT 'L' || label AS doc_hash, label, vec_id AS idx, 'chunk ' || vec_id || repeat(' word', CAST(vec_id % 90 AS INT)) AS text, vec_id % 5 + 1 AS page_start, vec_id % 4 AS body_offset,
       list_dot_product(embedding::DOUBLE[], q) AS score FROM embeddings, q),
 m AS (SELECT doc_hash, label, count(*) AS chunk_count, sum(idx) AS byte_size, 'doc ' || doc_hash AS file_name, CASE WHEN label % 4 = 3 THEN 'old' WHEN label % 5 = 4 THEN NULL ELSE 'new' END AS embed_model, '2024-01-1' || label AS last_accessed FROM c GROUP BY 1, 2)"""
_SNIP180 = "CASE WHEN length(text) <= 180 THEN text ELSE regexp_replace(left(text, 180), '\\s+$', '') || '…' END"


@query(
    "v1_normalize",
    "SELECT vec_id, round(list_sum(list_transform(v, lambda x: x * x)), 4) AS squares, round(v[1], 5) AS first, CAST(len(v) AS BIGINT) AS dim FROM (SELECT vec_id, CASE WHEN vec_id % 9 = 0 THEN list_transform(embedding, lambda x: 0.0::DOUBLE) ELSE list_transform(embedding::DOUBLE[], lambda x: x * 3.0 / (3.0 * sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])))) END AS v FROM embeddings)",
)
def v1(spark, d):
    scaled = F.transform("embedding", lambda x: F.when(F.col("vec_id") % 9 == 0, F.lit(0.0)).otherwise(x.cast("double") * 3))
    df = table(spark, d, "embeddings").select("vec_id", V.normalized(scaled).alias("v"))
    squares = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x)
    return df.select("vec_id", F.round(squares, 4).alias("squares"), F.round(F.get("v", F.lit(0)).cast("double"), 5).alias("first"), F.size("v").cast("long").alias("dim"))


@query("j2_query_scores", f"WITH {_V} SELECT idx, round(least(greatest(score, -1), 1), 5) AS score FROM c")
def j2(spark, d):
    return V.scored(chunks(spark, d), first_vector(spark, d)).select("idx", F.round("score", 5).alias("score"))


@query("v4_vector_search", f"WITH {_V} SELECT idx, round(score, 5) AS score FROM c WHERE score >= 0.3 ORDER BY score DESC, idx LIMIT 5")
def v4(spark, d):
    return V.search(chunks(spark, d), first_vector(spark, d)).select("idx", F.round("score", 5).alias("score"))


@query("v4_other_dimension", "SELECT vec_id AS idx FROM embeddings WHERE false")
def v4b(spark, d):
    return V.search(chunks(spark, d), [1.0, 0.0]).select("idx")


@query("t3_best_chunk", f"WITH {_V} SELECT doc_hash, max(round(score, 5)) AS score, arg_max(idx, score) AS idx FROM c GROUP BY 1")
def t3(spark, d):
    df = V.scored(chunks(spark, d), first_vector(spark, d))
    return df.groupBy("doc_hash").agg(F.round(F.max("score"), 5).alias("score"), F.max_by("idx", "score").alias("idx"))


@query("w1_top_k_per_document", f"WITH {_V} SELECT doc_hash, idx, round(score, 5) AS score FROM c WHERE score >= 0.1 QUALIFY row_number() OVER (PARTITION BY doc_hash ORDER BY score DESC, idx) <= 3")
def w1(spark, d):
    hits = V.scored(chunks(spark, d), first_vector(spark, d)).where("score >= 0.1")
    return V.top_k(hits, ["doc_hash"], 3, [F.desc("score"), F.col("idx")]).select("doc_hash", "idx", F.round("score", 5).alias("score"))


@query("p8_valid_vectors", "SELECT vec_id, vec_id % 6 NOT IN (0, 1) AS ok FROM embeddings")
def p8(spark, d):
    v = F.when(F.col("vec_id") % 6 == 0, F.array().cast("array<float>")).when(F.col("vec_id") % 6 == 1, F.array_append("embedding", F.lit(float("nan")).cast("float"))).otherwise(F.col("embedding"))
    return table(spark, d, "embeddings").select("vec_id", V.valid(v).alias("ok"))


@query(
    "c10_semantic_search",
    f"""WITH {_V}, h AS (SELECT c.*, row_number() OVER (PARTITION BY doc_hash ORDER BY score DESC, idx) AS n FROM c JOIN m USING (doc_hash) WHERE embed_model = 'new' AND score >= 0.05),
    r AS (SELECT doc_hash, max(score) AS score, string_agg(page_start || ':' || {_SNIP180}, '|' ORDER BY n) FILTER (n <= 2) AS snippets FROM h WHERE n <= 3 GROUP BY 1)
    SELECT doc_hash, file_name, round(score, 5) AS score, snippets FROM r JOIN m USING (doc_hash) ORDER BY score DESC, last_accessed DESC, doc_hash LIMIT 50""",
)
def c10(spark, d):
    df = search.semantic_search(manifest(spark, d), chunks(spark, d), first_vector(spark, d), "new", least=0.05)
    text = F.array_join(F.transform("snippets", lambda s: F.concat_ws(":", s["page"].cast("string"), s["text"])), "|")
    return df.select("doc_hash", "file_name", F.round("score", 5).alias("score"), text.alias("snippets"))


@query(
    "p3_p4_search_outcome",
    f"WITH {_V} SELECT count(*) FILTER (embed_model = 'old') AS excluded, count(*) FILTER (embed_model = 'new' AND label = 0) AS corrupted, count(*) FILTER (embed_model IS NULL) AS no_index FROM m",
)
def p34(spark, d):
    bad = chunks(spark, d).withColumn("embedding", F.when((F.col("label") == 0) & (F.col("idx") % 2 == 0), F.slice("embedding", 1, 9)).otherwise(F.col("embedding")))
    return search.search_outcome(manifest(spark, d), bad, "new", 64)


# ---- collections


@query(
    "j1_resolve_members",
    f"""WITH f AS (SELECT sha256(CAST(doc_id // 2 AS VARCHAR)) AS doc_hash, min(doc_id) AS pos, min(doc_id // 2) AS k FROM documents GROUP BY 1)
    SELECT pos, doc_hash, CASE WHEN k % 7 = 0 THEN 'tab ' || k WHEN k % 2 = 0 THEN 'file ' || k ELSE doc_hash END AS file_name, CASE WHEN k = 0 THEN 'memory' ELSE 'session' END AS source,
           CASE WHEN k = 0 THEN 'ready' WHEN k % 2 = 1 THEN 'missing' WHEN k % 6 = 2 THEN 'no-index' WHEN k % 10 = 4 THEN 'model-mismatch' ELSE 'ready' END AS status FROM f""",
)
def j1(spark, d):
    docs = table(spark, d, "documents")
    members = docs.select(F.col("doc_id").alias("pos"), F.sha2(F.floor(F.col("doc_id") / 2).cast("string"), 256).alias("doc_hash"))
    k = F.col("doc_id")
    entries = docs.where("doc_id % 2 = 0").select(doc_hash().alias("doc_hash"), F.concat(F.lit("file "), k.cast("string")).alias("file_name"), F.when(k % 10 == 4, "old").otherwise("new").alias("embed_model"), F.lit(64).alias("embed_dim"), F.when(k % 6 == 2, 0).otherwise(5).alias("chunk_count"))
    tabs = docs.where("doc_id % 7 = 0").select(doc_hash().alias("doc_hash"), F.concat(F.lit("tab "), k.cast("string")).alias("file_name"))
    active = {"doc_hash": "5feceb66ffc86f38d952786c6d696c79c2dbc239dd4e91b46729d73a27fb57e9", "model": "new", "dim": 64}
    return search.resolve_members(members, entries, tabs, active)


_HITS = f"{_V}, h AS (SELECT c.*, file_name FROM c JOIN m USING (doc_hash, label) WHERE label IN (0, 1, 2, 5) AND score >= 0.05 QUALIFY row_number() OVER (PARTITION BY doc_hash ORDER BY score DESC, idx) <= 5)"


def _member_hits(spark, d):
    members = manifest(spark, d).where(F.col("doc_hash").isin("L0", "L1", "L2", "L5"))
    return search.collection_hits(members, chunks(spark, d), first_vector(spark, d), least=0.05)


@query("t2_merge_hits", f"WITH {_HITS} SELECT doc_hash, idx, round(score, 5) AS score FROM h ORDER BY score DESC, doc_hash, idx LIMIT 8")
def t2(spark, d):
    return search.merged(_member_hits(spark, d), 8).select("doc_hash", "idx", F.round("score", 5).alias("score"))


@query(
    "c9_collection_search",
    f"""WITH RECURSIVE {_HITS}, g AS (SELECT doc_hash, idx, '[' || file_name || ' p.' || page_start || ']' || chr(10) || substring(text, CAST(body_offset AS INT) + 1) AS seg, row_number() OVER (ORDER BY score DESC, doc_hash, idx) AS n FROM h),
    f AS (SELECT 0::BIGINT AS n, 0::BIGINT AS used, []::BIGINT[] AS kept UNION ALL
          SELECT g.n, CASE WHEN f.used + length(seg) <= 2000 THEN f.used + length(seg) ELSE f.used END, CASE WHEN f.used + length(seg) <= 2000 THEN list_append(f.kept, g.n) ELSE f.kept END FROM f JOIN g ON g.n = f.n + 1)
    SELECT string_agg(seg, chr(10) || chr(10) ORDER BY doc_hash, idx) AS context, count(*) AS kept FROM g WHERE list_contains((SELECT kept FROM f ORDER BY n DESC LIMIT 1), n)""",
)
def c9(spark, d):
    hits = _member_hits(spark, d).withColumn("one", F.lit(1))
    return qa.context(hits, ["one"], search.member_segment(), budget=2000, place=("doc_hash", "idx")).select("context", "kept")


@query("a10_dropped_documents", f"WITH {_HITS} SELECT CAST(count(DISTINCT doc_hash) - count(DISTINCT doc_hash) FILTER (score >= 0.2) AS BIGINT) AS dropped FROM h")
def a10(spark, d):
    hits = _member_hits(spark, d)
    return qa.dropped_documents(hits, hits.where("score >= 0.2"))


@query("t5_searchable_members", "SELECT k AS pos FROM (SELECT doc_id AS k FROM documents WHERE doc_id % 2 = 0) ORDER BY (k = 44) DESC, k LIMIT 20")
def t5(spark, d):
    df = table(spark, d, "documents").select(F.col("doc_id").alias("pos"), F.col("doc_id").cast("string").alias("doc_hash"), F.when(F.col("doc_id") % 2 == 0, "ready").otherwise("missing").alias("status"))
    return search.searchable_members(df, "44").select("pos")


_LIST = "list_transform(range(0, 6), lambda i: CASE WHEN i = 4 THEN 'bad' ELSE sha256(CAST((doc_id * i) % 11 AS VARCHAR)) END)"


def _hashes(spark, d):
    made = F.transform(F.sequence(F.lit(0), F.lit(5)), lambda i: F.when(i == 4, "bad").otherwise(F.sha2(((F.col("doc_id") * i) % 11).cast("string"), 256)))
    return table(spark, d, "documents").select("doc_id", made.alias("hs"))


@query(
    "u2_clean_hashes",
    f"""WITH l AS (SELECT doc_id, i, h FROM (SELECT doc_id, unnest(generate_series(1, 6)) AS i, unnest({_LIST}) AS h FROM documents) WHERE h <> 'bad'),
    f AS (SELECT doc_id, h, min(i) AS i FROM l GROUP BY ALL) SELECT doc_id, string_agg(left(h, 6), ',' ORDER BY i) AS hashes FROM f GROUP BY 1""",
)
def u2(spark, d):
    return _hashes(spark, d).select("doc_id", F.array_join(F.transform(store.clean_hashes(F.col("hs")), lambda h: F.left(h, F.lit(6))), ",").alias("hashes"))


@query(
    "u3_u4_members",
    f"SELECT doc_id, CAST(len(list_distinct(list_append({_LIST}, 'z'))) AS BIGINT) AS with_z, CAST(6 - 1 AS BIGINT) AS without_bad FROM documents",
)
def u34(spark, d):
    df = _hashes(spark, d)
    return df.select("doc_id", F.size(store.with_active(F.lit("z"), F.col("hs"))).cast("long").alias("with_z"), F.size(store.toggled(F.col("hs"), F.lit("bad"))).cast("long").alias("without_bad"))


# ---- questions and answers


@query(
    "j3_a4_verification",
    """WITH s AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id < 60), c AS (SELECT embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id >= 60),
    b AS (SELECT vec_id, label, greatest(max(list_dot_product(s.e, c.e)), 0) AS x FROM s, c GROUP BY 1, 2)
    SELECT label, count(*) AS total, round(avg(x), 5) AS avg_score, count(*) FILTER (x < 0.5) AS weak_count, count(*) FILTER (x < 0.5) >= 2 OR count(*) FILTER (x < 0.5) / count(*) > 0.2 OR avg(x) < 0.65 AS needs_refine FROM b GROUP BY 1""",
)
def j3(spark, d):
    rows = table(spark, d, "embeddings")
    best = V.best_scores(rows.where("vec_id < 60"), rows.where("vec_id >= 60"), "vec_id")
    scores = best.join(rows.select("vec_id", "label"), "vec_id")
    return qa.verification(scores, ["label"]).withColumn("avg_score", F.round("avg_score", 5))


@query(
    "a5_collection_verifier",
    f"WITH {_V} SELECT count(*) AS size, CAST(64 AS BIGINT) AS dim, round(greatest(max(score), 0), 5) AS max_score FROM c WHERE label IN (0, 1, 2)",
)
def a5(spark, d):
    df = V.scored(chunks(spark, d).where("label in (0, 1, 2)"), first_vector(spark, d)).groupBy("label").agg(F.count("*").alias("n"), F.max("score").alias("s"), F.first(F.size("embedding"), ignorenulls=True).alias("dim"))
    return df.agg(F.sum("n").alias("size"), F.first("dim", ignorenulls=True).cast("long").alias("dim"), F.round(F.greatest(F.max("s"), F.lit(0.0)), 5).alias("max_score"))


@query(
    "a6_keyword_score",
    r"""SELECT doc_id, CAST(len(regexp_extract_all(lower(text), '\bthe\b')) + len(regexp_extract_all(lower(text), '\bthat\b')) + (length(lower(text)) - length(replace(lower(text), 'é', ''))) AS BIGINT) AS score FROM documents""",
)
def a6(spark, d):
    words = F.array(F.lit("the"), F.lit("that"), F.lit("é"))
    return table(spark, d, "documents").select("doc_id", T.keyword_score(F.col("text"), words).alias("score"))


_M = "m AS (SELECT conv_id, turn, role, text, CASE WHEN role = 'assistant' AND (conv_id + turn) % 5 = 0 THEN 'cancelled' END AS meta FROM conversations WHERE role <> 'system')"


def messages(spark, d):
    gone = (F.col("role") == "assistant") & ((F.col("conv_id") + F.col("turn")) % 5 == 0)
    return table(spark, d, "conversations").where("role <> 'system'").withColumn("meta", F.when(gone, "cancelled"))


_A = f"{_M}, a AS (SELECT * FROM (SELECT *, lead(meta) OVER (PARTITION BY conv_id ORDER BY turn) AS after FROM m) WHERE NOT (role = 'user' AND coalesce(after = 'cancelled', false)) AND meta IS NULL)"


@query("w12_answered_pairs", f"WITH {_A} SELECT conv_id, turn, role FROM a")
def w12(spark, d):
    return qa.answered(messages(spark, d)).select("conv_id", "turn", "role")


@query(
    "w6_history",
    f"""WITH {_A}, l AS (SELECT conv_id, turn, CASE WHEN role = 'user' THEN 'Q: ' ELSE 'A: ' END || text AS l FROM a),
    u AS (SELECT *, sum(length(l) + 1) OVER w AS used, row_number() OVER w AS n FROM l WINDOW w AS (PARTITION BY conv_id ORDER BY turn DESC ROWS UNBOUNDED PRECEDING))
    SELECT conv_id, chr(10) || '[이전 대화]' || chr(10) || string_agg(l, chr(10) ORDER BY turn) || chr(10) AS history FROM u WHERE n = 1 OR used <= 600 GROUP BY 1""",
)
def w6(spark, d):
    return qa.history(messages(spark, d), 600)


@query(
    "w11_latest_pairs",
    "SELECT conv_id, turn FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations) WHERE i > greatest(n - 4, 0) + greatest(n - 4, 0) % 2",
)
def w11(spark, d):
    return qa.latest_pairs(table(spark, d, "conversations"), 4).select("conv_id", "turn")


@query(
    "w7_budget_with_skip",
    """WITH RECURSIVE l AS (SELECT doc_id, unnest(generate_series(1, len(p))) AS i, unnest(p) AS t FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents)),
    f AS (SELECT doc_id, 0::BIGINT AS i, 0::BIGINT AS used, 0::BIGINT AS kept FROM documents UNION ALL
          SELECT l.doc_id, l.i, CASE WHEN used + length(t) <= 800 THEN used + length(t) ELSE used END, CASE WHEN used + length(t) <= 800 THEN kept + 1 ELSE kept END FROM f JOIN l ON l.doc_id = f.doc_id AND l.i = f.i + 1)
    SELECT doc_id, max(used) AS used, max(kept) AS kept FROM f GROUP BY 1""",
)
def w7(spark, d):
    df = table(spark, d, "documents").select("doc_id", qa.within_budget(F.split("text", "\n"), F.char_length, 800).alias("k"))
    return df.select("doc_id", F.aggregate("k", F.lit(0), lambda a, x: a + F.char_length(x)).cast("long").alias("used"), F.size("k").cast("long").alias("kept"))


_WHOLE = r"regexp_replace(left({0}, 8000), '\[[^\]\n]{{0,130}}$', '')"


# the question's keywords are tion and thatan; no text has empty lines, so each is one paragraph, cut at the limit
@query(
    "c8_keyword_context",
    rf"""WITH RECURSIVE t AS (SELECT doc_id, text AS t FROM documents WHERE length(text) > 8000), v AS (SELECT doc_id, 1::BIGINT AS i, t FROM t), {chunks_sql("greatest(100, round(2666 / " + cpt_sql("t") + "))")},
    s AS (SELECT doc_id, k, c, len(regexp_extract_all(lower(c), '\btion\b')) + len(regexp_extract_all(lower(c), '\bthatan\b')) AS score FROM c),
    o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, k) AS n FROM s WHERE score > 0),
    g AS (SELECT DISTINCT doc_id, 0::BIGINT AS n, 0::BIGINT AS used, NULL::BIGINT AS k, NULL::VARCHAR AS c FROM o UNION ALL
          SELECT o.doc_id, o.n, CASE WHEN used + length(o.c) <= 8000 THEN used + length(o.c) ELSE used END, o.k, CASE WHEN used + length(o.c) <= 8000 THEN o.c END FROM g JOIN o ON o.doc_id = g.doc_id AND o.n = g.n + 1),
    a AS (SELECT doc_id, string_agg(c, chr(10) || chr(10) ORDER BY k) AS chosen FROM g GROUP BY 1),
    e AS (SELECT doc_id, count(*) AS n, min_by(c, k) || chr(10) || chr(10) || max_by(c, k) AS ends, max_by(c, score * 1000000 - k) AS best, max(score) AS score FROM s GROUP BY 1),
    r AS (SELECT d.doc_id, CASE WHEN e.doc_id IS NULL THEN coalesce(text, '') WHEN e.n <= 1 THEN {_WHOLE.format("text")} WHEN score = 0 THEN {_WHOLE.format("ends")} WHEN chosen IS NULL THEN {_WHOLE.format("best")} ELSE chosen END AS context
          FROM documents d LEFT JOIN e ON e.doc_id = d.doc_id LEFT JOIN a ON a.doc_id = d.doc_id)
    SELECT doc_id, length(context) AS n, sha256(context) AS hash FROM r""",
)
def c8(spark, d):
    df = qa.keyword_context(table(spark, d, "documents"), "What is the tion of thatan?")
    return df.select("doc_id", F.char_length("context").cast("long").alias("n"), F.sha2("context", 256).alias("hash"))


# 1,200 characters, so that some of the best passages do not fit and later ones still may
@query(
    "c7_rag_context",
    f"""WITH RECURSIVE {_V}, h AS (SELECT doc_hash, idx, row_number() OVER (PARTITION BY doc_hash ORDER BY score DESC, idx) AS n FROM c WHERE score >= 0.1 QUALIFY n <= 5),
    s AS (SELECT doc_hash, idx, n, '[p.' || (idx % 5 + 1) || ']' || chr(10) || substring('chunk ' || idx || repeat(' word', CAST(idx % 90 AS INT)), CAST(idx % 4 AS INT) + 1) AS segment FROM h),
    f AS (SELECT DISTINCT doc_hash, 0::BIGINT AS n, 0::BIGINT AS used, NULL::BIGINT AS idx, NULL::VARCHAR AS segment FROM s UNION ALL
          SELECT s.doc_hash, s.n, CASE WHEN used + length(s.segment) <= 1200 THEN used + length(s.segment) ELSE used END, s.idx, CASE WHEN used + length(s.segment) <= 1200 THEN s.segment END FROM f JOIN s ON s.doc_hash = f.doc_hash AND s.n = f.n + 1)
    SELECT doc_hash, coalesce(string_agg(segment, chr(10) || chr(10) ORDER BY idx), '') AS context, count(segment) AS kept FROM f GROUP BY 1""",
)
def c7(spark, d):
    hits = V.top_k(V.scored(chunks(spark, d), first_vector(spark, d)).where("score >= 0.1"), ["doc_hash"], 5, [F.desc("score"), F.col("idx")])
    return qa.context(hits, ["doc_hash"], T.labeled_segment(F.col("text"), T.page_label(F.col("page_start")), F.col("body_offset")), 1200)


@query("c14_refine_fallback", "SELECT item_id, CASE item_id % 3 WHEN 0 THEN text WHEN 1 THEN text ELSE 'better' END AS answer FROM benchmark")
def c14(spark, d):
    made = F.when(F.col("item_id") % 3 == 0, F.lit(None)).when(F.col("item_id") % 3 == 1, " \n").otherwise("better")
    return table(spark, d, "benchmark").select("item_id", qa.refined(made, F.col("text")).alias("answer"))


# ---- store


def entries(spark, d):
    s = sessions(spark, d)
    return s.select("doc_hash", "last_accessed", "byte_size", (F.col("doc_id") % 50 == 0).alias("pinned"), (F.col("doc_id") % 10).alias("lib"))


_E = f"e AS (SELECT {HASH_SQL} AS doc_hash, {DAY_SQL} AS last_accessed, n_chars AS byte_size, doc_id % 50 = 0 AS pinned, doc_id % 10 AS lib FROM documents)"


@query(
    "a9_lru_eviction",
    f"""WITH {_E}, x AS (SELECT *, count(*) OVER (PARTITION BY lib) - coalesce(sum(CASE WHEN pinned THEN 0 ELSE 1 END) OVER o, 0) AS c, sum(byte_size) OVER (PARTITION BY lib) - coalesce(sum(CASE WHEN pinned THEN 0 ELSE byte_size END) OVER o, 0) AS b
    FROM e WINDOW o AS (PARTITION BY lib ORDER BY last_accessed, doc_hash ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) SELECT lib, doc_hash FROM x WHERE NOT pinned AND (c > 30 OR b > 60000)""",
)
def a9(spark, d):
    return store.evicted(entries(spark, d), ["lib"], 30, 60000).select("lib", "doc_hash")


@query("a8_library_stats", f"WITH {_E} SELECT count(*) AS n, CAST(sum(byte_size) AS BIGINT) AS total_bytes FROM e")
def a8(spark, d):
    return store.stats(entries(spark, d))


@query("t6_recent", f"WITH {_E} SELECT doc_hash, last_accessed FROM e ORDER BY last_accessed DESC, doc_hash")
def t6(spark, d):
    return store.recent(entries(spark, d)).select("doc_hash", "last_accessed")


@query(
    "s26_upsert",
    "SELECT doc_id AS k, CASE WHEN doc_id % 3 = 0 THEN 'new' ELSE 'old' END AS v, CASE WHEN doc_id % 3 = 0 THEN 2 ELSE 1 END AS at FROM documents UNION ALL SELECT doc_id + 1000000, 'new', 2 FROM documents WHERE doc_id % 100 = 0",
)
def s26(spark, d):
    docs = table(spark, d, "documents")
    old = docs.select(F.col("doc_id").alias("k"), F.lit("old").alias("v"), F.lit(1).alias("at"))
    new = docs.where("doc_id % 3 = 0").select(F.col("doc_id").alias("k"), F.lit("new").alias("v"), F.lit(2).alias("at"))
    more = docs.where("doc_id % 100 = 0").select((F.col("doc_id") + 1000000).alias("k"), F.lit("new").alias("v"), F.lit(2).alias("at"))
    return store.upsert(old, new.union(more), "k", "at")


@query("s26_summary_merge", f"SELECT {HASH_SQL} AS doc_hash, CASE WHEN doc_id % 3 = 0 THEN 'new' WHEN doc_id % 4 = 0 THEN left(text, 300) END AS full_summary, CASE WHEN doc_id % 3 = 0 THEN 'kw' END AS keywords FROM documents")
def s26b(spark, d):
    s = sessions(spark, d)
    add = lambda n, c: F.struct(F.lit(n).alias("name"), F.lit(c).alias("content"))
    news = s.where("doc_id % 3 = 0").select("doc_hash", F.explode(F.array(add("full", "new"), add("keywords", "kw"))).alias("x")).select("doc_hash", "x.*")
    out = store.merge_summaries(s, news)
    return out.select("doc_hash", F.try_element_at("summaries", F.lit("full")).alias("full_summary"), F.try_element_at("summaries", F.lit("keywords")).alias("keywords"))


@query("s25_session_meta", f"WITH {_S} SELECT doc_hash, file_name, CAST(len(p) AS BIGINT) AS page_count, sm IS NOT NULL AS has_summary FROM s")
def s25(spark, d):
    return sessions(spark, d).select("doc_hash", "file_name", F.size("page_texts").cast("long").alias("page_count"), (F.size("summaries") > 0).alias("has_summary"))


@query(
    "p10_normalize_manifest",
    f"""SELECT {HASH_SQL} AS doc_hash, left(repeat(source, 200), 512) AS file_name, '' AS file_path, CASE WHEN doc_id % 3 = 0 THEN 0 ELSE doc_id END AS page_count, left(repeat('m', CAST(doc_id % 200 AS INT)), 128) AS embed_model, CASE WHEN doc_id % 2 = 0 THEN 64 END::BIGINT AS embed_dim,
    0::BIGINT AS chunk_count, n_chars AS byte_size, CASE WHEN doc_id % 5 = 0 THEN '1970-01-01T00:00:00.000Z' ELSE {DAY_SQL} END AS last_accessed FROM documents WHERE doc_id % 4 <> 0""",
)
def p10(spark, d):
    k = F.col("doc_id")
    raw = table(spark, d, "documents").select(
        F.when(k % 4 == 0, "nothash").otherwise(doc_hash()).alias("doc_hash"),
        F.repeat("source", F.lit(200)).alias("file_name"),
        F.lit(None).cast("string").alias("file_path"),
        F.when(k % 3 == 0, "many").otherwise(k.cast("string")).alias("page_count"),
        F.repeat(F.lit("m"), (k % 200).cast("int")).alias("embed_model"),
        F.when(k % 2 == 0, "64").otherwise("x").alias("embed_dim"),
        F.lit("-3").alias("chunk_count"),
        F.col("n_chars").cast("string").alias("byte_size"),
        F.when(k % 5 == 0, F.lit(None)).otherwise(F.expr(DAY)).alias("last_accessed"),
    )
    return store.normalized_manifest(raw)


@query(
    "j9_u5_reconcile",
    f"""SELECT {HASH_SQL} AS doc_hash, CASE WHEN doc_id % 5 = 0 THEN CASE WHEN doc_id % 10 = 0 THEN 'remove' ELSE 'register' END WHEN doc_id % 5 = 1 THEN 'drop' WHEN doc_id % 10 = 2 THEN 'remove' WHEN doc_id % 5 = 3 THEN 'clear-index' ELSE 'keep' END AS action FROM documents""",
)
def j9(spark, d):
    k = F.col("doc_id")
    docs = table(spark, d, "documents")
    known = docs.where(k % 5 != 0).select(doc_hash().alias("doc_hash"), F.lit(3).alias("chunk_count"))
    found = docs.where(k % 5 != 1).select(doc_hash().alias("doc_hash"), (~((k % 10 == 0) | (k % 10 == 2))).alias("readable"), (k % 5 != 3).alias("has_index"))
    return store.reconciled(known, found)


@query("j8_open_collection", "SELECT count(*) AS opened, count(*) + 1 AS total FROM documents")
def j8(spark, d):
    ids = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("doc_hash"))
    return store.opened(ids.select(F.array("doc_hash", F.lit("gone"), "doc_hash").alias("doc_hashes")), ids)


@query(
    "c21_restore",
    f"""SELECT {HASH_SQL} AS doc_hash, CASE doc_id % 4 WHEN 0 THEN 'none' WHEN 1 THEN 'full' WHEN 2 THEN 'refused' ELSE 'text' END AS state, doc_id % 4 = 1 AND doc_id % 3 = 1 AS index, CASE WHEN doc_id % 4 = 1 THEN 'b' END AS summary, CASE WHEN doc_id % 4 = 1 THEN doc_id ELSE 0 END AS n_messages FROM documents""",
)
def c21(spark, d):
    k = F.col("doc_id")
    docs = table(spark, d, "documents")
    version = F.when(k % 4 == 1, 1).when(k % 4 == 2, 2).otherwise(0)
    kept = docs.where(k % 4 != 0).select(doc_hash().alias("doc_hash"), version.alias("schema_version"), F.when(k % 3 == 1, "new").otherwise("old").alias("embed_model"), F.lit(2).alias("chunk_count"), F.create_map(F.lit("c"), F.lit("x"), F.lit("b"), F.lit("y"), F.lit("a"), F.lit(" ")).alias("summaries"), k.alias("n_messages"))
    return store.restored(docs.select(doc_hash().alias("doc_hash")), kept, "new")


@query(
    "c22_save_rules",
    """SELECT doc_id AS doc_hash, CASE WHEN doc_id % 4 = 0 THEN 2 ELSE 1 END AS revision, CASE WHEN doc_id % 4 = 0 THEN 9 ELSE 5 END AS chunk_count, CASE WHEN doc_id % 3 = 0 THEN 'new' ELSE 'old' END AS summary, true AS committed, 2 AS saved_at FROM documents""",
)
def c22(spark, d):
    docs = table(spark, d, "documents")
    k = F.col("doc_id")
    row = lambda *c: [x.alias(n) for x, n in zip(c, ("doc_hash", "revision", "index_state", "chunk_count", "summary", "committed", "saved_at"), strict=True)]
    old = docs.select(*row(k, F.lit(1), F.lit("ready"), F.lit(5), F.lit("old"), F.lit(True), F.lit(1))).drop("index_state")
    new = docs.select(*row(k, F.lit(2) - (k % 4 == 3).cast("int"), F.when(k % 4 == 1, "building").when(k % 4 == 2, "failed").otherwise("ready"), F.lit(9), F.lit("new"), k % 3 == 0, F.lit(2)))
    return store.saved(old, new)


@query(
    "s28_collections",
    f"""WITH e AS (SELECT doc_id // 100 AS lib, CAST(doc_id AS VARCHAR) AS id, CASE WHEN doc_id % 3 = 1 THEN ' set ' || source ELSE 'new ' || source END AS name, CASE WHEN doc_id % 3 = 1 THEN 3 ELSE 1 END::BIGINT AS members,
           CASE WHEN doc_id % 3 = 1 THEN {DAY_SQL} ELSE replace({DAY_SQL}, '2024-01', '2024-02') END AS la, doc_id % 100 = 1 AS pinned FROM documents),
    w AS (SELECT *, count(*) OVER (PARTITION BY lib) AS n, count(*) FILTER (NOT pinned) OVER (PARTITION BY lib ORDER BY la, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS gone FROM e)
    SELECT id, name, members FROM w WHERE pinned OR n - gone <= 50""",
)
def s28(spark, d):
    # libraries of a hundred ids; a third of the documents is stored only, a third new, and a third stored and changed
    k = F.col("doc_id")
    made = lambda name, day: table(spark, d, "documents").select(F.floor(k / 100).alias("lib"), k.cast("string").alias("id"), F.concat(F.lit(name), "source").alias("name"), F.array(doc_hash(), doc_hash(), F.lit("bad")).alias("doc_hashes"), day.alias("last_accessed"), k)
    stored = made(" set ", F.expr(DAY)).where(k % 3 != 0).drop("doc_id")
    changes = made(" new ", F.replace(F.expr(DAY), F.lit("2024-01"), F.lit("2024-02"))).where(k % 3 != 1).drop("doc_id")
    current = (F.col("lib") * 100 + 1).cast("string")
    return store.saved_collections(stored, changes, current, ["lib"]).select("id", "name", F.size("doc_hashes").cast("long").alias("members"))


@query("x8_latest_request", "SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY 1")
def x8(spark, d):
    return store.latest_only(table(spark, d, "events").select("user_id", "event_id", "event_type"), "user_id", "event_id")


# ---- chunks and chapters


@query(
    "c4_page_range_chapters",
    """WITH p AS (SELECT doc_id, len(string_split(text, chr(10))) AS n FROM documents), r AS (SELECT doc_id, n, unnest(generate_series(0, (n - 1) // 10)) AS i FROM p)
    SELECT doc_id, CAST(i + 1 AS INT) AS index, concat('Pages ', i * 10 + 1, '-', least((i + 1) * 10, n)) AS title, CAST(i * 10 + 1 AS INT) AS start_page, CAST(least((i + 1) * 10, n) AS INT) AS end_page FROM r""",
)
def c4(spark, d):
    df = table(spark, d, "documents").select("doc_id", F.split("text", "\n").alias("p")).withColumn("s", C.chapter_starts(F.col("p")))
    return df.select("doc_id", F.inline(C.detect_chapters(F.col("p"), F.col("s"))))


@query(
    "w3_chapter_ends",
    """WITH p AS (SELECT doc_id, unnest(generate_series(1, len(l))) AS page, unnest(l) AS t, len(l) AS n FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)),
    h AS (SELECT doc_id, page, n, row_number() OVER (PARTITION BY doc_id ORDER BY page) AS i FROM p WHERE page % 3 = 2 UNION ALL SELECT doc_id, NULL, n, 1 FROM p WHERE n = 1)
    SELECT doc_id, CAST(i AS INT) AS index, coalesce('Chapter ' || ((page + 1) // 3) || ' x', 'Pages 1-1') AS title, CAST(CASE WHEN i = 1 THEN 1 ELSE page END AS INT) AS start_page, CAST(coalesce(lead(page) OVER (PARTITION BY doc_id ORDER BY page) - 1, n) AS INT) AS end_page FROM h""",
)
def w3(spark, d):
    # every third page begins with a heading
    head = lambda t, i: F.when(i % 3 == 1, F.concat(F.lit("Chapter "), F.floor((i + 2) / 3).cast("string"), F.lit(" x\n"), t)).otherwise(F.concat(F.lit("- "), t))
    df = table(spark, d, "documents").select("doc_id", F.transform(F.split("text", "\n"), head).alias("p"))
    df = df.withColumn("s", C.chapter_starts(F.col("p")))
    return df.select("doc_id", F.inline(C.detect_chapters(F.col("p"), F.col("s"))))


@query(
    "j6_chapter_pages",
    """WITH p AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents), r AS (SELECT doc_id, l, unnest(generate_series(0, (len(l) - 1) // 10)) AS i FROM p)
    SELECT doc_id, CAST(i + 1 AS INT) AS index, sha256(array_to_string(l[i * 10 + 1:(i + 1) * 10], chr(10) || chr(10))) AS text_hash FROM r""",
)
def j6(spark, d):
    df = table(spark, d, "documents").select("doc_id", F.split("text", "\n").alias("p")).withColumn("s", C.chapter_starts(F.col("p")))
    df = df.select("doc_id", F.explode(C.with_text(C.detect_chapters(F.col("p"), F.col("s")), F.col("p"))).alias("c"))
    return df.select("doc_id", "c.index", F.sha2("c.text", 256).alias("text_hash"))


@query(
    "j4_page_of_offset",
    """WITH p AS (SELECT doc_id, unnest(generate_series(1, len(l))) AS page, unnest(l) AS t FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)),
    o AS (SELECT doc_id, page, coalesce(sum(length(t) + 2) OVER (PARTITION BY doc_id ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos FROM p)
    SELECT doc_id, CAST(max(page) AS BIGINT) AS page FROM o JOIN documents USING (doc_id) WHERE pos <= n_chars // 2 GROUP BY 1""",
)
def j4(spark, d):
    docs = table(spark, d, "documents")
    return docs.select("doc_id", C.page_of_offset(F.split("text", "\n"), F.floor(F.col("n_chars") / 2)).cast("long").alias("page"))


def lined(spark, d):
    """Documents whose lines are paragraphs."""
    return table(spark, d, "documents").select("doc_id", F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("t"), F.split("text", "\n").alias("page_texts"))


@query(
    "c1_chunk_text",
    """WITH RECURSIVE d AS (SELECT doc_id, replace(text, chr(10), chr(10) || chr(10)) AS t FROM documents), p AS (SELECT doc_id, t, string_split(t, chr(10) || chr(10)) AS p FROM d),
    f AS (SELECT doc_id, 0::BIGINT AS i, ''::VARCHAR AS cur, []::VARCHAR[] AS out FROM p UNION ALL
          SELECT f.doc_id, f.i + 1, CASE WHEN cur = '' OR length(cur || '  ' || p[f.i + 1]) > 400 THEN p[f.i + 1] ELSE cur || chr(10) || chr(10) || p[f.i + 1] END,
                 CASE WHEN cur <> '' AND length(cur || '  ' || p[f.i + 1]) > 400 AND regexp_matches(cur, '\\S') THEN list_append(out, regexp_replace(cur, '^\\s+|\\s+$', '', 'g')) ELSE out END FROM f JOIN p ON p.doc_id = f.doc_id WHERE f.i < len(p)),
    g AS (SELECT doc_id, t, arg_max(CASE WHEN regexp_matches(cur, '\\S') THEN list_append(out, regexp_replace(cur, '^\\s+|\\s+$', '', 'g')) ELSE out END, i) AS out FROM f JOIN p USING (doc_id) GROUP BY ALL),
    h AS (SELECT doc_id, CASE WHEN length(t) <= 400 THEN [t] ELSE flatten(list_transform(out, lambda c: list_transform(range(0, greatest((length(c) - 1) // 400, 0) + 1), lambda k: substring(c, k * 400 + 1, 400)))) END AS c FROM g)
    SELECT doc_id, CAST(len(c) AS BIGINT) AS n, sha256(array_to_string(c, '|')) AS hash FROM h""",
)
def c1(spark, d):
    df = lined(spark, d).select("doc_id", C.chunk_text(F.col("t"), 100).alias("c"))
    return df.select("doc_id", F.size("c").cast("long").alias("n"), F.sha2(F.array_join("c", "|"), 256).alias("hash"))


@query("c2_overlap_chunks")
def c2(spark, d):
    return C.overlap_chunks_of(lined(spark, d), "doc_id", "page_texts", 120)


# a chapter is ten lines here; document and chapter are one number while its lines are packed
@query(
    "c3_chunk_chapters",
    f"""WITH RECURSIVE l AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents), r AS (SELECT doc_id, l, unnest(generate_series(0, (len(l) - 1) // 10)) AS i FROM l),
    t AS (SELECT doc_id * 1000000 + i + 1 AS doc_id, array_to_string(l[i * 10 + 1:(i + 1) * 10], chr(10) || chr(10)) AS t FROM r),
    v AS (SELECT doc_id, unnest(generate_series(1, len(p))) AS i, unnest(p) AS t FROM (SELECT doc_id, string_split(t, chr(10) || chr(10)) AS p FROM t)), {chunks_sql(200)}
    SELECT doc_id // 1000000 AS doc_id, CAST(doc_id % 1000000 AS INT) AS index, CAST(k - 1 AS INT) AS i, c AS chunk FROM c""",
)
def c3(spark, d):
    df = lined(spark, d).withColumn("s", C.chapter_starts(F.col("page_texts")))
    df = df.select("doc_id", F.explode(C.with_text(C.detect_chapters(F.col("page_texts"), F.col("s")), F.col("page_texts"))).alias("c"))
    return df.select("doc_id", "c.index", F.posexplode(C.chunk_text(F.col("c.text"), 200)).alias("i", "chunk"))


@query("c6_index_build")
def c6(spark, d):
    return V.embedded(C.overlap_chunks_of(lined(spark, d), "doc_id", "page_texts"), V.HashingEmbedder()).select("doc_id", "idx", "model", "embedding")
