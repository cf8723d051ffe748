"""Queries of the text functions. Where the tables have no citations, headings or other letters, they are put in by
expressions that both engines work out alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pageloom.functions import text as T
from pageloom.plans.registry import query, table

CITE = r"(?i)\[(?:([^\[\]|\n]{1,120}?)\s+)?p\.\s*(\d+)(?:\s*\|\s*[^\]\n]{0,200})?\s*\]"
BARE = r"(?i)\[p\.\s*(\d+)(?:\s*\|\s*[^\]\n]{0,200})?\s*\]"
#: A document's text with citations put in: bare, named, with a quotation, page 0 and one cut off at the end.
CITED = """concat('Intro [p.', cast(doc_id % 90 as string), '] ', substring(text, 1, 200), ' [', source, '.pdf p. ', cast(doc_id % 7 as string), '] and [P.', cast(doc_id as string), ' | a quote]. ', substring(text, 201), ' [p.12')"""
CITED_SQL = """concat('Intro [p.', CAST(doc_id % 90 AS VARCHAR), '] ', substring(text, 1, 200), ' [', source, '.pdf p. ', CAST(doc_id % 7 AS VARCHAR), '] and [P.', CAST(doc_id AS VARCHAR), ' | a quote]. ', substring(text, 201), ' [p.12')"""
SANITIZED = r"regexp_replace(regexp_replace({0}, '(?m)^\s*---\s*$', '\\-\\-\\-', 'g'), '(?m)^\s*\[질문\]', '\\[질문\\]', 'g')"
_TRIM = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", "n_chars")


def cited(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).withColumn("c", F.expr(CITED))


_STOP = ", ".join(f"'{w}'" for w in T.STOPWORDS)


@query(
    "f5_keywords",
    rf"""SELECT item_id, array_to_string(list_filter(list_transform(regexp_split_to_array(regexp_replace(text, '[?？!！.,;:''"()\[\]{{}}]', ' ', 'g'), '\s+'), lambda w: lower(w)),
         lambda w: length(w) >= 2 AND w NOT IN ({_STOP})), ' ') AS keywords FROM benchmark""",
)
def f5(spark, d):
    return table(spark, d, "benchmark").select("item_id", F.array_join(T.keywords(F.col("text")), " ").alias("keywords"))


@query(
    "f6_sentences",
    rf"""WITH s AS (SELECT doc_id, {_TRIM.format(rf"regexp_replace(regexp_replace({CITED_SQL}, '{CITE}', '', 'g'), '\s+', ' ', 'g')")} AS t FROM documents),
         p AS (SELECT doc_id, list_filter(string_split(regexp_replace(t, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: length(x) >= 15)[1:100] AS s FROM s)
         SELECT doc_id, i, s[i] AS sentence FROM (SELECT doc_id, s, unnest(generate_series(1, len(s))) AS i FROM p)""",
)
def f6(spark, d):
    df = cited(spark, d).select("doc_id", F.posexplode(T.sentences(F.col("c"))).alias("i", "sentence"))
    return df.select("doc_id", (F.col("i") + 1).cast("long").alias("i"), "sentence")


@query(
    "f7_citation_grammar",
    f"""SELECT doc_id, array_to_string(list_transform(regexp_extract_all(c, '{CITE}', 1), lambda x: coalesce(x, '')), '|') AS docs, array_to_string(regexp_extract_all(c, '{CITE}', 2), '|') AS pages
        FROM (SELECT doc_id, {CITED_SQL} AS c FROM documents)""",
)
def f7(spark, d):
    both = [F.array_join(F.regexp_extract_all("c", F.lit(T.CITATION), F.lit(i)), "|").alias(n) for i, n in ((1, "docs"), (2, "pages"))]
    return cited(spark, d).select("doc_id", *both)


@query(
    "f8_parse_citations",
    f"""WITH c AS (SELECT doc_id, {CITED_SQL} AS c FROM documents),
        x AS (SELECT doc_id, regexp_split_to_array(c, '{CITE}') AS g, regexp_extract_all(c, '{CITE}') AS r, regexp_extract_all(c, '{CITE}', 1) AS n, regexp_extract_all(c, '{CITE}', 2) AS p FROM c),
        i AS (SELECT *, unnest(generate_series(1, len(g))) AS i FROM x),
        s AS (SELECT doc_id, 2 * i AS o, 'text' AS type, g[i] AS content, NULL::BIGINT AS page, NULL AS doc_name FROM i WHERE g[i] <> ''
              UNION ALL SELECT doc_id, 2 * i + 1, CASE WHEN p[i]::BIGINT >= 1 THEN 'citation' ELSE 'text' END, CASE WHEN p[i]::BIGINT >= 1 THEN NULL ELSE r[i] END,
                     CASE WHEN p[i]::BIGINT >= 1 THEN p[i]::BIGINT END, CASE WHEN p[i]::BIGINT >= 1 THEN nullif(trim(n[i]), '') END FROM i WHERE i <= len(r))
        SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY o) AS i, type, content, page, doc_name FROM s""",
)
def f8(spark, d):
    df = cited(spark, d).select("doc_id", F.posexplode(T.parse_citations(F.col("c"))).alias("i", "s"))
    return df.select("doc_id", (F.col("i") + 1).cast("long").alias("i"), "s.type", "s.content", "s.page", "s.doc_name")


@query(
    "f9_strip_citations",
    f"SELECT doc_id, regexp_replace(c, '{CITE}', '', 'g') AS none, regexp_replace(c, '{BARE}', '', 'g') AS named FROM (SELECT doc_id, {CITED_SQL} AS c FROM documents)",
)
def f9(spark, d):
    return cited(spark, d).select("doc_id", T.strip_citations(F.col("c")).alias("none"), T.strip_bare_citations(F.col("c")).alias("named"))


@query(
    "f10_qualify_citations",
    rf"SELECT doc_id, regexp_replace(c, '{BARE}', '[' || source || ' x.pdf p.\1]', 'g') AS qualified FROM (SELECT doc_id, source, {CITED_SQL} AS c FROM documents)",
)
def f10(spark, d):
    return cited(spark, d).select("doc_id", T.qualify_citations(F.col("c"), F.concat("source", F.lit("[x].pdf"))).alias("qualified")).withColumn("qualified", F.replace("qualified", F.lit(" x .pdf"), F.lit(" x.pdf")))


@query("f11_strip_partial", rf"SELECT doc_id, regexp_replace(c, '\[[^\]\n]{{0,130}}$', '') AS whole FROM (SELECT doc_id, {CITED_SQL} AS c FROM documents)")
def f11(spark, d):
    return cited(spark, d).select("doc_id", T.strip_partial_citation(F.col("c")).alias("whole"))


@query(
    "f12_doc_label",
    rf"""SELECT doc_id, {_TRIM.format("left(" + _TRIM.format(rf"regexp_replace(regexp_replace(n, '[\[\]|\n]', ' ', 'g'), '\s+', ' ', 'g')") + ", 110)")} AS label
         FROM (SELECT doc_id, concat('[', source, ']|  ', substring(text, 1, 130)) AS n FROM documents)""",
)
def f12(spark, d):
    name = F.concat(F.lit("["), "source", F.lit("]|  "), F.substring("text", 1, 130))
    return documents(spark, d).select("doc_id", T.doc_label(name).alias("label"))


@query(
    "f4_sanitize_prompt",
    rf"""SELECT doc_id, {SANITIZED.format("t")} AS safe
        FROM (SELECT doc_id, concat(substring(text, 1, 50), chr(10), ' ---', chr(10), 'a --- b', chr(10), '[질문] x', chr(10), substring(text, 51)) AS t FROM documents)""",
)
def f4(spark, d):
    t = F.concat(F.substring("text", 1, 50), F.lit("\n ---\na --- b\n[질문] x\n"), F.expr("substring(text, 51)"))
    return documents(spark, d).select("doc_id", T.sanitize_prompt(t).alias("safe"))


@query(
    "f2_code_points",
    "SELECT doc_id, i + 1 AS i, substring(text, i * 700 + 1, 700) AS piece FROM (SELECT doc_id, text, unnest(generate_series(0, greatest((length(text) - 1) // 700, 0))) AS i FROM documents)",
)
def f2(spark, d):
    df = documents(spark, d).select("doc_id", F.posexplode(T.code_point_pieces(F.col("text"), 700)).alias("i", "piece"))
    return df.select("doc_id", (F.col("i") + 1).cast("long").alias("i"), "piece")


@query(
    "f14_labels",
    "SELECT doc_id, CASE WHEN doc_id % 5 >= 1 THEN '[p.' || (doc_id % 5) || ']' ELSE '' END AS label, CASE doc_id % 3 WHEN 1 THEN 'slide ' || doc_id WHEN 2 THEN 'ch. ' || doc_id ELSE 'p.' || doc_id END AS shown FROM documents",
)
def f14(spark, d):
    kind = F.when(F.col("doc_id") % 3 == 1, "slide").when(F.col("doc_id") % 3 == 2, "chapter")
    return documents(spark, d).select("doc_id", T.page_label(F.col("doc_id") % 5).alias("label"), T.unit_label(F.col("doc_id"), kind).alias("shown"))


@query("p11_clamp_page", "SELECT doc_id, CASE WHEN n_chars BETWEEN 1 AND 2400 THEN n_chars END AS page FROM documents")
def p11(spark, d):
    return documents(spark, d).select("doc_id", T.clamp_page(F.col("n_chars"), F.lit(2400)).cast("long").alias("page"))


@query(
    "f15_label_paragraphs",
    r"""WITH p AS (SELECT doc_id, unnest(generate_series(1, len(l))) AS page, unnest(l) AS t FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)),
        u AS (SELECT doc_id, page, regexp_replace(t, '^\s+|\s+$', '', 'g') AS t FROM p),
        v AS (SELECT doc_id, page, k, substring(t, k * 1500 + 1, 1500) AS t FROM (SELECT *, unnest(range(0, greatest(length(t) - 1, 0) // 1500 + 1)) AS k FROM u))
        SELECT doc_id, coalesce(string_agg('[p.' || page || '] ' || t, chr(10) || chr(10) ORDER BY page, k) FILTER (t <> ''), '') AS labeled FROM v GROUP BY doc_id""",
)
def f15(spark, d):
    return documents(spark, d).select("doc_id", T.label_paragraphs(F.split("text", "\n")).alias("labeled"))


@query(
    "f16_labeled_segment",
    "SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN text ELSE '[p.' || (doc_id % 4) || ']' || chr(10) || substring(text, CAST(doc_id % 50 AS INT) + 1) END AS segment FROM documents",
)
def f16(spark, d):
    seg = T.labeled_segment(F.col("text"), T.page_label(F.col("doc_id") % 4), (F.col("doc_id") % 50).cast("int"))
    return documents(spark, d).select("doc_id", seg.alias("segment"))


@query(
    "f17_keyword_snippet",
    rf"""SELECT doc_id, CASE WHEN s > 0 THEN '…' ELSE '' END || {_TRIM.format(r"regexp_replace(substring(text, s + 1, e - s), '\s+', ' ', 'g')")} || CASE WHEN e < length(text) THEN '…' ELSE '' END AS snippet
         FROM (SELECT doc_id, text, greatest(a - 1 - 50, 0) AS s, least(length(text), a - 1 + 4 + 50) AS e FROM (SELECT doc_id, text, strpos(lower(text), 'ther') AS a FROM documents) WHERE a > 0)""",
)
def f17(spark, d):
    df = documents(spark, d).select("doc_id", T.keyword_snippet(F.col("text"), F.lit("ther")).alias("snippet"))
    return df.where("snippet is not null")


@query(
    "f18_semantic_snippet",
    rf"""SELECT doc_id, CASE WHEN length(t) <= 180 THEN t ELSE regexp_replace(regexp_replace(left(t, 180), '\[[^\]\n]{{0,130}}$', ''), '\s+$', '') || '…' END AS snippet
         FROM (SELECT doc_id, {_TRIM.format(rf"regexp_replace(left({CITED_SQL}, CAST(100 + doc_id % 400 AS INT)), '\s+', ' ', 'g')")} AS t FROM documents)""",
)
def f18(spark, d):
    return cited(spark, d).select("doc_id", T.semantic_snippet(F.left("c", (100 + F.col("doc_id") % 400).cast("int"))).alias("snippet"))


_TALK = " OR ".join("regexp_matches(t, '{}')".format(p.replace("'", "''")) for p in T.CONVERSATIONAL)
_MADE = "concat('Hope this helps', chr(10), substring(text, 1, 80), chr(10), chr(10), chr(10), chr(10), 'To summarize: all', chr(10), 'Feel free to ask [p.3]', chr(10), substring(text, 81), chr(10), 'Let me know if you need', chr(10))"


@query(
    "f19_strip_conversational",
    rf"""WITH l AS (SELECT doc_id, unnest(generate_series(1, len(a))) AS i, unnest(a) AS l FROM (SELECT doc_id, string_split({_MADE}, chr(10)) AS a FROM documents)),
         t AS (SELECT doc_id, i, l, {_TRIM.format("l")} AS t FROM l),
         k AS (SELECT doc_id, string_agg(l, chr(10) ORDER BY i) AS s FROM t WHERE t = '' OR regexp_matches(t, '{CITE}') OR NOT ({_TALK}) GROUP BY doc_id)
         SELECT doc_id, {_TRIM.format("regexp_replace(s, '\n{3,}', chr(10) || chr(10), 'g')")} AS kept FROM k""",
)
def f19(spark, d):
    made = F.expr(_MADE.replace("chr(10)", "char(10)"))
    return documents(spark, d).select("doc_id", T.strip_conversational(made).alias("kept"))


@query(
    "f13_normalize_placement",
    """SELECT doc_id, concat('First ', source, '[p.1][p.2].', chr(10), chr(10), 'Next (x) [p.3] line[p.4]', chr(10), 'End') AS placed FROM documents""",
)
def f13(spark, d):
    c = F.concat(F.lit("First "), "source", F.lit(".\n- [p.1] [p.2]\n\nNext (x) ( [p.3] ) line\n  [p.4] .\nEnd"))
    return documents(spark, d).select("doc_id", T.normalize_placement(c).alias("placed"))


_HEADS = "concat(CASE doc_id % 5 WHEN 0 THEN 'Chapter ' || (doc_id % 40) || ' Start' WHEN 1 THEN '제' || (doc_id % 9) || '장 개요...' WHEN 2 THEN '3절' WHEN 3 THEN 'chapter 7 ..... 12' ELSE left(text, 30) END)"


@query(
    "f20_chapter_heading",
    rf"""SELECT doc_id, regexp_matches(h, '(?i)^(제?\d+[장절]|chapter\s*\d+|\d+장)') AND NOT regexp_matches(h, '[.·…]{{2,}}\s*\d+\s*$|\s{{3,}}\d+\s*$') AS heading,
         lower({_TRIM.format(r"regexp_replace(regexp_replace(h, '\s+', ' ', 'g'), '[.·:;,\-–—]+$', '')")}) AS key,
         coalesce(try_cast(nullif(regexp_extract(h, '^제?\s*(\d+)\s*([장절])', 1), '') AS BIGINT), try_cast(nullif(regexp_extract(h, '(?i)^chapter\s*(\d+)', 1), '') AS BIGINT)) AS num
         FROM (SELECT doc_id, {_HEADS} AS h FROM documents)""",
)
def f20(spark, d):
    df = documents(spark, d).withColumn("h", F.expr(_HEADS))
    key = T.heading_key(F.col("h"))
    return df.select("doc_id", T.is_heading(F.col("h")).alias("heading"), key["key"].alias("key"), key["num"].alias("num"))


@query("p6_toc_line", rf"SELECT doc_id, regexp_matches(h, '[.·…]{{2,}}\s*\d+\s*$|\s{{3,}}\d+\s*$') AS toc FROM (SELECT doc_id, {_HEADS} AS h FROM documents)")
def p6(spark, d):
    return documents(spark, d).select("doc_id", F.expr(_HEADS).rlike(T.TOC_LINE).alias("toc"))


_OCR = "concat('see https://a.example/x?y=', source, ' ', text)"


@query(
    "f23_ocr_text",
    rf"SELECT doc_id, CASE WHEN length(b) > 12000 THEN left(b, 12000) || '[...]' ELSE b END AS ocr FROM (SELECT doc_id, {_TRIM.format(rf"regexp_replace({_OCR}, 'https?://\S+', '', 'g')")} AS b FROM documents)",
)
def f23(spark, d):
    return documents(spark, d).select("doc_id", T.ocr_text(F.expr(_OCR)).alias("ocr"))


@query(
    "f25_image_mime",
    "SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'image/jpeg' WHEN 1 THEN 'image/gif' WHEN 2 THEN 'image/webp' ELSE 'image/png' END AS mime FROM documents",
)
def f25(spark, d):
    head = F.element_at(F.array(*map(F.lit, ("/9j/4A", "R0lGODlh", "UklGRx", "iVBOR"))), (F.col("doc_id") % 4 + 1).cast("int"))
    return documents(spark, d).select("doc_id", T.image_mime(F.concat(head, "text")).alias("mime"))


@query("f26_highlight", r"SELECT doc_id, regexp_replace(text, '(?i)the', '**\0**', 'g') AS marked FROM documents")
def f26(spark, d):
    return documents(spark, d).select("doc_id", T.highlight(F.col("text"), F.lit("THE")).alias("marked"))


@query(
    "f28_content_hash",
    "SELECT doc_id, sha256(text) AS text_hash, sha256(replace(text, chr(10), chr(12))) AS pages_hash FROM documents",
)
def f28(spark, d):
    return documents(spark, d).select("doc_id", T.content_hash(F.col("text")).alias("text_hash"), T.pages_hash(F.split("text", "\n")).alias("pages_hash"))


@query("a11_duplicate_groups", "SELECT sha256(text) AS doc_hash, count(*) AS copies, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1")
def a11(spark, d):
    return documents(spark, d).groupBy(T.content_hash(F.col("text")).alias("doc_hash")).agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_id")).where("copies > 1")


_CJK = "'[\\x{ac00}-\\x{d7af}\\x{3130}-\\x{318f}\\x{1100}-\\x{11ff}\\x{3040}-\\x{309f}\\x{30a0}-\\x{30ff}\\x{4e00}-\\x{9fff}]'"
_MIXED = "concat(repeat('한국어 日本 ', CAST(doc_id % 60 AS INT)), text)"
_EVEN = "concat(" + ", ".join(f"substring(t, (length(t) // 10) * {i} + 1, 200)" for i in range(10)) + ")"


@query(
    "a12_chars_per_token",
    f"SELECT doc_id, round(greatest(1.5, 4 - 2.5 * len(regexp_extract_all(s, {_CJK})) / greatest(length(s), 1)), 6) AS cpt FROM (SELECT doc_id, CASE WHEN length(t) <= 2000 THEN t ELSE {_EVEN} END AS s FROM (SELECT doc_id, {_MIXED} AS t FROM documents))",
)
def a12(spark, d):
    return documents(spark, d).select("doc_id", F.round(T.chars_per_token(F.expr(_MIXED)).cast("double"), 6).alias("cpt"))


def _est(c: str) -> str:
    cjk = f"len(regexp_extract_all({c}, {_CJK}))"
    return f"CAST(ceil({cjk} / 1.3::DOUBLE + (length({c}) - {cjk}) / 3.5::DOUBLE) AS BIGINT)"


@query("a13_token_estimate", f"SELECT doc_id, {_est('t')} AS tokens FROM (SELECT doc_id, {_MIXED} AS t FROM documents)")
def a13(spark, d):
    return documents(spark, d).select("doc_id", T.token_estimate(F.expr(_MIXED)).cast("long").alias("tokens"))


_NEED = f"CAST(ceil({_est('source')} * 1.15::DOUBLE + {_est('t')} * 1.15::DOUBLE + 2048) AS BIGINT)"


@query(
    "a14_context_bucket",
    f"""SELECT doc_id, need, CASE WHEN need <= 4096 THEN 4096 WHEN need <= 8192 THEN 8192 WHEN need <= 12288 THEN 12288 ELSE 16384 END AS bucket, need > 16384 AS overflow,
        greatest(1.0, CASE WHEN need <= 4096 THEN 4096 WHEN need <= 8192 THEN 8192 WHEN need <= 12288 THEN 12288 ELSE 16384 END / 4096.0)::DOUBLE AS timeout_scale
        FROM (SELECT doc_id, {_NEED} AS need FROM (SELECT doc_id, source, {_MIXED} AS t FROM documents))""",
)
def a14(spark, d):
    df = documents(spark, d).select("doc_id", T.context_need(F.col("source"), F.expr(_MIXED)).cast("long").alias("need"))
    bucket = T.context_bucket(F.col("need"))
    return df.select("doc_id", "need", bucket.alias("bucket"), (F.col("need") > T.CONTEXT_BUCKETS[-1]).alias("overflow"), F.greatest(F.lit(1.0), bucket / 4096).cast("double").alias("timeout_scale"))


@query(
    "p1_page_range",
    """WITH p AS (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents),
       r AS (SELECT doc_id, p, least(a, b) AS s, greatest(a, b) AS e FROM (SELECT doc_id, p, greatest(1, least(doc_id % 6, len(p))) AS a, greatest(1, least(3, len(p))) AS b FROM p))
       SELECT doc_id, s AS first, e AS last, coalesce(array_to_string(list_filter(p[s:e], lambda x: regexp_matches(x, '\\S')), chr(10) || chr(10)), '') AS text,
              CAST(len(p) AS BIGINT) AS n_pages FROM r""",
)
def p1(spark, d):
    df = documents(spark, d).select("doc_id", T.page_range(F.split("text", "\n"), F.col("doc_id") % 6, F.lit(3)).alias("r"))
    return df.select("doc_id", F.col("r.start").cast("long").alias("first"), F.col("r.end").cast("long").alias("last"), "r.text", F.size("r.pages").cast("long").alias("n_pages"))


@query(
    "p7_query_gates",
    "SELECT item_id, length(trim(q)) >= 2 AND length(q) <= 512 AS keyword_ok, length(trim(q)) BETWEEN 1 AND 1000 AS question_ok FROM (SELECT item_id, left(text, CAST(item_id % 3 AS INT)) || CASE WHEN item_id % 7 = 0 THEN text || text || text ELSE ' ' END AS q FROM benchmark)",
)
def p7(spark, d):
    q = F.concat(F.left("text", (F.col("item_id") % 3).cast("int")), F.when(F.col("item_id") % 7 == 0, F.concat("text", "text", "text")).otherwise(" "))
    df = table(spark, d, "benchmark").select("item_id", q.alias("q"))
    n = F.char_length(F.trim("q"))
    return df.select("item_id", ((n >= 2) & (F.char_length("q") <= 512)).alias("keyword_ok"), n.between(1, 1000).alias("question_ok"))


@query("p9_hash_predicate", "SELECT doc_id, regexp_matches(h, '^[a-f0-9]{64}$') AS ok FROM (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN upper(sha256(text)) WHEN doc_id % 3 = 1 THEN left(sha256(text), 63) ELSE sha256(text) END AS h FROM documents)")
def p9(spark, d):
    h = F.sha2("text", 256)
    h = F.when(F.col("doc_id") % 3 == 0, F.upper(h)).when(F.col("doc_id") % 3 == 1, F.left(h, F.lit(63))).otherwise(h)
    return documents(spark, d).select("doc_id", h.rlike("^[a-f0-9]{64}$").alias("ok"))


@query(
    "p12_image_enrichment",
    """WITH p AS (SELECT doc_id, unnest(generate_series(1, len(l))) AS page, unnest(l) AS t FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)),
       d AS (SELECT doc_id, doc_id % 3 + 1 AS page, source FROM documents)
       SELECT p.doc_id, p.page, t || coalesce(chr(10) || '[이미지 분석: ' || source || ']' || chr(10) || '[이미지 분석: second]', '') AS text FROM p LEFT JOIN d ON d.doc_id = p.doc_id AND d.page = p.page""",
)
def p12(spark, d):
    docs = documents(spark, d)
    pages = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "text")).withColumn("page", (F.col("i") + 1).cast("long")).drop("i")
    found = docs.select("doc_id", (F.col("doc_id") % 3 + 1).alias("page"), F.explode(F.array(F.struct(F.lit(0).alias("n"), F.col("source").alias("what")), F.struct(F.lit(1).alias("n"), F.lit("second").alias("what")))).alias("x"))
    note = lambda x: F.concat(F.lit("\n[이미지 분석: "), x["what"], F.lit("]"))
    notes = found.groupBy("doc_id", "page").agg(F.array_join(F.transform(F.sort_array(F.collect_list("x")), note), "").alias("notes"))
    return pages.join(notes, ["doc_id", "page"], "left").select("doc_id", "page", F.concat("text", F.coalesce("notes", F.lit(""))).alias("text"))
