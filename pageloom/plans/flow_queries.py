"""Queries of whole flows, exports and cleaning, with SQL where DuckDB can say it."""

from __future__ import annotations

from pyspark.sql import functions as F

from pageloom import settings
from pageloom.functions import prompts as P
from pageloom.functions import sanitize as Z
from pageloom.operators import chunk as C
from pageloom.operators import flow, qa
from pageloom.operators import summary as S
from pageloom.operators import vectors as V
from pageloom.plans.registry import query, table
from pageloom.sources import export


def documents(spark, d):
    return table(spark, d, "documents").select("doc_id", "text", "lang", "source", "n_chars")


@query(
    "c5_documents",
    """WITH e AS (SELECT doc_id, source, string_split(text, chr(10)) AS p FROM documents),
    k AS (SELECT doc_id, len(p) AS n, p, list_filter([{'title': 'One', 'start': 0}, {'title': 'Two ' || source, 'start': 1}, {'title': 'Five', 'start': 2}, {'title': 'Six', 'start': len(p) - 1}],
          lambda b, i: CASE i WHEN 1 THEN TRUE WHEN 2 THEN len(p) >= 2 WHEN 3 THEN len(p) >= 3 ELSE len(p) >= 4 END) AS b FROM e),
    r AS (SELECT doc_id, n, p, b, unnest(range(1, len(b) + 1)) AS i FROM k)
    SELECT doc_id, n AS page_count, i - 1 AS index, b[i].title AS title, CAST(b[i].start + 1 AS BIGINT) AS start_page, CAST(coalesce(b[i + 1].start, n) AS BIGINT) AS end_page,
           array_to_string(p[b[i].start + 1:coalesce(b[i + 1].start, n)], chr(10) || chr(10)) AS text FROM r""",
)
def c5(spark, d):
    section = lambda t, u: F.struct(t.alias("title"), F.lit(u).alias("unit"))
    two = F.concat(F.lit("Two "), "source")
    sections = F.array(section(F.lit("One"), 0), section(F.concat(F.lit(" "), two, F.lit(" ")), 1), section(two, 2), section(F.lit(""), 3), section(F.lit("Five"), 2), section(F.lit("Six"), 900000))
    none = "array<struct<level:int,title:string,unit:int>>"
    files = documents(spark, d).select("doc_id", F.split("text", "\n").alias("units"), sections.alias("sections"), F.array().cast(none).alias("headings"), F.array(F.struct(F.lit(7).alias("unit"))).alias("images"))
    made = flow.documents(files, "doc_id")
    return made.select("doc_id", "page_count", F.inline("chapters")).select("doc_id", "page_count", F.col("index").cast("long").alias("index"), "title", F.col("start_page").cast("long").alias("start_page"), F.col("end_page").cast("long").alias("end_page"), "text")


@query(
    "j5_citation_targets",
    """WITH t AS (SELECT doc_id // 20 AS lib, doc_id AS tab_id, source || CASE WHEN doc_id % 20 < 3 THEN '' ELSE ' ' || (doc_id % 20) END AS label, n_chars AS page_count, doc_id % 20 = 0 AS active FROM documents),
    c AS (SELECT doc_id // 20 AS lib, doc_id, CASE WHEN doc_id % 3 = 0 THEN NULL WHEN doc_id % 3 = 1 THEN source || CASE WHEN doc_id % 20 < 3 THEN '' ELSE ' ' || (doc_id % 20) END ELSE 'gone.pdf' END AS doc_name, doc_id % 2000 AS page FROM documents),
    n AS (SELECT lib, label, count(*) AS n, max(tab_id) AS tab_id, max_by(page_count, tab_id) AS page_count FROM t GROUP BY 1, 2),
    a AS (SELECT lib, tab_id AS own, page_count AS own_count, label AS own_label FROM t WHERE active),
    j AS (SELECT c.*, n.n, own, own_count, n.tab_id, n.page_count, doc_name IS NOT NULL AND doc_name IS DISTINCT FROM own_label AS far FROM c LEFT JOIN n ON n.lib = c.lib AND n.label = c.doc_name LEFT JOIN a ON a.lib = c.lib),
    s AS (SELECT *, CASE WHEN n > 1 THEN 'ambiguous' WHEN far AND n IS NULL THEN 'closed' WHEN NOT coalesce(page BETWEEN 1 AND CASE WHEN far THEN page_count ELSE own_count END, FALSE) THEN 'invalid' ELSE 'open' END AS state FROM j)
    SELECT doc_id, CASE WHEN state = 'open' THEN CASE WHEN far THEN tab_id ELSE own END END AS tab_id, CASE WHEN state = 'open' THEN page END AS target_page, state FROM s""",
)
def j5(spark, d):
    k, lib = F.col("doc_id"), F.floor(F.col("doc_id") / 20).alias("lib")
    tail = F.when(k % 20 < 3, F.lit("")).otherwise(F.concat(F.lit(" "), (k % 20).cast("string")))
    tabs = documents(spark, d).select(lib, k.alias("tab_id"), F.concat(F.lit("["), "source", F.lit("|"), tail, F.lit("]")).alias("file_name"), F.col("n_chars").alias("page_count"), (k % 20 == 0).alias("active"))
    name = F.when(k % 3 == 0, F.lit(None)).when(k % 3 == 1, F.concat("source", tail)).otherwise("gone.pdf")
    cites = documents(spark, d).select(lib, "doc_id", name.alias("doc_name"), (k % 2000).alias("page"))
    return flow.citation_targets(cites, tabs, "lib").select("doc_id", "tab_id", "target_page", "state")


_ESC = "replace(replace(replace(replace(replace({0}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), chr(39), '&#39;')"


@query(
    "s29_html_page",
    f"""WITH l AS (SELECT doc_id, source, lang, unnest(generate_series(1, len(p))) AS i, unnest(p) AS t FROM (SELECT doc_id, source, lang, string_split(text, chr(10)) AS p FROM documents)),
    w AS (SELECT doc_id, i, regexp_replace('x ' || translate(t, '*`~', ''), '\\s+$', '') AS t FROM l),
    b AS (SELECT doc_id, string_agg('<h2>Line ' || i || '</h2>' || chr(10) || '<p>' || {_ESC.format("t")} || '</p>', chr(10) ORDER BY i) AS body FROM w GROUP BY 1)
    SELECT doc_id, '<!DOCTYPE html><html lang="' || CASE WHEN regexp_matches(lang, '^[a-z][a-z]$') THEN lang ELSE 'ko' END || '"><head><meta charset="utf-8"><meta http-equiv="Content-Security-Policy" content="{export.POLICY.replace("'", "''")}"><title>'
           || {_ESC.format("'A & ' || source")} || '</title><style>{export.STYLE}</style></head><body><main class="doc">' || body || '</main></body></html>' AS page FROM documents JOIN b USING (doc_id)""",
)
def s29(spark, d):
    lines = F.transform(F.split("text", "\n"), lambda t, i: F.concat(F.lit("## Line "), (i + 1).cast("string"), F.lit("\nx "), F.translate(t, "*`~", "")))
    df = documents(spark, d).withColumn("md", F.array_join(lines, "\n\n"))
    return df.select("doc_id", export.html_page(F.col("md"), F.concat(F.lit("A & "), "source"), F.col("lang")).alias("page"))


@query(
    "c20_enriched_pages",
    """WITH p AS (SELECT doc_id AS key, unnest(generate_series(1, len(l))) AS page, unnest(l) AS t, source FROM (SELECT doc_id, source, string_split(text, chr(10)) AS l FROM documents))
    SELECT key, page, t || CASE WHEN key % 4 = 3 THEN '' WHEN page = 1 THEN chr(10) || '[이미지 분석: picture ' || source || ' 0]' || CASE WHEN key % 4 <> 1 THEN chr(10) || '[이미지 분석: picture ' || source || ' 1]' ELSE '' END
           WHEN page = 2 THEN chr(10) || '[이미지 분석: picture ' || source || ' 2]' ELSE '' END AS text FROM p""",
)
def c20(spark, d):
    docs = documents(spark, d).withColumnRenamed("doc_id", "key")
    # of every fourth document the first picture fails, of others the second
    made = F.transform(F.sequence(F.lit(0), F.lit(2)), lambda i: F.struct(F.when(i < 2, 1).otherwise(2).cast("long").alias("page"), i.alias("pos"), F.concat(F.when(((F.col("key") % 4 == 3) & (i == 0)) | ((F.col("key") % 4 == 1) & (i == 1)), F.lit("bad ")).otherwise("picture "), "source", F.lit(" "), i.cast("string")).cast("binary").alias("data")))
    images = docs.select("key", F.inline(made))
    pages = docs.select("key", F.posexplode(F.split("text", "\n")).alias("i", "text")).select("key", (F.col("i") + 1).cast("long").alias("page"), "text")
    return flow.enriched_pages(pages, flow.described(images, _Echo()), ["key"])


class _Echo:
    """A describer that says what the bytes say, and fails at bad ones."""

    def describe(self, images: list[bytes]) -> list[str | None]:
        return [None if x.startswith(b"bad") else x.decode() for x in images]


@query(
    "f24_xml_text",
    """SELECT doc_id, '<' || source || '>&amp;lt; 가' || '&#xZZ;' || t || ' "' AS text, t AS kept FROM (SELECT doc_id, source, regexp_replace(translate(text, '<>&', ''), '[\\x{E000}-\\x{F8FF}\\x{F0000}-\\x{10FFFF}]', '', 'g') AS t FROM documents)""",
)
def f24(spark, d):
    bare = F.translate("text", "<>&", "")
    xml = F.concat(F.lit("<a b='1'>&lt;"), "source", F.lit("&gt;&amp;amp;lt; &#xAC00;&#xZZ;<!-- <x> --><![CDATA[no]]>"), bare, F.lit("</a> &#34;<!-- open"))
    return documents(spark, d).select("doc_id", Z.xml_text(xml).alias("text"), Z.without_private_use(bare).alias("kept"))


@query(
    "f29_error_text",
    """SELECT doc_id, 'at ~ and <share> or <system> ' || source AS path, 'Bearer [REDACTED] ' || source || ' sk-ant-[REDACTED] AIza[REDACTED]' AS body FROM documents""",
)
def f29(spark, d):
    digest = F.sha2("text", 256)
    path = F.concat(F.lit("at /home/"), "source", F.lit("/a/b.txt and \\\\server\\share\\"), digest, F.lit(" or /etc/"), digest, F.lit(" "), "source")
    body = F.concat(F.lit("bearer "), digest, F.lit(" "), "source", F.lit(" sk-ant-"), digest, F.lit(" AIza"), digest)
    return documents(spark, d).select("doc_id", Z.error_path(path).alias("path"), Z.error_body(body).alias("body"))


@query("s30_settings", "SELECT * FROM (VALUES ('maxChunkSize', '4000'), ('theme', '\"dark\"'), ('ollamaBaseUrl', '\"http://localhost:11434\"')) AS t(name, value)")
def s30(spark, d):
    import json

    given = {"maxChunkSize": 4000, "theme": "dark", "uiLanguage": "fr", "model": "", "persistSessions": 1, "ollamaBaseUrl": "http://localhost:11434", "unknown": True}
    return spark.createDataFrame([(k, json.dumps(v)) for k, v in settings.cleaned(given).items()], "name string, value string")


def _index(spark, d, embedder):
    pages = documents(spark, d).select(F.col("doc_id").alias("doc_hash"), F.split("text", "\n").alias("page_texts"))
    return V.embedded(C.overlap_chunks_of(pages, max_tokens=200), embedder)


@query("c12_ask")
def c12(spark, d):
    embedder = V.HashingEmbedder()
    # every third document has no index and is searched by keyword
    chunks = _index(spark, d, embedder).where(F.col("doc_hash") % 3 != 0)
    docs = documents(spark, d).select(F.col("doc_id").alias("doc_hash"), F.col("source").alias("file_name"), F.split("text", "\n").alias("page_texts"), "text", S.leading(F.col("text")).alias("summary"))
    return flow.ask(docs, chunks, "What did the other one say of it?", embedder, S.FirstSentences(3))


@query("c13_verified")
def c13(spark, d):
    embedder = V.HashingEmbedder()
    answers = documents(spark, d).where("doc_id % 50 = 0").select("doc_id", F.col("text").alias("answer"))
    return flow.verified(answers, _index(spark, d, embedder), embedder, "doc_id")


@query(
    "c12_question_prompt",
    """SELECT item_id, '[요약 내용]' || chr(10) || left(text, 3000) || chr(10) || chr(10) || CASE WHEN item_id % 2 = 0 THEN '[원문 관련 부분]' || chr(10) || 'x' || chr(10) || chr(10) ELSE '' END || chr(10) || '[질문]' || chr(10) || text AS prompt FROM benchmark""",
)
def c12_prompt(spark, d):
    p = qa.question_prompt(F.col("text"), F.when(F.col("item_id") % 2 == 0, "x"), F.lit(None).cast("string"), F.col("text"))
    return table(spark, d, "benchmark").select("item_id", p.alias("prompt"))


@query(
    "f27_split_prompt",
    "SELECT item_id, CASE WHEN item_id % 2 = 0 THEN regexp_replace(text, '^\\s+|\\s+$', '', 'g') ELSE '' END AS system, CASE WHEN item_id % 2 = 0 THEN 'q' || item_id || '---' || chr(10) || chr(10) || 'x' ELSE text END AS user FROM benchmark",
)
def f27(spark, d):
    p = F.when(F.col("item_id") % 2 == 0, F.concat("text", F.lit("\n---\n\nq"), F.col("item_id").cast("string"), F.lit("---\n\nx \n"))).otherwise(F.col("text"))
    parts = qa.split_prompt(p)
    return table(spark, d, "benchmark").select("item_id", parts["system"].alias("system"), parts["user"].alias("user"))


def _values(rows) -> str:
    """Rows of texts as SQL values."""
    return ", ".join("(" + ", ".join("'" + x.replace("'", "''") + "'" for x in row) + ")" for row in rows)


# a template with its text, then the rule put before the first separator
@query(
    "f27_build_prompt",
    f"""WITH t(lang, kind, template) AS (VALUES {_values((lang, kind, t) for (lang, kind), t in P.TEMPLATES.items())}), r(lang, rule) AS (VALUES {_values(P.CITATION_RULES.items())}),
    d AS (SELECT doc_id, text, source, ['full', 'chapter', 'keywords', 'qa', 'custom'][doc_id % 5 + 1] AS kind, ['ko', 'en', 'ja', 'zh', 'auto', 'fr', NULL][doc_id % 7 + 1] AS lang, CASE WHEN doc_id % 2 = 0 THEN source END AS own FROM documents),
    k AS (SELECT *, CASE WHEN lang IN ('ko', 'en', 'ja', 'zh', 'auto') THEN lang ELSE 'ko' END AS known FROM d),
    w AS (SELECT doc_id, k.kind, coalesce(k.lang, '') AS lang, CASE WHEN k.kind = 'custom' THEN own ELSE t.template END || chr(10) || chr(10) || '---' || chr(10) || chr(10) || text AS raw, rule FROM k LEFT JOIN t ON t.lang = known AND t.kind = k.kind JOIN r ON r.lang = known),
    x AS (SELECT *, position(chr(10) || chr(10) || '---' || chr(10) || chr(10) IN raw) AS split FROM w)
    SELECT doc_id, kind, lang, CASE WHEN kind = 'keywords' THEN raw ELSE left(raw, split - 1) || chr(10) || chr(10) || rule || substring(raw, split) END AS prompt FROM x""",
)
def f27_build(spark, d):
    k = F.col("doc_id")
    kind = F.get(F.array(*map(F.lit, (*P.KINDS, "custom"))), k % 5)
    lang = F.get(F.array(*map(F.lit, ("ko", "en", "ja", "zh", "auto", "fr", None))), k % 7)
    own = F.when(k % 2 == 0, F.concat(F.lit(" \n"), "source", F.lit(" "))).otherwise("  ")
    return documents(spark, d).select("doc_id", kind.alias("kind"), F.coalesce(lang, F.lit("")).alias("lang"), P.build_prompt(F.col("text"), kind, lang, own).alias("prompt"))
