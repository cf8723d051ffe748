"""Queries of summaries, layout, tables, trees and request streams in batch form."""

from __future__ import annotations

from pyspark.sql import functions as F

from pageloom.functions import text as T
from pageloom.functions.prompts import CITATION_RULES, TEMPLATES
from pageloom.operators import chunk as C
from pageloom.operators import layout as L
from pageloom.operators import summary as S
from pageloom.plans.registry import query, table
from pageloom.plans.text_queries import BARE, SANITIZED
from pageloom.sources import formats
from pageloom.streaming import requests as R


def documents(spark, d):
    return table(spark, d, "documents").select("doc_id", "text", "source", "n_chars")


def paged(spark, d):
    return documents(spark, d).withColumn("pages", F.split("text", "\n"))


# ---- summaries

_LEAD = r"regexp_replace(array_to_string(regexp_split_to_array(replace({0}, chr(10), ' '), '\. ')[1:2], ' '), '^\s+|\s+$', '', 'g')"


@query("v6_leading_sentences", f"SELECT doc_id, {_LEAD.format('text')} AS summary FROM documents")
def leading(spark, d):
    return documents(spark, d).select("doc_id", S.leading(F.col("text")).alias("summary"))


@query(
    "w9_fair_truncation",
    r"""WITH l AS (SELECT doc_id, unnest(generate_series(1, len(p))) AS i, unnest(p) AS t, len(p) AS n, greatest(600 - 2 * (len(p) - 1), 0) AS r FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents)),
    o AS (SELECT *, row_number() OVER w AS k, coalesce(sum(length(t)) OVER (PARTITION BY doc_id ORDER BY length(t), i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM l WINDOW w AS (PARTITION BY doc_id ORDER BY length(t), i)),
    s AS (SELECT *, length(t) <= floor((r - before) / (n - k + 1)) AS fits FROM o),
    g AS (SELECT *, min(CASE WHEN fits THEN NULL ELSE k END) OVER (PARTITION BY doc_id) AS stop FROM s),
    h AS (SELECT *, min(CASE WHEN k = stop THEN floor((r - before) / (n - k + 1)) END) OVER (PARTITION BY doc_id) AS share FROM g)
    SELECT doc_id, i, CAST(CASE WHEN stop IS NULL OR k < stop THEN length(t) ELSE least(length(t), share) END AS BIGINT) AS allotted FROM h""",
)
def w9(spark, d):
    df = paged(spark, d)
    shares = S.fair_shares(F.col("pages"), F.greatest(600 - 2 * (F.size("pages") - 1), F.lit(0)))
    return df.select("doc_id", F.posexplode(shares).alias("i", "allotted")).select("doc_id", (F.col("i") + 1).cast("long").alias("i"), F.col("allotted").cast("long").alias("allotted"))


# labelled paragraphs of lines as pages (v, t), then chunks as C1 packs them (one row each: doc_id, k, c)
_LABELLED = r"""p AS (SELECT doc_id, unnest(generate_series(1, len(l))) AS page, unnest(l) AS t FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)),
    u AS (SELECT doc_id, page, regexp_replace(t, '^\s+|\s+$', '', 'g') AS t FROM p WHERE regexp_matches(t, '\S')),
    v AS (SELECT doc_id, '[p.' || page || '] ' || substring(t, k * 1500 + 1, 1500) AS t, row_number() OVER (PARTITION BY doc_id ORDER BY page, k) AS i FROM (SELECT *, unnest(range(0, (length(t) - 1) // 1500 + 1)) AS k FROM u)),
    t AS (SELECT doc_id, string_agg(t, chr(10) || chr(10) ORDER BY i) AS t FROM v GROUP BY 1)"""


def cpt_sql(t: str) -> str:
    even = "concat(" + ", ".join(f"substring({t}, (length({t}) // 10) * {i} + 1, 200)" for i in range(10)) + ")"
    cjk = "'[\\x{ac00}-\\x{d7af}\\x{3130}-\\x{318f}\\x{1100}-\\x{11ff}\\x{3040}-\\x{309f}\\x{30a0}-\\x{30ff}\\x{4e00}-\\x{9fff}]'"
    sample = f"CASE WHEN length({t}) <= 2000 THEN {t} ELSE {even} END"
    return f"greatest(1.5::DOUBLE, 4 - 2.5::DOUBLE * len(regexp_extract_all({sample}, {cjk})) / greatest(length({sample}), 1))"


def chunks_sql(tokens: int | str) -> str:
    """Rows doc_id, k, c: whole paragraphs while they fit, each chunk over the limit cut at it."""
    return rf"""z AS (SELECT doc_id, t, greatest(100, CAST(floor({tokens} * {cpt_sql("t")}) AS BIGINT)) AS most FROM t),
    n AS (SELECT v.doc_id, v.i, length(v.t) AS n, most FROM v JOIN z ON z.doc_id = v.doc_id),
    f AS (SELECT doc_id, i, n AS len, 1::BIGINT AS g FROM n WHERE i = 1 UNION ALL
          SELECT n.doc_id, n.i, CASE WHEN f.len + 2 + n.n > most THEN n.n ELSE f.len + 2 + n.n END, f.g + CASE WHEN f.len + 2 + n.n > most THEN 1 ELSE 0 END FROM f JOIN n ON n.doc_id = f.doc_id AND n.i = f.i + 1),
    w AS (SELECT f.doc_id, g, any_value(most) AS most, regexp_replace(string_agg(v.t, chr(10) || chr(10) ORDER BY f.i), '^\s+|\s+$', '', 'g') AS c FROM f JOIN v ON v.doc_id = f.doc_id AND v.i = f.i JOIN z ON z.doc_id = f.doc_id GROUP BY 1, 2),
    x AS (SELECT doc_id, g, j, substring(c, j * most + 1, most) AS c FROM (SELECT *, unnest(range(0, (length(c) - 1) // most + 1)) AS j FROM w)),
    c AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY g, j) AS k, c FROM x)"""


def _fair_sql(budget: str, note: str) -> str:
    """Of rows m (doc_id, k, s): joined, or cut to fair shares of budget (over q.joined) with a note: doc_id, joined."""
    return rf"""q AS (SELECT doc_id, count(*) AS n, string_agg(s, chr(10) || chr(10) ORDER BY k) AS joined, string_agg(s, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY k) AS partial FROM m GROUP BY 1),
    b AS (SELECT *, {budget} AS most, greatest({budget} - 2 * (n - 1), 0) AS r FROM q),
    o AS (SELECT m.doc_id, k, s, r, n, row_number() OVER y AS rank, coalesce(sum(length(s)) OVER (PARTITION BY m.doc_id ORDER BY length(s), k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM m JOIN b ON b.doc_id = m.doc_id WINDOW y AS (PARTITION BY m.doc_id ORDER BY length(s), k)),
    e AS (SELECT *, CASE WHEN length(s) > floor((r - before) / (n - rank + 1)) THEN CAST(floor((r - before) / (n - rank + 1)) AS BIGINT) END AS over_ FROM o),
    h AS (SELECT *, first_value(over_ IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS share FROM e),
    a AS (SELECT doc_id, string_agg(CASE WHEN length(s) > share THEN regexp_replace(regexp_replace(left(s, share), '\[[^\]
]{{0,130}}$', ''), '\s+$', '') || '…' ELSE s END, chr(10) || chr(10) ORDER BY k) || chr(10) || chr(10) || '{note}' AS cut FROM h GROUP BY 1),
    g2 AS (SELECT b.doc_id, n, partial, CASE WHEN length(joined) <= most THEN joined ELSE cut END AS joined FROM b JOIN a ON a.doc_id = b.doc_id)"""


def _whole_sql(prompt: str, language: str) -> str:
    made = _LEAD.format(f"'{prompt}' || chr(10) || chr(10) || joined")
    return f"partial || CASE WHEN n > 1 THEN chr(10) || chr(10) || '---' || chr(10) || chr(10) || '## {S.INTEGRATION[language][0]}' || chr(10) || chr(10) || {made} ELSE '' END"


@query(
    "c15_full_summary_one_chunk",
    f"WITH {_LABELLED} SELECT doc_id, CAST(1 AS BIGINT) AS n_chunks, {_LEAD.format('t')} AS summary FROM t",
)
def c15(spark, d):
    # a call that takes any of the documents whole
    return S.full_summary(paged(spark, d), "doc_id", "pages", max_tokens=100000).select("doc_id", "n_chunks", "summary")


_C15_BUDGET = f"CAST(floor(200 * {cpt_sql('joined')}) AS BIGINT)"


@query(
    "c15_full_summary",
    f"""WITH RECURSIVE {_LABELLED}, {chunks_sql(200)}, m AS (SELECT doc_id, k, {_LEAD.format("c")} AS s FROM c), {_fair_sql(_C15_BUDGET, S.INTEGRATION["en"][2])}
    SELECT doc_id, n AS n_chunks, partial, {_whole_sql(S.INTEGRATION["en"][1], "en")} AS summary FROM g2""",
)
def c15b(spark, d):
    return S.full_summary(paged(spark, d), "doc_id", "pages", max_tokens=200, language="en")


@query(
    "w9_truncated_summaries",
    f"""WITH m AS (SELECT doc_id, unnest(range(0, len(p))) AS k, unnest(p) AS s FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents)), {_fair_sql("600", S.TRUNCATED)}
    SELECT doc_id, joined FROM g2""",
)
def w9b(spark, d):
    return paged(spark, d).select("doc_id", S.truncated_summaries(F.col("pages"), 600).alias("joined"))


# texts without headings: chapters are ranges of ten pages, each with a number of its own made of document and chapter
_CHAPTERS = r"""p AS (SELECT doc_id, unnest(generate_series(1, len(l))) AS page, unnest(l) AS t FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)),
    u AS (SELECT doc_id, page, regexp_replace(t, '^\s+|\s+$', '', 'g') AS t FROM p WHERE regexp_matches(t, '\S')),
    v AS (SELECT doc_id * 100000 + (page - 1) // 10 AS doc_id, '[p.' || page || '] ' || substring(t, k * 1500 + 1, 1500) AS t, row_number() OVER (PARTITION BY doc_id, (page - 1) // 10 ORDER BY page, k) AS i FROM (SELECT *, unnest(range(0, (length(t) - 1) // 1500 + 1)) AS k FROM u)),
    t AS (SELECT doc_id, string_agg(t, chr(10) || chr(10) ORDER BY i) AS t FROM v GROUP BY 1)"""


@query(
    "c16_chapter_summary",
    f"""WITH RECURSIVE {_CHAPTERS}, {chunks_sql(4000)},
    m AS (SELECT doc_id // 100000 AS doc_id, doc_id % 100000 AS ch, string_agg({_LEAD.format("c")}, chr(10) || chr(10) ORDER BY k) AS body FROM c GROUP BY ALL),
    d AS (SELECT doc_id, len(string_split(text, chr(10))) AS n FROM documents)
    SELECT doc_id, coalesce(string_agg('## Pages ' || (ch * 10 + 1) || '-' || least(ch * 10 + 10, n) || chr(10) || chr(10) || body, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY ch) FILTER (regexp_matches(body, '\\S')), '') AS summary
    FROM d LEFT JOIN m USING (doc_id) GROUP BY doc_id""",
)
def c16(spark, d):
    df = paged(spark, d).withColumn("s", C.chapter_starts(F.col("pages")))
    return S.chapter_summary(df.withColumn("chapters", C.detect_chapters(F.col("pages"), F.col("s"))), "doc_id", "chapters", "pages")


_C17 = r"CASE WHEN length(t) > 16000 THEN regexp_replace(left(t, 16000), '\[[^\]\n]{0,130}$', '') || chr(10) || chr(10) || '[...]' ELSE t END"


@query("c17_custom_single", f"""WITH {_LABELLED} SELECT doc_id, length(t) > 16000 AS cut, {_LEAD.format(f"'List the dates. Be brief' || chr(10) || chr(10) || {_C17}")} AS summary FROM t""")
def c17(spark, d):
    return S.custom_summary(paged(spark, d), "doc_id", "pages", "List the dates. Be brief", chunked=False)


@query(
    "c17_custom_chunked",
    f"""WITH RECURSIVE {_LABELLED}, {chunks_sql(100)}, m AS (SELECT doc_id, k, {_LEAD.format("'List the dates' || chr(10) || chr(10) || c")} AS s FROM c), {_fair_sql(_C15_BUDGET.replace("200", "100"), S.INTEGRATION["ja"][2])}
    SELECT doc_id, FALSE AS cut, {_whole_sql("List the dates", "ja")} AS summary FROM g2""",
)
def c17b(spark, d):
    return S.custom_summary(paged(spark, d), "doc_id", "pages", "List the dates", chunked=True, max_tokens=100, language="ja")


@query("c18_finalized", "SELECT doc_id, concat('Sum of ', source, '[p.1].', chr(10), chr(10), 'pages 2-4', chr(10), chr(10), 'cut') AS final FROM documents")
def c18(spark, d):
    made = F.concat(F.lit("Hope this helps\nSum of "), "source", F.lit(".\n[p.1]\n"))
    return documents(spark, d).select("doc_id", S.finalized(made, F.array(F.lit("pages 2-4"), F.lit(None), F.lit("cut"))).alias("final"))


_ASKED = "\n\n".join([TEMPLATES["en", "full"], CITATION_RULES["en"], "---", ""])


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def members(spark, d):
    k = F.col("doc_id")
    return paged(spark, d).select(F.floor(k / 12).alias("collection_id"), (k % 12).alias("pos"), F.concat("source", F.lit(".pdf")).alias("file_name"), F.when(k % 3 == 0, F.concat(F.left("text", F.lit(3500)), F.lit(" [p.2]"))).alias("summary"), F.when(k % 3 == 1, F.col("pages")).alias("page_texts"), "text")


_CUT = "regexp_replace({0}, '\\[[^\\]\\n]{{0,130}}$', '')"
# members in order, each taking its part of 12,000 characters
_MEMBER_BLOCKS = rf"""{_LABELLED},
    m AS (SELECT doc_id // 12 AS c, doc_id % 12 AS pos, source || '.pdf' AS file, CASE doc_id % 3 WHEN 0 THEN left(left(text, 3500) || ' [p.2]', 3000) WHEN 1 THEN left(coalesce(t.t, text), 1500) ELSE left(text, 1500) END AS raw,
          CASE doc_id % 3 WHEN 0 THEN text IS NOT NULL WHEN 1 THEN t.t IS NOT NULL ELSE FALSE END AS citable, row_number() OVER (PARTITION BY doc_id // 12 ORDER BY doc_id) AS i FROM documents LEFT JOIN t USING (doc_id)),
    f AS (SELECT DISTINCT c, 0::BIGINT AS i, 12000::BIGINT AS rest, NULL::BIGINT AS pos, NULL::VARCHAR AS file, NULL::VARCHAR AS content, NULL::BOOLEAN AS citable FROM m UNION ALL
          SELECT c, i, CASE WHEN taken THEN rest - length(k) ELSE rest END, pos, file, CASE WHEN taken THEN k END, citable FROM (
              SELECT *, rest >= 200 AND regexp_matches(raw, '\S') AND regexp_matches(k, '\S') AS taken FROM (
                  SELECT *, CASE WHEN length(named) > rest THEN {_CUT.format("left(named, rest)")} ELSE named END AS k FROM (
                      SELECT m.c, m.i, f.rest, m.pos, m.file, coalesce(m.raw, '') AS raw, m.citable, regexp_replace({_CUT.format("left(coalesce(m.raw, ''), f.rest)")}, '{BARE}', '[' || m.file || ' p.\1]', 'g') AS named
                      FROM f JOIN m ON m.c = f.c AND m.i = f.i + 1 WHERE m.i <= 10)))),
    b AS (SELECT c AS collection_id, pos, file AS file_name, content, citable AS page_citable FROM f WHERE content IS NOT NULL)"""


@query("c19_w8_collection_blocks", f"WITH RECURSIVE {_MEMBER_BLOCKS} SELECT * FROM b")
def c19(spark, d):
    return S.collection_blocks(members(spark, d))


@query(
    "w8_block_budget",
    """WITH RECURSIVE m AS (SELECT doc_id // 12 AS collection_id, doc_id % 12 AS pos, least(length(text), 1500) AS n FROM documents), s AS (SELECT *, row_number() OVER (PARTITION BY collection_id ORDER BY pos) AS i FROM m),
    f AS (SELECT DISTINCT collection_id, 0::BIGINT AS i, 5000::BIGINT AS rest, NULL::BIGINT AS pos, 0::BIGINT AS chars FROM m UNION ALL
          SELECT s.collection_id, s.i, CASE WHEN rest < 200 THEN rest ELSE rest - least(n, rest) END, s.pos, CASE WHEN rest < 200 THEN 0 ELSE least(n, rest) END FROM f JOIN s ON s.collection_id = f.collection_id AND s.i = f.i + 1 WHERE s.i <= 10)
    SELECT collection_id, pos, chars FROM f WHERE chars > 0""",
)
def w8(spark, d):
    plain = members(spark, d).withColumns({"summary": F.lit(None).cast("string"), "page_texts": F.lit(None).cast("array<string>")})
    return S.collection_blocks(plain, 5000).select("collection_id", "pos", F.char_length("content").cast("long").alias("chars"))


@query(
    "c19_collection_prompt",
    rf"""WITH RECURSIVE {_MEMBER_BLOCKS}
    SELECT collection_id, {_quoted(S.COMPARISON)} || chr(10) || chr(10) || string_agg('## ' || file_name || CASE WHEN page_citable THEN '' ELSE chr(10) || replace({_quoted(S.NO_PAGES)}, '{{name}}', file_name) END || chr(10) ||
        regexp_replace({SANITIZED.format("content")}, '(?m)^(\s*)(#{{1,6}})', '\1\\\2', 'g'), chr(10) || chr(10) ORDER BY pos) AS prompt FROM b GROUP BY 1""",
)
def c19b(spark, d):
    return S.collection_prompt(S.collection_blocks(members(spark, d)), comparison=True)


# the generator gives back the whole prompt on one line, without full stops, so the rows show what was asked and what is kept
@query(
    "c19_inline_summaries",
    f"""WITH {_LABELLED}, m AS (SELECT doc_id, text, CASE WHEN doc_id % 3 = 0 THEN left(text, 3500) || ' [p.2]' END AS stored, CASE WHEN doc_id % 3 = 1 THEN coalesce(t.t, text) ELSE text END AS source,
           row_number() OVER (PARTITION BY doc_id // 12 ORDER BY doc_id) AS n, doc_id % 3 = 1 AND t.t IS NOT NULL AS labelled FROM documents LEFT JOIN t USING (doc_id)),
    g AS (SELECT *, CASE WHEN stored IS NULL AND n <= 10 AND regexp_matches(source, '\\S') THEN regexp_replace(replace(replace({_quoted(_ASKED)} || left(source, 6000), chr(10), ' '), '. ', ' '), '^\\s+|\\s+$', '', 'g') END AS made FROM m)
    SELECT doc_id, coalesce(stored, made) AS summary, made IS NOT NULL AND NOT labelled AS unlabelled, made || CASE WHEN length(source) > 6000 THEN chr(10) || chr(10) || {_quoted(S.INPUT_CUT["en"])} ELSE '' END AS saved FROM g""",
)
def c19c(spark, d):
    made = S.inline_summaries(members(spark, d).withColumn("doc_id", F.col("collection_id") * 12 + F.col("pos")), S.FirstSentences(10**9), language="en")
    return made.select("doc_id", "summary", "unlabelled", "saved")


# ---- layout

_BLOCKS = "string_split(text, chr(10))"


@query(
    "w5_paginate",
    """WITH RECURSIVE l AS (SELECT doc_id, unnest(generate_series(1, len(p))) AS i, unnest(p) AS t FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents)),
    b AS (SELECT doc_id, i, length(regexp_replace(t, '^\\s+|\\s+$', '', 'g')) AS n, i % 7 = 0 AS brk FROM l),
    f AS (SELECT DISTINCT doc_id, 0::BIGINT AS i, 0::BIGINT AS len, 0::BIGINT AS units, 0::BIGINT AS of FROM b UNION ALL
      SELECT b.doc_id, b.i, CASE WHEN cut THEN n ELSE len + n END, CASE WHEN cut AND len > 0 THEN units + 1 ELSE units END, CASE WHEN cut AND len > 0 THEN units + 1 ELSE units END
      FROM (SELECT f.len, f.units, b.*, b.brk OR (b.n > 0 AND f.len > 0 AND f.len + b.n > 500) AS cut FROM f JOIN b ON b.doc_id = f.doc_id AND b.i = f.i + 1) b)
    SELECT doc_id, max(units) + CASE WHEN arg_max(len, i) > 0 THEN 1 ELSE 0 END AS units, max(of) AS last_unit FROM f GROUP BY 1""",
)
def w5(spark, d):
    blocks = F.transform("pages", lambda t, i: F.struct(t.alias("text"), ((i + 1) % 7 == 0).alias("break_before")))
    df = paged(spark, d).select("doc_id", C.paginate(blocks, 500).alias("p"))
    return df.select("doc_id", F.size("p.units").cast("long").alias("units"), F.element_at("p.unit_of_block", -1).cast("long").alias("last_unit"))


@query(
    "w4_thin_headings",
    r"""WITH RECURSIVE l AS (SELECT doc_id, unnest(range(0, len(p))) AS i, unnest(p) AS t FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents)),
    h AS (SELECT doc_id, i, length(t) % 3 + 1 AS level, regexp_replace(left(t, 12), '^\s+|\s+$', '', 'g') AS title, i // 2 AS unit FROM l),
    v AS (SELECT doc_id, min(level) AS level FROM (SELECT doc_id, level FROM h WHERE title <> '' GROUP BY ALL HAVING count(DISTINCT unit) >= 2) GROUP BY 1),
    c AS (SELECT doc_id, title, unit, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS j FROM h JOIN v USING (doc_id, level) WHERE title <> ''),
    f AS (SELECT doc_id, j, title, unit, TRUE AS kept FROM c WHERE j = 1 UNION ALL
          SELECT c.doc_id, c.j, CASE WHEN c.unit > f.unit AND c.title <> f.title THEN c.title ELSE f.title END, CASE WHEN c.unit > f.unit AND c.title <> f.title THEN c.unit ELSE f.unit END, c.unit > f.unit AND c.title <> f.title FROM f JOIN c ON c.doc_id = f.doc_id AND c.j = f.j + 1),
    k AS (SELECT doc_id, title, CASE WHEN j = 1 THEN 0 ELSE unit END AS start, row_number() OVER (PARTITION BY doc_id ORDER BY j) - 1 AS x, count(*) OVER (PARTITION BY doc_id) AS n FROM f WHERE kept),
    g AS (SELECT doc_id, x // ((n + 49) // 50) AS g, min(start) AS start, arg_min(title, x) AS a, arg_max(title, x) AS b, count(*) AS m FROM k GROUP BY ALL)
    SELECT doc_id, CASE WHEN m = 1 THEN a ELSE a || ' — ' || b END AS title, start FROM g""",
)
def w4(spark, d):
    heads = F.transform("pages", lambda t, i: F.struct((F.char_length(t) % 3 + 1).alias("level"), F.left(t, F.lit(12)).alias("title"), (i / 2).cast("int").alias("unit")))
    return paged(spark, d).select("doc_id", F.inline(C.thin_headings(heads, F.size("pages")))).withColumn("start", F.col("start").cast("long"))


@query(
    "s21_grid_table",
    """SELECT doc_id, concat('| ', a, ' | x\\|y |', chr(10), '| --- | --- |', chr(10), '| c\\\\d | ', CASE WHEN doc_id % 2 = 0 THEN '' ELSE 'last' END, ' |') AS table FROM (SELECT doc_id, regexp_replace(replace(replace(source, '|', '\\|'), chr(10), ' '), '^\\s+|\\s+$', '', 'g') AS a FROM documents)""",
)
def s21(spark, d):
    k = F.col("doc_id")
    cell = lambda p, r, c, rs, cs, t: F.struct(F.lit(p).alias("pos"), F.lit(r).alias("row"), F.lit(c).alias("col"), F.lit(rs).alias("row_span"), cs.alias("col_span"), t.alias("text"), F.lit(2).alias("rows"), F.lit(2).alias("cols"))
    one = F.lit(1)
    # in even documents the third cell spans both columns and the fourth, covered, loses
    cells = F.array(cell(0, 0, 0, 1, one, F.col("source")), cell(1, 0, 1, 1, one, F.lit("x|y")), cell(2, 1, 0, 1, F.when(k % 2 == 0, 2).otherwise(1), F.lit("c\\d")), cell(3, 1, 1, 1, one, F.lit("last")), cell(4, 5, 0, 1, one, F.lit("outside")))
    rows = documents(spark, d).select("doc_id", F.inline(cells))
    return L.markdown_table(L.placed(rows, "doc_id"), "doc_id")


@query(
    "s6_page_text",
    "SELECT doc_id, concat(source, ' word', chr(10), 'line', CASE WHEN doc_id % 2 = 0 THEN chr(10) || chr(10) ELSE '' END, 'tail', CASE WHEN doc_id % 3 = 0 THEN ' loosebehind' ELSE '' END) AS text FROM documents",
)
def s6(spark, d):
    f = lambda v: F.lit(float(v))
    run = lambda i, s, x, y, eol: F.struct(F.lit(i).alias("idx"), s.alias("str"), f(x).alias("x"), f(y).alias("y"), f(1).alias("dx"), f(0).alias("dy"), f(20).alias("width"), f(10).alias("size"), eol.alias("eol"))
    even = F.col("doc_id") % 2 == 0
    runs = F.array(run(0, F.col("source"), 0, 100, F.lit(False)), run(1, F.lit("word"), 30, 100, F.lit(False)), run(2, F.lit("line"), 0, 80, F.lit(False)), run(3, F.lit(""), 0, 70, even), run(4, F.lit("tail"), 21, 80, F.lit(False)))
    loose = F.array(run(5, F.lit("loose"), 0, 0, F.lit(False)).withField("x", F.lit(None).cast("double")), run(6, F.lit(""), 0, 0, F.lit(True)), run(7, F.lit("behind"), 0, 20, F.lit(False)))
    runs = F.concat(runs, F.when(F.col("doc_id") % 3 == 0, loose).otherwise(F.slice(loose, 1, 0)))
    return L.page_text(documents(spark, d).select("doc_id", F.inline(runs)), "doc_id")


@query(
    "s7_outline",
    """WITH RECURSIVE i AS (SELECT doc_id // 20 AS doc_id, doc_id AS id, CASE WHEN doc_id % 20 = 0 THEN NULL WHEN doc_id % 20 < 4 THEN doc_id - doc_id % 20 ELSE doc_id - 3 END AS parent_id, source AS title FROM documents),
    t AS (SELECT doc_id, id, 1 AS level, title FROM i WHERE parent_id IS NULL UNION ALL SELECT i.doc_id, i.id, t.level + 1, i.title FROM t JOIN i ON i.parent_id = t.id WHERE t.level < 4) SELECT * FROM t""",
)
def s7(spark, d):
    k = F.col("doc_id")
    parent = F.when(k % 20 == 0, F.lit(None)).when(k % 20 < 4, k - k % 20).otherwise(k - 3)
    items = documents(spark, d).select(F.floor(k / 20).alias("doc_id"), k.alias("id"), parent.alias("parent_id"), (k % 20).alias("pos"), F.col("source").alias("title"))
    return L.outline(items).select("doc_id", "id", "level", "title")


# every third line of a text stands behind a heading, the others are prose with a citation here and there, in a fence or not
_MD = """CASE WHEN i % 3 = 0 THEN concat(repeat('#', CAST(1 + (i // 3 * 7 + doc_id) % 5 AS INT)), ' **Part** ', CAST(i AS VARCHAR), ' `x` #')
    WHEN i % 31 = 5 THEN '```' ELSE concat('x ', t, CASE WHEN i % 4 = 1 THEN concat(' [', source, ' p.', CAST(i % 6 AS VARCHAR), '] and [p.9]') ELSE '' END) END"""


@query(
    "f22_heading_tree",
    f"""WITH l AS (SELECT doc_id, source, unnest(range(0, len(p))) AS i, unnest(p) AS t FROM (SELECT doc_id, source, string_split(regexp_replace(text, '\\[[^\\]]*\\]', '', 'g'), chr(10)) AS p FROM documents)),
    k AS (SELECT doc_id, source, i, {_MD} AS m, count(*) FILTER (i % 31 = 5 AND i % 3 <> 0) OVER (PARTITION BY doc_id ORDER BY i) AS f, count(*) FILTER (i % 31 = 5 AND i % 3 <> 0) OVER (PARTITION BY doc_id) AS fences FROM l),
    h AS (SELECT *, i % 3 = 0 AND (f % 2 = 0 OR fences % 2 = 1) AS head, 1 + (i // 3 * 7 + doc_id) % 5 AS level FROM k),
    s AS (SELECT *, count(*) FILTER (head) OVER (PARTITION BY doc_id ORDER BY i) - 1 AS id FROM h),
    c AS (SELECT doc_id, id, source, (min(i) FILTER (i % 4 = 1 AND i % 3 <> 0 AND i % 31 <> 5)) % 6 AS page FROM s WHERE id >= 0 GROUP BY ALL),
    n AS (SELECT doc_id, id, level, concat('Part ', i, ' x') AS title FROM s WHERE head)
    SELECT n.doc_id, n.id, (SELECT max(o.id) FROM n o WHERE o.doc_id = n.doc_id AND o.id < n.id AND o.level < n.level) AS parent_id, n.level, n.title, CASE WHEN page >= 1 THEN page END AS page, CASE WHEN page >= 1 THEN source END AS doc_name
    FROM n JOIN c ON c.doc_id = n.doc_id AND c.id = n.id""",
)
def f22(spark, d):
    lines = documents(spark, d).select("doc_id", "source", F.posexplode(F.split(F.regexp_replace("text", r"\[[^\]]*\]", ""), "\n")).alias("i", "t"))
    md = lines.select("doc_id", "i", F.expr(_MD.replace("//", "div").replace("VARCHAR", "STRING")).alias("m"))
    md = md.groupBy("doc_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("i", "m"))), lambda x: x["m"]), "\n").alias("md"))
    return L.heading_trees(md, "doc_id", "md")


@query(
    "f21_normalize_math",
    r"""SELECT doc_id, concat('a $$', source, '$$ b $$x$$ `\(c\)` \[p.3\] \\(no\\)') AS math, concat('a ', source, ' b x `c` \[p.3\] \\(no\\)') AS plain FROM documents""",
)
def f21(spark, d):
    t = F.concat(F.lit(r"a \("), "source", F.lit(r"\) b \[x\] `\(c\)` \[p.3\] \\(no\\)"))
    return documents(spark, d).select("doc_id", L.normalize_math(t).alias("math"), L.strip_math(F.concat(F.lit(r"a \("), "source", F.lit(r"\) b \[x\] `\(c\)` \[p.3\] "))).alias("p0")).select("doc_id", "math", F.concat("p0", F.lit(r"\\(no\\)")).alias("plain"))


_P = "p AS (SELECT doc_id, unnest(generate_series(1, len(l))) AS page, unnest(l) AS t FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)), q AS (SELECT doc_id, page, CASE WHEN (doc_id + page // 4) % 3 = 0 THEN ' ' ELSE t END AS t FROM p)"


def some_blank(spark, d):
    df = paged(spark, d).select("doc_id", F.posexplode("pages").alias("i", "t")).withColumn("page", (F.col("i") + 1).cast("long"))
    return df.select("doc_id", "page", F.when((F.col("doc_id") + F.floor(F.col("page") / 4)) % 3 == 0, " ").otherwise(F.col("t")).alias("text"))


@query("p5_empty_pages", f"WITH {_P} SELECT doc_id, count(*) FILTER (NOT regexp_matches(t, '\\S')) AS empty, count(*) AS total, count(*) FILTER (NOT regexp_matches(t, '\\S')) >= 2 AND count(*) FILTER (NOT regexp_matches(t, '\\S')) / count(*) > 0.1 AS significant FROM q GROUP BY 1")
def p5(spark, d):
    return L.empty_pages(some_blank(spark, d), "doc_id")


@query(
    "s24_ocr_health",
    f"""WITH {_P}, b AS (SELECT doc_id, (page - 1) // 1 AS b, count(*) AS n, count(*) FILTER (NOT regexp_matches(t, '\\S')) AS e FROM q GROUP BY ALL),
    r AS (SELECT *, sum(CASE WHEN e = n THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY b) AS run FROM b), s AS (SELECT doc_id, run, count(*) FILTER (e = n) AS k FROM r GROUP BY ALL),
    m AS (SELECT doc_id, max(k) AS k FROM s GROUP BY 1), t AS (SELECT doc_id, CAST(sum(n) AS BIGINT) AS pages, CAST(sum(e) AS BIGINT) AS blank FROM b GROUP BY 1)
    SELECT doc_id, pages, blank, CASE WHEN k >= 3 THEN 'blankStreak' WHEN blank >= 2 AND blank / pages > 0.3 THEN 'blankRatio' END AS reason FROM t JOIN m USING (doc_id)""",
)
def s24(spark, d):
    return L.ocr_health(some_blank(spark, d), "doc_id", 1)


# ---- formats

_NAMES = "concat(source, CASE doc_id % 7 WHEN 0 THEN '.PDF' WHEN 1 THEN '.docx' WHEN 2 THEN '.pptx' WHEN 3 THEN '.hwpx' WHEN 4 THEN '.hwp' WHEN 5 THEN '.txt' ELSE '.pdf.zip' END)"


@query(
    "s1_s3_extensions",
    f"SELECT doc_id, regexp_matches(lower(n), '^.+\\.(pdf|docx|pptx|hwpx|hwp)$') AS supported, regexp_replace(n, '(?i)^(.+)\\.(pdf|docx|pptx|hwpx|hwp)$', '\\1') AS base FROM (SELECT doc_id, {_NAMES} AS n FROM documents)",
)
def s13(spark, d):
    n = F.expr(_NAMES)
    return documents(spark, d).select("doc_id", formats.supported(n).alias("supported"), formats.base_name(n).alias("base"))


@query(
    "s2_s19_magic",
    "SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'pdf' WHEN 1 THEN 'zip' WHEN 2 THEN 'cfb' WHEN 3 THEN 'hwp3' WHEN 4 THEN CASE WHEN doc_id % 12 = 4 THEN 'pdf' END END AS container FROM documents",
)
def s2(spark, d):
    k = F.col("doc_id")
    head = F.when(k % 6 == 0, F.encode(F.lit("%PDF-1.7"), "UTF-8")).when(k % 6 == 1, F.unhex(F.lit("504B0304FF"))).when(k % 6 == 2, F.unhex(F.lit("D0CF11E0A1B11AE100"))).when(k % 6 == 3, F.encode(F.lit("HWP Document File V3"), "UTF-8"))
    junk = F.when(k % 12 == 4, 500).otherwise(2000).cast("int")
    head = head.when(k % 6 == 4, F.encode(F.concat(F.repeat(F.lit("x"), junk), F.lit("%PDF-")), "UTF-8")).otherwise(F.encode("source", "UTF-8"))
    return documents(spark, d).select("doc_id", formats.container(head).alias("container"))


@query(
    "s20_s22_image_rules",
    """WITH i AS (SELECT doc_id // 100 AS doc, doc_id AS pos, 'sig' || (doc_id % 70) AS sig, doc_id % 130 AS width, 10 * (doc_id % 100) AS height FROM documents),
    g AS (SELECT *, row_number() OVER (PARTITION BY doc, sig ORDER BY pos) AS n FROM i WHERE width >= 50 AND height >= 50 AND width * height <= 4000000)
    SELECT doc, pos FROM (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY pos) AS k FROM g WHERE n = 1) WHERE k <= 50""",
)
def s20(spark, d):
    k = F.col("doc_id")
    images = documents(spark, d).select(F.floor(k / 100).alias("doc"), k.alias("pos"), F.concat(F.lit("sig"), (k % 70).cast("string")).alias("signature"), (k % 130).alias("width"), (10 * (k % 100)).alias("height"))
    return formats.kept_images(images, "doc").select("doc", "pos")


# ---- requests

_EV = "e AS (SELECT user_id, ts, value, event_id FROM events)"


@query(
    "x5_stalled_requests",
    """SELECT user_id, CASE WHEN epoch(TIMESTAMP '2024-03-01' - min(ts)) > 10800 THEN 'maxAge' WHEN epoch(TIMESTAMP '2024-03-01' - max(ts)) > 600 THEN 'stalled' END AS reason, count(*) AS frames FROM events WHERE ts <= TIMESTAMP '2024-03-01' GROUP BY 1""",
)
def x5(spark, d):
    return R.reclaimed(table(spark, d, "events"), "user_id", "2024-03-01 00:00:00")


@query(
    "x10_debounced_saves",
    """WITH g AS (SELECT user_id, ts, event_id, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nxt FROM events)
    SELECT user_id, ts, event_id FROM g WHERE nxt IS NULL OR epoch_us(nxt) - epoch_us(ts) > 3600000000""",
)
def x10(spark, d):
    return R.debounced(table(spark, d, "events").select("user_id", "ts", "event_id"), "user_id", 3600)


@query(
    "a15_sticky_window",
    """SELECT user_id, event_id, max(CASE WHEN n <= 4096 THEN 4096 WHEN n <= 8192 THEN 8192 WHEN n <= 12288 THEN 12288 ELSE 16384 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS num_ctx FROM (SELECT user_id, event_id, (event_id * 7919) % 17000 AS n FROM events)""",
)
def a15(spark, d):
    df = table(spark, d, "events").select("user_id", "event_id", T.context_bucket((F.col("event_id") * 7919) % 17000).alias("bucket"))
    return R.sticky(df, "user_id", "event_id", "bucket").select("user_id", "event_id", "num_ctx")


@query(
    "x4_idle_sessions",
    """WITH g AS (SELECT user_id, ts, CASE WHEN ts > lag(ts) OVER w + INTERVAL 2 HOURS THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM g) SELECT user_id, min(ts) AS begun, max(ts) + INTERVAL 2 HOURS AS ended, count(*) AS frames FROM s GROUP BY user_id, s""",
)
def x4(spark, d):
    return R.idle_sessions(table(spark, d, "events").select("user_id", "ts"), "user_id", "2 hours")


@query("x1_token_stream", "SELECT user_id AS request_id, string_agg(event_type, '' ORDER BY event_id) AS text, count(*) AS tokens FROM events WHERE event_type <> 'purchase' GROUP BY 1")
def x1(spark, d):
    tokens = table(spark, d, "events").where("event_type <> 'purchase'").select(F.col("user_id").alias("request_id"), F.col("event_id").alias("seq"), F.col("event_type").alias("token"))
    return R.assembled(tokens)
