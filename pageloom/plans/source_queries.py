"""Queries of the extractors: every document is written as files of a format, which are read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pageloom.functions import text as T
from pageloom.plans.registry import query, table
from pageloom.sources.extract import extracted
from pageloom.sources.writers import written

#: Lines in a file. No line needs more than one unit, so a file stays below the 500 units that are refused.
PART = 400


def _files(spark: SparkSession, d: str, kind: str) -> DataFrame:
    """A file for each 400 lines of a document: the first as title, a table of the id and the language, then the rest."""
    docs = table(spark, d, "documents").select("doc_id", "lang", F.split(F.coalesce("text", F.lit("")), "\n").alias("lines"))
    docs = docs.withColumn("lines", F.filter(F.transform("lines", T.trim), lambda x: x != ""))
    last = F.greatest(F.lit(0), F.floor((F.size("lines") - 1) / PART).cast("int"))
    parts = docs.withColumn("part", F.explode(F.sequence(F.lit(0), last)))
    parts = parts.withColumn("lines", F.slice("lines", F.col("part") * PART + 1, PART))
    cell = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    rows = F.array(F.array(F.lit("Key"), F.lit("Value")), F.array(F.lit("id"), cell(F.col("doc_id"))), F.array(F.lit("lang"), cell(F.col("lang"))))
    path = F.concat_ws("/", "doc_id", "part")
    return written(parts.select(path.alias("path"), F.get("lines", F.lit(0)).alias("title"), rows.alias("table"), F.slice("lines", 2, PART).alias("lines")), kind)


def _read(spark: SparkSession, d: str, kind: str) -> DataFrame:
    df, key = extracted(_files(spark, d, kind)), F.split("path", "/")
    first = F.get("headings", F.lit(0))
    place = [F.try_element_at(key, F.lit(i)).cast("long").alias(name) for i, name in ((1, "doc_id"), (2, "part"))]
    return df.select(
        *place,
        "kind",
        "unit_kind",
        F.array_join("units", "\n\n").alias("content"),
        F.size("headings").cast("long").alias("n_headings"),
        first["level"].cast("long").alias("level"),
        first["title"].alias("title"),
        F.exists("units", lambda x: (F.char_length(x) > 1800) & x.contains("\n\n") & (F.char_length(F.regexp_replace(x, "\n\n", "")) > 1800)).alias("overfull"),
        "error",
    )


def _sql(kind: str, unit: str = "page", between: str = "chr(10) || chr(10)") -> str:
    return rf"""WITH l AS (SELECT doc_id, lang, list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS l FROM documents),
    p AS (SELECT doc_id, lang, l, unnest(range(0, greatest(1, (len(l) + {PART - 1}) // {PART}))) AS part FROM l),
    q AS (SELECT doc_id, part, l[part * {PART} + 1:part * {PART} + {PART}] AS l, '| Key | Value |' || chr(10) || '| --- | --- |' || chr(10) || '| id | ' || doc_id || ' |' || chr(10) || '| lang | ' || coalesce(lang, '') || ' |' AS t FROM p),
    c AS (SELECT *, l[1] AS title, nullif(array_to_string(l[2:], {between}), '') AS rest FROM q)
    SELECT doc_id, part, '{kind}' AS kind, '{unit}' AS unit_kind, concat_ws(chr(10) || chr(10), title, t, rest) AS content, CAST(title IS NOT NULL AS BIGINT) AS n_headings,
           CASE WHEN title IS NOT NULL THEN 1::BIGINT END AS level, title, FALSE AS overfull, CAST(NULL AS VARCHAR) AS error FROM c"""


@query("s13_docx_files", _sql("docx"))
def s13(spark, d):
    return _read(spark, d, "docx")


@query("s14_pptx_files", _sql("pptx", "slide", "chr(10)"))
def s14(spark, d):
    return _read(spark, d, "pptx").withColumn("overfull", F.lit(False))  # a slide is a unit, whatever its length


@query("s17_hwpx_files", _sql("hwpx"))
def s17(spark, d):
    return _read(spark, d, "hwpx")


@query("s18_hwp_files", _sql("hwp"))
def s18(spark, d):
    return _read(spark, d, "hwp")
