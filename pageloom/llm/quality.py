"""Operator 1: quality rules as one projection.

A table of thresholds over integer counts is compiled into a single boolean
column. Counts come from built-in functions on each row alone: no user code,
no shuffle. Every rule reads ``100 * part  <op>  percent * whole``, so there is
no floating point and SQL gives the same verdict.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pageloom.llm.common import table, words

# Frequent function words of the four languages.
STOP_WORDS = (
    "the of and to in is that for it was on with as be by this are at from or "
    "le la les de des et en un une du est que qui dans pour pas sur au par avec "
    "der die das und den von zu mit sich auf ein eine nicht dem für ist im des es "
    "el los las y que del se por con una su para al lo como más"
).split()
STOP_BYTES = max(len(w.encode()) for w in STOP_WORDS)


@dataclass(frozen=True)
class Rule:
    """Keep a document only if 100 * part is at least low (at most high) percent of whole."""

    name: str
    part: str
    whole: str
    low: int | None = None
    high: int | None = None

    def passes(self) -> Column:
        part, whole = 100 * F.col(self.part), F.col(self.whole)
        tests = [part >= self.low * whole] if self.low is not None else []
        tests += [part <= self.high * whole] if self.high is not None else []
        return reduce(lambda a, b: a & b, tests)

    def sql(self) -> str:
        tests = [f"100 * {self.part} >= {self.low} * {self.whole}"] if self.low is not None else []
        tests += [f"100 * {self.part} <= {self.high} * {self.whole}"] if self.high is not None else []
        return "(" + " AND ".join(tests) + ")"


#: The production thresholds.
RULES = (
    Rule("word length", "word_chars", "n_words", low=200, high=1500),
    Rule("symbols", "n_symbols", "n_words", high=10),
    Rule("exclamations", "n_exclaims", "n_words", high=20),
    Rule("stop words", "n_stop", "n_words", low=2),
    Rule("repeated lines", "n_dup_lines", "n_lines", high=40),
)

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
MORE_COUNTS = ("n_lines", "n_stop", "n_exclaims")


def _is_stop_word(word: Column) -> Column:
    """Only words short enough are lower-cased: no capital of the list's letters has fewer bytes than its small letter
    or more, but for the Kelvin sign, whose k the list does not have."""
    return (F.octet_length(word) <= STOP_BYTES) & F.lower(word).isin(*dict.fromkeys(STOP_WORDS))


def _repeat_words(df: DataFrame) -> DataFrame:
    """Add n_repeat_words from the array column _words: words inside 3-word windows that occur twice or more.

    Windows are 64-bit hashes sorted beside their positions inside the row; equal neighbours repeat. The positions
    of repeating windows, in order, each cover three words less what the next one covers. Lambdas are interpreted, and
    a column of the row that they name is read anew for each word. So they get numbers from shifted arrays instead.
    """
    n = F.greatest(F.size("_words") - 2, F.lit(0))
    part = lambda name, start, length: F.slice(F.col(name), F.lit(start), length)
    mix = lambda x, y: F.xxhash64(x, y)
    step = lambda p, q: F.least(F.lit(3), F.coalesce(q - p, F.lit(3)))
    df = df.withColumn("_ids", F.transform("_words", lambda w: F.xxhash64(w)))
    df = df.withColumn("_windows", F.zip_with(F.zip_with(part("_ids", 1, n), part("_ids", 2, n), mix), part("_ids", 3, n), mix))
    places = F.transform("_windows", lambda _, i: i)
    df = df.withColumn("_sorted", F.sort_array(F.arrays_zip(F.col("_windows").alias("h"), places.alias("i"))))
    df = df.withColumn("_hashes", part("_sorted.h", 1, n)).withColumn("_places", part("_sorted.i", 1, n))
    pairs = F.greatest(n - 1, F.lit(0))
    df = df.withColumn("_same", F.zip_with(part("_hashes", 1, pairs), part("_hashes", 2, pairs), lambda x, y: x == y))
    no = F.array(F.lit(False))
    repeats = F.zip_with(F.concat(no, "_same"), F.concat("_same", no), lambda x, y: x | y)
    df = df.withColumn("_at", F.sort_array(F.array_compact(F.zip_with("_places", repeats, lambda i, r: F.when(r, i)))))
    # the test, always true, keeps the optimizer from pasting the arrays into filters and into each other
    once = F.monotonically_increasing_id() >= 0
    return df.withColumn("n_repeat_words", F.when(once, F.aggregate(F.zip_with("_at", part("_at", 2, F.size("_at")), step), F.lit(0), lambda a, x: a + x).cast("long")))


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the counts that rules may name, as longs. Columns that start with an underscore are dropped.

    A null text counts as empty: all counts are 0. An empty table gives an empty table.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    df = docs.withColumn("_words", words(F.col(text)))
    df = df.withColumn("_lines", F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    df = _repeat_words(df)
    return df.withColumns({
        "n_words": F.size("_words").cast("long"),
        "word_chars": F.char_length(F.array_join("_words", "")).cast("long"),
        "n_symbols": F.regexp_count(t, F.lit(r"[#*$%&|<>]")).cast("long"),
        "n_exclaims": F.regexp_count(t, F.lit("!")).cast("long"),
        "n_lines": F.size("_lines").cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "n_stop": F.size(F.filter("_words", _is_stop_word)).cast("long"),
    }).drop("_words", "_lines", "_ids", "_windows", "_sorted", "_hashes", "_places", "_same", "_at")


def quality(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """docs with counts, base_failed, the names of failed rules and kept.

    Columns of docs that carry one of these names are replaced. Equal rows get equal results, each for itself.
    """
    added = (*COUNTS, *MORE_COUNTS, "base_failed", "failed_rules", "kept")
    df = measure(docs.drop(*[c for c in added if c != text]), text)
    failed = F.array_compact(F.array(*[F.when(~r.passes(), F.lit(r.name)) for r in rules]))
    df = df.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    # the always true last part keeps the optimizer from pasting the counts into a filter on kept, where each column
    # would be worked out again for every reference to it
    once = F.monotonically_increasing_id() >= 0
    return df.withColumn("failed_rules", failed).withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0) & once)


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality(docs).select("doc_id", *COUNTS, "base_failed", "kept", *MORE_COUNTS)


_STOP_SQL = ", ".join("'" + w + "'" for w in dict.fromkeys(STOP_WORDS))
OP1_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT rid, doc_id, text,
        list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
        list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
x AS (SELECT rid, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM w),
v AS (SELECT rid, i, word || ' ' || lead(word, 1) OVER o || ' ' || lead(word, 2) OVER o AS win
      FROM x WINDOW o AS (PARTITION BY rid ORDER BY i)),
r AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, win) AS n FROM v WHERE win IS NOT NULL) WHERE n > 1),
c AS (SELECT rid, count(DISTINCT i + k) AS n FROM r, (VALUES (0), (1), (2)) t(k) GROUP BY rid),
m AS (SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words,
        CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
        CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
        CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
        CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words,
        CAST(len(ls) AS BIGINT) AS n_lines,
        CAST(len(list_filter(ws, lambda x: lower(x) IN ({_STOP_SQL}))) AS BIGINT) AS n_stop,
        CAST(len(regexp_extract_all(text, '!')) AS BIGINT) AS n_exclaims
      FROM w LEFT JOIN c USING (rid)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND {" AND ".join(r.sql() for r in RULES)} AS kept, n_lines, n_stop, n_exclaims
FROM b
"""
