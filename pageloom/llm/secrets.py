"""Operator 4: secret scans through an incremental ledger of blobs.

Every version of every text is addressed by the SHA-256 of its content. The
ledger keeps, for each blob, which rule versions have scanned it and the spans
they found, each under the name of its rule version. A run scans only pairs of
blob and rule version that the ledger lacks, each blob once however many paths
hold it, and joins the findings of the rule versions in force back to all paths. Built-in functions only: copies are combined before the shuffle
(by ``dropDuplicates``), and what is joined back is digests and spans.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pageloom.llm.common import table, written

REDACTED = "[REDACTED]"
#: Findings that are sent to every executor have at most so many blobs and spans together: about 15 MB.
MOST_SENT = 200_000


@dataclass(frozen=True)
class Rule:
    """Leftmost non-overlapping matches of pattern whose group has at least shortest characters."""

    kind: str
    pattern: str
    #: A text without any of these (in lower case if fold) has no match; cheaper to test than the pattern.
    hints: tuple[str, ...] = ()
    fold: bool = False
    group: int = 0
    shortest: int = 0
    version: int = 1

    @property
    def name(self) -> str:
        return f"{self.kind}@{self.version}"


def _either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


# Words and shapes of secrets. A run that is long enough from its first match on needs no later test.
KEYWORDS = ("password", "passwd", "secret", "token", "api_?key")
BASE = (
    Rule(
        "assign",
        "(" + "|".join(map(_either_case, KEYWORDS)) + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        hints=("passw", "secret", "token", "api"),
        fold=True,
        group=2,
        shortest=12,
    ),
    Rule("access", "AKIA[A-Z0-9]{14,}", hints=("AKIA",)),
    Rule("hex", "[0-9a-f]{16,}"),
)
RULES = (
    *BASE,
    # header lines, then all up to the end line, or, where that is missing, the lines of key characters
    Rule(
        "pem",
        "-----BEGIN [A-Z ]*PRIVATE KEY-----"
        + r"(?:[\x0A\x0D]+[A-Za-z]+-[A-Za-z]+:[^\x0A\x0D]*){0,4}"
        + r"(?:[^-]*-----END [A-Z ]*PRIVATE KEY-----|[\x20\x09-\x0D]+[A-Za-z0-9+/=\x0A\x0D]{40,})?",
        hints=("PRIVATE KEY-----",),
        version=2,
    ),
    Rule("github", "gh[pousr]_[A-Za-z0-9]{36,}", hints=("ghp_", "gho_", "ghu_", "ghs_", "ghr_")),
    Rule("slack", "xox[abprs]-[A-Za-z0-9-]{10,}", hints=("xox",)),
    Rule("google", "AIza[A-Za-z0-9_-]{35}", hints=("AIza",)),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}", hints=("eyJ",)),
)

#: As the ledger keeps them, and as findings() gives them: place is that of the rule among those in force.
KEPT_SPANS = "array<struct<start:int,end:int,rule:string>>"
SPANS = "array<struct<start:int,place:int,end:int,kind:string>>"


def _found(text: Column, rule: Rule) -> Column:
    """The rule's spans in code points: what lies between matches and the matches themselves give running offsets."""
    parts = F.arrays_zip(
        F.split(text, rule.pattern, -1).alias("gap"),
        F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0)).alias("match"),
        F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)).alias("value"),
    )

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.char_length(x["gap"])
        end = start + F.coalesce(F.char_length(x["match"]), F.lit(0))
        span = F.struct(start.alias("start"), end.alias("end"), F.lit(rule.name).alias("rule"))
        good = F.coalesce(F.char_length(x["value"]) >= rule.shortest, F.lit(False))
        return F.struct(end.alias("at"), F.when(good, F.array_append(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    zero = F.struct(F.lit(0).alias("at"), F.array().cast(KEPT_SPANS).alias("spans"))
    return F.aggregate(parts, zero, step, lambda acc: acc["spans"])


def _may_hold(rule: Rule, text: Column, lower: Column) -> Column:
    if not rule.hints:
        return text.rlike(rule.pattern)
    hit = F.lit(False)
    for word in rule.hints:
        hit = hit | F.contains(lower if rule.fold else text, F.lit(word))
    return hit


def scan(blobs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """blob, seen (names of the rules) and spans (with the names of their rules) for each row of blob, text, missing.

    A rule runs on a row only if missing, an array of rule names, holds it.
    """
    df = blobs.withColumn("_lower", F.lower("text"))
    none = F.array().cast(KEPT_SPANS)
    found = [F.when(F.array_contains("missing", r.name) & _may_hold(r, F.col("text"), F.col("_lower")), _found(F.col("text"), r)).otherwise(none) for r in rules]
    return df.select("blob", F.col("missing").alias("seen"), F.concat(*found).alias("spans"))


def blob(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def update(docs: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The ledger (blob, seen, spans) with the texts of docs: a row for each scan of a blob, written by the caller.

    Rows of the old ledger stay as they are. A blob that only some rule versions have seen gets one more row, for the
    others. Null texts count as empty. Blobs that all rules have seen are not scanned, and where few are new, the texts
    of the others are not shuffled.
    """
    names = F.array(*[F.lit(r.name) for r in rules])
    text = F.coalesce(F.col("text"), F.lit(""))
    blobs = docs.select(blob(F.col("text")).alias("blob"), text.alias("text"))
    if ledger is None:
        return scan(blobs.dropDuplicates(["blob"]).withColumn("missing", names), rules)
    seen = ledger.groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_set("seen"))).alias("_seen"))
    lacking = F.array_except(names, F.coalesce("_seen", F.array().cast("array<string>")))
    unseen = blobs.select("blob").distinct().join(seen, "blob", "left").select("blob", lacking.alias("missing"))
    unseen = written(unseen.where(F.size("missing") > 0), "unseen")
    if unseen.count() <= MOST_SENT:
        blobs = blobs.join(F.broadcast(unseen.select("blob")), "blob", "left_semi")
    return ledger.unionByName(scan(blobs.dropDuplicates(["blob"]).join(unseen, "blob"), rules))


def findings(ledger: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """blob and spans (by start, then place of the rule) of the rule versions in force, for blobs with any.

    One row for each blob. What other versions of a rule, or rules no longer in force, have found is left out.
    """
    names = F.array(*[F.lit(r.name) for r in rules])
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    place = lambda s: (F.array_position(names, s["rule"]) - 1).cast("int")
    full = lambda s: F.struct(s["start"].alias("start"), place(s).alias("place"), s["end"].alias("end"), F.get(kinds, place(s)).alias("kind"))
    now = ledger.select("blob", F.transform(F.filter("spans", lambda s: F.array_contains(names, s["rule"])), full).alias("spans"))
    return now.where(F.size("spans") > 0).groupBy("blob").agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list("spans")))).alias("spans"))


def spans_of(docs: DataFrame, found: DataFrame) -> DataFrame:
    """docs with a column spans: what findings() has for each row's text, empty if nothing. found: a written table.

    Findings of checked size are sent to the texts. Larger ones meet them in a shuffle, whose join can split a blob
    that many rows share.
    """
    size = found.agg(F.count("*").alias("n"), F.sum(F.size("spans")).alias("spans")).first()
    if size["n"] + (size["spans"] or 0) <= MOST_SENT:
        found = F.broadcast(found)
    found = found.withColumnsRenamed({"blob": "_blob", "spans": "_spans"})
    df = docs.drop("spans").withColumn("_blob", blob(F.col("text"))).join(found, "_blob", "left")
    return df.withColumn("spans", F.coalesce("_spans", F.array().cast(SPANS))).drop("_blob", "_spans")


def redacted(text: Column, spans: Column) -> Column:
    """text with each run of overlapping spans replaced by one mark."""

    def step(acc: Column, s: Column) -> Column:
        ahead = s["start"] >= acc["at"]
        more = F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit(REDACTED))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(ahead, more).otherwise(acc["out"]).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    rest = lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.char_length(text)))
    return F.aggregate(spans, start, step, rest)


def listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op4_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = written(findings(written(update(docs), "ledger")), "findings")
    # the digests and findings are joined; the text stays behind
    df = spans_of(docs, found).select("doc_id", "spans")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["place"] < len(BASE))
    return df.select("doc_id", *[count(r.kind) for r in BASE], F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def _kind_sql(place: int, rule: Rule) -> str:
    """Rows rid, place, kind, s, e of one rule: running sums over the pieces between matches and the matches."""
    rx = rule.pattern.replace("'", "''")
    return f"""
SELECT rid, {place} AS place, '{rule.kind}' AS kind, before + gaps AS s, before + gaps + n AS e FROM (
  SELECT rid, length(m) AS n, length(v) AS k,
         coalesce(sum(length(m)) OVER (PARTITION BY rid ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
         sum(length(g)) OVER (PARTITION BY rid ORDER BY i) AS gaps
  FROM (SELECT rid, unnest(range(1, len(ms) + 1)) AS i, unnest(ms) AS m, unnest(vs) AS v, unnest(gs[1:len(ms)]) AS g
        FROM (SELECT rid, regexp_extract_all(text, '{rx}') AS ms, regexp_extract_all(text, '{rx}', {rule.group}) AS vs,
                     regexp_split_to_array(text, '{rx}') AS gs FROM d) WHERE len(ms) > 0))
WHERE k >= {rule.shortest}"""


_COUNT_SQL = ", ".join(f"count(*) FILTER (kind = '{r.kind}') AS n_{r.kind}" for r in BASE)
_LIST_SQL = "string_agg(kind || ':' || CAST(s AS BIGINT) || ':' || CAST(e AS BIGINT), ',' ORDER BY s, place)"
OP4_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
f AS ({" UNION ALL ".join(_kind_sql(i, r) for i, r in enumerate(RULES))}),
a AS (SELECT rid, {_COUNT_SQL}, {_LIST_SQL} FILTER (place < {len(BASE)}) AS base, {_LIST_SQL} AS spans FROM f GROUP BY rid)
SELECT doc_id, {", ".join(f"coalesce(n_{r.kind}, 0) AS n_{r.kind}" for r in BASE)},
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN a USING (rid)
"""
