"""Operator 10: document fingerprints by consistent weighted sampling.

A text's terms are its word pairs, weighted by how often they occur. For each
of K samples a term draws r and c from Gamma(2, 1) and b from (0, 1), all fixed
by the term and the number of the sample. With t = floor(ln(weight) / r + b),
the sample of a text is the pair (term, t) of the least
ln(c) - r * (t - b) - r. Two texts then agree in a sample with the odds of their
generalised Jaccard similarity, the sum of smaller weights over that of larger.

r and c are drawn from tables of 4,096 quantiles of their distribution, b is
uniform; all come from one hash of the term and the sample, whose upper half
tells equal values apart.
Everything is built-in functions: terms are counted by sorting hashes inside
the row, then one aggregation takes K minima at once. The next document is
found in one shuffle, by buckets of consecutive ids with the first document of
the bucket that follows copied to their end.
"""

from __future__ import annotations

import math
from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pageloom.llm.common import table, words

SAMPLES = 32
#: Quantiles of Gamma(2, 1), and bits of the hash that choose one.
BITS = 12
#: Documents of a bucket of consecutive ids, and the most bounds of buckets; a table of more than 4 million documents
#: has larger buckets, whose rows pass through a sort that spills.
BUCKET_DOCS = 64
MOST_BUCKETS = 1 << 16
LOWEST = -(1 << 63)
#: Bits of a digest, few enough to be multiplied by a number of buckets.
DIGEST_BITS = 40


def gamma_quantiles(n: int, zero: Column) -> Column:
    """The middles of n equal parts of Gamma(2, 1), by halving: its distribution function is 1 - (1 + x) * exp(-x).

    ``zero`` is a column of zeros, which keeps the table out of the text of the plan.
    """
    middle = lambda a: (a["low"] + a["high"]) / 2

    def halve(i: Column):
        def step(a: Column, _: Column) -> Column:
            x = middle(a)
            below = 1 - (1 + x) * F.exp(-x) < (i + 0.5 + zero) / n
            return F.struct(F.when(below, x).otherwise(a["low"]).alias("low"), F.when(below, a["high"]).otherwise(x).alias("high"))

        return step

    start = F.struct(F.lit(0.0).alias("low"), F.lit(64.0).alias("high"))
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.aggregate(F.sequence(F.lit(1), F.lit(60)), start, halve(i), middle))


def draws(spark: SparkSession) -> dict[str, Column]:
    """Tables of r and of ln(c), as scalar subqueries: one small array each, which all samples look up."""
    r = gamma_quantiles(1 << BITS, F.col("id"))
    return {"r": spark.range(1).select(r.alias("r")).scalar(), "log_c": spark.range(1).select(F.transform(r, lambda x: F.log(x)).alias("log_c")).scalar()}


def _constants(values, kind: str) -> Column:
    """A constant array; a text in the plan, folded into a literal once."""
    return F.split(F.lit(",".join(map(repr, values))), ",").cast(f"array<{kind}>")


def _terms(df: DataFrame, text: str) -> DataFrame:
    """df without text, with a row for each term: h (null for a text without words) and w. Sorted runs are counted."""
    df = df.withColumn("_words", words(F.col(text))).drop(text)
    pair = lambda w, i: F.xxhash64(w, F.get("_words", i + 1))
    pairs = F.transform("_words", pair)
    df = df.withColumn("_sorted", F.sort_array(F.when(F.size("_words") > 1, F.slice(pairs, F.lit(1), F.size("_words") - 1)).otherwise(pairs))).drop("_words")
    numbered = F.transform("_sorted", lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    df = df.withColumn("_runs", F.filter(numbered, lambda x, j: (j == 0) | (x["h"] != F.get("_sorted", j - 1))))
    run = lambda x, j: F.struct(x["h"].alias("h"), (F.coalesce(F.get("_runs", j + 1)["i"], F.size("_sorted")) - x["i"]).alias("w"))
    df = df.withColumn("_runs", F.transform("_runs", run)).drop("_sorted")
    return df.withColumn("_x", F.explode_outer("_runs")).withColumns({"h": F.col("_x.h"), "w": F.col("_x.w")}).drop("_runs", "_x")


def _sample(e: Column, tables: dict[str, Column]) -> Column:
    """What a term offers in a sample: its value above 32 bits of its own. e: the hash of term and sample; the logarithm
    of the term's weight is in _log."""
    part = lambda at: F.shiftrightunsigned(e, at).bitwiseAND((1 << BITS) - 1).cast("int")
    r, log_c = F.get(tables["r"], part(0)), F.get(tables["log_c"], part(BITS))
    b = F.shiftrightunsigned(e, 2 * BITS).bitwiseAND((1 << 20) - 1) / float(1 << 20)
    value = log_c - r * (F.floor(F.col("_log") / r + b) - b + 1)
    return F.shiftleft(F.floor((value + 4096) * (1 << 18)), 32).bitwiseOR(F.shiftrightunsigned(e, 32))


def signatures(df: DataFrame, text: str, keys: list[str], samples: int = SAMPLES) -> DataFrame:
    """keys and signature (array of long), one row for each distinct keys of df: the minima over the terms of its texts.

    A null text counts as empty, and texts without words all have one signature, of -1.
    """
    tables = draws(df.sparkSession)
    # without terms h and w are null, and so is every sample
    terms = _terms(df.select(*keys, text), text).withColumn("_log", F.log(F.col("w").cast("double")))
    # each hash is used several times: in a column of its own it is worked out and written down once
    terms = terms.withColumns({f"_e{k}": F.xxhash64("h", F.lit(k)) for k in range(samples)})
    least = [F.min(_sample(F.col(f"_e{k}"), tables)).alias(f"_s{k}") for k in range(samples)]
    out = terms.groupBy(*keys).agg(*least)
    return out.select(*keys, F.array(*[F.coalesce(f"_s{k}", F.lit(-1).cast("long")) for k in range(samples)]).alias("signature"))


def likeness(a: Column, b: Column) -> Column:
    """The share of samples in which two signatures agree."""
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda x: x)) / F.size(a)


def fingerprint(signature: Column) -> Column:
    """Eight hexadecimal digits for each sample."""
    digits = lambda x: F.lpad(F.lower(F.hex(F.xxhash64(x).bitwiseAND(0xFFFFFFFF))), 8, "0")
    return F.array_join(F.transform(signature, digits), "")


def _bucketed(docs: DataFrame) -> DataFrame:
    """doc_id, text, ord, bucket, copied: every row, and copies of rows whose bucket comes after another's last row.

    Buckets hold consecutive rows by ord and digest, both ascending. A bucket that one id (or none) fills is split by
    the digests of its texts. What reaches the driver are bounds and tops of buckets, of a number that MOST_BUCKETS
    bounds.
    """
    rows = docs.select("doc_id", "text", F.coalesce("doc_id", F.lit(LOWEST)).alias("ord"), digest(F.col("text")).alias("digest"))
    n = docs.select("doc_id").count()
    if not n:
        return rows.withColumns({"bucket": F.lit(0), "copied": F.lit(False)})
    size = max(BUCKET_DOCS, -(-n // MOST_BUCKETS))
    count = -(-n // size)
    bounds = [LOWEST]
    if count > 1:
        at = [i / count for i in range(1, count)]
        cuts = rows.agg(F.percentile_approx("ord", at, min(1_000_000, 20 * count)).alias("x")).first()["x"]
        # an id that fills more than a bucket gets one of its own, which can be split
        alone = [x + y for x, z in zip([LOWEST, *cuts], cuts, strict=False) if x == z for y in (0, 1)]
        bounds = sorted({LOWEST, *cuts, *alone})
    counts = {r["bucket"]: r["n"] for r in _placed(rows, bounds).groupBy("bucket").agg(F.count("*").alias("n")).collect()}
    one_id = {i for i, low in enumerate(bounds) if i + 1 < len(bounds) and bounds[i + 1] == low + 1}
    parts = [max(1, -(-counts.get(i, 0) // size)) if i in one_id else 1 for i in range(len(bounds))]
    rows = _placed(rows, bounds)
    if max(parts) > 1:
        own = F.get(_constants(parts, "bigint"), F.col("bucket"))
        base = F.get(_constants(list(accumulate([0, *parts[:-1]])), "int"), F.col("bucket"))
        rows = rows.withColumn("bucket", (base + F.floor(F.col("digest") * own / (1 << DIGEST_BITS))).cast("int"))
    total = sum(parts)
    top = {r["bucket"]: r["top"] for r in rows.groupBy("bucket").agg(F.max(F.struct("ord", "digest")).alias("top")).collect()}
    full = sorted(top)
    follows = dict(zip(full, [*full[1:], full[0]], strict=True))
    tops = [top.get(i, (LOWEST, 0)) for i in range(total)]
    targets = _constants([follows.get(i, -1) for i in range(total)], "int")
    # the rows before it, by descending order, are those of the next bucket
    first = (F.get(_constants([x[0] for x in tops], "bigint"), F.col("bucket")) == F.col("ord")) & (F.get(_constants([x[1] for x in tops], "bigint"), F.col("bucket")) == F.col("digest"))
    own = F.struct(F.col("bucket"), F.lit(False).alias("copied"))
    copy = F.struct(F.get(targets, F.col("bucket")).alias("bucket"), F.lit(True).alias("copied"))
    rows = rows.withColumn("_in", F.explode(F.when(first, F.array(own, copy)).otherwise(F.array(own))))
    return rows.select("doc_id", "text", "ord", "digest", "_in.bucket", "_in.copied")


def digest(text: Column) -> Column:
    """A hash of DIGEST_BITS bits, never negative; that of an empty text for null."""
    return F.shiftrightunsigned(F.xxhash64(F.coalesce(text, F.lit(""))), 64 - DIGEST_BITS)


def _placed(rows: DataFrame, bounds: list[int]) -> DataFrame:
    """rows with bucket: the number of the last bound that is not above ord, found in two steps of about its square root."""
    step = math.isqrt(len(bounds) - 1) + 1
    parts = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    firsts = _constants([p[0] for p in parts], "bigint")
    fine = F.split(F.get(F.split(F.lit(";".join(",".join(map(str, p)) for p in parts)), ";"), F.col("_part")), ",").cast("array<bigint>")
    rows = rows.withColumn("_part", F.size(F.filter(firsts, lambda x: x <= F.col("ord"))) - 1)
    return rows.withColumn("bucket", F.col("_part") * step + F.size(F.filter(fine, lambda x: x <= F.col("ord"))) - 1).drop("_part")


def compare_edited(docs: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """Fingerprints of all rows of docs (doc_id, text) and of their edited texts, and how alike they are.

    The edited text has the last floor(n_chars / 2) code points replaced by as many first ones (or all) of the next
    document by descending doc_id; after the last comes the first. Null ids come last; rows with one id stand in an
    order fixed by their texts. Null texts count as empty. A single row is followed by itself.
    """
    rows = _bucketed(docs).withColumn("text", F.coalesce("text", F.lit("")))
    order = Window.partitionBy("bucket").orderBy("copied", F.desc("ord"), F.desc("digest"), "text")
    rows = rows.withColumns({"_n": F.row_number().over(order), "_next": F.lead("text").over(order)})
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.coalesce("_next", F.lit("")), F.lit(1), half))
    rows = rows.withColumn("_edited", edited)
    rows = rows.withColumns({"n_chars": n.cast("long"), "edited_sha256": F.sha2("_edited", 256)})
    # a copied row is only there for the one before it
    both = F.when(F.col("copied"), F.array(F.struct(F.lit(0).alias("which"), F.col("text")))).otherwise(
        F.array(F.struct(F.lit(0).alias("which"), F.col("text")), F.struct(F.lit(1).alias("which"), F.col("_edited").alias("text")))
    )
    keys = ["bucket", "_n", "copied", "doc_id", "n_chars", "edited_sha256"]
    rows = rows.select(*keys, F.explode(both).alias("_t")).select(*keys, "_t.which", "_t.text")
    # all that follows is grouped within buckets, where the rows already are
    drawn = signatures(rows, "text", [*keys, "which"], samples)
    side = lambda i: F.first(F.when(F.col("which") == i, F.col("signature")), ignorenulls=True)
    drawn = drawn.groupBy(*keys).agg(side(0).alias("_own"), side(1).alias("_edit"))
    following = F.lead("_own").over(Window.partitionBy("bucket").orderBy("_n"))
    drawn = drawn.withColumn("_then", following).where("not copied")
    return drawn.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        fingerprint(F.col("_own")).alias("fingerprint"),
        fingerprint(F.col("_edit")).alias("edited_fingerprint"),
        likeness(F.col("_own"), F.col("_edit")).alias("near_edited"),
        likeness(F.col("_own"), F.col("_then")).alias("near_next"),
    )


def op10_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_edited(table(spark, sf_dir, "documents"))
