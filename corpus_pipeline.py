"""The corpus pipeline: five stages from raw documents to packed sequences.

Each stage works on all rows that its predecessor kept and takes
(spark, docs, sf_dir). All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pageloom.llm import langid, neardup, packing, quality, secrets
from pageloom.llm.common import drop, table, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Above this many bits a byte under its best language, a text is in none of them (clean text takes 2 to 3).
MOST_BITS = 6.5


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts without a letter and texts that no learned language predicts."""
    found = langid.identify(docs, langid.train(docs), COLUMNS)
    return found.where((F.col("lang_pred") != langid.UNDETERMINED) & (F.col("bits_per_byte") <= MOST_BITS)).select(*COLUMNS)


def apply_quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects what fails the base rules or any of the threshold table."""
    return quality.quality(docs.select(*COLUMNS)).where("kept").select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each component of near-duplicates the row with the smallest doc_id, then the smallest digest of its text.

    Rows are told apart by doc_id and text, so rows of one doc_id with different texts are documents of their own, and of
    repeated rows one stays. A row with a null doc_id stays only if no other of its class has one. Texts without words
    are like nothing and stay.
    """
    found = written(neardup.grouped(docs), "grouped")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("_unnamed"), "doc_id", "digest")).alias("_first")
    winners = found.where("component is not null").groupBy("component").agg(first).select("_first.doc_id", "_first.digest")
    kept = winners.unionByName(found.where("component is null").select("doc_id", "digest").distinct())
    keys = kept.withColumnsRenamed({"doc_id": "_id", "digest": "_digest"})
    rows = docs.select(*COLUMNS).withColumn("_row", F.xxhash64("text"))
    rows = rows.join(keys, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_row") == F.col("_digest")), "left_semi")
    return rows.dropDuplicates(["doc_id", "_row"]).select(*COLUMNS)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces every secret by a mark; n_chars follows the text. No document is rejected."""
    found = written(secrets.findings(written(secrets.update(docs), "ledger")), "findings")
    df = secrets.spans_of(docs.select(*COLUMNS), found)
    some = F.size("spans") > 0
    text = F.when(some, secrets.redacted(F.col("text"), F.col("spans"))).otherwise(F.col("text"))
    df = df.withColumn("_text", text)
    n_chars = F.when(some, F.char_length("_text").cast("long")).otherwise(F.col("n_chars"))
    return df.select("doc_id", F.col("_text").alias("text"), "lang", "source", n_chars.alias("n_chars"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokenizes and packs all that is left."""
    return packing.pack(docs)


STAGES = [
    ("language ID", identify_language),
    ("quality rules", apply_quality_rules),
    ("near-duplicates", drop_near_duplicates),
    ("secret scans", redact_secrets),
    ("packing", pack_sequences),
]

#: Language identification and packing have no SQL form; the tests hold the pipeline against its operators.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents").select(*COLUMNS), None
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if before is not None:
            drop(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
