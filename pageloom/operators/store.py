"""The library as tables: sessions, manifest, collections; upserts, eviction, repair, restoring and saving rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MAX_SESSIONS, MAX_BYTES = 30, 200 * 1024 * 1024
MAX_COLLECTIONS, MAX_COLLECTION_HASHES, MAX_NAME = 50, 50, 200
SCHEMA_VERSION = 1
#: Characters of a date that part a library for eviction: up to the hour.
SLOT_CHARS = 13
HASH = "^[a-f0-9]{64}$"
EPOCH = "1970-01-01T00:00:00.000Z"


def upsert(stored: DataFrame, changes: DataFrame, key: str | list[str], order: str) -> DataFrame:
    """stored with changes, the row of the latest ``order`` for each key; one shuffle of both by key."""
    both = stored.unionByName(changes, allowMissingColumns=True)
    latest = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))
    return both.withColumn("_n", latest).where("_n = 1").drop("_n")


def latest_only(requests: DataFrame, key: str, order: str) -> DataFrame:
    """The latest request of each key; earlier ones may no longer write. Aggregated before the shuffle."""
    rest = [c for c in requests.columns if c not in (key, order)]
    best = F.max_by(F.struct(*rest), order) if rest else F.lit(None)
    df = requests.groupBy(key).agg(F.max(order).alias(order), best.alias("_row"))
    return df.select(key, order, "_row.*") if rest else df.drop("_row")


def merge_summaries(sessions: DataFrame, news: DataFrame) -> DataFrame:
    """sessions with the summaries of news (doc_hash, name, content) put into their maps; unknown hashes are ignored.

    Of several contents for one name the latest counts, by news' column saved_at where it has one, else the greatest.
    Rows without a hash or name are left out.
    """
    order = F.struct("saved_at", "content") if "saved_at" in news.columns else F.col("content")
    one = news.where("doc_hash is not null and name is not null").groupBy("doc_hash", "name").agg(F.max_by("content", order).alias("content"))
    got = one.groupBy("doc_hash").agg(F.map_from_entries(F.collect_list(F.struct("name", "content"))).alias("_new"))
    df = sessions.join(got, "doc_hash", "left")
    old = F.coalesce("summaries", F.create_map().cast("map<string,string>"))
    new = F.coalesce("_new", F.create_map().cast("map<string,string>"))
    kept = F.map_filter(old, lambda k, _: ~F.coalesce(F.array_contains(F.map_keys(new), k), F.lit(False)))
    return df.withColumn("summaries", F.map_concat(kept, new)).drop("_new")


def normalized_manifest(raw: DataFrame) -> DataFrame:
    """Entries with good hashes; texts cut to their limits, numbers cast or 0, dates or the epoch."""
    number = lambda c, kind="long": F.greatest(F.coalesce(F.col(c).try_cast(kind), F.lit(0)), F.lit(0))
    text = lambda c, n: F.left(F.coalesce(c, F.lit("")), F.lit(n))
    return raw.where(F.col("doc_hash").rlike(HASH)).select(
        "doc_hash",
        text("file_name", 512).alias("file_name"),
        text("file_path", 4096).alias("file_path"),
        number("page_count").alias("page_count"),
        F.left("embed_model", F.lit(128)).alias("embed_model"),
        F.col("embed_dim").try_cast("long").alias("embed_dim"),
        number("chunk_count").alias("chunk_count"),
        number("byte_size").alias("byte_size"),
        F.coalesce("last_accessed", F.lit(EPOCH)).alias("last_accessed"),
    )


def recent(manifest: DataFrame) -> DataFrame:
    return manifest.orderBy(F.desc("last_accessed"), "doc_hash")


def stats(manifest: DataFrame) -> DataFrame:
    return manifest.agg(F.count("*").alias("n"), F.coalesce(F.sum("byte_size"), F.lit(0)).alias("total_bytes"))


def evicted(entries: DataFrame, by: list[str] | None = None, most: int = MAX_SESSIONS, most_bytes: int = MAX_BYTES) -> DataFrame:
    """The entries that must go so that count and bytes are within their limits, least recently used first.

    entries: doc_hash, last_accessed, byte_size, pinned; pinned ones count and stay. An entry goes exactly if what is
    left after all older unpinned ones went is still too much. by: columns that part the table into libraries.
    """
    # without libraries the table is parted by the first characters of its dates, which keep their order
    parts = by or ["_slot"]
    df = entries if by else entries.withColumn("_slot", F.left(F.coalesce(F.col("last_accessed").cast("string"), F.lit("")), F.lit(SLOT_CHARS)))
    df = df.withColumn("_free", (~F.col("pinned")).cast("long"))
    whole = Window.partitionBy(*parts)
    older = whole.orderBy("last_accessed", "doc_hash").rowsBetween(Window.unboundedPreceding, -1)
    gone = lambda x: F.coalesce(F.sum(x).over(older), F.lit(0))
    df = df.withColumns({"_gone": gone(F.col("_free")), "_gone_bytes": gone(F.col("_free") * F.col("byte_size"))})
    if by:
        left = {"_count": F.count("*").over(whole) - F.col("_gone"), "_bytes": F.sum("byte_size").over(whole) - F.col("_gone_bytes")}
        df = df.withColumns(left)
    else:
        # one row for each slot: what went in the slots before, and what there is in all
        slots = df.groupBy("_slot").agg(F.count("*").alias("_n"), F.sum("byte_size").alias("_b"), F.sum("_free").alias("_f"), F.sum(F.col("_free") * F.col("byte_size")).alias("_fb"))
        all_, earlier = Window.partitionBy(F.lit(0)), Window.partitionBy(F.lit(0)).orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
        rest = lambda total, free: F.sum(total).over(all_) - F.coalesce(F.sum(free).over(earlier), F.lit(0))
        slots = slots.select("_slot", rest("_n", "_f").alias("_count"), rest("_b", "_fb").alias("_bytes"))
        df = df.join(slots, "_slot").withColumns({"_count": F.col("_count") - F.col("_gone"), "_bytes": F.col("_bytes") - F.col("_gone_bytes")})
    out = df.where(~F.col("pinned") & ((F.col("_count") > most) | (F.col("_bytes") > most_bytes)))
    return out.drop("_count", "_bytes", "_gone", "_gone_bytes", "_free", "_slot")


def clean_hashes(hashes: Column, most: int = MAX_COLLECTION_HASHES) -> Column:
    """Valid hashes, first mention of each, in order, ``most`` at most."""
    return F.slice(F.array_distinct(F.filter(F.coalesce(hashes, F.array().cast("array<string>")), lambda h: h.rlike(HASH))), 1, most)


def with_active(active: Column, hashes: Column) -> Column:
    """The members with the active document put first if it is not among them."""
    return F.when(F.array_contains(hashes, active), hashes).otherwise(F.array_union(F.array(active), hashes))


def toggled(hashes: Column, one: Column) -> Column:
    return F.when(F.array_contains(hashes, one), F.array_remove(hashes, one)).otherwise(F.array_append(hashes, one))


def saved_collections(stored: DataFrame, changes: DataFrame, current: str | Column | None = None, by: list[str] | None = None) -> DataFrame:
    """Collections (id, name, doc_hashes, last_accessed) after an upsert; the least recently used go over 50, but not
    the current one. Names are cut and members cleaned; a collection without members is not saved. by: columns that
    part the tables into libraries; current may be a column, the id for each row's library."""
    by = by or []
    df = changes.withColumns({"name": F.left(F.trim("name"), F.lit(MAX_NAME)), "doc_hashes": clean_hashes(F.col("doc_hashes"))})
    df = upsert(stored, df.where((F.col("name") != "") & (F.size("doc_hashes") > 0)), [*by, "id"], "last_accessed")
    entries = df.select(*by, F.col("id").alias("doc_hash"), "last_accessed", F.lit(0).cast("long").alias("byte_size"), F.coalesce(F.col("id") == current, F.lit(False)).alias("pinned"))
    gone = evicted(entries, by, most=MAX_COLLECTIONS, most_bytes=0).select(*by, F.col("doc_hash").alias("id"))
    return df.join(gone, [*by, "id"], "left_anti")


def opened(collection: DataFrame, sessions: DataFrame) -> DataFrame:
    """How many of a collection's distinct members there are, and how many can be opened."""
    members = collection.select(F.explode("doc_hashes").alias("doc_hash")).distinct()
    have = sessions.select("doc_hash").distinct().withColumn("_have", F.lit(1))
    df = members.join(have, "doc_hash", "left")
    return df.agg(F.count("_have").alias("opened"), F.count("*").alias("total"))


def reconciled(manifest: DataFrame, found: DataFrame) -> DataFrame:
    """doc_hash and action for every folder or entry: keep, register, remove (folder), drop (entry), clear-index.

    found: doc_hash, readable, has_index of the folders that are there; manifest: doc_hash, chunk_count.
    """
    a = manifest.select("doc_hash", F.col("chunk_count").alias("_claims"), F.lit(True).alias("_known"))
    df = a.join(found.select("doc_hash", "readable", "has_index"), "doc_hash", "full_outer")
    good = F.coalesce("readable", F.lit(False)) & F.col("doc_hash").rlike(HASH)
    action = (
        F.when(F.col("_known").isNull(), F.when(good, "register").otherwise("remove"))
        .when(F.col("readable").isNull(), "drop")
        .when(~good, "remove")
        .when((F.col("_claims") > 0) & ~F.coalesce("has_index", F.lit(False)), "clear-index")
        .otherwise("keep")
    )
    return df.select("doc_hash", action.alias("action"))


def restored(opened_docs: DataFrame, sessions: DataFrame, model: str) -> DataFrame:
    """What each opened document (doc_hash) gets back: text, index, summary, number of messages.

    Nothing without a stored session; only the text from one of another schema version (a newer one is refused); the
    index only if it was made by the current model; the first summary by name that is not blank.
    """
    df = opened_docs.select("doc_hash").join(sessions, "doc_hash", "left")
    known, same = F.col("schema_version").isNotNull(), F.col("schema_version") == SCHEMA_VERSION
    names = F.array_sort(F.map_keys(F.map_filter(F.coalesce("summaries", F.create_map().cast("map<string,string>")), lambda _, v: F.trim(F.coalesce(v, F.lit(""))) != "")))
    state = F.when(~known, "none").when(F.col("schema_version") > SCHEMA_VERSION, "refused").when(~same, "text").otherwise("full")
    ok = F.coalesce(same, F.lit(False))
    return df.select(
        "doc_hash",
        state.alias("state"),
        (ok & F.coalesce((F.col("embed_model") == model) & (F.col("chunk_count") > 0), F.lit(False))).alias("index"),
        F.when(ok, F.get(names, F.lit(0))).alias("summary"),
        F.when(ok, F.coalesce("n_messages", F.lit(0))).otherwise(0).cast("long").alias("n_messages"),
    )


def saved(stored: DataFrame, news: DataFrame) -> DataFrame:
    """Sessions after saving (doc_hash, revision, index_state, chunk_count, summary, committed, saved_at).

    An index that is being built or failed leaves the stored one, as does one of the same revision; a summary that is
    not committed never replaces a committed one.
    """
    new = news.select("doc_hash", *[F.col(c).alias(f"_{c}") for c in ("revision", "index_state", "chunk_count", "summary", "committed", "saved_at")])
    df = stored.join(new, "doc_hash", "full_outer")
    first = F.col("saved_at").isNull()
    replace_index = F.col("_saved_at").isNotNull() & (first | (~F.col("_index_state").isin("building", "failed") & ~F.col("_revision").eqNullSafe(F.col("revision"))))
    replace_summary = F.col("_saved_at").isNotNull() & (first | F.coalesce("_committed", F.lit(False)) | ~F.coalesce("committed", F.lit(False)))
    pick = lambda test, c: F.when(test, F.col(f"_{c}")).otherwise(F.col(c)).alias(c)
    return df.select(
        "doc_hash",
        pick(replace_index, "revision"),
        pick(replace_index, "chunk_count"),
        pick(replace_summary, "summary"),
        pick(replace_summary, "committed"),
        F.coalesce("_saved_at", "saved_at").alias("saved_at"),
    )
