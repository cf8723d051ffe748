"""Operator 5: near-duplicates by MinHash with tensored banding.

Two collections of M half-keys, two minima each, are computed for a document.
Its table keys are all pairs of a half-key of the one with a half-key of the
other: M * M tables for 4 * M hash functions, where independent tables would
take 4 * M * M. A half-key that no other document has cannot meet, so keys are
only formed from shared ones, and most documents form none.

Documents with equal sets are one class from the start. In a table bucket of
few classes all pairs are candidates; in a larger one each class is paired with
the smallest. Candidates are compared by their minima, then exactly on their
full shingle sets, and the verified links are contracted at once: components of
links are found by spreading smallest labels between tables.

Components that large buckets then still connect form groups, which go on in
three steps, each of which sees only what the one before left apart:

1. A class leaves its group if it provably has no link there. Its shingles that
   no other class of the groups has count towards every union but towards no
   intersection, and a link at 0.75 needs 3/7 of both sizes as common part.
2. Each class meets the middles of its half-keys: for each half-key, the class
   with the smallest share of such lonely shingles, which for copies around a
   base is the base.
3. All classes of different components of a group, divided once more by the
   half-keys of those left, are compared exactly, in blocks of sets of similar
   size that emit links only. This step grows with the square of a group, of
   classes that share half-keys, that the bound cannot refute and that are not
   linked; its largest component is not compared with itself.

What can be lost: a pair at a similarity of exactly 0.75 shares no key with
odds of 2 * (1 - 0.75**2)**M = 0.00002, and, where its buckets are small, has
too few equal minima with odds of 0.0000004 (both far less above). Of those that
share a large bucket no pair of different components stays uncompared.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pageloom.llm import shingles
from pageloom.llm.common import drop, table, written

#: Half-keys of each of the two collections, of two minima each.
M = 14
FUNCTIONS = 4 * M
#: Buckets of up to so many classes give all their pairs.
SMALL = 8
#: Sets of a block, and shingles in them, about.
BLOCK_SETS = 512
BLOCK_SHINGLES = 500_000
#: Pairs with fewer equal minima are not compared further: 0.75 less five standard deviations.
LEAST_EQUAL = 25
SIMILAR = 75
#: Sets of one band of sizes are at most this many times as large as each other: more than 4 / 3, so links stay in bands side by side.
BAND = 1.4
#: Ids of candidate documents that are sent to every executor, at most: 4 MB.
MOST_SENT = 500_000

#: A key with more rows than this, and more than a 50,000th of all, meets copies of its partner in several tasks.
HEAVY = 1000
MOST_COPIES = 50_000

SET = ["n", "d1", "d2"]
FEATURES = "doc_id long, digest long, n long, d1 long, d2 long, keys array<long>"
SETS = "doc_id long, n long, d1 long, d2 long, minima array<int>, shingles array<long>"


def _lists(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    offsets = np.arange(0, values.size + 1, values.shape[1], dtype=np.int32) if len(values) else np.zeros(1, np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.ravel(), kind))


def _shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[tuple], list[np.ndarray]]]:
    """Rows, without their last column, and the sets of these texts, a few megabytes of texts at a time."""
    for batch in batches:
        rows, texts, size = [], [], 0
        given = zip(*(c.to_pylist() for c in batch.columns[:-1]), strict=True)
        for row, text in zip(given, batch.columns[-1], strict=True):
            rows.append(row)
            texts.append((text.as_py() or "").encode())
            size += len(texts[-1])
            if size >= 4 * shingles.CHUNK:
                yield rows, shingles.sets(texts)
                rows, texts, size = [], [], 0
        if rows:
            yield rows, shingles.sets(texts)


def _digests(found: list[np.ndarray]) -> list[pa.Array]:
    """n, d1 and d2 of each set: two sums that tell sets apart."""
    n = np.array([len(s) for s in found], np.int64)
    d1 = np.array([s.sum(dtype=np.uint64) for s in found], np.uint64).view(np.int64)
    d2 = np.array([shingles.mix(s + np.uint64(1)).sum(dtype=np.uint64) for s in found], np.uint64).view(np.int64)
    return [pa.array(n), pa.array(d1), pa.array(d2)]


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows, found in _shingled(batches):
        keys = np.zeros((len(rows), 2 * M), np.int64)
        full = np.flatnonzero([len(s) for s in found])
        if len(full):
            low = shingles.minima([found[i] for i in full], FUNCTIONS)
            half = shingles.mix(low[:, 0::2] + shingles.mix(low[:, 1::2] + np.arange(2 * M, dtype=np.uint64)))
            keys[full] = half.view(np.int64)
        given = [pa.array([r[i] for r in rows], pa.int64()) for i in range(2)]
        yield pa.RecordBatch.from_arrays([*given, *_digests(found), _lists(keys, pa.int64())], names=["doc_id", "digest", *SET, "keys"])


def _full_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows, found in _shingled(batches):
        keep = [i for i, s in enumerate(found) if len(s)]
        if keep:
            kept = [found[i] for i in keep]
            low = (shingles.minima(kept, FUNCTIONS) & np.uint64(0xFFFFFFFF)).astype(np.uint32).view(np.int32)
            offsets = np.cumsum([0, *[len(s) for s in kept]]).astype(np.int32)
            flat = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(kept).view(np.int64)))
            columns = [pa.array([rows[i][0] for i in keep], pa.int64()), *_digests(kept), _lists(low, pa.int32()), flat]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", *SET, "minima", "shingles"])


def _pairs_of(nodes: Column) -> Column:
    """All pairs (larger, smaller) of a short sorted array."""
    below = lambda x, i: F.transform(F.slice(nodes, F.lit(1), i), lambda y: F.struct(x.alias("a"), y.alias("b")))
    return F.flatten(F.transform(nodes, below))


def components(edges: DataFrame) -> DataFrame:
    """node and label, the smallest node that it reaches, for every node of the edges (a, b); written."""
    both = written(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("label")), "labels")
    while True:
        seen = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("_low"))
        lower = labels.join(seen, "node").select("node", F.least("label", "_low").alias("_next"), F.col("label").alias("_old"))
        # one more step along the labels themselves halves what is left of a chain
        roots = labels.select(F.col("node").alias("_next"), F.col("label").alias("_root"))
        step = lower.join(roots, "_next", "left").select("node", F.least("_next", "_root").alias("label"), (F.least("_next", "_root") != F.col("_old")).alias("moved"))
        now = written(step, "labels")
        drop(labels)
        done = now.where("moved").isEmpty()
        labels = now.select("node", "label")
        labels.written_at = now.written_at
        if done:
            drop(both)
            return labels


def _join_heavy(rows: DataFrame, other: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """rows joined to other, which has each key once. Keys of many rows are dealt over several tasks.

    rows must be a written table. What is sent to every executor are its heavy keys, MOST_COPIES at most.
    """
    limit = max(HEAVY, -(-rows.count() // MOST_COPIES))
    heavy = rows.groupBy(key).count().where(F.col("count") > limit)
    heavy = heavy.select(key, F.ceil(F.col("count") / limit).cast("int").alias("_parts")).where(F.col(key).isNotNull()).collect()
    if not heavy:
        return rows.join(other, key, how)
    parts = rows.sparkSession.createDataFrame(heavy, f"{key} long, _parts int")
    dealt = rows.join(F.broadcast(parts), key, "left").withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.coalesce("_parts", F.lit(1))).cast("int"))
    copies = other.join(F.broadcast(parts), key, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1)))
    return dealt.drop("_parts").join(copies.drop("_parts"), [key, "_salt"], how).drop("_salt")


class _Linker:
    """The components that verified links make so far. labels: node and label of all candidate classes."""

    def __init__(self, sets: DataFrame):
        self.sets = sets
        self.labels = written(sets.select("node", F.col("node").alias("label")), "labels")

    def _likely(self, pairs: DataFrame) -> DataFrame:
        """Those of the pairs (a, b) that are in two components and may be similar by size and equal minima."""
        info = self.sets.select("node", "n", "minima").join(self.labels, "node")
        a = info.withColumnsRenamed({"node": "a", "n": "_na", "minima": "_ma", "label": "_la"})
        b = info.withColumnsRenamed({"node": "b", "n": "_nb", "minima": "_mb", "label": "_lb"})
        equal = F.size(F.filter(F.zip_with("_ma", "_mb", lambda x, y: x == y), lambda x: x))
        df = _join_heavy(pairs, b, "b").join(a, "a").where("_la <> _lb")
        df = df.where(100 * F.least("_na", "_nb") >= SIMILAR * F.greatest("_na", "_nb")).where(equal >= LEAST_EQUAL)
        return df.select("a", "b", "_la", "_lb")

    def _verified(self, pairs: DataFrame) -> DataFrame:
        full = self.sets.select("node", "n", "shingles")
        a = full.withColumnsRenamed({"node": "a", "n": "_na", "shingles": "_sa"})
        b = full.withColumnsRenamed({"node": "b", "n": "_nb", "shingles": "_sb"})
        both = F.size(F.array_intersect("_sa", "_sb")).cast("long")
        df = _join_heavy(pairs, b, "b").join(a, "a").withColumn("_both", both)
        return df.where(100 * F.col("_both") >= SIMILAR * (F.col("_na") + F.col("_nb") - F.col("_both")))

    def merge(self, links: DataFrame) -> None:
        """Put components together; links: pairs (a, b) of labels."""
        labels = self.labels
        moved = components(links)
        to = moved.select(F.col("node").alias("label"), F.col("label").alias("_to"))
        self.labels = written(labels.join(to, "label", "left").select("node", F.coalesce("_to", "label").alias("label")), "labels")
        drop(labels)
        drop(moved)

    def link(self, pairs: DataFrame) -> None:
        """Verify candidate pairs (a, b), a written table, on their full sets and put the components of links together."""
        likely = written(self._likely(pairs), "likely")
        links = written(self._verified(likely).select(F.col("_la").alias("a"), F.col("_lb").alias("b")).distinct(), "links")
        if not links.isEmpty():
            self.merge(links)
        drop(links)
        drop(likely)


def _block_links(key: tuple, rows: pa.Table) -> pa.Table:
    """Links (a, b) of labels among the rows of two blocks, exact; those that others imply are left out."""
    _, i, j = (k.as_py() for k in key)
    labels, block, n, lonely = (rows[c].to_numpy() for c in ("label", "block", "n", "lonely"))
    lists = rows["shingles"].combine_chunks()
    flat, ends = lists.flatten().to_numpy(zero_copy_only=False), np.cumsum(n)
    left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
    links: list[tuple[int, int]] = []
    if len(left) and len(right):
        # only rows that the bound does not refute against the smallest of the other side
        common = (100 + SIMILAR) * (n - lonely)
        left, right = (own[common[own] >= SIMILAR * (n[own] + n[other].min())] for own, other in ((left, right), (right, left)))
    if len(left) and len(right) and (labels[np.concatenate([left, right])] != labels[left[0]]).any():
        chosen = np.zeros(len(n), bool)
        chosen[right] = True
        owner = np.repeat(np.arange(len(n)), n)
        inside = np.flatnonzero(chosen[owner])
        inside = inside[np.argsort(flat[inside], kind="stable")]
        tokens, owner = flat[inside], owner[inside]
        up = {x: x for x in labels.tolist()}

        def top(x: int) -> int:
            while up[x] != x:
                up[x] = up[up[x]]
                x = up[x]
            return x

        for a in left.tolist():
            own = flat[ends[a] - n[a] : ends[a]]
            low = np.searchsorted(tokens, own)
            many = np.searchsorted(tokens, own, "right") - low
            at = np.repeat(low - np.cumsum(many) + many, many) + np.arange(many.sum())
            both = np.bincount(owner[at], minlength=len(n))
            for b in np.flatnonzero((both > 0) & (labels != labels[a]) & (100 * both >= SIMILAR * (n + n[a] - both))).tolist():
                x, y = top(int(labels[a])), top(int(labels[b]))
                if x != y:
                    up[max(x, y)] = min(x, y)
                    links.append((int(labels[a]), int(labels[b])))
    return pa.table({"a": pa.array([x for x, _ in links], pa.int64()), "b": pa.array([y for _, y in links], pa.int64())})


def _connected(rows: DataFrame, by: list[str]) -> DataFrame | None:
    """label and group for all labels that share by with another one; rows: label and by."""
    met = written(rows.select("label", *by).distinct(), "met")
    several = met.groupBy(*by).agg(F.min("label").alias("b"), F.max("label").alias("_y")).where("b <> _y").drop("_y")
    edges = written(met.join(several, by).where("label <> b").select(F.col("label").alias("a"), "b").distinct(), "edges")
    groups = None if edges.isEmpty() else components(edges).withColumnsRenamed({"label": "group", "node": "label"})
    for done in (met, edges):
        drop(done)
    return groups


def _with_counts(sets: DataFrame, rows: DataFrame) -> DataFrame:
    """rows with n and lonely, the number of a node's shingles that no other node of rows has."""
    own = sets.join(rows.select("node"), "node", "left_semi")
    held = own.select("node", F.explode("shingles").alias("_s")).groupBy("_s").agg(F.min("node").alias("node"), F.max("node").alias("_other"))
    alone = held.where("node = _other").groupBy("node").agg(F.count("*").alias("_alone"))
    counts = own.select("node", "n").join(alone, "node", "left").select("node", "n", F.coalesce("_alone", F.lit(0)).alias("lonely"))
    return rows.join(counts, "node")


def _unrefuted(rows: DataFrame) -> DataFrame:
    """The rows (node, group, n, lonely) whose class may be linked with another of its group.

    A link of sets of n and m shingles has 100 * common >= SIMILAR * (n + m - common), where common is at most
    n - lonely and m is at least SIMILAR % of n and the smallest of the group.
    """
    least = rows.groupBy("group").agg(F.min("n").alias("_least"))
    other = F.greatest(F.col("_least"), F.ceil(SIMILAR * F.col("n") / 100))
    may = (100 + SIMILAR) * (F.col("n") - F.col("lonely")) >= SIMILAR * (F.col("n") + other)
    return rows.join(least, "group").where(may).drop("_least")


def _link_blocks(linker: _Linker, rows: DataFrame) -> None:
    """Compare all classes of different components of a group. rows: node, label, group, n and lonely; written.

    Sets are dealt into blocks of one band of sizes, which meet those of the same band and the two beside it. The
    largest component of a group is only compared with the rest, not with itself.
    """
    sizes = rows.groupBy("group", "label").count().groupBy("group").agg(F.max_by("label", F.struct("count", "label")).alias("_main"))
    band = F.floor(F.log("n") / math.log(BAND)).cast("int")
    rows = rows.join(sizes, "group").withColumns({"is_main": F.col("label") == F.col("_main"), "band": band}).drop("_main")
    place = ["group", "band", "is_main"]
    needed = F.ceil(F.greatest(F.count("*") / BLOCK_SETS, F.sum("n") / BLOCK_SHINGLES)).cast("int")
    blocks = written(rows.groupBy(*place).agg(needed.alias("_count")), "blocks")
    block = F.xxhash64("band", "is_main", "_spot")
    rows = rows.join(blocks, place).withColumn("_spot", F.pmod(F.xxhash64("node"), "_count")).withColumn("block", block)
    rows = written(rows.select("node", "label", "group", "block", "lonely"), "placed")
    blocks = blocks.withColumn("_spot", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_count").cast("long") - 1))).withColumn("block", block)
    one = blocks.where("not is_main").select("group", "band", F.col("block").alias("i"))
    other = blocks.select("group", F.explode(F.array(*[F.col("band") + x for x in (-1, 0, 1)])).alias("band"), F.col("block").alias("j"), "is_main")
    meets = written(one.join(other, ["group", "band"]).where("is_main or j >= i").select("group", "i", "j"), "meets")
    sides = meets.select("*", F.col("i").alias("block")).union(meets.where("i <> j").select("*", F.col("j").alias("block")))
    full = rows.join(sides, ["group", "block"]).join(linker.sets.select("node", "n", "shingles"), "node")
    full = full.select("group", "i", "j", "block", "label", "n", "lonely", "shingles")
    links = written(full.groupBy("group", "i", "j").applyInArrow(_block_links, "a long, b long").distinct(), "links")
    if not links.isEmpty():
        linker.merge(links)
    for done in (links, meets, rows):
        drop(done)


def _settle(linker: _Linker, large: DataFrame, halves: DataFrame) -> None:
    """Link until no pair of different components in a large bucket is left uncompared. large: node and key of large
    buckets; halves: node and half."""
    groups = _connected(large.join(linker.labels, "node"), ["key"])
    if groups is None:
        return
    members = written(linker.labels.join(groups, "label"), "members")
    left = written(_unrefuted(_with_counts(linker.sets, members)).drop("label"), "unrefuted")
    # the middles
    dealt = written(halves.join(left, "node").join(linker.labels, "node").select("node", "half", "label", "lonely", "n"), "dealt")
    middle = F.min_by(F.struct("node", "label"), F.struct(F.col("lonely") / F.col("n"), "node"))
    middles = dealt.groupBy("half").agg(middle.alias("_m")).select("half", F.col("_m.node").alias("_to"), F.col("_m.label").alias("_home"))
    met = _join_heavy(dealt, middles, "half").where("label <> _home")
    pairs = written(met.select(F.greatest("node", "_to").alias("a"), F.least("node", "_to").alias("b")).distinct(), "pairs")
    linker.link(pairs)
    for done in (members, dealt, pairs):
        drop(done)
    # what is still apart and shares a half-key within its group
    now = left.join(linker.labels, "node")
    again = _connected(halves.join(now, "node"), ["group", "half"])
    if again is not None:
        rest = written(now.drop("group").join(again, "label"), "rest")
        _link_blocks(linker, rest)
        drop(rest)
    drop(left)


def _candidates(keyed: DataFrame, buckets: DataFrame) -> DataFrame:
    """Distinct pairs (a, b), a the larger, written: all of a small bucket, those with the smallest class of a larger one."""
    two = buckets.where("size = 2").select(F.col("last").alias("a"), F.col("first").alias("b"))
    more = written(keyed.join(buckets.where("size > 2").select("key", "size", "first"), "key"), "more")
    star = more.where((F.col("size") > SMALL) & (F.col("node") != F.col("first"))).select(F.col("node").alias("a"), F.col("first").alias("b"))
    short = more.where(F.col("size") <= SMALL).groupBy("key").agg(F.sort_array(F.collect_set("node")).alias("nodes"))
    all_ = short.select(F.explode(_pairs_of(F.col("nodes"))).alias("p")).select("p.a", "p.b")
    pairs = written(two.union(star).union(all_).distinct(), "pairs")
    drop(more)
    return pairs


def _tables(halves: DataFrame) -> tuple[DataFrame, DataFrame]:
    """node and key, and the buckets of all keys that several nodes have: key, size, first and last; both written.

    halves: node, pos, half, with 2 * M places.
    """
    shared = written(halves.groupBy("half").agg(F.min("node").alias("_x"), F.max("node").alias("_y")).where("_x <> _y").select("half"), "halves")
    own = halves.join(shared, "half").groupBy("node").agg(F.collect_set(F.struct("pos", "half")).alias("_own"))
    side = lambda test: F.transform(F.filter("_own", lambda h: test(h["pos"])), lambda h: h["half"])
    own = own.select("node", side(lambda p: p < M).alias("_left"), side(lambda p: p >= M).alias("_right"))
    tensor = F.flatten(F.transform("_left", lambda x: F.transform("_right", lambda y: F.xxhash64(x, y))))
    keyed = written(own.select("node", F.explode(tensor).alias("key")), "keyed")
    drop(shared)
    sizes = keyed.groupBy("key").agg(F.count("*").alias("size"), F.min("node").alias("first"), F.max("node").alias("last"))
    return keyed, written(sizes.where("size > 1"), "buckets")


def _node(df: DataFrame, shared_ids: DataFrame | None) -> DataFrame:
    """df (doc_id, n, d1, d2 and more) with node: the doc_id, or, where classes share it, a hash of it and the class."""
    if shared_ids is None:
        return df.withColumn("node", F.col("doc_id"))
    several = shared_ids.select("doc_id", F.lit(True).alias("_several"))
    return df.join(several, "doc_id", "left").withColumn("node", F.when(F.col("_several"), F.xxhash64("doc_id", *SET)).otherwise(F.col("doc_id"))).drop("_several")


def _link_classes(docs: DataFrame, reps: DataFrame, shared_ids: DataFrame | None) -> DataFrame | None:
    """node and label of the classes that may be linked; reps: doc_id, digest, node and the half-keys of
    each class."""
    halves = reps.select("node", F.posexplode("keys").alias("pos", "half"))
    keyed, buckets = _tables(halves)
    pairs = _candidates(keyed, buckets)
    if pairs.isEmpty():
        for done in (keyed, buckets, pairs):
            drop(done)
        return None
    nodes = written(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct(), "nodes")
    ids = reps.join(nodes, "node").select("doc_id", "digest")
    # a list of ids of checked size is sent to the texts; a longer one meets them in a shuffle
    few = nodes.count() <= MOST_SENT
    texts = docs.join(F.broadcast(ids) if few else ids, ["doc_id", "digest"]).select("doc_id", "text").distinct()
    sets = _node(texts.mapInArrow(_full_sets, SETS), shared_ids)
    linker = _Linker(written(sets.select("node", "n", "minima", "shingles"), "sets"))
    drop(nodes)
    linker.link(pairs)
    drop(pairs)
    large = written(keyed.join(buckets.where(F.col("size") > SMALL).select("key"), "key"), "large")
    for done in (keyed, buckets):
        drop(done)
    _settle(linker, large, reps.join(large.select("node").distinct(), "node", "left_semi").select("node", F.explode(F.slice("keys", 1, M)).alias("half")))
    drop(large)
    drop(linker.sets)
    return linker.labels


def grouped(docs: DataFrame) -> DataFrame:
    """doc_id, digest (of the text), n_shingles, component_id and component for every row of docs (doc_id, text).

    component tells components apart even if they have the same smallest doc_id, which only repeated ids allow. Rows of
    the same doc_id with different texts are documents of their own. A row with a null doc_id has its class's component
    and never gives a component_id; a class of such rows alone is linked with no other class and has a null
    component_id. Texts without words have a null component.
    """
    docs = docs.select("doc_id", F.xxhash64("text").alias("digest"), "text")
    features = written(docs.mapInArrow(_features, FEATURES), "features")
    classes = written(features.where("n > 0").groupBy(*SET).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("size")), "classes")
    shared_ids = written(classes.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"), "ids")
    if shared_ids.isEmpty():
        drop(shared_ids)
        shared_ids = None
    named = _node(classes, shared_ids)
    # the class's half-keys, from one of the rows that carry its smallest doc_id
    reps = features.join(classes.where("doc_id is not null").select("doc_id", *SET), ["doc_id", *SET], "left_semi")
    reps = reps.groupBy("doc_id", *SET, "keys").agg(F.min("digest").alias("digest"))
    reps = written(_node(reps, shared_ids).select("doc_id", "digest", "node", "keys"), "reps")
    labels = _link_classes(docs, reps, shared_ids)
    if labels is None:
        named = named.withColumn("label", F.col("node"))
    else:
        named = named.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    component = F.coalesce("label", F.xxhash64(*SET))
    if shared_ids is None:
        named = named.select(*SET, "size", F.col("label").alias("component_id"), component.alias("component"))
    else:
        named = written(named.select(*SET, "size", "doc_id", component.alias("component")), "named")
        least = named.groupBy("component").agg(F.min("doc_id").alias("component_id"))
        named = named.join(least, "component").drop("doc_id")
    named = written(named, "components")
    for done in [classes, reps] + [x for x in (labels, shared_ids) if x is not None]:
        drop(done)
    return _join_classes(features.drop("keys"), named)


def _join_classes(rows: DataFrame, named: DataFrame) -> DataFrame:
    """The rows with their class's component_id and component. A class of many rows is dealt over several tasks."""
    limit = max(HEAVY, -(-rows.count() // MOST_COPIES))
    heavy = named.where(F.col("size") > limit).select(*SET, F.ceil(F.col("size") / limit).cast("int").alias("_parts")).collect()
    result = ["doc_id", "digest", F.col("n").alias("n_shingles"), "component_id", "component"]
    full, named = rows.where("n > 0"), named.drop("size")
    if heavy:
        parts = F.broadcast(rows.sparkSession.createDataFrame(heavy, "n long, d1 long, d2 long, _parts int"))
        count = F.coalesce("_parts", F.lit(1))
        full = full.join(parts, SET, "left").withColumn("_salt", F.pmod(F.monotonically_increasing_id(), count).cast("int"))
        named = named.join(parts, SET, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), count - 1)))
        joined = full.drop("_parts").join(named.drop("_parts"), [*SET, "_salt"])
    else:
        joined = full.join(named, SET)
    none = F.lit(None).cast("long")
    empty = rows.where("n = 0").select("doc_id", "digest", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), none.alias("component"))
    return joined.select(*result).unionByName(empty)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs (doc_id, text).

    Links documents whose sets of five-word shingles have a Jaccard similarity of 0.75 or more; component_id is the
    smallest doc_id reachable. Equal sets are linked. Texts that are null or without words have an empty set and are
    linked with nothing. Repeated rows share their result. Rows of one doc_id with different texts are documents of their
    own, which are linked only if they are similar. A row with a null doc_id takes its class's component and never gives
    one. Other columns are not read.
    """
    out = grouped(docs)
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
