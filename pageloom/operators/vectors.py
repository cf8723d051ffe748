"""Vectors: normalisation, cosine scores, exact search, the embedding boundary."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain, islice
from typing import Protocol

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pageloom.shared import written

MIN_SCORE = 0.3
TOP_K = 5
BATCH = 50
#: Rows embedded before they are passed on, a multiple of BATCH.
PART = 1000
#: Queries that the driver holds at a time, rows on a side of a tile of products, and pairs summed at a time.
BLOCK, TILE, PAIRS = 1 << 15, 1 << 10, 1 << 12
#: Bytes of a row group of written vectors.
ROW_GROUP = 8 << 20
#: Numbers below this have products that single precision can hold.
LARGEST = 1e15


def normalized(v: Column) -> Column:
    """The vector at length 1, as floats; all zeros if its length is 0 or not finite."""
    squares = F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    inv = F.when((squares > 0) & (squares < float("inf")) & ~F.isnan(squares), 1 / F.sqrt(squares)).otherwise(0.0)
    return F.transform(v, lambda x: F.when(inv == 0, F.lit(0.0)).otherwise(x.cast("double") * inv).cast("float"))


def dot(a: Column, b: Column) -> Column:
    """The product of two vectors of length 1, summed as doubles and kept within -1 and 1."""
    terms = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.least(F.greatest(F.aggregate(terms, F.lit(0.0), lambda s, x: s + x), F.lit(-1.0)), F.lit(1.0))


def valid(v: Column, most: int = 8192) -> Column:
    """A vector that can be searched with: neither empty nor too long, every value finite."""
    finite = F.forall(v, lambda x: ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(v) > 0) & (F.size(v) <= most) & finite, F.lit(False))


def one_dimension(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """The table with its dimension checked: the job that reads it fails at a vector of another size than the others.

    The sizes are looked at by the job itself, in one aggregation that is joined as a single value.
    """
    sizes = vectors.agg(F.min(F.size(column)).alias("_least"), F.max(F.size(column)).alias("_most"))
    good = F.when(F.col("_least") == F.col("_most"), F.lit(True)).otherwise(F.raise_error(F.lit("vectors of different dimensions")))
    return vectors.where(sizes.select(good.alias("good")).scalar())


def scored(chunks: DataFrame, query: list[float], column: str = "embedding") -> DataFrame:
    """chunks with score, of vectors at length 1 with the query's dimension; others are left out.

    The query is one vector and becomes part of the plan, so nothing is joined or moved.
    """
    q = np.asarray(query, dtype=np.float64)
    norm = float(np.sqrt((q * q).sum()))
    unit = (q / norm if norm > 0 and np.isfinite(norm) else np.zeros_like(q)).astype(np.float32)
    literal = F.array(*[F.lit(float(x)) for x in unit])
    return chunks.where(F.size(column) == len(q)).withColumn("score", dot(F.col(column), literal))


def top_k(hits: DataFrame, by: list[str], k: int, order: list[Column]) -> DataFrame:
    """The first k rows of each group; Spark limits groups before it shuffles them."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return hits.withColumn("_rank", rank).where(F.col("_rank") <= k).drop("_rank")


def search(chunks: DataFrame, query: list[float], k: int = TOP_K, least: float = MIN_SCORE) -> DataFrame:
    """The k best chunks at or above the least score, best first; ties by idx."""
    hits = scored(chunks, query).where((F.col("score") >= least) & ~F.isnan("score"))
    return hits.orderBy(F.desc("score"), "idx").limit(k)


def best_scores(queries: DataFrame, chunks: DataFrame, key: str, block: int = BLOCK) -> DataFrame:
    """key and max_score (0 at least) of every query over all chunks, by blocks of matrix products.

    queries: key, embedding, a stated set (sentences of an answer) of one dimension. The driver holds a block of it at a
    time and sends it to the tasks that read the chunks; each task sends back one row for a query. Queries and chunk
    vectors of more than one block are written once, so that no block embeds them anew. Chunks of another dimension
    are passed over; if there are only such, no query has a row.
    """
    pairs = queries.select(key, "embedding")
    first = pairs.limit(block + 1).toArrow()
    vectors = first["embedding"].to_pylist()
    kind, dim = queries.schema[key].dataType.simpleString(), len(vectors[0]) if vectors else 0
    if len(vectors) <= block:
        parts = _best_of(first[key].combine_chunks(), np.asarray(vectors, dtype=_width(queries)).reshape(len(vectors), dim), chunks, key, kind, _width(chunks))
    else:
        # small row groups, so that every core gets some
        stored = written(chunks.select("embedding").where(F.size("embedding") == dim).distinct(), "vectors", **{"parquet.block.size": ROW_GROUP})
        rows = written(_packed(pairs, key, dim), "queries").toLocalIterator()
        parts = None
        while some := list(islice(rows, block)):
            left = np.frombuffer(b"".join(r[1] for r in some), dtype=_width(queries)).reshape(-1, dim)
            part = _best_of(pa.array([r[0] for r in some], first.schema.field(key).type), left, stored, key, kind, _width(chunks))
            parts = part if parts is None else parts.union(part)
    return parts.groupBy(key).agg(F.max("max_score").alias("max_score"))


def _width(vectors: DataFrame) -> str:
    """How numpy calls the numbers of the vectors."""
    return "<f4" if vectors.schema["embedding"].dataType.elementType.simpleString() == "float" else "<f8"


def _matrix(vectors: pa.Array, dim: int, width: str) -> np.ndarray:
    """The vectors of that dimension; null numbers are no numbers."""
    vectors = vectors.filter(pc.equal(pc.list_value_length(vectors), dim))
    return vectors.flatten().to_numpy(zero_copy_only=False).astype(width, copy=False).reshape(len(vectors), dim)


def _packed(queries: DataFrame, key: str, dim: int) -> DataFrame:
    """key and the embedding's bytes, which the driver reads faster than lists."""
    width = _width(queries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = _matrix(batch.column(1), dim, width)
            if len(found) < batch.num_rows:
                raise ValueError("queries of different dimensions")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([v.tobytes() for v in found], pa.binary())], names=[key, "embedding"])

    return queries.select(key, "embedding").mapInArrow(run, f"{key} {queries.schema[key].dataType.simpleString()}, embedding binary")


def _best_of(keys: pa.Array, left: np.ndarray, chunks: DataFrame, key: str, kind: str, width: str) -> DataFrame:
    dim = left.shape[1]
    left, back = _once(left)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, lengths, met = np.zeros(len(left)), _lengths(left), False
        for batch in batches:
            right = _matrix(batch.column(0), dim, width)
            if right.size:
                met = True
                _raise(best, left, lengths, right)
        if met:
            yield pa.RecordBatch.from_arrays([keys, pa.array(np.minimum(best, 1.0)[back])], names=[key, "max_score"])

    return chunks.select("embedding").mapInArrow(run, f"{key} {kind}, max_score double")


def _once(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row once, and where the rows given are among these."""
    if not rows.size:
        return rows, np.zeros(len(rows), np.int64)
    found, back = np.unique(np.ascontiguousarray(rows).view(f"V{rows.shape[1] * rows.itemsize}").ravel(), return_inverse=True)
    return found.view(rows.dtype).reshape(-1, rows.shape[1]), back


def _lengths(rows: np.ndarray) -> np.ndarray:
    return np.sqrt(np.square(rows, dtype=np.float64).sum(axis=1))


def _raise(best: np.ndarray, left: np.ndarray, lengths: np.ndarray, right: np.ndarray) -> None:
    """Raise best, one number for a row of left, to the greatest product with a row of right, summed as dot() does.

    Products in single precision, tile by tile, tell which pairs can be the best; only these are summed as doubles.
    Equal rows of right are looked at once. Values out of its range, or no numbers, take products of doubles.
    """
    right = _once(right)[0]
    # at least twice what a product in single precision can be off by
    slack = lengths * _lengths(right).max() * ((right.shape[1] + 4) * 2.0**-23) + 1e-30
    plain = not (np.abs(left).max(initial=0) < LARGEST and np.abs(right).max() < LARGEST)
    kind = np.float64 if plain else np.float32
    room = np.empty(TILE * TILE, kind)
    for i in range(0, len(left), TILE):
        some, now, off = left[i : i + TILE].astype(kind, copy=False), best[i : i + TILE], slack[i : i + TILE]
        for j in range(0, len(right), TILE):
            other = right[j : j + TILE].astype(kind, copy=False)
            product = np.matmul(some, other.T, out=room[: len(some) * len(other)].reshape(len(some), len(other)))
            top = product.max(axis=1)
            if plain:
                np.maximum(now, top, out=now)
                continue
            rows = np.flatnonzero(top > now - off)
            least = np.maximum(now - off, top - 2 * off)[rows]
            at, of = np.nonzero(product[rows] >= least[:, None])
            for k in range(0, len(at), PAIRS):
                a, b = rows[at[k : k + PAIRS]], of[k : k + PAIRS]
                terms = left[i + a].astype(np.float64) * right[j + b].astype(np.float64)
                np.maximum.at(now, a, np.cumsum(terms, axis=1)[:, -1])


class Embedder(Protocol):
    """The boundary to an embedding service: texts in, one vector for each out. Instances are sent to workers."""

    model: str
    dim: int

    def embed(self, texts: list[str]) -> list[list[float]]: ...


def _hash(word: str) -> bytes:
    return hashlib.blake2b(word.encode(), digest_size=8).digest()


class HashingEmbedder:
    """An embedder that needs no service: signed counts of hashed words, at length 1. The same everywhere."""

    def __init__(self, dim: int = 64, model: str = "hashing"):
        self.dim, self.model = dim, model

    def embed(self, texts: list[str]) -> list[list[float]]:
        words = [text.lower().split() for text in texts]
        counts = [len(w) for w in words]
        flat = list(chain.from_iterable(words))
        h = np.frombuffer(b"".join(map(_hash, flat)), "<u8")
        at = np.repeat(np.arange(len(texts)), counts) * self.dim + (h % np.uint64(self.dim)).astype(np.int64)
        v = np.bincount(at, np.where(h >> np.uint64(63), 1.0, -1.0), len(texts) * self.dim).reshape(len(texts), self.dim)
        norm = np.sqrt((v * v).sum(axis=1, keepdims=True))
        return (v / np.where(norm > 0, norm, 1)).astype(np.float32).tolist()


def embedded(rows: DataFrame, embedder: Embedder, text: str = "text", batch: int = BATCH) -> DataFrame:
    """rows with embedding and model. A service that returns another number of vectors fails the job: an index is
    built whole or not at all."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    names, at_text = [*rows.columns, "embedding", "model"], rows.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (b.slice(k, PART) for b in batches for k in range(0, b.num_rows, PART)):
            texts, found = [t or "" for t in part.column(at_text).to_pylist()], []
            for at in range(0, len(texts), batch):
                some = embedder.embed(texts[at : at + batch])
                if len(some) != len(texts[at : at + batch]):
                    raise ValueError("the embedder left out texts")
                found += some
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found, pa.list_(pa.float32())), pa.array([embedder.model] * len(texts), pa.string())], names=names)

    return rows.mapInArrow(run, f"{schema}, embedding array<float>, model string")
