"""Operator 7: token counts by separator scan.

Token files are flat: ids of fixed width, each document ended by a separator,
no index. They are read in blocks, cut wherever a block is full. A scan finds
the separators of each block at once in numpy, knowing nothing of other blocks.
A prefix scan over the blocks of a file, sums of their sizes and the largest
separator position so far, then stitches documents that run over block
boundaries. Blocks are summed up before that, so it moves a row for a block.

Spark's text sink writes the files, with the separator's bytes as line ends, so
they are committed like any other output; beside each lies a file of names in
the same order, which is all that tells a document's id.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pageloom.llm.common import exists, new_path, slices, table
from pageloom.llm.tokens import default_path, encoder

#: The separator and the id width of the 50k byte-level vocabulary.
SEPARATOR = 50256
DTYPE = "<u2"
#: Ids of a block.
BLOCK = 1 << 16
#: Documents of a file, at most.
FILE_DOCS = 1 << 12
#: Files of more bytes are read in ranges of this size instead of at once.
LARGEST = 1 << 28

FOUND = "shard string, block long, size long, at array<long>"
#: Session setting under which rows of two kinds go to two files of a task in the order in which they come.
WRITERS = "spark.sql.maxConcurrentOutputFileWriters"


def _lines(path: str, separator: int, dtype: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, most = encoder(path, specials=False), np.iinfo(dtype).max
        for batch in (part for whole in batches for part in slices(whole)):
            values = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = bpe.ids(text.as_py() or "")
                if len(ids) and (ids.max() > most or (ids == separator).any()):
                    raise ValueError(f"an id of {path} is the separator or does not fit into {dtype}")
                values += [b"" if doc_id is None else str(doc_id).encode(), ids.astype(dtype).tobytes()]
            kinds = pa.array(["names", "ids"] * batch.num_rows, pa.string())
            yield pa.RecordBatch.from_arrays([kinds, pa.array(values, pa.binary())], names=["kind", "value"])

    return lines


def _mark(separator: int, dtype: str) -> bytes:
    return np.array([separator], dtype).tobytes()


def write_token_files(docs: DataFrame, out: str, path: str | None = None, separator: int = SEPARATOR, dtype: str = DTYPE, file_docs: int = FILE_DOCS) -> None:
    """Flat token files of docs (doc_id, text) under out/kind=ids, and names, line by line, under out/kind=names.

    Null texts count as empty. Separator strings in a text are ordinary text, so only document ends hold the separator;
    a vocabulary that does not fit into dtype fails the job. An empty table writes no files.
    """
    conf = docs.sparkSession.conf
    before = conf.get(WRITERS)
    lines = docs.select("doc_id", "text").mapInArrow(_lines(path or default_path(), separator, dtype), "kind string, value binary")
    writer = lines.select("kind", F.col("value").cast("string").alias("value")).write.partitionBy("kind").option("maxRecordsPerFile", file_docs)
    conf.set(WRITERS, "4")
    try:
        writer.option("encoding", "ISO-8859-1").option("lineSep", _mark(separator, dtype).decode("latin-1")).text(out)
    finally:
        conf.set(WRITERS, before)


def _row(shard: str, block: int, ids: np.ndarray, separator: int) -> pa.RecordBatch:
    at = np.flatnonzero(ids == separator)
    columns = [pa.array([shard]), pa.array([block], pa.int64()), pa.array([len(ids)], pa.int64()), pa.array([at], pa.list_(pa.int64()))]
    return pa.RecordBatch.from_arrays(columns, names=["shard", "block", "size", "at"])


def _whole(separator: int, dtype: str, block: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.frombuffer(content.as_buffer(), dtype=dtype)
                for at in range(0, len(ids), block):
                    yield _row(name, at // block, ids[at : at + block], separator)

    return scan


def _ranges(separator: int, dtype: str, block: int, most: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        width = np.dtype(dtype).itemsize * block
        for batch in batches:
            for name, first in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                uri = "file://" + name[5:] if name.startswith("file:/") and not name.startswith("file://") else name
                system, at = fs.FileSystem.from_uri(uri)
                with system.open_input_file(at) as file:
                    for number in range(first, first + max(1, most // width)):
                        part = file.read_at(width, number * width)
                        if not part:
                            break
                        yield _row(name, number, np.frombuffer(part, dtype=dtype), separator)

    return scan


def scanned(spark: SparkSession, path: str, separator: int = SEPARATOR, dtype: str = DTYPE, block: int = BLOCK) -> DataFrame:
    """shard (the file's path), block, size and at (where the separator stands) of flat token files.

    Files up to LARGEST bytes come through Spark's reader at once; larger ones are read in byte ranges, by as many tasks.
    """
    files = spark.read.format("binaryFile").load(path)
    small = files.where(F.col("length") <= LARGEST).select("path", "content").mapInArrow(_whole(separator, dtype, block), FOUND)
    width = np.dtype(dtype).itemsize * block
    step = max(1, LARGEST // width)
    firsts = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("length") - 1) / width), F.lit(step).cast("long")))
    parts = files.where(F.col("length") > LARGEST).select("path", firsts.alias("first"))
    large = parts.repartition("path", "first").mapInArrow(_ranges(separator, dtype, block, LARGEST), FOUND)
    return small.union(large)


def document_lengths(found: DataFrame) -> DataFrame:
    """shard, ordinal, n_tokens of every document of scanned() files, separators not counted.

    Tokens behind a file's last separator are its last document. A file without tokens has no documents.
    """
    before = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum("size").over(before), F.lit(0).cast("long"))
    found = found.withColumn("_start", start)
    found = found.withColumns({
        "_last": F.coalesce(F.max(F.col("_start") + F.get("at", F.size("at") - 1)).over(before), F.lit(-1).cast("long")),
        "_done": F.coalesce(F.sum(F.size("at")).over(before), F.lit(0).cast("long")),
        "_final": F.lead("block").over(Window.partitionBy("shard").orderBy("block")).isNull(),
    })
    ends = F.transform("at", lambda x: x + F.col("_start"))
    # behind the last separator of a file, its end ends one more document, if tokens are left
    rest = F.when(F.col("_final"), F.array(F.col("_start") + F.col("size"))).otherwise(F.array().cast("array<bigint>"))
    found = found.withColumns({"_ends": F.concat(ends, rest), "_open": F.size("at")})
    each = F.transform("_ends", lambda e, i: F.struct((F.col("_done") + i).alias("ordinal"), (e - F.when(i == 0, F.col("_last")).otherwise(F.get("_ends", i - 1)) - 1).alias("n_tokens"), (i >= F.col("_open")).alias("open")))
    out = found.select("shard", F.explode(each).alias("d")).where("not d.open or d.n_tokens > 0")
    return out.select("shard", "d.ordinal", "d.n_tokens")


def _names(mark: bytes) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids = [int(x) if x else None for x in content.split(mark)[:-1]]
                columns = [pa.array([name] * len(ids), pa.string()), pa.array(range(len(ids)), pa.int64()), pa.array(ids, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["shard", "ordinal", "doc_id"])

    return read


def _stem(path: Column) -> Column:
    """A file's name, which ids and names of the same documents share."""
    return F.substring_index(path, "/", -1)


def token_counts(docs: DataFrame, path: str | None = None, separator: int = SEPARATOR, dtype: str = DTYPE, block: int = BLOCK) -> DataFrame:
    """doc_id and n_tokens of every row of docs, read back from flat token files that are written first."""
    spark, out = docs.sparkSession, new_path(docs.sparkSession, "tokens")
    write_token_files(docs, out, path, separator, dtype)
    if not exists(spark, f"{out}/kind=ids"):
        return docs.select("doc_id", F.lit(0).cast("long").alias("n_tokens")).limit(0)
    names = spark.read.format("binaryFile").load(f"{out}/kind=names").select("path", "content")
    names = names.mapInArrow(_names(_mark(separator, dtype)), "shard string, ordinal long, doc_id long")
    lengths = document_lengths(scanned(spark, f"{out}/kind=ids", separator, dtype, block))
    same = names.withColumn("shard", _stem(F.col("shard"))).join(lengths.withColumn("shard", _stem(F.col("shard"))), ["shard", "ordinal"])
    return same.select("doc_id", "n_tokens")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))
