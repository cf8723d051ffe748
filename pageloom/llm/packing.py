"""Operator 2: packing by first-fit decreasing.

Texts become ids in Arrow batches and are cut at multiples of the sequence
length; only piece lengths and checksums leave that task, never ids. Documents
fall into random groups of bounded size. Each group packs its pieces on its
own, longest first, into the first sequence with room, found in a tournament
tree: its leaves are the sequences' free places, each inner node the larger of
its two. A source, a run of copies or a repeated id cannot fill a group, since
groups follow a hash of doc_id, checksum and number of the copy.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pageloom.llm.common import table
from pageloom.llm.tokens import default_path, encoder

SEQUENCE = 2048
END = 1
#: Documents of a group, about: large enough that its last, part-filled sequence is no loss.
GROUP_DOCS = 4096
SEED = 20240

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, copy long"
PACKED = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def first_fit(lengths: list[int], size: int = SEQUENCE) -> tuple[list[int], list[int]]:
    """Bin and offset of each length, in the given order, by first fit: the lowest bin with room takes it."""
    leaves = 1 << max(0, len(lengths) - 1).bit_length()
    free = [size] * (2 * leaves)
    bins, offsets = [], []
    for n in lengths:
        at = 1
        while at < leaves:
            at *= 2
            if free[at] < n:
                at += 1
        bins.append(at - leaves)
        offsets.append(size - free[at])
        free[at] -= n
        while at > 1:
            at //= 2
            free[at] = max(free[2 * at], free[2 * at + 1])
    return bins, offsets


def _pieces(path: str, size: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path)
        for batch in batches:
            columns: list[list] = [[], [], [], [], [], []]
            copies: dict[tuple, int] = {}
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.append(bpe.ids(text.as_py() or ""), np.uint32(END)).astype("<u4")
                row = (doc_id, len(ids), zlib.crc32(ids.tobytes()))
                copies[row] = copies.get(row, -1) + 1
                for start in range(0, len(ids), size):
                    piece = ids[start : start + size]
                    for column, value in zip(columns, (doc_id, start, len(piece), zlib.crc32(piece.tobytes()), len(ids), copies[row]), strict=True):
                        column.append(value)
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "copy"]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)

    return cut


def pieces(docs: DataFrame, path: str | None = None, size: int = SEQUENCE) -> DataFrame:
    """A row for each piece of each document: doc_id, start, length, ids_crc32, doc_tokens, copy.

    copy numbers equal rows (one doc_id and text) within an Arrow batch. Null texts count as empty.
    """
    return docs.select("doc_id", "text").mapInArrow(_pieces(path or default_path(), size), PIECES)


def _pack(size: int) -> Callable[[pa.Table], pa.Table]:
    def pack(group: pa.Table) -> pa.Table:
        group = group.sort_by([("length", "descending"), ("doc_id", "ascending"), ("start", "ascending"), ("ids_crc32", "ascending")])
        bins, offsets = first_fit(group["length"].to_pylist(), size)
        first = group["_group"][0].as_py() << 32
        group = group.drop_columns(["_group", "copy"])
        group = group.append_column("sequence_id", pa.array([first + b for b in bins], pa.int64()))
        return group.append_column("offset", pa.array(offsets, pa.int64()))

    return pack


def packed(cut: DataFrame, n_docs: int, size: int = SEQUENCE, group_docs: int = GROUP_DOCS) -> DataFrame:
    """pieces() with sequence_id and offset. n_docs sets the number of groups.

    Sequences of a group are numbered from its number times 2**32. Equal documents are packed each on their own. Groups
    follow doc_id, checksum and copy, so neither null nor repeated ids fill a group. Lengths of at most ``size`` are required, as pieces() gives them.
    """
    groups = max(1, -(-n_docs // group_docs))
    # a document is spread over groups, so that one endless document does not make one endless group
    key = F.pmod(F.xxhash64("doc_id", "start", "ids_crc32", "copy", F.lit(SEED)), F.lit(groups))
    return cut.withColumn("_group", key).groupBy("_group").applyInArrow(_pack(size), PACKED)


def pack(docs: DataFrame, path: str | None = None, size: int = SEQUENCE, group_docs: int = GROUP_DOCS) -> DataFrame:
    """Every document of docs in sequences of at most ``size`` ids; an empty table gives an empty table."""
    return packed(pieces(docs, path, size), docs.select("doc_id").count(), size, group_docs)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
