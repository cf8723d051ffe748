import zlib

import numpy as np
from helpers import EDGES, docs, prose, rng
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pageloom.llm import packing as P
from pageloom.llm.tokens import ByteBpe, default_path


def slow_first_fit(lengths, size):
    free, out = [], []
    for n in lengths:
        at = next((i for i, f in enumerate(free) if f >= n), len(free))
        if at == len(free):
            free.append(size)
        out.append((at, size - free[at]))
        free[at] -= n
    return out


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=80))
def test_tournament_tree(lengths):
    bins, offsets = P.first_fit(lengths, 50)
    assert list(zip(bins, offsets, strict=True)) == slow_first_fit(lengths, 50)


def test_ids_are_the_librarys():
    from tokenizers import Tokenizer

    lib, ours = Tokenizer.from_file(default_path()), ByteBpe(default_path())
    r = rng()
    for text in [t or "" for _, t in EDGES] + ["".join(chr(r.randrange(1, 0xD7FF)) for _ in range(40)) for _ in range(200)]:
        assert ours.ids(text).tolist() == lib.encode(text, add_special_tokens=False).ids


def test_every_id_in_one_piece(spark):
    r = rng()
    rows = [*EDGES, *((100 + i, prose(r, r.randint(1, 900))) for i in range(60))]
    got = P.pack(docs(spark, rows, "length", "sequence_id"), group_docs=16).toPandas()
    bpe = ByteBpe(default_path())
    for i, text in rows:
        if i is None or i == 5:
            continue
        ids = np.append(bpe.ids(text or ""), 1).astype("<u4")
        own = got[got.doc_id == i].sort_values("start")
        assert own.length.sum() == len(ids) == own.doc_tokens.iloc[0]
        assert [zlib.crc32(ids[a : a + n].tobytes()) for a, n in zip(own.start, own.length, strict=True)] == own.ids_crc32.tolist()
    assert len(got[got.doc_id == 5]) == 2 and got.doc_id.isna().sum() == 1
    for _, seq in got.sort_values("offset").groupby("sequence_id"):
        assert seq.offset.tolist() == [0, *seq.length.cumsum().tolist()[:-1]] and seq.length.sum() <= 2048


def test_empty(spark):
    assert P.pack(docs(spark, EDGES).limit(0)).count() == 0


def test_null_and_repeated_ids_fill_no_group(spark):
    rows = [(None, "the same text")] * 3000 + [(4, f"text {i}") for i in range(1500)] + [(i, "own") for i in range(10, 1510)]
    cut = P.pieces(docs(spark, rows))
    got = P.packed(cut, len(rows), group_docs=256)
    sizes = [r["count"] for r in got.groupBy((F.col("sequence_id") / (1 << 32)).cast("long")).count().collect()]
    assert sum(sizes) == 6000 and max(sizes) <= 2 * 6000 / len(sizes)
