import random

import numpy as np
import pytest
import sentencepiece
from helpers import EDGES, docs

from pageloom.llm import pieces as S
from pageloom.llm import token_counts as C
from pageloom.llm.tokens import ByteBpe, default_path


def test_counts_over_block_boundaries(spark):
    bpe = ByteBpe(default_path(), specials=False)
    rows = [*EDGES, *((100 + i, "tok en " * (i % 7)) for i in range(40))]
    want = sorted((i is None, i or 0, len(bpe.ids(t or ""))) for i, t in rows)
    for block in (3, 1 << 16):
        got = C.token_counts(docs(spark, rows, "ids", "shard", "n_tokens").repartition(3), block=block)
        assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_tokens"]) for r in got.collect()) == want


def test_files_are_flat_and_split(spark, tmp_path):
    bpe = ByteBpe(default_path(), specials=False)
    rows = [(i, f"some words {i} " * (i % 5)) for i in range(30)]
    C.write_token_files(docs(spark, rows).coalesce(1), str(tmp_path / "t"), file_docs=8)
    files = sorted((tmp_path / "t" / "kind=ids").glob("*.txt"))
    flat = np.concatenate([np.fromfile(f, "<u2") for f in files])
    assert len(files) == 4 and flat.tolist() == [x for _, t in rows for x in [*bpe.ids(t).tolist(), C.SEPARATOR]]


def test_query_rows_against_the_tokenizer(spark):
    bpe, sf = ByteBpe(default_path(), specials=False), "/root/testdata/sf0.001"
    want = {r["doc_id"]: len(bpe.ids(r["text"] or "")) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert {r["doc_id"]: r["n_tokens"] for r in C.op7_token_counts(spark, sf).collect()} == want


def test_flat_files(spark, tmp_path):
    sep = C.SEPARATOR
    np.array([5, 6, sep, sep, 7, sep, 8, 9], "<u2").tofile(tmp_path / "a.bin")
    np.array([sep], "<u2").tofile(tmp_path / "b.bin")
    np.array([], "<u2").tofile(tmp_path / "c.bin")
    for largest in (C.LARGEST, 4):  # at once, and in byte ranges
        kept, C.LARGEST = C.LARGEST, largest
        try:
            got = C.document_lengths(C.scanned(spark, str(tmp_path), block=3)).orderBy("shard", "ordinal").collect()
        finally:
            C.LARGEST = kept
        assert [(r["shard"][-5:], r["ordinal"], r["n_tokens"]) for r in got] == [("a.bin", 0, 2), ("a.bin", 1, 0), ("a.bin", 2, 1), ("a.bin", 3, 2), ("b.bin", 0, 0)]


def test_ids_that_do_not_fit_fail(spark):
    with pytest.raises(Exception, match="does not fit"):
        C.token_counts(docs(spark, [(1, "some text")]), dtype="<u1", separator=255).collect()


def test_no_documents(spark):
    assert C.token_counts(docs(spark, EDGES).limit(0)).count() == 0


def test_query_ids_equal_the_library(spark):
    import zlib

    sf = "/root/testdata/sf0.001"
    lib = sentencepiece.SentencePieceProcessor(model_file=S.default_path())
    want = {}
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        ids = lib.encode(r["text"] or "")
        want[r["doc_id"]] = (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
    assert {r["doc_id"]: (r["n_pieces"], r["ids_crc32"]) for r in S.op8_sentencepiece(spark, sf).collect()} == want


def test_pieces_equal_the_library():
    lib, ours = sentencepiece.SentencePieceProcessor(model_file=S.default_path()), S.Pieces(S.default_path())
    rng = random.Random(2)
    letters = "abcdefghijklmnop  ▁éß日本語ﬁ\n\t\x00😀ing the THE 1234567890"
    texts = [t or "" for _, t in EDGES if len(t or "") < 1000] + ["a" * 700, " " * 90, "    def   f(x):\n\n      pass", "Internationalization!!!"]
    texts += ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(800)]
    texts += [" ".join(lib.id_to_piece(rng.randrange(300, 32000)).strip("▁") for _ in range(20)) for _ in range(300)]
    ids = ours.encode(texts)
    assert ids == lib.encode(texts)
    assert [ours.decode(x) for x in ids] == lib.decode(ids)


def test_unigram_viterbi_against_all_segmentations():
    model = [("▁a", -1.0), ("a", -2.0), ("b", -2.5), ("ab", -2.2), ("▁", -3.0), ("ba", -1.7), ("bab", -5.5), ("▁ab", -4.0)]
    ours = S.Pieces(pieces=model, merges=False)
    score = dict(model)

    def best(text):
        if not text:
            return 0.0
        return max((score[text[:n]] + best(text[n:]) for n in range(1, len(text) + 1) if text[:n] in score), default=-1e9)

    for text in ("a", "ab", "abba", "babab", "aabbab", "b"):
        got = [model[i][0] for i in ours.encode([text])[0]]
        assert "".join(got) == "▁" + text and abs(sum(score[p] for p in got) - best("▁" + text)) < 1e-9


def test_piece_rows(spark):
    got = S.encode_documents(docs(spark, EDGES, "n_pieces")).collect()
    assert len(got) == len(EDGES) and all(r["round_trip"] for r in got)
    assert {r["doc_id"]: r["n_pieces"] for r in got}[1] == 0
    assert S.encode_documents(docs(spark, EDGES).limit(0)).count() == 0
