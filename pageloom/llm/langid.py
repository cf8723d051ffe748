"""Operator 3: language identification by prediction by partial matching.

Each language has a tree of byte contexts up to three bytes long. A byte that
its longest seen context has not been followed by costs an escape and is
looked for after the next shorter context, down to equal odds for all 256
values (escape estimate C, no exclusions). The statistics are frozen after
training, so the code length of a byte depends on itself and three bytes
before it only: it is tabled for every four-byte string seen in training, and
worked out from shorter ones for the rest. A text's code length under a
language is the exact sum over all its bytes; the shortest wins.

Training counts a bounded sample of labelled documents on the executors, bounded
in documents and bytes of a language and in languages. What reaches the driver,
and is broadcast, is bounded by that sample.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pageloom.llm.common import latest, slices, table

#: Documents a language is learned from, about (each labelled document is taken with equal odds).
SAMPLE_DOCS = 400
#: Bytes a language is learned from, about, where that is less: 400 documents of 20 KB.
SAMPLE_BYTES = 8_000_000
#: Languages that are learned, at most: those with the most labelled documents.
MOST_LANGUAGES = 256
ORDER = 3
#: Texts are coded in windows of about this many bytes; a longer text is carried on from window to window.
WINDOW = 1 << 18
#: Stands before each text in place of the bytes that are not there.
LEAD = b"\n" * ORDER
UNDETERMINED = "und"


@dataclass
class Model:
    """For n from 1 to ORDER + 1: grams[n], sorted n-byte strings as numbers; costs[n], a row of bits by language for
    each; escapes[n], for the n-byte contexts in contexts[n], what a language pays to leave them."""

    languages: list[str]
    grams: dict[int, np.ndarray]
    costs: dict[int, np.ndarray]
    contexts: dict[int, np.ndarray]
    escapes: dict[int, np.ndarray]


def held_out(doc_id: Column) -> Column:
    """Documents that are never learned from. Null ids are not held out (and not learned from either)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, n, gram, times) of each batch of (lang, text)."""
    for batch in (part for whole in batches for part in slices(whole)):
        by_lang: dict[str, list[bytes]] = {}
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
            by_lang.setdefault(lang, []).append(text)
        for lang, texts in by_lang.items():
            data = np.frombuffer(LEAD + LEAD.join(texts), dtype=np.uint8).astype(np.uint64)
            own = np.ones(len(data), bool)
            starts = np.cumsum([0, *[len(t) + ORDER for t in texts]])[:-1]
            own[(starts[:, None] + np.arange(ORDER)).ravel()] = False
            gram = np.zeros(len(data), np.uint64)
            for n in range(1, ORDER + 2):
                gram[n - 1 :] |= data[: len(data) - n + 1] << np.uint64(8 * (n - 1))
                seen, times = np.unique(gram[own], return_counts=True)
                arrays = [pa.array([lang] * len(seen)), pa.array(np.full(len(seen), n, np.int32)), pa.array(seen.astype(np.int64)), pa.array(times.astype(np.int64))]
                yield pa.RecordBatch.from_arrays(arrays, names=["lang", "n", "gram", "times"])


def sample(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_bytes: int = SAMPLE_BYTES) -> DataFrame:
    """About sample_docs labelled documents, or sample_bytes, of each of MOST_LANGUAGES languages, none held out.

    Documents are chosen by a hash of doc_id.
    """
    usable = F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))
    labelled = docs.select("doc_id", "lang", "text").where(usable)
    sizes = labelled.groupBy("lang").agg(F.count("*").alias("n"), F.sum(F.octet_length("text").cast("long")).alias("bytes"))
    sizes = sizes.orderBy(F.desc("n"), "lang").limit(MOST_LANGUAGES).collect()
    if not sizes:
        return labelled.limit(0)
    shares = [x for r in sizes for x in (r["lang"], min(1.0, sample_docs / r["n"], sample_bytes / max(1, r["bytes"])))]
    share = F.coalesce(F.try_element_at(F.create_map(*map(F.lit, shares)), F.col("lang")), F.lit(0.0))
    return labelled.where(F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 20)) < share * (1 << 20))


def train(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> Model:
    """The model of docs (doc_id, lang, text). Without labelled documents it has no languages."""
    counted = sample(docs, sample_docs).select("lang", "text").mapInArrow(_count, "lang string, n int, gram long, times long")
    counts = counted.groupBy("lang", "n", "gram").agg(F.sum("times").alias("times")).toPandas()
    return build(counts)


def build(counts) -> Model:
    """The model of a pandas frame of lang, n, gram, times."""
    languages = sorted(counts["lang"].unique())
    grams = {n: np.unique(counts["gram"][counts["n"] == n].to_numpy(np.int64)) for n in range(1, ORDER + 2)}
    for n in range(ORDER, 0, -1):  # a context may hold bytes of a lead, which no gram ends with
        grams[n] = np.union1d(grams[n], grams[n + 1] >> 8)
    costs = {n: np.zeros((len(grams[n]), len(languages))) for n in grams}
    contexts = {n: np.unique(grams[n + 1] >> 8) for n in range(ORDER + 1)}
    escapes = {n: np.zeros((len(contexts[n]), len(languages))) for n in contexts}
    for k, lang in enumerate(languages):
        own = counts[counts["lang"] == lang]
        for n in grams:
            here = own[own["n"] == n].sort_values("gram")
            gram, times = here["gram"].to_numpy(np.int64), here["times"].to_numpy(float)
            context, of = np.unique(gram >> 8, return_inverse=True)
            total, kinds = np.bincount(of, times), np.bincount(of)
            escapes[n - 1][np.searchsorted(contexts[n - 1], context), k] = -np.log2(kinds / (total + kinds))
            if n == 1:
                costs[1][:, k] = escapes[0][0, k] + 8
            else:
                at = np.searchsorted(grams[n - 1], grams[n] & ((1 << 8 * (n - 1)) - 1))
                costs[n][:, k] = escapes[n - 1][np.searchsorted(contexts[n - 1], grams[n] >> 8), k] + costs[n - 1][at, k]
            costs[n][np.searchsorted(grams[n], gram), k] = -np.log2(times / (total + kinds)[of])
    return Model(languages, grams, costs, contexts, escapes)


class Coder:
    """Code lengths by table. Node numbers of one- to four-byte strings are chained: next[n][node, byte], 0 if unseen."""

    def __init__(self, model: Model):
        self.model, self.next = model, {}
        for n in range(2, ORDER + 2):
            gram = model.grams[n]
            follow = np.zeros((len(model.grams[n - 1]) + 1, 256), np.int32)
            follow[np.searchsorted(model.grams[n - 1], gram >> 8) + 1, gram & 255] = np.arange(1, len(gram) + 1)
            self.next[n] = follow
        self.first = np.zeros(256, np.int32)
        self.first[model.grams[1]] = np.arange(1, len(model.grams[1]) + 1)

    def costs(self, data: np.ndarray) -> np.ndarray:
        """A row of bits by language for each byte of data from number ORDER on."""
        # node[n]: of the n bytes that end at each place
        node = {1: self.first[data]}
        for n in range(2, ORDER + 2):
            node[n] = self.next[n][node[n - 1][:-1], data[n - 1 :]]
        last = {n: x[len(x) - (len(data) - ORDER) :] for n, x in node.items()}
        before = {n: x[ORDER - n : len(x) - 1] for n, x in node.items() if n <= ORDER}
        out = self.model.costs[ORDER + 1][last[ORDER + 1] - 1]
        left = np.flatnonzero(last[ORDER + 1] == 0)
        out[left] = 0
        for n in range(ORDER, 0, -1):
            if not len(left):
                return out
            context = before[n][left]
            seen = context > 0
            out[left[seen]] += self._escape(n, context[seen])
            here = last[n][left]
            out[left[here > 0]] += self.model.costs[n][here[here > 0] - 1]
            left = left[here == 0]
        out[left] += self.model.escapes[0][0] + 8
        return out

    def _escape(self, n: int, node: np.ndarray) -> np.ndarray:
        gram = self.model.grams[n][node - 1]
        at = np.minimum(np.searchsorted(self.model.contexts[n], gram), len(self.model.contexts[n]) - 1)
        return np.where((self.model.contexts[n][at] == gram)[:, None], self.model.escapes[n][at], 0.0)

    def lengths(self, texts: list[bytes]) -> np.ndarray:
        """A row of bits by language for each text; a long text is coded in windows."""
        total = np.zeros((len(texts), len(self.model.languages)))
        held, size = [], 0
        for i, text in enumerate(texts):
            for at in range(0, len(text), WINDOW):
                held.append((i, (text[at - ORDER : at] if at else LEAD) + text[at : at + WINDOW]))
                size += len(held[-1][1])
                if size >= WINDOW:
                    self._add(total, held)
                    held, size = [], 0
        if held:
            self._add(total, held)
        return total

    def _add(self, total: np.ndarray, held: list[tuple[int, bytes]]) -> None:
        costs = self.costs(np.frombuffer(b"".join(x for _, x in held), dtype=np.uint8))
        ends = np.cumsum([len(x) for _, x in held]) - ORDER
        starts = ends - np.array([len(x) for _, x in held]) + ORDER
        # every other sum is of a lead, which is not coded; the last one would start behind the end
        sums = np.add.reduceat(costs, np.column_stack([starts, ends]).ravel()[:-1], axis=0)[::2]
        np.add.at(total, [i for i, _ in held], sums)


def _predict(model) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        letter = regex.compile(r"\p{L}")
        coder = latest("langid", model.id, lambda: Coder(model.value))
        languages = coder.model.languages
        for batch in (part for whole in batches for part in slices(whole)):
            texts = [t if t and languages and letter.search(t) else "" for t in batch.column(batch.num_columns - 1).to_pylist()]
            data = [t.encode() for t in texts]
            n = len(data)
            lang, score, bits = [UNDETERMINED] * n, np.zeros(n), np.zeros(n)
            if languages:
                lengths = coder.lengths(data)
                best = lengths.argmin(axis=1)
                shortest = lengths[np.arange(n), best]
                score = 1 / np.exp2(-np.minimum(lengths - shortest[:, None], 1000)).sum(axis=1)
                bits = shortest / np.maximum(1, [len(d) for d in data])
                lang = [languages[k] if d else UNDETERMINED for k, d in zip(best, data, strict=True)]
                score = np.where([bool(d) for d in data], score, 0.0)
            rest = [batch.column(i) for i in range(batch.num_columns - 1)]
            names = [*batch.schema.names[:-1], "lang_pred", "score", "bits_per_byte"]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(lang, pa.string()), pa.array(score), pa.array(bits)], names=names)

    return predict


def identify(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """The columns keep of docs with lang_pred, score (the winner's share of 2**-code length) and bits_per_byte.

    Null texts and texts without a letter are ``und`` with score 0, as are all texts under a model without languages.
    Ties go to the first language by name. Each row stands for itself; an empty table gives an empty table.
    """
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    # keep may hold the text itself
    rows = docs.select(*keep, F.col("text").alias("_text"))
    handed = Handed(docs.sparkSession.sparkContext.broadcast(model))
    return rows.mapInArrow(_predict(handed), f"{schema}{', ' if schema else ''}lang_pred string, score double, bits_per_byte double")


class Handed:
    """A broadcast model with a name under which a worker keeps what it made of it."""

    def __init__(self, broadcast):
        import uuid

        self.broadcast, self.id = broadcast, uuid.uuid4().hex

    @property
    def value(self) -> Model:
        return self.broadcast.value


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = identify(docs, train(docs), ["doc_id"])
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "bits_per_byte")
