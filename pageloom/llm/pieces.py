"""Operator 8: SentencePiece encoding and decoding by a batched Viterbi search.

Distinct words of equal length advance together, one end position at a time.
For every piece length the words' substring hashes are looked up among the
sorted keys of all pieces; the best total score so far wins and its length is
stored as a backpointer. A unigram model needs no more. In a model built from
merges the best total is not the model's own segmentation, so there a piece
may follow another only if merging their two texts gives back these two; the
pieces of every prefix are then fixed, and the search finds the library's ids.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from pageloom.llm.common import cached, table

SPACE = "▁"
#: Segmented words that a worker remembers, about; those not seen again for so many new ones are forgotten.
MEMORY = 400_000
#: So few words of one length, longer than this, are searched one by one.
FEW, LONG = 8, 64
#: Texts that are segmented together.
TOGETHER = 2048
_P = np.uint64(0x9E3779B97F4A7C15 | 1)
#: A word: a run of spaces and what follows it. No piece reaches over the end of one.
_WORD = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _codes(texts: list[str]) -> np.ndarray:
    """Code points of texts of one length, a row for each."""
    return np.frombuffer("".join(texts).encode("utf-32-le"), dtype=np.uint32).reshape(len(texts), -1).astype(np.uint64)


def _prefix_hashes(codes: np.ndarray) -> np.ndarray:
    out = np.zeros((codes.shape[0], codes.shape[1] + 1), np.uint64)
    for i in range(codes.shape[1]):
        out[:, i + 1] = out[:, i] * _P + codes[:, i] + np.uint64(1)
    return out


class Pieces:
    """Pieces, scores and the two directions of one model file. merges: whether its segmentation is by merges."""

    def __init__(self, path: str | None = None, pieces: list[tuple[str, float]] | None = None, merges: bool = True):
        """From a file, or, for a unigram model of one's own, from (piece, score) pairs with ids in their order."""
        self.merges, self.byte_ids, self.unknown = merges, {}, -1
        if path:
            import sentencepiece

            lib = sentencepiece.SentencePieceProcessor(model_file=path)
            names = [lib.id_to_piece(i) for i in range(lib.vocab_size())]
            special = {i for i in range(len(names)) if lib.is_unknown(i) or lib.is_control(i) or lib.is_unused(i)}
            self.byte_ids = {int(names[i][3:5], 16): i for i in range(len(names)) if lib.is_byte(i)}
            plain = [i for i in range(len(names)) if i not in special and not lib.is_byte(i)]
            scores = [lib.get_score(i) for i in range(len(names))]
            self.unknown = lib.unk_id()
        else:
            names, scores = [p for p, _ in pieces], [s for _, s in pieces]
            plain, special = list(range(len(names))), set()
        self.score = {names[i]: scores[i] for i in plain}
        self.id = {names[i]: i for i in plain}
        if any(SPACE in p.lstrip(SPACE) for p in self.id):
            raise ValueError("a piece reaches over the end of a word")
        self.names, self.scores = names, np.array([*scores, 0.0])
        self.longest = max(map(len, self.id))
        # a long row of hashes would mix lengths: the length is part of the key
        keys = [(self._key(_prefix_hashes(_codes([p]))[0, -1], len(p)), i) for p, i in self.id.items()]
        keys.sort()
        self.keys, self.ids = np.array([k for k, _ in keys], np.uint64), np.array([i for _, i in keys])
        if len(np.unique(self.keys)) < len(self.keys):
            raise ValueError("two pieces have one key")
        self.raw = [b"" if i in special else p.encode() for i, p in enumerate(names)]
        for b, i in self.byte_ids.items():
            self.raw[i] = bytes([b])
        self.histories: dict[int, tuple | None] = {}
        self.follows: dict[int, bool] = {}
        self.words: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        # runs of spaces aside, words hold no longer piece than this
        self.longest_word = max((len(p) for p in self.id if p.strip(SPACE)), default=1)

    @staticmethod
    def _key(h, n: int):
        with np.errstate(over="ignore"):
            return (h ^ (h >> np.uint64(29))) * _P + np.uint64(n)

    def _history(self, piece: int) -> tuple[list[float], list[str], list[str]] | None:
        """How a piece comes about by merging the best-scored neighbours, leftmost first: the scores, and its first and
        last part before each merge and at the end. None if merging does not lead to it."""
        if piece not in self.histories:
            parts, scores, first, last = list(self.names[piece]), [], [], []
            while True:
                first.append(parts[0])
                last.append(parts[-1])
                found = [(s, -i) for i in range(len(parts) - 1) if (s := self.score.get(parts[i] + parts[i + 1])) is not None]
                if not found:
                    break
                score, at = max(found)
                parts[-at : 2 - at] = [parts[-at] + parts[1 - at]]
                scores.append(score)
            self.histories[piece] = (scores, first, last) if len(parts) == 1 else None
        return self.histories[piece]

    def _may_follow(self, before: int, piece: int) -> bool:
        """Whether merging two pieces' texts together gives these two: no pair across their border is ever the best.

        before: an id, -1 at the start of a word, the unknown id after a character without a piece.
        """
        right = self._history(piece)
        if right is None or before in (-1, self.unknown):
            return right is not None
        left = self._history(before)
        if left is None:
            return False
        i = j = 0
        while True:
            across = self.score.get(left[2][i] + right[1][j])
            a = left[0][i] if i < len(left[0]) else None
            b = right[0][j] if j < len(right[0]) else None
            # among equals the leftmost merges first: the left piece, the border, the right piece
            if across is not None and (a is None or across > a) and (b is None or across >= b):
                return False
            if a is None and b is None:
                return True
            if b is None or (a is not None and a >= b):
                i += 1
            else:
                j += 1

    def _may_all_follow(self, before: np.ndarray, piece: np.ndarray) -> np.ndarray:
        keys, of = np.unique((before + 1) * len(self.names) + piece, return_inverse=True)
        known = self.follows
        good = np.empty(len(keys), bool)
        for i, key in enumerate(keys.tolist()):
            answer = known.get(key)
            if answer is None:
                b, p = divmod(key, len(self.names))
                answer = known[key] = self._may_follow(b - 1, p)
            good[i] = answer
        return good[of]

    def _segment(self, words: list[str]) -> list[bytes]:
        """Ids of words of one length, each as little-endian unsigned 32-bit numbers."""
        n, length = len(words), len(words[0])
        longest = self.longest if any(w.startswith(2 * SPACE) for w in words) else self.longest_word
        hashes = _prefix_hashes(_codes(words))
        power = np.cumprod(np.array([1, *[int(_P)] * self.longest], np.uint64), dtype=np.uint64)
        total = np.full((n, length + 1), -np.inf)
        total[:, 0] = 0
        last = np.full((n, length + 1), -1, np.int64)
        back = np.zeros((n, length + 1), np.int32)
        for end in range(1, length + 1):
            # of a model built from merges only one piece can end a prefix: words that have it are done
            todo = np.arange(n)
            for size in range(min(end, longest), 0, -1):
                start = end - size
                key = self._key(hashes[todo, end] - hashes[todo, start] * power[size], size)
                at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
                found = (self.keys[at] == key) & np.isfinite(total[todo, start])
                hit = todo[found]
                if not len(hit):
                    continue
                piece, before = self.ids[at[found]], last[hit, start]
                if self.merges:
                    good = self._may_all_follow(before, piece)
                    hit, piece = hit[good], piece[good]
                score = total[hit, start] + self.scores[piece]
                better = score > total[hit, end]
                hit = hit[better]
                total[hit, end], last[hit, end], back[hit, end] = score[better], piece[better], size
                if self.merges:
                    todo = todo[~np.isfinite(total[todo, end])]
                    if not len(todo):
                        break
            # a character without a piece stands alone, and what follows it starts anew
            lone = np.flatnonzero(~np.isfinite(total[:, end]) & np.isfinite(total[:, end - 1]))
            lone = [i for i in lone if words[i][end - 1] not in self.id]
            total[lone, end], last[lone, end], back[lone, end] = total[lone, end - 1] - 1e6, self.unknown, 1
        steps, at, rows = [], np.full(n, length), np.arange(n)
        while at.any():
            steps.append(np.where(at > 0, last[rows, at], -1))
            size = back[rows, at]
            if ((size == 0) & (at > 0)).any():
                raise ValueError("a word has no segmentation")
            at = at - size
        ids = np.stack(steps[::-1], axis=1)
        flat, ends = ids[ids >= 0].astype("<u4").tobytes(), (4 * (ids >= 0).sum(axis=1)).cumsum().tolist()
        out = [flat[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]
        if self.byte_ids:
            for i in np.flatnonzero((ids == self.unknown).any(axis=1)):
                out[i] = self._with_bytes(words[i], out[i])
        return out

    def _with_bytes(self, word: str, ids: bytes) -> bytes:
        """Ids with each unknown one replaced by those of its character's bytes."""
        out, at = [], 0
        for i in np.frombuffer(ids, "<u4").tolist():
            size = 1 if i == self.unknown else len(self.names[i])
            out += [self.byte_ids[b] for b in word[at : at + size].encode()] if i == self.unknown else [i]
            at += size
        return np.array(out, "<u4").tobytes()

    def _segment_long(self, word: str) -> bytes:
        """The same search for one long word, where there is nothing to advance together."""
        total: list[float | None] = [0.0] + [None] * len(word)
        last, back = [-1] * (len(word) + 1), [0] * (len(word) + 1)
        longest = self.longest if word.startswith(2 * SPACE) else self.longest_word
        for end in range(1, len(word) + 1):
            for size in range(min(end, longest), 0, -1):
                before = total[end - size]
                piece = self.id.get(word[end - size : end]) if before is not None else None
                if piece is None:
                    continue
                if self.merges:
                    key = (last[end - size] + 1) * len(self.names) + piece
                    if key not in self.follows:
                        self.follows[key] = self._may_follow(last[end - size], piece)
                    if not self.follows[key]:
                        continue
                score = before + self.scores[piece]
                if total[end] is None or score > total[end]:
                    total[end], last[end], back[end] = score, piece, size
                    if self.merges:
                        break
            if total[end] is None and total[end - 1] is not None and word[end - 1] not in self.id:
                total[end], last[end], back[end] = total[end - 1] - 1e6, self.unknown, 1
        ids, end = [], len(word)
        while end:
            if not back[end]:
                raise ValueError("a word has no segmentation")
            ids.append(last[end])
            end -= back[end]
        packed = np.array(ids[::-1], "<i8").astype("<u4").tobytes()
        return self._with_bytes(word, packed) if self.byte_ids and self.unknown in ids else packed

    def encode_packed(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit numbers; see encode()."""
        split = [_WORD.findall(SPACE + t.replace(" ", SPACE)) if t else [] for t in texts]
        if len(self.words) > MEMORY // 2:
            self.words, self.older = {}, self.words
        if len(self.follows) > 4 * MEMORY:
            self.follows.clear()
        known, older = self.words, self.older
        new: dict[int, dict[str, None]] = {}
        for w in {w for words in split for w in words}:
            if w not in known:
                if w in older:
                    known[w] = older[w]
                else:
                    new.setdefault(len(w), {})[w] = None
        for group in new.values():
            group = list(group)
            if len(group) < FEW and len(group[0]) > LONG:
                known.update((w, self._segment_long(w)) for w in group)
                continue
            step = max(1, (1 << 20) // len(group[0]))
            for at in range(0, len(group), step):
                part = group[at : at + step]
                known.update(zip(part, self._segment(part), strict=True))
        return [b"".join([known[w] for w in words]) for words in split]

    def encode(self, texts: list[str]) -> list[list[int]]:
        """Ids of each text, spaces as their mark and one put in front; an empty text has none."""
        return [np.frombuffer(x, "<u4").tolist() for x in self.encode_packed(texts)]

    def decode(self, ids: list[int]) -> str:
        """The text of ids. Bytes that are no UTF-8 become replacement characters."""
        text = b"".join([self.raw[i] for i in ids]).decode("utf-8", "replace").replace(SPACE, " ")
        return text[1:] if text[:1] == " " else text


def model(path: str) -> Pieces:
    return cached(("pieces", path), lambda: Pieces(path))


def _encoded(path: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = model(path)
        names = ["doc_id", "n_pieces", "ids_crc32", "round_trip"]
        for batch in batches:
            ids, rows = batch.column(0).to_pylist(), []
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for at in range(0, len(texts), TOGETHER):
                part = texts[at : at + TOGETHER]
                for text, found in zip(part, pieces.encode_packed(part), strict=True):
                    same = pieces.decode(np.frombuffer(found, "<u4").tolist()) == text.replace(SPACE, " ")
                    rows.append((len(found) // 4, zlib.crc32(found), same))
            columns = [pa.array(ids, pa.int64())] + [pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return encode


def encode_documents(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_pieces, ids_crc32 (of little-endian unsigned 32-bit ids) and round_trip of every row of docs.

    round_trip: decoding gives back the text, marks of spaces read as spaces. Null texts count as empty.
    """
    schema = "doc_id long, n_pieces long, ids_crc32 long, round_trip boolean"
    return docs.select("doc_id", "text").mapInArrow(_encoded(path or default_path()), schema)


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents"))
