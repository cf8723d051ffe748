"""Sets of hashed word shingles and their minima, vectorised over batches of texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from pageloom.llm.common import cached

WIDTH = 5
#: Texts are hashed together up to about this many bytes; longer ones in parts cut between words.
CHUNK = 1 << 20
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
# A-Z to lower case and every white-space byte to a space
_FOLD = bytes(32 if b in (9, 10, 11, 12, 13) else b + 32 if 65 <= b <= 90 else b for b in range(256))


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every bit over all 64 (the SplitMix64 finish)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def odd_numbers(n: int, seed: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=_U) * _U(_BASE) + _U(seed)) | _U(1)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of a fixed odd number modulo 2**64 and of its inverse, at least n of each."""
    n = 1 << max(21, (n - 1).bit_length())

    def make() -> tuple[np.ndarray, np.ndarray]:
        base = 0xD6E8FEB86659FD93
        both = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(n, b, dtype=_U)
            p[0] = 1
            both.append(np.cumprod(p, dtype=_U))
        return both[0], both[1]

    if n > 1 << 21:
        return make()  # one word of over two million bytes: not kept
    return cached(("powers", n), make)


def _parts(text: bytes) -> Iterator[bytes]:
    at = 0
    while len(text) - at > CHUNK:
        cut = text.rfind(b" ", at, at + CHUNK)
        if cut < 0:
            cut = text.find(b" ", at + CHUNK)
        if cut < 0:
            break
        yield text[at:cut]
        at = cut + 1
    yield text[at:] if at else text


def _hash_parts(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all words of the parts, in order, and the number of words of each part."""
    data = np.frombuffer(b" " + b" ".join(parts) + b" ", dtype=np.uint8)
    space = data == 32
    starts = np.flatnonzero(space[:-1] & ~space[1:]) + 1
    ends = np.flatnonzero(~space[:-1] & space[1:]) + 1
    power, inverse = _powers(len(data))
    total = np.cumsum((data.astype(_U) + _U(1)) * power[: len(data)], dtype=_U)
    words = mix((total[ends - 1] - total[starts - 1]) * inverse[starts] + (ends - starts).astype(_U) * _U(_BASE))
    # a part begins behind the space that ends the one before
    begins = np.cumsum([1, *[len(p) + 1 for p in parts]])
    return words, np.diff(np.searchsorted(starts, begins))


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, in order, and the number of words of each text."""
    hashes, counts = [np.zeros(0, _U)], np.zeros(len(texts), np.int64)
    held: list[bytes] = []
    owner: list[int] = []
    size = 0

    def flush() -> None:
        nonlocal held, owner, size
        if held:
            words, n = _hash_parts(held)
            hashes.append(words)
            np.add.at(counts, owner, n)
        held, owner, size = [], [], 0

    for i, text in enumerate(texts):
        for part in _parts(text.translate(_FOLD)):
            held.append(part)
            owner.append(i)
            size += len(part)
            if size >= CHUNK:
                flush()
    flush()
    return np.concatenate(hashes), counts


def sets(texts: list[bytes], width: int = WIDTH) -> list[np.ndarray]:
    """Each text's distinct shingles as sorted 64-bit hashes; of fewer words, the whole sequence; of none, nothing."""
    words, counts = word_hashes(texts)
    by = odd_numbers(width, 5)
    whole = np.zeros(max(0, len(words) - width + 1), _U)
    for j in range(width):
        whole += words[j : j + len(whole)] * by[j]
    whole = mix(whole)
    out, at = [], 0
    for n in counts.tolist():
        if n >= width:
            out.append(np.unique(whole[at : at + n - width + 1]))
        elif n:
            out.append(mix((words[at : at + n] * by[:n]).sum(dtype=_U, keepdims=True) + np.array([n], _U) * _U(_BASE)))
        else:
            out.append(np.zeros(0, _U))
        at += n
    return out


def minima(sets_: list[np.ndarray], functions: int, seed: int = 11) -> np.ndarray:
    """A row for each set, none empty, with the smallest value of each hash function over it."""
    flat = np.concatenate(sets_)
    starts = np.cumsum([0, *[len(s) for s in sets_]])[:-1]
    by, plus = odd_numbers(functions, seed), odd_numbers(functions, seed + 1)
    out = np.empty((len(sets_), functions), _U)
    for k in range(functions):
        out[:, k] = np.minimum.reduceat(flat * by[k] + plus[k], starts)
    return out
