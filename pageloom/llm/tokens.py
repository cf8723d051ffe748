"""Byte-level BPE ids of whole texts, for packing and token counts.

The vocabulary is a public tokenizer file whose path is a parameter; nothing is trained or copied.
"""

from __future__ import annotations

import json

import numpy as np

from pageloom.llm.common import cached

# Fixed value: the split pattern of this kind of vocabulary.
BYTE_LEVEL_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in the file: itself, or the next free one from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return {chr(b if b in shown else next(spare)): b for b in range(256)}


class ByteBpe:
    """ids(text): a uint32 array, equal to Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids.

    Where merges stand in the order of their ids, a rank encoder gives the same ids several times as fast; any other
    file goes through its own library. With specials=False, special strings in a text are ordinary text.
    """

    def __init__(self, path: str, specials: bool = True):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, added = spec["model"], {t["content"]: t["id"] for t in spec["added_tokens"]}
        letters = _byte_letters()
        vocab = {k: v for k, v in model["vocab"].items() if k not in added}
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        plain = (
            model["type"] == "BPE"
            and spec["normalizer"] is None
            and (spec["pre_tokenizer"] or {}).get("type") == "ByteLevel"
            and not spec["pre_tokenizer"].get("add_prefix_space")
            and spec["pre_tokenizer"].get("use_regex", True)
            and all(model["vocab"].get("".join(m)) == 256 + i for i, m in enumerate(pairs))
            and all(letters.keys() >= set(k) for k in vocab)
        )
        if plain:
            import tiktoken

            ranks = {bytes(letters[c] for c in k): v for k, v in vocab.items()}
            bpe = tiktoken.Encoding("byte_bpe", pat_str=BYTE_LEVEL_PATTERN, mergeable_ranks=ranks, special_tokens=added)
            allowed = "all" if specials else set()
            self.ids = lambda text: bpe.encode_to_numpy(text, allowed_special=allowed, disallowed_special=())
        else:
            from tokenizers import Tokenizer

            bpe = Tokenizer.from_file(path)
            bpe.encode_special_tokens = not specials
            self.ids = lambda text: np.array(bpe.encode(text, add_special_tokens=False).ids, dtype=np.uint32)


def encoder(path: str, specials: bool = True) -> ByteBpe:
    return cached(("byte_bpe", path, specials), lambda: ByteBpe(path, specials))
