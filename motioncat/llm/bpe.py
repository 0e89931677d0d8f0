"""Byte-level BPE vocabularies as rank tables."""

from __future__ import annotations

import base64
import json
import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import public_tokenizers
import regex
import tiktoken

RANKS = "byte_bpe_50k.tiktoken"
TOKENIZER = "byte_bpe_50k.json"
PATTERN = regex.compile(public_tokenizers.PATTERN.replace(r"^\s", r"^\p{White_Space}").replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))
# Unicode's white space; chunks are runs of other characters with one space before them, and white space as the pattern cuts it.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
CHUNKS = re.compile(rf" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
# From here on a text is split before the library sees it, whose own splitting ends a process on a very long run.
LONG_TEXT = 200_000

EncodeText = Callable[[str], np.ndarray]


class Vocabulary:
    """Ranks of the tokens of a ``.tiktoken`` file, and the bytes behind each id."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as lines:
            pairs = (line.split() for line in lines if line.strip())
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in pairs}
        self.tokens = [b""] * (1 + max(self.ranks.values()))
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.sizes = np.array([len(t) for t in self.tokens], dtype=np.int64)


@lru_cache(maxsize=4)
def vocabulary(path: str | None = None) -> Vocabulary:
    return Vocabulary(path or public_tokenizers.path(RANKS))


@lru_cache(maxsize=1)
def added_tokens() -> dict[str, int]:
    """Ids of the tokens that the tokenizers library cuts out of a text before all else."""
    with open(public_tokenizers.path(TOKENIZER), encoding="utf-8") as held:
        return {t["content"]: t["id"] for t in json.load(held)["added_tokens"]}


def library_encoder(path: str | None = None, added: bool = False) -> EncodeText:
    """Ids of a text by the tiktoken library; with ``added`` those of the tokenizers library, which knows added tokens."""
    special = added_tokens() if added else {}
    library = tiktoken.Encoding("text", pat_str=public_tokenizers.PATTERN, mergeable_ranks=vocabulary(path).ranks, special_tokens=special)
    cuts = re.compile("(" + "|".join(map(re.escape, special)) + ")") if special else None

    def pieces(text: str) -> Iterator[list[int]]:
        for k, part in enumerate(cuts.split(text) if cuts else [text]):
            if k % 2:
                yield [special[part]]
            else:
                for word in PATTERN.findall(part):
                    yield library._encode_single_piece(word)

    def encode(text: str) -> np.ndarray:
        if len(text) >= LONG_TEXT:
            return np.fromiter(chain.from_iterable(pieces(text)), "<u4")
        return np.array(library.encode(text, allowed_special="all") if added else library.encode_ordinary(text), dtype="<u4")

    return encode
