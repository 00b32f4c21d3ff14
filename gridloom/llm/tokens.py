"""Token ids of the public byte-level vocabulary, as numpy arrays.

The ids are those of the `tokenizers` library with the JSON vocabulary. The rank file holds the same vocabulary and
its library is about five times as fast, so it is used where ranks are given. Tests hold both against each other, also on
very long runs. The added tokens of the JSON are split off first and get their own ids, as the library does by default.
"""

from __future__ import annotations

import base64
import json
from functools import lru_cache

import numpy as np

from gridloom.llm.common import vocabulary_path

BYTE_BPE = "byte_bpe_50k.json"
BYTE_BPE_RANKS = "byte_bpe_50k.tiktoken"


def _added(path: str) -> dict[str, int]:
    """Added tokens of a vocabulary file that are found in texts as they are."""
    with open(path, encoding="utf-8") as file:
        listed = json.load(file).get("added_tokens") or []
    if odd := [t["content"] for t in listed if t.get("lstrip") or t.get("rstrip") or t.get("single_word") or t.get("normalized")]:
        raise ValueError(f"added tokens with options need ranks=None: {odd}")
    return {t["content"]: t["id"] for t in listed}


@lru_cache(maxsize=4)
def _ranked(path: str, vocabulary: str):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    added = _added(vocabulary)
    ranks = {token: rank for token, rank in ranks.items() if token.decode("utf-8", "replace") not in added}
    return tiktoken.Encoding("byte-bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=added)


@lru_cache(maxsize=4)
def _library(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def library_ids(text: str, vocabulary: str = BYTE_BPE) -> np.ndarray:
    return np.asarray(_library(vocabulary_path(vocabulary)).encode(text, add_special_tokens=False).ids, dtype=np.uint32)


def token_ids(text: str, vocabulary: str = BYTE_BPE, ranks: str | None = BYTE_BPE_RANKS) -> np.ndarray:
    """Ids of one text. ``ranks`` None: only the `tokenizers` library is used (any vocabulary)."""
    if ranks is None:
        return library_ids(text, vocabulary)
    return _ranked(vocabulary_path(ranks), vocabulary_path(vocabulary)).encode_to_numpy(text, allowed_special="all")
