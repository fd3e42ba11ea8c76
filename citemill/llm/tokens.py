"""Ids of texts under a public byte-level BPE vocabulary.

The ids are those of the tokenizers library with add_special_tokens=False. tiktoken reads the same vocabulary as ranks and
gives the same ids at several times the speed, so it does the work; a text that holds the string of a special token, or one
that its regular expression can't take, goes to tokenizers itself.
"""

from __future__ import annotations

import base64
import functools

import numpy as np


def _path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@functools.cache
def _slow(json_path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(json_path)


@functools.cache
def _fast(rank_path: str):
    import public_tokenizers
    import tiktoken

    with open(rank_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("byte_bpe_50k", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@functools.cache
def _special(json_path: str) -> tuple[str, ...]:
    return tuple(t.content for t in _slow(json_path).get_added_tokens_decoder().values())


def encode(text: str | None, json_path: str | None = None, rank_path: str | None = None) -> np.ndarray:
    """Ids of a text as unsigned 32-bit numbers; null is empty."""
    if not text:
        return np.empty(0, np.uint32)
    json_path = json_path or _path("byte_bpe_50k.json")
    if not any(s in text for s in _special(json_path)):
        try:
            return np.array(_fast(rank_path or _path("byte_bpe_50k.tiktoken")).encode_ordinary(text), np.uint32)
        except Exception as error:  # a pattern that backtracks too far over a huge run of blanks
            if "fancy" not in repr(error).lower() and "backtrack" not in repr(error).lower() and not isinstance(error, ValueError):
                raise
    return np.array(_slow(json_path).encode(text, add_special_tokens=False).ids, np.uint32)
