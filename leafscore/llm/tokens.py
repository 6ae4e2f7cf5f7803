"""The public byte-level BPE vocabulary, loaded once per Python worker."""

from __future__ import annotations

import base64
from functools import cache
from pathlib import Path

import numpy as np

#: Name of the vocabulary; its two files hold the same ids, one per library.
VOCABULARY = "byte_bpe_50k"
#: The string in a text for which the vocabulary has a token of its own.
SPECIAL = "<|endoftext|>"


def vocabulary_path(file: str) -> str:
    """Where the installed public vocabularies keep a file."""
    import public_tokenizers

    return public_tokenizers.path(file)


@cache
def _ranks(name: str):
    import public_tokenizers
    import tiktoken

    lines = Path(vocabulary_path(f"{name}.tiktoken")).read_bytes().splitlines()
    ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@cache
def _tokenizer(name: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary_path(f"{name}.json"))


def encode(text: str, name: str = VOCABULARY) -> np.ndarray:
    """Token ids of a whole text, no special tokens added; a special token's string in the text becomes that token.

    The rank-based encoder gives the same ids several times faster (pinned by a test); texts with that string, and
    those that its pattern engine refuses, such as extremely long runs of white space, go to the other library.
    """
    if SPECIAL in text:
        return np.asarray(_tokenizer(name).encode(text, add_special_tokens=False).ids, np.uint32)
    try:
        return np.asarray(_ranks(name).encode_ordinary(text), np.uint32)
    except BaseException as refused:  # the native library's panics do not derive from Exception
        if isinstance(refused, (KeyboardInterrupt, SystemExit, GeneratorExit, MemoryError, ImportError, OSError)):
            raise
        return np.asarray(_tokenizer(name).encode(text, add_special_tokens=False).ids, np.uint32)
