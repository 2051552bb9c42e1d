"""Byte-pair token ids of whole texts, from a public vocabulary file."""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np

VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
# Fixed value: how this public vocabulary's encoder cuts texts before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Texts are encoded in pieces of about this many characters.
PIECE = 1 << 16
_CUT = re.compile(r"(?<=\S) (?=\S)")


def load(path: str = VOCABULARY) -> bytes:
    """The vocabulary file, to be sent to the tasks; it has a fixed size."""
    with open(path, "rb") as file:
        return file.read()


_ENCODINGS: dict[int, object] = {}


def encoding(vocabulary: bytes):
    """The encoder of a vocabulary file, made once per process."""
    key = hash(vocabulary)
    if key not in _ENCODINGS:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines()) if a}
        _ENCODINGS[key] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENCODINGS[key]


def pieces(text: str, limit: int = PIECE) -> Iterator[str]:
    """``text`` cut before single spaces between words, where the encoder cuts in any case."""
    start = 0
    while len(text) - start > limit:
        cut = _CUT.search(text, start + limit)
        if not cut:
            break
        yield text[start : cut.start()]
        start = cut.start()
    yield text[start:]


def encode(encoder, text: str) -> np.ndarray:
    return np.concatenate(
        [np.array(encoder.encode_ordinary(p), dtype=np.uint16) for p in pieces(text)]
    )
