"""Public vocabularies, read on the driver; jobs carry their bytes and make each encoder once per worker."""

from __future__ import annotations

import base64
import os
from array import array
from collections.abc import Callable, Iterable, Sequence

TOKENIZERS = "/opt/tokenizers"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def file_bytes(name: str, folder: str = TOKENIZERS) -> bytes:
    with open(os.path.join(folder, name), "rb") as f:
        return f.read()


def read_ranks(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line)}


def sliced(texts: Sequence[str], most: int = 500_000) -> Iterable[tuple[int, int]]:
    """Ranges of texts of about so many characters at most, one text at least."""
    start = size = 0
    for i, x in enumerate(texts):
        if size and size + len(x) > most:
            yield start, i
            start, size = i, 0
        size += len(x)
    if start < len(texts):
        yield start, len(texts)


_made: dict[tuple[str, int], Callable[[str], bytes]] = {}


def byte_tokens(ranks: bytes) -> Callable[[str], bytes]:
    """Packed uint16 ids of a text, by a byte-level vocabulary of fewer than 65,536 ids."""
    key = ("byte", hash(ranks))
    if key not in _made:
        import tiktoken

        enc = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=read_ranks(ranks), special_tokens={})
        _made[key] = lambda s: array("H", enc.encode_ordinary(s)).tobytes()
    return _made[key]


def piece_tokens(model: bytes):
    """The processor of a sentence-piece vocabulary with byte fallback, and which of its ids are bytes."""
    import numpy as np

    key = ("piece", hash(model))
    if key not in _made:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        _made[key] = sp, np.array([sp.is_byte(i) for i in range(sp.vocab_size())])
    return _made[key]
