"""Vocabulary files of public byte-level BPE tokenizers: a base64 token and its rank a line. Their paths are parameters."""

from __future__ import annotations

import base64
from pathlib import Path

import regex as re

#: The installed vocabulary that is used where no path is given.
DEFAULT = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How that tokenizer cuts a text before byte pairs are merged.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def ranks(content: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, content.splitlines())}


def whole_words(path: str = DEFAULT) -> frozenset[str]:
    """The tokens that are whole lower-case words: letters only, behind a space. A fixed dictionary that doesn't depend on
    any corpus; it also holds frequent beginnings of words."""
    found = set()
    for token in ranks(Path(path).read_bytes()):
        try:
            text = token.decode()
        except UnicodeDecodeError:
            continue
        if re.fullmatch(r" \p{L}+", text):
            found.add(text[1:].casefold())
    return frozenset(found)
