"""The vocabulary that the queries encode with."""

from __future__ import annotations

import public_tokenizers


def vocabulary_path() -> str:
    """The byte-level vocabulary; its folder is installed on every machine."""
    return public_tokenizers.path("byte_bpe_50k.json")
