"""Where the vocabulary file of the queries lies; operators take any path."""

from __future__ import annotations


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    """The place of a public vocabulary file, as the installed package gives it."""
    import public_tokenizers

    return public_tokenizers.path(name)
