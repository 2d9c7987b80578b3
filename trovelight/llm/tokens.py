"""Byte-level BPE vocabularies from files, as encoders for tasks."""

from __future__ import annotations

import base64
import json
from collections.abc import Callable


def byte_of_letter() -> dict[str, int]:
    """The letters that byte-level vocabularies write bytes as: visible Latin-1 bytes as themselves, the
    others, in order, as the letters from 256 on."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in visible]
    return {chr(b): b for b in visible} | {chr(256 + n): b for n, b in enumerate(hidden)}


def ranks_of_json(path: str) -> dict[bytes, int]:
    """The vocabulary of a byte-level BPE in the JSON form of the tokenizers library, without added tokens."""
    with open(path, encoding="utf-8") as file:
        model = json.load(file)
    added = {token["content"] for token in model.get("added_tokens", [])}
    letters = byte_of_letter()
    return {bytes(letters[c] for c in token): rank for token, rank in model["model"]["vocab"].items() if token not in added}


def ranks_of_lines(path: str) -> dict[bytes, int]:
    """The vocabulary of a file with a base64 token and its rank on every line."""
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}


def encoder_of_json(path: str, added_tokens: bool = False) -> Callable[[str], list[int]]:
    """Texts to the ids that the tokenizers library gives for the file at `path` without special tokens around them.

    With `added_tokens` the contents of the file's added tokens in a text are those tokens, as the library
    reads them unless told otherwise; else they are ordinary text. The merges run in tiktoken, which is
    several times faster for the same ids. A text that tiktoken refuses (its pattern matcher has a limit)
    or that holds an added token goes through the tokenizers library.
    """
    import public_tokenizers
    import tiktoken

    fast = tiktoken.Encoding("file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks_of_json(path), special_tokens={})
    with open(path, encoding="utf-8") as file:
        added = [token["content"] for token in json.load(file).get("added_tokens", [])] if added_tokens else []
    plain = None

    def library(text: str) -> list[int]:
        nonlocal plain
        if plain is None:
            from tokenizers import Tokenizer

            plain = Tokenizer.from_file(path)
            plain.encode_special_tokens = not added_tokens
        return plain.encode(text, add_special_tokens=False).ids

    def encode(text: str) -> list[int]:
        if any(token in text for token in added):
            return library(text)
        try:
            return fast.encode_ordinary(text)
        except BaseException as error:
            if type(error).__name__ != "PanicException" and not isinstance(error, ValueError):
                raise
            return library(text)

    return encode
