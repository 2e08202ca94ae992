"""Byte-level BPE from a tokenizers file: loading, pre-tokens and byte pieces, inside tasks."""

from __future__ import annotations

import functools
import json
import os

import regex

#: How the byte-level pre-tokenizer splits text. Fixed value of the public vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Up to here `regex` and the tokenizers library class all characters alike; texts with others are split by the library.
_BEYOND = regex.compile("[^\\x00-\\u052f\\u2000-\\u206f\\u20a0-\\u20bf\\u3000-\\u30ff\\u4e00-\\u9fa5\\uac00-\\ud7a3]")
_SPLIT = regex.compile(PATTERN)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _alphabet() -> dict[str, int]:
    """The printable stand-ins of bytes in byte-level vocabularies: printable Latin-1 characters stand for themselves, the rest follow from 256 on."""
    own = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """What a tokenizers JSON file holds: bytes of each id, ids of byte strings, special strings."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            raw = json.load(f)
        to_byte = _alphabet()
        special = {t["content"]: t["id"] for t in raw.get("added_tokens", [])}
        self.special = special
        self.id_of = {bytes(to_byte[c] for c in t): i for t, i in raw["model"]["vocab"].items() if t not in special}
        self.bytes_of = {i: b for b, i in self.id_of.items()} | {i: t.encode() for t, i in special.items()}
        self.longest = max(map(len, self.id_of))
        self.special_pattern = regex.compile("|".join(map(regex.escape, special))) if special else None
        self._from_byte = {b: c for c, b in to_byte.items()}
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in raw["model"]["merges"]]
        made = [raw["model"]["vocab"]["".join(m)] for m in merges]
        self.ids_are_ranks = made == sorted(made)  # then the lowest id is merged first

    def merge(self, word: bytes) -> list[int]:
        """The ids of one pre-token, merged by the library's model."""
        return [t.id for t in self.library.model.tokenize("".join(self._from_byte[b] for b in word))]

    def fast(self):
        """An encoder that gives the library's ids, faster; see tests for the comparison."""
        import tiktoken

        if not self.ids_are_ranks:
            raise ValueError("ids of this vocabulary don't follow the order of its merges")
        return tiktoken.Encoding("byte-level", pat_str=PATTERN, mergeable_ranks=self.id_of, special_tokens=self.special)

    def split(self, text: str) -> list[str]:
        """Pre-tokens of a text without special strings."""
        if _BEYOND.search(text) is None:
            return _SPLIT.findall(text)
        return [text[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(text)]


@functools.lru_cache(2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)
