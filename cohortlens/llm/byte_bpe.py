"""Ids of a byte-level BPE vocabulary file, for the operators that tokenize whole tables."""

from __future__ import annotations

import json
import re

# The splitting pattern of byte-level BPE, and the code points of Unicode's White_Space.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SPACES = "\\x09-\\x0d\\x20\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
# The pattern's search for the end of white space recurses; longer runs are cut out beforehand.
LONG_RUN = 10_000
_LONG = re.compile(f"[{SPACES}]{{{LONG_RUN},}}")


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte: itself where printable, else the next free one from 256 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


class ByteBpe:
    """The vocabulary of a ``tokenizers`` file, merged by rank.

    ``ids`` equals the file's own tokenizer without its added special tokens' templates. Special
    tokens' strings are their ids, or ordinary text with ``plain=True``. ``token_bytes[i]`` are the
    bytes of id i.
    """

    def __init__(self, data: bytes):
        import tiktoken

        spec = json.loads(data)
        model, letters = spec["model"], byte_letters()
        if spec["normalizer"] or spec["pre_tokenizer"]["type"] != "ByteLevel" or spec["pre_tokenizer"]["add_prefix_space"]:
            raise ValueError("not a plain byte-level vocabulary")
        vocab = {bytes(letters[c] for c in token): i for token, i in model["vocab"].items()}
        merged = [vocab[bytes(letters[c] for c in "".join(pair if isinstance(pair, list) else pair.split(" ")))]
                  for pair in model["merges"]]
        if any(a >= b for a, b in zip(merged, merged[1:])):
            raise ValueError("ids do not follow the order of the merges")
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.size = 1 + max(*vocab.values(), *special.values(), 0)
        self.token_bytes = [b""] * self.size
        for token, i in [*vocab.items(), *((t.encode(), i) for t, i in special.items())]:
            self.token_bytes[i] = token
        self.special = special
        self._split = re.compile("|".join(map(re.escape, special))) if special else None
        self._bpe = tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=vocab, special_tokens={})

    def ids(self, text: str, plain: bool = False) -> list[int]:
        if self._split and not plain and (found := self._split.search(text)):
            out, at = [], 0
            while found:
                out += self._ordinary(text[at:found.start()])
                out.append(self.special[found.group()])
                at = found.end()
                found = self._split.search(text, at)
            return out + self._ordinary(text[at:])
        return self._ordinary(text)

    def _ordinary(self, text: str) -> list[int]:
        if len(text) < LONG_RUN or not _LONG.search(text):
            return self._bpe.encode_ordinary(text)
        out, at = [], 0
        for run in _LONG.finditer(text):
            # The run's last character belongs to what follows.
            end = run.end() - (run.end() < len(text))
            out += self._bpe.encode_ordinary(text[at:run.start()])
            out += self._bpe._encode_single_piece(text[run.start():end])
            at = end
        return out + self._bpe.encode_ordinary(text[at:])
