"""Token ids of a byte-level BPE file for texts of any length, in bounded memory."""

from __future__ import annotations

import json
import re

import numpy as np

#: How such files cut a text into words before merging (fixed by the tokenizer).
WORDS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: A blank between two other characters always begins a word of its own.
BORDER = re.compile(r"(?<=\S) (?=\S)").search
#: Words and runs of white space of so many characters go to the tokenizer itself: tiktoken's time grows with a word's square, its stack with a run.
RUN = 2000
BLANKS = re.compile(rf"\s{{{RUN}}}").search

_encoders: dict[str, "ByteEncoder"] = {}


class ByteEncoder:
    """``encode`` gives a text's ids as little-endian unsigned 32-bit numbers, as the file's tokenizer does for whole texts.

    The file's merges are run by tiktoken, which takes a third of the time; a token's rank is its id. Texts are taken in blocks of
    some ``block`` characters, cut where a word begins. Strings that the file adds as tokens of their own are found first.
    """

    def __init__(self, path: str, block: int = 1 << 18):
        import tiktoken
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        as_byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
        self.added = {t["content"]: t["id"].to_bytes(4, "little") for t in file["added_tokens"]}
        ranks = {bytes(as_byte[c] for c in token): i for token, i in file["model"]["vocab"].items() if token not in self.added}
        self.merges = tiktoken.Encoding("bytes", pat_str=WORDS, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.whole = Tokenizer.from_file(path)
        self.around = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.block = block

    def encode(self, text: str) -> bytes:
        parts = self.around.split(text) if any(t in text for t in self.added) else [text]
        return b"".join([self.added[part] if i % 2 else b"".join(map(self.known, self.blocks(part))) for i, part in enumerate(parts)])

    def blocks(self, text: str):
        at = 0
        while len(text) - at > self.block:
            border = BORDER(text, at + self.block)
            if not border:
                break
            yield text[at : border.start()]
            at = border.start()
        if at < len(text):
            yield text[at:]

    def known(self, block: str) -> bytes:
        if len(block) >= RUN and (max(map(len, block.split()), default=0) >= RUN or BLANKS(block)):
            return np.array(self.whole.encode(block, add_special_tokens=False).ids, dtype="<u4").tobytes()
        return np.array(self.merges(block), dtype="<u4").tobytes()


def byte_encoder(path: str) -> ByteEncoder:
    if path not in _encoders:
        _encoders[path] = ByteEncoder(path)
    return _encoders[path]
