"""Sum-of-squares online packing of tokenised documents into windows of a fixed length.

Each task reads its documents as a stream and keeps one level array: the number of partially filled
windows at every fill level. A document's remainder (what is left after its full windows) goes to the
level that makes the sum of squared counts smallest, a new window being level 0. Windows that are full
are emitted at once, so a task holds its open windows only. When its stream ends, the fullest open windows
are topped up with what the emptiest hold, cut where a window is full: windows keep what placement gave them, and a
task leaves one padded window at most. No exchange is needed at any scale.

Defined results: a null or empty text is one sequence piece holding the end id alone; repeated rows and
repeated ids are packed as separate documents; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame

from sievelake.llm.common import give_back, small_batches

WINDOW = 4096
END_ID = 2
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"

#: Words that can be split here, and how the tokenizer splits them after lower-casing (fixed by its file).
PLAIN = re.compile(r"[\x21-\x7E\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u00FF]*").fullmatch
PARTS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00DF-\u00F6\u00F8-\u00FF]+|[0-9]|[^\sa-z0-9\u00DF-\u00F6\u00F8-\u00FF]+").findall

_encoders: dict[str, "WordEncoder"] = {}


class WordEncoder:
    """Token ids of whole texts, word by word, with bounded tables of known words and of their parts.

    The tokenizer drops white space and none of its rules reaches over a space or a line feed, so the ids
    of a text are those of its parts between them. A word of ASCII and of precomposed Latin-1 letters is
    lower-cased and split here as the tokenizer's own rules do it, and its parts go to the tokenizer's merge
    model; any other word goes through the whole tokenizer. ``tests/llm`` holds both against whole texts.

    The tables hold words of up to ``longest`` characters, so their numbers bound their bytes; a table that is full is
    emptied, which costs time and changes no result.
    """

    def __init__(self, path: str, most_words: int = 400_000, most_parts: int = 300_000, longest: int = 48):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.merge = self.tokenizer.model.tokenize
        self.most_words, self.most_parts, self.longest = most_words, most_parts, longest
        self.words: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}
        self.id_bytes = [i.to_bytes(4, "little") for i in range(self.tokenizer.get_vocab_size())]
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in shown]
        self.as_text = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}

    def part(self, part: str) -> bytes:
        got = self.parts.get(part)
        if got is None:
            text = part if part.isascii() else "".join(map(self.as_text.__getitem__, part.encode()))
            got = b"".join([self.id_bytes[t.id] for t in self.merge(text)])
            if len(part) <= self.longest:
                if len(self.parts) >= self.most_parts:
                    self.parts.clear()
                self.parts[part] = got
        return got

    def learn(self, words: set[str]) -> None:
        """Puts all of the words into the table, which may be emptied before."""
        new = words.difference(self.words)
        if len(self.words) + len(new) > self.most_words:
            self.words.clear()
            new = words
        odd = []
        for word in new:
            if PLAIN(word) and "<|" not in word:
                self.words[word] = b"".join(map(self.part, PARTS(word.lower())))
            else:
                odd.append(word)
        if odd:
            for word, got in zip(odd, self.tokenizer.encode_batch_fast(odd, add_special_tokens=False), strict=True):
                self.words[word] = np.array(got.ids, dtype="<u4").tobytes()

    def encode(self, texts: list[str], portion: int = 50_000) -> list[bytes]:
        """The ids of each text; its words are looked up in portions, so that a long text needs no table of its own size."""
        out, at = [[] for _ in texts], 0
        queue: list[tuple[int, list[str]]] = []
        for i, text in enumerate(texts):
            words = text.replace("\n", " ").split(" ")
            for a in range(0, len(words), portion):
                part = words[a : a + portion]
                queue.append((i, part))
                at += len(part)
                if at >= portion:
                    self._emit(queue, out)
                    queue, at = [], 0
        self._emit(queue, out)
        return [b"".join(x) for x in out]

    def _emit(self, queue: list[tuple[int, list[str]]], out: list[list[bytes]]) -> None:
        words = set().union(*[part for _, part in queue])
        self.learn(words)
        for i, part in queue:
            out[i].append(b"".join(map(self.words.__getitem__, part)))
        for word in words:
            if len(word) > self.longest:
                del self.words[word]


def encoder(path: str) -> WordEncoder:
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


class Packer:
    """The level array and the open windows of one task; ``add`` yields the windows that it completes.

    A window is a list of pieces (document, start, length, document's ids, ids as bytes). ``placed`` counts the windows
    that placement completes, ``topped`` those that ``finish`` tops up, ``own`` the full ones of long documents.
    """

    def __init__(self, window: int = WINDOW):
        self.window = window
        self.count = np.zeros(window + 1, dtype=np.int64)
        self.open: dict[int, list[list]] = {}
        self.own = self.placed = self.topped = 0

    def add(self, doc, ids: bytes) -> Iterator[list]:
        total, at = len(ids) // 4, 0
        while total - at >= self.window:
            self.own += 1
            yield [(doc, at, self.window, total, ids[4 * at : 4 * (at + self.window)])]
            at += self.window
        if at < total:
            full = self.place((doc, at, total - at, total, ids[4 * at :]))
            if full:
                self.placed += 1
                yield full

    def best_level(self, size: int) -> int:
        """The level whose use changes the sum of squares least; among equals the fullest."""
        last = self.window - size
        before, after = self.count[: last + 1], self.count[size:].copy()
        after[last] = 0  # a full window leaves the array
        change = 2 * (after - before) + 2
        change[last] -= 1
        change[0] = 2 * after[0] + 1
        usable = before > 0
        usable[0] = True
        change = np.where(usable, change, np.iinfo(np.int64).max)
        return last - int(np.argmin(change[::-1]))

    def place(self, piece: tuple) -> list | None:
        size = piece[2]
        level = self.best_level(size)
        if level:
            held = self.open[level].pop()
            self.count[level] -= 1
        else:
            held = []
        held.append(piece)
        level += size
        if level == self.window:
            return held
        self.count[level] += 1
        self.open.setdefault(level, []).append(held)
        return None

    def finish(self) -> Iterator[list]:
        """The open windows, the fullest first, each topped up with pieces of the emptiest; the last may stay short."""
        left = [(level, held) for level in sorted(self.open) for held in self.open[level]]
        first = 0  # the emptiest that still has pieces
        while first < len(left):
            level, row = left.pop()
            while level < self.window and first < len(left):
                size, held = left[first]
                doc, start, length, total, ids = held.pop()
                part = min(length, self.window - level)
                row.append((doc, start, part, total, ids[: 4 * part]))
                level += part
                if part < length:
                    held.append((doc, start + part, length - part, total, ids[4 * part :]))
                left[first] = (size - part, held)
                first += not held
            self.topped += 1
            yield row
        self.open = {}
        self.count[:] = 0


def pack_documents(
    docs: DataFrame, tokenizer: str, *, window: int = WINDOW, end_id: int = END_ID, with_ids: bool = False, doc_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per piece: its document, place there, place in its sequence, CRC-32 and, on request, its ids.

    ``tokenizer`` is the path of a tokenizer file that every executor can read.
    """
    end = np.array([end_id], dtype="<u4").tobytes()
    small_batches(docs.sparkSession)

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        words, packer, base, serial = encoder(tokenizer), Packer(window), TaskContext.get().partitionId() << 36, 0

        def rows(windows):
            nonlocal serial
            cols = [[] for _ in range(8)]
            for pieces in windows:
                at = 0
                for doc, start, length, total, ids in pieces:
                    for c, v in zip(cols, (doc, start, length, zlib.crc32(ids), total, base + serial, at, ids), strict=True):
                        c.append(v)
                    at += length
                serial += 1
            arrays = [pa.array(c, pa.int64()) for c in cols[:7]] + ([pa.array(cols[7], pa.binary())] if with_ids else [])
            return pa.RecordBatch.from_arrays(arrays, names)

        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] + ["ids"] * with_ids
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                part = batch.slice(i, 64)
                texts = [t or "" for t in part.column(1).to_pylist()]
                done = [w for doc, ids in zip(part.column(0).to_pylist(), words.encode(texts), strict=True) for w in packer.add(doc, ids + end)]
                if done:
                    yield rows(done)
        if last := list(packer.finish()):
            yield rows(last)
        give_back()

    return docs.select(docs[doc_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text")).mapInArrow(run, SCHEMA + ", ids binary" * with_ids)
