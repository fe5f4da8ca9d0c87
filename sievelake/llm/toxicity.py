"""Noisy-channel deobfuscation, then a linear score of the restored words.

1. A character model (three letters) is counted over every document: 27 * 27 * 27 counts a task, whatever its
   rows, summed by index.
2. A token that isn't plain letters, or has a letter twice or more in a row, is a lattice: each symbol may stand for letters
   (leetspeak), a repeated symbol for one or two of them, a separator for nothing. Viterbi decoding takes the path of
   the best channel and model score; where the token can be read plainly too, both readings count. Runs of single
   characters are decoded as one token.
3. A logistic model of restored words is fitted to at most ``fit_rows`` labelled rows, taken by the hash of their
   ids. Its words are all that stand more often in toxic rows of the sample than chance explains (``least_gain``: half of the
   likelihood ratio; 2.5 is a chance of one in forty). The sample's size bounds what the driver holds; the
   fitted weights are sent to the tasks that score.

Defined results: null and empty texts score as the model does without words; a row without an id counts as held
out; labels of unknown ids, without a value or held out are not used; without usable labels every score is that
of the smoothed share of toxic rows; repeated rows give equal scores; other columns are ignored.
"""

from __future__ import annotations

import math
import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievelake.llm.common import Workspace, give_back

#: Tables remember tokens of up to so many characters, so that their numbers bound their bytes.
LONGEST = 48
SIDE = 27  # the letters, and what separates words
#: What a symbol may stand for besides itself (fixed values of the channel).
SIGNS = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "<": "c", "€": "e", "£": "l", "µ": "u",
}
SEPARATORS = set(".-_*~'`^​‌‍­ ")
SPACED = re.compile(r"(?<!\w)\w(?:[ .\-*]{1,2}\w(?!\w)){2,}").finditer
TWICE, THRICE = re.compile(r"(\w)\1").search, re.compile(r"(\w)\1\1").search
EDGE = " .,;:!?\"'()[]{}<>|%&#*$~`^_-+=/\\"
CLASS = np.full(256, 26, np.int32)
CLASS[97:123] = CLASS[65:91] = np.arange(26)


class Channel:
    """Viterbi decoding of one token under a character model (log-probabilities of the third letter)."""

    SIGN, DOUBLE, DROP = -1.0, -1.5, -0.3

    def __init__(self, counts: np.ndarray):
        grown = counts.reshape(SIDE, SIDE, SIDE).astype(np.float64) + 0.05
        self.log = np.log(grown / grown.sum(axis=2, keepdims=True)).tolist()

    def options(self, sign: str, n: int) -> list[tuple[str, float]]:
        if sign in SEPARATORS:
            return [("", self.DROP * n)]
        letters = [(sign, 0.0)] if sign.isalpha() else [(c, self.SIGN) for c in SIGNS.get(sign, "")]
        if not letters:
            return [("", 2 * self.DROP * n)]
        return letters if n == 1 else [*letters, *((2 * c, p + self.DOUBLE * (n > 2)) for c, p in letters)]

    def decode(self, token: str) -> str:
        paths = {(26, 26): (0.0, "")}
        at = 0
        while at < len(token):
            sign, n = token[at], 1
            while at + n < len(token) and token[at + n] == sign:
                n += 1
            at += n
            new: dict[tuple[int, int], tuple[float, str]] = {}
            for letters, cost in self.options(sign, n):
                for (a, b), (score, text) in paths.items():
                    score += cost
                    for c in letters:
                        code = ord(c) - 97 if "a" <= c <= "z" else 26
                        score += self.log[a][b][code]
                        a, b = b, code
                    if (a, b) not in new or new[a, b][0] < score:
                        new[a, b] = (score, text + letters)
            paths = new
        return max((score + self.log[a][b][26], text) for (a, b), (score, text) in paths.items())[1]


def tokens_of(text: str) -> set[str]:
    """The different tokens of a text in lower case; runs of single characters are one more."""
    text = text.lower()
    tokens = set(text.split())
    for m in SPACED(text):
        tokens.add(re.sub(r"[ .\-*]+", " ", m[0]))
    return tokens


class Restorer:
    """Restored words of texts, with a bounded table of known tokens."""

    def __init__(self, channel: Channel, most: int = 100_000):
        self.channel, self.most, self.known = channel, most, {}

    def token(self, token: str) -> tuple[str, ...]:
        got = self.known.get(token)
        if got is None:
            got = self.read(token)
            if len(token) <= LONGEST:
                if len(self.known) >= self.most:
                    self.known.clear()
                self.known[token] = got
        return got

    def read(self, token: str) -> tuple[str, ...]:
        core = token.strip(EDGE)
        if core.isalpha():
            twice = TWICE(core)
            out = {core} if not twice else {self.channel.decode(core)} if THRICE(core) else {core, self.channel.decode(core)}
        elif any(c.isalpha() for c in core):
            out = {self.channel.decode(core), *(w for w in re.split(r"[\W_]+", core) if len(w) > 1)}
        else:
            out = {core, self.channel.decode(core)} if any(c in SIGNS for c in core) else {core}
        if core and len(core) < len(token) and any(c in SIGNS for c in (token.lstrip(EDGE)[len(core) :][:1], token[: -len(core)][-1:]) if c):
            out.add(self.channel.decode(token.strip(".,;:?\"'")))  # a sign at an end may be a letter
        return tuple(out - {""})

    def words(self, text: str) -> set[str]:
        out: set[str] = set()
        for t in tokens_of(text):
            out.update(self.token(t))
        return out


def letter_counts(docs: DataFrame) -> np.ndarray:
    """Counts of three letters in a row over all texts."""

    def run(batches):
        import pyarrow as pa

        counts = np.zeros(SIDE**3, np.int64)
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                text = "  ".join(t or "" for t in batch.column(0).slice(i, 256).to_pylist())
                c = CLASS[np.frombuffer(f"  {text}  ".encode(), np.uint8)]
                code = (c[:-2] * SIDE + c[1:-1]) * SIDE + c[2:]
                counts += np.bincount(code, minlength=len(counts))
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[at])], ["code", "n"])
        give_back()

    found = docs.select("text").mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))
    out = np.zeros(SIDE**3, np.int64)
    for r in found.collect():
        out[r["code"]] = r["n"]
    return out


def fit(rows: list[np.ndarray], label: np.ndarray, words: int, penalty: float = 0.2, steps: int = 400) -> tuple[np.ndarray, float]:
    """Weights and intercept of a logistic model on sets of word numbers, by gradient steps with momentum."""
    n = len(rows)
    col = np.concatenate(rows) if n else np.zeros(0, np.int64)
    row = np.repeat(np.arange(n), [len(r) for r in rows])
    share = (label.sum() + 0.5) / (n + 2)
    weight, bias = np.zeros(words), math.log(share / (1 - share))
    if not n or label.min() == label.max():
        return weight, bias
    seen = np.bincount(col, minlength=words)
    rate, speed, speed_b = 1.0 / (0.25 * np.maximum(seen, 1) * 3 + penalty), np.zeros(words), 0.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(bias + np.bincount(row, weight[col], minlength=n), -30, 30)))
        miss = label - p
        speed = 0.9 * speed + rate * (np.bincount(col, miss[row], minlength=words) - penalty * weight)
        speed_b = 0.9 * speed_b + miss.sum() / (0.25 * n * 3)
        weight, bias = weight + speed * 0.3, bias + speed_b * 0.3
    return weight, bias


def cut(rows: list[np.ndarray], label: np.ndarray, words: int, parts: int = 5) -> float:
    """The log-odds from which rows count as toxic: the best F1 of scores that models without the rows' own part give."""
    if len(rows) < 10 * parts or label.min() == label.max():
        return 0.0
    part, score = np.arange(len(rows)) % parts, np.zeros(len(rows))
    for p in range(parts):
        weight, bias = fit([r for r, q in zip(rows, part, strict=True) if q != p], label[part != p], words)
        for i in np.flatnonzero(part == p):
            score[i] = bias + weight[rows[i]].sum()
    order = np.argsort(-score, kind="stable")
    hits = np.cumsum(label[order])
    best = int(np.argmax(2 * hits / (np.arange(1, len(rows) + 1) + label.sum())))
    after = score[order[best + 1]] if best + 1 < len(rows) else score[order[best]]
    return float(np.clip((score[order[best]] + after) / 2, -3.0, 0.0))


class Scorer:
    """A fitted model: scores of texts, with a bounded table of known tokens."""

    def __init__(self, restorer: Restorer, weights: dict[str, float], bias: float, most: int = 100_000):
        self.restorer, self.weights, self.bias, self.most, self.known = restorer, weights, bias, most, {}

    def worth(self, token: str) -> tuple[str, ...]:
        got = self.known.get(token)
        if got is None:
            got = tuple(w for w in self.restorer.read(token) if w in self.weights)
            if len(token) <= LONGEST:
                if len(self.known) >= self.most:
                    self.known.clear()
                self.known[token] = got
        return got

    def score(self, text: str | None) -> float:
        hit: set[str] = set()
        for t in tokens_of(text or ""):
            if w := self.worth(t):
                hit.update(w)
        x = self.bias + sum(self.weights[w] for w in sorted(hit))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, x))))


def is_held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(True))


def fit_toxicity(docs: DataFrame, labels: DataFrame, *, fit_rows: int = 20_000, least_gain: float = 2.5, id_col: str = "doc_id", text_col: str = "text") -> Scorer:
    """The model that labels outside the held-out part give; its character model covers all of ``docs``."""
    spark = docs.sparkSession
    ws = Workspace(spark, "toxicity")
    docs = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    usable = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).filter("toxic is not null and doc_id is not null").filter(~is_held_out())
    usable = usable.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    share = min(1.0, fit_rows / max(1, usable.count()))
    sample = usable.filter(F.shiftrightunsigned(F.xxhash64("doc_id"), 11) < int(share * (1 << 53)))

    restorer = Restorer(Channel(letter_counts(docs)))

    def restored(batches):
        import pyarrow as pa

        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                words = [sorted(restorer.words(t or "")) for t in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(words, pa.list_(pa.string()))], ["doc_id", "toxic", "words"])
        restorer.known.clear()
        give_back()

    # the sample has fit_rows rows at most (give or take the spread of a hash), so it is sent to where the texts are; rows that repeat an id
    # give one of their texts, the least, so that the bound holds for what is collected too
    texts = docs.join(F.broadcast(sample), "doc_id").groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min("text").alias("text"))
    read = texts.select("doc_id", "toxic", "text").mapInArrow(restored, "doc_id long, toxic int, words array<string>")
    read = ws.keep(read, "sample")
    n1, n0 = read.agg(F.coalesce(F.sum("toxic"), F.lit(0)), F.coalesce(F.sum(1 - F.col("toxic")), F.lit(0))).first()
    a, b = F.col("a"), F.col("b")
    gain = sum(x * F.log((x + 0.5) / ((a + b) * (n / max(1, n0 + n1)) + 0.5)) for x, n in ((a, n1), (b, n0)))
    found = read.select("toxic", F.explode("words").alias("word")).groupBy("word").agg(F.sum("toxic").alias("a"), F.sum(1 - F.col("toxic")).alias("b")).filter(gain >= least_gain)
    words = sorted(r["word"] for r in found.select("word").collect())
    number = {w: i for i, w in enumerate(words)}
    picked = read.orderBy(F.xxhash64("doc_id")).select("toxic", F.array_intersect("words", F.lit(words or [""])).alias("words")).collect()
    rows = [np.array([number[w] for w in r["words"] if w in number], dtype=np.int64) for r in picked]
    label = np.array([r["toxic"] for r in picked], dtype=np.float64)
    weight, bias = fit(rows, label, len(words))
    bias -= cut(rows, label, len(words))
    weights = {w: float(x) for w, x in zip(words, weight, strict=True)}

    return Scorer(restorer, weights, bias)


def score_toxicity(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """Per document: id, whether its label is held out of the fit, score in 0 to 1, and 1 for scores from a half."""
    scorer = fit_toxicity(docs, labels, id_col=id_col, text_col=text_col, **settings)

    def scored(batches):
        import pyarrow as pa

        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([scorer.score(t) for t in part.column(1).to_pylist()], pa.float64())], ["doc_id", "score"])
        scorer.known.clear()
        give_back()

    out = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text")).mapInArrow(scored, "doc_id long, score double")
    return out.select("doc_id", is_held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, *, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """The documents, all columns, that score under the threshold."""
    scorer, at = fit_toxicity(docs, labels, id_col=id_col, text_col=text_col, **settings), docs.columns.index(text_col)

    def kept(batches):
        import pyarrow as pa

        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                yield part.filter(pa.array([scorer.score(t) < threshold for t in part.column(at).to_pylist()], pa.bool_()))
        scorer.known.clear()
        give_back()

    return docs.mapInArrow(kept, docs.schema)
