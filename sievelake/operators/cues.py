"""Cues in a sentence: the words and phrases of a lexicon by class, and rules that chain classes by order and distance.

A rule is data: a row of steps, each a class and how far its cue may stand behind the one before, in characters of the
same clause (0: next to it). One evaluator serves all rules, so that a rule can be read, counted and tested by itself.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import cached_property

TOKEN = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)*|\d[\d,]*(?:\.\d+)?|[^\s\w]|_")
CLAUSE_END = re.compile("[.;]")


class Lexicon:
    """Word lists by class, looked up by the first word of a phrase."""

    def __init__(self, classes: dict[str, tuple[str, ...]]):
        self.by_first: dict[str, list[tuple[tuple[str, ...], str]]] = {}
        for kind, listed in classes.items():
            for phrase in listed:
                words = tuple(TOKEN.findall(phrase.lower()))
                self.by_first.setdefault(words[0], []).append((words, kind))


@dataclass(frozen=True)
class Step:
    kind: str
    within: int = 0


class Reading:
    """A text read with a lexicon."""

    def __init__(self, text: str, lexicon: Lexicon):
        self.text, self.lexicon = text, lexicon
        self.tokens = [(m.start(), m.end(), m[0].lower()) for m in TOKEN.finditer(text)]

    @cached_property
    def cues(self) -> dict[str, list[tuple[int, int]]]:
        """Places of every class, in order."""
        out: dict[str, list[tuple[int, int]]] = {}
        words = [t[2] for t in self.tokens]
        for i, (start, _, word) in enumerate(self.tokens):
            for phrase, kind in self.lexicon.by_first.get(word, ()):
                if tuple(words[i : i + len(phrase)]) == phrase:
                    out.setdefault(kind, []).append((start, self.tokens[i + len(phrase) - 1][1]))
        return out

    def has(self, *kinds: str) -> bool:
        return any(k in self.cues for k in kinds)

    def behind(self, end: int, start: int, within: int) -> bool:
        """Whether a cue at ``start`` follows one that ends at ``end`` closely enough, in the same clause."""
        between = self.text[end:start]
        return start >= end and (not between.strip() if not within else len(between) <= within + 2 and not CLAUSE_END.search(between))

    def chain(self, *steps: Step) -> tuple[int, int] | None:
        """The place of the first chain of cues; among chains of one beginning the longest."""
        for first in self.cues.get(steps[0].kind, ()):
            ends = {first[1]}
            for step in steps[1:]:
                ends = {b for a, b in self.cues.get(step.kind, ()) if any(self.behind(e, a, step.within) for e in ends)}
            if ends:
                return first[0], max(ends)
        return None

    def said(self, *steps: Step) -> str | None:
        found = self.chain(*steps)
        return self.text[found[0] : found[1]].strip() if found else None

    def balanced(self) -> bool:
        return self.text.count("(") == self.text.count(")") and self.text.count("[") == self.text.count("]")
