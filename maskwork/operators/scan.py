"""Candidate spans of one text: rules, dictionaries and name lists.

These functions work on Python strings and code-point offsets inside Arrow batches; `engine`
turns the offsets into bytes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass, replace
from functools import cache

import regex

from ..functions.validators import check
from ..sources.demands import Facts
from ..sources.rules import Rule, compiled

__all__ = ["ListIndex", "Span", "dictionary_spans", "list_spans", "rule_spans", "word_spans", "zeros_for_os", "replace"]

ALNUM = r"[\p{Alphabetic}\p{N}]"
CJK = r"[぀-ヿ㐀-鿿가-힯]"
_DIGIT_RUN = regex.compile(rf"(?<!{ALNUM})[0-9oO]*[0-9][0-9oO]*(?!{ALNUM})")
_ZERO_LIKE = regex.compile(r"[0-9][oO]|[oO][0-9]")
_WORD = regex.compile(rf"{ALNUM}+")
_CJK = regex.compile(CJK)
_FIGURES = regex.compile(r"[0-9 ./-]+")
_NUMERIC = {"ID", "CARD", "OTHER", "PHONE"}


@dataclass(slots=True)
class Span:
    type: str
    start: int
    end: int
    confidence: float
    detector: str
    source: str
    enabled: bool = True

    def meets(self, other: Span) -> bool:
        return self.start < other.end and other.start < self.end


def zeros_for_os(text: str) -> str:
    if not _ZERO_LIKE.search(text):
        return text
    return _DIGIT_RUN.sub(lambda m: m[0].translate({111: 48, 79: 48}), text)


def rule_spans(text: str, rules: Iterable[Rule]) -> list[Span]:
    """Accepted matches of every rule; after a rejected match the search goes on one character further."""
    view = zeros_for_os(text)
    facts = Facts(view)
    views = [view, view.replace("\t", "\x01")] if "\t" in view else [view]
    out = []
    for rule in rules:
        if not facts.allow(rule.pattern, "i" in rule.flags):
            continue
        find, taken = search_of(rule.pattern, rule.flags), set()
        for hay in views:
            at = 0
            while m := find(hay, at):
                start, end = m.span()
                at = start + 1
                value = text[start:end]
                if start == end or (start, end) in taken or "\t" in value or "\x01" in hay[start:end]:
                    continue
                taken.add((start, end))
                if rule.check and not check(rule.check, value):
                    continue
                bare = rule.source == "rule" and rule.type in _NUMERIC and _FIGURES.fullmatch(value)
                out.append(Span("NUMBER" if bare else rule.type, start, end, rule.confidence, rule.id, rule.source))
                at = end
    return out


_LED = regex.compile(r"\[([^\[\]^]+)\]\[(\1[^\[\]]*)\][*+](?![?+])")


Search = Callable[[str, int], regex.Match | None]


@cache
def search_of(pattern: str, flags: str) -> Search:
    """A search for the leftmost match at or behind a place.

    Where a pattern is one character of a set and then a run of a wider set, and no match starts at
    the first such character of a run, none starts at a later one either: the run leads to the same
    places. So one attempt a run is enough, and long runs don't cost their square. A pattern with
    such a branch is searched branch by branch; the leftmost match wins, then the earlier branch.
    """
    branches = _branches(pattern)
    if not any(_LED.match(b) for b in branches):
        return compiled(pattern, flags).search
    searches = [_led_search(b, flags) for b in branches]
    if len(searches) == 1:
        return searches[0]

    def search(text: str, at: int) -> regex.Match | None:
        return min((m for find in searches if (m := find(text, at))), key=lambda m: m.start(), default=None)

    return search


def _led_search(pattern: str, flags: str) -> Search:
    whole, led = compiled(pattern, flags), _LED.match(pattern)
    if not led:
        return whole.search
    first, runs = compiled(f"[{led[1]}]", flags), compiled(f"[{led[2]}]+", flags)

    def search(text: str, at: int) -> regex.Match | None:
        for run in runs.finditer(text, at):
            if (start := first.search(text, *run.span())) and (m := whole.match(text, start.start())):
                return m
        return None

    return search


def _branches(pattern: str) -> list[str]:
    """The alternatives of a pattern outside of all groups and sets."""
    out, depth, last = [], 0, 0
    for m in regex.finditer(r"\\.|\[(?:\\.|[^\]])*\]|[()|]", pattern):
        depth += (m[0] == "(") - (m[0] == ")")
        if m[0] == "|" and not depth:
            out.append(pattern[last : m.start()])
            last = m.end()
    return [*out, pattern[last:]]


#: Letters that a dictionary term and a text may differ in.
FAMILIES = ["aàáâãäå", "cç", "eèéêë", "iìíîï", "nñ", "oòóôõö", "uùúûü", "yýÿ"]
_FAMILY = {c: f"[{f}]" for f in FAMILIES for c in f}


@cache
def term_pattern(term: str) -> tuple[regex.Pattern, bool]:
    loose = r"\s+".join("".join(_FAMILY.get(c.lower(), regex.escape(c, special_only=False)) for c in word) for word in term.split())
    return regex.compile(loose, regex.IGNORECASE), _CJK.search(term) is None


def dictionary_spans(text: str, terms: Iterable[str]) -> list[Span]:
    """Occurrences of terms, whatever their case, accents and spacing; words must stand alone."""
    out = []
    for term in sorted({t.strip() for t in terms} - {""}):
        pattern, alone = term_pattern(term)
        for m in pattern.finditer(text):
            s, e = m.span()
            if alone and (_WORD.match(text, e) or s and _WORD.match(text[s - 1])):
                continue
            out.append(Span("CUSTOM", s, e, 1.0, "dictionary", "dictionary"))
    return out


def word_spans(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _WORD.finditer(text)]


class ListIndex:
    """Names by kind, for exact look-up of word runs and, in CJK, of character runs."""

    def __init__(self, lists: Iterable[tuple[str, Sequence[str]]]) -> None:
        self.words: dict[str, str] = {}
        self.signs: dict[str, str] = {}
        self.first_words: set[str] = set()
        self.first_signs: set[str] = set()
        self.longest = 0
        for kind, names in lists:
            for raw in names:
                if not (spans := word_spans(raw)):
                    continue
                name = raw[spans[0][0] : spans[-1][1]]
                if _CJK.search(name):
                    if len(name) >= 2:
                        self.signs[name] = kind
                        self.first_signs.add(name[0])
                elif len(name) >= 3:
                    self.words[name] = kind
                    self.first_words.add(raw[slice(*spans[0])])
                    self.longest = max(self.longest, len(spans))
        self.lengths = sorted({len(x) for x in self.signs})

    def __len__(self) -> int:
        return len(self.words) + len(self.signs)


def list_spans(text: str, index: ListIndex) -> list[Span]:
    found = []
    words = word_spans(text)
    for i, (start, end) in enumerate(words):
        if text[start:end] in index.first_words:
            found += [(start, e, index.words.get(text[start:e])) for _, e in words[i : i + index.longest]]
    if index.signs:
        for start, c in enumerate(text):
            if c in index.first_signs:
                found += [(start, start + n, index.signs.get(text[start : start + n])) for n in index.lengths if start + n <= len(text)]
    return [Span(kind, s, e, 0.9, f"list:{kind.lower()}", "bundledList") for s, e, kind in found if kind]
