"""What a text must hold for a pattern to match in it: cheap tests before a search.

A pattern is read as a tree. Digits add up along a sequence, the least branch of a choice counts,
and repeats count as often as they must occur. Likewise one set of strings is found of which one is in
every match, or in what a look-around of it demands. Options, negations and classes demand nothing:
a text without what is demanded can't match, and no match is lost.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cache

import regex

MOST_STRINGS = 256
_REPEAT = regex.compile(r"[*+?]|\{(\d*)(,?)\d*\}")
_DIGIT = regex.compile(r"\d")
#: Letters that match others of another length or lower case: texts with them are searched anyway.
_ODD_CASE = regex.compile("[ſİıK]")


@dataclass(frozen=True)
class Demand:
    """A text with a match has `digits` digits and, if there are any, one of `strings`."""

    digits: int = 0
    strings: frozenset[str] = frozenset()

    def met(self, digits: int, text: str) -> bool:
        if digits < self.digits:
            return False
        for s in self.strings:
            if s in text:
                return True
        return not self.strings


def _better(a: frozenset[str], b: frozenset[str]) -> frozenset[str]:
    """The set that fewer texts will meet: longer strings, then capitals, then fewer."""
    rank = lambda s: (bool(s), min(map(len, s), default=0), all(x[0].isupper() for x in s), -len(s))
    return max(a, b, key=rank)


@dataclass
class _Node:
    digits: int = 0
    strings: frozenset[str] = frozenset()
    whole: frozenset[str] | None = None  # all that the node can match, where that is few strings


EMPTY = _Node(whole=frozenset([""]))


def _sequence(parts: list[_Node]) -> _Node:
    out, run, best = _Node(whole=frozenset([""])), frozenset([""]), frozenset()
    for p in parts:
        out.digits += p.digits
        joined = None if p.whole is None else frozenset(a + b for a in run for b in p.whole)
        if p.whole == EMPTY.whole:
            best = _better(best, p.strings)
        elif joined is not None and len(joined) <= MOST_STRINGS:
            run = joined
        else:
            best = _better(best, run if "" not in run else frozenset())
            best = _better(best, p.strings)
            run = p.whole if p.whole is not None else frozenset([""])
            out.whole = None
    best = _better(best, run if "" not in run else frozenset())
    if out.whole is not None:
        out.whole = run
    out.strings = best
    return out


def _choice(branches: list[_Node]) -> _Node:
    if len(branches) == 1:
        return branches[0]
    all_ask = all(b.strings for b in branches)
    strings = frozenset().union(*(b.strings for b in branches)) if all_ask else frozenset()
    whole = frozenset().union(*(b.whole for b in branches)) if all(b.whole is not None for b in branches) else None
    if whole is not None and len(whole) > MOST_STRINGS:
        whole = None
    return _Node(min(b.digits for b in branches), strings if len(strings) <= MOST_STRINGS else frozenset(), whole)


class _Reader:
    def __init__(self, pattern: str) -> None:
        self.p, self.i = pattern, 0

    def take(self, n: int = 1) -> str:
        self.i += n
        return self.p[self.i - n : self.i]

    def choice(self) -> _Node:
        branches = [self.sequence()]
        while self.p[self.i : self.i + 1] == "|":
            self.take()
            branches.append(self.sequence())
        return _choice(branches)

    def sequence(self) -> _Node:
        parts = []
        while self.i < len(self.p) and self.p[self.i] not in "|)":
            part = self.atom()
            while m := _REPEAT.match(self.p, self.i):
                self.i = m.end()
                least = {"*": 0, "?": 0, "+": 1}.get(m[0])
                if least is None:
                    least = int(m[1] or 0)
                    whole = part.whole if least == 1 and not m[2] else None
                    if least and not m[2] and part.whole is not None and len(part.whole) ** least <= MOST_STRINGS:
                        whole = _sequence([part] * least).whole
                else:
                    whole = part.whole | {""} if m[0] == "?" and part.whole is not None else None
                part = _Node(part.digits * least, part.strings if least else frozenset(), whole)
                if self.p[self.i : self.i + 1] in ("?", "+"):
                    self.take()  # lazy or possessive
            parts.append(part)
        return _sequence(parts)

    def atom(self) -> _Node:
        c = self.take()
        if c == "(":
            return self.group()
        if c == "[":
            return self.characters()
        if c == "\\":
            return self.escape(self.take())
        if c in "^$":
            return EMPTY
        if c == ".":
            return _Node()
        return _Node(c.isdecimal(), frozenset([c]), frozenset([c]))

    def group(self) -> _Node:
        around = regex.compile(r"\?(?:<?[=!]|[:>]|P?<\w+>|)").match(self.p, self.i)
        if around:
            self.i = around.end()
        inner = self.choice()
        self.take()  # )
        if around and around[0][-1] == "=":
            return _Node(strings=inner.strings, whole=EMPTY.whole)  # in the text, though not in the match
        return EMPTY if around and around[0][-1] == "!" else inner

    def escape(self, c: str) -> _Node:
        if c == "d":
            return _Node(digits=1)
        if c in "bBAzZG":
            return EMPTY
        if c in "pP":
            if self.p[self.i : self.i + 1] == "{":
                self.i = self.p.index("}", self.i) + 1
            return _Node()
        if c == "u":
            ch = chr(int(self.take(4), 16))
            return _Node(0, frozenset([ch]), frozenset([ch]))
        if c.isalnum():
            return _Node()
        return _Node(0, frozenset([c]), frozenset([c]))

    def characters(self) -> _Node:
        start, found, plain = self.i, [], True
        if self.p[self.i] == "^":
            plain = False
            self.take()
        first = True
        while first or self.p[self.i] != "]":
            first = False
            c = self.take()
            if c == "\\":
                e = self.take()
                if e == "u":
                    found.append(chr(int(self.take(4), 16)))
                elif e in "pP" and self.p[self.i : self.i + 1] == "{":
                    self.i = self.p.index("}", self.i) + 1
                    plain = False
                elif e == "d":
                    found.append("0-9")
                elif e.isalnum():
                    plain = False
                else:
                    found.append(e)
            elif c == "-" and found and self.p[self.i] != "]" and found[-1] != "0-9":
                end = self.take()
                if end == "\\":
                    plain = False
                    self.take()
                else:
                    found[-1] = f"{found[-1]}-{end}"
            else:
                found.append(c)
        self.take()
        digits = plain and self.i > start and all(x == "0-9" or x.isdecimal() or (len(x) == 3 and x[1] == "-" and x[0].isdecimal() and x[2].isdecimal()) for x in found)
        single = plain and not any(len(x) > 1 for x in found) and len(found) <= 6
        whole = frozenset(found) if single else None
        return _Node(int(digits), whole or frozenset(), whole)


@cache
def demand(pattern: str, ignore_case: bool) -> Demand:
    """What every match of pattern needs; strings in lower case where case is ignored."""
    reader = _Reader(pattern)
    node = reader.choice()
    if reader.i < len(pattern):  # not read to its end: nothing is known
        return Demand()
    strings = node.strings
    if ignore_case:
        strings = frozenset(s.lower() for s in strings)
    return Demand(node.digits, strings)


class Facts:
    """A text's digits and lower case, worked out once for all patterns."""

    def __init__(self, text: str) -> None:
        self.text = text
        self.digits = sum(1 for _ in _DIGIT.finditer(text))
        self.lower = text.lower()
        self.odd = not text.isascii() and _ODD_CASE.search(text) is not None

    def allow(self, pattern: str, ignore_case: bool) -> bool:
        return (ignore_case and self.odd) or demand(pattern, ignore_case).met(self.digits, self.lower if ignore_case else self.text)
