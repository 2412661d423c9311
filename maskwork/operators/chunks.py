"""Chunks of a text that a reviewer can hide with one tap.

A text outside the taken ranges is cut at hard breaks (line and cell ends, runs of spaces,
clause punctuation); inside a segment, atoms that read as parts of one value are joined.
"""

from __future__ import annotations

from collections.abc import Iterable

import regex

#: Limits of a chunk, in UTF-16 units and words.
LONGEST, BRIDGE_WORDS, BRIDGE_LENGTH = 60, 3, 3
LATIN = r"[A-Za-zÀ-ɏ]"
_UPPER = "[" + "".join(regex.escape(c) for c in map(chr, [*range(65, 91), *range(0xC0, 0x250)]) if c.upper() == c != c.lower()) + "]"
_NOT_SPACE = r"[^\t\n\x0B\x0C\r \u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF]"
_CJK = r"[぀-ヿ㐀-鿿가-힯豈-﫿]"
#: A break is one of the first signs, or one of the second ones where what follows it holds.
_BREAK = regex.compile(
    r"[\n\t| ;?!，；：、。！？()（）\[\]【】《》\"“”「」『』<>{}]"
    r"|(?=[ :,.])(?: {2,}|:(?=\Z| )|,(?!(?<=[0-9],)[0-9])"
    rf"|\.(?!(?<=[0-9]\.)[0-9])(?!{LATIN})(?<!(?<!{LATIN}){_UPPER}{LATIN}{{0,2}}\.))"
)
#: Words come first, unless they may begin an address or a link; groups tell the kinds apart.
_ATOM = regex.compile(
    rf"(?P<link>{_NOT_SPACE}+@{_NOT_SPACE}+|[A-Za-z][A-Za-z0-9+.\-]*://{_NOT_SPACE}+|www\.{_NOT_SPACE}+)|(?P<cjk>{_CJK}+)"
    rf"|{LATIN}{{1,3}}\.|[0-9](?:[0-9.,/\-+'’]*[0-9])?|{LATIN}[A-Za-zÀ-ɏ'’\-]*|{_NOT_SPACE}"
)
#: The same where a segment holds neither @ nor :// nor www.
_PLAIN_ATOM = regex.compile(rf"(?P<link>(?!))|(?P<cjk>{_CJK}+)|{LATIN}{{1,3}}\.|[0-9](?:[0-9.,/\-+'’]*[0-9])?|{LATIN}[A-Za-zÀ-ɏ'’\-]*|{_NOT_SPACE}")
_VALUE = regex.compile(rf"(?s).*(?:@|://|{_CJK}).*|[0-9].*|{_UPPER}.*|[€£$¥%₽₹¢]")
_FIRST_OF_VALUE = frozenset("0123456789") | frozenset(c for c in map(chr, [*range(65, 91), *range(0xC0, 0x250)]) if c.upper() == c != c.lower())
_SIGNS = frozenset("€£$¥%₽₹¢@")
_LATIN_LETTERS = frozenset(map(chr, [*range(65, 91), *range(97, 123), *range(0xC0, 0x250)]))


def units(text: str) -> int:
    return len(text) + sum(c > "\uffff" for c in text)


def free_ranges(length: int, taken: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    """What the taken ranges leave of 0..length."""
    out, at = [], 0
    for start, end in sorted(taken, key=lambda r: r[0]):
        if end > at:
            if start > at:
                out.append((at, start))
            at = end
    return out + [(at, length)] if at < length else out


def segments(text: str, start: int, end: int) -> list[tuple[int, int]]:
    out, at = [], start
    while at < end:
        m = _BREAK.search(text, at)
        stop = min(m.start(), end) if m else end
        if stop > at:
            out.append((at, stop))
        if not m or m.start() >= end:
            break
        at = m.end()
    return out


def atoms(text: str, start: int, end: int) -> list[tuple[int, int, bool]]:
    """Start, end and whether it reads as a value, of every atom of a segment."""
    part = text[start:end]
    linked = "@" in part or "://" in part or "www." in part
    out = []
    for m in (_ATOM if linked else _PLAIN_ATOM).finditer(text, start, end):
        a, b = m.span()
        if m["link"]:
            value = bool(_VALUE.fullmatch(text, a, b))
        else:
            value = text[a] in _FIRST_OF_VALUE or m["cjk"] is not None or (b == a + 1 and text[a] in _SIGNS)
        out.append((a, b, value))
    return out


def chunks(text: str, taken: Iterable[tuple[int, int]] = ()) -> list[tuple[int, int]]:
    out = []
    for a, b in free_ranges(len(text), taken):
        for x, y in segments(text, a, b):
            out += _joined(text, atoms(text, x, y))
    return out


def _joined(text: str, atoms: list[tuple[int, int, bool]]) -> list[tuple[int, int]]:
    """A value takes in the values behind it and up to BRIDGE_WORDS short words between; a word that is no value stays alone."""
    out, i, n = [], 0, len(atoms)
    while i < n:
        start, end, value = atoms[i]
        i += 1
        if not value:
            if text[start] in _LATIN_LETTERS:
                out.append((start, end))
            continue
        last, bridge = i, 0
        for j in range(i, n):
            a, b, more = atoms[j]
            if a - atoms[j - 1][1] > 1 or text[atoms[j - 1][1] : a] not in ("", " ") or (b - start > LONGEST // 2 and units(text[start:b]) > LONGEST):
                break
            if more:
                last, bridge = j + 1, 0
            elif bridge < BRIDGE_WORDS and units(text[a:b]) <= BRIDGE_LENGTH and text[a] in _LATIN_LETTERS:
                bridge += 1
            else:
                break
        out.append((start, atoms[last - 1][1]))
        i = last
    return out
