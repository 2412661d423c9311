"""Placeholders: numbering, person variants, anonymising and restoring one text."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

import regex

from ..sources.schema import entity_type

_TYPED = regex.compile(r"\[([A-Z_]+)_([0-9]+)\]")
_CJK = regex.compile(r"[぀-ヿ㐀-鿿가-힯]")
#: Honorifics after CJK names, and before names by gender.
CJK_HONORIFICS = ["先生", "女士", "小姐", "同学", "老师", "经理", "总", "医生", "律师", "さん", "様", "씨"]
FEMALE = ["Mme", "Madame", "Mlle", "Mademoiselle", "Mrs", "Ms", "Miss", "Sra", "Señora", "Srta", "Señorita", "Doña", "Dña"]
MALE = ["M.", "Monsieur", "Mr", "Sr", "Señor", "Don", "D."]


def _before(honorifics: list[str]) -> regex.Pattern:
    return regex.compile(rf"(?<![\p{{Alphabetic}}.])(?:{'|'.join(map(regex.escape, honorifics))})\.?[ \u00A0]+\Z")


_FEMALE, _MALE = _before(FEMALE), _before(MALE)


def utf16(value: str) -> int:
    return len(value) + sum(c > "\uffff" for c in value)


def gender_before(text: str, start: int) -> str | None:
    """Gender by the honorific within 16 UTF-16 units before start."""
    at, units = start, 0
    while at and (units := units + utf16(text[at - 1])) <= 16:
        at -= 1
    context = text[at:start]
    return "female" if _FEMALE.search(context) else "male" if _MALE.search(context) else None


def name_tokens(value: str) -> list[str]:
    if _CJK.search(value):
        value = value.strip()
        ending = next((h for h in CJK_HONORIFICS if value.endswith(h)), "")
        value = value.removesuffix(ending).strip()
        return [value] if value else []
    return [t for t in (w.strip(".,;:!?()\"'") for w in value.lower().split()) if t]


@dataclass
class Ledger:
    """original -> (placeholder, type) in order of first use; placeholder -> longest original."""

    entries: dict[str, tuple[str, str]] = field(default_factory=dict)
    longest: dict[str, str] = field(default_factory=dict)
    genders: dict[str, str] = field(default_factory=dict)
    used: dict[str, int] = field(default_factory=dict)

    def load(self, mappings: Iterable[tuple[str, str, str]]) -> Ledger:
        for original, placeholder, kind in mappings:
            self._enter(original, placeholder, kind)
            m = _TYPED.fullmatch(placeholder)
            if m and (counted := entity_type(m[1])):
                self.used[counted] = max(self.used.get(counted, 0), int(m[2]))
        return self

    def _enter(self, original: str, placeholder: str, kind: str) -> None:
        self.entries[original] = (placeholder, kind)
        if placeholder not in self.longest or utf16(original) > utf16(self.longest[placeholder]):
            self.longest[placeholder] = original

    def placeholder(self, original: str, kind: str, gender: str | None = None) -> str:
        if original in self.entries:
            return self.entries[original][0]
        found = None
        if kind == "PERSON":
            if gender:
                self.genders[original] = gender
            found = self._same_person(original, gender)
        while found is None:
            self.used[kind] = self.used.get(kind, 0) + 1
            name = f"[{kind}_{self.used[kind]}]"
            found = None if name in self.longest else name
        self._enter(original, found, kind)
        return found

    def _same_person(self, value: str, gender: str | None) -> str | None:
        """Placeholder of the known person with most words in common; None when two are as good."""
        own = name_tokens(value)
        most, holders = 0, []
        for known, (placeholder, kind) in self.entries.items():
            if kind != "PERSON" or not own:
                continue
            other = name_tokens(known)
            few, many = sorted((own, other), key=len) if len(own) != len(other) else (own, other)
            if not other or not set(few) <= set(many) or max(map(utf16, few)) < 2:
                continue
            if gender and self.genders.get(known, gender) != gender:
                continue
            shared = sum(t in own for t in other)
            if shared > most:
                most, holders = shared, [placeholder]
            elif shared == most:
                holders.append(placeholder)
        return holders[0] if holders and len(set(holders)) == 1 else None

    def mappings(self) -> list[dict[str, str]]:
        return [{"original": o, "placeholder": p, "type": t} for o, (p, t) in self.entries.items()]


def anonymise(text: str, spans: Iterable, ledger: Ledger) -> tuple[str, list[tuple[int, int, str]]]:
    """Text with enabled spans replaced, and (start, end, placeholder) in the original. Earlier spans win overlaps."""
    out, done, cursor = [], [], 0
    for s in sorted((s for s in spans if s.enabled), key=lambda s: s.start):
        if s.start < cursor:
            continue
        m = regex.compile(r"(?s)[\p{White_Space},;]*(.*?)[\p{White_Space},;]*").fullmatch(text, s.start, s.end)
        a, b = m.span(1)
        if a == b:
            continue
        name = ledger.placeholder(text[a:b], s.type, gender_before(text, s.start) if s.type == "PERSON" else None)
        out += [text[cursor:a], name, text[b : s.end]]
        done.append((a, b, name))
        cursor = s.end
    return "".join(out) + text[cursor:], done


#: Places that may be a placeholder an editor or a model has altered.
MANGLED = regex.compile(r"\[[^\[\]\n]*\]|<<(?:(?!>>)[^<\n])*>>|(?<![\p{Alphabetic}\p{N}_\[<])[A-Z][A-Z0-9]*(?:_[A-Z0-9]+)*_[0-9]+(?![\p{Alphabetic}\p{N}_])")
_KEY = regex.compile(r"\[[^\[\]\n]*\]|<<[^<>\n]*>>")


def canonical(candidate: str) -> str | None:
    bare = regex.sub(r"^[^\p{Alphabetic}\p{N}]+|[^\p{Alphabetic}\p{N}]+\Z", "", regex.sub("[*`~]", "", candidate))
    return "_".join(p for p in regex.split(r"[\p{White_Space}_-]", bare) if p).lower() or None


def restore(text: str, ledger: Ledger) -> str:
    """Exact placeholders first, the longest first; then altered ones that can only mean one."""
    for placeholder in sorted(ledger.longest, key=lambda p: (-len(p.encode()), p)):
        text = text.replace(placeholder, ledger.longest[placeholder])
    known: dict[str, set[str]] = {}
    for key in ledger.longest:
        if _KEY.fullmatch(key) and (form := canonical(key)):
            known.setdefault(form, set()).add(key)
    if not known:
        return text

    def back(m: regex.Match) -> str:
        keys = known.get(canonical(m[0]) or "", ())
        return ledger.longest[next(iter(keys))] if len(keys) == 1 else m[0]

    return MANGLED.sub(back, text)
