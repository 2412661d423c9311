"""What happens to candidate spans of one text before and after overlaps are resolved.

Order of `settle`: blank text; title lines of model spans; defaults; noise, readable terms and
public products; policy; overlaps; repair; merge with copies elsewhere in the text.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

import regex

from ..sources.schema import ENTITY_TYPES, PRIORITIES, InvalidArgument, entity_type
from .repair import repair
from .scan import ALNUM, CJK, Span, dictionary_spans, replace

_TRUSTED = {"dictionary", "manual"}
_EDGE = r"[\p{White_Space}!-/:-@\[-`{-~]"
_CORE = regex.compile(rf"(?s)(?!{_EDGE}).*(?<!{_EDGE})")

#: Titles and roles that are not names, and articles that may stand before them.
TITLES = {
    "chair", "chairman", "ceo", "cfo", "president", "director", "manager", "secretary", "head", "mr", "mrs", "ms", "miss", "dr", "prof", "operations",
    "human resources", "finance", "legal", "sales", "department", "lessor", "lessee", "landlord", "tenant", "buyer", "seller", "employer", "employee",
    "client", "customer", "monsieur", "madame", "président", "directeur", "service", "siret", "siren", "bailleur", "locataire", "señor", "señora",
    "presidente", "directora", "departamento", "dni", "nif", "先生", "女士", "小姐", "公司", "集团", "部门", "法务部", "销售部", "人事部", "财务部", "董事会", "董事长", "总经理",
    "经理", "总监", "主任", "主管", "秘书", "检测中心", "中心", "务部",
}
ARTICLES = ["the ", "a ", "an ", "le ", "la ", "les ", "el ", "los ", "las ", "un ", "une ", "una ", "l'", "l’"]
FUNCTION_WORDS = {
    "the", "a", "an", "of", "and", "or", "to", "in", "on", "at", "for", "by", "with", "from", "as", "le", "la", "les", "un", "une", "des", "du", "de",
    "et", "ou", "au", "en", "pour", "par", "avec", "el", "los", "las", "una", "y", "o", "del", "al", "con", "por", "para", "sin",
}
#: Labels before a date of birth.
BIRTH_LABELS = ["born", "date of birth", "birth date", "birthdate", "birthday", "d.o.b.", "dob", "né(e) le", "née le", "né le", "naissance", "nacido", "nacida", "nacimiento", "f. nac."]
#: Marks of funds and indices, which are public.
PRODUCT_MARKS = ["etf", "etfs", "etp", "etn", "ucits", "sicav", "opcvm", "spdr", "ishares", "xtrackers", "lyxor", "msci", "ftse", "stoxx", "nasdaq", "nikkei", "s&p", "dow jones", "index fund", "cac 40", "ibex 35", "hang seng", "russell"]
#: Figures, and words on lines whose figures name an account.
_FIGURE = regex.compile(r"[+\-−]?[€$£]?\d+(?:[.,]\d+)+\s?%?")
_ACCOUNT = regex.compile(r"\b(account|acct|compte|cuenta|iban|bic|swift|phone|tel|mobile|passport|client|customer|policy|member|ref|reference|contract|number|numero|id)\b", regex.I)
_FOLLOWING = regex.compile(r"[\p{L}\p{N}&.'’-]*(?:[ \u00A0]+[\p{Lu}\p{N}&][\p{L}\p{N}&.-]*){0,4}")


def core(value: str) -> tuple[int, int] | None:
    """Bounds of value without white space and ASCII punctuation at its edges."""
    m = _CORE.search(value)
    return m.span() if m and m[0] else None


def normalised(value: str) -> str:
    edge = r"[\p{White_Space}!-/:-@\[-`{-~、。，；：！？]+"
    return regex.sub(rf"^{edge}|{edge}$(?!\n)", "", value).lower()


def is_title(value: str) -> bool:
    n = normalised(value)
    return n in TITLES or any(n[len(a) :] in TITLES for a in ARTICLES if n.startswith(a))


def only_function_words(value: str) -> bool:
    words = [w for w in regex.split(_EDGE, value) if w]
    return bool(words) and all(w.lower() in FUNCTION_WORDS for w in words)


def meaningful(text: str, s: Span) -> bool:
    v = text[s.start : s.end].strip()
    if not v or s.source != "model":
        return bool(v)
    return len(v) >= (3 if v.isascii() else 2) and not is_title(v) and not only_function_words(v)


def title_lines(text: str, s: Span) -> list[Span]:
    """A model span over several lines, cut at its noise and at repeated table cells."""
    value = text[s.start : s.end]
    if s.source != "model" or "\n" not in value:
        return [s]
    parts, at = [], s.start
    for line in value.split("\n"):
        if inner := core(line):
            parts.append(replace(s, start=at + inner[0], end=at + inner[1]))
        at += len(line) + 1

    def tabbed(p: Span) -> bool:
        first = text.rfind("\n", 0, p.start) + 1
        last = text.find("\n", p.start)
        return "\t" in text[first : last if last >= 0 else len(text)]

    table = any(map(tabbed, parts))
    cells = Counter(regex.split(r"[\t\n]", text)) if table else Counter()
    kept = [p for p in parts if meaningful(text, p) and not (table and cells[text[p.start : p.end]] >= 3)]
    return kept if table or len(kept) < len(parts) else [s]


def after_birth_label(text: str, start: int) -> bool:
    before = text[max(0, start - 80) : start]
    lower = before.lower()
    for label in BIRTH_LABELS:
        at = lower.rfind(label)
        if at < 0:
            continue
        rest = lower[at + len(label) :]
        if "\n" in rest:
            if not rest.strip(" \t:\r\n"):
                return True
        elif len(rest) <= 20 and not regex.search("[0-9]", rest):
            return True
    at = before.rfind("NE LE")
    return at >= 0 and len(before) - at - 5 <= 20


def figure_rows(text: str) -> list[tuple[int, int]]:
    rows, at = [], 0
    for line in text.split("\n"):
        if sum(1 for _ in _FIGURE.finditer(line)) >= 2 and not _ACCOUNT.search(line):
            rows.append((at, at + len(line)))
        at += len(line) + 1
    return rows if len(rows) >= 3 else []


def defaults(text: str, spans: list[Span]) -> list[Span]:
    """Dates of birth are told from dates; dates, amounts and figures of tables start disabled."""
    born = {text[s.start : s.end].strip() for s in spans if s.type == "DATE" and after_birth_label(text, s.start)}
    rows = figure_rows(text)
    out = []
    for s in spans:
        if s.type == "DATE" and text[s.start : s.end].strip() in born:
            s = replace(s, type="BIRTH_DATE")
        elif s.type in ("DATE", "AMOUNT") or s.type == "NUMBER" and s.source in ("model", "rule") and any(a <= s.start and s.end <= b for a, b in rows):
            s = replace(s, enabled=False)
        out.append(s)
    return out


def readable_ranges(text: str, never_hide: Iterable[str]) -> list[tuple[int, int]]:
    return [(s.start, s.end) for s in dictionary_spans(text, never_hide)]


def is_readable(text: str, s: Span, ranges: list[tuple[int, int]]) -> bool:
    if s.source in _TRUSTED or not ranges or not (inner := core(text[s.start : s.end])):
        return False
    return any(a <= s.start + inner[0] and s.start + inner[1] <= b for a, b in ranges)


def public_product(text: str, s: Span) -> bool:
    if s.type not in ("COMPANY", "ADDRESS") or s.source in _TRUSTED:
        return False
    name = (text[s.start : s.end] + _FOLLOWING.match(text, s.end)[0]).lower()
    return any(mark in name for mark in PRODUCT_MARKS)


@dataclass
class Policy:
    """types: entity type -> hide, keep or off. ranges: byte ranges to which hiding is confined."""

    types: dict[str, str] = field(default_factory=dict)
    ranges: list[tuple[int, int]] | None = None

    @staticmethod
    def parse(types: dict[str, str] | None = None, ranges: Iterable[tuple[int, int]] | None = None) -> Policy:
        out = {}
        for name, action in (types or {}).items():
            if (kind := entity_type(name)) is None:
                raise InvalidArgument(f"unknown entity type {name!r}; expected one of {', '.join(ENTITY_TYPES)}")
            if action not in ("hide", "keep", "off"):
                raise InvalidArgument(f'unknown type action "{action}"; expected "hide", "keep" or "off"')
            out[kind] = action
        return Policy(out, None if ranges is None else [tuple(r) for r in ranges])

    def check(self, octets: int, boundary: Callable[[int], bool]) -> str | None:
        """What is wrong with the ranges in a text of so many bytes; None if nothing is."""
        if self.ranges is None:
            return None
        if not self.ranges:
            return "ranges is empty; omit it to process the whole text"
        for i, (a, b) in enumerate(self.ranges):
            if a >= b:
                return f"range {i} [{a}, {b}) is empty; start must be less than end"
            if b > octets:
                return f"range {i} [{a}, {b}) is outside the text ({octets} bytes)"
            if not boundary(a) or not boundary(b):
                return f"range {i} [{a}, {b}) is not on UTF-8 character boundaries"
        return None


def inside(s: Span, ranges: list[tuple[int, int]] | None) -> bool:
    return ranges is None or any(a < s.end and s.start < b for a, b in ranges)


def apply_policy(s: Span, policy: Policy, ranges: list[tuple[int, int]] | None) -> Span | None:
    if not inside(s, ranges):
        return None
    action = None if s.source in _TRUSTED else policy.types.get(s.type)
    if action == "off":
        return None
    return s if action is None else replace(s, enabled=action == "hide")


Size = Callable[[Span], int]


def resolve_once(spans: list[Span], size: Size) -> list[Span]:
    """The better span of any two that overlap, in order of position; ties keep the given order."""
    ranked = sorted(spans, key=lambda s: (-PRIORITIES[s.source], -size(s), -int(s.confidence * 1_000_000), s.start))
    kept: list[Span] = []
    for s in ranked:
        if not any(s.meets(k) for k in kept):
            kept.append(s)
    return sorted(kept, key=lambda s: s.start)


def resolve(spans: list[Span], size: Size) -> list[Span]:
    """As `resolve_once`, but a dictionary term inside a longer enabled span of another source yields to it as long as that span stays."""

    def shelters(c: Span, term: Span) -> bool:
        return c.enabled and c.source != "dictionary" and c.start <= term.start and c.end >= term.end and size(c) > size(term)

    waiting = {i for i, s in enumerate(spans) if s.source == "dictionary" and any(shelters(c, s) for c in spans)}
    while True:
        kept = resolve_once([s for i, s in enumerate(spans) if i not in waiting], size)
        bare = {i for i in waiting if not any(shelters(c, spans[i]) for c in kept)}
        if not bare:
            return kept
        waiting -= bare


_CJK = regex.compile(CJK)
_ALNUM = regex.compile(ALNUM)


def stands_alone(text: str, start: int, end: int) -> bool:
    if _CJK.search(text, start, end):
        return True
    return not (start and _ALNUM.match(text[start - 1])) and not (end < len(text) and _ALNUM.match(text[end]))


def propagate(text: str, spans: list[Span]) -> list[Span]:
    """Further occurrences of the values of enabled spans, and of the parts of people's names."""
    wanted: dict[str, tuple[str, str, bool]] = {}
    for s in spans:
        if not s.enabled:
            continue
        value = text[s.start : s.end].strip()
        if len(value) >= 3 or len(value) == 2 and not value.isascii():
            wanted.setdefault(value.lower(), (value, s.type, False))
        if s.type == "PERSON" and len(value.split()) > 1:
            for word in value.split():
                word = word.rstrip(".,;:!?()")
                if len(word) >= 4 and not regex.match(r"\p{Lowercase}", word) and not is_title(word):
                    wanted.setdefault(word.lower(), (word, s.type, True))
    taken = {(s.start, s.end) for s in spans}
    out = []
    for value, kind, part in wanted.values():
        for m in regex.finditer(regex.escape(value), text, regex.I):
            at = m.span()
            if at in taken or not stands_alone(text, *at) or part and text[at[0]] != value[0]:
                continue
            taken.add(at)
            out.append(Span(kind, *at, 0.95, "propagated", "propagated"))
    return out


def merge(text: str, spans: list[Span], size: Size, allowed: Callable[[Span], bool] = lambda s: True) -> list[Span]:
    kept = resolve([s for s in spans if meaningful(text, s) and allowed(s)], size)
    return resolve(kept + [s for s in propagate(text, kept) if allowed(s)], size)


def settle(text: str, candidates: list[Span], size: Size, never_hide: Iterable[str] = (), policy: Policy | None = None, ranges: list[tuple[int, int]] | None = None) -> list[Span]:
    """The spans of a text that count, from all candidates. ranges: the policy's, in code points."""
    if not text.strip():
        return []
    policy = policy or Policy()
    readable = readable_ranges(text, never_hide)
    fresh = []
    for s in defaults(text, [p for s in candidates for p in title_lines(text, s)]):
        if meaningful(text, s) and not is_readable(text, s, readable) and not public_product(text, s):
            if (s := apply_policy(s, policy, ranges)) is not None:
                fresh.append(s)
    mended = repair(text, resolve(fresh, size), fresh, size)
    return merge(text, mended, size, lambda s: not is_readable(text, s, readable) and inside(s, ranges))
