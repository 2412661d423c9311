"""Rule packs: the bundled ones, packs from JSON, and which rules a request selects."""

from __future__ import annotations

import json
from collections.abc import Iterable
from dataclasses import dataclass, field
from functools import cache

import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..functions.validators import CHECKS
from .rule_table import PACKS
from .schema import STRONG_CONFIDENCE, entity_type

PACK_VERSION = 2


class RulePackError(ValueError):
    """A rule pack that cannot be used."""


class BadJson(RulePackError):
    pass


class UnsupportedVersion(RulePackError):
    pass


class UnknownEntity(RulePackError):
    pass


class UnknownCheck(RulePackError):
    pass


class BadPattern(RulePackError):
    pass


@dataclass(frozen=True)
class Rule:
    id: str
    region: str
    type: str
    pattern: str
    flags: str
    confidence: float
    check: str = ""
    applicability: str = "baseline"
    verticals: tuple[str, ...] = ()
    category: str = ""
    subtype: str = ""
    examples: tuple[str, ...] = ()
    description: str = ""
    extras: tuple[tuple[str, str], ...] = ()

    @property
    def source(self) -> str:
        return "validatedRule" if self.check else "strongRule" if self.confidence >= STRONG_CONFIDENCE else "rule"

    @property
    def compiled(self) -> regex.Pattern:
        return compiled(self.pattern, self.flags)


@cache
def compiled(pattern: str, flags: str) -> regex.Pattern:
    return regex.compile(pattern, sum(getattr(regex, f.upper()) for f in flags if f in "ims"))


@dataclass
class RuleSelection:
    """Which rules apply. Disabled ids win over enabled ones, those over categories and verticals."""

    jurisdictions: Iterable[str] | None = None
    categories: Iterable[str] | None = None
    verticals: Iterable[str] = field(default_factory=tuple)
    enabled: Iterable[str] = field(default_factory=tuple)
    disabled: Iterable[str] = field(default_factory=tuple)
    include_all_specialized: bool = False

    def includes(self, rule: Rule) -> bool:
        if rule.id in set(self.disabled):
            return False
        if rule.id in set(self.enabled):
            return True
        if self.categories is not None and rule.category not in set(self.categories):
            return False
        return rule.applicability == "baseline" or self.include_all_specialized or bool(set(self.verticals) & set(rule.verticals))


def parse_pack(source: str) -> list[Rule]:
    """Rules of a JSON pack; raises a RulePackError that says what is wrong with it."""
    try:
        pack = json.loads(source)
        version, region, rows = pack["schemaVersion"], pack["region"], pack["rules"]
    except (ValueError, KeyError, TypeError) as e:
        raise BadJson(f"rule pack is not valid: {e}") from e
    if version != PACK_VERSION:
        raise UnsupportedVersion(f"rule pack version {version}; expected {PACK_VERSION}")
    out = []
    for r in rows:
        try:
            about, name = r["classification"], r["id"]
            kind = entity_type(r["entityType"])
            check = r.get("validate") or ""
            rule = Rule(name, region, kind or "", r["pattern"], "".join(f for f in r.get("flags", "") if f in "ims"), float(r["confidence"]), check, about["applicability"], tuple(about.get("verticals", ())), about["category"], about.get("subtype", ""), tuple(r.get("examples", ())), r.get("description", ""), tuple((k, str(about[k])) for k in ("protectionLevel", "defaultAction", "provenance", "status") if k in about))
        except (KeyError, TypeError, ValueError) as e:
            raise BadJson(f"rule {r.get('id') if isinstance(r, dict) else r!r} is not valid: {e}") from e
        if kind is None:
            raise UnknownEntity(f"rule {name}: unknown entity type {r['entityType']!r}")
        if check and check not in CHECKS:
            raise UnknownCheck(f"rule {name}: unknown check {check!r}")
        try:
            rule.compiled
        except regex.error as e:
            raise BadPattern(f"rule {name}: {e}") from e
        out.append(rule)
    return out


@cache
def pack(region: str) -> tuple[Rule, ...]:
    """The bundled rules of one region."""
    out = []
    for name, kind, confidence, flags, check, use, about, pattern, examples in PACKS[region][2]:
        level, _, verticals = use.partition(":")
        category, _, subtype = about.partition("/")
        out.append(Rule(f"regex:{region}:{name}", region, kind, pattern, flags, confidence, check, {"base": "baseline", "spec": "specialized"}[level], tuple(v for v in verticals.split(",") if v), category, subtype, tuple(examples)))
    return tuple(out)


def regions() -> list[str]:
    return [r for r in PACKS if r != "universal"]


def bundled(regions_wanted: Iterable[str] | None = None, selection: RuleSelection | None = None) -> list[Rule]:
    """Universal rules and those of the wanted regions (all when None), as far as the selection includes them."""
    wanted = selection.jurisdictions if selection and selection.jurisdictions is not None else regions_wanted
    names = None if wanted is None else {w.lower() for w in wanted}
    found = [r for region in PACKS if region == "universal" or names is None or region in names for r in pack(region)]
    return [r for r in found if selection is None or selection.includes(r)]


RULE_SCHEMA = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("id", "region", "type", "pattern", "flags")]
    + [T.StructField("confidence", T.DoubleType()), T.StructField("source", T.StringType()), T.StructField("check", T.StringType()), T.StructField("applicability", T.StringType()), T.StructField("verticals", T.ArrayType(T.StringType())), T.StructField("category", T.StringType()), T.StructField("subtype", T.StringType()), T.StructField("examples", T.ArrayType(T.StringType()))]
)


def rules_frame(spark: SparkSession, rules: Iterable[Rule] | None = None) -> DataFrame:
    """Rules as a table."""
    rows = [(r.id, r.region, r.type, r.pattern, r.flags, r.confidence, r.source, r.check or None, r.applicability, list(r.verticals), r.category, r.subtype, list(r.examples)) for r in (bundled() if rules is None else rules)]
    return spark.createDataFrame(rows, RULE_SCHEMA)
