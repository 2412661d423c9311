from __future__ import annotations

import json

import pytest

from maskwork.operators.scan import ListIndex, dictionary_spans, list_spans, rule_spans, zeros_for_os
from maskwork.operators.scan import search_of
from maskwork.sources import demands, rules
from maskwork.sources.rules import RuleSelection


@pytest.mark.parametrize("region", ["universal", *rules.regions()])
def test_rules_match_their_examples(region):
    for r in rules.pack(region):
        for e in r.examples:
            assert rule_spans(e, [r]), (r.id, e)


def test_inventory():
    every = rules.bundled()
    assert len(rules.regions()) == 19 and sum(r.region != "universal" for r in every) == 166
    assert len({r.id for r in every}) == len(every)


def test_selection():
    ids = lambda **k: {r.id for r in rules.bundled(["gb"], RuleSelection(**k))}
    assert "regex:gb:nino" in ids() and "regex:gb:nhs" not in ids()
    assert "regex:gb:nhs" in ids(verticals=["healthcare"]) and "regex:gb:nhs" in ids(include_all_specialized=True)
    assert "regex:gb:nhs" in ids(enabled=["regex:gb:nhs"]) and "regex:gb:nino" not in ids(disabled=["regex:gb:nino"], enabled=["regex:gb:nino"])
    assert "regex:gb:nino" not in ids(categories=["contact"]) and "regex:gb:phone_mobile" in ids(categories=["contact"])
    assert {r.region for r in rules.bundled(["gb"], RuleSelection(jurisdictions=["FR"]))} == {"universal", "fr"}
    assert {r.region for r in rules.bundled([])} == {"universal"}


def pack(**change):
    rule = {"id": "x:a", "entityType": "SSN", "pattern": "a+", "flags": "gi", "confidence": 0.5, "classification": {"category": "identity", "subtype": "", "applicability": "baseline", "verticals": []}} | change
    return json.dumps({"schemaVersion": 2, "region": "x", "rules": [rule]})


def test_loader_and_its_errors():
    (r,) = rules.parse_pack(pack())
    assert (r.type, r.source, r.flags) == ("ID", "rule", "i")
    for source, error in [("{", rules.BadJson), ('{"schemaVersion": 1, "region": "x", "rules": []}', rules.UnsupportedVersion), (pack(entityType="WHO"), rules.UnknownEntity), (pack(validate="nope"), rules.UnknownCheck), (pack(pattern="("), rules.BadPattern), (pack(confidence=None), rules.BadJson)]:
        with pytest.raises(error):
            rules.parse_pack(source)


def test_search_goes_on_after_a_rejected_match():
    (luhn,) = [r for r in rules.pack("universal") if r.id.endswith("credit_card")]
    (hit,) = rule_spans("no 4111111111111112 yes 4111111111111111", [luhn])
    assert hit.start == 24


def test_weak_figures_are_numbers_and_cells_are_not_crossed():
    (r,) = [r for r in rules.pack("gb") if r.id.endswith("bank_account")]
    assert [s.type for s in rule_spans("12345678", [r])] == ["NUMBER"]
    (p,) = [r for r in rules.pack("de") if r.id.endswith(":postal")]
    assert [(s.start, s.end) for s in rule_spans("10115 Berlin\tMitte", [p])] == [(0, 12)]


def test_labelled_id_and_zero_view():
    (r,) = [r for r in rules.pack("universal") if r.id.endswith("named_national_id")]
    assert [(s.start, s.end) for s in rule_spans("DNI 48291736K", [r])] == [(4, 13)]
    assert zeros_for_os("Bad o224 So") == "Bad 0224 So"


def test_dictionary_ignores_case_accents_and_spacing():
    text = "HELENE\nGARCON reHelene 李四光 Hélène Garçon"
    assert [text[s.start : s.end] for s in dictionary_spans(text, ["Helene Garcon ", "李四", " "])] == ["HELENE\nGARCON", "Hélène Garçon", "李四"]


def test_lists_are_exact():
    index = ListIndex([("COMPANY", ["Apple", "(Bank of X)", "阿里巴巴", "ab", "张"]), ("ADDRESS", ["Apple Park"])])
    text = "Apple apple Apple Park, Bank of X; 阿里巴巴集团"
    assert [(text[s.start : s.end], s.type) for s in list_spans(text, index)] == [("Apple", "COMPANY"), ("Apple", "COMPANY"), ("Apple Park", "ADDRESS"), ("Bank of X", "COMPANY"), ("阿里巴巴", "COMPANY")]
    assert len(index) == 4


def test_demands_are_read_from_patterns():
    d = lambda p, i=False: (demands.demand(p, i).digits, sorted(demands.demand(p, i).strings))
    assert d(r"\b\d{3}-?\d{2,4}\b") == (5, []) and d(r"(?:\d{2}|\d{4}a)x") == (2, ["x"])
    assert d(r"[\p{L}]+(?:GmbH|AG)\b") == (0, ["AG", "GmbH"]) and d(r"a(?:b|c)?d") == (0, ["abd", "acd", "ad"])
    assert d(r"(?:rue|AVENUE)\s+\w+", True) == (0, ["avenue", "rue"]) and d(r"(?<=Ref: )[A-Z]+(?!x)") == (0, ["Ref: "])
    assert d(r"(?<=^|, )\w") == (0, []) and d(r"x*y?[^a]") == (0, []) and d(r"[0-9]{2}[\d-]") == (2, [])


@pytest.mark.parametrize("region", ["universal", *rules.regions()])
def test_what_a_rule_demands_is_in_its_examples(region):
    for r in rules.pack(region):
        for e in r.examples:
            for text in (e, f"Word, {e}; more", e.upper() if "i" in r.flags else e):
                assert not r.compiled.search(text) or demands.Facts(text).allow(r.pattern, "i" in r.flags), (r.id, text)


def test_odd_letters_do_not_hide_matches():
    (r,) = [r for r in rules.pack("de") if r.id.endswith(":street")]
    assert rule_spans("Hauptſtraße 5 und Ringſtraſſe 7", [r])


def test_search_by_runs_is_the_search_of_the_pattern():
    import random

    rng = random.Random(2)
    every = [r for r in rules.bundled() if search_of(r.pattern, r.flags) != r.compiled.search]
    assert len(every) > 10
    for r in every:
        words = ["a", "Ab", " ", "  ", "-", "\t", ",", "12", "\n", *r.examples, *r.examples[0].split()]
        for _ in range(150):
            text, at = " ".join(rng.choice(words) for _ in range(rng.randrange(1, 9))), 0
            while True:
                got, want = search_of(r.pattern, r.flags)(text, at), r.compiled.search(text, at)
                assert (got and got.span()) == (want and want.span()), (r.id, text, at)
                if not want:
                    break
                at = rng.choice([want.start() + 1, max(want.end(), at + 1)])


def test_long_runs_are_linear():
    import time

    text = "word of a very long run without any stop " * 20_000 + "AG, 5"
    start = time.perf_counter()
    rule_spans(text, [r for r in rules.pack("de") if r.id.split(":")[-1] in ("company", "street")])
    assert time.perf_counter() - start < 20
