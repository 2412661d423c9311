from __future__ import annotations

import random

from maskwork.operators import repair, review
from maskwork.operators.review import Policy, Span, defaults, merge, propagate, resolve, resolve_once, settle, title_lines

SIZE = lambda s: s.end - s.start


def at(text, value, kind="PERSON", source="model", start=0, confidence=0.9, enabled=True):
    i = text.index(value, start)
    return Span(kind, i, i + len(value), confidence, "test", source, enabled)


def shown(text, spans):
    return [(text[s.start : s.end], s.type, s.enabled) for s in spans]


def run(text, spans, **options):
    return shown(text, settle(text, spans, SIZE, **options))


def test_blank_text_has_no_spans():
    assert run(" \n", [Span("PERSON", 0, 1, 1.0, "x", "manual")]) == []


def test_dates_start_disabled_but_births_do_not():
    text = "Issued 05/06/2021. Date of birth: 07/08/1985"
    spans = [at(text, "05/06/2021", "DATE", "strongRule"), at(text, "07/08/1985", "DATE", "strongRule")]
    assert run(text, spans) == [("05/06/2021", "DATE", False), ("07/08/1985", "BIRTH_DATE", True)]
    assert run(text, spans, policy=Policy.parse({"DATE": "hide", "BIRTH_DATE": "keep"})) == [("05/06/2021", "DATE", True), ("07/08/1985", "BIRTH_DATE", False)]
    for before, born in [("born on ", True), ("NE LE : ", True), ("née le\n ", True), ("born 1 ", False), ("born to many different people ", False)]:
        assert review.after_birth_label(before, len(before)) is born, before


def test_off_goes_before_overlaps_and_keep_after():
    text = "Ship to c/o Nora Vidal, 9 Calle Luna now."
    spans = [at(text, "c/o Nora Vidal, 9 Calle Luna", "ADDRESS"), at(text, "Nora Vidal")]
    assert run(text, spans)[0][1:] == ("ADDRESS", True)
    assert run(text, spans, policy=Policy.parse({"ADDRESS": "off"})) == [("Nora Vidal", "PERSON", True)]
    assert run(text, spans, policy=Policy.parse({"ADDRESS": "keep"}))[0][1:] == ("ADDRESS", False)


def test_ranges_also_bind_copies():
    text = "Nora Vidal rang.\nThen Nora Vidal met Paul Stein."
    second = text.index("Then")
    spans = [at(text, "Nora Vidal"), at(text, "Nora Vidal", start=second), at(text, "Paul Stein")]
    found = settle(text, spans, SIZE, ranges=[(second, len(text))])
    assert [s.start for s in found] == [second + 5, text.index("Paul")]
    assert [text[s.start : s.end] for s in settle(text, spans, SIZE, ranges=[(text.index("Stein"), len(text))])] == ["Paul Stein"]


def test_policy_errors():
    import pytest

    from maskwork.sources.schema import InvalidArgument

    with pytest.raises(InvalidArgument, match="PEOPLE"):
        Policy.parse({"PEOPLE": "hide"})
    with pytest.raises(InvalidArgument, match="type action"):
        Policy.parse({"EMAIL": "show"})
    assert Policy.parse({"SSN": "off"}).types == {"ID": "off"}
    assert "empty" in Policy(ranges=[]).check(5, lambda k: True)
    assert "range 0 [3, 3)" in Policy(ranges=[(3, 3)]).check(5, lambda k: True)
    assert "outside" in Policy(ranges=[(3, 9)]).check(5, lambda k: True)
    assert "boundaries" in Policy(ranges=[(0, 3)]).check(5, lambda k: k != 3)


def test_noise_titles_and_readable_terms():
    text = "The Director met Ana Ruiz of the Acme ETF and Bo"
    spans = [at(text, "The Director"), at(text, "of the"), at(text, "Ana Ruiz"), at(text, "Acme", "COMPANY"), at(text, "Bo")]
    assert run(text, spans) == [("Ana Ruiz", "PERSON", True)]
    assert run(text, spans, never_hide=["ana ruiz"]) == []


def test_multi_line_model_spans_lose_titles():
    text = "Ana Ruiz\nDirector"
    assert shown(text, title_lines(text, Span("PERSON", 0, len(text), 0.9, "m", "model"))) == [("Ana Ruiz", "PERSON", True)]
    plain = "Ana Ruiz\nBea Gil"
    assert len(title_lines(plain, Span("PERSON", 0, len(plain), 0.9, "m", "model"))) == 1
    table = "Yes\t1\nYes\t2\nYes\t3\nAna Ruiz\t4"
    assert shown(table, title_lines(table, Span("PERSON", 0, len(table) - 2, 0.9, "m", "model")))[-1] == ("Ana Ruiz", "PERSON", True)


def test_figures_of_a_table_start_disabled():
    text = "a 1.5 2.5\nb 1.5 2.5\nc 1.5 12.5"
    assert [s.enabled for s in defaults(text, [at(text, "12.5", "NUMBER", "rule"), at(text, "12.5", "NUMBER", "manual")])] == [False, True]


def test_dictionary_term_yields_while_its_cover_stays():
    text = "Falcon Street 12, Paris"
    term, cover = at(text, "Falcon", "CUSTOM", "dictionary"), at(text, "Falcon Street 12", "ADDRESS", "strongRule")
    assert shown(text, resolve([term, cover], SIZE)) == [("Falcon Street 12", "ADDRESS", True)]
    rival = at(text, "Street 12, Paris", "ADDRESS", "validatedRule")
    assert shown(text, resolve([term, cover, rival], SIZE)) == [("Falcon", "CUSTOM", True), ("Street 12, Paris", "ADDRESS", True)]


def test_kept_spans_never_overlap():
    rng = random.Random(3)
    for _ in range(200):
        spans = [Span("OTHER", a, a + rng.randrange(1, 9), rng.random(), "t", rng.choice(list(review.PRIORITIES))) for a in (rng.randrange(40) for _ in range(12))]
        kept = resolve_once(spans, SIZE)
        assert all(x.end <= y.start for x, y in zip(kept, kept[1:]))
        assert all(any(s.meets(k) for k in kept) for s in spans)


def test_propagation():
    text = "Ana María Ruiz, ana maría ruiz; Ruiz ruiz xRuiz. 张三 和张三丰"
    out = propagate(text, [at(text, "Ana María Ruiz"), at(text, "张三")])
    assert [text[s.start : s.end] for s in out] == ["ana maría ruiz", "María", "Ruiz", "Ruiz", "张三"]
    assert propagate(text, [at(text, "Ana María Ruiz", enabled=False)]) == []
    assert merge(text, [at(text, "Ana María Ruiz")], SIZE)[1].source == "propagated"


def mended(text, kept, extra=()):
    return shown(text, repair.repair(text, kept, [*kept, *extra], SIZE))


def test_names_and_companies_grow():
    assert mended("por MARIA LOPEZ GARCIA hoy", [at("por MARIA LOPEZ GARCIA hoy", "MARIA")])[0][0] == "MARIA LOPEZ GARCIA"
    assert mended("DE LA CRUZ", [at("DE LA CRUZ", "CRUZ")])[0][0] == "DE LA CRUZ"
    text = "Banco Sur de Madrid"
    assert mended(text, [at(text, "Banco Sur", "COMPANY")])[0][0] == "Banco Sur de Madrid"
    text = "Ana de la Cruz"
    assert mended(text, [at(text, "Ana"), at(text, "Cruz")])[0][0] == "Ana de la Cruz"


def test_numbers_and_addresses_grow():
    text = "tel 06 12 34 56 78."
    assert mended(text, [at(text, "06 12", "PHONE")]) == [("06 12 34 56 78", "NUMBER", True)]
    text = "12 34/5"
    assert mended(text, [at(text, "12", "PHONE")]) == [("12", "PHONE", True)]
    text = "Flat 3, Park Road 12, Leeds LS"
    assert mended(text, [at(text, "Park Road 12", "ADDRESS")]) == [("Flat 3, Park Road 12, Leeds LS", "ADDRESS", True)]
    text = "12 Park Road\nLeeds West\nYorkshire 9"
    spans = [at(text, "12 Park Road", "ADDRESS"), at(text, "Yorkshire 9", "ADDRESS")]
    assert ("Leeds West", "ADDRESS", True) in mended(text, spans)


def test_overlapping_candidates_of_a_group_are_absorbed():
    text = "call Ana Maria Ruiz now"
    assert mended(text, [at(text, "Ana Maria")], [at(text, "Maria Ruiz")])[0][0] == "Ana Maria Ruiz"
    assert mended(text, [at(text, "Ana Maria")], [at(text, "Ana Maria Ruiz", enabled=False)])[0][0] == "Ana Maria"
