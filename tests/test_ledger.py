from __future__ import annotations

from maskwork.operators.chunks import chunks
from maskwork.operators.ledger import Ledger, anonymise, canonical, gender_before, restore
from maskwork.operators.scan import Span


def span(text, value, kind="PERSON", enabled=True):
    i = text.index(value)
    return Span(kind, i, i + len(value), 0.9, "t", "model", enabled)


def test_numbers_reuse_and_variants():
    m = Ledger()
    assert m.placeholder("Paul Stein", "PERSON") == "[PERSON_1]" == m.placeholder("Paul", "PERSON")
    assert m.placeholder("王五先生", "PERSON") == "[PERSON_2]" == m.placeholder("王五", "PERSON")
    assert m.placeholder("Paul", "ID") == "[PERSON_1]"
    assert m.placeholder("a@b.cd", "EMAIL") == "[EMAIL_1]"
    assert restore("[PERSON_1]/[PERSON_2]", m) == "Paul Stein/王五先生"


def test_two_equally_good_people_are_a_third():
    m = Ledger()
    m.placeholder("Ana Ruiz", "PERSON"), m.placeholder("Ana Gil", "PERSON")
    assert m.placeholder("Ana", "PERSON") == "[PERSON_3]"


def test_gender_keeps_people_apart():
    m = Ledger()
    assert m.placeholder("Garnier", "PERSON", "female") == "[PERSON_1]"
    assert m.placeholder("Paul Garnier", "PERSON", "male") == "[PERSON_2]"
    for before, gender in [("Mme ", "female"), ("Dña. ", "female"), ("Mrs. ", "female"), ("M. ", "male"), ("D. ", "male"), ("Mr. ", "male"), ("NotMr ", None), ("Mr", None), ("", None)]:
        assert gender_before(before + "Garnier", len(before)) == gender, before


def test_loaded_numbers_go_on():
    m = Ledger().load([("张三", "[PERSON_4]", "PERSON"), ("1", "[SSN_7]", "ID"), ("x", "odd", "OTHER")])
    assert m.placeholder("李四", "PERSON") == "[PERSON_5]" and m.placeholder("2", "ID") == "[ID_8]"


def test_replacing():
    text = "Mail, Ana Ruiz, now; Ruiz 😀"
    spans = [span(text, ", Ana Ruiz,"), span(text, "Ruiz, now"), span(text, "Mail", enabled=False)]
    out, done = anonymise(text, spans, m := Ledger())
    assert out == "Mail, [PERSON_1], now; Ruiz 😀" and done == [(6, 14, "[PERSON_1]")]
    assert restore(out, m) == text
    assert anonymise("a , b", [Span("ID", 1, 3, 1, "t", "rule")], Ledger()) == ("a , b", [])


def test_altered_placeholders():
    m = Ledger()
    m.placeholder("王五", "PERSON"), m.placeholder("13900001111", "PHONE")
    assert restore("to *[Person-1]*, PERSON_1; [phone 1.]", m) == "to *王五*, 王五; 13900001111"
    assert restore("[PERSON_9] xPERSON_1 PERSON_12", m) == "[PERSON_9] xPERSON_1 PERSON_12"
    two = Ledger().load([("a", "[A_1]", "OTHER"), ("b", "<<a_1>>", "OTHER")])
    assert restore("[a 1]", two) == "[a 1]"
    assert canonical("**[Foo-Bar 2]**") == "foo_bar_2" and canonical("[*]") is None


def shown(text, taken=()):
    return [text[a:b] for a, b in chunks(text, taken)]


def test_chunks():
    assert shown("Please phone Laura Weber on 07 11 22 33 44, soon.") == ["Please", "phone", "Laura Weber on 07 11 22 33 44", "soon"]
    assert shown("Clara Stone saw Tim", [(6, 11)]) == ["Clara", "saw", "Tim"]
    assert shown("姓名：李四，地址") == ["姓名", "李四", "地址"]
    assert shown("Total: 1,250.00 €  | a.b@c.de\tx") == ["Total", "1,250.00 €", "a.b@c.de", "x"]
    assert shown("14 rue de la Paix\n-- . ") == ["14 rue de la Paix"]
    assert shown("Dr. No") == ["Dr. No"] and shown("") == []
    assert all(len(c) <= 60 for c in shown("Aa " * 50))
