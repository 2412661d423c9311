from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from maskwork.operators import engine, native, reply
from maskwork.operators.ledger import Ledger
from maskwork.operators.review import Policy, Span, resolve_once
from maskwork.plans import api, sqlfunctions
from maskwork.sources import files, name_lists
from maskwork.sources.schema import PRIORITIES, SPANS, Unsupported

TEXTS = ["Mail jean.dupont@exemple.fr, card 4111 1111 1111 1111.", "😀 张三 at 192.168.1.1", "", None, "token = \"24be64439e3e49cf46b2d7c90f3602a3d0b907ff\""]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string")


def test_process_and_restore(docs):
    out = engine.process(docs, regions=[])
    rows = {r.doc_id: r for r in out.orderBy("doc_id").collect()}
    assert [s.type for s in rows[0].spans] == ["EMAIL", "CARD"] and rows[0].anonymized.text == "Mail [EMAIL_1], card [CARD_1]."
    assert rows[1].spans[0].start == len("😀 张三 at ".encode()) and rows[2].spans == [] and rows[3].spans is None and rows[3].anonymized is None
    back = engine.restore(out.select("doc_id", F.col("anonymized.text").alias("hidden"), "anonymized.mappings"), "hidden")
    assert [r.restored for r in back.orderBy("doc_id").collect()] == TEXTS


@pytest.mark.parametrize("unit,start", [("utf8", 5), ("utf16", 3), ("codepoint", 2)])
def test_offset_units(spark, unit, start):
    df = spark.createDataFrame([("😀 a@b.cd",)], "text string")
    s = engine.detect(df, regions=[], offset_unit=unit).first().spans[0]
    assert (s.start, s.value) == (start, "a@b.cd")
    assert engine.anonymize(engine.detect(df, regions=[], offset_unit=unit), offset_unit=unit).first().anonymized.replacements[0].start == start


def test_model_spans_dictionary_lists_and_policy(spark):
    df = spark.createDataFrame([("Ana Ruiz of Acme wrote to Ana", [("PERSON", "Ana Ruiz", 0, 8, 0.9, "ner", "model", None)])], f"text string, m {SPANS.simpleString()}")
    got = engine.detect(df, regions=[], model_col="m", lists=[("COMPANY", ["Acme"])], dictionary=["wrote"]).first().spans
    assert [(s.value, s.source) for s in got] == [("Ana Ruiz", "model"), ("Acme", "bundledList"), ("wrote", "dictionary")]
    got = engine.detect(df, regions=[], model_col="m", policy=Policy.parse({"PERSON": "keep"})).first().spans
    assert [(s.value, s.enabled) for s in got] == [("Ana Ruiz", False)]
    plug = engine.detect(df, regions=[], detectors=[lambda t: [Span("OTHER", 0, 3, 1.0, "plug", "manual")]]).first().spans
    assert plug[0].detector == "plug"


@pytest.mark.parametrize("span,message", [(("PERSON", "x", 3, 3, 0.9, "n", "model", True), "invalid range"), (("PERSON", "x", 0, 99, 0.9, "n", "model", True), "out of bounds"), (("PERSON", "x", 0, 1, 0.9, "n", "model", True), "character boundary"), (("WHO", "é", 0, 2, 0.9, "n", "model", True), "unknown type"), (("ID", "zz", 0, 2, 0.9, "n", "model", True), "is not the text")])
def test_bad_spans_are_refused(spark, span, message):
    df = spark.createDataFrame([("é then", [span])], f"text string, spans {SPANS.simpleString()}")
    with pytest.raises(Exception, match=message):
        engine.anonymize(df).collect()


def test_merge_chunk_regions_languages(spark, docs):
    df = spark.createDataFrame([("Ana Ruiz and Ana Ruiz", [("PERSON", "Ana Ruiz", 0, 8, 0.9, "ner", "manual", True)])], f"text string, spans {SPANS.simpleString()}")
    assert [s.source for s in engine.merge(df).first().merged] == ["manual", "propagated"]
    assert [r.chunks for r in engine.chunk(docs.filter("doc_id in (2, 3)")).orderBy("doc_id").collect()] == [[], None]
    tags = spark.createDataFrame([(["fr-FR", "zz"], "x"), ([], "汉"), (["ja"], "汉"), (["hi"], "x"), (["zh_TW", "EN"], "")], "l array<string>, text string")
    assert [r.regions for r in engine.regions(tags, "l").collect()] == [["be", "ch", "fr"], ["cn", "es", "fr", "gb", "us"], ["jp"], [], ["cn", "gb", "ie", "us"]]
    with pytest.raises(Unsupported):
        engine.languages(docs)
    assert engine.languages(docs, identify=lambda t: ["en"]).first().languages == ["en"]


def test_native_resolution_agrees(spark):
    rng = random.Random(5)
    rows = []
    for _ in range(60):
        rows.append(([("OTHER", "v", a, a + rng.randrange(1, 9), rng.choice([0.5, 0.9]), f"d{k}", rng.choice(list(PRIORITIES)), True) for k, a in enumerate(rng.randrange(30) for _ in range(10))],))
    got = spark.createDataFrame(rows, f"s {SPANS.simpleString()}").select("s", native.resolve(F.col("s")).alias("r")).collect()
    for r in got:
        want = resolve_once([Span(x.type, x.start, x.end, x.confidence, x.detector, x.source) for x in r.s], lambda s: s.end - s.start)
        assert [x.detector for x in r.r] == [s.detector for s in want]


def test_native_and_arrow_detectors_agree(spark, data):
    d = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text")
    a = native.long_spans(d.withColumn("spans", native.detect(F.col("text"))), ["doc_id"]).drop("ord")
    b = native.long_spans(engine.detect(d, rules=native.PLAIN_RULES, raw=True), ["doc_id"]).drop("ord")
    assert a.count() == b.count() > 0 and a.exceptAll(b).isEmpty()


def test_native_defaults_policy_and_ranges(spark):
    text = "born 01/02/1990 signed 03/04/2020"
    spans = [("DATE", "01/02/1990", 5, 15, 0.9, "d", "strongRule", True), ("DATE", "03/04/2020", 23, 33, 0.9, "d", "strongRule", True)]
    df = spark.createDataFrame([(text, spans)], f"t string, s {SPANS.simpleString()}")
    d = df.select(native.with_defaults(F.col("t"), F.col("s")).alias("s")).first().s
    assert [(x.type, x.enabled) for x in d] == [("BIRTH_DATE", True), ("DATE", False)]
    p = df.select(native.apply_policy(F.col("s"), {"DATE": "keep"}, F.array(F.struct(F.lit(0).alias("start"), F.lit(6).alias("end")))).alias("s")).first().s
    assert [(x.value, x.enabled) for x in p] == [("01/02/1990", False)]
    bad = lambda a, b: df.select(native.range_error(F.lit("é!"), F.array(F.struct(F.lit(a).alias("start"), F.lit(b).alias("end"))))).first()[0]
    assert bad(0, 2) is None and "empty" in bad(2, 2) and "outside the text (3 bytes)" in bad(0, 4) and "boundaries" in bad(1, 3)


def test_native_anonymising_keeps_separators_and_numbers_by_type(spark):
    text = "é, 1.2.3.4; a@b.cd a@b.cd 5.6.7.8"
    r = native.anonymise_frame(spark.createDataFrame([(text,), (None,), ("",)], "text string")).collect()
    assert r[0].anonymized == "é, [IP_1]; [EMAIL_1] [EMAIL_1] [IP_2]" and r[1].anonymized is None and r[2].anonymized == ""
    assert [m.placeholder for m in r[0].mappings] == ["[IP_1]", "[EMAIL_1]", "[IP_2]"]


def test_reply_by_joins_agrees_with_the_direct_way(spark):
    docs = [("a", "Lease: tenant [PERSON_1] pays rent to landlord [PERSON_2] for the flat", ["[PERSON_1]", "[PERSON_2]"]), ("b", "Invoice: customer [PERSON_1] owes 20 for repairs, IBAN [IBAN_1]", ["[PERSON_1]", "[IBAN_1]"]), ("c", "note", [])]
    replies = ["Dear tenant [PERSON_1], the landlord [PERSON_2] asks for rent", "customer [PERSON_1] owes repairs, IBAN [IBAN_1] [IBAN_3]", "[EXPEDIENTE_1] and [PERSON_9], [SSN_2]", "no labels", "[person 1] PERSON_2"]
    cands = spark.createDataFrame([(i, k, t, p) for k, (i, t, p) in enumerate(docs)], "id string, ord int, text string, placeholders array<string>")
    asked = [(f"{k}{own}", r, own) for k, r in enumerate(replies) for own in ("a", "b", "z")]
    got = {r.reply_id: (r.unknown, r.invented, r.better_match) for r in reply.reply_check(spark.createDataFrame(asked, "reply_id string, reply string, id string"), cands).collect()}
    for rid, text, own in asked:
        want = api.check_reply(text, own, [{"id": i, "text": t, "placeholders": p} for i, t, p in docs])
        assert got[rid] == (want["unknown"], want["invented"], want["better_match"]), rid


def test_labels_and_contexts():
    assert reply.label("**[person 1]**") == "person_1" and reply.label("[12/9/26, 9:14]") is None and reply.label("[note]") is None
    got = reply.index_text("about the man [PERSON_1] who lives; [person 1] again 😀")
    assert got["labels"] == ["person_1"] and got["contexts"][0]["words"] == ["about", "the", "man", "who", "lives", "again"]


def test_json_calls(spark):
    ask = lambda name, **r: json.loads(api.call(name, json.dumps({"schema_version": 1} | r)))
    out = ask("process", text="a@b.cd", regions=[])
    assert out["text"] == "[EMAIL_1]" and out["mappings"][0]["original"] == "a@b.cd"
    assert ask("restore", text="[email 1]", mappings=out["mappings"])["text"] == "a@b.cd"
    assert ask("detect", text="a@b.cd", regions=[], policy={"types": {"EMAIL": "off"}})["detections"] == []
    assert ask("chunk", text="Ana is")["chunks"] == [{"start": 0, "end": 3}, {"start": 4, "end": 6}]
    assert ask("merge", text="a@b.cd", detections=out["detections"])["detections"] == out["detections"]
    assert ask("anonymize", text="a@b.cd", detections=out["detections"])["replacements"][0]["placeholder"] == "[EMAIL_1]"
    assert ask("regions", languages=["pt"])["regions"] == ["pt"] and ask("languages", text="x")["status"] == "core_error"
    assert ask("reply_check", reply="[PERSON_2]", id="a", candidates=[{"id": "a", "text": "[PERSON_1]", "placeholders": ["[PERSON_1]"]}])["invented"] == ["[PERSON_2]"]
    assert json.loads(api.call("detect", "{"))["status"] == "invalid_json"
    assert json.loads(api.call("detect", '{"schema_version": 2, "text": ""}'))["status"] == "invalid_argument"
    assert ask("detect")["status"] == "invalid_json"
    assert ask("detect", text="x", policy={"types": {"PEOPLE": "hide"}})["status"] == "invalid_argument"
    col = spark.range(1).select(api.call_column("regions", F.lit('{"schema_version": 1, "languages": ["fi"]}')).alias("x")).first().x
    assert json.loads(col)["regions"] == ["fi"]


def test_sql_functions(spark):
    sqlfunctions.register(spark)
    r = spark.sql("select mask_check('luhn', '79927398713') c, mask_anonymize('x a@b.cd') a, mask_restore('[EMAIL_1]', array(named_struct('original', 'a@b.cd', 'placeholder', '[EMAIL_1]', 'type', 'EMAIL'))) r, mask_regions(array('sv'), '') g").first()
    assert (r.c, r.a, r.r, r.g) == (True, "x [EMAIL_1]", "a@b.cd", ["se"])
    assert spark.sql("select value, start from mask_spans('x a@b.cd')").collect()[0] == ("a@b.cd", 2)
    assert "[EMAIL_1]" in spark.sql("select mask_call('process', '{\"schema_version\": 1, \"text\": \"a@b.cd\"}') x").first().x


def test_files(spark, tmp_path, docs):
    (tmp_path / "t").mkdir(), (tmp_path / "d").mkdir(), (tmp_path / "m").mkdir()
    (tmp_path / "t/a.txt").write_text("line\none")
    assert files.read_texts(spark, str(tmp_path / "t")).first().text == "line\none"
    d = {"type": "SSN", "value": "1", "start": 0, "end": 1, "confidence": 0.5, "detector": "x", "source": "model"}
    (tmp_path / "d/a.json").write_text(json.dumps([d])), (tmp_path / "d/b.json").write_text(json.dumps({"detections": [d]}))
    got = files.read_detections(spark, str(tmp_path / "d")).collect()
    assert [(r.detections[0].type, r.detections[0].enabled) for r in got] == [("ID", True)] * 2
    (tmp_path / "m/a.json").write_text(json.dumps({"mappings": [{"original": "o", "placeholder": "[ID_1]", "type": "ID"}]}))
    assert files.read_mappings(spark, str(tmp_path / "m")).first().mappings[0].original == "o"
    found = engine.detect(docs, regions=[])
    for kind in ("json", "tsv", "parquet", "orc"):
        files.write_detections(found.filter("spans is not null"), str(tmp_path / kind), kind)
    assert spark.read.csv(str(tmp_path / "tsv"), sep="\t").count() == 4
    assert spark.read.json(str(tmp_path / "json")).filter("size(detections) > 0").first().schema_version == 1
    with pytest.raises(ValueError):
        files.write_detections(found, str(tmp_path / "x"), "xml")


def test_name_lists(spark):
    common = spark.createDataFrame([("en", "apple"), ("zh", "中心")], "lang string, word string")
    places = spark.createDataFrame([("p1", ["北京市", "中心"], "always", 9_000_000), ("p2", ["齐齐哈尔市"], "big", 10)], "id string, names array<string>, bare string, population long")
    p = name_lists.place_names(places, common)
    assert {r.name for r in p.collect()} == {"北京市", "北京", "齐齐哈尔市", "齐齐哈尔"}
    ents = spark.createDataFrame([("c1", ["Apple", "Apple Inc (company)", "BMW", "AB", "example.com", "lower", "北京", "华为技术", "Total: x", "Texas"], 50)], "id string, names array<string>, sitelinks int")
    assert {r.name for r in name_lists.company_names(ents, p, common).collect()} == {"Apple Inc", "华为技术"}
    assert name_lists.as_lists(p, "ADDRESS")[0][0] == "ADDRESS"


def test_mapping_length_is_in_utf16():
    m = Ledger().load([("😀😀", "[ID_1]", "ID"), ("abc", "[ID_1]", "ID")])
    assert m.longest["[ID_1]"] == "😀😀"


def test_native_scan_of_hostile_texts(spark):
    import time

    from maskwork.operators import native

    long_run = "x" * 1_000_000
    texts = ["\ufdd0\ufdd0 mail a.b@c.example.org here", "a@b.com.x@y.zz a@b.cc@d.ee", "1.2.3.4.5 999.1.1.1.1 1.1.1.1", "+1 (55O) 123-4567", "4111111111111112 4111111111111111", "ip 10.0.0.1\t10.0.0.2", "é" * 50 + " +1 (555) 123-4567", ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    native_found = {r.doc_id: r.candidates for r in native.detect_frame(df).collect()}
    arrow = {r.doc_id: r.spans for r in engine.detect(df, rules=native.PLAIN_RULES, raw=True).collect()}
    assert native_found == arrow and native_found[0][0].value == "a.b@c.example.org" and native_found[0][0].start == 12
    assert [s.value for s in native_found[3]] == ["+1 (55O) 123-4567"]
    started = time.perf_counter()
    (row,) = native.detect_frame(spark.createDataFrame([(long_run + " a@b.org",)], "text string")).collect()
    assert [s.value for s in row.candidates] == ["a@b.org"] and time.perf_counter() - started < 30


def test_native_scan_closes_cells(spark):
    from maskwork.operators import native
    from maskwork.sources.rules import Rule

    rules = [Rule("x:words", "x", "OTHER", r"[a-z]+\s[a-z]+", "", 0.9), Rule("x:tail", "x", "OTHER", r"[0-9]+[^;]*", "", 0.9)]
    texts = ["ab\tcd ef", "a b\tc d", "12 ab\tcd; 3", "\tab cd\t"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = {r.doc_id: r.candidates for r in native.detect_frame(df, rules=rules).collect()}
    assert got == {r.doc_id: r.spans for r in engine.detect(df, rules=rules, raw=True).collect()} and got[0]


def test_lists_and_unknown_fields_of_requests():
    ask = lambda **r: json.loads(api.call("detect", json.dumps({"schema_version": 1, "text": "Acme Works met 12345678", "regions": ["gb"], "later_field": 1} | r)))
    assert ask(include_bundled_lists=True)["status"] == "core_error"
    assert [d["detector"] for d in ask(include_bundled_lists=True, lists=[{"type": "COMPANY", "names": ["Acme Works"]}])["detections"]] == ["list:company", "regex:gb:bank_account"]
    assert [d["type"] for d in ask(selection={"disabled": ["regex:gb:bank_account"], "not_known": 3})["detections"]] == []
