from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from maskwork.functions.validators import CHECKS, check, check_column, entropy_column

GOOD = {
    "aba": ["021000021", "011401533"], "ahv": ["756.1234.5678.97"], "belgianNrn": ["93051822361"], "bsn": ["111222333", "123456782"],
    "codiceFiscale": ["RSSMRA85T10A562S"], "cups": ["ES1234000000000001JN0F"], "dNummer": ["41010112345"], "dea": ["AB1234563"], "dni": ["12345678Z", "12345678-Z"],
    "fodselsnummer": ["01010750160"], "hetu": ["131052-308T"], "highEntropyToken": ["aB3dE5gH7jK9mN1pQ3sT5vW7yZ9bC2dF4hJ6kL8nP0"], "ibanMod97": ["GB29 NWBK 6016 1331 9268 19", "DE89370400440532013000"], "ipOctets": ["192.168.1.1", "0.0.0.255"],
    "luhn": ["4111 1111 1111 1111", "79927398713"], "nhs": ["943 476 5919"], "nif": ["123456789"], "nino": ["AB 12 34 56 C"], "nip": ["526-025-09-95"], "nir": ["2 55 08 14 168 025 38"], "npi": ["1234567893"],
    "partitaIva": ["IT07643520567"], "personnummer": ["811218-9876"], "pesel": ["44051401359"], "plIdCard": ["ABA300000"], "pps": ["1234567T"], "regon": ["123456785"], "samordningsnummer": ["701063-2391"],
    "secretAssignment": ['token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff'], "steuerId": ["86095742719"], "svnr": ["1237 010180"], "ukDrivingLicence": ["MORGA657054SM9IJ"],
}
BAD = {
    "aba": ["021000022"], "ahv": ["756.1234.5678.98"], "bsn": ["111222334", "000000000"], "dni": ["12345678A"], "ibanMod97": ["GB29 NWBK 6016 1331 9268 18", "GB2"], "ipOctets": ["999.1.1.1", "1.2.3", "1.2.3.4.5"],
    "luhn": ["4111 1111 1111 1112", "", "41a1"], "nhs": ["943 476 5918"], "nino": ["BG 12 34 56 C", "D"], "npi": ["1234567890"], "samordningsnummer": ["811218-9876"], "personnummer": ["701063-2391"],
    "secretAssignment": ["token = aaaaaaaaaaaaaaaaaaaaaaaa", "token 24be64439e3e49cf46b2d7c90f3602a3d0b907ff", "k=12345678901234567890"], "highEntropyToken": ["a" * 50], "steuerId": ["06095742719"], "pps": ["1234567A"],
}


def test_every_check_is_covered():
    assert set(GOOD) == set(CHECKS) and len(CHECKS) == 32


@pytest.mark.parametrize("name", sorted(CHECKS))
def test_known_values(name):
    assert all(check(name, v) for v in GOOD[name])
    assert not any(check(name, v) for v in BAD.get(name, []))


def test_columns_agree_with_plain(spark):
    rng = random.Random(7)
    values = [v for d in (GOOD, BAD) for vs in d.values() for v in vs]
    for v in list(values):
        for _ in range(3):
            k = rng.randrange(max(1, len(v)))
            values.append(v[:k] + rng.choice("0123456789AZ -x") + v[k + 1 :])
    values += ["", " ", "é" * 20, "１２３４５６７８９", "a=b", "x:" + "0f" * 10]
    df = spark.createDataFrame([(v,) for v in values], "v string").select("v", *(check_column(n, F.col("v")).alias(n) for n in CHECKS))
    for row in df.collect():
        for n in CHECKS:
            assert bool(row[n]) == check(n, row["v"]), (n, row["v"])


def test_entropy(spark):
    got = spark.createDataFrame([("aabb",), ("aaaa",), ("",), ("abcd",)], "v string").select(entropy_column(F.col("v"))).collect()
    assert [r[0] for r in got] == [1.0, 0.0, 0.0, 2.0]
