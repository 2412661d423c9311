"""The 32 value checks, each defined once and evaluated in two ways.

A check is written against a small set of operations. `Columns` builds a Spark expression that
stays in the JVM; `Plain` computes on Python strings, for the Arrow detector and for tests that
hold the two against each other. Checks must not depend on evaluation being lazy: operations
outside a string's bounds give an empty string or 0, and the shape test that comes with every
check makes such results irrelevant.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

DIGITS = "0123456789"
ALNUM = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: Check letters, weights and tables of the national formats.
SPANISH_LETTERS = "TRWAGMYFPDXBNJZSQVHLCKE"
FINNISH_LETTERS = "0123456789ABCDEFHJKLMNPRSTUVWXY"
IRISH_LETTERS = "WABCDEFGHIJKLMNOPQRSTUV"
ITALIAN_ODD = [1, 0, 5, 7, 9, 13, 15, 17, 19, 21, 1, 0, 5, 7, 9, 13, 15, 17, 19, 21, 2, 4, 18, 20, 11, 3, 6, 8, 12, 14, 16, 10, 22, 25, 24, 23]
OCTET = r"\+?0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"


class Plain:
    """Operations on Python values."""

    def sub(self, v, pattern, by=""):
        return re.sub(pattern, by, v)

    def upper(self, v):
        return v.upper()

    def size(self, v):
        return len(v)

    def octets(self, v):
        return len(v.encode())

    def cut(self, v, i, j):
        return v[i:j]

    def tail(self, v, n):
        return v[-n:]

    def join(self, *parts):
        return "".join(parts)

    def number(self, v):
        return int(v) if v.isascii() and v.isdigit() else 0

    def index(self, v, i, alphabet=DIGITS):
        c = v[i : i + 1] if i >= 0 else v[i:][:1]
        return alphabet.find(c) if c else 0

    def pick(self, table, i):
        return table[i] if 0 <= i < len(table) else table[0]

    def full(self, v, pattern):
        return re.fullmatch(pattern, v) is not None

    def iff(self, c, a, b):
        return a if c else b

    def every(self, *conditions):
        return all(conditions)

    def some(self, *conditions):
        return any(conditions)

    def no(self, c):
        return not c

    def between(self, x, lo, hi):
        return lo <= x <= hi

    def fold(self, v, start, step, alphabet=ALNUM):
        return reduce(step, (alphabet.find(c) for c in v), start)

    def luhn(self, v):
        return bool(v) and v.isascii() and v.isdigit() and sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(v))) % 10 == 0

    def entropy(self, v):
        return sum(-n / len(v) * math.log2(n / len(v)) for n in Counter(v).values()) if v else 0.0


class Columns:
    """The same operations as Spark expressions."""

    def sub(self, v, pattern, by=""):
        return F.regexp_replace(v, "(?d)" + pattern, by)

    def upper(self, v):
        return F.upper(v)

    def size(self, v):
        return F.length(v)

    def octets(self, v):
        return F.octet_length(v)

    def cut(self, v, i, j):
        return F.substring(v, i + 1, max(0, j - i))

    def tail(self, v, n):
        return F.right(v, F.lit(n))

    def join(self, *parts):
        return F.concat(*parts)

    def number(self, v):
        return F.coalesce(F.when(v.rlike(r"\A[0-9]+\z"), v.try_cast("long")), F.lit(0).cast("long"))

    def index(self, v, i, alphabet=DIGITS):
        return F.position(F.substring(v, i + 1 if i >= 0 else i, 1), F.lit(alphabet)) - 1

    def pick(self, table, i):
        if isinstance(table, str):
            return F.substring(F.lit(table), i.cast("int") + 1, F.lit(1))
        return F.element_at(F.array(*map(F.lit, table)), F.greatest(i.cast("int"), F.lit(0)) + 1)

    def full(self, v, pattern):
        return v.rlike(rf"\A(?:{pattern})\z")

    def iff(self, c, a, b):
        return F.when(c, a).otherwise(b)

    def every(self, *conditions):
        return reduce(lambda a, b: a & b, conditions)

    def some(self, *conditions):
        return reduce(lambda a, b: a | b, conditions)

    def no(self, c):
        return ~c

    def between(self, x, lo, hi):
        return x.between(lo, hi)

    def fold(self, v, start, step, alphabet=ALNUM):
        places = F.transform(F.split(v, ""), lambda c: (F.position(c, F.lit(alphabet)) - 1).cast("long"))
        return F.aggregate(places, F.lit(start).cast("long"), lambda a, x: step(a, x).cast("long"))

    def luhn(self, v):
        return F.coalesce(F.call_function("luhn_check", v), F.lit(False))

    def entropy(self, v):
        chars = F.split(v, "")
        n = F.length(v)
        share = lambda c: F.size(F.filter(chars, lambda x: x == c)) / n
        bits = F.aggregate(F.array_distinct(chars), F.lit(0.0), lambda a, c: a - share(c) * F.log2(share(c)))
        return F.when(n > 0, bits).otherwise(0.0)


def digits(o, v):
    return o.sub(v, "[^0-9]")


def spaceless(o, v):
    return o.upper(o.sub(v, r"\s"))


def weighted(o, d, weights, alphabet=DIGITS):
    """Sum of weight times place in the alphabet, over the first characters of d."""
    return reduce(lambda a, b: a + b, (o.index(d, i, alphabet) * w for i, w in enumerate(weights) if w))


def shaped(o, v, pattern, *more):
    return o.every(o.full(v, pattern), *more)


def luhn(o, v):
    return o.luhn(o.sub(v, "[ -]"))


def iban(o, v):
    c = spaceless(o, v)
    turned = o.join(o.cut(c, 4, 34), o.cut(c, 0, 4))
    step = lambda a, x: (a * o.iff(x > 9, 100, 10) + x) % 97
    return shaped(o, c, "[0-9A-Z]{5,34}", o.fold(turned, 0, step) == 1)


def ip_octets(o, v):
    return o.full(v, rf"{OCTET}(?:\.{OCTET}){{3}}")


def nino(o, v):
    return o.full(spaceless(o, v), r"(?s)(?!BG|GB|NK|KN|TN|NT|ZZ)[^DFIQUV][^DFIOQUV].*")


def nhs(o, v):
    d = digits(o, v)
    return shaped(o, d, "[0-9]{10}", (11 - weighted(o, d, [10, 9, 8, 7, 6, 5, 4, 3, 2]) % 11) % 11 == o.index(d, 9))


def uk_driving_licence(o, v):
    c = o.sub(v, r"\s")
    month, day = o.number(o.cut(c, 6, 8)), o.number(o.cut(c, 8, 10))
    return shaped(o, c, r"[\x00-\x7f]{5}[0-9]{6}[\x00-\x7f]{5}", o.some(o.between(month, 1, 12), o.between(month, 51, 62)), o.between(day, 1, 31))


def pesel(o, v):
    d = digits(o, v)
    return shaped(o, d, "[0-9]{11}", (10 - weighted(o, d, [1, 3, 7, 9, 1, 3, 7, 9, 1, 3]) % 10) % 10 == o.index(d, 10))


def polish_id_card(o, v):
    c = spaceless(o, v)
    return shaped(o, c, "[0-9A-Z]{3}[0-9][0-9A-Z]{5}", weighted(o, c, [7, 3, 1, 0, 7, 3, 1, 7, 3], ALNUM) % 10 == o.index(c, 3))


def nip(o, v):
    d = digits(o, v)
    return shaped(o, d, "[0-9]{10,}", weighted(o, d, [6, 5, 7, 2, 3, 4, 5, 6, 7]) % 11 == o.index(d, 9))


def regon(o, v):
    d = digits(o, v)
    short = weighted(o, d, [8, 9, 2, 3, 4, 5, 6, 7]) % 11 % 10 == o.index(d, 8)
    long = weighted(o, d, [2, 4, 8, 5, 0, 9, 7, 3, 6, 1, 2, 4, 8]) % 11 % 10 == o.index(d, 13)
    return o.some(shaped(o, d, "[0-9]{9}", short), shaped(o, d, "[0-9]{14}", long))


def personnummer(o, v):
    c, d = o.sub(v, "[ -]"), o.sub(v, "[+-]")
    day = o.cut(d, 4, 6)
    return o.every(o.size(c) >= 10, o.full(day, "[0-9]{1,2}"), o.number(day) < 61, o.luhn(o.tail(c, 10)))


def samordningsnummer(o, v):
    d = o.sub(v, "[+-]")
    day = o.cut(d, 4, 6)
    return o.every(o.size(d) >= 10, o.full(day, "[0-9]{1,2}"), o.number(day) >= 61)


def dea(o, v):
    c = o.upper(v)
    d = o.cut(c, 2, 9)
    return shaped(o, c, "[ABCDEFGHJKLMPRSTUX][A-Z][0-9]{7}", weighted(o, d, [1, 2, 1, 2, 1, 2]) % 10 == o.index(d, 6))


def npi(o, v):
    d = digits(o, v)
    return shaped(o, d, "[0-9]{10}", o.luhn(o.join("80840" if isinstance(d, str) else F.lit("80840"), d)))


def aba(o, v):
    d = digits(o, v)
    return shaped(o, d, "[0-9]{9}", weighted(o, d, [3, 7, 1, 3, 7, 1, 3, 7, 1]) % 10 == 0)


def nir(o, v):
    d = digits(o, v)
    return shaped(o, d, "[12][0-9]{14}", 97 - o.number(o.cut(d, 0, 13)) % 97 == o.number(o.cut(d, 13, 15)))


def dni(o, v):
    c = o.upper(o.sub(v, "[ -]"))
    body = o.sub(c, r"(?s).\Z" if isinstance(c, str) else r"(?s).\z")
    return shaped(o, c, "(?s)[0-9]+[A-Z]", o.pick(SPANISH_LETTERS, o.number(body) % 23) == o.tail(c, 1))


def cups(o, v):
    c = spaceless(o, v)
    r = o.number(o.cut(c, 2, 18)) % 529
    first = (r - r % 23) / 23 if not isinstance(r, int) else r // 23
    return shaped(o, c, r"[\x00-\x7f]{2}[0-9]{16}[\x00-\x7f]{2,}", o.pick(SPANISH_LETTERS, first) == o.cut(c, 18, 19), o.pick(SPANISH_LETTERS, r % 23) == o.cut(c, 19, 20))


def codice_fiscale(o, v):
    c = o.upper(v)
    place = lambda i: o.index(c, i, ALNUM)
    even = lambda i: o.iff(place(i) < 10, place(i), place(i) - 10)
    total = reduce(lambda a, b: a + b, (even(i) if i % 2 else o.pick(ITALIAN_ODD, place(i)) for i in range(15)))
    return shaped(o, c, "[0-9A-Z]{15}[A-Z]", total % 26 == o.index(c, 15, ALNUM) - 10)


def partita_iva(o, v):
    c = o.sub(o.upper(v), "^IT")
    return shaped(o, c, "[0-9]{11}", o.luhn(c))


def bsn(o, v):
    d = digits(o, v)
    s = weighted(o, d, [9, 8, 7, 6, 5, 4, 3, 2, -1])
    return shaped(o, d, "[0-9]{9}", s > 0, s % 11 == 0)


def nif(o, v):
    d = digits(o, v)
    r = weighted(o, d, [9, 8, 7, 6, 5, 4, 3, 2]) % 11
    return shaped(o, d, "[125689][0-9]{8}", o.iff(r < 2, 0, 11 - r) == o.index(d, 8))


def fodselsnummer(o, v):
    d = digits(o, v)
    control = lambda w: (11 - weighted(o, d, w) % 11) % 11
    return shaped(o, d, "[0-3][0-9]{10}|40[0-9]{9}", control([3, 7, 6, 1, 8, 9, 4, 5, 2]) == o.index(d, 9), control([5, 4, 3, 2, 7, 6, 5, 4, 3, 2]) == o.index(d, 10))


def d_nummer(o, v):
    return o.full(digits(o, v), "(?:4[1-9]|[56][0-9]|7[01])[0-9]{9}")


def belgian_nrn(o, v):
    d = digits(o, v)
    a, k = o.number(o.cut(d, 0, 9)), o.number(o.cut(d, 9, 11))
    return shaped(o, d, "[0-9]{11}", o.some(97 - a % 97 == k, 97 - (a + 2_000_000_000) % 97 == k))


def svnr(o, v):
    d = digits(o, v)
    return shaped(o, d, "[1-9][0-9]{9}", weighted(o, d, [3, 7, 9, 0, 5, 8, 4, 2, 1, 6]) % 11 == o.index(d, 3))


def ahv(o, v):
    d = digits(o, v)
    return shaped(o, d, "756[0-9]{10}", (10 - weighted(o, d, [1, 3] * 6) % 10) % 10 == o.index(d, 12))


def steuer_id(o, v):
    d = digits(o, v)

    def step(p, x):
        s = (x + p) % 10
        return o.iff(s == 0, 10, s) * 2 % 11

    return shaped(o, d, "[1-9][0-9]{10}", (11 - o.fold(o.cut(d, 0, 10), 10, step)) % 10 == o.index(d, 10))


def hetu(o, v):
    c = o.upper(v)
    n = o.number(o.join(o.cut(c, 0, 6), o.cut(c, 7, 10)))
    return shaped(o, c, r"(?s)[0-9]{6}[\x00-\x7f][0-9]{3}[\x00-\x7f]+", o.pick(FINNISH_LETTERS, n % 31) == o.cut(c, 10, 11))


def pps(o, v):
    c = o.upper(v)
    second = o.cut(c, 8, 9)
    extra = o.iff(o.full(second, "[A-VX-Z]"), 9 * (o.index(c, 8, ALNUM) - 9), 0)
    return shaped(o, c, r"[0-9]{7}[\x00-\x7f]+", o.pick(IRISH_LETTERS, (weighted(o, c, [8, 7, 6, 5, 4, 3, 2]) + extra) % 23) == o.cut(c, 7, 8))


def secret_assignment(o, v):
    s = o.sub(o.sub(v, r"(?s)^[^:=]*[:=][> \t\n\r\"']*"), "=+$")
    bits = o.entropy(s)
    return o.every(o.full(v, "(?s).*[:=].*"), o.octets(s) >= 16, o.no(o.full(s, "[0-9]*")), bits >= o.iff(o.full(s, "[0-9a-fA-F]*"), 3.0, 4.0))


def high_entropy_token(o, v):
    s = o.sub(v, "=+$")
    return o.every(o.between(o.octets(s), 40, 256), o.full(s, "(?s).*[a-z].*"), o.full(s, "(?s).*[A-Z].*"), o.full(s, "(?s).*[0-9].*"), o.entropy(s) >= 4.5)


CHECKS: dict[str, Callable] = {
    "aba": aba, "ahv": ahv, "belgianNrn": belgian_nrn, "bsn": bsn, "codiceFiscale": codice_fiscale, "cups": cups, "dNummer": d_nummer, "dea": dea,
    "dni": dni, "fodselsnummer": fodselsnummer, "hetu": hetu, "highEntropyToken": high_entropy_token, "ibanMod97": iban, "ipOctets": ip_octets, "luhn": luhn, "nhs": nhs,
    "nif": nif, "nino": nino, "nip": nip, "nir": nir, "npi": npi, "partitaIva": partita_iva, "personnummer": personnummer, "pesel": pesel,
    "plIdCard": polish_id_card, "pps": pps, "regon": regon, "samordningsnummer": samordningsnummer, "secretAssignment": secret_assignment, "steuerId": steuer_id, "svnr": svnr, "ukDrivingLicence": uk_driving_licence,
}

_PLAIN, _COLUMNS = Plain(), Columns()


def check(name: str, value: str) -> bool:
    """The named check of a Python string."""
    return bool(CHECKS[name](_PLAIN, value))


def check_column(name: str, value: Column) -> Column:
    """The named check as a Spark expression; null for null."""
    return CHECKS[name](_COLUMNS, value)


def entropy_column(value: Column) -> Column:
    """Shannon entropy in bits over the characters of value."""
    return _COLUMNS.entropy(value)
