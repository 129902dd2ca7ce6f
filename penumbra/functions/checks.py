"""Validity of matched values, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns as P


def let(value: Column, use) -> Column:
    """use(value), with value computed once however often `use` refers to it."""
    return F.transform(F.array(value), use)[0]


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def number(text: Column) -> Column:
    """Of a string known to hold digits only; null for anything else."""
    return text.try_cast("bigint")


def sum_of(items: Column) -> Column:
    return F.aggregate(items, F.lit(0), lambda a, b: a + b)


def each_digit(text: Column, use) -> Column:
    """use(digit, index) for each character of a string of digits; an empty string has none."""
    return F.when(text == "", F.array().cast("array<int>")).otherwise(F.transform(F.split(text, ""), lambda c, i: use(F.coalesce(c.try_cast("int"), F.lit(0)), i)))


def luhn(d: Column) -> Column:
    """Whether every second digit from the right, doubled, brings the sum to a multiple of ten; true without digits."""
    doubled = lambda n, i: F.when(i % 2 == 0, n).otherwise(n * 2 - F.when(n > 4, 9).otherwise(0))
    return sum_of(each_digit(F.reverse(d), doubled)) % 10 == 0


def mod97(d: Column) -> Column:
    """Remainder of a string of digits of any length."""
    return F.aggregate(F.split(d, ""), F.lit(0), lambda a, c: (a * 10 + F.coalesce(c.try_cast("int"), F.lit(0))) % 97)


def nir(v: Column) -> Column:
    def test(s: Column) -> Column:
        base = F.replace(F.replace(F.substring(s, 1, 13), F.lit("2A"), F.lit("19")), F.lit("2B"), F.lit("18"))
        shaped = (F.length(s) == 15) & base.rlike("^[0-9]{13}$") & s.rlike("[0-9]{2}$")
        return F.coalesce(F.when(shaped, F.lit(97) - number(base) % 97 == number(F.substring(s, 14, 2))), F.lit(False))

    return let(F.upper(F.regexp_replace(v, "[ .-]", "")), test)


def ssn(v: Column) -> Column:
    d = digits(v)
    area = F.substring(d, 1, 3)
    return (F.length(d) == 9) & ~area.isin("000", "666") & (area < "900") & (F.substring(d, 4, 2) != "00") & (F.substring(d, 6, 4) != "0000")


def iban(v: Column) -> Column:
    def test(s: Column) -> Column:
        turned = F.concat(F.substring(s, 5, 34), F.substring(s, 1, 4))
        told = F.array_join(F.transform(F.split(turned, ""), lambda c: F.when(c.rlike("[A-Z]"), (F.ascii(c) - 55).cast("string")).otherwise(c)), "")
        return F.when(F.length(s).between(15, 34) & s.rlike("^[A-Z]{2}[0-9]{2}[A-Z0-9]*$"), mod97(told) == 1).otherwise(False)

    return let(F.upper(F.regexp_replace(v, "\\s", "")), test)


def issuer(d: Column) -> Column:
    """Network of a card number by prefix and length; null if no issuer uses them."""
    out = None
    for name, n, low, high, lengths in P.ISSUERS:
        test = number(F.substring(d, 1, n)).between(low, high)
        then = F.when(F.length(d).isin(*lengths), name)
        out = F.when(test, then) if out is None else out.when(test, then)
    return out


def card(v: Column) -> Column:
    return let(digits(v), lambda d: F.when(F.length(d).between(13, 19) & issuer(d).isNotNull(), luhn(d)).otherwise(False))


def phone(v: Column) -> Column:
    d = digits(v)
    return F.length(d).between(7, 15) & (F.length(v) > F.length(d))


def vat_parts(v: Column) -> tuple[Column, Column]:
    """(country, body) in upper case."""
    return F.upper(F.substring(v, 1, 2)), F.upper(F.regexp_replace(F.substr(v, F.lit(3)), "^[ \\u00a0]", ""))


def vat_score(v: Column) -> Column:
    """Score of a VAT number, null if it is none. Checksums reject, they never lower a score."""
    country, body = vat_parts(v)
    checked, form = F.lit(P.VAT_CHECKED), F.lit(P.VAT_FORMAT)
    siren = number(F.substring(body, 3, 9))
    weights = F.array(*(F.lit(w) for w in range(9, 1, -1)))
    weighted = F.aggregate(F.zip_with(weights, F.slice(F.split(body, ""), 1, 8), lambda w, c: w * F.coalesce(c.try_cast("int"), F.lit(0))), F.lit(0), lambda a, b: a + b)
    rule = (
        F.when(country == "FR", F.when(body.rlike("^[0-9]{11}$"), F.when((siren % 97 * 3 + 12) % 97 == number(F.substring(body, 1, 2)), checked)).when(body.rlike("^[A-Z0-9]{2}[0-9]{9}$"), form))
        .when(country == "BE", F.when(body.rlike("^[0-9]{10}$"), F.when(F.lit(97) - number(F.substring(body, 1, 8)) % 97 == number(F.substring(body, 9, 2)), checked)))
        .when(country == "NL", F.when(body.rlike("^[0-9]{9}B[0-9]{2}$"), F.when(weighted % 11 == number(F.substring(body, 9, 1)), checked)))
        .when(country == "LU", F.when(body.rlike("^[0-9]{8}$"), F.when(number(F.substring(body, 1, 6)) % 89 == number(F.substring(body, 7, 2)), checked)))
    )
    for shape in dict.fromkeys(P.VAT_FORMS.values()):
        rule = rule.when(country.isin([c for c, s in P.VAT_FORMS.items() if s == shape]), F.when(body.rlike(f"^{shape}$"), form))
    return F.when(~v.rlike("[^\\x00-\\x7f\\u00a0]"), rule)


def labelled(text: Column, cstart: Column) -> Column:
    """Whether a company label stands in the characters before a number."""
    before = F.substr(text, F.greatest(cstart - (P.LABEL_REACH - 1), F.lit(1)), F.least(cstart, F.lit(P.LABEL_REACH)))
    return before.rlike(f"(?i)(?:{P.LABELS})")


def siret(v: Column) -> Column:
    d = digits(v)
    return F.when(F.substring(d, 1, 9) == P.LA_POSTE, sum_of(each_digit(d, lambda n, i: n)) % 5 == 0).otherwise(luhn(d))


def grouped(v: Column) -> Column:
    return v.rlike("(?U)^\\d{3}[ .]\\d{3}[ .]\\d{3}[ .]\\d{5}$")


def siren(v: Column) -> Column:
    return luhn(digits(v))


def luhn_only(v: Column) -> Column:
    return luhn(digits(v))
