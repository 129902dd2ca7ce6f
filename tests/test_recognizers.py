"""Vectors: what each recognizer finds and where (bytes), and what it leaves alone."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from penumbra.functions import patterns as P
from penumbra.functions.spans import before, byte_places, find_all, scan
from penumbra.operators.detect import entities_of
from penumbra.operators.mask import redact
from penumbra.operators.recognizers import Recognizer

VECTORS = [
    ("FR_NIR", "185017512345609", [(0, 15)]),
    ("FR_NIR", "1 85 05 78 120 123 27", [(0, 21)]),
    ("FR_NIR", "2.96.01.12.345.678.59", [(0, 21)]),
    ("FR_NIR", "185032A03411208", [(0, 15)]),
    *[("FR_NIR", t, []) for t in ("291059933807693", "291139933807692", "29105993380769", "1850175123456090", "2-91-05-99-338-076-92")],
    ("FR_NIR", "mon numéro de sécurité sociale est 1 85 01 75 123 456 09", [(38, 59)]),
    ("EMAIL_ADDRESS", "Contact john.smith@example.com for details.", [(8, 30)]),
    ("EMAIL_ADDRESS", "no email here", []),
    ("EMAIL_ADDRESS", "josé@example.com", []),
    ("EMAIL_ADDRESS", "rené.dupont@example.com", [(5, 24)]),
    ("US_SSN", "536-90-4399", [(0, 11)]),
    ("US_SSN", "536 90 4399", [(0, 11)]),
    *[("US_SSN", t, []) for t in ("000-12-3456", "666-12-3456", "901-12-3456", "536-00-4399", "536-90-0000", "536904399")],
    ("IBAN_CODE", "GB82WEST12345698765432", [(0, 22)]),
    ("IBAN_CODE", "GB82 WEST 1234 5698 7654 32", [(0, 27)]),
    ("IBAN_CODE", "wire to GB82WEST12345698765432 by Friday", [(8, 30)]),
    *[("IBAN_CODE", t, []) for t in ("GB82WEST12345698765433", "GB82WEST", "BE68539007547034 EUR", "A" * 9 + "1" * 20000)],
    ("IBAN_CODE", "BE68539007547034 by", [(0, 17)]),
    *[("CREDIT_CARD", t, [(0, len(t))]) for t in ("4111111111111111", "4111 1111 1111 1111", "3782-822463-10005", "5555555555554444", "2223003122003222", "6011111111111117", "3530111333300000", "36227206271667", "4222222222222")],
    *[("CREDIT_CARD", t, []) for t in ("4111111111111112", "73282932000074", "SIRET 732 829 320 00074", "9999999999999996", "411111111111111116", "4111111111111111 12")],
    ("PHONE_NUMBER", "téléphonez au : 0156 35 9180", [(18, 30)]),
    *[("PHONE_NUMBER", t, [(0, len(t))]) for t in ("212-555-0143", "(212) 555-0143", "+33 6 12 34 56 78", "01 56 35 91 80", "01.56.35.91.80")],
    *[("PHONE_NUMBER", t, []) for t in ("0156359180", "944 681 634 00019", "2125550143")],
    *[("EU_VAT", t, [(0, len(t))]) for t in ("FR40303265045", "fr40303265045", "FR 40303265045", "BE0776091951", "NL123456782B90", "LU12345613", "DE123456789", "IT12345678901", "ATU12345678", "IE1234567FA")],
    *[("EU_VAT", t, []) for t in ("FR41303265045", "BE0776091952", "NL123456783B90", "LU12345614", "US123456789", "CH123456789", "GB123456789", "DE12345678", "DE1234567890", "de DE123456789", "FR40 303265045", "Dſ123456789")],
    ("EU_VAT", "la somme de 123456789", [(9, 21)]),
    ("EU_VAT", "RO49 AAAA 1B31 0075 9384 0000", [(0, 4)]),
    ("EU_VAT", "DE 123456789", [(0, 13)]),
    ("FR_SIRET", "SIRET 73282932000074", [(6, 20)]),
    ("FR_SIRET", "N° SIRET : 732 829 320 00074", [(12, 29)]),
    ("FR_SIRET", "75008 PARIS 944 681 634 00019 66198", [(12, 29)]),
    ("FR_SIRET", "SIRET 35600000009075", [(6, 20)]),
    *[("FR_SIRET", t, []) for t in ("Référence 73282932000074", "SIRET 73282932000075", "SIRET 35600000000048")],
    *[("FR_SIREN", t, [(len(t) - n, len(t))]) for t, n in (("SIREN 732 829 320", 11), ("RCS Paris 732 829 320", 11), ("SIREN 356000000", 9), ("parcs 732829320", 9))],
    ("FR_SIREN", "SIRET 732 829 320 00074", [(6, 17)]),
    *[("FR_SIREN", t, []) for t in ("Total 732829320", "montant : 732 829 320", "SIREN 732829321", "SIRET 73282932000074")],
    ("FR_SIREN", "RCS" + "." * 45 + " 732829320", [(49, 58)]),
    ("FR_SIREN", "RCS" + "." * 46 + " 732829320", []),
]
SCORES = {"FR_NIR": 1.0, "EMAIL_ADDRESS": 0.9, "US_SSN": 0.85, "IBAN_CODE": 1.0, "CREDIT_CARD": 1.0, "PHONE_NUMBER": 0.75, "FR_SIRET": 1.0, "FR_SIREN": 1.0}


@pytest.fixture(scope="module")
def found(spark):
    rows = [(i, t) for i, (_, t, _) in enumerate(VECTORS)] + [(-1, None), (-2, ""), (-3, "a\u0001b x@y.com \u0001 4222222222222")]
    out = redact(spark.createDataFrame(rows, "id int, text string"), include_text=True).collect()
    return {r["id"]: r for r in out}


@pytest.mark.parametrize("i", range(len(VECTORS)))
def test_vector(found, i):
    entity, text, spans = VECTORS[i]
    own = [e for e in found[i]["entities"] if e["entity_type"] == entity]
    assert [(e["start"], e["end"]) for e in own] == spans
    for e in own:
        raw = text.encode()
        assert raw[e["start"] : e["end"]].decode() == text[e["cstart"] : e["cend"]] == e["value"]
        if entity in SCORES:
            assert e["score"] == pytest.approx(SCORES[entity])


def test_masks_keep_length_and_order(found):
    for r in found.values():
        if r["text"] is None:
            assert r["redacted"] is None and r["entities"] == []
            continue
        assert len(r["redacted"]) == len(r["text"])
        keys = [(e["rec_order"], e["start"]) for e in r["entities"]]
        assert keys == sorted(keys)
        for e in r["entities"]:
            assert set(r["redacted"][e["cstart"] : e["cend"]]) == {"█"}


def test_the_mark_in_a_text(found):
    assert [(e["entity_type"], e["start"]) for e in found[-3]["entities"]] == [("EMAIL_ADDRESS", 4), ("CREDIT_CARD", 14)]
    assert found[-3]["redacted"].startswith("a\u0001b ")


# ---- long texts


def random_texts(seed, parts, n, most):
    r = random.Random(seed)
    return ["".join(r.choice(parts) for _ in range(r.randint(0, most))) for _ in range(n)]


@pytest.mark.parametrize(
    ("entity", "texts"),
    [
        ("EMAIL_ADDRESS", random_texts(1, "ab.-_%+@éZ 9Ö\n", 4000, 60) + random_texts(2, ["a@b.io", "x", "-", ".", "_", "é", "@", "c.d@e.fr", "1", "%"], 4000, 12)),
        ("IBAN_CODE", random_texts(3, ["AA11", "AAAA", " ", "AB1", "é", "b", "7", "BE68539007547034 ", "x"], 4000, 14)),
    ],
)
def test_scans_without_going_back_find_the_same(spark, entity, texts):
    """The forms for long texts against the plain patterns, here and in another engine."""
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    places = lambda c: F.transform(c, lambda s: F.struct(s["cstart"], s["cend"]))
    rows = df.select("i", places(scan(F.col("t"), entity, P.PATTERN[entity])).alias("fast"), places(find_all(F.col("t"), P.PATTERN[entity])).alias("plain")).collect()
    plain = re.compile(P.PATTERN[entity])
    for r in rows:
        assert r["fast"] == r["plain"] and [tuple(s) for s in r["fast"]] == [m.span() for m in plain.finditer(texts[r["i"]])]


HOSTILE = {
    "dots": ("a." * 20_000 + "@", 0), "signs": ("a@" * 20_000, 0), "dots before a domain": ("a." * 20_000 + "b@c.io", 1), "groups": ("AA00 " + "AAAA " * 20_000, 0), "one group": ("AA00" + "AAAA" * 20_000 + "b", 0),
    "digits": ("1234567890 " * 10_000, 0), "emails": ("mail é a@b.io now " * 20_000, 20_000), "cards": ("4111 1111 1111 1111, " * 4_000, 4_000),
}


@pytest.mark.parametrize("name", list(HOSTILE))
def test_time_is_in_proportion_to_a_text(spark, name):
    """What took seconds to minutes by going back or by growing strings."""
    text, n = HOSTILE[name]
    df = spark.createDataFrame([(text,)], "text string")
    redact(df.limit(0)).collect()
    t = time.perf_counter()
    row = redact(df).select("redacted", F.size("entities").alias("n")).first()
    assert time.perf_counter() - t < 12 and row["n"] == n and len(row["redacted"]) == len(text)
    if name == "emails":
        assert row["redacted"] == "mail é ██████ now " * 20_000


def test_running_folds(spark):
    """Folds of all items before an index, for arrays of any length."""
    rows = [(list(range(n, 0, -1)),) for n in (0, 1, 2, 3, 8, 9, 10, 50)]
    df = spark.createDataFrame(rows, "a array<int>")
    at = lambda zero, add: before(F.col("a"), F.lit(zero), add, lambda upto: F.transform(F.sequence(F.lit(0), F.size("a")), lambda i: upto(i)))
    for a, total, most in df.select("a", at(0, lambda x, y: x + y), at(0, lambda x, y: F.greatest(x, y))).collect():
        assert total == [sum(a[:i]) for i in range(len(a) + 1)] and most == [max([0, *a[:i]]) for i in range(len(a) + 1)]


def test_places_in_bytes(spark):
    text = "é1😀a" * 3000
    df = spark.createDataFrame([(text, [-3, 0, 1, 5, 2048, 4096, 8191, 12_000, 99_999]), ("plain", [0, 3, 9]), ("", [0, 1]), ("é", [])], "t string, c array<int>")
    for t, c, got in df.select("t", "c", byte_places(F.col("t"), F.col("c"))).collect():
        assert got == [len(t[: max(0, x)].encode()) for x in c]


def test_a_recognizer_of_ones_own(spark):
    """Its pattern is taken as it is, also under a type that is known."""
    mine = Recognizer("EMAIL_ADDRESS", r"\b[a-z]+ at [a-z.]+\b", score=lambda v: F.lit(0.5))
    other = Recognizer("ORDER_NO", r"#\d{4}", score=lambda v: F.lit(1.0), valid=lambda v: v != "#0000")
    df = spark.createDataFrame([("bob at x.org, c@d.io, #1234 #0000",)], "text string")
    got = df.select(entities_of("text", ["EMAIL_ADDRESS", "ORDER_NO"], more=(mine, other)).alias("e")).first()["e"]
    assert [(e["entity_type"], e["value"]) for e in got] == [("EMAIL_ADDRESS", "c@d.io"), ("EMAIL_ADDRESS", "bob at x.org"), ("ORDER_NO", "#1234")]


def test_values_of_a_scan_without_places(spark):
    from pyspark.sql import functions as F

    from penumbra.functions import patterns as P
    from penumbra.functions.spans import scan, scanned_values
    from penumbra.plans import catalogue

    texts = ["", "a.b@c.io x@y.org, 123-45-6789 \u0001 123 45 6789", "DE12 3456 7890 FR12345678901 é", "no", None, "+33 1 23 45 67 89 4111 1111 1111 1111"]
    rows = spark.createDataFrame([(t,) for t in texts], "text string")
    for entity in P.ORDER:
        both = rows.select(scan(F.col("text"), entity, P.PATTERN[entity])["value"].alias("a"), scanned_values(F.col("text"), entity, P.PATTERN[entity]).alias("b")).collect()
        assert all((r["a"] or []) == (r["b"] or []) for r in both)
    plan = catalogue.QUERIES["sql_checks"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "4294967296" not in plan
