"""Example rows: text, value, type; the span must cover exactly the value."""

import pytest
from pyspark.sql import functions as F

from velaria.functions import checks
from velaria.operators import detect

FOUND = [
    ("Mi DNI es 12345678Z.", "12345678Z", "ES_DNI"),
    ("DNI 12.345.678-Z en el contrato", "12.345.678-Z", "ES_DNI"),
    ("DNI12345678Z pegado", "12345678Z", "ES_DNI"),
    ("DNI 1234\n5678Z cortado", "1234\n5678Z", "ES_DNI"),
    ("NIE: X-2482300-W", "X-2482300-W", "ES_NIE"),
    ("NIF K1234567L sin DNI", "K1234567L", "ES_NIF"),
    ("Empresa con CIF B64717838.", "B64717838", "ES_CIF"),
    ("NSS: 28/12345678/40", "28/12345678/40", "ES_NSS"),
    ("cuenta 0012 0345 03 0000067890 en el banco", "0012 0345 03 0000067890", "ES_CCC"),
    ("IBAN: ES0700120345030000067890", "ES0700120345030000067890", "IBAN"),
    ("cuenta DE89 3704 0044 0532 0130 00 en Alemania", "DE89 3704 0044 0532 0130 00", "IBAN"),
    ("IBAN GB29 NWBK 6016 1331 9268 19 fin", "GB29 NWBK 6016 1331 9268 19", "IBAN"),
    ("codice fiscale RCCMNL83S18D969H", "RCCMNL83S18D969H", "IT_CODICE_FISCALE"),
    ("VAT FR61954506077 (Francia)", "FR61954506077", "EU_VAT"),
    ("VAT FR 61954506077 (Francia)", "FR 61954506077", "EU_VAT"),
    ("tel +34 612 34 56 78 ya", "+34 612 34 56 78", "PHONE"),
    ("CP 08001 612345678", "612345678", "PHONE"),
    ("wa.me/34612345678", "34612345678", "PHONE"),
    ("tarjeta 4111 1111 1111 1111.", "4111 1111 1111 1111", "CREDIT_CARD"),
    ("amex 3782 822463 10005", "3782 822463 10005", "CREDIT_CARD"),
    ("mail ana.garcía@example.com.", "ana.garcía@example.com", "EMAIL"),
    ("ip 192.0.2.7,", "192.0.2.7", "IP"),
    ("vive en C/ Mayor 5, 3º B, 08001 Bar", "C/ Mayor 5, 3º B, 08001", "ADDRESS"),
    ("en Paseo de las Pruebas 12", "Paseo de las Pruebas 12", "ADDRESS"),
    ("nacida el 12 de marzo de 1985", "12 de marzo de 1985", "DATE_OF_BIRTH"),
    ("fecha de nacimiento: 29/02/2000", "29/02/2000", "DATE_OF_BIRTH"),
    ("pasaporte ABC123456", "ABC123456", "ES_PASSPORT"),
    ("matrícula 1234 BCD", "1234 BCD", "ES_PLATE"),
    ("contribuinte 501964843", "501964843", "PT_NIF"),
    ("Steuer-ID 36574261809", "36574261809", "DE_IDNR"),
    ("NIR 295109912611193", "295109912611193", "FR_NIR"),
    ("😀 DNI 1234​5678Z", "1234​5678Z", "ES_DNI"),
    ("DNI １２３４５６７８Ζ x", "１２３４５６７８Ζ", "ES_DNI"),
]
CLEAN = [
    "DNI 12345678A mala letra",
    "ref 912345678Z demasiados dígitos",
    "sha 3f2a12345678b9c0d1e2f3a4b5c6d7e8f9a0b1c2",
    "precio 900 123 456 y 902123456",
    "a600123456B pegado",
    "fecha 31/02/1990 nacido no",
    "factura del 12/03/1985",
    "ABC123456 sin palabra",
    "hotel612",
    "versión 1.2.3.4.5",
    "12345678 casas",
    "IBAN ES0700120345030000067891",
    "el camino es largo 5",
]


@pytest.fixture(scope="module")
def scanned(spark):
    rows = [(text,) for text, _, _ in FOUND] + [(text,) for text in CLEAN]
    df = spark.createDataFrame(rows, "text string")
    return {r.text: r.spans for r in detect.scan(df).collect()}


def test_values_are_found_whole(scanned):
    for text, value, entity in FOUND:
        got = [(s.type, text[s.start : s.end]) for s in scanned[text]]
        assert got == [(entity, value)], text


def test_look_alikes_of_values_are_not(scanned):
    assert {t: scanned[t] for t in CLEAN if scanned[t]} == {}


def test_null_and_empty_texts(spark):
    df = spark.createDataFrame([(None,), ("",)], "text string")
    assert [r.spans for r in detect.scan(df).collect()] == [[], []]


def test_cards_in_a_list_and_overlapping_candidates(spark):
    text = "4111111111111111 5500005555555559, 612 345 678 4111111111111111"
    df = spark.createDataFrame([(text,)], "text string")
    spans = detect.scan(df, types=("CREDIT_CARD",)).first().spans
    assert [text[s.start : s.end] for s in spans] == ["4111111111111111", "5500005555555559"]


def test_many_matches_are_placed_past_one_block(spark):
    text = " ".join(f"u{i}@example.com" for i in range(300))
    df = spark.createDataFrame([(text,)], "text string")
    spans = detect.scan(df, types=("EMAIL",)).first().spans
    assert [text[s.start : s.end] for s in spans] == text.split(" ")


def test_vat_rules_accept_public_examples(spark):
    numbers = [
        "ATU13585627", "BE0403019261", "BG175074752", "CY10259033P", "CZ25123891", "DE136695976",
        "DK13585628", "EE100931558", "EL094259216", "ESB64717838", "FI20774740", "FR40303265045",
        "HR33392005961", "HU12892312", "IE6433435F", "IT00743110157", "LT119511515", "LU15027442",
        "LV40003521600", "MT11679112", "NL004495445B01", "PL8567346215", "PT501964843",
        "RO18547290", "SE123456789701", "SI50223054", "SK2022749619", "XI980780684",
    ]
    df = spark.createDataFrame([(n,) for n in numbers], "n string")
    bad = [r.n for r in df.filter(~checks.eu_vat(F.col("n"))).collect()]
    assert bad == []
    turned = [n[:-1] + chr((ord(n[-1]) - 48 + 1) % 10 + 48) for n in numbers if n[-1].isdigit() and n[:2] not in ("NL", "SE")]
    df = spark.createDataFrame([(n,) for n in turned], "n string")
    assert df.filter(checks.eu_vat(F.col("n"))).count() == 0


def test_nss_has_two_branches(spark):
    def control(p, n):
        return (n + p * 10**7 if n < 10**7 else p * 10**8 + n) % 97

    rows = [(f"{p:02d}{n:08d}{control(p, n):02d}",) for p in (1, 28, 52) for n in (0, 9_999_999, 10_000_000, 99_999_999)]
    df = spark.createDataFrame(rows, "n string")
    assert df.filter(~checks.nss(F.col("n"))).count() == 0
