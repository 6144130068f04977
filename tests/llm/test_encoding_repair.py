import pytest

from geoskein.llm import mojibake as M
from geoskein.llm.encoding_repair import garbled_values, repair_records

DECODERS = ("cp1252", "cp437", "cp850", "mac_roman")
NAMES = ["Sølvgadekvarteret", "Måløvang", "Æblehaven", "Kystområdet – øst", "Île Brune"]


@pytest.mark.parametrize("decoder", DECODERS)
@pytest.mark.parametrize("name", NAMES)
def test_round_trip_of_utf8(name, decoder):
    garbled = name.encode("utf-8").decode(decoder, errors="replace")
    if M.REPLACEMENT in garbled:
        pytest.skip("bytes lost")
    assert M.repair_utf8(garbled)[0] == name


@pytest.mark.parametrize("name", NAMES)
def test_layers_and_case(name):
    twice = name
    for _ in range(2):
        twice = "".join(bytes([b]).decode("cp1252") if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D) else chr(b) for b in twice.encode("utf-8"))
    assert M.repair_utf8(twice)[0] == name
    assert M.repair_utf8("amlã¸se ã˜st")[0] == "amløse øst"


@pytest.mark.parametrize("text", ["Ø", "São Ø", "“Øerne”", "3° Nord", "Zone µ", "København ½", "Île Ærø", "Malmö/Øresund…", "Nørre‑Sønder", "Сёмга", "Ålborg"])
def test_unusual_but_correct(text):
    assert M.repair_utf8(text) is None


def test_mixed_spans_are_decoded_alone():
    assert M.repair_utf8("Amløse Ã˜st")[0] == "Amløse Øst"


def _shown(text, decoder, times):
    """UTF-8 bytes read by the decoder, bytes it leaves undefined as themselves."""
    for _ in range(times):
        text = "".join((bytes([b]).decode(decoder, "ignore") or chr(b)) if b >= 0x80 else chr(b) for b in text.encode("utf-8"))
    return text


SCRIPTS = ["naïve 😀", "東京", "안녕", "שלום", "Привет мир", "Ελλάδα", "ひらがな", "नमस्ते", "مرحبا", "สวัสดี", "Łódź Białystok", "It’s “ok” – 5 €", "3 °C"]


@pytest.mark.parametrize("times", [1, 2, 3, 4])
@pytest.mark.parametrize("decoder", ["latin-1", "cp1252", "cp437", "mac_roman"])
def test_any_script_and_number_of_layers(decoder, times):
    for text in SCRIPTS:
        assert M.repair_utf8(_shown(text, decoder, times))[0] == text, text


@pytest.mark.parametrize("text", [*SCRIPTS, "CAFÉ”", "Ö…", "SMÅ–", "Гёте", "é…", "Ñandú…", "Český Krumlov", "ŁÓDŹ…", "ÉTÉ»", "Ελλάς Ø", "한국어…", "são joão", "ação…", "ã”", "½ × 3"])
def test_correct_text_of_any_script_stays(text):
    assert M.repair_utf8(text) is None and M.repair_utf8(text.lower()) is None


def test_spans_are_maximal_and_whole():
    assert M._runs([(0xC3,), (0xB8,), (0xE6,), (0x9D,), (0xB1,), (), (0xE6,), (0x9D,)]) == [(0, 5, b"\xc3\xb8\xe6\x9d\xb1")]
    assert M._runs([(0xED,), (0xA0,), (0x80,)]) == [] == M._runs([(0xC0,), (0x80,)])  # a surrogate, an overlong form


def test_lower_case_needs_signs_or_evidence(spark):
    assert M.repair_utf8("ã…lekistevej") is None
    rows = ["Ålekistevej"] * 10 + ["ã…lekistevej", "ã…unknown"]
    got = {r.value: (r.restored, r.encoding) for r in garbled_values(_values(spark, rows)).collect()}
    assert got == {"ã…lekistevej": ("ålekistevej", "utf-8 as cp1252, lower case")}


def _values(spark, rows):
    return spark.createDataFrame([(v,) for v in rows], "value string")


def test_evidence_for_single_byte_confusion(spark):
    rows = ["Møllestien"] * 12 + ["Måløvang"] * 12 + ["M°llestien", "Mеlшvang", "Zone µ", "M�llestien", "�x�y", None, "", "plain", "Ø" * 20_000]
    got = {r.value: (r.restored, r.encoding) for r in garbled_values(_values(spark, rows)).collect()}
    assert got["M°llestien"][0] == "Møllestien"
    assert got["Mеlшvang"] == ("Måløvang", "cp1252 as cp1251")
    assert got["M�llestien"] == ("Møllestien", "lost")
    assert got["�x�y"] == (None, "lost")
    assert set(got) == {"M°llestien", "Mеlшvang", "M�llestien", "�x�y"}


def test_neither_repetition_nor_a_rare_case_vetoes(spark):
    # a third of the rows come from a wrongly decoded file; 'østerlund' is rare in lower case
    rows = ["Amløse Vest"] * 20 + ["Aml°se Vest"] * 10 + ["Østerlund"] * 30 + ["østerlund"] * 4 + ["¿sterlund"]
    # correct: more frequent than what they could be restored to, or no sign goes
    rows += ["3° Nord"] * 12 + ["3ø"] * 6 + ["Ïle"] * 10 + ["Øle"] * 20 + ["Zone µ"] * 3
    got = {r.value: r.restored for r in garbled_values(_values(spark, rows)).collect()}
    assert got == {"Aml°se Vest": "Amløse Vest", "¿sterlund": "østerlund"}


def test_records_with_extra_columns_and_repeats(spark):
    rows = [(1, "AmlÃ¸se", "x", 1), (1, "AmlÃ¸se", "x", 1), (2, None, None, None), (3, "Amløse", "Ã˜", 3)]
    df = spark.createDataFrame(rows, "key long, a string, b string, n long")
    got = sorted((r.key, r.field_name, r.restored) for r in repair_records(df, "key", ["a", "b"]).collect())
    assert got == [(1, "a", "Amløse"), (1, "a", "Amløse"), (3, "b", "Ø")]
    assert repair_records(df.limit(0), "key", ["a", "b"]).count() == 0
