"""IBANs followed by other upper-case words or numbers, and near words that speak against them."""

import pytest

from epispan.llm import pii

DE, GB = "DE89370400440532013000", "GB82WEST12345698765432"


def ibans_of(text):
    return [text[s.start : s.end] for s in pii.find_spans(text) if s.kind == "iban"]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        (f"{DE} BIC COBADEFF", [DE]),
        ("DE89 3704 0044 0532 0130 00 12", ["DE89 3704 0044 0532 0130 00"]),
        (f"{GB} I", [GB]),
        (f"{DE} {GB} OK", [DE, GB]),
        (f"AB12 CODE {DE} X", [DE]),
        (f"{DE}1 and {DE}A", []),
        ("NO9386011117947", ["NO9386011117947"]),
        ("DE89370400440532013001 BIC COBADEFF", []),
    ],
)
def test_iban_ends_with_its_country_length(text, want):
    assert ibans_of(text) == want


@pytest.mark.parametrize("word", ["invoice", "order", "part"])
def test_word_against_does_not_overrule_a_checksum(word):
    assert ibans_of(f"{word} paid to {DE} today") == [DE]
    assert pii.find_spans(f"{word} social 123-45-6789") == []


def test_every_iban_found_as_a_whole_run_is_still_found():
    country = next(c for c in ("ZZ", "QQ") if c not in pii.IBAN_LENGTHS)
    for body in ("12345678901234567", "1234567890123456789012"):
        for code in (country, "DE"):
            check = next(k for k in range(2, 99) if pii.mod97(f"{code}{k:02}{body}"))
            assert ibans_of(f"to {code}{check:02}{body}.") == [f"{code}{check:02}{body}"]
