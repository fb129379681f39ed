"""Valid values that stand beside other numbers or words, and one number written in two ways."""

import re

import pytest

from tidemark.llm import feistel

CIPHER = feistel.Cipher("secret")


@pytest.mark.parametrize(
    ("text", "value", "kind"),
    [
        ("4111 1111 1111 1111 123", "4111 1111 1111 1111", "card"),
        ("4111 1111 1111 1111 12/25", "4111 1111 1111 1111", "card"),
        ("123 4111 1111 1111 1111 x", "4111 1111 1111 1111", "card"),
        ("AT61 1904 3002 3457 3201 BIC", "AT61 1904 3002 3457 3201", "iban"),
        ("at 2021-02-28T10:00:00Z", "2021-02-28", "date"),
    ],
)
def test_a_valid_value_is_hidden_whatever_follows(text, value, kind):
    new, counts = feistel.hide(CIPHER, text)
    assert dict(counts) == {kind: 1}
    assert new == text.replace(value, feistel.pseudonym(CIPHER, kind, value)) != text


def test_what_is_not_valid_stays():
    for text in ("4111 1111 1111 1112 123", " ".join(str(i % 9 + 1) for i in range(31)), "2021-02-30T10:00:00Z", "2021-02-28Today"):
        assert feistel.hide(CIPHER, text) == (text, {})


def test_one_phone_number_has_one_pseudonym_however_it_is_written():
    news = [feistel.hide(CIPHER, t)[0] for t in ("+15551234567", "+1 555 123 4567", "+1-555-123-4567")]
    assert len({re.sub(r"\D", "", n) for n in news}) == 1
    assert news[0][:2] == "+1" and news[0] != "+15551234567"
    assert feistel.pseudonym(CIPHER, "phone", news[0], back=True) == "+15551234567"
